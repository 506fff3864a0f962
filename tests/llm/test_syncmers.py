import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from thoughtloom.llm import syncmers
from thoughtloom.llm.catalog import QUERIES


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chain(values):
    """Hash of several hashes, each seeded by the one before."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest((v & (1 << 64) - 1).to_bytes(8, "little"), seed)
    return seed


def plain_anchors(text, k=syncmers.K, s=syncmers.S):
    h = [signed(xxhash.xxh64_intdigest(t.encode(), 42)) for t in re.findall(r"[^\x20\x09-\x0D]{1,24}", text or "")]
    cut = lambda values: chain(values) & ((1 << 48) - 1)
    inner = h
    for j in range(1, s):
        inner = [signed(chain([x, y])) for x, y in zip(inner, h[j:])]
    found = {}
    for i in range(len(h) - k + 1):
        window = inner[i : i + k - s + 1]
        if min(window) in (window[0], window[-1]):
            found.setdefault(cut(h[i : i + k]), i)
    return found or ({cut(h): 0} if h else {})


def plain_print(found):
    return "".join(f"{x:012x}" for x, _ in sorted(found.items(), key=lambda p: p[1]))


def plain_likeness(a, b):
    if not a and not b:
        return 1.0
    places = sorted((a[x], b[x]) for x in a.keys() & b.keys())
    in_order = sum(x[1] < y[1] for x, y in zip(places, places[1:])) + bool(places)
    return 2.0 * in_order / (len(a) + len(b))


def plain(rows):
    """rows in their order."""
    out = []
    for (i, text), (_, other) in zip(rows, rows[1:] + rows[:1]):
        text, other = text or "", other or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + other[:q]
        a, b, c = map(plain_anchors, (text, edited, other))
        sha = hashlib.sha256(edited.encode()).hexdigest()
        out.append((i, len(text), sha, plain_print(a), plain_print(b), plain_likeness(a, b), plain_likeness(a, c)))
    return out


def ordered(rows):
    tie = lambda t: signed(xxhash.xxh64_intdigest((t or "").encode(), 42))
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, tie(r[1])))


def test_whole_corpus_against_plain_python(spark, documents):
    folder, rows = documents
    got = sorted(map(tuple, QUERIES["op11_closed_syncmers"](spark, folder).collect()), key=str)
    assert got == sorted(plain(ordered(rows)), key=str)
    by_id = {}
    for r in got:
        by_id.setdefault(r[3], set()).add(r[0])
    assert len(by_id) > 50


@pytest.mark.parametrize("k,s", [(4, 1), (6, 2), (9, 4), (3, 3)])
def test_other_lengths(spark, documents, k, s):
    folder, rows = documents
    found = spark.read.parquet(f"{folder}/documents.parquet").select("text", syncmers.anchors(F.coalesce("text", F.lit("")), k, s).alias("a"))
    for r in found.collect():
        assert {x["hash"]: x["place"] for x in r.a} == plain_anchors(r.text, k, s)


def test_window_guarantee():
    """Of k - s + 1 runs in a row one is chosen, whatever the words."""
    words = [str(i * 7919 % 101) for i in range(400)]
    places = sorted(plain_anchors(" ".join(words)).values())
    assert max(b - a for a, b in zip(places, places[1:])) <= syncmers.K - syncmers.S


def test_small_buckets_and_wrap(spark):
    rows = [(i, " ".join(str(i * 31 + j) for j in range(i % 13))) for i in range(40)] + [(7, "again"), (None, "no id"), (None, None)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(7)
        assert sorted(map(tuple, syncmers.compare(docs).collect()), key=str) == sorted(plain(ordered(rows)), key=str)
        one = syncmers.compare(docs.where("doc_id = 12")).collect()
        assert [tuple(r) for r in one] == plain([r for r in rows if r[0] == 12]) and one[0].near_next == 1.0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_nothing_and_long_runs(spark, nothing):
    assert QUERIES["op11_closed_syncmers"](spark, nothing).count() == 0
    text = "".join(chr(97 + i * i % 26) for i in range(300_000))
    row = syncmers.compare(spark.createDataFrame([(1, text), (2, "x" * 300_000)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_chars for r in row} == {1: 300_000, 2: 300_000} and row[0].near_edited > 0.5

import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from thoughtloom.llm import collocations
from thoughtloom.llm.catalog import QUERIES
from llm_words import lowered


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text or "")):
        yield re.findall(r"[^\x20\x09]+", piece)


def plain(rows, most=3, least=10, first=2000, percent=50):
    """rows: (lang, text)."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for size in range(1, most + 1):
                f.setdefault(lang, Counter()).update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, found in f.items():
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i : i + size]] = max(inside[p[i : i + size]], a)
        scores = []
        for p, a in candidates.items():
            if p not in inside or 100 * inside[p] < percent * a:
                score, k = min((1_000_000 * a * a // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
                scores.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(scores)[:first], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def language(i):
    return [None, "en", "de", "en"][i % 4]


@pytest.fixture
def texts(documents):
    _, rows = documents
    out = [(language(k), t) for k, (_, t) in enumerate(rows * 3)]
    out += [("en", "a a a a a a a a a a a a\x00b a a, A\tA! x.y;z:w?v\rq\x0bq\x0cq")] * 11 + [("xx", "one lang only")] * 10 + [("yy", ",.;")]
    return out + [("de", "é   é é " * 12), ("en", "z" * 50_000), ("en", "p q r s t. " * 4 + "q r s. " * 8), ("en", " ".join(["w1", "w2"] * 40_000))]


@pytest.mark.parametrize("most,least,first,percent", [(3, 10, 2000, 50), (2, 3, 50, 50), (4, 5, 5000, 80), (3, 1, 10**6, 0)])
def test_against_plain_counting(spark, texts, most, least, first, percent):
    docs = spark.createDataFrame([(l, t, "x", 1) for l, t in texts], "lang string, text string, phrase string, n int").repartition(6)
    got = collocations.collocations(docs, most, least, first, percent)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(texts, most, least, first, percent)


def test_query_on_tables(spark, documents, nothing):
    folder, rows = documents
    assert sorted(map(tuple, QUERIES["op13_collocations"](spark, folder).collect())) == plain([(None, t) for _, t in rows])
    assert QUERIES["op13_collocations"](spark, nothing).count() == 0


def test_index_intervals():
    words = b"to be or not to be that is to be".split()
    shard = collocations._Shard()
    shard.add(words)
    shard.add(words[:3])
    row = shard.row("en", 3)
    index = collocations.Index(row)
    for length in (1, 2, 3):
        begin, size, number = index.intervals(length)
        got = {tuple(index.words[i] for i in p): int(n) for *p, n in zip(*index.phrases(begin, length), size)}
        assert got == Counter(tuple(w[i : i + length]) for w in (words, words[:3]) for i in range(len(w) - length + 1))
        assert number.max() == len(begin) - 1
    begin, size = index.enumerate(2, np.array([w in (b"to", b"be") for w in [index.words[i] for i in index.first[index.intervals(1)[0]]]]))
    assert {tuple(index.words[i] for i in p): int(n) for *p, n in zip(*index.phrases(begin, 2), size)} == {(b"to", b"be"): 4}


def test_memory_of_a_shard():
    """Peak bytes a place of the steps that hold a whole shard; two workers share an executor with its JVM."""
    rng = np.random.default_rng(7)
    shard = collocations._Shard()
    for _ in range(1 << 14):
        shard.add([b"w%d" % w for w in rng.zipf(1.4, 16) % 50_000])
    places = len(shard.ids)
    row = {"shard": 0, "unit": 0, **shard.row("en", 3)}
    batch = pa.RecordBatch.from_pylist([row])

    def peak(run, batch):
        tracemalloc.start()
        out = sum(1 for _ in run(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert out
        return most / places

    asked = [r for b in collocations._ask((1, 2), 4)(iter([batch])) for r in b.to_pylist()]
    judge = collocations._judge(1)
    told = [r for h in range(16) for r in judge(pa.Table.from_pylist([a for a in asked if a["hash_range"] == h])).to_pylist()]
    replies = [{k: r[k] for k in ("shard", "length", "hash_range", "bits")} for r in told]
    assert peak(collocations._ask((1, 2), 4), batch) < 40
    assert peak(collocations._tell(3, 4), pa.RecordBatch.from_pylist([row | {"replies": replies}])) < 65

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from llm_words import WORD, lowered
from pyspark.sql import functions as F

from thoughtloom.llm import connected, kneser_ney, line_dedup, simhash
from thoughtloom.llm.catalog import QUERIES
from thoughtloom.llm.common import mixed, squeeze, squeeze_sorted


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_substring_dedup(spark, documents):
    folder, rows = documents
    words = [(i, re.findall(WORD, t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - 12) if i is not None else ():
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    want = Counter()
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 12) if i is not None else ():
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        want[(i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))] += 1
    assert Counter(map(tuple, QUERIES["op5_substring_dedup"](spark, folder).collect())) == want
    assert sum(n for (_, _, n, _) in want) > 500


def test_line_dedup(spark, documents):
    folder, rows = documents
    lines = []
    for i, t in rows:
        for k, line in enumerate(lowered(t).split("\n") if t and i is not None else ()):
            if words := frozenset(re.findall(WORD, line)):
                lines.append((i, k, words))
    gone = defaultdict(set)
    for i, k, a in lines:
        if any((j, m) < (i, k) and 5 * len(a & b) >= 4 * len(a | b) for j, m, b in lines):
            gone[i].add(k)
    want = Counter()
    for i, t in rows:
        own = t.split("\n") if t is not None else []
        kept = "\n".join(x for k, x in enumerate(own) if k not in gone[i])
        want[(i, len(own), len(gone[i]), sha(kept) if t is not None else None)] += 1
    assert Counter(map(tuple, QUERIES["op6_line_dedup"](spark, folder).collect())) == want


def test_lines_of_equal_ids_with_different_texts(spark):
    shared = "one two three four five six"
    rows = [(0, shared + "\nnothing like it"), (1, shared + "\nanother line of its own"), (1, "only here unique words kept\n" + shared), (1, "only here unique words kept\n" + shared), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"], r["lines"]["n_removed"]) for r in line_dedup.remove_lines(docs).collect())
    assert got == {(0, rows[0][1], 0): 1, (1, "another line of its own", 1): 1, (1, "only here unique words kept", 1): 2, (1, None, 0): 1}


def test_lines_with_one_word_in_very_many(spark):
    """More sets under one word than are compared in the first pass; all are verified."""
    rows = [(i, f"common w{i} x{i}") for i in range(1500)] + [(5000, "common w7 x7"), (5001, "COMMON w8 x8")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in line_dedup.later_matches(docs).collect()}
    assert got == {(5000, 0), (5001, 0)}


def test_sets_in_order():
    sets = [np.arange(10), np.arange(9), np.arange(8), np.arange(50, 60)]
    gone = line_dedup.matched([s.astype(np.uint64) for s in sets])
    assert gone.tolist() == [False, True, True, False]


def test_long_lines_with_few_changes(spark):
    """Sketches of every width: similar lines of very different lengths are all found."""
    r = np.random.default_rng(6)
    rows = []
    for k, n in enumerate((5, 9, 30, 64, 65, 90, 150, 160, 299, 310, 900)):
        own = [f"l{k}w{x}" for x in range(n)]
        swapped, longer, far = own.copy(), own + [f"more{x}" for x in range(n // 5)], own.copy()
        for x in r.choice(n, n // 9, replace=False):
            swapped[x] = f"s{x}"
        for x in r.choice(n, n // 4 + 1, replace=False):
            far[x] = f"f{x}"
        rows += [(10 * k + x, " ".join(w)) for x, w in enumerate((own, swapped, longer, far))]
    sets = {i: set(t.split()) for i, t in rows}
    want = {(j, 0) for j in sets if any(i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for i in sets)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(x) for x in line_dedup.later_matches(docs).collect()} == want and len(want) > 15


def plain_fingerprint(text):
    w = re.findall(WORD, lowered(text or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, radius=3):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {v: find(v) for v in values}


def test_simhash(spark, documents):
    folder, rows = documents
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    roots, least = plain_components({p for _, p in prints}), {}
    for i, p in prints:
        if i is not None:
            least[roots[p]] = min(least.get(roots[p], i), i)
    want = Counter((i, f"{p:016x}", least.get(roots[p])) for i, p in prints)
    assert Counter(map(tuple, QUERIES["op8_simhash"](spark, folder).collect())) == want
    assert len(least) < len(prints) - 10
    # Some are linked by differing fingerprints, to the smaller id on either side.
    linked = [(i, least[roots[p]]) for i, p in prints if i is not None and i >= 3990]
    assert any(i != c for i, c in linked) and len({p for _, p in prints}) > len(set(roots.values()))


def test_every_pair_within_the_radius_collides():
    r = np.random.default_rng(1)
    for free in (simhash.ALL, 0xFFFF00FF0F0F1234, 0b1011011):
        positions = [i for i in range(64) if free >> i & 1]
        for _ in range(300):
            flips = sum(1 << int(i) for i in r.choice(positions, 3, replace=False))
            assert any(mask & flips == 0 for mask in simhash.masks(free, 3))


def test_crowded_buckets_are_split_without_loss(spark):
    r = np.random.default_rng(2)
    center = int(r.integers(0, 1 << 62))
    values = {center} | {center ^ (1 << int(a)) ^ (1 << int(b)) for a, b in r.integers(0, 64, (300, 2)) if a != b}
    values |= {int(x) for x in r.integers(0, 1 << 62, 200)}
    frame = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    found = simhash.links(frame, 3, crowded=8).collect()
    mask = (1 << 64) - 1
    assert all(((a & mask) ^ (b & mask)).bit_count() <= 3 for a, b in found)
    want = plain_components(values)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in found:
        root[find(a & mask)] = find(b & mask)
    same = lambda of: Counter(frozenset(x for x in values if of(x) == y) for y in {of(x) for x in values})
    assert same(find) == same(lambda v: want[v])


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = dict(map(tuple, connected.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_nothing(spark, nothing):
    for name in ("op5_substring_dedup", "op6_line_dedup", "op8_simhash"):
        assert QUERIES[name](spark, nothing).count() == 0


def test_hot_passage_counts_once_a_pack(spark):
    """A passage in every document, over several packs."""
    from thoughtloom.llm import common, substring_dedup

    passage = " ".join(f"p{k}" for k in range(20))
    docs = spark.createDataFrame([(i, f"a{i} {passage} b{i}") for i in range(200)], "doc_id long, text string").repartition(7)
    assert common.packs(docs, 500).count() > 20
    got = {r.doc_id: (r.n_removed, r.removed) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got.pop(0) == (0, []) and all(n == 20 and [tuple(s) for s in spans] == [(1, 21)] for n, spans in got.values())
    assert docs.where(F.col("doc_id") < 0).count() == 0


def test_a_missing_array_is_an_error(tmp_path):
    np.arange(3, dtype="<u8").tofile(tmp_path / "hash-0")
    assert kneser_ney.present(str(tmp_path), "hash-0", 3).tolist() == [0, 1, 2]
    assert kneser_ney.numbers(str(tmp_path), 1, (0, 3, 3), np.array([1, 9], np.uint64)).tolist() == [1, -1]
    assert not len(kneser_ney.present(str(tmp_path), "hash-1", 0))
    with pytest.raises(FileNotFoundError):
        kneser_ney.numbers(str(tmp_path), 1, (0, 3, 5), np.array([1, 1 << 63], np.uint64))
    # Once the mount shows the file, the next try finds it.
    np.array([1 << 63, (1 << 63) + 1], "<u8").tofile(tmp_path / "hash-1")
    assert kneser_ney.numbers(str(tmp_path), 1, (0, 3, 5), np.array([1, 1 << 63], np.uint64)).tolist() == [1, 3]


def test_lines_of_one_template_join_to_one_tree():
    """Lines that differ in one word share their frequent words; runs of one root are skipped."""
    n = 3000
    empty = squeeze(np.zeros(0, np.uint64))
    names = mixed(np.arange(n, dtype=np.uint64))
    row = {"words": squeeze_sorted(np.full(n, 7, np.uint64)), "lines": squeeze(np.arange(n, dtype=np.uint32)),
           "positions": squeeze(np.zeros(n, np.uint32)), "names": squeeze(names), "sizes": squeeze(np.full(n, 20, np.uint32)),
           "sketches": squeeze(np.full(n, 5, np.uint64)), "firsts": empty}
    pairs = line_dedup._joined([row]).view(np.uint64)
    assert len(pairs) == n - 1 and set(pairs.ravel().tolist()) == set(names.tolist())

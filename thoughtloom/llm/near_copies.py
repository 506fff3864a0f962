"""Near copies by SimHash over word shingles: verified pairs of a wanted Jaccard similarity.

A document is the set of its runs of ``SHINGLE`` lower-cased (A-Z) words; fewer words
are one run. Two documents are linked if their sets' Jaccard similarity is 0.8 or more,
and get the component of the links.

Candidates are first the documents whose SimHash fingerprints over the same runs lie
within ``RADIUS`` bits (``simhash.links``). At 0.8 fingerprints differ in about 10 bits with
a spread of 3, and covering masks take 2,047 tables for radius 10 alone, so what the
radius leaves apart is completed by minimum hashes: ``HASHES`` minima a set, and ``BANDS``
keys of ``ROWS`` of them each; a pair at 0.8 shares no key with a chance of about one in a
million by estimate, a closer one less. Every candidate is verified on the whole sets, and
sets that fingerprints have joined are not compared again.

A key's sets are first compared with one of them, so that a group of near copies costs a
comparison each. Where a key still holds sets of several components, its pairs across
components are compared too; within a component nothing is left to find.

Only distinct sets take part; equal sets are copies. Rows without an id take no part.
Texts without words are copies of each other. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thoughtloom.llm import simhash
from thoughtloom.llm.common import flat, lower_ascii, mixed, rolling, slices, span_hashes, squeeze_sorted, unsqueeze_sorted, word_spans
from thoughtloom.llm.connected import components
from thoughtloom.session import materialise

#: Words of a shingle, and the similarity as a fraction.
SHINGLE, SIMILAR = 5, (4, 5)
#: Bits in which the fingerprints of candidates differ at most.
RADIUS = 3
HASHES, BANDS, ROWS = 256, 96, 8

_RANDOM = np.random.default_rng(42)
_FACTORS = _RANDOM.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32) | np.uint32(1)
_SHIFTS = _RANDOM.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)
_PICKED = np.stack([_RANDOM.choice(HASHES, ROWS, replace=False) for _ in range(BANDS)])


def shingles(text: str | None) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct shingles of a text."""
    data = lower_ascii(flat(text))
    words = span_hashes(data, *word_spans(data))
    return np.unique(rolling(words, min(SHINGLE, len(words)))) if len(words) else words


def name_of(found: np.ndarray) -> int:
    """Hash of a set of shingles."""
    total = np.add.reduce(mixed(found + np.uint64(1)), dtype=np.uint64) if len(found) else np.uint64(0)
    return int(mixed(np.array([total], np.uint64) + np.uint64(len(found))).view(np.int64)[0])


def keys(found: np.ndarray) -> np.ndarray:
    """Keys of a set, one a band: similar sets share one."""
    short, least = (found >> np.uint64(32)).astype(np.uint32), np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(least, (short[at : at + 512, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    bands = rolling(mixed(least[_PICKED].reshape(-1).astype(np.uint64) + np.uint64(1)), ROWS)[::ROWS]
    return mixed(bands + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    rows = docs.where(F.col("doc_id").isNotNull())
    return rows.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("digest", F.xxhash64("text"))


def _named(batches):
    for batch in batches:
        for part in slices(batch, 1):
            texts = part.column(1).to_pylist()
            sets, fps = [shingles(t) for t in texts], np.array([simhash.fingerprint(t, SHINGLE) for t in texts], np.uint64)
            columns = [part.column(0), part.column(2), pa.array([name_of(s) for s in sets], pa.int64())]
            columns += [pa.array([len(s) for s in sets], pa.int32()), pa.array([keys(s).tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fps.view(np.int64))], ["doc_id", "digest", "name", "size", "keys", "fp"])


def _keyed(batches):
    for batch in batches:
        found = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int64)
        columns = [found, *[np.repeat(batch.column(c).to_numpy(), BANDS) for c in ("name", "size")]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "name", "size"])


def _sets(batches):
    for batch in batches:
        for part in slices(batch, 1):
            found = [squeeze_sorted(shingles(t)) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["name", "held"])


def _similar(batches):
    """Pairs (a, b) whose sets held_a and held_b reach the similarity."""
    n, d = SIMILAR
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("held_a"), batch.column("held_b"), strict=True):
            x, y = (unsqueeze_sorted(s.as_py(), np.uint64) for s in (x, y))
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(common * d >= (len(x) + len(y) - common) * n)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _close(a: str, b: str):
    """Whether sets of two sizes can be similar."""
    n, d = SIMILAR
    return F.least(a, b) * d >= F.greatest(a, b) * n


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    joined = pairs.join(sets.toDF("a", "held_a"), "a").join(sets.toDF("b", "held_b"), "b")
    return materialise(joined.mapInArrow(_similar, "a long, b long"))


def fingerprint_pairs(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints lie within the radius, as many as join what the radius joins."""
    known = distinct.where("size > 0").select("name", "size", "fp")
    heads = materialise(known.groupBy("fp").agg(F.min(F.struct("name", "size")).alias("head")))
    linked = simhash.links(heads.select("fp"), RADIUS)
    ends = [heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}")) for c in "ab"]
    near = linked.join(ends[0], "a").join(ends[1], "b").select("head_a", "head_b")
    equal = known.join(heads, "fp").where(F.col("name") != F.col("head.name"))
    both = near.union(equal.select("head", F.struct("name", "size"))).where(_close("head_a.size", "head_b.size"))
    return materialise(both.select(F.col("head_a.name").alias("a"), F.col("head_b.name").alias("b")).distinct())


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the component of their set, which is its own where nothing links it."""
    return rows.join(roots.toDF("name", "root"), "name", "left").withColumn("root", F.coalesce("root", "name"))


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, first_id, first_digest): each distinct row by the hash of its text, and the first of its component.

    The first row has the smallest id, of equal ids the smallest digest.
    """
    rows = _rows(docs)
    marked = materialise(rows.mapInArrow(_named, "doc_id long, digest long, name long, size int, keys binary, fp long"))
    place = F.struct("doc_id", "digest")
    firsts = [F.min(place).alias("place"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.min("fp").alias("fp")]
    distinct = materialise(marked.groupBy("name").agg(*firsts))
    near = fingerprint_pairs(distinct)
    # Derived from the compact column wherever they are read: written as rows, keys take more
    # disk than they save time. Those of one set are dropped after a combinable count.
    keyed = distinct.where("size > 0").select("name", "size", "keys").mapInArrow(_keyed, "key long, name long, size int")
    shared = materialise(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    met = materialise(keyed.join(shared, "key"))
    wanted = met.select("name").union(near.select("a")).union(near.select("b")).distinct()
    wanted = distinct.join(wanted, "name", "left_semi")
    wanted = wanted.select("name", F.col("place.doc_id").alias("doc_id"), F.col("place.digest").alias("digest"))
    texts = rows.join(wanted, ["doc_id", "digest"]).dropDuplicates(["name"]).select("name", "text")
    sets = materialise(texts.mapInArrow(_sets, "name long, held binary"))
    links = _verified(near, sets)
    apart = materialise(_rooted(met, materialise(components(links))))
    heads = apart.groupBy("key").agg(F.min(F.struct("name", "size", "root")).alias("head"))
    to_head = apart.join(heads, "key").where((F.col("root") != F.col("head.root")) & _close("size", "head.size"))
    to_head = materialise(to_head.select(F.col("head.name").alias("a"), F.col("name").alias("b")).distinct())
    links = links.union(_verified(to_head, sets))
    roots = materialise(components(links))
    inside = materialise(_rooted(met, roots).select("key", "name", "size", "root"))
    several = inside.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    rest = materialise(inside.join(several, "key"))
    one = rest.select("key", *[F.col(c).alias(f"{c}_a") for c in ("name", "size", "root")])
    other = rest.select("key", *[F.col(c).alias(f"{c}_b") for c in ("name", "size", "root")])
    across = one.join(other, "key").where((F.col("name_a") < F.col("name_b")) & (F.col("root_a") != F.col("root_b")))
    across = across.where(_close("size_a", "size_b")).select(F.col("name_a").alias("a"), F.col("name_b").alias("b")).distinct()
    across = materialise(across.join(to_head, ["a", "b"], "left_anti"))
    if not across.isEmpty():
        roots = materialise(components(links.union(_verified(across, sets))))
    named = materialise(_rooted(distinct.select("name", "place"), roots))
    firsts = named.groupBy("root").agg(F.min("place").alias("first"))
    whole = named.join(firsts, "root").select("name", "first")
    found = marked.select("doc_id", "digest", "name").distinct().join(whole, "name")
    return found.select("doc_id", "digest", F.col("first.doc_id").alias("first_id"), F.col("first.digest").alias("first_digest"))

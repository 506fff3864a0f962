"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing.

A 64-bit fingerprint has a bit where more than half of the hashes of the text's word
shingles have it. Fingerprints within ``radius`` bits are linked, and documents get
the component of the links.

The links are found without misses: each bit position gets a vector of ``radius + 1``
bits, each non-zero vector v names a table whose mask holds the positions with odd
inner product, and any ``radius`` positions leave some v orthogonal to all of them;
so a pair that differs in these positions has equal bits under v's mask. A table's
mask keeps about half of the bits. A bucket with many fingerprints is split by
covering masks over the bits its own mask leaves out, which misses nothing for the
same reason, until few bits are left to differ; so no bucket is larger than
``2 ** (64 - bits fixed)`` fingerprints and no group of near copies is one task.

Only distinct fingerprints take part, so copies cost one row each; buckets of one
fingerprint are dropped after a combinable count; a bucket emits a spanning forest of
its links, never all pairs, which keeps every component.

Nulls: a null or wordless text has fingerprint zero, linked like any other. A null
document id takes part and gets its component; a component of null ids alone has a
null component id. Repeated rows get a row each. An empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thoughtloom.llm.common import flat, lower_ascii, slices
from thoughtloom.llm.connected import components
from thoughtloom.session import materialise

SEED = 42


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash of the lower-cased (A-Z) words; fewer words than a shingle are one shingle."""
    words = lower_ascii(flat(text)).split()
    if not words:
        return 0
    data = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(data, SEED)], np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = (np.cumsum(sizes) - sizes).tolist()
        ends = (np.cumsum(sizes) - 1).tolist()[shingle - 1 :]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(data[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(ends))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint's bits as a signed 64-bit integer."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                fps = np.array([fingerprint(t, shingle) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, fp long")


@lru_cache(maxsize=100_000)
def masks(free: int, radius: int) -> tuple[int, ...]:
    """Masks over the set bits of ``free``: any ``radius`` of them miss one mask at least."""
    size = 1 << (radius + 1)
    vectors, mask = {}, [0] * size
    positions = [i for i in range(64) if free >> i & 1]
    for k, position in enumerate(positions):
        vectors[position] = k % (size - 1) + 1  # every vector equally often
    for v in range(1, size):
        for position, vector in vectors.items():
            if (v & vector).bit_count() & 1:
                mask[v] |= 1 << position
    return tuple(mask[1:])


ALL = (1 << 64) - 1
KEYED = "fp long, mask long, value long"


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keyed(rows: DataFrame, radius: int) -> DataFrame:
    """Rows of (fp, mask so far) in each bucket of the next tables: mask fixed, bits under it."""

    def run(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            fixed = batch.column("mask").to_numpy().view(np.uint64)
            for mask in np.unique(fixed).tolist():
                own = fps[fixed == np.uint64(mask)]
                for more in masks(ALL & ~mask, radius):
                    now = mask | more
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(own.view(np.int64)),
                            pa.array(np.full(len(own), signed(now), np.int64)),
                            pa.array((own & np.uint64(now)).view(np.int64)),
                        ],
                        ["fp", "mask", "value"],
                    )

    return rows.select("fp", "mask").mapInArrow(run, KEYED)


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that span the components of distinct fingerprints: breadth first, a row of distances at a time."""
    left, links = np.sort(fps), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            here = queue.pop()
            near = np.bitwise_count(left ^ here) <= radius
            if near.any():
                found = left[near]
                links += [(int(here), int(x)) for x in found]
                queue += list(found)
                left = left[~near]
        # The component is complete; the rest belongs to others.
    return links


def links(distinct: DataFrame, radius: int = 3, crowded: int = 512) -> DataFrame:
    """Links (a, b) among distinct fingerprints that keep every component of the radius."""
    found, level = None, distinct.select("fp", F.lit(0).cast("long").alias("mask"))

    def spanning(batches):
        """Links within the buckets of a sorted partition; a bucket may go on in the next batch."""
        held = np.zeros((3, 0), np.int64)
        for batch in chain(batches, [None]):
            if batch is not None:
                held = np.concatenate([held, [batch.column(n).to_numpy() for n in ("mask", "value", "fp")]], axis=1)
            same = (held[:2, 1:] == held[:2, :-1]).all(axis=0)
            starts = np.append(0, np.flatnonzero(~same) + 1)
            ends = np.append(starts[1:], held.shape[1])
            if batch is not None:  # the last bucket may not be complete
                keep, starts, ends = starts[-1], starts[:-1], ends[:-1]
            fps = held[2].view(np.uint64)
            two = starts[ends - starts == 2]
            two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
            pairs = [np.stack([fps[two], fps[two + 1]], axis=1)]
            for a, b in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
                pairs.append(np.array(forest(fps[a:b], radius), np.uint64).reshape(-1, 2))
            sides = np.ascontiguousarray(np.concatenate(pairs)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sides[:, 0]), pa.array(sides[:, 1])], ["a", "b"])
            if batch is not None:
                held = held[:, keep:]

    while True:
        rows = materialise(keyed(level, radius))
        sizes = rows.groupBy("mask", "value").count().where("count > 1")
        met = materialise(rows.join(sizes, ["mask", "value"]))
        small = met.where((F.col("count") <= crowded) | (F.bit_count(F.bitwise_not("mask")) <= 12))
        dealt = small.select("mask", "value", "fp").repartition("mask", "value").sortWithinPartitions("mask", "value")
        now = dealt.mapInArrow(spanning, "a long, b long")
        now = materialise(now.distinct())
        found = now if found is None else found.union(now)
        rest = met.where((F.col("count") > crowded) & (F.bit_count(F.bitwise_not("mask")) > 12))
        if rest.isEmpty():
            return found
        level = rest.select("fp", "mask").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id reachable over links of the radius."""
    marked = materialise(fingerprints(docs, shingle))
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(least.select("fp"), radius))
    # A component's id is the smallest document id of its fingerprints.
    inside = materialise(roots.join(least, roots["node"] == least["fp"]).select("fp", "root", "first_id"))
    named = inside.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = inside.join(named, "root").select("fp", "component_id")
    whole = least.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return marked.join(whole, "fp").select("doc_id", "fp", "component_id")

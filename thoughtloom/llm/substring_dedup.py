"""Removal of long word passages that repeat across documents, by fixed-block anchors.

With windows of 13 words, every window holds exactly one of the non-overlapping
7-word blocks of its document. These blocks are indexed, and every rolling 7-word
window of every document probes the index. Anchors are blocks found in more than one
document. Each hit is extended to maximal exact repeats: the 13-word windows around
it are compared by 64-bit hashes of their word sequences, and the overlapping matches
join into the repeats. A word goes if a window that covers it also starts in a
document with a smaller id; windows are those of the input.

Documents are kept in compressed packs. What a pack sends is unique within the pack
and compressed (a few bytes a window), so a passage that a third of all documents
share costs a row a pack, in shards picked by hash; a pack answers for repeats inside
it on its own. Only windows at anchors are sent in full. Shards grow in number with
the words, never in size. All steps are written to the shared folder or shuffled.

Nulls: a null text has no words; documents without an id take no part and are kept
whole. Rows with equal ids are one document as far as order goes: they remove nothing
from each other. Documents of fewer words than a window are kept whole. An empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thoughtloom.llm.common import (
    WordHashes,
    by_shard,
    packs,
    power_of_two,
    ranges,
    rolling,
    rows_of,
    squeeze,
    squeeze_sorted,
    unpack,
    unsqueeze,
    unsqueeze_sorted,
)
from thoughtloom.session import materialise

_WINDOW_MULTIPLIER = np.uint64(0xC2B2AE3D27D4EB4F)
_HASHES = WordHashes()


class Words:
    """Word hashes of a pack, and where windows may start."""

    def __init__(self, row: dict, window: int):
        self.ids, self.known, self.texts = unpack(row)
        found = [_HASHES.of(t.split()) for t in self.texts]
        self.sizes = np.array([len(x) for x in found], np.int64)
        self.hashes = np.concatenate([np.zeros(0, np.uint64), *found])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.window = window
        self.takes_part = self.known & (self.sizes >= window)

    def places(self, width: int) -> np.ndarray:
        """Starts of runs of ``width`` words inside a document that takes part."""
        sizes = np.where(self.takes_part, self.sizes - width + 1, 0)
        return ranges(self.starts, sizes)

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1


class Anchors:
    """Distinct rolling blocks of a pack in the order of their shortened hashes."""

    def __init__(self, words: Words, block: int, bits: int):
        self.places = words.places(block)
        hashes = rolling(words.hashes, block)[self.places] >> np.uint64(32 - bits)
        self.order = np.argsort(hashes)
        ordered = hashes[self.order]
        self.first = np.append(True, ordered[1:] != ordered[:-1]) if len(ordered) else np.zeros(0, bool)
        self.keys = ordered[self.first]
        self.shards = by_shard((self.keys >> np.uint64(32)).astype(np.int64), 1 << bits)

    def active_places(self, active: np.ndarray) -> np.ndarray:
        """Starts of the blocks whose key is active."""
        return self.places[self.order[active[np.cumsum(self.first) - 1]]] if len(self.order) else self.places


def _sent(block: int, window: int, bits: int):
    def run(batches):
        for row in rows_of(batches):
            words = Words(row, window)
            anchors = Anchors(words, block, bits)
            if not len(anchors.keys):
                continue
            document = words.document(anchors.places)
            indexed = ((anchors.places - words.starts[document]) % block == 0)[anchors.order]
            at = np.flatnonzero(anchors.first)
            document = document[anchors.order]
            indexed = np.logical_or.reduceat(indexed, at)
            several = np.maximum.reduceat(document, at) != np.minimum.reduceat(document, at)
            out = [
                (s, row["pack_id"], squeeze_sorted(anchors.keys[a:b].astype(np.uint32)),
                 squeeze(np.packbits(indexed[a:b])), squeeze(np.packbits(several[a:b])))
                for s, a, b in anchors.shards
            ]
            yield pa.RecordBatch.from_pydict(dict(zip(("shard", "pack_id", "keys", "indexed", "several"), zip(*out, strict=True), strict=True)))

    return run


def _met(table: pa.Table) -> pa.Table:
    """For each pack of a shard, which of its keys are anchors: indexed somewhere, in two documents."""
    keys, indexed, several, sizes = [], [], [], []
    for row in rows_of(table.to_batches()):
        keys.append(unsqueeze_sorted(row["keys"], np.uint32))
        sizes.append(len(keys[-1]))
        indexed.append(np.unpackbits(unsqueeze(row["indexed"], np.uint8), count=sizes[-1]))
        several.append(np.unpackbits(unsqueeze(row["several"], np.uint8), count=sizes[-1]))
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.append(True, ordered[1:] != ordered[:-1])
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(key)))
    anchor = np.logical_or.reduceat(np.concatenate(indexed)[order], at) & (
        (counts > 1) | np.logical_or.reduceat(np.concatenate(several)[order], at)
    )
    active = np.zeros(len(key), bool)
    active[order] = anchor[np.cumsum(first) - 1]
    out = []
    for i, part in enumerate(np.split(active, np.cumsum(sizes)[:-1])):
        if part.any():
            out.append((table.column("pack_id")[i].as_py(), table.column("shard")[i].as_py(), squeeze(np.packbits(part))))
    pack_id, shard, flags = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"pack_id": pa.array(pack_id, pa.int64()), "shard": pa.array(shard, pa.int64()), "active": pa.array(flags, pa.binary())})


def _extended(block: int, window: int, bits: int):
    """Windows at anchors: those matched inside the pack, and the rest for the shards."""

    def run(batches):
        for row in rows_of(batches):
            words = Words(row, window)
            anchors = Anchors(words, block, bits)
            active = np.zeros(len(anchors.keys), bool)
            spans = {s: (a, b) for s, a, b in anchors.shards}
            for reply in row["replies"]:
                a, b = spans[reply["shard"]]
                active[a:b] = np.unpackbits(unsqueeze(reply["active"], np.uint8), count=b - a)
            hit = np.zeros(len(words.hashes) + 1, np.int64)
            hit[anchors.active_places(active) + 1] = 1
            hit = np.cumsum(hit)
            places = words.places(window)
            places = places[hit[places + window - block + 1] > hit[places]]
            if not len(places):
                continue
            hashes = rolling(words.hashes, window, _WINDOW_MULTIPLIER)[places]
            ids = words.ids[words.document(places)]
            order = np.lexsort((ids, hashes))
            hashes, ids, places = hashes[order], ids[order], places[order]
            first = np.append(True, hashes[1:] != hashes[:-1])
            least = ids[first][np.cumsum(first) - 1]
            later = ids > least
            shards = (hashes[~later] >> np.uint64(64 - bits)).astype(np.int64)
            out = [(-1 - row["pack_id"] % (1 << bits), row["pack_id"], b"", b"", squeeze_sorted(np.sort(places[later])))]
            for s, a, b in by_shard(shards, 1 << bits):
                out.append((s, row["pack_id"], squeeze_sorted(hashes[~later][a:b]), squeeze(ids[~later][a:b]), squeeze(places[~later][a:b])))
            yield pa.RecordBatch.from_pydict(dict(zip(("shard", "pack_id", "hashes", "ids", "places"), zip(*out, strict=True), strict=True)))

    return run


def _judged(table: pa.Table) -> pa.Table:
    """For each pack of a shard, the starts of windows that a smaller id has."""
    out, rows = [], []
    for row in rows_of(table.to_batches()):
        if row["shard"] < 0:
            out.append((row["pack_id"], row["places"]))
        else:
            rows.append((row["pack_id"], *(f(row[n], d) for f, n, d in ((unsqueeze_sorted, "hashes", np.uint64), (unsqueeze, "ids", np.int64), (unsqueeze, "places", np.int64)))))
    if rows:
        hashes, ids, places = (np.concatenate([r[k] for r in rows]) for k in (1, 2, 3))
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        first = np.append(True, ordered[1:] != ordered[:-1])
        least = np.minimum.reduceat(ids[order], np.flatnonzero(first))
        later = np.zeros(len(ids), bool)
        later[order] = ids[order] > least[np.cumsum(first) - 1]
        bounds = np.cumsum([len(r[1]) for r in rows])[:-1]
        for row, own, place in zip(rows, np.split(later, bounds), np.split(places, bounds), strict=True):
            if own.any():
                out.append((row[0], squeeze_sorted(np.sort(place[own]))))
    pack_id, found = zip(*out, strict=True) if out else ((), ())
    return pa.table({"pack_id": pa.array(pack_id, pa.int64()), "places": pa.array(found, pa.binary())})


RESULT = "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start:long,stop:long>>"


def _rewritten(window: int):
    names = [x.split()[0] for x in RESULT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]

    def run(batches):
        for row in rows_of(batches):
            ids, known, texts = unpack(row)
            split = [t.split() for t in texts]
            sizes = np.array([len(x) for x in split], np.int64)
            edge = np.zeros(int(sizes.sum()) + 1, np.int64)
            for found in row["found"] or []:
                places = unsqueeze_sorted(found, np.int64)
                np.add.at(edge, places, 1)
                np.add.at(edge, places + window, -1)
            gone = np.cumsum(edge)[:-1] > 0
            out, at = [], 0
            for doc_id, is_known, words in zip(ids.tolist(), known.tolist(), split, strict=True):
                own = gone[at : at + len(words)]
                at += len(words)
                spans = []
                if own.any():
                    turns = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
                    spans = [{"start": a, "stop": b} for a, b in turns.reshape(-1, 2).tolist()]
                    kept = b" ".join(w for w, g in zip(words, own.tolist(), strict=True) if not g)
                else:
                    kept = b" ".join(words)
                out.append((doc_id if is_known else None, len(words), int(own.sum()), kept.decode("utf-8", "surrogatepass"), spans))
            for i in range(0, len(out), 500):
                columns = zip(*out[i : i + 500], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def remove_repeats(docs: DataFrame, window: int = 13, words_per_shard: int = 2_000_000) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, removed): texts without passages of smaller ids, and their word spans."""
    block = (window + 1) // 2
    held = materialise(packs(docs))
    words = held.agg(F.sum("n_words")).first()[0] or 0
    bits = power_of_two(words / words_per_shard)
    sent = held.mapInArrow(_sent(block, window, bits), "shard long, pack_id long, keys binary, indexed binary, several binary")
    met = sent.groupBy("shard").applyInArrow(_met, "pack_id long, shard long, active binary")
    replies = met.groupBy("pack_id").agg(F.collect_list(F.struct("shard", "active")).alias("replies"))
    extended = held.join(replies, "pack_id").mapInArrow(
        _extended(block, window, bits), "shard long, pack_id long, hashes binary, ids binary, places binary"
    )
    judged = extended.groupBy("shard").applyInArrow(_judged, "pack_id long, places binary")
    found = judged.groupBy("pack_id").agg(F.collect_list("places").alias("found"))
    return held.join(found, "pack_id", "left").mapInArrow(_rewritten(window), RESULT)

"""Helpers shared by the operators: words, hashes, packed columns, documents in packs."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multipliers of the rolling hashes and of the finalizer.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
FINALIZER = np.uint64(0xFF51AFD7ED558CCD)

_CACHE_LIMIT = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat(text: str | None) -> bytes:
    """UTF-8 bytes; a null text is empty. ``bytes.split()`` then splits at 0x20 and 0x09-0x0D."""
    return text.encode("utf-8", "surrogatepass") if text else b""


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lower_ascii(data: bytes) -> bytes:
    return data.translate(_LOWER)


class WordHashes(dict):
    """64-bit hash of a word; remembers a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_LIMIT:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of a text in bytes."""
    bytes_ = np.frombuffer(data, np.uint8)
    space = np.ones(len(bytes_) + 2, np.int8)
    space[1:-1] = (bytes_ == 32) | ((bytes_ >= 9) & (bytes_ <= 13))
    edges = np.diff(space)
    return np.flatnonzero(edges < 0), np.flatnonzero(edges > 0)


_BLOCK = 1 << 17


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2 ** 64."""
    steps = np.full((2, n), [[MULTIPLIER], [np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))]], np.uint64)
    steps[:, 0] = 1
    return tuple(np.cumprod(steps, axis=1))


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word of a text: its bytes as digits to the base of the multiplier.

    Sums of whole blocks give all words of a block at once, whatever their number.
    """
    bytes_, out = np.frombuffer(data, np.uint8), np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        first = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, first + _BLOCK, "right")))
        block = bytes_[first : ends[stop - 1]]
        power, inverse = _powers(max(_BLOCK, 1 << (len(block) - 1).bit_length()))
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * power[: len(block)], out=sums[1:])
        a, b = starts[at:stop] - first, ends[at:stop] - first
        out[at:stop] = (sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64)
        at = stop
    return mixed(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly, so that their high bits can name a shard."""
    h = h ^ (h >> np.uint64(33))
    h = h * FINALIZER
    return h ^ (h >> np.uint64(29))


def rolling(hashes: np.ndarray, width: int, multiplier: np.uint64 = MULTIPLIER) -> np.ndarray:
    """Hash of each run of ``width`` values; empty if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, width):
        out *= multiplier
        out += hashes[j : j + n]
    return mixed(out)


def squeeze(values: np.ndarray) -> bytes:
    """Array to compressed bytes, byte planes apart, so that small numbers cost little."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize) if len(values) else b""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes() if len(values) else b"")


def unsqueeze(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(dtype) if len(raw) else np.zeros(0, dtype)


def squeeze_sorted(values: np.ndarray) -> bytes:
    """As ``squeeze`` for ascending values, by their differences."""
    return squeeze(np.diff(values, prepend=values.dtype.type(0)))


def unsqueeze_sorted(data: bytes, dtype) -> np.ndarray:
    return np.cumsum(unsqueeze(data, dtype), dtype=dtype)


def by_shard(shards: np.ndarray, count: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) of the runs of an ascending array of shard numbers."""
    bounds = np.searchsorted(shards, np.arange(count + 1))
    return [(s, int(a), int(b)) for s, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]


def power_of_two(wanted: float, least_bits: int = 4, most_bits: int = 20) -> int:
    """Exponent of the shard count for a wanted number of shards."""
    return int(min(most_bits, max(least_bits, np.ceil(np.log2(max(1.0, wanted))))))


# -- documents in packs ------------------------------------------------------------

PACK = "pack_id long, n_words long, n_docs long, ids binary, known binary, sizes binary, texts binary"


def packs(docs: DataFrame, pack_bytes: int = 8_000_000) -> DataFrame:
    """Rows of (doc_id, text) as compressed packs of some megabytes.

    A pack is the unit that later passes answer to: its ``pack_id`` is unique once
    the frame is written, and its rows keep their order. A text larger than
    ``pack_bytes`` is a pack of its own.
    """

    def run(batches):
        part, serial = TaskContext.get().partitionId(), 0
        ids, texts, held = [], [], 0

        def flush():
            nonlocal ids, texts, held, serial
            known = np.array([i is not None for i in ids], np.uint8)
            row = {
                "pack_id": [(part << 32) | serial],
                "n_words": [sum(len(t.split()) for t in texts)],
                "n_docs": [len(ids)],
                "ids": [squeeze(np.array([i or 0 for i in ids], np.int64))],
                "known": [squeeze(known)],
                "sizes": [squeeze(np.array([len(t) for t in texts], np.int64))],
                "texts": [zstandard.ZstdCompressor(level=3).compress(b"".join(texts))],
            }
            serial += 1
            ids, texts, held = [], [], 0
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                data = flat(text.as_py())
                if held and held + len(data) > pack_bytes:
                    yield flush()
                ids.append(doc_id.as_py())
                texts.append(data)
                held += len(data)
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PACK)


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Ids, whether they are known, and texts of a pack."""
    ids, known = unsqueeze(row["ids"], np.int64), unsqueeze(row["known"], np.uint8).astype(bool)
    blob, texts, at = zstandard.ZstdDecompressor().decompress(row["texts"]), [], 0
    for size in unsqueeze(row["sizes"], np.int64).tolist():
        texts.append(blob[at : at + size])
        at += size
    return ids, known, texts


def rows_of(batches):
    """Rows of Arrow batches, one by one."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated ranges start .. start + size."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total) - np.repeat(ends - sizes, sizes) + np.repeat(starts, sizes)


# -- chunks between which tokens never reach ----------------------------------------

#: A word with the space before it; else white space up to the one before a word, or that one.
CHUNK = re.compile(r" ?[^\t-\r ]+|[\t-\r ]+(?=[\t-\r ][^\t-\r ])|[\t-\r ]+")
#: Other white space (and controls some engines count as such): such texts aren't cut.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


class ChunkIds(dict):
    """Token ids of chunks as packed little-endian unsigned 32-bit integers.

    A token never crosses from other characters to white space, so a text is the
    concatenation of its chunks and most of them are met again; a bounded number of
    short ones is remembered. ``encode_lines`` gets words, each with one space before
    it at most; ``encode_one`` any text. ``whole`` tells texts
    that must not be cut.
    """

    def __init__(self, encode_lines, encode_one, whole=None, limit: int = 500_000):
        super().__init__()
        self.encode_lines, self.encode_one, self.limit = encode_lines, encode_one, limit
        self.whole = whole or (lambda text: False)

    def encode(self, texts: list[str]) -> list[bytes]:
        uncut = [bool(ODD_SPACE.search(t)) or self.whole(t) for t in texts]
        cut = [[] if u else CHUNK.findall(t) for u, t in zip(uncut, texts, strict=True)]
        if len(self) > self.limit:
            self.clear()
        wanted = [c for c in set().union(*cut) if c not in self]
        words = [c for c in wanted if c[-1] > " "]
        self.update(zip(words, self.encode_lines(words) if words else (), strict=True))
        self.update((c, self.encode_one(c)) for c in wanted if c[-1] <= " ")
        get = self.__getitem__
        out = [
            self.encode_one(t) if u else b"".join(map(get, chunks)) for u, t, chunks in zip(uncut, texts, cut, strict=True)
        ]
        for chunk in wanted:
            if len(chunk) > 64:
                del self[chunk]
        return out


def split_ids(ids: np.ndarray, separator: int, groups: np.ndarray) -> list[bytes]:
    """Packed ids of each group of ``groups`` parts, where a separator stands between all parts."""
    ends = np.append(np.flatnonzero(ids == separator), len(ids))
    last = np.cumsum(groups) - 1
    stops = (ends - np.arange(len(ends)))[last] * 4
    data = ids[ids != separator].astype("<u4").tobytes()
    return [data[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]


def slices(batch: pa.RecordBatch, text_column: int, most_bytes: int = 2_000_000):
    """Parts of a batch whose texts have at most so many bytes (one row at least)."""
    column = batch.column(text_column)
    sizes = [x or 0 for x in pc.binary_length(column).to_pylist()]
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)

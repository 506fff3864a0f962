"""Byte-level BPE encoding and decoding with a sentencepiece model made from the ranks.

The vocabulary file (base64 token and rank a line) becomes a sentencepiece BPE model
without any training: every token is a piece whose bytes are mapped to printable
characters, its score is the negative rank, normalisation is the identity. Encoding
splits a text by the pre-token pattern, maps each pre-token's bytes to the same
characters and lets sentencepiece merge; decoding joins the bytes of the ids.

Nulls: a null text is empty, a null id list decodes to no bytes. Empty texts have no
tokens. Rows are handled one by one, so ties, repeated rows and empty tables need
nothing special; other columns of the input are not read.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from thoughtloom.llm.common import ChunkIds, slices, split_ids


@lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[bytes, ...]:
    """Bytes of each id."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return tuple(ranks[i] for i in range(len(ranks)))


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """One printable character for each byte: itself where printable, else from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(moved)) for b in range(256)]


def mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(dict(enumerate(byte_characters())))


def serialised_model(path: str) -> bytes:
    """The sentencepiece model of a vocabulary file."""
    model = sentencepiece_model_pb2.ModelProto()
    for rank, token in enumerate(vocabulary(path)):
        model.pieces.add(piece=mapped(token), score=-float(rank), type=model.SentencePiece.NORMAL)
    model.pieces.add(piece="⁇", score=0.0, type=model.SentencePiece.UNKNOWN)
    trainer, normalizer = model.trainer_spec, model.normalizer_spec
    trainer.model_type = trainer.BPE
    trainer.vocab_size = len(model.pieces)
    trainer.unk_id, trainer.bos_id, trainer.eos_id, trainer.pad_id = len(model.pieces) - 1, -1, -1, -1
    trainer.unk_piece = "⁇"
    trainer.hard_vocab_limit = False
    normalizer.name = "identity"
    normalizer.add_dummy_prefix = normalizer.remove_extra_whitespaces = normalizer.escape_whitespaces = False
    return model.SerializeToString()


class Encoder:
    """Ids of texts by one model."""

    def __init__(self, path: str, pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(path))
        self.pattern = regex.compile(pattern)
        self.map = dict(enumerate(byte_characters()))
        self.unknown = self.pieces.unk_id()
        self.chunks = ChunkIds(self._lines, self._one)

    def _parts(self, parts: list[str], groups: np.ndarray) -> list[bytes]:
        # The unknown character keeps pre-tokens apart: no piece contains it.
        text = "\n".join(parts).encode("utf-8", "surrogatepass").decode("latin-1")
        ids = self.pieces.encode(text.translate(self.map | {10: "⁇"}), out_type=int)
        return split_ids(np.array(ids, np.int64), self.unknown, groups)

    def _lines(self, chunks: list[str]) -> list[bytes]:
        parts = self.pattern.findall("\n".join(chunks))
        ends = np.append([i for i, p in enumerate(parts) if p == "\n"], len(parts)).astype(np.int64)
        return self._parts([p for p in parts if p != "\n"], np.diff(ends - np.arange(len(ends)), prepend=0))

    def _one(self, text: str) -> bytes:
        out = []
        for part in self.pattern.findall(text):
            mapped_part = part.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.map)
            out += self.pieces.encode(mapped_part, out_type=int)
        return np.array(out, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return self.chunks.encode([t or "" for t in texts])


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens, ids): ids are packed little-endian unsigned 32-bit integers.

    One pass over the texts, no shuffle. Each worker process makes the model (about a
    megabyte) from the vocabulary file, which every machine has.
    """

    def run(batches):
        encode_texts = encoder(path, pattern).encode
        for batch in batches:
            for part in slices(batch, 1):
                ids = encode_texts(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "n_tokens", "ids"],
                )

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the bytes that the packed ids stand for."""

    def run(batches):
        token = vocabulary(path).__getitem__
        for batch in batches:
            for part in slices(batch, 2, 8_000_000):
                decoded = [b"".join(map(token, np.frombuffer(x or b"", "<u4").tolist())) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(decoded, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"]
                )

    rows = tokens.select("doc_id", "n_tokens", "ids")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")

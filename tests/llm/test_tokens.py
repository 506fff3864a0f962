import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from thoughtloom.llm import byte_bpe, packing
from thoughtloom.llm.catalog import QUERIES

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_is_that_of_the_ranks(spark, documents):
    folder, rows = documents
    got = Counter(map(tuple, QUERIES["op1_byte_bpe"](spark, folder).collect()))
    plain, want = reference(), Counter()
    for doc_id, text in rows:
        ids = plain.encode_ordinary(text or "")
        packed = np.array(ids, "<u4").tobytes()
        want[(doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())] += 1
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x85\xa0 'st1Aé中😀⁇"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_any_text_round_trips(text):
    encoder = byte_bpe.encoder(RANKS, public_tokenizers.PATTERN)
    ids = np.frombuffer(encoder.encode([text])[0], "<u4").tolist()
    assert ids == reference_once().encode_ordinary(text)
    assert b"".join(byte_bpe.vocabulary(RANKS)[i] for i in ids) == text.encode()


_ONCE = []


def reference_once():
    if not _ONCE:
        _ONCE.append(reference())
    return _ONCE[0]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x1c\x85\xa0 'st1Aé中😀"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_ids_of_the_file_are_those_of_the_tokenizer(text):
    got = packing.encoder_of(JSON, public_tokenizers.PATTERN).encode([text])[0]
    if not _TOKENIZER:
        _TOKENIZER.append(Tokenizer.from_file(JSON))
    assert np.frombuffer(got, "<u4").tolist() == _TOKENIZER[0].encode(text, add_special_tokens=False).ids


_TOKENIZER = []


def packed_rightly(got, rows, capacity=2048):
    """Every document is there as it should be; sequences are gapless and no longer than allowed."""
    tokenizer = Tokenizer.from_file(JSON)
    want = Counter()
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        start = 0
        for piece in range(-(-len(ids) // capacity)):
            stop = len(ids) - (-(-len(ids) // capacity) - piece - 1) * capacity
            want[(doc_id, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes()))] += 1
            start = stop
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r.length for r in got) // capacity)


def test_packing(spark, documents):
    folder, rows = documents
    used, least = packed_rightly(QUERIES["op2_best_fit_packing"](spark, folder).collect(), rows)
    assert used <= least + 1


def test_fullest_is_the_best_subset():
    from itertools import combinations

    for lengths, room in (([5, 5, 7, 9, 2], 16), ([3, 3, 3], 10), ([8], 7), ([6, 4, 4, 1], 9), ([2, 2, 2, 2, 2], 9)):
        best = max(sum(c) for n in range(len(lengths) + 1) for c in combinations(lengths, n) if sum(c) <= room)
        chosen = packing.fullest(dict(Counter(lengths)), room)
        assert sum(chosen) == best and not Counter(chosen) - Counter(lengths)


def test_plan_uses_every_piece_once():
    histogram = {2048: 3, 1500: 7, 600: 5, 548: 9, 100: 40, 1: 13}
    plan = packing.plan(histogram, 2048)
    assert sum((Counter({k: n * t for k, n in Counter(c).items()}) for t, c in plan), Counter()) == Counter(histogram)
    assert all(sum(c) <= 2048 for _, c in plan)


def test_nothing(spark, nothing):
    assert QUERIES["op1_byte_bpe"](spark, nothing).count() == 0
    assert QUERIES["op2_best_fit_packing"](spark, nothing).count() == 0

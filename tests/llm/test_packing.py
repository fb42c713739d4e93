"""Harmonic packing against the library's ids and what every packing must keep."""

import json
import struct
import zlib
from collections import defaultdict
from functools import lru_cache

import public_tokenizers
import pytest
from helpers import docs_frame
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmill.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def checked(pieces, want, capacity):
    """Pieces (doc, start, length, crc, total, sequence, offset): every id of `want` once, sequences gapless and padded little; their lengths."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, total, sequence, offset in pieces:
        ids = want[doc]
        assert total == len(ids) and length > 0 and crc == zlib.crc32(struct.pack(f"<{length}I", *ids[start : start + length]))
        by_doc[doc].append((start, length))
        by_sequence[sequence].append((offset, length))
    assert by_doc.keys() == want.keys()
    for doc, spans in by_doc.items():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == len(want[doc])
    sizes = []
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
        sizes.append(at)
    return sizes


def padding(sizes, capacity):
    return sum(capacity - n for n in sizes if n & (n - 1))


@given(st.lists(st.integers(1, 400), min_size=1, max_size=120), st.sampled_from([1, 4, 8, 64]))
@settings(max_examples=150, deadline=None)
def test_bins(lengths, least):
    bins = packing.Bins(64, least)
    want = {i: list(range(1000 * i, 1000 * i + n)) for i, n in enumerate(lengths)}
    sequences = [s for i, ids in want.items() for s in bins.add(i, struct.pack(f"<{len(ids)}I", *ids))]
    full = len(sequences)
    sequences += bins.close()
    assert not bins.open
    pieces, k = [], 0
    for k, s in enumerate(sequences):
        at = 0
        for doc, start, packed, total in s:
            pieces.append((doc, start, len(packed) // 4, zlib.crc32(packed), total, k, at))
            at += len(packed) // 4
    sizes = checked(pieces, want, 64)
    of = [len(s) for s in sequences[:full]]
    for s, n in zip(sequences[:full], of, strict=True):  # bins of one class, filled by count
        assert {64 // (len(p[2]) // 4) for p in s} == {n}
    assert padding(sizes[full:], 64) == 0 and all(64 - n < 64 / (k + 1) for n, k in zip(sizes[:full], of, strict=True))
    if least == 1:
        assert padding(sizes, 64) == 0


def test_packing(spark, words):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(PATH)
    rows = [(i, words(1 + 37 * i % 900, i)) for i in range(150)]
    rows += [(900, None), (901, ""), (902, " \n\t "), (903, "!?"), (None, "a null id"), (904, "İx ΑΣ é é 日本"), (905, "it's WE'LL can't 1½²x º <|endoftext|>y ×÷ €5 \x1c\x85 \xa0z"), (906, words(30000, 1)), (907, "same"), (908, "same")]
    want = {r[0]: [*theirs.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows}
    got = [tuple(r) for r in packing.pack_documents(docs_frame(spark, rows), PATH).collect()]
    sizes = checked(got, want, 4096)
    assert padding(sizes, 4096) <= 0.005 * sum(sizes)
    assert packing.pack_documents(docs_frame(spark, []), PATH).count() == 0
    twice = packing.pack_documents(docs_frame(spark, [(1, "one two")] * 3), PATH, least=1).collect()
    assert sum(r.length for r in twice) == 3 * len(theirs.encode("one two", add_special_tokens=False).ids) + 3
    with pytest.raises(ValueError):
        packing.pack_documents(docs_frame(spark, []), PATH, capacity=1000)


@lru_cache
def encoders():
    from tokenizers import Tokenizer

    with open(PATH, encoding="utf-8") as f:
        return packing.Encoder(json.load(f)), Tokenizer.from_file(PATH)


@given(st.text(alphabet=st.characters(max_codepoint=0x17F), max_size=60))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_the_library(text):
    own, theirs = encoders()
    ids = theirs.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == struct.pack(f"<{len(ids)}I", *ids)

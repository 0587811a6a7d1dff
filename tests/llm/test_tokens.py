"""BPE and packing against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import awkward_rows
from varsight.llm import bpe, packing
from varsight.llm.common import tokenizer_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_round_trip(awkward, clashing, nothing, library):
    want = Counter((d, *digests(library, t)) for d, t, *_ in awkward_rows())
    for df in (awkward, clashing):
        assert Counter(tuple(r) for r in bpe.round_trip_digests(df).collect()) == want
    assert bpe.round_trip_digests(nothing).count() == 0


def test_ids_and_text_columns(awkward, clashing):
    for df in (awkward, clashing):
        out = bpe.decode(bpe.encode(df))
        assert out.where(F.col("decoded") != F.coalesce("text", F.lit(""))).count() == 0
        assert out.count() == df.count()


def test_odd_texts(library):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab's tred'l \n\t.9é中!") for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["aaaaaaaaaaaaaaaa", "''s", " 's", "<|endoftext|", "a<|endoftext|><|endoftext|>'s", " 　x", "1½²x"]
    mine = bpe.PairIndexBPE(tokenizer_path())
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    ids, ranges = mine.encode_texts(data, offsets)
    for i, t in enumerate(texts):
        assert ids[ranges[i] : ranges[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    assert mine.decode(np.array([50256, 162])).startswith(b"<|endoftext|>")


def check_packing(rows, texts, library, capacity=1024):
    want = Counter()
    for d, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        at, first = 0, len(ids) % capacity or capacity
        for p in range(-(-len(ids) // capacity)):
            size = first if p == 0 else capacity
            want[d, p, at, size, zlib.crc32(np.array(ids[at : at + size], dtype="<u4").tobytes())] += 1
            at += size
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_packing(awkward, clashing, nothing, library):
    texts = [(r[0], r[1]) for r in awkward_rows()]
    for df in (awkward, clashing):
        rows = packing.pack(df).collect()
        n = check_packing(rows, texts, library)
        assert n <= -(-sum(r["length"] for r in rows) // 1024) + 1
    assert packing.pack(nothing).count() == 0


@pytest.mark.parametrize("kind", ["mixed", "one length", "long"])
def test_plans_use_every_piece(kind):
    rng = np.random.default_rng(4)
    lengths = {"mixed": rng.integers(1, 1025, 5000), "one length": np.append(np.full(2000, 400), rng.integers(1, 1025, 3000)), "long": rng.integers(520, 1025, 3000)}[kind]
    histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    used, sequences = Counter(), 0
    for parts, repeats in packing.plan_patterns(histogram):
        assert sum(k * n for k, n in parts) <= 1024
        sequences += repeats
        for k, n in parts:
            used[k] += n * repeats
    assert used == Counter(histogram)
    room = np.zeros(1025, dtype=int)  # best fit, longest first
    best = 0
    for n in np.sort(lengths)[::-1]:
        fits = np.flatnonzero(room[n:])
        if len(fits):
            room[n + fits[0]] -= 1
            room[fits[0]] += 1
        else:
            best += 1
            room[1024 - n] += 1
    assert sequences <= 1.005 * best
    assert packing.plan_patterns({}) == []
    with pytest.raises(ValueError):
        packing.plan_patterns({2000: 1})

"""Packing against exhaustive optima; ids against the tokenizers library; whole results on Spark."""

import random
import sys
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from distkpi.llm import dominance_packing as p
from distkpi.llm.queries import PACKING_VOCABULARY

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY.encode_special_tokens = True
with open(PACKING_VOCABULARY, "rb") as f:
    OWN = p._encoding(f.read(), public_tokenizers.PATTERN)


@lru_cache(None)
def optimum(sizes, capacity):
    """Fewest bins of a sorted tuple of sizes, by trying every set with the largest piece."""
    if not sizes:
        return 0
    first, rest = sizes[0], sizes[1:]
    best = len(sizes)

    def sets(i, room, left):
        nonlocal best
        best = min(best, 1 + optimum(left, capacity))
        for k in range(i, len(left)):
            if left[k] <= room and (k == i or left[k] != left[k - 1]):
                sets(k, room - left[k], left[:k] + left[k + 1:])

    sets(0, capacity - first, rest)
    return best


def bins_of(patterns):
    return sum(q.bins for q in patterns)


def contents(patterns):
    out = Counter()
    for q in patterns:
        for s, each in q.items:
            out[s] += each * q.bins
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9), st.integers(20, 30))
def test_reduction_loses_no_optimum(sizes, capacity):
    fixed, rest = p.reduce(Counter(sizes), capacity)
    assert contents(fixed) + rest == Counter(sizes)
    assert all(sum(s * k for s, k in q.items) <= capacity and sum(k for _, k in q.items) <= 3 for q in fixed)
    left = tuple(sorted(rest.elements(), reverse=True))
    assert bins_of(fixed) + optimum(left, capacity) == optimum(tuple(sorted(sizes, reverse=True)), capacity)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 400)), st.integers(50, 70))
def test_plan_is_whole_and_small(histogram, capacity):
    patterns = p.plan(histogram, capacity)
    assert contents(patterns) == Counter(histogram)
    assert all(sum(s * k for s, k in q.items) <= capacity for q in patterns)
    assert len(patterns) < 3 * capacity
    places = p.Places(patterns)
    used = Counter()
    for s, n in histogram.items():
        sequence, offset = places.of(np.full(n, s), np.arange(n))
        used.update(zip(sequence.tolist(), offset.tolist(), [s] * n))
    by = {}
    for (sequence, offset, s), n in used.items():
        assert n == 1
        by.setdefault(sequence, []).append((offset, s))
    assert sorted(by) == list(range(bins_of(patterns)))
    for parts in by.values():
        end = 0
        for offset, s in sorted(parts):
            assert offset == end
            end += s


def test_best_fit_in_runs_is_best_fit():
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 120))]
        rooms = []
        for s in sorted(sizes, reverse=True):
            fits = [i for i, r in enumerate(rooms) if r >= s]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= s
            else:
                rooms.append(40 - s)
        assert bins_of(p.best_fit(Counter(sizes), 40)) == len(rooms)


def test_near_the_bound_at_scale():
    rng = np.random.default_rng(1)
    histogram = Counter(np.minimum(2048, rng.lognormal(6, 1, 200_000).astype(int) + 1).tolist())
    need = -(-sum(s * c for s, c in histogram.items()) // 2048)
    assert bins_of(p.plan(histogram)) <= need * 1.002 + 1


def test_ids_of_every_code_point_as_the_library():
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(f"a{chr(c)}b {chr(c)}1{chr(c)} {chr(c)}{chr(c)}'{chr(c)}!\n" for c in points[i:i + 64])
             for i in range(0, len(points), 64)]
    for at in range(0, len(texts), 1000):
        some = texts[at:at + 1000]
        assert [e.ids for e in LIBRARY.encode_batch_fast(some, add_special_tokens=False)] == [
            OWN.encode_ordinary(t) for t in some]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abetnio'  \n\t1é世sdlr.!-ğß🙂<|endoftext|>"), max_size=60))
def test_ids_as_the_library(text):
    assert OWN.encode_ordinary(text) == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [7, 2048])
def test_on_spark(make_docs, capacity):
    rows = [(1, None), (2, ""), (2, ""), (3, "a b c " * 3000), (None, "x y z"), (4, "<|endoftext|>"), (5, "é世" * 900),
            (6, "one two"), (6, "one two"), *((i, "word " * (i % 17)) for i in range(10, 120))]
    packed = p.pack(make_docs(rows), PACKING_VOCABULARY, public_tokenizers.PATTERN, capacity)
    got = packed.collect()
    docs = {}
    for r in got:
        assert r["length"] <= capacity and len(r["ids"]) == 4 * r["length"]
        docs.setdefault(r["doc_id"], []).append(r)
    want = Counter((d, tuple(LIBRARY.encode(t or "", add_special_tokens=False).ids) + (0,)) for d, t in rows)
    seen = Counter()
    for d, own in docs.items():
        own.sort(key=lambda r: r["piece"])
        copies = Counter(r["piece"] for r in own)
        assert len(set(copies.values())) == 1                     # repeated rows: as many of every piece
        ids, length = [], 0
        for r in {r["piece"]: r for r in own}.values():
            assert r["start"] == length
            assert r["piece"] == 0 or r["length"] == capacity
            length += r["length"]
            ids += np.frombuffer(r["ids"], "<u4").tolist()
        assert len({r["piece"] for r in own}) == max(1, -(-length // capacity))
        seen[d, tuple(ids)] += copies[0]
    assert seen == want
    joined = {r["sequence_id"]: r for r in p.sequences(packed).collect()}
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by) == list(range(len(by)))
    for sequence, parts in by.items():
        parts.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in parts] == np.cumsum([0] + [r["length"] for r in parts])[:-1].tolist()
        assert joined[sequence]["ids"] == b"".join(r["ids"] for r in parts)
        assert joined[sequence]["length"] <= capacity
    assert p.pack(make_docs([]), PACKING_VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_query(spark, sf):
    from distkpi.llm.queries import op11_dominance_packing
    got = op11_dominance_packing(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {d: LIBRARY.encode(t or "", add_special_tokens=False).ids + [0] for d, t in texts.items()}
    assert sum(r["length"] for r in got) == sum(map(len, ids.values()))
    for r in got:
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and len(part) == r["length"]

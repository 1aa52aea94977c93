"""Encoding against the tiktoken library; appends and edits against a fresh encoding."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from distkpi.llm import bpe_prefix as b
from distkpi.llm import length_histogram as h

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
with open(PATH, "rb") as f:
    V = b.Vocabulary(f.read(), public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=V.rank, special_tokens={})
TABLE = b._Pieces(V)

texts = st.text(st.sampled_from("abetnio'  \n\t1é世sdlr.!-ğß🙂  "), max_size=60)


def ids(text):
    return np.frombuffer(b"".join(b.encode_text(TABLE, text)), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(texts)
def test_as_the_library(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert V.decode(ids(text)) == text.encode()


@settings(max_examples=300, deadline=None)
@given(texts, texts, st.data())
def test_appends_and_edits(text, new, data):
    e = b.EditableText(V, text)
    start = data.draw(st.integers(0, len(text)))
    stop = data.draw(st.integers(start, len(text)))
    e.edit(start, stop, new)
    e.append("'ll")
    assert e.ids() == LIBRARY.encode_ordinary(text[:start] + new + text[stop:] + "'ll")


def test_prefix_entries_are_reused():
    rng = random.Random(2)
    data = bytes(rng.choice(b"abetnioshr") for _ in range(4000))
    p = b.PrefixEncoder(V, data[:1000])
    p.append(data[1000:])
    assert p.last == b.PrefixEncoder(V, data).last
    assert p.edit(2000, 2003, b"QQ") < 200
    assert p.last == b.PrefixEncoder(V, data[:2000] + b"QQ" + data[2003:]).last
    assert p.ids() == LIBRARY.encode_ordinary(p.data.decode())


@pytest.mark.parametrize("block", [50, b.BLOCK])
def test_on_spark(monkeypatch, make_docs, block):
    monkeypatch.setattr(b, "BLOCK", block)
    rows = [(1, None), (2, ""), (3, "a" * 30000), (4, " \n" * 5000), (None, "Hello, wörld 123!!"), (5, "x y"), (5, "x y"),
            (6, "the quick 日本語 brown " * 4000)]
    got = b.encode(make_docs(rows), PATH, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(got) == len(rows)
    want = sorted(((d, len(i := LIBRARY.encode_ordinary(t or "")), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256((t or "").encode()).hexdigest(), i) for d, t in rows), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert b.encode(make_docs([]), PATH, public_tokenizers.PATTERN).count() == 0


def test_histogram_against_the_library(spark, sf, make_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(
        spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "the end " * 20000)], "doc_id bigint, text string"))
    lengths = sorted(len(LIBRARY.encode_ordinary(r["text"] or "")) for r in docs.collect())
    table = h.suffix_table(h.lengths(docs, PATH, public_tokenizers.PATTERN))
    got = {r["n_tokens"]: r for r in table.collect()}
    assert sorted(got) == sorted(set(lengths))
    for n, r in got.items():
        assert r["documents"] == lengths.count(n)
        assert r["documents_at_least"] == sum(x >= n for x in lengths)
        assert r["tokens_at_least"] == sum(x for x in lengths if x >= n)
        assert r["truncated_tokens"] == sum(min(x, n) for x in lengths)
        assert r["share_at_most"] == sum(x <= n for x in lengths) / len(lengths)
        assert (r["all_documents"], r["all_tokens"]) == (len(lengths), sum(lengths))
    limits = [0, 1, 17, 512, 4096, 10**6]
    assert [tuple(r) for r in h.at_limits(table, limits).collect()] == [
        (c, sum(min(x, c) for x in lengths), sum(x > c for x in lengths)) for c in limits]
    assert [r["n_tokens"] for r in h.quantiles(table, [0.0, 0.5, 0.9, 1.0]).collect()] == [
        min(n for n in set(lengths) if sum(x <= n for x in lengths) >= q * len(lengths)) for q in (0.0, 0.5, 0.9, 1.0)]
    assert h.suffix_table(h.lengths(make_docs([]), PATH, public_tokenizers.PATTERN)).count() == 0


def test_long_matches_are_not_kept():
    table = b._Pieces(V)
    texts = [chr(97 + i % 26) * 30 + "".join(chr(97 + (i * 7 + j * j) % 26) for j in range(3000)) for i in range(40)]
    for text in texts:
        packed = b"".join(b.encode_text(table, text))
        assert V.decode(np.frombuffer(packed, "<u4").tolist()) == text.encode()
    assert sum(len(k) + len(v) for t in (table, table.old, table.long) for k, v in t.items()) < 20_000
    assert all(len(k.encode()) <= b.KEPT for k in table)

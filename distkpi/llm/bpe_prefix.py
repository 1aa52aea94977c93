"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string exactly one token can end a valid encoding
of it. :class:`PrefixEncoder` stores that token per prefix: the token that
ends prefix ``i`` is the one whose predecessor (the stored token of the prefix
before it) does not merge with it, that is, whose pair encodes to itself. The
encoding is read off backwards. Hence

* appending bytes only adds entries: the encoding after an append is exact
  without looking at the earlier bytes again;
* after an edit, entries are recomputed from the edit on, and only until as
  many entries in a row as the longest token has bytes are what they were.

:class:`EditableText` does the same for whole texts, which a pattern first
splits into matches that are encoded separately.

On Spark, texts are encoded in Arrow batches; the matches of a batch go
through a bounded table of encoded matches. The rank file is read once by the
driver and shipped (its size is that of the vocabulary, under 1 MB here).

Null texts are empty. Empty texts have no tokens. Texts over ``BLOCK``
characters are processed in blocks of matches. Rows come out as they went in,
repeated ones too.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

BLOCK = 1_000_000
CACHE = 200_000      # encoded matches kept per generation
KEPT = 64            # bytes of a match that is kept; longer ones are known only within their block
PAIRS = 500_000      # pairs of tokens kept


class Vocabulary:
    """Tokens and ranks of a rank file (base64 token and rank per line)."""

    def __init__(self, ranks: bytes, pattern: str):
        self.rank: dict[bytes, int] = {}
        for line in ranks.splitlines():
            if line:
                token, number = line.split()
                self.rank[base64.b64decode(token)] = int(number)
        self.tokens = [b""] * (max(self.rank.values()) + 1)
        for token, number in self.rank.items():
            self.tokens[number] = token
        self.longest = max(map(len, self.rank))
        self.split = regex.compile(pattern)
        #: Tokens whose bytes encode to the token itself; no other occurs in an encoding.
        self.standing = {t: n for t, n in self.rank.items() if self.merged(t) == [t]}
        self._pairs: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """Plain merging, lowest rank first; used only on a token or a pair of tokens."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.rank.get(a + b) for a, b in zip(parts, parts[1:])]
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                break
            i = ranks.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` and ``b`` encode to these two tokens."""
        key = a << 32 | b
        ok = self._pairs.get(key)
        if ok is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            x, y = self.tokens[a], self.tokens[b]
            ok = self._pairs[key] = self.merged(x + y) == [x, y]
        return ok

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The matches of the pattern, in lists of bounded length."""
        if len(text) <= BLOCK:
            yield self.split.findall(text)
            return
        matches = (m.group() for m in self.split.finditer(text))
        while block := list(islice(matches, BLOCK // 8)):
            yield block

    def encode_piece(self, data: bytes) -> list[int]:
        number = self.rank.get(data)
        if number is not None:
            return [number]
        return PrefixEncoder(self, data).ids()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixEncoder:
    """The last token of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v = vocabulary
        self.data = b""
        self.last: list[int] = []
        self.append(data)

    def _last_token(self, end: int) -> int:
        data, last, known, pair = self.data, self.last, self.v.standing.get, self.v._pairs.get
        # Shortest first: exactly one candidate is valid, and most tokens are short.
        for start in range(end - 1, end - self.v.longest - 1 if end > self.v.longest else -1, -1):
            token = known(data[start:end])
            if token is not None:
                if not start:
                    return token
                before = last[start - 1]
                ok = pair(before << 32 | token)
                if ok or ok is None and self.v.follows(before, token):
                    return token
        raise ValueError("the vocabulary does not hold every byte")

    def append(self, data: bytes) -> None:
        self.data += data
        for end in range(len(self.last) + 1, len(self.data) + 1):
            self.last.append(self._last_token(end))

    def become(self, data: bytes) -> None:
        """Cut back to the prefix shared with ``data`` and append its rest."""
        n = 0
        for a, b in zip(self.data, data):
            if a != b:
                break
            n += 1
        self.data = data[:n]
        del self.last[n:]
        self.append(data[n:])

    def edit(self, start: int, stop: int, data: bytes) -> int:
        """Replace bytes ``start:stop``; returns the number of entries computed."""
        old, tail_from = self.last, stop
        self.data = self.data[:start] + data + self.data[stop:]
        self.last = old[:start]
        shift = start + len(data) - stop
        same = 0
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._last_token(end))
            # An entry behind the edit depends on the bytes and entries of one token's length.
            before = end - shift - 1
            same = same + 1 if before >= tail_from and old[before] == self.last[-1] else 0
            if same >= self.v.longest:
                self.last += old[before + 1:]
                return end - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= len(self.v.tokens[token])
        return out[::-1]


class EditableText:
    """A text's matches and their tokens under edits and appends."""

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.v = vocabulary
        self.text = ""
        self.parts: list[tuple[int, list[int]]] = []    # length in characters, ids
        self.edit(0, 0, text)

    def append(self, text: str) -> None:
        self.edit(len(self.text), len(self.text), text)

    def edit(self, start: int, stop: int, text: str) -> int:
        """Replace characters ``start:stop``; returns the number of matches encoded."""
        bounds = [0]
        for n, _ in self.parts:
            bounds.append(bounds[-1] + n)
        # A match depends on at most two characters behind it, so two matches back are safe.
        first = max(0, next((i for i, b in enumerate(bounds) if b >= start), 0) - 3)
        self.text = self.text[:start] + text + self.text[stop:]
        shift = start + len(text) - stop
        later = {b + shift: i for i, b in enumerate(bounds) if b >= stop}
        new, done = [], len(self.parts)
        at = bounds[first]
        for m in self.v.split.finditer(self.text, at):
            new.append((len(m.group()), self.v.encode_piece(m.group().encode())))
            if m.end() in later and m.end() >= start + len(text):
                done = later[m.end()]
                break
        self.parts[first:done] = new
        return len(new)

    def ids(self) -> list[int]:
        return [i for _, ids in self.parts for i in ids]


class _Pieces(dict):
    """Encoded matches as packed ids; filled on demand, in two generations; long ones for a block only."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v = vocabulary
        self.old: dict[str, bytes] = {}
        self.long: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece) or self.long.get(piece)
        if out is None:
            data = piece.encode()
            ids = self.v.encode_piece(data)
            out = struct.pack(f"<{len(ids)}I", *ids)
            if len(data) > KEPT:
                return out
        elif piece in self.long:
            return out
        self[piece] = out
        return out

    def trim(self) -> None:
        self.long.clear()
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()

    def learn(self, blocks: list[list[str]]) -> None:
        """Encode the unseen matches in byte order: neighbours share the entries of their common prefix."""
        old = self.old
        unseen = [p for p in set().union(*blocks).difference(self) if p not in old]
        encoder, rank = PrefixEncoder(self.v), self.v.rank
        for data, piece in sorted([(p.encode(), p) for p in unseen]):
            number = rank.get(data)
            if number is None:
                encoder.become(data)
                ids = encoder.ids()
                (self if len(data) <= KEPT else self.long)[piece] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                self[piece] = struct.pack("<I", number)


_workers: dict[str, _Pieces] = {}


def _encoder(ranks: bytes, pattern: str) -> _Pieces:
    """The table of this Python worker; kept between tasks."""
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _workers:
        _workers.clear()
        _workers[key] = _Pieces(Vocabulary(ranks, pattern))
    return _workers[key]


def encode_text(table: _Pieces, text: str) -> Iterator[bytes]:
    """Packed ids of a text, block by block."""
    for block in table.v.pieces(text):
        table.trim()
        table.learn([block])
        yield b"".join(map(table.__getitem__, block))


def encode_texts(table: _Pieces, texts: Iterable[str]) -> Iterator[Iterator[bytes]]:
    """For each text its packed ids, block by block; short texts are encoded together."""
    def together(waiting: list[str]) -> Iterator[Iterator[bytes]]:
        blocks = [table.v.split.findall(t) for t in waiting]
        table.trim()
        table.learn(blocks)
        for block in blocks:
            yield iter([b"".join(map(table.__getitem__, block))])

    waiting, size = [], 0
    for text in texts:
        if waiting and size + len(text) > BLOCK:
            yield from together(waiting)
            waiting, size = [], 0
        if len(text) > BLOCK:
            yield encode_text(table, text)
        else:
            waiting.append(text)
            size += len(text)
    yield from together(waiting)


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, text: str = "text",
           with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids."""
    with open(vocabulary_path, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}["doc_id"]
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>"

    def run(batches):
        table = _encoder(shipped.value, pattern)
        for batch in batches:
            counts, digests, decoded, all_ids = [], [], [], []
            for blocks in encode_texts(table, (x.as_py() or "" for x in batch.column(1))):
                n, hashed, back, own = 0, hashlib.sha256(), hashlib.sha256(), []
                for packed in blocks:
                    ids = np.frombuffer(packed, "<u4")
                    n += len(ids)
                    hashed.update(packed)
                    back.update(table.v.decode(ids.tolist()))
                    if with_ids:
                        own.append(ids.astype(np.int32))
                counts.append(n)
                digests.append(hashed.hexdigest())
                decoded.append(back.hexdigest())
                if with_ids:
                    all_ids.append(np.concatenate(own) if own else np.zeros(0, np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()),
                       pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", text).mapInArrow(run, schema)

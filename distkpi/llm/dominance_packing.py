"""Best-fit packing after Martello-Toth dominance reduction.

Documents become sequences of at most ``CAPACITY`` token ids. A document is
its ids and one end id; only a document longer than a sequence is cut, into
full pieces, of which the first may be shorter.

1. One pass encodes every text. It writes the pieces with their ids and
   numbers the pieces of each length within a task.
2. What the packing needs is the number of pieces of each length: at most
   ``CAPACITY`` rows, whatever the number of documents. The driver plans on
   this histogram only.
3. *Dominance reduction* permanently fixes small sets: a piece ``j`` with a
   set ``F`` of at most two others closes a sequence if every other set that
   could share a sequence with ``j`` can be exchanged for ``F`` without needing
   more sequences, because its members fit, one set of them per member of
   ``F``, into the places of ``F``. Fixed lengths leave the histogram, so the
   instance shrinks, and no optimum is lost.
4. The rest is packed best fit, longest first, in runs: sequences with equal
   contents are one pattern with a multiplicity. A length adds at most three
   patterns, so there are fewer than ``3 * CAPACITY`` of them, each of at most
   ``sqrt(2 * CAPACITY)`` different lengths; that bounds the plan that is sent
   to the tasks.
5. Each piece takes the place of its rank among the pieces of its length:
   number within its task plus the pieces of that length in earlier tasks.

Ids come from the ``tiktoken`` library by the ranks given. With the ranks of
``byte_bpe_50k.tiktoken`` they equal those of the ``tokenizers`` library with
``byte_bpe_50k.json`` (tested on every code point), at a quarter of the time.
The strings of special tokens are ordinary text, so no document can hold one.

Null and empty texts are one piece of the end id. Null ids are carried along.
Repeated rows are documents of their own. An empty table gives an empty result.
Extra columns are ignored. Very long texts are encoded whole, one at a time,
and give as many pieces as needed; sequences and pieces never grow. Ties among
pieces of one length are free: their places are alike.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from distkpi.llm.common import materialize

CAPACITY = 2048
END = 0
OUT_BYTES = 8 << 20      # ids of a batch that leaves a task


class Pattern(NamedTuple):
    """``bins`` sequences with the same contents: (length, pieces of it) pairs."""

    bins: int
    items: tuple[tuple[int, int], ...]


# ---- the plan, on the histogram -------------------------------------------------

def _largest_pair(sizes: list[int], n: Counter, room: int) -> tuple[int, int] | None:
    """Two pieces (a >= b) with the largest sum within ``room``; ``sizes`` ascending."""
    best, lo, hi = None, 0, len(sizes) - 1
    while lo <= hi:
        b, a = sizes[lo], sizes[hi]
        if a + b > room or (lo == hi and n[a] < 2):
            hi -= 1
            continue
        if best is None or a + b > sum(best):
            best = (a, b)
        lo += 1
    return best


def dominating(w: int, n: Counter, sizes: list[int], capacity: int) -> tuple[int, ...] | None:
    """A set with a piece of length ``w`` that dominates all others with it, if a small one does.

    ``n`` counts the other pieces, ``sizes`` are their lengths, ascending.
    """
    room = capacity - w
    fits = sizes[:bisect_left(sizes, room + 1)]
    if not fits:
        return (w,)                                  # nothing fits beside it
    best = fits[-1]
    if best == room:
        return w, best                               # any other set fits into the place of that one piece
    least = []
    for s in fits:                                   # the three shortest
        least += [s] * min(n[s], 3 - len(least))
        if len(least) == 3:
            break
    if len(least) < 2 or sum(least[:2]) > room:
        return w, best                               # at most one fits: the longest
    if len(least) == 3 and sum(least) <= room:
        return None
    a, b = _largest_pair(fits, n, room)              # at most two fit
    if best >= a + b:
        return w, best
    if a != best:
        return None
    # (a, b) dominates a pair unless both of its pieces are longer than b.
    longer = []
    for s in sizes[bisect_left(sizes, b + 1):]:
        longer += [s] * min(n[s], 2 - len(longer))
        if len(longer) == 2:
            return (w, a, b) if sum(longer) > room else None
    return w, a, b


def reduce(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Pattern], Counter]:
    """Fixed sequences, and the histogram of what is left."""
    n = Counter({s: c for s, c in histogram.items() if c})
    fixed: list[Pattern] = []
    changed = True
    while changed:
        changed = False
        for w in sorted(n, reverse=True):
            while n[w]:
                n[w] -= 1
                chosen = dominating(w, n, sorted(s for s in n if n[s]), capacity)
                n[w] += 1
                if chosen is None:
                    break
                # The same set dominates as long as its lengths last: removals only leave fewer alternatives.
                need = Counter(chosen)
                times = min(n[s] // k for s, k in need.items())
                n.subtract({s: k * times for s, k in need.items()})
                fixed.append(Pattern(times, tuple(sorted(need.items(), reverse=True))))
                changed = True
        n = +n
    return fixed, n


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Best fit, longest first; equal sequences together."""
    open_: dict[int, list[Pattern]] = {}             # by room left
    rooms: list[int] = []                            # ascending

    def put(bins: int, items: tuple, room: int) -> None:
        if not bins:
            return
        if room not in open_:
            open_[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        open_[room].append(Pattern(bins, items))

    for s in sorted((s for s, c in histogram.items() if c), reverse=True):
        left = histogram[s]
        while left:
            i = bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                bins, items = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
            else:
                room, bins, items = capacity, -(-left // (capacity // s)), ()
            each = room // s                         # the tightest sequence stays the tightest until it is full
            full = min(bins, left // each)
            put(full, (*items, (s, each)), room - each * s)
            left, bins = left - full * each, bins - full
            if bins and left:
                put(1, (*items, (s, left)), room - left * s)
                left, bins = 0, bins - 1
            put(bins, items, room)
    return [p for room in rooms for p in open_[room]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """All sequences, as patterns."""
    fixed, rest = reduce(histogram, capacity)
    merged: Counter = Counter()
    for p in fixed + best_fit(rest, capacity):
        merged[p.items] += p.bins
    return [Pattern(bins, items) for items, bins in merged.items()]


class Places:
    """The places of every length, in order: rank within the length -> sequence and offset."""

    def __init__(self, patterns: list[Pattern]):
        taken: Counter = Counter()
        rows, first = [], 0
        for bins, items in patterns:
            at = 0
            for s, each in items:
                rows.append((s, taken[s], each, first, at))
                taken[s] += bins * each
                at += s * each
            first += bins
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.key = self._key(table[:, 0], table[:, 1])
        self.first_rank, self.each, self.sequence, self.at = table[:, 1:].T

    @staticmethod
    def _key(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return length.astype(np.uint64) << np.uint64(44) | rank.astype(np.uint64)

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, self._key(length, rank), "right") - 1
        nth = rank - self.first_rank[i]
        return self.sequence[i] + nth // self.each[i], self.at[i] + nth % self.each[i] * length


# ---- the documents --------------------------------------------------------------

_workers: dict[str, tiktoken.Encoding] = {}


def _encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """The encoder of this Python worker; kept between tasks."""
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _workers:
        _workers.clear()
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _workers[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _workers[key]


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids."""
    first = n % capacity or capacity
    return [(0, min(n, first))] + [(s, capacity) for s in range(first, n, capacity)]


def tokenised(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = CAPACITY,
              end: int = END, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32 bit), part, nth.

    ``nth`` numbers the pieces of one length within a task, ``part``; a written
    table of these rows is what :func:`place` takes.
    """
    with open(ranks_path, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())     # one vocabulary file
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids", "part", "nth"]

    def run(batches):
        encoding, part, seen = _encoding(shipped.value, pattern), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            of, rows, size = [], [], 0
            for i, value in enumerate(batch.column(1)):
                ids = np.append(encoding.encode_to_numpy(value.as_py() or "", disallowed_special=()), end)
                packed = memoryview(ids.astype("<u4").tobytes())
                for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
                    of.append(i)
                    rows.append((piece, start, length, bytes(packed[4 * start:4 * (start + length)]), seen[length]))
                    seen[length] += 1
                    size += 4 * length
                    if size >= OUT_BYTES:
                        yield batch_of(batch, of, rows, part)
                        of, rows, size = [], [], 0
            if rows:
                yield batch_of(batch, of, rows, part)

    def batch_of(batch, of, rows, part):
        piece, start, length, ids, nth = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(of, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
             pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array([part] * len(rows), pa.int32()),
             pa.array(nth, pa.int64())], names=names)

    return docs.select("doc_id", F.col(f"`{text}`")).mapInArrow(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary, part int, nth bigint")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, without ``part`` and ``nth``.

    ``pieces`` is a written table (it is read twice and must not change
    between): any columns, with ``length``, ``part`` and ``nth`` as numbered by
    :func:`tokenised`.
    """
    # At most CAPACITY lengths a task: no length, however frequent, is a large group.
    counts = materialize(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("_n")), "packing-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    places = pieces.sparkSession.sparkContext.broadcast(Places(plan(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = [f for f in pieces.schema.fields if f.name not in ("part", "nth")]
    ranked = pieces.join(starts, ["part", "length"]).select(
        *[f"`{f.name}`" for f in out], (F.col("_before") + F.col("nth")).alias("_rank"))

    def run(batches):
        for batch in batches:
            *columns, rank = batch.columns
            length = batch.column("length").to_numpy(zero_copy_only=False)
            sequence, offset = places.value.of(length, rank.to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                                             names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out)
    return ranked.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = CAPACITY,
         end: int = END, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset: one row per piece."""
    return place(materialize(tokenised(docs, ranks_path, pattern, capacity, end, text), "packing-pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids: the sequences put together (each at most a capacity long)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))

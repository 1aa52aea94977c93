"""N-gram Jaccard join: size-aware, heavy and light sets apart.

Documents whose sets of distinct shingles are similar enough are linked; the
result is the component of every document. :class:`Near` gives the words of a
shingle and the least Jaccard similarity ``p / q``: ``OP6`` (3 words, 0.9) is
the rule of the query, ``GENERAL`` (5 words, 0.8) that of pipeline stages.

1. One pass over the texts gives each document's set size, a 128-bit digest of
   the set and a parity sketch. Documents with equal sets are one class.
2. *Light* sets (up to a boundary) enumerate fixed-size subsets: two sets of
   sizes n and m link exactly if they share ``ceil(p (n + m) / (p + q))``
   elements, so for every possible partner size a set lists its subsets of that size. Two
   sets with a common subset are a link.
3. *Heavy* sets scan inverted lists. A list per shingle would be quadratic on
   shared passages, so lists are keyed by blocks of shingles: two linked sets
   differ in at most ``k`` elements, hence of ``k + 1 + spare`` hash blocks at
   least ``1 + spare`` are equal in both. ``k`` depends on the size, so blocks
   are made per size group, and a set is listed in its own and the next
   smaller group. Empty blocks are listed only for a set with more than
   ``spare`` of them (else a non-empty equal block exists); more blocks are
   spare where a set leaves more of them empty, so that this stays rare.
4. The boundary between both minimises the number of list rows, heavy rows
   weighted by the verification they cause, over the sizes that occur.
5. A second pass over the texts makes the list rows, a key and a tag of the
   set each, and sends them straight into the exchange that groups the lists:
   they are written once. A task lists equal sets once. Most lists hold one
   tag and end there; the tags of the others become classes again.
   Two linked sets share ``spare`` blocks more than they need. So each set leaves
   its longest lists, as many as it has blocks to spare: those of a line that
   many texts hold, whose members would be compared all with all.
6. Lists are scanned around a pivot: each member is compared with the smallest
   member, not all with all. Then components are computed; in a list that still
   holds several components, only members of different components are compared,
   after a size test and a sketch test that never reject a link, and long lists
   are dealt to cells, so that no task compares more than two cells' members.
   The sketch tells large sets apart badly, so the pairs it leaves are tested by
   marks, a sketch that grows with the set, before any text is joined to them.
   So every link is found or already implied, and a list of one component costs
   its length.

Every link is verified on the whole sets (64-bit shingle hashes), made again
from the two texts.

Null, empty and blank texts have no shingles and link with nothing. Rows that
share an id count as one document with several texts. A null id takes part
with its text; a component of null ids only has a null id. Equal similarities
need no order: every link counts. Texts of any length are shingled whole. Extra
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from distkpi.llm.common import discard, materialize
from distkpi.llm.components import components

SPARE = 2
INLINE = 64         # sizes up to this may become light; their sets are kept
HEAVY_WEIGHT = 4
CACHE = 300_000
CACHED_WORD = 64    # bytes of a word that is worth keeping
CELL = 1024         # members of a list that are compared with each other in one task
KEY_BITS = 48       # of list keys and tags: equal ones only make candidates
TASK_SETS = 200_000 # sets a task remembers, so that it lists copies once

_MASK = (1 << 64) - 1


class Near(NamedTuple):
    """Shingles of ``words`` words; sets link from a similarity of ``p / q`` below 1."""

    words: int
    p: int
    q: int

    @property
    def least(self) -> int:
        """The smallest size that can link with a different set."""
        return -(-self.p // (self.q - self.p))


OP6 = Near(3, 9, 10)
GENERAL = Near(5, 4, 5)
WORDS = OP6.words
LEAST = OP6.least


def least_overlap(n: int, m: int, near: Near = OP6) -> int:
    """Shared elements that make sets of sizes ``n`` and ``m`` link."""
    return -(-near.p * (n + m) // (near.p + near.q))


def partners(n: int, near: Near = OP6) -> range:
    """Sizes that can link with size ``n``."""
    return range(-(-near.p * n // near.q), near.q * n // near.p + 1)


@lru_cache(None)
def groups(near: Near = OP6, upto: int = 1 << 31) -> np.ndarray:
    """First sizes of the groups; a partner is in the same or an adjacent one."""
    out = [1]
    while out[-1] <= upto:
        out.append(near.q * out[-1] // near.p + 1)
    return np.array(out)


@lru_cache(None)
def spare(group: int, near: Near = OP6) -> int:
    """Spare blocks of a size group: about twice as many as its smallest set leaves empty.

    Limited for small sets, where further blocks would mostly be empty themselves.
    """
    first, differ = int(groups(near)[group]), _most_different(group, near)
    n = SPARE
    while n < SPARE + differ // 5:
        b = differ + 1 + n
        if n >= SPARE + int(2 * b * (1 - 1 / b) ** first):
            break
        n += 1
    return n


def _most_different(group: int, near: Near) -> int:
    return int(groups(near)[group + 1] - 1) * (near.q - near.p) // near.p


def blocks(group: int, near: Near = OP6) -> int:
    """Number of blocks of a size group: the largest difference, one more, and the spare ones."""
    return _most_different(group, near) + 1 + spare(group, near)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= CACHED_WORD:
            self[word] = h
        return h


_words = _WordHashes()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    parts = (text or "").encode().lower().split()      # bytes: only A-Z and ASCII white space
    if len(_words) >= CACHE:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, parts), np.uint64, len(parts))
    if not len(h):
        return h
    n = min(words, len(h))
    x = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - n + 1 + i])
    return np.unique(x)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the elements per 512 cells: two sets differ in at least as many elements as bits."""
    odd = np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def marks(s: np.ndarray) -> bytes:
    """Parity of the elements per cell, as a sketch's, with two to four cells an element."""
    cells = max(64, 1 << int(2 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def unlike(x: bytes, y: bytes) -> int:
    """Elements that two sets differ in at least, from their marks; the longer ones are folded."""
    a, b = (np.frombuffer(v, np.uint8) for v in ((x, y) if len(x) >= len(y) else (y, x)))
    while len(a) > len(b):
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def _in_blocks(s: np.ndarray, near: Near) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Group, number of blocks, salted elements and their blocks, for a set's size group and the one below."""
    first_sizes = groups(near)
    own = int(np.searchsorted(first_sizes, len(s), "right")) - 1
    for group in (own - 1, own):
        if first_sizes[group + 1] > near.least:
            n = blocks(group, near)
            salted = _mix(s + np.uint64((group + 1) * 0x9E3779B97F4A7C15 & _MASK))
            yield group, n, salted, (salted % np.uint64(n)).astype(np.int64)


def heavy_keys(s: np.ndarray, near: Near = OP6) -> np.ndarray:
    """List keys of a set: one per block, for its size group and the one below; the lowest bit is the group's."""
    out = []
    for group, n, salted, block in _in_blocks(s, near):
        order = np.argsort(block, kind="stable")
        own_blocks, first = np.unique(block[order], return_index=True)
        sums = np.add.reduceat(_mix(salted)[order], first)
        if n - len(own_blocks) > spare(group, near):
            rest = np.setdiff1d(np.arange(n), own_blocks)[spare(group, near):]
            own_blocks = np.concatenate([own_blocks, rest])
            sums = np.concatenate([sums, np.zeros(len(rest), np.uint64)])
        keys = _mix(sums + own_blocks.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(group))
        out.append(keys & np.uint64(_MASK - 1) | np.uint64(group & 1))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def to_spare(s: np.ndarray, near: Near = OP6) -> list[int]:
    """How many of its lists a set may leave, in groups of even and of odd number: spare blocks that are not empty."""
    out = [0, 0]
    for group, n, _, block in _in_blocks(s, near):
        out[group & 1] = max(0, spare(group, near) - n + np.count_nonzero(np.bincount(block)))
    return out


def light_keys(s: list[int], boundary: int, near: Near = OP6) -> list[int]:
    """Keys of the fixed-size subsets of a set, for every partner size up to the boundary."""
    n, out = len(s), []
    for m in partners(n, near):
        size = least_overlap(n, m, near)
        if near.least <= m <= boundary and size <= min(n, m):
            tag = f"{min(n, m)}:{max(n, m)}:".encode()
            for some in combinations(s, size):
                h = xxhash.xxh64_intdigest(tag + np.array(some, np.int64).tobytes())
                out.append(h - (1 << 64) if h >> 63 else h)
    return out


def light_cost(n: int, near: Near = OP6) -> int:
    return sum(comb(n, c) for m in partners(n, near) if (c := least_overlap(n, m, near)) <= min(n, m))


def heavy_cost(n: int, near: Near = OP6) -> int:
    own = int(np.searchsorted(groups(near), n, "right")) - 1
    return HEAVY_WEIGHT * (blocks(own, near) + blocks(own - 1, near))


def choose_boundary(histogram: dict[int, int], near: Near = OP6) -> int:
    """Largest light size; ``histogram``: number of sets by size, sizes up to ``INLINE``."""
    def total(x: int) -> int:
        from_heavy = partners(x + 1, near).start
        return sum(c * ((light_cost(n, near) if n <= x else 0) + (heavy_cost(n, near) if n >= from_heavy else 0))
                   for n, c in histogram.items() if n >= near.least)
    return min(range(near.least - 1, INLINE + 1), key=lambda x: (total(x), x))


def digest_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def describe(docs: DataFrame, text: str, near: Near = OP6) -> DataFrame:
    """doc_id, n, digest, sketch and lists to spare of the set."""
    def run(batches):
        for batch in batches:
            sets = [shingles(value.as_py(), near.words) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([digest_of(s) for s in sets], pa.binary()),
                 pa.array([sketch(s) if len(s) >= near.least else None for s in sets], pa.list_(pa.int64())),
                 pa.array([to_spare(s, near) if len(s) >= near.least else None for s in sets], pa.list_(pa.int32()))],
                names=["doc_id", "n", "digest", "sketch", "to_spare"])

    return docs.select(F.col("doc_id").cast("long"), F.col(f"`{text}`").alias("text")).mapInArrow(
        run, "doc_id bigint, n bigint, digest binary, sketch array<bigint>, to_spare array<int>")


def _tag(digest: bytes) -> int:
    return int.from_bytes(digest[:KEY_BITS // 8], "big")


def _tag_column(digest: Column) -> Column:
    return F.conv(F.hex(F.substring(digest, 1, KEY_BITS // 8)), 16, 10).cast("long")


def _listed(docs: DataFrame, text: str, boundary: int, near: Near) -> DataFrame:
    """key, tag: the lists that the sets stand in, light ones up to ``boundary``."""
    def run(batches):
        done: set[bytes] = set()
        for batch in batches:
            keys, tags, counts = [], [], []
            for value in batch.column(0):
                s = shingles(value.as_py(), near.words)
                if len(s) < near.least:
                    continue
                digest = digest_of(s)
                if digest in done:
                    continue
                if len(done) >= TASK_SETS:
                    done.clear()
                done.add(digest)
                own = []
                if near.q * len(s) >= near.p * (boundary + 1):
                    own.append(heavy_keys(s, near))
                if len(s) <= boundary:
                    own.append(np.array(light_keys(s.view(np.int64).tolist(), boundary, near), np.int64))
                for k in own:
                    keys.append(k & ((1 << KEY_BITS) - 1))
                    tags.append(_tag(digest))
                    counts.append(len(k))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys), pa.int64()), pa.array(np.repeat(tags, counts), pa.int64())],
                    names=["key", "tag"])

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "key bigint, tag bigint")


def _shorter(named: DataFrame) -> DataFrame:
    """key, node of the lists that are left when each set leaves its longest ones, as many as it can spare.

    Longest by (length, key) is the same order for all sets, with empty blocks
    as the longest. If the shortest of the equal blocks of two linked sets were
    left by one of them, so were the others, all longer: more than are spare.
    """
    lengths = named.withColumn("length", F.count(F.lit(1)).over(Window.partitionBy("key")))
    longest = Window.partitionBy("node", F.col("key").bitwiseAND(1)).orderBy(F.desc("length"), "key")
    return lengths.withColumn("nth", F.row_number().over(longest)).filter("nth > to_spare").select("key", "node")


def _texts(docs: DataFrame, text: str, nodes: DataFrame, near: Near) -> DataFrame:
    """node, text, size and marks of the given nodes; a node without an id is known by its set."""
    def mark(batches):
        for batch in batches:
            sets = [shingles(x.as_py(), near.words) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([len(s) for s in sets], pa.int64()), pa.array([marks(s) for s in sets], pa.binary())],
                names=["node", "text", "size", "marks"])

    def run(batches):
        for batch in batches:
            digests = [digest_of(shingles(x.as_py(), near.words)) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), batch.column(0)], names=["digest", "text"])

    # Merged at every size: a table just small enough to be broadcast is not a size to plan for.
    nodes = nodes.hint("merge")
    value = F.col(f"`{text}`").alias("text")
    named = docs.select(F.col("doc_id").cast("long").alias("node"), value).filter("node IS NOT NULL")
    out = named.join(nodes, "node", "left_semi")
    if not nodes.filter(F.col("node") >= UNNAMED).isEmpty():
        rest = docs.filter("doc_id IS NULL").select(value).mapInArrow(run, "digest binary, text string")
        out = out.unionByName(rest.select(_unnamed(F.col("digest")).alias("node"), "text").join(
            nodes, "node", "left_semi"))
    return out.dropDuplicates(["node", "text"]).select("node", "text").mapInArrow(
        mark, "node bigint, text string, size bigint, marks binary")


def _may_link(na: Column, sa: Column, nb: Column, sb: Column, near: Near) -> Column:
    """Never false for a link: sizes within ``p / q``, and no more differing parity bits than elements may differ."""
    differ = sum((F.bit_count(sa[i].bitwiseXOR(sb[i])) for i in range(1, 8)),
                 F.bit_count(sa[0].bitwiseXOR(sb[0])))
    return ((near.q * F.least(na, nb) >= near.p * F.greatest(na, nb))
            & ((near.p + near.q) * differ <= (near.q - near.p) * (na + nb)))


def _verify(pairs: DataFrame, facts: DataFrame, texts: DataFrame, name: str, near: Near) -> DataFrame:
    """Those pairs (a, b) that link, checked on the whole sets; texts are joined to pairs that marks leave."""
    def of(side: str, table: DataFrame, *cols: str) -> DataFrame:
        return table.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in cols])

    def alike(batches):
        for batch in batches:
            keep = [(near.p + near.q) * unlike(x.as_py(), y.as_py()) <= (near.q - near.p) * (m.as_py() + n.as_py())
                    for x, y, m, n in zip(*map(batch.column, ("a_marks", "b_marks", "a_size", "b_size")))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def run(batches):
        last, s = None, None
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a_text"), batch.column("b_text")):
                x = x.as_py()
                if x != last:                # pairs of one pivot follow each other
                    last, s = x, shingles(x, near.words)
                other = shingles(y.as_py(), near.words)
                shared = len(np.intersect1d(s, other, assume_unique=True))
                keep.append(near.q * shared >= near.p * (len(s) + len(other) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = pairs.join(of("a", facts, "n", "sketch"), "a").join(of("b", facts, "n", "sketch"), "b")
    pairs = pairs.filter(_may_link(F.col("a_n"), F.col("a_sketch"), F.col("b_n"), F.col("b_sketch"), near))
    marked = pairs.select("a", "b").distinct().join(of("b", texts, "size", "marks"), "b").join(of("a", texts, "size", "marks"), "a")
    pairs = marked.mapInArrow(alike, "a bigint, b bigint").distinct()
    full = pairs.join(of("b", texts, "text"), "b").join(of("a", texts, "text"), "a")
    return materialize(full.select("a", "b", "a_text", "b_text").mapInArrow(run, "a bigint, b bigint").distinct(), name)


def _relabel(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Labels after further edges; nodes that are in no edge so far have no row."""
    if labels is None:
        return components(edges)
    a = labels.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    b = labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    lifted = edges.join(a, "a", "left").join(b, "b", "left").select(
        F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    up = components(lifted).select(F.col("node").alias("was"), F.col("root").alias("now"))
    moved = labels.join(up, F.col("root") == F.col("was"), "left").select(
        "node", F.coalesce("now", "root").alias("root"))
    new = up.join(labels, F.col("was") == F.col("node"), "left_anti").select(
        F.col("was").alias("node"), F.col("now").alias("root"))
    return materialize(moved.unionByName(new), "labels")


#: A class of equal sets is a node, named by its smallest id; without one, by its digest, above
#: all ids, so that the smallest node of a component is an id if there is one.
UNNAMED = 1 << 62


def _unnamed(digest: Column) -> Column:
    return F.conv(F.substring(F.hex(digest), 1, 15), 16, 10).cast("long") + F.lit(UNNAMED)


def _labelled(df: DataFrame, labels: DataFrame, node: str, out: str) -> DataFrame:
    by = labels.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    return df.join(by, F.col(node) == F.col("_n"), "left").withColumn(out, F.coalesce("_r", node)).drop("_n", "_r")


def _cross(open_: DataFrame, near: Near) -> DataFrame:
    """Pairs of members of different components of a list; members of a long list meet cell by cell."""
    cell = F.pmod(F.xxhash64("node"), F.col("cells"))
    dealt = open_.withColumn("cell", cell)
    x = dealt.withColumn("to", F.explode(F.sequence(F.col("cell"), F.col("cells") - 1))).withColumnRenamed("cell", "from")
    y = dealt.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cell")))).withColumnRenamed("cell", "to")
    x, y = x.alias("x"), y.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.from") == F.col("y.from"))
                 & (F.col("x.to") == F.col("y.to")) & (F.col("x.label") != F.col("y.label"))
                 & ((F.col("x.from") < F.col("x.to")) | (F.col("x.node") < F.col("y.node")))
                 & (F.col("x.pivot") != F.col("x.node")) & (F.col("y.pivot") != F.col("y.node"))
                 & _may_link(F.col("x.n"), F.col("x.sketch"), F.col("y.n"), F.col("y.sketch"), near))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def rooted_classes(docs: DataFrame, text: str = "text", near: Near = OP6) -> tuple[DataFrame, DataFrame]:
    """``doc_id, n, digest`` of every row, and ``digest, node, root`` of every class with shingles (written tables)."""
    seen = materialize(describe(docs, text, near), "jaccard-docs")
    marks = [f"s{i}" for i in range(8)]
    classes = seen.filter("n > 0").groupBy("digest").agg(
        F.min("doc_id").alias("id"), F.first("n").alias("n"),
        *[F.first(F.col("to_spare")[i]).alias(m) for i, m in enumerate(("even", "odd"))],
        *[F.first(F.col("sketch")[i]).alias(m) for i, m in enumerate(marks)])
    classes = materialize(classes.select("digest", "n", F.coalesce("id", _unnamed(F.col("digest"))).alias("node"),
                                         "even", "odd", F.array(*marks).alias("sketch")), "jaccard-classes")
    linkable = classes.filter(F.col("n") >= near.least)

    small = {r["n"]: r["count"] for r in
             linkable.filter(F.col("n") <= INLINE).groupBy("n").count().collect()}   # at most INLINE rows
    boundary = choose_boundary(small, near)
    same = Window.partitionBy("key")
    listed = _listed(docs, text, boundary, near).select(
        "key", "tag", F.min("tag").over(same).alias("lo"), F.max("tag").over(same).alias("hi"))
    met = materialize(listed.filter("lo <> hi").select("key", "tag"), "jaccard-met")
    # Sets that stand in light lists too leave none.
    spared = F.when(F.col("n") > boundary, F.when(F.col("key").bitwiseAND(1) == 0, F.col("even")).otherwise(F.col("odd"))).otherwise(0)
    named = met.join(linkable.select(_tag_column(F.col("digest")).alias("tag"), "node", "n", "even", "odd"), "tag")
    named = materialize(_shorter(named.select("key", "node", spared.alias("to_spare")).repartition("key").distinct()),
                        "jaccard-named")
    heads = named.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("top"),
                                     F.count(F.lit(1)).alias("members")).filter("pivot <> top").drop("top")
    scanned = materialize(named.join(heads, "key"), "jaccard-scanned")
    discard(met, named)

    nodes = materialize(scanned.select("node").distinct(), "jaccard-nodes")
    facts = materialize(linkable.join(nodes, "node", "left_semi").select("node", "n", "sketch"), "jaccard-facts")
    texts = materialize(_texts(docs, text, nodes, near), "jaccard-texts")

    # Every member with one pivot; then with its other pivots outside its component.
    one = scanned.groupBy("node").agg(F.min("pivot").alias("a")).filter("a < node")
    links = _verify(one.select("a", F.col("node").alias("b")), facts, texts, "jaccard-links", near)
    labels = _relabel(None, links)

    stars = scanned.filter("pivot < node").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    stars = _labelled(_labelled(stars, labels, "a", "la"), labels, "b", "lb").filter("la <> lb").select("a", "b")
    more = _verify(stars, facts, texts, "jaccard-links", near)
    labels = _relabel(labels, more)

    # Lists that still hold several components: members of different ones.
    open_ = _labelled(scanned, labels, "node", "label")
    parts = open_.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    open_ = materialize(open_.join(parts.select("key"), "key").join(facts, "node").select(
        "key", "node", "pivot", "label", "n", "sketch",
        F.ceil(F.col("members") / CELL).alias("cells")), "jaccard-open")
    last = _verify(_cross(open_, near), facts, texts, "jaccard-links", near)
    labels = _relabel(labels, last)
    rooted = materialize(_labelled(classes.select("digest", "node"), labels, "node", "root"), "jaccard-roots")
    discard(scanned, nodes, facts, texts, links, more, open_, last, classes)
    return seen.select("doc_id", "n", "digest"), rooted


def jaccard_components(docs: DataFrame, text: str = "text", near: Near = OP6) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs``."""
    seen, rooted = rooted_classes(docs, text, near)
    rooted = rooted.select(F.col("digest").alias("_digest"),
                           F.when(F.col("root") < UNNAMED, F.col("root")).alias("_component"))
    return seen.join(rooted, (F.col("digest") == F.col("_digest")) & (F.col("n") > 0), "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("_component")).otherwise(F.col("doc_id")).alias("component_id"))


def _with_digest(rows: DataFrame, text: str, near: Near) -> DataFrame:
    """``rows`` (one column ``_row``) with ``_digest`` and ``_n`` of the text's set."""
    def run(batches):
        for batch in batches:
            sets = [shingles(x.as_py(), near.words) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([digest_of(s) for s in sets], pa.binary()),
                 pa.array([len(s) for s in sets], pa.int64())], names=["_row", "_digest", "_n"])

    kind = rows.schema["_row"].dataType.simpleString()
    return rows.select("_row", F.col(f"_row.`{text}`").alias("_text")).mapInArrow(
        run, f"_row {kind}, _digest binary, _n bigint")


def keep_one(docs: DataFrame, text: str = "text", near: Near = OP6) -> DataFrame:
    """One row of ``docs`` per component: that of the smallest id, null ids last, of equal ones the first by text.

    Decided by id and set: an id with several texts loses those that are linked
    to a smaller id and keeps the others. Rows without shingles stay, repetitions
    of an id among them go. Only what goes or is in doubt (null and repeated
    ids) is joined to the texts.
    """
    seen, rooted = rooted_classes(docs, text, near)
    by = F.col("digest") == F.col("_digest")
    found = seen.join(rooted.select(F.col("digest").alias("_digest"), "root"), by & (F.col("n") > 0), "left")
    # Ids whose rows do not simply stay. Written, so that Spark joins them by their real size.
    special = materialize(found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("root") != F.col("doc_id"), F.lit(False))).alias("_gone"), F.count(F.lit(1)).alias("_rows"))
        .filter("_gone OR _rows > 1").select(F.col("doc_id").alias("_id"), "_rows"), "jaccard-special")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    own = F.col("_row.doc_id")
    left = rows.filter(own.isNotNull()).join(special.hint("merge"), own == F.col("_id"), "left_anti")
    # Null and repeated ids: by id and set.
    repeated = materialize(special.filter("_rows > 1").select("_id"), "jaccard-repeated")
    doubt = rows.filter(own.isNull())
    if not repeated.isEmpty():
        doubt = doubt.unionByName(rows.join(repeated, own == F.col("_id"), "left_semi"))
    doubt = materialize(_with_digest(doubt, text, near).withColumn("_nth", F.monotonically_increasing_id()),
                        "jaccard-doubt")
    winners = rooted.filter("node = root").groupBy("root").agg(F.min("digest").alias("_digest"))
    winners = winners.select("_digest", F.when(F.col("root") < UNNAMED, F.col("root")).alias("_id"))
    stays = doubt.filter("_n > 0").join(winners, "_digest").filter(own.eqNullSafe(F.col("_id")))
    first = stays.select("_digest", own.alias("_id"), F.xxhash64(F.col(f"_row.`{text}`")).alias("_h"), "_nth").unionByName(
        doubt.filter((F.col("_n") == 0) & own.isNotNull()).select("_digest", own.alias("_id"), F.lit(0).cast("long").alias("_h"), "_nth"))
    first = first.groupBy("_digest", "_id").agg(F.min(F.struct("_h", "_nth"))["_nth"].alias("_chosen")).select("_chosen")
    chosen = doubt.join(materialize(first, "jaccard-chosen"), F.col("_nth") == F.col("_chosen"), "left_semi")
    blank = doubt.filter((F.col("_n") == 0) & own.isNull())
    return left.select("_row").unionByName(chosen.select("_row")).unionByName(blank.select("_row")).select("_row.*")


def oracle(table: str = "documents", near: Near = OP6) -> str:
    """DuckDB SQL of :func:`jaccard_components`: all pairs that share a shingle."""
    words, p, q = near
    leads = ", ".join(f"lead(v, {i}) OVER o" for i in range(1, words))
    return f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table}),
t AS (SELECT rid, len(w) AS len, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT DISTINCT rid, v FROM (
        SELECT rid, len, i, concat_ws(' ', v, {leads}) AS v FROM t WINDOW o AS (PARTITION BY rid ORDER BY i))
      WHERE i <= greatest(len - {words - 1}, 1)),
s AS (SELECT d.rid, d.doc_id, count(g.rid) AS n FROM d LEFT JOIN g USING (rid) GROUP BY ALL),
x AS (SELECT rid, n, v FROM g JOIN s USING (rid)),
p AS (SELECT a.rid AS a, b.rid AS b, a.n AS na, b.n AS nb, count(*) AS c
      FROM x a JOIN x b ON a.v = b.v AND a.rid < b.rid AND {q} * a.n >= {p} * b.n AND {q} * b.n >= {p} * a.n
      GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE {q} * c >= {p} * (na + nb - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rid AS a, rid AS b FROM s UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT s.doc_id, s.n AS n_shingles, min(t.doc_id) AS component_id
FROM s JOIN r ON s.rid = r.a JOIN s t ON t.rid = r.b GROUP BY s.rid, s.doc_id, s.n"""

"""Merkle manifest of a dataset, its trees stored in van Emde Boas layout.

A row is a leaf: the hash of its columns. Leaves of a group (a language) stand
in the order of their id; every two consecutive nodes become one, the last of
an odd level alone, until one remains, the group's subroot. Subroots, by group
(null first, else by bytes), become the root in the same way. All hashes are
lowercase hex SHA-256.

1. One pass hashes the rows (built-in functions), the tampered ones twice.
2. Positions within a group come from a range-sort of the leaves and counts per
   range, so a group may hold any share of the rows.
3. Leaves are cut into aligned blocks of ``2 ** HEIGHT``. A block is a complete
   subtree and a task of its own. Its nodes are stored in one byte string in
   van Emde Boas order: a tree of ``L`` levels is its upper half of levels,
   then the lower subtrees one after the other, each laid out alike, so a path
   touches few neighbouring stretches whatever the size of a page.
   :func:`address` is this arithmetic; building writes by it and proofs read
   siblings by it.
4. Block roots are the leaves of the next layer, and so on until a group is a
   single block. So is the tree over the subroots.
5. Proofs go down again: a block gets the path above its root, and gives each
   child its own. The rows meet only the path of their block.

Null columns hash as ``-``. A null id stands before all others, rows with the
same id by their hash; identical rows are leaves of their own. A null group is
a group, as is an empty name. An empty table has no rows and no root. Texts are
hashed whole. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from distkpi.llm.common import materialize

HEIGHT = 12             # a block: up to 4,096 leaves, 8,191 nodes of 32 bytes
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER = 7


# ---- the layout -----------------------------------------------------------------

@lru_cache(None)
def addresses(levels: int) -> tuple[np.ndarray, ...]:
    """Place of every node of a complete tree of ``levels`` levels: by level from the root, then by index."""
    if levels == 1:
        return (np.zeros(1, np.int64),)
    upper, lower = addresses(levels // 2), addresses(levels - levels // 2)
    subtrees = np.arange(1 << len(upper))[:, None]
    start = (1 << len(upper)) - 1
    return (*upper, *((start + subtrees * ((1 << len(lower)) - 1) + x[None, :]).ravel() for x in lower))


def address(levels: int, depth: int, index: int) -> int:
    """Place of one node, without a table: descends into the half that holds it."""
    base = 0
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        depth -= upper
        lower = levels - upper
        base += (1 << upper) - 1 + (index >> depth) * ((1 << lower) - 1)
        index &= (1 << depth) - 1
        levels = lower
    return base


def _join(*digests: bytes) -> bytes:
    """Parent of nodes: the hash of their hex texts."""
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


def grown(leaves: list[bytes], height: int | None) -> tuple[int, bytes, bytes]:
    """``(levels, nodes, root)`` of a block; ``height`` None: until one node remains."""
    if height is None:
        height = (len(leaves) - 1).bit_length()
    places = addresses(height + 1)
    store = np.zeros(((1 << (height + 1)) - 1, 32), np.uint8)
    level = leaves
    for depth in range(height, -1, -1):
        store[places[depth][:len(level)]] = np.frombuffer(b"".join(level), np.uint8).reshape(-1, 32)
        if depth:
            level = [_join(*level[i:i + 2]) for i in range(0, len(level), 2)]
    return height + 1, store.tobytes(), level[0]


def siblings(nodes: bytes, levels: int, count: int, index: int) -> list[tuple[bytes | None, bool]]:
    """From a leaf of a block up: (the sibling or none, whether it stands left)."""
    out = []
    for depth in range(levels - 1, 0, -1):
        other = index ^ 1
        if other < count:
            at = 32 * address(levels, depth, other)
            out.append((nodes[at:at + 32], other < index))
        else:
            out.append((None, False))
        index, count = index >> 1, -(-count // 2)
    return out


# A path is a byte string of steps, bottom up: 0 (no sibling), 1 (it stands left) or 2 (right), and its digest.

def path_of(steps: list[tuple[bytes | None, bool]]) -> bytes:
    return b"".join(b"\0" if d is None else (b"\1" if left else b"\2") + d for d, left in steps)


def steps_of(path: bytes) -> list[tuple[bytes | None, bool]]:
    out, i = [], 0
    while i < len(path):
        mark = path[i]
        out.append((path[i + 1:i + 33] if mark else None, mark == 1))
        i += 33 if mark else 1
    return out


def proof(path: list[tuple[bytes | None, bool]]) -> str:
    """One hash of all siblings of a path."""
    return hashlib.sha256(b"".join(d.hex().encode() for d, _ in path if d is not None)).hexdigest()


def folded(leaf: bytes, path: list[tuple[bytes | None, bool]]) -> bytes:
    """The root that a leaf and a path lead to."""
    for other, left in path:
        leaf = _join(leaf) if other is None else _join(other, leaf) if left else _join(leaf, other)
    return leaf


# ---- leaves ---------------------------------------------------------------------

def leaf_hash(*columns: Column) -> Column:
    """Hash of columns: ``-`` for null, else byte count, ``:`` and value."""
    parts = [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
             for s in (c.cast("string") for c in columns)]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", id: str = "doc_id",
           tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """g, doc_id, leaf, changed: the group (null first, then by bytes), the hash and that after tampering.

    ``tampered`` gives new values of columns for the rows that satisfy ``where``.
    """
    touched = F.lit(None)
    if tampered:
        touched = F.when(where, leaf_hash(*[tampered.get(c, F.col(f"`{c}`")) for c in columns]))
    g = F.coalesce(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")), F.lit("0"))
    return docs.select(g.alias("g"), F.col(f"`{id}`").alias("doc_id"),
                       F.unhex(leaf_hash(*[F.col(f"`{c}`") for c in columns])).alias("leaf"),
                       F.unhex(touched).alias("touched")).select(
        "g", "doc_id", "leaf", F.coalesce("touched", "leaf").alias("changed"))


def positions(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """A written table of ``rows`` with ``rank`` in the group by the order, and ``total``, the group's rows.

    Equal rows may stand in any order; a number spreads them over the ranges.
    """
    key = [*group, *order, "_tie"]
    spread = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*key)
    ordered = spread.sortWithinPartitions(*key).drop("_tie")
    fields = ordered.schema.fields
    where = [ordered.columns.index(g) for g in group]

    def run(batches):
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in where))) or [()] * batch.num_rows
            nth = []
            for k in keys:
                n = n + 1 if k == last else 0
                last = k
                nth.append(n)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * len(nth), pa.int32()), pa.array(nth, pa.int64())],
                names=[*batch.schema.names, "part", "nth"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    numbered = materialize(ordered.mapInArrow(run, f"{schema}, part int, nth bigint"), f"{name}-numbered")
    # One row per group and range; ranges follow the order, so a group's ranges are consecutive.
    counts = numbered.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy(*group)
    counts = counts.select(
        *group, "part", F.sum("n").over(by).alias("total"),
        F.coalesce(F.sum("n").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("before"))
    return numbered.join(materialize(counts, f"{name}-ranges"), [*group, "part"]).select(
        *[f.name for f in fields], (F.col("before") + F.col("nth")).alias("rank"), "total")


# ---- the manifest ---------------------------------------------------------------

BLOCK = "g string, total bigint, block bigint, count bigint, levels int, nodes binary, digest binary"


def _blocks(nodes: DataFrame, layer: int, height: int) -> DataFrame:
    """The blocks of one layer from its nodes (g, total, rank, digest)."""
    def run(key, table):
        g, block = (k.as_py() for k in key)
        total = table.column("total")[0].as_py()
        order = np.argsort(table.column("rank").to_numpy())
        digests = table.column("digest").combine_chunks().take(pa.array(order)).to_pylist()
        width = -(-total >> height * layer)                          # nodes of this layer in the group
        levels, stored, root = grown(digests, None if width <= 1 << height else height)
        return pa.table({"g": pa.array([g], pa.string()), "total": pa.array([total], pa.int64()),
                         "block": pa.array([block], pa.int64()), "count": pa.array([len(digests)], pa.int64()),
                         "levels": pa.array([levels], pa.int32()), "nodes": pa.array([stored], pa.binary()),
                         "digest": pa.array([root], pa.binary())})

    return nodes.withColumn("block", F.shiftright("rank", height)).groupBy("g", "block").applyInArrow(run, BLOCK)


def _is_top(layer: int, height: int) -> Column:
    return F.col("total") <= F.lit(1 << height * (layer + 1))


def build(nodes: DataFrame, name: str, height: int = HEIGHT) -> list[DataFrame]:
    """The layers of the trees over (g, total, rank, digest), each a written table of blocks.

    A group's tree ends in the layer where it is a single block; that block's
    ``digest`` is its root.
    """
    out, layer = [], 0
    while True:
        blocks = materialize(_blocks(nodes, layer, height), f"{name}-layer{layer}")
        out.append(blocks)
        rest = blocks.filter(~_is_top(layer, height))
        if rest.isEmpty():
            return out
        nodes = rest.select("g", "total", F.col("block").alias("rank"), "digest")
        layer += 1


def roots(layers: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """g, digest: the root of every group."""
    tops = [b.filter(_is_top(k, height)).select("g", "digest") for k, b in enumerate(layers)]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def _children(blocks: DataFrame, height: int) -> DataFrame:
    """g, block, path: the path above every leaf of ``blocks``, whose own paths are given; ``block`` is its rank."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in ("g", "block", "count", "levels", "nodes", "path")}
                first, m = r["block"] << height, r["count"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["g"]] * m, pa.string()), pa.array(range(first, first + m), pa.int64()),
                     pa.array([path_of(siblings(r["nodes"], r["levels"], m, k)) + r["path"] for k in range(m)],
                              pa.binary())], names=["g", "block", "path"])

    return blocks.mapInArrow(run, "g string, block bigint, path binary")


def block_paths(layers: list[DataFrame], above: DataFrame, name: str, height: int = HEIGHT) -> DataFrame:
    """g, block, path: the path above the root of every block of the lowest layer.

    ``above`` gives the path above each group's root (g, path).
    """
    paths = None
    for layer in range(len(layers) - 1, -1, -1):
        # A block at its group's top gets the group's path, any other that of its parent's leaf.
        tops = layers[layer].filter(_is_top(layer, height)).select("g", "block").join(above, "g")
        paths = tops if paths is None else tops.unionByName(paths)
        if layer:
            paths = materialize(_children(layers[layer].join(paths, ["g", "block"]), height), f"{name}-paths{layer}")
    return paths


def _folded(rows: DataFrame, blocks: DataFrame, height: int) -> DataFrame:
    """The result row of every leaf: its path is that inside its block and then the block's."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        proofs, ends, fixed = [], [], ("", "")
        if left.num_rows:
            block = right.to_pylist()[0]
            fixed = block["subroot"].hex(), block["root"].hex()
            above = steps_of(block["path"])
            for rank, leaf in zip(left.column("rank").to_pylist(), left.column("changed").to_pylist()):
                path = siblings(block["nodes"], block["levels"], block["count"], rank & ((1 << height) - 1)) + above
                proofs.append(proof(path))
                ends.append(folded(leaf, path).hex())
        m = left.num_rows
        return pa.table({
            "doc_id": left.column("doc_id"), "leaf": pa.array([v.hex() for v in left.column("leaf").to_pylist()], pa.string()),
            "subroot": pa.array([fixed[0]] * m, pa.string()), "root": pa.array([fixed[1]] * m, pa.string()),
            "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(ends, pa.string())})

    left = rows.select("g", F.shiftright("rank", height).alias("block"), "rank", "doc_id", "leaf", "changed")
    return left.groupBy("g", "block").cogroup(blocks.groupBy("g", "block")).applyInArrow(
        run, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")


class Manifest(NamedTuple):
    """Written tables: placed leaves, tree layers of the groups, placed subroots, tree layers over them."""

    leaves: DataFrame
    layers: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]


def manifest(rows: DataFrame, height: int = HEIGHT) -> Manifest:
    """The manifest of a written table of :func:`leaves`."""
    placed = materialize(positions(rows, ["g"], ["doc_id", "leaf"], "merkle"), "merkle-leaves")
    layers = build(placed.select("g", "total", "rank", F.col("leaf").alias("digest")), "merkle", height)
    own = roots(layers, height).select(F.lit("").alias("all"), F.col("g").alias("group"), "digest")
    subroots = materialize(positions(own, ["all"], ["group"], "merkle-top"), "merkle-subroots")
    top = build(subroots.select(F.col("all").alias("g"), "total", "rank", "digest"), "merkle-top", height)
    return Manifest(placed, layers, subroots, top)


def verify(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified from a written table of :func:`leaves`."""
    m = manifest(rows, height)
    root = roots(m.top, height)
    # Down the tree over the subroots: the path above every group's subroot.
    top = m.top[0].join(block_paths(m.top, root.select("g", F.lit(b"").alias("path")), "merkle-top", height),
                        ["g", "block"])
    above = m.subroots.select("group", "rank", F.col("digest").alias("subroot")).join(
        _children(top, height).select(F.col("block").alias("rank"), "path"), "rank")
    above = materialize(above.select(F.col("group").alias("g"), "subroot", "path"), "merkle-above")
    # Down the groups' trees: the path above every block.
    blocks = m.layers[0].drop("digest").join(
        block_paths(m.layers, above.select("g", "path"), "merkle", height), ["g", "block"])
    blocks = blocks.join(above.select("g", "subroot"), "g").withColumn(
        "root", root.agg(F.max("digest")).scalar())
    out = _folded(m.leaves, blocks.drop("total"), height)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def prove(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The manifest of ``documents``, and the check of every row after tampering.

    Tampering adds 1 to ``n_chars`` where ``TAMPER`` divides the CRC-32 of the
    decimal id; a null id is never touched and a null count stays null.
    """
    where = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER) == 0
    changed = {"n_chars": (F.col("n_chars").cast("decimal(38,0)") + 1)}
    return verify(materialize(leaves(docs, tampered=changed, where=where), "merkle-hashes"), height)


def oracle(table: str = "documents") -> str:
    """DuckDB SQL of :func:`prove`: levels by recursion, siblings by position."""
    def leaf(n_chars: str) -> str:
        parts = [f"coalesce(strlen({v}) || ':' || ({v}), '-')" for v in
                 ("doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text")]
        return f"sha256({' || '.join(parts)})"

    # CRC-32 bit by bit: every character, then seven shifts.
    bits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [unicode(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    crc = (f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), "
           "lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)")

    def tree(name: str, start: str) -> str:
        return f"""{name}(g, n, level, i, h) AS (
  {start} UNION ALL
  SELECT a.g, (a.n + 1) // 2, a.level + 1, a.i // 2, sha256(a.h || coalesce(b.h, ''))
  FROM {name} a LEFT JOIN {name} b ON a.g = b.g AND b.i = a.i + 1 WHERE a.n > 1 AND a.i % 2 = 0)"""

    def fold(name: str, nodes: str, start: str) -> str:
        return f"""{name}(rid, g, level, i, h) AS (
  {start} UNION ALL
  SELECT f.rid, f.g, f.level + 1, f.i // 2,
         sha256(CASE WHEN f.i % 2 = 0 THEN f.h || coalesce(o.h, '') ELSE o.h || f.h END)
  FROM {name} f JOIN {nodes}_top e ON e.g = f.g AND f.level < e.level
  LEFT JOIN {nodes} o ON o.g = f.g AND o.level = f.level AND o.i = xor(f.i, 1))"""

    return f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('1' || lang, '0') AS g, {leaf('n_chars')} AS leaf,
         CASE WHEN {crc} % 7 = 0 THEN {leaf('n_chars + 1')} ELSE {leaf('n_chars')} END AS touched FROM {table}),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS i,
             count(*) OVER (PARTITION BY g) AS n FROM d),
{tree('t', 'SELECT g, n, 0, i, leaf FROM p')},
t_top AS (SELECT g, level, h FROM t WHERE n = 1),
s AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS j, count(*) OVER () AS n, h FROM t_top),
{tree('u', "SELECT 'all', n, 0, j, h FROM s")},
u_top AS (SELECT g, level, h FROM u WHERE n = 1),
q AS (SELECT p.rid, o.level AS l, o.h FROM p JOIN t o ON o.g = p.g AND o.i = xor(p.i >> o.level, 1)
      UNION ALL
      SELECT p.rid, 1000 + o.level, o.h FROM p JOIN s ON s.g = p.g JOIN u o ON o.i = xor(s.j >> o.level, 1)),
{fold('f', 't', 'SELECT rid, g, 0, i, touched FROM p')},
v AS (SELECT f.rid, f.g, f.h FROM f JOIN t_top USING (g, level)),
{fold('w', 'u', "SELECT v.rid, 'all', 0, s.j, v.h FROM v JOIN s USING (g)")},
z AS (SELECT w.rid, w.h FROM w JOIN u_top USING (g, level)),
proofs AS (SELECT rid, sha256(string_agg(h, '' ORDER BY l)) AS proof FROM q GROUP BY rid)
SELECT p.doc_id, p.leaf, t_top.h AS subroot, u_top.h AS root, coalesce(proofs.proof, sha256('')) AS proof_sha256,
       z.h AS folded_root, z.h = u_top.h AS verified
FROM p JOIN t_top USING (g) CROSS JOIN u_top JOIN z USING (rid) LEFT JOIN proofs USING (rid)"""

"""The manifest against a plain reading of the rule, at several block heights; layout and proofs."""

import hashlib
import zlib

import pytest

from distkpi.llm import merkle_manifest as m
from distkpi.llm.common import materialize
from tests.llm.test_oracles import duck, same


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def plain(rows):
    """Rows (doc_id, source, lang, n_chars, text) by a literal reading."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = levels([leaf(r) for r in groups[g]])
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            touched = list(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                touched[3] += 1
            node, siblings = leaf(touched), []
            for tree, at in ((trees[g], i), (top, k)):
                for level in tree[:-1]:
                    other = at ^ 1
                    if other < len(level):
                        siblings.append(level[other])
                        node = h(level[other], node) if other < at else h(node, level[other])
                    else:
                        node = h(node)
                    at //= 2
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], h(*siblings), node, node == top[-1][0]))
    return sorted(out, key=repr)


def docs(spark, rows):
    return spark.createDataFrame([(*r, 7, "g") for r in rows],
                                 "doc_id bigint, source string, lang string, n_chars bigint, text string, rank int, g string")


@pytest.mark.parametrize("height", [1, 2, 3, 12])
def test_against_plain(spark, height):
    rows = [(i, "s", "en", i, f"text {i}") for i in range(37)]
    rows += [(i, None, "de", None, None) for i in range(100, 109)] + [(i, "é", None, 3, "ü") for i in range(200, 203)]
    rows += [(500, "x", "", 1, ""), (501, "x", "zz", 1, "a" * 100_000), (502, "x", "日本", 2, "本")]
    rows += [(None, "x", "en", 1, "a"), (None, "x", "en", 1, "b"), (3, "s", "en", 3, "text 3"), (3, "s", "en", 9, "other")]
    got = m.prove(docs(spark, rows), height).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)
    assert {r["verified"] for r in got} == {True, False}


def test_small_tables(spark):
    one = [(7, "s", None, 1, "t")]
    assert sorted(map(tuple, m.prove(docs(spark, one)).collect()), key=repr) == plain(one)
    assert m.prove(docs(spark, [])).collect() == []
    for n in (2, 3, 4, 5):
        rows = [(i, "s", "l", i, "t") for i in range(n)]
        assert sorted(map(tuple, m.prove(docs(spark, rows), 1).collect()), key=repr) == plain(rows)


def test_oracle(spark):
    rows = [(i, "s" if i % 3 else None, ["en", "de", None][i % 3], i * 7, f"x{i}é") for i in range(60)]
    table = docs(spark, rows)
    same(m.prove(table, 3), duck(m.oracle(), documents=table.toArrow()))


def test_layout():
    for n in range(1, 14):
        table = m.addresses(n)
        places = [p for level in table for p in level.tolist()]
        assert sorted(places) == list(range((1 << n) - 1))
        for depth, level in enumerate(table):
            for i in range(0, len(level), max(1, len(level) // 50)):
                assert m.address(n, depth, i) == level[i]
    # The upper half of the levels comes first, then each lower subtree in one stretch.
    assert sorted(p for level in m.addresses(12)[:6] for p in level.tolist()) == list(range(63))
    below = [p for depth, level in enumerate(m.addresses(12)[6:]) for p in level[:1 << depth].tolist()]
    assert sorted(below) == list(range(63, 126))


def test_stored_manifest(spark):
    """Every stored node is where the address says, and a layer's roots are the next layer's leaves."""
    rows = materialize(m.leaves(docs(spark, [(i, "s", "en", i, str(i)) for i in range(50)])), "t-leaves")
    made = m.manifest(rows, 2)
    assert [b.count() for b in made.layers] == [13, 4, 1]
    tree = levels([r["leaf"].hex() for r in made.leaves.orderBy("rank").collect()])
    for layer, blocks in enumerate(made.layers):
        for b in blocks.collect():
            count, at = b["count"], b["block"] << 2
            for up in range(b["levels"]):
                for i in range(count):
                    place = 32 * m.address(b["levels"], b["levels"] - 1 - up, i)
                    assert b["nodes"][place:place + 32].hex() == tree[2 * layer + up][at + i]
                count, at = -(-count // 2), at // 2

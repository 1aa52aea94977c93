"""The parts of the join, and rows that SQL sees differently."""

import random
import time
from itertools import combinations

import numpy as np

import corpus_pipeline
from distkpi.llm import common
from distkpi.llm import jaccard_join as j
from distkpi.llm.components import components


def brute(texts):
    sets = [frozenset(j.shingles(t).tolist()) for t in texts]
    return {(a, b) for a, b in combinations(range(len(sets)), 2)
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])}


def test_keys_meet_for_every_link():
    rng = random.Random(3)
    for n in (9, 10, 11, 18, 19, 20, 21, 35, 60, 150, 400):
        for _ in range(40):
            a = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))
            drop = rng.randrange(n // 10 + 1)
            add = rng.randrange(n // 10 + 1)
            b = np.unique(np.concatenate([rng.sample(a.tolist(), n - drop),
                                          [rng.getrandbits(64) for _ in range(add)]]).astype(np.uint64))
            shared = len(np.intersect1d(a, b))
            if 100 * shared < 90 * (len(a) + len(b) - shared):
                continue
            assert set(j.heavy_keys(a).tolist()) & set(j.heavy_keys(b).tolist())
            assert 19 * int((np.unpackbits(j.sketch(a).view(np.uint8)) != np.unpackbits(j.sketch(b).view(np.uint8))).sum()) \
                <= len(a) + len(b)
            if max(len(a), len(b)) <= 20 and not np.array_equal(a, b):
                assert set(j.light_keys(a.tolist(), 20)) & set(j.light_keys(b.tolist(), 20))


def test_boundary_follows_the_cost():
    assert j.choose_boundary({}) == j.LEAST - 1
    assert 10 <= j.choose_boundary({n: 100 for n in range(9, 65)}) < 25


def test_random_groups_against_all_pairs(spark, make_docs):
    rng = random.Random(9)
    texts = []
    for g in range(12):
        size = rng.choice([10, 14, 19, 25, 60, 120])
        words = [f"g{g}w{i}" for i in range(size + 2)]
        for _ in range(10):
            if rng.random() < 0.7:
                words = list(words)
                words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
            texts.append(" ".join(words if rng.random() < 0.8 else words[:-rng.randrange(1, 4)]))
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in sorted(brute(texts)):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = {i: root(i) for i in range(len(texts))}
    order = list(range(len(texts)))
    rng.shuffle(order)
    got = {r["doc_id"]: r["component_id"] for r in j.jaccard_components(make_docs([(i, texts[i]) for i in order])).collect()}
    assert got == want


def test_null_and_shared_ids(make_docs):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = make_docs([(None, a), (None, a), (5, a), (7, a), (None, b), (None, ""), (8, None), (9, b + " end"),
                      (9, b + " end"), (None, "only here without any id"), (3, "alone " + b[:60])])
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in j.jaccard_components(docs).collect()), key=repr)
    assert got == sorted([(None, 28, 5), (None, 28, 5), (5, 28, 5), (7, 28, 5), (None, 28, 9), (None, 0, None),
                          (8, 0, 8), (9, 29, 9), (9, 29, 9), (None, 3, None), (3, got[[g[0] for g in got].index(3)][1], 3)], key=repr)
    kept = j.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(
        [(5, a), (9, b + " end"), (8, None), (None, ""), (None, "only here without any id"), (3, "alone " + b[:60])], key=repr)


def test_one_row_of_each_group_by_id_and_text(make_docs):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = make_docs([(1, a), (2, a), (2, b), (2, b.upper()), (None, c), (None, c + " more"), (None, c), (4, ""), (4, None), (None, " ")])
    for near in (j.OP6, j.GENERAL):
        got = sorted(((r["doc_id"], (r["text"] or "").lower()) for r in j.keep_one(docs, near=near).collect()), key=repr)
        assert [g for g in got if g[0] is not None] == [(1, a), (2, b), (4, "")]
        assert len([g for g in got if g[0] is None and g[1].strip()]) == 1 and (None, " ") in got


def test_long_lists_are_dealt_to_cells(make_docs, monkeypatch):
    """Many members of one list, linked in no star: each cell of the list is a group of its own."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(40)]
    texts = []
    for i in range(60):
        copy = list(words)
        for k in rng.sample(range(40), rng.choice([1, 3, 5])):
            copy[k] = f"x{i}y{k}"
        texts.append(" ".join(copy))
    want = j.jaccard_components(make_docs(list(enumerate(texts))), near=j.GENERAL).collect()
    monkeypatch.setattr(j, "CELL", 4)
    got = j.jaccard_components(make_docs(list(enumerate(texts))), near=j.GENERAL).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_components_of_a_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}
    assert components(edges.limit(0)).count() == 0


def test_keys_meet_for_every_link_at_the_general_rule():
    near, rng = j.GENERAL, random.Random(4)
    met = 0
    for n in (4, 5, 6, 8, 9, 12, 17, 25, 40, 60, 150, 400, 1500):
        for _ in range(40):
            a = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))
            drop, add = rng.randrange(n // 5 + 1), rng.randrange(n // 4 + 1)
            b = np.unique(np.array(rng.sample(a.tolist(), n - drop) + [rng.getrandbits(64) for _ in range(add)], np.uint64))
            shared = len(np.intersect1d(a, b))
            if 5 * shared < 4 * (len(a) + len(b) - shared):
                continue
            met += 1
            assert set(j.heavy_keys(a, near).tolist()) & set(j.heavy_keys(b, near).tolist())
            assert 9 * int((np.unpackbits(j.sketch(a).view(np.uint8)) != np.unpackbits(j.sketch(b).view(np.uint8))).sum()) \
                <= len(a) + len(b)
            if max(len(a), len(b)) <= 12 and not np.array_equal(a, b):
                x, y = (j.light_keys(s.view(np.int64).tolist(), 12, near) for s in (a, b))
                assert set(x) & set(y)
    assert met > 200


def test_near_copies_between_the_limits(spark, make_docs):
    """Families whose members are at 0.8 to 0.9: all pairs by brute force, and what the pipeline's stage keeps."""
    rng, texts = random.Random(12), []
    for g, size in enumerate((9, 20, 30, 40, 60, 60, 60, 140, 140, 300, 600)):
        words = [f"g{g}w{i}" for i in range(size + 4)]
        for _ in range(8):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 1, 2]) * max(1, size // 70)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10 ** 6)}"
            texts.append(" ".join(copy if rng.random() < 0.7 else copy[:-rng.randrange(1, 4)]))
    sets = [frozenset(j.shingles(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    between = 0
    for a, b in combinations(range(len(texts)), 2):
        shared, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if 5 * shared >= 4 * union:
            between += 10 * shared < 9 * union
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
    assert between > 20
    docs = make_docs(list(enumerate(texts)))
    got = {r["doc_id"]: r["component_id"] for r in j.jaccard_components(docs, near=j.GENERAL).collect()}
    assert got == dict(enumerate(root))
    kept = corpus_pipeline.distinct(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))


def test_linked_sets_meet_without_their_longest_lists():
    """Each set leaves its longest lists, as many as it can spare, whatever lists are long."""
    rng, met, left = random.Random(31), 0, 0
    for near in (j.OP6, j.GENERAL):
        for n in (10, 17, 26, 33, 60, 150, 400, 1500):
            for _ in range(40):
                a = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))
                drop, add = (rng.randrange(n * (near.q - near.p) // near.q + 1) for _ in "ab")
                b = np.unique(np.array(rng.sample(a.tolist(), n - drop) + [rng.getrandbits(64) for _ in range(add)], np.uint64))
                shared = len(np.intersect1d(a, b))
                if near.q * shared < near.p * (len(a) + len(b) - shared) or min(len(a), len(b)) < near.least:
                    continue
                both = set(j.heavy_keys(a, near).tolist()) & set(j.heavy_keys(b, near).tolist())
                for longest in (lambda k: k in both, lambda k: k not in both, lambda k: k % 7):     # shared, own or any lists
                    stay = []
                    for s in (a, b):
                        spared, keys = j.to_spare(s, near), j.heavy_keys(s, near).tolist()
                        left += sum(spared)
                        stay.append({k for g in (0, 1) for k in sorted((k for k in keys if k & 1 == g),
                                                                     key=lambda k: (-longest(k), k))[spared[g]:]})
                    assert stay[0] & stay[1]
                met += 1
    assert met > 150 and left > 10 * met


def test_marks_reject_no_link_and_most_large_sets():
    rng = random.Random(32)
    for near in (j.OP6, j.GENERAL):
        for n in (4, 9, 30, 200, 3000):
            for share in (0, 0.01, 0.03, 0.05, 0.1, 0.5, 1):
                a = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))
                b = np.unique(np.array(rng.sample(a.tolist(), n - int(share * n)) + [rng.getrandbits(64) for _ in range(int(share * n) + 1)], np.uint64))
                shared = len(np.intersect1d(a, b))
                least = j.unlike(j.marks(a), j.marks(b))
                assert least <= len(a) + len(b) - 2 * shared and least == j.unlike(j.marks(b), j.marks(a))
                passes = (near.p + near.q) * least <= (near.q - near.p) * (len(a) + len(b))
                assert passes or near.q * shared < near.p * (len(a) + len(b) - shared)
                assert not passes or share < 0.5 or n < 30


def test_texts_of_shared_lines_are_not_compared(make_docs, monkeypatch):
    """Long texts that hold the same lines and link with few: no text is read again for the others, all links are found."""
    rng = random.Random(33)
    lines = [[f"line{k}w{i}" for i in range(9)] for k in range(6)]
    texts = []
    for i in range(40):
        words = [f"d{i}w{k}" for k in range(rng.choice([700, 1300, 1400]))]
        for k, line in enumerate(lines):
            words[100 * (k + 1):100 * (k + 1)] = line
        texts.append(words)
    for i in (3, 17, 28):                                                                           # near copies of three
        copy = list(texts[i])
        for k in rng.sample(range(len(copy)), len(copy) // 50):
            copy[k] = f"x{i}y{k}"
        texts.append(copy)
    texts = [" ".join(t) for t in texts]
    read, write = {}, j.materialize

    def spy(df, name):
        out = write(df, name)
        read[name] = read.get(name, 0) + out.count()
        return out
    monkeypatch.setattr(j, "materialize", spy)
    got = {r["doc_id"]: r["component_id"] for r in j.jaccard_components(make_docs(list(enumerate(texts))), near=j.GENERAL).collect()}
    assert got == {**{i: i for i in range(40)}, 40: 3, 41: 17, 42: 28}
    assert read["jaccard-texts"] <= 10, read


def test_shuffle_files_go_with_the_write(spark):
    def files():
        disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        every = disk.getAllFiles()
        return {every.apply(i).getName() for i in range(every.size()) if every.apply(i).getName().startswith("shuffle_")}
    before, was = files(), spark.conf.get(common.SHUFFLES_GO)
    out = common.materialize(spark.range(1000).repartition(4, "id").groupBy("id").count(), "t")
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(common.SHUFFLES_GO) == was and out.count() == 1000

"""Learned operators against plain versions: every language set, a generic optimiser, one process."""

import itertools
import math
import zlib

import numpy as np
import pytest

from distkpi.llm import language_mixture, quality_ranking

# Beside the operator's: its rounds end early by design, these go on.
LONG = 3000


def plain_counts(text):
    """Trigrams of letters and separators, one after the other."""
    def cell(byte):
        return byte - 96 if 97 <= byte <= 122 else byte - 101 if byte >= 128 else 0

    c = [0, 0, *map(cell, text.lower().encode()), 0]
    out = {}
    for a, b, d in zip(c, c[1:], c[2:]):
        if b:
            at = ((a * 155 + b) * 155 + d) * 0x9E3779B97F4A7C15 % 2 ** 64 >> 50
            out[at] = out.get(at, 0) + 1
    return out


def plain_mixture(p, n):
    w = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(LONG):
        shares = p * w
        w = (n[:, None] * shares / shares.sum(axis=1, keepdims=True)).sum(axis=0) / n.sum()
    return w, float((n * np.log((p * w).sum(axis=1))).sum())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_counts_equal_plain_counts(docs):
    for text in ["", "a", "Ünïcode und 日本語, ABC-def", *[r["text"] for r in docs.limit(20).collect()]]:
        counts = language_mixture.ngram_counts(text)
        assert {int(i): int(counts[i]) for i in np.flatnonzero(counts)} == plain_counts(text)


def test_model_equals_one_process(docs):
    rows = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] is not None]
    sums = {}
    for r in rows:
        if r["text"] is not None and any(x.isalpha() for x in r["text"]):
            mine = sums.setdefault(r["lang"], {})
            for cell, n in plain_counts(r["text"]).items():
                mine[cell] = mine.get(cell, 0) + n
    languages = sorted(sums)
    counts = np.zeros((len(languages), language_mixture.BUCKETS))
    for i, x in enumerate(languages):
        for cell, n in sums[x].items():
            counts[i, cell] = n
    model = language_mixture.Model(languages, counts)
    got = {r["doc_id"]: r for r in language_mixture.identify(docs).collect()}
    for r in docs.collect():
        lang, score, mixture = language_mixture.infer(model, r["text"])
        mine = got[r["doc_id"]]
        assert (mine["lang_pred"], mine["mixture"]) == (lang, mixture) and abs(mine["score"] - score) < 1e-9
        assert mine["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_sets_against_all_sets(docs):
    """The chosen set has the best penalised likelihood of all sets, its proportions those of a long run."""
    model = language_mixture.fit(docs)
    by = {}
    for r in docs.filter("length(text) > 600").orderBy("doc_id").collect():
        by.setdefault(r["lang"], r["text"])
    langs = [x for x in model.languages if x in by]
    assert len(langs) >= 3
    cases = [(by[a][:600],) for a in langs] + [(by[a][:600], by[b][:400]) for a, b in itertools.combinations(langs, 2)]
    cases += [tuple(by[x][:500] for x in langs[:3])]
    for case in cases:
        text = " ".join(case)
        n = language_mixture.ngram_counts(text)
        cells = np.flatnonzero(n)
        n, p = n[cells].astype(float), model.p[cells]
        worth = {}
        for k in range(1, 4):
            for chosen in itertools.combinations(range(len(model.languages)), k):
                w, likelihood = plain_mixture(p[:, chosen], n)
                worth[chosen] = likelihood - (k - 1) * language_mixture.PENALTY * math.log(n.sum()), w
        lang, score, mixture = language_mixture.infer(model, text)
        best = max(worth, key=lambda c: worth[c][0])
        assert tuple(sorted(model.languages.index(x) for x in mixture)) == best
        w = dict(zip(best, worth[best][1]))
        assert abs(score - max(w.values())) < 0.02
        assert model.languages.index(lang) == max(w, key=w.get)


def test_weights_against_gradient_descent():
    """One document of label 0: the pairs are known, so the loss can be minimised by another way."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4)) * [1, 5, 0.1, 2] + [3, 0, 1, -2]
    x[-1] = x[:-1].mean(axis=0) - [1, 4, 0.05, -1]
    y = np.array([1] * 59 + [0])
    model = quality_ranking.fit_pairs(x, y)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    d, w = z[:-1] - z[-1], np.zeros(4)
    for _ in range(60_000):
        w += 0.3 * ((d / (1 + np.exp(d @ w))[:, None]).mean(axis=0) - quality_ranking.RIDGE * w)
    assert np.abs(model.weights - w).max() < 1e-5


def test_cut_against_all_levels():
    rng = np.random.default_rng(6)
    y = np.array([0, 1] * 200)
    x = rng.normal(size=(400, 3)) + y[:, None] * [1.0, 0.5, 0.0]
    model = quality_ranking.fit_pairs(x, y)
    merit = [float(((row - model.centre) / model.scale) @ model.weights) for row in x]

    def rate(cut):
        right = [[m >= cut for m, label in zip(merit, y) if label == 1], [m < cut for m, label in zip(merit, y) if label == 0]]
        return sum(sum(r) / len(r) for r in right) / 2

    assert rate(model.cut) >= max(rate(float(np.quantile(merit, q / 200))) for q in range(1, 200)) - 1e-9
    score = model.score(x)
    assert all((s >= quality_ranking.CUT) == (m >= model.cut) for s, m in zip(score, merit))
    order = np.argsort(merit, kind="stable")
    assert (np.diff(score[order]) >= 0).all()


def test_scores_equal_one_process(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = sorted((r["doc_id"], r["quality"]) for r in labels.collect()
                   if r["quality"] in (0, 1) and r["doc_id"] in texts and zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0)
    rows = sorted((i, q, tuple(map(float, quality_ranking.measures(texts[i])))) for i, q in known)
    model = quality_ranking.fit_pairs(np.array([r[2] for r in rows]), np.array([r[1] for r in rows]))
    got = {r["doc_id"]: r for r in quality_ranking.rank(docs, labels).collect()}
    assert len(got) == len(texts)
    for i, text in texts.items():
        score = float(model.score(np.array([quality_ranking.measures(text)], float))[0])
        assert abs(got[i]["score"] - score) < 1e-9 and got[i]["predicted"] == int(score >= quality_ranking.CUT)


def plain_weights(x, y):
    """Newton steps on the listed pairs, every good row against every bad one."""
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    d, w = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, x.shape[1]), np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(d @ w))
        gradient = quality_ranking.RIDGE * w - (d * p[:, None]).mean(axis=0)
        curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + quality_ranking.RIDGE * np.eye(len(w))
        w = w - np.linalg.solve(curve, gradient)
    return w


@pytest.mark.parametrize("goods, bads, shift", [(80, 50, 0.5), (7, 200, 3.0), (1, 1, 1.0)])
def test_weights_of_all_pairs(goods, bads, shift):
    rng = np.random.default_rng(8)
    y = np.array([1] * goods + [0] * bads)
    x = rng.normal(size=(goods + bads, 5)) * [1, 9, 0.1, 2, 1] + shift * y[:, None]
    x[:, 4] = x[:, 3] ** 2
    assert np.abs(quality_ranking.fit_pairs(x, y).weights - plain_weights(x, y)).max() < 1e-8


def test_fit_takes_every_labelled_document(spark):
    """More than 20,000 documents of each label, many with equal measures; few are unlike the others."""
    docs = spark.range(60_000).selectExpr(
        "id AS doc_id", """concat(repeat(concat(substr(sha2(string(id), 256), 1, int(id % 9) + 1), ' the '), int(id % 13) + 1),
        CASE WHEN id % 500 = 1 THEN '## %% ||' WHEN id % 2 = 0 THEN 'End.' ELSE 'X' END) AS text""")
    labels = spark.range(60_000).selectExpr("id AS doc_id", "int((id + id DIV 7) % 2) AS quality")
    rows = [(r["text"], r["quality"], r["doc_id"]) for r in docs.join(labels, "doc_id").orderBy("doc_id").collect()]
    known = [(quality_ranking.measures(text), q) for text, q, i in rows if zlib.crc32(str(i).encode()) % 5 != 0]
    model = quality_ranking.fit_pairs(np.array([r[0] for r in known], float), np.array([r[1] for r in known]))
    got = {r["doc_id"]: r for r in quality_ranking.rank(docs, labels).collect()}
    assert min(np.bincount([q for _, q in known])) > 20_000 and len(got) == 60_000
    want = model.score(np.array([quality_ranking.measures(text) for text, _, _ in rows], float))
    assert max(abs(got[i]["score"] - s) for (_, _, i), s in zip(rows, want)) < 1e-9


def test_cut_of_equal_merits(spark):
    """Few different merits: the quantiles are read from counts, as from the sorted merits."""
    x = [[float(i % 3), float(i % 2)] for i in range(600)]
    y = [int(i % 3 + (i % 7 == 0) > 1) for i in range(600)]
    rows = spark.createDataFrame(list(zip(y, x)), "y int, x array<double>")
    model, plain = quality_ranking.fit(rows, 2), quality_ranking.fit_pairs(np.array(x), np.array(y))
    assert np.abs(model.weights - plain.weights).max() < 1e-9 and abs(model.cut - plain.cut) < 1e-9
    merit = plain.merit(np.array(x))
    cuts = np.quantile(merit, quality_ranking.LEVELS)
    rate = [((merit[np.array(y) == 1] >= c).mean() + (merit[np.array(y) == 0] < c).mean()) / 2 for c in cuts]
    assert abs(plain.cut - cuts[int(np.argmax(rate))]) < 1e-9

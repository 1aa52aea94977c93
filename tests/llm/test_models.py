"""Learned operators: held-out accuracy and awkward rows. Search: recall against brute force."""

import numpy as np

from distkpi.llm import collision_search, language_mixture, quality_ranking, queries

SF = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    got = queries.op1_language_mixture(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    m = got.merge(docs, on="doc_id")
    assert len(got) == len(docs)
    assert got.score.between(0, 1).all()
    out = m[m.held_out]
    assert len(out) > 100 and (out.lang == out.lang_pred).mean() >= 0.97


def test_mixture_of_two_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_mixture.fit(docs)
    by = {r["lang"]: r["text"] for r in docs.filter("n_chars BETWEEN 2000 AND 4000").select("lang", "text").collect()}
    lang, share, found = language_mixture.infer(model, by["de"][:2000] + " " + by["fr"][:1000])
    assert lang == "de" and 0.5 < share < 0.85 and found == ["de", "fr"]
    assert language_mixture.infer(model, by["es"])[2] == ["es"]


def test_language_awkward_rows(make_docs):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !? ²", None), (None, "hello there world", "en"), (4, "hello " * 400_000, None),
            (5, "bonjour à tous le monde", "fr"), (5, "bonjour à tous le monde", "fr"), (6, "日本語", None)]
    got = {(r["doc_id"], r["lang_pred"]) for r in language_mixture.identify(make_docs(rows)).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got and len(got) == 7
    assert language_mixture.identify(make_docs([])).count() == 0
    none = language_mixture.identify(make_docs([(1, "words here", None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in none] == [("und", 0.0)]


def test_long_texts_are_counted_in_blocks(monkeypatch):
    text = "Straße über die ñandú, and más words. " * 50
    whole = language_mixture.ngram_counts(text)
    monkeypatch.setattr(language_mixture, "BLOCK", 97)
    assert (language_mixture.ngram_counts(text) == whole).all()


def test_quality_of_held_out_documents(spark):
    got = queries.op7_quality_ranking(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()
    m = got.merge(labels, on="doc_id")
    good, bad = m[m.held_out & (m.quality == 1)], m[m.held_out & (m.quality == 0)]
    order = (good.score.to_numpy()[:, None] > bad.score.to_numpy()[None]).mean()
    assert order >= 0.95 and good.predicted.mean() >= 0.9 and bad.predicted.mean() <= 0.1


def test_quality_awkward_rows(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (None, "x"), (3, "word " * 300_000), (4, "fine text. Another line."), (4, "fine text.")])
    none = spark.createDataFrame([(1, None, 0), (99, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = quality_ranking.rank(docs, none).collect()
    assert len(got) == 6 and {(r["score"], r["predicted"]) for r in got} == {(0.5, 1)}
    both = spark.createDataFrame([(3, 0, 0), (4, 1, 0), (4, 1, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in quality_ranking.rank(docs, both, held_out=-1).collect()}
    assert got[4] > got[3]
    assert quality_ranking.rank(make_docs([]), both).count() == 0


def brute(ids, v, k=10):
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        out[int(ids[i])] = [(int(ids[x]), d[x]) for x in np.lexsort((ids, d)) if x != i][:k]
    return out


def test_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = table.toPandas()
    want = brute(pdf.vec_id.to_numpy(), np.array(pdf.embedding.tolist(), float))
    got = collision_search.nearest(table, table.vec_id % 100 == 0, block=300, query_block=7).toPandas()
    hits = 0
    for q, group in got.sort_values("rank").groupby("query_id"):
        assert list(group["rank"]) == list(range(1, len(group) + 1))
        exact = dict(want[q])
        hits += len(set(group.vec_id) & set(exact))
        assert all(abs(exact[i] - s) < 1e-12 for i, s in zip(group.vec_id, group.score) if i in exact)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_search_awkward_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (100, [1.0, 3.0]), (3, None), (4, [0.0, 0.0]),
            (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, []), (None, [1.0, 2.0]), (9, [1.0, 2.0, 3.0]),
            (200, [0.0, 0.0]), (300, [5.0, 5.0, 5.0])]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<float>, rank int, score string")
    got = sorted(tuple(r) for r in collision_search.nearest(table, table.vec_id % 100 == 0).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 100, 1.0), (100, 1, 0, 1.0), (100, 2, 1, 1.0), (100, 3, 2, 1.0),
                   (300, 1, 9, np.sqrt(16 + 9 + 4))]
    assert collision_search.nearest(table.limit(0), table.vec_id % 100 == 0).count() == 0


def test_search_verifies_few_vectors(spark):
    pdf = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    ids, vectors = pdf.vec_id.to_numpy(), np.array(pdf.embedding.tolist(), float)
    asks = ids % 100 == 0
    index = collision_search.Index(ids, vectors)
    got = index.search(ids[asks], vectors[asks], 10)
    assert index.verified < 0.4 * asks.sum() * len(ids)
    # A bound from elsewhere: nothing beyond it is looked for.
    again = collision_search.Index(ids, vectors)
    bounds = np.array([found[-1][0] for found in got])
    assert again.search(ids[asks], vectors[asks], 10, bounds) == got
    assert again.verified <= index.verified
    none = collision_search.Index(ids, vectors).search(ids[asks], vectors[asks], 10, np.zeros(asks.sum()))
    assert all(not found or found[0][0] > 0 for found in none)


def test_search_of_extreme_components(spark):
    rng = np.random.default_rng(3)
    for scale in (1.5e308, 1e-300, 1e200):
        vectors = rng.uniform(-0.9, 0.9, (60, 6)) * scale
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
        got = collision_search.nearest(table, table.vec_id % 20 == 0, k=5, block=25).collect()
        assert len(got) == 15 and not any(np.isnan(r["score"]) for r in got)
        exact = {q: collision_search.distances(vectors / scale, vectors[q] / scale) for q in (0, 20, 40)}
        hits = sum(r["vec_id"] in np.argsort(exact[r["query_id"]])[1:6] for r in got)
        assert hits >= 13
    # Small vectors beside huge ones, and many equal ones.
    rows = [(i, [1e308, float(i)]) for i in range(30)] + [(100 + i, [float(i), 1.0]) for i in range(30)] + [(200 + i, [7.0, 7.0]) for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = collision_search.nearest(table, table.vec_id.isin(100, 200), k=3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [
        (100, 101, 1.0), (100, 102, 2.0), (100, 103, 3.0), (200, 201, 0.0), (200, 202, 0.0), (200, 203, 0.0)]

"""Language identification by multilingual mixture inference.

A document is a mixture of languages: each of its n-grams was drawn from one
language, with unknown proportions. Expectation maximisation estimates the
proportions from the n-gram likelihoods of the learned languages, and the set
of languages is chosen by penalised likelihood: starting from the single most
likely language, the next language (by its proportion under all languages) is
added while the likelihood gains more than ``PENALTY * log(n-grams)``. The
predicted language is the largest proportion of the chosen set, the score that
proportion.

Features are byte trigrams of the lower-cased text over letters (other
characters are one separator), hashed into ``BUCKETS`` cells, so a model is a
table of ``languages x BUCKETS`` log-likelihoods whatever the corpus size.
Counts are summed over all training documents by Spark (a task sends one row
per language and cell it saw); only that table reaches the driver and goes
back to the tasks.

A null text or one without a letter gives ``und`` with score 0. With no
training document every text is ``und``. Rows come out as they went in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from distkpi.llm.common import crc_mod

BUCKETS = 1 << 14
PRIOR = 0.5          # added to every cell's count
PENALTY = 1.0        # per language, times log of the number of n-grams (one free proportion each)
ROUNDS = 30
TOLERANCE = 1e-4
BLOCK = 1 << 20      # bytes of a text looked at together

# Cell of a byte: 0 separator, 1-26 letters, then the bytes of other characters.
_CELL = np.zeros(256, np.int64)
_CELL[97:123] = np.arange(1, 27)
_CELL[128:] = np.arange(27, 155)


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed trigrams of a text; whole texts, in blocks that overlap by two bytes."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(1, len(data)), BLOCK):
        c = _CELL[data[max(0, at - 2):at + BLOCK]]
        if at == 0:
            c = np.concatenate([[0, 0], c])
        if at + BLOCK >= len(data):
            c = np.concatenate([c, [0]])
        code = (c[:-2] * 155 + c[1:-1]) * 155 + c[2:]
        code = code[(c[1:-1] > 0)]
        cell = (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)
        out += np.bincount(cell.astype(np.int64), minlength=BUCKETS)
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def count_table(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, cell, n over the documents with a language; summed within each task first."""
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for value, label in zip(batch.column(0), batch.column(1)):
                t = value.as_py()
                if has_letter(t):
                    key = label.as_py()
                    if key in sums:
                        sums[key] += ngram_counts(t)
                    else:
                        sums[key] = ngram_counts(t)
        for key, total in sums.items():
            cells = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(cells), pa.string()), pa.array(cells, pa.int64()),
                 pa.array(total[cells], pa.int64())], names=["lang", "cell", "n"])

    known = docs.filter(F.col(lang).isNotNull()).select(text, lang)
    return known.mapInArrow(run, "lang string, cell bigint, n bigint").groupBy("lang", "cell").agg(
        F.sum("n").alias("n"))


class Model:
    """Log-likelihoods of the cells by language, languages in code-point order."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + PRIOR
        self.p = (smooth / smooth.sum(axis=1, keepdims=True)).T.copy() if languages else None


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The model of all given documents; its table has at most languages x BUCKETS rows."""
    table = count_table(docs, text, lang).toPandas()
    languages = sorted(table["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    place = {x: i for i, x in enumerate(languages)}
    counts[table["lang"].map(place).to_numpy(int), table["cell"].to_numpy(int)] = table["n"].to_numpy()
    return Model(languages, counts)


def proportions(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Mixture proportions by expectation maximisation and the log-likelihood they reach."""
    k, total = p.shape[1], n.sum()
    if k == 1:
        return np.ones(1), float(n @ np.log(p[:, 0]))
    w = np.full(k, 1.0 / k)
    for _ in range(ROUNDS):
        new = w * (p.T @ (n / (p @ w))) / total
        done = np.abs(new - w).max() < TOLERANCE
        w = new
        if done:
            break
    return w, float(n @ np.log(p @ w))


def infer(model: Model, text: str | None) -> tuple[str, float, list[str]]:
    """Predicted language, its proportion, and the chosen set, largest proportion first."""
    if not model.languages or not has_letter(text):
        return "und", 0.0, []
    counts = ngram_counts(text)
    cells = np.flatnonzero(counts)
    n, p = counts[cells].astype(float), model.p[cells]
    if len(model.languages) == 1:
        return model.languages[0], 1.0, model.languages
    full, _ = proportions(p, n)
    by_share = np.argsort(-full, kind="stable")
    alone = n @ np.log(p)
    chosen = [int(np.argmax(alone))]
    best = float(alone[chosen[0]])
    w = np.ones(1)
    for more in by_share:
        if more in chosen:
            continue
        trial = [*chosen, int(more)]
        weights, likelihood = proportions(p[:, trial], n)
        if likelihood - best <= PENALTY * np.log(n.sum()):
            break
        chosen, w, best = trial, weights, likelihood
    top = int(np.argmax(w))
    order = np.argsort(-w, kind="stable")
    return model.languages[chosen[top]], float(min(1.0, w[top])), [model.languages[chosen[i]] for i in order]


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and all languages of the mixture."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}["doc_id"]

    def run(batches):
        for batch in batches:
            found = [infer(sent.value, x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64()),
                 pa.array([f[2] for f in found], pa.list_(pa.string()))],
                names=["doc_id", "lang_pred", "score", "mixture"])

    return docs.select("doc_id", text).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, mixture array<string>")


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """Learn from the documents outside the held-out fold, predict all."""
    model = fit(docs.filter(crc_mod(F.col("doc_id"), folds) != held_out))
    return predict(docs, model).select(
        "doc_id", (crc_mod(F.col("doc_id"), folds) == held_out).alias("held_out"),
        "lang_pred", "score", "mixture")

"""Quality classifier by Bradley-Terry pairwise ranking.

A document's merit is a linear function of its measures; that one document is
preferred to another has the probability ``1 / (1 + exp(merit_b - merit_a))``.
The weights minimise the logistic loss over all preference pairs (every
document of label 1 against every one of label 0). The merits of the labelled
documents are then cut at a quantile: the one, of ``LEVELS``, that separates
the labels best (mean of both classes' accuracies). The score is a logistic
function of the merit that is exactly ``CUT`` at that quantile.

Measures of all documents come from one pass over the whole texts. The model
is fitted on all labelled documents outside the held-out fold, in a pass over
their measures per Newton step. Pairs are not listed: what a document adds to
their sums is a smooth function of the other one's merit, so the documents of
each label are added up at ``NODES`` Chebyshev points per ``WIDTH`` of merit
(:func:`spread`), and the sums over pairs follow from those points to double
precision (:func:`pair_sums`). The quantiles are exact order statistics. Only
sums per point, and the merits at the quantiles, reach the driver.

Null texts have the measures of the empty text. Labels that are null or whose
document is missing are ignored; with several labels of one document each one
counts. Without documents of both labels every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from distkpi.llm.common import crc_mod, discard, materialize, prefix_sums
from distkpi.llm.quality_rules import STOP_WORDS

RIDGE = 1e-2
STEPS = 30
# The logistic function has its poles pi off the axis: interpolation at so many
# points errs by less than 1e-15.
WIDTH, NODES = 2.0, 20
CELLS = 1000         # cells that a task holds at once
LEVELS = np.arange(0.005, 1.0, 0.005)
CUT = 0.3

_STOP = frozenset(w.encode() for w in STOP_WORDS)
_EDGE = b".,;:!?"

MEASURES = ("log_words", "mean_length", "upper", "digits", "symbols", "marks", "ends", "beyond_ascii",
            "distinct_words", "top_word", "repeated_lines", "repeated_fours", "short_words", "long_words",
            "stop_words", "lines", "bare_lines", "title_words", "pipes", "distinct_bytes",
            "few_words", "much_repeated", "many_symbols", "few_stop_words")


def measures(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8", "replace")
    size = max(1, len(data))
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    n = max(1, len(words))
    lower = data.lower().split()
    seen: dict[bytes, int] = {}
    for w in lower:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    # Two windows of four words are compared by the hash of the tuple, within one document only.
    fours = list(zip(lower, lower[1:], lower[2:], lower[3:]))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    stop = sum(c for w, c in seen.items() if w.strip(_EDGE) in _STOP) / n
    symbols = sum(int(count[ord(c)]) for c in "#*$%&<>|{}[]~^_=@") / n
    repeated = 1 - len(set(fours)) / len(fours) if fours else 0.0
    letters = max(1, int(count[65:91].sum() + count[97:123].sum()))
    ends = sum(int(count[ord(c)]) for c in ".?") / n
    return [np.log1p(len(words)), lengths.mean() / 10 if len(words) else 0.0,
            count[65:91].sum() / letters, min(1.0, count[48:58].sum() / size * 5), min(3.0, symbols),
            min(2.0, count[33] / n), min(1.0, ends), count[128:].sum() / size,
            len(seen) / n, max(seen.values(), default=0) / n,
            1 - len(set(lines)) / max(1, len(lines)), repeated,
            float((lengths <= 3).sum()) / n, float((lengths >= 12).sum()) / n, stop,
            min(1.0, len(lines) / n), sum(not x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / max(1, len(lines)),
            sum(w[:1].isupper() for w in words) / n, min(2.0, int(count[124]) / n),
            float((count > 0).sum()) / 100,
            float(len(words) < 20), float(repeated > 0.3), float(symbols > 0.2), float(stop < 0.05)]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and its measures, one row per row of ``docs``."""
    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}["doc_id"]

    def run(batches):
        for batch in batches:
            rows = [np.asarray(measures(x.as_py()), float) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, x array<double>")


class Model:
    def __init__(self, centre, scale, weights, cut):
        self.centre, self.scale, self.weights, self.cut = centre, scale, weights, cut

    def merit(self, x: np.ndarray) -> np.ndarray:
        # Summed row by row: equal measures have equal merits, whatever rows are beside them.
        return ((x - self.centre) / self.scale * self.weights).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Rises with the merit; ``CUT`` at the chosen quantile."""
        if self.weights is None:
            return np.full(len(x), 0.5)
        z = np.clip(self.merit(x) - self.cut, -30, 30) + np.log(CUT / (1 - CUT))
        out = 1 / (1 + np.exp(-z))
        return np.where(self.merit(x) >= self.cut, np.maximum(out, CUT), np.minimum(out, np.nextafter(CUT, 0)))


_POINTS = np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)
# Chebyshev polynomials at a merit, times this: the Lagrange basis of the points there.
_TO_POINTS = np.polynomial.chebyshev.chebvander(_POINTS, NODES - 1).T * np.where(np.arange(NODES) == 0, 1, 2)[:, None] / NODES


def spread(z: np.ndarray, merit: np.ndarray):
    """Rows added up at the points of their merit's cell: yields the cell, and per point
    the sums of 1, the measures, and their products (upper triangle)."""
    cell = np.floor(merit / WIDTH).astype(np.int64)
    upper = np.triu_indices(z.shape[1])
    for c in np.unique(cell):
        rows = z[cell == c]
        basis = np.polynomial.chebyshev.chebvander(2 * (merit[cell == c] / WIDTH - c) - 1, NODES - 1) @ _TO_POINTS
        yield int(c), basis.T @ np.hstack([np.ones((len(rows), 1)), rows, rows[:, upper[0]] * rows[:, upper[1]]])


def pair_sums(good: dict, bad: dict, w: np.ndarray):
    """Mean loss over all pairs, its gradient and its curvature, with the ridge; ``good`` and
    ``bad`` have the sums of :func:`spread` by cell."""
    size = len(w)
    upper = np.triu_indices(size)
    at = (_POINTS + 1) / 2
    b_merit = np.concatenate([(c + at) * WIDTH for c in bad])
    b_sums = np.concatenate(list(bad.values()))
    b_n, b_x = b_sums[:, 0], b_sums[:, 1:1 + size]
    loss, slope, cross, square = 0.0, np.zeros(size), np.zeros((size, size)), np.zeros(len(upper[0]))
    b_wrong, b_curve, pairs = np.zeros(len(b_n)), np.zeros(len(b_n)), 0.0
    for c, g_sums in good.items():
        g_n, g_x = g_sums[:, 0], g_sums[:, 1:1 + size]
        lead = ((c + at) * WIDTH)[:, None] - b_merit[None]
        wrong = 1 / (1 + np.exp(np.clip(lead, -700, 700)))       # probability of the wrong order
        curve = wrong * (1 - wrong)
        loss += g_n @ np.logaddexp(0, -lead) @ b_n
        slope += (wrong @ b_n) @ g_x
        square += (curve @ b_n) @ g_sums[:, 1 + size:]
        cross += g_x.T @ curve @ b_x
        b_wrong += g_n @ wrong
        b_curve += g_n @ curve
        pairs += g_n.sum() * b_n.sum()
    slope -= b_wrong @ b_x
    square += b_curve @ b_sums[:, 1 + size:]
    whole = np.zeros((size, size))
    whole[upper] = square
    whole = whole + np.triu(whole, 1).T - cross - cross.T
    return (loss / pairs + RIDGE / 2 * w @ w, RIDGE * w - slope / pairs, whole / pairs + RIDGE * np.eye(size))


def newton(sums, size: int) -> np.ndarray:
    """Weights of least loss; ``sums`` gives the sums of both labels at given weights. A step that
    raises the loss is halved."""
    w = kept = np.zeros(size)
    least, step = np.inf, np.zeros(size)
    for _ in range(STEPS):
        loss, gradient, curve = pair_sums(*sums(w), w)
        if loss > least + 1e-12:
            step = step / 2
        else:
            least, kept, step = loss, w, -np.linalg.solve(curve, gradient)
        w = kept + step
        if np.abs(step).max() < 1e-8:
            return np.round(w, 10)       # beyond the noise of the order of summation
    return np.round(kept, 10)


def standard(centre, scale) -> tuple[np.ndarray, np.ndarray]:
    scale = np.round(np.asarray(scale, float), 12)
    return np.round(np.asarray(centre, float), 12), np.where(scale < 1e-9, 1.0, scale)


def ranks(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank below each level's quantile of ``n`` merits, and how far it is on the way to the next rank."""
    at = LEVELS * (n - 1)
    return np.floor(at).astype(np.int64), at - np.floor(at)


def best_cut(value, bad, good, bad_below, good_below, bads: int, goods: int) -> float:
    """The quantile that separates best. Rows: different merits, ascending, with the documents of
    each label that have it and that are below it; only merits at :func:`ranks` or the ranks after are needed."""
    low, way = ranks(bads + goods)
    end = bad + good + bad_below + good_below
    i = np.searchsorted(end, low, side="right")
    j = np.searchsorted(end, np.minimum(low + 1, bads + goods - 1), side="right")
    cut = value[i] + way * (value[j] - value[i])
    past = cut > value[i]                # the merit at the lower rank is below the cut
    right = (goods - good_below[i] - past * good[i]) / goods + (bad_below[i] + past * bad[i]) / bads
    return float(cut[int(np.argmax(right))])


def fit_pairs(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of labelled measures, in one process; :func:`fit` does the same on a table."""
    good, bad = (y == 1).sum(), (y == 0).sum()
    if not good or not bad:
        return Model(None, None, None, None)
    model = Model(*standard(x.mean(axis=0), x.std(axis=0)), np.zeros(x.shape[1]), 0.0)
    z = (x - model.centre) / model.scale

    def sums(w):
        merit = (z * w).sum(axis=1)
        return tuple(dict(spread(z[y == label], merit[y == label])) for label in (1, 0))

    model.weights = newton(sums, x.shape[1])
    value, place = np.unique(model.merit(x), return_inverse=True)
    count = [np.bincount(place[y == label], minlength=len(value)) for label in (0, 1)]
    model.cut = best_cut(value, *count, *(np.cumsum(c) - c for c in count), bad, good)
    return model


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def fit(rows: DataFrame, size: int = len(MEASURES)) -> Model:
    """The model of a written table (y, x) of labelled measures, all of its rows."""
    first = rows.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1),
                     *[f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(size)]).first()
    bad, good = first[:2]
    if not good or not bad:
        return Model(None, None, None, None)
    model = Model(*standard(first[2:2 + size], first[2 + size:]), np.zeros(size), 0.0)

    def sums(w):
        def add(batches):
            held = {}

            def rows_of():
                keys = [(y, c, k) for y, c in held for k in range(NODES)]
                return pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(zip(*keys), (pa.int32(), pa.int64(), pa.int32()))]
                    + [pa.array(list(np.concatenate(list(held.values()))), pa.list_(pa.float64()))],
                    names=["y", "cell", "node", "v"])

            for batch in batches:
                if not batch.num_rows:
                    continue
                y, z = batch.column(0).to_numpy(), (_matrix(batch.column(1)) - model.centre) / model.scale
                merit = (z * w).sum(axis=1)
                for label in (0, 1):
                    for c, v in spread(z[y == label], merit[y == label]):
                        held[label, c] = held.get((label, c), 0) + v
                if len(held) > CELLS:
                    yield rows_of()
                    held.clear()
            if held:
                yield rows_of()

        def total(table: pa.Table) -> pa.Table:
            v = np.sort(_matrix(table["v"].combine_chunks()), axis=0).sum(axis=0)
            return table.slice(0, 1).set_column(3, "v", pa.array([v], pa.list_(pa.float64())))

        kind = "y int, cell bigint, node int, v array<double>"
        found = rows.select("y", "x").mapInArrow(add, kind).groupBy("y", "cell", "node").applyInArrow(total, kind).toArrow()
        y, cell, node = (found[name].to_numpy() for name in ("y", "cell", "node"))
        v = _matrix(found["v"].combine_chunks())
        out = {1: {}, 0: {}}
        for i in np.lexsort((node, cell, y)):
            out[y[i]].setdefault(int(cell[i]), []).append(v[i])
        return tuple({c: np.array(per) for c, per in out[label].items()} for label in (1, 0))

    model.weights = newton(sums, size)
    model.cut = _cut(rows, model, bad, good)
    return model


def _cut(rows: DataFrame, model: Model, bad: int, good: int) -> float:
    """:func:`best_cut` from running counts of the merits, by ranges of merit."""
    def merits(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(model.merit(_matrix(batch.column(1))))], names=["y", "merit"])

    counts = rows.select("y", "x").mapInArrow(merits, "y int, merit double").groupBy("merit").agg(
        F.count_if(F.col("y") == 0).alias("bad"), F.count_if(F.col("y") == 1).alias("good"))
    ranged = materialize(counts.repartitionByRange("merit").withColumn("range", F.spark_partition_id()), "quality-merits")
    low, _ = ranks(bad + good)
    wanted = np.union1d(low, np.minimum(low + 1, bad + good - 1))

    def at_ranks(batches):
        for batch in batches:
            _, n0, n1, below0, below1 = (column.to_numpy() for column in batch.columns)
            start = below0 + below1
            hit = np.searchsorted(wanted, start) < np.searchsorted(wanted, start + n0 + n1)
            yield batch.filter(pa.array(hit))

    running = prefix_sums(ranged, [], "range", [F.col("merit")], {"bad_below": "bad", "good_below": "good"})
    found = running.select("merit", "bad", "good", "bad_below", "good_below").mapInArrow(
        at_ranks, "merit double, bad bigint, good bigint, bad_below bigint, good_below bigint").toArrow().sort_by("merit")
    discard(ranged)
    return best_cut(*(column.to_numpy() for column in found.columns), bad, good)


def labelled(features: DataFrame, labels: DataFrame, folds: int, held_out: int) -> DataFrame:
    """y, x of the labelled documents outside the held-out fold."""
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").filter(
        crc_mod(F.col("doc_id"), folds) != held_out).select(
        F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("y"))
    return features.join(known, F.col("doc_id") == F.col("_id")).select("y", "x")


def rank(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    features = materialize(measured(docs), "quality-measures")
    rows = materialize(labelled(features, labels, folds, held_out), "quality-labelled")
    model = fit(rows)
    discard(rows)
    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}["doc_id"]

    def run(batches):
        for batch in batches:
            values = np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, len(MEASURES))
            score = model.score(values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= CUT).astype(np.int32))],
                names=["doc_id", "score", "predicted"])

    scored = features.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), folds) == held_out).alias("held_out"),
                         "score", "predicted")

"""Quality rules: a threshold table compiled into Spark column expressions.

Every measure is a built-in expression of one document, so the whole operator
is a projection: no shuffle, no user function, nothing leaves the row. Ratios
are compared in integers (``1000 * numerator`` against ``permille *
denominator``), so a value on a threshold decides the same way everywhere.

Null, empty and blank texts have no words and fail the base rule. Repeated
rows and rows with a null id are judged like any other; one row comes out per
row that goes in. Columns of the input are never overwritten: the measures are
computed under reserved names and only the asked-for ones are returned.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from distkpi.llm.common import SPACE_RUN, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Function words of the languages the corpus is known to hold; a fixed list of
# a rule, extended per deployment.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "was", "for", "on", "it",
    "der", "die", "das", "und", "zu", "den", "mit", "von", "ist", "ein", "eine", "auf", "im",
    "le", "la", "les", "de", "des", "et", "un", "une", "dans", "que", "en", "sur", "est", "du",
    "el", "los", "las", "y", "por", "con", "para", "del", "al", "se", "su", "como",
)


class Rule(NamedTuple):
    """``low <= 1000 * numerator / denominator <= high``; None leaves a side open."""

    name: str
    numerator: str
    denominator: str
    low: int | None
    high: int | None


#: Ratios in thousandths. A zero denominator passes (the base rule rejects it).
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2000, 15000),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 100),
    Rule("stop_words_per_word", "n_stop_words", "n_words", 10, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 400),
    Rule("shouted_words", "n_marked_words", "n_words", None, 300),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_stop_words", "n_marked_words")


def compile_rules(rules: tuple[Rule, ...], col) -> Column:
    """The table as one boolean column; ``col`` maps a measure's name to its column."""
    tests = []
    for r in rules:
        scaled = 1000 * col(r.numerator).cast("long")
        if r.low is not None:
            tests.append(scaled >= r.low * col(r.denominator))
        if r.high is not None:
            tests.append(scaled <= r.high * col(r.denominator))
    return reduce(Column.__and__, tests, F.lit(True))


def _repeated(df: DataFrame) -> DataFrame:
    """Adds ``_n_repeat_words`` from ``_words``.

    Windows are compared by hash first; only documents in which a hash occurs
    twice sort their windows (hash, words, position), where the words decide.
    """
    last = F.size("_words") - WINDOW
    none = F.expr("CAST(array() AS array<bigint>)")
    df = df.withColumn("_hash", F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice("_words", i + 1, WINDOW))))
        .otherwise(none))
    df = df.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_hash")) < F.size("_hash"),
        F.sort_array(F.transform("_hash", lambda h, i: F.struct(
            h.alias("h"), F.slice("_words", i + 1, WINDOW).alias("w"), i.alias("p"))))))

    def same(x: Column, j: Column) -> Column:
        y = F.get("_sorted", j)
        return F.coalesce((x["h"] == y["h"]) & (x["w"] == y["w"]), F.lit(False))

    df = df.withColumn("_at", F.sort_array(F.transform(
        F.filter("_sorted", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"])))
    covered = F.aggregate(
        "_at", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + WINDOW).alias("end"),
                              (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n")),
        lambda a: a["n"])
    return df.withColumn("_n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``_q`` of all measures and both verdicts."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                     F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    df = df.withColumn("_words", words(F.col("_text")))
    df = _repeated(df)
    bare = reduce(lambda c, s: F.replace(c, F.lit(s), F.lit("")), SYMBOLS, F.col("_text"))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"),
                                          lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    plain = [F.size("_words").cast("long").alias("n_words"),
             F.length(F.regexp_replace("_text", SPACE_RUN, "")).cast("long").alias("word_chars"),
             (F.length("_text") - F.length(bare)).cast("long").alias("n_symbols"),
             (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
             F.col("_n_repeat_words").alias("n_repeat_words"),
             F.size("_lines").cast("long").alias("n_lines"),
             F.size(F.filter("_words", lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?")))
                             .isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
             F.size(F.filter("_words", lambda w: w.endswith("!!"))).cast("long")
             .alias("n_marked_words")]
    df = df.select("_row", F.struct(*plain).alias("_m"))

    def m(name: str) -> Column:
        return F.col(f"_m.{name}")

    base = (m("n_words") < MIN_WORDS) | \
        (100 * m("n_repeat_words") > MAX_REPEAT_PERCENT * m("n_words"))
    return df.select("_row", "_m", base.alias("_base_failed"),
                     (~base & compile_rules(RULES, m)).alias("_kept"))


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, the measures, base_failed, kept."""
    return measure(docs, text).select(
        "_row.doc_id", *[f"_m.{x}" for x in MEASURES[:5]],
        F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"),
        *[f"_m.{x}" for x in MEASURES[5:]])


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, unchanged.

    The row number keeps the optimizer from moving the filter below the measures, where the
    verdict's whole expression would be written out again for every use of a measure.
    """
    judged = measure(docs, text).select("_row", "_kept", F.monotonically_increasing_id().alias("_n"))
    return judged.filter("_kept AND _n >= 0").select("_row.*")


def oracle(table: str = "documents") -> str:
    """DuckDB SQL of :func:`quality_rules`."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    tests = []
    for r in RULES:
        if r.low is not None:
            tests.append(f"1000 * {r.numerator} >= {r.low} * {r.denominator}")
        if r.high is not None:
            tests.append(f"1000 * {r.numerator} <= {r.high} * {r.denominator}")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {table}),
w AS (SELECT rid, doc_id, t,
             list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
      FROM d),
win AS (SELECT rid, p, ws[p:p + {WINDOW - 1}] AS v
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS p FROM w WHERE len(ws) >= {WINDOW})),
rep AS (SELECT rid, count(DISTINCT q) AS n
        FROM (SELECT rid, unnest(range(p, p + {WINDOW})) AS q
              FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, v) AS c FROM win) WHERE c > 1)
        GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
             length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
             len(list_filter(ws, lambda x: lower(rtrim(x, '.,;:!?')) IN ({stop})))::BIGINT AS n_stop_words,
             len(list_filter(ws, lambda x: x LIKE '%!!'))::BIGINT AS n_marked_words
      FROM w LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed
      FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(tests)} AS kept, n_lines, n_stop_words, n_marked_words
FROM b"""

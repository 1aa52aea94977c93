"""Secret scans: an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. The
ledger is a Parquet table of one row per (blob, rule, rule version) scanned,
with the spans found. A scan

1. lists the distinct (blob, rule, version) pairs of the given versions that
   the ledger does not hold,
2. reads the text of one copy of each unseen blob and runs only the rules
   that are new for it,
3. appends the findings, and joins those of all blobs back to every path.

Copies are therefore scanned once, and a second scan with the same rules
scans nothing. Only built-in functions run: positions come from the lengths
of the pieces between matches (``split``) and of the matches themselves
(``regexp_extract_all``), so there is no user function on any path.

Null texts are empty blobs. Repeated rows and null ids come out as they went
in. Spans are code points, end exclusive; of spans with one start the kind
listed first comes first. Texts of any length are scanned whole. Extra columns
keep their names and values. An empty table gives no rows and adds nothing to
the ledger. Two scans at once may both add a pair: it counts once.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int>>"


class Rule(NamedTuple):
    """``least`` code points of group ``group`` are needed for a match to count."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = ("(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|" +
           _any_case("api") + "_?" + _any_case("key") +
           r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")

#: A private key starts at its header. It ends at its END line, if that is the next line with five
#: hyphens; else after the header lines of an encrypted key, the lines up to the last run of 16
#: base64 characters with nothing but base64, white space, escapes and quote marks before it, and
#: one shorter line. Every repetition is of a single character class, so a key of any length is
#: found whole without a deep stack.
_PEM_HEADER = "-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
_PEM_END = r"^[\s\S]*?-{5,}(END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----)?"
_PEM_FIELD = r"[\s\\]+[A-Za-z][A-Za-z0-9-]*:\x20?[^\s\\]+"
_PEM_BODY = r"""^[A-Za-z0-9+/=\s\\"',>#|*]*[A-Za-z0-9+/=]{16}(?:[\s\\"',>#|*]+[A-Za-z0-9+/=]{1,15})?"""

#: The order is the tie-break of spans with the same start.
RULES = (
    Rule("assign", 1, _ASSIGN, 2, 8),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", 1, "[0-9a-f]+", 0, 32),
    Rule("pem", 3, _PEM_HEADER, 0, 1),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("login_url", 1, r"[a-z][a-z0-9+]*://[A-Za-z0-9._%-]+:[A-Za-z0-9._%-]+@[A-Za-z0-9.-]+", 0, 1),
)
BASE = ("assign", "access", "hex")

#: A cheap test that every text with a counting match passes.
_HINT = {"hex": "[0-9a-f]{32}", "access": "AKIA[A-Z0-9]{12}"}


def _key_tail(after: Column) -> Column:
    """Code points of a private key that follow its header, in the text up to the next header."""
    # Header fields one after the other, then the rest as one match.
    fields = F.filter(F.regexp_extract_all(after, F.lit(_PEM_FIELD + r"|[\s\S]+"), F.lit(0)),
                      lambda x: x.rlike(rf"^(?:{_PEM_FIELD})\z"))
    skipped = F.aggregate(fields, F.lit(0), lambda n, x: n + F.length(x))
    body = F.length(F.regexp_extract(F.substr(after, skipped + 1), _PEM_BODY, 0))
    return (F.when(F.regexp_extract(after, _PEM_END, 1) != "", F.length(F.regexp_extract(after, _PEM_END, 0)))
            .when(body > 0, skipped + body).otherwise(0))


def spans(text: Column, rule: Rule) -> Column:
    """Leftmost non-overlapping matches of a rule, those too short dropped."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern),
                                                             F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    # A private key reaches into the text after its header; the next gap counts from the header.
    tail = F.transform(F.slice(between, 2, F.size(between)), _key_tail) if rule.kind == "pem" else F.transform(
        whole, lambda x: F.lit(0))
    lengths = F.arrays_zip(
        F.transform(between, lambda x: F.length(x)).alias("gap"),
        F.transform(whole, lambda x: F.length(x)).alias("own"),
        F.transform(part, lambda x: F.length(x)).alias("part"), tail.alias("tail"))
    empty = F.expr(f"CAST(array() AS {SPAN})")
    found = F.aggregate(
        lengths, F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + F.coalesce(x["own"], F.lit(0))).alias("at"),
            F.when(x["part"] >= rule.least, F.concat(a["out"], F.array(F.struct(
                (a["at"] + x["gap"]).alias("start"),
                (a["at"] + x["gap"] + x["own"] + x["tail"]).alias("end")))))
            .otherwise(a["out"]).alias("out")),
        lambda a: a["out"])
    hint = _HINT.get(rule.kind, rule.pattern)
    return F.when(text.rlike(hint), found).otherwise(empty)


def _ledger(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:  # a ledger that was never written
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def scan(versions: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES,
         text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Scan the unseen (blob, rule version) pairs of ``versions`` and append them to the ledger.

    Returns the rows of ``versions`` (the columns ``keep``; all by default) with
    their blob address (``_row``, ``_blob``) and the ledger after the scan:
    ``blob, kind, version, spans``.
    """
    spark = versions.sparkSession
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    addressed = versions.select(F.struct(*[F.col(f"`{c}`") for c in keep or versions.columns]).alias("_row"),
                                F.sha2(body, 256).alias("_blob"))
    blobs = versions.select(F.sha2(body, 256).alias("blob"), body.alias("body"))
    seen = _ledger(spark, ledger_path)
    if seen is None:
        blobs = blobs.withColumn("known", F.expr("CAST(array() AS array<string>)"))
    else:
        # Only the blobs at hand are looked up, whatever the ledger holds.
        seen = seen.join(blobs.select("blob").distinct(), "blob", "left_semi")
        known = seen.groupBy("blob").agg(F.collect_set(
            F.concat_ws("@", "kind", F.col("version").cast("string"))).alias("known"))
        blobs = blobs.join(known, "blob", "left").withColumn(
            "known", F.coalesce("known", F.expr("CAST(array() AS array<string>)")))
    todo = F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])
    unseen = (blobs.filter(F.size(F.array_except(todo, F.col("known"))) > 0)
              .groupBy("blob").agg(F.first("body").alias("body"), F.first("known").alias("known")))
    found = unseen.select("blob", F.inline(F.array(*[F.struct(
        F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"),
        F.array_contains("known", f"{r.kind}@{r.version}").alias("old"),
        F.when(F.array_contains("known", f"{r.kind}@{r.version}"), F.expr(f"CAST(array() AS {SPAN})"))
        .otherwise(spans(F.col("body"), r)).alias("spans")) for r in rules])))
    found.filter(~F.col("old")).drop("old").write.mode("append").parquet(ledger_path)
    return addressed, spark.read.parquet(ledger_path)


def _merged(ledger: DataFrame, rules) -> DataFrame:
    """Findings of the current rule versions, one row per blob that has any."""
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    current = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    hits = (ledger.filter((F.size("spans") > 0) & F.col("kind").isin(*[r.kind for r in rules]))
            .filter(F.col("version") == current[F.col("kind")]))
    each = F.transform("spans", lambda s: F.struct(s["start"].alias("start"),
                                                   rank[F.col("kind")].alias("rank"),
                                                   s["end"].alias("end"), F.col("kind").alias("kind")))
    # A blob has a row per rule and scan; two scans at once may both add a pair, and agree on it.
    return hits.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(each)))).alias("_hits"))


def find(versions: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES,
         text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows of ``versions`` (``_row``) with ``_hits``: start, rank, end, kind of all findings in order."""
    addressed, ledger = scan(versions, ledger_path, rules, text, keep)
    empty = F.expr("CAST(array() AS array<struct<start:int,rank:int,end:int,kind:string>>)")
    return addressed.join(_merged(ledger, rules), F.col("_blob") == F.col("blob"), "left").select(
        "_row", F.coalesce("_hits", empty).alias("_hits"))


def _joined(hits: Column) -> Column:
    return F.array_join(F.transform(hits, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans."""
    df = find(docs, ledger_path, rules, keep=["doc_id"])

    def n(kind: str) -> Column:
        return F.size(F.filter("_hits", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("_hits", lambda s: s["kind"].isin(*BASE))
    return df.select("_row.doc_id", *[n(k) for k in BASE],
                     F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("_hits")).alias("spans"))


def redact(docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES,
           text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding replaced by ``mark``; overlapping findings become one."""
    df = find(docs, ledger_path, rules, text)
    body = F.col(f"_row.`{text}`")
    cut = F.aggregate(
        "_hits", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when((s["start"] >= a["at"]), F.concat(
                a["out"], F.substring(body, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)))
            .otherwise(a["out"]).alias("out")),
        lambda a: F.concat(a["out"], F.substring(body, a["at"] + 1, F.length(body))))
    clean = F.when(F.size("_hits") > 0, cut).otherwise(body)
    return df.select(*[clean.alias(c) if c == text else F.col(f"_row.`{c}`") for c in docs.columns])


def oracle(table: str = "documents", rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL of :func:`secret_spans`."""
    def quoted(pattern: str) -> str:
        return pattern.replace("'", "''")

    parts = []
    for i, r in enumerate(rules):
        pat = quoted(r.pattern)
        if r.kind == "pem":
            parts.append(f"""
SELECT rid, {i} AS rank, 'pem' AS kind, k,
       list_sum(list_transform(gap[:k], lambda x: length(x))) + coalesce(list_sum(list_transform(own[:k - 1], lambda x: length(x))), 0) AS s,
       length(own[k]) + CASE WHEN regexp_extract(a, '{quoted(_PEM_END)}', 1) <> '' THEN length(regexp_extract(a, '{quoted(_PEM_END)}', 0))
                             WHEN b <> '' THEN h + length(b) ELSE 0 END AS n, 1 AS p, 1 AS least
FROM (SELECT *, regexp_extract(substr(a, h::BIGINT + 1), '{quoted(_PEM_BODY)}', 0) AS b
      FROM (SELECT *, coalesce(list_sum(list_transform(list_filter(regexp_extract_all(a, '{quoted(_PEM_FIELD)}|[\\s\\S]+'),
                     lambda x: regexp_full_match(x, '{quoted(_PEM_FIELD)}')), lambda x: length(x))), 0) AS h
            FROM (SELECT *, gap[k + 1] AS a
                  FROM (SELECT rid, unnest(range(1, len(own) + 1)) AS k, own, gap
                        FROM (SELECT rid, regexp_extract_all(t, '{pat}') AS own, regexp_split_to_array(t, '{pat}') AS gap
                              FROM d WHERE regexp_matches(t, '{pat}'))))))""")
            continue
        parts.append(f"""
SELECT rid, {i} AS rank, '{r.kind}' AS kind, k,
       list_sum(list_transform(gap[:k], lambda x: length(x))) + coalesce(list_sum(list_transform(own[:k - 1], lambda x: length(x))), 0) AS s,
       length(own[k]) AS n, length(part[k]) AS p, {r.least} AS least
FROM (SELECT rid, unnest(range(1, len(own) + 1)) AS k, own, part, gap
      FROM (SELECT rid, regexp_extract_all(t, '{pat}') AS own, regexp_extract_all(t, '{pat}', {r.group}) AS part,
                   regexp_split_to_array(t, '{pat}') AS gap
            FROM d WHERE regexp_matches(t, '{pat}')))""")
    base = ", ".join(f"'{k}'" for k in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {table}),
m AS ({' UNION ALL '.join(parts)}),
f AS (SELECT rid, rank, kind, s, kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT AS v FROM m WHERE p >= least),
g AS (SELECT rid, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
             string_agg(v, ',' ORDER BY s, rank) FILTER (kind IN ({base})) AS b,
             string_agg(v, ',' ORDER BY s, rank) AS a
      FROM f GROUP BY rid)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)},
       sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM d LEFT JOIN g USING (rid)"""

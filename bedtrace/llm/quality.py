"""Quality rules with risk-controlled thresholds, in DataFrame expressions only.

Each rule compares a measure of a text with a cutoff. The cutoffs are not guessed: labelled documents of good quality
are a holdout, and for each stratum (language) the strictest setting of all rules together is taken whose false
rejections stay, with high confidence, below a risk. The settings form one fixed path: each step tightens one rule, from
the loosest cutoffs of all rules to the strictest ones, so a document that fails at a step fails at all later ones and
the joint rejections can only grow. The steps are tested in this order, each at the full level of the stratum, up to the
first that is not proven: with n good documents of which k fail by then, a step is proven when
P(Binomial(n, risk) <= k) <= error / strata, an exact bound. Testing in a fixed order needs no division by the number of
steps, and counting joint rejections none of the risk by the number of rules; only the strata share the error, so the
statement holds for all of them at once. A stratum with too few labels gets no cutoff, so nothing is rejected there: the
first step needs ln(error / strata) / ln(1 - risk) good labels, 144 for four strata at the default levels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bedtrace.llm.common import documents, labels
from bedtrace.session import cut_lineage

RISK = 0.03  # share of good documents that may be rejected by the rules of a stratum
ERROR = 0.05  # probability that this fails anywhere
MIN_WORDS = 50

# rule: (numerator, denominator, cutoffs per thousand); a document fails when 1000 * numerator > cutoff * denominator
RULES: dict[str, tuple[str, str, list[int]]] = {
    "symbols": ("n_symbols", "n_words", [20, 50, 100, 200, 300, 500, 800]),
    "dup_lines": ("n_dup_lines", "n_lines", [50, 100, 200, 300, 400, 500, 700]),
    "repeats": ("n_repeat_words", "n_words", [50, 100, 150, 200, 300, 400]),
    "long_words": ("word_chars", "n_words", [7000, 8000, 9000, 10000, 12000, 15000]),
    "capitals": ("n_capitals", "word_chars", [50, 100, 200, 300, 500, 700]),
}
# The path: each rule has seven steps at most, loosest cutoffs of all rules first, then the next ones.
STEPS: list[tuple[str, int]] = [(r, sorted(cs, reverse=True)[k]) for k in range(max(len(cs) for _, _, cs in RULES.values())) for r, (_, _, cs) in RULES.items() if k < len(cs)]
FEATURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals"]


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more.

    Windows are compared by their 64-bit hashes. If these are all different the answer is 0; otherwise (hash, place) is
    sorted, equal neighbours give the places of repeated windows, and each place covers three words less its overlap
    with the next place. Everything is at most n log n in the length of the text; lambda variables hold what is used
    more than once, so nothing is worked out twice.
    """

    def hashes(w: Column) -> Column:
        all_of = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.slice(all_of, 1, F.greatest(F.size(w) - 2, F.lit(0)))

    def covered(places: Column) -> Column:
        steps = F.zip_with(places, F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    def repeated(s: Column) -> Column:
        twice = F.filter(s, lambda e, j: (e["h"] == F.get(s, j - 1)["h"]) | (e["h"] == F.get(s, j + 1)["h"]))
        return _bind(F.sort_array(F.transform(twice, lambda e: e["i"])), covered)

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_bind(ordered, repeated))

    return _bind(hashes(words), count)


def _bind(value: Column, body) -> Column:
    """``body`` of ``value``, with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the columns of FEATURES (in place of columns of these names) for its whole texts; null: no words."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    length = lambda c: F.length(c).cast("long")
    words = F.array_remove(F.split(t, r"[\x20\x09-\x0D]+", -1), "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")
    worded = _bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("r")))
    lined = _bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    out = df.withColumns({"__w": worded, "__l": lined})
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    made = {
        "n_words": F.col("__w.n"), "word_chars": length(F.translate(t, " \t\n\x0b\x0c\r", "")), "n_symbols": length(t) - length(F.translate(t, "#*$%&|<>", "")),
        "n_lines": F.col("__l.n"), "n_dup_lines": F.col("__l.d"), "n_repeat_words": F.col("__w.r"), "n_capitals": length(t) - length(F.translate(t, capitals, "")),
    }
    return out.withColumns(made).drop("__w", "__l")


def fails(rule: str, cutoff: Column) -> Column:
    top, bottom, _ = RULES[rule]
    return 1000 * F.col(top) > cutoff * F.col(bottom)


def _allowed(n: Column, risk: float, log_error: Column) -> Column:
    """Largest k with ln P(Binomial(n, risk) <= k) <= log_error; -1 if there is none. Terms are kept as logarithms."""
    odds = F.lit(risk / (1 - risk))
    first = n * F.log1p(F.lit(-risk))
    start = F.struct(first.alias("term"), first.alias("total"), F.when(first <= log_error, 0).otherwise(-1).cast("long").alias("k"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) * odds / i)
        total = F.greatest(term, a["total"]) + F.log1p(F.exp(-F.abs(term - a["total"])))
        return F.struct(term.alias("term"), total.alias("total"), F.when(total <= log_error, i).otherwise(a["k"]).alias("k"))

    up_to = F.greatest(F.ceil(n * F.lit(risk)), F.lit(1)).cast("long")
    return F.aggregate(F.sequence(F.lit(1).cast("long"), up_to), start, step, lambda a: a["k"])


def fail_step() -> Column:
    """First step of the path at which a document fails; null if it passes all."""
    return F.least(*[F.when(fails(r, F.lit(c)), k) for k, (r, c) in enumerate(STEPS)])


def proven_steps(measured: DataFrame, stratum: str, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """``stratum`` and ``steps`` (how many steps of the path are proven) of each stratum of the good documents ``measured``."""
    step = fail_step()
    counts = [F.sum(F.when(step <= k, 1).otherwise(0)).alias(f"fail_{k}") for k in range(len(STEPS))]
    per = cut_lineage(measured.groupBy(stratum).agg(F.count("*").alias("n_good"), *counts))  # one row per stratum
    per = per.withColumn("allowed", _allowed(F.col("n_good"), risk, F.lit(math.log(error / max(1, per.count())))))
    steps = sum([F.when(F.col(f"fail_{k}") <= F.col("allowed"), 1).otherwise(0) for k in range(len(STEPS))], F.lit(0))  # counts only grow
    return per.select(stratum, steps.alias("steps"))


def judged(df: DataFrame, marks: DataFrame, cols: list[str], key: str = "doc_id", stratum: str = "lang", text: str = "text") -> DataFrame:
    """``cols`` of every row with FEATURES, base_failed and kept.

    ``marks`` has ``key`` and quality (1: good); of several marks of one document the lowest counts, a null mark or key
    is none. Null text: no words, so it fails the base rule; null stratum: a stratum of its own. Repeated rows are
    judged row by row; an empty table, or one without marks, gives rows judged by the base rule alone. Columns of
    ``cols`` named like an output give way to it; other columns are left behind.
    """
    cols = [c for c in cols if c not in [*FEATURES, "base_failed", "kept"]]
    src = df.select(*[F.col(f"`{c}`") for c in cols], F.col(f"`{key}`").alias("__key"), F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("")).alias("__stratum"), F.col(f"`{text}`").alias("__text"))
    measured = cut_lineage(features(src, "__text").drop("__text"))  # read twice: by the calibration and by the verdict
    quality = marks.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min("quality").alias("__quality")).filter("__quality = 1")
    good = measured.join(quality, "__key").drop(*[c for c in cols])
    safe = cut_lineage(proven_steps(good, "__stratum"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    bad = F.coalesce(fail_step() < F.col("steps"), F.lit(False))
    out = measured.join(safe, "__stratum", "left")
    return out.select(*[F.col(f"`{c}`") for c in cols], *FEATURES, base.alias("base_failed"), (~base & ~bad).alias("kept"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(documents(spark, sf_dir), labels(spark, sf_dir), ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def measures_sql(table: str) -> str:
    """The measures of FEATURES for a table with rid, text, lang."""
    return f"""
  d0 AS (SELECT *, coalesce(text, '') AS t FROM {table}),
  d1 AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
                list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g') <> '') AS lines FROM d0),
  w1 AS (SELECT rid, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM d1),
  w2 AS (SELECT rid, i, a, lead(a) OVER w AS b, lead(a, 2) OVER w AS c FROM w1 WINDOW w AS (PARTITION BY rid ORDER BY i)),
  w3 AS (SELECT rid, i, c IS NOT NULL AND count(*) OVER (PARTITION BY rid, a, b, c) > 1 AS again FROM w2),
  w4 AS (SELECT rid, again OR coalesce(lag(again) OVER w, false) OR coalesce(lag(again, 2) OVER w, false) AS covered FROM w3
         WINDOW w AS (PARTITION BY rid ORDER BY i)),
  w5 AS (SELECT rid, count(*) FILTER (WHERE covered) AS n FROM w4 GROUP BY rid),
  m AS (SELECT d1.* EXCLUDE (words, lines, t), CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
               CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
               CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(w5.n, 0) AS BIGINT) AS n_repeat_words,
               CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals
        FROM d1 LEFT JOIN w5 USING (rid))"""


def verdicts_sql() -> str:
    """CTEs after ``m``: the cutoffs and the verdict of each row, in ``v``."""
    step = "least(" + ", ".join(f"CASE WHEN 1000 * {RULES[r][0]} > {c} * {RULES[r][1]} THEN {k} END" for k, (r, c) in enumerate(STEPS)) + ")"
    return f"""
  stepped AS (SELECT *, {step} AS step FROM m),
  good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
  held AS (SELECT coalesce(lang, '') AS stratum, step FROM stepped JOIN good USING (doc_id)),
  per AS (SELECT stratum, count(*) AS n_good FROM held GROUP BY 1),
  terms AS (SELECT stratum, n_good, unnest(generate_series(0, CAST(greatest(ceil(n_good * {RISK}), 1) AS BIGINT))) AS i FROM per),
  logs AS (SELECT stratum, i, n_good * ln(1 - {RISK}) + sum(CASE WHEN i > 0 THEN ln((n_good - i + 1) * {RISK / (1 - RISK)!r} / i) ELSE 0 END)
             OVER (PARTITION BY stratum ORDER BY i) AS term FROM terms),
  tails AS (SELECT stratum, i, sum(exp(term)) OVER (PARTITION BY stratum ORDER BY i) AS p FROM logs),
  safe AS (SELECT stratum, coalesce(max(i) FILTER (WHERE p <= {ERROR} / (SELECT count(*) FROM per)), -1) AS allowed FROM tails GROUP BY stratum),
  path AS (SELECT unnest(generate_series(0, {len(STEPS) - 1})) AS k),
  failed AS (SELECT stratum, k, count(*) FILTER (WHERE step <= k) AS n FROM held CROSS JOIN path GROUP BY ALL),
  cuts AS (SELECT stratum, count(*) FILTER (WHERE n <= allowed) AS steps FROM failed JOIN safe USING (stratum) GROUP BY 1),
  v AS (SELECT stepped.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(step < steps, false) AS kept
        FROM stepped LEFT JOIN cuts ON coalesce(lang, '') = stratum)"""


OP10_SQL = f"""
WITH src AS (SELECT *, row_number() OVER () AS rid FROM documents), {measures_sql('src')}, {verdicts_sql()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM v
"""

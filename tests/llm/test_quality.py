import collections
import math
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from bedtrace.llm import quality
from tests.llm.conftest import AWKWARD


def measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered), len(re.findall("[A-Z]", text)))


def test_measures_equal_plain_python(spark, docs, sample):
    odd = [(10**6 + i, t) for i, t in enumerate(["a b c a b c a b c d", "x x x x x x", "a b c\na b c\n\n \n", "A#B |<>| a", "a b a b a", None, ""])]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = {r.doc_id: tuple(r)[1:] for r in quality.features(df).select("doc_id", *quality.FEATURES).collect()}
    assert got == {k: measures(t) for k, t in sample + odd}


def exact_tail(n, k, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_allowed_rejections_are_the_exact_binomial_bound(spark):
    risk, error = 0.02, 0.001
    df = spark.createDataFrame([(n,) for n in (1, 50, 300, 400, 900, 2500)], "n long")
    for r in df.select("n", quality._allowed(F.col("n"), risk, F.lit(math.log(error))).alias("k")).collect():
        want = max([k for k in range(r.n + 1) if exact_tail(r.n, k, risk) <= error], default=-1) if r.n < 1000 else None
        if want is None:
            assert exact_tail(r.n, r.k, risk) <= error < exact_tail(r.n, r.k + 1, risk)
        else:
            assert r.k == want


def test_a_cutoff_is_taken_where_labels_prove_it(spark):
    """2,000 good texts without symbols, 300 bad ones full of them: symbols are cut; 40 good ones in another stratum prove nothing."""
    def text(i, bad):
        return " ".join(f"word{i}{k}" + ("$$$" if bad else "") for k in range(60))

    rows = [(i, text(i, i >= 2000), "en") for i in range(2300)] + [(i, text(i, i >= 5040), "xx") for i in range(5000, 5080)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(r[0], int(r[0] < 2000 or 5000 <= r[0] < 5040)) for r in rows], "doc_id long, quality int")
    out = {r.doc_id: r.kept for r in quality.judged(docs, marks, ["doc_id"]).collect()}
    assert all(out[i] for i in range(2000)) and not any(out[i] for i in range(2000, 2300))
    assert all(out[i] for i in range(5000, 5080))


def test_the_path_stops_at_the_first_step_that_is_not_proven(spark):
    """Good texts of which some have symbols: the steps proven follow the exact tail of the joint rejections."""
    def row(i, signs):
        return i, " ".join(f"word{i}{k}" for k in range(100)) + " $" * signs, "en"

    rows = [row(i, 0) for i in range(190)] + [row(1000 + i, 30) for i in range(3)] + [row(2000 + i, 12) for i in range(4)] + [row(3000 + i, 4) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    measured = quality.features(docs).withColumn("s", F.lit("en"))
    per = {r.doc_id: r.k for r in measured.select("doc_id", quality.fail_step().alias("k")).collect()}
    n, want = len(rows), 0
    for k in range(len(quality.STEPS)):
        if exact_tail(n, sum(v is not None and v <= k for v in per.values()), quality.RISK) > quality.ERROR:
            break
        want = k + 1
    got = quality.proven_steps(measured, "s").first().steps
    assert got == want and 0 < want < len(quality.STEPS)
    verdict = {r.doc_id: r.kept for r in quality.judged(docs, docs.select("doc_id", F.lit(1).alias("quality")), ["doc_id"]).collect()}
    assert {i for i, k in verdict.items() if not k} == {i for i, k in per.items() if k is not None and k < want}


def test_false_rejections_stay_below_the_risk():
    """Simulated holdouts of strata whose true rejection rates grow along the path: a chosen step beyond the risk is as rare as promised."""
    import random

    rng, wrong, risk, error, n = random.Random(8), 0, quality.RISK, quality.ERROR, 300
    allowed = max(k for k in range(40) if exact_tail(n, k, risk) <= error)
    for _ in range(400):
        rates = [0.004 * k for k in range(1, 30)]
        draws = [rng.random() for _ in range(n)]
        steps = sum(sum(d < r for d in draws) <= allowed for r in rates)
        wrong += steps > 0 and rates[steps - 1] > risk
    assert wrong / 400 <= error + 0.03


def test_null_strata_and_a_stratum_without_a_name_are_one(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60)) + (" $$" * 60 if i % 50 == 49 else ""), None if i % 2 else "") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, int(i % 50 != 49)) for i in range(400)], "doc_id long, quality int")
    out = {r.doc_id: r.kept for r in quality.judged(docs, marks, ["doc_id"]).collect()}
    assert {i for i, k in out.items() if not k} == {i for i in range(400) if i % 50 == 49}


def test_a_cutoff_is_proven_on_the_given_table(spark):
    df = quality.op10_quality_rules(spark, "/root/testdata/sf0.01")
    assert df.filter("not base_failed and not kept").count() > 0


def test_awkward_rows(spark, awkward, nothing):
    marks = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (7, None)], "doc_id long, quality int")
    out = quality.judged(awkward, marks, ["doc_id", "text", "kept", "digest"])
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "digest", *quality.FEATURES, "base_failed", "kept"]
    assert isinstance(out.schema["kept"].dataType, T.BooleanType)
    assert sorted((str(r.doc_id), r.n_words, r.kept) for r in rows) == sorted((str(r[0]), measures(r[1])[0], measures(r[1])[0] >= 50) for r in AWKWARD)
    assert quality.judged(nothing, marks, ["doc_id"]).count() == 0
    assert quality.judged(awkward, marks.limit(0), ["doc_id"]).count() == len(AWKWARD)

"""Scans, store versions, contracts, sinks and audits."""

import pytest
from pyspark.sql import functions as F

from bedtrace.sources import logs, store


@pytest.fixture(scope="module")
def folder(tmp_path_factory, wells):
    root = tmp_path_factory.mktemp("logs") / "train"
    root.mkdir()
    log, curve = wells
    for w, d in log.groupby("well"):
        if w == "w1":  # two rows that change places
            d = d.iloc[[*range(50), 51, 50, *range(52, len(d))]]
        d.drop(columns="well").to_csv(root / f"{w}__horizontal_well.csv", index=False)
    for w, d in curve.groupby("well"):
        d.drop(columns="well").to_csv(root / f"{w}__typewell.csv", index=False)
    return root.parent


def test_read_wells(spark, folder, wells):
    d = logs.read_wells(spark, str(folder), "train")
    got = d.toPandas().sort_values(["well", "row_idx"])
    want = wells[0]
    assert len(got) == len(want) and list(got[got.well != "w1"].MD) == list(want[want.well != "w1"].MD)
    one = got[got.well == "w1"].reset_index(drop=True)
    assert one.MD[50] == 51 and one.MD[51] == 50 and list(got[got.md_falls].well) == ["w1"] and one.md_falls[51]
    assert got.is_known.sum() == want.TVT_input.notna().sum() and got.GR.isna().sum() == want.GR.isna().sum()
    assert got.BUDA.isna().all()


def test_read_typewells(spark, folder, wells):
    assert logs.read_typewells(spark, str(folder), "train").count() == len(wells[1])


def test_fill_nearest(spark):
    d = spark.createDataFrame([("a", 1.0, None), ("a", 2.0, 5.0), ("a", 3.0, None)], "g string, x double, y double")
    assert {r.y for r in logs.fill_curve(d, "g", "x", "y", "nearest").collect()} == {5.0}


def test_compact_and_pushdown(spark, tmp_path):
    d = spark.range(100).select(F.concat(F.lit("w"), F.col("id") % 5).alias("well"), (F.col("id") / 3).alias("v"))
    logs.compact(d, str(tmp_path / "c"))
    back = logs.rows_of(spark, str(tmp_path / "c"), ["w1", "w3"], ["v"])
    assert back.count() == 40 and back.schema["v"].dataType.simpleString() == "float"
    plan = back._jdf.queryExecution().toString()
    assert "PushedFilters: [In(well" in plan


def test_feature_versions(spark, tmp_path):
    root = str(tmp_path / "store")
    base = spark.range(50).select(F.col("id").cast("string").alias("id"), F.col("id").cast("double").alias("a"))
    built = []

    def build(missing):
        built.append(missing)
        return base if missing is None else base.select("id", (F.col("a") * 2).alias("b"))

    one, two = {"columns": ["a"], "wells": 50}, {"columns": ["a", "b"], "wells": 50}
    store.cached_features(spark, root, one, build)
    store.cached_features(spark, root, one, build)
    up = store.cached_features(spark, root, two, build, previous=store.version_path(root, one))
    assert built == [None, ["b"]] and up.columns == ["id", "a", "b"] and up.count() == 50


def test_coverage_gate(spark):
    d = spark.createDataFrame([(1, 1.0), (2, None)], "id int, a double")
    with pytest.raises(store.ContractError):
        store.require_coverage(d, ["a"], 0.95)
    with pytest.raises(store.ContractError):
        store.require_coverage(d, ["zz"], 0.1)
    with pytest.raises(store.ContractError):
        store.require_frame(d, {"id": "int", "a": "double"}, ["a"])


def test_prediction_sink_keeps_sample_order(spark, tmp_path):
    sample = spark.createDataFrame([(f"w_{i}", (i * 7) % 50) for i in range(50)], "id string, sample_pos int")
    pred = spark.createDataFrame([(f"w_{i}", float(i)) for i in range(40)], "id string, tvt double")
    path = str(tmp_path / "out")
    store.write_predictions(pred, sample, path, fallback=-5.0)
    rows = [line for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()[1:]]
    want = sorted(range(50), key=lambda i: (i * 7) % 50)
    assert rows == [f"w_{i},{float(i) if i < 40 else -5.0}" for i in want]


def test_equal_count_join(spark):
    a, b = spark.range(5).withColumn("x", F.lit(1)), spark.range(6).withColumn("y", F.lit(2))
    with pytest.raises(store.ContractError):
        store.joined_predictions(a, b, "id")
    assert store.joined_predictions(a, b.where("id < 5"), "id").count() == 5


def test_audit_sees_swapped_rows(spark):
    sample = spark.range(10).select(F.col("id").cast("string").alias("k"), F.col("id").alias("pos"))
    good = sample.withColumn("v", F.lit(1.5))
    bad = good.withColumn("pos", F.when(F.col("pos") == 3, 4).when(F.col("pos") == 4, 3).otherwise(F.col("pos")))
    a, b = (store.audit_output(d, sample, "k", "v", "pos").first() for d in (good, bad))
    assert a.out_of_place == 0 and b.out_of_place == 2 and a.digest == b.digest and a.rows == 10

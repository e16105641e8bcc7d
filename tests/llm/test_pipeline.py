import corpus_pipeline
import pytest
from bedtrace.llm import jaccard, quality, secrets
from bedtrace.session import cut_lineage
from tests.llm import test_jaccard, test_lines, test_quality, test_secrets
from tests.llm.test_tokens import PATH, check_pieces
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage gets and returns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        made = cut_lineage(stage(spark, docs, SF))
        out.append((name, docs, made))
        docs = made
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert [s[0] for s in stages] == ["quality_rules", "line_dedup", "near_duplicates", "secret_scans", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert after.schema == before.schema


def test_each_stage_against_brute_force(spark, stages):
    (_, d0, d1), (_, _, d2), (_, _, d3), (_, _, d4), (_, _, d5) = stages
    before, after = texts(d0), texts(d1)
    marks = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in quality.judged(d0, marks, ["doc_id"]).filter("kept").collect()}
    assert after == {k: before[k] for k in kept}
    for k, t in before.items():  # too few labels for a cutoff here: the base rule alone
        n, *_, covered, _ = test_quality.measures(t)
        assert (k in kept) == (not (n < 50 or 100 * covered > 50 * n))
    want = {k: t for k, t in test_lines.brute(list(after.items())) if t.split() or not after[k].split()}
    assert texts(d2) == want
    comps = {k: c for k, _, c in test_jaccard.brute(list(want.items()), 5, 80)}
    near = {k: t for k, t in want.items() if comps[k] == k}
    assert texts(d3) == near
    assert texts(d4) == {k: secrets.redacted(t) for k, t in near.items()}
    assert not any(test_secrets.base_spans(t) for t in texts(d4).values())
    assert {r.doc_id: r.n_chars for r in d4.collect()} == {k: len(t) for k, t in texts(d4).items()}
    check_pieces(d5.collect(), list(texts(d4).items()), Tokenizer.from_file(PATH), 1024)


def test_stages_take_awkward_rows(spark, awkward, nothing):
    for df in (awkward, nothing):
        docs = df
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, SF)
            made.count()
            docs = cut_lineage(made) if name != "packing" else docs
        direct = jaccard.one_of_each(df)
        assert direct.columns == df.columns


def test_run_applies_all_stages(spark, stages):
    got = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in stages[-1][2].collect())

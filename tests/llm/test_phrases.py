import collections
import random
import re

import numpy as np
import pytest

from bedtrace.llm import phrases
from tests.llm.conftest import AWKWARD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top, covered=50):
    """(lang, text) rows -> the phrases of each language, from the definition."""
    f, out = collections.Counter(), []
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update(((lang or "und") if lang is None else lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    for lang in {g[0] for g in f}:
        n = sum(c for g, c in f.items() if g[0] == lang and len(g) == 2)
        longest = collections.Counter()
        for g, c in f.items():
            if g[0] == lang and len(g) == 4:
                for inside in (g[1:3], g[2:4]):
                    longest[inside] = max(longest[inside], c)
        found = []
        for g, a in f.items():
            if g[0] != lang or len(g) < 3 or a < least or (len(g) == 3 and longest[g[1:]] >= least and 100 * longest[g[1:]] >= covered * a):
                continue
            cuts = [(10**6 * a * a // (f[(lang, *g[1 : 1 + k])] * f[(lang, *g[1 + k :])]), k) for k in range(1, len(g) - 1)]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(g[1:]).encode(), f[(lang, *g[1 : 1 + k])], f[(lang, *g[1 + k :])]))
        out += [(lang, i + 1, p.decode(), -a, le, r, n, -s) for i, (s, a, p, le, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def corpus(seed, docs=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)] + ["Éa", "Zz", "日本", "don't"]
    passage = " ".join(f"p{i}" for i in range(40))
    ring = " ".join(["ha", "ho"] * 12)
    rows = []
    for i in range(docs):
        text = "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", " ? "]) for _ in range(rng.randrange(60)))
        rows.append((rng.choice(["en", "de", "und", None, ""]), text + (passage if i % 4 == 0 else "") + (" " + ring if i % 7 == 0 else "")))
    return rows


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("least, top", [(2, 10**6), (3, 15)])
def test_equals_counting_all_grams(spark, least, top):
    rows = corpus(least)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    want = brute(rows, least, top)
    assert len(want) > 50
    assert rows_of(phrases.collocations(df, least=least, top=top)) == want


def test_words_with_equal_hashes_get_another_seed(spark):
    rows = corpus(7, 20)
    df = spark.createDataFrame(rows, "lang string, text string")

    def weak(of, seed):
        return phrases.hashes(of, seed) if seed else np.array([len(x) for x in of.to_pylist()], np.int64)

    assert phrases.vocabulary(df, weak)[1] == 1
    assert rows_of(phrases.collocations(df, least=2, digest=weak)) == brute(rows, 2, 2000)


def test_unary_paths_are_whole_and_cut_into_bounded_rows(spark):
    n = phrases.PART + 90
    chain = [("en", i, i + 1, i + 2, 5) for i in range(n)]
    side = [("en", 10**6, 0, 1, 3), ("en", 10**6 + 1, 0, 1, 2), ("de", 1, 2, 3, 9)]
    edges = spark.createDataFrame(chain + side, "lang string, w1 long, w2 long, w3 long, n long").repartition(6)
    inner = spark.createDataFrame([("en", i, i + 1) for i in range(1, n)], "lang string, w1 long, w2 long")
    got = collections.defaultdict(list)
    for r in phrases.compact_paths(edges, inner).collect():
        assert len(r.ws) <= phrases.PART + 2
        got[(r.lang, r.path)].append((r.part, r.ws, r.n))
    assert len(got) == 4
    parts = sorted(max(got.values(), key=len))
    assert [p for p, _, _ in parts] == [0, 1] and [w for _, w, _ in parts] == [list(range(phrases.PART + 2)), list(range(phrases.PART, n + 2))]


def test_awkward_rows(spark, awkward, nothing):
    from pyspark.sql import functions as F

    df = awkward.withColumn("phrase", F.lit("x")).withColumn("rank", F.lit("y"))
    assert rows_of(phrases.collocations(df, least=2)) == brute([(r[2], r[1]) for r in AWKWARD], 2, 2000)
    out = phrases.collocations(nothing)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and out.count() == 0


@pytest.mark.parametrize("block", [1, 4, 1 << 20])
def test_words_follow_only_inside_a_piece(block):
    import pyarrow as pa

    got = []
    for code, dic, text, follows in phrases.words(pa.array(["A b,c", "d", "", " e\tf\x0bg", "x"], pa.string()), block):
        got += [(dic[c].as_py(), t, f) for c, t, f in zip(code.tolist(), text.tolist(), follows.tolist())]
    assert got == [(b"a", 0, True), (b"b", 0, False), (b"c", 0, False), (b"d", 1, False), (b"e", 3, True), (b"f", 3, False), (b"g", 3, False), (b"x", 4, False)]

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from bedtrace.llm import langid, toxicity
from bedtrace.llm.common import mixed, text_bytes, words_of
from bedtrace.llm.subwords import Grams
from tests.llm.conftest import AWKWARD


def test_words_do_not_depend_on_blocks():
    text = ["Aa bb\ncc", "", " ", "é日本 x" * 20, "y" * 300, "a b"]
    data, offs = text_bytes(pa.array(text))
    whole = words_of(data, offs)
    for block in (1, 7, 64):
        for a, b in zip(whole, words_of(data, offs, block)):
            assert (a == b).all()
    words = [w for t in text for w in t.encode().lower().split()]
    assert [bytes(data[s : s + n]).lower() for s, n in zip(whole[0], whole[1])] == words
    assert len(set(whole[2].tolist())) == len(set(words))


def test_gram_sums_equal_plain_python():
    g = Grams((2, 3), 1 << 10)
    rng = np.random.default_rng(0)
    table = rng.normal(size=(g.rows + 1, 2)).astype(np.float32)
    table[-1] = 0
    data, offs = text_bytes(pa.array(["Ab c", "defg"]))
    starts, lens, h = words_of(data, offs)

    def row(gram):
        v = len(gram)
        for b in gram:
            v = v * 256 + b
        return ((v * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> (64 - 10)

    for w, got in zip([b" ab ", b" c ", b" defg "], g.sums(table, data, starts, lens)):
        want = sum(table[row(w[i : i + n])] for n in g.orders for i in range(len(w) - n + 1))
        assert np.allclose(got, want, atol=1e-5)
    assert g.counts(lens).tolist() == [sum(len(w) + 2 - n + 1 for n in g.orders) for w in ("ab", "c", "defg")]


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(1)
    k, trans = 3, rng.normal(size=(3, 3))
    counts = np.array([1, 4, 0, 6, 2])
    e = rng.normal(size=(int(counts.sum()), k))
    want, at = [], 0
    for n in counts:
        part, total = np.zeros((n, k)), 0.0
        for path in itertools.product(range(k), repeat=int(n)) if n else []:
            p = np.exp(sum(e[at + t, y] for t, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            # the message into the first word is uniform, so its transition sums over all languages
            p *= np.exp(trans[:, path[0]]).sum()
            total += p
            for t, y in enumerate(path):
                part[t, y] += p
        want.append(part / max(total, 1e-300))
        at += n
    for block in (2, 3, 64):
        assert np.allclose(langid.marginals(e, counts, trans, block), np.concatenate(want), atol=1e-4)


def test_held_out_languages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.op6_language_id(spark, "/root/testdata/sf0.01").join(df.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(out) == df.count()
    held = out[[zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]]
    assert held.held_out.all() and held.held_out.sum() == out.held_out.sum()
    assert (held.lang_pred == held.lang).mean() > 0.98
    assert out.score.between(0, 1).all()


def test_code_switched_text_is_shared_between_its_languages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", "lang").toPandas()
    model = langid.fit(rows.text.tolist()[:400], rows.lang.tolist()[:400])
    a = next(t for t, x in zip(rows.text[400:], rows.lang[400:]) if x == "en").split()[:60]
    b = next(t for t, x in zip(rows.text[400:], rows.lang[400:]) if x == "es").split()[:60]
    data, offs = text_bytes(pa.array([" ".join(a + b)]))
    starts, lens, h = words_of(data, offs)
    p = langid.marginals(model.potentials(data, starts, lens, h), np.array([len(starts)]), model.trans)
    found = [model.langs[i] for i in p.argmax(1)]
    assert found[:50].count("en") > 45 and found[-50:].count("es") > 45


def test_awkward_texts(spark, awkward, nothing):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang").toPandas()
    model = langid.fit(rows.text.tolist(), rows.lang.tolist(), epochs=1)
    out = langid.predict(awkward, model, ["doc_id", "score"])
    assert out.columns == ["doc_id", "lang_pred", "score"]
    und = sorted(str(r.doc_id) for r in out.collect() if r.lang_pred == "und")
    assert und == sorted(str(r[0]) for r in AWKWARD if not any(c.isalpha() for c in r[1] or ""))
    assert langid.predict(nothing, model, ["doc_id"]).count() == 0
    tox = toxicity.fit(rows.text.tolist(), (mixed(np.arange(len(rows), dtype=np.uint64)) % np.uint64(2)).astype(int), steps=8)
    got = toxicity.score_texts(awkward, tox, ["doc_id", "score"]).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert toxicity.score_texts(nothing, tox, ["doc_id"]).count() == 0
    empty = toxicity.fit([], np.zeros(0))
    assert toxicity.score_texts(awkward, empty, ["doc_id"]).count() == len(AWKWARD)


def test_best_bag_is_the_largest_mean():
    rng = np.random.default_rng(2)
    counts = np.array([0, 1, 3, 9, 0, 20])
    words = rng.normal(size=int(counts.sum()))
    top, first, last = toxicity.best_bags(words, counts)
    at, w = 0, toxicity.WINDOW
    for d, n in enumerate(counts):
        part = words[at : at + n]
        bags = [part[i : i + w].mean() for i in range(max(1, n - w + 1))] if n else [0.0]
        assert np.isclose(top[d], max(bags))
        if n:
            assert np.isclose(words[first[d] : last[d]].mean(), top[d]) and at <= first[d] < last[d] <= at + n
        at += n


def test_toxic_words_and_unseen_misspellings():
    rng = np.random.default_rng(3)
    filler = [f"{a}{b}" for a in ("an", "the", "er", "tion", "sh", "ou") for b in ("re", "st", "en", "ha", "ble")]
    bad = ["worthless", "pathetic", "disgusting"]
    texts, y = [], []
    for i in range(900):
        words = rng.choice(filler, rng.integers(20, 200)).tolist()
        if i % 4 == 0:
            for _ in range(3):
                words.insert(int(rng.integers(len(words))), str(rng.choice(bad)))
        texts.append(" ".join(words))
        y.append(int(i % 4 == 0))
    m = toxicity.fit(texts, np.array(y))

    def score(t):
        data, offs = text_bytes(pa.array([t]))
        starts, lens, h = words_of(data, offs)
        return float(m.scores(m.word_scores(data, starts, lens, h), np.array([len(starts)]))[0])

    plain = " ".join(filler * 5)
    assert score(plain) < 0.3 and score("") < 0.3
    assert all(score(f"{plain} {w} {plain}") > 0.5 for w in bad)
    assert all(score(f"{plain} {w} {plain}") > 0.3 for w in ("worthles", "pathetik", "disgustting"))


def test_rows_of_the_other_fold_are_not_learned(spark):
    key = spark.createDataFrame([(7,), (None,)], "doc_id long")
    got = [r[0] for r in key.select(langid.remainder(F.col("doc_id"), 4)).collect()]
    assert got == [zlib.crc32(b"7") % 4, None]


def test_expected_transitions_equal_all_paths():
    rng = np.random.default_rng(4)
    k, trans = 3, rng.normal(size=(3, 3))
    sizes = np.array([3, 1, 5])
    e = rng.normal(size=(int(sizes.sum()), k))
    want, at = np.zeros((k, k)), 0
    for n in sizes:
        part, total = np.zeros((k, k)), 0.0
        for path in itertools.product(range(k), repeat=int(n)):
            p = np.exp(sum(e[at + t, y] for t, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:]))) * np.exp(trans[:, path[0]]).sum()
            total += p
            for a, b in zip(path, path[1:]):
                part[a, b] += p
        want += part / total
        at += n
    assert np.allclose(langid._pair_sums(e, sizes, trans), want, atol=1e-8)


def test_language_query_on_tables_without_labels(spark, nothing, tmp_path):
    rows = [(1, "some words here", None), (2, None, "en"), (3, " \n", "de"), (4, "123 !", None), (None, "", "en")]
    tables = {"empty": nothing.select("doc_id", "text", "lang"), "unlabelled": spark.createDataFrame(rows, "doc_id long, text string, lang string"),
              "one": spark.createDataFrame([(i, f"words of one tongue {i}", "en") for i in range(30)], "doc_id long, text string, lang string")}
    got = {}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got[name] = {r.doc_id: (r.lang_pred, r.score) for r in langid.op6_language_id(spark, f"{tmp_path}/{name}").collect()}
    assert got["empty"] == {}
    assert got["unlabelled"] == {1: ("und", 0.0), 2: ("und", 1.0), 3: ("und", 1.0), 4: ("und", 1.0), None: ("und", 1.0)}
    assert {x for x, _ in got["one"].values()} == {"en"} and len(got["one"]) == 30


def test_samples_are_even_over_labels_and_copies_take_one_place(spark):
    rows = [(f"common text {i}", "en") for i in range(900)] + [("a copied text", "en")] * 500 + [(f"rare {i}", "xx") for i in range(7)] + [(None, "de"), ("x" * 50, "long")]
    df = spark.createDataFrame(rows, "t string, l string").repartition(5)
    got = langid.class_sample(df, "l", rows=60, chars=40, text="t").toPandas()
    assert sorted(got.text[got.label == "xx"]) == sorted(f"rare {i}" for i in range(7))
    assert (got.label == "en").sum() == 53 and set(got.label) == {"en", "xx"} and got.text.is_unique
    assert langid.per_class({"a": 5, "b": 100, "c": 100}, 50) == {"a": 5, "b": 22, "c": 23}

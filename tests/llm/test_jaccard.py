import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from bedtrace.llm import jaccard
from bedtrace.llm.components import components
from tests.llm.conftest import AWKWARD


def shingles(text, words):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if len(w) < words:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def brute(rows, words=4, sim=85):
    """(key, number of shingles, component) of each row, by comparing all pairs."""
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= sim * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)].append(key)
    return sorted([(k, len(s), min(least[find(i)], default=None)) for i, ((k, _), s) in enumerate(zip(rows, sets))], key=str)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def edited(rng, base, share):
    return " ".join(w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in base.split())


@pytest.fixture(scope="module")
def near():
    """Chains and stars of near copies of texts of 3 to 900 words, around the border of similarity."""
    rng = random.Random(5)
    rows = []
    for size in (3, 5, 8, 12, 20, 45, 100, 300, 900):
        base = " ".join(f"v{rng.randrange(5000)}" for _ in range(size))
        last = base
        for k in range(12):
            rows.append(edited(rng, base, rng.choice([0, 0.005, 0.015, 0.03, 0.05])))
            last = edited(rng, last, 0.01)
            rows.append(last)
            rows.append(" ".join(base.split()[: int(size * rng.uniform(0.8, 1))]).upper())
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_components_equal_all_pairs(spark, near, docs, sample):
    df = spark.createDataFrame(near, "doc_id long, text string").repartition(5)
    assert got(jaccard.link_components(df)) == brute(near)
    assert got(jaccard.link_components(docs)) == brute(sample)


def test_five_words_and_another_similarity(spark, near):
    df = spark.createDataFrame(near, "doc_id long, text string")
    assert got(jaccard.link_components(df, words=5, sim=80)) == brute(near, 5, 80)


def test_every_link_meets_in_a_key_that_is_left():
    """The allocation loses no pair: also texts with many empty subsets, after each has left out its longest lists."""
    rng = np.random.default_rng(2)
    for n in (6, 7, 9, 14, 27, 80, 400, 3000):
        for _ in range(30):
            base = rng.integers(0, 2**63, n).astype(np.uint64)
            other = base.copy()
            most = int(jaccard.most_apart(np.int64(n), np.int64(n), 85)) // 2
            other[rng.choice(n, most, replace=False)] = rng.integers(0, 2**63, most).astype(np.uint64)
            cut = rng.integers(0, int(jaccard.most_apart(np.int64(n), np.int64(n), 85)) - 2 * most + 1)
            other = other[: n - cut]
            a, b = np.unique(base), np.unique(other)
            v, size = np.concatenate([a, b]), np.array([len(a), len(b)])
            if 100 * len(np.intersect1d(a, b)) < 85 * len(np.union1d(a, b)) or len(np.union1d(a, b)) == len(np.intersect1d(a, b)):
                continue
            common = []
            for up in (False, True):
                keys, count, slack, rare, rare_count, stuck = jaccard.signatures(v, size, up, np.ones(2, bool))
                common.append((set(keys[: count[0]].tolist()), set(keys[count[0] :].tolist()), slack, stuck, set(rare[: rare_count[0]].tolist()), set(rare[rare_count[0] :].tolist())))
            meet = 0
            for i, j in ((0, 0), (0, 1), (1, 0)):
                x, y = common[i], common[j]
                shared = len(x[0] & y[1])
                drop = max(int(x[2][0]), int(y[2][1]))
                meet += max(0, shared - drop) + (len(x[4] & y[5]) if x[3].any() or y[3].any() else 0)
            assert meet > 0, (n, len(a), len(b))


def test_deletion_keys_find_sets_that_agree_in_empty_subsets_only():
    """Sets made so that all segments they share are empty still meet."""
    rng = np.random.default_rng(4)
    found = tried = 0
    for _ in range(4000):
        a = rng.integers(0, 2**63, 9).astype(np.uint64)
        b = np.append(a[:-1], rng.integers(0, 2**63, 1).astype(np.uint64))
        v, size = np.concatenate([np.sort(a), np.sort(b)]), np.array([9, 9])
        keys, count, slack, *_ = jaccard.signatures(v, size, False, np.ones(2, bool), 80)
        tried += 1
        found += len(set(keys[: count[0]].tolist()) & set(keys[count[0] :].tolist())) > int(slack.max())
    assert found == tried


def test_sketch_is_a_lower_bound():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
        b = np.unique(np.append(a[: rng.integers(100, 200)], rng.integers(0, 2**63, 30).astype(np.uint64)))
        s = jaccard.sketches(np.concatenate([a, b]), np.array([len(a), len(b)])).view(np.uint64)
        bits = sum(int(x).bit_count() for x in s[0] ^ s[1])
        assert bits <= len(np.setxor1d(a, b))


def test_shingles_of_arrow_slices():
    texts = ["", "one", "One TWO three", "a b c d e", "a b c d a b c d", None]
    arr = pa.array(["x y", *[t or "" for t in texts]]).slice(1)
    _, n = jaccard.shingle_sets(arr, 4)
    assert n.tolist() == [len(shingles(t, 4)) for t in texts]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    ids = rng.sample(range(10**6), 400)
    links = list(zip(ids[:200], ids[1:201])) + [(ids[210], x) for x in ids[211:400]]
    out = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({out[x] for x in ids[:201]}) == 1 and len({out[x] for x in ids[210:400]}) == 1
    assert out[ids[0]] != out[ids[210]] and len(out) == 391


def test_awkward_rows(spark, awkward, nothing):
    rows = [(r[0], r[1]) for r in AWKWARD]
    assert got(jaccard.link_components(awkward)) == brute(rows)
    assert jaccard.link_components(nothing).count() == 0
    kept = jaccard.one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "4", "5", "None", "7", "8", "9"])

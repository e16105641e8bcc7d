import random
import re

from bedtrace.llm import lines
from tests.llm.conftest import AWKWARD


def brute(rows, min_words=0, long_words=50):
    """Rows (key, text) in any order -> (key, new text), from the definition: a line with words is covered when it and a
    neighbour stood together before (smaller key, then place), or when it is long and stood before."""
    words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x))
    seen_pairs, seen_long, new = set(), set(), {}
    for no_key, k, t in sorted({(k is None, k or 0, t) for k, t in rows if t is not None}):
        every = t.split("\n")
        at = [i for i, x in enumerate(every) if words(x)]
        covered = set()
        for i, j in zip(at, at[1:]):
            if (every[i], every[j]) in seen_pairs:
                covered |= {i, j}
            seen_pairs.add((every[i], every[j]))
        for i in at:
            if words(every[i]) >= long_words:
                if every[i] in seen_long:
                    covered.add(i)
                seen_long.add(every[i])
        out, i = [], 0
        while i < len(every):
            if i not in covered:
                out.append(every[i])
                i += 1
                continue
            run = []
            while i < len(every) and (i in covered or not words(every[i])):
                run.append(every[i])
                i += 1
            counts = [words(x) for x in run if words(x)]
            if not (counts[0] >= long_words if len(counts) == 1 else sum(counts) >= min_words):
                out += run
        new[(no_key, k, t)] = "\n".join(out)
    return sorted([(k, None if t is None else new[(k is None, k or 0, t)]) for k, t in rows], key=str)


def passages():
    rng = random.Random(4)
    line = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    shared = [[line(rng.randint(5, 12)) for _ in range(14)] for _ in range(4)]
    one = line(60)
    rows = []
    for i in range(60):
        body = [line(rng.randint(2, 20)) for _ in range(rng.randint(0, 8))]
        at = rng.randint(0, len(body))
        if i % 3 == 0:
            body[at:at] = shared[i % 4]
        if i % 5 == 0:
            body.insert(at, one)
        rows.append((i, "\n".join(body)))
    return rows, shared, one


def test_equals_brute_force(spark, docs, sample):
    got = sorted([(r.doc_id, r.text) for r in lines.dedup_lines(docs.select("doc_id", "text")).collect()], key=str)
    assert got == brute(sample)


def test_shared_passages_stay_once_and_other_lines_stay(spark):
    rows, shared, one = passages()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted([(r.doc_id, r.text) for r in lines.dedup_lines(df).collect()], key=str)
    assert got == brute(rows)
    texts = dict(got)
    assert sum(one in t.split("\n") for t in texts.values()) == 1
    own = {x for p in shared for x in p} | {one}
    for k, t in rows:  # lines of one document alone are never taken
        assert [x for x in t.split("\n") if x and x not in own] == [x for x in texts[k].split("\n") if x and x not in own]
    for p in shared:  # most of a passage goes from all documents but one, wherever it stands
        left = sum(x in t.split("\n") for t in texts.values() for x in p)
        before = sum(x in t.split("\n") for _, t in rows for x in p)
        assert left < 0.5 * before


def test_borders_follow_the_lines_and_not_their_place():
    rng = random.Random(6)
    passage = [f"line {rng.randrange(10**9)} of it" for _ in range(60)]
    want = None
    for lead in range(5):
        d = lines.Lines("\n".join([f"lead {lead} {i}" for i in range(lead)] + passage))
        ends = {b - lead for _, b in d.chunks() if b - lead > lines.WINDOW}
        want = want or ends
        assert ends == want
    many = lines.Lines("\n".join(f"x {rng.randrange(10**9)}" for _ in range(4000))).chunks()
    assert 4 <= 4000 / len(many) <= 8 and max(b - a for a, b in many) <= lines.MAX_LINES


def long_passages(copies=5):
    rng = random.Random(12)
    line = lambda: " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randint(3, 9)))
    shared = [[line() for _ in range(rng.randint(18, 40))] for _ in range(8)]
    rows, want, repeated = [], {}, 0
    for p, passage in enumerate(shared):
        for c in range(copies):
            before, after = ([line() for _ in range(rng.randint(0, 12))] for _ in range(2))
            rows.append((10 * p + c, "\n".join(before + passage + after)))
            want[10 * p + c] = "\n".join(before + (passage if c == 0 else []) + after)
            repeated += len(passage) * (c > 0)
    return rows, want, repeated


def test_chunks_and_their_growth_decide_long_passages(spark):
    """Most repeated lines are found without the finer level, more than the chunks themselves hold; both levels find all."""
    rows, want, repeated = long_passages()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert {r.doc_id: r.text for r in lines.dedup_lines(df).collect()} == want
    got = {r.doc_id: r.lines_removed for r in lines.dedup_lines(df, levels="chunks").collect()}
    assert 0.8 * repeated < sum(got.values()) <= repeated
    first, inside = set(), 0
    for _, t in rows:
        d = lines.Lines(t)
        units = {d.key(a, b)[2]: b - a for a, b in d.units()}
        inside += sum(n for u, n in units.items() if u in first)
        first |= set(units)
    assert inside < 0.9 * sum(got.values())


def test_chunks_find_passages_of_lines_that_stand_elsewhere_first(spark):
    """Every line stands in an earlier document, in another order: lines alone lead there, chunks to the passage."""
    rows, _, repeated = long_passages(3)
    rng = random.Random(3)
    every = sorted({x for _, t in rows for x in t.split("\n")})
    rng.shuffle(every)
    rows = [(-1, "\n".join(every)), *rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([(r.doc_id, r.text) for r in lines.dedup_lines(df).collect()], key=str) == brute(rows)
    assert sum(r.lines_removed for r in lines.dedup_lines(df, levels="chunks").collect()) > 0.8 * repeated


def test_what_a_run_must_say():
    long = " ".join(f"w{i}" for i in range(60))
    text = f"short line\n{long}\nanother short line\n\nthird"
    assert lines.without(text, [(0, 1)]) == (text, 0)
    assert lines.without(text, [(1, 2)]) == ("short line\nanother short line\n\nthird", 1)
    assert lines.without(text, [(2, 4)]) == (f"short line\n{long}", 3)
    assert lines.without(text, [(2, 4)], min_words=5) == (text, 0)
    assert lines.without(text, [(0, 2), (1, 4)]) == ("", 5)


def test_parameters_for_short_runs_and_long_lines(spark):
    nine = [" ".join(f"{c}{i}" for i in range(9)) for c in "ab"]
    line = " ".join(f"z{i}" for i in range(49))
    rows = [(k, f"own {k}\n{nine[0]}\n{nine[1]}\nmine {k}\n{line}\nend {k}") for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for args in ({}, {"min_words": 20}, {"long_words": 49}):
        assert sorted([(r.doc_id, r.text) for r in lines.dedup_lines(df, **args).collect()], key=str) == brute(rows, **args)
    got = {r.doc_id: r.text for r in lines.dedup_lines(df, long_words=49).collect()}
    assert got[0] == rows[0][1] and all(got[k] == f"own {k}\nmine {k}\nend {k}" for k in range(1, 10))


def test_short_passages_go_as_a_whole_wherever_they_stand(spark):
    rng = random.Random(9)
    line = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    shapes = [(2, 27), (3, 20), (4, 15), (5, 11), (6, 10), (2, 10)]  # lines, words of a line
    shared = [[line(w) for _ in range(n)] for n, w in shapes for _ in range(5)]
    rows, own = [], {}
    for p, passage in enumerate(shared):
        for c in range(4):
            before, after = ([line(rng.randint(2, 20)) for _ in range(rng.randint(0, 5))] for _ in range(2))
            k = 10 * p + c
            own[k] = before + (passage if c == 0 else []) + after
            rows.append((k, "\n".join(before + passage + after)))
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == {k: "\n".join(x) for k, x in own.items()}


def test_empty_lines_inside_a_passage_and_lines_that_many_pairs_share():
    one, two, three = (" ".join(f"{c}{i}" for i in range(12)) for c in "abc")
    rows = [(1, f"x\n{one}\n\n{two}\ny"), (2, f"z\n{one}\n\n{two}\n{three}"), (3, f"{two}\n{three}"), (4, f"{one}\nq\n{two}")]
    assert brute(rows) == [(1, rows[0][1]), (2, f"z\n{three}"), (3, ""), (4, rows[3][1])]
    assert brute([(1, "\n".join([one] * 4))]) == [(1, one)]

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from bedtrace.llm import pii
from tests.llm.conftest import AWKWARD, SF, long_text

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def checksum(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (2 if k % 2 else 1)
        total += x // 10 + x % 10
    return total % 10 == 0


def plain(text):
    """Base spans by the patterns as they are written."""
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and checksum(d), "phone": 9 <= len(d) <= 15}[kind]
            out += [(m.start(), m.end(), kind)] if fine else []
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))


def test_base_spans_equal_the_patterns(sample):
    rng = random.Random(1)
    odd = ["a@b.c%d@e.f", "@x.y a@b a@b.c.d..e", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.0000255", "+1 (168) 555-5254 97.51.17.173", "+12+1234567890 4111 1111-1111 1111 4111111111111111",
           "x@y.z@w.v", "é@b.co .@a.b", "१२३.1.1.1", "+1", ""]
    odd += ["".join(rng.choice(["1", "23", "4", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "%", "é", "\n", "4111 1111 1111 1111"]) for _ in range(rng.randrange(40))) for _ in range(4000)]
    for t in odd + [t for _, t in sample if t]:
        assert pii.base_spans(t) == plain(t), t


def tree(rng, n, loops=0):
    edges = [(rng.integers(0, k), k, rng.integers(0, 3)) for k in range(1, n)] + [(*sorted(rng.choice(n, 2, replace=False)), 1) for _ in range(loops)]
    return np.array(edges, np.int64).reshape(-1, 3)


def all_labellings(u, edges, pairs):
    n = len(u)
    p, node, edge = [], np.zeros((n, pii.L)), np.zeros((len(edges), pii.L, pii.L))
    states = list(itertools.product(range(pii.L), repeat=n))
    p = np.array([np.exp(sum(u[k, y[k]] for k in range(n)) + sum(pairs[t, y[i], y[j]] for i, j, t in edges)) for y in states])
    p /= p.sum()
    for q, y in zip(p, states):
        node[range(n), y] += q
        for k, (i, j, _) in enumerate(edges):
            edge[k, y[i], y[j]] += q
    return node, edge


def test_beliefs_are_exact_on_trees_and_close_on_circles():
    rng = np.random.default_rng(0)
    for loops, close in ((0, 1e-5), (1, 0.05)):
        u, pairs, edges = rng.normal(size=(5, pii.L)), rng.normal(size=(3, pii.L, pii.L)) * 0.7, tree(rng, 5, loops)
        got = pii.beliefs(u, edges, pairs, 60)
        for a, b in zip(got, all_labellings(u, edges, pairs)):
            assert np.abs(a - b).max() < close


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(2)
    texts = ["call +1 (168) 555-5254 or 1685555254 now", "mail a.1@b.co and a.1[at]b.co", "in 2020 and 4 5 of 6"]
    g = pii.graph([(t, pii.tokens(t), [], pii.base_spans(t)) for t in texts])
    assert {0, 1} <= set(g.edges[:, 2].tolist()) and len(g.first) <= 11
    field = pii.Field(rng.normal(size=(pii.ROWS, pii.L)) * 0.3, rng.normal(size=(pii.L, pii.L)) * 0.3, rng.normal(size=(2, 2)) * 0.3)

    def loss():  # sum over documents would need 5^11 states: the graph falls into runs, taken one by one
        u, pairs, total, seen = field.unary(g), field.pairs(), 0.0, set()
        near = {k: {k} for k in range(len(u))}
        for i, j, _ in g.edges.tolist():
            both = near[i] | near[j]
            for k in both:
                near[k] = both
        for k in range(len(u)):
            if k in seen:
                continue
            part = sorted(near[k])
            seen |= near[k]
            edges = [(part.index(i), part.index(j), t) for i, j, t in g.edges.tolist() if i in near[k]]
            score = lambda y: sum(u[p, y[q]] for q, p in enumerate(part)) + sum(pairs[t, y[i], y[j]] for i, j, t in edges)  # noqa: E731, B023
            total += np.log(sum(np.exp(score(y)) for y in itertools.product(range(pii.L), repeat=len(part)))) - score([g.gold[p] for p in part])
        return total

    grads = pii.gradient(field, g, 80)
    for w, d in zip((field.table, field.trans, field.agree), grads):
        places = np.argwhere(np.abs(d) > 1e-3)
        for at in map(tuple, places[rng.permutation(len(places))[:6]]):
            w[at] += 1e-5
            up = loss()
            w[at] -= 2e-5
            down = loss()
            w[at] += 1e-5
            assert abs((up - down) / 2e-5 - d[at]) < 1e-3 + 0.02 * abs(d[at])


@pytest.fixture(scope="module")
def field():
    rng = random.Random(3)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    card = lambda: next(c for c in iter(lambda: n(16), "") if checksum(c))
    say = lambda: rng.choice([f"u{n(2)}.x@mail{n(1)}.example.com", f"+1 ({n(3)}) 555-{n(4)}", card(), f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.9"])
    return pii.fit([f"the word {say()} stands with {say()} and {n(rng.randint(1, 9))}" for _ in range(200)])


def added(text, field):
    base, every = pii.find([text], field)[0]
    return [text[s:e] for s, e, k in every if (s, e, k) not in base]


def test_mentions_of_a_document_are_labelled_alike(field):
    assert added("ring +1 (168) 555-5254 today. Later: 1685555254, she said", field) == ["1685555254"]
    assert added("a code 1685555254, she said", field) == []
    assert added("ring +1 (168) 555-5254 and 7319408266", field) == []
    far = "ring +1 (168) 555-5254 today " + "and on it goes " * 3000 + "Later: 1685555254, she said"
    assert added(far, field) == ["1685555254"]
    assert added("mail u12.x@mail3.example.com or u12.x [at] mail3 [dot] example [dot] com today", field) == ["u12.x [at] mail3 [dot] example [dot] com"]
    assert added("host 97.51.17.173 that is 97[.]51[.]17[.]173 here", field) == ["97[.]51[.]17[.]173"]


def test_plain_numbers_and_cards_without_a_checksum_are_left_alone(field):
    for t in ("on 2024-05-17 at 12:30 for 1,299.00 in 2023", "isbn 978-3-16-148410-0 of v2.10.3", "number 4412473014894483 twice 4412473014894483", "no digits here", "300.1.1.1 and 1.2.3"):
        assert added(t, field) == []


def test_hubs_have_few_links():
    text = "x 1685555254 " * 500
    g = pii.graph([(text, pii.tokens(text), [], [])])
    assert len(g.first) == 500 and len(g.edges) <= 1000


def test_without_examples_nothing_is_added():
    for texts in ([], ["no sign"], ["only 3 numbers 17 and 2020"]):
        assert added("ring 168-555-5254", pii.fit(texts)) == []


def test_awkward_rows(spark, awkward, nothing, field):
    out = pii.scan(awkward, field, ["doc_id", "kept", "spans"])
    assert out.columns == ["doc_id", "kept", *pii.OUT.fieldNames()]
    got = sorted([(str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out.collect()])
    want = []
    for i, t, *_ in AWKWARD:
        b = plain(t or "")
        want.append((str(i), *(sum(k == x[2] for x in b) for k in pii.KINDS), hashlib.sha256(pii.joined(b).encode()).hexdigest()))
    assert got == sorted(want)
    assert pii.scan(nothing, pii.learn(nothing), ["doc_id"]).count() == 0


def test_long_texts_take_time_in_proportion():
    for t in (long_text(200_000), "a" * 2_000_000, "1" * 400_000, "a.b-" * 300_000 + "@", "[at]" * 100_000, "9 " * 100_000):
        pii.find([t], pii.Field(np.zeros((pii.ROWS, pii.L)), np.zeros((pii.L, pii.L)), np.zeros((2, 2))))


def test_query_on_a_table(spark, sample):
    got = {r.doc_id: r for r in pii.op11_pii(spark, SF).collect()}
    assert len(got) == len(sample)
    for i, t in sample:
        b = plain(t or "")
        assert got[i].base_sha256 == hashlib.sha256(pii.joined(b).encode()).hexdigest()
        assert set(pii.joined(b).split(",")) <= set(got[i].spans.split(","))

"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. The field labels every token that can be personal data at all (one with a digit or an at
sign, also a written-out one); other words have the label O for certain, so the chain falls apart there without
any loss. Neighbouring tokens share learned transitions. Tokens of a document that repeat each other, or are alike (the
same last digits under other separators, one address written out), share skip potentials however far apart they stand:
each is linked to the one before it and to the first of its kind, so a token that occurs k times has at most 2 k links.
Loopy message passing over both kinds of edges, with the base spans as evidence, then decides documents as a whole: a
bare number is reported where the same number stands as a telephone number elsewhere, and is left alone without that.

The field is learned from the base spans of a bounded sample: some mentions are rewritten in forms that the patterns do
not know, or said a second time in such a form, and plain numbers of other uses are added as examples of O.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bedtrace.llm.common import documents, map_text
from bedtrace.llm.langid import SAMPLE_CHARS, training_rows

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
L = len(LABELS)
ROWS = 1 << 14  # of the hashed features
SAMPLE_ROWS = 2000  # bound of the sample the field is learned on
ROUNDS = 20  # of message passing, the same for every document
SURE = 0.8
EPOCHS = 150
CLAMP = 30.0
CHAIN, SAME, ALIKE = 0, 1, 2  # kinds of edges

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NOT_DIGIT = re.compile("[^0-9]+")
WHITE = "\x20\t\n\x0b\x0c\r"
TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
AT = re.compile(r"\x20?[\[(](?:at|AT|@)[\])]\x20?")
REST = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\x20?[\[(](?:dot|DOT|\.)[\])]\x20?)[A-Za-z0-9-]+)+")
SIGN = r"[0-9@]|[\[(](?:at|AT)[\])]"

Span = tuple[int, int, str]


# --- patterns ---------------------------------------------------------------------------------------------------------


def digits(s: str) -> str:
    return NOT_DIGIT.sub("", s)


def luhn(d: str) -> bool:
    back = [int(c) for c in reversed(d)]
    return (sum(back[::2]) + sum(2 * x - 9 * (x > 4) for x in back[1::2])) % 10 == 0


def octets(s: str) -> bool:
    parts = s.split(".")
    return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """Findings of the patterns by start, then kind; leftmost and not overlapping within a kind.

    The local part of an address is walked to the left from its at sign, so a long run of letters costs one look.
    """
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in LOCAL:
            lo -= 1
        m = DOMAIN.match(text, at) if lo < at else None
        if m:
            out.append((lo, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if octets(m[0])]
    out += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if 12 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return _ordered(out)


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


# --- tokens and edges of a document -----------------------------------------------------------------------------------


def tokens(text: str) -> list[tuple[int, int]]:
    """Tokens that can be personal data, without quotes and other marks around them; written-out addresses are one token."""
    spelled, done = [], 0
    for m in AT.finditer(text):
        lo = m.start()
        while lo > done and text[lo - 1] in LOCAL:
            lo -= 1
        rest = REST.match(text, m.end())
        if lo < m.start() and rest:
            spelled.append((lo, rest.end()))
            done = rest.end()
    out, k = list(spelled), 0
    for m in TOKEN.finditer(text):
        while k < len(spelled) and spelled[k][1] <= m.start():
            k += 1
        if k < len(spelled) and spelled[k][0] < m.end():
            continue
        s, e = m.span()
        while s < e and not (text[s].isalnum() or text[s] in "+(["):
            s += 1
        while e > s and not (text[e - 1].isalnum() or text[e - 1] in ")]"):
            e -= 1
        if s < e:
            out.append((s, e))
    return sorted(out)


def shape(core: str) -> str:
    """Runs of digits by length, letters as a; bounded."""
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: f"{min(len(m[0]), 20)};", core[:80]))[:40]


def canonical(core: str) -> str:
    """What two mentions of one thing have in common: the plain address, the dotted number, or the last seven digits."""
    c = re.sub(r"\x20?[\[(](?:at|@)[\])]\x20?", "@", re.sub(r"\x20?[\[(](?:dot|\.)[\])]\x20?", ".", core.lower()))
    if "@" in c or octets(c):
        return c
    d = digits(c)
    if len(d) >= 7 and not any(x.isalpha() for x in c):
        return d[-7:]
    return c if len(c) >= 5 else ""


@dataclass
class Graph:
    """Tokens of some documents: hashed features (flat, with the first place of each token), evidence and edges."""

    feats: np.ndarray
    first: np.ndarray
    clamp: np.ndarray  # label known from a base span, or -1
    gold: np.ndarray  # label to learn
    left: np.ndarray  # no neighbour on this side: the word there is O
    right: np.ndarray
    edges: np.ndarray  # [m, 3]: token, token, kind


def graph(docs: list[tuple[str, list[tuple[int, int]], list[Span], list[Span]]]) -> Graph:
    """``docs``: text, tokens, spans that are evidence, spans to learn."""
    feats, first, clamp, gold, left, right, edges, n_feats = [], [], [], [], [], [], [], 0
    for text, toks, known, wanted in docs:
        base, last, seen = len(first), len(toks) - 1, {}
        joined = [k > 0 and 0 < s - toks[k - 1][1] <= 3 and not text[toks[k - 1][1] : s].strip(WHITE) for k, (s, _) in enumerate(toks)]
        run = np.cumsum([not j for j in joined])
        whole: dict[int, str] = {}
        for k, (s, e) in enumerate(toks):
            whole[run[k]] = (whole.get(run[k], "") + digits(text[s:e]))[-40:]
        shapes = [shape(text[s:e]) for s, e in toks]
        inside = _labels(toks, known, -1)
        for k, (s, e) in enumerate(toks):
            core, all_digits = text[s:e], whole[run[k]]
            d = digits(core)
            word = text[max(0, s - 24) : s].rstrip(WHITE).rsplit(None, 1)
            made = [f"s{shapes[k]}", f"c{core[0]}", f"n{min(len(d), 21)}", f"r{min(len(all_digits), 21)}", f"w{word[-1].lower()[-12:]}" if word else "w",
                    f"p{shapes[k - 1]}" if joined[k] else "p", f"f{shapes[k + 1]}" if k < last and joined[k + 1] else "f", "b"]
            made += [f"l{luhn(d)}"] if 12 <= len(d) <= 19 else []
            made += [f"L{luhn(all_digits)}"] if 12 <= len(all_digits) <= 19 else []
            made += [f"o{octets(canonical(core))}"] if core.count(".") >= 3 else []
            made += ["@"] if "@" in canonical(core) else []
            feats += [zlib.crc32(x.encode()) % ROWS for x in made]
            first.append(n_feats)
            n_feats += len(made)
            left.append(not joined[k])
            right.append(not (k < last and joined[k + 1]))
            if joined[k]:
                edges.append((base + k - 1, base + k, CHAIN))
            ends_run = k == last or not joined[k + 1]
            keys = {canonical(core): SAME} | ({all_digits[-7:]: ALIKE} if ends_run and len(all_digits) >= 9 and len(d) < len(all_digits) else {})
            for key, kind in keys.items():
                if key:
                    head, before = seen.get(key, (None, None))
                    if before is not None:
                        edges.append((before, base + k, kind))
                        if head != before:
                            edges.append((head, base + k, kind))
                    seen[key] = (base + k if head is None else head, base + k)
        clamp += inside
        gold += _labels(toks, wanted, 0)
    arr = lambda x: np.array(x, np.int64)
    return Graph(arr(feats), arr(first), arr(clamp), arr(gold), np.array(left, bool), np.array(right, bool), arr(edges).reshape(-1, 3))


def _labels(toks: list[tuple[int, int]], spans: list[Span], none: int) -> list[int]:
    """Label of the span that a token meets (the first by start), ``none`` where there is no span."""
    out, k, spans = [], 0, sorted(spans)
    for s, e in toks:
        while k < len(spans) and spans[k][1] <= s:
            k += 1
        out.append(LABELS.index(spans[k][2]) if k < len(spans) and spans[k][0] < e else none)
    return out


# --- field ------------------------------------------------------------------------------------------------------------


@dataclass
class Field:
    table: np.ndarray  # [ROWS, L]
    trans: np.ndarray  # [L, L], O at both ends of a run
    agree: np.ndarray  # [2, 2]: edge kind SAME or ALIKE; both O, both the same kind of data

    def pairs(self) -> np.ndarray:
        """Logarithms of the edge potentials, [3, L, L]."""
        out = np.zeros((3, L, L))
        out[CHAIN] = self.trans
        for k in (SAME, ALIKE):
            out[k][np.arange(L), np.arange(L)] = self.agree[k - 1, 1]
            out[k][0, 0] = self.agree[k - 1, 0]
        return out

    def unary(self, g: Graph) -> np.ndarray:
        u = np.add.reduceat(self.table[g.feats], g.first, axis=0) if len(g.first) else np.zeros((0, L))
        u = u + g.left[:, None] * self.trans[0] + g.right[:, None] * self.trans[:, 0]
        at = np.flatnonzero(g.clamp >= 0)
        u[at, g.clamp[at]] += CLAMP
        return u


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def beliefs(u: np.ndarray, edges: np.ndarray, pairs: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of the tokens and of the two ends of each edge, by sum-product message passing.

    All messages are renewed together, half of the old one kept, a fixed number of times. On graphs without a circle
    this reaches the exact marginals when ``rounds`` is a few times the diameter.
    """
    i, j, psi = edges[:, 0], edges[:, 1], pairs[edges[:, 2]]
    to_j, to_i = np.zeros((len(edges), L)), np.zeros((len(edges), L))

    def total() -> np.ndarray:
        b = u.copy()
        for c in range(L):
            b[:, c] += np.bincount(j, to_j[:, c], len(u)) + np.bincount(i, to_i[:, c], len(u))
        return b

    for _ in range(rounds if len(edges) else 0):
        b = total()
        new_j = _log_sum((b[i] - to_i)[:, :, None] + psi, 1)
        new_i = _log_sum((b[j] - to_j)[:, None, :] + psi, 2)
        to_j = 0.5 * to_j + 0.5 * (new_j - new_j.max(1, keepdims=True))
        to_i = 0.5 * to_i + 0.5 * (new_i - new_i.max(1, keepdims=True))
    b = total()
    both = (b[i] - to_i)[:, :, None] + (b[j] - to_j)[:, None, :] + psi
    soft = lambda x, ax: np.exp(x - x.max(ax, keepdims=True)) / np.exp(x - x.max(ax, keepdims=True)).sum(ax, keepdims=True)
    return soft(b, 1), soft(both, (1, 2))


def gradient(field: Field, g: Graph, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected minus observed features, for table, trans and agree; expectations from the beliefs."""
    node, edge = beliefs(field.unary(g), g.edges, field.pairs(), rounds)
    diff = node.copy()
    diff[np.arange(len(node)), g.gold] -= 1
    width = np.diff(np.append(g.first, len(g.feats)))
    spread = np.repeat(diff, width, axis=0)
    table = np.stack([np.bincount(g.feats, spread[:, c], ROWS) for c in range(L)], 1)
    trans = np.zeros((L, L))
    trans[0] += diff[g.left].sum(0)
    trans[:, 0] += diff[g.right].sum(0)
    e = edge.copy()
    e[np.arange(len(e)), g.gold[g.edges[:, 0]], g.gold[g.edges[:, 1]]] -= 1
    trans += e[g.edges[:, 2] == CHAIN].sum(0)
    agree = np.zeros((2, 2))
    for k in (SAME, ALIKE):
        s = np.einsum("eyy->y", e[g.edges[:, 2] == k]) if (g.edges[:, 2] == k).any() else np.zeros(L)
        agree[k - 1] = s[0], s[1:].sum()
    return table, trans, agree


# --- examples ---------------------------------------------------------------------------------------------------------


def _rewritten(s: str, kind: str, rng: random.Random, linked: bool) -> str:
    """The same thing in a form that the patterns do not know."""
    d = digits(s)
    if kind == "email":
        at, dot = rng.choice(["[at]", "(at)", " [at] ", " (at) "]), rng.choice([".", " [dot] ", "[dot]"])
        local, _, domain = s.partition("@")
        return local + at + domain.replace(".", dot)
    if kind == "ip":
        return s.replace(".", rng.choice(["[.]", "(.)"]))
    if kind == "card":
        sep = rng.choice([".", "_", "/"])
        return sep.join(d[k : k + 4] for k in range(0, len(d), 4))
    if linked and rng.random() < 0.5:
        return d[-10:] if rng.random() < 0.5 else d
    return rng.choice([f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}.{d[-7:-4]}.{d[-4:]}", f"00{d[:-10] or 1} {d[-10:-7]} {d[-7:-4]}-{d[-4:]}"])


def _plain_number(rng: random.Random) -> str:
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    return rng.choice([
        n(rng.randint(1, 20)), f"20{n(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.20{n(2)}", f"{n(2)}:{n(2)}", f"{n(2)}:{n(2)}:{n(2)}",
        f"v{n(1)}.{n(2)}.{n(1)}", f"{n(1)}.{n(1)}", f"{n(1)},{n(3)}.{n(2)}", f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}", f"{n(4)}-{n(4)}", f"No.{n(5)}", f"A{n(2)}-{n(5)}", f"{n(3)}.{n(3)}.{n(3)}.{n(3)}.{n(2)}",
        f"x{n(8)}f", f"({n(4)})", f"{n(2)}%", f"+{n(2)}", f"@{n(4)}", f"#{n(6)}", f"{n(3)}-{n(2)}-{n(4)}", f"{n(16)}", f"{n(10)}", f"{n(11)}",
    ])


def examples(texts: list[str], seed: int = 5) -> list[tuple[str, list[tuple[int, int]], list[Span], list[Span]]]:
    """Documents to learn from: as they are, and with mentions rewritten, repeated and mixed with plain numbers."""
    rng, out = random.Random(seed), []
    for text in texts:
        spans = base_spans(text)
        out.append((text, tokens(text), [], spans))
        if not spans:
            continue
        made, labels, known, at, again = [], [], [], 0, []
        size = lambda: sum(map(len, made))
        for s, e, kind in spans:
            if s < at:
                continue
            made.append(text[at:s])
            old = text[s:e]
            way = rng.random()
            new = _rewritten(old, kind, rng, False) if way < 0.3 else old
            lo = size()
            made.append(new)
            labels.append((lo, lo + len(new), kind))
            if new == old:
                known.append(labels[-1])
                if way < 0.8:
                    again.append((kind, _rewritten(old, kind, rng, True) if rng.random() < 0.8 else old))
            at = e
        made.append(text[at:])
        for kind, said in again:
            made.append(rng.choice([" and ", "\n", ", then "]))
            lo = size()
            made.append(said)
            labels.append((lo, lo + len(said), kind))
            made.append(rng.choice([" so ", " it "]))
        for _ in range(rng.randint(0, 4)):
            made.append(f" {rng.choice(['of', 'in', 'no'])} {_plain_number(rng)} or ")
        new = "".join(made)
        out.append((new, tokens(new), known, labels))
    for _ in range(min(400, 4 * len(texts))):
        new = " and ".join(_plain_number(rng) for _ in range(rng.randint(1, 6)))
        out.append((new, tokens(new), [], base_spans(new)))
    return out


def fit(texts: list[str], epochs: int = EPOCHS) -> Field:
    """Weights by AdaGrad on the gradient of the beliefs. Without examples all weights are 0: nothing is added then."""
    field = Field(np.zeros((ROWS, L)), np.zeros((L, L)), np.full((2, 2), 0.5))
    g = graph(examples(texts))
    if not len(g.first) or not (g.gold > 0).any():
        return Field(field.table, field.trans, np.zeros((2, 2)))
    sums = [np.full_like(w, 1e-2) for w in (field.table, field.trans, field.agree)]
    for _ in range(epochs):
        for w, s, d in zip((field.table, field.trans, field.agree), sums, gradient(field, g)):
            d = d + 0.01 * w
            s += d * d
            w -= 0.3 * d / np.sqrt(s)
    return field


# --- whole texts ------------------------------------------------------------------------------------------------------


def _possible(kind: str, core: str) -> bool:
    """Whether a run of tokens can be of its kind at all."""
    d = digits(core)
    return {"email": "@" in canonical(core), "ip": octets(canonical(core)), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 7 <= len(d) <= 15}[kind]


def find(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """Base spans, and base and added spans together, of each text. Texts do not influence each other."""
    docs = []
    for t in texts:
        b = base_spans(t)
        docs.append((t, tokens(t), b, b))
    g = graph(docs)
    node, _ = beliefs(field.unary(g), g.edges, field.pairs())
    best = node.argmax(1)
    sure = (best > 0) & (node[np.arange(len(node)), best] >= SURE) & (g.clamp < 0) if len(node) else np.zeros(0, bool)
    out, at = [], 0
    for text, toks, base, _ in docs:
        more, k = [], 0
        while k < len(toks):
            if not sure[at + k]:
                k += 1
                continue
            to = k + 1
            while to < len(toks) and sure[at + to] and best[at + to] == best[at + k] and not g.left[at + to]:
                to += 1
            s, e, kind = toks[k][0], toks[to - 1][1], LABELS[best[at + k]]
            if _possible(kind, text[s:e]):
                more.append((s, e, kind))
            k = to
        out.append((base, _ordered(base + more)))
        at += len(toks)
    return out


OUT = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(df: DataFrame, field: Field, cols: list[str], text: str = "text") -> DataFrame:
    """``cols`` of every row with n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and all spans.

    Null or empty text: no spans (the hash is that of no bytes). Each row is judged for itself, so repeated rows get
    equal results and an empty table gives an empty one. Spans of equal start go by kind. Columns of ``cols`` named
    like an output give way to it; other columns are left behind.
    """
    nothing = hashlib.sha256(b"").hexdigest()

    def run(arr: pa.Array) -> list:
        n = len(arr)
        counts = {k: np.zeros(n, np.int64) for k in KINDS}
        digest, spans = [nothing] * n, [""] * n
        rows = np.flatnonzero(pc.match_substring_regex(arr, SIGN).to_numpy(zero_copy_only=False)).tolist()
        for at in range(0, len(rows), 64):
            part = rows[at : at + 64]
            for i, (base, every) in zip(part, find([arr[i].as_py() for i in part], field)):
                for _, _, k in base:
                    counts[k][i] += 1
                digest[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                spans[i] = joined(every)
        return [*counts.values(), digest, spans]

    return map_text(df, cols, text, OUT, run)


def learn(df: DataFrame, text: str = "text") -> Field:
    """The field learned on at most SAMPLE_ROWS texts with a sign of personal data, of at most SAMPLE_CHARS characters,
    chosen by a hash; equal texts count once."""
    src = df.select(F.col(f"`{text}`").alias("text")).filter(F.col("text").rlike(SIGN))
    sample = training_rows(src, src.count(), SAMPLE_ROWS, SAMPLE_CHARS).toPandas()
    return fit(sorted(set(sample["text"])))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scan(docs, learn(docs), ["doc_id"])

"""Language of whole texts by a linear-chain conditional random field over words.

Each word has a potential for each language: the sum of learned weights of its prefixes, suffixes and n-grams (hashed
rows) plus learned multiples of its lexicon log-odds. Learned transition weights tie neighbouring words, and
forward-backward gives each word the probability of each language in its surroundings, also where a text switches
between languages. The language of a text is the one with the largest mean probability over its words with letters.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bedtrace.llm.common import WHITE, doc_counts, documents, map_text, text_bytes, words_of
from bedtrace.llm.subwords import Grams

GRAMS = Grams((1, 2, 3, 4), 1 << 17)
SAMPLE_ROWS = 2000  # bound of the labelled sample that the model is fitted on
SAMPLE_CHARS = 20_000  # longer texts are not used for the fit
LEXICON_WORDS = 20_000
BLOCK = 64
PART = 4 << 20  # bytes of text that are worked on together
EPOCHS = 3
HAS_LETTER = np.zeros(256, bool)
HAS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # [rows + 1, languages]
    bias: np.ndarray
    trans: np.ndarray
    lex_hash: np.ndarray  # sorted word hashes
    lex_odds: np.ndarray  # [words, languages]
    lex_weight: float

    def potentials(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """[words, languages]; words without a letter say nothing."""
        e, pick, which = GRAMS.distinct_sums(self.table, data, starts, lens, hashes)
        e += self.bias
        k = np.minimum(np.searchsorted(self.lex_hash, hashes[pick]), len(self.lex_hash) - 1)
        known = self.lex_hash[k] == hashes[pick]
        e[known] += self.lex_weight * self.lex_odds[k[known]]
        e[~lettered(data, starts[pick], lens[pick])] = 0
        return e[which]


def lettered(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Words with a letter; bytes of characters beyond ASCII count as letters here."""
    before = np.append(0, np.cumsum(HAS_LETTER[data], dtype=np.int64))
    return before[starts + lens] > before[starts]


def _norm(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(-1, keepdims=True), 1e-30)


def marginals(e: np.ndarray, counts: np.ndarray, trans: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Probability of each language for each word by forward-backward, for texts of ``counts`` words each.

    Texts are cut into blocks. The product of the transfer matrices of each block carries messages from block to block
    of a text; inside the blocks all texts go on in step. Work is in proportion to the words, memory as well.
    """
    if not len(e):
        return e
    langs = e.shape[1]
    a = np.exp(trans).astype(np.float32)
    blocks = -(-counts // block)
    nb = int(blocks.sum())
    doc = np.repeat(np.arange(len(counts)), blocks)
    first_block = np.cumsum(blocks) - blocks
    no = np.arange(nb) - first_block[doc]
    word = np.arange(len(e)) - np.repeat(np.cumsum(counts) - counts, counts)
    wb, wt = np.repeat(first_block, counts) + word // block, word % block
    size = np.minimum(counts[doc] - no * block, block)
    x = np.ones((block, nb, langs), np.float32)
    x[wt, wb] = np.exp(e - e.max(1, keepdims=True))
    live = np.arange(block)[:, None] < size  # [block, nb]

    into = np.full((nb, langs), 1 / langs, np.float32)  # forward message before a block, transition not yet applied
    back = np.full((nb, langs), 1, np.float32)
    start = no == 0
    if (blocks > 1).any():
        p = np.broadcast_to(np.eye(langs, dtype=np.float32), (nb, langs, langs)).copy()
        for t in range(block):
            step = (p @ a) * x[t][:, None, :]
            step /= np.maximum(step.max((1, 2), keepdims=True), 1e-30)
            p = np.where(live[t][:, None, None], step, p)
        for j in range(1, int(blocks.max())):
            k = np.flatnonzero(no == j) if j < 64 else (first_block[blocks > j] + j)
            into[k] = _norm(np.einsum("bi,bij->bj", into[k - 1], p[k - 1]))
            r = first_block[blocks > j] + blocks[blocks > j] - 1 - j  # from the right end
            back[r] = _norm(np.einsum("bij,bj->bi", p[r + 1], back[r + 1]))
    fwd = np.empty_like(x)
    m = into
    for t in range(block):
        m = np.where(live[t][:, None], _norm((m @ a) * x[t]), m)
        fwd[t] = m
    m = back
    for t in range(block - 1, -1, -1):
        fwd[t] = _norm(fwd[t] * m)
        m = np.where(live[t][:, None], _norm((x[t] * m) @ a.T), m)
    return fwd[wt, wb]


def _pieces(rng: np.random.Generator, lang: np.ndarray, counts: np.ndarray, block: int) -> list[np.ndarray]:
    """Training sequences: stretches of words of the sample, every second one spliced with a stretch of another text, so
    that the transitions see switches."""
    begin = np.cumsum(counts) - counts
    out = []
    for d in rng.permutation(len(counts)).tolist():
        for s in range(0, int(counts[d]), block):
            seq = np.arange(begin[d] + s, begin[d] + min(s + block, int(counts[d])))
            if rng.random() < 0.5:
                o = int(rng.integers(len(counts)))
                cut, n = int(rng.integers(len(seq) + 1)), int(counts[o])
                if n:
                    at = int(rng.integers(n))
                    seq = np.append(seq[:cut], np.arange(begin[o] + at, begin[o] + min(n, at + block - cut)))
            out.append(seq)
    return out


def fit(texts: list[str], langs: list[str], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Maximum likelihood by AdaGrad over batches of sequences, gradients by forward-backward.

    Texts without a word teach nothing; without any other text the model knows no language.
    """
    texts, langs = ([x for x, t in zip(xs, texts) if t.strip(WHITE)] for xs in (texts, langs))
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((GRAMS.rows + 1, 0), np.float32), np.zeros(0, np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.uint64), np.zeros((0, 0), np.float32), 0.0)
    k = len(names)
    lang = np.array([names.index(x) for x in langs])
    arr = pa.array(texts, pa.string())
    data, offs = text_bytes(arr)
    starts, lens, hashes = words_of(data, offs)
    counts = doc_counts(starts, offs)
    label = np.repeat(lang, counts)
    used = lettered(data, starts, lens)
    # lexicon: log-odds of the words of the sample, those that say most first
    seen = Counter(zip(hashes.tolist(), label.tolist()))
    words = np.array(sorted({h for h, _ in seen}), np.uint64)
    n = np.zeros((len(words), k))
    for (h, y), c in seen.items():
        n[np.searchsorted(words, np.uint64(h)), y] = c
    odds = np.log(n + 0.5) - np.log(n.sum(1, keepdims=True) + 0.5 * k) - np.log((n.sum(0) + 1) / (n.sum() + k))
    odds -= odds.mean(1, keepdims=True)
    top = np.sort(np.argsort(-(n.sum(1) * np.abs(odds).max(1)), kind="stable")[:LEXICON_WORDS])
    # distinct words carry the features
    uniq, pick, word_id = np.unique(hashes, return_index=True, return_inverse=True)
    rows, begin = GRAMS.places(data, starts[pick], lens[pick])
    width = np.diff(np.append(begin, rows.shape[1]))
    in_lex = np.isin(uniq, words[top])
    lex = np.zeros((len(uniq), k), np.float32)
    lex[in_lex] = odds[np.searchsorted(words, uniq[in_lex])]

    m = Model(names, np.zeros((GRAMS.rows + 1, k), np.float32), np.zeros(k, np.float32), np.zeros((k, k), np.float32), words[top], odds[top].astype(np.float32), 0.1)
    g_table, g_trans, g_bias, g_lex = np.full_like(m.table, 1e-3), np.full_like(m.trans, 1e-3), np.full(k, 1e-3), 1e-3
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        seqs = _pieces(rng, lang, counts, BLOCK)
        for at in range(0, len(seqs), 256):
            part = seqs[at : at + 256]
            idx, sizes = np.concatenate(part), np.array([len(s) for s in part])
            if not len(idx):
                continue
            ws, local = np.unique(word_id[idx], return_inverse=True)
            take = np.concatenate([np.arange(begin[w], begin[w] + width[w]) for w in ws])
            cut = np.cumsum(width[ws]) - width[ws]
            r = rows[:, take]
            e = (np.add.reduceat(sum(m.table[x] for x in r), cut, axis=0) + m.bias + m.lex_weight * lex[ws])[local]
            e[~used[idx]] = 0
            post = marginals(e, sizes, m.trans)
            diff = post.copy()
            diff[np.arange(len(idx)), label[idx]] -= 1
            diff[~used[idx]] = 0
            # transitions: pairs inside a sequence, with the pair probability taken from the neighbours' marginals
            inner = np.flatnonzero(np.repeat(np.arange(len(sizes)), sizes)[1:] == np.repeat(np.arange(len(sizes)), sizes)[:-1])
            pair = _pair_sums(e, sizes, m.trans)
            true = np.zeros((k, k))
            np.add.at(true, (label[idx][inner], label[idx][inner + 1]), 1)
            d_trans = (pair - true) / len(idx)
            d_word = np.stack([np.bincount(local, diff[:, c], len(ws)) for c in range(k)], 1) / len(idx)
            spread = np.repeat(d_word, width[ws], axis=0)
            grad = np.zeros_like(m.table)
            for x in r:
                for c in range(k):
                    grad[:, c] += np.bincount(x, spread[:, c], GRAMS.rows + 1)
            grad[GRAMS.rows] = 0
            d_lex = float((d_word * lex[ws]).sum())
            for w, g, d in ((m.table, g_table, grad), (m.trans, g_trans, d_trans), (m.bias, g_bias, d_word.sum(0))):
                g += d * d
                w -= 0.2 * d / np.sqrt(g)
            g_lex += d_lex**2
            m.lex_weight -= 0.05 * d_lex / g_lex**0.5
    return m


def _pair_sums(e: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Expected number of each transition, over sequences of at most BLOCK words."""
    k, n = e.shape[1], int(sizes.max())
    a = np.exp(trans)
    x = np.ones((n, len(sizes), k))
    t = np.arange(len(e)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    x[t, np.repeat(np.arange(len(sizes)), sizes)] = np.exp(e - e.max(1, keepdims=True))
    live = np.arange(n)[:, None] < sizes
    f = np.empty_like(x)
    msg = np.full((len(sizes), k), 1 / k)
    for i in range(n):
        msg = np.where(live[i][:, None], _norm((msg @ a) * x[i]), msg)
        f[i] = msg
    total, back = np.zeros((k, k)), np.ones((len(sizes), k))
    for i in range(n - 1, 0, -1):
        joint = f[i - 1][:, :, None] * a * (x[i] * back)[:, None, :]
        joint /= np.maximum(joint.sum((1, 2), keepdims=True), 1e-30)
        total += joint[live[i]].sum(0)
        back = np.where(live[i][:, None], _norm((x[i] * back) @ a.T), back)
    return total


OUT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predict(df: DataFrame, model: Model, cols: list[str], text: str = "text") -> DataFrame:
    """``cols`` of every row with lang_pred and score (mean probability of that language over words with letters).

    Null or empty text and text without a letter: ``und`` with score 1.0. A model that knows no language (an empty table,
    no labels, or only blank labelled texts) gives ``und`` everywhere, with score 0.0 for texts with letters. Ties go to the first language by name.
    Repeated rows are predicted row by row; columns of ``cols`` named like an output give way to it.
    """

    def text_sums(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the language probabilities over the words with letters of each text, and the number of these words."""
        starts, lens, hashes = words_of(data, offs)
        counts = doc_counts(starts, offs)
        used = lettered(data, starts, lens)
        n = len(offs) - 1
        mean, has = np.zeros((n, len(model.langs))), np.zeros(n, np.int64)
        ends = np.cumsum(counts)
        d = 0
        while d < n:  # texts together up to about 300,000 words
            to = max(d + 1, int(np.searchsorted(ends, (ends[d - 1] if d else 0) + 300_000, "right")))
            w = slice(int(ends[d - 1]) if d else 0, int(ends[to - 1]))
            post = marginals(model.potentials(data, starts[w], lens[w], hashes[w]), counts[d:to], model.trans)
            doc = np.repeat(np.arange(d, to), counts[d:to])
            for c in range(len(model.langs)):
                mean[:, c] += np.bincount(doc[used[w]], post[used[w], c], n)
            has += np.bincount(doc[used[w]], minlength=n)
            d = to
        return mean, has

    def run(arr: pa.Array) -> list:
        data, offs = text_bytes(arr)
        if not model.langs:
            none = _no_ascii_letter(data, offs)
            return [["und"] * len(arr), [float(n and not any(c.isalpha() for c in t.as_py())) for n, t in zip(none.tolist(), arr)]]
        mean = np.zeros((len(arr), len(model.langs)))
        has = np.zeros(len(arr), np.int64)
        first = 0
        while first < len(arr):  # some texts of the batch at a time: memory follows PART (or the longest text)
            last = max(first + 1, int(np.searchsorted(offs, offs[first] + PART, "right")) - 1)
            mean[first:last], has[first:last] = text_sums(data[offs[first] : offs[last]], offs[first : last + 1] - offs[first])
            first = last
        best = mean.argmax(1)
        score = np.clip(mean[np.arange(len(arr)), best] / np.maximum(has, 1), 0, 1)
        langs = [model.langs[b] for b in best]
        ascii_only = np.zeros(len(arr), bool)
        for i in np.flatnonzero(_no_ascii_letter(data, offs)).tolist():
            ascii_only[i] = not any(c.isalpha() for c in arr[i].as_py())
        return [["und" if u else x for x, u in zip(langs, ascii_only)], np.where(ascii_only, 1.0, score)]

    return map_text(df, cols, text, OUT, run)


def _no_ascii_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    letters = HAS_LETTER.copy()
    letters[128:] = False
    before = np.append(0, np.cumsum(letters[data], dtype=np.int64))
    return before[offs[1:]] == before[offs[:-1]]


def remainder(key: Column, by: int) -> Column:
    return F.crc32(key.cast("string")) % by


def training_rows(df: DataFrame, total: int, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, text: str = "text") -> DataFrame:
    """A bounded sample of at most ``rows`` rows, with texts of at most ``chars`` characters.

    ``total`` is the number of rows of ``df``. A hash over all columns first keeps a share of somewhat more than
    ``rows`` of them, so that what is then ordered and sent to the driver does not grow with the table.
    """
    at = F.pmod(F.xxhash64(*df.columns), F.lit(1 << 30))
    share = min(1.0, (1.3 * rows + 100) / max(total, 1))
    ok = df.filter((at < int(share * (1 << 30)) + 1) & F.col(text).isNotNull() & (F.length(text) <= chars))
    return ok.orderBy(at, text).limit(rows)


def per_class(counts: dict[str, int], rows: int) -> dict[str, int]:
    """Shares of ``rows`` as even as the classes allow: a small class keeps all it has, the others divide the rest."""
    out, left = {}, rows
    for k, (c, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[c] = min(n, left // (len(counts) - k))
        left -= out[c]
    return out


def class_sample(df: DataFrame, label: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, text: str = "text", classes: int = 200) -> DataFrame:
    """At most ``rows`` rows (text, label) of at most ``chars`` characters, spread evenly over the labels.

    Rare labels are drawn whole, so a label is learned however small its share of the table is; of more than ``classes``
    labels the commonest are taken. The draw is by a hash of the text, and equal texts of a label count once, so a group
    of copies takes one place. A share of each label is kept before anything is ordered: what is ordered does not grow
    with the table.
    """
    ok = df.select(F.col(text).alias("text"), F.col(label).alias("label")).filter(F.col("text").isNotNull() & F.col("label").isNotNull() & (F.length("text") <= chars))
    found = {r["label"]: r["n"] for r in ok.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(classes).collect()}
    quota = per_class(found, rows)
    wanted = [(c, int(min(1.0, (4 * q + 100) / found[c]) * (1 << 30)) + 1, q) for c, q in quota.items() if q]
    if not wanted:
        return ok.limit(0)
    table = df.sparkSession.createDataFrame(wanted, T.StructType([ok.schema["label"], T.StructField("top", T.LongType()), T.StructField("quota", T.LongType())]))
    at = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    drawn = ok.join(F.broadcast(table), "label").withColumn("at", at).filter("at < top").groupBy("label", "text", "at", "quota").agg(F.count("*").alias("copies"))
    ranked = drawn.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("at", "text")))
    return ranked.filter("k <= quota").select("text", "label").orderBy("label", "text")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    sample = class_sample(docs.filter(~held), "lang").toPandas()
    model = fit(sample["text"].tolist(), sample["label"].tolist())
    return predict(docs, model, ["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", "score")

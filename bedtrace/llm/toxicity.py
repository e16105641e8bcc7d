"""Toxicity of whole texts: averaged subword embeddings under a linear softmax, trained jointly in numpy.

The vector of a word is the mean of the vectors of its character n-grams and of the word itself, so a misspelling that
was never seen shares most of its vector with the word it comes from. A bag is a stretch of ``WINDOW`` words; its vector
is the mean of its words', and a linear softmax turns it into class probabilities. A text is as toxic as its most toxic
bag. The fit starts with whole texts as bags and goes on with the most toxic bag of each text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bedtrace.llm.common import doc_counts, documents, labels, map_text, text_bytes, words_of
from bedtrace.llm.langid import remainder, training_rows
from bedtrace.llm.subwords import Grams

GRAMS = Grams((3, 4, 5), 1 << 17)
SAMPLE_ROWS = 4000  # bound of the labelled sample
SAMPLE_CHARS = 20_000
DIM = 8
WINDOW = 4
MIN_TEXTS = 4  # n-grams and words of fewer texts of the sample say nothing: they would only learn noise in the labels
DECAY = 1e-6
DROP = 0.7
THRESHOLD = 0.3


@dataclass
class Model:
    gain: np.ndarray  # [rows + 1, 1]: embedding times the difference of the class weights
    bias: float

    def word_scores(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        total, pick, which = GRAMS.distinct_sums(self.gain, data, starts, lens, hashes)
        own = self.gain[GRAMS.word_rows(hashes[pick]), 0]
        return ((total[:, 0] + own) / (GRAMS.counts(lens[pick]) + 1))[which]

    def scores(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        top, _, _ = best_bags(words, counts)
        return 1 / (1 + np.exp(-np.clip(top + self.bias, -50, 50)))


def best_bags(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest mean over the bags of each text, and the first and last word (exclusive) of that bag.

    Bags are all stretches of WINDOW words, or the text itself when it is shorter; a text without words gets 0.
    """
    end = np.cumsum(counts)
    begin = end - counts
    total = np.append(0.0, np.cumsum(words, dtype=np.float64))
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(words))
    to = np.minimum(at + WINDOW, end[doc])
    full = (to - at == WINDOW) | (at == begin[doc])
    mean = np.where(full, (total[to] - total[at]) / np.maximum(to - at, 1), -np.inf)
    top, first, last = np.zeros(len(counts)), begin.copy(), begin.copy()
    has = np.flatnonzero(counts)
    if len(has):
        top[has] = np.maximum.reduceat(mean, begin[has])
        hit = np.flatnonzero(mean == top[doc])
        d, k = np.unique(doc[hit], return_index=True)
        first[d], last[d] = hit[k], to[hit[k]]
    return top, first, last


def fit(texts: list[str], toxic: np.ndarray, steps: int = 200, seed: int = 7) -> Model:
    """Adam on the mean logistic loss; the first quarter of the steps takes whole texts as bags."""
    data, offs = text_bytes(pa.array(texts, pa.string()))
    starts, lens, hashes = words_of(data, offs)
    counts = doc_counts(starts, offs)
    if not len(starts):
        return Model(np.zeros((GRAMS.rows + 1, 1), np.float32), float(np.log((toxic.sum() + 0.5) / (len(toxic) - toxic.sum() + 0.5))) if len(toxic) else -1.0)
    uniq, pick, word_id = np.unique(hashes, return_index=True, return_inverse=True)
    rows, begin = GRAMS.places(data, starts[pick], lens[pick])
    width = np.diff(np.append(begin, rows.shape[1]))
    own = GRAMS.word_rows(uniq)
    share = 1 / (GRAMS.counts(lens[pick]) + 1)
    common = _common_rows(rows, begin, width, own, word_id, counts)
    rows = np.where(common[rows], rows, GRAMS.rows)
    own = np.where(common[own], own, GRAMS.rows)
    end = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts)

    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (GRAMS.rows + 1, DIM))
    emb[GRAMS.rows] = 0
    w = rng.normal(0, 0.5, (2, DIM))
    b = np.zeros(2)
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (emb, w, b)]
    y = toxic.astype(float)
    for step in range(1, steps + 1):
        u = emb @ (w[1] - w[0])
        score = (sum(np.add.reduceat(u[r], begin) for r in rows) + u[own]) * share
        if step > steps // 4:  # half of the words are left out, else one word of a text would learn for all its toxic words
            score = np.where(rng.random(len(uniq)) < DROP, 0.0, score)
        words = score[word_id]
        if step <= steps // 4:
            logit = np.bincount(doc, words, len(counts)) / np.maximum(counts, 1) * 20
        else:
            logit, first, last = best_bags(words, counts)
        p = 1 / (1 + np.exp(-np.clip(logit + b[1] - b[0], -50, 50)))
        d = (p - y) / len(y)
        if step <= steps // 4:
            coef = np.bincount(word_id, (d * 20 / np.maximum(counts, 1))[doc], len(uniq))
        else:
            n = last - first
            place = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            coef = np.bincount(word_id[place], np.repeat(d / np.maximum(n, 1), n), len(uniq))
            coef[score == 0] = 0
        coef = coef * share
        c = np.bincount(own, coef, GRAMS.rows + 1)
        hit = np.flatnonzero(coef)  # only words of the bags pass a gradient on
        size = width[hit]
        place = np.repeat(begin[hit] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        spread = np.repeat(coef[hit], size)
        for r in rows:
            c += np.bincount(r[place], spread, GRAMS.rows + 1)
        c[GRAMS.rows] = 0
        g_w = c @ emb
        grads = (c[:, None] * (w[1] - w[0]) + DECAY * emb, np.stack([-g_w, g_w]) + 1e-5 * w, np.array([-d.sum(), d.sum()]))
        for x, (m1, m2), g in zip((emb, w, b), state, grads):
            m1 *= 0.9
            m1 += 0.1 * g
            m2 *= 0.99
            m2 += 0.01 * g * g
            x -= 0.03 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return Model((emb @ (w[1] - w[0])).astype(np.float32)[:, None], float(b[1] - b[0]))


def _common_rows(rows: np.ndarray, begin: np.ndarray, width: np.ndarray, own: np.ndarray, word_id: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rows of the table that occur in MIN_TEXTS texts at least (a text counts once for each distinct word of it)."""
    doc = np.repeat(np.arange(len(counts)), counts)
    in_texts = np.bincount(np.unique(doc * len(begin) + word_id) % len(begin), minlength=len(begin))
    n = np.bincount(own, in_texts, GRAMS.rows + 1)
    for r in rows:
        n += np.bincount(r, np.repeat(in_texts, width), GRAMS.rows + 1)
    ok = n >= MIN_TEXTS
    ok[GRAMS.rows] = False
    return ok


OUT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def score_texts(df: DataFrame, model: Model, cols: list[str], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``cols`` of every row with score and predicted (1 from ``threshold`` on).

    Null and empty texts and texts without words get the score of an empty bag. Repeated rows are scored row by row;
    an empty table gives an empty result; columns of ``cols`` named like an output give way to it.
    """

    def run(arr: pa.Array) -> list:
        data, offs = text_bytes(arr)
        starts, lens, hashes = words_of(data, offs)
        s = model.scores(model.word_scores(data, starts, lens, hashes), doc_counts(starts, offs))
        return [s, (s >= threshold).astype(np.int32)]

    return map_text(df, cols, text, OUT, run)


def chosen(marks: DataFrame, rows: int) -> DataFrame:
    """At most twice ``rows`` of the labels, by a hash of the id: a bounded side for the join with the texts."""
    share = min(1.0, (1.3 * rows + 100) / max(marks.count(), 1))
    at = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30))
    return marks.filter(at < int(share * (1 << 30)) + 1).orderBy(at, "doc_id").limit(2 * rows)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    marks = labels(spark, sf_dir).filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.filter(remainder(F.col("doc_id"), 4) != 2)
    labelled = docs.filter(~held).select("doc_id", "text").join(F.broadcast(chosen(marks, SAMPLE_ROWS)), "doc_id")
    sample = training_rows(labelled, 0, SAMPLE_ROWS, SAMPLE_CHARS).toPandas()
    model = fit(sample["text"].tolist(), sample["toxic"].to_numpy())
    return score_texts(docs, model, ["doc_id"]).select("doc_id", held.alias("held_out"), "score", "predicted")

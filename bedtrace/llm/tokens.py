"""Token counts with overlap resynchronisation for huge documents.

A byte-level tokenizer cuts a text from left to right into pre-tokens (a word with its space, a run of digits, ...) and
merges bytes inside each of them only. What follows a pre-token border therefore depends on the text behind the border
alone. So when two overlapping chunks both have a pre-token border at the same place, and the left one is right up to
there, the right one is right from there on: the place is a proven common border and the two are spliced there. Borders
nearer than ``guard`` characters to the end of the left chunk are not used, since the cut may have changed them (a
contraction or an added token that the cut splits is shorter than the guard). A pair of chunks without a common border
(a single giant word, for example) is encoded again with wider overlaps until one is found or the chunk is the text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bedtrace.llm.common import documents, kept_object, map_text
from bedtrace.session import cut_lineage

CHUNK_CHARS = 65_536
OVERLAP = 2_048
LIMIT = 512
# Letters, digits and spaces of these code points are the same in every Unicode version that the libraries carry.
UNUSUAL = re.compile("[^\x00-ɏ]")


def _byte_letters() -> dict[str, int]:
    """Character that stands for each byte in the vocabulary of a byte-level tokenizer."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a text as the tokenizers library gives them, for a byte-level BPE file.

    The ids come from tiktoken with the vocabulary of the same file, which is the same merge procedure and several times
    faster; a text with characters outside Latin, where the Unicode tables of the two libraries could differ, and the
    chunks of huge texts go to tokenizers itself. Files of another build always go to tokenizers.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, processors

        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [a["content"] for a in spec["added_tokens"]]
        self.guard = max([3, *map(len, added)]) + 4
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.fast = None
        if pre.get("type") == "ByteLevel" and model["type"] == "BPE" and not spec.get("normalizer") and not pre.get("add_prefix_space"):
            self.exact.post_processor = processors.ByteLevel(trim_offsets=False)  # offsets with the leading space
            import tiktoken

            letters = _byte_letters()
            special = {a["content"]: a["id"] for a in spec["added_tokens"]}
            ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
            pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
            order = [model["vocab"].get(m) for m in merged]
            if pre.get("use_regex", True) and all(a["special"] and not a["lstrip"] and not a["rstrip"] and not a["single_word"] for a in spec["added_tokens"]):
                if None not in order and all(a < b for a, b in zip(order, order[1:])):
                    self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> list[int]:
        if self.fast is not None and not UNUSUAL.search(text):
            return self.fast.encode(text, allowed_special="all")
        return self.exact.encode(text, add_special_tokens=False).ids

    def borders(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids, and the place (in code points) and token number of each pre-token border, by tokenizers with offsets."""
        e = self.exact.encode(text, add_special_tokens=False)
        if not e.ids:
            return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        word = np.array([-1 if w is None else w for w in e.word_ids])
        new = np.append(True, (word[1:] != word[:-1]) | (word[1:] < 0) | (word[:-1] < 0))
        k = np.flatnonzero(new)
        return e.ids, np.array([s for s, _ in e.offsets], np.int64)[k], k

    def id_parts(self, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP) -> Iterator[list[int]]:
        """Ids of a text of any length, part by part, with the memory of one chunk."""
        at = 0  # a proven border
        while len(text) - at > chunk + overlap:
            size, over = chunk, overlap
            while True:
                end, nxt = min(len(text), at + size + over), at + size
                ids, pos, k = self.borders(text[at:end])
                if end == len(text):
                    yield ids
                    return
                _, pos2, _ = self.borders(text[nxt:end])
                common = np.intersect1d(pos[pos <= end - at - self.guard] + at, pos2 + nxt)
                if len(common):
                    break
                size, over = size * 2, min(size * 2, over * 4)  # widen
            p = int(common[0])
            yield ids[: int(k[np.searchsorted(pos, p - at)])]
            at = p
        yield self.ids(text[at:])


def encoder(path: str) -> Encoder:
    return kept_object(("encoder", path), lambda: Encoder(path))


def piece_counter(path: str):
    """Function from texts to token counts for a file of tokenizers (.json) or sentencepiece (.model)."""
    if path.endswith(".model"):
        import sentencepiece

        sp = kept_object(("sentencepiece", path), lambda: sentencepiece.SentencePieceProcessor(model_file=path))
        return lambda texts: [len(sp.encode(t)) for t in texts]
    enc = encoder(path)
    return lambda texts: [len(enc.ids(t)) for t in texts]


OUT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])


def count_tokens(df: DataFrame, path: str, cols: list[str], text: str = "text", limit: int = LIMIT, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """``cols`` of every row with n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of its whole text.

    Texts up to ``chunk`` code points are encoded at once. Longer ones become rows of overlapping chunks that are dealt
    over all tasks, so one huge document is no single task's work; per chunk only its borders inside the overlaps come
    back. Null text: empty, 0 tokens. An empty table gives an empty result; repeated rows are counted row by row;
    columns of ``cols`` named like an output give way to it. Files of sentencepiece (.model) are not cut.
    """
    if path.endswith(".model"):
        chunk = 1 << 62

    def whole(arr: pa.Array) -> list:
        count = piece_counter(path)
        n, size = [], []
        for x in arr:
            t = x.as_py()
            n += count([t])
            size.append(len(t.encode()))
        return [size, n, [v > limit for v in n]]

    cols = [c for c in cols if c not in OUT.fieldNames()]
    size = F.length(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    short = map_text(df.filter(size <= chunk), cols, text, OUT, whole)
    if path.endswith(".model"):
        return short
    rest = df.filter(size > chunk).select(F.monotonically_increasing_id().alias("__row"), *[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(cols)], F.col(f"`{text}`").alias("__text"))
    rest = cut_lineage(rest)  # row numbers must not change when a task runs again
    done = []
    while not rest.isEmpty():
        pairs, total = _chunk_counts(rest, path, chunk, overlap)
        bad = pairs.filter("cut is null").select("__row").distinct()
        cuts = pairs.groupBy("__row").agg(F.sum("cut").alias("cut"))
        good = total.join(bad, "__row", "left_anti").join(cuts, "__row", "left").select("__row", (F.col("n") - F.coalesce("cut", F.lit(0))).alias("n_tokens"))
        done.append(rest.join(good, "__row").select(
            *[F.col(f"__c{i}").alias(c) for i, c in enumerate(cols)], F.octet_length("__text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
        rest = cut_lineage(rest.join(bad, "__row", "left_semi"))
        chunk, overlap = chunk * 2, min(chunk * 2, overlap * 4)
    for d in done:
        short = short.unionByName(d)
    return short


def _chunk_counts(rest: DataFrame, path: str, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """Per pair of neighbouring chunks the tokens to take off (null: no common border), and per row the tokens of all chunks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, value in zip(b.column(0), b.column(1)):
                t = value.as_py()
                for no, at in enumerate(range(0, max(1, len(t) - overlap), chunk)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row.as_py()], pa.int64()), pa.array([no], pa.int64()), pa.array([at], pa.int64()), pa.array([at + chunk + overlap >= len(t)]), pa.array([t[at : at + chunk + overlap]])],
                        names=["__row", "no", "at", "last", "part"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            rows = []
            for row, no, at, last, part in zip(*[c.to_pylist() for c in b.columns]):
                ids, pos, k = enc.borders(part)
                head = pos < overlap if no else pos < 0
                tail = (pos >= chunk) & (pos <= len(part) - enc.guard) if not last else pos < 0
                rows.append((row, no, len(ids), (pos[head] + at).tolist(), k[head].tolist(), (pos[tail] + at).tolist(), (len(ids) - k[tail]).tolist(), last))
            kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 4, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*rows), kinds)] if rows else [pa.array([], kind) for kind in kinds],
                                             names=["__row", "no", "n", "head", "head_k", "tail", "tail_k", "last"])

    parts = rest.select("__row", "__text").mapInArrow(cut, "__row long, no long, at long, last boolean, part string")
    parts = parts.repartition("__row", "no")
    arrays = "head array<long>, head_k array<long>, tail array<long>, tail_k array<long>"
    enc = cut_lineage(parts.mapInArrow(encode, f"__row long, no long, n long, {arrays}, last boolean"))
    left = enc.filter("not last").select("__row", "no", "tail", "tail_k")
    right = enc.select("__row", (F.col("no") - 1).alias("no"), "head", "head_k")
    both = left.join(right, ["__row", "no"]).withColumn("p", F.array_min(F.array_intersect("tail", "head")))
    at = lambda pos, k: F.element_at(k, F.array_position(pos, F.col("p")).cast("int"))
    pairs = both.select("__row", F.when(F.col("p").isNotNull(), at("tail", "tail_k") + at("head", "head_k")).alias("cut"))
    return pairs, enc.groupBy("__row").agg(F.sum("n").alias("n"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"])

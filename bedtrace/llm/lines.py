"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last WINDOW lines ends a chunk where it meets a fixed remainder, so borders follow
the lines around them and not their place in a text; chunks have DIVISOR lines on average. Chunks of several lines (and
single lines of ``long_words`` words or more) are looked up all over the table. Where one occurs again, its bytes are
compared, and the match is grown line by line to both sides against its first occurrence (smallest document id, then
place) until the lines differ: a passage that starts or ends inside a chunk is found to its last line.

Passages too short to hold a chunk are found on a second, finer level: of any two neighbouring lines the one with the
smaller hash is an anchor, whatever stands around them. Only anchors that occur again, outside of what the first level
covers, are looked at with their neighbours, and compared by bytes. Both levels together cover a line exactly when it
and a neighbour stood together before, or when it is long and stood somewhere before.

Neighbouring covered lines are removed together: two or more with ``min_words`` words (by default any number), or one
long line. A short line that many texts share, alone between lines of its own text, stays. The first occurrence of a
line in the table is never removed. Lines without words belong to no chunk; they go with the covered lines before them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bedtrace.llm.common import bound_batches, documents
from bedtrace.llm.marks import is_marked, marked, split_by_marks
from bedtrace.session import cut_lineage

WINDOW = 2
DIVISOR = 6
MAX_LINES = 64  # a chunk without a border for so long ends
LONG_WORDS = 50
MIN_WORDS = 0
MASK = (1 << 64) - 1


class Lines:
    """The lines with words of a text: bytes, places among all lines, hashes and chunks."""

    def __init__(self, text: str, long_words: int = LONG_WORDS) -> None:
        import xxhash

        self.all = text.encode().split(b"\n")
        self.at = [i for i, x in enumerate(self.all) if x.strip()]
        self.raw = [self.all[i] for i in self.at]
        self.long = [len(x) >= 2 * long_words - 1 and len(x.split()) >= long_words for x in self.raw]
        self.hashes = [xxhash.xxh3_64_intdigest(x) for x in self.raw]

    def chunks(self) -> list[tuple[int, int]]:
        """First line and line after the last of all chunks."""
        first, out, last, h, n = 0, [], 0, self.hashes, len(self.raw)
        for i in range(n):
            roll = sum(x * y for x, y in zip((0x9E3779B97F4A7C15, 1), h[max(0, i + 1 - WINDOW) : i + 1])) & MASK
            last = i + 1
            if (roll >> 17) % DIVISOR == 0 or self.long[i] or last == n or self.long[last] or last - first == MAX_LINES:
                out.append((first, last))
                first = last
        return out

    def units(self) -> list[tuple[int, int]]:
        """The chunks that are looked up."""
        return [(a, b) for a, b in self.chunks() if b - a > 1 or self.long[a]]

    def anchor(self, i: int) -> int:
        """Hash of the anchor of line i and the next one."""
        return min(self.hashes[i], self.hashes[i + 1])

    def key(self, a: int, b: int) -> tuple[int, int, bytes]:
        """Two 64-bit hashes and the bytes of some lines."""
        import xxhash

        part = b"\n".join(self.raw[a:b])
        h = xxhash.xxh3_128_intdigest(part)
        return _signed(h >> 64), _signed(h & MASK), part

    def digests(self, a: int, b: int) -> list[bytes]:
        import xxhash

        return [xxhash.xxh3_128_digest(x) for x in self.raw[a:b]]


def without(text: str, spans: list[tuple[int, int]], min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> tuple[str, int]:
    """``text`` without its covered lines (``spans`` of lines with words) that say enough, and the number of lines removed."""
    lines = Lines(text, long_words)
    covered = {lines.at[i] for a, b in spans for i in range(a, b)}
    raw, filled = text.split("\n"), set(lines.at)
    out, run, gone = [], [], 0
    for i in range(len(raw) + 1):
        if i < len(raw) and (i in covered or (run and i not in filled)):
            run.append(i)
            continue
        if run:
            words = [len(lines.all[k].split()) for k in run if k in filled]
            enough = sum(words) >= (long_words if len(words) == 1 else min_words)
            gone += len(run) * enough
            out += [] if enough else raw[run[0] : run[-1] + 1]
            run = []
        out += raw[i : i + 1]
    return "\n".join(out), gone


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


OUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("lines_removed", T.LongType())])
SPANS = "array<struct<a:int,b:int>>"


def _same_start(x: str, y: str) -> Column:
    """Number of equal entries at the start of two arrays."""
    equal = F.zip_with(x, y, lambda a, b: F.coalesce(a == b, F.lit(False)))
    differs = F.array_position(equal, False)
    return F.when(differs == 0, F.size(equal)).otherwise(differs - 1).cast("int")


def _repeated(found: DataFrame) -> DataFrame:
    """Rows of ``found`` (k, hash, a, b, h1, h2, part, before, after) that are not the first of equal ones, with the
    lines before and after that first one.

    Rows are grouped by the bytes themselves, and copies are combined before the shuffle. Different bytes under the same
    128-bit hash are all left alone.
    """
    found = cut_lineage(found)
    where = F.struct(F.col("k").isNull().alias("last"), F.col("k").alias("k"), F.col("hash").alias("hash"), F.col("a").alias("a"))
    same = found.groupBy("h1", "h2", "part").agg(F.min(F.struct(where.alias("where"), "before", "after")).alias("first"), F.count("*").alias("n"))
    same = same.groupBy("h1", "h2").agg(F.count("*").alias("kinds"), F.min("first").alias("first"), F.sum("n").alias("n"))
    same = cut_lineage(same.filter("kinds = 1 and n > 1").select("h1", "h2", "first"))
    extra = found.drop("part").join(same, ["h1", "h2"]).filter(~where.eqNullSafe(F.col("first.where")))
    return extra.select("k", "hash", "a", "b", "before", "after", F.col("first.before").alias("first_before"), F.col("first.after").alias("first_after"))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, long_words: int = LONG_WORDS, levels: str = "both") -> DataFrame:
    """``df`` with ``text`` without its repeated lines, and the columns n_lines (before) and lines_removed.

    All columns of ``df`` are kept (but for columns of these two names). Null text stays null with 0 lines; the empty
    text has one empty line. A null key is the last in the order of occurrences. Rows with the same key and text are
    one document: all of them keep and lose the same lines. An empty table gives an empty result. Two different units
    with the same 128-bit hash would both be kept; lines reached by growth are compared by 128-bit hashes.
    ``levels="chunks"`` leaves the finer level out.
    """
    bound_batches(df.sparkSession)
    made = ["n_lines", "lines_removed"]
    cols = [c for c in df.columns if c not in made]
    src = df.select(*[F.col(f"`{c}`") for c in cols]).withColumns({"__key": F.col(f"`{key}`"), "__hash": F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))})
    kind = src.schema["__key"].dataType.simpleString()
    rows = src.filter(F.col(f"`{text}`").isNotNull()).select(F.col("__key").alias("k"), F.col("__hash").alias("hash"), F.col(f"`{text}`").alias("t"), F.lit(None).cast(SPANS).alias("spans"))
    found_schema = f"k {kind}, hash long, a int, b int, h1 long, h2 long, part binary, before array<binary>, after array<binary>"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes of the units and of the anchors of a batch and how often they are there."""
        for batch in batches:
            seen = []
            for x in batch.column(0):
                d = Lines(x.as_py(), long_words)
                seen += [d.key(a, b)[0] for a, b in d.units()]
                h = d.hashes
                seen += [_signed(h[i]) for i in range(len(h)) if (i and h[i] < h[i - 1]) or (i + 1 < len(h) and h[i] <= h[i + 1])]
            h, n = np.unique(np.array(seen, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n, pa.int64())], names=["h", "n"])

    again = rows.select("t").mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")
    bits = marked(again.select("h"), "h")

    def occurrences(of: DataFrame, pick: Callable[[Lines, list], list]) -> DataFrame:
        """One row per unit that ``pick`` takes from the lines of a text and the spans covered so far."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, units = [], []
                for i, (t, spans) in enumerate(zip(batch.column(2), batch.column(3))):
                    new = pick(Lines(t.as_py(), long_words), [(s["a"], s["b"]) for s in spans.as_py() or ()])
                    units += new
                    row += [i] * len(new)
                take = pa.array(row, pa.int64())
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *[pa.array([u[k] for u in units], x) for k, x in enumerate(kinds)]],
                                                 names=["k", "hash", "a", "b", "h1", "h2", "part", "before", "after"])

        return of.mapInArrow(run, found_schema)

    def chunk_units(d: Lines, spans: list) -> list:
        every, out = d.chunks(), []
        for k, (a, b) in enumerate(every):
            if b - a > 1 or d.long[a]:
                h1, h2, part = d.key(a, b)
                if is_marked(bits, np.array([h1]))[0]:
                    # the chunks beside it; the border before the left one may depend on lines outside of a passage
                    lo, hi = every[max(k - 1, 0)][0], every[min(k + 1, len(every) - 1)][1]
                    out.append((a, b, h1, h2, part, d.digests(max(0, lo - WINDOW), a)[::-1], d.digests(b, hi)))
        return out

    def pair_units(d: Lines, spans: list) -> list:
        covered = np.zeros(len(d.raw) + 1, bool)
        for a, b in spans:
            covered[a:b] = True
        open_pairs = np.flatnonzero(~(covered[:-2] & covered[1:-1])) if len(d.raw) > 1 else np.zeros(0, np.int64)
        hit = is_marked(bits, np.array([_signed(d.anchor(i)) for i in open_pairs.tolist()], np.int64)) if len(open_pairs) else []
        return [(i, i + 2, *d.key(i, i + 2), [], []) for i, ok in zip(open_pairs.tolist(), hit) if ok]

    grown = _repeated(occurrences(rows, chunk_units)).select("k", "hash", (F.col("a") - _same_start("before", "first_before")).alias("a"), (F.col("b") + _same_start("after", "first_after")).alias("b"))
    spans = cut_lineage(grown.distinct())

    def per_text(s: DataFrame) -> DataFrame:
        return cut_lineage(s.groupBy(F.col("k").alias("__key"), F.col("hash").alias("__hash")).agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("__drop")))

    def with_spans(of: DataFrame, drops: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows that can have spans, with them in __drop, and the rest; only the first meet the spans in a join.

        The table of spans grows with the input, so it is never broadcast, however small it is.
        """
        hit, rest = split_by_marks(of, "__hash", drops.select(F.col("__hash").alias("h")), "h")
        both = hit.alias("x").join(drops.hint("merge").alias("y"), F.col("x.__key").eqNullSafe(F.col("y.__key")) & (F.col("x.__hash") == F.col("y.__hash")), "left")
        return both.select(*[F.col(f"x.`{c}`") for c in of.columns], F.col("y.__drop")), rest

    if levels == "both":
        texts = rows.select(F.col("k").alias("__key"), F.col("hash").alias("__hash"), "t")
        hit, rest = with_spans(texts, per_text(spans))
        seen = hit.unionByName(rest.withColumn("__drop", F.lit(None).cast(SPANS))).select(F.col("__key").alias("k"), F.col("__hash").alias("hash"), "t", F.col("__drop").alias("spans"))
        pairs = _repeated(occurrences(seen, pair_units)).select("k", "hash", "a", "b")
        spans = spans.unionByName(pairs)
    drops = per_text(spans)

    kept = [c for c in cols if c != text]
    schema = T.StructType([src.schema[c] for c in kept] + [T.StructField("__t", T.StringType()), *OUT.fields[1:]])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, total, gone = [], [], []
            for x, d in zip(b.column(len(kept)), b.column(len(kept) + 1)):
                t, n = without(x.as_py(), [(s["a"], s["b"]) for s in d.as_py() or ()], min_words, long_words)
                texts.append(t)
                total.append(x.as_py().count("\n") + 1)
                gone.append(n)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(kept))], pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=[*kept, "__t", *made])

    # texts without a mark go on as they are; only the others meet their spans
    hit, rest = with_spans(src, drops)
    changed = hit.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"), "__drop").mapInArrow(rebuild, schema)
    lines = F.when(F.col(f"`{text}`").isNull(), 0).otherwise(F.length(text) - F.length(F.translate(F.col(f"`{text}`"), "\n", "")) + 1).cast("long")
    same_rows = rest.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__t"), lines.alias("n_lines"), F.lit(0).cast("long").alias("lines_removed"))
    both = changed.unionByName(same_rows)
    return both.select(*[F.col("__t").alias(text) if c == text else F.col(f"`{c}`") for c in cols], *made)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "lines_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))

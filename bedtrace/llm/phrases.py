"""Phrase collocations by a weighted de Bruijn graph.

The nodes of the graph are two words, its edges three: each word of a piece starts one walk step, written as the longest
gram that fits there (three words, or fewer at the end of a piece). Only these are aggregated; shorter counts follow
from the flow: the edges that leave a node plus the pieces that end in it are the occurrences of its two words, and the
same holds for single words. Nodes that one edge enters and one edge leaves with the node's whole flow lie inside a
unary path; such paths are compacted to one row with one weight, whose inner nodes need no counting of their own and,
being parts of an equally frequent longer phrase, are no candidates.

Grams that a first pass proves too rare for a candidate go to an unnamed node, so flow is kept and the many grams that
occur once are not written one by one. Words are numbered by 64-bit hashes that a check over all words of the table has
shown to be different; if two were equal another seed would be taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bedtrace.llm.common import LOWER, bound_batches, documents, mixed, text_bytes
from bedtrace.llm.marks import is_marked, marked
from bedtrace.session import cut_lineage

LEAST = 10  # occurrences of a candidate
COVERED = 50  # a candidate inside a longer one with this per cent of its occurrences is dropped
TOP = 2000
BLOCK = 6 << 20  # bytes of text that are worked on together
SALTS = 1024
PART = 512  # edges of a path in one row
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = ENDS.copy()
GAP[[0x20, 0x09]] = True


def words(arr: pa.Array, block: int = BLOCK) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """Words of a batch of texts: code of each, the lower-cased words the codes stand for, text of each, and whether
    the next word follows in the same piece.

    Given in blocks that end where a text or a piece ends, so memory follows the block (or the longest piece).
    """
    data, offs = text_bytes(arr)
    n, at = len(data), 0
    while at < n:
        end = min(n, at + block)
        while end < n:
            text = int(offs[np.searchsorted(offs, end, "right") - 1])
            low = max(at, text)
            stops = np.flatnonzero(ENDS[data[low:end]])
            if len(stops) or text > at:
                end = low + int(stops[-1]) + 1 if len(stops) else text
                break
            end = min(n, end + block)  # a piece longer than the block
        yield _words(data[at:end], np.clip(offs - at, 0, end - at))
        at = end


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    black = ~GAP[data]
    first, last = black.copy(), black.copy()
    first[1:] &= ~black[:-1]
    last[:-1] &= ~black[1:]
    inner = offs[(offs > 0) & (offs < len(data))]
    first[inner] = black[inner]
    last[inner - 1] = black[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(0, bool)
    at = np.append(0, np.cumsum(ends - starts))
    seen = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(LOWER[data[black]])]).dictionary_encode()
    text = np.searchsorted(offs, starts, "right") - 1
    piece = np.searchsorted(np.flatnonzero(ENDS[data]), starts)
    follows = np.append((text[1:] == text[:-1]) & (piece[1:] == piece[:-1]), False)
    return seen.indices.to_numpy(zero_copy_only=False).astype(np.int64), seen.dictionary, text, follows


def hashes(of: pa.Array, seed: int) -> np.ndarray:
    """Signed 64-bit hashes of byte strings."""
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(x, seed) for x in of.to_pylist()], np.uint64).view(np.int64)


def _pairs(h: np.ndarray, lang: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Fingerprint of each word with the next one and the language; only a screen is built on it."""
    u = h.view(np.uint64)
    return mixed(mixed(u[:-1] + lang[:-1]) * np.uint64(0x9E3779B97F4A7C15) + u[1:])[follows[:-1]].view(np.int64)


def _langs(arr: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    seen = arr.dictionary_encode()
    h = hashes(seen.dictionary.cast(pa.binary()), 0).view(np.uint64)
    code = seen.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return code, seen.dictionary, h[code]


Digest = Callable[[pa.Array, int], np.ndarray]


def vocabulary(src: DataFrame, digest: Digest = hashes) -> tuple[DataFrame, int]:
    """All words with their hashes (h, word), written, and the seed under which no two words have the same hash."""
    seed = 0
    while True:

        def run(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for _, dic, _, _ in words(b.column(1)):
                    yield pa.RecordBatch.from_arrays([pa.array(digest(dic, seed), pa.int64()), dic.cast(pa.binary()).cast(pa.string())], names=["h", "word"])

        found = cut_lineage(src.mapInArrow(run, "h long, word string").distinct())
        if found.groupBy("h").count().filter("count > 1").isEmpty():
            return found, seed
        seed += 1


def longest_grams(src: DataFrame, seed: int, least: int = LEAST, digest: Digest = hashes) -> DataFrame:
    """lang, w1, w2, w3, n of ``src`` (lang, text), written: how often the longest gram starts at a word, as hashes.

    w3 (and w2) are null at the end of a piece and where the gram is too rare to be ``least`` times in the table.
    """

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang_h = _langs(b.column(0))[2]
            for code, dic, text, follows in words(b.column(1)):
                fp, n = np.unique(_pairs(digest(dic, seed)[code], lang_h[text], follows) if len(code) > 1 else np.zeros(0, np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), pa.array(n, pa.int64())], names=["fp", "n"])

    bits = marked(src.mapInArrow(prints, "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "fp")

    def counted(block: tuple, lang: np.ndarray, lang_h: np.ndarray) -> list[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
        """Language codes, words and counts of the grams of one, two and three words that start in a block."""
        code, dic, text, follows = block
        if not len(code):
            return []
        h, v, own = digest(dic, seed), len(dic), lang[text]
        two = np.zeros(len(code) + 1, bool)
        if len(code) > 1:
            two[np.flatnonzero(follows[:-1])] = is_marked(bits, _pairs(h[code], lang_h[text], follows))
        three = two[:-1] & two[1:]
        two = two[:-1] & ~three
        # equal grams of the block together: numbers of (language, word), then with the second, then with the third
        key, back = np.unique(own * v + code, return_inverse=True)
        c, n = np.unique(back[~two & ~three], return_counts=True)
        out = [(key[c] // v, [h[key[c] % v]], n)]
        at = np.flatnonzero(two | three)
        pair, p_back = np.unique(back[at] * v + code[np.minimum(at + 1, len(code) - 1)], return_inverse=True)
        p_lang, p_words = key[pair // v] // v, [h[key[pair // v] % v], h[pair % v]]
        c, n = np.unique(p_back[two[at]], return_counts=True)
        out.append((p_lang[c], [w[c] for w in p_words], n))
        at3 = three[at]
        c, n = np.unique(p_back[at3] * v + code[at[at3] + 2], return_counts=True)
        out.append((p_lang[c // v], [w[c // v] for w in p_words] + [h[c % v]], n))
        return out

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, langs, lang_h = _langs(b.column(0))
            for block in words(b.column(1)):
                for where, ws, n in counted(block, lang, lang_h):
                    cols = [pa.array(w, pa.int64()) for w in ws] + [pa.nulls(len(n), pa.int64())] * (3 - len(ws))
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(where)), *cols, pa.array(n, pa.int64())], names=["lang", "w1", "w2", "w3", "n"])

    return cut_lineage(src.mapInArrow(grams, "lang string, w1 long, w2 long, w3 long, n long").groupBy("lang", "w1", "w2", "w3").agg(F.sum("n").alias("n")))


def compact_paths(edges: DataFrame, inner: DataFrame) -> DataFrame:
    """lang, path, part, ws, n: the edges (lang, w1, w2, w3, n) as unary paths, cut into rows of at most PART edges.

    ``inner`` (lang, w1, w2) are the nodes inside of paths. Each edge looks up the edge before it, then the head so far
    of that one, and so on in doubled steps. A path has a head, since every walk is finite: a ring of nodes that
    nothing enters or leaves would hold no piece of text.
    """
    numbered = cut_lineage(edges.withColumn("id", F.monotonically_increasing_id()))
    before = numbered.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.col("id").alias("head")).join(inner, ["lang", "w1", "w2"])
    chain = cut_lineage(numbered.select("lang", "w1", "w2", "id").join(before, ["lang", "w1", "w2"]).select("id", "head", F.lit(1).cast("long").alias("dist")))
    while True:
        up = chain.select(F.col("id").alias("u"), F.col("head").alias("u_head"), F.col("dist").alias("u_dist"))
        chain_next = chain.join(up, F.col("head") == F.col("u"), "left")
        if chain.join(up, F.col("head") == F.col("u"), "left_semi").isEmpty():
            break
        chain = cut_lineage(chain_next.select("id", F.coalesce("u_head", "head").alias("head"), (F.col("dist") + F.coalesce("u_dist", F.lit(0))).alias("dist")))
    placed = numbered.join(chain, "id", "left").select("lang", F.coalesce("head", "id").alias("path"), F.coalesce("dist", F.lit(0).cast("long")).alias("dist"), "w1", "w2", "w3", "n")
    rows = placed.groupBy("lang", "path", F.expr(f"dist div {PART}").alias("part")).agg(F.sort_array(F.collect_list(F.struct("dist", "w1", "w2", "w3"))).alias("e"), F.max("n").alias("n"))
    return cut_lineage(rows.select("lang", "path", "part", F.concat(F.array(F.col("e")[0]["w1"], F.col("e")[0]["w2"]), F.transform("e", lambda x: x["w3"])).alias("ws"), "n"))


def candidates(grams: DataFrame, least: int = LEAST, covered: int = COVERED) -> DataFrame:
    """lang, w1, w2, w3 (null for two words), a, l, r, score of the phrases that are not covered by a longer one."""
    flow = cut_lineage(grams.filter("w2 is not null").groupBy("lang", "w1", "w2").agg(F.sum("n").alias("f")).filter(F.col("f") >= least))
    single = cut_lineage(grams.groupBy("lang", F.col("w1").alias("w")).agg(F.sum("n").alias("f")).filter(F.col("f") >= least))
    edges = grams.filter(F.col("w3").isNotNull() & (F.col("n") >= least))
    leave = edges.groupBy("lang", "w1", "w2").agg(F.count("*").alias("out"), F.max("n").alias("out_n"))
    enter = edges.groupBy("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.count("*").alias("into"), F.max("n").alias("into_n"))
    nodes = cut_lineage(flow.join(leave, ["lang", "w1", "w2"], "left").join(enter, ["lang", "w1", "w2"], "left"))
    unary = F.coalesce((F.col("out") == 1) & (F.col("into") == 1) & (F.col("out_n") == F.col("f")) & (F.col("into_n") == F.col("f")), F.lit(False))
    junctions = nodes.filter(~unary)
    paths = compact_paths(edges, nodes.filter(unary).select("lang", "w1", "w2"))

    steps = paths.select("lang", "n", "ws", F.explode(F.sequence(F.lit(1), F.size("ws") - 2)).alias("i"))
    threes = steps.select("lang", *[F.element_at("ws", F.col("i") + k).alias(f"w{k + 1}") for k in range(3)], F.col("n").alias("a"))
    node = lambda a, b, f: junctions.select("lang", F.col("w1").alias(a), F.col("w2").alias(b), F.col("f").alias(f))
    word = lambda w, f: single.select("lang", F.col("w").alias(w), F.col("f").alias(f))
    # a node inside a path has the weight of the path
    threes = threes.join(node("w1", "w2", "f12"), ["lang", "w1", "w2"], "left").join(node("w2", "w3", "f23"), ["lang", "w2", "w3"], "left")
    threes = threes.join(word("w1", "f1"), ["lang", "w1"]).join(word("w3", "f3"), ["lang", "w3"])
    threes = threes.select("lang", "w1", "w2", "w3", "a", F.col("f1").alias("l1"), F.coalesce("f23", "a").alias("r1"), F.coalesce("f12", "a").alias("l2"), F.col("f3").alias("r2"))
    longer = F.greatest(F.coalesce("out_n", F.lit(0)), F.coalesce("into_n", F.lit(0)))
    twos = junctions.filter(100 * longer < covered * F.col("f")).join(word("w1", "l1"), ["lang", "w1"]).join(word("w2", "r1"), ["lang", "w2"])
    twos = twos.select("lang", "w1", "w2", F.lit(None).cast("long").alias("w3"), F.col("f").alias("a"), "l1", "r1", F.lit(None).cast("long").alias("l2"), F.lit(None).cast("long").alias("r2"))

    # whole division of decimals is exact; counts may have 16 digits
    wide = lambda c: f"cast({c} as decimal(16,0))"
    score = lambda k: F.expr(f"cast({wide('a')} * {wide('a')} * cast(1000000 as decimal(7,0)) as decimal(38,0)) div ({wide(f'l{k}')} * {wide(f'r{k}')})")
    both = twos.unionByName(threes).withColumns({"s1": score(1), "s2": score(2)})
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    return both.select("lang", "w1", "w2", "w3", "a", F.when(second, F.col("l2")).otherwise(F.col("l1")).alias("l"), F.when(second, F.col("r2")).otherwise(F.col("r1")).alias("r"), F.least("s1", "s2").alias("score"))


def collocations(df: DataFrame, group: str = "lang", text: str = "text", least: int = LEAST, covered: int = COVERED, top: int = TOP, digest: Digest = hashes) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of two or three words of each ``group``.

    Null group: ``und``, as a group of that name. Null and empty texts have no words, and repeated rows count as often
    as they occur. Ties in score go by a, then by the bytes of the phrase. A table without words or without a frequent
    phrase gives no rows. Other columns, whatever their names, are not looked at.
    """
    bound_batches(df.sparkSession)
    src = df.select(F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    names, seed = vocabulary(src, digest)
    grams = longest_grams(src, seed, least, digest)
    total = grams.groupBy("lang").agg(F.sum("n").alias("n"))
    found = candidates(grams, least, covered).withColumn("salt", F.pmod(F.xxhash64("w1", "w2", "w3"), F.lit(SALTS)))
    # what has `top` better ones in its own share of the group has them in the group
    best = Window.partitionBy("lang", "salt").orderBy(F.desc("score"), F.desc("a"))
    found = cut_lineage(found.withColumn("k", F.rank().over(best)).filter(F.col("k") <= top).drop("k"))
    used = found.select(F.explode(F.array("w1", "w2", "w3")).alias("h")).filter("h is not null").distinct()
    names = cut_lineage(names.join(used, "h"))
    for w in ("w1", "w2", "w3"):
        found = found.join(names.select(F.col("h").alias(w), F.col("word").alias(f"{w}_name")), w, "left")
    found = found.withColumn("phrase", F.concat_ws(" ", "w1_name", "w2_name", "w3_name"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    found = found.withColumn("k", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("k") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return found.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


OP13_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS pid, lang, piece FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
listed AS (SELECT pid, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
w AS (SELECT pid, lang, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM listed),
g AS (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY pid ORDER BY i)),
total AS (SELECT lang, count(*) AS n FROM g GROUP BY lang),
f1 AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
longer AS (SELECT lang, a, b, max(f) AS m FROM (SELECT lang, w1 AS a, w2 AS b, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
cuts AS (
  SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, 1 AS k, f2.f AS a, x.f AS l, y.f AS r
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
  LEFT JOIN longer ON longer.lang = f2.lang AND longer.a = f2.w1 AND longer.b = f2.w2
  WHERE 100 * coalesce(m, 0) < 50 * f2.f
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, 1, f3.f, x.f, y.f
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, 2, f3.f, x.f, y.f
  FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3),
scored AS (SELECT *, CAST((1000000 * CAST(a AS HUGEINT) * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

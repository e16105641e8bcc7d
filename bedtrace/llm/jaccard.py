"""N-gram Jaccard join: universe-partition pigeonhole with exact verification.

Documents are sets of word shingles (64-bit hashes). Two sets x, y link when 100 |x & y| >= 85 |x | y|, which is the
same as |x - y| + |y - x| <= H with H = 15 (|x| + |y|) / 185. The universe of shingles is hashed into segments, their
number set by the size band: m = H + 1 + slack for the largest sets of the band. A difference of at most H touches at
most H segments, so x and y have the same subset in slack + 1 segments at least. Each document indexes the subsets of
its own band and, if a partner can lie there, of the band above; it needs no more than its own H + 1 + slack segments.

Allocation by cost: a document may leave out as many segments as the slack allows (v = -1), and leaves out the ones
with the longest lists. Empty subsets have the longest lists of all and are always left out; they use up slack first.
Of the slack + 1 common segments of a pair, the one with the shortest list is left out by neither. A document with more
empty subsets than slack indexes the one-deletion neighbourhoods (v = +1) of its first segments, as many as hold one
non-empty subset for each empty one beyond the slack; if all common segments of a pair are empty, both documents do
so, and one of these segments differs by at most one shingle, because otherwise the difference would be above H.

Lists are not expanded into pairs. In each list the document with most company leads and is compared with the others;
what is linked then is one component, and only members of different components of a list are compared further. A
512-bit parity sketch gives a lower bound of the difference inside these joins, so nearly all pairs that fail do so
there; the rest is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bedtrace.llm.common import doc_counts, documents, map_text, mixed, text_bytes, words_of
from bedtrace.llm.components import components
from bedtrace.llm.marks import is_marked, marked, split_by_marks
from bedtrace.session import cut_lineage

WORDS, SIM = 4, 85  # words of a shingle, similarity in per cent
SKETCH = 8  # words of 64 bits
PART_BYTES = 4 << 20


def bands(largest: int, sim: int) -> np.ndarray:
    """First size of each band; a partner of a set lies in the same or a neighbouring band."""
    out, beyond = [1], 0
    while beyond < 3:  # up to the end of the band above that of the largest
        beyond += out[-1] > largest
        out.append(max(out[-1] + 1, -(-out[-1] * 10_000 // (sim * sim))))
    return np.array(out, np.int64)


def most_apart(a: np.ndarray, b: np.ndarray, sim: int) -> np.ndarray:
    """Largest difference of two sets of these sizes that still link."""
    return (100 - sim) * (a + b) // (100 + sim)


def shingle_sets(arr: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, in order of text and hash, and the number of each text.

    A text with fewer words is one shingle of all its words, one without words has none.
    """
    data, offs = text_bytes(arr)
    starts, _, h = words_of(data, offs)
    n = doc_counts(starts, offs)
    first = np.cumsum(n) - n
    size = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), size)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size) + first[doc]
    length = np.minimum(n[doc], words)
    v = mixed(length.astype(np.uint64))
    for k in range(words):
        more = k < length
        v = np.where(more, mixed(v * np.uint64(0x9E3779B97F4A7C15) + h[np.where(more, at + k, 0)] if len(h) else v), v)
    order = np.lexsort((v, doc))
    v, doc = v[order], doc[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (doc[1:] != doc[:-1])
    return v[new], np.bincount(doc[new], minlength=len(n))


def set_ids(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit number of each set; equal sets have equal numbers."""
    total = np.append(np.uint64(0), np.cumsum(mixed(v)))
    ends = np.cumsum(n)
    return mixed((total[ends] - total[ends - n]) ^ n.astype(np.uint64)).view(np.int64)


def sketches(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """[texts, SKETCH]: bit k is the parity of the shingles that hash to k, so bits that differ are at most the difference."""
    doc = np.repeat(np.arange(len(n)), n)
    bit = (mixed(v ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(64 * SKETCH)).astype(np.int64)
    out = np.zeros(len(n) * SKETCH, np.uint64)
    np.bitwise_xor.at(out, doc * SKETCH + bit // 64, np.uint64(1) << (bit % 64).astype(np.uint64))
    return out.view(np.int64).reshape(-1, SKETCH)


def signatures(v: np.ndarray, n: np.ndarray, up: bool, use: np.ndarray, sim: int = SIM) -> tuple[np.ndarray, ...]:
    """Keys of the texts marked in ``use``, for their own band or the band above (``up``).

    Returns the keys in order of text, their number per text, the slack left per text, the keys of empty subsets
    (of texts with more of them than slack), their number per text, and which texts have too few other subsets.
    """
    edge = bands(int(n.max()) if len(n) else 1, sim)
    own = np.searchsorted(edge, np.maximum(n, 1), "right") - 1
    band = own + up
    last = edge[band + 1] - 1  # largest size of the band
    partner = np.minimum(n * 100 // sim, last)
    h = most_apart(n, partner, sim)
    use = use & (h > 0) & ((n * 100 // sim >= edge[band]) if up else True)
    h_band = most_apart(last, last, sim)
    low = np.maximum(-(-edge[band] * sim // 100), 1)  # smallest set that meets others in this band
    empty_share = np.exp(-low / (h_band + 2.0))
    expected = empty_share * (h_band + 2)
    slack = np.floor(expected + 3 * np.sqrt(expected)).astype(np.int64)
    m, mine = h_band + 1 + slack, h + 1 + slack
    mine = np.where(use, np.minimum(mine, m), 0)
    off = np.cumsum(mine) - mine
    doc = np.repeat(np.arange(len(n)), n)
    seg = (mixed(v + np.uint64(0x2545F4914F6CDD1D)) % m[doc].astype(np.uint64)).astype(np.int64)
    g = mixed(v ^ np.uint64(0x1B873593CC9E2D51))
    hit = seg < mine[doc]
    slot = off[doc[hit]] + seg[hit]
    total = np.zeros(int(mine.sum()), np.uint64)
    np.add.at(total, slot, g[hit])
    count = np.bincount(slot, minlength=len(total))
    slot_doc = np.repeat(np.arange(len(n)), mine)
    slot_seg = np.arange(len(total)) - np.repeat(off, mine)
    place = mixed((band[slot_doc].astype(np.uint64) << np.uint64(40)) + slot_seg.astype(np.uint64))
    full = count > 0
    keys, key_doc = [mixed(total[full] ^ place[full])], [slot_doc[full]]
    empties = np.bincount(slot_doc[~full], minlength=len(n))
    over = np.maximum(empties - slack, 0)
    rare, rare_doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if over.any():
        # first segments with as many non-empty subsets as there are empty ones beyond the slack
        seen = np.cumsum(full)
        before = seen - full - np.repeat((np.append(0, seen)[off]), mine)
        chosen = before < over[slot_doc]
        near = mixed(place ^ np.uint64(0xD1B54A32D192ED03))
        keys.append(mixed(total[chosen] ^ near[chosen]))
        key_doc.append(slot_doc[chosen])
        less = chosen[slot]
        keys.append(mixed((total[slot[less]] - g[hit][less]) ^ near[slot[less]]))
        key_doc.append(doc[hit][less])
        lone = ~full & (over > 0)[slot_doc]
        rare, rare_doc = mixed(place[lone] ^ np.uint64(0x94D049BB133111EB)), slot_doc[lone]
    key_doc = np.concatenate(key_doc)
    order = np.argsort(key_doc, kind="stable")
    left = np.where(use, np.maximum(slack - empties, 0), 0)
    stuck = over > mine - empties
    return np.concatenate(keys)[order].view(np.int64), np.bincount(key_doc, minlength=len(n)), left, rare.view(np.int64), np.bincount(rare_doc, minlength=len(n)), stuck


LONGS = T.ArrayType(T.LongType())
PROFILE = T.StructType([
    T.StructField("n_shingles", T.LongType()), T.StructField("sid", T.LongType()), T.StructField("sketch", LONGS),
    T.StructField("keys", LONGS), T.StructField("keys_up", LONGS), T.StructField("slack", T.LongType()), T.StructField("slack_up", T.LongType()),
    T.StructField("rare", LONGS), T.StructField("stuck", T.BooleanType()),
])


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(values))


def _parts(arr: pa.Array) -> Iterator[pa.Array]:
    """Slices of about PART_BYTES of text."""
    _, offs = text_bytes(arr)
    at = 0
    while at < len(arr):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + PART_BYTES, "right")) - 1)
        yield arr.slice(at, to - at)
        at = to


def profiles(df: DataFrame, key: str, text: str, words: int, sim: int = SIM) -> DataFrame:
    """Per row: size, set number and, once for each set of a batch, sketch and keys."""

    def run(arr: pa.Array) -> list:
        made = []
        seen: set[int] = set()
        for part in _parts(arr):
            v, n = shingle_sets(part, words)
            sid = set_ids(v, n)
            fresh = np.zeros(len(n), bool)
            fresh[np.unique(sid, return_index=True)[1]] = True
            fresh &= n > 0
            fresh &= np.array([s not in seen for s in sid.tolist()], bool)
            seen.update(sid.tolist())
            k0, c0, s0, r0, rc0, stuck0 = signatures(v, n, False, fresh, sim)
            k1, c1, s1, r1, rc1, stuck1 = signatures(v, n, True, fresh, sim)
            rare = np.concatenate([r0, r1])
            doc = np.concatenate([np.repeat(np.arange(len(n)), rc0), np.repeat(np.arange(len(n)), rc1)])
            made.append([pa.array(n.astype(np.int64)), pa.array(sid), _lists(sketches(v, n).ravel(), np.full(len(n), SKETCH)), _lists(k0, c0), _lists(k1, c1),
                         pa.array(s0), pa.array(s1), _lists(rare[np.argsort(doc, kind="stable")], rc0 + rc1), pa.array(stuck0 | stuck1)])
        if not made:
            return [[] for _ in PROFILE.fields]
        return [pa.concat_arrays(list(x)) for x in zip(*made)]

    return map_text(df, [key], text, PROFILE, run)


def candidate_lists(prof: DataFrame) -> DataFrame:
    """``key``, ``sid``, ``size``: the members of all lists with two sets or more, after each set has left out its longest lists."""
    rare = F.col("rare")  # a set with more empty subsets than its others can make up for: meet in the empty ones as well
    if prof.filter("stuck").isEmpty():
        rare = F.array().cast("array<long>")
    rows = prof.select("sid", F.explode(F.concat("keys", "keys_up", rare)).alias("key"))
    multi = cut_lineage(rows.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).filter("lo < hi").select("key"))
    bits = marked(multi, "key")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for no in (0, 1, 2):
                lists, slack = b.column(2 + no), b.column(5 + no).to_numpy()
                offs = lists.offsets.to_numpy()
                keys = lists.values.to_numpy()[offs[0] : offs[-1]]
                ok = is_marked(bits, keys)
                doc = np.repeat(np.arange(len(lists)), np.diff(offs))[ok]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[ok]), pa.array(b.column(0).to_numpy()[doc]), pa.array(b.column(1).to_numpy()[doc]), pa.array(np.full(len(doc), no, np.int32)), pa.array(slack[doc])],
                    names=["key", "sid", "size", "up", "slack"])

    got = prof.select("sid", "n_shingles", "keys", "keys_up", rare.alias("rare"), "slack", "slack_up", F.lit(0).cast("long").alias("slack_rare")).mapInArrow(pick, "key long, sid long, size long, up int, slack long")
    got = cut_lineage(got.join(multi, "key").distinct())
    counts = cut_lineage(got.groupBy("key").agg(F.count("*").alias("cost")))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("sid", "up").orderBy(F.desc("cost"), "key"))  # lists of one set
    return got.join(counts, "key").withColumn("rank", rank).filter("rank > slack").select("key", "sid", "size", "cost")


def _near(n1: Column, n2: Column, s1: Column, s2: Column, sim: int) -> Column:
    """Sizes that can link, and sketches that do not rule it out."""
    apart = sum((F.bit_count(F.get(s1, F.lit(k)).bitwiseXOR(F.get(s2, F.lit(k)))) for k in range(SKETCH)), F.lit(0))
    return (100 * F.least(n1, n2) >= sim * F.greatest(n1, n2)) & (apart <= F.floor((100 - sim) * (n1 + n2) / (100 + sim)))


def verified(pairs: DataFrame, sets: DataFrame, sim: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    left = pairs.join(sets.select(F.col("sid").alias("b"), F.col("shingles").alias("sb")), "b")
    both = left.join(sets.select(F.col("sid").alias("a"), F.col("shingles").alias("sa")), "a").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            oa, ob = b.column(2).offsets.to_numpy(), b.column(3).offsets.to_numpy()
            va, vb = b.column(2).values.to_numpy(), b.column(3).values.to_numpy()
            for i in range(b.num_rows):
                x, y = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * both >= sim * (len(x) + len(y) - both)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def link_components(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, sim: int = SIM) -> DataFrame:
    """One row per row of ``df``: ``key``, n_shingles, component_id (smallest ``key`` reachable by links).

    Null, empty and wordless texts have no shingles and stay alone (component_id is their own key, null for a null
    key). Rows with equal sets are linked without a comparison, repeated rows among them. An empty table gives an empty
    result; other columns are left behind. Shingles are compared by 64-bit hashes.
    """
    src = df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    prof = cut_lineage(profiles(src, "__key", "__text", words, sim))
    lists = cut_lineage(candidate_lists(prof))
    links = _links(src, prof, lists, words, sim)
    roots = components(links)
    rows = prof.select("__key", "n_shingles", "sid").join(roots.withColumnRenamed("node", "sid"), "sid", "left")
    rows = cut_lineage(rows.select("__key", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("root", "sid")).alias("root")))
    groups = cut_lineage(rows.filter("root is not null").groupBy("root").agg(F.min("__key").alias("least"), F.count("*").alias("n")).filter("n > 1").select("root", "least"))
    out = rows.join(groups, "root", "left")
    return out.select(F.col("__key").alias(key), "n_shingles", F.coalesce("least", "__key").alias("component_id"))


def _links(src: DataFrame, prof: DataFrame, lists: DataFrame, words: int, sim: int) -> DataFrame:
    degree = lists.groupBy("sid").agg(F.sum("cost").alias("degree"))
    sketch = prof.filter(F.size("keys") + F.size("keys_up") > 0).select("sid", "sketch").join(degree, "sid").groupBy("sid").agg(F.max("degree").alias("degree"), F.first("sketch").alias("sketch"))
    sketch = cut_lineage(sketch)
    bits = marked(sketch, "sid")

    def sets_of(arr: pa.Array) -> list:
        sids, sets = [], []
        for part in _parts(arr):
            v, n = shingle_sets(part, words)
            sid = set_ids(v, n)
            ok = is_marked(bits, sid) & (n > 0)
            sids.append(pa.array(sid, mask=~ok))
            at = np.repeat(ok, n)
            sets.append(_lists(v[at].view(np.int64), np.where(ok, n, 0)))
        return [pa.concat_arrays(sids), pa.concat_arrays(sets)] if sids else [[], []]

    kind = T.StructType([T.StructField("sid", T.LongType()), T.StructField("shingles", LONGS)])
    sets = map_text(src, [], "__text", kind, sets_of).filter("sid is not null")
    sets = cut_lineage(sets.dropDuplicates(["sid"]))
    lists = cut_lineage(lists.select("key", "sid", "size").join(sketch, "sid"))
    comp = lists.select("sid").distinct().select(F.col("sid").alias("node"), F.col("sid").alias("root")).limit(0)
    links = None
    for turn in range(3):
        left = lists.join(comp.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        mixed_keys = left.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
        left = cut_lineage(left.join(cut_lineage(mixed_keys), "key").select("key", "sid", "size", "degree", "sketch", "root"))
        if left.isEmpty():
            break
        ok = _near(F.col("x.size"), F.col("y.size"), F.col("x.sketch"), F.col("y.sketch"), sim) & (F.col("x.root") != F.col("y.root"))
        if turn < 2:  # compare with the one that leads each list
            best = left.groupBy("key").agg(F.max(F.struct("degree", "sid", "size", "root", "sketch")).alias("x"))
            best = cut_lineage(best.select("key", "x.sid", "x.size", "x.root", "x.sketch"))
            pairs = best.alias("x").join(left.alias("y"), (F.col("x.key") == F.col("y.key")) & ok)
        else:  # the rest: members of different components
            pairs = left.alias("x").join(left.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.sid") < F.col("y.sid")) & ok)
        pairs = pairs.select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")).distinct()
        new = verified(cut_lineage(pairs), sets, sim)
        links = cut_lineage(new if links is None else links.unionByName(new))
        lists = left.drop("root")
        if turn < 2:
            comp = components(links)
    return links if links is not None else comp.select(F.col("node").alias("a"), F.col("root").alias("b"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, sim: int = 80) -> DataFrame:
    """Rows of ``df``, all columns, without the documents that are linked with one of a smaller ``key``.

    Rows of one key are one document: of several same rows (key and text) one stays. Rows with a null key cannot be
    told apart and stay.
    """
    comp = cut_lineage(link_components(df, key, text, words, sim))
    gone = cut_lineage(comp.filter(F.col("component_id") < F.col(key)).select(F.col(key).alias("__gone")).distinct())
    hit, rest = split_by_marks(df, key, gone, "__gone")
    kept = rest.unionByName(hit.join(gone, F.col(f"`{key}`") == F.col("__gone"), "left_anti"))
    twins = cut_lineage(comp.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__twin")).agg(F.count("*").alias("n")).filter("n > 1").select("__twin"))
    if twins.isEmpty():
        return kept
    several, single = split_by_marks(kept, key, twins, "__twin")
    return single.unionByName(several.dropDuplicates([key, text]))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(documents(spark, sf_dir))

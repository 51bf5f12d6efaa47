"""Near-duplicate documents by SetSketch registers, joint likelihood and exact verification.

A document's set of word shingles is sketched as truncated minima on an exponentially spaced
scale: register i holds floor(1 - log_b(min of Exp(a) variates)), which merges by maximum and
agrees between two sets with a probability close to their Jaccard similarity. Copies (equal sets)
are represented by one document. Bands of registers bring similar documents together:

1. In each band's bucket every document meets the smallest one. Of such a pair the similarity is
   estimated jointly from the counts of larger, smaller and equal registers and the known set
   sizes; where it may reach the threshold, the pair is confirmed on the full sets: for each document
   first the pair with the smallest it met, then those that are still in two components. A
   group of n copies takes some n texts, not n^2 pairs, for its members are linked through the smallest.
2. What is left are buckets of three and more documents that are still in several components:
   pairs of theirs that never met. Members are dealt into tiles of bounded size, large components into
   tiles of their own; pairs of tiles are compared, but never inside one component, and a task
   returns a spanning forest of its links.

So documents that only share a bucket by chance don't chain into families, a large family is
linear, and no link between different components is left out.

Bands of ``rows`` registers lose a pair of similarity J with probability (1 - J^rows)^bands:
1.4e-7 at J = 0.8 with the defaults. For far more documents than 10^9, raise both.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Forest, components, groups, lean, mixed, shingle_sets, small_batches, steps, strings, written

BANDS, ROWS = 40, 5
BASE, RATE = 1.001, 20.0
#: A pair is dropped unverified where the likelihood peaks this far below the threshold (5 standard errors).
MARGIN = 0.14
#: Shingles of a tile, members that meet one document in a task.
TILE, MEMBERS = 100_000, 512
SALTS = 16
BITMAP = 1 << 22


def registers(offsets: np.ndarray, hashes: np.ndarray, m: int) -> np.ndarray:
    """m SetSketch registers of each set, a matrix of uint16 (0 for empty sets)."""
    seed = mixed(np.arange(1, 2 * m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    flip, times = seed[:m].astype(np.uint32), seed[m:].astype(np.uint32) | np.uint32(1)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    n = len(offsets) - 1
    low = np.full((n, m), 0xFFFFFFFF, np.uint32)
    for i in range(n):
        for a in range(offsets[i], offsets[i + 1], 512):
            y = x[a : min(a + 512, offsets[i + 1]), None] ^ flip
            y *= times
            np.minimum(low[i], y.min(axis=0), out=low[i])
    exp = -np.log1p(-(low + 0.5) / 2.0**32)
    k = np.floor(1 - (np.log(exp) - math.log(RATE)) / math.log(BASE))
    k[np.diff(offsets) == 0] = 0
    return np.clip(k, 0, 65535).astype(np.uint16)


def band_keys(k: np.ndarray, bands: int, rows: int) -> np.ndarray:
    acc = np.arange(1, bands + 1, dtype=np.uint64)[None, :].repeat(len(k), 0)
    for r in range(rows):
        acc = mixed(acc * np.uint64(0x9E3779B97F4A7C15) + k[:, r : bands * rows : rows].astype(np.uint64) + np.uint64(1))
    return acc.view(np.int64)


def may_reach(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, na: np.ndarray, nb: np.ndarray, t: float) -> np.ndarray:
    """Whether the joint likelihood of the registers still rises at similarity t, so peaks at or above it."""
    u, v = na / (na + nb), nb / (na + nb)
    c = (BASE - 1) / BASE
    up, down = np.maximum(u - v * t, 1e-9), np.maximum(v - u * t, 1e-9)
    p, q = -np.log1p(-up * c) / math.log(BASE), -np.log1p(-down * c) / math.log(BASE)
    dp, dq = -v * c / (1 - up * c) / math.log(BASE), -u * c / (1 - down * c) / math.log(BASE)
    return larger * dp / p + smaller * dq / q - equal * (dp + dq) / np.maximum(1 - p - q, 1e-9) >= 0


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many hashes two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _sketch(documents: DataFrame, idc: str, text: str, k: int, m: int) -> DataFrame:
    """id, n_shingles, digest of the set (null if empty), registers (little-endian, 2 bytes each)."""
    kind = documents.schema[idc].dataType

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, text):
            offsets, h = shingle_sets(strings(b.column(text)), k)
            n = np.diff(offsets)
            digest = [hashlib.blake2b(h[offsets[i] : offsets[i + 1]].tobytes(), digest_size=16).digest() if n[i] else None for i in range(len(n))]
            regs = registers(offsets, h, m)
            yield pa.RecordBatch.from_arrays([b.column(idc), pa.array(n), pa.array(digest, pa.binary()), pa.array([r.tobytes() if c else None for r, c in zip(regs, n)], pa.binary())], ["id", "n_shingles", "digest", "regs"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("regs", T.BinaryType())])
    return documents.select(idc, text).mapInArrow(lean(sketch), schema)


def _matrix(column: pa.Array, m: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, m)


def _banded(unique: DataFrame, bands: int, rows: int) -> DataFrame:
    """rep, n, key of each band."""

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = band_keys(_matrix(b.column("regs"), bands * rows), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * bands, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("n"), lists], ["rep", "n", "keys"])

    schema = T.StructType([unique.schema["rep"], T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    return unique.select("rep", "n", "regs").mapInArrow(lean(band), schema).select("rep", "n", F.explode("keys").alias("key"))


def _likely(pairs: DataFrame, m: int, t: float) -> DataFrame:
    """Pairs (rep, low) whose joint likelihood may reach similarity t."""
    schema = T.StructType([pairs.schema["rep"], pairs.schema["low"]])

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = _matrix(b.column("x"), m), _matrix(b.column("y"), m)
                larger, equal = (x > y).sum(1), (x == y).sum(1)
                ok = may_reach(larger, m - larger - equal, equal, np.asarray(b.column("n"), np.float64), np.asarray(b.column("low_n"), np.float64), t)
                yield pa.RecordBatch.from_arrays([b.column("rep").filter(pa.array(ok)), b.column("low").filter(pa.array(ok))], ["rep", "low"])

    return pairs.mapInArrow(lean(likely), schema)


def _star_links(rows: DataFrame, k: int, over: int, under: int) -> DataFrame:
    """Links (a, b) of each low with its members, on full sets. rows: low, salt, id, part (0: the low itself), text, sorted by low, salt, part."""
    kind = rows.schema["id"].dataType

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads = None, []
        for b in steps(batches, "text"):
            offsets, h = shingle_sets(strings(b.column("text")), k)
            low, salt, part = b.column("low").to_pylist(), np.asarray(b.column("salt")), np.asarray(b.column("part"))
            found = []
            for r in range(b.num_rows):
                s = h[offsets[r] : offsets[r + 1]]
                if (low[r], salt[r]) != key:
                    key, heads = (low[r], salt[r]), []
                if part[r] == 0:
                    heads.append(s.copy())
                elif any(under * (both := shared(s, x)) >= over * (len(s) + len(x) - both) for x in heads if len(s)):
                    found.append(r)
            if found:
                at = pa.array(found)
                yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("low").take(at)], ["a", "b"])

    return rows.mapInArrow(lean(link), T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def _tile_links(rows: DataFrame, k: int, m: int, over: int, under: int) -> DataFrame:
    """Links of a spanning forest of each pair of tiles, between components only. rows: pair, tile, comp, id, regs, text, sorted by pair."""
    kind = rows.schema["id"].dataType
    t = max(0.0, over / under - MARGIN)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["pair"]):
            ids, comp = g["id"].combine_chunks(), np.asarray(g["comp"].combine_chunks().dictionary_encode().indices)
            tile = np.asarray(g["tile"])
            several = len(np.unique(tile)) > 1
            sets = []
            for b in steps(g.to_batches(), "text"):
                offsets, h = shingle_sets(strings(b.column("text")), k)
                sets += [h[offsets[r] : offsets[r + 1]].copy() for r in range(b.num_rows)]
            regs, n = _matrix(g["regs"].combine_chunks(), m), np.array([len(s) for s in sets], np.float64)
            pairs, score = [], []
            for a in range(len(ids) - 1):
                c = np.arange(a + 1, len(ids))
                c = c[(comp[c] != comp[a]) & (under * np.minimum(n[c], n[a]) >= over * np.maximum(n[c], n[a])) & (n[c] > 0)]
                if several:
                    c = c[tile[c] != tile[a]]
                if len(c):
                    larger, equal = (regs[a] > regs[c]).sum(1), (regs[a] == regs[c]).sum(1)
                    ok = may_reach(larger, m - larger - equal, equal, n[a], n[c], t)
                    pairs.append(np.stack([np.full(ok.sum(), a), c[ok]], 1))
                    score.append(equal[ok])
            forest, found = Forest(len(ids)), []
            for x in np.unique(comp):  # members of one component are linked already
                own = np.flatnonzero(comp == x)
                for y in own[1:]:
                    forest.join(int(own[0]), int(y))
            if pairs:
                pairs, score = np.concatenate(pairs), np.concatenate(score)
                for a, c in pairs[np.argsort(-score, kind="stable")].tolist():
                    if forest.root(a) != forest.root(c) and under * (both := shared(sets[a], sets[c])) >= over * (len(sets[a]) + len(sets[c]) - both):
                        forest.join(a, c)
                        found.append((a, c))
            if found:
                at = np.array(found)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[:, 0])), ids.take(pa.array(at[:, 1]))], ["a", "b"])

    return rows.mapInArrow(lean(link), T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def _tile_pairs(members: DataFrame, tile: int) -> tuple[DataFrame, DataFrame]:
    """(rep, comp, tile) of each member, and the pairs of tiles (a, b) to compare.

    members: rep, n, comp, family. Components of over ``tile`` shingles have tiles of their own, which
    are not compared with each other; the others of a family share tiles.
    """
    sizes = members.groupBy("family", "comp").agg(F.ceil(F.sum("n") / F.lit(tile)).cast("int").alias("t"), F.sum("n").alias("size"))
    sizes = written(sizes, "sizes")  # read by each of the tables below
    big = sizes.where("t > 1").select("family", "comp", "t")
    pool = sizes.where("t <= 1").groupBy("family").agg(F.ceil(F.sum("size") / F.lit(tile)).cast("int").alias("p"))
    named = lambda comp, i: F.xxhash64("family", comp, i)
    none = F.lit("pool")
    placed = members.join(sizes.select("family", "comp", "t"), ["family", "comp"]).join(pool, "family", "left")
    own = named(F.col("comp").cast("string"), F.pmod(F.xxhash64("rep"), F.col("t")).cast("int"))
    placed = placed.select("rep", "comp", F.when(F.col("t") > 1, own).otherwise(named(none, F.pmod(F.xxhash64("comp"), F.col("p")).cast("int"))).alias("tile"))
    index = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pools = pool.select("family", index("p").alias("i")).select("family", "i", named(none, F.col("i")).alias("a"))
    bigs = big.select("family", "comp", index("t").alias("i")).select("family", "comp", named(F.col("comp").cast("string"), F.col("i")).alias("b"))
    within = pools.join(pools.select("family", F.col("i").alias("j"), F.col("a").alias("b")), "family").where("i <= j").select("a", "b")
    across = pools.select("family", "a").join(bigs.select("family", "b"), "family").select("a", "b")
    two = big.select("family", F.col("comp").alias("c")).join(big.select("family", F.col("comp").alias("d")), "family").where("c < d")
    large = two.join(bigs.select("family", F.col("comp").alias("c"), F.col("b").alias("a")), ["family", "c"]).join(bigs.select("family", F.col("comp").alias("d"), "b"), ["family", "d"]).select("a", "b")
    return placed, within.union(across).union(large)


def _flagged(docs: DataFrame, id_col: str, nodes: DataFrame) -> DataFrame:
    """The documents with ``__in``: whether their id's hash is among those of ``nodes`` (node), so for all of these and few others.

    The bitmap has BITMAP bits (half a megabyte) however many nodes there are; it only saves shuffling.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP)) + 1
    own = F.col(f"`{id_col}`")
    bits = nodes.select(place("node").alias("__p")).groupBy(F.bitmap_bucket_number("__p").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__p")).alias("__bits"))
    at = F.bitmap_bit_position(place(own))
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), (at % 8 + 1).cast("int"))
    found = docs.withColumn("__bucket", F.bitmap_bucket_number(place(own))).join(F.broadcast(bits), "__bucket", "left")
    return found.withColumn("__in", F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False))).drop("__bucket", "__bits")


def _in_bitmap(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    return _flagged(docs, "id", nodes).where("__in").select("id", "text")


def near_duplicates(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: tuple[int, int] = (80, 100),
    bands: int = BANDS,
    rows: int = ROWS,
    tile: int = TILE,
) -> DataFrame:
    """One row per row of ``documents``: the id, n_shingles, component_id, kept.

    Words are what ASCII white space separates, with A-Z lower-cased. Documents of Jaccard
    similarity >= similarity[0] / similarity[1] are linked; component_id is the smallest id
    reachable. Null and empty texts have no shingles and link with nothing (component_id is
    their own id). Rows that repeat an id are one node with the links of each of its texts.
    Rows with a null id link with nothing, have a null component_id and are kept. Very long texts are
    read whole; an empty table gives no rows. Columns other than the two named are not read.
    """
    spark = documents.sparkSession
    small_batches(spark)
    m, (over, under) = bands * rows, similarity
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketch = written(_sketch(docs, "id", "text", shingle, m), "sketch")
    unique = written(sketch.where("n_shingles > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs")), "unique")
    banded = _banded(unique, bands, rows)
    buckets = banded.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("low"), F.max("rep").alias("high"), F.count(F.lit(1)).alias("many")).where("low.rep != high")
    met = written(banded.join(buckets, "key").select("key", "rep", "n", F.col("low.rep").alias("low"), F.col("low.n").alias("low_n"), "many"), "met")
    # first, each with the smallest of its buckets
    fits = F.lit(under) * F.least("n", "low_n") >= F.lit(over) * F.greatest("n", "low_n")
    star = met.where("rep != low").where(fits).select("rep", "low").distinct()
    of = lambda rep, n, regs: unique.select(F.col("rep").alias(rep), F.col("n").alias(n), F.col("regs").alias(regs))
    pairs = written(_likely(star.join(of("rep", "n", "x").hint("merge"), "rep").join(of("low", "low_n", "y").hint("merge"), "low"), m, max(0.0, over / under - MARGIN)).distinct(), "pairs")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = lambda x: x.select(F.col("id").alias("node"))
    sorted_ = lambda x, n, *by: x.repartition(max(least, -(-n // 4096)), *by)

    def confirmed(pairs: DataFrame, n: int) -> DataFrame:
        """Links among n pairs (rep, low). A low with many members is dealt over several tasks, its text to each."""
        dealt = pairs.groupBy("low").agg(F.ceil(F.count(F.lit(1)) / F.lit(MEMBERS)).cast("int").alias("salts"))
        heads = dealt.select("low", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("part"), F.col("low").alias("id"))
        tails = pairs.join(dealt.hint("merge"), "low").select("low", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("part"), F.col("rep").alias("id"))
        both = written(heads.union(tails), "asked")  # read twice
        # neither side has a bound, so neither is ever broadcast; most texts meet no other and are left out by a bitmap first
        text = _in_bitmap(docs, nodes(both)).join(both.hint("merge"), "id")
        return written(_star_links(sorted_(text, n, "low", "salt").sortWithinPartitions("low", "salt", "part"), shingle, over, under), "links")

    # each with the smallest it met at all; what that leaves in two components, with the others it met
    one = written(pairs.groupBy("rep").agg(F.min("low").alias("low")), "one")
    links = confirmed(one, one.count())
    parts = written(components(links), "parts")
    in_part = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
    rest = pairs.join(one, ["rep", "low"], "left_anti").join(in_part("rep"), "rep", "left").join(in_part("low"), "low", "left")
    rest = written(rest.where(F.coalesce("rep_part", "rep") != F.coalesce("low_part", "low")).select("rep", "low"), "rest")
    if left := rest.count():
        links = confirmed(rest, left)
        parts = written(components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links)), "parts")
    # then, pairs of other buckets that are still apart
    apart = met.where("many > 2").select("key", "rep", "n").join(parts, F.col("rep") == F.col("node"), "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    mixed = apart.select("key", "comp").distinct().groupBy("key").agg(F.min("comp").alias("first"), F.max("comp").alias("last")).where("first != last").select("key", "first")
    # a bucket may hold very many: its row is repeated, its members are dealt over the repeats
    salt = F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")
    mixed = mixed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    apart = written(apart.withColumn("salt", salt).join(mixed, ["key", "salt"]).select("rep", "n", "comp", "first").distinct(), "apart")
    more = links.limit(0)
    if apart.count():
        family = written(components(apart.select(F.col("comp").alias("a"), F.col("first").alias("b"))), "family").select(F.col("node").alias("comp"), F.col("component").alias("family"))
        placed, tiles = _tile_pairs(written(apart.select("rep", "n", "comp").distinct().join(family, "comp"), "members"), tile)
        compared = tiles.select(F.xxhash64("a", "b").alias("pair"), F.explode(F.array_distinct(F.array("a", "b"))).alias("tile"))
        rows_ = written(placed.join(compared, "tile").join(unique.select("rep", "regs").hint("merge"), "rep").select("pair", "tile", "comp", F.col("rep").alias("id"), "regs"), "tiles")
        text = _in_bitmap(docs, nodes(rows_)).join(rows_.hint("merge"), "id")
        more = _tile_links(sorted_(text, rows_.count(), "pair").sortWithinPartitions("pair"), shingle, m, over, under)
    # documents that repeat an id with another text are one node, whatever their text's representative is
    same = sketch.where("n_shingles > 0").join(unique.select("digest", "rep"), "digest").where("id != rep").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a != b").select("a", "b")
    parts = written(components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more).union(same)), "parts")
    label = unique.select("digest", "rep").join(parts, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    # texts without shingles have no digest and need no join: they are no hot key
    full = sketch.where("digest is not null").select("id", "n_shingles", "digest").join(label, "digest", "left").select("id", "n_shingles", "component")
    out = full.unionByName(sketch.where("digest is null").select("id", "n_shingles", F.col("id").alias("component")))
    out = out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True)))


def drop_near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns unchanged, without those that are not the smallest id of their component.

    Of rows that repeat an id one stays, that with the smallest text (nulls first); rows without an
    id, or with a text without words, are no copies of others. An empty table gives no rows.
    """
    found = written(near_duplicates(documents, id_col=id_col, text_col=text_col, **options).select(F.col(id_col).alias("__id"), "kept"), "found")
    gone = written(found.where("not kept").select("__id").distinct(), "gone")
    # most documents are none of these by a bitmap, and are not shuffled
    flagged = _flagged(documents, id_col, gone.select(F.col("__id").alias("node")))
    names = [F.col(f"`{c}`") for c in documents.columns]
    doubtful = flagged.where("__in").select(names)
    kept = flagged.where("not __in").select(names).unionByName(doubtful.join(gone.hint("merge"), doubtful[id_col] == gone["__id"], "left_anti"))
    again = found.where("__id is not null").groupBy("__id").count().where("count > 1").select("__id")
    if not again.agg(F.count(F.lit(1))).first()[0]:
        return kept
    first = Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_first())
    repeated = kept.join(again, kept[id_col] == again["__id"], "left_semi").withColumn("__place", F.row_number().over(first)).where("__place = 1").select(names)
    return kept.join(again, kept[id_col].eqNullSafe(again["__id"]), "left_anti").unionByName(repeated)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(documents, shingle=2, similarity=(80, 100))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p+1], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws)-1))) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i.n >= 80 * (x.n + y.n - i.n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.a = w.doc_id
"""

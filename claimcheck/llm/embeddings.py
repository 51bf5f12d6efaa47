"""Near-duplicate vectors of one label by int8 tile products with rigorous error bounds.

Each unit vector x is quantised to s * q with q of int8 and the residual norm e = |x - s q| kept.
For two vectors |x.y - (s q).(t r)| <= e_x (1 + e_y) + e_y, so the exact integer product of two
tiles, scaled, plus that bound says which pairs can reach the threshold at all; only those are
computed in double precision. A label's vectors are cut into tiles of bounded size and each pair
of tiles is one group of rows. Copies are represented by one vector with its multiplicity. A
task returns a count and at most one link for each vector it holds, never the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, groups, local_links, written

TILE = 1024
#: Slack for rounding in the bound itself, far above what float64 needs for unit vectors.
SLACK = 1e-9


def _prepared(vectors: DataFrame, idc: str, vec: str, label: str) -> DataFrame:
    """id, label, digest, dim, x (little-endian doubles); digest is null for vectors that link with nothing."""
    kinds = vectors.schema

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("x")
            labels = np.asarray(pc.is_valid(b.column("label")))
            present = np.asarray(pc.is_valid(lists))
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            flat = pc.list_flatten(lists)
            values = np.asarray(pc.fill_null(flat, float("nan")), np.float64)
            digest, dims, out = [], [], []
            for i in range(b.num_rows):
                x = values[offsets[i] : offsets[i + 1]] + 0.0
                ok = bool(present[i] and labels[i] and len(x) and np.isfinite(x).all() and x.any())
                raw = x.tobytes() if ok else None
                digest.append(hashlib.blake2b(raw, digest_size=16).digest() if ok else None)
                dims.append(len(x))
                out.append(raw)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(digest, pa.binary()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["id", "label", "digest", "dim", "x"])

    schema = T.StructType([T.StructField("id", kinds[idc].dataType), T.StructField("label", kinds[label].dataType), T.StructField("digest", T.BinaryType()), T.StructField("dim", T.IntegerType()), T.StructField("x", T.BinaryType())])
    return vectors.select(F.col(idc).alias("id"), F.col(label).alias("label"), F.col(vec).cast("array<double>").alias("x")).mapInArrow(prepare, schema)


class Tile:
    """Unit vectors, their int8 form and its error."""

    def __init__(self, raw: list[bytes], dim: int) -> None:
        x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), dim)
        x = x / np.abs(x).max(1, keepdims=True)
        self.x = x / np.sqrt((x * x).sum(1, keepdims=True))
        scale = np.abs(self.x).max(1, keepdims=True) / 127
        self.q = np.rint(self.x / scale).astype(np.int8)
        self.scale = scale[:, 0]
        self.error = np.sqrt(((self.x - self.q * scale) ** 2).sum(1)) + SLACK
        # sums of products of int8 values are whole numbers: exact in float32 below 2^24
        self.wide = self.q.astype(np.float32 if dim * 127 * 127 < 1 << 24 else np.float64)


def matches(a: Tile, b: Tile, threshold: float) -> np.ndarray:
    """Whether cosine >= threshold, for each pair of the two tiles."""
    out = np.zeros((len(a.x), len(b.x)), bool)
    for s in range(0, len(a.x), 256):
        rows = slice(s, s + 256)
        upper = (a.wide[rows] @ b.wide.T).astype(np.float64) * (a.scale[rows, None] * b.scale[None])
        upper += a.error[rows, None] * (1 + b.error[None]) + b.error[None]
        i, j = np.nonzero(upper >= threshold)
        for c in range(0, len(i), 65536):
            p, q = i[c : c + 65536], j[c : c + 65536]
            ok = np.einsum("ij,ij->i", a.x[rows][p], b.x[q]) >= threshold
            out[s + p[ok], q[ok]] = True
    return out


def near_vectors(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    tile: int = TILE,
) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null, their lengths are equal and their cosine
    in double precision is at least ``threshold``. Null, empty and zero vectors and those with
    null or non-finite components link with nothing: n_links is 0 and component_id their own id.
    Rows with a null id have a null component_id and are kept; rows that repeat an id are one
    node. Other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType
    all_ = written(_prepared(vectors, id_col, vector_col, label_col), "vectors")
    keys = ["label", "dim", "digest"]
    unique = all_.where("digest is not null and id is not null").groupBy(*keys).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("x").alias("x"))
    unique = written(unique, "unique")
    sizes = unique.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("tiles"))
    cut = (
        unique.join(sizes, ["label", "dim"])
        .withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("label", "dim", "rep", "copies", "x", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "label", "dim", "i", "j")
        .sortWithinPartitions("label", "dim", "i", "j")
    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["label", "dim", "i", "j"]):
            dim, i, j = g["dim"][0].as_py(), g["i"][0].as_py(), g["j"][0].as_py()
            tiles, raw, copies = np.asarray(g["tile"]), g["x"].to_pylist(), np.asarray(g["copies"])
            ids = g["rep"].combine_chunks()
            left = np.flatnonzero(tiles == i)
            right = left if i == j else np.flatnonzero(tiles == j)
            if not len(left) or not len(right):
                continue
            a = Tile([raw[k] for k in left], dim)
            m = matches(a, a if i == j else Tile([raw[k] for k in right], dim), threshold)
            n = len(raw)
            whole = np.zeros((n, n), bool)
            whole[np.ix_(left, right)] = m
            whole |= whole.T
            np.fill_diagonal(whole, False)
            links = whole @ copies
            up = np.full(n, -1, np.int64)
            for child, root in local_links(whole):
                up[child] = root
            at = np.flatnonzero((links > 0) | (up >= 0))
            if len(at):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(links[at].astype(np.int64)), ids.take(pa.array(up[at], mask=up[at] < 0))], ["id", "links", "up"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("links", T.LongType()), T.StructField("up", kind)])
    found = written(cut.mapInArrow(link, schema), "links")
    # a representative of several digests (rows that repeat an id) joins them by its id
    same = all_.where("digest is not null").join(unique.select(*keys, "rep"), keys).where("id != rep").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a != b").select("a", "b")
    parts = components(found.where("up is not null").select(F.col("id").alias("a"), F.col("up").alias("b")).union(same))
    count = found.groupBy("id").agg(F.sum("links").alias("links"))
    label = (
        unique.select(*keys, "rep", "copies")
        .join(count.withColumnRenamed("id", "rep"), "rep", "left")
        .join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        .select(*keys, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    out = all_.select("id", *keys).join(label, keys, "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True)))


def op4_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
n AS (SELECT *, sqrt(list_sum(list_transform(x, lambda y: y * y))) AS norm FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
      WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.98),
d AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN d ON d.a = e.vec_id JOIN c ON c.a = e.vec_id
"""

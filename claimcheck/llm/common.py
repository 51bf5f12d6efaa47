"""What several operators share: Arrow text kernels, shared-folder tables, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step works on; bounds the memory of a Python worker.
STEP_BYTES = 1 << 20

#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only where that is unset and Spark runs in one process (tests, a bench) a temporary folder is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = getattr(shared_folder, "own", None) or tempfile.mkdtemp(prefix="checkpoint-")
        shared_folder.own = found
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch between the JVM and a Python worker, where the session names none of its own.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def small_batches(spark: SparkSession) -> None:
    """Long texts come in small batches: both sides hold one whole. Settings that differ from Spark's own stay."""
    for key, (default, own) in BATCH.items():
        if spark.conf.get(key, default) in (default, default.rstrip("b")):
            spark.conf.set(key, own)


def released() -> None:
    """Give freed memory back to the system: an idle worker holds little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(f: Callable) -> Callable:
    """``f`` over batches, after which the worker's freed memory is given back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            released()

    return run


def strings(column: pa.Array) -> pa.StringArray:
    """No nulls (they become empty) and plain 32-bit offsets from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string array without nulls."""
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(1, np.int32), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def from_parts(offsets: np.ndarray, data: np.ndarray) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def translated(column: pa.StringArray, table: np.ndarray) -> pa.StringArray:
    """Each byte through ``table``, which must leave bytes from 0x80 as they are."""
    offsets, data = parts(column)
    return from_parts(offsets, table[data])


def steps(batches: Iterable[pa.RecordBatch], text: str, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``size`` bytes of text, or one row."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        at = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64))
        start = 0
        while start < n:
            base = at[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(at, base + size, "right")))
            yield batch.slice(start, end - start)
            start = end


def words_of(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """Words between ASCII white space: (offsets by row, codes, distinct words)."""
    lists = pc.ascii_split_whitespace(column)
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    flat = lists.flatten()
    offsets = offsets - offsets[0]
    full = np.asarray(pc.binary_length(flat)) > 0
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        flat = flat.filter(pa.array(full))
    encoded = flat.dictionary_encode()
    return offsets, np.asarray(encoded.indices), encoded.dictionary


def hashed(words: pa.StringArray) -> np.ndarray:
    """A fixed 64-bit hash of each string, the same on every machine."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(column: pa.StringArray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row as 64-bit hashes: (offsets, sorted hashes by row).

    With fewer than k words, the whole sequence is the one shingle; without words there is none.
    """
    offsets, codes, distinct = words_of(translated(column, LOWER))
    h = mixed(hashed(distinct) + np.uint64(0x9E3779B97F4A7C15))[codes]
    n = np.diff(offsets)
    rows = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(codes)) - offsets[:-1][rows]
    size = np.minimum(n, k)[rows]
    first = place <= n[rows] - size
    at = np.flatnonzero(first)
    acc = np.zeros(len(at), np.uint64)
    for j in range(k):
        inside = j < size[at]
        acc = np.where(inside, mixed(acc * np.uint64(0xD6E8FEB86659FD93) + h[np.minimum(at + j, max(len(h) - 1, 0))]) if len(h) else acc, acc)
    # shorter sequences are kept apart from k-word shingles by their length
    acc = mixed(acc + size[at].astype(np.uint64))
    row = rows[at]
    order = np.lexsort((acc, row))
    row, acc = row[order], acc[order]
    new = np.ones(len(acc), bool)
    new[1:] = (acc[1:] != acc[:-1]) | (row[1:] != row[:-1])
    row, acc = row[new], acc[new]
    return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))]).astype(np.int64), acc


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, from batches sorted by them; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        cut = np.zeros(batch.num_rows, bool)
        for c in columns:
            cut[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(cut).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over 0..n-1 where the smallest index is the root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def local_links(match: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest (pairs i > j) of the graph with this symmetric boolean matrix."""
    n = len(match)
    left = np.ones(n, bool)
    out = []
    for s in range(n):
        if not left[s]:
            continue
        left[s] = False
        edge = [s]
        while edge:
            x = edge.pop()
            new = np.flatnonzero(match[x] & left)
            left[new] = False
            out += [(int(y), s) for y in new]
            edge += new.tolist()
    return out


#: Edges that one step of ``stars`` joins; bounds the memory of a Python worker.
BLOCK = 200_000


def stars(edges: DataFrame, block: int) -> DataFrame:
    """Fewer edges (u, v) with the same components: of each block of edges, each node to the smallest that the block links it to.

    A block are at most ``block`` edges of one partition, and the rest of an Arrow batch.
    """

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        nodes = pa.chunked_array([*t["u"].chunks, *t["v"].chunks]).unique()
        nodes = nodes.take(pc.sort_indices(nodes))
        forest = Forest(len(nodes))
        for x, y in zip(*(pc.index_in(t[c], value_set=nodes).to_pylist() for c in ("u", "v"))):
            forest.join(x, y)
        root = np.array([forest.root(x) for x in range(len(nodes))], np.int64)
        at = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(at)), nodes.take(pa.array(root[at]))], ["u", "v"])

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= block:
                yield star(held)
                held, n = [], 0
        if held:
            yield star(held)

    return edges.select("u", "v").mapInArrow(lean(contract), edges.select("u", "v").schema)


def components(edges: DataFrame, a: str = "a", b: str = "b", *, block: int = BLOCK) -> DataFrame:
    """(node, component) for each node of an edge, component the smallest reachable node.

    Blocks of edges are first contracted to stars, each by itself. Then alternating large-star and
    small-star steps, until each node has one edge, to a node that has
    none itself: where all edges are one block, that holds from the start. A round is two partially
    aggregated minima and two joins that can be split where a
    node has very many edges; each round is written to the shared folder. Only a count reaches the
    driver. Edges with null or equal
    ends are left out; an empty input gives an empty result.
    """
    kind = edges.schema[a].dataType
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` != `{b}`").where("u is not null and v is not null")
    e = written(e, "edges")
    e = written(stars(e.coalesce(max(1, -(-e.count() // block))), block), "edges")
    while True:
        several = e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
        between = e.select("u").join(e.select(F.col("v").alias("u")), "u", "left_semi")
        if several.union(between).agg(F.count(F.lit(1))).first()[0] == 0:
            break
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = e.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # large-star keeps an edge of each node to the smallest of its neighbours' neighbourhoods
        large = written(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(low.select("u", F.col("m").alias("v"))).distinct()
        e = written(small, "edges")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).select(F.col("node").cast(kind), F.col("component").cast(kind))

"""Best-fit packing of tokenised documents into sequences by linear grouping.

Lengths are whole numbers up to the capacity, so the whole problem is a histogram of at most
``capacity`` counts; it is solved on the driver in time that does not grow with the documents.
Large lengths are cut into groups of equal cardinality and rounded up to the largest of their
group; configurations of these few sizes are built largest first, each completed to the best
possible fill, and used as often as the counts allow; actual lengths replace the rounded ones
in descending order; then small pieces go, best fit, into what is left and into new sequences.
The plan is a list of intervals: pieces of length L with ranks [a, b) go to sequences s, s+1, ...
at offset o. Documents meet it by their length and their rank among pieces of that length,
which is counted by partition, so nothing but the histogram reaches the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import STEP, Encoder
from .common import lean, small_batches, steps, strings, written

CAPACITY = 2048
GROUPS = 1024


def _fill(sizes: list[int], counts: list[int], room: int) -> list[tuple[int, int]]:
    """(index, times) of a largest sum <= room with bounded counts; among equals, larger sizes first."""
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    trace: list[tuple[int, int, np.ndarray]] = []
    for k, (size, count) in enumerate(zip(sizes, counts)):
        take = 1
        while count > 0 and size * take <= room and not reach[room]:
            t = min(take, count)
            if size * t <= room:
                before = reach
                reach = before.copy()
                reach[size * t :] |= before[: room + 1 - size * t]
                trace.append((k, t, before))
            count -= t
            take *= 2
        if reach[room]:
            break
    at = int(np.flatnonzero(reach)[-1])
    out: Counter = Counter()
    for k, t, before in reversed(trace):
        if not before[at]:
            at -= sizes[k] * t
            out[k] += t
    return sorted(out.items())


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int | None = None) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(intervals, sequences): an interval is (length, first rank, last rank + 1, first sequence, offset).

    Lengths of at least ``small`` (capacity / 4 unless given) are grouped. Every rank of every length is in one interval.
    """
    small = small or max(1, capacity // 4)
    out: list[tuple[int, int, int, int, int]] = []
    used: Counter = Counter()
    base = 0

    def place(length: int, times: int, first: int, offset: int) -> None:
        out.append((length, used[length], used[length] + times, first, offset))
        used[length] += times

    if histogram.get(capacity):
        place(capacity, histogram[capacity], 0, 0)
        base = histogram[capacity]
    large = sorted(((k, v) for k, v in histogram.items() if small <= k < capacity and v), reverse=True)
    # groups of equal cardinality, whole lengths kept together where they fit
    total = sum(v for _, v in large)
    each = max(1, -(-total // groups))
    stock: list[list[list[int]]] = []  # per group: [length, count], descending
    room = 0
    for length, count in large:
        while count:
            if not room or not stock:
                stock.append([])
                room = each
            t = min(count, room)
            stock[-1].append([length, t])
            count, room = count - t, room - t
    sizes = [g[0][0] for g in stock]
    left = [sum(c for _, c in g) for g in stock]
    # bins as runs: residual capacity to the runs (first sequence, how many) that have it
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    k = 0
    while k < len(sizes):
        if not left[k]:
            k += 1
            continue
        left[k] -= 1
        config = Counter({k: 1})
        more = [j for j in range(k, len(sizes)) if left[j] and sizes[j] <= capacity - sizes[k]]
        for j, t in _fill([sizes[j] for j in more], [left[j] for j in more], capacity - sizes[k]) if more else ():
            config[more[j]] += t
        left[k] += 1
        times = min(left[j] // t for j, t in config.items())
        for j, t in config.items():
            left[j] -= t * times
        # substitute actual lengths, slot by slot; a slot's lengths cut the run of sequences into pieces
        spans = [(base, times, 0)]
        for j in sorted(config):
            for _ in range(config[j]):
                new = []
                for first, n, offset in spans:
                    while n:
                        head = stock[j][0]
                        t = min(n, head[1])
                        place(head[0], t, first, offset)
                        new.append((first, t, offset + head[0]))
                        head[1] -= t
                        if not head[1]:
                            stock[j].pop(0)
                        first, n = first + t, n - t
                spans = new
        base += times
        for first, n, offset in spans:
            runs[capacity - offset].append((first, n))
    residuals = sorted(r for r in runs if r)
    for length in sorted((k for k, v in histogram.items() if 0 < k < small and v), reverse=True):
        count = histogram[length]
        while count:
            at = bisect_left(residuals, length)
            if at == len(residuals):
                # new sequences, each filled with as many of this length as are left
                per = min(count, capacity // length)
                times = count // per
                for slot in range(per):
                    place(length, times, base, slot * length)
                rest = capacity - per * length
                count -= per * times
                if rest:
                    if rest not in runs or not runs[rest]:
                        insort(residuals, rest)
                    runs[rest].append((base, times))
                base += times
                continue
            room = residuals[at]
            first, n = runs[room].pop()
            t = min(n, count)
            if t < n:
                runs[room].append((first + t, n - t))
            if not runs[room]:
                residuals.pop(at)
            place(length, t, first, capacity - room)
            count -= t
            rest = room - length
            if rest:
                if not runs[rest]:
                    insort(residuals, rest)
                runs[rest].append((first, t))
    return out, base


def pieces(documents: DataFrame, *, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """id, piece, start, length, ids_crc32 of each piece: whole texts (null: empty) with the end id, cut only where longer than ``capacity``."""
    kind = documents.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, end_id)
        for b in steps(batches, "text", STEP):
            offsets, ids = encoder(strings(b.column("text")))
            view = memoryview(ids.astype("<u4")).cast("B")
            row, piece, start, length, crc = [], [], [], [], []
            for i in range(len(offsets) - 1):
                n = int(offsets[i + 1] - offsets[i])
                for p in range(-(-n // capacity)):
                    a, z = p * capacity, min(n, (p + 1) * capacity)
                    row.append(i)
                    piece.append(p)
                    start.append(a)
                    length.append(z - a)
                    crc.append(zlib.crc32(view[4 * (offsets[i] + a) : 4 * (offsets[i] + z)]))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(cut), f"id {kind}, piece int, start long, length long, ids_crc32 long")


def packed(documents: DataFrame, *, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Sequences are gapless from offset 0. Rows that repeat a document are packed as often as
    they stand there; null ids are carried along; an empty table gives no rows; other columns
    are not read.
    """
    spark = documents.sparkSession
    small_batches(spark)
    out = [F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32"]
    made = written(pieces(documents, tokenizer=tokenizer, end_id=end_id, id_col=id_col, text_col=text_col, capacity=capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    intervals, _ = plan(histogram, capacity, groups)
    # rank among pieces of one length: (salt, place within salt and length); salts keep a common length apart
    salted = made.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(max(1, min(65536, sum(histogram.values()) // 200_000 + 16)))))
    ranked = salted.withColumn("k", F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece")) - 1)
    sums = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    ahead = sums.withColumn("ahead", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    ranked = ranked.join(ahead, ["length", "salt"]).withColumn("rank", F.col("ahead") + F.col("k"))
    # the plan has at most a few intervals for each of ``capacity`` lengths, whatever the input
    by = defaultdict(list)
    for length, a, z, first, offset in sorted(intervals):
        by[length].append((a, z, first, offset))
    table = pa.table({"length": pa.array(list(by), pa.int64()), "plan": pa.array([[{"a": a, "z": z, "first": f, "at": o} for a, z, f, o in v] for v in by.values()], pa.list_(pa.struct([(c, pa.int64()) for c in ("a", "z", "first", "at")])))})
    layout = spark.createDataFrame(table.to_pandas(), "length long, plan array<struct<a: long, z: long, first: long, at: long>>") if len(by) else spark.createDataFrame([], "length long, plan array<struct<a: long, z: long, first: long, at: long>>")
    steps_ = layout.select("length", F.inline("plan"))
    return (
        ranked.join(F.broadcast(steps_), (ranked["length"] == steps_["length"]) & (F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("z")))
        .select(*out[:3], ranked["length"], "ids_crc32", (F.col("first") + F.col("rank") - F.col("a")).alias("sequence_id"), F.col("at").alias("offset"))
    )


TOKENIZER, END_ID = "word_bpe_49k.json", 0


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packed(documents, tokenizer=TOKENIZER, end_id=END_ID)

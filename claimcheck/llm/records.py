"""Token ids as length-delimited binary records, with a separate offset index.

A file is a run of frames, all integers little-endian::

    u64 length of the payload | u64 offset of the frame in its file
    | u32 masked crc32 of those 16 bytes | payload | u32 masked crc32 of the payload | marker

    payload: u8 flags (1: the id is present) | i64 id | u8 bytes per token id (2 or 4) | ids

The mask rotates a checksum right by 15 bits and adds 0xA282EAD8, so that the checksum of data
that holds checksums stays useful. The marker is 32 random characters of a dataset's own, kept
beside the files: a reader that starts anywhere finds the next frame by it, so large files are
read by many tasks, a frame at a time. Files are numbered in ascending order of the ids they
hold. Reading back checks every length, offset and checksum and yields the index: file, offset
and length of each frame, so that a loader can fetch frames in any order.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import STEP, Encoder
from .common import lean, shared_path, small_batches, steps, strings

HEAD, TAIL = struct.Struct("<QQI"), struct.Struct("<I")
PAYLOAD = struct.Struct("<BqB")
#: Text bytes of a file at most; fewer where the cluster would otherwise have less than WAVES tasks a core.
FILE_BYTES, LEAST_BYTES, WAVES = 256 << 20, 16 << 20, 4


def masked(crc: int) -> int:
    return ((((crc >> 15) | (crc << 17)) & 0xFFFFFFFF) + 0xA282EAD8) & 0xFFFFFFFF


def frame(data: bytes, at: int) -> bytes:
    """Without the closing marker, which the writer adds."""
    head = struct.pack("<QQ", len(data), at)
    return b"".join([head, TAIL.pack(masked(zlib.crc32(head))), data, TAIL.pack(masked(zlib.crc32(data)))])


def checked(row: memoryview) -> tuple[int, memoryview]:
    """(offset, payload) of one frame without its marker; raises ValueError where it is damaged."""
    if len(row) < HEAD.size + TAIL.size:
        raise ValueError("a frame is cut off")
    size, at, crc = HEAD.unpack_from(row)
    if masked(zlib.crc32(row[:16])) != crc:
        raise ValueError("the head of a frame is damaged")
    if len(row) != HEAD.size + size + TAIL.size:
        raise ValueError(f"the frame at byte {at} is cut off")
    if masked(zlib.crc32(row[HEAD.size : HEAD.size + size])) != TAIL.unpack_from(row, HEAD.size + size)[0]:
        raise ValueError(f"the payload at byte {at} is damaged")
    return at, row[HEAD.size : HEAD.size + size]


def payload(key: int | None, ids: np.ndarray, width: int) -> bytes:
    return PAYLOAD.pack(key is not None, key or 0, width) + ids.astype(f"<u{width}").tobytes()


def opened(data: memoryview) -> tuple[int | None, bytes]:
    """The id and the token ids (u32) of a payload."""
    flags, key, width = PAYLOAD.unpack_from(data)
    return key if flags & 1 else None, np.frombuffer(data[PAYLOAD.size :], f"<u{width}").astype("<u4").tobytes()


def frames(data: bytes, marker: str) -> Iterator[tuple[int, memoryview]]:
    """(offset, payload) of each frame of a whole file, by lengths alone; raises ValueError where it is damaged."""
    view, at, end = memoryview(data), 0, marker.encode()
    while at < len(view):
        size = HEAD.size + struct.unpack_from("<Q", view, at)[0] + TAIL.size if at + HEAD.size <= len(view) else 0
        found, held = checked(view[at : at + size])
        if found != at or bytes(view[at + size : at + size + len(end)]) != end:
            raise ValueError(f"a frame is cut off at byte {at}")
        yield at, held
        at += size + len(end)


def write_records(documents: DataFrame, path: str, *, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Encode every whole text (null: empty), append ``end_id`` and write ``path``/frames and ``path``/marker.

    Rows go in ascending order of id (null ids first), rows of one id in order of text; very
    long texts are one frame. Other columns are not read. An empty table makes no frames.
    """
    spark = documents.sparkSession
    small_batches(spark)
    total = documents.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(1, -(-total // file_bytes), min(-(-total // LEAST_BYTES), WAVES * spark.sparkContext.defaultParallelism))
    marker = uuid.uuid4().hex
    mark = marker.encode()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, end_id)
        width = 2 if max(encoder.size, end_id + 1) <= 1 << 16 else 4
        at = 0
        for b in steps(batches, "text", STEP):
            offsets, ids = encoder(strings(b.column("text")))
            out = []
            for i, k in enumerate(b.column("id").to_pylist()):
                out.append(frame(payload(k, ids[offsets[i] : offsets[i + 1]], width), at))
                at += len(out[-1]) + len(mark)
                if mark in out[-1]:
                    raise ValueError("the data hold the marker; write them again, with another")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(int(n), "id").sortWithinPartitions("id", "text") if n > 1 else rows.coalesce(1).sortWithinPartitions("id", "text")
    # bytes pass through a string column unchanged; a task writes one file; the writer adds the marker
    framed = rows.mapInArrow(lean(encode), "frame binary").select(F.col("frame").cast("string").alias("value"))
    framed.write.options(compression="none", lineSep=marker, maxRecordsPerFile=0).text(f"{path}/frames")
    spark.createDataFrame([(marker,)], "value string").coalesce(1).write.text(f"{path}/marker")


def read_records(spark: SparkSession, path: str, *, columns: str = "index") -> DataFrame:
    """The frames of all files: file, offset, length, id, n_tokens, ids_crc32; or with the ids.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers. ``columns="ids"``
    adds them as binary (u32).
    """
    full = columns == "ids"
    small_batches(spark)
    marker = spark.read.text(f"{path}/marker").first()[0]
    names = ["file", "offset", "length", "id", "n_tokens", "ids_crc32"] + ["ids"] * full
    kinds = [pa.int64()] * 6 + [pa.binary()] * full

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in names]
            for row, file in zip(b.column("row"), b.column("file").to_pylist()):
                offset, held = checked(memoryview(row.as_buffer()))
                key, ids = opened(held)
                for c, x in zip(out, (file, offset, len(held), key, len(ids) // 4, zlib.crc32(ids), ids)):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    rows = spark.read.option("lineSep", marker).text(f"{path}/frames")
    rows = rows.select(F.col("value").cast("binary").alias("row"), F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long").alias("file"))
    return rows.mapInArrow(lean(parse), ", ".join(f"{c} long" for c in names[:6]) + ", ids binary" * full)


def write_dataset(documents: DataFrame, path: str, **options) -> DataFrame:
    """Write the files, read them back and write the offset index beside them; returns the index.

    Its ``start`` is the number of ids in all frames before a frame, counted from what was read:
    within a file (of bounded size) in order of offsets, plus the totals of the files before it.
    """
    spark = documents.sparkSession
    write_records(documents, path, **options)
    read_records(spark, path).write.parquet(f"{path}/index")
    index = spark.read.parquet(f"{path}/index")
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    ahead = totals.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("ahead"))
    before = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("offset")) - F.col("n_tokens")
    return index.withColumn("before", before).join(ahead, "file").select("file", "offset", "length", "id", (F.col("ahead") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


TOKENIZER, END_ID = "byte_bpe_50k.json", 2


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    index = write_dataset(documents, shared_path(spark, "records"), tokenizer=TOKENIZER, end_id=END_ID)
    return index.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")

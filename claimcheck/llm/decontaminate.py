"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

Every benchmark item is cut into windows of ``window`` consecutive words (a shorter item is
one window). A window must be contained whole, so of its tokens, ordered by rarity in the
documents, the necessary prefix is one token: the rarest. A document can contain a window only
where it has that token, with room before it for the token's position in the window and room
after it for the rest; only those places are verified, word by word.

The benchmark side is taken in blocks of at most ``max_index_words`` words, so what is sent to
the tasks has a fixed bound; a larger benchmark means more passes over the documents, never a
larger broadcast. The documents are not shuffled: a document's blocks meet by its row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import from_parts, lean, parts, small_batches, steps, strings, unused, words_of

#: Bytes of words stay (A-Z as a-z), all others become a space: 0-9, a-z and everything from 0x80.
WORD_BYTES = np.full(256, 0x20, np.uint8)
WORD_BYTES[0x30:0x3A] = np.arange(0x30, 0x3A)
WORD_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)
WORD_BYTES[0x61:0x7B] = np.arange(0x61, 0x7B)
WORD_BYTES[0x80:] = np.arange(0x80, 0x100)

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


def split_words(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    offsets, data = parts(column)
    return words_of(from_parts(offsets, WORD_BYTES[data]))


class Index:
    """Windows of one block of the benchmark, over the block's own small vocabulary."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        offsets, codes, vocabulary = split_words(pa.array([t for _, t in items], pa.string()))
        self.vocabulary = vocabulary
        found: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for i, (item, _) in enumerate(items):
            w = codes[offsets[i] : offsets[i + 1]].tolist()
            for j in range(max(1, len(w) - window + 1)) if w else ():
                found[tuple(w[j : j + window])].add(item)
        self.windows = sorted(found)
        self.items = [sorted(found[w]) for w in self.windows]
        self.probes: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def by_rarity(self, counts: np.ndarray) -> None:
        """Choose each window's rarest token and lay the windows out for probing."""
        laid: dict[tuple[int, int], list[int]] = defaultdict(list)
        for k, w in enumerate(self.windows):
            place = min(range(len(w)), key=lambda p: (counts[w[p]], w[p], p))
            laid[len(w), place].append(k)
        for (size, place), ks in sorted(laid.items()):
            rows = np.array([self.windows[k] for k in ks], np.int64)
            key = rolled(rows)
            order = np.argsort(key, kind="stable")
            token = np.zeros(len(self.vocabulary) + 1, bool)
            token[rows[:, place]] = True
            self.probes.append((size, place, token, key[order], rows[order], np.array(ks)[order]))

    def hits(self, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, window) of each occurrence; codes are of this vocabulary, -1 for other words."""
        rows, starts, which = [], [], []
        doc = None
        for size, place, token, keys, contents, ids in self.probes:
            at = np.flatnonzero(token[codes])
            if not len(at):
                continue
            if doc is None:
                doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            row, start = doc[at], at - place
            fits = (start >= offsets[row]) & (start + size <= offsets[row + 1])
            row, start = row[fits], start[fits]
            for a in range(0, len(start), 1 << 16):
                r, s = row[a : a + (1 << 16)], start[a : a + (1 << 16)]
                here = codes[s[:, None] + np.arange(size)]
                key = rolled(here)
                lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                while (on := lo < hi).any():  # more than once only where two windows share a key
                    j = np.flatnonzero(on)
                    same = (contents[lo[j]] == here[j]).all(1)
                    rows.append(r[j[same]])
                    starts.append(s[j[same]])
                    which.append(ids[lo[j[same]]])
                    lo = lo + 1
        none = np.zeros(0, np.int64)
        return (np.concatenate(rows), np.concatenate(starts), np.concatenate(which)) if rows else (none, none, none)


def rolled(rows: np.ndarray) -> np.ndarray:
    acc = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + (rows[:, j] + 1).astype(np.uint64)
        acc ^= acc >> np.uint64(29)
    return acc


def in_vocabulary(codes: np.ndarray, distinct: pa.StringArray, vocabulary: pa.StringArray) -> np.ndarray:
    to = np.asarray(pc.fill_null(pc.index_in(distinct, value_set=vocabulary), -1), np.int64)
    return to[codes] if len(to) else codes.astype(np.int64)


def _counts(documents: DataFrame, text: str, vocabulary: pa.StringArray) -> np.ndarray:
    """How often the documents hold each word of the vocabulary (bounded, so collected)."""
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value) + 1, np.int64)
        for b in steps(batches, text):
            _, codes, distinct = split_words(strings(b.column(text)))
            total += np.bincount(in_vocabulary(codes, distinct, sent.value) + 1, minlength=len(total))
        at = np.flatnonzero(total[1:])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[1:][at], pa.int64())], ["word", "n"])

    got = documents.select(text).mapInArrow(lean(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary), np.int64)
    for r in got:
        out[r.word] = r.n
    return out


def _blocks(benchmark: DataFrame, item: str, text: str, bound: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of about ``bound`` words; one partition's rows are on the driver at a time."""
    held, n = [], 0
    rows = benchmark.select(F.col(item).cast("string"), F.col(text)).where(F.col(item).isNotNull() & F.col(text).isNotNull())
    for r in rows.toLocalIterator():
        size = len(r[1]) // 2 + 1
        if held and n + size > bound:
            yield held
            held, n = [], 0
        held.append((r[0], r[1]))
        n += size
    yield held


def contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 8,
    max_index_words: int = 500_000,
    into: str = "contamination",
    keep: list[str] | None = None,
) -> DataFrame:
    """All columns of ``documents`` (or those in ``keep``) and a struct ``into``: n_words, n_hit, items, spans.

    ``items`` are the ids (as strings, sorted) of the items that have an occurring window,
    ``spans`` the maximal runs [start, end) of hit words. Null or empty text has no words.
    Items with null id or text have no window; items of one id count once; equal windows of
    several items report them all. Repeated rows are answered one by one; of a window's words that are
    equally rare the first in order is probed; very long texts are read whole; an empty table gives no rows. A column already
    named ``into`` is replaced.
    """
    spark = documents.sparkSession
    small_batches(spark)
    names = [c for c in documents.columns if c != into]
    out = documents.select(names)
    blocks = _blocks(benchmark, item_col, item_text_col, max_index_words)
    block, k = next(blocks), 0
    while block is not None:
        after = next(blocks, None)
        passed = names if after is not None or keep is None else [c for c in names if c in keep]
        schema = T.StructType([*(documents.schema[c] for c in passed), T.StructField(into, FOUND)])
        index = Index(block, window)
        index.by_rarity(_counts(documents, text_col, index.vocabulary))
        index.windows = []
        sent = spark.sparkContext.broadcast(index)

        def find(batches: Iterator[pa.RecordBatch], sent=sent, passed=passed, again: bool = k > 0) -> Iterator[pa.RecordBatch]:
            index = sent.value
            kind = None
            for b in steps(batches, text_col):
                old = b.column(b.num_columns - 1).to_pylist() if again else None
                offsets, codes, distinct = split_words(strings(b.column(text_col)))
                row, start, which = index.hits(offsets, in_vocabulary(codes, distinct, index.vocabulary))
                size = np.array([p[0] for p in index.probes], np.int64)
                length = np.zeros(len(index.items), np.int64)
                for s, p in zip(size, index.probes):
                    length[p[5]] = s
                found = [{"n_words": int(n), "n_hit": 0, "items": [], "spans": []} for n in np.diff(offsets)]
                order = np.argsort(row, kind="stable")
                cuts = np.flatnonzero(np.diff(row[order])) + 1
                for at in np.split(order, cuts) if len(order) else ():
                    r = int(row[at[0]])
                    begin = start[at] - offsets[r]
                    marks = np.zeros(found[r]["n_words"] + 1, np.int64)
                    np.add.at(marks, begin, 1)
                    np.add.at(marks, begin + length[which[at]], -1)
                    items = set().union(*(index.items[w] for w in np.unique(which[at]).tolist()))
                    found[r] |= {"items": items, "marks": marks}
                for r, f in enumerate(found):
                    marks = f.pop("marks", None)
                    if old and old[r]["spans"]:
                        marks = np.zeros(f["n_words"] + 1, np.int64) if marks is None else marks
                        for s in old[r]["spans"]:
                            marks[s["start"]] += 1
                            marks[s["end"]] -= 1
                        f["items"] = set(f["items"]) | set(old[r]["items"])
                    if marks is not None:
                        hit = np.concatenate([[0], (np.cumsum(marks[:-1]) > 0).astype(np.int8), [0]])
                        edge = np.diff(hit)
                        f["n_hit"] = int(hit.sum())
                        f["spans"] = [{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
                    f["items"] = sorted(f["items"])
                kind = kind or pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in passed), pa.array(found, kind)], [*passed, into])

        out = out.mapInArrow(lean(find), schema)
        block, k = after, k + 1
    return out


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, *, min_items: int = 1, **options) -> DataFrame:
    """The documents, all columns unchanged, that hold windows of fewer than ``min_items`` items.

    Null and empty texts hold none and stay; repeated rows are judged one by one; an empty benchmark
    lets all pass.
    """
    into = unused(documents, "contamination")
    found = contaminated(documents, benchmark, into=into, **options)
    return found.where(F.size(f"{into}.items") < min_items).drop(into)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    c = F.col("contamination")
    return contaminated(documents, benchmark, keep=["doc_id"]).select(
        "doc_id",
        c.n_words.alias("n_words"),
        c.n_hit.alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", c["items"]).cast("binary"), 256).alias("items_sha256"),
        (F.size(c["items"]) >= 2).alias("contaminated"),
    )


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, len(ws[p:p+7]) AS size, array_to_string(ws[p:p+7], ' ') AS win FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws)-7))) AS p FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, p, array_to_string(ws[p:p+size-1], ' ') AS win FROM (SELECT doc_id, ws, size, unnest(generate_series(1, len(ws)-size+1)) AS p FROM w, sizes WHERE len(ws) >= size)),
h AS (SELECT dw.doc_id, dw.p, dw.size, iw.item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.size = iw.size),
hit AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(generate_series(p, p+size-1)) AS q FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items,
       sha256(coalesce(it.l, '')) AS items_sha256, coalesce(it.n, 0) >= 2 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

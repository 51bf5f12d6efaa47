"""Language-model scoring with a weighted backoff automaton over words.

Texts are sequences of words (between ASCII white space, A-Z lower-cased) and one end. The model
holds all n-grams of up to ``order`` words of the training texts, smoothed towards shorter
contexts: p(w | h) = (c(hw) + k p(w | h')) / (c(h) + k), where h' is h without its first word. As
an automaton: a context is a state; an n-gram is an arc with that weight to the state of its last
words; a state without an arc for a word follows its failure arc to the state of the shorter
context, at the weight k / (c(h) + k). A text is one left-to-right traversal from the start state
that carries the state and adds up log-probabilities. In the empty context, known words share
1 - u by their counts, and an unknown word has u (the share of words seen once) times the weight
of its path through an automaton of the same kind over bytes. What the bytes' model gives to known
words is left out, so the probabilities add up to a little less than one.

No n-gram is pruned and the automaton is never in one place. Documents are cut into blocks of
bounded size as they are read. A block asks for each of its distinct n-grams once, with the
block's training count; questions go by ranges of a hash, where the counts of all blocks are summed
up, and come back to the block, which builds the part of the automaton that its own texts can
reach. So what is gathered grows with the corpus, tasks stay of one size, a word that stands
everywhere is one question a block, and nothing is broadcast.

N-grams are known by 64 bits of a hash; those of two and more words by enough bits that one in
2^24 shares its place with another (``bits``), which keeps the questions small.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, groups, hashed, lean, mixed, parts, small_batches, strings, translated, words_of, written

ORDER, LETTERS = 3, 4
#: Weight of the shorter context, by words of the context; the same for bytes.
PRIOR = (3000.0, 30.0)
LETTER_PRIOR = (4.0, 4.0, 4.0)
#: Text bytes of a block.
BLOCK_BYTES = 8 << 20
#: Tokens between the places at which a long text is entered; a state depends on the last words only.
SEGMENT = 256
# Symbols of the bytes' automaton (fixed values): a byte, the end of a word, its start.
WORD_END, WORD_START = 256, 257
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


# --- bytes of columns ------------------------------------------------------------------------


def packed(x: np.ndarray) -> bytes:
    """Unsigned integers, byte by byte of their places, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(data.reshape(size, -1).T).view(kind).ravel()


# --- n-grams of a block ------------------------------------------------------------------------


class Level(NamedTuple):
    """The distinct n-grams of one size: sorted keys, the place of one occurrence, the n-gram at each place (-1: none), training counts."""

    keys: np.ndarray
    at: np.ndarray
    index: np.ndarray
    counts: np.ndarray


def levels(symbols: np.ndarray, place: np.ndarray, h: np.ndarray, order: int, weight: np.ndarray, start: int, bits: int = 64) -> list[Level]:
    """n-grams of 1 to ``order`` symbols. ``place`` counts within a sequence, which begins with ``start`` (no n-gram ends there)."""
    out, before = [], h[symbols]
    for k in range(1, order + 1):
        if k > 1:
            here = mixed(before[:-1] * GOLDEN + h[symbols[1:]] + np.uint64(k))
            before = np.concatenate([before[:1], here])
        at = np.flatnonzero((symbols != start) & (place >= k - 1))
        keys = before[at] if k == 1 else before[at] >> np.uint64(64 - bits)
        sort = np.argsort(keys)
        keys = keys[sort]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        which = np.empty(len(keys), np.int32)
        which[sort] = np.cumsum(new, dtype=np.int32) - 1
        index = np.full(len(symbols), -1, np.int32)
        index[at] = which
        counts = np.bincount(which, weights=weight[at], minlength=int(new.sum())).astype(np.int64)
        out.append(Level(keys[new], at[sort[new]], index, counts))
    return out


def byte_levels(symbols: np.ndarray, place: np.ndarray, order: int, weight: np.ndarray) -> list[Level]:
    """The same for bytes, in time linear in them: an n-gram is its first symbols' number and its last symbol. Keys are the symbols, not sorted."""
    out: list[Level] = []
    alphabet = WORD_START + 1
    for k in range(1, order + 1):
        at = np.flatnonzero((symbols != WORD_START) & (place >= k - 1))
        key, size = symbols[at], alphabet
        if k > 1:
            n = len(out[-1].keys)
            before = out[-1].index[at - 1]
            key, size = np.where(before < 0, n, before).astype(np.int64) * alphabet + key, (n + 1) * alphabet
        if size <= 1 << 24:
            here = np.zeros(size, bool)
            here[key] = True
            number = np.cumsum(here, dtype=np.int32) - 1
            which, n = number[key], int(here.sum())
        else:
            found, which = np.unique(key, return_inverse=True)
            n = len(found)
        one = np.zeros(n, np.int64)
        one[which] = at
        index = np.full(len(symbols), -1, np.int32)
        index[at] = which
        keys = np.full(n, k << 40, np.uint64)
        for j in range(k):
            keys |= symbols[one - j].astype(np.uint64) << np.uint64(9 * j)
        out.append(Level(keys, one, index, np.bincount(which, weights=weight[at], minlength=n).astype(np.int64)))
    return out


class Block(NamedTuple):
    """Texts as symbols: words by number, then the end, then the start; where each text begins."""

    symbols: np.ndarray
    place: np.ndarray
    first: np.ndarray
    words: pa.Array
    train: np.ndarray

    @classmethod
    def of(cls, codes: bytes, words: bytes, lengths: list[int], train: list[bool]) -> Block:
        raw = zstandard.ZstdDecompressor().decompress(words).decode("utf-8", "surrogatepass")
        words = pa.array(raw.split("\n") if raw else [], pa.string())
        n = np.asarray(lengths, np.int64)
        offsets = np.concatenate([[0], np.cumsum(n)])
        flat = unpacked(codes, "<u4").astype(np.int32)
        first = offsets[:-1] + 2 * np.arange(len(n))
        symbols = np.full(offsets[-1] + 2 * len(n), len(words), np.int32)
        row = np.repeat(np.arange(len(n)), n)
        symbols[np.arange(len(flat)) + 2 * row + 1] = flat
        symbols[first] = len(words) + 1
        place = np.arange(len(symbols)) - np.repeat(first, n + 2)
        return cls(symbols, place, first, words, np.repeat(np.asarray(train, bool), n + 2))

    def word_levels(self, order: int, bits: int) -> list[Level]:
        v = len(self.words)
        h = mixed(np.concatenate([hashed(self.words), np.array([1, 2], np.uint64)]) + GOLDEN)
        h[v:] = mixed(np.array([0x656E64, 0x7374617274], np.uint64))
        return levels(self.symbols, self.place, h, order, self.train, v + 1, bits)

    def letter_levels(self, order: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[Level]]:
        """(symbols, where each word begins, levels) of the words; counts: how often each stands in the block's training texts."""
        offsets, data = parts(self.words)
        n = np.diff(offsets)
        first = np.concatenate([[0], np.cumsum(n + 2)]).astype(np.int32)
        word = np.repeat(np.arange(len(n), dtype=np.int32), n + 2)
        place = np.arange(first[-1], dtype=np.int32) - first[:-1][word]
        symbols = np.full(first[-1], WORD_END, np.int32)
        symbols[place == 0] = WORD_START
        symbols[(place > 0) & (place <= n[word])] = data
        return symbols, first, byte_levels(symbols, place, order, counts[word].astype(np.float64))


# --- the automaton -----------------------------------------------------------------------------


class Automaton:
    """States, failure arcs with backoff weights, arcs; natural logarithms.

    The arc that a state of m symbols has for the symbol at a place is the n-gram of m + 1
    symbols that ends there, so arcs are found by the n-gram's number at that place.
    """

    def __init__(self, found: list[Level], counts: list[np.ndarray], base: np.ndarray, starts: int, prior: tuple[float, ...]) -> None:
        """From n-grams, their counts in the whole corpus and the weights of single symbols."""
        order = len(found)
        # the start of a text is a context like a single symbol, though no arc leads to it
        totals = [np.append(counts[0], starts), *counts[1:]]
        offset = np.concatenate([[1], 1 + np.cumsum([len(t) for t in totals[: order - 1]])]).astype(np.int64)
        states = int(offset[order - 1])
        self.fail, self.back, self.size = np.zeros(states, np.int32), np.zeros(states), np.zeros(states, np.int8)
        self.start = int(offset[1] - 1) if starts > 0 else 0
        for k in range(1, order):  # contexts of k symbols
            own = slice(int(offset[k - 1]), int(offset[k]))
            self.size[own] = k
            self.back[own] = math.log(prior[k - 1]) - np.log(totals[k - 1] + prior[k - 1])
            if k > 1:
                self.fail[own] = offset[k - 2] + found[k - 2].index[found[k - 1].at]
        self.index = [x.index for x in found]
        self.arcs = np.cumsum([0] + [len(x.keys) for x in found])[:-1]
        weights, to = [base], [np.where(counts[0] > 0, offset[0] + np.arange(len(base)), 0)]
        for k in range(2, order + 1):
            at, c = found[k - 1].at, counts[k - 1]
            prefix = found[k - 2].index[at - 1]
            prefix = np.where(prefix < 0, len(totals[k - 2]) - 1, prefix)  # only the start, before pairs
            suffix = found[k - 2].index[at]
            with np.errstate(divide="ignore"):
                w = np.log(c + prior[k - 2] * np.exp(weights[-1][suffix])) - np.log(totals[k - 2][prefix] + prior[k - 2])
            weights.append(np.where(c > 0, w, -np.inf))
            to.append(offset[k - 1] + np.arange(len(c)) if k < order else offset[k - 2] + suffix)
        self.weight, self.to = np.concatenate(weights), np.concatenate(to).astype(np.int32)

    def step(self, state: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, log-probabilities) for the symbols at these places: failure arcs until a state has an arc."""
        weight, out = np.zeros(len(state)), np.zeros(len(state), np.int32)
        todo = np.arange(len(state))
        for m in range(len(self.index) - 1, -1, -1):  # states of m symbols; their failure arcs lead to fewer
            own = self.size[state[todo]] == m
            who = todo[own]
            arc = self.arcs[m] + self.index[m][place[who]]
            paid = self.weight[arc]
            if m:
                hit = paid > -np.inf
                lost = who[~hit]
                who, arc, paid = who[hit], arc[hit], paid[hit]
                weight[lost] += self.back[state[lost]]
                state[lost] = self.fail[state[lost]]
                todo = np.concatenate([todo[~own], lost])
            weight[who] += paid
            out[who] = self.to[arc]
        return out, weight

    def walk(self, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The weight of each sequence: ``length`` symbols after its start at ``first``, read from left to right.

        Sequences are read side by side. Long ones are entered at every SEGMENT symbols as well: as
        many symbols as a context has, read from the empty one, lead to the state that the whole past leads to.
        """
        reach = len(self.index) - 1
        pieces = np.maximum(1, -(-length // SEGMENT))
        row = np.repeat(np.arange(len(first)), pieces)
        number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        warm = np.where(number > 0, reach, 0)
        begin = first[row] + 1 + number * SEGMENT - warm
        size = np.minimum(length[row] - number * SEGMENT, SEGMENT) + warm
        sort = np.argsort(-size, kind="stable")
        begin, warm_, size = begin[sort], warm[sort], size[sort]
        state = np.where(number[sort] > 0, 0, self.start).astype(np.int32)
        total = np.zeros(len(row))
        for i in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -i, "left"))
            state[:n], w = self.step(state[:n], begin[:n] + i)
            total[:n] += np.where(warm_[:n] <= i, w, 0.0)
        return np.bincount(row[sort], weights=total, minlength=len(first))


def text_scores(block: Block, found: list[Level], counts: list[np.ndarray], spelled: tuple, spelling: list[np.ndarray], totals: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known tokens, sum of log10(c + 0.5), log10 probability) of each text of a block.

    ``counts`` and ``spelling`` are the corpus counts of the n-grams of words and of bytes.
    """
    v = len(block.words)
    single = block.symbols[found[0].at]
    c = np.zeros(v + 2)
    c[single] = counts[0]
    size, ends = totals["tokens"], totals["ends"]
    unknown = min(0.5, max(totals["once"], 1) / size) if size else 0.5
    base = np.full(v + 2, -np.inf)
    base[c > 0] = np.log(c[c > 0]) + math.log(1 - unknown) - math.log(max(size, 1))
    if not ends:
        base[v] = math.log(0.5)
    which = np.flatnonzero(c[:v] == 0)
    if len(which):
        _, first, by = spelled
        p = np.log(spelling[0] + 0.5) - math.log(totals["letters"] + 0.5 * (WORD_END + 1))
        length = np.diff(first)[which] - 1
        base[which] = math.log(unknown) + Automaton(by, spelling, p, size - ends, LETTER_PRIOR).walk(first[which].astype(np.int64), length)
    length = np.diff(np.append(block.first, len(block.symbols))) - 1
    score = Automaton(found, counts, base[single], ends, PRIOR).walk(block.first, length) / math.log(10)
    row = np.repeat(np.arange(len(length)), length + 1)
    on = block.symbols != v + 1
    each = c[block.symbols]
    known = np.bincount(row, weights=on & (each > 0), minlength=len(length))
    low = np.bincount(row, weights=np.where(on, np.log10(each + 0.5), 0.0), minlength=len(length))
    return known, low, score


# --- over the corpus ---------------------------------------------------------------------------


def _blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """One row a block: ids, train, lengths (words of each text), codes, words; tokens, ends and letters of its training texts."""

    def made(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        column = lambda name: table.column(name).combine_chunks()
        offsets, codes, distinct = words_of(translated(strings(table.column("text")), LOWER))
        n, train = np.diff(offsets), np.asarray(column("train"), bool)
        on = np.repeat(train, n)
        size = np.asarray(pc.binary_length(distinct), np.int64)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        blob = lambda x: pa.array([x], pa.binary())
        words = zstandard.ZstdCompressor(level=1).compress("\n".join(distinct.to_pylist()).encode("utf-8", "surrogatepass"))
        ends = int(train.sum())
        letters = int((size[codes[on]] + 1).sum()) if on.any() else 0
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), one(column("id")), one(column("train")), one(pa.array(n.astype(np.int32))), blob(packed(codes.astype("<u4"))), blob(words), pa.array([int(on.sum()) + ends]), pa.array([ends]), pa.array([letters])],
            ["block", "ids", "train", "lengths", "codes", "words", "tokens", "ends", "letters"],
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        held, size = [], 0
        for b in batches:
            at = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column("text")), 0), np.int64) + 8)
            start = 0
            while start < b.num_rows:
                base = at[start - 1] if start else 0
                end = max(start + (not held), int(np.searchsorted(at, base + block_bytes - size, "right")))
                if end > start:
                    held.append(b.slice(start, end - start))
                    size += int(at[end - 1] - base)
                start = end
                if start < b.num_rows:
                    yield made(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield made(number, held)

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), *T._parse_datatype_string("train array<boolean>, lengths array<int>, codes binary, words binary, tokens long, ends long, letters long").fields])
    return rows.mapInArrow(lean(cut), schema)


def _widths(order: int, bits: int) -> list[int]:
    """Bits of the keys of each kind of question: n-grams of words by size, then all n-grams of bytes."""
    return [64] + [bits] * (order - 1) + [64]


def _questions(order: int, letters: int, bits: int, shards: int):
    """Rows (shard, block, keys, counts): a shard is a kind and a range of its keys."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                number = b.column("block")[r].as_py()
                block = Block.of(*(b.column(c)[r].as_py() for c in ("codes", "words", "lengths", "train")))
                found = block.word_levels(order, bits)
                c = np.zeros(len(block.words) + 2, np.int64)
                c[block.symbols[found[0].at]] = found[0].counts
                kinds = [(x.keys, x.counts) for x in found]
                del found
                spelled = block.letter_levels(letters, c)[2]
                keys = mixed(np.concatenate([x.keys for x in spelled]))
                sort = np.argsort(keys)
                kinds.append((keys[sort], np.concatenate([x.counts for x in spelled])[sort]))
                del spelled, block
                for kind, ((keys, counts), width) in enumerate(zip(kinds, _widths(order, bits))):
                    step = -(-(1 << width) // shards)
                    cuts = [0, *np.searchsorted(keys, np.array([k * step for k in range(1, shards)], np.uint64)).tolist(), len(keys)]
                    shard, raw, n = [], [], []
                    for s, (a, z) in enumerate(zip(cuts, cuts[1:])):
                        if z > a:
                            shard.append(kind * shards + s)
                            raw.append(packed(np.diff(keys[a:z], prepend=np.uint64(0))))
                            n.append(packed(counts[a:z].astype("<u8")))
                    yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array([number] * len(shard), pa.int64()), pa.array(raw, pa.binary()), pa.array(n, pa.binary())], ["shard", "block", "keys", "counts"])

    return ask


def _answers(shards: int):
    """Rows (shard, block, counts): what each block asked, summed up over all blocks; and of single words how many there are, and once only."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["shard"]):
            shard = g["shard"][0].as_py()
            asked = [np.cumsum(unpacked(x, "<u8"), dtype=np.uint64) for x in g["keys"].to_pylist()]
            keys = np.concatenate(asked)
            counts = np.concatenate([unpacked(x, "<u8") for x in g["counts"].to_pylist()]).astype(np.int64)
            cuts = np.cumsum([0] + [len(x) for x in asked])
            del asked
            sort = np.argsort(keys)
            keys = keys[sort]
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            del keys
            sums = np.add.reduceat(counts[sort], np.flatnonzero(new))
            total = np.empty(len(sort), np.uint64)
            total[sort] = sums[np.cumsum(new) - 1]
            single = shard < shards
            types, once = (int((sums > 0).sum()), int((sums == 1).sum())) if single else (0, 0)
            raw = [packed(total[a:z].astype("<u8")) for a, z in zip(cuts, cuts[1:])]
            n = len(raw)
            yield pa.RecordBatch.from_arrays([g["shard"].combine_chunks(), g["block"].combine_chunks(), pa.array(raw, pa.binary()), pa.array([types] + [0] * (n - 1)), pa.array([once] + [0] * (n - 1))], ["shard", "block", "answer", "types", "once"])

    return answer


def scored(documents: DataFrame, train, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, letters: int = LETTERS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, train, n_tokens, n_known, train_tokens, base_score, score of each row; ``train`` is a boolean column.

    Null texts are empty; an empty text is one end. A very long text is a block of its own. Rows
    that repeat a document are scored and counted as often as they stand there; a null id is
    carried along; ``train`` that is null counts as false. Without any training row every word is
    unknown and bytes are equally likely. Other columns are not read; an empty table gives no rows.
    Scores don't depend on how rows are dealt out.
    """
    if not 2 <= order <= len(PRIOR) + 1 or not 2 <= letters <= len(LETTER_PRIOR) + 1:
        raise ValueError("order and letters need a prior for each length of a context")
    spark = documents.sparkSession
    small_batches(spark)
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    made = written(_blocks(rows, block_bytes), "blocks")
    sums = made.agg(F.count(F.lit(1)).alias("blocks"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "ends", "letters"))).first().asDict()
    # by the size of the input: blocks to a task, questions to a shard, bits of a key
    blocks = sums["blocks"]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-blocks // 2))
    bits = min(64, 24 + max(20, math.ceil(math.log2(max(2, blocks * block_bytes)))))
    kinds = len(_widths(order, bits))
    questions = made.select("block", "codes", "words", "lengths", "train").mapInArrow(lean(_questions(order, letters, bits, shards)), "shard int, block long, keys binary, counts binary")
    dealt = questions.repartition(max(least, -(-kinds * shards // 4)), "shard").sortWithinPartitions("shard", "block")
    answers = written(dealt.mapInArrow(lean(_answers(shards)), "shard int, block long, answer binary, types long, once long"), "answers")
    sums |= answers.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "once"))).first().asDict()
    none = lambda c: F.lit(None).cast(made.schema[c].dataType).alias(c)
    held = ["ids", "train", "lengths", "codes", "words"]
    both = made.select("block", F.lit(-1).alias("shard"), *held, F.lit(None).cast("binary").alias("answer")).unionByName(answers.select("block", "shard", *(none(c) for c in held), "answer"))
    both = both.repartition(max(least, -(-blocks // 4)), "block").sortWithinPartitions("block", "shard")
    floor = math.log10(sums["tokens"] + 0.5 * (sums["types"] + 1))
    id_kind = rows.schema["id"].dataType

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["block"]):
            shard, raw = np.asarray(g["shard"]), g["answer"].to_pylist()
            train, lengths = g["train"][0].as_py(), g["lengths"][0].as_py()
            block = Block.of(g["codes"][0].as_py(), g["words"][0].as_py(), lengths, train)
            got = [np.concatenate([np.zeros(0, np.uint64), *(unpacked(raw[k], "<u8") for k in np.flatnonzero((shard >= 0) & (shard // shards == kind)))]).astype(np.float64) for kind in range(kinds)]
            # bytes were asked for together, in the order of their mixed keys
            spelled = block.letter_levels(letters, np.zeros(len(block.words)))
            keys = mixed(np.concatenate([x.keys for x in spelled[2]]))
            answer = np.empty(len(keys))
            answer[np.argsort(keys)] = got[-1]
            spelling = np.split(answer, np.cumsum([len(x.keys) for x in spelled[2]])[:-1])
            known, low, high = text_scores(block, block.word_levels(order, bits), got[:-1], spelled, spelling, sums)
            n = np.asarray(lengths, np.int64) + 1
            ids = g["ids"].combine_chunks()
            ids = ids.flatten()
            for a in range(0, len(n), 10_000):
                z = slice(a, a + 10_000)
                m = len(n[z])
                yield pa.RecordBatch.from_arrays([ids.slice(a, m), pa.array(train[z], pa.bool_()), pa.array(n[z]), pa.array(known[z].astype(np.int64)), pa.array(np.full(m, sums["tokens"], np.int64)), pa.array(low[z] - n[z] * floor), pa.array(high[z])], ["id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = T.StructType([T.StructField("id", id_kind), *T._parse_datatype_string("train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])
    return both.mapInArrow(lean(score), schema).withColumnRenamed("id", id_col)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    found = scored(documents, train)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

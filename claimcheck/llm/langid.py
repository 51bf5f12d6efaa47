"""Language identification by error-correcting output codes.

Each language is a codeword of +1 / -1 bits; one linear classifier over letter n-grams predicts
each bit. Decoding adds up, over the bits, the logistic loss of the margin under each codeword
and takes the codeword with the least; a document is ambiguous where the second codeword is
hardly worse. Text is case-folded, letters are mapped to a fixed alphabet of 64 symbols, any run
of other characters is one boundary symbol, and n-grams of 1 to 3 symbols are counted over the
whole text.

The classifiers are fitted on the driver from a bounded sample of labelled rows
(``sample_rows``), a quota of each label, chosen by a hash of the id; counting n-grams of the sample and predicting run
on the executors, over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, small_batches, steps, strings

SYMBOLS = 64
#: Features: single symbols, pairs, and triples hashed to this many cells.
TRIPLES = 1 << 13
SIZE = SYMBOLS + SYMBOLS**2 + TRIPLES
UNKNOWN = "und"
SAMPLE_ROWS = 2000
#: Rows of each label at least, however many labels there are.
LABEL_ROWS = 20
SALTS = 8
STEP = 1 << 20


def _alphabet() -> np.ndarray:
    """Code point to symbol, for the Basic Multilingual Plane: 0 for what isn't a letter, a-z are 1 to 26, others 27 to 63."""
    out = np.zeros(0x10000, np.uint8)
    for c in range(0x10000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()[0]
            out[c] = ord(low) - 96 if "a" <= low <= "z" else 27 + (ord(low) * 2654435761 >> 7) % (SYMBOLS - 27)
    return out


class Features:
    _table: np.ndarray | None = None

    @classmethod
    def table(cls) -> np.ndarray:
        if cls._table is None:
            cls._table = _alphabet()
        return cls._table


def n_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of n-gram weights (rows of unit length, zero without letters) and which rows have letters."""
    table = Features.table()
    out = np.zeros((len(texts), SIZE), np.float32)
    has = np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        s = table[np.where(c < 0x10000, c, 0)]
        if (c >= 0x10000).any():
            high = np.flatnonzero(c >= 0x10000)
            s[high] = [27 + (int(c[k]) * 2654435761 >> 7) % (SYMBOLS - 27) if chr(c[k]).isalpha() else 0 for k in high]
        if not s.any():
            continue
        has[i] = True
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] > 0) | (s[:-1] > 0)
        s = np.concatenate([[0], s[keep], [0]]).astype(np.int64)
        pair = s[:-1] * SYMBOLS + s[1:]
        triple = (pair[:-1] * SYMBOLS + s[2:]) * 40503 >> 4 & TRIPLES - 1
        for at, codes, size in ((0, s, SYMBOLS), (SYMBOLS, pair, SYMBOLS**2), (SYMBOLS + SYMBOLS**2, triple, TRIPLES)):
            row = np.sqrt(np.bincount(codes, minlength=size).astype(np.float32))
            if at == 0:
                row[0] = 0
            out[i, at : at + size] = row / max(np.sqrt((row * row).sum()), 1e-9)
    return out, has


def codewords(n: int, bits: int | None = None, seed: int = 7) -> np.ndarray:
    """n rows of +1 / -1 with no two equal or complementary columns where avoidable, rows far apart.

    Up to 7 languages get the exhaustive code (2^(n-1) - 1 bits); more get the best of 200 random codes.
    """
    if n == 1:
        return np.ones((1, 1))
    if n <= 7:
        columns = [[1] + [1 if k >> j & 1 else -1 for j in range(n - 1)] for k in range(2 ** (n - 1) - 1)]
        return np.array(columns, np.float64).T
    bits = bits or int(15 * np.ceil(np.log2(n)))
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        distance = ((bits - code @ code.T) / 2 + np.eye(n) * bits).min()
        if distance > far:
            best, far = code, distance
    return best


class Model:
    """languages, codewords, weights by bit; decoding."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> None:
        self.languages, self.code, self.weights, self.bias = languages, code, weights, bias

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best, share of the best, lead over the second)."""
        margins = x @ self.weights + self.bias
        loss = np.stack([np.logaddexp(0, -margins * c).sum(1) for c in self.code], 1)
        share = np.exp(-(loss - loss.min(1, keepdims=True)) * (2 / max(1, self.code.shape[1])))
        share /= share.sum(1, keepdims=True)
        order = np.sort(share, 1)
        return loss.argmin(1), order[:, -1], order[:, -1] - (order[:, -2] if share.shape[1] > 1 else 0)


def fit(x: np.ndarray, y: list[str], *, steps_: int = 150, decay: float = 1e-5) -> Model:
    """One logistic classifier per bit, by full-batch gradient steps with momentum; languages weigh alike."""
    languages = sorted(set(y))
    index = {k: i for i, k in enumerate(languages)}
    code = codewords(max(1, len(languages)))
    if not languages:
        return Model([UNKNOWN], np.ones((1, 1)), np.zeros((SIZE, 1), np.float32), np.zeros(1, np.float32))
    who = np.array([index[k] for k in y])
    target = code[who].astype(np.float32)
    weight = (1 / np.bincount(who, minlength=len(languages)))[who].astype(np.float32)
    weight /= weight.sum()
    w, b = np.zeros((SIZE, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps_):
        g = -target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30))) * weight[:, None]
        vw = 0.9 * vw - 4.0 * (x.T @ g + decay * w)
        vb = 0.9 * vb - 4.0 * g.sum(0)
        w, b = w + vw, b + vb
    return Model(languages, code, w, b)


def train(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a documented quota of rows with a label and a text: of each label those with the smallest hashes of the id.

    Every label gets ``sample_rows`` over the number of labels, ``LABEL_ROWS`` at least, so every
    label present is learned; labels with fewer rows give all of theirs.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("h"), F.col(id_col).cast("string").alias("k"))
    labels = rows.agg(F.count_distinct("lang")).first()[0]
    if not labels:
        return fit(np.zeros((0, SIZE), np.float32), [])
    quota = max(LABEL_ROWS, sample_rows // labels)
    # ranked by label without the texts, a label first in SALTS parts, for one may hold most rows
    order = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("h", F.coalesce("k", F.lit(""))))
    some = rows.select("lang", "h", "k", F.pmod("h", F.lit(SALTS)).alias("s")).withColumn("r", order("lang", "s")).where(F.col("r") <= quota)
    last = some.withColumn("r", order("lang")).where(F.col("r") <= quota).groupBy("lang").agg(F.max(F.struct("h", F.coalesce("k", F.lit("")).alias("k"))).alias("last"))
    at = F.struct(F.col("h"), F.coalesce("k", F.lit("")).alias("k"))
    chosen = rows.join(F.broadcast(last), "lang").where(at <= F.col("last"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text", STEP):
            x, has = n_grams(b.column("text").to_pylist())
            raw = [np.concatenate([np.flatnonzero(r).astype(np.float32), r[np.flatnonzero(r)]]).tobytes() for r in x[has]]
            yield pa.RecordBatch.from_arrays([b.column("lang").filter(pa.array(has)), pa.array(raw, pa.binary())], ["lang", "x"])

    got = chosen.select("lang", "text").mapInArrow(lean(features), "lang string, x binary").limit(2 * quota * labels).toArrow()
    x = np.zeros((got.num_rows, SIZE), np.float32)
    for i, raw in enumerate(got["x"].to_pylist()):
        v = np.frombuffer(raw, np.float32)
        x[i, v[: len(v) // 2].astype(np.int64)] = v[len(v) // 2 :]
    return fit(x, got["lang"].to_pylist())


def predicted(documents: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None, into: str = "language", lead: float = 0.1) -> DataFrame:
    """The columns (or those in ``keep``) and a struct ``into``: lang, score (0 to 1), ambiguous.

    ``und`` with score 0 where the text is null, empty or has no letter; ambiguous where the
    best codeword leads the second by less than ``lead``. A column already named ``into`` is replaced.
    """
    small_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    names = [c for c in (documents.columns if keep is None else keep) if c != into]
    read = list(dict.fromkeys([*names, text_col]))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in steps(batches, text_col, STEP):
            texts = strings(b.column(text_col)).to_pylist()
            lang, score, close = [], [], []
            for a in range(0, len(texts), 256):
                x, has = n_grams(texts[a : a + 256])
                best, share, ahead = model.decode(x)
                lang += [model.languages[k] if h else UNKNOWN for k, h in zip(best, has)]
                score += np.where(has, share, 0.0).tolist()
                close += (has & (ahead < lead)).tolist()
            found = pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], ["lang", "score", "ambiguous"])
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), found], [*names, into])

    schema = T.StructType([*(documents.schema[c] for c in names), T.StructField(into, T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]))])
    return documents.select(read).mapInArrow(lean(predict), schema)


def fold(column: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(documents.where(fold("doc_id", 4) != 2))
    found = predicted(documents.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.ambiguous").alias("ambiguous"))

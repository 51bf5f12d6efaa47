"""Numbers and spans in report texts, one report or a table of them.

A figure is found in steps. A text is cut into chunks: runs of word characters, dots and commas. A
figure stands at the beginning of a chunk that begins with a digit, so a chunk holds one at most:
its number and scale are read from the chunk, its currency from what stands before the chunk, a
percent sign from what follows. Tables of texts go through the same steps as native expressions.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Currency prefixes, scale suffixes, the span of bare years, words that follow a difference.
PREFIXES = ("US$", "R$", "$", "€", "£", "₹")
SCALES = {"K": 1e3, "M": 1e6, "mn": 1e6, "B": 1e9, "bn": 1e9, "%": 1.0}
FIRST_YEAR, LAST_YEAR = 1900, 2099
COMPARATIVES = "more less higher lower faster slower fewer greater smaller longer shorter better worse".split()

# The same classes in Python, Java and RE2: letters and digits of any script, and the underscore.
LETTERS = r"\p{L}\p{N}_"
#: The number of a chunk and its scale, up to the chunk's end or a dot or comma.
BODY = r"^([0-9]{1,3}(?:,[0-9]{2,3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?)(bn|mn|[KMB])?(?:[.,]|$)"
_CURRENCY = "|".join(re.escape(p) for p in PREFIXES)


class Token(NamedTuple):
    text: str
    start: int
    end: int
    context: str
    value: float


def close(a: float, b: float) -> bool:
    return abs(a - b) <= 1e-9 * max(abs(a), abs(b))


_CHUNK, _BODY = re.compile(r"[\w.,]+"), re.compile(BODY)
_BEFORE = re.compile(rf"(?:^|[^\w.,])({_CURRENCY})\Z")
_WORD = re.compile(r"\s+([A-Za-z]+)")


def _figure(text: str, begin: int, stop: int) -> Token | None:
    """The figure at the beginning of the chunk text[begin:stop]."""
    body = _BODY.match(text[begin:stop])
    if body is None:
        return None
    number, scale = body[1], body[2] or ""
    end = begin + len(number) + len(scale)
    if end == stop and not scale and text[end : end + 1] == "%" and not re.match(r"\w", text[end + 1 : end + 2]):
        scale, end = "%", end + 1
    before = _BEFORE.search(text[max(0, begin - 4) : begin])  # longer than any currency
    currency = before[1] if before else ""
    if not currency and not scale and len(number) == 4 and number.isdigit() and FIRST_YEAR <= int(number) <= LAST_YEAR:
        return None
    start = begin - len(currency)
    after = _WORD.match(text, end)
    said = text[start:end]
    return Token(said, start, end, f"{said} {after[1]}" if after else said, float(number.replace(",", "")) * SCALES.get(scale, 1.0))


def tokens(text: str | None) -> list[Token]:
    """Figures with their offsets in code points; bare years are none."""
    chunks = (m.span() for m in _CHUNK.finditer(text or "") if "0" <= m[0][0] <= "9")
    return [t for a, z in chunks if (t := _figure(text, a, z)) is not None]


def occurrences(text: str, span: str) -> list[tuple[int, int]]:
    """All places of a span, overlapping ones too; an empty span has none."""
    return [(m.start(), m.start() + len(span)) for m in re.finditer(f"(?={re.escape(span)})", text)] if span else []


def uncovered(text: str, claimed: list[tuple[str, tuple[float, ...]]]) -> list[Token]:
    """Figures that no claim accounts for: inside no occurrence of a span that states that value."""
    left = tokens(text)
    for span, values in claimed:
        places = occurrences(text, span) if values else []
        accounted = {t for t in left for s, e in places if s <= t.start and t.end <= e and any(close(t.value, v) for v in values)}
        left = [t for t in left if t not in accounted]
    return left


#: How a span says that a figure is a change: what stands right before it, what right after it.
CHANGES = {
    "growth": (None, re.compile(r"\s*(?:%|percent\b|pct\b|percentage points?\b)", re.I)),
    "comparison": (re.compile(r"\bby\s+(?:\w+\s+)?$", re.I), re.compile(rf"(?:\s+[\w%]+){{0,2}}\s+(?:{'|'.join(COMPARATIVES)})\b", re.I)),
}


def written_as_difference(kind: str, span: str, value: float) -> bool:
    """Whether the first figure of the span that equals the value reads as a change."""
    found = [t for t in tokens(span) if close(t.value, value)][:1]
    before, after = CHANGES.get(kind, (None, None))
    for t in found:
        unit = t.end - t.text.endswith("%")  # a percent sign is read as what follows
        if kind == "growth":
            return after.match(span, unit) is not None
        return bool(before and before.search(span[: t.start]) or after and after.match(span, t.end))
    return False


# --- tables of texts ---------------------------------------------------------------------------


def _scale(suffix: Column) -> Column:
    out = F.lit(1.0)
    for name, by in SCALES.items():
        out = F.when(suffix == name, F.lit(by)).otherwise(out)
    return out


def sweep(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col`` and one row per figure: text, start, end, context, value; offsets in code points.

    Texts are cut at the chunks that begin with a digit; what lies between them is kept only as
    its length, its last and its first characters, so places are running sums of short rows.
    """
    chunk = rf"(?<![{LETTERS}.,])[0-9][{LETTERS}.,]*"
    row = documents.where(F.col(text_col).rlike("[0-9]")).select(F.monotonically_increasing_id().alias("_row"), F.col(id_col), F.col(text_col).alias("_text"))
    row = row.select("_row", id_col, F.split("_text", chunk).alias("_gaps"), F.regexp_extract_all("_text", F.lit(chunk), F.lit(0)).alias("_chunks"))
    each = F.transform(
        "_chunks",
        lambda c, k: F.struct(
            k.alias("k"),
            c.alias("chunk"),
            F.length(F.get("_gaps", k)).alias("gap"),
            # a gap between two chunks follows one's last character and precedes the other's first
            F.concat(F.when(k > 0, F.lit("0")).otherwise(F.lit("")), F.substring(F.get("_gaps", k), -5, 5)).alias("before"),
            F.concat(F.get("_gaps", k + 1), F.when(k < F.size("_chunks") - 1, F.lit("0")).otherwise(F.lit(""))).alias("after"),
        ),
    )
    cut = row.select("_row", id_col, F.inline(each))
    order = Window.partitionBy("_row").orderBy("k")
    begin = (F.sum(F.col("gap") + F.length("chunk")).over(order) - F.length("chunk")).cast("int")
    found = cut.withColumn("begin", begin).where(F.col("chunk").rlike(BODY))
    found = found.withColumn("number", F.regexp_extract("chunk", BODY, 1)).withColumn("scale", F.regexp_extract("chunk", BODY, 2))
    percent = (F.col("scale") == "") & (F.length("number") == F.length("chunk")) & F.col("after").rlike(f"^%([^{LETTERS}]|$)")
    found = found.withColumn("suffix", F.when(percent, "%").otherwise(F.col("scale"))).withColumn("currency", F.regexp_extract("before", rf"(?:^|[^{LETTERS}.,])({_CURRENCY})\z", 1))
    said = F.concat("currency", "number", "suffix")
    year = (F.col("currency") == "") & (F.col("suffix") == "") & F.col("number").rlike("^[0-9]{4}$") & F.col("number").cast("int").between(FIRST_YEAR, LAST_YEAR)
    rest = F.when(F.length("number") + F.length("scale") == F.length("chunk"), F.substr("after", F.when(percent, 2).otherwise(1))).otherwise(F.lit("."))
    word = F.regexp_extract(rest, r"^[\s\p{Z}]+([A-Za-z]+)", 1)
    end = F.col("begin") + F.length("number") + F.length("suffix")
    return found.where(~year).select(
        id_col,
        said.alias("text"),
        (F.col("begin") - F.length("currency")).cast("int").alias("start"),
        end.cast("int").alias("end"),
        F.when(word != "", F.concat(said, F.lit(" "), word)).otherwise(said).alias("context"),
        (F.replace("number", F.lit(","), F.lit("")).cast("double") * _scale(F.col("suffix"))).alias("value"),
    )


def uncovered_tokens(found: DataFrame, covers: DataFrame, id_col: str) -> DataFrame:
    """Anti join of swept figures with covering spans (id, s, e, v): those inside a span of their value are accounted for."""
    c = covers.select(F.col(id_col).alias("_id"), "s", "e", "v")
    same = F.abs(F.col("value") - F.col("v")) <= F.lit(1e-9) * F.greatest(F.abs("value"), F.abs("v"))
    return found.join(c, (F.col(id_col) == F.col("_id")) & (F.col("s") <= F.col("start")) & (F.col("end") <= F.col("e")) & same, "left_anti")


def duplicates_rejected(claims: DataFrame, doc: str = "doc_id", span: str = "span", key: str = "id") -> DataFrame:
    """Rejects repeated spans, then repeated ids among the rest; both copies go. Adds ``rejected`` (null: kept)."""
    marked = claims.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(doc, span))).withColumn("_s", F.col("_n") > 1)
    again = F.count(F.when(~F.col("_s"), F.lit(1))).over(Window.partitionBy(doc, key)) > 1
    return marked.withColumn("rejected", F.when(F.col("_s"), "duplicate_span").when(again, "duplicate_id")).drop("_n", "_s")


#: Code points of a bucket of places; spans meet only in buckets that both touch.
BUCKET = 128


def overlaps(a: DataFrame, b: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Pairs of spans (a_id, a_s, a_e) and (b_id, b_s, b_e) of one document that overlap, with the shared length.

    Spans are dealt into the buckets they touch, and a pair is told in the first bucket that both
    touch, so the work is linear in the spans where they are short, however long the document.
    """

    def dealt(spans: DataFrame, p: str) -> DataFrame:
        first, last = F.floor(F.col(f"{p}_s") / BUCKET), F.floor(F.greatest(F.col(f"{p}_e") - 1, f"{p}_s") / BUCKET)
        return spans.withColumn(f"_{p}", first).withColumn("_bucket", F.explode(F.sequence(first, last)))

    pairs = dealt(a, "a").join(dealt(b, "b"), [id_col, "_bucket"]).where((F.col("_bucket") == F.greatest("_a", "_b")) & (F.col("a_s") < F.col("b_e")) & (F.col("b_s") < F.col("a_e")))
    return pairs.drop("_bucket", "_a", "_b").withColumn("shared", F.least("a_e", "b_e") - F.greatest("a_s", "b_s"))


def matched(pairs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Greedy one-to-one matching within each document: largest overlap first, ties by a_id, then b_id."""

    def greedy(d: pd.DataFrame) -> pd.DataFrame:
        left, right, kept = set(), set(), []
        for r in d.sort_values(["shared", "a_id", "b_id"], ascending=[False, True, True]).itertuples():
            if r.a_id not in left and r.b_id not in right:
                left.add(r.a_id)
                right.add(r.b_id)
                kept.append(r.Index)
        return d.loc[kept]

    return pairs.groupBy(id_col).applyInPandas(greedy, pairs.schema)

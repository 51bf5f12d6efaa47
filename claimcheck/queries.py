"""Queries over the driver's tables and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import measures as M
from .model import AggregatePlan, ChangePlan, Config, Entity, Measure, Metric, Period, RankPlan, SharePlan, Slice
from . import cases
from .operators import batch, rewrite, summary, text
from .operators import verification as V
from .plans import lowering
from .sources.dataset import attach

T = "o_orderdate"
Y95, Y96, Y97, Y90 = (Period(date(y, 1, 1), date(y + 1, 1, 1)) for y in (1995, 1996, 1997, 1990))
ALL = Period(date(1900, 1, 1), date(2100, 1, 1))
Q1, Q2 = Period(date(1997, 1, 1), date(1997, 4, 1)), Period(date(1997, 4, 1), date(1997, 7, 1))
LATE = Period(date(1996, 7, 1), date(1997, 7, 1))
REVENUE, ORDERS, AVERAGE = Measure("sum", "o_totalprice", 2), Measure("count"), Measure("avg", "o_totalprice", 4)

CONFIG = Config(
    time_column=T,
    entities={"priority": Entity(column="o_orderpriority", aliases={"urgent": "1-URGENT", "high": "2-HIGH"}), "status": Entity(column="o_orderstatus", aliases={"final": "F"})},
    metrics={
        "revenue": Metric(agg="sum", column="o_totalprice", aliases=["sales"], round=2, polarity="higher_is_better"),
        "orders": Metric(agg="count", aliases=["number of orders"]),
        "avg_order_value": Metric(agg="avg", column="o_totalprice", aliases=["average order value"], round=4),
        "order_share": Metric(agg="share", aliases=["share of orders"]),
    },
)


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet")


def _holes(spark: SparkSession, d: str) -> DataFrame:
    """Orders with nulls made in a measure and in a dimension."""
    o = _orders(spark, d)
    return o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))).withColumn("o_orderpriority", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")))


HOLES = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice, nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders)"
_R = {None: "{}", 2: "round({}, 2)", 4: "round({}, 4)"}


def _sql_value(m: Measure, where: str | None = None) -> str:
    x = "count(*)" if m.column is None else f"{m.agg}({m.column})"
    return _R[m.round].format(x + (f" FILTER (WHERE {where})" if where else ""))


def _sql_where(s: Slice) -> str:
    out = f"{T} >= DATE '{s.period.start}' AND {T} < DATE '{s.period.end}'"
    return out if s.column is None else f"{out} AND {s.column} = '{s.value}'"


def _sql_aggregate(p: AggregatePlan, table: str = "orders") -> str:
    used = "count(*)" if p.measure.column is None else f"count({p.measure.column})"
    return f"SELECT CAST({_sql_value(p.measure)} AS DOUBLE) AS value, count(*) AS n_rows, {used} AS n_used FROM {table} WHERE {_sql_where(p.rows)}"


def _sql_change(p: ChangePlan, table: str = "orders") -> str:
    side = lambda s, n: f"(SELECT CAST({_sql_value(p.measure)} AS DOUBLE) AS {n}, count(*) AS n_{n} FROM {table} WHERE {_sql_where(s)})"
    value = "100.0 * (current - baseline) / nullif(baseline, 0)" if p.kind == "growth" else "current - baseline"
    return f"SELECT current, baseline, {value} AS value, n_current, n_baseline FROM {side(p.current, 'current')}, {side(p.baseline, 'baseline')}"


def _sql_rank(p: RankPlan, table: str = "orders") -> str:
    key = f"CAST(CAST(date_trunc('{p.grain}', {T}) AS DATE) AS VARCHAR)" if p.grain else f"CAST({p.column} AS VARCHAR)"
    order = f"value {'DESC' if p.descending else 'ASC'} NULLS LAST"
    over = f"rank() OVER (ORDER BY {order})" if p.min_rows is None else f"CASE WHEN n_rows >= {p.min_rows} THEN rank() OVER (PARTITION BY n_rows >= {p.min_rows} ORDER BY {order}) END"
    return f"SELECT key, value, n_rows, {over} AS rank FROM (SELECT {key} AS key, CAST({_sql_value(p.measure)} AS DOUBLE) AS value, count(*) AS n_rows FROM {table} WHERE {_sql_where(Slice(p.period))} GROUP BY 1) WHERE key IS NOT NULL"


def _sql_share(p: SharePlan, table: str = "orders") -> str:
    mine = f"{p.rows.column} = '{p.rows.value}'"
    return (
        f"SELECT part, whole, 100.0 * part / nullif(whole, 0) AS value, n_part, n_rows FROM (SELECT CAST({_sql_value(p.measure, mine)} AS DOUBLE) AS part, CAST({_sql_value(p.measure)} AS DOUBLE) AS whole,"
        f" count(*) FILTER (WHERE {mine}) AS n_part, count(*) AS n_rows FROM {table} WHERE {_sql_where(Slice(p.rows.period))})"
    )


_RUN = {AggregatePlan: (V.aggregate, _sql_aggregate), ChangePlan: (V.change, _sql_change), RankPlan: (V.rank, _sql_rank), SharePlan: (V.share, _sql_share)}
PRIORITY, STATUS = "o_orderpriority", "o_orderstatus"


def _by(measure: Measure, period: Period = Y97, column: str = PRIORITY, desc: bool = True, grain: str | None = None, min_rows: int | None = None) -> RankPlan:
    return RankPlan(measure, period, T if grain else column, grain, desc, "", min_rows)


#: Plans over orders.
PLANS = {
    "agg_sum_period": AggregatePlan(REVENUE, Slice(Y97)),
    "agg_count_period": AggregatePlan(ORDERS, Slice(Y97)),
    "agg_avg_period": AggregatePlan(AVERAGE, Slice(Y97)),
    "agg_entity_filter": AggregatePlan(REVENUE, Slice(Y97, STATUS, "F")),
    "agg_empty_slice": AggregatePlan(REVENUE, Slice(Y90)),
    "growth_yoy": ChangePlan("growth", REVENUE, Slice(Y97), Slice(Y96)),
    "growth_qoq": ChangePlan("growth", REVENUE, Slice(Q2), Slice(Q1)),
    "growth_entity": ChangePlan("growth", REVENUE, Slice(Y97, PRIORITY, "1-URGENT"), Slice(Y96, PRIORITY, "1-URGENT")),
    "growth_overlap_period": ChangePlan("growth", REVENUE, Slice(Y97), Slice(LATE)),
    "growth_zero_baseline": ChangePlan("growth", ORDERS, Slice(Y97), Slice(Y90)),
    "compare_diff": ChangePlan("compare", ORDERS, Slice(Y97), Slice(Y96)),
    "compare_avg": ChangePlan("compare", AVERAGE, Slice(Y97), Slice(Y96)),
    "compare_entity": ChangePlan("compare", ORDERS, Slice(Y97, STATUS, "F"), Slice(Y96, STATUS, "F")),
    "rank_entity_desc": _by(REVENUE),
    "rank_entity_asc": _by(AVERAGE, desc=False),
    "rank_month": _by(REVENUE, grain="month"),
    "rank_quarter": _by(ORDERS, grain="quarter"),
    "rank_min_rows": _by(AVERAGE, ALL, min_rows=3000),
    "share_count": SharePlan(ORDERS, Slice(Y97, PRIORITY, "1-URGENT")),
    "share_sum": SharePlan(REVENUE, Slice(Y97, STATUS, "F")),
    "share_absent_entity": SharePlan(REVENUE, Slice(Y97, STATUS, "nowhere")),
    "share_absent_entity_count": SharePlan(ORDERS, Slice(Y97, STATUS, "nowhere")),
}
#: Plans over orders with nulls.
HOLED = {
    "agg_count_column_with_nulls": AggregatePlan(Measure("count", "o_totalprice"), Slice(Y97)),
    "agg_avg_null_denominator": AggregatePlan(AVERAGE, Slice(Y97)),
    "rank_null_key_dropped": _by(ORDERS),
}


def _plan(plan, table: Callable) -> Callable:
    return lambda spark, d: _RUN[type(plan)][0](table(spark, d), T, plan)


def _rounded(agg: str) -> Callable:
    def run(spark: SparkSession, d: str) -> DataFrame:
        li = spark.read.parquet(f"{d}/lineitem.parquet")
        k = V.kinds(li)
        return li.groupBy("l_returnflag", "l_linestatus").agg(M.value(Measure(agg, "l_extendedprice", 2), k).alias("price"), M.value(Measure(agg, "l_discount", 2), k).alias("discount"), M.rows().alias("n_rows"))

    return run


def rank_ties(spark: SparkSession, d: str) -> DataFrame:
    """Customers' months by how many orders they had, in buckets, so that many tie."""
    o = _orders(spark, d).withColumn("bucket", (F.col("o_custkey") % 40).cast("string"))
    return V.rank(o, T, _by(ORDERS, ALL, "bucket"))


def rank_null_value_last(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d).withColumn("o_totalprice", F.when(F.col(PRIORITY) != "2-HIGH", F.col("o_totalprice")))
    return V.rank(o, T, _by(REVENUE, desc=False))


def rank_min_rows_inclusive(spark: SparkSession, d: str) -> DataFrame:
    """The threshold is met exactly by one group: its size is bound to the data."""
    o = _orders(spark, d)
    sizes = o.where(M.in_period(T, Y97)).groupBy(PRIORITY).count().agg(F.sort_array(F.collect_list("count"))[2].alias("n"))
    groups = V.rank(o, T, _by(REVENUE)).drop("rank").join(sizes)
    from pyspark.sql import Window

    enough = F.col("n_rows") >= F.col("n")
    return groups.withColumn("enough", enough).withColumn("rank", F.when(F.col("enough"), F.rank().over(Window.partitionBy("enough").orderBy(F.desc("value"))).cast("long"))).select("key", "value", "n_rows", "rank")


def summary_national(spark: SparkSession, d: str) -> DataFrame:
    return summary.national(_orders(spark, d), CONFIG)


def summary_by_quarter_qoq(spark: SparkSession, d: str) -> DataFrame:
    out = summary.by_quarter(_orders(spark, d), CONFIG)
    return out.select("period", "revenue", "orders", *(M.rounded(F.col(c), 6).alias(c) for c in ("revenue_change", "orders_change")))


def summary_by_entity_share_rank(spark: SparkSession, d: str) -> DataFrame:
    return summary.by_entity(_orders(spark, d), CONFIG, "priority").select("key", "revenue", "orders", "n_rows", M.rounded(F.col("row_share"), 6).alias("row_share"), "revenue_rank", "orders_rank")


def inject_cell_invariance(spark: SparkSession, d: str) -> DataFrame:
    """A cell of a column that no metric reads is rewritten; the result stays."""
    o = rewrite.with_cell(_orders(spark, d), "o_orderkey", 7, "o_custkey", -1)
    return V.aggregate(o, T, PLANS["agg_sum_period"])


def row_pick_limit_offset(spark: SparkSession, d: str) -> DataFrame:
    return rewrite.pick(_orders(spark, d), "o_orderkey", 11, column=PRIORITY, named=["1-URGENT", "2-HIGH"], low=100, high=9000).select("o_orderkey", "o_orderpriority", "o_totalprice")


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy("event_type").agg(F.percentile("value", F.array(F.lit(0.5), F.lit(0.95))).alias("p"), F.count(F.lit(1)).alias("n")).select("event_type", "n", M.rounded(F.col("p")[0], 6).alias("p50"), M.rounded(F.col("p")[1], 6).alias("p95"))


def star_join_etl(spark: SparkSession, d: str) -> DataFrame:
    """One row per order: customer's segment and nation, lines, revenue and days to the last shipment."""
    o, c, n, li = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "customer", "nation", "lineitem"))
    lines = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), M.rounded(F.sum("l_extendedprice"), 2).alias("revenue"), F.max("l_shipdate").alias("shipped"))
    return (
        o.join(c, o["o_custkey"] == c["c_custkey"])
        .join(n, c["c_nationkey"] == n["n_nationkey"])
        .join(lines, o["o_orderkey"] == lines["l_orderkey"])
        .select("o_orderkey", "c_mktsegment", "n_name", "n_lines", "revenue", F.datediff("shipped", T).cast("long").alias("days"))
    )


def _batch_slices() -> list[tuple[Measure, Slice]]:
    months = [Period(date(1997, m, 1), date(1997 + m // 12, m % 12 + 1, 1)) for m in range(1, 13)]
    return [(m, Slice(p, *e)) for p in [*months, Q1, Y97] for m in (REVENUE, ORDERS) for e in ((), (STATUS, "F"), (PRIORITY, "2-HIGH"))]


def shared_scan_batch(spark: SparkSession, d: str) -> DataFrame:
    """84 slices in one scan and one job, as one row per slice."""
    wanted = _batch_slices()
    values = {STATUS: ["F"], PRIORITY: ["2-HIGH"]}
    groups, columns = lowering.grouped_frame(attach(_orders(spark, d), CONFIG, max_rows=None), T, wanted, values, exact=True)
    k = columns.index("o_totalprice")
    asked = spark.createDataFrame([(i, m.agg, s.period.start, s.period.end, None if s.column is None else list(values).index(s.column)) for i, (m, s) in enumerate(wanted)], "slice long, agg string, start date, end date, dim int")
    # the slices asked for meet the groups, both bounded by the question
    mine = F.when(F.col("dim").isNull(), True).when(F.col("dim") == 0, F.col("d0") == 0).otherwise(F.col("d1") == 0)
    met = F.broadcast(asked).join(groups, (F.col("day") >= F.col("start")) & (F.col("day") < F.col("end")) & F.coalesce(mine, F.lit(False)), "left")
    total, n = F.sum(f"s{k}").cast("double"), F.coalesce(F.sum("n"), F.lit(0))
    return met.groupBy("slice", "agg").agg(total.alias("total"), n.alias("n_rows")).select("slice", F.when(F.col("agg") == "count", F.col("n_rows").cast("double")).otherwise(M.rounded(F.col("total"), 2)).alias("value"), "n_rows")


def _sql_shared_scan() -> str:
    return " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS slice, CAST({_sql_value(m)} AS DOUBLE) AS value, count(*) AS n_rows FROM orders WHERE {_sql_where(s)}" for k, (m, s) in enumerate(_batch_slices()))


def batch_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Generated point claims for each month and status: stated exactly, rounded, or wrong by a tenth."""
    o = _orders(spark, d).groupBy(F.date_trunc("month", T).cast("date").alias("month"), STATUS).agg(M.rounded(F.sum("o_totalprice"), 2).alias("computed"))
    k = F.pmod(F.month("month") + F.ascii(STATUS), F.lit(4))
    claims = o.select(
        F.concat_ws("/", F.col("month").cast("string"), STATUS).alias("claim_id"),
        F.when(k == 3, "growth").otherwise("point_value").alias("kind"),
        F.when(k == 0, F.col("computed")).when(k == 1, M.rounded(F.col("computed"), 0)).when(k == 2, F.col("computed") + 0.1).otherwise(F.col("computed")).alias("stated"),
        F.when(k == 1, 0).otherwise(2).alias("decimals"),
        F.when(k == 3, F.when(F.month("month") > 6, "increase").otherwise("decrease")).alias("direction"),
        F.lit(None).cast("string").alias("polarity"),
        "computed",
    )
    return batch.verdicts(claims).select("claim_id", "verdict", "policy")


def claim_dup_spans(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as claims: repeated spans and ids of a document are rejected, both copies."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    claims = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "span")).withColumn("id", (F.col("pos") % 50).cast("string"))
    out = text.duplicates_rejected(claims)
    return out.groupBy("doc_id").agg(F.count_if(F.col("rejected") == "duplicate_span").alias("n_span"), F.count_if(F.col("rejected") == "duplicate_id").alias("n_id"), F.count_if(F.col("rejected").isNull()).alias("n_kept"))


def span_overlap_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Spans of 40 characters at steps of 30 against spans of 25 at steps of 35, in each document's length."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.length("text").alias("n"))
    spans = lambda p, step, size: docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n"), F.lit(step))).alias(f"{p}_s")).withColumn(f"{p}_e", F.col(f"{p}_s") + size).withColumn(f"{p}_id", F.col(f"{p}_s"))
    out = text.overlaps(spans("a", 30, 40), spans("b", 35, 25))
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum("shared").cast("long").alias("shared"))


def numeric_tokens(spark: SparkSession, d: str) -> DataFrame:
    return text.sweep(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "doc_id", "text")


def claim_rejections(spark: SparkSession, d: str) -> DataFrame:
    """Orders as wire claims, with fields missing, foreign, out of range: why each is rejected."""
    from .model import wire_fields
    from .operators.claim_checks import rejections

    k = F.col("o_orderkey")
    pick = lambda by, *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (by % len(xs) + 1).cast("int"))
    kind = pick(k, "point_value", "growth", "comparison", "ranking", "share", "guess", None)
    set_ = {
        "id": F.when(k % 11 == 3, "").otherwise(k.cast("string")),
        "span": F.when(k % 13 == 5, F.lit(None)).otherwise(F.concat(F.lit("order "), k.cast("string"))),
        "confidence": pick(F.floor(k / 3), "high", "low", "high", "medium", None),
        "metric": F.when(k % 17 == 0, F.lit(None)).otherwise("revenue"),
        "period": F.when(k % 2 == 0, "1997"),
        "subject": F.when(k % 3 == 0, F.lit("urgent")),
        "value": F.when(kind.isin("point_value", "growth", "comparison", "share") & (k % 5 > 0), F.when(k % 5 == 1, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))),
        "direction": F.when(kind.isin("growth", "comparison") | (k % 19 == 0), pick(F.floor(k / 2), "increase", "higher", "decrease", "worse", None)),
        "rank": F.when(kind == "ranking", (k % 4).cast("int")),
        "rank_from": F.when(kind == "ranking", pick(F.floor(k / 7), "highest", "top", None)),
        "group_by": F.when(kind == "ranking", pick(F.floor(k / 5), "priority", "quarter", None)),
    }
    claims = _orders(spark, d).select(k, kind.alias("type"), *(set_.get(f, F.lit(None)).cast(t).alias(f) for f, t in wire_fields().items() if f != "type"))
    return rejections(claims).select("o_orderkey", "rejected")


def compile_rows(spark: SparkSession, d: str) -> DataFrame:
    return cases.compile_rows(spark, CONFIG)


def policy_rows(spark: SparkSession, d: str) -> DataFrame:
    return cases.policy_rows(spark, CONFIG)


def verdict_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """The flagship's claims by id: verdict, policy, computed value, reason."""
    return verified_claims(spark, d).select("claim_id", "verdict", F.coalesce("policy", F.lit("")).alias("policy"), M.rounded(F.col("computed"), 6).alias("computed"), F.coalesce("abstain_reason", F.lit("")).alias("reason"))


def verified_claims(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: claims of a report to verdicts."""
    from .claims import sample_claims
    from .report import verdict_table
    from .verify import verify_claims

    ds = attach(_orders(spark, d), CONFIG)
    return verdict_table(spark, verify_claims(ds, sample_claims(), CONFIG))


OWN: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "agg_rounded_sum": _rounded("sum"),
    "agg_rounded_avg": _rounded("avg"),
    **{f.__name__: f for f in (rank_ties, rank_null_value_last, rank_min_rows_inclusive, summary_national, summary_by_quarter_qoq, summary_by_entity_share_rank, inject_cell_invariance, row_pick_limit_offset, latency_percentiles, star_join_etl, shared_scan_batch, batch_verdicts, claim_dup_spans, span_overlap_candidates, numeric_tokens, verified_claims, claim_rejections, compile_rows, policy_rows, verdict_outcomes)},
}

_ROUNDED_SQL = "SELECT l_returnflag, l_linestatus, round({a}(l_extendedprice), 2) AS price, round({a}(l_discount), 2) AS discount, count(*) AS n_rows FROM lineitem GROUP BY 1, 2"
SQL: dict[str, str] = {
    "agg_rounded_sum": _ROUNDED_SQL.format(a="sum"),
    "agg_rounded_avg": _ROUNDED_SQL.format(a="avg"),
    "rank_ties": _sql_rank(_by(ORDERS, ALL, "bucket"), "(SELECT *, CAST(o_custkey % 40 AS VARCHAR) AS bucket FROM orders)"),
    "rank_null_value_last": _sql_rank(_by(REVENUE, desc=False), "(SELECT o_orderdate, o_orderpriority, CASE WHEN o_orderpriority <> '2-HIGH' THEN o_totalprice END AS o_totalprice FROM orders)"),
    "rank_min_rows_inclusive": f"WITH g AS ({_sql_rank(_by(REVENUE))}), s AS (SELECT n_rows AS n FROM g ORDER BY n_rows LIMIT 1 OFFSET 2) SELECT key, value, n_rows, CASE WHEN n_rows >= n THEN rank() OVER (PARTITION BY n_rows >= n ORDER BY value DESC) END AS rank FROM g, s",
    "summary_national": "SELECT round(sum(o_totalprice), 2) AS revenue, CAST(count(*) AS DOUBLE) AS orders, round(avg(o_totalprice), 4) AS avg_order_value FROM orders",
    "summary_by_quarter_qoq": """WITH q AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, round(sum(o_totalprice), 2) AS revenue, CAST(count(*) AS DOUBLE) AS orders FROM orders GROUP BY 1)
SELECT period, revenue, orders, round(100.0 * (revenue - lag(revenue) OVER w) / nullif(lag(revenue) OVER w, 0), 6) AS revenue_change, round(100.0 * (orders - lag(orders) OVER w) / nullif(lag(orders) OVER w, 0), 6) AS orders_change FROM q WINDOW w AS (ORDER BY period)""",
    "summary_by_entity_share_rank": """WITH g AS (SELECT o_orderpriority AS key, round(sum(o_totalprice), 2) AS revenue, CAST(count(*) AS DOUBLE) AS orders, count(*) AS n_rows FROM orders GROUP BY 1)
SELECT *, round(100.0 * n_rows / sum(n_rows) OVER (), 6) AS row_share, rank() OVER (ORDER BY revenue DESC) AS revenue_rank, rank() OVER (ORDER BY orders DESC) AS orders_rank FROM g""",
    "inject_cell_invariance": _sql_aggregate(PLANS["agg_sum_period"]),
    "row_pick_limit_offset": "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND o_orderkey BETWEEN 100 AND 9000 ORDER BY o_orderkey LIMIT 1 OFFSET 11",
    "latency_percentiles": "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1",
    "star_join_etl": """SELECT o_orderkey, c_mktsegment, n_name, l.n_lines, l.revenue, date_diff('day', o_orderdate, l.shipped) AS days FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN (SELECT l_orderkey, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS revenue, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) l ON l.l_orderkey = o_orderkey""",
    "shared_scan_batch": _sql_shared_scan(),
    "batch_verdicts": """WITH g AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderstatus AS s, round(sum(o_totalprice), 2) AS computed FROM orders GROUP BY 1, 2),
c AS (SELECT *, (month(month) + ascii(s)) % 4 AS k FROM g),
d AS (SELECT *, CASE k WHEN 1 THEN round(computed, 0) WHEN 2 THEN computed + 0.1 ELSE computed END AS stated, CASE k WHEN 1 THEN 0 ELSE 2 END AS decimals FROM c)
SELECT CAST(month AS VARCHAR) || '/' || s AS claim_id, CASE WHEN k = 3 AND month(month) <= 6 THEN 'FAIL' WHEN abs(CAST(stated AS DECIMAL(38,6)) - CAST(computed AS DECIMAL(38,6))) * 2 <= CAST(power(10, -decimals) AS DECIMAL(38,6)) THEN 'PASS' ELSE 'FAIL' END AS verdict,
CASE WHEN k = 3 AND month(month) <= 6 THEN 'direction' ELSE 'half_ulp' END AS policy FROM d""",
    "claim_dup_spans": """WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS span, unnest(range(len(string_split(text, chr(10))))) % 50 AS id FROM documents),
m AS (SELECT *, count(*) OVER (PARTITION BY doc_id, span) > 1 AS s FROM c),
r AS (SELECT *, NOT s AND count(*) FILTER (WHERE NOT s) OVER (PARTITION BY doc_id, id) > 1 AS i FROM m)
SELECT doc_id, count(*) FILTER (WHERE s) AS n_span, count(*) FILTER (WHERE i) AS n_id, count(*) FILTER (WHERE NOT s AND NOT i) AS n_kept FROM r GROUP BY 1""",
    "span_overlap_candidates": """WITH a AS (SELECT doc_id, unnest(generate_series(0, length(text), 30)) AS s FROM documents), b AS (SELECT doc_id, unnest(generate_series(0, length(text), 35)) AS s FROM documents)
SELECT a.doc_id, count(*) AS pairs, CAST(sum(least(a.s + 40, b.s + 25) - greatest(a.s, b.s)) AS BIGINT) AS shared FROM a JOIN b ON a.doc_id = b.doc_id AND a.s < b.s + 25 AND b.s < a.s + 40 GROUP BY 1""",
}


def _sql_tokens() -> str:
    """Independent of the native form: texts are tiled by all chunks, places are running sums over tiles."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    c = text.LETTERS + ".,"
    currency = "|".join(p.replace("$", r"\$") for p in text.PREFIXES)
    scale = " ".join(f"WHEN {quoted(s)} THEN {by}" for s, by in text.SCALES.items())
    return rf"""
WITH t AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '[^{c}]*[{c}]+')) AS tile, generate_subscripts(regexp_extract_all(text, '[^{c}]*[{c}]+'), 1) AS k FROM documents),
p AS (SELECT doc_id, text, regexp_extract(tile, '[{c}]+$') AS chunk, CAST(sum(length(tile)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS stop FROM t),
b AS (SELECT *, stop - length(chunk) AS begin, regexp_extract(chunk, '{text.BODY}', 1) AS number, regexp_extract(chunk, '{text.BODY}', 2) AS scale FROM p WHERE regexp_matches(chunk, '{text.BODY}')),
s AS (SELECT *, regexp_extract(substring(text, greatest(begin - 3, 1), least(begin, 4)), '(?:^|[^{c}])({currency})$', 1) AS currency,
      CASE WHEN scale = '' AND number = chunk AND substring(text, stop + 1, 1) = '%' AND NOT regexp_matches(substring(text, stop + 2, 1), '[{text.LETTERS}]') THEN '%' ELSE scale END AS suffix FROM b),
f AS (SELECT *, currency || number || suffix AS said, begin + length(number) + length(suffix) AS e FROM s WHERE NOT (currency = '' AND suffix = '' AND regexp_matches(number, '^(19|20)[0-9][0-9]$')))
SELECT doc_id, said AS text, CAST(begin - length(currency) AS INTEGER) AS start, CAST(e AS INTEGER) AS "end",
       said || CASE WHEN regexp_matches(substring(text, e + 1, 400), '^[\s\p{{Z}}]+[A-Za-z]') THEN ' ' || regexp_extract(substring(text, e + 1, 400), '^[\s\p{{Z}}]+([A-Za-z]+)', 1) ELSE '' END AS context,
       CAST(replace(number, ',', '') AS DOUBLE) * CASE suffix {scale} ELSE 1.0 END AS value FROM f
"""


def _sql_rejections() -> str:
    at = lambda by, *xs: f"([{', '.join('NULL' if x is None else repr(x) for x in xs)}])[{by} % {len(xs)} + 1]"
    return f"""
WITH c AS (SELECT o_orderkey AS k, o_totalprice, {at('o_orderkey', 'point_value', 'growth', 'comparison', 'ranking', 'share', 'guess', None)} AS type FROM orders),
w AS (SELECT k, type, k % 11 <> 3 AS has_id, k % 13 <> 5 AS has_span, {at('(k // 3)', 'high', 'low', 'high', 'medium', None)} AS confidence, k % 17 <> 0 AS has_metric, k % 3 = 0 AS has_subject,
      CASE WHEN type IN ('point_value', 'growth', 'comparison', 'share') AND k % 5 > 0 THEN CASE WHEN k % 5 = 1 THEN -o_totalprice ELSE o_totalprice END END AS value,
      CASE WHEN type IN ('growth', 'comparison') OR k % 19 = 0 THEN {at('(k // 2)', 'increase', 'higher', 'decrease', 'worse', None)} END AS direction,
      k % 4 AS rank, {at('(k // 7)', 'highest', 'top', None)} AS rank_from, {at('(k // 5)', 'priority', 'quarter', None)} AS group_by FROM c)
SELECT k AS o_orderkey, CASE WHEN type IS NULL OR type = 'guess' THEN 'unknown_type'
  WHEN type NOT IN ('growth', 'comparison') AND direction IS NOT NULL THEN 'foreign_field'
  WHEN NOT has_id OR NOT has_span OR NOT has_metric OR confidence IS NULL OR confidence = 'medium' THEN 'invalid_claim'
  WHEN type = 'growth' AND (value < 0 OR direction IS NULL OR direction NOT IN ('increase', 'decrease')) THEN 'invalid_claim'
  WHEN type = 'comparison' AND (value < 0 OR direction IS NULL OR direction NOT IN ('higher', 'worse')) THEN 'invalid_claim'
  WHEN type = 'ranking' AND (rank < 1 OR rank_from = 'top' OR group_by IS NULL) THEN 'invalid_claim'
  WHEN type = 'share' AND NOT has_subject THEN 'invalid_claim' END AS rejected FROM w
"""


#: The flagship's claims in SQL: what each states, and what the tables say.
_OUTCOMES_SQL = """
WITH y AS (SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q, o_orderpriority AS p, o_totalprice AS x FROM orders),
r AS (SELECT round(sum(x) FILTER (WHERE y = 1997), 2) AS now, round(sum(x) FILTER (WHERE y = 1996), 2) AS before, CAST(count(*) FILTER (WHERE y = 1997) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE y = 1996) AS DOUBLE) AS n_before,
      100.0 * count(*) FILTER (WHERE y = 1997 AND p = '1-URGENT') / count(*) FILTER (WHERE y = 1997) AS share FROM y),
q AS (SELECT rank() OVER (ORDER BY round(sum(x), 2) DESC) AS k, q FROM y WHERE y = 1997 GROUP BY q),
p AS (SELECT rank() OVER (ORDER BY round(sum(x), 2) DESC) AS k, p FROM y WHERE y = 1997 GROUP BY p),
v AS (SELECT 'c1' AS claim_id, 'point' AS kind, 573455982.34 AS stated, 2 AS places, now AS computed, true AS up FROM r
  UNION ALL SELECT 'c2', 'point', 573455983.34, 2, now, true FROM r UNION ALL SELECT 'c3', 'point', 2279, 0, n, true FROM r
  UNION ALL SELECT 'c4', 'change', 2.44, 2, 100.0 * (now - before) / before, true FROM r UNION ALL SELECT 'c5', 'change', 2.44, 2, 100.0 * (now - before) / before, false FROM r
  UNION ALL SELECT 'c6', 'direction', NULL, NULL, n - n_before, true FROM r
  UNION ALL SELECT 'c7', 'rank', 1, NULL, CAST(k AS DOUBLE), true FROM q WHERE q = 3 UNION ALL SELECT 'c8', 'rank', 1, NULL, CAST(k AS DOUBLE), true FROM p WHERE p = '1-URGENT'
  UNION ALL SELECT 'c9', 'point', 20.1, 1, share, true FROM r),
j AS (SELECT *, kind IN ('change', 'direction') AND NOT (CASE WHEN up THEN computed > 0 ELSE computed < 0 END) AS turned,
      abs(CAST(stated AS DECIMAL(38,9)) - CAST(CASE WHEN kind = 'change' THEN abs(computed) ELSE computed END AS DECIMAL(38,9))) * 2 <= CAST(power(10, -places) AS DECIMAL(38,9)) AS near FROM v)
SELECT claim_id, CASE WHEN turned THEN 'FAIL' WHEN kind = 'direction' THEN 'PASS' WHEN kind = 'rank' THEN CASE WHEN stated = computed THEN 'PASS' ELSE 'FAIL' END WHEN near THEN 'PASS' ELSE 'FAIL' END AS verdict,
       CASE WHEN turned OR kind = 'direction' THEN 'direction' WHEN kind = 'rank' THEN 'rank' ELSE 'half_ulp' END AS policy, round(computed, 6) AS computed, '' AS reason FROM j
UNION ALL SELECT * FROM (VALUES ('c10', 'UNVERIFIABLE', '', CAST(NULL AS DOUBLE), 'schema_gap'), ('c11', 'UNVERIFIABLE', '', NULL, 'ambiguous'), ('c12', 'UNVERIFIABLE', '', NULL, 'no_data')) AS u(claim_id, verdict, policy, computed, reason)
"""
SQL |= {"numeric_tokens": _sql_tokens(), "claim_rejections": _sql_rejections(), "compile_rows": cases.COMPILE_SQL, "policy_rows": cases.POLICY_SQL, "verdict_outcomes": _OUTCOMES_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{k: _plan(p, _orders) for k, p in PLANS.items()}, **{k: _plan(p, _holes) for k, p in HOLED.items()}, **OWN}


def oracle_sql() -> dict[str, str]:
    return {**{k: _RUN[type(p)][1](p) for k, p in PLANS.items()}, **{k: _RUN[type(p)][1](p, HOLES) for k, p in HOLED.items()}, **SQL}

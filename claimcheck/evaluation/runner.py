"""The corruption benchmark: all variants' claims verified in one batch, outcomes aggregated by class."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Config, Verdict
from ..operators import rewrite
from ..sources.dataset import Dataset, attach
from ..verify import verify_claims
from .corrupt import EXACT, Variant

SCHEMA = "seed int, cls string, claim_id string, outcome string, false_alarms int, invariant boolean"


def _outcome(v: Verdict | None) -> str:
    return "missed" if v is None else {"FAIL": "detected", "UNVERIFIABLE": "abstained", "PASS": "false_accept"}[v.verdict]


def run(ds: Dataset, config: Config, text: str, suite: list[Variant]) -> DataFrame:
    """One row per variant. Equal claims of several variants are verified once."""
    spark = ds.df.sparkSession
    distinct = list({c.model_dump_json(): c for v in suite for c in v.claims}.items())
    by = dict(zip([k for k, _ in distinct], verify_claims(ds, [c for _, c in distinct], config)))
    rows = []
    for v in suite:
        got = {c.id: by[c.model_dump_json()] for c in v.claims}
        if v.cell is None:
            alarms = sum(x.verdict == "FAIL" for k, x in got.items() if k != v.claim_id)
            rows.append((v.seed, v.cls, v.claim_id, _outcome(got.get(v.claim_id)), alarms, None))
            continue
        column, pick, said = v.cell
        again = verify_claims(attach(injected(ds.df, column, pick, said, config), config, max_rows=None), list(v.claims), config)
        # a cell that names no entity moves a row out of a group; claims about the whole must not move
        same = all(a.verdict == got[c.id].verdict for c, a in zip(v.claims, again) if c.subject is None and c.type != "ranking")
        rows.append((v.seed, v.cls, "", "detected" if same else "missed", 0, same))
    return spark.createDataFrame(rows, SCHEMA)


def injected(df: DataFrame, column: str, pick: int, said: str, config: Config) -> DataFrame:
    """An instruction in one row's text cell; the row is the one whose hash comes first after ``pick``."""
    h = F.pmod(F.xxhash64(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]), F.lit(1 << 30))
    marked = df.withColumn("_h", h)
    first = marked.agg(F.min(F.when(F.col("_h") >= pick, F.col("_h"))).alias("a"), F.min("_h").alias("b")).first()
    at = first["a"] if first["a"] is not None else first["b"]
    return rewrite.with_cell(marked, "_h", at, column, said).drop("_h")


def class_rows(outcomes: DataFrame) -> DataFrame:
    """Counts and rates per class, and over all (overall) and the classes that must be computed (exact_match)."""
    parts = [outcomes.select("*", F.col("cls").alias("group")), outcomes.where(F.col("cls").isin(*EXACT)).select("*", F.lit("exact_match").alias("group")), outcomes.where(F.col("cls") != "instruction_in_data").select("*", F.lit("overall").alias("group"))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    n = F.count(F.lit(1))
    count = lambda o: F.count_if(F.col("outcome") == o)
    return both.groupBy("group").agg(n.alias("n"), *(count(o).alias(o) for o in ("detected", "abstained", "false_accept", "missed")), (count("detected") / n).alias("detection_rate"), (count("false_accept") / n).alias("false_accept_rate"), F.sum("false_alarms").alias("false_alarms"), F.countDistinct("seed").alias("seeds")).orderBy("group")


def percentiles(times: DataFrame, column: str) -> DataFrame:
    """p50 and p95, linearly interpolated."""
    return times.agg(F.percentile(column, F.array(F.lit(0.5), F.lit(0.95))).alias("p")).select(F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"))


def table(outcomes: DataFrame) -> str:
    head = ["group", "n", "detected", "abstained", "false_accept", "missed", "false_alarms"]
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    lines += ["| " + " | ".join(str(r[h]) for h in head) + " |" for r in class_rows(outcomes).collect()]
    return "\n".join(lines)


def spliced(readme: str, made: str, start: str = "<!-- bench -->", end: str = "<!-- /bench -->") -> str:
    """A text with what stands between the markers replaced."""
    a, b = readme.index(start) + len(start), readme.index(end)
    return readme[:a] + "\n" + made + "\n" + readme[b:]


def planned(suite: list[Variant], recorded: set[str]) -> dict[str, int]:
    """Calls that a live run would make: distinct texts without a recording."""
    from ..claims import fingerprint

    keys = {fingerprint(v.text) for v in suite}
    return {"artifacts": len(suite), "distinct": len(keys), "recorded": len(keys & recorded), "live": len(keys - recorded)}


def throttle(calls_per_minute: float, now: float, last: float | None) -> float:
    """Seconds to wait before the next call."""
    return 0.0 if last is None else max(0.0, 60.0 / calls_per_minute - (now - last))


def judge_summary(spark: SparkSession, ds: Dataset, config: Config) -> dict:
    """What a judging model would be shown: national, quarterly and per-entity figures, no rows."""
    from ..operators import summary

    return {"national": summary.national(ds.df, config).first().asDict(), "quarters": [r.asDict() for r in summary.by_quarter(ds.df, config).collect()], "entities": {d: [r.asDict() for r in summary.by_entity(ds.df, config, d).collect()] for d in config.entities}}

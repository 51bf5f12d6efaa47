"""A report, a dataset and a configuration to a run record."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession

from . import claims as C
from .model import Config
from .report import RunRecord
from .sources.dataset import Dataset, load
from .verify import verify_claims
from .vocabulary import load_config

PROMPT = (
    "List each checkable numeric statement of the report as an object of the given schema. "
    "Copy the span word for word. State values as written; growth and comparison values are magnitudes. "
    "Fields that the statement does not give are null. Use the report's own words for metrics, subjects and periods."
)


def run(ds: Dataset, text: str, raw: list, config: Config, *, dataset: str = "", model: str = "claims-file", exact: bool = True) -> RunRecord:
    """The dataset never meets the client, and a text reaches a verdict only through validated claims."""
    began = time.perf_counter()
    found = C.extract(text, raw)
    verdicts = verify_claims(ds, found.claims, config, exact=exact)
    return RunRecord(C.fingerprint(text), dataset, C.fingerprint(config.model_dump_json()), model, found, verdicts, {"verify_s": time.perf_counter() - began})


def verify_report(spark: SparkSession, report: str, data: str, config: str, client: C.Client, *, model: str = "claims-file", **caps) -> tuple[RunRecord, str]:
    text = C.read_report(report)
    cfg = load_config(config)
    ds = load(spark, data, cfg, **caps)
    return run(ds, text, C.ask(client, PROMPT, text), cfg, dataset=data, model=model), text

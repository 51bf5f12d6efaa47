"""Claims checked again as fact rows arrive (an extension, not parity): cubes of micro-batches add up.

Each micro-batch is rolled up and written under its batch id, so a batch that is run again
replaces its own rows and nothing is counted twice; verdicts are made from all cubes so far.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..compiler import compile_claim
from ..model import Abstain, Claim, Config, Verdict
from ..plans import cube
from ..sources.dataset import attach
from ..verify import abstained, decided


def verify_from_cube(cubes: DataFrame, claims: list[Claim], config: Config) -> list[Verdict]:
    plans = [compile_claim(c, config) for c in claims]
    computed = iter(cube.execute(cubes, config, [p for p in plans if not isinstance(p, Abstain)]))
    return [abstained(c, p) if isinstance(p, Abstain) else decided(c, p, next(computed), config) for c, p in zip(claims, plans)]


def reverify(stream: DataFrame, claims: list[Claim], config: Config, folder: str, report: Callable[[int, list[Verdict]], None], checkpoint: str):
    """Start a query that calls ``report(batch, verdicts)`` after each micro-batch; returns the query."""

    def step(batch: DataFrame, number: int) -> None:
        cube.build(attach(batch, config, max_rows=None), config).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        report(number, verify_from_cube(batch.sparkSession.read.parquet(folder), claims, config))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()

"""Command line: ``verify``, ``init`` and ``bench``. Exit 0: no failures; 1: some; 2: an error of the system."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import claims as C
from . import report as R
from .pipeline import verify_report
from .sources.dataset import describe


def _session() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _verify(a: argparse.Namespace) -> int:
    if a.claims:
        client: C.Client = C.FileClient(a.claims)
    elif a.recording:
        with open(a.recording, encoding="utf-8") as f:
            client = C.RecordingClient(json.load(f))
    else:
        raise ValueError("give --claims or --recording: no live model is built in")
    caps = {"max_bytes": None, "max_rows": None} if a.no_caps else {}
    run, text = verify_report(_session(), a.report, a.data, a.config, client, **caps)
    for path, made in ((a.json, R.to_json(run)), (a.markdown, R.to_markdown(run)), (a.html, R.to_html(run, text))):
        if path:
            with open(path, "w", encoding="utf-8") as f:
                f.write(made)
    if a.annotate:
        print("\n".join(R.annotations(run, text, a.report)))
    print(R.to_text(run), end="")
    if extra := R.stub(run.verdicts):
        print("\nThe configuration lacks:\n" + extra, end="")
    return run.exit_code(a.strict)


def _init(a: argparse.Namespace) -> int:
    out = R.template(describe(_session(), a.data), a.data)
    if a.out:
        with open(a.out, "w", encoding="utf-8") as f:
            f.write(out)
    else:
        print(out, end="")
    return 0


def _bench(a: argparse.Namespace) -> int:
    from .evaluation import corrupt, runner
    from .sources.dataset import load
    from .vocabulary import load_config

    config = load_config(a.config)
    ds = load(_session(), a.data, config)
    text = C.read_report(a.report)
    with open(a.claims, encoding="utf-8") as f:
        raw = json.load(f)
    suite = corrupt.generate(text, C.extract(text, raw).claims, config, seeds=range(1, a.seeds + 1))
    if a.out:
        corrupt.write(suite, a.out)
    print(runner.table(runner.run(ds, config, text, suite)))
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="claimcheck", description=__doc__)
    sub = p.add_subparsers(required=True)
    v = sub.add_parser("verify")
    v.add_argument("report")
    for name in ("data", "config"):
        v.add_argument(f"--{name}", required=True)
    for name in ("claims", "recording", "json", "markdown", "html"):
        v.add_argument(f"--{name}")
    for name in ("strict", "annotate", "no-caps"):
        v.add_argument(f"--{name}", action="store_true")
    v.set_defaults(run=_verify)
    i = sub.add_parser("init")
    i.add_argument("data")
    i.add_argument("--out")
    i.set_defaults(run=_init)
    b = sub.add_parser("bench")
    b.add_argument("report")
    for name in ("data", "config", "claims"):
        b.add_argument(f"--{name}", required=True)
    b.add_argument("--seeds", type=int, default=5)
    b.add_argument("--out")
    b.set_defaults(run=_bench)
    a = p.parse_args(argv)
    try:
        return a.run(a)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())

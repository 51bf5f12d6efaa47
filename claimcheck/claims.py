"""Claims from outside: wire objects are validated and rejected, never repaired."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from dataclasses import dataclass
from typing import Any, Protocol

from pydantic import ValidationError
from pyspark.sql import types as T

from .model import CLAIM_TYPES, Claim, Comparison, Growth, PointValue, Ranking, Share, rules, wire_fields
from .operators.text import Token, uncovered, written_as_difference

MAX_REPORT_BYTES = 1 << 20


@dataclass(frozen=True)
class Rejected:
    reason: str
    raw: Any
    detail: str = ""


@dataclass(frozen=True)
class Extraction:
    claims: list[Claim]
    rejected: list[Rejected]
    unextracted: list[Token]


class Client(Protocol):
    """Turns a report into raw wire objects: a model, a recording or a file."""

    def extract(self, prompt: str, text: str, schema: dict) -> str: ...


class ReportError(ValueError):
    pass


class StaleRecording(ValueError):
    pass


def wire_schema() -> dict:
    """JSON schema of a wire claim: every field of any type, required and nullable."""
    kinds = {"double": "number", "int": "integer", "string": "string"}
    item = {"type": "object", "additionalProperties": False, "required": list(wire_fields()), "properties": {k: {"type": [kinds[t], "null"]} for k, t in wire_fields().items()}}
    item["properties"]["type"] = {"type": "string", "enum": sorted(CLAIM_TYPES)}
    return {"type": "array", "items": item}


def wire_struct() -> T.StructType:
    """The same as a Spark schema, for tables of claims."""
    kinds = {"double": T.DoubleType(), "int": T.IntegerType(), "string": T.StringType()}
    return T.StructType([T.StructField(k, kinds[t]) for k, t in wire_fields().items()])


def parse_one(raw: Any) -> Claim | Rejected:
    """A claim, or why the object is none. A key that must be stated is never filled in."""
    if not isinstance(raw, dict):
        return Rejected("not_an_object", raw)
    kind = CLAIM_TYPES.get(raw.get("type"))
    if kind is None:
        return Rejected("unknown_type", raw, str(raw.get("type")))
    known = rules(raw["type"])
    foreign = sorted(k for k, v in raw.items() if v is not None and k not in known and k != "type")
    if foreign:
        return Rejected("foreign_field", raw, ", ".join(foreign))
    try:
        return kind.model_validate({k: raw[k] for k, r in known.items() if k in raw and (r.stated or raw[k] is not None)})
    except ValidationError as e:
        return Rejected("invalid_claim", raw, "; ".join(f"{'.'.join(map(str, x['loc']))}: {x['msg']}" for x in e.errors()))


def stated_values(claim: Claim) -> tuple[float, ...]:
    return tuple(float(x) for x in (getattr(claim, "value", None), getattr(claim, "rank", None)) if x is not None)


def extract(text: str, raw: list[Any]) -> Extraction:
    """Validate each object, hold its span against the text, drop both copies of repeated spans and ids, sweep what is left."""
    good, rejected = [], []
    for r in raw:
        c = parse_one(r)
        if isinstance(c, Rejected):
            rejected.append(c)
        elif not c.span or c.span not in text:
            rejected.append(Rejected("span_not_verbatim", r))
        elif isinstance(c, (Growth, Comparison)) and c.value is not None and not written_as_difference(c.type, c.span, c.value):
            rejected.append(Rejected("value_not_a_difference", r))
        else:
            good.append((c, r))
    for reason, key in (("duplicate_span", lambda c: c.span), ("duplicate_id", lambda c: c.id)):
        n = Counter(key(c) for c, _ in good)
        rejected += [Rejected(reason, r) for c, r in good if n[key(c)] > 1]
        good = [(c, r) for c, r in good if n[key(c)] == 1]
    claims = [c for c, _ in good]
    return Extraction(claims, rejected, uncovered(text, [(c.span, stated_values(c)) for c in claims]))


def read_report(path: str) -> str:
    with open(path, "rb") as f:
        raw = f.read(MAX_REPORT_BYTES + 1)
    if len(raw) > MAX_REPORT_BYTES:
        raise ReportError(f"{path}: over {MAX_REPORT_BYTES} bytes")
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError as e:
        raise ReportError(f"{path}: not UTF-8") from e
    if not text.strip():
        raise ReportError(f"{path}: empty")
    return text


def fingerprint(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


class FileClient:
    """A JSON array of wire objects in place of a model's answer; the same checks follow."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            self.answer = f.read()

    def extract(self, prompt: str, text: str, schema: dict) -> str:
        return self.answer


class RecordingClient:
    """Replays recorded answers in order; a recording of another prompt, text or schema is an error."""

    def __init__(self, recording: dict) -> None:
        self.recording, self.left = recording, list(recording["responses"])

    @staticmethod
    def keys(model: str, prompt: str, text: str, schema: dict) -> dict:
        return {"model": model, "prompt_sha256": fingerprint(prompt), "artifact_sha256": fingerprint(text), "schema_sha256": fingerprint(json.dumps(schema, sort_keys=True))}

    def extract(self, prompt: str, text: str, schema: dict) -> str:
        want = self.keys(self.recording["model"], prompt, text, schema)
        if stale := [k for k, v in want.items() if self.recording.get(k) != v]:
            raise StaleRecording(f"recorded for another {', '.join(stale)}")
        if not self.left:
            raise StaleRecording("the recording has no more answers")
        return self.left.pop(0)


def ask(client: Client, prompt: str, text: str, *, pauses: tuple[float, ...] = (1, 4, 16), wait=None) -> list[Any]:
    """The client's array of objects: passing failures are tried again after each pause, an unreadable answer once."""
    import time

    wait = wait or time.sleep
    schema = wire_schema()
    for attempt in (0, 1):
        for k in range(len(pauses) + 1):
            try:
                answer = client.extract(prompt, text, schema)
                break
            except (ConnectionError, TimeoutError):
                if k == len(pauses):
                    raise
                wait(pauses[k])
        try:
            got = json.loads(answer)
            if isinstance(got, list):
                return got
            error: Exception = ValueError("the answer is not an array")
        except ValueError as e:
            error = e
        if attempt:
            raise ValueError(f"no readable answer: {error}")
    raise AssertionError


def sample_claims() -> list[Claim]:
    """A few claims about the orders table at scale 0.01, right and wrong ones and some that cannot be checked."""
    y = {"period": "1997", "confidence": "high"}
    z = {"confidence": "low"}
    return [
        PointValue(id="c1", span="revenue was 573,455,982.34 in 1997", metric="revenue", value=573455982.34, **y),
        PointValue(id="c2", span="revenue was 573,455,983.34 in 1997", metric="revenue", value=573455983.34, **y),
        PointValue(id="c3", span="2,279 orders in 1997", metric="orders", value=2279, **y),
        Growth(id="c4", span="revenue grew 2.44% over 1996", metric="revenue", value=2.44, direction="increase", baseline_period="1996", **y),
        Growth(id="c5", span="revenue fell 2.44% over 1996", metric="revenue", value=2.44, direction="decrease", baseline_period="1996", **y),
        Comparison(id="c6", span="orders were higher than in 1996", metric="orders", value=None, direction="higher", baseline_period="1996", **y),
        Ranking(id="c7", span="Q3 had the highest revenue of 1997", metric="revenue", rank=1, rank_from="highest", group_by="quarter", period="1997 Q3", scope="1997", **z),
        Ranking(id="c8", span="urgent was first by revenue", metric="revenue", rank=1, rank_from="highest", group_by="priority", subject="urgent", **y),
        Share(id="c9", span="urgent made 20.1% of orders", metric="orders", subject="urgent", value=20.1, **y),
        PointValue(id="c10", span="profit was 12", metric="profit", value=12, **y),
        PointValue(id="c11", span="revenue was 5 lately", metric="revenue", value=5, period="lately", **z),
        PointValue(id="c12", span="revenue was 5 in 1990", metric="revenue", value=5, period="1990", **z),
    ]

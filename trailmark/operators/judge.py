"""Judges: the one user-supplied function, and what may go wrong with it."""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame

ANSWERS = "key string, answers string, ms double, error string"
#: Statuses that are tried again, and how often.
AGAIN, RETRIES, DEADLINE_S = (429, 500, 502, 503, 504), 2, 2.5


class Transport(Protocol):
    """Sends a request body and returns status, headers and body."""

    def __call__(self, body: bytes, timeout: float) -> tuple[int, dict[str, str], bytes]: ...


@dataclass(frozen=True)
class Http:
    """POST to a URL with a bearer key."""

    url: str
    key: str

    def __call__(self, body: bytes, timeout: float) -> tuple[int, dict[str, str], bytes]:
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return r.status, dict(r.headers), r.read()
        except urllib.error.HTTPError as e:
            return e.code, dict(e.headers), e.read()


def decide(transport: Transport, state: Any, questions: dict[str, Any], deadline: float = DEADLINE_S, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> dict[str, Any]:
    """One call under one deadline, with at most two retries; never raises: answers or error."""
    began, body = clock(), json.dumps({"state": state, "questions": questions}).encode()
    for attempt in range(RETRIES + 1):
        left = deadline - (clock() - began)
        if left <= 0:
            return {"error": "timeout", "ms": (clock() - began) * 1000}
        try:
            status, headers, raw = transport(body, left)
        except Exception as e:  # noqa: BLE001  whatever a transport raises, the output passes through
            return {"error": type(e).__name__, "ms": (clock() - began) * 1000}
        if status == 200:
            answers = validated(raw, questions)
            return {"answers": answers, "ms": (clock() - began) * 1000} if answers is not None else {"error": "invalid answer", "ms": (clock() - began) * 1000}
        if status not in AGAIN or attempt == RETRIES:
            return {"error": f"status {status}", "ms": (clock() - began) * 1000}
        asked = headers.get("Retry-After", "")
        wait = float(asked) if asked.replace(".", "", 1).isdigit() else 0.15 * 2**attempt
        if wait > deadline - (clock() - began):
            return {"error": "timeout", "ms": (clock() - began) * 1000}
        sleep(wait)
    return {"error": "unavailable", "ms": (clock() - began) * 1000}


def is_share(x: Any) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x) and 0 <= x <= 1


def validated(raw: bytes, questions: dict[str, Any]) -> dict[str, Any] | None:
    """The answers if every question has a well-formed one, else None."""
    try:
        answers = json.loads(raw)["answers"]
        for name, question in questions.items():
            a = answers[name]
            if a["type"] != question["type"]:
                return None
            if a["type"] == "noul" and not is_share(a["noul"]):
                return None
            if a["type"] == "choice" and not (a["choice"] in question["criteria"] and is_share(a["confidence"]) and a["choice"] in a["probabilities"] and all(map(is_share, a["probabilities"].values()))):
                return None
    except (ValueError, KeyError, TypeError):
        return None
    return answers


def clamped(probabilities: dict[str, float]) -> dict[str, float]:
    """The research rule: out-of-range values are clamped, and what is no number is left out."""
    return {k: min(1.0, max(0.0, float(v))) for k, v in probabilities.items() if isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v)}


def ask(requests: DataFrame, make: Callable[[], Transport], concurrency: int = 4) -> DataFrame:
    """Answers for requests (key, state and questions as JSON); each task keeps at most concurrency calls open."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transport = make()
        with ThreadPoolExecutor(concurrency) as pool:
            for frame in frames:
                found = pool.map(lambda r: decide(transport, json.loads(r.state), json.loads(r.questions)), frame.itertuples(index=False))
                yield pd.DataFrame([{"key": k, "answers": json.dumps(f["answers"]) if "answers" in f else None, "ms": f["ms"], "error": f.get("error")} for k, f in zip(frame["key"], found, strict=True)], columns=["key", "answers", "ms", "error"])

    return requests.select("key", "state", "questions").mapInPandas(rows, ANSWERS)


class Recorded:
    """A transport that replays answers by state, for tests: {json of state: [(status, headers, body), ...]}."""

    def __init__(self, answers: dict[str, list[tuple[int, dict[str, str], bytes]]]):
        self.answers = {k: list(v) for k, v in answers.items()}

    def __call__(self, body: bytes, timeout: float) -> tuple[int, dict[str, str], bytes]:
        return self.answers[json.dumps(json.loads(body)["state"], sort_keys=True)].pop(0)



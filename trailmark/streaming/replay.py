"""Exact replay of a session, message by message, with feedback.

A folded read takes the place of the original for all later decisions: it is no
evidence itself, and its shorter text counts in the ages that follow. So each
decision depends on the ones before, and a session is one sequential fold. The
same fold serves whole sessions (``replay``) and streams (``replay_stream``);
sessions go side by side.

State is bounded by freshness: evidence of an earlier request or beyond the
token age is dropped at once, and open calls when their result has come.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as X
from ..functions.logs import u16
from ..operators.dedupe import DEFAULT, RECALL, TAG, Freshness
from ..operators.events import with_message

OUTPUT = "session string, ord bigint, call_id string, status string, alias string, folded_lines int, original_tokens bigint, kept_tokens bigint, text string"
_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
_NEEDED = ["session", "ord", "msg", "kind", "call_id", "tool", "args", "text", "is_error", "text_only"]
_FOOTER = re.compile(X.FOOTER.replace(r"\z", r"\Z"), re.ASCII)
_REFERENCE = re.compile(X.REFERENCE, re.ASCII)
_NAMED = re.compile(r"[a-z][A-Z]|[A-Z]+_[A-Z]+|[A-Za-z0-9_][/.][A-Za-z0-9_]")


def tokens(text: str) -> int:
    return -(-u16(text) // 4)


def references(text: str) -> str:
    found = [t for t in dict.fromkeys(_REFERENCE.findall(text)) if len(t) <= 80 and _NAMED.search(t)][:6]
    return f" Hidden references (partial): {', '.join(found)}." if found else ""


def runs(late: list[str], first: int, early: list[str], e_first: int, least: int) -> list[tuple[int, int]]:
    """Runs of equal lines at equal places, as from and to in the late text, from 1."""
    shift = first - e_first
    equal = [0 <= i + shift < len(early) and x == early[i + shift] for i, x in enumerate(late)]
    edges = [i for i in range(len(equal) + 1) if (i < len(equal) and equal[i]) != (i > 0 and equal[i - 1])]
    return [(a + 1, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= least]


class Session:
    """What a session's next decision depends on."""

    def __init__(self, cfg: Freshness = DEFAULT, state: dict[str, Any] | None = None, act: bool = True):
        self.cfg, self.act = cfg, act
        s = state or {}
        self.epoch, self.upto, self.seq, self.last = s.get("epoch", 0), s.get("upto", 0), s.get("seq", 0), s.get("last", -1)
        self.msg, self.units = s.get("msg"), s.get("units", 0)
        self.calls: dict[str, str] = s.get("calls", {})
        self.evidence: dict[str, list[dict[str, Any]]] = s.get("evidence", {})

    def state(self) -> dict[str, Any]:
        return {"epoch": self.epoch, "upto": self.upto, "seq": self.seq, "last": self.last, "msg": self.msg, "units": self.units, "calls": self.calls, "evidence": self.evidence}

    def _forget(self) -> None:
        fresh = {p: [e for e in es if self.upto - e["upto"] <= self.cfg.max_age][-self.cfg.max_earlier :] for p, es in self.evidence.items()}
        self.evidence = {p: es for p, es in fresh.items() if es}

    def _grow(self, msg: int, part: str) -> None:
        """A message's parts count as joined by line feeds and rounded up once."""
        same = msg == self.msg
        before = -(-self.units // 4) if same else 0
        self.msg, self.units = msg, (self.units + 1 if same else 0) + u16(part)
        self.upto += -(-self.units // 4) - before

    def take(self, m: Any) -> dict[str, Any] | None:
        """The next message; the outcome of a result."""
        if m.ord <= self.last:
            return {"ord": m.ord, "call_id": m.call_id, "status": "late"}
        self.last = m.ord
        text = m.text or ""
        if m.kind == "user":
            self.epoch += 1
            if self.cfg.same_epoch:
                self.evidence = {}
        if m.kind == "call":
            self.calls[m.call_id] = m.args or "{}"
        if m.kind != "result":
            self._grow(m.msg, self.calls[m.call_id] if m.kind == "call" else text)
            self._forget()
            return None
        args = json.loads(self.calls.pop(m.call_id, "{}"))
        self.seq += 1
        alias = f"t{self.seq}"
        found = None
        if m.tool == "read" and not m.is_error and m.text_only:
            try:
                found = self._read(args, text, m.call_id, alias)
            except (AttributeError, TypeError, ValueError) as e:  # a strange argument must not stop the session: the original stays
                found = {"status": f"error: {type(e).__name__}"}
        if found and found["status"] == "folded" and self.act:
            text = found["text"]
        self.upto += tokens(text)
        if found and "entry" in found and (found["status"] != "folded" or not self.act):
            path, entry = found["entry"]
            self.evidence.setdefault(path, []).append(entry | {"upto": self.upto})
        self._forget()
        if not found or found["status"] == "kept":
            return None
        return {"ord": m.ord, "call_id": m.call_id, "alias": alias, **found}

    def _read(self, args: dict, text: str, call_id: str, alias: str) -> dict[str, Any] | None:
        path, first = args.get("path"), args.get("offset", 1)
        if not isinstance(path, str) or isinstance(first, bool) or not isinstance(first, int | float) or first != int(first) or first < 1:
            return None
        first = int(first)
        footer = _FOOTER.search(text)
        body = text[: footer.start()] if footer else text
        lines = body.split("\n")
        own = f"{RECALL} with id" in text or text.startswith(TAG)
        out: dict[str, Any] = {"status": "kept"} | ({} if own else {"entry": (path, {"call": call_id, "first": first, "body": body})})
        if len(lines) < self.cfg.min_lines:
            return out
        fresh = [e for e in self.evidence.get(path, []) if self.upto - e["upto"] <= self.cfg.max_age]
        for e in reversed(fresh[-self.cfg.max_earlier :]):
            some = runs(lines, first, e["body"].split("\n"), e["first"], self.cfg.min_run)
            if some:
                break
        else:
            return out
        covered = sum(b - a + 1 for a, b in some)
        hidden = "\n".join("\n".join(lines[a - 1 : b]) for a, b in some)
        shown = [
            f"{TAG} {path}: file lines {first}-{first + len(lines) - 1}. Folded {covered}/{len(lines)} file lines matching read {e['call']} still in context."
            f' Full output: {RECALL} with id "{alias}".{references(hidden)} Search original chunks with {RECALL} query.'
        ]
        at = 0
        for a, b in some:
            shown += [*lines[at : a - 1], f'… [file lines {first + a - 1}-{first + b - 1} unchanged; {RECALL} with id "{alias}"] …']
            at = b
        folded = "\n".join([*shown, *lines[at:]]) + (footer[0] if footer else "")
        before, after = tokens(text), tokens(folded)
        if after > before * (1 - self.cfg.min_saved_share):
            return out
        return out | {"status": "folded", "folded_lines": covered, "original_tokens": before, "kept_tokens": after, "text": folded}


def _frame(session: str, found: list[dict[str, Any]]) -> pd.DataFrame:
    # plain objects: None is null in every column, and Arrow makes one array of each
    rows = [[f.get(c) if c != "session" else session for c in _COLUMNS] for f in found]
    return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(_COLUMNS)})


def replay(messages: DataFrame, cfg: Freshness = DEFAULT, act: bool = True) -> DataFrame:
    """Folded reads of whole sessions, with feedback. act False: decide only (shadow)."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        session = Session(cfg, act=act)
        ordered = frame.sort_values("ord", kind="stable")
        found = [f for m in ordered.itertuples(index=False) if (f := session.take(m))]
        return _frame(frame["session"].iloc[0], found)

    return with_message(messages).select(_NEEDED).groupBy("session").applyInPandas(one, OUTPUT)


class ReplayProcessor(StatefulProcessor):
    """The fold over a stream: rows of a micro-batch in the order of ord; rows behind it come out as late."""

    def __init__(self, cfg: Freshness = DEFAULT, act: bool = True):
        self.cfg, self.act = cfg, act

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("session", "state string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values("ord", kind="stable")
        before = json.loads(self.kept.get()[0]) if self.kept.exists() else None
        session = Session(self.cfg, before, self.act)
        found = [f for m in frame.itertuples(index=False) if (f := session.take(m))]
        self.kept.update((json.dumps(session.state()),))
        yield _frame(key[0], found)

    def close(self) -> None:
        pass


def replay_stream(messages: DataFrame, cfg: Freshness = DEFAULT, act: bool = True) -> DataFrame:
    """``replay`` of a streaming frame of messages. The state store must be RocksDB."""
    return with_message(messages).select(_NEEDED).groupBy("session").transformWithStateInPandas(ReplayProcessor(cfg, act), OUTPUT, "Append", "None")


def originals_first(batch: DataFrame, number: int, originals: str, log: str) -> str | None:
    """A foreachBatch sink: what is folded is stored before its decision is logged; a repeated batch replaces its own files.

    Originals must be stored, or the batch fails and is tried again. A log that
    can't be written stops nothing: its error is returned.
    """
    found = batch.persist()
    try:
        found.filter("status = 'folded'").select("session", "alias", "call_id", "ord", "text").write.mode("overwrite").parquet(f"{originals}/batch={number}")
        try:
            found.drop("text").write.mode("overwrite").parquet(f"{log}/batch={number}")
        except Exception as e:  # noqa: BLE001  whatever the log's store says, the session goes on
            return type(e).__name__
        return None
    finally:
        found.unpersist()

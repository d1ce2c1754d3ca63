"""A session's commands: status, report, recall, labels."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import analytics, dedupe, recall, sieve
from .settings import Settings, checked

LABELLED = ("seen", "sieve")


@dataclass
class Workbench:
    """Messages, saved originals (session, alias, call_id, summary, text) and a log (session, ord, kind, acted, from, to)."""

    messages: DataFrame
    originals: DataFrame
    log: DataFrame
    settings: Settings = Settings()

    def set(self, **values: Any) -> Settings:
        """Change settings; what is not valid changes nothing."""
        self.settings = replace(self.settings, **checked(values))
        return self.settings

    def folded(self) -> DataFrame | None:
        if self.settings.dedupe == "off":
            return None
        return dedupe.plan(self.messages, replace(dedupe.DEFAULT, max_age=self.settings.max_age, same_epoch=self.settings.same_epoch))

    def shortened(self, judge: sieve.Judge) -> DataFrame | None:
        if self.settings.sieve == "off":
            return None
        s = self.settings
        return sieve.plan(self.messages, judge, replace(sieve.DEFAULT, threshold=s.threshold, min_share=s.min_share, min_saved=s.min_saved))

    def report(self) -> DataFrame:
        return analytics.telemetry(self.log)

    def status(self) -> DataFrame:
        """One line a session: mode, acted results, tokens saved."""
        r = self.report()
        return r.select("session", F.concat(F.lit(f"ctx:{self.settings.mode} · "), (F.col("collapsed") + F.col("shortened")).cast("string"), F.lit(" trimmed, "), F.round(F.col("saved") / 1000, 1).cast("string"), F.lit("k tok saved")).alias("status"))

    def recall(self, session: str, id: str | None = None, query: str | None = None, budget: int = 800, offset: float = 1, limit: float = 2000) -> dict[str, Any]:
        """A search of the session's originals, or the exact lines of one by alias or call."""
        own = self.originals.filter(F.col("session") == session)
        if id is not None:
            ids = own.sparkSession.createDataFrame([(session, id)], "session string, id string")
            found = recall.lookup(own, ids).first()["original"]
            if found is None:
                known = [r["alias"] for r in own.select("alias").orderBy(F.desc("alias")).limit(20).collect()]
                return {"status": "unknown", "known": known}
            own = own.filter(F.col("alias") == found["alias"])
        if query is not None:
            return recall.search(own.select("alias", "summary", "text"), query, budget, max(1, int(offset)))
        if id is None:
            return {"status": "nothing asked"}
        page = own.select(recall.lines_page(F.col("text"), F.lit(offset), F.lit(limit)).alias("p"), "alias").first()
        return {"status": "lines", "alias": page["alias"], "lines": page["p"]["lines"], "total": page["p"]["total"], "next": page["p"]["next"]}

    def label(self, session: str, text: str) -> DataFrame:
        """A log row that labels the session's last fold or shortening; empty if there was none."""
        last = self.log.filter((F.col("session") == session) & F.col("kind").isin(*LABELLED)).orderBy(F.desc("ord")).limit(1)
        return last.select("session", F.lit("label").alias("kind"), F.col("kind").alias("target"), F.col("ord").alias("target_ord"), F.lit(text).alias("label"))

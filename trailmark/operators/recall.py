"""Search of saved originals: ranked verbatim chunks within a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import logs
from ..functions import text as X
from .dedupe import RECALL


def hits(originals: DataFrame, query: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Chunks that match the query: keys, alias, summary, from, to, text, score.

    originals: keys, alias, summary, text. The score is the number of query words
    in the chunk, doubled by their number if it holds the query literally.
    """
    terms = X.words(F.lit(query))
    exploded = originals.select(*keys, "alias", "summary", F.explode(logs.chunks_of("text")).alias("c")).select(*keys, "alias", "summary", "c.*")
    matched = F.size(F.array_intersect(X.words(F.col("text")), terms))
    exact = F.lower("text").contains(query.lower())
    return exploded.withColumn("score", matched + F.when(exact, F.size(terms)).otherwise(0)).filter("score > 0")


def ranked(found: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    order = [F.desc("score"), F.asc("alias"), F.asc("from")]
    by = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    return found.withColumn("rank", F.row_number().over(by.orderBy(*order)))


def page(found: DataFrame, budget: int = 800, offset: int = 1, keys: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """The ranked chunks from offset on that fit in the budget, up to the first that does not.

    A chunk takes a token at least, so no more than budget of them can fit:
    the ranking is cut to that many before any sum runs.
    """
    part = F.concat(F.lit(f"[{RECALL} "), "alias", F.lit("] Historical "), "summary", F.lit(": output lines "), F.col("from").cast("string"), F.lit("-"), F.col("to").cast("string"), F.lit("\n"), "text")
    if keys:
        some = ranked(found, keys).filter(F.col("rank") < offset + budget)
    else:
        some = ranked(found.orderBy(F.desc("score"), F.asc("alias"), F.asc("from")).limit(offset + budget - 1))
    some = some.filter(F.col("rank") >= offset).withColumn("part", part).withColumn("part_tokens", X.tokens(F.col("part")))
    by = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    used = F.sum("part_tokens").over(by.orderBy("rank"))
    return some.withColumn("used", used).filter(F.col("used") <= budget)


def coverage(originals: DataFrame, query: str) -> tuple[list[str], list[str]]:
    """Query words that no original holds, and identifiers without an exact match."""
    spark = originals.sparkSession
    row = spark.range(1).select(X.words(F.lit(query)).alias("w"), X.query_identifiers(F.lit(query)).alias("i")).first()
    words, names = row["w"], row["i"]
    checks = [F.max(F.array_contains(X.words(F.col("text")), w)).alias(f"w{i}") for i, w in enumerate(words)]
    around = r"[\p{L}\p{N}_$./-]"
    quoted = lambda s: "\\Q" + s + "\\E"
    checks += [F.max(F.col("text").rlike(f"(?iu)(?<!{around}){quoted(s)}(?!{around})")).alias(f"i{i}") for i, s in enumerate(names)]
    if not checks:
        return [], []
    got = originals.agg(*checks).first().asDict()
    return [w for i, w in enumerate(words) if not got[f"w{i}"]], [s for i, s in enumerate(names) if not got[f"i{i}"]]


def search(originals: DataFrame, query: str, budget: int = 800, offset: int = 1) -> dict:
    """The answer to a query: status, text, hits, returned, missing words and identifiers, next offset."""
    n = originals.count()
    if not n:
        return {"status": "empty", "hits": 0, "returned": 0, "text": "No saved originals to search."}
    if not query_words(originals, query):
        return {"status": "no_terms", "hits": 0, "returned": 0, "text": "Provide a query containing words or identifiers."}
    missing, names = coverage(originals, query)
    found = hits(originals, query)
    total = found.count()
    if not total:
        return {"status": "no_match", "hits": 0, "returned": 0, "missing": missing, "missing_identifiers": names, "text": f"No lexical matches. Searched {n} saved original(s)."}
    shown = page(found, budget, offset).orderBy("rank").collect()
    following = offset + len(shown)
    return {
        "status": "partial" if missing or names else "complete", "hits": total, "returned": len(shown), "missing": missing, "missing_identifiers": names,
        "used": shown[-1]["used"] if shown else 0, "next": following if following <= total else None, "text": "\n\n".join(r["part"] for r in shown),
        "chunks": [(r["alias"], r["from"], r["to"]) for r in shown],
    }


def query_words(frame: DataFrame, query: str) -> list[str]:
    return frame.sparkSession.range(1).select(X.words(F.lit(query)).alias("w")).first()["w"]


def lookup(originals: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (session, id) with the original of that alias, else of that call: alias first, by two equi joins."""
    by_alias = originals.select("session", F.col("alias").alias("id"), F.struct("alias", "call_id", "text").alias("a"))
    by_call = originals.select("session", F.col("call_id").alias("id"), F.struct("alias", "call_id", "text").alias("b"))
    return ids.join(by_alias, ["session", "id"], "left").join(by_call, ["session", "id"], "left").select("session", "id", F.coalesce("a", "b").alias("original"))


def lines_page(text: F.Column, offset: F.Column, limit: F.Column) -> F.Column:
    """Lines from offset (at least 1) on, limit of them; total and next (null at the end; empty lines past it)."""
    lines = X.pieces(text)
    first = F.greatest(F.lit(1), F.floor(offset)).cast("int")
    last = F.least(F.size(lines), first - 1 + F.greatest(F.lit(1), F.floor(limit)).cast("int"))
    some = F.when(first <= F.size(lines), F.slice(lines, first, F.greatest(last - first + 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return F.struct(some.alias("lines"), F.size(lines).alias("total"), F.when(last < F.size(lines), last + 1).alias("next"))

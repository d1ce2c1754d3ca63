"""Measures of decisions against labels, and order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.model import LABELS, PREDICTIONS

#: Ties go to the safer decision.
SAFETY = ("KEEP", "TRUNCATE", "UNCERTAIN", "DROP")


def ratio(part: Column, whole: Column) -> Column:
    """NaN where nothing counts."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(float("nan")))


def confusion(rows: DataFrame, truth: str = "truth", pred: str = "pred", labels: tuple = LABELS, predictions: tuple = PREDICTIONS) -> DataFrame:
    """One row per label, one column per prediction; zeros filled in."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(str(x),) for x in labels], "truth string")
    counts = rows.groupBy(F.col(truth).cast("string").alias("truth")).agg(*[F.count_if(F.col(pred).cast("string") == str(p)).alias(f"pred_{p}".lower()) for p in predictions])
    return every.join(counts, "truth", "left").na.fill(0)


def summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The measures of rows: key, truth, acceptable, critical, pred, tokens, truncated_tokens."""
    n = F.count(F.lit(1))
    truth, pred, critical = F.col("truth"), F.col("pred"), F.col("critical")
    may_drop = F.array_contains("acceptable", "DROP")
    share = lambda part, whole=None: ratio(F.count_if(part), n if whole is None else F.count_if(whole))
    saved = F.when(pred == "DROP", F.col("tokens")).when(pred == "TRUNCATE", F.greatest(F.lit(0), F.col("tokens") - F.col("truncated_tokens"))).otherwise(0)
    return rows.groupBy(*(by or [])).agg(
        n.alias("n"),
        share(pred == truth).alias("accuracy"),
        share(F.array_contains("acceptable", pred)).alias("lenient_accuracy"),
        share((truth == "KEEP") & (pred == "KEEP"), truth == "KEEP").alias("keep_recall"),
        share((truth != "DROP") & (pred != "DROP"), truth != "DROP").alias("retention"),
        share(critical & (pred == "DROP"), critical).alias("critical_false_drop_rate"),
        F.sort_array(F.collect_set(F.when(critical & (pred == "DROP"), F.col("key")))).alias("critical_false_drops"),
        share(~may_drop & (pred == "DROP"), ~may_drop).alias("false_drop_rate"),
        share((truth == "TRUNCATE") & (pred == "TRUNCATE"), truth == "TRUNCATE").alias("truncate_accuracy"),
        share(may_drop & (pred == "DROP"), pred == "DROP").alias("drop_precision"),
        share((truth == "DROP") & (pred == "DROP"), truth == "DROP").alias("drop_recall"),
        share(pred == "UNCERTAIN").alias("uncertain_rate"),
        ratio(F.sum(saved), F.sum("tokens")).alias("token_savings"),
    )


def misjudgements(rows: DataFrame, by: list[str]) -> DataFrame:
    """Predictions that are not acceptable, by key, truth, prediction and whether a critical row was dropped: n. by: the groups, as category."""
    wrong = rows.filter(~F.array_contains("acceptable", F.col("pred")))
    return wrong.groupBy(*by, "key", "truth", "pred", (F.col("critical") & (F.col("pred") == "DROP")).alias("critical_drop")).agg(F.count(F.lit(1)).alias("n"))


def majority(votes: DataFrame, by: list[str], vote: str = "pred", order: tuple = SAFETY) -> DataFrame:
    """The most frequent vote; ties go to the earliest in order."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(vote))
    counted = votes.groupBy(*by, vote).agg(F.count(F.lit(1)).alias("votes"))
    first = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("votes"), place))
    return counted.withColumn("_first", first).filter("_first = 1").drop("_first")


def nearest_rank(column: str, p: float) -> Column:
    """The value at rank ceil(p / 100 * n); NaN of nothing."""
    return F.coalesce(F.expr(f"percentile_disc({p / 100}) within group (order by {column})").cast("double"), F.lit(float("nan")))


def floor_rank(rows: DataFrame, by: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """Values at index floor(n * share) of the sorted column, counted from 0."""
    keys = by or ["_all"]
    rows = rows if by else rows.withColumn("_all", F.lit(1))
    counted = rows.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_c"))
    # distinct values with their counts: the only thing that is ordered
    upto = F.sum("_c").over(W.partitionBy(*keys).orderBy(column))
    total = F.sum("_c").over(W.partitionBy(*keys))
    ranked = counted.withColumns({"_upto": upto, "_n": total})
    at = lambda s: F.least(F.floor(F.col("_n") * s), F.col("_n") - 1)
    hit = lambda s: F.min(F.when(F.col("_upto") > at(s), F.col(column)))
    return ranked.groupBy(*keys).agg(*[hit(s).alias(name) for name, s in shares.items()]).drop("_all")


def unanimous(votes: DataFrame, by: list[str], vote: str = "pred") -> DataFrame:
    """Whether all repeats agree; a missing vote is one of its own."""
    return votes.groupBy(*by).agg((F.count_distinct(F.coalesce(F.col(vote), F.lit("\0none"))) == 1).alias("unanimous"))


def key_line_coverage(cases: DataFrame, results: DataFrame) -> DataFrame:
    """results (key, trimmed, kept_text, kept_tokens) with their case's truth, tokens, and its key lines: how many, and how many the kept text holds.

    cases: key, truth, tokens, key_lines; a result without a case is left out.
    """
    met = results.join(cases, "key")
    kept = F.size(F.filter("key_lines", lambda k: F.col("kept_text").contains(k)))
    return met.withColumns({"key_total": F.size("key_lines").cast("bigint"), "key_kept": F.when(F.col("trimmed"), kept).otherwise(0).cast("bigint")})


def write_time_summary(cases: DataFrame, results: DataFrame) -> DataFrame:
    """How often outputs that may be trimmed were, and others by mistake; key lines that survived; tokens before and after."""
    met = key_line_coverage(cases, results)
    trim, keep, trimmed = F.col("truth") == "TRIM", F.col("truth") == "KEEP", F.col("trimmed")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)
    return met.agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(trim).alias("may_trim"), F.count_if(trim & trimmed).alias("trimmed"), F.count_if(keep).alias("must_keep"), F.count_if(keep & trimmed).alias("false_trims"),
        total(F.when(trim & trimmed, F.col("key_total")), "key_lines"), total(F.when(trim & trimmed, F.col("key_kept")), "key_lines_kept"),
        total(F.col("tokens"), "tokens_before"), total(F.when(trimmed, F.col("kept_tokens")).otherwise(F.col("tokens")), "tokens_after"),
    )


def hidden_sweep(blocks: DataFrame, drops: list[float], min_share: float = 0.3) -> DataFrame:
    """Per threshold: outputs rewritten if blocks below it were hidden, hidden blocks and tokens, and the needed ones among them.

    blocks: output, tokens, p, needed. An output is rewritten if the hidden
    blocks hold min_share of its tokens at least. The thresholds are a literal array.
    """
    each = blocks.withColumn("drop", F.explode(F.array(*map(F.lit, drops))))
    hidden = F.col("p") < F.col("drop")
    per = each.groupBy("drop", "output").agg(
        F.count_if(hidden).alias("h"), F.sum(F.when(hidden, F.col("tokens")).otherwise(0)).alias("h_tokens"), F.sum("tokens").alias("all_tokens"),
        F.count_if(F.col("needed")).alias("n"), F.count_if(hidden & F.col("needed")).alias("n_hidden"),
    )
    done = (F.col("h") > 0) & (F.col("h_tokens") >= F.col("all_tokens") * min_share)
    total = lambda c, name: F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).cast("bigint").alias(name)
    return per.groupBy("drop").agg(
        F.count(F.lit(1)).alias("outputs"), F.count_if(done).alias("rewritten"), total("h", "hidden_blocks"), total("h_tokens", "hidden_tokens"),
        F.sum("n").cast("bigint").alias("needed_blocks"), total("n_hidden", "needed_hidden"), F.count_if(done & (F.col("n_hidden") > 0)).alias("bad_outputs"),
    )


def top(rows: DataFrame, by: str, n: int, key: str) -> DataFrame:
    """The n rows with the most of a column; ties go to the least key. The limit is the feature: a ranking."""
    return rows.orderBy(F.desc(by), F.col(key)).limit(n)


def markdown(frame: DataFrame, title: str, most: int = 1000) -> str:
    """A report table of a small frame; a larger one is refused."""
    rows = frame.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    lines = [frame.columns, ["---"] * len(frame.columns), *[["" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r] for r in rows]]
    return f"## {title}\n\n" + "\n".join(f"| {' | '.join(x)} |" for x in lines) + "\n"


def sweep(rows: DataFrame, grid: DataFrame, measures: dict[str, Column], by: list[str]) -> DataFrame:
    """Measures for each parameter row of grid: a small grid, sent to every task (checked to be at most 1,000 rows)."""
    if grid.limit(1001).count() > 1000:
        raise ValueError("a grid has at most 1,000 rows")
    return rows.crossJoin(F.broadcast(grid)).groupBy(*by).agg(*[c.alias(n) for n, c in measures.items()])

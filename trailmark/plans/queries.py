"""Registered queries over the driver's tables; each says which inventory rows it covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import logs, research, shell
from ..functions import text as X
from ..operators import analytics, dedupe, events, metrics, policy, recall, sieve
from ..sources import synth
from ..streaming import replay


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.sessions(spark, sf_dir).filter("kind = 'result'")


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    bash = _results(spark, sf_dir).filter("tool = 'bash'")
    return bash.select("session", "ord", F.posexplode(X.pieces(F.col("text"))).alias("i", "line")).select("session", "ord", (F.col("i") + 1).alias("n"), "line")


def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-20, 21, 22, 23."""
    t = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", X.tokens(t).alias("tokens"), X.line_count(t).cast("bigint").alias("lines"), X.size_class(X.line_count(t)).alias("size_class"), X.truncate(t, 80).alias("preview"))


def call_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-24, 25, 26."""
    r = _results(spark, sf_dir)
    return r.groupBy(X.summarize_call(F.col("tool"), F.col("args")).alias("summary"), X.related_key(F.col("tool"), F.col("args")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def line_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-28, 29, 30."""
    lines = _log_lines(spark, sf_dir).withColumn("t", X.trim(F.col("line")))
    return lines.groupBy(X.shape(F.col("t")).alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.max(X.line_priority(F.col("t"))).cast("bigint").alias("priority"), F.max(X.has(F.col("t"), X.NOTABLE)).alias("notable"))


def outcome_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-27."""
    return _results(spark, sf_dir).groupBy(X.outcome_line(F.col("text"), F.col("is_error")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def hidden_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-31."""
    return _results(spark, sf_dir).groupBy("tool", F.array_join(X.hidden_references(F.col("text")), ", ").alias("refs")).agg(F.count(F.lit(1)).alias("n"))


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-35, 39, 134."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(X.words(F.col("text"))).cast("bigint").alias("words"), F.size(X.facts(F.col("text"))).cast("bigint").alias("facts"))


def request_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-36, 37."""
    c = _table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.array_join(X.request_terms(F.col("text")), " ").alias("terms"), F.array_join(X.query_identifiers(F.col("text")), " ").alias("identifiers"))


def tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-62, 84, 85, 87, 34."""
    return events.tool_events(synth.sessions(spark, sf_dir)).select("session", "ord", "tool", "args", F.col("epoch").cast("bigint").alias("epoch"), F.col("upto").cast("bigint").alias("upto"), F.col("seq").cast("bigint").alias("seq"))


def evidence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-63, 129."""
    pairs = dedupe.evidence(dedupe.reads(synth.sessions(spark, sf_dir)))
    return pairs.select("session", "ord", "e_ord", F.col("age").cast("bigint").alias("age"), F.col("rank").cast("bigint").alias("rank"))


def matched_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-64, 86, 66."""
    found = dedupe.reads(synth.sessions(spark, sf_dir))
    runs = dedupe.chosen_runs(dedupe.matched_runs(found, dedupe.evidence(found)))
    return runs.select("session", "ord", "e_ord", *(F.col(c).cast("bigint").alias(f"run_{c}") for c in ("from", "to")))


def content_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-65."""
    found = dedupe.reads(synth.sessions(spark, sf_dir))
    runs = dedupe.content_runs(found, dedupe.evidence(found))
    return runs.select("session", "ord", F.col("rank").cast("bigint").alias("rank"), *(F.col(c).cast("bigint").alias(f"run_{c}") for c in ("from", "to", "e_from")))


def folded_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-98, 61, 138."""
    done = dedupe.plan(synth.sessions(spark, sf_dir))
    return done.select("session", "ord", F.col("folded_lines").cast("bigint").alias("folded_lines"), F.col("total_lines").cast("bigint").alias("total_lines"), "original_tokens", "kept_tokens", F.md5("text").alias("digest"))


def seen_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-104, 132: the flagship."""
    return dedupe.savings(synth.sessions(spark, sf_dir))


def reread_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-74, 75, 105."""
    return analytics.reread_census(synth.sessions(spark, sf_dir))


def session_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-47, 48, 49, 107."""
    return analytics.session_census(synth.sessions(spark, sf_dir))


def role_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-107."""
    return analytics.role_tokens(synth.sessions(spark, sf_dir))


def output_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-43, 108, 57, 41."""
    return analytics.output_profile(synth.sessions(spark, sf_dir))


def long_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-44."""
    return analytics.long_exclusions(synth.sessions(spark, sf_dir))


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-108 on documents."""
    return _table(spark, sf_dir, "documents").select("doc_id", analytics.repeated_line_tokens(F.col("text")).alias("tokens"))


def read_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-45, 76, 109."""
    return analytics.read_inventory(synth.sessions(spark, sf_dir))


def classifier_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-40, 41, 42, 81, 110."""
    return analytics.classifier_coverage(synth.sessions(spark, sf_dir))


def command_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-40, 41, 42."""
    c = X.arg(F.col("args"), "command")
    found = _results(spark, sf_dir).filter("tool = 'bash'").groupBy(c.alias("command")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("command", "n", shell.kind_of("command").alias("kind"), shell.old_kind(F.col("command")).alias("old_kind"))


def stack_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-88, 59, 89."""
    keys = ["session", "ord"]
    lines = logs.keep_reason(logs.regions(_log_lines(spark, sf_dir), keys), keys)
    return lines.groupBy("session", "ord", F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("n").cast("bigint").alias("places"))


def notable_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-90, 126."""
    found = logs.notable_lines(_log_lines(spark, sf_dir), ["session", "ord"], 16)
    return found.select("session", "ord", F.col("n").cast("bigint").alias("n"), "text", F.col("priority").cast("bigint").alias("priority"))


def key_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-91, 92: runs of lines of one kind."""
    lines = _log_lines(spark, sf_dir).withColumn("kind", F.regexp_extract(X.trim(F.col("line")), "^[A-Za-z]+", 0))
    at = W.partitionBy("session", "ord").orderBy("n")
    new = F.when(F.col("kind").eqNullSafe(F.lag("kind").over(at)), 0).otherwise(1)
    runs = lines.withColumn("new", new).withColumn("run", F.sum("new").over(at.rowsBetween(W.unboundedPreceding, 0)))
    each = runs.groupBy("session", "ord", "run", "kind").agg(F.count(F.lit(1)).alias("size"))
    return each.groupBy("kind", "size").agg(F.count(F.lit(1)).alias("runs"))


def sieve_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-57 to 60, 67, 68, 91, 94, 99, 139 to 141, 152, 153, with the formula judge."""
    done = sieve.plan(synth.sessions(spark, sf_dir))
    return done.select("session", "ord", "output_kind", F.size("blocks").alias("blocks"), F.coalesce(F.size("hidden"), F.lit(0)).alias("hidden"), F.coalesce("skip", F.lit("shortened")).alias("skip"), "original_tokens", "hidden_tokens", F.md5("out").alias("digest"))


def recall_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-69, 70, 93, 95, 127, 128: each session's read originals searched for one query."""
    r = _results(spark, sf_dir).filter("tool = 'read'")
    originals = r.select("session", F.col("call_id").alias("alias"), X.summarize_call(F.col("tool"), F.col("args")).alias("summary"), "text")
    found = recall.page(recall.hits(originals, "v100 edited compute", ("session",)), 800, 2, ("session",))
    return found.select("session", "alias", F.col("from").cast("bigint").alias("chunk_from"), F.col("score").cast("bigint").alias("score"), F.col("rank").cast("bigint").alias("rank"), F.col("used").cast("bigint").alias("used"))


def recall_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-142 over documents: the ranked chunks within the budget."""
    d = _table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("alias"), F.col("source").alias("summary"), "text")
    found = recall.page(recall.hits(d, "the nation of order"), 4000)
    return found.select("alias", "from", "to", "score", "rank", "used")


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-111."""
    return metrics.confusion(_table(spark, sf_dir, "labels"), "quality", "toxic", (0, 1), (0, 1))


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled decisions by formula: truth from the labels, predictions from the id."""
    rows = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")
    i = F.col("doc_id")
    truth = F.when(F.col("toxic") == 1, "DROP").when(F.col("quality") == 1, "KEEP").otherwise("TRUNCATE")
    pred = F.when(i % 11 == 0, "UNCERTAIN").when(i % 5 == 0, "DROP").when(i % 3 == 0, "TRUNCATE").otherwise("KEEP")
    acceptable = F.when(F.col("toxic") == 1, F.array(F.lit("DROP"))).when(i % 2 == 0, F.array(F.lit("KEEP"), F.lit("TRUNCATE"))).otherwise(F.array(F.lit("KEEP")))
    return rows.select(i.alias("doc_id"), F.col("lang").alias("category"), i.cast("string").alias("key"), truth.alias("truth"), acceptable.alias("acceptable"), (i % 4 == 0).alias("critical"), pred.alias("pred"), X.tokens(F.col("text")).alias("tokens"), F.lit(40).cast("bigint").alias("truncated_tokens"))


def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-112."""
    found = metrics.summary(eval_rows(spark, sf_dir), ["category"])
    rates = [F.round(c, 9).alias(c) for c in found.columns if c not in ("category", "n", "critical_false_drops")]
    return found.select("category", "n", *rates, F.array_join("critical_false_drops", ",").alias("critical_false_drops"))


def majority_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-113, 116."""
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.col("event_type").alias("pred"))
    order = ("click", "view", "error", "signup", "purchase")
    return metrics.majority(e, ["user"], order=order).join(metrics.unanimous(e, ["user"]), "user")


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-114."""
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(metrics.nearest_rank("value", 50).alias("p50"), metrics.nearest_rank("value", 95).alias("p95"), F.max("value").alias("top"))


def floor_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-115."""
    return metrics.floor_rank(_table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge readings by formula, one per event."""
    i = F.col("event_id")
    part = lambda m, d=100: ((i * m) % d) / float(d)
    choice = F.element_at(F.array(*map(F.lit, ("KEEP", "TRUNCATE", "DROP", "UNCERTAIN"))), (i % 4 + 1).cast("int"))
    return _table(spark, sf_dir, "events").select(
        i.alias("event_id"), "event_type", choice.alias("choice"), part(7).alias("confidence"),
        F.create_map(F.lit("KEEP"), part(13), F.lit("TRUNCATE"), part(17), F.lit("DROP"), part(29)).alias("probabilities"),
        F.create_map(F.lit("needed_now"), part(31), F.lit("user_requested"), part(37), F.lit("durable"), part(41), F.lit("unique_fact"), part(43), F.lit("superseded"), part(47), F.lit("mostly_noise"), part(53)).alias("signals"),
        (i % 3 == 0).alias("excerpted"),
    )


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-54, 143, 144, 145."""
    r = readings(spark, sf_dir).select(policy.raw().alias("raw"), policy.safe().alias("safe"), policy.composite().alias("composite"), policy.guarded().alias("guarded"))
    return r.groupBy("raw", "safe", "composite", "guarded").agg(F.count(F.lit(1)).alias("n"))


def hybrid_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-50, 51, 71, 72, 146, 147."""
    facts = policy.source_facts(events.tool_events(synth.sessions(spark, sf_dir))).withColumn("event_id", F.substring("call_id", 2, 20).cast("bigint"))
    ruled = policy.rules(events.tool_events(synth.sessions(spark, sf_dir))).select("session", "ord", "rule")
    joined = facts.join(ruled, ["session", "ord"]).join(readings(spark, sf_dir), "event_id")
    return joined.select("tool", "durable", "superseded", "exact_repeat", "rule", policy.hybrid().alias("hybrid")).groupBy("tool", "durable", "superseded", "exact_repeat", "rule", "hybrid").agg(F.count(F.lit(1)).alias("n"))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-83, 118, 119, 117."""
    grid = spark.createDataFrame([(d, c) for d in (0.5, 0.6, 0.7, 0.8, 0.9) for c in (0.5, 0.7)], "drop double, conf double")
    rows = readings(spark, sf_dir)
    hit = (F.col("choice") == "DROP") & (policy.probability("DROP") >= F.col("drop")) & (F.col("confidence") >= F.col("conf"))
    regret = hit & (policy.signal("needed_now") >= 0.5)
    return metrics.sweep(rows, grid, {"dropped": F.count_if(hit), "regret": F.count_if(regret), "mean_needed": F.round(F.avg(F.when(hit, policy.signal("needed_now"))), 6)}, ["drop", "conf"])


def regret_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-120: several cuts in one pass by grouping sets."""
    r = readings(spark, sf_dir).withColumns({"pred": policy.guarded(), "needed": policy.signal("needed_now") >= 0.5})
    r.createOrReplaceTempView("_regret_rows")
    return spark.sql("""
        SELECT event_type, choice, CAST(excerpted AS STRING) AS excerpted, count(*) AS n, count_if(pred = 'DROP' AND needed) AS regret
        FROM _regret_rows GROUP BY GROUPING SETS ((event_type), (choice), (excerpted), ())""")


def idle_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-101."""
    return events.idle_gaps(synth.sessions(spark, sf_dir)).groupBy("session").agg(F.count(F.lit(1)).alias("gaps"), F.count_if("cold").alias("cold"), F.max("gap_s").cast("bigint").alias("longest"))


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-102: at most eight requests of a session, evenly spread, the first two left out."""
    at = W.partitionBy("session").orderBy("ord")
    users = synth.sessions(spark, sf_dir).filter("kind = 'user'").withColumn("i", F.row_number().over(at) - 3).filter("i >= 0")
    step = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(W.partitionBy("session")) / 8))
    return users.withColumn("step", step).filter(F.col("i") % F.col("step") == 0).select("session", "ord")


def facts_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-39, 77, 135."""
    return analytics.facts_used(synth.sessions(spark, sf_dir))


def block_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-78."""
    return analytics.block_facts(synth.sessions(spark, sf_dir))


def sole_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-79."""
    return analytics.sole_sources(synth.sessions(spark, sf_dir))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-123 over a log made from the events."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.when(F.col("event_type") == "click", "seen").when(F.col("event_type") == "error", "sieve").when(F.col("event_type") == "view", "recall").otherwise("label")
    log = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), kind.alias("kind"), (F.col("event_id") % 2 == 0).alias("acted"), (k * 10).alias("from"), (F.col("event_id") % 400).alias("to"))
    return analytics.telemetry(log)


def would_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-125 over decisions made from the events."""
    i = F.col("event_id")
    decision = F.when(i % 3 == 0, "DROP").when(i % 3 == 1, "TRUNCATE").otherwise("KEEP")
    made = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), (i % 7).cast("string").alias("call_id"), i.alias("at"), decision.alias("decision"), (i % 400).alias("tokens"))
    return analytics.would_save(made)


def misjudgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-121."""
    return metrics.misjudgements(eval_rows(spark, sf_dir), ["category"])


def no_longer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-46."""
    return analytics.no_longer(synth.sessions(spark, sf_dir))


def changed_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-106."""
    return analytics.changed_diffs(synth.sessions(spark, sf_dir))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How later results of a key compare with earlier ones."""
    found = policy.relations(events.tool_events(synth.sessions(spark, sf_dir)))
    return found.groupBy("session", F.col("outcome").alias("relation")).agg(F.count(F.lit(1)).alias("n"))


def later_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-73."""
    found = policy.relations(events.tool_events(synth.sessions(spark, sf_dir)))
    return found.groupBy("session", "relation").agg(F.count(F.lit(1)).alias("n"))


def exact_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-17, 104, 154 to 161: replay with feedback."""
    return replay.replay(synth.sessions(spark, sf_dir)).drop("text")


def shadow_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-162: the same decisions without feedback, so those of the relational plan."""
    done = replay.replay(synth.sessions(spark, sf_dir), act=False)
    return done.select("session", "ord", F.col("folded_lines").cast("bigint").alias("folded_lines"), "original_tokens", "kept_tokens", F.md5("text").alias("digest"))


def log_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-94, 95, 96, 97, 53, 131: how outputs are cut by each rule."""
    bash = _results(spark, sf_dir).filter("tool = 'bash'")
    return bash.select("session", "ord", F.size(logs.blocks_of("text")).alias("blocks"), F.size(logs.chunks_of("text")).alias("chunks"), F.size(research.sieve_blocks_of("text", "tool")).alias("research_blocks"), F.size(research.units_of("text", "tool")["units"]).alias("units"))


def trimmed_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-100, 150, 151: what plain rules keep of long outputs."""
    bash = _results(spark, sf_dir).filter("tool = 'bash'").select("session", "ord", research.trimmed_of("text", "tool").alias("t"))
    return bash.select("session", "ord", "t.*")


def top_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-132: the five sessions that save most."""
    return metrics.top(dedupe.savings(synth.sessions(spark, sf_dir)), "saved", 5, "session")


def top_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-132: the ten tools with the most tokens."""
    return metrics.top(analytics.session_census(synth.sessions(spark, sf_dir)), "tokens", 10, "tool")


def hidden_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-118: thresholds for hiding blocks, with the needed blocks they hide; blocks by formula, five to an output."""
    i = F.col("event_id")
    blocks = _table(spark, sf_dir, "events").select(F.floor(i / 5).alias("output"), (i % 400 + 1).alias("tokens"), ((i * 37) % 100 / 100.0).alias("p"), (i % 7 == 0).alias("needed"))
    return metrics.hidden_sweep(blocks, [0.05, 0.1, 0.15, 0.2, 0.3, 0.5])


def write_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-10, 80, 82, 122: labelled documents as cases, results by formula."""
    docs = _table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")
    first = F.filter(F.slice(X.pieces(F.col("text")), 1, 3), lambda x: x != "")
    cases = docs.join(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").select(
        F.col("doc_id").alias("key"), F.when(F.col("quality") == 1, "KEEP").otherwise("TRIM").alias("truth"), X.tokens(F.col("text")).alias("tokens"), first.alias("key_lines"))
    kept = F.substring("text", 1, 400)
    results = docs.select(F.col("doc_id").alias("key"), (F.col("doc_id") % 3 != 0).alias("trimmed"), kept.alias("kept_text"), X.tokens(kept).alias("kept_tokens"))
    return metrics.write_time_summary(cases, results)


def future_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-103."""
    return analytics.future_text(synth.sessions(spark, sf_dir), 10).select("session", "ord", F.md5("future").alias("digest"))


QUERIES = {
    "inv20_text_measures": text_measures, "inv25_call_summaries": call_summaries, "inv27_outcome_lines": outcome_lines, "inv28_line_priorities": line_priorities,
    "inv31_hidden_references": hidden_references, "inv35_document_words": document_words, "inv37_request_terms": request_terms, "inv41_command_kinds": command_kinds,
    "inv62_tool_events": tool_events, "inv63_evidence_pairs": evidence_pairs, "inv64_matched_runs": matched_runs, "inv65_content_runs": content_runs, "inv73_relations": relations, "inv73_later_relations": later_relations,
    "inv88_stack_regions": stack_regions, "inv92_key_runs": key_runs, "inv101_idle_gaps": idle_gaps, "inv102_checkpoints": checkpoints,
    "inv104_seen_savings": seen_savings, "inv105_reread_census": reread_census, "inv106_changed_diffs": changed_diffs, "inv107_session_census": session_census, "inv107_role_tokens": role_tokens,
    "inv108_output_profile": output_profile, "inv108_long_exclusions": long_exclusions, "inv108_repeated_lines": repeated_lines, "inv109_read_inventory": read_inventory, "inv110_classifier_coverage": classifier_coverage,
    "inv111_confusion": confusion_matrix, "inv112_metric_summary": metric_summary, "inv113_majority_votes": majority_votes, "inv114_percentiles": percentiles, "inv115_floor_quantiles": floor_quantiles,
    "inv119_threshold_sweep": threshold_sweep, "inv120_regret_cuts": regret_cuts, "inv123_telemetry": telemetry, "inv125_would_save": would_save, "inv121_misjudgements": misjudgements, "inv46_no_longer": no_longer, "inv126_notable_lines": notable_lines, "inv127_recall_reads": recall_reads,
    "inv138_folded_reads": folded_reads, "inv140_sieve_plan": sieve_plan, "inv142_recall_documents": recall_documents, "inv144_policies": policies, "inv146_hybrid_policies": hybrid_policies, "inv77_facts_used": facts_used, "inv78_block_facts": block_facts, "inv79_sole_sources": sole_sources,
    "inv132_top_sessions": top_sessions, "inv132_top_tools": top_tools, "inv118_hidden_blocks": hidden_blocks, "inv122_write_time": write_time, "inv103_future_text": future_text,
    "inv17_exact_replay": exact_replay, "inv162_shadow_replay": shadow_replay, "inv95_log_chunks": log_chunks, "inv100_trimmed_outputs": trimmed_outputs,
}

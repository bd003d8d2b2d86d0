"""Monitor actions, repairs, plans, experiments, feedback and the human queue as state changes.

Each function takes tables and returns new ones. Of each report the first five actions count, and
the actions of all reports take effect in order of (report, pos): what one has changed the next one meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calendrix.functions.semantics import or_else
from calendrix.functions.urls import host, normal_url, shared_platform, slug
from calendrix.operators.folds import folded
from calendrix.operators.selection import first_of, top_of_each

#: Columns of an action item with what an insert puts where none is given.
ITEM_DEFAULTS = {"severity": "info", "category": "general", "action_type": "investigation"}


#: States of a stored query: not there; else (made by, switched on, boosted). "own" was there before.
QUERY_STATES = [None, *((made, on, up) for made in ("own", "event_search", "source_discovery") for on in (True, False) for up in (False, True))]


def _query_moves() -> dict[str, tuple[int, ...]]:
    """What each action makes of each state."""
    number = {s: n for n, s in enumerate(QUERY_STATES)}

    def move(change):
        return tuple(number[change(s)] for s in QUERY_STATES)

    made = lambda kind: move(lambda s: s or (kind, True, False))
    return {
        "deactivate_query": move(lambda s: s and (s[0], False, s[2])),
        "boost_query": move(lambda s: (s[0], True, True) if s and s[1] else s),
        "create_query": made("event_search"),
        "create_source_query": made("source_discovery"),
    }


def first_actions(actions: DataFrame, most: int = 5) -> DataFrame:
    """The first `most` actions(report, pos, ...) of each report."""
    return top_of_each(actions, ["report"], ["pos"], most).drop("rank")


def folded_queries(actions: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, pos, known) of the query actions, known telling whether the text was there when its turn
    came, and (query_text, state) of all texts after them."""
    start = queries.select(F.col("query_text").alias("key"), F.when(F.col("is_active"), QUERY_STATES.index(("own", True, False))).otherwise(QUERY_STATES.index(("own", False, False))).alias("state"))
    steps = actions.select(or_else(F.col("query_text")).alias("key"), F.col("type").alias("step"), "report", "pos").where(F.col("step").isin(list(_query_moves())))
    met, after = folded(steps, ["report", "pos"], _query_moves(), start, len(QUERY_STATES))
    return met.select("report", "pos", (F.col("state_before") != 0).alias("known")), after.select(F.col("key").alias("query_text"), "state")


def action_results(actions: DataFrame, known: DataFrame, skips: DataFrame) -> DataFrame:
    """(report, pos, action, detail, result) of first_actions().

    actions(report, pos, type, query_text, source_url, reason, context, title, description, action_type,
    auto_fixable, repair_id, verification_result, notes, action_item_id, detail); known(report, pos,
    known) of folded_queries(); skips(report, pos, result) of skip_results(). Query actions without a text leave nothing.
    """
    met = actions.join(known, ["report", "pos"], "left").join(skips.select("report", "pos", F.col("result").alias("_skip")), ["report", "pos"], "left")
    kind, none = F.col("type"), lambda *cols: [or_else(F.col(c)).isNull() for c in cols]
    either = lambda tests: tests[0] if len(tests) == 1 else tests[0] | tests[1]
    source_query = kind == "create_source_query"
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    or_no = lambda c, other: F.coalesce(or_else(F.col(c)), F.lit(other))
    fixable = F.coalesce("auto_fixable", F.lit(False)).cast("string")
    # The result texts.
    result = (
        F.when(kind == "deactivate_query", "Done")
        .when(kind.isin("create_source_query", "create_query") & F.col("known"), "Skipped (already exists)")
        .when(source_query, "Created (source_discovery)")
        .when(kind == "create_query", "Created (event_search)")
        .when(kind == "boost_query", "Boosted to 0.8")
        .when(kind == "flag_source", text("Flagged: ", or_no("reason", "none")))
        .when((kind == "add_source_context") & either(none("source_url", "context")), "Skipped (missing source_url or context)")
        .when(kind == "add_source_context", text('Context set: "', F.substring("context", 1, 80), '..."'))
        .when((kind == "escalate_to_human") & either(none("title", "description")), "Skipped (missing title or description)")
        .when(kind == "escalate_to_human", text("Created action item (", or_no("action_type", "investigation"), ", auto_fixable=", fixable, ")"))
        .when((kind == "skip_source") & none("source_url")[0], "Skipped (missing source_url)")
        .when(kind == "skip_source", F.col("_skip"))
        .when((kind == "verify_repair") & either(none("repair_id", "verification_result")), "Skipped (missing repair_id or verification_result)")
        .when(kind == "verify_repair", text(F.col("verification_result"), ": ", or_no("notes", "no notes")))
        .when((kind == "resolve_action_item") & none("action_item_id")[0], "Skipped (missing action_item_id)")
        .when(kind == "resolve_action_item", "Resolved")
        .otherwise("Skipped (unknown action type)")
    )
    query_kinds = kind.isin("deactivate_query", "create_source_query", "create_query", "boost_query")
    detail = F.when(query_kinds, F.col("query_text")).otherwise(F.coalesce(*[or_else(F.col(c)) for c in ("source_url", "title", "repair_id", "action_item_id", "detail")], F.lit("unknown")))
    return met.where(~(query_kinds & none("query_text")[0])).select("report", "pos", kind.alias("action"), detail.alias("detail"), result.alias("result"))


def acted_queries(queries: DataFrame, after: DataFrame) -> DataFrame:
    """queries(query_text, is_active, priority, query_type, created_by) after folded_queries(): switched
    off, boosted to .8, and created at .7 or, for sources, 1."""
    told = F.array(*[F.struct(F.lit(s[0] if s else None).cast("string").alias("made"), F.lit(bool(s and s[1])).alias("live"), F.lit(bool(s and s[2])).alias("up")) for s in QUERY_STATES])
    now = after.where("state != 0").select(F.col("query_text"), F.get(told, F.col("state")).alias("s"))
    met = now.join(queries, "query_text", "left")
    own = F.col("s.made") == "own"
    base = F.when(own, F.col("priority")).when(F.col("s.made") == "source_discovery", 1.0).otherwise(0.7)
    return met.select(
        "query_text", F.col("s.live").alias("is_active"), F.when(F.col("s.up"), 0.8).otherwise(base).alias("priority"),
        F.when(own, F.col("query_type")).otherwise(F.col("s.made")).alias("query_type"), F.when(own, F.col("created_by")).otherwise("agent").alias("created_by"),
    )


def acted_sources(sources: DataFrame, actions: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """sources(url, tier, validation_context, demoted_at) after the actions: context set, or demoted."""
    done = results.join(actions.select("report", "pos", "source_url", "context"), ["report", "pos"])
    context = first_of(done.where("result LIKE 'Context set%'"), ["source_url"], [F.desc("report"), F.desc("pos")]).select(F.col("source_url").alias("url"), F.col("context").alias("_context"))
    out = done.where("result = 'Source demoted'").select(F.col("source_url").alias("url"), F.lit(True).alias("_out")).distinct()
    met = sources.join(context, "url", "left").join(out, "url", "left")
    gone = F.coalesce("_out", F.lit(False))
    return met.withColumns(
        {"validation_context": F.coalesce("_context", "validation_context"), "tier": F.when(gone, "demoted").otherwise(F.col("tier")), "demoted_at": F.when(gone, as_of).otherwise(F.col("demoted_at"))}
    ).drop("_context", "_out")


def new_items(escalations: DataFrame, now: Column) -> DataFrame:
    """Action items of escalations(title, description, severity, category, action_type, auto_fixable, and
    suggested_fix, affected_files, monitor_report_id if there), with the defaults of what is missing."""
    filled = {c: F.coalesce(or_else(F.col(c)), F.lit(default)) for c, default in ITEM_DEFAULTS.items()}
    kinds = {"suggested_fix": "string", "affected_files": "array<string>", "monitor_report_id": "bigint"}
    carried = {c: F.lit(None).cast(kind) for c, kind in kinds.items() if c not in escalations.columns}
    return escalations.withColumns({**carried, **filled, "auto_fixable": F.coalesce("auto_fixable", F.lit(False)), "is_resolved": F.lit(False), "repair_status": F.lit("pending"), "attempt_count": F.lit(0), "created_at": now})


def parse_escalations(counters: DataFrame) -> DataFrame:
    """An action item for each source of scrape_counters() that is to be escalated, on every run."""
    return counters.where("escalate").select(
        F.concat(F.lit("Parser failing: "), F.col("source").cast("string")).alias("title"), F.concat(F.col("parse_failures").cast("string"), F.lit(" parse failures in a row")).alias("description"),
        F.lit("warning").alias("severity"), F.lit("scraper").alias("category"), F.lit("code_fix").alias("action_type"), F.lit(True).alias("auto_fixable"),
    )


def verified_repairs(items: DataFrame, repairs: DataFrame, verdicts: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """items(id, repair_status, is_resolved) and repairs(id, action_item_id, verification_result,
    verified_at) after verdicts(repair_id, result, pos) in order of pos: the last one on a repair stays
    with it, the last one on an item's repairs sets the item's status, verified or else failed, and one that is
    verified resolves the item for good."""
    said = verdicts.groupBy(F.col("repair_id").alias("id")).agg(F.max_by("result", "pos").alias("_said"))
    judged = repairs.join(said, "id", "left")
    judged = judged.withColumns({"verification_result": F.coalesce("_said", "verification_result"), "verified_at": F.when(F.col("_said").isNotNull(), as_of).otherwise(F.col("verified_at"))})
    good = F.col("result") == "verified"
    owners = repairs.where("action_item_id IS NOT NULL").select(F.col("id").alias("repair_id"), F.col("action_item_id").alias("id"))
    hit = verdicts.join(owners, "repair_id").groupBy("id").agg(F.max_by(good, "pos").alias("_last"), F.bool_or(good).alias("_ever"))
    met = items.join(hit, "id", "left")
    status = F.when(F.col("_last"), "verified").when(~F.col("_last"), "failed").otherwise(F.col("repair_status"))
    return met.withColumns({"repair_status": status, "is_resolved": F.col("is_resolved") | F.coalesce("_ever", F.lit(False))}).drop("_last", "_ever"), judged.drop("_said")


def open_queue(items: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Items that may be repaired: open, neither proposed nor rolled back, and not failed of late."""
    cool = F.col("last_failure_at").isNull() | (F.col("last_failure_at") < as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))
    return items.where(~F.col("is_resolved") & ~F.col("repair_status").isin("proposed", "rolled_back") & cool)


def proposed_queue(items: DataFrame, most: int = 5) -> DataFrame:
    """The newest open proposals for a human to see."""
    return items.where("NOT is_resolved AND repair_status = 'proposed'").orderBy(F.desc("proposed_at"), "id").limit(most)


def unverified(repairs: DataFrame) -> DataFrame:
    return repairs.where("verification_result IS NULL")


def repaired_items(items: DataFrame, repairs: DataFrame) -> DataFrame:
    """Each item with how many repairs it had, and how many of them were verified."""
    counts = repairs.groupBy(F.col("action_item_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("verification_result") == "verified").alias("_good"))
    met = items.join(counts, "id", "left")
    return met.withColumns({"repairs": F.coalesce("_n", F.lit(0)), "verified": F.coalesce("_good", F.lit(0))}).drop("_n", "_good")


def completed_plan(plans: DataFrame, plan_id: str, runs: DataFrame, as_of: Column) -> DataFrame:
    """plans(id, status, execution_summary, completed_at), a pending one of which ends with the
    counts of runs(plan_id, events, errors)."""
    sums = runs.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"), F.sum("events").alias("events"), F.sum("errors").alias("errors"))
    said = sums.select(F.col("plan_id").alias("id"), F.concat_ws(", ", F.concat(F.col("n"), F.lit(" sources")), F.concat(F.col("events"), F.lit(" events")), F.concat(F.col("errors"), F.lit(" errors"))).alias("_said"))
    met = plans.join(said, "id", "left")
    now = (F.col("status") == "pending") & F.col("_said").isNotNull() & ((F.lit(plan_id) == "*") | (F.col("id").cast("string") == plan_id))
    return met.withColumns({"status": F.when(now, "completed").otherwise(F.col("status")), "execution_summary": F.when(now, F.col("_said")).otherwise(F.col("execution_summary")), "completed_at": F.when(now, as_of).otherwise(F.col("completed_at"))}).drop("_said")


def due_experiments(experiments: DataFrame, as_of: Column, most: int = 20) -> DataFrame:
    """The oldest pending experiments whose time has come."""
    return experiments.where((F.col("status") == "pending") & (F.col("evaluate_after") <= as_of)).orderBy("evaluate_after", "id").limit(most)


def evaluated(experiments: DataFrame, verdicts: DataFrame, as_of: Column) -> DataFrame:
    """experiments(id, status, outcome_match, confidence_delta, evaluated_at) after verdicts(id, hit, delta)."""
    met = experiments.join(verdicts.select("id", "hit", F.col("delta").alias("_delta"), F.lit(True).alias("_done")), "id", "left")
    done = F.coalesce("_done", F.lit(False)) & (F.col("status") == "pending")
    return met.withColumns(
        {"outcome_match": F.when(done, F.col("hit")).otherwise(F.col("outcome_match")), "confidence_delta": F.when(done, F.col("_delta")).otherwise(F.col("confidence_delta")), "evaluated_at": F.when(done, as_of).otherwise(F.col("evaluated_at")), "status": F.when(done, "evaluated").otherwise(F.col("status"))}
    ).drop("hit", "_delta", "_done")


def hypotheses(probes: DataFrame, as_of: Column, runs: int = 3, days: int = 3) -> DataFrame:
    """Experiments on probes(name, url, events, scraper) that found events."""
    n = F.col("events").cast("string")
    said = F.concat(n, F.lit("+ events per scrape, parser: "), F.col("scraper"))
    return probes.where("events > 0").select(
        F.lit("scout").alias("agent"), F.concat(F.lit('Source "'), F.col("name"), F.lit('" ('), F.col("url"), F.lit(") will produce "), n, F.lit("+ events per scrape")).alias("hypothesis"),
        said.alias("prediction"), F.lit(runs).alias("evaluation_window_runs"), (as_of + F.make_dt_interval(F.lit(days))).alias("evaluate_after"), F.lit("pending").alias("status"),
    )


def known_urls(sources: DataFrame, config: DataFrame) -> DataFrame:
    """(normal): the set of URLs that count as known. On shared platforms a config source stands for
    all below its first path segment too."""
    base = config.where(shared_platform(F.col("url"))).select(F.concat_ws("/", host(F.col("url")), slug(F.col("url"))).alias("normal")).where("normal LIKE '%/%'")
    own = lambda df: df.select(normal_url(F.col("url")).alias("normal"))
    return own(sources).union(own(config)).union(base).distinct()


#: Length of the pieces that submissions and events meet on; shorter submissions are pieces as they are.
PIECE = 8


def found_events(asked: DataFrame, events: DataFrame, title_chars: int = 30) -> DataFrame:
    """asked(id, url, title) with found_id: the least id of events(id, url, title) whose URL holds the
    asked one (normalised) or whose title holds the first characters of the asked title, in any case.

    A text of PIECE characters or more is looked for by its rarest piece among those of the events' texts, and a shorter
    one is a piece as a whole. Equal texts, of submissions and of events, are one, so that neither a
    common piece nor a common text makes pairs.
    """
    both = lambda url, title: F.explode(F.array(F.struct(F.lit("url").alias("kind"), url.alias("text")), F.struct(F.lit("title").alias("kind"), title.alias("text"))))
    needles = asked.select(F.col("id").alias("asked_id"), both(normal_url(F.col("url")), F.lower(F.substring("title", 1, title_chars))).alias("x")).select("asked_id", "x.*").where("text <> ''")
    texts = events.select(F.col("id").alias("event_id"), both(F.lower("url"), F.lower("title")).alias("x")).where("event_id IS NOT NULL AND x.text <> ''")
    # One event stands for all of one text: the least id. What is asked often is looked for once.
    bodies = texts.groupBy("x.kind", F.col("x.text").alias("body")).agg(F.min("event_id").alias("event_id"))
    wanted = needles.select("kind", "text").distinct()
    cuts = lambda text, n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(F.col(text), i, F.lit(n)))
    pieces = lambda df, text: df.where(F.length(text) >= PIECE).withColumn("piece", F.explode(F.array_distinct(F.transform(cuts(text, PIECE), lambda p: F.xxhash64(p)))))
    held = pieces(bodies, "body").select("kind", "piece", "event_id")
    asked_pieces = pieces(wanted, "text").join(held.groupBy("kind", "piece").agg(F.count(F.lit(1)).alias("df")), ["kind", "piece"], "left")
    rarest = asked_pieces.groupBy("kind", "text").agg(F.min(F.struct("df", "piece")).alias("r"), F.count_if(F.col("df").isNull()).alias("absent")).where("absent = 0")
    met = rarest.select("kind", "text", F.col("r.piece").alias("piece")).join(held, ["kind", "piece"])
    met = met.join(bodies, ["kind", "event_id"]).where(F.contains("body", F.col("text"))).select("kind", "text", "event_id")
    short = wanted.where(F.length("text") < PIECE)
    lengths = [r.n for r in short.select(F.length("text").alias("n")).distinct().collect()]  # below PIECE
    for n in lengths:
        own = bodies.where(F.length("body") >= n).select("kind", "event_id", F.explode(F.array_distinct(cuts("body", n))).alias("text"))
        met = met.unionByName(own.join(short.where(F.length("text") == n), ["kind", "text"]))
    hits = needles.join(met.groupBy("kind", "text").agg(F.min("event_id").alias("event_id")), ["kind", "text"])
    best = hits.groupBy(F.col("asked_id").alias("id")).agg(F.min("event_id").alias("found_id"))
    return asked.join(best, "id", "left")


def completed_feedback(feedback: DataFrame, analyses: DataFrame, as_of: Column) -> DataFrame:
    """feedback(id) with what analyses(id, source_known, found_id, likely_reason, actions) say of it;
    those without an analysis stay open."""
    met = feedback.join(analyses, "id", "left")
    done = F.col("source_known").isNotNull()
    found = F.col("found_id").isNotNull()
    return met.select(*feedback.columns, "source_known", F.when(done, found).alias("was_found"), F.when(done, found).alias("was_rejected"), F.col("likely_reason").alias("rejection_reason"), F.coalesce("actions", F.array().cast("array<string>")).alias("actions_taken"), done.alias("analysis_complete"), F.when(done, as_of).alias("analyzed_at"))


def first_success(times_found: Column, last_run: Column, last_success: Column) -> Column:
    """last_success of a query when the column was introduced: its last run, if it ever found anything."""
    return F.when(times_found > 0, last_run).otherwise(last_success)

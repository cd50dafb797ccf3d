"""Named queries: each reads the given tables and returns a DataFrame."""

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from . import bindings as b
from .functions import dates, numeric, terms, text, urls
from .operators import admission, clusters, gate, priority

QDAY, ETIME = b.AS_OF_QUESTIONS, b.AS_OF_EVENTS
FILE_ROWS = 25_000  # rows of a landed file, about


def gate_flags(spark: SparkSession, sf: str) -> DataFrame:
    return gate.gate(b.view(spark, sf, "questions"), QDAY)


def gate_summary(spark, sf):
    return gate.top_flags(gate_flags(spark, sf))


def salvage_flags(spark, sf):
    return gate_flags(spark, sf).select("question_id", gate.is_salvageable("flags").alias("salvageable"))


def drafts(spark, sf):
    events = b.view(spark, sf, "extracted").select(
        F.col("id").alias("extracted_event_id"), "event_type", "candidate_deadlines"
    )
    return b.view(spark, sf, "questions").join(events, "extracted_event_id")


def admission_errors(spark, sf):
    return admission.admit(drafts(spark, sf), QDAY).select("question_id", "error", "deadline", "category", "options")


def deadline_parse(spark, sf):
    return (
        b.view(spark, sf, "questions").select("question_id", dates.parse_deadline("deadline").alias("due"))
        .select("question_id", "due", dates.days_until("due", QDAY).alias("days_left"), dates.format_date("due").alias("shown"))
    )


def deadline_repair(spark, sf):
    return drafts(spark, sf).select(
        "question_id", dates.repair_deadline("deadline", "candidate_deadlines", QDAY).alias("deadline")
    )


# ---- scoring --------------------------------------------------------------------------
def scoring_rows(spark, sf):
    """Valid, unscored questions with their cluster's features."""
    from .plans import stages

    return stages.scoring_input(
        b.view(spark, sf, "questions"), b.view(spark, sf, "extracted"), b.view(spark, sf, "clusters"),
        b.view(spark, sf, "validation"),
    )


def question_texts(spark, sf):
    return b.view(spark, sf, "questions").select("question_id", "question_text")


def scored_all(spark, sf):
    from .operators import scoring

    return scoring.score(scoring_rows(spark, sf), question_texts(spark, sf), QDAY)


def novelty(spark, sf):
    from .operators import scoring

    return scoring.novelty(question_texts(spark, sf))


def max_similarity(spark, sf):
    from .operators import scoring

    found = scoring.earlier_similarity(question_texts(spark, sf))
    return found.select("question_id", F.round("max_similarity", 6).alias("max_similarity"))


def near_duplicate_theme(spark, sf):
    from .operators import scoring

    return scoring.theme_repeats(question_texts(spark, sf))


def scored_rank(spark, sf):
    from .operators import scoring

    cols = ["question_id", "rank", "quality_flags", "explanation"] + [
        F.round(c, 6).alias(c) for c in scoring.COMPONENTS + ["penalty_total", "total_score"]
    ]
    return scored_all(spark, sf).select(*cols)


def scored_rank_sparse(spark, sf):
    """The same scores where the stored texts lack the batch and rows without flags have none at all."""
    from .operators import scoring

    rows = scoring_rows(spark, sf)
    rows = rows.withColumn("validation_flags", F.when(F.size("validation_flags") > 0, F.col("validation_flags")))
    stored = question_texts(spark, sf).join(rows, "question_id", "left_anti")
    cols = ["question_id", "rank", "quality_flags", "explanation"] + [
        F.round(c, 6).alias(c) for c in scoring.COMPONENTS + ["penalty_total", "total_score"]
    ]
    return scoring.score(rows, stored, QDAY).select(*cols)


def top_questions(spark, sf):
    from .operators import scoring

    top = scoring.top_rows(scored_all(spark, sf))
    return top.select(
        "rank", "question_text", F.round("total_score", 6).alias("total_score"), "category", "deadline",
        "resolution_source", "explanation",
        *[F.round(F.col(f"score_breakdown.{c}"), 6).alias(c) for c in scoring.COMPONENTS],
        F.col("score_breakdown.quality_flags").alias("quality_flags"),
    )


def soft_flags(spark, sf):
    from .operators import scoring

    return scoring.prepare(scoring_rows(spark, sf), QDAY).select("question_id", "quality_flags")


# ---- clusters and priorities -------------------------------------------------------------
def event_members(spark, sf):
    """Events as cluster members: user as cluster, event type as source."""
    role = F.when(F.col("event_type") == "click", "discovery").when(F.col("event_type") == "purchase", "resolution").otherwise("attention")
    return b.table(spark, sf, "events").select(
        F.col("user_id").alias("cluster_id"), F.col("event_type").alias("source"), role.alias("signal_role"),
        F.col("ts").alias("timestamp"),
    )


def cluster_features(spark, sf):
    out = clusters.cluster_features(event_members(spark, sf), ETIME)
    entries = F.array_sort(F.map_entries("source_role_mix"))
    mix = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.withColumn("source_role_mix", mix)


def labelled_vectors(spark, sf):
    return b.table(spark, sf, "embeddings").select(F.col("label").alias("cluster_id"), "embedding")


def cluster_coherence(spark, sf):
    return clusters.coherence(labelled_vectors(spark, sf)).withColumn("coherence_score", F.round("coherence_score", 5))


def cluster_priority_topk(spark, sf):
    members = b.view(spark, sf, "labelled_members")
    ranked = priority.cluster_priorities(members, ETIME, clusters.coherence(labelled_vectors(spark, sf)))
    return priority.extraction_queue(ranked).withColumn("coherence_score", F.round("coherence_score", 4)).select(
        "cluster_id", "size", "mention_velocity", "source_diversity", "recency", "weighted_mention_velocity",
        "coherence_score", "priority_topic", "priority_score",
    )


def priority_tiered(spark, sf):
    return priority.cluster_priorities_tiered(b.view(spark, sf, "labelled_members"), ETIME).select(
        "cluster_id", "priority_score"
    )


def generation_input(spark, sf):
    """Suitable extracted events with their cluster's features and priority."""
    events = b.view(spark, sf, "extracted").where("tradability = 'suitable'").join(b.view(spark, sf, "clusters"), "cluster_id")
    bridge = b.view(spark, sf, "cluster_events").join(
        b.view(spark, sf, "articles").select(F.col("id").alias("event_id"), "source"), "event_id"
    )
    return priority.event_priorities(events, priority.source_flags(bridge))


def event_priority_sparse(spark, sf):
    """Priorities of events of which some have no confidence and no cluster features: missing numbers count as 0."""
    gone = lambda c, cond: F.when(~F.expr(cond), F.col(c)).alias(c)
    events = b.view(spark, sf, "extracted").where("tradability = 'suitable'").withColumn("confidence", gone("confidence", "id % 4 = 0"))
    features = b.view(spark, sf, "clusters")
    for c in ("weighted_mention_velocity", "source_diversity", "coherence_score"):
        features = features.withColumn(c, gone(c, "cluster_id % 3 = 0"))
    bridge = b.view(spark, sf, "cluster_events").join(
        b.view(spark, sf, "articles").select(F.col("id").alias("event_id"), "source"), "event_id"
    )
    queue = priority.event_priorities(events.join(features, "cluster_id"), priority.source_flags(bridge))
    return queue.select("id", "priority_topic", "priority_score")


def event_priority_queue(spark, sf):
    return generation_input(spark, sf).select("id", "priority_topic", "priority_score")


def event_priority_tiered(spark, sf):
    events = b.view(spark, sf, "extracted").join(b.view(spark, sf, "clusters"), "cluster_id")
    return priority.event_priorities_tiered(events).select("id", "priority_score")


# ---- pending work -------------------------------------------------------------------------
def pending_anti(spark, sf):
    """Questions that have no score yet."""
    from .operators.pending import without_match

    return without_match(question_texts(spark, sf), b.view(spark, sf, "scored"), "question_id", "question_id")


def pending_not_in(spark, sf):
    """Clusters not extracted yet, null-aware: the articles' ids over the number of customers against customers' clusters."""
    from .operators.pending import not_in

    customers = b.table(spark, sf, "customer").agg(F.count("*").alias("n"))
    ids = b.table(spark, sf, "documents").join(F.broadcast(customers)).select((F.col("doc_id") % F.col("n")).alias("cluster_id")).distinct()
    return not_in(ids, b.view(spark, sf, "extracted"), "cluster_id", "cluster_id")


def pending_not_in_null(spark, sf):
    """The same against a column with nulls: no row is left."""
    from .operators.pending import not_in

    return not_in(question_texts(spark, sf), b.view(spark, sf, "questions"), "question_id", "repair_parent_question_id")


def pending_generation(spark, sf):
    """Suitable events without a question among those of every third order."""
    from .plans import stages

    asked = b.view(spark, sf, "questions").where("question_id % 3 = 0")
    return stages.generation_pending(b.view(spark, sf, "extracted"), asked).select("id", "cluster_id")


def pending_validation(spark, sf):
    from .plans import stages

    done = b.view(spark, sf, "validation").where("question_id % 5 <> 0")
    return stages.validation_pending(question_texts(spark, sf), done)


def pending_scoring(spark, sf):
    from .plans import stages

    done = b.view(spark, sf, "scored").where("question_id % 4 = 1")
    views = [b.view(spark, sf, v) for v in ("questions", "extracted", "clusters", "validation")]
    return stages.scoring_input(*views, scored=done).select("question_id", "cluster_id", "mention_velocity", "clarity_score")


def _second_pass(spark, sf):
    from .plans import stages

    queue = b.view(spark, sf, "validation").where("NOT is_valid").withColumnRenamed("flags", "validation_flags")
    responses = b.view(spark, sf, "questions").where("repair_parent_question_id IS NOT NULL")
    return queue, stages.second_pass(queue, responses, QDAY)


def repair_second_pass(spark, sf):
    """Questions that name a parent, as answers to the failed ones: gated again, with their parent."""
    return _second_pass(spark, sf)[1].select("question_id", "repair_parent_question_id", "is_valid", "flags")


def repair_open(spark, sf):
    """Failed questions that may be repaired and have no repair yet."""
    from .plans import stages

    queue = b.view(spark, sf, "validation").where("NOT is_valid").withColumnRenamed("flags", "validation_flags")
    stored = b.view(spark, sf, "questions").where("repair_parent_question_id IS NOT NULL")
    return stages.repair_open(queue, stored).select("question_id")


def days_levels(spark, sf):
    """How near each question's deadline is, as shown and as a level."""
    due = b.view(spark, sf, "questions").select("question_id", dates.days_until(dates.parse_deadline("deadline"), QDAY).alias("days_left"))
    return due.select("question_id", "days_left", numeric.days_bucket("days_left").alias("shown"), numeric.days_level("days_left").alias("level"))


def run_states(spark, sf):
    """Current state of each run, from its own entries."""
    from .plans import runlog

    runs = run_log(spark, sf).where("stage_number = 1").select("run_id", "status", "error_message", "at", "seq")
    return runlog.fold_runs(runs)


def latest_run(spark, sf):
    from .plans import runlog

    return runlog.latest_run(run_states(spark, sf))


def active_run(spark, sf):
    from .plans import runlog

    return runlog.active_run(run_states(spark, sf))


def repair_counts(spark, sf):
    from .plans import stages

    return stages.second_pass_counts(*_second_pass(spark, sf))


def suitability_counts(spark, sf):
    from .plans import stages

    return stages.suitability_counts(b.view(spark, sf, "extracted"))


def stage_summaries(spark, sf):
    from .plans import stages

    return stages.stage_summaries(*[b.view(spark, sf, v) for v in ("articles", "clusters", "extracted", "questions", "validation", "scored")])


# ---- dashboards ---------------------------------------------------------------------------
def review_rows(spark, sf, with_validation=False):
    from .plans import dashboard

    return dashboard.review_queue(
        b.view(spark, sf, "scored"), b.view(spark, sf, "questions"), b.view(spark, sf, "review"), QDAY,
        b.view(spark, sf, "validation") if with_validation else None,
    )


def dashboard_queue(spark, sf):
    from .plans import dashboard

    return dashboard.display_ranks(review_rows(spark, sf)).select(
        "question_id", "question_text", "category", "total_score", "deadline", "review_status", "effective_status", "rank"
    )


def filtered_queue(spark, sf):
    from .plans import dashboard

    rows = dashboard.filter_review(
        review_rows(spark, sf).where("effective_status = 'active'"), "price",
        ["finance", "politics", "other"], "Binary", 40, "Deadline (Soonest)",
    )
    return rows.select("question_id", "question_text", "category", "total_score", "deadline")


def status_stats(spark, sf):
    from .plans import dashboard

    return dashboard.status_stats(review_rows(spark, sf)).withColumn("avg_score", F.round("avg_score", 6)).withColumn("max_score", F.round("max_score", 6))


def repair_rows(spark, sf):
    from .plans import dashboard

    return dashboard.repair_queue(*[b.view(spark, sf, v) for v in ("questions", "validation", "extracted", "clusters")])


def repair_queue(spark, sf):
    from .plans import dashboard

    return dashboard.repair_ranks(repair_rows(spark, sf)).select(
        "question_id", "rank", "validation_flags", "extraction_confidence", "weighted_mention_velocity"
    )


def repair_children(spark, sf):
    return repair_rows(spark, sf).select("question_id", "has_repair_child")


def review_changes(spark, sf):
    kind = F.col("event_type")
    return b.table(spark, sf, "events").select(
        F.col("user_id").alias("question_id"),
        F.when(kind == "click", "selected").when(kind == "error", "removed").otherwise("active").alias("status"),
        F.col("props").alias("reason"), F.col("event_id").cast("string").alias("notes"), F.col("ts").cast("timestamp_ntz").alias("changed_at"),
    )


def review_latest(spark, sf):
    """Latest decision per user from the event stream read as a change log."""
    from .plans import dashboard

    return dashboard.latest_review(review_changes(spark, sf))


def run_log(spark, sf):
    kind = F.col("event_type")
    return b.table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), (F.col("event_id") % 6 + 1).cast("int").alias("stage_number"),
        F.concat(F.lit("FR"), (F.col("event_id") % 6 + 1).cast("string")).alias("stage_name"),
        F.when(kind == "click", "completed").when(kind == "error", "failed").when(kind == "view", "running").otherwise("pending").alias("status"),
        F.create_map(
            F.lit("clusters_processed"), F.get_json_object("props", "$.k"), F.lit("pending_clusters"), F.lit("100")
        ).alias("summary"),
        F.lit("").alias("error_message"), F.col("ts").alias("at"), F.col("event_id").alias("seq"),
    )


def run_stages(spark, sf):
    from .plans import runlog

    return runlog.fold_stages(run_log(spark, sf)).withColumn("progress", runlog.stage_progress()).drop("summary", "error_message")


def run_progress(spark, sf):
    from .plans import runlog

    return runlog.run_progress(runlog.fold_stages(run_log(spark, sf))).withColumn("progress", F.round("progress", 6))


# ---- discovery ----------------------------------------------------------------------------
def market_rows(spark, sf):
    from .plans import discovery

    tracked = b.view(spark, sf, "review").where("status = 'selected'")
    return discovery.markets(review_rows(spark, sf, True), QDAY, tracked)


def discovery_markets(spark, sf):
    return market_rows(spark, sf).drop("score_breakdown", "resolution_criteria", "resolution_source", "rationale", "created_at")


def discovery_filter(spark, sf):
    from .plans import discovery

    rows = discovery.filter_markets(market_rows(spark, sf), "priority 1", "World News", "All", "Binary", 0.3, "Active")
    return rows.orderBy(*discovery.market_order("Ending Soon")).select("id", "question", "total_score", "status")


def discovery_top(how):
    def run(spark, sf):
        from .plans import discovery

        return market_rows(spark, sf).orderBy(*discovery.market_order(how)).limit(20).select("id", "total_score", "days_left", "status")

    return run


def topics(spark, sf):
    from .plans import discovery

    return discovery.topic_rollup(*[b.view(spark, sf, v) for v in ("extracted", "cluster_events", "articles", "questions", "scored")])


def topic_rollup(spark, sf):
    return topics(spark, sf).withColumn("avg_candidate_score", F.round("avg_candidate_score", 6))


def trend_topk(spark, sf):
    from .plans import discovery

    scored = topics(spark, sf).withColumn("trend_score", discovery.trend_score(ETIME))
    return discovery.top_topics(scored).select("id", "title", "category", "event_count", "trend_score")


def topic_notes(spark, sf):
    from .plans import discovery

    cols = ["id", "focus_sentence", "what_is_uncertain", "watching_points", "key_dates", "data_sources", "adjacent_topics"]
    return discovery.enrich_topics(topics(spark, sf)).select(*cols)


def summary_metrics(spark, sf):
    from .plans import discovery

    return discovery.summary_metrics(market_rows(spark, sf), topics(spark, sf), QDAY)


def category_counts(spark, sf):
    from .plans import discovery

    return discovery.category_counts(market_rows(spark, sf))


discovery_newest = discovery_top("Newest")
discovery_ending = discovery_top("Ending Soon")
discovery_emerging = discovery_top("Emerging")
discovery_highest = discovery_top("Highest Score")


# ---- vectors ---------------------------------------------------------------------------
VECTOR_THRESHOLD, VECTOR_EPS = 0.40, 0.65


def vector_rows(spark, sf):
    return b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), "embedding")


def vector_dedupe(spark, sf):
    from .operators import vectors

    return vectors.dedupe_vectors(vector_rows(spark, sf), VECTOR_THRESHOLD).select(F.col("pos").alias("vec_id"))


def vector_dedupe_strict(spark, sf):
    """The default threshold, which keeps every vector of this data."""
    from .operators import vectors

    return vectors.dedupe_vectors(vector_rows(spark, sf)).select(F.col("pos").alias("vec_id"))


def vector_dedupe_blocks(spark, sf):
    """The same rows where a block holds 64 vectors, so that many cells and visits take part."""
    from .operators import vectors

    return vectors.dedupe_vectors(vector_rows(spark, sf), VECTOR_THRESHOLD, block=64).select(F.col("pos").alias("vec_id"))


def dbscan_blocks(spark, sf):
    from .operators import vectors

    return vectors.dbscan(vector_rows(spark, sf), VECTOR_EPS, block=64).withColumnRenamed("pos", "vec_id")


def dbscan(spark, sf):
    from .operators import vectors

    return vectors.dbscan(vector_rows(spark, sf), VECTOR_EPS).withColumnRenamed("pos", "vec_id")


def dbscan_features(spark, sf):
    """Density clusters, then the features of each cluster with its coherence."""
    from .operators import vectors
    from .operators.durable import written

    labels = written(vectors.dbscan(vector_rows(spark, sf), VECTOR_EPS))
    joined = labels.select("pos", F.col("label").alias("cluster_id"))
    members = joined.join(b.view(spark, sf, "articles").withColumnRenamed("id", "pos"), "pos")
    vecs = joined.join(vector_rows(spark, sf), "pos")
    return clusters.cluster_features(members, ETIME, vecs).drop("source_role_mix")


# ---- stories ---------------------------------------------------------------------------
def story_dedupe(spark, sf):
    from .operators import stories

    return stories.dedupe_stories(generation_input(spark, sf), priority.generation_order()).select("id", "priority_score")


def question_dedupe(spark, sf):
    """Near-duplicates within one event."""
    from .operators import stories

    return stories.dedupe_questions(b.view(spark, sf, "questions")).select("question_id", "extracted_event_id")


def capped_story_dedupe(spark, sf):
    """Questions accepted over all stories, at most two each."""
    from .operators import stories

    return stories.accept_questions(b.view(spark, sf, "questions")).select("question_id", "extracted_event_id")


def token_fingerprint(spark, sf):
    from .operators import stories

    return stories.token_fingerprint(b.table(spark, sf, "documents"), "doc_id", F.col("text"))


# ---- feeds -----------------------------------------------------------------------------
FEED_TIME = "2024-02-01 00:00:00"
FEED_ORDER = ["rss", "gdelt", "reddit", "hackernews", "wikipedia", "federal_register", "congress", "sec_edgar", "bls", "fred",
              "eia", "polymarket", "kalshi"]


def raw_payloads(spark, sf):
    """Every document landed as the payload of one of the 13 feeds (by id): whole text inside, but for the four feeds of figures
    (Wikipedia views, BLS, FRED, EIA), whose items have no field that an adapter takes a text from."""
    d = b.table(spark, sf, "documents").select("doc_id", F.trim(F.regexp_replace("text", r"[\s\p{Cntrl}]+", " ")).alias("text"), "source")
    k, sid = F.col("doc_id"), F.col("doc_id").cast("string")
    title = F.concat(F.lit("Item "), sid)
    iso = F.date_format(F.timestamp_seconds(k * 60 + 1704067200), "yyyy-MM-dd'T'HH:mm:ss")
    day = F.substring(iso, 1, 10)
    esc = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    js, st, arr = F.to_json, F.struct, F.array
    n = lambda c, name: c.alias(name)
    body = [
        F.concat(F.lit("<rss version=\"2.0\"><channel><title>Wire "), F.col("source"), F.lit(" - Top</title><item><title>"), title,
                 F.lit("</title><description>"), esc, F.lit("</description><link>https://wire.example.com/"), sid, F.lit("</link><pubDate>"),
                 F.date_format(F.timestamp_seconds(k * 60 + 1704067200), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item></channel></rss>")),
        js(st(n(arr(st(n(F.col("text"), "title"), n(F.concat(F.lit("https://n.example.com/"), sid), "url"), n(F.col("source"), "domain"),
                       n(F.date_format(F.timestamp_seconds(k * 60 + 1704067200), "yyyyMMdd'T'HHmmss'Z'"), "seendate"))), "articles"))),
        js(st(n(st(n(arr(st(n(st(n(title, "title"), n(F.col("text"), "selftext"), n(F.concat(F.lit("/r/x/"), sid), "permalink"),
                                   n((k * 60 + 1704067200).cast("double"), "created_utc")), "data"))), "children")), "data"))),
        js(st(n(F.when(k % 2 == 0, "story").otherwise("job"), "type"), n(F.col("text"), "title"), n(F.lit(""), "url"), n(k * 60 + 1704067200, "time"))),
        js(st(n(arr(st(n(arr(st(n(F.concat(F.lit("Page_"), sid), "article"), n(k * 37 % 50000, "views"))), "articles"))), "items"))),
        js(st(n(arr(st(n(title, "title"), n(F.col("text"), "abstract"), n(day, "publication_date"), n(F.lit("Rule"), "type"),
                       n(arr(st(n(F.lit("EPA"), "name")), st(n(F.lit(""), "name")), st(n(F.lit("SEC"), "name"))), "agencies"), n(F.lit("https://fr.example.com"), "html_url"))), "results"))),
        js(st(n(arr(st(n(title, "title"), n(F.lit("HR"), "type"), n(sid, "number"), n(F.lit(118), "congress"), n(F.lit("https://bill.example.com"), "url"),
                       n(st(n(F.col("text"), "text"), n(day, "actionDate")), "latestAction"))), "bills"))),
        F.concat(F.lit("<feed xmlns=\"http://www.w3.org/2005/Atom\"><title>Filings</title><entry><title>"), title, F.lit("</title><summary>"), esc,
                 F.lit("</summary><link href=\"https://sec.example.com/"), sid, F.lit("\"/><updated>"), iso, F.lit("-05:00</updated></entry></feed>")),
        js(st(n(st(n(arr(st(n(F.lit("LNS14000000"), "seriesID"), n(arr(st(n(sid, "value"), n(F.lit("2024"), "year"), n(F.lit("May"), "periodName"))), "data"))), "series")), "Results"))),
        js(st(n(arr(st(n(sid, "value"), n(day, "date"))), "observations"))),
        js(st(n(st(n(arr(st(n(sid, "value"), n(day, "period"))), "data")), "response"))),
        js(arr(st(n(F.col("text"), "question"), n(F.lit(""), "description"), n(F.concat(iso, F.lit("Z")), "endDate"), n(sid, "slug")))),
        F.when(k % 3 == 0, "{broken").otherwise(
            js(st(n(arr(st(n(title, "title"), n(F.col("text"), "subtitle"), n(F.lit("Politics"), "category"), n(sid, "ticker"), n(F.concat(iso, F.lit("Z")), "close_time"))), "markets")))),
    ]
    feed, payload = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for i, (name, p) in enumerate(zip(FEED_ORDER, body)):
        feed, payload = feed.when(k % 13 == i, name), payload.when(k % 13 == i, p)
    hint = F.when(feed == "fred", "UNRATE").when(feed == "eia", "OTHER").when(feed == "sec_edgar", "8-K")
    return d.select(feed.alias("source"), F.lit(FEED_TIME).cast("timestamp").alias("received_at"), payload.alias("payload"), hint.alias("hint"))


def feed_events(spark, sf):
    from .sources.adapters import fan_in

    return fan_in(raw_payloads(spark, sf))


def feed_counts(spark, sf):
    from .sources.adapters import feed_counts as counts

    return counts(raw_payloads(spark, sf))


def exact_dedupe(spark, sf):
    """First document per content hash."""
    from .sources.sinks import new_events

    docs = b.table(spark, sf, "documents").select("doc_id", "source", text.content_hash("text").alias("content_hash"))
    return new_events(docs, order=["doc_id"])


def ingest_counts(spark, sf):
    """Documents fetched, new and deduplicated per source."""
    from .sources.sinks import ingest_counts as counts

    docs = b.table(spark, sf, "documents").select(
        "doc_id", "source", text.content_hash("text").alias("content_hash"), F.col("doc_id").alias("timestamp"),
        F.lit("").alias("title"), F.lit("").alias("url"),
    )
    return counts(docs)


def windowed_velocity(spark, sf):
    from .streaming.incremental import windowed_velocity as velocity

    events = b.table(spark, sf, "events").select(F.col("ts").alias("timestamp"), F.col("event_type").alias("source"), "user_id")
    return velocity(events, "6 hours").select("window_start", "source", "mentions", "weighted_mentions", "users")


# ---- streams, sinks and logs, read back ---------------------------------------------------
def _landed(spark, rows, slices, order):
    """`rows` in a landing folder, `files` files for each slice of the order, the earliest slice first; a folder for what a run writes, and `files`."""
    import uuid

    from .operators.durable import checkpoint_root, freeing, of_slice, slices as rounds

    root = f"{checkpoint_root(spark).rstrip('/')}/run-{uuid.uuid4().hex}"
    with freeing(rows.sparkSession):
        low, high, count = rows.agg(F.min(order), F.max(order), F.count(F.lit(1))).first()
    step, files = (high - low) / slices, max(1, -(-count // (slices * FILE_ROWS)))
    landed = spark.read.schema(rows.schema)
    for i in range(slices):
        part = rows.where((F.col(order) >= low + step * i) & ((F.col(order) < low + step * (i + 1)) if i < slices - 1 else F.lit(True)))
        n = min(files, rounds(-(-count // slices)))  # whole rows are shuffled round by round
        for j in range(n):
            with freeing(rows.sparkSession):
                part.where(of_slice(j, n, order)).repartition(files * (j + 1) // n - files * j // n).write.mode("append").parquet(f"{root}/land")
        # a task without rows writes no file: empty ones make up the number, as a stream counts files
        for _ in range(files * (i + 1) - len(landed.parquet(f"{root}/land").inputFiles())):
            rows.limit(0).coalesce(1).write.mode("append").parquet(f"{root}/land")
    return root, files


def stream_ingest(spark, sf):
    """Documents streamed in four batches to a table that holds each content hash once."""
    from .streaming.incremental import unique_stream

    docs = b.table(spark, sf, "documents").select("doc_id", "source", text.content_hash("text").alias("content_hash"))
    root, files = _landed(spark, docs, 4, "doc_id")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/land")
    unique_stream(stream, f"{root}/table", f"{root}/checkpoint", order=["doc_id"]).awaitTermination()
    return spark.read.parquet(f"{root}/table").select("doc_id", "source", "content_hash")


def stream_velocity(spark, sf):
    """Events streamed in four time slices; a last row, a year later, lets the watermark pass all of them."""
    from .streaming.incremental import velocity_stream

    events = b.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("source"), "user_id")
    root, files = _landed(spark, events, 4, "timestamp")
    events.agg((F.max("timestamp") + F.expr("INTERVAL 1 YEAR")).alias("timestamp")).select(
        "timestamp", F.lit("end").alias("source"), F.lit(None).cast(events.schema["user_id"].dataType).alias("user_id")
    ).coalesce(1).write.mode("append").parquet(f"{root}/land")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/land")
    velocity_stream(stream, f"{root}/table", f"{root}/checkpoint", "6 hours").awaitTermination()
    out = spark.read.parquet(f"{root}/table").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    return out.select("window_start", "source", "mentions", "weighted_mentions", "users")


def _streamed(spark, rows, slices, run):
    """`rows` streamed in slices by question through `run(stream, table, checkpoint)`, and the table read back."""
    root, files = _landed(spark, rows, slices, "question_id")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/land")
    run(stream, f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/table")


def stream_gate(spark, sf):
    """The gate over questions that arrive in three batches."""
    from .streaming.incremental import gate_stream

    out = _streamed(spark, b.view(spark, sf, "questions"), 3, lambda s, table, ck: gate_stream(s, table, ck, QDAY))
    return out.select("question_id", "is_valid", "flags", "clarity_score")


def stream_score(spark, sf):
    """Scores of valid questions that arrive in one batch, as scores are scaled within a batch."""
    from .operators import scoring
    from .streaming.incremental import score_stream

    texts = question_texts(spark, sf)
    out = _streamed(spark, scoring_rows(spark, sf), 1, lambda s, table, ck: score_stream(s, texts, table, ck, QDAY))
    cols = ["question_id", "rank", "quality_flags", "explanation"] + [F.round(c, 6).alias(c) for c in scoring.COMPONENTS + ["penalty_total", "total_score"]]
    return out.select(*cols)


def _sunk(table):
    """Written in two batches, the second with all rows and once more, as after a failure; read back."""
    def query(spark, sf):
        import uuid

        from .operators.durable import checkpoint_root
        from .sources.sinks import CONTRACTS, stage_sink

        rows = b.view(spark, sf, table)
        sink = stage_sink(spark, f"{checkpoint_root(spark).rstrip('/')}/{table}-{uuid.uuid4().hex}", table)
        sink.write(rows.where(F.col(CONTRACTS[table][1][0]) % 3 == 0), 0)
        sink.write(rows, 1)
        sink.write(rows, 1)
        return sink.read()
    query.__name__ = f"sink_{table}"
    return query


def _logged(log, entries, order, parts=4):
    """Entries appended part by part, with a snapshot after each second one."""
    for i in range(parts):
        log.append(entries.where(F.pmod(order, F.lit(parts)) == i), i)
        if i % 2:
            log.compact()
    return log.entries()


def review_store(spark, sf):
    """The decisions of `review_latest`, kept in a log with snapshots."""
    import uuid

    from .operators.durable import checkpoint_root
    from .plans import dashboard
    from .sources.sinks import review_log as store

    log = store(spark, f"{checkpoint_root(spark).rstrip('/')}/reviews-{uuid.uuid4().hex}")
    return dashboard.latest_review(_logged(log, review_changes(spark, sf), F.xxhash64("notes")))


def run_store(spark, sf):
    """The stages of `run_stages`, kept in a log with snapshots."""
    import uuid

    from .operators.durable import checkpoint_root
    from .plans import runlog
    from .sources.sinks import stage_log

    log = stage_log(spark, f"{checkpoint_root(spark).rstrip('/')}/runs-{uuid.uuid4().hex}")
    entries = _logged(log, run_log(spark, sf), F.xxhash64("seq"))
    return runlog.fold_stages(entries).withColumn("progress", runlog.stage_progress()).drop("summary", "error_message")


# ---- text and URL scans ------------------------------------------------------------------
def url_parts(spark, sf):
    url = urls.first_url("url")
    return b.table(spark, sf, "pages").select(
        "page_id", url.alias("link"), urls.url_host(url).alias("host"), urls.url_path(url).alias("path"),
        urls.is_homepage("url").alias("homepage"), urls.is_trusted("url").alias("trusted"),
        urls.resolution_strength("url").alias("strength"), urls.source_label("url").alias("label"),
    )


def pii_scan(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", text.has_pii("text").alias("pii"))


def garbled_scan(spark, sf):
    return b.table(spark, sf, "documents").select(
        "doc_id", text.is_garbled("text").alias("garbled"), text.has_blocked_term("text").alias("blocked")
    )


def display_values(spark, sf):
    s = "total_score"
    return b.view(spark, sf, "scored").select(
        "question_id", numeric.score_band(s).alias("band"), numeric.percent_text(s).alias("pct"), numeric.score_text(s).alias("points"),
        numeric.days_bucket(F.col("question_id").cast("int") % 40 - 3).alias("chip"),
    )


# ---- inference tables ----------------------------------------------------------------------
def event_responses(spark, sf):
    """A response text per extracted event, as a model might send it: fenced, broken, incomplete or good."""
    k = F.col("id") % 10
    e = b.view(spark, sf, "extracted")
    fields = [
        F.when(k == 6, "short").otherwise(F.col("event_summary")).alias("event_summary"),
        F.when(k == 7, F.array().cast("array<string>")).otherwise(F.col("entities")).alias("entities"),
        F.when(k == 2, "gossip").otherwise(F.col("event_type")).alias("event_type"),
        F.concat(F.lit("the "), "outcome_variable").alias("outcome_variable"),
        "candidate_deadlines", "resolution_sources", "tradability", "rejection_reason",
        F.when(k == 3, 1.5).otherwise(F.col("confidence")).alias("confidence"), "market_angle", "contradiction_flag", "contradiction_details",
        F.when(k != 1, F.col("time_horizon")).alias("time_horizon"), "resolution_hints",
        F.when(k == 4, "extra").alias("note"),
    ]
    json = F.to_json(F.struct(*fields))
    text_ = F.when(k == 0, F.concat(F.lit("```json\n"), json, F.lit("\n```"))).when(k == 5, F.concat(json, F.lit(" trailing"))).otherwise(json)
    return e.select("id", F.concat(F.lit("prompt "), F.col("id").cast("string")).alias("prompt"), text_.alias("response"))


def event_contract(spark, sf):
    from .operators.responses import event_contract as contract

    return contract(event_responses(spark, sf)).select("id", "error")


def event_response_rows(spark, sf):
    from .operators import responses

    return responses.event_rows(responses.event_contract(event_responses(spark, sf))).select(
        "id", "event_summary", "entities", "event_type", "outcome_variable", "tradability", "confidence", "contradiction_flag", "resolution_hints"
    )


def event_retries(spark, sf):
    from .operators import responses

    return responses.retry_set(responses.event_contract(event_responses(spark, sf)), 0).select("id", "prompt")


def question_responses(spark, sf):
    q = b.view(spark, sf, "questions")
    item = F.struct(
        "question_text", "category", "question_type", "options", "deadline", "deadline_source", "resolution_source", "resolution_criteria",
        "rationale", "resolution_confidence", F.lit("needs checking").alias("resolution_confidence_reason"), "source_independence",
        "timing_reliability", "already_resolved",
    )
    return q.select("question_id", F.to_json(F.struct(F.array(item).alias("questions"))).alias("response"))


def question_contract(spark, sf):
    from .operators.responses import question_contract as contract

    return contract(question_responses(spark, sf)).select("question_id", "error")


def question_response_rows(spark, sf):
    from .operators import responses

    rows = responses.question_rows(responses.question_contract(question_responses(spark, sf)))
    return rows.select("question_id", "item", "question_text", "category", "options", "deadline", "resolution_confidence")


def extraction_prompts(spark, sf):
    from .operators import prompts

    members = b.view(spark, sf, "labelled_members")
    features = clusters.cluster_features(members, ETIME)
    return prompts.extraction_prompts(members, features)


def generation_prompts(spark, sf):
    from .operators import prompts

    return prompts.generation_prompts(b.view(spark, sf, "extracted"), QDAY)


def repair_prompts(spark, sf):
    """Failed, repairable questions without a repair, joined to their event."""
    from .operators import prompts

    failed = repair_rows(spark, sf).where(~F.col("has_repair_child") & gate.is_salvageable("validation_flags"))
    events = b.view(spark, sf, "extracted").select(
        F.col("id").alias("extracted_event_id"), "event_summary", "entities", "time_horizon", "candidate_deadlines", "resolution_sources", "market_angle"
    )
    return prompts.repair_prompts(failed.join(events, "extracted_event_id"), QDAY)


QUERIES = [
    # text, dates, URLs
    deadline_parse, deadline_repair, url_parts, pii_scan, garbled_scan, token_fingerprint, display_values,
    # feeds and storage
    feed_events, feed_counts, exact_dedupe, ingest_counts, windowed_velocity,
    # clusters and priorities
    cluster_features, cluster_coherence, cluster_priority_topk, priority_tiered, event_priority_queue, event_priority_sparse, event_priority_tiered,
    # similarity
    vector_dedupe, vector_dedupe_strict, vector_dedupe_blocks, dbscan_blocks, dbscan, dbscan_features, story_dedupe, question_dedupe, capped_story_dedupe,
    novelty, max_similarity, near_duplicate_theme, stream_ingest, stream_velocity, stream_gate, stream_score, review_store, run_store,
    # gate, admission, scoring
    gate_flags, gate_summary, salvage_flags, admission_errors, soft_flags, scored_rank, scored_rank_sparse, top_questions,
    # inference tables
    event_contract, event_response_rows, event_retries, question_contract, question_response_rows,
    extraction_prompts, generation_prompts, repair_prompts,
    # pending work, dashboards, run log
    pending_anti, pending_generation, pending_validation, pending_scoring, repair_second_pass, repair_open, repair_counts, days_levels, run_states, latest_run, active_run, suitability_counts,
    stage_summaries, pending_not_in, pending_not_in_null, dashboard_queue, filtered_queue, status_stats, repair_queue, repair_children,
    review_latest, run_stages, run_progress,
    # discovery
    discovery_markets, discovery_filter, topic_rollup, trend_topk, topic_notes, summary_metrics, category_counts,
]
NAMED = {f.__name__: f for f in QUERIES} | {f"sink_{t}": _sunk(t) for t in ("extracted", "questions", "validation", "scored")} | {
    "discovery_newest": discovery_newest, "discovery_ending": discovery_ending, "discovery_emerging": discovery_emerging,
    "discovery_highest": discovery_highest,
}

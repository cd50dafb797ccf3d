"""Feeds, sinks, streams, logs, contracts and clusters."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from omenflow.options import Options
from omenflow.operators import clusters, pending, priority, prompts, responses
from omenflow.plans import dashboard, discovery, runlog
from omenflow.sources import adapters, sinks
from omenflow.streaming import incremental

NOW = dt.datetime(2026, 6, 1, 12)


def members(spark, rows):
    return spark.createDataFrame(rows, "cluster_id long, source string, signal_role string, timestamp timestamp_ntz")


def test_cluster_features(spark):
    t0 = dt.datetime(2026, 6, 1)
    rows = [(1, s, "discovery", t0 + dt.timedelta(hours=h)) for s, h in (("reuters", 0), ("bbc", 1), ("reuters", 2))]
    rows += [(2, s, "attention", t0 + dt.timedelta(hours=h)) for s, h in (("reddit", 0), ("reddit", 1), ("hackernews", 2))]
    rows += [(3, "eia", "resolution", t0)] * 2 + [(4, "eia", "resolution", t0)] * 3
    got = {r.cluster_id: r for r in clusters.cluster_features(members(spark, rows), NOW).collect()}
    assert set(got) == {1, 2, 4}
    assert got[1].source_diversity == 2 and got[1].mention_velocity == 1.5 and got[1].recency == 10.0
    assert got[1].weighted_mention_velocity > got[2].weighted_mention_velocity
    assert got[4].mention_velocity == 3.0 and got[4].weighted_mention_velocity == 7.5 and got[4].source_role_mix == {"resolution": 3}


def test_coherence(spark):
    rows = [(1, [1.0, 2.0])] * 3 + [(2, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (4, [1.0, 0.0])]
    got = {r.cluster_id: r.coherence_score for r in clusters.coherence(spark.createDataFrame(rows, "cluster_id long, embedding array<double>")).collect()}
    assert got[1] == pytest.approx(1.0) and got[2] == pytest.approx(0.0) and got[3] == 0.0 and got[4] == pytest.approx(0.0)


def test_topic_of_text(spark):
    df = spark.createDataFrame([("Bitcoin and Ethereum rally as spot ETF nears",), ("Paperwork Reduction Act: notice inviting comments on information collection",)], "x string")
    topic, prior = priority.text_topic("x", F.lit(True), F.lit(True))
    pen = priority.procedural_penalty(F.bit_count(priority.hit_mask(F.lower("x"), ["paperwork reduction act", "information collection", "notice inviting comments"])))
    rows = df.select(topic.alias("t"), prior.alias("p"), pen.alias("n")).collect()
    assert rows[0].t == "crypto" and rows[0].p > 0.5 and rows[1].n == pytest.approx(0.54)


def test_not_in_with_nulls(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    right = spark.createDataFrame([(2,)], "k long")
    nulls = spark.createDataFrame([(2,), (None,)], "k long")
    assert [r.k for r in pending.not_in(left, right, "k", "k").collect()] == [1]
    assert pending.not_in(left, nulls, "k", "k").count() == 0
    assert sorted(str(r.k) for r in pending.not_in(left, nulls, "k", "k", null_aware=False).collect()) == ["1", "None"]
    assert pending.not_in(left, right.limit(0), "k", "k").count() == 3


RAW = "source string, received_at timestamp, payload string, hint string"


def raw(spark, *rows):
    return spark.createDataFrame([(s, NOW, p if isinstance(p, str) else json.dumps(p), h) for s, p, h in rows], RAW)


def test_feeds(spark):
    df = raw(
        spark,
        ("gdelt", {"articles": [{"title": "A", "url": "u", "seendate": "bad"}, {"title": "B", "domain": "d.com", "seendate": "20260102T030405Z"}]}, None),
        ("polymarket", [{"question": "Q?", "description": "D", "endDate": "2027-01-01T00:00:00Z", "slug": "q"}], None),
        ("reddit", {"data": {"children": [{"data": {"title": "T", "selftext": "x" * 900, "permalink": "/r/a", "created_utc": 0}}]}}, None),
        ("wikipedia", {"items": [{"articles": [{"article": "Main_Page", "views": 10**7}, {"article": "Some_One", "views": 1234567}, {"article": "Rare", "views": 5}]}]}, None),
        ("bls", {"Results": {"series": [{"seriesID": "X", "data": []}, {"seriesID": "LNS14000000", "data": [{"value": "4.0", "year": "2026", "periodName": "May"}]}]}}, None),
        ("rss", "<feed><title>My Wire - World</title><entry><title>Hi</title><summary>there</summary><link href='http://l'/><updated>2026-01-02T00:00:00+02:00</updated></entry></feed>", None),
        ("kalshi", "{bad", None),
    )
    got = {(r.feed, r.title): r for r in adapters.fan_in(df).collect()}
    assert got["gdelt", "A"].source == "gdelt" and got["gdelt", "A"].timestamp == NOW
    assert got["gdelt", "B"].source == "d.com" and got["gdelt", "B"].timestamp == dt.datetime(2026, 1, 2, 3, 4, 5)
    assert got["polymarket", "Q?"].timestamp == dt.datetime(2027, 1, 1) and got["polymarket", "Q?"].url.endswith("/event/q")
    cut = adapters.fan_in(df, Options(body_chars=500)).where("feed = 'reddit'").first()
    assert len(got["reddit", "T"].content) == 903 and len(cut.content) == 503 and cut.content_hash != got["reddit", "T"].content_hash
    assert got["reddit", "T"].timestamp == NOW
    assert got["wikipedia", "Some One"].content.endswith("received 1,234,567 pageviews") and ("wikipedia", "Main Page") not in got
    assert got["bls", "Unemployment Rate — May 2026"].content == "BLS Unemployment Rate: 4.0 (May 2026)"
    assert got["rss", "Hi"].source == "my_wire" and got["rss", "Hi"].timestamp == dt.datetime(2026, 1, 1, 22)
    counts = {r.feed: r for r in adapters.feed_counts(df).collect()}
    assert counts["kalshi"].rejected == 1 and counts["kalshi"].events == 0 and counts["gdelt"].events == 2


def test_new_events_and_counts(spark):
    rows = [(1, "a", "h1"), (2, "a", "h1"), (3, "b", "h2"), (4, "b", "h3")]
    df = spark.createDataFrame(rows, "timestamp long, source string, content_hash string").withColumn("title", F.lit("")).withColumn("url", F.lit(""))
    stored = spark.createDataFrame([("h3",)], "content_hash string")
    assert sorted(r.timestamp for r in sinks.new_events(df, stored).collect()) == [1, 3]
    got = {r.source: (r.fetched, r.new, r.deduplicated) for r in sinks.ingest_counts(df, stored).collect()}
    assert got == {"a": (2, 1, 1), "b": (2, 1, 1)}


def test_cluster_sink(spark, tmp_path):
    f = spark.createDataFrame([(1,)], "cluster_id long")
    m = spark.createDataFrame([(1, 10), (1, None), (2, 11)], "cluster_id long, event_id long")
    sinks.write_clusters(f, m, str(tmp_path / "c"), str(tmp_path / "b"))
    assert [tuple(r) for r in sinks.read_table(spark, str(tmp_path / "b")).collect()] == [(1, 10)]
    ids = sinks.with_ids(spark.range(5), [F.desc("id")], "new_id", after=7)
    assert {r.id: r.new_id for r in ids.collect()} == {4: 8, 3: 9, 2: 10, 1: 11, 0: 12}


def test_feeds_are_read_in_one_scan_and_a_further_feed_is_one_more_entry(spark, tmp_path):
    land = str(tmp_path / "land")
    raw(spark, ("gdelt", {"articles": [{"title": "A", "url": "u"}]}, None), ("notes", {"notes": [{"text": "B"}, {"text": "C"}]}, None),
        ("notes", {"other": 1}, None)).write.parquet(land)
    own = adapters.Feed(adapters._list("$.notes"), lambda opts: adapters._event(
        title=adapters._f("text"), content=adapters._f("text"), source="notes", source_type="own", url="", when=F.lit(None).cast("timestamp_ntz")), list_at="$.notes")
    table, feeds = spark.read.schema(RAW).parquet(land), adapters.FEEDS | {"notes": own}
    events = adapters.fan_in(table, feeds=feeds)
    assert sorted((r.feed, r.title) for r in events.collect()) == [("gdelt", "A"), ("notes", "B"), ("notes", "C")]
    counts = adapters.feed_counts(table, feeds=feeds)
    assert sorted(tuple(r) for r in counts.collect()) == [("gdelt", 1, 0, 1), ("notes", 2, 1, 2)]
    for df in (events, counts):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_ingest_stream_keeps_hashes_unique(spark, tmp_path):
    land, table, ck = (str(tmp_path / n) for n in ("land", "table", "ck"))
    post = lambda *titles: raw(spark, ("gdelt", {"articles": [{"title": t, "url": "u"} for t in titles]}, None))
    for titles in (("A", "B", "a "), ("B", "C"), ("A", "D")):
        post(*titles).write.mode("append").parquet(land)
        incremental.ingest_stream(spark.readStream.schema(RAW).parquet(land), table, ck).awaitTermination()
    assert sorted(r.title.strip().lower() for r in spark.read.parquet(table).collect()) == ["a", "b", "c", "d"]


def test_windowed_velocity_stream_matches_table(spark, tmp_path):
    rows = [(dt.datetime(2026, 1, 1, 0, m), "reuters", m % 3) for m in range(0, 50, 5)] + [(dt.datetime(2030, 1, 1), "kalshi", 1)]
    df = spark.createDataFrame(rows, "timestamp timestamp, source string, user_id long")
    df.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    out = incremental.windowed_velocity(stream, "10 minutes", delay="5 minutes", not_after="2026-12-31")
    q = out.writeStream.format("memory").queryName("velocity").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = incremental.windowed_velocity(df, "10 minutes", not_after="2026-12-31")
    key = lambda rows: sorted((r.window_start, r.source, r.mentions, r.weighted_mentions) for r in rows)
    assert key(spark.table("velocity").collect()) == key(want.collect()) and len(key(want.collect())) == 5


def test_review_log(spark):
    log = spark.createDataFrame(
        [(1, "selected", "r", "", 1), (1, "removed", "r2", "", 2), (2, "selected", "", "", 1), (2, "active", "", "", 3)],
        "question_id long, status string, reason string, notes string, changed_at long",
    )
    assert [(r.question_id, r.status, r.reason) for r in dashboard.latest_review(log).collect()] == [(1, "removed", "r2")]
    with pytest.raises(Exception, match="Unsupported review status"):
        sinks.review_entries(log.withColumn("status", F.lit("odd"))).collect()


def test_effective_status(spark):
    df = spark.createDataFrame([("selected", "2020-01-01"), (None, "2020-01-01"), (None, "soon"), ("", "2030-01-01")], "s string, d string")
    assert [r.x for r in df.select(dashboard.effective_status("s", "d", NOW).alias("x")).collect()] == ["selected", "expired", "active", "active"]


def test_run_log(spark):
    at = lambda h: dt.datetime(2026, 1, 1, h)
    runs = spark.createDataFrame([(1, at(0))], "run_id long, at timestamp_ntz")
    log = runlog.new_run(runs, 1, 3).unionByName(spark.createDataFrame(
        [(1, 1, "FR1", "running", {}, "", at(1)), (1, 1, "FR1", "running", {}, "", at(2)), (1, 1, "FR1", "completed", {"new": "3"}, "", at(3)),
         (1, 2, "FR2", "running", {"pending_clusters": "4", "clusters_processed": "9"}, "", at(4))],
        "run_id long, stage_number int, stage_name string, status string, summary map<string,string>, error_message string, at timestamp_ntz"))
    st = {r.stage_number: r for r in runlog.fold_stages(log).withColumn("p", runlog.stage_progress()).collect()}
    assert st[1].started_at == at(1) and st[1].finished_at == at(3) and st[2].p == 1.0 and st[3].status == "pending" and st[2].finished_at is None
    assert runlog.run_progress(runlog.fold_stages(log)).first().progress == pytest.approx(1 / 3)
    closed = log.unionByName(runlog.cancel(runlog.fold_stages(log), 1, "2026-01-02 00:00:00"))
    assert sorted(r.status for r in runlog.fold_stages(closed).collect()) == ["completed", "failed", "failed"]


def test_discovery_status_and_label(spark):
    df = spark.createDataFrame([("world_news",), ("crypto",), ("odd",), (None,), ("",), ("entertainment",)], "c string")
    assert [r.x for r in df.select(discovery.category_label("c").alias("x")).collect()] == ["World News", "Crypto", "Other", "Other", "Other", "Entertainment"]
    days = spark.createDataFrame([(True, -3), (False, -1), (False, 14), (False, 15), (False, None)], "t boolean, d int")
    assert [r.x for r in days.select(discovery.market_status(F.col("t"), "d").alias("x")).collect()] == ["Tracked", "Expired", "Ending Soon", "Active", "Active"]


EVENT = {
    "event_summary": "A long enough summary of the event.", "entities": ["Fed"], "event_type": "policy", "outcome_variable": "rate level",
    "resolution_sources": ["Fed"], "tradability": "suitable", "rejection_reason": "", "confidence": 0.7, "market_angle": "m",
    "contradiction_flag": False, "contradiction_details": "", "time_horizon": "2 weeks", "resolution_hints": ["h"],
}
CASES = [
    (json.dumps(EVENT), None), ("```json\n" + json.dumps(EVENT) + "\n```", None), ("nonsense", "not a JSON object"), ("[1]", "not a JSON object"),
    (json.dumps(EVENT) + "x", "not a JSON object"), (json.dumps(EVENT) + "}", "not a JSON object"), (json.dumps(EVENT) + "]", "not a JSON object"),
    (json.dumps({k: v for k, v in EVENT.items() if k != "entities"}), "missing: entities"), (json.dumps(EVENT | {"confidence": 2}), "out of range: confidence"),
    (json.dumps(EVENT | {"confidence": "high"}), "type: confidence"), (json.dumps(EVENT | {"event_type": "x"}), "not allowed: event_type"),
    (json.dumps(EVENT | {"extra": 1}), "extra keys: extra"), (json.dumps(EVENT | {"event_summary": "short"}), "too short: event_summary"),
    (json.dumps(EVENT | {"entities": []}), "too few: entities"), (json.dumps(EVENT | {"contradiction_flag": "no"}), "type: contradiction_flag"),
    (json.dumps(EVENT | {"entities": [1]}), "type: entities"), (json.dumps(EVENT | {"confidence": 1}), None),
]


def test_event_contract(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(CASES)], "id long, response string")
    got = {r.id: r.error for r in responses.event_contract(df).collect()}
    assert got == {i: e for i, (_, e) in enumerate(CASES)}


def test_answer_asks_again(spark):
    """A model that answers badly until it is shown its error."""
    def respond(texts):
        return [json.dumps(EVENT) if "validation error" in p and "stubborn" not in p else "no" for p in texts]

    df = spark.createDataFrame([(1, "easy"), (2, "stubborn")], "id long, prompt string")
    good, bad = responses.answer(df, respond, responses.event_contract)
    assert [r.id for r in good.collect()] == [1] and [r.id for r in bad.collect()] == [2]
    assert responses.event_rows(good).first().confidence == 0.7


def test_embed_in_batches(spark):
    def load():
        return lambda texts: [[len(t), len(texts)] for t in texts]

    got = responses.embed(spark.createDataFrame([(i, "x" * i) for i in range(5)], "id long, t string").coalesce(1), load, "t", batch=2)
    assert {r.id: r.embedding for r in got.collect()} == {0: [0, 2], 1: [1, 2], 2: [2, 2], 3: [3, 2], 4: [4, 1]}


def test_extraction_prompt_takes_the_newest_twenty(spark):
    rows = [(1, i, f"text {i}", "bbc", "discovery", dt.datetime(2026, 1, 1) + dt.timedelta(hours=i)) for i in range(30)]
    m = spark.createDataFrame(rows, "cluster_id long, id long, content string, source string, signal_role string, timestamp timestamp_ntz")
    text = prompts.extraction_prompts(m, clusters.cluster_features(m, NOW)).first().prompt
    assert text.count("\n- text") == 20 and "- text 29" in text and "- text 9\n" not in text and "cluster of 30 related" in text


def test_rejects_by_shape(spark):
    """Every payload gives events or is rejected, or its list is empty."""
    payloads = [
        ("rss", "<rss><channel><item></rss>", 1), ("rss", "<rss version='2.0'><channel><title>T</title><item><title>a</title></item></channel></rss>", 0),
        ("rss", "<feed><title>F</title><entry><title>x</title></entry></feed>", 0), ("rss", "<rss><chanel/></rss>", 1),
        ("gdelt", '{"articles": "oops"}', 1), ("gdelt", '{"artikles": []}', 1), ("gdelt", '{"articles": []}', 0), ("gdelt", None, 1),
        ("polymarket", "{}", 1), ("polymarket", '[{"question": "q"}]', 0), ("hackernews", "[1]", 1), ("kalshi", "{broken", 1), ("nope", "{}", 1),
        ("sec_edgar", "<html></html>", 1), ("sec_edgar", "<feed><entry><title>t</title></entry></feed>", 0),
    ]
    rows = [(s, p, None, NOW) for s, p, _ in payloads]
    df = spark.createDataFrame(rows, "source string, payload string, hint string, received_at timestamp")
    bad = {(r.source, r.payload) for r in adapters.malformed(df).collect()}
    assert bad == {(s, p) for s, p, rejected in payloads if rejected}


def test_missing_numbers_count_as_zero(spark):
    from omenflow.functions.numeric import clamp, log_scale

    r = spark.createDataFrame([(None,)], "x double").select(clamp("x").alias("a"), log_scale("x", 10.0).alias("b")).first()
    assert (r.a, r.b) == (0.0, 0.0)

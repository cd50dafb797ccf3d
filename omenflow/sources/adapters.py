"""Landed raw payloads of the feeds to canonical event rows, in one pass over the table.

Raw rows: source, received_at, payload (JSON or XML text), hint (the request parameter a payload does
not repeat, such as a series id or a form type) and, for list positions, position. `received_at` stands
in wherever a feed gives no usable time. The session time zone is UTC.

A payload is parsed once, as its source says, to an array of items, which are variants; it is exploded once; and each
field of an event is one CASE over the sources. A feed is a `Feed`: where its items lie and what its fields are.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import terms
from ..functions.text import content_hash, or_empty
from ..options import DEFAULTS, Options
from ..plans.discovery import lookup

COLUMNS = ["title", "content", "source", "source_type", "url", "entities", "content_hash", "signal_role", "timestamp"]


def _text(path: str) -> Column:
    """A field of the item as text, null if it is not there."""
    return F.try_variant_get("i", f"$.{path}", "string")


def _f(path: str) -> Column:
    return or_empty(_text(path))


def _event(*, title, content, source, source_type, url, when, role="discovery", entities=None, hash_of=None) -> dict[str, Column]:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return {
        "title": title, "content": content, "source": lit(source), "source_type": F.lit(source_type), "url": lit(url),
        "entities": F.lit("") if entities is None else entities, "content_hash": content_hash(content if hash_of is None else hash_of),
        "signal_role": F.lit(role), "timestamp": F.coalesce(when, F.col("received_at").cast("timestamp_ntz")).cast("timestamp_ntz"),
    }


@dataclass(frozen=True)
class Feed:
    """`items`: parsed payload -> array of variants. `fields`: options -> the columns of an event, of the item `i`.

    `keep` tells items that are no events. `list_at` is the path that a JSON payload needs to be of the feed at all.
    """

    items: Callable[[Column], Column]
    fields: Callable[[Options], dict[str, Column]]
    keep: Callable[[Options], Column] = lambda opts: F.lit(True)
    list_at: str | None = None


def _list(path: str, first: bool = False) -> Callable[[Column], Column]:
    """The items of a JSON payload, or the first one alone."""
    whole = lambda parsed: F.try_variant_get(parsed, path, "array<variant>")
    return (lambda parsed: F.slice(whole(parsed), 1, 1)) if first else whole


def _as_variants(items: Column, item: Callable[[Column], Column]) -> Column:
    return F.transform(items, lambda x: F.parse_json(F.to_json(item(x))))


def _body(c: Column, opts: Options) -> Column:
    """The whole text, or its beginning where the caller asks for that."""
    return c if opts.body_chars is None else F.substring(c, 1, opts.body_chars)


def _wall(c: Column) -> Column:
    """ISO date-time as written, its offset dropped."""
    return F.substring(c, 1, 19).try_cast("timestamp_ntz")


def _day(c: Column) -> Column:
    return F.try_to_timestamp(F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), c), F.lit("yyyy-M-d")).cast("timestamp_ntz")


def _epoch(c: Column) -> Column:
    """Seconds since the epoch; 0 or null means unknown."""
    return F.when(F.coalesce(c, F.lit(0.0)) != 0, F.timestamp_micros((c * 1000000).cast("bigint")).cast("timestamp_ntz"))


def _instant(c: Column) -> Column:
    """RFC 822 or ISO text as a UTC time."""
    rfc = F.regexp_replace(c, r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(
        F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss xx")), F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss z")),
        c.try_cast("timestamp"),
    ).cast("timestamp_ntz")


def _with(head: Column, tail: Column) -> Column:
    """`head. tail`, or head alone."""
    return F.when(tail == "", head).otherwise(F.concat(head, F.lit(". "), tail))


def _prefixed(prefix: str, key: Column) -> Column:
    return F.when(key == "", "").otherwise(F.concat(F.lit(prefix), key))


def _rss_items(_: Column) -> Column:
    """RSS 2.0 and Atom."""
    item = "title: STRING, description: STRING, summary: STRING, link: STRING, pubDate: STRING, updated: STRING"
    entry = "title: STRING, summary: STRING, link: STRUCT<_href: STRING>, published: STRING, updated: STRING"
    r = F.from_xml("payload", f"channel STRUCT<title: STRING, item: ARRAY<STRUCT<{item}>>>")["channel"]
    a = F.from_xml("payload", f"title STRING, entry ARRAY<STRUCT<{entry}>>")
    of = lambda x, feed, summary, link, at: F.struct(
        x["title"].alias("title"), summary.alias("summary"), link.alias("link"), at.alias("at"), feed.alias("feed"))
    rss = _as_variants(r["item"], lambda x: of(x, r["title"], F.coalesce(x["summary"], x["description"]), x["link"], F.coalesce(x["pubDate"], x["updated"])))
    atom = _as_variants(a["entry"], lambda x: of(x, a["title"], x["summary"], x["link"]["_href"], F.coalesce(x["published"], x["updated"])))
    return F.when(F.contains("payload", F.lit("<rss")), rss).otherwise(atom)


def _rss(opts: Options) -> dict[str, Column]:
    name = F.trim(F.substring_index(F.coalesce(_text("feed"), "hint"), " - ", 1))
    return _event(title=_f("title"), content=_with(_f("title"), _f("summary")), source=F.replace(F.lower(name), F.lit(" "), F.lit("_")),
                  source_type="rss", url=_f("link"), when=_instant(_text("at")))


def _gdelt(opts: Options) -> dict[str, Column]:
    when = F.try_to_timestamp(_text("seendate"), F.lit("yyyyMMdd'T'HHmmss'Z'")).cast("timestamp_ntz")
    return _event(title=_f("title"), content=_f("title"), source=F.coalesce(_text("domain"), F.lit("gdelt")), source_type="gdelt", url=_f("url"), when=when)


def polymarket(role: str = "discovery") -> Feed:
    """Market listings; `role` says what kind of signal they are taken for."""
    fields = lambda opts: _event(
        title=_f("question"), content=_with(_f("question"), _f("description")), source="polymarket", source_type="market",
        url=_prefixed("https://polymarket.com/event/", _f("slug")), when=_wall(_text("endDate")), role=role)
    return Feed(_list("$"), fields, list_at="$")


def _kalshi(opts: Options) -> dict[str, Column]:
    content = F.concat(_with(_f("title"), _f("subtitle")),
                       F.when(_f("category") == "", "").otherwise(F.concat(F.lit(" [Category: "), _f("category"), F.lit("]"))))
    return _event(title=_f("title"), content=content, source="kalshi", source_type="market",
                  url=_prefixed("https://kalshi.com/markets/", _f("ticker")), when=_wall(_text("close_time")), role="benchmark")


def _reddit(opts: Options) -> dict[str, Column]:
    return _event(title=_f("data.title"), content=_with(_f("data.title"), _body(_f("data.selftext"), opts)), source="reddit", source_type="social",
                  url=_prefixed("https://reddit.com", _f("data.permalink")), when=_epoch(F.try_variant_get("i", "$.data.created_utc", "double")), role="attention")


def _hackernews(opts: Options) -> dict[str, Column]:
    return _event(title=_f("title"), content=_f("title"), source="hackernews", source_type="social", url=_f("url"),
                  when=_epoch(F.try_variant_get("i", "$.time", "double")), role="attention")


def _top_story(opts: Options) -> Column:
    """One payload per item; `position`, where given, is its place in the top list."""
    story = F.coalesce(_text("type") == "story", F.lit(False))
    return story if opts.hn_max_stories is None else story & F.coalesce(F.col("position") < opts.hn_max_stories, F.lit(True))


def _page_title() -> Column:
    return F.replace(_f("article"), F.lit("_"), F.lit(" "))


def _wikipedia(opts: Options) -> dict[str, Column]:
    """Top pages of the day before the payload arrived."""
    day, title = F.col("received_at").cast("timestamp_ntz") - F.expr("INTERVAL 1 DAY"), _page_title()
    views = F.format_number(F.try_variant_get("i", "$.views", "bigint"), 0)
    content = F.concat(F.lit("Wikipedia attention spike: "), title, F.lit(" received "), views, F.lit(" pageviews"))
    key = F.concat(F.lit("wiki-"), title, F.lit("-"), F.date_format(day, "yyyy/MM/dd"))
    return _event(title=title, content=content, source="wikipedia", source_type="social",
                  url=F.concat(F.lit("https://en.wikipedia.org/wiki/"), _f("article")), when=day, role="attention", hash_of=key)


def _busy_page(opts: Options) -> Column:
    title = _page_title()
    return ~title.startswith("Special:") & ~title.startswith("Main Page") & (F.try_variant_get("i", "$.views", "bigint") >= opts.wiki_min_views)


def _federal_register(opts: Options) -> dict[str, Column]:
    names = F.transform(F.try_variant_get("i", "$.agencies", "array<variant>"), lambda x: F.try_variant_get(x, "$.name", "string"))
    agencies = F.coalesce(F.array_join(F.filter(names, lambda n: F.coalesce(n, F.lit("")) != ""), ", "), F.lit(""))
    head = F.concat(F.lit("["), _f("type"), F.lit("] "), _f("title"))
    content = F.concat(_with(head, _body(_f("abstract"), opts)),
                       F.when(agencies == "", "").otherwise(F.concat(F.lit(" (Agencies: "), agencies, F.lit(")"))))
    return _event(title=_f("title"), content=content, source="federal_register", source_type="official", url=_f("html_url"),
                  when=_day(_text("publication_date")), role="resolution", entities=agencies)


def _congress(opts: Options) -> dict[str, Column]:
    head = F.concat(F.lit("["), _f("type"), _f("number"), F.lit(", "), _f("congress"), F.lit("th Congress] "), _f("title"))
    action = _f("latestAction.text")
    content = F.when(action == "", head).otherwise(F.concat(head, F.lit(". Latest action: "), action))
    return _event(title=_f("title"), content=content, source="congress", source_type="official", url=_f("url"),
                  when=_day(_text("latestAction.actionDate")), role="resolution")


def _sec_items(_: Column) -> Column:
    body = F.from_xml("payload", "entry ARRAY<STRUCT<title: STRING, summary: STRING, link: STRUCT<_href: STRING>, updated: STRING>>")
    return _as_variants(body["entry"], lambda x: F.struct(x["title"].alias("title"), x["summary"].alias("summary"), x["link"]["_href"].alias("link"), x["updated"].alias("updated")))


def _sec(opts: Options) -> dict[str, Column]:
    """`hint` is the form type."""
    head = F.concat(F.lit("[SEC "), or_empty("hint"), F.lit("] "), _f("title"))
    return _event(title=_f("title"), content=_with(head, _body(_f("summary"), opts)), source="sec_edgar", source_type="official",
                  url=_f("link"), when=_wall(_text("updated")), role="resolution")


def _series(label: str, source: str, names: dict, sid: Column, value, period, shown, url: str, when, key) -> dict[str, Column]:
    name = lookup(names, sid, sid)
    content = F.concat(F.lit(f"{label} "), name, F.lit(": "), value, shown)
    return _event(title=F.concat(name, F.lit(" — "), period), content=content, source=source, source_type="official",
                  url=F.concat(F.lit(url), sid), when=when, role="resolution", hash_of=key)


def _bls(opts: Options) -> dict[str, Column]:
    """Latest point of each series that has data."""
    sid, year, month = _f("seriesID"), _f("data[0].year"), _f("data[0].periodName")
    span = F.concat(month, F.lit(" "), year)
    return _series("BLS", "bls", terms.BLS_SERIES, sid, _f("data[0].value"), span, F.concat(F.lit(" ("), span, F.lit(")")),
                   "https://data.bls.gov/timeseries/", F.lit(None).cast("timestamp_ntz"), F.concat(F.lit("bls-"), sid, F.lit("-"), year, F.lit("-"), month))


def _fred(opts: Options) -> dict[str, Column]:
    """First observation; `hint` is the series id."""
    sid = or_empty("hint")
    return _series("FRED", "fred", terms.FRED_SERIES, sid, _f("value"), _f("date"), F.concat(F.lit(" (as of "), _f("date"), F.lit(")")),
                   "https://fred.stlouisfed.org/series/", _day(_text("date")), F.concat(F.lit("fred-"), sid, F.lit("-"), _f("date")))


def _eia(opts: Options) -> dict[str, Column]:
    """First row; `hint` is the series id."""
    sid = or_empty("hint")
    return _series("EIA", "eia", terms.EIA_SERIES, sid, _f("value"), _f("period"), F.concat(F.lit(" (period: "), _f("period"), F.lit(")")),
                   "https://www.eia.gov/opendata/browser/?id=", _day(_text("period")), F.concat(F.lit("eia-"), sid, F.lit("-"), _f("period")))


_there = lambda opts: F.col("i").isNotNull()
FEEDS = {
    "rss": Feed(_rss_items, _rss), "gdelt": Feed(_list("$.articles"), _gdelt, list_at="$.articles"),
    "reddit": Feed(_list("$.data.children"), _reddit, list_at="$.data.children"),
    "hackernews": Feed(lambda parsed: F.array(parsed), _hackernews, _top_story),
    "wikipedia": Feed(_list("$.items[0].articles"), _wikipedia, _busy_page, "$.items"),
    "federal_register": Feed(_list("$.results"), _federal_register, list_at="$.results"), "congress": Feed(_list("$.bills"), _congress, list_at="$.bills"),
    "sec_edgar": Feed(_sec_items, _sec),
    "bls": Feed(_list("$.Results.series"), _bls, lambda opts: F.coalesce(F.size(F.try_variant_get("i", "$.data", "array<variant>")) > 0, F.lit(False)), "$.Results.series"),
    "fred": Feed(_list("$.observations", True), _fred, _there, "$.observations"), "eia": Feed(_list("$.response.data", True), _eia, _there, "$.response.data"),
    "polymarket": polymarket(), "kalshi": Feed(_list("$.markets"), _kalshi, list_at="$.markets"),
}


def _by_source(of: Callable[[Feed], Column | None], feeds: dict[str, Feed]) -> Column:
    """One CASE over the sources; null where a feed has nothing to say."""
    out = None
    for name, feed in feeds.items():
        column = of(feed)
        if column is not None:
            here = F.col("feed") == name
            out = F.when(here, column) if out is None else out.when(here, column)
    return out


def _shaped(feeds: dict[str, Feed], parsed: Column) -> Column:
    """Whether a payload parses and has the shape of its feed.

    A JSON payload needs its list of items (Hacker News: an item object), an XML payload must
    parse to a channel or to a feed. A list that is empty is no reject.
    """
    listed = _by_source(lambda f: None if f.list_at is None else F.try_variant_get(parsed, f.list_at, "array<variant>").isNotNull(), feeds)
    channel = F.from_xml("payload", "channel STRUCT<title: STRING, item: ARRAY<STRUCT<title: STRING>>>, title STRING, _corrupt_record STRING",
                         {"columnNameOfCorruptRecord": "_corrupt_record"})
    sound = F.trim("payload").rlike(r"(?s)^<.*>$") & F.coalesce(channel["_corrupt_record"].isNull(), F.lit(False))
    rss_like = F.contains("payload", F.lit("<rss")) & channel["channel"].isNotNull()
    atom_like = F.contains("payload", F.lit("<feed"))
    own = F.when(F.col("feed") == "hackernews", F.try_variant_get(parsed, "$", "map<string,variant>").isNotNull())
    own = own.when(F.col("feed") == "rss", sound & (rss_like | atom_like)).when(F.col("feed") == "sec_edgar", sound & atom_like)
    return F.coalesce(own, listed, F.lit(False))


def landed_items(raw: DataFrame, feeds: dict[str, Feed] | None = None) -> DataFrame:
    """feed, received_at, hint, position, rejected, at, i: a row for each item, and one without an item for each payload that has none."""
    feeds = FEEDS if feeds is None else feeds
    given = lambda name, kind: F.col(name) if name in raw.columns else F.lit(None).cast(kind)
    rows = raw.select(F.col("source").alias("feed"), "received_at", given("hint", "string").alias("hint"), given("position", "bigint").alias("position"), "payload",
                      F.try_parse_json("payload").alias("parsed"))
    rows = rows.select("feed", "received_at", "hint", "position", (~_shaped(feeds, F.col("parsed"))).alias("rejected"),
                       _by_source(lambda f: f.items(F.col("parsed")), feeds).alias("items"))
    return rows.select("feed", "received_at", "hint", "position", "rejected", F.posexplode_outer("items").alias("at", "i"))


def malformed(raw: DataFrame) -> DataFrame:
    """Payloads that do not parse or do not have the shape of their feed, with their source: the reject table."""
    bad = raw.withColumn("feed", F.col("source"))
    return bad.where(~_shaped(FEEDS, F.try_parse_json("payload"))).drop("feed")


def _is_event(feeds: dict[str, Feed], opts: Options) -> Column:
    return F.col("at").isNotNull() & F.coalesce(_by_source(lambda f: f.keep(opts), feeds), F.lit(False))


def fan_in(raw: DataFrame, opts: Options = DEFAULTS, feeds: dict[str, Feed] | None = None) -> DataFrame:
    """All feeds in one event table, from one scan. A payload that does not parse yields no rows and fails nothing.

    `feeds` are the feeds to read, FEEDS or more of them: a further feed is one more entry.
    """
    feeds = FEEDS if feeds is None else feeds
    fields = {name: feed.fields(opts) for name, feed in feeds.items()}
    rows = landed_items(raw, feeds).where(_is_event(feeds, opts))
    place = {id(feed): name for name, feed in feeds.items()}
    return rows.select(*[_by_source(lambda f, c=c: fields[place[id(f)]][c], feeds).alias(c) for c in COLUMNS], "feed")


def feed_counts(raw: DataFrame, opts: Options = DEFAULTS, feeds: dict[str, Feed] | None = None) -> DataFrame:
    """Per feed: payloads, rejected payloads and events, from one scan."""
    feeds = FEEDS if feeds is None else feeds
    first = F.coalesce(F.col("at"), F.lit(0)) == 0  # one row of each payload
    return landed_items(raw, feeds).groupBy("feed").agg(
        F.count_if(first).alias("payloads"), F.count_if(first & F.col("rejected")).alias("rejected"), F.count_if(_is_event(feeds, opts)).alias("events")
    )

"""Views that give the given tables the shape of feed items, questions and reviews.

The same SELECT runs in Spark SQL and in the checking engine; a `Dialect` holds the few
spellings that differ. Nothing is sampled: each view covers its whole base table.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .functions import terms

AS_OF_QUESTIONS = "1998-06-01"
AS_OF_EVENTS = "2024-02-01 00:00:00"

PHRASES = [
    "Federal Reserve rate cut after CPI", "Bitcoin spot ETF approval", "Earnings guidance and merger",
    "Senate election primary", "NBA playoff championship", "Ceasefire and tariff talks",
    "Paperwork Reduction Act notice inviting comments", "Local bakery opens", "Draft guidance workshop notice",
]
SOURCES = [
    "reuters", "bbc", "politico", "gdelt", "polymarket", "kalshi", "reddit", "hackernews", "wikipedia",
    "federal_register", "congress", "sec_edgar", "bls", "fred", "eia", "espn",
]
TEMPLATES = [
    "close above $100 price", "win the championship", "win its next match", "report revenue growth",
    "launch a summer discount promotion", "see temperature above 95 degrees",
    "be named in an article by Reuters", "announce a merger", "be assassinated",
    "face insider trading claims", "have a major role", "reach 555-123-4567", "see a rate cut",
    "hold an election vote", "release a blog post", "win against FC Alpha",
]
RESOLUTION_SOURCES = [
    "SEC filings at https://www.sec.gov/edgar/browse/", "Wired at https://www.wired.com/", "official source",
    "Reuters and AP reporting", "Binance at https://www.binance.com/en/trade/BTC_USDT",
    "League at https://example.com/results/finals",
    "Federal Reserve statement at https://federalreserve.gov/monetarypolicy", "news reports",
    "BLS at https://www.bls.gov/cpi/ or media reports", "Example at https://example.com.",
]
CRITERIA = [
    "Resolves YES if it happens by the deadline. Resolves NO otherwise.", "Outcome if confirmed by reports.",
    "Too short", "Resolves to 'A' if first. Resolves to 'B' if second.",
    "Depends on who is responsible, if widely reported by the press.",
]
EVENT_TYPES = terms.EVENT_TYPES
CATEGORIES = terms.QUESTION_CATEGORIES
YES_NO = [("Yes", "No"), ("yes", "no"), ("TRUE", "False"), ("negative", "affirmative"), ("Up", "Down")]


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@dataclass(frozen=True)
class Dialect:
    name: str

    @property
    def spark(self) -> bool:
        return self.name == "spark"

    def lit(self, s: str) -> str:
        if self.spark:
            return '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
        return text(s)

    def pick(self, options: list[str], key: str) -> str:
        arms = " ".join(f"WHEN {i} THEN {self.lit(o)}" for i, o in enumerate(options))
        return f"CASE ({key}) % {len(options)} {arms} END"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def add_days(self, d: str, n: str) -> str:
        return f"date_add({d}, CAST({n} AS INT))" if self.spark else f"CAST({d} + CAST({n} AS INTEGER) AS DATE)"

    def add_minutes(self, base: str, n: str) -> str:
        if self.spark:
            return f"(TIMESTAMP_NTZ'{base}' + make_dt_interval(0, 0, CAST({n} AS INT), 0))"
        return f"(TIMESTAMP '{base}' + to_minutes(CAST({n} AS BIGINT)))"

    def show_date(self, d: str, fmt: str) -> str:
        if self.spark:
            return f"date_format({d}, '{fmt}')"
        duck = fmt.replace("yyyy", "%Y").replace("MMMM", "%B").replace("MMM", "%b").replace("MM", "%m")
        duck = duck.replace("dd", "%d") if "dd" in duck else duck.replace(" d", " %-d").replace("d ", "%-d ", 1) if duck.startswith("d ") else duck.replace(" d,", " %-d,")
        return f"strftime({d}, '{duck}')"


def questions(d: Dialect) -> str:
    k = "o_orderkey"
    due = "deadline_date"
    shapes = ["yyyy-MM-dd", "yyyy/MM/dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy"]
    shown = " ".join(f"WHEN {i} THEN {d.show_date(due, f)}" for i, f in enumerate(shapes))
    yes = d.pick([a for a, _ in YES_NO], k)
    no = d.pick([b for _, b in YES_NO], k)
    return f"""
SELECT {k} AS question_id, o_custkey AS extracted_event_id,
  CASE WHEN {k} % 50 = 1 THEN {k} - 1 END AS repair_parent_question_id,
  'Will ' || p_name || ' ' || p_brand || ' ' || {d.pick(TEMPLATES, k)} || ' by ' || {d.show_date(due, 'MMMM d, yyyy')}
    || CASE WHEN {k} % 23 = 0 THEN '' ELSE '?' END AS question_text,
  {d.pick(CATEGORIES, k)} AS category,
  CASE WHEN {k} % 4 = 3 THEN 'multiple_choice' ELSE 'binary' END AS question_type,
  CASE WHEN {k} % 12 = 3 THEN {d.array("'A'", "'B'", "'C'")}
       WHEN {k} % 12 = 7 THEN {d.array("'A'", "'B'", "'C'", "'D'")}
       WHEN {k} % 12 = 11 THEN {d.array("'A'", "'B'", "'C'", "'D'", "'E'", "'F'")}
       WHEN {k} % 31 = 0 THEN {d.array("'Yes'", "'No'", "' '")}
       ELSE {d.array(yes, no)} END AS options,
  CASE {k} % 7 {shown} ELSE 'soon' END AS deadline,
  CASE WHEN {k} % 19 = 0 THEN 'calendar' ELSE 'Official calendar at https://example.com/calendar' END AS deadline_source,
  {d.pick(RESOLUTION_SOURCES, k)} AS resolution_source,
  {d.pick(CRITERIA, k)} AS resolution_criteria,
  'Order priority ' || o_orderpriority AS rationale,
  CAST({k} % 11 AS DOUBLE) / 10 AS resolution_confidence,
  CASE WHEN {k} % 3 = 0 THEN 'needs checking' ELSE '' END AS resolution_confidence_reason,
  CAST({k} % 9 AS DOUBLE) / 8 AS source_independence,
  CAST({k} % 5 AS DOUBLE) / 4 AS timing_reliability,
  {k} % 29 = 0 AS already_resolved,
  o_orderdate AS created_at
FROM (
  SELECT o.*, p_name, p_brand,
    {d.add_days('CAST(o_orderdate AS DATE)', f'({k} % 7) * 100')} AS {due}
  FROM (SELECT *, {k} % (SELECT count(*) FROM part) AS pk FROM orders) o JOIN part ON p_partkey = pk
) q"""


def extracted(d: Dialect) -> str:
    k = "c_custkey"
    return f"""
SELECT {k} AS id, CAST(({k} - {k} % 3) / 3 AS BIGINT) AS cluster_id,
  {d.pick(PHRASES, k)} || ' in ' || n_name || ' ' || lower(c_mktsegment) || '. More is expected' AS event_summary,
  {d.array('n_name', 'c_mktsegment')} AS entities,
  {d.pick(EVENT_TYPES, k)} AS event_type,
  {d.pick(['vote count', 'CPI value', 'price level', 'approval'], k)} AS outcome_variable,
  {d.array(d.show_date(d.add_days("CAST('1998-05-20' AS DATE)", f'{k} % 40'), 'yyyy-MM-dd'), "'Q3 1998'", d.show_date(d.add_days("CAST('1998-05-20' AS DATE)", f'{k} % 90'), 'MMMM d, yyyy'))} AS candidate_deadlines,
  {d.array(d.pick(RESOLUTION_SOURCES, k))} AS resolution_sources,
  CASE WHEN {k} % 6 = 0 THEN 'unsuitable' ELSE 'suitable' END AS tradability,
  CASE WHEN {k} % 6 = 0 THEN 'too vague' ELSE '' END AS rejection_reason,
  CAST({k} % 10 AS DOUBLE) / 10 AS confidence,
  'Public interest in ' || n_name AS market_angle,
  {k} % 7 = 0 AS contradiction_flag,
  CASE WHEN {k} % 7 = 0 THEN 'sources disagree' ELSE '' END AS contradiction_details,
  {d.pick(['2-4 weeks', 'by June 1998', 'ongoing'], k)} AS time_horizon,
  {d.array("'official notice published'", "'vote recorded'")} AS resolution_hints
FROM customer JOIN nation ON n_nationkey = c_nationkey"""


def clusters(d: Dialect) -> str:
    return f"""
SELECT DISTINCT cluster_id, CAST(cluster_id % 40 AS DOUBLE) / 4 AS mention_velocity,
  CAST(cluster_id % 40 AS DOUBLE) / 4 * 1.5 AS weighted_mention_velocity,
  cluster_id % 7 AS source_diversity, CAST(cluster_id % 200 AS DOUBLE) AS recency,
  CAST(cluster_id % 5 AS DOUBLE) / 5 AS coherence_score
FROM (SELECT CAST((c_custkey - c_custkey % 3) / 3 AS BIGINT) AS cluster_id FROM customer) c""".replace(
        "* 1.5", "* CAST(1.5 AS DOUBLE)")


def articles(d: Dialect) -> str:
    content = f"{d.pick(PHRASES, 'doc_id')} || '. ' || text"
    return f"""
SELECT doc_id AS id, substring({content}, 1, 60) AS title, {content} AS content,
  {d.pick(SOURCES, 'doc_id')} AS source,
  CASE WHEN doc_id % 16 < 4 THEN 'discovery' WHEN doc_id % 16 < 6 THEN 'benchmark' WHEN doc_id % 16 < 9 THEN 'attention'
       WHEN doc_id % 16 < 15 THEN 'resolution' ELSE 'discovery' END AS signal_role,
  '' AS url, '' AS entities,
  {d.add_minutes('2024-01-01 00:00:00', 'doc_id * 7')} AS timestamp
FROM documents"""


def cluster_events(d: Dialect) -> str:
    """Every article belongs to one of the customers' clusters, all of which exist."""
    count = "SELECT CAST((max(c_custkey) - max(c_custkey) % 3) / 3 AS BIGINT) + 1 FROM customer"
    return f"SELECT doc_id % ({count}) AS cluster_id, doc_id AS event_id FROM documents"


def labelled_members(d: Dialect) -> str:
    """Articles grouped by the label of their vector; those without one are dealt out over ten clusters."""
    return f"""
SELECT coalesce(CAST(label AS BIGINT), a.id % 10) AS cluster_id, a.* FROM ({articles(d)}) a LEFT JOIN embeddings ON vec_id = a.id"""


def validation(d: Dialect) -> str:
    k = "o_orderkey"
    flags = [
        "'ambiguous_wording', 'weak_resolution_source'", "'low_source_independence:0.25'", "'minor_involvement'",
        "'low_resolution_confidence:0.50 (needs checking)', 'excessive_deadline'", "'pii_exposure'",
    ]
    arms = " ".join(
        f"WHEN {k} % 3 = 0 AND {k} % 5 = {i} THEN {d.array(*f.split(', '))}" for i, f in enumerate(flags)
    )
    empty = "CAST(array() AS ARRAY<STRING>)" if d.spark else "CAST([] AS VARCHAR[])"
    return f"""
SELECT {k} AS question_id, {k} % 3 <> 0 AS is_valid, CASE {arms} ELSE {empty} END AS flags,
  CASE WHEN {k} % 3 <> 0 THEN CAST(1 AS DOUBLE) WHEN {k} % 5 IN (0, 3) THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END AS clarity_score
FROM orders"""


def review(d: Dialect) -> str:
    k = "o_orderkey"
    return f"""
SELECT {k} AS question_id, CASE WHEN {k} % 37 = 0 THEN 'selected' ELSE 'removed' END AS status,
  'checked by hand' AS reason, '' AS notes, o_orderdate AS changed_at
FROM orders WHERE {k} % 37 = 0 OR {k} % 41 = 0"""


def scored(d: Dialect) -> str:
    """A stored score table, for views that only read scores."""
    k = "o_orderkey"
    return f"""
SELECT {k} AS question_id, CAST({k} % 997 AS DOUBLE) / 997 AS total_score,
  CAST({k} % 13 AS DOUBLE) / 13 AS mention_velocity_score, CAST({k} % 7 AS DOUBLE) / 7 AS source_diversity_score,
  CAST({k} % 6 AS DOUBLE) / 5 AS clarity_score, CAST({k} % 5 AS DOUBLE) / 4 AS novelty_score,
  CAST({k} % 3 AS DOUBLE) / 2 AS market_interest_score, CAST({k} % 4 AS DOUBLE) / 3 AS resolution_strength_score,
  CAST({k} % 8 AS DOUBLE) / 7 AS time_horizon_score
FROM orders WHERE {k} % 3 <> 0"""


VIEWS = {
    "questions": questions, "extracted": extracted, "clusters": clusters, "articles": articles,
    "cluster_events": cluster_events, "labelled_members": labelled_members, "validation": validation,
    "review": review, "scored": scored,
}
SPARK, CHECK = Dialect("spark"), Dialect("duckdb")
SPREAD = ["orders", "documents", "customer"]  # much work per row follows
TASK_QUESTIONS = 25_000  # questions of a task; joins of narrow rows leave as few tasks as there are cores
TASK_EVENTS = 25_000  # the same for extracted events
TABLES = ["nation", "customer", "part", "orders", "documents", "embeddings"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that is read as fewer partitions than there are cores is spread out first.

    Large inputs come in many partitions and are left as they are.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in SPREAD and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name](SPARK)
    used = {t: table(spark, sf_dir, t) for t in TABLES if f" {t}" in sql}
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    rows = spark.sql(sql, **used)
    for one, base, size, key in (("questions", "orders", TASK_QUESTIONS, "question_id"), ("extracted", "customer", TASK_EVENTS, "id")):
        if name == one:
            tasks = -(-used[base].count() // size)
            if tasks > spark.sparkContext.defaultParallelism:
                return rows.repartition(tasks, key)
    return rows


def check_sql(name: str) -> str:
    return VIEWS[name](CHECK)

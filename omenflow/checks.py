"""Plain SQL that must give the same rows as each query, for the checking engine.

Written from the rules, not from the Spark plans. Every statement covers whole tables.
"""

import re

from . import bindings as b
from .functions import terms as t

L = b.text


def esc(words) -> str:
    """Alternation of literal words; only the characters special to the pattern language are escaped."""
    return "|".join(re.sub(r"([.+*?()|^$\[\]{}\\])", r"\\\1", w) for w in words)


def any_of(x, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {L(w)})" for w in words) + ")"


def count_of(x, words) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {L(w)}) AS INT)" for w in words) + ")"


def word_of(x, words) -> str:
    return f"regexp_matches({x}, {L(chr(92) + 'b(?:' + esc(words) + ')' + chr(92) + 'b')})"


def rx(x, pattern) -> str:
    return f"regexp_matches({x}, {L(pattern)})"


def rx_any(x, patterns) -> str:
    return "(" + " OR ".join(rx(x, p) for p in patterns) + ")"


def one_of(x, words) -> str:
    return f"{x} IN ({', '.join(L(w) for w in words)})"


def squash(x) -> str:
    return rf"trim(regexp_replace(lower(coalesce({x}, '')), '\s+', ' ', 'g'))"


def plain(x) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[[:punct:]]', '', 'g'), '\s+', ' ', 'g'))"


def aliased(x) -> str:
    out = f"lower(coalesce({x}, ''))"
    for s, d in t.STORY_ALIASES:
        out = f"replace({out}, {L(s)}, {L(d)})"
    return f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"


def story_tokens(x) -> str:
    drop = ", ".join(L(w) for w in t.STOPWORDS + t.MONTH_WORDS)
    return (
        f"list_filter(string_split({aliased(x)}, ' '), lambda w: length(w) >= 3 "
        f"AND NOT regexp_full_match(w, '[0-9]+') AND w NOT IN ({drop}))"
    )


def deadline(x, lead=False) -> str:
    v = f"trim(coalesce({x}, ''))"
    if lead:
        v = rf"regexp_replace({v}, '(?i)^(by|before)\s+', '')"
    fmts = ["%Y-%m-%d", "%Y/%m/%d", "%B %d, %Y", "%b %d, %Y", "%d %B %Y", "%d %b %Y"]
    return "CAST(coalesce(" + ", ".join(f"try_strptime({v}, '{f}')" for f in fmts) + ") AS DATE)"


def long_date(d) -> str:
    return f"strftime({d}, '%B %-d, %Y')"


def views(*names) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{'v_' + n} AS ({b.check_sql(n)})" for n in names)


def in_map(x, table, default) -> str:
    arms = " ".join(f"WHEN {L(k)} THEN CAST({v} AS DOUBLE)" for k, v in table.items())
    return f"CASE {x} {arms} ELSE CAST({default} AS DOUBLE) END"


Q_DAY = f"DATE '{b.AS_OF_QUESTIONS}'"
E_TIME = f"TIMESTAMP '{b.AS_OF_EVENTS}'"


# ---- gate ---------------------------------------------------------------------------
def first_word(x, words, head) -> str:
    arms = " ".join(f"WHEN {word_of(x, [w])} THEN {L(f'{head} ({w})')}" for w in words)
    return f"CASE {arms} END"


def gate_cte() -> str:
    viol = "[" + ", ".join(f"CASE WHEN {word_of('hay', [w])} THEN {L(w)} END" for w in t.VIOLENCE_TERMS) + "]"
    media = count_of("src", [m for m in t.TRUSTED_MEDIA_TERMS if m != "ap"]) + f" + CAST({word_of('src', ['ap'])} AS INT)"
    return f"""
g0 AS (
  SELECT *, coalesce(question_text,'') || ' ' || coalesce(resolution_criteria,'') AS full_text,
    {squash("coalesce(question_text,'') || ' ' || coalesce(resolution_criteria,'')")} AS hay,
    {squash('question_text')} AS q, {squash('resolution_source')} AS src, {squash('category')} AS cat,
    {squash('resolution_criteria')} AS crit, {deadline('deadline')} AS due
  FROM v_questions),
g1 AS (
  SELECT *, NOT {rx_any('full_text', t.STATE_ACTION_PATTERNS)} AS individual,
    {any_of('src', ['http://', 'https://', '.'])} AS located, {any_of('src', t.AUTHORITATIVE_TERMS)} AS anchored,
    {media} AS media, {any_of('src', t.GENERIC_SOURCE_TERMS)} AS generic, {any_of('hay', t.DISPUTED_TERMS)} AS disputed,
    list_filter({viol}, lambda w: w IS NOT NULL) AS violent,
    len(list_filter(options, lambda o: {squash('o')} <> '' AND contains(crit, {squash('o')}))) AS named
  FROM g0),
g2 AS (
  SELECT *, coalesce(
      {first_word('hay', t.TERRORISM_TERMS, 'terrorism_content')}, {first_word('hay', t.ILLEGAL_TERMS, 'illegal_activity')},
      CASE WHEN individual AND {rx_any('full_text', t.DEATH_PATTERNS)} THEN 'death_market' END,
      CASE WHEN individual AND regexp_matches(lower(question_text), '^({'|'.join(t.QUESTION_STARTS)})')
        AND len(list_intersect(violent, [{', '.join(L(w) for w in t.SEVERE_VIOLENCE_TERMS)}])) > 0
        THEN 'violence_content (' || array_to_string(violent, ', ') || ')' END) AS topic,
    CASE WHEN length(src) < 15 THEN true
      WHEN {one_of('cat', t.AUTHORITATIVE_CATEGORIES)} AND {any_of('src', t.GENERIC_FALLBACK_TERMS)} THEN true
      WHEN anchored THEN false
      WHEN {one_of('cat', t.CREDIBLE_REPORTING_CATEGORIES)} AND media > 0 AND disputed THEN true
      WHEN {one_of('cat', t.CREDIBLE_REPORTING_CATEGORIES)} AND media > 0 AND generic THEN true
      WHEN {one_of('cat', t.CREDIBLE_REPORTING_CATEGORIES)} AND media > 0
        AND (media >= 2 OR {any_of('src', t.STATEMENT_ANCHORS)} OR located) THEN false
      WHEN NOT located AND media = 0 THEN true
      WHEN generic THEN true
      WHEN {any_of('src', t.GENERIC_NEWS_ONLY_TERMS)} THEN true ELSE false END AS weak_source,
    CASE WHEN length(crit) < 30 THEN true WHEN disputed THEN true
      WHEN question_type = 'multiple_choice' AND named < greatest(2, least(len(options), 3))
        AND len(regexp_extract_all(crit, 'resolves to')) < 2 THEN true
      WHEN question_type <> 'multiple_choice' AND NOT contains(crit, 'resolves yes') AND NOT contains(crit, 'resolves no') THEN true
      ELSE {any_of('crit', t.WEAK_CRITERIA_TERMS)} END AS weak_criteria
  FROM g1),
gated AS (
  SELECT question_id, list_filter([
    'prohibited_topic:' || topic,
    CASE WHEN {word_of('q', t.MANIPULATION_TERMS)} OR {rx_any('question_text', t.MORAL_HAZARD_PATTERNS)} THEN 'manipulation_risk' END,
    CASE WHEN coalesce(TRY_CAST(regexp_extract(q, {L(t.MINOR_AGE)}, 1) AS INT), 99) < 18 OR {rx('q', t.MINOR_CONTEXT)}
      OR {word_of('q', t.MINOR_WORD_TERMS)} OR ({word_of('q', ['children'])} AND NOT contains(q, {L("children's")})) THEN 'minor_involvement' END,
    CASE WHEN {rx_any('question_text', [t.EMAIL_PATTERN, t.PHONE_PATTERN, t.SSN_PATTERN])} THEN 'pii_exposure' END,
    CASE WHEN {word_of('lower(full_text)', t.AMBIGUOUS_TERMS)} THEN 'ambiguous_wording' END,
    CASE WHEN weak_source THEN 'weak_resolution_source' END,
    CASE WHEN weak_criteria THEN 'weak_resolution_criteria' END,
    CASE WHEN due IS NULL OR due < {Q_DAY} THEN 'invalid_deadline_window' END,
    CASE WHEN due > {Q_DAY} + 1825 THEN 'excessive_deadline' END,
    CASE WHEN question_type = 'binary' AND (NOT suffix(trim(question_text), '?') OR NOT {rx('trim(question_text)', t.BINARY_LEAD)})
      THEN 'unclear_binary_condition' END,
    CASE WHEN already_resolved THEN 'already_resolved' END,
    CASE WHEN resolution_confidence < 0.65 THEN 'low_resolution_confidence:' || printf('%.2f', resolution_confidence)
      || CASE WHEN resolution_confidence_reason <> '' THEN ' (' || resolution_confidence_reason || ')' ELSE '' END END,
    CASE WHEN source_independence < 0.4 THEN 'low_source_independence:' || printf('%.2f', source_independence) END,
    CASE WHEN timing_reliability < 0.4 THEN 'low_timing_reliability:' || printf('%.2f', timing_reliability) END
  ], lambda f: f IS NOT NULL) AS flags FROM g2)"""


GATE_ROWS = """SELECT question_id, len(flags) = 0 AS is_valid, flags,
  greatest(0.0, least(1.0, CAST(1 AS DOUBLE) - CAST(0.2 AS DOUBLE) * len(flags))) AS clarity_score FROM gated"""


def salvageable(flags) -> str:
    hard = " OR ".join(f"starts_with(f, {L(p)})" for p in t.NON_SALVAGEABLE_PREFIXES)
    soft = one_of("split_part(f, ':', 1)", t.SALVAGEABLE_FLAGS)
    return (f"(len({flags}) > 0 AND len(list_filter({flags}, lambda f: {hard})) = 0 "
            f"AND len(list_filter({flags}, lambda f: NOT ({soft}))) = 0)")


def gate_flags() -> str:
    return f"{views('questions')}, {gate_cte()} {GATE_ROWS}"


def gate_summary() -> str:
    return f"""{views('questions')}, {gate_cte()}
SELECT unnest(flags) AS flag, count(*) AS n FROM gated GROUP BY 1 ORDER BY n DESC, flag LIMIT 3"""


def salvage_flags() -> str:
    return f"""{views('questions')}, {gate_cte()}
SELECT question_id, {salvageable('flags')} AS salvageable FROM gated"""


# ---- admission ----------------------------------------------------------------------------
def garbled(x) -> str:
    return (f"({x} = '' OR length({x}) - length(regexp_replace({x}, '[^\\x00-\\x7f]', '', 'g')) > 0.3 * length({x}) "
            f"OR regexp_matches({x}, {L(t.CONTROL_CHARS)}))")


def blocked(x) -> str:
    return rx(f"lower({x})", r"\b(?:" + esc(t.BLOCKED_TERMS) + ")")


def unsafe(x) -> str:
    return (f"CASE WHEN {blocked(x)} THEN 'Blocked content detected in {x}' WHEN {garbled(x)} THEN 'Garbled text detected in {x}' END")


def repair_sql(own, candidates) -> str:
    best = f"list_min(list_filter(list_transform({candidates}, lambda c: {deadline('c', True)}), lambda d: d > {Q_DAY}))"
    return (f"CASE WHEN {deadline(own, True)} > {Q_DAY} THEN {long_date(deadline(own, True))} "
            f"WHEN {best} IS NOT NULL THEN {long_date(best)} ELSE {own} END")


def admission_cte() -> str:
    msg = lambda head, x: f"{L(head + ': ' + chr(39))} || {x} || {L(chr(39))}"
    opt = (f"list_filter(list_transform(options, lambda o, i: CASE WHEN trim(o) = '' THEN 'Option ' || (i - 1) || ' is empty or not a string' "
           f"WHEN {blocked('o')} OR {garbled('o')} THEN 'Option ' || (i - 1) || ' contains blocked or garbled content' END), lambda m: m IS NOT NULL)[1]")
    sports = f"({any_of('lower(question_text)', t.SPORTSBOOK_TERMS)} OR {rx_any('lower(question_text)', t.SPORTSBOOK_PATTERNS)} " \
             f"OR ({rx('lower(question_text)', t.SPORTSBOOK_STAT)} AND contains(lower(question_text), 'next') AND contains(lower(question_text), 'game')))"
    return f"""
drafts AS (
  SELECT q.*, e.event_type, {repair_sql('q.deadline', 'e.candidate_deadlines')} AS due
  FROM v_questions q JOIN v_extracted e ON e.id = q.extracted_event_id),
judged AS (
  SELECT * REPLACE (due AS deadline), coalesce(
    CASE WHEN already_resolved THEN 'already_resolved: event has already concluded' END,
    CASE WHEN resolution_confidence < 0.65 THEN 'resolution_confidence too low (' || printf('%.2f', resolution_confidence) || '): ' || resolution_confidence_reason END,
    CASE WHEN source_independence < 0.4 THEN 'source_independence too low (' || printf('%.2f', source_independence) || '): resolution source has conflict of interest' END,
    CASE WHEN timing_reliability < 0.4 THEN 'timing_reliability too low (' || printf('%.2f', timing_reliability) || '): resolution may never be published by deadline' END,
    CASE WHEN NOT suffix(trim(question_text), '?') THEN 'question_text does not end with ''?'': ' || substring(question_text, 1, 60) END,
    {unsafe('question_text')}, {unsafe('resolution_criteria')}, {unsafe('resolution_source')},
    CASE WHEN question_type = 'binary' AND len(options) <> 2 THEN 'Binary question must have exactly 2 options, got ' || len(options) END,
    CASE WHEN question_type = 'multiple_choice' AND len(options) NOT BETWEEN 3 AND 5 THEN 'Multiple-choice question must have 3–5 options, got ' || len(options) END,
    {opt},
    CASE WHEN due = '' OR {one_of('lower(trim(due))', t.VAGUE_DEADLINES)} THEN {msg('Deadline is missing or vague', 'due')} END,
    CASE WHEN length(trim(deadline_source)) < 10 THEN {msg('Deadline source is missing or too vague', 'deadline_source')} END,
    CASE WHEN length(trim(resolution_source)) < 10 THEN {msg('Resolution source is too vague', 'resolution_source')} END,
    CASE WHEN length(trim(resolution_criteria)) < 20 THEN {msg('Resolution criteria is too short', 'resolution_criteria')} END,
    CASE WHEN category = 'sports' AND {sports} THEN 'sportsbook-style question' END) AS error
  FROM drafts)"""


def admission_errors() -> str:
    yes, no = one_of("lower(trim(options[1]))", t.YES_WORDS), one_of("lower(trim(options[2]))", t.NO_WORDS)
    yes2, no2 = one_of("lower(trim(options[2]))", t.YES_WORDS), one_of("lower(trim(options[1]))", t.NO_WORDS)
    return f"""{views('questions', 'extracted')}, {admission_cte()}
SELECT question_id, error, deadline,
  CASE WHEN event_type = 'election' AND category IN ('', 'other', 'election') THEN 'politics' ELSE category END AS category,
  CASE WHEN question_type = 'binary' AND len(options) = 2 AND (({yes} AND {no}) OR ({no2} AND {yes2})) THEN ['Yes', 'No'] ELSE options END AS options
FROM judged"""


def deadline_parse() -> str:
    return f"""{views('questions')} SELECT question_id, due, CAST(due - {Q_DAY} AS INT) AS days_left, {long_date('due')} AS shown
FROM (SELECT question_id, {deadline('deadline')} AS due FROM v_questions)"""


def deadline_repair() -> str:
    return f"""{views('questions', 'extracted')}
SELECT q.question_id, {repair_sql('q.deadline', 'e.candidate_deadlines')} AS deadline
FROM v_questions q JOIN v_extracted e ON e.id = q.extracted_event_id"""


# ---- scoring ------------------------------------------------------------------------------
def D(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def earlier_cte(name: str, rel: str, words: int = 5) -> str:
    """Best Jaccard to a smaller id over all pairs, on bit masks of the token sets."""
    masks = ", ".join(
        f"bit_or(CASE WHEN i // 60 = {w} THEN CAST(1 AS UBIGINT) << (i % 60) ELSE CAST(0 AS UBIGINT) END) AS w{w}" for w in range(words)
    )
    inter = " + ".join(f"bit_count(a.w{w} & z.w{w})" for w in range(words))
    return f"""
{name}_tok AS (SELECT question_id, unnest(list_distinct(list_filter(string_split({plain('question_text')}, ' '), lambda w: w <> ''))) AS tok FROM {rel}),
{name}_voc AS (SELECT tok, CASE WHEN r > {60 * words} THEN CAST(error('more tokens than bits') AS BIGINT) ELSE r - 1 END AS i
  FROM (SELECT tok, row_number() OVER (ORDER BY tok) AS r FROM (SELECT DISTINCT tok FROM {name}_tok))),
{name}_m AS (SELECT question_id, count(*) AS n, {masks} FROM {name}_tok JOIN {name}_voc USING (tok) GROUP BY question_id),
{name}_best AS (SELECT question_id, max(common / CAST(an + zn - common AS DOUBLE)) AS best FROM (
  SELECT a.question_id, a.n AS an, z.n AS zn, CAST({inter} AS INTEGER) AS common
  FROM {name}_m a JOIN {name}_m z ON z.question_id < a.question_id) GROUP BY question_id)"""


def novelty_case(best) -> str:
    return f"CASE WHEN {best} >= 0.9 THEN {D(0)} WHEN {best} >= 0.7 THEN {D(.25)} WHEN {best} >= 0.4 THEN {D(.5)} ELSE {D(1)} END"


def novelty() -> str:
    return f"""{views('questions')}, {earlier_cte('nov', 'v_questions')}
SELECT q.question_id, {novelty_case('coalesce(best, 0)')} AS novelty_score FROM v_questions q LEFT JOIN nov_best USING (question_id)"""


def max_similarity() -> str:
    return f"""{views('questions')}, {earlier_cte('ms', 'v_questions')}
SELECT q.question_id, CASE WHEN best >= 0.1 THEN round(best, 6) ELSE {D(0)} END AS max_similarity FROM v_questions q LEFT JOIN ms_best USING (question_id)"""


def near_duplicate_theme() -> str:
    return f"""{views('questions')}, {earlier_cte('th', 'v_questions')}
SELECT q.question_id, coalesce(best, 0) >= 0.75 AS near_duplicate_theme FROM v_questions q LEFT JOIN th_best USING (question_id)"""


def homepage(url, path) -> str:
    return f"({url} = '' OR {path} = '' OR {one_of(path, t.HOMEPAGE_PATHS)})"


def url_cols(x) -> str:
    """url, host, path of the first link of x."""
    url = rf"regexp_replace(regexp_extract(coalesce({x}, ''), '(?i)https?://[^\s)]+'), '[.,;]+$', '')"
    return (rf"{url} AS url, regexp_extract({url}, '(?i)^https?://([^/?#]*)', 1) AS host, "
            rf"regexp_extract({url}, '(?i)^https?://[^/?#]*([^?#]*)', 1) AS path")


def score_cte() -> str:
    zero = lambda cond, x: f"CASE WHEN {cond} THEN {D(x)} ELSE {D(0)} END"
    reg = " ".join([f"WHEN {one_of('f', t.REGULATORY_EXACT)} THEN {D(.15)}"] + [
        f"WHEN starts_with(f, {L(p)}) THEN {D(a)}" for p, a in t.REGULATORY_PREFIX_PENALTIES])
    hard = " OR ".join(f"starts_with(f, {L(p)})" for p in t.HARD_EXCLUDE_PREFIXES)
    e = t.EXPLANATIONS
    return f"""
joined AS (
  SELECT q.*, c.mention_velocity, c.source_diversity, v.clarity_score, v.flags AS vflags
  FROM v_questions q JOIN v_extracted x ON x.id = q.extracted_event_id JOIN v_clusters c ON c.cluster_id = x.cluster_id
  JOIN v_validation v ON v.question_id = q.question_id WHERE v.is_valid),
texted AS (SELECT *, {plain('question_text')} AS low, {deadline('deadline')} AS due, {url_cols('resolution_source')} FROM joined),
kept AS (SELECT *, regexp_replace(path, '^/+|/+$', '', 'g') AS bare FROM texted
  WHERE NOT ({any_of('low', t.MEDIA_TERMS)} AND {any_of('low', t.OUTLET_TERMS)}) AND NOT coalesce(due < {Q_DAY}, false)),
{earlier_cte('th', 'kept')}, {earlier_cte('nov', 'v_questions')},
flagged AS (
  SELECT kept.*, {homepage('url', 'bare')} AS f_home, {any_of('low', t.PROMO_TERMS)} AS f_promo, {any_of('low', t.RETAIL_TERMS)} AS f_retail,
    {any_of('low', t.WEATHER_TERMS)} AS f_weather,
    {any_of('low', t.LOW_SIGNIFICANCE_TERMS)} OR (category = 'other' AND {any_of('low', ['launch', 'release'])}) AS f_low,
    coalesce(th_best.best, 0) >= 0.75 AS f_theme, {novelty_case('coalesce(nov_best.best, 0)')} AS novelty_score,
    {any_of('low', t.PRICE_TERMS)} AS price, {any_of('low', t.MAJOR_SPORTS_TERMS)} AS sports
  FROM kept LEFT JOIN th_best USING (question_id) LEFT JOIN nov_best USING (question_id)),
flags2 AS (SELECT *, list_filter([CASE WHEN f_home THEN 'homepage_source' END, CASE WHEN f_promo THEN 'promo_event' END,
    CASE WHEN f_retail THEN 'retail_promo_event' END, CASE WHEN f_weather THEN 'weather_event' END,
    CASE WHEN f_low THEN 'low_significance_event' END, CASE WHEN f_theme THEN 'near_duplicate_theme' END], lambda f: f IS NOT NULL) AS quality_flags
  FROM flagged),
lim AS (SELECT min(mention_velocity) AS v0, max(mention_velocity) AS v1, CAST(min(source_diversity) AS DOUBLE) AS d0, CAST(max(source_diversity) AS DOUBLE) AS d1 FROM flags2),
comp AS (
  SELECT *, CASE WHEN v1 = v0 THEN {D(1)} ELSE (mention_velocity - v0) / (v1 - v0) END AS vel,
    CASE WHEN d1 = d0 THEN {D(1)} ELSE (source_diversity - d0) / (d1 - d0) END AS source_diversity_score,
    CASE WHEN coalesce(clarity_score, 0) = 0 THEN {D(1)} ELSE clarity_score END AS clarity,
    CASE WHEN {any_of('low', t.INTEREST_SPORTS_TERMS)} OR {any_of('low', t.INTEREST_HIGH_TERMS)} THEN {D(1)} WHEN category = 'sports' THEN {D(.4)}
      WHEN {any_of('low', t.INTEREST_LOW_TERMS)} THEN {D(.1)} ELSE {D(.4)} END AS interest,
    {D(.5)} * (CASE WHEN f_home THEN {D(.2)} WHEN {any_of('lower(host)', t.STRONG_HOSTS)} THEN {D(1)} WHEN {any_of('lower(path)', t.STRONG_PATHS)} THEN {D(1)}
      WHEN {one_of('lower(host)', t.WEAK_NEWS_HOSTS)} THEN {D(.2)} WHEN {any_of(plain('resolution_source'), t.WEAK_SOURCE_TEXT)} THEN {D(.2)} ELSE {D(.6)} END)
      + {D(.5)} * (resolution_confidence * source_independence) AS strength,
    {D(.7)} * (CASE WHEN due IS NULL OR due < {Q_DAY} THEN {D(0)} WHEN due - {Q_DAY} <= 2 THEN {D(.2)} WHEN due - {Q_DAY} <= 30 THEN {D(1)}
      WHEN due - {Q_DAY} <= 180 THEN {D(.9)} WHEN due - {Q_DAY} <= 365 THEN {D(.6)} ELSE {D(.3)} END) + {D(.3)} * timing_reliability AS time_horizon_score
  FROM flags2, lim WHERE len(list_filter(vflags, lambda f: {hard})) = 0),
lifted AS (
  SELECT *, CASE WHEN sports THEN greatest(CASE WHEN price THEN greatest(vel, {D(.8)}) ELSE vel END, {D(.6)}) WHEN price THEN greatest(vel, {D(.8)}) ELSE vel END AS mention_velocity_score,
    CASE WHEN sports THEN greatest(CASE WHEN price THEN greatest(strength, {D(.8)}) ELSE strength END, {D(.6)}) WHEN price THEN greatest(strength, {D(.8)}) ELSE strength END AS resolution_strength_score,
    CASE WHEN sports THEN greatest(interest, {D(1)}) ELSE interest END AS market_interest_score
  FROM comp),
totals AS (
  SELECT *, {D(.25)} * market_interest_score + {D(.25)} * resolution_strength_score + {D(.2)} * clarity + {D(.1)} * mention_velocity_score
      + {D(.1)} * novelty_score + {D(.05)} * time_horizon_score + {D(.05)} * source_diversity_score AS base,
    ({any_of('low', t.ORDINARY_MATCH_TERMS)} OR ({any_of('low', t.ORDINARY_MATCH_WORDS)} AND {rx('low', t.ORDINARY_MATCH_DATE)})) AND NOT sports AS ordinary,
    {zero(f"f_home AND NOT {any_of('lower(resolution_source)', t.TRUSTED_DOMAINS)}", .05)} + {zero('f_promo', .25)} + {zero('f_retail', .1)}
    + {zero("f_retail AND (contains(low, 'discount') OR contains(low, '%'))", .05)} + {zero("f_retail AND contains(low, 'all purchases')", .05)}
    + {zero('f_weather', .15)} + {zero('f_low', .1)} + {zero('f_theme', .1)}
    + coalesce(list_sum(list_transform(vflags, lambda f: CASE {reg} ELSE {D(0)} END)), {D(0)}) AS penalty_total
  FROM lifted),
scored AS (
  SELECT *, greatest({D(0)}, least({D(1)}, CASE WHEN ordinary THEN base * {D(.85)} ELSE base END - penalty_total)) AS total,
    CASE WHEN f_promo OR f_retail THEN {L(e['promo'])} WHEN market_interest_score >= 1 AND resolution_strength_score >= 1 AND len(quality_flags) = 0 THEN {L(e['strong'])}
      WHEN market_interest_score <= 0.1 THEN {L(e['low_interest'])} WHEN resolution_strength_score <= 0.2 THEN {L(e['weak_source'])}
      WHEN time_horizon_score <= 0.3 THEN {L(e['horizon'])} WHEN len(quality_flags) > 0 THEN {L(e['penalties'])} ELSE {L(e['middle'])} END AS explanation
  FROM totals),
ranked AS (
  SELECT question_id, row_number() OVER (ORDER BY total DESC, question_id) AS rank, quality_flags, explanation, question_text, category, deadline, resolution_source,
    round(clarity, 6) AS clarity_score, round(mention_velocity_score, 6) AS mention_velocity_score, round(source_diversity_score, 6) AS source_diversity_score,
    round(novelty_score, 6) AS novelty_score, round(market_interest_score, 6) AS market_interest_score, round(resolution_strength_score, 6) AS resolution_strength_score,
    round(time_horizon_score, 6) AS time_horizon_score, round(penalty_total, 6) AS penalty_total, round(total, 6) AS total_score
  FROM scored)"""


SCORE_VIEWS = ("questions", "extracted", "clusters", "validation")


def scored_rank() -> str:
    return f"""{views(*SCORE_VIEWS)}, {score_cte()}
SELECT * EXCLUDE (question_text, category, deadline, resolution_source) FROM ranked"""


def scored_rank_sparse() -> str:
    return scored_rank()


def top_questions() -> str:
    return f"""{views(*SCORE_VIEWS)}, {score_cte()}
SELECT * EXCLUDE (question_id, penalty_total) FROM ranked ORDER BY rank LIMIT 10"""


def soft_flags() -> str:
    return f"""{views(*SCORE_VIEWS)}, {score_cte()} SELECT question_id, quality_flags FROM flags2"""


# ---- clusters and priorities -----------------------------------------------------------------
EVENT_MEMBERS = """SELECT user_id AS cluster_id, event_type AS source, CASE event_type WHEN 'click' THEN 'discovery' WHEN 'purchase' THEN 'resolution'
  ELSE 'attention' END AS signal_role, ts AS timestamp FROM events"""


def feature_cols() -> str:
    span = "((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / CAST(3600000000 AS DOUBLE))"
    weight = f"sum({in_map('source', t.SOURCE_WEIGHTS, t.DEFAULT_SOURCE_WEIGHT)})"
    return f"""count(*) AS size,
  CASE WHEN {span} < 0.01 THEN CAST(count(*) AS DOUBLE) ELSE round(count(*) / {span}, 4) END AS mention_velocity,
  count(DISTINCT source) AS source_diversity,
  round((epoch_us({E_TIME}) - epoch_us(max(timestamp))) / CAST(3600000000 AS DOUBLE), 4) AS recency,
  CASE WHEN {span} < 0.01 THEN {weight} ELSE round({weight} / {span}, 4) END AS weighted_mention_velocity"""


def cluster_features() -> str:
    return f"""WITH m AS ({EVENT_MEMBERS}),
r AS (SELECT cluster_id, string_agg(signal_role || '=' || n, ',' ORDER BY signal_role) AS source_role_mix
      FROM (SELECT cluster_id, signal_role, count(*) AS n FROM m GROUP BY ALL) GROUP BY cluster_id)
SELECT f.*, source_role_mix, {D(0)} AS coherence_score FROM (SELECT cluster_id, {feature_cols()} FROM m GROUP BY cluster_id) f JOIN r USING (cluster_id) WHERE size >= 3"""


COHERENCE = """SELECT a.label AS cluster_id, avg(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(z.embedding AS DOUBLE[]))) AS coherence_score
  FROM embeddings a JOIN embeddings z ON a.label = z.label AND a.vec_id < z.vec_id GROUP BY a.label"""


def cluster_coherence() -> str:
    return f"SELECT cluster_id, round(coherence_score, 5) AS coherence_score FROM ({COHERENCE})"


def topic_case(hits: dict, outlet: str, bench: str) -> tuple[str, str]:
    score = dict(hits)
    score["major_news"] = f"({score['major_news']} + CASE WHEN {outlet} THEN {D(.75)} ELSE 0 END)"
    for k, v in (("crypto", .25), ("finance", .2), ("sports", .15)):
        score[k] = f"({score[k]} + CASE WHEN {bench} THEN {D(v)} ELSE 0 END)"
    best = f"greatest({', '.join(score.values())})"
    arms = " ".join(f"WHEN {s} = {best} THEN '{k}'" for k, s in score.items())
    topic = f"CASE WHEN {best} <= 0 THEN 'other' {arms} END"
    prior = f"CASE WHEN {best} <= 0 THEN {D(.2)} ELSE greatest({D(0)}, least({D(1)}, {D(.2)} + {D(.18)} * least({best}, {D(4)}))) END"
    return topic, prior


def cluster_score_sql(prior, hits, wv, div, rec, coh, bench) -> str:
    return (f"round({D(.38)} * {prior} + {D(.24)} * CASE WHEN {wv} <= 0 THEN {D(0)} ELSE least(ln(1 + {wv}) / ln({D(13)}), {D(1)}) END "
            f"+ {D(.14)} * greatest({D(0)}, least({D(1)}, {div} / {D(6)})) + {D(.1)} * greatest({D(0)}, least({D(1)}, 1 - greatest({rec}, 0) / {D(168)})) "
            f"+ {D(.08)} * greatest({D(0)}, least({D(1)}, {coh})) + {D(.06)} * CASE WHEN {bench} THEN 1 ELSE 0 END "
            f"- greatest({D(0)}, least({D(.72)}, {hits} * {D(.18)})), 4)")


def cluster_priority_topk() -> str:
    hay = squash("title || ' ' || content || CASE WHEN entities = '' THEN '' ELSE ' ' || entities END")
    words = {k: t.TOPIC_TERMS[k] for k in t.TOPIC_TERMS} | {"procedural": t.PROCEDURAL_TERMS}
    flags = ", ".join(f"bool_or(contains(hay, {L(w)})) AS {k}_{i}" for k, ws in words.items() for i, w in enumerate(ws))
    sums = ", ".join("(" + " + ".join(f"CAST({k}_{i} AS INT)" for i in range(len(ws))) + f") AS n_{k}" for k, ws in words.items())
    topic, prior = topic_case({k: f"CAST(n_{k} AS DOUBLE)" for k in t.TOPIC_TERMS}, "outlet", "bench")
    score = cluster_score_sql("prior", "n_procedural", "weighted_mention_velocity", "source_diversity", "recency", "coherence_score", "bench")
    return f"""{views('labelled_members')},
h AS (SELECT *, {hay} AS hay FROM v_labelled_members),
f AS (SELECT cluster_id, {feature_cols()}, bool_or({one_of('source', t.MAJOR_OUTLETS)}) AS outlet, bool_or({one_of('source', t.BENCHMARK_SOURCES)}) AS bench, {flags} FROM h GROUP BY cluster_id),
n AS (SELECT *, {sums} FROM f),
p AS (SELECT n.*, round(coalesce(c.coherence_score, 0), 4) AS coherence_score, {topic} AS priority_topic, {prior} AS prior FROM n LEFT JOIN ({COHERENCE}) c USING (cluster_id))
SELECT cluster_id, size, mention_velocity, source_diversity, recency, weighted_mention_velocity, coherence_score, priority_topic, {score} AS priority_score
FROM p ORDER BY priority_score DESC, weighted_mention_velocity DESC, mention_velocity DESC, source_diversity DESC, recency, cluster_id LIMIT 10"""


def tier_case(hay, outlet) -> str:
    arms = " ".join(f"WHEN {h} THEN {D(v)}" for (v, _), h in zip(t.TIERED_TERMS, hay))
    return f"CASE {arms} WHEN {outlet} THEN {D(.8)} ELSE {D(.2)} END"


def lin(x, s) -> str:
    return f"greatest({D(0)}, least({D(1)}, {x} / {D(s)}))"


def priority_tiered() -> str:
    # word boundaries written out, as letters of every script count as word characters
    word = lambda x, ws: rx(x, r"(?:^|[^\p{L}\p{N}_])(?:" + esc(ws) + r")(?:$|[^\p{L}\p{N}_])")
    tiers = ", ".join(f"bool_or({word('hay', ws)}) AS tier{i}" for i, (_, ws) in enumerate(t.TIERED_TERMS))
    return f"""{views('labelled_members')},
h AS (SELECT *, {squash("title || ' ' || content")} AS hay FROM v_labelled_members),
f AS (SELECT cluster_id, {feature_cols()}, {tiers}, bool_or({word('source', t.TIERED_OUTLETS)}) AS outlet, bool_or({word('hay', t.TIERED_PROCEDURAL)}) AS proc,
  bool_or(signal_role = 'benchmark' OR {one_of('source', t.BENCHMARK_SOURCES)}) AS bench FROM h GROUP BY cluster_id)
SELECT cluster_id, round({D(.45)} * {tier_case([f'tier{i}' for i in range(6)], 'outlet')} + {D(.25)} * {lin('weighted_mention_velocity', 15)}
  + {D(.15)} * {lin('source_diversity', 6)} + {D(.1)} * greatest({D(0)}, least({D(1)}, 1 - greatest(recency, 0) / {D(168)}))
  + {D(.05)} * CASE WHEN bench THEN {D(.08)} ELSE 0 END - CASE WHEN proc THEN {D(.35)} ELSE 0 END, 4) AS priority_score FROM f"""


def event_priority_sparse() -> str:
    """The full query over views that hold 0 where the other side's have nothing."""
    gone = ", ".join(f"CASE WHEN cluster_id % 3 = 0 THEN 0 ELSE {c} END AS {c}" for c in ("weighted_mention_velocity", "source_diversity", "coherence_score"))
    full = event_priority_queue().replace("v_extracted AS (", "all_extracted AS (").replace("v_clusters AS (", "all_clusters AS (")
    extra = f"""v_extracted AS (SELECT * REPLACE (CASE WHEN id % 4 = 0 THEN 0 ELSE confidence END AS confidence) FROM all_extracted),
v_clusters AS (SELECT * REPLACE ({gone}) FROM all_clusters),
s AS (SELECT"""
    return full.replace("\ns AS (SELECT", "\n" + extra, 1)


EVENT_TEXT = """event_summary || ' ' || market_angle || ' ' || outcome_variable || ' ' || event_type || ' ' || array_to_string(entities, ' ') || ' ' || array_to_string(resolution_sources, ' ')"""


def event_priority_queue() -> str:
    hits = {k: f"CAST({count_of('hay', ws)} AS DOUBLE)" for k, ws in t.TOPIC_TERMS.items()}
    topic, prior = topic_case({k: f"n_{k}" for k in hits}, "outlet", "bench")
    counts = ", ".join(f"{h} AS n_{k}" for k, h in hits.items())
    clus = cluster_score_sql("prior", "n_proc", "weighted_mention_velocity", "source_diversity", "recency", "coherence_score", "bench")
    return f"""{views('extracted', 'clusters', 'cluster_events', 'articles')},
s AS (SELECT cluster_id, bool_or({one_of('source', t.MAJOR_OUTLETS)}) AS outlet, bool_or({one_of('source', t.BENCHMARK_SOURCES)}) AS bench
  FROM v_cluster_events JOIN v_articles ON id = event_id GROUP BY cluster_id),
h AS (SELECT e.*, c.* EXCLUDE (cluster_id), coalesce(outlet, false) AS outlet, coalesce(bench, false) AS bench, {squash(EVENT_TEXT)} AS hay
  FROM v_extracted e JOIN v_clusters c USING (cluster_id) LEFT JOIN s USING (cluster_id) WHERE tradability = 'suitable'),
n AS (SELECT *, {counts}, {count_of('hay', t.PROCEDURAL_TERMS)} AS n_proc FROM h),
p AS (SELECT *, {topic} AS priority_topic, {prior} AS prior FROM n)
SELECT id, priority_topic, round({D(.4)} * {clus} + {D(.22)} * prior + {D(.2)} * greatest({D(0)}, least({D(1)}, confidence))
  + {D(.12)} * {in_map("replace(lower(event_type), ' ', '_')", t.EVENT_TYPE_PRIORS, .45)} + {D(.06)} - CASE WHEN contradiction_flag THEN {D(.12)} ELSE 0 END
  - {D(.6)} * greatest({D(0)}, least({D(.72)}, n_proc * {D(.18)})), 4) AS priority_score FROM p"""


def event_priority_tiered() -> str:
    hay = squash(EVENT_TEXT)
    return f"""{views('extracted', 'clusters')},
h AS (SELECT e.*, c.* EXCLUDE (cluster_id), {hay} AS hay, {squash("array_to_string(resolution_sources, ' ')")} AS src FROM v_extracted e JOIN v_clusters c USING (cluster_id))
SELECT id, round({D(.4)} * {tier_case([word_of('hay', ws) for _, ws in t.TIERED_TERMS], word_of('src', t.TIERED_OUTLETS))} + {D(.2)} * {lin('confidence', 1)}
  + {D(.2)} * {lin('weighted_mention_velocity', 15)} + {D(.1)} * {lin('source_diversity', 6)} + {D(.1)} * greatest({D(0)}, least({D(1)}, 1 - greatest(recency, 0) / {D(168)}))
  - CASE WHEN {word_of('hay', t.TIERED_PROCEDURAL)} THEN {D(.35)} ELSE 0 END - CASE WHEN contradiction_flag THEN {D(.1)} ELSE 0 END, 4) AS priority_score FROM h"""


# ---- pending work ---------------------------------------------------------------------------------
def pending_anti() -> str:
    return f"""{views('questions', 'scored')} SELECT question_id, question_text FROM v_questions q
WHERE NOT EXISTS (SELECT 1 FROM v_scored s WHERE s.question_id = q.question_id)"""


def pending_not_in() -> str:
    return f"""{views('extracted')} SELECT DISTINCT cluster_id FROM (SELECT doc_id % (SELECT count(*) FROM customer) AS cluster_id FROM documents)
WHERE cluster_id NOT IN (SELECT cluster_id FROM v_extracted)"""


def pending_not_in_null() -> str:
    return f"""{views('questions')} SELECT question_id, question_text FROM v_questions
WHERE question_id NOT IN (SELECT repair_parent_question_id FROM v_questions)"""


def pending_generation() -> str:
    return f"""{views('extracted', 'questions')} SELECT id, cluster_id FROM v_extracted
WHERE tradability = 'suitable' AND id NOT IN (SELECT extracted_event_id FROM v_questions WHERE question_id % 3 = 0)"""


def pending_validation() -> str:
    return f"""{views('questions', 'validation')} SELECT question_id, question_text FROM v_questions q
WHERE NOT EXISTS (SELECT 1 FROM v_validation v WHERE v.question_id = q.question_id AND v.question_id % 5 <> 0)"""


def pending_scoring() -> str:
    return f"""{views('questions', 'extracted', 'clusters', 'validation', 'scored')}
SELECT q.question_id, e.cluster_id, c.mention_velocity, v.clarity_score
FROM v_questions q JOIN v_extracted e ON e.id = q.extracted_event_id JOIN v_clusters c ON c.cluster_id = e.cluster_id
JOIN v_validation v ON v.question_id = q.question_id AND v.is_valid
WHERE NOT EXISTS (SELECT 1 FROM v_scored s WHERE s.question_id = q.question_id AND s.question_id % 4 = 1)"""


def second_pass_cte() -> str:
    return f"""{views('questions', 'validation')}, {gate_cte()},
rows_again AS ({GATE_ROWS}),
open_rows AS (SELECT question_id FROM v_validation WHERE NOT is_valid AND {salvageable('flags')}),
again AS (SELECT g.question_id, q.repair_parent_question_id, g.is_valid, g.flags FROM rows_again g JOIN v_questions q USING (question_id)
  WHERE q.repair_parent_question_id IN (SELECT question_id FROM open_rows))"""


def repair_second_pass() -> str:
    return f"{second_pass_cte()} SELECT * FROM again"


def repair_open() -> str:
    return f"""{views('questions', 'validation')} SELECT question_id FROM v_validation v WHERE NOT is_valid AND {salvageable('flags')}
  AND NOT EXISTS (SELECT 1 FROM v_questions q WHERE q.repair_parent_question_id = v.question_id)"""


def days_levels() -> str:
    return f"""{views('questions')} SELECT question_id, days_left, CASE WHEN days_left IS NULL THEN '' WHEN days_left < 0 THEN 'Expired' WHEN days_left = 0 THEN 'Today' ELSE days_left || 'd left' END AS shown,
  CASE WHEN days_left IS NULL THEN '' WHEN days_left <= 7 THEN 'urgent' WHEN days_left <= 30 THEN 'soon' ELSE 'ok' END AS level
FROM (SELECT question_id, CAST({deadline('deadline')} - {Q_DAY} AS INT) AS days_left FROM v_questions)"""


RUNS_CTE = """WITH runs AS (SELECT user_id AS run_id, CASE event_type WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'pending' END AS status, ts, event_id
  FROM events WHERE event_id % 6 = 0),
states AS (SELECT run_id, status, '' AS error_message, (SELECT min(ts) FROM runs r WHERE r.run_id = a.run_id AND r.status = 'running') AS started_at,
    CASE WHEN status IN ('completed', 'failed') THEN ts END AS finished_at
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) AS rn FROM runs) a WHERE rn = 1)"""


def run_states() -> str:
    return f"{RUNS_CTE} SELECT * FROM states"


def latest_run() -> str:
    return f"{RUNS_CTE} SELECT * FROM states ORDER BY run_id DESC LIMIT 1"


def active_run() -> str:
    return f"{RUNS_CTE} SELECT * FROM states WHERE status IN ('queued', 'running') ORDER BY run_id DESC LIMIT 1"


def repair_counts() -> str:
    return f"""{second_pass_cte()}, best AS (SELECT repair_parent_question_id AS question_id, bool_or(is_valid) AS ok FROM again GROUP BY 1)
SELECT count(*) AS open, count(ok) AS answered, count(*) FILTER (ok) AS repaired FROM open_rows LEFT JOIN best USING (question_id)"""


def suitability_counts() -> str:
    return f"{views('extracted')} SELECT tradability, count(*) AS n FROM v_extracted GROUP BY 1"


def stage_summaries() -> str:
    parts = [
        ("ingestion", "events", "count(*)", "articles"), ("ingestion", "sources", "count(DISTINCT source)", "articles"),
        ("clustering", "clusters", "count(*)", "clusters"),
        ("extraction", "suitable", "count(*) FILTER (tradability = 'suitable')", "extracted"),
        ("extraction", "unsuitable", "count(*) FILTER (tradability <> 'suitable')", "extracted"),
        ("generation", "questions", "count(*)", "questions"), ("generation", "repairs", "count(repair_parent_question_id)", "questions"),
        ("validation", "valid", "count(*) FILTER (is_valid)", "validation"), ("validation", "failed", "count(*) FILTER (NOT is_valid)", "validation"),
        ("scoring", "scored", "count(*)", "scored"),
    ]
    arms = " UNION ALL ".join(f"SELECT '{s}' AS stage, '{m}' AS metric, {e} AS n FROM v_{v}" for s, m, e, v in parts)
    return f"{views('articles', 'clusters', 'extracted', 'questions', 'validation', 'scored')} {arms}"


# ---- dashboards -------------------------------------------------------------------------------------
REVIEW_CTE = f"""rv AS (
  SELECT s.*, q.* EXCLUDE (question_id), r.status AS review_status, {deadline('q.deadline')} AS due,
    CASE WHEN r.status IS NOT NULL THEN r.status WHEN {deadline('q.deadline')} < {Q_DAY} THEN 'expired' ELSE 'active' END AS effective_status
  FROM v_scored s JOIN v_questions q USING (question_id) LEFT JOIN v_review r USING (question_id))"""


def dashboard_queue() -> str:
    return f"""{views('scored', 'questions', 'review')}, {REVIEW_CTE}
SELECT question_id, question_text, category, total_score, deadline, review_status, effective_status,
  row_number() OVER (PARTITION BY effective_status ORDER BY total_score DESC, question_id) AS rank FROM rv"""


def filtered_queue() -> str:
    return f"""{views('scored', 'questions', 'review')}, {REVIEW_CTE}
SELECT question_id, question_text, category, total_score, deadline FROM rv WHERE effective_status = 'active' AND lower(question_text) LIKE '%price%'
  AND category IN ('finance', 'politics', 'other') AND question_type = 'binary' AND total_score >= 0.4 ORDER BY due NULLS LAST, question_id"""


def status_stats() -> str:
    return f"""{views('scored', 'questions', 'review')}, {REVIEW_CTE}
SELECT effective_status, count(*) AS n, count(DISTINCT category) AS categories, round(avg(total_score), 6) AS avg_score, round(max(total_score), 6) AS max_score,
  count(*) FILTER (question_type = 'binary') AS binary, count(*) FILTER (question_type = 'multiple_choice') AS multiple_choice FROM rv GROUP BY effective_status"""


REPAIR_CTE = """rp AS (
  SELECT q.question_id, v.flags AS validation_flags, e.confidence AS extraction_confidence, c.*,
    EXISTS (SELECT 1 FROM v_questions k WHERE k.repair_parent_question_id = q.question_id) AS has_repair_child
  FROM v_questions q JOIN v_validation v USING (question_id) JOIN v_extracted e ON e.id = q.extracted_event_id JOIN v_clusters c ON c.cluster_id = e.cluster_id
  WHERE NOT v.is_valid)"""


def repair_queue() -> str:
    return f"""{views('questions', 'validation', 'extracted', 'clusters')}, {REPAIR_CTE}
SELECT question_id, row_number() OVER (ORDER BY weighted_mention_velocity DESC NULLS LAST, mention_velocity DESC NULLS LAST, source_diversity DESC NULLS LAST,
  extraction_confidence DESC NULLS LAST, recency NULLS LAST, question_id) AS rank, validation_flags, extraction_confidence, weighted_mention_velocity
FROM rp WHERE NOT has_repair_child AND {salvageable('validation_flags')}"""


def repair_children() -> str:
    return f"""{views('questions', 'validation', 'extracted', 'clusters')}, {REPAIR_CTE} SELECT question_id, has_repair_child FROM rp"""


def review_latest() -> str:
    return """SELECT question_id, status, reason, notes, changed_at FROM (
  SELECT user_id AS question_id, CASE event_type WHEN 'click' THEN 'selected' WHEN 'error' THEN 'removed' ELSE 'active' END AS status, props AS reason,
    CAST(event_id AS VARCHAR) AS notes, ts AS changed_at, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn = 1 AND status <> 'active'"""


STAGES_CTE = """WITH log AS (SELECT user_id AS run_id, CAST(event_id % 6 + 1 AS INT) AS stage_number, 'FR' || (event_id % 6 + 1) AS stage_name,
    CASE event_type WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'pending' END AS status,
    CAST(json_extract(props, '$.k') AS DOUBLE) AS k, ts, event_id FROM events),
stages AS (SELECT run_id, stage_number, stage_name, status, (SELECT min(ts) FROM log b WHERE b.run_id = a.run_id AND b.stage_number = a.stage_number AND b.status = 'running') AS started_at,
    CASE WHEN status IN ('completed', 'failed') THEN ts END AS finished_at, least(greatest(k / CAST(100 AS DOUBLE), 0), 1) AS progress
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id, stage_number ORDER BY ts DESC, event_id DESC) AS rn FROM log) a WHERE rn = 1)"""


def run_stages() -> str:
    return f"{STAGES_CTE} SELECT * FROM stages"


def run_progress() -> str:
    return f"{STAGES_CTE} SELECT run_id, round(count(*) FILTER (status = 'completed') / CAST(count(*) AS DOUBLE), 6) AS progress FROM stages GROUP BY run_id"


# ---- discovery ------------------------------------------------------------------------------------------
def label_case(x) -> str:
    key = f"trim(lower(replace({x}, '_', ' ')))"
    arms = " ".join(f"WHEN {L(k)} THEN {L(v)}" for k, v in t.CATEGORY_ALIASES.items())
    own = " ".join(f"WHEN {L(c.lower())} THEN {L(c)}" for c in t.DISCOVERY_CATEGORIES if c.lower() not in t.CATEGORY_ALIASES)
    return f"CASE {key} {arms} {own} ELSE 'Other' END"


MARKET_CTE = f"""{REVIEW_CTE}, mk AS (
  SELECT question_id AS id, question_text AS question, {label_case('category')} AS category, question_type, total_score, deadline, CAST(due - {Q_DAY} AS INT) AS days_left,
    deadline_source, CASE WHEN is_valid THEN 'Valid' WHEN len(flags) > 0 THEN 'Needs Review' ELSE 'Unknown' END AS validation_status, flags AS warnings, review_status,
    CASE WHEN review_status = 'selected' THEN 'Tracked' WHEN due - {Q_DAY} < 0 THEN 'Expired' WHEN due - {Q_DAY} <= 14 THEN 'Ending Soon' ELSE 'Active' END AS status,
    rationale, created_at, CASE WHEN due IS NULL THEN 1 WHEN due < {Q_DAY} THEN 2 ELSE 0 END AS grp, coalesce(abs(due - {Q_DAY}), 999999) AS dist
  FROM rv LEFT JOIN v_validation USING (question_id))"""
MARKET_VIEWS = ("scored", "questions", "review", "validation")


def discovery_markets() -> str:
    return f"""{views(*MARKET_VIEWS)}, {MARKET_CTE} SELECT * EXCLUDE (rationale, created_at, grp, dist) FROM mk"""


def discovery_filter() -> str:
    return f"""{views(*MARKET_VIEWS)}, {MARKET_CTE} SELECT id, question, total_score, status FROM mk
WHERE (contains(lower(question), 'priority 1') OR contains(lower(rationale), 'priority 1') OR contains(lower(category), 'priority 1'))
  AND category = 'World News' AND question_type = 'binary' AND total_score >= 0.3 AND status = 'Active'"""


def discovery_top(order):
    return f"""{views(*MARKET_VIEWS)}, {MARKET_CTE} SELECT id, total_score, days_left, status FROM mk ORDER BY {order}, id LIMIT 20"""


def discovery_newest() -> str:
    return discovery_top("created_at DESC NULLS LAST, total_score DESC")


def discovery_ending() -> str:
    return discovery_top("grp, dist, total_score DESC")


def discovery_emerging() -> str:
    return discovery_top("total_score DESC, created_at DESC NULLS LAST, dist")


def discovery_highest() -> str:
    return discovery_top("total_score DESC, grp, dist, created_at DESC NULLS LAST")


TOPIC_VIEWS = ("extracted", "cluster_events", "articles", "questions", "scored")
TOPIC_CTE = """tp AS (
  SELECT e.id, e.cluster_id, e.event_summary, e.event_type FROM v_extracted e),
ne AS (SELECT cluster_id, count(DISTINCT event_id) AS event_count, count(DISTINCT source) AS source_count, max(timestamp) AS latest_event_at
  FROM v_cluster_events LEFT JOIN v_articles ON id = event_id GROUP BY cluster_id),
qs AS (SELECT extracted_event_id AS id, count(DISTINCT q.question_id) AS suggested_market_count, avg(total_score) AS avg_candidate_score,
  list(nullif(category, '') ORDER BY total_score DESC NULLS LAST, q.question_id)[1] AS cat, list(question_text ORDER BY total_score DESC NULLS LAST, q.question_id)[1] AS ex
  FROM v_questions q LEFT JOIN v_scored s USING (question_id) GROUP BY 1),
topics AS (SELECT id, coalesce(nullif(event_summary, ''), 'Emerging topic') AS title, event_summary AS summary, coalesce(cat, nullif(event_type, ''), 'other') AS category,
  coalesce(event_count, 0) AS event_count, coalesce(source_count, 0) AS source_count, coalesce(suggested_market_count, 0) AS suggested_market_count,
  avg_candidate_score, latest_event_at, ex AS example_question
  FROM tp LEFT JOIN ne USING (cluster_id) LEFT JOIN qs USING (id))"""


def topic_rollup() -> str:
    return f"{views(*TOPIC_VIEWS)}, {TOPIC_CTE} SELECT * REPLACE (round(avg_candidate_score, 6) AS avg_candidate_score) FROM topics"


def trend_topk() -> str:
    age = f"greatest((epoch_us({E_TIME}) - epoch_us(latest_event_at)) / CAST(86400000000 AS DOUBLE), 0)"
    return f"""{views(*TOPIC_VIEWS)}, {TOPIC_CTE} SELECT id, title, category, event_count, round(least(CAST(event_count AS DOUBLE), 20) * {D(2.2)}
  + least(CAST(source_count AS DOUBLE), 15) * {D(2)} + least(CAST(suggested_market_count AS DOUBLE), 10) * {D(2.4)} + coalesce(avg_candidate_score, 0) * {D(24)}
  + CASE WHEN latest_event_at IS NULL THEN 0 ELSE 25 - least({age}, 25) END, 1) AS trend_score FROM topics ORDER BY trend_score DESC, event_count DESC, id LIMIT 6"""


def topic_notes() -> str:
    def arms(table, show):
        return "CASE lab " + " ".join(f"WHEN {L(k)} THEN {show(v)}" for k, v in table.items() if k != "Other") + f" ELSE {show(table['Other'])} END"

    arr = lambda v: "[" + ", ".join(L(x) for x in v) + "]"
    return f"""{views(*TOPIC_VIEWS)}, {TOPIC_CTE}, lb AS (SELECT *, {label_case('category')} AS lab FROM topics)
SELECT id, trim(split_part(trim(summary), '.', 1)) || '.' AS focus_sentence, replace({arms(t.TOPIC_UNCERTAINTY, L)}, '{{t}}', lower(title)) AS what_is_uncertain,
  ['Watch whether mention velocity stays elevated beyond the current ' || event_count || '-event burst.', 'Track whether coverage broadens beyond the current ' || source_count || ' distinct sources.',
   {arms(t.TOPIC_WATCH, L)}] AS watching_points,
  CASE WHEN latest_event_at IS NULL THEN ['Near-term follow-up timing is still unclear.'] ELSE ['Near-term follow-up window: by ' || strftime(latest_event_at + INTERVAL 7 DAY, '%b %d'),
   'If the story is durable, expect a clearer milestone before ' || strftime(latest_event_at + INTERVAL 30 DAY, '%b %d')] END AS key_dates,
  {arms(t.TOPIC_SOURCES, arr)} AS data_sources, {arms(t.ADJACENT_TOPICS, arr)} AS adjacent_topics FROM lb"""


def summary_metrics() -> str:
    return f"""{views('scored', 'questions', 'review', 'validation', 'extracted')}, {MARKET_CTE}
SELECT count(*) FILTER (status <> 'Expired') AS active_markets, printf('%.1f', avg(total_score) * 100) AS average_market_score,
  count(*) FILTER (created_at >= {Q_DAY} - INTERVAL 7 DAY) AS new_this_week, (SELECT count(*) FROM v_extracted) AS emerging_topics FROM mk"""


def category_counts() -> str:
    return f"{views(*MARKET_VIEWS)}, {MARKET_CTE} SELECT category, count(*) AS n FROM mk GROUP BY category"


# ---- vectors ----------------------------------------------------------------------------------
def vec_pairs(t_) -> str:
    return f"""vp AS MATERIALIZED (SELECT a.vec_id AS a, z.vec_id AS b FROM embeddings a JOIN embeddings z ON a.vec_id < z.vec_id
  WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(z.embedding AS DOUBLE[])) >= {t_})"""


def vector_dedupe(t_=0.40) -> str:
    """A scan in order that carries the list of kept ids."""
    return f"""WITH RECURSIVE {vec_pairs(t_)},
near AS MATERIALIZED (SELECT b, list(a) AS before FROM vp GROUP BY b),
item AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rn FROM embeddings),
scan AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS kept UNION ALL
  SELECT i.rn, CASE WHEN len(list_intersect(s.kept, coalesce(n.before, []))) > 0 THEN s.kept ELSE list_append(s.kept, i.vec_id) END
  FROM scan s JOIN item i ON i.rn = s.rn + 1 LEFT JOIN near n ON n.b = i.vec_id)
SELECT unnest(kept) AS vec_id FROM (SELECT kept FROM scan ORDER BY rn DESC LIMIT 1)"""


def vector_dedupe_strict() -> str:
    return vector_dedupe(0.92)


def vector_dedupe_blocks() -> str:
    return vector_dedupe()


DBSCAN_CTE = f"""WITH RECURSIVE {vec_pairs(0.35)},
nb AS MATERIALIZED (SELECT a, b FROM vp UNION ALL SELECT b, a FROM vp),
core AS MATERIALIZED (SELECT vec_id AS v FROM embeddings LEFT JOIN nb ON nb.a = vec_id GROUP BY vec_id HAVING count(nb.b) + 1 >= 3),
reach AS (SELECT v AS root, v FROM core UNION SELECT r.root, nb.b FROM reach r JOIN nb ON nb.a = r.v JOIN core ON core.v = nb.b),
comp AS (SELECT v, min(root) AS root FROM reach GROUP BY v),
lab AS (SELECT root, dense_rank() OVER (ORDER BY root) - 1 AS label FROM (SELECT DISTINCT root FROM comp)),
cored AS (SELECT v, label FROM comp JOIN lab USING (root)),
db AS (SELECT v AS vec_id, label FROM cored UNION ALL
  SELECT nb.a, min(label) FROM nb JOIN cored ON cored.v = nb.b WHERE nb.a NOT IN (SELECT v FROM core) GROUP BY nb.a)"""


def dbscan() -> str:
    return f"{DBSCAN_CTE} SELECT vec_id, label FROM db"


def dbscan_blocks() -> str:
    return dbscan()


def dbscan_features() -> str:
    return f"""{DBSCAN_CTE}, art AS ({b.check_sql('articles')}), m AS (SELECT label AS cluster_id, art.* FROM db JOIN art ON art.id = db.vec_id),
coh AS (SELECT x.label AS cluster_id, avg(list_cosine_similarity(CAST(p.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) AS c
  FROM db x JOIN db y ON x.label = y.label AND x.vec_id < y.vec_id JOIN embeddings p ON p.vec_id = x.vec_id JOIN embeddings q ON q.vec_id = y.vec_id GROUP BY x.label)
SELECT f.*, round(coalesce(c, 0), 4) AS coherence_score FROM (SELECT cluster_id, {feature_cols()} FROM m GROUP BY cluster_id) f LEFT JOIN coh USING (cluster_id) WHERE size >= 3"""


# ---- stories ------------------------------------------------------------------------------------
def fingerprint_cte(name, rel, key, text) -> str:
    return f"""{name}_t AS (SELECT {key}, unnest(w) AS token, generate_subscripts(w, 1) AS ix FROM (SELECT {key}, {story_tokens(text)} AS w FROM {rel})),
{name} AS (SELECT {key}, list(token ORDER BY token) AS tokens FROM (
  SELECT {key}, token, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, min(ix)) AS rk FROM {name}_t GROUP BY {key}, token) WHERE rk <= 14 GROUP BY {key})"""


def token_fingerprint() -> str:
    return f"WITH {fingerprint_cte('fp', 'documents', 'doc_id', 'text')} SELECT * FROM fp"


def story_dedupe() -> str:
    queue = event_priority_queue()
    head, body = queue.split("SELECT id, priority_topic,", 1)
    text = "event_summary || ' ' || market_angle || ' ' || outcome_variable || ' ' || event_type || ' ' || array_to_string(entities, ' ')"
    inter = "CAST(len(list_intersect(a.tokens, z.tokens)) AS INTEGER)"
    return f"""{head.rstrip().rstrip(',')}, pq AS (SELECT p.*, {body.split(' AS priority_score FROM p')[0]} AS priority_score FROM p),
ord AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY priority_score DESC, weighted_mention_velocity DESC, mention_velocity DESC, confidence DESC, source_diversity DESC, recency, id) AS rn,
  list_distinct({story_tokens("array_to_string(entities, ' ')")}) AS ents FROM pq),
{fingerprint_cte('fp', 'ord', 'rn', text)},
it AS MATERIALIZED (SELECT ord.rn, tokens, len(tokens) AS n, ents, lower(event_type) AS kind FROM ord JOIN fp USING (rn)),
pr AS MATERIALIZED (SELECT ar AS a, zr AS b FROM (SELECT a.rn AS ar, z.rn AS zr, {inter} AS i, a.n AS an, z.n AS zn, a.kind = z.kind AS k, len(list_intersect(a.ents, z.ents)) AS e
    FROM it a JOIN it z ON a.rn < z.rn)
  WHERE i / CAST(an + zn - i AS DOUBLE) >= 0.42 OR (k AND e >= 2 AND (i / CAST(an + zn - i AS DOUBLE) >= 0.24 OR i / CAST(least(an, zn) AS DOUBLE) >= 0.42))
    OR (i / CAST(least(an, zn) AS DOUBLE) >= 0.6 AND e >= 1) OR (k AND i / CAST(least(an, zn) AS DOUBLE) >= 0.75)),
nr AS MATERIALIZED (SELECT b, list(a) AS before FROM pr GROUP BY b),
scan AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS kept UNION ALL
  SELECT o.rn, CASE WHEN len(list_intersect(s.kept, coalesce(nr.before, []))) > 0 THEN s.kept ELSE list_append(s.kept, o.rn) END
  FROM scan s JOIN (SELECT rn FROM ord) o ON o.rn = s.rn + 1 LEFT JOIN nr ON nr.b = o.rn)
SELECT id, priority_score FROM ord WHERE rn IN (SELECT unnest(kept) FROM (SELECT kept FROM scan ORDER BY rn DESC LIMIT 1))"""


NEAR = "(i / CAST(an + zn - i AS DOUBLE) >= 0.66 OR i / CAST(least(an, zn) AS DOUBLE) >= 0.8)"


def question_dedupe() -> str:
    """Per event, a scan by id over its own pairs."""
    return f"""{views('questions')},
it AS MATERIALIZED (SELECT question_id AS q, extracted_event_id AS ev, question_type AS kind, {aliased('question_text')} AS norm, list_distinct({story_tokens('question_text')}) AS w FROM v_questions),
pr AS MATERIALIZED (SELECT ev, a, b FROM (SELECT a.ev, a.q AS a, z.q AS b, CAST(len(list_intersect(a.w, z.w)) AS INTEGER) AS i, len(a.w) AS an, len(z.w) AS zn, a.kind = z.kind AS k, a.norm = z.norm AS same
  FROM it a JOIN it z ON a.ev = z.ev AND a.q < z.q) WHERE same OR (k AND {NEAR})),
nr AS MATERIALIZED (SELECT b, list(a) AS before FROM pr GROUP BY b),
o AS MATERIALIZED (SELECT ev, q, coalesce(before, []) AS before, row_number() OVER (PARTITION BY ev ORDER BY q) AS rn FROM it LEFT JOIN nr ON b = q),
scan AS (SELECT DISTINCT ev, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS kept FROM it UNION ALL
  SELECT o.ev, o.rn, CASE WHEN len(list_intersect(s.kept, o.before)) > 0 THEN s.kept ELSE list_append(s.kept, o.q) END FROM scan s JOIN o ON o.ev = s.ev AND o.rn = s.rn + 1)
SELECT question_id, extracted_event_id FROM v_questions WHERE question_id IN (SELECT unnest(kept) FROM (SELECT ev, arg_max(kept, rn) AS kept FROM scan GROUP BY ev))"""


def capped_story_dedupe() -> str:
    """A scan over all questions in order, carrying the accepted token sets and stories."""
    return f"""{views('questions')},
it AS MATERIALIZED (SELECT question_id AS q, extracted_event_id AS ev, list_sort(list_distinct({story_tokens('question_text')})) AS w FROM v_questions),
st AS MATERIALIZED (SELECT w, row_number() OVER (ORDER BY w) AS g, len(w) AS n FROM (SELECT DISTINCT w FROM it)),
nr AS MATERIALIZED (SELECT ag AS g, list(zg) AS near FROM (SELECT a.g AS ag, z.g AS zg, CAST(len(list_intersect(a.w, z.w)) AS INTEGER) AS i, a.n AS an, z.n AS zn FROM st a, st z WHERE a.n > 0 AND z.n > 0) WHERE {NEAR} GROUP BY ag),
o AS MATERIALIZED (SELECT q, ev, st.g, near, row_number() OVER (ORDER BY q) AS rn FROM it JOIN st USING (w) JOIN nr USING (g)),
scan AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS sets, CAST([] AS BIGINT[]) AS evs, CAST([] AS BIGINT[]) AS kept UNION ALL
  SELECT rn, CASE WHEN ok THEN list_append(sets, g) ELSE sets END, CASE WHEN ok THEN list_append(evs, ev) ELSE evs END, CASE WHEN ok THEN list_append(kept, q) ELSE kept END
  FROM (SELECT o.*, s.sets, s.evs, s.kept, len(list_intersect(s.sets, o.near)) = 0 AND len(list_filter(s.evs, lambda e: e = o.ev)) < 2 AS ok FROM scan s JOIN o ON o.rn = s.rn + 1))
SELECT question_id, extracted_event_id FROM v_questions WHERE question_id IN (SELECT unnest(kept) FROM (SELECT kept FROM scan ORDER BY rn DESC LIMIT 1))"""


# ---- feeds ----------------------------------------------------------------------------------------
# what the feed payloads hold, stated as events: (feed, title, content, source, type, url, entities, hash text, role, time, condition)
def feed_rows() -> str:
    at, day, noon = "base", "date_trunc('day', base)", "TIMESTAMP '2024-02-01 00:00:00'"
    title = "'Item ' || doc_id"
    specs = [
        ("rss", title, f"{title} || '. ' || body", "'wire_' || source", "rss", "'https://wire.example.com/' || doc_id", "''", None, "discovery", at, "true"),
        ("gdelt", "body", "body", "source", "gdelt", "'https://n.example.com/' || doc_id", "''", None, "discovery", at, "true"),
        ("reddit", title, f"{title} || '. ' || body", "'reddit'", "social", "'https://reddit.com/r/x/' || doc_id", "''", None, "attention", at, "true"),
        ("hackernews", "body", "body", "'hackernews'", "social", "''", "''", None, "attention", at, "doc_id % 2 = 0"),
        ("wikipedia", "'Page ' || doc_id", "'Wikipedia attention spike: Page ' || doc_id || ' received ' || format('{:,}', doc_id * 37 % 50000) || ' pageviews'", "'wikipedia'", "social",
         "'https://en.wikipedia.org/wiki/Page_' || doc_id", "''", "'wiki-Page ' || doc_id || '-2024/01/31'", "attention", f"{noon} - INTERVAL 1 DAY", "doc_id * 37 % 50000 >= 10000"),
        ("federal_register", title, f"'[Rule] ' || {title} || '. ' || body || ' (Agencies: EPA, SEC)'", "'federal_register'", "official", "'https://fr.example.com'", "'EPA, SEC'", None, "resolution", day, "true"),
        ("congress", title, f"'[HR' || doc_id || ', 118th Congress] ' || {title} || '. Latest action: ' || body", "'congress'", "official", "'https://bill.example.com'", "''", None, "resolution", day, "true"),
        ("sec_edgar", title, f"'[SEC 8-K] ' || {title} || '. ' || body", "'sec_edgar'", "official", "'https://sec.example.com/' || doc_id", "''", None, "resolution", at, "true"),
        ("bls", "'Unemployment Rate — May 2024'", "'BLS Unemployment Rate: ' || doc_id || ' (May 2024)'", "'bls'", "official", "'https://data.bls.gov/timeseries/LNS14000000'", "''", "'bls-LNS14000000-2024-May'", "resolution", noon, "true"),
        ("fred", f"'Unemployment Rate — ' || strftime({day}, '%Y-%m-%d')", f"'FRED Unemployment Rate: ' || doc_id || ' (as of ' || strftime({day}, '%Y-%m-%d') || ')'", "'fred'", "official",
         "'https://fred.stlouisfed.org/series/UNRATE'", "''", f"'fred-UNRATE-' || strftime({day}, '%Y-%m-%d')", "resolution", day, "true"),
        ("eia", f"'OTHER — ' || strftime({day}, '%Y-%m-%d')", f"'EIA OTHER: ' || doc_id || ' (period: ' || strftime({day}, '%Y-%m-%d') || ')'", "'eia'", "official",
         "'https://www.eia.gov/opendata/browser/?id=OTHER'", "''", f"'eia-OTHER-' || strftime({day}, '%Y-%m-%d')", "resolution", day, "true"),
        ("polymarket", "body", "body", "'polymarket'", "market", "'https://polymarket.com/event/' || doc_id", "''", None, "discovery", at, "true"),
        ("kalshi", title, f"{title} || '. ' || body || ' [Category: Politics]'", "'kalshi'", "market", "'https://kalshi.com/markets/' || doc_id", "''", None, "benchmark", at, "doc_id % 3 <> 0"),
    ]
    parts = [
        f"SELECT '{feed}' AS feed, {ti} AS title, {co} AS content, {so} AS source, '{ty}' AS source_type, {u} AS url, {en} AS entities, "
        f"sha256(lower(trim({ha or co}))) AS content_hash, '{ro}' AS signal_role, CAST({when} AS TIMESTAMP) AS timestamp FROM docs WHERE doc_id % 13 = {i} AND {cond}"
        for i, (feed, ti, co, so, ty, u, en, ha, ro, when, cond) in enumerate(specs)
    ]
    return rf"""WITH docs AS (SELECT doc_id, source, trim(regexp_replace(text, '[\s\x0b\x00-\x1f\x7f]+', ' ', 'g')) AS body, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS base FROM documents),
fe AS ({' UNION ALL '.join(parts)})"""


def feed_events() -> str:
    return f"{feed_rows()} SELECT * FROM fe"


def feed_counts() -> str:
    names = "['rss','gdelt','reddit','hackernews','wikipedia','federal_register','congress','sec_edgar','bls','fred','eia','polymarket','kalshi']"
    return f"""{feed_rows()}, p AS (SELECT {names}[doc_id % 13 + 1] AS feed, count(*) AS payloads, count(*) FILTER (doc_id % 13 = 12 AND doc_id % 3 = 0) AS rejected FROM documents GROUP BY 1)
SELECT p.feed, payloads, rejected, coalesce(events, 0) AS events FROM p LEFT JOIN (SELECT feed, count(*) AS events FROM fe GROUP BY feed) USING (feed)"""


DOC_HASH = r"sha256(lower(regexp_replace(regexp_replace(text, '^[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ''), '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '')))"


def exact_dedupe() -> str:
    return f"""SELECT doc_id, source, content_hash FROM (SELECT doc_id, source, {DOC_HASH} AS content_hash, row_number() OVER (PARTITION BY {DOC_HASH} ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1"""


def ingest_counts() -> str:
    return f"""WITH h AS (SELECT doc_id, source, row_number() OVER (PARTITION BY {DOC_HASH} ORDER BY doc_id) AS rn FROM documents)
SELECT source, count(*) AS fetched, count(*) FILTER (rn = 1) AS new, count(*) FILTER (rn > 1) AS deduplicated FROM h GROUP BY source"""


def windowed_velocity() -> str:
    return f"""SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS window_start, event_type AS source, count(*) AS mentions,
  sum({in_map('event_type', t.SOURCE_WEIGHTS, t.DEFAULT_SOURCE_WEIGHT)}) AS weighted_mentions, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2"""


def stream_ingest() -> str:
    return exact_dedupe()


def stream_velocity() -> str:
    return windowed_velocity()


def stream_gate() -> str:
    return gate_flags()


def stream_score() -> str:
    return scored_rank()


def review_store() -> str:
    return review_latest()


def run_store() -> str:
    return run_stages()


def sink_extracted() -> str:
    return f"{views('extracted')} SELECT * FROM v_extracted"


def sink_questions() -> str:
    return f"{views('questions')} SELECT * FROM v_questions"


def sink_validation() -> str:
    return f"{views('questions', 'validation')} SELECT * FROM v_validation"


def sink_scored() -> str:
    return f"{views('scored')} SELECT * FROM v_scored"


# ---- text and URL scans -------------------------------------------------------------------------------
def url_parts() -> str:
    home = homepage("u.url", "bare")
    return f"""WITH u AS (SELECT page_id, pages.url AS raw, {url_cols('pages.url')} FROM pages), w AS (SELECT *, regexp_replace(path, '^/+|/+$', '', 'g') AS bare FROM u)
SELECT page_id, u.url AS link, host, path, {home} AS homepage, {any_of('lower(raw)', t.TRUSTED_DOMAINS)} AS trusted,
  CASE WHEN {home} THEN {D(.2)} WHEN {any_of('lower(host)', t.STRONG_HOSTS)} THEN {D(1)} WHEN {any_of('lower(path)', t.STRONG_PATHS)} THEN {D(1)}
    WHEN {one_of('lower(host)', t.WEAK_NEWS_HOSTS)} THEN {D(.2)} WHEN {any_of(plain('raw'), t.WEAK_SOURCE_TEXT)} THEN {D(.2)} ELSE {D(.6)} END AS strength,
  CASE WHEN u.url <> '' THEN replace(host, 'www.', '') WHEN length(trim(raw)) > 55 THEN substring(trim(raw), 1, 55) || '...' ELSE trim(raw) END AS label FROM w u"""


def pii_scan() -> str:
    # word boundaries written out, as letters of every script count as word characters
    lead, tail = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
    pats = [lead + r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}" + tail, lead + r"\d{3}[-.\s]?\d{3}[-.\s]?\d{4}" + tail, lead + r"\d{3}-\d{2}-\d{4}" + tail]
    return f"SELECT doc_id, {rx_any('text', pats)} AS pii FROM documents"


def garbled_scan() -> str:
    blocked_ = rx("lower(text)", r"(?:^|[^\p{L}\p{N}_])(?:" + esc(t.BLOCKED_TERMS) + ")")
    return f"SELECT doc_id, {garbled('text')} AS garbled, {blocked_} AS blocked FROM documents"


def display_values() -> str:
    d = "question_id % 40 - 3"
    return f"""{views('scored')} SELECT question_id, CASE WHEN total_score >= 0.75 THEN 'high' WHEN total_score >= 0.55 THEN 'good' WHEN total_score >= 0.4 THEN 'fair' ELSE 'low' END AS band,
  CAST(round_even(total_score * 100, 0) AS INT) || '%' AS pct, CAST(CAST(round_even(total_score * 100, 0) AS INT) AS VARCHAR) AS points,
  CASE WHEN {d} < 0 THEN 'Expired' WHEN {d} = 0 THEN 'Today' ELSE ({d}) || 'd left' END AS chip FROM v_scored"""


# ---- inference tables -----------------------------------------------------------------------------------
EVENT_ERROR = """CASE id % 10 WHEN 1 THEN 'missing: time_horizon' WHEN 2 THEN 'not allowed: event_type' WHEN 3 THEN 'out of range: confidence'
  WHEN 4 THEN 'extra keys: note' WHEN 5 THEN 'not a JSON object' WHEN 6 THEN 'too short: event_summary' WHEN 7 THEN 'too few: entities' END"""


def event_contract() -> str:
    return f"{views('extracted')} SELECT id, {EVENT_ERROR} AS error FROM v_extracted"


def event_response_rows() -> str:
    return f"""{views('extracted')} SELECT id, event_summary, entities, event_type, 'the ' || outcome_variable AS outcome_variable, tradability, confidence,
  contradiction_flag, resolution_hints FROM v_extracted WHERE {EVENT_ERROR} IS NULL"""


def event_retries() -> str:
    return f"""{views('extracted')} SELECT id, 'Your previous response had a validation error:' || chr(10) || {EVENT_ERROR} || chr(10) || chr(10)
  || 'Please fix the JSON and respond again. Original request:' || chr(10) || chr(10) || 'prompt ' || id AS prompt FROM v_extracted WHERE {EVENT_ERROR} IS NOT NULL"""


def question_error() -> str:
    checks = []
    for name, (low, high) in t.QUESTION_STRING_FIELDS.items():
        if name == "resolution_confidence_reason":
            continue
        checks.append(f"CASE WHEN length({name}) < {low} THEN 'too short: {name}' END")
        if high is not None:
            checks.append(f"CASE WHEN length({name}) > {high} THEN 'too long: {name}' END")
    checks.append("CASE WHEN len(options) < 2 THEN 'too few: options' WHEN len(options) > 5 THEN 'too many: options' END")
    return f"coalesce({', '.join(checks)})"


def question_contract() -> str:
    return f"{views('questions')} SELECT question_id, {question_error()} AS error FROM v_questions"


def question_response_rows() -> str:
    return f"""{views('questions')} SELECT question_id, CAST(0 AS INT) AS item, question_text, category, options, deadline, resolution_confidence FROM v_questions
WHERE {question_error()} IS NULL"""


NL = "chr(10)"


def extraction_prompts() -> str:
    from .operators.prompts import EXTRACTION_HEAD, EXTRACTION_TAIL

    head, tail = [f"replace({L(x)}, '@', {NL})" for x in (EXTRACTION_HEAD.replace("\n", "@"), EXTRACTION_TAIL.replace("\n", "@"))]
    return f"""{views('labelled_members')}, m AS (SELECT * FROM v_labelled_members),
r AS (SELECT cluster_id, string_agg(signal_role || ': ' || n, ', ' ORDER BY signal_role) AS mix FROM (SELECT cluster_id, signal_role, count(*) AS n FROM m GROUP BY ALL) GROUP BY cluster_id),
f AS (SELECT cluster_id, {feature_cols()} FROM m GROUP BY cluster_id),
h AS (SELECT cluster_id, string_agg('- ' || content, {NL} ORDER BY rn) AS bullets FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY timestamp DESC, id) AS rn FROM m) WHERE rn <= 20 GROUP BY cluster_id),
s AS (SELECT cluster_id, string_agg(source, ', ' ORDER BY source) AS sources FROM (SELECT DISTINCT cluster_id, source FROM m) GROUP BY cluster_id)
SELECT f.cluster_id, replace({head}, '{{n}}', CAST(size AS VARCHAR)) || bullets || {NL} || {NL} || 'Sources: ' || sources || {NL} || {NL} || 'Cluster Metadata:' || {NL}
  || '- Mention velocity: ' || printf('%.2f', mention_velocity) || ' events/hour' || {NL} || '- Source diversity: ' || source_diversity || ' unique sources' || {NL}
  || '- Recency: ' || printf('%.1f', recency) || ' hours since latest item' || {NL} || '- Source role mix: ' || mix
  || {NL} || '- Weighted velocity (official sources count more): ' || printf('%.2f', weighted_mention_velocity) || {tail} AS prompt
FROM f JOIN r USING (cluster_id) JOIN h USING (cluster_id) JOIN s USING (cluster_id) WHERE size >= 3"""


def section(title, x) -> str:
    return f"{L(title + ':')} || {NL} || {x}"


def stacked(*parts) -> str:
    return f" || {NL} || {NL} || ".join(f"({p})" for p in parts)


def generation_prompts() -> str:
    from .operators.prompts import ELECTION_CATEGORY, ELECTION_SOURCE, GEOPOLITICS_SOURCE

    lines = ", ".join([
        "'Event type: ' || event_type", f"CASE WHEN event_type = 'election' THEN {L(ELECTION_CATEGORY)} END", f"CASE WHEN event_type = 'election' THEN {L(ELECTION_SOURCE)} END",
        f"CASE WHEN event_type = 'geopolitics' THEN {L(GEOPOLITICS_SOURCE)} END", "'Outcome variable: ' || outcome_variable",
        "'Candidate deadlines: ' || array_to_string(candidate_deadlines, ', ')", "'Sources that can settle it: ' || array_to_string(resolution_sources, ', ')",
        "'Market angle: ' || market_angle",
        "CASE WHEN confidence < 0.5 THEN 'Caution: the event was read with low confidence (' || printf('%.2f', confidence) || ')' END",
        "CASE WHEN contradiction_flag THEN 'Caution: the sources disagree: ' || contradiction_details END",
    ])
    body = stacked(
        section("TODAY'S DATE", L(b.AS_OF_QUESTIONS)), section("EVENT SUMMARY", "event_summary"), section("KEY ENTITIES", "array_to_string(entities, ', ')"),
        section("EXPECTED TIME HORIZON", "time_horizon"), section("WHAT IS KNOWN OF THE EVENT", f"concat_ws({NL}, {lines})"),
        section("OUTCOMES TO LOOK FOR", f"'- ' || array_to_string(resolution_hints, {NL} || '- ')"),
    )
    return f"{views('extracted')} SELECT id, {body} AS prompt FROM v_extracted WHERE tradability <> 'unsuitable'"


def repair_prompts() -> str:
    body = stacked(
        section("TODAY'S DATE", L(b.AS_OF_QUESTIONS)), section("ORIGINAL QUESTION", "question_text"), section("ORIGINAL TYPE", "question_type"),
        section("ORIGINAL OPTIONS", "'[''' || array_to_string(options, ''', ''') || ''']'"), section("ORIGINAL DEADLINE", "deadline"),
        section("ORIGINAL DEADLINE SOURCE", "deadline_source"), section("ORIGINAL RESOLUTION SOURCE", "resolution_source"),
        section("ORIGINAL RESOLUTION CRITERIA", "resolution_criteria"), section("FLAGS TO MEND", "array_to_string(flags, ', ')"),
        section("EVENT SUMMARY", "event_summary"), section("KEY ENTITIES", "array_to_string(entities, ', ')"), section("EXPECTED TIME HORIZON", "time_horizon"),
        section("POSSIBLE DEADLINES", "array_to_string(candidate_deadlines, ', ')"),
        section("SOURCES THAT CAN SETTLE IT", "array_to_string(resolution_sources, ', ')"), section("MARKET ANGLE", "market_angle"),
    )
    return f"""{views('questions', 'validation', 'extracted')} SELECT q.question_id, {body} AS prompt
FROM v_questions q JOIN v_validation v USING (question_id) JOIN v_extracted e ON e.id = q.extracted_event_id
WHERE NOT is_valid AND {salvageable('flags')} AND NOT EXISTS (SELECT 1 FROM v_questions k WHERE k.repair_parent_question_id = q.question_id)"""

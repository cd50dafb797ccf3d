"""Batch inference and the checks of its structured responses.

`infer` maps a table of prompts to a table of response texts; everything after it is expressions.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import terms as t
from ..functions.text import let, strip

EVENT_SCHEMA = (
    "event_summary STRING, entities ARRAY<STRING>, event_type STRING, outcome_variable STRING, candidate_deadlines ARRAY<STRING>, "
    "resolution_sources ARRAY<STRING>, tradability STRING, rejection_reason STRING, confidence DOUBLE, market_angle STRING, "
    "contradiction_flag BOOLEAN, contradiction_details STRING, time_horizon STRING, resolution_hints ARRAY<STRING>"
)
QUESTION_SCHEMA = (
    "question_text STRING, category STRING, question_type STRING, options ARRAY<STRING>, deadline STRING, deadline_source STRING, "
    "resolution_source STRING, resolution_criteria STRING, rationale STRING, resolution_confidence DOUBLE, "
    "resolution_confidence_reason STRING, source_independence DOUBLE, timing_reliability DOUBLE, already_resolved BOOLEAN"
)
REASK = "Your previous response had a validation error:\n{e}\n\nPlease fix the JSON and respond again. Original request:\n\n{p}"


def infer(prompts: DataFrame, respond: Callable[[list[str]], list[str]], prompt: str = "prompt") -> DataFrame:
    """Add `response`. `respond` is the caller's model: a batch of prompts to as many texts."""
    schema = ", ".join(f"{n} {ty}" for n, ty in prompts.dtypes) + ", response string"

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(response=respond(pdf[prompt].tolist()))

    return prompts.mapInPandas(run, schema)


def embed(rows: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], text: str, batch: int = 32) -> DataFrame:
    """Add `embedding`. `load` builds the caller's encoder once per task; texts go to it in batches."""
    schema = ", ".join(f"{n} {ty}" for n, ty in rows.dtypes) + ", embedding array<double>"

    def run(batches: Iterator[pd.DataFrame]):
        encode = load()
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield part.assign(embedding=[[float(v) for v in e] for e in encode(part[text].tolist())])

    return rows.mapInPandas(run, schema)


def unfenced(c) -> Column:
    """JSON text out of an optional code fence: the first line and everything from the last fence go."""
    s = strip(c)
    inner = F.regexp_replace(F.regexp_replace(s, r"(?s)^```[^\n]*\n", ""), r"(?s)```(?!.*```).*$", "")
    return F.when(s.startswith("```"), inner).otherwise(s)




def _member(root, name: str, as_type: str) -> Column:
    """Type and value of a JSON member, read once; the type is null when it is absent."""
    return F.struct(
        F.schema_of_variant(F.variant_get(root, f"$.{name}", "variant")).alias("kind"),
        F.try_variant_get(root, f"$.{name}", as_type).alias("value"),
    )


def _type_of(root, name: str) -> Column:
    return F.schema_of_variant(F.variant_get(root, f"$.{name}", "variant"))


def _string_error(root, name: str, low: int, high: int | None) -> Column:
    def check(m):
        out = (F.when(m["kind"].isNull(), F.lit(f"missing: {name}")).when(m["kind"] != "STRING", F.lit(f"type: {name}"))
               .when(F.length(m["value"]) < low, F.lit(f"too short: {name}")))
        return out if high is None else out.when(F.length(m["value"]) > high, F.lit(f"too long: {name}"))

    return let(_member(root, name, "string"), check)


def _enum_error(root, name: str, values: list[str]) -> Column:
    return F.when(~F.try_variant_get(root, f"$.{name}", "string").isin(values), F.lit(f"not allowed: {name}"))


def _number_error(root, name: str) -> Column:
    numeric = "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"
    return let(_member(root, name, "double"), lambda m: (
        F.when(m["kind"].isNull(), F.lit(f"missing: {name}")).when(~m["kind"].rlike(numeric), F.lit(f"type: {name}"))
        .when(~m["value"].between(0.0, 1.0), F.lit(f"out of range: {name}"))))


def _flag_error(root, name: str) -> Column:
    return let(_type_of(root, name), lambda k: F.when(k.isNull(), F.lit(f"missing: {name}")).when(k != "BOOLEAN", F.lit(f"type: {name}")))


def _list_error(root, name: str, low: int, high: int | None, required: bool, item: tuple[int, int] | None = None) -> Column:
    """A list of strings with bounded length, and items of bounded length."""
    def check(m):
        out = F.when(m["kind"].isNull(), F.lit(f"missing: {name}") if required else F.lit(None).cast("string"))
        out = out.when(~m["kind"].isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(f"type: {name}"))
        out = out.when(F.size(m["value"]) < low, F.lit(f"too few: {name}"))
        if high is not None:
            out = out.when(F.size(m["value"]) > high, F.lit(f"too many: {name}"))
        if item is not None:
            out = out.when(F.exists(m["value"], lambda o: ~F.length(o).between(*item)), F.lit(f"item length: {name}"))
        return out

    return let(_member(root, name, "array<string>"), check)


def _extra_error(json: Column, allowed: list[str]) -> Column:
    keys = F.filter(F.json_object_keys(json), lambda k: ~k.isin(allowed))
    return F.when(F.size(F.coalesce(keys, F.array().cast("array<string>"))) > 0,
                  F.concat(F.lit("extra keys: "), F.array_join(F.array_sort(keys), ", ")))


def _first(checks: list[Column]) -> Column:
    return F.coalesce(*checks)


def _parsed(json) -> Column:
    """The text and its JSON value; the value is null unless the text is one JSON object.

    The parser stops at the end of the first value; set inside a list and inside an object, a text
    with anything after its value breaks one of the two.
    """
    json = F.col(json)
    in_list = F.try_parse_json(F.concat(F.lit("["), json, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), json, F.lit("}")))
    v = F.when(in_list.isNotNull(), F.try_variant_get(in_object, "$.v", "variant"))
    return F.struct(json.alias("json"), v.alias("v"))


def _whole(v: Column) -> Column:
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return F.when(~is_object, F.lit("not a JSON object"))


def _checked(responses: DataFrame, error: Callable[[Column, Column], Column]) -> DataFrame:
    """Add `json` and `error`. The response is parsed once, also where a filter on `error` is moved."""
    df = responses.withColumn("json", unfenced("response"))
    return df.withColumn("error", let(_parsed("json"), lambda p: error(p["json"], p["v"])))


def event_contract(responses: DataFrame) -> DataFrame:
    """Check event responses; `error` is null for those that meet the contract."""
    allowed = [*t.EVENT_STRING_FIELDS, *t.EVENT_LIST_FIELDS, "confidence", "contradiction_flag"]

    def error(json, v):
        checks = [_whole(v)] + [_string_error(v, name, low, high) for name, (low, high) in t.EVENT_STRING_FIELDS.items()]
        checks += [_enum_error(v, "event_type", t.EVENT_TYPES), _enum_error(v, "tradability", ["suitable", "unsuitable"])]
        checks += [_list_error(v, n, low, None, req) for n, (low, req) in t.EVENT_LIST_FIELDS.items()]
        checks += [_number_error(v, "confidence"), _flag_error(v, "contradiction_flag"), _extra_error(json, allowed)]
        return _first(checks)

    return _checked(responses, error)


def event_rows(checked: DataFrame) -> DataFrame:
    """Rows of accepted event responses, with defaults for what is optional."""
    d = F.from_json("json", EVENT_SCHEMA)
    rows = checked.where(F.col("error").isNull()).withColumn("d", d)
    empty = F.array().cast("array<string>")
    keep = [c for c in checked.columns if c not in ("json", "error")]
    return rows.select(
        *keep, "d.event_summary", "d.entities", F.coalesce("d.event_type", F.lit("other")).alias("event_type"),
        F.coalesce("d.outcome_variable", F.lit("")).alias("outcome_variable"), F.coalesce("d.candidate_deadlines", empty).alias("candidate_deadlines"),
        F.coalesce("d.resolution_sources", empty).alias("resolution_sources"), F.coalesce("d.tradability", F.lit("suitable")).alias("tradability"),
        F.coalesce("d.rejection_reason", F.lit("")).alias("rejection_reason"), F.coalesce("d.confidence", F.lit(0.5)).alias("confidence"),
        F.coalesce("d.market_angle", F.lit("")).alias("market_angle"), F.coalesce("d.contradiction_flag", F.lit(False)).alias("contradiction_flag"),
        F.coalesce("d.contradiction_details", F.lit("")).alias("contradiction_details"), F.coalesce("d.time_horizon", F.lit("")).alias("time_horizon"),
        F.coalesce("d.resolution_hints", empty).alias("resolution_hints"),
    )


def _question_fits(q) -> Column:
    """True only where no check of a question can fail: all its fields of the right type and no others, read at once."""
    kinds = {n: "STRING" for n in t.QUESTION_STRING_FIELDS} | {n: r"(BIGINT|DOUBLE|FLOAT|DECIMAL\([0-9,]+\))" for n in t.QUESTION_NUMBER_FIELDS}
    kinds |= {"options": "ARRAY<STRING>", "already_resolved": "BOOLEAN"}
    shape = "^OBJECT<" + ", ".join(f"{n}: {kinds[n]}" for n in sorted(kinds)) + ">$"
    types = {n: "double" for n in t.QUESTION_NUMBER_FIELDS} | {"options": "array<string>", "already_resolved": "boolean"}
    fields = F.try_variant_get(q, "$", "struct<" + ", ".join(f"{n}: {types.get(n, 'string')}" for n in kinds) + ">")

    def within(v):
        out = v["category"].isin(t.QUESTION_CATEGORIES) & v["question_type"].isin(t.QUESTION_TYPES)
        for name, (low, high) in t.QUESTION_STRING_FIELDS.items():
            out = out & (F.length(v[name]) >= low)
            out = out if high is None else out & (F.length(v[name]) <= high)
        for name in t.QUESTION_NUMBER_FIELDS:
            out = out & v[name].between(0.0, 1.0)
        return out & F.size(v["options"]).between(2, 5) & F.forall(v["options"], lambda o: F.length(o).between(1, 200))

    return F.schema_of_variant(q).rlike(shape) & let(fields, within)


def question_contract(responses: DataFrame) -> DataFrame:
    """Check question responses: a list of 1 to 5 items, each within its bounds."""
    def item_error(q):
        # which check fails is asked only where one can
        return F.when(~F.coalesce(_question_fits(q), F.lit(False)), first_error(q))

    def first_error(q):
        checks = [F.when(~F.schema_of_variant(q).startswith("OBJECT"), F.lit("type: question"))]
        checks += [_string_error(q, name, low, high) for name, (low, high) in t.QUESTION_STRING_FIELDS.items()]
        checks += [_enum_error(q, "category", t.QUESTION_CATEGORIES), _enum_error(q, "question_type", t.QUESTION_TYPES)]
        checks.append(_list_error(q, "options", 2, 5, True, (1, 200)))
        checks += [_number_error(q, n) for n in t.QUESTION_NUMBER_FIELDS] + [_flag_error(q, "already_resolved")]
        allowed = [*t.QUESTION_STRING_FIELDS, "options", *t.QUESTION_NUMBER_FIELDS, "already_resolved"]
        return _first([*checks, _extra_error(F.to_json(q), allowed)])

    def error(json, v):
        outer = lambda items: _first([
            F.when(items.isNull(), F.lit("type: questions")), F.when(F.size(items) < 1, F.lit("too few: questions")),
            F.when(F.size(items) > 5, F.lit("too many: questions")), _extra_error(json, ["questions"]),
            F.try_element_at(F.array_compact(F.transform(items, item_error)), F.lit(1)),
        ])
        missing = F.when(_type_of(v, "questions").isNull(), F.lit("missing: questions"))
        return _first([_whole(v), missing, let(F.try_variant_get(v, "$.questions", "array<variant>"), outer)])

    return _checked(responses, error)


def question_rows(checked: DataFrame) -> DataFrame:
    """One row per question of the accepted responses, `item` being its place in the list."""
    d = F.from_json("json", f"questions ARRAY<STRUCT<{QUESTION_SCHEMA.replace(' STRING', ': STRING').replace(' ARRAY', ': ARRAY').replace(' DOUBLE', ': DOUBLE').replace(' BOOLEAN', ': BOOLEAN')}>>")
    keep = [c for c in checked.columns if c not in ("json", "error")]
    # a filter on the error, or one that an inner explode brings along, would check and read every response again
    items = F.when(F.col("error").isNull(), d["questions"])
    return checked.select(*keep, F.posexplode_outer(items).alias("item", "d")).where(F.col("item").isNotNull()).select(*keep, "item", "d.*")


def retry_set(checked: DataFrame, attempt: int, prompt: str = "prompt", retries: int = 2) -> DataFrame:
    """Prompts to ask again, with the error (cut at 500 characters) put in front; none after `retries`."""
    e = F.when(F.length("error") > 500, F.concat(F.substring("error", 1, 500), F.lit("..."))).otherwise(F.col("error"))
    again = F.replace(F.replace(F.lit(REASK), F.lit("{e}"), e), F.lit("{p}"), F.col(prompt))
    rows = checked.where(F.col("error").isNotNull()).withColumn(prompt, again).drop("response", "json", "error")
    return rows if attempt < retries else rows.limit(0)


def answer(prompts: DataFrame, respond, check: Callable[[DataFrame], DataFrame], retries: int = 2) -> tuple[DataFrame, DataFrame]:
    """Ask, check, and re-ask what failed. Returns (accepted, failed)."""
    from .durable import written

    accepted, asked, first = None, prompts.withColumn("_asked", F.col("prompt")), "_asked"
    for attempt in range(retries + 1):
        checked = written(check(infer(asked, respond)))
        good = checked.where(F.col("error").isNull())
        accepted = good if accepted is None else accepted.unionByName(good)
        bad = checked.where(F.col("error").isNotNull())
        if attempt == retries:
            return accepted.drop(first), bad.drop(first)
        asked = retry_set(bad.withColumn("prompt", F.col(first)), attempt, retries=retries)

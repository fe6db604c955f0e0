"""Model calls as table jobs: prompts and requests in, answers out; the call itself is the user's function."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark import rules, schemas
from leadspark.functions.columns import answer_text, day_part, or_blank, quarter_hours, recovery_text, shorten, without_fence_line, without_fences

DEFAULT_TEMPLATE = "Assess this record for group lodging demand.\nSource: %s\nTitle: %s\nLocation: %s\nValue (CAD): %s\nIssued: %s\nDetails: %s\nLink: %s"
#: Prompt templates by kind of source, in own words; a table of (source, template) may replace them.
TEMPLATES = {
    "permits": "A building permit was issued. Which crews will come from out of town, how many people and for how long?\nPermit: {title}\nAddress: {location}\nDeclared value (CAD): {value}\nIssued: {issued_at}\n{description}",
    "productions": "A film or television production is listed. Estimate the visiting crew and the length of its stay.\nProduction: {title}\nBase: {location}\nStart: {issued_at}\n{description}",
    "venue": "A venue announces an event. How many visitors will need rooms nearby?\nEvent: {title}\n{description}\nLink: {source_url}",
    "events": "A business event is listed. How many attendees will travel to it?\nEvent: {title}\n{description}\nLink: {source_url}",
    "awards": "A public contract was awarded. Will the contractor bring crews from elsewhere?\nContract: {title}\nPlace: {location}\nValue (CAD): {value}\nAwarded: {issued_at}\n{description}",
    "news": "A news item names a project. Is there demand for group lodging in it?\nHeadline: {title}\n{description}\nLink: {source_url}",
}
OUTREACH_TEMPLATE = "Draft a short first message to the contact of this lead.\nTitle: %s\nLocation: %s\nType: %s\nTiming: %s"
RATIONALE_TEMPLATE = "Project: %s. Type: %s. Location: %s. Crew Size: %d. Duration Months: %d. Priority Score: %d. Value: %d."


def template_table(spark: SparkSession, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """The templates as the small table that ``with_prompt`` joins."""
    return spark.createDataFrame(list(templates.items()), "source string, template string")


def with_prompt(projects: DataFrame, templates: DataFrame, default: str = DEFAULT_TEMPLATE) -> DataFrame:
    """Prompt of every record from the template of its source; {title}-style marks are filled in."""
    joined = projects.join(F.broadcast(templates.select("source", "template")), "source", "left")
    fields = ("source", "title", "location", "value", "issued_at", "description", "source_url")
    text = F.col("template")
    for name in fields:
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(F.col(name).cast("string"), F.lit("")))
    plain = F.format_string(default, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields])
    return joined.withColumn("prompt", F.coalesce(text, plain)).drop("template")


def request(prompt: Column | str, system: str) -> Column:
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.to_json(F.struct(F.array(message("system", F.lit(system)), message("user", or_blank(prompt))).alias("messages")))


def conversation_requests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, request: the turns of each conversation in order as a message list."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    folded = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), ordered.alias("m"))
    return folded.select("conv_id", "n_turns", F.to_json(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))).alias("request"))


def outreach_prompt(leads: DataFrame) -> DataFrame:
    return leads.withColumn("prompt", F.format_string(OUTREACH_TEMPLATE, *[or_blank(c) for c in ("title", "location", "project_type", "suggested_outreach_timing")]))


def rationale_prompt(leads: DataFrame) -> DataFrame:
    return leads.withColumn("prompt", F.format_string(RATIONALE_TEMPLATE, or_blank("title"), or_blank("project_type"), or_blank("location"), "estimated_crew_size", "estimated_duration_months", "priority_score", "project_value"))


def with_rationale(leads: DataFrame, answers: DataFrame) -> DataFrame:
    """The answer cut at a word to 280 characters; no answer leaves it empty."""
    text = answers.where("status = 'ok'").select("id", shorten("response").alias("_a"))
    return leads.join(text, "id", "left").withColumn("rationale", F.coalesce("_a", F.lit(""))).drop("_a")


def alert_prompt(events: DataFrame, now: Column) -> DataFrame:
    minutes = (F.unix_timestamp(now) - F.unix_timestamp("started_at")) / 60
    rate = F.when(F.col("flights_scheduled") > 0, F.col("flights_cancelled") / F.col("flights_scheduled") * 100).otherwise(F.lit(0.0))
    hours = (F.unix_timestamp("recovery_eta") - F.unix_timestamp(now)) / 3600
    text = F.format_string(
        "Cause: %s\nState: %s\nScore: %.1f\nDuration: %d min\nCancelled: %.1f%% (%d/%d)\nStranded: %d\nTime of day: %s\nRecovery: %s",
        "cause", "alert_state", "sps", F.coalesce(quarter_hours(minutes), F.lit(0)), rate, "flights_cancelled", "flights_scheduled", "est_stranded", day_part(F.hour(now)), recovery_text(hours),
    )
    return events.withColumn("prompt", text)


def alert_copy(events: DataFrame, answers: DataFrame) -> DataFrame:
    """Generated copy, or the fixed actions where there is none."""
    text = answers.where("status = 'ok'").select("id", F.col("response").alias("_a"))
    return events.join(text, "id", "left").withColumn("copy", F.coalesce(F.nullif("_a", F.lit("")), F.lit("• " + "\n• ".join(rules.ALERT_ACTIONS)))).drop("_a")


class RetryableError(Exception):
    """A failed connection or a server error; one more try is made."""


def call_model(requests: DataFrame, call: Callable[[str], str], pause_s: float = 2.0) -> DataFrame:
    """id, response, status, latency_ms, attempts of every request row (id, request).

    Failures are rows. Write the result before using it, or a repeated task calls again.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for ident, body in zip(frame["id"], frame["request"], strict=True):
                began, attempts, response, status = time.monotonic(), 0, None, "error"
                while attempts < 2 and status != "ok":
                    attempts += 1
                    try:
                        response, status = call(body), "ok"
                    except RetryableError:
                        time.sleep(pause_s if attempts < 2 else 0)
                    except Exception:
                        break
                out.append((str(ident), response, status, int(1000 * (time.monotonic() - began)), attempts))
            yield pd.DataFrame(out, columns=["id", "response", "status", "latency_ms", "attempts"])

    return requests.select(F.col("id").cast("string"), "request").mapInPandas(run, "id string, response string, status string, latency_ms bigint, attempts int")


def no_model(_: str) -> str:
    """Stand-in that answers nothing."""
    return ""


def parse_answers(answers: DataFrame, response: str = "response") -> tuple[DataFrame, DataFrame]:
    """(parsed, quarantine): chat responses to the enrichment fields; a wrong type fails the record."""
    text = answers.withColumn("_a", answer_text(response)).withColumn("_json", without_fence_line("_a.text"))
    parsed = text.withColumn("_p", F.from_json("_json", schemas.ENRICHMENT + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    good = F.col("_a.error").isNull() & F.col("_p").isNotNull() & F.col("_p._corrupt").isNull()
    zero = {"int": F.lit(0), "boolean": F.lit(False), "string": F.lit("")}
    fields = [tuple(f.split()) for f in schemas.ENRICHMENT.split(", ")]
    keep = [c for c in answers.columns if c != response]
    ok = F.coalesce(good, F.lit(False))
    return parsed.where(ok).select(*keep, *[F.coalesce(f"_p.{n}", zero[t]).alias(n) for n, t in fields]), parsed.where(~ok).select(*keep, response, F.coalesce("_a.error", F.lit("malformed answer")).alias("error"))


def parse_signals(answers: DataFrame, response: str = "response") -> DataFrame:
    """Lenient extraction: every field by itself, a wrong type is no value, fractions are cut; adds hits of six fields."""
    json = F.try_parse_json(without_fences(response))
    picked = {}
    for name, kind in schemas.SIGNAL.items():
        field = F.try_variant_get(json, f"$.{name}", "variant")
        is_text = F.schema_of_variant(field) == "STRING"
        value = F.try_variant_get(json, f"$.{name}", kind)
        picked[name] = F.when(is_text, value) if kind == "string" else F.when(~is_text, value)
    for name in ("duration_days", "crew_size"):
        picked[name] = picked[name].cast("int")
    picked["start_date"] = F.try_to_timestamp(picked["start_date"], F.lit("yyyy-MM-dd")).cast("date")
    out = answers.withColumns(picked)
    filled = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("org_name", "location", "project_type")] + [F.coalesce(F.col(c), F.lit(0)) > 0 for c in ("duration_days", "crew_size")] + [F.col("start_date").isNotNull()]
    hits = F.lit(0)
    for f in filled:
        hits = hits + f.cast("int")
    return out.withColumn("field_hits", hits)

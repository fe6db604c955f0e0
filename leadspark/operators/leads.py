"""Lead tables: assembly, ranking, digests, lineage and payload rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark import rules
from leadspark.functions.columns import blank_to_null, or_blank, row_id, score_mark, state_mark, thousands, yes_no


def assemble(projects: DataFrame, answers: DataFrame, as_of: Column, key: str = "hash") -> DataFrame:
    """Leads from projects and model answers on the record hash, with defaults for what is missing."""
    joined = projects.join(answers, key)
    meta = lambda k: F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit(""))
    return joined.select(
        row_id(key).alias("id"), F.col(key).alias("raw_project_id"), blank_to_null("raw_input_id").alias("raw_input_id"), "source", "title", "location",
        F.col("value").alias("project_value"), or_blank("general_contractor").alias("general_contractor"), meta("applicant").alias("applicant"), meta("contractor").alias("contractor"), "source_url",
        or_blank("project_type").alias("project_type"), F.coalesce("estimated_crew_size", F.lit(0)).alias("estimated_crew_size"), F.coalesce("estimated_duration_months", F.lit(0)).alias("estimated_duration_months"),
        F.coalesce("out_of_town_crew_likely", F.lit(False)).alias("out_of_town_crew_likely"), F.coalesce("priority_score", F.lit(0)).alias("priority_score"), or_blank("priority_reason").alias("priority_reason"),
        F.lit("").alias("rationale"), or_blank("suggested_outreach_timing").alias("suggested_outreach_timing"), or_blank("notes").alias("notes"), F.lit("new").alias("status"), as_of.alias("created_at"), as_of.alias("updated_at"),
    )


def augment(projects: DataFrame, signals: DataFrame, key: str = "hash") -> DataFrame:
    """Empty titles and locations filled from the extracted signal, which also joins the metadata."""
    names = projects.columns
    joined = projects.join(signals.select(key, F.col("org_name").alias("_o"), F.col("location").alias("_l"), F.col("project_type").alias("_p")), key, "left")
    extra = F.map_filter(F.create_map(F.lit("org_name"), F.col("_o"), F.lit("project_type"), F.col("_p")), lambda _, v: v.isNotNull())
    meta = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(meta, lambda k, _: ~F.map_contains_key(extra, k)), extra)
    return joined.withColumns({"title": F.coalesce(blank_to_null("title"), "_o", F.lit("")), "location": F.coalesce(blank_to_null("location"), "_l", F.lit("")), "metadata": merged}).select(*names)


def ranked(leads: DataFrame, limit: int | None = None) -> DataFrame:
    out = leads.orderBy(F.desc("priority_score"), F.desc("created_at"), "id")
    return out.limit(limit) if limit else out


def digest(leads: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return leads.where(F.col("status").isin("new", "notified") & (F.col("created_at") >= as_of - F.expr(f"INTERVAL {days} DAYS")))


def priority_alerts(leads: DataFrame, threshold: int) -> DataFrame:
    return leads.where((F.lit(threshold) > 0) & (F.col("priority_score") >= threshold))


def search(leads: DataFrame, least_score: int | None = None, status: str | None = None, source: str | None = None, text: str | None = None, since: Column | None = None, with_rationale: bool = False) -> DataFrame:
    """The ad-hoc filters, combined."""
    for keep, cond in (
        (least_score is not None, F.col("priority_score") >= (least_score or 0)),
        (status is not None, F.col("status") == status),
        (source is not None, F.col("source") == source),
        (text is not None, F.ilike("title", F.lit(f"%{text}%"))),
        (since is not None, F.col("created_at") >= (since if since is not None else F.lit(None))),
        (with_rationale, F.col("rationale").isNotNull()),
    ):
        if keep:
            leads = leads.where(cond)
    return leads


def lineage(leads: DataFrame, raw_inputs: DataFrame, asked: DataFrame, payload: bool = False) -> DataFrame:
    """Raw document of every asked lead id, with why it is missing where it is."""
    raw = raw_inputs.select(F.col("id").alias("raw_input_id"), "hash", "payload_type", F.col("source_url").alias("raw_source_url"), *(["payload"] if payload else []), F.lit(True).alias("_raw"))
    rows = asked.select(F.col("id")).join(leads.select("id", "raw_input_id", F.lit(True).alias("_lead")), "id", "left").join(raw, "raw_input_id", "left")
    status = F.when(F.col("_lead").isNull(), "no lead").when(blank_to_null("raw_input_id").isNull(), "no link").when(F.col("_raw").isNull(), "no payload").otherwise("ok")
    return rows.withColumn("lookup_status", status).drop("_lead", "_raw")


def outreach(log: DataFrame, leads: DataFrame) -> DataFrame:
    return log.join(leads.select(F.col("id").alias("lead_id"), "title"), "lead_id").orderBy(F.desc("logged_at"), "id")


def newest_per(rows: DataFrame, key: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def context_text(leads: DataFrame, raw_inputs: DataFrame) -> DataFrame:
    """One text a lead of all it says, for embedding."""
    joined = leads.join(raw_inputs.select(F.col("id").alias("raw_input_id"), "payload_type"), "raw_input_id", "left")
    part = lambda label, c: F.concat(F.lit(label), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return joined.select("id", F.concat_ws(" | ", part("Title: ", "title"), part("Location: ", "location"), part("Type: ", "project_type"), part("Value: ", "project_value"), part("Notes: ", "notes"), part("Document: ", "payload_type")).alias("context"))


def find(rows: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """The asked keys with their rows; columns are null where a key is missing."""
    return wanted.select(key).join(rows, key, "left")


def notify_new(table: DataFrame, day: Column, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """(message of the best new leads, table in which just those are marked as notified)."""
    new = ranked(table.where("status = 'new'"), limit)
    marked = table.join(new.select("id", F.lit("notified").alias("_s")), "id", "left")
    return digest_message(new, day, limit=limit), marked.withColumn("status", F.coalesce("_s", "status")).select(*table.columns)


# Payload rows. The labels and marks of the payloads, which receivers read as they stand. ---------------------------------------------------------------------------------------


def _markdown(text: Column) -> Column:
    return F.struct(F.lit("mrkdwn").alias("type"), text.alias("text"))


def lead_blocks(leads: DataFrame, base_url: str = "") -> DataFrame:
    """id, priority_score, created_at and the section block of every lead as JSON."""
    both = (or_blank("contractor") != "") & (or_blank("applicant") != "")
    contact = F.when((or_blank("contractor") != "") | (or_blank("applicant") != ""), F.concat(F.lit("\n📞"), F.when(or_blank("contractor") != "", F.concat(F.lit(" *Contractor:* "), F.col("contractor"))).otherwise(""), F.when(both, "  |").otherwise(""), F.when(or_blank("applicant") != "", F.concat(F.lit(" *Applicant:* "), F.col("applicant"))).otherwise(""))).otherwise("")
    source = F.when(or_blank("source_url") != "", F.concat(F.lit("\n📄 <"), F.col("source_url"), F.lit("|View source document>"))).otherwise("")
    audit = F.when((F.lit(base_url) != "") & blank_to_null("raw_input_id").isNotNull(), F.concat(F.lit(f"\n🔍 <{base_url}/leads/"), F.col("id"), F.lit("/raw|View raw audit data>"))).otherwise("")
    text = F.concat(
        F.lit("*"), or_blank("title"), F.lit("*\t\t\t"), score_mark("priority_score"), F.lit(" *Score: "), F.col("priority_score").cast("string"), F.lit("/10*\n📍 "), or_blank("location"), F.lit("  |  💰 $"), thousands("project_value"),
        F.lit(" CAD  |  🏢 GC: "), or_blank("general_contractor"), contact, F.lit("\n🔌 *Source:* "), or_blank("source"), F.lit("\n🕐 *Outreach:* "), or_blank("suggested_outreach_timing"), F.lit("\n📝 "), or_blank("notes"), source, audit,
    )
    fields = F.array_compact(
        F.array(
            _markdown(F.concat(F.lit("*Type:* "), or_blank("project_type"))),
            _markdown(F.format_string("*Crew:* ~%d  |  ~%d months", "estimated_crew_size", "estimated_duration_months")),
            _markdown(F.concat(F.lit("*Out-of-town:* "), yes_no("out_of_town_crew_likely"))),
            _markdown(F.concat(F.lit("*Reason:* "), or_blank("priority_reason"))),
            F.when(or_blank("rationale") != "", _markdown(F.concat(F.lit("*Rationale:* "), F.col("rationale")))),
        )
    )
    block = F.to_json(F.struct(F.lit("section").alias("type"), _markdown(text).alias("text"), fields.alias("fields")))
    return leads.select("id", "priority_score", "created_at", block.alias("block"))


def digest_message(leads: DataFrame, day: Column, name: str = "leadspark", limit: int = 500) -> DataFrame:
    """One row: the message of the ``limit`` best leads, a header, then a section and a divider a lead."""
    divider = '{"type":"divider"}'
    blocks = lead_blocks(ranked(leads, limit))
    order = F.struct((-F.col("priority_score")).alias("a"), (-F.unix_micros("created_at")).alias("b"), F.col("id").alias("c"), F.col("block").alias("block"))
    folded = blocks.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(order)).alias("rows"))
    title = F.concat(F.lit(f"🏗️  {name} — "), F.col("n").cast("string"), F.lit(" new "), F.when(F.col("n") == 1, "lead").otherwise("leads"), F.lit("  ("), F.date_format(day, "MMM d, yyyy"), F.lit(")"))
    header = F.to_json(F.struct(F.lit("header").alias("type"), F.struct(F.lit("plain_text").alias("type"), title.alias("text")).alias("text")))
    parts = F.concat(F.array(header, F.lit(divider)), F.flatten(F.transform("rows", lambda r: F.array(r["block"], F.lit(divider)))))
    return folded.select("n", F.concat(F.lit('{"blocks":['), F.array_join(parts, ","), F.lit("]}")).alias("payload"), F.size(parts).alias("n_blocks"))


def escaped(c: Column | str) -> Column:
    text = or_blank(c)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def digest_page(leads: DataFrame, limit: int = 500) -> DataFrame:
    """One row: the digest of the ``limit`` best leads as an HTML page, a card each."""
    line = lambda label, c: F.concat(F.lit(f"<p><strong>{label}:</strong> "), escaped(c), F.lit("</p>"))
    card = F.concat(
        F.lit('<div class="lead-card '), F.when(F.col("priority_score") >= 8, "high-priority").otherwise("medium-priority"), F.lit('"><h2>'), escaped("title"), F.lit('</h2><div class="score">Priority Score: '), F.col("priority_score").cast("string"), F.lit("/10</div>"),
        line("Location", "location"), line("Project Type", "project_type"), line("Reason", "priority_reason"), line("Notes", "notes"), F.lit('<div class="meta">Source: '), escaped("source"), F.lit(" | Value: $"), F.col("project_value").cast("string"), F.lit(" | GC: "), escaped("general_contractor"), F.lit('</div><a href="'), escaped("source_url"), F.lit('">View Source</a></div>'),
    )
    rows = ranked(leads, limit).select(F.struct((-F.col("priority_score")).alias("a"), (-F.unix_micros("created_at")).alias("b"), F.col("id").alias("c"), card.alias("card")).alias("r"))
    return rows.agg(F.concat(F.lit("<html><body><h1>Weekly High-Priority Leads</h1>"), F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["card"]), "\n"), F.lit("</body></html>")).alias("html"), F.count(F.lit(1)).alias("n"))


def alert_payloads(events: DataFrame) -> DataFrame:
    """Message of every alert event: airport, minutes, state, score, cause, cancelled, total, rooms, copy."""
    rooms = F.when(F.coalesce("rooms", F.lit(0)) == 0, "room count not set — use /inventory N").otherwise(F.col("rooms").cast("string"))
    copy = F.when(or_blank("copy") != "", F.concat(F.lit("*Suggested Actions:*\n"), F.col("copy"))).otherwise(F.lit("*Suggested Actions:*\n• " + "\n• ".join(rules.ALERT_ACTIONS)))
    pair = lambda a, b: F.struct(F.lit("section").alias("type"), F.array(_markdown(a), _markdown(b)).alias("fields"), F.lit(None).cast("struct<type:string,text:string>").alias("text"))
    no_fields = F.lit(None).cast("array<struct<type:string,text:string>>")
    blocks = F.array(
        F.struct(F.lit("header").alias("type"), no_fields.alias("fields"), F.struct(F.lit("plain_text").alias("type"), F.concat(F.lit("🚨 Disruption Alert: "), F.col("airport")).alias("text")).alias("text")),
        pair(F.concat(F.lit("*Status:*\n"), state_mark(F.col("state")), F.format_string(" Active (%d min)", "minutes")), F.concat(F.lit("*Cause:*\n"), or_blank("cause"))),
        pair(F.format_string("*Impact:*\n%d cancellations (%d total flights)", "cancelled", "total"), F.concat(F.lit("*Est. Stranded Pax:*\n"), F.col("score").cast("bigint").cast("string"))),
        pair(F.lit(f"*Earliest Recovery:*\n{rules.EARLIEST_CLEAR}"), F.concat(F.lit("*Rooms Available:*\n"), rooms)),
        F.struct(F.lit("section").alias("type"), no_fields.alias("fields"), _markdown(copy).alias("text")),
    )
    return events.withColumn("payload", F.to_json(F.struct(blocks.alias("blocks"))))


def resolve_text(airport: Column, minutes: Column, score: Column) -> Column:
    return F.format_string("✅ *Disruption Resolved: %s*\nTotal Duration: %d min\nFinal SPS Score: %.1f", airport, minutes, score)

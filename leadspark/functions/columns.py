"""Column helpers: money, dates, keys, text forms and scores, all built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadspark import rules


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit(""))


def or_blank(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


# Money ------------------------------------------------------------------------------------------


def whole_dollars(c: Column | str) -> Column:
    """`$300,000.00` and `515,000.00` to whole dollars, cents cut; anything else is 0."""
    text = F.trim(F.regexp_replace(F.split_part(or_blank(c), F.lit("."), F.lit(1)), r"[$,]", ""))
    return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))


def leading_dollars(c: Column | str) -> Column:
    """Whole dollars of free text: the integer it begins with, once commas and $ are gone; else 0."""
    text = F.split_part(F.regexp_replace(or_blank(c), r"[$,]", ""), F.lit("."), F.lit(1))
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def thousands(c: Column | str) -> Column:
    return F.format_number(_col(c), 0)


# Dates ------------------------------------------------------------------------------------------


def first_date(c: Column | str, patterns: Sequence[str]) -> Column:
    """The date that the first fitting pattern reads, else null."""
    return F.coalesce(*[F.try_to_timestamp(_col(c), F.lit(p)).cast("date") for p in patterns])


def feed_date(c: Column | str, default: Column) -> Column:
    """Dates as feeds and award lists write them, tried in order; ``default`` where none fits."""
    text = F.trim(F.regexp_replace(or_blank(c), r"^[A-Za-z]{3},\s*", ""))
    zoned = ["dd MMM yyyy HH:mm:ss z", "dd MMM yyyy HH:mm:ss Z", "dd MMM yy HH:mm z", "dd MMM yy HH:mm Z"]
    plain = [F.try_to_timestamp(_col(c), F.lit(p)) for p in ("yyyy-MM-dd", "MMM dd, yyyy", "MM/dd/yyyy")]
    return F.coalesce(*plain, *[F.try_to_timestamp(text, F.lit(p)) for p in zoned], default)


def schedule_start(c: Column | str) -> Column:
    """First date of `M/d/yyyy - M/d/yyyy`."""
    return first_date(F.trim(F.split_part(or_blank(c), F.lit(" - "), F.lit(1))), ["M/d/yyyy"])


# Keys -------------------------------------------------------------------------------------------


def joined_key(*parts: Column | str, sep: str = "|") -> Column:
    """SHA-256 of the parts between separators; a null part is empty."""
    return F.sha2(F.concat_ws(sep, *[or_blank(p) for p in parts]), 256)


def day_text(c: Column | str) -> Column:
    return F.coalesce(F.date_format(_col(c), "yyyy-MM-dd"), F.lit("0001-01-01"))


def record_key(source="source", external_id="external_id", title="title", issued_at="issued_at") -> Column:
    """Identity of a record: source, its id there, title and day of issue."""
    return joined_key(source, external_id, title, day_text(issued_at))


def payload_key(c: Column | str) -> Column:
    """Identity of a fetched document."""
    return F.sha2(_col(c).cast("binary"), 256)


def permit_key(source: str, number: Column | str, address: Column | str, issued_at: Column | str) -> Column:
    return joined_key(F.lit(source), number, address, day_text(issued_at))


def production_key(source: str, title: Column | str, kind: Column | str) -> Column:
    return joined_key(F.lit(source), F.lower(F.trim(_col(title))), F.lower(F.trim(_col(kind))))


def award_key(source: str, *parts: Column | str) -> Column:
    return joined_key(F.lit(source), *parts)


def item_key(source: str, item: Column | str) -> Column:
    """Feed items, cards and headings: `source:id`."""
    return joined_key(F.lit(source), item, sep=":")


def row_id(*parts: Column | str) -> Column:
    """An id in UUID form that follows from its parts, so a repeated task makes the same one."""
    h = joined_key(*parts)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


# Text -------------------------------------------------------------------------------------------


def slug(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(or_blank(c))), "[^a-z0-9]+", "-"), F.lit("-"))


def dashed(c: Column | str) -> Column:
    return F.replace(F.lower(or_blank(c)), F.lit(" "), F.lit("-"))


def title_case(c: Column | str) -> Column:
    return F.initcap(F.regexp_replace(F.trim(or_blank(c)), r"\s+", " "))


def city(c: Column | str, default: str = "Metro Vancouver, BC", suffix: str = ", BC") -> Column:
    part = F.trim(F.try_element_at(F.split(or_blank(c), ","), F.lit(2)))
    return F.when((part != "") & (F.lower(part) != "canada"), F.concat(part, F.lit(suffix))).otherwise(F.lit(default))


def production_name(c: Column | str) -> Column:
    names = F.create_map(*[F.lit(x) for kv in rules.PRODUCTION_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.lower(or_blank(c))), or_blank(c))


def type_prefix(c: Column | str) -> Column:
    return F.lower(F.trim(F.split_part(or_blank(c), F.lit(" - "), F.lit(1))))


def builder_name(line: Column | str, number: Column | str) -> Column:
    """What a header line holds after the permit number, less its decimals."""
    line, number = _col(line), _col(number)
    at = F.instr(line, number)
    return F.when((at > 0) & (number != ""), F.trim(F.regexp_replace(F.substr(line, at + F.char_length(number)), r"[\d,]+\.\d{2}", ""))).otherwise(F.lit(""))


def absolute_url(c: Column | str, base: str) -> Column:
    link = or_blank(c)
    return F.when((link == "") | link.startswith("http"), link).otherwise(F.concat(F.lit(base), link))


def without_contact_data(c: Column | str) -> Column:
    """E-mail addresses, then phone numbers, replaced by marks.

    Texts without an @, or without the digits that end every phone number, skip the costly pattern.
    """
    text = _col(c)
    mailed = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, rules.EMAIL_PATTERN, F.lit(rules.EMAIL_MARK))).otherwise(text)
    return F.when(mailed.rlike(rules.PHONE_END), F.regexp_replace(mailed, rules.PHONE_PATTERN, F.lit(rules.PHONE_MARK))).otherwise(mailed)


def contains_any(c: Column | str, words: Sequence[str], whole_words: bool = False) -> Column:
    text = F.lower(or_blank(c))
    tests = [text.rlike(rf"\b\Q{w}\E\b") if whole_words else F.contains(text, F.lit(w)) for w in words]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def shorten(c: Column | str, limit: int = 280) -> Column:
    """Text of over ``limit`` characters cut at the last blank within limit + 1 (ASCII: bytes are characters)."""
    text = F.trim(or_blank(c))
    head = F.substring(text, 1, limit + 1)
    word = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    cut = F.when(F.instr(head, " ") > 0, word).otherwise(F.substring(text, 1, limit))
    return F.when(F.octet_length(text) > limit, F.trim(cut)).otherwise(text)


# The marks and words of messages in the helpers below.


def score_mark(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c >= 9, "🔥").when(c >= 7, "⚡").when(c >= 5, "👀").otherwise("📌")


def yes_no(c: Column | str) -> Column:
    return F.when(F.coalesce(_col(c), F.lit(False)), "yes").otherwise("no")


# Model answers ------------------------------------------------------------------------------------


def without_fence_line(c: Column | str) -> Column:
    """Drop a leading fence line and everything from the last fence on."""
    text = F.trim(or_blank(c))
    body = F.when(F.instr(text, "\n") > 0, F.regexp_replace(text, r"(?s)^[^\n]*\n", "")).otherwise(text)
    body = F.when(F.instr(body, "```") > 0, F.regexp_extract(body, r"(?s)^(.*)```", 1)).otherwise(body)
    return F.btrim(F.when(text.startswith("```"), body).otherwise(text), F.lit(" \n\t\r"))


def without_fences(c: Column | str) -> Column:
    text = F.btrim(or_blank(c), F.lit(" \n\t\r"))
    bare = F.regexp_replace(F.regexp_replace(text, r"^```(json)?", ""), r"```$", "")
    return F.btrim(F.when(text.startswith("```"), bare).otherwise(text), F.lit(" \n\t\r"))


def answer_text(c: Column | str) -> Column:
    """(text, error) of a chat response: its first text block, or the message of its error object."""
    parsed = F.from_json(_col(c), "struct<content:array<struct<type:string,text:string>>,error:struct<message:string>>")
    block = F.try_element_at(F.filter(parsed["content"], lambda b: b["type"] == "text"), F.lit(1))
    error = F.when(parsed["error"].isNotNull(), parsed["error"]["message"]).when(block.isNull(), F.lit("no text block"))
    return F.struct(F.when(error.isNull(), block["text"]).alias("text"), error.alias("error"))


# Vectors ------------------------------------------------------------------------------------------


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine in double precision; 0 for null, empty, unequal lengths or a zero vector."""
    a, b = F.transform(_col(a), lambda x: x.cast("double")), F.transform(_col(b), lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0)
    return F.coalesce(F.when(ok, dot(a, b) / norm), F.lit(0.0))


# Disruption ----------------------------------------------------------------------------------------


def hour_factor(hour: Column) -> Column:
    out = F.lit(rules.NIGHT_FACTOR)
    for least, factor in reversed(rules.HOUR_FACTORS):
        out = F.when(hour >= least, F.lit(factor)).otherwise(out)
    return out


def disruption_score(rate: Column, hour: Column, minutes: Column, seats: Column | None = None, connecting: Column | None = None) -> Column:
    """Stranded-passenger score; 0 or null seats and connecting share take the defaults."""
    seats = F.coalesce(F.nullif(seats, F.lit(0)), F.lit(rules.SEATS)) if seats is not None else F.lit(rules.SEATS)
    connecting = F.coalesce(F.nullif(connecting, F.lit(0.0)), F.lit(rules.CONNECTING)) if connecting is not None else F.lit(rules.CONNECTING)
    return rate * seats.cast("double") * connecting * hour_factor(hour) * F.least(minutes / F.lit(60.0), F.lit(3.0))


def state_of(score: Column) -> Column:
    out = F.lit(rules.TOP_STATE)
    for upper, name in reversed(rules.STATE_BANDS):
        out = F.when(score < upper, F.lit(name)).otherwise(out)
    return out


def tuned_state(state: Column, score: Column, minutes: Column, weather: Column, single_runway: Column) -> Column:
    """Single-runway cap first, then the rule of the active weather alert."""
    capped = F.when(single_runway & (state == "HardAlert"), "SoftAlert").otherwise(state)
    return (
        F.when((weather == "Fog") & (minutes < rules.FOG_MINUTES), "Ignore")
        .when((weather == "Snow") & (capped == "Ignore"), "PreAlert")
        .when((weather == "AtmosphericRiver") & (score >= rules.RIVER_SCORE) & (capped == "Watch"), "SoftAlert")
        .otherwise(capped)
    )


def weather_type(event: Column | str, headline: Column | str) -> Column:
    event, headline = F.upper(or_blank(event)), F.lower(or_blank(headline))
    return (
        F.when(F.contains(event, F.lit("SNOW")), "Snow")
        .when(F.contains(event, F.lit("FOG")), "Fog")
        .when(F.contains(headline, F.lit("atmospheric")), "AtmosphericRiver")
        .when(F.contains(event, F.lit("WIND")), "Wind")
        .otherwise("Unknown")
    )


# Parts of the day, recovery and state marks of alert texts.


def day_part(hour: Column) -> Column:
    return F.when((hour >= 21) | (hour < 5), "overnight").when(hour >= 17, "evening").when(hour >= 12, "afternoon").otherwise("morning")


def recovery_text(hours: Column) -> Column:
    return F.when(hours.isNull(), "unknown").otherwise(F.concat(F.round(hours).cast("bigint").cast("string"), F.lit(" hours from now")))


def quarter_hours(minutes: Column) -> Column:
    return (F.round(minutes / 15) * 15).cast("int")


def state_mark(state: Column) -> Column:
    return F.when(state == "HardAlert", "🔴").when(state == "SoftAlert", "⚠️").otherwise("👀")

"""Rules-based pre-score that decides which records are worth a model call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark import rules
from leadspark.functions.columns import or_blank


def with_prescore(
    projects: DataFrame,
    high: Sequence[str] = tuple(rules.HIGH_VALUE),
    low: Sequence[str] = tuple(rules.LOW_VALUE),
    geo: str = rules.GEO_PATTERN,
    text_cols: Sequence[str] = ("title", "location"),
    low_penalty: int = 5,
) -> DataFrame:
    """Add prescore and prescore_reason: location, value tier, one point a keyword, minus low-value words."""
    text = F.lower(F.concat_ws(" ", *[or_blank(c) for c in text_cols]))
    near = or_blank("location").rlike(geo) | or_blank("title").rlike(geo)
    tier, tier_reason = F.lit(0), F.lit(None).cast("string")
    for least, points, reason in reversed(rules.VALUE_TIERS):
        tier = F.when(F.col("value") >= least, points).otherwise(tier)
        tier_reason = F.when(F.col("value") >= least, F.lit(reason)).otherwise(tier_reason)
    hits = lambda words: F.filter(F.array(*[F.lit(w) for w in words]).cast("array<string>"), lambda w: F.contains(text, w))
    good, bad = hits(high), hits(low)
    named = lambda words, label: F.transform(words, lambda w: F.concat(F.lit(label), w))
    reasons = F.concat(F.array(F.when(near, F.lit(rules.GEO_REASON)), tier_reason), named(good, "Keyword: "), named(bad, "Deprioritized: "))
    score = F.when(near, 2).otherwise(0) + tier + F.size(good) - low_penalty * F.size(bad)
    return projects.withColumns({"prescore": score.cast("int"), "prescore_reason": F.array_join(F.array_compact(reasons), ", ")})


def split_by_score(scored: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Rows to enrich, and the others as skipped leads that keep their reason."""
    enough = F.col("prescore") >= threshold
    skipped = scored.where(~F.coalesce(enough, F.lit(False))).withColumns({"status": F.lit("skipped"), "priority_reason": F.concat(F.lit("Skipped: pre-score "), F.col("prescore").cast("string"), F.lit(" ("), F.col("prescore_reason"), F.lit(")"))})
    return scored.where(enough), skipped


def filter_funnel(rows: DataFrame, allowed: Sequence[str], least: int, kind: str = "sub_type", value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Counts of rows that pass, are of low value, or of another type; the value test comes first."""
    fate = F.when(~F.coalesce(F.col(value) > least, F.lit(False)), "skipped_low_value").when(~F.coalesce(F.lower(F.trim(F.col(kind))).isin(*allowed), F.lit(False)), "skipped_type").otherwise("passed")
    return rows.withColumn("_fate", fate).groupBy(*by).agg(*[F.count_if(F.col("_fate") == f).alias(f) for f in ("passed", "skipped_low_value", "skipped_type")])


def relevant_permits(rows: DataFrame, allowed: Sequence[str], least: int = rules.MIN_PERMIT_VALUE, kind: str = "sub_type", value: str = "value") -> DataFrame:
    """Commercial rows strictly above the least value."""
    return rows.where((F.col(value) > least) & F.lower(F.trim(F.col(kind))).isin(*allowed))

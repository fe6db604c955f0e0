"""Content-hash deduplication, insert-ignore, upsert and purge as new table states.

Every function takes table states and returns the next one; ``store.TableStore`` puts it in place, bucket by
bucket. Blobs stay in their own table; joins carry hashes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.functions.columns import blank_to_null, record_key, without_contact_data


def with_hash(projects: DataFrame) -> DataFrame:
    """Fill a missing record hash with the generic key."""
    return projects.withColumn("hash", F.coalesce(blank_to_null("hash"), record_key()) if "hash" in projects.columns else record_key())


def first_of_each(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """First row of each key; every row with a null key stays.

    One pass: rows without a key are dealt out by a hash of theirs, so they do not meet in one task.
    """
    plain = [f.name for f in rows.schema.fields if not f.dataType.simpleString().startswith(("map", "array<map", "struct", "variant"))]
    own = F.when(F.col(key).isNull(), F.xxhash64(*plain))
    numbered = rows.withColumn("_own", own).withColumn("_rn", F.row_number().over(Window.partitionBy(key, "_own").orderBy(*order)))
    return numbered.where((F.col("_rn") == 1) | F.col(key).isNull()).drop("_own", "_rn")


def unseen(batch: DataFrame, seen: DataFrame, key: str = "hash") -> DataFrame:
    """Rows of the batch whose key is not in ``seen``, or null. A seen table that is bucketed by the key stays where it is."""
    return batch.join(seen.select(key), key, "left_anti")


def already_seen(batch: DataFrame, seen: DataFrame, key: str = "hash") -> DataFrame:
    return batch.join(seen.select(key), key, "left_semi")


def insert_ignore(store: DataFrame, batch: DataFrame, order: Sequence[Column], key: str = "hash") -> DataFrame:
    """Rows of ``batch`` to append so that ``key`` stays unique; the first of a key wins."""
    return first_of_each(unseen(batch, store, key), key, order)


def insert_returning(store: DataFrame, batch: DataFrame, order: Column, key: str = "hash", id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows to append, batch with winning_id): the stored row wins, else the first of the batch, by id in a tie.

    A row without a key is always appended and wins for itself.
    """
    known = store.groupBy(key).agg(F.min(id_col).alias("_known"))
    firsts = batch.groupBy(key).agg(F.min_by(id_col, F.struct(order.alias("o"), F.col(id_col).alias("i"))).alias("_first"))
    winners = firsts.join(known, key, "left").select(key, F.coalesce("_known", "_first").alias("winning_id"))
    told = batch.join(winners, key, "left").withColumn("winning_id", F.coalesce("winning_id", id_col))
    return insert_ignore(store, batch, [order, F.col(id_col)], key), told


def stored_payloads(batch: DataFrame, payload: str = "payload", strip: bool = True) -> DataFrame:
    """Hash the payload as fetched, then take contact data out of what is kept."""
    hashed = batch.withColumn("hash", F.sha2(F.col(payload).cast("binary"), 256))
    return hashed.withColumn(payload, without_contact_data(F.col(payload).cast("string")).cast(batch.schema[payload].dataType)) if strip else hashed


def upsert(store: DataFrame, batch: DataFrame, key: str, version: Column) -> DataFrame:
    """Last write wins: of each key the row with the highest version, the batch's in a tie."""
    names = store.columns
    both = store.withColumn("_new", F.lit(0)).unionByName(batch.select(*names).withColumn("_new", F.lit(1)))
    return both.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(version, F.col("_new"))).alias("_r")).select("_r.*")


def set_status(table: DataFrame, updates: DataFrame, key: str = "id", column: str = "status") -> tuple[DataFrame, DataFrame]:
    """(table with new values, keys that it does not have)."""
    new = updates.groupBy(key).agg(F.max(column).alias("_value"))
    changed = table.join(new, key, "left").withColumn(column, F.coalesce("_value", column)).select(*table.columns)
    return changed, new.join(table.select(key), key, "left_anti").select(key)


def purge(raw: DataFrame, leads: DataFrame, older_than: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, rows to delete): old rows that no lead refers to."""
    referenced = leads.select(F.col("raw_input_id").alias("id")).where("id is not null")
    doomed = raw.where(F.col("created_at") < older_than).join(referenced, "id", "left_anti")
    return raw.join(doomed.select("id"), "id", "left_anti"), doomed


def purgeable(raw: DataFrame, leads: DataFrame, older_than: Column, by: Sequence[str] = ()) -> DataFrame:
    """Count and oldest day of the rows that ``purge`` would delete; nothing is deleted."""
    return purge(raw, leads, older_than)[1].groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("oldest"))


def copy_missing(source: DataFrame, target: DataFrame, key: str, types: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows to append, reconciliation): cast, skip keys the target has, compare counts."""
    cast = source.select(*[F.expr(f"try_cast(`{c}` as {types[c]})").alias(c) if c in types else F.col(c) for c in source.columns])
    fresh = insert_ignore(target, cast, [F.col(c) for c in cast.columns if c != key][:1] or [F.col(key)], key)
    return fresh, reconcile(source, target.select(key).unionByName(fresh.select(key)))


def copy_dry_run(source: DataFrame, target: DataFrame, key: str, types: dict[str, str]) -> DataFrame:
    """One row: how many rows the copy would read, append and skip, and how many values a cast would lose."""
    fresh, _ = copy_missing(source, target, key, types)
    bad = [F.count_if(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` as {t})").isNull()) for c, t in types.items()]
    lost = bad[0] if bad else F.lit(0).cast("bigint")
    for n in bad[1:]:
        lost = lost + n
    read = source.agg(F.count(F.lit(1)).alias("would_read"), lost.alias("lost_values"))
    return read.crossJoin(fresh.agg(F.count(F.lit(1)).alias("would_append"))).withColumn("would_skip", F.col("would_read") - F.col("would_append"))


def reconcile(source: DataFrame, target: DataFrame) -> DataFrame:
    counts = source.agg(F.count(F.lit(1)).alias("source_rows")).crossJoin(target.agg(F.count(F.lit(1)).alias("target_rows")))
    return counts.withColumn("matches", F.col("source_rows") == F.col("target_rows"))


"""Selections and predicates of the ingest and digest steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_window(items: DataFrame, from_ms: int | None, to_ms: int | None, feeds: list[str] | None = None) -> DataFrame:
    """Items of the inclusive window; ``feeds``: None is all, an empty list is none."""
    if from_ms is not None:
        items = items.where(F.col("date_ms") >= from_ms)
    if to_ms is not None:
        items = items.where(F.col("date_ms") <= to_ms)
    if feeds is not None:
        items = items.where(F.col("feed_id").isin(feeds) if feeds else F.lit(False))
    return items


def selected_feeds(items: DataFrame, selected: list[str] | None, excluded: list[str] = (), since_ms: int | None = None) -> DataFrame:
    """Items of the selected feeds less the excluded, of feeds whose last item is not before ``since_ms``."""
    items = in_window(items, None, None, selected)
    if excluded:
        items = items.where(~F.col("feed_id").isin(list(excluded)))
    if since_ms is not None:
        live = items.groupBy("feed_id").agg(F.max("date_ms").alias("last_ms")).where(F.col("last_ms") >= since_ms)
        items = items.join(live, "feed_id", "left_semi")
    return items


def archive_scan(items: DataFrame, kinds: list[str], to_ms: int, kind_col: str = "lang") -> DataFrame:
    """Each different post of a feed once (its smallest id), of the kinds named, up to ``to_ms``."""
    rows = items.where(F.col(kind_col).isin(kinds) & (F.col("date_ms") <= to_ms))
    return rows.groupBy("feed_id", F.sha2("text", 256).alias("digest")).agg(F.min("item_id").alias("item_id"))


def incremental_window(cursors: DataFrame, start_ms: int, end_ms: int, refresh: Column | None = None) -> DataFrame:
    """cursor + 1 to the end, or the whole period without a cursor or where a refresh is due."""
    whole = F.col("cursor_ms").isNull() | (F.lit(False) if refresh is None else refresh)
    return cursors.select(
        "feed_id", "cursor_ms",
        F.when(whole, F.lit(start_ms)).otherwise(F.col("cursor_ms") + 1).alias("from_ms"),
        F.lit(end_ms).alias("to_ms"),
        F.coalesce(F.col("cursor_ms") >= end_ms, F.lit(False)).alias("already_ingested"),
    )


def effective_mode(feed: str, source: str, warmup: str, user: str) -> Column:
    """The feed's mode, else the source's, else include_all while it warms up, else the user's; 'inherit' is none."""
    return F.coalesce(F.nullif(F.col(feed), F.lit("inherit")), F.nullif(F.col(source), F.lit("inherit")), F.when(F.col(warmup), F.lit("include_all")), F.col(user))


def has_letter(column: str) -> Column:
    return F.col(column).rlike(r"\p{L}")


def with_letters(df: DataFrame, column: str, exempt: Column | None = None) -> DataFrame:
    """Rows whose text has a letter; exempt rows (pictures) stay."""
    keep = F.coalesce(has_letter(column), F.lit(False))
    return df.where(keep | exempt if exempt is not None else keep)


def inaccessible(audience: str, access: str) -> Column:
    """Paid and seen as a preview only; unknown is accessible."""
    return F.coalesce((F.col(audience) == "only_paid") & (F.col(access) == "preview"), F.lit(False))


def not_deleted(feeds: DataFrame, include_deleted: bool = False) -> DataFrame:
    return feeds if include_deleted else feeds.where(F.col("deleted_at").isNull())


def active_rules(rules: DataFrame, now: Column) -> DataFrame:
    return rules.where((F.col("state") == "active") & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))


def recover_stale(runs: DataFrame, before: Column, running: str = "running") -> DataFrame:
    """Runs that still run though they began before ``before`` have failed."""
    return runs.withColumn("status", F.when((F.col("status") == running) & (F.col("started_at") < before), "failed").otherwise(F.col("status")))


def bounded_dates(rows: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Undated rows between lower_ms and upper_ms: outside the window, inside (dated by the lower bound) or ambiguous."""
    low, high = F.col("lower_ms"), F.col("upper_ms")
    outside = F.coalesce(high < from_ms, F.lit(False)) | F.coalesce(low > to_ms, F.lit(False))
    inside = F.coalesce((low >= from_ms) & (high <= to_ms) & (low <= high), F.lit(False))
    verdict = F.when(outside, "outside").when(inside, "inside").otherwise("ambiguous")
    return rows.withColumn("verdict", verdict).withColumn("date_ms", F.when(F.col("verdict") == "inside", low))


def without_secrets(sources: DataFrame, secret: str) -> DataFrame:
    return sources.withColumn("connected", F.col(secret).isNotNull()).drop(secret)


def enabled_plan(feeds: DataFrame, sources: DataFrame) -> DataFrame:
    """Enabled feeds: ready, or failed with their disabled source. The sources are few but unbounded, so the join's form is Spark's choice."""
    s = sources.select("source_id", F.col("enabled").alias("source_enabled"))
    return feeds.where("enabled").join(s, "source_id").withColumn("plan", F.when(F.col("source_enabled"), "ready").otherwise("source_disabled"))


def refresh_plan(feeds: DataFrame, paid: DataFrame, start_ms: int, from_ms: int) -> DataFrame:
    """Feeds with paid items are read again from the start of the period."""
    flags = paid.select("feed_id").distinct().withColumn("refresh", F.lit(True))
    out = feeds.join(flags, "feed_id", "left").withColumn("refresh", F.coalesce("refresh", F.lit(False)))
    return out.withColumn("from_ms", F.when(F.col("refresh"), F.lit(start_ms)).otherwise(F.lit(from_ms)))


def feed_kind(dialog: str, key: str) -> tuple[Column, Column]:
    """(kind, external id with its name space): groups, chats and users are discussions, channels news."""
    group = F.col(dialog).isin("megagroup", "chat", "user")
    return F.when(group, "discussion").otherwise("news"), F.concat(F.col(dialog), F.lit(":"), F.col(key).cast("string"))


def media_descriptor(media: str) -> Column:
    """Text that stands for a media struct (type, paths, mime, url)."""
    kind = F.col(f"{media}.type")
    return (
        F.when(kind == "photo", "[Photo]")
        .when(kind == "album", F.concat(F.lit("[Album: "), F.size(f"{media}.paths").cast("string"), F.lit(" photos]")))
        .when(kind == "video", "[Video]")
        .when(kind == "document", F.concat(F.lit("[Document: "), F.col(f"{media}.mime"), F.lit("]")))
        .when(kind == "webpage", F.concat(F.lit("[Web page: "), F.col(f"{media}.url"), F.lit("]")))
    )


def ttl_expired(rows: DataFrame, column: str, now_ms: int, ttl_ms: int) -> DataFrame:
    """Rows older than the time to live, with the constant on one side so that it reaches the scan."""
    return rows.where(F.col(column) < now_ms - ttl_ms)


def parsed(raw: DataFrame, column: str, schema: str, valid: str) -> DataFrame:
    """The fields of a JSON column, and the verdict ok or bad by the condition ``valid``; what doesn't parse is bad."""
    rows = raw.withColumn("__r", F.from_json(column, schema)).select(*raw.columns, "__r.*")
    return rows.withColumn("verdict", F.when(F.coalesce(F.expr(valid), F.lit(False)), "ok").otherwise("bad"))


def owned(rows: DataFrame, owner, column: str = "user_id") -> DataFrame:
    """Rows of one owner: a plain equality, which reaches the scan."""
    return rows.where(F.col(column) == owner)


def owned_through(children: DataFrame, parents: DataFrame, on: list[str], owner, column: str = "user_id") -> DataFrame:
    """Rows whose parent is the owner's. The parents are filtered first, so Spark can build its runtime filter from them; rows without a parent belong to nobody."""
    return children.join(owned(parents, owner, column).select(*on), on, "left_semi")


def period_error(start_ms: Column, end_ms: Column) -> Column:
    """Why a period is refused, null where it isn't: both ends or neither, none negative, the start not after the end."""
    return (
        F.when(start_ms.isNull() != end_ms.isNull(), "both ends or neither")
        .when((start_ms < 0) | (end_ms < 0), "negative")
        .when(start_ms > end_ms, "start after end")
    )

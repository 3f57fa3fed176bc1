"""Feeds that a user could follow, out of the links that pages show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls


def discovered(links: DataFrame) -> DataFrame:
    """(feed, kind, name, first): each target of ``links`` (place, href, name) once. kind: news for lists and Following, discussion for chats.

    The name is the first that isn't blank, else the target's own; first is the least place. Links to anything else, with control characters or to other origins count nothing.
    """
    t = links.select("place", text.feed_name("name").alias("name"), urls.link_target("href").alias("t")).where("t IS NOT NULL")
    rows = t.select("place", F.nullif("name", F.lit("")).alias("name"), urls.target_feed(F.col("t")).alias("feed"), F.col("t.kind").alias("of"), F.col("t.id").alias("id"))
    own = F.when(F.col("of") == "following", "Following").otherwise(F.concat(F.initcap("of"), F.lit(" "), "id"))
    named = rows.groupBy("feed", "of", "id").agg(F.min_by("name", F.when(F.col("name").isNotNull(), F.col("place"))).alias("said"), F.min("place").alias("first"))
    return named.select("feed", F.when(F.col("of") == "chat", "discussion").otherwise("news").alias("kind"), F.coalesce("said", own).alias("name"), "first")


def menu_order() -> list:
    """Following first, news before discussions, then by name and id."""
    return [F.desc(F.col("feed") == "x:following"), F.desc("kind"), F.asc("name"), F.asc("feed")]


def ingested(items: DataFrame, runs: DataFrame, deadline_ms: int) -> tuple[DataFrame, DataFrame]:
    """(outcomes: a row a feed; items that may be kept). ``items``: source, feed, item and bad (an invalid item); ``runs``: source, feed, took_ms (of the whole source), error (the feed's own, null without).

    A source that took longer than the deadline fails with all its feeds; an error fails its feed alone; an invalid item fails its feed too, and no other. Failed feeds keep nothing.
    """
    bad = items.groupBy("source", "feed").agg(F.count("*").alias("n"), F.bool_or(F.coalesce("bad", F.lit(False))).alias("bad"))
    late = runs.groupBy(F.col("source").alias("__source")).agg(F.max("took_ms").alias("took"))
    both = runs.join(late, F.col("source") == F.col("__source")).join(bad, ["source", "feed"], "left")
    error = F.when(F.col("took") > deadline_ms, "connector deadline exceeded").when(F.col("error").isNotNull(), F.col("error")).when(F.col("bad"), "an invalid item")
    outcomes = both.select("source", "feed", error.alias("failure"), F.when(error.isNull(), F.coalesce("n", F.lit(0))).otherwise(0).alias("fetched"))
    return outcomes, items.join(outcomes.where("failure IS NULL").select("source", "feed"), ["source", "feed"], "left_semi")

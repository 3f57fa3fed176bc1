"""Windows, islands and other order-sensitive operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins, units
from ..registry import query
from ..sources.tables import EVENT_ITEMS, event_items, table
from .scans import DAY, START

LAST = [F.desc_nulls_last, F.desc]


@query("""SELECT o_custkey AS digest, o_orderkey AS run, o_orderstatus AS status FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, nullif(o_orderpriority, '5-LOW') DESC NULLS LAST, o_orderkey DESC) = 1""")
def latest_per_group(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("finished", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")))
    rows = units.latest(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc_nulls_last("finished"), F.desc("o_orderkey")])
    return rows.select(F.col("o_custkey").alias("digest"), F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("status"))


@query("""SELECT o_custkey AS story, o_orderstatus AS story_version, o_orderpriority AS profile_version, o_orderkey AS points FROM orders WHERE o_orderstatus <> 'P'
    QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def reusable_points(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    rows = units.latest(o, ["o_custkey", "o_orderstatus", "o_orderpriority"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return rows.select(F.col("o_custkey").alias("story"), F.col("o_orderstatus").alias("story_version"), F.col("o_orderpriority").alias("profile_version"), F.col("o_orderkey").alias("points"))


@query("""WITH o AS (SELECT o_custkey AS story, o_orderstatus AS story_version, o_orderpriority AS profile_version, o_orderkey AS points, o_orderdate AS made FROM orders), w AS (SELECT DISTINCT story, story_version, profile_version FROM o),
    cur AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY story ORDER BY made DESC, points DESC) = 1),
    past AS (SELECT * FROM o WHERE made < TIMESTAMP '1999-01-01' QUALIFY row_number() OVER (PARTITION BY story, story_version, profile_version ORDER BY made DESC, points DESC) = 1)
    SELECT w.*, coalesce(c.points, p.points) AS points, CASE WHEN c.points IS NOT NULL THEN 'current' WHEN p.points IS NOT NULL THEN 'history' END AS origin FROM w LEFT JOIN cur c USING (story, story_version, profile_version) LEFT JOIN past p USING (story, story_version, profile_version)""")
def current_then_reusable(spark, sf_dir):
    """Points of the current digest (a story's last order) first, then the newest of old digests with the same versions."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("story"), F.col("o_orderstatus").alias("story_version"), F.col("o_orderpriority").alias("profile_version"), F.col("o_orderkey").alias("points"), F.col("o_orderdate").alias("at"))
    on = ["story", "story_version", "profile_version"]
    order = [F.desc("at"), F.desc("points")]
    current = units.latest(o, ["story"], order)
    return joins.reused_points(o.select(*on).distinct(), current, o.where(F.col("at") < F.lit("1999-01-01").cast("timestamp")), on, order)


def discussion(spark, sf_dir):
    """Events as messages: a third have no thread; the scope is the user."""
    return event_items(spark, sf_dir).select(
        "user_id", F.col("item_id").alias("pos"), (F.col("user_id") % 2).cast("string").alias("feed_id"),
        F.when(F.col("item_id") % 3 != 0, F.col("feed_id")).alias("root"), (F.col("item_id") % 5 != 0).alias("is_group"), "author", "date_ms",
    )


def _units_sql(root_gap, root_cap, gap, cap):
    return f"""WITH {EVENT_ITEMS}, m AS (SELECT user_id, item_id AS pos, cast(user_id % 2 AS VARCHAR) AS feed_id, CASE WHEN item_id % 3 <> 0 THEN feed_id END AS root, item_id % 5 <> 0 AS is_group, author, date_ms FROM items),
    r1 AS (SELECT *, CASE WHEN abs(date_ms - lag(date_ms) OVER w) <= {root_gap} THEN 0 ELSE 1 END AS brk FROM m WHERE root IS NOT NULL WINDOW w AS (PARTITION BY user_id, feed_id, root ORDER BY pos)),
    r2 AS (SELECT *, sum(brk) OVER (PARTITION BY user_id, feed_id, root ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM r1),
    r3 AS (SELECT *, row_number() OVER (PARTITION BY user_id, feed_id, root, island ORDER BY pos) - 1 AS n FROM r2),
    r AS (SELECT *, min(pos) OVER (PARTITION BY user_id, feed_id, root, island, n // {root_cap}) AS unit FROM r3),
    s0 AS (SELECT user_id, pos, feed_id, is_group, author, date_ms, false AS rooted FROM m WHERE root IS NULL UNION ALL SELECT user_id, pos, feed_id, is_group, author, date_ms, true FROM r WHERE n % {root_cap} = 0),
    s1 AS (SELECT *, CASE WHEN NOT rooted AND is_group AND author <> '' AND NOT lag(rooted) OVER w AND feed_id = lag(feed_id) OVER w AND author = lag(author) OVER w AND abs(date_ms - lag(date_ms) OVER w) <= {gap} THEN 0 ELSE 1 END AS brk
        FROM s0 WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
    s2 AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM s1),
    s3 AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY pos) - 1 AS n FROM s2),
    s AS (SELECT *, min(pos) OVER (PARTITION BY user_id, island, n // {cap}) AS unit FROM s3)
    SELECT user_id, pos, unit FROM r UNION ALL SELECT user_id, pos, unit FROM s WHERE NOT rooted"""


@query(_units_sql(DAY // 2, 8, DAY // 4, 4))
def thread_units(spark, sf_dir):
    return units.thread_units(discussion(spark, sf_dir), ["user_id"], DAY // 2, 8, DAY // 4, 4).select("user_id", "pos", "unit")


@query(_units_sql(30 * 60_000, 8, DAY * 3, 4))
def adjacent_units(spark, sf_dir):
    return units.thread_units(discussion(spark, sf_dir), ["user_id"], gap_ms=DAY * 3).select("user_id", "pos", "unit")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS occurrence FROM events")
def occurrence_number(spark, sf_dir):
    n = units.occurrence(["user_id", "event_type"], [F.asc("ts"), F.asc("event_id")])
    return table(spark, sf_dir, "events").select("event_id", n.cast("long").alias("occurrence"))


@query(f"""WITH {EVENT_ITEMS}, d AS (SELECT item_id, user_id, CASE WHEN item_id % 4 = 0 THEN date_ms // {DAY} END AS day FROM items)
    SELECT item_id, last_value(day IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY item_id ROWS UNBOUNDED PRECEDING) AS day FROM d""")
def day_forward_fill(spark, sf_dir):
    rows = event_items(spark, sf_dir).select("item_id", "user_id", F.when(F.col("item_id") % 4 == 0, F.floor(F.col("date_ms") / DAY)).alias("day"))
    return rows.select("item_id", units.fill_forward("day", ["user_id"], [F.asc("item_id")]).cast("long").alias("day"))


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role END AS author, turn % 4 = 0 AS brk FROM conversations),
    i AS (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS chain FROM c)
    SELECT conv_id, turn, last_value(author IGNORE NULLS) OVER (PARTITION BY conv_id, chain ORDER BY turn ROWS UNBOUNDED PRECEDING) AS author FROM i""")
def author_fill(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.col("role")).alias("author"))
    chains = units.islands(c, ["conv_id"], [F.asc("turn")], F.col("turn") % 4 != 0, "chain")
    return chains.select("conv_id", "turn", units.fill_forward("author", ["conv_id", "chain"], [F.asc("turn")]).alias("author"))


@query("""WITH f AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS brk FROM events),
    g AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) - 1 AS run FROM f)
    SELECT user_id, cast(run AS BIGINT) AS run, event_type, count(*) AS n FROM g GROUP BY ALL""")
def run_length_groups(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return units.run_lengths(e, ["user_id"], [F.asc("event_id")], "event_type").select("user_id", F.col("run").cast("long").alias("run"), "event_type", "n")


@query(f"""WITH {EVENT_ITEMS}, m AS (SELECT user_id, date_ms // 604800000 AS week, item_id, (date_ms // 60000) % 1440 AS minute FROM items),
    d AS (SELECT user_id, week, CASE WHEN minute < lag(minute) OVER (PARTITION BY user_id, week ORDER BY item_id) THEN 1 ELSE 0 END AS descent FROM m)
    SELECT user_id, week, cast(sum(descent) AS BIGINT) AS descents, sum(descent) = 1 AS one_midnight FROM d GROUP BY user_id, week""")
def midnight_descent(spark, sf_dir):
    minute = F.floor(F.col("date_ms") / 60000) % 1440
    m = event_items(spark, sf_dir).select("user_id", F.floor(F.col("date_ms") / 604_800_000).alias("week"), "item_id", minute.alias("minute"))
    descent = F.when(F.col("minute") < F.lag("minute").over(Window.partitionBy("user_id", "week").orderBy("item_id")), 1).otherwise(0)
    out = m.withColumn("descent", descent).groupBy("user_id", "week").agg(F.sum("descent").alias("descents"))
    return out.withColumn("one_midnight", F.col("descents") == 1)


@query("""WITH f AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS brk FROM events),
    g AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM f),
    h AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS streak FROM g)
    SELECT user_id, min(event_id) AS confirmed_at FROM h WHERE streak = 4 GROUP BY user_id""")
def confirm_streak(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("event_id")
    runs = units.islands(e, ["user_id"], [F.asc("event_id")], F.col("event_type") == F.lag("event_type").over(w), "run")
    streak = F.row_number().over(Window.partitionBy("user_id", "run").orderBy("event_id"))
    return runs.withColumn("streak", streak).where("streak = 4").groupBy("user_id").agg(F.min("event_id").alias("confirmed_at"))


@query(f"""WITH {EVENT_ITEMS}, e AS (SELECT DISTINCT user_id, date_ms AS to_ms FROM items WHERE feed_id = 'purchase')
    SELECT user_id, coalesce(lag(to_ms) OVER (PARTITION BY user_id ORDER BY to_ms) + 1, to_ms - {DAY} + 1) AS from_ms, to_ms FROM e""")
def tumbling_periods(spark, sf_dir):
    ends = event_items(spark, sf_dir).where("feed_id = 'purchase'").select("user_id", F.col("date_ms").alias("to_ms")).distinct()
    before = F.lag("to_ms").over(Window.partitionBy("user_id").orderBy("to_ms"))
    return ends.select("user_id", F.coalesce(before + 1, F.col("to_ms") - DAY + 1).alias("from_ms"), "to_ms")


@query(f"""WITH {EVENT_ITEMS}, s AS (SELECT user_id, item_id, date_ms, {START + 3 * DAY} + (item_id % 30) * {DAY} AS expires FROM items)
    SELECT item_id, expires > date_ms AS valid, CASE WHEN expires > date_ms AND expires - date_ms < {7 * DAY} THEN date_ms + {30 * DAY} ELSE expires END AS new_expires,
      expires > date_ms AND coalesce(date_ms - lag(date_ms) OVER (PARTITION BY user_id ORDER BY item_id) >= 3600000, true) AS touch FROM s""")
def session_touch(spark, sf_dir):
    s = event_items(spark, sf_dir).select("user_id", "item_id", "date_ms", (START + 3 * DAY + (F.col("item_id") % 30) * DAY).alias("expires"))
    valid, left = F.col("expires") > F.col("date_ms"), F.col("expires") - F.col("date_ms")
    gap = F.col("date_ms") - F.lag("date_ms").over(Window.partitionBy("user_id").orderBy("item_id"))
    return s.select("item_id", valid.alias("valid"), F.when(valid & (left < 7 * DAY), F.col("date_ms") + 30 * DAY).otherwise(F.col("expires")).alias("new_expires"), (valid & F.coalesce(gap >= 3_600_000, F.lit(True))).alias("touch"))

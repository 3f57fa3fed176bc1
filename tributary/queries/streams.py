"""Streaming programs, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import EVENT_ITEMS, table
from ..streaming import programs
from .merges import ARRIVAL, arrival
from .scans import DAY


def stream(spark, sf_dir, name):
    """A glob, since a file stream takes a folder or a glob, and a table may be one file."""
    return programs.read(spark, f"{sf_dir}/{name}.parque[t]", table(spark, sf_dir, name).schema)


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {ARRIVAL}) = 1""")
def stream_upsert(spark, sf_dir):
    rows = stream(spark, sf_dir, "lineitem").withColumn("fetched_at", F.lit(1).cast("long"))
    found = programs.upsert_stream(rows, programs.folder(spark, "upsert"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_returnflag"], "fetched_at", arrival(), buckets=16)
    return found.read().drop("fetched_at")


@query("""WITH b AS (SELECT o_orderkey, o_orderstatus AS status, o_totalprice AS price, 1::BIGINT AS n FROM orders WHERE o_orderdate < TIMESTAMP '1997-07-01' AND o_orderkey % 10 <> 0
      UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'E' ELSE o_orderstatus END, o_totalprice, 2 FROM orders WHERE o_orderdate >= TIMESTAMP '1996-07-01' AND o_orderdate < TIMESTAMP '1999-07-01' AND o_orderkey % 10 <> 0
      UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 14 = 0 THEN 'F' ELSE o_orderstatus END, o_totalprice, 3 FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01' OR o_orderkey % 10 = 0),
    c AS (SELECT *, row_number() OVER w = 1 OR status IS DISTINCT FROM lag(status) OVER w OR price IS DISTINCT FROM lag(price) OVER w AS changed FROM b WINDOW w AS (PARTITION BY o_orderkey ORDER BY n))
    SELECT o_orderkey, arg_max(status, n) AS status, arg_max(price, n) AS price, max(n) FILTER (WHERE changed) AS fetched_at FROM c GROUP BY o_orderkey""")
def late_data_upsert(spark, sf_dir):
    """Three files of overlapping windows, a micro-batch each: a tenth of the orders comes late, others come again, some of them edited."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    key, date, late = F.col("o_orderkey"), F.col("o_orderdate"), F.col("o_orderkey") % 10 == 0
    edited = lambda n, to: F.when(key % n == 0, to).otherwise(F.col("status"))
    day = lambda x: F.lit(x).cast("timestamp")
    files = (
        o.where((date < day("1997-07-01")) & ~late),
        o.where((date >= day("1996-07-01")) & (date < day("1999-07-01")) & ~late).withColumn("status", edited(7, "E")),
        o.where((date >= day("1998-07-01")) | late).withColumn("status", edited(14, "F")),
    )
    root = programs.folder(spark, "late")
    for at, rows in enumerate(files, 1):
        rows = rows.drop("o_orderdate").withColumn("fetched_at", F.lit(at).cast("long"))
        rows.write.mode("append").parquet(f"{root}/landed")
        # as a scheduler would call it: each run takes what has landed since the one before
        found = programs.upsert_stream(programs.read(spark, f"{root}/landed", rows.schema), f"{root}/table", ["o_orderkey"], ["status", "price"], "fetched_at", [F.desc("fetched_at")], buckets=16)
    return found.read()


@query(f"""WITH RECURSIVE {EVENT_ITEMS}, o AS (SELECT user_id AS key, item_id AS pos, date_ms AS t, row_number() OVER (PARTITION BY user_id ORDER BY item_id) AS rn FROM items),
    f AS (SELECT key, pos, rn, 1::BIGINT AS n, t + {DAY} AS resets FROM o WHERE rn = 1
      UNION ALL SELECT o.key, o.pos, o.rn, CASE WHEN f.resets > o.t THEN f.n + 1 ELSE 1 END, CASE WHEN f.resets > o.t THEN f.resets ELSE o.t + {DAY} END FROM f JOIN o ON o.key = f.key AND o.rn = f.rn + 1)
    SELECT key AS user_id, pos, n AS count, n <= 2 AS allowed FROM f""")
def stream_rate_limit(spark, sf_dir):
    rows = stream(spark, sf_dir, "events").select("user_id", "event_id", F.expr("unix_millis(cast(ts as timestamp))").alias("t"))
    return programs.to_table(programs.rate_limited(rows, "user_id", "event_id", "t", DAY, 2), programs.folder(spark, "limits"))

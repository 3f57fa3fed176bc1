"""Greedy folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds
from ..registry import query
from ..sources.tables import EVENT_ITEMS, event_items, table
from .scans import DAY


def _pack_sql(rows: str, max_items: int, max_size: int) -> str:
    """``rows``: key, pos, size, kind."""
    return f"""WITH RECURSIVE r AS ({rows}), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS rn FROM r),
    f AS (SELECT key, pos, rn, 0::BIGINT AS batch, 1::BIGINT AS n, size AS total, kind FROM o WHERE rn = 1
      UNION ALL SELECT o.key, o.pos, o.rn, f.batch + CASE WHEN f.n >= {max_items} OR f.total + o.size > {max_size} OR f.kind <> o.kind THEN 1 ELSE 0 END,
        CASE WHEN f.n >= {max_items} OR f.total + o.size > {max_size} OR f.kind <> o.kind THEN 1 ELSE f.n + 1 END,
        CASE WHEN f.n >= {max_items} OR f.total + o.size > {max_size} OR f.kind <> o.kind THEN o.size ELSE f.total + o.size END, o.kind
      FROM f JOIN o ON o.key = f.key AND o.rn = f.rn + 1)
    SELECT key, pos, batch FROM f"""


@query(_pack_sql("SELECT source AS key, doc_id AS pos, n_chars AS size, '' AS kind FROM documents", 5, 8000))
def pack_next_fit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("key"), F.col("doc_id").alias("pos"), F.col("n_chars").alias("size"))
    return folds.next_fit(docs, ["key"], "pos", "size", 5, 8000)


@query(_pack_sql("SELECT conv_id % 7 AS key, conv_id AS pos, count(*) AS size, '' AS kind FROM conversations GROUP BY conv_id", 50, 12))
def pack_units(spark, sf_dir):
    """Whole conversations (never split) into checkpoints of at most 12 messages."""
    c = table(spark, sf_dir, "conversations").groupBy((F.col("conv_id") % 7).alias("key"), F.col("conv_id").alias("pos")).agg(F.count("*").alias("size"))
    return folds.next_fit(c, ["key"], "pos", "size", 50, 12)


@query(_pack_sql("SELECT source AS key, doc_id AS pos, n_chars AS size, lang AS kind FROM documents", 5, 20000))
def pack_same_detail(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("key"), F.col("doc_id").alias("pos"), F.col("n_chars").alias("size"), "lang")
    return folds.next_fit(docs, ["key"], "pos", "size", 5, 20000, same="lang")


@query("""WITH RECURSIVE r AS (SELECT source AS key, doc_id AS pos, strlen(text) AS size, 1 + len(string_split(text, chr(10))) % 9 AS m FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS rn FROM r),
    f AS (SELECT key, pos, rn, 0::BIGINT AS batch, 1 AS n, size AS total, m AS members FROM o WHERE rn = 1
      UNION ALL SELECT key, pos, rn, batch + CASE WHEN fits THEN 0 ELSE 1 END, CASE WHEN fits THEN n + 1 ELSE 1 END, CASE WHEN fits THEN total + 1 + size ELSE size END, CASE WHEN fits THEN members + m ELSE m END
      FROM (SELECT o.key, o.pos, o.rn, o.size, o.m, f.batch, f.n, f.total, f.members, f.n < 50 AND f.total + 1 + o.size <= 12000 AND f.members + o.m <= 20 AS fits FROM f JOIN o ON o.key = f.key AND o.rn = f.rn + 1))
    SELECT key, pos, batch FROM f""")
def pack_records(spark, sf_dir):
    """Records of one request: 50 at most, 20 members, and 12,000 bytes with a line feed between records."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("key"), F.col("doc_id").alias("pos"), F.octet_length("text").alias("size"), (1 + F.size(F.split("text", "\n")) % 9).alias("members"))
    return folds.next_fit(docs, ["key"], "pos", "size", 50, 12000, gap=1, members="members", max_members=20)


@query(f"""WITH RECURSIVE {EVENT_ITEMS}, o AS (SELECT user_id AS key, item_id AS pos, date_ms AS t, row_number() OVER (PARTITION BY user_id ORDER BY item_id) AS rn FROM items),
    f AS (SELECT key, pos, rn, 1::BIGINT AS n, t + {2 * DAY} AS resets FROM o WHERE rn = 1
      UNION ALL SELECT o.key, o.pos, o.rn, CASE WHEN f.resets > o.t THEN f.n + 1 ELSE 1 END, CASE WHEN f.resets > o.t THEN f.resets ELSE o.t + {2 * DAY} END FROM f JOIN o ON o.key = f.key AND o.rn = f.rn + 1)
    SELECT key, pos, n AS count, n <= 3 AS allowed FROM f""")
def rate_limit_fixed_window(spark, sf_dir):
    rows = event_items(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("item_id").alias("pos"), F.col("date_ms").alias("t"))
    return folds.fixed_window(rows, ["key"], "pos", "t", 2 * DAY, 3)


@query("""SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source) + 5000 - coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 60000 AS evict FROM documents""")
def quota_evict(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return folds.quota_evict(files, ["source"], ["doc_id"], "n_chars", 5000, 60000).select("source", "doc_id", "evict")


@query("""WITH RECURSIVE r AS (SELECT url.split_part('/', 3) AS host, page_id, strlen(html) AS size FROM pages), o AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS rn FROM r),
    f AS (SELECT host, page_id, rn, 0::BIGINT AS file, size AS total FROM o WHERE rn = 1
      UNION ALL SELECT o.host, o.page_id, o.rn, file + CASE WHEN f.total + o.size > 20000 THEN 1 ELSE 0 END, CASE WHEN f.total + o.size > 20000 THEN o.size ELSE f.total + o.size END FROM f JOIN o ON o.host = f.host AND o.rn = f.rn + 1)
    SELECT host, page_id AS pos, file, file >= max(file) OVER (PARTITION BY host) - 1 AS kept FROM f""")
def log_rotation(spark, sf_dir):
    """Log lines of a host: a new file before 20,000 bytes are exceeded, the last closed file and the open one are kept."""
    lines = table(spark, sf_dir, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), "page_id", F.octet_length("html").alias("size"))
    return folds.rotated(lines, ["host"], ["page_id"], "size", 20000)


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r, event_id AS k, event_type FROM events),
    l AS (SELECT user_id, r, CASE WHEN user_id % 3 = 0 THEN CASE WHEN r < 2 THEN 3 ELSE 0 END ELSE k % 4 * (CASE WHEN user_id % 5 = 0 THEN 4 ELSE 1 END) * (CASE WHEN r % 3 = 0 THEN 1 ELSE 0 END) END AS added, k % 41 = 0 AS stop,
      CASE WHEN user_id % 7 = 0 THEN r < 3 ELSE event_type <> 'click' END AS moved, k % 5 = 0 AS edge, k % 3 = 0 AS at_edge FROM e WHERE r < 9),
    f AS (SELECT user_id, -1 AS r, 0 AS items, false AS advanced, false AS into_new, 0 AS idle, false AS saw, false AS early, 0 AS stall, false AS settled, NULL::VARCHAR AS reason FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL SELECT user_id, r, items, CASE WHEN reason IS NULL THEN true ELSE advanced END, moved, idle, saw, early, stall2, CASE WHEN moved THEN false ELSE settled OR settles END,
        coalesce(reason, CASE WHEN probe THEN CASE WHEN settles THEN NULL WHEN NOT moved THEN 'boundary' WHEN NOT at_edge THEN 'no_progress' END WHEN stall2 >= 2 THEN 'boundary' END, CASE WHEN r + 1 >= 9 THEN 'max_rounds' END)
      FROM (SELECT *, CASE WHEN probe OR settles THEN 0 WHEN added = 0 AND NOT moved THEN stall + 1 ELSE 0 END AS stall2 FROM (
        SELECT *, advanced AND idle - early::INTEGER >= 2 AND saw AS probe, NOT moved AND edge AND NOT settled AS settles FROM (
          SELECT l.user_id, l.r, l.added, l.moved, l.edge, l.at_edge, least(f.items + l.added, 25)::INTEGER AS items, f.advanced, CASE WHEN l.added > 0 THEN 0 ELSE f.idle + 1 END AS idle, l.added = 0 AND (f.saw OR (f.advanced AND f.into_new)) AS saw,
            l.added = 0 AND (f.early OR (f.idle = 0 AND NOT f.advanced)) AS early, CASE WHEN l.added > 0 THEN 0 ELSE f.stall END AS stall, l.added = 0 AND f.settled AS settled, CASE WHEN l.stop THEN 'condition' WHEN l.added > 0 AND f.items + l.added >= 25 THEN 'max_items' END AS reason
          FROM f JOIN l ON l.user_id = f.user_id AND l.r = f.r + 1 WHERE f.reason IS NULL))))
    SELECT user_id, arg_max(reason, r) FILTER (WHERE reason IS NOT NULL) AS stop_reason, max(r)::INTEGER AS stopped_at, arg_max(items, r) AS items FROM f GROUP BY user_id""")
def scan_stop_reason(spark, sf_dir):
    """Every user's events as the round log of a scan: nine rounds, two stalls and 25 items at most."""
    from pyspark.sql import Window

    k, u = F.col("event_id"), F.col("user_id")
    r = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", r.alias("round"))
    busy = k % 4 * F.when(u % 5 == 0, 4).otherwise(1) * F.when(F.col("round") % 3 == 0, 1).otherwise(0)
    added = F.when(u % 3 == 0, F.when(F.col("round") < 2, 3).otherwise(0)).otherwise(busy)
    moved = F.when(u % 7 == 0, F.col("round") < 3).otherwise(F.col("event_type") != "click")
    log = rows.select("user_id", "round", added.alias("added"), (k % 41 == 0).alias("stop"), moved.alias("moved"), (k % 5 == 0).alias("edge"), (k % 3 == 0).alias("at_edge"))
    return folds.scan_stops(log, "user_id", 9, 2, 25)


@query("""WITH w AS (SELECT conv_id, list(role ORDER BY turn) AS a FROM conversations GROUP BY conv_id),
    p AS (SELECT x.conv_id, x.a AS a, y.a AS b FROM w x JOIN w y ON y.conv_id = x.conv_id + 1),
    k AS (SELECT conv_id, list_filter(range(1, least(len(a), len(b)) + 1), lambda n: list_slice(a, len(a) - n + 1, len(a)) = list_slice(b, 1, n)) AS lens FROM p)
    SELECT conv_id, coalesce(list_max(lens), 0) AS overlap, len(lens) AS candidates FROM k""")
def window_overlap_merge(spark, sf_dir):
    """The longest end of one window that begins the next, and how many lengths would do."""
    w = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("a"))
    nxt = w.select((F.col("conv_id") - 1).alias("conv_id"), F.col("a").alias("b"))
    lengths = F.sequence(F.lit(1), F.least(F.size("a"), F.size("b")))
    overlaps = F.filter(lengths, lambda n: F.slice("a", F.size("a") - n + 1, n) == F.slice("b", F.lit(1), n))
    pairs = w.join(nxt, "conv_id").withColumn("overlaps", overlaps)
    return pairs.select("conv_id", F.coalesce(F.array_max("overlaps"), F.lit(0)).cast("long").alias("overlap"), F.size("overlaps").cast("long").alias("candidates"))

"""Scans, selections and predicates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import filters, positions
from ..registry import query
from ..session import shared_folder
from ..sources import archive
from ..sources.tables import DOCUMENT_ITEMS, EVENT_ITEMS, document_items, event_items, table

DAY = 86_400_000
#: 2024-01-01 in epoch milliseconds; the events lie in that January.
START = 1_704_067_200_000
#: Posts of an archive page.
PAGE = 500


@query(f"WITH {EVENT_ITEMS} SELECT item_id, feed_id, date_ms FROM items WHERE date_ms BETWEEN {START + 3 * DAY} AND {START + 9 * DAY}")
def scan_window(spark, sf_dir):
    return filters.in_window(event_items(spark, sf_dir), START + 3 * DAY, START + 9 * DAY).select("item_id", "feed_id", "date_ms")


@query(f"""WITH {EVENT_ITEMS}, last AS (SELECT feed_id, max(date_ms) AS last_ms FROM items GROUP BY feed_id)
    SELECT i.item_id, i.feed_id FROM items i JOIN last l USING (feed_id)
    WHERE l.last_ms >= {START} AND i.feed_id IN ('view', 'click', 'purchase') AND i.feed_id NOT IN ('view')""")
def scan_selected_feeds(spark, sf_dir):
    items = event_items(spark, sf_dir)
    return filters.selected_feeds(items, ["view", "click", "purchase"], excluded=["view"], since_ms=START).select("item_id", "feed_id")


@query(f"""WITH {EVENT_ITEMS} SELECT item_id, feed_id, date_ms FROM items
    WHERE feed_id IN ('signup', 'error') AND date_ms BETWEEN {START} AND {START + 15 * DAY}""")
def items_in_window(spark, sf_dir):
    items = event_items(spark, sf_dir)
    return filters.in_window(items, START, START + 15 * DAY, feeds=["signup", "error"]).select("item_id", "feed_id", "date_ms")


@query(f"""WITH {DOCUMENT_ITEMS} SELECT min(item_id) AS item_id, feed_id, sha256(text) AS digest FROM items
    WHERE lang IN ('en', 'de') AND date_ms <= {START + DAY // 2} GROUP BY feed_id, sha256(text)""")
def archive_scan_dedupe(spark, sf_dir):
    items = document_items(spark, sf_dir)
    return filters.archive_scan(items, ["en", "de"], START + DAY // 2).select("item_id", "feed_id", "digest")


@query(f"""SELECT event_id + 1 AS post_id, event_type AS kind, concat('Post ', event_id) AS title, epoch_us(ts) // 1000 AS date_ms, props AS text FROM events WHERE event_type IN ('view', 'purchase') AND epoch_us(ts) // 1000 BETWEEN {START + 9 * DAY} AND {START + 20 * DAY}""")
def archive_pages(spark, sf_dir):
    """The events as an archive, newest first, some posts a page, written as JSON pages; then scanned page by page until one lies before the window."""
    posts = event_items(spark, sf_dir).select((F.col("item_id") + 1).alias("id"), F.col("feed_id").alias("type"), F.concat(F.lit("Post "), F.col("item_id").cast("string")).alias("title"), "date_ms", F.col("meta").alias("text"))
    numbered = positions.numbered(posts, [F.desc("date_ms"), F.asc("id")], "place").withColumn("page", F.format_string("%09d", F.floor((F.col("place") - 1) / PAGE)))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct("id", "type", "title", "date_ms", "text").alias("post")))), lambda x: x["post"])
    root = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    numbered.groupBy("page").agg(F.to_json(listed).alias("value")).repartition("page").write.partitionBy("page").text(root)
    return archive.scan(spark, archive.names(spark, f"{root}/page=*/part-*"), ["view", "purchase"], START + 9 * DAY, START + 20 * DAY)


@query("SELECT DISTINCT event_type AS feed_id, cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE cast(json_extract_string(props, '$.k') AS INTEGER) < 10")
def json_path_distinct(spark, sf_dir):
    k = F.get_json_object("meta", "$.k").cast("int")
    return event_items(spark, sf_dir).select("feed_id", k.alias("k")).where("k < 10").distinct()


@query(f"""WITH {EVENT_ITEMS}, cursors AS (SELECT feed_id, max(date_ms) FILTER (WHERE item_id % 2 = 0 AND feed_id <> 'error') AS cursor_ms FROM items GROUP BY feed_id)
    SELECT feed_id, cursor_ms, CASE WHEN cursor_ms IS NULL OR feed_id = 'click' THEN {START} ELSE cursor_ms + 1 END AS from_ms,
           {START + 40 * DAY} AS to_ms, cursor_ms IS NOT NULL AND cursor_ms >= {START + 40 * DAY} AS already_ingested FROM cursors""")
def incremental_window(spark, sf_dir):
    items = event_items(spark, sf_dir)
    cursors = items.groupBy("feed_id").agg(F.max(F.when((F.col("item_id") % 2 == 0) & (F.col("feed_id") != "error"), F.col("date_ms"))).alias("cursor_ms"))
    return filters.incremental_window(cursors, START, START + 40 * DAY, refresh=F.col("feed_id") == "click")


MODES = """feeds AS (SELECT o_orderkey AS feed_id, CASE o_orderkey % 4 WHEN 0 THEN 'inherit' WHEN 1 THEN 'personalized' WHEN 2 THEN NULL ELSE 'inherit' END AS feed_mode,
    CASE o_custkey % 3 WHEN 0 THEN 'inherit' WHEN 1 THEN 'include_all' ELSE 'inherit' END AS source_mode, o_orderstatus = 'P' AS warmup, 'personalized' AS user_mode FROM orders)"""


@query(f"""WITH {MODES} SELECT feed_id, coalesce(nullif(feed_mode, 'inherit'), nullif(source_mode, 'inherit'), CASE WHEN warmup THEN 'include_all' END, user_mode) AS effective_mode FROM feeds""")
def effective_mode(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 4
    feeds = o.select(
        F.col("o_orderkey").alias("feed_id"),
        F.when(k.isin(0, 3), "inherit").when(k == 1, "personalized").alias("feed_mode"),
        F.when(F.col("o_custkey") % 3 == 1, "include_all").otherwise("inherit").alias("source_mode"),
        (F.col("o_orderstatus") == "P").alias("warmup"),
        F.lit("personalized").alias("user_mode"),
    )
    return feeds.select("feed_id", filters.effective_mode("feed_mode", "source_mode", "warmup", "user_mode").alias("effective_mode"))


@query("""SELECT doc_id, regexp_matches(text, '\\p{L}') AS has_letter FROM documents
    WHERE regexp_matches(text, '\\p{L}') OR lang = 'es'""")
def letterless_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return filters.with_letters(docs, "text", exempt=F.col("lang") == "es").select("doc_id", filters.has_letter("text").alias("has_letter"))


@query("""SELECT doc_id, lang, source FROM documents
    WHERE NOT coalesce((CASE WHEN lang = 'fr' THEN 'only_paid' WHEN lang = 'de' THEN 'everyone' END) = 'only_paid' AND (CASE WHEN doc_id % 2 = 0 THEN 'preview' ELSE 'full' END) = 'preview', false)""")
def exclude_inaccessible(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source",
        F.when(F.col("lang") == "fr", "only_paid").when(F.col("lang") == "de", "everyone").alias("audience"),
        F.when(F.col("doc_id") % 2 == 0, "preview").otherwise("full").alias("content_access"),
    )
    return docs.where(~filters.inaccessible("audience", "content_access")).select("doc_id", "lang", "source")


@query("SELECT o_orderkey AS feed_id FROM orders WHERE nullif(o_orderstatus, 'F') IS NOT NULL")
def active_feeds(spark, sf_dir):
    feeds = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("feed_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("deleted_at"))
    return filters.not_deleted(feeds).select("feed_id")


@query("""SELECT o_orderkey AS rule_id FROM orders WHERE o_orderstatus <> 'F'
    AND (o_orderpriority = '1-URGENT' OR o_orderdate > TIMESTAMP '1995-06-01')""")
def active_rules(spark, sf_dir):
    rules = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("rule_id"),
        F.when(F.col("o_orderstatus") != "F", "active").otherwise("dismissed").alias("state"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderdate")).alias("expires_at"),
    )
    return filters.active_rules(rules, F.lit("1995-06-01").cast("timestamp_ntz")).select("rule_id")


@query("""SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1997-01-01' THEN 'failed' ELSE o_orderstatus END AS status FROM orders""")
def recover_stale(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("started_at"))
    return filters.recover_stale(runs, F.lit("1997-01-01").cast("timestamp_ntz"), running="O").select("run_id", "status")


@query(f"""WITH {EVENT_ITEMS}, b AS (SELECT item_id, lag(date_ms) OVER (PARTITION BY user_id ORDER BY date_ms, item_id) AS lower_ms,
      lead(date_ms) OVER (PARTITION BY user_id ORDER BY date_ms, item_id) AS upper_ms FROM items)
    SELECT item_id, lower_ms, upper_ms,
      CASE WHEN upper_ms < {START + 5 * DAY} OR lower_ms > {START + 12 * DAY} THEN 'outside'
           WHEN lower_ms >= {START + 5 * DAY} AND upper_ms <= {START + 12 * DAY} AND lower_ms <= upper_ms THEN 'inside' ELSE 'ambiguous' END AS verdict,
      CASE WHEN lower_ms >= {START + 5 * DAY} AND upper_ms <= {START + 12 * DAY} AND lower_ms <= upper_ms
           AND NOT (upper_ms < {START + 5 * DAY} OR lower_ms > {START + 12 * DAY}) THEN lower_ms END AS date_ms FROM b""")
def bounded_window_date(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("date_ms", "item_id")
    rows = event_items(spark, sf_dir).select("item_id", F.lag("date_ms").over(w).alias("lower_ms"), F.lead("date_ms").over(w).alias("upper_ms"))
    return filters.bounded_dates(rows, START + 5 * DAY, START + 12 * DAY).select("item_id", "lower_ms", "upper_ms", "verdict", "date_ms")


@query("""SELECT c_custkey AS source_id, c_acctbal >= 0 AS connected, c_mktsegment AS kind FROM customer""")
def public_sources(spark, sf_dir):
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_mktsegment").alias("kind"), F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("credentials"))
    return filters.without_secrets(sources, "credentials").select("source_id", "connected", "kind")


@query("""SELECT n.n_nationkey AS feed_id, CASE WHEN r.r_regionkey IN (1, 3) THEN 'source_disabled' ELSE 'ready' END AS plan FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
    WHERE n.n_nationkey % 5 <> 0""")
def enabled_plan(spark, sf_dir):
    feeds = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("feed_id"), F.col("n_regionkey").alias("source_id"), (F.col("n_nationkey") % 5 != 0).alias("enabled"))
    sources = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("source_id"), (~F.col("r_regionkey").isin(1, 3)).alias("enabled"))
    return filters.enabled_plan(feeds, sources).select("feed_id", "plan")


@query(f"""WITH {EVENT_ITEMS}, paid AS (SELECT DISTINCT feed_id FROM items WHERE cast(json_extract_string(meta, '$.k') AS INTEGER) = 7 AND date_ms <= {START + 2 * DAY})
    SELECT DISTINCT i.feed_id, p.feed_id IS NOT NULL AS refresh, CASE WHEN p.feed_id IS NOT NULL THEN {START} ELSE {START + 10 * DAY} END AS from_ms
    FROM items i LEFT JOIN paid p USING (feed_id)""")
def refresh_plan(spark, sf_dir):
    items = event_items(spark, sf_dir)
    paid = filters.in_window(items, None, START + 2 * DAY).where(F.get_json_object("meta", "$.k").cast("int") == 7)
    return filters.refresh_plan(items.select("feed_id").distinct(), paid, START, START + 10 * DAY)


@query("""SELECT CASE WHEN event_type IN ('view', 'click') THEN 'discussion' ELSE 'news' END AS kind, concat(CASE WHEN event_type IN ('view', 'click') THEN 'chat:' ELSE 'channel:' END, user_id) AS external_id, count(*) AS items
    FROM events GROUP BY ALL""")
def classify_kind(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("dialog", F.when(F.col("event_type").isin("view", "click"), "chat").otherwise("channel"))
    kind, external = filters.feed_kind("dialog", "user_id")
    return e.groupBy(kind.alias("kind"), external.alias("external_id")).agg(F.count("*").alias("items"))


@query("""SELECT event_id AS item_id, CASE event_type WHEN 'view' THEN '[Photo]' WHEN 'click' THEN '[Video]' WHEN 'signup' THEN concat('[Document: ', 'text/', user_id, ']')
    WHEN 'error' THEN concat('[Web page: https://h/', user_id, ']') ELSE '[Album: 2 photos]' END AS descriptor FROM events""")
def media_fallback(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "photo").when(F.col("event_type") == "click", "video").when(F.col("event_type") == "signup", "document").when(F.col("event_type") == "error", "webpage").otherwise("album")
    media = F.struct(kind.alias("type"), F.array(F.lit("a"), F.lit("b")).alias("paths"), F.concat(F.lit("text/"), "user_id").alias("mime"), F.concat(F.lit("https://h/"), "user_id").alias("url"))
    return e.select(F.col("event_id").alias("item_id"), media.alias("media")).select("item_id", filters.media_descriptor("media").alias("descriptor"))


@query("""SELECT doc_id, source, n_chars FROM documents WHERE lang <> 'fr' AND n_chars > 100 AND text <> '' ORDER BY doc_id DESC""")
def timeline_collect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.where((F.col("lang") != "fr") & (F.col("n_chars") > 100) & (F.col("text") != "")).orderBy(F.desc("doc_id")).select("doc_id", "source", "n_chars")


@query(f"""WITH {EVENT_ITEMS} SELECT item_id FROM items WHERE {START + 20 * DAY} - date_ms > {7 * DAY}""")
def ttl_expired(spark, sf_dir):
    return filters.ttl_expired(event_items(spark, sf_dir), "date_ms", START + 20 * DAY, 7 * DAY).select("item_id")


@query("""SELECT CASE WHEN try_cast(l_orderkey AS BIGINT) > 0 AND l_linestatus <> '' AND l_shipdate IS NOT NULL AND l_linenumber <= 6 THEN 'ok' ELSE 'bad' END AS verdict, count(*) AS n FROM lineitem GROUP BY 1""")
def parse_validate_records(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").select(F.to_json(F.struct(F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("type"), F.col("l_linenumber").alias("part"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"))).alias("json"))
    rows = filters.parsed(raw, "json", "id long, type string, part int, date string", "id > 0 AND trim(type) <> '' AND to_date(date) IS NOT NULL AND part <= 6")
    return rows.groupBy("verdict").agg(F.count("*").alias("n"))

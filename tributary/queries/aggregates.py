"""Aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merges, usage
from ..registry import query
from ..sources.tables import EVENT_ITEMS, event_items, table
from .scans import DAY, START


@query("SELECT o_custkey AS source_id, count(*) AS feeds, count(*) >= 20 AS conflict FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey")
def capacity_guard(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    return o.groupBy(F.col("o_custkey").alias("source_id")).agg(F.count("*").alias("feeds")).withColumn("conflict", F.col("feeds") >= 20)


@query("SELECT l_orderkey AS story_id, max(l_linenumber) AS version FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey")
def latest_delivered_version(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'")
    return l.groupBy(F.col("l_orderkey").alias("story_id")).agg(F.max("l_linenumber").alias("version"))


@query(f"WITH {EVENT_ITEMS} SELECT user_id, feed_id, least(min(date_ms), {START + 5 * DAY}) AS occurred_at, max(date_ms) AS last_ms, count(*) AS members FROM items GROUP BY user_id, feed_id")
def development_rollup(spark, sf_dir):
    g = event_items(spark, sf_dir).groupBy("user_id", "feed_id")
    return g.agg(F.least(F.min("date_ms"), F.lit(START + 5 * DAY)).alias("occurred_at"), F.max("date_ms").alias("last_ms"), F.count("*").alias("members"))


@query(f"WITH {EVENT_ITEMS} SELECT feed_id, max(date_ms) AS last_ms FROM items GROUP BY feed_id")
def latest_fetch_per_feed(spark, sf_dir):
    return event_items(spark, sf_dir).groupBy("feed_id").agg(F.max("date_ms").alias("last_ms"))


@query("SELECT source AS story_id, array_to_string(list_sort(list_distinct(list(lang))), ',') AS topics FROM documents GROUP BY source")
def label_union(spark, sf_dir):
    labels = F.array_join(F.array_sort(F.collect_set("lang")), ",")
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("story_id")).agg(labels.alias("topics"))


@query("""WITH w AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: trim(x) <> '') AS words FROM documents),
    u AS (SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM w), g AS (SELECT doc_id, w, min(i) AS i FROM u GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM g) SELECT doc_id, string_agg(w, '|' ORDER BY i) AS labels FROM r WHERE rn <= 5 GROUP BY doc_id""")
def label_cap(spark, sf_dir):
    words = F.filter(F.split("text", " "), lambda x: F.trim(x) != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(F.array_distinct(words), 1, 5), "|").alias("labels"))


@query("SELECT c_mktsegment AS grp, min(c_custkey) AS first_id, count(*) AS n, row_number() OVER (ORDER BY min(c_custkey)) AS place FROM customer GROUP BY c_mktsegment")
def ordered_group(spark, sf_dir):
    from pyspark.sql import Window

    groups = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("grp")).agg(F.min("c_custkey").alias("first_id"), F.count("*").alias("n"))
    return groups.withColumn("place", F.row_number().over(Window.orderBy("first_id")).cast("long"))


@query(f"""WITH {EVENT_ITEMS}, a AS (SELECT *, user_id AS album, CASE WHEN item_id % 4 = 0 THEN '' ELSE feed_id END AS caption FROM items)
    SELECT album, min(item_id) AS item_id, arg_min(date_ms, item_id) AS date_ms, arg_min(caption, item_id) FILTER (WHERE trim(caption) <> '') AS caption,
      bool_or(item_id % 97 = 0) AS pinned, array_to_string(list(external_id ORDER BY item_id) FILTER (WHERE feed_id = 'purchase'), ',') AS paths,
      CASE WHEN count(*) FILTER (WHERE feed_id = 'purchase') > 1 THEN 'album' WHEN count(*) FILTER (WHERE feed_id = 'purchase') = 1 THEN 'photo' END AS media FROM a GROUP BY album""")
def album_fold(spark, sf_dir):
    a = event_items(spark, sf_dir).withColumn("album", F.col("user_id")).withColumn("caption", F.when(F.col("item_id") % 4 == 0, "").otherwise(F.col("feed_id")))
    photo = F.col("feed_id") == "purchase"
    paths = F.transform(F.array_sort(F.collect_list(F.when(photo, F.struct("item_id", "external_id")))), lambda x: x["external_id"])
    out = a.groupBy("album").agg(
        F.min("item_id").alias("item_id"),
        F.min_by("date_ms", "item_id").alias("date_ms"),
        F.min_by("caption", F.when(F.trim("caption") != "", F.col("item_id"))).alias("caption"),
        F.bool_or(F.col("item_id") % 97 == 0).alias("pinned"),
        F.when(F.count_if(photo) > 0, F.array_join(paths, ",")).alias("paths"),
        F.count_if(photo).alias("photos"),
    )
    return out.withColumn("media", F.when(F.col("photos") > 1, "album").when(F.col("photos") == 1, "photo")).drop("photos")


@query(f"WITH {EVENT_ITEMS} SELECT min(date_ms) AS from_ms, max(date_ms) AS to_ms, count(DISTINCT feed_id) AS feeds FROM items WHERE feed_id <> 'error'")
def union_window(spark, sf_dir):
    return event_items(spark, sf_dir).where("feed_id <> 'error'").agg(F.min("date_ms").alias("from_ms"), F.max("date_ms").alias("to_ms"), F.countDistinct("feed_id").alias("feeds"))


USAGE = """u AS (SELECT l_returnflag AS stage, l_linestatus AS model, cast(l_quantity AS BIGINT) * 1000 AS prompt, cast(l_linenumber AS BIGINT) * 100 AS completion,
    CASE WHEN l_linenumber % 2 = 0 THEN cast(l_quantity AS BIGINT) * 400 END AS hit, CASE WHEN l_linenumber % 3 = 0 THEN cast(l_quantity AS BIGINT) * 500 END AS miss, l_orderkey, l_linenumber FROM lineitem)"""


def usage_rows(spark, sf_dir):
    q, n = F.col("l_quantity").cast("long"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("stage"), F.col("l_linestatus").alias("model"),
        (q * 1000).alias("prompt"), (n.cast("long") * 100).alias("completion"),
        F.when(n % 2 == 0, q * 400).alias("hit"), F.when(n % 3 == 0, q * 500).alias("miss"), "l_orderkey", "l_linenumber",
    )


@query(f"""WITH {USAGE}, a AS (SELECT stage, CASE WHEN l_orderkey % 9 = 0 THEN 'unknown' ELSE model END AS model, ['success', 'retry', 'failure'][l_linenumber % 3 + 1] AS status, l_orderkey % 1000 AS duration_ms, l_linenumber % 5 <> 0 AS told, prompt, completion, hit, miss FROM u)
    SELECT stage, model, cast(grouping(stage, model) AS BIGINT) AS level, count(*) AS attempts, cast(sum(duration_ms) AS BIGINT) AS duration_ms, count(*) FILTER (WHERE told) AS reported, cast(coalesce(sum(prompt) FILTER (WHERE told), 0) AS BIGINT) AS prompt,
      cast(coalesce(sum(completion) FILTER (WHERE told), 0) AS BIGINT) AS completion, cast(coalesce(sum(prompt + completion) FILTER (WHERE told), 0) AS BIGINT) AS total, cast(coalesce(sum(hit) FILTER (WHERE told), 0) AS BIGINT) AS hit, cast(coalesce(sum(miss) FILTER (WHERE told), 0) AS BIGINT) AS miss,
      count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'retry') AS retry, count(*) FILTER (WHERE status = 'failure') AS failure, false AS saturated
    FROM a GROUP BY GROUPING SETS ((), (stage, model))""")
def usage_grouping_sets(spark, sf_dir):
    n, told = F.col("l_linenumber"), F.col("l_linenumber") % 5 != 0
    attempts = usage_rows(spark, sf_dir).select(
        "stage", F.when(F.col("l_orderkey") % 9 != 0, F.col("model")).alias("model"), F.get(F.array(*map(F.lit, ("success", "retry", "failure"))), (n % 3).cast("int")).alias("status"),
        (F.col("l_orderkey") % 1000).alias("duration_ms"), *[F.when(told, F.col(c)).alias(c) for c in ("prompt", "completion", "hit", "miss")], F.when(told, F.col("prompt") + F.col("completion")).alias("total"),
    )
    return usage.rollup(attempts)


@query(f"""WITH {USAGE}, big AS (SELECT stage, model, prompt::HUGEINT * 40000000 AS v FROM u)
    SELECT stage, model, cast(least(sum(v), 9007199254740991) AS BIGINT) AS total, sum(v) > 9007199254740991 AS saturated FROM big GROUP BY stage, model""")
def saturating_sum(spark, sf_dir):
    v = F.col("prompt").cast("decimal(30,0)") * 40000000
    return usage_rows(spark, sf_dir).groupBy("stage", "model").agg(usage.saturating_sum(v).alias("total"), usage.saturated(v).alias("saturated"))


COST = """c AS (SELECT *, least(prompt, coalesce(hit, greatest(0, prompt - coalesce(miss, prompt)))) AS cached FROM u),
    d AS (SELECT *, least(prompt, coalesce(miss, greatest(0, prompt - cached))) AS uncached FROM c)"""


@query(f"WITH {USAGE}, {COST} SELECT stage, model, cast(sum(uncached * 2 + cached * 1 + completion * 4) AS BIGINT) AS micro_cost, cast(sum(cached) AS BIGINT) AS cached, cast(sum(uncached) AS BIGINT) AS uncached FROM d GROUP BY stage, model")
def token_cost(spark, sf_dir):
    p, h, m, c = (F.col(x) for x in ("prompt", "hit", "miss", "completion"))
    one = [F.lit(x) for x in (2, 1, 4)]
    return usage_rows(spark, sf_dir).groupBy("stage", "model").agg(
        F.sum(usage.micro_cost(p, h, m, c, *one)).alias("micro_cost"), F.sum(usage.cached_tokens(p, h, m)).alias("cached"), F.sum(usage.uncached_tokens(p, h, m)).alias("uncached")
    )


@query(f"""WITH {USAGE}, p AS (SELECT l_orderkey % 50 AS run, model, prompt, CASE WHEN l_orderkey % 50 < 10 AND l_linenumber = 7 THEN NULL ELSE 2 + (CASE WHEN l_orderkey % 50 > 40 THEN l_linenumber % 2 ELSE 0 END) END AS price FROM u)
    SELECT run, model, CASE WHEN bool_and(price IS NOT NULL) AND count(DISTINCT price) <= 1 THEN cast(sum(prompt * price) AS BIGINT) END AS cost, count(*) AS attempts FROM p GROUP BY run, model""")
def cost_poison(spark, sf_dir):
    run, n = F.col("l_orderkey") % 50, F.col("l_linenumber")
    price = F.when((run < 10) & (n == 7), F.lit(None)).otherwise(2 + F.when(run > 40, n % 2).otherwise(0))
    rows = usage_rows(spark, sf_dir).select(run.alias("run"), "model", "prompt", price.alias("price"))
    cost = usage.poisoned_sum(F.col("prompt") * F.col("price"), F.col("price").isNotNull())
    one_price = F.coalesce(F.min("price") == F.max("price"), F.lit(True))
    return rows.groupBy("run", "model").agg(F.when(one_price, cost).alias("cost"), F.count("*").alias("attempts"))


@query(f"""WITH {USAGE} SELECT stage, count(*) FILTER (WHERE prompt >= 0 AND completion >= 0 AND prompt + completion + (CASE WHEN l_linenumber = 5 THEN 1 ELSE 0 END) = prompt + completion AND coalesce(hit + miss = prompt, true)) AS valid, count(*) AS n FROM u GROUP BY stage""")
def usage_validate(spark, sf_dir):
    p, c, h, m = (F.col(x) for x in ("prompt", "completion", "hit", "miss"))
    total = p + c + F.when(F.col("l_linenumber") == 5, 1).otherwise(0)
    return usage_rows(spark, sf_dir).groupBy("stage").agg(F.count_if(usage.valid_usage(p, c, total, h, m)).alias("valid"), F.count("*").alias("n"))


@query(f"""WITH {EVENT_ITEMS}, r AS (SELECT user_id AS message, feed_id AS emoji, max(item_id % 50) AS n, bool_or(item_id % 101 = 0) AS viewer FROM items GROUP BY ALL)
    SELECT message, cast(sum(n) AS BIGINT) AS reactions, bool_or(viewer) AS viewer, count(*) AS kinds FROM r GROUP BY message""")
def reaction_rollup(spark, sf_dir):
    each = event_items(spark, sf_dir).groupBy(F.col("user_id").alias("message"), "feed_id").agg(F.max(F.col("item_id") % 50).alias("n"), F.bool_or(F.col("item_id") % 101 == 0).alias("viewer"))
    return each.groupBy("message").agg(F.sum("n").alias("reactions"), F.bool_or("viewer").alias("viewer"), F.count("*").alias("kinds"))


@query("SELECT user_id, coalesce(arg_min(event_type, event_id) FILTER (WHERE event_type NOT IN ('view', 'click')), 'unnamed') AS name FROM events GROUP BY user_id")
def first_non_null(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    named = F.when(~F.col("event_type").isin("view", "click"), F.col("event_id"))
    return e.groupBy("user_id").agg(F.coalesce(F.min_by("event_type", named), F.lit("unnamed")).alias("name"))


@query("SELECT l_orderkey AS story, CASE WHEN count(DISTINCT l_returnflag) = 1 AND count(l_returnflag) = count(*) THEN min(l_returnflag) END AS author FROM lineitem GROUP BY l_orderkey")
def all_equal_author(spark, sf_dir):
    same = (F.min("l_returnflag") == F.max("l_returnflag")) & (F.count("l_returnflag") == F.count("*"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("story")).agg(F.when(same, F.min("l_returnflag")).alias("author"))


@query("""WITH n AS (SELECT DISTINCT source, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 0), r AS (SELECT *, length(source) % 3 AS before, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM n)
    SELECT source, (before + count(*) FILTER (WHERE before + k <= 5))::BIGINT AS negatives, bool_or(before + k = 5) AS graduated, min(doc_id) FILTER (WHERE before + k = 5) AS graduated_by FROM r GROUP BY source, before""")
def warmup_graduation(spark, sf_dir):
    """Each bad document is an event; a source counts it while it is warm, up to five, some having counted before."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").where("quality = 0").select("doc_id"), "doc_id")
    sources = d.select("source", (F.char_length("source") % 3).alias("negatives")).distinct()
    return merges.warmed(sources, d, "source", "doc_id", 5)


@query("""SELECT l_suppkey AS source, l_returnflag AS feed, CASE WHEN max(max(l_quantity)) OVER (PARTITION BY l_suppkey) > 49 THEN 'connector deadline exceeded' WHEN l_returnflag = 'N' AND l_suppkey % 4 = 0 THEN 'refused' WHEN bool_or(l_discount > 0.095) THEN 'an invalid item' END AS failure,
    CASE WHEN max(max(l_quantity)) OVER (PARTITION BY l_suppkey) > 49 OR (l_returnflag = 'N' AND l_suppkey % 4 = 0) OR bool_or(l_discount > 0.095) THEN 0 ELSE count(*) END AS fetched FROM lineitem GROUP BY l_suppkey, l_returnflag""")
def ingest_isolation(spark, sf_dir):
    """A source's feeds by return flag: late sources fail whole, refused feeds and those with an invalid item alone."""
    from ..operators import discovery

    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_returnflag").alias("feed"), "l_quantity", (F.col("l_discount") > 0.095).alias("bad"))
    runs = l.groupBy("source", "feed").agg(F.max("l_quantity").alias("took_ms")).withColumn("error", F.when((F.col("feed") == "N") & (F.col("source") % 4 == 0), "refused"))
    return discovery.ingested(l, runs, 49)[0]


@query("""SELECT l_orderkey AS run, CASE WHEN bool_and(l_returnflag = 'R') THEN 'failed' WHEN bool_or(l_returnflag = 'R') THEN 'partial' ELSE 'complete' END AS status FROM lineitem GROUP BY l_orderkey""")
def run_status(spark, sf_dir):
    bad = F.col("l_returnflag") == "R"
    status = F.when(F.bool_and(bad), "failed").when(F.bool_or(bad), "partial").otherwise("complete")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(status.alias("status"))


@query("""SELECT l_suppkey AS feed_id, count(*) FILTER (WHERE l_returnflag <> 'R') AS fetched, count(*) FILTER (WHERE l_returnflag = 'R') AS failed,
    CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') = 0 THEN 'ok' WHEN count(*) FILTER (WHERE l_returnflag <> 'R') = 0 THEN 'failed' ELSE 'partial' END AS status FROM lineitem GROUP BY l_suppkey""")
def ingest_status(spark, sf_dir):
    bad = F.col("l_returnflag") == "R"
    out = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("feed_id")).agg(F.count_if(~bad).alias("fetched"), F.count_if(bad).alias("failed"))
    return out.withColumn("status", F.when(F.col("failed") == 0, "ok").when(F.col("fetched") == 0, "failed").otherwise("partial"))


@query("SELECT o_custkey AS user_id, count(*) AS running FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey HAVING count(*) > 1")
def active_run_conflict(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("running")).where("running > 1")


@query("SELECT l_orderkey AS story_id, CASE WHEN bool_or(l_returnflag = 'A') THEN 'thorough' ELSE 'brief' END AS detail FROM lineitem GROUP BY l_orderkey")
def story_detail_level(spark, sf_dir):
    detail = F.when(F.bool_or(F.col("l_returnflag") == "A"), "thorough").otherwise("brief")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("story_id")).agg(detail.alias("detail"))


@query("SELECT o_orderkey AS story_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def visible_stories(spark, sf_dir):
    hidden = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("story_id"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("story_id")).join(hidden, "story_id", "left_anti")


@query("""SELECT o_custkey AS digest, o_orderkey AS article, CASE WHEN o_orderpriority = '1-URGENT' THEN 'paid' WHEN o_orderpriority = '2-HIGH' THEN 'inaccessible' WHEN o_orderdate > c.d THEN 'stale' ELSE 'shown' END AS part
    FROM orders JOIN (SELECT o_custkey AS k, max(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS d FROM orders GROUP BY o_custkey) c ON o_custkey = c.k""")
def article_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    made = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("generated_at"))
    part = F.when(F.col("o_orderpriority") == "1-URGENT", "paid").when(F.col("o_orderpriority") == "2-HIGH", "inaccessible").when(F.col("o_orderdate") > F.col("generated_at"), "stale").otherwise("shown")
    return o.join(made, "o_custkey", "left").select(F.col("o_custkey").alias("digest"), F.col("o_orderkey").alias("article"), part.alias("part"))

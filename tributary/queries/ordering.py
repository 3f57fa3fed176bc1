"""Orders, limits, pages and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import paging
from ..registry import query
from ..sources.tables import DOCUMENT_ITEMS, document_items, table


@query("SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS position FROM orders ORDER BY position NULLS LAST, o_orderkey")
def order_nulls_last(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("position"))
    return o.orderBy(F.asc_nulls_last("position"), "o_orderkey")


@query(f"""WITH {DOCUMENT_ITEMS}, f AS (SELECT feed_id, row_number() OVER (ORDER BY feed_id DESC) AS ordinal FROM (SELECT DISTINCT feed_id FROM items WHERE feed_id <> 'src0'))
    SELECT item_id, row_number() OVER (PARTITION BY lang ORDER BY date_ms // 600000, coalesce(ordinal, 9223372036854775807), external_id, item_id) AS place FROM items LEFT JOIN f USING (feed_id)""")
def item_total_order(spark, sf_dir):
    from pyspark.sql import Window

    items = document_items(spark, sf_dir)
    feeds = items.where("feed_id <> 'src0'").select("feed_id").distinct()
    feeds = feeds.withColumn("ordinal", F.row_number().over(Window.orderBy(F.desc("feed_id"))).cast("long"))
    rows = items.join(feeds, "feed_id", "left").withColumn("ordinal", F.coalesce("ordinal", F.lit(2**63 - 1)))
    w = Window.partitionBy("lang").orderBy(F.floor(F.col("date_ms") / 600000), "ordinal", "external_id", "item_id")
    return rows.select("item_id", F.row_number().over(w).cast("long").alias("place"))


@query("""SELECT o_custkey AS user_id, o_orderkey AS story, cast(floor(o_totalprice) AS BIGINT) % 101 AS score FROM orders WHERE cast(floor(o_totalprice) AS BIGINT) % 101 >= 60
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY cast(floor(o_totalprice) AS BIGINT) % 101 DESC, o_orderkey) <= CASE WHEN o_custkey % 2 = 0 THEN 3 ELSE 12 END""")
def topk_stories(spark, sf_dir):
    score = F.floor("o_totalprice").cast("long") % 101
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("story"), score.alias("score")).where("score >= 60")
    most = F.coalesce(F.when(F.col("user_id") % 2 == 0, 3), F.lit(12))
    return paging.top_k(o, ["user_id"], [F.desc("score"), F.asc("story")], most).drop("rank")


@query("""SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1996-06-01' OR (o_orderdate = TIMESTAMP '1996-06-01' AND o_orderkey < 5000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 21""")
def keyset_page_desc(spark, sf_dir):
    """The limit is the feature: one page."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return paging.page(o, "o_orderdate", "o_orderkey", "desc", 20, (_ntz("1996-06-01"), 5000))


@query("""SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1996-06-01' OR (o_orderdate = TIMESTAMP '1996-06-01' AND o_orderkey > 5000) ORDER BY o_orderdate, o_orderkey LIMIT 101""")
def keyset_page_asc(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return paging.page(o, "o_orderdate", "o_orderkey", "asc", 100, (_ntz("1996-06-01"), 5000))


def _ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query("SELECT o_orderkey AS run_id FROM orders ORDER BY o_orderdate DESC, nullif(o_orderpriority, '5-LOW') DESC NULLS LAST, o_orderkey DESC LIMIT 1")
def latest_run(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("finished", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")))
    return o.orderBy(F.desc("o_orderdate"), F.desc_nulls_last("finished"), F.desc("o_orderkey")).limit(1).select(F.col("o_orderkey").alias("run_id"))


@query("SELECT c_custkey AS story_id, c_mktsegment AS key FROM customer WHERE c_acctbal >= 1000 ORDER BY cast(floor(c_acctbal) AS BIGINT) DESC, c_custkey LIMIT 200")
def recent_refs(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal >= 1000")
    return c.orderBy(F.floor("c_acctbal").cast("long").desc(), F.asc("c_custkey")).limit(200).select(F.col("c_custkey").alias("story_id"), F.col("c_mktsegment").alias("key"))


@query("""SELECT o_orderkey AS bucket FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1997-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 100)""")
def bounded_cleanup(spark, sf_dir):
    """What a cleanup leaves that deletes the 100 oldest expired buckets at most."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    gone = o.where(F.col("o_orderdate") <= _ntz("1997-01-01")).orderBy("o_orderdate", "o_orderkey").limit(100).select("o_orderkey")
    return o.join(gone, "o_orderkey", "left_anti").select(F.col("o_orderkey").alias("bucket"))


@query("SELECT c_mktsegment AS scope, arg_min(c_custkey, c_custkey) AS owner, arg_min(c_name, c_custkey) AS name FROM customer GROUP BY c_mktsegment")
def earliest_owner(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("scope")).agg(F.min("c_custkey").alias("owner"), F.min_by("c_name", "c_custkey").alias("name"))


@query("""SELECT 'personalized' AS part, doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT 'include_all', doc_id FROM documents JOIN labels USING (doc_id) WHERE lang IN ('en', 'de') AND quality = 1""")
def union_partitions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    a = docs.where("lang = 'en'").select(F.lit("personalized").alias("part"), "doc_id")
    good = docs.where("lang IN ('en', 'de')").join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id")
    return a.unionByName(good.select(F.lit("include_all").alias("part"), "doc_id"))


@query("SELECT source FROM documents WHERE lang = 'fr' INTERSECT SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1")
def subscribed_intersection(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    paid = docs.join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    return docs.where("lang = 'fr'").select("source").intersect(paid.select("source"))


@query("""WITH expected AS (SELECT l_orderkey AS i, l_linenumber AS m FROM lineitem WHERE l_returnflag <> 'R'), returned AS (SELECT l_orderkey AS i, l_linenumber AS m FROM lineitem WHERE l_linenumber < 6)
    SELECT i, m, 'missing' AS problem FROM (SELECT DISTINCT i, m FROM expected EXCEPT SELECT i, m FROM returned) UNION ALL SELECT i, m, 'unknown' FROM (SELECT i, m FROM returned EXCEPT SELECT i, m FROM expected)
    UNION ALL SELECT i, m, 'duplicate' FROM returned GROUP BY i, m HAVING count(*) > 1""")
def coverage_diff(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_linenumber").alias("m"), "l_returnflag")
    expected, returned = l.where("l_returnflag <> 'R'").select("i", "m"), l.where("m < 6").select("i", "m")
    counts = expected.groupBy("i", "m").agg(F.lit(1).alias("e")).join(returned.groupBy("i", "m").agg(F.count("*").alias("r")), ["i", "m"], "full")
    problems = F.array_compact(F.array(F.when(F.col("r").isNull(), "missing"), F.when(F.col("e").isNull(), "unknown"), F.when(F.col("r") > 1, "duplicate")))
    return counts.select("i", "m", F.explode(problems).alias("problem"))

"""The digest: items of a window, grouped into stories, classified, ranked and rendered, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, udfs, urls
from ..operators import filters, folds, graph, paging
from ..session import settled
from ..sources.tables import DOCUMENT_ITEMS, EVENT_ITEMS, document_items, event_items

DAY = 86_400_000
START = 1_704_067_200_000
#: A story counts from this score on; a digest has so many stories.
THRESHOLD, MOST = 50, 12

RANKED_ITEMS_SQL = f"""WITH {EVENT_ITEMS}, f(feed_id, source_id, feed_mode) AS (VALUES ('view', 1, 'inherit'), ('click', 1, 'personalized'), ('purchase', 2, 'inherit'), ('signup', 2, 'include_all'), ('error', 3, 'inherit')),
    s(source_id, source_mode, warmup, enabled) AS (VALUES (1, 'inherit', false, true), (2, 'inherit', true, true), (3, 'include_all', false, false)),
    j AS (SELECT i.item_id, i.feed_id, i.user_id, i.date_ms, cast(floor(i.value) AS BIGINT) AS score, coalesce(nullif(f.feed_mode, 'inherit'), nullif(s.source_mode, 'inherit'), CASE WHEN s.warmup THEN 'include_all' END, 'personalized') AS mode
      FROM items i JOIN f USING (feed_id) JOIN s USING (source_id) WHERE s.enabled AND i.date_ms BETWEEN {START} AND {START + 20 * DAY} AND NOT (i.item_id % 4 = 0 AND i.user_id % 2 = 0))
    SELECT feed_id, item_id, score, mode, row_number() OVER (PARTITION BY feed_id ORDER BY score DESC, date_ms DESC, item_id) AS rank FROM j WHERE mode = 'include_all' OR score >= 10
    QUALIFY row_number() OVER (PARTITION BY feed_id ORDER BY score DESC, date_ms DESC, item_id) <= {MOST}"""


def ranked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best items of each enabled feed in the window, less inaccessible ones, by each feed's effective mode."""
    feeds = spark.createDataFrame([("view", 1, "inherit"), ("click", 1, "personalized"), ("purchase", 2, "inherit"), ("signup", 2, "include_all"), ("error", 3, "inherit")], "feed_id string, source_id int, feed_mode string")
    sources = spark.createDataFrame([(1, "inherit", False, True), (2, "inherit", True, True), (3, "include_all", False, False)], "source_id int, source_mode string, warmup boolean, enabled boolean")
    items = filters.in_window(event_items(spark, sf_dir), START, START + 20 * DAY)
    audience = F.when(F.col("user_id") % 2 == 0, "only_paid")
    access = F.when(F.col("item_id") % 4 == 0, "preview").otherwise("full")
    items = items.withColumn("audience", audience).withColumn("access", access).where(~filters.inaccessible("audience", "access"))
    plan = feeds.join(sources.where("enabled"), "source_id").withColumn("user_mode", F.lit("personalized"))
    plan = plan.select("feed_id", filters.effective_mode("feed_mode", "source_mode", "warmup", "user_mode").alias("mode"))
    # the plan has a row a feed of one user: five here
    rows = items.join(F.broadcast(plan), "feed_id").withColumn("score", F.floor("value")).where("mode = 'include_all' OR score >= 10")
    top = paging.top_k(rows, ["feed_id"], [F.desc("score"), F.desc("date_ms"), F.asc("item_id")], MOST)
    return top.select("feed_id", "item_id", "score", "mode", F.col("rank").cast("long").alias("rank"))


_SLUG = "nullif(regexp_replace(regexp_replace(lower(trim(split_part(text, chr(10), 1))), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-|-$', '', 'g'), '')"
TOP_STORIES_SQL = f"""WITH RECURSIVE {DOCUMENT_ITEMS}, sel AS (SELECT * FROM items WHERE date_ms BETWEEN {START} AND {START + 30 * DAY} AND NOT (lang = 'fr' AND item_id % 2 = 0)),
    keys AS (SELECT item_id AS item, concat('sha:', sha256(text)) AS key FROM sel UNION ALL SELECT item_id, concat('key:', {_SLUG}) FROM sel WHERE {_SLUG} IS NOT NULL),
    e AS (SELECT DISTINCT a.item AS x, b.item AS y FROM keys a JOIN keys b USING (key)),
    r AS (SELECT item AS x, item AS y FROM (SELECT DISTINCT item FROM keys) UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x), c AS (SELECT x AS item_id, min(y) AS story FROM r GROUP BY x),
    m AS (SELECT story, s.*, contains(lower(text), 'idiot') OR contains(lower(text), 'moron') AS muted FROM c JOIN sel s USING (item_id)),
    st AS (SELECT story, count(*) AS members, count(DISTINCT feed_id) AS feeds, array_to_string(list_sort(list_distinct(list(lang))), ',') AS topics, min(date_ms) AS occurred_at, bool_or(muted) AS muted, arg_min(split_part(text, chr(10), 1), item_id) AS title FROM m GROUP BY story),
    sc AS (SELECT *, CASE WHEN muted THEN 0 ELSE least(100, 40 + 15 * (members - 1) + 5 * feeds) END AS score FROM st)
    SELECT story, title, topics, members, feeds, occurred_at, score, row_number() OVER (ORDER BY score DESC, story) AS rank FROM sc WHERE NOT muted AND score >= {THRESHOLD} QUALIFY row_number() OVER (ORDER BY score DESC, story) <= {MOST}"""


def analyzed(items: DataFrame) -> DataFrame:
    """The default analyser, deterministic: an item's story keys are its text's hash and the slug of its first line."""
    a = items.select(F.col("item_id").alias("item"), F.concat(F.lit("sha:"), F.sha2("text", 256)).alias("key"))
    b = items.select(F.col("item_id").alias("item"), F.concat(F.lit("key:"), text.slug(F.substring_index("text", "\n", 1))).alias("key"))
    return a.unionByName(b.where("key IS NOT NULL"))


def stories(items: DataFrame, analyse=analyzed) -> DataFrame:
    """Items with ``story``, the smallest item of their component."""
    found = graph.key_components(analyse(items)).select(F.col("item").alias("item_id"), F.col("component").alias("story"))
    return items.join(found, "item_id")


def top_stories(spark: SparkSession, sf_dir: str, muted: tuple[str, ...] = ("idiot", "moron")) -> DataFrame:
    """The stories of the period's documents: window, access, resolution, rules, score, threshold, top k."""
    items = filters.in_window(document_items(spark, sf_dir), START, START + 30 * DAY)
    items = items.withColumn("audience", F.when(F.col("lang") == "fr", "only_paid")).withColumn("access", F.when(F.col("item_id") % 2 == 0, "preview"))
    items = items.where(~filters.inaccessible("audience", "access"))
    mute = F.lit(False)
    for phrase in muted:
        mute |= F.lower("text").contains(phrase)
    m = stories(items).select("story", "item_id", "feed_id", "lang", "date_ms", mute.alias("muted"), F.substring_index("text", "\n", 1).alias("head"))
    s = m.groupBy("story").agg(
        F.count("*").alias("members"),
        F.countDistinct("feed_id").alias("feeds"),
        F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("topics"),
        F.min("date_ms").alias("occurred_at"),
        F.bool_or("muted").alias("muted"),
        F.min_by("head", "item_id").alias("title"),
    )
    score = F.when(F.col("muted"), F.lit(0).cast("long")).otherwise(F.least(F.lit(100).cast("long"), 40 + 15 * (F.col("members") - 1) + 5 * F.col("feeds")))
    relevant = s.withColumn("score", score).where(~F.col("muted") & (F.col("score") >= THRESHOLD))
    # the limit is the feature (a digest's most stories); the rank is over those rows alone
    best = relevant.orderBy(F.desc("score"), F.asc("story")).limit(MOST)
    top = paging.top_k(best.withColumn("digest", F.lit(1)), ["digest"], [F.desc("score"), F.asc("story")], MOST)
    return top.select("story", "title", "topics", "members", "feeds", "occurred_at", "score", F.col("rank").cast("long").alias("rank"))


#: Parts of a digest, in order.
HEAD, STORIES, GROUPS, PAID, FOOT = range(5)
NOTHING = "- Nothing to report."
#: Bytes of a page.
PAGE_BYTES = 1 << 20


def _lines(rows: DataFrame, part: int, a, b, lines) -> DataFrame:
    """(digest, at, line): each row's array of lines, in their place in the digest: part, then ``a`` and ``b``."""
    each = rows.select("digest", a.cast("long").alias("a"), b.cast("long").alias("b"), F.posexplode(lines).alias("c", "line"))
    return each.select("digest", F.struct(F.lit(part).alias("part"), "a", "b", F.col("c").cast("long").alias("c")).alias("at"), "line")


def _points(points) -> object:
    """Lines of points (text, author, viewer), or of none."""
    name = lambda p: F.concat(F.lit("**"), text.markdown(text.stripped(F.regexp_replace(p["author"], text.BIDI, ""))), F.lit(":**"), F.when(p["viewer"], " `SELF`").otherwise(""), F.lit(" "))
    said = lambda p: F.when(F.coalesce(text.stripped(F.regexp_replace(p["author"], text.BIDI, "")), F.lit("")) != "", name(p)).otherwise("")
    lines = F.transform(points, lambda p: F.concat(F.lit("- "), F.coalesce(said(p), F.lit("")), p["text"]))
    return F.when(F.size(points) > 0, lines).otherwise(F.array(F.lit(NOTHING)))


def _linked(title, url):
    """A title, linked where the address is one of the web."""
    return F.coalesce(F.concat(F.lit("["), title, F.lit("](<"), urls.safe(url), F.lit(">)")), title)


def story_lines(stories: DataFrame) -> DataFrame:
    """``stories``: digest, place, title, points (text, author, viewer) and sources (title, feed, url)."""
    source = lambda s: F.concat(F.lit("- "), _linked(text.markdown(F.coalesce(s["title"], s["feed"])), s["url"]), F.lit(" — "), text.markdown(s["feed"]))
    lines = F.concat(F.array(F.concat(F.lit("## "), text.markdown("title")), F.lit("")), _points(F.col("points")), F.array(F.lit(""), F.lit("### Sources")), F.transform("sources", source), F.array(F.lit("")))
    return _lines(stories, STORIES, F.col("place"), F.lit(0), lines)


def group_lines(sections: DataFrame) -> DataFrame:
    """``sections``: digest, group, group_place, place (1 the group's first), feed, removed, points, and articles (title, url, preview, published, points), null where the section is points alone."""
    article = lambda x: F.concat(F.array(F.lit(""), F.concat(F.lit("#### "), _linked(text.markdown(x["title"]), x["url"]))), F.when(x["preview"], F.array(F.lit("Preview"))).otherwise(F.array().cast("array<string>")), F.array(F.concat(F.lit("Published: "), x["published"])), _points(x["points"]))
    articles = F.when(F.size("articles") == 0, F.array(F.lit("No articles."))).otherwise(F.flatten(F.transform("articles", article)))
    head = F.when(F.col("place") == 1, F.array(F.concat(F.lit("## "), "group"), F.lit(""))).otherwise(F.array().cast("array<string>"))
    feed = F.array(F.concat(F.lit("### "), "feed", F.when(F.col("removed"), " (removed)").otherwise("")))
    lines = F.concat(head, feed, F.when(F.col("articles").isNull(), _points(F.col("points"))).otherwise(articles), F.array(F.lit("")))
    return _lines(sections, GROUPS, F.col("group_place"), F.col("place"), lines)


def paid_lines(posts: DataFrame) -> DataFrame:
    """``posts``: digest, place, newsletter, title, url. Newsletters stand in the order of their first post."""
    names = posts.groupBy("digest", "newsletter").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    rows = posts.join(names, ["digest", "newsletter"])
    before = F.when(F.col("place") == F.col("first"), F.array(F.concat(F.lit("### "), text.markdown("newsletter")))).otherwise(F.array().cast("array<string>"))
    after = F.when(F.col("place") == F.col("last"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(before, F.array(F.concat(F.lit("- "), _linked(text.markdown("title"), F.col("url")))), after)
    some = posts.select("digest").distinct()
    head = _lines(some, PAID, F.lit(-1), F.lit(0), F.array(F.lit("## Paid posts"), F.lit("")))
    foot = _lines(some, FOOT, F.lit(0), F.lit(0), F.array(F.lit(""), F.lit("These posts were not summarized because their full text is unavailable.")))
    return head.unionByName(_lines(rows, PAID, F.col("first"), F.col("place"), lines)).unionByName(foot)


def head_lines(digests: DataFrame) -> DataFrame:
    """``digests``: digest, title, status, reason (null where it didn't fail)."""
    reason = F.when(F.col("reason").isNotNull(), F.array(F.concat(F.lit("Failure reason: "), text.markdown("reason")))).otherwise(F.array().cast("array<string>"))
    return _lines(digests, HEAD, F.lit(0), F.lit(0), F.concat(F.array(F.concat(F.lit("# "), "title"), F.concat(F.lit("Status: "), "status")), reason, F.array(F.lit(""))))


def pages(lines: DataFrame, most: int = PAGE_BYTES) -> DataFrame:
    """(digest, page from 0, markdown): a digest's lines in order, in pages of at most ``most`` bytes, line feeds included; empty lines at its end go.

    A line longer than a page is cut between characters. Pages are filled by bytes from the first on, over ranges of the order, so a digest may have any number of stories and no row is larger than a page.
    """
    ends = lines.where("line <> ''").groupBy(F.col("digest").alias("__digest")).agg(F.max("at").alias("__last"))
    left = lines.join(ends, F.col("digest").eqNullSafe(F.col("__digest"))).where("at <= __last").select("digest", "at", "line")
    long = F.octet_length("line") > most - 1
    cut = left.where(long).select("digest", "at", F.posexplode(udfs.utf8_split("line", F.lit(most - 1))).alias("piece", "line"))
    rows = left.where(~long).withColumn("piece", F.lit(0)).select("digest", "at", "piece", "line").unionByName(cut)
    rows = settled(rows.select("digest", F.struct("at", "piece").alias("at"), "line"), "lines")
    fitted = folds.next_fit(rows.withColumn("size", F.octet_length("line") + 1), ["digest"], "at", "size", 2**31 - 1, most)
    placed = fitted.select(F.col("digest").alias("__digest"), F.col("pos").alias("__at"), F.col("batch").alias("page"))
    both = rows.join(placed, F.col("digest").eqNullSafe(F.col("__digest")) & (F.col("at") == F.col("__at")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])
    return both.groupBy("digest", "page").agg(F.concat(F.array_join(ordered, "\n"), F.lit("\n")).alias("markdown"))


__all__ = ["analyzed", "group_lines", "head_lines", "pages", "paid_lines", "ranked_items", "stories", "story_lines", "top_stories"]

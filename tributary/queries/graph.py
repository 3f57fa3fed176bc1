"""Story resolution and the flagship digest."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph
from ..plans import digest
from ..registry import query
from ..sources.tables import table
from .scalars import SLUG

KEYS = f"""keys AS (SELECT doc_id AS item, concat('sha:', sha256(text)) AS key FROM documents UNION ALL
    SELECT doc_id, concat('slug:', {SLUG.format(x='split_part(text, chr(10), 1)')}) FROM documents WHERE {SLUG.format(x='split_part(text, chr(10), 1)')} IS NOT NULL)"""


def document_keys(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    a = docs.select(F.col("doc_id").alias("item"), F.concat(F.lit("sha:"), F.sha2("text", 256)).alias("key"))
    b = docs.select(F.col("doc_id").alias("item"), F.concat(F.lit("slug:"), text.slug(F.substring_index("text", "\n", 1))).alias("key"))
    return a.unionByName(b.where("key IS NOT NULL"))


@query(f"""WITH RECURSIVE {KEYS}, e AS (SELECT DISTINCT a.item AS x, b.item AS y FROM keys a JOIN keys b USING (key)),
    r AS (SELECT item AS x, item AS y FROM (SELECT DISTINCT item FROM keys) UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x) SELECT x AS item, min(y) AS component FROM r GROUP BY x""")
def story_components(spark, sf_dir):
    return graph.key_components(document_keys(spark, sf_dir))


@query(digest.TOP_STORIES_SQL)
def digest_top_stories(spark, sf_dir):
    return digest.top_stories(spark, sf_dir)


@query(digest.RANKED_ITEMS_SQL)
def digest_ranked_items(spark, sf_dir):
    return digest.ranked_items(spark, sf_dir)


_MARKED = "regexp_replace({x}, '([\\\\`*_{{}}\\[\\]()#+\\-.!|>~])', '\\\\\\1', 'g')"
_TITLE = "substr(split_part(text, chr(10), 1), 1, 200)"


def _m(x: str) -> str:
    return _MARKED.format(x=x)


@query(f"""WITH RECURSIVE d AS (SELECT source AS digest, doc_id, lang, {_TITLE} AS title, concat('https://h.test/', doc_id) AS url, list_transform(list_slice(string_split(text, chr(10)), 2, 4), lambda l: substr(l, 1, 200)) AS points FROM documents),
    s AS (SELECT digest, 1 AS part, doc_id AS a, 0 AS b, list_concat([concat('## ', {_m('title')}), ''], CASE WHEN len(points) = 0 THEN ['- Nothing to report.'] ELSE list_transform(points, lambda p, i: concat('- ', CASE WHEN i = 1 THEN concat('**', {_m('lang')}, ':** ', CASE WHEN doc_id % 2 = 0 THEN '' ELSE '' END) ELSE '' END, p)) END,
      ['', '### Sources', CASE WHEN doc_id % 3 = 0 THEN concat('- ', {_m('lang')}, ' — ', {_m('lang')}) ELSE concat('- [', {_m('title')}, '](<', url, '>) — ', {_m('lang')}) END, '']) AS lines FROM d WHERE lang <> 'fr'),
    g AS (SELECT source AS digest, 2 AS part, row_number() OVER (PARTITION BY source ORDER BY lang) AS a, 1 AS b, list_concat([concat('## ', lang), ''], [concat('### ', lang, CASE WHEN lang = 'de' THEN ' (removed)' ELSE '' END)],
      CASE WHEN lang = 'en' THEN ['', concat('#### [', {_m("'About ' || lang")}, '](<https://h.test/en>)'), 'Preview', 'Published: today', concat('- ', n, ' documents')] WHEN lang = 'es' THEN ['No articles.'] ELSE [concat('- ', n, ' documents')] END, ['']) AS lines FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)),
    q AS (SELECT digest, doc_id, title, url, concat('N', doc_id % 3) AS letter FROM d WHERE lang = 'fr'), qf AS (SELECT *, min(doc_id) OVER w AS first, max(doc_id) OVER w AS last FROM q WINDOW w AS (PARTITION BY digest, letter)),
    paid AS (SELECT digest, 3 AS part, first AS a, doc_id AS b, list_concat(CASE WHEN doc_id = first THEN [concat('### ', letter)] ELSE [] END, [concat('- [', {_m('title')}, '](<', url, '>)')], CASE WHEN doc_id = last THEN [''] ELSE [] END) AS lines FROM qf
      UNION ALL SELECT DISTINCT digest, 3, -1, 0, ['## Paid posts', ''] FROM q UNION ALL SELECT DISTINCT digest, 4, 0, 0, ['', 'These posts were not summarized because their full text is unavailable.'] FROM q),
    h AS (SELECT DISTINCT source AS digest, 0 AS part, 0 AS a, 0 AS b, list_concat([concat('# Digest of ', source), 'Status: completed'], CASE WHEN length(source) % 2 = 0 THEN ['Failure reason: none\\.'] ELSE [] END, ['']) AS lines FROM documents),
    al AS (SELECT * FROM h UNION ALL SELECT * FROM s UNION ALL SELECT * FROM g UNION ALL SELECT * FROM paid), l AS (SELECT digest, part, a, b, unnest(lines) AS line, unnest(range(len(lines))) AS c FROM al),
    o AS (SELECT *, row_number() OVER w AS rn, count(*) FILTER (WHERE line <> '') OVER (PARTITION BY digest ORDER BY part, a, b, c ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS more FROM l WINDOW w AS (PARTITION BY digest ORDER BY part, a, b, c)),
    k AS (SELECT digest, rn, line, strlen(line) + 1 AS size FROM o WHERE more > 0),
    f AS (SELECT digest, rn, 0::BIGINT AS page, size AS total FROM k WHERE rn = 1 UNION ALL SELECT k.digest, k.rn, f.page + CASE WHEN f.total + k.size > 8000 THEN 1 ELSE 0 END, CASE WHEN f.total + k.size > 8000 THEN k.size ELSE f.total + k.size END FROM f JOIN k ON k.digest = f.digest AND k.rn = f.rn + 1)
    SELECT digest, page, concat(string_agg(line, chr(10) ORDER BY rn), chr(10)) AS markdown FROM f JOIN k USING (digest, rn) GROUP BY digest, page""")
def render_markdown(spark, sf_dir):
    """A digest for each source in pages of 8,000 bytes: every document a story or, in one language, a paid post; a section for each language."""
    d = table(spark, sf_dir, "documents")
    title, url, none = F.substring(F.substring_index("text", "\n", 1), 1, 200), F.concat(F.lit("https://h.test/"), F.col("doc_id").cast("string")), F.lit(None).cast("string")
    cut = F.transform(F.slice(F.split("text", "\n"), 2, 3), lambda line, i: F.struct(F.substring(line, 1, 200).alias("text"), F.when(i == 0, F.concat(F.lit("\u200e "), "lang")).alias("author"), F.lit(False).alias("viewer")))
    source = F.struct(F.when(F.col("doc_id") % 3 != 0, title).alias("title"), F.col("lang").alias("feed"), F.when(F.col("doc_id") % 3 != 0, url).otherwise("javascript:x").alias("url"))
    stories = d.where("lang <> 'fr'").select(F.col("source").alias("digest"), F.col("doc_id").alias("place"), title.alias("title"), cut.alias("points"), F.array(source).alias("sources"))
    said = F.array(F.struct(F.concat(F.col("n").cast("string"), F.lit(" documents")).alias("text"), none.alias("author"), F.lit(False).alias("viewer")))
    article = F.struct(F.concat(F.lit("About "), "lang").alias("title"), F.lit("https://h.test/en").alias("url"), F.lit(True).alias("preview"), F.lit("today").alias("published"), said.alias("points"))
    articles = F.when(F.col("lang") == "en", F.array(article)).when(F.col("lang") == "es", F.filter(F.array(article), lambda x: F.lit(False)))
    langs = d.groupBy(F.col("source").alias("digest"), "lang").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("digest").orderBy("lang"))
    groups = langs.select("digest", F.col("lang").alias("group"), place.alias("group_place"), F.lit(1).alias("place"), F.col("lang").alias("feed"), (F.col("lang") == "de").alias("removed"), said.alias("points"), articles.alias("articles"))
    paid = d.where("lang = 'fr'").select(F.col("source").alias("digest"), F.col("doc_id").alias("place"), F.concat(F.lit("N"), (F.col("doc_id") % 3).cast("string")).alias("newsletter"), title.alias("title"), url.alias("url"))
    heads = d.select(F.col("source").alias("digest")).distinct().select("digest", F.concat(F.lit("Digest of "), "digest").alias("title"), F.lit("completed").alias("status"), F.when(F.char_length("digest") % 2 == 0, "none.").alias("reason"))
    lines = digest.head_lines(heads).unionByName(digest.story_lines(stories)).unionByName(digest.group_lines(groups)).unionByName(digest.paid_lines(paid))
    return digest.pages(lines, 8000)

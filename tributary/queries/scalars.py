"""Scalar functions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html, text, udfs, urls
from ..operators import paging
from ..registry import query
from ..sources.tables import EVENT_ITEMS, event_items, table


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


SLUG = "nullif(regexp_replace(regexp_replace(lower(trim({x})), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-|-$', '', 'g'), '')"


@query(f"SELECT doc_id, {SLUG.format(x='text')} AS slug FROM documents")
def slug_key(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.slug(F.col("text")).alias("slug"))


#: White space of every kind, as SQL: what is left out at the ends of texts.
WHITE_SQL = "concat(" + ", ".join(f"chr({ord(c)})" for c in text.WHITE) + ")"


@query(f"""SELECT doc_id, lower(trim(regexp_replace(concat(chr(9), chr(160), text, chr(8195), chr(10)), concat('[', {WHITE_SQL}, ']+'), ' ', 'g'))) AS label FROM (SELECT doc_id, concat('fiAB 1/2', text) AS text FROM documents)""")
def interest_label(spark, sf_dir):
    """Every text between a tab, a no-break space, a wide space and a line feed, after a ligature, wide letters and a fraction."""
    framed = F.concat(F.lit("\t\u00a0\ufb01\uff21\uff22\u30001/2"), "text", F.lit("\u2003\n"))
    return docs(spark, sf_dir).select("doc_id", text.interest_label(framed).alias("label"))


@query(f"""WITH w AS (SELECT doc_id, list_filter(list_transform(string_split(text, ' '), lambda x: trim(concat(chr(160), x, chr(9)), {WHITE_SQL})), lambda x: length(x) BETWEEN 1 AND 6) AS words FROM documents),
    u AS (SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM w), k AS (SELECT *, lower(trim(regexp_replace(w, concat('[', {WHITE_SQL}, ']+'), ' ', 'g'))) AS key FROM u),
    f AS (SELECT doc_id, arg_min(w, i) AS w, min(i) AS i FROM k GROUP BY doc_id, key), g AS (SELECT doc_id, string_agg(w, '|' ORDER BY i) AS labels FROM f GROUP BY doc_id)
    SELECT doc_id, coalesce(labels, '') AS labels FROM documents LEFT JOIN g USING (doc_id)""")
def label_clean(spark, sf_dir):
    words = F.transform(F.split(F.col("text"), " "), lambda x: F.concat(F.lit("\u00a0"), x, F.lit("\t")))
    return docs(spark, sf_dir).select("doc_id", F.array_join(text.clean_labels(words, 6), "|").alias("labels"))


NORMAL = """CASE WHEN regexp_matches({u}, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#\\s]+)([^?#\\s]*)(\\?[^#\\s]*)?(?:#.*)?$') THEN
    concat(lower(regexp_extract({u}, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#\\s]+)', 1)),
      CASE WHEN regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#\\s]+([^?#\\s]*)', 1) = '' THEN '/'
           WHEN length(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#\\s]+([^?#\\s]*)', 1)) > 1 THEN regexp_replace(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#\\s]+([^?#\\s]*)', 1), '/+$', '') ELSE '/' END,
      regexp_extract({u}, '^[^?#]*(\\?[^#\\s]*)', 1)) END"""


@query(f"SELECT page_id, {NORMAL.format(u='trim(url)')} AS url FROM pages")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.normalized("url").alias("url"))


@query(f"""WITH p AS (SELECT page_id, {NORMAL.format(u='trim(url)')} AS a, {NORMAL.format(u="trim(concat(url, '/'))")} AS b FROM pages)
    SELECT page_id, array_to_string(CASE WHEN a = b THEN [a] ELSE [a, b] END, ' ') AS urls FROM p""")
def canonical_urls(spark, sf_dir):
    both = F.array_distinct(F.array(urls.normalized("url"), urls.normalized(F.concat("url", F.lit("/")))))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(both, " ").alias("urls"))


@query("SELECT page_id, CASE WHEN regexp_matches(trim(u), '^https?://') THEN replace(trim(u), '>', '%3E') END AS url FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat(url, '>x') WHEN 1 THEN concat('java', url) ELSE url END AS u FROM pages)")
def safe_url(spark, sf_dir):
    u = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit(">x"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("java"), "url")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", urls.safe(u).alias("url"))


@query("""WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(url, '://', '://u:p@') WHEN 1 THEN regexp_replace(url, '^(https?://[^/?#]+)', '\\1:8080') ELSE url END AS u FROM pages),
    h AS (SELECT page_id, u, lower(regexp_extract(u, '^https?://([^/?#\\s]+)', 1)) AS host FROM u)
    SELECT page_id, CASE WHEN length(u) <= 2048 AND NOT (regexp_matches(host, '[@:\\[]') OR regexp_matches(host, '^\\d+(\\.\\d+){3}$') OR regexp_matches(host, '^(localhost|.*\\.local|.*\\.localhost)$') OR host = '' OR NOT contains(host, '.')) THEN concat('https://', host) END AS origin FROM h""")
def publication_origin(spark, sf_dir):
    k = F.col("page_id") % 4
    u = F.when(k == 0, F.replace("url", F.lit("://"), F.lit("://u:p@"))).when(k == 1, F.regexp_replace("url", "^(https?://[^/?#]+)", "$1:8080")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", urls.publication_origin(u).alias("origin"))


@query("""SELECT host AS feed, min(page_id) AS page_id, count(*) AS pages FROM (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:\\s]+)', 1)) AS host FROM pages) GROUP BY host""")
def discover_publications(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(urls.host("url").alias("feed")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("pages"))


@query("""WITH d AS (SELECT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:\\s]+)', 1)) AS id, CASE WHEN page_id % 3 = 0 THEN concat('Feed ', page_id) END AS name, page_id FROM pages)
    SELECT id, coalesce(name, id) AS name, page_id % 2 = 0 AS fixed FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY name IS NULL, page_id) = 1""")
def discover_feeds_merge(spark, sf_dir):
    from ..operators import units

    d = table(spark, sf_dir, "pages").select(urls.host("url").alias("id"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Feed "), F.col("page_id").cast("string"))).alias("name"), "page_id")
    best = units.latest(d, ["id"], [F.col("name").isNull().asc(), F.asc("page_id")])
    return best.select("id", F.coalesce("name", "id").alias("name"), (F.col("page_id") % 2 == 0).alias("fixed"))


@query("""SELECT min(page_id) AS page_id, host FROM (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:\\s]+)', 1)) AS host FROM pages) GROUP BY host ORDER BY 1 LIMIT 250""")
def target_dedupe_cap(spark, sf_dir):
    """250 targets are the most that a batch takes: the cap is the feature."""
    t = table(spark, sf_dir, "pages").groupBy(urls.host("url").alias("host")).agg(F.min("page_id").alias("page_id"))
    return t.orderBy("page_id").limit(250)


@query("""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:\\s]+)', 1)), '[^a-z0-9]', '-', 'g') AS host FROM pages),
    u AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'https://x.com/home' WHEN 1 THEN 'https://x.com/i/lists/' || page_id WHEN 2 THEN 'https://x.com/i/chat/' || host || page_id WHEN 3 THEN 'https://x.com/i/chat/Settings'
      WHEN 4 THEN 'https://x.com/i/lists/0' || page_id WHEN 5 THEN 'https://x.com/i/chat/' || host || '/' WHEN 6 THEN 'http://x.com/i/lists/' || page_id ELSE 'https://x.com/' || host END AS u FROM h),
    t AS (SELECT page_id, u, regexp_matches(u, '^https://x\\.com/(home|i/lists/[1-9]\\d{0,31}|i/chat/[A-Za-z0-9][A-Za-z0-9_-]{0,127})$') AND NOT regexp_matches(lower(u), '/i/chat/(compose|new|requests|search|settings)$') AS ok FROM u),
    k AS (SELECT page_id, u, CASE WHEN ok THEN CASE WHEN contains(u, '/lists/') THEN 'list' WHEN contains(u, '/chat/') THEN 'chat' ELSE 'following' END END AS kind FROM t)
    SELECT page_id, kind, CASE WHEN kind <> 'following' THEN regexp_extract(u, '[^/]*$') END AS id, CASE WHEN kind = 'following' THEN 'x:following' ELSE 'x:' || kind || ':' || regexp_extract(u, '[^/]*$') END AS feed,
      CASE WHEN kind IS NOT NULL THEN u END AS url FROM k""")
def target_parse(spark, sf_dir):
    """Addresses of every form, valid and not, to target, feed id, and by way of the feed id to the address again."""
    n, host = F.col("page_id").cast("string"), F.regexp_replace(urls.host("url"), "[^a-z0-9]", "-")
    at = lambda *parts: F.concat(F.lit("https://x.com/"), *[F.lit(p) if isinstance(p, str) else p for p in parts])
    forms = F.array(at("home"), at("i/lists/", n), at("i/chat/", host, n), at("i/chat/Settings"), at("i/lists/0", n), at("i/chat/", host, "/"), F.concat(F.lit("http://x.com/i/lists/"), n), at(host))
    t = table(spark, sf_dir, "pages").select("page_id", urls.target(F.get(forms, (F.col("page_id") % 8).cast("int"))).alias("t"))
    t = t.withColumn("feed", urls.target_feed(F.col("t")))
    return t.select("page_id", "t.kind", "t.id", "feed", urls.target_url(urls.feed_target("feed")).alias("url"))


@query("""SELECT page_id, len(regexp_extract_all(html, 'href="[^"]*"')) AS links, coalesce(nullif(regexp_extract(html, 'href="([^"]*)"', 1), ''), '') AS first_link FROM pages""")
def extract_links_html(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).cast("long").alias("links"), F.coalesce(F.get(links, 0), F.lit("")).alias("first_link"))


@query("""WITH c AS (SELECT conv_id, turn, role, text, 1704067200000 + (conv_id * 100 + turn) * 60000 AS stamp, conv_id * 100 + turn + 1 AS n FROM conversations),
    p AS (SELECT conv_id, turn, false AS quote, n, CASE WHEN turn % 4 = 3 THEN concat('https://x.com/i/web/status/', n) ELSE concat('https://x.com/', role, '/status/', n) END AS url, text, CASE WHEN turn % 3 = 2 THEN concat('Name of ', role) ELSE concat('@', role) END AS author, stamp, n AS m FROM c
      UNION ALL SELECT conv_id, turn, true, n + 50, concat('https://x.com/quoted/status/', n + 50), 'Quoted words', '@quoted', NULL, NULL FROM c WHERE turn % 2 = 1)
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, quote) - 1 AS place, n::VARCHAR AS id, stamp AS date_ms, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, author, url,
      m * 100 AS replies, CASE WHEN m % 2 = 0 THEN m * 1100000 END AS reposts, m AS likes, CASE WHEN m IS NOT NULL THEN 1234000 + m % 1000 END AS views FROM p""")
def extract_posts(spark, sf_dir):
    """Conversations as pages of posts, every second with another post quoted in it; broken at the end, as pages are."""
    n, turn = F.col("conv_id") * 100 + F.col("turn") + 1, F.col("turn")
    s = lambda c: c.cast("string")
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("<br>"))
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + (F.col("conv_id") * 100 + turn) * 60), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    link = F.when(turn % 4 == 3, F.concat(F.lit("https://x.com/i/web/status/"), s(n))).otherwise(F.concat(F.lit("/"), "role", F.lit("/status/"), s(n), F.lit("/photo/1?x=1")))
    name = F.when(turn % 3 == 2, F.concat(F.lit("<span>Name of "), "role", F.lit("</span>"))).otherwise(F.concat(F.lit('<span>A name</span><a href="/'), "role", F.lit('"><i>x</i></a>')))
    quoted = F.concat(F.lit('<article data-testid="tweet"><div data-testid="User-Name"><a href="/quoted">q</a></div><a href="/quoted/status/'), s(n + 50), F.lit('"></a><p data-testid="tweetText">Quoted\n <b>words</b></p></article>'))
    reposts = F.when(n % 2 == 0, F.concat(F.lit('<button data-testid="unretweet">'), s(F.floor(n * 11 / 10)), F.lit(","), s(n * 11 % 10), F.lit(" m</button>"))).otherwise('<button data-testid="retweet">none</button>')
    views = F.concat(F.lit('<a href="/x/analytics" aria-label="1,234.'), F.lpad(s(n % 1000), 3, "0"), F.lit(' Views"></a>'))
    post = F.concat(
        F.lit('<div><article data-testid="tweet"><div data-testid="User-Name">'), name, F.lit('</div><a href="https://evil.test/a/status/9">no</a><a href="'), link, F.lit('"><time datetime="'), at, F.lit('">then</time></a><div data-testid="tweetText">'), escaped,
        F.lit('</div><script>var a = "<article data-testid=\\"tweet\\">";</script><img src=x>'), F.when(turn % 2 == 1, quoted).otherwise(""),
        F.lit('<button data-testid="reply" aria-label="'), s(n / 10), F.lit('K replies"></button>'), reposts, F.lit('<button data-testid="like">'), s(n), F.lit("</button>"), views, F.lit("</article>"),
    )
    c = table(spark, sf_dir, "conversations")
    pages = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", post.alias("post")))), lambda x: x["post"]), "<hr>").alias("html"))
    return pages.select("conv_id", F.posexplode(html.posts(F.concat(F.lit("<!DOCTYPE html><main><p>Posts"), "html", F.lit("<div><a href=")))).alias("place", "post")).select("conv_id", F.col("place").cast("long").alias("place"), "post.*")


@query("""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs') AS h FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(h, '<(p|div|br|li|tr|h[1-6])(\\s[^>]*)?/?>', chr(10), 'g'), '<[^>]*(>|$)', '', 'g') AS h FROM a),
    c AS (SELECT page_id, replace(replace(replace(regexp_replace(h, '&amp;?', chr(1), 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"') AS h FROM b)
    SELECT page_id, array_to_string(list_filter(list_transform(string_split(replace(h, chr(1), '&'), chr(10)), lambda l: trim(regexp_replace(l, '\\s+', ' ', 'g'))), lambda l: l <> ''), chr(10)) AS text FROM c""")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", udfs.html_text("html").alias("text"))


@query(None)
def nfkc_key(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.slug(udfs.nfkc(F.col("text"))).alias("slug"))


@query("""WITH c AS (SELECT doc_id, text, range(1, 102) AS k FROM documents) SELECT doc_id, list_reduce(list_filter(list_transform(k, lambda n: substr(text, 1, n)), lambda s: strlen(s) <= 100), lambda a, b: CASE WHEN length(a) >= length(b) THEN a ELSE b END) AS head,
    list_reduce(list_filter(list_transform(k, lambda n: right(text, n)), lambda s: strlen(s) <= 100), lambda a, b: CASE WHEN length(a) >= length(b) THEN a ELSE b END) AS tail FROM c""")
def utf8_truncate(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.utf8_head("text", 100).alias("head"), text.utf8_tail("text", 100).alias("tail"))


@query(None)
def utf8_split(spark, sf_dir):
    """Pieces of 1000 bytes; the test puts them together again."""
    pieces = udfs.utf8_split("text", F.lit(1000))
    return docs(spark, sf_dir).select("doc_id", F.posexplode(pieces).alias("piece", "text"))


@query("""WITH j AS (SELECT doc_id, concat('{"lang":', coalesce(to_json(lang)::VARCHAR, 'null'), ',"n":', n_chars, ',"payload":{"meta":{"isGroup":', doc_id % 2 = 0, ',"links":[{"a":null,"b":"x"},{"a":', doc_id, ',"b":"y"}]},"text":', to_json(regexp_replace(text, '[\\x00-\\x1f]', ' ', 'g'))::VARCHAR, '},"source":', coalesce(to_json(source)::VARCHAR, 'null'), '}') AS j FROM documents)
    SELECT doc_id, j AS canonical, sha256(j) AS fingerprint, sha256(text) AS text_hash FROM j JOIN documents USING (doc_id)""")
def fingerprint(spark, sf_dir):
    """A nested payload whose fields are built out of order."""
    link = lambda b, a: F.struct(F.lit(b).alias("b"), a.cast("long").alias("a"))
    meta = F.struct(F.array(link("x", F.lit(None)), link("y", F.col("doc_id"))).alias("links"), (F.col("doc_id") % 2 == 0).alias("isGroup"))
    d = docs(spark, sf_dir)
    parts = ("source", F.struct(F.regexp_replace("text", r"[\x00-\x1f]", " ").alias("text"), meta.alias("meta")).alias("payload"), F.col("n_chars").alias("n"), "lang")
    return d.select("doc_id", text.canonical_json(d, *parts).alias("canonical"), text.fingerprint(d, *parts).alias("fingerprint"), F.sha2("text", 256).alias("text_hash"))


@query(f"""WITH {EVENT_ITEMS}, e AS (SELECT item_id, user_id, feed_id, CASE WHEN item_id % 3 > 0 THEN date_ms END AS date_ms, row_number() OVER (PARTITION BY user_id, feed_id ORDER BY item_id) - 1 AS n FROM items)
    SELECT item_id, concat('fallback:', sha256(concat('["', CASE WHEN feed_id = 'click' THEN 'post' ELSE 'chat_message' END, '",', coalesce(date_ms::VARCHAR, 'null'), ',"', user_id, '","', feed_id, '",', CASE WHEN user_id % 2 = 0 THEN '"home"' ELSE 'null' END,
      CASE WHEN feed_id <> 'click' THEN concat(',', n) ELSE '' END, CASE WHEN item_id % 5 = 0 THEN ',"viewer"' ELSE '' END, ']'))) AS identity FROM e""")
def fallback_identity(spark, sf_dir):
    """All seven parts; an occurrence only for chat messages."""
    from ..operators import units

    post = F.col("feed_id") == "click"
    e = event_items(spark, sf_dir).withColumn("n", units.occurrence(["user_id", "feed_id"], [F.asc("item_id")]))
    parts = (F.when(post, "post").otherwise("chat_message"), F.when(F.col("item_id") % 3 > 0, F.col("date_ms")), F.col("user_id").cast("string"), "feed_id", F.when(F.col("user_id") % 2 == 0, "home"))
    return e.select("item_id", text.fallback_identity(*parts, occurrence=F.when(~post, F.col("n")), viewer=F.col("item_id") % 5 == 0).alias("identity"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(concat(chr(10), ' ', text, '  ', chr(13), chr(10), chr(10)), '\\r\\n?', chr(10), 'g'), '[ \\t]+(\\n|$)', '\\1', 'g'), '^\\n+', ''), '\\n+$', '') AS text FROM documents""")
def boilerplate_clean(spark, sf_dir):
    raw = F.concat(F.lit("\n "), F.col("text"), F.lit("  \r\n\n"))
    return docs(spark, sf_dir).select("doc_id", text.boilerplate(raw).alias("text"))


@query("""WITH c AS (SELECT o_orderkey, o_totalprice AS p, floor(o_totalprice)::BIGINT AS whole, o_orderkey % 8 AS k FROM orders),
    t AS (SELECT o_orderkey, CASE k WHEN 0 THEN concat(whole // 10, '.', whole % 10, 'K') WHEN 1 THEN concat(whole // 10, ',', whole % 10, 'm') WHEN 2 THEN concat(' ', whole, 'B') WHEN 3 THEN concat(whole // 1000, ',', lpad((whole % 1000)::VARCHAR, 3, '0')) WHEN 4 THEN concat(whole, '.000.001') WHEN 5 THEN whole::VARCHAR WHEN 6 THEN concat(whole, 'x') ELSE '' END AS raw,
      CASE k WHEN 0 THEN whole * 100 WHEN 1 THEN whole * 100000 WHEN 2 THEN whole * 1000000000 WHEN 3 THEN whole WHEN 4 THEN whole * 1000000 + 1 WHEN 5 THEN whole END AS n FROM c)
    SELECT o_orderkey, raw, n FROM t""")
def compact_count(spark, sf_dir):
    """Every order's price, written in one of eight ways."""
    whole, k = F.floor("o_totalprice").cast("long"), F.col("o_orderkey") % 8
    s = lambda c: c.cast("string")
    tenths = lambda mark, unit: F.concat(s(F.floor(whole / 10)), F.lit(mark), s(whole % 10), F.lit(unit))
    raw = (
        F.when(k == 0, tenths(".", "K")).when(k == 1, tenths(",", "m")).when(k == 2, F.concat(F.lit(" "), s(whole), F.lit("B")))
        .when(k == 3, F.concat(s(F.floor(whole / 1000)), F.lit(","), F.lpad(s(whole % 1000), 3, "0"))).when(k == 4, F.concat(s(whole), F.lit(".000.001"))).when(k == 5, s(whole))
        .when(k == 6, F.concat(s(whole), F.lit("x"))).otherwise("")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).withColumn("n", text.compact_count("raw"))


#: Before each document's text: one secret of every kind, told apart by the document's id.
PLANTED = ("https://u:pw@h.test/x", "ftp://onlytoken@h.test", "Bearer abc.def-{id}", "sk-abc{id}", "sk_live_abc{id}", "xai-{id}", "AIza{id}", "gsk_{id}", "api_key: \"a b\"", "auth_token={id}", "ct0=deadbeef;", "pin: 1234", "Cookie=session={id}\n")


@query(f"""WITH v AS (SELECT doc_id, replace('{" ".join(PLANTED)}', '{{id}}', doc_id::VARCHAR) || text || chr(10) || 'params: secret' AS raw FROM documents),
    a AS (SELECT doc_id, string_split(raw, chr(10) || 'params:')[1] AS m FROM v),
    b AS (SELECT doc_id, regexp_replace(m, '(?i)\\bBearer\\s+[A-Za-z0-9._~+/=-]+', 'Bearer [REDACTED]', 'g') AS m FROM a),
    c AS (SELECT doc_id, regexp_replace(regexp_replace(m, '\\b(?:sk[-_]|xai-)[A-Za-z0-9_-]+\\b', '[REDACTED]', 'g'), '\\b(?:AIza|gsk_)[A-Za-z0-9_-]+\\b', '[REDACTED]', 'g') AS m FROM b),
    d AS (SELECT doc_id, regexp_replace(m, '(?i)(\\bcookie\\b["'']?\\s*[:=]\\s*)(?:"[^"]*"|''[^'']*''|[^\\r\\n]+)', '\\1[REDACTED]', 'g') AS m FROM c),
    e AS (SELECT doc_id, regexp_replace(m, '(?i)(\\b(?:api[_-]?key|auth[_-]?token|ct0|pin)\\b["'']?\\s*[:=]\\s*)(?:"[^"]*"|''[^'']*''|[^;\\s,}}\\]]+)', '\\1[REDACTED]', 'g') AS m FROM d),
    f AS (SELECT doc_id, regexp_replace(m, '(?i)([a-z][a-z0-9+.-]*://)[^/\\s@]+@', '\\1[REDACTED]@', 'g') AS m FROM e)
    SELECT doc_id, CASE WHEN length(m) > 500 THEN left(m, 497) || '...' ELSE m END AS clean FROM f""")
def redact_secrets(spark, sf_dir):
    """Every document as an error message, with planted secrets before it."""
    raw = F.concat(F.replace(F.lit(" ".join(PLANTED)), F.lit("{id}"), F.col("doc_id").cast("string")), "text", F.lit("\nparams: secret"))
    return docs(spark, sf_dir).select("doc_id", text.redact(raw).alias("clean"))


@query("SELECT doc_id, regexp_replace(text, '([\\\\`*_{}\\[\\]()#+\\-.!|>~])', '\\\\\\1', 'g') AS text FROM documents")
def markdown_escape(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.markdown(F.col("text")).alias("text"))


@query("""SELECT o_orderkey, translate(rtrim(base64(encode(concat('{"s":"requested_desc","v":', cast(floor(o_totalprice) AS BIGINT), ',"id":', o_orderkey, '}'))), '='), '+/', '-_') AS cursor FROM orders""")
def cursor_encode(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", paging.cursor_column("requested_desc", F.floor("o_totalprice"), F.col("o_orderkey")).alias("cursor"))


@query("""WITH c AS (SELECT doc_id, text, list_reduce(list_filter(list_transform(range(1, 201), lambda n: substr(text, 1, n)), lambda s: strlen(s) <= 200), lambda a, b: CASE WHEN length(a) >= length(b) THEN a ELSE b END) AS head,
      list_reduce(list_filter(list_transform(range(1, 201), lambda n: right(text, n)), lambda s: strlen(s) <= 200), lambda a, b: CASE WHEN length(a) >= length(b) THEN a ELSE b END) AS tail FROM documents)
    SELECT doc_id, CASE WHEN strlen(text) <= 3000 THEN text WHEN doc_id % 2 = 0 THEN concat_ws(chr(10), 't', concat(substr(text, 11, 30), chr(10), substr(text, 101, 30), chr(10), substr(text, 201, 30)), head, tail) ELSE concat(head, chr(10), '[...]', chr(10), tail) END AS text FROM c""")
def compact_text(spark, sf_dir):
    """Long texts of even documents have four pieces of evidence, of which three are taken; the others have none."""
    cut = lambda a: F.substring("text", a, 30)
    found = F.when(F.col("doc_id") % 2 == 0, F.array(cut(11), cut(101), cut(201), cut(301)))
    return docs(spark, sf_dir).select("doc_id", text.compact(F.lit("t"), "text", found, 3000, 200).alias("text"))


@query(f"""WITH c AS (SELECT doc_id, text, [concat(chr(10), substr(text, 5, 20), chr(160)), 'not in there', concat(' ', chr(9)), substr(text, 5, 20), substr(text, 40, 500), substr(text, 90, 12), substr(text, 120, 9), substr(text, 150, 9)] AS c FROM documents),
    f AS (SELECT doc_id, list_filter(list_transform(c, lambda x: trim(x, {WHITE_SQL})), lambda x: x <> '' AND strlen(x) <= 400 AND contains(text, x)) AS f FROM c)
    SELECT doc_id, array_to_string(list_slice(list_filter(f, lambda x, i: list_position(f, x) = i), 1, 3), '|') AS evidence FROM f""")
def evidence_filter(spark, sf_dir):
    cut = lambda a, n: F.substring("text", a, n)
    candidates = F.array(F.concat(F.lit("\n"), cut(5, 20), F.lit("\u00a0")), F.lit("not in there"), F.lit(" \t"), cut(5, 20), cut(40, 500), cut(90, 12), cut(120, 9), cut(150, 9))
    return docs(spark, sf_dir).select("doc_id", F.array_join(text.evidence(candidates, "text"), "|").alias("evidence"))


@query(f"""WITH t AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 2 = 0 THEN concat(chr(10), chr(9), ' ') WHEN doc_id % 5 = 0 THEN concat(chr(10), source, ' ') END AS whole FROM documents)
    SELECT doc_id, coalesce(CASE WHEN trim(whole, {WHITE_SQL}) <> '' THEN whole END, CASE WHEN doc_id % 3 = 0 THEN lang END, source) AS text FROM t""")
def text_fallback(spark, sf_dir):
    k = F.col("doc_id")
    full = F.when(k % 2 == 0, "\n\t ").when(k % 5 == 0, F.concat(F.lit("\n"), "source", F.lit(" ")))
    short = F.when(k % 3 == 0, F.col("lang"))
    return docs(spark, sf_dir).select("doc_id", text.first_text(full, short, "source").alias("text"))


@query("""SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN concat('@user', user_id) END, nullif(concat_ws(' ', CASE WHEN event_id % 3 = 0 THEN 'Ann' END, CASE WHEN event_id % 5 = 0 THEN 'Lee' END), ''), event_type) AS author FROM events""")
def author_resolve(spark, sf_dir):
    k = F.col("event_id")
    name = F.nullif(F.concat_ws(" ", F.when(k % 3 == 0, "Ann"), F.when(k % 5 == 0, "Lee")), F.lit(""))
    author = F.coalesce(F.when(k % 2 == 0, F.concat(F.lit("@user"), F.col("user_id").cast("string"))), name, F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", author.alias("author"))


@query("""SELECT doc_id, substr(trim(regexp_replace(regexp_replace(text, '[\\x00-\\x1F\\x7F]', ' ', 'g'), '\\s+', ' ', 'g')), 1, 160) AS name FROM documents""")
def clean_name(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.feed_name(F.col("text")).alias("name"))


@query("SELECT doc_id, regexp_replace(text, '[^a-zA-Z0-9_-]', '_', 'g') AS key FROM documents")
def safe_key(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.safe_key(F.col("text")).alias("key"))


@query("""SELECT event_id, CASE WHEN s >= 3600 THEN concat(s // 3600, 'h ', s % 3600 // 60, 'm ', s % 60, 's') WHEN s % 3600 // 60 > 0 THEN concat(s % 3600 // 60, 'm ', s % 60, 's') ELSE concat(s % 60, 's') END AS duration
    FROM (SELECT event_id, event_id * 7 % 9000 AS s FROM events)""")
def format_duration(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.duration(F.col("event_id") * 7 % 9000).alias("duration"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(least(CASE WHEN l_linenumber = 3 THEN l_partkey END, 30) * 1000, 500 * (1::BIGINT << l_linenumber::BIGINT)) AS wait_ms FROM lineitem""")
def retry_schedule(spark, sf_dir):
    after = F.when(F.col("l_linenumber") == 3, F.col("l_partkey"))
    wait = text.backoff_ms(F.col("l_linenumber"), 500, after)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", wait.alias("wait_ms"))


@query("SELECT event_id, strftime(ts, '%d/%m/%Y, %H:%M') AS moment FROM events")
def format_moment(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "dd/MM/yyyy, HH:mm").alias("moment"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN cast(ts AS DATE) WHEN 1 THEN cast(ts AS DATE) - 1 WHEN 2 THEN cast(ts AS DATE) - (CASE WHEN (dayofweek(ts) + 7 - 2) % 7 = 0 THEN 7 ELSE (dayofweek(ts) + 7 - 2) % 7 END)::INTEGER
      ELSE CASE WHEN make_date(year(ts)::INTEGER, 1, 20) > cast(ts AS DATE) THEN make_date(year(ts)::INTEGER - 1, 1, 20) ELSE make_date(year(ts)::INTEGER, 1, 20) END END AS day FROM events""")
def relative_day(spark, sf_dir):
    """today, yesterday, a weekday (the last one before today) or 'Jan 20' as dates, seen from each event's own day."""
    from ..functions import dates

    k = F.col("event_id") % 4
    label = F.when(k == 0, "Today").when(k == 1, "Yesterday").when(k == 2, "Tuesday").otherwise("Jan 20")
    return table(spark, sf_dir, "events").select("event_id", dates.relative_day(label, F.col("ts").cast("date")).alias("day"))


@query("""SELECT user_id, CASE WHEN user_id % 3 = 0 THEN concat('10.0.0.', user_id % 250) ELSE 'direct' END AS client, count(*) AS n FROM events GROUP BY ALL""")
def client_address(spark, sf_dir):
    from ..functions import dates

    hops = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("9.9.9.9, 10.0.0."), (F.col("user_id") % 250).cast("string"), F.lit(", 127.0.0.1")))
    return table(spark, sf_dir, "events").groupBy("user_id", dates.client_address(hops, F.lit("direct"), 1).alias("client")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 < 6 THEN doc_id END AS id, CASE WHEN doc_id % 7 < 6 THEN source END AS source, CASE WHEN doc_id % 7 < 6 THEN CASE WHEN doc_id % 7 = 4 THEN 1 ELSE 2 END END AS parts FROM documents""")
def json_cleanup(spark, sf_dir):
    """Answers in seven forms: fenced, with a comma too many, in single quotes, without quotes, cut off, with a comment, and none."""
    n, src = F.col("doc_id").cast("string"), F.col("source")
    c = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    forms = F.array(
        c("<THINK>\nhm {\n</THINK>\n```json\n{\"id\":", n, ",\"source\":\"", src, "\",\"parts\":[\"a\",\"b\"]}\n```\nThere."), c("{\"id\":", n, ",\"source\":\"", src, "\",\"parts\":[\"a\",\"b\",],}"), c("{'id':", n, ",'source':'", src, "','parts':['a','b\"']}"),
        c("{id:", n, ",source:", src, ",parts:[a,b]}"), c("{\"id\":", n, ",\"source\":\"", src, "\",\"parts\":[\"a"), c("{\"id\":", n, ", // the id\n\"source\":\"", src, "\",/* two */\"parts\":[True,None]}"), c("no: {json", n),
    )
    clean = text.cleaned_json(F.get(forms, (F.col("doc_id") % 7).cast("int")))
    at = lambda path: F.get_json_object("json", path)
    rows = docs(spark, sf_dir).select("doc_id", clean.alias("json"))
    return rows.select("doc_id", at("$.id").cast("long").alias("id"), at("$.source").alias("source"), F.json_array_length(at("$.parts")).alias("parts"))


@query("""WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:\\s]+)', 1)), '[^a-z0-9]', '-', 'g') AS host FROM pages),
    l AS (SELECT page_id AS place, CASE page_id % 6 WHEN 0 THEN 'x:following' WHEN 1 THEN concat('x:list:', 1 + page_id % 50) WHEN 2 THEN concat('x:chat:', host) WHEN 3 THEN concat('x:list:', 1 + page_id % 50) END AS feed, CASE page_id % 6 WHEN 0 THEN 'Following' WHEN 2 THEN concat('Chat ', host) ELSE concat('List ', 1 + page_id % 50) END AS own,
      CASE WHEN page_id % 5 = 0 THEN concat('Name ', page_id) END AS name FROM p WHERE page_id % 6 < 4),
    f AS (SELECT feed, CASE WHEN feed LIKE 'x:chat:%' THEN 'discussion' ELSE 'news' END AS kind, coalesce(arg_min(name, place) FILTER (WHERE name IS NOT NULL), any_value(own)) AS name, min(place) AS first FROM l GROUP BY feed)
    SELECT *, row_number() OVER (ORDER BY feed = 'x:following' DESC, kind DESC, name, feed) AS menu FROM f""")
def discover_links(spark, sf_dir):
    """Links of six forms: the home page, lists, chats, lists by full address with a query, another origin, and one with a control character."""
    from ..operators import discovery, positions

    n, host = F.col("page_id"), F.regexp_replace(urls.host("url"), "[^a-z0-9]", "-")
    number = (1 + n % 50).cast("string")
    c = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    forms = F.array(c("/home#top"), c("/i/lists/", number), c("https://X.com:443/i/chat/", host, "?a=/"), c("https://x.com/i/lists/", number, "?x#y"), c("https://x.com.test/i/lists/", number), c("/i/lists/", number, "\t"))
    name = F.when(n % 5 == 0, c(" \t Name\n", n.cast("string"), " ")).when(n % 5 == 1, " ")
    links = table(spark, sf_dir, "pages").select(n.alias("place"), F.get(forms, (n % 6).cast("int")).alias("href"), name.alias("name"))
    return positions.numbered(discovery.discovered(links), discovery.menu_order(), "menu")


@query(f"WITH {EVENT_ITEMS} SELECT item_id, concat(feed_id, ':', author) AS k FROM items WHERE length(author) > 1")
def feed_key(spark, sf_dir):
    return event_items(spark, sf_dir).where(F.char_length("author") > 1).select("item_id", F.concat_ws(":", "feed_id", "author").alias("k"))

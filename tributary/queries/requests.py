"""Model requests' deterministic shell, and plain table scans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import requests
from ..registry import query
from ..sources.tables import NAMES, table
from .folds import _pack_sql


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(1, least(l_partkey, 100, l_suppkey * 1000 // 300)) AS most FROM lineitem""")
def request_limits(spark, sf_dir):
    most = requests.member_limit(F.col("l_partkey"), F.col("l_suppkey") * 1000)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", most.alias("most"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS i, l_linenumber AS m FROM lineitem WHERE l_returnflag <> 'R'), r AS (SELECT l_orderkey AS i, l_linenumber AS m, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 10 GROUP BY ALL),
    b AS (SELECT coalesce(e.i, r.i) AS i, coalesce(e.m, r.m) AS m, e.i IS NOT NULL AS asked, n FROM e FULL JOIN r ON e.i = r.i AND e.m = r.m), x AS (SELECT i, bool_or(NOT asked OR coalesce(n, 0) > 1) AS bad FROM b GROUP BY i)
    SELECT i, m, CASE WHEN bad THEN 'single' ELSE 'missing' END AS action FROM b JOIN x USING (i) WHERE asked AND (bad OR n IS NULL)""")
def retry_plan(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_linenumber").alias("m"), "l_returnflag", "l_linestatus", "l_quantity")
    return requests.retry_plan(l.where("l_returnflag <> 'R'"), l.where("l_linestatus = 'F' AND l_quantity > 10"), "i", "m")


@query("""WITH RECURSIVE s AS (SELECT source AS request, count(*) AS size, 1 + length(source) AS cap FROM documents GROUP BY source), f AS (SELECT request, cap, 0::BIGINT AS first, size AS n FROM s
      UNION ALL SELECT request, cap, CASE h WHEN 0 THEN first ELSE first + (n + 1) // 2 END, CASE h WHEN 0 THEN (n + 1) // 2 ELSE n // 2 END FROM f, (VALUES (0), (1)) t(h) WHERE n > cap)
    SELECT request, first, n FROM f WHERE n <= cap""")
def bisect_requests(spark, sf_dir):
    s = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("request")).agg(F.count("*").alias("size"))
    return requests.bisected(s, "size", F.char_length("request") + 1).select("request", "first", "n")


@query("""WITH RECURSIVE o AS (SELECT conv_id AS key, turn AS pos, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
    f AS (SELECT key, pos, rn, least(size, 600 // n) AS share, 600 - least(size, 600 // n) AS rest FROM o WHERE rn = 1
      UNION ALL SELECT o.key, o.pos, o.rn, least(o.size, f.rest // (o.n - o.rn + 1)), f.rest - least(o.size, f.rest // (o.n - o.rn + 1)) FROM f JOIN o ON o.key = f.key AND o.rn = f.rn + 1)
    SELECT key, pos, share FROM f""")
def fair_shares(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("pos"), F.char_length("text").alias("size"))
    return requests.fair_shares(c, ["key"], "pos", "size", 600)


STORIES = """st AS (SELECT source AS key, doc_id AS pos, CASE doc_id % 5 WHEN 0 THEN 'thorough' WHEN 1 THEN 'brief' ELSE 'normal' END AS detail, doc_id % 11 = 0 AS has_media, n_chars AS raw_bytes, n_chars + 40 AS input_bytes FROM documents)"""
ALONE = "detail = 'thorough' OR has_media OR input_bytes > 20000"


@query(_pack_sql(f"WITH {STORIES} SELECT key, pos, input_bytes AS size, detail AS kind FROM st WHERE NOT ({ALONE})", 5, 20000).replace("SELECT key, pos, batch FROM f", f"""SELECT key, pos, 'batch' AS kind, batch FROM f
    UNION ALL SELECT source, doc_id, 'single', NULL FROM (WITH {STORIES} SELECT key AS source, pos AS doc_id FROM st WHERE {ALONE})"""))
def summary_jobs(spark, sf_dir):
    n = F.col("doc_id")
    stories = table(spark, sf_dir, "documents").select(
        F.col("source").alias("key"), n.alias("pos"), F.when(n % 5 == 0, "thorough").when(n % 5 == 1, "brief").otherwise("normal").alias("detail"),
        (n % 11 == 0).alias("has_media"), F.col("n_chars").alias("raw_bytes"), (F.col("n_chars") + 40).alias("input_bytes"),
    )
    return requests.summary_jobs(stories, ["key"], "pos", 20000)


def _frames(n: str) -> str:
    return f"list_sum(list_transform(range({n}), lambda i: length(i::VARCHAR) + 3)) + 2 * ({n} - 1)"


@query(f"""WITH RECURSIVE lv AS (SELECT conv_id AS key, -1 AS level, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, repeat(md5(text), (1 + turn % 5)::INTEGER) AS body, 0::BIGINT AS n, '' AS content FROM conversations
      UNION ALL SELECT key, level + 1, batch, substr(content, 1, 150), n, content FROM (
        SELECT key, level, batch, n, array_to_string(list_transform(range(1, n + 1), lambda j: concat('[', j - 1, ']', chr(10), substr(bodies[j], 1, shares[j + 1]))), chr(10) || chr(10)) AS content FROM (
          SELECT *, list_reduce(list_prepend([(300 - ({_frames("n")}))::BIGINT], list_transform(bodies, lambda b, j: [length(b), n - j + 1])),
            lambda acc, x: list_concat([acc[1] - least(x[1], acc[1] // x[2])], list_append(acc[2:], least(x[1], acc[1] // x[2])))) AS shares FROM (
            SELECT key, level, place // 3 AS batch, count(*) AS n, list(body ORDER BY place) AS bodies FROM (SELECT *, count(*) OVER (PARTITION BY key) AS left_over FROM lv) WHERE level = -1 OR left_over > 1 GROUP BY ALL))))
    SELECT key, level::INTEGER AS level, place AS batch, n, content, body AS merged FROM lv WHERE level >= 0""")
def merge_fan_in(spark, sf_dir):
    """All merges of all levels, from a conversation's parts to one root."""
    parts = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), "turn", F.repeat(F.md5("text"), (1 + F.col("turn") % 5).cast("int")).alias("body"))
    out = requests.merge_tree(parts, ["key"], "turn", "body", 3, 300, lambda content: F.substring(content, 1, 150))
    return out.withColumn("n", F.col("n").cast("long"))


_BARE = "regexp_replace(text, '[^a-zA-Z ]', '', 'g')"


@query(f"""WITH RECURSIVE t AS (SELECT conv_id AS unit, turn AS m, {_BARE} AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations),
    p AS (SELECT unit, (place // 3) * 3 AS first, m, body, place, 0 AS round FROM t
      UNION ALL SELECT unit, first + CASE WHEN place - first >= (n + 1) // 2 THEN (n + 1) // 2 ELSE 0 END, m, body, place, round + 1
      FROM (SELECT *, count(*) OVER w AS n, length(concat('{{"i":', unit, ',"members":[]}}')) + sum(length(concat('{{"m":', m, ',"text":""}}')) + least(length(body), 150)) OVER w + count(*) OVER w - 1 + 1 AS low FROM p WINDOW w AS (PARTITION BY unit, first)) WHERE low > 600 AND n > 1),
    x AS (SELECT unit, m, body, place, arg_max(first, round) AS first FROM p GROUP BY ALL),
    f AS (SELECT unit, first, count(*) AS n, list(length(body) ORDER BY length(body)) AS sizes, list(m ORDER BY place) AS ms, list(body ORDER BY place) AS bodies, length(concat('{{"i":', unit, ',"members":[]}}')) + sum(length(concat('{{"m":', m, ',"text":""}}'))) + count(*) - 1 AS fixed, least(max(length(body)), 500) AS high FROM x GROUP BY unit, first),
    l AS (SELECT *, (SELECT max(v) FROM range(0, high + 1) r(v) WHERE fixed + list_sum(list_transform(sizes, lambda s: least(s, v))) + 1 <= 600) AS text_limit FROM f)
    SELECT unit, first, n, text_limit::INTEGER AS text_limit, strlen(encoded) AS bytes, encoded FROM (SELECT *, concat('{{"i":', unit, ',"members":[', array_to_string(list_transform(range(1, n + 1), lambda j: concat('{{"m":', ms[j], ',"text":"', substr(bodies[j], 1, text_limit), '"}}')), ','), ']}}') AS encoded FROM l)""")
def sized_records(spark, sf_dir):
    """Conversations as records: three members at most, 600 bytes with the line feed, texts of 150 bytes at least and 500 at most."""
    bare = F.regexp_replace("text", "[^a-zA-Z ]", "")
    members = F.transform(F.array_sort(F.collect_list(F.struct("turn", bare.alias("text")))), lambda x: F.struct(x["turn"].alias("m"), x["text"].alias("text")))
    units = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("unit")).agg(members.alias("members"))
    return requests.sized_records(units, "unit", "members", 3, 600, 150, 500)


def _rounds_sql(back: str, limited: str, odd: str, action: str) -> str:
    """``back``, ``limited`` and ``odd`` by request, member and round; ``action`` by n, back, odd, limited and path."""
    return f"""WITH RECURSIVE q AS (SELECT l_orderkey AS request, l_linenumber AS member, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1),
    r AS (SELECT 0 AS round, request, '' AS path, member, part, '' AS outcome, false AS asked FROM q
      UNION ALL SELECT * FROM (
        SELECT CASE WHEN k = 0 THEN round ELSE round + 1 END AS round, request, CASE WHEN k = 0 THEN path ELSE concat(path, CASE act WHEN 'halves' THEN CASE WHEN rank <= (n + 1) // 2 THEN 'h0' ELSE 'h1' END WHEN 'missing' THEN 'm' ELSE concat('s', member) END) END AS path, member, part,
          CASE WHEN k = 0 THEN result ELSE '' END AS outcome, k = 0 AS asked
        FROM (SELECT *, CASE WHEN came AND act NOT IN ('halves', 'all singly', 'failed') THEN 'done' WHEN act = 'failed' THEN 'failed' ELSE 'asked again' END AS result FROM (
          SELECT *, {action} AS act FROM (
            SELECT *, count(*) OVER w AS n, CASE WHEN lim THEN 0 ELSE count(*) FILTER (WHERE came) OVER w END AS back, row_number() OVER (PARTITION BY request, path ORDER BY member) AS rank FROM (
              SELECT *, {back} AND NOT ({limited}) AS came, ({limited}) AS lim, ({odd}) AS strange FROM (SELECT *, count(*) OVER (PARTITION BY request, path) AS asked_n FROM r WHERE NOT asked)) WINDOW w AS (PARTITION BY request, path)))), (VALUES (0), (1)) t(k)
        WHERE k = 0 OR result = 'asked again'))
    SELECT round, request, path, member, outcome FROM r WHERE asked"""


def _lines(spark, sf_dir):
    first = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity"))
    l = table(spark, sf_dir, "lineitem").withColumn("rn", first).where("rn = 1")
    return l.select(F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("member"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("part"))


@query(_rounds_sql("(part + round) % 4 = 0", "asked_n > 4 AND request % 9 = 0", "false", "CASE WHEN lim THEN CASE WHEN n = 1 THEN 'failed' ELSE 'halves' END WHEN back = n THEN 'done' WHEN back = 0 THEN CASE WHEN n = 1 THEN 'failed' ELSE 'halves' END ELSE 'missing' END"))
def classification_rounds(spark, sf_dir):
    """Recorded answers: a member comes back every fourth round, large batches of some requests are cut off."""

    def answer(asked):
        n = F.count("*").over(Window.partitionBy("request", "path"))
        told = asked.withColumn("limited", (n > 4) & (F.col("request") % 9 == 0))
        return told.where(F.col("limited") | ((F.col("part") + F.col("round")) % 4 == 0)).select("request", "path", F.when(~F.col("limited"), F.col("member")).alias("member"), "limited")

    return requests.retry_rounds(_lines(spark, sf_dir), answer, "classification").drop("place")


@query(_rounds_sql("(part + round) % 3 <> 0", "asked_n > 4 AND request % 9 = 0", "asked_n > 1 AND request % 11 = 0", "CASE WHEN lim THEN CASE WHEN n = 1 OR regexp_matches(path, 's[0-9]+$') THEN 'failed' ELSE 'halves' END WHEN back = n AND NOT strange THEN 'done' WHEN regexp_matches(path, 's[0-9]+$') THEN 'failed' WHEN strange THEN 'all singly' ELSE 'missing singly' END"))
def analysis_rounds(spark, sf_dir):
    """Recorded answers: two members of three come back, some requests with a member that wasn't asked for, some cut off."""

    def answer(asked):
        n = F.count("*").over(Window.partitionBy("request", "path"))
        told = asked.withColumn("n", n).withColumn("limited", (F.col("n") > 4) & (F.col("request") % 9 == 0))
        back = told.where(F.col("limited") | ((F.col("part") + F.col("round")) % 3 != 0)).select("request", "path", F.when(~F.col("limited"), F.col("member")).alias("member"), "limited")
        strange = told.where(~F.col("limited") & (F.col("n") > 1) & (F.col("request") % 11 == 0)).select("request", "path", F.lit(99).alias("member"), "limited").distinct()
        return back.unionByName(strange)

    return requests.retry_rounds(_lines(spark, sf_dir), answer, "analysis").drop("place")


@query(_rounds_sql("(part + round) % 3 <> 0", "request % 13 = 0 AND asked_n > 1", "false", "CASE WHEN back = n THEN 'done' WHEN regexp_matches(path, 's[0-9]+$') THEN 'failed' WHEN lim THEN 'all singly' ELSE 'missing singly' END"))
def summary_rounds(spark, sf_dir):
    """Recorded answers: entries of a batch that failed or didn't come back are summarised singly, once."""

    def answer(asked):
        n = F.count("*").over(Window.partitionBy("request", "path"))
        told = asked.withColumn("limited", (n > 1) & (F.col("request") % 13 == 0))
        return told.where(F.col("limited") | ((F.col("part") + F.col("round")) % 3 != 0)).select("request", "path", F.when(~F.col("limited"), F.col("member")).alias("member"), "limited")

    return requests.retry_rounds(_lines(spark, sf_dir), answer, "summary").drop("place")


@query("""SELECT o_orderkey AS story, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE cast(o_custkey % 101 AS INTEGER) END AS score, o_orderstatus <> 'F' AND o_custkey % 101 >= 60 AS relevant FROM orders""")
def classification_decisions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    score, relevant = requests.decision((F.col("o_custkey") % 101).cast("int"), F.col("o_orderstatus") == "F", F.lit(60))
    return o.select(F.col("o_orderkey").alias("story"), score.alias("score"), relevant.alias("relevant"))


@query("""SELECT o_orderkey AS story, CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_custkey % 2 = 0 AND o_orderpriority = '5-LOW' THEN 100 END AS score FROM orders""")
def fast_path_scores(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    prompt = F.when(F.col("o_orderpriority") == "5-LOW", " ").otherwise(F.col("o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("story"), requests.fast_score(F.col("o_custkey") % 2 != 0, prompt, F.col("o_orderstatus") == "F").alias("score"))


def _scan(name: str) -> None:
    def scan(spark, sf_dir):
        return table(spark, sf_dir, name)

    scan.__name__ = f"scan_{name}"
    query(f"SELECT * FROM {name}")(scan)


for _name in NAMES:
    if _name != "embeddings":  # arrays of floats: the rows are compared by count alone
        _scan(_name)


@query("SELECT vec_id, label, cast(len(embedding) AS INTEGER) AS dimensions FROM embeddings")
def scan_embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.size("embedding").alias("dimensions"))

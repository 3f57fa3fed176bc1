"""Joins of feeds, items and stories, each an equi-join first."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import udfs
from ..functions.text import stripped


def missing_keys(expected: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    return expected.join(present.select(*on), on, "left_anti")


def entitled(posts: DataFrame, lookups: DataFrame, id_col: str, publication: str) -> DataFrame:
    """``posts`` with entitlement: denied where the lookup found nothing, else full. ``lookups``: ``asked`` (the id that was asked for), and the id and publication that came back; one that differs from the post's is an error."""
    found = lookups.select("asked", F.col(id_col).alias("__id"), F.col(publication).alias("__of"))
    both = posts.join(found, posts[id_col] == found["asked"], "left")
    other = ~F.col("__id").eqNullSafe(F.col(id_col)) | ~F.col("__of").eqNullSafe(F.col(publication))
    wrong = F.raise_error(F.concat(F.lit("another post came back for "), F.col(id_col).cast("string")))
    return both.withColumn("entitlement", F.when(F.col("asked").isNull(), "denied").when(other, wrong).otherwise("full")).drop("asked", "__id", "__of")


def reused_points(selected: DataFrame, current: DataFrame, history: DataFrame, on: list[str], order: list[Column]) -> DataFrame:
    """``selected`` with points and origin: of the current digest where it has the same versions (``on``), else the newest (by ``order``) of the history, else null (to be summarised)."""
    w = Window.partitionBy(*on).orderBy(*order)
    newest = history.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*on, F.col("points").alias("__past"))
    mine = current.select(*on, F.col("points").alias("__now"))
    both = selected.join(mine, on, "left").join(newest, on, "left")
    origin = F.when(F.col("__now").isNotNull(), "current").when(F.col("__past").isNotNull(), "history")
    return both.withColumn("points", F.coalesce("__now", "__past")).withColumn("origin", origin).drop("__now", "__past")


def tuple_lookup(requests: DataFrame, cache: DataFrame, on: list[str]) -> DataFrame:
    """Cache rows for the requested tuples, with the requests' own order (column ordinal); misses have nulls."""
    return requests.join(cache, on, "left")


def unit_misses(members: DataFrame, hits: DataFrame, on: list[str], unit: list[str]) -> DataFrame:
    """Members with ``hit``, and ``miss``: whether any member of their unit has none (then the whole unit is analysed again)."""
    marked = members.join(hits.select(*on).distinct().withColumn("hit", F.lit(True)), on, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return marked.withColumn("miss", F.max(~F.col("hit")).over(Window.partitionBy(*unit)))


def quoted(messages: DataFrame, key: list[str], reply_to: str, place: str, text: str) -> DataFrame:
    """Messages with the text of the one that they reply to before their own, where it is known and not empty."""
    q = messages.select(*key, F.col(place).alias("__place"), F.col(text).alias("__quote"))
    joined = messages.withColumn("__place", F.col(reply_to)).join(q, [*key, "__place"], "left").drop("__place")
    prefix = F.concat(F.lit("[QUOTED_MESSAGE]\n"), F.col("__quote"), F.lit("\n[/QUOTED_MESSAGE]\n"), F.col(text))
    return joined.withColumn("rendered", F.when(F.coalesce(F.col("__quote"), F.lit("")) != "", prefix).otherwise(F.col(text))).drop("__quote")


def newest_reference(keys: DataFrame, references: DataFrame, component: str) -> DataFrame:
    """For each component the newest reference that has one of its keys (ties: the smaller key)."""
    met = keys.select(component, "key").distinct().join(references.select("key", "last_ms"), "key")
    w = Window.partitionBy(component).orderBy(F.desc("last_ms"), F.asc("key"))
    return met.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def windowed(items: DataFrame, windows: DataFrame) -> DataFrame:
    """Items within their feed's own window: the feed is the equi key, the range a residual. The least begin and the greatest end of all windows (one row is asked for) filter the items first, where the scan can use them."""
    low, high = windows.agg(F.min("from_ms"), F.max("to_ms")).first()
    if low is None or high is None:
        return items.join(windows, "feed_id").limit(0)
    near = items.where((F.col("date_ms") >= low) & (F.col("date_ms") <= high))
    return near.join(windows, "feed_id").where((F.col("date_ms") >= F.col("from_ms")) & (F.col("date_ms") <= F.col("to_ms")))


def phrase_matches(texts: DataFrame, rules: list[tuple[str, str]], text: str) -> DataFrame:
    """(…, rule_id) for every rule (id, phrase) whose phrase is a substring: an array of the rules met by literal predicates, exploded. No join at all: the rules are a literal list."""
    hits = F.filter(F.array(*[F.when(F.lower(text).contains(p.lower()), F.lit(i)) for i, p in rules]), lambda x: x.isNotNull())
    return texts.withColumn("rule_id", F.explode(hits))


#: Characters of a phrase that it is looked up by where the rules are too many for an automaton.
KEY = 8
#: Bytes of phrases that one automaton holds; it is sent to every task.
AUTOMATON_BYTES = 16 << 20


def rule_matches(stories: DataFrame, rules: DataFrame, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """(story_id, rule_id), each once: rules (rule_id, kind, label) as a table of any size.

    ``stories``: story_id and the arrays topics, entities, types and texts. Labels and values are compared in NFKC and lower case, without white space at their ends. A topic, entity or story_type equals one of the
    story's; a phrase is a substring of one of its texts. Blank labels and other kinds match nothing, null arrays are empty.

    Topics, entities and types are an equi-join. Phrases of up to ``automaton_bytes`` in all are one automaton in every task, which reads each text once. More are an equi-join too: their first KEY characters (all of
    shorter ones) against the different substrings of that length, then one look at the whole phrase; substrings go without the texts, which are joined back for candidates only.
    """
    plain = lambda c: F.lower(udfs.nfkc(c))
    needles = rules.select("rule_id", "kind", stripped(plain("label")).alias("needle")).where("needle <> ''")
    kinds = (("topic", "topics"), ("entity", "entities"), ("story_type", "types"), ("phrase", "texts"))

    def tagged(kind: str, column: str) -> Column:
        return F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), v.alias("value")))

    values = stories.select("story_id", F.inline(F.concat(*[tagged(*k) for k in kinds]))).where("value IS NOT NULL").withColumn("value", plain("value"))
    equal = values.where("kind <> 'phrase'").select("story_id", "kind", stripped("value").alias("needle")).join(needles, ["kind", "needle"]).select("story_id", "rule_id")

    phrases = needles.where("kind = 'phrase'").select("rule_id", "needle")
    texts = values.where("kind = 'phrase'").select("story_id", "place", "value")
    size = phrases.agg(F.sum(F.octet_length("needle") + 16)).first()[0]
    if size is None:
        return equal.distinct()
    found = _by_automaton(texts, phrases) if size <= automaton_bytes else _by_keys(texts, phrases)
    return equal.unionByName(found).distinct()


def _by_automaton(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(story_id, rule_id): phrases are few enough to be sent; equal ones are one needle."""
    rows = phrases.groupBy("needle").agg(F.collect_list("rule_id").alias("rules")).toArrow()
    sent = texts.sparkSession.sparkContext.broadcast((rows["needle"].to_pylist(), rows["rules"].to_pylist()))
    kinds = {c: df.schema[c].dataType.simpleString() for c, df in (("story_id", texts), ("rule_id", phrases))}
    few = udfs.ROWS

    def run(batches: Iterator) -> Iterator:
        import ahocorasick
        import pyarrow as pa

        needles, rules = sent.value
        machine = ahocorasick.Automaton()
        for i, needle in enumerate(needles):
            machine.add_word(needle, i)
        machine.make_automaton()
        # a few rows of a batch are Python objects at once, with their matches
        for part in (batch.slice(a, few) for batch in batches for a in range(0, batch.num_rows, few)):
            stories, out = [], []
            for i, text in enumerate(part.column(1).to_pylist()):
                for n in {n for _, n in machine.iter(text)}:
                    out += rules[n]
                    stories += [i] * len(rules[n])
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(stories, pa.int64())), pa.array(out, schema.field(1).type)], ["story_id", "rule_id"])

    from pyspark.sql.pandas.types import to_arrow_schema

    of = phrases.select(F.lit(None).alias("story_id"), "rule_id").schema
    schema = to_arrow_schema(of)
    return texts.select("story_id", "value").mapInArrow(run, f"story_id {kinds['story_id']}, rule_id {kinds['rule_id']}")


def _by_keys(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(story_id, rule_id) by an equi-join on the phrases' first characters."""
    phrases = phrases.withColumn("key", F.left("needle", F.lit(KEY)))
    # at most KEY numbers, whatever the number of rules
    sizes = sorted(r["n"] for r in phrases.select(F.char_length("key").alias("n")).distinct().collect())
    # the KEY characters from every place on (fewer at the end), of which shorter keys are the beginnings
    windows = F.array_distinct(F.regexp_extract_all("value", F.lit(f"(?s)(?=(.{{1,{KEY}}}))"), 1))
    pieces = texts.select("story_id", "place", F.explode(windows).alias("piece"))
    starts = F.array(*[F.when(F.char_length("piece") >= n, F.left("piece", F.lit(n))) for n in sizes])
    keyed = pieces.select("story_id", "place", F.explode(starts).alias("key"))
    met = keyed.join(phrases, "key").select("story_id", "place", "rule_id", "needle").distinct()
    return met.join(texts, ["story_id", "place"]).where(F.col("value").contains(F.col("needle"))).select("story_id", "rule_id")


def neighbor_bounds(rows: DataFrame, partition: list[str], order: list[Column], date: str = "date_ms") -> DataFrame:
    """Bounds of undated rows: the last known date before, and 59 999 ms past the next known one."""
    w = Window.partitionBy(*partition).orderBy(*order)
    low = F.last(date, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    high = F.first(date, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)) + 59_999
    return rows.withColumn("lower_ms", F.when(F.col(date).isNull(), low)).withColumn("upper_ms", F.when(F.col(date).isNull(), high))

"""State transitions as pure functions: the old table and what arrives, to the new table.

Nothing is updated in place; a caller writes the result to a new folder and switches to it. Keys are joined once; a batch is
first reduced to one row a key, so a repeated key costs no repeated join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_of_batch(batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key (the one that sequential writes would leave)."""
    return batch.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def upsert_items(old: DataFrame, batch: DataFrame, keys: list[str], payload: list[str], stamp: str) -> DataFrame:
    """Payload always replaced; the stamp advances only where a payload column differs (nulls compared as values)."""
    o = old.select(*keys, *[F.col(c).alias(f"__o_{c}") for c in [*payload, stamp]], F.lit(True).alias("__old"))
    n = batch.select(*keys, *payload, stamp, F.lit(True).alias("__new"))
    joined = o.join(n, keys, "full")
    changed = F.lit(False)
    for c in payload:
        changed |= ~F.col(c).eqNullSafe(F.col(f"__o_{c}"))
    arrived, known = F.col("__new").isNotNull(), F.col("__old").isNotNull()
    columns = [F.when(arrived, F.col(c)).otherwise(F.col(f"__o_{c}")).alias(c) for c in payload]
    new_stamp = F.when(~arrived, F.col(f"__o_{stamp}")).when(~known | changed, F.col(stamp)).otherwise(F.col(f"__o_{stamp}"))
    return joined.select(*keys, *columns, new_stamp.alias(stamp))


def upsert_periods(old: DataFrame, batch: DataFrame, keys: list[str], identity: str, status: str, at: str) -> DataFrame:
    """(keys, identity, status, created_at, updated_at): one row a key. A key that is new is made by its first row (by ``at``, then identity); the last row's status and time are taken. Several rows of a key in one batch are as if each were written by itself."""
    order = F.struct(F.col(at), F.col(identity))
    n = batch.groupBy(*keys).agg(F.min_by(identity, order).alias("__first"), F.min(at).alias("__from"), F.max_by(status, order).alias("__status"), F.max(at).alias("__to"))
    both = old.withColumn("__known", F.lit(True)).join(n, keys, "full")
    known, new = F.col("__known").isNotNull(), F.col("__to").isNotNull()
    return both.select(
        *keys, F.when(known, F.col(identity)).otherwise(F.col("__first")).alias(identity), F.when(new, F.col("__status")).otherwise(F.col(status)).alias(status),
        F.when(known, F.col("created_at")).otherwise(F.col("__from")).alias("created_at"), F.when(new, F.col("__to")).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def advance_cursors(cursors: DataFrame, seen: DataFrame, key: str, column: str) -> DataFrame:
    """Cursors never go back; a key seen for the first time begins with what was seen."""
    new = seen.groupBy(key).agg(F.max(column).alias("__seen"))
    return cursors.join(new, key, "full").select(key, F.greatest(column, "__seen").alias(column))


def create_or_revive(feeds: DataFrame, requests: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """A feed that is active stays as it is, a deleted one is revived with the defaults, an unknown one is made with them. Column ``deleted_at`` marks the deleted."""
    columns = [c for c in feeds.columns if c not in (key, "deleted_at")]
    r = requests.select(key).distinct().withColumn("__asked", F.lit(True))
    joined = feeds.withColumn("__known", F.lit(True)).join(r, key, "full")
    fresh = F.col("__asked").isNotNull() & (F.col("__known").isNull() | F.col("deleted_at").isNotNull())
    outcome = F.when(F.col("__asked").isNull(), "untouched").when(F.col("__known").isNull(), "created").when(F.col("deleted_at").isNotNull(), "revived").otherwise("existing")
    return joined.select(key, *[F.when(fresh, defaults[c]).otherwise(F.col(c)).alias(c) if c in defaults else F.col(c) for c in columns], F.when(~fresh, F.col("deleted_at")).alias("deleted_at"), outcome.alias("outcome"))


def insert_once(old: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The old rows, and of the batch the first row of each key that the old don't have."""
    first = last_of_batch(batch, keys, order)
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def replace_set(old: DataFrame, new: DataFrame, keys: list[str], identity: str) -> DataFrame:
    """Exactly the new set; a row whose keys the old set had keeps its identity, others keep the one they bring."""
    ids = old.select(*keys, F.col(identity).alias("__id"))
    return new.join(ids, keys, "left").withColumn(identity, F.coalesce("__id", identity)).drop("__id")


def apply_rules(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rules (origin, state, strength) by precedence: an inferred rule never replaces an explicit or dismissed one; the same rule again changes nothing. ``version`` counts changes."""
    n = new.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in ("origin", "state", "strength")], F.lit(True).alias("__new"))
    joined = old.withColumn("__known", F.lit(True)).join(n, keys, "full")
    barred = (F.col("__n_origin") == "inferred") & F.coalesce((F.col("origin") == "explicit") | (F.col("state") == "dismissed"), F.lit(False))
    same = F.lit(True)
    for c in ("origin", "state", "strength"):
        same &= F.col(c).eqNullSafe(F.col(f"__n_{c}"))
    take = F.col("__new").isNotNull() & ~barred & ~(F.col("__known").isNotNull() & same)
    columns = [F.when(take, F.col(f"__n_{c}")).otherwise(F.col(c)).alias(c) for c in ("origin", "state", "strength")]
    return joined.select(*keys, *columns, (F.coalesce("version", F.lit(0)) + F.when(take, 1).otherwise(0)).alias("version"))


def soft_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """Parents and children (which name their parent in ``key``) marked as deleted, those deleted before left as they are."""
    g = gone.select(key).distinct().withColumn("__gone", F.lit(True))

    def mark(df: DataFrame) -> DataFrame:
        hit = F.col("__gone").isNotNull() & F.col("deleted_at").isNull()
        return df.join(g, key, "left").withColumn("deleted_at", F.when(hit, at).otherwise(F.col("deleted_at"))).drop("__gone")

    return mark(parents), mark(children)


def bump_version(old: DataFrame, changes: DataFrame, key: str, column: str, version: str) -> DataFrame:
    """``column`` set to what arrives, ``version`` one more where that is a change."""
    n = changes.select(key, F.col(column).alias("__n"), F.lit(True).alias("__new"))
    joined = old.join(n, key, "left")
    change = F.col("__new").isNotNull() & ~F.col("__n").eqNullSafe(F.col(column))
    return joined.withColumn(version, F.col(version) + F.when(change, 1).otherwise(0)).withColumn(column, F.when(change, F.col("__n")).otherwise(F.col(column))).drop("__n", "__new")


def story_versions(stories: DataFrame, developments: DataFrame, members: DataFrame, new_stories: DataFrame, new_developments: DataFrame, new_members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Versioned upsert of stories, their developments and members, to the three new tables.

    stories (story, title, labels, version); developments (story, dev, kind, title, occurred_at, version); members (story, dev, item, fingerprint);
    the new ones without versions. A story's version rises by one if its title or labels, a development's kind or title, or any membership changed, or it gained
    a development; a development's by one if its kind or title changed, its date became earlier, or it gained, lost or re-fingerprinted a member. An item belongs to
    one development: a move changes both. What is absent from the new tables stays as it is.
    """
    m_old = members.select("item", F.col("story").alias("o_story"), F.col("dev").alias("o_dev"), F.col("fingerprint").alias("o_print"))
    m = m_old.join(new_members, "item", "full")
    moved = F.col("story").isNotNull() & (~F.col("story").eqNullSafe(F.col("o_story")) | ~F.col("dev").eqNullSafe(F.col("o_dev")))
    touched = m.withColumn("moved", moved).withColumn("reprinted", F.col("story").isNotNull() & ~F.col("moved") & ~F.col("fingerprint").eqNullSafe(F.col("o_print")))
    gained = touched.where("moved OR reprinted").select("story", "dev", (F.col("moved")).alias("membership"))
    lost = touched.where("moved AND o_story IS NOT NULL").select(F.col("o_story").alias("story"), F.col("o_dev").alias("dev"), F.lit(True).alias("membership"))
    dev_touch = gained.unionByName(lost).groupBy("story", "dev").agg(F.lit(True).alias("touched"), F.bool_or("membership").alias("membership"))
    members_out = touched.select("item", *[F.coalesce(n, o).alias(n) for n, o in (("story", "o_story"), ("dev", "o_dev"), ("fingerprint", "o_print"))])

    nd = new_developments.select("story", "dev", F.col("kind").alias("n_kind"), F.col("title").alias("n_title"), F.col("occurred_at").alias("n_at"), F.lit(True).alias("new"))
    d = developments.withColumn("known", F.lit(True)).join(nd, ["story", "dev"], "full").join(dev_touch, ["story", "dev"], "left")
    known, new = F.col("known").isNotNull(), F.col("new").isNotNull()
    meta = known & new & (~F.col("kind").eqNullSafe(F.col("n_kind")) | ~F.col("title").eqNullSafe(F.col("n_title")))
    earlier = known & new & F.coalesce(F.col("n_at") < F.col("occurred_at"), F.lit(False))
    d = d.withColumn("meta", meta).withColumn("added", ~known & new)
    dev_bump = known & (F.col("meta") | earlier | F.coalesce("touched", F.lit(False)))
    devs_out = d.select("story", "dev", F.coalesce("n_kind", "kind").alias("kind"), F.when(new, F.col("n_title")).otherwise(F.col("title")).alias("title"), F.least("occurred_at", "n_at").alias("occurred_at"), F.when(~known, 1).otherwise(F.col("version") + F.when(dev_bump, 1).otherwise(0)).alias("version"))

    story_touch = d.groupBy("story").agg(F.bool_or(F.col("added") | F.col("meta") | F.coalesce("membership", F.lit(False)) | F.coalesce("touched", F.lit(False))).alias("changed"))
    ns = new_stories.select("story", F.col("title").alias("n_title"), F.col("labels").alias("n_labels"), F.lit(True).alias("new"))
    s = stories.withColumn("known", F.lit(True)).join(ns, "story", "full").join(story_touch, "story", "left")
    own = new & (~F.col("title").eqNullSafe(F.col("n_title")) | ~F.col("labels").eqNullSafe(F.col("n_labels")))
    bump = own | F.coalesce("changed", F.lit(False))
    stories_out = s.select("story", F.when(new, F.col("n_title")).otherwise(F.col("title")).alias("title"), F.when(new, F.col("n_labels")).otherwise(F.col("labels")).alias("labels"), F.when(~known, 1).otherwise(F.col("version") + F.when(bump, 1).otherwise(0)).alias("version"))
    return stories_out, devs_out, members_out


def warmed(sources: DataFrame, events: DataFrame, key: str, event: str, threshold: int) -> DataFrame:
    """(key, negatives, graduated, graduated_by) of the sources that events name: each different event counts once, while the source is still warm (its count below ``threshold``); the event that reaches the threshold ends the warmup.

    ``sources``: the key and its ``negatives`` so far; events of unknown sources count nothing. No more than ``threshold`` events of a source are looked at one by one.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(event))
    first = events.select(key, event).distinct().withColumn("__k", place).where(F.col("__k") <= threshold)
    both = first.join(sources.select(key, F.col("negatives").alias("__before")), key)
    at = F.col("__before") + F.col("__k")
    out = both.groupBy(key).agg(F.max("__before").alias("__before"), F.count_if(at <= threshold).alias("__more"), F.min(F.when(at == threshold, F.col(event))).alias("graduated_by"))
    return out.select(key, (F.col("__before") + F.col("__more")).cast("long").alias("negatives"), F.col("graduated_by").isNotNull().alias("graduated"), "graduated_by")

"""Exact dedup: groups by a 128-bit content hash, bytes compared inside the groups; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_groups(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Documents are grouped by (MD5, text): the shuffle key starts with the 128-bit hash, and the
    aggregate compares the bytes, so two texts with one MD5 form two groups. Map-side aggregation leaves
    one row per text and task, so a hot text is no hot task. Rows then find their group by MD5 and,
    should MD5 collide, SHA-256.

    ``keep``: which stable id of a group stays, the "smallest" or the "largest".
    A null text counts as empty; a row whose id is null never stays while another of its group has an id;
    repeated rows (same id and text) each count in group_size and share ``kept``; an empty table gives an empty result;
    other columns are ignored.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    base = base.withColumn("h", F.unhex(F.md5("body")))
    groups = base.groupBy("h", "body").agg(pick("id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.select("h", F.unhex(F.sha2("body", 256)).alias("sha"), "keep_id", "group_size")
    rows = base.select("id", "h", F.unhex(F.sha2("body", 256)).alias("sha"))
    out = rows.join(groups, ["h", "sha"])
    return out.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (a row with a null id stays only where its whole group has none)."""
    kept = exact_groups(docs, keep, id_col, text_col).where("kept").select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    same = docs[id_col].eqNullSafe(kept["__id"]) & (F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256) == kept["__sha"])
    return docs.join(kept, same, "left_semi")

"""Deletes over a declared graph of foreign keys, level by level: rows of a deleted parent go too, or lose their reference."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    key: str
    action: str = "cascade"

    def __post_init__(self):
        if self.action not in ("cascade", "set_null"):
            raise ValueError(f"no action {self.action}")


def levels(tables: list[str], keys: tuple[ForeignKey, ...]) -> list[str]:
    """Tables so that every parent comes before its children; a table may refer to itself, other cycles are refused."""
    left, out = list(tables), []
    while left:
        ready = [t for t in left if not any(k.child == t and k.parent != t and k.parent in left for k in keys)]
        if not ready:
            raise ValueError(f"foreign keys go in a circle: {', '.join(left)}")
        out += ready
        left = [t for t in left if t not in ready]
    return out


def deleted(tables: dict[str, DataFrame], keys: tuple[ForeignKey, ...], roots: dict[str, Column], rounds: int = 100) -> dict[str, DataFrame]:
    """What is left of each table when the rows go that ``roots`` names by a condition.

    Each edge is a join of the child with the different keys of parents that went; nothing else of a parent moves. A null reference points to nothing, and a reference to a key that isn't there stays. A row goes if one of its
    cascading parents does, whatever its other references say. A table's references to itself are followed round by round.
    """
    out, gone = {}, {}

    def marked(rows: DataFrame, key: ForeignKey, parents: DataFrame) -> DataFrame:
        """``rows`` with __hit: whether ``key`` refers to one of ``parents``."""
        p = parents.select(F.col(key.key).alias("__parent")).where("__parent IS NOT NULL").distinct().withColumn("__hit", F.lit(True))
        return rows.join(p, rows[key.column] == p["__parent"], "left").drop("__parent").withColumn("__hit", F.coalesce("__hit", F.lit(False)))

    for name in levels(list(tables), keys):
        rows = tables[name].withColumn("__gone", F.coalesce(roots.get(name, F.lit(False)), F.lit(False)))
        mine = [k for k in keys if k.child == name]
        touched = [k for k in mine if k.parent != name and k.parent in gone]
        for key in sorted(touched, key=lambda k: k.action != "cascade"):
            rows = marked(rows, key, gone[key.parent])
            if key.action == "cascade":
                rows = rows.withColumn("__gone", F.col("__gone") | F.col("__hit")).drop("__hit")
            else:
                rows = rows.withColumn(key.column, F.when(~F.col("__hit"), F.col(key.column))).drop("__hit")
        for key in (k for k in mine if k.parent == name):
            if not touched and name not in roots:
                continue
            rows = settled(rows, "cascade")
            for _ in range(rounds if key.action == "cascade" else 0):
                more = settled(marked(rows, key, rows.where("__gone")), "cascade")
                grown = not more.where("__hit AND NOT __gone").isEmpty()
                rows = more.withColumn("__gone", F.col("__gone") | F.col("__hit")).drop("__hit")
                if not grown:
                    break
            else:
                if key.action == "cascade":
                    raise RuntimeError("the cascade did not settle")
            if key.action == "set_null":
                rows = marked(rows, key, rows.where("__gone")).withColumn(key.column, F.when(~F.col("__hit"), F.col(key.column))).drop("__hit")
        if touched or name in roots:
            gone[name] = rows.where("__gone")
        out[name] = rows.where("NOT __gone").select(*tables[name].columns)
    return out

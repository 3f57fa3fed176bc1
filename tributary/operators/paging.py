"""Total orders, top-k and keyset pages."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Page sizes: default and most.
DEFAULT_LIMIT, MOST = 20, 100
#: Named sorts: column and direction.
SORTS = {"requested_desc": ("created_at", "desc"), "requested_asc": ("created_at", "asc"), "period_desc": ("period_end", "desc"), "period_asc": ("period_end", "asc")}


def page_limit(limit: int | None) -> int:
    if limit is None:
        return DEFAULT_LIMIT
    if not isinstance(limit, int) or isinstance(limit, bool) or not 1 <= limit <= MOST:
        raise ValueError(f"the limit must lie from 1 to {MOST}")
    return limit


def encode_cursor(sort: str, value, key) -> str:
    raw = json.dumps({"s": sort, "v": value, "id": key}, separators=(",", ":")).encode()
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def decode_cursor(cursor: str, sort: str):
    """(value, key) of a cursor made for the same sort; ValueError otherwise."""
    try:
        found = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        if found["s"] != sort:
            raise ValueError("the cursor is of another sort")
        return found["v"], found["id"]
    except (KeyError, TypeError, UnicodeDecodeError) as e:
        raise ValueError("not a cursor") from e


def page(df: DataFrame, column: str, key: str, direction: str, limit: int, after: tuple | None = None) -> DataFrame:
    """One page and one row more (which tells that another page follows), by (column, key) in one direction; a filter on the tuple, then a top-k, never a full sort."""
    if after is not None:
        value, last = F.lit(after[0]), F.lit(after[1])
        further = (F.col(column) < value) | ((F.col(column) == value) & (F.col(key) < last)) if direction == "desc" else (F.col(column) > value) | ((F.col(column) == value) & (F.col(key) > last))
        df = df.where(further)
    order = [F.desc(column), F.desc(key)] if direction == "desc" else [F.asc(column), F.asc(key)]
    return df.orderBy(*order).limit(page_limit(limit) + 1)


def top_k(df: DataFrame, partition: list[str], order: list[Column], k: int | Column) -> DataFrame:
    """The first k rows of each partition, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def cursor_column(sort: str, value: Column, key: Column) -> Column:
    """base64url of the cursor's JSON, without padding."""
    raw = F.to_json(F.struct(F.lit(sort).alias("s"), value.alias("v"), key.alias("id")))
    return F.translate(F.rtrim(F.base64(F.encode(raw, "UTF-8")), F.lit("=")), "+/", "-_")

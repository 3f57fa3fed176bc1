"""A paged JSON archive, newest posts first.

A page is one JSON file, a list of posts (id, type, title, date_ms, text); pages follow one another by name, and each post of a page is not older than those of the next. Spark's own file source opens
pages, in tasks and on any file system; the driver has their names only. Pages are read in waves, each as large as all before it, until one lies wholly before the window: the number of waves is
the logarithm of the number of pages. A page that repeats another (a paging cycle) and a page with an invalid post fail the scan; both are told by a table with a row a page, written wave by wave.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stripped
from ..session import settled

POST = "id long, type string, title string, date_ms long, text string"
#: Pages of the first wave, and of a batch of the stream.
WAVE = 256


def parsed_options(options: dict) -> dict:
    """Options as a connector has them, texts, as ``scan`` takes them."""
    out: dict = {k: int(options[k]) for k in ("from_ms", "to_ms") if k in options}
    if "kinds" in options:
        out["kinds"] = [k for k in options["kinds"].split(",") if k]
    return out


def names(spark: SparkSession, glob: str) -> list[str]:
    """Paths that a glob names, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(x.getPath().toString() for x in found)


def pages(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(page: its path, signature: SHA-256 of its bytes, posts: null where it is no list of posts)."""
    raw = spark.read.option("wholetext", "true").text(paths)
    posts = F.from_json("value", f"array<struct<{POST.replace(' ', ':').replace(',:', ',')}>>", {"mode": "PERMISSIVE"})
    return raw.select(F.col("_metadata.file_path").alias("page"), F.sha2("value", 256).alias("signature"), posts.alias("posts"))


def _valid(post):
    known = post["id"].isNotNull() & (post["id"] > 0) & (post["id"] < 2**53) & post["date_ms"].isNotNull()
    return F.coalesce(known & (stripped(post["title"]) != "") & (stripped(post["type"]) != ""), F.lit(False))


def accounts(found: DataFrame) -> DataFrame:
    """A row a page: page, signature, oldest, newest, and whether it is to be refused."""
    dates = F.transform("posts", lambda p: p["date_ms"])
    return found.select("page", "signature", F.array_min(dates).alias("oldest"), F.array_max(dates).alias("newest"), (F.col("posts").isNull() | F.exists("posts", lambda p: ~_valid(p))).alias("bad"))


def checked(told: DataFrame) -> None:
    """Raise for a page with an invalid post and for pages that are equal."""
    bad = told.where("bad").orderBy("page").first()
    if bad:
        raise ValueError(f"an invalid post in {bad['page']}")
    twice = told.groupBy("signature").agg(F.count("*").alias("n"), F.min("page").alias("page"), F.max("page").alias("other")).where("n > 1").orderBy("page").first()
    if twice:
        raise ValueError(f"page {twice['other']} repeats page {twice['page']}")


def posts_of(found: DataFrame, kinds: list[str], from_ms: int, to_ms: int) -> DataFrame:
    rows = found.select(F.inline("posts")).where(F.col("type").isin(kinds) & F.col("date_ms").between(from_ms, to_ms))
    return rows.select(F.col("id").alias("post_id"), F.col("type").alias("kind"), "title", "date_ms", "text")


def scan(spark: SparkSession, paths: list[str], kinds: list[str] = ("newsletter", "podcast"), from_ms: int = -(2**62), to_ms: int = 2**62, wave: int = WAVE) -> DataFrame:
    """(post_id, kind, title, date_ms, text): posts of the kinds within the window, from the pages up to the first that lies wholly before it. A path that is named twice is a cycle."""
    if len(set(paths)) < len(paths):
        counts = Counter(paths)
        again = next(p for p in paths if counts[p] > 1)
        raise ValueError(f"page {again} repeats page {again}")
    told, found, last, read = None, None, None, 0
    while read < len(paths) and not last:
        # a wave's files are listed once, here
        wave_pages = pages(spark, paths[read : read + max(wave, read)])
        read += max(wave, read)
        mine = settled(accounts(wave_pages), "pages")
        told = mine if told is None else told.unionByName(mine)
        found = wave_pages if found is None else found.unionByName(wave_pages)
        # a row a page of the wave
        last = mine.where(F.col("newest") < from_ms).agg(F.min("page")).first()[0]
    if told is None:
        return spark.createDataFrame([], "post_id long, kind string, title string, date_ms long, text string")
    if last:
        told = told.where(F.col("page") <= last)
    checked(told)
    return posts_of(found if last is None else found.where(F.col("page") <= last), list(kinds), from_ms, to_ms)


def stream(spark: SparkSession, glob: str, kinds: list[str] = ("newsletter", "podcast"), from_ms: int = -(2**62), to_ms: int = 2**62, pages_per_batch: int = WAVE) -> DataFrame:
    """Posts of pages as they arrive; the file source's own offsets remember which pages were read. An invalid page fails its batch."""
    raw = spark.readStream.option("wholetext", "true").option("maxFilesPerTrigger", pages_per_batch).text(glob)
    posts = F.from_json("value", f"array<struct<{POST.replace(' ', ':').replace(',:', ',')}>>")
    bad = posts.isNull() | F.exists(posts, lambda p: ~_valid(p))
    found = raw.select(F.when(bad, F.raise_error(F.lit("an invalid post"))).otherwise(posts).alias("posts"))
    return posts_of(found, list(kinds), from_ms, to_ms)

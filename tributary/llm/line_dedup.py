"""Line dedup by a segment-partition edit join; DataFrame functions only.

Lines at most ``edits`` apart are linked, and of each connected class the first line of the corpus stays.
A line is split into edits + 1 segments. Of two lines so close one segment is whole in both, at places that differ by a few
characters at most; so every line's segments are indexed by (number, length of the line, substring), and every line
probes the index of its own length and the lengths down to ``edits`` less, at the places that the multi-match-aware rule
leaves; only probes whose bit is set in a bitmap of the indexed keys are shuffled. Candidate pairs are verified once, by a bit-parallel edit distance
in a band as wide as the threshold: a column of the band is two numbers, moved on by a handful of bit operations.

Variants of one line by the thousand share their segments. Each is paired with one hub of every key first, and only lines of different
components are paired after that, if their counts of characters by class lie within 2 * edits, as those of close lines do.

Lines too short for the edit join are linked with equal ones only: they are counted by id like all others, and have no keys.

Equal lines are one line in all this. Which lines are worth shuffling as text is told by bitmaps of their hashes
of a fixed size (2**BITS_LOG2 bits), broadcast: a bit that is set by chance costs work, never a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, components, discard, materialize, within

#: Shorter lines, in characters, have no near copies; exact ones they may have.
MIN_CHARS = 24
EDITS = 2
#: Classes of characters for the histograms.
CLASSES = ("aA", "eE", "iI", "oO", "uU", "tT", "nN", "sS", "rR", "hH", "dDlL", "cCmM", "bBgGpPwWvV", " ", ".,!?;:", "0123456789")


def line_keys(lines: DataFrame, edits: int, index: bool) -> DataFrame:
    """(h, key) for each line (h, line, n) and each key that it has in the ``index``, or else that it probes.

    Segment i of a line of m characters runs from i * m / k to (i + 1) * m / k, rounded down, for k = edits + 1. A key is a hash of i, m and a substring: of the
    line's own segments (the index), and of the other places where a line of a length from n - edits to n may have its segment in this one.
    The places are one literal list, exploded, so that the expression for a key is compiled once.
    """
    k, places = edits + 1, []
    for delta in range(edits + 1):
        for i in range(k):
            low, high = max(-i, delta - (edits - i)), min(i, delta + (edits - i))
            places += [F.struct(F.lit(delta).alias("delta"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for shift in range(low, high + 1) if (delta == 0 and shift == 0) == index]
    rows = lines.select("h", "line", "n", F.inline(F.array(*places))).withColumn("m", F.col("n") - F.col("delta"))
    part = F.expr(f"substring(line, cast(i * m div {k} as int) + 1 + shift, cast((i + 1) * m div {k} - i * m div {k} as int))")
    return rows.select("h", F.xxhash64("i", "m", part).alias("key"))


def histogram(line: Column) -> Column:
    """How many characters of each class a line has: one edit changes two counts by one each at most."""
    n = F.char_length(line)
    return F.array(*[n - F.char_length(F.translate(line, letters, "")) for letters in CLASSES])


def _near(c: str, d: str, edits: int) -> Column:
    """Whether histograms are so close that the lines may be."""
    apart = sum((F.abs(F.col(c)[i] - F.col(d)[i]) for i in range(1, len(CLASSES))), F.abs(F.col(c)[0] - F.col(d)[0]))
    return apart <= 2 * edits


def within_edits(s: Column, t: Column, edits: int) -> Column:
    """Whether the edit distance of ``s`` and ``t`` is ``edits`` at most. What they have in common at both ends is left out first.

    Hyyrö's bit-parallel algorithm on the band of 2 * edits + 1 diagonals: for each character of the shorter string, bit b tells whether it equals the
    longer one's b-th character of the band; vertical differences of +1 and -1 are two numbers; the distance is followed along
    the lowest diagonal to the last row, and along that row to its end.
    """
    width, pad = 2 * edits + 1, F.lit(b"\xff" * 4 * edits)
    mask, top = (1 << width) - 1, width - 1
    swap = F.char_length(s) < F.char_length(t)
    # four bytes a character, so that the n-th is found without counting
    long, short = F.encode(F.when(swap, t).otherwise(s), "UTF-32"), F.encode(F.when(swap, s).otherwise(t), "UTF-32")
    n, m = ((F.octet_length(x) / 4).cast("int") for x in (long, short))
    inputs = F.struct(long.alias("long"), short.alias("short"), n.alias("n"), m.alias("m"))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(17))])

    def let(value: Column, body) -> Column:
        """``body`` of ``value``, computed once."""
        return F.transform(F.array(value), body)[0]

    def part(x: Column, at, k) -> Column:
        return F.substring(x, at * 4 + 1, k * 4)

    def head(x: Column) -> Column:
        """``x`` and how many characters both begin with, by binary search (less than 2**17 of them)."""

        def longer(k: Column, step: Column) -> Column:
            more = k + step
            return F.when((more <= x["m"]) & (part(x["long"], k, step) == part(x["short"], k, step)), more).otherwise(k)

        return F.struct(*[x[c].alias(c) for c in ("long", "short", "n", "m")], F.aggregate(steps, F.lit(0), longer).alias("head"))

    def middle(x: Column) -> Column:
        """What is left without the common beginning and end."""

        def longer(k: Column, step: Column) -> Column:
            more = k + step
            return F.when((more <= x["m"] - x["head"]) & (part(x["long"], x["n"] - more, step) == part(x["short"], x["m"] - more, step)), more).otherwise(k)

        def cut(tail: Column) -> Column:
            n, m = x["n"] - x["head"] - tail, x["m"] - x["head"] - tail
            return F.struct(F.concat(pad, part(x["long"], x["head"], n)).alias("long"), part(x["short"], x["head"], m).alias("short"), n.alias("n"), m.alias("m"))

        return let(F.aggregate(steps, F.lit(0), longer), cut)

    def near(x: Column) -> Column:
        def equal(i: Column) -> Column:
            c = F.substring(x["short"], i * 4 + 1, F.lit(4))
            bits = [F.when(F.substring(x["long"], (i + b) * 4 + 1, F.lit(4)) == c, 1 << b).otherwise(0) for b in range(width)]
            return F.struct(i.alias("i"), sum(bits[1:], bits[0]).alias("eq"))

        def step(at: Column, p: Column) -> Column:
            vp, vn, eq = at["vp"], at["vn"], p["eq"]
            d0 = ((eq.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(F.lit(mask))

            def moved(d: Column) -> Column:
                hp, hn = vn.bitwiseOR(F.lit(mask).bitwiseXOR(d.bitwiseOR(vp))), d.bitwiseAND(vp)
                down = p["i"] - x["n"] + edits  # how far the last row has been followed; below 0 the diagonal still is
                bit = lambda v, k: F.call_function("shiftright", v, k).bitwiseAND(F.lit(1))
                change = F.when(down < 0, 1 - bit(d, F.lit(top))).otherwise(bit(hp, top - 1 - down) - bit(hn, top - 1 - down))
                half = F.call_function("shiftright", d, F.lit(1))
                return F.struct(hn.bitwiseOR(F.lit(mask).bitwiseXOR(half.bitwiseOR(hp))).alias("vp"), half.bitwiseAND(hp).alias("vn"), (at["dist"] + change).alias("dist"))

            return let(d0, moved)

        first = F.struct(F.lit(mask & ~((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("dist"))
        rows = F.transform(F.sequence(F.lit(0), x["m"] - 1), equal)
        return F.when(x["n"] <= edits, True).when((x["n"] - x["m"] > edits) | (x["m"] == 0), False).otherwise(F.aggregate(rows, first, step)["dist"] <= edits)

    return let(let(let(inputs, head), middle), near)


def lines_of(docs: DataFrame, id_col: str, text_col: str, min_chars: int, short: bool) -> DataFrame:
    """(doc, row: a hash of the text, pos, line, n, id: 128 bits as two hashes, h: the first of them) of the lines that are long enough, and of the ``short`` ones that are not blank."""
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col).cast("string")).alias("row"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("pos", "line"))
    counts = F.char_length("line") >= min_chars
    rows = rows.where(counts | F.col("line").rlike(r"(?U)\S") if short else counts).withColumn("h", F.xxhash64("line"))
    return rows.withColumn("n", F.char_length("line")).withColumn("id", F.struct("h", F.xxhash64(F.lit(7), "line").alias("g")))


def line_classes(lines: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """(id, first: struct of the class's first occurrence) of every line whose class has more than one occurrence, written in the shared folder; lines under ``min_chars`` link with equal ones only."""
    at = F.struct(F.col("doc").isNull().alias("no"), F.col("doc"), F.col("row"), F.col("pos"))
    known = materialize(lines.groupBy("id", "h").agg(F.min(at).alias("first"), F.count("*").alias("times")), "lines")
    lines = lines.where(F.col("n") >= min_chars)
    # a line that occurs once needs no grouping; those that may occur often come together
    marked = within(lines.select("line", "n", "id", "h"), bitmap(known.where("times > 1")))
    each = marked.where(~F.col("__in")).unionByName(marked.where("__in").dropDuplicates(["id", "h"])).select("line", "n", "id", "h")
    each = materialize(each, "each")
    index = line_keys(each, edits, True)
    probes = within(line_keys(each, edits, False).select("h", F.col("key").alias("k"), F.col("key").alias("h2")).withColumnsRenamed({"h": "line", "h2": "h"}), bitmap(index.select(F.col("key").alias("h"))))
    probes = probes.where("__in").select(F.col("line").alias("h"), F.col("k").alias("key"))
    keyed = materialize(index.withColumn("index", F.lit(True)).unionByName(probes.withColumn("index", F.lit(False))), "keys")
    # keys that an indexed line and another share; the hub is the key's least indexed line
    hubs = keyed.groupBy("key").agg(F.min(F.when(F.col("index"), F.col("h"))).alias("hub"), F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high AND hub IS NOT NULL")
    shared = materialize(keyed.join(hubs.select("key", "hub"), "key"), "shared")
    texts = within(each.select("line", "id", "h"), bitmap(shared)).where("__in")
    texts = texts.join(shared.select("h").distinct(), "h", "left_semi").select("line", "id", "h", histogram(F.col("line")).alias("counts"))
    texts = materialize(texts, "candidates")
    discard(each, keyed)

    def linked(pairs: DataFrame) -> DataFrame:
        """(a, b): ids of the pairs (x, y) that are close; the histograms are asked first."""
        x = texts.select(F.col("h").alias("x"), F.col("line").alias("s"), F.col("id").alias("a"), F.col("counts").alias("c"))
        y = texts.select(F.col("h").alias("y"), F.col("line").alias("t"), F.col("id").alias("b"), F.col("counts").alias("d"))
        both = pairs.join(x, "x").join(y, "y").where(_near("c", "d", edits))
        return both.where(within_edits(F.col("s"), F.col("t"), edits)).select("a", "b")

    # first every line with its hub, then, across the components that this leaves, all lines of a key
    star = shared.where("h <> hub").select(F.least("h", "hub").alias("x"), F.greatest("h", "hub").alias("y")).distinct()
    first = components(linked(star))
    label = first.select(F.col("node.h").alias("h"), F.col("label").alias("part"))
    left = shared.drop("hub").join(texts.select("h", "id", "counts"), "h").join(label, "h", "left").withColumn("part", F.coalesce("part", "id"))
    left = materialize(left.select("key", "h", "index", "counts", "part"), "parts")
    open_keys = left.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
    left = left.join(open_keys, "key")
    own = left.where("index").select("key", F.col("h").alias("g"), F.col("counts").alias("c"), F.col("part").alias("p"))
    met = own.join(left.select("key", "h", F.col("counts").alias("d"), F.col("part").alias("q")), "key").where((F.col("p") != F.col("q")) & _near("c", "d", edits))
    rest = met.select(F.least("g", "h").alias("x"), F.greatest("g", "h").alias("y")).distinct()
    rest = materialize(rest, "pairs")
    labels = components(materialize(first.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(linked(rest)), "links"))
    named = known.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    classes = named.groupBy("label").agg(F.min("first").alias("first"), F.sum("times").alias("times")).where("times > 1").select("label", "first")
    return materialize(named.join(classes.withColumnRenamed("first", "kept"), "label").select("id", "h", F.col("kept").alias("first")), "classes")


def deduplicate_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """``docs`` with the text less its repeated lines, and n_lines, n_removed (longs).

    Lines end with a line feed and have ``min_chars`` characters at least to count; two link when at most ``edits`` insertions, deletions and
    substitutions of characters apart. With ``short``, shorter lines that are not blank count too, and link with equal ones. Of each connected class the line that is first by (id, place in the text) stays. A null
    text stays null, with no lines; a null id comes last; rows with equal ids go by a hash of the text, and rows equal in both are one document;
    other columns stay, but columns named like the results are replaced; an empty table gives an empty result.
    """
    if min_chars < edits + 1:
        raise ValueError("a line needs a character for each segment")
    docs = docs.drop("n_lines", "n_removed")
    lines = lines_of(docs, id_col, text_col, min_chars, short)
    classes = line_classes(lines, edits, min_chars)
    found = within(lines.select("doc", "row", "pos", "id", "h"), bitmap(classes)).where("__in").drop("__in", "h")
    found = found.join(classes.drop("h"), "id")
    first = (F.col("first.doc").eqNullSafe(F.col("doc"))) & (F.col("first.row") == F.col("row")) & (F.col("first.pos") == F.col("pos"))
    gone = found.where(~first).groupBy("doc", "row").agg(F.collect_set("pos").alias("gone"))
    # the columns of the documents stand in a struct of their own, so that none can meet a working column
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = own.withColumn("hash", F.xxhash64("text")).join(gone, F.col("id").eqNullSafe(F.col("doc")) & (F.col("hash") == F.col("row")), "left")
    parts = F.split("text", "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    # the text is split once, not once a line
    kept = F.transform(F.array(parts), lambda lines: F.array_join(F.transform(places, lambda i: F.element_at(lines, i + 1)), "\n"))[0]
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept)
    removed = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    counts = [F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(removed).cast("long").alias("n_removed")]
    return out.select(*[text.alias(c) if c == text_col else F.col("own").getField(c).alias(c) for c in docs.columns], *counts)

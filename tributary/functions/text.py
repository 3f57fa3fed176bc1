"""Text functions on columns, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from . import udfs


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: The white space that is left out at the ends of texts.
WHITE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def stripped(x: str | Column) -> Column:
    """Without white space of any kind (not blanks alone) at both ends."""
    return F.trim(_c(x), F.lit(WHITE))


def slug(x: str | Column) -> Column:
    """Lower case, runs of anything but letters and digits as '-', none at the ends; null where nothing is left. Give NFKC text (``udfs.nfkc``) where it may not be."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(stripped(x)), r"[^\p{L}\p{N}]+", "-"), "^-|-$", ""), F.lit(""))


def interest_label(x: str | Column) -> Column:
    """NFKC, white space collapsed and left out at the ends, lower case."""
    return F.lower(F.trim(F.regexp_replace(udfs.nfkc(_c(x)), f"[{WHITE}]+", " ")))


def clean_labels(x: str | Column, most: int = 200) -> Column:
    """Trimmed labels of 1 to ``most`` characters, of equal ones (by NFKC and lower case) the first spelling."""
    ok = F.filter(F.transform(_c(x), stripped), lambda v: (F.char_length(v) >= 1) & (F.char_length(v) <= most))
    return udfs.first_spellings(ok)


def utf8_head(x: str | Column, n: int) -> Column:
    """The first ``n`` bytes of UTF-8, less the character that they cut; replacement characters of the text's own stay."""
    b = F.encode(_c(x), "UTF-8")
    begun = F.regexp_extract(F.hex(F.substring(b, max(1, n - 2), min(n, 3))), "([C-F][0-9A-F](?:[89AB][0-9A-F])*)$", 1)
    cut = F.hex(F.substring(b, n + 1, 1)).rlike("^[89AB]")
    return F.substring(b, F.lit(1), n - F.when(cut, F.char_length(begun) / 2).otherwise(0).cast("int")).cast("string")


def utf8_prefix(x: str | Column, n: Column) -> Column:
    """The first ``n`` bytes of UTF-8, less the character that they cut; ``n`` is a column."""
    b, n = F.encode(_c(x), "UTF-8"), n.cast("int")
    # a character's bytes after its first are 80 to BF; it has three of them at most
    whole = lambda k: ~F.hex(F.substring(b, n - k + 1, F.lit(1))).rlike("^[89AB]")
    end = F.when(whole(0), n).when(whole(1), n - 1).when(whole(2), n - 2).otherwise(n - 3)
    return F.when(n >= F.octet_length(b), _c(x)).otherwise(F.substring(b, F.lit(1), F.greatest(end, F.lit(0))).cast("string"))


def utf8_tail(x: str | Column, n: int) -> Column:
    """The last ``n`` bytes of UTF-8, less the rest of the character that they cut."""
    b = F.encode(_c(x), "UTF-8")
    first = F.greatest(F.lit(1), F.octet_length(b) - n + 1)
    rest = F.regexp_extract(F.hex(F.substring(b, first, F.lit(min(n, 3)))), "^((?:[89AB][0-9A-F])*)", 1)
    return F.substring(b, first + (F.char_length(rest) / 2).cast("int"), F.lit(n)).cast("string")


def compact(title: str | Column, text: str | Column, evidence: str | Column, long_bytes: int = 8000, end_bytes: int = 2000) -> Column:
    """A long text as its title, evidence and both ends; without evidence as its ends with [...] between."""
    t = _c(text)
    whole = F.octet_length(t) <= long_bytes
    found = F.slice(F.coalesce(_c(evidence), F.array().cast("array<string>")), 1, 3)
    parts = F.concat_ws("\n", _c(title), F.array_join(found, "\n"), utf8_head(t, end_bytes), utf8_tail(t, end_bytes))
    plain = F.concat(utf8_head(t, end_bytes), F.lit("\n[...]\n"), utf8_tail(t, end_bytes))
    return F.when(whole, t).when(F.size(found) > 0, parts).otherwise(plain)


def evidence(candidates: str | Column, source: str | Column, most_bytes: int = 400, most: int = 3) -> Column:
    """Candidates that the source has word for word: trimmed, of 1 to ``most_bytes`` bytes, each once, ``most`` at most."""
    s = _c(source)
    ok = F.filter(F.transform(_c(candidates), stripped), lambda v: (v != "") & (F.octet_length(v) <= most_bytes) & s.contains(v))
    return F.slice(F.array_distinct(ok), 1, most)


def first_text(*columns: str | Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.when(stripped(c) != "", _c(c)) for c in columns])


def boilerplate(x: str | Column) -> Column:
    """Line feeds only, no blanks at the ends of lines, no empty lines at either end."""
    lines = F.regexp_replace(F.regexp_replace(_c(x), "\r\n?", "\n"), "[ \t]+(\n|$)", "$1")
    return F.regexp_replace(F.regexp_replace(lines, "^\n+", ""), "\n+$", "")


def safe_key(x: str | Column) -> Column:
    return F.regexp_replace(_c(x), "[^a-zA-Z0-9_-]", "_")


def feed_name(x: str | Column, most: int = 160) -> Column:
    """Control characters as blanks, blanks collapsed, cut at ``most`` characters."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(_c(x), r"[\x00-\x1F\x7F]", " "), r"\s+", " ")), 1, most)


#: Controls of the direction of writing.
BIDI = "[\\u061C\\u200E\\u200F\\u202A-\\u202E\\u2066-\\u2069]"


def markdown(x: str | Column) -> Column:
    """Markdown's special characters escaped, bidirectional controls removed."""
    return F.regexp_replace(F.regexp_replace(_c(x), "[\\u202A-\\u202E\\u2066-\\u2069]", ""), r"([\\`*_{}\[\]()#+\-.!|>~])", r"\\$1")


#: Patterns of secrets and what stands for them, applied in this order.
SECRETS = (
    (r"-----BEGIN [^-]*PRIVATE KEY-----[\s\S]*?-----END [^-]*PRIVATE KEY-----", "[REDACTED]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]"),
    (r"\b(?:sk[-_]|xai-)[A-Za-z0-9_-]+\b", "[REDACTED]"),
    (r"\bAIza[A-Za-z0-9_-]+\b", "[REDACTED]"),
    (r"\bgsk_[A-Za-z0-9_-]+\b", "[REDACTED]"),
    (r"""(?i)(\bcookie\b["']?\s*[:=]\s*)(?:"[^"]*"|'[^']*'|[^\r\n]+)""", "$1[REDACTED]"),
    (r"""(?i)(\b(?:api[_-]?key|auth[_-]?token|ct0|pin)\b["']?\s*[:=]\s*)(?:"[^"]*"|'[^']*'|[^;\s,}\]]+)""", "$1[REDACTED]"),
    (r"(?i)([a-z][a-z0-9+.-]*://)[^/\s@]+@", "$1[REDACTED]@"),
)


def redact(x: str | Column, most: int = 500) -> Column:
    """Secrets replaced; what follows a line with params: goes first; a longer message is cut to ``most`` characters, the last three of them dots."""
    out = F.substring_index(_c(x), "\nparams:", 1)
    for pattern, stand_in in SECRETS:
        out = F.regexp_replace(out, pattern, stand_in)
    return F.when(F.char_length(out) > most, F.concat(F.substring(out, 1, most - 3), F.lit("..."))).otherwise(out)


def cleaned_json(x: str | Column) -> Column:
    """A model's answer as JSON: without its <think> parts, of a code fence what stands in it, trimmed and repaired; null where nothing makes it JSON, or nothing is left."""
    bare = stripped(F.regexp_replace(_c(x), r"(?i)<think>[\s\S]*?</think>", ""))
    fence = r"```(?:json)?\s*([\s\S]*?)```"
    inner = F.when(bare.rlike(fence), stripped(F.regexp_extract(bare, fence, 1))).otherwise(bare)
    return udfs.repaired_json(F.nullif(inner, F.lit("")))


def compact_count(x: str | Column) -> Column:
    """1.2K, 3,4M, 5B or 12,345 as a whole number; null for anything else."""
    t = F.upper(F.trim(_c(x)))
    scaled, plain = t.rlike(r"^\d[\d.,]*[KMB]$"), t.rlike(r"^\d[\d.,]*$")
    number = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[KMB]$", ""), ",", "."), r"\.(?=.*\.)", "")
    unit = F.when(t.endswith("K"), 1_000).when(t.endswith("M"), 1_000_000).otherwise(1_000_000_000)
    return F.when(scaled, F.round(number.try_cast("decimal(20,4)") * unit, 0).cast("long")).when(plain, F.regexp_replace(t, "[.,]", "").try_cast("long"))


def _by_name(value: Column, kind: DataType) -> Column:
    """The value with the fields of its structs and the keys of its maps in alphabetical order (of a letter's two cases, the small one first)."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: (f.name.lower(), f.name.swapcase()))
        return F.when(value.isNotNull(), F.struct(*[_by_name(value.getField(f.name), f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda v: _by_name(v, kind.elementType))
    if isinstance(kind, MapType):
        order = lambda a, b: F.when(F.lower(a) < F.lower(b), -1).when(F.lower(a) > F.lower(b), 1).when(a > b, -1).when(a < b, 1).otherwise(0)
        keys = F.array_sort(F.map_keys(value), order)
        return F.map_from_arrays(keys, F.transform(keys, lambda k: _by_name(value[k], kind.valueType)))
    return value


def canonical_json(df: DataFrame, *columns: str | Column) -> Column:
    """One JSON object of the columns: names in alphabetical order at every depth, nulls kept."""
    schema = df.select(*columns).schema
    named = F.struct(*[_c(c).alias(f.name) for c, f in zip(columns, schema.fields, strict=True)])
    return F.to_json(_by_name(named, schema), {"ignoreNullFields": "false"})


def fingerprint(df: DataFrame, *columns: str | Column) -> Column:
    """SHA-256 of the canonical JSON of the columns: the order in which they are given, or their structs were built, doesn't count."""
    return F.sha2(canonical_json(df, *columns), 256)


def identity_parts(kind: str | Column, date: str | Column, author: str | Column, text: str | Column, location: str | Column, occurrence: str | Column | None = None, viewer: str | Column | None = None) -> Column:
    """JSON array of what tells a message without an id; the occurrence where it isn't null, and "viewer" where ``viewer`` is true, come last."""
    part = lambda c: F.regexp_replace(F.to_json(F.array(_c(c))), r"^\[|\]$", "")
    more = [] if occurrence is None else [F.when(_c(occurrence).isNotNull(), part(occurrence))]
    more += [] if viewer is None else [F.when(_c(viewer), F.lit('"viewer"'))]
    return F.concat(F.lit("["), F.concat_ws(",", *[part(c) for c in (kind, date, author, text, location)], *more), F.lit("]"))


def fallback_identity(*parts: str | Column, **more: str | Column) -> Column:
    """``fallback:`` and the SHA-256 of ``identity_parts``."""
    return F.concat(F.lit("fallback:"), F.sha2(identity_parts(*parts, **more), 256))


def duration(seconds: Column) -> Column:
    """1h 2m 3s, without leading zero parts."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    part = lambda v, u: F.concat(v.cast("long").cast("string"), F.lit(u))
    return F.when(h > 0, F.concat_ws(" ", part(h, "h"), part(m, "m"), part(s, "s"))).when(m > 0, F.concat_ws(" ", part(m, "m"), part(s, "s"))).otherwise(part(s, "s"))


def backoff_ms(attempt: Column, base_ms: int, retry_after_s: Column | None = None, most_s: int = 30) -> Column:
    """2^attempt times the base, or the server's wish, which counts up to ``most_s`` seconds."""
    own = F.lit(base_ms).cast("long") * F.pow(F.lit(2), attempt).cast("long")
    return own if retry_after_s is None else F.coalesce(F.least(retry_after_s, F.lit(most_s)).cast("long") * 1000, own)

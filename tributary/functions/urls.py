"""URL functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scheme and host (with a port), path, query: the parts of a URL without its fragment.
_PARTS = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#\s]+)([^?#\s]*)(\?[^#\s]*)?(?:#.*)?$"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalized(x: str | Column) -> Column:
    """Without fragment, host in lower case, path without a slash at its end (the root keeps its own); null for what is no URL."""
    u = F.trim(_c(x))
    host, path, query = (F.regexp_extract(u, _PARTS, i) for i in (1, 2, 3))
    path = F.when(path == "", "/").when(F.char_length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    return F.when(u.rlike(_PARTS), F.concat(F.lower(host), path, query))


def safe(x: str | Column) -> Column:
    """http and https only, with > escaped; null for others."""
    u = F.trim(_c(x))
    return F.when(u.rlike("^https?://"), F.replace(u, F.lit(">"), F.lit("%3E")))


def publication_origin(x: str | Column, most: int = 2048) -> Column:
    """The https origin of a publication; null with credentials, a port, an IP address or a local host, or where it is too long."""
    u = F.trim(_c(x))
    host = F.lower(F.regexp_extract(u, r"^https?://([^/?#\s]+)", 1))
    bad = host.rlike(r"[@:\[]") | host.rlike(r"^\d+(\.\d+){3}$") | host.rlike(r"^(localhost|.*\.local|.*\.localhost)$") | (host == "") | ~host.contains(".")
    return F.when((F.char_length(u) <= most) & ~bad, F.concat(F.lit("https://"), host))


def status_id(x: str | Column) -> Column:
    return F.nullif(F.regexp_extract(_c(x), r"/status/(\d+)", 1), F.lit(""))


def host(x: str | Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(_c(x), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:\s]+)", 1)), F.lit(""))


#: Forms of a target's address and of its feed's id, and conversation ids that name pages of control.
TARGET_URL = r"^https://x\.com/(?:home|i/lists/([1-9]\d{0,31})|i/chat/([A-Za-z0-9][A-Za-z0-9_-]{0,127}))\z"
TARGET_FEED = r"^x:(?:following|list:([1-9]\d{0,31})|chat:([A-Za-z0-9][A-Za-z0-9_-]{0,127}))\z"
RESERVED_CHATS = ("compose", "new", "requests", "search", "settings")


def _target(x: Column, pattern: str) -> Column:
    number, chat = (F.regexp_extract(x, pattern, i) for i in (1, 2))
    kind = F.when(number != "", "list").when(chat != "", "chat").otherwise("following")
    ok = x.rlike(pattern) & ~F.lower(chat).isin(*RESERVED_CHATS)
    return F.when(ok, F.struct(kind.alias("kind"), F.nullif(F.concat(number, chat), F.lit("")).alias("id")))


def target(x: str | Column) -> Column:
    """(kind, id) of a target's exact address: following (no id), list or chat; null for anything else and for reserved paths."""
    return _target(_c(x), TARGET_URL)


def feed_target(x: str | Column) -> Column:
    """(kind, id) of a target's feed id; null for what is none."""
    return _target(_c(x), TARGET_FEED)


def target_url(t: Column) -> Column:
    k = t.getField("kind")
    return F.when(k == "following", "https://x.com/home").when(k == "list", F.concat(F.lit("https://x.com/i/lists/"), t.getField("id"))).when(k == "chat", F.concat(F.lit("https://x.com/i/chat/"), t.getField("id")))


def target_feed(t: Column) -> Column:
    k = t.getField("kind")
    return F.when(k == "following", "x:following").otherwise(F.concat(F.lit("x:"), k, F.lit(":"), t.getField("id")))


def link_target(href: str | Column) -> Column:
    """(kind, id) of a link as a page has it: control characters and other origins are refused, a path stands on the origin, query and fragment don't count."""
    u = _c(href)
    whole = F.when(u.rlike("^/(?!/)"), F.concat(F.lit("https://x.com"), u)).when(u.rlike("(?i)^https://x[.]com(?::443)?(?:[/?#]|$)"), F.regexp_replace(u, "(?i)^https://x[.]com(?::443)?", "https://x.com"))
    return F.when(~u.rlike(r"[\x00-\x1f\x7f]"), target(F.regexp_replace(whole, "[?#][\\s\\S]*$", "")))

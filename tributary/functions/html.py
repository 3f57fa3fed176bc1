"""Posts out of HTML: pages become element trees in Arrow batches, and each post's parts are found in its own subtree, in document order."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that end a line where a text's lines count.
BLOCK = {"p", "div", "br", "li", "ul", "tr", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6"}


class Element:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element | str] = []

    def elements(self) -> Iterator[Element]:
        """All elements below, in document order."""
        held = [c for c in reversed(self.children) if isinstance(c, Element)]
        while held:
            e = held.pop()
            yield e
            held += [c for c in reversed(e.children) if isinstance(c, Element)]

    def first(self, test: Callable[[Element], bool]) -> Element | None:
        return next((e for e in self.elements() if test(e)), None)

    def text(self, line: str = "") -> str:
        """The text below, scripts and styles left out, with ``line`` around blocks."""
        out: list[str] = []
        held: list[Element | str] = [self]
        while held:
            x = held.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in ("script", "style"):
                ends = [line] if line and x.tag in BLOCK else []
                held += [*ends, *reversed(x.children), *ends]
        return "".join(out)


class Tree(HTMLParser):
    """The element tree of a page, of a broken one too: an end tag closes up to its element, if that is open; what isn't closed ends with the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(e)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Element(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        e = self.at
        while e is not None and e.tag != tag:
            e = e.parent
        if e is not None and e.parent is not None:
            self.at = e.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str) -> Element:
    parser = Tree()
    parser.feed(html)
    parser.close()
    return parser.root


def _has(name: str, *values: str) -> Callable[[Element], bool]:
    return lambda e: e.attrs.get(name) in values


#: What a post and its parts are marked with.
POST = ("article", "tweet")
TEXT, NAME = _has("data-testid", "tweetText"), _has("data-testid", "User-Name")
COUNTS = {
    "replies": _has("data-testid", "reply"),
    "reposts": _has("data-testid", "retweet", "unretweet"),
    "likes": _has("data-testid", "like", "unlike"),
    "views": lambda e: (e.tag == "a" and "/analytics" in e.attrs.get("href", "")) or "view" in e.attrs.get("aria-label", "").lower(),
}
ORIGIN = "https://x.com"
STATUS = re.compile(r"/(?:([A-Za-z0-9_]{1,15})|i/web)/status/([1-9][0-9]{0,31})(?:/.*)?")
HANDLE = re.compile(r"/([A-Za-z0-9_]{1,15})")
COUNT = re.compile(r"(\d[\d.,]*)\s*([KMBkmb])?")


def _plain(e: Element | None) -> str:
    return " ".join(e.text(" ").split()) if e else ""


def _count(e: Element | None) -> int | None:
    """The first number of an element's label or text; with K, M or B a decimal (the last point counts), else digits with marks between them."""
    m = COUNT.search(f"{e.attrs.get('aria-label', '')} {_plain(e)}") if e else None
    if not m:
        return None
    digits, unit = m[1], (m[2] or "").upper()
    if not unit:
        return int(re.sub("[.,]", "", digits))
    whole, _, part = digits.replace(",", ".").rstrip(".").rpartition(".")
    number = f"{whole.replace('.', '')}.{part}" if whole else part
    return int(float(number) * {"K": 1_000, "M": 1_000_000, "B": 1_000_000_000}[unit] + 0.5)


def _status(post: Element) -> tuple[str | None, str | None]:
    for e in post.elements():
        href = e.attrs.get("href", "") if e.tag == "a" else ""
        if "/status/" not in href:
            continue
        path = href[len(ORIGIN) :] if href.startswith(ORIGIN + "/") else href
        m = STATUS.fullmatch(re.split("[?#]", path)[0]) if path.startswith("/") and not path.startswith("//") else None
        if m:
            return m[2], f"{ORIGIN}/{m[1] or 'i/web'}/status/{m[2]}"
    return None, None


def _author(post: Element) -> str | None:
    name = post.first(NAME)
    if name is None:
        return None
    for e in name.elements():
        m = HANDLE.fullmatch(e.attrs.get("href", "")) if e.tag == "a" else None
        if m:
            return f"@{m[1]}"
    lines = [" ".join(line.split()) for line in name.text("\n").split("\n")]
    lines = [line for line in lines if line]
    return next((line for line in lines if line.startswith("@")), lines[0] if lines else None)


def _date(post: Element) -> int | None:
    e = post.first(lambda e: e.tag == "time" and "datetime" in e.attrs)
    try:
        at = datetime.fromisoformat(e.attrs["datetime"]) if e else None
    except ValueError:
        return None
    if at is None:
        return None
    return round((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def extracted(html: str) -> list[dict]:
    out = []
    for post in tree(html).elements():
        if post.tag != POST[0] or post.attrs.get("data-testid") != POST[1]:
            continue
        number, url = _status(post)
        counts = {name: _count(post.first(test)) for name, test in COUNTS.items()}
        out.append({"id": number, "date_ms": _date(post), "text": _plain(post.first(TEXT)), "author": _author(post), "url": url, **counts})
    return out


FIELDS = {"id": StringType(), "date_ms": LongType(), "text": StringType(), "author": StringType(), "url": StringType(), **{name: LongType() for name in COUNTS}}


@F.pandas_udf(ArrayType(StructType([StructField(*f) for f in FIELDS.items()])))
def posts(x: pd.Series) -> pd.Series:
    """The posts of a page in document order, those quoted inside another too; null for null. A post's parts are the first in its subtree: of one that quotes another, its own come first."""
    return x.map(lambda html: None if html is None else extracted(html))

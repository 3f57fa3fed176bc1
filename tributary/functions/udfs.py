"""What built-in expressions can't do: Arrow-batched UDFs of the standard library."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType

#: Rows of an Arrow batch that are Python objects at once.
ROWS = 64


def _by_rows(kind: DataType) -> Callable:
    """A function of one value as an Arrow UDF; nulls stay. Only ROWS values are Python objects at any time, whatever Spark puts in a batch."""
    rows = ROWS

    def of(f: Callable) -> Callable:
        def run(x: pa.Array) -> pa.Array:
            done = [pa.array([None if v is None else f(v) for v in x.slice(a, rows).to_pylist()], x.type) for a in range(0, len(x), rows)]
            return pa.concat_arrays(done) if done else x

        return F.arrow_udf(run, kind)

    return of


@_by_rows(StringType())
def nfkc(text):
    import unicodedata

    return text if text.isascii() else unicodedata.normalize("NFKC", text)


@_by_rows(ArrayType(StringType()))
def first_spellings(texts):
    """Of an array's texts that are equal by NFKC and lower case the first, in order; null texts go."""
    import unicodedata

    found: dict = {}
    for t in texts:
        if t is not None:
            found.setdefault((t if t.isascii() else unicodedata.normalize("NFKC", t)).lower(), t)
    return list(found.values())


def _repaired(text: str | None) -> str | None:
    """``text`` as JSON, or None where no repair makes it so: quotes of either kind, keys and words without quotes, comments, commas too many, and what is still open at the end closed."""
    import json
    import re

    if text is None:
        return None
    try:
        json.loads(text)
        return text
    except ValueError:
        pass
    words = {"true": "true", "false": "false", "null": "null", "True": "true", "False": "false", "None": "null", "undefined": "null"}
    out, open_, i = [], [], 0

    def no_comma() -> None:
        while out and (out[-1] == "," or out[-1].isspace()):
            out.pop()
        if out and out[-1] == ":":
            out.append("null")

    while i < len(text):
        c = text[i]
        if c in "\"'":
            j, part = i + 1, []
            while j < len(text) and text[j] != c:
                if text[j] == "\\" and j + 1 < len(text):
                    part.append(text[j + 1] if text[j + 1] == "'" else text[j : j + 2])
                    j += 2
                else:
                    part.append('\\"' if text[j] == '"' else text[j])
                    j += 1
            out.append('"' + re.sub(r"[\x00-\x1f]", lambda m: json.dumps(m[0])[1:-1], "".join(part)) + '"')
            i = j + 1
        elif c in "{[":
            out.append(c)
            open_.append("}" if c == "{" else "]")
            i += 1
        elif c in "}]":
            if c in open_:
                while True:
                    no_comma()
                    last = open_.pop()
                    out.append(last)
                    if last == c:
                        break
            i += 1
        elif text.startswith(("//", "/*"), i):
            end = text.find("\n" if text[i + 1] == "/" else "*/", i + 2)
            i = len(text) if end < 0 else end + (1 if text[i + 1] == "/" else 2)
        elif c in ",:" or c.isspace():
            out.append(c)
            i += 1
        else:
            m = re.compile(r"[^\s,:{}\[\]\"']+").match(text, i)
            word = m[0]
            number = re.fullmatch(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?", word)
            out.append(words.get(word, word if number else json.dumps(word)))
            i = m.end()
    no_comma()
    while open_:
        no_comma()
        out.append(open_.pop())
    fixed = "".join(out)
    try:
        json.loads(fixed)
        return fixed
    except ValueError:
        return None


@F.pandas_udf(StringType())
def repaired_json(x: pd.Series) -> pd.Series:
    """The text as JSON where it is, or small repairs make it so; else null."""
    return x.map(_repaired)


@F.pandas_udf(ArrayType(StringType()))
def utf8_split(x: pd.Series, n: pd.Series) -> pd.Series:
    """Pieces of at most n bytes, cut between characters; an empty text is one empty piece, a character longer than n a piece of its own."""

    def pieces(text: str | None, most: int):
        if text is None:
            return None
        raw, out, a = text.encode(), [], 0
        while a < len(raw):
            b = min(len(raw), a + most)
            while b < len(raw) and raw[b] & 0xC0 == 0x80 and b > a:
                b -= 1
            if b == a:
                b = a + 1
                while b < len(raw) and raw[b] & 0xC0 == 0x80:
                    b += 1
            out.append(raw[a:b].decode())
            a = b
        return out or [""]

    return pd.Series([pieces(t, int(m)) for t, m in zip(x, n, strict=True)])


@F.pandas_udf(StringType())
def html_text(x: pd.Series) -> pd.Series:
    """Text of HTML: links' text stays, pictures, scripts and styles go, blocks end lines."""
    from html.parser import HTMLParser

    class Text(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style"):
                self.skip += 1
            elif tag in ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6"):
                self.out.append("\n")

        def handle_endtag(self, tag):
            if tag in ("script", "style") and self.skip:
                self.skip -= 1

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    def text(html):
        if html is None:
            return None
        parser = Text()
        parser.feed(html)
        parser.close()
        lines = [" ".join(line.split()) for line in "".join(parser.out).split("\n")]
        return "\n".join(line for line in lines if line)

    return x.map(text)

"""Element trees, posts and the text of HTML."""

from pyspark.sql import functions as F

from tributary.functions import html, udfs


def test_trees_of_broken_pages():
    root = html.tree("<ul><li>a<li>b</ul></p><p>c<b>d</p>e<br/>f<img src=x>g")
    assert root.text() == "abcdefg"
    assert [e.tag for e in root.elements()] == ["ul", "li", "li", "p", "b", "br", "img"]
    assert html.tree("").text() == "" and html.tree("a <script>x<y</script> b").text() == "a  b"
    deep = html.tree("<div>" * 5000 + "x" + "</div>" * 5000)
    assert deep.text() == "x" and sum(1 for _ in deep.elements()) == 5000


def test_posts():
    page = """<article data-testid="tweet"><div data-testid="User-Name"><span>Ann</span><a href="/ann_1">@ann_1</a></div>
      <a href="//x.com/z/status/5">n</a><a href="/ann_1/status/0">n</a><a href="https://x.com/ann_1/status/77?s=1"><time datetime="2024-01-01T00:00:01.500Z"></time></a>
      <div data-testid="tweetText">One &lt;b&gt;<br> two <a href="/x">three</a></div>
      <article data-testid="tweet"><div data-testid="User-Name">Bob<br>@bob</div><div data-testid="tweetText">Quoted</div><button data-testid="like">9</button></article>
      <button data-testid="like" aria-label="1.234,5K Likes"></button></article>
      <article>no post</article><article data-testid="tweet"><time datetime="soon"></time><a href="/i/web/status/8">x</a><div data-testid="User-Name"></div>"""
    a, b, c = html.extracted(page)
    assert (a["id"], a["url"], a["author"], a["text"], a["date_ms"]) == ("77", "https://x.com/ann_1/status/77", "@ann_1", "One <b> two three", 1704067201500)
    assert a["likes"] == 9 and a["replies"] is None  # the first in its subtree is the quoted post's
    assert (b["id"], b["author"], b["text"], b["likes"]) == (None, "@bob", "Quoted", 9)
    assert (c["id"], c["url"], c["author"], c["date_ms"], c["text"]) == ("8", "https://x.com/i/web/status/8", None, None, "")
    count = lambda x: html._count(html.tree(f"<i>{x}</i>"))
    assert [count(x) for x in ("1.5K", "2,5 m", "3B", "1.234.5K", "12,345", "1.234.567", "none", "7.K")] == [1500, 2_500_000, 3_000_000_000, 1_234_500, 12345, 1234567, None, 7000]


def test_columns(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, '<article data-testid="tweet">x')], "k int, h string")
    got = {r["k"]: r["p"] for r in df.select("k", html.posts("h").alias("p")).collect()}
    assert got[1] is None and got[2] == [] and len(got[3]) == 1
    cases = {
        "<p>a</p><p>b  c</p>": "a\nb c", "x<br>y<br/>z": "x\ny\nz", "<script>if (a<b) {}</script><style>p{}</style>t": "t", "<a href=x>link</a> &amp; <img alt=y>&lt;": "link & <",
        "<ul><li>1<li>2</ul>": "1\n2", "<!-- no -->yes": "yes", "<h1>T</h1>": "T", "": "", "a&nbsp;b": "a b", "<table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>": "12\n3",
    }
    found = spark.createDataFrame([(x,) for x in cases], "h string").select("h", udfs.html_text("h").alias("t")).collect()
    assert {r["h"]: r["t"] for r in found} == cases
    assert spark.createDataFrame([(None,)], "h string").select(udfs.html_text(F.col("h"))).first()[0] is None

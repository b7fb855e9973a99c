"""Markup, character references and addresses against Python's own readers and the standard's examples."""

import html
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from newsloom.functions import html as H
from newsloom.operators import rules
from newsloom.sources import tables


def run(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_references_as_python_reads_them(spark):
    r = random.Random(1)
    names = list(html.entities.html5)
    bits = ["&", "#", "x", "X", ";", " ", "<", "=", "é", "amp", "lt", "\n", "&amp;lt;", "&#", "&#x", "copy", "notit;", "0", "128", "x80"]
    one = lambda: r.choice([r.choice(bits), "&" + r.choice(names), f"&#{r.choice([r.randrange(300), r.randrange(70_000), r.randrange(1_200_000)])};", f"&#x{r.randrange(1_200_000):X}"])
    texts = ["".join(one() for _ in range(r.randrange(7))) for _ in range(3000)]
    texts += ["&" + n for n in names] + ["&" + n + "x" for n in names] + ["&" * 5, "&#99999999999999999999;", "&#xFFFFFFFFFFFFFFFF;", "&#x000000000041;", "&#0;", "&#13;", "&#xD800;", ""]
    assert run(spark, texts, H.unescape) == [html.unescape(t) for t in texts]
    assert run(spark, [None, "/p?a=1&copy=2&copy;&copyx&lt;"], lambda c: H.unescape(c, True)) == [None, "/p?a=1&copy=2©&copyx<"]


class Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links, self.metas = [], []

    def handle_starttag(self, tag, attrs):
        d = {}
        for k, v in attrs:
            d.setdefault(k, v or "")
        if tag == "a" and d.get("href", "").strip(" "):
            self.links.append(d["href"].strip(" "))
        if tag == "meta":
            self.metas.append((d.get("name", ""), d.get("property", ""), d.get("content", "").strip(" ")))


def test_tags_as_python_reads_them(spark):
    r = random.Random(2)
    values = ["x", "a > b", "it's", "&eacute;t&eacute;", 'say "no"', "/p?a=1&amp;b=2", "", "a\nb", "<i>"]

    def attr(k):
        v, q = r.choice(values), r.choice("\"'")
        if q in v:
            v = v.replace(q, "&quot;" if q == '"' else "&#39;")
        bare = "".join(c for c in v.split()[0] if c not in "<>\"'") if v.split() else ""
        return r.choice([f" {k}={q}{v}{q}", f"\n{k.upper()} = {q}{v}{q}", f" {k}={bare}" if bare else f" {k}"])

    pieces = [
        lambda: "<!-- > <a href=no> -->", lambda: "<script>var a='<a href=\"no\">';</script >", lambda: "<style>a > b</style>", lambda: "<b>text</b> 1 < 2 & 3 > 2", lambda: "<!DOCTYPE html>", lambda: "<p>",
        lambda: "<a" + "".join(attr(k) for k in r.sample(["href", "class", "title", "rel"], r.randrange(4))) + ">t</a>", lambda: "<abbr href=no>", lambda: "<>", lambda: '<a title="k" href="/one" href="/two">',
        lambda: "<META" + "".join(attr(k) for k in r.sample(["name", "property", "content", "x"], r.randrange(5))) + r.choice([">", " />"]),
    ]
    pages = ["".join(r.choice(pieces)() for _ in range(r.randrange(8))) for _ in range(800)]
    links, metas = run(spark, pages, H.links), run(spark, pages, H.meta_tags)
    for page, own, found in zip(pages, links, metas):
        reader = Reader()
        reader.feed(page)
        reader.close()
        assert own == reader.links and [(m.name, m.property, m.content) for m in found] == reader.metas, page


def test_hard_markup(spark):
    page = """<!-- <title>no</title> > --><TITLE lang='a > b'> A &amp; <b> </title><svg><title>other</title></svg><a rel="nofollow Author" title="x > y">J&oacute;se <b>P</b></a><a rel=author>no</a><time datetime='2024-03-05T&#48;0:00'>"""
    assert run(spark, [page, None, "<title>open"], H.title) == ["A & <b>", "", "open"]
    assert run(spark, [page], H.author_link) == ["Jóse P"] and run(spark, [page, ""], H.time_tag) == ["2024-03-05T00:00", ""]
    texts = {
        "<p>a</p><nav><nav>no</nav>no</nav><p>b</p>": "a\nb",
        "<nav>no</nav><article class='a>b'><p>x &lt;p&gt; y</p><aside>no</aside><article>in</article>z</article><p>no</p>": "x <p> y\nin z",
        "<p>1 < 2 & 3 > 2</p><script>if (a < b) '</p>'</script><!-- > no --><![CDATA[ > no ]]>": "1 < 2 & 3 > 2",
        "<article>open <p>to the end": "open to the end",
        "</nav><p>a<br/>b</p><header>never closed": "a\nb",
        "<title>no</title>\n<h1>Caf&eacute;</h1>\t <li>&#8364;&nbsp;5": "Café\n€\xa05",
        "": "",
    }
    assert run(spark, list(texts), H.main_text) == list(texts.values())
    deep = "<nav>" * 300 + "no" + "</nav>" * 300 + "<p>yes</p>"
    assert run(spark, [deep, None, "<" * 20_000, "<a " + "x=1 " * 30_000, "<p " + "'" * 30_000 + ">t"], H.main_text)[:2] == ["yes", ""]


EXAMPLES = """g:h = g:h|g = http://a/b/c/g|./g = http://a/b/c/g|g/ = http://a/b/c/g/|/g = http://a/g|//g = http://g|?y = http://a/b/c/d;p?y|g?y = http://a/b/c/g?y|#s = http://a/b/c/d;p?q#s
g#s = http://a/b/c/g#s|g?y#s = http://a/b/c/g?y#s|;x = http://a/b/c/;x|g;x = http://a/b/c/g;x|g;x?y#s = http://a/b/c/g;x?y#s| = http://a/b/c/d;p?q|. = http://a/b/c/|./ = http://a/b/c/|.. = http://a/b/
../ = http://a/b/|../g = http://a/b/g|../.. = http://a/|../../ = http://a/|../../g = http://a/g|../../../g = http://a/g|../../../../g = http://a/g|/./g = http://a/g|/../g = http://a/g|g. = http://a/b/c/g.
.g = http://a/b/c/.g|g.. = http://a/b/c/g..|..g = http://a/b/c/..g|./../g = http://a/b/g|./g/. = http://a/b/c/g/|g/./h = http://a/b/c/g/h|g/../h = http://a/b/c/h|g;x=1/./y = http://a/b/c/g;x=1/y
g;x=1/../y = http://a/b/c/y|g?y/./x = http://a/b/c/g?y/./x|g?y/../x = http://a/b/c/g?y/../x|g#s/./x = http://a/b/c/g#s/./x|g#s/../x = http://a/b/c/g#s/../x|http://x.org/a/../b = http://x.org/b|mailto:a/../b = mailto:a/../b"""


def test_addresses_of_the_standard(spark):
    """RFC 3986, 5.4, and two more."""
    pairs = [e.split(" = ") for line in EXAMPLES.split("\n") for e in line.split("|")]
    assert run(spark, [a for a, _ in pairs], lambda c: H.joined_url(F.lit("http://a/b/c/d;p?q"), c)) == [b for _, b in pairs]


@pytest.mark.parametrize("name", rules.shipped())
def test_both_spellings_give_one_article(spark, name):
    """Letters as they are and as references: the same rows, for each source that comes with the library."""
    s = rules.shipped_source(name)
    page = """<html><head><title>Minería en Perú: ríos de Junín</title><meta property="og:description" content="Violencia, contaminación y minería ilegal en la región de Junín, Perú"><meta name="author" content="José Ñuñez"></head><body><a href="/topics/minería/">x</a><p>á</p></body></html>"""
    spelled = page
    for a, b in {"í": "&iacute;", "ú": "&#250;", "ó": "&#xF3;", "é": "&eacute;", "Ñ": "&Ntilde;", "ñ": "&ntilde;"}.items():
        spelled = spelled.replace(a, b)
    spelled = spelled.replace("<head>", "<head><!-- > <title>no</title> --><meta name='x' content='a > b <title>no</title>'>")
    rows = [[tuple(r) for r in tables.articles(rules.parse_articles(spark.createDataFrame([(s.base + "/2024/01/x/", p)], "url string, html string"), s)).collect()] for p in (page, spelled)]
    assert rows[0] == rows[1] and len(rows[0]) == 1 and "Minería en Perú: ríos de Junín" in rows[0][0]

"""Text, label, id and date functions on small cases."""

import hashlib
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.functions import html as H
from newsloom.functions import text as X
from newsloom.functions import vocabulary as V
from newsloom.operators import places


def run(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r.o for r in df.select("i", make(F.col("c")).alias("o")).orderBy("i").collect()]


def test_accents(spark):
    words = ["Caquetá", "Bogotá", "Áb", "ñandú", None, ""]
    assert run(spark, words, X.normalised) == ["caqueta", "bogota", "ab", "nandu", "", ""]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0x24F)), min_size=1, max_size=40))
def test_accents_as_unicode(spark, values):
    want = ["".join(c for c in unicodedata.normalize("NFD", v) if unicodedata.category(c) != "Mn") for v in values]
    got = run(spark, values, X.strip_accents)
    assert got == want and run(spark, got, X.strip_accents) == got


def test_whole_words_and_order(spark):
    rules = {"first": ["para"], "second": ["una", "u.s."]}
    assert run(spark, ["una parada", "para una", "x", "the u.s.a", "perú_para"], lambda c: X.first_label(c, rules, "?")) == ["second", "first", "?", "second", "?"]
    assert run(spark, ["en caqueta", "Pará y Caquetá"], lambda c: X.first_listed(c, ["Caquetá", "Pará"])) == ["Caquetá", "Caquetá"]
    assert run(spark, [["b", "a"], []], lambda c: X.first_slug(c, {"a": "1", "b": "2"}), "array<string>") == ["1", ""]


def test_labels(spark):
    assert run(spark, ["logging_deforestation", "", None, "foo_bar", "land's_end x2y"], lambda c: X.pretty(c, V.SECTOR_LABELS)) == ["Logging / Deforestation", "Unclassified", "Unclassified", "Foo Bar", "Land'S End X2Y"]
    assert run(spark, ["a&b<c>'d\""], X.html_escape) == ["a&amp;b&lt;c&gt;&#39;d\""]


def test_ids(spark):
    assert run(spark, ["http://x/y"], lambda c: X.url_id("p", c)) == ["p:url-" + hashlib.sha1(b"http://x/y").hexdigest()[:12]]
    assert run(spark, [" Perú "], lambda c: X.conflict_id(c, F.lit("t"))) == ["CONFLICT_" + hashlib.md5("perú|t".encode()).hexdigest()[:8]]


def test_titles(spark):
    assert run(spark, ["The Mine, at Las Bambas!", "", "de la"], X.normalised_title) == ["mine bambas", "", ""]


def test_dates(spark):
    raw = ["", None, "not a date", "2024-05-06", "2024-05-06T23:30:00-05:00", "May 6, 2024", "6 May 2024", "2024-13-40"]
    assert run(spark, raw, X.iso_date) == ["", "", "not a date", "2024-05-06", "2024-05-06", "2024-05-06", "2024-05-06", "2024-13-40"]
    assert run(spark, ["Dom, 21/06/2026 - 08:00", "31/02/2026", "x", None, "1/2/2026"], X.day_month_year) == ["2026-06-21", "", "", "", "2026-02-01"]
    assert run(spark, ["es-PE", "SPanish", "pt", None], X.language_of) == ["es", "es", "en", "en"]


PAGE = """<html><head><title> A &amp; B </title><meta content='D1' name="description"><meta property="og:title" content="">
<meta name="twitter:title" content=" T "></head><body><nav>no</nav><a class="x" href="/list/gold/?a=1">g</a><a href='b.html#f'>b</a><a href="//o.org/p">o</a>
<a href="https://s.org/2024/01/x-y">x</a><article><p>One &lt;two&gt;</p><script>var a = "<p>";</script><p>Three</p></article></body></html>"""


def test_html(spark):
    assert run(spark, [PAGE, None], H.title) == ["A & B", ""]
    assert run(spark, [PAGE, ""], lambda c: H.meta(c, "og:title", "twitter:title")) == ["T", ""]
    assert run(spark, [PAGE], lambda c: H.meta(c, "description")) == ["D1"]
    links = run(spark, [PAGE], H.links)[0]
    assert links == ["/list/gold/?a=1", "b.html#f", "//o.org/p", "https://s.org/2024/01/x-y"]
    assert run(spark, links, lambda c: H.joined_url(F.lit("https://s.org/a/c.html?q"), c)) == ["https://s.org/list/gold/?a=1", "https://s.org/a/b.html#f", "https://o.org/p", "https://s.org/2024/01/x-y"]
    assert run(spark, ["https://S.org:80/a?b#c"], H.clean_url) == ["https://S.org:80/a/"] and run(spark, ["https://S.org/a"], H.host) == ["s.org"]
    assert run(spark, [PAGE], lambda c: H.slugs(c, "/list/([^/]+)/")) == [["gold"]]
    assert run(spark, [PAGE], H.main_text) == ["One <two>\nThree"]
    assert run(spark, ["a; b,,c"], H.keyword_list) == [["a", "b", "c"]]


def test_places(spark):
    assert run(spark, ["village", "state", "", None, "office"], places.address_precision) == ["town", "region", "unknown", "unknown", "office"]
    assert run(spark, ["PER.8_1", "PER.8.8_1", "PER.8.8.4_1"], places.boundary_level) == [1, 2, 3]
    q = lambda **k: places.candidate_query(*[F.lit(k.get(n)) for n in ("context", "name", "locality", "region", "country")], k.get("by", False))
    one = lambda c: tuple(spark.range(1).select(c.alias("q")).first().q)
    assert one(q(region="Cusco", country="Peru")) == ("Cusco, Peru", "region") and one(q(country="Peru")) == ("", "") and one(q(country="Peru", by=True)) == ("Peru", "country")
    assert one(q(locality="X", country="Peru")) == ("X, Peru", "specific")
    eff = lambda *a: spark.range(1).select(places.effective_precision(*map(F.lit, a)).alias("p")).first().p
    assert eff("town", "Cusco, Peru", "Peru", "Cusco") == "region" and eff("town", "Peru", "Perú", "") == "country" and eff(" Town", "Lima X", "Peru", "Lima") == "town"

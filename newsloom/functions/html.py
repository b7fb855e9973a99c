"""Reading of HTML and URLs by expressions.

A page is read as markup and the text between: comments, CDATA, declarations, whole scripts and styles, titles, and tags, whose quoted values may hold ">". Character references are
decoded once, at a single pass over the pieces between ampersands, with all of HTML's names.
"""

from __future__ import annotations

import html.entities
import json
import zlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F



def held(c: Column, use: Callable[[Column], Column]) -> Column:
    """What is made of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


# ---- character references --------------------------------------------------------------------------------------------

_BUCKETS = 2048


def _named() -> tuple[str, str]:
    """Names with their semicolon by bucket of a hash, as JSON; names that need none, as a pattern (longest first)."""
    table: list[dict[str, str]] = [{} for _ in range(_BUCKETS)]
    for name, value in html.entities.html5.items():
        if name.endswith(";"):
            table[zlib.crc32(name.encode()) % _BUCKETS][name] = value
    short = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return json.dumps(table), "|".join(short)


_NAMES, _SHORT = _named()
_SHORT_VALUES = json.dumps({n: v for n, v in html.entities.html5.items() if not n.endswith(";")})
#: What numbers of C1 controls mean: the characters that Windows-1252 has there
_C1 = {n: bytes([n]).decode("cp1252", "replace").replace("�", chr(n)) for n in range(0x80, 0xA0)} | {0: "�", 13: "\r"}
_REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};)"


def _character(number: Column) -> Column:
    """The character of a number (null: too large), as HTML has it: none for controls and non-characters, the replacement for what is no character."""
    n = F.coalesce(number, F.lit(0x110000))
    control = n.between(1, 8) | n.between(0xE, 0x1F) | n.between(0x7F, 0x9F) | n.between(0xFDD0, 0xFDEF) | (n == 0xB) | (n % 65536 >= 0xFFFE)
    c1 = F.create_map(*[F.lit(x) for kv in _C1.items() for x in kv])
    own = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.coalesce(F.when(n < 0xA0, F.try_element_at(c1, n.cast("int"))), F.when((n > 0x10FFFF) | n.between(0xD800, 0xDFFF), "�").when(control, "").otherwise(own))


def unescape(c: Column, attribute: bool = False) -> Column:
    """Character references decoded: names, decimal and hexadecimal numbers. In the value of an attribute, a name without its semicolon
    stays where a letter, a digit or "=" follows (it is part of an address)."""
    table = F.from_json(F.lit(_NAMES), "array<map<string,string>>")
    short = F.from_json(F.lit(_SHORT_VALUES), "map<string,string>")

    def decoded(p: Column, whole: Column) -> Column:
        digits = F.regexp_replace(whole, "^#[xX]?|;$", "")
        number = F.when(whole.rlike("^#[xX]"), F.conv(F.when(F.length(F.ltrim(digits, F.lit("0"))) <= 8, digits), 16, 10).cast("bigint")).otherwise(digits.try_cast("bigint"))
        name = F.regexp_extract(p, f"^({_SHORT})", 1)
        after = F.substring(p, F.length(name) + 1, F.lit(1))
        loose = name != ""
        if attribute:
            loose = loose & ~after.rlike("[A-Za-z0-9=]")
        exact = F.try_element_at(F.get(table, (F.crc32(whole.cast("binary")) % _BUCKETS).cast("int")), whole)
        rest = lambda k: F.substring(p, F.length(k) + 1, F.length(p))
        return (
            F.when(whole.startswith("#"), F.concat(_character(number), rest(whole)))
            .when(whole.endswith(";") & exact.isNotNull(), F.concat(exact, rest(whole)))
            .when(loose, F.concat(F.try_element_at(short, name), rest(name)))
            .otherwise(F.concat(F.lit("&"), p))
        )

    each = lambda p: held(F.regexp_extract(p, _REFERENCE, 1), lambda whole: decoded(p, whole))
    return held(F.split(c, "&"), lambda pieces: F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), each), "")))


# ---- markup ----------------------------------------------------------------------------------------------------------

#: What follows a tag's name; a ">" in a quoted value doesn't end the tag. Possessive, so linear in time and without a deep stack
_REST = r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+"""
_RAW = "script|style|title|textarea|iframe"
#: Comments, CDATA, declarations, elements whose content isn't markup, and tags (group 2: slash and name)
_MARK = rf"(?is)<!--(?:-?>|.*?(?:--!?>|\z))|<!\[CDATA\[.*?(?:\]\]>|\z)|<[!?][^>]*+>|<({_RAW})(?=[\s/>]){_REST}>.*?(?:</\1(?=[\s/>])[^>]*+>|\z)|<(/?[a-z][^\s/>]*+){_REST}>"


def marks(html: Column) -> Column:
    """All markup in order."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_MARK), 0)


def is_tag(mark: Column, name: str) -> Column:
    return mark.rlike(rf"(?i)^<{name}[\s/>]")


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a tag, decoded; the first of several; empty if missing."""
    inner = F.regexp_extract(tag, r"(?s)^<[A-Za-z][^\s/>]*([^>]*.*?)>$", 1)
    pieces = F.regexp_extract_all(inner, F.lit(r"""(?s)[^\s/=>]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]++))?"""), 0)
    own = F.get(F.filter(pieces, lambda p: p.rlike(rf"(?i)^{name}(\s*=|$)")), F.lit(0))
    value = F.regexp_replace(F.regexp_extract(own, r"(?s)^[^\s/=>]+\s*=\s*(.*)$", 1), r"""(?s)^"(.*)"$|^'(.*)'$""", "$1$2")
    return F.coalesce(unescape(value, True), F.lit(""))


def tags_of(found: Column, name: str) -> Column:
    """The opening tags of an element among markup."""
    return F.filter(found, lambda m: is_tag(m, name))


def tags(html: Column, name: str) -> Column:
    return tags_of(marks(html), name)


def meta_tags_of(found: Column) -> Column:
    return F.transform(tags_of(found, "meta"), lambda t: F.struct(attribute(t, "name").alias("name"), attribute(t, "property").alias("property"), F.trim(attribute(t, "content")).alias("content")))


def meta_tags(html: Column) -> Column:
    """Name, property and content of every meta tag, in order; read once for all that is asked of them."""
    return meta_tags_of(marks(html))


def meta_of(found: Column, *names: str) -> Column:
    """The first non-blank content, in order of the names; of each, the first tag with that name, or with that property if no tag has the name."""
    out = []
    for name in names:
        first = F.coalesce(F.get(F.filter(found, lambda t: t["name"] == name), F.lit(0)), F.get(F.filter(found, lambda t: t["property"] == name), F.lit(0)))
        out.append(F.nullif(first["content"], F.lit("")))
    return F.coalesce(*out, F.lit(""))


def meta(html: Column, *names: str) -> Column:
    return meta_of(meta_tags(html), *names)


def metas_of(found: Column, name: str) -> Column:
    """Non-blank contents of all tags with the property, in order."""
    return F.filter(F.transform(F.filter(found, lambda t: t["property"] == name), lambda t: t["content"]), lambda v: v != "")


def author_link(html: Column) -> Column:
    """Text of the first anchor that is marked as the author's."""
    place = lambda found, test: F.get(F.array_compact(F.transform(found, lambda m, i: F.when(test(m, i), i))), F.lit(0))

    def text(found: Column, begin: Column) -> Column:
        end = place(found, lambda m, i: (i > begin) & is_tag(m, "/a"))
        texts = F.split(F.coalesce(html, F.lit("")), _MARK)
        return F.when(begin.isNotNull(), F.array_join(F.slice(texts, begin + 2, F.coalesce(end, F.size(found)) - begin), ""))

    author = lambda m, i: is_tag(m, "a") & attribute(m, "rel").rlike(r"(?i)(^|\s)author(\s|$)")
    inside = held(marks(html), lambda found: held(place(found, author), lambda begin: text(found, begin)))
    return F.coalesce(F.trim(unescape(inside)), F.lit(""))


def time_tag(html: Column) -> Column:
    """The datetime of the first time element; empty if it has none."""
    return F.trim(F.coalesce(attribute(F.get(tags(html, "time"), F.lit(0)), "datetime"), F.lit("")))


def title_of(found: Column) -> Column:
    first = F.get(tags_of(found, "title"), F.lit(0))
    return F.coalesce(F.trim(unescape(F.regexp_extract(first, rf"(?is)^<title{_REST}>(.*?)(?:</title[^>]*+>)?\z", 1))), F.lit(""))


def title(html: Column) -> Column:
    return title_of(marks(html))


def links(html: Column) -> Column:
    """Every href of an anchor, in order."""
    return F.filter(F.transform(tags(html, "a"), lambda t: F.trim(attribute(t, "href"))), lambda u: u != "")


# ---- addresses -------------------------------------------------------------------------------------------------------

_SCHEME = r"(?:[a-zA-Z][\w+.-]*:)"


def without_dots(path: Column) -> Column:
    """A path whose "." and ".." segments are followed; going up from the root stays there."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    start = F.array().cast("array<string>")
    kept = F.aggregate(segments, start, lambda stack, s: F.when(s == ".", stack).when(s == "..", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.least(F.size(stack), F.lit(1))))).otherwise(F.concat(stack, F.array(s))))
    whole = F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), whole).otherwise(path)


def joined_url(base: Column, href: Column) -> Column:
    """The absolute address of a link on a page, dot segments followed (RFC 3986, 5.2); other schemes stay as they are."""
    part = lambda c, pattern: F.regexp_extract(c, pattern, 1)
    scheme, site = part(base, f"^({_SCHEME})"), part(base, rf"^{_SCHEME}?(//[^/?#]*)")
    path = lambda c: part(c, rf"^{_SCHEME}?(?://[^/?#]*)?([^?#]*)")
    query = lambda c: part(c, r"^[^?#]*(\?[^#]*)")
    fragment = part(href, r"^[^#]*(#.*)")
    own, folder = path(href), part(path(base), r"^(.*/)")
    merged = F.when(own.startswith("/"), own).otherwise(F.concat(F.when(folder != "", folder).otherwise("/"), own))
    absolute = href.rlike(f"^{_SCHEME}//")
    return (
        F.when(absolute | href.startswith("//"), F.concat(F.when(absolute, part(href, f"^({_SCHEME})")).otherwise(scheme), part(href, rf"^{_SCHEME}?(//[^/?#]*)"), without_dots(own), query(href), fragment))
        .when(href.rlike(f"^{_SCHEME}"), href)
        .when(own == "", F.concat(scheme, site, path(base), F.when(query(href) != "", query(href)).otherwise(query(base)), fragment))
        .otherwise(F.concat(scheme, site, without_dots(merged), query(href), fragment))
    )


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1)


def clean_url(url: Column) -> Column:
    """Scheme, host and path with a slash at the end."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    return F.when(bare.endswith("/"), bare).otherwise(F.concat(bare, F.lit("/")))


def slugs(html: Column, pattern: str) -> Column:
    """Sorted distinct first groups of a pattern over the page's links."""
    found = F.transform(links(html), lambda u: F.regexp_extract(u, pattern, 1))
    return F.sort_array(F.array_distinct(F.filter(found, lambda s: s != "")))


def keyword_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,;]"), lambda s: F.trim(s)), lambda s: s != "")


# ---- text ------------------------------------------------------------------------------------------------------------

_ASIDE = ("nav", "header", "footer", "aside", "noscript")
_FRAME = rf"(?i)</?(?:article|{'|'.join(_ASIDE)})>"


def main_text(html: Column) -> Column:
    """Paragraph text of the first article element, or of the page: scripts, styles, titles, comments, navigation (nested too) and tags go.

    An element that is never closed reaches to the end; an end without a beginning means nothing.
    """

    def step(now: Column, part: Column, whole: Column) -> Column:
        name, end = F.lower(F.regexp_extract(part["mark"], "([A-Za-z]+)", 1)), part["mark"].startswith("</")
        article = name == "article"
        depth = F.when(article, now["depth"]).when(end, F.greatest(now["depth"] - 1, F.lit(0))).otherwise(now["depth"] + 1)
        inner = F.when(~article | now["done"], now["inner"]).when(end, F.greatest(now["inner"] - 1, F.lit(0))).otherwise(now["inner"] + 1)
        done = now["done"] | (article & end & (now["inner"] > 0) & (inner == 0))
        seen = (depth == 0) & (whole | ((inner > 0) & ~done))
        return F.struct(depth.alias("depth"), inner.alias("inner"), done.alias("done"), F.when(seen, F.concat(now["out"], F.array(part["text"]))).otherwise(now["out"]).alias("out"))

    def kept(bare: Column) -> Column:
        whole = ~bare.rlike("(?i)<article>")
        frames, texts = F.regexp_extract_all(bare, F.lit(_FRAME), 0), F.split(bare, _FRAME)
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("inner"), F.lit(False).alias("done"), F.when(whole, F.slice(texts, 1, 1)).otherwise(F.array().cast("array<string>")).alias("out"))
        parts = F.arrays_zip(frames.alias("mark"), F.slice(texts, 2, F.size(frames)).alias("text"))
        return held(whole, lambda w: F.array_join(F.aggregate(parts, start, lambda now, part: step(now, part, w), lambda s: s["out"]), " "))

    # tags without attributes, all else as <>
    c = held(F.regexp_replace(F.coalesce(html, F.lit("")), _MARK, "<$2>"), kept)
    c = F.regexp_replace(c, r"(?i)</(p|div|h[1-6]|li)>|<br>", "\n")
    c = unescape(F.regexp_replace(c, r"(?i)</?[a-z][^\s/>]*>|<>", " "))
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t\r\f]+", " "), r"\s*\n\s*", "\n")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def text_status(text: Column, status: Column) -> Column:
    """ok, empty, or error: with the reason, of a fetched page."""
    return F.when(~status.eqNullSafe(F.lit(200)), F.concat(F.lit("error:"), F.coalesce(status.cast("string"), F.lit("fetch")))).when(text == "", "empty").otherwise("ok")

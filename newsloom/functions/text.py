"""Column expressions for text, labels, ids, dates and casts."""

from __future__ import annotations

import calendar
import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .html import held


def _accents() -> tuple[str, str]:
    """Letters of Latin-1 Supplement to Latin Extended-B that decompose to one base character, and those."""
    pairs = [(chr(c), "".join(x for x in unicodedata.normalize("NFD", chr(c)) if unicodedata.category(x) != "Mn")) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{Mn}", "")


def normalised(c: Column) -> Column:
    """Without accents, lower case, trimmed; null is empty."""
    return F.lower(F.trim(strip_accents(F.coalesce(c, F.lit("")))))


def quoted(word: str) -> str:
    """A pattern for the word itself, alike in Java, RE2 and Python."""
    return re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", word)


_INSIDE, _EDGE = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"


def word_pattern(words: list[str]) -> str:
    """Any of the words, each with a border of words at both ends; where a word begins or ends in another character, a border is a letter beside it."""
    inner = lambda c: c.isalnum() or c == "_"
    by: dict[tuple[bool, bool], list[str]] = {}
    for w in words:
        by.setdefault((inner(w[0]), inner(w[-1])), []).append(quoted(w))
    parts = [f"{f'(^|{_EDGE})' if a else _INSIDE}({'|'.join(ws)}){f'($|{_EDGE})' if b else _INSIDE}" for (a, b), ws in by.items()]
    return parts[0] if len(parts) == 1 else f"({'|'.join(parts)})"


def has_word(c: Column, words: list[str]) -> Column:
    return c.rlike(word_pattern(words))


def first_label(c: Column, rules: dict[str, list[str]], default: str = "") -> Column:
    """The first label, in the order of the rules, of which a word occurs. The text is in lower case."""
    out = None
    for label, words in rules.items():
        hit = has_word(c, [w.lower() for w in words])
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(default) if out is None else out.otherwise(default)


def first_listed(c: Column, names: list[str]) -> Column:
    """The first listed name in the text, whatever its accents and case; as listed."""
    text = F.lower(strip_accents(c))
    plain = lambda s: "".join(x for x in unicodedata.normalize("NFD", s) if unicodedata.category(x) != "Mn").lower()
    return F.coalesce(*[F.when(has_word(text, [plain(n)]), n) for n in names], F.lit(""))


def first_slug(slugs: Column, rules: dict[str, str]) -> Column:
    """The value of the first entry whose key is among the slugs."""
    return F.coalesce(*[F.when(F.array_contains(slugs, k), v) for k, v in rules.items()], F.lit(""))


def first_equal(c: Column, values: dict[str, str], other: Column) -> Column:
    """What a value stands for, or the other."""
    return F.coalesce(*[F.when(c == k, v) for k, v in values.items()], other)


def or_else(c: Column, other: Column) -> Column:
    """The other where the column is null or blank."""
    return F.when(F.trim(F.coalesce(c, F.lit(""))) != "", c).otherwise(other)


def blob(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *parts))


def path_words(path: Column) -> Column:
    return F.translate(path, "-/", "  ")


def url_id(prefix: str, url: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:url-"), F.substring(F.sha1(url), 1, 12))


def publisher_id(prefix: str, own: Column, url: Column) -> Column:
    return F.when(F.coalesce(own, F.lit("")) != "", F.concat(F.lit(f"{prefix}:"), own)).otherwise(url_id(prefix, url))


def conflict_id(country: Column, title: Column) -> Column:
    return F.concat(F.lit("CONFLICT_"), F.substring(F.md5(F.concat(F.lower(F.trim(country)), F.lit("|"), title)), 1, 8))


def title_words(c: Column) -> Column:
    kept = F.regexp_replace(F.lower(c), rf"[^{V.TITLE_CHARACTERS}\s]", " ")
    stop = F.array(*[F.lit(w) for w in V.STOPWORDS])
    return F.filter(F.split(kept, r"\s+"), lambda w: (w != "") & ~F.array_contains(stop, w))


def normalised_title(c: Column) -> Column:
    return F.array_join(title_words(c), " ")


def keywords(words: Column, least: int = V.KEYWORD_LENGTH) -> Column:
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= least))


def pretty(c: Column, labels: dict[str, str]) -> Column:
    """A code's label, else the code with spaces and initials; letters after any other character are initials too."""
    v = F.trim(F.coalesce(c, F.lit("")))
    out = None
    for k, label in labels.items():
        out = F.when(v == k, label) if out is None else out.when(v == k, label)
    spaced = F.replace(v, F.lit("_"), F.lit(" "))
    # a mark before each letter that follows none, then initials by words, then the marks go
    marked = F.regexp_replace(F.lower(spaced), r"(?<![\p{L}])(?=\p{L})", "\u0001 ")
    return out.otherwise(F.regexp_replace(F.initcap(marked), "\u0001 ", ""))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def six_decimals(c: Column) -> Column:
    return F.format_string("%.6f", c)


_WEEKDAY = r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+"
_TIME = r"(?i)(^|[T\s,]|\bat)\s*\d{1,2}:\d{2}(:\d{2}([.,]\d+)?)?\s*([ap]\.?m\.?)?\s*(z|[a-z]{2,5}|(utc|gmt)?[+-]\d{2}:?\d{2})?(\s*\([^)]*\))?\s*$"


_MONTHS = {n.lower(): i for i in range(1, 13) for n in (calendar.month_name[i], calendar.month_abbr[i])} | {"sept": 9}


def iso_date(raw: Column) -> Column:
    """An ISO date where the text is one, with or without weekday, time and zone (which don't shift it); else the text; null is empty.

    What is left is read as words and numbers: a month's name with a day and a year of four digits in any order; three numbers, the year first or last, and then
    the month before the day if that is a date; or eight digits.
    """
    text = F.trim(F.coalesce(raw, F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(text, _WEEKDAY, ""), _TIME, "")
    bare = F.regexp_replace(F.regexp_replace(F.lower(bare), r"(\d)(st|nd|rd|th)\b", "$1"), r"\bof\b|\bthe\b|,", " ")
    months = F.create_map(*[F.lit(x) for kv in _MONTHS.items() for x in kv])
    date = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")

    def known(parts: Column) -> Column:
        words, numbers = F.filter(parts, lambda p: p.rlike("[a-z]")), F.filter(parts, lambda p: ~p.rlike("[a-z]"))
        month = F.try_element_at(months, F.get(words, F.lit(0))).cast("string")
        a, b, c = (F.get(numbers, F.lit(i)) for i in range(3))
        short = lambda *xs: functools.reduce(lambda p, q: p & q, [F.length(x) <= 2 for x in xs])
        shape = lambda w, n: (F.size(words) == w) & (F.size(numbers) == n)
        return (
            F.when(shape(1, 2) & (F.length(a) == 4) & short(b), date(a, month, b))
            .when(shape(1, 2) & (F.length(b) == 4) & short(a), date(b, month, a))
            .when(shape(0, 3) & (F.length(a) == 4) & short(b, c), date(a, b, c))
            .when(shape(0, 3) & (F.length(c) == 4) & short(a, b), F.coalesce(date(c, a, b), date(c, b, a)))
            .when(shape(0, 1) & (F.length(a) == 8), F.try_to_date(a, "yyyyMMdd"))
        )

    found = held(F.when(bare.rlike(r"^[a-z0-9\s./-]+$"), F.regexp_extract_all(bare, F.lit(r"[a-z]+|\d+"), 0)), known)
    return F.coalesce(F.date_format(found, "yyyy-MM-dd"), F.coalesce(raw, F.lit("")))


def day_month_year(c: Column) -> Column:
    """The first d/m/yyyy in the text as an ISO date; empty if there is none or it is no date."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d{1,2}/\d{1,2}/\d{4})", 1)
    return F.coalesce(F.date_format(F.try_to_date(found, "d/M/yyyy"), "yyyy-MM-dd"), F.lit(""))


def number(c: Column) -> Column:
    return c.try_cast("double")


def language_of(c: Column) -> Column:
    return F.when(F.lower(F.trim(F.coalesce(c, F.lit("")))).rlike("^(es|sp)"), "es").otherwise("en")

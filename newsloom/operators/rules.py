"""Ordered keyword rules, compiled once into expressions; sources, their discovery, parsing and relevance tests as data."""

from __future__ import annotations

import importlib.resources
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as X
from . import growth


@dataclass
class Source:
    """A source's configuration. Rules are {dimension: {label: [words]}} in order of priority; all of it is data."""

    name: str
    url_path: str
    rules: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    countries: dict[str, list[str]] = field(default_factory=dict)
    default_country: str = ""
    regions: list[str] = field(default_factory=list)
    label: str = ""  #: as articles name it
    base: str = ""
    seeds: list[str] = field(default_factory=list)
    over_collect: int = 1  #: listing pages are read until there are so many times the wanted articles
    order: str = "url"  #: in which candidates are taken: by address, or as they come on the pages
    # which addresses are articles: of the groups of url_path the first is a category, the second a slug
    denied_path: str | None = None
    denied_segments: list[str] = field(default_factory=list)
    denied_prefixes: list[str] = field(default_factory=list)
    denied_slugs: list[str] = field(default_factory=list)
    denied_address: str | None = None
    categories: list[str] = field(default_factory=list)
    # what a page says about itself
    meta: dict[str, list[str]] = field(default_factory=lambda: dict(_META))
    author_link: bool = False
    time_tag: bool = False
    day_first: bool = False
    country_names: dict[str, str] = field(default_factory=dict)
    locked: dict[str, str] = field(default_factory=dict)
    tags: str | None = None
    slug_pattern: str | None = None
    slug_patterns: dict[str, str] = field(default_factory=dict)
    slug_rules: dict[str, dict[str, str]] = field(default_factory=dict)
    blob: list[str] = field(default_factory=lambda: ["title", "text", "section", "path"])
    region_text: list[str] = field(default_factory=lambda: ["title", "text"])
    notes: list[list[str]] = field(default_factory=lambda: [["author", "author: {}"], ["section", "section: {}"], ["keywords", "keywords: {}"]])
    slug_notes: list[list] = field(default_factory=lambda: [["topics", "topics: {}", 8]])
    no_slugs: str | None = None
    method: str = "metadata + keyword rule"
    # which articles count
    relevance: str = "any"
    section: str | None = None
    strong_sectors: list[str] = field(default_factory=list)
    relevant_slugs: list[str] = field(default_factory=list)
    more_relevant_slugs: list[str] = field(default_factory=list)
    blocked: list[str] = field(default_factory=list)
    americas_only: bool = False

    @classmethod
    def from_json(cls, text: str) -> Source:
        return cls(**{k: v for k, v in json.loads(text).items() if not k.startswith("_")})

    def telling_slugs(self) -> list[str]:
        """Slugs that make an article relevant by themselves: the listed ones, or all that have a rule and some more."""
        if self.relevant_slugs or not self.more_relevant_slugs:
            return self.relevant_slugs
        ruled = [s for d, by in self.slug_rules.items() if d != "country" for s in by]
        return list(dict.fromkeys(ruled + self.more_relevant_slugs))


_META = {
    "title": ["og:title", "twitter:title"], "text": ["og:description", "description"], "section": ["article:section"], "author": ["author", "article:author"],
    "keywords": ["keywords", "news_keywords"], "date": ["article:published_time", "date"],
}
_DATA = importlib.resources.files("newsloom.sources") / "data"


def shipped() -> list[str]:
    """Names of the sources that come with the library."""
    return sorted(f.name.removesuffix(".json") for f in _DATA.iterdir() if f.name.endswith(".json"))


def shipped_source(name: str) -> Source:
    return Source.from_json((_DATA / f"{name}.json").read_text(encoding="utf-8"))


def rule_rows(rules: dict[str, dict[str, list[str]]], source: str = "") -> list[tuple[str, str, int, str, str]]:
    """(source, dimension, priority, label, keyword) rows of the nested rules."""
    return [(source, d, i, label, w) for d, labels in rules.items() for i, (label, words) in enumerate(labels.items()) for w in words]


def rules_of(rows: DataFrame) -> dict[str, dict[str, list[str]]]:
    """Nested rules from such rows, which are configuration and few."""
    out: dict[str, dict[str, list[str]]] = {}
    for r in rows.orderBy("dimension", "priority", "keyword").collect():
        out.setdefault(r.dimension, {}).setdefault(r.label, []).append(r.keyword)
    return out


def classify(df: DataFrame, blob: Column, rules: dict[str, dict[str, list[str]]]) -> DataFrame:
    """A column for each dimension: the first label of which a word occurs, else empty."""
    return df.withColumns({d: X.first_label(blob, labels) for d, labels in rules.items()})


def blocked(blob: Column, phrases: list[str]) -> Column:
    """The first blocked phrase in the text, or null."""
    return F.coalesce(*[F.when(X.has_word(blob, [p]), p) for p in phrases], F.lit(None).cast("string"))


def relevance(kind: str, source: Source, sector: Column, event: Column, issue: Column, country: Column, url: Column, slugs: Column, blob: Column) -> Column:
    """Tests by name: any, always, pair (sector with event or issue), pair_or_issue, pair_or_issue_or_violence,
    pair_or_section, strong (strong sector with event, issue or section; or an issue)."""
    s, e, i = sector != "", event != "", issue != ""
    in_section = F.contains(url, F.lit(source.section)) if source.section else F.lit(False)
    strong = sector.isin(source.strong_sectors)
    tests = {
        "always": F.lit(True),
        "any": s | e | i,
        "pair": s & (e | i),
        "pair_or_issue": (s & (e | i)) | i,
        "pair_or_issue_or_violence": (s & (e | i)) | i | (event == "violence"),
        "pair_or_section": (s & (e | i)) | (in_section & s),
        "strong": (strong & (e | i)) | (in_section & strong) | i,
    }
    out = tests[kind]
    if source.telling_slugs():
        out = out | F.arrays_overlap(slugs, F.array(*[F.lit(x) for x in source.telling_slugs()]))
    if source.blocked:
        out = out & blocked(blob, source.blocked).isNull()
    if source.americas_only:
        out = out & country.isin(list(source.countries))
    return out


def is_article(url: Column, source: Source) -> Column:
    p = H.path(url)
    ok = p.rlike(source.url_path)
    if source.denied_path:
        ok = ok & ~p.rlike(source.denied_path)
    if source.denied_segments:
        ok = ok & ~p.rlike(f"/({'|'.join(X.quoted(s) for s in source.denied_segments)})(/|$)")
    if source.categories:
        ok = ok & F.regexp_extract(p, source.url_path, 1).isin(source.categories)
    if source.denied_slugs:
        ok = ok & ~F.regexp_extract(p, source.url_path, 2).isin(source.denied_slugs)
    for prefix in source.denied_prefixes:
        ok = ok & ~F.startswith(p, F.lit(prefix))
    if source.denied_address:
        ok = ok & ~F.contains(url, F.lit(source.denied_address))
    return ok


def _listed(pages: DataFrame, source: Source, base: str, *more: Column) -> DataFrame:
    """(more, place, url) of article links of the same host on landed pages."""
    found = pages.select(*more, F.posexplode(H.links(F.col("html"))).alias("place", "href"))
    names = [c for c in found.columns if c != "href"]
    whole = found.select(*names, H.joined_url(F.lit(base), F.col("href")).alias("url"))
    return whole.where((H.host(F.col("url")) == H.host(F.lit(base))) & is_article(F.col("url"), source)).select(*names, H.clean_url(F.col("url")).alias("url"))


def discover(pages: DataFrame, source: Source, base: str) -> DataFrame:
    """Distinct clean addresses of articles of the same host among the links of landed pages (url, html)."""
    return _listed(pages, source, base).select("url").distinct()


def candidates(pages: DataFrame, source: Source, most: int) -> DataFrame:
    """(url, seed, place): addresses on the landed pages of the seeds, with where each comes first. Seeds are read in order until there are enough."""
    order = F.array(*[F.lit(s) for s in source.seeds])
    seeds = pages.where(F.col("url").isin(source.seeds))
    found = _listed(seeds, source, source.base, F.array_position(order, F.col("url")).alias("seed"))
    used = growth.seeds_within(found, most * source.over_collect)
    return used.groupBy("url").agg(F.min(F.struct("seed", "place")).alias("first")).select("url", "first.seed", "first.place")


def _held(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """With columns that are computed here: else the plan would put their expressions into each of their many uses."""
    held = df.withColumn("_held", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    return held.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], "_held.*")


def parse_articles(pages: DataFrame, source: Source) -> DataFrame:
    """Article rows of landed pages: the canonical columns and, for the relevance test, slugs; pages without a title go."""
    pages = _held(_held(pages, {"_marks": H.marks(F.col("html"))}), {"_metas": H.meta_tags_of(F.col("_marks"))})
    h, url, metas, found = F.col("html"), F.col("url"), F.col("_metas"), F.col("_marks")
    said = {k: H.meta_of(metas, *source.meta.get(k, [])) if source.meta.get(k) else F.lit("") for k in ("title", "text", "section", "author", "keywords", "date", "id", "country", "tier")}
    said["title"] = X.or_else(said["title"], H.title_of(found))
    if source.author_link:
        said["author"] = X.or_else(said["author"], H.author_link(h))
    if source.time_tag:
        said["date"] = X.or_else(said["date"], H.time_tag(h))
    patterns = source.slug_patterns or ({"topics": source.slug_pattern} if source.slug_pattern else {})
    slugs = {k: H.slugs(h, patterns[k]) if k in patterns else F.array().cast("array<string>") for k in ("topics", "regions")}
    if source.tags:
        slugs["topics"] = F.transform(H.metas_of(metas, source.tags), lambda t: F.lower(t))
    df = _held(pages, {f"_{k}": c for k, c in said.items()} | {f"_{k}": c for k, c in slugs.items()}).where("_title <> ''")
    field = {k: F.col(f"_{k}") for k in said} | {"path": X.path_words(H.path(url)), "topics": F.array_join("_topics", " ")}
    df = _held(df, {"_blob": X.blob(*[field[k] for k in source.blob])})
    df = classify(df, F.col("_blob"), {d: source.rules.get(d, {}) for d in ("sector", "event_type", "environmental_issue")})
    for d, by_slug in source.slug_rules.items():
        if d != "country":
            df = df.withColumn(d, X.or_else(X.first_slug(F.col("_topics"), by_slug), F.col(d)))
    country = X.first_label(F.col("_blob"), source.countries, source.default_country)
    if source.country_names:
        own = F.lower(F.col("_country"))
        country = X.or_else(X.first_equal(own, source.country_names, X.first_label(own, source.countries)), country)
    if "country" in source.slug_rules:
        country = X.or_else(X.first_slug(F.array_union("_topics", "_regions"), source.slug_rules["country"]), country)
    region = X.first_listed(F.concat_ws(" ", *[field[k] for k in source.region_text]), source.regions) if source.regions else F.lit("")
    date = X.day_month_year(F.col("_date")) if source.day_first else X.iso_date(F.col("_date"))
    blank = {c: F.lit("") for c in ("locality", "latitude", "longitude", "actor_company", "community_actor")}
    df = _held(df, {d: F.col(d) for d in ("sector", "event_type", "environmental_issue")} | {"_where": country}).withColumn("country", F.col("_where")).drop("_where")
    country = F.col("country")
    df = df.withColumns({"article_id": X.publisher_id(source.name, F.col("_id"), url), "source": F.lit(source.label or source.name), "article_title": F.col("_title"), "article_url": url, "date_published": date, "country": country, "region_department": region, **blank, "source_text_excerpt": F.substring("_text", 1, 500), "extraction_method": F.lit(source.method)})
    return df.withColumn("notes", _notes(source)).withColumnRenamed("_topics", "slugs")


def _notes(source: Source) -> Column:
    """What a reader of the table should know of a row, joined by bars."""
    some = [F.when(F.size(f"_{k}") > 0, F.concat(F.lit(shape.replace("{}", "")), F.array_join(F.slice(f"_{k}", 1, n), ", "))) for k, shape, n in source.slug_notes]
    slugs = F.nullif(F.concat_ws(" / ", *some), F.lit(""))
    out = [F.coalesce(slugs, F.lit(source.no_slugs)) if source.no_slugs else slugs]
    locked = F.contains("_blob", F.lit(source.locked.get("word", ""))) | (F.col("_tier") == source.locked.get("tier", ""))
    holds = {"no sector": F.col("sector") == "", "no event": F.col("event_type") == "", "no country": F.col("country") == "", "locked": locked if source.locked else F.lit(False)}
    for what, shape in source.notes:
        out.append(F.when(holds[what], shape) if what in holds else F.when(F.col(f"_{what}") != "", F.concat(F.lit(shape.replace("{}", "")), F.col(f"_{what}"))))
    return F.concat_ws(" | ", *out)


def relevant_articles(pages: DataFrame, source: Source) -> DataFrame:
    df = parse_articles(pages, source)
    text = X.blob(F.col("article_title"), F.col("source_text_excerpt"))
    return df.where(relevance(source.relevance, source, F.col("sector"), F.col("event_type"), F.col("environmental_issue"), F.col("country"), F.col("article_url"), F.col("slugs"), text))


def crawl(pages: DataFrame, source: Source, most: int) -> DataFrame:
    """The first ``most`` relevant articles, in the order of their candidates, among landed pages (url, html, status); latest first.

    A page landed more than once counts as first landed by its text; pages whose status isn't 200 don't count.
    """
    got = pages.where("status = 200")
    wanted = candidates(got, source, most)
    landed = got.select(H.clean_url(F.col("url")).alias("url"), "html").groupBy("url").agg(F.min("html").alias("html"))
    found = relevant_articles(landed.join(wanted, "url"), source)
    order = ["url"] if source.order == "url" else ["seed", "place"]
    return found.orderBy(*order).limit(most).orderBy(*growth.date_order("date_published", "url"))

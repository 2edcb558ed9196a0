"""Web pages that are already fetched: text, metadata, links, domains, robots rules and crawls over a table of pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.shared import cut

#: Elements whose text is left out, and elements without an end tag.
DROPPED = ("script", "style", "nav", "footer", "header")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.meta: dict[str, str] = {}
        self.links: list[str] = []
        self.lang = None
        self.title: list[str] = []
        self._drop = 0
        self._stack: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag == "html":
            self.lang = a.get("lang")
        if tag == "meta" and a.get("content") is not None and (name := a.get("name") or a.get("property")):
            self.meta.setdefault(name.lower(), a["content"])
        if tag in ("a", "link") and a.get("href"):
            self.links.append(a["href"])
        if tag not in VOID:
            self._stack.append(tag)
            self._drop += tag in DROPPED

    def handle_endtag(self, tag: str) -> None:
        if tag in self._stack:
            while self._stack:
                t = self._stack.pop()
                self._drop -= t in DROPPED
                if t == tag:
                    break

    def handle_data(self, data: str) -> None:
        if self._stack and self._stack[-1] == "title":
            self.title.append(data)
        if not self._drop and (t := data.strip()):
            self.text.append(t)


def parse_html(html: str | None) -> _Page:
    p = _Page()
    p.feed(html or "")
    p.close()
    return p


def resolve(base: str, href: str) -> str | None:
    """An absolute http(s) address without its fragment."""
    try:
        u = urldefrag(urljoin(base, href)).url
        return u if urlsplit(u).scheme in ("http", "https") else None
    except ValueError:
        return None


def parse_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, title, description, keywords, author, language, content_length and links (distinct, sorted). Null html is an empty page."""

    def of(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            rows = []
            for i, u, h in zip(p["page_id"], p["url"], p["html"]):
                x = parse_html(h)
                m = lambda n: x.meta.get(n) or x.meta.get(f"og:{n}") or ""  # noqa: B023, E731
                links = sorted({r for l in x.links if (r := resolve(u or "", l))})
                rows.append((i, u, "\n".join(x.text), "".join(x.title).strip(), m("description"), m("keywords"), m("author"), x.lang or "", len(h or ""), links))
            yield pd.DataFrame(rows, columns=["page_id", "url", "text", "title", "description", "keywords", "author", "language", "content_length", "links"])

    return pages.select("page_id", "url", "html").mapInPandas(of, "page_id long, url string, text string, title string, description string, keywords string, author string, language string, content_length long, links array<string>")


def hrefs(html: Column) -> Column:
    """href values of a and link elements, as written, in order."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<(?:a|link)\b[^>]*?\bhref="([^"]*)"'), F.lit(1))


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def host(url: Column) -> Column:
    """Network location, port and user included."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def domain_filter(df: DataFrame, allowed: list[str] | None = None, blocked: list[str] | None = None, url: str = "url") -> DataFrame:
    """Blocked wins; no allow list allows all."""
    h = host(F.col(url))
    out = df.filter(~h.isin(blocked)) if blocked else df
    return out.filter(h.isin(allowed)) if allowed else out


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """Rows of ``urls`` that no rule (host, user_agent, disallow) for the agent forbids by a prefix of the path."""
    mine = rules.filter((F.col("user_agent") == "*") | F.contains(F.lower(F.lit(agent)), F.lower("user_agent"))).filter("disallow <> ''").select(F.col("host").alias("_h"), "disallow")
    path = F.concat(F.lit("/"), F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?([^#]*)", 1))
    u = urls.withColumn("_path", path).withColumn("_host", host(F.col("url")))
    return u.join(mine, (F.col("_host") == F.col("_h")) & F.startswith(F.col("_path"), F.col("disallow")), "left_anti").drop("_path", "_host")


def crawl(pages: DataFrame, seeds: list[str], max_depth: int = 2, max_pages: int | None = None) -> DataFrame:
    """url, depth of the pages that are reached from the seeds over links in a table of pages, breadth first; each page once, at its least depth."""
    links = cut(parse_pages(pages).select("url", F.explode("links").alias("to")).distinct(), "links")  # pages are parsed once
    known = pages.select("url").filter("url is not null").distinct()
    spark = pages.sparkSession
    frontier = spark.createDataFrame([(s,) for s in seeds], "url string").join(known, "url", "left_semi").distinct().withColumn("depth", F.lit(0))
    found = frontier
    for d in range(1, max_depth + 1):
        step = links.join(frontier, "url").select(F.col("to").alias("url")).distinct().join(known, "url", "left_semi").join(found, "url", "left_anti")
        frontier = cut(step.withColumn("depth", F.lit(d)), "frontier")
        found = found.unionByName(frontier)
    return found.orderBy("depth", "url").limit(max_pages) if max_pages else found

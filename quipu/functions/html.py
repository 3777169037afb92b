"""Article parts out of HTML, as an Arrow UDF over the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

ARTICLE = StructType([StructField(c, StringType()) for c in ("titulo", "texto", "fecha")])
# Elements whose content isn't text of the article, elements without end tags.
SKIPPED = {"script", "style", "nav", "footer", "header", "aside", "form", "noscript", "svg", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Classes and elements that hold the body, best first.
BODIES = ("article", "main", "entry-content", "post-content", "article-body", "field-name-body", "content")
PARAGRAPH = 30


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.path: list[tuple[str, str]] = []
        self.meta: dict[str, str] = {}
        self.headings: list[str] = []
        self.title = ""
        self.times: list[str] = []
        self.paragraphs: list[tuple[set[str], str]] = []
        self.open: list[str] | None = None
        self.kind = ""

    def _flush(self) -> None:
        if self.open is None:
            return
        got = " ".join("".join(self.open).split())
        if got:
            if self.kind == "p":
                self.paragraphs.append(({x for tag, cls in self.path for x in (tag, *cls.split())}, got))
            elif self.kind == "h1":
                self.headings.append(got)
            elif self.kind == "title":
                self.title = self.title or got
            elif self.kind == "time":
                self.times.append(got)
        self.open = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name = (a.get("property") or a.get("name") or a.get("itemprop") or "").lower()
            self.meta.setdefault(name, a.get("content", ""))
        if tag == "time" and a.get("datetime"):
            self.times.append(a["datetime"])
        if tag in VOID:
            if tag == "br" and self.open is not None:
                self.open.append(" ")
            return
        if tag == "p" or tag in ("div", "ul", "ol", "table", "section", "article", "footer", "nav", "h1", "h2", "h3"):
            self._flush()  # these end an open paragraph
            if self.path and self.path[-1][0] == "p":
                self.path.pop()
        self.path.append((tag, a.get("class", "")))
        if tag in ("p", "h1", "title", "time") and not any(t in SKIPPED for t, _ in self.path[:-1]):
            self._flush()
            self.open, self.kind = [], tag

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.path):
            return
        if tag == self.kind or tag not in ("a", "b", "i", "em", "strong", "span", "u", "small", "sup", "sub"):
            self._flush()
        while self.path:
            if self.path.pop()[0] == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.open is not None and not any(t in SKIPPED for t, _ in self.path):
            self.open.append(data)


def parse(source: str) -> tuple[str, str, str]:
    """Title (12 characters or more, else empty), body paragraphs (30 or more each) and date text (up to 100) of a page."""
    page = _Page()
    page.feed(source)
    page.close()
    page._flush()
    titles = [page.headings[0] if page.headings else "", page.meta.get("og:title", ""), page.title]
    title = next((" ".join(t.split()) for t in titles if len(" ".join(t.split())) >= 12), "")
    long_ = [(where, p) for where, p in page.paragraphs if len(p) >= PARAGRAPH]
    options = ["\n".join(p for where, p in long_ if body in where) for body in BODIES] + ["\n".join(p for _, p in long_)]
    body = max(options[:-1], key=len) or options[-1]
    dates = [page.meta.get(k, "") for k in ("article:published_time", "datepublished", "date")] + page.times
    date = next((d.strip() for d in dates if 0 < len(d.strip()) <= 100), "")
    return title, body, date


@F.pandas_udf(ARTICLE)
def article(s: pd.Series) -> pd.DataFrame:
    """``(titulo, texto, fecha)`` of HTML pages; null and empty pages give empty parts."""
    return pd.DataFrame([parse(x or "") for x in s], columns=ARTICLE.names)

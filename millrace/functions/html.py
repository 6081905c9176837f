"""Allow-list cleaning of HTML fragments."""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sliced import sliced_udf
from .text import text

#: Elements that stay, and those that go with all they hold.
KEPT = frozenset(
    "a abbr acronym article aside b bdi bdo blockquote br caption cite code col colgroup dd del details dfn div dl dt em figcaption figure "
    "h1 h2 h3 h4 h5 h6 hgroup hr i img ins kbd li mark ol p pre q rp rt ruby s samp section small span strike strong sub summary sup table "
    "tbody td tfoot th thead time tr tt u ul var wbr".split()
)
DROPPED = frozenset("script style iframe noscript object embed applet frame frameset noembed noframes title textarea select".split())
VOID = frozenset("br col hr img wbr".split())

#: Attributes of single elements, besides those of all.
ATTRIBUTES = {
    "a": {"href"}, "img": {"src", "alt", "width", "height", "align"}, "blockquote": {"cite"}, "q": {"cite"}, "del": {"cite", "datetime"},
    "ins": {"cite", "datetime"}, "time": {"datetime"}, "ol": {"type", "start"}, "ul": {"type"}, "li": {"type", "value"},
    "td": {"abbr", "align", "colspan", "rowspan", "headers", "height", "width", "valign"},
    "th": {"abbr", "align", "colspan", "rowspan", "headers", "height", "scope", "width", "valign"},
    "col": {"align", "span", "valign", "width", "height"}, "colgroup": {"align", "span", "valign", "width", "height"},
    "table": {"height", "width", "summary"}, "details": {"open"},
}
_COMMON = frozenset({"dir", "lang", "id", "title"})
_URLS = frozenset({"href", "src", "cite"})
_NUMBERS = frozenset({"width", "height", "colspan", "rowspan", "span", "start", "value"})
_SCHEMES = frozenset({"http", "https", "mailto"})
_SCHEME = re.compile(r"^([a-zA-Z][a-zA-Z0-9+.-]*):")


def _url(value: str) -> str | None:
    """The url without white space inside, if its scheme is allowed or it is relative."""
    value = re.sub(r"[\x00-\x20\x7f]+", "" if not value.strip().startswith("mailto:") else " ", value).strip()
    if not value:
        return None
    if found := _SCHEME.match(value):
        return value if found[1].lower() in _SCHEMES else None
    return None if ":" in re.split(r"[/?#]", value, maxsplit=1)[0] else value


class _Cleaner(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.dropping: list[str] = []  # open elements whose content goes
        self.bare: dict[str, list[bool]] = {"a": [], "span": []}  # whether an open one was written

    def _attributes(self, tag: str, attrs: list[tuple[str, str | None]]) -> list[tuple[str, str]]:
        allowed, kept = ATTRIBUTES.get(tag, frozenset()), []
        for name, value in attrs:
            if name not in allowed and name not in _COMMON or any(name == n for n, _ in kept):
                continue
            value = value or ""
            if name in _URLS:
                value = _url(value)
                if value is None:
                    continue
            elif name in _NUMBERS and not re.fullmatch(r"\d+%?", value):
                continue
            elif name == "dir" and value.lower() not in ("ltr", "rtl"):
                continue
            elif name in ("id", "lang") and not re.fullmatch(r"[a-zA-Z0-9:_.-]+", value):
                continue
            kept.append((name, value))
        if tag == "a" and any(n == "href" for n, _ in kept):
            kept.append(("rel", "nofollow"))
        return kept

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in DROPPED:
            if tag not in ("embed", "frame"):
                self.dropping.append(tag)
            return
        if self.dropping or tag not in KEPT:
            return
        kept = self._attributes(tag, attrs)
        written = bool(kept) or tag not in ("a", "img", "span")
        if tag in self.bare:
            self.bare[tag].append(written)
        if written:
            self.out.append("<" + tag + "".join(f' {n}="{escape(v)}"' for n, v in kept) + ">")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in KEPT and not self.dropping:
            kept = self._attributes(tag, attrs)
            if kept or tag not in ("a", "img", "span"):
                self.out.append("<" + tag + "".join(f' {n}="{escape(v)}"' for n, v in kept) + "/>")

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED:
            if tag in self.dropping:
                while self.dropping.pop() != tag:
                    pass
            return
        if self.dropping or tag not in KEPT or tag in VOID:
            return
        if tag in self.bare and self.bare[tag] and not self.bare[tag].pop():
            return
        self.out.append(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        if not self.dropping:
            self.out.append(data.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&#34;").replace("'", "&#39;"))

    def handle_entityref(self, name: str) -> None:
        if not self.dropping:
            self.out.append(f"&{name};")

    def handle_charref(self, name: str) -> None:
        if not self.dropping:
            self.out.append(f"&#{name};")


def sanitize(fragment: str | None) -> str:
    """The allowed part of a fragment: text stays, elements and attributes that
    are not listed go, urls are http, https, mailto or relative."""
    if not fragment:
        return ""
    cleaner = _Cleaner()
    cleaner.feed(fragment)
    cleaner.close()
    return "".join(cleaner.out)


sanitize_udf = sliced_udf(sanitize, T.StringType())


def sanitize_html(c: Column | str) -> Column:
    """:func:`sanitize` of a column; fragments without markup don't leave the JVM.
    Spark calls Python for every row of a CASE, so the others go there as nulls."""
    marked = text(c).rlike("[<>&\"']")
    return F.when(marked, sanitize_udf(F.when(marked, text(c)))).otherwise(text(c))


def sanitize_items(items: DataFrame) -> DataFrame:
    """Cleans content and summary of the items of type text/html; a summary that is
    the content is cleaned with it."""
    html, same = F.col("content_type") == "text/html", F.col("summary") == F.col("content")
    clean = {"content": sanitize_html(F.when(html, F.col("content"))), "summary": sanitize_html(F.when(html & ~F.coalesce(same, F.lit(False)), F.col("summary")))}
    clean["summary"] = F.when(same, clean["content"]).otherwise(clean["summary"])
    return items.withColumns({c: F.when(html, value).otherwise(text(c)) for c, value in clean.items()})

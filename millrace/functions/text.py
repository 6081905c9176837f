"""Column functions for texts, keys, names and search tokens."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode white space, as a class of Java's regular expressions.
WHITE = r"[\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_OTHER_WHITE = WHITE.replace(r"\x{20}", "")
#: Runs of white space that are more than one space; other printable ASCII is passed
#: over by one look, as most of a text is that.
_RUNS = rf"(?![!-~])(?:{_OTHER_WHITE}{WHITE}*| {WHITE}+)"
#: A character that :func:`xml_escape` changes.
_UNSAFE_XML = r"[^ !#-%(-;=?-\x{d7ff}\x{e000}-\x{fffd}\x{10000}-\x{10ffff}]"


def text(c: Column | str) -> Column:
    """The column as a string, '' for null."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def trim_white(c: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text(c), f"^{WHITE}+|{WHITE}+$", "")


def collapse_white(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(text(c), _RUNS, " "), F.lit(" "))


def normalize_text(c: Column | str) -> Column:
    """White space collapsed, lower case code point by code point (no final sigma)."""
    plain = F.replace(F.replace(collapse_white(c), F.lit("Σ"), F.lit("σ")), F.lit("İ"), F.lit("i"))
    return F.lower(plain)


def content_hash(title: Column | str, content: Column | str) -> Column:
    """32 hex digits: the first half of SHA-256 over the normalised title and
    content with a zero byte between."""
    joined = F.concat(normalize_text(title), F.lit("\0"), normalize_text(content))
    return F.substring(F.sha2(joined.cast("binary"), 256), 1, 32)


def identity_hash(title: Column | str, content: Column | str) -> Column:
    """:func:`content_hash`, or '' if title and content are both empty."""
    return F.when((text(title) == "") & (text(content) == ""), F.lit("")).otherwise(content_hash(title, content))


# -- urls -------------------------------------------------------------------------

#: Printable ASCII without what a url would have to escape.
_PLAIN = r"^[A-Za-z][A-Za-z0-9+.-]*://[A-Za-z0-9.-]+(:[0-9]*)?(/[A-Za-z0-9/._~!$&'()*+,;=:@-]*)?(\?[!-~&&[^#]]*)?(#[A-Za-z0-9/._~!$&'()*+,;=:@?-]*)?$"
_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def _odd_url(url: str) -> str:
    """A trimmed url with characters beyond the plain ones."""
    if any(c < " " or c == "\x7f" for c in url):
        return url
    body, _, fragment = url.partition("#")
    scheme, colon, rest = body.partition(":")
    if not colon or not scheme[:1].isalpha() or not scheme[:1].isascii() or not all(c.isascii() and (c.isalnum() or c in "+-.") for c in scheme):
        return url
    if not rest.startswith("//") or _bad_escape(fragment):
        return url
    rest, mark, query = rest[2:].partition("?")
    cut = rest.find("/")
    authority, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
    user, at, host = authority.rpartition("@")
    name, _, port = host.rpartition(":") if ":" in host and not host.endswith("]") else (host, "", "")
    if not host or (port and not (port.isascii() and port.isdigit())) or _bad_escape(path) or (at and _bad_escape(user)):
        return url
    if any(c in " <>\"\\^`{|}" for c in name) or ("%" in name and not name.startswith("[")):
        return url
    plain = _unescaped(path)
    if path not in ("", "/") and plain != "/":
        shorter = plain.rstrip(b"/") if isinstance(plain, bytes) else plain
        path = path if shorter == plain and _is_escaped(path) else _escaped(shorter)
    elif plain == b"/":
        path = "/"
    return f"{scheme.lower()}://{user}{at}{host.lower()}{path}{mark}{query}"


def _bad_escape(s: str) -> bool:
    hexes = set("0123456789abcdefABCDEF")
    return any(len(x) < 2 or x[0] not in hexes or x[1] not in hexes for x in s.split("%")[1:])


def _unescaped(path: str) -> bytes:
    first, *rest = path.split("%")
    return first.encode() + b"".join(bytes([int(x[:2], 16)]) + x[2:].encode() for x in rest)


_PATH_SAFE = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_.~$&+,/:;=@")


def _escaped(raw: bytes) -> str:
    return "".join(chr(b) if b in _PATH_SAFE else f"%{b:02X}" for b in raw)


def _is_escaped(path: str) -> bool:
    return all(b in _PATH_SAFE or b in b"!'()*[]%" for b in path.encode())


@F.pandas_udf(T.StringType())
def _odd_urls(urls: pd.Series) -> pd.Series:
    return urls.map(_odd_url)


def normalize_url(c: Column | str) -> Column:
    """Scheme and host in lower case, no fragment, no slashes at the path's end
    unless it is all of the path; the query stays.  What is no absolute url comes
    back trimmed.  Plain urls stay in built-in expressions; only others (escapes,
    spaces, user names, other alphabets) go through a vectorised helper."""
    url = trim_white(c)
    path = F.regexp_extract(url, _PARTS, 3)
    plain = F.concat(
        F.lower(F.regexp_extract(url, _PARTS, 1)), F.lit("://"), F.lower(F.regexp_extract(url, _PARTS, 2)),
        F.when(path == "/", path).otherwise(F.rtrim(path, F.lit("/"))), F.regexp_extract(url, _PARTS, 4),
    )
    return F.when(url.rlike(_PLAIN), plain).when(url.contains("://"), _odd_urls(url)).otherwise(url)


# -- search tokens ------------------------------------------------------------------


def bigram_tokenize(c: Column | str, split_after_han: bool = False) -> Column:
    """Runs of Han characters as overlapping pairs (a lone one as itself), each
    piece after a space unless it comes first; other runs as they are.  With
    ``split_after_han`` a space also follows a Han run before other text."""
    runs = F.regexp_extract_all(text(c), F.lit(r"(\p{IsHan}+|\P{IsHan}+)"), F.lit(1))
    pairs = lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substr(r, i, F.lit(2)))
    )
    han = lambda r: r.rlike(r"^\p{IsHan}")
    piece = lambda r, i: F.when(han(r), F.concat(F.when(i == 0, F.lit("")).otherwise(F.lit(" ")), F.array_join(pairs(r), " "))).otherwise(
        F.when((i > 0) & ~r.rlike(f"^{WHITE}"), F.concat(F.lit(" "), r)).otherwise(r) if split_after_han else r
    )
    return F.array_join(F.transform(runs, piece), "")


@cache
def _accents() -> tuple[str, str]:
    """Letters with diacritics and their base letters, from Unicode's tables."""
    out = {}
    for code in range(0xC0, 0x2000):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isalpha() and all(unicodedata.combining(c) for c in base[1:]):
            out[chr(code)] = base[0]
    return "".join(out), "".join(out.values())


def fold_token(c: Column | str) -> Column:
    """Lower case without diacritics."""
    marks, bases = _accents()
    return F.lower(F.translate(F.regexp_replace(text(c), r"\p{Mn}", ""), marks + "Σİ", bases + "σi"))


def index_tokens(c: Column | str) -> Column:
    """Folded runs of letters, digits and private-use characters, in order."""
    return F.regexp_extract_all(fold_token(c), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), F.lit(1))


def search_terms(c: Column | str) -> Column:
    """The phrases of a query, each an array of tokens: pieces of the bigram form
    between white space.  Pieces without a token are left out."""
    pieces = F.split(collapse_white(bigram_tokenize(c)), " ")
    return F.filter(F.transform(F.filter(pieces, lambda p: p != ""), index_tokens), lambda t: F.size(t) > 0)


# -- names and export texts ---------------------------------------------------------


def month_of(published: Column | str, fetched: Column | str) -> Column:
    """yyyy-MM of the first that is not null, else ``unknown``."""
    month = lambda c: F.date_format(c, "yyyy-MM")
    return F.coalesce(month(published), month(fetched), F.lit("unknown"))


#: Device names that can't be file names.
_DEVICES = r"(?i)^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"


def safe_name(c: Column | str) -> Column:
    """A file name: reserved and control characters as _, no outer white space,
    then no outer dots; device names get a _ in front; may be ''."""
    name = F.btrim(trim_white(F.regexp_replace(text(c), r'[/\\:*?"<>|\x00-\x1f\x7f]', "_")), F.lit("."))
    return F.when(name.rlike(_DEVICES), F.concat(F.lit("_"), name)).otherwise(name)


def body_of(content: Column | str, summary: Column | str) -> Column:
    """The content, or the summary if that is empty."""
    return F.coalesce(F.nullif(text(content), F.lit("")), text(summary))


def looks_like_html(c: Column | str) -> Column:
    return text(c).rlike("<[a-zA-Z][^>]*>")


def escape_bare_amp(c: Column | str) -> Column:
    """& that begins no entity as &amp;"""
    return F.regexp_replace(text(c), "&(?!(#x?[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);)", "&amp;")


#: The elements that are closed.
_VOID = "br|hr|img|input|meta|link|source|area|base|col|embed|param|track|wbr"


def self_close_void(c: Column | str) -> Column:
    """Void elements closed for XML; names that begin like one are closed too."""
    return F.regexp_replace(text(c), f"<({_VOID})([^>]*?)/?>", "<$1$2/>")


def xml_escape(c: Column | str) -> Column:
    """Text for XML.  The column stands here twice: give one that is there, no costly
    expression."""
    out = F.regexp_replace(text(c), r"[^\x{9}\x{a}\x{d}\x{20}-\x{d7ff}\x{e000}-\x{fffd}\x{10000}-\x{10ffff}]", "�")
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;"), ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return F.when(text(c).rlike(_UNSAFE_XML), out).otherwise(text(c))


def body_to_xhtml(body: Column | str, content_type: Column | str) -> Column:
    """HTML made well-formed for XML; plain text as one paragraph with breaks."""
    html = self_close_void(escape_bare_amp(body))
    plain = F.concat(F.lit("<p>"), F.array_join(F.transform(F.split(text(body), "\n"), xml_escape), "<br/>"), F.lit("</p>"))
    return F.when((text(content_type) == "text/html") | looks_like_html(body), html).otherwise(plain)


def parse_tags(c: Column | str) -> Column:
    """JSON text as an array; null if empty or invalid."""
    return F.from_json(F.nullif(text(c), F.lit("")), "array<string>")


def parse_extra(c: Column | str) -> Column:
    """JSON text as a map; null if empty or invalid."""
    return F.from_json(F.nullif(text(c), F.lit("")), "map<string,string>")


#: Fixed values, in seconds: interval if none is set, longest back-off.
DEFAULT_INTERVAL, LONGEST_BACKOFF = 1800, 86_400


def effective_interval(interval: Column | str, fail_count: Column | str, default: int = DEFAULT_INTERVAL) -> Column:
    """Seconds to wait: doubled for each failure up to six, at most a day or the
    interval itself if that is longer."""
    interval, fails = (F.col(c) if isinstance(c, str) else c for c in (interval, fail_count))
    base = F.when(interval > 0, interval).otherwise(F.lit(default if default > 0 else DEFAULT_INTERVAL)).cast("long")
    doubled = base * F.pow(F.lit(2), F.least(fails, F.lit(6))).cast("long")
    return F.when(F.coalesce(fails, F.lit(0)) <= 0, base).otherwise(F.least(doubled, F.greatest(base, F.lit(LONGEST_BACKOFF))))


def register(spark: SparkSession) -> None:
    """SQL functions ``bigram`` and ``sanitize_html`` for a session."""
    from .html import sanitize_udf

    spark.sql(
        r"""CREATE OR REPLACE TEMPORARY FUNCTION bigram(s STRING) RETURNS STRING RETURN
        array_join(transform(regexp_extract_all(coalesce(s, ''), '(\\p{IsHan}+|\\P{IsHan}+)', 1),
            (r, i) -> CASE WHEN NOT r RLIKE '^\\p{IsHan}' THEN r
                ELSE concat(if(i = 0, '', ' '), if(length(r) = 1, r, array_join(transform(sequence(1, greatest(length(r) - 1, 1)), k -> substr(r, k, 2)), ' '))) END), '')"""
    )
    spark.udf.register("sanitize_html", sanitize_udf)

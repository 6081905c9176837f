import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import html, sliced, text, times
from millrace.functions.html import sanitize


def column(spark, values, f, name="x"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_content_hash(spark):
    a, b, c, d = column(spark, ["Hello  World", " hello\tworld ", "hello world!", None], lambda x: text.content_hash(x, F.lit("b")))
    assert len(a) == 32 and a == b and a != c and len(d) == 32
    assert column(spark, ["", None, "x"], lambda x: text.identity_hash(x, x))[:2] == ["", ""]


def test_normalize_text(spark):
    got = column(spark, ["ΑΣ", "A 　B c", None, "İ"], text.normalize_text)
    assert got == ["ας".replace("ς", "σ"), "a b c", "", "i"]


URLS = {
    "https://Example.com/Post#frag": "https://example.com/Post",
    "https://example.com/path/": "https://example.com/path",
    "https://example.com/": "https://example.com/",
    "  https://example.com/a  ": "https://example.com/a",
    "HTTP://A.com//": "http://a.com",
    "https://a.com?q=1/#x": "https://a.com?q=1/",
    "https://a.com/b///?q": "https://a.com/b?q",
    "example.com/path": "example.com/path",
    "mailto:a@b.c": "mailto:a@b.c",
    "": "",
    "https://a.com/a b/": "https://a.com/a%20b",
    "https://A.com/é": "https://a.com/%C3%A9",
    "https://a.com/%zz": "https://a.com/%zz",
    "https://a.com:x/": "https://a.com:x/",
    "https://User@A.com/x/": "https://User@a.com/x",
    "https://a.com/x%2Fy": "https://a.com/x%2Fy",
}


def test_normalize_url(spark):
    assert column(spark, [*URLS, None], text.normalize_url) == [*URLS.values(), ""]


def bigrams_by_loop(s):
    import regex

    out = ""
    for run in regex.findall(r"\p{Han}+|\P{Han}+", s):
        if regex.match(r"\p{Han}", run):
            for piece in [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]:
                out += (" " if out else "") + piece
        else:
            out += run
    return out


def test_bigrams(spark):
    values = ["雨后山路v2很滑", "春夏秋", "雪", "", None, "x 河流 y", "湖边有三只鹤"]
    got = column(spark, values, text.bigram_tokenize)
    assert got == [bigrams_by_loop(v or "") for v in values] and got[0] == "雨后 后山 山路v2 很滑"
    assert column(spark, ["山路v2很滑"], lambda x: text.bigram_tokenize(x, split_after_han=True)) == ["山路 v2 很滑"]
    text.register(spark)
    assert [spark.sql("SELECT bigram(:v)", {"v": v}).first()[0] for v in values if v is not None] == [g for g, v in zip(got, values) if v is not None]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("山河雪q k7", max_size=12), min_size=1, max_size=20))
def test_bigrams_match_a_loop(spark, values):
    assert column(spark, values, text.bigram_tokenize) == [bigrams_by_loop(v) for v in values]


def test_tokens_and_terms(spark):
    assert column(spark, ["Über-Größe ΜΣ 7x"], text.index_tokens) == [["uber", "große", "μσ", "7x"]]
    assert column(spark, ["left_right 河流 +"], text.search_terms) == [[["left", "right"], ["河流"]]]


def name_by_loop(s):
    kept = "".join("_" if c in '/\\:*?"<>|' or ord(c) < 32 or ord(c) == 127 else c for c in s).strip().strip(".")
    devices = {"CON", "PRN", "AUX", "NUL"} | {f"{d}{k}" for d in ("COM", "LPT") for k in range(1, 10)}
    return f"_{kept}" if kept.upper() in devices else kept


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.text('q/\\:*?"<>|.\x02 é雪', max_size=10), st.sampled_from(["nul", "Lpt4", "com0", "LPT10", "aux.", " prn "])), min_size=1, max_size=20))
def test_names_match_a_loop(spark, values):
    assert column(spark, values, text.safe_name) == [name_by_loop(v) for v in values]


def test_missing_names_and_months(spark):
    assert column(spark, [None, "", "draft\x7f2?"], text.safe_name) == ["", "", "draft_2_"]
    rows = spark.sql("SELECT * FROM VALUES (TIMESTAMP'2019-11-30', TIMESTAMP'2020-02-29'), (NULL, TIMESTAMP'2020-02-29'), (NULL, NULL) AS t(p, f)")
    assert [r[0] for r in rows.select(text.month_of("p", "f")).collect()] == ["2019-11", "2020-02", "unknown"]


@pytest.mark.parametrize("name", ["br", "hr", "img", "wbr", "source", "track"])
def test_void_elements_are_closed(spark, name):
    html = f'<b>1 & 2</b><{name} id="k">&copy;&#x41;<{name}/><{name}>'
    want = f'<b>1 &amp; 2</b><{name} id="k"/>&copy;&#x41;<{name}/><{name}/>'
    assert column(spark, [html], lambda x: text.body_to_xhtml(x, F.lit("text/html"))) == [want]


def test_plain_bodies_and_escapes(spark):
    assert column(spark, ["1 > 0\nnext & last\n"], lambda x: text.body_to_xhtml(x, F.lit("text/plain"))) == ["<p>1 &gt; 0<br/>next &amp; last<br/></p>"]
    assert column(spark, ["'q'\t\"r\"\x02\r\n"], text.xml_escape) == ["&#39;q&#39;&#x9;&#34;r&#34;\ufffd&#xD;&#xA;"]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 700_000), st.integers(0, 40)), min_size=1, max_size=20), st.integers(60, 5000))
def test_intervals_match_a_loop(spark, rows, default):
    def by_loop(interval, fails):
        base = wait = interval if interval > 0 else default
        for _ in range(min(fails, 6)):
            wait *= 2
        return base if fails == 0 else min(wait, max(base, 24 * 3600))

    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a int, b int")
    got = [r.got for r in df.select("i", text.effective_interval("a", "b", default).alias("got")).orderBy("i").collect()]
    assert got == [by_loop(a, b) for a, b in rows]


TIMES = {
    "2023-01-02T03:04:05Z": "2023-01-02 03:04:05", "2023-01-02T03:04:05.5+08:00": "2023-01-01 19:04:05", "Mon, 02 Jan 2023 03:04:05 +0100": "2023-01-02 02:04:05",
    "Mon, 02 Jan 2023 03:04:05 GMT": "2023-01-02 03:04:05", "Tue, 02 Jan 2023 03:04:05 PST": "2023-01-02 03:04:05", "02 Jan 23 03:04 -0200": "2023-01-02 05:04:00", "02 Jan 70 03:04 UTC": "1970-01-02 03:04:00",
    "2023-01-02T03:04:05": "2023-01-02 03:04:05", "2023-01-02 03:04:05": "2023-01-02 03:04:05", "2023-01-02": "2023-01-02 00:00:00", "Mon, 2 Jan 2023 03:04:05 GMT": None, "soon": None, "": None, "2023-13-02": None,
}


def test_feed_times(spark):
    got = column(spark, list(TIMES), lambda x: F.date_format(F.date_trunc("second", times.parse_feed_time(x)), "yyyy-MM-dd HH:mm:ss"))
    assert got == list(TIMES.values())


def test_viewed_at(spark):
    got = column(spark, ["2024-01-01T08:00:00", "2024-01-01T08:00:00+02:00", "x"], lambda x: times.stamp(times.parse_viewed_at(x, "Asia/Shanghai")))
    assert got == ["2024-01-01T00:00:00Z", "2024-01-01T06:00:00Z", ""]


ALLOWED = {"b", "p", "i", "em", "ul", "li", "code", "strong", "blockquote"}
SCRIPTED = ["script", "style", "iframe", "object", "svg", "form", "input", "button", "math", "template"]
HANDLERS = ["onclick", "ONFOCUS", "onmouseover", "onwheel", "srcdoc", "formaction", "style"]
SCHEMES = ["javascript", "JaVaScRiPt", "vbscript", "data", "java\tscript", " javascript"]


@given(st.sampled_from(SCRIPTED), st.sampled_from(HANDLERS), st.sampled_from(SCHEMES), st.sampled_from(["a", "img", "p"]), st.booleans())
def test_sanitize_drops(element, handler, scheme, carrier, upper):
    call = "steal(7)"
    element = element.upper() if upper else element
    fragment = f'<p>kept</p><{element} {handler}="{call}">{call}</{element}><{carrier} {handler}="{call}" href="{scheme}:{call}" src="{scheme}:{call}">t</{carrier}><p>end</p>'
    out = sanitize(fragment).lower()
    assert f"<{element.lower()}" not in out and f"{handler.lower()}=" not in out and f"{scheme.strip().lower()}:" not in out
    assert out.startswith("<p>kept</p>") and "script:" not in out


@given(st.recursive(st.text("xyz é雪", min_size=1, max_size=6), lambda inner: st.tuples(st.sampled_from(sorted(ALLOWED - {"p", "li"})), inner).map(lambda t: f"<{t[0]}>{t[1]}</{t[0]}>"), max_leaves=5))
def test_sanitize_keeps_allowed_elements(fragment):
    assert sanitize(fragment) == fragment and sanitize(sanitize(fragment)) == fragment


def test_sanitize_links_and_texts():
    table = "<table><thead><tr><th>Year</th></tr></thead><tbody><tr><td>1987</td></tr></tbody></table>"
    assert sanitize(table) == table
    assert sanitize('<a href="http://host.test/p?k=1&amp;m=2" title="more">go</a>') == '<a href="http://host.test/p?k=1&amp;m=2" title="more" rel="nofollow">go</a>'
    assert sanitize('<img src="cat/1.jpg" alt="a cat">') == '<img src="cat/1.jpg" alt="a cat">'
    assert sanitize("") == sanitize(None) == "" and sanitize("1 < 2 & 3") == "1 &lt; 2 &amp; 3"


def test_only_marked_fragments_leave_the_jvm_and_equal_ones_once(spark, monkeypatch):
    def seen(fragment):
        return fragment and "seen " + fragment

    monkeypatch.setattr(html, "sanitize_udf", sliced.sliced_udf(seen, T.StringType()))
    rows = [("text/html", "plain", "plain"), ("text/html", "<b>", "<b>"), ("text/html", "plain", "a & b"), ("text/plain", "<i>", "<i>"), ("text/html", None, "&"), ("text/html", "&", None)]
    got = html.sanitize_items(spark.createDataFrame(rows, "content_type string, content string, summary string"))
    assert sorted((r.content, r.summary) for r in got.collect()) == sorted([("plain", "plain"), ("seen <b>", "seen <b>"), ("plain", "seen a & b"), ("<i>", "<i>"), ("", "seen &"), ("seen &", "")])

    def marked_only(fragment):
        if fragment and not set(fragment) & set("<>&\"'"):
            raise ValueError(f"{fragment!r} has no markup")
        return fragment

    monkeypatch.setattr(html, "sanitize_udf", sliced.sliced_udf(marked_only, T.StringType()))
    assert html.sanitize_items(spark.createDataFrame(rows, "content_type string, content string, summary string")).agg(F.count("content")).first()[0] == len(rows)


def test_white_space_and_xml_of_every_character(spark):
    white = set("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(x) for x in range(0x2000, 0x200B)}
    every = [chr(x) for x in (*range(0xD800), *range(0xE000, 0x11000))]
    values = [f"{c}a{c}{c}b {c}c{c} d" for c in every]
    wanted = [" ".join("".join(" " if x in white else x for x in v).split(" ")).strip(" ") for v in values]
    while any("  " in w for w in wanted):
        wanted = [w.replace("  ", " ") for w in wanted]
    assert column(spark, values, text.collapse_white) == wanted
    entities = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&#34;", "'": "&#39;", "\t": "&#x9;", "\n": "&#xA;", "\r": "&#xD;"}
    escaped = ["\ufffd" if c < " " and c not in entities or c in "\ufffe\uffff" else entities.get(c, c) for c in every]
    assert column(spark, every, text.xml_escape) == escaped

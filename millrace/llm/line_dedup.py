"""Line dedup by winnowing.

The window of a line is the shortest stretch from it on that holds at least
``min_words`` words.  The position of the least line hash of every window is
selected, once for all windows that share it: consecutive windows mostly do.  Any
run of that many words which occurs twice has the same window in both places, so
the same position of it is selected in both.

Selected positions meet by their hash; those whose hash is selected at no other
position are done with.  From the rest, matches are extended both ways: to the left
to every line whose window selected the position, from there to the right to every
line at which a stretch of ``min_words`` words ends, or begins if read backwards.
Equal stretches meet at their first, and the later ones go.  They overlap from line
to line and end where a maximal run ends, so together they are that run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

_SPACES = " \t\n\x0b\x0c\r"
_NO_ID = -(1 << 63)


def _lines(text: Column) -> Column:
    """(no, h, w) of every line with a word: number, hash of the trimmed line, words."""
    every = F.transform(
        F.split(text, "\n"),
        lambda x, i: F.struct(i.alias("no"), F.xxhash64(F.btrim(x, F.lit(_SPACES))).alias("h"), F.regexp_count(x, F.lit(r"[^ \t-\r]+")).alias("w")),
    )
    return F.filter(every, lambda x: x["w"] > 0)


def _minima(lines: Column, min_words: int) -> Column:
    """The number of the least hash's line (the first of equal ones) in the window of
    every line that has one; a line has a word at least, so ``min_words`` lines are
    enough to look at.  Lines without a window are the last ones."""
    start = F.struct(F.lit(0).alias("w"), F.lit((1 << 63) - 1).alias("least"), F.lit(-1).alias("at"))

    def add(a: Column, y: Column) -> Column:
        lower = (y["h"] < a["least"]) | (a["at"] < 0)
        longer = F.struct((a["w"] + y["w"]).alias("w"), F.least(a["least"], y["h"]).alias("least"), F.when(lower, y["no"]).otherwise(a["at"]).alias("at"))
        return F.when(a["w"] >= min_words, a).otherwise(longer)

    found = F.transform(lines, lambda x, i: F.aggregate(F.slice(lines, i + 1, F.lit(min_words)), start, add))
    return F.filter(found, lambda x: x["w"] >= min_words)


def _selected(minima: Column) -> Column:
    """(at, fp, a, b) of every selected position: windows a to b, counted from 0,
    selected it.  Positions of minima never go back, so these are consecutive."""
    last = F.size(minima) - 1
    begins = F.filter(F.transform(minima, lambda x, i: F.when((i == 0) | (x["at"] != F.get(minima, i - 1)["at"]), i)), lambda i: i.isNotNull())
    ends = F.filter(F.transform(minima, lambda x, i: F.when((i == last) | (x["at"] != F.get(minima, i + 1)["at"]), i)), lambda i: i.isNotNull())
    return F.transform(
        F.arrays_zip(begins.alias("a"), ends.alias("b")),
        lambda z: F.struct(F.get(minima, z["a"])["at"].alias("at"), F.get(minima, z["a"])["least"].alias("fp"), z["a"].alias("a"), z["b"].alias("b")),
    )


def _stretches(lines: Column, i: Column, min_words: int) -> Column:
    """(high, h) of the stretches from line i on that hold ``min_words`` words, but
    don't without their last line or don't without their first: last line, hash."""
    start = F.struct(F.lit(0).alias("w"), F.lit(0).alias("rest"), F.lit(42).cast("long").alias("h"), F.array().cast("array<struct<high:int,h:bigint>>").alias("out"))

    def add(a: Column, y: Column) -> Column:
        w, rest, h = a["w"] + y["w"], F.when(a["w"] == 0, 0).otherwise(a["rest"] + y["w"]), F.xxhash64(a["h"], y["h"])
        ends = (w >= min_words) & ((a["w"] < min_words) | (rest < min_words))
        out = F.when(ends, F.array_append(a["out"], F.struct(y["no"].alias("high"), h.alias("h")))).otherwise(a["out"])
        return F.struct(w.alias("w"), rest.alias("rest"), h.alias("h"), out.alias("out"))

    # without its first line a stretch has fewer lines than words, so no more than min_words lines
    return F.aggregate(F.slice(lines, i + 1, F.lit(min_words)), start, add, lambda a: a["out"])


def repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """k1, k2 (doc_id and hash of the text), runs (array of first and last line
    number) of every document that holds a later copy of a run.  Where a run
    overlaps its first copy, the first stays whole."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("k1"), F.xxhash64(text).alias("k2"), _lines(text).alias("lines"))
    lines = written(keyed, "lines")
    # the explode of one element holds the minima, which would be sought again for each position
    seeds = lines.select("k1", "k2", F.explode(F.array(_minima(F.col("lines"), min_words))).alias("minima"))
    seeds = written(seeds.select("k1", "k2", F.inline(_selected(F.col("minima")))), "positions")
    place = F.struct("k1", "k2", "at")
    # tables of their own, so that a join with a frequent hash can be split
    met = written(seeds.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("fp"), "met-prints")
    met = seeds.join(met, "fp").groupBy("k1", "k2").agg(F.collect_set(F.struct("fp", "a", "b")).alias("seeds"))
    # one array a document; lines exploded beside it would be copied for each position

    def grow(x: Column, i: Column) -> Column:
        low = F.get("lines", i)["no"].alias("low")
        return F.transform(_stretches(F.col("lines"), i, min_words), lambda z: F.struct(x["fp"].alias("fp"), low, z["high"].alias("high"), z["h"].alias("h")))

    grown = F.flatten(F.transform("seeds", lambda x: F.flatten(F.transform(F.sequence(x["a"], x["b"]), lambda i: grow(x, i)))))
    grown = written(lines.join(met, ["k1", "k2"]).select("k1", "k2", F.inline(grown)), "stretches")
    place = F.struct("k1", "k2", "low", "high")
    firsts = grown.groupBy("fp", "h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    firsts = written(firsts.select("fp", "h", "first"), "first-runs")
    later = grown.join(firsts, ["fp", "h"]).where(F.struct("k1", "k2", "low") > F.struct("first.k1", "first.k2", "first.low"))
    own = (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))
    later = later.withColumn("low", F.when(own, F.greatest("low", F.col("first.high") + 1)).otherwise(F.col("low"))).where("low <= high")
    return later.groupBy("k1", "k2").agg(F.collect_set(F.struct("low", "high")).alias("runs"))


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs with later copies of runs of lines cut out of ``text``, and
    ``n_dropped``, the number of lines that went.

    A run counts from ``min_words`` words on; lines are compared without outer
    white space, lines without a word have no part and stay.  The order of
    documents is (doc_id, hash of the text), null ids first.  A column n_dropped
    of docs is replaced.  Rows that agree in
    both are one document and come out alike.  Null texts stay null.  Only
    built-in functions; no pairs of occurrences are formed, each meets the first.
    """
    runs = repeated_runs(docs, min_words)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("k1"), F.xxhash64(text).alias("k2"),
    )
    # the explode of one element holds the lines, which would be split again for each line
    found = whole.join(runs, ["k1", "k2"], "left").select("row", "runs", F.explode(F.array(F.split("row.text", "\n"))).alias("lines"))
    within = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["low"], r["high"]))))
    blank = F.filter(F.transform("lines", lambda x, i: F.when(~x.rlike(r"[^ \t-\r]"), i)), lambda i: i.isNotNull())
    found = found.withColumn("gone", F.array_except(within, blank))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    cut = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    columns = [F.when(F.col("runs").isNull(), F.col("row.text")).otherwise(cut).alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "n_dropped"]
    return found.select(*columns, F.when(F.col("runs").isNull(), F.lit(0)).otherwise(F.size("gone")).alias("n_dropped"))


def without_copies(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs after :func:`dedup_lines` without the rows of which nothing was left; a
    column n_chars is set anew where lines went.  Null and empty texts stay, as do
    all columns and the order of them."""
    held = "n_dropped"
    while held in docs.columns:
        held = f"_{held}"  # a name that docs doesn't have
    cut = dedup_lines(docs.withColumnRenamed("n_dropped", held), min_words)
    kept = cut.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^ \t-\r]"))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        kept = kept.withColumn("n_chars", F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(length))
    return kept.select(*(F.col(f"`{held}`").alias(c) if c == "n_dropped" else F.col(f"`{c}`") for c in docs.columns))


_SQL_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL = f"""
WITH every AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, no, trim(line, {_SQL_TRIM}) AS line, len(regexp_extract_all(line, '[^ \\t-\\r]+')) AS w FROM every),
l AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY no) AS q, sum(w) OVER (PARTITION BY doc_id ORDER BY no) - w AS p FROM w WHERE w > 0),
spans AS (SELECT 'f' AS kind, a.doc_id, a.no AS low, min(b.no) AS high FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.no >= a.no AND b.q - a.p >= 50 GROUP BY a.doc_id, a.no
    UNION ALL SELECT 'b', a.doc_id, max(b.no), a.no FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.no <= a.no AND a.q - b.p >= 50 GROUP BY a.doc_id, a.no),
c AS (SELECT kind, s.doc_id, low, high, string_agg(line, chr(10) ORDER BY no) AS content FROM spans s JOIN l ON l.doc_id = s.doc_id AND no BETWEEN low AND high GROUP BY ALL),
firsts AS (SELECT *, min({{'d': doc_id, 'low': low, 'high': high}}) OVER (PARTITION BY kind, content) AS first FROM c),
later AS (SELECT doc_id, CASE WHEN doc_id = first.d THEN greatest(low, first.high + 1) ELSE low END AS low, high FROM firsts WHERE doc_id > first.d OR low > first.low),
gone AS (SELECT DISTINCT l.doc_id, no FROM later JOIN l ON l.doc_id = later.doc_id AND no BETWEEN low AND high),
cut AS (SELECT e.doc_id, string_agg(line, chr(10) ORDER BY e.no) FILTER (g.no IS NULL) AS text, count(g.no) AS n FROM every e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.no = e.no GROUP BY e.doc_id)
SELECT d.doc_id, CASE WHEN n > 0 THEN coalesce(cut.text, '') ELSE d.text END AS text, coalesce(n, 0) AS n_dropped FROM documents d LEFT JOIN cut USING (doc_id)
"""

"""Quality rules with cutoffs whose risk is controlled.

Every text is measured inside its row with built-in functions.  Rules and their
cutoffs form one sequence of steps, each of which rejects all that the steps before
it reject and more.  Labelled rows are the holdout: in each stratum the steps are
tested in that order, by exact binomial bounds, on the share of good documents that
all rules together reject, up to the first that is not certified.  Tests in a fixed
order share one error level; only the strata divide it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

_SPACE = r"[ \t-\r]+"
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = r"[#*$%&|<>]"

#: Share of good documents that all rules together may reject in a stratum, and the
#: chance that they reject more in any of the strata.
FALSE_REJECTION, ERROR = 0.02, 0.05

#: The steps: rules (a higher value is worse) and their cutoffs, mildest first.
GRID: dict[str, list[float]] = {
    "symbols": [0.8, 0.4, 0.2, 0.1, 0.05, 0.02],
    "long_words": [40.0, 20.0, 15.0, 12.0, 10.0, 9.0],
    "short_words": [-1.5, -2.0, -2.5, -3.0, -3.5, -4.0],
    "repeats": [0.25, 0.2, 0.15, 0.1, 0.05, 0.02],
    "dup_lines": [0.9, 0.7, 0.5, 0.3, 0.2, 0.1],
}
STEPS = [(rule, cutoff) for rule, cutoffs in GRID.items() for cutoff in cutoffs]


def measured(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    (long) and base_failed; columns of these names are replaced.

    Null texts have no words.  Windows of eight words are told apart by 64-bit
    hashes that combine by doubling (1, 2, 4, 8 words), so the work is linear in
    the text, and only texts with a repeated window sort their windows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(_SPACES))
    found = docs.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE)))
    found = found.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):
        later = F.slice("_hash", F.lit(step + 1), F.size("_words"))
        found = found.withColumn("_hash", F.zip_with("_hash", later, lambda a, b: F.xxhash64(a, b)))
    found = found.withColumn("_hash", F.slice("_hash", F.lit(1), F.greatest(F.size("_words") - 7, F.lit(0))))
    placed = F.array_sort(F.transform("_hash", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    found = found.withColumn("_placed", F.when(F.size(F.array_distinct("_hash")) < F.size("_hash"), placed))
    equal = F.filter(
        F.zip_with("_placed", F.slice("_placed", F.lit(2), F.size("_placed")), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"]))),
        lambda x: x.isNotNull(),
    )
    found = found.withColumn("_starts", F.array_sort(F.array_distinct(F.flatten(equal))))
    steps = F.zip_with("_starts", F.slice("_starts", F.lit(2), F.size("_starts")), lambda x, y: F.least(F.coalesce(y - x, F.lit(8)), F.lit(8)))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    found = found.withColumn("_lines", lines)
    out = {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, _SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
    }
    found = found.withColumns(out).drop("_words", "_hash", "_placed", "_starts", "_lines")
    return found.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _measure(rule: str) -> Column:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "long_words": F.col("word_chars") / words,
        "short_words": -F.col("word_chars") / words,
    }[rule]


def _log_gamma(x: Column) -> Column:
    """log of the gamma function for x >= 1, by Stirling's series beyond 10."""
    y = x + 10
    low = F.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4)) + F.log((x + 5) * (x + 6) * (x + 7) * (x + 8) * (x + 9))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - low


def log_binomial_tail(k: Column, n: Column, p: float) -> Column:
    """log P(X <= k) for X ~ Binomial(n, p), exact but for rounding: terms are summed
    from the k-th down, relative to it, as far as they matter (some deviations)."""
    k, n = k.cast("double"), n.cast("double")
    reach = 10 * F.sqrt(n * p * (1 - p)) + 40
    above = F.greatest(k - n * p, F.lit(0.0))
    count = F.least(k, F.ceil(above + reach)).cast("int")

    def add(acc: Column, j: Column) -> Column:
        term = acc["term"] * (k - j) / (n - k + j + 1) * ((1 - p) / p)  # of k - j - 1
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    terms = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    last = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p)
    return F.when((k >= n) | (above > reach), F.lit(0.0)).otherwise(last + F.aggregate(terms, start, add, lambda a: F.log(a["sum"])))


def _with_step(rows: DataFrame) -> DataFrame:
    """Adds ``stratum``, the language, and ``step``, the first that rejects the row."""
    first = F.coalesce(*(F.when(_measure(rule) > cutoff, F.lit(k)) for k, (rule, cutoff) in enumerate(STEPS)))
    return rows.withColumns({"step": first, "stratum": F.coalesce(F.col("lang").cast("string"), F.lit(""))})


def certified_steps(measures: DataFrame, labels: DataFrame, false_rejection: float = FALSE_REJECTION, error: float = ERROR) -> DataFrame:
    """stratum, last: the step up to which rows of a language are rejected, from
    measured rows (doc_id, lang, the measures) and labels (doc_id, quality).

    The holdout is every labelled row that passes the base rules.  A step is
    certified if it and all before it have P(X <= rejected good | n good,
    false_rejection) of error / languages at most.  Of the certified ones that with
    most bad rows rejected beyond the good ones is taken, the mildest of equals, and
    none if that is not positive.  Languages with too few good rows for any
    certificate are tested together, and share what is certified for all of them.
    Rows without a label, or with a null one, have no part; with several labels the
    worst holds.
    """
    worst = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    held = _with_step(measures.where("NOT base_failed")).join(worst, "doc_id")
    counts = written(held.groupBy("stratum", "step").agg(F.count_if("good").alias("k"), F.count_if(~F.col("good")).alias("bad")), "step-counts")
    languages = counts.groupBy("stratum").agg(F.sum("k").alias("n"))
    level = math.log(error / max(1, languages.count()))
    few = F.col("n") < math.ceil(level / math.log(1 - false_rejection))
    pools = written(languages.select("stratum", F.when(~few, F.col("stratum")).alias("pool")), "pools")  # null: tested together
    steps = F.explode(F.sequence(F.lit(0), F.lit(len(STEPS) - 1))).alias("step")
    met = counts.join(pools, "stratum")
    pooled = met.groupBy("pool", "step").agg(F.sum("k").alias("k"), F.sum("bad").alias("bad"))
    sizes = pooled.groupBy("pool").agg(F.sum("k").alias("n")).select("pool", "n", steps)
    upto = W.partitionBy("pool").orderBy("step")
    same = (F.col("a.step") == F.col("b.step")) & F.col("a.pool").eqNullSafe(F.col("b.pool"))
    every = sizes.alias("a").join(pooled.alias("b"), same, "left").select("a.pool", "a.step", "n", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("bad", F.lit(0)).alias("bad"))
    every = every.withColumns({"k": F.sum("k").over(upto), "bad": F.sum("bad").over(upto)})  # a row a step
    passed = F.min(log_binomial_tail(F.col("k"), F.col("n"), false_rejection) <= level).over(upto)
    gain = F.col("bad") - F.col("k")
    best = every.withColumn("passed", passed).where(F.col("passed") & (gain > 0)).groupBy("pool").agg(F.max_by("step", F.struct(gain, -F.col("step"))).alias("last"))
    return pools.alias("a").join(best.alias("b"), F.col("a.pool").eqNullSafe(F.col("b.pool"))).select("a.stratum", "b.last")


#: Strata up to this number are broadcast (some hundred bytes each).
_BROADCAST_STRATA = 10_000


def _verdict(rows: DataFrame, lasts: DataFrame) -> DataFrame:
    """Adds ``kept``; drops the helper columns."""
    lasts = written(lasts, "certified")
    if lasts.count() <= _BROADCAST_STRATA:
        lasts = F.broadcast(lasts)
    judged = _with_step(rows).join(lasts, "stratum", "left")
    rejected = F.coalesce(F.col("step") <= F.col("last"), F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("stratum", "step", "last")


def judge(docs: DataFrame, labels: DataFrame, false_rejection: float = FALSE_REJECTION, error: float = ERROR) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept for every row of docs (doc_id, text, lang).

    Texts are measured once; only the measures are written and joined.  A null
    lang is a stratum of its own; without labels only the base rules reject.  Null,
    empty and very short texts fail the base rules; rows that repeat an id are judged
    each for itself and count each in the holdout; an empty table gives no rows.
    """
    measures = written(measured(docs.select("doc_id", "text", "lang")).drop("text"), "measures")
    judged = _verdict(measures, certified_steps(measures, labels, false_rejection, error))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, false_rejection: float = FALSE_REJECTION, error: float = ERROR) -> DataFrame:
    """The rows of docs that :func:`judge` keeps, with all their columns; a table
    without ``lang`` is one stratum.

    Rows that pass the base rules are written once with their measures, from which
    the steps are certified and the verdicts are read.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    whole = docs.select("doc_id", "text", lang.alias("lang"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    names = [*MEASURES, "base_failed"]
    # filters don't pass an explode; they would repeat the measuring for each of their columns
    once = measured(whole).select("doc_id", "lang", "row", F.explode(F.array(F.struct(*names))).alias("m")).select("doc_id", "lang", "row", "m.*")
    measures = written(once.where("NOT base_failed"), "measures")
    return _verdict(measures, certified_steps(measures, labels, false_rejection, error)).where("kept").select("row.*")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _sql_measures() -> str:
    ratio = {"symbols": "n_symbols / greatest(n_words, 1)", "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)", "long_words": "word_chars / greatest(n_words, 1)", "short_words": "-word_chars / greatest(n_words, 1)"}
    return " UNION ALL ".join(f"SELECT *, '{rule}' AS rule, {ratio[rule]} AS measure FROM m" for rule in GRID)


_SQL_WORD = r"[^ \t-\r]+"

ORACLE_SQL = f"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SQL_WORD}') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_SQL_WORD}')) AS lines FROM documents),
g AS (SELECT doc_id, unnest(range(len(words) - 7)) AS i, words FROM w WHERE len(words) >= 8),
h AS (SELECT doc_id, i, array_to_string(words[i + 1:i + 8], ' ') AS win FROM g),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM h) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM r) GROUP BY doc_id),
m0 AS (SELECT doc_id, coalesce(lang, '') AS stratum, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m0),
mr AS ({_sql_measures()}),
good AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
cuts AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{rule}', {c}::DOUBLE)" for k, (rule, c) in enumerate(STEPS))}) AS t(step, rule, cutoff)),
st AS (SELECT doc_id, stratum, base_failed, min(step) FILTER (measure > cutoff) AS step FROM mr JOIN cuts USING (rule) GROUP BY ALL),
held AS (SELECT stratum, step, good FROM st JOIN good USING (doc_id) WHERE NOT base_failed),
lang AS (SELECT stratum, count(*) FILTER (good) AS n, {ERROR} / (SELECT greatest(count(DISTINCT stratum), 1) FROM held) AS level FROM held GROUP BY stratum),
pool AS (SELECT stratum, level, CASE WHEN n >= ceil(ln(level) / ln(1 - {FALSE_REJECTION})) THEN stratum ELSE ' few' END AS pool FROM lang),
ph AS (SELECT pool, level, step, good FROM held JOIN pool USING (stratum)),
t AS (SELECT pool, level, s.step, count(*) FILTER (good) AS n, count(*) FILTER (good AND ph.step <= s.step) AS k, count(*) FILTER (NOT good AND ph.step <= s.step) AS bad FROM ph, (SELECT step FROM cuts) s GROUP BY ALL),
tail AS (SELECT *, CASE WHEN k >= n THEN 1.0 ELSE list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({FALSE_REJECTION}) + (n - i) * ln(1 - {FALSE_REJECTION})))) END AS p FROM t),
passed AS (SELECT *, max(p) OVER (PARTITION BY pool ORDER BY step) <= level AS ok FROM tail),
best AS (SELECT pool, arg_max(step, (bad - k) * 1000 - step) AS last FROM passed WHERE ok AND bad > k GROUP BY pool),
hit AS (SELECT DISTINCT doc_id FROM st JOIN pool USING (stratum) JOIN best USING (pool) WHERE step <= last)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND hit.doc_id IS NULL AS kept
FROM m LEFT JOIN hit USING (doc_id)
"""

"""Full-text search: every phrase of a query must occur, newest first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import bigram_tokenize, index_tokens, search_terms, text, trim_white

from .listing import filter_entries, newest_first, page_of
from .tables import written

COLUMNS = ("title", "summary", "content", "author")
#: Buckets by token hash in which an index is laid out.
BUCKETS = 64
#: Tokens in a row that are looked up together in the search for phrases.
GRAM = 3


def column_tokens(c: str) -> Column:
    return index_tokens(bigram_tokenize(text(c)))


def _holds(tokens: Column, phrase: list[str]) -> Column:
    if len(phrase) == 1:
        return F.array_contains(tokens, phrase[0])
    want = F.array(*(F.lit(t) for t in phrase))
    starts = F.when(F.size(tokens) >= len(phrase), F.sequence(F.lit(1), F.size(tokens) - len(phrase) + 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(starts, lambda i: F.slice(tokens, i, F.lit(len(phrase))) == want)


def query_phrases(df: DataFrame, q: str) -> list[list[str]]:
    """The phrases of one query; ValueError if nothing is left of it."""
    raw = df.sparkSession.range(1).select(search_terms(F.lit(q)).alias("t"), (trim_white(bigram_tokenize(F.lit(q))) == "").alias("empty")).first()
    if raw["empty"]:
        raise ValueError("empty query")
    return raw["t"]


def matching_entries(entries: DataFrame, q: str, state: DataFrame | None = None, **filters) -> DataFrame:
    """Entries that hold every phrase in some column, by one scan."""
    phrases = query_phrases(entries, q)
    found = filter_entries(entries, state, **filters)
    if not phrases:
        return found.limit(0)
    tokens = found.withColumns({f"_t_{c}": column_tokens(c) for c in COLUMNS})
    for phrase in phrases:
        hit = F.lit(False)
        for c in COLUMNS:
            hit = hit | _holds(F.col(f"_t_{c}"), phrase)
        tokens = tokens.where(hit)
    return tokens.select(entries.columns)


def search_entries(entries: DataFrame, q: str, state: DataFrame | None = None, page: int = 1, page_size: int | None = None, **filters) -> tuple[DataFrame, DataFrame]:
    """(page, total) of the entries that match."""
    found = matching_entries(entries, q, state, **filters)
    return page_of(found.orderBy(*newest_first()), page, page_size), found.agg(F.count("*").alias("total"))


def build_search_index(entries: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """entry_id, col, pos, token, bucket of all undeleted entries; to be written
    with partitionBy("bucket")."""
    live = entries.where(~F.col("deleted"))
    lists = live.select(F.col("id").alias("entry_id"), F.explode(F.array(*(F.struct(F.lit(c).alias("col"), column_tokens(c).alias("tokens")) for c in COLUMNS))).alias("x"))
    each = lists.select("entry_id", "x.col", F.posexplode("x.tokens").alias("pos", "token"))
    return each.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))


def update_search_index(index: DataFrame, changed: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """index with the tokens of the changed entries as they are now; deleted ones
    have none."""
    kept = index.join(changed.select(F.col("id").alias("entry_id")).distinct(), "entry_id", "left_anti").select(index.columns)
    return kept.unionByName(build_search_index(changed, buckets).select(index.columns))


def search_batch(queries: DataFrame, index: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """query_id, entry_id of all matches of many queries (query_id, q).

    Phrases that several queries share are looked up once.  A word is held by the
    entries of its postings.  For longer phrases the asked tokens of each column meet
    in order, once for all phrases, and each run of GRAM of them votes for where a
    phrase would begin; a place with all votes holds it, an entry with all phrases
    matches.  So a frequent token costs its postings once, not once a query.
    """
    terms = queries.select("query_id", search_terms("q").alias("terms")).where(F.size("terms") > 0)
    phrases = written(terms.select("query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("tokens")).groupBy("query_id", "n_terms", "tokens").agg(F.count("*").alias("uses")), "phrases")
    asked = written(phrases.select("tokens").distinct(), "asked")
    lengths = sorted(r[0] for r in asked.select(F.least(F.size("tokens"), F.lit(GRAM))).distinct().collect())  # at most GRAM
    hits = []
    if 1 in lengths:
        words = asked.where("size(tokens) = 1").select("tokens", F.col("tokens")[0].alias("token"))
        hits.append(index.select("entry_id", "token", "bucket").join(_in_buckets(words, buckets), ["bucket", "token"]).select("tokens", "entry_id"))
    if lengths and lengths[-1] > 1:
        hits.append(_phrase_hits(asked.where("size(tokens) > 1"), index, [n for n in lengths if n > 1], buckets))
    if not hits:
        return index.select(F.lit(None).cast("long").alias("query_id"), "entry_id").limit(0)
    found = reduce(DataFrame.unionByName, hits).distinct().join(phrases, "tokens")
    alone = found.where("n_terms = uses").select("query_id", "entry_id")
    several = found.where("n_terms > uses").groupBy("query_id", "n_terms", "entry_id").agg(F.sum("uses").alias("n")).where("n = n_terms")
    return alone.unionByName(several.select("query_id", "entry_id"))


def _in_buckets(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))


def _phrase_hits(asked: DataFrame, index: DataFrame, lengths: list[int], buckets: int) -> DataFrame:
    """tokens, entry_id where phrases (tokens) of several tokens occur; ``lengths`` are
    those of the runs that vote."""
    known = _in_buckets(asked.select(F.explode("tokens").alias("token")).distinct(), buckets)
    places = index.join(known, ["bucket", "token"], "left_semi").select("entry_id", "col", "pos", "token")
    order = W.partitionBy("entry_id", "col").orderBy("pos")
    after = lambda k: F.when(F.lead("pos", k).over(order) == F.col("pos") + k, F.lead("token", k).over(order)).alias(f"token{k}")
    runs = places.select("entry_id", "col", "pos", "token", *(after(k) for k in range(1, lengths[-1])))
    gram = lambda n: F.when(F.col(f"token{n - 1}").isNotNull(), F.array("token", *(f"token{k}" for k in range(1, n))))
    runs = runs.select("entry_id", "col", "pos", F.explode(F.array_compact(F.array(*(gram(n) for n in lengths)))).alias("gram"))
    size = F.least(F.size("tokens"), F.lit(GRAM))
    grams = asked.select("tokens", (F.size("tokens") - size + 1).alias("votes"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size("tokens") - size + 1), lambda i: F.slice("tokens", i, size))).alias("nth", "gram"))
    met = runs.join(grams, "gram").select("tokens", "votes", "entry_id", "col", (F.col("pos") - F.col("nth")).alias("start"))
    whole = met.where("votes = 1").select("tokens", "entry_id")
    longer = met.where("votes > 1").groupBy("tokens", "votes", "entry_id", "col", "start").agg(F.count("*").alias("n")).where("n = votes")
    return whole.unionByName(longer.select("tokens", "entry_id"))

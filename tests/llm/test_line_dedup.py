import random
import re

from pyspark.sql import functions as F

from millrace.llm import line_dedup

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, runs string, n_chars long"


def brute(rows, least=50):
    """Text and number of dropped lines of each document, by all windows."""
    words = lambda line: len(re.findall(r"[^ \t-\r]+", line))
    strip = " \t\n\x0b\x0c\r"
    docs, windows = [], {}
    for key, text in rows:
        lines = (text or "").split("\n")
        own = [i for i, x in enumerate(lines) if words(x)]
        spans = []
        for step in (1, -1):
            order = own[::step]
            for k in range(len(order)):
                n, e = 0, k
                while e < len(order) and n < least:
                    n += words(lines[order[e]])
                    e += 1
                if n >= least:
                    span = order[k:e]
                    content = (step, tuple(lines[i].strip(strip) for i in span))
                    spans.append((content, min(span), max(span)))
        docs.append((key, text, lines, spans))
        for content, low, high in spans:
            windows[content] = min(windows.get(content, (key, low, high)), (key, low, high))
    out = []
    for key, text, lines, spans in docs:
        # of a run that overlaps its first copy only what lies beyond that goes
        start = lambda c, low: max(low, windows[c][2] + 1) if windows[c][0] == key else low
        gone = {i for c, low, high in spans if (key, low) > windows[c][:2] for i in range(start(c, low), high + 1) if words(lines[i])}
        out.append((key, text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)))
    return out


def test_all_documents_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = sorted((r.doc_id, r.text, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect())
    want = brute(rows)
    assert sum(n for *_, n in want) > 100
    assert got == want


def test_frequent_lines_in_many_contexts_match_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.choice([1, 1, 2, 3, 9]))) for _ in range(12)] + ["", "  "]
    passages = [[rng.choice(pool) for _ in range(rng.randint(3, 9))] for _ in range(6)]
    rows = []
    for key in range(120):
        lines = []
        while len(lines) < rng.choice([2, 10, 40]):
            lines += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(["  ", ""]) + rng.choice(pool)]
        rows.append((key, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for least in (4, 9, 16):
        got = sorted((r.doc_id, r.text, r.n_dropped) for r in line_dedup.dedup_lines(docs, least).collect())
        assert got == brute(rows, least)


def test_positions_are_selected_once(spark):
    text = "\n".join(f"{w} w" for w in "one two three four five six seven eight nine ten".split())
    rows = spark.range(1).select(line_dedup._lines(F.lit(text)).alias("lines"))
    rows = rows.select("lines", F.explode(F.array(line_dedup._minima(F.col("lines"), 6))).alias("minima"))
    lines, minima, found = rows.select("lines", "minima", line_dedup._selected(F.col("minima"))).first()
    hashes = [x.h for x in lines]
    want = [min(range(i, i + 3), key=hashes.__getitem__) for i in range(8)]
    assert [m["at"] for m in minima] == want
    assert [z.at for z in found] == sorted(set(want)) and [z.fp for z in found] == [hashes[z.at] for z in found]
    assert [i for z in found for i in range(z.a, z.b + 1)] == list(range(8)) and all(want[i] == z.at for z in found for i in range(z.a, z.b + 1))


def test_runs_are_cut_from_end_to_end(spark):
    passage = "\n".join(f"{x} " * 20 for x in ("alpha", "beta", "gamma")) + "\nshort tail"
    rows = [(1, f"first\n{passage}\nend one", "r", 0), (2, f"second head\n{passage}\nend two", "r", 0), (3, "short tail\nonly this", "r", 0)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1]
    assert got[2].text == "second head\nend two" and got[2].n_dropped == 4 and got[2].runs == "r"


def test_nulls_repeats_empty_and_long(spark):
    line = "word " * 60
    rows = [(None, line, "a", 1), (1, line, "b", 1), (1, line, "c", 1), (2, None, None, None), (3, "", "d", 0), (4, "x y\n" * 20_000, "e", 1), (5, f"{line}\nnew", "f", 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.runs): (r.text, r.n_dropped) for r in line_dedup.dedup_lines(df).collect()}
    assert got[None, "a"] == (line, 0)
    assert got[1, "b"] == got[1, "c"] == ("", 1)
    assert got[2, None] == (None, 0) and got[3, "d"] == ("", 0)
    assert got[4, "e"][1] == 19_975 and got[4, "e"][0].count("x y") == 25  # the first run of 50 words stays whole
    assert got[5, "f"] == ("new", 1)
    kept = line_dedup.without_copies(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.n_chars) for r in kept.collect() if r.n_chars is not None and r.doc_id != 4) == [(0, 1), (3, 0), (5, 3)]
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = line_dedup.without_copies(df.select("doc_id", "text", F.lit(7).alias("n_dropped"), F.lit("z").alias("a.b")))
    assert odd.columns == ["doc_id", "text", "n_dropped", "a.b"] and {r.n_dropped for r in odd.collect()} == {7}
    both = line_dedup.without_copies(df.select("doc_id", "text", F.lit(7).alias("n_dropped"), F.lit(8).alias("_n_dropped")))
    assert both.columns == ["doc_id", "text", "n_dropped", "_n_dropped"] and {(r.n_dropped, r._n_dropped) for r in both.collect()} == {(7, 8)}

import math
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import cover_tree, queries, quality, unigram

SF = "/root/testdata/sf0.01"


# -- quality rules ----------------------------------------------------------------------


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {p for v in places.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
TEXTS = ["", None, " \t\n", "a b c d e f g h", "a b c d e f g h a b c d e f g h i", "x " * 9, "é# <b>\n\n é# <b>\né# <b>", "1 2 3 4 5 6 7 8 9 " * 3, "w\u00a0x y", "z " * 30_000, " lead " + "q r s t u v w x " * 2]


def test_measures_match_brute_force(spark):
    rows = [(i, t, "en", "k") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string")
    for r in quality.measured(df).collect():
        assert tuple(r[m] for m in MEASURES) == brute(TEXTS[r.doc_id])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in quality.measured(docs).collect():
        assert tuple(r[m] for m in MEASURES) == brute(r.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


def test_binomial_tail_is_exact(spark):
    rows = [(k, n, p) for n in (1, 5, 60, 5000, 200_000) for p in (0.01, 0.2) for k in {0, 1, n // 200, n // 100, n} if k <= n]
    for p in (0.01, 0.2):
        df = spark.createDataFrame([(k, n) for k, n, q in rows if q == p], "k long, n long")
        for r in df.select("k", "n", quality.log_binomial_tail(F.col("k"), F.col("n"), p).alias("t")).collect():
            terms = [math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(p) + (r.n - i) * math.log(1 - p) for i in range(min(r.k, 5000) + 1)]
            want = 0.0 if r.k == r.n else max(terms) + math.log(sum(math.exp(t - max(terms)) for t in terms))
            assert r.t == pytest.approx(want, abs=1e-6)


def corpus(spark):
    """1,500 good texts, of which few have symbols, and 300 bad ones full of them."""
    good = [(i, " ".join(f"w{i}x{j}" for j in range(30)) + (" #" if i < 5 else ""), "en", "a") for i in range(1500)]
    bad = [(i, " ".join(f"w{i}x{j} ##" for j in range(30)), "en", "a") for i in range(1500, 1800)]
    odd = [(1800, " ".join(f"v{j} ##" for j in range(30)), "xx", "a"), (1801, None, None, None), (None, "short", "en", "a")]
    labels = [(i, int(i < 1500), 0) for i in range(0, 1790)] + [(1790, None, None), (None, 0, 0)]
    return spark.createDataFrame(good + bad + odd, "doc_id long, text string, lang string, kept string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_cutoffs_are_certified(spark):
    docs, labels = corpus(spark)
    verdict = {r.doc_id: r.kept for r in quality.judge(docs, labels).collect()}
    assert sum(verdict[i] for i in range(1500)) >= 1495 and not any(verdict[i] for i in range(1500, 1800))
    assert verdict[1800] and not verdict[1801] and not verdict[None]  # no label in its stratum; too short
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, v in verdict.items() if v)
    few = labels.where("doc_id % 20 = 0")
    assert sum(r.kept for r in quality.judge(docs, few).collect()) == 1801  # too few labels to certify anything
    assert quality.judge(docs.limit(0), labels).count() == 0
    plain = docs.select("doc_id", "text", F.lit(1).alias("a.b"))  # no lang, a dotted name
    assert quality.keep_good(plain, labels).columns == plain.columns
    # languages with too few good rows each are certified together, one without labels is not
    mixed = docs.withColumn("lang", F.when(F.col("doc_id") < 1790, F.concat(F.lit("l"), F.col("doc_id") % 12)).otherwise(F.col("lang")))
    verdict = {r.doc_id: r.kept for r in quality.judge(mixed, labels).collect()}
    assert sum(verdict[i] for i in range(1500)) >= 1495 and not any(verdict[i] for i in range(1500, 1790)) and verdict[1800]


def plain_lasts(rows):
    """The step up to which each language is rejected, by a plain loop: rows are
    (language, first step that rejects, good)."""
    langs = sorted({r[0] for r in rows})
    level = quality.ERROR / len(langs)
    n = {x: sum(g for a, _, g in rows if a == x) for x in langs}
    pool = {x: x if n[x] and (1 - quality.FALSE_REJECTION) ** n[x] <= level else None for x in langs}
    out = {}
    for own in set(pool.values()):
        mine = [(s, g) for x, s, g in rows if pool[x] == own]
        goods, best = sum(g for _, g in mine), (0, None)
        for last in range(len(quality.STEPS)):
            k = sum(g for s, g in mine if s is not None and s <= last)
            bad = sum(not g for s, g in mine if s is not None and s <= last)
            if sum(math.comb(goods, i) * quality.FALSE_REJECTION**i * (1 - quality.FALSE_REJECTION) ** (goods - i) for i in range(k + 1)) > level:
                break
            if bad - k > best[0]:
                best = (bad - k, last)
        out |= {x: best[1] for x in langs if pool[x] == own}
    return out


def test_certified_steps_match_a_plain_loop(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality._with_step(quality.measured(docs).where("NOT base_failed")).join(labels, "doc_id").selectExpr("stratum", "step", "quality = 1").collect()
    want = plain_lasts([tuple(r) for r in rows])
    assert {r.stratum: r["last"] for r in quality.certified_steps(quality.measured(docs), labels).collect()} == {x: k for x, k in want.items() if k is not None}
    assert want["en"] is not None
    judged = queries.op7_quality_rules(spark, SF)
    assert judged.where("NOT base_failed AND NOT kept").count() > 10  # the method's own verdicts


def test_measures_equal_the_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = sorted(con.execute(queries.ORACLE_SQL["op7_quality_rules"]).fetchall())
    assert sorted(map(tuple, queries.op7_quality_rules(spark, SF).collect())) == want


# -- search -----------------------------------------------------------------------------


def top_by_scan(rows, every, k):
    out = []
    for i, q in rows.items():
        if i % every == 0:
            scored = sorted((-int(np.dot(q, x)), j) for j, x in rows.items() if j != i and len(x) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def found(spark, rows, every, k=5):
    df = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in rows.items()], "vec_id long, v array<long>")
    return sorted(map(tuple, cover_tree.top_k(df, F.col("vec_id") % every == 0, k).collect()))


def test_search_matches_a_scan(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centers = rng.integers(-200, 200, (5, 8))
    rows = {i: centers[i % 5] + rng.integers(-9, 9, 8) for i in range(400)}
    assert found(spark, rows, 20) == top_by_scan(rows, 20, 5)
    monkeypatch.setattr(cover_tree, "DATA_BLOCK", 50)
    monkeypatch.setattr(cover_tree, "QUERY_BLOCK", 4)
    assert found(spark, rows, 20) == top_by_scan(rows, 20, 5)
    same = {i: np.array([3, 4]) for i in range(150)} | {200: np.array([9, 9]), 201: np.array([-1, 0, 5])}
    assert found(spark, same, 50) == top_by_scan(same, 50, 5)


def test_search_of_few_or_odd_vectors(spark):
    assert found(spark, {0: np.array([1, 2]), 7: np.array([0, 1])}, 7) == [(0, 1, 7, 2), (7, 1, 0, 2)]
    schema = "vec_id long, embedding array<float>, label int, v string"
    rows = [(0, [0.5, -0.5], 1, "x"), (1, None, 1, "x"), (2, [float("nan"), 1.0], 1, "x"), (3, [None, 1.0], 1, "x"), (4, [1.0, 0.25], 1, "x"), (4, [1.0, 0.25], 2, "y"), (None, [1.0, 1.0], 1, "x"), (5, [float("inf"), 0.0], 1, "x")]
    vectors = cover_tree.integer_vectors(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, vectors.collect())) == [(0, [128, -128]), (4, [256, 64]), (4, [256, 64])]
    score = 128 * 256 - 128 * 64
    assert sorted(map(tuple, cover_tree.top_k(vectors, F.col("vec_id") % 50 == 0).collect())) == [(0, 1, 4, score), (0, 2, 4, score)]
    # repeated ids with different vectors: each row counts, as a query too
    rows = [(0, [256, 0]), (4, [256, 0]), (4, [512, 0]), (7, [128, 0]), (0, [0, 256])]
    twice = cover_tree.top_k(spark.createDataFrame(rows, "vec_id long, v array<long>"), F.col("vec_id") % 50 == 0, 2)
    assert sorted(map(tuple, twice.collect())) == [(0, 1, 0, 0), (0, 1, 4, 131072), (0, 2, 4, 0), (0, 2, 4, 65536)]
    assert cover_tree.top_k(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_of_covers():
    rng = np.random.default_rng(8)
    x, q = rng.normal(size=(300, 6)), rng.normal(size=(80, 6))
    a, b = cover_tree.Node(x, np.arange(300)), cover_tree.Node(q, np.arange(80))
    for d in [a, *a.children, *a.leaves()]:
        for n in [b, *b.children, *b.leaves()]:
            assert (q[n.rows] @ x[d.rows].T).max() <= cover_tree.most_score(n, d)
    assert sorted(r for leaf in a.leaves() for r in leaf.rows) == list(range(300))


# -- pieces -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return unigram.Unigram(queries.PIECES)


@pytest.fixture(scope="module")
def library():
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(queries.PIECES, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1  # the same pieces and scores as a unigram model
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


ODD = ["", " ", "a", "  a  b ", "héllo wörld\nfoo\tbar", "日本語 テキスト 🙂🙂", "▁x ▁", "a▁b", "\n\n a", " lead", "trail ", "\x00\x7f ok"]


def ids_of(pieces, texts):
    ids, at = pieces.encode(pa.array(texts))
    return [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])]


def test_pieces_equal_the_library(spark, pieces, library):
    words = [w for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect() for w in r.text.split(" ")][:4000]
    # the library adds scores in single precision, which the scores of -1e9 of some pieces drown
    plain = [w for w, ids in zip(words, ids_of(pieces, words)) if all(pieces.score[i] > -1e6 and i > 258 for i in ids)]
    assert ids_of(pieces, ODD) == library.encode(ODD)
    pairs = list(zip(ids_of(pieces, plain), library.encode(plain)))
    # where the library stops at another path, ours scores higher
    assert all(a == b or pieces.score[a].sum() > pieces.score[b].sum() for a, b in pairs) and sum(a == b for a, b in pairs) > 0.9 * len(plain) > 900
    for t in [*ODD, *words[:300], "x" * 300 + " yy", "🙂" * 200]:
        marked = ("▁" + t).replace(" ", "▁").encode() if t else b""
        assert ids_of(pieces, [t])[0] == pieces.viterbi(marked)
        assert pieces.decode(ids_of(pieces, [t])[0]) == t.replace("▁", " ")


def plain_ids(text, scores, byte_ids, unknown):
    """The best path over the whole text, by a dictionary of pieces."""
    text = "▁" + text.replace(" ", "▁") if text else ""
    longest = max(map(len, scores))
    best, back = [0.0] + [-float("inf")] * len(text), [None] * (len(text) + 1)
    for i in range(len(text)):
        known = False
        for j in range(i + 1, min(len(text), i + longest) + 1):
            hit = scores.get(text[i:j])
            known |= j == i + 1 and hit is not None
            if hit is not None and best[i] + hit[1] > best[j]:
                best[j], back[j] = best[i] + hit[1], (i, [hit[0]])
        if not known and best[i] + unknown > best[i + 1]:
            best[i + 1], back[i + 1] = best[i] + unknown, (i, [byte_ids[b] for b in text[i].encode()])
    ids, at = [], len(text)
    while at:
        at, step = back[at]
        ids = step + ids
    return ids


def test_ids_of_whole_documents_by_a_plain_search(spark, pieces):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(queries.PIECES, "rb") as f:
        model.ParseFromString(f.read())
    scores = {x.piece: (i, x.score) for i, x in enumerate(model.pieces) if x.type in (1, 4)}
    byte_ids = {int(x.piece[3:5], 16): i for i, x in enumerate(model.pieces) if x.type == 6}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r.ids for r in unigram.encode(docs, queries.PIECES).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        assert got[i] == plain_ids(t.replace("▁", " "), scores, byte_ids, pieces.unknown)


def test_double_array_finds_its_keys():
    keys = [(w.encode(), i) for i, w in enumerate(["a", "ab", "abc", "b", "é", "éa", "zzz", "\x00"])]
    trie = unigram.DoubleArray(keys)

    def get(key):
        s = 0
        for c in key:
            to = trie.base[s] + c
            if trie.check[to] != s:
                return None
            s = to
        return int(trie.value[s])

    assert [get(k) for k, _ in keys] == list(range(8))
    assert get(b"zz") == -1 and get(b"c") is None and get(b"abd") is None


def test_all_documents_come_back(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    crcs = {r.doc_id: r.c for r in docs.select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("c")).collect()}
    got = queries.op2_sentencepiece(spark, SF).collect()
    assert {r.doc_id: r.decoded_crc32 for r in got} == crcs and all(r.n_tokens > 0 for r in got)
    odd = spark.createDataFrame([(1, None, "i"), (None, "", None), (2, "a  b", "i"), (2, "a  b", "i")], "doc_id long, text string, ids string")
    back = unigram.decode(unigram.encode(odd, queries.PIECES), queries.PIECES).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == [(0, ""), (1, ""), (2, "a  b"), (2, "a  b")]
    assert unigram.encode(odd.limit(0), queries.PIECES).count() == 0


# -- pipeline ---------------------------------------------------------------------------


def test_stages_one_after_another(spark):
    from millrace.llm.common import load, written
    from tests.llm.test_line_dedup import brute as cut_lines
    from tests.llm.test_simhash import plain_roots

    docs = load(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "best_fit_packing"]
    good = written(corpus_pipeline.quality_rules(spark, docs, SF), "t")
    kept = {r.doc_id for r in queries.op7_quality_rules(spark, SF).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept and good.columns == docs.columns
    cut = written(corpus_pipeline.line_copies(spark, good, SF), "t")
    want = {i: t for i, t, n in cut_lines(sorted((r.doc_id, r.text) for r in good.collect())) if n == 0 or re.search(r"\S", t)}
    assert {r.doc_id: r.text for r in cut.collect()} == want and cut.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    near = corpus_pipeline.near_copies(spark, cut, SF)
    roots = plain_roots(sorted(want.items()))
    assert {r.doc_id for r in near.collect()} == {i for i, root in roots.items() if root == i} and near.columns == docs.columns
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == {r.doc_id for r in near.collect()}

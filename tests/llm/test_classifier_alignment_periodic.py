import hashlib
import zlib
from collections import Counter
from decimal import Decimal

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from millrace.llm import alignment, classifier, periodic
from millrace.llm.queries import BYTE_BPE, PIECES, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


# -- periodic runs ---------------------------------------------------------------------


def plain_runs(words, least=12):
    """All runs by trying every period."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)  # the smallest comes first
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def plain_row(doc_id, text, plant):
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(((-m, s, q) for s, m, q in runs), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, n, len(runs), *((best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4),
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)), n - len(dropped),
    )


def by_id(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_runs_of_all_documents_match_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 6000").collect()
    want = by_id(plain_row(r.doc_id, r.text, True) for r in rows)
    got = QUERIES["op13_periodic_runs"](spark, SF).collect()
    kept = {r.doc_id for r in rows}
    assert by_id(r for r in got if r.doc_id in kept) == want
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()


def generated(seed):
    """Word sequences of few letters, powers, Fibonacci words and planted repeats."""
    drawn = np.random.default_rng(seed)
    fib = ["a", "b"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    texts = [" ".join(fib[-1]), "x " * 500, "a b " * 200 + "a a " * 90, " ".join("ab"[bin(i).count("1") % 2] for i in range(400))]
    for size in (2, 3, 50):
        for _ in range(12):
            w = drawn.integers(0, size, drawn.integers(1, 700))
            for _ in range(3):
                at, p = drawn.integers(0, len(w)), drawn.integers(1, 120)
                w[at : at + 4 * p] = np.resize(w[at : at + p], len(w[at : at + 4 * p]))
            texts.append(" ".join(map(str, w)))
    return texts


@pytest.mark.parametrize("base", [5, 7, 13])
def test_tiles_of_any_size_find_all_runs(spark, base):
    rows = list(enumerate(generated(base)))
    got = periodic.periodic_runs(spark.createDataFrame(rows, DOCS), base=base).collect()
    assert by_id(got) == by_id(plain_row(i, t, False) for i, t in rows)


def test_tiles_share_two_periods():
    for n in (1, 31, 32, 33, 100, 5000):
        covered = set()
        tiles = list(periodic.tiles_of(n, 5))
        for start, end, low, high in tiles:
            assert 0 <= start < end <= n
            assert (start, end) == (0, n) or 2 << high <= (end - start) // 2 + 16 or end == n
            covered |= set(range(low, high + 1))
        assert covered == set(range((n // 2).bit_length()))


def test_runs_of_odd_rows(spark):
    rows = [(None, "y " * 30), (1, None), (2, ""), (3, " \n\t "), (4, "a\x1cb " * 12), (4, "a\x1cb " * 12), (5, "one"), (6, "a a a a a a a a a a a"), (7, " x " * 12)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"row": F.lit("r"), "start": F.lit(1), "words": F.lit(2)})
    got = periodic.periodic_runs(df).collect()
    assert by_id(got) == by_id(plain_row(i, t, False) for i, t in rows)
    assert periodic.periodic_runs(df.limit(0)).count() == 0


def test_a_long_document(spark):
    """One document of 60,000 words: runs within a tile, across tiles, and of a period as long as tiles."""
    drawn = np.random.default_rng(1)
    w = drawn.integers(0, 1 << 30, 60_000)
    w[100:200], w[3000:11000], w[15000:45000] = np.resize(w[100:103], 100), np.resize(w[3000:3700], 8000), np.resize(w[15000:27001], 30_000)
    got = periodic.periodic_runs(spark.createDataFrame([(1, " ".join(map(str, w)))], DOCS)).first()
    lines = f"100,{100},3\n3000,8000,700\n15000,30000,12001\n"
    assert (got.n_runs, got.start, got.length, got.period, got.exponent_milli) == (3, 15000, 30000, 12001, 2499)
    assert got.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()


# -- alignment of tokenizers -----------------------------------------------------------


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def plain_alignment(rows, libraries, links="end"):
    """The digest columns by loops over whole texts and the libraries' own results."""
    a, b = libraries
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    found, counts = [], Counter()
    for doc_id, text in rows:
        whole = (" " + (text or "")).encode()
        x = a.encode(whole.decode(), add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        xs = [bytes(back[c] for c in a.id_to_token(i)) for i in x]
        ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not text or b"".join(xs) != whole or b"".join(ys) != whole:
            x, y, xs, ys = [], [], [], []
        spans = []
        for tokens in (xs, ys):
            ends = np.cumsum([len(t) for t in tokens], dtype=int).tolist()
            spans.append(list(zip([0, *ends], ends)))
        both = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = []
        for low, high in zip([0, *both], both):
            inside = [[i for i, (s, e) in zip(ids, span) if low <= s and e <= high] for ids, span in ((x, spans[0]), (y, spans[1]))]
            groups.append("|".join(",".join(map(str, ids)) for ids in inside))
        meet = (lambda p, q: p[1] == q[1]) if links == "end" else (lambda p, q: p[0] < q[1] and q[0] < p[1])
        near, k = [], 0
        for i, p in enumerate(spans[0]):
            while k < len(spans[1]) and spans[1][k][1] <= p[0]:
                k += 1
            m = k
            while m < len(spans[1]) and spans[1][m][0] < p[1]:
                if meet(p, spans[1][m]):
                    near.append((x[i], y[m]))
                m += 1
        counts.update(near)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        found.append((doc_id, len(x), len(y), len(groups), near, digest))
    most = {}
    for (_, i), n in counts.items():
        most[i] = max(most.get(i, 0), n)
    return [(d, n, m, g, len(near), sum(counts[p] == most[p[1]] for p in near), sum(counts[p] for p in near), digest) for d, n, m, g, near, digest in found]


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    (1, None), (2, ""), (3, " "), (4, "a  b   c"), (5, " x "), (6, "x▁y"), (7, "<s>hi</s> <|endoftext|>"), (8, "é́ ﬁ　퟿\U0001f600"), (9, "\x00a\n\t b"), (9, "\x00a\n\t b"),
    (None, "null id"), (11, "-" * 700), (12, "Unbelievable antidisestablishmentarianism " * 30), (13, "<0x41> ▁"), (14, "a\r\n b \n"),
]


def test_alignment_of_all_documents_matches_brute_force(spark, libraries):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_tokenizer_alignment"](spark, SF)
    assert by_id(got.select(*COLUMNS).collect()) == by_id(plain_alignment(rows, libraries))


@pytest.mark.parametrize("links", ["end", "overlap"])
def test_alignment_of_odd_texts(spark, libraries, links, monkeypatch):
    df = spark.createDataFrame(ODD, DOCS).withColumns({"row": F.lit("x"), "pairs": F.lit(1)})
    want = by_id(plain_alignment(ODD, libraries, links))
    assert by_id(alignment.align_tokenizers(df, BYTE_BPE, PIECES, links).select(*COLUMNS).collect()) == want
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 0)
    assert by_id(alignment.align_tokenizers(df, BYTE_BPE, PIECES, links).select(*COLUMNS).collect()) == want
    assert alignment.align_tokenizers(df.limit(0), BYTE_BPE, PIECES, links).count() == 0


def test_pairs_that_end_together_are_bounded_by_the_vocabularies():
    a, b = [b"ab", b"b", b"c", b"b"], [b"b", b"xab", b"ab", b"d"]
    plain = sum(x.endswith(y) or y.endswith(x) for x in a for y in b)
    assert alignment.most_end_pairs(a, b) == plain
    whole = alignment.byte_level_bytes(alignment.Encoder.of(BYTE_BPE)), alignment.PieceEncoder.of(PIECES).bytes
    assert alignment.most_end_pairs(*whole) < alignment.BROADCAST_PAIRS


# -- quality classifier ----------------------------------------------------------------


def test_scores_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op11_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    good, bad = ([r.score for r in held if r.quality == y] for y in (1, 0))
    order = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    share = len(good) / len(held)
    assert order > 0.97 and np.mean([(r.score - r.quality) ** 2 for r in held]) < share * (1 - share) / 3


def test_held_out_labels_and_other_columns_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.lit(1))
    changed = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("s"), "x": F.lit(1), "score": F.lit(2)})
    first, second = (by_id(classifier.score_quality(*p).select("doc_id", "score", "predicted").collect()) for p in ((docs, labels), (changed, other)))
    assert [(d, p) for d, _, p in first] == [(d, p) for d, _, p in second]
    assert np.allclose([s for _, s, _ in first], [s for _, s, _ in second], atol=1e-9)


def test_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "\n \n"), (None, "word " * 50_000), (4, "a"), (4, "a"), (6, "|||"), (7, "é中")], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in classifier.score_quality(docs, none).collect()} == {0.5}
    assert classifier.score_quality(docs.limit(0), none).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, None), (4, 0), (4, 1), (4, 1), (6, 0), (7, 2)], "doc_id long, quality int")
    rows = classifier.score_quality(docs, labels).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows) and [r.held_out for r in rows if r.doc_id is None] == [True]
    one = classifier.score_quality(docs, labels.where("quality = 1 AND doc_id <> 4")).collect()
    assert {r.score for r in one} == {1.0}


def test_learning_from_a_bounded_sample(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    measured = classifier.with_statistics(docs)
    whole, part = (classifier.labelled(measured, labels, most=m).count() for m in (10**6, 20))
    assert 5 <= part <= 40 < whole


def test_isotonic_fit_matches_the_least_squares_by_minimax():
    drawn = np.random.default_rng(3)
    for _ in range(30):
        n = drawn.integers(1, 30)
        y, w = drawn.random(n), drawn.integers(1, 5, n).astype(float)
        mean = lambda i, j: (y[i : j + 1] * w[i : j + 1]).sum() / w[i : j + 1].sum()
        want = [max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
        assert np.allclose(classifier.isotonic(y, w), want)


def test_features_approach_the_gaussian_kernel(monkeypatch):
    monkeypatch.setattr(classifier, "FEATURES", 20_000)
    x = np.random.default_rng(0).standard_normal((6, 5))
    z = classifier.fourier(x, 1.3)[:, :-1]
    squares = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-squares / (2 * 1.3**2 * 5))).max() < 0.05


def test_statistics_of_a_small_text():
    x = dict(zip(classifier.STATISTICS, classifier.statistics(pa.array(["Aa bb bb\nAa bb bb\n", ""]))[0]))
    assert x["log_words"] == pytest.approx(np.log1p(6)) and x["repeated_lines"] == 0.5 and x["top_word"] == pytest.approx(4 / 6)
    assert x["distinct_words"] == pytest.approx(2 / 6) and x["repeated_word"] == pytest.approx(2 / 5) and x["capital"] == pytest.approx(2 / 6) and x["class_1"] == pytest.approx(2 / 18)
    assert not classifier.statistics(pa.array([""])).any() and Decimal(str(x["word_chars"])) == 2

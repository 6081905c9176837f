import numpy as np
import xxhash

from millrace.llm import simhash
from millrace.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, root string"


def plain_fingerprint(text, words=4, seed=42):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, bits):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    root = {i: i for i, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(fps):
        for j, b in fps[:k]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (format(f, "016x"), find(i)) for i, f in fps}


def test_all_documents_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == plain_components(rows, 4)


def test_nulls_ties_clashing_columns_and_empty(spark):
    rows = [(3, None, "a"), (1, "", "b"), (2, "one two", "c"), (2, "one two", "c"), (None, "one two", "d"), (5, "x " * 30_000, "e")]
    got = sorted(simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect(), key=str)
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 6 and by_id[3].component_id == by_id[1].component_id == 1
    assert by_id[3].fingerprint == "0" * 16 and by_id[None].component_id == 2
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = simhash.keep_one_each(spark.createDataFrame(rows, SCHEMA), words=4, bits=4)
    assert sorted((r.doc_id or 0, r.root) for r in kept.collect()) == [(0, "d"), (1, "b"), (2, "c"), (5, "e")]


def test_linked_pairs_always_share_an_anchor():
    rng = np.random.default_rng(1)
    for bits in range(9):
        x = rng.integers(0, 2**64, 300, dtype=np.uint64)
        y = x.copy()
        for k in range(len(y)):
            for place in rng.choice(64, bits, replace=False):
                y[k] ^= np.uint64(1) << np.uint64(place)
        a, b = (set(zip(*(z.tolist() for z in simhash.anchors(v, bits)))) for v in (x, y))
        assert {row for row, _ in a & b} == set(range(300))


def test_hot_anchors_are_cut_without_losing_links(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 2**62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (200, 2))})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    monkeypatch.setattr(simhash, "MOST", 40)
    roots = {r.node: r.root for r in components(simhash.links(df, 4)).collect()}
    assert set(roots) == set(fps) and len(set(roots.values())) == 1


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 101), (100, 101)], "a long, b long")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert roots == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_roots(rows, words=5):
    """The least doc_id that steps of pairs at Jaccard 0.8 or more can reach."""
    sets, root = [], {i: i for i, _ in rows}
    for i, t in rows:
        tokens = (t or "").encode().lower().split()
        sets.append((i, {b" ".join(tokens[k : k + words]) for k in range(max(1, len(tokens) - words + 1))}))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_kept_rows_match_exact_similarity(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    roots = plain_roots([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert {r.doc_id for r in simhash.keep_one_each(docs).collect()} == {i for i, root in roots.items() if i == root}


def test_near_copies_at_the_threshold(spark, monkeypatch):
    """Groups around one hub, members from 0.6 to 0.97 to it, and in several parts."""
    rng, rows = np.random.default_rng(3), []
    for group in range(12):
        base = [f"w{group}x{k}" for k in range(200)]
        for changes in (0, 1, 2, 3, 4, 4, 4, 5, 5, 5, 6, 7, 8, 9):
            own = list(base)
            for place in rng.choice(200, changes, replace=False):
                own[place] = f"n{rng.integers(1 << 40)}"
            rows.append((len(rows), " ".join(own), "g"))
    roots = plain_roots([r[:2] for r in rows])
    want = {i for i, root in roots.items() if i == root}
    assert 12 < len(want) < len(rows) - 12
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id for r in simhash.keep_one_each(df).collect()} == want
    monkeypatch.setattr(simhash, "MOST", 8)
    monkeypatch.setattr(simhash, "MOST_SETS", 8)
    assert {r.doc_id for r in simhash.keep_one_each(df).collect()} == want


def test_links_survive_where_the_hub_does_not_and_equal_fingerprints_are_held(spark):
    x, y, z = (np.arange(a, a + 100, dtype=np.uint64) for a in (0, 10, 20))  # x-y and y-z at 0.82, x-z at 0.67
    a, b = simhash.alike(np.concatenate([x, z, y]), np.array([100, 100, 100]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(1, 2), (2, 0)]
    # one shingle outweighs all others: equal fingerprints by all seeds, sets that share little
    rows = [(k, "x " * 3000 + " ".join(f"{k}w{n}" for n in range(40)), "r") for k in range(3)]
    assert len({plain_fingerprint(t, 5, 42) for _, t, _ in rows}) == 1
    assert simhash.keep_one_each(spark.createDataFrame(rows, SCHEMA)).count() == 3

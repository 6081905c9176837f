"""The stages of the pipeline one after another on small odd tables."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def tables(spark, folder, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        *(c if c in ("doc_id", "text") else f"CAST(NULL AS {t}) AS {c}" for c, t in docs.dtypes), "9L AS n_dropped", "'x' AS `a.b`"
    )
    odd.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return odd.columns


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n))


def test_odd_documents_go_through_all_stages(spark, tmp_path):
    one, near = prose(1, 200), prose(1, 200).rsplit(" ", 1)[0] + " other"
    passage = "\n".join(prose(k, 30) for k in (7, 8))
    rows = [
        (1, one), (2, near), (3, None), (4, ""), (5, "few words"), (6, prose(2, 60)), (6, prose(2, 60)),
        (7, f"{prose(3, 70)}\n{passage}"), (8, f"{prose(4, 70)}\n{passage}\n{prose(5, 40)}"), (9, prose(6, 4000)), (10, passage),
    ]
    columns = tables(spark, str(tmp_path), rows)
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        path = f"{tmp_path}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = sorted((r.doc_id, r.text) for r in docs.collect())
    assert [d for d, _ in kept["quality_rules"]] == [1, 2, 6, 6, 7, 8, 9, 10]  # null, empty and short texts go
    after = dict(kept["line_dedup"])
    assert after[7] == rows[7][1] and after[8] == f"{prose(4, 70)}\n{prose(5, 40)}" and 10 not in after
    assert [d for d, _ in kept["near_dedup"]] == [1, 6, 7, 8, 9]  # one of 1 and 2, one of the repeated rows
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {1, 6, 7, 8, 9}
    assert all(r.offset + r.length <= 2048 for r in packed) and len({(r.doc_id, r.piece) for r in packed}) == len(packed)


def test_an_empty_table(spark, tmp_path):
    tables(spark, str(tmp_path), [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

"""The pipeline: each stage against a brute-force version on a small table, and its end to end run."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pointloom.llm import stages

SF = "/root/testdata/sf0.001"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


def test_stages_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        assert after.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
        docs = after
    assert 0 < docs.count() < 200


def test_run_packs_what_is_left(spark):
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert 0 < got.doc_id.nunique() < 200 and got.groupby("sequence_id").length.sum().max() <= 2048


@pytest.fixture
def planted(make_docs, spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    passage, base = words(60, 5), words(120, 6)
    return {
        "docs": make_docs((0, words(80, 1)), (1, f"{words(40, 2)} {item} {words(40, 3)}"), (2, f"{words(30, 4)}\n{passage}"), (3, f"{words(30, 7)}\n{passage}"), (4, base), (5, base + " end"), (6, None), (7, ""), (None, words(80, 8))),
        "passage": passage,
    }


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=str)


def test_planted_cases(spark, planted):
    docs = planted["docs"]
    assert ids(stages.toxicity_filter(spark, docs, SF)) == ids(docs)
    lines = {r["doc_id"]: r for r in stages.line_dedup(spark, docs, SF).collect()}
    assert lines[2]["text"].endswith(planted["passage"]) and lines[3]["text"] == words(30, 7) and lines[3]["n_chars"] == len(words(30, 7))
    assert ids(stages.near_dedup(spark, docs, SF)) == [0, 1, 2, 3, 4, 6, 7, None]
    assert ids(stages.decontaminate(spark, docs, SF)) == [0, 2, 3, 4, 5, 6, 7, None]


def test_shortened_copies_of_items_go(spark, make_docs):
    item = max((r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=lambda t: len(t.split()))
    assert ids(stages.decontaminate(spark, make_docs((0, words(80, 1)), (1, item.rsplit(" ", 2)[0])), SF)) == [0]


def brute_survivors(rows, width=5):
    """What near-dedup leaves of (doc_id, text) rows, by all pairs."""
    sets = []
    for _, t in rows:
        w = tuple((t or "").lower().split())
        sets.append({w[i : i + width] for i in range(max(1, len(w) - width + 1))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[root(i)] = root(j)
    order = lambda k: (rows[k][0] is None, rows[k][0] or 0)
    best = {}
    for k in range(len(rows)):
        best[root(k)] = min(best.get(root(k), k), k, key=order)
    return sorted((rows[k] for k in best.values()), key=str)


def test_near_dedup_equals_brute_force(spark, make_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = [r for r in brute_survivors(rows) if (r[1] or "").split()] + [r for r in rows if not (r[1] or "").split()]
    assert sorted(map(tuple, stages.near_dedup(spark, docs, SF).select("doc_id", "text").collect()), key=str) == sorted(want, key=str)


def test_repeated_and_null_ids(spark, make_docs):
    """Unique texts stay whatever their ids; null ids are dealt with like others."""
    a, b, c = words(80, 1), words(80, 2), words(80, 3)
    left = stages.near_dedup(spark, make_docs((3, a), (5, a), (5, b), (None, b), (None, c), (7, c + " end")), SF)
    assert sorted(map(tuple, left.select("doc_id", "text").collect())) == [(3, a), (5, b), (7, c + " end")]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    left = stages.decontaminate(spark, make_docs((1, item), (1, a), (None, f"{b} {item}"), (None, c), (2, None), (None, "")), SF)
    assert sorted(map(tuple, left.select("doc_id", "text").collect()), key=str) == sorted([(1, a), (None, c), (2, None), (None, "")], key=str)


def test_extra_columns_and_repeated_rows_pass(spark, make_docs):
    docs = make_docs((0, words(80, 1)), (0, words(80, 1)), (1, words(70, 2)), extra=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert docs.count() == 3 and "component" in docs.columns


def test_toxic_documents_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    left = stages.toxicity_filter(spark, docs, "/root/testdata/sf0.1").join(labels, "doc_id").groupBy("toxic").agg(F.count("*").alias("n"))
    n = {r["toxic"]: r["n"] for r in left.collect()}
    all_ = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    assert n[0] >= 0.99 * all_[0] and n.get(1, 0) <= 0.1 * all_[1]

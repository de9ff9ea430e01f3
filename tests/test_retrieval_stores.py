"""Scopes, stored postings and packed vectors."""

from __future__ import annotations

import numpy as np
import pytest

from tessarine.operators import retrieval as r
from tessarine.operators import vectors
from tessarine.operators.lineage import tenant_bucket
from tessarine.operators.postings import PostingsStore

CHUNKS = "chunk_id long, organization long, repository string, content string, breadcrumb string"
QUERIES = "query_id long, organization long, repository string, query string"


@pytest.fixture(scope="module")
def two_tenants(spark):
    rows = [(1, 1, "a", "red fox runs", "x"), (2, 2, "a", "red fox runs", "x"), (3, 1, "b", "red fox sits", "x"), (4, None, "a", "red fox", "x"), (5, 1, None, "red fox", "x"), (6, 1, "a", "only red here", "fox red"), (7, 1, "a", None, None)]
    asked = [(10, 1, "a", "the red fox"), (11, 2, "a", "Red fox"), (12, 1, "b", "fox"), (13, None, "a", "red"), (14, 3, "a", "red"), (15, 1, "a", "red cow"), (16, 2, "b", "red")]
    return spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(asked, QUERIES)


WANT = {(10, 1), (10, 6), (11, 2), (12, 3)}


def test_keyword_leg_stays_in_scope(two_tenants):
    chunks, asked = two_tenants
    assert {(x.query_id, x.chunk_id) for x in r.keyword_leg(chunks, asked).collect()} == WANT


def test_stored_postings(spark, two_tenants, tmp_path):
    """The same answer from the store, also in a session that opens it anew; only asked tenants' folders are read."""
    chunks, asked = two_tenants
    store = PostingsStore(spark, str(tmp_path / "p"), 4)
    store.write(chunks)
    assert {(x.query_id, x.chunk_id) for x in store.keyword_leg(asked).collect()} == WANT
    one = asked.filter("query_id = 12")
    bucket = spark.range(1).select(tenant_bucket(r.F.lit(1).cast("long"))).first()[0]
    files = {x.split("org_bucket=")[1].split("/")[0] for x in store.asked(one).inputFiles()}
    assert files == {str(bucket)} and len({x.split("org_bucket=")[1].split("/")[0] for x in store.read().inputFiles()}) == 2
    assert "PartitionFilters: [isnotnull(org_bucket" in store.asked(one)._jdf.queryExecution().toString()
    again = PostingsStore(spark.newSession(), str(tmp_path / "p"), 4)
    spark.sql(f"DROP TABLE {store.name}")
    assert again.read().count() == store.read().count() > 0


def test_buckets_spare_a_shuffle_of_postings(spark, two_tenants, tmp_path, monkeypatch):
    chunks, asked = two_tenants
    store = PostingsStore(spark, str(tmp_path / "p"), 4)
    store.write(chunks)
    monkeypatch.setattr(r.counted_small, "__defaults__", (0,))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = r.query_terms(asked).select("repository", "term").distinct()
        met = store.read().join(keys.hint("shuffle_hash"), ["repository", "term"], "left_semi")
        assert "Exchange hashpartitioning(repository" not in str(met._jdf.queryExecution().executedPlan()).split("Scan parquet")[0].split("postings")[0] and met.count() > 0
        assert {(x.query_id, x.chunk_id) for x in store.keyword_leg(asked).collect()} == WANT
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def cosines(rows, asked, limit):
    out = set()
    for q, scope, v in asked:
        own = []
        for i, s, w in rows:
            if s == scope and i != q and len(v) == len(w):
                n = np.linalg.norm(v) * np.linalg.norm(w)
                own.append((-round(float(np.dot(v, w) / n) if n else 0.0, 6), i))
        out |= {(q, i) for _, i in sorted(own)[:limit]}
    return out


@pytest.mark.parametrize("dim", [3, 1536])
def test_vector_leg(spark, monkeypatch, dim):
    """Small blocks and groups, so that one scope is dealt to several parts and packs; other lengths, norm 0, nulls and ties."""
    monkeypatch.setattr(vectors, "BLOCK_BYTES", dim * 8 * 3)
    monkeypatch.setattr(vectors, "GROUP_BYTES", dim * 8 * 7)
    g = np.random.default_rng(1)
    rows = [(i, (1, "a" if i % 3 else "b", 0), g.normal(size=dim).round(2)) for i in range(60)] + [(90, (1, "a", 0), np.zeros(dim)), (91, (2, "a", 0), np.ones(dim)), (92, (1, "a", 1), np.ones(dim)), (93, (1, "a", 0), np.ones(dim + 1))]
    rows += [(i + 100, s, v) for i, s, v in rows[:10]]
    table = [(i, *s, v.tolist()) for i, s, v in rows] + [(94, 1, "a", 0, None), (95, 1, None, 0, [1.0] * dim), (96, 1, "a", 0, [None] * dim)]
    df = spark.createDataFrame(table, "chunk_id long, organization int, repository string, model int, embedding array<double>")
    asked = df.filter("chunk_id % 4 = 0 or chunk_id > 80").withColumnRenamed("chunk_id", "query_id")
    got = {(x.query_id, x.chunk_id) for x in r.vector_leg(df, asked, 4).collect()}
    assert got == cosines(rows, [x for x in rows if x[0] % 4 == 0 or x[0] > 80], 4)


def test_heaps_are_bounded(spark, monkeypatch):
    """No group gives more than ``limit`` rows for a query, so that many are shuffled."""
    g = np.random.default_rng(2)
    df = spark.createDataFrame([(i, 1, "a", 0, g.normal(size=8).tolist()) for i in range(500)], "chunk_id long, organization int, repository string, model int, embedding array<double>")
    heaps = r.vector_heaps(df, df.filter("chunk_id < 7").withColumnRenamed("chunk_id", "query_id"), 5)
    assert heaps.count() == 35
    assert "zip_with" not in heaps._jdf.queryExecution().toString() and "aggregate(" not in heaps._jdf.queryExecution().toString()


def test_tie_tail_from_heaps(spark):
    rows = [(i, 1, "a", 0, [1.0, i / 100]) for i in range(30)]
    df = spark.createDataFrame(rows, "chunk_id long, organization int, repository string, model int, embedding array<double>")
    asked = df.filter("chunk_id = 0").withColumnRenamed("chunk_id", "query_id")
    got = [x.chunk_id for x in r.exact_with_tie_tail(r.vector_heaps(df, asked, 5, tol=0.002), 5, 0.002).orderBy("rank").collect()]
    score = lambda i: round(1 / (1 + (i / 100) ** 2) ** 0.5, 6)
    assert got == [i for i in range(1, 30) if i <= 5 or score(5) - score(i) <= 0.002]


def test_cell_store(spark, tmp_path):
    """Recall at k = 50 over all vectors of sf0.1 as one scope, with a share of the rows scored; slack 1 gives the exact answer; stored lists are used again."""
    from pyspark.sql import functions as F

    from tessarine.operators.cells import CellStore, n_cells

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.lit(1).alias("model"), "embedding")
    asked = rows.filter("chunk_id % 40 = 0").withColumnRenamed("chunk_id", "query_id")
    exact = {(x.query_id, x.chunk_id) for x in r.vector_leg(rows, asked, scope=("model",)).collect()}
    store = CellStore(rows, ["model"], path=str(tmp_path / "lists"))
    found, stats = store.search(asked, 50)
    got = {(x.query_id, x.chunk_id) for x in found.collect()}
    scored = sum(x.scored for x in stats.collect()) / (asked.count() * rows.count())
    assert len(got) == len(exact) and len(got & exact) >= 0.9 * len(exact) and scored < 0.5
    assert {(x.query_id, x.chunk_id) for x in store.search(asked.limit(5), 50, 1.0)[0].collect()} <= exact
    assert [n_cells(n) for n in (0, 100, 10**12)] == [1, 10, 4096]
    few = CellStore(rows.limit(3), ["model"])
    assert few.search(asked.limit(1), 50)[0].count() <= 3 and CellStore(rows.limit(0), ["model"]).search(asked, 5)[0].count() == 0


@pytest.mark.parametrize("named", [False, True])
def test_blocks_of_a_list_meet_queries_together(spark, named):
    """What is scored, and found, does not depend on how many tasks packed the lists; ids may be strings."""
    from tessarine.operators.cells import CellStore

    rng = np.random.default_rng(4)
    key = (lambda i: f"c{i}") if named else int
    rows = spark.createDataFrame([(1, key(i), v.tolist()) for i, v in enumerate(rng.normal(size=(600, 8)))], f"model int, chunk_id {'string' if named else 'long'}, embedding array<double>")
    asked = rows.limit(30).withColumnRenamed("chunk_id", "query_id")
    got = [tuple(sorted(map(tuple, df.collect())) for df in CellStore(rows.repartition(n), ["model"]).search(asked, 5)) for n in (1, 24)]
    assert got[0] == got[1] and len(got[0][0]) == 150 and all(q != c for q, c, *_ in got[0][0])

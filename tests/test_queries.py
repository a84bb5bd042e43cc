"""Every query with a SQL twin gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from hexlore.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    told = duck.sql(ORACLES[name])
    assert sorted(told.columns) == columns
    at = [told.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[k]) for k in at) for r in told.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_alone(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_zscores_of_all_dimensions(spark, sf_dir):
    sizes = [len(r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    rows = QUERIES["zscore_matrix_all"](spark, sf_dir).collect()
    assert len(rows) == sum(sizes) and {r.d for r in rows} == set(range(max(sizes)))


def test_models_see_whole_vectors_and_labels(spark, sf_dir):
    from hexlore.plans.learning import classes

    told = {r.vec_id: (list(r.embedding), r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    assert {r.vec_id: (r.features.toArray().tolist(), r.label) for r in classes(spark, sf_dir).collect()} == told


def test_importance_of_all_dimensions(spark, sf_dir):
    size = len(spark.read.parquet(f"{sf_dir}/embeddings.parquet").first().embedding)
    assert {r.feature for r in QUERIES["variable_importance"](spark, sf_dir).collect()} == {f"d{k}" for k in range(size)}


def test_sweep_covers_every_k(spark, sf_dir):
    rows = QUERIES["kmeans_best_of_n"](spark, sf_dir).collect()
    assert sorted(r.k for r in rows) == list(range(2, 11)) and all(-1 <= r.silhouette <= 1 for r in rows)
    best = max(sorted(rows, key=lambda r: r.k), key=lambda r: r.silhouette)
    assert [r.k for r in rows if r.chosen] == [max(best.k, 4)]


def test_tree_and_means_agree_alike_over_blocks(spark, sf_dir, monkeypatch):
    from hexlore.operators import cluster

    whole = QUERIES["kmeans_ward_agreement"](spark, sf_dir).collect()
    monkeypatch.setattr(cluster, "MOST_TREE_ROWS", 100)
    assert QUERIES["kmeans_ward_agreement"](spark, sf_dir).collect() == whole


def test_agreement_asks_for_few_jobs(spark, sf_dir):
    """Jobs and stages stay in the driver's memory: a pass of all k-means restarts is one job, whatever their number."""
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    row = QUERIES["kmeans_ward_agreement"](spark, sf_dir).first()
    assert jobs() - before < 90 and 0 <= row.agreement <= row.aligned_agreement <= 1


def test_flagship(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) > 0 and all(r.score is None or 0 <= r.score <= 100 for r in rows)

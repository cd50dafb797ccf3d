"""Every query against its checking SQL on the smallest tables, and the shape of key plans."""

import os

import duckdb
import pytest

import __spark_entry__ as contract

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    df = contract.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    cur = con.execute(SQL[name])
    assert got == rows([d[0] for d in cur.description], cur.fetchall())


def test_every_query_has_its_sql():
    from omenflow import catalog

    assert set(catalog.NAMED) <= set(SQL) <= set(contract.queries())


def test_candidates_meet_on_keys(spark):
    """No nested-loop join among the similarity joins; the scan reads only what is used."""
    from omenflow import catalog
    from omenflow.functions.text import token_set
    from omenflow.operators import tokenjoin

    rows_ = catalog.question_texts(spark, SF)
    groups, _ = tokenjoin.distinct_sets(rows_.selectExpr("question_id AS pos").join(
        rows_.select(rows_.question_id.alias("pos"), token_set("question_text").alias("tokens")), "pos"), ["tokens"])
    keys = tokenjoin.publish(tokenjoin.number_tokens(groups), 0.7)
    plan = tokenjoin.meet(keys.left, keys.right, where=tokenjoin.jaccard_at_least(0.7))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SortMergeJoin" in plan
    scan = catalog.windowed_velocity(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in scan.split("ReadSchema:")[1].split("\n")[0]


def test_views_cover_their_tables(spark):
    """Every article lies in one labelled cluster, and in one customers' cluster that exists."""
    from omenflow import bindings as b

    docs = b.table(spark, SF, "documents").count()
    assert b.view(spark, SF, "labelled_members").count() == docs == b.view(spark, SF, "articles").count()
    assert b.view(spark, SF, "cluster_events").join(b.view(spark, SF, "clusters"), "cluster_id").count() == docs

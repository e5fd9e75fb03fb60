"""Every query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from plangrove import registry

registry.load_all()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(rows):
    norm = lambda v: None if v is None else round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(norm(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, sf_dir, oracle, name):
    df = registry.QUERIES[name](spark, sf_dir)
    rel = oracle.sql(registry.ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    got, want = df.select(*columns).collect(), rel.query("r", f"SELECT {quoted} FROM r").fetchall()
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())


def test_disposition_accounts_for_every_row(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert sum(r["n_rows"] for r in registry.QUERIES["disposition_accounting"](spark, sf_dir).collect()) == n


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["disposition_accounting", "adjacency_mining", "cooccurrence_fit", "legal_rules", "split_impact", "box_adjacency", "overlapping_boxes", "benchmark_contamination", "keep_one_duplicates", "copy_ordinals"])
def test_plans_hold_no_cross_join(spark, sf_dir, name):
    plan = plan_of(registry.QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_are_pruned(spark, sf_dir):
    plan = plan_of(registry.QUERIES["seed_aggregate"](spark, sf_dir))
    assert "props" not in plan and "PushedFilters: [IsNotNull(event_type)" in plan
    assert "text" not in plan_of(registry.QUERIES["inventory_coverage"](spark, sf_dir))


def test_text_constraints_of_odd_texts(spark, tmp_path):
    """Numbers beyond an integer, white space and letters beyond ASCII: as the query's SQL has them."""
    texts = ["99999999999 the 5", "99999999999 the", "the 2147483648", "5 the\u00e9", "5\x0bthe", "the\x0b7", "5\u00a0the", "5 THE_X", "FAM\u0130LY 5 the", "THE 05", "5\nthe", None, ""]
    spark.createDataFrame([(k, t, ["E\u0130\u03a3", None][k % 2], 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["text_constraint_parse"](spark, str(tmp_path)).orderBy("doc_id").collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert [tuple(r) for r in got] == sorted(db.execute(registry.ORACLE["text_constraint_parse"]).fetchall())

"""Every registered query against its SQL, and plan properties that matter at scale."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from rolefit.operators import recommend as Rec
from rolefit.oracles import ORACLES
from rolefit.queries import QUERIES
from tests.conftest import SF

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted(map(repr, cursor.fetchall()))
    got = sorted(repr(tuple(row)) for row in df.select(*columns).collect())
    assert got == expected


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "score" in df.columns


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loops_and_no_python(spark, name, monkeypatch):
    """Also in the plans of the tables that are written on the way."""
    plans, write = [], Rec.written

    def seen(df, table):
        plans.append(plan(df))
        return write(df, table)

    monkeypatch.setattr(Rec, "written", seen)
    plans.append(plan(QUERIES[name](spark, SF)))
    for operator in ["NestedLoop", "CartesianProduct", "PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"]:
        assert not any(operator in text for text in plans)


@pytest.mark.parametrize("name", ["profile_upsert", "profile_lookup", "preference_upsert", "preference_lookup", "staging_dedup",
                                  "curated_jobs", "dedup_documents"])
def test_wide_rows_are_not_sorted_to_be_reduced(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "SortAggregate" not in text and "hint" not in text.lower()


@pytest.mark.parametrize("name", ["recommend_from_latest", "recommend_preferences", "recommend_topk"])
def test_no_table_that_grows_is_broadcast(spark, name, monkeypatch):
    plans, write = [], Rec.written

    def seen(df, table):
        plans.append(plan(df))
        return write(df, table)

    monkeypatch.setattr(Rec, "written", seen)
    plans.append(plan(QUERIES[name](spark, SF)))
    for key in ["gid", "sid", "ord", "c_class"]:
        assert not any(f"BroadcastHashJoin [{key}#" in text for text in plans), key


def test_top_k_is_limited_before_the_shuffle(spark):
    from rolefit import queries as Q
    from rolefit.operators import recommend as Rec
    from rolefit.operators.features import JOB_SIGNATURE

    text = plan(Rec.job_signatures(Q.match_jobs(spark, SF), JOB_SIGNATURE, 10))
    # The plan is printed from the result down to the scan. One shuffle serves
    # the limit and the grouping after it.
    final, partial = text.index("row_number(), 10, Final"), text.index("row_number(), 10, Partial")
    assert final < text.index("Exchange hashpartitioning(j_req") < partial
    assert text.count("Exchange hashpartitioning(j_req") == 1


def test_extraction_needs_no_shuffle(spark):
    from pyspark.sql import functions as F
    from rolefit.operators import enrich as En

    df = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("job_uid"),
                                                              F.col("text").alias("description"))
    assert "Exchange" not in plan(En.enrich(df))


@pytest.mark.parametrize("name", ["skill_hits", "education_min", "skills_required_preferred"])
def test_texts_of_few_row_groups_are_dealt_over_all_tasks(spark, name):
    """The given tables have one row group each, so two tasks would read all postings."""
    from pyspark.sql import functions as F
    from rolefit import queries as Q

    rows = Q.texts(spark, SF).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(rows) > 16 and max(r["count"] for r in rows) * 8 < sum(r["count"] for r in rows)
    assert "REPARTITION_BY_NUM" in plan(QUERIES[name](spark, SF))


def test_given_jobs_and_candidates_are_dealt_over_all_tasks(spark):
    from pyspark.sql import functions as F
    from rolefit import fixtures as fx

    for rows in (fx.jobs(spark, SF), fx.candidate_payloads(spark, SF)):
        tasks = rows.groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert len(tasks) > 16 and max(r["count"] for r in tasks) * 8 < sum(r["count"] for r in tasks)


def test_no_preference_that_grows_is_broadcast(spark, monkeypatch):
    plans, write = [], Rec.written

    def seen(df, table):
        plans.append(plan(df))
        return write(df, table)

    monkeypatch.setattr(Rec, "written", seen)
    plans.append(plan(QUERIES["recommend_preferences"](spark, SF)))
    for key in ["candidate_id", "pid", "pkey", "jid", "jkey", "fkey", "shape"]:
        assert not any(f"BroadcastHashJoin [{key}#" in text for text in plans), key


@pytest.mark.parametrize("name", ["match_explanations", "match_pairs"])
def test_no_method_is_generated_that_the_jvm_does_not_compile(spark, name):
    limit = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.unset(limit)
    assert int(spark.conf.get(limit)) > 8000
    assert QUERIES[name](spark, SF).count() > 0
    assert int(spark.conf.get(limit)) <= 8000
    QUERIES["education_min"](spark, SF)
    assert int(spark.conf.get(limit)) > 8000

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from evidentia.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, con, name):
    df, r = catalogue.QUERIES[name](spark, SF), con.sql(catalogue.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(r.columns)
    norm = lambda v: round(v, 9) if isinstance(v, float) else v
    got = sorted((repr([norm(x[c]) for c in cols]) for x in df.collect()))
    at = [r.columns.index(c) for c in cols]
    assert got == sorted(repr([norm(x[i]) for i in at]) for x in r.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["q_validate_package", "q_validate_document", "q_validate_constructed_item", "q_validate_construction_record", "q_generate_items", "q_answer_record"])
def test_records_of_one_file_are_judged_in_several_tasks(spark, name):
    assert catalogue.QUERIES[name](spark, SF).select(F.spark_partition_id()).distinct().count() > 1


def test_least_discordance_of_a_column(spark):
    from evidentia.functions import stats

    a = [0.5, 0.05, 0.01, 0.001, 2.0**-30, 2.0**-30 * (1 + 2**-52), 2.0**-30 * (1 - 2**-53), 0.999, 1e-300, 1 / 3]
    rows = spark.createDataFrame([(x,) for x in a], "a double").select("a", stats.least_discordance_of(F.col("a")).alias("k")).collect()
    assert {r.a: r.k for r in rows} == {x: stats.least_discordance(x) for x in a}
    assert spark.createDataFrame([(0.0,), (1.0,), (-1.0,)], "a double").filter(stats.least_discordance_of(F.col("a")).isNotNull()).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name, table", [("q_min_discordance", "part"), ("q_motif_catalogue", "events")])
def test_rows_come_from_a_table(spark, name, table):
    assert any(f"/{table}.parquet" in f for f in catalogue.QUERIES[name](spark, SF).inputFiles())

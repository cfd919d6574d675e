"""Every registered query runs and, where it has SQL, gives the rows of that SQL."""

import pytest

import __spark_entry__ as registry
from checks import compare, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.database(SF)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, con, name):
    ok, note = compare.compare(spark, con, name, SF)
    assert ok, note


def test_entry(spark):
    assert registry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", ["t3_new_files", "t3_counts_of_new_files"])
def test_streamed_tables_may_be_folders_of_files(spark, tmp_path, name):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    documents.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    documents.write.parquet(f"{tmp_path}/old_documents.parquet")
    run = registry.queries()[name]
    assert sorted(run(spark, str(tmp_path)).collect()) == sorted(run(spark, SF).collect()) != []


def test_files_without_a_number_do_not_meet_in_one_task(spark):
    numbered = queries._numbered(queries._code(spark, SF))
    assert 0 < numbered.count() < queries._code(spark, SF).count() and numbered.where("doc = ''").isEmpty()


def test_texts_are_parsed_once(spark):
    planned = registry.queries()["a7_try_and_none"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert planned.count("MapInArrow") <= 1


def test_history_is_written_by_many_tasks(spark, tmp_path):
    sizes = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize"]
    kept = {name: spark.conf.get(name) for name in sizes}
    for name in sizes:
        spark.conf.set(name, "1k")
    written = []
    read = queries.history.read_history_json
    queries.history.read_history_json = lambda spark, path: written.append(path) or read(spark, path)
    try:
        rows = registry.queries()["s9_history_file"](spark, SF).count()
    finally:
        queries.history.read_history_json = read
        for name in sizes:
            spark.conf.set(name, kept[name])
    files = spark.read.text(written[0]).select("_metadata.file_path").distinct().count()
    assert files > 1 and rows == spark.read.parquet(f"{SF}/orders.parquet").count()

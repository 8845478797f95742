import pytest
from pyspark.sql import functions as F

from tallyframe.session import scratch_path, shared_dir
from tallyframe.sources import database, files, tables

SETTINGS = {"host": "h", "port": "3306", "database": "d", "table": "t", "user": "u", "password": "p"}


def test_csv_and_ingest_modes(spark, tmp_path):
    df = spark.createDataFrame([(1, "Ann, B", 1.5), (2, None, None)], "id int, name string, pay double")
    source, target = str(tmp_path / "csv"), str(tmp_path / "out")
    files.write_csv(df, source)
    schema = "id int, name string, pay double"
    assert sorted(files.read_csv(spark, source, schema).collect()) == sorted(df.collect())
    assert files.ingest_csv(spark, source, schema, target).count() == 2
    assert files.ingest_csv(spark, source, schema, target, "append").count() == 4
    assert files.ingest_csv(spark, source, schema, target, "replace").count() == 2
    with pytest.raises(Exception, match="already exists"):
        files.ingest_csv(spark, source, schema, target, "fail")
    with pytest.raises(ValueError):
        files.ingest_csv(spark, source, schema, target, "merge")


def test_text_lines(spark, tmp_path):
    df = spark.createDataFrame([("one ",), ("two",)], "line string")
    first, copy = str(tmp_path / "a"), str(tmp_path / "b")
    files.write_lines(df, "line", first)
    files.write_lines(df, "line", first, mode="append")
    files.copy_lines(spark, first, copy)
    assert sorted(r["line"] for r in files.read_lines(spark, copy).collect()) == ["one", "one", "two", "two"]


def test_jdbc_options():
    options = database.jdbc_options("mysql", {**SETTINGS, "partition_column": "id", "lower": "0", "upper": "9", "partitions": "3"})
    assert options["url"] == "jdbc:mysql://h:3306/d" and options["numPartitions"] == "3"
    with pytest.raises(ValueError, match="unknown backend"):
        database.jdbc_options("other", SETTINGS)
    with pytest.raises(ValueError, match="password"):
        database.jdbc_options("mysql", {k: v for k, v in SETTINGS.items() if k != "password"})
    assert database.settings_from_env({"DB_HOST": "h"}) == {"host": "h"}


def test_load_table_contract(spark):
    frame = spark.createDataFrame([(1,), (2,)], "x int")
    load = lambda cond=None, reader=None: database.load_table(spark, "mysql", SETTINGS, cond, reader or (lambda s, o: frame))
    assert load(F.col("x") > 1).count() == 1
    with pytest.raises(RuntimeError, match="no rows"):
        load(F.col("x") > 5)

    def broken(session, options):
        raise OSError("refused")

    with pytest.raises(RuntimeError, match="refused"):
        load(reader=broken)


def test_tables_views_and_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(1, "s"), (2, "t")], "id int, secret string")
    assert tables.create_table(df, "tf_test", str(tmp_path / "t")).count() == 2
    tables.drop_table(spark, "tf_test")
    assert not spark.catalog.tableExists("tf_test")
    assert tables.create_view(df, "public", ["id"]).columns == ["id"]
    snapshot = tables.create_snapshot(df.withColumn("r", F.rand()), "snap")
    assert sorted(snapshot.collect()) == sorted(spark.table("snap").collect())
    counts = tables.table_counts(spark, ["public", "snap"]).collect()
    assert [(r["table_name"], r["row_count"]) for r in counts] == [("public", 2), ("snap", 2)]
    assert tables.drop_snapshot(spark, "snap")
    with pytest.raises(ValueError):
        tables.table_counts(spark, [])


def test_scratch_paths_lie_in_the_configured_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark).startswith(configured)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_csv_by_header_name_quotes_and_line_breaks(spark, tmp_path):
    folder = tmp_path / "by-name"
    folder.mkdir()
    (folder / "x.csv").write_text('name,extra,id\n"He said ""hi"", ok",z,1\n"two\nlines",,2\n')
    got = files.read_csv(spark, str(folder), "id int, name string").collect()
    assert sorted(map(tuple, got)) == [(1, 'He said "hi", ok'), (2, "two\nlines")]
    with pytest.raises(ValueError, match="absent"):
        files.read_csv(spark, str(folder), "absent int")
    with pytest.raises(Exception, match="(?i)malformed|cast|parse"):
        files.read_csv(spark, str(folder), "id int, name int").collect()


def test_csv_keeps_every_text(spark, tmp_path):
    rows = [(1, ' "q", \\ back\\'), (2, "a\nb"), (3, ""), (4, None), (5, "x"), (6, '\\"')]
    df = spark.createDataFrame(rows, "id int, t string")
    files.write_csv(df, str(tmp_path / "t"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "t"), "id int, t string").collect())) == rows


def test_table_rebuilt_from_itself(spark):
    name = "rebuilt_from_itself"
    tables.create_table(spark.range(5).toDF("n"), name)
    rebuilt = tables.create_table(spark.table(name).where("n > 1"), name)
    assert sorted(r["n"] for r in rebuilt.collect()) == [2, 3, 4]
    tables.drop_table(spark, name)
    assert not spark.catalog.tableExists(name)


def test_stages_are_deleted_with_their_block(spark):
    from pathlib import Path

    from tallyframe.session import delete_stage, materialise, stages

    root = Path(shared_dir(spark).removeprefix("file:"))
    before = set(root.iterdir())
    with stages(spark):
        kept = materialise(spark.range(10))
        assert kept.count() == 10 and len(set(root.iterdir()) - before) == 1
    assert set(root.iterdir()) == before
    tables.create_snapshot(spark.range(3).toDF("n"), "short_lived")
    assert tables.drop_snapshot(spark, "short_lived") and set(root.iterdir()) == before
    with pytest.raises(ValueError, match="not under"):
        delete_stage(spark, "/tmp/elsewhere")


def test_columns_of_the_catalog(spark):
    spark.range(1).selectExpr("id", "'x' AS t").createOrReplaceTempView("listed_view")
    got = [tuple(r)[:4] for r in tables.table_columns(spark, ["listed_view"]).orderBy("position").collect()]
    assert got == [("listed_view", 1, "id", "bigint"), ("listed_view", 2, "t", "string")]
    spark.catalog.dropTempView("listed_view")

import json
from pathlib import Path

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.functions.columns import format_bytes, label_name, parent_id_array
from faultlens.plans.report import report, unified_report, write_reports
from faultlens.plans.workloads import generated_values, hot_key_lines
from faultlens.session import broadcast_if_small, shared_folder
from faultlens.sources import delimited, manifest, tables


def test_text_tables_to_parquet(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "nation.tbl").write_text("0|ALGERIA|0|quiet|\n1|BRAZIL|1|a, b|\n")
    (raw / "orders.tbl").write_text("1|7|O|1.50|1996-01-02|5-LOW|Clerk#1|0|note|\n2|8|F|x|1996-01-03|1-URGENT|C|0|n|\n")
    outcome = delimited.convert_all(spark, str(raw), f"{tmp_path}/lake")
    assert outcome["nation"] is None and outcome["orders"] is None
    assert all(outcome[n] for n in delimited.SCHEMAS if n not in ("nation", "orders"))
    orders = spark.read.parquet(f"{tmp_path}/lake/orders")
    assert [(r.o_orderkey, r.o_totalprice, r.o_orderdate) for r in orders.orderBy("o_orderkey").collect()] == [
        (1, 1.5, "1996-01-02"),
        (2, None, "1996-01-03"),
    ]
    found = tables.register_views(spark, f"{tmp_path}/lake", list(delimited.SCHEMAS))
    assert sorted(found) == ["nation", "orders"]
    assert spark.sql("SELECT n_comment FROM nation WHERE n_name = 'BRAZIL'").first()[0] == "a, b"
    listed = {r.table_name: r for r in tables.table_summary(spark, f"{tmp_path}/lake", ["nation", "orders", "part"]).collect()}
    assert listed["nation"].row_count == 2 and listed["nation"].bytes > 0
    assert (listed["part"].row_count, listed["part"].size) == (None, "NOT FOUND")
    assert tables.table_summary(spark, f"{tmp_path}/none", ["part"]).first().size == "NOT FOUND"
    inventory = tables.storage_inventory(spark, f"{tmp_path}/lake").collect()
    assert sum(r.files for r in inventory) == len(tables.stored_files(spark, f"{tmp_path}/lake").collect())


def test_files_follow_the_data(spark, tmp_path):
    """More input gives more files, for every table alike."""
    raw, counts = tmp_path / "raw", []
    raw.mkdir()
    small = {"advisoryPartitionSizeInBytes": "32k", "coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(f"spark.sql.adaptive.{k}") for k in small}
    for k, v in small.items():
        spark.conf.set(f"spark.sql.adaptive.{k}", v)
    try:
        for rows in (10, 20_000):
            (raw / "part.tbl").write_text("".join(f"{i}|name {i * 7919}|m|b|t|1|c|1.0|comment {i * 104729}|\n" for i in range(rows)))
            delimited.convert_table(spark, "part", str(raw), f"{tmp_path}/lake")
            counts.append(len(list((tmp_path / "lake" / "part").glob("*.parquet"))))
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.adaptive.{k}", v)
    assert counts[0] == 1 < counts[1], counts


def test_unknown_table(spark):
    with pytest.raises(ValueError):
        delimited.read_raw_table(spark, "nope", "/tmp")


def test_missing_parquet_is_empty(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    empty = tables.parquet_or_empty(spark, f"{tmp_path}/absent", schema)
    assert empty.schema == schema and empty.count() == 0
    spark.range(2).write.parquet(f"{tmp_path}/there")
    assert tables.parquet_or_empty(spark, f"{tmp_path}/there", schema).count() == 2


def test_manifest(spark, tmp_path):
    path = f"{tmp_path}/runs"
    schema = ", ".join(f"{c} STRING" for c in manifest.MANIFEST_COLUMNS)
    first = [("A", " OOM ", "1", "001", "t", "x", "FINISHED"), ("B", "OOM", "1", "002", "t", "x", "TIMEOUT")]
    second = [("C", "SKEW", "2", "001", "t", "x", "FAILED"), ("D", "SKEW", "2", "002", "t", "x", "ERROR: lost")]
    manifest.append_runs(spark.createDataFrame(first, schema), path)
    manifest.append_runs(spark.createDataFrame(second, schema), path)
    (tmp_path / "runs" / "short.csv").write_text("h\nE,SKEW,2,003\n")
    runs = manifest.read_manifest(spark, path)
    assert {tuple(r) for r in manifest.completed_runs(runs).collect()} == {("OOM", "001"), ("SKEW", "001")}
    planned = spark.createDataFrame([("OOM", "001"), ("OOM", "002"), ("NET", "001")], "FailureType STRING, RunId STRING")
    assert {tuple(r) for r in manifest.pending_runs(planned, runs).collect()} == {("OOM", "002"), ("NET", "001")}
    totals = {r.FailureType: (r.submitted, r.errors) for r in manifest.summary(runs).collect()}
    assert totals == {"OOM": (1, 0), "SKEW": (1, 1)}


def test_report_with_vectors_and_old_columns(spark):
    results = spark.createDataFrame([("a", 3, "4,5"), ("b", None, "")], "app_id STRING, root_cause_stage_id INT, victim_stages STRING")
    scored = spark.createDataFrame(
        [("a", 4.0, Vectors.dense([0.2, 0.8])), ("c", 9.0, Vectors.dense([1.0]))], ["app_id", "prediction", "probability"]
    )
    found = {r.app_id: r for r in unified_report(results, scored).collect()}
    assert (found["a"].root_cause_stages, found["a"].victim_stages) == ([3], [4, 5])
    assert (found["a"].predicted_class, found["a"].confidence) == ("Network Timeout", 0.8)
    assert (found["b"].root_cause_stages, found["b"].predicted_class, found["b"].confidence) == ([], "Not Available", 0.0)
    assert (found["c"].predicted_class, found["c"].confidence) == ("Unknown", 1.0)
    assert '"root_cause_analysis":{"root_cause_stages":[3],"victim_stages":[4,5]}' in found["a"].report_json
    assert [r.app_id for r in unified_report(results, scored, "c").collect()] == ["c"]
    assert unified_report(results, scored, "zzz").count() == 0


def test_small_columns(spark):
    sizes = spark.createDataFrame([(0,), (1023,), (1024,), (1536 * 1024,), (5 << 30,)], "n BIGINT")
    assert [r[0] for r in sizes.select(format_bytes(F.col("n"))).collect()] == ["0 B", "1023 B", "1.00 KB", "1.50 MB", "5.00 GB"]
    texts = spark.createDataFrame([("1, 2,x,2,",), (None,), ("",), ("99999999999",)], "t STRING")
    assert [r[0] for r in texts.select(parent_id_array(F.col("t"))).collect()] == [[1, 2], [], [], []]
    labels = spark.createDataFrame([(2,), (9,)], "n INT")
    assert [r[0] for r in labels.select(label_name(F.col("n"))).collect()] == ["Data Skew", "Unknown"]


def test_stored_report(spark, tmp_path):
    results = spark.createDataFrame([("a", "3", "")], "app_id STRING, root_cause_stage_ids STRING, victim_stages STRING")
    results.write.parquet(f"{tmp_path}/rca")
    found = report(spark, f"{tmp_path}/rca", f"{tmp_path}/absent")
    write_reports(found, f"{tmp_path}/json")
    line = json.loads(spark.read.text(f"{tmp_path}/json").first()[0])
    assert line["root_cause_analysis"] == {"root_cause_stages": [3], "victim_stages": []}
    assert line["failure_classification"] == {"predicted_class": "Not Available", "confidence": 0.0}
    assert report(spark, f"{tmp_path}/x", f"{tmp_path}/y").count() == 0


def test_generated_rows(spark):
    values = generated_values(spark, 101, 5, seed=3)
    assert values.count() == 100 and values.select("category").distinct().count() == 5
    assert values.exceptAll(generated_values(spark, 101, 5, seed=3)).isEmpty()
    assert hot_key_lines(spark, 10, 3, 2.5).groupBy("l_orderkey").sum("l_quantity").first()[1] == 25.0


def test_broadcast_needs_a_small_estimate(spark):
    df = spark.range(1000)
    assert "hint" in broadcast_if_small(df)._jdf.queryExecution().logical().toString().lower()
    assert "hint" not in broadcast_if_small(df, limit=10)._jdf.queryExecution().logical().toString().lower()


def test_shared_folder_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) == (named or spark.sparkContext.getCheckpointDir()).rstrip("/")


def test_appending_again_adds_nothing(spark, tmp_path, monkeypatch):
    """The same job twice, half of it lost, other runs and other times of a run: every entry once."""
    path = str(tmp_path / "manifest")
    schema = ", ".join(f"{c} STRING" for c in manifest.MANIFEST_COLUMNS)
    rows = [(f"a{k}", " OOM", "1", f"{k:03}", str(100 + k), "app" if k % 2 else "", "ERROR" if k == 3 else "FINISHED") for k in range(8)]
    runs = spark.createDataFrame(rows, schema).repartition(4)
    assert manifest.append_runs(runs.limit(0), path) == 0
    assert manifest.append_runs(runs, path) == 8 and manifest.append_runs(runs, path) == 0
    # A lost job: some of its files are gone, as if they had never appeared.
    sorted((tmp_path / "manifest").glob("part-*.csv"))[0].unlink()
    manifest.append_runs(runs.unionByName(runs), path)
    later = spark.createDataFrame([(*rows[3][:4], "900", "app", "FINISHED")], schema)
    assert manifest.append_runs(later, path) == 1 and manifest.append_runs(later, path) == 0
    found = manifest.read_manifest(spark, path)
    assert found.count() == found.select("FailureType", "RunId", "Timestamp").distinct().count() == 9
    assert {r.submitted for r in manifest.summary(found).collect()} == {8}


def test_sizes_of_the_given_tables(spark, data):
    from __spark_entry__ import queries

    rows = {r.table_name: r for r in queries()["table_sizes"](spark, data).collect()}
    assert len(rows) == 14
    for name, row in rows.items():
        path = Path(data, f"{name}.parquet")
        files = [path] if path.is_file() else list(path.rglob("*.parquet"))
        assert (row.files, row.bytes) == (len(files), sum(f.stat().st_size for f in files)), name
        assert row.row_count == spark.read.parquet(str(path)).count()
    empty = tables.table_sizes({"none": spark.read.parquet(f"{data}/nation.parquet").filter("false")}).first()
    assert (empty.row_count, empty.files, empty.bytes) == (0, 0, 0)


def test_bucketed_join_moves_no_lines(spark, data):
    from faultlens.plans import workloads

    df = workloads.bucketed_join(workloads.Tables(spark, data))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("SortMergeJoin"):].split("== Initial Plan ==")[0]
    assert "Bucketed: true" in join and "Exchange" not in join, plan
    from faultlens.sources.bucketed import bucket_count

    assert bucket_count(spark.range(10)) == 2 and bucket_count(spark.range(1 << 30)) == 64


def test_buckets_by_rows(spark):
    """Well packed files are small, their rows are not."""
    from faultlens.sources.bucketed import bucket_count

    assert bucket_count(spark.range(10), rows=100 << 20) == 128

from __future__ import annotations

import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from cohortlens import plans
from cohortlens.schemas import SCHEMAS, ClinicalTables, SchemaError, conform
from cohortlens.sources import (
    SnapshotError,
    clear_run,
    freeze,
    jdbc_options,
    jdbc_predicates,
    load_tables,
    scratch,
    snapshot_folder,
    thaw,
)
from cohortlens.sources import snapshot
from cohortlens.sources.jdbc import ROW, adapt_columns, read_plan
from edge import edge_tables


@pytest.fixture(scope="module")
def tables(spark):
    return edge_tables(spark)


def test_load_tables_reads_and_checks(spark, tables, tmp_path):
    for name in SCHEMAS:
        wide = getattr(tables, name).withColumn("extra", F.lit(1))
        wide.coalesce(1).write.parquet(f"{tmp_path}/{name}")
    loaded = load_tables(spark, str(tmp_path))
    for name, schema in SCHEMAS.items():
        assert getattr(loaded, name).columns == schema.names
    assert plans.build_cohort(loaded).count() == 6
    loaded.create_views("clinical_")
    assert spark.table("clinical_patients").count() == 4
    loaded.create_views("clinical_")


def test_wrong_tables_are_named(tables):
    bad = tables.icustays.withColumn("intime", F.col("intime").cast("timestamp")).drop("outtime")
    with pytest.raises(SchemaError, match="icustays: intime is timestamp, not timestamp_ntz; outtime is missing"):
        conform(bad, "icustays")
    with pytest.raises(SchemaError):
        ClinicalTables(**{name: tables.patients for name in SCHEMAS})


def test_jdbc_options():
    connection = {"url": "jdbc:postgresql://host/db", "user": "u", "password": "p"}
    plain = jdbc_options("patients", connection)
    assert plain["dbtable"] == "patients" and "partitionColumn" not in plain
    split = jdbc_options("icustays", connection, {"hadm_id": (1, 900)}, 16, db_schema="clinic")
    assert split["dbtable"] == "clinic.icustays"
    assert (split["partitionColumn"], split["lowerBound"], split["upperBound"], split["numPartitions"]) == (
        "hadm_id", "1", "900", "16",
    )
    with pytest.raises(ValueError):
        jdbc_options("patients", {"user": "u"})
    assert set(connection) == {"url", "user", "password"}


def test_database_types_are_adapted(spark):
    raw = spark.sql(
        "select 7 as hadm_id, 'x' as drug, 2.5 as dose_val_rx, 'mg' as dose_unit_rx, date'2020-01-02' as startdate"
    )
    adapted = adapt_columns(raw, "prescriptions")
    types = lambda schema: [(f.name, f.dataType) for f in schema]
    assert types(adapted.schema) == types(SCHEMAS["prescriptions"])
    assert str(adapted.first()["startdate"]) == "2020-01-02 00:00:00"


def test_narrower_types_are_widened(spark, tables, rows, tmp_path):
    narrow = tables.prescriptions.withColumns(
        {"hadm_id": F.col("hadm_id").cast("int"), "startdate": F.col("startdate").cast("date")}
    )
    wide = conform(narrow, "prescriptions")
    assert [f.dataType for f in wide.schema] == [f.dataType for f in SCHEMAS["prescriptions"]]
    assert str(wide.where("startdate is not null").first()["startdate"]).endswith("00:00:00")
    for kind, fits in (("smallint", True), ("decimal(18,0)", True), ("decimal(19,0)", False), ("decimal(10,2)", False), ("double", False), ("string", False)):
        one = tables.icustays.withColumn("hadm_id", F.lit(7).cast(kind))
        if fits:
            assert conform(one, "icustays").first()["hadm_id"] == 7
        else:
            with pytest.raises(SchemaError, match="hadm_id is"):
                conform(one, "icustays")
    # a wider type than declared could lose values
    with pytest.raises(SchemaError, match="seq_num is bigint, not int"):
        conform(tables.diagnoses_icd.withColumn("seq_num", F.col("seq_num").cast("long")), "diagnoses_icd")
    for name in SCHEMAS:
        (narrow if name == "prescriptions" else getattr(tables, name)).write.parquet(f"{tmp_path}/{name}")
    loaded = load_tables(spark, str(tmp_path))
    assert rows(loaded.prescriptions.orderBy("hadm_id", "drug", "dose_val_rx").select("hadm_id")) == rows(
        tables.prescriptions.orderBy("hadm_id", "drug", "dose_val_rx").select("hadm_id")
    )


def test_jdbc_reads_are_split(spark):
    connection = {"url": "jdbc:postgresql://host/db", "user": "u"}
    options, predicates = read_plan("icustays", connection, partitions=8, db_schema="clinic")
    assert options["dbtable"] == f"clinic.icustays {ROW}" and len(predicates) == 8 and f"{ROW}::text" in predicates[0]
    options, predicates = read_plan("icustays", connection, bounds={"hadm_id": (1, 9)}, partitions=8)
    assert predicates is None and options["numPartitions"] == "8"
    other = {"url": "jdbc:other://host/db"}
    with pytest.raises(ValueError, match="one task"):
        read_plan("icustays", other)
    with pytest.raises(ValueError, match="one task"):
        read_plan("patients", other, bounds={"hadm_id": (1, 9)})
    assert read_plan("icustays", other, partitions=1)[1] is None
    assert len(read_plan("icustays", other, row_hash="some_hash(x)")[1]) == 64
    # the conditions hold every row exactly once, a NULL or negative hash included
    conditions = jdbc_predicates(5, "h")
    held = spark.sql("select explode(array(null, 0, -1, -7, 12, 9223372036854775807L, -9223372036854775807L)) h")
    counts = held.select(sum((F.expr(c).cast("int") for c in conditions), F.lit(0)).alias("n")).collect()
    assert {r["n"] for r in counts} == {1}


def test_freeze_and_thaw(spark, rows, tmp_path):
    path = freeze(spark.range(3), f"{tmp_path}/x")
    first = thaw(spark, path)
    freeze(spark.range(5), path)
    assert thaw(spark, path).count() == 5
    # a frame of the result before the last one can still be read
    assert first.count() == 3
    for n in (6, 7):
        freeze(spark.range(n), path)
    assert thaw(spark, path).count() == 7
    kept = [p.name for p in Path(path).iterdir() if not p.name.startswith(".")]
    assert sorted(n.split("-")[0] for n in kept) == ["data", "data", "manifest", "manifest"]


def test_frozen_result_may_be_made_from_itself(spark, tmp_path):
    path = freeze(spark.range(3).withColumn("x", F.array(F.lit(1))), f"{tmp_path}/x")
    freeze(thaw(spark, path).where("id > 0"), path)
    assert thaw(spark, path).count() == 2


def test_failed_write_leaves_the_old_result(spark, tmp_path):
    path = freeze(spark.range(3), f"{tmp_path}/x")
    broken = spark.range(100).select(F.when(F.col("id") > 50, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        freeze(broken, path)
    assert thaw(spark, path).count() == 3
    assert len([p for p in Path(path).iterdir() if p.name.startswith("data-")]) == 1


def test_second_writer_of_a_number_fails(spark, tmp_path, monkeypatch):
    path = freeze(spark.range(3), f"{tmp_path}/x")
    seen = snapshot._commits(spark, path)
    freeze(spark.range(4), path)
    monkeypatch.setattr(snapshot, "_commits", lambda *_: seen)  # as a writer sees it that began earlier
    with pytest.raises(SnapshotError, match="another writer"):
        freeze(spark.range(9), path)
    monkeypatch.undo()
    assert thaw(spark, path).count() == 4


def test_thaw_checks_what_it_finds(spark, tmp_path):
    with pytest.raises(SnapshotError, match="no frozen result"):
        thaw(spark, f"{tmp_path}/nothing")
    path = freeze(spark.range(0, 8, 1, 4), f"{tmp_path}/x")
    part = next(Path(path).glob("data-*/part-*"))
    part.rename(f"{tmp_path}/lost")
    with pytest.raises(SnapshotError, match="holds 6 rows of 8"):
        thaw(spark, path)
    assert thaw(spark, path, check=False).count() == 6
    empty = thaw(spark, freeze(spark.range(0), f"{tmp_path}/empty"))
    assert empty.columns == ["id"] and empty.count() == 0
    other = freeze(spark.range(2), f"{tmp_path}/other")
    folder = next(Path(other).glob("data-*"))
    spark.range(2).select(F.col("id").cast("string").alias("id")).write.mode("overwrite").parquet(str(folder))
    with pytest.raises(SnapshotError, match="another schema"):
        thaw(spark, other)


def test_scratch_is_new_and_shared(spark):
    alone = {"spark.sql.warehouse.dir": "file:/disk/of/this/machine"}
    named = {"spark.checkpoint.dir": "hdfs://shared/folder/"}
    disk = {"spark.checkpoint.dir": "file:///disk"}
    cluster = lambda conf: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077"))
    for conf in (alone, disk):
        with pytest.raises(ValueError, match="one machine"):
            snapshot.shared_folder(cluster(conf))
        assert snapshot.shared_folder(cluster(conf | {snapshot.SHARED_MOUNT: "true"})).startswith("file:")
    assert snapshot.shared_folder(cluster(named)) == "hdfs://shared/folder"
    for master in ("local[8]", "local-cluster[3,2,1000]"):
        local = SimpleNamespace(conf=alone, sparkContext=SimpleNamespace(master=master))
        assert snapshot.shared_folder(local) == alone["spark.sql.warehouse.dir"]
    first, second = snapshot_folder(spark, "a"), snapshot_folder(spark, "a")
    assert first != second and Path(first.removeprefix("file:")).parent.is_dir()


def test_clearing_a_run(spark):
    kept = scratch(spark.range(4))
    assert kept.count() == 4
    folder = Path(snapshot.run_folder(spark).removeprefix("file:"))
    assert any(folder.iterdir())
    clear_run(spark)
    assert not folder.exists()
    assert scratch(spark.range(2)).count() == 2


def test_package_can_be_shipped(tmp_path):
    from cohortlens.session import zipped_package

    (tmp_path / "package.zip").write_bytes(zipped_package())
    code = f"import sys; sys.path.insert(0, '{tmp_path}/package.zip'); import cohortlens.catalog; print(cohortlens.__file__)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and "package.zip" in done.stdout, done.stderr[-2000:]


def test_shipped_package_reaches_the_workers(spark):
    from cohortlens.session import ship_package

    path = ship_package(spark)
    assert ship_package(spark) == path
    found = spark.sparkContext.parallelize([0], 1).map(lambda _: [p for p in __import__("sys").path if p.endswith("cohortlens.zip")]).first()
    assert found


def test_nothing_is_left_when_the_driver_ends(tmp_path):
    code = f"""
from cohortlens.session import build_session
from cohortlens.catalog import run
spark = build_session("t", "local[2]", {{"spark.sql.warehouse.dir": "{tmp_path}/w", "spark.checkpoint.dir": "{tmp_path}/shared", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
assert run("frozen_outcomes", spark, "/root/testdata/sf0.001").count() == 12
import os
assert [n for n in os.listdir("{tmp_path}/shared") if n.startswith("run-")]
"""
    root = str(Path(__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert [p for p in (tmp_path / "shared").iterdir() if p.name.startswith("run-")] == []
    assert not (tmp_path / "w" / "_snapshots").exists()


def test_frozen_report_equals_the_lazy_one(spark, tables, tmp_path):
    frozen = plans.freeze_report(spark, tables, str(tmp_path))
    labeled = plans.label_cohort(plans.build_cohort(tables))
    exposures = plans.build_exposures(tables, labeled)
    lazy = plans.report_tables(labeled, exposures)
    for name, table in lazy.items():
        assert sorted(map(str, frozen[name].collect())) == sorted(map(str, table.collect())), name
    assert frozen["cohort_rows"].count() == 6 and frozen["exposure_rows"].count() == 6


def test_views_answer_sql(spark, tables, rows):
    plans.create_views(tables)
    plans.create_views(tables)
    got = rows(
        spark.sql(
            "SELECT heart_failure, count(*) AS n, "
            "round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct "
            "FROM cohort GROUP BY heart_failure ORDER BY 1"
        )
    )
    assert [(flag, n, float(pct)) for flag, n, pct in got] == [(0, 3, 50.0), (1, 3, 50.0)]
    checks = spark.sql(
        "SELECT count(*), count(DISTINCT hadm_id), count(DISTINCT drug), sum(in_icu) FROM exposures"
    )
    assert rows(checks) == [(6, 3, 2, 3)]
    # a view over a view, replaced with it
    assert rows(spark.sql("SELECT count(*), min(heart_failure) FROM cases")) == [(3, 1)]
    found = {r["check_name"]: r["value"] for r in plans.view_checks(spark).collect()}
    assert (found["total_admissions"], found["case_pct"], found["prescriptions"], found["unique_drugs"]) == (6, 50.0, 6, 2)


def test_report_job_prints_its_tables(spark, tmp_path, capsys):
    from cohortlens.__main__ import main

    main(["--tables", "/root/testdata/sf0.001", "--out", f"{tmp_path}/report", "--stand-in", "--top", "3"])
    printed = capsys.readouterr().out
    assert "Table 3. Clinical outcomes" in printed and "No secondary diabetes" in printed and "*Dose summaries" in printed
    assert thaw(spark, f"{tmp_path}/report/exposures").count() == 3

"""Readers, sinks and streams on small files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sensorloom.operators.cohort import GuardError
from sensorloom.sources import readers, sinks
from sensorloom.streaming import readings as streams


def test_csv_and_tsv(spark, tmp_path):
    (tmp_path / "r.csv").write_text("participant_id,start_datetime,glucose_value_mg_dL\n1,2024-01-01T00:05:00Z,120.5\n1,bad,x\n")
    got = readers.readings_csv(spark, str(tmp_path / "r.csv")).orderBy("rid").collect()
    assert [(r.pid, r.g) for r in got] == [(1, 120.5), (1, None)] and got[1].ts is None
    (tmp_path / "p.tsv").write_text("person_id\tclinical_site\n7\tUAB\n")
    assert tuple(readers.delimited(spark, str(tmp_path / "p.tsv"), "person_id int, clinical_site string", sep="\t").head()) == (7, "UAB")
    (tmp_path / "h.csv").write_text(" a , b\n1,2\n")
    assert readers.trimmed_header(spark, str(tmp_path / "h.csv")).columns == ["a", "b"]


# Field names of the device documents.
def test_documents(spark, tmp_path):
    item = lambda v: {"effective_time_frame": {"time_interval": {"start_date_time": "2024-01-01T00:00:00Z"}}, "blood_glucose": {"unit": "mg/dL", "value": v}}
    (tmp_path / "12_DEX.json").write_text(json.dumps({"header": {"timezone": "PST"}, "body": {"cgm": [item(101), item("low"), item("??")]}}))
    (tmp_path / "13_DEX.json").write_text("{broken")
    (tmp_path / "14_DEX.json").write_text(json.dumps({"body": {"cgm": []}}))
    got = readers.cgm_documents(spark, str(tmp_path)).collect()
    assert sorted((r.pid, r.timezone, r.g) for r in got if r.g is not None) == [(12, "pst", 39.0), (12, "pst", 101.0)] and len(got) == 3


def test_subject_files(spark, tmp_path):
    for sid, n in ((1, 3), (2, 1)):
        rows = "".join(f"2024-01-01 00:0{k}:00,{100 + k if k < n else ''},{200 + k}\n" for k in range(4))
        (tmp_path / f"S-00{sid}.csv").write_text("Timestamp,A GL,B GL\n" + rows)
    got = readers.subject_files(spark, str(tmp_path), "A GL", "B GL", least=2).groupBy("pid").agg(F.count("*").alias("n"), F.min("g").alias("g")).collect()
    assert {(r.pid, r.n, r.g) for r in got} == {(1, 3, 100.0), (2, 4, 200.0)}


def test_subject_files_with_other_columns(spark, tmp_path):
    (tmp_path / "S-1.csv").write_text("Timestamp,A GL,B GL\n2024-01-01 00:00:00,1,2\n")
    (tmp_path / "S-2.csv").write_text("B GL,Timestamp,Note,A GL\n20,2024-01-01 00:00:00,x,10\n")
    (tmp_path / "S-3.csv").write_text("Timestamp,B GL\n2024-01-01 00:00:00,200\n")
    got = readers.subject_files(spark, str(tmp_path), "A GL", "B GL", least=0).collect()
    assert sorted((r.pid, r.g) for r in got) == [(1, 1.0), (2, 10.0), (3, 200.0)]


def test_a_key_opens_its_file_alone(spark, tmp_path):
    """Another subject's file can't even be parsed: nothing fails as long as it isn't opened."""
    import pytest

    from sensorloom.sources.subjects import subject_rows

    (tmp_path / "S-1.csv").write_text("Timestamp,A GL,B GL\n2024-01-01 00:00:00,1,2\n")
    (tmp_path / "S-2.csv").write_text("Timestamp,A GL,B GL\n2024-01-01 00:00:00,1,2,3,4,5\n")
    (tmp_path / "S-3.csv").write_text("")
    path = str(tmp_path)
    assert [(r.pid, r.g) for r in readers.subject_files(spark, path, "A GL", "B GL", least=0, keys=[1, 3]).collect()] == [(1, 1.0)]
    with pytest.raises(Exception, match="columns"):
        readers.subject_files(spark, path, "A GL", "B GL", least=0).collect()
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = subject_rows(spark, path, ["A GL", "none"])
        assert [tuple(r) for r in rows.where("pid = 1").collect()] == [(1, "1", None)]
        assert [tuple(r) for r in rows.where("pid in (1, 3) and `A GL` = '1'").collect()] == [(1, "1", None)]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_keys_are_pushed_to_the_scan(spark, tmp_path):
    (tmp_path / "r.csv").write_text("participant_id,start_datetime,glucose_value_mg_dL\n1,2024-01-01T00:00:00Z,100\n2,2024-01-01T00:00:00Z,90\n")
    d = readers.readings_csv(spark, str(tmp_path), keys=[2, 9])
    plan = d._jdf.queryExecution().toString()
    assert "PushedFilters: [In(participant_id, [2,9])]" in plan and [r.g for r in d.collect()] == [90.0]


def test_computed_once(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    for _ in range(2):
        assert sinks.computed_once(spark, str(tmp_path / "once"), make).count() == 3
    assert made == [1]


def test_a_job_that_died_counts_as_none(spark, tmp_path):
    path = tmp_path / "half"
    spark.range(7).write.parquet(str(path))
    (path / "_SUCCESS").unlink()
    assert sinks.computed_once(spark, str(path), lambda: spark.range(3)).count() == 3
    (tmp_path / "empty").mkdir()
    assert all(sinks.replicates_left(spark, str(tmp_path / name), [0, 1]) == [0, 1] for name in ("none", "empty"))


def test_written_tables_can_go(spark):
    from sensorloom.session import discard, written

    d = written(spark.range(5), "some")
    files = d.inputFiles()
    assert d.count() == 5 and files
    discard(d)
    import os

    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(k, float(k), float(2 * k)) for k in range(5)], "k long, a double, b double")
    assert sinks.publish_checked(d, str(tmp_path / "ok"), "a", "b") > 0.999 and spark.read.parquet(str(tmp_path / "ok")).count() == 5
    with pytest.raises(GuardError):
        sinks.publish_checked(d.withColumn("b", F.col("k") % 2), str(tmp_path / "no"), "a", "b")
    assert not (tmp_path / "no").exists()
    path = str(tmp_path / "reps")
    assert sinks.replicates_left(spark, path, range(3)) == [0, 1, 2]
    for _ in range(2):
        sinks.append_replicate(d, path, 1)
    assert sinks.replicates_left(spark, path, range(3)) == [0, 2] and spark.read.parquet(path).count() == 5
    sinks.save_metadata(spark, str(tmp_path / "m"), features=["a", "b"], k=3)
    assert sinks.load_metadata(spark, str(tmp_path / "m")) == {"features": ["a", "b"], "k": 3}


def test_streams(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(1, at(5 * k), k, g) for k, g in enumerate([100.0, 60.0, 61.0, 62.0, 100.0, 140.0])]
    spark.createDataFrame(rows, "pid long, ts timestamp, rid long, g double").coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(make, name, mode="append"):
        s = spark.readStream.schema("pid long, ts timestamp, rid long, g double").parquet(str(tmp_path / "in"))
        q = make(s).writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    assert len(run(lambda s: streams.grid(s), "grid", "complete")) == 6
    assert [(r.n, r.nadir) for r in run(lambda s: streams.low_sessions(s), "lows", "complete")] == [(3, 60.0)]
    assert [r.delta for r in run(streams.step_flags, "flags")] == [-40.0, 38.0, 40.0]
    assert len(run(streams.deduplicated, "once")) == 6


def test_small_files_share_tasks(monkeypatch):
    from sensorloom.sources import subjects

    files = [(k, f"/f{k:06}", 10) for k in range(200_000)]
    parts = list(subjects.bundles(files))
    assert len(parts) == 200 and [f for p in parts for f in p.files] == [f[:2] for f in files]
    assert len(list(subjects.bundles(files[:64]))) == 64 and list(subjects.bundles([])) == []
    assert [len(p.files) for p in subjects.bundles([(k, "", subjects.BYTES // 2) for k in range(640)])] == [2] * 320

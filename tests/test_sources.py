"""Files: layouts, empties, ledgers, IDS lines, logs, sinks."""

import json

import pytest
from pyspark.sql import functions as F

from flowlake.operators import ids
from flowlake.sources import files, logs, sinks
from flowlake.sources.flows import read_flows
from flowlake.sources.ids import bad_lines, read_ids_events
from flowlake.streaming.flows import ingest_flows, land_new_files


def test_layouts_are_united_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("src_ip,timestamp,x\n10.0.0.1,1.5,1\n10.0.0.2,2.5,abc\n")
    (tmp_path / "b.csv").write_text("y,x,src_ip,timestamp\n7,8,10.0.0.3,3.5\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("src_ip,timestamp,z\n")
    rows = sorted(tuple(r) for r in read_flows(spark, str(tmp_path)).select(
        "src_ip", "timestamp", "x", "y", "z").collect())
    assert rows == [("10.0.0.1", 1.5, 1.0, None, None), ("10.0.0.2", 2.5, None, None, None),
                    ("10.0.0.3", 3.5, 8.0, 7.0, None)]


def test_merged_file_is_read_alone(spark, tmp_path):
    (tmp_path / "a.csv").write_text("src_ip,x\n10.0.0.1,1\n")
    (tmp_path / "merged_flows.csv").write_text("src_ip,x\n10.0.0.9,2\n")
    assert [tuple(r) for r in read_flows(spark, str(tmp_path)).collect()] == [("10.0.0.9", 2.0)]
    (tmp_path / "merged_flows.csv").write_text("")
    assert [tuple(r) for r in read_flows(spark, str(tmp_path)).collect()] == [("10.0.0.1", 1.0)]


def test_nothing_to_read_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    with pytest.raises(FileNotFoundError):
        read_flows(spark, str(tmp_path))
    (tmp_path / "a.csv").write_text("src_ip,x\n")
    with pytest.raises(ValueError):
        read_flows(spark, str(tmp_path))


def test_ledger_and_sizes(spark, tmp_path):
    for name, kb in (("a.pcap", 101), ("b.pcap", 100), ("c.pcap", 99), ("ba.pcap", 200)):
        (tmp_path / name).write_bytes(b"x" * kb * 1024)
    found = files.list_files(spark, str(tmp_path), "*.pcap")
    ledger = found.filter("file_name = 'ba.pcap'")
    names = {r["file_name"] for r in files.new_files(found, ledger).collect()}
    assert names == {"a.pcap", "b.pcap"}
    assert {r["file_name"] for r in files.files_over(found).collect()} == {"a.pcap", "ba.pcap"}


def test_ids_events(spark, tmp_path):
    def line(kind, **more):
        return json.dumps({"event_type": kind, "timestamp": "2026-05-18T10:00:00.123456+0000", **more})

    (tmp_path / "eve.json").write_text("\n".join([
        line("alert", src_ip="10.0.0.1", dest_port=22, alert={"signature": "S"}),
        line("flow"), line("dns"), '{"event_type":"al', ""]) + "\n")
    events = read_ids_events(spark, str(tmp_path))
    counts = {r["event_type"]: r["events"] for r in ids.ids_event_counts(events).collect()}
    assert counts == {"alert": 1, "flow": 1, "dns": 1, "http": 0, "malformed": 1}
    view = ids.first_alerts(events).first()
    assert (view["at"], view["src"], view["dst"], view["port"], view["signature"], view["category"]) == (
        "2026-05-18T10:00:00", "10.0.0.1", "?", "22", "S", "?")
    assert bad_lines(events).first()[0] == '{"event_type":"al'
    assert ids.alert_volume(events).first()["alerts"] == 1


def test_runs_are_kept(spark, tmp_path):
    path = str(tmp_path / "runs")
    sinks.append_run(spark.range(3), path, "20240101_000000")
    sinks.append_run(spark.range(5), path, "20240102_000000")
    assert sinks.latest_run(spark, path).count() == 5
    assert spark.read.parquet(path).count() == 8


def test_datasets_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, 0), (2, 1)], "x INT, label INT")
    sinks.write_dataset(df, str(tmp_path / "d"))
    assert (tmp_path / "d" / "label=1").is_dir()
    sinks.write_dataset(df, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["x", "label"]
    lines = spark.createDataFrame([(2, "b"), (1, "a")], "ord INT, line STRING")
    sinks.write_report(lines, str(tmp_path / "r"))
    parts = list((tmp_path / "r").glob("part-*"))
    assert len(parts) == 1 and parts[0].read_text() == "a\nb\n"


def test_credential_hits(spark, tmp_path):
    (tmp_path / "ssh.txt").write_text("try 1\n[22] host: h login: root\n")
    (tmp_path / "web.txt").write_text("nothing\n")
    hit = logs.credential_hits(spark, str(tmp_path)).collect()
    assert len(hit) == 1 and hit[0]["file"].endswith("ssh.txt") and "root" in hit[0]["line"]


def test_files_are_ingested_once(spark, tmp_path):
    src, out, mark = (tmp_path / n for n in ("in", "out", "mark"))
    src.mkdir()
    columns = ["src_ip", "timestamp"]
    (src / "a.csv").write_text("src_ip,timestamp\n10.0.0.1,1.5\n")
    for _ in range(2):
        ingest_flows(spark, str(src), columns, str(out), str(mark))
    assert spark.read.parquet(str(out)).count() == 1
    (src / "b.csv").write_text("src_ip,timestamp\n10.0.0.2,2.5\n")
    ingest_flows(spark, str(src), columns, str(out), str(mark))
    assert spark.read.parquet(str(out)).agg(F.sum("timestamp")).first()[0] == 4.0


def test_files_land_once(spark, tmp_path):
    src, out, mark = (tmp_path / n for n in ("in", "out", "mark"))
    src.mkdir()
    (src / "a.pcap").write_bytes(b"abc")
    for _ in range(2):
        land_new_files(spark, str(src), str(out), str(mark), "*.pcap")
    rows = spark.read.parquet(str(out)).collect()
    assert len(rows) == 1 and bytes(rows[0]["content"]) == b"abc"

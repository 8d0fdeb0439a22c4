import json

from lodestar.sources import io
from lodestar.streaming import events


def test_json_lines_with_bad_ones(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text(json.dumps({"chunk_id": "a", "doc_id": "d", "content": "x", "year": 2020}) + "\nnot json\n")
    got = io.read_chunks(spark, str(p)).collect()
    assert [(r.chunk_id, r.year) for r in got] == [("a", 2020)]


def test_discover_and_pairs(spark, tmp_path):
    (tmp_path / "My Acts").mkdir()
    (tmp_path / "My Acts" / "Some-Act one.pdf").write_bytes(b"%PDF")
    got = io.discover(spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.file_size) for r in got] == [("my_acts_some_act_one", 4)]
    c = tmp_path / "p.csv"
    c.write_text("go_number,supersedes\n54,42\n7,\n54,41\n")
    assert [(r.go_number, r.supersedes) for r in io.read_pairs(spark, str(c)).collect()] == [("54", ["41", "42"])]


def test_write_upsert_resume(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x", [1.0]), ("a", 2, "x", [2.0]), ("b", 1, "y", []), ("c", 1, "y", [3.0])], "chunk_id string, v int, collection string, embedding array<double>")
    got = io.upsert(spark, df, str(tmp_path / "t"), "chunk_id", "v").orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.v) for r in got] == [("a", 2), ("c", 1)]
    assert io.unprocessed(df, spark.createDataFrame([("a",)], "chunk_id string"), "chunk_id").count() == 2
    io.write_chunks(df.drop("embedding"), str(tmp_path / "j"), by="collection")
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    io.write_csv(df.drop("embedding"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 4


def test_stream_matches_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 5}:10:00", "view" if i % 2 else "buy", float(i)) for i in range(40)]
    spark.createDataFrame(rows, "event_id long, t string, event_type string, value double").selectExpr("event_id", "cast(t as timestamp) as ts", "event_type", "value").write.parquet(str(tmp_path / "in"))
    q = events.usage(events.read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("usage_mem").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    stream = sorted(map(tuple, spark.table("usage_mem").collect()))
    batch = sorted(map(tuple, events.usage(spark.read.parquet(str(tmp_path / "in"))).collect()))
    assert stream == batch and stream

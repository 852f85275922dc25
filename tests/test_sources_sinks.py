"""Files in and out, and streams against batches."""

import json
import math
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from benchloom.operators import aggregate as G
from benchloom.operators import dataops as D
from benchloom.operators import documents as O
from benchloom.operators import qa as Q
from benchloom.operators import scoring as S
from benchloom.session import table
from benchloom.sources import media, readers, sinks
from benchloom.streaming import incremental

SAMPLE = {"task_id": "vsec_001", "domain": "visual_security", "viewpoint_motion_target": 45.0, "prompt": "p" * 60, "industrial_logic_questions": [{"id": "q1", "text": "t", "answer": "yes"}]}


def test_samples_wrapped_and_bare(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"samples": [SAMPLE, SAMPLE | {"viewpoint_motion_target": "orbit_cw_90deg"}]}))
    (tmp_path / "b.json").write_text(json.dumps([SAMPLE | {"task_id": "x_001"}]))
    a, b = readers.samples(spark, str(tmp_path / "a.json")), readers.samples(spark, str(tmp_path / "b.json"))
    assert [r[0] for r in a.orderBy("seq").select(readers.target_degrees(a["viewpoint_motion_target"])).collect()] == [45.0, 90.0]
    assert b.count() == 1 and readers.keyed(a).count() == 1


def test_results_folder(spark, tmp_path):
    m = tmp_path / "m1"
    m.mkdir()
    (m / "t1.json").write_text(json.dumps({"vfa": 3.0, "scored": {"weighted_score": 80.0, "axis_scores": {"gi": 70.0}}}))
    (m / "t2.json").write_text('{"task_id": "T2", "weighted_score": 5.0}')
    (m / "bad.json").write_text('{"task_id": ')
    (m / "per_sample.json").write_text("[1]")
    got = {r["task_id"]: r for r in readers.results(spark, str(tmp_path)).collect()}
    assert set(got) == {"t1", "T2"} and got["t1"]["viewpoint_motion"] == 3.0 and got["T2"]["weighted_score"] == 5.0 and got["t1"]["model"] == "m1"


def test_aggregates_answers_manifest(spark, tmp_path):
    (tmp_path / "m1").mkdir()
    (tmp_path / "m1" / "aggregate.json").write_text("{}")
    (tmp_path / "answers.json").write_text('{"a:q1": "yes", "a:q:2": "no"}')
    (tmp_path / "m.csv").write_text("hash,path\n1,x\n")
    r = readers.aggregates(spark, str(tmp_path)).first()
    assert (r["model"], r["overall"], r["viewpoint_motion_tier"]) == ("m1", 0.0, "unknown")
    assert {tuple(x) for x in readers.answers(spark, str(tmp_path / "answers.json")).collect()} == {("a", "q1", "yes"), ("a", "q:2", "no")}
    assert readers.manifest(spark, str(tmp_path / "m.csv")).first()["hash"] == "1"


def test_images(spark, tmp_path):
    (tmp_path / "crane_site").mkdir()
    (tmp_path / "crane_site" / "big_boom.JPG").write_bytes(b"1")
    (tmp_path / "crane_site" / "x.txt").write_bytes(b"1")
    r = readers.images(spark, str(tmp_path)).collect()
    assert len(r) == 1 and {"crane", "site", "big", "boom"} <= set(r[0]["words"])


def test_clean_json(spark, tmp_path):
    df = spark.createDataFrame([(math.nan, [math.inf, 1.0], {"a": math.nan}, (math.nan, "x"))], "s double, a array<double>, m map<string,double>, t struct<v:double,n:string>")
    r = sinks.clean(df).first()
    assert r["s"] is None and r["a"] == [None, 1.0] and r["m"] == {"a": None} and r["t"]["v"] is None
    sinks.json_lines(df, str(tmp_path / "o"))
    assert json.loads(spark.read.text(str(tmp_path / "o")).first()[0])["s"] is None


def test_prompts_and_tables(spark, tmp_path):
    df = spark.createDataFrame([("b", None), ("a", "ü")], "task_id string, prompt string")
    sinks.prompts(df, str(tmp_path / "p"))
    lines = [json.loads(x[0]) for x in spark.read.text(str(tmp_path / "p")).collect()]
    assert [x["task_id"] for x in lines] == ["a", "b"] and lines[1]["prompt"] is None
    assert sinks.markdown_table(df).count("\n") == 4 and sinks.exit_status(df) == 1 and sinks.exit_status(df.limit(0)) == 0


def test_streams_equal_batches(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    (tmp_path / "in").mkdir()
    table(spark, d, "sample_results").write.mode("overwrite").parquet(str(tmp_path / "in"))
    batch = incremental.running_metrics(spark.read.parquet(str(tmp_path / "in")))
    stream = incremental.running_metrics(spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in")))
    rounded = lambda rows: {(r["model_id"], r["n"], round(r["gated_score"], 6)) for r in rows}
    place, checkpoint = str(tmp_path / "table"), str(tmp_path / "c")
    incremental.start(stream, place, checkpoint).awaitTermination()
    assert rounded(incremental.current(spark, place, "model_id").collect()) == rounded(batch.collect())
    # More input: only what changes is added, and the state is that of all input.
    table(spark, d, "sample_results").limit(30).write.mode("append").parquet(str(tmp_path / "in"))
    incremental.start(stream, place, checkpoint).awaitTermination()
    now = incremental.running_metrics(spark.read.parquet(str(tmp_path / "in")))
    assert rounded(incremental.current(spark, place, "model_id").collect()) == rounded(now.collect())
    assert spark.read.parquet(place).where("batch = 1").count() < spark.read.parquet(place).where("batch = 0").count() + 30


def test_sessions_and_windows_of_a_stream(spark, tmp_path):
    from datetime import datetime, timedelta

    t = datetime(2026, 1, 1)
    rows = [(u, t + timedelta(minutes=m), "a", 1.0) for u, ms in ((1, (0, 10, 45, 200)), (2, (5,))) for m in ms]
    spark.createDataFrame(rows, "user_id bigint, ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id bigint, ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    incremental.start(incremental.sessions(stream), str(tmp_path / "s"), str(tmp_path / "cs"), "complete").awaitTermination()
    assert sorted(r["n"] for r in incremental.current(spark, str(tmp_path / "s")).where("user_id = 1").collect()) == [1, 1, 2]
    incremental.start(incremental.windowed_events(stream), str(tmp_path / "w"), str(tmp_path / "cw")).awaitTermination()
    assert sorted(r["n"] for r in incremental.current(spark, str(tmp_path / "w"), "window_start", "event_type").collect()) == [1, 4]


def test_documents_are_written_whole(spark, tmp_path):
    docs = spark.createDataFrame([("m/1", '{"a":1}'), ("m2", '{"a":null}')], "model_name string, document string")
    sinks.documents(docs, str(tmp_path / "d"), "model_name")
    back = {r["model_name"]: json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "d")).collect()}
    assert back == {"m/1": {"a": 1}, "m2": {"a": None}}
    rows = spark.createDataFrame([("b", 1, "two"), ("a", 0, "zero"), ("b", 0, "one\nmore")], "key string, line_no int, line string")
    sinks.lines(rows, str(tmp_path / "l"), "key", "line_no")
    assert "\n".join(r[0] for r in spark.read.text(str(tmp_path / "l")).collect()) == "zero\none\nmore\ntwo"


def test_calibration_text(spark):
    rows = spark.createDataFrame([("easy", 85.0, 90.25, 4, True), ("hard", 45.0, 0.0, 0, False)], "bucket string, target double, mean double, n bigint, above_target boolean")
    got = O.calibration_document(rows, "m").first()
    doc = json.loads(got["document"])
    assert doc["buckets"]["easy"] == {"bucket": "easy", "mean_score": 90.25, "target": 85.0, "n_samples": 4, "above_target": True} and len(doc["flags"]) == 1
    assert got["console"].splitlines()[5:7] == ["hard               0.00       45     0         OK", "easy              90.25       85     4       FAIL"]


def test_a_report_of_nothing(spark):
    d = "/root/testdata/sf0.001"
    empty = S.scored(table(spark, d, "sample_results").limit(0))
    doc = json.loads(O.report_document(empty, table(spark, d, "samples"), "m").first()["document"])
    assert doc["model"] == "m" and doc["summary"]["num_samples_total"] == 0 and doc["axis_statistics"] == {} and doc["worst_samples"] == []
    assert json.loads(O.leaderboard_document(G.leaderboard(G.model_metrics(empty, table(spark, d, "models").limit(0)))).first()["document"]) == {"models": [], "num_models": 0}


def test_old_names_of_fields(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"task_id": "a", "ika_questions": [{"id": "q", "text": "x"}]}, {"task_id": "b", "questions": [{"id": "r"}], "vfa_target": 30.0}]))
    got = {r["task_id"]: r for r in readers.samples(spark, str(tmp_path / "s.json")).collect()}
    assert got["a"]["industrial_logic_questions"][0]["id"] == "q" and got["b"]["industrial_logic_questions"][0]["id"] == "r"
    assert len({r["seq"] for r in got.values()}) == 2
    (tmp_path / "m").mkdir()
    for name, body in {"1": {"scored": {"viewpoint_motion_score": 40.0}, "vfa_score": 90.0}, "2": {"vfa_score": 50.0}, "3": {"scored": {"axis_scores": {"vfa": 60.0}}}, "4": {}}.items():
        (tmp_path / "m" / f"{name}.json").write_text(json.dumps({"task_id": name} | body))
    assert {r["task_id"]: r["gate_score"] for r in readers.results(spark, str(tmp_path / "m")).collect()} == {"1": 40.0, "2": 50.0, "3": 60.0, "4": None}


def test_images_that_can_be_read(spark, tmp_path):
    def png(pixels):
        h, w, c = pixels.shape
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        raw = b"".join(bytes([0]) + pixels[y].tobytes() for y in range(h))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8), rng.integers(0, 256, (4, 6, 1), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(png(a))
    (tmp_path / "b.png").write_bytes(png(b))
    (tmp_path / "c.png").write_bytes(png(a)[:60])
    (tmp_path / "d.ppm").write_bytes(b"P6\n# note\n7 5\n255\n" + a.tobytes())
    (tmp_path / "e.jpg").write_bytes(b"\xff\xd8 no decoder")
    got = {r["path"].rsplit("/", 1)[1]: r for r in media.images(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.png", "b.png", "d.ppm"}
    assert np.array_equal(np.frombuffer(got["a.png"]["pixels"], np.uint8).reshape(5, 7, 3)[..., ::-1], a) and got["b.png"]["channels"] == 1
    assert bytes(got["d.ppm"]["pixels"]) == bytes(got["a.png"]["pixels"])
    wanted = spark.createDataFrame([(1, ["c.png", "e.jpg", "a.png", "b.png"]), (2, ["e.jpg"])], "row_id bigint, candidates array<string>")
    names = media.images(spark, str(tmp_path)).withColumn("path", F.element_at(F.split("path", "/"), -1))
    assert {r["row_id"]: r["path"] for r in media.first_readable(wanted, names).collect()} == {1: "a.png", 2: None}


def test_raw_video(spark, tmp_path):
    y = np.arange(24, dtype=np.uint8).reshape(4, 6) * 10
    frame = b"FRAME\n" + y.tobytes() + bytes([128] * 12)
    (tmp_path / "t1.y4m").write_bytes(b"YUV4MPEG2 W6 H4 F25:1 Ip C420jpeg\n" + frame * 3)
    (tmp_path / "cut.y4m").write_bytes(b"YUV4MPEG2 W6 H4 F25:1 C420jpeg\n" + frame * 2 + frame[:20])
    (tmp_path / "none.y4m").write_bytes(b"")
    got = media.video_frames(spark, str(tmp_path)).orderBy("name", "frame").collect()
    assert [(r["name"], r["frame"]) for r in got] == [("cut", 0), ("cut", 1), ("t1", 0), ("t1", 1), ("t1", 2)]
    grey = np.frombuffer(got[0]["pixels"], np.uint8).reshape(4, 6, 3)
    assert np.abs(grey.astype(int) - y[..., None]).max() <= 1


def test_questions_and_lines(spark):
    s = spark.createDataFrame([(1, "t", [("q1", "Any drift?", "no", ""), ("q2", "x", "yes", "W3"), ("q3", "x", "yes", "W3")])], "row_id bigint, task_id string, industrial_logic_questions array<struct<id:string,text:string,answer:string,weakness_target:string>>")
    asked = Q.questions(s)
    lines = Q.answers_of_lines(asked, spark.createDataFrame([(1, '1. {"answer": "yes", "chain_of_thought": "no drift at all"}\n2. yes')], "row_id bigint, raw_response string"))
    out = Q.evaluate(asked, lines)
    assert {(r["qid"], r["outcome"]) for r in out.collect()} == {("q1", "superlative"), ("q2", "correct"), ("q3", "wrong")}
    assert {r["tag"]: r["accuracy"] for r in Q.weakness_accuracy(out).collect()} == {"untagged": 1.0, "W3": 0.5}
    assert Q.superlative_log(out).count() == 1


def test_keep_first_and_candidates(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "doc_id bigint, text string")
    assert {(r["doc_id"], r["action"]) for r in D.keep_first(docs, "text", "doc_id").collect()} == {(1, "keep"), (2, "delete")}
    q = spark.createDataFrame([(1, ["boom", "crane"], 11)], "query bigint, words array<string>, current bigint")
    i = spark.createDataFrame([(10, ["boom", "crane"]), (11, ["x"]), (12, ["y"])], "item bigint, words array<string>")
    assert [(r["item"], r["score"]) for r in D.candidates(q, i).orderBy("position").collect()] == [(11, 3), (10, 2)]

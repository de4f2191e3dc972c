"""Stateful streams give what the batch forms give."""

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from sparksieve.streaming import state


def run(spark, tmp_path, df, build, name):
    """Feed the rows of df, one file per group of ``b``, through a stream."""
    src = str(tmp_path / name)
    for b in sorted(r[0] for r in df.select("b").distinct().collect()):
        df.where(F.col("b") == b).drop("b").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.drop("b").schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / (name + "-ck"))).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_restore_chunks():
    pairs = [("__EMAIL_1__", "a@b.c"), ("__EMAIL_10__", "x@y.z")]
    text = "to __EMAIL_1__ and __EMAIL_10__, not __EMAIL_"
    for cut in range(len(text)):
        out, tail = state.restore_chunk("", text[:cut], pairs, False)
        rest, _ = state.restore_chunk(tail, text[cut:], pairs, True)
        assert out + rest == "to a@b.c and x@y.z, not __EMAIL_"


def test_restore_stream(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, "s", 0, "mail __EM", False), (1, 1, "s", 1, "AIL_1__ now", True)], "b int, response_id long, session_id string, chunk_no long, data string, last boolean")
    got = run(spark, tmp_path, df, lambda s: state.restore_stream(s, {"s": [("__EMAIL_1__", "a@b.c")]}), "restored")
    assert "".join(r["text"] for r in sorted(got, key=lambda r: r["chunk_no"])) == "mail a@b.c now"


def test_placeholders_and_consent(spark, tmp_path):
    df = spark.createDataFrame([(0, "s", 1, "email-address", "i1"), (0, "s", 2, "email-address", "i2"), (1, "s", 3, "email-address", "i1")], "b int, session_id string, seq long, rule_id string, identity string")
    got = run(spark, tmp_path, df, state.placeholder_stream, "names")
    assert [r["placeholder"] for r in sorted(got, key=lambda r: r["seq"])] == ["__EMAIL_1__", "__EMAIL_2__", "__EMAIL_1__"]
    rows = [(0, "s", 1, "x", ["i"], 1, 0, True), (0, "s", 2, "mask", [], 0, 0, True), (1, "s", 3, "x", ["i"], 1, 0, True), (1, "s", 4, "y", [], 0, 0, True)]
    df = spark.createDataFrame(rows, "b int, session_id string, turn long, text string, ids array<string>, n_hits int, bare int, redactable boolean")
    got = run(spark, tmp_path, df, state.consent_stream, "consent")
    assert [r["decision"] for r in sorted(got, key=lambda r: r["turn"])] == ["BLOCKED", "ACK", "MASKED", "FORWARD"]


def test_scene_stream(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, "request", 2), (0, 2, "request", 0), (1, 1, "redacted", 0), (2, 1, "response", 0)], "b int, id long, kind string, n_alerts int")
    got = run(spark, tmp_path, df, state.scene_stream, "scenes")
    assert [(r["id"], r["outcome"], r["n_alerts"]) for r in got] == [(1, "response", 2)]
    assert isinstance(pd.DataFrame(got), pd.DataFrame)


def test_rate_limited(spark, tmp_path):
    at = lambda sec: datetime(2024, 1, 1) + timedelta(seconds=sec)
    rows = [(0, "a", at(0), "m0"), (0, "a", at(10), "m1"), (0, "b", at(5), "n0"), (0, "a", at(30), "m2"), (1, "a", at(45), "m3"), (1, "a", at(61), "m4"), (1, "b", at(34), "n1")]
    df = spark.createDataFrame(rows, "b int, source string, ts timestamp, message string")
    got = run(spark, tmp_path, df, lambda s: state.rate_limited(s, "source"), "limited")
    assert sorted(r["message"] for r in got) == ["m0", "m2", "m4", "n0"]

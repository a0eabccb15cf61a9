from __future__ import annotations

import json

from galley.streaming import audit_stream as S


def test_counts_do_not_depend_on_the_number_of_files(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.range(2000).select(
        F.col("id").alias("event_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("id") * 7919, F.lit(2000)) * 600).alias("ts"),
        F.lit("r").alias("run_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("stage"),
        F.when(F.col("id") % 7 == 0, "e").alias("error"),
    )
    found = []
    for files in (4, 150):
        base = tmp_path / str(files)
        rows.unionByName(rows).repartition(files).write.json(f"{base}/log")
        S.write_counts(S.stage_counts(S.read_log(spark, f"{base}/log")), f"{base}/out", f"{base}/cp").awaitTermination()
        found.append(sorted(map(tuple, spark.read.parquet(f"{base}/out").collect())))
    assert found[0] == found[1]
    # 2000 events in steps of ten minutes: 13 whole days are closed
    assert sum(r[3] for r in found[0]) == 13 * 144


def test_calls_meet_outputs_as_they_arrive(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    rows = [
        {"ts": "2024-01-01T00:00:00Z", "kind": "call", "call_id": "a", "tool_name": "x", "payload": "{}"},
        {"ts": "2024-01-01T00:00:05Z", "kind": "output", "call_id": "a", "payload": '{"ok":true}'},
        {"ts": "2024-01-01T00:10:00Z", "kind": "call", "call_id": "b", "tool_name": "y", "payload": "{}"},
        {"ts": "2024-01-01T05:00:00Z", "kind": "output", "call_id": "b", "payload": "late"},
        {"ts": "2024-01-02T00:00:00Z", "kind": "call", "call_id": "c", "tool_name": "z", "payload": "{}"},
        {"ts": "2024-01-02T00:00:00Z", "kind": "output", "call_id": "c", "payload": "{}"},
    ]
    (log / "1.json").write_text("\n".join(map(json.dumps, rows)))
    events = spark.readStream.schema(
        "ts timestamp, kind string, call_id string, tool_name string, payload string"
    ).json(str(log))
    query = (
        S.pair_tools(events).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {(r.call_id, r.tool_name, r.payload) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {("a", "x", '{"ok":true}'), ("c", "z", "{}")} <= got
    assert ("b", "y", "late") not in got


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path, monkeypatch):
    import pytest

    base = str(tmp_path)
    rows = spark.range(1000).selectExpr("id as event_id", "timestamp_seconds(id) as ts", "'r' || id % 9 as run_id", "'s' as stage", "cast(null as string) as error")
    rows.repartition(6).write.json(f"{base}/in")
    events = lambda: spark.readStream.schema(S.SCHEMA).option("maxFilesPerTrigger", 2).json(f"{base}/in")
    write, seen = S.write_batch, []

    def fails_once(batch, batch_id, *where):
        write(batch, batch_id, *where)
        seen.append(batch_id)
        if len(seen) == 2:
            raise RuntimeError("lost after writing")

    monkeypatch.setattr(S, "write_batch", fails_once)
    query = S.append_log(events(), f"{base}/log", f"{base}/cp")
    with pytest.raises(Exception, match="lost after writing"):
        query.awaitTermination()
    S.append_log(events(), f"{base}/log", f"{base}/cp").awaitTermination()
    assert seen == [0, 1, 1, 2]
    got = spark.read.schema(S.SCHEMA).json(f"{base}/log")
    assert got.count() == 1000 == got.select("event_id").distinct().count()
    # a second writer of the same log, and nothing new for the first
    S.append_log(events(), f"{base}/log", f"{base}/cp2", "other").awaitTermination()
    S.append_log(events(), f"{base}/log", f"{base}/cp").awaitTermination()
    assert spark.read.schema(S.SCHEMA).json(f"{base}/log").count() == 2000


def test_latest_payloads_do_not_depend_on_files_or_restarts(spark, tmp_path):
    from pyspark.sql import functions as F

    from galley.operators import audit as A

    whole = F.concat(F.lit('{"body":"t'), F.col("id").cast("string"), F.lit('"}'))
    rows = spark.range(1200).select(
        F.concat(F.lit("r"), F.col("id") % 7).alias("run_id"), F.when(F.col("id") % 2 == 0, "content").otherwise("other").alias("stage"),
        F.col("id").alias("seq"), F.when(F.col("id") % 5 == 0, whole).when(F.col("id") % 5 == 1, F.lit("oops")).otherwise('{"body":7}').alias("payload"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 600).alias("ts"),
    )
    want = sorted(map(tuple, A.latest_stage(rows).select("run_id", "stage", "payload", "complete").collect()))
    schema = "run_id string, stage string, seq bigint, payload string, ts timestamp"
    for files, runs in ((1, 1), (4, 2), (20, 3)):
        base = f"{tmp_path}/{files}"
        for k in range(runs):
            part = rows.where((F.col("seq") >= 1200 * k // runs) & (F.col("seq") < 1200 * (k + 1) // runs))
            part.repartition(files).write.mode("append").json(f"{base}/in")
            stream = spark.readStream.schema(schema).json(f"{base}/in")
            S.keep_latest(S.latest_partials(stream), f"{base}/out", f"{base}/cp").awaitTermination()
        got = sorted(map(tuple, S.read_latest(spark, f"{base}/out").select("run_id", "stage", "payload", "complete").collect()))
        assert got == want


def test_outputs_without_a_call_in_time_have_rows(spark, tmp_path):
    rows = [
        ("2024-01-01 00:00:00", "call", "a"), ("2024-01-01 00:00:05", "output", "a"), ("2024-01-01 00:00:06", "output", "a"),
        ("2024-01-01 00:10:00", "call", "b"), ("2024-01-01 05:00:00", "output", "b"), ("2024-01-01 06:00:00", "output", "x"),
        ("2024-01-09 00:00:00", "call", "end"), ("2024-01-09 00:00:00", "output", "end"),
    ]
    events = spark.createDataFrame(rows, "ts string, kind string, call_id string").selectExpr(
        "cast(ts as timestamp) as ts", "kind", "call_id", "'t' as tool_name", "'p' as payload"
    )
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    S.pair_tools(stream, "1 hour", "full").writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
        "checkpointLocation", f"{tmp_path}/cp"
    ).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.call_id or "", r.output_id or "") for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("", "b"), ("", "x"), ("a", "a"), ("a", "a"), ("b", ""), ("end", "end")]

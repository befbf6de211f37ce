"""Registered queries, sources, sinks, chunks and streams."""

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from tracklake.operators import possession
from tracklake.plans import chunks, table_queries  # noqa: F401
from tracklake.plans.queries import ORACLE_SQL, QUERIES
from tracklake.sources import exports, segments, tables
from tracklake.streaming import pipelines

SF = "/root/testdata/sf0.001"


def shown(v):
    return f"{v:.9g}" if isinstance(v, float) and v else "0" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLE_SQL:
        return
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("events", "labels", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(shown(r[names.index(c)]) for c in df.columns) for r in got.fetchall())
    assert sorted(tuple(shown(r[c]) for c in df.columns) for r in rows) == want


def test_queries_without_sql_take_all_rows(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT event_id, event_id // 22 AS frame_id, event_type FROM '{SF}/events.parquet'")
    assert QUERIES["replay_dup_suppression"](spark, SF).count() == con.execute("SELECT count(*) FROM events").fetchone()[0]
    exits = con.execute("SELECT count(*) FROM events WHERE event_type = 'signup' AND frame_id % 40 < 36").fetchone()[0]
    assert 0.9 * exits < QUERIES["substitution_pairs"](spark, SF).count() <= exits  # the weakest evidence gives no row


def test_substitutions_wait_two_minutes(spark, tmp_path):
    """An exit in frame 0 and the team's only entry 6 s later."""
    spark.createDataFrame([(3, "signup", 1.0), (150 * 22 + 4, "purchase", 1.0)], "event_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    rows = QUERIES["substitution_pairs"](spark, str(tmp_path)).collect()
    assert [(r.player_off_track_id, r.player_on_track_id, r.timestamp_ms) for r in rows] == [(3, 4, 3000.0)]


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_sources(spark, tmp_path):
    d = spark.createDataFrame([(1, 2.0), (2, float("nan"))], "a long, b double")
    back = exports.export(d, f"{tmp_path}/x")
    assert back.count() == 2
    assert tables.read_required(spark, f"{tmp_path}/x", ["a"]).where("b is null").count() == 1
    with pytest.raises(ValueError):
        tables.read_required(spark, f"{tmp_path}/x", ["zz"])
    assert tables.read_optional(spark, f"{tmp_path}/none", T.StructType.fromDDL("a long")).count() == 0
    assert exports.export(d, f"{tmp_path}/j", "json").where("b is null").count() == 1
    assert exports.export(d.where("a = 1"), f"{tmp_path}/c", "csv").first().b == 2.0
    with pytest.raises(ValueError):
        exports.assert_unique(spark.createDataFrame([(1,), (1,)], "a long"), ["a"])
    with pytest.raises(ValueError):
        tables.jersey_predictions(spark.createDataFrame([(1, "7"), (1, "8")], "track_id long, jersey_number string"))
    h = tables.with_header(spark.createDataFrame([(1, 1.7, True), (2, 0.5, False)], "frame_id long, confidence double, valid boolean"), "r", "m")
    assert [r.confidence for r in h.orderBy("frame_id").collect()] == [1.0, 0.0]
    assert tables.order_violations(spark.createDataFrame([(1, 1, 5), (1, 2, 4), (1, 3, None)], "k long, row long, f long"), ["k"], "f", "row").count() == 2


def test_segments(spark, tmp_path):
    p = tmp_path / "league" / "2016" / "game"
    p.mkdir(parents=True)
    (p / "1_asr.json").write_text('{"segments": {"0": [0.0, 2.5, "Hello"], "1": [3.0, 1.0, "back"], "2": [4]}}')
    s = segments.read_segments(spark, str(p))
    assert {(r.segment_id, r.valid) for r in s.collect()} == {("0", True), ("1", False), ("2", False)}
    assert s.select(*segments.match_of(F.col("path"))).first()["half"] == 1
    assert segments.in_range(s, 2.0, 3.0).count() == 1
    assert segments.srt_text(s.where("valid").withColumn("g", F.lit(1)), ["g"], "segment_id").first().srt == "1\n00:00:00,000 --> 00:00:02,500\nHello"


def test_chunks(spark):
    plan = chunks.plan_chunks(spark.createDataFrame([("a", 2000), ("b", 0)], "camera_id string, frames long"), 25.0, 30.0)
    assert [(r.frame_start, r.frame_end) for r in plan.orderBy("chunk_index").collect()] == [(0, 750), (750, 1500), (1500, 2000)]
    with pytest.raises(ValueError):
        chunks.plan_chunks(plan, 25.0, 10.0)
    c = spark.createDataFrame([("a", 0, "PENDING", 2, None), ("a", 1, "PASSED", 1, "old"), ("a", 2, "PENDING", 0, None)], "camera_id string, chunk_index int, status string, attempts int, fingerprint string")
    ok = spark.createDataFrame([("a", 0, False), ("a", 2, True)], "camera_id string, chunk_index int, ok boolean")
    out = {r.chunk_index: r.status for r in chunks.mark(chunks.invalidate(c, "new"), ok, "new").collect()}
    assert out == {0: "FAILED", 1: "PENDING", 2: "PASSED"}


def test_streams(spark, tmp_path):
    o = spark.range(60).select((F.col("id") % 2).alias("global_id"), F.timestamp_millis(F.col("id") * 100).alias("event_time"), F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"), F.lit(0.5).alias("detection_confidence"))
    o.write.parquet(f"{tmp_path}/o")
    stream = spark.readStream.schema(o.schema).parquet(f"{tmp_path}/o")
    q = pipelines.fused_timeline(stream, ["global_id"], "1 second").writeStream.format("memory").queryName("fused").option("checkpointLocation", f"{tmp_path}/c1").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("fused").agg(F.max("observation_count")).first()[0] == 5
    f = spark.createDataFrame([(1, k, k * 40.0, 10.0 if k < 5 else None, 10.0 if k < 5 else None, True) for k in range(8)], "match_id long, frame_id long, timestamp_ms double, ball_x double, ball_y double, in_play boolean")
    players = spark.createDataFrame([(1, k, 3, "team_0", 10.5, 10.0) for k in range(8)], "match_id long, frame_id long, track_id long, team_id string, x_field double, y_field double")
    c = possession.frame_candidates(f, players, ["match_id"])
    c.coalesce(1).write.parquet(f"{tmp_path}/p")
    s = spark.readStream.schema(c.schema).parquet(f"{tmp_path}/p")
    q = pipelines.possession_stream(s).writeStream.format("memory").queryName("owners").outputMode("append").option("checkpointLocation", f"{tmp_path}/c2").start()
    q.processAllAvailable()
    q.stop()
    want = possession.possession_timeline(c, ["match_id"]).select("frame_id", "possession_state", "owner_track_id")
    assert sorted(map(tuple, spark.table("owners").select("frame_id", "possession_state", "owner_track_id").collect())) == sorted(map(tuple, want.collect()))

"""Positions from a stream against the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgertide.operators import positions as batch
from ledgertide.streaming import tracker
from tests.test_ledger import STORED, random_fills, sequential


def test_stream_matches_batch(spark, tmp_path):
    rows = random_fills(7, 300)
    rows = [r for r in rows if r[1] is not None]
    source = str(tmp_path / "in")
    late = sorted(rows, key=lambda r: r[3] + (r[0] % 7) * 3_000_000)
    for i in range(0, len(late), 60):
        spark.createDataFrame(late[i : i + 60] + late[max(0, i - 5) : i], STORED).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(STORED).option("maxFilesPerTrigger", 1).parquet(source)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for _ in range(2):  # the second run continues from the checkpoint and adds nothing new
        query = tracker.positions(stream, "6 hours").writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    want = {k: v for k, v in sequential(rows).items() if v[0] != "none"}
    horizon = max(r[3] for r in rows) - 6 * 3_600_000
    got = {r.fill_key: (r.kind, r.net_size, r.opener) for r in spark.read.parquet(out).collect()} if spark.read.parquet(out).columns else {}
    assert len(got) > 50
    assert set(got) == {r[12] for r in rows if r[3] <= horizon and r[12] in want}
    for k, (kind, net, opener) in got.items():
        assert (kind, net, opener) == (want[k][0], want[k][2], want[k][4])
    assert batch.transitions(spark.createDataFrame(rows, STORED)).where(F.col("kind") != "none").count() == len(want)


def test_followed_stream_has_fills_behind_the_watermark(spark, tmp_path):
    rows = sorted((r for r in random_fills(12, 200) if r[1] is not None), key=lambda r: r[3])
    late = rows[10:20]  # more than the look-back behind the newest
    source = str(tmp_path / "in")
    rest = [r for r in rows if r not in late]
    for part in (rest[:90], rest[90:] + rest[:5], late + rest[-3:]):
        spark.createDataFrame(part, STORED).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(STORED).option("maxFilesPerTrigger", 1).parquet(source)
    out, folder = str(tmp_path / "out"), str(tmp_path / "kept")
    tracker.positions(stream, "2 hours").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c1")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert not {r[12] for r in late} & {r.fill_key for r in spark.read.parquet(out).collect()}
    tracker.follow(stream, folder, str(tmp_path / "c2"), buckets=4).awaitTermination()
    moves = batch.transitions(spark.createDataFrame(rows, STORED))
    for name, table in {"snapshots": batch.snapshots(moves), "effects": batch.effects(moves), "lifecycles": batch.lifecycles(moves)}.items():
        got = spark.read.parquet(f"{folder}/{name}").select(table.columns)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, table.collect()), key=repr)
    assert {r[12] for r in late} & {r.fill_key for r in spark.read.parquet(f"{folder}/snapshots").collect()}


def test_stored_stream_is_idempotent(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "fills")
    rows = random_fills(8, 50)
    df = spark.createDataFrame(rows, STORED)
    df.write.mode("append").parquet(source)
    df.limit(20).write.mode("append").parquet(source)
    stream = spark.readStream.schema(STORED).parquet(source)
    for check in ("c1", "c2"):  # a lost checkpoint replays everything
        tracker.store_fills(stream, path, str(tmp_path / check)).awaitTermination()
    assert spark.read.parquet(path).count() == len({r[12] for r in rows})

from datetime import datetime

import pytest
from conftest import values
from pyspark.sql import functions as F

from tallyline.plans import fetch
from tallyline.sources.feeds import stream_files
from tallyline.sources.store import Store
from tallyline.streaming.commits import commit_store, drop_repeats, earlier_keys, stream_ingest_commits, take_in

FEED = "repo_id long, sha1 string, seq long, commit_date timestamp_ntz"


def write(spark, path, rows):
    spark.createDataFrame(rows, FEED).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, tmp_path):
    feed = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(path)
    store = commit_store(spark, str(tmp_path / "store"), feed.schema)
    stream_ingest_commits(feed, store, str(tmp_path / "checkpoint")).awaitTermination()
    return store.read()


def test_stream_equals_batch_and_keeps_late_commits(spark, tmp_path):
    path = str(tmp_path / "feed")
    days = [datetime(2021, 1, n) for n in range(1, 6)]
    first = [(1, "a", 1, days[2]), (1, "a", 2, days[2]), (2, "a", 3, days[2])]
    second = [(1, "a", 4, days[2]), (1, "late", 5, days[0]), (1, "b", 6, days[3])]
    write(spark, path, first)
    write(spark, path, second)
    stored = run(spark, path, tmp_path)
    empty = spark.createDataFrame([], FEED)
    whole = fetch.new_commits(spark.createDataFrame(first + second, FEED), empty)
    assert values(stored.select("repo_id", "sha1")) == values(whole.select("repo_id", "sha1"))

    # A later run goes on from the checkpoint and meets repeats of both batches.
    write(spark, path, [(1, "b", 7, days[3]), (2, "a", 8, days[2]), (3, "c", 9, days[4])])
    again = run(spark, path, tmp_path)
    assert values(again.select("repo_id", "sha1")) == [(1, "a"), (1, "b"), (1, "late"), (2, "a"), (3, "c")]


def test_a_batch_that_runs_again_replaces_its_rows(spark, tmp_path):
    path = str(tmp_path / "feed")
    write(spark, path, [(1, "a", 1, datetime(2021, 1, 1))])
    run(spark, path, tmp_path)
    # The batch wrote its rows, but its commit mark was lost with the driver.
    for name in ("0", ".0.crc"):
        mark = tmp_path / "checkpoint" / "commits" / name
        if mark.exists():
            mark.unlink()
    assert values(run(spark, path, tmp_path).select("repo_id", "sha1")) == [(1, "a")]


def files_of(frame):
    return {row.f for row in frame.select(F.input_file_name().alias("f")).distinct().collect()}


def test_a_batch_opens_only_the_files_of_its_repositories(spark, tmp_path):
    store = commit_store(spark, str(tmp_path / "store"), spark.createDataFrame([], FEED).schema)
    day = datetime(2021, 1, 1)
    rows = spark.range(40_000).select((F.col("id") % 400).alias("repo_id"), F.sha1(F.col("id").cast("string")).alias("sha1"), F.col("id").alias("seq"), F.lit(day).cast("timestamp_ntz").alias("commit_date"))
    take_in(store, rows, 0)
    batch = rows.where("repo_id in (7, 8, 9)").unionByName(
        spark.range(9_700).select((F.col("id") % 3 + 7).alias("repo_id"), F.concat(F.lit("new"), "id").alias("sha1"), "id", F.lit(day).cast("timestamp_ntz")).toDF("repo_id", "sha1", "seq", "commit_date")
    )
    assert batch.count() == 10_000
    keys = earlier_keys(store, batch)
    everything, opened = set(store.read().inputFiles()), set(keys.inputFiles())
    home = files_of(store.read().where("repo_id in (7, 8, 9)"))
    assert len(opened) == len(home) <= 3 < 150 < len(everything)
    assert {f.rsplit("/", 2)[1] for f in opened} == {f.rsplit("/", 2)[1] for f in home}
    assert keys.count() == 300
    take_in(store, batch, 1)
    assert store.read().count() == 40_000 + 9_700
    take_in(store, batch, 1)  # the same batch again
    assert store.snapshot().number == 2


def test_small_files_are_compacted(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), spark.createDataFrame([], "id long").schema, by=["id"], buckets=2)
    for n in range(12):
        store.append(spark.createDataFrame([(n,)], "id long"))
    assert max(len(names) for names in store.snapshot().folders.values()) <= 8
    assert values(store.read()) == sorted(((n,) for n in range(12)), key=repr)


def test_a_change_keeps_untouched_files(spark, tmp_path):
    schema = "id long, name string"
    store = Store(spark, str(tmp_path / "s"), spark.createDataFrame([], schema).schema, by=["id"], buckets=8)
    assert store.read().count() == 0
    store.append(spark.createDataFrame([(n, "old") for n in range(64)], schema))
    before, files = store.snapshot(), set(store.read().inputFiles())
    change = spark.createDataFrame([(3, "new"), (100, "new")], schema)
    touched = store.touched(change)
    store.upsert(change, ["id"])
    kept = {f for f in files if int(f.rsplit("/", 2)[1].removeprefix("bucket=")) not in touched}
    assert kept and kept < set(store.read().inputFiles()) and not (files - kept) & set(store.read().inputFiles())
    assert values(store.read()) == sorted([(n, "new" if n == 3 else "old") for n in range(64)] + [(100, "new")], key=repr)
    store.delete(spark.createDataFrame([(3, "x"), (4, "x"), (999, "x")], schema), ["id"])
    assert store.read().where("id in (3, 4)").count() == 0 and store.read().count() == 63
    assert values(store.read(snapshot=before)) == sorted([(n, "old") for n in range(64)], key=repr)  # an older reader
    store.delete_all()
    assert store.read().count() == 0


def test_two_writers_cannot_write_the_same_snapshot(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), spark.createDataFrame([], "id long").schema, by=["id"], buckets=2)
    store.append(spark.range(5))
    late = store.snapshot()
    store.append(spark.range(5, 9))
    with pytest.raises(RuntimeError):
        store._commit(late, {}, None)
    assert store.read().count() == 9


def test_a_fetch_moves_the_marks_without_reading_the_stored_commits(spark, tmp_path):
    day = lambda n: datetime(2021, 1, n)
    schema = "repo_id long, sha1 string, commit_date timestamp_ntz"
    store = commit_store(spark, str(tmp_path / "commits"), spark.createDataFrame([], schema).schema)
    known = spark.createDataFrame([(1, "a", day(3)), (2, "x", day(9)), (3, "z", day(2))], schema)
    store.append(known)
    marks = fetch.high_water_marks(store.read())
    mark_store = Store(spark, str(tmp_path / "marks"), marks.schema, by=["repo_id"], buckets=4)
    mark_store.append(marks)
    feed = spark.createDataFrame([(1, "old", 1, day(2)), (1, "a", 2, day(3)), (1, "b", 3, day(5)), (4, "n", 4, None), (2, "y", 5, None)], FEED)
    added = fetch.fetch_into(store, mark_store, feed)
    assert values(added, "sha1") == [("b",), ("n",), ("y",)]
    assert values(store.read(), "sha1") == [("a",), ("b",), ("n",), ("x",), ("y",), ("z",)]
    assert values(mark_store.read()) == sorted([(1, day(5)), (2, day(9)), (3, day(2)), (4, None)], key=repr)
    read = fetch.since_marks(feed, mark_store.read()).inputFiles()
    assert read and all("/marks/" in f for f in read)
    assert values(fetch.fetch_into(store, mark_store, feed)) == []


def test_a_table_is_one_file_or_a_folder_of_parts(spark, tmp_path):
    rows = spark.createDataFrame([(n, f"s{n}", n, datetime(2021, 1, 1)) for n in range(30)], FEED)
    rows.repartition(3).write.parquet(str(tmp_path / "a" / "parts.parquet"))
    (tmp_path / "b").mkdir()
    rows.toPandas().to_parquet(tmp_path / "b" / "single.parquet", coerce_timestamps="us")
    for folder, name in (("a", "parts.parquet"), ("b", "single.parquet")):
        feed = stream_files(spark, str(tmp_path / folder / name), rows.schema)
        store = commit_store(spark, str(tmp_path / f"store-{name}"), rows.schema)
        stream_ingest_commits(feed, store, str(tmp_path / f"checkpoint-{name}")).awaitTermination()
        assert values(store.read().select("sha1")) == sorted((f"s{n}",) for n in range(30))


def test_repeats_within_a_delay(spark, tmp_path):
    path = str(tmp_path / "feed")
    write(spark, path, [(1, "a", 1, datetime(2021, 1, 1)), (1, "a", 2, datetime(2021, 1, 1)), (1, "b", 3, datetime(2021, 1, 1))])
    feed = spark.readStream.schema(FEED).parquet(path)
    query = (
        drop_repeats(feed, "2 days").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    assert values(spark.read.parquet(str(tmp_path / "out")).select("sha1")) == [("a",), ("b",)]

"""Results by content hash equal a full run and read what changed; streams equal batches, drop late rows and restart."""

import datetime
import threading

import pytest
from pyspark.sql import functions as F

from factloom.plans.incremental import ResultStore
from factloom.sources.scratch import children, scratch, scratch_path
from factloom.streaming import windows


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words(df):
    return df.select("id", F.explode(F.split("text", " ")).alias("word"))


def table(spark, given):
    return spark.createDataFrame([(i, t, "clash") for i, t in given], "id long, text string, part string")


@pytest.fixture
def store(spark):
    return ResultStore(spark, scratch_path(spark, "store"), "id", "bigint", "word string")


def holds(store, df):
    return rows(store.results().drop("part")) == rows(words(df.where("id IS NOT NULL")))


def test_only_what_changed_is_read(spark, store):
    assert store.generation() == 0
    assert store.results().count() == 0
    first = table(spark, [(i, f"a{i} b") for i in range(50)] + [(90, None), (91, ""), (None, "null key")])
    did = store.update(first, ["text"], words)
    assert (did.generation, did.kept, did.computed, did.gone, did.rows_read) == (1, 0, 52, 0, 52)
    assert holds(store, first)
    second = table(spark, [(i, f"a{i} b" if i % 10 else "new") for i in range(5, 60)] + [(90, None), (91, "")])
    did = store.update(second, ["text"], words)
    assert (did.kept, did.computed, did.gone) == (43, 14, 5)
    assert did.rows_read == 14
    assert holds(store, second)
    did = store.update(second, ["text"], words)
    assert (did.kept, did.computed, did.rows_read) == (57, 0, 0)
    assert holds(store, second)


def test_repeated_keys_count_together(spark, store):
    store.update(table(spark, [(1, "x"), (1, "x"), (2, "y"), (2, "z")]), ["text"], words)
    again = table(spark, [(2, "z"), (1, "x"), (2, "y")])  # one copy of 1 less, 2 in another order
    did = store.update(again, ["text"], words)
    assert (did.kept, did.computed) == (1, 1)
    assert holds(store, again)


def test_a_run_that_breaks_off_changes_nothing(spark, store, monkeypatch):
    first, second = table(spark, [(1, "a"), (2, "b")]), table(spark, [(1, "a"), (2, "c"), (3, "d")])
    store.update(first, ["text"], words)
    with monkeypatch.context() as m:
        m.setattr(ResultStore, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.update(second, ["text"], words)
    assert len(children(spark, f"{store.folder}/parts")) == 2
    assert holds(store, first)
    spark.createDataFrame([], store.manifest_schema).write.parquet(f"{store.folder}/manifest/generation=2")  # a manifest without its mark
    spark._jvm.org.apache.hadoop.fs.Path(store.folder).getFileSystem(spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(f"{store.folder}/manifest/generation=2/_SUCCESS"), False)
    assert store.generation() == 1
    did = store.update(second, ["text"], words)
    assert (did.generation, did.computed, did.rows_read) == (2, 2, 2)
    assert holds(store, second)
    store.compact()
    assert holds(store, second)
    store.vacuum()
    assert holds(store, second)
    assert len(children(spark, f"{store.folder}/parts")) == len(children(spark, f"{store.folder}/manifest")) == 1


def test_scratch_of_two_threads(spark):
    seen, both = {}, threading.Barrier(2)

    def work(name):
        with scratch(spark) as folder:
            both.wait()
            seen[name] = scratch_path(spark, "x").startswith(folder)
            both.wait()

    some = [threading.Thread(target=work, args=(n,)) for n in "ab"]
    for t in some:
        t.start()
    for t in some:
        t.join()
    assert seen == {"a": True, "b": True}


# --- streams --------------------------------------------------------------------------------------

EVENTS = "id long, at timestamp, k string"


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def events(spark, given):
    return spark.createDataFrame([(i, None if m is None else at(m), k) for i, m, k in given], EVENTS)


def by_hour(stream):
    return windows.tumbling(stream, "at", "1 hour", "30 minutes", ["k"], [F.count("*").alias("n")])


def minutes(spark, df, *columns):
    zero = spark.createDataFrame([(at(0),)], "z timestamp").select(F.unix_seconds("z")).first()[0]
    return rows(df.select(*[((F.unix_seconds(c) - zero) / 60).cast("int") if c in ("window_start", "session_start", "session_end") else F.col(c) for c in columns]))


def test_windows_close_late_rows_are_dropped_and_streams_restart(spark):
    folder = scratch_path(spark, "stream")
    seen = lambda *given: windows.replayed(spark, [events(spark, given)], by_hour, folder)
    got = seen((1, 5, "a"), (2, 10, "a"), (3, 10, "b"), (4, None, "a"), (5, 70, None))
    assert got.count() == 0  # the watermark is at 40: no window has ended
    got = seen((6, 15, "a"), (7, 100, "a"))  # behind, but its window is open; the watermark goes to 70
    assert minutes(spark, got, "window_start", "k", "n") == [(0, "a", 3), (0, "b", 1)]
    got = seen((8, 20, "b"), (9, 65, "a"), (10, 170, "a"))  # 20: too late; 65 still counts; the watermark goes to 140
    assert minutes(spark, got, "window_start", "k", "n") == [(0, "a", 3), (0, "b", 1), (60, "a", 2), (60, None, 1)]
    again = windows.advance(spark, f"{folder}/in", "id bigint, at timestamp, k string", by_hour, f"{folder}/out", f"{folder}/checkpoint")
    assert again.count() == 4  # nothing new: nothing repeated


def test_a_stream_that_breaks_off_goes_on(spark):
    folder, calls = scratch_path(spark, "stream"), []

    def broken(stream):
        calls.append(1)
        counted = by_hour(stream)
        return counted.where(F.when(F.col("n") > 1, F.raise_error(F.lit("lost"))).otherwise(F.lit(True))) if len(calls) == 1 else counted

    events(spark, [(1, 5, "a"), (2, 6, "a"), (3, 200, "a")]).write.parquet(f"{folder}/in")
    with pytest.raises(Exception, match="lost"):
        windows.advance(spark, f"{folder}/in", "id bigint, at timestamp, k string", broken, f"{folder}/out", f"{folder}/checkpoint")
    got = windows.advance(spark, f"{folder}/in", "id bigint, at timestamp, k string", by_hour, f"{folder}/out", f"{folder}/checkpoint")
    assert minutes(spark, got, "window_start", "k", "n") == [(0, "a", 2)]


def test_sessions_across_batches(spark):
    build = lambda s: windows.sessions(s, "at", "10 minutes", "1 minute", ["k"], [F.count("*").alias("n")])
    slices = [events(spark, [(1, 0, "a"), (2, 8, "a"), (3, 3, "b")]), events(spark, [(4, 17, "a"), (5, 40, "a"), (6, 60, "c")])]
    got = windows.replayed(spark, slices, build, scratch_path(spark, "stream"))
    assert minutes(spark, got, "session_start", "session_end", "k", "n") == [(0, 27, "a", 3), (3, 13, "b", 1), (40, 50, "a", 1)]


def test_repeated_deliveries(spark):
    build = lambda s: windows.first_of_each(s, "at", "1 hour", ["id"])
    slices = [events(spark, [(1, 0, "a"), (1, 1, "a"), (2, 5, "a")]), events(spark, [(1, 2, "a"), (3, 9, "b")])]
    assert [r["id"] for r in windows.replayed(spark, slices, build, scratch_path(spark, "stream")).orderBy("id").collect()] == [1, 2, 3]

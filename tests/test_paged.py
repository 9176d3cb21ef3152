import threading
import time

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from uttermark.operators import batching, staging
from uttermark.operators.staging import new_path
from uttermark.plans import catalogue
from uttermark.sources import paged

SCHEMA = "id long, row struct<text: string, audio: array<struct<src: string>>>"


def rows_of(offset, length):
    return [{"id": i, "row": {"text": f"t{i}", "audio": [{"src": f"s{i}"}]}} for i in range(offset, offset + length)]


def unsteady(failures=2):
    seen = {}

    def fetch(offset, length):
        seen[offset] = seen.get(offset, 0) + 1
        if seen[offset] <= failures:
            raise RuntimeError("busy")
        return rows_of(offset, length)

    return fetch


@pytest.mark.parametrize("total", [0, 1, 100, 250])
def test_every_page_is_a_partition(spark, total):
    got = paged.read_pages(spark, f"pages{total}", unsteady(), SCHEMA, lambda: total, pause=0.0)
    assert sorted(r.id for r in got.collect()) == list(range(total))
    assert got.rdd.getNumPartitions() == max(1, -(-total // 100))
    if total:
        assert got.where("id = 0").first().row.audio[0].src == "s0"


def test_pages_cover():
    for start, end in ((0, 0), (0, 5), (3, 10), (7, 35), (10, 20)):
        got = paged.pages(start, end, 10)
        assert [i for p in got for i in range(p.offset, p.offset + p.length)] == list(range(start, end))
        assert all(p.offset // 10 == (p.offset + p.length - 1) // 10 for p in got)


def test_a_page_that_stays_away_fails(spark):
    with pytest.raises(Exception, match="busy"):
        paged.read_pages(spark, "away", unsteady(9), SCHEMA, lambda: 5, retries=2, pause=0.0).collect()
    calls = []

    def never(offset, length):
        calls.append(offset)
        raise batching.PermanentError("gone")

    with pytest.raises(batching.PermanentError):
        paged.fetched(never, paged.Page(0, 5), 5, 0.0)
    assert calls == [0]
    with pytest.raises(RuntimeError, match="has 3 rows for 5"):
        paged.fetched(lambda o, n: rows_of(o, 3), paged.Page(0, 5), 1, 0.0)


def test_stream_reads_what_was_added(spark, tmp_path):
    known = tmp_path / "total"
    out, progress = new_path(spark, "paged"), new_path(spark, "progress")
    for total, want in ((130, 130), (130, 130), (275, 275)):
        known.write_text(str(total))
        stream = paged.stream_pages(spark, "growing", unsteady(1), SCHEMA, lambda: int(known.read_text()), pause=0.0)
        stream.writeStream.format("parquet").option("checkpointLocation", progress).trigger(availableNow=True).start(out).awaitTermination()
        got = spark.read.parquet(out)
        assert got.count() == want == got.select("id").distinct().count()


# --- calls in flight ---------------------------------------------------------------------------


def test_window_of_calls():
    """No more calls than the window, no more items taken than calls, and results as calls end."""
    taken, going, most, lock = [], 0, 0, threading.Lock()

    def items():
        for i in range(20):
            taken.append(i)
            yield i

    def call(i):
        nonlocal going, most
        with lock:
            going += 1
            most = max(most, going)
        time.sleep(0.2 if i == 0 else 0.02)
        with lock:
            going -= 1
        return i * i

    done = []
    for item, result, at in batching.in_completion_order(items(), call, 4):
        done.append((item, result, at))
        assert len(taken) - len(done) <= 4
    assert most == 4 and sorted(x[:2] for x in done) == [(i, i * i) for i in range(20)]
    assert done[0][0] != 0 and {at for _, _, at in done} == {1, 2, 3, 4}
    assert [x for x in batching.in_completion_order(iter("ab"), str.upper, 1)] == [("a", "A", 1), ("b", "B", 1)]


def test_a_failure_in_the_window_ends_the_task(spark):
    def broken(batch):
        return {"x": [1]}

    with pytest.raises(Exception, match="the batch function got"):
        batching.map_batches(spark.range(20).coalesce(1), broken, [("x", "int")], batch_size=2, drop=(), in_flight=3).collect()


def test_retries_hold_inside_the_window(spark):
    seen = {}

    def flaky(batch):
        key = int(batch["id"][0])
        seen[key] = seen.get(key, 0) + 1
        if key % 10 == 0:
            raise batching.PermanentError("no")
        if key % 4 == 0 and seen[key] < 3:
            raise RuntimeError("busy")
        return {"x": [int(i) + 1 for i in batch["id"]]}

    got = batching.map_batches(spark.range(40).coalesce(1), flaky, [("x", "int")], batch_size=2, drop=(), pause=0.0, in_flight=5).collect()
    assert len(got) == 40 and max(r.in_flight for r in got) == 5
    for r in got:
        first = r.id - r.id % 2
        assert (r.x, r.attempts) == ((None, 1) if first % 10 == 0 else (r.id + 1, 3 if first % 4 == 0 else 1))


def test_numbers_come_as_arrays(rows):
    df = rows(
        [(1, [1.0, 2.0], ([0.5, 0.25], 16)), (2, None, None), (3, [], (None, 8)), (4, [3.0], ([1.0], 4))],
        "id int, v array<double>, audio struct<array: array<float>, sampling_rate: int>",
    ).coalesce(1)

    def lengths(batch):
        kinds = [type(a["array"]).__name__ if a else None for a in batch["audio"]]
        return {"n": [-1 if v is None else len(v) for v in batch["v"]], "kind": kinds, "rate": [a and a["sampling_rate"] for a in batch["audio"]]}

    for size in (1, 3):
        got = batching.map_batches(df, lengths, [("n", "int"), ("kind", "string"), ("rate", "int")], batch_size=size).orderBy("id").collect()
        assert [(r.n, r.kind, r.rate) for r in got] == [(2, "ndarray", 16), (-1, None, None), (0, "NoneType", 8), (1, "ndarray", 4)]
        assert got[0].v == [1.0, 2.0] and got[1].v is None


def test_a_large_table_goes_through_in_turns(spark):
    """No task gets much more than its bytes, no more partitions are at work at once, and every row comes back."""

    def lane(batch):
        sizes = sum(len(t) for t in batch["text"] if t)
        return {"lane": [TaskContext.get().partitionId()] * len(batch["id"]), "size": [sizes] * len(batch["id"])}

    text = F.when(F.col("id") % 7 > 0, F.repeat(F.lit("x"), 100))
    df = spark.range(600).repartition(12, "id").select("id", text.alias("text"), F.array(F.col("id")).alias("ids"))
    adds = [("lane", "int"), ("size", "int")]
    whole = batching.map_batches(df, lane, adds, batch_size=1000, parallel=3, parallel_by=("id",))
    turns = batching.map_batches(df, lane, adds, batch_size=1000, parallel=3, parallel_by=("id",), task_bytes=6_000)
    assert batching.table_bytes(df) == 600 * (8 + 16) + 514 * 100
    assert turns.schema.simpleString() == whole.schema.simpleString()
    rows = lambda got: sorted((r.id, r.text, r.ids) for r in got.collect())
    assert rows(turns) == rows(whole) == rows(df)
    assert {r.lane for r in turns.collect()} == {0, 1, 2}
    assert max(r["size"] for r in whole.collect()) > 14_000 and max(r["size"] for r in turns.collect()) < 8_000
    assert turns.select("size", "lane").distinct().count() > 3
    small = batching.map_batches(df, lane, adds, batch_size=1000, parallel=3, task_bytes=10**6)
    assert small.rdd.getNumPartitions() == 3 and rows(small) == rows(df)
    assert batching.map_batches(df.where("id < 0"), lane, adds, parallel=3, task_bytes=1).count() == 0


def test_queries_that_bound_their_calls_take_a_large_table_in_turns(spark, tmp_path, monkeypatch):
    docs = spark.range(400).repartition(6).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.repeat(F.lit("y"), 90).alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    most, real = [], batching._in_turns
    monkeypatch.setattr(batching, "_in_turns", lambda df, mapped, turns: most.append(turns) or real(df, mapped, turns))
    monkeypatch.setattr(catalogue, "TASK_BYTES", 4_000)
    assert catalogue.map_batches_parallel(spark, str(tmp_path)).first().asDict() == {"lanes": 4, "rows": 400, "letters": 400 * 91, "right": 400}
    window = catalogue.map_batches_window(spark, str(tmp_path)).first()
    assert (window.lang, window.rows, window.letters, window.most_in_flight) == ("en", 400, 400 * 98, 4)
    assert most == [3, 4]


def test_turns_in_a_folder_with_a_blank_in_its_name(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "shared_folder", lambda spark: f"{tmp_path}/a b%20c")
    got = batching.map_batches(spark.range(100), lambda b: {"y": [i + 1 for i in b["id"]]}, [("y", "long")], drop=(), parallel=2, task_bytes=100)
    assert got.where("y = id + 1").count() == 100

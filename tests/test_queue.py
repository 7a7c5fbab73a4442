"""The keyed queue: rules, restarts, cost of a batch, live progress."""

import json
import random
import time

from shelfspark.streaming import ingest, queue
from shelfspark.streaming.queue import QueueProgress

FIELDS = ("path", "kind", "thumb", "seq")


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f".{name}").write_text("\n".join(json.dumps(dict(zip(FIELDS, r))) for r in rows))
    (folder / f".{name}").rename(folder / f"{name}.json")


def run(spark, tmp_path, **trigger):
    q = queue.keyed_queue(ingest.change_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), **trigger)
    q.awaitTermination()
    return q


def waiting(spark, tmp_path):
    return {r.path: (r.kind, r.thumb, r.seq) for r in queue.waiting_jobs(spark, str(tmp_path / "ck")).collect()}


def test_jobs_replace_each_other_and_leave_when_done(spark, tmp_path):
    put(tmp_path / "in", "1", [("/a", "upsert", True, 1), ("/b", "upsert", False, 2), ("/c", "remove", False, 3), ("/a", "upsert", False, 4)])
    run(spark, tmp_path)
    assert waiting(spark, tmp_path) == {"/a": ("upsert", True, 4), "/b": ("upsert", False, 2), "/c": ("remove", False, 3)}
    # started again with its checkpoint: done jobs go, one that was renewed stays, a removal drops the thumbnail
    put(tmp_path / "in", "2", [("/c", "done", None, 3), ("/b", "done", None, 1), ("/a", "remove", False, 5), ("/d", "upsert", False, 6), ("/d", "done", None, 6), (None, "upsert", True, 7), ("/b", "upsert", True, 1)])
    run(spark, tmp_path)
    assert waiting(spark, tmp_path) == {"/a": ("remove", False, 5), "/b": ("upsert", False, 2)}
    told = {(r.path, r.state, r.seq) for r in spark.read.parquet(str(tmp_path / "out/batch=1")).collect()}
    assert told == {("/a", "waiting", 5), ("/c", "done", 3), ("/d", "done", 6)}
    put(tmp_path / "in", "3", [("/a", "upsert", False, 8)])
    run(spark, tmp_path)
    assert waiting(spark, tmp_path)["/a"] == ("upsert", False, 8)


def test_a_batch_costs_what_its_paths_cost(spark, tmp_path):
    put(tmp_path / "in", "1", [(f"/p{i}", "upsert", False, i) for i in range(3000)])
    run(spark, tmp_path)
    put(tmp_path / "in", "2", [("/p7", "upsert", True, 9000), ("/p8", "done", None, 9001)])
    last = run(spark, tmp_path).lastProgress
    state = last.stateOperators[0]
    assert last.numInputRows == 2 and state.numRowsTotal == 2999 and state.numRowsUpdated + state.numRowsRemoved <= 4
    assert spark.read.parquet(str(tmp_path / "out/batch=1")).count() == 2


def test_stream_equals_one_batch_and_the_plain_rules(spark, tmp_path):
    rng = random.Random(4)
    events = [(f"/{rng.randint(0, 12)}", rng.choice(["upsert", "upsert", "remove", "done"]), rng.random() < 0.5, i) for i in range(200)]
    want = {}
    for path, *event in events:
        want[path] = queue.after(want.get(path), tuple(event))
    for n in range(4):
        part = events[n * 50 : n * 50 + 50]
        rng.shuffle(part)
        put(tmp_path / "in", str(n), part)
        run(spark, tmp_path)
    assert waiting(spark, tmp_path) == {p: j for p, j in want.items() if j}
    # without done events it is the batch rule
    plain = [e for e in events if e[1] != "done"]
    batch = {r.path: (r.kind, r.thumb, r.seq) for r in ingest.dedup_queue(spark.createDataFrame(plain, "path string, kind string, thumb boolean, seq long")).collect()}
    held = {}
    for path, *event in plain:
        held[path] = queue.after(held.get(path), tuple(event))
    assert batch == held


def test_progress_of_a_running_stream(spark, tmp_path):
    seen = QueueProgress("indexing")
    spark.streams.addListener(seen)
    try:
        put(tmp_path / "in", "1", [("/a", "upsert", False, 1), ("/b", "upsert", False, 2), ("/c", "upsert", False, 3)])
        q = queue.keyed_queue(ingest.change_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), "indexing", processingTime="0 seconds")

        def until(want):
            for _ in range(600):
                if seen.snapshot() == want:
                    return
                time.sleep(0.1)
            raise AssertionError(seen.snapshot())

        until({"pending": 3, "processed": 0, "running": True, "last_path": None})
        put(tmp_path / "in", "2", [("/a", "done", None, 1), ("/b", "done", None, 2)])
        until({"pending": 1, "processed": 2, "running": True, "last_path": "/b"})
        q.stop()
        until({"pending": 1, "processed": 2, "running": False, "last_path": "/b"})
        # after a restart what waits is known from the state
        put(tmp_path / "in", "3", [("/d", "upsert", False, 4)])
        queue.keyed_queue(ingest.change_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), "indexing").awaitTermination()
        until({"pending": 2, "processed": 2, "running": False, "last_path": "/b"})
    finally:
        spark.streams.removeListener(seen)


def test_scan_stamps_are_kept(spark, tmp_path):
    folder = str(tmp_path / "stamps")
    assert queue.last_scan(spark, folder) == 0 and ingest.scan_due("hourly", queue.last_scan(spark, folder), 5000, False)
    queue.stamp_scan(spark, folder, 5000)
    assert queue.last_scan(spark, folder) == 5000 and not ingest.scan_due("hourly", queue.last_scan(spark, folder), 6000, False)
    queue.stamp_scan(spark, folder, 8600)
    assert queue.last_scan(spark, folder) == 8600

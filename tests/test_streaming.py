import time
from datetime import date, datetime

from pyspark.sql import functions as F

from nodalis.operators import writes
from nodalis.streaming import ingest, poll, sides

ROWS = "k string, posted long, v long"


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def source(name, folder, incoming, failing, every="1 second"):
    def merge(stored, batch):
        if failing.get(name, 0):
            failing[name] -= 1
            raise RuntimeError(f"{name} is down")
        return writes.upsert(stored, batch, ["k"], "posted")

    return poll.Source(name, lambda s: s.readStream.schema(ROWS).parquet(str(incoming)), str(folder), ROWS, merge, ("k",), every)


def rows_of(spark, folder):
    return sorted(map(tuple, ingest.current(spark, str(folder), ROWS).select("k", "posted", "v").collect()))


def test_one_source_fails_three_times_and_the_others_go_on(spark, tmp_path):
    failing, names = {"b": 3}, ("a", "b", "c")
    for n in names:
        put(spark, tmp_path / f"{n}-in", [(n, 1, 10)], ROWS)
    made = [source(n, tmp_path / n, tmp_path / f"{n}-in", failing) for n in names]
    seen = []
    poller = poll.Poller(spark, made, pause=0.5)

    def merged(name):
        try:
            return rows_of(spark, tmp_path / name)
        except Exception:
            return []

    import threading

    def watch():
        began = time.monotonic()
        while time.monotonic() - began < 150:
            if not seen and merged("a") and merged("c") and not merged("b"):
                seen.append("others first")
            if all(merged(n) for n in names):
                break
            time.sleep(0.2)
        poller.stop()

    thread = threading.Thread(target=watch)
    thread.start()
    poller.run(seconds=160)
    thread.join()
    assert [(n, i) for n, i, _ in poller.failures] == [("b", 1), ("b", 2), ("b", 3)]
    assert all("b is down" in message for _, _, message in poller.failures)
    assert seen and {n: rows_of(spark, tmp_path / n) for n in names} == {n: [(n, 1, 10)] for n in names}
    assert not spark.streams.active


def test_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    put(spark, tmp_path / "in", [("k", 1, 10)], ROWS)
    poll.Poller(spark, [source("x", tmp_path / "x", tmp_path / "in", {}, None)]).run(seconds=90)
    put(spark, tmp_path / "in", [("k", 2, 20), ("m", 1, 5)], ROWS)
    poller = poll.Poller(spark, [source("x", tmp_path / "x", tmp_path / "in", {"x": 1}, None)], pause=0.1)
    poller.run(seconds=90)
    assert len(poller.failures) == 1
    assert rows_of(spark, tmp_path / "x") == [("k", 2, 20), ("m", 1, 5)]


def test_a_source_that_cannot_open_is_tried_again(spark, tmp_path):
    put(spark, tmp_path / "in", [("k", 1, 10)], ROWS)
    good, tries = source("y", tmp_path / "y", tmp_path / "in", {}, None), []

    def opened(session):
        tries.append(1)
        if len(tries) < 3:
            raise OSError("no connection")
        return good.open(session)

    poller = poll.Poller(spark, [poll.Source("y", opened, good.folder, ROWS, good.merge, ("k",), None)], pause=0.05)
    poller.run(seconds=90)
    assert [n for _, n, _ in poller.failures] == [1, 2] and rows_of(spark, tmp_path / "y") == [("k", 1, 10)]


POSTINGS = "day date, posted timestamp, doc long"


def at(day, hour, minute=0):
    """A posting at an hour of central daylight time, as UTC."""
    return datetime(2024, 6, day, hour + 5, minute) if hour + 5 < 24 else datetime(2024, 6, day + 1, hour - 19, minute)


def test_sides_of_a_stream_close_by_watermark(spark, tmp_path):
    incoming, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    day = lambda d: date(2024, 6, d)

    def step(rows):
        put(spark, incoming, rows, POSTINGS)
        stream = spark.readStream.schema(POSTINGS).parquet(incoming)
        run = sides.closed_sides(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        run.awaitTermination()  # every step is a restart
        return sorted((r.day.day, r.side, r.posted.day, r.posted.hour, r.doc, r.postings) for r in spark.read.parquet(out).collect())

    first = [(day(5), at(4, 6), 1), (day(5), at(4, 8), 2), (day(5), at(4, 8), 3), (day(5), at(4, 14), 4), (day(5), at(4, 6), 1), (day(6), at(4, 9), 99)]
    assert step(first) == []  # still open; document 99 was not posted on the day before its own
    second = [(day(5), at(4, 15), 5), (day(5), at(4, 13), 6), (day(5), at(4, 7), 12), (day(6), at(5, 6), 7)]
    step(second)  # a correction, a posting that comes late, and one that comes too late
    third = [(day(5), at(4, 16), 8), (day(6), at(5, 23), 9), (day(7), at(6, 5), 10)]  # the first came after its day was closed
    got = step(third)
    want = [(5, "final", 4, 20, 5, 3), (5, "study", 4, 13, 3, 4)]
    assert got[:2] == want
    got = step([(day(8), at(7, 12), 11)])
    assert got == [*want, (6, "final", 6, 4, 9, 1), (6, "study", 5, 11, 7, 1), (7, "study", 6, 10, 10, 1)]


def test_sides_of_a_table(spark):
    rows = [(date(2024, 6, 5), at(4, 6), 1), (date(2024, 6, 5), at(4, 8), 2), (date(2024, 6, 5), at(4, 8), 3), (date(2024, 6, 5), at(4, 14), 4), (date(2024, 6, 5), at(5, 8), 7)]
    got = sides.sides(spark.createDataFrame(rows, POSTINGS)).orderBy("side").collect()
    assert [(r.side, r.posted, r.doc, r.postings) for r in got] == [("final", at(4, 14), 4, 1), ("study", at(4, 8), 3, 3)]
    assert sides.sides(spark.createDataFrame([], POSTINGS)).count() == 0

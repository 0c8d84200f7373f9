"""Entries that expire in a stream over several batches and restarts; files taken in once."""

import datetime as dt
import time

import pytest

from tessera.sources import collections, ingest
from tessera.streaming import state_streams as s

START = dt.datetime(2024, 1, 1)
HOUR = 3600 * 1000


def put(spark, folder, name, rows):
    """rows: (user_id, event_id, hours after the start)."""
    data = [(u, e, START + dt.timedelta(hours=h)) for u, e, h in rows]
    spark.createDataFrame(data, "user_id long, event_id long, ts timestamp").coalesce(1).write.parquet(f"{folder}/in/{name}")


def run(spark, folder, lifetime_ms, late):
    stream = spark.readStream.schema("user_id long, event_id long, ts timestamp").option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    with s.rocks_db(spark):
        out = s.drained(s.lookups(stream, lifetime_ms, late), "append", ["event_id"], folder, single=late is None)
    assert spark.conf.get(s.STORE, "") != s.ROCKS
    return {r.event_id: r.hit for r in out.collect()}


def held(spark, folder):
    return spark.read.format("statestore").option("stateVarName", "entry").load(f"{folder}/checkpoint").count()


def test_entries_expire_by_event_time(spark, tmp_path):
    folder = str(tmp_path)
    put(spark, folder, "a", [(1, 1, 0), (1, 2, 24), (1, 3, 48.001), (2, 4, 0), (3, 5, 1)])
    assert run(spark, folder, 24 * HOUR, "1 hour") == {1: False, 2: True, 3: False, 4: False, 5: False}
    # State outlives a restart: the entry of user 1 is found, those of users 2 and 3 are too old and were dropped.
    put(spark, folder, "b", [(1, 6, 60), (4, 7, 70)])
    got = run(spark, folder, 24 * HOUR, "1 hour")
    assert got[6] is True and got[7] is False
    put(spark, folder, "c", [(4, 8, 94)])
    got = run(spark, folder, 24 * HOUR, "1 hour")
    assert got[8] is True
    # The watermark is past the entries of users 1 to 3.
    put(spark, folder, "d", [(5, 9, 95), (2, 10, 96)])
    got = run(spark, folder, 24 * HOUR, "1 hour")
    assert got[9] is False and got[10] is False
    assert held(spark, folder) == 3  # users 4, 5 and 2


def test_entries_expire_by_the_clock(spark, tmp_path):
    folder = str(tmp_path)
    put(spark, folder, "a", [(1, 1, 0), (1, 2, 1000)])
    assert run(spark, folder, 3_600_000, None) == {1: False, 2: True}
    put(spark, folder, "b", [(1, 3, 2000)])
    assert run(spark, folder, 3_600_000, None)[3] is True
    short = f"{folder}/short"
    put(spark, short, "a", [(1, 1, 0)])
    run(spark, short, 1500, None)
    time.sleep(2)
    put(spark, short, "b", [(1, 2, 0)])
    assert run(spark, short, 1500, None)[2] is False


def test_files_are_taken_in_once(spark, tmp_path, monkeypatch):
    inbox, store, work = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "work")
    inbox.mkdir()
    stored = lambda: sorted((r.filename, r.chunk_index, r.page, r.text) for r in collections.read(spark, store, "law").collect())
    (inbox / "a.txt").write_text("Положение\fо закупке")
    (inbox / "b.txt").write_text("Положение\fо закупке")
    (inbox / "long.txt").write_text("слово " * 400)
    (inbox / "x.pdf").write_bytes(b"no pdf")
    (inbox / "blank.txt").write_text(" \n")
    ingest.ingest(spark, str(inbox), store, "law", work)
    first = stored()
    assert [x[:3] for x in first] == [("a.txt", 0, 1), ("a.txt", 1, 2), ("long.txt", 0, 1), ("long.txt", 1, 1), ("long.txt", 2, 1)]
    assert {(r.filename, r.error) for r in ingest.errors(spark, work).collect()} == {("x.pdf", "not a PDF file"), ("blank.txt", "no text")}
    # Again, with nothing new; then with another checkpoint.
    ingest.ingest(spark, str(inbox), store, "law", work)
    ingest.ingest(spark, str(inbox), store, "law", str(tmp_path / "other"))
    assert stored() == first
    # A batch that was cut behind its write runs again, and adds nothing twice.
    (inbox / "c.txt").write_text("новое")
    kept = collections.append

    def cut(*args):
        kept(*args)
        raise RuntimeError("cut")

    monkeypatch.setattr(collections, "append", cut)
    with pytest.raises(Exception, match="cut"):
        ingest.ingest(spark, str(inbox), store, "law", work)
    monkeypatch.setattr(collections, "append", kept)
    ingest.ingest(spark, str(inbox), store, "law", work, files_per_batch=1)
    assert stored() == sorted([*first, ("c.txt", 0, 1, "новое")])


def test_a_batch_looks_up_its_own_files_alone(spark, tmp_path, monkeypatch):
    """Else each batch lists the whole collection, and a folder of many files takes the square of its size."""
    inbox, store = tmp_path / "in", str(tmp_path / "store")
    inbox.mkdir()
    for i in range(5):
        (inbox / f"{i}.txt").write_text(f"текст {i % 4}")
    monkeypatch.setattr(collections, "files", lambda *a: pytest.fail("listed"))
    ingest.ingest(spark, str(inbox), store, "law", str(tmp_path / "one"), files_per_batch=2)
    ingest.ingest(spark, str(inbox), store, "law", str(tmp_path / "two"), files_per_batch=2)
    assert collections.read(spark, store, "law").count() == 4
    assert collections.stored(spark, store, "law", ["absent"]) == set() == collections.stored(spark, store, "none", ["absent"])


def test_chunks_are_cut_once(spark):
    """A window of text isn't cut again for each mention of it in a filter."""
    from tessera.operators.chunking import chunk

    d = chunk(spark.createDataFrame([("a", 1, "x y\n" * 900)], "file_id string, page int, text string"))
    assert d._jdf.queryExecution().optimizedPlan().toString().count("substring(") <= 2 and d.count() == 4  # the window and its left part

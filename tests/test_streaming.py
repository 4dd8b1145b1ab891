"""Streams over several micro-batches end where the batch operators end."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from maskwright.operators import limits, running
from maskwright.operators import reports as R
from maskwright.streaming import jobs
from maskwright.streaming import runtime as rt
from tests.test_running import SCHEMA, skewed_events


def write_parts(df, order, n, folder, name):
    """n files in time order, named so that the stream reads them in that order."""
    import os
    import time

    rows = sorted(df.collect(), key=lambda r: tuple(r[c] for c in order))
    size = -(-len(rows) // n)
    now = time.time() - 1000
    for i in range(n):
        path = f"{folder}/{name}{i}.parquet"
        df.sparkSession.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1).write.parquet(f"{folder}/_tmp{i}")
        piece = [f for f in os.listdir(f"{folder}/_tmp{i}") if f.endswith(".parquet")][0]
        os.link(f"{folder}/_tmp{i}/{piece}", path)
        os.utime(path, (now + i, now + i))


def test_rate_limit_state_crosses_batches(spark, tmp_path):
    rng = random.Random(6)
    rows, t = [], 0
    for i in range(1200):
        t += rng.choice([0, 0, 1, 1, 2, 5])
        rows.append((i, 0 if i % 3 == 0 else rng.randint(1, 5), t))
    df = spark.createDataFrame(rows, "id long, client long, at long")
    (tmp_path / "in").mkdir()
    write_parts(df, ["at", "id"], 4, str(tmp_path / "in"), "req")
    out = str(tmp_path / "out")
    jobs.rate_limit(rt.file_stream(spark, str(tmp_path / "in"), "req", files_per_batch=1), out)
    got = {r.id: (r.window_start, r.n, r.limited) for r in rt.table(spark, out, "decisions").filter("id IS NOT NULL").collect()}
    want = {r.id: (r.window_start, r.n, r.limited) for r in limits.rate_limit(df).collect()}
    assert got == want and any(v[2] for v in want.values())
    assert rt.table(spark, out, "decisions").select("batch").distinct().count() == 4


def test_quota_state_crosses_batches(spark, tmp_path):
    rows = [(i, i % 3, dt.datetime(2024, 1, 25) + dt.timedelta(hours=i)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, key_id long, timestamp timestamp_ntz")
    keys = spark.createDataFrame([(0, 10), (1, None), (2, 0)], "key_id long, monthly_limit long")
    (tmp_path / "in").mkdir()
    write_parts(df, ["timestamp", "id"], 3, str(tmp_path / "in"), "calls")
    out = str(tmp_path / "out")
    jobs.quota(rt.file_stream(spark, str(tmp_path / "in"), "calls", 1), keys, out)
    got = {r.id: (r.n, r.status) for r in rt.table(spark, out, "decisions").collect()}
    want = {r.id: (r.n, r.status) for r in limits.monthly_quota(df.join(keys, "key_id")).collect()}
    assert got == want


def _call_files(spark, folder, parts):
    """One file a part, in the order in which the stream reads them."""
    folder.mkdir(exist_ok=True)
    for n, rows in parts:
        path = folder.parent / f"part{n}"
        spark.createDataFrame(rows, "id long, key_id long, timestamp timestamp_ntz").coalesce(1).write.parquet(str(path))
        piece = next(path.glob("*.parquet")).rename(folder / f"calls{n}.parquet")
        os.utime(piece, (1_700_000_000 + n, 1_700_000_000 + n))


def test_quota_state_follows_changed_keys_and_closed_months_leave(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rt, "COMPACT_EVERY", 2)
    day = lambda m, d: dt.datetime(2024, m, d)
    keys = spark.createDataFrame([(k, 3) for k in range(50)], "key_id long, monthly_limit long")
    parts = [
        [(k, k, day(1, 10)) for k in range(50)],
        [(100, 1, day(1, 31)), (101, 1, day(2, 1))],
        [(200, 1, day(2, 5)), (201, 1, day(1, 30)), (202, 99, day(2, 5))],  # late, but January is open till 8 February
        [(300, 2, day(2, 20)), (301, 1, day(2, 20)), (302, 1, day(2, 21))],
        [(400, 1, day(1, 31)), (401, 1, day(2, 22))],  # January is closed
    ]
    _call_files(spark, tmp_path / "in", list(enumerate(parts))[:3])
    out = str(tmp_path / "out")
    job = lambda: jobs.quota(rt.file_stream(spark, str(tmp_path / "in"), "calls", 1), keys, out)
    job()
    _call_files(spark, tmp_path / "in", list(enumerate(parts))[3:])
    job()  # a restart goes on from the checkpoint
    got = {r.id: (r.n, r.status) for r in rt.table(spark, out, "decisions").collect()}
    assert [got[i] for i in (1, 100, 101, 200, 201, 202)] == [(1, 200), (2, 200), (1, 200), (2, 200), (3, 200), (None, 401)]
    assert [got[i] for i in (300, 301, 302, 400, 401)] == [(1, 200), (3, 200), (4, 429), (1, 200), (5, 429)]
    sizes = [spark.read.parquet(rt.batch_folder(out, "state", i)).count() for i in range(5)]
    assert sizes == [50, 2, 2, 2, 2]  # keys and months that a batch changes
    assert rt.runs_upto(spark, out, "state", 4) == [(0, 4), (2, 3)]
    assert {(r.key_id, r.month.month, r.used) for r in spark.read.parquet(rt.batch_folder(out, "state-compact2", 3)).collect()} == {(1, 2, 4), (2, 2, 1)}


def test_levels_of_merged_runs(spark, tmp_path):
    out, keys = str(tmp_path), ["k"]
    for b in range(9):
        rows = [(b % 3, f"{b}"), (10 + b, "once")]
        rt.save_version(spark.createDataFrame(rows, "k long, v string").coalesce(1), out, "t", b, keys, every=2)
        got = {r.k: r.v for r in rt.latest(spark, out, "t", keys, every=2).collect()}
        assert got == {**{i % 3: f"{i}" for i in range(b + 1)}, **{10 + i: "once" for i in range(b + 1)}}
    runs = lambda b: rt.runs_upto(spark, out, "t", b, every=2)
    assert runs(7) == [(3, 7)] and runs(8) == [(0, 8), (3, 7)] and runs(6) == [(0, 6), (1, 5), (2, 3)]
    assert {r.k for r in rt.latest(spark, out, "t", keys, upto=1, every=2).collect()} == {0, 1, 10, 11}


def test_counters_and_literacy_over_batches(spark, tmp_path, monkeypatch):
    events = spark.createDataFrame(skewed_events(900), SCHEMA)
    (tmp_path / "in").mkdir()
    write_parts(events, ["timestamp", "id"], 3, str(tmp_path / "in"), "ev")
    out = str(tmp_path / "out")
    jobs.literacy(rt.file_stream(spark, str(tmp_path / "in"), "ev", 1), out)
    got = {r.user_id: (r.types, r.anonymised, r.score) for r in rt.last_version(rt.table(spark, out, "literacy"), ["user_id"]).collect()}
    assert got == {r.user_id: (r.types, r.anonymised, r.score) for r in R.literacy_score(events).collect()}
    monkeypatch.setattr(rt, "COMPACT_EVERY", 2)
    again = str(tmp_path / "again")
    jobs.literacy(rt.file_stream(spark, str(tmp_path / "in"), "ev", 1), again)
    assert rt.table(spark, again, "literacy-compact").select("batch").distinct().count() == 1
    compacted = rt.latest(spark, again, "literacy", ["user_id"])
    assert got == {r.user_id: (r.types, r.anonymised, r.score) for r in compacted.collect()}


def test_late_rows_are_dropped(spark, tmp_path):
    day = dt.datetime(2024, 3, 1)
    rows = [(day, "a")] * 3 + [(day + dt.timedelta(days=30), "a")] * 2
    late = [(day, "a"), (day + dt.timedelta(days=29), "a")]
    (tmp_path / "in").mkdir()
    schema = "ts timestamp_ntz, event_type string"
    import os
    import time

    for i, part in enumerate([rows, [(day + dt.timedelta(days=30), "b")], late]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        piece = [f for f in os.listdir(tmp_path / f"w{i}") if f.endswith(".parquet")][0]
        os.link(tmp_path / f"w{i}" / piece, tmp_path / "in" / f"ev{i}.parquet")
        os.utime(tmp_path / "in" / f"ev{i}.parquet", (time.time() - 100 + i,) * 2)
    out = str(tmp_path / "out")
    jobs.activity_windows(rt.file_stream(spark, str(tmp_path / "in"), "ev", 1), out, late="2 days")
    done = rt.last_version(rt.table(spark, out, "windows"), ["window_start", "event_type"])
    n = {str(r.window_start)[:10]: r.n for r in done.filter("event_type = 'a'").collect()}
    assert n["2024-03-01"] == 3  # the late row for 1 March came after the watermark had passed
    assert n["2024-03-30"] == 3  # one day late is inside the watermark


def test_replayed_batch_replaces_itself(spark, tmp_path):
    df = spark.range(5).withColumn("v", F.lit("x"))
    for _ in range(2):
        rt.save(df, str(tmp_path), "t", 0)
    assert rt.table(spark, str(tmp_path), "t").count() == 5


def test_gate_and_log(spark, tmp_path):
    df = spark.createDataFrame([(1, "mail a@b.com"), (2, "ok"), (3, "IBAN DE89370400440532013000")], "doc_id long, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    jobs.scan_gate(stream, out, "2024-01-31 00:00:00")
    gate = {r.doc_id: r for r in rt.table(spark, out, "gate").collect()}
    assert {i: r.route for i, r in gate.items()} == {1: "passed", 2: "passed", 3: "held"}
    assert gate[3].text is None and gate[3].error_code == "CONTENT_BLOCK" and gate[1].text == "mail a@b.com"
    log = rt.table(spark, out, "log")
    assert "text" not in log.columns and log.count() == 3


def test_config_is_read_again_after_its_age(spark):
    now = [0.0]
    cache = jobs.ConfigCache(lambda: spark.range(1), ttl=300, clock=lambda: now[0])
    for t in (0, 100, 300, 301, 500, 602):
        now[0] = t
        cache.get()
    assert cache.reads == 3


def test_limiter_with_text_keys_late_requests_and_a_shrinking_state(spark, tmp_path):
    first = [(i, "10.0.0.%d" % (i % 7), 1000 + i) for i in range(60)]
    late = [(100, "10.0.0.1", 990), (101, "10.0.0.1", 1062), (102, "10.0.0.9", 1065)]
    after = [(200, "10.0.0.9", 90_000)]
    (tmp_path / "in").mkdir()
    for name, rows in (("a", first), ("b", late), ("c", after)):
        df = spark.createDataFrame(rows, "id long, client string, at long")
        write_parts(df, ["id"], 1, str(tmp_path / "in"), f"req{name}") if not (tmp_path / "in" / "_tmp0").exists() else None
        if name != "a":
            df.coalesce(1).write.parquet(str(tmp_path / "in" / f"_{name}"))
            piece = next((tmp_path / "in" / f"_{name}").glob("*.parquet"))
            piece.rename(tmp_path / "in" / f"req{name}0.parquet")
    out = str(tmp_path / "out")
    jobs.rate_limit(rt.file_stream(spark, str(tmp_path / "in"), "req", files_per_batch=1), out)
    done = {r.id: r for r in rt.table(spark, out, "decisions").filter("id IS NOT NULL").collect()}
    assert set(done) == {r[0] for r in first + late + after}
    assert done[100].window_start == 1001 and done[100].n > done[57].n  # counted in the open window, at its start
    assert done[101].window_start == 1062 and done[102].n == 1
    sizes = [spark.read.parquet(rt.batch_folder(out, "state", i)).count() for i in range(3)]
    assert sizes[0] == 7 and sizes[-1] == 1


def test_limiter_keeps_a_window_that_another_clients_clock_has_ended(spark, tmp_path):
    """Client 1 is late in the second batch, and again in a third that comes when the lateness has passed."""
    parts = [[(i, 1, 100) for i in range(10)] + [(50, 2, 161)], [(51, 1, 150)], [(52, 2, 760)], [(53, 1, 155)]]
    (tmp_path / "in").mkdir()
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, "id long, client long, at long").coalesce(1).write.parquet(str(tmp_path / f"part{n}"))
        piece = next((tmp_path / f"part{n}").glob("*.parquet")).rename(tmp_path / "in" / f"req{n}.parquet")
        os.utime(piece, (1_700_000_000 + n, 1_700_000_000 + n))
    out = str(tmp_path / "out")
    jobs.rate_limit(rt.file_stream(spark, str(tmp_path / "in"), "req", files_per_batch=1), out)
    done = {r.id: (r.window_start, r.n, r.limited) for r in rt.table(spark, out, "decisions").filter("id IS NOT NULL").collect()}
    assert done[51] == (100, 11, True) and done[50] == (161, 1, False)
    assert done[52] == (760, 1, False) and done[53] == (155, 1, False)


def test_configuration_is_held_while_the_table_is_replaced(spark, tmp_path):
    path = str(tmp_path / "config")
    rows = lambda p: spark.createDataFrame([(1, p, "[]")], "org_id long, preset string, custom_terms string")
    rows("finance").write.parquet(path)
    now = [0.0]
    cache = jobs.ConfigCache(lambda: spark.read.parquet(path), ttl=300, clock=lambda: now[0])
    assert cache.get().first().preset == "finance"
    rows("health").write.mode("overwrite").parquet(path)
    now[0] = 299.0
    assert cache.get().first().preset == "finance" and cache.reads == 1
    now[0] = 301.0
    assert cache.get().first().preset == "health" and cache.reads == 2


def test_a_table_may_be_a_folder_of_files(spark, tmp_path):
    """Both scans of a stream read ``documents.parquet`` whole, be it a file or a folder."""
    import __spark_entry__ as entry

    spark.range(40).selectExpr("id AS doc_id", "concat('text ', id) AS text").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, f"N{i}") for i in range(25)], "n_nationkey long, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    gate = entry.queries()["st_scan_gate"](spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in gate) == list(range(40)) and {r.route for r in gate} == {"held", "passed"}
    assert rt.file_stream(spark, str(tmp_path), "documents").schema == spark.read.parquet(str(tmp_path / "documents.parquet")).schema
    decided = entry.queries()["st_config_refresh"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.org_id) for r in decided) == [(i, i % 25) for i in range(40)]


def test_a_table_may_be_a_partitioned_folder(spark, tmp_path):
    """Columns that stand in folder names only are read, and those files are no error."""
    import __spark_entry__ as entry

    rows = [(i, f"text {i}", [None, "en", "de/x"][i % 3], i % 2) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, part int")
    docs.write.partitionBy("lang", "part").parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, f"N{i}") for i in range(25)], "n_nationkey long, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    decided = entry.queries()["st_config_refresh"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.org_id) for r in decided) == [(i, i % 25) for i in range(40)]
    out = str(tmp_path / "out")
    rt.run(rt.file_stream(spark, str(tmp_path), "documents"), out, lambda b, i: rt.save(b, out, "whole", i))
    got = rt.table(spark, out, "whole").select("doc_id", "text", "lang", "part").collect()
    assert sorted(map(tuple, got)) == rows


def test_the_folder_of_a_stream_may_be_a_pattern(spark, tmp_path):
    for i in range(2):
        spark.range(5 * i, 5 * i + 5).write.parquet(str(tmp_path / f"day{i}" / "calls.parquet"))
    out = str(tmp_path / "out")
    rt.run(rt.file_stream(spark, f"{tmp_path}/day*", "calls"), out, lambda b, i: rt.save(b, out, "whole", i))
    assert sorted(r.id for r in rt.table(spark, out, "whole").collect()) == list(range(10))

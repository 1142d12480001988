"""The trend table: bounded files, same counts, replays change nothing."""

import os
import random
from collections import Counter
from datetime import datetime, timedelta

from plume.session import local_fs_path
from plume.streaming import windows as W

DAY0 = datetime(2024, 1, 1)


def batches(n, seed=1):
    """Per batch the windows changed and their counts so far: days go by, and a
    few events come up to an hour late."""
    r, counts, out = random.Random(seed), Counter(), []
    for i in range(n):
        changed = set()
        for _ in range(r.randint(0, 6)):
            day = DAY0 + timedelta(days=max(0, i // 2 - r.choice([0, 0, 0, 1])))
            key = (day, r.choice(["view", "like", None]))
            counts[key] += r.randint(1, 5)
            changed.add(key)
        out.append([(d, d + timedelta(days=1), k, counts[d, k]) for d, k in sorted(changed, key=str)])
    return out, counts


SCHEMA = "window_start timestamp_ntz, window_end timestamp_ntz, event_type string, count long"


def files(path):
    return sum(f.endswith(".parquet") for _, _, names in os.walk(local_fs_path(path)) for f in names)


def rows(table):
    return {(r.window_start, r.event_type): r["count"] for r in table.read().collect()}


def test_fifty_batches_keep_a_bounded_number_of_files(spark, scratch):
    table = W.WindowTable(spark, scratch)
    assert table.read() is None
    given, counts = batches(50)
    most = 0
    for i, b in enumerate(given):
        table.add(spark.createDataFrame(b, SCHEMA).coalesce(1), i)
        most = max(most, files(scratch))
        if i % 7 == 3:  # the batch is run again
            table.add(spark.createDataFrame(b, SCHEMA).coalesce(1), i)
    assert rows(table) == dict(counts)
    assert most <= 2 * 2 + 2 * W.FAN  # two open folders, two levels of closed ones
    assert len(os.listdir(os.path.join(local_fs_path(scratch), "open"))) <= 2


def test_a_killed_batch_is_replayed(spark, scratch, monkeypatch):
    table = W.WindowTable(spark, scratch)
    given, counts = batches(9, seed=2)
    for i, b in enumerate(given):
        df = spark.createDataFrame(b, SCHEMA).coalesce(1)
        if i % 4 == 2:
            for broken in ("_merge", "_latest") if i % 8 == 2 else ("_merge",):
                with monkeypatch.context() as m:
                    m.setattr(W.WindowTable, broken, lambda *a: 1 / 0)
                    try:
                        table.add(df, i)
                    except ZeroDivisionError:
                        pass
        table.add(df, i)
    assert rows(table) == dict(counts)


def test_a_merged_folder_hides_its_parts(spark, scratch, monkeypatch):
    table = W.WindowTable(spark, scratch)
    given, counts = batches(24, seed=3)
    with monkeypatch.context() as m:  # the parts stay where they are
        m.setattr(W.Folder, "delete", lambda *a: None)
        for i, b in enumerate(given):
            table.add(spark.createDataFrame(b, SCHEMA).coalesce(1), i)
    assert any(n.startswith("1-") for n in os.listdir(os.path.join(local_fs_path(scratch), "closed")))
    assert rows(table) == dict(counts)

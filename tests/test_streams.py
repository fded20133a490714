"""Streams of pages and listings against the batch operators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from talentspark.operators import jobs as J
from talentspark.sources.landing import page_window
from talentspark.streaming import jobs as streams

LANDED = "source string, skill string, skill_pos int, page int, payload string, at timestamp"
LISTING = "source string, job_id string, fetch_ord long, skills_matched int, at timestamp"


def stream(spark, folder, batches, schema):
    """The rows of each batch as one file, read one file a micro-batch."""
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, schema.replace("timestamp", "string"))
        frame.coalesce(1).write.mode("append").json(str(folder / "in" / f"b{i:03}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder / "in" / "*"))


def run(spark, df, folder, name):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    return spark.table(name).collect()


def day(n, hour=0):
    return f"2024-01-{n:02} {hour:02}:00:00"


def test_uid_dedup_on_a_stream(spark, tmp_path):
    batches = [
        [("a", "1", 1, 2, day(1)), ("a", "1", 2, 3, day(1)), ("a", "2", 3, 0, day(1)), ("b", "1", 4, 1, day(1))],
        [("a", "1", 5, 1, day(1, 5)), ("a", "2", 6, 1, day(1, 6)), ("", "", 7, 1, day(1, 6)), ("", "", 8, 2, day(1, 6))],
        [("a", "9", 9, 1, day(9))],
        [("a", "1", 10, 1, day(1, 7)), ("a", "3", 11, 1, day(9))],  # behind the watermark: dropped
        [("a", "1", 12, 1, day(9, 1))],  # forgotten by now: a listing of its own
    ]
    got = run(spark, streams.uid_dedup_stream(stream(spark, tmp_path, batches, LISTING), "at", "1 day"), tmp_path, "uids")
    within = spark.createDataFrame([r[:4] for b in batches[:3] for r in b] + [batches[3][1][:4]], LISTING.rsplit(",", 1)[0])
    want = {r.fetch_ord for r in J.uid_dedup(within).collect()} | {12}
    assert sorted(r.fetch_ord for r in got) == sorted(want)


def payload(items, more=False):
    return json.dumps({"data": items, "results": items, "next": "x" if more else None})


@pytest.mark.parametrize("seed", [1, 2])
def test_page_window_on_a_stream(spark, tmp_path, seed):
    rng = random.Random(seed)
    pages = []
    for source in ("Arbeitnow", "Findwork.dev", "Jobicy", "Adzuna"):
        for skill in ("py", "sql", None):
            n = rng.randrange(2, 7)
            for p in range(1, n + 1):
                body = rng.choice([payload([{"id": 1}], True)] * 4 + [payload([]), "<error>", payload([{"id": 2}])])
                pages.append((source, skill, 0, p, body, day(1, rng.randrange(24))))
    rng.shuffle(pages)
    third = len(pages) // 3
    # the last batch moves the watermark past everything
    batches = [pages[:third], pages[third:2 * third], pages[2 * third:], [("Jobicy", "late", 0, 1, "{}", day(9))], [("Jobicy", "end", 0, 1, "{}", day(9))]]
    got = run(spark, streams.page_window_stream(stream(spark, tmp_path, batches, LANDED), "at", 5, "2 days"), tmp_path, f"pages{seed}")
    every = spark.createDataFrame([r[:5] for b in batches for r in b], LANDED.rsplit(",", 1)[0])
    want = page_window(every, 5).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
    assert len({(r.source, r.skill) for r in got}) > 8


def test_a_missing_page_is_given_up_after_the_delay(spark, tmp_path):
    one = payload([{"id": 1}])
    batches = [[("Arbeitnow", "py", 0, 1, one, day(1)), ("Arbeitnow", "py", 0, 3, one, day(1))], [("Jobicy", "x", 0, 1, "{}", day(20))],
               [("Jobicy", "y", 0, 1, "{}", day(20))]]
    got = run(spark, streams.page_window_stream(stream(spark, tmp_path, batches, LANDED), "at", 5, "1 hour"), tmp_path, "gaps")
    assert sorted((r.source, r.page) for r in got) == [("Arbeitnow", 1), ("Arbeitnow", 3), ("Jobicy", 1), ("Jobicy", 1)]

"""Listings that share page and position in two feed categories."""

from pyspark.sql import functions as F

from talentspark.operators import jobs as J
from talentspark.sources import feeds
from talentspark.sources.landing import LANDED_SCHEMA


def test_two_and_many_skills_score_colliding_pages_alike(spark):
    rows = [("A", 0, 7, "x", t, "c", "l", "u", t) for t in ("python here", "sql here", "python and sql", "sql here", "none")]
    df = spark.createDataFrame(rows, feeds.LISTING_SCHEMA)

    def scored(skills):
        return sorted((r.title, r.skills_matched, r.matched_skills) for r in J.score_jobs(df, skills).collect())

    assert scored(["python", "sql"]) == scored(["python", "sql", *[f"absent{k}" for k in range(50)]])


def test_categories_have_their_place_in_the_fetch_order(spark):
    page = "<rss><channel><item><title>a: b</title><link>u</link><description>d</description></item></channel></rss>"
    names = feeds.CATEGORIES["We Work Remotely"]
    landed = spark.createDataFrame([("We Work Remotely", c, 0, 1, page) for c in names], LANDED_SCHEMA)
    orders = [r.fetch_ord for r in feeds.normalise(landed, "weworkremotely").collect()]
    assert sorted(orders) == [(k << 44) + (1 << 20) for k in range(len(names))]


def test_fetch_order_refuses_what_does_not_fit(spark):
    def order(*values):
        return spark.range(1).select(feeds.fetch_ord(*map(F.lit, values)).alias("o")).first().o

    assert order(2, 3, 4) == (2 << 44) + (3 << 20) + 4
    for values in ((1 << 19, 1, 1), (0, 1 << 24, 1), (0, 1, 1 << 20), (0, -1, 1)):
        try:
            order(*values)
        except Exception as e:
            assert "out of range" in str(e)
        else:
            raise AssertionError(values)

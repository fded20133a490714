"""Landed feed pages: one row per fetched page, and which of them count."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentspark.operators.joins import lookup_join
from talentspark.session import settle
from talentspark.sources.feeds import FEEDS, Feed, json_items

# ``skill`` is the search term (or feed category) of the request, ``skill_pos`` its place in
# the query; feeds that are not searched by term use one fixed value.
LANDED_SCHEMA = "source string, skill string, skill_pos int, page int, payload string"


PAGED = [f for f in FEEDS.values() if f.pages_factor is not None]


def _page_limit(feed: Feed, max_pages: int) -> int:
    return 1 if feed.pages_factor is None else feed.pages_factor * max_pages


def stop_page() -> Column:
    """The page at which a landed page ends its scan, null if it does not: the page itself where it failed or is
    empty (feeds that stop there), the next one where it has no link (feeds that follow links)."""
    payload, page = F.col("payload"), F.col("page")

    def stop_at(feed: Feed) -> Column:
        if feed.stops_when_empty:
            # an unreadable page has no items either
            return F.when(F.coalesce(F.size(json_items(payload, feed.envelope)), F.lit(0)) <= 0, page)
        readable = F.coalesce(F.get_json_object(payload, "$").isNotNull(), F.lit(False))
        link = F.coalesce(F.get_json_object(payload, "$.next"), F.lit(""))
        return F.when(~readable, page).when(link == "", page + 1)

    stop = F
    for feed in PAGED:
        stop = stop.when(F.col("source") == feed.name, stop_at(feed))
    return stop


def within_limit(landed: DataFrame, max_pages: int | None) -> DataFrame:
    if max_pages is None:
        return landed
    limit = F
    for feed in FEEDS.values():
        limit = limit.when(F.col("source") == feed.name, _page_limit(feed, max_pages))
    return landed.where(F.col("page") <= limit)


def page_window(landed: DataFrame, max_pages: int | None = 3) -> DataFrame:
    """Keep the pages a sequential scan of each (source, skill) would have read.

    A scan ends at a failed page, at an empty page (feeds that stop there), after the page
    without a link to the next one (feeds that follow links) and at the page limit;
    ``max_pages=None`` leaves the limit out. Feeds with one request per term never stop early.
    """
    # partial aggregation: only one number per (source, skill) leaves each task
    stops = (
        landed.where(F.col("source").isin([f.name for f in PAGED]))
        .select("source", F.coalesce("skill", F.lit("")).alias("_term"), stop_page().alias("_stop"))
        .groupBy("source", "_term").agg(F.min("_stop").alias("_stop")).where(F.col("_stop").isNotNull())
    )
    landed = within_limit(landed, max_pages)
    joined = lookup_join(
        landed.withColumn("_term", F.coalesce("skill", F.lit(""))),
        settle(stops), ["source", "_term"], "left", spread_by=["source", "skill", "page"],
    )
    return joined.where(F.col("_stop").isNull() | (F.col("page") < F.col("_stop"))).select(*landed.columns)

"""The job operators that need memory, on streams of landed pages and listings."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from talentspark.sources.landing import PAGED, stop_page, within_limit

NEVER = 1 << 30


def uid_dedup_stream(scored: DataFrame, time_col: str, delay: str = "1 day") -> DataFrame:
    """Per source the first matching listing of each id to arrive; ids are forgotten ``delay`` after their time,
    so the state holds the ids of that time only. Equal to ``uid_dedup`` where copies of an id arrive in fetch order
    within the delay; a copy that comes later than that is a listing of its own or, behind the watermark, dropped."""
    matching = scored.where("skills_matched > 0").withWatermark(time_col, delay)
    return matching.dropDuplicatesWithinWatermark(["source", "job_id"])


def page_window_stream(landed: DataFrame, time_col: str, max_pages: int | None = 3, delay: str = "1 hour") -> DataFrame:
    """The pages that a sequential scan of each (source, skill) would have read, from a stream of landed pages.

    Pages may land in any order: one is passed on when all pages before it have landed and none of them ended the
    scan. Remembered are the next page, the page that ends the scan and what waits for a missing page. Once the
    watermark has passed ``delay`` after the last waiting page, it no longer waits for missing ones, which is what the
    batch operator does with gaps. Feeds without pages are passed on at once.
    """
    names = [f.name for f in PAGED]
    columns = ["source", "skill", "skill_pos", "page", "payload"]
    rows = within_limit(landed, max_pages).withWatermark(time_col, delay)
    direct = rows.where(~F.col("source").isin(names)).select(*columns)
    waiting = rows.where(F.col("source").isin(names)).select(
        *columns, F.coalesce("skill", F.lit("")).alias("_term"), F.coalesce(stop_page(), F.lit(NEVER)).alias("_stop"), time_col
    )

    def scan(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, stop, kept = 1, NEVER, {}
        if state.exists:
            at, stop, pages, skills, places, payloads = state.get
            kept = {p: (s, k, b) for p, s, k, b in zip(pages, skills, places, payloads, strict=True)}
        latest = 0
        for frame in frames:
            for skill, place, page, payload, ends, time in zip(
                frame["skill"], frame["skill_pos"], frame["page"], frame["payload"], frame["_stop"], frame[time_col], strict=True
            ):
                kept[int(page)] = (skill, None if pd.isna(place) else int(place), payload)
                stop, latest = min(stop, int(ends)), max(latest, int(time.timestamp() * 1000))
        out = []
        if state.hasTimedOut:
            out = sorted(p for p in kept if p < stop)
            at = max([at, *(p + 1 for p in out)])
        else:
            while at in kept and at < stop:
                out.append(at)
                at += 1
            # a page behind the gap that was given up
            out += sorted(p for p in kept if p < at and p not in out and p < stop)
        done = [(key[0], kept[p][0], kept[p][1], p, kept[p][2]) for p in out]
        kept = {p: v for p, v in kept.items() if p not in out and p < stop}
        ordered = sorted(kept)
        state.update((at, stop, ordered, *([kept[p][i] for p in ordered] for i in range(3))))
        if kept and latest:
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs() + 1))
        frame = pd.DataFrame(done, columns=columns)
        yield frame.astype({"skill_pos": "Int32", "page": "int32"})

    schema = "source string, skill string, skill_pos int, page int, payload string"
    state = "at int, stop int, pages array<int>, skills array<string>, places array<int>, payloads array<string>"
    released = waiting.groupBy("source", "_term").applyInPandasWithState(scan, schema, state, "append", GroupStateTimeout.EventTimeTimeout)
    return released.unionByName(direct)

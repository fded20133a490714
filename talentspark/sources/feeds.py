"""Nine feed layouts and their mapping to one listing schema."""

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentspark.functions.text import clean_html, strip, title_company

# rows of ``normalise``: the listing before it is scored
LISTING_SCHEMA = (
    "source string, source_ord int, fetch_ord long, job_id string, title string, company string, "
    "location string, url string, description string"
)


@dataclass(frozen=True)
class Feed:
    """How one feed is laid out.

    ``items``: payload column -> array of item structs. ``fields``: item -> listing columns.
    ``pages_factor``: pages per allowed page, None for one request per term.
    ``envelope``: dotted path of the item array in a JSON page. ``html``: descriptions hold tags to strip.
    """

    name: str
    ord: int
    items: Callable[[Column], Column]
    fields: Callable[[Column], dict[str, Column]]
    envelope: str | None = None
    pages_factor: int | None = None
    stops_when_empty: bool = False
    follows_next: bool = False
    html: bool = True


def _or(c: Column, default: str) -> Column:
    return F.coalesce(c, F.lit(default))


def _or_empty(c: Column, default: str) -> Column:
    """``default`` for missing and for empty values."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def json_items(payload: Column, envelope: str, item_type: str = "string") -> Column:
    """The array under the dotted ``envelope`` path of a JSON page; null if unreadable."""
    keys = envelope.split(".")
    ddl = reduce(lambda inner, key: f"struct<{key}:{inner}>", reversed(keys), f"array<{item_type}>")
    return reduce(lambda c, key: c[key], keys, F.from_json(payload, ddl))


def _json(envelope: str, item_ddl: str) -> Callable[[Column], Column]:
    return lambda payload: json_items(payload, envelope, f"struct<{item_ddl}>")


# --- fixed values of the mappings below: field names of each feed and the texts that stand in
# --- for missing fields


def _arbeitnow(j: Column) -> dict[str, Column]:
    remote = j["remote"].isNotNull() & ~j["remote"].isin("false", "0", "")
    return dict(
        job_id=_or(j["slug"], ""), title=_or(j["title"], ""), company=_or(j["company_name"], ""),
        location=F.when(remote, "Remote").otherwise(_or(j["location"], "")),
        url=_or(j["url"], ""), description=_or(j["description"], ""),
    )


def _jobicy(j: Column) -> dict[str, Column]:
    return dict(
        job_id=_or(j["id"], ""), title=_or(j["jobTitle"], ""), company=_or(j["companyName"], ""),
        location=_or(j["jobGeo"], "Remote"), url=_or(j["url"], ""),
        description=_or(j["jobDescription"], ""),
    )


def _remoteok_items(payload: Column) -> Column:
    """The first element is a notice without id, and elements need not be objects at all."""
    item = "id string, position string, company string, location string, description string"
    listings = F.transform(F.from_json(payload, "array<string>"), lambda s: F.from_json(s, item))
    return F.filter(listings, lambda j: j["id"].isNotNull())


def _remoteok(j: Column) -> dict[str, Column]:
    return dict(
        job_id=j["id"], title=_or(j["position"], ""), company=_or(j["company"], ""),
        location=_or_empty(j["location"], "Remote"),
        url=F.concat(F.lit("https://remoteok.com/remote-jobs/"), j["id"]),
        description=_or(j["description"], ""),
    )


def _themuse(j: Column) -> dict[str, Column]:
    return dict(
        job_id=_or(j["id"], ""), title=_or(j["name"], ""), company=_or(j["company"]["name"], ""),
        location=_or(F.get(j["locations"], F.lit(0))["name"], "Remote"),
        url=_or(j["refs"]["landing_page"], ""), description=_or(j["contents"], ""),
    )


def _himalayas(j: Column) -> dict[str, Column]:
    places = j["locationRestrictions"]
    return dict(
        job_id=F.coalesce(j["slug"], j["id"], F.lit("")), title=_or(j["title"], ""),
        company=_or(j["companyName"], ""),
        location=F.when(F.size(places) > 0, F.array_join(places, ", ")).otherwise("Remote (Worldwide)"),
        url=F.coalesce(j["applicationLink"], j["url"], F.lit("")),
        description=_or(j["description"], ""),
    )


RSS_TAGS = ["guid", "link", "title", "region", "description"]


def _rss_items(payload: Column) -> Column:
    item = ",".join(f"{tag}:string" for tag in RSS_TAGS)
    return F.from_xml(payload, f"channel struct<item:array<struct<{item}>>>")["channel"]["item"]


def _weworkremotely(j: Column) -> dict[str, Column]:
    tag = {name: strip(_or(j[name], "")) for name in RSS_TAGS}
    named = title_company(tag["title"])
    return dict(
        job_id=F.when(tag["guid"] != "", tag["guid"]).otherwise(tag["link"]),
        title=named["title"], company=named["company"],
        location=_or_empty(tag["region"], "Remote (US-friendly)"), url=tag["link"],
        description=tag["description"],
    )


def _findwork(j: Column) -> dict[str, Column]:
    keywords = F.array_join(F.coalesce(j["keywords"], F.array().cast("array<string>")), ", ")
    return dict(
        job_id=_or(j["id"], ""), title=_or(j["role"], ""), company=_or(j["company_name"], ""),
        location=_or(j["location"], "Remote"), url=_or(j["url"], ""),
        description=F.concat(_or(j["text"], ""), F.lit(" Skills: "), keywords),
    )


def _usajobs(j: Column) -> dict[str, Column]:
    p = j["MatchedObjectDescriptor"]
    summary = p["UserArea"]["Details"]["JobSummary"]
    return dict(
        job_id=_or(p["PositionID"], ""), title=_or(p["PositionTitle"], ""),
        company=_or(p["OrganizationName"], ""),
        location=_or(F.get(p["PositionLocation"], F.lit(0))["LocationName"], "USA"),
        url=_or(p["PositionURI"], ""),
        description=F.concat(_or(p["QualificationSummary"], ""), F.lit(" "), _or(summary, "")),
    )


def _adzuna(j: Column) -> dict[str, Column]:
    return dict(
        job_id=_or(j["id"], ""), title=_or(j["title"], ""),
        company=_or(j["company"]["display_name"], ""), location=_or(j["location"]["display_name"], ""),
        url=_or(j["redirect_url"], ""), description=_or(j["description"], ""),
    )


# --- fixed values: feed names, envelopes, item fields and paging rules, in the order in which
# --- the feeds are joined into one table
FEEDS = {
    "arbeitnow": Feed(
        "Arbeitnow", 0,
        _json("data", "slug:string,title:string,company_name:string,remote:string,location:string,"
                      "url:string,description:string"),
        _arbeitnow, "data", pages_factor=1, stops_when_empty=True),
    "jobicy": Feed(
        "Jobicy", 1,
        _json("jobs", "id:string,jobTitle:string,companyName:string,jobGeo:string,jobDescription:string,url:string"),
        _jobicy, "jobs"),
    "remoteok": Feed("RemoteOK", 2, _remoteok_items, _remoteok),
    "themuse": Feed(
        "The Muse", 3,
        _json("results", "id:string,name:string,company:struct<name:string>,locations:array<struct<name:string>>,"
                         "contents:string,refs:struct<landing_page:string>"),
        _themuse, "results", pages_factor=1, stops_when_empty=True),
    "himalayas": Feed(
        "Himalayas", 4,
        _json("jobs", "slug:string,id:string,title:string,companyName:string,locationRestrictions:array<string>,"
                      "description:string,applicationLink:string,url:string"),
        _himalayas, "jobs", pages_factor=2, stops_when_empty=True),
    "weworkremotely": Feed("We Work Remotely", 5, _rss_items, _weworkremotely),
    "findwork": Feed(
        "Findwork.dev", 6,
        _json("results", "id:string,role:string,company_name:string,location:string,keywords:array<string>,"
                         "text:string,url:string"),
        _findwork, "results", pages_factor=1, follows_next=True, html=False),
    "usajobs": Feed(
        "USAJobs", 7,
        _json("SearchResult.SearchResultItems",
              "MatchedObjectDescriptor:struct<PositionID:string,PositionTitle:string,OrganizationName:string,"
              "PositionLocation:array<struct<LocationName:string>>,QualificationSummary:string,"
              "UserArea:struct<Details:struct<JobSummary:string>>,PositionURI:string>"),
        _usajobs, "SearchResult.SearchResultItems", pages_factor=1, stops_when_empty=True),
    "adzuna": Feed(
        "Adzuna", 8,
        _json("results", "id:string,title:string,company:struct<display_name:string>,"
                         "location:struct<display_name:string>,description:string,redirect_url:string"),
        _adzuna, "results", pages_factor=1, stops_when_empty=True),
}


# feeds fetched by category: the categories in the order in which they are fetched
CATEGORIES = {
    "We Work Remotely": [
        "Programming", "DevOps / Sysadmin", "Design", "Data Science", "Product", "Management & Finance", "All Other Remote",
    ],
}


def term_pos(source: Column, skill: Column, skill_pos: Column) -> Column:
    """Place of the search term in the query, or of the feed category among the feed's categories."""
    place = F
    for name, categories in CATEGORIES.items():
        for k, category in enumerate(categories):
            place = place.when((source == name) & (skill == category), k)
    return F.coalesce(place, skill_pos, F.lit(0))


def fetch_ord(skill_pos: Column, page: Column, pos: Column) -> Column:
    """One number that sorts as (skill_pos, page, pos): 19, 24 and 20 bits; larger values are refused."""
    parts = [(F.coalesce(skill_pos, F.lit(0)).cast("long"), 19), (page.cast("long"), 24), (pos.cast("long"), 20)]
    fits = F.lit(True)
    for value, bits in parts:
        fits = fits & F.coalesce(value.between(0, (1 << bits) - 1), F.lit(True))
    (a, _), (b, _), (c, _) = parts
    joined = F.shiftleft(a, 44).bitwiseOR(F.shiftleft(b, 20)).bitwiseOR(c)
    return F.when(fits, joined).otherwise(F.raise_error(F.lit("skill_pos, page or pos out of range")).cast("long"))


def normalise(landed: DataFrame, *feed_keys: str) -> DataFrame:
    """Listings of the named feeds (of all nine by default) in one pass over the landed pages.

    Unreadable pages give no rows.
    """
    feeds = [FEEDS[key] for key in feed_keys or FEEDS]

    def listing(feed: Feed) -> Column:
        def row(j: Column) -> Column:
            return F.struct(*[value.alias(name) for name, value in feed.fields(j).items()])

        return F.transform(feed.items(F.col("payload")), row)

    listings, source_ord = F, F
    for feed in feeds:
        here = F.col("source") == feed.name
        listings, source_ord = listings.when(here, listing(feed)), source_ord.when(here, feed.ord)
    items = landed.where(F.col("source").isin([f.name for f in feeds])).select(
        "source", source_ord.alias("source_ord"), term_pos(F.col("source"), F.col("skill"), F.col("skill_pos")).alias("skill_pos"),
        "page", F.posexplode(listings).alias("pos", "j")
    )
    plain = F.col("source").isin([f.name for f in FEEDS.values() if not f.html])
    return items.select(
        "source", "source_ord",
        fetch_ord(F.col("skill_pos"), F.col("page"), F.col("pos")).alias("fetch_ord"),
        "j.job_id", "j.title", "j.company", "j.location", "j.url",
        F.when(plain, strip(F.col("j.description"))).otherwise(clean_html(F.col("j.description"))).alias("description"),
    )


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """(category, page, pos, item): the items of landed RSS files, ``path/category=<name>/page=<number>/<any name>``.

    A file is one row of the reader, so its items keep their order; unreadable files give no rows.
    """
    item = ", ".join(f"{tag}: string" for tag in RSS_TAGS)
    pages = spark.read.format("xml").option("rowTag", "channel").schema(
        f"item array<struct<{item}>>, category string, page int"
    ).load(path)
    return pages.select("category", "page", F.posexplode("item").alias("pos", "item"))


def rss_listings(items: DataFrame) -> DataFrame:
    """Listings of ``read_rss`` rows, in the order in which the categories are fetched."""
    feed = FEEDS["weworkremotely"]
    source = F.lit(feed.name)
    fields = {name: value for name, value in feed.fields(F.col("item")).items()}
    place = term_pos(source, F.col("category"), F.lit(None).cast("int"))
    return items.select(
        source.alias("source"), F.lit(feed.ord).alias("source_ord"), fetch_ord(place, F.col("page"), F.col("pos")).alias("fetch_ord"),
        *(fields[c].alias(c) for c in ("job_id", "title", "company", "location", "url")),
        clean_html(fields["description"]).alias("description"),
    )

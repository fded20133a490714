"""The entities of the engine, derived from the given tables by Spark."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentspark.functions import patterns as P
from talentspark.operators.entities import entity_table, gazetteer_spans
from talentspark.session import spread
from talentspark.sources.feeds import FEEDS

# a query list: plain words, a phrase, an inner-symbol and a symbol-edged name, and a copy
SKILLS = ["the", "tion", "of the", "Der", "an", ".example", "ex-la", "the"]
GAZETTEER = [
    ("PERSON", "the"), ("PERSON", "le"), ("GPE", "der"), ("LOC", "los"), ("ORG", "with"), ("ORG", "von"),
]
SKILL_GAZETTEER = [("software", "with"), ("skill", "von"), ("technical concept", "les"), ("education", "por")]
MODEL_SCORES = {"software": 0.9, "skill": 0.8, "technical concept": 0.5, "education": 0.9}
PAGE_SIZE = 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "documents"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with title (the <title> element) and company (the host)."""
    return spread(load(spark, sf_dir, "pages")).select(
        "page_id", "url", "html",
        F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("company"),
    )


# One item of each feed's payload, from a row of ``pages`` with ``id`` and ``v`` = page_id % 4;
# null fields are left out of the JSON text.
ITEMS = {
    "arbeitnow": """named_struct('slug', concat('job-', id), 'title', title, 'company_name', company,
        'remote', if(v = 2, null, v = 0), 'location', case v when 1 then 'Berlin' when 2 then 'Paris' end,
        'url', url, 'description', html)""",
    "jobicy": """named_struct('id', id, 'jobTitle', title, 'companyName', company,
        'jobGeo', if(v = 3, null, concat('Geo', v)), 'jobDescription', html, 'url', url)""",
    "remoteok": """named_struct('id', id, 'position', title, 'company', company,
        'location', case v when 0 then '' when 1 then null else 'Lisbon' end, 'description', html)""",
    "themuse": """named_struct('id', id, 'name', title, 'company', named_struct('name', company),
        'locations', case v when 0 then array() when 1 then null when 2 then array(named_struct('name', 'Oslo'))
            else array(named_struct('name', 'Rome'), named_struct('name', 'Bonn')) end,
        'contents', html, 'refs', named_struct('landing_page', url))""",
    "himalayas": """named_struct('slug', if(v = 0, null, concat('job-', id)), 'id', id, 'title', title,
        'companyName', company, 'locationRestrictions',
        case v when 1 then array() when 2 then array('Peru', 'Chile') when 3 then array('Cuba') end,
        'description', html, 'applicationLink', if(v = 1, null, concat(url, '#apply')), 'url', url)""",
    "weworkremotely": """concat('<item><guid isPermaLink="false">', if(v = 0, '', concat('g-', id)), '</guid><link>',
        id, '/link</link><title><![CDATA[ ', if(v = 1, title, concat(company, ': ', title, if(v = 2, ': II', ''))),
        ' ]]></title><region>', if(v = 2, '', 'Anywhere'), '</region><description><![CDATA[', html,
        ']]></description></item>')""",
    "findwork": """named_struct('id', id, 'role', title, 'company_name', company,
        'location', if(v = 1, null, 'Quito'), 'keywords', if(v = 0, null, array('k', concat('v', v))),
        'text', html, 'url', url)""",
    "usajobs": """named_struct('MatchedObjectDescriptor', named_struct('PositionID', id, 'PositionTitle', title,
        'OrganizationName', company, 'PositionLocation', case v when 0 then array() when 1 then null
            else array(named_struct('LocationName', 'Austin')) end,
        'QualificationSummary', if(v = 3, null, concat('<b>', title, '</b>')),
        'UserArea', if(v = 2, null, named_struct('Details', named_struct('JobSummary', html))), 'PositionURI', url))""",
    "adzuna": """named_struct('id', id, 'title', title, 'company', named_struct('display_name', company),
        'location', if(v = 1, null, named_struct('display_name', 'Utah')), 'description', html, 'redirect_url', url)""",
}
# what stands before and after the comma-joined items of a page
ENVELOPES = {
    "arbeitnow": ('{"data":[', "]}"),
    "jobicy": ('{"jobs":[', "]}"),
    "remoteok": ('[{"legal":"notice"},', "]"),
    "themuse": ('{"results":[', "]}"),
    "himalayas": ('{"jobs":[', "]}"),
    "weworkremotely": ('<rss version="2.0"><channel><title>Feed</title>', "</channel></rss>"),
    "findwork": ('{"results":[', '],"next":"more"}'),
    "usajobs": ('{"SearchResult":{"SearchResultItems":[', "]}}"),
    "adzuna": ('{"results":[', "]}"),
}


def _land(rows: DataFrame) -> DataFrame:
    """Landed pages from rows (feed, seq, id, v, title, company, url, html): per feed, pages of
    ``PAGE_SIZE`` items, numbered from 1, in the order of ``seq``."""
    def per_feed(value) -> Column:
        chosen = F
        for key, feed in FEEDS.items():
            chosen = chosen.when(F.col("source") == feed.name, value(key))
        return chosen

    def item(key: str) -> Column:
        built = F.expr(ITEMS[key])
        return built if key == "weworkremotely" else F.to_json(built)

    paged = rows.select(
        "source", (F.floor(F.col("seq") / PAGE_SIZE) + 1).cast("int").alias("page"),
        F.struct("seq", per_feed(item).alias("item")).alias("entry"),
    )
    items = F.sort_array(F.collect_list("entry"))["item"]
    grouped = paged.groupBy("source", "page").agg(items.alias("items"))
    joined = F.when(F.col("source") == FEEDS["weworkremotely"].name, F.array_join("items", "")).otherwise(
        F.array_join("items", ",")
    )
    payload = F.concat(
        per_feed(lambda key: F.lit(ENVELOPES[key][0])), joined, per_feed(lambda key: F.lit(ENVELOPES[key][1]))
    )
    return grouped.select(
        "source", F.lit("any").alias("skill"), F.lit(0).alias("skill_pos"), "page", payload.alias("payload")
    )


def _listing_rows(spark: SparkSession, sf_dir: str, source: Column, seq: Column, job_id: Column) -> DataFrame:
    return pages(spark, sf_dir).select(
        source.alias("source"), seq.alias("seq"), job_id.cast("string").alias("id"),
        (F.col("page_id") % 4).alias("v"), "title", "company", "url", "html",
    )


def landed_feed(spark: SparkSession, sf_dir: str, feed_key: str) -> DataFrame:
    """All rows of ``pages`` as listings of one feed."""
    key = F.col("page_id")
    return _land(_listing_rows(spark, sf_dir, F.lit(FEEDS[feed_key].name), key, key))


def landed_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``pages``, dealt out to the nine feeds; two neighbours of a feed share an id."""
    names = F.array(*[F.lit(feed.name) for feed in FEEDS.values()])
    source = F.get(names, (F.col("page_id") % len(FEEDS)).cast("int"))
    seq = F.floor(F.col("page_id") / len(FEEDS))
    return _land(_listing_rows(spark, sf_dir, source, seq, F.floor(seq / 2)))


def landed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of an order as a landed page: the order is the search term, the line number the
    page; untaxed lines stand for empty pages, fully taxed ones for failed requests."""
    names = F.array(*[F.lit(f.name) for f in FEEDS.values()])
    path = F.create_map(*[F.lit(x) for f in FEEDS.values() for x in (f.name, f.envelope or "none")])
    key = F.regexp_extract(path[F.col("source")], r"([A-Za-z]+)\z", 1)
    items = F.when(F.col("l_tax") == 0, "[]").otherwise('[{"id":1}]')
    nested = F.when(F.col("source") == "USAJobs", F.concat(F.lit('{"SearchResult":{"SearchResultItems":'), items, F.lit("}}")))
    plain = F.concat(
        F.lit('{"'), key, F.lit('":'), items,
        F.when(F.col("l_returnflag") == "R", "").otherwise(',"next":"more"'), F.lit("}"),
    )
    payload = F.when(F.col("l_tax") == 0.08, "<error>").otherwise(F.coalesce(nested, plain))
    return spread(load(spark, sf_dir, "lineitem")).select(
        F.get(names, (F.col("l_orderkey") % len(FEEDS)).cast("int")).alias("source"), "l_orderkey", "l_linenumber",
        "l_tax", "l_returnflag",
    ).select(
        "source", F.col("l_orderkey").cast("string").alias("skill"), F.lit(0).alias("skill_pos"),
        F.col("l_linenumber").alias("page"), payload.alias("payload"),
    )


def document_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as listings: the feed is ``source``, the title the first 12 characters, the
    company the language; two neighbours share an id."""
    return documents(spark, sf_dir).select(
        "source", F.regexp_extract("source", r"(\d+)", 1).cast("int").alias("source_ord"),
        F.col("doc_id").alias("fetch_ord"), F.floor(F.col("doc_id") / 40).cast("string").alias("job_id"),
        F.substring("text", 1, 12).alias("title"), F.col("lang").alias("company"),
        F.concat(F.lit("In "), F.col("lang")).alias("location"),
        F.concat(F.lit("https://jobs.example.com/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("text").alias("description"),
    )


def event_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as scored listings; ids come from the JSON properties, every third one is missing."""
    return load(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"),
        F.when(F.col("event_id") % 3 == 0, "").otherwise(F.get_json_object("props", "$.k")).alias("job_id"),
        F.col("event_id").alias("fetch_ord"), (F.floor("value") % 4).cast("int").alias("skills_matched"),
    )


def part_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as scored jobs with many equal (title, company) pairs, some of them missing."""
    return load(spark, sf_dir, "part").select(
        F.when(F.col("p_type") != "PROMO", F.col("p_name")).alias("title"), F.col("p_brand").alias("company"),
        F.col("p_type").alias("location"), F.col("p_size").alias("skills_matched"),
        F.col("p_name").alias("matched_skills"), (F.col("p_partkey") % 3).cast("int").alias("source_ord"),
        F.col("p_partkey").alias("fetch_ord"),
    )


def resumes_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as labelled resumes: every second raw category by source number, written in
    lower case (and so unknown) for Spanish texts."""
    raw = F.array(*[F.lit(r) for r, _ in P.CATEGORY_PAIRS])
    number = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    category = F.get(raw, number * 2)
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("resume_id"),
        F.when(F.col("lang") == "es", F.lower(category)).otherwise(category).alias("Category"),
        F.col("text").alias("Text"),
    )


_LOWER = "abcdefghijklmnopqrstuvwxyz"


def _benchmark_runs(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """(row_no, w): all words of each benchmark text in runs of ``size`` words, the last one shorter."""
    words = load(spark, sf_dir, "benchmark").select(
        "item_id", F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)).alias("w")
    ).where(F.size("w") > 0)
    runs = F.expr(f"transform(sequence(0, (size(w) - 1) div {size}), g -> slice(w, int(g) * {size} + 1, {size}))")
    return words.select("item_id", F.posexplode(runs).alias("g", "w")).select((F.col("item_id") * 1000 + F.col("g")).alias("row_no"), "w")


def esco(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A skill vocabulary from all words of benchmark, seven a row: words 1-2 as the preferred label; word 3,
    words 4-6 and word 7 as alternatives, none for every fifth row."""
    alts = F.concat_ws(
        "\n", F.get("w", F.lit(2)), F.array_join(F.slice("w", 4, 3), " "), F.lit(" "),
        F.concat(F.lit(" "), F.translate(F.get("w", F.lit(6)), _LOWER, _LOWER.upper()), F.lit(" ")),
    )
    return _benchmark_runs(spark, sf_dir, 7).select(
        "row_no", F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("preferredLabel"),
        F.when(F.col("row_no") % 5 != 0, alts).alias("altLabels"),
    )


def tech_terms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(terms, organisation spans): "brand name" terms, the brand being the organisation."""
    rows = load(spark, sf_dir, "part").select(
        F.lower(F.concat_ws(" ", "p_brand", "p_name")).alias("term"), F.length("p_brand").alias("end")
    ).distinct()
    return rows.select("term").distinct(), rows.select("term", F.lit(0).alias("start"), "end")


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long skill list from all words of benchmark, six a time: words 1-2, word 3, ".word 4" and "word 5, word 6"."""
    terms = F.array(
        F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1))), F.get("w", F.lit(2)),
        F.concat(F.lit("."), F.get("w", F.lit(3))), F.concat(F.get("w", F.lit(4)), F.lit(", "), F.get("w", F.lit(5))),
    )
    return _benchmark_runs(spark, sf_dir, 6).select("row_no", F.posexplode(terms).alias("i", "skill")).where("skill IS NOT NULL").select(
        (F.col("row_no") * 4 + F.col("i")).cast("int").alias("pos"), "skill"
    )


def model_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of the documents as a skill model would report them, with a score per label."""
    scores = F.create_map(*[F.lit(x) for label, s in MODEL_SCORES.items() for x in (label, s)])
    found = entity_table(documents(spark, sf_dir), "doc_id", gazetteer_spans(F.col("text"), SKILL_GAZETTEER))
    return found.withColumn("score", scores[F.col("label")])


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings with the scores of classes 0-9: class c sums the dimensions i with i mod 10 = c."""
    scores = F.expr(
        "transform(sequence(0, 9), c -> aggregate(filter(embedding, (x, i) -> i % 10 = c), 0D, (t, x) -> t + double(x)))"
    )
    return load(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", scores.alias("scores"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for lang, mime in zip(
        ["en", "fr", "de"], P.ACCEPTED_TYPES.values()) for x in (lang, mime)])
    return load(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(kinds[F.col("lang")], F.lit("text/plain")).alias("mime")
    )


def messy_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with the text missing for toxic rows and blank for low-quality ones."""
    labels = load(spark, sf_dir, "labels")
    blank = F.when(F.col("toxic") == 1, None).when(F.col("quality") == 0, "  \t\n").otherwise(F.col("text"))
    return load(spark, sf_dir, "documents").join(labels, "doc_id", "left").select("doc_id", blank.alias("text"))

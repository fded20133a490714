"""Scoring, row building, deduplication, ranking and summaries of job listings."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentspark.functions import patterns as P
from talentspark.functions.text import has_whole_word, sanitize_filename
from talentspark.operators.grams import skill_table, whole_word_hits

# up to this many skills each is tested as a literal; longer lists go through an n-gram join
MAX_LITERALS = 50

JOB_COLUMNS = [
    "source", "job_id", "title", "company", "location", "url",
    "skills_matched", "matched_skills", "description_file",
]


def score_jobs(
    listings: DataFrame, skills: list[str], title: str = "title", description: str = "description",
    key: tuple[str, ...] = ("source", "fetch_ord"),
) -> DataFrame:
    """Add ``skills_matched`` and ``matched_skills`` (names in query order, comma-joined).

    A skill counts when it occurs as a whole word in title or description, ignoring case; a
    name given twice counts twice. ``key`` names rows; rows that share it are told apart by their texts.
    """
    if len(skills) > MAX_LITERALS:
        return _score_by_join(listings, skills, title, description, key)
    hit = [f"_hit{i}" for i in range(len(skills))]
    scored = listings.withColumn("_text", _search_text(title, description))
    scored = scored.select("*", *[has_whole_word(F.col("_text"), s).alias(h) for s, h in zip(skills, hit)])
    count = sum((F.col(h).cast("int") for h in hit), F.lit(0))
    names = F.concat_ws(", ", *[F.when(F.col(h), F.lit(s)) for s, h in zip(skills, hit)])
    # Generated columns keep a later score filter above this point; pushed below the
    # projection it would run every pattern a second time.
    return scored.select(
        *listings.columns,
        F.inline(F.array(F.struct(count.alias("skills_matched"), names.alias("matched_skills")))),
    )


def _search_text(title: str, description: str) -> Column:
    empty = F.lit("")
    return F.lower(F.concat(F.coalesce(title, empty), F.lit(" "), F.coalesce(description, empty)))


def _score_by_join(listings, skills, title, description, key) -> DataFrame:
    # rows of one key and text have the same hits, which the set below takes once
    keyed = listings.withColumn("_key", F.struct(*key, F.sha2(_search_text(title, description), 256).alias("_digest")))
    texts = keyed.select("_key", _search_text(title, description).alias("_text"))
    hits = whole_word_hits(texts, "_key", "_text", skill_table(listings.sparkSession, skills))
    per_job = hits.groupBy("_key").agg(
        F.sort_array(F.collect_set(F.struct("pos", "skill"))).alias("_hits"),
    )
    scored = keyed.join(per_job, "_key", "left")
    return scored.select(
        *listings.columns,
        F.when(F.col("_hits").isNull(), 0).otherwise(F.size("_hits")).alias("skills_matched"),
        F.coalesce(F.array_join(F.col("_hits.skill"), ", "), F.lit("")).alias("matched_skills"),
    )


def file_name(source: Column, job_id: Column, title: Column) -> Column:
    key = F.concat(F.replace(F.lower(source), F.lit(" "), F.lit("_")), F.lit("_"), job_id)
    return F.concat(sanitize_filename(key), F.lit("_"), sanitize_filename(title), F.lit(".txt"))


def with_description_file(scored: DataFrame) -> DataFrame:
    name = file_name(F.col("source"), F.col("job_id"), F.col("title"))
    return scored.withColumn("description_file", F.concat(F.lit(P.DESCRIPTION_DIR + "/"), name))


def build_rows(scored: DataFrame) -> DataFrame:
    """Matching listings in the nine output columns."""
    return with_description_file(scored.where("skills_matched > 0")).select(*JOB_COLUMNS)


def descriptions(scored: DataFrame) -> DataFrame:
    """(source, file_name, content): the text document of each matching listing."""
    matched = F.coalesce(F.nullif("matched_skills", F.lit("")), F.lit(P.NO_SKILLS))
    values = {"title": F.col("title"), "company": F.col("company"), "location": F.col("location"), "matched_skills": matched}
    head = [F.concat(F.lit(label), values[name]) for name, label in P.DESCRIPTION_LABELS.items()]
    lines = F.array(*head, F.lit(P.DESCRIPTION_RULE), F.lit(""), F.col("description"), F.lit(""))
    content = F.array_join(lines, "\n")
    name = file_name(F.col("source"), F.col("job_id"), F.col("title"))
    return scored.where("skills_matched > 0").select("source", name.alias("file_name"), content.alias("content"))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. Spark limits each key to one row per task before the
    shuffle (WindowGroupLimit), so a key with a third of all rows stays cheap."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def uid_dedup(scored: DataFrame) -> DataFrame:
    """Per source the first matching listing of each id, in fetch order."""
    return first_per_key(scored.where("skills_matched > 0"), ["source", "job_id"], [F.col("fetch_ord")])


def best_first() -> list[Column]:
    return [F.desc("skills_matched"), F.asc("source_ord"), F.asc("fetch_ord")]


def title_company_dedup(jobs: DataFrame) -> DataFrame:
    """The best-ranked listing of each (title, company); missing values are equal."""
    return first_per_key(jobs, ["title", "company"], best_first())


def rank_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(*best_first())


def top_jobs(jobs: DataFrame, n: int = 10) -> DataFrame:
    return rank_jobs(jobs).limit(n).select("title", "company", "location", "skills_matched", "matched_skills")


def jobs_total(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count(F.lit(1)).alias("total"))


def _with_bar(counts: DataFrame) -> DataFrame:
    return counts.withColumn("bar", F.least("n", F.lit(40)))


def jobs_by_source(jobs: DataFrame) -> DataFrame:
    return _with_bar(jobs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))).orderBy(F.desc("n"), "source")


def score_distribution(jobs: DataFrame) -> DataFrame:
    return _with_bar(jobs.groupBy("skills_matched").agg(F.count(F.lit(1)).alias("n"))).orderBy(F.desc("skills_matched"))


def matches_per_source(matching: DataFrame) -> DataFrame:
    """Matching jobs per feed, before the duplicates across feeds are dropped."""
    return matching.groupBy("source").agg(F.count(F.lit(1)).alias("n"))

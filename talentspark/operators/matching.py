"""Keyword match scores of resumes and jobs."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentspark.functions import patterns as P
from talentspark.functions.text import keyword_tokens, match_band, percent_half_up
from talentspark.operators.joins import lookup_join, skew_join
from talentspark.session import settle, settle_table


def keyword_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, words): the distinct keywords of each text, sorted."""
    return docs.select(id_col, F.array_sort(keyword_tokens(F.col(text_col))).alias("words"))


def score_pairs(requests: DataFrame, resumes: DataFrame, jobs: DataFrame) -> DataFrame:
    """Score the requested (resume_id, job_id) pairs: share of the job's keywords that the
    resume has, 0-100, and its band. ``resumes`` and ``jobs`` are keyword sets; one popular
    resume or job may hold most of the requests."""
    sided = skew_join(
        requests, resumes.select("resume_id", F.col("words").alias("_r")), ["resume_id"], "inner",
        ["resume_id", "job_id"],
    )
    sided = skew_join(
        sided, jobs.select("job_id", F.col("words").alias("_j")), ["job_id"], "inner", ["resume_id", "job_id"]
    )
    score = percent_half_up(F.size(F.array_intersect("_j", "_r")), F.size("_j"))
    return sided.select("resume_id", "job_id", score.alias("score")).withColumn("band", match_band(F.col("score")))


def match_pairs(
    resumes: DataFrame, jobs: DataFrame, top_k: int = 10, min_score: int = P.GREAT_MATCH_SCORE
) -> DataFrame:
    """The best jobs of each resume: (resume_id, job_id, score, rank), score >= ``min_score``.

    ``resumes`` (resume_id, words) and ``jobs`` (job_id, words) are keyword sets. The result
    is exact; what keeps it from comparing all pairs:

    * equal keyword sets are scored once, so copies cost nothing extra;
    * a job of n words needs ``need`` common words, so a match must contain one of its
      n - need + 1 rarest words - only those are joined, and they are the words that few
      resumes have;
    * each surviving candidate is scored on the full sets.
    """
    if not 1 <= min_score <= 100:
        raise ValueError("min_score must be between 1 and 100")
    set_key = F.md5(F.array_join("words", " "))
    # empty sets are dropped on reading: a filter here would extract the keywords twice
    resume_sets = settle_table(resumes.select("resume_id", "words", set_key.alias("r")), "resume-keywords").where(
        F.size("words") > 0
    )
    job_sets = settle_table(jobs.select("job_id", "words", set_key.alias("j")), "job-keywords").where(
        F.size("words") > 0
    )
    r_sets = resume_sets.select("r", "words").dropDuplicates(["r"])
    j_sets = job_sets.select("j", "words").dropDuplicates(["j"])

    # words that no job asks for count towards no score
    asked = settle_table(j_sets.select(F.explode("words").alias("word")).distinct(), "job-words")
    r_words = lookup_join(
        r_sets.select("r", F.size("words").alias("_size"), F.explode("words").alias("word")), asked, ["word"], "left_semi",
        ["r", "word"],
    )
    frequency = settle_table(r_words.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "keyword-counts")
    n = F.size("words")
    need = F.greatest(F.ceil(n * (min_score - 0.5) / 100 - 1e-9), F.lit(1)).cast("int")
    j_words = j_sets.select("j", n.alias("n"), need.alias("need"), F.explode("words").alias("word"))
    rarest = (
        lookup_join(j_words, frequency, ["word"], "left", ["j", "word"])
        .groupBy("j", "n", "need")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word"))).alias("_w"))
        .select("j", "need", F.inline(F.slice("_w", F.lit(1), F.col("n") - F.col("need") + 1)))
        .where("df > 0").select("j", "need", "word")
    )
    candidates = (
        lookup_join(r_words, settle_table(rarest, "rare-keywords"), ["word"], "inner", ["r", "word"])
        .where(F.col("_size") >= F.col("need")).select("r", "j").distinct()
    )
    with_resume = candidates.join(r_sets.withColumnRenamed("words", "_r"), "r")
    with_both = lookup_join(with_resume, j_sets.withColumnRenamed("words", "_j"), ["j"], "inner", ["r", "j"])
    scored = with_both.select(
        "r", "j", percent_half_up(F.size(F.array_intersect("_j", "_r")), F.size("_j")).alias("score")
    ).where(F.col("score") >= min_score)

    # of equal jobs no more than top_k can be reported per resume
    copy_no = F.row_number().over(Window.partitionBy("j").orderBy("job_id"))
    members = job_sets.select("j", "job_id").withColumn("_n", copy_no).where(F.col("_n") <= top_k).drop("_n")
    best = F.row_number().over(Window.partitionBy("r").orderBy(F.desc("score"), "job_id"))
    # a short job that most resumes match is one key here
    named = skew_join(settle_table(scored, "scored-sets"), members, ["j"], "inner", ["r"])
    top = named.withColumn("rank", best).where(F.col("rank") <= top_k)
    return skew_join(resume_sets.select("resume_id", "r"), top, ["r"], "inner", ["resume_id"]).select(
        "resume_id", "job_id", "score", "rank"
    )

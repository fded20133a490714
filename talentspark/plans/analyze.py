"""Resume and job analysis: the two analysis requests as table jobs."""

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentspark.functions.redact import redact_serving, redact_spans
from talentspark.functions.scores import top_k_classes
from talentspark.functions.text import is_blank, text_sanitize
from talentspark.operators import entities as E
from talentspark.operators import grams
from talentspark.operators.learning import classes_of, decision_scores


def validate(df: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects with ``reason``): missing or blank texts do not stop a job."""
    text = F.col(text_col)
    reason = F.when(text.isNull(), "null").when(is_blank(text), "blank")
    checked = df.withColumn("reason", reason)
    return checked.where("reason is null").drop("reason"), checked.where("reason is not null")


def _reason(id_col: str, text_col: str) -> Column:
    text = F.col(text_col)
    return F.when(F.col(id_col).isNull(), "null id").when(text.isNull(), "null").when(is_blank(text), "blank")


def statuses(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, status) of every row: ``answered`` by the analyses, or why not (``null id``, ``null``, ``blank``)."""
    return df.select(id_col, F.coalesce(_reason(id_col, text_col), F.lit("answered")).alias("status"))


def rejects(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows that the analyses leave unanswered, as they came, with ``reason``."""
    return df.withColumn("reason", _reason(id_col, text_col)).where("reason is not null")


def _skill_maps(skills: DataFrame, id_col: str) -> DataFrame:
    """Per text a map skill -> struct<unit,start,end>; a group is one text's distinct skills."""
    entry = F.struct("skill", F.struct("unit", "start", "end"))
    return skills.groupBy(id_col).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("skills"))


def extract_skills(
    docs: DataFrame, id_col: str, text_col: str, lex: grams.Lexicon,
    entities: DataFrame | None = None,
) -> DataFrame:
    """(id, skill, unit, start, end): dictionary skills, plus model-found ones where given."""
    found = grams.first_spans(grams.phrase_match(docs, id_col, text_col, lex), id_col)
    if entities is None:
        return found.select(id_col, "skill", F.lit("token").alias("unit"), "start", "end")
    return E.merge_model_skills(found, entities, lex, id_col)


def _placed(clean: DataFrame, id_col: str) -> DataFrame:
    """Texts placed by id once; the skill groups and the join with them need no other shuffle.

    The join would drop missing ids on one side only, which would keep Spark from sharing the
    shuffle between the two sides, so they are dropped here.
    """
    return clean.where(F.col(id_col).isNotNull()).repartition(F.col(id_col))


def _with_skills(docs: DataFrame, id_col: str, skills: DataFrame) -> DataFrame:
    none = F.create_map().cast("map<string,struct<unit:string,start:int,end:int>>")
    joined = docs.join(_skill_maps(skills, id_col), id_col, "left")
    return joined.withColumn("skills", F.coalesce("skills", none)).withColumn("education", F.lit(""))


def analyze_jobs(
    jobs: DataFrame, id_col: str, text_col: str, lex: grams.Lexicon,
    entities: DataFrame | None = None,
) -> DataFrame:
    """(id, cleaned_job_desc, skills, education); the other rows are those of ``rejects``."""
    good, _ = validate(jobs.select(id_col, text_col), text_col)
    clean = _placed(good.select(id_col, text_sanitize(F.col(text_col)).alias("cleaned_job_desc")), id_col)
    return _with_skills(
        clean, id_col, extract_skills(clean, id_col, "cleaned_job_desc", lex, entities)
    )


def categories(df: DataFrame, model: PipelineModel, top_k: int = 2, embed=None) -> DataFrame:
    """Add ``categories`` (best first) to a frame with a column ``text``.

    ``embed`` (text column -> array<float>) stands in for a model without text stages.
    """
    given = df if embed is None else df.withColumn("features", array_to_vector(embed(F.col("text"))))
    predicted = model.transform(given)
    return predicted.select(
        *df.columns, top_k_classes(decision_scores(predicted), classes_of(model), top_k).alias("categories")
    )


def _redacted(df: DataFrame, from_col: str, to_col: str, entity_spans, labels=None, known=None) -> DataFrame:
    """Redaction by pattern, then of the entities that ``entity_spans`` (text column -> spans
    column) finds in the redacted text. ``labels`` are those to redact, ``known`` those that it can find."""
    clean = df.withColumn(to_col, redact_serving(F.col(from_col)))
    if entity_spans is None:
        return clean
    text = F.col(to_col)
    return clean.withColumn(to_col, redact_spans(text, entity_spans(text), labels, known))


def clean_resumes(resumes: DataFrame, id_col: str, text_col: str, entity_spans=None, labels=None, known=None) -> DataFrame:
    """(id, cleaned_resume); the other rows are those of ``rejects``. Labels that are not ``known`` are refused."""
    good, _ = validate(resumes.select(id_col, text_col), text_col)
    return _redacted(good, text_col, "cleaned_resume", entity_spans, labels, known).select(id_col, "cleaned_resume")


def classify_resumes(
    resumes: DataFrame, id_col: str, text_col: str, model: PipelineModel, top_k: int = 2, entity_spans=None, embed=None,
    labels=None, known=None,
) -> DataFrame:
    """(id, categories): clean, embed, score, keep the best classes."""
    cleaned = clean_resumes(resumes, id_col, text_col, entity_spans, labels, known).withColumnRenamed("cleaned_resume", "text")
    return categories(cleaned, model, top_k, embed).select(id_col, "categories")


def analyze_resumes(
    resumes: DataFrame, id_col: str, text_col: str, model: PipelineModel, lex: grams.Lexicon, top_k: int = 2,
    entity_spans=None, entities: DataFrame | None = None, embed=None, labels=None, known=None,
) -> DataFrame:
    """(id, cleaned_resume, education, categories, skills).

    The classifier cleans its input itself, so it sees the text cleaned twice (``[EMAIL]``
    has become ``EMAIL``), while skills come from the text cleaned once.
    """
    clean = _placed(clean_resumes(resumes, id_col, text_col, entity_spans, labels, known), id_col)
    skills = extract_skills(clean, id_col, "cleaned_resume", lex, entities)
    twice = _redacted(clean, "cleaned_resume", "text", entity_spans, labels, known)
    return _with_skills(categories(twice, model, top_k, embed).drop("text"), id_col, skills)

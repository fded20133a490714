"""Readers and writers of dataset, vocabulary, dictionary and result files."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentspark.functions import patterns as P
from talentspark.functions.text import upload_status
from talentspark.operators.dictionary import vocab_distinct
from talentspark.operators.jobs import rank_jobs

# quoted fields may hold line breaks, quotes and blanks at their ends
CSV = {
    "header": True, "multiLine": True, "quote": '"', "escape": '"',
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def scan_labelled_csv(spark: SparkSession, path: str, schema: str = "Category string, Text string") -> DataFrame:
    """Labelled texts; ``path`` may be a file, a folder or a glob, whose files are concatenated."""
    return spark.read.options(**CSV).schema(schema).csv(path)


def scan_vocab_tsv(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Distinct cleaned terms of one column of a tab-separated vocabulary."""
    return vocab_distinct(spark.read.options(sep="\t", header=True, quote="").csv(path), column)


def scan_skill_map(spark: SparkSession, path: str) -> DataFrame:
    """(phrase, preferred) of a dictionary: JSON rows as ``sink_skill_map`` writes them, which are read
    in splits, or one JSON object phrase -> preferred per file. Anything else raises."""
    try:
        rows = spark.read.schema("phrase string, preferred string").json(path)
        files = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"no dictionary at {path}") from e
        raise
    both = F.col("phrase").isNotNull() & F.col("preferred").isNotNull()
    lines, whole = rows.agg(F.count(F.lit(1)), F.count_if(both)).first()
    if whole and whole == lines:
        return rows
    if whole:
        raise ValueError(f"{lines - whole} of {lines} rows of {path} lack a phrase or its preferred name")
    pairs = F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})
    return files.select(F.explode(pairs).alias("phrase", "preferred"))


def scan_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, mime, status) of uploaded files by their extension; contents are not read."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)\z", 1))
    mime = F
    for name, kind in P.ACCEPTED_TYPES.items():
        mime = mime.when(ext == name, kind)
    return spark.read.format("binaryFile").load(path).select(
        "path", mime.otherwise("application/octet-stream").alias("mime")
    ).withColumn("status", upload_status(F.col("mime")))


def sink_jobs_csv(jobs: DataFrame, path: str) -> None:
    """Ranked jobs; part files hold consecutive ranges of the ranking."""
    rank_jobs(jobs).drop("source_ord", "fetch_ord", "description").write.mode("errorifexists").options(
        **CSV
    ).csv(path)


def sink_descriptions(documents: DataFrame, path: str) -> None:
    """(source, file_name, content) as a table, one folder per source, instead of one small
    file per job."""
    documents.write.partitionBy("source").parquet(path)


def sink_skill_map(dictionary: DataFrame, path: str) -> None:
    """The dictionary as JSON rows, for ``scan_skill_map``."""
    dictionary.select("phrase", "preferred").write.json(path)


def sink_dataset_csv(dataset: DataFrame, path: str) -> None:
    dataset.write.options(**CSV, quoteAll=True).csv(path)

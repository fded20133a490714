"""The skill dictionary: four vocabularies folded into phrase -> preferred label."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentspark.functions.text import strip
from talentspark.operators.jobs import first_per_key


def vocab_distinct(vocab: DataFrame, column: str) -> DataFrame:
    """Distinct lower-cased, trimmed terms."""
    return vocab.select(strip(F.lower(column)).alias("term")).where(F.col("term").isNotNull()).distinct()


def esco_entries(esco: DataFrame) -> DataFrame:
    """(phrase, preferred, seq) of a table (row_no, preferredLabel, altLabels).

    Each preferred label maps to itself, each non-blank line of the alternatives to it;
    ``seq`` is (row_no, position in the row).
    """
    preferred = strip(F.lower("preferredLabel"))
    alts = F.transform(F.split(F.coalesce("altLabels", F.lit("")), "\n"), lambda a: F.lower(strip(a)))
    entries = F.concat(F.array(preferred), F.filter(alts, lambda a: a != ""))
    return (
        esco.where(F.col("preferredLabel").isNotNull())
        .select("row_no", preferred.alias("preferred"), F.posexplode(entries).alias("pos", "phrase"))
        .select("phrase", "preferred", F.struct("row_no", "pos").alias("seq"))
    )


def strip_organisation(tech: DataFrame, org_spans: DataFrame) -> DataFrame:
    """(phrase, preferred): each technology term without its right-most organisation name.

    ``org_spans``: (term, start, end) in characters. Terms without a span, or with nothing
    left, map to themselves.
    """
    last = org_spans.groupBy("term").agg(F.max(F.struct("start", "end")).alias("_org"))
    term = F.col("term")
    kept = F.concat(
        F.substring(term, F.lit(1), F.col("_org.start")),
        F.substring(term, F.col("_org.end") + 1, F.length(term)),
    )
    return tech.join(last, "term", "left").select(
        term.alias("phrase"), F.coalesce(F.nullif(strip(kept), F.lit("")), term).alias("preferred")
    )


def skill_dictionary(
    esco: DataFrame, skills: DataFrame, knowledge: DataFrame, tech: DataFrame, org_spans: DataFrame
) -> DataFrame:
    """(phrase, preferred), one row per phrase.

    The last writer wins among the ESCO rows; the later vocabularies only add what is missing,
    in the order skills, knowledge, technology. ``skills``, ``knowledge`` and ``tech`` hold
    one column ``term``, cleaned by ``vocab_distinct``.
    """
    last = (
        esco_entries(esco).groupBy("phrase").agg(F.max_by("preferred", "seq").alias("preferred"))
        .withColumn("prio", F.lit(0))
    )
    own = F.col("term").alias("phrase"), F.col("term").alias("preferred")
    added = (
        skills.select(*own, F.lit(1).alias("prio"))
        .unionByName(knowledge.select(*own, F.lit(2).alias("prio")))
        .unionByName(strip_organisation(tech, org_spans).withColumn("prio", F.lit(3)))
    )
    return first_per_key(last.unionByName(added), ["phrase"], [F.col("prio")]).select("phrase", "preferred")

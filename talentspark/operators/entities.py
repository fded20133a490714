"""Named entities: providers, redaction joins and the merge with dictionary skills."""

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentspark.functions import patterns as P
from talentspark.functions.redact import redact_spans, wanted_labels
from talentspark.functions.text import strip
from talentspark.operators.grams import Lexicon
from talentspark.operators.jobs import first_per_key
from talentspark.operators.joins import lookup_join


def gazetteer_pattern(gazetteer: list[tuple[str, str]]) -> str:
    """One pattern for all (label, phrase) pairs: whole words, any case, the longest first."""
    phrases = sorted({phrase for _, phrase in gazetteer}, key=lambda p: (-len(p), p))
    escaped = [re.sub(r"([^\w\s])", r"\\\1", p, flags=re.ASCII) for p in phrases]
    return rf"(?iu)(?<![{P.WORD}])(?:{'|'.join(escaped)})(?![{P.WORD}])"


def gazetteer_spans(text: Column, gazetteer: list[tuple[str, str]]) -> Column:
    """The default entity provider: array of struct<label,text,start,end,score>.

    Offsets add up the lengths of the text between the finds and of the finds themselves.
    """
    pattern = gazetteer_pattern(gazetteer)
    finds = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    labels = F.create_map(*[F.lit(x) for label, phrase in dict((p.lower(), (la, p)) for la, p in gazetteer).values()
                            for x in (phrase.lower(), label)])
    empty = F.array().cast("array<struct<label:string,text:string,start:int,end:int,score:double>>")
    # zipped rather than indexed: a lambda would split the text again for every find
    zipped = F.zip_with(finds, gaps, lambda f, g: F.struct(f.alias("text"), g.alias("gap")))
    steps = F.filter(zipped, lambda step: step["text"].isNotNull())

    def add(acc: Column, step: Column) -> Column:
        start = acc["pos"] + step["gap"]
        end = start + F.length(step["text"])
        span = F.struct(
            F.element_at(labels, F.lower(step["text"])).alias("label"), step["text"].alias("text"),
            start.alias("start"), end.alias("end"), F.lit(1.0).alias("score"),
        )
        return F.struct(end.alias("pos"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    start = F.struct(F.lit(0).alias("pos"), empty.alias("spans"))
    return F.aggregate(steps, start, add, lambda acc: acc["spans"])


def entity_table(docs: DataFrame, id_col: str, spans: Column) -> DataFrame:
    return docs.select(id_col, F.inline(spans))


def model_entities(
    docs: DataFrame, id_col: str, text_col: str, load: Callable[[], Callable[[list[str]], list[list[dict]]]]
) -> DataFrame:
    """Entities found by a Python model, in Arrow batches.

    ``load`` runs once per task and returns a function from texts to one list of
    {label, text, start, end, score} per text.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def find(batches: Iterator) -> Iterator:
        import pandas as pd

        predict = load()
        for batch in batches:
            found = predict(batch.iloc[:, 1].tolist())
            rows = [
                (key, e["label"], e["text"], e["start"], e["end"], e["score"])
                for key, entities in zip(batch.iloc[:, 0], found) for e in entities
            ]
            yield pd.DataFrame(rows, columns=[id_col, "label", "text", "start", "end", "score"])

    schema = f"`{id_col}` {id_type}, label string, text string, start int, end int, score double"
    return docs.select(id_col, text_col).mapInPandas(find, schema)


def unknown_labels(requested: DataFrame, known: DataFrame) -> DataFrame:
    """Labels asked for (column ``label``) that the label table does not hold."""
    return requested.select("label").distinct().join(known.select("label").distinct(), "label", "left_anti")


def redact_entities(
    docs: DataFrame, id_col: str, text_col: str, entities: DataFrame, labels: list[str] | None = None,
    known: list[str] | None = None,
) -> DataFrame:
    """Replace the entity spans of each text; texts without entities stay as they are. A label that is not
    among the ``known`` ones of the entity finder is refused.

    Spans are gathered per text, so a group is never larger than its text.
    """
    wanted = entities.where(F.col("label").isin(wanted_labels(labels, known)))
    spans = wanted.groupBy(id_col).agg(F.collect_list(F.struct("label", "start", "end")).alias("_spans"))
    joined = docs.join(spans, id_col, "left")
    return joined.withColumn(text_col, redact_spans(F.col(text_col), F.col("_spans"), labels)).drop("_spans")


def merge_model_skills(dictionary_skills: DataFrame, entities: DataFrame, lex: Lexicon, id_col: str) -> DataFrame:
    """Add model-found skills a text does not have yet: (id, skill, unit, start, end).

    Dictionary spans count tokens, model spans characters. A model phrase known to the
    dictionary takes its preferred label.
    """
    found = entities.where(F.col("label").isin(P.SKILL_LABELS) & (F.col("score") > P.ENTITY_THRESHOLD)).select(
        id_col, strip(F.lower("text")).alias("phrase"), "start", "end"
    )
    named = lookup_join(found, lex.phrases, ["phrase"], "left", [id_col, "start"]).select(
        id_col, F.coalesce("preferred", "phrase").alias("skill"), "start", "end"
    )
    fresh = first_per_key(named, [id_col, "skill"], [F.col("start"), F.col("end")]).join(
        dictionary_skills.select(id_col, "skill"), [id_col, "skill"], "left_anti"
    )
    columns = [id_col, "skill", "unit", "start", "end"]
    return (
        dictionary_skills.withColumn("unit", F.lit("token")).select(*columns)
        .unionByName(fresh.withColumn("unit", F.lit("char")).select(*columns))
    )

"""Terms, TF-IDF weights and text embeddings."""

from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.feature import (
    IDF, CountVectorizer, ElementwiseProduct, HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer,
)
from pyspark.ml.functions import predict_batch_udf
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

from talentspark.functions.text import words
from talentspark.operators.joins import lookup_join
from talentspark.operators.known import listed, partial_counts, partial_hits
from talentspark.session import settle, settle_table, small_batches

# fixed values: vectoriser settings
MIN_DF, MAX_DF, MAX_FEATURES, MAX_NGRAM = 2, 0.95, 5_000, 3
EMBEDDING_WIDTH, EMBEDDING_BATCH = 384, 32


def term_tokens(c: Column) -> Column:
    """Words of two letters or more of the normalised text, which are those of the lower-cased one."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z]{2,}"), F.lit(0))


def _term_text(c: Column) -> Column:
    """What ``operators.known`` finds the words of ``term_tokens`` in."""
    return F.lower(c)


def _gram_array(tokens: str, n: int) -> Column:
    """All runs of n tokens, repeats included."""
    count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    grams = F.slice(tokens, F.lit(1), count)
    for k in range(2, n + 1):
        grams = F.zip_with(grams, F.slice(tokens, F.lit(k), count), lambda a, b: F.concat(a, F.lit(" "), b))
    return grams


def _gram_counts(tokens: DataFrame, n: int, frequent: DataFrame | None, by: str | None = None) -> DataFrame:
    """(term, df, cf) of the n-grams whose first and last n - 1 words are ``frequent`` terms, counted apart for
    each value of the column ``by``.

    Each batch of texts is counted by itself, so one row per batch and gram goes on to be added up; texts are not
    shuffled, and a longer gram is spelled out only after that. Parts too many to be sent to the tasks are joined.
    """
    own = [] if by is None else [by]
    parts = None if frequent is None else listed(frequent, "term")
    if frequent is not None and parts is None:
        return _joined_counts(tokens, n, frequent, own)
    counts = partial_counts(tokens.select(*own, "_tokens"), "_tokens", parts, by)
    key = "term" if parts is None else "_code"
    counts = counts.groupBy(key, *own).agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    if parts is None:
        return counts
    names = tokens.sparkSession.createDataFrame(list(enumerate(parts)), "_no long, _part string")
    for k, place in enumerate((F.expr(f"_code div {max(len(parts), 1)}"), F.col("_code") % max(len(parts), 1))):
        counts = counts.withColumn("_no", place).join(F.broadcast(names.withColumnRenamed("_part", f"_part{k}")), "_no")
    term = F.concat("_part0", F.lit(" "), F.substring_index("_part1", " ", -1))
    return counts.select(term.alias("term"), *own, "df", "cf")


def _joined_counts(tokens: DataFrame, n: int, frequent: DataFrame, own: list[str]) -> DataFrame:
    """``_gram_counts`` for any number of ``frequent`` terms.

    A row of a text yields its grams to count occurrences, and its distinct grams to count
    texts. Both are summed per task before the shuffle, and texts are not shuffled at all.
    """
    if tokens.schema["_tokens"].dataType == StringType():
        tokens = tokens.withColumn("_tokens", term_tokens(F.col("_tokens")))
    per_text = tokens.select(*own, _gram_array("_tokens", n).alias("_g")).select(*own, F.explode(F.array(
        F.struct(F.lit(1).alias("cf"), F.lit(0).alias("df"), F.col("_g").alias("grams")),
        F.struct(F.lit(0).alias("cf"), F.lit(1).alias("df"), F.array_distinct("_g").alias("grams")),
    )).alias("_c"))
    rows = per_text.select(*own, "_c.cf", "_c.df", F.explode("_c.grams").alias("term"))
    for part in (F.substring_index("term", " ", n - 1), F.substring_index("term", " ", 1 - n)):
        rows = lookup_join(
            rows.withColumn("_part", part), frequent.select(F.col("term").alias("_part")), ["_part"], "left_semi",
            ["term"],
        ).drop("_part")
    return rows.groupBy("term", *own).agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def term_stats(
    docs: DataFrame, text_col: str, max_n: int = MAX_NGRAM, min_df: int = MIN_DF,
    max_df: float = MAX_DF, max_features: int = MAX_FEATURES,
) -> DataFrame:
    """(term, df, cf, idf): the ``max_features`` terms with the highest total count (then in
    string order) among those in at least ``min_df`` texts and at most ``max_df`` of them.

    Exact, but without counting every n-gram: a gram is no more frequent than the shorter grams
    in it. So once ``max_features`` shorter terms are known, longer ones are counted only if
    their parts reach the lowest count among those.
    """
    n_texts = docs.count()
    tokens = docs.select(_term_text(F.col(text_col)).alias("_tokens"))
    best = [F.desc("cf"), F.asc("term")]
    top, frequent, bound = None, None, 0
    for n in range(1, max_n + 1):
        # the lowest count only rises: what lies below it is neither among the terms nor a part of one
        reached = _gram_counts(tokens, n, frequent).where((F.col("df") >= min_df) & (F.col("cf") >= bound))
        counts = settle_table(reached, "term-counts")
        kept = counts.where(F.col("df") <= max_df * n_texts)
        top = settle((kept if top is None else top.unionByName(kept)).orderBy(*best).limit(max_features))
        found, lowest = top.agg(F.count(F.lit(1)), F.min("cf")).first()
        bound = lowest if found == max_features else 0
        frequent = counts.where(F.col("cf") >= bound)
    return top.withColumn("idf", F.log((F.lit(n_texts) + 1) / (F.col("df") + 1)) + 1)


def own_counts(fold: int) -> Column:
    """The counts of one fold among the ``parts`` of a term, null if it has none there."""
    return F.get(F.filter("parts", lambda p: p["fold"] == fold), F.lit(0))


def training_counts(fold: int | None) -> dict[str, Column]:
    """df and cf of the texts of all other folds; of all texts without a ``fold``."""
    own = None if fold is None else own_counts(fold)
    return {c: F.col(c) - (F.lit(0) if own is None else F.coalesce(own[c], F.lit(0))) for c in ("df", "cf")}


def _least_count(terms: DataFrame, sizes: dict[int, int], min_dfs: list[int], max_df: float, max_features: int) -> int:
    """The least count that a further term needs for a place among the ``max_features`` first terms of any training
    set, at any of the ``min_dfs``; 0 while one of them has fewer terms."""
    total, lowest = sum(sizes.values()), []
    # without rows a training set has no terms
    for fold, least in product([*(f for f in sorted(sizes) if sizes[f] < total), None], min_dfs):
        counts = training_counts(fold)
        fits = (counts["df"] >= least) & (counts["df"] <= max_df * (total - sizes.get(fold, 0)))
        lowest.append(terms.where(fits).select(counts["cf"].alias("cf")).orderBy(F.desc("cf")).limit(max_features).agg(
            F.count(F.lit(1)).alias("n"), F.min("cf").alias("cf")))
    # one row per training set and limit
    return min((r["cf"] or 0) if r["n"] == max_features else 0 for r in reduce(DataFrame.unionByName, lowest).collect())


def fold_terms(
    tokens: DataFrame, max_n: int, min_dfs: list[int], max_df: float, max_features: int
) -> tuple[DataFrame, dict[int, int]]:
    """(term, words, df, cf, parts) of rows (fold, _tokens), and the number of rows of each fold; ``_tokens`` holds
    lists of words or lower-cased texts.

    Terms are counted once per fold, not once per training set: what a fold trains on is the total less the fold's
    own counts, which stand in ``parts`` (fold, df, cf). A gram is counted only if its parts are in the least of
    ``min_dfs`` texts of all folds, without which no training set can hold it often enough, and, once every training
    set has ``max_features`` shorter terms, if all folds have its parts as often as the last of those. So the terms
    hold the ``max_features`` first ones of every training set for every ``n``. Rows without a fold are left out.
    """
    kept = tokens.where(F.col("fold").isNotNull())
    # one row per fold
    sizes = {r["fold"]: r["count"] for r in kept.groupBy("fold").count().collect()}
    counted, frequent, bound = None, None, 0
    for n in range(1, max_n + 1):
        per_fold = _gram_counts(kept, n, frequent, "fold")
        totals = per_fold.groupBy("term").agg(
            F.lit(n).alias("words"), F.sum("df").alias("df"), F.sum("cf").alias("cf"),
            F.collect_list(F.struct("fold", "df", "cf")).alias("parts"),
        )
        found = settle_table(totals.where((F.col("df") >= min(min_dfs)) & (F.col("cf") >= bound)), "fold-terms")
        counted = found if counted is None else counted.unionByName(found)
        if n < max_n and sizes:
            bound = _least_count(counted, sizes, min_dfs, max_df, max_features)
            frequent = found.where(F.col("cf") >= bound)
    return counted, sizes


def fold_vocabularies(
    docs: DataFrame, text_col: str, fold_col: str, max_n: int = MAX_NGRAM, min_df: int = MIN_DF,
    max_df: float = MAX_DF, max_features: int = MAX_FEATURES,
) -> DataFrame:
    """(fold, term, df, cf): the vocabulary of each fold's training texts, which are those of all other folds.

    The limits are those of ``term_stats``, applied to the training texts. Texts without a fold belong to no
    training set; null texts count as texts without terms.
    """
    tokens = docs.select(F.col(fold_col).alias("fold"), _term_text(F.col(text_col)).alias("_tokens"))
    terms, sizes = fold_terms(tokens, max_n, [min_df], max_df, max_features)
    out = terms.select(F.col("parts")[0]["fold"].alias("fold"), "term", "df", "cf").limit(0)
    for fold, size in sorted(sizes.items()):
        rest = terms.select(F.lit(fold).alias("fold"), "term", *[v.alias(c) for c, v in training_counts(fold).items()])
        fits = (F.col("df") >= min_df) & (F.col("df") <= max_df * (sum(sizes.values()) - size))
        out = out.unionByName(rest.where(fits).orderBy(F.desc("cf"), F.asc("term")).limit(max_features))
    return out


def tfidf(docs: DataFrame, id_col: str, text_col: str, max_n: int = MAX_NGRAM, **limits) -> DataFrame:
    """(id, term, tfidf): count times idf, scaled to length 1 per text.

    Grams are looked up and counted where their text is read; only (id, number of the term, count) is placed by id, and
    scaling needs no other shuffle. The vocabulary has at most ``max_features`` rows and is sent to every task.
    """
    stats = settle(term_stats(docs, text_col, max_n, **limits).select("term", "idf"))
    # at most max_features rows
    terms = sorted(r["term"] for r in stats.collect())
    names = docs.sparkSession.createDataFrame(list(enumerate(terms)), "_no long, term string")
    vocabulary = settle(names.join(stats, "term"))
    tokens = docs.select(id_col, _term_text(F.col(text_col)).alias("_tokens"))
    hits = partial_hits(tokens, id_col, "_tokens", terms).repartition(F.col(id_col))
    counts = hits.groupBy(id_col, "_no").agg(F.sum("_n").alias("_n"))
    weights = counts.join(F.broadcast(vocabulary), "_no").select(id_col, "term", (F.col("_n") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return weights.select(id_col, "term", (F.col("w") / norm).alias("tfidf"))


def normalize_by_lookup(docs: DataFrame, id_col: str, text_col: str, stop_words: list[str], lemmas: DataFrame) -> DataFrame:
    """Stop-word and alphabet filter with lemmas from a table (form, lemma); unknown forms stay.

    Stop words are tested on the form, as it stands in the text.
    """
    forms = docs.select(id_col, F.posexplode(words(F.col(text_col))).alias("pos", "form")).where(
        F.col("form").rlike(r"\A\p{L}+\z") & ~F.col("form").isin(stop_words)
    )
    named = lookup_join(forms, lemmas.select("form", "lemma"), ["form"], "left", [id_col, "pos"])
    joined = named.groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct("pos", F.lower(F.coalesce("lemma", "form")).alias("w")))).alias("_w")
    )
    text = F.coalesce(F.array_join(F.col("_w.w"), " "), F.lit(""))
    return docs.select(id_col).join(joined, id_col, "left").select(id_col, text.alias("normalized"))


MODELS: dict[str, Callable[[], Callable]] = {}


def register_model(name: str, load: Callable[[], Callable]) -> None:
    """Make an embedding model known; ``load`` returns ``encode(list of texts) -> 2-d array``."""
    if not name or MODELS.setdefault(name, load) is not load:
        raise ValueError(f"no name, or one that another model has: {name!r}")


def model_loader(name: str) -> Callable[[], Callable]:
    """How a registered model is loaded; other names are refused before any row is read."""
    if name not in MODELS:
        raise ValueError(f"unknown embedding model {name!r}; known: {', '.join(sorted(MODELS)) or 'none'}")
    return MODELS[name]


def embed_with(text: Column, model: str | Callable[[], Callable], batch_size: int = EMBEDDING_BATCH) -> Column:
    """Vectors of a Python embedding model, a registered name or a loader, as array<float>.

    The model is loaded once by each Python worker, which keeps it for its later tasks; texts reach it
    ``batch_size`` at a time. A null text is embedded as an empty one. The active session's Arrow batches are made small.
    """
    if session := SparkSession.getActiveSession():
        small_batches(session)
    load = model_loader(model) if isinstance(model, str) else model

    def make() -> Callable:
        import numpy as np

        encode = load()

        def predict(texts):
            return np.asarray(encode([t or "" for t in texts]), "float32").reshape(len(texts), -1)

        return predict

    run = predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return run(F.coalesce(text, F.lit("")))


def hashed_embedding(input_col: str, output_col: str = "features", width: int = EMBEDDING_WIDTH) -> Pipeline:
    """The default embedder: hashed word counts of length 1, no download and no fit."""
    tokens, counts = f"{output_col}_tokens", f"{output_col}_counts"
    return Pipeline(stages=[
        RegexTokenizer(inputCol=input_col, outputCol=tokens, gaps=False, pattern=r"\p{L}+"),
        HashingTF(inputCol=tokens, outputCol=counts, numFeatures=width),
        Normalizer(inputCol=counts, outputCol=output_col, p=2.0),
    ])


class SmoothedIdf(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Spark's idf plus one, as an element-wise product."""

    @keyword_only
    def __init__(self, inputCol: str = None, outputCol: str = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ElementwiseProduct:
        idf = IDF(inputCol=self.getInputCol(), outputCol="_idf").fit(dataset).idf
        return ElementwiseProduct(
            scalingVec=Vectors.dense(idf.toArray() + 1.0), inputCol=self.getInputCol(), outputCol=self.getOutputCol()
        )


def term_lists(input_col: str) -> Pipeline:
    """Array columns ``grams1``, ``grams2``, ``grams3``: all 1..n-grams of a text, repeats included."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=input_col, outputCol="grams1", gaps=False, pattern="[a-z]+", minTokenLength=2),
        NGram(n=2, inputCol="grams1", outputCol="_pairs"),
        NGram(n=3, inputCol="grams1", outputCol="_triples"),
        SQLTransformer(statement="SELECT *, concat(grams1, _pairs) AS grams2, "
                                 "concat(grams1, _pairs, _triples) AS grams3 FROM __THIS__"),
    ])


def tfidf_stages(
    input_col: str = "grams3", output_col: str = "features", min_df: int = MIN_DF, max_df: float = MAX_DF,
    max_features: int = MAX_FEATURES,
) -> list:
    """The same weights as ``tfidf`` as sparse vectors, from a column of ``term_lists``."""
    counts, weighted = f"{output_col}_counts", f"{output_col}_weighted"
    return [
        CountVectorizer(inputCol=input_col, outputCol=counts, vocabSize=max_features, minDF=min_df, maxDF=max_df),
        SmoothedIdf(inputCol=counts, outputCol=weighted),
        Normalizer(inputCol=weighted, outputCol=output_col, p=2.0),
    ]

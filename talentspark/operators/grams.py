"""Token n-grams as rows, and equi-joins of texts with phrase tables on them."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentspark.functions import patterns as P
from talentspark.operators.joins import lookup_join
from talentspark.operators.known import listed, partial_runs, run_starts
from talentspark.session import settle

# a word is a run of letters, marks and digits; any other visible character stands alone
TOKEN = rf"[\p{{L}}\p{{M}}\p{{N}}]+|[^{P.WHITESPACE}\p{{L}}\p{{M}}\p{{N}}]"
# the same for whole-word search, where the underscore joins words and marks do not
# (a-z and 0-9 are letters and digits that need no look at the Unicode tables)
WORD_TOKEN = rf"[a-z0-9{P.WORD}]+|[^{P.WHITESPACE}{P.WORD}]"
WORD_PIECE = rf"(?:{WORD_TOKEN})[{P.WHITESPACE}]*"
# the characters of WHITESPACE, for tasks that have its pieces already
BLANKS = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def run_rows(docs: DataFrame, id_col: str, arrays: dict[str, str], max_n: int) -> DataFrame:
    """(id, start, <name>1 .. <name>max_n, ...): per position the next ``max_n`` elements of each
    array column, null past the end. ``arrays`` gives name -> column."""
    shifted = [
        F.slice(column, k, F.greatest(F.size(column), F.lit(1))).alias(f"{name}{k}")
        for name, column in arrays.items() for k in range(1, max_n + 1)
    ]
    return docs.select(id_col, F.posexplode(F.arrays_zip(*shifted)).alias("start", "_run")).select(
        id_col, "start", "_run.*"
    )


def _heads(table: DataFrame, head: Column) -> DataFrame:
    """(head, lengths): the lengths of the sequences that begin with each token."""
    return settle(table.groupBy(head.alias("head")).agg(F.sort_array(F.collect_set("n")).alias("lengths")))


def _candidates(rows: DataFrame, heads: DataFrame, id_col: str, token: str, max_n: int) -> DataFrame:
    """Runs whose first token begins a known sequence, once per length ``n`` to try. Most
    positions end here, before any gram is put together."""
    begun = lookup_join(rows.withColumn("head", F.col(f"{token}1")), heads, ["head"], "inner", [id_col, "start"])
    tried = begun.withColumn("n", F.explode("lengths")).drop("head", "lengths")
    last = F.get(F.array(*[F.col(f"{token}{k}") for k in range(1, max_n + 1)]), F.col("n") - 1)
    return tried.where(last.isNotNull())


@dataclass(frozen=True)
class Lexicon:
    """A settled dictionary: its rows (phrase, preferred), the same keyed by token sequence
    (gram, n, preferred), the lengths per first token, and the greatest length."""

    phrases: DataFrame
    table: DataFrame
    heads: DataFrame
    max_n: int


def lexicon(dictionary: DataFrame) -> Lexicon:
    """Key (phrase, preferred) rows by their tokens.

    Phrases that differ in spacing only share a key; the one written like its key wins, then
    the first in string order.
    """
    phrases = settle(dictionary.select("phrase", "preferred"))
    keyed = (
        phrases.select("phrase", "preferred", tokens(F.col("phrase")).alias("_t"))
        .where(F.size("_t") > 0)
        .select("phrase", "preferred", F.array_join("_t", " ").alias("gram"), F.size("_t").alias("n"))
        .groupBy("gram", "n")
        .agg(F.min_by("preferred", F.struct(F.col("phrase") != F.col("gram"), "phrase")).alias("preferred"))
    )
    table = settle(keyed)
    heads = _heads(table, F.substring_index("gram", " ", 1))
    return Lexicon(phrases, table, heads, table.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0])


def phrase_match(docs: DataFrame, id_col: str, text_col: str, lex: Lexicon) -> DataFrame:
    """Every dictionary phrase in every text, overlaps included.

    Gives (id, phrase, preferred, start, end) with token offsets, end exclusive.
    """
    docs = docs.select(id_col, tokens(F.col(text_col)).alias("_tokens"))
    known = listed(lex.table, "gram")
    if known is not None:
        names = docs.sparkSession.createDataFrame(list(enumerate(known)), "_no long, gram string")
        found = run_starts(docs, id_col, "_tokens", known)
        hits = lookup_join(found, settle(names.join(lex.table, "gram")), ["_no"], "inner", spread_by=[id_col, "start"])
        return _spans(hits, id_col)
    # more phrases than a task can hold
    rows = _candidates(run_rows(docs, id_col, {"_t": "_tokens"}, lex.max_n), lex.heads, id_col, "_t", lex.max_n)
    gram = F.concat_ws(" ", *[F.when(F.col("n") >= k, F.col(f"_t{k}")) for k in range(1, lex.max_n + 1)])
    grams = rows.select(id_col, "start", "n", gram.alias("gram"))
    return _spans(lookup_join(grams, lex.table, ["gram", "n"], "inner", spread_by=[id_col, "start"]), id_col)


def _spans(hits: DataFrame, id_col: str) -> DataFrame:
    return hits.select(
        id_col, F.col("gram").alias("phrase"), "preferred", "start", (F.col("start") + F.col("n")).alias("end")
    )


def first_spans(hits: DataFrame, id_col: str) -> DataFrame:
    """First span of each canonical skill per text: (id, skill, start, end).

    Start and end are packed into one long, which keeps the aggregate a hash aggregate with
    partial results per task.
    """
    packed = F.shiftleft(F.col("start").cast("long"), 32) + F.col("end")
    first = hits.groupBy(id_col, F.col("preferred").alias("skill")).agg(F.min(packed).alias("_span"))
    return first.select(
        id_col, "skill",
        F.shiftright("_span", 32).cast("int").alias("start"),
        F.col("_span").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("end"),
    )


def skill_table(spark: SparkSession, skills: list[str]) -> DataFrame:
    """The query list as rows (pos, skill); copies are kept."""
    return spark.createDataFrame(list(enumerate(skills)), "pos int, skill string")


def whole_word_hits(docs: DataFrame, id_col: str, text_col: str, skills: DataFrame) -> DataFrame:
    """(id, pos, skill) for each skill of a large query list that occurs as a whole word.

    An occurrence between word boundaries starts and ends at token edges, so it equals a run of
    tokens with the blanks between them. Such runs are found a batch of texts at a time; a list of
    skills too long for that is joined. A skill that starts (ends) with a symbol also needs a word
    character right before (after) it.
    """
    literal = F.lower("skill")
    pieces = F.regexp_extract_all(literal, F.lit(WORD_PIECE), F.lit(0))
    wanted = settle(
        skills.where(literal.rlike(rf"[^{P.WHITESPACE}]")).select(
            "pos", "skill", literal.alias("gram"),
            F.size(pieces).alias("n"), pieces.alias("_pieces"),
            F.regexp_extract(literal, WORD_TOKEN, 0).alias("_head"),
            (~literal.rlike(rf"\A[{P.WORD}]")).alias("_before"),
            (~literal.rlike(rf"[{P.WORD}]\z")).alias("_after"),
        )
    )
    # a run neither begins nor ends with a blank
    trimmed = wanted.where(F.col("gram").rlike(rf"\A[^{P.WHITESPACE}]") & F.col("gram").rlike(rf"[^{P.WHITESPACE}]\z"))
    known = listed(trimmed, "gram")
    if known is None:
        return _hits_by_join(docs, id_col, text_col, wanted.drop("_pieces"))
    rows = {r["gram"]: r for r in trimmed.select("gram", "_pieces", "_before", "_after").distinct().collect()}
    found = partial_runs(
        docs.select(id_col, F.regexp_extract_all(F.lower(text_col), F.lit(WORD_PIECE), F.lit(0)).alias("_p")), id_col, "_p",
        [rows[g]["_pieces"] for g in known], [rows[g]["_before"] or rows[g]["_after"] for g in known], BLANKS,
    )
    before, after = (F.coalesce(F.col(c).rlike(rf"\A[{P.WORD}]"), F.lit(False)) for c in ("_prev", "_next"))
    held = found.groupBy(id_col, "_no").agg(
        F.max(before).alias("before"), F.max(after).alias("after"), F.max(before & after).alias("both")
    )
    names = docs.sparkSession.createDataFrame(list(enumerate(known)), "_no long, gram string")
    named = settle(names.join(trimmed, "gram").select("_no", "pos", "skill", "_before", "_after"))
    hits = lookup_join(held, named, ["_no"], "inner", spread_by=[id_col, "_no"])
    needed = F.when(F.col("_before") & F.col("_after"), F.col("both")).when(F.col("_before"), F.col("before")).when(
        F.col("_after"), F.col("after")).otherwise(F.lit(True))
    hits = hits.where(needed)
    total, places = named.agg(F.count(F.lit(1)), F.count_distinct("pos")).first()
    if total == places:
        return hits.select(id_col, "pos", "skill")
    return hits.groupBy(id_col, "pos").agg(F.min("skill").alias("skill"))


def _hits_by_join(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """``whole_word_hits`` for any number of ``wanted`` skills, by an equi-join on the runs."""
    max_n = wanted.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]

    text = F.lower(text_col)
    df = docs.select(
        id_col,
        F.regexp_extract_all(text, F.lit(WORD_TOKEN), F.lit(0)).alias("_t"),
        F.regexp_extract_all(text, F.lit(WORD_PIECE), F.lit(0)).alias("_p1"),
    )
    # columns, as lambdas would evaluate the extractions again for every token
    df = df.select(
        "*", F.transform("_t", lambda t: t.rlike(rf"\A[{P.WORD}]")).alias("_word"),
        F.zip_with("_t", "_p1", lambda t, p: t == p).alias("_tight"),
    )
    ends_in_word = F.zip_with("_tight", "_word", lambda tight, word: tight & word)
    next_is_word = F.concat(F.slice("_word", 2, F.greatest(F.size("_t"), F.lit(1))), F.array(F.lit(False)))
    df = df.select(
        id_col, "_t", "_p1", F.concat(F.array(F.lit(False)), ends_in_word).alias("_before"),
        F.zip_with("_tight", next_is_word, lambda tight, word: tight & word).alias("_after"),
    )
    rows = run_rows(df, id_col, {"_t": "_t", "_p": "_p1", "before": "_before", "after": "_after"}, max_n)
    rows = _candidates(rows, _heads(wanted, F.col("_head")), id_col, "_t", max_n)
    gram, after = F, F
    for n in range(1, max_n + 1):
        here = F.col("n") == n
        gram = gram.when(here, F.concat(*[F.col(f"_p{k}") for k in range(1, n)], F.col(f"_t{n}")))
        after = after.when(here, F.col(f"after{n}"))
    grams = rows.select(id_col, "start", "n", gram.alias("gram"), F.col("before1").alias("before"), after.alias("after"))
    hits = lookup_join(grams, wanted.drop("_head"), ["gram", "n"], "inner", spread_by=[id_col, "start"])
    hits = hits.where((~F.col("_before") | F.col("before")) & (~F.col("_after") | F.col("after")))
    return hits.groupBy(id_col, "pos").agg(F.min("skill").alias("skill"))

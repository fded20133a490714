"""The registered queries: name -> (Spark query, checking SQL or None)."""

import json

from pyspark.ml import PipelineModel
from pyspark.ml.feature import IndexToString, SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentspark.catalog import sql as S
from talentspark.catalog import tables as T
from talentspark.functions import patterns as P
from talentspark.functions import redact as R
from talentspark.functions import scores as C
from talentspark.functions import text as X
from talentspark.operators import dictionary as D
from talentspark.operators import entities as E
from talentspark.operators import features as FT
from talentspark.operators import grams as G
from talentspark.operators import jobs as J
from talentspark.operators import learning as L
from talentspark.operators import matching as M
from talentspark.operators import metrics as MT
from talentspark.operators import splits as SP
from talentspark.operators import stages, svm
from talentspark.plans import aggregate, analyze, dataset, train
from talentspark.session import scratch_path, spread
from talentspark.sources import feeds, files, landing

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# ---------------------------------------------------------------- sources and sinks

def _feed_query(key: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return feeds.normalise(T.landed_feed(spark, sf, key), key).drop("source_ord")

    query(f"src_{key}", S.feed_listings(key))(run)


for _key in feeds.FEEDS:
    _feed_query(_key)


_STOPS_EMPTY = "('Arbeitnow', 'The Muse', 'Himalayas', 'USAJobs', 'Adzuna')"


@query("page_window", f"""
    WITH names AS (SELECT * FROM {S.values([(f.ord, f.name, f.pages_factor or 0) for f in feeds.FEEDS.values()],
                                           'n(ord, source, factor)')}),
    landed AS (
        SELECT source, factor, CAST(l_orderkey AS VARCHAR) AS skill, l_linenumber AS page,
            l_tax = 0.08 AS failed, l_tax = 0 AS empty,
            source = 'USAJobs' OR l_returnflag = 'R' AS last
        FROM lineitem JOIN names ON ord = l_orderkey % 9),
    stops AS (
        SELECT source, skill, min(CASE
            WHEN failed THEN page WHEN source IN {_STOPS_EMPTY} AND empty THEN page
            WHEN source = 'Findwork.dev' AND last THEN page + 1 END) AS stop
        FROM landed WHERE factor > 0 GROUP BY ALL)
    SELECT l.source, l.skill, l.page FROM landed l LEFT JOIN stops s ON l.source = s.source AND l.skill = s.skill
    WHERE page <= CASE WHEN factor = 0 THEN 1 ELSE 3 * factor END AND (stop IS NULL OR page < stop)""")
def page_window(spark, sf):
    return landing.page_window(T.landed_orders(spark, sf), 3).select("source", "skill", "page")


def _csv_of_documents(spark, sf, name: str, columns: list) -> str:
    path = scratch_path(spark, name)
    files.sink_dataset_csv(T.documents(spark, sf).select(*columns), path)
    return path


@query("rss_jobs", f"""
    WITH landed AS ({S.feed_listings('weworkremotely')}),
    placed AS (SELECT *, 5 AS source_ord, ((fetch_ord >> 20) % 7 << 44) + fetch_ord AS place FROM landed)
    SELECT job_id, title, company, location, url, skills_matched, matched_skills
    FROM ({S.unique_jobs("SELECT source, source_ord, place AS fetch_ord, job_id, title, company, location, url, description FROM placed", T.SKILLS)})""")
def rss_jobs(spark, sf):
    """Landed RSS files to ranked jobs."""
    path = scratch_path(spark, "rss")
    names = F.array(*[F.lit(c) for c in feeds.CATEGORIES["We Work Remotely"]])
    T.landed_feed(spark, sf, "weworkremotely").select(
        "payload", "page", F.get(names, F.col("page") % 7).alias("category")
    ).write.partitionBy("category", "page").text(path)
    jobs = aggregate.report(feeds.rss_listings(feeds.read_rss(spark, path)), T.SKILLS).ranked()
    return jobs.select("job_id", "title", "company", "location", "url", "skills_matched", "matched_skills")


@query("scan_labelled_csv", "SELECT source AS Category, text AS Text FROM documents")
def scan_labelled_csv(spark, sf):
    path = _csv_of_documents(spark, sf, "labelled", [F.col("source").alias("Category"), F.col("text").alias("Text")])
    return files.scan_labelled_csv(spark, path)


@query("scan_vocab_tsv", "SELECT DISTINCT lower(trim(p_name)) AS term FROM part")
def scan_vocab_tsv(spark, sf):
    path = scratch_path(spark, "vocabulary")
    T.load(spark, sf, "part").select(
        F.col("p_partkey").alias("Code"), F.concat(F.lit(" "), F.initcap("p_name")).alias("Element Name")
    ).write.options(sep="\t", header=True, ignoreLeadingWhiteSpace=False).csv(path)
    return files.scan_vocab_tsv(spark, path, "Element Name")


@query("scan_glob_union", "SELECT text AS Resume_str, lang AS Category FROM documents")
def scan_glob_union(spark, sf):
    path = _csv_of_documents(spark, sf, "synthetic", [F.col("text").alias("Resume_str"), F.col("lang").alias("Category")])
    return files.scan_labelled_csv(spark, path + "/*.csv", "Resume_str string, Category string")


@query("scan_skill_map", "SELECT DISTINCT lower(p_brand || ' ' || p_name) AS phrase, p_name AS preferred FROM part")
def scan_skill_map(spark, sf):
    path = scratch_path(spark, "skill-map")
    pairs = T.load(spark, sf, "part").select(
        "p_brand", F.lower(F.concat_ws(" ", "p_brand", "p_name")).alias("phrase"), "p_name"
    ).distinct()
    # one object (and one file) per brand
    objects = pairs.groupBy("p_brand").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("phrase", "p_name")))).alias("value")
    )
    objects.write.partitionBy("p_brand").text(path)
    return files.scan_skill_map(spark, path + "/*/")


def _doc_report(spark, sf) -> aggregate.JobReport:
    return aggregate.report(T.document_listings(spark, sf), T.SKILLS)


@query("sink_jobs_csv", f"SELECT source, job_id, title, company, location, url, skills_matched, matched_skills, "
       f"'job_descriptions/' || {S.file_name('source', 'job_id', 'title')} AS description_file "
       f"FROM ({S.unique_jobs(S.DOC_LISTINGS, T.SKILLS)})")
def sink_jobs_csv(spark, sf):
    path = scratch_path(spark, "jobs")
    files.sink_jobs_csv(_doc_report(spark, sf).jobs, path)
    schema = ", ".join(f"{c} {'int' if c == 'skills_matched' else 'string'}" for c in J.JOB_COLUMNS)
    return files.scan_labelled_csv(spark, path, schema)


_CONTENT = (
    "'Title          : ' || title || chr(10) || 'Company        : ' || company || chr(10) || "
    "'Location       : ' || location || chr(10) || 'Matched Skills : ' || "
    "coalesce(nullif(matched_skills, ''), 'None') || chr(10) || repeat('─', 60) || chr(10) || chr(10) || "
    "description || chr(10)"
)


@query("sink_descriptions", f"SELECT source, {S.file_name('source', 'job_id', 'title')} AS file_name, "
       f"{_CONTENT} AS content FROM ({S.unique_jobs(S.DOC_LISTINGS, T.SKILLS)})")
def sink_descriptions(spark, sf):
    path = scratch_path(spark, "descriptions")
    files.sink_descriptions(_doc_report(spark, sf).descriptions(), path)
    return spark.read.parquet(path).select("source", "file_name", "content")


_ESCO = r"""
    esco_words AS (SELECT item_id, regexp_extract_all(text, '\p{L}+') AS w FROM benchmark),
    esco_runs AS (SELECT item_id * 1000 + g AS row_no, w[g * 7 + 1:g * 7 + 7] AS w
        FROM (SELECT item_id, w, unnest(range((len(w) + 6) // 7)) AS g FROM esco_words)),
    esco AS (SELECT row_no, lower(concat_ws(' ', w[1], w[2])) AS preferred,
        CASE WHEN row_no % 5 <> 0 THEN [w[3], array_to_string(w[4:6], ' '), w[7]] ELSE [] END AS alts FROM esco_runs),
    esco_entries AS (
        SELECT preferred AS phrase, preferred, row_no, 0 AS pos FROM esco
        UNION ALL SELECT lower(unnest(alts)), preferred, row_no, unnest(range(1, len(alts) + 1)) FROM esco),
    dictionary AS (
        SELECT phrase, preferred FROM (
            SELECT phrase, preferred, 0 AS prio, row_no, pos FROM esco_entries
            UNION ALL SELECT DISTINCT lower(p_name), lower(p_name), 1, 0, 0 FROM part
            UNION ALL SELECT DISTINCT lower(c_mktsegment), lower(c_mktsegment), 2, 0, 0 FROM customer
            UNION ALL SELECT DISTINCT lower(p_brand || ' ' || p_name), lower(p_name), 3, 0, 0 FROM part)
        WHERE phrase <> ''
        QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY prio, row_no DESC, pos DESC) = 1)"""


def _dictionary(spark, sf) -> DataFrame:
    tech, spans = T.tech_terms(spark, sf)
    return D.skill_dictionary(
        T.esco(spark, sf), D.vocab_distinct(T.load(spark, sf, "part"), "p_name"),
        D.vocab_distinct(T.load(spark, sf, "customer"), "c_mktsegment"), tech, spans,
    )


@query("skill_dictionary", f"WITH {_ESCO} SELECT phrase, preferred FROM dictionary")
def skill_dictionary(spark, sf):
    return _dictionary(spark, sf)


@query("sink_skill_map", f"WITH {_ESCO} SELECT phrase, preferred FROM dictionary")
def sink_skill_map(spark, sf):
    path = scratch_path(spark, "dictionary")
    files.sink_skill_map(_dictionary(spark, sf), path)
    return files.scan_skill_map(spark, path)


_MAPPED = f"""
    mapped AS (SELECT doc_id AS resume_id, text AS Text,
        CASE WHEN lang = 'es' THEN lower(raw) ELSE raw END AS Category
        FROM documents JOIN {S.values([(i, r) for i, (r, _) in enumerate(P.CATEGORY_PAIRS)], 'c(pos, raw)')}
        ON pos = 2 * CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER)),
    broad AS (SELECT mapped.*, Mapped_Category FROM mapped LEFT JOIN
        {S.values(P.CATEGORY_PAIRS, 'b(raw2, Mapped_Category)')} ON raw2 = Category)"""


@query("category_map", f"WITH {_MAPPED} SELECT resume_id, Category, Mapped_Category FROM broad")
def category_map(spark, sf):
    return dataset.map_categories(T.resumes_raw(spark, sf).drop("Text"))


@query("prepare_dataset", f"WITH {_MAPPED} SELECT resume_id, Category, Mapped_Category, "
       f"{S.redact_dataset('Text')} AS Text FROM broad")
def prepare_dataset(spark, sf):
    return dataset.prepare_dataset(T.resumes_raw(spark, sf))


@query("sink_dataset_csv", f"WITH {_MAPPED} SELECT Category, Mapped_Category, {S.redact_dataset('Text')} AS Text FROM broad")
def sink_dataset_csv(spark, sf):
    path = scratch_path(spark, "dataset")
    files.sink_dataset_csv(
        dataset.prepare_dataset(T.resumes_raw(spark, sf)).select("Category", "Mapped_Category", "Text"), path
    )
    return files.scan_labelled_csv(spark, path, "Category string, Mapped_Category string, Text string")


@query("upload_filter", f"""
    SELECT doc_id, CASE lang WHEN 'en' THEN 'accepted' WHEN 'fr' THEN 'unsupported' WHEN 'de' THEN 'accepted'
        ELSE 'rejected' END AS status FROM documents""")
def upload_filter(spark, sf):
    return T.uploads(spark, sf).select("doc_id", X.upload_status(F.col("mime")).alias("status"))


# ---------------------------------------------------------------- text rules

@query("skill_list_parse", f"""
    SELECT doc_id, CAST(len(l) AS INTEGER) AS n, array_to_string(l, '|') AS skills FROM (SELECT doc_id,
        list_filter(list_transform(string_split(text, ','), lambda s: {S.strip('s')}), lambda s: s <> '') AS l
        FROM documents)""")
def skill_list_parse(spark, sf):
    df = T.documents(spark, sf).select("doc_id", X.skill_list(F.col("text")).alias("l"))
    return df.select("doc_id", F.size("l").alias("n"), F.array_join("l", "|").alias("skills"))


@query("clean_html", f"SELECT page_id, {S.clean_html('html')} AS text FROM pages")
def clean_html(spark, sf):
    return T.pages(spark, sf).select("page_id", X.clean_html(F.col("html")).alias("text"))


@query("sanitize_filename", f"SELECT doc_id, {S.filename('text')} AS name FROM documents")
def sanitize_filename(spark, sf):
    return T.documents(spark, sf).select("doc_id", X.sanitize_filename(F.col("text")).alias("name"))


@query("skill_score", f"SELECT fetch_ord, {S.score_columns('low', T.SKILLS)} FROM "
       f"(SELECT *, lower(title || ' ' || description) AS low FROM ({S.DOC_LISTINGS}))")
def skill_score(spark, sf):
    return J.score_jobs(T.document_listings(spark, sf), T.SKILLS).select("fetch_ord", "skills_matched", "matched_skills")


@query("row_build", f"SELECT source, job_id, title, company, location, url, skills_matched, matched_skills, "
       f"'job_descriptions/' || {S.file_name('source', 'job_id', 'title')} AS description_file FROM "
       f"(SELECT *, {S.score_columns('low', T.SKILLS)} FROM "
       f"(SELECT *, lower(title || ' ' || description) AS low FROM ({S.DOC_LISTINGS}))) WHERE skills_matched > 0")
def row_build(spark, sf):
    return J.build_rows(J.score_jobs(T.document_listings(spark, sf), T.SKILLS))


@query("text_sanitize", f"SELECT doc_id, {S.sanitize('text')} AS text FROM documents")
def text_sanitize(spark, sf):
    return T.documents(spark, sf).select("doc_id", X.text_sanitize(F.col("text")).alias("text"))


@query("input_validate", """
    SELECT doc_id, CASE WHEN toxic = 1 THEN 'null' WHEN quality = 0 THEN 'blank' ELSE 'good' END AS status
    FROM documents LEFT JOIN labels USING (doc_id)""")
def input_validate(spark, sf):
    good, rejects = analyze.validate(T.messy_texts(spark, sf), "text")
    return good.select("doc_id", F.lit("good").alias("status")).unionByName(
        rejects.select("doc_id", F.col("reason").alias("status"))
    )


@query("pii_redact_serving", f"SELECT doc_id, {S.redact_serving('text')} AS text FROM documents")
def pii_redact_serving(spark, sf):
    return T.documents(spark, sf).select("doc_id", R.redact_serving(F.col("text")).alias("text"))


@query("pii_redact_dataset", f"SELECT doc_id, {S.redact_dataset('text')} AS text FROM documents")
def pii_redact_dataset(spark, sf):
    return T.documents(spark, sf).select("doc_id", R.redact_dataset(F.col("text")).alias("text"))


@query("dataset_clean_noner", f"SELECT doc_id AS resume_id, {S.redact_dataset('text')} AS text FROM documents")
def dataset_clean_noner(spark, sf):
    return dataset.prepare_dataset(T.resumes_raw(spark, sf), entity_spans=None).select(
        "resume_id", F.col("Text").alias("text")
    )


def _entity_sql(x: str) -> str:
    # run twice, as neighbours share the separator that the pattern consumes
    for label, phrase in T.GAZETTEER:
        if label in P.PII_LABELS:
            for _ in range(2):
                x = S.replace(x, rf"(?i)(\A|{S.WORD_EDGE}){phrase}(\z|{S.WORD_EDGE})", rf"\1[{label}]\2")
    return x


def _pii_spans(text):
    return E.gazetteer_spans(text, T.GAZETTEER)


@query("entity_redact", f"SELECT doc_id, {_entity_sql('text')} AS text FROM documents")
def entity_redact(spark, sf):
    text = F.col("text")
    return T.documents(spark, sf).select("doc_id", R.redact_spans(text, _pii_spans(text)).alias("text"))


@query("entity_redact_join", f"SELECT doc_id, {_entity_sql('text')} AS text FROM documents")
def entity_redact_join(spark, sf):
    docs = T.documents(spark, sf).select("doc_id", "text")
    return E.redact_entities(docs, "doc_id", "text", E.entity_table(docs, "doc_id", _pii_spans(F.col("text"))))


@query("entity_label_check", "SELECT DISTINCT lang AS label FROM documents WHERE lang NOT IN ('en', 'fr') "
       "AND lang NOT IN (SELECT role FROM conversations)")
def entity_label_check(spark, sf):
    requested = T.load(spark, sf, "documents").select(F.col("lang").alias("label"))
    known = T.load(spark, sf, "conversations").select(F.col("role").alias("label"))
    return E.unknown_labels(requested, known.unionByName(spark.createDataFrame([("en",), ("fr",)], "label string")))


@query("simple_normalize", "SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z\\s]', ' ', 'g'), "
       "'\\s+', ' ', 'g')) AS text FROM documents")
def simple_normalize(spark, sf):
    return T.documents(spark, sf).select("doc_id", X.simple_normalize(F.col("text")).alias("text"))


_STOPS = ", ".join(S.text(w) for w in P.KEYWORD_STOP_WORDS)


@query("stop_alpha_normalize", f"""
    SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_\\p{{M}}]+'),
        lambda w: regexp_matches(w, '\\A\\p{{L}}+\\z') AND NOT list_contains([{_STOPS}], w)), ' ') AS text
    FROM documents""")
def stop_alpha_normalize(spark, sf):
    return T.documents(spark, sf).select(
        "doc_id", X.stop_alpha_normalize(F.col("text"), P.KEYWORD_STOP_WORDS).alias("text")
    )


@query("keyword_tokens", f"SELECT doc_id, array_to_string(list_sort({S.keywords('text')}), ' ') AS words FROM documents")
def keyword_tokens(spark, sf):
    sets = M.keyword_sets(T.documents(spark, sf), "doc_id", "text")
    return sets.select("doc_id", F.array_join("words", " ").alias("words"))


@query("title_company_split", f"""
    SELECT conv_id, turn, {S.title_company('raw')[0]} AS title, {S.title_company('raw')[1]} AS company
    FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text ELSE role || ' : ' || text END AS raw FROM conversations)""")
def title_company_split(spark, sf):
    raw = F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(F.concat_ws(" : ", "role", "text"))
    df = spread(T.load(spark, sf, "conversations")).select("conv_id", "turn", X.title_company(raw).alias("s"))
    return df.select("conv_id", "turn", "s.title", "s.company")


# ---------------------------------------------------------------- joins and dictionary

_QUERY_TERMS = r"""
    qw AS (SELECT item_id, regexp_extract_all(text, '\p{L}+') AS w FROM benchmark),
    qr AS (SELECT item_id * 1000 + g AS row_no, w[g * 6 + 1:g * 6 + 6] AS w
        FROM (SELECT item_id, w, unnest(range((len(w) + 5) // 6)) AS g FROM qw)),
    terms AS (SELECT * FROM (
        SELECT CAST(row_no * 4 AS INTEGER) AS pos, concat_ws(' ', w[1], w[2]) AS skill FROM qr
        UNION ALL SELECT CAST(row_no * 4 + 1 AS INTEGER), w[3] FROM qr
        UNION ALL SELECT CAST(row_no * 4 + 2 AS INTEGER), '.' || w[4] FROM qr
        UNION ALL SELECT CAST(row_no * 4 + 3 AS INTEGER), w[5] || ', ' || w[6] FROM qr) WHERE skill IS NOT NULL)"""


def _marked(x: str) -> str:
    """Every non-word character between chr(1) marks; chr(2) where two of them meet. A single
    chr(1) is then a word boundary."""
    marked = f"regexp_replace({x}, '([^{P.WORD}])', chr(1) || '\\1' || chr(1), 'g')"
    return f"replace(chr(1) || {marked} || chr(1), chr(1) || chr(1), chr(2))"


@query("skill_theta_match", f"""
    WITH {_QUERY_TERMS},
    docs AS (SELECT doc_id, {_marked('lower(text)')} AS low FROM documents),
    marked AS (SELECT pos, skill, replace({_marked('lower(skill)')}, chr(2), chr(1)) AS m FROM terms),
    -- within a skill two symbols may meet as well
    wanted AS (SELECT pos, skill, CASE WHEN contains(skill, ', ') THEN replace(m, ',' || chr(1) || ' ', ',' || chr(2) || ' ')
        ELSE m END AS m FROM marked)
    SELECT doc_id, pos, skill FROM docs JOIN wanted ON contains(low, m)""")
def skill_theta_match(spark, sf):
    return G.whole_word_hits(T.documents(spark, sf), "doc_id", "text", T.query_terms(spark, sf))


_HITS = f"""
    lex AS (SELECT gram, n, arg_min(preferred, (phrase <> gram)::VARCHAR || phrase) AS preferred FROM (
        SELECT phrase, preferred, array_to_string({S.tokens('phrase')}, ' ') AS gram,
            len({S.tokens('phrase')}) AS n FROM dictionary) WHERE n > 0 GROUP BY gram, n),
    doc_tokens AS (SELECT doc_id, TOKENS AS t FROM documents),
    toks AS (SELECT doc_id, unnest(t) AS w, unnest(range(len(t))) AS s FROM doc_tokens),
    grams AS (SELECT doc_id, s, unnest(range(1, 7)) AS n, unnest({S.run_list(6)}) AS gram FROM toks
        WINDOW d AS (PARTITION BY doc_id ORDER BY s)),
    hits AS (SELECT doc_id, gram AS phrase, preferred, CAST(s AS INTEGER) AS start, CAST(s + n AS INTEGER) AS "end"
        FROM grams JOIN lex USING (gram, n)),
    firsts AS (SELECT doc_id, preferred AS skill, min((start, "end")) AS span FROM hits GROUP BY ALL)"""
_RAW_HITS = _HITS.replace("TOKENS", S.tokens("text"))


@query("phrase_match", f'WITH {_ESCO}, {_RAW_HITS} SELECT doc_id, phrase, start, "end" FROM hits')
def phrase_match(spark, sf):
    hits = G.phrase_match(T.documents(spark, sf), "doc_id", "text", G.lexicon(_dictionary(spark, sf)))
    return hits.select("doc_id", "phrase", "start", "end")


@query("skill_canonicalise", f"WITH {_ESCO}, {_RAW_HITS} SELECT doc_id, phrase, preferred, count(*) AS n FROM hits GROUP BY ALL")
def skill_canonicalise(spark, sf):
    hits = G.phrase_match(T.documents(spark, sf), "doc_id", "text", G.lexicon(_dictionary(spark, sf)))
    return hits.groupBy("doc_id", "phrase", "preferred").agg(F.count(F.lit(1)).alias("n"))


@query("first_span_dedup", f"WITH {_ESCO}, {_RAW_HITS} SELECT doc_id, skill, span[1] AS start, span[2] AS \"end\" FROM firsts")
def first_span_dedup(spark, sf):
    hits = G.phrase_match(T.documents(spark, sf), "doc_id", "text", G.lexicon(_dictionary(spark, sf)))
    return G.first_spans(hits, "doc_id")


_FOUND = " UNION ALL ".join(
    rf"""SELECT doc_id, {S.text(p)} AS phrase, CAST(length(before) - 1 AS INTEGER) AS start,
        CAST(length(before) - 1 + {len(p)} AS INTEGER) AS "end" FROM (SELECT doc_id, regexp_extract(' ' || text,
            '(?is)\A(.*?{S.WORD_EDGE}){p}({S.WORD_EDGE}|\z)', 1) AS before FROM documents) WHERE before <> ''"""
    for label, p in T.SKILL_GAZETTEER if label in P.SKILL_LABELS and T.MODEL_SCORES[label] > P.ENTITY_THRESHOLD
)


@query("model_skill_merge", f"""
    WITH {_ESCO}, {_RAW_HITS}, found AS ({_FOUND}),
    named AS (SELECT doc_id, coalesce(preferred, found.phrase) AS skill, start, "end"
        FROM found LEFT JOIN dictionary ON dictionary.phrase = found.phrase),
    fresh AS (SELECT * FROM named ANTI JOIN firsts USING (doc_id, skill)
        QUALIFY row_number() OVER (PARTITION BY doc_id, skill ORDER BY start, "end") = 1)
    SELECT doc_id, skill, 'token' AS unit, span[1] AS start, span[2] AS "end" FROM firsts
    UNION ALL SELECT doc_id, skill, 'char', start, "end" FROM fresh""")
def model_skill_merge(spark, sf):
    return analyze.extract_skills(
        T.documents(spark, sf), "doc_id", "text", G.lexicon(_dictionary(spark, sf)), T.model_entities(spark, sf)
    )


@query("vocab_distinct", "SELECT DISTINCT lower(trim(p_name)) AS term FROM part")
def vocab_distinct(spark, sf):
    return D.vocab_distinct(T.load(spark, sf, "part").select(F.concat(F.upper("p_name"), F.lit(" \t")).alias("t")), "t")


# requests: each resume answers the page of its number, counted round
_PAIR_SCORES = f"""
    pairs AS (SELECT doc_id AS resume_id, page_id AS job_id, {S.keywords('text')} AS r, {S.keywords('html')} AS j
        FROM documents JOIN pages ON page_id = doc_id % (SELECT count(*) FROM pages)),
    scored AS (SELECT resume_id, job_id, CASE WHEN len(j) = 0 THEN 0 ELSE
        CAST(floor(len(list_intersect(j, r)) / len(j) * 100 + 0.5) AS INTEGER) END AS score FROM pairs)"""


def _request_scores(spark, sf) -> DataFrame:
    n_pages = T.load(spark, sf, "pages").count()
    requests = T.load(spark, sf, "documents").select(
        F.col("doc_id").alias("resume_id"), (F.col("doc_id") % n_pages).alias("job_id")
    )
    resumes = M.keyword_sets(T.documents(spark, sf), "doc_id", "text").withColumnRenamed("doc_id", "resume_id")
    jobs = M.keyword_sets(T.pages(spark, sf), "page_id", "html").withColumnRenamed("page_id", "job_id")
    return M.score_pairs(requests, resumes, jobs)


@query("keyword_match_score", f"WITH {_PAIR_SCORES} SELECT resume_id, job_id, score FROM scored")
def keyword_match_score(spark, sf):
    return _request_scores(spark, sf).select("resume_id", "job_id", "score")


@query("match_band", f"WITH {_PAIR_SCORES} SELECT resume_id, job_id, CASE WHEN score >= 70 THEN "
       f"{S.text(P.GREAT_MATCH_TEXT)} ELSE {S.text(P.ADVICE_TEXT)} END AS band FROM scored")
def match_band(spark, sf):
    return _request_scores(spark, sf).select("resume_id", "job_id", "band")


@query("match_pairs", f"""
    WITH r AS (SELECT doc_id AS resume_id, {S.keywords('text')} AS w FROM documents),
    j AS (SELECT item_id AS job_id, {S.keywords('text')} AS w FROM benchmark),
    jw AS (SELECT job_id, len(w) AS n, unnest(w) AS word FROM j),
    rw AS (SELECT resume_id, unnest(w) AS word FROM r),
    scored AS (SELECT resume_id, job_id, CAST(floor(count(*) / any_value(n) * 100 + 0.5) AS INTEGER) AS score
        FROM rw JOIN jw USING (word) GROUP BY resume_id, job_id)
    SELECT resume_id, job_id, score, CAST(row_number() OVER (PARTITION BY resume_id ORDER BY score DESC, job_id)
        AS INTEGER) AS rank FROM scored WHERE score >= 70
    QUALIFY row_number() OVER (PARTITION BY resume_id ORDER BY score DESC, job_id) <= 10""")
def match_pairs(spark, sf):
    resumes = M.keyword_sets(T.documents(spark, sf), "doc_id", "text").withColumnRenamed("doc_id", "resume_id")
    jobs = M.keyword_sets(T.load(spark, sf, "benchmark"), "item_id", "text").withColumnRenamed("item_id", "job_id")
    return M.match_pairs(resumes, jobs)


# ---------------------------------------------------------------- deduplication, ranking, summaries

@query("uid_dedup", """
    SELECT source, job_id, fetch_ord, skills_matched FROM (
        SELECT event_type AS source, CASE WHEN event_id % 3 = 0 THEN '' ELSE props->>'$.k' END AS job_id,
            event_id AS fetch_ord, CAST(floor(value) % 4 AS INTEGER) AS skills_matched FROM events)
    WHERE skills_matched > 0
    QUALIFY row_number() OVER (PARTITION BY source, job_id ORDER BY fetch_ord) = 1""")
def uid_dedup(spark, sf):
    return J.uid_dedup(T.event_listings(spark, sf))


_PART_JOBS = """
    SELECT CASE WHEN p_type <> 'PROMO' THEN p_name END AS title, p_brand AS company, p_type AS location,
        p_size AS skills_matched, p_name AS matched_skills, p_partkey % 3 AS source_ord, p_partkey AS fetch_ord
    FROM part"""
_BEST_FIRST = "skills_matched DESC, source_ord, fetch_ord"


@query("title_company_dedup", f"SELECT title, company, skills_matched, fetch_ord FROM ({_PART_JOBS}) "
       f"QUALIFY row_number() OVER (PARTITION BY title, company ORDER BY {_BEST_FIRST}) = 1")
def title_company_dedup(spark, sf):
    return J.title_company_dedup(T.part_jobs(spark, sf)).select("title", "company", "skills_matched", "fetch_ord")


@query("rank_jobs", f"SELECT title, company, skills_matched, fetch_ord FROM ({_PART_JOBS}) ORDER BY {_BEST_FIRST}")
def rank_jobs(spark, sf):
    return J.rank_jobs(T.part_jobs(spark, sf)).select("title", "company", "skills_matched", "fetch_ord")


@query("top10_jobs", f"SELECT title, company, location, skills_matched, matched_skills FROM ({_PART_JOBS}) "
       f"ORDER BY {_BEST_FIRST} LIMIT 10")
def top10_jobs(spark, sf):
    return J.top_jobs(T.part_jobs(spark, sf))


_DOC_MATCHING = S.matching(S.DOC_LISTINGS, T.SKILLS)
_DOC_JOBS = S.unique_jobs(S.DOC_LISTINGS, T.SKILLS)


@query("jobs_total", f"SELECT count(*) AS total FROM ({_DOC_JOBS})")
def jobs_total(spark, sf):
    return _doc_report(spark, sf).total()


@query("jobs_by_source", f"SELECT source, count(*) AS n, least(count(*), 40) AS bar FROM ({_DOC_JOBS}) GROUP BY source")
def jobs_by_source(spark, sf):
    return _doc_report(spark, sf).by_source().withColumn("bar", F.col("bar").cast("long"))


@query("skill_score_distribution", f"SELECT skills_matched, count(*) AS n, least(count(*), 40) AS bar "
       f"FROM ({_DOC_JOBS}) GROUP BY skills_matched")
def skill_score_distribution(spark, sf):
    return _doc_report(spark, sf).by_score().withColumn("bar", F.col("bar").cast("long"))


@query("matches_per_source", f"SELECT source, count(*) AS n FROM ({_DOC_MATCHING}) GROUP BY source")
def matches_per_source(spark, sf):
    return _doc_report(spark, sf).matches_per_source()


@query("source_union", S.all_listings())
def source_union(spark, sf):
    return feeds.normalise(T.landed_all(spark, sf))


@query("aggregate_jobs", f"SELECT source, job_id, title, company, location, url, skills_matched, matched_skills, "
       f"'job_descriptions/' || {S.file_name('source', 'job_id', 'title')} AS description_file "
       f"FROM ({S.unique_jobs(S.all_listings(), T.SKILLS)})")
def aggregate_jobs(spark, sf):
    return aggregate.aggregate_jobs(T.landed_all(spark, sf), T.SKILLS, max_pages=None).ranked()


# ---------------------------------------------------------------- splits, terms, metrics

def _split_sql(select: str) -> str:
    return f"""
    SELECT doc_id, source, {select} FROM (SELECT doc_id, source,
        row_number() OVER (PARTITION BY source ORDER BY md5('420:' || doc_id), doc_id) AS rn,
        count(*) OVER (PARTITION BY source) AS n FROM documents)"""


def _classed(spark, sf) -> DataFrame:
    return T.load(spark, sf, "documents").select("doc_id", "source")


@query("stratified_split", _split_sql("rn <= (n * 30 + 99) // 100 AS is_test"))
def stratified_split(spark, sf):
    return SP.stratified_split(_classed(spark, sf), "source", "doc_id")


_FOLD = "CAST((rn > n // 5)::INT + (rn > n * 2 // 5)::INT + (rn > n * 3 // 5)::INT + (rn > n * 4 // 5)::INT AS INTEGER) AS fold"


@query("stratified_kfold", _split_sql(_FOLD))
def stratified_kfold(spark, sf):
    return SP.stratified_kfold(_classed(spark, sf), "source", "doc_id")


@query("label_distribution", f"""
    WITH parts AS ({_split_sql("CASE WHEN rn <= (n * 30 + 99) // 100 THEN 'test' ELSE 'train' END AS part")})
    SELECT part, source AS label, count(*) AS n FROM parts GROUP BY CUBE (part, source)""")
def label_distribution(spark, sf):
    split = SP.stratified_split(_classed(spark, sf), "source", "doc_id")
    return MT.label_distribution(split.withColumn("part", F.when(F.col("is_test"), "test").otherwise("train")), "source", "part")


@query("augment_union", f"""
    WITH parts AS ({_split_sql("rn > (n * 30 + 99) // 100 AS is_train")})
    SELECT text AS Text, parts.source AS Mapped_Category FROM parts JOIN documents USING (doc_id) WHERE is_train
    UNION ALL SELECT text, role FROM conversations""")
def augment_union(spark, sf):
    rows = T.documents(spark, sf).select("doc_id", F.col("text").alias("Text"), F.col("source").alias("Mapped_Category"))
    training = SP.stratified_split(rows, "Mapped_Category", "doc_id").where("not is_test")
    synthetic = T.load(spark, sf, "conversations").select(F.col("text").alias("Resume_str"), F.col("role").alias("Category"))
    return dataset.augment(training, synthetic)


@query("class_weights", """
    SELECT CAST(label AS INTEGER) AS label, n, round(total / (k * n), 9) AS weight FROM (
        SELECT label, count(*) AS n, sum(count(*)) OVER () AS total, count(*) OVER () AS k FROM embeddings GROUP BY label)""")
def class_weights(spark, sf):
    df = MT.class_weights(T.load(spark, sf, "embeddings"), "label")
    return df.withColumn("weight", F.round("weight", 9))


_TERMS = """
    docs AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' '),
        lambda w: length(w) > 1) AS t FROM documents),
    toks AS (SELECT doc_id, unnest(t) AS w, unnest(range(len(t))) AS s FROM docs),
    runs AS (SELECT doc_id, unnest(""" + S.run_list(3) + """) AS term FROM toks
        WINDOW d AS (PARTITION BY doc_id ORDER BY s)),
    grams AS (SELECT * FROM runs WHERE term IS NOT NULL),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
    total AS (SELECT count(*) AS n FROM documents),
    stats AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term),
    vocabulary AS (SELECT term, df, cf, ln((1 + n) / (1 + df)) + 1 AS idf FROM stats, total
        WHERE df >= 2 AND df <= 0.95 * n ORDER BY cf DESC, term LIMIT 5000)"""


@query("term_stats", f"WITH {_TERMS} SELECT term, df, cf, round(idf, 6) AS idf FROM vocabulary")
def term_stats(spark, sf):
    return FT.term_stats(T.documents(spark, sf), "text").withColumn("idf", F.round("idf", 6))


@query("tfidf", f"""
    WITH {_TERMS}, weights AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN vocabulary USING (term))
    SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM weights""")
def tfidf(spark, sf):
    return FT.tfidf(T.documents(spark, sf), "doc_id", "text").withColumn("tfidf", F.round("tfidf", 6))


@query("fold_vocabularies", f"""
    WITH {_TERMS}, folds AS ({_split_sql(_FOLD)}),
    own AS (SELECT fold, term, count(*) AS df, sum(tf) AS cf FROM tf JOIN folds USING (doc_id) GROUP BY ALL),
    parts AS (SELECT fold, count(*) AS size FROM folds GROUP BY fold),
    training AS (SELECT p.fold, s.term, s.df - coalesce(own.df, 0) AS df, s.cf - coalesce(own.cf, 0) AS cf, n - size AS texts
        FROM parts p CROSS JOIN stats s CROSS JOIN total LEFT JOIN own ON own.fold = p.fold AND own.term = s.term)
    SELECT fold, term, CAST(df AS BIGINT) AS df, CAST(cf AS BIGINT) AS cf FROM training WHERE df >= 2 AND df <= 0.95 * texts
    QUALIFY row_number() OVER (PARTITION BY fold ORDER BY cf DESC, term) <= 5000""")
def fold_vocabularies(spark, sf):
    folds = SP.stratified_kfold(T.documents(spark, sf).select("doc_id", "source", "text"), "source", "doc_id")
    return FT.fold_vocabularies(folds, "text", "fold")


# given predictions: the class with the highest of ten given scores
_PREDICTED = """
    scored AS (SELECT vec_id, label, list_transform(range(10), lambda c: list_sum(list_transform(
        list_filter(embedding, lambda x, i: (i - 1) % 10 = c), lambda x: CAST(x AS DOUBLE)))) AS s FROM embeddings),
    predicted AS (SELECT vec_id, label, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS prediction, s FROM scored)"""


def _predicted(spark, sf) -> DataFrame:
    return T.class_scores(spark, sf).withColumn("prediction", C.argmax(F.col("scores")))


@query("classification_report", f"""
    WITH {_PREDICTED},
    classes AS (SELECT label AS c FROM predicted UNION SELECT prediction FROM predicted),
    per AS (SELECT c, (SELECT count(*) FROM predicted WHERE label = c AND prediction = c) AS hits,
        (SELECT count(*) FROM predicted WHERE prediction = c) AS chosen,
        (SELECT count(*) FROM predicted WHERE label = c) AS support FROM classes),
    shares AS (SELECT c, support, hits, CASE WHEN chosen = 0 THEN 0 ELSE hits / chosen END AS p,
        CASE WHEN support = 0 THEN 0 ELSE hits / support END AS r, 2 * hits / (support + chosen) AS f FROM per)
    SELECT CAST(c AS VARCHAR) AS label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM shares
    UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hits) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM shares
    UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM shares
    UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
        round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM shares""")
def classification_report(spark, sf):
    report = MT.classification_report(_predicted(spark, sf), "label", "prediction")
    return report.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("confusion_matrix", f"WITH {_PREDICTED} SELECT CAST(label AS INTEGER) AS label, "
       + ", ".join(f"count(*) FILTER (prediction = {c}) AS p_{c}" for c in range(10)) + " FROM predicted GROUP BY label")
def confusion_matrix(spark, sf):
    return MT.confusion_matrix(_predicted(spark, sf), "label", "prediction", list(range(10)))


@query("topk_accuracy", f"""
    WITH {_PREDICTED}, ranked AS (SELECT 1 + len(list_filter(s, lambda x, i: x > s[label + 1]
        OR (x = s[label + 1] AND i < label + 1))) AS rank FROM predicted)
    SELECT CAST(k AS INTEGER) AS k, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END), 6) AS accuracy
    FROM ranked, range(1, 6) AS ks(k) GROUP BY k""")
def topk_accuracy(spark, sf):
    df = T.class_scores(spark, sf)
    result = MT.topk_accuracy(df, C.label_rank(F.col("scores"), F.col("label")), [1, 2, 3, 4, 5])
    return result.withColumn("accuracy", F.round("accuracy", 6))


@query("topk_categories", f"""
    WITH {_PREDICTED}, ranked AS (SELECT vec_id, list_reverse_sort(list_transform(s, lambda x, i: {{'x': x, 'i': -i}})) AS o
        FROM predicted)
    SELECT vec_id, 'class ' || (-o[1].i - 1) || '|class ' || (-o[2].i - 1) AS categories FROM ranked""")
def topk_categories(spark, sf):
    best = C.top_k_classes(F.col("scores"), [f"class {i}" for i in range(10)])
    return T.class_scores(spark, sf).select("vec_id", F.array_join(best, "|").alias("categories"))


@query("decision_scores", f"""
    WITH {_PREDICTED} SELECT vec_id, CAST(i AS INTEGER) AS class, round(s[i + 1], 6) AS score FROM predicted, range(10) AS r(i)""")
def decision_scores(spark, sf):
    rows = T.load(spark, sf, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"))
    width = len(rows.first()["features"])
    # a row of weights a class, the intercept last
    weights = [float(i % 10 == c and i < width) for c in range(10) for i in range(width + 1)]
    scored = svm.BlockSvmModel(weights=weights, classes=10).transform(rows)
    return scored.select("vec_id", F.posexplode(L.decision_scores(scored)).alias("class", "score")).withColumn(
        "score", F.round("score", 6)
    )


# ---------------------------------------------------------------- learning and analysis

def _labelled(spark, sf) -> DataFrame:
    return T.documents(spark, sf).select("doc_id", F.col("lang").alias("class"), "text")


def _fitted(spark, sf):
    """(text model, labelled rows) fitted on the languages of all documents; the model takes raw texts."""
    rows = _labelled(spark, sf)
    steps = [stages.RedactText(inputCol="text", outputCol="clean"), stages.NormalizeText(inputCol="clean", outputCol="plain")]
    return train.fit_text_model(rows, "class", "text", steps=steps), rows


def _trained(spark, sf, costs, weights, penalties) -> train.Training:
    return train.train_classifier(
        _labelled(spark, sf), "doc_id", "class", "text", costs=costs, class_weights=weights, penalties=penalties, folds=P.FOLDS,
    )


def _learned_sql(points: list[dict]) -> str:
    return "SELECT * FROM " + S.values([(json.dumps(p, sort_keys=True), True) for p in points], "t(params, learned)")


def _learned(scores: DataFrame) -> DataFrame:
    """Whether each point of the grid tells languages apart better than by chance, twice as well at least."""
    return scores.select("params", (F.col("mean_score") > 2 / len(_CLASSES)).alias("learned"))


# a model whose scores SQL can restate: counts of letter groups times whole numbers, an intercept last
_GROUPS = ["th", "ch", "os", "que", "e"]
_GROUP_WEIGHTS = [[0, 9, 0, 0, 1, 0], [9, 0, 0, 0, 0, 3], [0, 0, 9, 0, 0, 2], [0, 0, 1, 9, 0, 1]]
_CLASSES = ["de", "en", "es", "fr"]


def _group_model(spark) -> PipelineModel:
    counts = ", ".join(f"CAST((length(text) - length(replace(text, '{g}', ''))) / {len(g)} AS DOUBLE) AS n{i}" for i, g in enumerate(_GROUPS))
    return PipelineModel(stages=[
        SQLTransformer(statement=f"SELECT *, {counts} FROM __THIS__"),
        VectorAssembler(inputCols=[f"n{i}" for i in range(len(_GROUPS))], outputCol="features"),
        svm.BlockSvmModel(weights=[float(x) for row in _GROUP_WEIGHTS for x in row], classes=len(_CLASSES)),
        IndexToString(inputCol="prediction", outputCol="category", labels=_CLASSES),
    ])


def _group_categories(x: str) -> str:
    """SQL of the model's two best classes of text ``x``."""
    counts = [f"(length({x}) - length(replace({x}, '{g}', ''))) // {len(g)}" for g in _GROUPS]
    scores = ", ".join(
        f"{{'s': -({' + '.join(f'{w} * ({n})' for w, n in zip(row, counts))} + {row[-1]}), 'i': {i}}}" for i, row in enumerate(_GROUP_WEIGHTS)
    )
    names = "[" + ", ".join(map(S.text, _CLASSES)) + "]"
    return f"array_to_string(list_transform(list_sort([{scores}])[1:2], lambda b: {names}[b.i + 1]), '|')"


@query("fold_sizes", """
    WITH r AS (SELECT lang AS class, row_number() OVER (PARTITION BY lang ORDER BY md5('420:' || doc_id), doc_id) AS rn,
            count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE lang IS NOT NULL),
    t AS (SELECT class, n, (n * 30 + 99) // 100 AS test FROM r GROUP BY ALL),
    k AS (SELECT class, false AS is_test, CAST(f AS INTEGER) AS fold, (n - test) * (f + 1) // 5 - (n - test) * f // 5 AS n
        FROM t, range(5) s(f))
    SELECT class, true AS is_test, CAST(NULL AS INTEGER) AS fold, CAST(test AS BIGINT) AS n FROM t
    UNION ALL SELECT class, is_test, fold, CAST(n AS BIGINT) FROM k WHERE n > 0""")
def fold_sizes(spark, sf):
    parts = train.parts(_labelled(spark, sf), "doc_id", "class", "text", P.FOLDS)
    return parts.groupBy("class", "is_test", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("analysis_status", """
    SELECT doc_id, CASE WHEN toxic = 1 THEN 'null' WHEN quality = 0 THEN 'blank' ELSE 'answered' END AS status
    FROM documents LEFT JOIN labels USING (doc_id)""")
def analysis_status(spark, sf):
    return analyze.statuses(T.messy_texts(spark, sf), "doc_id", "text")


# a network of two layers over the counts of small letters; its weights are such that single precision is exact
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_HIDDEN = [[((5 * i + 3 * j + i * j) % 9 - 4) / 4 for i in range(26)] for j in range(6)]
_OUT = [[((2 * j + k) % 5 - 2) / 2 for j in range(6)] for k in range(3)]


def _letter_network():
    import numpy as np

    hidden, out = np.array(_HIDDEN, "float32"), np.array(_OUT, "float32")

    def encode(texts: list[str]):
        counts = np.array([[t.count(x) for x in _LETTERS] for t in texts], "float32")
        return np.maximum(counts @ hidden.T, 0) @ out.T

    return encode


FT.register_model("letters", _letter_network)


@query("embed_text", f"""
    WITH counts AS (SELECT doc_id, [CAST(length(text) - length(replace(text, x, '')) AS DOUBLE) for x in {list(_LETTERS)}] AS c FROM documents),
    hidden AS (SELECT doc_id, [{", ".join(f"greatest(list_dot_product(c, {row}), 0)" for row in _HIDDEN)}] AS h FROM counts)
    SELECT doc_id, {", ".join(f"list_dot_product(h, {row}) AS dim{k}" for k, row in enumerate(_OUT))} FROM hidden""")
def embed_text(spark, sf):
    embedded = T.documents(spark, sf).select("doc_id", FT.embed_with(F.col("text"), "letters").alias("embedding"))
    return embedded.select("doc_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"dim{i}") for i in range(3)])


@query("train_svc", "SELECT lang AS class, count(*) AS n, true AS learned FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def train_svc(spark, sf):
    model, rows = _fitted(spark, sf)
    right = F.avg((F.col("category") == F.col("class")).cast("double"))
    return model.transform(rows).groupBy("class").agg(F.count(F.lit(1)).alias("n"), (right > 0.9).alias("learned"))


@query("grid_search", _learned_sql(L.svm_points()))
def grid_search(spark, sf):
    return _learned(_trained(spark, sf, L.COSTS, L.CLASS_WEIGHTS, L.PENALTIES).scores)


@query("cv_scores", _learned_sql(L.svm_points([0.3], ["balanced", "none"], ["l2"])))
def cv_scores(spark, sf):
    return _learned(_trained(spark, sf, [0.3], ["balanced", "none"], ["l2"]).scores)


_TERM_GRID = {"max_ns": [1, 3], "min_dfs": [2, 5], "sizes": [500, 3000], "costs": [0.5, 5.0]}


@query("term_grid_search", _learned_sql(L.term_points(**_TERM_GRID)))
def term_grid_search(spark, sf):
    return _learned(train.train_on_terms(_labelled(spark, sf), "doc_id", "class", "text", folds=P.FOLDS, **_TERM_GRID).scores)


@query("model_save_load", "SELECT doc_id, true AS same FROM documents")
def model_save_load(spark, sf):
    model, rows = _fitted(spark, sf)
    path = scratch_path(spark, "model")
    L.save_model(model, path)
    before, after = (
        m.transform(rows).select("doc_id", "category", vector_to_array("rawPrediction").alias("scores")) for m in (model, L.load_model(path))
    )
    return before.join(after, "doc_id").select(
        "doc_id", ((before["category"] == after["category"]) & (before["scores"] == after["scores"])).alias("same")
    )


@query("classify_resumes", f"""
    WITH clean AS (SELECT doc_id, {S.redact_serving('text')} AS t FROM documents)
    SELECT doc_id, {_group_categories('t')} AS categories FROM clean""")
def classify_resumes(spark, sf):
    return analyze.classify_resumes(T.documents(spark, sf).select("doc_id", "text"), "doc_id", "text", _group_model(spark)).select(
        "doc_id", F.array_join("categories", "|").alias("categories")
    )


@query("train_classifier", """
    WITH n AS (SELECT lang AS label, (count(*) * 30 + 99) // 100 AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang)
    SELECT label, CAST(n AS BIGINT) AS support, true AS learned FROM n
    UNION ALL SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), CAST(sum(n) AS BIGINT), true FROM n""")
def train_classifier(spark, sf):
    report = _trained(spark, sf, [0.3], ["balanced"], ["l2"]).report()
    return report.select("label", "support", (F.col("f1") > 0.9).alias("learned"))


def _skill_text(df: DataFrame, *columns: str) -> DataFrame:
    """The skill map as sorted "skill@start-end" text."""
    entries = F.transform(
        F.array_sort(F.map_entries("skills")),
        lambda e: F.concat(e["key"], F.lit("@"), e["value"]["start"], F.lit("-"), e["value"]["end"]),
    )
    return df.select(*columns, F.array_join(entries, "|").alias("skills"))


@query("analyze_jobs", f"""
    WITH {_ESCO}, {_HITS.replace("TOKENS", S.tokens(S.sanitize('text')))},
    maps AS (SELECT doc_id, string_agg(skill || '@' || span[1] || '-' || span[2], '|' ORDER BY skill) AS skills
        FROM firsts GROUP BY doc_id)
    SELECT doc_id, {S.sanitize('text')} AS cleaned_job_desc, coalesce(skills, '') AS skills, '' AS education
    FROM documents LEFT JOIN maps USING (doc_id)""")
def analyze_jobs(spark, sf):
    result = analyze.analyze_jobs(T.documents(spark, sf), "doc_id", "text", G.lexicon(_dictionary(spark, sf)))
    return _skill_text(result, "doc_id", "cleaned_job_desc", "education")


@query("analyze_resumes", f"""
    WITH {_ESCO}, redacted AS (SELECT doc_id, {S.redact_serving('text')} AS t FROM documents),
    clean AS (SELECT doc_id, {_entity_sql('t')} AS cleaned FROM redacted),
    again AS (SELECT doc_id, {S.redact_serving('cleaned')} AS t FROM clean),
    twice AS (SELECT doc_id, {_entity_sql('t')} AS t FROM again),
    {_HITS.replace("TOKENS", S.tokens('cleaned')).replace("AS t FROM documents", "AS t FROM clean")},
    maps AS (SELECT doc_id, string_agg(skill || '@' || span[1] || '-' || span[2], '|' ORDER BY skill) AS skills
        FROM firsts GROUP BY doc_id)
    SELECT doc_id, cleaned AS cleaned_resume, '' AS education, {_group_categories('t')} AS categories, coalesce(skills, '') AS skills
    FROM clean JOIN twice USING (doc_id) LEFT JOIN maps USING (doc_id)""")
def analyze_resumes(spark, sf):
    result = analyze.analyze_resumes(
        T.documents(spark, sf).select("doc_id", "text"), "doc_id", "text", _group_model(spark), G.lexicon(_dictionary(spark, sf)),
        entity_spans=_pii_spans,
    )
    return _skill_text(result.withColumn("categories", F.array_join("categories", "|")),
                       "doc_id", "cleaned_resume", "education", "categories")

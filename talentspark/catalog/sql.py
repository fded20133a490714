"""SQL building blocks of the checks: the text rules restated for DuckDB."""

from talentspark.functions import patterns as P
from talentspark.functions.redact import PHONE_DATASET, PHONE_SERVING

WORD_EDGE = rf"[^{P.WORD}]"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def replace(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {text(pattern)}, {text(by)}, 'g')"


def strip(x: str) -> str:
    return replace(x, rf"\A[{P.WHITESPACE}]+|[{P.WHITESPACE}]+\z", "")


def clean_html(x: str) -> str:
    return strip(replace(f"coalesce({x}, '')", "<[^>]+>", " "))


def sanitize(x: str) -> str:
    return f"trim({replace(replace(x, f'[^{P.PROSE_KEPT}]', ''), f'[{P.WHITESPACE}]+', ' ')}, ' ')"


def redact_serving(x: str) -> str:
    out = sanitize(x)
    for pattern, label in [
        (P.ADDRESS, "[ADDRESS]"), (PHONE_SERVING, "[PHONE]"), (P.ZIP, "[ZIP]"), (P.POBOX, "[POBOX]"), (P.EMAIL, "[EMAIL]"),
    ]:
        out = replace(out, pattern, label)
    return out


def redact_dataset(x: str) -> str:
    out = sanitize(x)
    for pattern, label in [
        (P.EMAIL, "[EMAIL]"), (PHONE_DATASET, "[PHONE]"), (P.POBOX, "[ADDRESS]"), (P.ADDRESS, "[ADDRESS]"), (P.ZIP, "[ZIP]"),
    ]:
        out = replace(out, pattern, label)
    return out


def filename(x: str) -> str:
    named = f"CASE WHEN {x} IS NULL OR {x} = '' THEN 'unknown' ELSE {x} END"
    kept = strip(replace(named, rf"[^{P.WORD}{P.WHITESPACE}-]", ""))
    cut = f"substring({replace(kept, f'[{P.WHITESPACE}]+', '_')}, 1, 60)"
    return f"coalesce(nullif({cut}, ''), 'unnamed')"


def file_name(source: str, job_id: str, title: str) -> str:
    return f"{filename(f'''replace(lower({source}), ' ', '_') || '_' || {job_id}''')} || '_' || {filename(title)} || '.txt'"


def _quoted(literal: str) -> str:
    return "".join(ch if ch.isalnum() or ch in "_ " else "\\" + ch for ch in literal)


def whole_word(x: str, literal: str) -> str:
    """Whether the lower-cased text ``x`` holds ``literal`` between word boundaries."""
    low = literal.lower()
    before = rf"(\A|{WORD_EDGE})" if low[0].isalnum() else f"[{P.WORD}]"
    after = rf"(\z|{WORD_EDGE})" if low[-1].isalnum() else f"[{P.WORD}]"
    return f"regexp_matches({x}, {text(before + _quoted(low) + after)})"


def score_columns(x: str, skills: list[str]) -> str:
    """skills_matched and matched_skills of the lower-cased text column ``x``."""
    count = " + ".join(f"CAST({whole_word(x, s)} AS INTEGER)" for s in skills)
    names = ", ".join(f"CASE WHEN {whole_word(x, s)} THEN {text(s)} END" for s in skills)
    return f"CAST({count} AS INTEGER) AS skills_matched, concat_ws(', ', {names}) AS matched_skills"


TOKEN = rf"[\p{{L}}\p{{M}}\p{{N}}]+|[^{P.WHITESPACE}\p{{L}}\p{{M}}\p{{N}}]"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {text(TOKEN)})"


def run_list(max_n: int) -> str:
    """The runs of 1..max_n tokens ``w`` that start here, over the window ``d``; null past the end."""
    following = [f" || ' ' || lead(w, {k}) OVER d" for k in range(1, max_n)]
    return "[" + ", ".join("w" + "".join(following[:n]) for n in range(max_n)) + "]"


def keywords(x: str) -> str:
    """Distinct keywords as a list."""
    kept = replace(f"lower({x})", f"[^a-z0-9{P.WEB_WHITESPACE}]", "")
    stops = ", ".join(text(w) for w in P.KEYWORD_STOP_WORDS)
    return (
        f"list_distinct(list_filter(regexp_extract_all({kept}, '[a-z0-9]+'), "
        f"lambda w: length(w) > 2 AND NOT list_contains([{stops}], w)))"
    )


def values(rows: list[tuple], columns: str) -> str:
    listed = ", ".join("(" + ", ".join(text(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
    return f"(VALUES {listed}) AS {columns}"


def title_company(x: str) -> tuple[str, str]:
    cut = f"strpos({x}, ':')"
    title = f"CASE WHEN {cut} > 0 THEN {strip(f'substring({x}, {cut} + 1)')} ELSE {x} END"
    company = f"CASE WHEN {cut} > 0 THEN {strip(f'substring({x}, 1, {cut} - 1)')} ELSE '' END"
    return title, company


PAGES = (
    "SELECT page_id, url, html, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, "
    "regexp_extract(url, '^https?://([^/?#]+)', 1) AS company, page_id % 4 AS v FROM pages"
)

WWR_RAW = "CASE WHEN v = 1 THEN title ELSE company || ': ' || title || CASE WHEN v = 2 THEN ': II' ELSE '' END END"

# feed -> what its listings must be, from the row of ``pages`` and its ``id`` text
FEED_SQL = {
    "arbeitnow": dict(
        source="Arbeitnow", job_id="'job-' || id", location="CASE v WHEN 0 THEN 'Remote' WHEN 1 THEN 'Berlin' WHEN 2 THEN 'Paris' ELSE '' END"),
    "jobicy": dict(source="Jobicy", location="CASE WHEN v = 3 THEN 'Remote' ELSE 'Geo' || v END"),
    "remoteok": dict(
        source="RemoteOK", location="CASE WHEN v < 2 THEN 'Remote' ELSE 'Lisbon' END",
        url="'https://remoteok.com/remote-jobs/' || id"),
    "themuse": dict(source="The Muse", location="CASE v WHEN 2 THEN 'Oslo' WHEN 3 THEN 'Rome' ELSE 'Remote' END"),
    "himalayas": dict(
        source="Himalayas", job_id="CASE WHEN v = 0 THEN id ELSE 'job-' || id END",
        location="CASE v WHEN 2 THEN 'Peru, Chile' WHEN 3 THEN 'Cuba' ELSE 'Remote (Worldwide)' END",
        url="CASE WHEN v = 1 THEN url ELSE url || '#apply' END"),
    "weworkremotely": dict(
        source="We Work Remotely", job_id="CASE WHEN v = 0 THEN id || '/link' ELSE 'g-' || id END",
        title=title_company(strip(WWR_RAW))[0], company=title_company(strip(WWR_RAW))[1],
        location="CASE WHEN v = 2 THEN 'Remote (US-friendly)' ELSE 'Anywhere' END", url="id || '/link'"),
    "findwork": dict(
        source="Findwork.dev", location="CASE WHEN v = 1 THEN 'Remote' ELSE 'Quito' END",
        description=strip("html || ' Skills: ' || CASE WHEN v = 0 THEN '' ELSE 'k, v' || v END")),
    "usajobs": dict(
        source="USAJobs", location="CASE WHEN v < 2 THEN 'USA' ELSE 'Austin' END",
        description=clean_html(
            "CASE WHEN v = 3 THEN '' ELSE '<b>' || title || '</b>' END || ' ' || CASE WHEN v = 2 THEN '' ELSE html END")),
    "adzuna": dict(source="Adzuna", location="CASE WHEN v = 1 THEN '' ELSE 'Utah' END"),
}
FEED_DEFAULTS = dict(job_id="id", title="title", company="company", url="url", description=clean_html("html"))


def feed_columns(key: str) -> dict[str, str]:
    return {**FEED_DEFAULTS, **FEED_SQL[key]}


def feed_listings(key: str) -> str:
    """Listings of all pages as one feed, in the order of page_id."""
    c = feed_columns(key)
    return (
        f"SELECT {text(c['source'])} AS source, ((page_id // 20 + 1) << 20) + page_id % 20 AS fetch_ord, "
        + ", ".join(f"{c[k]} AS {k}" for k in ("job_id", "title", "company", "location", "url", "description"))
        + f" FROM (SELECT *, CAST(page_id AS VARCHAR) AS id FROM ({PAGES}))"
    )


def all_listings() -> str:
    """Pages dealt out to the nine feeds."""
    parts = []
    for ord_, key in enumerate(FEED_SQL):
        c = feed_columns(key)
        parts.append(
            f"SELECT {text(c['source'])} AS source, {ord_} AS source_ord, "
            "((seq // 20 + 1) << 20) + seq % 20 AS fetch_ord, "
            + ", ".join(f"{c[k]} AS {k}" for k in ("job_id", "title", "company", "location", "url", "description"))
            + f" FROM dealt WHERE feed = {ord_}"
        )
    return (
        f"WITH dealt AS (SELECT *, page_id % 9 AS feed, page_id // 9 AS seq, CAST((page_id // 9) // 2 AS VARCHAR) AS id FROM ({PAGES})) "
        + " UNION ALL ".join(parts)
    )


DOC_LISTINGS = (
    "SELECT source, CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) AS source_ord, doc_id AS fetch_ord, "
    "CAST(doc_id // 40 AS VARCHAR) AS job_id, substring(text, 1, 12) AS title, lang AS company, "
    "'In ' || lang AS location, 'https://jobs.example.com/' || doc_id AS url, text AS description FROM documents"
)


def matching(listings: str, skills: list[str]) -> str:
    """Scored listings, the first matching one per source and id."""
    return (
        f"SELECT * FROM (SELECT *, {score_columns('low', skills)} FROM "
        f"(SELECT *, lower(title || ' ' || description) AS low FROM ({listings}))) WHERE skills_matched > 0 "
        "QUALIFY row_number() OVER (PARTITION BY source, job_id ORDER BY fetch_ord) = 1"
    )


def unique_jobs(listings: str, skills: list[str]) -> str:
    return (
        f"SELECT * FROM ({matching(listings, skills)}) QUALIFY row_number() OVER "
        "(PARTITION BY title, company ORDER BY skills_matched DESC, source_ord, fetch_ord) = 1"
    )

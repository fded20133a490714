import json

from talentspark.operators import jobs as J
from talentspark.plans.aggregate import report
from talentspark.sources import feeds, landing

RSS = (
    '<?xml version="1.0"?><rss version="2.0"><channel><title>Feed</title>'
    '<item><title> Acme: Dev: Ops </title><guid isPermaLink="false">g1</guid><link>http://x/1</link><region></region>'
    "<description><![CDATA[<p>Hi</p> there]]></description></item>{more}</channel></rss>"
)
SOLO = "<item><title>Solo</title><link>http://x/2</link><region>EU</region><description>d</description></item>"


def land(spark, *rows):
    """rows of (source, skill, page, body)"""
    return spark.createDataFrame(
        [(s, k, 0, p, b if isinstance(b, str) or b is None else json.dumps(b)) for s, k, p, b in rows],
        landing.LANDED_SCHEMA,
    )


def listings(df, key):
    return [r.asDict() for r in feeds.normalise(df, key).orderBy("fetch_ord").collect()]


def test_remote_and_missing_fields(spark):
    got = listings(land(spark, ("Arbeitnow", None, 1, {"data": [
        {"slug": "s", "title": "T", "company_name": "C", "remote": True, "location": "L", "description": "<p>a</p>"},
        {"slug": "t", "remote": False, "location": "L"}, {}]})), "arbeitnow")
    assert [(g["job_id"], g["location"], g["description"]) for g in got] == [("s", "Remote", "a"), ("t", "L", ""), ("", "", "")]


def test_notice_and_odd_elements_are_skipped(spark):
    got = listings(land(spark, ("RemoteOK", None, 1, [
        {"legal": "x"}, "text", {"id": 5, "location": ""}, {"id": "6", "location": "Rome"}])), "remoteok")
    assert [(g["job_id"], g["location"], g["url"]) for g in got] == [
        ("5", "Remote", "https://remoteok.com/remote-jobs/5"), ("6", "Rome", "https://remoteok.com/remote-jobs/6")]


def test_rss_items(spark):
    df = land(spark, ("We Work Remotely", "Design", 1, RSS.format(more=SOLO)), ("We Work Remotely", "Data", 1, RSS.format(more="")))
    got = listings(df, "weworkremotely")
    assert [(g["job_id"], g["company"], g["title"], g["location"], g["description"]) for g in got[:3]] .count(
        ("g1", "Acme", "Dev: Ops", "Remote (US-friendly)", "Hi  there")) == 2
    assert ("http://x/2", "", "Solo", "EU", "d") in [
        (g["job_id"], g["company"], g["title"], g["location"], g["description"]) for g in got]


def test_rss_files(spark, tmp_path):
    for category, page, name in (("Design", 2, "a.rss"), ("Programming", 1, "b.xml"), ("DevOps %2F Sysadmin", 1, "c.rss")):
        folder = tmp_path / f"category={category}" / f"page={page}"
        folder.mkdir(parents=True)
        (folder / name).write_text(RSS.format(more=SOLO) if category == "Design" else "<rss><oops" if page == 3 else RSS.format(more=""))
    rows = feeds.rss_listings(feeds.read_rss(spark, str(tmp_path))).orderBy("fetch_ord").collect()
    assert [(r.company, r.title) for r in rows] == [("Acme", "Dev: Ops")] * 3 + [("", "Solo")]
    assert [r.fetch_ord for r in rows] == [1 << 20, (1 << 44) + (1 << 20), (2 << 44) + (2 << 20), (2 << 44) + (2 << 20) + 1]


def test_nested_feeds(spark):
    got = listings(land(spark, ("USAJobs", "py", 1, {"SearchResult": {"SearchResultItems": [
        {"MatchedObjectDescriptor": {"PositionID": "p", "PositionLocation": [{"LocationName": "DC"}],
                                     "QualificationSummary": "q<br>", "UserArea": {"Details": {"JobSummary": "js"}}}},
        {"MatchedObjectDescriptor": {"PositionID": "q", "UserArea": None, "PositionLocation": []}}]}})), "usajobs")
    assert [(g["location"], g["description"]) for g in got] == [("DC", "q  js"), ("USA", "")]
    got = listings(land(spark, ("Findwork.dev", "py", 1, {"results": [{"id": 1, "keywords": ["a", "b"], "text": " <b>t"}, {"id": 2}]})), "findwork")
    assert [g["description"] for g in got] == ["<b>t Skills: a, b", "Skills:"]
    got = listings(land(spark, ("Himalayas", None, 1, {"jobs": [{"id": 7, "locationRestrictions": ["A", "B"], "url": "u"},
                                                                {"slug": "z", "locationRestrictions": [], "applicationLink": "l", "url": "u"}]})), "himalayas")
    assert [(g["job_id"], g["location"], g["url"]) for g in got] == [("7", "A, B", "u"), ("z", "Remote (Worldwide)", "l")]


def test_unreadable_page_gives_no_rows(spark):
    assert listings(land(spark, ("Jobicy", "py", 1, "oops{"), ("Jobicy", "sql", 1, None)), "jobicy") == []


def test_page_window(spark):
    full, empty = {"data": [{"slug": "a"}], "jobs": [{"id": 1}]}, {"data": [], "jobs": []}
    df = land(
        spark,
        *[("Arbeitnow", None, p, b) for p, b in enumerate([full, full, empty, full], 1)],
        *[("Himalayas", None, p, full) for p in range(1, 9)],
        ("Adzuna", "a", 1, {"results": [{"id": 1}]}), ("Adzuna", "a", 2, "broken{"), ("Adzuna", "a", 3, {"results": [{"id": 1}]}),
        ("Adzuna", "b", 1, {"results": [{"id": 1}]}),
        ("Jobicy", "a", 1, "broken{"), ("Jobicy", "b", 1, full), ("Jobicy", "b", 2, full),
        ("Findwork.dev", "a", 1, {"results": [], "next": "n"}), ("Findwork.dev", "a", 2, {"results": [{"id": 1}], "next": None}),
        ("Findwork.dev", "a", 3, {"results": [{"id": 2}], "next": None}),
    )

    def kept(max_pages):
        rows = landing.page_window(df, max_pages).select("source", "skill", "page").collect()
        return {s: sorted((r.skill or "", r.page) for r in rows if r.source == s) for s in {r.source for r in rows}}

    got = kept(3)
    assert got["Arbeitnow"] == [("", 1), ("", 2)]
    assert got["Himalayas"] == [("", p) for p in range(1, 7)]
    assert got["Adzuna"] == [("a", 1), ("b", 1)]
    assert got["Jobicy"] == [("a", 1), ("b", 1)]
    assert got["Findwork.dev"] == [("a", 1), ("a", 2)]
    assert len(kept(None)["Himalayas"]) == 8 and kept(1)["Himalayas"] == [("", 1), ("", 2)]


def _listing(source, ord_, fetch, uid, title, company, text):
    return (source, ord_, fetch, uid, title, company, "", "u", text)


def test_aggregation_rules(spark):
    rows = [
        _listing("A", 0, 1, "x", "none", "c", "nothing here"),
        _listing("A", 0, 2, "x", "later copy", "c", "knows sql"),
        _listing("A", 0, 3, "x", "third copy", "c", "python sql"),
        _listing("A", 0, 4, "", "no id 1", "c", "sql"),
        _listing("A", 0, 5, "", "no id 2", "c", "sql"),
        _listing("B", 1, 1, "x", "same", "d", "sql"),
        _listing("C", 2, 1, "x", "same", "d", "python sql"),
    ]
    df = spark.createDataFrame(rows, feeds.LISTING_SCHEMA)
    result = report(df, ["Python", "sql", "Python"])
    got = [(r.source, r.title, r.skills_matched, r.matched_skills) for r in result.ranked().collect()]
    assert got == [("C", "same", 3, "Python, sql, Python"), ("A", "later copy", 1, "sql"), ("A", "no id 1", 1, "sql")]
    assert result.total().first().total == 3
    assert [(r.source, r.n, r.bar) for r in result.by_source().collect()] == [("A", 2, 2), ("C", 1, 1)]
    assert [(r.skills_matched, r.n) for r in result.by_score().collect()] == [(3, 1), (1, 2)]
    assert {r.source: r.n for r in result.matches_per_source().collect()} == {"A": 2, "B": 1, "C": 1}
    assert result.ranked().first().description_file == "job_descriptions/c_x_same.txt"


def test_long_skill_lists_score_alike(spark, monkeypatch):
    texts = ["go asp.net, c++ x", "Machine  learning machine learning", "c# node.js a_b", "", "GO go été go-to"]
    rows = [_listing(s, o, i, "x", t, "c", t) for o, s in enumerate("AB") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, feeds.LISTING_SCHEMA)
    skills = ["go", ".net", "c++", "machine learning", "node.js", "a", "a_b", "Go", "été", "c#", "+ x", "go-to", ".js"]

    def scored():
        got = J.score_jobs(df, skills).select("source", "fetch_ord", "skills_matched", "matched_skills").collect()
        return sorted(map(tuple, got))

    literal = scored()
    monkeypatch.setattr(J, "MAX_LITERALS", 0)
    assert scored() == literal and any(r[2] > 2 for r in literal)


def test_duplicate_limit_runs_before_the_shuffle(spark):
    df = spark.createDataFrame([], "source string, job_id string, fetch_ord long, skills_matched int")
    plan = J.uid_dedup(df)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_description_document(spark):
    df = spark.createDataFrame([("S T", "1", "T!", "C", "L", "a, b", "body", 2)],
                               "source string, job_id string, title string, company string, location string, "
                               "matched_skills string, description string, skills_matched int")
    row = J.descriptions(df).first()
    assert row.file_name == "s_t_1_T.txt"
    assert row.content == "Title          : T!\nCompany        : C\nLocation       : L\nMatched Skills : a, b\n" + "─" * 60 + "\n\nbody\n"


def test_missing_values_are_equal_in_dedup(spark):
    df = spark.createDataFrame([(None, "a", 1, 0, 1), (None, "a", 2, 0, 2), ("x", None, 1, 0, 3), ("x", None, 1, 0, 4)],
                               "title string, company string, skills_matched int, source_ord int, fetch_ord long")
    assert sorted(r.fetch_ord for r in J.title_company_dedup(df).collect()) == [2, 3]

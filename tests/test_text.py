import re

import pytest
from pyspark.sql import functions as F

from talentspark.functions import redact as R
from talentspark.functions import scores as C
from talentspark.functions import text as X
from talentspark.functions import patterns as P
from talentspark.catalog import tables as T


def test_clean_html(one):
    assert one(X.clean_html, "<p>Hi</p><br>&amp; you", None, "  x  ") == ["Hi  &amp; you", "", "x"]


def test_sanitize_filename(one):
    got = one(X.sanitize_filename, "Sr. Dev (C++) – Remote", "!!!", "", None, "a" * 80, "x  y_z-1")
    assert got == ["Sr_Dev_C_Remote", "unnamed", "unknown", "unknown", "a" * 60, "x_y_z-1"]


def test_skill_list(one):
    assert one(X.skill_list, "python, ,sql , python", "")[0] == ["python", "sql", "python"]
    assert X.parse_skills(" python, ,sql , python") == ["python", "sql", "python"]
    with pytest.raises(ValueError):
        X.parse_skills(" , ")


def test_text_sanitize(one):
    assert one(X.text_sanitize, "  C# & C++ / R&D\t(x) é_y  ") == ["C C++ / RD (x) y"]


def test_simple_normalize(one):
    assert one(X.simple_normalize, " Ab-c  9é d\n") == ["ab c d"]


def test_stop_alpha_normalize(one):
    assert one(lambda c: X.stop_alpha_normalize(c, ["the"]), "The Éclair, x2 don't") == ["éclair don t"]


def test_title_company(one):
    got = one(X.title_company, "Acme: Dev: Ops", "Solo")
    assert [(r.title, r.company) for r in got] == [("Dev: Ops", "Acme"), ("Solo", "")]


def test_keyword_tokens(one):
    got = one(X.keyword_tokens, "Seeking Kubernetes and network design talent", "CI/CD the ab python Python", "")
    assert [sorted(g) for g in got] == [["design", "kubernetes", "network", "seeking", "talent"], ["cicd", "python"], []]
    assert len(P.KEYWORD_STOP_WORDS) == len(set(P.KEYWORD_STOP_WORDS))


@pytest.mark.parametrize("literal,text,found", [
    ("c++", "i know c++ well", False), (".net", "use .net core", False), (".net", "asp.net core", True),
    ("node.js", "use node.js now", True), ("Python", "python", True), ("go", "mango go_to", False),
    ("go", "été-go", True), ("go", "égo", False),
])
def test_whole_word(one, literal, text, found):
    assert one(lambda c: X.has_whole_word(c, literal), text) == [found]
    assert bool(re.search(r"\b" + re.escape(literal.lower()) + r"\b", text)) == found


def test_percent_and_band(spark):
    df = spark.createDataFrame([(3, 5), (1, 8), (0, 0), (7, 10)], "m int, n int")
    rows = df.select(X.percent_half_up(F.col("m"), F.col("n")).alias("s")).withColumn("b", X.match_band(F.col("s"))).collect()
    assert [r.s for r in rows] == [60, 13, 0, 70]
    assert [r.b == P.GREAT_MATCH_TEXT for r in rows] == [False, False, False, True]


def test_upload_status(one):
    types = [P.ACCEPTED_TYPES["pdf"], P.ACCEPTED_TYPES["docx"], P.ACCEPTED_TYPES["doc"], "text/plain"]
    assert one(X.upload_status, *types) == ["accepted", "accepted", "unsupported", "rejected"]


REDACTED = [
    ("Mail ann.lee@mail.example.org today.", "Mail [EMAIL] today.", None),
    ("Ring (212) 555-0188 now.", "Ring [PHONE] now.", None),
    ("Ring +49 30123 45678.", "Ring [PHONE].", None),
    ("Office: 42 Oak Street, Apt 7C.", "Office [ADDRESS].", None),
    ("Office: 42 Oak Street Apt 7C.", "Office [ADDRESS] 7C.", None),
    ("Zip 60614-1234 or 606141", "Zip [ZIP] or [ZIP]", None),
    ("Post to P.O. Box 99.", "Post to [POBOX].", "Post to [ADDRESS]."),
    ("P.O. Box 60614", "P.O. Box [ZIP]", "[ADDRESS]"),
    ("Card 4785380592391139 here", "Card [PHONE][ZIP] here", None),
    ("5 years of experience building APIs", "[ADDRESS] APIs", None),
    ("user_name@mail.example.org", "[EMAIL]", None),
    ("7 jones@mail.example.org", "[ADDRESS]@mail.example.org", "7 [EMAIL]"),
    ("C# & C++ / R&D", "C C++ / RD", None),
    ("/12 345 678/ x", "[PHONE] x", "/12 345 678/ x"),
]


def test_redaction_goldens(one):
    texts = [t for t, _, _ in REDACTED]
    assert one(R.redact_serving, *texts) == [a for _, a, _ in REDACTED]
    assert one(R.redact_dataset, *texts) == [b or a for _, a, b in REDACTED]


def test_redaction_twice_loses_brackets(one):
    assert one(lambda c: R.redact_serving(R.redact_serving(c)), "Zip 60614.") == ["Zip ZIP."]


def test_redaction_agrees_with_python(spark, sf):
    rows = T.load(spark, sf, "documents").select("text", R.redact_serving(F.col("text")).alias("got")).collect()
    for text, got in rows:
        text = re.sub(r"\s+", " ", re.sub(r"[^a-zA-Z0-9\s.,\-/()@+]", "", text)).strip()
        for pattern, label in R.SERVING_RULES:
            text = re.sub(pattern, label, text, flags=re.ASCII)
        assert got == text
        assert not re.search(P.EMAIL, got)


def test_redact_spans(spark):
    spans = "array<struct<label:string,start:int,end:int>>"
    given = [("PERSON", 0, 7), ("ORG", 8, 11), ("PERSON", 12, 14), ("GPE", 18, 22)]
    df = spark.createDataFrame([("Ann Lee met Bo in Rome", given), ("none", []), ("null", None)], f"t string, s {spans}")
    got = [r[0] for r in df.select(R.redact_spans(F.col("t"), F.col("s"))).collect()]
    assert got == ["[PERSON] met [PERSON] in [GPE]", "none", "null"]
    orgs = df.select(R.redact_spans(F.col("t"), F.col("s"), ["ORG"])).first()[0]
    assert orgs == "Ann Lee [ORG] Bo in Rome"


CLASSES = ["Technology", "Engineering", "Finance & Accounting", "Business & Management", "Human & Social Services",
           "Sales & Marketing", "Creative & Design", "Health & Lifestyle", "Building & Construction",
           "Aviation & Transport", "Automobile", "Agriculture"]


def test_top_k(spark):
    scores = [7.0, 6.5, 6.0, 4.0, 3.5, 3.0, 1.0, 1.0, 0.5, -0.5, -1.0, -2.0]
    df = spark.createDataFrame([(scores,)], "s array<double>")
    assert df.select(C.top_k_classes(F.col("s"), CLASSES, 3)).first()[0] == CLASSES[:3]
    assert df.select(C.top_k_classes(F.col("s"), CLASSES, 12)).first()[0] == CLASSES
    ranks = df.select(*[C.label_rank(F.col("s"), F.lit(i)) for i in range(12)]).first()
    assert list(ranks) == list(range(1, 13))
    for k in (0, 13):
        with pytest.raises(ValueError, match="classes to choose from"):
            C.top_k_classes(F.col("s"), CLASSES, k)

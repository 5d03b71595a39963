"""Row-level rules on hand-written edge rows."""

import pytest
from pyspark.sql import functions as F

from dqspark import functions as fn


def apply(spark, make, values, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r["r"] for r in df.select("i", make(F.col("v")).alias("r")).orderBy("i").collect()]


def test_non_blank_trims_spaces_only(spark):
    assert apply(spark, fn.non_blank, [None, "", "  ", "\t", "a"]) == [False, False, False, True, True]


def test_email_clean_removes_bad_characters(spark):
    given = [None, " John Doe@Gmail.com ", "***", "é@x.com", "a+b_c%d-e.f@x.com", "a\\b@x.com", "a,b@x.com"]
    cleaned = ["", "johndoe@gmail.com", "", "@x.com", "a+b_c%d-e.f@x.com", "ab@x.com", "ab@x.com"]
    assert apply(spark, fn.email_clean, given) == cleaned


def test_valid_email(spark):
    good = ["a@b.co", "a.b+c%d-e_f@x-y.example.com", "a@b..com", "no-reply@x.com"]
    bad = ["", "a", "a@b", "x@y.z", "a@@b.com", "@x.com", "a@x.c0m", "a@x.com\n", "A@x.com", "a@_x.com", "a@b@c.com"]
    assert apply(spark, fn.is_valid_email, good) == [True] * len(good)
    assert apply(spark, fn.is_valid_email, bad) == [False] * len(bad)


def test_format_status(spark):
    status = lambda c: fn.format_status(fn.email_clean(c))
    given = [None, "  ", "***", "masked***", "john doe@x.com", "a@@b.com"]
    assert apply(spark, status, given) == ["empty", "empty", "empty", "invalid", "valid", "invalid"]


def test_blocked_is_anchored(spark):
    given = ["no-reply@x.com", "noreply@x.com", "do-not-reply@x.com", "donotreply@x.com", "noreply.team@x.com", "xnoreply@x.com"]
    assert apply(spark, fn.is_blocked, given) == [True, True, True, True, False, False]


def test_parts_trimmed_or_not(spark):
    given = [" Info@X.com ", "plain", "a@b@c.com", None]
    assert apply(spark, fn.local_part, given) == ["info", "plain", "a", None]
    assert apply(spark, fn.email_domain, given) == ["x.com", "", "b", None]
    assert apply(spark, lambda c: fn.email_domain(c, trimmed=False), given) == ["x.com ", "", "b", None]


def test_normalize_domain(spark):
    given = [None, "HTTPS://WWW.X.com/p", " https://x.com", "http://a.b/c\nd", "wWw.x.com ", "www.www.x.com", "x/", "httpx://y"]
    expected = ["", "x.com", "https:", "a.b", "x.com", "www.x.com", "x", "httpx:"]
    assert apply(spark, fn.normalize_domain, given) == expected


def test_website_domain_prefix_is_case_sensitive(spark):
    assert apply(spark, fn.website_domain, [None, " www.X.com ", "WWW.x.com", "wwwx.com"]) == ["", "x.com", "www.x.com", "wwwx.com"]


def test_domain_root(spark):
    assert apply(spark, fn.domain_root, ["x.com", "localhost", ".com", ""]) == ["x", "localhost", "", ""]


def test_alnum_clean_drops_capitals_by_default(spark):
    assert apply(spark, fn.alnum_clean, [None, "Acme Co", "a-b_c 1"]) == ["", "cmeo", "abc1"]
    assert apply(spark, lambda c: fn.alnum_clean(c, lower_first=True), ["Acme Co"]) == ["acmeco"]


PAIRS = [
    ("x.com", "x.com", True),
    ("mail.x.com", "x.com", True),
    ("x.com", "mail.x.com", True),
    ("ax.com", "x.com", False),
    ("axb.com", "a_b.com", False),
    ("x.com", "%.com", False),
    ("x.", "", True),
    ("", "", True),
    ("x..com", ".com", True),
    ("a\\b.com", "b.com", False),
]


@pytest.mark.parametrize("proper", [False, True])
def test_domain_related_and_suffixes_agree(spark, proper):
    df = spark.createDataFrame(PAIRS, "a string, b string, related boolean")
    up = F.array_contains(fn.dotted_suffixes(F.col("a")), F.col("b"))
    down = F.array_contains(fn.dotted_suffixes(F.col("b"), proper=True), F.col("a"))
    for r in df.select("*", fn.domain_related(F.col("a"), F.col("b")).alias("got"), (up | down).alias("by_suffix")).collect():
        assert r["got"] == r["by_suffix"] == r["related"], r
    suffixes = apply(spark, lambda c: fn.dotted_suffixes(c, proper), ["a.b.c", "x", ""])
    assert suffixes == ([["b.c", "c"], [], []] if proper else [["a.b.c", "b.c", "c"], ["x"], [""]])


def test_six_clauses(spark):
    rows = [
        # e-mail domain, local, local clean, company domain, root, name, match
        ("x.com", "a", "a", "x.com", "x", "", True),
        ("anz.com", "a", "a", "anz.com.au", "anz", "", True),
        ("gmail.com", "anz.au", "anzau", "anz.com.au", "anz", "", True),
        ("gmail.com", "baanthai", "baanthai", "bt.com", "bt", "baan", True),
        ("gmail.com", "anz1", "anz1", "other.com", "other", "anz", False),
        ("gmail.com", "abc", "abc", ".com", "", "", False),
        ("gmail.com", "abc", "abc", "q.com", "q", "", False),
    ]
    names = ["d", "l", "lc", "cd", "root", "name", "expected"]
    df = spark.createDataFrame(rows, names)
    got = df.select("expected", fn.six_clause_match(*[F.col(c) for c in names[:6]]).alias("got")).collect()
    assert [r["got"] for r in got] == [r["expected"] for r in got]


def test_labels(spark):
    assert apply(spark, fn.country_key, [None, " ", " AU "]) == ["UNKNOWN", "UNKNOWN", "AU"]
    assert apply(spark, fn.status_label, [None, "", "valid"]) == ["NULL", "NULL", "valid"]


def test_occurrence_bucket_edges(spark):
    given = [2, 49, 50, 100, 101, 250, 251, 300, 301]
    expected = ["<50", "<50", "50-100", "50-100", "101-250", "101-250", "251-300", "251-300", ">300"]
    assert apply(spark, fn.occurrence_bucket, given, "bigint") == expected


def test_role_score(spark):
    assert apply(spark, fn.role_score, ["sales", "salesforce", "info.au", "admin", "admins", "jane"]) == [10, 7, 7, 10, 0, 0]


def test_pct_rounds_half_away_from_zero(spark):
    df = spark.createDataFrame([(1, 200), (1, 800), (1, 3), (2, 3), (0, 0), (5, 5), (201, 20000)], "a bigint, b bigint")
    got = [r[0] for r in df.select(fn.pct(F.col("a"), F.col("b"))).collect()]
    assert got == [0.5, 0.13, 33.33, 66.67, None, 100.0, 1.01]


def test_ratio2_signs(spark):
    df = spark.createDataFrame([(1, 8), (-1, 8), (0, 3), (1, 0)], "a bigint, b bigint")
    assert [r[0] for r in df.select(fn.ratio2(F.col("a"), F.col("b"))).collect()] == [0.13, -0.13, 0.0, None]

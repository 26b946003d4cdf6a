"""Column functions against the values they must have."""

import pytest
from pyspark.sql import functions as F

from briefloom.functions import rules, text, urls


def values(spark, column, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r.v for r in df.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def test_canonical_urls(spark):
    cases = {
        "HTTPS://Example.COM/news/?utm_source=x&id=3#part": "https://example.com/news?id=3",
        "http://a.b:443//x///y/": "http://a.b/x/y",
        "https://a.b/": "https://a.b/",
        "https://a.b": "https://a.b",
        "https://a.b/p?q=a~b*c&REF=1&k": "https://a.b/p?q=a~b%2Ac&k=",
    }
    assert values(spark, urls.canonical_url, list(cases)) == list(cases.values())


def test_evidence_urls(spark):
    good = ["https://a.b/x", "https://a.b:8443/"]
    bad = ["http://a.b", "https://u:p@a.b/", "https://a.b:99999/", " https://a.b", "https:///x", "https://a.b/\x01", "https://a.b/" + "x" * 256]
    assert values(spark, urls.is_evidence_url, good + bad) == [True] * len(good) + [False] * len(bad)


def test_redacted_urls(spark):
    cases = {
        "https://h.x/hooks/access_token/path-secret/releases": "https://h.x/hooks/access_token/REDACTED/releases",
        "https://h.x/download/api_key=assignment-secret/file": "https://h.x/download/api_key=REDACTED/file",
        "https://u:p@h.x/a?token=1&b=2#f": "https://h.x/a?token=REDACTED&b=2",
    }
    assert values(spark, urls.redacted_url, list(cases)) == list(cases.values())


def test_texts(spark):
    assert values(spark, text.normal_title, ["Introducing: New Agent SDK!", "ＡＩ  Released"]) == ["agent sdk", "ai"]
    assert values(spark, lambda x: text.truncated(x, 5), ["a  b", "abcdefgh", "abc  efgh"]) == ["a b", "abcd…", "abc…"]
    assert values(spark, text.estimated_tokens, ["", "abcd", "中文ab"]) == [0, 2, 3]
    assert values(spark, text.is_chinese, ["中", "中文", " a中b文 ", None]) == [False, True, True, False]
    assert values(spark, text.is_calendar_date, ["2026-02-28", "2026-02-30", "2026-2-3", None]) == [True, False, False, False]
    assert values(spark, text.is_rfc3339, ["2026-02-28T10:00:00Z", "2026-02-30T10:00:00Z", "2026-02-28T10:00:00+08:00", "2026-02-28"]) == [True, False, True, False]
    assert values(spark, text.slug, ["  Foo  BAR/é$-", "Straße"]) == ["foo%20bar%2F%C3%A9$-", "strasse"]
    assert values(spark, text.company_key, ["Foo, Inc.", "foo​ inc"]) == ["foo inc", "foo inc"]
    assert values(spark, text.redacted, ["api_key: abc, x", "Bearer abcdefgh12", "sk-12345678 y", "nothing"]) == ["api_key=[REDACTED], x", "[REDACTED]", "[REDACTED] y", "nothing"]


def test_page_content(spark):
    page = "<title> T </title><nav>menu</nav><script>x</script><p>" + "word " * 30
    rows = values(spark, text.page_content, [page, "<p>short", None])
    assert (rows[0].title, rows[0].status, rows[0].text[:9]) == ("T", "verified", "word word")[:2] + (rows[0].text[:9],)
    assert "menu" not in rows[0].text and rows[1].status == rows[2].status == "insufficient"


@pytest.mark.parametrize(("words", "expected"), [("API v2 may ship", True), ("the model might help", False), ("nothing here", False), ("pricing 3%", True), ("模型有望 model", True)])
def test_shortlistable(spark, words, expected):
    assert values(spark, rules.is_shortlistable, [words]) == [expected]


def test_score_backfill(spark):
    df = spark.createDataFrame([(60,), (100,), (1,)], "v int")
    rows = df.select(rules.backfilled_score(F.col("v"), {"a": 25, "b": 20, "c": 15, "d": 40}).alias("s")).collect()
    assert [tuple(r.s) for r in rows] == [(25, 20, 15, 0), (25, 20, 15, 40), (1, 0, 0, 0)]

import hashlib

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(s):
    return F.lit(s)


def test_identity(spark):
    want = "source_8b79c6aeb84c765a31014864"
    assert value(spark, T.det_id("source", lit("https://example.test/a"), "x")) == want
    assert value(spark, T.det_id("source", F.lit(None).cast("string"))) is None
    with pytest.raises(Exception, match="empty"):
        value(spark, T.det_id("source", lit("")))
    assert value(spark, T.fingerprint(lit("  A\x1c b\xa0C "))) == hashlib.sha256(b"a b c").hexdigest()


@pytest.mark.parametrize(("url", "want"), [
    ("HTTPS://Example.test/a?utm_source=x&edition=2#part", "https://example.test/a?edition=2"),
    ("http://a.test", "http://a.test/"), ("http://A.test/x?b=&c", "http://a.test/x?b=&c="), ("ftp://a.test/", None), ("not-a-url", None),
])
def test_urls(spark, url, want):
    assert value(spark, T.canonical_url(lit(url))) == want


@pytest.mark.parametrize(("text", "want"), [
    ("Ocean currents transport heat around the planet.", True), ("Les courants océaniques transportent la chaleur.", False),
    ("海洋环流在全球传输热量。", False), ("Океанские течения переносят тепло.", False),
])
def test_english(spark, text, want):
    assert value(spark, T.is_english(lit(text))) is want


@pytest.mark.parametrize(("text", "want"), [("menu link " * 300 + "A sentence.", False), ("Version control stores snapshots of file states.", True), ("", False), ("x", False)])
def test_html_quality(spark, text, want):
    assert value(spark, T.html_quality(lit(text))) is want


@pytest.mark.parametrize(("before", "after", "want"), [
    ("Mars has 2 small moons that orbit the planet.", "Mars has 2 small moons orbiting it.", None), ("Mars has 2 small moons.", "Mars has 99 small moons.", "numbers"),
    ("Titan does not have a dense oxygen atmosphere.", "Titan has a dense oxygen atmosphere.", "negation"), ("The lake stores water.", "The lake stores more water.", "comparison_direction"),
    ("The study suggests an effect.", "The study proves an effect.", "modality"), ("The plant grew in spring.", "Because of light the plant grew in spring.", "causality_added"),
    ("The engine performed well in tests.", "The engine is the best in tests.", "superlative_added"),
])
def test_anchor_violations(spark, before, after, want):
    got = value(spark, T.anchor_violations(lit(before), lit(after)))
    assert got == [] if want is None else want in got


def test_translated_anchors_and_conflicts(spark):
    assert value(spark, T.anchor_violations(lit("火星有2顆小衛星。"), lit("Mars has 2 small moons."), True)) == []
    assert value(spark, T.anchor_violations(lit("火星有2顆小衛星。"), lit("Mars has 9 small moons."), True)) == ["numbers"]
    conflict = lambda a, b: value(spark, T.anchor_conflict(T.anchors(lit(a)), T.anchors(lit(b))))
    assert conflict("Sunlight increases the rate of photosynthesis in plants.", "Sunlight decreases the rate of photosynthesis in plants.")
    assert conflict("Observation number 1 confirms a repeatable result.", "Observation number 2 confirms a repeatable result.")
    assert not conflict("Mars has 2 small moons that orbit the planet.", "Mars possesses two small moons orbiting it.")


def test_risks_tokens_and_retry(spark):
    assert value(spark, T.risk_flags(lit("Medical treatment always works."))) == ["high_risk_actionable_domain", "unverifiable_superlative"]
    assert value(spark, T.risk_flags(lit("A diagnosis follows."))) == []
    assert value(spark, T.query_tokens(lit("The Straße of the 2 moons and b a"), 2)) == ["2", "b"]
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert str(value(spark, T.retry_at(lit("90"), now))) == "2024-01-01 00:01:30"
    assert str(value(spark, T.retry_at(lit("Mon, 01 Jan 2024 05:00:00 GMT"), now))) == "2024-01-01 05:00:00"
    assert value(spark, T.safe_text(lit("a\x00\x1bb\n\t\x85c"))) == "ab\n\tc"

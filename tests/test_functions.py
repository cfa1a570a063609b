"""Column functions on literal rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evidence_engine.functions import scores as S
from evidence_engine.functions import text as T


@pytest.fixture(scope="module")
def one(spark):
    def value(column):
        return spark.range(1).select(column.alias("x")).first()["x"]

    return value


def test_normalize_text_variants(one):
    assert one(T.normalize_text(F.lit("Crème  Brûlée &amp; Co https://x.org/a?b 5% ₹10"))) == "creme brulee and co 5% ₹10"
    assert one(T.normalize_text(F.lit("A & B Limited"), "registry")) == "a and b"
    assert one(T.normalize_text(F.lit("Not-so, fast!"), "claim")) == "not so fast"
    assert one(T.normalize_text(F.lit("  Two\n Words "), "plain")) == "two words"
    assert one(T.normalize_text(F.lit(None).cast("string"))) == ""


def test_title_tokens(one):
    assert one(T.title_tokens(F.lit("The company opens new facilities in 3 cities"))) == ["commission", "plant", "city"]
    a, b = F.lit("Alpha opens copper plant in Odisha"), F.lit("Alpha commissions copper facility at Odisha")
    assert one(T.jaccard(T.title_tokens(a), T.title_tokens(b))) == 1.0
    assert one(T.jaccard(T.title_tokens(F.lit("")), T.title_tokens(b))) == 0.0


@pytest.mark.parametrize(("x", "want"), [(2.5, 3), (-2.5, -2), (0.49, 0), (-0.51, -1)])
def test_halves_go_up(one, x, want):
    assert one(T.round_half_up(F.lit(x))) == want


def test_clamp(one):
    assert one(T.clamp(F.lit(120.0))) == 100
    assert one(T.clamp(F.lit(float("nan")), -5, 5)) == -5
    assert one(T.clamp(F.lit(float("inf")), -5, 5)) == -5
    assert one(T.clamp(F.lit(None).cast("double"))) == 0


def test_dates(one):
    def shown(column):
        return one(F.date_format(column, "yyyy-MM-dd HH:mm:ss"))

    assert shown(T.parse_feed_date(F.lit("20240131T101500Z"))) == "2024-01-31 10:15:00"
    assert shown(T.parse_feed_date(F.lit("Wed, 31 Jan 2024 10:15:00 GMT"))) == "2024-01-31 10:15:00"
    assert shown(T.parse_feed_date(F.lit("Wed, 31 Jan 2024 10:15:00 +0530"))) == "2024-01-31 04:45:00"
    assert one(T.parse_feed_date(F.lit("soon"))) is None
    assert shown(T.strict_utc(F.lit("2024-02-29T00:00:00.123Z"))) == "2024-02-29 00:00:00"
    for bad in ("2024-02-30T00:00:00Z", "2024-02-29T00:00:00+00:00", "2024-02-29T00:00:00.1234Z"):
        assert one(T.strict_utc(F.lit(bad))) is None


def test_addresses(one):
    assert one(T.domain_of(F.lit("https://www.Example.com/a"))) == "example.com"
    assert one(T.domain_of(F.lit("not an address"))) == ""
    assert one(T.canonical_url(F.lit("https://e.org/a?b=1#c"))) == "https://e.org/a"
    assert one(T.canonical_url(F.lit("https://e.org/a?utm_source=x&b=1&fbclid=2#c"), "traceable")) == "https://e.org/a?b=1"
    for bad in ("ftp://e.org/a", "https://user:secret@e.org/a", "javascript:alert(1)"):
        assert one(T.canonical_url(F.lit(bad), "traceable")) is None


def test_html_and_words(one):
    assert one(T.clean_html_text(F.lit("<script>var a;</script><p>Tom &amp; <b>Ann</b></p>"))) == "Tom & Ann"
    assert one(T.truncate_words(F.lit("a b c d"), 3)) == "a b c…"
    assert one(T.truncate_words(F.lit("a b c"), 3)) == "a b c"


def fnv(text: str) -> str:
    h = 2166136261
    for c in text:
        h = (h ^ ord(c)) * 16777619 % 2**32
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"
    out = ""
    while True:
        h, r = divmod(h, 36)
        out = digits[r] + out
        if not h:
            return out


@pytest.mark.parametrize("text", ["", "a", "plant opens in odisha", "₹10 crore"])
def test_hash_of_titles(one, text):
    assert one(T.fnv36(F.lit(text))) == fnv(text)


def test_stable_id_leaves_out_empty_parts(one):
    assert one(T.stable_id(F.lit("a"), F.lit(""), F.lit("b"))) == one(T.stable_id(F.lit("a"), F.lit("b")))


def test_tone_counts_overlapping_terms_once_each(one):
    # gain and gains both stand in the text
    assert one(S.media_tone(F.lit("gains gains"))) == 14
    assert one(S.media_tone(F.lit("anything"), external=F.lit("-3.5,1,2"))) == -28
    assert one(S.media_tone(F.lit("loss and fraud"))) == -16


def test_official_filing_beats_a_rumour(one):
    filing = S.certainty(F.lit("exchange filing announced and approved"), F.lit(1), F.lit(0), F.lit(True))
    rumour = S.certainty(F.lit("sources said it may be exploring talks"), F.lit(1), F.lit(3), F.lit(False))
    assert one(filing) - one(rumour) > 25


def test_forecast_and_bucket(one):
    f = one(S.forecast(F.lit(90), F.lit(80), F.lit(90), F.lit(6), F.lit(5), F.lit(70)))
    assert f.p24 >= 82 and f.posture == "ACT NOW" and "rapid media acceleration" in f.drivers and f.p72 >= f.p24
    quiet = one(S.forecast(F.lit(56), F.lit(0), F.lit(60), F.lit(1), F.lit(0), F.lit(0)))
    assert quiet.posture == "AMPLIFY" and quiet.drivers == ["incremental relevance with limited momentum"]
    assert one(S.bucket(F.lit(76), F.lit(58), F.lit(0), F.lit(0), F.lit(False))) == "must"
    assert one(S.bucket(F.lit(64), F.lit(0), F.lit(0), F.lit(0), F.lit(True))) == "must"
    assert one(S.bucket(F.lit(20), F.lit(10), F.lit(10), F.lit(58), F.lit(False))) == "watch"
    assert one(S.bucket(F.lit(20), F.lit(10), F.lit(10), F.lit(57), F.lit(False))) == "other"


def test_personal_frame_drifts(one):
    d = one(S.narrative_drift(F.lit("Tycoon buys beloved club, owner celebrates"), F.lit("Consortium completes minority investment in sports franchise"), F.lit(1), F.lit(0), F.lit(5)))
    assert d.score >= 65 and d.risk == "HIGH" and len(d.reasons) >= 2
    assert one(S.narrative_drift(F.lit("x"), F.lit(None).cast("string"), F.lit(1), F.lit(0), F.lit(5))).score == 0


def test_category_takes_the_first_rule(one):
    assert one(S.infer_category(F.lit("court hears ceo"))) == "Leadership"
    assert one(S.infer_category(F.lit("court hears case"))) == "Regulatory"
    assert one(S.infer_category(F.lit("nothing here"))) == "Corporate"


def test_strict_offset(spark):
    from evidence_engine.functions.text import strict_offset

    texts = ["2024-02-29T10:00:00Z", " 2024-02-29 10:00:00.5+05:30 ", "2024-02-29t10:00:00-23:59", "2023-02-29T10:00:00Z", "2024-02-29T24:00:00Z", "2024-02-29T10:00:00", "2024-02-29T10:00:00.1234567Z", "2024-02-29T10:00:00+0530", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.unix_millis(strict_offset(F.col("t"))).alias("ms")).orderBy("i").collect()
    base = 1709200800000
    assert [r.ms for r in rows] == [base, base + 500 - 330 * 60000, base + 1439 * 60000, None, None, None, None, None, None, None]


def test_normal_texts_keep_the_same_characters_of_all(spark):
    """The class of characters that go is written as ranges; it is the complement of those that stay."""
    import re

    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(a, "".join(map(chr, codes[a : a + 4096]))) for a in range(0, len(codes), 4096)], "k int, t string")
    got = {r.k: r.n for r in rows.select("k", F.regexp_replace("t", T._OTHERS, " ").alias("n")).collect()}
    assert got == {r.k: re.sub(r"[^a-z0-9₹$%+.\-]+", " ", r.t) for r in rows.collect()}


def test_words_between_bars_are_found_as_a_pattern_finds_them(spark):
    rows = spark.createDataFrame([(t,) for t in ("a tax case", "xtaxx", "ai", "an ai plan", "M&A", "", "a.b", "acb", None)], "t string")
    for pattern in ("tax|case", "ai |plan", "tax||x", "a.b", "m&a|M&A", ""):
        assert [r[0] for r in rows.select(T.holds(F.col("t"), pattern)).collect()] == [r[0] for r in rows.select(F.col("t").rlike(pattern)).collect()]


def test_normal_texts_have_single_blanks(spark):
    rows = spark.createDataFrame([(" A \t\n b,, ,c \u00a0\u2003d\x0b ",), ("  ",), (None,), ("é\u0301t\u00e9 &amp; https://x.y/z  q",)], "t string")
    assert [r[0] for r in rows.select(T.normalize_text(F.col("t"))).collect()] == ["a b c d", "", "", "ete and q"]

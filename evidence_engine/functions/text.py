"""Column builders over texts, addresses, dates and ids. Column in, Column out; all stay in the JVM."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidence_engine.params import DEFAULT, Params


def _folding() -> tuple[str, str]:
    """Latin letters whose compatibility decomposition is one ASCII letter and combining marks, and that letter."""
    source, target = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii():
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


ACCENTED, PLAIN = _folding()
_MARKS = r"[̀-ͯ]"
#: All but a-z, 0-9 and ₹$%+.- as ranges: Java tries a class that is a complement at many times the cost for each letter.
_OTHERS = r"[\x00-#&-*,/:-`{-₸₺-\x{10FFFF}]+"


def round_half_up(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5).cast("int")


def clamp(x: Column, low: float = 0, high: float = 100) -> Column:
    """Within [low, high]; null, NaN and infinities become low."""
    bad = x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.when(bad, F.lit(low)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))


def fold(text: Column) -> Column:
    """Without diacritics, lower-cased."""
    return F.lower(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), ACCENTED, PLAIN), _MARKS, ""))


def _squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_text(text: Column, variant: str = "title") -> Column:
    """Variants: title, registry (legal suffixes dropped), claim (letters and digits), search (not folded), plain (lower, squeezed)."""
    if variant == "plain":
        return _squeeze(F.lower(F.coalesce(text, F.lit(""))))
    if variant == "search":
        return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))
    body = fold(text)
    if variant == "claim":
        return F.trim(F.regexp_replace(F.regexp_replace(body, r"https?://\S+", " "), "[^a-z0-9]+", " "))
    if variant == "registry":
        body = F.regexp_replace(F.regexp_replace(body, "&", " and "), "[^a-z0-9]+", " ")
        return _squeeze(F.regexp_replace(body, r"\b(limited|ltd|private|pvt|plc|inc|corporation|corp)\b", " "))
    body = F.regexp_replace(F.regexp_replace(body, r"https?://\S+", " "), "&amp;", " and ")
    # blanks are among the others, so each run has become one blank
    return F.trim(F.regexp_replace(body, _OTHERS, " "))


def holds(text: Column, pattern: str) -> Column:
    """text.rlike(pattern); words without any sign of a pattern between bars are looked for as such, at a fraction of the cost."""
    if not re.fullmatch("[A-Za-z0-9 |]+", pattern):
        return text.rlike(pattern)
    return reduce(or_, [text.contains(w) for w in pattern.split("|")])


def title_tokens(text: Column, params: Params = DEFAULT) -> Column:
    words = F.split(normalize_text(text), " ")
    stop = F.array(*[F.lit(w) for w in params.stop_words]) if params.stop_words else F.array().cast("array<string>")
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))
    if not params.canonical:
        return kept
    table = F.create_map(*[F.lit(x) for pair in params.canonical.items() for x in pair])
    return F.transform(kept, lambda w: F.coalesce(F.try_element_at(table, w), w))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; 0 where either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / F.size(F.array_union(a, b)))


def parse_feed_date(value: Column) -> Column:
    """Fourteen digits or more as yyyyMMddHHmmss in UTC, else an ISO or RFC 822 date; null where none reads it."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    compact = F.when(F.length(digits) >= 14, F.try_to_timestamp(F.substring(digits, 1, 14), F.lit("yyyyMMddHHmmss")))
    mail = F.regexp_replace(F.trim(value), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(compact, F.try_to_timestamp(value), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")))


def strict_utc(value: Column) -> Column:
    """Only yyyy-mm-ddThh:mm:ss with at most three decimals and Z, on a day that exists."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,3})?Z$"), value.try_cast("timestamp"))


def strict_offset(value: Column) -> Column:
    """As databases write it: T or a blank, at most six decimals, Z or an offset of hours and minutes; null for days and times that do not exist."""
    text = F.trim(value)
    shape = r"(?i)^(\d{4}-\d{2}-\d{2})[T ]((?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d{1,6})?)(?:Z|([+-])([01]\d|2[0-3]):([0-5]\d))$"
    part = [F.regexp_extract(text, shape, k) for k in range(6)]
    local = F.concat(part[1], F.lit("T"), part[2], F.lit("Z")).try_cast("timestamp")
    minutes = F.coalesce(part[4].try_cast("long") * 60 + part[5].try_cast("long"), F.lit(0))
    return F.when(text.rlike(shape), F.timestamp_micros(F.unix_micros(local) - F.when(part[3] == "-", -minutes).otherwise(minutes) * 60_000_000))


def domain_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", "")), F.lit(""))


def canonical_url(url: Column, mode: str = "plain") -> Column:
    """plain: without query and fragment. traceable: http(s), no credentials, without fragment and tracking parameters, else null. https: as it is if https without credentials, else null."""
    if mode == "https":
        return F.when(url.rlike(r"^https://[^/@\s?#]+([/?#]|$)"), url)
    if mode == "plain":
        return F.regexp_replace(url, r"[?#].*$", "")
    whole = F.regexp_replace(F.trim(url), r"#.*$", "")
    query = F.regexp_extract(whole, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|fbclid|gclid|mc_[^=]*)(=|$)"))
    clean = F.concat(F.regexp_replace(whole, r"\?.*$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return F.when(whole.rlike(r"^https?://[^/@\s?]+([/?]|$)"), clean)


def clean_html_text(html: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(html, r"(?is)<script.*?</script>", " "), r"(?is)<style.*?</style>", " ")
    body = F.regexp_replace(body, r"<[^>]+>", " ")
    for code, char in (("&amp;", "&"), ("&quot;", '"'), ("&#39;|&apos;", "'")):
        body = F.regexp_replace(body, code, char)
    return _squeeze(body)


def truncate_words(text: Column, limit: int = 42) -> Column:
    words = F.filter(F.split(clean_html_text(text), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > limit, F.concat(F.array_join(F.slice(words, 1, limit), " "), F.lit("…"))).otherwise(F.array_join(words, " "))


def fnv36(text: Column) -> Column:
    """32-bit FNV-1a over the code units of the text, in base 36. One unit for each character of the basic plane."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    hashed = F.aggregate(chars, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    return F.lower(F.conv(hashed.cast("string"), 10, 36))


def stable_id(*parts: Column, digits: int = 24) -> Column:
    """The first digits of the SHA-256 of the non-empty parts, joined with bars."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.nullif(p.cast("string"), F.lit("")) for p in parts]), 256), 1, digits)


def tone_label(score: Column) -> Column:
    return F.when(score >= 25, "Positive").when(score <= -25, "Negative").otherwise("Neutral / mixed")

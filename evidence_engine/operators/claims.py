"""The claim-evidence graph: build, assess, filter, merge, correct, compare."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.functions.scores import class_from_tier, coverage_group
from evidence_engine.functions.text import canonical_url, domain_of, normalize_text, stable_id
from evidence_engine.operators.articles import small
from evidence_engine.plans.materialize import materialize
from evidence_engine.plans.pairs import meet

#: Shared tokens over the smaller set from which two facts may contradict each other.
OVERLAP = 0.45
NEGATION = r"\b(not|no|never|denied|denies|without|false|cancelled|rejected)\b"


def _first_of(row: Column | None, names: Sequence[str], known: Sequence[str]) -> list[Column]:
    """The fields of a struct (or columns, without one) that there are, as texts; empty ones as null."""
    return [F.nullif((F.col(n) if row is None else row[n]).cast("string"), F.lit("")) for n in names if n in known]


def build_evidence(events: DataFrame) -> DataFrame:
    """One row for each source of an event with a traceable address: id, event_id, authority, title, address, domain, published_at, tier, official, provider, source_id.

    events(event_id, sources (array of structs), and, as far as there are such columns, title, url, published_at, latest_at,
    source_name, source). A source may have url, link, source_url; authority, name, source_name, publisher, domain;
    published_at, pub_date; tier, official, title, provider, source_id: the first that is given counts, then the event's. A
    tier that is missing is 0 for official sources, else 3. An event none of whose sources has a traceable address has its
    own address as evidence. The id is made of event, address, authority and date; of equal ids the last source counts.
    """
    known, given = {f.name for f in events.schema["sources"].dataType.elementType.fields}, set(events.columns)
    none = F.lit(None).cast("string")
    date = _first_of(None, ["published_at", "latest_at"], given)
    title = _first_of(None, ["title"], given)

    def told(source: Column) -> Column:
        def first(*names: str, rest: Sequence[Column] = ()) -> Column:
            return F.coalesce(*_first_of(source, names, known), *rest, none)

        official = F.coalesce(source["official"], F.lit(False)) if "official" in known else F.lit(False)
        tier = F.coalesce(*([source["tier"].cast("int")] if "tier" in known else []), F.when(official, 0).otherwise(3))
        return F.struct(
            canonical_url(first("url", "link", "source_url", rest=_first_of(None, ["url"], given)), "traceable").alias("address"),
            first("authority", "name", "source_name", "publisher", "domain", rest=[F.lit("Unknown source")]).alias("authority"),
            first("published_at", "pub_date", rest=date).alias("published_at"), first("title", rest=title).alias("title"), tier.alias("tier"), (official | (tier == 0)).alias("official"),
            first("provider").alias("provider"), first("source_id").alias("source_id"),
        )

    own = F.struct(
        canonical_url(F.coalesce(*_first_of(None, ["url"], given), none), "traceable").alias("address"), F.coalesce(*_first_of(None, ["source_name", "source"], given), F.lit("Unknown source")).alias("authority"),
        F.coalesce(*date, none).alias("published_at"), F.coalesce(*title, none).alias("title"), F.lit(3).alias("tier"), F.lit(False).alias("official"), none.alias("provider"), none.alias("source_id"),
    )
    good = F.filter(F.transform(F.coalesce("sources", F.array().cast(events.schema["sources"].dataType)), told), lambda s: s["address"].isNotNull())
    rows = events.select("event_id", good.alias("good"), F.filter(F.array(own), lambda s: s["address"].isNotNull()).alias("own"))
    rows = rows.select("event_id", F.posexplode(F.when(F.size("good") > 0, F.col("good")).otherwise(F.col("own"))).alias("nth", "e")).select("event_id", "nth", "e.*")
    rows = rows.withColumn("id", stable_id(F.lit("evidence"), F.col("event_id"), F.col("address"), F.col("authority"), F.col("published_at")))
    columns = ["event_id", "authority", "title", "address", "published_at", "tier", "official", "provider", "source_id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*columns), "nth").alias("e")).select("id", "e.*").withColumn("domain", domain_of(F.col("address")))


def build_claims(events: DataFrame) -> DataFrame:
    """One row for each claim: claim_id, event_id, kind, sequence (from 1), text, normalized_text, entity_ids, observed_at, lifecycle, version.

    events(event_id, facts, interpretations (arrays of texts), summary, headline, and, as far as there are such columns,
    entity_ids, latest_at, published_at, created_at, lifecycle, status, version). Facts are those given, else the summary,
    else the headline; empty texts count as not given. The id is made of event, kind, place (the first has none) and
    normalised text, so a fact stated twice has two ids.
    """
    given = set(events.columns)

    def some(texts: Column) -> Column:
        return F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda t: F.coalesce(t, F.lit("")) != "")

    facts = F.when(F.size(some(F.col("facts"))) > 0, some(F.col("facts"))).otherwise(F.array_compact(F.array(F.coalesce(F.nullif("summary", F.lit("")), F.nullif("headline", F.lit(""))))))
    ids = F.array_distinct(some(F.col("entity_ids"))) if "entity_ids" in given else F.array().cast("array<string>")
    seen = F.coalesce(*_first_of(None, ["latest_at", "published_at", "created_at"], given), F.lit(None).cast("string"))
    life = F.coalesce(*_first_of(None, ["lifecycle", "status"], given), F.lit("observed"))
    version = F.coalesce(F.nullif(F.col("version").cast("int"), F.lit(0)), F.lit(1)) if "version" in given else F.lit(1)
    parts = F.array(F.struct(F.lit("fact").alias("kind"), facts.alias("texts")), F.struct(F.lit("interpretation").alias("kind"), some(F.col("interpretations")).alias("texts")))
    rows = events.select("event_id", ids.alias("entity_ids"), seen.alias("observed_at"), life.alias("lifecycle"), version.alias("version"), F.explode(parts).alias("part"))
    rows = rows.select("*", F.posexplode("part.texts").alias("nth", "text")).withColumn("normalized_text", normalize_text(F.col("text"), "claim"))
    place = F.when(F.col("nth") > 0, F.col("nth"))
    return rows.select(
        stable_id(F.lit("claim"), F.col("event_id"), F.col("part.kind"), place, F.col("normalized_text")).alias("claim_id"), "event_id", F.col("part.kind").alias("kind"), (F.col("nth") + 1).alias("sequence"),
        F.trim("text").alias("text"), "normalized_text", "entity_ids", "observed_at", "lifecycle", "version",
    )


def claim_sequence(claims: DataFrame) -> DataFrame:
    """The place of each claim within its event and kind, from 1."""
    nth = F.row_number().over(Window.partitionBy("event_id", "kind").orderBy("observed_at", "claim_id"))
    return claims.select("claim_id", "event_id", "kind", nth.alias("sequence"))


def assess_support(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claim_id, support, n_evidence, n_domains: facts with traceable evidence are provisional, else unsupported."""
    good = evidence.withColumn("address", canonical_url(F.col("url"), "traceable")).filter("address IS NOT NULL").select("claim_id", domain_of(F.col("address")).alias("domain"))
    per = good.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n_evidence"), F.countDistinct("domain").alias("n_domains"))
    rows = claims.join(per, "claim_id", "left")
    support = F.when(F.col("kind") == "interpretation", "interpretation").when(F.col("n_evidence") > 0, "provisional").otherwise("unsupported")
    return rows.select("claim_id", support.alias("support"), F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), F.coalesce("n_domains", F.lit(0)).alias("n_domains"))


def support_violations(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """rule, n: what forbids publishing. Duplicate ids, unsafe addresses, evidence without claim, facts without evidence."""
    bad_url = canonical_url(F.col("url"), "traceable").isNull()
    parts = [
        claims.groupBy("claim_id").count().filter("count > 1").select(F.lit("duplicate_claim").alias("rule")),
        evidence.groupBy("evidence_id").count().filter("count > 1").select(F.lit("duplicate_evidence").alias("rule")),
        evidence.filter(bad_url).select(F.lit("unsafe_address").alias("rule")),
        evidence.join(claims, "claim_id", "left_anti").select(F.lit("orphan_evidence").alias("rule")),
        claims.filter("kind = 'fact'").join(evidence, "claim_id", "left_anti").select(F.lit("fact_without_evidence").alias("rule")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return every.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def orphan_evidence(links: DataFrame, evidence: DataFrame) -> DataFrame:
    """Links whose evidence does not exist."""
    return links.join(evidence.select("evidence_id").distinct(), "evidence_id", "left_anti")


def filter_claims(claims: DataFrame, event_id=None, kind: str | None = None, lifecycle: str | None = None, support: str | None = None, text: str | None = None, entity_id: str | None = None) -> DataFrame:
    """Filters that are given apply; text is sought in the claim's text, entity ids and event's id. claims may hold entity_ids (array) and text."""
    for column, value in (("event_id", event_id), ("kind", kind), ("lifecycle", lifecycle), ("support", support)):
        if value not in (None, ""):
            claims = claims.filter(F.col(column) == F.lit(value))
    if entity_id:
        claims = claims.filter(F.array_contains("entity_ids", entity_id))
    if text and text.strip():
        fields = [F.array_join(c, " ") if c == "entity_ids" else F.col(c).cast("string") for c in ("text", "entity_ids", "event_id") if c in claims.columns]
        claims = claims.filter(F.lower(F.concat_ws(" ", *fields)).contains(text.strip().lower()))
    return claims


def project_graph(claims: DataFrame, evidence: DataFrame, contradictions: DataFrame | None = None) -> dict[str, DataFrame]:
    """The part of the graph that the claims touch."""
    out = {"claims": claims, "evidence": evidence.join(claims.select("claim_id"), "claim_id", "left_semi")}
    if contradictions is not None:
        ids = claims.select("claim_id")
        left = contradictions.join(ids.withColumnRenamed("claim_id", "a"), "a", "left_semi")
        right = contradictions.join(ids.withColumnRenamed("claim_id", "b"), "b", "left_semi")
        out["contradictions"] = left.union(right).distinct()
    return out


def graph_summary(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row of counts."""
    c = claims.agg(
        F.count(F.lit(1)).alias("claims"), F.count_if(F.col("kind") == "fact").alias("facts"), F.count_if(F.col("kind") == "interpretation").alias("interpretations"),
        F.countDistinct("event_id").alias("events"), F.count_if(F.col("lifecycle") == "closed").alias("closed"),
    )
    return c.crossJoin(evidence.agg(F.count(F.lit(1)).alias("evidence"), F.countDistinct("evidence_id").alias("distinct_evidence")))


def facts_per_event(claims: DataFrame) -> DataFrame:
    return claims.groupBy("event_id").agg(F.count_if(F.col("kind") == "fact").alias("facts"), F.count(F.lit(1)).alias("claims"))


def unsupported_material(claims: DataFrame, support: DataFrame, materiality: DataFrame, floor: int = 65) -> DataFrame:
    """Unsupported facts of events at or over the floor."""
    bad = support.filter("support = 'unsupported'").select("claim_id")
    return claims.join(bad, "claim_id", "left_semi").join(materiality.filter(F.col("materiality") >= floor), "event_id").select("claim_id", "event_id", "materiality")


def contradictions(facts: DataFrame, overlap: float = OVERLAP, negation: str = NEGATION) -> DataFrame:
    """facts(claim_id, scope, text) -> id, a, b, overlap: pairs of a scope that share tokens but differ in a negation cue.

    Equal texts of a scope are one node. When the smaller set shares ceil(overlap n) of its n tokens, one of its rarest
    n - ceil(overlap n) + 1 is shared; so those of the smaller meet all of the larger, where sizes and cues allow it, and a
    pair is kept if from its first common token on both still have as many tokens as it must share. Words that many facts
    of a scope have are dealt in blocks, so a scope of any size runs in many tasks.
    """
    cue = F.lower("text").rlike(negation)
    words = F.array_sort(F.array_distinct(F.filter(F.split(normalize_text(F.col("text"), "claim"), " "), lambda w: F.length(w) >= 4)))
    rows = facts.select("claim_id", "scope", words.alias("words"), cue.alias("cue")).filter(F.size("words") > 0)
    rows = materialize(rows.groupBy("scope", "words", "cue").agg(F.min("claim_id").alias("claim_id")))
    each = rows.select("claim_id", "scope", "cue", F.size("words").alias("n"), F.explode("words").alias("word"))
    seen = each.groupBy("scope", "word").agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(seen, ["scope", "word"]).withColumn("at", F.row_number().over(Window.partitionBy("claim_id", "scope", "cue").orderBy("df", "word")))
    ranked = materialize(ranked.drop("df"))
    need = F.ceil(F.col("nx") * overlap - 1e-9)
    # only facts that differ in the cue are sent to each other
    left, right = (ranked.select("scope", "word", pole.alias("pole"), *[F.col(c).alias(f"{short}{k}") for c, short in (("claim_id", "id"), ("n", "n"), ("at", "at"))]) for k, pole in (("x", F.col("cue")), ("y", ~F.col("cue"))))
    met = meet(left.filter(F.col("atx") <= F.col("nx") - need + 1), right, ["scope", "word", "pole"], F.col("idx"), F.col("idy"))
    met = met.filter(F.col("nx") <= F.col("ny"))
    left_over = F.least(F.col("nx") - F.col("atx"), F.col("ny") - F.col("aty")) + 1
    first = met.filter(F.least("atx", "aty") - 1 + left_over >= need).groupBy("scope", "idx", "idy", "nx").agg(F.min(F.col("atx").cast("long") * (1 << 32) + left_over).alias("first"))
    pairs = first.filter(F.col("first") % (1 << 32) >= need).select("scope", F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b")).distinct()
    wa, wb = (rows.select("scope", F.col("claim_id").alias(k), F.col("words").alias(f"w{k}")) for k in "ab")
    scored = pairs.join(wa, ["scope", "a"]).join(wb, ["scope", "b"]).withColumn("overlap", F.size(F.array_intersect("wa", "wb")) / F.least(F.size("wa"), F.size("wb")))
    return scored.filter(F.col("overlap") >= overlap).select(stable_id(F.lit("contradiction"), F.col("a"), F.col("b")).alias("id"), "a", "b", "overlap")


def correction_versions(corrections: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """corrections(claim_id, request_id, created_at, text, original) -> version, previous text and request of each, by claim, and the columns to keep."""
    w = Window.partitionBy("claim_id").orderBy("created_at", "request_id")
    return corrections.select(
        "claim_id", "request_id", (F.row_number().over(w) + 1).alias("version"), F.coalesce(F.lag("text").over(w), F.col("original")).alias("previous_text"), F.lag("request_id").over(w).alias("supersedes"), "text", *keep
    )


def unknown_correction_evidence(requests: DataFrame, evidence: DataFrame) -> DataFrame:
    """The distinct (request_id, claim_id, evidence_id) that a request names and no evidence has. requests hold evidence_ids (array)."""
    named = requests.select("request_id", "claim_id", F.explode("evidence_ids").alias("evidence_id")).distinct()
    return named.join(evidence.select("evidence_id"), "evidence_id", "left_anti").select("request_id", "claim_id", "evidence_id")


def apply_corrections(claims: DataFrame, corrections: DataFrame, requests: DataFrame, evidence: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(corrections with the accepted requests added, a result for each request). Append-only and idempotent.

    As if the requests came one by one by created_at, claim_id and text. A request needs text of at most 10 000 characters, an
    actor and an id of at most 200 characters or none, else it is rejected. One whose id a correction has, stored or accepted
    before it, is replayed if claim and text are equal, else a conflict. Others are applied where the claim is a fact and, if
    evidence is given, all their evidence_ids exist, else rejected. Requests without an id are never replayed.
    """
    key = F.coalesce(F.concat(F.lit("r"), "request_id"), F.concat_ws(" ", F.lit("c"), "claim_id", F.col("created_at").cast("string"), "text"))
    order = [c for c in ("created_at", "claim_id", "text", "evidence_ids") if c in requests.columns]
    rows = requests.withColumn("__key", key).withColumn("__nth", F.row_number().over(Window.partitionBy("__key").orderBy(*order)))
    known = corrections.filter("request_id IS NOT NULL").groupBy("request_id").agg(F.min(F.struct(F.col("claim_id"), F.trim("text").alias("text"))).alias("__known"))
    kinds = claims.groupBy("claim_id").agg(F.max(F.col("kind") == "fact").alias("__fact"))
    shaped = F.length("text").between(1, 10000) & (F.trim("text") != "") & (F.trim(F.coalesce("actor", F.lit(""))) != "") & (F.coalesce(F.length("request_id"), F.lit(0)) <= 200)
    sound = F.coalesce(F.col("__fact"), F.lit(False))
    marked = rows.join(known, "request_id", "left").join(kinds, "claim_id", "left")
    if evidence is not None:
        named = rows.select("__key", "__nth", F.explode("evidence_ids").alias("evidence_id"))
        lost = named.join(evidence.select("evidence_id"), "evidence_id", "left_anti").select("__key", "__nth").distinct().withColumn("__lost", F.lit(True))
        marked = marked.join(lost, ["__key", "__nth"], "left")
        sound = sound & F.col("__lost").isNull()
    content = F.struct("claim_id", F.trim("text").alias("text"))
    good = F.coalesce(shaped, F.lit(False)) & sound & F.col("__known").isNull()
    first = F.min(F.when(good, F.struct(F.col("__nth").alias("nth"), content.alias("content")))).over(Window.partitionBy("__key"))
    named_before = F.coalesce("__known", F.when(F.col("request_id").isNotNull() & (F.col("__first.nth") < F.col("__nth")), F.col("__first.content")))
    result = (
        F.when(~F.coalesce(shaped, F.lit(False)), "rejected").when(named_before.isNotNull(), F.when(named_before == content, "replayed").otherwise("conflict"))
        .when(good & (F.col("request_id").isNull() | (F.col("__first.nth") == F.col("__nth"))), "applied").otherwise("rejected")
    )
    marked = marked.withColumn("__first", first).withColumn("result", result)
    added = marked.filter("result = 'applied'").select(*corrections.columns)
    return corrections.unionByName(added), marked.select("request_id", "claim_id", "result")


def mark_corrected(claims: DataFrame, corrections: DataFrame) -> DataFrame:
    """claims, with lifecycle corrected and the request of the latest correction (correction_id) where there is one."""
    last = corrections.groupBy("claim_id").agg(F.max_by("request_id", F.struct("created_at", "request_id")).alias("correction_id"), F.lit(True).alias("__has"))
    rows = claims.drop("correction_id").join(last, "claim_id", "left")
    return rows.withColumn("lifecycle", F.when(F.col("__has"), "corrected").otherwise(F.col("lifecycle"))).drop("__has")


def correction_audit(claims: DataFrame, corrections: DataFrame) -> DataFrame:
    """An audit row for each correction: who, which claim, the text and lifecycle before and the text and version after.

    claims(claim_id, lifecycle), corrections as for correction_versions with actor.
    """
    rows = correction_versions(corrections, ["actor", "created_at"]).join(claims.select("claim_id", "lifecycle"), "claim_id")
    before = F.when(F.col("version") == 2, F.col("lifecycle")).otherwise("corrected")
    return rows.select(
        F.col("created_at").alias("occurred_at"), "request_id", F.trim("actor").alias("actor"), F.lit("correct").alias("action"), F.lit("claim").alias("object_type"), F.col("claim_id").alias("object_id"),
        F.struct(F.col("previous_text").alias("text"), before.alias("lifecycle"), F.col("supersedes").alias("correction_id")).alias("previous_value"), F.struct("text", "version").alias("new_value"),
    )


def claim_history(claims: DataFrame, links: DataFrame, evidence: DataFrame, corrections: DataFrame, audit: DataFrame) -> DataFrame:
    """claim_id, current_text, and the arrays evidence, corrections and audit of each claim, in order.

    claims(claim_id, text), links(claim_id, evidence_id), evidence(evidence_id, published_at, ...) by date, those without last, then
    id; corrections(claim_id, request_id, version, created_at, text) by version; audit(object_type, object_id, occurred_at, request_id,
    action) by time. The text is the last correction's, else the claim's own. A claim without any has empty arrays.
    """

    def ordered(rows: DataFrame, name: str, order: list, columns: list[str]) -> DataFrame:
        item = F.struct(F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)]).alias("k"), F.struct(*columns).alias("v"))
        return rows.groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]).alias(name))

    proof = links.select("claim_id", "evidence_id").distinct().join(evidence.groupBy("evidence_id").agg(F.min("published_at").alias("published_at")), "evidence_id")
    parts = [
        ordered(proof, "evidence", [F.col("published_at").isNull(), F.col("published_at"), F.col("evidence_id")], ["evidence_id", "published_at"]),
        ordered(corrections, "corrections", [F.col("version"), F.col("created_at"), F.col("request_id")], ["version", "request_id", "text"]),
        ordered(audit.filter("object_type = 'claim'").withColumnRenamed("object_id", "claim_id"), "audit", [F.col("occurred_at"), F.col("request_id")], ["occurred_at", "request_id", "action"]),
    ]
    rows = claims.select("claim_id", "text")
    for part in parts:
        rows = rows.join(part, "claim_id", "left")
    lists = [F.coalesce(c, F.array().cast(part.schema[c].dataType)).alias(c) for c, part in zip(("evidence", "corrections", "audit"), parts)]
    return rows.select("claim_id", F.coalesce(F.try_element_at("corrections", F.lit(-1))["text"], F.col("text")).alias("current_text"), *lists)


#: Lanes of a fingerprint, of 64 bits each; four from one SHA-256.
LANES = 16


def content_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows and lanes (array of LANES decimals), a hash of the rows as a multiset, whatever their order.

    Each row gives LANES numbers of 64 bits; the lanes are their sums modulo 2**64. So the fingerprint of a table follows from
    that of an earlier one and the rows that have gone and come (changed_fingerprint), without the table.
    """
    body = F.to_json(F.struct(*columns))
    digests = df.select(*[F.sha2(F.concat(body, F.lit(f"|{k}")), 256).alias(f"d{k}") for k in range(LANES // 4)])
    lanes = [F.conv(F.substring(f"d{i // 4}", 1 + 16 * (i % 4), 16), 16, 10).cast("decimal(20,0)") for i in range(LANES)]
    summed = digests.agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(x), F.lit(0)).alias(f"s{i}") for i, x in enumerate(lanes)])
    return summed.select("rows", F.array(*[_in_lane(F.col(f"s{i}")) for i in range(LANES)]).alias("lanes"))


def _in_lane(x: Column) -> Column:
    return F.pmod(x.cast("decimal(38,0)"), F.lit(str(2**64)).cast("decimal(38,0)")).cast("decimal(20,0)")


def changed_fingerprint(before: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """The fingerprint of a table from that before a change and those of the rows that have gone and come."""
    signs = [part.select((F.lit(sign) * F.col("rows")).alias("rows"), F.transform("lanes", lambda x: F.lit(sign) * x.cast("decimal(38,0)")).alias("lanes")) for part, sign in ((before, 1), (gone, -1), (come, 1))]
    three = signs[0].union(signs[1]).union(signs[2]).agg(F.sum("rows").alias("rows"), *[F.sum(F.col("lanes")[i]).alias(f"s{i}") for i in range(LANES)])
    return three.select("rows", F.array(*[_in_lane(F.col(f"s{i}")) for i in range(LANES)]).alias("lanes"))


def fingerprint_text() -> Column:
    """A fingerprint as 64 hexadecimal digits."""
    return F.sha2(F.concat_ws("|", F.col("rows").cast("string"), F.array_join(F.transform("lanes", lambda x: x.cast("string")), "|")), 256)


#: What a generation is known by: when it was made, what it covers, what it was made from, and its content.
IDENTITY = ("generated_at", "window_start", "window_end", "source_commit", "source_repository", "source_run", "source_attempt", "content")
#: Seconds that two clocks may differ by.
SKEW = 60


def generation_id(prefix: str = "") -> Column:
    """SHA-256 of the fields of IDENTITY, each with its name; a missing one counts as such. Columns have the prefix."""
    fields = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(prefix + c).cast("string"), F.lit("\0"))) for c in IDENTITY]
    return F.sha2(F.concat_ws("\n", *fields), 256)


def compare_generations(published: DataFrame, expected: DataFrame) -> DataFrame:
    """(field, published, expected) where two heads of one row with the columns of IDENTITY differ; none if they are one generation."""

    def fields(head: DataFrame, name: str) -> DataFrame:
        each = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(name)) for c in IDENTITY] + [F.struct(F.lit("generation_id").alias("field"), generation_id().alias(name))]
        return head.select(F.inline(F.array(*each)))

    return fields(published, "published").join(fields(expected, "expected"), "field", "full_outer").filter(~F.col("published").eqNullSafe(F.col("expected")))


def graph_gate(claims: DataFrame, links: DataFrame, evidence: DataFrame, head: DataFrame, now: Column, stale_minutes: int = 240, input_stale_minutes: int = 180) -> DataFrame:
    """rule, violations (0 passes) of a stored graph before it is read.

    claims(claim_id, event_id), links(claim_id, evidence_id), evidence(evidence_id), head: one row with publishable,
    unsupported_material, generated_at, source_commit, events, claims, evidence (as declared), input_events, the identity of the
    snapshot that it was made from (the columns of IDENTITY and generation_id, each with input_ before it), and what the graph says
    of it: named_generated_at, named_commit, named_run, named_attempt. A missing value breaks the rules that need it.
    """
    orphans = links.join(evidence.select("evidence_id"), "evidence_id", "left_anti").agg(F.count(F.lit(1)).alias("n_orphans"))
    counts = claims.agg(F.count(F.lit(1)).alias("n_claims"), F.countDistinct("event_id").alias("n_events"))
    row = head.crossJoin(counts).crossJoin(evidence.agg(F.count(F.lit(1)).alias("n_evidence"))).crossJoin(orphans)  # tables of one row

    def seconds(c) -> Column:
        return (F.col(c) if isinstance(c, str) else c).cast("timestamp").cast("long")

    def fresh(c: str, minutes: int) -> Column:
        age = seconds(now) - seconds(c)
        return (age >= -SKEW) & (age <= minutes * 60)

    same = [("named_generated_at", "input_generated_at"), ("source_commit", "input_source_commit"), ("named_commit", "input_source_commit"), ("named_run", "input_source_run"), ("named_attempt", "input_source_attempt")]
    identity = F.col("input_generation_id") == generation_id("input_")
    for x, y in same:
        identity = identity & F.col(x).eqNullSafe(F.col(y))
    made = seconds("generated_at") + SKEW
    passes = {
        "publishable": F.col("publishable"),
        "unsupported_material": F.col("unsupported_material") == 0,
        "fresh": fresh("generated_at", stale_minutes),
        "event_count": F.col("events") == F.col("n_events"),
        "claim_count": F.col("claims") == F.col("n_claims"),
        "evidence_count": F.col("evidence") == F.col("n_evidence"),
        "input_identity": identity & F.col("input_source_commit").rlike("^[a-f0-9]{40}$") & F.col("input_content").rlike("^[a-f0-9]{64}$"),
        "input_window": (seconds("input_window_start") < seconds("input_window_end")) & (seconds("input_window_end") <= seconds("input_generated_at") + SKEW),
        "input_before_graph": (seconds("input_generated_at") <= made) & (seconds("input_window_end") <= made),
        "input_fresh": fresh("input_generated_at", input_stale_minutes) & fresh("input_window_end", input_stale_minutes),
        "input_events": (F.col("input_events") >= 1) & (F.col("input_events") == F.col("n_events")),
    }
    broken = [F.struct(F.lit(k).alias("rule"), (~F.coalesce(v, F.lit(False))).cast("long").alias("violations")) for k, v in passes.items()]
    return row.select(F.inline(F.array(F.struct(F.lit("orphan_evidence").alias("rule"), F.col("n_orphans").alias("violations")), *broken)))


def evidence_sources(events: DataFrame, registry: DataFrame, order: Sequence[str] = ("event_id",)) -> DataFrame:
    """name, domain, tier, class, provider: the distinct sources of events by domain, those without one by name; the first one counts.

    events(event_id, the columns of order, sources array<struct<url, name, tier, provider>>): first is the least by order and
    place. registry(registry_ord, domain, name, tier, class): a source's entry is the first whose domain is its host or a
    parent of it. The source's own tier goes before the registry's; the class is the registry's, else the one of the
    source's own tier.
    """
    known = {f.name for f in events.schema["sources"].dataType.elementType.fields}
    rows = events.select(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], F.posexplode("sources").alias("nth", "s"))
    name = F.nullif(F.col("s.name"), F.lit("")) if "name" in known else F.lit(None).cast("string")
    web = F.when(F.col("s.url").rlike("(?i)^https?://"), F.col("s.url"))
    tier = F.col("s.tier").cast("int") if "tier" in known else F.lit(None).cast("int")
    provider = F.coalesce("s.provider", F.lit("")) if "provider" in known else F.lit("")
    at = F.struct(*[f"__o{i}" for i in range(len(order))], "nth", name.alias("name"), tier.alias("tier"), provider.alias("provider"))
    domain = F.coalesce(domain_of(web), F.lit(""))
    key = F.coalesce(F.nullif(domain, F.lit("")), F.nullif(normalize_text(F.coalesce(name, F.lit("unknown-source"))), F.lit("")))
    first = rows.select(key.alias("key"), domain.alias("domain"), at.alias("at")).filter("key IS NOT NULL").groupBy("key", "domain").agg(F.min("at").alias("at"))
    # every suffix of a domain is looked up by equality
    labels = F.split("domain", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    entry = F.struct("registry_ord", F.col("name").alias("registered"), F.col("tier").alias("registry_tier"), "class")
    asked = first.filter("domain <> ''").select("key", F.explode(suffixes).alias("suffix"))
    found = asked.join(small(registry.select(F.col("domain").alias("suffix"), entry.alias("entry"))), "suffix").groupBy("key").agg(F.min("entry").alias("entry"))
    both = first.join(found, "key", "left")
    kind = F.coalesce(F.nullif(F.col("entry.class"), F.lit("")), class_from_tier(F.col("at.tier")))
    return both.select(
        F.coalesce("at.name", "entry.registered", F.nullif("domain", F.lit("")), F.lit("Unnamed source")).alias("name"), "domain", F.coalesce("at.tier", "entry.registry_tier", F.lit(3)).alias("tier"), kind.alias("class"), F.col("at.provider").alias("provider")
    ).orderBy("tier", "name")


def coverage_snapshot(shown: DataFrame, registry: DataFrame) -> DataFrame:
    """name, configured, evidenced of the coverage groups that have either: active entries of the registry, and evidence_sources."""
    active = registry.filter(F.coalesce("active", F.lit(True))) if "active" in registry.columns else registry
    sides = [rows.select(coverage_group(F.col("class"), F.col("tier")).alias("name"), F.lit(i).alias("side")) for i, rows in enumerate((active, shown))]
    return sides[0].union(sides[1]).groupBy("name").agg(F.count_if(F.col("side") == 0).alias("configured"), F.count_if(F.col("side") == 1).alias("evidenced"))

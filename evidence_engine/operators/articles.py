"""Feed items to relevant articles: dedupe, freshness, entity matches, source tiers, relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.functions.scores import any_of, infer_category, media_tone
from evidence_engine.functions.text import canonical_url, domain_of, fnv36, normalize_text, stable_id, title_tokens
from evidence_engine.params import DEFAULT, Params

#: A dimension is broadcast when it has at most so many rows.
BROADCAST_ROWS = 100_000
#: So many words of aliases are looked up as a list in the words of each text.
LISTED_WORDS = 256


def small(dimension: DataFrame) -> DataFrame:
    """A dimension for a join: broadcast when its rows, counted, are few; else left to the planner."""
    return F.broadcast(dimension) if dimension.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else dimension


def union_feeds(*feeds: DataFrame | None) -> DataFrame:
    """The items of all feeds that could be read (None: could not), with the feed's place as job_idx; columns that a feed lacks are null."""
    read = [feed.withColumn("job_idx", F.lit(i)) for i, feed in enumerate(feeds) if feed is not None]
    if not read:
        raise ValueError("no feed could be read")
    every = read[0]
    for feed in read[1:]:
        every = every.unionByName(feed, allowMissingColumns=True)
    return every


def first_wins(items: DataFrame, order: list[str]) -> DataFrame:
    """One item for each canonical address, else title and date: the first by order. Items without address or title go."""
    key = F.coalesce(F.nullif(canonical_url(F.col("url")), F.lit("")), F.concat_ws("|", "title", F.col("published_at").cast("string")))
    kept = items.filter((F.coalesce("url", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "")).withColumn("item_key", key)
    # the smallest of each key by a partial aggregation, so a much repeated address does not gather in one task
    rest = [c for c in kept.columns if c not in ("item_key", *order)]
    least = kept.groupBy("item_key").agg(F.min(F.struct(*order, *rest)).alias("first"))
    return least.select("item_key", "first.*").select(*items.columns, "item_key")


def fresh_articles(articles: DataFrame, now: Column, max_hours: int = 96, future_tolerance_hours: int = 12) -> DataFrame:
    """Not older than max_hours, nor further ahead than the tolerance; undated ones go."""
    return articles.filter((F.col("published_at") >= now - F.expr(f"INTERVAL {max_hours} HOURS")) & (F.col("published_at") <= now + F.expr(f"INTERVAL {future_tolerance_hours} HOURS")))


def in_window(rows: DataFrame, start: Column, end: Column, column: str = "published_at") -> DataFrame:
    return rows.filter(F.col(column).between(start, end))


def filter_records(rows: DataFrame, start: Column, end: Column, source_ids: list[str] | None = None, include_undated: bool = False) -> DataFrame:
    kept = F.col("published_at").between(start, end)
    if include_undated:
        kept = kept | F.col("published_at").isNull()
    return rows.filter(kept & F.col("source_name").isin(source_ids) if source_ids is not None else kept)


def article_features(articles: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Normalised title, tokens, domain, address, ids, tone and category of each article."""
    both = normalize_text(F.concat_ws(" ", "title", "description"))
    return articles.select(
        "ord",
        normalize_text(F.col("title")).alias("norm_title"),
        F.array_join(F.array_sort(F.array_distinct(title_tokens(F.col("title"), params))), " ").alias("tokens"),
        domain_of(F.col("url")).alias("domain"),
        canonical_url(F.col("url")).alias("address"),
        canonical_url(F.col("url"), "traceable").alias("traceable"),
        fnv36(normalize_text(F.col("title"))).alias("title_hash"),
        stable_id(F.lit("article"), F.col("url"), F.lit("")).alias("stable_id"),
        media_tone(both, params).alias("tone"),
        infer_category(both, params).alias("category"),
    )


def source_tier(rows: DataFrame, sources: DataFrame, params: Params = DEFAULT, column: str = "host") -> DataFrame:
    """rows with tier: of the first registry row whose domain is the host or a parent of it, else by pattern, else 3."""
    host = F.lower(F.regexp_replace(F.coalesce(column, F.lit("")), r"^www\.", ""))
    # every suffix of a host is looked up by equality
    labels = F.split(F.lower(F.regexp_replace("__host", r"^www\.", "")), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = rows.select(F.col(column).alias("__host")).distinct().withColumn("suffix", F.explode(suffixes))
    found = hosts.join(small(sources.select(F.col("domain").alias("suffix"), "tier", "registry_ord")), "suffix").groupBy("__host").agg(F.min_by("tier", "registry_ord").alias("__tier"))
    by_pattern = F.coalesce(*[F.when(host.rlike(p), F.lit(t)) for p, t in params.domain_tiers], F.lit(3))
    return rows.join(small(found), F.col(column) == F.col("__host"), "left").withColumn("tier", F.coalesce("__tier", by_pattern)).drop("__host", "__tier")


def alias_table(entities: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """One row for each alias: entity_id, type, tier, alias, needs_context, context (texts any of which will do)."""
    named = entities.withColumn("names", F.array_distinct(F.filter(F.transform(F.concat(F.array("name"), "aliases"), lambda a: normalize_text(a)), lambda a: a != "")))
    parents = named.select(F.col("entity_id").alias("parent_id"), F.filter("names", lambda a: F.length(a) > 3).alias("parent_names"))
    rows = named.join(small(parents), "parent_id", "left")
    phrase = F.array(F.lit(params.context_phrase)) if params.context_phrase else F.array().cast("array<string>")
    context = F.array_distinct(F.concat(F.transform("context", lambda c: normalize_text(c)), F.coalesce("parent_names", F.array().cast("array<string>")), phrase))
    rows = rows.withColumn("context", context).withColumn("alias", F.explode("names"))
    return rows.select("entity_id", "type", "tier", "alias", (F.col("ambiguous") | (F.length("alias") <= 4)).alias("needs_context"), "context")


def alias_index(entities: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """alias_table with each alias' rarest word, by which texts find it: the word that fewest aliases have, then the longest."""
    aliases = alias_table(entities, params).withColumn("words", F.array_distinct(F.filter(F.split("alias", "[^a-z0-9]+"), lambda w: w != ""))).filter(F.size("words") > 0)
    each = aliases.select("alias", F.explode("words").alias("word")).distinct()
    shared = each.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(shared, "word").groupBy("alias").agg(F.min(F.struct("n", (-F.length("word")).alias("size"), "word")).alias("least"))
    plain = F.col("alias").rlike("^[a-z0-9]+$")
    at = F.concat(F.lit("(^|[^a-z0-9])"), F.regexp_replace("alias", r"([.+*?^${}()|\[\]\\\-])", r"\\$1"), F.lit("([^a-z0-9]|$)"))
    return aliases.drop("words").join(rarest.select("alias", F.col("least.word").alias("word")), "alias").withColumns({"plain": plain, "pattern": at})


def entity_hits(docs: DataFrame, entities: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """docs(ord, text and, if wanted, part) -> ord, entity_id, type, tier, alias, phrase, in_part for each alias that stands in a text.

    The distinct words of a text are looked up by equality in the index of rarest words; only where one is found is the
    alias itself looked for, with its borders, and with context where it needs some. Where the index is small it is
    broadcast, and texts are judged where they are; else words travel with the document's number alone, and the texts of
    documents with a hit come back once. phrase: a stakeholder's text has the context phrase. in_part: the alias stands,
    with its context, in the part of the text, too.
    """
    index = alias_index(entities, params)
    few = index.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    has_part = "part" in docs.columns

    def padded(name: str) -> Column:
        return F.concat(F.lit(" "), normalize_text(F.col(name)), F.lit(" "))

    body = docs.select("ord", padded("text").alias("body"), *([padded("part").alias("part")] if has_part else []))
    words = F.array_distinct(F.filter(F.split("body", "[^a-z0-9]+"), lambda w: w != ""))
    if few:
        asked = [r.word for r in index.select("word").distinct().limit(LISTED_WORDS + 1).collect()]
        if len(asked) <= LISTED_WORDS:  # only words that are asked for become rows, as each row has the text with it
            words = F.array_intersect(F.split("body", "[^a-z0-9]+"), F.array(*[F.lit(w) for w in asked]).cast("array<string>"))
        met = body.withColumn("word", F.explode(words)).join(F.broadcast(index), "word")
    else:
        met = body.select("ord", F.explode(words).alias("word")).join(index, "word").join(body, "ord")

    def stands(text: str) -> Column:
        return F.col(text).contains(F.col("alias")) & F.expr(f"regexp_like({text}, pattern)")

    def backed(text: str) -> Column:
        return ~F.col("needs_context") | F.exists("context", lambda c: F.col(text).contains(c))

    hits = met.filter((F.col("plain") | stands("body")) & backed("body"))
    phrase = F.when(F.col("type") == "stakeholder", F.col("body").contains(f" {params.context_phrase} ")).otherwise(False) if params.context_phrase else F.lit(False)
    in_part = stands("part") & backed("part") if has_part else F.lit(None).cast("boolean")
    return hits.select("ord", "entity_id", "type", "tier", "alias", phrase.alias("phrase"), in_part.alias("in_part"))


def match_entities(docs: DataFrame, entities: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """docs(ord, text) -> ord, entity_id, type, tier, matched_alias.

    The longest alias of an entity that stands in the text wins (see entity_hits). Stakeholders count only beside another
    entity or the context phrase.
    """
    hits = entity_hits(docs.select("ord", "text"), entities, params)
    best = hits.groupBy("ord", "entity_id", "type", "tier").agg(F.max(F.struct(F.length("alias").alias("n"), F.col("alias"))).alias("m"), F.max("phrase").alias("phrase"))
    allowed = F.max((F.col("type") != "stakeholder") | F.col("phrase")).over(Window.partitionBy("ord"))
    return best.withColumn("allowed", allowed).filter("allowed").select("ord", "entity_id", "type", "tier", F.col("m.alias").alias("matched_alias"))


def assess_relevance(articles: DataFrame, entities: DataFrame, sources: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """ord, include_as_news, include_as_sentiment, reason, entity_ids of each article.

    articles may have hints (entity ids that their feed stands for); they count like names in the text, but not in the title.
    Texts are matched once, titles as a part of them, and judged before anything is joined, so that no text is shuffled.
    """
    both_texts = F.concat_ws(" ", "title", "description")
    hits = entity_hits(articles.select("ord", both_texts.alias("text"), F.col("title").alias("part")), entities, params).filter("type <> 'stakeholder'").select("ord", "entity_id", "in_part")
    if "hints" in articles.columns:
        known = entities.filter("type <> 'stakeholder'").select("entity_id")
        hinted = articles.select("ord", F.explode("hints").alias("entity_id")).join(small(known), "entity_id", "left_semi").select("ord", "entity_id", F.lit(False).alias("in_part"))
        hits = hits.union(hinted)
    found = hits.groupBy("ord").agg(F.array_sort(F.collect_set("entity_id")).alias("in_text"), F.max("in_part").alias("named"))
    title = normalize_text(F.col("title"))
    both = F.trim(F.concat_ws(" ", title, normalize_text(F.col("description"))))
    price = any_of(title, params.price_move)
    judged = articles.select(
        "ord", "official", "host", (F.col("channel") == "public-conversation").alias("public"), any_of(title, params.public_question).alias("question"), any_of(title, params.routine_market).alias("routine"),
        F.when(price, ~any_of(both, params.corporate_event)).otherwise(price).alias("price_alone"),
    )
    rows = source_tier(judged, sources, params).join(found, "ord", "left")
    official, public, named = F.col("official") | (F.col("tier") == 0), F.col("public"), F.coalesce("named", F.lit(False))
    reason = (
        F.when(F.coalesce(F.size("in_text"), F.lit(0)) == 0, "no_entity")
        .when(public & F.col("question"), "public_question")
        .when(public & named, "public_sentiment_only")
        .when(public, "weak_public_context")
        .when(F.col("routine") & ~official, "routine_market_advice")
        .when(F.col("price_alone") & ~official, "price_movement_without_event")
        .when(~named & ~official, "entity_only_in_snippet")
        .when(official, "official")
        .otherwise("direct_entity_news")
    )
    rows = rows.withColumn("reason", reason)
    return rows.select("ord", F.col("reason").isin("official", "direct_entity_news").alias("include_as_news"), (F.col("reason") == "public_sentiment_only").alias("include_as_sentiment"), "reason", F.coalesce(F.array_join("in_text", ","), F.lit("")).alias("entity_ids"))


def rejection_reasons(assessed: DataFrame) -> DataFrame:
    return assessed.filter("not include_as_news").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))

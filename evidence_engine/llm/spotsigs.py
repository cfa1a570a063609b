"""SpotSigs document fingerprints, in DataFrame operations only.

A signature is a common word (an anchor) with the chain_length content words that follow it, whatever anchors stand in
between. The fingerprint of a text is the set of 64-bit hashes of its signatures, sorted and written as hexadecimal digits.
A text without any chain has its runs of chain_length + 1 words as signatures; one of fewer words, the hash of them all.

Likeness is the Jaccard measure of two sets. near_pairs() deals the sets by their length into ranges so wide that sets
as alike as the threshold stand in the same or in neighbouring ranges, looks for partners by the rarest signatures of
a set only, and computes the Jaccard measure where the lengths allow the threshold at all.

Nulls: a null text counts as empty; a null id is an id of its own, ranked first. Rows of equal id have the same
successor, the text of the next id; where several rows have that id, the one with the smallest text hash. An empty table
gives an empty result. Ids are read as long integers: other integer types come back as long, ids that are no integers are an
error. The signatures of a very long text are made in one row, in time that grows with its length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.llm.columns import text_or_empty
from evidence_engine.plans.materialize import materialize
from evidence_engine.plans.pairs import meet

#: Common words of English, German, French and Spanish that open a chain.
ANCHORS = (
    "a an and are as at be by for from has have he in is it its of on or that the this to was were will with "
    "als auf das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "au aux avec ce dans de du elle en est et il la le les par pas plus pour que qui sur un une "
    "al como con del el es las lo los más no para por se su una y"
).split()


def signatures(text: Column, chain_length: int = 2, anchors: Sequence[str] = ANCHORS) -> Column:
    """The sorted set of signature hashes of a text, array<long>.

    The j-th anchor, at word i, has i - j content words before it; so its chain starts at that place of the content words.
    """
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")

    def chains(ws: Column, p: Column) -> Column:
        whole = F.filter(p["at"], lambda at, j: at - j + chain_length <= F.size(p["content"]))
        return F.transform(whole, lambda at, j: F.xxhash64(F.get(ws, at), *[F.get(p["content"], at - j + k) for k in range(chain_length)]))

    def runs(ws: Column) -> Column:
        some = F.transform(F.sequence(F.lit(0), F.size(ws) - chain_length - 1), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(chain_length + 1)]))
        return F.when(F.size(ws) > chain_length, some).otherwise(F.array(F.xxhash64(ws)))

    def found(ws: Column) -> Column:
        content = F.filter(ws, lambda w: ~w.isin(*anchors))
        at = F.filter(F.transform(ws, lambda w, i: F.when(w.isin(*anchors), i).otherwise(-1)), lambda i: i >= 0)
        chained = F.transform(F.array(F.struct(content.alias("content"), at.alias("at"))), lambda p: chains(ws, p))[0]
        return F.transform(F.array(chained), lambda c: F.when(F.size(c) > 0, c).otherwise(runs(ws)))[0]

    # each intermediate array is a variable of an outer function, so that it is made once
    return F.array_sort(F.array_distinct(F.transform(F.array(words), found)[0]))


def fingerprint(signature_set: Column) -> Column:
    """Sixteen hexadecimal digits for each signature, comma-joined."""
    return F.array_join(F.transform(signature_set, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ",")


def likeness(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Jaccard measure of two sets; 0 without looking further where their lengths rule out the threshold."""
    shared = F.size(F.array_intersect(a, b))
    full = shared / (F.size(a) + F.size(b) - shared)
    return F.when(F.least(F.size(a), F.size(b)) < threshold * F.greatest(F.size(a), F.size(b)), F.lit(0.0)).otherwise(full)


#: Stands for a null id in joins, so that both sides of a join are dealt by the same plain column.
_NO_ID = -(2**63)


def following(ids: DataFrame) -> DataFrame:
    """ids(key, n_chars) with distinct keys -> key, prev_key, prev_n_chars: of the key before, for the first key the last.

    The keys are dealt by ranges. A window orders each range; the last row of each range goes to the next range through
    a table with a row for each range.
    """
    ranged = materialize(ids.repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    me, over = F.struct("key", "n_chars"), Window.orderBy("part")
    last = ranged.groupBy("part").agg(F.max(me).alias("end"))
    # the range before; for the first range the last one
    last = last.select("part", F.coalesce(F.lag("end").over(over), F.last("end").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("end"))
    chained = ranged.withColumn("before", F.lag(me).over(Window.partitionBy("part").orderBy("key"))).join(last, "part").withColumn("before", F.coalesce("before", "end"))
    return chained.select("key", F.col("before.key").alias("prev_key"), F.col("before.n_chars").alias("prev_n_chars"))


def fingerprints(docs: DataFrame, chain_length: int = 2, anchors: Sequence[str] = ANCHORS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text, signatures."""
    return docs.select("doc_id", text_or_empty(F.col("text")).alias("text")).withColumn("signatures", signatures(F.col("text"), chain_length, anchors))


def with_edits(docs: DataFrame, chain_length: int = 2, anchors: Sequence[str] = ANCHORS) -> DataFrame:
    """For each row: doc_id, n_chars, signatures, edited (text), edited_signatures, next_signatures.

    edited: the last floor(n_chars / 4) code points give way to as many first ones of the next document's text (or all).
    Whole texts move once, to their id; both uses of that read the same exchange. Signatures are made where they are
    used, which costs less than moving them with the texts. Of the next document only the beginning that is wanted and
    the signatures move on.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    rows = docs.select(key.alias("key"), text_or_empty(F.col("text")).alias("text"))
    ids = rows.select("key", F.length("text").alias("n_chars")).groupBy("key").agg(F.max("n_chars").alias("n_chars"))
    placed = rows.join(following(ids), "key")
    start = F.substring(F.col("text"), F.lit(1), F.floor(F.col("prev_n_chars") / 4).cast("int"))
    ahead = placed.select(F.col("prev_key").alias("to_key"), F.struct(F.xxhash64("text").alias("h"), start.alias("start"), signatures(F.col("text"), chain_length, anchors).alias("signatures")).alias("next"))
    ahead = ahead.groupBy("to_key").agg(F.min("next").alias("next"))
    both = placed.join(ahead, F.col("key") == F.col("to_key"))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next.start"), F.lit(1), cut))
    both = both.select(F.when(F.col("key") != _NO_ID, F.col("key")).alias("doc_id"), n.cast("long").alias("n_chars"), "text", edited.alias("edited"), F.col("next.signatures").alias("next_signatures"))
    made = {name: signatures(F.col(column), chain_length, anchors) for name, column in (("signatures", "text"), ("edited_signatures", "edited"))}
    return both.withColumns(made).drop("text")


def near_pairs(docs: DataFrame, threshold: float = 0.8, chain_length: int = 2, anchors: Sequence[str] = ANCHORS) -> DataFrame:
    """(a, b, likeness) for each two different fingerprints at or over the threshold; a, b: the least ids that have them.

    Exact: no candidate is capped. A set's prefix of its n - ceil(threshold n) + 1 rarest signatures must meet a partner's.
    """
    sets = fingerprints(docs, chain_length, anchors).groupBy("signatures").agg(F.min("doc_id").alias("id"))
    sets = materialize(sets.withColumn("n", F.size("signatures")))
    each = sets.select("id", "n", F.explode("signatures").alias("sig"))
    seen = each.groupBy("sig").count()
    rarest = F.slice(F.sort_array(F.collect_list(F.struct("count", "sig"))), F.lit(1), F.first("n") - F.ceil(F.first("n") * F.lit(threshold) - 1e-9).cast("int") + 1)
    prefix = each.join(seen, "sig").groupBy("id").agg(F.first("n").alias("n"), rarest.alias("rare"))
    band = F.floor(F.log(F.col("n").cast("double")) / -F.log(F.lit(threshold)) + 1e-9)
    prefix = prefix.select("id", "n", band.alias("band"), F.explode("rare.sig").alias("sig"))
    # a set looks for shorter partners in its own range and the one below
    longer = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"))
    shorter = prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "sig", "band")
    apart = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    # a signature that many prefixes of a range have is dealt in blocks
    met = meet(longer, shorter, ["sig", "band"], F.col("a"), F.col("b"))
    pairs = met.filter(apart & (F.col("nb") >= threshold * F.col("na") - 1e-9)).select("a", "b").distinct()
    left, right = (sets.select(F.col("id").alias(x), F.col("signatures").alias(f"s{x}")) for x in "ab")
    scored = pairs.join(left, "a").join(right, "b").withColumn("likeness", likeness(F.col("sa"), F.col("sb"), threshold))
    return scored.filter(F.col("likeness") >= threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")

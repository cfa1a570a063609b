"""Near-duplicate classes by ProbMinHash over weighted word shingles, banding and verification.

A text is the weighted set of its runs of WIDTH lower-cased words; a run's weight is how often it occurs. Each element
sends a Poisson process of arrivals, its rate the weight, to REGISTERS registers; a register keeps the element that
arrives first. Two registers agree with the probability Jaccard of the two sets. An element stops as soon as its next
arrival is later than the latest first arrival of its text. Links are defined by the plain Jaccard of the sets, which a
line repeated often can take far from the probability Jaccard; so texts with repeats send a second signature in which every
weight is 1 (without repeats the two are the same). Bands of ROWS registers make buckets: the 32 bands of 4 with weight 1 miss
a pair at 0.8 with a chance under 1e-7, whatever the weights are.

A node is a distinct text (by the hash of its words); copies cost no pairs. A node's shingles that no other node has
cannot be shared, which bounds its likeness to any other: with n shingles, v of them held elsewhere, two nodes are at
most m / (n1 + n2 - m) alike, m the lesser v. A member that cannot reach the threshold with any size in its bucket leaves
the bucket, which clears large groups of those that were edited too much to belong.

In a bucket the members are first compared with one pivot, the one with the largest share of common shingles, hence
near the text that all derive from. What is verified at THRESHOLD (exact Jaccard of the shingle sets) is joined into
components. Then members still apart are compared with another pivot. What is still apart goes through an exact join by
prefixes: two nodes alike enough share one of their rarest shingles at places that leave enough to share. So no bucket
is capped, no link between components is lost, and no pairs within a component are made.

Nulls: a null text counts as empty; all texts without words are one node. Texts of fewer than WIDTH words are one shingle.
Ids may be null or repeated; the class of null ids alone is null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.llm.arrays import joined, mixed, parts, powers, shingles, span_hashes, words
from evidence_engine.llm.columns import free_names, text_or_empty
from evidence_engine.plans.materialize import materialize

WIDTH, THRESHOLD, REGISTERS, ROWS = 5, 0.8, 128, 4
#: Rounds of comparison with pivots before the rest is compared pair by pair.
PIVOT_ROUNDS = 2
#: A band key or shingle is hot when more than one entry in so many has it; so there are fewer hot ones than this.
HOT_SHARE = 1024
#: Parts into which the entries of a hot shingle are dealt where they meet.
SALTS = 16


def prob_minhash(elements: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """n x registers signatures. elements: distinct within their owner; owner: ascending text numbers, each present."""
    first = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, np.uint64)
    time, turn = np.zeros(len(elements)), 0
    e, o, w = elements, owner, weight.astype(float)
    while len(e):
        # few elements left: several arrivals of each at once
        many = 1 if len(e) > 4096 else 32
        turns = np.arange(turn, turn + many, dtype=np.uint64)[None, :]
        draw = mixed(e[:, None] + (turns * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        wait = -np.log(((draw >> np.uint64(11)).astype(float) + 1) * 2.0**-53)
        arrival = time[:, None] + np.cumsum(wait / w[:, None], axis=1)
        place = (mixed(draw ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)
        flat = (o[:, None] * registers + place.astype(np.int64)).ravel()
        at = arrival.ravel()
        np.minimum.at(first, flat, at)
        won = at == first[flat]
        winner[flat[won]] = np.repeat(e, many)[won]
        time, turn = arrival[:, -1], turn + many
        latest = first.reshape(n, registers).max(1)
        go_on = time < latest[o]
        e, o, w, time = e[go_on], o[go_on], w[go_on], time[go_on]
    return winner.reshape(n, registers)


def weighted_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles sorted by text, their text numbers and weights, and a hash of each text's words."""
    body, at = joined(pc.utf8_lower(texts))
    n = len(texts)
    starts, ends, of = words(body, at)
    each = span_hashes(body, starts, ends)
    power, inverse = powers(len(each) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each * power[:-1], dtype=np.uint64)])
    bounds = np.searchsorted(of, np.arange(n + 1))
    node = mixed((sums[bounds[1:]] - sums[bounds[:-1]]) * inverse[bounds[:-1]] + np.diff(bounds).astype(np.uint64))
    run, owner = shingles(each, of, n, width)
    order = np.lexsort((run, owner))
    run, owner = run[order], owner[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(new)
    return run[head], owner[head], np.diff(np.append(head, len(run))), node


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of each text; keys of different bands differ."""
    n, registers = signature.shape
    grouped = signature.reshape(n, registers // rows, rows)
    key = np.arange(registers // rows, dtype=np.uint64)[None, :] * np.uint64(0xA24BAED4963EE407)
    for k in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, k])
    return key


def all_band_keys(elements: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys sorted by text, and each text's first place among them: of the bands with weight 1, then with the weights where they differ."""
    plain = band_keys(prob_minhash(elements, owner, np.ones(len(elements)), n))
    repeats = np.zeros(n, bool)
    repeats[owner[weight > 1]] = True
    some = np.flatnonzero(repeats)
    inside = repeats[owner]
    weighted = band_keys(prob_minhash(elements[inside], np.searchsorted(some, owner[inside]), weight[inside], len(some)))
    # a band in which both signatures agree has one key
    own = weighted != plain[some]
    keys = np.concatenate([plain.ravel(), weighted[own]])
    of = np.concatenate([np.repeat(np.arange(n), plain.shape[1]), np.repeat(some, own.sum(1))])
    order = np.argsort(of, kind="stable")
    return keys[order], np.searchsorted(of[order], np.arange(n + 1))


def signed_texts(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs(doc_id, text) -> doc_id, mark (hash of the whole text), node, bands (array<long>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, "text"):
                elements, owner, weight, node = weighted_sets(batch.column("text"), width)
                keys, at = all_band_keys(elements, owner, weight, batch.num_rows)
                bands = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(node.view(np.int64)), bands], ["doc_id", "mark", "node", "bands"])

    source = docs.select("doc_id", text_or_empty(F.col("text")).alias("text")).withColumn("mark", F.xxhash64("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, mark long, node long, bands array<long>")


def shingle_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs(text) -> node, items (array<long>, distinct shingle hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, "text"):
                elements, owner, _, node = weighted_sets(batch.column("text"), width)
                at = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
                items = pa.ListArray.from_arrays(pa.array(at), pa.array(elements.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), items], ["node", "items"])

    return docs.select(text_or_empty(F.col("text")).alias("text")).mapInArrow(run, "node long, items array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b) -> a, b, likeness: exact Jaccard of their sets."""
    left, right = (sets.select(F.col("node").alias(x), F.col("items").alias(f"s{x}")) for x in "ab")
    shared = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", (shared / (F.size("sa") + F.size("sb") - shared)).alias("likeness"))


def _few(df: DataFrame, rows: int) -> DataFrame:
    """A table of so many rows in no more parts than they need."""
    return df.coalesce(1 + rows // 50_000)


def _met(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with table (a row for each key). Rows of hot keys stay where they are: the table's few rows for those come to them."""
    few, rest = table.join(F.broadcast(hot), key, "left_semi"), table.join(F.broadcast(hot), key, "left_anti")
    return rows.join(F.broadcast(few), key, how).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(rest, key, how))


def _hot(counts: DataFrame, key: str, n: str) -> DataFrame:
    """The keys of counts, written already, that make up more than one in HOT_SHARE of all."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.filter(F.col(n) * HOT_SHARE > total).select(key)


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> node, label for each end of an edge: the least node of its component.

    Each round takes the least label among the neighbours and jumps to that label's own label, until none changes.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a")).distinct()
    both = materialize(both)
    rows = both.count()
    labels = materialize(_few(both.groupBy("node").agg(F.least("node", F.min("to")).alias("label")), rows))
    while True:
        near = both.join(labels.select(F.col("node").alias("to"), "label"), "to").groupBy("node").agg(F.min("label").alias("least"))
        lower = labels.join(near, "node").select("node", F.least("label", "least").alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        lower = lower.join(jump, "label", "left").select("node", F.least("label", "further").alias("label"), "was")
        lower = materialize(_few(lower, rows))
        labels = lower.select("node", "label")
        if lower.filter(F.col("label") != F.col("was")).isEmpty():
            return labels


def classed(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """docs(doc_id, text) -> doc_id, mark (hash of the text), node, label: the least node of the class of each row, written."""
    texts = materialize(signed_texts(docs, width))
    bands = texts.select("node", "bands").dropDuplicates(["node"]).select("node", F.explode("bands").alias("key"))
    shared = materialize(bands.groupBy("key").count().filter("count > 1"))
    hot = _hot(shared, "key", "count")
    members = materialize(_met(bands, shared.select("key"), "key", hot, "left_semi"))
    nodes = materialize(members.select("node").distinct())
    # one document stands for each node; only its text is read again
    chosen = texts.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("chosen")).select("chosen").distinct()
    source = docs.select("doc_id", "text").join(chosen, F.col("doc_id").eqNullSafe(F.col("chosen")), "left_semi")
    sets = materialize(shingle_sets(source, width).dropDuplicates(["node"]).join(nodes, "node", "left_semi"))
    # a shingle that one node alone has: counted once, its least node is that node
    alone = sets.select("node", F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node"))
    alone = alone.filter("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("u"))
    sizes = sets.select("node", F.size("items").alias("n")).join(alone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("v"))
    active = materialize(members.join(sizes, "node"))
    n_nodes = nodes.count()

    # two sets that are threshold alike share this part of the sum of their sizes
    share = threshold / (1 + threshold) - 1e-9
    labels, tested = nodes.select("node", F.col("node").alias("label")), None
    for turn in range(PIVOT_ROUNDS + 1):
        labelled = active.join(labels, "node")
        central = F.col("v") / F.col("n") if turn == 0 else F.lit(0.0)
        pivot = F.max_by(F.struct(F.col("node").alias("pivot"), F.col("label").alias("at"), F.col("n").alias("pn"), F.col("v").alias("pv")), F.struct(central, F.xxhash64("node", "key", F.lit(turn))))
        apart = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least"), pivot.alias("p")).filter("low < high").select("key", "least", "p.*")
        # buckets that are one component stay so: they are done; so are members that can have no partner in the bucket
        held = materialize(_met(labelled, apart, "key", hot).filter(F.col("v") >= share * (F.col("n") + F.col("least"))))
        active = held.select("node", "key", "n", "v")
        if turn < PIVOT_ROUNDS:
            pairs = held.filter((F.col("label") != F.col("at")) & (F.least("v", "pv") >= share * (F.col("n") + F.col("pn")))).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
        else:
            pairs = _across(held.select("node", "label", "n").distinct(), sets, share, threshold)
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        scored = materialize(verified(pairs, sets))
        if scored.isEmpty():
            if held.isEmpty():
                break
            continue
        tested = scored if tested is None else tested.union(scored)
        new = scored.filter(F.col("likeness") >= threshold)
        if new.isEmpty():
            continue
        # the new links as links between components
        ends = new.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
        joined_to = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")).filter("a <> b"))
        moved = joined_to.select(F.col("node").alias("label"), F.col("label").alias("now"))
        labels = materialize(_few(labels.join(moved, "label", "left").select("node", F.coalesce("now", "label").alias("label")), n_nodes))

    return materialize(texts.select("doc_id", "mark", "node").join(labels, "node", "left").select("doc_id", "mark", "node", F.coalesce("label", "node").alias("label")))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """docs(doc_id, text) -> doc_id, class_id (least id of the class), class_size (rows), class_texts (distinct texts)."""
    of = classed(docs, threshold, width)
    counted = of.groupBy("label", "node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = materialize(counted.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("class_texts")))
    return _met(of, classes, "label", _hot(classes, "label", "class_size")).select("doc_id", "class_id", "class_size", "class_texts")


def _across(nodes: DataFrame, sets: DataFrame, share: float, threshold: float) -> DataFrame:
    """(a, b) of different components that may be threshold alike, by a prefix join that misses none. nodes: node, label, n.

    The shingles of a node are ranked, the rarest first. Two nodes alike enough share one of their first
    n - ceil(threshold n) + 1; where the first that they share is the i-th of one and the j-th of the other, they share at most
    min(n1 - i, n2 - j) + 1. Entries that cannot reach what the smallest node with that shingle needs go before the
    join, and so do shingles that one component alone still has; this empties the shingles of the text that a group derives from.
    """
    items = sets.join(nodes, "node").select("node", "label", "n", F.explode("items").alias("item"))
    seen = materialize(items.groupBy("item").agg(F.count(F.lit(1)).alias("c")))
    ranked = _met(items, seen, "item", _hot(seen, "item", "c")).groupBy("node", "label", "n").agg(F.sort_array(F.collect_list(F.struct("c", "item"))).alias("rare"))
    width = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    prefix = materialize(ranked.select("node", "label", "n", F.posexplode(F.slice("rare", F.lit(1), width)).alias("i", "r")).select("node", "label", "n", "i", F.col("r.item").alias("item")))
    reach = F.col("n") - F.col("i")
    smallest = prefix.groupBy("item").agg(F.min("n").alias("least"))
    able = prefix.join(smallest, "item").filter(reach >= share * (F.col("n") + F.col("least"))).drop("least")
    mixed_items = able.groupBy("item").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("item")
    able = materialize(able.join(mixed_items, "item", "left_semi"))
    # the entries of one hot shingle are dealt into parts; each part meets all of them, part by part
    often = able.groupBy("item").count()
    entries = able.count()
    often = F.broadcast(often.filter(F.col("count") * HOT_SHARE > entries).select("item", F.lit(True).alias("often")))
    able = able.join(often, "item", "left").withColumn("often", F.coalesce("often", F.lit(False)))
    parts_of = F.when(F.col("often"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    other = able.select("item", F.explode(parts_of).alias("salt"), *[F.col(c).alias(f"other_{c}") for c in ("node", "label", "n", "i")])
    able = able.withColumn("salt", F.when(F.col("often"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).otherwise(0))
    enough = F.least(reach, F.col("other_n") - F.col("other_i")) >= share * (F.col("n") + F.col("other_n"))
    pairs = able.join(other, ["item", "salt"]).filter((F.col("node") < F.col("other_node")) & (F.col("label") != F.col("other_label")) & enough)
    return pairs.select(F.col("node").alias("a"), F.col("other_node").alias("b"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """The rows of docs that stand for their class, with all their columns: of the least id and, where rows repeat it, of one text and row."""
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    chosen = classed(docs, threshold, width).groupBy("label").agg(F.min(own).alias("least")).select("least.doc_id", "least.mark")
    kept_id, kept_mark, mark, first = free_names(docs.columns, "kept_id", "kept_mark", "mark", "first")
    chosen = chosen.select(F.col("doc_id").alias(kept_id), F.col("mark").alias(kept_mark))
    marked = docs.withColumn(mark, F.xxhash64(text_or_empty(F.col("text"))))
    rows = marked.join(chosen, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(mark) == F.col(kept_mark)), "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc_id", mark).orderBy("doc_id"))
    return rows.withColumn(first, nth).filter(F.col(first) == 1).select(*docs.columns)

"""The queries of this subpackage and, where SQL can express them, the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine.llm import langid_ecoc
from evidence_engine.llm import probminhash
from evidence_engine.llm import quality_pu
from evidence_engine.llm import secrets_cnn
from evidence_engine.llm import speculative_bpe
from evidence_engine.llm.byte_bpe import round_trip
from evidence_engine.llm.centroids import cluster
from evidence_engine.llm.exact_dedup import exact_dedup
from evidence_engine.llm.hard_negatives import mine
from evidence_engine.llm.line_dedup import line_dedup
from evidence_engine.llm.mixing import mix
from evidence_engine.llm.spotsigs import fingerprint, likeness, with_edits
from evidence_engine.llm.suffix_dedup import remove_repeats

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_dedup(documents(spark, sf_dir))
    return lines.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_edits(documents(spark, sf_dir))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("signatures")).alias("fingerprint"),
        fingerprint(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rows = round_trip(documents(spark, sf_dir), *vocabulary)
    return rows.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("body", 256).alias("decoded_sha256")
    )


def op4_langid_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = langid_ecoc.held_out(F.col("doc_id"), 4, 2)
    model = langid_ecoc.fit(docs.filter(~held))
    return langid_ecoc.predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_secrets_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secrets_cnn.scan(documents(spark, sf_dir))

    def of(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def written(spans_of):
        return F.array_join(F.transform(spans_of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    return spans.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(written(F.filter("spans", lambda s: s["kind"] != "model")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        "network",
    )


def op6_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = langid_ecoc.held_out(F.col("doc_id"), 3, 1)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality_pu.quality(documents(spark, sf_dir), labels, ~held)
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(documents(spark, sf_dir))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(documents(spark, sf_dir))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cluster(embeddings(spark, sf_dir))
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    rows = embeddings(spark, sf_dir).withColumn("label", F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))
    return mine(rows, vec_id % 100 == 0)


def op13_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = speculative_bpe.decode(speculative_bpe.encode(documents(spark, sf_dir), path), path)
    return rows.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("body", "UTF-8"), 256).alias("decoded_sha256")
    )


QUERIES: dict[str, Query] = {"op1_mix": op1_mix, "op9_exact_dedup": op9_exact_dedup, "op10_line_dedup": op10_line_dedup, "op2_spotsigs": op2_spotsigs, "op8_byte_bpe": op8_byte_bpe, "op4_langid_ecoc": op4_langid_ecoc, "op5_secrets_cnn": op5_secrets_cnn, "op6_quality_pu": op6_quality_pu, "op3_probminhash": op3_probminhash, "op7_suffix_dedup": op7_suffix_dedup, "op11_centroids": op11_centroids, "op12_hard_negatives": op12_hard_negatives, "op13_speculative_bpe": op13_speculative_bpe}


def _kmeans_sql(k: int = 8, rounds: int = 10, scale: int = 1024, width: int = 64) -> str:
    """The rounds written out: a<r> assigns all vectors to the centroids c<r>, c<r+1> are their means."""
    far = "list_sum(list_transform(list_zip(v.ints, c.ints), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT"
    parts = [f"""
v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS ints FROM embeddings
      WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR), ints) - 1)::INT AS cluster, ints FROM v
       ORDER BY sha256('3:' || vec_id::VARCHAR), ints LIMIT {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, any_value(ints) AS ints, min(d)::BIGINT AS distance, arg_min(cluster, d * {k} + cluster) AS cluster
       FROM (SELECT v.vec_id, v.ints, c.cluster, {far} AS d FROM v, c{r} c) GROUP BY vec_id)""")
        if r < rounds:
            parts.append(f"""
e{r} AS (SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n
         FROM (SELECT cluster, unnest(ints) AS x, generate_subscripts(ints, 1) AS i FROM a{r}) GROUP BY cluster, i),
m{r} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS ints FROM e{r} GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.ints, c.ints) AS ints FROM c{r} c LEFT JOIN m{r} m ON c.cluster = m.cluster)""")
    return f"""
WITH {",".join(parts)}
SELECT a.vec_id, a.cluster, a.distance, sum(a.distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia,
       sum(a.distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.ints, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster
"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op11_centroids": _kmeans_sql(),
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS ints FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other,
             list_sum(list_transform(list_zip(a.ints, b.ints), lambda x: x[1] * x[2]))::BIGINT AS score
           FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
o AS (SELECT anchor_id, other AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS nth FROM s WHERE same),
n AS (SELECT o.*, s.other AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY o.anchor_id, o.positive_id ORDER BY s.score DESC, s.other)::INT AS rank
      FROM o JOIN s ON o.anchor_id = s.anchor_id
      WHERE o.nth <= 5 AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
""",
    "op1_mix": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
             md5(coalesce(doc_id::VARCHAR, '') || ':mix:' || coalesce(text, '')) AS mark FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
c AS (SELECT *, (2 * source_size)::DOUBLE AS cap, (2 * source_size)::DOUBLE / weight AS used_at,
        (SELECT sum(source_size)::DOUBLE * 1.5 FROM s) AS budget FROM w),
r AS (SELECT *, row_number() OVER o AS nth,
        (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS reach
      FROM c WINDOW o AS (ORDER BY used_at, source NULLS LAST)),
l AS (SELECT arg_min(reach, nth) AS level FROM r WHERE used_at > reach),
t AS (SELECT source, source_size, weight, budget, CASE WHEN level IS NULL OR used_at <= level THEN cap ELSE weight * level END AS target FROM r, l),
u AS (SELECT d.*, t.source_size, t.weight, t.budget, t.target,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY mark, doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT u.*, e.epoch, (upto + e.epoch * source_size)::DOUBLE / weight AS finish FROM u, (VALUES (0), (1)) e(epoch)),
q AS (SELECT *, sum(size) OVER (ORDER BY finish, mark, doc_id NULLS FIRST, epoch, size ROWS UNBOUNDED PRECEDING)::DOUBLE AS total FROM p)
SELECT doc_id, size, source_size, target, sum(CASE WHEN total <= budget THEN size ELSE 0 END)::BIGINT AS taken
FROM q GROUP BY doc_id, source, size, source_size, target, upto
""",
    "op9_exact_dedup": f"""
WITH n AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256 FROM n
""",
    "op10_line_dedup": rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM e),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY rid, doc_id
""",
}

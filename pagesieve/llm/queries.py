"""One query for each training-data operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.llm import (
    decontamination, hard_negatives, jaccard_groups, languages, line_dedup, merkle, neighbours, packing, private_data, quality, resharding,
    toxicity, warc)
from pagesieve.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}.parquet"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op4_flow_resharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes, moving the fewest bytes."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    layout = resharding.reshard(spark, _path(folder, "documents"), 16, size)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return resharding.read_shards(spark, layout).select(
        F.col("row.doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op6_first_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(spark.read.parquet(_path(folder, "documents")), tokenizer_path())


@query
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the later copies of repeated three-line windows removed."""
    done = line_dedup.dedup_lines(spark.read.parquet(_path(folder, "documents")).select("doc_id", "text"))
    return done.select(
        "doc_id", F.col("_lines").cast("long").alias("n_lines"), F.col("_removed_lines").cast("long").alias("n_removed"),
        F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


ORACLE["op7_line_dedup"] = """
WITH lines AS (
    SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
windows AS (
    SELECT doc_id, pos, array_to_string(parts[pos:pos + 2], chr(10)) AS content
    FROM (SELECT doc_id, parts, unnest(range(1, len(parts) - 1)) AS pos FROM lines)
    WHERE NOT regexp_full_match(array_to_string(parts[pos:pos + 2], ''), '\\s*')),
ranked AS (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY content ORDER BY doc_id, pos) AS place FROM windows),
gone AS (
    SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS line FROM ranked WHERE place > 1),
kept AS (
    SELECT l.doc_id, count(*) FILTER (g.line IS NOT NULL) AS n_removed,
        coalesce(string_agg(l.part, chr(10) ORDER BY l.line) FILTER (g.line IS NULL), '') AS text
    FROM (SELECT doc_id, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS line FROM lines) l
    LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line
    GROUP BY l.doc_id)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(d.parts) END AS BIGINT) AS n_lines,
    CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
    CAST(CASE WHEN d.text IS NULL THEN NULL ELSE length(k.text) END AS BIGINT) AS n_chars,
    CASE WHEN d.text IS NULL THEN NULL ELSE md5(k.text) END AS text_md5
FROM lines d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


@query
def op10_simhash_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and benchmark item of which it holds a passage."""
    return decontamination.matches(
        spark.read.parquet(_path(folder, "documents")), spark.read.parquet(_path(folder, "benchmark")))


@query
def op8_bootstrapped_private_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document: the fixed kinds and what contexts reveal."""
    found = private_data.private_spans(spark.read.parquet(_path(folder, "documents")))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{private_data.KINDS[k]}")

    counts = map(count, range(len(private_data.KINDS)))
    return found.select("doc_id", *counts, "base_sha256", private_data.spans_text("spans").alias("spans"))


@query
def op9_weak_label_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The quality score of every document, and whether it is accepted."""
    done = quality.judge(spark.read.parquet(_path(folder, "documents")).select("doc_id", "text"))
    return done.select("doc_id", F.col("_score").alias("score"), (F.col("_score") >= quality.THRESHOLD).alias("accepted"))


@query
def op1_dictionary_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to archives and read back."""
    path = f"{shared_dir(spark, 'warc')}/archives"
    warc.write_archives(spark.read.parquet(_path(folder, "pages")), path)
    return warc.read_archives(spark, path, payload=False).drop("url", "payload")


ORACLE["op1_dictionary_warc"] = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
    CASE WHEN f.first IS NULL OR f.first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN f.first <> page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON f.digest = p.digest
"""


@query
def op5_token_group_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """The shingle set size and the component of every document."""
    return jaccard_groups.components(spark.read.parquet(_path(folder, "documents"))).drop("text_key")


@query
def op2_multiprobe_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest of each embedding whose id is divisible by 20."""
    return neighbours.nearest(spark.read.parquet(_path(folder, "embeddings")))


@query
def op3_recurrent_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity of every document."""
    docs = spark.read.parquet(_path(folder, "documents")).select("doc_id", "text")
    network = toxicity.fit(docs, spark.read.parquet(_path(folder, "labels")))
    return toxicity.scored(docs, network).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A Merkle tree over all documents, and whether each, as found later, still leads to its root."""
    docs = spark.read.parquet(_path(folder, "documents"))
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    later = {"text": F.when(tampered, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))}
    rows = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", later)
    folded = merkle.fold(F.coalesce("later_leaf", "leaf"))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _merkle_sql(leaf_levels: int = 8, group_levels: int = 4) -> str:
    """Levels unrolled: 8^8 documents a language and 8^4 languages."""
    def level(k: int, source: str) -> str:
        """Nodes with what flanks them; and their parents, which a tree of one node lacks."""
        return f"""
{source}f{k} AS (SELECT *, count(*) OVER (PARTITION BY g) AS n,
    coalesce(string_agg(h, '') OVER (PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM {source}{k}),
{source}{k + 1} AS (SELECT g, pos // 8 AS pos, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h
    FROM {source}f{k} GROUP BY g, pos // 8),"""

    def step(before: str, after: str, source: str, k: int, at: str) -> str:
        return f"""
{after} AS (SELECT p.* REPLACE (
    CASE WHEN f.n = 1 THEN folded ELSE sha256(f.l || folded || f.r) END AS folded, proof || f.l || f.r AS proof)
    FROM {before} p JOIN {source}f{k} f ON f.g = {'p.g' if source == 'a' else '0'} AND f.pos = {at} // {8 ** k}),"""

    def hashed(text: str) -> str:
        parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(parts)})"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    byte = "list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b))"
    crc = f"xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: ascii(d)::BIGINT), lambda c, b: {byte}, 4294967295), 4294967295)"
    leaves = "".join(level(k, "a") for k in range(leaf_levels))
    groups = "".join(level(k, "b") for k in range(group_levels))
    steps = "".join(step(f"p{k}", f"p{k + 1}", "a", k, "p.pos") for k in range(leaf_levels))
    steps += "".join(step(f"p{leaf_levels + k}", f"p{leaf_levels + k + 1}", "b", k, "p.g") for k in range(group_levels))
    return f"""
WITH d AS (SELECT doc_id, {hashed('text')} AS h, CASE WHEN {crc} % 3 = 0 THEN {hashed(lowered)} ELSE {hashed('text')} END AS folded,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM documents),
p0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, '' AS proof FROM d),
a0 AS (SELECT g, pos, h FROM p0),{leaves}
b0 AS (SELECT 0 AS g, g AS pos, h FROM a{leaf_levels}),{groups}{steps}
root AS (SELECT h AS root FROM b{group_levels})
SELECT doc_id, p.h AS leaf, a.h AS subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM p{leaf_levels + group_levels} p JOIN a{leaf_levels} a ON a.g = p.g CROSS JOIN root
"""


ORACLE["op13_merkle_manifest"] = _merkle_sql()


@query
def op12_cross_parsing_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document."""
    docs = spark.read.parquet(_path(folder, "documents"))
    return languages.predicted(docs, languages.fit(docs)).select(
        "doc_id", languages.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op11_coordinate_pruned_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of each embedding whose id is divisible by 100, for each of its five nearest of the same label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(_path(folder, "embeddings")).select(
        "vec_id", label.alias("label"), hard_negatives.quantised(F.col("embedding")).alias("vector"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


ORACLE["op11_coordinate_pruned_negatives"] = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
        CAST(list_sum(list_transform(range(1, len(a.vector) + 1), lambda i: a.vector[i] * b.vector[i])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.vector) = len(b.vector) WHERE a.vec_id % 100 = 0),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""

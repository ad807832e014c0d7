"""The llm queries of __spark_entry__: name -> function, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegauge.llm import annulus, divergence, exact, imatch, lines, lm, mixing, packing, simhash, tiff, tokens, toxicity, warc
from notegauge.llm.common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op2_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op5_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tiff.encode_texts(table(spark, sf_dir, "documents"))
    files = files.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    pages = tiff.pages(files)
    size = F.octet_length("samples")
    return pages.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -64, 64)")).alias("tail_crc32"), "media_bytes", "media_sha256", "feature",
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    return scored.select("doc_id", held_out.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op11_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annulus.clusters(table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.over(spark, f"{sf_dir}/documents.parquet").result()
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_imatch_fingerprints": op2_imatch_fingerprints,
    "op3_lm_scores": op3_lm_scores,
    "op4_warc": op4_warc,
    "op5_tiff_pages": op5_tiff_pages,
    "op6_line_dedup": op6_line_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_source_mix": op8_source_mix,
    "op9_packing": op9_packing,
    "op10_token_counts": op10_token_counts,
    "op11_annulus_clusters": op11_annulus_clusters,
    "op12_source_divergence": op12_source_divergence,
    "op13_exact_dedup": op13_exact_dedup,
}

#: XXH64, the tokenizer and trained models are beyond SQL; those queries are tested against brute force.
ORACLES: dict[str, str] = {}

ORACLES["op4_warc"] = """
WITH own AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
kept AS (SELECT payload_digest, max(page_id) AS last FROM own WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM own LEFT JOIN kept USING (payload_digest)
"""

ORACLES["op6_line_dedup"] = r"""
WITH line AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS s, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents
), keyed AS (
    SELECT *, translate(trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line
), frequent AS (
    SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT doc_id, s, n, coalesce(doc_id <> last, false) AS gone FROM keyed LEFT JOIN frequent USING (k)
)
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(s, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id
"""

ORACLES["op8_source_mix"] = rf"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sized AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS position FROM d GROUP BY source
), capped AS (
    SELECT *, [5.0, 2.0, 1.0][(position - 1) % 3 + 1]::DOUBLE AS weight, ({mixing.REPEATS} * source_size)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM sized
), levels AS (
    SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, position ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped
), plan AS (
    SELECT source, source_size, position, least(cap, weight * (SELECT level FROM levels WHERE cap / weight >= level ORDER BY cap / weight, position LIMIT 1)) AS target FROM levels
), size AS (
    SELECT greatest(1, least({mixing.BLOCK}, sum(size)::BIGINT // {mixing.SLOTS})) AS block, sum(size)::BIGINT AS total FROM d
), share AS (
    SELECT position, coalesce(lag(finish) OVER (ORDER BY position), 0) AS lo, CASE WHEN position = max(position) OVER () THEN {mixing.CIRCLE} ELSE finish END AS hi
    FROM (SELECT position, least(floor(sum(target) OVER (ORDER BY position) / sum(target) OVER () * {mixing.CIRCLE}::DOUBLE)::BIGINT, {mixing.CIRCLE - 1}) AS finish FROM plan WHERE target > 0)
), point AS (
    SELECT i::HUGEINT * {mixing.GOLDEN} % {mixing.CIRCLE} AS x FROM (SELECT unnest(range((SELECT total // block FROM size))) AS i)
), drawn AS (
    SELECT position, count(*) AS slots FROM point JOIN share ON x >= lo AND x < hi GROUP BY position
), laid AS (
    SELECT doc_id, size, source_size, position, target, coalesce(sum(size) OVER (PARTITION BY position ORDER BY md5(doc_id::VARCHAR), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
    FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source
)
SELECT doc_id, size, source_size, target, ({" + ".join(f"greatest(0, least(size, coalesce(slots, 0) * block - begins - {t} * source_size))" for t in range(mixing.REPEATS))})::BIGINT AS taken
FROM laid LEFT JOIN drawn USING (position) CROSS JOIN size
"""

#: The exact sums fit in HUGEINT; a round is a pair of steps, so the rounds are written out.
_MEANS = "SELECT cluster, i, ((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS v FROM near{r} JOIN vector USING (vec_id) GROUP BY cluster, i"
_NEAR = """near{r} AS MATERIALIZED (
    SELECT vec_id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT vec_id, cluster, sum((a.v - b.v) * (a.v - b.v))::BIGINT AS d FROM vector a JOIN centre{r} b USING (i) GROUP BY vec_id, cluster) GROUP BY vec_id
)"""
_CENTRE = """centre{n} AS MATERIALIZED (
    WITH mean AS ({means}) SELECT cluster, i, coalesce(mean.v, old.v) AS v FROM centre{r} old LEFT JOIN mean USING (cluster, i)
)"""
_ROUNDS = ",\n".join(f"{_NEAR.format(r=r)},\n{_CENTRE.format(n=r + 1, r=r, means=_MEANS.format(r=r))}" for r in range(annulus.ROUNDS))

ORACLES["op11_annulus_clusters"] = f"""
WITH kept AS (
    SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {annulus.DIM} AND len(list_filter(embedding, lambda x: isfinite(x::DOUBLE))) = {annulus.DIM}
), vector AS MATERIALIZED (
    SELECT vec_id, unnest(range({annulus.DIM})) AS i, unnest(list_transform(embedding, lambda x: floor({annulus.SCALE} * x::DOUBLE)::BIGINT)) AS v FROM kept
), centre0 AS MATERIALIZED (
    SELECT cluster, i, v FROM (SELECT vec_id, row_number() OVER (ORDER BY sha256('{annulus.SEED}:' || vec_id)) - 1 AS cluster FROM kept) JOIN vector USING (vec_id) WHERE cluster < {annulus.K}
), {_ROUNDS}, {_NEAR.format(r=annulus.ROUNDS)}
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM near{annulus.ROUNDS} JOIN (SELECT cluster, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM centre{annulus.ROUNDS} GROUP BY cluster) USING (cluster)
"""

_SHARE = f"1 + {divergence.UNIT}::HUGEINT * ({{n}} + {divergence.ADDED}) // ({{total}} + {divergence.ADDED} * {{size}})"
ORACLES["op12_source_divergence"] = rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), word AS MATERIALIZED (
    SELECT r, lang, source, unnest(terms) AS term FROM d
), vocabulary AS MATERIALIZED (
    SELECT lang, term FROM word GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.LEAST}
), n AS MATERIALIZED (
    SELECT lang, source, term, count(*) AS n FROM word JOIN vocabulary USING (lang, term) GROUP BY ALL
), size AS (
    SELECT lang, count(*) AS size FROM vocabulary GROUP BY lang
), g AS MATERIALIZED (
    SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN n USING (lang, source) GROUP BY ALL
), p AS MATERIALIZED (
    SELECT lang, source, term, coalesce(n, 0) AS n, {_SHARE.format(n="coalesce(n, 0)", total="total", size="size")} AS p FROM g JOIN vocabulary USING (lang) JOIN size USING (lang) LEFT JOIN n USING (lang, source, term)
), q AS MATERIALIZED (
    SELECT lang, term, {_SHARE.format(n="sum(n)::HUGEINT", total="(sum(sum(n)) OVER (PARTITION BY lang))::HUGEINT", size="count(*) OVER (PARTITION BY lang)")} AS q FROM n GROUP BY lang, term
), pair AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y USING (lang, term) GROUP BY ALL) f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), telling AS (
    SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pair
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM telling) WHERE rank <= {divergence.TOP}
"""

ORACLES["op13_exact_dedup"] = r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents
)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY content ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY content) AS group_size, row_number() OVER (PARTITION BY content ORDER BY n DESC, doc_id) = 1 AS kept, sha256(content) AS text_sha256
FROM d
"""

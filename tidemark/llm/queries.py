"""One query per operator, on its whole table, and the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import ann, byte_bpe, clustering, jaccard, language, packing, quality, ranked_search, sharding, suffix_dedup, token_counts, topk, warc
from tidemark.llm.common import keep, table, work_folder


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), separator=2)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.mark_repeats(table(spark, sf_dir, "documents"), length=400).drop("k", "kept")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "warc")
    index = keep(warc.write_bundles(warc.mark_revisits(table(spark, sf_dir, "pages")), folder), "warc-index")
    read = warc.read_records(index, folder)
    # equal to its digest, so what was read is what was written
    whole = F.when(F.col("record_type") == "response", F.sha1("payload")).otherwise(F.col("payload_digest"))
    size = F.when(F.col("record_type") == "response", F.octet_length("payload")).otherwise(F.col("payload_bytes"))
    return read.select(
        "page_id", size.cast("long").alias("payload_bytes"), whole.alias("payload_digest"), "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf_dir, "documents"), width=3, percent=90)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = language.fit(documents.filter(~held_out))
    return language.predict(documents, model).withColumn("held_out", held_out)


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return ann.nearest(embeddings, embeddings.filter("vec_id % 20 = 0"), top=20)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), max_bytes=1 << 20)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(
        table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return topk.top_k(embeddings, embeddings.filter("vec_id % 100 = 0"), k=10)


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.with_inertia(*clustering.clusters_of(table(spark, sf_dir, "embeddings"), clusters=16, rounds=3))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=50)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = lambda: F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    learned = quality.fit(documents, table(spark, sf_dir, "labels").filter(~held_out()))
    return quality.score(documents, learned, threshold=0.3).withColumn("held_out", held_out())


QUERIES = {
    "op1_packing": op1_packing,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_warc": op4_warc,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_language_id": op6_language_id,
    "op7_ann": op7_ann,
    "op8_sharding": op8_sharding,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_topk": op10_topk,
    "op11_clustering": op11_clustering,
    "op12_ranked_search": op12_ranked_search,
    "op13_quality": op13_quality,
}


def _rounds_sql(rounds: int) -> str:
    """Centroids c0 ... c<rounds> and the assignments a0 ... a<rounds> of every vector to each of them."""
    parts = []
    for i in range(rounds + 1):
        if i:
            parts.append(f"""l{i} AS (
    SELECT c, unnest(v) AS x, unnest(range(64)) AS pos FROM a{i - 1}
), m{i} AS (
    SELECT c, pos, CAST(sum(x) AS HUGEINT) AS total, count(*) AS n FROM l{i} GROUP BY ALL
), c{i} AS (
    SELECT c, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS v FROM m{i} GROUP BY c
    UNION ALL SELECT c, v FROM c{i - 1} WHERE c NOT IN (SELECT c FROM m{i})
)""")
        parts.append(f"""d{i} AS (
    SELECT r, vec_id, s.v, c,
           CAST(list_sum(list_transform(list_zip(s.v, k.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance
    FROM sound s, c{i} k
), a{i} AS (
    SELECT * FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, c) = 1
)""")
    return ", ".join(parts)


SQL = {
    "op4_warc": """
WITH records AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), sized AS (
    SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM records
), marked AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS largest FROM sized
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> largest THEN largest END AS refers_to
FROM marked
""",
    "op8_sharding": """
WITH rows AS (
    SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes,
           CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS bits
    FROM documents
), sized AS (
    SELECT depth, bits >> (60 - depth) AS prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows
    FROM rows, (SELECT CAST(unnest(range(0, 61)) AS INTEGER) AS depth) GROUP BY ALL
), fitting AS (
    SELECT * FROM sized WHERE shard_bytes <= 1048576 OR shard_rows = 1
), shortest AS (
    SELECT doc_id, n_bytes, bits, min(fitting.depth) AS depth
    FROM rows JOIN fitting ON rows.bits >> (60 - fitting.depth) = fitting.prefix GROUP BY ALL
)
SELECT doc_id, n_bytes, shortest.depth, shard_bytes, shard_rows, shard_bytes > 1048576 AS oversized,
       substr(right(repeat('0', 60) || bin(bits), 60), 1, shortest.depth) AS shard
FROM shortest JOIN fitting ON shortest.depth = fitting.depth AND shortest.bits >> (60 - shortest.depth) = fitting.prefix
""",
    "op11_clustering": """
WITH sound AS (
    SELECT row_number() OVER () AS r, vec_id,
           list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), hashed AS (
    SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS hash, v FROM sound ORDER BY hash NULLS LAST, v LIMIT 16
), c0 AS (
    SELECT row_number() OVER (ORDER BY hash NULLS LAST, v) - 1 AS c, v FROM hashed
), """
    + _rounds_sql(3)
    + """
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (c)
""",
    "op12_ranked_search": r"""
WITH words AS (
    SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents WHERE text IS NOT NULL
), docs AS (
    SELECT *, len(terms) AS n FROM words WHERE len(terms) > 0
), totals AS (
    SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs
), postings AS (
    SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY ALL
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE item_id IS NOT NULL
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals
), scores AS (
    SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN docs USING (r), totals
    WHERE doc_id IS NOT NULL GROUP BY ALL
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scores WHERE score > 0
)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 50
""",
    "op10_topk": """
WITH sound AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), long AS (
    SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS at FROM sound
), scores AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
    FROM long q JOIN long c ON q.at = c.at AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scores
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 10
""",
}

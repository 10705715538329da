"""One query per operator over its whole table, with production parameters; SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm import archives, decontaminate, hamming_index, jaccard_tree, knn_quality, ngram_trie, packing, resampling, secrets, suffix_groups, token_files, va_search, whitening
from tradewind.llm.shared import importable, shared_folder
from tradewind.llm.tokenizing import default_vocabulary

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "archives")
    arcs = archives.write_arc(table(spark, sf_dir, "pages"), folder)
    found = archives.records(archives.convert(spark, arcs, folder, least_bytes=0))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
g AS (SELECT page_id, payload, min(page_id) OVER (PARTITION BY payload) AS first_page FROM p)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + (((('0x' || substr(sha1(payload), (1 + 5 * (k // 4))::INTEGER, 5))::INTEGER) >> (15 - 5 * (k % 4))::INTEGER) & 31), 1)), '') AS payload_digest,
    CASE WHEN first_page IS NULL OR first_page = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first_page = page_id THEN NULL ELSE first_page END AS refers_to
FROM g
"""


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.digest(packing.pack(spark, docs, shared_folder(spark, "packing"), default_vocabulary()))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = knn_quality.fit(spark, docs, table(spark, sf_dir, "labels"))
    return knn_quality.classified(knn_quality.score(spark, docs, model))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return va_search.top_k(spark, vectors, F.col("vec_id") % 100 == 0, shared_folder(spark, "va-search"), k=10, scale=1024)


OP4_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) AS rank
    FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
) WHERE rank <= 10
"""


def op5_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trie = ngram_trie.train(spark, docs.where(~ngram_trie.held_out()), shared_folder(spark, "ngram-trie"))
    return ngram_trie.digest(ngram_trie.score(docs, trie), trie)


def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_groups.without_repeats(spark, table(spark, sf_dir, "documents"), shared_folder(spark, "repeats"))


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.spans(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-files")
    manifest = token_files.write(spark, table(spark, sf_dir, "documents"), folder, default_vocabulary())
    return token_files.digest(token_files.read(manifest))


def op10_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_tree.groups(spark, table(spark, sf_dir, "documents"), shared_folder(spark, "jaccard"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
        WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w
),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 75 * (nx.c + ny.c - i)),
r AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.other = l.x)
SELECT r.doc_id, coalesce(any_value(n.c), 0)::BIGINT AS n_shingles, min(r.other) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY 1
"""


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.draw(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shared_folder(spark, "resampling"))


OP11_SQL = r"""
WITH RECURSIVE steps AS (
    SELECT i, 0 AS k, i::BIGINT AS v FROM range(256) t(i)
    UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8
),
crc AS (SELECT list(v ORDER BY i) AS codes FROM steps WHERE k = 8),
texts AS (
    SELECT row_number() OVER () AS row, doc_id, text FROM documents
    UNION ALL SELECT -row_number() OVER (), NULL, text FROM benchmark
),
w AS (
    SELECT row, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM texts
),
spans AS (
    SELECT row, span, count(*) AS c FROM (SELECT row, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]),
        list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))) AS span FROM w) GROUP BY ALL
),
features AS (
    SELECT span, xor(list_reduce(list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
        lambda v, b: xor(v >> 8, codes[1 + (xor(v, b) & 255)]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT span, hex(encode(span)) AS h FROM spans), crc
),
counted AS (SELECT row, bucket, sum(c) AS c FROM spans JOIN features USING (span) GROUP BY ALL),
both_sides AS (SELECT bucket, sum(c) FILTER (row > 0) AS s, sum(c) FILTER (row < 0) AS t FROM counted GROUP BY ALL),
gains AS (
    SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((sum(s) OVER ())::DOUBLE + 10000)
        / ((coalesce(s, 0)::DOUBLE + 1) * (coalesce(sum(t) OVER (), 0)::DOUBLE + 10000))))::BIGINT AS gain FROM both_sides
),
weights AS (SELECT row, sum(c * gain)::BIGINT AS weight FROM counted JOIN gains USING (bucket) WHERE row > 0 GROUP BY ALL),
scored AS (
    SELECT row, doc_id, len(words) AS n_words, greatest(0, 3 * len(words) - 3 + if(len(words) = 1, 1, 0))::BIGINT AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM w LEFT JOIN weights USING (row) WHERE row > 0
),
places AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank FROM scored LEFT JOIN places USING (row)
"""


def op12_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_index.top_k(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, shared_folder(spark, "hamming-index"), k=5)


def op13_whitened_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark, table(spark, sf_dir, "embeddings"), shared_folder(spark, "whitening"), count=16, scale=64, offset=1_000_000)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    importable(spark)
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: list[Query] = [
    op1_arc_to_warc,
    op2_best_fit_packing,
    op3_quality_classifier,
    op4_exact_top_k,
    op5_ngram_scores,
    op6_repeated_bytes,
    op7_benchmark_leaks,
    op8_secret_scan,
    op9_token_files,
    op10_jaccard_groups,
    op11_importance_resampling,
    op12_nearest_vectors,
    op13_whitened_vectors,
    pipeline,
]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """No SQL: tokenizer ids and the packing of them (2, 9), learned scores (3, 5), edit distances (7), test batteries (8),
    repeated byte strings over all texts (6), approximate search (12) and eigenvectors (13); ``tests/llm`` has brute-force versions of these."""
    return {"op1_arc_to_warc": OP1_SQL, "op4_exact_top_k": OP4_SQL, "op10_jaccard_groups": OP10_SQL, "op11_importance_resampling": OP11_SQL}

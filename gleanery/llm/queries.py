"""Registered queries of the training-data operators, and SQL where it can express them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import (
    bpe, decontam, html_main, licenses, mixing, pii, prefix_trie, quality, simhash,
    tokens, topk, toxicity, turn_repair,
)
from gleanery.llm.conversation_sql import PREFIX_TRIE_SQL, TURN_REPAIR_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_model() -> str:
    """Where the vocabulary file lies on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def word_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents")).drop("detections")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), token_model)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_texts(table(spark, sf_dir, "pages"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_topk(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.rated(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminations(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(table(spark, sf_dir, "conversations"))


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_texts(table(spark, sf_dir, "documents"), word_model)
    return coded.select(
        "doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_personal_data, op3_license_scan, op4_token_counts, op5_main_text,
        op6_exact_topk, op7_quality, op8_source_mix, op9_contamination, op10_near_duplicates,
        op11_prefix_trie, op12_turn_repair, op13_bpe_round_trip,
    )
}

_WORDS_SQL = r"regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# The other operators are beyond SQL: trained models, hashes it lacks, vocabularies, cuts of
# graphs, and patterns with conditions on their surroundings. They are tested by brute force.
ORACLES = {
    "op11_prefix_trie": PREFIX_TRIE_SQL,
    "op12_turn_repair": TURN_REPAIR_SQL,
    "op6_exact_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scores AS (
          SELECT q.vec_id AS query_id, c.vec_id,
                 CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
          WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place
          FROM scores
        ) WHERE place <= 10""",
    "op9_contamination": f"""
        WITH items AS (
          SELECT item_id, words, least(5, len(words)) AS n
          FROM (SELECT item_id, {_WORDS_SQL} AS words FROM benchmark) WHERE len(words) > 0
        ),
        item_shingles AS (
          SELECT DISTINCT item_id, n, array_to_string(words[i : i + n - 1], ' ') AS s
          FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS i FROM items)
        ),
        totals AS (SELECT item_id, count(*) AS total FROM item_shingles GROUP BY item_id),
        texts AS (
          SELECT doc_id, {_WORDS_SQL} AS words FROM documents
        ),
        doc_shingles AS (
          SELECT DISTINCT doc_id, n, array_to_string(words[i : i + n - 1], ' ') AS s
          FROM (
            SELECT *, unnest(range(1, len(words) - n + 2)) AS i
            FROM texts, (SELECT DISTINCT n FROM items)
          )
        )
        SELECT doc_id, item_id, count(*) AS shared, total AS item_shingles,
               count(*) / CAST(total AS DOUBLE) AS containment
        FROM doc_shingles JOIN item_shingles USING (n, s) JOIN totals USING (item_id)
        GROUP BY doc_id, item_id, total HAVING count(*) >= 0.8 * total - 1e-9""",
}

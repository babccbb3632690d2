"""Table schemas of the corpus, evaluation and control tables."""

from pyspark.sql import types as T

ARTICLE_META = T.StructType(
    [T.StructField(c, T.StringType())
     for c in ["pmid", "title", "authors", "journal", "year", "mesh_terms", "doi"]]
)
ABSTRACTS = T.StructType(
    [T.StructField("pmid", T.StringType()), T.StructField("abstract", T.StringType())]
)
REGISTRY = T.StructType([T.StructField("pmid", T.StringType())])
CHUNKS = T.StructType([
    T.StructField("pmid", T.StringType()),
    T.StructField("chunk_id", T.StringType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("chunk", T.StringType()),
])
EMBEDDINGS = T.StructType(
    CHUNKS.fields
    + [T.StructField("embedding", T.ArrayType(T.FloatType())),
       T.StructField("model", T.StringType())]
)
EVAL_QUESTIONS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ["question", "chunk_id", "pmid", "source_chunk"]]
)
EMBEDDING_RESULTS = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("model_path", T.StringType()),
    T.StructField("embedding_dim", T.LongType()),
    T.StructField("num_eval_pairs", T.LongType()),
    T.StructField("hit_rate_at_5", T.DoubleType()),
    T.StructField("mrr_at_5", T.DoubleType()),
    T.StructField("hit_rate_at_10", T.DoubleType()),
    T.StructField("mrr_at_10", T.DoubleType()),
    T.StructField("evaluated_at", T.TimestampType()),
])
GENERATION_RESULTS = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("avg_faithfulness", T.DoubleType()),
    T.StructField("avg_relevance", T.DoubleType()),
    T.StructField("avg_conciseness", T.DoubleType()),
    T.StructField("composite_score", T.DoubleType()),
    T.StructField("evaluated_at", T.TimestampType()),
])
FAILURES = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("evaluated_at", T.TimestampType()),
])
SEARCH_TERMS = T.StructType([
    T.StructField("term", T.StringType()),
    T.StructField("active", T.BooleanType()),
    T.StructField("last_run_at", T.TimestampType()),
    T.StructField("run_count", T.IntegerType()),
    T.StructField("last_searched_through", T.DateType()),
])
PRODUCTION_CONFIG = T.StructType([
    T.StructField("config_version", T.IntegerType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("updated_by", T.StringType()),
    T.StructField("generation_model_name", T.StringType()),
    T.StructField("embedding_model_name", T.StringType()),
    T.StructField("embedding_model_path", T.StringType()),
    T.StructField("embedding_dimension", T.IntegerType()),
])
CONVERSATION_HISTORY = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("turn_number", T.IntegerType()),
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("query_used", T.StringType()),
    T.StructField("chunks_retrieved", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])
SESSION_STATES = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("state_json", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

CONFIG_FIELDS = [
    "generation_model_name",
    "embedding_model_name",
    "embedding_model_path",
    "embedding_dimension",
]

"""Registered queries: de-duplication, merges, updates, differences and parsing."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.vectors import has_dimension
from gleanery.operators import keys as ops
from gleanery.operators.rotation import mark_runs
from gleanery.plans.ingest import new_articles, new_records, search_report
from gleanery.queries.common import table
from gleanery.sources.articles import parse_articles

# Runs of a term, as the control tables keep them.
TERMS_SQL = """
terms AS (
  SELECT c_name AS term, c_acctbal > 0 AS active,
         max(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate END) AS last_run_at,
         CAST(count(o_orderkey) AS INTEGER) AS run_count,
         CAST(max(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate END) AS DATE)
           AS last_searched_through
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_name, c_acctbal
)"""


def anti_join_registry(spark, sf):
    docs, registry = table(spark, sf, "documents"), table(spark, sf, "labels")
    return ops.unseen(docs.select("doc_id"), registry, "doc_id")


def search_counts(spark, sf):
    """Parts searched by order lines against the parts already shipped in full boxes."""
    lines = table(spark, sf, "lineitem")
    registry = lines.where(F.col("l_quantity") >= 50).select("l_partkey")
    return search_report(lines, registry, "l_partkey")


def merge_insert_only(spark, sf):
    target = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("payload")
    )
    source = table(spark, sf, "events").select(
        F.col("user_id").alias("id"), F.col("event_type").alias("payload"), "ts", "event_id"
    )
    first = [F.asc("ts"), F.asc("event_id")]
    added = ops.absent_rows(target, source, "id", first)
    return target.unionByName(added.select("id", "payload"))


def registry_union(spark, sf):
    registry, found = table(spark, sf, "labels"), table(spark, sf, "documents")
    return ops.union_keys(registry, found, key="doc_id")


def seed_if_empty(spark, sf):
    """One table with rows keeps them; an empty one takes the defaults."""
    defaults = table(spark, sf, "nation").select(F.col("n_name").alias("name"))
    filled = table(spark, sf, "customer").select(F.col("c_name").alias("name"))
    empty = table(spark, sf, "orders").where(F.col("o_totalprice") < 0).select(
        F.col("o_orderpriority").alias("name")
    )
    kept = ops.seed_if_empty(filled, defaults).withColumn("target", F.lit("filled"))
    seeded = ops.seed_if_empty(empty, defaults).withColumn("target", F.lit("empty"))
    return kept.unionByName(seeded)


def keyed_update(spark, sf):
    """Every order is a run of its customer's term."""
    terms = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("term"),
        (F.col("c_acctbal") > 0).alias("active"),
        F.lit(None).cast("timestamp_ntz").alias("last_run_at"),
        F.lit(0).alias("run_count"),
        F.lit(None).cast("date").alias("last_searched_through"),
    )
    runs = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("term"),
        F.col("o_orderdate").alias("run_at"),
        F.col("o_orderdate").cast("date").alias("searched_through"),
    )
    return mark_runs(terms, runs)


def snapshot_diff(spark, sf):
    """Labels as the index, a rule over the documents as the source."""
    return ops.snapshot_diff(_stored(spark, sf), _derived(spark, sf), "doc_id")


def snapshot_apply(spark, sf):
    index, source = _stored(spark, sf), _derived(spark, sf)
    changes = ops.snapshot_diff(index, source, "doc_id")
    return ops.apply_changes(index, source, changes, "doc_id")


def _stored(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("flag"))


def _derived(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", (F.col("n_chars") > 1000).cast("int").alias("flag")
    )


def dim_check(spark, sf):
    fits = has_dimension(F.col("embedding"), 64)
    return table(spark, sf, "embeddings").groupBy("label").agg(
        F.count_if(fits).alias("accepted"), F.count_if(~fits).alias("rejected")
    )


def _escaped(text: Column) -> Column:
    for raw, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]:
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def _element(name: str, *content: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), *content, F.lit(f"</{name.split(' ')[0]}>"))


def article_xml(spark, sf):
    """Documents written as citation records; language decides which date fields exist."""
    docs = table(spark, sf, "documents")
    text, lang, source = (_escaped(F.col(c)) for c in ["text", "lang", "source"])
    date = (
        F.when(F.col("lang") == "en", _element("Year", F.lit("2001")))
        .when(F.col("lang") == "de", _element("MedlineDate", F.lit("1999 Jan-Feb")))
        .otherwise("")
    )
    abstract = _element(
        "Abstract",
        _element("AbstractText Label='A'", text),
        _element("AbstractText Label='B'", lang),
    )
    authors = _element(
        "AuthorList",
        _element("Author", _element("LastName", lang), _element("ForeName", source)),
        _element("Author", _element("CollectiveName", source)),
        _element("Author", _element("LastName", source)),
    )
    article = _element(
        "Article",
        _element("Journal", _element("JournalIssue", _element("PubDate", date)),
                 _element("Title", source)),
        _element("ArticleTitle", source),
        _element("ELocationID EIdType='pii'", lang),
        _element("ELocationID EIdType='doi'", F.lit("10.1/"), F.col("doc_id").cast("string")),
        abstract,
        authors,
    )
    headings = _element(
        "MeshHeadingList",
        *[_element("MeshHeading", _element("DescriptorName UI='D0'", c)) for c in [lang, source]],
    )
    citation = _element(
        "MedlineCitation",
        _element("PMID Version='1'", F.col("doc_id").cast("string")), article, headings,
    )
    return docs.select(_element("PubmedArticle", citation).alias("xml"))


def article_parse(spark, sf):
    return parse_articles(article_xml(spark, sf), "xml")


def ingest_dedup(spark, sf):
    """Articles that are not registered, as they go into the abstract table; registered ones
    are left out before they are parsed."""
    registry = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("pmid"))
    records = new_records(article_xml(spark, sf), "xml", registry)
    fresh = new_articles(parse_articles(records, "xml"), registry)
    return fresh.select("pmid", "title", "abstract", "year", "doi")


QUERIES = {
    "anti_join_registry": anti_join_registry,
    "search_counts": search_counts,
    "merge_insert_only": merge_insert_only,
    "registry_union": registry_union,
    "seed_if_empty": seed_if_empty,
    "keyed_update": keyed_update,
    "snapshot_diff": snapshot_diff,
    "snapshot_apply": snapshot_apply,
    "dim_check": dim_check,
    "article_parse": article_parse,
    "ingest_dedup": ingest_dedup,
}

_ARTICLE_COLUMNS = """
    CAST(doc_id AS VARCHAR) AS pmid, source AS title, text || ' ' || lang AS abstract,
    CASE lang WHEN 'en' THEN '2001' WHEN 'de' THEN '1999 Jan-Feb' ELSE 'Unknown' END AS year,
    '10.1/' || doc_id AS doi"""

ORACLES = {
    "anti_join_registry": """
        SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "search_counts": """
        SELECT count(*) AS searched,
               count(*) FILTER (WHERE l_partkey NOT IN (
                 SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)) AS "new",
               false AS truncated
        FROM lineitem""",
    "merge_insert_only": """
        SELECT s_suppkey AS id, s_name AS payload FROM supplier
        UNION ALL
        SELECT user_id, event_type FROM (
          SELECT user_id, event_type,
                 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place
          FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)
        ) WHERE place = 1""",
    "registry_union": "SELECT doc_id FROM labels UNION SELECT doc_id FROM documents",
    "seed_if_empty": """
        SELECT c_name AS name, 'filled' AS target FROM customer
        UNION ALL
        SELECT n_name, 'empty' FROM nation
        WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0)""",
    "keyed_update": """
        SELECT c_custkey AS term, c_acctbal > 0 AS active, r.last_run_at,
               CAST(coalesce(r.runs, 0) AS INTEGER) AS run_count,
               CAST(r.last_run_at AS DATE) AS last_searched_through
        FROM customer LEFT JOIN (
          SELECT o_custkey, max(o_orderdate) AS last_run_at, count(*) AS runs
          FROM orders GROUP BY o_custkey
        ) r ON c_custkey = o_custkey""",
    "snapshot_diff": """
        SELECT doc_id, change FROM (
          SELECT coalesce(l.doc_id, d.doc_id) AS doc_id,
                 CASE WHEN l.doc_id IS NULL THEN 'insert' WHEN d.doc_id IS NULL THEN 'delete'
                      WHEN l.quality <> CAST(d.n_chars > 1000 AS INTEGER) THEN 'update' END
                   AS change
          FROM labels l FULL JOIN documents d ON l.doc_id = d.doc_id
        ) WHERE change IS NOT NULL""",
    "snapshot_apply": "SELECT doc_id, CAST(n_chars > 1000 AS INTEGER) AS flag FROM documents",
    "dim_check": """
        SELECT label, count(*) FILTER (WHERE len(embedding) = 64) AS accepted,
               count(*) FILTER (WHERE len(embedding) <> 64) AS rejected
        FROM embeddings GROUP BY label""",
    "article_parse": f"""
        SELECT {_ARTICLE_COLUMNS},
               lang || ' ' || source || ', , ' || source AS authors, source AS journal,
               lang || ', ' || source AS mesh_terms
        FROM documents""",
    "ingest_dedup": f"""
        SELECT {_ARTICLE_COLUMNS} FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
}

"""Article records in citation XML, flattened with built-in expressions."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import fixed_values as fixed
from gleanery.sources.tables import spread

# Element names of the public citation XML format.
ROW_TAG = "PubmedArticle"
RECORD_DDL = """
    MedlineCitation struct<
      PMID: struct<_VALUE: string, _Version: string>,
      Article: struct<
        Journal: struct<
          Title: string,
          JournalIssue: struct<PubDate: struct<Year: string, MedlineDate: string>>>,
        ArticleTitle: string,
        ELocationID: array<struct<_VALUE: string, _EIdType: string>>,
        Abstract: struct<AbstractText: array<string>>,
        AuthorList: struct<Author: array<struct<LastName: string, ForeName: string>>>>,
      MeshHeadingList: struct<
        MeshHeading: array<struct<DescriptorName: struct<_VALUE: string, _UI: string>>>>>
"""
# Padding inside an abstract is part of the text.
XML_OPTIONS = {"ignoreSurroundingSpaces": "false"}


def read_article_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of XML files; a file is split between tasks at the row tag."""
    return (
        spark.read.format("xml")
        .options(rowTag=ROW_TAG, **XML_OPTIONS)
        .schema(RECORD_DDL)
        .load(path)
    )


def parse_articles(df: DataFrame, xml: str, *keep: str) -> DataFrame:
    """One flat row per XML string; unreadable XML gives a row with a null ``pmid``."""
    # As a generated row the record is parsed once, whatever filters follow.
    record = F.inline(F.array(F.from_xml(xml, RECORD_DDL, XML_OPTIONS)))
    return flatten_articles(spread(df.select(*keep, xml)).select(*keep, record), *keep)


def article_key(xml: Column) -> Column:
    """The record's key alone; null where there is none or the XML cannot be read."""
    record = F.from_xml(xml, "MedlineCitation struct<PMID: struct<_VALUE: string>>", XML_OPTIONS)
    return F.trim(record["MedlineCitation"]["PMID"]["_VALUE"])


def flatten_articles(records: DataFrame, *keep: str) -> DataFrame:
    """Nested records to the columns of the article table plus ``abstract``."""
    article = F.col("MedlineCitation.Article")
    authors = F.col("MedlineCitation.Article.AuthorList.Author")
    headings = F.col("MedlineCitation.MeshHeadingList.MeshHeading")
    published = article["Journal"]["JournalIssue"]["PubDate"]
    return records.select(
        *keep,
        F.trim(F.col("MedlineCitation.PMID._VALUE")).alias("pmid"),
        _text(article["ArticleTitle"]).alias("title"),
        _joined(article["Abstract"]["AbstractText"], " ").alias("abstract"),
        _joined(F.transform(authors, _author_name), ", ").alias("authors"),
        _text(article["Journal"]["Title"]).alias("journal"),
        F.coalesce(
            published["Year"], published["MedlineDate"], F.lit(fixed.UNKNOWN_YEAR)
        ).alias("year"),
        _joined(
            F.transform(headings, lambda h: _text(h["DescriptorName"]["_VALUE"])), ", "
        ).alias("mesh_terms"),
        F.get(
            F.filter(article["ELocationID"], lambda e: e["_EIdType"] == "doi"), F.lit(0)
        )["_VALUE"].alias("doi"),
    )


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _joined(values: Column, separator: str) -> Column:
    return F.array_join(F.coalesce(values, F.array().cast("array<string>")), separator)


def _author_name(author: Column) -> Column:
    return F.trim(F.concat(_text(author["LastName"]), F.lit(" "), _text(author["ForeName"])))

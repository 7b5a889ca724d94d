"""Small tables with all that can be odd about them."""

from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"
SF_MORE = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, source string"


def docs(spark: SparkSession, rows, schema: str = SCHEMA):
    return spark.createDataFrame(rows, schema)


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def sample(spark: SparkSession, sf: str = SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts(spark: SparkSession, sf: str = SF):
    return {r.doc_id: r.text for r in sample(spark, sf).select("doc_id", "text").collect()}

"""Queries over web pages: links, and table rows of generated pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources import html_tables as H


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets of every page, in order."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    return found.select("page_id", F.col("pos").cast("bigint").alias("pos"), "href")


def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a constituents table made from each part brand, read back from its HTML."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    row = F.concat(F.lit("<tr><td>"), "p_name", F.lit("</td><td>T"), F.col("p_partkey").cast("string"), F.lit("</td><td>"), "p_type", F.lit("<br>x</td></tr>"))
    body = part.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("body"))
    page = F.concat(F.lit('<table id="constituents"><tbody><tr><th>Company</th><th>Ticker</th><th>FTSE Industry Classification Benchmark sector[11]</th></tr>'), "body", F.lit("</tbody></table>"))
    return H.index_rows(body.select(page.alias("html")), "ftse250").drop("row_no")

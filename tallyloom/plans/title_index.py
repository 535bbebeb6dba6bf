"""Search in titles by an index of three-letter pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.columns import url_decoded
from tallyloom.operators.rows import replace_by_key
from tallyloom.plans.catalogue import title_contains

GRAM = 3
# The rarest pieces of a pattern that are looked up; more of them drop hardly any product.
LOOKED_UP = 3

POSTINGS_SCHEMA = "gram string, id bigint"
COUNTS_SCHEMA = "gram string, n bigint"


def _grams(text):
    last = F.greatest(F.length(text) - (GRAM - 1), F.lit(0))
    places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(GRAM))))


def postings(products: DataFrame) -> DataFrame:
    """``gram`` and ``id``: every product once for each three letters in a row of its title, in
    lower case. Titles that are NULL or shorter have none."""
    return products.select(F.explode(_grams(F.lower("title"))).alias("gram"), "id")


def updated(index: DataFrame, changed: DataFrame) -> DataFrame:
    """The postings after the titles of some products (id, title) changed; a product that is gone has
    a NULL title."""
    return replace_by_key(index, changed.select("id").distinct(), postings(changed).select(index.columns), "id")


def write_index(index: DataFrame, folder: str) -> None:
    """Postings in the order of their pieces, so that a look-up reads a few row groups, and how many
    postings each piece has. A piece that many products share is spread over files by id."""
    in_order = index.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id")
    in_order.write.mode("errorifexists").parquet(f"{folder}/postings")
    counts = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("errorifexists").parquet(f"{folder}/counts")


def read_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return (
        spark.read.schema(POSTINGS_SCHEMA).parquet(f"{folder}/postings"),
        spark.read.schema(COUNTS_SCHEMA).parquet(f"{folder}/counts"),
    )


def search_titles(products: DataFrame, index: DataFrame, counts: DataFrame, q: str) -> DataFrame:
    """As ``title_contains(q)`` on the products: literal, without regard to case, URL-decoded.

    The pieces of the pattern are looked up, rarest first, and only products that have all of them
    are joined by id and compared. A pattern of one or two letters has no piece and reads all
    titles; one with a piece that no title has finds nothing without reading any.
    """
    spark = products.sparkSession
    wanted = spark.range(1).select(_grams(F.lower(url_decoded(q)))).first()[0]
    if not wanted:
        return products.filter(title_contains(q))
    known = {row.gram: row.n for row in counts.filter(F.col("gram").isin(wanted)).collect()}
    if len(known) < len(wanted):
        return products.filter(F.lit(False))
    rarest = sorted(known, key=lambda gram: (known[gram], gram))[:LOOKED_UP]
    having_all = (
        index.filter(F.col("gram").isin(rarest))
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") == len(rarest))
    )
    return products.join(having_all.select("id"), "id", "left_semi").filter(title_contains(q))

"""Product catalogue reads: search, lists, related and recommended products, nested loads."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import day_of, url_decoded
from tallyloom.functions.fixed_values import LIVE
from tallyloom.operators.rows import id_order, page_with_total, require_one
from tallyloom.sources.layout import days_within

Tables = Mapping[str, DataFrame]

# Columns whose ranges a search of products asks for, together or alone.
LAYOUT = ("price", "created_at")

# Children of a product that a product listing carries along.
CHILD_KINDS = ("images", "documents", "metadata", "options", "variants")


def search(tables: Tables, products: DataFrame, params: Mapping[str, object]) -> DataFrame:
    """Keep products that meet every predicate whose parameter is given and not empty; zero is
    empty, as a number and as the text "0" that a request carries.

    Parameters: ``q``, ``min_price``, ``max_price``, ``start``, ``end``, ``is_published``,
    ``category`` (ids separated by commas).
    """
    given = {name: value for name, value in params.items() if not _empty(value)}
    if "q" in given:
        products = products.filter(title_contains(str(given["q"])))
    products = products.filter(price_between(given.get("min_price"), given.get("max_price")))
    products = products.filter(created_between(products, given.get("start"), given.get("end")))
    if "is_published" in given:
        products = products.filter(F.col("published_scope") == 1)
    if "category" in given:
        products = in_categories(tables, products, str(given["category"]))
    return products


def _empty(value: object) -> bool:
    return not value or value == "0"


def title_contains(q: str) -> Column:
    """Literal, case-insensitive containment of the URL-decoded text."""
    return F.contains(F.lower("title"), F.lower(url_decoded(q)))


def price_between(low, high) -> Column:
    """An empty lower bound is 0 once an upper one is given; an empty upper bound is open."""
    low, high = (None if _empty(bound) else bound for bound in (low, high))
    if not low and not high:
        return F.lit(True)
    at_least = F.col("price") >= F.lit(str(low or 0)).cast("decimal(18,2)")
    if not high:
        return at_least
    return at_least & (F.col("price") <= F.lit(str(high)).cast("decimal(18,2)"))


def created_between(products: DataFrame, start: str | None, end: str | None) -> Column:
    """Created on a day from ``start`` to ``end``, each optional and included.

    Written as bounds on the plain column, not on its day, so that they reach the file scan.
    """
    return days_within(
        products, "created_at", day_of(start) if start else None, day_of(end) if end else None
    )


def in_categories(tables: Tables, products: DataFrame, ids: str) -> DataFrame:
    wanted = [int(part) for part in ids.split(",") if part.strip()]
    links = tables["collections"].filter(F.col("category_id").isin(wanted))
    return products.join(links.select(F.col("product_id").alias("id")), "id", "left_semi")


def live(products: DataFrame) -> DataFrame:
    return products.filter(F.col("action_type") == LIVE)


def of_account(products: DataFrame, account_id: int) -> DataFrame:
    return products.filter(F.col("account_id") == account_id)


def by_business(tables: Tables, products: DataFrame, business_uid: str) -> DataFrame:
    """Products of the business with this uid. The id comes from a one-value subquery, so the
    product scan is filtered in place instead of joined."""
    business = _first(tables["businesses"].filter(F.col("uid") == business_uid))
    return products.filter(F.col("vendor_id") == business.select("id").scalar())


def _first(df: DataFrame) -> DataFrame:
    return df.orderBy("id").limit(1)


def list_products(
    tables: Tables, params: Mapping[str, object] | None = None, live_only: bool = False
) -> DataFrame:
    """All matching products in id order; descending unless ``order_by`` says otherwise.

    Besides the parameters of :func:`search`: ``account_id``, ``business_uid``, ``order_by``. Cut a
    page with :func:`tallyloom.operators.rows.page`.
    """
    params = params or {}
    products = tables["products"]
    if params.get("account_id") is not None:
        products = of_account(products, int(params["account_id"]))
    if params.get("business_uid") is not None:
        products = by_business(tables, products, str(params["business_uid"]))
    if live_only:
        products = live(products)
    found = search(tables, products, params)
    return found.orderBy(id_order(str(params.get("order_by") or "desc")))


def by_id(tables: Tables, product_id: int) -> DataFrame:
    return tables["products"].filter(F.col("id") == product_id)


def by_id_or_fail(tables: Tables, product_id: int) -> DataFrame:
    return require_one(by_id(tables, product_id), f"product: {product_id}")


def by_uid(tables: Tables, uid: str) -> DataFrame:
    return _first(tables["products"].filter(F.col("uid") == uid))


def find_or_fail(tables: Tables, uid: str) -> DataFrame:
    return require_one(by_uid(tables, uid), f"product: {uid}")


def related(tables: Tables, uid: str, live_only: bool = False) -> DataFrame:
    """Other products of the same vendor."""
    anchor = by_uid(tables, uid)
    found = tables["products"].filter(
        (F.col("vendor_id") == anchor.select("vendor_id").scalar())
        & (F.col("id") != anchor.select("id").scalar())
    )
    return (live(found) if live_only else found).orderBy("id")


def recommended(tables: Tables, uid: str, live_only: bool = False) -> DataFrame:
    """Other products linked to any category of the product's account."""
    anchor = by_uid(tables, uid)
    categories = tables["categories"].filter(
        F.col("account_id") == anchor.select("account_id").scalar()
    )
    linked = (
        tables["collections"]
        .join(categories.select(F.col("id").alias("category_id")), "category_id", "left_semi")
        .filter(F.col("product_id") != anchor.select("id").scalar())
        .select(F.col("product_id").alias("id"))
        .distinct()
    )
    found = tables["products"].join(linked, "id", "left_semi")
    return (live(found) if live_only else found).orderBy("id")


def get_all(
    tables: Tables,
    params: Mapping[str, object] | None = None,
    live_only: bool = False,
    number: int = 1,
    children_per_row: int | None = None,
) -> DataFrame:
    """The product listing: the matching page with its total and the children of its products."""
    direction = str((params or {}).get("order_by") or "desc")
    found = page_with_total(list_products(tables, params, live_only), number, direction=direction)
    return with_children(tables, found, children_per_row)


def children_of(tables: Tables, products: DataFrame) -> DataFrame:
    """The long form of a nested load, one row per child: product_id, kind, place and the child's
    columns, with its id, as JSON text. Only children of the given products are read on; nothing
    grows with the number of children of a product."""
    ids = products.select(F.col("id").alias("product_id")).filter("product_id IS NOT NULL")
    return reduce(
        DataFrame.unionByName,
        [
            _child_rows(tables[kind].join(ids, "product_id", "left_semi"), kind)
            for kind in CHILD_KINDS
        ],
    )


def with_children(
    tables: Tables, products: DataFrame, children_per_row: int | None = None
) -> DataFrame:
    """Products with one list per kind of child, each list as JSON text in the order of the
    children's places.

    All children of a product are in one row, as in the nested load that this stands for. Give
    ``children_per_row`` to cut the lists: ``part`` 0 is then on every product, and places from
    ``children_per_row`` on go to further rows. :func:`children_of` has no lists at all.
    """
    part = F.lit(0)
    if children_per_row:
        part = F.floor(F.col("place") / children_per_row).cast("int")
    children = children_of(tables, products).withColumn("part", part)
    lists = []
    for kind in CHILD_KINDS:
        mine = F.when(F.col("kind") == kind, F.struct("place", "id", "child"))
        ordered = F.transform(F.array_sort(F.collect_list(mine)), lambda c: c["child"])
        text = F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]"))
        lists.append(text.alias(kind))
    every_product = products.select(
        F.col("id").alias("product_id"),
        F.lit(None).cast("string").alias("kind"),
        F.lit(None).cast("bigint").alias("place"),
        F.lit(None).cast("bigint").alias("id"),
        F.lit(None).cast("string").alias("child"),
        F.lit(0).alias("part"),
    )
    parts = children.unionByName(every_product).groupBy("product_id", "part").agg(*lists)
    parts = parts.withColumnRenamed("product_id", "id")
    return products.join(parts, products["id"].eqNullSafe(parts["id"])).drop(parts["id"])


def _child_rows(children: DataFrame, kind: str) -> DataFrame:
    """One row per child: its place in the product's list and its columns as JSON text."""
    fields = [c for c in children.columns if c not in ("product_id", "place")]
    return children.select(
        "product_id",
        F.lit(kind).alias("kind"),
        F.col("place").cast("bigint").alias("place"),
        "id",
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("child"),
    )


def child_id(product_id: Column, place: Column) -> Column:
    """A repeatable id for a child that a payload delivers: 60 bits of a digest of both values.

    Nothing is read back from it; order and part come from the column ``place``. Children are
    always looked up together with their product, so equal ids of two products do no harm.
    """
    digest = F.md5(F.concat_ws("/", product_id.cast("string"), place.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")

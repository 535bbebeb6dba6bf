"""Product feed: load, full replace and delete of products with all their child rows.

A feed has one row per product: ``product_id`` and ``payload``, a JSON text. All child tables come
from narrow passes over the parsed feed; nothing is shuffled to flatten a payload.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tallyloom.functions.columns import or_blank
from tallyloom.functions.fixed_values import (
    DEFAULT_SCOPE,
    DRAFT,
    LIST_KIND,
    LIVE,
    PUBLISHED_SCOPES,
)
from tallyloom.operators.rows import first_per, replace_by_key
from tallyloom.plans.catalogue import child_id
from tallyloom.sources.buckets import BucketedTables
from tallyloom.sources.lazy import LazyTables
from tallyloom.sources.schemas import FEED_NUMBERS, FEED_PAYLOAD

Tables = Mapping[str, DataFrame]

CHILD_TABLES = (
    "images",
    "videos",
    "documents",
    "metadata",
    "options",
    "variants",
    "option_variants",
    "collections",
)

HEADER = [
    "title",
    "description",
    "except",
    "published_scope",
    "currency",
    "price",
    "compare_at_price",
    "inventory_quantity",
    "min_purchase_quantity",
    "metric",
]

# Partitions that payloads are dealt to first, whatever ``spark.sql.shuffle.partitions`` says. Up to
# ``spark.shuffle.sort.bypassMergeThreshold`` a scan task writes its rows as they come; for more
# partitions it would hold them all to sort them. Larger partitions are split when they are read.
DEALT_TO = 200


def parse_feed(feed: DataFrame) -> DataFrame:
    """``product_id`` and one column per payload field. Text that is no JSON object gives NULLs.

    Numbers that cannot be read are NULL; :func:`field_rejects` lists them. If the feed has a column
    ``sequence``, the last delivery of a product counts; otherwise a product delivered twice is
    refused by the jobs and listed by :func:`repeated_deliveries`. To load all tables from one
    delivery, write this frame once and pass what is read back: each child table then reads its own
    column only.
    """
    parsed = _as_text(feed)
    names = [name for name in parsed.columns if name != "product_id"]
    return parsed.select("product_id", *[_typed(parsed, name) for name in names])


def _as_text(feed: DataFrame) -> DataFrame:
    if "sequence" in feed.columns:
        # A maximum over texts is taken in sorted rows, and a scan task may hold any number of payloads:
        # so rows are dealt to partitions of bounded size first. Dealt by the sequence too, they combine
        # there before the shuffle to their product, however often it is delivered.
        feed = feed.hint("rebalance", DEALT_TO, "product_id", "sequence")
        last = F.max(F.struct("sequence", "payload")).alias("last")
        feed = feed.groupBy("product_id").agg(last).select("product_id", "last.payload")
    parsed = feed.select("product_id", F.from_json("payload", FEED_PAYLOAD).alias("p"))
    return parsed.select("product_id", "p.*")


def _number(text: Column, kind: str) -> Column:
    """Whole numbers may be written with decimals that are zero."""
    if kind in ("int", "bigint"):
        exact = text.try_cast("decimal(38,6)")
        return F.when(exact == F.floor(exact), F.floor(exact)).try_cast(kind)
    return text.try_cast(kind)


def _typed(parsed: DataFrame, name: str) -> Column:
    if name in FEED_NUMBERS[""]:
        return _number(F.col(name), FEED_NUMBERS[""][name]).alias(name)
    numbers = FEED_NUMBERS.get(name)
    if not numbers:
        return F.col(f"`{name}`")
    fields = parsed.schema[name].dataType.elementType.names

    def item(given: Column) -> Column:
        return F.struct(
            *[
                (_number(given[f], numbers[f]) if f in numbers else given[f]).alias(f)
                for f in fields
            ]
        )

    return F.transform(name, item).alias(name)


def field_rejects(feed: DataFrame) -> DataFrame:
    """Given numbers that cannot be read: product_id, field (with its list), place and text."""

    def unread(listed: str, item: Column | None, place: Column) -> list[Column]:
        found = []
        for name, kind in FEED_NUMBERS[listed].items():
            text = F.col(f"`{name}`") if item is None else item[name]
            field = F.lit(f"{listed}.{name}" if listed else name)
            given = F.when((text != "") & _number(text, kind).isNull(), text)
            found.append(F.struct(field.alias("field"), place.cast("bigint").alias("place"), given.alias("text")))
        return found

    def of_list(listed: str) -> Column:
        if not listed:
            return F.array(*unread("", None, F.lit(0)))
        items = F.transform(listed, lambda item, place: F.array(*unread(listed, item, place)))
        return F.coalesce(F.flatten(items), F.array())

    # all lists in one pass, so that a task holds a payload once
    checks = F.filter(F.concat(*[of_list(listed) for listed in FEED_NUMBERS]), lambda c: c["text"].isNotNull())
    rows = _as_text(feed).select("product_id", F.explode_outer(checks).alias("reject"))
    return rows.filter("reject IS NOT NULL").select("product_id", "reject.field", "reject.place", "reject.text")


# Fields that may be of any kind, beside the lists and plain values of the schema.
_ANY_KIND = {"metadata[].name", "options[].value"}


def _declared_kinds(spark: SparkSession) -> dict[str, str]:
    """Path of every field of the payload schema with its kind: list, object (an item), value, any."""
    found: dict[str, str] = {}

    def walk(prefix: str, fields: StructType) -> None:
        for field in fields:
            path = f"{prefix}{field.name}"
            kind = field.dataType
            if isinstance(kind, ArrayType):
                found[path], path, kind = "list", f"{path}[]", kind.elementType
            if isinstance(kind, StructType):
                found[path] = "object"
                walk(f"{path}.", kind)
            else:
                found[path] = "any" if path in _ANY_KIND else "value"

    walk("", spark.createDataFrame([], FEED_PAYLOAD).schema)
    return found


_DEPTH = 5  # steps from a payload to the fields of a variant's options: variants, item, options, item, field


def unknown_fields(feed: DataFrame) -> DataFrame:
    """What deliveries hold outside of the payload schema, so that nothing is lost in silence.

    One row per path, ``problem`` and kind ``found``: how often (``n_found``), and the lowest product
    with it (``product_id``) and its value as JSON (``example``). Problems: ``unknown`` (no such
    field; what is below it is not listed), ``kind`` (a list, object or value where another is
    declared; null is of every kind), ``no object`` (a payload that is no JSON object; path is blank).
    Payloads are walked one level at a time, next to where they lie; only counts are shuffled.
    """
    spark = feed.sparkSession
    declared = F.create_map(*[F.lit(part) for pair in _declared_kinds(spark).items() for part in pair])
    level = feed.select("product_id", F.lit("").alias("path"), F.try_parse_json("payload").alias("value"), "payload")
    level = level.withColumn("found", _kind(F.col("value")))
    broken = (F.col("found") != "object") | F.col("value").isNull()
    found = [
        level.filter(broken).select(
            "product_id", "path", F.lit("no object").alias("problem"), F.coalesce("found", F.lit("text")).alias("found"),
            F.col("payload").alias("example"),
        )
    ]
    level = level.filter(~broken).select("product_id", "path", "value")
    for _ in range(_DEPTH):
        parts = spark.sql(
            """SELECT product_id, path, e.key, e.value FROM {level}, LATERAL variant_explode(value) e""", level=level
        )
        step = F.when(F.col("key").isNull(), "[]").when(F.col("path") == "", F.col("key")).otherwise(
            F.concat(F.lit("."), "key")
        )
        parts = parts.select("product_id", F.concat("path", step).alias("path"), "value").withColumns(
            {"found": _kind(F.col("value")), "declared": F.element_at(declared, F.col("path"))}
        )
        fits = F.col("found").isin("null") | (F.col("declared") == "any") | (F.col("declared") == F.col("found"))
        problem = F.when(F.col("declared").isNull(), "unknown").when(~fits, "kind")
        parts = parts.withColumn("problem", problem)
        found.append(
            parts.filter("problem IS NOT NULL").select(
                "product_id", "path", "problem", "found", F.to_json("value").alias("example")
            )
        )
        level = parts.filter("problem IS NULL AND found IN ('list', 'object') AND declared <> 'any'").select(
            "product_id", "path", "value"
        )
    lowest = F.min(F.struct("product_id", "example")).alias("lowest")
    counted = reduce(DataFrame.unionByName, found).groupBy("path", "problem", "found").agg(
        F.count(F.lit(1)).alias("n_found"), lowest
    )
    return counted.select("path", "problem", "found", "n_found", "lowest.product_id", "lowest.example")


def _kind(value: Column) -> Column:
    schema = F.schema_of_variant(value)
    return (
        F.when(schema.startswith("ARRAY"), "list")
        .when(schema.startswith("OBJECT"), "object")
        .when(schema == "VOID", "null")
        .when(schema.isNotNull(), "value")
    )


def repeated_deliveries(parsed: DataFrame) -> DataFrame:
    """Products that a feed without a sequence delivers more than once, with how often."""
    return (
        parsed.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")
    )


def _single(parsed: DataFrame, once: bool) -> DataFrame:
    """Products delivered once. ``once`` says that all are: :func:`parse_feed` has taken the last
    deliveries of a feed with a sequence, and counting them again would hold them beside the counts."""
    return parsed if once else parsed.join(repeated_deliveries(parsed), "product_id", "left_anti")


# --- headers ----------------------------------------------------------------------------------


def scope_code(name: Column) -> Column:
    codes = F.lit(None).cast("int")
    given = F.coalesce(name, F.lit(DEFAULT_SCOPE))
    for scope, code in PUBLISHED_SCOPES.items():
        codes = F.when(given == scope, F.lit(code)).otherwise(codes)
    return codes


def has_images(images: Column) -> Column:
    return F.coalesce(F.size(images), F.lit(0)) > 0


def initial_status(images: Column) -> Column:
    return F.when(has_images(images), LIVE).otherwise(DRAFT)


def next_status(old_code: Column, images: Column) -> Column:
    """A live product without images becomes a draft, a draft with images becomes live."""
    return (
        F.when((old_code == LIVE) & ~has_images(images), DRAFT)
        .when((old_code == DRAFT) & has_images(images), LIVE)
        .otherwise(old_code)
    )


def next_slug(old_title: Column, new_title: Column, old_slug: Column) -> Column:
    """The new title when the title changed, otherwise the slug as it was."""
    return F.when(old_title.eqNullSafe(new_title), old_slug).otherwise(new_title)


def _header_fields(prefix: str = "") -> list[Column]:
    def field(name: str) -> Column:
        return F.col(f"{prefix}`{name}`")

    defaults = {
        "description": or_blank(field("description")),
        "except": or_blank(field("except")),
        "currency": or_blank(field("currency")),
        "metric": or_blank(field("metric")),
        "published_scope": scope_code(field("published_scope")),
    }
    return [defaults.get(name, field(name)).alias(name) for name in HEADER]


def new_products(tables: Tables, parsed: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Product rows of a feed; the vendor is the business with the payload's uid."""
    businesses = first_per(tables["businesses"], ["uid"], ["id"]).select(
        F.col("uid").alias("business_uid"), F.col("id").alias("vendor_id")
    )
    now = F.lit(as_of.isoformat()).cast("timestamp_ntz")
    return parsed.join(businesses, "business_uid").select(
        F.col("product_id").alias("id"),
        F.concat(F.lit("prd-"), F.col("product_id").cast("string")).alias("uid"),
        "account_id",
        "vendor_id",
        F.col("title").alias("slug"),
        *_header_fields(),
        initial_status(F.col("images")).alias("action_type"),
        now.alias("action_date"),
        now.alias("created_at"),
    )


# --- children ---------------------------------------------------------------------------------


def _items(parsed: DataFrame, field: str) -> DataFrame:
    """``product_id``, ``place`` in the payload list, and ``item``.

    The outer form with a filter behind it parses a payload once; the inner form makes the
    optimizer test the list before exploding it, which parses the text again for each test.
    """
    items = parsed.select("product_id", F.posexplode_outer(field).alias("place", "item"))
    return items.filter(F.col("place").isNotNull())


def _own_id() -> Column:
    return child_id(F.col("product_id"), F.col("place")).alias("id")


def _own_place() -> Column:
    return F.col("place").cast("bigint").alias("place")


def images_of(parsed: DataFrame) -> DataFrame:
    return _items(parsed, "images").select(
        _own_id(),
        "product_id",
        _own_place(),
        "item.position",
        "item.alt",
        "item.src",
        F.coalesce("item.width", F.lit(0)).alias("width"),
        F.coalesce("item.height", F.lit(0)).alias("height"),
    )


def videos_of(parsed: DataFrame) -> DataFrame:
    return _items(parsed, "videos").select(
        _own_id(),
        "product_id",
        _own_place(),
        *[or_blank(f"item.{f}").alias(f) for f in ("title", "url", "description")],
    )


def documents_of(parsed: DataFrame) -> DataFrame:
    return _items(parsed, "documents").select(
        _own_id(),
        "product_id",
        _own_place(),
        "item.title",
        or_blank("item.description").alias("description"),
        "item.src",
        "item.kind",
        "item.position",
    )


def metadata_of(parsed: DataFrame) -> DataFrame:
    """A list attribute keeps its name as JSON text, any other its single name as plain text; a
    list given for such a one counts by its first name."""
    single = F.coalesce(
        F.try_variant_get("item.name", "$[0]", "string"), F.try_variant_get("item.name", "$", "string")
    )
    name = F.when(F.col("item.kind") == LIST_KIND, F.to_json("item.name")).otherwise(single)
    return _items(parsed, "metadata").select(
        _own_id(),
        "product_id",
        _own_place(),
        "item.metafield_id",
        or_blank(name).alias("name"),
        or_blank("item.label").alias("label"),
        "item.kind",
    )


def options_of(parsed: DataFrame) -> DataFrame:
    return _items(parsed, "options").select(
        _own_id(),
        "product_id",
        _own_place(),
        "item.name",
        F.to_json("item.value").alias("value"),
        "item.position",
    )


VARIANT_TEXT = (
    "sku",
    "inventory_policy",
    "fulfillment_service",
    "inventory_management",
    "taxable",
    "barcode",
    "weight_unit",
    "requires_shipping",
)
VARIANT_NUMBERS = (
    "price",
    "position",
    "compare_at_price",
    "grams",
    "weight",
    "inventory_quantity",
)


def variants_of(parsed: DataFrame) -> DataFrame:
    return _items(parsed, "variants").select(
        _own_id(),
        "product_id",
        _own_place(),
        "item.title",
        *[or_blank(f"item.{f}").alias(f) for f in VARIANT_TEXT],
        *[F.col(f"item.{f}") for f in VARIANT_NUMBERS],
    )


def _variant_options(parsed: DataFrame) -> DataFrame:
    """Options named by variants, each with the place of the product's option of that name.

    Both lists are in the same payload, so the name is looked up inside the row; the first option
    of a name counts, place -1 means there is none.
    """
    names = F.transform("options", lambda o: o["name"]).alias("names")
    variants = parsed.select(
        "product_id", names, F.posexplode_outer("variants").alias("place", "variant")
    )
    named = variants.filter(F.col("place").isNotNull()).select(
        "product_id",
        "names",
        child_id(F.col("product_id"), F.col("place")).alias("variant_id"),
        F.explode("variant.options").alias("link"),
    )
    place = F.coalesce(F.array_position("names", F.col("link.option")), F.lit(0)) - 1
    return named.select(
        "product_id", "variant_id", "link.option", "link.value", place.alias("option_place")
    )


def option_variants_of(parsed: DataFrame) -> DataFrame:
    """Links of variants to the options of their product."""
    found = _variant_options(parsed).filter(F.col("option_place") >= 0)
    return found.select(
        "product_id",
        child_id(F.col("product_id"), F.col("option_place")).alias("option_id"),
        "variant_id",
        "value",
    )


def option_rejects(parsed: DataFrame) -> DataFrame:
    """Variant options whose name the product does not offer."""
    return (
        _variant_options(parsed)
        .filter(F.col("option_place") < 0)
        .select("product_id", "variant_id", "option", "value")
    )


def collections_of(tables: Tables, parsed: DataFrame) -> DataFrame:
    """Category links of a feed; unknown slugs drop out, a slug used twice means its lowest id."""
    by_slug = first_per(tables["categories"].select("slug", "id"), ["slug"], ["id"])
    slugs = parsed.select("product_id", F.explode_outer("categories").alias("slug"))
    return slugs.join(by_slug, "slug").select("product_id", F.col("id").alias("category_id"))


def feed_children(tables: Tables, parsed: DataFrame) -> LazyTables:
    return LazyTables(
        {
            "images": lambda: images_of(parsed),
            "videos": lambda: videos_of(parsed),
            "documents": lambda: documents_of(parsed),
            "metadata": lambda: metadata_of(parsed),
            "options": lambda: options_of(parsed),
            "variants": lambda: variants_of(parsed),
            "option_variants": lambda: option_variants_of(parsed),
            "collections": lambda: collections_of(tables, parsed),
        }
    )


# --- jobs -------------------------------------------------------------------------------------


def feed_rejects(tables: Tables, parsed: DataFrame) -> DataFrame:
    """Feed rows that cannot be loaded because their business is unknown."""
    known = tables["businesses"].select(F.col("uid").alias("business_uid"))
    return parsed.join(known, "business_uid", "left_anti").select("product_id", "business_uid")


def load_feed(tables: Tables, parsed: DataFrame, as_of: dt.datetime, once: bool = False) -> LazyTables:
    """Products and all child tables of a feed of new products, each delivered once. Give ``once`` if
    the feed had a sequence: repeated deliveries are then settled, and are not looked for again."""
    known = tables["businesses"].select(F.col("uid").alias("business_uid"))
    loadable = _single(parsed, once).join(known, "business_uid", "left_semi")
    return _with_products(
        lambda: new_products(tables, loadable, as_of),
        feed_children(tables, loadable).__getitem__,
    )


def _with_products(
    products: Callable[[], DataFrame], child: Callable[[str], DataFrame]
) -> LazyTables:
    return LazyTables(
        {"products": products, **{name: partial(child, name) for name in CHILD_TABLES}}
    )


def replaced_products(products: DataFrame, parsed: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Header fields of the products in the feed overwritten, all other products as they were."""
    new = parsed.select(
        F.col("product_id").alias("id"),
        F.lit(True).alias("delivered"),
        F.struct(*_header_fields()).alias("new"),
        has_images(F.col("images")).alias("with_images"),
    )
    joined = products.join(new, "id", "left")
    delivered = F.col("delivered").isNotNull()
    images = F.when(F.col("with_images"), F.array(F.lit(1)))
    same_status = F.col("action_type").eqNullSafe(
        next_status(F.col("action_type"), images)
    )
    status = F.when(delivered, next_status(F.col("action_type"), images)).otherwise(
        F.col("action_type")
    )
    changed = {
        "slug": F.when(
            delivered, next_slug(F.col("title"), F.col("new.title"), F.col("slug"))
        ).otherwise(F.col("slug")),
        "action_type": status,
        "action_date": F.when(
            ~delivered | same_status, F.col("action_date")
        ).otherwise(F.lit(as_of.isoformat()).cast("timestamp_ntz")),
    }
    for name in HEADER:
        changed[name] = F.when(delivered, F.col(f"new.`{name}`")).otherwise(F.col(f"`{name}`"))
    return joined.select(
        *[changed.get(c, F.col(f"`{c}`")).alias(c) for c in products.columns]
    )


def replace(
    tables: Tables, children: Tables, parsed: DataFrame, as_of: dt.datetime, once: bool = False
) -> LazyTables:
    """All tables after a full replace: ``tables`` holds products, businesses and categories,
    ``children`` the child tables. Children of delivered products are replaced as a whole; feed
    rows of unknown products change nothing. ``once`` as in :func:`load_feed`. Write the result to a
    new snapshot folder."""
    ids = tables["products"].select(F.col("id").alias("product_id"))
    known = _single(parsed, once).join(ids, "product_id", "left_semi")
    fresh = feed_children(tables, known)
    return _with_products(
        lambda: replaced_products(tables["products"], known, as_of),
        lambda name: replace_by_key(children[name], known, fresh[name], "product_id"),
    )


def delete(tables: Tables, children: Tables, product_ids: DataFrame) -> LazyTables:
    """All tables without the products of ``product_ids(id)`` and without their child rows."""
    gone = product_ids.select(F.col("id").alias("product_id"))
    return _with_products(
        lambda: tables["products"].join(product_ids.select("id"), "id", "left_anti"),
        lambda name: children[name].join(gone, "product_id", "left_anti"),
    )


# The column by which each table is kept in buckets: all rows of a product lie in the same ones.
BUCKET_KEYS = {"products": "id", **{name: "product_id" for name in CHILD_TABLES}}


def replace_in_buckets(
    snapshot: BucketedTables,
    tables: Tables,
    parsed: DataFrame,
    as_of: dt.datetime,
    name: str,
    once: bool = False,
) -> frozenset[int]:
    """:func:`replace` on a bucketed snapshot, into the new snapshot ``name``: reads and writes the
    buckets of the delivered products only, and gives their numbers. ``tables`` has the categories.
    Write ``parsed`` once before: it is read for every table."""
    numbers = snapshot.touched(parsed, "product_id")
    base = snapshot.only(numbers)
    after = replace({**tables, "products": base["products"]}, base, parsed, as_of, once)
    snapshot.write_changed(after, BUCKET_KEYS, numbers, name)
    return numbers


def delete_in_buckets(snapshot: BucketedTables, product_ids: DataFrame, name: str) -> frozenset[int]:
    """:func:`delete` on a bucketed snapshot, as :func:`replace_in_buckets` does."""
    numbers = snapshot.touched(product_ids, "id")
    base = snapshot.only(numbers)
    snapshot.write_changed(delete(base, base, product_ids), BUCKET_KEYS, numbers, name)
    return numbers


def product_changes(product_ids: DataFrame, action: str) -> DataFrame:
    """Change-log rows of products: ``create``, ``update`` or ``delete``."""
    if action not in ("create", "update", "delete"):
        raise ValueError(f"unknown action: {action!r}")
    return product_ids.select(
        F.col("id").alias("entity_id"),
        F.lit(action).alias("action"),
        F.lit(None).cast("date").alias("old_date"),
    )

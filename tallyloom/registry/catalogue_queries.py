"""Catalogue queries and the same questions in SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyloom.operators.rows import page_by_rank, page_with_total
from tallyloom.plans import catalogue, feed, title_index
from tallyloom.registry.ctes import sql_with
from tallyloom.registry.edge import at_edge
from tallyloom.session import shared_folder
from tallyloom.sources.buckets import BucketedTables, write_buckets
from tallyloom.sources.change_log import append_change_log, read_change_log
from tallyloom.sources.derived import DerivedTables
from tallyloom.sources.layout import read_interleaved, write_interleaved
from tallyloom.sources.schemas import TABLE_SCHEMAS

AS_OF = dt.datetime(2024, 1, 10, 8, 30)
ANCHOR = "prd-7"

COLUMNS = [
    "id", "uid", "account_id", "vendor_id", "title", "slug", "description", "published_scope",
    "price", "inventory_quantity", "action_type", "created_at",
]

PRODUCT_SQL = """p.id, p.uid, p.account_id, p.vendor_id, p.title, p.slug, p.description,
    p.published_scope, CAST(p.price AS DOUBLE) AS price, p.inventory_quantity, p.action_type,
    strftime(p.created_at, '%Y-%m-%d %H:%M:%S') AS created_at"""


def _products_sql(where: str, tail: str = "", extra_columns: str = "") -> str:
    return sql_with(f"SELECT {PRODUCT_SQL}{extra_columns} FROM products p WHERE {where} {tail}")


IN_CATEGORY = """EXISTS (SELECT 1 FROM collections c WHERE c.product_id = p.id
    AND c.category_id IN ({ids}))"""

# name -> (parameters, live only, the same condition in SQL)
SEARCHES = {
    "product_search_title": ({"q": "RED%20w"}, False, "lower(p.title) LIKE '%red w%'"),
    "product_search_price": (
        {"min_price": 950, "max_price": "1020.50"},
        False,
        "p.price >= 950 AND p.price <= 1020.50",
    ),
    "product_search_created": (
        {"start": "2020-03-01", "end": "2020-04-15"},
        False,
        "CAST(p.created_at AS DATE) BETWEEN DATE '2020-03-01' AND DATE '2020-04-15'",
    ),
    "product_search_created_from": (
        {"start": "2020-09-05", "end": ""},
        False,
        "CAST(p.created_at AS DATE) >= DATE '2020-09-05'",
    ),
    "product_search_created_until": (
        {"end": "2020-02-20"},
        False,
        "CAST(p.created_at AS DATE) <= DATE '2020-02-20'",
    ),
    "product_search_published": ({"is_published": True}, False, "p.published_scope = 1"),
    "product_search_category": ({"category": "3,17,21"}, False, IN_CATEGORY.format(ids="3, 17, 21")),
    "product_search_combined": (
        {
            "q": "bolt",
            "min_price": 910,
            "start": "2020-02-01",
            "is_published": True,
            "category": "2,3,5,8,13",
        },
        True,
        "p.title ILIKE '%bolt%' AND p.price >= 910 AND p.published_scope = 1 "
        "AND p.action_type = 9 AND CAST(p.created_at AS DATE) >= DATE '2020-02-01' AND "
        + IN_CATEGORY.format(ids="2, 3, 5, 8, 13"),
    ),
    "product_list": ({"account_id": 5}, True, "p.account_id = 5 AND p.action_type = 9"),
    "product_by_business": (
        {"business_uid": "biz-4", "order_by": "asc"},
        False,
        "p.vendor_id = (SELECT b.id FROM businesses b WHERE b.uid = 'biz-4')",
    ),
}

ANCHOR_SQL = "(SELECT a.{column} FROM products a WHERE a.uid = 'prd-7')"

RELATED_SQL = (
    f"p.vendor_id = {ANCHOR_SQL.format(column='vendor_id')} AND p.uid <> 'prd-7'"
)

RECOMMENDED_SQL = f"""p.uid <> 'prd-7' AND p.id IN (
    SELECT c.product_id FROM collections c JOIN categories g ON g.id = c.category_id
    WHERE g.account_id = {ANCHOR_SQL.format(column='account_id')})"""


# --- feed ---------------------------------------------------------------------------------------

def _child_id(place: str) -> str:
    """The id of a child: 60 bits of a digest of its product and place."""
    return f"CAST('0x' || substr(md5(product_id || '/' || {place}), 1, 15) AS BIGINT)"


OWN = f"{_child_id('i')} AS id, product_id, i AS place"
FIRST = f"{_child_id('0')} AS id, product_id, CAST(0 AS BIGINT) AS place"


def _child_sql(source: str) -> dict[str, str]:
    """Child rows of a feed table (``feed`` or ``revised``), written from its source columns."""
    return {
        "images": f"""
            SELECT {OWN}, CAST(i AS INTEGER) AS position,
                   'view ' || i AS alt, 'img/' || product_id || '/' || i AS src,
                   CAST(640 AS INTEGER) AS width, CAST(0 AS INTEGER) AS height
            FROM {source}, range(4) AS r(i) WHERE i < n_images""",
        "videos": f"""
            SELECT {FIRST}, p_name AS title,
                   'https://video.example.test/' || product_id AS url, '' AS description
            FROM {source} WHERE p_size % 2 = 1""",
        "documents": f"""
            SELECT {FIRST}, 'Sheet ' || product_id AS title,
                   '' AS description, 'doc/' || product_id AS src, 'pdf' AS kind,
                   CAST(0 AS INTEGER) AS position
            FROM {source}""",
        "metadata": f"""
            SELECT {OWN}, i + 1 AS metafield_id,
                   CASE i WHEN 0 THEN '["' || p_type || '","' || p_brand || '"]'
                          ELSE p_brand END AS name,
                   CASE i WHEN 0 THEN 'tags' ELSE '' END AS label,
                   CAST(CASE i WHEN 0 THEN 7 ELSE 1 END AS INTEGER) AS kind
            FROM {source}, range(2) AS r(i)""",
        "options": f"""
            SELECT {OWN},
                   CASE i WHEN 0 THEN 'size' ELSE 'type' END AS name,
                   CASE i WHEN 0 THEN '["S","M"]' ELSE '"' || p_type || '"' END AS value,
                   CAST(i AS INTEGER) AS position
            FROM {source}, range(2) AS r(i)""",
        "variants": f"""
            SELECT {OWN}, p_name || ' v' || i AS title,
                   price + i AS price, 'sku-' || product_id || '-' || i AS sku,
                   CAST(i AS INTEGER) AS position
            FROM {source}, range(3) AS r(i) WHERE i < product_id % 3 + 1""",
        "option_variants": f"""
            SELECT product_id, {_child_id('0')} AS option_id, {_child_id('i')} AS variant_id,
                   CASE WHEN i % 2 = 0 THEN 'S' ELSE 'M' END AS value
            FROM {source}, range(3) AS r(i) WHERE i < product_id % 3 + 1 AND product_id % 10 <> 0""",
        "collections": f"""
            SELECT f.product_id, g.id AS category_id
            FROM {source} f JOIN categories g ON g.slug = lower(f.p_brand)""",
    }


CHILD_COLUMNS = {"variants": ["id", "product_id", "place", "title", "price", "sku", "position"]}

ALL_COLUMNS = [
    *COLUMNS, "except", "currency", "compare_at_price", "min_purchase_quantity", "metric",
    "action_date",
]

# Texts and numbers that no payload carries.
UNSET_SQL = """'' AS "except", '' AS currency, CAST(NULL AS DOUBLE) AS compare_at_price,
    CAST(NULL AS INTEGER) AS min_purchase_quantity, '' AS metric"""

QUANTITY_SQL = "CASE WHEN product_id % 50 <> 0 THEN p_size END"

FEED_PRODUCTS_SQL = f"""
    SELECT product_id AS id, 'prd-' || product_id AS uid, account_id, vendor_id, title,
           title AS slug, p_type AS description, CAST(1 AS INTEGER) AS published_scope,
           CAST(price AS DOUBLE) AS price, {QUANTITY_SQL} AS inventory_quantity,
           CASE WHEN n_images > 0 THEN 9 ELSE 1 END AS action_type, {UNSET_SQL},
           '2024-01-10 08:30:00' AS action_date, '2024-01-10 08:30:00' AS created_at
    FROM feed"""


def _parsed(t, name: str = "product_feed"):
    """Both feeds have a sequence, so a product is in here once."""
    return feed.parse_feed(t[name])


def _loaded(t):
    return feed.load_feed(t, _parsed(t), AS_OF, once=True)


def _stored(t):
    """Child tables as they are before a replace or delete: those of the first delivery."""
    return feed.feed_children(t, _parsed(t))


def _loaded_child(name: str):
    def build(t):
        return _shown(name, _loaded(t)[name])

    return build


def _shown(name: str, child):
    return child.select(*CHILD_COLUMNS.get(name, child.columns))


def _replaced_child(name: str):
    return lambda t: _shown(name, _replaced(t)[name])


def _left_child(name: str):
    return lambda t: _shown(name, feed.delete(t, _stored(t), _withdrawn(t))[name])


def _replaced(t):
    return feed.replace(t, _stored(t), _parsed(t, "revised_feed"), AS_OF, once=True)


def _replaced_products(t):
    return _replaced(t)["products"].select(*[F.col(f"`{c}`") for c in ALL_COLUMNS])


def _child_counts(tables):
    """Rows per product and child table."""
    frames = [
        tables[name]
        .groupBy("product_id")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .select(F.lit(name).alias("child"), "product_id", "n_rows")
        for name in feed.CHILD_TABLES
    ]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def _replaced_children(t):
    return _child_counts(_replaced(t))


def _status_transition(t):
    old = t["products"].select("id", F.col("action_type").alias("old_code"))
    new = _parsed(t, "revised_feed").select(F.col("product_id").alias("id"), "images")
    return old.join(new, "id").select(
        "id",
        "old_code",
        feed.has_images(F.col("images")).alias("with_images"),
        feed.next_status(F.col("old_code"), F.col("images")).alias("new_code"),
    )


def _withdrawn(t):
    """Products out of stock of a size, the ones a delete job is asked to remove."""
    return t["products"].filter(F.col("inventory_quantity") <= 10).select("id")


def _deleted(t):
    left = feed.delete(t, _stored(t), _withdrawn(t))
    products = left["products"].select(
        F.lit("products").alias("child"),
        F.col("id").alias("product_id"),
        F.lit(1).cast("bigint").alias("n_rows"),
    )
    return products.unionByName(_child_counts(left))


def _product_log(t):
    created = _loaded(t)["products"]
    updated = _parsed(t, "revised_feed").select(F.col("product_id").alias("id"))
    log = feed.product_changes(created, "create")
    for ids, action in ((updated, "update"), (_withdrawn(t), "delete")):
        log = log.unionByName(feed.product_changes(ids, action))
    return log.select("entity_id", "action")


def _bucketed(t):
    """A snapshot in buckets, a delivery that replaces some products and a job that deletes others,
    each writing the buckets it touches; the last snapshot is read back."""
    spark = t["products"].sparkSession
    root = shared_folder(spark, "buckets")
    first = {"products": t["products"], **feed.feed_children(t, _parsed(t).checkpoint())}
    write_buckets(first, feed.BUCKET_KEYS, root, "1", buckets=16)
    parsed = _parsed(t, "revised_feed").checkpoint()
    feed.replace_in_buckets(BucketedTables(spark, root, "1"), t, parsed, AS_OF, "2", once=True)
    feed.delete_in_buckets(BucketedTables(spark, root, "2"), _withdrawn(t), "3")
    left = BucketedTables(spark, root, "3")
    products = left["products"].select(
        F.lit("products").alias("child"),
        F.col("id").alias("product_id"),
        F.lit(1).cast("bigint").alias("n_rows"),
    )
    return products.unionByName(_child_counts(left))


def _committed_log(t):
    """Every job runs twice, and one is stopped before its commit: each fact is there once."""
    spark = t["products"].sparkSession
    path = shared_folder(spark, "change-log")
    jobs = {
        "created": feed.product_changes(_loaded(t)["products"], "create"),
        "updated": feed.product_changes(
            _parsed(t, "revised_feed").select(F.col("product_id").alias("id")), "update"
        ),
        "deleted": feed.product_changes(_withdrawn(t), "delete"),
    }
    jobs["deleted"].write.parquet(f"{path}/deleted/stopped")
    for _ in range(2):
        for batch, facts in jobs.items():
            append_change_log(facts, path, batch)
    return read_change_log(spark, path, "entity_id bigint, action string, old_date date").select(
        "entity_id", "action"
    )


def _title_search(t):
    """Postings of all titles, written and looked up."""
    spark = t["products"].sparkSession
    folder = shared_folder(spark, "titles")
    title_index.write_index(title_index.postings(t["products"]), folder)
    found = title_index.search_titles(t["products"], *title_index.read_index(spark, folder), "RED%20w")
    return found.select(*COLUMNS)


# the same searches on the snapshot in the order of both columns
IN_LAYOUT = ("product_search_price", "product_search_created", "product_search_combined")


def _in_layout(name):
    params, live_only, _ = SEARCHES[name]

    def search(t):
        spark = t["products"].sparkSession
        folder = shared_folder(spark, "layout")
        write_interleaved(t["products"], catalogue.LAYOUT, folder)
        stored = read_interleaved(spark, folder, TABLE_SCHEMAS["products"], catalogue.LAYOUT)
        tables = {"products": stored, "collections": t["collections"], "businesses": t["businesses"]}
        return catalogue.list_products(tables, params, live_only).select(*COLUMNS)

    return search


def _children(t):
    nested = catalogue.with_children(_stored(t), t["products"])
    return nested.select("id", "title", "part", *catalogue.CHILD_KINDS)


def _listing(t):
    params = {"account_id": 5, "min_price": 905, "max_price": "0"}
    listed = catalogue.get_all({**_stored(t), **t}, params, number=2)
    return listed.select("id", "title", "total", "part", *catalogue.CHILD_KINDS)


def _past_the_end(t):
    found = catalogue.list_products(t, {"account_id": 5})
    return page_with_total(found, 1_000_000, direction="DESC").select(*COLUMNS, "total")


def _page(t):
    found = catalogue.list_products(t, {"account_id": 5})
    return page_with_total(found, 2, direction="desc").select(*COLUMNS, "total")


def _page_by_rank(t):
    found = catalogue.list_products(t, {"account_id": 5})
    return page_by_rank(found, 2, direction="desc", with_total=True).select(*COLUMNS, "total")


_QUERIES = {
    "product_page": _page,
    "product_page_by_rank": _page_by_rank,
    "product_page_past_the_end": _past_the_end,
    "product_listing": _listing,
    "product_by_id": lambda t: catalogue.by_id(t, 42).select(*COLUMNS),
    "product_by_uid": lambda t: catalogue.by_uid(t, ANCHOR).select(*COLUMNS),
    "product_related": lambda t: catalogue.related(t, ANCHOR, live_only=True).select(*COLUMNS),
    "product_recommended": lambda t: catalogue.recommended(t, ANCHOR).select(*COLUMNS),
    "product_with_children": _children,
    "feed_products": lambda t: _loaded(t)["products"].select(*[F.col(f"`{c}`") for c in ALL_COLUMNS]),
    **{f"feed_{name}": _loaded_child(name) for name in feed.CHILD_TABLES},
    "feed_field_rejects": lambda t: feed.field_rejects(t["product_feed"]),
    "feed_unknown_fields": lambda t: feed.unknown_fields(t["drifted_feed"]),
    "feed_option_rejects": lambda t: feed.option_rejects(_parsed(t)),
    "product_replace": _replaced_products,
    "product_replace_children": _replaced_children,
    **{f"product_replace_{name}": _replaced_child(name) for name in feed.CHILD_TABLES},
    **{f"product_delete_{name}": _left_child(name) for name in feed.CHILD_TABLES},
    "product_status_transition": _status_transition,
    "product_delete_cascade": _deleted,
    "product_change_log": _product_log,
    "product_change_log_committed": _committed_log,
    "product_buckets": _bucketed,
    "product_search_title_indexed": _title_search,
    **{f"{name}_layout": _in_layout(name) for name in IN_LAYOUT},
}


def queries() -> dict:
    def bind(build):
        return lambda spark, folder: at_edge(build(DerivedTables(spark, folder)))

    def bind_search(params, live_only):
        return bind(lambda t: catalogue.list_products(t, params, live_only).select(*COLUMNS))

    searches = {
        name: bind_search(params, live_only)
        for name, (params, live_only, _) in SEARCHES.items()
    }
    return {**searches, **{name: bind(build) for name, build in _QUERIES.items()}}


def _nested_sql(products: str = "products", columns: str = "") -> str:
    texts = {
        "images": ["position", "alt", "src", "width", "height"],
        "documents": ["title", "description", "src", "kind", "position"],
        "metadata": ["metafield_id", "name", "label", "kind"],
        "options": ["name", "value", "position"],
    }
    parts = []
    for kind, fields in texts.items():
        struct = ", ".join(f"'{f}': c.{f}" for f in ["id", *fields])
        parts.append(
            f"""(SELECT coalesce(CAST(to_json(list({{{struct}}} ORDER BY c.place)) AS VARCHAR), '[]')
                 FROM f_{kind} c WHERE c.product_id = p.id) AS {kind}"""
        )
    # Text fields of a variant that its payload leaves out are blank, numbers are null.
    parts.append(
        """(SELECT coalesce('[' || string_agg(
               '{"id":' || c.id || ',"title":"' || c.title || '","sku":"' || c.sku || '","inventory_policy":"",'
               || '"fulfillment_service":"","inventory_management":"","taxable":"",'
               || '"barcode":"","weight_unit":"","requires_shipping":"","price":'
               || CAST(CAST(c.price AS DECIMAL(18,2)) AS VARCHAR) || ',"position":' || c.position
               || ',"compare_at_price":null,"grams":null,"weight":null,'
               || '"inventory_quantity":null}', ',' ORDER BY c.place) || ']', '[]')
            FROM f_variants c WHERE c.product_id = p.id) AS variants"""
    )
    shown = ", ".join([f"p.id, p.title{columns}, CAST(0 AS INTEGER) AS part", *parts])
    return f"SELECT {shown} FROM {products} p"


def _page_sql(limits: str) -> str:
    """A page of one account beside the total, which an empty page shows alone."""
    columns = ", ".join(f"t.{column}" for column in COLUMNS)
    return sql_with(f"""
        SELECT {columns}, n.total
        FROM (SELECT count(*) AS total FROM products WHERE account_id = 5) n
        LEFT JOIN (SELECT {PRODUCT_SQL} FROM products p WHERE p.account_id = 5
                   ORDER BY p.id DESC {limits}) t ON true""")


def oracle_sql() -> dict[str, str]:
    fresh = {f"f_{name}": sql for name, sql in _child_sql("feed").items()}
    revised = {f"r_{name}": sql for name, sql in _child_sql("revised").items()}
    found = {name: _products_sql(where) for name, (_, _, where) in SEARCHES.items()}
    found["product_page"] = _page_sql("LIMIT 10 OFFSET 10")
    found["product_by_id"] = _products_sql("p.id = 42")
    found["product_by_uid"] = _products_sql("p.uid = 'prd-7'")
    found["product_related"] = _products_sql(f"{RELATED_SQL} AND p.action_type = 9")
    found["product_recommended"] = _products_sql(RECOMMENDED_SQL)
    found["product_page_past_the_end"] = _page_sql("LIMIT 0")
    found["product_listing"] = sql_with(
        _nested_sql("listed", ", p.total"),
        **fresh,
        matching="SELECT * FROM products WHERE account_id = 5 AND price >= 905",
        listed="""SELECT t.*, n.total FROM (SELECT count(*) AS total FROM matching) n
            LEFT JOIN (SELECT * FROM matching ORDER BY id DESC LIMIT 10 OFFSET 10) t ON true""",
    )
    found["feed_field_rejects"] = sql_with("""
        SELECT product_id, 'inventory_quantity' AS field, CAST(0 AS BIGINT) AS place,
               'many' AS text FROM feed WHERE product_id % 50 = 0""")
    found["product_with_children"] = sql_with(_nested_sql(), **fresh)
    found["feed_products"] = sql_with(FEED_PRODUCTS_SQL)
    for name, sql in _child_sql("feed").items():
        shown = "SELECT * REPLACE (CAST(price AS DOUBLE) AS price) FROM f" if (
            name == "variants"
        ) else "SELECT * FROM f"
        found[f"feed_{name}"] = sql_with(shown, f=sql)
    found["feed_unknown_fields"] = """
        WITH whole AS (SELECT *, p_partkey AS product_id FROM part WHERE p_type <> 'PROMO'),
        rows AS (
            SELECT '' AS path, 'no object' AS problem, 'list' AS found, p_partkey AS product_id,
                   '[' || p_partkey || ']' AS example FROM part WHERE p_type = 'PROMO'
            UNION ALL SELECT 'colour', 'unknown', 'value', product_id, '"' || p_brand || '"' FROM whole
            UNION ALL SELECT 'price', 'kind', 'object', product_id, '{"amount":' || p_size || '}' FROM whole
            UNION ALL SELECT 'images[].depth', 'unknown', 'value', product_id, i::VARCHAR
                FROM whole, range(4) AS r(i) WHERE i < p_size % 4
            UNION ALL SELECT 'videos', 'kind', 'value', product_id, '"none"' FROM whole WHERE p_size % 2 = 0
            UNION ALL SELECT 'variants[].sku', 'kind', 'list', product_id, '["' || p_brand || '"]' FROM whole
            UNION ALL SELECT 'variants[].options[].unit', 'unknown', 'value', product_id, '"EU"' FROM whole)
        SELECT path, problem, found, count(*) AS n_found, min(product_id) AS product_id,
               min(example) FILTER (product_id = least_id) AS example
        FROM (SELECT *, min(product_id) OVER (PARTITION BY path, problem, found) AS least_id FROM rows)
        GROUP BY path, problem, found"""
    found["feed_option_rejects"] = sql_with(f"""
        SELECT product_id, {_child_id('i')} AS variant_id, 'colour' AS option,
               CASE WHEN i % 2 = 0 THEN 'S' ELSE 'M' END AS value
        FROM feed, range(3) AS r(i) WHERE i < product_id % 3 + 1 AND product_id % 10 = 0""")
    found["product_replace"] = sql_with("""
        SELECT p.id, p.uid, p.account_id, p.vendor_id, coalesce(r.title, p.title) AS title,
               CASE WHEN r.title IS NULL OR r.title = p.title THEN p.slug ELSE r.title END AS slug,
               coalesce(r.p_type, p.description) AS description,
               CASE WHEN r.product_id IS NULL THEN p.published_scope ELSE 1 END AS published_scope,
               CAST(coalesce(r.price, p.price) AS DOUBLE) AS price,
               CASE WHEN r.product_id IS NULL THEN p.inventory_quantity
                    WHEN r.product_id % 50 <> 0 THEN r.p_size END AS inventory_quantity,
               CASE WHEN p.action_type = 9 AND r.n_images = 0 THEN 1
                    WHEN p.action_type = 1 AND r.n_images > 0 THEN 9
                    ELSE p.action_type END AS action_type, """
        + UNSET_SQL
        + """,
               CASE WHEN p.action_type = 9 AND r.n_images = 0 OR
                         p.action_type = 1 AND r.n_images > 0 THEN '2024-01-10 08:30:00'
                    ELSE strftime(p.created_at, '%Y-%m-%d %H:%M:%S') END AS action_date,
               strftime(p.created_at, '%Y-%m-%d %H:%M:%S') AS created_at
        FROM products p LEFT JOIN revised r ON r.product_id = p.id""")
    found["product_status_transition"] = sql_with("""
        SELECT p.id, p.action_type AS old_code, r.n_images > 0 AS with_images,
               CASE WHEN r.n_images = 0 THEN 1 ELSE 9 END AS new_code
        FROM products p JOIN revised r ON r.product_id = p.id""")
    kept = "SELECT * FROM f_{name} WHERE product_id NOT IN (SELECT product_id FROM revised)"
    for name in feed.CHILD_TABLES:
        columns = ", ".join(
            "CAST(price AS DOUBLE) AS price" if c == "price" else c
            for c in CHILD_COLUMNS.get(name, ["*"])
        )
        found[f"product_replace_{name}"] = sql_with(
            f"SELECT {columns} FROM ({kept.format(name=name)} UNION ALL SELECT * FROM r_{name})",
            **{f"f_{name}": fresh[f"f_{name}"], f"r_{name}": revised[f"r_{name}"]},
        )
        found[f"product_delete_{name}"] = sql_with(
            f"""SELECT {columns} FROM f_{name} WHERE product_id IN (
                SELECT id FROM products WHERE inventory_quantity > 10)""",
            **{f"f_{name}": fresh[f"f_{name}"]},
        )
    found["product_replace_children"] = sql_with(
        " UNION ALL ".join(
            f"""SELECT '{name}' AS child, product_id, count(*) AS n_rows FROM (
                {kept.format(name=name)} UNION ALL SELECT * FROM r_{name}) GROUP BY product_id"""
            for name in feed.CHILD_TABLES
        ),
        **fresh,
        **revised,
    )
    found["product_delete_cascade"] = sql_with(
        """SELECT 'products' AS child, id AS product_id, CAST(1 AS BIGINT) AS n_rows
           FROM products WHERE inventory_quantity > 10 UNION ALL """
        + " UNION ALL ".join(
            f"""SELECT '{name}', c.product_id, count(*) FROM f_{name} c
                JOIN products p ON p.id = c.product_id
                WHERE p.inventory_quantity > 10 GROUP BY c.product_id"""
            for name in feed.CHILD_TABLES
        ),
        **fresh,
    )
    found["product_page_by_rank"] = found["product_page"]
    found["product_search_title_indexed"] = found["product_search_title"]
    found |= {f"{name}_layout": found[name] for name in IN_LAYOUT}
    left = "product_id IN (SELECT id FROM products WHERE inventory_quantity > 10)"
    found["product_buckets"] = sql_with(
        """SELECT 'products' AS child, id AS product_id, CAST(1 AS BIGINT) AS n_rows
           FROM products WHERE inventory_quantity > 10 UNION ALL """
        + " UNION ALL ".join(
            f"""SELECT '{name}' AS child, product_id, count(*) AS n_rows FROM (
                {kept.format(name=name)} UNION ALL SELECT * FROM r_{name})
                WHERE {left} GROUP BY product_id"""
            for name in feed.CHILD_TABLES
        ),
        **fresh,
        **revised,
    )
    found["product_change_log"] = found["product_change_log_committed"] = sql_with("""
        SELECT product_id AS entity_id, 'create' AS action FROM feed
        UNION ALL SELECT product_id, 'update' FROM revised
        UNION ALL SELECT id, 'delete' FROM products WHERE inventory_quantity <= 10""")
    return found

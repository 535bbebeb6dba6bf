from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal as D

import pytest

from tallyloom.plans import feed
from tallyloom.sources.lazy import LazyTables
from tallyloom.sources.sinks import write_export, write_snapshot
from tallyloom.sources.stored import StoredTables, empty_table

AS_OF = dt.datetime(2024, 6, 1, 12)
LATER = dt.datetime(2024, 7, 1, 12)

FULL = {
    "business_uid": "biz-1",
    "account_id": 5,
    "title": "Shirt",
    "price": 12.5,
    "images": [
        {"position": 0, "alt": "front", "src": "a.png", "width": 10, "height": 20},
        {"alt": "back", "src": "b.png"},
    ],
    "categories": ["shirts", "nothing", "both"],
    "videos": [{"url": "v"}],
    "documents": [{"title": "Care", "src": "c.pdf", "kind": "pdf", "position": 0}],
    "metadata": [
        {"metafield_id": 1, "name": ["x", "y"], "label": "tags", "kind": 7},
        {"metafield_id": 2, "name": ["plain"], "kind": 1},
        {"metafield_id": 3, "kind": 7},
    ],
    "options": [
        {"name": "size", "value": ["S", "M"], "position": 0},
        {"name": "size", "value": ["L"], "position": 1},
    ],
    "variants": [
        {"title": "S", "options": [{"option": "size", "value": "S"}]},
        {"title": "red", "price": 3, "options": [{"option": "colour", "value": "red"}]},
        {"title": "bare"},
    ],
}

BARE = {"business_uid": "biz-1", "account_id": 6, "title": "Bare", "published_scope": "WEB"}
LOST = {"business_uid": "nobody", "account_id": 6, "title": "Lost", "images": [{"src": "z"}]}


@pytest.fixture
def tables(make):
    return {
        "businesses": make("businesses", [(1, "biz-1"), (2, "biz-1"), (3, "biz-3")]),
        # the slug "both" is used in two accounts
        "categories": make("categories", [(50, 1, "shirts"), (61, 2, "both"), (60, 1, "both")]),
    }


def parsed(make, payloads):
    rows = [(key, json.dumps(payload)) for key, payload in payloads.items()]
    return feed.parse_feed(make("feed", rows, "product_id bigint, payload string"))


@pytest.fixture
def loaded(make, tables):
    return feed.load_feed(tables, parsed(make, {1: FULL, 2: BARE, 3: LOST}), AS_OF)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_headers(loaded):
    found = {r.id: r for r in loaded["products"].collect()}
    assert set(found) == {1, 2}
    assert (found[1].vendor_id, found[1].slug, found[1].price) == (1, "Shirt", D("12.50"))
    assert (found[1].action_type, found[2].action_type) == (9, 1)
    assert (found[2].description, found[2].currency) == ("", "")
    assert found[2].price is None and found[2].inventory_quantity is None
    assert (found[1].published_scope, found[2].published_scope) == (1, 1)
    assert found[1].created_at == AS_OF


def test_children(loaded):
    assert rows(loaded["images"], "place", "src", "width", "height") == [
        (0, "a.png", 10, 20), (1, "b.png", 0, 0),
    ]
    assert loaded["images"].select("id").distinct().count() == 2
    assert rows(loaded["videos"], "title", "url", "description") == [("", "v", "")]
    assert rows(loaded["documents"], "title", "description") == [("Care", "")]
    assert rows(loaded["metadata"], "metafield_id", "name", "label") == [
        (1, '["x","y"]', "tags"), (2, "plain", ""), (3, "", ""),
    ]
    assert rows(loaded["options"], "name", "value") == [
        ("size", '["L"]'), ("size", '["S","M"]'),
    ]
    assert rows(loaded["variants"], "title", "sku") == [("S", ""), ("bare", ""), ("red", "")]
    assert rows(loaded["collections"], "product_id", "category_id") == [(1, 50), (1, 60)]


def test_variant_options_and_rejects(make, loaded):
    options = {(r.place, r.id) for r in loaded["options"].collect()}
    variants = {(r.place, r.id) for r in loaded["variants"].collect()}
    ((option, variant, value),) = rows(
        loaded["option_variants"], "option_id", "variant_id", "value"
    )
    assert (0, option) in options and (0, variant) in variants and value == "S"
    rejects = feed.option_rejects(parsed(make, {1: FULL}))
    ((product, variant, name),) = rows(rejects, "product_id", "variant_id", "option")
    assert (product, name) == (1, "colour") and (1, variant) in variants


def test_unknown_business_is_rejected(make, tables):
    rejects = feed.feed_rejects(tables, parsed(make, {1: FULL, 3: LOST}))
    assert rows(rejects, "product_id", "business_uid") == [(3, "nobody")]


@pytest.mark.parametrize(
    "old, images, new",
    [(9, True, 9), (9, False, 1), (1, True, 9), (1, False, 1), (4, True, 4), (4, False, 4)],
)
def test_status_on_replace(make, tables, old, images, new):
    payload = {**BARE, "images": [{"src": "n"}] if images else []}
    products = make(
        "products",
        [(1, "u", 5, 1, "Bare", "old-slug", "", "", 1, "", None, None, None, None, "", old, AS_OF, AS_OF)],
    )
    changed = feed.replaced_products(products, parsed(make, {1: payload}), LATER).first()
    assert changed.action_type == new
    assert changed.action_date == (AS_OF if old == new else LATER)
    assert changed.slug == "old-slug"


@pytest.fixture
def stored(spark, tables, loaded, tmp_path):
    """A first snapshot on disk, as a replace job finds it."""
    folder = str(tmp_path / "one")
    write_snapshot({name: loaded[name] for name in ("products", *feed.CHILD_TABLES)}, folder)
    return StoredTables(spark, folder)


def replaced(tables, stored, update):
    base = {**tables, "products": stored["products"]}
    return feed.replace(base, stored, update, LATER)


UPDATE = {
    "business_uid": "biz-1", "account_id": 99, "title": "Shirt 2", "price": 1,
    "images": [{"src": "new.png", "height": 7}], "options": [{"name": "fit", "value": ["slim"]}],
}


def test_replace(make, tables, stored):
    update = parsed(make, {1: UPDATE, 77: UPDATE})
    after = replaced(tables, stored, update)
    products = {r.id: r for r in after["products"].collect()}
    assert set(products) == {1, 2}
    assert (products[1].title, products[1].slug) == ("Shirt 2", "Shirt 2")
    assert (products[1].account_id, products[1].vendor_id) == (5, 1)
    assert products[1].created_at == AS_OF
    assert products[2].title == "Bare"
    assert rows(after["images"], "product_id", "src", "height") == [(1, "new.png", 7)]
    assert rows(after["options"], "name") == [("fit",)]
    for emptied in ("videos", "documents", "metadata", "variants", "option_variants", "collections"):
        assert after[emptied].count() == 0


def test_replace_twice_is_replace_once(spark, make, tables, stored, tmp_path):
    update = parsed(make, {1: UPDATE})
    once = replaced(tables, stored, update)
    folder = str(tmp_path / "two")
    write_snapshot(once, folder)
    again = replaced(tables, StoredTables(spark, folder), update)
    for name in ("products", *feed.CHILD_TABLES):
        assert sorted(map(str, again[name].collect())) == sorted(map(str, once[name].collect()))


def test_snapshots_are_not_overwritten(stored, tmp_path):
    with pytest.raises(Exception, match="exist"):
        write_snapshot({"products": stored["products"]}, str(tmp_path / "one"))


def test_delete_leaves_no_child(make, tables, stored):
    base = {**tables, "products": stored["products"]}
    left = feed.delete(base, stored, make("ids", [(1,)], "id bigint"))
    assert rows(left["products"], "id") == [(2,)]
    for name in feed.CHILD_TABLES:
        assert left[name].count() == 0


def test_product_changes(make):
    ids = make("ids", [(1,), (2,)], "id bigint")
    log = feed.product_changes(ids, "create").unionByName(feed.product_changes(ids, "delete"))
    assert rows(log, "entity_id", "action") == [(1, "create"), (1, "delete"), (2, "create"), (2, "delete")]
    with pytest.raises(ValueError):
        feed.product_changes(ids, "rename")


def test_export_keeps_headings(spark, tmp_path):
    path = str(tmp_path / "export")
    write_export(spark.sql("SELECT 1 AS `Fee Amount`"), path)
    assert spark.read.csv(path, header=True).columns == ["Fee Amount"]
    with pytest.raises(ValueError):
        write_export(spark.range(1), path, "pdf")


def test_text_that_is_no_payload(make, tables):
    bad = feed.parse_feed(make("feed", [(9, "{oops")], "product_id bigint, payload string"))
    loaded = feed.load_feed(tables, bad, AS_OF)
    assert loaded["products"].count() == 0
    assert loaded["images"].count() == 0
    assert rows(feed.feed_rejects(tables, bad), "product_id") == [(9,)]


def test_tables_are_built_once_and_lazily(spark):
    calls = []

    def build():
        calls.append(1)
        return empty_table(spark, "rooms")

    tables = LazyTables({"rooms": build})
    assert calls == [] and list(tables) == ["rooms"]
    assert tables["rooms"] is tables["rooms"]
    assert calls == [1]


def test_single_values_and_numbers_as_text(make):
    payload = {
        **BARE,
        "inventory_quantity": "5",
        "price": "9.50",
        "min_purchase_quantity": "some",
        "metadata": [
            {"metafield_id": "1", "name": "Red", "kind": 1},
            {"metafield_id": 2, "name": "Red", "kind": "7"},
            {"metafield_id": 3, "name": ["a", "b"], "kind": 7},
        ],
        "options": [{"name": "size", "value": "S"}, {"name": "n", "value": 5}],
        "variants": [{"title": "v", "inventory_quantity": "7", "grams": 5.0, "weight": "heavy"}],
    }
    delivered = make("feed", [(1, json.dumps(payload))], "product_id bigint, payload string")
    read = feed.parse_feed(delivered)
    assert rows(read, "inventory_quantity", "price", "account_id") == [(5, D("9.50"), 6)]
    assert rows(feed.metadata_of(read), "metafield_id", "name") == [
        (1, "Red"), (2, '"Red"'), (3, '["a","b"]'),
    ]
    assert rows(feed.options_of(read), "name", "value") == [("n", "5"), ("size", '"S"')]
    assert rows(feed.variants_of(read), "inventory_quantity", "grams") == [(7, 5)]
    assert rows(feed.field_rejects(delivered), "product_id", "field", "place", "text") == [
        (1, "min_purchase_quantity", 0, "some"), (1, "variants.weight", 0, "heavy"),
    ]


def test_last_delivery_counts(make, tables):
    deliveries = [
        (1, 2, json.dumps({**BARE, "title": "late"})), (1, 1, json.dumps({**FULL, "title": "early"})),
    ]
    delivered = make("feed", deliveries, "product_id bigint, sequence int, payload string")
    loaded = feed.load_feed(tables, feed.parse_feed(delivered), AS_OF)
    assert rows(loaded["products"], "id", "title") == [(1, "late")]
    assert loaded["images"].count() == 0


def deepest(plan: str) -> str:
    """What a plan does below its last exchange, in the tasks that read the input."""
    return plan[plan.rindex("Exchange") :]


def test_payloads_are_sorted_in_partitions_of_bounded_size_only(make):
    """A task that reads the feed holds no payloads, however many it reads."""
    delivered = make("feed", [(1, 1, "{}")], "product_id bigint, sequence int, payload string")
    for found in (feed.parse_feed(delivered), feed.field_rejects(delivered)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "payload" in deepest(plan)
        assert "Sort" not in deepest(plan)
        assert "REBALANCE_PARTITIONS_BY_COL" in deepest(plan)


def test_field_rejects_read_a_payload_once(make):
    """A union of lists let one task hold the payloads of its partition once per list."""
    delivered = make("feed", [(1, 1, "{}")], "product_id bigint, sequence int, payload string")
    plan = feed.field_rejects(delivered)._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan
    assert plan.count("Scan ExistingRDD") == 1


def test_repeats_ties_and_blanks_of_deliveries(make):
    """One product delivered very often; equal sequences, blank sequences, payloads and products."""
    columns = "product_id bigint, sequence int, payload string"
    title = '{{"title": "{}"}}'.format
    deliveries = [(1, n % 500, title(f"t{n:04}")) for n in range(2000)]
    deliveries += [(2, 3, title("b")), (2, 3, title("a")), (2, None, title("z")), (3, 1, title("x")), (3, 2, None)]
    deliveries += [(4, None, title("n")), (5, 1, None), (5, 1, title("p")), (None, 1, title("q"))]
    read = feed.parse_feed(make("feed", deliveries, columns)).select("product_id", "title").collect()
    assert sorted(map(tuple, read), key=str) == sorted(
        [(1, "t1999"), (2, "b"), (3, None), (4, "n"), (5, "p"), (None, "q")], key=str
    )


def test_field_rejects_of_lists_with_blanks(make):
    payloads = [
        (1, json.dumps({"images": [None, {"width": "wide", "height": ""}], "variants": None, "price": "much"})),
        (2, json.dumps({"images": [], "options": [{"position": "x"}, {"position": "1.5"}]})), (3, None), (4, "{oops"),
    ]
    found = feed.field_rejects(make("feed", payloads, "product_id bigint, payload string"))
    assert rows(found, "product_id", "field", "place", "text") == [
        (1, "images.width", 1, "wide"), (1, "price", 0, "much"),
        (2, "options.position", 0, "x"), (2, "options.position", 1, "1.5"),
    ]
    assert found.schema.simpleString() == "struct<product_id:bigint,field:string,place:bigint,text:string>"


def test_repeated_delivery_without_sequence_is_refused(make, tables, stored):
    twice = [(1, json.dumps(UPDATE)), (1, json.dumps({**UPDATE, "title": "x"}))]
    update = feed.parse_feed(make("feed", twice, "product_id bigint, payload string"))
    assert rows(feed.repeated_deliveries(update), "product_id", "n_rows") == [(1, 2)]
    assert feed.load_feed(tables, update, AS_OF)["products"].count() == 0
    after = replaced(tables, stored, update)
    assert rows(after["products"], "id", "title") == [(1, "Shirt"), (2, "Bare")]
    assert after["images"].count() == 2


def test_products_not_delivered_keep_their_date(make):
    old = [(1, "u", 5, 1, "Bare", "s", "", "", 1, "", None, None, None, None, "", None, AS_OF, AS_OF)]
    products = make("products", old)
    untouched = feed.replaced_products(products, parsed(make, {2: BARE}), LATER).first()
    assert untouched.action_date == AS_OF
    delivered = feed.replaced_products(products, parsed(make, {1: BARE}), LATER).first()
    assert delivered.action_date == AS_OF and delivered.action_type is None


def test_unknown_fields(make):
    """Nested lists, null, single items where lists are declared, and payloads that are no object."""
    payloads = [
        (3, json.dumps({**FULL, "weight": {"kg": 1}, "images": [{"src": "a", "alt": None, "dpi": 3}, None, "b.png"]})),
        (2, json.dumps({"title": ["a"], "images": {"src": "x"}, "videos": None, "dpi": 1, "metadata": [{"name": {"x": 1}}]})),
        (4, json.dumps({"variants": [{"options": [{"option": "size", "extra": 1}, 5]}, {"options": "none"}]})),
        (5, "{oops"), (6, "7"), (7, None), (8, "{}"), (1, json.dumps({"weight": 2})),
    ]
    found = feed.unknown_fields(make("feed", payloads, "product_id bigint, payload string"))
    assert rows(found, "path", "problem", "found", "n_found", "product_id", "example") == sorted([
        ("", "no object", "text", 2, 5, "{oops"),
        ("", "no object", "value", 1, 6, "7"),
        ("weight", "unknown", "object", 1, 3, '{"kg":1}'),
        ("weight", "unknown", "value", 1, 1, "2"),
        ("dpi", "unknown", "value", 1, 2, "1"),
        ("images[].dpi", "unknown", "value", 1, 3, "3"),
        ("images[]", "kind", "value", 1, 3, '"b.png"'),
        ("images", "kind", "object", 1, 2, '{"src":"x"}'),
        ("title", "kind", "list", 1, 2, '["a"]'),
        ("variants[].options", "kind", "value", 1, 4, '"none"'),
        ("variants[].options[]", "kind", "value", 1, 4, "5"),
        ("variants[].options[].extra", "unknown", "value", 1, 4, "1"),
    ])
    assert feed.unknown_fields(make("feed", [], "product_id bigint, payload string")).collect() == []

"""Joins that multiply rows from both sides: models are made distinct before they meet, and results stay the same."""

import os

import pytest
from pyspark.sql import functions as F

from metricloom import model, repository
from metricloom.catalogue import models as catalogue
from metricloom.catalogue.queries import ENTRIES
from metricloom.operators.lowering import Lowering
from metricloom.plans.evaluation import Evaluation
from metricloom.plans.joins import JoinStep, counts_rows
from tests.music import equal

SF = "/root/testdata/sf0.01"


def joined_rows(builder, query):
    """The rows of the query's only segment, before they are aggregated."""
    plan = builder.plan(query)
    return Lowering(builder.repository, builder.spark, Evaluation(builder.repository))._rows(plan.segments[0])


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", ["join_many_to_many", "join_priority_path"])
def test_suppliers_meet_distinct_customers(spark, name):
    entry = ENTRIES[name]
    got = joined_rows(entry.repository(SF).build(spark), entry.query).count()
    suppliers = spark.read.parquet(f"{SF}/supplier.parquet").count()
    customers = spark.read.parquet(f"{SF}/customer.parquet").select("c_nationkey", "c_mktsegment").distinct().count()
    assert got <= suppliers * 5 + customers


def shops(spark, how=None, theta=False, partial="left"):
    """Cities with shops on one side, and on the other people with their purchases; nulls, orphans, repeated rows."""

    def frame(name, schema, rows):
        m = model(name).from_dataframe(spark.createDataFrame(rows, schema).coalesce(1))
        for c in schema.split(", "):
            column, kind = c.split()
            m.with_dimension(column, "string" if kind == "string" else "number", primary_key=column == "id")
        return m

    city = frame("city", "id int, name string, zone int", [(1, "A", 1), (2, "B", 1), (3, "C", None), (4, None, 2)])
    shop = frame("shop", "id int, city int, kind string, size double", [(i, (1, 1, 2, 3, None, 9)[i % 6], ("x", None, "y")[i % 3], (0.5, None)[i % 2]) for i in range(20)])
    person = frame("person", "id int, city int, sex string", [(i, (1, 2, 2, None, 4, 8)[i % 6], ("f", "m", None)[i % 3]) for i in range(24)])
    bought = frame("bought", "person int, thing string", [((i * 7) % 30 if i % 5 else None, ("p", "q", None)[i % 3]) for i in range(40)])
    visit = frame("visit", "person int, day int", [((i * 5) % 28, i % 3) for i in range(40)])
    for m in (city, shop, person):
        m.with_metric("count", "number", lambda m: F.count(m.column("id")))
    shop.with_metric("size_sum", "number", lambda m: F.sum(m.column("size")))
    shop.with_metric("kinds", "number", lambda m: F.count_distinct(m.column("kind")), ignores_duplicates=True)
    shop.with_metric("mean_of_sizes", "number", lambda m: F.round(F.avg(m.metric("size_sum")), 6))
    bought.with_metric("count", "number", lambda m: F.count(m.column("thing")))
    r = repository()
    for m in (city, shop, person, bought, visit):
        r.with_model(m)
    same_city = lambda m, x: m["city"].dimension("id") == m[x].dimension("city")
    by_city = lambda x: lambda m: same_city(m, x) & (m["city"].column("zone") < 2) if theta else same_city(m, x)
    by_person = lambda x: lambda m: m["person"].dimension("id") == m[x].dimension("person")
    r.join_one_to_many("city", "shop", by_city("shop"), how=how)
    r.join_one_to_many("city", "person", by_city("person"), how=None if partial == "left" else partial)
    r.join_one_to_many("person", "bought", by_person("bought"), how=None if partial == "left" else partial)
    return r.join_one_to_many("person", "visit", by_person("visit"))


QUERIES = [
    {"members": ["city.name", "shop.count", "shop.size_sum"], "filters": [{"operator": "equals", "member": "person.sex", "value": ["f"]}]},
    {"members": ["person.sex", "shop.count"]},
    {"members": ["bought.thing", "shop.count", "shop.kinds"]},
    {"members": ["bought.thing", "shop.kinds"]},
    {"members": ["bought.thing", "visit.day", "shop.mean_of_sizes"]},
    {"members": ["bought.thing", "visit.day", "person.count"]},
    {"members": ["shop.kind", "bought.thing"]},
    {"members": ["bought.thing", "shop.kind", "visit.day"], "filters": [{"operator": "notSet", "member": "person.sex"}]},
    {"members": ["shop.kind", "person.count"], "filters": [{"operator": "or", "filters": [{"operator": "set", "member": "bought.thing"}, {"operator": "gt", "member": "visit.day", "value": [1]}]}]},
    {"members": ["shop.kind", "person.count"], "filters": [{"operator": "inQuery", "member": "bought.thing", "value": {"members": ["bought.thing"], "filters": [{"operator": "set", "member": "person.sex"}]}}]},
]


@pytest.mark.parametrize("how, theta, partial", [(None, False, "left"), ("inner", False, "inner"), (None, True, "full")])
def test_results_are_those_of_whole_models(spark, monkeypatch, how, theta, partial):
    builder = shops(spark, how, theta, partial).build(spark)
    rows = lambda: [sorted(map(tuple, builder.build_query(q).collect()), key=str) for q in QUERIES]
    got = rows()
    monkeypatch.setattr(Lowering, "_reads", lambda *_: None)
    assert got == rows()


def test_what_hangs_on_a_model_is_made_distinct_with_it(spark):
    builder = shops(spark).build(spark)
    query = {"members": ["bought.thing", "shop.count"]}
    rows = joined_rows(builder, query)
    assert {f.name for f in rows.schema.fields} >= {"thing", "kind"} and "sex" not in rows.columns
    # of persons and what they bought only city and thing are left, each pair once
    pairs = rows.groupBy(F.col("shop.id"), F.col("person.city"), F.col("bought.thing")).count()
    assert pairs.where(F.col("count") > 1).count() == 0


def test_columns_that_are_not_named_by_their_model_are_read_too(spark):
    a = model("a").from_dataframe(spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "id int, k int")).with_dimension("id", "number", primary_key=True).with_dimension("k", "number")
    a.with_metric("count", "number", lambda m: F.count(m.column("id")))
    b = model("b").from_dataframe(spark.createDataFrame([(7, 1, {"x": 1}), (7, 2, {"x": 2}), (7, 2, {"x": 2}), (8, 3, {})], "k int, v int, m map<string, int>")).with_dimension("k", "number")
    b.with_dimension("next", "number", lambda m: m.sql("v + {}", 1)).with_dimension("bare", "number", lambda m: F.col("v") * 2)
    b.with_dimension("x", "number", lambda m: m.column("m")["x"])
    builder = repository().with_model(a).with_model(b).join_many_to_many("a", "b", equal("a", "b", "k")).build(spark)
    rows = lambda dimension: sorted(map(tuple, builder.build_query({"members": [dimension, "a.count"]}).collect()), key=str)
    assert rows("b.next") == [(2, 2), (3, 2), (4, 1)]
    assert rows("b.bare") == [(2, 2), (4, 2), (6, 1)]
    assert rows("b.x") == [(1, 2), (2, 2), (None, 1)]  # maps can't be compared: all rows are joined


def test_the_model_that_counts_joined_rows():
    sales = catalogue.sales("")
    steps = [JoinStep("orders", "customer", "right"), JoinStep("orders", "lineitem", "left"), JoinStep("lineitem", "part", "left")]
    assert counts_rows(sales.joins, steps, ["orders", "customer", "lineitem", "part"]) == "lineitem"
    assert counts_rows(sales.joins, [*steps, JoinStep("customer", "events", "left")], ["orders", "customer", "lineitem", "part", "events"]) is None
    trade = catalogue.trade("")
    assert counts_rows(trade.joins, [JoinStep("customer", "supplier", "left")], ["customer", "supplier"]) is None
    assert counts_rows(trade.joins, [JoinStep("customer", "nation", "right")], ["nation", "customer"]) == "customer"

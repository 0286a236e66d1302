"""Results over small tables with nulls, orphans and repeated rows."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from metricloom import format_results, model, repository
from metricloom.model import Model
from tests.music import equal


def frame(spark, name, schema, rows) -> Model:
    return model(name).from_dataframe(spark.createDataFrame(rows, schema))


def rows_of(builder, members, context=None, **query):
    return [tuple(r) for r in builder.build_query({"members": members, **query}, context).collect()]


def f(op, member, *value):
    return {"operator": op, "member": member, **({"value": list(value)} if value else {})}


@pytest.fixture(scope="module")
def store_sales(spark):
    rows = [(1, 1, 1, 10), (2, 1, 1, 20), (3, 1, 2, 30), (4, 1, 2, 40), (5, 2, 1, 50), (6, 2, 1, 60), (7, 2, 2, 70), (8, 2, 2, 80)]
    m = frame(spark, "store_sales", "id int, store_id int, product_id int, sales int", rows)
    m.with_dimension("id", "number").with_dimension("store_id", "number", primary_key=True).with_dimension("product_id", "number", primary_key=True)
    m.with_metric("sales", "number", lambda m: F.sum(m.column("sales")))
    m.with_metric("median_sales", "number", lambda m: m.sql("percentile_cont(0.5) within group (order by {})", m.metric("sales")))
    return repository().with_model(m).build(spark)


def test_metric_of_a_metric(store_sales):
    assert rows_of(store_sales, ["store_sales.store_id", "store_sales.median_sales", "store_sales.sales"]) == [(2, 130, 260), (1, 50, 100)]
    assert rows_of(store_sales, ["store_sales.store_id", "store_sales.product_id", "store_sales.median_sales", "store_sales.sales"]) == [(2, 2, 150, 150), (2, 1, 110, 110), (1, 2, 70, 70), (1, 1, 30, 30)]
    assert rows_of(store_sales, ["store_sales.median_sales"]) == [(90,)]


@pytest.fixture(scope="module")
def shop(spark):
    """Customer 3 has no invoice, invoice 14 has no customer, two customers have no country."""
    c = frame(spark, "customers", "id int, name string, country string", [(1, "Ann", "AT"), (2, "Bob", None), (3, "Cyd", "CH"), (4, "dan%", None)])
    c.with_dimension("customer_id", "number", lambda m: m.column("id"), primary_key=True).with_dimension("name", "string").with_dimension("country", "string")
    c.with_metric("count", "number", lambda m: F.count(m.column("id")))
    i = frame(
        spark,
        "invoices",
        "id int, customer int, total int, made timestamp_ntz",
        [(10, 1, 5, datetime(2021, 1, 1)), (11, 1, 7, datetime(2021, 12, 31)), (12, 2, 7, datetime(2022, 12, 31, 5)), (13, 2, None, None), (14, 9, 1, datetime(2020, 6, 5, 4, 3, 2))],
    )
    i.with_dimension("invoice_id", "number", lambda m: m.column("id"), primary_key=True).with_dimension("customer_id", "number", lambda m: m.column("customer")).with_dimension("made", "datetime")
    i.with_metric("total", "number", lambda m: F.sum(m.column("total"))).with_metric("count", "number", lambda m: F.count(m.column("id")))
    lines = frame(spark, "lines", "invoice int, line int, song string", [(10, 1, "x"), (10, 2, "x"), (10, 3, "y"), (11, 1, "x"), (12, 1, None), (14, 1, "y")])
    lines.with_dimension("invoice_id", "number", lambda m: m.column("invoice"), primary_key=True).with_dimension("line", "number", primary_key=True).with_dimension("song", "string")
    lines.with_metric("count", "number", lambda m: F.count(m.column("line")))
    r = repository().with_model(c).with_model(i).with_model(lines)
    r.join_one_to_many("customers", "invoices", equal("customers", "invoices", "customer_id"))
    r.join_one_to_many("invoices", "lines", equal("invoices", "lines", "invoice_id"))
    r.with_calculated_dimension("invoices.buyer", "string", lambda m: F.concat(m["customers"].dimension("name"), F.lit("/"), m["invoices"].dimension("invoice_id").cast("string")))
    r.with_calculated_metric("shop.per_line", "number", lambda m: m["invoices"].metric("total", aggregated=True) / m["lines"].metric("count", aggregated=True))
    return r.build(spark)


def test_rows_without_partner(shop):
    # from the metric's model to the customers: those without invoices stay, the invoice without customer goes
    assert rows_of(shop, ["customers.name", "invoices.total"], order=[{"member": "customers.name", "direction": "asc"}]) == [("Ann", 12), ("Bob", 7), ("Cyd", None), ("dan%", None)]
    assert rows_of(shop, ["invoices.total"]) == [(20,)]
    assert sorted(rows_of(shop, ["customers.name", "invoices.invoice_id"]), key=str) == [("Ann", 10), ("Ann", 11), ("Bob", 12), ("Bob", 13), ("Cyd", None), ("dan%", None)]


def test_segments_meet_only_in_values_that_are_not_null(shop):
    assert rows_of(shop, ["customers.country", "customers.count"]) != []
    assert sorted(rows_of(shop, ["customers.country", "customers.count"]), key=str) == [("AT", 1), ("CH", 1), (None, 2)]
    assert sorted(rows_of(shop, ["customers.country", "customers.count", "invoices.total"])) == [("AT", 1, 12), ("CH", 1, None)]


def test_rows_multiplied_by_a_join_count_once(shop):
    assert sorted(rows_of(shop, ["lines.song", "invoices.total"]), key=str) == [("x", 12), ("y", 6), (None, 7)]
    # a dimension that only filters is part of the grain: invoice 10 counts for x and for y
    assert rows_of(shop, ["invoices.total"], filters=[f("in", "lines.song", "x", "y")]) == [(18,)]


def test_metric_filters_come_after_aggregation(shop):
    assert rows_of(shop, ["customers.name", "invoices.total"], filters=[f("gt", "invoices.total", 7)]) == [("Ann", 12)]
    assert rows_of(shop, ["customers.name"], filters=[f("gte", "invoices.count", 2)]) == [("Ann",), ("Bob",)]
    assert rows_of(shop, ["invoices.total"], filters=[f("gt", "invoices.total", 100)]) == []


def names(shop, *filters):
    return [r[0] for r in rows_of(shop, ["customers.name"], filters=list(filters))]


@pytest.mark.parametrize(
    ("filters", "want"),
    [
        ([f("equals", "customers.country", "AT")], ["Ann"]),
        ([f("in", "customers.country", "AT", "CH")], ["Ann", "Cyd"]),
        ([f("notEquals", "customers.country", "AT")], ["Cyd"]),
        ([f("notIn", "customers.country", "AT", "CH")], []),
        ([f("set", "customers.country")], ["Ann", "Cyd"]),
        ([f("notSet", "customers.country")], ["Bob", "dan%"]),
        ([f("contains", "customers.name", "N", "y")], ["Ann", "Cyd", "dan%"]),
        ([f("notContains", "customers.name", "N", "y")], ["Bob"]),
        ([f("startsWith", "customers.name", "a", "D")], ["Ann", "dan%"]),
        ([f("notStartsWith", "customers.name", "a", "D")], ["Bob", "Cyd"]),
        ([f("endsWith", "customers.name", "B", "d")], ["Bob", "Cyd"]),
        ([f("notEndsWith", "customers.name", "B", "d")], ["Ann", "dan%"]),
        ([f("contains", "customers.name", "_")], ["Ann", "Bob", "Cyd", "dan%"]),  # a wildcard
        ([f("gt", "customers.customer_id", 1, 2)], ["Cyd", "dan%"]),
        ([f("gte", "customers.customer_id", "2"), f("lt", "customers.customer_id", 4, 9)], ["Bob", "Cyd"]),
        ([f("lte", "customers.customer_id", 1)], ["Ann"]),
        ([{"operator": "or", "filters": [f("lte", "customers.customer_id", 1), {"operator": "and", "filters": [f("set", "customers.country"), f("gt", "customers.customer_id", 2)]}]}], ["Ann", "Cyd"]),
    ],
)
def test_filters_of_dimensions(shop, filters, want):
    assert names(shop, *filters) == want


def test_filters_by_date(shop):
    ids = lambda op, value: [r[0] for r in rows_of(shop, ["invoices.invoice_id"], filters=[{"operator": op, "member": "invoices.made", "value": value}])]
    year = {"startDate": "2021-01-01", "endDate": "2022-12-31"}
    assert ids("inDateRange", year) == [10, 11]  # the last day is its midnight
    assert ids("notInDateRange", year) == [12, 14]
    assert ids("beforeDate", "2021-01-01") == [14] and ids("afterDate", date(2021, 1, 1)) == [11, 12]
    assert ids("inDateRange", "2021") == [10, 11] and ids("afterDate", "tomorrow") == []


def test_sub_queries_and_their_nulls(shop):
    by = lambda op, query: names(shop, {"operator": op, "member": "customers.customer_id", "value": query})
    buyers = {"members": ["invoices.customer_id"]}
    assert by("inQuery", buyers) == ["Ann", "Bob"] and by("notInQuery", buyers) == ["Cyd", "dan%"]
    assert by("inQuery", {"members": ["invoices.customer_id"], "filters": [f("gt", "invoices.total", 7)]}) == ["Ann"]
    with_null = {"members": ["invoices.customer_id"], "filters": [{"operator": "or", "filters": [f("set", "customers.name"), f("notSet", "customers.name")]}]}
    assert by("notInQuery", with_null) == []  # customers without invoices bring a null
    assert by("inQuery", {"members": ["invoices.customer_id"], "order": [{"member": "invoices.customer_id", "direction": "desc"}], "limit": 2}) == ["Bob"]


def test_order_limit_and_count(shop):
    by_total = [{"member": "invoices.total", "direction": "desc"}, {"member": "customers.name", "direction": "desc"}]
    members = ["customers.name", "invoices.total"]
    assert [r[0] for r in rows_of(shop, members, order=by_total)] == ["Ann", "Bob", "dan%", "Cyd"]
    assert rows_of(shop, members, order=by_total, offset=1, limit=2) == [("Bob", 7), ("dan%", None)]
    assert len(rows_of(shop, members, limit=0, offset=0)) == 4
    assert rows_of(shop, members)[0] == ("Ann", 12)  # the first metric, greatest first
    assert rows_of(shop, ["customers.name", "customers.country"], order=[{"member": "invoices.total", "direction": "desc"}])[0][0] == "Ann"  # not shown: no order
    assert [r[0] for r in rows_of(shop, ["invoices.made.year", "invoices.count"])] == [None, 2020, 2021, 2022]
    count = shop.build_count_query({"members": members, "limit": 1, "offset": 2, "order": by_total, "filters": [f("notSet", "invoices.total")]})
    assert count.columns == ["count"] and count.collect()[0][0] == 2


def test_dimensions_first_and_repeated_members_once(shop):
    df = shop.build_query({"members": ["invoices.total", "customers.name", "lines.count", "customers.name"]})
    assert df.columns == ["customers___name", "invoices___total", "lines___count"]


def test_members_across_models(shop):
    assert rows_of(shop, ["invoices.buyer"], filters=[f("set", "invoices.buyer")]) == [("Ann/10",), ("Ann/11",), ("Bob/12",), ("Bob/13",)]
    assert rows_of(shop, ["shop.per_line"]) == [(20 / 6,)]
    assert dict(rows_of(shop, ["customers.name", "shop.per_line"], filters=[f("in", "customers.name", "Ann", "Bob")])) == {"Ann": 3.0, "Bob": 7.0}


def test_granularities_of_one_moment(spark):
    at = datetime(2009, 1, 19, 7, 8, 9)
    m = frame(spark, "x", "d date, t timestamp_ntz, clock string", [(at.date(), at, "07:08:09"), (date(2021, 1, 1), datetime(2021, 1, 1), None)])
    m.with_dimension("t", "datetime").with_dimension("d", "date").with_dimension("clock", "time").with_dimension("raw", "datetime", lambda m: m.column("t"), omit_granularity=True)
    b = repository().with_model(m).build(spark)
    parts = "year quarter quarter_of_year month month_num week week_num date day_of_month time hour hour_of_day minute".split()
    assert [d.name for d in m.dimensions.values() if d.parent == "t"] == [f"t.{p}" for p in parts]
    got = rows_of(b, [f"x.t.{p}" for p in parts])
    assert got[0] == (2009, "2009-Q1", 1, "2009-01", 1, "2009-W04", 4, date(2009, 1, 19), 19, "07:08:09", "2009-01-19 07", 7, "2009-01-19 07:08")
    assert got[1][5:7] == ("2021-W53", 53)  # the calendar's year, the ISO week
    assert rows_of(b, ["x.d.quarter", "x.d.day_of_month", "x.clock.hour", "x.clock.minute"]) == [("2009-Q1", 19, "07", "07:08"), ("2021-Q1", 1, None, None)]
    assert "x.raw.year" not in b.schema.members


def test_one_table_in_two_roles(spark):
    u = frame(spark, "user", "id int, name string, born timestamp_ntz", [(1, "a", datetime(2000, 1, 1)), (2, "b", datetime(2001, 1, 1))])
    u.with_dimension("user_id", "number", lambda m: m.column("id"), primary_key=True).with_dimension("name", "string").with_dimension("born", "datetime")
    i = frame(spark, "invoice", "id int, buyer int, seller int", [(1, 1, 2), (2, 2, 2)]).with_dimension("id", "number", primary_key=True)
    i.with_metric("count", "number", lambda m: F.count(m.column("id")))
    r = repository().with_model(u.clone("buyer")).with_model(u.clone("seller")).with_model(i)
    r.join_many_to_one("invoice", "buyer", lambda m: m["invoice"].column("buyer") == m["buyer"].dimension("user_id"))
    r.join_many_to_one("invoice", "seller", lambda m: m["invoice"].column("seller") == m["seller"].dimension("user_id"))
    b = r.build(spark)
    assert rows_of(b, ["buyer.name", "buyer.born.year", "seller.name", "seller.born.year", "invoice.count"]) == [("a", 2000, "b", 2001, 1), ("b", 2001, "b", 2001, 1)]
    assert b.repository.dimension("buyer.born.year").granularity == "year"
    assert b.hierarchy("buyer.born").elements[0].dimensions == ("buyer.born.year",)


def test_context_reaches_every_callback(spark):
    seen = []
    m = model("x").from_dataframe(lambda s, ctx: s.range(ctx["n"]).withColumnRenamed("id", "k")).with_dimension("k", "number", lambda m: m.column("k") + m.context["add"], primary_key=True)
    m.with_metric("sum", "number", lambda m: F.sum(m.column("k") * m.context["add"]))
    y = model("y").from_dataframe(lambda s, ctx: s.createDataFrame([(0,)], "k long")).with_dimension("k", "number")
    r = repository().with_model(m).with_model(y).join_one_to_one("x", "y", lambda j: seen.append(j.context) or (j["x"].column("k") == j["y"].column("k")))
    b = r.build(spark)
    context = {"n": 4, "add": 10}
    assert rows_of(b, ["x.sum"], context) == [(60,)]
    assert rows_of(b, ["x.k"], context, filters=[{"operator": "inQuery", "member": "x.k", "value": {"members": ["x.k"], "filters": [f("gt", "x.k", 11)]}}]) == [(12,), (13,)]
    assert rows_of(b, ["y.k", "x.sum"], context) and seen == [context]


def test_sources(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, None)], "id int, v string").createOrReplaceTempView("plain_table")
    spark.table("plain_table").write.parquet(f"{tmp_path}/p")
    spark.table("plain_table").write.option("header", True).csv(f"{tmp_path}/c")
    count = lambda m: rows_of(repository().with_model(m.with_metric("count", "number", lambda r: F.count(r.column("id")))).build(spark), [f"{m.name}.count"], {"table": "plain_table"})
    assert count(model("plain_table")) == [(2,)]
    assert count(model("x").from_table("plain_table")) == count(model("x").from_table(lambda ctx: ctx["table"])) == [(2,)]
    spark.sql("create table default.named (id int) using parquet")
    try:
        assert count(model("x").from_table("default.named")) == [(0,)]
    finally:
        spark.sql("drop table default.named")
    assert count(model("x").from_files(f"{tmp_path}/p")) == count(model("x").from_files(f"{tmp_path}/c", "csv", schema="id int, v string", header=True)) == [(2,)]
    assert count(model("x").from_sql("select * from plain_table where v = :v", v="a")) == [(1,)]
    stream = spark.readStream.schema("id int, v string").parquet(f"{tmp_path}/p")
    with pytest.raises(ValueError, match="reads a stream"):
        count(model("x").from_dataframe(stream))


def test_sql_text_in_callbacks(spark):
    m = frame(spark, "x", "a int, `odd name` string", [(1, "it's"), (2, "b\\c"), (3, None)])
    m.with_dimension("a", "number", primary_key=True).with_dimension("b", "string", lambda r: r.sql("coalesce({}, {})", r.column("odd name"), "it's \\ none"))
    m.with_metric("n", "number", lambda r: r.sql("sum({} * {}) filter (where {} > {})", r.column("a"), 10, r.column("a"), 1))
    b = repository().with_model(m).build(spark)
    assert rows_of(b, ["x.b", "x.n"]) == [("it's \\ none", 30), ("b\\c", 20), ("it's", None)]
    m.with_dimension("c", "string", lambda r: r.sql("{} || '-' || {}", r.dimension("b"), r.sql("upper({}) || {}", r.column("odd name"), "{2}")))
    m.with_dimension("d", "string", lambda r: r.sql("regexp_replace({}, '[a-z]{2}', {})", F.concat(r.dimension("b"), F.lit("!")), "_"))
    values = [datetime(2020, 1, 2, 3, 4, 5), date(2020, 1, 2), 1.5, Decimal("2.50"), b"\x01", 1 << 40, True, None, "a'b\\"]
    m.with_dimension("e", "string", lambda r: r.sql("to_json(struct(" + ", ".join(["{}"] * len(values)) + "))", *values))
    m.with_metric("p", "number", lambda r: r.sql("{} + {}", r.sql("sum({})", r.column("a")), r.sql("max({})", r.dimension("a"))))
    m.with_metric("q", "number", lambda r: r.sql("sum({})", r.column("a") * 2))
    m.with_metric("r", "number", lambda r: r.sql("sum({})"))
    b = repository().with_model(m).build(spark)
    assert rows_of(b, ["x.c"], filters=[{"operator": "set", "member": "x.c"}]) == [("b\\c-B\\C{2}",), ("it's-IT'S{2}",)]
    assert rows_of(b, ["x.d", "x.p"]) == [("it's \\ none!".replace("it", "_").replace("no", "_").replace("ne", "_"), 6), ("b\\c!", 4), ("_'s!", 2)]
    assert [r[0] for r in rows_of(b, ["x.e"])] == ['{"col1":"2020-01-02T03:04:05.000","col2":"2020-01-02","col3":1.5,"col4":2.50,"col5":"AQ==","col6":1099511627776,"col7":true,"col9":"a\'b\\\\"}']
    for metric, message in (("q", "references"), ("r", "places")):
        with pytest.raises(ValueError, match=message):
            rows_of(b, [f"x.{metric}"])


def test_empty_order_is_no_order(shop):
    plan = lambda **q: shop.build_query({"members": ["customers.country", "customers.count"], **q})._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" in plan() and "Sort" not in plan(order=[])


def test_introspection_and_formats(shop):
    u = model("user").with_dimension("user_id", "number", primary_key=True, description="who").with_dimension("at", "datetime", format=lambda v: f"DateTime: {v:%Y}").with_dimension("share", "number", format="percentage")
    u.with_metric("price", "number", lambda m: F.sum(m.column("p")), format="currency").with_metric("n", "number", lambda m: F.count(m.column("user_id")), private=True)
    b = repository().with_model(u).build(shop.spark)
    known = b.introspect({"members": ["user.user_id", "user.at", "user.at.year", "user.share", "user.price", "user.n"]})
    assert known["user___user_id"] == {"memberType": "dimension", "path": "user.user_id", "alias": "user___user_id", "format": None, "type": "number", "description": "who", "isPrimaryKey": True, "isGranularity": False, "isPrivate": False}
    assert known["user___at___year"]["isGranularity"] and known["user___n"]["isPrivate"] and known["user___price"]["memberType"] == "metric"
    got = format_results([{"user___user_id": 1, "user___at": datetime(2020, 1, 1), "user___at___year": 2020, "user___share": 10, "user___price": 9.5}], known)
    assert got == [{
        "user___user_id": {"value": 1}, "user___at": {"value": datetime(2020, 1, 1), "formattedValue": "DateTime: 2020"}, "user___at___year": {"value": 2020, "formattedValue": "2020"},
        "user___share": {"value": 10, "formattedValue": "10%"}, "user___price": {"value": 9.5, "formattedValue": "$9.5"}, "user___n": {"value": None},
    }]


def test_plans_push_filters_and_prune_columns(spark, tmp_path):
    spark.createDataFrame([(1, 2, "a", datetime(2020, 1, 1))], "id long, v long, s string, t timestamp_ntz").write.parquet(f"{tmp_path}/t")
    m = model("x").from_files(f"{tmp_path}/t").with_dimension("id", "number", primary_key=True).with_dimension("s", "string").with_dimension("t", "datetime")
    m.with_metric("v", "number", lambda r: F.sum(r.column("v")))
    b = repository().with_model(m).build(spark)
    df = b.build_query({"members": ["x.s", "x.v"], "filters": [{"operator": "afterDate", "member": "x.t", "value": "2019-01-01"}, f("gt", "x.id", 0)]})
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(t,2019-01-01T00:00)" in text and "GreaterThan(id,0)" in text
    assert text.count("Exchange hashpartitioning") == 1
    plain = b.build_query({"members": ["x.s", "x.v"]})._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<v:bigint,s:string>" in plain


def test_large_side_of_a_right_join_is_not_shuffled_by_the_small_side_s_key(spark, tmp_path):
    spark.range(20_000).selectExpr("id", "id % 7 as nation", "uuid() as pad").write.parquet(f"{tmp_path}/fact")
    spark.createDataFrame([(k, f"n{k}") for k in (*range(6), 99, None)], "nation long, name string").write.parquet(f"{tmp_path}/nation")
    fact = model("fact").from_files(f"{tmp_path}/fact").with_dimension("id", "number", primary_key=True).with_dimension("nation", "number").with_metric("n", "number", lambda m: F.count(m.column("id")))
    n = model("nation").from_files(f"{tmp_path}/nation").with_dimension("nation", "number", primary_key=True).with_dimension("name", "string")
    b = repository().with_model(n).with_model(fact).join_one_to_many("nation", "fact", equal("nation", "fact", "nation")).build(spark)
    query = {"members": ["nation.name", "fact.n"], "order": [{"member": "nation.name", "direction": "asc"}]}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        df = b.build_query(query)
        got = [tuple(r) for r in df.collect()]
        text = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == [tuple(r) for r in b.build_query(query).collect()]
    assert dict(got) == {**{f"n{k}": len(range(k, 20_000, 7)) for k in range(6)}, "n99": 0, "nNone": 0}
    assert "BroadcastHashJoin" in text and "RightOuter" not in text


def test_conditions_that_are_only_equalities(spark):
    from metricloom.operators.lowering import equal_columns

    a, b, c = F.col("`x`.`a`"), F.col("`y`.`b`"), F.col("`x`.`c`")
    assert equal_columns(b == a, "x", "y") == [("`x`.`a`", "`y`.`b`")]
    assert equal_columns((a == b) & (b == c) & (a == b), "x", "y") == [("`x`.`a`", "`y`.`b`"), ("`x`.`c`", "`y`.`b`"), ("`x`.`a`", "`y`.`b`")]
    for other in (a == c, a > b, (a == b) | (c == b), F.coalesce(a, F.lit(0)) == b, a.eqNullSafe(b), (a == b) & (c > 1)):
        assert equal_columns(other, "x", "y") is None

"""Queries for what is no plain query over the star schema: namespaced and odd names, functions in callbacks, SQL
templates, and the metadata of a repository as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf

from metricloom.catalogue import models
from metricloom.functions.formatting import format_results
from metricloom.hierarchy import element
from metricloom.model import model
from metricloom.repository import Repository, repository

Query = Callable[[SparkSession, str], DataFrame]
SURFACE: dict[str, tuple[Query, str]] = {}


def _query(name: str, make: Callable[[SparkSession, str], Repository], members: list[str], sql: str, **query) -> None:
    SURFACE[name] = (lambda spark, sf_dir: make(spark, sf_dir).build(spark).build_query({"members": members, **query}), sql)


def _table(name: str, schema: str, rows: Callable[[SparkSession, str], Iterable[tuple]], sql: str) -> None:
    """A table of what is known without reading data, or of formatted rows of a small result."""
    SURFACE[name] = (lambda spark, sf_dir: spark.createDataFrame(list(rows(spark, sf_dir)), schema), sql)


def _orders(sf_dir: str):
    return model("orders").from_files(f"{sf_dir}/orders.parquet")


# names


def _namespaced(spark: SparkSession, sf_dir: str) -> Repository:
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceGlobalTempView("metricloom_orders")
    m = model("orders").from_table("global_temp.metricloom_orders").with_dimension("orderstatus", "string", lambda m: m.column("o_orderstatus"))
    m.with_dimension("orderkey", "number", lambda m: m.column("o_orderkey"), primary_key=True)
    return repository().with_model(m.with_metric("count", "number", lambda m: F.count(m.column("o_orderkey"))))


def _odd_names(spark: SparkSession, sf_dir: str) -> Repository:
    m = model("orders").from_sql(f"select o_orderkey as `order key`, o_orderstatus as `the ``status```, o_custkey as `select` from parquet.`{sf_dir}/orders.parquet`")
    m.with_dimension("key", "number", lambda m: m.column("order key"), primary_key=True).with_dimension("status", "string", lambda m: m.column("the `status`"))
    return repository().with_model(m.with_metric("customers", "number", lambda m: F.count_distinct(m.column("select"))))


def _identifiers(spark: SparkSession, sf_dir: str) -> Repository:
    m = _orders(sf_dir).with_dimension("status", "string", lambda m: m.identifier("orders", "o_orderstatus"))
    m.with_dimension("orderkey", "number", lambda m: m.sql("{}", m.identifier("o_orderkey")), primary_key=True)
    return repository().with_model(m.with_metric("count", "number", lambda m: F.count(m.column("o_orderkey"))))


_BY_STATUS = "select o_orderstatus as orders___{}, {} as orders___{} from orders group by 1"
_query("namespaced_table", _namespaced, ["orders.orderstatus", "orders.count"], _BY_STATUS.format("orderstatus", "count(*)", "count"))
_query("quoted_identifiers", _odd_names, ["orders.status", "orders.customers"], _BY_STATUS.format("status", "count(distinct o_custkey)", "customers"))
_query("identifier_ref", _identifiers, ["orders.status", "orders.count"], _BY_STATUS.format("status", "count(*)", "count"))

# SQL templates


def _templates(spark: SparkSession, sf_dir: str) -> Repository:
    m = model("customer").from_files(f"{sf_dir}/customer.parquet").with_dimension("custkey", "number", lambda m: m.column("c_custkey"), primary_key=True)
    m.with_dimension("name", "string", lambda m: m.column("c_name")).with_dimension("segment", "string", lambda m: F.lower(m.column("c_mktsegment")))
    m.with_dimension("full_name", "string", lambda m: m.sql("{} || ' ' || {}", m.dimension("name"), m.dimension("segment")))
    m.with_dimension("short", "string", lambda m: m.sql("regexp_replace({}, '[0-9]{4}$', {})", m.sql("upper({})", m.dimension("name")), "it's"))
    m.with_metric("share", "number", lambda m: m.sql("round({} / {}, 6)", m.sql("sum(case when {} > {} then 1.0D else 0.0D end)", m.column("c_acctbal"), 500.5), m.sql("count({})", m.dimension("custkey"))))
    return repository().with_model(m)


_query("sql_template_nested", _templates, ["customer.full_name", "customer.short"], "select distinct c_name || ' ' || lower(c_mktsegment) as customer___full_name, regexp_replace(upper(c_name), '[0-9]{4}$', 'it''s') as customer___short from customer")
_query("sql_template_aggregate", _templates, ["customer.segment", "customer.share"], "select lower(c_mktsegment) as customer___segment, round(sum(case when c_acctbal > 500.5 then 1.0 else 0.0 end)::double / count(*), 6) as customer___share from customer group by 1")


def _literals(spark: SparkSession, sf_dir: str) -> Repository:
    m = _orders(sf_dir).with_dimension("orderkey", "number", lambda m: m.column("o_orderkey"), primary_key=True)
    m.with_dimension("late", "boolean", lambda m: m.sql("{} >= {} and {} <> {}", m.column("o_orderdate"), date(1998, 1, 1), m.column("o_orderstatus"), "F"))
    return repository().with_model(m.with_metric("count", "number", lambda m: F.count(m.column("o_orderkey"))))


_query("sql_template_literals", _literals, ["orders.late", "orders.count"], "select o_orderdate >= date '1998-01-01' and o_orderstatus <> 'F' as orders___late, count(*) as orders___count from orders group by 1")

# functions in callbacks: of a value, of a group, of a table


def _functions(spark: SparkSession, sf_dir: str) -> Repository:
    @pandas_udf("string")
    def initial(names: pd.Series) -> pd.Series:
        return names.str[:1] + "."

    @pandas_udf("double")
    def spread(values: pd.Series) -> float:
        return float(values.max() - values.min())

    m = model("customer").from_files(f"{sf_dir}/customer.parquet").with_dimension("custkey", "number", lambda m: m.column("c_custkey"), primary_key=True)
    m.with_dimension("initial", "string", lambda m: initial(m.column("c_mktsegment")))
    m.with_metric("count", "number", lambda m: F.count(m.column("c_custkey")))
    m.with_metric("spread", "number", lambda m: F.round(spread(m.column("c_acctbal")), 2))
    return repository().with_model(m)


def _table_function(spark: SparkSession, sf_dir: str) -> Repository:
    class Numbers:
        def eval(self, low: int, high: int):
            for n in range(low, high + 1):
                yield n, n % 3

    numbers = udtf(Numbers, returnType="n int, rest int")
    m = model("numbers").from_dataframe(lambda spark, ctx: numbers(F.lit(1), F.lit(50))).with_dimension("n", "number", primary_key=True).with_dimension("rest", "number")
    return repository().with_model(m.with_metric("sum", "number", lambda m: F.sum(m.column("n"))))


_query("function_of_a_value", _functions, ["customer.initial", "customer.count"], "select c_mktsegment[1] || '.' as customer___initial, count(*) as customer___count from customer group by 1")
_query("function_of_a_group", _functions, ["customer.spread"], "select round(max(c_acctbal) - min(c_acctbal), 2) as customer___spread from customer")
_query("function_of_a_table", _table_function, ["numbers.rest", "numbers.sum"], "select cast(i % 3 as integer) as numbers___rest, cast(sum(i) as bigint) as numbers___sum from range(1, 51) t(i) group by 1")

# what is known of members, joins and hierarchies


def _calls(spark: SparkSession, sf_dir: str):
    """A dimension that four members refer to is worked out once for a query."""
    calls = []
    m = _orders(sf_dir).with_dimension("orderkey", "number", lambda m: m.column("o_orderkey"), primary_key=True)
    m.with_dimension("price", "number", lambda m: calls.append(1) or m.column("o_totalprice"))
    m.with_dimension("double", "number", lambda m: m.dimension("price") * 2).with_dimension("half", "number", lambda m: m.dimension("price") / 2)
    m.with_metric("sum", "number", lambda m: F.sum(m.dimension("price"))).with_metric("max", "number", lambda m: F.max(m.dimension("half")))
    repository().with_model(m).build(spark).build_query({"members": ["orders.price", "orders.double", "orders.half", "orders.sum", "orders.max"]})
    yield (len(calls),)


def _parts(spark: SparkSession, sf_dir: str):
    m = model("orders").with_dimension("made", "date", omit_granularity=True).with_dimension("sent", "time").with_dimension("id", "number", private=True)
    return ((path,) for path in repository().with_model(m).build(spark).schema.members)


def _known(spark: SparkSession, sf_dir: str):
    found = models.sales(sf_dir).build(spark).introspect({"members": ["orders.orderkey", "orders.orderdate.month", "orders.total", "nation.full_name"]})
    return ((alias, x["memberType"], x["path"], x["type"], x["isPrimaryKey"], x["isGranularity"]) for alias, x in found.items())


def _joins(spark: SparkSession, sf_dir: str):
    r = models.sales(sf_dir)
    return ((left, right, r.find_join(left, right).cardinality) for left in r.models for right in r.models if r.find_join(left, right))


def _hierarchy_levels(spark: SparkSession, sf_dir: str):
    m = model("orders").with_dimension("id", "number", primary_key=True).with_dimension("made", "date")
    m.with_categorical_hierarchy("order", element("status").with_dimensions("id", "made").with_key("id"), element.from_dimension("made"))
    b = repository().with_model(m).with_temporal_hierarchy("months", element.from_dimension("orders.made.month")).build(spark)
    return ((k, h.name, h.type, n, e.name, ",".join(e.dimensions), ",".join(e.key_dimensions)) for k, h in enumerate(b.hierarchies) for n, e in enumerate(h.elements))


def _values(columns: str, *rows: tuple) -> str:
    told = lambda v: str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'"
    return f"select * from (values {', '.join('(' + ', '.join(map(told, r)) + ')' for r in rows)}) as t({columns})"


_table("member_worked_out_once", "calls int", _calls, "select 1 as calls")
_table("granularity_left_out", "path string", _parts, _values("path", ("orders.made",), ("orders.sent",), ("orders.sent.hour",), ("orders.sent.minute",)))
_table(
    "introspection",
    "alias string, kind string, path string, type string, primary_key boolean, granularity boolean",
    _known,
    _values(
        "alias, kind, path, type, primary_key, granularity",
        ("orders___orderkey", "dimension", "orders.orderkey", "number", True, False),
        ("orders___orderdate___month", "dimension", "orders.orderdate.month", "string", False, True),
        ("orders___total", "metric", "orders.total", "number", False, False),
        ("nation___full_name", "dimension", "nation.full_name", "string", False, False),
    ),
)
_ONE_TO_MANY = [("region", "nation"), ("nation", "customer"), ("customer", "orders"), ("orders", "lineitem"), ("part", "lineitem"), ("supplier", "lineitem"), ("customer", "events")]
_table("catalog_of_joins", "one string, other string, type string", _joins, _values("one, other, type", *((a, b, "one_to_many") for a, b in _ONE_TO_MANY), *((b, a, "many_to_one") for a, b in _ONE_TO_MANY)))
_table(
    "hierarchies_in_order",
    "place int, name string, type string, level int, element string, dimensions string, keys string",
    _hierarchy_levels,
    _values(
        "place, name, type, level, element, dimensions, keys",
        (0, "orders.order", "categorical", 0, "status", "orders.id,orders.made", "orders.id"),
        (0, "orders.order", "categorical", 1, "made", "orders.made", "orders.made"),
        *((1, "orders.made", "temporal", k, x, f"orders.{x}", f"orders.{x}") for k, x in enumerate(("made.year", "made.quarter", "made.month", "made.week", "made"))),
        (2, "months", "temporal", 0, "orders.made.month", "orders.made.month", "orders.made.month"),
    ),
)

# rows for people


def _formatted(spark: SparkSession, sf_dir: str):
    m = model("events").from_files(f"{sf_dir}/events.parquet").with_dimension("event_id", "number", primary_key=True).with_dimension("event_type", "string", format=lambda v: v.upper())
    m.with_metric("count", "number", lambda m: F.count(m.column("event_id")), format="currency").with_metric("users", "number", lambda m: F.count_distinct(m.column("user_id")), format="percentage")
    builder, query = repository().with_model(m).build(spark), {"members": ["events.event_type", "events.count", "events.users"]}
    shown = format_results(builder.build_query(query).collect(), builder.introspect(query))  # one row an event type
    return (tuple(r[c]["formattedValue"] for c in ("events___event_type", "events___count", "events___users")) for r in shown)


def _levels_for_people(spark: SparkSession, sf_dir: str):
    m = models.region(sf_dir).with_categorical_hierarchy("where", element("region").with_dimensions("regionkey", "name").with_format(["name"], lambda d: f"{d('name').value} ({d('regionkey').value})"), element("both").with_dimensions("regionkey", "name"))
    builder = repository().with_model(m).build(spark)
    rows = [r.asDict() for r in builder.build_query({"members": ["region.regionkey", "region.name"]}).collect()]  # five rows
    return (tuple(e.formatter(r) for e in builder.hierarchy("region.where").elements) for r in rows)


_table("formatted_results", "type string, count string, users string", _formatted, "select upper(event_type) as type, '$' || count(*) as count, count(distinct user_id) || '%' as users from events group by event_type")
_table("hierarchy_formatter", "region string, both_shown string", _levels_for_people, "select r_name || ' (' || r_regionkey || ')' as region, r_regionkey || ', ' || r_name as both_shown from region")

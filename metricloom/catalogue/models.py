"""Repositories over the star schema's tables (region nation customer supplier part orders lineitem events,
and documents with labels), all read from Parquet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metricloom.hierarchy import element
from metricloom.model import Model, model
from metricloom.operators.filters import Filter, default_filters, numbers
from metricloom.repository import Repository, repository


def money(x: Column) -> Column:
    """Sums of cents are exact whatever the order of rows."""
    return F.sum(x.cast("decimal(18,2)")).cast("double")


def _model(name: str, sf_dir: str, table: str | None = None) -> Model:
    return model(name).from_files(f"{sf_dir}/{table or name}.parquet")


def _columns(m: Model, prefix: str, **types: str) -> Model:
    """Dimensions ``name`` that are the column ``<prefix>_<name>``."""
    for name, kind in types.items():
        m.with_dimension(name, kind, lambda r, c=f"{prefix}_{name}": r.column(c))
    return m


def region(sf_dir: str) -> Model:
    return _columns(_model("region", sf_dir).with_dimension("regionkey", "number", lambda m: m.column("r_regionkey"), primary_key=True), "r", name="string")


def nation(sf_dir: str) -> Model:
    m = _model("nation", sf_dir).with_dimension("nationkey", "number", lambda m: m.column("n_nationkey"), primary_key=True)
    return _columns(m, "n", name="string", regionkey="number")


def customer(sf_dir: str) -> Model:
    m = _model("customer", sf_dir).with_dimension("custkey", "number", lambda m: m.column("c_custkey"), primary_key=True)
    _columns(m, "c", name="string", nationkey="number", mktsegment="string", acctbal="number")
    m.with_metric("count", "number", lambda m: F.count(m.column("c_custkey")))
    m.with_metric("balance", "number", lambda m: money(m.column("c_acctbal")), format="currency")
    return m.with_metric("least_balance", "number", lambda m: F.min(m.column("c_acctbal")), ignores_duplicates=True)


def supplier(sf_dir: str) -> Model:
    m = _model("supplier", sf_dir).with_dimension("suppkey", "number", lambda m: m.column("s_suppkey"), primary_key=True)
    _columns(m, "s", name="string", nationkey="number")
    m.with_metric("count", "number", lambda m: F.count(m.column("s_suppkey")))
    return m.with_metric("balance", "number", lambda m: money(m.column("s_acctbal")))


def part(sf_dir: str) -> Model:
    m = _model("part", sf_dir).with_dimension("partkey", "number", lambda m: m.column("p_partkey"), primary_key=True)
    _columns(m, "p", name="string", brand="string", type="string", size="number")
    return m.with_metric("count", "number", lambda m: F.count(m.column("p_partkey")))


def orders(sf_dir: str) -> Model:
    m = _model("orders", sf_dir).with_dimension("orderkey", "number", lambda m: m.column("o_orderkey"), primary_key=True)
    _columns(m, "o", custkey="number", orderstatus="string", orderpriority="string", totalprice="number", orderdate="datetime")
    m.with_metric("count", "number", lambda m: F.count(m.column("o_orderkey")))
    m.with_metric("total", "number", lambda m: money(m.column("o_totalprice")), format="currency")
    m.with_metric("customers", "number", lambda m: F.count_distinct(m.column("o_custkey")), ignores_duplicates=True)
    m.with_metric("largest", "number", lambda m: F.max(m.column("o_totalprice")), ignores_duplicates=True)
    m.with_metric("median_total", "number", lambda m: F.round(m.sql("percentile_cont(0.5) within group (order by {})", m.metric("total")), 4))
    return m.with_metric("count_with_status", "string", lambda m: F.concat(F.count(m.column("o_orderkey")).cast("string"), F.lit(" - "), m.column("o_orderstatus", group_by=True)))


def lineitem(sf_dir: str) -> Model:
    m = _model("lineitem", sf_dir)
    # order and line number repeat in these tables: these six columns together don't
    for name, kind in (("orderkey", "number"), ("linenumber", "number"), ("partkey", "number"), ("suppkey", "number"), ("extendedprice", "number")):
        m.with_dimension(name, kind, lambda r, c=f"l_{name}": r.column(c), primary_key=True)
    m.with_dimension("shipdate", "datetime", lambda r: r.column("l_shipdate"), primary_key=True)
    _columns(m, "l", returnflag="string", linestatus="string")
    m.with_metric("count", "number", lambda m: F.count(m.column("l_orderkey")))
    m.with_metric("quantity", "number", lambda m: money(m.column("l_quantity")))
    m.with_metric("revenue", "number", lambda m: money(m.column("l_extendedprice")))
    return m.with_metric("average_quantity", "number", lambda m: F.round(F.avg(m.column("l_quantity").cast("decimal(18,2)")).cast("double"), 4))


def events(sf_dir: str) -> Model:
    m = _model("events", sf_dir).with_dimension("event_id", "number", primary_key=True)
    m.with_dimension("ts", "datetime").with_dimension("user_id", "number").with_dimension("event_type", "string")
    m.with_dimension("day", "date", lambda m: m.dimension("ts").cast("date"))
    m.with_dimension("clock", "time", lambda m: F.date_format(m.column("ts"), "HH:mm:ss"))
    m.with_metric("count", "number", lambda m: F.count(m.column("event_id")))
    return m.with_metric("users", "number", lambda m: F.count_distinct(m.column("user_id")), ignores_duplicates=True)


def on(left: str, right: str):
    """``on("orders.custkey", "customer.custkey")``: equal dimensions."""
    (a, x), (b, y) = left.split("."), right.split(".")
    return lambda m: m[a].dimension(x) == m[b].dimension(y)


def sales(sf_dir: str) -> Repository:
    """region 1:N nation 1:N customer 1:N orders 1:N lineitem N:1 part and supplier; customer 1:N events."""
    r = repository()
    for make in (region, nation, customer, orders, lineitem, part, supplier, events):
        r.with_model(make(sf_dir))
    r.join_one_to_many("region", "nation", on("region.regionkey", "nation.regionkey"))
    r.join_one_to_many("nation", "customer", on("nation.nationkey", "customer.nationkey"))
    r.join_one_to_many("customer", "orders", on("customer.custkey", "orders.custkey"))
    r.join_one_to_many("orders", "lineitem", on("orders.orderkey", "lineitem.orderkey"))
    r.join_many_to_one("lineitem", "part", on("lineitem.partkey", "part.partkey"))
    r.join_many_to_one("lineitem", "supplier", on("lineitem.suppkey", "supplier.suppkey"))
    r.join_one_to_many("customer", "events", on("customer.custkey", "events.user_id"))
    r.with_calculated_dimension("nation.full_name", "string", lambda m: F.concat(m["region"].dimension("name"), F.lit(": "), m["nation"].dimension("name")))
    r.with_calculated_metric("sales.revenue_per_total", "number", lambda m: m["lineitem"].metric("revenue", aggregated=True) / m["orders"].metric("total", aggregated=True))
    geography = [element("region").with_dimensions("region.regionkey", "region.name").with_key("region.regionkey").with_format(["region.name"])]
    geography.append(element("nation").with_dimensions("nation.nationkey", "nation.name").with_key("nation.nationkey").with_format(["nation.name"]))
    return r.with_categorical_hierarchy("geography", *geography)


def with_roles(sf_dir: str) -> Repository:
    """lineitem with the nation of the customer and that of the supplier: one table in two roles."""
    r = repository()
    n = nation(sf_dir)
    for m in (customer(sf_dir), orders(sf_dir), lineitem(sf_dir), supplier(sf_dir), n, n.clone("supplier_nation")):
        r.with_model(m)
    r.join_one_to_many("nation", "customer", on("nation.nationkey", "customer.nationkey"))
    r.join_one_to_many("customer", "orders", on("customer.custkey", "orders.custkey"))
    r.join_one_to_many("orders", "lineitem", on("orders.orderkey", "lineitem.orderkey"))
    r.join_many_to_one("lineitem", "supplier", on("lineitem.suppkey", "supplier.suppkey"))
    return r.join_many_to_one("supplier", "supplier_nation", on("supplier.nationkey", "supplier_nation.nationkey"))


def trade(sf_dir: str, how: str | None = None, priority: str = "normal") -> Repository:
    """Suppliers and customers of one nation meet many to many; the way through the nation is longer."""
    r = repository().with_model(nation(sf_dir)).with_model(customer(sf_dir)).with_model(supplier(sf_dir))
    r.join_one_to_many("nation", "customer", on("nation.nationkey", "customer.nationkey"))
    r.join_one_to_many("nation", "supplier", on("nation.nationkey", "supplier.nationkey"))
    return r.join_many_to_many("customer", "supplier", on("customer.nationkey", "supplier.nationkey"), how=how, priority=priority)


def large_orders(sf_dir: str, how: str | None = None, least: float = 300000.0) -> Repository:
    """Customers and those of their orders that are large: the condition is not only equality."""
    r = repository().with_model(customer(sf_dir)).with_model(orders(sf_dir))
    condition = lambda m: (m["customer"].dimension("custkey") == m["orders"].dimension("custkey")) & (m["orders"].column("o_totalprice") > least)
    return r.join_one_to_many("customer", "orders", condition, how=how)


def labelled(sf_dir: str) -> Repository:
    """Documents and their labels, one to one, labels missing for most."""
    d = _model("documents", sf_dir).with_dimension("doc_id", "number", primary_key=True).with_dimension("lang", "string")
    d.with_metric("count", "number", lambda m: F.count(m.column("doc_id")))
    x = _model("labels", sf_dir).with_dimension("doc_id", "number", primary_key=True).with_dimension("toxic", "number")
    x.with_metric("count", "number", lambda m: F.count(m.column("doc_id")))
    return repository().with_model(d).with_model(x).join_one_to_one("documents", "labels", on("documents.doc_id", "labels.doc_id"))


def with_divisible(r: Repository) -> Repository:
    """The filters that there are, and one of our own."""
    divisible = Filter("divisibleBy", "The member is divisible by all values.", numbers, lambda _, m, values: (m % values[0] == 0) if len(values) == 1 else F.greatest(*(m % v for v in values)) == 0)
    return r.with_filters(default_filters().register(divisible))


def by_context(sf_dir: str) -> Repository:
    """Source, dimension and join look at the query's context."""
    o = model("orders").from_sql(lambda ctx: (f"select * from parquet.`{sf_dir}/orders.parquet` where o_orderstatus = :status", {"status": ctx["status"]}))
    o.with_dimension("orderkey", "number", lambda m: m.column("o_orderkey"), primary_key=True)
    o.with_dimension("size", "string", lambda m: F.when(m.column("o_totalprice") >= m.context["large"], "large").otherwise("small"))
    o.with_dimension("custkey", "number", lambda m: m.column("o_custkey"), private=True)
    o.with_metric("count", "number", lambda m: F.count(m.column("o_orderkey")))
    r = repository().with_model(o).with_model(customer(sf_dir))
    return r.join_many_to_one("orders", "customer", lambda m: (m["orders"].dimension("custkey") == m["customer"].dimension("custkey")) & (m["customer"].column("c_mktsegment") == m.context["segment"]), how="inner")


def from_sql(sf_dir: str) -> Repository:
    """Models over queries; one of them in the shape of a union."""
    c = model("customer").from_sql(f"select c_custkey, c_mktsegment from parquet.`{sf_dir}/customer.parquet`")
    c.with_dimension("c_custkey", "number", primary_key=True).with_dimension("c_mktsegment", "string")
    sums = f"select o_custkey as key, o_totalprice as price, 'early' as era from parquet.`{sf_dir}/orders.parquet` where o_orderdate < timestamp_ntz'1998-01-01'"
    sums += f" union all select o_custkey, o_totalprice, 'late' from parquet.`{sf_dir}/orders.parquet` where o_orderdate >= timestamp_ntz'1998-01-01'"
    s = model("spending").from_sql(sums).with_dimension("key", "number").with_dimension("era", "string")
    s.with_metric("sum", "number", lambda m: money(m.column("price")), private=True)
    r = repository().with_model(c).with_model(s).join_one_to_many("customer", "spending", lambda m: m["customer"].column("c_custkey") == m["spending"].column("key"))
    return r.with_calculated_metric("spending.thousands", "number", lambda m: F.round(m["spending"].metric("sum", aggregated=True) / 1000, 3))

# The members, messages and plans that these tests expect are fixed values.

import pytest
from pyspark.sql import functions as F

from metricloom import model, repository
from metricloom.plans.joins import JoinPlan, JoinStep
from tests import music


def plan_of(spark, r, members, **query):
    return r.build(spark).plan({"members": members, **query})


def steps(*triples):
    return tuple(JoinStep(*t) for t in triples)


def test_plan_with_three_segments(spark):
    f = lambda op, member, *v: {"operator": op, "member": member, "value": list(v)}
    plan = plan_of(
        spark,
        music.store(),
        ["artists.name", "tracks.name", "albums.title", "tracks.unit_price", "invoice_lines.quantity"],
        filters=[f("equals", "genres.name", "Rock"), f("gt", "invoice_lines.unit_price", 0), f("gt", "invoice_lines.quantity", 0), f("gt", "tracks.unit_price", 0), f("gt", "invoices.total", 100)],
        order=[{"member": "artists.name", "direction": "asc"}],
    )
    dims = ("artists.name", "tracks.name", "albums.title")
    tracks, lines, invoices = plan.segments
    assert (tracks.alias, lines.alias, invoices.alias) == ("s0", "s1", "s2")
    assert tracks.models == ("artists", "tracks", "albums", "genres")
    assert tracks.model_query.members == (*dims, "genres.name", "tracks.track_id", "tracks.unit_price")
    assert tracks.segment_query.members == tracks.root_query.members == (*dims, "tracks.unit_price")
    beyond = (("tracks", "albums", "right"), ("albums", "artists", "left"), ("tracks", "genres", "left"))
    assert tracks.join_plan == JoinPlan("tracks", steps(*beyond), False)
    assert lines.models == ("artists", "tracks", "albums", "genres", "invoice_lines")
    assert lines.model_query.members == (*dims, "genres.name", "invoice_lines.invoice_line_id", "invoice_lines.quantity", "invoice_lines.unit_price")
    assert lines.segment_query.metrics == ("invoice_lines.quantity", "invoice_lines.unit_price")
    assert lines.root_query.metrics == ("invoice_lines.quantity",)
    assert lines.join_plan == JoinPlan("invoice_lines", steps(("invoice_lines", "tracks", "left"), *beyond), False)
    assert invoices.models == ("artists", "tracks", "albums", "genres", "invoices")
    assert invoices.root_query.members == dims and invoices.segment_query.metrics == ("invoices.total",)
    assert invoices.join_plan == JoinPlan("invoices", steps(("invoices", "invoice_lines", "left"), ("invoice_lines", "tracks", "left"), *beyond), True)
    assert [f["member"] for s in plan.segments for f in s.filters] == ["genres.name"] * 3
    assert [f["member"] for f in plan.filters] == ["invoice_lines.unit_price", "invoice_lines.quantity", "tracks.unit_price", "invoices.total"]
    assert plan.projected_dimensions == dims and plan.projected_metrics == ("tracks.unit_price", "invoice_lines.quantity")
    assert plan.order == ({"member": "artists.name", "direction": "asc"},) and plan.limit is None
    assert all(s.metric_refs is None for s in plan.segments)


def diamond(priority="normal", ab=None, bd=None):
    r = repository()
    for name, keys in (("a", "a"), ("b", "ba"), ("c", "ca"), ("d", "dbc")):
        m = model(name)
        for k in keys:
            m.with_dimension(f"{k}_id", "number", primary_key=k == name)
        r.with_model(m)
    r.join_one_to_one("a", "b", music.equal("a", "b", "a_id"), how=ab)
    r.join_one_to_many("a", "c", music.equal("a", "c", "a_id"))
    r.join_one_to_one("b", "d", music.equal("b", "d", "b_id"), how=bd)
    return r.join_one_to_many("c", "d", music.equal("c", "d", "c_id"), priority=priority)


ABCD = ["a.a_id", "b.b_id", "c.c_id", "d.d_id"]


def test_joins_of_a_diamond(spark):
    join = lambda r, members: plan_of(spark, r, members).segments[0].join_plan
    assert join(diamond(), ABCD) == JoinPlan("a", steps(("a", "c", "left"), ("a", "b", "left"), ("b", "d", "left")), True)
    assert join(diamond("high"), ABCD) == JoinPlan("a", steps(("a", "b", "left"), ("b", "d", "left"), ("d", "c", "right")), False)
    assert join(diamond("high"), ["a.a_id", "b.b_id", "d.d_id"]) == JoinPlan("a", steps(("a", "b", "left"), ("b", "d", "left")), False)
    assert join(diamond("high", "inner", "full"), ABCD) == JoinPlan("a", steps(("a", "b", "inner"), ("b", "d", "full"), ("d", "c", "right")), False)
    assert join(diamond(), ["c.c_id"]) == JoinPlan("c", (), False)


def test_models_must_be_connected(spark):
    made = music.models()
    r = repository()
    with pytest.raises(ValueError, match="no model"):
        r.build(spark)
    for name in ("customers", "invoices", "invoice_lines", "tracks"):
        r.with_model(made[name])
    r.join_one_to_many("customers", "invoices", music.equal("customers", "invoices", "customer_id"))
    for _ in range(2):
        with pytest.raises(ValueError, match="must be connected"):
            r.build(spark)
        r.join_many_to_one("invoice_lines", "tracks", music.equal("invoice_lines", "tracks", "track_id"))
    r.join_one_to_many("invoices", "invoice_lines", music.equal("invoices", "invoice_lines", "invoice_id"))
    assert r.build(spark)


def test_declarations_are_checked():
    with pytest.raises(ValueError, match="invalid model name"):
        model("no-dash")
    with pytest.raises(ValueError, match="already exists"):
        model("a").with_dimension("x", "number").with_metric("x", "number", lambda m: F.sum(m.column("x")))
    with pytest.raises(ValueError, match="already exists"):
        model("a").with_dimension("d", "date").with_temporal_hierarchy("d")
    with pytest.raises(ValueError, match="type 'money'"):
        model("a").with_dimension("x", "money")
    r = repository().with_model(model("a")).with_model(model("b"))
    with pytest.raises(ValueError, match="clone"):
        r.join_one_to_one("a", "a", lambda m: None)
    with pytest.raises(KeyError, match="Model c"):
        r.join_one_to_one("a", "c", lambda m: None)
    with pytest.raises(ValueError, match="priority"):
        r.join_one_to_one("a", "b", lambda m: None, priority="urgent")
    first = r.join_one_to_one("a", "b", lambda m: 1).find_join("a", "b")
    assert r.join_one_to_many("a", "b", lambda m: 2).find_join("a", "b") != first
    assert r.find_join("b", "a").cardinality == "many_to_one" and len(r.joins_of("a")) == 1


def test_references_of_a_metric_the_last_one_first(spark):
    r = diamond().with_calculated_metric("x.both", "number", lambda m: F.sum(m["c"].column("v") + m["a"].dimension("a_id")))
    s = plan_of(spark, r, ["x.both"]).segments[0]
    assert s.join_plan.initial == "a" and s.models == ("a", "c")
    assert s.model_query.dimensions == ("a.a_id", "c.c_id")


def test_metric_refs_make_a_sub_query(spark):
    r = diamond()
    r.models["c"].with_metric("sum", "number", lambda m: F.sum(m.column("v"))).with_metric("top", "number", lambda m: F.max(m.metric("sum")))
    s = plan_of(spark, r, ["a.a_id", "c.top"], filters=[{"operator": "set", "member": "b.b_id"}]).segments[0]
    assert s.metric_refs.join_on == ("a.a_id", "b.b_id", "c.c_id")
    assert s.metric_refs.plan.projected_metrics == ("c.sum",) and [f["member"] for f in s.metric_refs.plan.segments[0].filters] == ["b.b_id"]


def test_circles_are_found(spark):
    r = repository().with_model(model("a").with_metric("x", "number", lambda m: F.sum(m.metric("y"))).with_metric("y", "number", lambda m: F.sum(m.metric("x"))))
    with pytest.raises(ValueError, match="circle"):
        plan_of(spark, r, ["a.x"])

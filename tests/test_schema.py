# The members, messages and plans that these tests expect are fixed values.

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from metricloom import Filter, FilterRegistry, QueryError, default_filters
from metricloom.operators.filters import numbers
from metricloom.schema import MIXED
from tests import music


def messages(spark, query, r=None):
    return [str(i) for i in (r or music.store()).build(spark).schema.safe_parse(query)[1]]


def test_all_errors_with_their_places(spark):
    f = lambda op, member, value: {"operator": op, "member": member, "value": value}
    query = {
        "members": ["customers.customer_id", "invoices.total"],
        "order": [{"member": "customers.customer_id", "direction": "asc"}],
        "filters": [
            f("equals", "customers.customer_id1", 1),
            f("gte", "customers.customer_id", ["a"]),
            f("nonExistingOperator", "customers.customer_id2", 1),
            f("inQuery", "customers.customer_id", {"members": ["customers.customer_id"], "filters": [f("equals", "customers.customer_id2", [1])]}),
        ],
        "limit": 10,
    }
    names = "and or equals in notEquals notIn notSet set contains notContains startsWith notStartsWith endsWith notEndsWith gt gte lt lte inDateRange notInDateRange beforeDate afterDate inQuery notInQuery".split()
    assert messages(spark, query) == [
        "Error at filters[0].member: Member not found",
        "Error at filters[0].value: Expected array, received number",
        "Error at filters[1].value[0]: Expected number, received nan",
        "Error at filters[2].operator: Invalid discriminator value. Expected " + " | ".join(f"'{n}'" for n in names),
        "Error at filters[3].value.filters[0].member: Member not found",
    ]
    with pytest.raises(QueryError, match="Member not found"):
        music.store().build(spark).build_query(query)


def test_connectives_hold_members_of_one_kind(spark):
    row = {"operator": "equals", "member": "customers.customer_id", "value": [1]}
    aggregate = {"operator": "lt", "member": "invoice_lines.unit_price", "value": [1]}
    wrap = lambda *fs: {"operator": "or", "filters": list(fs)}
    places = lambda *fs: [i.path for i in music.store().build(spark).schema.safe_parse({"members": ["invoice_lines.unit_price"], "filters": list(fs)})[1] if i.message == MIXED]
    top = ("filters", 0, "filters")
    assert places(wrap(row, aggregate)) == [top]
    assert places(wrap(row, wrap(wrap(aggregate)))) == [top]
    assert places(wrap(wrap(wrap(row, aggregate)))) == [(*top, 0, "filters", 0, "filters"), (*top, 0, "filters"), top]
    assert places(row, aggregate) == []
    assert messages(spark, {"members": ["customers.city"], "filters": [wrap()]}) == ["Error at filters[0].filters: Array must contain at least 1 element(s)"]


@pytest.mark.parametrize(
    ("part", "want"),
    [
        ({"members": []}, "Error at members: Array must contain at least 1 element(s)"),
        ({"members": "x"}, "Error at members: Expected array, received string"),
        ({"members": ["artists.nope"]}, "Error at members[0]: Member not found"),
        ({"limit": -1}, "Error at limit: Expected a whole number of 0 or more, received -1"),
        ({"offset": 1.5}, "Error at offset: Expected a whole number of 0 or more, received 1.5"),
        ({"order": [{"member": "artists.name", "direction": "up"}]}, "Error at order[0].direction: Invalid enum value. Expected 'asc' | 'desc', received 'up'"),
        ({"filters": [{"operator": "contains", "member": "artists.name", "value": [1]}]}, "Error at filters[0].value[0]: Expected string, received number"),
        ({"filters": [{"operator": "beforeDate", "member": "invoices.invoice_date", "value": "someday"}]}, "Error at filters[0].value: Invalid date: someday"),
        ({"filters": [{"operator": "inDateRange", "member": "invoices.invoice_date", "value": {"startDate": "2020-01-01"}}]}, "Error at filters[0].value.endDate: Required"),
        ({"filters": [{"operator": "inQuery", "member": "artists.name", "value": {"members": ["artists.name", "albums.title"]}}]}, "Error at filters[0].value.members: A sub-query must have one member"),
    ],
)
def test_single_errors(spark, part, want):
    assert messages(spark, {"members": ["artists.name"], **part}) == [want]


def test_values_are_read(spark):
    parsed, issues = music.store().build(spark).schema.safe_parse(
        {
            "members": ["artists.name"],
            "limit": 0,
            "filters": [
                {"operator": "gt", "member": "artists.artist_id", "value": ["3", 4.5, " "]},
                {"operator": "inDateRange", "member": "invoices.invoice_date", "value": {"startDate": "2020-1-2", "endDate": datetime(2021, 1, 1)}},
            ],
        }
    )
    assert not issues
    assert [f["value"] for f in parsed["filters"]] == [[3, 4.5, 0], (datetime(2020, 1, 2), datetime(2021, 1, 1))]


def test_private_members_are_hidden_and_own_filters_replace_the_others(spark):
    r = music.store().with_calculated_metric("x.secret", "number", lambda m: F.sum(m["invoices"].column("Total")), private=True)
    assert messages(spark, {"members": ["x.secret"]}, r) == ["Error at members[0]: Member not found"]
    r.with_filters(FilterRegistry((Filter("odd", "", numbers, lambda _, m, v: m % 2 == 1),)))
    query = {"members": ["artists.name"], "filters": [{"operator": "equals", "member": "artists.name", "value": ["x"]}]}
    assert messages(spark, query, r) == ["Error at filters[0].operator: Invalid discriminator value. Expected 'and' | 'or' | 'odd'"]
    with pytest.raises(ValueError, match="connective"):
        default_filters().register(Filter("and", "", numbers, lambda _, m, v: m))


def test_json_schema_lists_members_and_filters(spark):
    schema = music.store().build(spark).schema.json_schema()
    assert "invoices.invoice_date.quarter" in schema["$defs"]["member"]["enum"]
    kinds = {x["properties"]["operator"]["const"]: x for x in schema["$defs"]["filters"]["items"]["anyOf"]}
    assert len(kinds) == 24 and kinds["set"]["required"] == ["operator", "member"] and kinds["gt"]["properties"]["value"]["minItems"] == 1

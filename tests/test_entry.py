import ast
import os
import re

import pytest

import __spark_entry__
from metricloom.catalogue.queries import ORACLE_SQL, QUERIES

ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))


def sources():
    for folder, _, files in os.walk(f"{ROOT}/metricloom"):
        if "/llm" not in folder.removeprefix(ROOT):
            yield from (f"{folder}/{f}" for f in files if f.endswith(".py"))


def test_nothing_else_imports_the_corpus_operators():
    found = list(sources())
    assert len(found) > 15
    for path in found:
        for node in ast.walk(ast.parse(open(path).read())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(re.match(r"metricloom\.llm|corpus_pipeline", n) for n in names), path


def test_queries_and_their_sql():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(QUERIES) <= set(queries) and set(ORACLE_SQL) <= set(sql) <= set(queries)
    numbered = {int(m[1]) for n in queries if (m := re.match(r"op(\d+)_", n))}
    assert numbered in (set(), set(range(1, 11)))


def test_everything_else_works_without_them(monkeypatch):
    monkeypatch.setattr(__spark_entry__, "HAS_LLM", False)
    monkeypatch.setattr(__spark_entry__, "HAS_PIPELINE", False)
    assert __spark_entry__.queries() == QUERIES and __spark_entry__.oracle_sql() == ORACLE_SQL


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the tables are not here")
def test_flagship_query(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["customer___mktsegment", "orders___total"] and df.count() == 5

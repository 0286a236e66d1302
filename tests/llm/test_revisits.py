import random

import duckdb

from metricloom.llm import revisits

SCHEMA = "record_id bigint, url string, ts bigint, kind string, status int, etag string, last_modified string, headers map<string,string>"


def brute(rows):
    out = {}
    for i, url, ts, kind, _, etag, dated, _ in rows:
        if kind != "revisit":
            continue
        old = [r for r in rows if r[3] == "response" and 200 <= (r[4] or 0) < 300 and r[4] != 206 and r[1] is not None and r[1] == url and ts is not None and r[2] is not None and r[2] < ts]
        if not old:
            out[i] = (None, "no_response")
            continue
        best = max(old, key=lambda r: (r[2], r[0]))
        if etag is not None and best[5] is not None:
            ok = etag.removeprefix("W/") == best[5].removeprefix("W/")
        elif dated is not None and best[6] is not None:
            ok = dated == best[6]
        else:
            ok = None
        out[i] = (best[0], {True: "resolved", False: "mismatch", None: "unverified"}[ok])
    return out


def test_as_of_join_matches_brute_force_with_a_hot_url(spark):
    rng = random.Random(7)
    rows = []
    for i in range(900):
        url = rng.choice(["a.org/hot", "a.org/hot", *[f"a.org/{k}" for k in range(40)], None])
        kind = rng.choice(["response", "revisit", "revisit"])
        rows.append((i, url, rng.choice([None, *range(60)]), kind, rng.choice([200, 200, 203, 206, 404, None]) if kind == "response" else 304, rng.choice([None, '"x"', 'W/"x"', '"y"']), rng.choice([None, "m", "n"]), {"Date": str(i)}))
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as range", "'z' as canonical", "2 as found").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.record_id: (r.refers_to, r.outcome) for r in revisits.resolve_revisits(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rows)
    assert revisits.resolve_revisits(df.limit(0)).count() == 0


def test_only_permitted_headers_are_merged(spark):
    rows = [
        (1, "http://WWW.Ex.org:80/a/?b=2&utm_x=1&a=1#f", 1, "response", 200, '"e"', None, {"Content-Type": "text/html", "Content-Length": "9", "ETag": "old"}),
        (2, "https://ex.org/a?a=1&b=2", 2, "revisit", 304, 'W/"e"', None, {"content-length": "0", "etag": "new", "Expires": "soon", "Transfer-Encoding": "chunked"}),
        (3, "https://ex.org/a?a=1&b=2", 1, "revisit", 304, '"e"', None, None),
    ]
    got = {r.record_id: r for r in revisits.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[2].canonical == "ex.org/a?a=1&b=2"
    assert [tuple(x) for x in got[2].headers] == [("content-length", "9"), ("content-type", "text/html"), ("etag", "new"), ("expires", "soon")]
    assert (got[3].outcome, got[3].refers_to, got[3].headers) == ("no_response", None, [])


def test_query_matches_sql(spark, tmp_path):
    rng = random.Random(1)
    urls = [f"{s}://{h}/p{k}{e}" for s in ("http", "https") for h in ("x.org", "www.X.org") for k in range(9) for e in ("", "/", "#top", "?utm_source=feed", "?page=2&ref=x", ".html")]
    spark.createDataFrame([(i, rng.choice(urls), rng.choice(["<p>é</p>", "b", "", None])) for i in range(600)], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = revisits.op7_revisit_resolution(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(revisits.OP7_SQL).fetchall()
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert len({r.outcome for r in got.collect()}) == 4

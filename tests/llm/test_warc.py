import random

from pyspark.sql import functions as F

from framewright.llm import warc as op

SCHEMA = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, note string"


def plain(rows):
    out = {}
    for r in rows:
        i, url, ts, kind, tag, date, _, _ = r
        if kind == "response":
            out[i] = ("full", None)
            continue
        before = [x for x in rows if x[3] == "response" and url is not None and ts is not None and x[1] == url and x[2] is not None and x[2] < ts]
        if not before:
            out[i] = ("unmatched", None)
            continue
        b = max(before, key=lambda x: (x[2], x[0]))
        weak = lambda t: t[2:] if t.startswith("W/") else t
        if tag is not None and b[4] is not None:
            same = weak(tag) == weak(b[4])
        elif date is not None and b[5] is not None:
            same = date == b[5]
        else:
            same = None
        out[i] = ("unverified", None) if same is None else ("resolved", b[0]) if same else ("mismatch", None)
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        url = rng.choice(["a.org/x"] * 6 + ["b.org/y", "c.org", None])
        rows.append((i, url, rng.choice([None, *range(150)]), rng.choice(["response", "revisit"]), rng.choice([None, '"1"', 'W/"1"', '"2"']), rng.choice([None, "d1", "d2"]), {"ETag": "x"} if rng.random() < 0.8 else None, "n"))
    df = spark.createDataFrame(rows, SCHEMA)
    for each in (1000, 90, 5, 1):
        got = {r.record_id: (r.status, r.resolved_id) for r in op.resolved(df, each).collect()}
        assert got == plain(rows)
    assert op.resolved(df.limit(0)).collect() == []
    assert "note" in op.resolved(df).columns and op.resolved(df.union(df.where("record_id = 5"))).count() == 601


def test_headers_and_bodies(spark):
    rows = [
        (1, "HTTP://www.A.org:80/p/?b=2&utm_source=q&a=1#top", 10, "response", '"t"', None, {"Content-Type": "text/html", "Content-Length": "9", "X": "old", "Date": "1"}, ""),
        (2, "https://a.org/p?a=1&b=2&ref=z", 20, "revisit", 'W/"t"', None, {"content-type": "text/plain", "Content-Length": "0", "x": "new", "Expires": "3"}, ""),
    ]
    got = op.resolved(spark.createDataFrame(rows, SCHEMA))
    bodies = spark.createDataFrame([(1, "BODY")], "record_id long, body string")
    r = {x.record_id: x for x in op.with_bodies(got, bodies).collect()}
    assert r[2].canonical == r[1].canonical == "a.org/p?a=1&b=2"
    assert r[2].merged == {"content-type": "text/html", "content-length": "9", "x": "new", "date": "1", "expires": "3"}
    assert (r[1].body, r[2].body, r[2].resolved_id) == ("BODY", "BODY", 1)


def test_headers_of_any_case_clashing_columns_and_long_values(spark):
    rows = [
        (1, "a.org/" + "x" * 300_000, 10, "response", '"t"', None, {"Set-Cookie": "a=1", "set-cookie": "b=2", "Vary": "x", "VARY": None, "Empty": None}, "mine"),
        (2, "a.org/" + "x" * 300_000, 20, "revisit", '"t"', None, {"vary": "y", "Vary": "z", "Cache-Control": "no"}, "too"),
        (2305843009213693953, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "note as _key", "note as _range", "note as _carried", "note as _of", "note as body", "note as status")
    got = op.resolved(df)
    assert set(got.columns) == {*df.columns, "canonical", "resolved_id", "merged"}
    r = {x.record_id: x for x in op.with_bodies(got, spark.createDataFrame([(1, "BODY")], "record_id long, body string")).collect()}
    assert r[1].merged == {"set-cookie": "a=1\nb=2", "vary": "x", "empty": None}
    assert r[2].merged == {"set-cookie": "a=1\nb=2", "vary": "z, y", "empty": None, "cache-control": "no"}
    assert (r[1]._key, r[2]._range, r[2]._carried, r[2]._of, r[2].body, r[2].status) == ("mine", "too", "too", "too", "BODY", "resolved")
    assert r[2305843009213693953].status == "unmatched" and op.with_bodies(got.limit(0), df.limit(0)).count() == 0


def test_large_page_ids_and_repeats(spark):
    pages = [(2305843009213693953, "a.org", "x"), (7, None, None), (8, "b.org", "y"), (8, "b.org", "y")]
    got = op.report(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.response_page_id) for r in got if r.canonical) == [(8, 8), (8, 8), (2305843009213693953, 2305843009213693953)]
    assert [r.status for r in got if r.page_id == 7] == ["unmatched"]


def test_query_equals_sql(spark):
    import duckdb

    rng = random.Random(1)
    rows = [(i, rng.choice(["http://www.h.org/a/", "https://h.org/a?utm_x=1#t", "http://k.org/q?page=2&ref=x", "http://h.org"]), f"<p>{rng.randrange(3)}") for i in range(500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    con = duckdb.connect()
    frame = pages.toPandas()
    con.register("pages", frame)
    key = lambda r: tuple("" if x is None else x for x in r)
    want = sorted((tuple(None if x != x else x for x in r) for r in con.sql(op.ORACLE).fetchall()), key=key)
    got = sorted(map(tuple, op.report(pages).collect()), key=key)
    assert got == want and {r[2] for r in got} == {"resolved", "mismatch"}
    assert op.report(pages.where(F.lit(False))).collect() == []

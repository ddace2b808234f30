import datetime as dt
import random

from pyspark.sql import functions as F

from sensorloom.llm import queries, url_lists


def active(host, at, entries):
    if host is None or at is None:
        return []
    parts = host.split(".")
    own = {".".join(parts[k:]) for k in range(len(parts))}
    state = {}
    for name, domain, time, on in sorted((e for e in entries if None not in e), key=lambda e: (e[2], e[3])):
        if domain in own and time <= at:
            state[name, domain] = on
    return sorted(k for k, on in state.items() if on)


def test_as_of(spark):
    rng = random.Random(6)
    day = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 60))
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "c.b.org", "com"]
    entries = [(rng.choice("pq"), rng.choice(hosts), day(), rng.random() < 0.6) for _ in range(300)]
    entries += [("p", "a.com", dt.datetime(2024, 1, 5), v) for v in (True, False, True)] + [("p", None, day(), True), (None, "a.com", day(), True), ("p", "a.com", None, True), ("p", "a.com", day(), None)]
    urls = [(k, f"https://u@{rng.choice(hosts).upper()}.:80/p?x=@y", day()) for k in range(200)]
    urls += [(500, None, day()), (501, "no scheme", day()), (502, "http://a.com", None), (503, "http://" + "z." * 300 + "com/", day()), (3, urls[3][1], urls[3][2]), (None, "ftp://x.a.com#f", dt.datetime(2030, 1, 1)), (504, "http://a.com", dt.datetime(2000, 1, 1))]
    e = spark.createDataFrame(entries, "list string, domain string, listed_at timestamp_ntz, listed boolean")
    c = spark.createDataFrame(urls, "page_id long, url string, fetched_at timestamp_ntz").withColumn("domain", F.lit("clash")).withColumn("list", F.lit("clash"))
    got = sorted((tuple(r) for r in url_lists.listed_captures(c, e).collect()), key=str)

    def host(url):
        if url and "://" in url:
            h = url.split("://")[1].split("/")[0].split("#")[0].split("@")[-1].split(":")[0].lower().rstrip(".")
            return h if len(h) <= 253 else None
        return None

    want = []
    for page, url, at in urls:
        on = active(host(url), at, entries)
        want.append((page, host(url), len(on), ",".join(sorted({n for n, _ in on}))))
    assert got == sorted(want, key=str)
    assert url_lists.listed_captures(c.limit(0), e).count() == 0
    assert url_lists.listed_captures(c, e.limit(0)).agg(F.sum("n_active")).head()[0] == 0


def test_same_as_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("pages", "events"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL["op5_url_lists"])
    got = queries.op5_url_lists(spark, d).select(*want.columns).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want.fetchall(), key=str)
    assert any(r.blocked for r in got)

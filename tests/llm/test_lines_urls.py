import hashlib
from collections import defaultdict

import duckdb
import pytest

from inkgauge.llm import line_dedup, url_reputation
from inkgauge.llm.queries import queries
from inkgauge.llm.sql import OP4, oracle_sql

from .util import ODD_ROWS, docs


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_twin(spark, sf001, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf001}/{t}.parquet')")
    twin = con.sql(oracle_sql()[name])
    got = queries()[name](spark, sf001)
    assert sorted(got.columns) == sorted(twin.columns)
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, got.select(*twin.columns).collect()), key=key) == sorted(twin.fetchall(), key=key)


def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars and i is not None:
                held[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(held[key(x)]) < min_docs or i == max(held[key(x)])]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_lines_against_brute_force(spark):
    a, b, c = "A line that is long enough to be judged here", "é" * 39 + "Z", "\t spaced line, forty code points or a few more \r"
    rows = [(i, "\n".join([a, f"own {i}", b if i % 2 else c, a.upper()])) for i in range(11)]
    rows += [(3, rows[3][1]), (None, a), (None, a + "\nx"), *ODD_ROWS]
    got = line_dedup.dedup_lines(docs(spark, rows), carry=("lang", "key"))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_text", "kept_sha256", "lang", "key"]
    assert sorted([(r[0], r[1], r[2], r[4]) for r in got.collect()], key=repr) == brute_lines(rows)
    assert line_dedup.dedup_lines(docs(spark, []).limit(0)).collect() == []


def test_urls(spark):
    urls = ["http://a.example.org/es/x", "HTTP://EXAMPLE.ORG/en/12?q=/fr/", "https://org", "http://b.com/fr/", "http://b.com/de/#x",
            "no scheme", None, "", "http://x.COM", "http://xorg/", "://org/", "http://h.net/a://b", "http://h.net/a://b"]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    labels = spark.createDataFrame([(11, 0), (11, None), (None, 1)], "doc_id long, quality int")
    got = {r["page_id"]: tuple(r)[1:] for r in url_reputation.judge_urls(pages, labels).collect()}
    assert len(got) == len(urls)
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("org", "", None, "allow")
    assert got[3][2:] == ("com/fr/", "allow") and got[4][1:] == ("/de/", "com/de/", "block")
    assert got[5][:3] == got[6][:3] == got[7][:3] == ("", "", None)
    assert got[8][0] == "x.com" and got[9][2] is None and got[10][2] == "org/" and got[11][1] == "/a://b"
    empty = labels.limit(0)
    assert {r["verdict"] for r in url_reputation.judge_urls(pages, empty).collect()} == {"allow", "block"}
    assert url_reputation.judge_urls(pages.limit(0), labels).collect() == []


def test_reputation_shrinks(spark):
    rows = [("bad.one.net", 0)] * 40 + [("bad.one.net", 1)] + [("few.one.net", 0)] + [("good.two.net", 1)] * 50
    got = {r["host"]: r for r in url_reputation.host_reputation(spark.createDataFrame(rows, "host string, good int")).collect()}
    assert got["bad.one.net"]["upper"] < 0.5 < got["good.two.net"]["good"]
    assert 0 < got["few.one.net"]["good"] < 1 and got["few.one.net"]["upper"] > got["bad.one.net"]["upper"]


def test_hosts_without_labels_are_judged_by_their_parents(spark):
    hosts = ["bad.one.net"] * 40 + ["good.two.org"] * 50 + ["worse.three.info"] * 30 + ["new.one.net", "new.two.org", "x.four.info", "x.five.biz", None]
    pages = spark.createDataFrame([(i, h and f"http://{h}/p{i}") for i, h in enumerate(hosts)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(40 <= i < 90)) for i in range(120)], "doc_id long, quality int")
    got = {r["host"]: r["verdict"] for r in url_reputation.judge_urls(pages, labels, rules=()).collect()}
    assert got == {"bad.one.net": "block", "good.two.org": "allow", "worse.three.info": "block", "new.one.net": "block",
                   "new.two.org": "allow", "x.four.info": "block", "x.five.biz": "allow", "": "allow"}
    # mostly bad labels speak against a host of an unknown suffix, a single one does not
    most = labels.where("doc_id < 40 or doc_id >= 85")
    assert {r["host"]: r["verdict"] for r in url_reputation.judge_urls(pages, most, rules=(), z=0.0).collect()}["x.five.biz"] == "block"
    one = labels.where("doc_id = 0")
    assert {r["host"]: r["verdict"] for r in url_reputation.judge_urls(pages, one, rules=()).collect()}["x.five.biz"] == "allow"


def test_twin_judges_hosts_without_labels(spark):
    """The whole rule in SQL: domains, suffixes and all labels speak for hosts that have none."""
    pages, labels = [], []
    for k, (host, good, n) in enumerate([("a.bad.com", 0, 40), ("b.bad.com", 0, 30), ("a.fine.com", 1, 50), ("x.worse.net", 0, 60), ("y.ok.org", 1, 9)]):
        for i in range(n):
            pages.append((1000 * k + i, f"https://{host}/p{i}"))
            labels.append((1000 * k + i, good if i % 10 else 1 - good))
    pages += [(9000 + i, u) for i, u in enumerate(["http://new.bad.com/x", "http://new.fine.com/x", "http://other.net/x", "http://deep.other.net/x",
                                                   "http://nowhere.xyz/x", "no url", None, "http://new.bad.com/de/", "http://NEW.ok.org/x"])]
    p = spark.createDataFrame(pages, "page_id long, url string")
    for lab in (labels, labels[:70], []):
        con = duckdb.connect()
        con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
        con.executemany("INSERT INTO pages VALUES (?, ?)", pages)
        con.execute("CREATE TABLE labels (doc_id BIGINT, quality INTEGER)")
        if lab:
            con.executemany("INSERT INTO labels VALUES (?, ?)", lab)
        want = {r[0]: r for r in con.execute(OP4).fetchall()}
        got = url_reputation.judge_urls(p, spark.createDataFrame(lab, "doc_id long, quality int")).collect()
        assert {r["page_id"]: tuple(r) for r in got} == want
        blocked = {r["host"] for r in got if r["verdict"] == "block" and r["rule"] is None}
        assert not lab or "new.bad.com" in blocked

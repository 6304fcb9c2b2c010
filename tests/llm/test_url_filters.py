import itertools
import re

from pyspark.sql import functions as F

from plumbline.llm import url_filters as uf
from plumbline.llm.queries import URL_RULES


def brute_parts(url):
    at = url.find("://") if url is not None else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def brute_mined(rows, min_count, min_lift, chance):
    counts, blocked = {}, {}
    for items, bad in rows:
        for n in range(1, len(items) + 1):
            for some in itertools.combinations(sorted(items), n):
                counts[some] = counts.get(some, 0) + 1
                blocked[some] = blocked.get(some, 0) + bad
    base = sum(bad for _, bad in rows) / len(rows)
    rules = {}
    for s, n in counts.items():
        c = blocked[s] / n
        if blocked[s] >= min_count and c >= min_lift * base - 1e-12 and c - base >= chance * (base * (1 - base) / n) ** 0.5:
            rules[s] = c
    return {s: c for s, c in rules.items() if not any(set(t) < set(s) for t in rules)}


URLS = [
    "http://a.com/fr/1", "https://A.Example.ORG/es/x?y=1#z", "http://example.org/en/12", "http://xexample.org/es/", "http://org", "http://b.com/de/2", "http://b.com/dex",
    "no scheme", "", None, "x://h?q/://z", "http://example.org/en/2#a/b", "ftp://É.com/fr/", "http://a.com/fr/1", "http://" + "x" * 5000 + ".com/de/", "http://h\n.org/a\nb",
]


def test_written_rules(spark):
    rows = [(i, u, "html", "clash") for i, u in enumerate(URLS)] + [(None, "http://q.org/"), (0, "http://q.net/")]
    df = spark.createDataFrame([(*r, "h", "v")[:4] for r in rows], "page_id long, url string, html string, verdict string")
    got = uf.judge(df, URL_RULES, uf.mine(spark.createDataFrame([], "url string, blocked boolean"))).collect()
    want = []
    for i, u, *_ in rows:
        host, path = brute_parts(u)
        rule = brute_rule(host, path)
        want.append((i, host, path, rule.text if rule else None, rule.verdict if rule else "allow"))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)


def test_mined_rules_match_brute_force(spark):
    urls = [(f"http://{h}.net/{p}/{i}?k={i}", bad) for i, (h, p, bad) in enumerate(
        [("spam", "x", True)] * 12 + [("spam", "y", True)] * 3 + [("spam", "y", False)] * 9 + [("good", "x", False)] * 20 + [("mid", "x", True)] * 4 + [("mid", "x", False)] * 4)]
    df = spark.createDataFrame(urls, "url string, blocked boolean")
    rules = uf.mine(df, min_support=0.01, min_lift=1.3, least=3).collect()
    tokens = [r[0] for r in df.select(uf.tokens(F.col("url"))).collect()]
    want = brute_mined([(t, bad) for t, (_, bad) in zip(tokens, urls)], 3, 1.3, 1.64)
    assert want
    got = {tuple(sorted([r["key"], *r["rest"]])): r["confidence"] for r in rules}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string")
    judged = {r["page_id"]: r for r in uf.judge(pages, [], uf.mine(df, 0.01, 1.3, 3)).collect()}
    for i, t in enumerate(tokens):
        best = max((c for s, c in want.items() if set(s) <= set(t)), default=None)
        assert judged[i]["confidence"] == best and judged[i]["verdict"] == ("block" if best else "allow")


def test_production_parameters_mine_rules_that_block(spark):
    urls = [(f"http://www.{'casino-win' if i % 3 == 0 else 'news'}.example.com/en/{i}", i % 3 == 0 and i % 4 > 0 or i % 10 == 1) for i in range(600)]
    rules = uf.mine(spark.createDataFrame(urls, "url string, blocked boolean"))
    assert {("in host:casino",), ("in host:win",)} <= {tuple([r["key"], *r["rest"]]) for r in rules.collect()}
    pages = spark.createDataFrame([(1, "http://casino.example.net/x"), (2, "http://other.net/")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in uf.judge(pages, [], rules).collect()} == {1: "block", 2: "allow"}


def test_rules_are_mined_from_the_given_tables_and_block_pages(spark):
    from plumbline.llm.session import table

    pages = table(spark, "/root/testdata/sf0.1", "pages").select("page_id", "url")
    rules = uf.mine(uf.labelled_pages(pages, table(spark, "/root/testdata/sf0.1", "labels")))
    assert rules.count() > 0
    judged = uf.judge(pages, URL_RULES, rules)
    assert judged.where("rule is null and verdict = 'block'").count() > 0 and judged.where("verdict = 'allow'").count() > 1000


def test_empty_tables(spark):
    none = spark.createDataFrame([], "url string, blocked boolean")
    assert uf.mine(none).count() == 0
    assert uf.mine(spark.createDataFrame([("http://a/b", False)] * 9, "url string, blocked boolean")).count() == 0
    assert uf.judge(spark.createDataFrame([], "page_id long, url string"), URL_RULES, uf.mine(none)).count() == 0


def test_labels_join_pages(spark):
    pages = spark.createDataFrame([(1, "http://a/"), (2, None), (3, "http://c/"), (4, "http://d/")], "page_id long, url string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 0), (3, None, 1), (None, 0, 0), (4, 1, None)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, uf.labelled_pages(pages, labels).where("url is not null").collect())) == [("http://a/", True), ("http://c/", True), ("http://d/", False)]


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "http://a/")], "page_id long, url string")
    plan = uf.judge(df, URL_RULES, spark.createDataFrame([], uf._RULES))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian", plan)

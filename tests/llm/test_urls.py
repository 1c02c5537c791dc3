from __future__ import annotations

import random
import re

import pytest

from opinara.llm import urls
from opinara.llm.queries import _RULES, QUERIES, SQL


def parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (m[1].translate(low), m[2]) if m else ("", "")


def brute(url, rules=_RULES):
    host, path = parts(url)
    best = max(((len(n), n, v) for v, n in rules for h, _, p in [n.partition("/")]
                if (host == h or host.endswith("." + h)) and path.startswith("/" + p)), default=None)
    if best:
        return host, path, best[1], best[2]
    words = "|".join("[^A-Za-z0-9]".join(w) for w in urls.UNWANTED)
    bad = re.search(f"(?:^|[^A-Za-z0-9])(?:{words})(?:[^A-Za-z0-9]|$)", host + path)
    return host, path, None, "block" if bad else "allow"


ODD = [None, "", "no scheme.com/en/", "://", "http://", "HTTP://EXAMPLE.COM/en/x", "x://a://b.com/", "https://Ä.COM/", "http://com/",
       "http://com", "http://acom/", "http://www.example.com/en/a?b#c", "http://m.example.com/en/", "http://example.com/en",
       "http://example.com?x=/en/", "http://a.net/es/", "http://net/fr/1", "http://notnet/fr/", "http://x.org/casino-win",
       "http://casino.org", "http://mycasino.org", "http://a\nb.com/\nen/", "http://u@example.com:80/en/", "http://x.org/" + "a/" * 20_000]


def table(spark, values):
    return spark.createDataFrame([(i, u, "r") for i, u in enumerate(values)], "page_id long, url string, rule string")


@pytest.mark.parametrize("inline", [500, 0])
def test_odd_urls(spark, inline):
    rules = [*(urls.host_rule(v, n) for v, n in _RULES), *urls.PATTERN_RULES]
    rows = urls.judge(table(spark, ODD + ODD), rules, inline=inline).collect()
    assert len(rows) == 2 * len(ODD)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url), r.url


def test_random_rules_and_both_lookups(spark):
    rng = random.Random(1)
    hosts = ["com", "a.com", "b.a.com", "net", "x-y.net"]
    rules = tuple({(rng.choice(("allow", "block")), n) for n in {f"{rng.choice(hosts)}/{rng.choice(('', 'e', 'en/', 'en/x', 'en/x/'))}" for _ in range(15)}})
    rules = tuple({n: (v, n) for v, n in rules}.values())
    seen = [f"http://{rng.choice(('', 'www.', 'q.'))}{rng.choice(hosts)}/{rng.choice(('', 'e', 'en', 'en/', 'en/x', 'en/xy', 'en/x/z', 'EN/'))}" for _ in range(300)]
    made = [urls.host_rule(v, n) for v, n in rules]
    for inline in (500, 0):
        for r in urls.judge(table(spark, seen), made, inline=inline).collect():
            assert (r.host, r.path, r.rule, r.verdict) == brute(r.url, rules), r.url


def test_rules_are_filed_under_their_rarest_token(spark):
    subjects = spark.createDataFrame([("www.a.com/en/",), ("b.com/en/",), ("c.com/fr/",)], "subject string")
    rule, none = urls.host_rule("block", "a.com/en/"), urls.Rule("any", "x$", (), "block", 1)
    assert urls.rarest_tokens(subjects, [rule, none]) == {rule: "a", none: None}


def test_rules_without_literal_are_always_tried(spark):
    rule = urls.Rule("digits", "[0-9]{4}$", (), "block", 1, shown=True)
    for inline in (500, 0):
        rows = urls.judge(table(spark, ["http://a.b/1234", "http://a.b/x", None]), [rule], inline=inline).collect()
        assert sorted(r.verdict for r in rows) == ["allow", "allow", "block"]


def test_no_rules_and_no_rows(spark):
    assert [r.verdict for r in urls.judge(table(spark, ["http://a.b/"]), []).collect()] == ["allow"]
    assert urls.judge(table(spark, ["x"]).where("false"), [urls.host_rule("block", "com/")]).count() == 0


def test_query_is_native_and_equals_its_sql(spark):
    from opinara.verification import compare

    sf = "/root/testdata/sf0.001"
    ok, message = compare.compare(spark, compare.duck(sf), sf, "op8", QUERIES["op8_url_filters"], SQL["op8_url_filters"])
    assert ok, message
    plan = QUERIES["op8_url_filters"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)

"""URL filters against regular expressions."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from scoreloom.llm import url_filter as uf


def as_regex(glob):
    out = re.escape(glob).replace(r"\*\*", "[^€]*").replace(r"\*", "[^/]*")
    return re.compile(out.encode(), re.S)


GLOBS = st.lists(st.text("ab/*.", max_size=8).filter(lambda g: "***" not in g), max_size=40)
URLS = st.lists(st.text("ab/.é", max_size=12), max_size=20)


@settings(max_examples=150, deadline=None)
@given(GLOBS, URLS)
def test_the_automaton_matches_as_regular_expressions_do(globs, urls):
    machine = uf.automaton([uf.Rule(g, "block") for g in globs])
    texts = [u.encode() for u in urls]
    got = uf.matches(machine, texts)
    every = [as_regex(g).pattern.replace("[^€]*".encode(), b"[\\x00-\\xff]*") for g in globs]
    for i, t in enumerate(texts):
        for j, pattern in enumerate(every):
            assert got[i, j] == bool(re.fullmatch(pattern, t, re.S))


CASES = [
    ("https://www.example.net/en/5", "www.example.net", "/en/5", "example.net/en/", "allow"),
    ("https://example.net/de/5", "example.net", "/de/5", "net/", "block"),
    ("https://example.net", "example.net", "", None, "allow"),
    ("http://A.EXAMPLE.com/de/x?q=/en/", "a.example.com", "/de/x", "example.com/de/", "block"),
    ("http://x.org/fr/#top", "x.org", "/fr/", "org/fr/", "allow"),
    ("http://x.org/FR/", "x.org", "/FR/", None, "allow"),
    ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
    ("http://x.com/a.net/b", "x.com", "/a.net/b", None, "allow"),
    ("http://x.net:80/", "x.net:80", "/", None, "allow"),
    ("ftp://best-CASINO.com", "best-casino.com", "", None, "block"),
    ("http://x.com/casino/", "x.com", "/casino/", None, "allow"),
    ("http://x.com/a/wp-login.php", "x.com", "/a/wp-login.php", None, "block"),
    ("no scheme.net/", "", "", None, "allow"),
    ("http://", "", "", None, "allow"),
    ("a://b.net/x\ny://c", "b.net", "/x\ny://c", "net/", "block"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://é.net/" + "x" * 5000, "é.net", "/" + "x" * 5000, "net/", "block"),
]


def test_hosts_paths_and_rules(spark):
    rows = [(i, c[0], "mine") for i, c in enumerate(CASES)]
    pages = spark.createDataFrame(rows * 2, "page_id bigint, url string, rule string")
    got = uf.judge(pages, keep=["page_id"]).collect()
    assert len(got) == 2 * len(CASES)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == CASES[r.page_id][1:]


def test_no_pages_and_no_rules(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert uf.judge(pages).count() == 0
    pages = spark.createDataFrame([(1, "http://x.net/")], "page_id bigint, url string")
    assert uf.judge(pages, rules=[], default="block").first().verdict == "block"

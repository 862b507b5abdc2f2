import pytest

from threadloom.llm import urls

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
URLS = ["https://a.example.org/es/1", "http://example.org/en/12?x=1", "http://EXAMPLE.ORG/en/2", "http://b.COM/fr/x", "http://b.com/FR/x", "http://xcom/de/", "http://x.com/de", "http://x.com/de/?q",
        "ftp://org/", "http://org", "http://.org/", "http://a.org:80/es/", "a.org/es/", None, "", "://", "http://a.org?x=/es/", "http://spam-farm.net/", "http://x.spam-farm.org/", "http://notspam-farm.net/a",
        "http://my-casino.net", "http://user@x.com/de/a#b", "http://a.b.c.example.org/en/1", "http://é.org/ñ", "http://a.com/de/\nx", "http://a.com/fr/" + "x" * 5000, "http://x://y.org/", "http://casinos.net/"]


def expected(url):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3:]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:][: min([rest[cut:].index(c) for c in "?#" if c in rest[cut:]], default=None)]
    best = max(((h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), key=lambda r: len(r[0]), default=None)
    if best:
        return host, path, *best
    import re

    bad = re.search(r"(^|[.-])(spam-farm|cheap-pills|casino|free-money|adult|malware|phishing|warez)([.:-]|$)", host)
    return host, path, None, "block" if bad else "allow"


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame(rows, "page_id long, url string, html string, rule string, token string, _subject string").select("*")


def test_rules(spark, pages):
    rows = [(i, u, None, "r", "t", "s") for i, u in enumerate(URLS)] + [(5, URLS[5], None, "", "", ""), (None, URLS[0], None, "", "", "")]
    got = urls.judge(pages(rows), urls.rule_table(spark, urls.CONTRACT_RULES + urls.WORD_RULES)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((r[0], *expected(r[1])) for r in rows), key=str)


def test_rare_tokens_file_the_rules(spark, pages):
    """Only rules filed under a token of the URL run: one under a token that no URL has fits nothing, whatever its pattern."""
    rule = urls.Rule("all", "block", 1, ".*", ["nowhere"])
    got = urls.judge(pages([(1, "http://a.org/", None, "", "", "")]), urls.rule_table(spark, [rule])).collect()
    assert [r.verdict for r in got] == ["allow"]


def test_shuffled_rules_give_the_same(spark, pages, monkeypatch):
    rows = [(i, u, None, "r", "t", "s") for i, u in enumerate(URLS)]
    monkeypatch.setattr(urls, "BROADCAST_RULES", 0)
    got = urls.judge(pages(rows), urls.rule_table(spark, urls.CONTRACT_RULES + urls.WORD_RULES)).collect()
    assert sorted(tuple(r) for r in got) == sorted((r[0], *expected(r[1])) for r in rows)


def test_empty_table(spark, pages):
    assert urls.judge(pages([]), urls.rule_table(spark, urls.CONTRACT_RULES)).count() == 0

from __future__ import annotations

import math
import random
from itertools import combinations

from galley.llm import url_filter as U

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def by_hand(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for kind, rule in RULES:
        rule_host, _, rule_path = rule.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rule_path):
            if best is None or len(rule) > len(best[1]):
                best = (kind, rule)
    return host, path, best


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/71?x=/de/", "http://a.example.com/en/8", "http://badexample.com/en/1",
    "http://com/en/", "http://notcom/en/", "http://x.net/de/8", "https://example.net/de/8/9#a", "https://x.example.net/de/9?b", "ftp://q.org?es=/es/",
    "http://q.org/es/", "http://é.ORG/es/://x", "http://cheap-pills.shop.io/a", "http://cheappills.io/b", "http://news.io/spam", "http://casino.io:80/x/123",
    "http://casinowin.io/win/now", "http://www.weather.io/today/rain", "http://weathertoday.io/", "http://" + "a" * 5000 + ".io/" + "b/" * 5000, "http://casino.io:80/x/123",
] + [f"http://www.gardenflower{i}.io/flower/{i}" for i in range(30)]
WORDS = "the weather today is rain and casino win cheap pills garden flower news"


def pages(spark, urls=None):
    urls = URLS if urls is None else urls
    rows = [(k if k % 5 else None, u, "<p>" + WORDS + "</p>" if k % 3 else None, "h", "s") for k, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, score string").repartition(3)


def test_rules_and_parts(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    host, path = U.host_and_path(U.F.col("url"))
    rule, verdict = U.rule_for(U.F.col("h"), U.F.col("p"), U.RULES)
    for r in df.select("url", host.alias("h"), path.alias("p")).select("*", rule.alias("rule"), verdict.alias("verdict")).collect():
        h, p, best = by_hand(r.url)
        assert (r.h, r.p) == (h, p)
        assert (r.verdict, r.rule) == (best or (None, None))


def test_verdicts(spark):
    got = U.judge(pages(spark)).collect()
    assert len(got) == len(URLS)
    found = {(r.host, r.path): r for r in got}
    for url in URLS:
        host, path, best = by_hand(url)
        r = found[host, path]
        assert r.rule == (best[1] if best else None)
        assert r.verdict == (best[0] if best else ("block" if r.score > 0 else "allow"))
    verdict = lambda url: found[by_hand(url)[:2]].verdict
    assert verdict("http://cheap-pills.shop.io/a") == verdict("http://cheappills.io/b") == verdict("http://casinowin.io/win/now") == "block"
    assert verdict("http://www.weather.io/today/rain") == verdict("http://weathertoday.io/") == verdict(None) == "allow"


def test_split_is_the_most_likely_one():
    rnd = random.Random(1)
    total = 1000
    for _ in range(300):
        name = "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 9)))
        words = {"".join(rnd.choice("ab") for _ in range(rnd.randint(2, 4))): math.log(rnd.randint(1, 99) / total) for _ in range(8)}
        known = [(s, n, words[name[s : s + n]]) for s in range(len(name)) for n in range(2, 5) if name[s : s + n] in words and s + n <= len(name)]
        weigh = lambda w: max(words.get(w, -math.inf), math.log(10 / total) - len(w) * math.log(10))
        cuts = (c for k in range(len(name)) for c in combinations(range(1, len(name)), k))
        best = max(sum(weigh(name[a:b]) for a, b in zip((0, *c), (*c, len(name)))) for c in cuts)
        got = U.best_split(name, known, total)
        assert "".join(got) == name
        assert abs(sum(map(weigh, got)) - best) < 1e-9


def test_long_names_and_words_are_segmented_alike(spark):
    long_word = "pneumonoultramicroscopicsilicovolcanoconiosis"
    words = ["weather", "today", "casino", "rain", long_word]
    lexicon = spark.createDataFrame([(w, math.log(0.01)) for w in [*words, long_word[:24] + "x"]], "word string, weight double")
    rnd = random.Random(3)
    want = {}
    for n in (1, 3, 9, 300, 2000):
        chosen = [rnd.choice(words) for _ in range(n)]
        want["".join(chosen)] = chosen
    want[long_word[:24] + "q"] = [long_word[:24] + "q"]
    got = U.segmented(spark.createDataFrame([(n,) for n in [*want, "0"]], "name string"), lexicon, 1000).collect()
    assert {r.name: r.words for r in got} == {**want, "0": ["0"]}


def test_weights_are_those_of_multinomial_bayes(spark):
    rows = [("spam.io", "/a", ["spam", "io"], True), ("spam.io", "/a", ["a"], False), ("ok.io", "/a", ["ok", "io"], True), ("ok.io", "/a", ["a", "a"], False), ("ok.io", "/spam", ["spam"], False), ("ok.io", "/spam", ["ok", "io"], True)]
    weights, prior = U.word_weights(spark.createDataFrame(rows, "host string, path string, words array<string>, in_host boolean"))
    block, allow = {"spam": 1, "io": 1, "a": 1}, {"ok": 2, "io": 2, "a": 2, "spam": 1}
    for r in weights.collect():
        b, a = block.get(r.word, 0), allow.get(r.word, 0)
        usual = U.PRIOR_WORDS * (a + b) / 10
        odds = math.log((b + usual) / (3 + U.PRIOR_WORDS)) - math.log((a + usual) / (7 + U.PRIOR_WORDS))
        assert abs(r.score - odds * 1e6) < 1
    assert prior == round(math.log(2 / 3) * 1e6)


def test_empty_table(spark):
    assert U.judge(pages(spark, [])).count() == 0

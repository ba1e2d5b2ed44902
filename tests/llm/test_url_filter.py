import random
import re
from collections import Counter, defaultdict

import pytest

from lexmill.llm import url_filter as U

PAGES = "page_id long, url string, html string, host int, rule string, verdict string"
RULES = "action string, host string, path string"


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return low(host), path


def rule_for(host, path, rules):
    fits = [(len(h + p), len(h), a == "block", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, None)


def plain(pages, links, rules, damping=U.DAMPING, rounds=U.ROUNDS, least=U.LEAST):
    """pages: urls; links: the (host, path) pairs linked from each."""
    mentions, edges = Counter(map(parts, pages)), Counter()
    for url, out in zip(pages, links, strict=True):
        host = parts(url)[0]
        mine = {x for x in out if host and x[0] and x[0] != host}
        mentions.update(mine)
        edges.update((host, x[0]) for x in mine)
    seed = defaultdict(lambda: defaultdict(float))
    total = Counter()
    for (host, path), n in mentions.items():
        total[host] += n
        if action := rule_for(host, path, rules)[1]:
            seed[action][host] += n
    score = {}
    for action, turn in (("allow", False), ("block", True)):
        mass = {h: n / total[h] for h, n in seed[action].items() if h}
        sums = Counter(mass)
        every = Counter()
        for (a, b), n in edges.items():
            every[b if turn else a] += n
        for _ in range(rounds):
            new = Counter()
            for (a, b), n in edges.items():
                x, y = (b, a) if turn else (a, b)
                if x in mass:
                    new[y] += damping * mass[x] * n / every[x]
            mass = new
            sums.update(mass)
        score[action] = sums
    out = []
    for url in pages:
        host, path = parts(url)
        rule, action = rule_for(host, path, rules)
        bad, good = score["block"][host], score["allow"][host]
        out.append((host, path, rule, action or ("block" if bad >= least and bad > good else "allow")))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_against_plain_python(spark, monkeypatch, seed):
    if seed == 1:
        monkeypatch.setattr(U, "RULES_TO_BROADCAST", 0)
        monkeypatch.setattr(U, "HOSTS_TO_BROADCAST", 0)
    rng = random.Random(seed)
    hosts = ["a.com", "b.a.com", "x.org", "y.x.org", "net", "é.net", "c.d.e.net", "com", "xcom", "", "a.com:80"]
    paths = ["", "/", "/fr/1", "/de/2", "/de", "/fr/a/b", "//", "/É"]
    url = lambda: rng.choice(["http", "HTTPS", "ftp"]) + "://" + rng.choice([str.upper, str])(rng.choice(hosts)) + rng.choice(paths) + rng.choice(["", "?q=/de/", "#x", "?u=http://x.org/"])
    rules = [("allow", "org", "/"), ("block", "x.org", "/de/"), ("block", "com", "/de"), ("allow", "a.com", "/fr/"), ("block", "a.com", "/fr/"), ("block", "net", ""), ("allow", "e.net", "/de"), ("allow", "com", "/fr/a/")]
    pages, links, rows = [], [], []
    for i in range(120):
        targets = [(rng.choice(hosts), rng.choice(paths)) for _ in range(rng.randint(0, 3))]
        html = "".join(rng.choice(['<a class=x href="https://{}">l</a>', "<A\nHREF = '//{}?a=1'>", "<area href=http://{} >", '<!-- <a href="//com/"> --><a href="//{}#x">'] ).format(h + p) for h, p in targets)
        html = rng.choice(["", '<script>"<a href=//com/>"</script>', '<p>//x</p><a href="/de/">', '<b href="//com/">']) + html
        pages.append(rng.choice([None, "", "no scheme", *[url() for _ in range(12)]]))
        links.append([(h, p) for h, p in targets if h])
        rows.append((i, pages[-1], rng.choice([None, ""]) if not targets else html, 1, "r", "v"))
    rows.append((None, *rows[0][1:]))
    pages.append(pages[0])
    links.append(links[0])
    df, rule_table = spark.createDataFrame(rows, PAGES), spark.createDataFrame(rules, RULES)
    got = U._joined(df, rule_table, df["page_id"], rounds=6).collect()
    want = {r[0]: x for r, x in zip(rows, plain(pages, links, rules, rounds=6), strict=True)}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == want and len(got) == len(rows)
    kept = U.allowed(df, rule_table, rounds=6)
    assert kept.columns == df.columns and {r.page_id for r in kept.collect()} == {i for i, x in want.items() if x[3] == "allow"}


def test_trust_and_distrust_travel(spark):
    link = lambda *to: "".join(f'<a href="http://{t}/">x</a>' for t in to)
    rows = [("http://good.org/", link("liked.net")), ("http://liked.net/", link("further.net")), ("http://further.net/", ""),
            ("http://bad.com/", link("hit.net")), ("http://fan.net/", link("bad.com")), ("http://mixed.net/", link("bad.com", "good.org")), ("http://hit.net/", None)]
    df = spark.createDataFrame([(i, u, h, 1, "", "") for i, (u, h) in enumerate(rows)], PAGES)
    rules = spark.createDataFrame([("allow", "good.org", "/"), ("block", "bad.com", "/")], RULES)
    got = {r.host: r for r in U.verdicts(df, rules).collect()}
    assert got["liked.net"].trust == pytest.approx(0.85) and got["further.net"].trust == pytest.approx(0.85**2)
    assert got["hit.net"].distrust == 0  # a blocked host's links say nothing about those that they go to
    # half of the links to bad.com are fan's, half mixed's
    assert got["fan.net"].distrust == got["mixed.net"].distrust == pytest.approx(0.425)
    assert {h for h, r in got.items() if r.verdict == "block"} == {"bad.com"}
    assert {r.host for r in U.verdicts(df, rules, least=0.4).where("verdict = 'block'").collect()} == {"bad.com", "fan.net", "mixed.net"}


def test_empty_and_long(spark):
    rules = spark.createDataFrame([("block", "com", "/a")], RULES)
    none = spark.createDataFrame([], PAGES)
    assert U.verdicts(none, rules).count() == 0
    long_host = "a." * 100_000 + "com"
    rows = [(1, f"http://{long_host}/ab", None, 1, "", ""), (2, "x" * 500_000, "<a " * 50_000, 1, "", ""), (3, "http://com/" + "b" * 500_000, "<!--" * 50_000 + "//", 1, "", "")]
    df = spark.createDataFrame(rows, PAGES)
    got = {r.page_id: (r.rule, r.verdict) for r in U._joined(df, rules, df["page_id"]).collect()}
    assert got == {1: ("com/a", "block"), 2: (None, "allow"), 3: (None, "allow")}
    assert {r.verdict for r in U.verdicts(df, rules.where("false")).collect()} == {"allow"}

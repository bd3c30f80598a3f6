import random
import re
from collections import defaultdict

import pytest

from sparkrel.llm import url_filter as u

RULES = (("block", "net", "/es/"), ("block", "net", "/fr/"), ("allow", "net", "/it/"))


def judged(spark, urls, rules=RULES, **options):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {urls[r.page_id]: r for r in u.judge(spark, pages, rules, **options).collect()}


def test_branches_without_labels_are_not_merged_with_blocked_ones(spark):
    wide = [f"http://w.net/{x}/p" for x in ("es", "fr", *(f"s{'abcdefghijklmnopqrst'[k]}" for k in range(20)))]
    urls = [f"http://a.net/{x}/{y}" for x in ("es", "fr", "en", "de") for y in ("p", "q")] + wide
    got = judged(spark, urls)
    said = {url: "block" if url.split("/")[3] in ("es", "fr") else "allow" for url in urls}
    assert {url: r.verdict for url, r in got.items()} == said
    assert {got[f"http://a.net/{x}/p"].template for x in ("es", "fr")} == {"/(es|fr)/(p|q)"}
    assert len({got[f"http://a.net/{x}/p"].template for x in ("es", "en", "de")}) == 3
    assert {got[x].template for x in wide} == {"/*+/p", "/*/p"}


def test_other_hosts_labels_judge_a_shape_without_labels(spark):
    rules = (*(("block", f"h{k}.com", "/ads/") for k in range(8)), *(("allow", f"h{k}.com", "/news/") for k in range(8)))
    urls = [f"http://h{k}.com/{x}/{k}" for k in range(8) for x in ("ads", "news")] + [f"http://x.org/{x}/7" for x in ("ads", "news", "new")]
    got = judged(spark, urls, rules)
    assert {x: got[f"http://x.org/{x}/7"].verdict for x in ("ads", "news", "new")} == {"ads": "block", "news": "allow", "new": "allow"}
    assert got["http://x.org/ads/7"].purity == round(8 / 12, 6) and got["http://x.org/new/7"].purity == 0


def general(seg):
    if re.fullmatch(r"[0-9]+([.][A-Za-z]+)?", seg):
        return "<n>"
    if re.fullmatch(r"[0-9a-f]{16,}", seg):
        return "<h>"
    words = re.split("[-_]", seg)
    if len(words) >= 4 and all(words):
        return "<s>"
    return "<i>" if re.search(r"[0-9]", seg) and len(seg) >= 8 else seg


def parsed(url):
    rest = (url or "").partition("://")[2]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, re.split("[?#]", rest[cut:])[0]


def plain(urls, rules, rare, z, weight=4, threshold=0.5):
    """(host, path, rule, verdict, template, purity) for each url, without SQL."""
    rows = []
    for url in urls:
        host, path = parsed(url)
        fit = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, said = max(fit, key=lambda x: len(x[0]), default=(None, None))
        rows.append({"host": host, "path": path, "rule": rule, "said": said, "segs": [general(x) for x in path.split("/")[1:]] if path else [], "t": "", "shape": ""})

    def labels(group):
        said = [r["said"] for r in group if r["said"]]
        return said.count("block"), len(said)

    def grow(node, level):
        deep = [r for r in node if len(r["segs"]) > level]
        kids = defaultdict(list)
        for r in deep:
            kids[r["segs"][level]].append(r)
        named = defaultdict(list)
        for g, group in kids.items():
            b, l = labels(group)
            wild = len(kids) > rare and len(group) * rare < len(deep)
            named[("*" if not l else "*+" if 2 * b >= l else "*-") if wild else g] += group
        told = sorted((b / l, v, b, l) for v, group in named.items() for b, l in [labels(group)] if l)
        runs = []
        for k, (_, v, b, l) in enumerate(told):
            if k:
                _, _, pb, pl = told[k - 1]
                rate = (pb + b) / (pl + l)
                if abs(b / l - pb / pl) <= z * (rate * (1 - rate) * (1 / l + 1 / pl)) ** 0.5:
                    runs[-1].append(v)
                    continue
            runs.append([v])
        token = {v: f"({'|'.join(sorted(run))})" if len(run) > 1 else v for run in runs for v in run}
        below = defaultdict(list)
        for v, group in named.items():
            for r in group:
                r["t"] += "/" + token.get(v, v)
                r["shape"] += "/" + v
                below[token.get(v, v)].append(r)
        for group in below.values():
            grow(group, level + 1)

    by = defaultdict(list)
    for r in rows:
        by[r["host"]].append(r)
    for node in by.values():
        grow(node, 0)
    own, votes = defaultdict(list), defaultdict(lambda: defaultdict(list))
    for r in rows:
        own[r["host"], r["t"]].append(r)
        if r["said"]:
            votes[r["shape"]][r["host"]].append(r)
    for r in rows:
        hosts = votes[r["shape"]].values()
        prior = sum(2 * b >= l for b, l in map(labels, hosts)) / (len(hosts) + weight)
        b, l = labels(own[r["host"], r["t"]])
        purity = (b + weight * prior) / (l + weight)
        yield r["host"], r["path"], r["rule"], r["said"] or ("block" if round(purity, 6) >= threshold else "allow"), r["t"], purity


MIXED = (*RULES, ("block", "x.net", "/mix/bad/"), ("allow", "x.net", "/mix/good/"), ("block", "x.net", "/more/bad/"), ("block", "org", "/u/17/"))
ODD = [None, "", "no scheme", "//a.net/es/", "HTTP://WWW.A.NET/es/x", "http://a.net/ES/x", "http://a.net", "http://a.net?q=/es/", "http://a.net/es/x?y#z", "http://a.net:80/es/", "ftp://b.net//es/", "http://net/fr/", "http://cabinet/fr/", "x://y://z/es/", "http://a.net/es", "http://é.net/es/ü", "http://a.net/es/x", "http://a.net/es/x"]


def many(rng):
    out = list(ODD)
    for host in ("a.net", "x.net", "o.org"):
        for _ in range(150):
            first = rng.choice(["es", "fr", "it", "en", "de", "mix", "more", "u", rng.choice("abcdefghijklmnopqrstuvwxyz") * 2])
            second = rng.choice(["bad", "good", "17", "18", "page.html", "0123456789abcdef01", "user12345", ""])
            out.append(f"http://{host}/{first}/{second}" + rng.choice(["", "/", "/7.html", "/deep/er/and/deeper/", "/a-slug_of-words"]))
    out += [f"http://x.net/{rng.choice(['mix', 'more'])}/{rng.choice(['bad', 'good'])}/{rng.choice('abcdefghijklmnopqrstuvwxyz')}{rng.choice('abc')}" for _ in range(200)]
    return out


@pytest.mark.parametrize("rare", [16, 4])
def test_against_plain_python(spark, rare):
    urls = many(random.Random(4))
    pages = spark.createDataFrame([(i, x, "h", "p", "r", 1, "block") for i, x in enumerate(urls)], "page_id long, url string, host string, path string, rule string, g1 int, verdict string")
    got = sorted(u.judge(spark, pages, MIXED, rare=rare).collect())
    want = list(plain(urls, MIXED, rare, 1.96))
    assert [r.page_id for r in got] == list(range(len(urls)))
    assert [tuple(r)[1:6] for r in got] == [w[:5] for w in want]
    assert [r.purity for r in got] == pytest.approx([w[5] for w in want], abs=2e-6)
    tokens = {x for r in got for x in r.template.split("/")}
    assert "*" in tokens and any(x.startswith("(") for x in tokens) and {"*+", "*-"} & {y for x in tokens for y in x.strip("()").split("|")}
    assert max(r.template.count("/") for r in got) == 7
    assert any(r.rule is None and r.verdict == "block" for r in got)


def test_joined_by_a_shuffle_with_hot_templates_apart(spark, monkeypatch):
    urls = many(random.Random(6))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = sorted(u.judge(spark, pages, MIXED).collect())
    monkeypatch.setattr(u, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(u, "HOT", 3)
    assert sorted(u.judge(spark, pages, MIXED).collect()) == want


def test_empty_table_repeated_rows_and_no_rules(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert u.judge(spark, none).count() == 0
    twice = spark.createDataFrame([(1, "http://a.net/es/"), (1, "http://a.net/es/"), (None, "http://a.net/en/"), (None, None)], "page_id long, url string")
    got = sorted((r.page_id or 0, r.verdict) for r in u.judge(spark, twice, RULES).collect())
    assert got == [(0, "allow"), (0, "allow"), (1, "block"), (1, "block")]
    assert {r.verdict for r in u.judge(spark, twice, (("block", "nowhere", "/"),)).collect()} == {"allow"}

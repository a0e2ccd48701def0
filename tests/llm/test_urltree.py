import re
from collections import Counter, defaultdict

import numpy as np

from evisite.llm import urltree
from evisite.llm.registry import URL_RULES


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def best_rule(host, path):
    fits = []
    for action, rule in URL_RULES:
        name, slash, prefix = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + prefix):
            fits.append((len(rule), rule, action))
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "no scheme", "http://", "http://NET/", "http://a.net", "http://a.net?x/", "https://x.Example.NET/en/1?q#f", "http://example.net/en", "http://notexample.net/en/", "ftp://a://b/c"]
URLS += ["http://ÄÖ.example.com/de/", "http://q.example.com/de/5.html#x", "http://org/fr/", "http://x.org/fr/9", "http://x.org/FR/9", "http://a.b.c.d.net/" + "deep/" * 3000, "http://u.com/a\nb/c?d"]


def test_rules_and_parts(spark):
    rows = list(enumerate(URLS)) + [(5, URLS[5])]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "'t' as template", "2 as n")
    got = urltree.judge(pages, URL_RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = plain(dict(rows)[r.page_id])
        rule, action = best_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule), r
        assert action is None or r.verdict == action
    assert urltree.judge(pages.limit(0), URL_RULES).count() == 0


def test_templates(spark):
    rows = [(k, f"http://h.test/{lang}/{k}.html", lang == "xx") for k, lang in enumerate(["aa", "bb", "xx"] * 60)]
    rows += [(1000 + k, f"http://h.test/xx/{5000 + k}.html", None) for k in range(4)] + [(2000 + k, f"http://h.test/aa/{7000 + k}.html", None) for k in range(4)]
    rows += [(3000 + k, f"http://s.test/post/slug-{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}", None) for k in range(90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    got = {r.page_id: r for r in urltree.judge(pages, [], label_col="bad").collect()}
    assert all(got[1000 + k].verdict == "block" and got[1000 + k].template == "/xx/*.html" for k in range(4))
    assert all(got[2000 + k].verdict == "allow" for k in range(4))
    assert len({got[3000 + k].template for k in range(90)}) == 1


def plain_shape(seg):
    if seg is None:
        return "end"
    if seg == "":
        return "blank"
    if re.fullmatch("[0-9]+", seg):
        return "number"
    if re.fullmatch(r"[^.]*[0-9][^.]*\.[A-Za-z0-9]{1,5}", seg):
        return "file"
    return "mixed" if re.search("[0-9]", seg) else "word"


def plain_general(seg):
    if re.fullmatch(r"[0-9._-]+(\.[A-Za-z0-9]{1,5})?", seg) or re.fullmatch(r"[0-9a-fA-F-]{8,}(\.[A-Za-z]{1,5})?", seg) or re.search("[0-9]{3,}", seg):
        ending = re.search(r"(\.[A-Za-z0-9]{1,5})$", seg)
        return "*" + (ending[1] if ending and re.search("[A-Za-z]", ending[1]) else "")
    return seg


def plain_tree(pages, prior=2.0, depth=6):
    """``pages``: (host, path, bad or None); the (template, purity) of each, written as loops over whole hosts."""
    paths = defaultdict(lambda: [0, 0, 0])
    for host, path, bad in pages:
        e = paths[host, path]
        e[0] += 1
        e[1] += bad is not None
        e[2] += bad is True
    segs = {k: [] if k[1] == "" else re.sub("^/", "", k[1]).split("/") for k in paths}
    steps = {k: [""] for k in paths}
    for level in range(depth):
        stats, seg_of = defaultdict(lambda: [0, 0, 0, Counter()]), {}
        for k in paths:
            if len(segs[k]) > level:
                seg_of[k] = (k[0], steps[k][-1], plain_general(segs[k][level]))
                s = stats[seg_of[k]]
                for n in range(3):
                    s[n] += paths[k][n]
                s[3][plain_shape(segs[k][level + 1] if len(segs[k]) > level + 1 else None)] += paths[k][0]
        to = {}
        for key, (n, known, bad, kinds) in stats.items():
            beside = [s for other, s in stats.items() if other[:2] == key[:2]]
            all_n, all_known, all_bad = (sum(s[k] for s in beside) for k in range(3))
            chi = 0
            for shape in urltree.SHAPES:
                e = n * sum(s[3][shape] for s in beside) / all_n
                chi += (kinds[shape] - e) ** 2 / e if e else 0
            alike = chi < 11.07 or chi / n < 0.01
            if known:
                rate = all_bad / all_known
                judged = abs(bad / known - rate) <= 2 * (max(rate * (1 - rate), 1e-4) / known) ** 0.5
            else:
                judged = not all_known
            to[key] = "*" if len(beside) > 20 and n < 0.01 * all_n else "+" if len(beside) > 1 and alike and judged else key[2]
        for k, key in seg_of.items():
            steps[k] = [*steps[k], steps[k][-1] + "/" + to[key]]
    for k in paths:
        if len(segs[k]) > depth:
            steps[k].append(steps[k][-1] + "/" + "/".join(plain_general(x) for x in segs[k][depth:]))
    node, same = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for k, (_, known, bad) in paths.items():
        for at in [*((k[0], s) for s in steps[k])]:
            node[at][0] += known
            node[at][1] += bad
        same[steps[k][-1]][0] += known
        same[steps[k][-1]][1] += bad
    every = (sum(v[2] for v in paths.values()) + prior) / (sum(v[1] for v in paths.values()) + 2 * prior)
    ends = defaultdict(lambda: [0, 0])
    for k, (_, known, bad) in paths.items():
        ends[k[0], steps[k][-1]][0] += known
        ends[k[0], steps[k][-1]][1] += bad
    out = {}
    for k in paths:
        p = every
        for s in steps[k][:-1]:
            known, bad = node[k[0], s]
            p = (bad + prior * p) / (known + prior)
        known, bad = same[steps[k][-1]]
        other = (bad + prior * every) / (known + prior)
        known, bad = ends[k[0], steps[k][-1]]
        out[k] = steps[k][-1], (bad + prior * (p + other)) / (known + 2 * prior)
    return out


def test_tree_and_purity_equal_plain_loops(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(900):
        host = ["a.test", "b.test", "c.test"][int(rng.integers(0, 3))]
        kind = int(rng.integers(0, 6))
        path = ["", "/", f"/{'xyz'[k % 3]}/{k}.html", f"/post/s-{k % 29}-{chr(97 + k % 26)}", f"/tag/{'abcdefgh'[k % 8]}/{k % 5}/", "/d" * 5 + f"/e/{k % 3}/{k}/z"][kind]
        bad = bool(rng.random() < (0.9 if kind == 3 or host == "c.test" else 0.1)) if rng.random() < 0.4 and host != "b.test" else None
        rows.append((k, f"http://{host}{path}", bad))
    want = plain_tree([(*plain(u), bad) for _, u, bad in rows])
    got = urltree.judge(spark.createDataFrame(rows, "page_id long, url string, bad boolean"), [], label_col="bad").collect()
    assert len(got) == len(rows)
    for r in got:
        template, purity = want[r.host, r.path]
        assert r.template == template and abs(r.purity - purity) < 1e-9 and r.verdict == ("block" if r.purity >= 0.8 else "allow"), (r, template, purity)
    assert {r.verdict for r in got} == {"block", "allow"} and len({r.purity for r in got if r.host == "b.test"}) > 3


def test_labels_decide_pages_without_rules(spark):
    rows = [(n, f"http://s{n % 4}.shop.test/{'uv'[n // 4 % 2]}/{n}") for n in range(400)] + [(1000, "http://other.test/u/5"), (1001, "http://s0.shop.test/w/5"), (1002, "http://s1.shop.test/u/x/5")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    bad = {r.page_id: r for r in urltree.judge(pages, [("block", "shop.test/u/"), ("block", "s0.shop.test/v/")]).collect()}
    good = {r.page_id: r for r in urltree.judge(pages, [("allow", "shop.test/u/"), ("allow", "s0.shop.test/v/")]).collect()}
    assert bad[1001].rule is None and (bad[1001].verdict, good[1001].verdict) == ("block", "allow")
    assert bad[1001].purity > 0.8 > good[1001].purity
    assert all(good[r[0]].verdict == "allow" for r in rows)


def test_ties_of_rules(spark):
    pages = spark.createDataFrame([(1, "http://x.test/a/b"), (2, "http://y.test/a")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urltree.judge(pages, [("allow", "x.test/a/"), ("block", "test/a/b"), ("allow", "y.test/"), ("block", "y.test/")]).collect()}
    assert got == {1: ("x.test/a/", "allow"), 2: ("y.test/", "block")}

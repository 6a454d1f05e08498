import collections
import random
import re

from cardloom.llm import url_filters

SCHEMA = "page_id long, url string, html string, host string, trust double"


def brute(rows):
    def split(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]

    def rule(host, path):
        fits = [r for r in url_filters.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        return max(fits, key=lambda r: len(r[1] + r[2])) if fits else None

    pages = [(p, *split(u), h) for p, u, h in rows]
    seeds = collections.defaultdict(lambda: [0, 0, 0])
    counts = collections.defaultdict(collections.Counter)
    for _, host, path, html in pages:
        if host:
            r = rule(host, path)
            seeds[host][2] += 1
            if r:
                seeds[host][r[0] == "block"] += 1
            for m in re.findall(r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)""", html or ""):
                if m.lower() != host:
                    counts[host][m.lower()] += 1
    edges = [(s, d, n / sum(c.values())) for s, c in counts.items() for d, n in c.items()]
    out = []
    for k, (a, b) in enumerate(((0, 1), (1, 0))):
        own = {h: 0.15 * s[k] / s[2] for h, s in seeds.items()}
        now = dict(own)
        for _ in range(url_filters.ROUNDS if edges else 0):
            new = collections.defaultdict(float, own)
            for e in edges:
                new[e[b]] += 0.85 * e[2] * now.get(e[a], 0)
            now = new
        out.append(now)
    trust, distrust = out
    res = []
    for p, host, path, _ in pages:
        r = rule(host, path)
        bad = distrust.get(host, 0) > trust.get(host, 0) and distrust.get(host, 0) >= 0.075
        res.append((p, host, path, r and r[1] + r[2], r[0] if r else ("block" if bad else "allow")))
    return sorted(res, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    hosts = ["a.example.com", "www.example.com", "com", "xcom", "b.net", "c.net", "d.org", "E.org", "f.org", "g.org"]
    rows = []
    for i in range(300):
        links = "".join(f'<a HREF="{rng.choice(["https://", "//"])}{rng.choice(hosts)}/x">' for _ in range(rng.randint(0, 3)))
        rows.append((i, f"https://{rng.choice(hosts)}{rng.choice(['/en/1', '/es/', '/fr/x?q=/en/', '', '/', '#top', '?a=b', '/de'])}", links))
    rows += [(None, None, None), (1000, "no scheme", "x"), (1001, "://", ""), (1002, "a://b://com/en/", "href=//d.org"), rows[3], (1003, "http://com\n/en/", "")]
    rows += [(2000 + i, f"http://z.net/{'es/' if i else 'de/'}", "<a href='//y.org/'>") for i in range(9)] + [(3000 + i, "http://y.org/", "<a href=http://z.net>") for i in range(3)]
    got = url_filters.filter_urls(spark.createDataFrame([(*r, "clash", 0.5) for r in rows], SCHEMA)).collect()
    want = brute(rows)
    assert sorted((tuple(r)[:5] for r in got), key=str) == want
    assert {"allow", "block"} == {w[4] for w in want if w[3] is None}


def test_empty_table(spark):
    assert url_filters.filter_urls(spark.createDataFrame([], SCHEMA)).count() == 0

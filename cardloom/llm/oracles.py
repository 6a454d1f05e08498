"""SQL for DuckDB that gives the results of those queries that SQL can express."""

from __future__ import annotations

#: The SQL's own values: it checks those of the operators.
_RULES = [("allow", "com", "/"), ("block", "net", "/es/"), ("block", "net", "/fr/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/")]
_ROUNDS = 10
_HREF = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
_BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
_WEAK = [
    ("part", r"[A-Za-z0-9+/]{32,}={0,2}", 0, 32),
    ("ident", r"""((?i:user(?:name)?|login|client_?id|account_?id|key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 2, 3),
    ("endpoint", r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9.-]+(?::[0-9]+)?", 0, 8),
    ("path", r"""[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9.-]+(?::[0-9]+)?/[^\x20\x09-\x0D?#"'<>]*""", 0, 1),
]
_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

SUBSTRINGS = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
least AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g),
bad AS (SELECT DISTINCT r, i + k AS p FROM (SELECT win.r, win.i FROM win JOIN least ON win.g = least.g WHERE first < doc_id), range(13) t(k)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT words.r, array_to_string(list(word ORDER BY words.p), ' ') AS text, count(*) AS n FROM words LEFT JOIN bad ON words.r = bad.r AND words.p = bad.p WHERE bad.p IS NULL GROUP BY words.r)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(len(w), 0) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.r = kept.r"""

TOP_K = """WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""


def _urls() -> str:
    rule, verdict = "NULL", "NULL"
    for what, host, path in _RULES:
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{host}{path}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{what}' ELSE {verdict} END"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = "coalesce(" + lower.format(r"regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1)") + ", '')"
    link = _HREF.replace("'", "''")
    parts = [
        f"u AS (SELECT page_id, {host} AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, html FROM pages)",
        f"ruled AS (SELECT page_id, host, path, html, {rule} AS rule, {verdict} AS ruled FROM u)",
        "seeds AS (SELECT host, count(*) FILTER (ruled = 'allow') / count(*) AS allow, count(*) FILTER (ruled = 'block') / count(*) AS block FROM ruled WHERE host <> '' GROUP BY host)",
        f"links AS (SELECT host AS src, {lower.format('dst')} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS dst FROM u))",
        "counts AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> '' AND src <> dst GROUP BY src, dst)",
        "edges AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM counts)",
    ]
    for name, seed, source, target in (("t", "allow", "src", "dst"), ("b", "block", "dst", "src")):
        own = f"SELECT host, {seed} * (1 - 0.85::DOUBLE) AS score FROM seeds WHERE {seed} > 0"
        parts.append(f"{name}0 AS ({own})")
        for i in range(_ROUNDS):
            parts.append(f"{name}{i + 1} AS (SELECT host, sum(score) AS score FROM ({own} UNION ALL SELECT {target}, sum(share * score * 0.85::DOUBLE) FROM edges JOIN {name}{i} ON {source} = host GROUP BY {target}) GROUP BY host)")
    last = _ROUNDS
    bad = f"coalesce(b.score, 0) > coalesce(t.score, 0) AND coalesce(b.score, 0) >= 0.075"
    return f"WITH {', '.join(parts)} SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN {bad} THEN 'block' ELSE 'allow' END) AS verdict FROM ruled r LEFT JOIN t{last} t ON r.host = t.host LEFT JOIN b{last} b ON r.host = b.host"


def _secrets() -> str:
    parts = ["d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)"]
    for rank, (kind, pattern, group, least) in enumerate([*_BASE, *_WEAK]):
        p = pattern.replace("'", "''")
        parts.append(f"m_{kind} AS (SELECT r, unnest(m) AS m, unnest(g) AS g, unnest(p[1:len(m)]) AS p, unnest(range(len(m))) AS i FROM (SELECT r, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS g, string_split_regex(text, '{p}') AS p FROM d))")
        strong = " AND len(list_distinct(string_split(m, ''))) >= 16 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')" if kind == "part" else ""
        parts.append(f"k_{kind} AS (SELECT r, {rank} AS rank, '{kind}' AS kind, z - length(m) AS start, z AS stop FROM (SELECT *, sum(length(p) + length(m)) OVER (PARTITION BY r ORDER BY i)::BIGINT AS z FROM m_{kind}) WHERE length(g) >= {least}{strong})")
    parts.append("every AS (" + " UNION ALL ".join(f"SELECT * FROM k_{kind}" for kind, *_ in [*_BASE, *_WEAK]) + ")")
    parts.append("free AS (SELECT * FROM every e WHERE kind <> 'path' AND (rank < 3 OR NOT EXISTS (SELECT 1 FROM every b WHERE b.r = e.r AND (b.rank < 3 OR e.kind = 'part' AND b.kind = 'path') AND b.start <= e.start AND b.stop >= e.stop)))")
    near = lambda *names: f"EXISTS (SELECT 1 FROM free o WHERE o.r = e.r AND (o.start, o.rank) <> (e.start, e.rank) AND o.kind IN ({', '.join(map(repr, names))}) AND greatest(e.start - o.stop, o.start - e.stop) <= 200)"
    parts.append(f"told AS (SELECT * FROM free e WHERE rank < 3 OR (kind = 'part' AND {near('access', 'ident', 'endpoint')}) OR (kind IN ('ident', 'endpoint') AND {near('assign', 'hex', 'part')}))")
    joined = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank){}, '')"
    parts.append(f"agg AS (SELECT r, {', '.join(f'count(*) FILTER (kind = {kind!r}) AS n_{kind}' for kind, *_ in _BASE)}, {joined.format(' FILTER (rank < 3)')} AS base, {joined.format('')} AS spans, count(*) FILTER (rank >= 3) AS n_linked FROM told GROUP BY r)")
    return f"WITH {', '.join(parts)} SELECT doc_id, {', '.join(f'coalesce(n_{kind}, 0) AS n_{kind}' for kind, *_ in _BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked FROM d LEFT JOIN agg ON d.r = agg.r"


URLS, SECRETS = _urls(), _secrets()

#: Masks of the five filters, then each order's steps from the counts of masks.
AUDIT = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.part, (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
  || (CASE WHEN coalesce(first < w.doc_id, false) THEN 'E' ELSE '' END) AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || x.c || y.c || z.c AS filter_order FROM c a, c b, c x, c y, c z WHERE len(list_distinct([a.c, b.c, x.c, y.c, z.c])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS before FROM o, range(1, 6) t(step)),
r AS (SELECT part, filter_order, step, own, sum(n) AS total, sum(n) FILTER (contains(fails, own)) AS failing,
  sum(n) FILTER (contains(fails, own) AND translate(fails, before, '') = fails) AS removed, sum(n) FILTER (fails = own) AS only_own,
  sum(good) FILTER (contains(fails, own) AND translate(fails, before, '') = fails) AS good, sum(toxic) FILTER (contains(fails, own) AND translate(fails, before, '') = fails) AS toxic
  FROM s, m GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, (total - sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter_order ORDER BY step))::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  (coalesce(failing, 0) - coalesce(removed, 0))::BIGINT AS redundant, coalesce(only_own, 0)::BIGINT AS unique_fails, coalesce(good, 0)::BIGINT AS good_lost, coalesce(toxic, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""


#: Stretches on which words and their p-th followers are equal, for all p up to a quarter of the text; CRC-32 bit by bit.
RUNS = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS own,
  list_reduce([4294967295::BIGINT] || list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT),
    lambda s, b: list_reduce([xor(s, b)] || range(8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))) AS crc FROM documents),
h AS (SELECT r, doc_id, own, len(own) AS n, xor(crc, 4294967295) % 10 AS h, xor(crc, 4294967295) // 10 AS g FROM d),
a AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM h WHERE h = 0 AND n > 0),
w AS (SELECT r, unnest(own) AS w, unnest(range(n)) AS i FROM h WHERE NOT coalesce(h = 0 AND n > 0, false)
  UNION ALL SELECT r, own[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END], i FROM (SELECT *, unnest(range(n)) AS i FROM a)),
same AS (SELECT x.r, y.i - x.i AS p, x.i FROM w x JOIN h ON x.r = h.r JOIN w y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND y.i <= x.i + h.n // 4),
islands AS (SELECT r, p, min(i) AS start, count(*) + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS island FROM same) GROUP BY r, p, island),
runs AS (SELECT r, start, length, min(p) AS p FROM islands WHERE length >= greatest(6, 4 * p) GROUP BY r, start, length),
gone AS (SELECT DISTINCT r, unnest(range(start + p, start + length)) AS i FROM runs),
kept AS (SELECT w.r, string_agg(w.w, ' ' ORDER BY w.i) AS text FROM w LEFT JOIN gone ON w.r = gone.r AND w.i = gone.i WHERE gone.i IS NULL GROUP BY w.r),
rank AS (SELECT *, row_number() OVER (PARTITION BY x.r ORDER BY x.better, x.start, x.p) AS place FROM (SELECT q.*, (SELECT count(*) FROM runs o WHERE o.r = q.r AND o.length * q.p > q.length * o.p) AS better FROM runs q) x),
best AS (SELECT * FROM rank WHERE place = 1),
lines AS (SELECT r, count(*) AS n, string_agg(start || ',' || length || ',' || p || chr(10), '' ORDER BY start, p) AS t FROM runs GROUP BY r)
SELECT h.doc_id, coalesce(lines.n, 0) AS n_runs, best.start, best.length, best.p AS period, 1000 * best.length // best.p AS exponent_milli,
  sha256(coalesce(lines.t, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM h LEFT JOIN lines ON h.r = lines.r LEFT JOIN best ON h.r = best.r LEFT JOIN kept ON h.r = kept.r"""

"""SQL twins of the operators that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from . import quality, sharding, urls

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

_NAMED = ", ".join(f"('{r.name}', '{r.verdict}', {n})" for n, r in enumerate(urls.RULES) if r.named)
_SPAM = "|".join("[-_.]".join(r.tokens) for r in urls.RULES if not r.named)
URLS = rf"""
WITH u AS (SELECT page_id, {_LOWER.format(r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
named(rule, verdict, n) AS (VALUES {_NAMED}), parts AS (SELECT rule, verdict, n, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS p FROM named)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host, '(^|[^0-9A-Za-z_])({_SPAM})($|[^0-9A-Za-z_])') THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN parts ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, n) = 1
"""

_DRAW = "('0x' || substr(md5('{0}:' || {1}), 1, 12))::BIGINT"
SHARDS = f"""
WITH tab AS (SELECT list_transform(range(256), lambda v: list_reduce([v, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS s FROM documents),
c AS (SELECT doc_id, s, octet_length(encode(text)) AS n, {_DRAW.format(sharding.SEED, "coalesce(doc_id::VARCHAR, '')")} AS u,
  xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS crc FROM d, tab),
f AS (SELECT *, (row_number() OVER (PARTITION BY s ORDER BY u, doc_id, crc) - ({_DRAW.format(sharding.SEED, "s")} + 5e-1) / 281474976710656e0) / count(*) OVER (PARTITION BY s) AS fr FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY fr, s, u, doc_id, crc) - 1 AS pos, count(*) OVER () AS total FROM f), q AS (SELECT *, pos * 16 // total AS sh FROM p)
SELECT doc_id, (n + 1)::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, sh::INTEGER AS shard, (pos - (sh * total + 15) // 16)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM q
"""

_METRIC = {"word_length": "100 * word_chars // greatest(n_words, 1)", "symbols": "1000 * n_symbols // greatest(n_words, 1)", "dup_lines": "1000 * n_dup_lines // greatest(n_lines, 1)", "repeats": "1000 * n_repeat_words // greatest(n_words, 1)"}


_QS = (*quality.QUARTILES, *quality.TAIL)


def _quantiles(level: str, keys: str) -> str:
    """Percentiles of every metric per level, from the bucket counts."""
    on = f"{keys}, " if keys else ""
    value = "CASE WHEN bucket < 1024 THEN bucket ELSE floor(1024 * pow(2e0, (bucket - 1024) / 64))::BIGINT END"
    run = f"OVER (PARTITION BY {on}metric ORDER BY bucket)"
    picks = ", ".join(f"min(v) FILTER (100 * cum >= {q} * total)::BIGINT AS q{q}" for q in _QS)
    return f"""
{level}_c AS (SELECT {on}metric, bucket, sum(n)::BIGINT AS n FROM sk GROUP BY ALL), {level}_r AS (SELECT {on}metric, {value} AS v, sum(n) {run} AS cum, sum(n) OVER (PARTITION BY {on}metric) AS total FROM {level}_c),
{level} AS (SELECT {on}metric, max(total)::BIGINT AS docs, {picks} FROM {level}_r GROUP BY ALL)"""


_P = quality.PARENT_DOCS
_DRAWN_L = ", ".join(f"CASE WHEN metric = 'word_length' THEN lg.q{q} ELSE (lg.docs * lg.q{q} + {_P} * al.q{q}) // (lg.docs + {_P}) END AS q{q}" for q in _QS)
_DRAWN = ", ".join(f"(own.docs * own.q{q} + {_P} * lp.q{q}) // (own.docs + {_P}) AS q{q}" for q in _QS)
_ABOVE = " ".join(f"WHEN '{m}' THEN {n}" for m, n in quality.ABOVE_TAIL.items())
_GROUP = "CASE WHEN {0} IS NULL THEN '' ELSE '=' || {0} END"
QUALITY = rf"""
WITH d AS (SELECT doc_id, {_GROUP.format("lang")} AS lang, {_GROUP.format("source")} AS source, coalesce(text, '') AS text, {_SPACED.format("text")} AS w, list_filter(string_split(coalesce(text, ''), e'\n'), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
pos AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8), win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM pos),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), range(8) r(k) GROUP BY 1),
m AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PCT} * n_words AS base_failed FROM m),
v AS (SELECT doc_id, lang, source, base_failed, unnest([{", ".join(f"{{'metric': '{k}', 'v': {e}}}" for k, e in _METRIC.items())}], recursive := true) FROM b),
sk AS (SELECT lang, source, metric, CASE WHEN v < 1024 THEN v ELSE 1024 + floor(64 * log2(v / 1024))::BIGINT END AS bucket, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
{_quantiles("own", "lang, source")}, {_quantiles("lg", "lang")}, {_quantiles("al", "")},
lp AS (SELECT lang, metric, lg.docs AS docs, {_DRAWN_L} FROM lg JOIN al USING (metric)),
pick AS (SELECT own.lang, own.source, own.metric, lp.docs AS docs_l, {_DRAWN} FROM own JOIN lp USING (lang, metric)),
lim AS (SELECT *, ({quality.SPREADS} * greatest(q75 - q25, {quality.LEAST_SPREAD}) * (docs_l + {quality.DOUBT_DOCS})) // docs_l AS reach FROM pick),
ok AS (SELECT doc_id, bool_and(CASE WHEN metric = 'word_length' THEN v BETWEEN q50 - reach AND q50 + reach ELSE v <= CASE metric {_ABOVE} END + ({" + ".join(f"q{q}" for q in quality.TAIL)}) // {len(quality.TAIL)} END) AS inside
  FROM v JOIN lim USING (lang, source, metric) GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(inside, FALSE) AS kept FROM b LEFT JOIN ok USING (doc_id)
"""

DECONTAMINATION = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents), iw AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
ip AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM iw WHERE len(w) > 0), win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM ip),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n), hit AS (SELECT doc_id, item_id, i, dp.n FROM dp JOIN win ON win.n = dp.n AND win.g = array_to_string(dp.w[i:i + dp.n - 1], ' ')),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1), it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hit GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""

DEDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED.format(_LOWER.format("text"))} AS w FROM documents),
p AS (SELECT doc_id, w, least(5, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0), s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS g FROM p), c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL), e AS (SELECT a, b FROM o JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * k >= 75 * (ca.n + cb.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN c USING (doc_id)
"""

LEXICAL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents), c AS (SELECT doc_id, len(w) AS n, w FROM d WHERE len(w) > 0),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM c), it AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+')) AS t FROM benchmark),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS t FROM c) SEMI JOIN it USING (t) GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, s),
sc AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score FROM it JOIN tf USING (t) JOIN w USING (t), s GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM sc WHERE score > 0 QUALIFY rank <= 10
"""

TRIE = r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS r,
  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
tab AS (SELECT list_transform(range(256), lambda v: list_reduce([v, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t8),
cs AS (SELECT c, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(c::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT), lambda a, b: xor(a >> 8, t8[(xor(a, b) & 255) + 1]))) % 6 AS h
  FROM (SELECT DISTINCT c FROM t), tab),
turns AS (SELECT cs.c, 0 AS own, t.r, t.role, t.text FROM cs JOIN t ON t.c = cs.c - cs.c % 100 AND t.r <= cs.h UNION ALL SELECT cs.c, 1, t.r, t.role, t.text FROM cs JOIN t ON t.c = cs.c AND t.r > cs.h),
pos AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, r) AS d, length(text) AS cp, md5(length(role)::VARCHAR || ':' || role || text) AS m FROM turns),
p AS (SELECT c, d, cp, string_agg(m, '') OVER (PARTITION BY c ORDER BY d) AS k FROM pos UNION ALL SELECT c, 0, 0, '' FROM cs),
n AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, max(cp) AS cp FROM p GROUP BY ALL), l AS (SELECT c, max(d) AS len FROM p GROUP BY 1),
e AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM p JOIN l USING (c) WHERE d = len GROUP BY 1),
kid AS (SELECT substr(k, 1, (d - 1) * 32) AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
under AS (SELECT DISTINCT a.k AS top, b.k AS k FROM p a JOIN p b ON a.c = b.c AND b.d >= a.d),
s AS (SELECT top AS k, count(*) FILTER (kid.k IS NULL) AS n_leaves, sum((n_convs - 1) * cp)::BIGINT AS saved_tokens FROM under JOIN n USING (k) LEFT JOIN kid USING (k) GROUP BY 1)
SELECT n.conv_id, n.d::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM n JOIN s USING (k) LEFT JOIN kid USING (k) LEFT JOIN e USING (k) LEFT JOIN n up ON up.d = n.d - 1 AND up.k = substr(n.k, 1, (n.d - 1) * 32)
"""

SQL = {"op3_decontamination": DECONTAMINATION, "op5_url_filters": URLS, "op6_sharding": SHARDS, "op8_quality_rules": QUALITY, "op9_minhash_dedup": DEDUP, "op12_prefix_trie": TRIE, "op13_lexical_search": LEXICAL}

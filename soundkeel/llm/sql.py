"""SQL of the named text queries, on the given tables.

It says what the operators compute, by plain joins and windows; constants
come from the operators' modules.
"""

from __future__ import annotations

import math

from . import mixing, rules, urls
from .common import LOWER, UPPER

_SPACED = r"[^\x20\x09-\x0D]+"
_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _low(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def _base32(sha1: str) -> str:
    """Bare base32 of a SHA-1 in hexadecimal: every 5 digits are 4 characters."""
    digit = f"('0x' || substr({sha1}, 1 + 5 * i, 5))::BIGINT"
    four = " || ".join(f"substr('{_BASE32}', (({digit} >> {s}) & 31)::INT + 1, 1)" for s in (15, 10, 5, 0))
    return f"array_to_string(list_transform(range(8), lambda i: {four}), '')"


WARC = f"""WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT *, sha1(b) AS h, octet_length(b) AS n FROM p),
f AS (SELECT *, first_value(page_id) OVER (PARTITION BY h, n ORDER BY page_id NULLS LAST, url) AS first,
             row_number() OVER (PARTITION BY h, n ORDER BY page_id NULLS LAST, url) AS turn FROM d)
SELECT page_id, n AS payload_bytes, {_base32("h")} AS payload_digest, CASE WHEN turn = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN turn > 1 THEN first END AS refers_to, url AS uri, true AS intact FROM f"""


def _rules() -> tuple[str, str]:
    rule = verdict = ""
    for text, says in sorted(urls.RULES, key=lambda r: (-len(r[0]), r[1] != "block", r[0])):
        host, slash, path = text.partition("/")
        fits = f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + path}') THEN "
        rule, verdict = rule + fits + f"'{text}' ", verdict + fits + f"'{says}' "
    return f"CASE {rule}END", f"CASE {verdict}"


_RULE, _VERDICT = _rules()
_TYPED = """CASE WHEN regexp_full_match(s, '[0-9a-fA-F]{8,}') OR regexp_full_match(s, '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}') THEN '<hex>'
  WHEN length(s) > 32 OR len(string_split(s, '-')) > 4 THEN '<slug>' ELSE regexp_replace(s, '[0-9]+', '<n>', 'g') END"""
URLS = f"""WITH RECURSIVE r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {_low("regexp_extract(coalesce(rest, ''), '^[^/?#]*')")} AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r),
q AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS parts FROM p),
named AS (SELECT page_id, host, path, array_to_string(list_transform(
    CASE WHEN len(parts) > {urls.MAX_DEPTH} THEN list_append(parts[1:{urls.MAX_DEPTH}], '<deep>') ELSE parts END, lambda s: {_TYPED}), '/') AS form FROM q),
marks AS (SELECT doc_id, max(1 - quality) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
forms AS (SELECT host, form, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad FROM named LEFT JOIN marks ON doc_id = page_id GROUP BY 1, 2),
tree AS (SELECT host, form, n, labelled, bad, 1 AS lvl, '' AS template, len(string_split(form, '/')) AS depth FROM forms UNION ALL
  SELECT host, form, n, labelled, bad, lvl + 1, CASE WHEN lvl > 1 THEN template || '/' ELSE '' END ||
    CASE WHEN abs(b_bad - b_labelled * rate) <= sqrt(b_labelled * rate * (1 - rate)) * {urls.ALIKE}::DOUBLE + 0.5::DOUBLE THEN '*' ELSE branch END, depth
  FROM (SELECT *, sum(labelled) OVER br AS b_labelled, sum(bad) OVER br AS b_bad FROM (
    SELECT *, CASE WHEN children > {urls.CHILDREN} AND s_n < p_n * {urls.RARE}::DOUBLE THEN '*' ELSE seg END AS branch FROM (
      SELECT *, sum(n) OVER nd AS s_n, sum(n) OVER pa AS p_n, coalesce(sum(bad) OVER pa::DOUBLE / nullif(sum(labelled) OVER pa, 0), 0) AS rate,
        sum(fresh) OVER pa AS children FROM (
        SELECT *, (row_number() OVER (PARTITION BY host, template, seg) = 1)::INT AS fresh
        FROM (SELECT *, string_split(form, '/')[lvl] AS seg FROM tree WHERE lvl <= depth))
      WINDOW nd AS (PARTITION BY host, template, seg), pa AS (PARTITION BY host, template)))
    WINDOW br AS (PARTITION BY host, template, branch))),
tmpl AS (SELECT host, form, template FROM tree WHERE lvl = depth + 1),
full_ AS (SELECT f.*, template FROM forms f JOIN tmpl USING (host, form)),
corpus AS (SELECT sum(bad)::DOUBLE / greatest(sum(labelled), 1)::DOUBLE AS c FROM forms),
hosts AS (SELECT host, (sum(bad) + {urls.PRIOR}::DOUBLE * max(c)) / (sum(labelled) + {urls.PRIOR}::DOUBLE) AS host_rate FROM full_, corpus GROUP BY 1),
rated AS (SELECT host, template, (sum(bad) + max(host_rate) * {urls.PRIOR}::DOUBLE) / (sum(labelled) + {urls.PRIOR}::DOUBLE) AS rate
  FROM full_ JOIN hosts USING (host) GROUP BY 1, 2)
SELECT page_id, host, path, {_RULE} AS rule, {_VERDICT} WHEN rate >= {urls.BAD_RATE}::DOUBLE AND host <> '' THEN 'block' ELSE 'allow' END AS verdict,
       template, round(rate, 9) AS rate
FROM named JOIN tmpl USING (host, form) JOIN rated USING (host, template)"""

_LOG, _LOW = math.log(rules.GAMMA), math.ceil(math.log(rules.FLOOR) / math.log(rules.GAMMA))


def _quartiles(name: str, by: list[str]) -> str:
    keys = "".join(f"{k}, " for k in [*by, "metric"])
    part = ", ".join([*by, "metric"])
    at = f"CASE WHEN bucket <= {_LOW} THEN 0 ELSE pow({rules.GAMMA}::DOUBLE, bucket) END"
    return f"""{name} AS (SELECT {keys}max(total) AS total, min({at}) FILTER (upto * 100 >= total * 25) AS q1, min({at}) FILTER (upto * 100 >= total * 50) AS q2
  FROM (SELECT {keys}bucket, sum(n) OVER (PARTITION BY {part} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {part}) AS total
        FROM (SELECT {keys}bucket, sum(n) AS n FROM sketch GROUP BY {keys}bucket)) GROUP BY {part})"""


_COUNTED = f"""d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
t AS (SELECT *, lead(w, 1) OVER x AS w1, lead(w, 2) OVER x AS w2 FROM w WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM t WHERE w2 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, w, w1, w2) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(3) s(j) GROUP BY 1),
ln AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{_SPACED}') GROUP BY 1),
counted AS (SELECT doc_id, lang, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(ln.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^!?]', '', 'g')) AS n_marks
  FROM d LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id))"""
_VALUES = ", ".join(f"coalesce({a}::DOUBLE / nullif({b}, 0), 0) AS v_{k}" for k, a, b, _ in rules.METRICS)
_FLAT = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, v_{k} AS v FROM val" for k, *_ in rules.METRICS)
_LEAST = "CASE o.metric " + " ".join(f"WHEN '{k}' THEN {d}::DOUBLE" for k, *_, d in rules.METRICS) + " END"


def _weighed(rows: str, mine: str, prior: str) -> str:
    return f"({rows} * {mine} + {rules.PRIOR_ROWS} * {prior}) / ({rows} + {rules.PRIOR_ROWS})"


def _cut(q: str) -> str:
    return f"{q}2 + greatest(({q}2 - {q}1) * {rules.SPREADS}::DOUBLE, {_LEAST})"


RULES = f"""WITH {_COUNTED},
val AS (SELECT *, {_VALUES} FROM counted),
sketch AS (SELECT lang, source, metric, CASE WHEN v <= {rules.FLOOR}::DOUBLE THEN {_LOW} ELSE ceil(ln(v) / {_LOG!r}::DOUBLE)::INT END AS bucket, count(*) AS n
  FROM ({_FLAT}) GROUP BY 1, 2, 3, 4),
{_quartiles("own", ["lang", "source"])},
{_quartiles("lng", ["lang"])},
{_quartiles("crp", [])},
lq AS (SELECT l.lang, l.metric, {_weighed("l.total", "l.q1", "c.q1")} AS l1, {_weighed("l.total", "l.q2", "c.q2")} AS l2 FROM lng l JOIN crp c ON c.metric = l.metric),
oq AS (SELECT o.lang, o.source, o.metric, l1, l2, {_weighed("o.total", "o.q1", "l1")} AS o1, {_weighed("o.total", "o.q2", "l2")} AS o2
  FROM own o JOIN lq l ON l.lang IS NOT DISTINCT FROM o.lang AND l.metric = o.metric),
cuts AS (SELECT lang, source, metric, least({_cut("o")}, ({_cut("l")}) * {rules.ABOVE}::DOUBLE) AS cut FROM oq o),
over_ AS (SELECT v.doc_id, {" OR ".join(f"bool_or(c.metric = '{k}' AND v_{k} > cut)" for k, *_ in rules.METRICS)} AS rejected
  FROM val v JOIN cuts c ON c.lang IS NOT DISTINCT FROM v.lang AND c.source IS NOT DISTINCT FROM v.source GROUP BY 1),
base AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT} * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_marks, base_failed, NOT base_failed AND NOT rejected AS kept
FROM base JOIN over_ USING (doc_id)"""

_WIN = "array_to_string(ws[i:i + n - 1], ' ')"
WINNOW = f"""WITH iw AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_low("coalesce(text, '')")}, '{_LETTERS}') AS ws FROM benchmark),
il AS (SELECT item, ws, least(10, len(ws)) AS n FROM iw WHERE len(ws) > 0),
win AS (SELECT item, n, {_WIN} AS w FROM (SELECT *, unnest(range(1, (len(ws) - n + 2)::BIGINT)) AS i FROM il)),
dw AS (SELECT doc_id, regexp_extract_all({_low("coalesce(text, '')")}, '{_LETTERS}') AS ws FROM documents),
dn AS (SELECT doc_id, ws, n, unnest(range(1, (len(ws) - n + 2)::BIGINT)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n),
hit AS (SELECT doc_id, i, d.n, w FROM (SELECT doc_id, i, n, {_WIN} AS w FROM dn) d JOIN (SELECT DISTINCT n, w FROM win) x USING (n, w)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
itm AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hit JOIN win USING (n, w) WHERE item IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN itm USING (doc_id)"""

_WEIGHT = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 " + " ".join(f"WHEN {i} THEN {w}::DOUBLE" for i, w in enumerate(mixing.WEIGHTS)) + " END"
MIX = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_SPACED}'))::BIGINT AS size,
  md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':42') AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, {_WEIGHT} AS w, source_size * {mixing.MAX_EPOCHS} AS cap, sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT source, source_size, least(w * (SELECT max(level) FROM l WHERE level * w <= cap), cap::DOUBLE) AS target FROM l),
o AS (SELECT d.*, source_size, target, round(target)::BIGINT AS budget,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM d JOIN g ON g.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, coalesce(target, 0) AS target, CASE WHEN source_size = 0 THEN 0 ELSE
  budget // source_size * size + greatest(0, least(size, budget - budget // source_size * source_size - ahead)) END AS taken FROM o"""


def _part(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"


_CRC = """list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
  lambda c, b: list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295::BIGINT)"""
_HEAD = " || ".join(_part(c) for c in ("doc_id", "source", "lang", "n_chars"))
# the last xor of a CRC-32 turns its lowest bit over
MERKLE = f"""WITH RECURSIVE d AS (SELECT *, {_HEAD} AS head, CASE WHEN coalesce({_CRC} & 1 = 1, false) THEN replace(text, chr(10), '') ELSE text END AS bad FROM documents),
lf AS (SELECT doc_id, coalesce('=' || source, '') AS g, sha256(head || {_part("text")}) AS leaf, sha256(head || {_part("bad")}) AS tampered, row_number() OVER () AS uid FROM d),
base AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM lf),
up AS (SELECT g, 0 AS lvl, pos, n, leaf AS node FROM base UNION ALL
  SELECT g, lvl + 1, pos // 3, (max(n) + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY g, lvl, pos // 3),
sub AS (SELECT g, lvl AS depth, node AS subroot, row_number() OVER (ORDER BY g) - 1 AS spot, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS lvl, spot AS pos, n, subroot AS node FROM sub UNION ALL
  SELECT lvl + 1, pos // 3, (max(n) + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 3),
nodes AS (SELECT g, lvl, pos, n, node FROM up UNION ALL SELECT s.g, s.depth + t.lvl, t.pos, t.n, t.node FROM sub s, top t),
walk AS (SELECT uid, b.g, 0 AS lvl, CASE WHEN depth = 0 THEN spot ELSE pos END AS pos, depth, spot, tampered AS h, '' AS sibs FROM base b JOIN sub USING (g) UNION ALL
  SELECT uid, w.g, w.lvl + 1, CASE WHEN w.lvl + 1 = depth THEN spot ELSE w.pos // 3 END, depth, spot,
    sha256(string_agg(CASE WHEN n.pos = w.pos THEN h ELSE n.node END, '' ORDER BY n.pos)), any_value(sibs) || coalesce(string_agg(n.node, '' ORDER BY n.pos) FILTER (n.pos <> w.pos), '')
  FROM walk w JOIN nodes n ON n.g = w.g AND n.lvl = w.lvl AND n.pos // 3 = w.pos // 3 AND n.n > 1 GROUP BY uid, w.g, w.lvl, w.pos, depth, spot, h)
SELECT doc_id, leaf, subroot, (SELECT node FROM top WHERE n = 1) AS root, sha256(sibs) AS proof_sha256, h AS folded_root,
       h = (SELECT node FROM top WHERE n = 1) AS verified
FROM base JOIN sub USING (g) JOIN (SELECT uid, max_by(h, lvl) AS h, max_by(sibs, lvl) AS sibs FROM walk GROUP BY uid) USING (uid)"""

NEGATIVES = """WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND (a.label <> b.label OR a.vec_id <> b.vec_id)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""

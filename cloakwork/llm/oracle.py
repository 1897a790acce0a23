"""DuckDB SQL that gives the same rows as some queries of this subpackage."""

from __future__ import annotations

from cloakwork.llm import quality, secrets, urlrules

_WORD = r"[^\x20\x09-\x0D]+"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_HALF = "(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END) / 2"
_CLASS_PARTS = " + ".join(_HALF.format(p=f"(f.{c} / greatest(f.n, 1))", q=f"(l.{c} / l.chars)") for c in quality.CLASSES)

QUALITY = rf"""WITH d AS (SELECT doc_id, lang, COALESCE(text, '') AS t FROM documents),
b AS (SELECT *, length(t) AS n, regexp_extract_all(t, '{_WORD}') AS w, length(regexp_replace(t, '{quality.SPACE}', '', 'g')) AS word_chars,
  len(regexp_extract_all(t, '[{quality.SYMBOLS}]')) AS symbols, length(regexp_replace(t, '\P{{L}}+', '', 'g')) AS all_letters,
  length(t) - length(regexp_replace(t, '\p{{Lu}}+', '', 'g')) AS capitals, len(regexp_extract_all(t, '[0-9]')) AS digits FROM d),
f AS (SELECT *, len(w) AS n_words, all_letters - capitals AS letters, n - word_chars AS spaces, n - all_letters - digits - (n - word_chars) - symbols AS others,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM b),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM f WHERE len(w) > 2)),
rep AS (SELECT doc_id, COUNT(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, COUNT(*) OVER (PARTITION BY doc_id, s) AS c FROM tri) WHERE c > 1) GROUP BY 1),
lw AS (SELECT doc_id, lang, lower(unnest(w)) AS x FROM f),
z AS (SELECT lang, COUNT(*) AS c FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY 1),
tr AS (SELECT f.* FROM f JOIN z ON f.lang = z.lang JOIN documents o ON o.doc_id = f.doc_id WHERE o.text IS NOT NULL AND CAST(('0x' || md5(CAST(f.doc_id AS VARCHAR))[1:8])::UBIGINT AS DOUBLE) < {float(quality.TRAIN_ROWS << 32)} / z.c),
r AS (SELECT lang, x, c FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY c DESC, x) AS k FROM (SELECT lang, x, COUNT(*) AS c FROM (SELECT lang, lower(unnest(w)) AS x FROM tr) GROUP BY 1, 2)) WHERE k <= {quality.COMMON}),
l0 AS (SELECT lang, SUM(n_words) AS nw, {', '.join(f'CAST(SUM({c}) AS DOUBLE) AS {c}' for c in quality.CLASSES)} FROM tr GROUP BY 1),
l AS (SELECT *, {' + '.join(quality.CLASSES)} AS chars, (SELECT SUM(c) FROM r WHERE r.lang = l0.lang) / nw AS total FROM l0 WHERE nw > 0),
h AS (SELECT lw.doc_id, lw.x, COUNT(*) / any_value(f.n_words) AS p FROM lw JOIN f ON lw.doc_id = f.doc_id WHERE lw.x IN (SELECT x FROM r) GROUP BY 1, 2),
s AS (SELECT h.doc_id, r.lang, SUM({_HALF.format(p='h.p', q='(r.c / l.nw)')}) AS d, SUM(h.p) AS p, SUM(r.c / l.nw) AS q FROM h JOIN r ON h.x = r.x JOIN l ON r.lang = l.lang GROUP BY 1, 2),
j AS (SELECT f.doc_id, l.lang, sqrt(greatest(0, {_CLASS_PARTS})) AS cd,
  sqrt(greatest(0, COALESCE(s.d, 0) + (l.total - COALESCE(s.q, 0)) / 2 + {_HALF.format(p='greatest(0, 1 - COALESCE(s.p, 0))', q='greatest(0, 1 - l.total)')})) AS wd
  FROM f CROSS JOIN l LEFT JOIN s ON s.doc_id = f.doc_id AND s.lang = l.lang),
m AS (SELECT doc_id, arg_min({{'c': cd, 'w': wd}}, greatest(wd / {quality.WORD_DISTANCE}, cd / {quality.CHAR_DISTANCE})) AS best FROM j GROUP BY 1),
o AS (SELECT f.doc_id, n_words, word_chars, symbols AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, COALESCE(n_repeat_words, 0) AS n_repeat_words, f.n, m.best FROM f LEFT JOIN rep ON rep.doc_id = f.doc_id LEFT JOIN m ON m.doc_id = f.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND (best IS NULL OR ((n_words < {quality.MIN_WORDS} OR best.w <= {quality.WORD_DISTANCE}) AND (n < {quality.MIN_CHARS} OR best.c <= {quality.CHAR_DISTANCE}))) AS kept FROM o"""

NEARDUP = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(x, ' ') AS s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]) END) AS x FROM w)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x),
c AS (SELECT x AS doc_id, MIN(y) AS component_id FROM r GROUP BY 1)
SELECT c.doc_id, COALESCE(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id"""


def _rule(k: int, rule: secrets.Rule) -> str:
    p = _q(rule.pattern)
    group = f"regexp_extract_all(t, {p}, {rule.group})"
    return f"""SELECT doc_id, {k} AS k, list_sum(list_transform(g[1:i], lambda x: length(x))) + COALESCE(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) AS s,
 list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(h[1:i], lambda x: length(x))) AS e
 FROM (SELECT doc_id, g, h, v, unnest(range(1, len(h) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(t, {p}) AS g, regexp_extract_all(t, {p}) AS h, {group} AS v FROM d WHERE regexp_matches(t, {p}))) WHERE length(v[i]) >= {rule.least}"""


_KIND = f"[{', '.join(_q(r.kind) for r in secrets.RULES)}][k + 1]"
_LIST = f"COALESCE(string_agg({_KIND} || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k) FILTER ({{}}), '')"
SECRETS = f"""WITH d AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(_rule(k, r) for k, r in enumerate(secrets.RULES))}),
a AS (SELECT doc_id, {', '.join(f"COUNT(*) FILTER (k = {k}) AS n_{r.kind}" for k, r in enumerate(secrets.RULES[: secrets.BASE]))}, {_LIST.format(f"k < {secrets.BASE}")} AS base, {_LIST.format("TRUE")} AS spans FROM f GROUP BY 1)
SELECT d.doc_id, {', '.join(f"COALESCE(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.RULES[: secrets.BASE])}, sha256(encode(COALESCE(base, ''))) AS base_sha256, COALESCE(spans, '') AS spans FROM d LEFT JOIN a ON a.doc_id = d.doc_id"""

MIXING = """WITH RECURSIVE c AS (SELECT source, COUNT(*) AS n FROM documents GROUP BY 1),
w AS (SELECT source, CAST(floor(sqrt(n)) AS BIGINT) // (SELECT gcd_of FROM (SELECT list_reduce(list(CAST(floor(sqrt(n)) AS BIGINT)), lambda a, b: gcd(a, b)) AS gcd_of FROM c)) AS share, row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM c),
v AS (SELECT list(share ORDER BY i) AS share, SUM(share)::BIGINT AS q FROM w),
edf AS (SELECT CAST(0 AS BIGINT) AS t, list_transform(share, lambda x: CAST(0 AS BIGINT)) AS k, CAST(NULL AS BIGINT) AS i, CAST(NULL AS BIGINT) AS block, share, q FROM v
 UNION ALL SELECT t + 1, list_transform(k, lambda x, j: CASE WHEN j = pick THEN x + 1 ELSE x END), pick, k[pick], share, q FROM (
  SELECT *, list_min(list_filter(list_transform(k, lambda x, j: CASE WHEN x < share[j] AND x * q // share[j] <= t THEN {'due': ((x + 1) * q + share[j] - 1) // share[j], 'j': CAST(j AS BIGINT)} END), lambda z: z IS NOT NULL)).j AS pick FROM edf WHERE t < q)),
p AS (SELECT w.source, w.share, edf.block, edf.t - 1 AS slot, edf.q FROM edf JOIN w ON edf.i = w.i),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY COALESCE(md5(CAST(doc_id AS VARCHAR)), ''), doc_id) - 1 AS rank FROM documents),
s AS (SELECT r.*, rank // 8 AS block, w.share FROM r JOIN w ON r.source IS NOT DISTINCT FROM w.source)
SELECT s.doc_id, s.source, s.rank AS source_rank, s.block, (s.block // s.share) * p.q + p.slot AS slot, ((s.block // s.share) * p.q + p.slot) * 8 + s.rank % 8 AS place
FROM s JOIN p ON s.source IS NOT DISTINCT FROM p.source AND s.block % s.share = p.block"""

# Every subset of a labelled URL's tokens is counted; folding and pruning change no verdict.
_HOST = "regexp_extract(COALESCE(url, ''), '^(?s:.*?)://([^/?#]*)', 1)"
_FIXED = " ".join(
    f"WHEN (h = {_q(h)} OR ends_with(h, {_q('.' + h)})) AND starts_with(p, {_q(p)}) THEN {{'rule': {_q(h + p)}, 'verdict': {_q(v)}}}" for v, h, p in sorted(urlrules.FIXED, key=lambda r: -len(r[1] + r[2]))
)
URLRULES = rf"""WITH u AS (SELECT page_id, url, translate({_HOST}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h, regexp_extract(COALESCE(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS p,
  regexp_extract(COALESCE(url, ''), '^(?s:.*?)://[^?#]*\?([^#]*)', 1) AS q FROM pages),
t AS (SELECT *, list_sort(list_distinct(list_filter(list_transform(string_split(h, '.'), lambda x: 'h:' || x), lambda x: x <> 'h:') || list_filter(list_transform(string_split(p, '/'), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '0', 'g')), lambda x: x <> 'p:')
  || list_filter(list_transform(string_split(q, '&'), lambda x: 'q:' || string_split(x, '=')[1]), lambda x: x <> 'q:'))) AS tok FROM u),
l AS (SELECT t.tok, b.bad FROM t JOIN (SELECT doc_id, bool_or(toxic = 1 OR quality = 0) AS bad FROM labels WHERE (toxic = 1 OR quality = 0) IS NOT NULL GROUP BY 1) b ON b.doc_id = t.page_id WHERE len(t.tok) > 0),
z AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (bad) AS bad FROM l),
s AS (SELECT list_filter(tok, lambda x, i: m // CAST(power(2, i - 1) AS BIGINT) % 2 = 1) AS items, bad FROM (SELECT tok, bad, unnest(range(1, CAST(power(2, len(tok)) AS BIGINT))) AS m FROM l)),
c AS (SELECT items, COUNT(*) AS n, COUNT(*) FILTER (bad) AS hits FROM s GROUP BY 1),
r AS (SELECT items FROM c, z WHERE c.hits >= greatest({urlrules.LEAST}, {urlrules.SUPPORT} * z.n) AND c.hits >= {urlrules.CONFIDENCE} * c.n
  AND (c.hits / c.n + {urlrules.QUANTILE**2} / (2 * c.n) - {urlrules.QUANTILE} * sqrt(c.hits / c.n * (1 - c.hits / c.n) / c.n + {urlrules.QUANTILE**2} / (4 * c.n * c.n))) / (1 + {urlrules.QUANTILE**2} / c.n) > z.bad / z.n),
b AS (SELECT DISTINCT tok FROM (SELECT DISTINCT tok FROM t) d JOIN r ON list_has_all(d.tok, r.items)),
f AS (SELECT page_id, h, p, tok, CASE {_FIXED} END AS fixed FROM t)
SELECT page_id, h AS host, p AS path, fixed.rule AS rule, COALESCE(fixed.verdict, CASE WHEN b.tok IS NULL THEN 'allow' ELSE 'block' END) AS verdict FROM f LEFT JOIN b ON f.tok = b.tok"""

# Every order is run over the masks, step by step; the query forms polynomials.
AUDIT = rf"""WITH d AS (SELECT doc_id, COALESCE(source, '') AS part, COALESCE(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS w, MIN(doc_id) OVER (PARTITION BY t) AS least FROM d),
g AS (SELECT doc_id, bool_or(COALESCE(quality = 1, false)) AS good, bool_or(COALESCE(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, COALESCE(good, false) AS good, COALESCE(toxic, false) AS toxic,
  (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * COALESCE(least < w.doc_id, false)::INT AS mask FROM w LEFT JOIN g ON g.doc_id = w.doc_id),
m AS (SELECT part, mask, COUNT(*) AS n, COUNT(*) FILTER (good) AS good, COUNT(*) FILTER (toxic) AS toxic FROM f GROUP BY 1, 2),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(step AS INT) AS step, CAST(power(2, ascii(filter_order[step]) - 65) AS INT) AS bit,
  list_sum(list_transform(range(1, step), lambda j: CAST(power(2, ascii(filter_order[j]) - 65) AS INT))) AS before FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step, bit, SUM(n) FILTER (mask & (COALESCE(before, 0) + bit)::INT = 0) AS kept,
  SUM(n) FILTER (mask & bit > 0 AND mask & COALESCE(before, 0)::INT = 0) AS removed, SUM(n) FILTER (mask & bit > 0 AND mask & COALESCE(before, 0)::INT > 0) AS redundant,
  SUM(n) FILTER (mask = bit) AS unique_fails, SUM(good) FILTER (mask & bit > 0 AND mask & COALESCE(before, 0)::INT = 0) AS good_lost,
  SUM(toxic) FILTER (mask & bit > 0 AND mask & COALESCE(before, 0)::INT = 0) AS toxic_lost FROM m, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, {', '.join(f'CAST(COALESCE({c}, 0) AS BIGINT) AS {c}' for c in ('kept', 'removed', 'redundant', 'unique_fails', 'good_lost', 'toxic_lost'))},
  CAST(SUM(COALESCE(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""

# Every vector is compared with every centroid in every round.
_ASSIGN = """a{r} AS (SELECT vec_id, any_value(v) AS v, arg_min(c, d * 16 + c) AS c, MIN(d) AS d FROM (SELECT x.vec_id, x.v, y.c, list_sum(list_transform(list_zip(x.v, y.m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x, c{r} y) GROUP BY 1),
"""
_MEANS = """c{n} AS (SELECT c{r}.c, COALESCE(s.m, c{r}.m) AS m FROM c{r} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM
 (SELECT c, i, SUM(v[i])::BIGINT AS s, COUNT(*) AS n FROM (SELECT c, v, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY 1, 2) GROUP BY 1) s ON s.c = c{r}.c),
"""
CLUSTERS = f"""WITH x AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m FROM (SELECT sha256('1:' || vec_id) AS h, v FROM x ORDER BY h LIMIT 16)),
{''.join(_ASSIGN.format(r=r) + _MEANS.format(r=r, n=r + 1) for r in range(3))}{_ASSIGN.format(r=3)}i AS (SELECT c, SUM(d)::BIGINT AS of_cluster FROM a3 GROUP BY 1)
SELECT vec_id, a3.c::INT AS cluster, d::BIGINT AS distance, of_cluster AS cluster_inertia, (SELECT SUM(d) FROM a3)::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a3 JOIN i ON i.c = a3.c JOIN c3 ON c3.c = a3.c"""

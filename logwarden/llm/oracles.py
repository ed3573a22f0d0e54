"""SQL that must give the rows of the text queries, for those that SQL can express."""

from __future__ import annotations

from . import collocations, decontaminate, linededup, mixing, nndescent, substring
from .common import ASCII_UPPER

_TOKENS = r"regexp_extract_all(translate(COALESCE(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(upper=ASCII_UPPER, lower=ASCII_UPPER.lower())
_WORDS = r"regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING = f"""WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(list_slice(ws, s, s + {substring.WINDOW - 1}), ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {substring.WINDOW - 2})) AS s FROM d WHERE len(ws) >= {substring.WINDOW})),
firsts AS (SELECT k, MIN(doc_id) AS f FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, s + i AS p FROM (SELECT win.doc_id, win.s, unnest(range(0, {substring.WINDOW})) AS i FROM win JOIN firsts USING (k) WHERE f < win.doc_id)),
lost AS (SELECT doc_id, list(p) AS ps, COUNT(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(COALESCE(n, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id)"""

DECONTAMINATE = f"""WITH d AS (SELECT doc_id, {_TOKENS} AS ws FROM documents),
i AS (SELECT item_id, ws, least({decontaminate.WINDOW}, len(ws)) AS size FROM (SELECT item_id, {_TOKENS} AS ws FROM benchmark) WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(ws, s, s + size - 1), ' ') AS k FROM (SELECT item_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS s FROM i)),
sizes AS (SELECT DISTINCT size FROM i),
dw AS (SELECT doc_id, size, s, array_to_string(list_slice(ws, s, s + size - 1), ' ') AS k FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS s FROM d, sizes WHERE len(ws) >= size)),
met AS (SELECT doc_id, item_id, s, size FROM dw JOIN iw USING (size, k)),
words AS (SELECT doc_id, COUNT(*) AS n_hit FROM (SELECT DISTINCT doc_id, s + j AS p FROM (SELECT doc_id, s, unnest(range(0, size)) AS j FROM met)) GROUP BY 1),
items AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(COALESCE(n_hit, 0) AS BIGINT) AS n_hit, CAST(COALESCE(n_items, 0) AS BIGINT) AS n_items, sha256(COALESCE(ids, '')) AS items_sha256,
  COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) >= {nndescent.COSINE}::DOUBLE),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
comp AS (SELECT a AS vec_id, MIN(b) AS component_id FROM reach GROUP BY 1),
degree AS (SELECT a AS vec_id, COUNT(*) AS n FROM links GROUP BY 1)
SELECT vec_id, CAST(COALESCE(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN degree USING (vec_id)"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v{k} // {1 << shift}) % 32 AS INT) + 1, 1)" for k in range(8) for shift in (15, 10, 5, 0)
)
_CHUNKS = ", ".join(f"CAST('0x' || substr(h, {5 * k + 1}, 5) AS BIGINT) AS v{k}" for k in range(8))
WARC = f"""WITH p AS (SELECT page_id, COALESCE(html, '') AS x, sha1(COALESCE(html, '')) AS h FROM pages),
f AS (SELECT x, MIN(page_id) AS first FROM p GROUP BY 1),
c AS (SELECT page_id, x, first, {_CHUNKS} FROM p JOIN f USING (x))
SELECT page_id, CAST(octet_length(encode(x)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM c"""

_SHARE = "pow(share, k / 4096.0::DOUBLE)"
MIXING = f"""WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS n FROM documents),
s AS (SELECT source, SUM(n) AS tokens FROM d GROUP BY 1 HAVING SUM(n) > 0),
sh AS (SELECT source, tokens, tokens / (SELECT SUM(tokens) FROM s)::DOUBLE AS share FROM s),
g AS (SELECT k, ln(SUM({_SHARE})) - k / 4096.0::DOUBLE * SUM({_SHARE} * ln(share)) / SUM({_SHARE}) AS h, MAX({_SHARE} / share) / SUM({_SHARE}) AS most
  FROM sh, range(0, {mixing.GRID + 1}) r(k) GROUP BY k),
spread AS (SELECT COALESCE(MAX(k) FILTER (WHERE round(h, 9) >= round({mixing.ENTROPY_SHARE}::DOUBLE * ln((SELECT COUNT(*) FROM sh)), 9)), 0) AS k FROM g),
chosen AS (SELECT CASE WHEN (SELECT COUNT(*) FROM sh) < 2 THEN {mixing.GRID} WHEN (SELECT round(most, 9) > {mixing.REPEATS} FROM g WHERE g.k = spread.k)
  THEN least({mixing.GRID}, (SELECT MAX(k) FROM g WHERE round(most, 9) > {mixing.REPEATS}) + 1) ELSE spread.k END AS k FROM spread),
b AS (SELECT source, '=' || source AS sk, CAST(tokens AS BIGINT) AS tokens, CAST(floor(round({_SHARE} / (SELECT SUM({_SHARE}) FROM sh, chosen) * (SELECT SUM(tokens) FROM s), 3)) AS BIGINT) AS budget,
  CAST(greatest(1, ceil(tokens / {mixing.BLOCK_TOKENS}.0::DOUBLE)) AS BIGINT) AS blocks FROM sh, chosen),
placed AS (SELECT doc_id, d.source, n, sk, tokens, budget, CAST('0x' || substr(md5('block:' || sk || ':' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % blocks AS block FROM d JOIN b ON d.source = b.source),
sums AS (SELECT sk, block, SUM(n) AS n, MIN(tokens) AS tokens, MIN(budget) AS budget FROM placed GROUP BY 1, 2),
turns AS (SELECT *, ROW_NUMBER() OVER w AS block_rank, SUM(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, budget - epoch * tokens AS room
  FROM (SELECT *, unnest(range(0, budget // tokens + 1)) AS epoch FROM sums)
  WINDOW w AS (PARTITION BY sk, epoch ORDER BY md5('turn:' || sk || ':' || CAST(epoch AS VARCHAR) || ':' || CAST(block AS VARCHAR)), block)),
taken AS (SELECT p.doc_id, p.source, p.n, t.epoch, p.block, t.block_rank, t.upto <= t.room AS whole, t.room - t.upto + t.n AS space,
  SUM(p.n) OVER (PARTITION BY p.sk, t.epoch, p.block ORDER BY md5('doc:' || CAST(t.epoch AS VARCHAR) || ':' || CAST(p.doc_id AS VARCHAR)), p.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM placed p JOIN turns t USING (sk, block))
SELECT doc_id, source, n AS n_tokens, CAST(epoch AS BIGINT) AS epoch, CAST(block AS BIGINT) AS block, CAST(block_rank AS INT) AS block_rank FROM taken WHERE whole OR (space > 0 AND run <= space)"""

_LINE_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{upper}', '{lower}')".format(upper=ASCII_UPPER, lower=ASCII_UPPER.lower())
LINES = f"""WITH s AS (SELECT doc_id, string_split(COALESCE(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, pos, line, {_LINE_KEY} AS k FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM s)),
c AS (SELECT k, MAX(doc_id) AS last FROM l WHERE length(k) >= {linededup.MIN_CHARS} GROUP BY k HAVING COUNT(DISTINCT doc_id) >= {linededup.MIN_DOCS})
SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (WHERE doc_id < last) AS n_dropped,
  sha256(COALESCE(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE last IS NULL OR doc_id >= last), '')) AS kept_sha256
FROM l LEFT JOIN c USING (k) GROUP BY doc_id"""

FILTERS = f"""WITH x AS (SELECT doc_id, COALESCE(source, '') AS part, COALESCE(text, '') AS t FROM documents),
f AS (SELECT t, MIN(doc_id) AS least FROM x GROUP BY 1),
w AS (SELECT doc_id, part, x.t, least, regexp_extract_all(x.t, '[^\x20\x09-\x0D]+') AS ws FROM x JOIN f ON x.t = f.t),
m AS (SELECT part, COALESCE(quality = 1, FALSE) AS good, COALESCE(toxic = 1, FALSE) AS toxic,
  [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), w.doc_id > least] AS fails
  FROM w LEFT JOIN labels ON labels.doc_id = w.doc_id),
c AS (SELECT part, fails, COUNT(*) AS n, SUM(CAST(good AS INT)) AS good, SUM(CAST(toxic AS INT)) AS toxic FROM m GROUP BY 1, 2),
i AS (SELECT unnest(range(1, 6)) AS v),
o AS (SELECT [a.v, b.v, c.v, d.v, e.v] AS vs FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.v, b.v, c.v, d.v, e.v])) = 5),
s AS (SELECT vs, array_to_string([substr('ABCDE', CAST(v AS INT), 1) FOR v IN vs], '') AS filter_order, unnest(range(1, 6)) AS step FROM o),
r AS (SELECT part, filter_order, step, vs[step] AS filter, n, good, toxic, fails[vs[step]] AS fail,
  len(list_filter(vs[1:step - 1], lambda v: fails[v])) > 0 AS earlier, len(list_filter(fails, lambda z: z)) AS n_fails FROM s, c),
g AS (SELECT part, filter_order, step, filter, COALESCE(SUM(n) FILTER (WHERE NOT earlier AND NOT fail), 0) AS kept, COALESCE(SUM(n) FILTER (WHERE NOT earlier AND fail), 0) AS removed,
  COALESCE(SUM(n) FILTER (WHERE earlier AND fail), 0) AS redundant, COALESCE(SUM(n) FILTER (WHERE fail AND n_fails = 1), 0) AS unique_fails,
  COALESCE(SUM(good) FILTER (WHERE NOT earlier AND fail), 0) AS good_lost, COALESCE(SUM(toxic) FILTER (WHERE NOT earlier AND fail), 0) AS toxic_lost FROM r GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(SUM(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM g"""

COLLOCATIONS = f"""WITH d AS (SELECT COALESCE(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(COALESCE(text, ''), '{ASCII_UPPER}', '{ASCII_UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM d),
g AS (SELECT lang, k, array_to_string(list_slice(ws, s, s + k - 1), ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM p, range(1, {collocations.LENGTH + 1}) r(k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, COUNT(*) AS a FROM g GROUP BY 1, 2, 3),
n AS (SELECT lang, SUM(a) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= {collocations.MIN_COUNT}),
u AS (SELECT lang, phrase, a, cut, array_to_string(list_slice(ws, 1, cut), ' ') AS x, array_to_string(list_slice(ws, cut + 1, k), ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
s AS (SELECT u.lang, u.phrase, u.a, u.cut, fx.a AS l, fy.a AS r, CAST(u.a AS HUGEINT) * {collocations.SCALE} // (fx.a + fy.a) AS score FROM u JOIN f fx ON fx.lang = u.lang AND fx.phrase = u.x JOIN f fy ON fy.lang = u.lang AND fy.phrase = u.y),
b AS (SELECT * FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN c w ON w.lang = c.lang AND w.k > c.k AND 100 * w.a >= {collocations.SUBSUMED_PERCENT} * c.a AND position(' ' || c.phrase || ' ' IN ' ' || w.phrase || ' ') > 0),
t AS (SELECT b.* FROM b ANTI JOIN inside USING (lang, phrase)),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM k JOIN n USING (lang) WHERE rank <= {collocations.TOP}"""

ORACLES = {"op12_collocations": COLLOCATIONS, "op11_linededup": LINES, "op13_filteraudit": FILTERS, "op4_substring": SUBSTRING, "op5_nndescent": EMBEDDINGS, "op7_decontaminate": DECONTAMINATE, "op8_mixing": MIXING, "op10_warc": WARC}

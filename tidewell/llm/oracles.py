"""DuckDB SQL for those queries of this package that SQL can express on whole tables."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x20\x09-\x0D]+')"
_ALNUM = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

JACCARD = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
),
l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""

_KEY = "CASE WHEN regexp_matches({0}, '^[^/?#]*://') THEN translate(regexp_extract({0}, '^[^/?#]*://[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(regexp_extract({0}, '^[^#]*'), length(regexp_extract({0}, '^[^/?#]*://[^/?#]*')) + 1) END"


def _rule(host: str, path: str) -> str:
    rules = [("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("allow", "org", "/")]
    cases = " ".join(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{v} {h}{p}'" for v, h, p in rules)
    return f"CASE {cases} END"


_REST = "CASE WHEN instr({0}, '://') > 0 THEN substr({0}, instr({0}, '://') + 3) END"
_HOST = "coalesce(translate(regexp_extract(" + _REST + ", '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = "coalesce(regexp_extract(" + _REST + ", '^[^/?#]*([^?#]*)', 1), '')"
_HEAD = "regexp_extract(url, '^[^/?#]*://[^/?#]*')"

_PARTS = "'^([^/?#]*://[^/?#]*)([^?#]*)(.*)$'"
_STEPS = f"list_reduce(string_split(regexp_extract(goal, {_PARTS}, 2), '/')[2:], lambda done, x: CASE WHEN x = '..' THEN regexp_replace(done, '/[^/]*$', '') WHEN x = '.' THEN done ELSE done || '/' || x END, '')"
_NO_DOTS = f"CASE WHEN regexp_matches(regexp_extract(goal, {_PARTS}, 2), '/[.][.]?(/|$)') THEN regexp_extract(goal, {_PARTS}, 1) || {_STEPS} || CASE WHEN regexp_matches(regexp_extract(goal, {_PARTS}, 2), '/[.][.]?$') THEN '/' ELSE '' END || regexp_extract(goal, {_PARTS}, 3) ELSE goal END"

URLS = f"""
WITH RECURSIVE found AS (
  SELECT url,
    unnest([
      regexp_extract(regexp_extract(html, '(?i)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>'), '(?i)[\\s"'']href\\s*=\\s*["'']?([^\\s>"'']+)', 1),
      regexp_extract(regexp_extract(html, '(?i)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>'), '(?i)[\\s"'';]url\\s*=\\s*["'']?([^\\s>"'';]+)', 1)
    ]) AS raw
  FROM pages
),
target AS (
  SELECT url, CASE
    WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
    WHEN starts_with(t, '//') THEN regexp_extract(url, '^[^/?#]*:') || t
    WHEN starts_with(t, '/') THEN {_HEAD} || t
    WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    ELSE {_HEAD} || CASE WHEN regexp_replace({_PATH.format("url")}, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace({_PATH.format("url")}, '[^/]*$', '') END || t END AS goal
  FROM (SELECT url, replace(raw, '&amp;', '&') AS t FROM found WHERE raw <> '')
),
plain AS (SELECT url, {_NO_DOTS} AS goal FROM target),
l AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT {_KEY.format("url")} AS a, {_KEY.format("goal")} AS b FROM plain) WHERE a <> b),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, seen) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
ruled AS (SELECT node, min(split_part({_rule(_HOST.format("seen"), _PATH.format("seen"))}, ' ', 1)) AS theirs FROM r GROUP BY node),
p AS (SELECT page_id, url, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path FROM pages),
q AS (SELECT *, {_rule("host", "path")} AS hit FROM p)
SELECT page_id, host, path, split_part(hit, ' ', 2) AS rule, coalesce(split_part(hit, ' ', 1), theirs, 'allow') AS verdict
FROM q LEFT JOIN ruled ON ruled.node = {_KEY.format("q.url")}
"""

PASSAGES = f"""
WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS ws FROM documents),
g AS MATERIALIZED (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
),
m AS MATERIALIZED (SELECT h, min(struct_pack(doc_id := doc_id, i := i)) AS f FROM g GROUP BY h HAVING count(*) > 1),
x AS MATERIALIZED (SELECT g.doc_id, g.i, g.doc_id <> f.doc_id OR g.i <> f.i AS removed, f.doc_id AS first_id FROM g JOIN m ON g.h = m.h),
c AS (
  SELECT doc_id, least(i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 50), 50) AS n FROM x
),
d AS (
  SELECT doc_id, least(i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 50), 50) AS n, first_id FROM x WHERE removed
)
SELECT c.doc_id, CAST(c.n_repeated AS BIGINT) AS n_repeated, CAST(coalesce(d.n_removed, 0) AS BIGINT) AS n_removed, coalesce(d.first_ids, CAST([] AS BIGINT[])) AS first_ids
FROM (SELECT doc_id, sum(n) AS n_repeated FROM c GROUP BY doc_id) c
LEFT JOIN (SELECT doc_id, sum(n) AS n_removed, list_sort(list(DISTINCT first_id)) AS first_ids FROM d GROUP BY doc_id) d ON d.doc_id = c.doc_id
"""

LEAKS = f"""
WITH b AS (SELECT item_id, {_ALNUM} AS ws FROM benchmark),
k AS MATERIALIZED (
  SELECT DISTINCT item_id, len(ws[i:i + 9]) AS size, array_to_string(ws[i:i + 9], ' ') AS run
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
),
w AS MATERIALIZED (SELECT doc_id, {_ALNUM} AS ws FROM documents),
h AS MATERIALIZED (
  SELECT DISTINCT doc_id, i, size, item_id
  FROM (SELECT doc_id, i, size, array_to_string(ws[i:i + size - 1], ' ') AS run
        FROM (SELECT doc_id, ws, z.size, unnest(range(1, len(ws) - z.size + 2)) AS i FROM w, (SELECT DISTINCT size FROM k) z WHERE len(ws) >= z.size)) o
  JOIN k USING (size, run)
),
t AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY doc_id),
j AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN t ON t.doc_id = w.doc_id LEFT JOIN j ON j.doc_id = w.doc_id
"""

MIXING = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS k FROM documents
),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s),
v AS (
  SELECT *, source_size * 3 / weight AS reach,
    (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM w WINDOW before AS (ORDER BY source_size * 3 / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
t AS (SELECT source, source_size, least(source_size * 3, (SELECT max(level) FROM v WHERE level <= reach) * weight) AS target FROM v),
u AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
),
r AS (
  SELECT * FROM (SELECT source, upto, size, target, CAST(floor(target) AS BIGINT) AS goal, upto - size + j * source_size AS start FROM u, (SELECT unnest([0, 1, 2]) AS j))
  WHERE size > 0 AND start < target
),
p AS (
  SELECT source, upto, start, least(size, goal - start) AS words, CASE WHEN start + size <= goal THEN (start + size) / target ELSE 1.0 END AS finish FROM r WHERE start < goal
  UNION ALL
  SELECT source, upto, start, start + size - greatest(goal, start) AS words, (start + size) / target AS finish FROM r WHERE start + size > goal
),
o AS (SELECT source, upto, words, sum(words) OVER (ORDER BY finish, source IS NULL, source, start ROWS UNBOUNDED PRECEDING) - words AS begun FROM p),
m AS (SELECT source, upto, sum(least(words, budget - begun)) AS taken FROM o, (SELECT sum(size) AS budget FROM u) WHERE begun < budget GROUP BY source, upto)
SELECT u.doc_id, u.size, u.source_size, u.target, CAST(coalesce(m.taken, 0) AS BIGINT) AS taken
FROM u LEFT JOIN m ON m.source IS NOT DISTINCT FROM u.source AND m.upto = u.upto AND u.size > 0
"""

WARC = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest AS d, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN original <> page_id THEN original END AS refers_to
FROM p LEFT JOIN m ON m.d = p.payload_digest AND p.payload_bytes >= 1000
"""

FIM = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || CAST(doc_id AS VARCHAR)) AS x FROM documents
),
h AS (SELECT *, len(u) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h
),
p AS (SELECT *, array_to_string(u[1:lo], '') AS prefix, array_to_string(u[lo + 1:hi], '') AS middle, array_to_string(u[hi + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

LINES = f"""
WITH l AS MATERIALIZED (
  SELECT doc_id, i, ls[i] AS line, {_LOWER.format("trim(ls[i], chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')")} AS key
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
),
k AS MATERIALIZED (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(k.key) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN k.key IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM l LEFT JOIN k ON k.key = l.key GROUP BY doc_id
"""

PHRASES = rf"""
WITH p AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS MATERIALIZED (
  SELECT lang, m, phrase, count(*) AS f
  FROM (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) s(m) WHERE len(ws) >= m))
  GROUP BY lang, m, phrase HAVING count(*) >= 30
),
c AS MATERIALIZED (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS ws FROM g WHERE m > 1),
v AS MATERIALIZED (SELECT lang, m, phrase, f, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS rest FROM c JOIN (VALUES (1), (2), (3)) x(k) ON x.k < c.m),
k AS (
  SELECT v.lang, v.phrase, v.f AS a, x.f AS l, y.f AS r, v.k, (CAST(2000000 AS HUGEINT) * v.f) // (x.f + y.f) AS score
  FROM v JOIN g x ON x.lang = v.lang AND x.phrase = v.head JOIN g y ON y.lang = v.lang AND y.phrase = v.rest
),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (
  SELECT DISTINCT q.lang, q.part FROM (SELECT lang, f, s, array_to_string(ws[i:i + s - 1], ' ') AS part FROM (SELECT lang, f, ws, s, unnest(range(1, m - s + 2)) AS i FROM c JOIN (VALUES (2), (3)) z(s) ON z.s < c.m)) q
  JOIN c ON c.lang = q.lang AND c.phrase = q.part WHERE CAST(100 AS HUGEINT) * q.f >= CAST(80 AS HUGEINT) * c.f
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, CAST(score AS BIGINT) AS score
FROM b JOIN t ON t.lang = b.lang WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = b.lang AND o.part = b.phrase)
QUALIFY rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": JACCARD,
    "op2_url_filter": URLS,
    "op3_suffix_array_dedup": PASSAGES,
    "op5_benchmark_decontamination": LEAKS,
    "op6_source_mixing": MIXING,
    "op7_warc_revisits": WARC,
    "op11_fill_in_middle": FIM,
    "op12_line_dedup": LINES,
    "op13_collocations": PHRASES,
}

"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from .license_texts import KNOWN, SPELLINGS
from .licenses import COPYRIGHT_LINE, JOINED, OTHER
from .url_filters import ENTRIES

SQL: dict[str, str] = {}

SQL["op8_decontaminate"] = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ig AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
dg AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, (SELECT DISTINCT m FROM ig) WHERE len(w) >= m)),
hit AS (SELECT doc_id, item_id, m, i FROM dg JOIN ig USING (m, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, sha256(string_agg(id, ',' ORDER BY id)) AS h
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  coalesce(items.h, sha256('')) AS items_sha256, words.n IS NOT NULL AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SQL["op4_quality_rules"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
  SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g JOIN (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)) GROUP BY doc_id),
m0 AS (
  SELECT doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m0),
r AS (SELECT doc_id, stratum, rule, unnest(CASE rule WHEN 'symbols' THEN [0.5, 0.3, 0.2, 0.1, 0.05, 0.02]::DOUBLE[]
    WHEN 'dup_lines' THEN [0.95, 0.9, 0.8, 0.7, 0.6, 0.5]::DOUBLE[] WHEN 'word_length' THEN [20, 15, 12, 10, 9, 8, 7]::DOUBLE[]
    ELSE [0.19, 0.17, 0.15]::DOUBLE[] END) AS c,
    CASE rule WHEN 'symbols' THEN n_symbols::DOUBLE / nullif(word_chars, 0) WHEN 'dup_lines' THEN n_dup_lines::DOUBLE / nullif(n_lines, 0)
    WHEN 'word_length' THEN word_chars::DOUBLE / nullif(n_words, 0) ELSE n_repeat_words::DOUBLE / nullif(n_words, 0) END AS v
  FROM m, (SELECT unnest(['symbols', 'dup_lines', 'word_length', 'repeats']) AS rule)),
lab0 AS (SELECT doc_id, min(quality) >= 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
lab AS (SELECT min(doc_id) AS doc_id, bool_and(good) AS good FROM lab0 JOIN d USING (doc_id) GROUP BY stratum, text),
t AS (
  SELECT stratum, rule, c, -c AS o,
    count(*) FILTER (good) AS n, count(*) FILTER (good AND v > c) AS k, count(*) FILTER (NOT good AND v > c) AS bad
  FROM r JOIN lab USING (doc_id) GROUP BY ALL),
s AS (SELECT 4 * greatest(1, count(DISTINCT stratum)) AS tests FROM t WHERE n > 0),
p AS (
  SELECT t.*, n > 0 AND k <= n * 0.005 AND (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.005) + (n - i) * ln(0.995)))
    FROM (SELECT unnest(range(0, least(k, 1000000) + 1)) AS i)) <= 0.05 / (SELECT tests FROM s) AS ok FROM t),
f AS (SELECT stratum, rule, c FROM (SELECT *, bool_and(ok) OVER (PARTITION BY stratum, rule ORDER BY o) AS allowed FROM p) WHERE allowed AND bad > 0),
best AS (SELECT stratum, rule, min(c) AS c FROM f GROUP BY ALL),
rejected AS (SELECT DISTINCT doc_id FROM (SELECT DISTINCT doc_id, stratum, rule, v FROM r) JOIN best USING (stratum, rule) WHERE v > best.c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept
FROM m
"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_SAME = "MAP {" + ", ".join(f"{_quoted(a)}: {_quoted(b)}" for a, b in SPELLINGS.items()) + "}"


def _canonical(x: str) -> str:
    bare = (f"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), {_quoted('(?m)' + COPYRIGHT_LINE)}, '', 'g'), "
            f"{_quoted(JOINED)}, '', 'g'), {_quoted(OTHER)}, ' ', 'g'))")
    return f"array_to_string(list_transform(string_split({bare}, ' '), lambda w: coalesce({_SAME}[w], w)), ' ')"


SQL["op10_license_scan"] = f"""
WITH k0 AS (SELECT * FROM (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in KNOWN)}) AS t(license, txt)),
known AS (SELECT sha256({_canonical("txt")}) AS digest, min(license) AS license, bool_or(NOT contains(trim(txt, ' ' || chr(10)), chr(10))) AS single FROM k0 GROUP BY 1),
d AS (SELECT doc_id, {_canonical("text")} AS c FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
ll AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS ids
  FROM (SELECT doc_id, sha256({_canonical("line")}) AS digest FROM l) JOIN (SELECT * FROM known WHERE single) USING (digest) GROUP BY doc_id),
dd AS (SELECT doc_id, CASE WHEN c <> '' THEN sha256(c) END AS digest FROM d)
SELECT dd.doc_id, dd.digest, known.license, coalesce(ll.ids, '') AS line_licenses
FROM dd LEFT JOIN known USING (digest) LEFT JOIN ll ON ll.doc_id = dd.doc_id
"""

SQL["op5_url_filters"] = f"""
WITH e AS (SELECT lower(entry) AS key, list, since::DATE AS since, max(action) = 'add' AS adds
  FROM (VALUES {", ".join("(" + ", ".join(map(_quoted, e)) + ")" for e in ENTRIES)}) AS t(entry, list, action, since) GROUP BY 1, 2, 3),
v AS (SELECT * FROM (SELECT *, lead(since) OVER (PARTITION BY key, list ORDER BY since) AS until FROM e) WHERE adds),
p0 AS (SELECT *, CASE WHEN regexp_matches(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//') THEN url WHEN regexp_matches(url, '^[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+(?:[/?#]|:[0-9]|$)') THEN '//' || url ELSE '' END AS u FROM pages),
p AS (SELECT page_id, url, DATE '2024-01-01' + (page_id % 366)::INT AS fetched,
  rtrim(lower(regexp_extract(u, '//(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '.') AS host,
  regexp_replace(regexp_extract(u, '//[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g') AS path FROM p0),
k AS (
  SELECT page_id, fetched, array_to_string(h[i:], '.') AS key FROM (SELECT page_id, fetched, string_split(host, '.') AS h, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM p)
  UNION
  SELECT page_id, fetched, host || '/' || lower(array_to_string(s[1:i], '/')) FROM (SELECT page_id, fetched, host, string_split(path, '/') AS s, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM p WHERE path <> '')),
m AS (SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM k JOIN v USING (key)
  WHERE since <= fetched AND (until IS NULL OR fetched < until) GROUP BY page_id)
SELECT p.page_id, url, fetched::VARCHAR AS fetched, host, coalesce(lists, '') AS lists, lists IS NOT NULL AS blocked FROM p LEFT JOIN m USING (page_id)
"""

SQL["op2_minhash_dedup"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.y AS component_id, d.doc_id = m.y AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) m ON m.x = d.doc_id
"""

SQL["op3_warc"] = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM q
"""

SQL["op7_line_dedup"] = r"""
WITH l0 AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
l AS (SELECT doc_id, pos, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM l0 WHERE length(trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12))) > 0),
d AS (SELECT line, min({'d': doc_id, 'p': pos}) AS first, length(line) AS n FROM l GROUP BY line),
r AS (SELECT line, n AS m FROM d WHERE n >= 30 UNION ALL SELECT line, n - 1 FROM d WHERE n >= 30),
k AS (SELECT line, m, 1 AS side, line[1:m // 2] AS seg FROM r UNION ALL SELECT line, m, 2, right(line, m - m // 2) FROM r),
e AS (SELECT DISTINCT x.line AS a, y.line AS b FROM k x JOIN k y USING (m, side, seg) WHERE x.line <> y.line AND levenshtein(x.line, y.line) <= 1),
b AS (SELECT a AS line, min(d.first) AS other, count(*) AS links FROM e JOIN d ON d.line = e.b GROUP BY a),
f AS (SELECT l.doc_id, l.pos, coalesce(b.links, 0) AS links, {'d': l.doc_id, 'p': l.pos} > d.first OR coalesce({'d': l.doc_id, 'p': l.pos} > b.other, false) AS gone
  FROM l JOIN d USING (line) LEFT JOIN b USING (line)),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, sum(links) AS n_links, string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (gone) AS removed FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(removed, '') AS removed
FROM documents LEFT JOIN g USING (doc_id)
"""


def _rounds(k: int = 40, rounds: int = 5) -> str:
    """Assignments and floored means, one pair of CTEs a round."""
    near = """SELECT vec_id, q, arg_min({'c': c, 'd': d}, {'d': d, 'c': c}) AS m FROM (
  SELECT vec_id, q, c, list_sum(list_transform(list_zip(q, z), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c%d) GROUP BY ALL"""
    parts = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS c, q AS z FROM v ORDER BY sha256('2:' || vec_id), q LIMIT {k})"""]
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({near % r})")
        parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n.z, c{r}.z) AS z FROM c{r} LEFT JOIN (
  SELECT c, list(floor_mean ORDER BY i) AS z FROM (SELECT c, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS floor_mean FROM (
    SELECT m.c AS c, i, sum(x) AS s, count(*) AS n FROM (SELECT m, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{r}) GROUP BY ALL)) GROUP BY c) n USING (c))""")
    parts.append(f"f AS (SELECT vec_id, m.c AS cluster, m.d AS distance FROM ({near % rounds}))")
    return ",\n".join(parts)


SQL["op11_centroid_clustering"] = f"""
WITH {_rounds()}
SELECT vec_id, cluster::INT AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(z, ',')) AS centroid_sha256 FROM f JOIN c5 ON c5.c = cluster
"""

SQL["op13_ranked_search"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, row_number() OVER () AS q, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
st AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
t AS (SELECT q, item_id, unnest(w) AS term FROM i),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM t) GROUP BY ALL),
g AS (SELECT term, floor(1000 * ln((2 * st.n + 2) / (2 * df + 1)))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM f GROUP BY term), st),
s AS (SELECT q, item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * f.n * st.n) // st.l))))::BIGINT AS score
  FROM t JOIN f USING (term) JOIN g USING (term), st GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""

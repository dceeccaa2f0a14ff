"""DuckDB fragments that the SQL twins share."""

from __future__ import annotations

from tessella.functions.text import GUARD_RULES, REJECTION, STOP_WORDS
from tessella.operators import sentence_rules as rules

WS = r"[ \t\n\r\f\x0b]"


def quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '{WS}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def eval_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9 \\t\\n\\r\\f\\x0b]', ' ', 'g'), '{WS}+'), lambda t: length(t) >= 2)"


def index_tokens(x: str) -> str:
    return f"list_filter({eval_tokens(x)}, lambda t: t NOT IN ({', '.join(map(quote, STOP_WORDS))}))"


def detections(x: str) -> str:
    hits = ", ".join(f"CASE WHEN regexp_matches(coalesce({x}, ''), {quote(p)}, 'i') THEN {quote(n)} END" for n, p in GUARD_RULES)
    return f"list_filter([{hits}], lambda d: d IS NOT NULL)"


def rejection(x: str) -> str:
    return f"CASE WHEN len({detections(x)}) > 0 THEN {quote(REJECTION)} || array_to_string({detections(x)}, ', ') || ')' END"


def cosine(a: str, b: str) -> str:
    return f"CASE WHEN list_dot_product({a}, {a}) > 0 AND list_dot_product({b}, {b}) > 0 THEN greatest(-1.0, least(1.0, list_cosine_similarity({a}, {b}))) ELSE 0.0 END"


def bm25(corpus: str, terms: list[str] | None = None) -> str:
    """CTEs tok, tf, st, idf, part over a CTE ``corpus`` (id, text)."""
    only = f" WHERE term IN ({', '.join(map(quote, terms))})" if terms is not None else ""
    return f"""tok AS (SELECT id, {index_tokens('text')} AS t FROM {corpus}),
tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM tok){only} GROUP BY ALL),
st AS (SELECT count(*) AS n, coalesce(avg(len(t)), 1.0) AS avgdl FROM tok),
idf AS (SELECT term, df, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), st),
part AS (SELECT id, term, idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) AS part FROM tf JOIN idf USING (term), st)"""


BOUNDARY = rf"[.!?]+{WS}+|\n{WS}*"


def sentences(x: str, key: str, source: str) -> str:
    """A query of (key, i, content, s, e): sentences in order from 1."""
    return f"""SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY k) AS i, content, s, s + length(content) AS e FROM (
  SELECT {key}, k, {strip('piece')} AS content, coalesce(sum(length(piece)) OVER (PARTITION BY {key} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    + length(piece) - length(regexp_replace(piece, '^{WS}+', '')) AS s
  FROM (SELECT {key}, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM (
    SELECT {key}, string_split(regexp_replace({x}, '({BOUNDARY})', '\\1' || chr(1), 'g'), chr(1)) AS p FROM {source} WHERE {x} IS NOT NULL))) WHERE content <> ''"""


def fold(spans: str, key: str, size: int) -> str:
    """A query of (key, start_char, end_char, content) over (key, i, content, s, e[, b]) without overlap; b: a break before."""
    b = "b" if "AS b" in spans else "false"
    one = "{'s': x.s, 'e': x.e, 'c': x.content}"
    return f"""SELECT {key}, unnest(chunks).s AS start_char, unnest(chunks).e AS end_char, unnest(chunks).c AS content FROM (
  SELECT {key}, list_reduce(list({{'s': s::BIGINT, 'e': e::BIGINT, 'content': content, 'b': {b}}} ORDER BY i),
    lambda a, x: CASE WHEN NOT x.b AND length(a[len(a)].c) + 1 + length(x.content) <= {size}
      THEN list_concat(a[:len(a) - 1], [{{'s': a[len(a)].s, 'e': x.e, 'c': a[len(a)].c || ' ' || x.content}}]) ELSE list_concat(a, [{one}]) END,
    [{{'s': 0::BIGINT, 'e': 0::BIGINT, 'c': repeat('x', {size})}}])[2:] AS chunks FROM ({spans}) GROUP BY {key})"""


def fold_overlapping(spans: str, key: str, size: int) -> str:
    """As fold(), the next chunk beginning with the last sentence of the one before. spans: (key, i, content, s, e, b)."""
    last = "a[len(a)]"
    grown = f"{{'s': z.s, 'e': x.e, 'c': z.c || ' ' || x.content, 'ls': x.s, 'lc': x.content}}"
    from_last = "{'s': z.ls, 'e': x.e, 'c': z.lc || ' ' || x.content, 'ls': x.s, 'lc': x.content}"
    one = "{'s': x.s, 'e': x.e, 'c': x.content, 'ls': x.s, 'le': x.e, 'lc': x.content}"
    grown, from_last = grown.replace("'lc'", "'le': x.e, 'lc'"), from_last.replace("'lc'", "'le': x.e, 'lc'")
    alone = "{'s': z.ls, 'e': z.le, 'c': z.lc, 'ls': z.ls, 'le': z.le, 'lc': z.lc}"
    fits = f"length(z.c) + 1 + length(x.content) <= {size}"
    closed = f"(CASE WHEN x.b THEN list_concat(a, list_transform([{last}], lambda z: {alone})) ELSE a END)"
    step = f"list_transform([{closed}], lambda a: list_transform([{last}], lambda z: CASE WHEN {fits} THEN list_concat(a[:len(a) - 1], [{grown}]) ELSE list_concat(a, [{from_last}]) END)[1])[1]"
    return f"""SELECT {key}, unnest(chunks).s AS start_char, unnest(chunks).e AS end_char, unnest(chunks).c AS content FROM (
  SELECT {key}, list_reduce(rest, lambda a, x: {step}, start) AS chunks FROM (
    SELECT {key}, list_transform(l[1:1], lambda x: {one}) AS start, l[2:] AS rest FROM (
      SELECT {key}, list({{'s': s::BIGINT, 'e': e::BIGINT, 'content': content, 'b': b}} ORDER BY i) AS l FROM ({spans}) GROUP BY {key})))"""


def rule_sentences(x: str, key: str, source: str, abbreviations: frozenset[str]) -> str:
    """A query of (key, i, s, e): as sentences(), but pieces that end in an abbreviation, an initial or an item's number go on."""
    names = ", ".join(map(quote, sorted(abbreviations)))
    return f"""SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY g) - 1 AS i, s, s + length(content) AS e FROM (
  SELECT {key}, g, {strip("piece")} AS content, p0 + length(piece) - length(regexp_replace(piece, '^{WS}+', '')) AS s FROM (
    SELECT {key}, g, string_agg(piece, '' ORDER BY k) AS piece, min(p0) AS p0 FROM (
      SELECT *, coalesce(sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM (
        SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY {key} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p0,
          starts_with(m, '.') AND NOT starts_with(m, '..') AND NOT contains(m, chr(10)) AND (w IN ({names}) OR regexp_full_match(w, '\\p{{L}}|[0-9]{{1,2}}')) AS goes_on FROM (
          SELECT *, lower(regexp_extract(piece[:length(piece) - length(m)], '[\\p{{L}}\\p{{N}}\\p{{M}}_.]*$')) AS w FROM (
            SELECT *, regexp_extract(piece, '([.!?]+{WS}+|\\n{WS}*)$') AS m FROM (
              SELECT {key}, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM (
                SELECT {key}, string_split(regexp_replace({x}, '({BOUNDARY})', '\\1' || chr(1), 'g'), chr(1)) AS p FROM {source} WHERE {x} IS NOT NULL))))))
    GROUP BY {key}, g)) WHERE content <> ''"""


def ruled_sentences(x: str, key: str, source: str) -> str:
    """A query of (key, i, s, e): by the rules for single stops. The tables have no quotation, bracket, list or run of dots with a stop that another rule would decide."""
    names = lambda words: "(" + ", ".join(map(quote, sorted(words))) + ")"
    ends = rf"[.!?…。！？]+[\"''”’»)\]]*{WS}+|\n{WS}*"
    digit = "(regexp_matches(a, '^[0-9]') OR a = '(')"
    lower = "(upper(a) <> a AND lower(a) = a)"
    goes_on = f"""CASE WHEN stop <> '.' OR contains(m, chr(10)) OR a = '' THEN false WHEN l IN {names(rules.TITLES)} THEN true WHEN l IN {names(rules.NUMBERED)} AND {digit} THEN true
      WHEN l IN {names(rules.ABBREVIATIONS | rules.NUMBERED)} THEN {lower} OR {digit} OR f = 'I' WHEN w IN ('A.M', 'P.M') THEN NOT (lower(a) <> a AND upper(a) = a)
      WHEN regexp_full_match(w, '(\\p{{L}}\\.)+\\p{{L}}') THEN f NOT IN {names(rules.STARTERS)} WHEN regexp_full_match(w, '\\p{{Lu}}') THEN NOT (w = 'I' AND f IN {names(rules.STARTERS)}) ELSE false END"""
    return f"""SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY g) - 1 AS i, s, s + length(content) AS e FROM (
  SELECT {key}, g, {strip("piece")} AS content, p0 + length(piece) - length(regexp_replace(piece, '^{WS}+', '')) AS s FROM (
    SELECT {key}, g, string_agg(piece, '' ORDER BY k) AS piece, min(p0) AS p0 FROM (
      SELECT *, coalesce(sum(CASE WHEN {goes_on} THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM (
        SELECT *, lower(w) AS l FROM (
          SELECT *, CASE WHEN contains(w0, '.') AND NOT regexp_full_match(w0, '(\\p{{L}}\\.)+\\p{{L}}') THEN regexp_extract(w0, '[^.]*$') ELSE w0 END AS w FROM (
            SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY {key} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p0, regexp_extract(m, '^[.!?…。！？]+') AS stop,
              ltrim(regexp_extract(piece[:length(piece) - length(m)], '[^ \\t\\n\\r\\f\\x0b]*$'), '"''“‘([{{«') AS w0,
              coalesce(lead(piece[1]) OVER (PARTITION BY {key} ORDER BY k), '') AS a, coalesce(lead(regexp_extract(piece, '^\\p{{L}}{{0,21}}')) OVER (PARTITION BY {key} ORDER BY k), '') AS f FROM (
              SELECT *, regexp_extract(piece, '({ends})$') AS m FROM (
                SELECT {key}, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM (
                  SELECT {key}, string_split(regexp_replace({x}, '({ends})', '\\1' || chr(1), 'g'), chr(1)) AS p FROM {source} WHERE {x} IS NOT NULL)))))))
    GROUP BY {key}, g)) WHERE content <> ''"""


def hashed_vector(tokens: str, dim: int) -> str:
    """The offline embedder's vector, before it is scaled."""
    return f"list_transform(range({dim}), lambda b: len(list_filter({tokens}, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % {dim} = b))::DOUBLE)"

"""DuckDB SQL for the rows of the document queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_WORDS = r"'[^\x20\x09-\x0D]+'"

DECONTAMINATION = f"""
WITH b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_low('text')}, {_ALNUM}) AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda k: array_to_string(w[k:k + least(len(w), 10) - 1], ' '))) AS win FROM b WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_low("coalesce(text, '')")}, {_ALNUM}) AS w FROM documents),
p AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
h AS (SELECT p.r, p.k, p.n, bw.item FROM p JOIN bw ON p.n = bw.n AND array_to_string(p.w[p.k:p.k + p.n - 1], ' ') = bw.win),
x AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS q FROM h) GROUP BY 1),
i AS (SELECT r, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS s FROM h GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN x USING (r) LEFT JOIN i USING (r)
"""

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_low("coalesce(text, '')")}, {_WORDS}) AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) END AS t FROM d),
u AS (SELECT r, len(t) AS n, unnest(t) AS x FROM s),
o AS (SELECT a.r AS a, b.r AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM o WHERE 100 * c >= 75 * (na + nb - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT r, r FROM s),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
m AS (SELECT reach.a AS r, min(s.doc_id) AS component_id FROM reach JOIN s ON reach.b = s.r GROUP BY 1)
SELECT s.doc_id, len(s.t)::BIGINT AS n_shingles, m.component_id FROM s JOIN m USING (r)
"""

LINE_DEDUP = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS no FROM d),
w AS (SELECT doc_id, no, row_number() OVER (ORDER BY doc_id NULLS FIRST, no) AS r, regexp_extract_all({_low('line')}, {_WORDS}) AS w FROM x),
s AS (SELECT doc_id, no, r, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) END AS t FROM w),
u AS (SELECT r, len(t) AS n, unnest(t) AS y FROM s),
o AS (SELECT a.r AS a, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM u a JOIN u b ON a.y = b.y AND b.r < a.r GROUP BY a.r, b.r),
g AS (SELECT DISTINCT s.doc_id, s.no FROM o JOIN s ON o.a = s.r WHERE 4 * c >= 3 * (na + nb - c)),
k AS (SELECT x.doc_id, count(*) AS n_lines, count(g.no) AS n_removed, string_agg(CASE WHEN g.no IS NULL THEN x.line END, chr(10) ORDER BY x.no) AS t FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.no = g.no GROUP BY 1)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.t, '')) AS text_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

#: The patterns as SQL's engine takes them: it doesn't go back and forth, so they need no possessive parts.
_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
}
_NEAR = {
    "email": "mail|contact|write|address|correo|courriel|schreib",
    "ip": r"\bip\b|host|server|address|adresse|login|client",
    "card": "card|visa|master|credit|karte|carte|tarjeta|payment|pay",
    "phone": r"phone|call|\btel|mobile|fax|whatsapp|anruf|appel|llama",
    "iban": "iban|bank|account|konto|compte|cuenta|transfer",
}
_SCORE = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.5, "iban": 0.9}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN reverse({_DIGITS})[k]::INT WHEN reverse({_DIGITS})[k]::INT > 4 THEN reverse({_DIGITS})[k]::INT * 2 - 9 ELSE reverse({_DIGITS})[k]::INT * 2 END)) % 10 = 0"
_TURNED = "(replace(m, ' ', '')[5:] || replace(m, ' ', '')[:4])"
_MOD97 = f"list_reduce(list_prepend(0, list_transform(range(1, length({_TURNED}) + 1), lambda k: CASE WHEN {_TURNED}[k] BETWEEN '0' AND '9' THEN ascii({_TURNED}[k]) - 48 ELSE ascii({_TURNED}[k]) - 55 END)), lambda a, c: (a * (CASE WHEN c > 9 THEN 100 ELSE 10 END) + c) % 97) = 1"
_VALID = {
    "email": "true",
    "ip": r"len(list_filter(string_split(m, '.'), lambda p: NOT regexp_full_match(p, '0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])'))) = 0",
    "card": f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
    "iban": _MOD97,
}


def _kind(place: int, kind: str) -> str:
    at = "coalesce(list_sum(list_transform(gs[:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(ms[:i - 1], lambda g: length(g))), 0)"
    return f"""SELECT r, t, {place} AS place, '{kind}' AS kind, ({at})::BIGINT AS a, m FROM (
  SELECT r, t, ms, gs, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m FROM (SELECT r, t, regexp_extract_all(t, '{_PII[kind]}') AS ms, regexp_split_to_array(t, '{_PII[kind]}') AS gs FROM d) WHERE len(ms) > 0)"""


PII = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
c AS ({' UNION ALL '.join(_kind(k, kind) for k, kind in enumerate(_PII))}),
v AS (SELECT *, a + length(m) AS b, lower(substring(t, greatest(a - 40, 0) + 1, a - greatest(a - 40, 0))) AS near FROM c WHERE CASE kind {' '.join(f"WHEN '{k}' THEN {x}" for k, x in _VALID.items())} END),
z AS (SELECT *, kind || ':' || a || ':' || b AS said, least(1.0, CASE kind {' '.join(f"WHEN '{k}' THEN {_SCORE[k]} + CASE WHEN regexp_matches(near, '{p}') THEN 0.2 ELSE 0 END" for k, p in _NEAR.items())} END)::DOUBLE AS score FROM v),
k AS (SELECT r, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ('email', 'ip', 'card', 'phone'))}, string_agg(said, ',' ORDER BY place, a) FILTER (kind <> 'iban') AS base, string_agg(said, ',' ORDER BY place, a) AS spans, sum(score) AS score FROM z GROUP BY 1)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in ('email', 'ip', 'card', 'phone'))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, round(coalesce(score, 0), 6) AS score_sum FROM d LEFT JOIN k USING (r)
"""

SUBSTRING_DEDUP = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT r, k, md5(array_to_string(w[k:k + 34], ' ')) AS p FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS k FROM d WHERE len(w) >= 35)),
often AS (SELECT p FROM starts GROUP BY p HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(k, k + 35)) AS k FROM starts SEMI JOIN often USING (p)),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY k) AS t FROM words ANTI JOIN gone USING (r, k) GROUP BY r),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN lost USING (r)
"""

COLLOCATIONS = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_low("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
s AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) AS v(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS lp, array_to_string(w[j + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
x AS (SELECT cut.lang, cut.phrase, cut.a, cut.j, l.f AS l, r.f AS r, (1000000::HUGEINT * cut.a * cut.a // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = cut.lp JOIN f r ON r.lang = cut.lang AND r.phrase = cut.rp),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY 1, 2),
k AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM k)
SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN s USING (lang) WHERE rank <= 2000
"""

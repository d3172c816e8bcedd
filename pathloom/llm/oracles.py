"""SQL for the operators that SQL can express on whole tables. Formulas differ from the operators', but for op6: its SQL takes the
rules' patterns from secrets.py and adds up the same lengths; tests/llm compares it with loops that share neither."""

from __future__ import annotations

from .secrets import BASE, RULES, Rule

WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

OP5 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS.format("text")} AS w FROM documents),
t AS (SELECT rid, len(w) AS n, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
g AS (SELECT rid, i, word, CASE WHEN i + 34 <= n THEN string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) END AS win FROM t),
c AS (SELECT win FROM g WHERE win IS NOT NULL GROUP BY win HAVING count(*) > 1),
m AS (SELECT rid, i, word, max(CASE WHEN c.win IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM g LEFT JOIN c ON g.win = c.win)
SELECT d.doc_id, CAST(len(any_value(d.w)) AS BIGINT) AS n_words, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '')) AS kept_sha256
FROM d LEFT JOIN m ON d.rid = m.rid GROUP BY d.rid, d.doc_id"""


def _spans(kind: int, rule: Rule) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""SELECT rid, {kind} AS kind, '{rule.name}' AS name, list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS st, length(ms[i]) AS n
FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT rid, string_split_regex(t, '{p}') AS ps, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {rule.group}) AS gs FROM d)) WHERE length(gs[i]) >= {rule.least}"""


_TOLD = "string_agg(name || ':' || CAST(st AS BIGINT) || ':' || CAST(st + n AS BIGINT), ',' ORDER BY st, kind)"
OP6 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_spans(k, r) for k, r in enumerate(RULES))})
SELECT d.doc_id, {", ".join(f"CAST(count(*) FILTER (kind = {k}) AS BIGINT) AS n_{r.name}" for k, r in enumerate(BASE))},
sha256(coalesce({_TOLD} FILTER (kind < {len(BASE)}), '')) AS base_sha256, coalesce({_TOLD}, '') AS spans
FROM d LEFT JOIN s ON d.rid = s.rid GROUP BY d.rid, d.doc_id"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP7 = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r AS (SELECT doc_id, doc_id AS at FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.at)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(r.at) FROM r WHERE r.doc_id = d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id"""

OP7_LINKS = OP7.replace("AS component_id FROM", "AS component_id, (SELECT count(*) FROM l WHERE l.x = d.doc_id) AS n_links FROM")

OP8 = """WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS t FROM documents),
g AS (SELECT rid, i, md5_number(array_slice(t, i, i + 399)) AS win FROM (SELECT rid, t, unnest(range(1, octet_length(t) - 398)) AS i FROM d)),
c AS (SELECT win FROM g GROUP BY win HAVING count(*) > 1),
s AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM g SEMI JOIN c ON g.win = c.win),
r AS (SELECT rid, i, sum(CASE WHEN i <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM s),
p AS (SELECT rid, run, min(i) AS st, max(i) + 399 AS en FROM r GROUP BY rid, run),
k AS (SELECT rid, list(st ORDER BY st) AS st, list(en ORDER BY st) AS en FROM p GROUP BY rid),
f AS (SELECT doc_id, t, coalesce(st, []) AS st, coalesce(en, []) AS en FROM d LEFT JOIN k ON d.rid = k.rid),
h AS (SELECT doc_id, octet_length(t) AS n_bytes, coalesce(list_sum(en) - list_sum(st), 0) + len(st) AS n_removed, len(st) AS n_spans,
array_to_string(list_transform(range(1, len(st) + 2), lambda j: hex(array_slice(t, CASE WHEN j = 1 THEN 1 ELSE en[j - 1] + 1 END, CASE WHEN j > len(st) THEN octet_length(t) ELSE st[j] - 1 END))), '') AS kept FROM f)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256, CAST(n_bytes - n_removed AS BIGINT) AS kept_bytes FROM h"""

_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_CHUNK = "CAST('0x' || substr(sha1(h), 5 * k + 1, 5) AS BIGINT)"
OP9 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
array_to_string(list_transform(range(8), lambda k: {" || ".join(f"substr({_BASE32}, CAST(({_CHUNK} >> {s}) & 31 AS BIGINT) + 1, 1)" for s in (15, 10, 5, 0))}), '') AS payload_digest,
CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM p"""

OP10 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

OP11 = OP7.replace("len(w) - 4, least", "len(w) - 3, least").replace("w[i:i + 4]", "w[i:i + 3]").replace(">= 75 *", ">= 80 *")
OP11 = "SELECT *, doc_id = component_id AS kept FROM (" + OP11 + ")"

OP12 = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, list_transform(range(4), lambda k: CAST('0x' || substr(sha256('1:' || doc_id), CAST(8 * k + 1 AS BIGINT), 8) AS BIGINT)) AS h FROM documents),
c AS (SELECT *, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS x, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS y,
CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, t, len(u) AS n, form, coalesce(array_to_string(u[1:x], ''), '') AS p, coalesce(array_to_string(u[x + 1:y], ''), '') AS m, coalesce(array_to_string(u[y + 1:], ''), '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

_LENGTHS = " UNION ALL ".join(f"SELECT lang, {k} AS k, array_to_string(w[i:i + {k - 1}], ' ') AS p, count(*) AS f FROM (SELECT lang, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM g) GROUP BY ALL" for k in range(1, 6))
OP13 = f"""WITH g AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
n AS (SELECT lang, sum(len(w)) AS n FROM g GROUP BY lang), f AS ({_LENGTHS}), o AS (SELECT *, string_split(p, ' ') AS w FROM f WHERE f >= 100),
c AS (SELECT o.lang, o.k, o.p, o.w, o.f AS a, x.f AS l, y.f AS r, n.n, CAST(1000 AS HUGEINT) * o.f * n.n // (CAST(x.f AS HUGEINT) * y.f) AS score, x.k AS cut FROM o JOIN n ON n.lang = o.lang
JOIN o x ON x.lang = o.lang AND x.k < o.k AND x.p = array_to_string(o.w[1:x.k], ' ') JOIN o y ON y.lang = o.lang AND y.k = o.k - x.k AND y.p = array_to_string(o.w[x.k + 1:], ' ')),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
s AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM b z WHERE z.lang = b.lang AND z.k > b.k AND z.a >= b.a AND contains(' ' || z.p || ' ', ' ' || b.p || ' ')))
SELECT lang, CAST(rank AS BIGINT) AS rank, p AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM s) WHERE rank <= 2000"""

ORACLES: dict[str, str] = {"op5_suffix_tree": OP5, "op6_secrets": OP6, "op7_jaccard": OP7, "op7_links": OP7_LINKS, "op8_suffix_array": OP8, "op9_warc": OP9, "op10_bit_sliced": OP10, "op11_minhash": OP11, "op12_fim": OP12, "op13_phrases": OP13}

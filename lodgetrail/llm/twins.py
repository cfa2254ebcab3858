"""SQL twins of the queries that SQL can express on whole tables."""

from __future__ import annotations

_WORDS = r"""regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"""
_PLAIN = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
_FOLDED = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""

#: The unsigned CRC-32 of a short ASCII string, byte by byte and bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda c: ascii(c)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(({value})::VARCHAR))::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _levels(name: str, depth: int) -> str:
    """Common table expressions ``<name>0`` (given: g, i, d) to ``<name><depth>``: each the parents of the one before, or its lone nodes."""
    steps = []
    for k in range(depth):
        steps.append(f"""{name}{k + 1} AS (SELECT g, i // 16 AS i, CASE WHEN max(n) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d
  FROM (SELECT g, i, d, count(*) OVER (PARTITION BY g) AS n FROM {name}{k}) GROUP BY g, i // 16)""")
        steps.append(f"""{name}b{k} AS (SELECT g, i, n, coalesce(string_agg(d, '') OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS x,
  coalesce(string_agg(d, '') OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS y
  FROM (SELECT g, i, d, count(*) OVER (PARTITION BY g) AS n FROM {name}{k}))""")
    return ",\n".join(steps)


def _manifest_sql(depth: int = 5, upper: int = 3) -> str:
    """Leaves, levels and proofs, level by level; levels above a tree's top hand its root on."""
    fields = "doc_id source lang n_chars text".split()
    leaf = " || ".join(_field(f) for f in fields)
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    other = " || ".join(_field(low if f == "text" else f) for f in fields)
    rows = f"""rows AS (SELECT doc_id, source, coalesce('=' || source, '-') AS g, sha256({leaf}) AS leaf,
  sha256(CASE WHEN {_CRC.format("doc_id::VARCHAR")} % 5 = 0 THEN {other} ELSE {leaf} END) AS changed FROM documents),
t0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS d, doc_id, changed FROM rows)"""
    subroots = f"u0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, d, g AS own FROM t{depth})"
    folds = [f"f0 AS (SELECT t0.g, t0.i, doc_id, t0.d AS leaf, t{depth}.d AS subroot, changed AS fold, '' AS proof FROM t0 JOIN t{depth} USING (g))"]
    for k in range(depth):
        folds.append(f"""f{k + 1} AS (SELECT f.g, f.i // 16 AS i, doc_id, leaf, subroot, CASE WHEN b.n = 1 THEN fold ELSE sha256(x || fold || y) END AS fold,
  proof || CASE WHEN b.n = 1 THEN '' ELSE x || y END AS proof FROM f{k} f JOIN tb{k} b ON b.g = f.g AND b.i = f.i)""")
    folds.append(f"h0 AS (SELECT u0.g, u0.i, doc_id, leaf, subroot, fold, proof FROM f{depth} f JOIN u0 ON u0.own = f.g)")
    for k in range(upper):
        folds.append(f"""h{k + 1} AS (SELECT h.g, h.i // 16 AS i, doc_id, leaf, subroot, CASE WHEN b.n = 1 THEN fold ELSE sha256(x || fold || y) END AS fold,
  proof || CASE WHEN b.n = 1 THEN '' ELSE x || y END AS proof FROM h{k} h JOIN ub{k} b ON b.g = h.g AND b.i = h.i)""")
    parts = [rows, _levels("t", depth), subroots, _levels("u", upper), *folds]
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, u.d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = u.d AS verified FROM h{upper} h JOIN u{upper} u ON u.g = h.g"""


def _repair_sql() -> str:
    """Damage, faults, and the cheapest edits turn by turn over the four grammar states."""
    return r"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce('=' || conv_id, '-') AS g, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
z AS (SELECT *, """ + _CRC.format("k") + r""" % 20 AS z FROM c),
t AS (SELECT g, turn, CASE z WHEN 4 THEN 'user' ELSE role END AS role, CASE z WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(0, CASE z WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM z),
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
  row_number() OVER (PARTITION BY g, role, text ORDER BY turn NULLS FIRST, copy) AS seen, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ends FROM t),
o AS (SELECT g, i, turn, role, text, left(role, 1) AS r, CASE WHEN ends = '' THEN 1 WHEN seen > 1 THEN 2 WHEN ends NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f FROM n),
ins(q, w, m, x) AS (VALUES (0, '', 0, 0), (0, 'I', 2, 3), (0, 'II', 3, 6), (1, '', 1, 0), (1, 'I', 2, 3), (1, 'II', 3, 6), (2, '', 2, 0), (2, 'I', 3, 3), (2, 'II', 2, 6), (3, '', 3, 0), (3, 'I', 2, 3), (3, 'II', 3, 6)),
edit(q, e, r, m, x) AS (VALUES (0, 'D', NULL, 0, 4), (1, 'D', NULL, 1, 4), (2, 'D', NULL, 2, 4), (3, 'D', NULL, 3, 4), (0, 'R', NULL, 2, 3), (1, 'R', NULL, 2, 3), (2, 'R', NULL, 3, 3), (3, 'R', NULL, 2, 3),
  (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0)),
walk AS (SELECT DISTINCT g, 0::BIGINT AS i, 0 AS q, {'c': 0, 'a': ''} AS v FROM c
  UNION ALL
  SELECT walk.g, o.i, edit.m AS q, min({'c': v.c + ins.x + edit.x + CASE WHEN o.f = 3 AND edit.e <> 'D' THEN 3 ELSE 0 END, 'a': v.a || ins.w || edit.e}) AS v
  FROM walk JOIN o ON o.g = walk.g AND o.i = walk.i + 1 JOIN ins ON ins.q = walk.q JOIN edit ON edit.q = ins.m AND (edit.r IS NULL OR edit.r = o.r) AND (edit.e = 'D' OR o.f NOT IN (1, 2))
  GROUP BY walk.g, o.i, edit.m),
size AS (SELECT g, count(*) AS n FROM o GROUP BY g),
best AS (SELECT walk.g, min({'c': v.c + ins.x, 'a': v.a || ins.w}) AS v FROM walk LEFT JOIN size ON size.g = walk.g JOIN ins ON ins.q = walk.q AND ins.m IN (0, 3) WHERE walk.i = coalesce(size.n, 0) GROUP BY walk.g),
letter AS (SELECT g, v.a AS a, unnest(range(1, length(v.a) + 1)) AS p FROM best),
put AS (SELECT letter.g, p, a[p] AS e, o.role, coalesce(o.text, '') AS text, row_number() OVER (PARTITION BY letter.g ORDER BY p) AS j FROM letter
  LEFT JOIN o ON o.g = letter.g AND a[p] <> 'I' AND o.i = length(replace(left(a, p), 'I', '')) WHERE a[p] <> 'D'),
opened AS (SELECT g, 1 AS s FROM put WHERE j = 1 AND e = 'K' AND left(role, 1) = 's'),
line AS (SELECT put.g, j, CASE WHEN e = 'K' THEN role WHEN (j - coalesce(s, 0)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END AS t FROM put LEFT JOIN opened ON opened.g = put.g),
whole AS (SELECT g, string_agg(t, chr(10) ORDER BY j) AS t FROM line GROUP BY g),
pair AS (SELECT g, lag(r) OVER (PARTITION BY g ORDER BY i) || r AS rr FROM o),
bad AS (SELECT g, count(*) AS n FROM pair WHERE rr NOT IN ('su', 'ua', 'au') GROUP BY g),
fact AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum((f = 1)::INT) AS blank, sum((f = 2)::INT) AS duplicate, sum((f = 3)::INT) AS truncated FROM o GROUP BY g),
own AS (SELECT DISTINCT conv_id, g FROM c)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(bad.n, 0)::BIGINT AS illegal, best.v.c::BIGINT AS cost, best.v.a AS audit, sha256(coalesce(whole.t, '')) AS repaired_sha256
FROM own JOIN best ON best.g = own.g LEFT JOIN fact ON fact.g = own.g LEFT JOIN bad ON bad.g = own.g LEFT JOIN whole ON whole.g = own.g"""


TWINS = {
    "op3_substrings": f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
first AS (SELECT s, min({{'d': doc_id, 'i': i}}) AS m FROM win GROUP BY s),
again AS (SELECT doc_id, i FROM win JOIN first USING (s) WHERE doc_id > m.d OR (doc_id = m.d AND i > m.i)),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(range(0, 20)) AS k FROM again)),
single AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM single ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id""",
    "op4_minhash": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_FOLDED} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
meet AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM meet JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT DISTINCT a AS d, a AS m FROM link UNION SELECT reach.d, link.b FROM reach, link WHERE link.a = reach.m)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, w.doc_id)::BIGINT AS component_id, coalesce(component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT d, min(m) AS component_id FROM reach GROUP BY d) comp ON comp.d = w.doc_id""",
    "op7_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE list_count(embedding) = len(embedding) AND isfinite(list_sum(embedding::DOUBLE[])) AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a),
reach AS (SELECT DISTINCT a AS d, a AS m FROM link UNION SELECT reach.d, link.b FROM reach, link WHERE link.a = reach.m)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(m, vec_id)::BIGINT AS component_id, coalesce(m, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN (SELECT d, min(m) AS m FROM reach GROUP BY d) comp ON comp.d = vec_id""",
    "op9_quality": f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, ws[i:i + 4] AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(range(0, 5)) AS k FROM twice)) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (len(t) - len(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN lines ON lines.doc_id = w.doc_id LEFT JOIN rep ON rep.doc_id = w.doc_id),
b AS (SELECT *, ((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (100 * n_symbols > 10 * word_chars)::INT
  + 8 * (100 * n_dup_lines > 60 * n_lines)::INT + 16 * (word_chars > 20 * n_words)::INT)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM b""",
    "op11_decontamination": f"""
WITH d AS (SELECT doc_id, {_PLAIN} AS ws FROM documents),
i AS (SELECT item_id, {_PLAIN} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[k:k + n - 1], ' ') AS s FROM
  (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS k FROM i WHERE len(ws) > 0)),
size AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, k, n, array_to_string(ws[k:k + n - 1], ' ') AS s FROM
  (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d CROSS JOIN size WHERE len(ws) >= n)),
hit AS (SELECT doc_id, k, n, item_id FROM dw JOIN iw USING (n, s)),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, k + unnest(range(0, n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM hit)) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS xs FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(item.n, 0)::BIGINT AS n_items, sha256(coalesce(xs, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word ON word.doc_id = d.doc_id LEFT JOIN item ON item.doc_id = d.doc_id""",
    "op12_manifest": _manifest_sql(),
    "op13_conversations": _repair_sql(),
}

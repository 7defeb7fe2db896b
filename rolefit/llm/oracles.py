"""The queries' results as plain DuckDB SQL, for the operators that SQL can express."""

from __future__ import annotations

WORDS = r"'[^\x20\x09-\x0D]+'"
LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_VECTORS = """
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT r.vec_id, coalesce(n.n_links, 0) AS n_links, r.component_id, r.vec_id = r.component_id AS kept
FROM (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a) r
LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) n ON n.a = r.vec_id
"""

REPEATS = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS words FROM documents
), starts AS (
  SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS passage FROM d, unnest(range(1, len(words) - 33)) AS t(i)
), repeated AS (
  SELECT doc_id, i FROM starts WHERE passage IN (SELECT passage FROM starts GROUP BY passage HAVING count(*) > 1)
), covered AS (
  SELECT DISTINCT doc_id, p FROM repeated, unnest(range(i, i + 35)) AS t(p)
), kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.p) AS words, count(*) AS n
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM d) w
  ANTI JOIN covered c ON c.doc_id = w.doc_id AND c.p = w.p
  GROUP BY w.doc_id
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, (len(d.words) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.words, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def _shingles(table: str, key: str) -> str:
    return f"""
  SELECT DISTINCT {key}, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[i:i + 4], ' ') END AS shingle
  FROM (SELECT {key}, regexp_extract_all({LOWERED.format('text')}, {WORDS}) AS words FROM {table} WHERE text IS NOT NULL) x,
    unnest(range(1, greatest(len(words) - 4, least(len(words), 1)) + 1)) AS t(i)
"""


CONTAINED = f"""
WITH lengths AS (
  SELECT DISTINCT len(regexp_extract_all(text, {WORDS})) AS n FROM benchmark WHERE len(regexp_extract_all(text, {WORDS})) BETWEEN 2 AND 4
), d AS ({_shingles('documents', 'doc_id')}
  UNION SELECT doc_id, array_to_string(words[i:i + n - 1], ' ') AS shingle
  FROM (SELECT doc_id, regexp_extract_all({LOWERED.format('text')}, {WORDS}) AS words FROM documents WHERE text IS NOT NULL) x
    JOIN lengths ON len(words) > n, unnest(range(1, len(words) - n + 2)) AS t(i)
), b AS ({_shingles('benchmark', 'item_id')}),
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id)
SELECT d.doc_id, b.item_id, count(*) AS n_shared, any_value(n.n_shingles) AS n_shingles
FROM d JOIN b USING (shingle) JOIN n ON n.item_id = b.item_id
GROUP BY d.doc_id, b.item_id HAVING count(*) >= 0.8 * any_value(n.n_shingles) - 1e-9
"""

LINES = f"""
WITH all_lines AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> '') x
), tokens AS (
  SELECT DISTINCT doc_id, k, unnest(regexp_extract_all(line, {WORDS})) AS token FROM all_lines
), counts AS (
  SELECT token, count(*) AS df FROM tokens GROUP BY token
), ordered AS (
  SELECT doc_id, k, token, row_number() OVER (PARTITION BY doc_id, k ORDER BY df, token) AS place, count(*) OVER (PARTITION BY doc_id, k) AS n
  FROM tokens JOIN counts USING (token)
), prefix AS (
  SELECT * FROM ordered WHERE place <= n - ceil(0.8 * n - 1e-9) + 1
), pairs AS (
  SELECT DISTINCT x.doc_id AS xd, x.k AS xk, x.n AS xn, y.doc_id AS yd, y.k AS yk, y.n AS yn
  FROM prefix x JOIN prefix y ON x.token = y.token AND (x.doc_id, x.k) < (y.doc_id, y.k) AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)
), gone AS (
  SELECT DISTINCT yd AS doc_id, yk AS k FROM (
    SELECT xd, xk, yd, yk FROM pairs p JOIN tokens x ON x.doc_id = p.xd AND x.k = p.xk JOIN tokens y ON y.doc_id = p.yd AND y.k = p.yk AND y.token = x.token
    GROUP BY xd, xk, yd, yk HAVING 5 * count(*) >= 4 * (any_value(xn) + any_value(yn) - count(*))
  ) s
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.k) AS text, count(*) AS n FROM all_lines l
  ANTI JOIN gone g ON g.doc_id = l.doc_id AND g.k = l.k GROUP BY l.doc_id
), total AS (SELECT doc_id, count(*) AS n FROM all_lines GROUP BY doc_id)
SELECT d.doc_id, coalesce(total.n, 0) AS n_lines, coalesce(total.n, 0) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN total ON total.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?::[0-9]*)?(?:[/?#]|$)', 1))"

LISTED = rf"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + (page_id % 366)::INT AS seen_at, {HOST} AS host, regexp_extract(url, '^[A-Za-z]+://[^/]+/([a-z]+)', 1) AS section,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> '') AS segments
  FROM pages
), patterns AS (
  SELECT page_id, host AS pattern FROM p WHERE host <> ''
  UNION ALL SELECT page_id, host || '/' || section FROM p WHERE host <> '' AND section <> ''
), seen AS (
  SELECT pattern, min(page_id) AS first, count(*) AS n FROM patterns GROUP BY pattern HAVING substr(md5(pattern), 1, 1) < '8'
), entries AS (
  SELECT pattern, DATE '2024-01-01' + (first % 150)::INT AS valid_from, true AS listed FROM seen
  UNION ALL SELECT pattern, DATE '2024-01-01' + (150 + n % 100)::INT, false FROM seen
  UNION ALL SELECT pattern, DATE '2024-01-01' + (250 + first % 100)::INT, n % 2 = 0 FROM seen
), one AS (
  SELECT pattern, valid_from, bool_or(listed) AS listed FROM entries GROUP BY pattern, valid_from
), held AS (
  SELECT * FROM (SELECT *, lead(valid_from) OVER (PARTITION BY pattern ORDER BY valid_from) AS valid_to FROM one) x WHERE listed
), asked AS (
  SELECT page_id, seen_at, array_to_string(string_split(host, '.')[k:], '.') AS pattern FROM p, unnest(range(1, len(string_split(host, '.')) + 1)) AS t(k) WHERE host <> ''
  UNION SELECT page_id, seen_at, host || '/' || array_to_string(segments[1:k], '/') FROM p, unnest(range(1, len(segments) + 1)) AS t(k) WHERE host <> ''
), hit AS (
  SELECT page_id, a.pattern, length(a.pattern) AS l FROM asked a JOIN held h ON a.pattern = h.pattern AND seen_at >= valid_from AND (valid_to IS NULL OR seen_at < valid_to)
), per AS (
  SELECT page_id, count(*) AS n, first(pattern ORDER BY l DESC, pattern) AS matched FROM hit GROUP BY page_id
)
SELECT p.page_id, strftime(p.seen_at, '%Y-%m-%d') AS fetched_at, coalesce(per.n, 0) AS n_matches, per.matched, per.n IS NOT NULL AS blocked
FROM p LEFT JOIN per ON per.page_id = p.page_id
"""

#: crc32 of a number's decimal digits, bit by bit.
CRC_OF_ID = """xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b:
    list_reduce(range(8), lambda d, i: CASE WHEN d % 2 = 1 THEN xor(d // 2, 3988292384) ELSE d // 2 END, xor(c, b)), 4294967295), 4294967295)"""


def _leaf(text: str) -> str:
    fields = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    return "sha256(concat(" + ", ".join(f"coalesce(octet_length(encode({f}))::VARCHAR || ':' || {f}, '-')" for f in fields) + "))"


MANIFEST = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
    {_leaf("text")} AS leaf, CASE WHEN {CRC_OF_ID} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS given
  FROM documents
), up(source, lvl, pos, n, h) AS (
  SELECT source, 0, pos, n, leaf FROM leaves
  UNION ALL
  SELECT source, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY source, lvl, pos // 3, n
), subroots AS (
  SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1
), over(lvl, pos, n, h) AS (
  SELECT 0, pos, n, h FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM over WHERE n > 1 GROUP BY lvl, pos // 3, n
), folded(doc_id, source, lvl, pos, h, proof) AS (
  SELECT doc_id, source, 0, pos, given, '' FROM leaves
  UNION ALL
  SELECT f.doc_id, f.source, f.lvl + 1, f.pos // 3, sha256(string_agg(CASE WHEN u.pos = f.pos THEN f.h ELSE u.h END, '' ORDER BY u.pos)),
    f.proof || coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (WHERE u.pos <> f.pos), '')
  FROM folded f JOIN up u ON u.source IS NOT DISTINCT FROM f.source AND u.lvl = f.lvl AND u.pos // 3 = f.pos // 3 AND u.n > 1
  GROUP BY f.doc_id, f.source, f.lvl, f.pos, f.h, f.proof
), sources AS (
  SELECT source, max(lvl) AS top FROM up GROUP BY source
), raised(doc_id, lvl, pos, h, proof) AS (
  SELECT f.doc_id, 0, s.pos, f.h, f.proof FROM folded f JOIN sources t ON t.source IS NOT DISTINCT FROM f.source AND t.top = f.lvl
  JOIN subroots s ON s.source IS NOT DISTINCT FROM f.source
  UNION ALL
  SELECT f.doc_id, f.lvl + 1, f.pos // 3, sha256(string_agg(CASE WHEN u.pos = f.pos THEN f.h ELSE u.h END, '' ORDER BY u.pos)),
    f.proof || coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (WHERE u.pos <> f.pos), '')
  FROM raised f JOIN over u ON u.lvl = f.lvl AND u.pos // 3 = f.pos // 3 AND u.n > 1
  GROUP BY f.doc_id, f.lvl, f.pos, f.h, f.proof
)
SELECT l.doc_id, l.leaf, s.h AS subroot, o.h AS root, sha256(r.proof) AS proof_sha256, r.h AS folded_root, r.h = o.h AS verified
FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
JOIN over o ON o.n = 1 JOIN raised r ON r.doc_id = l.doc_id AND r.lvl = o.lvl
"""

ORACLES = {
    "op2_embedding_near_dedup": NEAR_VECTORS,
    "op3_substring_dedup": REPEATS,
    "op7_decontamination": CONTAINED,
    "op8_line_dedup": LINES,
    "op9_url_filter": LISTED,
    "op12_merkle_manifest": MANIFEST,
}

"""DuckDB SQL for the queries of this subpackage that SQL can say."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]"

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}+') AS ws FROM d),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS g FROM w, unnest(range(1, CAST(len(ws) AS BIGINT) - 6)) AS r(i)),
again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
step AS (SELECT doc_id, least(8, lead(i, 1, i + 8) OVER (PARTITION BY doc_id ORDER BY i) - i) AS n FROM again),
rep AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_repeat_words FROM step GROUP BY doc_id),
ln AS (SELECT doc_id, host, text, line FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln GROUP BY doc_id),
nl AS (SELECT doc_id, host, text, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm, len(regexp_extract_all(line, '{_WORD}+')) AS words FROM ln),
often AS (SELECT host, norm, min(doc_id) AS first_doc, count(DISTINCT doc_id) AS n_docs FROM nl GROUP BY host, norm),
hosts AS (SELECT host, count(DISTINCT doc_id) AS host_docs FROM d GROUP BY host),
gone AS (SELECT doc_id, CAST(sum(words) AS BIGINT) AS removed_words, count(*) AS removed_lines FROM nl JOIN often o USING (host, norm) JOIN hosts USING (host)
    WHERE n_docs > 30 AND n_docs > 0.001 * host_docs AND nl.doc_id <> o.first_doc GROUP BY doc_id),
b AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words, coalesce(removed_lines, 0) AS removed_lines
    FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (n_words - removed_words < 0.2 * n_words) AS kept FROM b
"""


NGRAM_JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g FROM d, unnest(range(1, greatest(2, CAST(len(w) AS BIGINT) - 2))) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS name FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
link AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(doc_id, other) AS (SELECT a, b FROM link UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other),
least_of AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id),
class AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY name) AS class_id FROM n)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(class_id, doc_id) AS class_id, least(doc_id, coalesce(other, doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN class USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""


def chat_format(marked: str) -> str:
    return rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '{marked}'), (-1, 1, 'assistant', '{marked}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(33 + length(role) + length(text) + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


_SECRETS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)""", "length(regexp_extract(hit, '{p}', 2)) >= 6"),
    "access": (r"AKIA[A-Z0-9]+", "length(hit) >= 20"),
    "hex": (r"[0-9a-f]+", "length(hit) >= 24"),
    "key_part": (r"[A-Za-z0-9/+_=-]+", "length(hit) >= 32 AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') AND NOT regexp_full_match(hit, '[0-9a-f]+')"),
    "endpoint": (r"https?://[A-Za-z0-9._:/-]{4,}|[0-9]{1,3}(?:[.][0-9]{1,3}){3}(?::[0-9]{1,5})?", "true"),
    "account": (r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:[.][A-Za-z0-9-]{1,63}){1,8}", "true"),
}


def secret_scan(scope: int) -> str:
    def kind(rank: int, name: str, pattern: str, keep: str) -> str:
        p = pattern.replace("'", "''")
        return rf"""{name} AS (SELECT doc_id, start, {rank} AS rank, '{name}' AS kind, start + length(hit) AS stop FROM (
            SELECT doc_id, m[j] AS hit, CAST(list_sum(list_transform(list_slice(g, 1, j), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, j - 1), lambda x: length(x))), 0) AS BIGINT) AS start
            FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM d), unnest(range(1, CAST(len(m) AS BIGINT) + 1)) AS r(j)) WHERE {keep.replace("{p}", p)})"""

    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{", ".join(kind(i, name, *rule) for i, (name, rule) in enumerate(_SECRETS.items()))},
part AS ({" UNION ALL ".join(f"SELECT * FROM {k}" for k in _SECRETS)}),
need(weak, other) AS (VALUES ('key_part', 'access'), ('key_part', 'account'), ('key_part', 'endpoint'), ('endpoint', 'access'), ('endpoint', 'assign'), ('endpoint', 'hex'), ('endpoint', 'key_part'),
    ('account', 'assign'), ('account', 'hex'), ('account', 'key_part')),
added AS (SELECT w.* FROM part w WHERE EXISTS (SELECT 1 FROM part o JOIN need ON need.weak = w.kind AND need.other = o.kind WHERE o.doc_id = w.doc_id
    AND o.start <= w.stop + {scope} AND w.start <= o.stop + {scope} AND (o.stop <= w.start OR w.stop <= o.start))),
every AS (SELECT * FROM part WHERE rank < 3 UNION ALL SELECT * FROM added),
per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3), '') AS b, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS a FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM d LEFT JOIN per USING (doc_id)
"""


HARD_NEGATIVES = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT * FROM (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score) WHERE rank <= 10
"""


FILL_IN_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS tokens, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) for i in range(4)] AS x FROM d),
c AS (SELECT *, len(tokens) AS n, least(x[1] % (len(tokens) + 1), x[2] % (len(tokens) + 1)) AS a, greatest(x[1] % (len(tokens) + 1), x[2] % (len(tokens) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 90 THEN 'plain' WHEN x[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
o AS (SELECT *, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""

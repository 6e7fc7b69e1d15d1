"""What queries of numbered operators must return, as SQL over the given tables."""

from __future__ import annotations

# CRC-32 of a list of bytes, from its table of 256 entries; ``t`` is that table.
_CRC_TABLE = """crc_table AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END,
    i) ORDER BY i) AS t FROM range(256) r(i))"""
_CRC = "xor(list_reduce({0}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"
_BYTES = "list_transform(range(length(hex(encode({0}))) // 2), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT)"


def crc32(text: str) -> str:
    return _CRC.format(_BYTES.format(text))


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _features(table: str) -> str:
    return f"""SELECT row_no, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature
        FROM (SELECT row_no, {_TERMS} AS w FROM {table})"""


RESAMPLING = f"""
WITH {_CRC_TABLE},
docs AS (SELECT row_number() OVER () AS row_no, doc_id, text FROM documents),
goal AS (SELECT row_number() OVER () AS row_no, text FROM benchmark),
of_docs AS ({_features('docs')}), of_goal AS ({_features('goal')}),
coded AS (SELECT feature, {crc32('feature')} % 10000 AS bucket FROM (SELECT feature FROM of_docs UNION SELECT feature FROM of_goal), crc_table),
s AS (SELECT bucket, count(*) AS s FROM of_docs JOIN coded USING (feature) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM of_goal JOIN coded USING (feature) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM of_docs) + 10000)
    / ((s + 1.0::DOUBLE) * ((SELECT count(*) FROM of_goal) + 10000)))) AS gain FROM s LEFT JOIN t USING (bucket)),
weighed AS (SELECT row_no, count(*) AS n, floor(sum(gain) / count(*)) AS weight FROM of_docs JOIN coded USING (feature) JOIN gain USING (bucket) GROUP BY row_no),
scored AS (SELECT row_no, doc_id, len({_TERMS}) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM docs LEFT JOIN weighed USING (row_no)),
ranked AS (SELECT row_no, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20 AND doc_id IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (row_no)
"""

SUBSTRINGS = r"""
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT row_no, doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM docs)),
least AS (SELECT h, min(doc_id) AS least FROM windows GROUP BY h),
gone AS (SELECT DISTINCT row_no, unnest(range(i, i + 13)) AS i FROM windows JOIN least USING (h) WHERE doc_id > least),
kept AS (SELECT row_no, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept
    FROM (SELECT row_no, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs) ANTI JOIN gone USING (row_no, i) GROUP BY row_no)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (row_no)
"""

TRIE = rf"""
WITH {_CRC_TABLE},
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS k, d, n_words FROM (
    SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_words FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT conv_id, {crc32('conv_id::VARCHAR')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
built AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, k) AS k, d, n_words FROM (
    SELECT c.conv_id, 0 AS own, t.k, d, n_words FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.k <= h
    UNION ALL SELECT c.conv_id, 1, t.k, d, n_words FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.k > h)),
steps AS (SELECT conv_id, k AS depth, n_words, string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY k) AS path FROM built),
members AS (SELECT conv_id, depth, path, n_words FROM steps UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
lengths AS (SELECT conv_id, max(depth) AS n FROM members GROUP BY conv_id),
nodes AS (SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_words) AS n_words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = n), '')) AS ends_sha256
    FROM members JOIN lengths USING (conv_id) GROUP BY path),
children AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (path)),
below AS (SELECT left(path, 32 * unnest(range(0, depth + 1))) AS path, (n_children = 0)::INT AS leaf, (n_convs - 1) * n_words AS saved FROM full_nodes),
subtrees AS (SELECT path, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM below GROUP BY path)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM full_nodes f JOIN subtrees USING (path) LEFT JOIN nodes p ON f.depth > 0 AND p.path = left(f.path, length(f.path) - 32)
"""

ORACLES = {"op11_prefix_crc_resampling": RESAMPLING, "op12_anchor_substrings": SUBSTRINGS, "op13_sparse_table_trie": TRIE}

"""DuckDB twins of the queries that SQL can express."""

OP3 = """
WITH whole AS (
    SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), met AS (
    SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, d.v)]) AS BIGINT) AS score
    FROM whole q JOIN whole d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id
), placed AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM met
)
SELECT * FROM placed WHERE rank <= 20
"""

OP5 = r"""
WITH docs AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source
), weighed AS (
    SELECT *, 1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS weight FROM sources
), tight AS (
    SELECT *, coalesce(sum(source_size) OVER before, 0) AS size_before, coalesce(sum(weight) OVER before, 0) AS weight_before,
        sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight
    FROM weighed
    WINDOW before AS (ORDER BY source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), units AS (
    SELECT *, CAST(all_size - 3 * size_before AS DOUBLE) / CAST(all_weight - weight_before AS DOUBLE) AS unit FROM tight
), limits AS (
    SELECT *, weight * unit > CAST(3 * source_size AS DOUBLE) AS full_ FROM units
), level AS (
    SELECT arg_min(unit, weight_before) AS unit FROM limits WHERE NOT full_
), targets AS (
    SELECT source, source_size, weight, CASE WHEN full_ THEN CAST(3 * source_size AS DOUBLE) ELSE weight * (SELECT unit FROM level) END AS target
    FROM limits
), placed AS (
    SELECT doc_id, size, source_size, weight, target,
        sum(size) OVER (PARTITION BY d.source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id ROWS UNBOUNDED PRECEDING) - size AS start
    FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), middles AS (
    SELECT *, CAST(start AS DOUBLE) + CAST(size AS DOUBLE) / 2 AS m0, CAST(source_size + start AS DOUBLE) + CAST(size AS DOUBLE) / 2 AS m1,
        CAST(2 * source_size + start AS DOUBLE) + CAST(size AS DOUBLE) / 2 AS m2
    FROM placed
), shares AS (
    SELECT *, CASE WHEN target > 0 THEN m0 / target ELSE 0.0::DOUBLE END AS share,
        CAST(m0 <= target AS INTEGER) + CAST(m1 <= target AS INTEGER) + CAST(m2 <= target AS INTEGER) AS copies
    FROM middles
)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
    CASE WHEN copies = 0 THEN NULL
    WHEN weight = 1 THEN 0.0::DOUBLE + 2.0::DOUBLE * (share * 1.5::DOUBLE - 0.0::DOUBLE) / (2.0::DOUBLE + sqrt(4.0::DOUBLE + 2.0::DOUBLE * (share * 1.5::DOUBLE - 0.0::DOUBLE) * -1.0::DOUBLE))
    WHEN weight = 2 THEN CASE WHEN share * 1.5::DOUBLE <= 0.75::DOUBLE
        THEN 0.0::DOUBLE + 2.0::DOUBLE * (share * 1.5::DOUBLE - 0.0::DOUBLE) / (1.0::DOUBLE + sqrt(1.0::DOUBLE + 2.0::DOUBLE * (share * 1.5::DOUBLE - 0.0::DOUBLE) * 2.0::DOUBLE))
        ELSE 0.5::DOUBLE + 2.0::DOUBLE * (share * 1.5::DOUBLE - 0.75::DOUBLE) / (2.0::DOUBLE + sqrt(4.0::DOUBLE + 2.0::DOUBLE * (share * 1.5::DOUBLE - 0.75::DOUBLE) * -2.0::DOUBLE)) END
    ELSE 0.0::DOUBLE + 2.0::DOUBLE * (share * 2.0::DOUBLE - 0.0::DOUBLE) / (1.0::DOUBLE + sqrt(1.0::DOUBLE + 2.0::DOUBLE * (share * 2.0::DOUBLE - 0.0::DOUBLE) * 2.0::DOUBLE))
    END AS position
FROM shares
"""

#: Unsigned CRC-32 of the decimal digits and signs of a text.
CRC = """list_reduce(list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii({0}[i]) AS BIGINT)),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))), CAST(4294967295 AS BIGINT))"""

OP11 = rf"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
    SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS pos FROM turns
), ids AS (
    SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS name FROM turns
), hashed AS (
    SELECT conv_id, conv_id - conv_id % 20 AS base, xor({CRC.format("name")}, 4294967295) % 4 AS h FROM ids
), rebuilt AS (
    SELECT c.conv_id, p.pos, p.role, p.text FROM hashed c JOIN placed p ON p.conv_id = c.base AND p.pos <= c.h
    UNION ALL
    SELECT c.conv_id, p.pos - c.h + least(c.h, (SELECT count(*) FROM placed b WHERE b.conv_id = c.base)), p.role, p.text
    FROM hashed c JOIN placed p ON p.conv_id = c.conv_id AND p.pos > c.h
), prefixes AS (
    SELECT conv_id, pos AS depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
        array_agg([role, text]) OVER (PARTITION BY conv_id ORDER BY pos) AS prefix
    FROM rebuilt
    UNION ALL
    SELECT conv_id, 0, 0, CAST([] AS VARCHAR[][]) FROM ids
), members AS (
    SELECT conv_id, depth, words, min(conv_id) OVER node AS node, count(*) OVER node AS n_convs,
        depth = max(depth) OVER (PARTITION BY conv_id) AS ends
    FROM prefixes WINDOW node AS (PARTITION BY depth, prefix)
), nodes AS (
    SELECT node AS conv_id, depth, any_value(n_convs) AS n_convs, max(words) AS words,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM members GROUP BY node, depth
), linked AS (
    SELECT n.*, m.node AS parent_conv_id FROM nodes n LEFT JOIN members m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1
), counted AS (
    SELECT l.*, (SELECT count(*) FROM linked k WHERE k.parent_conv_id = l.conv_id AND k.depth = l.depth + 1) AS n_children FROM linked l
), totals AS (
    SELECT m.node, m.depth, sum(CAST(c.n_children = 0 AS INTEGER)) AS n_leaves, sum((c.n_convs - 1) * c.words) AS saved_tokens
    FROM counted c JOIN members m ON m.conv_id = c.conv_id AND m.depth <= c.depth GROUP BY m.node, m.depth
)
SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, c.parent_conv_id, CAST(c.n_convs AS BIGINT) AS n_convs, CAST(c.n_children AS BIGINT) AS n_children,
    CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN totals t ON t.node = c.conv_id AND t.depth = c.depth
"""

OP13 = rf"""
WITH RECURSIVE named AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
    FROM conversations
), hashed AS (
    SELECT *, xor({CRC.format("name")}, 4294967295) % 20 AS kind FROM named
), damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM hashed, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i,
        rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS ended, left(role, 1) AS initial
    FROM damaged
), judged AS (
    SELECT *, CASE WHEN ended = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
    FROM placed
), counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
        count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
    FROM judged GROUP BY conv_id
), inserts (p, k, mid, added) AS (
    VALUES (0, 0, 0, CAST([] AS VARCHAR[])), (0, 1, 2, ['user:']), (0, 2, 3, ['user:', 'assistant:']), (1, 0, 1, []), (1, 1, 2, ['user:']), (1, 2, 3, ['user:', 'assistant:']),
        (2, 0, 2, []), (2, 1, 3, ['assistant:']), (2, 2, 2, ['assistant:', 'user:']), (3, 0, 3, []), (3, 1, 2, ['user:']), (3, 2, 3, ['user:', 'assistant:'])
), edits (op, mid, initial, q, base, named) AS (
    VALUES ('D', 0, NULL, 0, 3, NULL), ('D', 1, NULL, 1, 3, NULL), ('D', 2, NULL, 2, 3, NULL), ('D', 3, NULL, 3, 3, NULL),
        ('K', 0, 's', 1, 0, NULL), ('K', 0, 'u', 2, 0, NULL), ('K', 1, 'u', 2, 0, NULL), ('K', 2, 'a', 3, 0, NULL), ('K', 3, 'u', 2, 0, NULL),
        ('R', 0, NULL, 2, 2, 'user'), ('R', 1, NULL, 2, 2, 'user'), ('R', 2, NULL, 3, 2, 'assistant'), ('R', 3, NULL, 2, 2, 'user')
), ends (q, tail, ending, last_lines) AS (
    VALUES (0, 0, '', CAST([] AS VARCHAR[])), (1, 4, 'II', ['user:', 'assistant:']), (2, 2, 'I', ['assistant:']), (3, 0, '', [])
), walk AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, {{'cost': 0, 'audit': '', 'lines': CAST([] AS VARCHAR[])}} AS best FROM counts
    UNION ALL
    SELECT w.conv_id, j.i, e.q, min({{
        'cost': w.best.cost + 2 * s.k + e.base + CASE WHEN j.fault = 3 AND e.op <> 'D' THEN 1 ELSE 0 END, 'audit': w.best.audit || repeat('I', s.k) || e.op,
        'lines': w.best.lines || s.added || CASE e.op WHEN 'D' THEN [] ELSE [coalesce(e.named, j.role) || ':' || j.text] END}})
    FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1
    JOIN inserts s ON s.p = w.q JOIN edits e ON e.mid = s.mid AND (e.op = 'D' OR j.fault NOT IN (1, 2)) AND (e.initial IS NULL OR e.initial = j.initial)
    GROUP BY w.conv_id, j.i, e.q
), solved AS (
    SELECT w.conv_id, min({{'cost': w.best.cost + z.tail, 'audit': w.best.audit || z.ending, 'lines': w.best.lines || z.last_lines}}) AS best
    FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN ends z ON z.q = w.q GROUP BY w.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit,
    sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
"""

SQL = {"op3_max_score": OP3, "op5_curriculum": OP5, "op11_turn_trie": OP11, "op13_turn_repair": OP13}

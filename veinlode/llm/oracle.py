"""DuckDB statements with the rows of the queries that SQL can express."""

# ASCII letters only: lower() would also change letters beyond ASCII.
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = f"""
WITH d AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
i AS (SELECT item_id, {WORDS.format("text")} AS w FROM benchmark),
iw AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, p, p + 9), ' ') AS pat
    FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM i WHERE len(w) > 0)
),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (
    SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS pat
    FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)
),
m AS (SELECT DISTINCT dw.doc_id, dw.p, iw.n, iw.item_id FROM dw JOIN iw ON iw.n = dw.n AND iw.pat = dw.pat),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit
      FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(s.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""

OP4 = r"""
WITH t AS (SELECT conv_id, list({'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS x
           FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS row_no FROM conversations) GROUP BY conv_id, row_no),
c AS (SELECT conv_id, list_transform(x, lambda v: {'role': v.role, 'text': v.text}) AS turns FROM t),
k AS (SELECT conv_id, turns, turns[1] AS first,
             row_number() OVER (PARTITION BY turns[1] ORDER BY len(turns) DESC, list_sum(list_transform(turns, lambda v: length(v.text))) DESC,
                                conv_id NULLS LAST) AS rn FROM c),
p AS (SELECT k.conv_id, b.conv_id AS chosen_id, b.turns AS a, CASE WHEN k.rn > 1 THEN k.turns END AS r
      FROM k JOIN k b ON k.first = b.first AND b.rn = 1),
n AS (SELECT *, CASE WHEN r IS NULL
                     THEN coalesce(list_max(list_filter(range(0, len(a)), lambda i: a[i + 1].role = 'assistant')), len(a) - 1)
                     ELSE list_filter(range(0, least(len(a), len(r)) + 1),
                                      lambda i: i = least(len(a), len(r)) OR a[i + 1] <> r[i + 1])[1] END AS m FROM p),
s AS (SELECT conv_id, chosen_id, m, a[1:m] AS q, a[m + 1:] AS ca, CASE WHEN r IS NOT NULL THEN r[m + 1:] END AS cr FROM n),
f AS (SELECT *, list_transform(ca, lambda v: concat('<|', v.role, '|>\n', v.text, '<|end|>\n')) AS sa,
                list_transform(cr, lambda v: concat('<|', v.role, '|>\n', v.text, '<|end|>\n')) AS sr FROM s)
SELECT conv_id, chosen_id, CAST(m AS INTEGER) AS prompt_turns,
       array_to_string(list_transform(q, lambda v: concat('<|', v.role, '|>\n', v.text, '<|end|>\n')), '') AS prompt,
       array_to_string(sa, '') AS chosen_text,
       array_to_string(list_transform(list_filter(range(1, len(ca) + 1), lambda i: ca[i].role = 'assistant'), lambda i:
           concat(length(array_to_string(sa[1:i - 1], '')) + length(ca[i].role) + 5, ':', length(array_to_string(sa[1:i], '')))), ',') AS chosen_spans,
       CASE WHEN cr IS NOT NULL THEN array_to_string(sr, '') END AS rejected_text,
       CASE WHEN cr IS NOT NULL THEN
       array_to_string(list_transform(list_filter(range(1, len(cr) + 1), lambda i: cr[i].role = 'assistant'), lambda i:
           concat(length(array_to_string(sr[1:i - 1], '')) + length(cr[i].role) + 5, ':', length(array_to_string(sr[1:i], '')))), ',') END AS rejected_spans
FROM f
""".replace("\\n", "' || chr(10) || '")

SPACED = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

OP7 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, text, {SPACED.format("text")} AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
t AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM m)),
c AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM t) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM c GROUP BY doc_id),
x AS (SELECT m.doc_id, text, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
             greatest(len(w), 1) AS n FROM m LEFT JOIN r ON r.doc_id = m.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             n_words < 50 OR n_symbols > 0.3 * n OR len(regexp_extract_all(text, '\p{{Lu}}')) > 0.4 * greatest(length(text), 1)
             OR len(regexp_extract_all(text, '\|')) > 0.2 * n OR len(regexp_extract_all(text, '[!?]{{2}}')) > 0.3 * n
             OR NOT word_chars::DOUBLE / n BETWEEN 2 AND 25 OR n_dup_lines > 0.5 * n_lines AS rejected FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM f
"""

OP8 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {SPACED.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) > 1 THEN w[i] || ' ' || w[i + 1] ELSE w[1] END AS k
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
      WHERE 100 * least(na.n, nb.n) >= 80 * greatest(na.n, nb.n)
      GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.b, d.doc_id)) AS component_id, least(d.doc_id, coalesce(c.b, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""

ORACLES: dict[str, str] = {"op4_preferences": OP4, "op5_decontaminate": OP5, "op7_rules": OP7, "op8_neardup": OP8}

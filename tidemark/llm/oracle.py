"""SQL for the registered queries of the corpus operators, where SQL can express them."""

ORACLE: dict[str, str] = {}

ORACLE["op1_quality_rules"] = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), numbered AS (
    SELECT *, row_number() OVER () AS row FROM d
), token AS (
    SELECT row, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM numbered
), window3 AS (
    SELECT row, i, w || ' ' || lead(w, 1) OVER next || ' ' || lead(w, 2) OVER next AS w3
    FROM token WINDOW next AS (PARTITION BY row ORDER BY i)
), tri AS (
    SELECT row, i, count(*) OVER (PARTITION BY row, w3) AS n FROM window3 WHERE w3 IS NOT NULL
), covered AS (
    SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n > 1) GROUP BY row
), m AS (
    SELECT doc_id, len(words) AS n_words,
           coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
           length(regexp_replace(text, '[^\p{Lu}]', '', 'g'))::BIGINT AS n_upper,
           regexp_matches(text, '\p{L}') AS has_letters,
           len(lines) AS n_lines,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
           coalesce(c.n, 0)::BIGINT AS n_repeat_words
    FROM numbered LEFT JOIN covered c USING (row)
), f AS (
    SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
             + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
             + CASE WHEN 2 * n_upper > word_chars THEN 8 ELSE 0 END
             + CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END
             + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END
             + CASE WHEN n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines THEN 64 ELSE 0 END
             + CASE WHEN NOT has_letters THEN 128 ELSE 0 END)::BIGINT AS fail_bits
    FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM f
"""
ORACLE["op2_decontaminate"] = r"""
WITH d AS (
    SELECT row_number() OVER () AS row, doc_id,
           list_filter(regexp_split_to_array(lower_ascii, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
    FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)
), b AS (
    SELECT item_id,
           list_filter(regexp_split_to_array(lower_ascii, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
    FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM benchmark)
), w AS (
    SELECT DISTINCT item_id, least(13, len(words)) AS n, array_to_string(words[i : i + least(13, len(words)) - 1], ' ') AS w
    FROM (SELECT item_id, words, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS i FROM b WHERE len(words) > 0)
), plain AS (
    SELECT row, words, ' ' || array_to_string(words, ' ') || ' ' AS plain FROM d
), held AS (
    SELECT p.row, w.item_id, w.n, w.w FROM plain p JOIN w ON contains(p.plain, ' ' || w.w || ' ')
), starts AS (
    SELECT row, words, unnest(range(1, len(words) + 1)) AS i FROM plain WHERE row IN (SELECT row FROM held)
), hits AS (
    SELECT DISTINCT h.row, s.i, h.n, h.item_id
    FROM held h JOIN starts s ON s.row = h.row AND array_to_string(s.words[s.i : s.i + h.n - 1], ' ') = h.w
), covered AS (
    SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS p FROM hits) GROUP BY row
), items AS (
    SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM hits) GROUP BY row
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN covered USING (row) LEFT JOIN items USING (row)
"""

ORACLE["op3_mix"] = r"""
WITH d AS (
    SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size
    FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS weight
    FROM d GROUP BY source
), whole AS (
    SELECT sum(source_size)::DOUBLE AS total FROM s
), by_level AS (
    SELECT *, coalesce(sum(3 * source_size) OVER before, 0)::DOUBLE AS capped, sum(weight) OVER rest AS open_weight
    FROM s
    WINDOW before AS (ORDER BY 3 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           rest AS (ORDER BY 3 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
    SELECT (total - capped) / open_weight AS level FROM by_level, whole
    WHERE 3 * source_size / weight >= (total - capped) / open_weight ORDER BY 3 * source_size / weight LIMIT 1
), t AS (
    SELECT source, source_size, least((3 * source_size)::DOUBLE, (SELECT level FROM level) * weight) AS target FROM s
), placed AS (
    SELECT d.doc_id, d.size, t.source_size, t.target,
           coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (CASE WHEN size > 0 AND 2 * before + size < 2 * target THEN 1 ELSE 0 END
              + CASE WHEN size > 0 AND 2 * (source_size + before) + size < 2 * target THEN 1 ELSE 0 END
              + CASE WHEN size > 0 AND 2 * (2 * source_size + before) + size < 2 * target THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""

ORACLE["op12_search"] = r"""
WITH term AS (
    SELECT row, doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)
), tf AS (
    SELECT row, doc_id, t, count(*) AS tf FROM term GROUP BY ALL
), corpus AS (
    SELECT count(DISTINCT row) AS n, count(*)::BIGINT AS l FROM term
), size AS (
    SELECT row, 75 + (25 * count(*) * any_value(c.n)) // any_value(c.l) AS m FROM term, corpus c GROUP BY row
), asked AS (
    SELECT item, item_id, t, count(*) AS times FROM (
        SELECT item, item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
        FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark))
    GROUP BY ALL
), weight AS (
    SELECT t, floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM tf, corpus c WHERE t IN (SELECT t FROM asked) GROUP BY t, c.n
), scored AS (
    SELECT item, item_id, tf.row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM asked JOIN weight USING (t) JOIN tf USING (t) JOIN size ON size.row = tf.row GROUP BY ALL
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""

ORACLE["op13_collocations"] = r"""
WITH piece AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents
), words AS (
    SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece
), place AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), phrase AS (
    SELECT lang, k, list_slice(w, i, i + k - 1) AS p, count(*) AS f
    FROM place, range(1, 6) AS t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL
), size AS (
    SELECT lang, sum(f)::BIGINT AS n FROM phrase WHERE k = 1 GROUP BY lang
), frequent AS (
    SELECT * FROM phrase WHERE f >= 100
), cuts AS (
    SELECT c.lang, c.p, c.k, c.f AS a, x.f AS l, y.f AS r, n, cut,
           ((1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM frequent c, range(1, 5) AS t(cut), frequent x, frequent y, size s
    WHERE c.k >= 2 AND cut < c.k AND x.lang = c.lang AND y.lang = c.lang AND s.lang = c.lang
      AND x.p = list_slice(c.p, 1, cut) AND y.p = list_slice(c.p, cut + 1, c.k)
), lowest AS (
    SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) AS place FROM cuts
), covered AS (
    SELECT lang, list_slice(p, b, b + m - 1) AS p, max(f) AS longer
    FROM frequent, range(1, 5) AS t(b), range(2, 5) AS u(m)
    WHERE m < k AND b + m - 1 <= k GROUP BY ALL
), kept AS (
    SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score
    FROM lowest LEFT JOIN covered USING (lang, p) WHERE place = 1 AND coalesce(longer < a, true)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

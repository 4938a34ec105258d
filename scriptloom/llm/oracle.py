"""SQL for DuckDB that gives the rows of the registered queries.

The others have none: models, hashes that DuckDB lacks, packing and byte windows are tested
against brute force in tests/llm.
"""

from __future__ import annotations

WORD = r"'[^\x20\x09-\x0D]+'"

OP1 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""

OP5 = f"""
WITH d AS (
    SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS nth FROM documents
), w AS (
    SELECT *, regexp_extract_all(text, {WORD}) AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {WORD})) AS lines FROM d
), runs AS (
    SELECT nth, i, array_to_string(words[i:i + 7], ' ') AS run
    FROM w, unnest(range(1, len(words) - 6)) AS t(i)
), twice AS (
    SELECT nth, i FROM runs QUALIFY count(*) OVER (PARTITION BY nth, run) > 1
), covered AS (
    SELECT nth, count(DISTINCT i + k) AS n FROM twice, range(0, 8) AS r(k) GROUP BY nth
), m AS (
    SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
    FROM w LEFT JOIN covered USING (nth)
), f AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        10 * n_symbols > n_words OR n_dup_lines >= 10 AS soft_failed FROM m
), h AS (
    SELECT source, count(*) AS n, count_if(base_failed OR soft_failed) AS bad
    FROM f WHERE source IS NOT NULL GROUP BY source
), s AS (
    SELECT avg(bad / n) AS mean, coalesce(var_samp(bad / n), 0) AS v, avg(1 / n) AS i,
        max(n) AS most FROM h
), prior AS (
    SELECT mean, CASE WHEN v > mean * (1 - mean) * i THEN
        least(most, greatest(1, mean * (1 - mean) / (v - mean * (1 - mean) * i) - 1))
        ELSE most END AS weight FROM s
), bad_hosts AS (
    SELECT source FROM h, prior WHERE (bad + mean * weight) / (n + weight) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND coalesce(source NOT IN (SELECT source FROM bad_hosts), TRUE) AS kept
FROM f"""

OP10 = f"""
WITH d AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, {WORD})), 0) AS BIGINT) AS size,
        md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffle FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source
), r AS (
    SELECT *, [1, 2, 3][(place - 1) % 3 + 1] AS weight, 3 * source_size AS cap,
        CAST(3 * source_size AS DOUBLE) / [1, 2, 3][(place - 1) % 3 + 1] AS ratio FROM s
), l AS (
    SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER ahead, 0) AS DOUBLE)
        / (sum(weight) OVER () - coalesce(sum(weight) OVER ahead, 0)) AS level FROM r
    WINDOW ahead AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
    SELECT source, place, source_size, CASE WHEN ratio <= level THEN CAST(cap AS DOUBLE)
        ELSE weight * max(level) OVER () END AS target FROM l
), q AS (
    SELECT d.*, place, source_size, target, row_number() OVER own AS nth,
        CAST(sum(size) OVER own AS BIGINT) AS upto
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
    WINDOW own AS (PARTITION BY place ORDER BY shuffle, doc_id, size ROWS UNBOUNDED PRECEDING)
), c AS (
    SELECT *, (copy * source_size + upto) / target AS finish FROM q, range(0, 3) AS n(copy)
    WHERE copy * source_size + upto - size <= target
), o AS (
    SELECT *, sum(size) OVER (ORDER BY finish, place, shuffle, doc_id, size, copy
        ROWS UNBOUNDED PRECEDING) AS reach FROM c
), k AS (
    SELECT place, nth, CAST(sum(size) AS BIGINT) AS taken FROM o
    WHERE reach <= (SELECT sum(size) FROM d) GROUP BY place, nth
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken
FROM q LEFT JOIN k USING (place, nth)"""

OP12 = r"""
WITH p AS (
    SELECT lang, unnest(list_transform(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]'), lambda x: regexp_extract_all(x, '[^\x20\x09]+'))) AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)
), g AS (
    SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, any_value(w[i:i + size - 1]) AS words,
        count(*) AS f
    FROM p, range(1, 5) AS s(size), unnest(range(1, len(w) - size + 2)) AS t(i) GROUP BY ALL
), c AS (
    SELECT * FROM g WHERE size > 1 AND f >= 30
), scored AS (
    SELECT c.*, x.f AS l, y.f AS r, k, CAST(2000000 * CAST(c.f AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score
    FROM c, unnest(range(1, size)) AS t(k)
    JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:k], ' ')
    JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[k + 1:], ' ')
    QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1
), inner_parts AS (
    SELECT lang, array_to_string(words[i:i + m - 1], ' ') AS phrase, max(f) AS longer
    FROM c, range(2, 4) AS s(m), unnest(range(1, size - m + 2)) AS t(i) WHERE m < size GROUP BY ALL
), n AS (
    SELECT lang, sum(f) AS n FROM g WHERE size = 1 GROUP BY lang
)
SELECT lang, row_number() OVER best AS rank, phrase, f AS a, l, r, CAST(n AS BIGINT) AS n, score
FROM scored LEFT JOIN inner_parts USING (lang, phrase) JOIN n USING (lang)
WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(f AS HUGEINT)
WINDOW best AS (PARTITION BY lang ORDER BY score DESC, f DESC, phrase)
QUALIFY row_number() OVER best <= 2000"""

OP13 = """
WITH v AS (
    SELECT row_number() OVER () AS nth, vec_id,
        CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), FALSE))) = len(embedding)
), s AS (
    SELECT a.nth AS anchor, a.vec_id AS anchor_id, b.nth, b.vec_id, a.label = b.label AS same,
        CAST(coalesce(list_sum(list_transform(range(1, least(len(a.q), len(b.q)) + 1),
            lambda i: a.q[i] * b.q[i])), 0) AS BIGINT) AS score
    FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.nth <> b.nth
), p AS (
    SELECT * FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, nth) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER found AS INTEGER) AS rank,
    s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same
    AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
WINDOW found AS (PARTITION BY p.anchor, p.nth ORDER BY s.score DESC, s.vec_id NULLS LAST, s.nth)
QUALIFY row_number() OVER found <= 5"""

ORACLE: dict[str, str] = {
    "op1_exact_dedup": OP1,
    "op5_host_rules": OP5,
    "op10_fair_mix": OP10,
    "op12_collocations": OP12,
    "op13_hard_negatives": OP13,
}

"""The registered queries as SQL for DuckDB, over the same whole tables.

The SQL takes other ways than the Spark code: lines and parts are unnested into rows,
state runs through windows or a recursive query, and text is put together again by
ordered aggregation.
"""

from __future__ import annotations

from catalog.inputs import CODE_EXPRESSION, DUCKDB_SCRIPT, MOST_CHUNKS
from scriptloom.functions import fixed_values as fixed

NL = "chr(10)"
WS = fixed.WS
ORACLE: dict[str, str] = {}

SCRIPTS = f"src AS (SELECT CAST(c_custkey AS VARCHAR) AS script_id, {DUCKDB_SCRIPT} AS source FROM customer)"
DOCS = "src AS (SELECT CAST(doc_id AS VARCHAR) AS script_id, text AS source FROM documents)"
PAGES = "src AS (SELECT CAST(page_id AS VARCHAR) AS script_id, html AS source FROM pages)"
CODE = f"""code AS (SELECT CAST(o_custkey AS VARCHAR) AS script_id, o_orderkey AS chunk_no,
    {CODE_EXPRESSION} AS code FROM orders)"""
CONVERSIONS = f"""conv AS (SELECT CAST(c_custkey AS VARCHAR) AS script_id, chunk_no,
    'from pyspark.sql import SparkSession' || {NL} || 'df.filter(''' || c_mktsegment || ''')' AS converted
    FROM customer, range(1, {MOST_CHUNKS + 1}) n(chunk_no) WHERE (c_custkey + chunk_no) % 7 <> 0)"""


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def rstrip(x: str) -> str:
    return f"regexp_replace({x}, '[{WS}]+$', '')"


def unix(x: str) -> str:
    return rf"regexp_replace({x}, '\r\n?', {NL}, 'g')"


def no_comments(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '(?s)/\*.*?\*/', '', 'g'), '--[^\n]*', '', 'g')"


def lines_of(x: str) -> str:
    """List of lines at any line boundary, without the empty one a final boundary opens."""
    marked = rf"regexp_replace({x}, '{fixed.LINE_BOUNDARY}', {NL}, 'g')"
    return (
        f"CASE WHEN {marked} = '' THEN [] WHEN ends_with({marked}, {NL})"
        f" THEN string_split({marked}, {NL})[:-2] ELSE string_split({marked}, {NL}) END"
    )


def int_(x: str) -> str:
    return f"CAST({x} AS INTEGER)"


def n_lines(x: str) -> str:
    return int_(f"len(string_split({x}, {NL}))")


def number(order: str, by: str = "script_id") -> str:
    return int_(f"row_number() OVER (PARTITION BY {by} ORDER BY {order})")


def unnested(name: str, source: str, items: str, item: str, keys: str = "script_id") -> str:
    """CTE with one row per list element: keys, pos, item."""
    return f"""{name} AS (SELECT {keys}, generate_subscripts(ls, 1) AS pos, unnest(ls) AS {item}
        FROM (SELECT {keys}, {items} AS ls FROM {source}))"""


# --- splitters as CTEs: each reads a CTE (script_id, source), yields (script_id, pos, code) -


def delimiter_blocks(source: str, out: str) -> str:
    hit = f"({strip('line')} = '/')"
    return f"""
    {unnested(out + '_l', source, f"string_split({unix('source')}, {NL})", 'line')},
    {out}_f AS (SELECT *, {hit} AS hit, sum({hit}::INT) OVER (
        PARTITION BY script_id ORDER BY pos) AS g FROM {out}_l),
    {out}_b AS (SELECT script_id, g, {strip(f'string_agg(line, {NL} ORDER BY pos)')} AS code
        FROM {out}_f WHERE NOT hit GROUP BY script_id, g),
    {out} AS (SELECT script_id, {number('g')} AS pos, code FROM {out}_b WHERE code <> '')"""


def line_chunks(source: str, out: str, n: int) -> str:
    return f"""
    {unnested(out + '_l', source, f"string_split(source, {NL})", 'line')},
    {out} AS (SELECT script_id, {int_(f'(pos - 1) // {n} + 1')} AS pos,
        string_agg(line, {NL} ORDER BY pos) AS code
        FROM {out}_l GROUP BY script_id, (pos - 1) // {n})"""


def pattern_blocks(source: str, out: str, skip: bool, keep: bool) -> str:
    lead = f"[{WS}]*" if skip else ""
    pattern = (
        rf"(?i){lead}(?:CREATE[{WS}]+(?:OR[{WS}]+REPLACE[{WS}]+)?(?:FUNCTION|PROCEDURE|PACKAGE|TRIGGER)"
        rf"|DECLARE|BEGIN)[\s\S]*?END[{WS}]*;|[^;]+;|[^;]+\z"
    )
    terminated = "" if keep else "AND ends_with(code, ';')"
    return f"""
    {unnested(out + '_m', source, f"regexp_extract_all({unix('source')}, '{pattern}')", 'raw')},
    {out}_s AS (SELECT script_id, pos, {strip('raw')} AS code FROM {out}_m),
    {out} AS (SELECT script_id, {number('pos')} AS pos, code FROM {out}_s
        WHERE code NOT IN ('', '/') {terminated})"""


OPENS = f"regexp_matches(code, '^(?i)(?:{'|'.join(fixed.BLOCK_OPENERS)})')"


def begin_pieces(source: str, out: str, keys: str, cap: int) -> str:
    """(keys, code) to (keys, pos, code), cut before BEGIN where longer than cap."""
    cuts = (
        f"CASE WHEN length({strip('code')}) > {cap} THEN string_split("
        f"regexp_replace(code, '((?i)BEGIN)', chr(1) || '\\1', 'g'), chr(1)) ELSE [code] END"
    )
    return f"""
    {unnested(out + '_c', source, cuts, 'cut', keys)},
    {out} AS (SELECT {keys}, pos, {strip('cut')} AS code FROM {out}_c WHERE {strip('cut')} <> '')"""


def size_chunks(source: str, out: str, keys: str, cap: int) -> str:
    """(keys, code) to (keys, grp, code): semicolon parts in runs that just exceed cap."""
    same = " AND ".join(f"q.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    mine = ", ".join(f"q.{k.strip()}" for k in keys.split(","))
    return f"""
    {unnested(out + '_p', f"(SELECT * FROM {source} WHERE length(code) > {cap})", "string_split(code, ';')", 'part', keys)},
    {out}_q AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY pos) AS pos,
        part, length(part) + 1 AS len FROM {out}_p WHERE {strip('part')} <> ''),
    {out}_r AS (
        SELECT {keys}, pos, len AS total, 1 AS grp FROM {out}_q WHERE pos = 1
        UNION ALL
        SELECT {mine}, q.pos, CASE WHEN r.total > {cap} THEN q.len ELSE r.total + q.len END,
            CASE WHEN r.total > {cap} THEN r.grp + 1 ELSE r.grp END
        FROM {out}_r r JOIN {out}_q q ON {same} AND q.pos = r.pos + 1),
    {out} AS (
        SELECT {keys}, grp, {strip(f"string_agg(part || ';', {NL} ORDER BY pos)")} AS code
        FROM {out}_q JOIN {out}_r USING ({keys}, pos) GROUP BY {keys}, grp
        UNION ALL
        SELECT {keys}, 1, code FROM {source} WHERE length(code) <= {cap})"""


def batches(source: str, out: str, small: int = 180, cap: int = 300) -> str:
    """(script_id, pos, code) to (script_id, pos, code): small neighbours joined."""
    return f"""
    {out}_q AS (SELECT script_id, {number('pos')} AS pos, code, length(code) AS len
        FROM {source} WHERE {strip('code')} <> ''),
    {out}_r AS (
        SELECT script_id, pos, len AS held, len >= {small} AS alone, 1 AS grp
        FROM {out}_q WHERE pos = 1
        UNION ALL
        SELECT q.script_id, q.pos,
            CASE WHEN r.alone OR q.len >= {small} OR r.held > {cap} THEN q.len ELSE r.held + q.len END,
            q.len >= {small},
            CASE WHEN r.alone OR q.len >= {small} OR r.held > {cap} THEN r.grp + 1 ELSE r.grp END
        FROM {out}_r r JOIN {out}_q q ON q.script_id = r.script_id AND q.pos = r.pos + 1),
    {out} AS (SELECT script_id, {int_('grp')} AS pos, string_agg(code, {NL} ORDER BY pos) AS code
        FROM {out}_q JOIN {out}_r USING (script_id, pos) GROUP BY script_id, grp)"""


def comment_only(x: str) -> str:
    line = strip("l")
    return (
        f"(len(list_filter(string_split({x}, {NL}),"
        f" lambda l: {line} <> '' AND NOT starts_with({line}, '--'))) = 0)"
    )


def cascade(source: str, out: str, skip: bool = True, keep: bool = True) -> str:
    """(script_id, pos, strategy, code)."""
    return f"""
    {delimiter_blocks(source, 'd')},
    d_ids AS (SELECT script_id FROM d GROUP BY script_id HAVING count(*) > 1),
    no_d AS (SELECT * FROM {source} WHERE script_id NOT IN (SELECT script_id FROM d_ids)),
    {pattern_blocks('no_d', 'p', skip, keep)},
    p_ids AS (SELECT script_id FROM p GROUP BY script_id HAVING count(*) > 1),
    b AS (SELECT script_id, pos AS b_no, code, (length(code) > 1200 OR {OPENS}) AS refine
        FROM p WHERE script_id IN (SELECT script_id FROM p_ids)),
    b_refine AS (SELECT script_id, b_no, code FROM b WHERE refine),
    {begin_pieces('b_refine', 'cut', 'script_id, b_no', 1200)},
    cut_n AS (SELECT script_id, b_no, pos AS c_no, code FROM cut),
    {size_chunks('cut_n', 'sized', 'script_id, b_no, c_no', 1200)},
    fine AS (
        SELECT script_id, b_no, c_no, grp, code FROM sized
        WHERE {strip('code')} <> '' AND NOT {comment_only('code')}
        UNION ALL SELECT script_id, b_no, 0, 0, code FROM b WHERE NOT refine),
    fine_n AS (SELECT script_id, {number('b_no, c_no, grp')} AS pos, code FROM fine),
    {batches('fine_n', 'batched')},
    rest AS (SELECT * FROM no_d WHERE script_id NOT IN (SELECT script_id FROM p_ids)),
    {line_chunks('rest', 'counted', 100)},
    {out} AS (
        SELECT script_id, pos, 'delimiter' AS strategy, code FROM d
        WHERE script_id IN (SELECT script_id FROM d_ids)
        UNION ALL SELECT script_id, pos, 'pattern', code FROM batched
        UNION ALL SELECT script_id, pos, 'lines', code FROM counted)"""


def line_depths(source: str, out: str, items: str, keys: str = "script_id") -> str:
    """(keys, pos, line, depth): running sum less its running minimum below zero."""
    delta = "(contains(upper(line), 'BEGIN')::INT - contains(upper(line), 'END')::INT)"
    w = f"OVER (PARTITION BY {keys} ORDER BY pos)"
    return f"""
    {unnested(out + '_l', source, items, 'line', keys)},
    {out}_s AS (SELECT *, sum({delta}) {w} AS s FROM {out}_l),
    {out} AS (SELECT {keys}, pos, line, {int_(f's - least(0, min(s) {w})')} AS depth FROM {out}_s)"""


def top_level(source: str, out: str) -> str:
    closes = f"(depth = 0 AND {strip('line')} = '/')::INT"
    return f"""
    {line_depths(source, out + '_d', lines_of('source'))},
    {out}_g AS (SELECT *, coalesce(sum({closes}) OVER (PARTITION BY script_id ORDER BY pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM {out}_d),
    {out} AS (SELECT script_id, {number('g')} AS pos, {rstrip(f'string_agg(line, {NL} ORDER BY pos)')} AS code
        FROM {out}_g GROUP BY script_id, g)"""


def safe_chunks(source: str, out: str, keys: str, n: int) -> str:
    """(keys, code) to (keys, grp, code)."""
    same = " AND ".join(f"q.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    mine = ", ".join(f"q.{k.strip()}" for k in keys.split(","))
    big = f"(SELECT * FROM {source} WHERE {n_lines('code')} > {n})"
    return f"""
    {line_depths(big, out + '_d', f"string_split(code, {NL})", keys)},
    {out}_q AS (SELECT *, depth = 0 AND regexp_matches({rstrip('line')}, '[;/]$') AS safe FROM {out}_d),
    {out}_r AS (
        SELECT {keys}, pos, 1 AS held, safe AND 1 >= {n} AS cut, 1 AS grp FROM {out}_q WHERE pos = 1
        UNION ALL
        SELECT {mine}, q.pos, CASE WHEN r.cut THEN 1 ELSE r.held + 1 END,
            q.safe AND CASE WHEN r.cut THEN 1 ELSE r.held + 1 END >= {n},
            CASE WHEN r.cut THEN r.grp + 1 ELSE r.grp END
        FROM {out}_r r JOIN {out}_q q ON {same} AND q.pos = r.pos + 1),
    {out} AS (
        SELECT {keys}, grp, string_agg(line, {NL} ORDER BY pos) AS code
        FROM {out}_q JOIN {out}_r USING ({keys}, pos) GROUP BY {keys}, grp
        UNION ALL SELECT {keys}, 1, code FROM {source} WHERE {n_lines('code')} <= {n})"""


def block_type(x: str) -> str:
    ws = f"[{WS}]+"
    header = (
        rf"regexp_extract({x}, '(?i)\bCREATE{ws}(?:OR{ws}REPLACE{ws})?"
        rf"(PROCEDURE|FUNCTION|PACKAGE{ws}BODY|PACKAGE|TRIGGER)\b', 1)"
    )
    return (
        f"CASE WHEN {header} <> '' THEN regexp_replace(upper({header}), '{ws}', '_', 'g')"
        f" WHEN starts_with(upper(regexp_replace({x}, '^[{WS}]+', '')), 'BEGIN')"
        f" THEN 'ANONYMOUS_BLOCK' ELSE 'UNKNOWN' END"
    )


# --- static checks -------------------------------------------------------------------


def rule_conditions(x: str) -> dict[str, tuple[str, bool, str]]:
    def has(word: str) -> str:
        return f"contains({x}, '{word}')"

    def count(char: str) -> str:
        return f"len(regexp_extract_all({x}, '[{char}]'))"

    return {
        "no_session": (
            f"(NOT {has('spark.read')} AND NOT {has('SparkSession')})", True, fixed.MSG_NO_SESSION
        ),
        "no_dataframe_api": (
            f"NOT regexp_matches({x}, '[.](select|withColumn|filter|groupBy)')",
            True,
            fixed.MSG_NO_DATAFRAME,
        ),
        "legacy_api": (f"({has('SQLContext')} OR {has('.rdd')})", False, fixed.MSG_LEGACY),
        "paren_mismatch": (f"({count('(')} <> {count(')')})", True, fixed.MSG_PARENS),
        "no_import": (
            rf"NOT regexp_matches({x}, 'import[{WS}]+spark|from[{WS}]+pyspark')",
            True,
            fixed.MSG_NO_IMPORT,
        ),
    }


def valid(x: str) -> str:
    fails = [cond for cond, fatal, _ in rule_conditions(x).values() if fatal]
    return f"CAST(NOT ({' OR '.join(fails)}) AS INTEGER)"


def comment_list(x: str) -> str:
    hits = ", ".join(
        f"CASE WHEN {cond} THEN '{msg}' END" for cond, _, msg in rule_conditions(x).values()
    )
    kept = f"list_filter([{hits}], lambda m: m IS NOT NULL)"
    return f"CASE WHEN len({kept}) = 0 THEN ['{fixed.MSG_PASSED}'] ELSE {kept} END"


def annotated(x: str) -> str:
    return f"array_to_string({comment_list(x)}, {NL}) || {NL} || {x}"


# --- the queries ---------------------------------------------------------------------

WITH = "WITH RECURSIVE "
CHUNK = "script_id, CAST(pos AS INTEGER) AS chunk_no, code"

ORACLE["read_script_files"] = f"""{WITH}{SCRIPTS} SELECT script_id, source || {NL} AS source,
    sha256(source || {NL}) AS content_hash FROM src"""
ORACLE["scripts_from_column"] = f"{WITH}{DOCS} SELECT *, sha256(source) AS content_hash FROM src"
TURNS = f"""turns AS (SELECT CAST(u.conv_id AS VARCHAR) AS script_id, u.turn AS chunk_no,
    u.text AS original, a.text AS converted FROM conversations u LEFT JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"""
ORACLE["mapping_csv"] = f"{WITH}{TURNS} SELECT *, {annotated('converted')} AS annotated FROM turns"
ORACLE["mapping_csv_indexed"] = ORACLE["mapping_csv"]
ORACLE["write_script_files"] = f"{WITH}{DOCS} SELECT script_id, source AS code FROM src"

ORACLE["normalize_newlines"] = f"{WITH}{SCRIPTS} SELECT script_id, {unix('source')} AS source FROM src"
ORACLE["strip_comments"] = f"{WITH}{SCRIPTS} SELECT script_id, {no_comments('source')} AS source FROM src"
ORACLE["strip_comments_pages"] = (
    f"{WITH}{PAGES} SELECT script_id, {no_comments('source')} AS source FROM src"
)
ORACLE["drop_blank"] = f"""{WITH}{DOCS}, {line_chunks('src', 'c', 1)}
    SELECT script_id, pos AS chunk_no, {strip('code')} AS code FROM c WHERE {strip('code')} <> ''"""
ORACLE["drop_comment_only"] = f"""{WITH}{SCRIPTS}, {line_chunks('src', 'c', 2)}
    SELECT {CHUNK} FROM c WHERE NOT {comment_only('code')}"""

ORACLE["split_delimiter"] = f"{WITH}{SCRIPTS}, {delimiter_blocks('src', 'o')} SELECT {CHUNK} FROM o"
ORACLE["split_lines"] = f"{WITH}{DOCS}, {line_chunks('src', 'o', 100)} SELECT {CHUNK} FROM o"
TERMINATED = f"{CHUNK}, ends_with(code, ';') AS is_terminated"
ORACLE["split_pattern"] = (
    f"{WITH}{SCRIPTS}, {pattern_blocks('src', 'o', True, True)} SELECT {TERMINATED} FROM o"
)
ORACLE["split_pattern_literal"] = (
    f"{WITH}{SCRIPTS}, {pattern_blocks('src', 'o', False, False)} SELECT {TERMINATED} FROM o"
)
ORACLE["split_pattern_pages"] = (
    f"{WITH}{PAGES}, {pattern_blocks('src', 'o', True, True)} SELECT {TERMINATED} FROM o"
)


def statements(out: str) -> str:
    return f"""st_src AS (SELECT script_id, {strip('source')} AS code FROM src),
    st_open AS (SELECT *, {OPENS} AS whole FROM st_src),
    {unnested('st_p', '(SELECT * FROM st_open WHERE NOT whole)', "string_split(code, ';')", 'part')},
    st_t AS (SELECT *, pos < max(pos) OVER (PARTITION BY script_id) AS ended FROM st_p),
    {out} AS (SELECT script_id, {number('pos')} AS pos,
        {strip("part || CASE WHEN ended THEN ';' ELSE '' END")} AS code
        FROM st_t WHERE {strip('part')} <> ''
        UNION ALL SELECT script_id, 1, code FROM st_open WHERE whole AND code <> '')"""


ORACLE["split_statements"] = f"{WITH}{PAGES}, {statements('o')} SELECT {CHUNK} FROM o"
ORACLE["split_statements_scripts"] = f"{WITH}{SCRIPTS}, {statements('o')} SELECT {CHUNK} FROM o"
ORACLE["split_before_begin"] = f"""{WITH}{SCRIPTS}, s AS (SELECT script_id, source AS code FROM src),
    {begin_pieces('s', 'o', 'script_id', 1200)}
    SELECT script_id, {number('pos')} AS chunk_no, code FROM o"""
ORACLE["rechunk_by_size"] = f"""{WITH}{PAGES}, s AS (SELECT script_id, source AS code FROM src),
    {size_chunks('s', 'o', 'script_id', 1200)} SELECT script_id, {int_('grp')} AS chunk_no, code FROM o"""
ORACLE["split_top_level"] = f"{WITH}{SCRIPTS}, {top_level('src', 'o')} SELECT {CHUNK} FROM o"
ORACLE["split_safe"] = f"""{WITH}{SCRIPTS}, s AS (SELECT script_id, source AS code FROM src),
    {safe_chunks('s', 'o', 'script_id', 25)}
    SELECT script_id, {int_('grp')} AS chunk_no, code, {n_lines('code')} > 25 AS oversized FROM o"""
ORACLE["batch_small_lines"] = (
    f"{WITH}{DOCS}, {line_chunks('src', 'l', 1)}, {batches('l', 'o')} SELECT {CHUNK} FROM o"
)
ORACLE["batch_small_statements"] = (
    f"{WITH}{PAGES}, {statements('l')}, {batches('l', 'o')} SELECT {CHUNK} FROM o"
)
TAGGED = "script_id, CAST(pos AS INTEGER) AS chunk_no, strategy, code"
ORACLE["chunk_scripts"] = f"{WITH}{SCRIPTS}, {cascade('src', 'o')} SELECT {TAGGED} FROM o"
ORACLE["chunk_scripts_literal"] = (
    f"{WITH}{SCRIPTS}, {cascade('src', 'o', False, False)} SELECT {TAGGED} FROM o"
)
ORACLE["chunk_pages"] = f"{WITH}{PAGES}, {cascade('src', 'o')} SELECT {TAGGED} FROM o"
ORACLE["chunk_documents"] = f"{WITH}{DOCS}, {cascade('src', 'o')} SELECT {TAGGED} FROM o"


def structured(n: int) -> str:
    return f"""{WITH}{SCRIPTS},
    clean AS (SELECT script_id, {no_comments('source')} AS source FROM src),
    {top_level('clean', 't')}, tb AS (SELECT script_id, pos AS b_no, code FROM t),
    {safe_chunks('tb', 's', 'script_id, b_no', n)},
    o AS (SELECT script_id, {number('b_no, grp')} AS chunk_no, code FROM s)
    SELECT script_id, chunk_no, printf('blk_%03d', chunk_no) AS chunk_id,
        {block_type('code')} AS block_type, {n_lines('code')} AS line_count,
        {int_('length(code)')} AS n_chars, {n_lines('code')} > {n} AS oversized, code FROM o"""


ORACLE["structured_chunks"] = structured(400)
ORACLE["structured_chunks_short"] = structured(20)

ORACLE["with_chunk_id"] = f"""{WITH}{DOCS}, {line_chunks('src', 'c', 1)},
    k AS (SELECT script_id, pos AS chunk_no, row_number() OVER (PARTITION BY script_id ORDER BY pos) AS serial
        FROM c WHERE {strip('code')} <> '')
    SELECT *, printf('blk_%03d', serial) AS chunk_id FROM k"""
ORACLE["with_chunk_id_per_source"] = """WITH k AS (SELECT source, lang, doc_id,
    row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS serial FROM documents)
    SELECT *, printf('blk_%03d', serial) AS chunk_id FROM k"""
ORACLE["with_block_type"] = f"""{WITH}{SCRIPTS}, {delimiter_blocks('src', 'o')}
    SELECT script_id, pos AS chunk_no, {block_type('code')} AS block_type FROM o"""
ORACLE["with_counts"] = f"""{WITH}{DOCS}, {line_chunks('src', 'o', 9)}
    SELECT script_id, pos AS chunk_no, {n_lines('code')} AS line_count, {int_('length(code)')} AS n_chars FROM o"""
ORACLE["line_depth"] = f"""{WITH}{SCRIPTS}, {line_depths('src', 'o', lines_of('source'))}
    SELECT script_id, {int_('pos')} AS line_no, line, depth FROM o"""
ORACLE["with_progress"] = f"""{WITH}{DOCS}, {line_chunks('src', 'c', 5)},
    k AS (SELECT script_id, pos AS chunk_no,
        row_number() OVER (PARTITION BY script_id ORDER BY pos) AS position,
        count(*) OVER (PARTITION BY script_id) AS n_chunks FROM c)
    SELECT *, CAST(position AS DOUBLE) / n_chunks AS fraction FROM k"""

ORACLE["with_progress_anew"] = f"""{WITH}{DOCS}, {line_chunks('src', 'c', 5)},
    k AS (SELECT script_id, pos AS chunk_no,
        row_number() OVER (PARTITION BY script_id ORDER BY pos) AS position,
        count(*) OVER (PARTITION BY script_id) AS n_chunks FROM c WHERE pos % 3 <> 1)
    SELECT *, CAST(position AS DOUBLE) / n_chunks AS fraction FROM k"""

for _rule, (_cond, _, _) in rule_conditions("code").items():
    ORACLE[f"lint_{_rule}"] = (
        f"WITH {CODE} SELECT script_id, chunk_no, {int_(_cond)} AS broken FROM code"
    )
ORACLE["lint_verdict"] = f"""WITH {CODE}, c AS (SELECT script_id, chunk_no, {valid('code')} AS is_valid,
    {comment_list('code')} AS comments FROM code)
    SELECT script_id, chunk_no, is_valid, {int_('len(comments)')} AS n_comments,
    array_to_string(comments, '|') AS comments FROM c"""
ORACLE["lint_annotate"] = (
    f"WITH {CODE} SELECT script_id, chunk_no, {annotated('code')} AS annotated FROM code"
)


def found(source: str, columns: str, x: str, with_message: bool) -> str:
    def row(rule: str, cond: str, fatal: bool, msg: str) -> str:
        message = f", {int(fatal)} AS invalidates, '{msg}' AS message" if with_message else ""
        return f"SELECT {columns}, '{rule}' AS rule{message} FROM {source} WHERE {cond}"

    return " UNION ALL ".join(row(rule, *rest) for rule, rest in rule_conditions(x).items())


ORACLE["lint_findings"] = f"WITH {CODE} {found('code', 'script_id, chunk_no', 'code', True)}"
ORACLE["lint_findings_pages"] = f"WITH {PAGES} {found('src', 'script_id', 'source', False)}"
_failed = "(starts_with(code, '# Gemini Error: ') OR starts_with(code, '# OpenAI Error: '))"
ORACLE["conversion_errors"] = f"""WITH {CODE} SELECT script_id, chunk_no,
    CASE WHEN {_failed} THEN 'error' ELSE 'ok' END AS status,
    CASE WHEN {_failed} THEN substr(code, 17) END AS error FROM code"""

ORACLE["map_chunks"] = f"""{WITH}{TURNS} SELECT script_id, chunk_no, original, converted,
    CASE WHEN converted IS NOT NULL THEN {valid('converted')} END AS is_valid,
    CASE WHEN converted IS NOT NULL THEN array_to_string({comment_list('converted')}, '|') END AS comments,
    {annotated('converted')} AS annotated FROM turns"""
MAPPED = f"""{SCRIPTS}, {CONVERSIONS}, {cascade('src', 'o')},
    mapped AS (SELECT o.script_id, CAST(pos AS BIGINT) AS serial, {block_type('code')} AS block_type,
        {n_lines('code')} AS line_count, code AS original, converted
        FROM o LEFT JOIN conv ON conv.script_id = o.script_id AND conv.chunk_no = o.pos)"""
ORACLE["audit_table"] = f"""{WITH}{MAPPED} SELECT script_id, serial AS "Sr No",
    printf('blk_%03d', serial) AS "Chunk ID", block_type AS "Block Type",
    line_count AS "Line Count", original AS "Original",
    {annotated('converted')} AS "Converted" FROM mapped"""
ORACLE["audit_summary"] = f"""{WITH}{MAPPED} SELECT script_id, block_type,
    {int_('grouping(script_id, block_type)')} AS level, count(*) AS n_chunks,
    CAST(sum(CASE WHEN converted IS NOT NULL THEN {valid('converted')} ELSE 0 END) AS BIGINT) AS n_valid,
    CAST(sum(line_count) AS BIGINT) AS n_lines
    FROM mapped GROUP BY ROLLUP (script_id, block_type)"""
ORACLE["rule_summary"] = f"""WITH {CODE}, f AS ({found('code', 'script_id, chunk_no', 'code', False)})
    SELECT rule, count(*) AS n_findings, count(DISTINCT (script_id, chunk_no)) AS n_chunks
    FROM f GROUP BY rule"""
ORACLE["dedup_chunks"] = f"""{WITH}{DOCS}, {line_chunks('src', 'c', 1)},
    k AS (SELECT {CHUNK}, sha256(code) AS content_hash,
        row_number() OVER (PARTITION BY code ORDER BY script_id, pos) AS nth,
        count(*) OVER (PARTITION BY code) AS n_copies FROM c)
    SELECT script_id, chunk_no, code, content_hash, n_copies FROM k WHERE nth = 1"""
ORACLE["dedup_null_code"] = f"""{WITH}{DOCS}, {line_chunks('src', 'c', 1)},
    k AS (SELECT {CHUNK}, sha256(code) AS content_hash,
        row_number() OVER (PARTITION BY code ORDER BY script_id, pos) AS nth,
        count(*) OVER (PARTITION BY code) AS n_copies FROM c WHERE CAST(script_id AS BIGINT) % 5 <> 0)
    SELECT script_id, chunk_no, code, content_hash, n_copies FROM k WHERE nth = 1 UNION ALL
    SELECT script_id, CAST(pos AS INTEGER), NULL, NULL, 1 FROM c WHERE CAST(script_id AS BIGINT) % 5 = 0"""
ORACLE["label_copies"] = f"""{WITH}{DOCS}, {line_chunks('src', 'c', 1)},
    k AS (SELECT {CHUNK}, sha256(code) AS content_hash,
        row_number() OVER w AS nth, first_value(script_id) OVER w AS first_script_id,
        first_value(CAST(pos AS INTEGER)) OVER w AS first_chunk_no,
        count(*) OVER (PARTITION BY code) AS n_copies
        FROM c WINDOW w AS (PARTITION BY code ORDER BY script_id, pos))
    SELECT script_id, chunk_no, content_hash, first_script_id, first_chunk_no, n_copies
    FROM k WHERE nth > 1"""
ORACLE["dedup_documents"] = f"""{WITH}{DOCS} SELECT min(script_id) AS script_id, source,
    sha256(source) AS content_hash, count(*) AS n_copies FROM src WHERE source IS NOT NULL GROUP BY source
    UNION ALL SELECT script_id, NULL, NULL, 1 FROM src WHERE source IS NULL"""
ORACLE["label_document_copies"] = f"""{WITH}{DOCS},
    k AS (SELECT script_id, sha256(source) AS content_hash, min(script_id) OVER w AS first_script_id,
        count(*) OVER w AS n_copies FROM src WHERE source IS NOT NULL WINDOW w AS (PARTITION BY source))
    SELECT * FROM k WHERE script_id <> first_script_id"""
ORACLE["assemble"] = f"{WITH}{DOCS} SELECT script_id, source AS code FROM src"
ORACLE["final_scripts"] = f"""WITH {CODE}, w AS (SELECT script_id,
    string_agg(code, {NL} ORDER BY chunk_no) AS whole FROM code GROUP BY script_id)
    SELECT script_id, {valid('whole')} AS is_valid, {annotated('whole')} AS annotated FROM w"""
ORACLE["final_scripts_missing"] = f"""WITH {CODE}, w AS (SELECT script_id,
    string_agg(code, {NL} ORDER BY chunk_no) FILTER (chunk_no % 9 <> 0) AS whole,
    CAST(count(*) FILTER (chunk_no % 9 = 0) AS BIGINT) AS n_missing FROM code GROUP BY script_id)
    SELECT script_id, CASE WHEN n_missing > 0 THEN 0 ELSE {valid('whole')} END AS is_valid, n_missing FROM w"""
SEEN = "seen AS (SELECT text FROM documents WHERE lang = 'fr')"
ORACLE["only_new"] = f"""WITH {SEEN} SELECT CAST(doc_id AS VARCHAR) AS script_id,
    sha256(text) AS content_hash FROM documents WHERE text NOT IN (SELECT text FROM seen)"""
ORACLE["only_new_first"] = f"""WITH {SEEN} SELECT min(CAST(doc_id AS VARCHAR)) AS script_id,
    sha256(text) AS content_hash FROM documents WHERE text NOT IN (SELECT text FROM seen) GROUP BY text"""
ORACLE["extend_seen"] = "SELECT DISTINCT sha256(text) AS content_hash FROM documents"
ORACLE["stream_chunks"] = f"""{WITH}
    src AS (SELECT DISTINCT sha256(text) AS script_id, {no_comments('text')} AS source FROM documents),
    {top_level('src', 't')}, tb AS (SELECT script_id, pos AS b_no, code FROM t),
    {safe_chunks('tb', 's', 'script_id, b_no', 400)},
    o AS (SELECT script_id AS content_hash, {number('b_no, grp')} AS chunk_no, code FROM s)
    SELECT content_hash, chunk_no, printf('blk_%03d', chunk_no) AS chunk_id,
        {block_type('code')} AS block_type, {n_lines('code')} AS line_count,
        {int_('length(code)')} AS n_chars, {n_lines('code')} > 400 AS oversized, code FROM o"""
ORACLE["stream_script_files"] = f"""{WITH}{SCRIPTS.replace("src AS", "raw AS", 1)},
    src AS (SELECT DISTINCT sha256(source || {NL}) AS script_id,
        {no_comments(f"(source || {NL})")} AS source FROM raw),
    {top_level('src', 't')}, tb AS (SELECT script_id, pos AS b_no, code FROM t),
    {safe_chunks('tb', 's', 'script_id, b_no', 400)},
    o AS (SELECT script_id AS content_hash, {number('b_no, grp')} AS chunk_no, code FROM s)
    SELECT content_hash, chunk_no, printf('blk_%03d', chunk_no) AS chunk_id,
        {block_type('code')} AS block_type, {n_lines('code')} AS line_count,
        {int_('length(code)')} AS n_chars, {n_lines('code')} > 400 AS oversized, code FROM o"""
ORACLE["line_totals"] = f"""{WITH}{DOCS}, {line_chunks('src', 'o', 100)}
    SELECT {n_lines('code')} AS line_count, count(*) AS n_chunks,
    CAST(sum(length(code)) AS BIGINT) AS n_chars FROM o GROUP BY 1"""

ORACLE["count_where"] = "SELECT count(*) AS n FROM customer WHERE c_nationkey = 10"
ORACLE["update_if"] = """SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey = 10
    AND (SELECT count(*) FROM customer WHERE c_nationkey = 10) > 0
    THEN c_acctbal * CAST(1.1 AS DOUBLE) ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer"""
ORACLE["update_if_unmet"] = """SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey = 10
    AND (SELECT count(*) FROM orders WHERE o_totalprice < 0) > 0
    THEN c_acctbal * CAST(1.1 AS DOUBLE) ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer"""
_poor = "(CASE WHEN c_nationkey > 5 THEN c_acctbal < 0 END)"
ORACLE["update_where"] = f"""SELECT c_custkey, c_name,
    CASE WHEN {_poor} THEN 2000 ELSE c_nationkey END AS c_nationkey, c_acctbal,
    CASE WHEN {_poor} THEN c_mktsegment || '-' || c_nationkey ELSE c_mktsegment END AS c_mktsegment
    FROM customer"""
ORACLE["lookup_one"] = """SELECT c_custkey, c_nationkey, n_name,
    CASE WHEN n_name IS NULL THEN 'NO_DATA_FOUND' ELSE 'OK' END AS status
    FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey"""
ORACLE["lookup_many"] = """SELECT c_custkey, c_name,
    CASE WHEN count(o_orderkey) = 1 THEN min(o_orderkey) END AS o_orderkey,
    CASE count(o_orderkey) WHEN 0 THEN 'NO_DATA_FOUND' WHEN 1 THEN 'OK' ELSE 'TOO_MANY_ROWS' END AS status
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey
    GROUP BY c_custkey, c_name"""

ORACLE["lookup_key"] = """SELECT c_custkey, c_custkey * 2 AS wanted, o_totalprice,
    CASE WHEN o_orderkey IS NULL THEN 'NO_DATA_FOUND' ELSE 'OK' END AS status
    FROM customer LEFT JOIN orders ON o_orderkey = c_custkey * 2"""

ORACLE["select_columns"] = """SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount,
    l_extendedprice * (1 - l_discount) AS discounted,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem"""
ORACLE["filter_rows"] = """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE o_totalprice > 100000 AND o_orderstatus = 'F'"""
ORACLE["group_by"] = """SELECT l_returnflag, l_linestatus, count(*) AS n,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price,
    min(l_discount) AS least_discount FROM lineitem GROUP BY ALL"""


# --- scripts as rows of lines --------------------------------------------------------


def big_scripts(script: str) -> str:
    """(script_id, line_no, line, pos) of the customers' scripts in larger ones."""
    return f"""{SCRIPTS}, {unnested('bl', 'src', f"string_split(source, {NL})", 'line')},
    big AS (SELECT {script} AS script_id, CAST(script_id AS BIGINT) * 100000 + pos AS line_no, line FROM bl)"""


def big_documents(cut: str) -> str:
    return f"""dl AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line
        FROM (SELECT doc_id, string_split(text, {cut}) AS ls FROM documents)),
    big AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 61 + 1 END AS script_id,
        doc_id * 1000000 + pos AS line_no, line FROM dl WHERE {strip('line')} <> '')"""


def depths_of_rows(out: str) -> str:
    delta = "(contains(upper(line), 'BEGIN')::INT - contains(upper(line), 'END')::INT)"
    w = "OVER (PARTITION BY script_id ORDER BY line_no)"
    return f"""{out}_s AS (SELECT *, sum({delta}) {w} AS s FROM big),
    {out} AS (SELECT script_id, line_no, line, {int_(f's - least(0, min(s) {w})')} AS depth FROM {out}_s)"""


def folded(source: str, value: str, held: str, starts: str, group: str) -> str:
    """Group number of each row by a recursive query over places: `held` is the state after a
    row with value v and state h before it, `starts` says whether it begins a group."""
    return f"""v AS (SELECT script_id, line_no, {value} AS v,
        row_number() OVER (PARTITION BY script_id ORDER BY line_no) AS pos FROM {source}),
    r AS (SELECT script_id, line_no, pos, (SELECT {held} FROM (SELECT 0 AS h)) AS h, 1 AS g FROM v WHERE pos = 1
        UNION ALL
        SELECT q.script_id, q.line_no, q.pos, {held}, r.g + {starts}::INT
        FROM r JOIN v q ON q.script_id = r.script_id AND q.pos = r.pos + 1)
    SELECT script_id, line_no, CAST(g AS BIGINT) AS {group} FROM r"""


ORACLE["depth_of_lines"] = f"""{WITH}{big_scripts('CAST(0 AS BIGINT)')}, {depths_of_rows('o')}
    SELECT script_id, line_no, line, depth FROM o"""
ORACLE["top_level_of_lines"] = f"""{WITH}{big_scripts('CAST(0 AS BIGINT)')}, {depths_of_rows('o')}
    SELECT script_id, line_no, CAST(1 + coalesce(sum((depth = 0 AND {strip('line')} = '/')::INT) OVER (
        PARTITION BY script_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS BIGINT) AS block_no FROM o"""
ORACLE["safe_chunks_of_lines"] = (
    f"{WITH}{big_scripts('CAST(script_id AS BIGINT) % 83')}, {depths_of_rows('o')}, "
    + folded(
        "o",
        f"(depth = 0 AND regexp_matches({rstrip('line')}, '[;/]$'))::INT",
        "CASE WHEN v = 1 AND h + 1 >= 25 THEN 0 ELSE h + 1 END",
        "(h = 0)",
        "chunk_no",
    )
)
ORACLE["batch_rows"] = f"{WITH}{big_documents(NL)}, " + folded(
    "big", "length(line)", "CASE WHEN v >= 180 OR h + v > 300 THEN 0 ELSE h + v END", "(h = 0 OR v >= 180)", "batch_no"
)
ORACLE["size_runs"] = f"{WITH}{big_documents(chr(39) + '.' + chr(39))}, " + folded(
    "big", "length(line)", "CASE WHEN h + v + 1 > 1200 THEN 0 ELSE h + v + 1 END", "(h = 0)", "run_no"
)
ORACLE["audit_summary_batches"] = ORACLE["audit_summary"]
ORACLE["rule_summary_batches"] = ORACLE["rule_summary"]
SEEN_BATCHES = "seen AS (SELECT text FROM documents WHERE lang IN ('fr', 'de') AND doc_id % 2 = 0)"
ORACLE["only_new_to_table"] = ORACLE["only_new"].replace(SEEN, SEEN_BATCHES)
ORACLE["only_new_to_table_first"] = ORACLE["only_new_first"].replace(SEEN, SEEN_BATCHES)
ORACLE["write_packed_scripts"] = ORACLE["write_script_files"]

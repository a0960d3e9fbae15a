"""DuckDB statements for the lineage analytics: the same corpus, parsed step by step in SQL."""

from millrace.functions import sqltext as t
from millrace.plans import dbt, models, patterns
from millrace.sources import corpus


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(texts) -> str:
    return ", ".join(f"({i}, {q(x)})" for i, x in enumerate(texts))


def _filled(column: str) -> str:
    return f"replace(replace({column}, '{{k}}', c_custkey::VARCHAR), '{{seg}}', lower(c_mktsegment))"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def hidden(x: str) -> str:
    return f"translate({x}, {q(t.PLAIN)}, {q(t.VEILED)})"


def shown(x: str) -> str:
    return f"translate(translate({x}, {q(t.COMMENT_START + t.COMMENT_END)}, ''), {q(t.VEILED)}, {q(t.PLAIN)})"


def veiled_piece(p: str) -> str:
    inner = hidden(f"substring({p}, 2, length({p}) - 2)")
    return f"""CASE WHEN {p}[1] = '"' AND length({p}) > 1 THEN '"' || {inner} || '"' ELSE {hidden(p)} END"""


def bare(x: str) -> str:
    return f"lower({shown(f"replace({x}, chr(34), '')")})"


WORDS = r'\w+|"[^"]*"'
TOKENS = r'[(),]|"[^"]*"|\w+|[^(),"\w]+'


def rebuilt(x: str, comment: str, quoted: str) -> str:
    return f"""array_to_string(list_transform(regexp_extract_all({x}, {q(t.PIECES)}), lambda p:
        CASE WHEN p[1:2] IN ('--', '/*') THEN {comment} WHEN p[1] IN ('''', '"') THEN {quoted} ELSE p END), '')"""


def last_part(x: str) -> str:
    return f"regexp_extract({x}, '(\"[^\"]*\"|[^\".]*)$', 1)"


def named(x: str) -> str:
    return f"regexp_replace(lower({shown(x)}), '[);,]+$', '')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def safe_label(x: str) -> str:
    cleaned = f"regexp_replace({x}, '[^a-zA-Z0-9_]', '_', 'g')"
    return f"CASE WHEN regexp_matches({cleaned}, '^[0-9]|^$') THEN 'task_' || {cleaned} ELSE {cleaned} END"


SCRIPTS = f"""
tpl(tid, body) AS (VALUES {_values(corpus.TEMPLATES)}),
scripts AS (SELECT c_custkey AS script_id, {_filled('body')} AS sql_text
            FROM customer JOIN tpl ON c_custkey % {len(corpus.TEMPLATES)} = tid)"""


#: From a BEGIN to the first END before a semicolon.
BLOCK = rf"(?is)\bBEGIN\b(.*?)\bEND\b\s*(?:{t.COMMENT}\s*)*;"


def statements_of(source: str, out: str) -> str:
    """CTEs that split the scripts of ``source`` into ``out``."""
    veiled = rebuilt("sql_text", f"{q(t.COMMENT_START)} || {hidden('p')} || {q(t.COMMENT_END)}", veiled_piece("p"))
    clean = trim(f"regexp_replace(part, {q(t.COMMENT)}, ' ', 'g')")
    return f"""
{out}_v AS (SELECT script_id, string_split(regexp_replace({veiled}, {q(BLOCK)}, '', 'g'), ';') AS parts FROM {source}),
{out}_p AS (SELECT script_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i, len(parts) AS n FROM {out}_v),
{out}_c AS (SELECT *, {clean} AS veiled, row_number() OVER (PARTITION BY script_id ORDER BY i) - 1 AS stmt_no
            FROM {out}_p WHERE {clean} <> ''),
{out}_k AS (SELECT *, CASE WHEN {has('veiled', t.CTAS)} THEN 'CTAS' WHEN {has('veiled', t.INSERT_SELECT)} THEN 'INSERT_SELECT'
              WHEN {has('veiled', t.INSERT_VALUES)} THEN 'INSERT_VALUES' ELSE 'UNKNOWN' END AS statement_type FROM {out}_c),
{out} AS (SELECT script_id, stmt_no, veiled, statement_type,
            {trim(f"({shown('part')} || CASE WHEN i < n THEN ';' ELSE '' END)")} AS raw_sql,
            CASE WHEN statement_type = 'CTAS' THEN {named(f"regexp_extract(veiled, {q(t.CTAS_BODY)}, 1)")}
                 WHEN statement_type <> 'UNKNOWN' THEN {named(f"regexp_extract(veiled, {q(t.INSERT_BODY)}, 1)")}
            END AS target_table
          FROM {out}_k)"""


def cte_list(x: str) -> str:
    stop = ", ".join(q(w) for w in t.NOT_A_CTE)
    return f"""list_transform(list_filter(regexp_extract_all(regexp_extract({x}, '(?is)\\bWITH\\b.*$'), {q(t.CTE_NAME)}, 1),
                                          lambda n: upper(n) NOT IN ({stop})), lambda n: {shown('n')})"""


def refs_of(source: str, out: str, text: str, keys: str) -> str:
    """CTEs with the distinct table references of ``text`` and their first positions."""
    found = f"regexp_extract_all({text}, {q(t.TABLE_REF)}, 1)"
    return f"""
{out}_r AS (SELECT {keys}, unnest({found}) AS raw, generate_subscripts({found}, 1) AS pos FROM {source}),
{out} AS (SELECT {keys}, {named('raw')} AS tbl, min(pos) AS pos FROM {out}_r GROUP BY ALL HAVING tbl <> 'dual')"""


STATEMENTS = f"""{SCRIPTS}, {statements_of('scripts', 'stm')},
{refs_of('stm', 'stm_refs', 'veiled', 'script_id, stmt_no, veiled, target_table')},
stm_src AS (SELECT script_id, stmt_no, tbl, pos FROM stm_refs WHERE tbl IS DISTINCT FROM target_table
            AND NOT list_contains(list_transform({cte_list('veiled')}, lambda n: lower(n)), tbl)),
catalog AS (SELECT s.*, CASE WHEN target_table IS NULL THEN 'stmt_' || s.stmt_no
              ELSE CASE statement_type WHEN 'CTAS' THEN 'create_' ELSE 'insert_' END || {last_part('target_table')} END AS label
            FROM stm s)"""

EDGES = f"""{STATEMENTS},
producers AS (SELECT script_id, target_table AS tbl, max(stmt_no) AS src FROM catalog WHERE target_table IS NOT NULL
              GROUP BY ALL),
edges AS (SELECT DISTINCT r.script_id, src, r.stmt_no AS dst, r.tbl AS via_table
          FROM stm_src r JOIN producers p ON r.script_id = p.script_id AND r.tbl = p.tbl WHERE src <> r.stmt_no)"""


def levels_of(nodes: str, edges: str, key: str, node: str) -> str:
    """CTEs ending in ``leveled(key, node, level)``; nodes on or behind a cycle have no level."""
    return f"""
g_nodes AS (SELECT {key} AS g, {node} AS node FROM {nodes}),
g_edges AS (SELECT DISTINCT {key} AS g, src, dst FROM {edges} WHERE src <> dst),
g_reach AS (SELECT g, src, dst FROM g_edges
            UNION SELECT r.g, r.src, e.dst FROM g_reach r JOIN g_edges e ON r.g = e.g AND r.dst = e.src),
g_blocked AS (SELECT DISTINCT g, dst AS node FROM g_reach r
              WHERE EXISTS (SELECT 1 FROM g_reach c WHERE c.g = r.g AND c.src = r.src AND c.dst = r.src)),
g_walk AS (SELECT g, node, 0 AS len FROM g_nodes WHERE (g, node) NOT IN (SELECT g, node FROM g_blocked)
           UNION SELECT w.g, e.dst, w.len + 1 FROM g_walk w JOIN g_edges e ON w.g = e.g AND w.node = e.src
           WHERE (e.g, e.dst) NOT IN (SELECT g, node FROM g_blocked)),
leveled AS (SELECT n.g AS {key}, n.node AS {node}, max(len) AS level FROM g_nodes n
            LEFT JOIN g_walk w ON n.g = w.g AND n.node = w.node GROUP BY ALL)"""


def bodies_of(source: str, out: str) -> str:
    """CTEs that cut the statements of ``source`` into selects, ``out(…, ord, is_final, name, body)``.

    Words, parentheses and commas are placed by character offset, and bodies are cut out by offset.
    """
    body = f"""CASE statement_type WHEN 'CTAS' THEN regexp_extract(veiled, {q(t.CTAS_BODY)}, 2)
               WHEN 'INSERT_SELECT' THEN regexp_extract(veiled, {q(t.INSERT_BODY)}, 2) ELSE veiled END"""
    return f"""
{out}_b AS (SELECT script_id, stmt_no, target_table, {body} AS body FROM {source} WHERE statement_type <> 'INSERT_VALUES'),
{out}_w AS (SELECT *, {has('body', r'(?i)^\s*WITH\b')} AS has_with,
              regexp_replace(body, '(?i)^\\s*WITH\\s+(?:RECURSIVE\\s+)?', '') AS inner_sql FROM {out}_b),
{out}_t AS (SELECT script_id, stmt_no, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM (
              SELECT *, regexp_extract_all(inner_sql, {q(TOKENS)}) AS toks FROM {out}_w WHERE has_with)),
{out}_l AS (SELECT *, sum(length(tok)) OVER w - length(tok) AS off,
              sum(CASE tok WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER w - CASE tok WHEN '(' THEN 1 ELSE 0 END AS lvl
            FROM {out}_t WINDOW w AS (PARTITION BY script_id, stmt_no ORDER BY pos)),
{out}_main AS (SELECT script_id, stmt_no, min(pos) AS main_pos, min(off) AS main_off FROM {out}_l
               WHERE lvl = 0 AND upper(tok) = 'SELECT' GROUP BY ALL),
{out}_z AS (SELECT l.*, lag(tok) OVER (PARTITION BY l.script_id, l.stmt_no ORDER BY pos) AS prev
            FROM {out}_l l LEFT JOIN {out}_main m USING (script_id, stmt_no)
            WHERE lvl = 0 AND pos < coalesce(main_pos, 999999999) AND {trim('tok')} <> ''),
{out}_open AS (SELECT script_id, stmt_no, pos, off, row_number() OVER (PARTITION BY script_id, stmt_no ORDER BY pos) - 1 AS ord
               FROM {out}_z WHERE tok = '(' AND upper(prev) IN ('AS', 'MATERIALIZED')),
{out}_close AS (SELECT o.*, min(z.pos) AS close_pos, min(z.off) AS close_off FROM {out}_open o
                JOIN {out}_z z ON o.script_id = z.script_id AND o.stmt_no = z.stmt_no AND z.tok = ')' AND z.pos > o.pos
                GROUP BY ALL),
{out}_head AS (SELECT *, lag(close_pos, 1, 0) OVER (PARTITION BY script_id, stmt_no ORDER BY ord) AS after_pos
               FROM {out}_close),
{out}_name AS (SELECT h.script_id, h.stmt_no, h.ord, h.off, h.close_off, arg_min(z.tok, z.pos) AS name FROM {out}_head h
               JOIN {out}_z z ON h.script_id = z.script_id AND h.stmt_no = z.stmt_no AND z.pos > h.after_pos
                AND z.pos < h.pos AND regexp_full_match(z.tok, {q(WORDS)}) GROUP BY ALL),
{out}_n AS (SELECT script_id, stmt_no, count(*) AS n FROM {out}_name GROUP BY ALL),
{out} AS (SELECT n.script_id, n.stmt_no, n.ord, false AS is_final, {named('n.name')} AS name,
            {trim('substring(inner_sql, n.off::BIGINT + 2, (n.close_off - n.off)::BIGINT - 1)')} AS body
          FROM {out}_name n JOIN {out}_w w USING (script_id, stmt_no)
          UNION ALL
          SELECT w.script_id, w.stmt_no, coalesce(n.n, 0), true, target_table,
            {trim('CASE WHEN has_with THEN substring(inner_sql, main_off::BIGINT + 1) ELSE inner_sql END')}
          FROM {out}_w w LEFT JOIN {out}_n n USING (script_id, stmt_no) LEFT JOIN {out}_main m USING (script_id, stmt_no)
          WHERE NOT has_with OR main_off IS NOT NULL)"""


def items_of(source: str, out: str) -> str:
    """CTEs that cut the first select list of each body of ``source`` at its own commas."""
    k = "script_id, stmt_no, ord"
    return f"""
{out}_t AS (SELECT {k}, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM (
              SELECT {k}, regexp_extract_all(body, {q(TOKENS)}) AS toks FROM {source})),
{out}_l AS (SELECT *, sum(length(tok)) OVER w - length(tok) AS off,
              sum(CASE tok WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER w - CASE tok WHEN '(' THEN 1 ELSE 0 END AS lvl
            FROM {out}_t WINDOW w AS (PARTITION BY {k} ORDER BY pos)),
{out}_s AS (SELECT {k}, min(pos) AS sel_pos, arg_min(lvl, pos) AS base, min(off) + 6 AS sel_end FROM {out}_l
            WHERE upper(tok) = 'SELECT' GROUP BY ALL),
{out}_f AS (SELECT {k}, sel_pos, base, sel_end, min(pos) AS from_pos, min(off) AS from_off FROM {out}_l JOIN {out}_s USING ({k})
            WHERE upper(tok) = 'FROM' AND lvl = base AND pos > sel_pos GROUP BY ALL),
{out}_cut AS (SELECT {k}, off AS start_off, off + 1 AS item_start FROM {out}_l JOIN {out}_f USING ({k})
              WHERE tok = ',' AND lvl = base AND pos > sel_pos AND pos < from_pos
              UNION ALL SELECT {k}, sel_end, sel_end FROM {out}_f),
{out}_e AS (SELECT c.*, lead(start_off, 1, from_off) OVER (PARTITION BY {k} ORDER BY item_start) AS end_off
            FROM {out}_cut c JOIN {out}_f USING ({k})),
{out}_x AS (SELECT {k}, item_start, is_final, name,
              {trim('substring(body, item_start::BIGINT + 1, (end_off - item_start)::BIGINT)')} AS expr
            FROM {out}_e JOIN {source} USING ({k})),
{out} AS (SELECT {k}, is_final, name, expr, row_number() OVER (PARTITION BY {k} ORDER BY item_start) - 1 AS item
          FROM {out}_x WHERE expr <> '')"""


def column_name(x: str) -> str:
    alias = f"regexp_extract({x}, {q(t.ALIAS)}, 1)"
    words = f"list_filter(regexp_split_to_array({x}, '[\\s,.()+*/\\-]'), lambda w: regexp_full_match(w, {q(WORDS)}))"
    return bare(f"CASE WHEN {x} = '*' THEN '*' WHEN {alias} <> '' THEN {alias} ELSE {words}[-1] END")


def cast_type(x: str) -> str:
    return f"upper(regexp_replace(regexp_extract({x}, {q(t.CAST)}, 1), '\\s+', '', 'g'))"


def transformation(x: str) -> str:
    fn = f"upper(regexp_extract({x}, {q(t.AGGREGATE)}, 1))"
    return f"""CASE WHEN {fn} <> '' THEN 'aggregate:' || {fn} WHEN {has(x, t.WINDOW)} THEN 'window_function'
        WHEN {has(x, t.CAST)} THEN 'cast:' || {cast_type(x)} WHEN {has(x, t.ALIAS)} THEN 'rename'
        WHEN {has(x, '[+*/-]')} THEN 'arithmetic' WHEN {has(x, '(?i)\\b(COALESCE|NVL|NULLIF)\\b')} THEN 'null_handling'
        WHEN {has(x, '(?i)\\bCASE\\b')} THEN 'case_expression' ELSE 'passthrough' END"""


MODELS = f"{STATEMENTS}, {bodies_of('stm', 'mdl')}, {items_of('mdl', 'itm')}"
NAMED = f"""{MODELS}, nm AS (SELECT *, {last_part('name')} AS short FROM mdl WHERE name IS NOT NULL),
{refs_of('nm', 'nm_refs', 'body', 'script_id, stmt_no, ord, name, short')},
kinds AS (SELECT r.*, {last_part('r.tbl')} AS ref_short, EXISTS (
            SELECT 1 FROM nm d WHERE d.script_id = r.script_id
            AND (d.name = r.tbl OR d.short = r.tbl)
            AND (d.stmt_no < r.stmt_no OR (d.stmt_no = r.stmt_no AND d.ord < r.ord))) AS is_model FROM nm_refs r)"""


def meant(source: str, reader: str) -> str:
    """The references of ``source`` with the models they mean, if any."""
    return f"""SELECT r.*, d.model FROM {source} r LEFT JOIN r_def d ON d.script_id = r.script_id AND since <= r.stmt_no
        AND (d.model = r.tbl OR ({last_part('d.model')} = r.tbl AND d.model <> r.{reader}))
        QUALIFY d.model IS NULL OR d.model = r.tbl
             OR NOT bool_or(d.model = r.tbl) OVER (PARTITION BY r.script_id, r.stmt_no, r.{reader}, r.tbl)"""


REGISTERED = f"""{MODELS},
reg AS (SELECT script_id, stmt_no, ord, is_final, name, body FROM mdl WHERE name IS NOT NULL
        UNION ALL SELECT script_id, stmt_no, 0, true, target_table, veiled FROM stm
        WHERE statement_type = 'INSERT_VALUES'),
lst AS (SELECT * FROM reg QUALIFY row_number() OVER (PARTITION BY script_id, name ORDER BY stmt_no DESC, ord DESC) = 1),
{refs_of('reg', 'reg_refs', 'body', 'script_id, stmt_no, ord, name')},
r_def AS (SELECT script_id, name AS model, min(stmt_no) AS since FROM reg GROUP BY ALL),
res AS ({meant('reg_refs', 'name')}),
m_edges AS (SELECT DISTINCT script_id, model AS src, name AS dst FROM res WHERE model <> name),
cols AS (SELECT DISTINCT i.script_id, {column_name('expr')} AS col, l.name AS model FROM lst l JOIN itm i
         USING (script_id, stmt_no, ord) WHERE {column_name('expr')} IS NOT NULL),
tsk AS (SELECT script_id, stmt_no, 'stmt_' || stmt_no AS task_id, {safe_label('label')} AS task_label, target_table, raw_sql
        FROM catalog WHERE target_table IS NOT NULL),
tsk_r AS (SELECT k.*, tbl FROM tsk k JOIN stm_src USING (script_id, stmt_no)),
tsk_src AS (SELECT DISTINCT script_id, task_id, coalesce(model, tbl) AS tbl FROM ({meant('tsk_r', 'target_table')}))"""

REACH = """
reach AS (SELECT script_id, src, dst FROM m_edges
          UNION SELECT r.script_id, r.src, e.dst FROM reach r JOIN m_edges e ON r.script_id = e.script_id AND r.dst = e.src)"""

AFFECTED = """
aff AS (SELECT e.script_id, a.col, src, dst FROM m_edges e JOIN cols a ON a.script_id = e.script_id AND a.model = src
        JOIN cols b ON b.script_id = e.script_id AND b.model = dst AND a.col = b.col)"""

QUESTIONS = f"""
asked AS (SELECT DISTINCT script_id, {column_name('expr')} AS col FROM itm WHERE name IS NOT NULL
          AND {column_name('expr')} <> '*'),
qst AS (SELECT * FROM asked UNION ALL SELECT DISTINCT script_id, 'no_such_column' FROM asked)"""

TRACE = f"""{MODELS}, {QUESTIONS},
occ AS (SELECT script_id, stmt_no, ord, item, expr, {bare(f"regexp_extract(expr, {q(t.ALIAS)}, 1)")} AS alias,
          list_distinct(list_transform(regexp_extract_all(expr, {q(WORDS)}), lambda w: {bare('w')})) AS ws FROM itm),
wrd AS (SELECT script_id, stmt_no, ord, item, expr, alias, unnest(ws) AS w FROM occ),
hop AS (SELECT * FROM wrd QUALIFY row_number() OVER (PARTITION BY script_id, stmt_no, ord, w ORDER BY item) = 1),
ends AS (SELECT script_id, stmt_no, max(ord) AS last_ord FROM mdl GROUP BY ALL),
walk AS (SELECT q.script_id, q.col, e.stmt_no, last_ord, -1 AS ord, q.col AS cur, NULL::VARCHAR AS input_col,
           NULL::VARCHAR AS expr FROM qst q JOIN ends e ON q.script_id = e.script_id
         UNION ALL
         SELECT k.script_id, k.col, k.stmt_no, k.last_ord, k.ord + 1,
           CASE WHEN h.w IS NULL OR h.alias = '' THEN k.cur ELSE h.alias END, h.w, h.expr
         FROM walk k LEFT JOIN hop h ON h.script_id = k.script_id AND h.stmt_no = k.stmt_no AND h.ord = k.ord + 1
           AND h.w = k.cur WHERE k.ord < k.last_ord),
steps AS (SELECT k.script_id, k.col, row_number() OVER (PARTITION BY k.script_id, k.col ORDER BY k.stmt_no, k.ord) AS hop,
            k.stmt_no, coalesce({last_part('m.name')}, 'final_output') AS model_name, is_final, input_col,
            cur AS output_col, {transformation('k.expr')} AS transformation, {shown('k.expr')} AS snippet
          FROM walk k JOIN mdl m ON m.script_id = k.script_id AND m.stmt_no = k.stmt_no AND m.ord = k.ord
          WHERE k.input_col IS NOT NULL)"""

DOTTED = r'(?:\w+|"[^"]*")(?:\.(?:\w+|"[^"]*"))*'
_NO_ALIAS = ", ".join(q(w) for w in (
    "WHERE JOIN ON USING LEFT RIGHT FULL INNER OUTER CROSS NATURAL LATERAL GROUP ORDER HAVING UNION EXCEPT INTERSECT MINUS "
    "LIMIT OFFSET FETCH PIVOT UNPIVOT START CONNECT WINDOW QUALIFY SET WHEN ( ) ,"
).split())
ACROSS = f"""{MODELS}, {QUESTIONS},
x_tok AS (SELECT script_id, stmt_no, ord, regexp_extract_all(body, {q(DOTTED + '|[(),]')}) AS toks FROM mdl),
x_at AS (SELECT script_id, stmt_no, ord, toks[i + 1] AS ref, toks[i + 2] AS after, toks[i + 3] AS then_
         FROM x_tok, unnest(range(1, len(toks) + 1)) r(i) WHERE upper(toks[i]) IN ('FROM', 'JOIN') AND toks[i + 1] NOT IN ('(', ')', ',')),
x_scope AS (SELECT DISTINCT script_id, stmt_no, ord, {named('ref')} AS ref,
              coalesce(CASE WHEN upper(after) = 'AS' THEN {bare('then_')} WHEN upper(after) NOT IN ({_NO_ALIAS}) THEN {bare('after')} END,
                       {bare(last_part(named('ref')))}) AS called FROM x_at),
x_opt AS (SELECT script_id, stmt_no AS f_stmt, ord AS f_ord, is_final, name AS ref FROM mdl WHERE name IS NOT NULL
          UNION SELECT script_id, stmt_no, ord, is_final, {last_part('name')} FROM mdl WHERE is_final AND name IS NOT NULL),
x_feed AS (SELECT script_id, stmt_no, ord, called, max({{'s': f_stmt, 'o': f_ord}}) AS f FROM x_scope JOIN x_opt USING (script_id, ref)
           WHERE CASE WHEN is_final THEN f_stmt < stmt_no ELSE f_stmt = stmt_no AND f_ord < ord END GROUP BY script_id, stmt_no, ord, called, ref),
x_word AS (SELECT script_id, stmt_no, ord, item,
             unnest(regexp_extract_all(regexp_replace(expr, {q(t.ALIAS)}, ''), {q(DOTTED)})) AS word FROM itm),
x_rest AS (SELECT *, regexp_replace(word, '\\.?("[^"]*"|[^".]*)$', '') AS rest FROM x_word),
x_said AS (SELECT DISTINCT script_id, stmt_no, ord, item, {bare(last_part('word'))} AS col,
             CASE WHEN rest <> '' THEN {bare(last_part('rest'))} END AS qualifier FROM x_rest),
x_edge AS (SELECT DISTINCT m.script_id, i.stmt_no AS a_stmt, i.ord AS a_ord, i.item AS a_item, m.stmt_no, m.ord, m.item
           FROM x_said m JOIN x_feed g ON g.script_id = m.script_id AND g.stmt_no = m.stmt_no AND g.ord = m.ord
             AND (qualifier IS NULL OR qualifier = called)
           JOIN itm i ON i.script_id = m.script_id AND i.stmt_no = f.s AND i.ord = f.o AND {column_name('i.expr')} = m.col),
x_first AS (SELECT script_id, col, min({{'s': stmt_no, 'o': ord}}) AS f FROM x_said GROUP BY ALL),
x_reach AS (SELECT q.script_id, q.col, m.stmt_no, m.ord, m.item FROM (SELECT DISTINCT * FROM qst) q
              JOIN x_first USING (script_id, col) JOIN x_said m ON m.script_id = q.script_id AND m.col = q.col AND m.stmt_no = f.s AND m.ord = f.o
            UNION SELECT r.script_id, r.col, e.stmt_no, e.ord, e.item FROM x_reach r JOIN x_edge e
              ON e.script_id = r.script_id AND a_stmt = r.stmt_no AND a_ord = r.ord AND a_item = r.item)"""

_BLANK = "regexp_replace({}, '[^\\n]', ' ', 'g')"
_HOLLOW = f"""CASE WHEN length(p) > 1 AND p[-1] = p[1] THEN p[1] || {_BLANK.format('p[2:-2]')} || p[1] ELSE p[1] || {_BLANK.format('p[2:]')} END"""
BLANKED = f"""{SCRIPTS},
txt AS (SELECT script_id, {rebuilt('sql_text', _BLANK.format('p'), _HOLLOW)} AS txt FROM scripts)"""

HITS = f"""{BLANKED},
rules(rule, pattern_type, score, rx) AS (VALUES {', '.join(f'({i}, {q(k)}, {s}, {q(p)})' for i, (k, s, p) in enumerate(patterns.RULES))}),
cut AS (SELECT script_id, rule, pattern_type, score, string_split(regexp_replace(txt, rx, chr(1) || '\\0', 'g'), chr(1)) AS parts
        FROM txt, rules WHERE regexp_matches(txt, rx)),
prt AS (SELECT script_id, rule, pattern_type, score, unnest(parts) AS part, generate_subscripts(parts, 1) AS i, len(parts) AS n
        FROM cut),
found AS (SELECT script_id, pattern_type, score, i, n,
            sum(length(part)) OVER (PARTITION BY script_id, rule ORDER BY i) AS location FROM prt),
hit AS (SELECT script_id, pattern_type, score, location FROM found WHERE i < n),
prn AS (SELECT script_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM (
          SELECT script_id, regexp_extract_all(regexp_replace(txt, '''[^'']*''', '''''', 'g'),
                                               '(?i)\\(\\s*SELECT\\b|[()]') AS toks FROM txt)),
ttl AS (SELECT *, sum(CASE tok WHEN ')' THEN -1 ELSE 1 END) OVER (PARTITION BY script_id ORDER BY i) AS total FROM prn),
dep AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY script_id ORDER BY i)) AS depth FROM ttl),
depths AS (SELECT s.script_id, coalesce(max(depth) FILTER (length(tok) > 1), 0) AS max_depth
           FROM txt s LEFT JOIN dep d USING (script_id) GROUP BY ALL),
hits AS (SELECT script_id, pattern_type, location, score AS complexity_score FROM hit h WHERE pattern_type <> 'CTE'
           OR NOT EXISTS (SELECT 1 FROM hit r WHERE r.script_id = h.script_id AND r.pattern_type = 'RECURSIVE_CTE'
                          AND abs(r.location - h.location) < 20)
         UNION ALL SELECT script_id, 'NESTED_SUBQUERY', 0, 3 FROM depths WHERE max_depth >= 3)"""

DBT = f"""
dtpl(name, body) AS (VALUES {', '.join(f'({q(n)}, {q(b)})' for n, b in corpus.DBT_MODELS)}),
dbt_src AS (SELECT 'nation_' || c_nationkey AS project, {_filled('name')} AS name, {_filled('body')} AS sql_text
            FROM customer, dtpl
            UNION ALL SELECT DISTINCT 'nation_' || c_nationkey, {_filled(q(corpus.DBT_DIM[0]))}, {_filled(q(corpus.DBT_DIM[1]))}
            FROM customer),
dbt_ok AS (SELECT * FROM dbt_src WHERE {has('name', t.SAFE_MODEL_NAME)}),
dbt_refs AS (SELECT project, name, ref, min(pos) AS pos FROM (
               SELECT project, name, unnest(regexp_extract_all(sql_text, {q(dbt.REF)}, 1)) AS ref,
                      generate_subscripts(regexp_extract_all(sql_text, {q(dbt.REF)}, 1), 1) AS pos FROM dbt_ok) GROUP BY ALL),
dbt_srcs AS (SELECT project, name, s || '.' || t AS src, min(pos) AS pos FROM (
               SELECT project, name, unnest(regexp_extract_all(sql_text, {q(dbt.SOURCE)}, 1)) AS s,
                      unnest(regexp_extract_all(sql_text, {q(dbt.SOURCE)}, 2)) AS t,
                      generate_subscripts(regexp_extract_all(sql_text, {q(dbt.SOURCE)}, 1), 1) AS pos FROM dbt_ok) GROUP BY ALL),
dbt_edges AS (SELECT DISTINCT r.project, r.ref AS src, r.name AS dst FROM dbt_refs r JOIN dbt_ok k
              ON r.project = k.project AND r.ref = k.name WHERE r.ref <> r.name)"""

VERSIONS = f"""
vtpl(tid, a, b) AS (VALUES {', '.join(f'({i}, {q(a)}, {q(b)})' for i, (a, b) in enumerate(corpus.VERSIONS))}),
vers AS (SELECT c_custkey AS id, {_filled('a')} AS v1, {_filled('b')} AS v2
         FROM customer JOIN vtpl ON c_custkey % {len(corpus.VERSIONS)} = tid)"""

LAYERS = ", ".join(q(s) for s in models.MART_SCHEMAS)
GROUPED = f"({has('body', '(?i)' + chr(92) + 'bGROUP' + chr(92) + 's+BY' + chr(92) + 'b')} OR {has('body', t.AGGREGATE)})"
WINDOWED = has("body", t.WINDOW)
FLAT = trim("regexp_replace({}, '\\s+', ' ', 'g')")
SHORTENED = f"""CASE WHEN length({FLAT.format(shown('body'))}) <= 300 THEN {FLAT.format(shown('body'))}
    ELSE regexp_extract({FLAT.format(shown('body'))}, '^(.{{0,294}})\\s', 1) || ' [...]' END"""

LINEAGE = f"""{REGISTERED},
l_reads AS (SELECT DISTINCT script_id, coalesce(model, tbl) AS source, name AS target FROM res),
l_known AS (SELECT script_id, name AS source FROM reg UNION SELECT script_id, source FROM l_reads),
l_edges AS (SELECT * FROM l_reads UNION SELECT script_id, tbl, task_id FROM tsk_src
            WHERE (script_id, tbl) IN (SELECT script_id, source FROM l_known)),
l_count AS (SELECT script_id, stmt_no, ord, count(*) AS n FROM itm GROUP BY ALL),
l_nodes AS (
  SELECT l.script_id, name AS id, {last_part('name')} AS label,
         CASE WHEN is_final AND split_part(name, '.', 1) IN ({LAYERS}) AND contains(name, '.') THEN 'dbt_model'
              ELSE 'cte' END AS node_type, {SHORTENED} AS snippet, coalesce(n, 0) AS column_count
  FROM lst l LEFT JOIN l_count USING (script_id, stmt_no, ord)
  UNION ALL
  SELECT DISTINCT script_id, source, {last_part('source')}, CASE WHEN contains(source, '.') THEN 'table' ELSE 'cte' END,
         'Referenced as: ' || source, 0 FROM l_reads WHERE (script_id, source) NOT IN (SELECT script_id, name FROM reg)
  UNION ALL
  SELECT script_id, task_id, task_label, 'dag_task', raw_sql[1:200], 0 FROM tsk)"""

SQL = {
    "script_directory": f"""WITH {STATEMENTS}, n AS (SELECT script_id, count(*) AS n FROM catalog GROUP BY 1)
        SELECT 'script_' || script_id AS name, 'group_' || (script_id % 7) AS place, length(sql_text)::BIGINT AS chars,
               sha256(sql_text) AS checksum, coalesce(n, 0) AS statements FROM scripts LEFT JOIN n USING (script_id)""",
    "catalog_refresh": f"""WITH {VERSIONS}, v2s AS (SELECT id AS script_id, v2 AS sql_text FROM vers), {statements_of('v2s', 'vst')}
        SELECT v.script_id, stmt_no::BIGINT AS stmt_no, statement_type, target_table, raw_sql,
               CASE WHEN sql_text IN (SELECT v1 FROM vers) THEN 1 ELSE 2 END::BIGINT AS run
        FROM vst v JOIN v2s USING (script_id)""",
    "corpus_edges": f"""WITH {STATEMENTS},
        u AS (SELECT tbl, script_id, stmt_no, 0 AS w FROM stm_src
              UNION ALL SELECT target_table, script_id, stmt_no, 1 FROM catalog WHERE target_table IS NOT NULL),
        f AS (SELECT *, last_value(CASE WHEN w = 1 THEN {{'s': script_id, 'n': stmt_no}} END IGNORE NULLS) OVER (
                PARTITION BY tbl ORDER BY script_id, stmt_no, w ROWS UNBOUNDED PRECEDING) AS src FROM u)
        SELECT src.s AS src_script, src.n::BIGINT AS src_stmt, script_id AS dst_script, stmt_no::BIGINT AS dst_stmt, tbl AS via_table
        FROM f WHERE w = 0 AND src IS NOT NULL""",
    "corpus_downstream": f"""WITH RECURSIVE {STATEMENTS},
        e AS (SELECT DISTINCT tbl AS src, target_table AS dst FROM stm_src JOIN catalog USING (script_id, stmt_no)
              WHERE target_table IS NOT NULL),
        r AS (SELECT DISTINCT tbl AS origin, tbl AS node FROM stm_src WHERE starts_with(tbl, 'raw.')
              UNION SELECT origin, dst FROM r JOIN e ON node = src)
        SELECT origin AS "table", node AS depends FROM r WHERE origin <> node""",
    "script_clean": f"""WITH {SCRIPTS} SELECT script_id, {trim(
        "regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + rebuilt('sql_text', "' '", 'p')
        + ", '(?s)\\{\\{.*?\\}\\}', ' __JINJA_EXPR__ ', 'g'), '(?s)\\{%-?.*?-?%\\}', ' ', 'g'), '[ \\t]+', ' ', 'g'),"
        + " '\\n{3,}', chr(10) || chr(10), 'g')")} AS clean_text FROM scripts""",
    "rejected_scripts": f"""WITH {STATEMENTS} SELECT script_id, 'no statements' AS reason FROM scripts
        WHERE script_id NOT IN (SELECT script_id FROM stm)""",
    "unsafe_labels": f"""WITH {STATEMENTS} SELECT script_id, stmt_no, label, {safe_label('label')} AS task_id FROM catalog
        WHERE NOT {has('label', t.SAFE_IDENTIFIER)}""",
    "stmt_catalog": f"""WITH {STATEMENTS}
        SELECT c.script_id, c.stmt_no, 'stmt_' || c.stmt_no AS stmt_id, raw_sql, {shown('veiled')} AS clean_sql, statement_type,
               target_table,
               coalesce((SELECT string_agg(tbl, ',' ORDER BY pos) FROM stm_src s
                         WHERE s.script_id = c.script_id AND s.stmt_no = c.stmt_no), '') AS source_tables,
               {has('veiled', '(?i)' + chr(92) + 'bWHERE' + chr(92) + 'b')} AS has_where,
               {has('veiled', '(?i)' + chr(92) + 'bGROUP' + chr(92) + 's+BY' + chr(92) + 'b')} AS has_group_by,
               array_to_string(list_sort(list_distinct(list_transform(
                 regexp_extract_all(veiled, {q(t.AGGREGATE)}, 1), lambda f: upper(f)))), ',') AS aggregations, label
        FROM catalog c""",
    "stmt_aggregations": f"""WITH {STATEMENTS}, used AS (SELECT DISTINCT script_id, stmt_no,
            unnest(list_transform(regexp_extract_all(veiled, {q(t.AGGREGATE)}, 1), lambda f: upper(f))) AS aggregation FROM stm)
        SELECT aggregation, count(*) AS statements, count(DISTINCT script_id) AS scripts FROM used GROUP BY 1""",
    "stmt_edges": f"WITH {EDGES} SELECT * FROM edges",
    "stmt_edges_nearest_prior": f"""WITH {STATEMENTS},
        w AS (SELECT script_id, stmt_no, target_table FROM catalog WHERE target_table IS NOT NULL)
        SELECT r.script_id, max(w.stmt_no) AS src, r.stmt_no AS dst, r.tbl AS via_table FROM stm_src r
        JOIN w ON w.script_id = r.script_id AND w.target_table = r.tbl AND w.stmt_no < r.stmt_no GROUP BY ALL""",
    "stmt_predecessors": f"""WITH {EDGES}, e AS (SELECT DISTINCT script_id, src, dst FROM edges)
        SELECT script_id, dst AS stmt_no, string_agg(src::VARCHAR, ',' ORDER BY src) AS predecessors FROM e GROUP BY ALL""",
    "stmt_levels": f"WITH RECURSIVE {EDGES}, {levels_of('catalog', 'edges', 'script_id', 'stmt_no')} SELECT * FROM leveled",
    "cycles": f"""WITH RECURSIVE {EDGES},
        r AS (SELECT script_id, src AS a, dst AS b FROM edges UNION
              SELECT r.script_id, a, dst FROM r JOIN edges e ON r.script_id = e.script_id AND b = src)
        SELECT script_id, x.a AS stmt_no, min(x.b) AS component FROM r x JOIN r y USING (script_id)
        WHERE x.b = y.a AND y.b = x.a GROUP BY ALL""",
    "dependency_labels": f"""WITH RECURSIVE {EDGES}, {levels_of('catalog', 'edges', 'script_id', 'stmt_no')},
        lab AS (SELECT script_id, stmt_no, {safe_label('label')} AS label FROM catalog)
        SELECT e.script_id, u.label AS upstream, d.label AS downstream, min(level) AS level FROM edges e
        JOIN lab u ON u.script_id = e.script_id AND u.stmt_no = src JOIN lab d ON d.script_id = e.script_id AND d.stmt_no = dst
        JOIN leveled v ON v.script_id = e.script_id AND v.stmt_no = dst GROUP BY 1, 2, 3""",
    "tables_touched": f"""WITH {STATEMENTS} SELECT DISTINCT script_id, tbl AS "table", 'read' AS role FROM stm_src
        UNION SELECT script_id, target_table, 'write' FROM catalog WHERE target_table IS NOT NULL""",
    "corpus_rollup": f"""WITH {STATEMENTS} SELECT statement_type, count(*) AS statements,
        count(DISTINCT script_id) AS scripts,
        count(*) FILTER ({has('veiled', '(?i)' + chr(92) + 'bWHERE' + chr(92) + 'b')}) AS filtered,
        count(*) FILTER ({has('veiled', '(?i)' + chr(92) + 'bGROUP' + chr(92) + 's+BY' + chr(92) + 'b')}) AS "grouped"
        FROM catalog GROUP BY 1""",
    "most_read_tables": f"""WITH {STATEMENTS} SELECT tbl AS "table", count(*) AS readers FROM stm_src GROUP BY 1
        ORDER BY readers DESC, 1""",
    "script_changes": f"""WITH {VERSIONS} SELECT id AS script_id, 'changed' AS change, sha256(v1) AS old_checksum,
        sha256(v2) AS new_checksum FROM vers WHERE v1 <> v2""",
    "pattern_hits": f"WITH {HITS} SELECT script_id, pattern_type, location::BIGINT AS location, complexity_score FROM hits",
    "nesting_depth": f"WITH {HITS} SELECT script_id, max_depth::BIGINT AS max_depth FROM depths",
    "pattern_warnings": f"""WITH {HITS}, codes(pattern_type, code, message) AS (VALUES {', '.join(
        f'({q(a)}, {q(b)}, {q(c)})' for a, b, c in patterns.WARNINGS)}),
        fst AS (SELECT script_id, pattern_type, min(location)::BIGINT AS location FROM hits GROUP BY ALL)
        SELECT script_id, code, message, len(string_split(sql_text[1:location], chr(10))) AS line
        FROM fst JOIN codes USING (pattern_type) JOIN scripts USING (script_id)""",
    "script_complexity": f"""WITH {HITS} SELECT script_id, count(*) AS patterns, sum(complexity_score)::BIGINT AS score,
        max(complexity_score) AS worst FROM hits GROUP BY 1""",
    "cte_order": f"""WITH {SCRIPTS}, n AS (SELECT script_id, {cte_list(rebuilt('sql_text', "' '", veiled_piece('p')))} AS names
                                            FROM scripts)
        SELECT script_id, generate_subscripts(names, 1) - 1 AS position, unnest(names) AS cte FROM n""",
    "cte_bodies": f"""WITH {MODELS} SELECT script_id, stmt_no, ord, is_final, name, {shown('body')} AS body FROM mdl""",
    "model_columns": f"""WITH {MODELS}, c AS (SELECT *, {column_name('expr')} AS col FROM itm WHERE name IS NOT NULL)
        SELECT script_id, stmt_no, ord, is_final, name AS model, col AS column, {shown('expr')} AS expr,
               {transformation('expr')} AS transformation, {cast_type('expr')} AS data_type,
               CASE WHEN col = '*' THEN 'All columns from upstream'
                    WHEN {has('expr', t.AGGREGATE)} THEN upper(regexp_extract(expr, {q(t.AGGREGATE)}, 1)) || ' of ' || col
                    WHEN {has('expr', t.WINDOW)} THEN 'Window function result: ' || col
                    WHEN {has('expr', t.CAST)} THEN 'Cast column: ' || col ELSE 'Column: ' || col END AS description
        FROM c WHERE col IS NOT NULL""",
    "column_counts": f"""WITH {MODELS}, n AS (SELECT script_id, stmt_no, ord, count(*) AS n FROM itm GROUP BY ALL)
        SELECT script_id, stmt_no, name AS model, coalesce(n, 0) AS column_count
        FROM mdl LEFT JOIN n USING (script_id, stmt_no, ord) WHERE name IS NOT NULL""",
    "model_catalog": f"""WITH {MODELS} SELECT script_id, stmt_no, ord, {last_part('name')} AS name,
        CASE WHEN is_final THEN 'target' ELSE 'cte' END AS kind,
        CASE WHEN is_final AND contains(name, '.') AND split_part(name, '.', 1) IN ({LAYERS}) THEN 'marts'
             ELSE 'staging' END AS layer,
        CASE WHEN {GROUPED} OR {WINDOWED} THEN 'table' ELSE 'view' END AS materialized,
        'dbt model: ' || {last_part('name')} || '.' || CASE WHEN {GROUPED} THEN ' Aggregated grain.' ELSE '' END
          || CASE WHEN {has('body', '(?i)' + chr(92) + 'bUNION' + chr(92) + 's+ALL' + chr(92) + 'b')}
                  THEN ' UNION ALL of multiple sub-selects.' ELSE '' END
          || CASE WHEN {WINDOWED} THEN ' Contains window functions.' ELSE '' END AS description,
        {shown('body')} AS body FROM mdl WHERE name IS NOT NULL""",
    "model_refs": f"""WITH {NAMED} SELECT script_id, stmt_no, ord, short AS model,
        coalesce(string_agg(DISTINCT ref_short, ',' ORDER BY ref_short) FILTER (is_model), '') AS model_refs,
        coalesce(string_agg(DISTINCT tbl, ',' ORDER BY tbl) FILTER (NOT is_model AND contains(tbl, '.')), '') AS source_refs
        FROM kinds GROUP BY ALL""",
    "source_catalog": f"""WITH {NAMED}, o AS (SELECT DISTINCT script_id, split_part(tbl, '.', 1) AS "schema",
            regexp_replace(tbl, '^[^.]*\\.', '') AS x FROM kinds WHERE NOT is_model AND contains(tbl, '.'))
        SELECT script_id, "schema", string_agg(x, ',' ORDER BY x) AS tables FROM o GROUP BY ALL""",
    "dbt_models": f"""WITH {DBT} SELECT project, name,
        coalesce((SELECT string_agg(ref, ',' ORDER BY pos) FROM dbt_refs r WHERE r.project = k.project AND r.name = k.name), '')
          AS deps,
        coalesce((SELECT string_agg(src, ',' ORDER BY pos) FROM dbt_srcs r WHERE r.project = k.project AND r.name = k.name), '')
          AS sources,
        coalesce(nullif(lower(regexp_extract(sql_text, {q(dbt.MATERIALIZED)}, 1)), ''), 'view') AS materialization,
        {has('sql_text', dbt.INCREMENTAL)} AS is_incremental FROM dbt_ok k""",
    "dbt_rejected": f"""WITH {DBT} SELECT project, name, 'unsafe name' AS reason FROM dbt_src
        WHERE NOT {has('name', t.SAFE_MODEL_NAME)}""",
    "dbt_edges": f"WITH {DBT} SELECT * FROM dbt_edges",
    "dbt_levels": f"WITH RECURSIVE {DBT}, {levels_of('dbt_ok', 'dbt_edges', 'project', 'name')} SELECT * FROM leveled",
    "model_edges": f"WITH {REGISTERED} SELECT * FROM m_edges",
    "column_index": f"WITH {REGISTERED} SELECT script_id, col AS column, model FROM cols",
    "model_closure": f"WITH RECURSIVE {REGISTERED}, {REACH} SELECT * FROM reach",
    "impact_all_columns": f"""WITH RECURSIVE {REGISTERED}, {REACH},
        near AS (SELECT script_id, col, model AS node FROM cols
                 UNION SELECT c.script_id, col, dst FROM cols c JOIN reach r ON r.script_id = c.script_id AND src = model),
        hit AS (SELECT DISTINCT n.script_id, col, task_id FROM near n JOIN tsk_src k ON k.script_id = n.script_id AND tbl = node),
        a AS (SELECT script_id, col, string_agg(model, ',' ORDER BY model) AS models, count(*) AS n FROM cols GROUP BY ALL),
        b AS (SELECT script_id, col, string_agg(task_id, ',' ORDER BY task_id) AS tasks, count(*) AS n FROM hit GROUP BY ALL)
        SELECT script_id, col AS column, models AS affected_models, coalesce(tasks, '') AS affected_tasks,
               a.n + coalesce(b.n, 0) AS blast_radius FROM a LEFT JOIN b USING (script_id, col)""",
    "dependency_tree": f"""WITH {REGISTERED}, {AFFECTED} SELECT c.script_id, c.col AS column, model AS parent,
        coalesce(string_agg(DISTINCT dst, ',' ORDER BY dst), '') AS children
        FROM cols c LEFT JOIN aff ON aff.script_id = c.script_id AND aff.col = c.col AND src = model GROUP BY 1, 2, 3""",
    "critical_path": f"""WITH RECURSIVE {REGISTERED}, {AFFECTED},
        loops AS (SELECT script_id, col, src, dst FROM aff UNION SELECT r.script_id, r.col, r.src, e.dst FROM loops r
                  JOIN aff e ON e.script_id = r.script_id AND e.col = r.col AND r.dst = e.src),
        cyclic AS (SELECT DISTINCT script_id, col FROM loops WHERE src = dst),
        paths AS (SELECT script_id, col, model AS node, [model] AS path FROM cols
                  WHERE (script_id, col) NOT IN (SELECT script_id, col FROM cyclic)
                  UNION ALL SELECT p.script_id, p.col, e.dst, list_append(p.path, e.dst) FROM paths p
                  JOIN aff e ON e.script_id = p.script_id AND e.col = p.col AND e.src = p.node),
        best AS (SELECT script_id, col, path FROM paths
                 QUALIFY row_number() OVER (PARTITION BY script_id, col ORDER BY len(path) DESC, path) = 1)
        SELECT script_id, col AS column, array_to_string(path, ',') AS path FROM best
        UNION ALL SELECT c.script_id, c.col, arg_min(model, stmt_no * 1000 + ord) FROM cols c JOIN cyclic USING (script_id, col)
        JOIN reg r ON r.script_id = c.script_id AND r.name = model GROUP BY ALL""",
    "rename_impact": f"""WITH {REGISTERED},
        ln AS (SELECT script_id, name, unnest(string_split(body, chr(10))) AS line,
                 generate_subscripts(string_split(body, chr(10)), 1) AS i FROM lst)
        SELECT c.script_id, 'models/' || {last_part('model')} || '.sql' AS file_path,
               {trim(shown('arg_min(line, i)'))} AS line_hint, 'rename' AS change_type, col AS old_value,
               col || '_v2' AS new_value
        FROM cols c JOIN ln ON ln.script_id = c.script_id AND ln.name = model
          AND list_contains(list_transform(regexp_extract_all(line, {q(WORDS)}), lambda w: {bare('w')}), col)
        GROUP BY c.script_id, model, col""",
    "breaking_changes": f"""WITH {VERSIONS},
        both_v AS (SELECT id * 2 AS script_id, v1 AS sql_text FROM vers UNION ALL SELECT id * 2 + 1, v2 FROM vers),
        {statements_of('both_v', 'vst')}, {bodies_of('vst', 'vmd')}, {items_of('vmd', 'vit')},
        vc AS (SELECT script_id // 2 AS id, script_id % 2 AS v, {column_name('expr')} AS col, nullif({cast_type('expr')}, '') AS ty,
                 stmt_no, item FROM vit WHERE is_final),
        g AS (SELECT id, col, bool_or(v = 0) AS in1, bool_or(v = 1) AS in2,
                arg_max(ty, stmt_no * 100000 + item) FILTER (v = 0 AND ty IS NOT NULL) AS t1,
                arg_max(ty, stmt_no * 100000 + item) FILTER (v = 1 AND ty IS NOT NULL) AS t2
              FROM vc WHERE col IS NOT NULL GROUP BY ALL),
        d AS (SELECT id, coalesce(list(col ORDER BY col) FILTER (NOT in1), []) AS a,
                coalesce(list(col ORDER BY col) FILTER (NOT in2), []) AS r,
                coalesce(list(col || ' ' || t1 || ' -> ' || t2 ORDER BY col) FILTER (in1 AND in2 AND t1 <> t2), []) AS y
              FROM g GROUP BY id),
        e AS (SELECT id, y, len(a) = 1 AND len(r) = 1 AS ren, a, r FROM d),
        f AS (SELECT id, y, CASE WHEN ren THEN [] ELSE a END AS a, CASE WHEN ren THEN [] ELSE r END AS r,
                CASE WHEN ren THEN r[1] || ' -> ' || a[1] ELSE '' END AS n FROM e)
        SELECT id AS script_id, array_to_string(a, ',') AS added, array_to_string(r, ',') AS removed, n AS renamed,
               array_to_string(y, ',') AS type_changes, len(r) > 0 OR n <> '' OR len(y) > 0 AS is_breaking,
               coalesce(nullif(concat_ws('; ',
                 CASE WHEN len(r) > 0 THEN len(r) || ' column(s) removed: [''' || array_to_string(r, ''', ''') || ''']' END,
                 CASE WHEN n <> '' THEN '1 column(s) renamed' END,
                 CASE WHEN len(y) > 0 THEN len(y) || ' type change(s)' END,
                 CASE WHEN len(a) > 0 THEN len(a) || ' column(s) added (non-breaking)' END), ''), 'No changes detected')
                 AS summary
        FROM f""",
    "column_trace": f"""WITH RECURSIVE {TRACE} SELECT script_id, col AS column, hop, stmt_no, model_name, input_col,
        output_col, transformation, snippet FROM steps""",
    "column_trace_across": f"""WITH RECURSIVE {ACROSS} SELECT script_id, col AS column,
        row_number() OVER (PARTITION BY script_id, col ORDER BY stmt_no, ord, item) AS hop, stmt_no::BIGINT AS stmt_no,
        coalesce({last_part('name')}, 'final_output') AS model_name, {column_name('expr')} AS output_col,
        {transformation('expr')} AS transformation, {shown('expr')} AS snippet
        FROM (SELECT DISTINCT * FROM x_reach) JOIN itm USING (script_id, stmt_no, ord, item)""",
    "trace_rollup": f"""WITH RECURSIVE {TRACE},
        fnd AS (SELECT script_id, col, count(*) AS depth, min(stmt_no) AS first_stmt,
                  arg_max(model_name, stmt_no) FILTER (is_final) AS final_output FROM steps GROUP BY ALL),
        org AS (SELECT script_id, stmt_no, list_filter(
                  list_transform(regexp_extract_all(veiled, {q(t.FROM_REF)}, 1), lambda x: {named('x')}),
                  lambda x: NOT list_contains(list_transform({cte_list('veiled')}, lambda n: lower(n)), x))[1] AS source FROM stm),
        src AS (SELECT f.script_id, f.col, arg_min(source, stmt_no) AS source_table FROM fnd f JOIN org o
                ON o.script_id = f.script_id AND o.stmt_no >= first_stmt WHERE source IS NOT NULL GROUP BY ALL)
        SELECT q.script_id, q.col AS column, depth IS NOT NULL AS found, coalesce(depth, 0) AS depth, final_output, source_table
        FROM qst q LEFT JOIN fnd USING (script_id, col) LEFT JOIN src USING (script_id, col)""",
    "lineage_nodes": f"WITH {LINEAGE} SELECT * FROM l_nodes",
    "lineage_edges": f"WITH {LINEAGE} SELECT * FROM l_edges",
    "lineage_neighbours": f"""WITH {LINEAGE},
        u AS (SELECT script_id, target AS id, string_agg(source, ',' ORDER BY source) AS s, count(*) AS n FROM l_edges GROUP BY ALL),
        d AS (SELECT script_id, source AS id, string_agg(target, ',' ORDER BY target) AS s, count(*) AS n FROM l_edges GROUP BY ALL)
        SELECT script_id, id, coalesce(u.s, '') AS upstream, coalesce(d.s, '') AS downstream, coalesce(u.n, 0) AS in_degree,
               coalesce(d.n, 0) AS out_degree
        FROM l_nodes LEFT JOIN u USING (script_id, id) LEFT JOIN d USING (script_id, id)""",
    "lineage_export": f"""WITH {LINEAGE} SELECT 'node' AS kind, script_id, id AS a, label AS b FROM l_nodes
        UNION ALL SELECT 'edge', script_id, source, target FROM l_edges""",
    "incremental_events_stream": "SELECT event_id, ts, user_id, event_type, ts::DATE AS day FROM events",
}

"""The DuckDB statement of every query of this subpackage that SQL can express.

The other queries rest on a trained model, a tokenizer, a 64-bit hash that DuckDB lacks or an iterative
method; their tests compare them with plain Python.
"""

from __future__ import annotations

from millrace.llm import chat, line_rules
from millrace.llm.queries import ESCAPE_TEST

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escaped(x: str) -> str:
    for plain, stands in chat.ESCAPES:
        x = f"replace({x}, {_q(plain)}, {_q(stands)})"
    return x


def _words(x: str) -> str:
    parts = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"regexp_extract_all(translate(coalesce({x}, ''), '{UPPER}', '{LOWER}'), '{parts}')"


_ORDER = "ORDER BY turn, role, text"
_LABELS = f"string_split_regex(l, {_q(line_rules.BARS)})"
_BARE = f"rtrim({_LABELS}[-1], ' .')"
_LEAST = line_rules.LEAST_LABELS
_FAILS = " OR ".join(
    [
        f"""(len({_LABELS}) >= {_LEAST}
             AND len([x for x in {_LABELS}[:-2] if length(x) NOT BETWEEN 1 AND {line_rules.LONGEST_LABEL}]) = 0
             AND ((length({_LABELS}[-1]) > 0 AND length({_BARE}) <= {line_rules.LONGEST_LABEL})
                  OR (len({_LABELS}) > {_LEAST} AND {_BARE} = '')))""",
        *[f"len(regexp_extract_all(l, {_q(p)})) >= {line_rules.MOST_NOISE}" for p in line_rules.NOISE],
        *[f"contains(lower(l), {_q(p)})" for p in line_rules.BOILERPLATE],
    ]
)
_BLANK = r"[\x20\x09-\x0D]"

_VALUE = "[A-Za-z0-9+/_.=-]+"
_SIGN = r"""["']?\x20*[:=]\x20*["']?"""


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_FINITE = "embedding IS NOT NULL AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0"

#: Kinds of secrets in their order: pattern, what of a match is measured, and its least length.
_ASSIGN = "(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + f"){_SIGN}({_VALUE})"
_BASE = {
    "assign": (_ASSIGN, f"length(regexp_extract(m[i], {_q(_ASSIGN)}, 2))", 8),
    "access": ("AKIA[A-Z0-9]+", "length(m[i])", 16),
    "hex": ("[0-9a-f]+", "length(m[i])", 32),
}
_SECRETS = _BASE | {
    "private_key": (r"-----BEGIN ([A-Z]+ )?PRIVATE KEY-----", "1", 0),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", "1", 0),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", "1", 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "1", 0),
}


def _secret_spans(place: int, kind: str) -> str:
    """All spans of one kind: what lies before a match are the parts and the matches before it."""
    pattern, measured, least = _SECRETS[kind]
    sums = "coalesce(list_sum([length(x) for x in s[1:i]]), 0) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0)"
    return f"""
        SELECT row, {place} AS place, {_q(kind)} AS kind, ({sums})::BIGINT AS a, ({sums} + length(m[i]))::BIGINT AS z
        FROM (SELECT row, regexp_extract_all(t, {_q(pattern)}) AS m, string_split_regex(t, {_q(pattern)}) AS s FROM d),
             unnest(range(1, len(m) + 1)) u(i) WHERE {measured} >= {least}"""


_JOINED = "coalesce(string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, place){}, '')"
_IS_BASE = f"FILTER (place < {len(_BASE)})"

SQL: dict[str, str] = {
    "op1_chat_format": f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', {_q(ESCAPE_TEST)}), (-7, 1, 'assistant', {_q(ESCAPE_TEST)}))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' {_ORDER})) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' {_ORDER}) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length({_escaped('role')}) + length({_escaped('text')})
                   + {len(chat.HEAD) + len(chat.OPEN) + len(chat.CLOSE)})::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op2_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
        b AS (SELECT item_id, {_words('text')} AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, w[i:i + 9] AS g FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) u(i)
                WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT len(g) AS n FROM win),
        runs AS (SELECT doc_id, n, i, w[i:i + n - 1] AS g FROM d, sizes, unnest(range(1, len(w) - n + 2)) u(i)),
        hits AS (SELECT doc_id, i, n, item_id FROM runs JOIN win USING (g)),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) u(p) GROUP BY 1),
        items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS digest
                  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op5_secrets": f"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
        f AS ({" UNION ALL ".join(_secret_spans(k, kind) for k, kind in enumerate(_SECRETS))})
        SELECT any_value(doc_id) AS doc_id,
               {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in _BASE)},
               sha256({_JOINED.format(" " + _IS_BASE)}) AS base_sha256, {_JOINED.format("")} AS spans
        FROM d LEFT JOIN f USING (row) GROUP BY row""",
    "op9_line_rules": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, t, regexp_extract_all(t, '[^{_BLANK[1:-1]}]+') AS w FROM d),
        tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + 2]) AS n
                FROM w, unnest(range(1, len(w) - 1)) u(i)),
        rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM tri, unnest([i, i + 1, i + 2]) u(p) WHERE n > 1 GROUP BY 1),
        spoken AS (SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
                   WHERE regexp_matches(l, '[^{_BLANK[1:-1]}]')),
        lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS dup,
                         coalesce(sum(length(regexp_replace(l, '{_BLANK}+', '', 'g'))) FILTER (NOT ({_FAILS})), 0) AS left_chars
                  FROM spoken GROUP BY 1),
        m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_BLANK}+', '', 'g'))::BIGINT AS word_chars,
                     len(regexp_extract_all(t, {_q(line_rules.SYMBOLS)}))::BIGINT AS n_symbols,
                     coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(left_chars, 0) AS left_chars
              FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
        f AS (SELECT *, n_words < {line_rules.LEAST_WORDS} OR 100 * n_repeat_words > {line_rules.MOST_REPEATED} * n_words AS base_failed
              FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND 1 - left_chars::DOUBLE / greatest(word_chars, 1)::DOUBLE <= {line_rules.MOST_LOST} AS kept
        FROM f""",
    "op11_hard_negatives": f"""
        WITH r AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   [CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) for c in embedding] AS x
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_FINITE}),
        p AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
                     CAST(list_sum([z[1] * z[2] for z in list_zip(a.x, b.x)]) AS BIGINT) AS score
              FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
        pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM p WHERE same
                QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT anchor_id, positive_id,
               CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
               id AS negative_id, positive_score, score AS negative_score
        FROM pos JOIN p USING (anchor_id)
        WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        QUALIFY rank <= 5""",
    "op12_embedding_groups": f"""
        WITH RECURSIVE u AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
            WHERE label IS NOT NULL AND {_FINITE} AND len([c for c in embedding if c <> 0]) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
              ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
              WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
        reach AS (SELECT vec_id AS v, vec_id AS w FROM embeddings
                  UNION SELECT v, b FROM reach JOIN l ON w = a),
        least AS (SELECT v AS vec_id, min(w) AS component_id FROM reach GROUP BY v),
        n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM least LEFT JOIN n USING (vec_id)""",
}

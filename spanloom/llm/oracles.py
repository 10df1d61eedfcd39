"""DuckDB SQL for the queries that SQL can express, over whole tables."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sets(table, key, words, k):
    """w: distinct (key, gram) of a table, a text of fewer than k words as one gram."""
    return f"""SELECT {key}, unnest(list_distinct(CASE WHEN len(w) = 0 THEN []
            WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) END)) AS gram
        FROM (SELECT {key}, {words} AS w FROM {table})"""


_PLAIN = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
_BLANK = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+')"

OP2 = f"""WITH i AS ({_sets('benchmark', 'item_id', _PLAIN, 5)}),
    whole AS (SELECT item_id, count(*) AS n, string_agg(gram, '|' ORDER BY gram) AS grams FROM i GROUP BY 1),
    one AS (SELECT min(item_id) AS item_id, count(*) AS n_items, any_value(n) AS n_shingles FROM whole GROUP BY grams),
    d AS ({_sets('documents', 'doc_id', _PLAIN, 5)}),
    met AS (SELECT doc_id, item_id, count(*) AS hits FROM d JOIN i USING (gram) JOIN one USING (item_id) GROUP BY 1, 2)
    SELECT doc_id, item_id, n_items, n_shingles, hits, round(hits / n_shingles, 6) AS containment
    FROM met JOIN one USING (item_id) WHERE 100 * hits >= 80 * n_shingles"""

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""
_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?"""


def _kind(name, rank, pattern, least, value="m"):
    """Matches of one kind with their offsets: what stands before a match is its share of the split text plus the matches before."""
    return f"""SELECT doc_id, {rank} AS rank, '{name}' AS kind, m, s, s + length(m) AS e, {value} AS value FROM (
        SELECT doc_id, ms[i] AS m, list_sum(list_transform(parts[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda p: length(p))), 0) AS s
        FROM (SELECT doc_id, ms, parts, unnest(range(1, len(ms) + 1)) AS i FROM (
            SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS parts FROM documents WHERE regexp_matches(text, '{pattern}'))))
        WHERE length({value}) >= {least}"""


def _live(v):
    chars = f"string_split({v}, '')"
    return (f"length({v}) >= 12 AND list_sum(list_transform(list_distinct({chars}), lambda c: -(len(list_filter({chars}, lambda x: x = c)) / length({v})) * log2(len(list_filter({chars}, lambda x: x = c)) / length({v})))) >= 2.5"
            f" AND NOT regexp_matches(lower({v}), 'example|sample|changeme|placeholder|your_|xxxx|dummy')")


_ADDED = [("forge", "gh[pousr]_[A-Za-z0-9]{36,}"), ("bearer", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), ("private", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")]
_KINDS = " UNION ALL ".join([
    _kind("assign", 0, _ASSIGN, 8, f"regexp_replace(m, '{_VALUE}', '')"), _kind("access", 1, "AKIA[A-Z0-9]+", 16), _kind("hex", 2, "[0-9a-f]{32,}", 32),
    *(_kind(n, r, p, 1) for r, (n, p) in enumerate(_ADDED, 3))])

OP5 = f"""WITH k AS ({_KINDS}),
    o AS (SELECT value, count(DISTINCT split_part(coalesce(source, ''), '/', 1)) AS owners FROM k JOIN documents USING (doc_id) GROUP BY 1),
    j AS (SELECT k.*, CASE WHEN owners >= 3 THEN 'example' WHEN {_live('value')} THEN 'live' ELSE 'weak' END AS verdict FROM k JOIN o USING (value)),
    g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans,
        count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example FROM j GROUP BY 1)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
        coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM documents LEFT JOIN g USING (doc_id)"""

OP8 = f"""WITH RECURSIVE d AS ({_sets('documents', 'doc_id', _BLANK, 3)}),
    n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM d x JOIN d y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
    m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)"""

OP9 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
    k AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
    SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5"""


def _least(*options):
    """The least of structs (cost, edits, text), those that are not there left out."""
    return f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"


def _after(state, letters, cost, line="NULL"):
    """A state's struct after an edit: its cost, its letters, and a line of the repaired text."""
    text = f"{state}.o" if line == "NULL" else f"CASE WHEN {state}.o IS NULL THEN {line} ELSE {state}.o || chr(10) || {line} END"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letters}', 'o': {text}}} END"


def _open(where):
    """Where inserts lead from the four states: an open user row (ku), a closed pair (ka)."""
    one = lambda s, who: _after(s, "I", 3, f"'{who}:'")
    return f"""SELECT *, {_least("qu", one("q0", "user"), one("qs", "user"), one("qa", "user"))} AS ku, {_least("qa", one("qu", "assistant"), one("pu", "assistant"))} AS ka
        FROM (SELECT *, {_least(one("q0", "user"), one("qs", "user"))} AS pu FROM {where})"""


def _kept(state, cond):
    stays = _after(state, "K", "(CASE fault WHEN 'truncated' THEN 3 ELSE 0 END)", "role || ':' || text")
    return f"CASE WHEN {cond} AND fault NOT IN ('blank', 'duplicate') THEN {stays} END"


def _reroled(state, who):
    other = _after(state, "R", "(CASE fault WHEN 'truncated' THEN 6 ELSE 3 END)", f"'{who}:' || text")
    return f"CASE WHEN left(role, 1) <> '{who[0]}' AND fault NOT IN ('blank', 'duplicate') THEN {other} END"


_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({}, ''), lambda c: ascii(c)::BIGINT)), lambda crc, byte:
        list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
_STRUCT = "STRUCT(c BIGINT, a VARCHAR, o VARCHAR)"

OP11 = f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS act FROM conversations),
    d AS (SELECT conv_id, turn, CASE act WHEN 4 THEN 'user' ELSE role END AS role,
        CASE act WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE act WHEN 3 THEN 2 ELSE 1 END)) FROM k WHERE act <> 0),
    f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS again FROM d),
    n AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i,
        lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS before,
        CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again > 1 THEN 'duplicate'
            WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault FROM f),
    v AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'o': NULL::VARCHAR}} AS q0, NULL::{_STRUCT} AS qs, NULL::{_STRUCT} AS qu, NULL::{_STRUCT} AS qa
            FROM (SELECT DISTINCT conv_id FROM n)
        UNION ALL
        SELECT conv_id, i, {_after("q0", "D", 4)}, {_least(_after("qs", "D", 4), _kept("q0", "left(role, 1) = 's'"))},
            {_least(_after("ku", "D", 4), *[_kept(q, "left(role, 1) = 'u'") for q in ("q0", "qs", "ka")], *[_reroled(q, "user") for q in ("q0", "qs", "ka")])},
            {_least(_after("ka", "D", 4), _kept("ku", "left(role, 1) = 'a'"), _reroled("ku", "assistant"))}
            FROM ({_open("(SELECT v.conv_id, n.i, n.role, n.text, n.fault, q0, qs, qu, qa FROM v JOIN n ON n.conv_id IS NOT DISTINCT FROM v.conv_id AND n.i = v.i + 1)")})),
    e AS (SELECT conv_id, {_least("q0", "ka")} AS best FROM ({_open("(SELECT * FROM v QUALIFY i = max(i) OVER (PARTITION BY conv_id))")})),
    c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (i > 1 AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM n GROUP BY 1)
    SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
        coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.o, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id"""

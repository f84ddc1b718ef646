"""SQL for DuckDB that gives the same rows as the queries of problems 1, 4, 5 and 7 by comparing everything with everything.

Problems 2, 3, 6 and 8 have none: trained models, transducers over offsets and packings are no SQL.
"""

from __future__ import annotations

from tessera.llm import canonical as C
from tessera.llm.leakage import MIN_CHARACTERS, MIN_WORDS, SHARE
from tessera.llm.tokens import CLIP_CHARS, CLIP_HEAD, CLIP_MIDDLE, CLIP_TAIL, MAX_TOKENS, STOP


def _re(pattern: str) -> str:
    """A pattern as a literal for an engine that never backtracks and so knows no possessive quantifiers."""
    return "'" + pattern.replace("*+", "*").replace("++", "+").replace("'", "''") + "'"


def _letters(c: str) -> str:
    return rf"replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', '', 'g'), 'ß', 'ss')"


def canonical(table: str, key: str, text: str, name: str) -> str:
    """CTEs that end with `name` (key, c): the canonical text of each row that has one."""
    looks = r"^[\s\p{Z}]*(?:[{|]|-{3}|[\p{L}_][\p{L}\p{N}_ ]{0,40}[\s\p{Z}]*[:：=])"
    return (
        rf"{name}_b AS (SELECT {key}, {text} AS t, trim(regexp_replace(regexp_replace({text}, {_re(C.FENCE)}, '', 'g'), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) AS body FROM {table} WHERE {text} IS NOT NULL),"
        rf" {name}_p AS (SELECT {key}, t, list_filter(CASE WHEN starts_with(body, '{{') AND regexp_matches(body, {_re(C.JSON_TEXT)}) THEN list_transform(regexp_extract_all(body, {_re(C.JSON_PAIR)}), lambda p: regexp_replace(p, {_re(C.JSON_ESCAPE)}, ' ', 'g'))"
        rf" WHEN contains(body, chr(10)) THEN string_split_regex(body, '\s*\n\s*') ELSE string_split_regex(body, '\s*[;；]\s*') END, lambda p: trim(p) <> '') AS parts FROM {name}_b),"
        rf" {name} AS (SELECT {key}, CASE WHEN regexp_matches(t, {_re(looks)}) AND len(parts) >= {C.MIN_FIELDS} AND len(list_filter(parts, lambda p: NOT regexp_matches(p, {_re(C.FIELD)}))) = 0"
        rf" THEN 'R' || array_to_string(list_sort(list_transform(parts, lambda p: {_letters(f'regexp_extract(p, {_re(C.FIELD)}, 1)')} || chr(31) || {_letters(f'regexp_extract(p, {_re(C.FIELD)}, 2)')})), chr(30))"
        rf" WHEN {_letters('t')} = '' THEN 'X' || t ELSE 'P' || {_letters('t')} END AS c FROM {name}_p)"
    )


def token_rows(table: str, key: str, text: str, name: str) -> str:
    """CTEs that end with `name` (key, n, token): the distinct tokens of each row, and how many there are."""
    clip = (
        f"CASE WHEN length({text}) <= {CLIP_CHARS} THEN {text} ELSE substr({text}, 1, {CLIP_HEAD}) || chr(10) || substr({text},"
        f" CAST(floor((length({text}) - {CLIP_MIDDLE}) / 2) AS INT) + 1, {CLIP_MIDDLE}) || chr(10) || right({text}, {CLIP_TAIL}) END"
    )
    stop = ", ".join(f"'{c}'" for c in sorted(STOP))
    return (
        rf"{name}_l AS (SELECT {key}, list_distinct(list_slice(list_filter(flatten(list_transform(regexp_extract_all(lower({clip}), '[\p{{L}}\p{{N}}_]+'), lambda w:"
        rf" CASE WHEN regexp_full_match(w, '[一-鿿]+') THEN list_filter(string_split(w, ''), lambda t: t NOT IN ({stop})) ELSE [w] END)), lambda t: t <> ''), 1, {MAX_TOKENS})) AS tk FROM {table} WHERE {text} IS NOT NULL),"
        f" {name} AS (SELECT {key}, len(tk) AS n, unnest(tk) AS token FROM {name}_l)"
    )


_NODES = canonical("nodes", "id", "text", "cn") + ", " + token_rows("nodes", "id", "text", "tn")
_PAIRS = (
    "sp AS (SELECT a.id AS a, b.id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM tn a JOIN tn b ON a.token = b.token AND a.id < b.id AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4 GROUP BY a.id, b.id),"
    " pairs AS (SELECT a, b FROM sp JOIN cn x ON x.id = a JOIN cn y ON y.id = b WHERE shared * 5 >= (na + nb - shared) * 4 AND x.c <> y.c)"
)
_FOUND = (
    f"WITH {_NODES}, {canonical('pending', 'id', 'content', 'cp')}, {token_rows('pending', 'id', 'content', 'tp')}, sp AS (SELECT p.id AS pending_id, b.id AS node_id, count(*) AS shared, any_value(p.n) AS np, any_value(b.n) AS nb FROM tp p JOIN tn b"
    " ON p.token = b.token AND p.n * 5 >= b.n * 4 AND b.n * 5 >= p.n * 4 GROUP BY p.id, b.id), hit AS (SELECT pending_id, node_id FROM sp WHERE shared * 5 >= (np + nb - shared) * 4 UNION ALL SELECT cp.id, cn.id FROM cp JOIN cn USING (c))"
    " SELECT pending_id, min(node_id) AS node_id FROM hit JOIN pending ON pending.id = pending_id WHERE trim(content) <> '' GROUP BY pending_id"
)
_GROUPS = (
    f"WITH RECURSIVE {_NODES}, {_PAIRS}, cls AS (SELECT id, min(id) OVER (PARTITION BY c) AS copy_class FROM cn UNION ALL SELECT id, id FROM nodes WHERE text IS NULL),"
    " lk AS (SELECT DISTINCT x.copy_class AS u, y.copy_class AS v FROM pairs JOIN cls x ON x.id = a JOIN cls y ON y.id = b), both_ways AS (SELECT u, v FROM lk UNION SELECT v, u FROM lk),"
    " reach AS (SELECT DISTINCT u, u AS v FROM both_ways UNION SELECT r.u, e.v FROM reach r JOIN both_ways e ON e.u = r.v), root AS (SELECT u, min(v) AS g FROM reach GROUP BY u), deg AS (SELECT u, count(DISTINCT v) AS links FROM both_ways GROUP BY u)"
    " SELECT id, copy_class, coalesce(g, copy_class) AS group_id, coalesce(links, 0) AS links FROM cls LEFT JOIN root ON root.u = copy_class LEFT JOIN deg ON deg.u = copy_class"
)

_CJK = "[㐀-鿿぀-ヿ豈-﫿]"


def _units(table: str, key: str) -> str:
    return rf"(SELECT {key}, regexp_extract_all(regexp_replace(lower(text), '({_CJK})', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+') AS u FROM {table} WHERE text IS NOT NULL)"


def _windows(table: str, key: str, size: str) -> str:
    """(key, pos, w): each run of `size` units."""
    return f"(SELECT {key}, pos, array_to_string(list_slice(u, pos, pos + {size} - 1), ' ') AS w FROM (SELECT {key}, u, unnest(range(1, len(u) - {size} + 2)) AS pos FROM {table} WHERE len(u) >= {size}))"


_LEAKS = (
    f"WITH it AS (SELECT item_id, u, len(u) AS units, CASE WHEN len(list_filter(u, lambda x: regexp_full_match(x, '{_CJK}'))) * 2 > len(u) THEN {MIN_CHARACTERS} ELSE {MIN_WORDS} END AS least FROM {_units('eval_items', 'item_id')}), du AS {_units('documents', 'doc_id')},"
    + "".join(
        f" i{n} AS (SELECT * FROM it WHERE least = {n}), iw{n} AS {_windows(f'i{n}', 'item_id', str(n))}, dw{n} AS (SELECT DISTINCT doc_id, w FROM {_windows('du', 'doc_id', str(n))} WHERE w IN (SELECT w FROM iw{n})),"
        f" h{n} AS (SELECT doc_id, item_id, unnest(range(pos, pos + {n})) AS place FROM dw{n} JOIN iw{n} USING (w)),"
        for n in (MIN_WORDS, MIN_CHARACTERS)
    )
    + f" hits AS (SELECT * FROM h{MIN_WORDS} UNION ALL SELECT * FROM h{MIN_CHARACTERS}), cov AS (SELECT doc_id, item_id, count(DISTINCT place) AS matched FROM hits GROUP BY ALL)"
    f" SELECT doc_id, item_id, matched::INT AS matched, units::INT AS units FROM cov JOIN it USING (item_id) WHERE matched * {SHARE[1]} >= units * {SHARE[0]}"
)

ORACLE_SQL = {
    "p1_found": _FOUND,
    "p4_found": f"WITH {canonical('nodes', 'id', 'text', 'cn')} SELECT node_id, id AS copy_id FROM (SELECT id, min(id) OVER (PARTITION BY c) AS node_id FROM cn) WHERE id <> node_id",
    "p4_ledger": f"WITH {canonical('nodes', 'id', 'text', 'cn')} SELECT min(id) AS node_id, count(*) AS copies FROM cn GROUP BY c",
    "p5_found": f"WITH {_NODES}, {_PAIRS} SELECT a AS id_a, b AS id_b FROM pairs",
    "p5_groups": _GROUPS,
    "p7_found": f"SELECT doc_id, item_id FROM ({_LEAKS})",
    # In these tables no passage of an item is repeated in it, so that the tiles hold what the union of the matches does.
    "p7_coverage": _LEAKS,
}

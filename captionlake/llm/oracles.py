"""SQL for DuckDB of the divergence audit and of conversation repair."""

from __future__ import annotations

SOURCE_DIVERGENCE = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
 c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS dd FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
 k AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS l FROM c GROUP BY ALL HAVING sum(dd) >= 3),
 v AS (SELECT lang, count(*) AS v, CAST(sum(l) AS BIGINT) AS nl FROM k GROUP BY lang),
 own AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS n FROM c SEMI JOIN k USING (lang, term) GROUP BY ALL),
 g AS (SELECT x.lang, x.source, v, nl, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN v USING (lang) LEFT JOIN own USING (lang, source)),
 p AS (SELECT g.lang, g.source, term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.n + v) AS p, 1 + (1000000000 * (l + 1)) // (nl + v) AS q FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
 s AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
 z AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM o)
 SELECT lang, source, part, item, value, rank FROM z WHERE part = 'pair' OR rank <= 200"""


def _added(states: str, edit: str, cost: str, said: str) -> str:
    """A list of states after one more edit; said: the repaired line, if there is one."""
    line = f"x.r || CASE WHEN x.r = '' THEN '' ELSE chr(10) END || {said}" if said else "x.r"
    return f"list_transform(list_filter({states}, lambda x: x.c IS NOT NULL), lambda x: {{'c': x.c + {cost}, 'a': x.a || '{edit}', 'r': {line}}})"


_NONE = "{'c': CAST(NULL AS INT), 'a': CAST(NULL AS VARCHAR), 'r': CAST(NULL AS VARCHAR)}"
_FIRST = "{'c': 0, 'a': '', 'r': ''}"
_USER, _ASSISTANT = "'user:'", "'assistant:'"
_1 = _added("[s0, s1, s3]", "I", "3", _USER)  # one turn inserted, the user speaks
_2 = _added("[s2]", "I", "3", _ASSISTANT)
_11 = _added("i2", "I", "3", _ASSISTANT)  # two inserted, the assistant speaks
_22 = _added("i3", "I", "3", _USER)
_CUT = "CASE WHEN fault = 3 THEN 3 ELSE 0 END"


def _step(deleted: str, kept_from: str, initial: str, name: str) -> str:
    out = [_added(deleted, "D", "4", "")]
    if kept_from:
        live = f"CASE WHEN fault IN (0, 3) THEN {kept_from} ELSE [] END"
        out.append(_added(f"CASE WHEN fault IN (0, 3) AND c = '{initial}' THEN {kept_from} ELSE [] END", "K", _CUT, "role || ':' || text"))
        if name:
            out.append(_added(live, "R", f"3 + {_CUT}", f"'{name}:' || text"))
    whole = out[0]
    for x in out[1:]:
        whole = f"list_concat({whole}, {x})"
    return f"coalesce(list_sort({whole})[1], {_NONE})"


CONVERSATION_REPAIR = rf"""WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
 crc AS (SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda s, b: list_reduce(list_concat([xor(s, b)], range(8)), lambda z, i: xor(z >> 1, (z & 1) * 3988292384))), 4294967295) % 20 AS hit FROM named),
 rows AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM crc),
 numbered AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS z FROM rows),
 turns AS (SELECT *, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
  CASE WHEN z = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN z NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM numbered),
 search AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {_FIRST} AS s0, {_NONE} AS s1, {_NONE} AS s2, {_NONE} AS s3 FROM turns
  UNION ALL SELECT conv_id, i, {_step("[s0]", "", "", "")}, {_step("[s1]", "[s0]", "s", "")}, {_step("y2", "list_concat([s0, s1], y3)", "u", "user")}, {_step("y3", "y2", "a", "assistant")} FROM (
   SELECT *, list_concat(list_concat([s2], i2), {_22}) AS y2, list_concat(list_concat([s3], i3), {_11}) AS y3 FROM (
    SELECT t.*, s0, s1, s2, s3, {_1} AS i2, {_2} AS i3 FROM search JOIN turns t ON t.conv_id IS NOT DISTINCT FROM search.conv_id AND t.i = search.i + 1))),
 ends AS (SELECT conv_id, list_sort(list_concat(list_filter([s0, s3], lambda x: x.c IS NOT NULL), list_concat({_2}, {_added(_added("[s1]", "I", "3", _USER), "I", "3", _ASSISTANT)})))[1] AS s
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS last FROM search) WHERE last = 1),
 sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id)
 SELECT d.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(s.c, 0) AS BIGINT) AS cost, coalesce(s.a, '') AS audit, sha256(coalesce(s.r, '')) AS repaired_sha256
 FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM d.conv_id"""

"""DuckDB SQL for op13: the same rows by dynamic programming over turns, backwards, for the four states of the grammar.

A value is a cost of nine digits with the audit behind it, so the least of values is the cheapest, then the least audit.
"""

from __future__ import annotations

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: The state after a user's or an assistant's turn that is put in, counted from 1.
_NEXT = (3, 3, 4, 3)
_KEPT = {"s": (2, None, None, None), "u": (3, 3, None, 3), "a": (None, None, 4, None)}


def _more(value: str, cost: str, letters: str) -> str:
    return f"lpad(CAST(CAST(substr({value}, 1, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || '{letters}' || substr({value}, 10)"


def _turn(q: int) -> str:
    """What a turn x (role's initial, fault) makes of the values v for a state."""
    cut = "CASE WHEN x[2] = 't' THEN 1 ELSE 0 END"
    kept = " ".join(f"WHEN x[1] = '{i}' THEN {_more(f'v[{to[q]}]', cut, 'K')}" for i, to in _KEPT.items() if to[q])
    keep = f"CASE WHEN x[2] IN ('b', 'd') THEN NULL {kept} END"
    other = f"CASE WHEN x[2] NOT IN ('b', 'd') THEN {_more(f'v[{_NEXT[q]}]', f'2 + {cut}', 'R')} END"
    return f"least({_more(f'v[{q + 1}]', '3', 'D')}, {keep}, {other})"


def _insert(q: int) -> str:
    one = _NEXT[q]
    return f"least(w[{q + 1}], {_more(f'w[{one}]', '2', 'I')}, {_more(f'w[{_NEXT[one - 1]}]', '4', 'II')})"


_STEP = f"list_transform([[{', '.join(map(_turn, range(4)))}]], lambda w: [{', '.join(map(_insert, range(4)))}])[1]"

OP13_SQL = f"""
WITH bits AS (
  SELECT list_transform(range(0, 256), lambda n: list_reduce(range(0, 8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END, n)) AS tab
), k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295)) % 20 AS kind
  FROM conversations, bits
), d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM k WHERE kind <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS r, rtrim(text, {_WHITE}) AS seen, left(role, 1) AS i FROM d
), f AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) AS n, lag(i) OVER (PARTITION BY conv_id ORDER BY r) AS before FROM o
), g AS (
  SELECT *, CASE WHEN seen = '' THEN 'b' WHEN n > 1 THEN 'd' WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM f
), c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (r > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal,
    list([i, fault] ORDER BY r DESC) AS back, list(role ORDER BY r) AS roles, list(text ORDER BY r) AS texts
  FROM g GROUP BY conv_id
), p AS (
  SELECT *, list_reduce(back, lambda v, x: {_STEP}, ['000000000', '000000004II', '000000002I', '000000000'])[1] AS best FROM c
), a AS (
  SELECT *, CAST(substr(best, 1, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM p
), e AS (
  SELECT *, CASE WHEN audit = '' THEN '' ELSE list_reduce(list_transform(string_split(audit, ''), lambda l: [l]),
    lambda s, x: CASE x[1] WHEN 'D' THEN [s[1], CAST(CAST(s[2] AS INTEGER) + 1 AS VARCHAR), s[3]]
      WHEN 'K' THEN [left(roles[CAST(s[2] AS INTEGER)], 1), CAST(CAST(s[2] AS INTEGER) + 1 AS VARCHAR), s[3] || chr(10) || roles[CAST(s[2] AS INTEGER)] || ':' || texts[CAST(s[2] AS INTEGER)]]
      WHEN 'R' THEN [CASE s[1] WHEN 'u' THEN 'a' ELSE 'u' END, CAST(CAST(s[2] AS INTEGER) + 1 AS VARCHAR), s[3] || chr(10) || CASE s[1] WHEN 'u' THEN 'assistant:' ELSE 'user:' END || texts[CAST(s[2] AS INTEGER)]]
      ELSE [CASE s[1] WHEN 'u' THEN 'a' ELSE 'u' END, s[2], s[3] || chr(10) || CASE s[1] WHEN 'u' THEN 'assistant:' ELSE 'user:' END] END,
    ['', '1', ''])[3] END AS lines
  FROM a
), ids AS (
  SELECT DISTINCT conv_id FROM conversations
)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(substr(lines, 2), '')) AS repaired_sha256
FROM ids LEFT JOIN e ON ids.conv_id IS NOT DISTINCT FROM e.conv_id
"""

"""SQL of queries whose statement is long."""

from __future__ import annotations

OP11_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
lows AS (SELECT text, min(doc_id) AS low FROM texts GROUP BY text),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
said AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts),
failed AS (
  SELECT part, CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > low THEN 'E' ELSE '' END AS cell,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM said JOIN lows USING (text) LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, cell, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, cell),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS filter, substr(filter_order, 1, step - 1) AS earlier FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
met AS (SELECT *, contains(cell, filter) AS fails, length(translate(earlier, cell, '')) < length(earlier) AS gone FROM cells, steps),
figures AS (
  SELECT part, filter_order, step, filter,
         coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (cell = filter), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM met GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM figures
"""

#: CRC-32 of ASCII text: the register takes a byte, then shifts eight times.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}, ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda acc, e: CASE WHEN e >= 0 THEN xor(acc, e) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END))"""


def _after(row: str, edit: str, cost: str, best: str) -> str:
    """The best end `best`, preceded by an edit that leaves `row` (or nothing)."""
    return f"{{'c': {best}.c + {cost}, 'a': '{edit}' || {best}.a, 't': {f'list_prepend({row}, {best}.t)' if row else f'{best}.t'}}}"


def _row(state: int, keep: dict[str, int]) -> str:
    """The best that can be done with a row in a state: delete, give it the next role, or keep it."""
    follows, role = (3, "assistant") if state == 2 else (2, "user")
    options = [_after("", "D", "4", f"b{state}"), f"CASE WHEN NOT gone THEN {_after(f"'{role}:' || text", 'R', '3 + extra', f'b{follows}')} END"]
    options += [f"CASE WHEN NOT gone AND initial = '{i}' THEN {_after("role || ':' || text", 'K', 'extra', f'b{to}')} END" for i, to in keep.items()]
    return f"list_min([{', '.join(options)}])"


OP12_SQL = f"""
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
hit AS (SELECT n.*, hit FROM named n JOIN (SELECT name, ({_CRC.format("name")}) % 20 AS hit FROM (SELECT DISTINCT name FROM named)) USING (name)),
left_over AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit WHERE hit <> 0 UNION ALL SELECT conv_id, turn, role, text FROM hit WHERE hit = 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, substr(role, 1, 1) AS initial FROM left_over),
judged AS (
  SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed),
rows_ AS (SELECT conv_id, i, role, text, initial, blank OR again AS gone, CASE WHEN cut THEN 3 ELSE 0 END AS extra FROM judged),
totals AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
path AS (
  SELECT conv_id, n + 1 AS i, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS b0, {{'c': 6, 'a': 'II', 't': ['user:', 'assistant:']}} AS b1,
         {{'c': 3, 'a': 'I', 't': ['assistant:']}} AS b2, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS b3
  FROM totals
  UNION ALL
  SELECT conv_id, i, list_min([r0, {_after("'user:'", "I", "3", "b2")}]), list_min([r1, {_after("'user:'", "I", "3", "b2")}]), b2, b3
  FROM (SELECT conv_id, i, r0, r1, list_min([r2, {_after("'assistant:'", "I", "3", "r3")}]) AS b2, list_min([r3, {_after("'user:'", "I", "3", "r2")}]) AS b3
        FROM (SELECT r.conv_id, r.i, {_row(0, {"s": 1, "u": 2})} AS r0, {_row(1, {"u": 2})} AS r1, {_row(2, {"a": 3})} AS r2, {_row(3, {"u": 2})} AS r3
              FROM path JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM path.conv_id AND r.i = path.i - 1)))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(b0.c, 0)::BIGINT AS cost, coalesce(b0.a, '') AS audit, sha256(coalesce(array_to_string(b0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN totals t ON o.conv_id IS NOT DISTINCT FROM t.conv_id
LEFT JOIN path p ON o.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = 1
"""

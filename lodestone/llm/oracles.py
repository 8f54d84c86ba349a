"""SQL of the queries on phrases and conversations; long, so it lies apart from the queries."""

from __future__ import annotations

#: crc32 of an ASCII string, a byte at a time over the table that the polynomial gives.
CRC_TABLE = """
t AS (SELECT list(c ORDER BY n) AS v FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n)))"""


def crc32(text: str, table: str) -> str:
    each = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {each}), lambda c, b: xor(c >> 8, {table}[xor(c & 255, b) + 1])), 4294967295)"


def _edits() -> str:
    """All macro edits of up to two inserts before a row: state, initial, whether the row has to go, edits, cost, state after, inserted lines, what becomes of the row."""
    follows = {0: 2, 1: 2, 2: 3, 3: 2}
    rows = []
    for state in range(4):
        for initial in ("s", "u", "a", ""):
            for inserts in range(3):
                at, lines = state, []
                for _ in range(inserts):
                    lines.append("assistant:" if at == 2 else "user:")
                    at = follows[at]
                said = "[" + ", ".join(f"'{x}'" for x in lines) + "]::VARCHAR[]"
                head = f"({state}, '{initial}', '{'I' * inserts}"
                rows.append(f"{head}D', {3 + 2 * inserts}, {at}, {said}, '')")
                keep = 1 if initial == "s" and at == 0 else 2 if initial == "u" and at != 2 else 3 if initial == "a" and at == 2 else None
                if keep:
                    rows.append(f"{head}K', {2 * inserts}, {keep}, {said}, 'K')")
                rows.append(f"{head}R', {2 + 2 * inserts}, {follows[at]}, {said}, '{'assistant' if at == 2 else 'user'}')")
    return ", ".join(rows)


CONVERSATIONS = f"""
WITH RECURSIVE {CRC_TABLE},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
z AS (SELECT k.*, {crc32("name", "v")} % 20 AS f FROM k, t),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM z WHERE f <> 0),
r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM d),
q AS (SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '' END AS ini, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
             right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') AS cut, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS prior FROM r),
e(s, ini, edit, cost, s2, lines, fate) AS (VALUES {_edits()}),
p AS (SELECT conv_id, CAST(0 AS BIGINT) AS pos, 0 AS s, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': []::VARCHAR[]}} AS best FROM (SELECT DISTINCT conv_id FROM q)
      UNION ALL
      SELECT q.conv_id, q.pos, e.s2, min({{'cost': p.best.cost + e.cost + CASE WHEN e.fate <> '' AND q.cut THEN 1 ELSE 0 END, 'audit': p.best.audit || e.edit,
                 'lines': list_concat(list_concat(p.best.lines, e.lines), CASE e.fate WHEN '' THEN []::VARCHAR[] WHEN 'K' THEN [q.role || ':' || q.text] ELSE [e.fate || ':' || q.text] END)}})
      FROM p JOIN q ON q.conv_id IS NOT DISTINCT FROM p.conv_id AND q.pos = p.pos + 1 JOIN e ON e.s = p.s AND e.ini = q.ini WHERE e.fate = '' OR NOT (q.blank OR q.again) GROUP BY q.conv_id, q.pos, e.s2),
n AS (SELECT conv_id, max(pos) AS pos, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
             count(*) FILTER (WHERE cut AND NOT blank AND NOT again) AS truncated, count(*) FILTER (WHERE prior IS NOT NULL AND prior || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM q GROUP BY conv_id),
c(s, edit, cost, lines) AS (VALUES (0, '', 0, []::VARCHAR[]), (1, 'II', 4, ['user:', 'assistant:']), (2, 'I', 2, ['assistant:']), (3, '', 0, []::VARCHAR[])),
b AS (SELECT n.conv_id, min({{'cost': p.best.cost + c.cost, 'audit': p.best.audit || c.edit, 'lines': list_concat(p.best.lines, c.lines)}}) AS best FROM n JOIN p ON p.conv_id IS NOT DISTINCT FROM n.conv_id AND p.pos = n.pos JOIN c USING (s) GROUP BY n.conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(b.best.cost, 0) AS BIGINT) AS cost, coalesce(b.best.audit, '') AS audit, sha256(coalesce(array_to_string(b.best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM o.conv_id"""

#: Phrases are strings of words with one space between; words hold none.
PHRASES = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') AS ws
           FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
u AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM p, range(1, 5) x(k)),
f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, count(*) AS a FROM u GROUP BY lang, k, phrase HAVING count(*) >= 30),
h AS (SELECT lang, k, phrase, a, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:], ' ') AS tail FROM f, range(1, 4) x(j) WHERE j < k),
c AS (SELECT h.lang, h.phrase, h.a, min({'score': CAST(CAST(2000000 AS HUGEINT) * h.a // (l.a + r.a) AS BIGINT), 'j': j, 'l': l.a, 'r': r.a}) AS cut
      FROM h JOIN f l ON l.lang = h.lang AND l.phrase = h.head JOIN f r ON r.lang = h.lang AND r.phrase = h.tail GROUP BY h.lang, h.phrase, h.a),
longer AS (SELECT lang, array_to_string(ws[i:j], ' ') AS phrase, max(a) AS a FROM f, range(1, 5) x(i), range(2, 5) y(j) WHERE i < j AND j <= k AND j - i + 1 < k GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN longer o ON o.lang = c.lang AND o.phrase = c.phrase WHERE o.a IS NULL OR 100 * o.a < 80 * c.a),
s AS (SELECT lang, phrase, a, cut, row_number() OVER (PARTITION BY lang ORDER BY cut.score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT s.lang, CAST(rank AS BIGINT) AS rank, phrase, a, s.cut.l AS l, s.cut.r AS r, n, s.cut.score AS score FROM s JOIN n USING (lang) WHERE rank <= 2000"""

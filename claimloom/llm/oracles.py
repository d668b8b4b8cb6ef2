"""SQL of the queries on conversations, for an engine that has lists, recursion and SHA-256."""


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit: a step takes up a character, eight more shift it through."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    shift = "lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), {shift}), 4294967295)"


OP12_TRIES = f"""
WITH told AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS said FROM told GROUP BY conv_id),
shared AS (
  SELECT *, {crc32_sql("conv_id::VARCHAR")} % 6 AS h FROM convs),
whole AS (
  SELECT s.conv_id, coalesce(b.said[1:s.h], []) || s.said[s.h + 1:] AS said
  FROM shared s LEFT JOIN convs b ON b.conv_id = s.conv_id - s.conv_id % 100),
prefix AS (
  SELECT conv_id, len(said) AS size, unnest(range(len(said) + 1)) AS depth, said FROM whole),
members AS (
  SELECT conv_id, depth, size, said[1:depth] AS node FROM prefix),
nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(length(node[-1].text), 0) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
  FROM members GROUP BY node, depth),
under AS (SELECT node[1:depth - 1] AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
known AS (SELECT n.*, coalesce(u.n_children, 0) AS n_children FROM nodes n LEFT JOIN under u ON u.depth = n.depth AND u.node = n.node),
up AS (SELECT node, depth, saved, n_children, unnest(range(depth + 1)) AS d FROM known),
sums AS (SELECT node[1:d] AS node, d AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY ALL)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM known k JOIN sums s ON s.depth = k.depth AND s.node = k.node LEFT JOIN nodes p ON k.depth > 0 AND p.depth = k.depth - 1 AND p.node = k.node[1:k.depth - 1]"""

NEVER = 1_000_000_000


def _step(cost: str, audit: str) -> str:
    return f"{{'cost': {cost}, 'audit': {audit}}}"


def _kept(state: str, initial: str) -> str:
    return _step(f"{state}.cost + x.barred + CASE WHEN x.initial = '{initial}' THEN 0 ELSE 3 END", f"{state}.audit || CASE WHEN x.initial = '{initial}' THEN 'K' ELSE 'R' END")


def _gone(state: str) -> str:
    return _step(f"{state}.cost + 4", f"{state}.audit || 'D'")


def _put(state: str) -> str:
    return _step(f"{state}.cost + 3", f"{state}.audit || 'I'")


OP13_REPAIR = rf"""
WITH RECURSIVE clean AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM clean, (SELECT unnest([0, 1]) AS copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS rest FROM hurt),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY pos) || role[1:1] AS pair FROM placed),
marked AS (
  SELECT *, rest = '' AS blank, rest <> '' AND again AS duplicate, rest <> '' AND NOT again AND right(rest, 1) NOT IN ('.', '!', '?') AS truncated FROM seen),
flags AS (
  SELECT conv_id, pos, role, text, role[1:1] AS initial, CASE WHEN blank OR duplicate THEN {NEVER} WHEN truncated THEN 3 ELSE 0 END AS barred FROM marked),
folded AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, {_step("0::BIGINT", "''")} AS n, {_step(f"{NEVER}::BIGINT", "''")} AS s, {_step(f"{NEVER}::BIGINT", "''")} AS u, {_step(f"{NEVER}::BIGINT", "''")} AS a FROM hurt
  UNION ALL
  SELECT x.conv_id, x.pos, {_gone("f.n")}, least({_gone("f.s")}, {_step(f"f.n.cost + CASE WHEN x.initial = 's' THEN x.barred ELSE {NEVER} END", "f.n.audit || 'K'")}),
         least({_gone("f.u")}, {_gone("f.iu")}, {_kept("f.n", "u")}, {_kept("f.s", "u")}, {_kept("f.ia", "u")}),
         least({_gone("f.a")}, {_gone("f.ia")}, {_kept("f.iu", "a")})
  FROM (SELECT *, least(u, {_put("n")}, {_put("s")}, {_put("a")}) AS iu, least(a, {_put("u")}) AS ia FROM folded) f JOIN flags x ON x.conv_id IS NOT DISTINCT FROM f.conv_id AND x.pos = f.pos + 1),
best AS (
  SELECT conv_id, least(n, a, {_put("u")}) AS b FROM folded f WHERE pos = (SELECT max(pos) FROM flags x WHERE x.conv_id IS NOT DISTINCT FROM f.conv_id)),
edits AS (
  SELECT conv_id, unnest(string_split(b.audit, '')) AS edit, generate_subscripts(string_split(b.audit, ''), 1) AS k FROM best WHERE b.audit <> ''),
steps AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER w AS pos, count(*) FILTER (edit <> 'D') OVER w AS said FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
written AS (
  SELECT e.conv_id, e.k, e.edit, e.said, x.role, x.text, max(CASE WHEN e.edit = 'K' AND x.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS opens
  FROM steps e LEFT JOIN flags x ON e.edit <> 'I' AND x.conv_id IS NOT DISTINCT FROM e.conv_id AND x.pos = e.pos WHERE e.edit <> 'D'),
lines AS (
  SELECT conv_id, k, CASE WHEN edit = 'K' THEN role WHEN (said - opens) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END AS line FROM written),
made AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY k) AS lines FROM lines GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
       coalesce(b.b.cost, 0) AS cost, coalesce(b.b.audit, '') AS audit, sha256(coalesce(m.lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN made m ON m.conv_id IS NOT DISTINCT FROM o.conv_id"""

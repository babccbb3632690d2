"""SQL for the conversation operators, as DuckDB runs it."""


def crc32_sql(text: str) -> str:
    """CRC-32 of an expression's ASCII characters, bit by bit."""
    bits = ("list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: "
            "CASE WHEN (v & 1) = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)")
    return (
        "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform("
        f"string_split({text}, ''), lambda ch: CAST(ord(ch) AS BIGINT))), "
        f"lambda crc, byte: {bits}), CAST(4294967295 AS BIGINT))")


PREFIX_TRIE_SQL = f"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS t,
         row_number() OVER (PARTITION BY conv_id
                            ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL
),
ids AS (
  SELECT c, c - c % 100 AS start, {crc32_sql("CAST(c AS VARCHAR)")} % 6 AS h
  FROM (SELECT DISTINCT c FROM turns)
),
lent AS (
  SELECT i.c, t.n AS d, t.role, t.t FROM ids i JOIN turns t ON t.c = i.start AND t.n <= i.h
),
heads AS (
  SELECT i.c, i.h, count(l.c) AS k FROM ids i LEFT JOIN lent l ON l.c = i.c GROUP BY i.c, i.h
),
rebuilt AS (
  SELECT * FROM lent
  UNION ALL
  SELECT t.c, t.n - x.h + x.k, t.role, t.t FROM turns t JOIN heads x ON x.c = t.c WHERE t.n > x.h
),
spelled AS (
  SELECT c, CAST(0 AS BIGINT) AS d, '' AS path, CAST(0 AS BIGINT) AS chars FROM ids
  UNION ALL
  SELECT c, d, string_agg(length(role) || ':' || role || length(t) || ':' || t, '')
                 OVER (PARTITION BY c ORDER BY d), length(t)
  FROM rebuilt
),
paths AS (SELECT *, lag(path) OVER (PARTITION BY c ORDER BY d) AS above FROM spelled),
nodes AS (
  SELECT path, d, any_value(above) AS above, min(c) AS conv_id, count(*) AS n_convs,
         max(chars) AS chars
  FROM paths GROUP BY path, d
),
kids AS (SELECT above AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY above),
whole AS (SELECT c, max(d) AS d FROM paths GROUP BY c),
ended AS (
  SELECT path, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids
  FROM paths JOIN whole USING (c, d) GROUP BY path
),
pairs AS (SELECT DISTINCT a.path AS top, b.path FROM paths a JOIN paths b ON a.c = b.c AND b.d >= a.d),
sums AS (
  SELECT p.top, sum((x.n_convs - 1) * x.chars) AS saved, count(*) FILTER (k.path IS NULL) AS leaves
  FROM pairs p JOIN nodes x USING (path) LEFT JOIN kids k USING (path) GROUP BY p.top
)
SELECT x.conv_id, x.d AS depth, up.conv_id AS parent_conv_id, x.n_convs,
       CAST(coalesce(k.n, 0) AS BIGINT) AS n_children, s.leaves AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes x JOIN sums s ON s.top = x.path LEFT JOIN nodes up ON up.path = x.above AND x.d > 0
LEFT JOIN kids k ON k.path = x.path LEFT JOIN ended e ON e.path = x.path"""

_NEVER = 1 << 40


def _direct(state: int, wanted: int, kept: dict[str, int]) -> str:
    """Cheapest cost by an edit of the row itself, from the vector a0..a3 after it."""
    keeps = " ".join(f"WHEN '{kind}' THEN cut + a{to}" for kind, to in kept.items())
    return (f"least(3 + a{state}, CASE WHEN must THEN {_NEVER} ELSE least(2 + cut + a{wanted}, "
            f"CASE initial {keeps} ELSE {_NEVER} END) END)")


_STATES = [(2, {"s": 1, "u": 2}), (2, {"u": 2}), (3, {"a": 3}), (2, {"u": 2})]
_DIRECT = ", ".join(f"{_direct(s, w, k)} AS d{s}" for s, (w, k) in enumerate(_STATES))
_WANTED = "CASE st WHEN 2 THEN 3 ELSE 2 END"
_KEPT = ("CASE WHEN initial = 's' AND st = 0 THEN 1 WHEN initial = 'u' AND st IN (0, 1, 3) THEN 2 "
         "WHEN initial = 'a' AND st = 2 THEN 3 END")
_NAME = "CASE st WHEN 2 THEN 'assistant' ELSE 'user' END"


def _at(vector: str, state: str) -> str:
    return f"(CASE {state} " + " ".join(f"WHEN {s} THEN {vector}{s}" for s in range(4)) + " END)"


TURN_REPAIR_SQL = f"""
WITH RECURSIVE drawn AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS k, turn, coalesce(role, ' ') AS role,
         coalesce(text, ' ') AS t,
         {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")}
           % 20 AS kind
  FROM conversations
),
damaged AS (
  SELECT k, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS t
  FROM drawn, range(2) copies(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, t) - 1 AS i FROM damaged
),
marked AS (
  SELECT *, NOT regexp_matches(t, '[^\\x20\\x09-\\x0D]') AS blank,
         row_number() OVER (PARTITION BY k, role, t ORDER BY i) > 1 AS again,
         NOT regexp_matches(t, '[.!?][\\x20\\x09-\\x0D]*$') AS open
  FROM numbered
),
faults AS (
  SELECT k, i, turn, role, t, left(role, 1) AS initial, blank, again AND NOT blank AS duplicate,
         blank OR again AS must, CAST(open AND NOT blank AND NOT again AS BIGINT) AS cut
  FROM marked
),
sizes AS (SELECT k, max(i) + 1 AS n FROM faults GROUP BY k),
back AS (
  SELECT k, n AS i, CAST(0 AS BIGINT) AS a0, CAST(4 AS BIGINT) AS a1, CAST(2 AS BIGINT) AS a2,
         CAST(0 AS BIGINT) AS a3
  FROM sizes
  UNION ALL
  SELECT k, i, least(d0, 2 + d2, 4 + d3), least(d1, 2 + d2, 4 + d3), least(d2, 2 + d3),
         least(d3, 2 + d2)
  FROM (
    SELECT f.k, f.i, {_DIRECT} FROM back b JOIN faults f ON f.k = b.k AND f.i = b.i - 1
  )
),
walk AS (
  SELECT k, CAST(0 AS BIGINT) AS i, 0 AS st, '' AS audit, CAST([] AS VARCHAR[]) AS lines
  FROM sizes
  UNION ALL
  SELECT k, CASE edit WHEN 'I' THEN i ELSE i + 1 END,
         CASE edit WHEN 'D' THEN st WHEN 'K' THEN kept ELSE wanted END, audit || edit,
         CASE edit WHEN 'D' THEN lines WHEN 'I' THEN list_append(lines, name || ':')
           WHEN 'K' THEN list_append(lines, role || ':' || t)
           ELSE list_append(lines, name || ':' || t) END
  FROM (
    SELECT *, CASE WHEN i < n AND 3 + after_st = now THEN 'D'
                   WHEN i = n OR 2 + now_wanted = now THEN 'I'
                   WHEN NOT must AND cut + after_kept = now THEN 'K' ELSE 'R' END AS edit
    FROM (
      SELECT w.k, w.i, w.st, w.audit, w.lines, s.n, f.role, f.t, f.must, f.cut,
             {_WANTED} AS wanted, {_KEPT} AS kept, {_NAME} AS name,
             {_at("x.a", "w.st")} AS now, {_at("x.a", _WANTED)} AS now_wanted,
             {_at("y.a", "w.st")} AS after_st, {_at("y.a", "(" + _KEPT + ")")} AS after_kept
      FROM walk w JOIN sizes s ON s.k = w.k
      LEFT JOIN faults f ON f.k = w.k AND f.i = w.i
      LEFT JOIN back x ON x.k = w.k AND x.i = w.i
      LEFT JOIN back y ON y.k = w.k AND y.i = w.i + 1
      WHERE w.i < s.n OR w.st IN (1, 2)
    )
  )
),
done AS (
  SELECT w.k, w.audit, array_to_string(w.lines, chr(10)) AS repaired
  FROM walk w JOIN sizes s ON s.k = w.k AND w.i = s.n WHERE w.st IN (0, 3)
),
costs AS (SELECT k, a0 AS cost FROM back WHERE i = 0),
pairs AS (
  SELECT k, initial || lead(initial) OVER (PARTITION BY k ORDER BY i) AS pair FROM faults
),
illegal AS (
  SELECT k, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS n FROM pairs GROUP BY k
),
stats AS (
  SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (cut = 1) AS truncated
  FROM faults GROUP BY k
),
ids AS (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS k FROM conversations)
SELECT ids.conv_id, CAST(coalesce(s.gaps, 0) AS BIGINT) AS gaps, coalesce(s.blank, 0) AS blank,
       coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated,
       coalesce(g.n, 0) AS illegal, coalesce(c.cost, 0) AS cost, coalesce(d.audit, '') AS audit,
       sha256(coalesce(d.repaired, '')) AS repaired_sha256
FROM ids LEFT JOIN stats s USING (k) LEFT JOIN illegal g USING (k) LEFT JOIN costs c USING (k)
LEFT JOIN done d USING (k)"""

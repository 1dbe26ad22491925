"""Conversation structure repair by a fold in Spark SQL.

The turns of a conversation are put in order (by turn, nulls first, then by role and
text), windows flag each turn's fault, and the turns are collected as sorted structs. A
fold then walks them with four (cost, audit) structs, one for each state that the roles
so far can leave: nothing yet, after a system turn, after a user turn, after an assistant
turn. Every edit makes a candidate of a state, and `least` over the structs keeps the
cheapest, of equal cost the one whose audit comes first; no two audits of one state and
one cost are each other's prefix (they differ by insertions, which cost), so what is
least now stays least whatever follows. The edits give the repaired turns. Only
DataFrame functions are used.

A fold that appends to its audits copies them at each turn, so a conversation is folded
in blocks of BLOCK turns: a block is folded from each of the four states, and the blocks'
results are joined. Time grows with the turns, not with their square. A conversation's turns are
one array, since its repaired text and audit are one value each: it may hold as much as
an array and a string of Spark can (2 GB).

Nulls of role and text are one space (a blank text, a role that is neither). Null turns
come first, null conversations are one conversation. An empty table gives an empty
result; repeated rows are duplicates of the first; further columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
#: Costs of edits, and what an undeleted truncated turn adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: More than any repair costs: no way leads to a state.
NEVER = 1 << 40
BLANKS = " \t\n\x0b\x0c\r"
STATES = ("nothing", "system", "user", "assistant")


def _pair(cost, audit) -> Column:
    return F.struct(F.lit(cost).cast("long").alias("cost"), F.lit(audit).cast("string").alias("audit"))


def _add(state: Column, cost, letter) -> Column:
    return _pair(state["cost"] + cost, F.concat(state["audit"], F.lit(letter) if isinstance(letter, str) else letter))


def _four(*states: Column) -> Column:
    return F.struct(*[s.alias(name) for s, name in zip(states, STATES, strict=True)])


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def _inserted(at: Column) -> Column:
    """The four states after insertions; more than a user and an assistant never pay."""
    user = F.least(at["user"], *[_add(at[s], INSERT, "I") for s in ("nothing", "system", "assistant")])
    return _let(user, lambda u: _four(at["nothing"], at["system"], u, F.least(at["assistant"], _add(u, INSERT, "I"))))


def _edited(at: Column, turn: Column) -> Column:
    """The four states after a turn is kept, given another role or deleted."""
    more = F.when(turn["truncated"], TRUNCATED).otherwise(0)

    def to(state: Column, initial: str) -> Column:
        own = turn["initial"] == initial
        return _add(state, more + F.when(own, KEEP).otherwise(REROLE), F.when(own, F.lit("K")).otherwise(F.lit("R")))

    def or_deleted(state: Column, allowed: Column, other: Column) -> Column:
        return F.least(_add(state, DELETE, "D"), F.when(allowed, other))

    stays = ~turn["goes"]
    return _four(
        _add(at["nothing"], DELETE, "D"),
        or_deleted(at["system"], stays & (turn["initial"] == "s"), _add(at["nothing"], more + KEEP, "K")),
        or_deleted(at["user"], stays, to(F.least(at["nothing"], at["system"], at["assistant"]), "u")),
        or_deleted(at["assistant"], stays, to(at["user"], "a")),
    )


def _start(state: str) -> Column:
    return _four(*[_pair(0 if s == state else NEVER, "") for s in STATES])


def _block(turns: Column) -> Column:
    """For each state before the block, the four states after it."""
    return F.aggregate(
        turns, F.array(*[_start(s) for s in STATES]), lambda ways, turn: F.transform(ways, lambda at: _let(_inserted(at), lambda free: _edited(free, turn)))
    )


def _joined(at: Column, block: Column) -> Column:
    def after(state: str) -> Column:
        return F.least(*[_pair(F.least(at[s]["cost"] + block[i][state]["cost"], F.lit(NEVER)), F.concat(at[s]["audit"], block[i][state]["audit"])) for i, s in enumerate(STATES)])

    return _four(*[after(s) for s in STATES])


def cheapest(turns: Column) -> Column:
    """(cost, audit) of the cheapest repair of an array of (initial, goes, truncated)."""
    count = F.ceil(F.size(turns) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: _block(F.slice(turns, i * BLOCK + 1, F.lit(BLOCK))))
    return F.aggregate(blocks, _start("nothing"), _joined, lambda at: _let(_inserted(at), lambda end: F.least(end["nothing"], end["assistant"])))


def edited(turns: Column, audit: Column) -> Column:
    """The (role, text) structs that an audit's edits leave of the turns."""
    new = F.array(F.struct(F.lit(None).cast("string").alias("role"), F.lit("").alias("text")))

    def of_turn(turn: Column, edits: Column) -> Column:
        letter = F.right(edits, F.lit(1))
        own = F.struct(F.when(letter == "K", turn["role"]).alias("role"), turn["text"].alias("text"))
        return F.concat(F.flatten(F.array_repeat(new, F.length(edits) - 1)), F.when(letter == "D", F.slice(new, 1, 0)).otherwise(F.array(own)))

    each = F.zip_with(turns, F.regexp_extract_all(audit, F.lit("(I*[KRD])"), F.lit(1)), of_turn)
    last = F.flatten(F.array_repeat(new, F.length(F.regexp_extract(audit, "I*$", 0))))

    def named(kept: Column) -> Column:
        """A role that isn't the turn's own follows from its place after a system turn."""
        before = F.when(F.get(kept, F.lit(0))["role"].startswith("s"), 1).otherwise(0)
        return F.transform(kept, lambda t, i: F.struct(F.coalesce(t["role"], F.when((i - before) % 2 == 0, "user").otherwise("assistant")).alias("role"), t["text"].alias("text")))

    return _let(F.concat(F.flatten(each), last), named)


def flagged(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", absent: Column | None = None) -> DataFrame:
    """(conv, turn, role, text, absent, place, blank, duplicate, truncated, illegal): every turn with
    its place and its first fault. Rows that `absent` marks only name their conversation."""
    named = turns.select(
        F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
        F.coalesce(F.lit(False) if absent is None else absent, F.lit(False)).alias("absent"),
    ).repartition("conv")  # one shuffle: both windows and the groups need a conversation in one place
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    whole = Window.partitionBy("conv", "absent").orderBy(*order)
    alike = Window.partitionBy("conv", "absent", "role", "text").orderBy("place")
    end = F.rtrim("text", F.lit(BLANKS))
    pair = F.concat(F.substring(F.lag("role").over(whole), 1, 1), F.substring("role", 1, 1))
    rows = named.withColumn("place", F.row_number().over(whole)).withColumn("repeated", F.row_number().over(alike) > 1).withColumn("illegal", F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)))
    blank = end == ""
    duplicate = ~blank & F.col("repeated")
    return rows.select("conv", "turn", "role", "text", "absent", "place", blank.alias("blank"), duplicate.alias("duplicate"), (~blank & ~duplicate & ~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("truncated"), "illegal")


def repair(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", absent: Column | None = None) -> DataFrame:
    """One row per conversation: its id, gaps in the turn numbers, turns by first fault
    (blank, duplicate, truncated), illegal neighbours, the cheapest repair's cost and
    audit, and `repaired`, the array of (role, text) that it leaves. A conversation of
    absent rows only has zeros, an empty audit and an empty array."""
    rows = flagged(turns, id_col, turn_col, role_col, text_col, absent)
    here = ~F.col("absent")
    turn = F.struct("place", F.substring("role", 1, 1).alias("initial"), (F.col("blank") | F.col("duplicate")).alias("goes"), "truncated", "role", "text")
    count = lambda c: F.coalesce(F.count_if(here & F.col(c)), F.lit(0)).alias(c)
    groups = rows.groupBy("conv").agg(
        # a window over the sorted turns would need distinct counts; a set of numbers is small beside the texts
        (F.max(F.when(here, F.col("turn"))) - F.min(F.when(here, F.col("turn"))) + 1 - F.size(F.collect_set(F.when(here, F.col("turn"))))).alias("gaps"),
        *[count(c) for c in ("blank", "duplicate", "truncated", "illegal")],
        F.sort_array(F.collect_list(F.when(here, turn))).alias("turns"),
    )
    best = groups.withColumn("best", cheapest(F.transform("turns", lambda t: F.struct(t["initial"], t["goes"], t["truncated"]))))
    return best.select(
        F.col("conv").alias(id_col), F.coalesce(F.col("gaps"), F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal",
        F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), edited(F.col("turns"), F.col("best.audit")).alias("repaired"),
    )


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and absent: the turns with the damage that crc32 of
    `conv_id:turn`, modulo 20, deals out; dropped turns stay as absent rows."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    text, kind = name("text"), F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    rows = turns.select("conv_id", "turn", name("role").alias("own"), text.alias("whole"), kind.alias("kind"))
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("own")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("whole", ".!?", "")).otherwise(F.col("whole")).alias("text"),
        (F.col("kind") == 0).alias("absent"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def repair_damaged(turns: DataFrame) -> DataFrame:
    """Per conversation of the undamaged table: counts of faults, cost and audit of the
    cheapest repair, and repaired_sha256 of its `role:text` lines."""
    found = repair(damaged(turns), absent=F.col("absent"))
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines, 256).alias("repaired_sha256"))


#: The same rows in SQL: crc32 bit by bit, and the fold as a recursive query, a turn a step;
#: a cost with its audit is one text, the cost in ten digits, so that the least text is the cheapest.
REPAIR_SQL = """
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
hashed AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
      flatten(list_transform(range(1, length(k) + 1), lambda i: list_concat([CAST(ascii(substr(k, CAST(i AS INTEGER), 1)) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) % 20 AS kind
  FROM keyed),
turns AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hashed, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) AS copies(n)),
ends AS (
  SELECT conv_id, turn, role, text, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS e, left(role, 1) AS r,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM turns),
flags AS (
  SELECT conv_id, turn, role, text, r, i, e = '' AS blank, e <> '' AND nth > 1 AS dup, e <> '' AND nth = 1 AND right(e, 1) NOT IN ('.', '!', '?') AS trunc,
    coalesce(lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r NOT IN ('su', 'ua', 'au'), FALSE) AS illegal
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM ends)),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated,
    count(*) FILTER (illegal) AS illegal, count(*) AS n
  FROM flags GROUP BY conv_id),
convs AS (
  SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(n, 0) AS n
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON c.conv_id IS NOT DISTINCT FROM f.conv_id),
fold AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '1000000000' AS e, '1900000000' AS s, '1000000005I' AS u, '1000000010II' AS a FROM convs
  UNION ALL
  SELECT conv_id, i, e, s, u1, least(a1, (CAST(left(u1, 10) AS BIGINT) + 5) || substr(u1, 11) || 'I')
  FROM (SELECT *, least(u0, (CAST(left(e, 10) AS BIGINT) + 5) || substr(e, 11) || 'I', (CAST(left(s, 10) AS BIGINT) + 5) || substr(s, 11) || 'I', (CAST(left(a1, 10) AS BIGINT) + 5) || substr(a1, 11) || 'I') AS u1
    FROM (SELECT f.conv_id, t.i, (CAST(left(e, 10) AS BIGINT) + 2) || substr(e, 11) || 'D' AS e,
        least((CAST(left(s, 10) AS BIGINT) + 2) || substr(s, 11) || 'D', CASE WHEN stays AND r = 's' THEN (CAST(left(e, 10) AS BIGINT) + p) || substr(e, 11) || 'K' END) AS s,
        least((CAST(left(u, 10) AS BIGINT) + 2) || substr(u, 11) || 'D', CASE WHEN stays THEN (CAST(left(least(e, s, a), 10) AS BIGINT) + p + CASE r WHEN 'u' THEN 0 ELSE 1 END) || substr(least(e, s, a), 11) || CASE r WHEN 'u' THEN 'K' ELSE 'R' END END) AS u0,
        least((CAST(left(a, 10) AS BIGINT) + 2) || substr(a, 11) || 'D', CASE WHEN stays THEN (CAST(left(u, 10) AS BIGINT) + p + CASE r WHEN 'a' THEN 0 ELSE 1 END) || substr(u, 11) || CASE r WHEN 'a' THEN 'K' ELSE 'R' END END) AS a1
      FROM fold f JOIN (SELECT conv_id, i, r, NOT (blank OR dup) AS stays, CASE WHEN trunc THEN 5 ELSE 0 END AS p FROM flags) t ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = f.i + 1))),
best AS (
  SELECT f.conv_id, CAST(left(least(e, a), 10) AS BIGINT) - 1000000000 AS cost, substr(least(e, a), 11) AS audit FROM fold f JOIN convs c ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.i = c.n),
letters AS (
  SELECT conv_id, pos, substr(audit, CAST(pos AS INTEGER), 1) AS letter FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS pos FROM best)),
places AS (
  SELECT conv_id, pos, letter, count_if(letter <> 'I') OVER w AS i, count_if(letter <> 'D') OVER w AS nth FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
outs AS (
  SELECT p.conv_id, p.pos, p.nth, CASE WHEN letter = 'I' THEN '' ELSE text END AS text, CASE WHEN letter = 'K' THEN role END AS role,
    max(CASE WHEN letter = 'K' AND r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS lead_in
  FROM places p LEFT JOIN flags t ON p.conv_id IS NOT DISTINCT FROM t.conv_id AND p.i = t.i WHERE letter <> 'D'),
texts AS (
  SELECT conv_id, string_agg(coalesce(role, CASE WHEN (nth - lead_in) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY pos) AS whole FROM outs GROUP BY conv_id)
SELECT c.conv_id, c.gaps, c.blank, c.duplicate, c.truncated, c.illegal, b.cost, b.audit, sha256(coalesce(t.whole, '')) AS repaired_sha256
FROM convs c JOIN best b ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN texts t ON c.conv_id IS NOT DISTINCT FROM t.conv_id
"""

"""Conversation structure repair by bidirectional Dijkstra over the edit lattice.

A node is (rows consumed, last role initial in the output). Edits lead from node to node: Keep consumes
a row, Rerole consumes it as the user's or the assistant's, Delete consumes it without output, Insert
puts an empty text in. Only outputs whose initials read `(s?(ua)+)?` have a path. A forward heap starts
before the first row, a reverse heap behind the last one; when they meet, all crossings of the least
cost are finished, and of their concatenated audits (initials of the edits) the least in ASCII order wins.

From one node each letter leads along one edge, so an audit names its path. Both heaps hand out nodes
by cost and, for Keep costs nothing, by rows passed, so a node's equally cheap audits have all arrived
when it is handed out. A crossing is a node that one side has handed out and the other has reached.
Forward audits of one node are compared where their paths part, reverse ones by their first letter; no
audit is stored with a node.

Rows come sorted by conversation and turn in a stream; a conversation's rows are held by one task while
it is repaired, as the order-dependent digest of its texts requires. Nodes take some hundred bytes a row.

Defined cases: a null role, text, conv_id or turn is one space in the damage's key and a null role or
text one space in the row; null turns come first; rows of one turn follow role and text; repeated rows
are damaged alike and count as duplicates; a role other than system, user and assistant goes by its
initial; an empty role has no initial, may be kept anywhere, and is an illegal neighbour. Extra columns
are ignored; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Role that may follow each last initial of the output, and whether the output may end there.
FOLLOWING = {"": "su", "s": "u", "u": "a", "a": "u"}
FINAL = ("", "a")
ROLES = {"u": "user", "a": "assistant"}
_FIELDS = (
    ("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
    ("repaired_sha256", pa.string()),
)


@dataclass(frozen=True)
class Row:
    """What the lattice needs of a row; `must_go` for blank ones and duplicates."""

    initial: str
    must_go: bool = False
    truncated: bool = False

    @property
    def surcharge(self) -> int:
        return TRUNCATED if self.truncated else 0


def _ahead(rows: list[Row], node):
    """Edges (cost, letter, next node) from a node."""
    i, last = node
    new = FOLLOWING[last].replace("s", "")
    if i < len(rows):
        row = rows[i]
        yield DELETE, "D", (i + 1, last)
        if not row.must_go:
            if not row.initial:
                yield row.surcharge, "K", (i + 1, last)
            elif row.initial in FOLLOWING[last]:
                yield row.surcharge, "K", (i + 1, row.initial)
            yield REROLE + row.surcharge, "R", (i + 1, new)
    yield INSERT, "I", (i, new)


def _behind(rows: list[Row], node):
    """Edges (cost, letter, earlier node) into a node."""
    i, last = node
    before = [b for b in FOLLOWING if last and last in FOLLOWING[b]]
    if i:
        row = rows[i - 1]
        yield DELETE, "D", (i - 1, last)
        if not row.must_go:
            if not row.initial:
                yield row.surcharge, "K", (i - 1, last)
            elif row.initial == last:
                for b in before:
                    yield row.surcharge, "K", (i - 1, b)
            if last in ROLES:
                for b in before:
                    yield REROLE + row.surcharge, "R", (i - 1, b)
    if last in ROLES:
        for b in before:
            yield INSERT, "I", (i, b)


class _Side:
    """One heap with what it knows of each node: (cost, letter, neighbour towards its start, length)."""

    def __init__(self, rows: list[Row], starts, forward: bool):
        self.rows, self.forward = rows, forward
        self.known = {node: (0, "", None, 0) for node in starts}
        self.done = set()
        self.heap = [(0, self._passed(node), node) for node in starts]

    def _passed(self, node) -> int:
        return node[0] if self.forward else len(self.rows) - node[0]

    def least(self) -> float:
        while self.heap and self.heap[0][2] in self.done:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def settle(self) -> list:
        """Take the least node off the heap and offer its edges; returns it and the nodes it reached."""
        cost, _, node = heapq.heappop(self.heap)
        self.done.add(node)
        length, reached = self.known[node][3] + 1, [node]
        edges = _ahead if self.forward else _behind
        for price, letter, other in edges(self.rows, node):
            if other in self.done:
                continue
            offer = (cost + price, letter, node, length)
            reached.append(other)
            held = self.known.get(other)
            if held is None or offer[0] < held[0]:
                self.known[other] = offer
                heapq.heappush(self.heap, (offer[0], self._passed(other), other))
            elif offer[0] == held[0] and self._before(offer, held):
                self.known[other] = offer
        return reached

    def _before(self, one, two) -> bool:
        """Whether the audit over `one` is less than that over `two`, for the same node."""
        if not self.forward:
            return one[1] < two[1]
        x, y = one, two  # walk back to where both paths part
        while x[2] != y[2]:
            if x[3] > y[3]:
                x = self.known[x[2]]
            elif y[3] > x[3]:
                y = self.known[y[2]]
            else:
                x, y = self.known[x[2]], self.known[y[2]]
        if x[3] != y[3]:  # cannot be for two paths of one cost, but then the shorter one is less
            return x[3] < y[3]
        return x[1] < y[1]

    def path(self, node) -> list:
        """(letter, node it leads to) from the start to this node, or from this node to the end."""
        out = []
        while (held := self.known[node])[2] is not None:
            out.append((held[1], node if self.forward else held[2]))
            node = held[2]
        return out[::-1] if self.forward else out


def repair(rows: list[Row]) -> tuple[int, list]:
    """Least cost, and its least audit as (letter, node reached) pairs."""
    ahead = _Side(rows, [(0, "")], True)
    back = _Side(rows, [(len(rows), f) for f in FINAL], False)
    best = float("inf")
    while ahead.least() + back.least() <= best:
        side, other = (ahead, back) if ahead.least() <= back.least() else (back, ahead)
        for node in side.settle():
            if node in other.known:
                best = min(best, side.known[node][0] + other.known[node][0])
    crossings = [
        node for side, other in ((ahead, back), (back, ahead)) for node in side.done
        if node in other.known and side.known[node][0] + other.known[node][0] == best
    ]
    # a crossing whose path runs through another one is that one's path
    met, paths = set(crossings), []
    for node in crossings:
        earlier = ahead.known[node][2]
        if earlier in met and back.known[earlier][1:3] == (ahead.known[node][1], node):
            continue
        paths.append(ahead.path(node) + back.path(node))
    return best, min(paths, key=lambda path: "".join(letter for letter, _ in path))


def last_mark(text: str) -> str:
    """The last character that is no white space, or an empty string."""
    return text.rstrip(" \t\n\x0b\x0c\r")[-1:]


def faults(turns: list[tuple[str, str]]) -> list[str]:
    """First fault of each (role, text): blank, duplicate, truncated, or an empty string."""
    seen, out = set(), []
    for role, text in turns:
        mark = last_mark(text)
        if not mark:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if mark in (".", "!", "?") else "truncated")
        seen.add((role, text))
    return out


def repaired_turns(turns: list[tuple[str, str]], path: list) -> list[tuple[str, str]]:
    out, rest = [], iter(turns)
    for letter, (_, last) in path:
        if letter == "I":
            out.append((ROLES[last], ""))
            continue
        role, text = next(rest)
        if letter != "D":
            out.append((ROLES[last] if letter == "R" else role, text))
    return out


def report(conv: int | None, numbers: list[int | None], turns: list[tuple[str, str]]) -> tuple:
    """One row of `conversation_repairs` for a conversation's turn numbers and (role, text) rows."""
    known = [n for n in numbers if n is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    found = faults(turns)
    initials = [role[:1] for role, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    rows = [Row(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, found, strict=True)]
    cost, path = repair(rows)
    audit = "".join(letter for letter, _ in path)
    digest = hashlib.sha256()
    for place, (role, text) in enumerate(repaired_turns(turns, path)):
        digest.update((("\n" if place else "") + f"{role}:{text}").encode())
    counts = (found.count("blank"), found.count("duplicate"), found.count("truncated"))
    return conv, gaps, *counts, illegal, cost, audit, digest.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage, with `place` ordering equal turns; a dropped row stays with a null role."""
    space = F.lit(" ")
    given = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
    )
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    marked = given.withColumn("damage", F.crc32(F.encode(key, "UTF-8")) % 20)
    copies = F.explode(F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    text = (
        F.when(F.col("damage") == 1, F.lit("")).when(F.col("damage") == 2, F.translate("text", ".!?", ""))
        .when(F.col("damage") == 0, F.lit(None)).otherwise(F.col("text"))
    )
    role = F.when(F.col("damage") == 4, F.lit("user")).when(F.col("damage") == 0, F.lit(None)).otherwise(F.col("role"))
    return marked.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"),
        F.struct(F.col("role").alias("r"), F.col("text").alias("t")).alias("place"), copies.alias("copy"),
    )


def conversation_repairs(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of (conv_id, turn, role, text) rows; rows without a role only name their conv_id.

    A column `place` orders rows of equal turns; without one they follow role and text.
    """
    order = ["place"] if "place" in conversations.columns else ["role", "text"]
    ordered = conversations.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), *order)

    def each(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True)

        def results():
            for conv, group in itertools.groupby(rows(), key=lambda r: r[0]):
                held = [r for r in group if r[2] is not None]
                yield report(conv, [r[1] for r in held], [(r[2], r[3]) for r in held])

        found = results()
        while some := list(itertools.islice(found, 1000)):
            columns = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS]
            )

    schema = (
        "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
        "cost bigint, audit string, repaired_sha256 string"
    )
    return ordered.select("conv_id", "turn", "role", "text").mapInArrow(each, schema)


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return conversation_repairs(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: Least cost and audit per last initial, row by row; crc32 is computed bit by bit.
OP12_SQL = """
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), marked AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, bit: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 20 AS damage
  FROM given
), harmed AS (
  SELECT conv_id, turn, role AS r, text AS t, copy, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
    CASE damage WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM marked, (VALUES (0), (1)) AS copies(copy) WHERE damage <> 0 AND (copy = 0 OR damage = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t, copy) AS i,
    right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS mark FROM harmed
), flagged AS (
  SELECT *, mark = '' AS is_blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM placed
), rows AS (
  SELECT *, is_blank OR again AS must_go, NOT is_blank AND NOT again AND mark NOT IN ('.', '!', '?') AS is_cut FROM flagged
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (is_blank) AS blank, count(*) FILTER (again AND NOT is_blank) AS duplicate,
    count(*) FILTER (is_cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS size
  FROM rows GROUP BY conv_id
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, [{cost: 0, audit: '', last: '', body: ''}, {cost: 3, audit: 'I', last: 'u', body: chr(10) || 'user:'},
    {cost: 6, audit: 'II', last: 'a', body: chr(10) || 'user:' || chr(10) || 'assistant:'}] AS known FROM counted
  UNION ALL
  SELECT conv_id, i, list_filter(list_transform(['', 's', 'u', 'a'], lambda q: list_min(list_filter(list_concat(once, list_transform(once, lambda x:
      {cost: x.cost + 3, audit: x.audit || 'I', last: CASE x.last WHEN 'u' THEN 'a' ELSE 'u' END,
       body: x.body || chr(10) || CASE x.last WHEN 'u' THEN 'assistant:' ELSE 'user:' END})), lambda y: y.last = q))), lambda z: z IS NOT NULL) AS known
  FROM (
    SELECT conv_id, i, list_filter(list_transform(['', 's', 'u', 'a'], lambda q: list_min(list_filter(list_concat(taken, list_transform(taken, lambda x:
      {cost: x.cost + 3, audit: x.audit || 'I', last: CASE x.last WHEN 'u' THEN 'a' ELSE 'u' END,
       body: x.body || chr(10) || CASE x.last WHEN 'u' THEN 'assistant:' ELSE 'user:' END})), lambda y: y.last = q))), lambda z: z IS NOT NULL) AS once
    FROM (
      SELECT w.conv_id, r.i, list_concat(
        list_transform(w.known, lambda x: {cost: x.cost + 4, audit: x.audit || 'D', last: x.last, body: x.body}),
        list_transform(list_filter(w.known, lambda x: NOT r.must_go), lambda x:
          {cost: x.cost + 3 + r.is_cut::INT * 3, audit: x.audit || 'R', last: CASE x.last WHEN 'u' THEN 'a' ELSE 'u' END,
           body: x.body || chr(10) || CASE x.last WHEN 'u' THEN 'assistant:' ELSE 'user:' END || r.text}),
        list_transform(list_filter(w.known, lambda x: NOT r.must_go AND (r.role = '' OR left(r.role, 1) = CASE x.last WHEN 'u' THEN 'a' ELSE 'u' END
            OR (x.last = '' AND left(r.role, 1) = 's'))), lambda x:
          {cost: x.cost + r.is_cut::INT * 3, audit: x.audit || 'K', last: CASE WHEN r.role = '' THEN x.last ELSE left(r.role, 1) END,
           body: x.body || chr(10) || r.role || ':' || r.text})) AS taken
      FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
    )
  )
), ended AS (
  SELECT c.*, list_min(list_filter(w.known, lambda x: x.last IN ('', 'a'))) AS x
  FROM counted c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.size
)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(x.cost, 0) AS BIGINT) AS cost,
  coalesce(x.audit, '') AS audit, sha256(coalesce(substr(x.body, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM g.conv_id
"""

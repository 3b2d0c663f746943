"""Repair of conversation structure by depth-first branch and bound.

A conversation should be nothing, or an optional system row and then user and assistant
rows in turn. Edits that make it so have costs; the search finds the cheapest, and of
equally cheap ones the one whose string of edit initials (the audit) is least.

Rows are reduced to facts (role, text digest, faults) and range-partitioned by
conversation and turn, so that a conversation of any length is many stretches. A task
cuts its stretches into blocks of ``BLOCK`` rows and searches each block from the
grammar states it can be entered in. The best (cost, audit) of a block from state to
state is all that the next block needs, so blocks, and then stretches, are chained by
those few entries: two audits over the same rows never differ only by an ending, hence
the order of two prefixes already decides the order of whatever follows them.
"""

from __future__ import annotations

import functools
import hashlib
import operator
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.text import WHITE
from tidemark.session import materialize

# Fixed values of the task: costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLOCK = 64
REMEMBERED = 20_000
#: Grammar states: nothing yet, after the system row, after a user row, after an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = (NOTHING, SYSTEM, USER, ASSISTANT)
#: The state after a row that is inserted or gets a new role: the only turn that may follow.
TURN = (USER, USER, ASSISTANT, USER)
#: The state after a kept row by its role's initial; what is missing may not follow.
KEEP = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = {"su", "ua", "au"}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Rows inserted at the end so that the conversation may stop.
CLOSING = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}

Best = tuple[int, str]


def suffix_bounds(kinds: str) -> list[int]:
    """A cost that the rows from each position on have at least.

    A row to delete costs that, a truncated one its price or the dearer deletion. Two
    sound neighbours that may not follow each other need an edit between or at one of
    them, and no edit serves more than two such pairs.
    """
    bounds = [0] * (len(kinds) + 1)
    own = clashes = 0
    after = ""
    for i in range(len(kinds) - 1, -1, -1):
        kind = kinds[i]
        if kind == "d":
            own += DELETE
        else:
            own += TRUNCATED if kind.isupper() else 0
            clashes += bool(after) and kind.islower() and after.islower() and kind + after not in LEGAL
            after = kind
        bounds[i] = own + min(REROLE, INSERT, DELETE) * ((clashes + 1) // 2)
    return bounds


@functools.lru_cache(REMEMBERED)
def search(kinds: str, entry: int) -> tuple[Best | None, ...]:
    """The cheapest edits of a block of rows for each state it can end in, entered in a state.

    ``kinds`` has a letter per row: d if it must be deleted, else the initial of its role (x if it has
    none of the grammar's), a capital if it is truncated. Rows may be inserted before each row.
    """
    n = len(kinds)
    found: list[Best | None] = [None] * 4
    # Only deletions keep the first two states, so these ends need no search.
    if entry == NOTHING:
        kept = [(DELETE * (n - 1) + TRUNCATED * k.isupper(), "D" * i + "K" + "D" * (n - 1 - i)) for i, k in enumerate(kinds) if k in "sS"]
        found[SYSTEM] = min(kept, default=None)
    if entry in (NOTHING, SYSTEM):
        found[entry] = (DELETE * n, "D" * n)
    bounds = suffix_bounds(kinds)
    reached: list[list[Best | None]] = [[None] * 4 for _ in range(n + 1)]
    stack = [(0, entry, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        if all((best := found[end]) and _loses(cost + bounds[at], audit, best) for end in (USER, ASSISTANT)):
            continue
        before = reached[at][state]
        if before and before <= (cost, audit):
            continue
        reached[at][state] = (cost, audit)
        if at == n:
            if state in (USER, ASSISTANT):
                found[state] = min(found[state] or (cost, audit), (cost, audit))
            continue
        kind = kinds[at]
        extra = TRUNCATED * kind.isupper()
        # the last one pushed is tried first: the cheapest
        stack.append((at, TURN[state], cost + INSERT, audit + "I"))
        stack.append((at + 1, state, cost + DELETE, audit + "D"))
        if kind != "d":
            stack.append((at + 1, TURN[state], cost + REROLE + extra, audit + "R"))
            following = KEEP.get(kind.lower(), {}).get(state)
            if following is not None:
                stack.append((at + 1, following, cost + extra, audit + "K"))
    return tuple(found)


def _loses(cost: int, audit: str, best: Best) -> bool:
    """No way on from this audit, at this cost at least, is better than the best one known."""
    return cost > best[0] or cost == best[0] and audit > best[1][: len(audit)]


class Chain:
    """The best edits of the rows so far from one entry state to each state, chained block by block."""

    def __init__(self, entry: int) -> None:
        # by state: cost, place of its audit in the order of audits, and the audit as (all before, last part)
        self.ends: dict[int, tuple[int, int, tuple | None]] = {entry: (0, 0, None)}

    def add(self, table: dict[int, tuple[Best | None, ...]]) -> None:
        """Go through a block that has this best (cost, audit) for each state before and after."""
        ways: dict[int, tuple[int, int, str, tuple | None]] = {}
        for state, (cost, place, audit) in self.ends.items():
            for end, step in enumerate(table[state]):
                if step and (end not in ways or (cost + step[0], place, step[1]) < ways[end][:3]):
                    ways[end] = (cost + step[0], place, step[1], audit)
        order = sorted(ways, key=lambda end: ways[end][1:3])
        self.ends = {end: (ways[end][0], order.index(end), (ways[end][3], ways[end][2])) for end in ways}

    def audit(self, end: int) -> str:
        parts = []
        link = self.ends[end][2]
        while link:
            link, part = link
            parts.append(part)
        return "".join(reversed(parts))

    def entries(self) -> tuple[Best | None, ...]:
        return tuple((self.ends[end][0], self.audit(end)) if end in self.ends else None for end in STATES)

    def close(self) -> Best:
        """The best way to stop here."""
        cheapest = min(self.ends[end][0] + INSERT * CLOSING[end] for end in self.ends)
        return min(
            (cheapest, self.audit(end) + "I" * CLOSING[end]) for end in self.ends if self.ends[end][0] + INSERT * CLOSING[end] == cheapest
        )


COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")


class Stretch:
    """What is known of consecutive rows of a conversation."""

    def __init__(self, conv_id, entries: tuple[int, ...]) -> None:
        self.conv_id = conv_id
        self.counts = dict.fromkeys(COUNTS, 0)
        self.first: tuple | None = None  # (turn, role, digest)
        self.last_turn = self.low_turn = self.last_initial = None
        self.chains = {entry: Chain(entry) for entry in entries}
        self.kinds: list[str] = []

    def add(self, turn, role: str, digest: bytes, n: int, blank: bool, ended: bool, earlier: bool) -> None:
        """Take the n equal rows that come next."""
        initial = role[:1]
        if self.first is None:
            self.first = (turn, role, digest)
        else:
            self.counts["illegal"] += self.last_initial + initial not in LEGAL
        self.last_initial = initial
        if turn is not None and turn != self.last_turn:
            self.counts["turns"] += 1
            self.low_turn = turn if self.low_turn is None else self.low_turn
            self.last_turn = turn
        self.counts["rows"] += n
        self.counts["illegal"] += n - 1  # equal neighbours
        copies = n
        if blank:
            self.counts["blank"] += n
        else:
            if not earlier:
                copies -= 1
                kind = initial if initial in KEEP else "x"
                self.counts["truncated"] += not ended
                self.kinds.append(kind if ended else kind.upper())
            self.counts["duplicate"] += copies
        while copies:
            some = min(copies, BLOCK)
            self.kinds.append("d" * some)
            copies -= some
            self._blocks()
        self._blocks()

    def _blocks(self, whole: bool = False) -> None:
        if sum(map(len, self.kinds)) < BLOCK and not whole:
            return
        rows = "".join(self.kinds)
        while len(rows) >= BLOCK or rows and whole:
            block, rows = rows[:BLOCK], rows[BLOCK:]
            for chain in self.chains.values():
                chain.add({state: search(block, state) for state in chain.ends})
        self.kinds = [rows] if rows else []

    def join(self, other: dict) -> None:
        """Take the stretch that follows, as a row of ``PIECE``."""
        joined = self.first is not None
        for name in COUNTS:
            self.counts[name] += other[name]
        if joined:
            self.counts["illegal"] += self.last_initial + other["first_role"][:1] not in LEGAL
            self.counts["turns"] -= other["low_turn"] is not None and other["low_turn"] == self.last_turn
        self.first = self.first or (other["first_turn"], other["first_role"], other["first_digest"])
        self.last_initial = other["last_initial"]
        if other["low_turn"] is not None:
            self.low_turn = other["low_turn"] if self.low_turn is None else self.low_turn
            self.last_turn = other["last_turn"]
        table: dict[int, list[Best | None]] = {entry: [None] * 4 for entry in STATES}
        for step in other["steps"]:
            table[step["entry"]][step["end"]] = (step["cost"], step["audit"])
        for chain in self.chains.values():
            chain.add({entry: tuple(ends) for entry, ends in table.items()})

    def piece(self, complete: bool) -> dict:
        self._blocks(whole=True)
        row = {"conv_id": self.conv_id, "complete": complete, **self.counts}
        row |= {"low_turn": self.low_turn, "last_turn": self.last_turn, "last_initial": self.last_initial}
        row |= dict(zip(("first_turn", "first_role", "first_digest"), self.first))
        row["cost"], row["audit"], row["steps"] = None, None, None
        if complete:
            row["cost"], row["audit"] = self.chains[NOTHING].close()
        else:
            row["steps"] = [
                {"entry": entry, "end": end, "cost": best[0], "audit": best[1]}
                for entry, chain in self.chains.items()
                for end, best in enumerate(chain.entries())
                if best
            ]
        return row


PIECE = (
    "conv_id {conv}, complete boolean, rows long, blank long, duplicate long, truncated long, illegal long, turns long, low_turn {turn}, "
    "last_turn {turn}, last_initial string, first_turn {turn}, first_role string, first_digest binary, cost long, audit string, "
    "steps array<struct<entry: int, end: int, cost: long, audit: string>>"
)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _stretches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation: one piece of each. The first and the last may go on in another partition, all others are complete."""
    current = None
    ready = []
    leading = True
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for conv_id, *row in zip(*columns):
            if current is None or conv_id != current.conv_id:
                if current is not None:
                    ready.append(current.piece(complete=not leading))
                    leading = False
                # only the first one may have begun in another partition
                current = Stretch(conv_id, STATES if leading else (NOTHING,))
            current.add(*row)
        if len(ready) >= 1024:
            yield _batch(ready, schema)
            ready = []
    if current is not None:
        ready.append(current.piece(complete=False))
        yield _batch(ready, schema)


def _fold(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Open pieces sorted by conversation and first row: one complete piece of each conversation."""
    current = None
    for batch in batches:
        ready = []
        for row in batch.to_pylist():
            if current is None or row["conv_id"] != current.conv_id:
                if current is not None:
                    ready.append(current.piece(complete=True))
                current = Stretch(row["conv_id"], (NOTHING,))
            current.join(row)
        if ready:
            yield _batch(ready, schema)
    if current is not None:
        yield _batch([current.piece(complete=True)], schema)


def _rows(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """The four columns and a digest of the text; a null role or text is one space."""
    given = conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    return given.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    return functools.reduce(operator.and_, [a[name].eqNullSafe(b[name]) for name in names])


def find_repairs(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, rows, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows are taken by turn (null first), then role, then digest of the text; null roles and
    texts are one space, and a null conv_id is a conversation. Equal rows are one entry with a
    count from the first shuffle on. A role whose initial is none of s, u, a (an empty one
    too) cannot be kept. ``gaps`` is the number of turns missing between the first and the
    last. ``audit`` has D, I, K or R for each deleted, inserted, kept or reroled row, in
    order. Texts of any length are judged whole. An empty table gives no rows; other columns are ignored.
    """
    rows = _rows(conversations, conv_id, turn, role, text)
    types = {f.name: f.dataType for f in rows.schema}
    ending = F.rtrim(F.col("text"), F.lit(WHITE))
    facts = rows.select("conv_id", "turn", "role", "digest", (ending == "").alias("blank"), F.substring(ending, -1, 1).isin(".", "!", "?").alias("ended"))
    equal = facts.groupBy("conv_id", "turn", "role", "digest").agg(F.count(F.lit(1)).alias("n"), F.first("blank").alias("blank"), F.first("ended").alias("ended"))
    equal = materialize(equal)
    place = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"))
    again = equal.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("places")).where("places > 1")
    # a table of its own, so that the join can split a text that one conversation repeats in very many turns
    again = materialize(again.drop("places"))
    judged = equal.join(again, _same(equal, again, "conv_id", "role", "digest"), "left").select(
        equal["conv_id"], equal["turn"], equal["role"], equal["digest"], "n", "blank", "ended",
        (F.col("first").isNotNull() & ~F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn")).eqNullSafe(F.col("first"))).alias("earlier"),
    )
    keys = ("conv_id", "turn", "role", "digest")
    along = materialize(judged).repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = PIECE.format(conv=types["conv_id"].simpleString(), turn=types["turn"].simpleString())
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in rows.sparkSession.createDataFrame([], schema).schema])
    pieces = materialize(along.mapInArrow(functools.partial(_stretches, schema=arrow), schema))
    parts = pieces.where("NOT complete").repartition("conv_id").sortWithinPartitions("conv_id", "first_turn", "first_role", "first_digest")
    whole = pieces.where("complete").unionByName(parts.mapInArrow(functools.partial(_fold, schema=arrow), schema))
    gaps = F.coalesce(F.col("last_turn") - F.col("low_turn") + 1 - F.col("turns"), F.lit(0)).cast("long")
    return whole.select("conv_id", "rows", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _repaired(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The audit of a conversation, then its rows in order: walk both."""
    conv_id = audit = None
    at = position = 0
    state = NOTHING
    for batch in batches:
        done = []

        def put(role: str, text: str, edit: str) -> None:
            nonlocal position
            done.append({"conv_id": conv_id, "position": position, "role": role, "text": text, "edit": edit})
            position += 1

        def insertions() -> None:
            nonlocal at, state
            while audit[at : at + 1] == "I":
                at, state = at + 1, TURN[state]
                put(ROLE[state], "", "I")

        for row in batch.to_pylist():
            if row["audit"] is not None:
                if audit is not None:
                    insertions()
                conv_id, audit, at, position, state = row["conv_id"], row["audit"], 0, 0, NOTHING
                continue
            insertions()
            edit = audit[at]
            at += 1
            if edit == "R":
                state = TURN[state]
                put(ROLE[state], row["text"], "R")
            elif edit == "K":
                state = KEEP[row["role"][0]][state]
                put(row["role"], row["text"], "K")
        if done:
            yield _batch(done, schema)
    if audit is not None:
        tail = []
        while audit[at : at + 1] == "I":
            at, state = at + 1, TURN[state]
            tail.append({"conv_id": conv_id, "position": position, "role": ROLE[state], "text": "", "edit": "I"})
            position += 1
        if tail:
            yield _batch(tail, schema)


def repaired_rows(
    conversations: DataFrame, repairs: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The rows of the repaired conversations: conv_id, position, role, text, edit (I, K or R).

    ``repairs`` is the result of ``find_repairs`` for the same rows. Rows of a conversation
    follow each other in one partition, in order; they are streamed, never held together.
    """
    rows = _rows(conversations, conv_id, turn, role, text).select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "digest", "text")
    heads = repairs.select(
        "conv_id", "audit", *[F.lit(None).cast(rows.schema[name].dataType).alias(name) for name in ("turn", "role", "digest", "text")]
    )
    # an audit sorts before the rows, whose audit is null
    dealt = rows.unionByName(heads).repartition("conv_id")
    along = dealt.sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "digest")
    kind = rows.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, position long, role string, text string, edit string"
    arrow = pa.schema([("conv_id", to_arrow_type(kind)), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    return along.mapInArrow(functools.partial(_repaired, schema=arrow), schema)


def _digests(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    digest = conv_id = None
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if row["position"] == 0:
                if digest is not None:
                    done.append({"conv_id": conv_id, "repaired_sha256": digest.hexdigest()})
                conv_id, digest = row["conv_id"], hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{row['role']}:{row['text']}".encode())
        if done:
            yield _batch(done, schema)
    if digest is not None:
        yield _batch([{"conv_id": conv_id, "repaired_sha256": digest.hexdigest()}], schema)


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256: SHA-256 of the rows of ``repaired_rows`` as role:text joined by newlines."""
    kind = repaired.schema["conv_id"].dataType
    arrow = pa.schema([("conv_id", to_arrow_type(kind)), ("repaired_sha256", pa.string())])
    return repaired.mapInArrow(functools.partial(_digests, schema=arrow), f"conv_id {kind.simpleString()}, repaired_sha256 string")

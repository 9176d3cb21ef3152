"""Conversation structure repair: the cheapest edits, by a backward dynamic programme with square-root checkpoints.

A repaired conversation has the role initials ``(s?(ua)+)?``.  What is left to pay from a row on depends on
one of four states alone, so a stretch of rows acts on the four costs as a (min, +) matrix.  A conversation
that lies in several partitions is therefore solved in pieces: matrices of the pieces, costs at their ends,
states at their starts, then every piece on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import inf, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from uttermark.llm.common import checkpointed, staged

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"

FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
SYSTEM, USER, ASSISTANT, OTHER = range(4)
LEGAL_PAIRS = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}

# States: nothing written yet, or the initial that was written last.
NOTHING, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
STATES = 4
#: The state after a row of role (system, user, assistant, other), None where the row can't follow.
FOLLOWS = (
    (AFTER_SYSTEM, AFTER_USER, None, None),
    (None, AFTER_USER, None, None),
    (None, None, AFTER_ASSISTANT, None),
    (None, AFTER_USER, None, None),
)
#: The state after the one row of a user or assistant that can follow, and its role.
EXPECTED = ((AFTER_USER, "user"), (AFTER_USER, "user"), (AFTER_ASSISTANT, "assistant"), (AFTER_USER, "user"))
REROLE, DELETE, INSERT, UNMENDED = 3, 4, 3, 3

Costs = tuple[float, ...]


def _with_inserts(costs: Costs) -> Costs:
    """The costs where rows may be inserted first; a third insert comes back to a state of the first."""
    once = [INSERT + costs[EXPECTED[s][0]] for s in range(STATES)]
    return tuple(min(costs[s], once[s], INSERT + once[EXPECTED[s][0]]) for s in range(STATES))


#: What is left to pay after the last row.
AT_END = _with_inserts((0, inf, inf, 0))


def _choices(after: Costs, role: int, kind: int, state: int) -> list[tuple[float, str, int]]:
    """(cost, initial of the edit, state after it) of the edits of a row, without inserts."""
    found = [(DELETE + after[state], "D", state)]
    if kind not in (BLANK, DUPLICATE):
        mend = UNMENDED if kind == TRUNCATED else 0
        kept, turned = FOLLOWS[state][role], EXPECTED[state][0]
        if kept is not None:
            found.append((mend + after[kept], "K", kept))
        found.append((mend + REROLE + after[turned], "R", turned))
    return found


class Programme:
    """The dynamic programme over rows given as role and kind, a byte each.

    The four costs differ by a few edits at most, so few tuples of them exist once the least is taken off:
    steps are kept by tuple, which turns the walk into look-ups.
    """

    def __init__(self) -> None:
        self._costs: dict[tuple, tuple[Costs, float]] = {}
        self._letters: dict[tuple, tuple[str, int]] = {}

    def before(self, after: Costs, role: int, kind: int) -> tuple[Costs, float]:
        """The costs before a row, less their least one, and that least one."""
        found = self._costs.get((after, role, kind))
        if found is None:
            costs = _with_inserts(tuple(min(_choices(after, role, kind, s))[0] for s in range(STATES)))
            least = min(costs)
            found = self._costs[after, role, kind] = tuple(c - least for c in costs), least
        return found

    def edits(self, after: Costs, role: int, kind: int, state: int) -> tuple[str, int]:
        """The ASCII-least cheapest edits from before a row up to its own edit, and the state after it.

        An edit is tight if its cost and what is left after it make up what is left before it.
        """
        key = (after, role, kind, state)
        if key not in self._letters:
            before = _with_inserts(tuple(min(_choices(after, role, kind, s))[0] for s in range(STATES)))
            letters, letter = "", "I"
            while letter == "I":
                tight = [(edit, to) for cost, edit, to in _choices(after, role, kind, state) if cost == before[state]]
                to = EXPECTED[state][0]
                if INSERT + before[to] == before[state]:
                    tight.append(("I", to))
                letter, state = min(tight)
                letters += letter
            self._letters[key] = letters, state
        return self._letters[key]

    def costs_before(self, roles: bytes, kinds: bytes, end: Costs) -> tuple[Costs, float]:
        """The costs before the first of some rows, less their least one, and that least one."""
        least = min(end)
        costs = tuple(c - least for c in end)
        for role, kind in zip(reversed(roles), reversed(kinds)):
            costs, more = self.before(costs, role, kind)
            least += more
        return costs, least

    def walk(self, roles: bytes, kinds: bytes, end: Costs, state: int) -> Iterator[tuple[int, str, int]]:
        """(row, edits up to and of the row, state before them) of the ASCII-least cheapest edits, row by row.

        Costs are kept at every ``isqrt``-th row only; the rows between two checkpoints are computed again
        when the walk gets there.  So it holds twice the square root of the rows in costs, in twice the steps.
        """
        rows, step = len(roles), isqrt(len(roles)) + 1
        least = min(end)
        costs = tuple(c - least for c in end)
        starts = range(0, rows, step)
        checkpoints = {}
        for start in reversed(starts):
            checkpoints[start] = costs
            for i in range(min(start + step, rows) - 1, start - 1, -1):
                costs = self.before(costs, roles[i], kinds[i])[0]
        for start in starts:
            stop = min(start + step, rows)
            after = [checkpoints.pop(start)]
            for i in range(stop - 1, start, -1):
                after.append(self.before(after[-1], roles[i], kinds[i])[0])
            for i in range(start, stop):
                letters, to = self.edits(after[stop - 1 - i], roles[i], kinds[i], state)
                yield i, letters, state
                state = to


def closing(state: int) -> str:
    """The cheapest edits after the last row."""
    return {NOTHING: "", AFTER_ASSISTANT: "", AFTER_USER: "I", AFTER_SYSTEM: "II"}[state]


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by the CRC-32 of ``conv_id:turn``; nulls are one space in it, in roles and in texts."""
    shown = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (conv_col, turn_col)]
    hit = F.crc32(F.concat_ws(":", *shown).cast("binary")) % 20
    rows = conversations.select(
        F.col(f"`{conv_col}`").alias("conv_id"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit(" ")).alias("text"),
        hit.alias("hit"),
    )
    copies = F.when(F.col("hit") == 0, 0).when(F.col("hit") == 3, 2).otherwise(1)
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"),
    ).drop("copy")


def _digested(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("digest"))


def _ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, n, kind, part): equal rows once with their number, in order, in partitions that a conversation may span.

    The first fault of a row, without a join: the first turn of every (conversation, role, text) comes back
    as a mark on its own row.  Of equal rows of a turn the first can be no duplicate, the others are.
    """
    same = ["conv_id", "role", "digest", "blank", "cut"]
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    shown = rows.select("conv_id", "turn", "role", "digest", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(*ENDS)).alias("cut"))
    counted = shown.groupBy(*same, "turn").agg(F.count(F.lit(1)).alias("n"))
    marks = counted.groupBy(*same).agg(F.min(F.struct("turn")).alias("first")).select(*same, F.col("first.turn").alias("turn"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("first"))
    marked = counted.withColumn("first", F.lit(False)).unionByName(marks).groupBy(*same, "turn").agg(F.sum("n").alias("n"), F.max("first").alias("first"))
    kind = F.when(F.col("blank"), BLANK).when(~F.col("first"), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(FINE)
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    order = ["conv_id", "turn", "role", "digest"]
    slim = staged(marked.select(*order, "n", kind.alias("kind"), code.alias("code")), "conversation-rows")
    placed = slim.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    return checkpointed(placed)


def _segments(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one conversation in this partition, one conversation after another; rows come sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for frame in frames:
        ids, at = frame.column("conv_id").to_pylist(), 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or ids[i] != ids[at]:
                if held and last != ids[at]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(frame.slice(at, i - at))
                at, last = i, ids[at]
    if held:
        yield pa.Table.from_batches(held)


def _bytes(segment: pa.Table, name: str) -> bytes:
    return segment.column(name).to_numpy().astype(np.uint8).tobytes()


def _repeats(segment: pa.Table) -> int:
    """Rows beyond the first of equal ones: all are deleted at once, so they only add to the cost."""
    return int(segment.column("n").to_numpy().sum()) - segment.num_rows


def _pieces(rows: DataFrame, schema: StructType, solve: Callable[[Programme, pa.Table, object, int], Iterator[dict]], flush: int = 4096) -> DataFrame:
    """The rows that ``solve`` gives for every segment."""
    arrow = to_arrow_schema(schema)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        programme = Programme()
        for segment in _segments(frames):
            for row in solve(programme, segment, segment.column("conv_id")[0].as_py(), segment.column("part")[0].as_py()):
                out.append(row)
                if len(out) >= flush:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, schema)


def _borders(ordered: DataFrame) -> dict[tuple, tuple[Costs, int]]:
    """By (conversation, part): costs at the end and state at the start of the pieces of conversations that lie in several parts.

    A border between two partitions can cut one conversation, so there are at most two pieces a partition:
    that bounds what comes to the driver.  Each piece gives its (min, +) matrix, and then the state that the
    walk from each state ends in.
    """
    cut = ordered.groupBy("conv_id").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    found = [r["conv_id"] for r in cut.select("conv_id").collect()]
    if not found:
        return {}
    named = [i for i in found if i is not None]
    wanted = F.col("conv_id").isin(named) if named else F.lit(False)
    some = ordered.where(F.coalesce(wanted, F.lit(False)) | (F.col("conv_id").isNull() & F.lit(None in found)))
    key = [ordered.schema["conv_id"], StructField("part", ordered.schema["part"].dataType)]
    units = [tuple(0 if s == t else inf for s in range(STATES)) for t in range(STATES)]

    def matrix(programme, segment, conv, part):
        roles, kinds, more = _bytes(segment, "code"), _bytes(segment, "kind"), DELETE * _repeats(segment)
        for target in range(STATES):
            costs, least = programme.costs_before(roles, kinds, units[target])
            yield {"conv_id": conv, "part": part, "target": target, "costs": [c + least + more for c in costs]}

    made = _pieces(some, StructType([*key, *StructType.fromDDL("target int, costs array<double>").fields]), matrix).collect()
    matrices: dict[tuple, dict[int, list]] = {}
    for r in made:
        matrices.setdefault((r["conv_id"], r["part"]), {})[r["target"]] = r["costs"]
    parts: dict = {}
    for conv, part in sorted(matrices, key=lambda k: k[1]):
        parts.setdefault(conv, []).append(part)
    ends: dict[tuple, Costs] = {}
    for conv, own in parts.items():
        costs = AT_END
        for part in reversed(own):
            ends[conv, part] = costs
            costs = tuple(min(matrices[conv, part][t][s] + costs[t] for t in range(STATES)) for s in range(STATES))

    def ending(programme, segment, conv, part):
        roles, kinds = _bytes(segment, "code"), _bytes(segment, "kind")
        found = []
        for state in range(STATES):
            to = state
            for i, letters, before in programme.walk(roles, kinds, ends[conv, part], state):
                to = _after(roles[i], letters, before)
            found.append(to)
        yield {"conv_id": conv, "part": part, "ends": found}

    walked = _pieces(some, StructType([*key, *StructType.fromDDL("ends array<int>").fields]), ending).collect()
    reached = {(r["conv_id"], r["part"]): r["ends"] for r in walked}
    solved = {}
    for conv, own in parts.items():
        state = NOTHING
        for part in own:
            solved[conv, part] = (ends[conv, part], state)
            state = reached[conv, part][state]
        solved[conv, own[-1]] += (True,)
    return solved


def _after(role: int, letters: str, state: int) -> int:
    """The state after the edits of a row."""
    for letter in letters:
        if letter in "IR":
            state = EXPECTED[state][0]
        elif letter == "K":
            state = FOLLOWS[state][role]
    return state


_SUMMARY = "cost long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, head int, tail int, audit string"


def _solved(ordered: DataFrame) -> DataFrame:
    """Two sorts of rows, by piece: what is written for a row (``summary`` false), and one with the sums and edits.

    A row stands for the roles ``inserted`` before it, the role it is ``written`` with (null: deleted) and the
    roles that close the conversation after it; rows that nothing is written for are left out.
    """
    borders = _borders(ordered)
    order = [ordered.schema[name] for name in ("conv_id", "turn", "role", "digest")]
    written = StructType.fromDDL("inserted array<string>, written string, closing array<string>").fields
    schema = StructType([*order, *written, *StructType.fromDDL(f"summary boolean, part int, {_SUMMARY}").fields])

    def solve(programme, segment, conv, part):
        roles, kinds = _bytes(segment, "code"), _bytes(segment, "kind")
        numbers, names, digests, turns = segment.column("n").to_numpy(), segment.column("role"), segment.column("digest"), segment.column("turn")
        end, state, *last = borders.get((conv, part), (AT_END, NOTHING, True))
        audit: list[str] = []
        cost = 0
        for i, letters, before in programme.walk(roles, kinds, end, state):
            state, inserted, written, close = before, [], None, []
            for letter in letters:
                to, role = EXPECTED[state]
                if letter == "I":
                    cost += INSERT
                    inserted.append(role)
                elif letter == "D":
                    cost += DELETE
                else:
                    cost += (letter == "R") * REROLE + (kinds[i] == TRUNCATED) * UNMENDED
                    written = role if letter == "R" else names[i].as_py()
                state = to if letter in "IR" else FOLLOWS[state][roles[i]] if letter == "K" else state
            audit.append(letters)
            if numbers[i] > 1:
                cost += DELETE * int(numbers[i] - 1)
                audit.append("D" * int(numbers[i] - 1))
            if last and i == len(roles) - 1:
                for letter in closing(state):
                    state, role = EXPECTED[state]
                    cost += INSERT
                    close.append(role)
                    audit.append(letter)
            if inserted or written is not None or close:
                key = {"conv_id": conv, "turn": turns[i].as_py(), "role": names[i].as_py(), "digest": digests[i].as_py()}
                yield key | {"inserted": inserted, "written": written, "closing": close, "summary": False}
        known = turns.drop_null().to_numpy()
        blank = np.frombuffer(kinds, np.uint8) == BLANK
        copies = int(numbers.sum()) - len(roles)
        yield {
            "conv_id": conv,
            "summary": True,
            "part": part,
            "cost": cost,
            "blank": int(numbers[blank].sum()),
            "duplicate": int(numbers[~blank].sum()) - int((~blank).sum()) + kinds.count(DUPLICATE),
            "truncated": kinds.count(TRUNCATED),
            "illegal": copies + sum(pair not in LEGAL_PAIRS for pair in zip(roles, roles[1:])),
            "turns": len(np.unique(known)),
            "low": int(known[0]) if len(known) else None,
            "high": int(known[-1]) if len(known) else None,
            "head": roles[0],
            "tail": roles[-1],
            "audit": "".join(audit),
        }

    return staged(_pieces(ordered, schema, solve), "conversation-edits")


def _merged(solved: DataFrame, digested: DataFrame) -> DataFrame:
    """(conv_id, inserted, written, closing, text): what is written for a row, then the row's text, in the order of each conversation.

    Texts are shuffled once, to where their conversation is.  The next text after a written row is its own.
    """
    order = ["conv_id", "turn", "role", "digest"]
    roles = [F.col(name) for name in ("inserted", "written", "closing")]
    edits = solved.where("not summary").select(*order, *roles, F.lit(None).cast("binary").alias("text"))
    none = [F.lit(None).cast(edits.schema[name].dataType).alias(name) for name in ("inserted", "written", "closing")]
    rows = digested.select(*order, *none, F.col("text").cast("binary").alias("text"))
    both = edits.unionByName(rows).repartition("conv_id").sortWithinPartitions(*order, F.col("inserted").isNull())
    return both.select("conv_id", *roles, "text")


def _lines(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, pa.Scalar | None]]:
    """(conversation, role, text) of the repaired conversations, line by line."""
    waiting: tuple[str, list[str]] | None = None
    for frame in frames:
        convs, inserted, written, closes = (frame.column(i).to_pylist() for i in range(4))
        texts = frame.column(4)
        for i, conv in enumerate(convs):
            after: list[str] = []
            if inserted[i] is None:
                if waiting is not None:
                    yield conv, waiting[0], texts[i]
                    after, waiting = waiting[1], None
            else:
                for role in inserted[i]:
                    yield conv, role, None
                if written[i] is None:
                    after = closes[i]
                else:
                    waiting = (written[i], closes[i])
            for role in after:
                yield conv, role, None


def _hashes(merged: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256).  The hash of a conversation takes its lines one after another, so they stream through one task, which holds one Arrow frame at a time."""
    schema = StructType([merged.schema["conv_id"], *StructType.fromDDL("repaired_sha256 string").fields])
    arrow = to_arrow_schema(schema)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, running = None, None
        done: list[tuple] = []
        for conv, role, text in _lines(frames):
            if running is None or conv != last:
                if running is not None:
                    done.append((last, running.hexdigest()))
                last, running = conv, hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(f"{role}:".encode())
            if text is not None:
                running.update(text.as_buffer())
            if len(done) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), arrow)], schema=arrow)
                done = []
        if running is not None:
            done.append((last, running.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), arrow)], schema=arrow)

    return merged.mapInArrow(run, schema)


def _joined(solved: DataFrame) -> DataFrame:
    """One row per conversation from its pieces, of which there are as many as partitions at the utmost."""
    pieces = solved.where("summary").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", *[c.split()[0] for c in _SUMMARY.split(", ")]))).alias("p"))
    total = lambda name: F.aggregate(F.col(f"p.{name}"), F.lit(0).cast("long"), lambda a, x: a + x)
    following = F.arrays_zip(
        F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))).alias("a"), F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))).alias("b")
    )
    pair = lambda z, a, b: (z["a"]["tail"] == a) & (z["b"]["head"] == b)

    def legal(z: Column) -> Column:
        out = F.lit(False)
        for a, b in LEGAL_PAIRS:
            out = out | pair(z, a, b)
        return out

    illegal = F.size(F.filter(following, lambda z: ~legal(z))).cast("long")
    shared = F.size(F.filter(following, lambda z: F.coalesce(z["a"]["high"] == z["b"]["low"], F.lit(False)))).cast("long")
    span = F.array_max(F.col("p.high")) - F.array_min(F.col("p.low")) + 1
    return pieces.select(
        "conv_id",
        F.coalesce(span - (total("turns") - shared), F.lit(0)).cast("long").alias("gaps"),
        *[total(name).alias(name) for name in ("blank", "duplicate", "truncated")],
        (total("illegal") + illegal).alias("illegal"),
        total("cost").alias("cost"),
        F.array_join(F.col("p.audit"), "").alias("audit"),
    )


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, at, role, text): the repaired conversations, their lines counted from 0.

    ``rows`` are (conv_id, turn, role, text); null roles and texts are one space.  The edits are those of ``repair``.
    """
    digested = _digested(_plain(rows))
    merged = _merged(_solved(_ordered(digested)), digested)
    schema = StructType([merged.schema["conv_id"], *StructType.fromDDL("at long, role string, text string").fields])
    arrow = to_arrow_schema(schema)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, out = None, -1, []
        for conv, role, text in _lines(frames):
            at = at + 1 if at >= 0 and conv == last else 0
            last = conv
            out.append((conv, at, role, "" if text is None else text.as_py().decode()))
            if len(out) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), arrow)], schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), arrow)], schema=arrow)

    return merged.mapInArrow(run, schema)


def repair(rows: DataFrame, everyone: DataFrame | None = None) -> DataFrame:
    """One row per conversation: its faults, the least cost of mending it, the edits, and the SHA-256 of the result.

    ``rows`` are (conv_id, turn, role, text), other columns are not read.  The order is that of the turn,
    nulls first, then of the role and of the text's SHA-256; equal rows are repeats of each other.  Null
    roles and texts are one space, a null ``conv_id`` is a conversation of its own.  ``everyone``: a table
    whose ``conv_id`` values are returned even without rows; they get zeros, no edits and the hash of the
    empty text, and with none at all the result is empty.  A conversation of any share of the rows is cut
    into pieces of a partition; only its hash is taken in one pass over its lines.
    """
    digested = _digested(_plain(rows))
    solved = _solved(_ordered(digested))
    hashes = _hashes(_merged(solved, digested)).withColumnRenamed("conv_id", "_hashed")
    summary = _joined(solved).withColumnRenamed("conv_id", "_solved")
    ids = (rows if everyone is None else everyone).select("conv_id").distinct()
    out = ids.join(summary, ids["conv_id"].eqNullSafe(summary["_solved"]), "left").join(hashes, ids["conv_id"].eqNullSafe(hashes["_hashed"]), "left")
    counts = [F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))

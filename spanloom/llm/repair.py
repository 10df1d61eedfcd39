"""Repair of conversation structure: cheapest edits to a legal order of roles, by a Viterbi search in bounded memory.

The search keeps one survivor for each state of the grammar. Their histories form a tree of back pointers; a branch that no
survivor holds any more goes, and whatever all survivors share is settled and leaves at once with its rows. So a task holds
the unsettled end of one conversation, not the conversation.
"""
from __future__ import annotations

import hashlib
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Blanks of the contract, as a character class.
_BLANK = r"\x20\x09-\x0D"
#: What edits cost: keeping, another role, deleting, inserting; and what a truncated row adds unless it is deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

#: States of ``(s?(ua)+)?``: nothing yet, a system row, an open user row, a closed pair.
START, SYSTEM, USER, PAIR = range(4)
#: What can be inserted before a row, and where that leads: (letters, state).
_INSERTS = {START: [("", START), ("I", USER), ("II", PAIR)], SYSTEM: [("", SYSTEM), ("I", USER), ("II", PAIR)],
            USER: [("", USER), ("I", PAIR)], PAIR: [("", PAIR), ("I", USER)]}
#: What reading u or a does to a state.
_U, _A = {START: USER, SYSTEM: USER, PAIR: USER}, {USER: PAIR}
#: Whatever may follow, going on from the first state costs at most so much more than going on from the second: a missing
#: turn is inserted (3 each), and a system row that only the second can keep is deleted (4).
_EXCESS = {
    (START, SYSTEM): 0, (START, PAIR): 0, (START, USER): 3,
    (SYSTEM, START): 6, (SYSTEM, PAIR): 6, (SYSTEM, USER): 3,
    (PAIR, START): 4, (PAIR, SYSTEM): 0, (PAIR, USER): 3,
    (USER, START): 7, (USER, SYSTEM): 3, (USER, PAIR): 3,
}


def _moves(initial: str, fault: str):
    """(letter, cost, {state: next state}) of the edits of a row."""
    moves = [("D", DELETE, {q: q for q in range(4)})]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        kept = {"s": {START: SYSTEM}, "u": _U, "a": _A}.get(initial)
        if kept:
            moves.append(("K", KEEP + more, kept))
        moves += [("R", REROLE + more, to) for other, to in (("u", _U), ("a", _A)) if other != initial]
    return moves


def _step(held: tuple, initial: str, fault: str) -> tuple:
    """The survivors after a row: (state, cost, state it came from, letters), in the order of their whole edits.

    ``held`` are (state, cost) of the survivors before it, in that order too. Edits up to a row end with that row's letter
    and none is the beginning of another, so the order of complete histories is the order of the survivors they go
    through, then of the letters added here: a tie compares everything that is unsettled without walking it again.
    """
    moves, best = _moves(initial, fault), {}
    for rank, (state, cost) in enumerate(held):
        for letters, at in _INSERTS[state]:
            for letter, price, to in moves:
                if at in to:
                    key = (cost + INSERT * len(letters) + price, rank, letters + letter)
                    if to[at] not in best or key < best[to[at]]:
                        best[to[at]] = key
    # one that could not be cheapest whatever follows is no survivor; an equal one may win by its letters
    alive = [q for q, (c, _, _) in best.items() if all(c <= best[p][0] + _EXCESS[p, q] for p in best if p != q)]
    return tuple((q, best[q][0], held[best[q][1]][0], best[q][2]) for q in sorted(alive, key=lambda q: best[q][1:]))


class _Node:
    """Letters of one row on the way to a survivor; ``children`` counts and names the references to it."""
    __slots__ = ("parent", "letters", "children")

    def __init__(self, parent, letters):
        self.parent, self.letters, self.children = parent, letters, []


class Search:
    """Edits of one conversation, row by row: ``push`` and ``end`` give the letters settled so far, one string for a row."""

    #: Steps already worked out: costs are taken relative to the least, so there are few.
    known: dict = {}

    def __init__(self):
        self.root = _Node(None, "")
        self.held, self.base = ((START, 0),), 0
        self.nodes = {START: self.root}

    def push(self, initial: str, fault: str) -> list[str]:
        key = (self.held, initial, fault)
        step = self.known.get(key)
        if step is None:
            step = self.known[key] = _step(*key)
        nodes = {}
        for state, _, origin, letters in step:
            parent = self.nodes[origin]
            nodes[state] = node = _Node(parent, letters)
            parent.children.append(node)
        for old in self.nodes.values():
            while old is not self.root and not old.children:
                parent, old.parent = old.parent, None
                parent.children.remove(old)
                old = parent
        least = min(cost for _, cost, _, _ in step)
        self.base += least
        self.nodes, self.held = nodes, tuple((state, cost - least) for state, cost, _, _ in step)
        return self._settled()

    def _settled(self) -> list[str]:
        out = []
        while len(self.root.children) == 1:
            self.root = self.root.children[0]
            self.root.parent = None
            out.append(self.root.letters)
        return out

    def end(self) -> tuple[list[str], str, int]:
        """The letters of the rows still open, what is inserted after the last row, and the cost of all."""
        def last(rank):
            state, cost = self.held[rank]
            return [(cost + INSERT * len(x), rank, x, state) for x, at in _INSERTS[state] if at in (START, PAIR)]

        cost, _, letters, state = min(x for rank in range(len(self.held)) for x in last(rank))
        out, node = [], self.nodes[state]
        while node is not self.root:
            out.append(node.letters)
            node = node.parent
        return out[::-1], letters, self.base + cost


SCHEMA = "seq long, edit string, turn long, role string, text string, was string, fault string, total long"


def _edited(batches, id_):
    """Rows of conversations in order -> rows of edits in order."""
    names = [id_, "seq", "edit", "turn", "role", "text", "was", "fault", "total"]
    out, size = [], 0
    search, conv, kind, waiting, seq, open_pair = None, None, None, deque(), 0, False

    def emit(letters, rows):
        """Edits of settled rows; roles alternate, so the letters give each role."""
        nonlocal seq, open_pair, size
        for word in letters:
            for letter in word:
                role, text, was, fault, turn = "assistant" if open_pair else "user", "", None, None, None
                if letter != "I":
                    turn, was, text, fault = rows.popleft()
                    role = role if letter == "R" else was
                out.append((conv, seq, letter, turn, role, text, was, fault, None))
                seq, size = seq + 1, size + len(text) + 64
                if letter in "IR" or letter == "K" and not role.startswith("s"):
                    open_pair = not open_pair

    def finish():
        letters, last, cost = search.end()
        emit([*letters, last], waiting)
        # the closing row of a conversation: no edit, but what all edits cost
        out.append((conv, seq, None, None, None, None, None, None, cost))

    def flush():
        columns = list(zip(*out)) if out else [[] for _ in names]
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    for batch in batches:
        kind = batch.schema.field(0).type
        for c, turn, role, text, fault in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if search is None or c != conv:
                if search is not None:
                    finish()
                search, conv, seq, open_pair = Search(), c, 0, False
                waiting.clear()
            waiting.append((turn, role, text, fault))
            emit(search.push(role[:1] if role[:1] in ("s", "u", "a") else "", fault), waiting)
            if size > 1 << 22 or len(out) > 4000:
                yield flush()
                out, size = [], 0
    if search is not None:
        finish()
    if out:
        yield flush()


def repaired(df: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The cheapest edits that give each conversation roles whose initials read ``(s?(ua)+)?``.

    One row for each edit: id, seq (from 0), edit (K keep, R another role, D delete, I insert), turn, role and text as
    repaired (of a deleted row as they were), was (the role before; null for an insert), fault, total null; then a closing
    row with edit null and total, the cost of all edits. Rows of a conversation stay in order in one partition.

    Rows are read by turn (nulls first), then role, then text. A row's first fault counts: ``blank`` (nothing but blanks),
    ``duplicate`` (role and text stood earlier in the conversation), ``truncated`` (the last character that is no blank is
    none of ``.!?``), else ''. Blank and duplicate rows must be deleted. Keep costs 0, Rerole to user or assistant 3,
    Delete 4, Insert of an empty user or assistant row 3, and a truncated row that stays 3 more; of equal costs the least
    string of edits wins. A null role or text counts as one blank, a null id is a conversation like others, equal rows are
    duplicates, an empty table gives an empty table. Columns but the four named are left out, whatever their names.

    Rows are shuffled once, by id; earlier copies are found and rows are ordered by sorts that spill. Reading in turn
    order makes one conversation the work of one task, which streams it and holds only rows whose edit is unsettled: a few,
    unless roles never decide (a run of user rows alone keeps two histories open to its end).
    """
    blank = F.lit(" ")
    rows = df.select(F.col(id).alias("c"), F.col(turn).cast("long").alias("n"), F.coalesce(F.col(role).cast("string"), blank).alias("r"), F.coalesce(F.col(text).cast("string"), blank).alias("x"))
    again = Window.partitionBy("c", "r", "x").orderBy(F.col("n").asc_nulls_first())
    rows = rows.repartition("c").withColumn("k", F.row_number().over(again))
    fault = (F.when(~F.col("x").rlike(f"[^{_BLANK}]"), "blank").when(F.col("k") > 1, "duplicate")
             .when(~F.col("x").rlike(rf"[.!?][{_BLANK}]*+\z"), "truncated").otherwise(""))
    rows = rows.sortWithinPartitions(F.col("c"), F.col("n").asc_nulls_first(), "r", "x", "k").select(F.col("c").alias(id), "n", "r", "x", fault.alias("f"))
    return rows.mapInArrow(lambda batches: _edited(batches, id), f"`{id}` {df.schema[id].dataType.simpleString()}, {SCHEMA}")


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the planned damage, by the checksum of ``conv_id:turn`` (nulls: one blank) modulo 20:
    0 drops a row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes its role user. Null role or text: one blank."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    act = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(act == 1, "").when(act == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    rows = df.select("conv_id", "turn", F.when(act == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), act.alias("act"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("act") == 3, 2).otherwise(1)))
    return rows.filter("act <> 0").select("conv_id", "turn", "role", "text", times.alias("again")).drop("again")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _digested(batches, id_):
    """Edits in order -> one row for each conversation; the text is hashed as it passes."""
    out, kind = [], None
    names, fresh = [id_, *_COUNTS, "audit", "repaired_sha256"], lambda: [hashlib.sha256(), [], [None, None, 0], dict.fromkeys(_COUNTS, 0), None, True]
    digest, audit, turns, counts, before, first = fresh()

    def flush():
        kinds = [kind, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
        columns = list(zip(*out)) if out else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, _, edit, turn, role, text, was, fault, total in zip(*(batch.column(i).to_pylist() for i in range(9))):
            if edit is None:
                low, high, distinct = turns
                counts["gaps"], counts["cost"] = (high - low + 1 - distinct if distinct else 0), total
                out.append((conv, *(counts[k] for k in _COUNTS), "".join(audit), digest.hexdigest()))
                digest, audit, turns, counts, before, first = fresh()
                continue
            audit.append(edit)
            if was is not None:
                if fault:
                    counts[fault] += 1
                counts["illegal"] += before is not None and before + was[:1] not in ("su", "ua", "au")
                before = was[:1]
                if turn is not None and turn != turns[1]:
                    turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
            if edit != "D":
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        if len(out) > 4000:
            yield flush()
            out = []
    if out:
        yield flush()


def digests(edits: DataFrame, id: str = "conv_id") -> DataFrame:
    """One row for each conversation of ``repaired``: counts of faults, cost, the edits' letters, a hash of the repaired
    ``role:text`` lines. It follows ``repaired`` in the same stage, so rows are still in order."""
    kind = edits.schema[id].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return edits.mapInArrow(lambda batches: _digested(batches, id), f"`{id}` {kind}, {counts}, audit string, repaired_sha256 string")


def audited(df: DataFrame) -> DataFrame:
    """``digests`` of ``repaired`` over the ``damaged`` rows, for every conversation of ``df``: one without rows after the
    damage has zeros, no edits and the hash of an empty string. Edits of one conversation are one string, so of one value's size."""
    found = digests(repaired(damaged(df.select("conv_id", "turn", "role", "text"))))
    ids = df.select(F.col("conv_id").alias("whole")).distinct()
    joined = ids.join(found, ids["whole"].eqNullSafe(found["conv_id"]), "left")
    return joined.select(
        F.col("whole").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))

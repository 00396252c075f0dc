"""Conversation structure repair by a run-length dynamic programme.

A conversation in good order has the role initials ``(s?(ua)+)?``.  Edits lead there: keep a turn (K),
give it the other role (R), delete it (D), insert an empty turn (I).  What a turn allows depends only on
its symbol: role initial and fault.  The cost of going on from each of the four places of the pattern
(nothing yet, after s, after u, after a) is a vector; a turn is a 4 x 4 matrix in the (min, +) algebra.

Equal consecutive symbols are collapsed to runs.  A run of n turns is applied to the vector through the
binary powers of its matrix, which are cached for the whole worker.  The choices are unrolled from the
left by halving each run at its powers; halves that were unrolled before are looked up.  At any place
each letter leads to one next place, so taking the smallest letter that still reaches the least cost gives
the smallest of all cheapest audits.

Turns travel to the programme as role, order and a digest.  Each conversation is a stream sorted by order; a
worker holds one byte a turn of it, which is the length of the audit it puts out.  A second sorted stream
carries the texts past the audit and gives the repaired turns.  Repeats are found by windows over
(conversation, role, text), whose hot keys are cut into segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import durable, record_batch
from caseflow.operators import ordered

# What the edits cost, and what a truncated turn costs that is not deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Places of the pattern; the conversation may end at NOTHING and AFTER_A.
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
PLACES = range(4)
#: Where a user or assistant turn leads: the pattern asks for exactly one of them everywhere.
ONWARD = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
ROLE = {AFTER_U: "user", AFTER_A: "assistant"}
NEVER = 1 << 60
CUT = {"s": "S", "u": "U", "a": "A", "-": "="}

FAULTS = ("blank", "duplicate", "truncated")
_WORD, _ENDS = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"

Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]


def _plus(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(NEVER, *(a[i][k] + b[k][j] for k in PLACES)) for j in PLACES) for i in PLACES)


def _onto(a: Matrix, v: Vector) -> Vector:
    return tuple(min(NEVER, *(a[i][k] + v[k] for k in PLACES)) for i in PLACES)


#: No, one or two insertions; more of them only lead in circles.
INSERTIONS: Matrix = tuple(tuple(0 if i == j else INSERT if ONWARD[i] == j else 2 * INSERT if ONWARD[ONWARD[i]] == j else NEVER for j in PLACES) for i in PLACES)
END: Vector = _onto(INSERTIONS, (0, NEVER, NEVER, 0))


def _kept(initial: str, place: int) -> int | None:
    """Where a turn leads that stays as it is."""
    if initial == "s":
        return AFTER_S if place == NOTHING else None
    return ONWARD[place] if initial == ROLE[ONWARD[place]][0] else None


@lru_cache(maxsize=None)
def _edits(symbol: str, place: int) -> tuple[tuple[str, int, int], ...]:
    """(letter, cost, next place) of the edits of one turn, smallest letter first.

    A symbol is the initial of a turn (- for anything but s, u, a), its counterpart in ``CUT`` where the
    turn is truncated, or x where it must go.
    """
    found = [("D", DELETE, place)]
    if symbol != "x":
        extra, kept = TRUNCATED if symbol in CUT.values() else 0, _kept(symbol.lower(), place)
        if kept is not None:
            found.append(("K", KEEP + extra, kept))
        found.append(("R", REROLE + extra, ONWARD[place]))
    return tuple(found)


@lru_cache(maxsize=None)
def _power(symbol: str, k: int) -> Matrix:
    """The matrix of 2**k turns of one symbol."""
    if k:
        return _plus(_power(symbol, k - 1), _power(symbol, k - 1))
    one = [[NEVER] * 4 for _ in PLACES]
    for place in PLACES:
        for _, cost, after in _edits(symbol, place):
            one[place][after] = min(one[place][after], cost)
    return _plus(INSERTIONS, tuple(map(tuple, one)))


def _before(symbol: str, n: int, after: Vector) -> Vector:
    """The costs before a run, from those after it."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            after = _onto(_power(symbol, k), after)
    return after


@lru_cache(maxsize=1 << 16)
def _unrolled(symbol: str, k: int, place: int, after: Vector) -> tuple[str, int]:
    """Letters of 2**k turns from a place, and the place they lead to; ``after`` counts from its least cost."""
    if k:
        left, place = _choices(symbol, k - 1, place, _onto(_power(symbol, k - 1), after))
        right, place = _choices(symbol, k - 1, place, after)
        return left + right, place
    here, letters = _onto(_power(symbol, 0), after), ""
    while True:
        delete, *rest = _edits(symbol, place)
        if delete[1] + after[place] == here[place]:
            return letters + "D", place
        if INSERT + here[ONWARD[place]] == here[place]:
            letters, place = letters + "I", ONWARD[place]
            continue
        for letter, cost, onward in rest:
            if cost + after[onward] == here[place]:
                return letters + letter, onward


def _choices(symbol: str, k: int, place: int, after: Vector) -> tuple[str, int]:
    least = min(after)
    return _unrolled(symbol, k, place, tuple(min(v - least, NEVER) for v in after))


def cheapest(symbols: str) -> tuple[int, str]:
    """Least cost and smallest cheapest audit of a conversation given by its symbols."""
    runs = [(s, sum(1 for _ in g)) for s, g in groupby(symbols)]
    after = [END]
    for symbol, n in reversed(runs):
        after.append(_before(symbol, n, after[-1]))
    cost, place, letters = after[-1][NOTHING], NOTHING, []
    for (symbol, n), v in zip(runs, reversed(after[:-1])):
        for k in reversed(range(n.bit_length())):
            if n >> k & 1:
                n -= 1 << k
                text, place = _choices(symbol, k, place, _before(symbol, n, v))
                letters.append(text)
    while place in (AFTER_S, AFTER_U):
        place = ONWARD[place]
        letters.append("I")
    return cost, "".join(letters)


_FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of facts per conversation from its turns in order."""
    names = [f.split()[0] for f in ("conv_id long, " + _FACTS).split(", ")]

    class Open:
        def __init__(self, conv_id):
            self.conv_id, self.symbols, self.last = conv_id, bytearray(), None
            self.counts, self.illegal = dict.fromkeys(FAULTS, 0), 0
            self.first = self.turn = None
            self.turns = 0

        def add(self, turn, initial, fault):
            if self.last is not None and self.last + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.last = initial
            if turn is not None and turn != self.turn:
                self.first = turn if self.first is None else self.first
                self.turn, self.turns = turn, self.turns + 1
            if fault:
                self.counts[fault] += 1
            known = initial if initial in CUT else "-"
            self.symbols += (known if not fault else CUT[known] if fault == "truncated" else "x").encode()

        def row(self):
            cost, audit = cheapest(self.symbols.decode())
            gaps = 0 if self.first is None else self.turn - self.first + 1 - self.turns
            return (self.conv_id, gaps, *self.counts.values(), self.illegal, cost, audit)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * (len(names) - 1) + [pa.string()]
        return record_batch({n: pa.array(c, t) for n, c, t in zip(names, zip(*rows), kinds)})

    now = None
    for batch in batches:
        done = []
        for conv_id, turn, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault"))):
            if now is None or now.conv_id != conv_id:
                done += [now.row()] if now else []
                now = Open(conv_id)
            now.add(turn, initial, fault)
        if done:
            yield out(done)
    if now:
        yield out([now.row()])


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(conv_id, edit, role, text) in order, from each conversation's audit followed by its turns."""
    conv_id, audit, at, place = None, "", 0, NOTHING

    def inserted(done: list[tuple]) -> None:
        nonlocal at, place
        while at < len(audit) and audit[at] == "I":
            at, place = at + 1, ONWARD[place]
            done.append((conv_id, "I", ROLE[place], ""))

    for batch in batches:
        done: list[tuple] = []
        for key, plan, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text"))):
            if plan is not None:
                inserted(done)
                conv_id, audit, at, place = key, plan, 0, NOTHING
                continue
            inserted(done)
            letter, at = audit[at], at + 1
            if letter == "K":
                place = _kept(role[:1], place)
            elif letter == "R":
                place = ONWARD[place]
                role = ROLE[place]
            done.append((conv_id, letter, role, text))
        yield done
    done = []
    inserted(done)
    yield done


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, number = object(), 0
    for rows in _applied(batches):
        numbers = []
        for conv_id, *_ in rows:
            number = number + 1 if conv_id == last else 1
            last = conv_id
            numbers.append(number)
        c, e, r, t = zip(*rows) if rows else ((),) * 4
        yield record_batch({"conv_id": pa.array(c, pa.int64()), "step": pa.array(numbers, pa.int64()), "edit": pa.array(e, pa.string()), "role": pa.array(r, pa.string()), "text": pa.array(t, pa.string())})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of the turns that stay, one a line, per conversation: a stream, whatever its length."""
    rows = ((conv_id, edit, role, text) for found in _applied(batches) for conv_id, edit, role, text in found)
    done: list[tuple] = []
    for conv_id, own in groupby(rows, key=lambda r: r[0]):
        digest, first = hashlib.sha256(), True
        for _, edit, role, text in own:
            if edit != "D":
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        done.append((conv_id, digest.hexdigest()))
        if len(done) == 2000:
            yield record_batch({"conv_id": pa.array([d[0] for d in done], pa.int64()), "repaired_sha256": pa.array([d[1] for d in done], pa.string())})
            done = []
    yield record_batch({"conv_id": pa.array([d[0] for d in done], pa.int64()), "repaired_sha256": pa.array([d[1] for d in done], pa.string())})


@dataclass(frozen=True)
class Repair:
    """``facts``: per conversation (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)."""

    facts: DataFrame
    _stream: DataFrame

    def turns(self) -> DataFrame:
        """(conv_id, step, edit, role, text): every turn, deleted ones too, and the inserted ones, in order.
        Rows with edit D are not part of the repaired conversation."""
        return self._stream.mapInArrow(_turns, "conv_id long, step long, edit string, role string, text string")

    def digests(self) -> DataFrame:
        """(conv_id, repaired_sha256): the repaired turns as ``role:text``, joined by newlines."""
        return self._stream.mapInArrow(_digests, "conv_id long, repaired_sha256 string")


_ORDER = ["turn", "role", "digest", "copy"]


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, *_ORDER)


def repaired(turns: DataFrame, copy: str | None = None) -> Repair:
    """Diagnose and repair conversations (conv_id, turn, role, text).

    Turns are ordered by ``turn`` (NULL first), then role, then a digest of the text, then ``copy``, which tells rows apart that
    agree in everything else.  A NULL role or text counts as one space; NULL is a conversation like any
    other.  A turn has one fault at most: blank (no word), duplicate (role and text seen earlier in the
    conversation), truncated (not ended by ``.``, ``!`` or ``?``).  Roles are known by their first
    letter; one that is neither s, u nor a cannot be kept.  Other columns are ignored.  An empty table
    has no conversations.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.col(copy) if copy else F.lit(0)).cast("int").alias("copy"),
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))
    flaw = F.when(~F.col("text").rlike(_WORD), "blank").when(~F.col("text").rlike(_ENDS), "truncated")
    narrow = rows.select("conv_id", "turn", "role", "digest", "copy", flaw.alias("flaw"))
    with ordered.known_hot(conv_id=lambda: narrow.select("conv_id")):
        seen = ordered.positions(narrow, ["conv_id", "role", "digest"], ["turn", "copy"], "seen")
        fault = F.when(F.col("flaw") == "blank", "blank").when(F.col("seen") > 1, "duplicate").otherwise(F.col("flaw"))
        signs = _in_order(seen.select("conv_id", *_ORDER, F.substring("role", 1, 1).alias("initial"), fault.alias("fault")))
        facts = durable(signs.mapInArrow(_facts, f"conv_id long, {_FACTS}"))
    plans = facts.select("conv_id", "audit", F.lit(0).alias("kind"))
    stream = _in_order(plans.unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True), "kind")
    return Repair(facts, stream.select("conv_id", "audit", "role", "text"))


def with_conversations(ids: DataFrame, found: Repair) -> DataFrame:
    """One row per conversation of ``ids``; those without a turn have zeros, an empty audit and the hash of nothing."""
    every = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = ordered.attach(ordered.attach(every, found.facts, ["conv_id"]), found.digests(), ["conv_id"])
    nothing = {c.split()[0]: 0 for c in _FACTS.split(", ")} | {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return joined.withColumns({c: F.coalesce(c, F.lit(v).cast("string" if isinstance(v, str) else "long")) for c, v in nothing.items()})

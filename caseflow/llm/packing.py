"""Bounded-space online packing of token sequences into windows.

Every task tokenises its documents and packs them as they come.  It keeps a fixed number of open
windows: a piece goes to the fullest window that has room for it; where none has, the fullest is
closed, after the piece's head has filled it where too much room would stay empty.  What is still
open at the end travels as pieces, without tokens, and is packed again over groups of tasks, in
rounds, until one group is left; a group never holds more than ``fan_in`` tasks' open windows.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import durable, record_batch, texts

# The pattern by which the vocabulary's tokenizer cuts lower-cased text, here for texts
# of ASCII and Latin-1 letters, where lower-casing and composing change nothing else.
SIMPLE_TEXT = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
SIMPLE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
SPACES = re.compile(r"[ \t\n\r]+")
#: Tokens a task remembers; beyond it the memory starts anew.
REMEMBERED = 400_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")


@dataclass(frozen=True)
class Packing:
    """``size`` tokens a window, ``open_windows`` a task, ``fan_in`` tasks' leftovers merged at a time.

    A window with ``least_cut`` or more free tokens is not closed before a piece's head has filled it.
    """

    vocabulary: str
    end_id: int = 1
    size: int = 2048
    open_windows: int = 32
    fan_in: int = 32
    least_cut: int = 16


def encoder(vocabulary: str) -> Callable[[str], bytes]:
    """Text to little-endian 32-bit ids, equal to the tokenizer's own ``encode``.

    The tokenizer drops white space and never joins over it, and within simple text its tokens follow
    from the lower-cased text alone.  So each distinct token is encoded once and looked up after that.
    Words with other signs, and texts that may hold special tokens, go to the tokenizer as they are.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    moved = [b for b in range(256) if b not in kept]
    as_text = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}

    class Known(dict):
        def __missing__(self, token: str) -> bytes:
            if len(self) >= REMEMBERED:
                self.clear()
            spelled = "".join(map(as_text.__getitem__, token.encode()))
            ids = np.array([t.id for t in tokenizer.model.tokenize(spelled)], "<u4").tobytes()
            self[token] = ids
            return ids

    known = Known()

    def whole(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def simple(text: str) -> bytes:
        return b"".join(map(known.__getitem__, SIMPLE_TOKEN.findall(text.lower())))

    def encode(text: str) -> bytes:
        if "<|" in text:
            return whole(text)
        if SIMPLE_TEXT.fullmatch(text):
            return simple(text)
        return b"".join(simple(w) if SIMPLE_TEXT.fullmatch(w) else whole(w) for w in SPACES.split(text) if w)

    return encode


class Windows:
    """The open windows of one task; ``closed`` collects finished ones as lists of pieces."""

    def __init__(self, size: int, most: int) -> None:
        self.size, self.most = size, most
        self.fill: list[tuple[int, int]] = []  # (tokens, number), sorted
        self.pieces: dict[int, list[tuple]] = {}
        self.closed: list[list[tuple]] = []
        self.made = 0

    def put(self, pieces: list[tuple], length: int) -> None:
        """``pieces`` stay together: in the fullest window with room, else in a new one."""
        if length == self.size:
            self.closed.append(pieces)
            return
        at = bisect_left(self.fill, (self.size - length + 1, -1)) - 1
        if at >= 0:
            tokens, number = self.fill.pop(at)
            held = self.pieces.pop(number) + pieces
        else:
            if len(self.fill) >= self.most:
                self.closed.append(self.pieces.pop(self.fill.pop()[1]))
            tokens, number, held = 0, self.made, list(pieces)
            self.made += 1
        if tokens + length == self.size:
            self.closed.append(held)
        else:
            insort(self.fill, (tokens + length, number))
            self.pieces[number] = held

    def room_to_fill(self, length: int) -> int:
        """Free tokens of the window that must close before a piece of this length can be placed, else 0."""
        if length == self.size or len(self.fill) < self.most or self.fill[0][0] + length <= self.size:
            return 0
        return self.size - self.fill[-1][0]

    def rest(self) -> list[list[tuple]]:
        return [self.pieces[number] for _, number in self.fill]


def _rows(windows: list[list[tuple]], task: int, first: int, state: int) -> pa.RecordBatch:
    """Pieces of finished (0) or open (1) windows, numbered within the task."""
    columns: list[list[int]] = [[] for _ in range(8)]
    for n, window in enumerate(windows):
        offset = 0
        for piece in window:
            for column, value in zip(columns, (*piece, task, first + n, offset)):
                column.append(value)
            offset += piece[2]
    names = (*FIELDS, "task", "window", "offset")
    return record_batch({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)} | {"open": pa.array([bool(state)] * len(columns[0]), pa.bool_())})


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, window long, offset long, open boolean"


def pieces(docs: DataFrame, packing: Packing, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """First round: tokenise and pack within each task."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = encoder(packing.vocabulary), np.array([packing.end_id], "<u4").tobytes()
        windows, task, done = Windows(packing.size, packing.open_windows), TaskContext.get().partitionId(), 0
        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), texts(batch, "text")):
                ids = encode(raw.decode()) + end
                total = len(ids) // 4
                start = 0
                while start < total:
                    length = min(packing.size, total - start)
                    room = windows.room_to_fill(length)
                    length = room if room >= packing.least_cut else length
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    windows.put([(doc, start, length, crc, total)], length)
                    start += length
            yield _rows(windows.closed, task, done, 0)
            done += len(windows.closed)
            windows.closed.clear()
        yield _rows(windows.rest(), task, done, 1)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(pack, SCHEMA)


def _merge(rest: DataFrame, packing: Packing) -> DataFrame:
    """One round over the open windows of ``fan_in`` neighbouring tasks; windows move as they are."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, windows, done = None, None, 0
        held: list[tuple] = []
        key = None

        def flush() -> None:
            if held:
                windows.put(list(held), sum(p[2] for p in held))
                held.clear()

        def finish() -> Iterator[pa.RecordBatch]:
            flush()
            yield _rows(windows.closed, group, done, 0)
            yield _rows(windows.rest(), group, done + len(windows.closed), 1)

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in (*FIELDS, "task", "window", "group")]
            for *piece, task, window, g in zip(*columns):
                if g != group:
                    if windows is not None:
                        yield from finish()
                    group, windows, done, key = g, Windows(packing.size, packing.open_windows), 0, None
                if (task, window) != key:
                    flush()
                    key = (task, window)
                held.append(tuple(piece))
        if windows is not None:
            yield from finish()

    grouped = rest.withColumn("group", F.floor(F.col("task") / packing.fan_in).cast("long"))
    # Longest windows first, as the best fit wants them.
    filled = F.sum("length").over(Window.partitionBy("group", "task", "window"))
    sorted_rows = grouped.withColumn("filled", filled).repartition("group").sortWithinPartitions("group", F.desc("filled"), "task", "window", "offset")
    return sorted_rows.drop("filled", "offset", "open").mapInArrow(pack, SCHEMA)


def packed(docs: DataFrame, packing: Packing, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's tokens are its ids and ``end_id``; NULL and empty texts are one token long.  Documents
    over ``size`` tokens are cut every ``size`` tokens, any document where its head fills a window.  Pieces of a sequence lie
    gapless from 0.  A row that is there twice is packed twice, a NULL id is kept.  Sequence ids are
    unique, not dense.  No rows give none.
    """
    found = durable(pieces(docs, packing, doc_id, text))
    finished, rest = [found.filter("NOT open")], found.filter("open")
    tasks = (rest.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        merged = durable(_merge(rest, packing))
        finished.append(merged.filter("NOT open"))
        rest, tasks = merged.filter("open"), -(-tasks // packing.fan_in)
        if tasks == 1:
            break
    finished.append(rest)
    # Round, task and window in one number.
    numbered = [
        df.withColumn("sequence_id", F.shiftleft(F.lit(level).cast("long"), 58) + F.shiftleft("task", 32) + F.col("window"))
        for level, df in enumerate(finished)
    ]
    everything = numbered[0]
    for df in numbered[1:]:
        everything = everything.unionByName(df)
    return everything.select(*FIELDS, "sequence_id", "offset")

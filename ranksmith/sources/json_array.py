"""JSON arrays read by many tasks (A1, A2).

Spark's text source with ``,`` as the line separator cuts a file into byte
ranges and hands out the fragments between commas, on any store that Spark
reads. What a comma is depends on all bytes before it, so

1. every range is summarised for both cases "begins outside / inside a string":
   parity of its unescaped quotes, change of bracket depth in either case. An
   escape never crosses a comma, so nothing else is carried;
2. the state at the start of each range follows from sums over the ranges of
   its file (one row per range);
3. with its state known, a range finds the commas that part elements (outside
   strings, depth 1). Elements inside one range leave the task whole; the
   pieces of an element that crosses ranges are joined by one small shuffle.

Malformed files (unbalanced brackets or quotes, text outside the array, empty elements) raise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_QUOTE, _ESCAPE, _OPEN, _CLOSE = ord('"'), ord("\\"), [ord("["), ord("{")], [ord("]"), ord("}")]
_BLANK = " \t\r\n\ufeff"


def _events(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions of unescaped quotes, positions of brackets, +1 / -1 of each bracket).

    ``offs``: starts of the fragments, which end runs of backslashes."""
    quotes = np.flatnonzero(data == _QUOTE)
    if len(quotes):
        start = offs[np.searchsorted(offs, quotes, side="right") - 1]
        plain = np.where(data != _ESCAPE, np.arange(len(data)), -1)
        last = np.concatenate([[-1], np.maximum.accumulate(plain)])[quotes]  # before the run in front of the quote
        quotes = quotes[(quotes - 1 - np.maximum(last, start - 1)) % 2 == 0]
    up, down = np.isin(data, _OPEN), np.isin(data, _CLOSE)
    at = np.flatnonzero(up | down)
    return quotes, at, np.where(up[at], 1, -1)


def _buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, fragment offsets with the end) of a string column."""
    offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(col.buffers()[2] or b"", np.uint8)[offs[0]:offs[-1]], offs - offs[0]


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array]]:
    """(file, start of the range, fragments) of consecutive rows of one range."""
    for b in batches:
        file, start = b.column(0).dictionary_encode(), b.column(1).to_numpy()
        key = np.asarray(file.indices)
        edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (start[1:] != start[:-1]), [True]])) if b.num_rows else []
        for x, y in zip(edges[:-1], edges[1:]):
            yield file.dictionary[int(key[x])].as_py(), int(start[x]), b.column(2).slice(x, y - x)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, parity, delta = None, 0, [0, 0]
    out = []
    for file, start, col in _ranges(batches):
        if (file, start) != key:
            if key is not None:
                out.append((*key, parity, *delta))
            key, parity, delta = (file, start), 0, [0, 0]
        data, offs = _buffer(col)
        quotes, at, step = _events(data, offs[:-1])
        odd = np.searchsorted(quotes, at) % 2
        for case in (0, 1):
            delta[case] += int(step[odd == (case ^ parity)].sum())
        parity ^= len(quotes) % 2
    if key is not None:
        out.append((*key, parity, *delta))
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                                     names=["file", "start", "parity", "outside", "inside"])


def _states(frags: DataFrame) -> dict[tuple[str, int], tuple[int, int, bool]]:
    """State at the start of each range: (inside a string, depth, last range of its file); one entry per range."""
    s = frags.mapInArrow(_summaries, "file string, start long, parity int, outside long, inside long")
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("string", F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2)
    s = s.withColumn("delta", F.when(F.col("string") == 0, F.col("outside")).otherwise(F.col("inside")))
    s = s.withColumns({"depth": F.coalesce(F.sum("delta").over(before), F.lit(0)), "last": F.lead("start").over(order).isNull()})
    return {(r.file, r.start): (int(r.string), int(r.depth), r.last) for r in s.select("file", "start", "string", "depth", "last").collect()}


class _Range:
    """Cuts the fragments of one range into elements and pieces of elements."""

    def __init__(self, file: str, start: int, state: tuple[int, int, bool]):
        self.file, self.start = file, start
        self.string, self.depth, self.last = state
        self.number, self.held, self.first = 0, [], start == 0
        self.open = self.depth > 0  # the array has begun

    def fail(self, why: str):
        raise ValueError(f"malformed JSON in {self.file}: {why}")

    def feed(self, col: pa.Array) -> Iterator[tuple]:
        data, offs = _buffer(col)
        quotes, at, step = _events(data, offs[:-1])
        outside = np.searchsorted(quotes, at) % 2 == self.string
        at, depth = at[outside], self.depth + np.cumsum(step[outside])
        if (depth < 0).any():
            self.fail("a bracket is closed too often")
        ends = np.concatenate([[self.depth], depth])[np.searchsorted(at, offs[1:])]
        free = np.searchsorted(quotes, offs[1:]) % 2 == self.string
        before = np.concatenate([[self.depth], depth[:-1]])
        outer = at[(depth == 0) | (before == 0)]
        if len(outer):  # the array's own brackets; only blanks stand outside of them
            data = data.copy()
            for p in outer.tolist():
                if data[p] != (ord("]") if self.open else ord("[")) or (self.open and p != outer[-1]):
                    self.fail("text outside the array")
                rest = data[p + 1:].tobytes() if self.open else data[:p].tobytes()
                if rest.decode(errors="replace").strip(_BLANK):
                    self.fail("text outside the array")
                data[p if self.open else slice(0, p + 1)] = 32
                self.open = not self.open
            col = pa.StringArray.from_buffers(len(col), pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(data))
        elif not self.open and col.to_pylist() != [""] and "".join(col.to_pylist()).strip(_BLANK):
            self.fail("text outside the array")
        self.depth, self.string = int(ends[-1]), int(not free[-1])
        texts, a = col.to_pylist(), 0
        for cut in np.flatnonzero(free & (ends == 1)).tolist():
            yield from self.close(texts[a:cut + 1], False)
            a = cut + 1
        self.held += texts[a:]
        if not self.open and self.number + len(self.held) == 0:
            self.fail("text outside the array")

    def close(self, texts: list[str], at_end: bool) -> Iterator[tuple]:
        """An element ends: it is whole, or its beginning lies in a range before."""
        begun = self.number > 0 or self.start == 0
        yield (self.file, self.start, self.number, "whole" if begun else "head", ",".join(self.held + texts), self.number == 0 and self.start == 0, at_end)
        self.number, self.held = self.number + 1, []

    def end(self) -> Iterator[tuple]:
        if not self.last:
            # the comma behind the last fragment lies inside the element, unless the element was closed by it
            if self.held:
                kind = "tail" if self.number > 0 or self.start == 0 else "mid"
                yield (self.file, self.start, self.number, kind, ",".join(self.held) + ",", self.number == 0 and self.start == 0, False)
            else:
                yield (self.file, self.start, self.number, "tail", "", False, False)
            return
        if self.depth or self.string:
            self.fail("it ends inside the array")
        yield from self.close([], True)


_PIECE = "file string, start long, number long, kind string, value string, first boolean, last boolean"


def array_elements(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, _pos, _sub, value): the elements of JSON array files as JSON text, in file order by (_pos, _sub)."""
    frags = (spark.read.option("lineSep", ",").text(files)
             .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").cast("long").alias("start"), "value"))
    states = spark.sparkContext.broadcast(_states(frags))  # one entry per range

    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
    names = ["file", "start", "number", "kind", "value", "first", "last"]

    def cut(whole: bool):
        # chosen in the task: a filter on ``kind`` could be merged with filters on the parsed values
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cur = None

            def made(rows) -> pa.RecordBatch:
                rows = [r for r in rows if (r[3] == "whole") == whole and (not whole or _kept(r[0], r[4], r[5], r[6]))]
                return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

            for file, start, col in _ranges(batches):
                if cur is None or (cur.file, cur.start) != (file, start):
                    if cur is not None:
                        yield made(cur.end())
                    cur = _Range(file, start, states.value[file, start])
                yield made(cur.feed(col))
            if cur is not None:
                yield made(cur.end())

        return frags.mapInArrow(run, _PIECE)

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [_kept(*x) for x in zip(*(b.column(i).to_pylist() for i in (0, 3, 4, 5)))]
            yield b.filter(pa.array(ok, pa.bool_()))

    # an element that crosses ranges: its tail, whole ranges in between, its head
    before = Window.partitionBy("file").orderBy("start", F.when(F.col("kind") == "tail", 1).otherwise(0))
    pieces = cut(False).withColumn("owner", F.last(F.when(F.col("kind") == "tail", F.struct("start", "number")), True).over(before))
    joined = pieces.groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("start", "value"))).alias("p"),
                                                 F.max("first").alias("first"), F.max("last").alias("last"))
    joined = joined.select("file", F.col("owner.start").alias("_pos"), F.col("owner.number").alias("_sub"),
                           F.array_join(F.transform("p", lambda x: x["value"]), "").alias("value"), "first", "last")
    joined = joined.mapInArrow(checked, "file string, _pos long, _sub long, value string, first boolean, last boolean")
    whole = cut(True).select("file", F.col("start").alias("_pos"), F.col("number").alias("_sub"), "value")
    return whole.unionByName(joined.drop("first", "last"))


def _kept(file: str, value: str, first: bool, last: bool) -> bool:
    """False for the blank inside of an empty array; any other blank element is an error."""
    if value.strip(_BLANK):
        return True
    if first and last:
        return False
    raise ValueError(f"malformed JSON in {file}: an empty element")

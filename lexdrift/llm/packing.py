"""Filling containers of fixed capacity: bounded-space online best-fit.

Every task keeps ``open_bins`` open containers per capacity. They are found by their free space through a
bitset (bit f is set while a container with f free tokens is open): an item goes where the least free
space still holds it; when a new container is needed and all places are taken, the fullest is closed. An
item larger than the capacity is cut into full containers and a rest; nothing else is split.

At the end of a task its open containers that are not yet full enough are given up and their pieces packed
again, online as well, in a second round of as many tasks as its pieces need (they are a few numbers each), so
unused space does not grow with the number of tasks. All capacities are packed in the one pass that tokenizes the texts, without a shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexdrift.llm import tokens
from lexdrift.session import stage

OPEN_BINS, FULL, SECOND_ROWS = 64, 0.98, 100_000  # the last: pieces of one task of the second round
CAPACITIES_AT_MOST = 1000
SCHEMA = "bin_size_id int, container bigint, capacity int, filled int, doc_id bigint, piece int, first_token int, tokens int, done boolean"


class BestFit:
    """Open containers of one capacity. ``put`` and ``rest`` give closed containers as (filled, pieces)."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS) -> None:
        if capacity < 1 or open_bins < 1:
            raise ValueError("capacity and number of open bins must be positive")
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.by_free, self.count = 0, {}, 0

    def _take(self, free: int) -> list:
        bins = self.by_free[free]
        got = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.count -= 1
        return got

    def _keep(self, free: int, pieces: list) -> None:
        self.by_free.setdefault(free, []).append(pieces)
        self.bits |= 1 << free
        self.count += 1

    def put(self, size: int, piece) -> list[tuple[int, list]]:
        if size > self.capacity:
            raise ValueError("cut items larger than the capacity first")
        room = self.bits >> size
        if room:
            free = size + (room & -room).bit_length() - 1
            pieces = self._take(free)
        else:
            free, pieces = self.capacity, []
        pieces.append(piece)
        closed = []
        if free == size and size:
            return [(self.capacity, pieces)]
        if self.count >= self.open_bins:
            least = (self.bits & -self.bits).bit_length() - 1
            if least <= free - size:
                closed.append((self.capacity - least, self._take(least)))
            else:
                return [(self.capacity - free + size, pieces)]
        self._keep(free - size, pieces)
        return closed

    def rest(self) -> list[tuple[int, list]]:
        out = [(self.capacity - free, pieces) for free, bins in sorted(self.by_free.items()) for pieces in bins]
        self.bits, self.by_free, self.count = 0, {}, 0
        return out


def cut(size: int, capacity: int) -> list[tuple[int, int, int]]:
    """``(piece, first token, tokens)``: one piece, or full ones and a rest for an item beyond the capacity."""
    if size <= capacity:
        return [(0, 0, size)]
    return [(k, at, min(capacity, size - at)) for k, at in enumerate(range(0, size, capacity))]


class _Out:
    """Rows of closed containers, numbered within their task (or, in the second round, within theirs)."""

    def __init__(self, second: bool) -> None:
        ctx = TaskContext.get()
        self.next = ((ctx.partitionId() if ctx else 0) * 2 + int(second)) << 32
        self.rows: list[tuple] = []

    def add(self, bin_id: int, capacity: int, filled: int, pieces: list, done: bool) -> None:
        for doc, piece, first, size in pieces:
            self.rows.append((bin_id, self.next, capacity, filled, doc, piece, first, size, done))
        self.next += 1

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) or [[] for _ in range(9)]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["bin_size_id", "container", "capacity", "filled", "doc_id", "piece", "first_token", "tokens", "done"])


def _first(capacities: list[tuple[int, int]], path: str, open_bins: int, full: float):
    def run(batches):
        packers = [(i, c, BestFit(c, open_bins)) for i, c in capacities]
        out = _Out(False)
        for b in batches:
            for part in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                docs = part.column(0).to_pylist()
                for doc, size, text in zip(docs, tokens.sizes(part.column(1).to_pylist(), path), part.column(1)):
                    if not text.is_valid:
                        continue
                    for bin_id, capacity, packer in packers:
                        for piece, first, n in cut(size, capacity):
                            for filled, pieces in packer.put(n, (doc, piece, first, n)):
                                out.add(bin_id, capacity, filled, pieces, True)
                if out.rows:
                    yield out.batch()
        for bin_id, capacity, packer in packers:
            for filled, pieces in packer.rest():
                out.add(bin_id, capacity, filled, pieces, filled >= full * capacity)
        yield out.batch()

    return run


def _second(open_bins: int):
    def run(batches):
        packers: dict[tuple[int, int], BestFit] = {}
        out = _Out(True)
        for b in batches:
            cols = [b.column(i).to_pylist() for i in (0, 2, 4, 5, 6, 7)]
            for bin_id, capacity, doc, piece, first, n in zip(*cols):
                packer = packers.setdefault((bin_id, capacity), BestFit(capacity, 4 * open_bins))
                for filled, pieces in packer.put(n, (doc, piece, first, n)):
                    out.add(bin_id, capacity, filled, pieces, True)
            if out.rows:
                yield out.batch()
        for (bin_id, capacity), packer in packers.items():
            for filled, pieces in packer.rest():
                out.add(bin_id, capacity, filled, pieces, True)
        yield out.batch()

    return run


def pack(documents: DataFrame, bin_sizes: DataFrame, path: str = tokens.RANKS, open_bins: int = OPEN_BINS, full: float = FULL) -> DataFrame:
    """``(bin_size_id, container, capacity, filled, doc_id, piece, first_token, tokens)``: one row per piece.

    ``documents(doc_id, text)``, ``bin_sizes(bin_size_id, capacity_tokens)``. Null texts are in no container,
    empty ones are items of size 0; repeated rows are items of their own; an empty table gives no rows.
    Sizes that are null or not positive are refused, as are more than ``CAPACITIES_AT_MOST`` of them.
    """
    rows = bin_sizes.select("bin_size_id", "capacity_tokens").distinct().limit(CAPACITIES_AT_MOST + 1).collect()
    if len(rows) > CAPACITIES_AT_MOST:
        raise ValueError(f"more than {CAPACITIES_AT_MOST} container sizes")
    capacities = sorted((int(r[0]), int(r[1] or 0)) for r in rows)
    if any(c < 1 for _, c in capacities):
        raise ValueError("a capacity must be positive")
    packed = stage(documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_first(capacities, path, open_bins, full), SCHEMA), "packed")
    left = packed.where("not done")
    tasks = max(1, -(-left.count() // SECOND_ROWS))
    again = left.repartition(tasks, "bin_size_id", "container").sortWithinPartitions("bin_size_id", "container", "doc_id", "piece").mapInArrow(_second(open_bins), SCHEMA)
    return packed.where("done").union(again).drop("done")


def fill_report(packed: DataFrame) -> DataFrame:
    """``(bin_size_id, capacity, containers, tokens, fill)`` of a packing."""
    return packed.groupBy("bin_size_id", "capacity").agg(F.sum("tokens").alias("tokens"), F.countDistinct("container").alias("containers")).selectExpr(
        "bin_size_id", "capacity", "containers", "tokens", "round(tokens / (containers * capacity), 6) as fill"
    )

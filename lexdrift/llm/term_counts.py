"""Frequency of every distinct term: how often, and in how many records.

Burst-trie counting. Each task counts its batches column-wise and keeps the distinct terms in a burst
trie: small dictionaries (containers) under a path of leading characters; a container that outgrows
``BURST`` splits by the next character. The task ends by writing one row per container, the compact
subtrie: its path, its terms and their two counters.

Containers of different tasks are then brought together by *adaptive prefixes*: from the sizes of all
containers the paths with more terms than one merge should hold ("heavy" paths) are found, going deeper by
``DEPTH`` characters wherever a path is still heavy, and a term is routed by its shortest prefix that is not
heavy. A container whose path is not heavy travels whole; only those on a heavy path are cut. A term occurs
once per task, however frequent it is, so no route is hot because a term is. The subtries of one route are
merged in a trie of their own, which is written before the next route begins, so a task never holds more
than one route.

The heavy paths are the only thing sent to the driver: by choice of the limit there are at most
``ROUTES * partitions`` of each length, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexdrift.session import partitions, stage

BURST, FLUSH, DEPTH, ROUTES, LEAST_ROUTE, GATHERED = 2048, 400_000, 24, 4, 4096, 50_000  # the last: terms after which a merge is written at the end of a route
COUNTERS = "occ array<bigint>, recs array<bigint>"


class BurstTrie:
    """Terms with two counters; containers split by the next character when they outgrow ``burst``."""

    def __init__(self, burst: int = BURST) -> None:
        self.burst, self.root, self.terms = burst, {}, 0
        self.inner: set[int] = set()  # ids of dictionaries that are inner nodes

    def add(self, terms: Iterable[str], occ: Iterable[int], recs: Iterable[int]) -> None:
        inner = self.inner
        for term, o, r in zip(terms, occ, recs):
            node, level = self.root, 0
            while id(node) in inner:
                step = term[level : level + 1]
                child = node.get(step)
                if child is None:
                    child = node[step] = {}
                node, level = child, level + 1
                if not step:
                    break
            had = node.get(term)
            if had is None:
                node[term] = [o, r]
                self.terms += 1
                if len(node) > self.burst:
                    self._split(node, level)
            else:
                had[0] += o
                had[1] += r

    def _split(self, node: dict, level: int) -> None:
        held = list(node.items())
        node.clear()
        self.inner.add(id(node))
        for term, counters in held:
            node.setdefault(term[level : level + 1], {})[term] = counters

    def containers(self) -> Iterator[tuple[str, dict]]:
        todo = [("", self.root)]
        while todo:
            path, node = todo.pop()
            if id(node) in self.inner:
                todo += [(path + step, child) for step, child in node.items()]
            elif node:
                yield path, node


def _split_terms(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms (runs of characters other than blank and tab) and the row each stands in."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = pc.split_pattern(pc.replace_substring(pc.cast(column, pa.large_string()), "\t", " "), " ")
    rows, terms = pc.list_parent_indices(lists), pc.list_flatten(lists)
    keep = pc.greater(pc.binary_length(terms), 0)
    return terms.filter(keep), rows.filter(keep).to_numpy()


def _as_text(rows: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray]:
    terms, row = _split_terms(rows.column(0))
    coded = terms.dictionary_encode()
    codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    if not words:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    once = np.unique(row.astype(np.int64) * len(words) + codes) % len(words)
    return words, np.bincount(codes, minlength=len(words)), np.bincount(once, minlength=len(words))


def _as_counts(rows: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray]:
    t = pa.Table.from_batches([rows]).rename_columns(["w", "n"])
    t = t.filter(pc.is_valid(t["w"]))
    g = t.group_by("w").aggregate([("n", "sum"), ("n", "count")]) if t.num_rows else t
    if not t.num_rows:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    all_rows = t.group_by("w").aggregate([([], "count_all")])
    order = {w: i for i, w in enumerate(all_rows["w"].to_pylist())}
    recs = np.zeros(len(order), np.int64)
    recs[:] = all_rows["count_all"].to_numpy()
    words = g["w"].to_pylist()
    return words, pc.fill_null(g["n_sum"], 0).to_numpy(), recs[[order[w] for w in words]]


def _containers(reader, burst: int, flush: int):
    def run(batches):
        def out(trie: BurstTrie):
            path, n, terms, occ, recs = [], [], [], [], []
            for p, held in trie.containers():
                path.append(p)
                n.append(len(held))
                terms.append(list(held))
                occ.append([c[0] for c in held.values()])
                recs.append([c[1] for c in held.values()])
                if sum(n) > 50_000:
                    yield _block(path, n, terms, occ, recs)
                    path, n, terms, occ, recs = [], [], [], [], []
            if path:
                yield _block(path, n, terms, occ, recs)

        trie = BurstTrie(burst)
        for batch in batches:
            words, occ, recs = reader(batch)
            trie.add(words, occ.tolist(), recs.tolist())
            if trie.terms > flush:
                yield from out(trie)
                trie = BurstTrie(burst)
        yield from out(trie)

    return run


def _block(path, n, terms, occ, recs) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(path, pa.string()), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(occ, longs), pa.array(recs, longs)],
        names=["path", "n", "terms", "occ", "recs"],
    )


def _route(term: str, heavy: frozenset) -> str:
    for k in range(len(term) + 1):
        if term[:k] not in heavy:
            return term[:k]
    return term + "\0"  # the term is a heavy path itself


def _routed(heavy: frozenset):
    def run(batches):
        for batch in batches:
            whole, cut = [], {}
            paths = batch.column(0).to_pylist()
            routes = []
            for i, p in enumerate(paths):
                if p in heavy:
                    for t, o, r in zip(batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), batch.column(4)[i].as_py()):
                        at = cut.setdefault(_route(t, heavy), ([], [], []))
                        at[0].append(t), at[1].append(o), at[2].append(r)
                else:
                    whole.append(i)
                    routes.append(_route(p, heavy))
            part = batch.take(pa.array(whole, pa.int64()))
            if whole:
                yield pa.RecordBatch.from_arrays([pa.array(routes, pa.string()), part.column(2), part.column(3), part.column(4)], names=["route", "terms", "occ", "recs"])
            if cut:
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(cut), pa.string()), pa.array([c[0] for c in cut.values()], pa.list_(pa.string())), pa.array([c[1] for c in cut.values()], longs), pa.array([c[2] for c in cut.values()], longs)],
                    names=["route", "terms", "occ", "recs"],
                )

    return run


def _merged(burst: int):
    """Merge the subtries of each route, which come one after the other, and write its terms before the next."""

    def run(batches):
        def block():
            terms = [t for _, held in trie.containers() for t in held]
            counts = [c for _, held in trie.containers() for c in held.values()]
            for at in range(0, len(terms), 50_000):
                part = counts[at : at + 50_000]
                columns = [pa.array(terms[at : at + 50_000], pa.string()), pa.array([c[0] for c in part], pa.int64()), pa.array([c[1] for c in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["term", "occ", "recs"])

        trie, now = BurstTrie(burst), None
        for b in batches:
            for i, route in enumerate(b.column(0).to_pylist()):
                if route != now and trie.terms >= GATHERED:
                    yield from block()
                    trie = BurstTrie(burst)
                now = route
                trie.add(b.column(1)[i].as_py(), b.column(2)[i].as_py(), b.column(3)[i].as_py())
        yield from block()

    return run


def _heavy(subtries: DataFrame, limit: int, depth: int) -> frozenset:
    """Paths under which more than ``limit`` terms stand; deeper ones are looked for only below heavy ones."""
    heavy: set[str] = set()
    paths, at = subtries.groupBy("path").agg(F.sum("n").alias("n")), 0
    while True:
        first, last = at if not at else at + 1, at + depth
        nodes = paths.where(F.length("path") >= first).select(
            F.explode(F.transform(F.sequence(F.lit(first), F.least(F.length("path"), F.lit(last))), lambda k: F.substring("path", F.lit(1), k))).alias("node"), "n"
        )
        found = {r[0] for r in nodes.groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") > limit).select("node").collect()}
        heavy |= found
        deep = [p for p in found if len(p) == last]
        if not deep:
            return frozenset(heavy)
        # only what lies below the deepest heavy paths, a bounded list, is looked at again
        paths = paths.where(F.substring("path", 1, last).isin(deep) & (F.length("path") > last))
        at = last


def _count(source: DataFrame, reader, burst: int, flush: int, depth: int) -> DataFrame:
    spark = source.sparkSession
    subtries = stage(source.mapInArrow(_containers(reader, burst, flush), f"path string, n bigint, terms array<string>, {COUNTERS}"), "subtries")
    p = partitions(spark)
    total = subtries.agg(F.sum("n")).first()[0] or 0
    heavy = _heavy(subtries, max(LEAST_ROUTE, total // (ROUTES * p)), depth)
    routed = subtries.mapInArrow(_routed(heavy), f"route string, terms array<string>, {COUNTERS}")
    return routed.repartition(p, "route").sortWithinPartitions("route").mapInArrow(_merged(burst), "term string, occ bigint, recs bigint")


def term_counts(df: DataFrame, text: str, burst: int = BURST, flush: int = FLUSH, depth: int = DEPTH) -> DataFrame:
    """``(term, occ, recs)`` for every term of ``text``: occurrences and number of rows.

    Terms are runs of characters other than blank and tab, exactly as written. Null and empty texts
    have none; a repeated row counts as often as it occurs; an empty table gives no rows.
    """
    return _count(df.select(F.col(text).alias("texts")), _as_text, burst, flush, depth)


def weighted_counts(df: DataFrame, term: str, weight: str, burst: int = BURST, flush: int = FLUSH, depth: int = DEPTH) -> DataFrame:
    """``(term, occ, recs)`` of ready-made partial counts: sum of ``weight`` (null as 0) and number of rows per non-null term."""
    return _count(df.select(F.col(term).alias("w"), F.col(weight).cast("bigint").alias("n")), _as_counts, burst, flush, depth)


def marks(counts: DataFrame, measure: str, rare_below: int, common_above: float) -> DataFrame:
    """``(term, mark)`` of the terms that are ``rare`` or ``common``; rare where both hold (tiny tables only)."""
    mark = F.when(F.col(measure) < rare_below, "rare").when(F.col(measure) > F.lit(float(common_above)), "common")
    return counts.select("term", mark.alias("mark")).where("mark is not null")

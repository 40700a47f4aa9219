"""The k most similar vectors of every vector: learned partitions.

Fit (on bounded samples, per model, in tasks): the neighbour graph of a sample is cut into balanced parts -
balanced centres give a start, then every vertex goes where its neighbours are, with a price on parts
that are too full - and a linear softmax classifier learns which part a vector belongs to. Models of more than
``LEAVES`` parts get a tree: a first cut into up to ``SUPERS_AT_MOST`` regions, each of which is sampled and cut
again, so parts stay at about ``PART_ROWS`` rows while their number grows with the data, up to ``PARTS_AT_MOST``
(beyond some hundred million rows the parts grow instead; only the work grows then).

Search: every vector is indexed in its most probable part and compared exactly with the rows of several most
probable parts. Parts that lie near one another form bundles of about ``BUNDLE`` parts, and a row travels once to
each bundle that holds one of its parts, as query, as index row or as both. Only the comparison is partitioned;
no row is left out. With a ``recall`` the number of parts is measured: some queries are compared with every
row, and as many parts are searched as hold that share of their true neighbours.

Skew: of equal vectors every batch and every task keeps the k + 1 of lowest number on the index side, which is
all that a list of k neighbours can hold of them; bundles with many queries or index rows are cut into blocks,
so that one task never holds more than ``QUERY_BLOCK`` queries and ``INDEX_BLOCK`` index rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, GRAPH, PART_ROWS, PROBES = 12_000, 10, 1500, 12
LEAVES, BUNDLE, REGIONS = 64, 8, 8  # parts of a region, parts of a bundle, most probable regions in which parts are looked for
SUPERS_AT_MOST, PARTS_AT_MOST, MODELS_AT_MOST = 512, 65_536, 4096  # what is broadcast: a row of numbers per part and region
FEW_PARTS, FEW_ROWS = 16, 64  # small models have so many parts if they are not smaller than that
QUERY_BLOCK, INDEX_BLOCK = 60_000, 40_000
TRIED, TRIED_AT_MOST = 500, 20_000  # queries per model, and in all, that are compared with every row to measure the recall


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def neighbour_graph(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and similarities of the k nearest of every unit row."""
    n = len(x)
    k = min(k, n - 1)
    near, sim = np.zeros((n, k), np.int32), np.zeros((n, k), np.float32)
    for a in range(0, n, 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.zeros((len(s), 0), int)
        near[a : a + len(s)], sim[a : a + len(s)] = top, np.take_along_axis(s, top, 1)
    return near, sim


def balanced_parts(x: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """A part for each row of ``x``, of about equal sizes, cutting few edges of the neighbour graph."""
    n, rng = len(x), np.random.default_rng(seed)
    if parts <= 1 or n <= parts:
        return np.zeros(n, np.int64) if parts <= 1 else np.arange(n) % parts
    target = n / parts
    centres = x[rng.choice(n, parts, replace=False)].copy()
    price = np.zeros(parts, np.float32)
    label = np.zeros(n, np.int64)
    for step in range(25):
        label = (x @ centres.T - price).argmax(1)
        size = np.bincount(label, minlength=parts)
        price = np.clip(price + 0.05 * (size / target - 1), -1, 1).astype(np.float32)
        if step % 3 == 2:
            sums = np.zeros_like(centres)
            np.add.at(sums, label, x)
            filled = size > 0
            centres[filled] = unit_rows(sums[filled])
    near, sim = neighbour_graph(x, GRAPH)
    weight = np.maximum(sim, 0) ** 2
    for _ in range(6):
        votes = np.zeros((n, parts), np.float32)
        for j in range(near.shape[1]):
            votes[np.arange(n), label[near[:, j]]] += weight[:, j]
        votes += 0.5 * (x @ centres.T) - price
        label = votes.argmax(1)
        size = np.bincount(label, minlength=parts)
        price = np.clip(price + 0.1 * (size / target - 1), -2, 2).astype(np.float32)
    return label


class PartClassifier:
    """Linear softmax: the most probable parts of a vector."""

    def __init__(self, parts: int) -> None:
        self.parts, self.w, self.b = parts, None, None

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 25, seed: int = 11) -> "PartClassifier":
        n, d = x.shape
        rng = np.random.default_rng(seed)
        w, b = np.zeros((d, self.parts), np.float32), np.zeros(self.parts, np.float32)
        np.add.at(w.T, y, x)
        w = 8 * unit_rows(w.T).T.astype(np.float32)
        m, v, t = np.zeros_like(w), np.zeros_like(w), 0
        for _ in range(epochs if self.parts > 1 else 0):
            order = rng.permutation(n)
            for at in range(0, n, 512):
                rows = order[at : at + 512]
                z = x[rows] @ w + b
                z = np.exp(z - z.max(1, keepdims=True))
                z /= z.sum(1, keepdims=True)
                z[np.arange(len(rows)), y[rows]] -= 1
                g = x[rows].T @ z / len(rows) + 1e-4 * w
                t += 1
                m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
                b -= 0.5 * z.mean(0)
        self.w, self.b = w, b
        return self

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Logarithms of the probabilities of all parts."""
        z = x @ self.w + self.b
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


class PartTree:
    """Regions, their parts (numbered through the model) and the bundle of each part."""

    def __init__(self, root: PartClassifier, regions: dict[int, PartClassifier]) -> None:
        self.root, self.regions, self.first, self.bundle = root, regions, {}, np.zeros(0, np.int64)
        parts = bundles = 0
        for s in sorted(regions):
            r = regions[s]
            self.first[s] = parts
            near = balanced_parts(unit_rows(r.w.T).astype(np.float32), -(-r.parts // BUNDLE))
            self.bundle = np.r_[self.bundle, bundles + near]
            parts, bundles = parts + r.parts, bundles + int(near.max()) + 1
        self.parts = parts

    def top(self, x: np.ndarray, m: int, regions: int = REGIONS) -> np.ndarray:
        """Numbers of the m most probable parts, most probable first; -1 where the regions looked into have fewer."""
        known = np.array(sorted(self.regions))
        up = self.root.logs(x)[:, known] if self.root.parts > 1 else np.zeros((len(x), len(known)), np.float32)
        take = min(regions, len(known))
        best = np.argpartition(-up, take - 1, axis=1)[:, :take]
        width = max(r.parts for r in self.regions.values())
        score, part = np.full((len(x), take * width), -np.inf, np.float32), np.full((len(x), take * width), -1, np.int32)
        for j in range(take):
            for k in np.unique(best[:, j]):
                at, r = np.flatnonzero(best[:, j] == k), self.regions[int(known[k])]
                score[at, j * width : j * width + r.parts] = r.logs(x[at]) + up[at, k][:, None]
                part[at, j * width : j * width + r.parts] = np.arange(r.parts) + self.first[int(known[k])]
        m = min(m, score.shape[1])
        some = np.argpartition(-score, m - 1, axis=1)[:, :m]
        some = np.take_along_axis(some, np.argsort(-np.take_along_axis(score, some, 1), axis=1, kind="stable"), 1)
        return np.take_along_axis(part, some, 1)


def usable(vector: str, dim: int) -> F.Column:
    """Exactly ``dim`` finite numbers, not all zero."""
    v = F.col(vector)
    return (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sampled(rows: DataFrame, keys: list[str], groups: list[tuple], columns: str) -> DataFrame:
    """Of each group the ``most`` first rows by a hash of their number, with the other columns of ``groups``.

    ``groups`` has a row per group, at most ``PARTS_AT_MOST``: its keys, its ``share``, its ``most`` and more.
    Twice the wanted rows are let through by the same hash, so that not every row is sorted.
    """
    h = F.expr("xxhash64(idx, 3)")
    sizes = F.broadcast(rows.sparkSession.createDataFrame(groups, columns))
    let = rows.join(sizes, keys).where((h / F.lit(2.0**64) + 0.5) <= F.col("share"))
    return let.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(h, "idx"))).where(F.col("nth") <= F.col("most"))


def _fit_group(keys: int, dim: int):
    """Fits the classifier of one group of sampled rows to as many parts as its column ``parts`` says."""

    def run(key, t):
        order = np.lexsort((np.arange(t.num_rows), t["idx"].to_numpy()))
        x = unit_rows(_matrix(t["vector"], dim).astype(np.float64)[order]).astype(np.float32)
        parts = max(1, min(t["parts"][0].as_py(), len(x) // 16))
        made = PartClassifier(parts).fit(x, balanced_parts(x, parts))
        head = [pa.array([k.as_py()], k.type) for k in key]
        return pa.table([*head, pa.array([pickle.dumps(made)], pa.binary())], names=[*["model", "region"][:keys], "made"])

    return run


def fit_trees(rows: DataFrame, dim: int, sample: int = SAMPLE, part_rows: int = PART_ROWS, leaves: int = LEAVES) -> dict[str, PartTree]:
    """One tree per model of ``rows(model, idx, vector)``, from the first rows by a hash of their numbers."""
    spark = rows.sparkSession
    counts = {r["model"]: r["count"] for r in rows.groupBy("model").count().limit(MODELS_AT_MOST + 1).collect()}
    if len(counts) > MODELS_AT_MOST:
        raise ValueError(f"more than {MODELS_AT_MOST} models")
    part_rows = max(part_rows, -(-sum(counts.values()) // PARTS_AT_MOST))
    parts = {m: max(-(-n // part_rows), min(FEW_PARTS, n // FEW_ROWS), 1) for m, n in counts.items()}
    regions = {m: 1 if p <= leaves else min(SUPERS_AT_MOST, -(-p // leaves)) for m, p in parts.items()}
    roots = {m: PartClassifier(1) for m in counts}
    big = [(m, min(1.0, 2 * most / counts[m]), most, r) for m, r in regions.items() if r > 1 for most in [max(sample, 64 * r)]]
    if big:
        drawn = _sampled(rows, ["model"], big, "model string, share double, most int, parts int")
        for r in drawn.select("model", "idx", "vector", "parts").groupBy("model").applyInArrow(_fit_group(1, dim), "model string, made binary").collect():
            roots[r["model"]] = pickle.loads(r["made"])

    def region(batches):
        for b in batches:
            if b.num_rows:
                models, x, out = np.array(b.column(0).to_pylist(), object), unit_rows(_matrix(b.column(2), dim).astype(np.float64)).astype(np.float32), np.zeros(b.num_rows, np.int32)
                for m in set(models):
                    if roots[m].parts > 1:
                        out[models == m] = roots[m].logs(x[models == m]).argmax(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out)], names=["model", "idx", "vector", "region"])

    placed = rows.select("model", "idx", "vector").mapInArrow(region, "model string, idx bigint, vector array<float>, region int") if big else rows.select("model", "idx", "vector", F.lit(0).alias("region"))
    # a row per region
    held = [(r["model"], r["region"], r["count"]) for r in placed.groupBy("model", "region").count().collect()] if big else [(m, 0, n) for m, n in counts.items()]
    groups = [(m, g, min(1.0, 2 * sample / n), sample, max(1, round(n * parts[m] / counts[m]))) for m, g, n in held]
    if not groups:
        return {}
    drawn = _sampled(placed, ["model", "region"], groups, "model string, region int, share double, most int, parts int")
    fitted = drawn.select("model", "region", "idx", "vector", "parts").groupBy("model", "region").applyInArrow(_fit_group(2, dim), "model string, region int, made binary").collect()
    made: dict[str, dict[int, PartClassifier]] = {}
    for r in fitted:
        made.setdefault(r["model"], {})[r["region"]] = pickle.loads(r["made"])
    return {m: PartTree(roots[m], made[m]) for m in made}


def measured_probes(rows: DataFrame, trees: dict[str, PartTree], dim: int, k: int, least: float, probes: int, recall: float, tried: int = TRIED) -> dict[str, int]:
    """Parts to search per model, at least ``probes``: so many that ``recall`` of the true k neighbours of some queries lie in them.

    ``rows(model, idx, vector, ask)``; the queries tried, ``tried`` per model and ``TRIED_AT_MOST`` in all, are
    the first of those asked for by a hash. Work and what the tasks return are in proportion to the rows and to the tasks.
    """
    out = {m: min(probes, t.parts) for m, t in trees.items()}
    wide = [m for m, t in trees.items() if t.parts > probes]
    if not wide:
        return out
    nth = F.row_number().over(Window.partitionBy("model").orderBy(F.expr("xxhash64(idx, 2)"), "idx"))
    drawn = rows.where(F.col("ask") & F.col("model").isin(wide)).withColumn("nth", nth).where(F.col("nth") <= min(tried, TRIED_AT_MOST // len(wide) + 1)).select("model", "idx", "vector").collect()
    trial = {}
    for m in wide:
        mine = sorted((d for d in drawn if d["model"] == m), key=lambda d: d["idx"])
        if mine:
            x = unit_rows(np.array([d["vector"] for d in mine], np.float64).reshape(-1, dim)).astype(np.float32)
            order = trees[m].top(x, trees[m].parts, len(trees[m].regions))
            place = np.zeros((len(x), trees[m].parts), np.int32)
            np.put_along_axis(place, np.maximum(order, 0), np.broadcast_to(np.arange(order.shape[1], dtype=np.int32), order.shape), 1)
            trial[m] = np.array([d["idx"] for d in mine]), x, place
    if not trial:
        return out

    def near(batches):
        best = {m: (np.full((len(q), k), -2, np.float32), np.zeros((len(q), k), np.int64)) for m, (q, _, _) in trial.items()}
        for b in (b.slice(i, 2000) for b in batches for i in range(0, b.num_rows, 2000)):
            models, idx = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy()
            x = unit_rows(_matrix(b.column(2), dim).astype(np.float64)).astype(np.float32)
            for m in set(models) & set(trial):
                at, (ids, q, places) = np.flatnonzero(models == m), trial[m]
                s = q @ x[at].T
                s[ids[:, None] == idx[at][None, :]] = -2
                s = np.concatenate([best[m][0], s], axis=1)
                place = np.concatenate([best[m][1], places[:, trees[m].top(x[at], 1)[:, 0]]], axis=1)
                take = np.argpartition(-s, k - 1, axis=1)[:, :k]
                best[m] = np.take_along_axis(s, take, 1), np.take_along_axis(place, take, 1)
        for m, (s, place) in best.items():
            r, c = np.nonzero(s >= max(least, -1.5))
            yield pa.RecordBatch.from_arrays([pa.array([m] * len(r), pa.string()), pa.array(r), pa.array(s[r, c].astype(np.float64)), pa.array(place[r, c])], names=["model", "q", "cosine", "place"])

    found = rows.select("model", "idx", "vector").mapInArrow(near, "model string, q bigint, cosine double, place bigint")
    true = found.selectExpr("*", "row_number() over (partition by model, q order by cosine desc, place) as rank").where(f"rank <= {k}")
    held: dict[str, dict[int, int]] = {}
    for r in true.groupBy("model", "place").count().collect():  # one row per model and part
        held.setdefault(r["model"], {})[r["place"]] = r["count"]
    for m, counts in held.items():
        share = np.cumsum([counts.get(i, 0) for i in range(trees[m].parts)]) / sum(counts.values())
        out[m] = max(out[m], int(np.searchsorted(share, recall)) + 1)
    return out


def _first_of_equal(x: np.ndarray, idx: np.ndarray, keep: int) -> np.ndarray:
    """Positions without those of equal rows beyond the ``keep`` of lowest number."""
    with np.errstate(over="ignore"):
        h = (np.ascontiguousarray(x, np.float32).view(np.uint32).astype(np.uint64) * (np.arange(x.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))).sum(1)
    order = np.lexsort((idx, h))
    new = np.r_[True, h[order][1:] != h[order][:-1]] if len(order) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    same = (x[order] == x[order[first]]).all(1) if len(order) else np.zeros(0, bool)
    return np.sort(order[~same | (np.arange(len(order)) - first < keep)])


def _packed(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, "<f4")
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * x.shape[1] * 4).astype(np.int32)), pa.py_buffer(x)])


def _routed(trees: dict[str, PartTree], probes: dict[str, int], regions: int, dim: int, k: int, count: bool):
    """Rows ``(model, bundle, idx, vector, own, parts)`` per bundle a row goes to, or only their numbers."""

    def places(b):
        models, idx, ask = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy(), b.column(3).to_numpy(zero_copy_only=False)
        x = _matrix(b.column(2), dim).astype(np.float32)
        unit = unit_rows(x.astype(np.float64)).astype(np.float32)
        for m in sorted(set(models)):
            t, at = trees[m], np.flatnonzero(models == m)
            own = t.top(unit[at], 1)[:, 0]
            indexed = np.zeros(len(at), bool)
            indexed[_first_of_equal(x[at], idx[at], k + 1)] = True
            row, part, of_query = np.flatnonzero(indexed), own[indexed], np.zeros(int(indexed.sum()), bool)
            if ask[at].any():
                q = np.flatnonzero(ask[at])
                best = t.top(unit[at][q], probes[m], regions)
                r, c = np.nonzero(best >= 0)
                row, part, of_query = np.r_[row, q[r]], np.r_[part, best[r, c]], np.r_[of_query, np.ones(len(r), bool)]
            bundle = t.bundle[part]
            order = np.lexsort((part, bundle, row))
            yield m, at, row[order], part[order], of_query[order], bundle[order]

    def run(batches):
        for b in (b.slice(i, 4096) for b in batches for i in range(0, b.num_rows, 4096)):
            for m, at, row, part, of_query, bundle in places(b):
                if not len(row):
                    continue
                start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (bundle[1:] != bundle[:-1])])
                asked, held = np.add.reduceat(of_query.astype(np.int64), start), np.add.reduceat((~of_query).astype(np.int64), start)
                if count:
                    where, code = np.unique(bundle[start], return_inverse=True)
                    q, n = np.bincount(code, asked > 0), np.bincount(code, held)
                    yield pa.RecordBatch.from_arrays([pa.array([m] * len(where), pa.string()), pa.array(where), pa.array(q.astype(np.int64)), pa.array(n.astype(np.int64))], names=["model", "bundle", "asked", "held"])
                    continue
                own = np.full(len(start), -1, np.int32)
                index_at = np.flatnonzero(~of_query)
                own[np.searchsorted(start, index_at, side="right") - 1] = part[index_at]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(asked)].astype(np.int32)), pa.array(part[of_query].astype(np.int32)))
                rows = at[row[start]]
                vectors = _matrix(b.column(2).take(pa.array(rows)), dim)
                yield pa.RecordBatch.from_arrays([pa.array([m] * len(start), pa.string()), pa.array(bundle[start].astype(np.int64)), b.column(1).take(pa.array(rows)), _packed(vectors), pa.array(own), lists], names=["model", "bundle", "idx", "vector", "own", "parts"])

    return run


def _compare(k: int, least: float, dim: int):
    names = ["model", "idx", "near", "cosine"]
    empty = pa.table({"model": pa.array([], pa.string()), "idx": pa.array([], pa.int64()), "near": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})

    def run(key, t):
        t = t.combine_chunks()
        idx, own, asked = t["idx"].to_numpy(), t["own"].to_numpy(), t["asks"].to_numpy(zero_copy_only=False)
        x = unit_rows(np.frombuffer(b"".join(t["vector"].to_pylist()), "<f4").reshape(-1, dim).astype(np.float64))
        held = np.flatnonzero((own >= 0) & t["holds"].to_numpy(zero_copy_only=False))
        held = held[_first_of_equal(x[held].astype(np.float32), idx[held], k + 1)]
        held = held[np.lexsort((idx[held], own[held]))]  # ties go to the lower number
        lists = t["parts"].combine_chunks() if isinstance(t["parts"], pa.ChunkedArray) else t["parts"]
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        part = lists.flatten().to_numpy()
        of = np.repeat(np.arange(t.num_rows), np.diff(lists.offsets.to_numpy()))
        use = asked[of]
        part, of = part[use], of[use]
        by = np.argsort(part, kind="stable")
        part, of = part[by], of[by]
        x32 = x.astype(np.float32)
        out: list[list[np.ndarray]] = [[], [], []]
        for p in np.unique(own[held]):
            b, q_all = held[slice(*np.searchsorted(own[held], [p, p + 1]))], of[slice(*np.searchsorted(part, [p, p + 1]))]
            for a in range(0, len(q_all), 1024):
                q = q_all[a : a + 1024]
                s = x32[q] @ x32[b].T
                s[idx[q][:, None] == idx[b][None, :]] = -2
                take = min(k, s.shape[1])
                bound = np.partition(s, s.shape[1] - take, axis=1)[:, s.shape[1] - take]
                r, c = np.nonzero(s >= np.maximum(bound - 1e-5, max(least, -1.5) - 1e-5)[:, None])
                if len(r):
                    exact = np.round(np.einsum("ij,ij->i", x[q[r]], x[b[c]]), 12)
                    keep = exact >= least
                    out[0].append(idx[q[r[keep]]]), out[1].append(idx[b[c[keep]]]), out[2].append(exact[keep])
        if not out[0]:
            return empty
        q, near, cosine = map(np.concatenate, out)
        order = np.lexsort((near, -cosine, q))
        q, near, cosine = q[order], near[order], cosine[order]
        new = np.r_[True, (q[1:] != q[:-1]) | (near[1:] != near[:-1]) | (cosine[1:] != cosine[:-1])] if len(q) else np.zeros(0, bool)  # repeated rows count once
        q, near, cosine = q[new], near[new], cosine[new]
        begin = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
        rank = np.arange(len(q)) - np.maximum.accumulate(np.where(begin, np.arange(len(q)), 0))
        first = rank < k
        return pa.table([pa.array([key[0].as_py()] * int(first.sum()), pa.string()), pa.array(q[first]), pa.array(near[first]), pa.array(cosine[first])], names=names)

    return run


def most_similar(df: DataFrame, k: int = 5, least: float = -1.0, dim: int = 64, probes: int = PROBES, sample: int = SAMPLE, part_rows: int = PART_ROWS, queries: str | None = None, recall: float | None = None, leaves: int = LEAVES, query_block: int = QUERY_BLOCK, index_block: int = INDEX_BLOCK) -> DataFrame:
    """``(model, idx, near, cosine, rank)``: up to k most similar rows of the same model for every row.

    ``df`` has ``(model, idx, vector)``. Vectors that are null, of another length, all zero or not finite
    take no part; repeated rows count once, and a number with several vectors is near by the best of them;
    ties go to the lower number. ``least`` is the smallest cosine of interest, ``queries`` a condition on the
    rows that are asked for (all are indexed). With ``recall``, ``probes`` is the least number of parts searched
    and more are, as measured. An empty table gives no rows.
    """
    ask = F.coalesce(F.expr(queries), F.lit(False)) if queries else F.lit(True)
    rows = df.where(F.col("idx").isNotNull() & usable("vector", dim)).select(
        F.coalesce("model", F.lit("")).alias("model"), F.col("idx").cast("bigint").alias("idx"), F.col("vector").cast("array<float>").alias("vector"), ask.alias("ask")
    )
    trees = fit_trees(rows, dim, sample, part_rows, leaves)
    searched = measured_probes(rows, trees, dim, k, least, probes, recall) if recall else dict.fromkeys(trees, probes)
    regions = max((len(t.regions) for t in trees.values()), default=1) if recall else REGIONS
    route = lambda count, schema: rows.mapInArrow(_routed(trees, searched, regions, dim, k, count), schema)
    counts = route(True, "model string, bundle bigint, asked bigint, held bigint").groupBy("model", "bundle").agg(F.sum("asked").alias("asked"), F.sum("held").alias("held"))
    blocks = counts.select("model", "bundle", F.greatest(F.ceil(F.col("asked") / query_block), F.lit(1)).alias("qb"), F.greatest(F.ceil(F.col("held") / index_block), F.lit(1)).alias("ib"))
    sent = route(False, "model string, bundle bigint, idx bigint, vector binary, own int, parts array<int>").join(F.broadcast(blocks), ["model", "bundle"])  # a row per bundle, at most PARTS_AT_MOST
    # a row is a query of its block of queries in all index blocks, and an index row of its index block in all blocks of queries
    cell = sent.selectExpr("*", "pmod(xxhash64(idx), qb) as mine", "pmod(xxhash64(idx, 1), ib) as stored").selectExpr(
        "*", "explode(filter(flatten(transform(sequence(0L, qb - 1), q -> transform(sequence(0L, ib - 1), i -> struct(q, i)))), c -> c.q = mine and size(parts) > 0 or c.i = stored and own >= 0)) as cell"
    )
    met = (
        cell.selectExpr("model", "bundle", "cell.q as q", "cell.i as i", "idx", "vector", "own", "parts", "cell.q = mine as asks", "cell.i = stored as holds")
        .groupBy("model", "bundle", "q", "i").applyInArrow(_compare(k, least, dim), "model string, idx bigint, near bigint, cosine double")
    )
    best = met.repartition("model", "idx").groupBy("model", "idx", "near").agg(F.max("cosine").alias("cosine"))  # the exchange serves the ranking too
    return best.selectExpr("*", "row_number() over (partition by model, idx order by cosine desc, near) as rank").where(f"rank <= {k}")


def similar_pairs(df: DataFrame, k: int = 5, least: float = 0.85, **how) -> DataFrame:
    """``(model, idx_a, idx_b)``, idx_a < idx_b: pairs of a cosine of at least ``least``, one among the k most similar of the other."""
    found = most_similar(df, k, least, **how)
    return found.select("model", F.least("idx", "near").alias("idx_a"), F.greatest("idx", "near").alias("idx_b")).distinct()

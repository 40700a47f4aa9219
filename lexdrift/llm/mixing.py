"""Mixing sources to target weights: iterative proportional fitting and calibrated sampling.

The tokens of all documents of the wanted sources are summed per cell (source, language, topic). The cells
are raked to the marginals of topic, language and source in turn until nothing moves; a cell's weight is how
often its documents are used on average and never exceeds the source's cap. The sources come last in every
round, by a scale that counts in the capped cells, so their shares hold exactly; where the three marginals
contradict one another, language and topic yield, and the report says by how much. The size of the mixture is
the largest at which every source can still give its share under its cap, unless a smaller one is asked for.

Documents are then sampled with the calibrated weights as inclusion probabilities: a weight of 2.3 is two
copies and a third with probability 0.3. The draw is systematic over the
documents in the order of cell and class of size, at random within a class, so the tokens of a cell stay near
what was calibrated; of ``DRAWS`` seeded draws of a bucket the one that meets the bucket's tokens best is taken.
Sources are cut into buckets of bounded size, so one with a third of all rows is not one task.

Topics are clusters of the documents' tokens, fitted on all documents of the wanted sources after the mean of
each language is taken out, so that they say what a text is about rather than which language it is in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexdrift.llm import tokens
from lexdrift.llm.common import first_by_hash
from lexdrift.session import stage

SOURCES_AT_MOST, CELLS_AT_MOST, BUCKET, TEMPERATURE = 10_000, 200_000, 20_000, 0.8
TOPICS, FITTED, BAG, SCALE = 8, 15, 2048, 2.0**24  # clusters, rounds they are fitted in at most, columns that token numbers are hashed to, steps of one
ROUNDS, SETTLED, DRAWS = 500, 1e-9, 32


def bagged(documents: DataFrame, path: str = tokens.RANKS) -> DataFrame:
    """``(doc_id, source, lang, tokens, bag)`` of the documents with tokens; null languages are a language of their own.

    A bag has a number for each column that the document's token numbers are hashed to: the column plus ``BAG`` times the count.
    """

    def run(batches):
        for b in batches:
            for part in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                ids = tokens.numbers(part.column(3).to_pylist(), path)
                bags = []
                for x in ids:
                    counts = np.bincount((np.asarray(x, np.int64) * 2654435761 >> 7) % BAG, minlength=BAG)
                    there = np.flatnonzero(counts)
                    bags.append((there + BAG * counts[there]).astype(np.int64).tobytes())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array([len(x) for x in ids], pa.int64()), pa.array(bags, pa.binary())], names=["doc_id", "source", "lang", "tokens", "bag"])

    rows = documents.select(F.col("doc_id").cast("bigint"), "source", F.coalesce("lang", F.lit("")).alias("lang"), "text")
    return rows.mapInArrow(run, "doc_id bigint, source string, lang string, tokens bigint, bag binary").where("tokens > 0")


def _entries(bags: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and count of every number of the bags."""
    count, slot = np.divmod(np.frombuffer(b"".join(bags), np.int64), BAG)
    return np.repeat(np.arange(len(bags)), [len(x) // 8 for x in bags]), slot, count


def _unit(v: np.ndarray) -> np.ndarray:
    """At length one, in whole steps of 1 / ``SCALE``."""
    n = np.linalg.norm(v)
    return np.rint(v / n * SCALE) if n > 0 else np.zeros(len(v))


class Topics:
    """Centres of spherical k-means on bags of tokens, weighted by rarity and without the mean of their language.

    ``offsets`` has the product of each language's mean with the centres: what its documents have of them by their language alone.
    """

    def __init__(self, idf: np.ndarray, centres: np.ndarray, offsets: dict[str, list[int]]) -> None:
        self.idf, self.centres, self.offsets = idf, centres, offsets

    def weighed(self, bags: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and value of every number of the bags: damped counts by rarity, at length one a row.

        Values and centres are whole steps of 1 / ``SCALE``, so that sums and products are exact, whatever the order of the rows.
        """
        row, slot, count = _entries(bags)
        x = np.log1p(count) * self.idf[slot]
        norm = np.sqrt(np.bincount(row, x * x, minlength=len(bags)))
        return row, slot, np.rint(x / np.maximum(norm, 1e-9)[row] * SCALE)

    def of(self, weighed: tuple[np.ndarray, np.ndarray, np.ndarray], langs: list[str]) -> np.ndarray:
        """Number of the nearest centre of every row."""
        row, slot, x = weighed
        near = np.stack([np.bincount(row, x * c[slot], minlength=len(langs)) for c in self.centres], 1)
        none = [0] * len(self.centres)  # of a language without any weighted column
        return (near - np.array([self.offsets.get(g, none) for g in langs], float)).argmax(1)


def _parts(batches):
    """Bags and languages, a thousand rows at a time."""
    for b in batches:
        for part in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
            yield part.column("bag").to_pylist(), part.column("lang").to_pylist()


def _rarity(bags: DataFrame, n: int) -> np.ndarray:
    """Weight of every column, by how many of the ``n`` documents have it."""

    def run(batches):
        seen = np.zeros(BAG, np.int64)
        for some, _ in _parts(batches):
            seen += np.bincount(_entries(some)[1], minlength=BAG)
        yield pa.RecordBatch.from_arrays([pa.array(range(BAG), pa.int32()), pa.array(seen)], names=["slot", "n"])

    seen = bags.select("lang", "bag").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n")).collect()  # BAG rows
    out = np.zeros(BAG)
    for slot, docs in seen:
        out[slot] = np.log((1 + n) / (1 + docs))
    return out


def _language_means(bags: DataFrame, model: Topics) -> DataFrame:
    """``(lang, slot, mean)`` over all documents of each language, in whole steps of 1 / ``SCALE``."""

    def flat(held):
        for lang, v in held.items():
            slots = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slots), pa.string()), pa.array(slots, pa.int32()), pa.array(v[slots].astype(np.int64))], names=["lang", "slot", "total"])

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for some, langs in _parts(batches):
            row, slot, x = model.weighed(some)
            names: dict[str, int] = {}
            code = np.array([names.setdefault(g, len(names)) for g in langs])
            sums = np.bincount(code[row] * BAG + slot, x, minlength=len(names) * BAG).reshape(len(names), BAG)
            for lang, v in zip(names, sums):
                held[lang] = held.get(lang, 0.0) + v
            if len(held) > 256:
                yield from flat(held)
                held = {}
        yield from flat(held)

    sums = bags.select("lang", "bag").mapInArrow(run, "lang string, slot int, total bigint").groupBy("lang", "slot").agg(F.sum("total").alias("total"))
    return sums.join(bags.groupBy("lang").agg(F.count("*").alias("n")), "lang").selectExpr("lang", "slot", "cast(round(total / n) as bigint) as mean")


def _offsets(means: DataFrame, centres: np.ndarray) -> dict[str, list[int]]:
    ks = range(len(centres))
    columns = means.sparkSession.createDataFrame([(i, *c) for i, c in enumerate(centres.T.astype(int).tolist())], "slot int" + "".join(f", c{k} bigint" for k in ks))
    products = means.join(F.broadcast(columns), "slot").groupBy("lang").agg(*(F.sum(F.col("mean") * F.col(f"c{k}")) for k in ks))  # BAG rows
    return {r[0]: list(r[1:]) for r in products.collect()}


def _moved(bags: DataFrame, means: DataFrame, model: Topics) -> np.ndarray:
    """The centres after one round over all documents; one that no document is nearest to stays."""
    ks = range(len(model.centres))

    def run(batches):
        sums, docs = np.zeros((len(ks), BAG)), {}
        for some, langs in _parts(batches):
            row, slot, x = weighed = model.weighed(some)
            topic = model.of(weighed, langs)
            sums += np.bincount(topic[row] * BAG + slot, x, minlength=sums.size).reshape(sums.shape)
            for lang, k in zip(langs, topic):
                docs.setdefault(lang, [0] * len(ks))[k] += 1
        numbers = np.concatenate([sums.T, np.array(list(docs.values()), float).reshape(-1, len(ks))]).astype(np.int64)
        names = [pa.array([None] * BAG + list(docs), pa.string()), pa.array([*range(BAG), *[None] * len(docs)], pa.int32())]
        yield pa.RecordBatch.from_arrays([*names, *(pa.array(numbers[:, k]) for k in ks)], names=["lang", "slot", *(f"n{k}" for k in ks)])

    per_task = bags.select("lang", "bag").mapInArrow(run, "lang string, slot int" + "".join(f", n{k} bigint" for k in ks))
    rows = per_task.groupBy("lang", "slot").agg(*(F.sum(f"n{k}") for k in ks)).collect()  # BAG rows and one a language
    sums = np.zeros((BAG, len(ks)), np.int64)
    for r in rows:
        if r[0] is None:
            sums[r[1]] = r[2:]
    docs = means.sparkSession.createDataFrame([(r[0], *r[2:]) for r in rows if r[0] is not None], "lang string" + "".join(f", n{k} bigint" for k in ks))
    of_langs = means.join(F.broadcast(docs), "lang").groupBy("slot").agg(*(F.sum(F.col("mean") * F.col(f"n{k}")) for k in ks))  # at most CELLS_AT_MOST rows
    for r in of_langs.collect():
        sums[r[0]] -= np.array(r[1:], np.int64)
    units = np.stack([_unit(v) for v in sums.T.astype(float)])
    return np.where(units.any(1)[:, None], units, model.centres)


def fit_topics(bags: DataFrame, topics: int = TOPICS, rounds: int = FITTED) -> Topics:
    """Over all of ``bags(doc_id, lang, bag)`` in every round, until nothing moves or for ``rounds``.

    Only where the centres start is drawn: from the first different documents by a hash over the whole table.
    """
    langs = bags.groupBy("lang").count().limit(CELLS_AT_MOST + 1).collect()
    if len(langs) > CELLS_AT_MOST:
        raise ValueError(f"more than {CELLS_AT_MOST} languages")
    n = sum(r[1] for r in langs)
    model = Topics(_rarity(bags, n), np.zeros((1, BAG)), {})
    if not n:
        return model
    means = stage(_language_means(bags, model), "language_means")
    first = first_by_hash(bags, 4 * topics, "doc_id", "lang", "bag").select("lang", "bag").collect()
    own = {r["lang"]: np.zeros(BAG) for r in first}
    for r in means.where(F.col("lang").isin(list(own))).collect():
        own[r["lang"]][r["slot"]] = r["mean"]
    starts = {}
    for r in first:
        _, slot, x = model.weighed([r["bag"]])
        v = -own[r["lang"]]
        v[slot] += x
        starts.setdefault(_unit(v).tobytes(), _unit(v))
    model.centres = np.stack(list(starts.values())[:topics])
    model.offsets = _offsets(means, model.centres)
    for _ in range(rounds):
        centres = _moved(bags, means, model)
        if np.array_equal(centres, model.centres):
            break
        model = Topics(model.idf, centres, _offsets(means, centres))
    return model


def sized(bags: DataFrame, topics: Topics) -> DataFrame:
    """``(doc_id, source, lang, topic, tokens)`` of all bags."""

    def run(batches):
        for b in batches:
            for part in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                topic = topics.of(topics.weighed(part.column("bag").to_pylist()), part.column("lang").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array([f"topic{k}" for k in topic], pa.string()), part.column("tokens")], names=["doc_id", "source", "lang", "topic", "tokens"])

    return bags.select("doc_id", "source", "lang", "tokens", "bag").mapInArrow(run, "doc_id bigint, source string, lang string, topic string, tokens bigint")


def _capped_scale(w: np.ndarray, size: np.ndarray, cap: np.ndarray, target: float) -> np.ndarray:
    """Scale ``w`` by one factor, capped, so that the weighted size is the target (or all caps, if that is less)."""
    if target <= 0 or not size.sum():
        return np.zeros_like(w)
    w = np.where(size > 0, np.maximum(w, 1e-12), 0)
    if (cap * size).sum() <= target:
        return np.where(size > 0, cap, 0)
    order = np.argsort(cap / np.maximum(w, 1e-300))
    full, left = 0.0, (w * size).sum()
    for i in order:
        scale = (target - full) / left if left > 0 else np.inf
        if scale * w[i] <= cap[i]:
            break
        full += cap[i] * size[i]
        left -= w[i] * size[i]
    return np.minimum(scale * w, cap)


def _members(values: list[str]) -> dict[str, np.ndarray]:
    """Positions of every value, by one sort."""
    names, code = np.unique(np.array(values, object).astype(str), return_inverse=True)
    cut = np.cumsum(np.bincount(code, minlength=len(names)))[:-1]
    return dict(zip(names.tolist(), np.split(np.argsort(code, kind="stable"), cut)))


def rake(cells: list[tuple[str, str, str, float]], targets: dict[str, tuple[float, float]], total: float | None = None, temperature: float = TEMPERATURE, rounds: int = ROUNDS) -> tuple[np.ndarray, float, dict]:
    """Weights of the cells ``(source, lang, topic, tokens)``, the size of the mixture and the wanted shares by axis and value.

    ``targets`` gives each source its share and cap. Sources without tokens can give nothing: the shares of
    the others keep their proportions and add up to one. The wanted language and topic shares are those the
    sources have at these shares, to the power of ``temperature``, which lifts small ones; they yield where
    caps and sources say so.
    """
    size = np.array([c[3] for c in cells], float)
    axes = {name: _members([c[i] for c in cells]) for i, name in enumerate(("source", "lang", "topic"))} if cells else {"source": {}, "lang": {}, "topic": {}}
    own = {s: size[g].sum() for s, g in axes["source"].items()}
    whole = sum(t[0] for s, t in targets.items() if own.get(s))
    if not whole:
        return np.zeros(len(cells)), 0.0, {a: {} for a in axes}
    share = {s: targets[s][0] / whole for s in axes["source"] if own[s]}
    cap = np.array([targets[c[0]][1] for c in cells], float)
    most = min(targets[s][1] * own[s] / p for s, p in share.items() if p > 0)
    total = most if total is None else min(total, most)
    natural = size * np.array([share.get(c[0], 0.0) / max(own[c[0]], 1e-300) for c in cells])
    wanted = {"source": share}
    for axis in ("lang", "topic"):
        p = {v: natural[g].sum() ** temperature for v, g in axes[axis].items()}
        z = sum(p.values())
        wanted[axis] = {v: x / z for v, x in p.items()}
    w = np.ones(len(cells))
    for _ in range(rounds):
        before = w.copy()
        for axis in ("topic", "lang", "source"):
            for v, g in axes[axis].items():
                w[g] = _capped_scale(w[g], size[g], cap[g], wanted[axis].get(v, 0.0) * total)
        if (np.abs(w - before) * size).sum() <= SETTLED * max(total, 1.0):
            break
    return w, total, wanted


class Plan:
    """What a mixture is drawn from: the sized documents, the weights of their cells and the wanted shares."""

    def __init__(self, docs: DataFrame, weights: list[tuple], wanted: dict) -> None:
        self.docs, self.weights, self.wanted = docs, weights, wanted


def plan(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, path: str = tokens.RANKS, temperature: float = TEMPERATURE) -> Plan:
    rows = targets.where("source is not null and target_share is not null and max_repeats is not null").limit(SOURCES_AT_MOST + 1).collect()
    if len(rows) > SOURCES_AT_MOST:
        raise ValueError(f"more than {SOURCES_AT_MOST} target sources")
    wanted = {r["source"]: (float(r["target_share"]), float(r["max_repeats"])) for r in rows}
    few = F.broadcast(targets.select(F.col("source").alias("s")).distinct())  # at most SOURCES_AT_MOST, as checked
    named = documents.select("doc_id", "source", "lang", "text").join(few, F.col("source") == F.col("s"), "left_semi")
    bags = stage(bagged(named, path), "bags")
    docs = stage(sized(bags, fit_topics(bags)), "sized")
    sums = docs.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).limit(CELLS_AT_MOST + 1).collect()
    if len(sums) > CELLS_AT_MOST:
        raise ValueError(f"more than {CELLS_AT_MOST} cells of source, language and topic")
    cells = sorted((r["source"], r["lang"], r["topic"], float(r["tokens"]), r["docs"]) for r in sums)
    weights, _, shares = rake([c[:4] for c in cells], wanted, total_tokens, temperature)
    docs_of: dict[str, int] = {}
    for c in cells:
        docs_of[c[0]] = docs_of.get(c[0], 0) + c[4]
    return Plan(docs, [(*c[:3], float(w), -(-docs_of[c[0]] // BUCKET)) for c, w in zip(cells, weights)], shares)


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, path: str = tokens.RANKS, temperature: float = TEMPERATURE, seed: int = 42) -> DataFrame:
    """``(doc_id, source, lang, topic, tokens, copies)``: the documents of the mixture and how often each is used.

    ``documents(doc_id, source, lang, text)``, ``targets(source, target_share, max_repeats)``. Sources
    without a target, null sources and documents without tokens are not used; repeated rows are documents
    of their own. A wanted source without any tokens gives nothing, and the others keep the proportions of
    their shares; the result is empty only if no wanted source has tokens, as for an empty table.
    """
    return draw(plan(documents, targets, total_tokens, path, temperature), seed)


def draw(made: Plan, seed: int = 42) -> DataFrame:
    """The documents of a plan, sampled by its weights."""
    weights = made.docs.sparkSession.createDataFrame(made.weights, "source string, lang string, topic string, weight double, buckets int")

    def sample(key, rows):
        rows = rows.sort_by([("lang", "ascending"), ("topic", "ascending"), ("tokens", "descending"), ("doc_id", "ascending")])
        weight, size = rows["weight"].to_numpy(), rows["tokens"].to_numpy()
        cell = np.unique(np.array([f"{a}/{b}" for a, b in zip(rows["lang"].to_pylist(), rows["topic"].to_pylist())]), return_inverse=True)[1]
        stratum = cell * 256 + (4 * np.log2(size)).astype(np.int64)
        rng = np.random.default_rng(xxhash.xxh64_intdigest(f"{key[0].as_py()}/{key[1].as_py()}", seed))
        copies, missed = None, np.inf
        for _ in range(DRAWS):
            order = np.lexsort((rng.random(len(size)), stratum))
            drawn = np.empty(len(size), np.int32)
            drawn[order] = np.diff(np.floor(np.r_[0.0, np.cumsum(weight[order])] + rng.random() + 1e-9))
            if (error := abs(((drawn - weight) * size).sum())) < missed:
                copies, missed = drawn, error
        return rows.select(["doc_id", "source", "lang", "topic", "tokens"]).append_column("copies", pa.array(copies))

    return (
        made.docs.join(F.broadcast(weights), ["source", "lang", "topic"])  # at most CELLS_AT_MOST rows, as checked
        .withColumn("bucket", F.expr(f"pmod(xxhash64(doc_id, {seed}), buckets)"))
        .groupBy("source", "bucket")
        .applyInArrow(sample, "doc_id bigint, source string, lang string, topic string, tokens bigint, copies int")
        .where("copies > 0")
    )


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, actual_share, tokens, docs, most_copies)``: the shares as they came out."""
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("docs"), F.max("copies").alias("most_copies"))
    whole = used.agg(F.sum("tokens").alias("whole"))
    return (
        targets.select("source", "target_share").join(used, "source", "left").crossJoin(F.broadcast(whole))  # one row
        .selectExpr("source", "target_share", "coalesce(tokens / whole, 0D) as actual_share", "coalesce(tokens, 0) as tokens", "coalesce(docs, 0) as docs", "coalesce(most_copies, 0) as most_copies")
    )


def margin_report(mixed: DataFrame, made: Plan) -> DataFrame:
    """``(axis, value, wanted_share, actual_share, tokens)`` of all sources, languages and topics: how far each marginal was met."""
    asked = [(axis, v, float(x)) for axis, shares in made.wanted.items() for v, x in shares.items()]
    wanted = mixed.sparkSession.createDataFrame(asked, "axis string, value string, wanted_share double")
    used = mixed.select(F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in ("source", "lang", "topic")))).alias("m"), (F.col("tokens") * F.col("copies")).alias("n"))
    sums = used.groupBy("m.axis", "m.value").agg(F.sum("n").alias("tokens"))
    whole = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy("axis"))
    return wanted.join(sums, ["axis", "value"], "left").select("axis", "value", "wanted_share", F.coalesce(F.try_divide("tokens", whole), F.lit(0.0)).alias("actual_share"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"))

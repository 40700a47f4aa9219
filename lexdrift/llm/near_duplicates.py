"""Near-duplicate records: signature-coordinate inverted join.

1. Each record becomes the set of hashes of its word sequences and a signature of ``COORDS`` minimum
   hashes (one Arrow pass, numpy over whole batches).
2. Records with exactly the same set form a class; only its smallest id goes on.
3. The representatives are posted under each coordinate-value pair. Two records with a similarity of
   0.5 agree in about half of the coordinates; pairs are kept that agree in at least ``MATCHES``.
   *Prefix*: with the coordinate-values of each record ordered from rare to common, two records that
   agree in m of K coordinates share one among the first K - m + 1 of each, so only those are merged.
   *Skip*: values that occur once need no merge at all, and they fill the prefix first, so the long
   lists of common values are mostly never opened.
   Each opened posting carries the low three bits of its record's whole signature (24 bytes), so the
   collisions of a pair are counted where it is met, as a bit count, and a pair with fewer than the
   wanted number never leaves its task. Bits agree wherever coordinates do: nothing is lost.
4. The pairs are checked exactly on the full sets (of 32-bit hashes).

Hot groups. Classes take out exact copies before any pair is made. Values that a sample shows to be very
common are counted apart, by partial sums, so no task counts one value alone. An opened posting of more than
``CROWD`` records is not joined with itself as a whole: a record there can share with another only what is
not its own alone, which bounds the sizes its partners may have, and it is merged only with records of those
sizes, in blocks of at most ``BLOCK``. Records that share a common part and are otherwise different never meet.
The bounds are proven ones: no link is lost, whatever the sample, the crowd and the blocks are.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexdrift.session import stage

COORDS, MATCHES, EXPAND, PLANES = 64, 20, 64, 3
CROWD, BLOCK, BAND = 256, 4096, 1.1  # largest posting joined as a whole, rows of a block, ratio of sizes of a band
TRIED, OFTEN = 4000, 8  # records in the sample for very common values, and how many of them make a value so: at most COORDS * TRIED / OFTEN values
WORD = re.compile(r"[^\W_]+")
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (constants of the public splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _multipliers(coords: int) -> np.ndarray:
    return _mix(np.arange(1, 2 * coords + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def sets_and_signatures(texts: list[str], width: int, least_words: int, coords: int):
    """Positions of the texts that take part, their sorted distinct hashes (flat, with starts) and signatures."""
    words, counts = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        found = WORD.findall(t.lower())
        counts[i] = len(found)
        words += found
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64), np.zeros((coords, 0), np.uint32)
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), U, len(distinct))[codes]
    doc = np.repeat(np.arange(len(texts)), counts)
    n = len(hashed) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64), np.zeros((coords, 0), np.uint32)
    with np.errstate(over="ignore"):
        sh = np.zeros(n, U)
        for k in range(width):
            sh = _mix(sh * U(0x9E3779B97F4A7C15) + hashed[k : k + n])
    whole = (doc[:n] == doc[width - 1 :]) & (counts[doc[:n]] >= max(least_words, width))
    sh, d = sh[whole], doc[:n][whole]
    order = np.lexsort((sh, d))
    sh, d = sh[order], d[order]
    if not len(sh):
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64), np.zeros((coords, 0), np.uint32)
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (d[1:] != d[:-1])
    sh, d = sh[new], d[new]
    starts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
    sig, m = np.empty((coords, len(starts)), np.uint32), _multipliers(coords)
    for k in range(coords):
        with np.errstate(over="ignore"):
            sig[k] = np.minimum.reduceat(((sh * m[2 * k] + m[2 * k + 1]) >> U(32)).astype(np.uint32), starts)
    return d[starts], sh, starts, sig


def _plane(sig: np.ndarray, bit: int) -> np.ndarray:
    """One bit of each of up to 64 coordinates, as one number per record."""
    out = np.zeros(sig.shape[1], U)
    for k in range(len(sig)):
        out |= ((sig[k] >> np.uint32(bit)) & np.uint32(1)).astype(U) << U(k)
    return out.view(np.int64)


def _sketch(width: int, least_words: int, coords: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = ["\n".join(x for x in c if x is not None) if c else "" for c in part.column(1).to_pylist()]
                rows, sh, starts, sig = sets_and_signatures(texts, width, least_words, coords)
                if not len(rows):
                    continue
                ends = np.r_[starts, len(sh)].astype(np.int32)
                with np.errstate(over="ignore"):
                    sums = np.add.reduceat(_mix(sh ^ U(0xA5A5A5A5A5A5A5A5)), starts)
                xors = np.bitwise_xor.reduceat(_mix(sh + U(77)), starts)
                flat = np.ascontiguousarray(sig.T).reshape(-1).view(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(rows)),
                        pa.array(np.diff(ends), pa.int32()),
                        pa.array(sums.view(np.int64)),
                        pa.array(xors.view(np.int64)),
                        *(pa.array(_plane(sig, p)) for p in range(PLANES)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, coords), pa.int32()), pa.array(flat)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(sh.astype(np.uint32).view(np.int32))),
                    ],
                    names=["row_id", "n", "k1", "k2", *(f"b{p}" for p in range(PLANES)), "sig", "sh"],
                )

    return run


def record_sets(df: DataFrame, key: str, parts: str, width: int = 5, least_words: int = 5, coords: int = COORDS) -> DataFrame:
    """``(row_id, n, k1, k2, b0, b1, b2, sig, sh)`` of the records that take part, staged in the shared folder.

    ``parts`` is an array of texts, joined by line breaks without its nulls. Records of fewer words
    than ``least_words`` (or than one sequence) take no part: null lists, empty texts.
    """
    rows = df.select(F.col(key).cast("bigint").alias("row_id"), F.col(parts).alias("parts"))
    return stage(rows.mapInArrow(_sketch(width, least_words, coords), "row_id bigint, n int, k1 bigint, k2 bigint, b0 bigint, b1 bigint, b2 bigint, sig array<int>, sh array<int>"), "sets")


def classes(sets: DataFrame) -> DataFrame:
    """``(row_id, class_id)``: records of exactly the same set share the smallest of their ids."""
    reps = sets.groupBy("k1", "k2", "n").agg(F.min("row_id").alias("class_id"))
    return sets.select("row_id", "k1", "k2", "n").join(reps, ["k1", "k2", "n"]).select("row_id", "class_id").distinct()


def _posted(chosen: DataFrame, tried: int, often: int) -> DataFrame:
    """``(row_id, value, posted)`` of the values that more than one record has."""
    postings = chosen.select("row_id", F.posexplode("sig").alias("c", "v")).select("row_id", F.xxhash64("c", "v").alias("value"))
    share = max(1, -(-chosen.count() // tried))
    sampled = postings.where(F.expr(f"pmod(xxhash64(row_id, 5), {share}) = 0"))
    hot = stage(sampled.groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") >= often).select("value"), "hot")  # a bounded list, see OFTEN
    counted = postings.join(F.broadcast(hot), "value", "left_semi").groupBy("value").agg(F.count("*").alias("posted"))
    common = postings.join(F.broadcast(counted), "value")
    rest = postings.join(F.broadcast(hot), "value", "left_anti").selectExpr("row_id", "value", "count(*) over (partition by value) as posted").where("posted > 1")
    return rest.unionByName(common.select("row_id", "value", "posted"))


def _crowded(opened: DataFrame, sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """Pairs of records that meet in a crowded posting and whose sizes and own parts let them be similar enough."""
    crowd = opened.select("row_id").distinct()
    words = sets.select("row_id", F.explode("sh").alias("h")).join(crowd, "row_id")
    own = words.groupBy("h").agg(F.count("*").alias("times"), F.min("row_id").alias("row_id")).where("times = 1").groupBy("row_id").agg(F.count("*").alias("own"))
    t, band = threshold, lambda n: f"cast(floor(ln(greatest({n}, 1)) / ln({BAND})) as int)"
    sized = (
        opened.join(own, "row_id", "left").withColumn("free", F.col("n") - F.coalesce("own", F.lit(0)))
        .withColumn("least", F.ceil(F.col("n") * t - 1e-9)).withColumn("most", F.floor(F.least(F.col("n") / t, F.col("free") * ((1 + t) / t) - F.col("n")) + 1e-9))
        .where("least <= most").withColumn("band", F.expr(band("n")))
    )
    sized = stage(sized.select("row_id", "value", "b0", "b1", "b2", "n", "free", "least", "most", "band"), "crowd")
    seek = sized.withColumn("to", F.explode(F.expr(f"sequence({band('least')}, {band('most')})")))
    there = sized.groupBy("value", "band").agg(F.ceil(F.count("*") / block).alias("blocks"))
    asked = seek.groupBy("value", "to").agg(F.ceil(F.count("*") / block).alias("asking"))
    cut = asked.join(there, (asked["value"] == there["value"]) & (asked["to"] == there["band"])).select(asked["value"], asked["to"].alias("band"), "asking", "blocks")
    x = seek.drop("band").withColumnRenamed("to", "band").join(cut, ["value", "band"]).selectExpr("*", "pmod(xxhash64(row_id, 7), asking) as i", "explode(sequence(0L, blocks - 1)) as j")
    y = sized.join(cut, ["value", "band"]).selectExpr("*", "pmod(xxhash64(row_id, 8), blocks) as j", "explode(sequence(0L, asking - 1)) as i")
    keys = ["value", "band", "i", "j"]
    sides = [d.select(*keys, *(F.col(c).alias(side + c) for c in ("row_id", "b0", "b1", "b2", "n", "free", "least", "most"))) for side, d in (("x_", x), ("y_", y))]
    return (
        sides[0].join(sides[1], keys).where("x_row_id < y_row_id and y_n between x_least and x_most and x_n between y_least and y_most")
        .where(F.least("x_free", "y_free") >= (F.col("x_n") + F.col("y_n")) * (t / (1 + t)) - 1e-9)
    )


def class_links(sets: DataFrame, membership: DataFrame, threshold: float = 0.8, coords: int = COORDS, matches: int = MATCHES, crowd: int = CROWD, block: int = BLOCK, tried: int = TRIED, often: int = OFTEN) -> DataFrame:
    """``(class_a, class_b, similarity)``, class_a < class_b: links between different sets, staged."""
    reps = membership.where("row_id = class_id").select("row_id")
    chosen = sets.select("row_id", "sig").join(reps, "row_id")
    prefix = coords - matches + 1
    # the values that are not posted twice are the rarest and take their places in the prefix
    opened = (
        _posted(chosen, tried, often).groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("posted", "value"))).alias("values"))
        .withColumn("room", F.lit(prefix - coords) + F.size("values"))
        .where("room > 0")
        .select("row_id", F.expr("slice(values, 1, room)").alias("values"))
        .join(sets.select("row_id", "b0", "b1", "b2", "n"), "row_id")
        .select("row_id", "b0", "b1", "b2", "n", F.explode("values").alias("p"))
        .select("row_id", "b0", "b1", "b2", "n", "p.value", "p.posted")
    )
    opened = stage(opened, "opened")
    agree = f"{coords} - bit_count((x_b0 ^ y_b0) | (x_b1 ^ y_b1) | (x_b2 ^ y_b2)) >= {matches}"
    a, b = (opened.where(F.col("posted") <= crowd).select("value", *(F.col(c).alias(side + c) for c in ("row_id", "b0", "b1", "b2"))) for side in ("x_", "y_"))
    ids = [F.col("x_row_id").alias("a"), F.col("y_row_id").alias("b")]
    met = a.join(b, "value").where("x_row_id < y_row_id").where(agree).select(*ids)
    crowded = opened.where(F.col("posted") > crowd)
    if crowded.limit(1).count():
        met = met.union(_crowded(crowded, sets, threshold, block).where(agree).select(*ids))
    pairs = stage(met.distinct(), "pairs")
    sides = pairs.select(F.explode(F.array("a", "b")).alias("row_id"), "a", "b")
    both = (
        sets.select("row_id", "sh").join(sides, "row_id")
        .groupBy("a", "b").agg(*(F.first(F.when(F.col("row_id") == F.col(x), F.col("sh")), ignorenulls=True).alias("of_" + x) for x in ("a", "b")))
        .selectExpr("a", "b", "size(array_intersect(of_a, of_b)) as common", "size(array_distinct(of_a)) + size(array_distinct(of_b)) as total")
        .selectExpr("a as class_a", "b as class_b", "common / (total - common) as similarity")
        .where(F.col("similarity") >= threshold)
    )
    return stage(both, "links")


def near_duplicates(df: DataFrame, key: str, parts: str, width: int = 5, least_words: int = 5, threshold: float = 0.8, coords: int = COORDS, matches: int | None = None, **hot):
    """Membership ``(row_id, class_id)`` and links ``(class_a, class_b, similarity)``.

    Every record of enough words has one row in the membership. Ids are unique; of a row that is
    repeated one copy counts. Links join different sets only. An empty table gives two empty tables.
    ``matches`` is three standard deviations below what pairs at the threshold agree in; ``hot`` are the bounds of crowded postings.
    """
    if matches is None:
        matches = max(1, int(threshold * coords - 3 * (coords * threshold * (1 - threshold)) ** 0.5))
    sets = record_sets(df, key, parts, width, least_words, coords)
    membership = stage(classes(sets), "classes")
    return membership, class_links(sets, membership, threshold, coords, matches, **hot)


def row_pairs(membership: DataFrame, links: DataFrame, expand: int = EXPAND) -> DataFrame:
    """``(row_id_a, row_id_b)``, a < b: the links between rows.

    Classes of up to ``expand`` rows are written out. A larger class of exact copies keeps the
    compact form, in which nothing is lost: each copy is paired with the representative, and the
    representative with the linked classes.
    """
    size = membership.groupBy("class_id").agg(F.count("*").alias("members"))
    # only classes with more than one row and those with links matter here
    many = size.where("members > 1")
    copies = membership.join(many, "class_id")
    small, large = copies.where(F.col("members") <= expand), copies.where(F.col("members") > expand)
    inside = small.select("class_id", F.col("row_id").alias("a")).join(small.select("class_id", F.col("row_id").alias("b")), "class_id").where("a < b").select("a", "b")
    star = large.where("row_id > class_id").select(F.col("class_id").alias("a"), F.col("row_id").alias("b"))
    linked = links.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).distinct()
    stand = membership.join(linked, "class_id").join(many, "class_id", "left").where(f"members is null or members <= {int(expand)} or row_id = class_id").select("class_id", "row_id")
    across = (
        links.select("class_a", "class_b")
        .join(stand.select(F.col("class_id").alias("class_a"), F.col("row_id").alias("x")), "class_a")
        .join(stand.select(F.col("class_id").alias("class_b"), F.col("row_id").alias("y")), "class_b")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    )
    return inside.union(star).union(across).select(F.col("a").alias("row_id_a"), F.col("b").alias("row_id_b")).distinct()


def groups(membership: DataFrame, links: DataFrame, rounds: int = 40) -> DataFrame:
    """``(row_id, class_id, group_id, links)``: one row per record; group = smallest class id reachable.

    Smallest labels are passed along the links, with each label replaced by its own label in every
    round (pointer jumping), until nothing changes. Only the number of changes reaches the driver.
    """
    edges = stage(links.selectExpr("class_a as u", "class_b as v").union(links.selectExpr("class_b as u", "class_a as v")), "edges")
    label = stage(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")), "labels")
    for _ in range(rounds):
        near = edges.join(label.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        passed = label.join(near, "u").select("u", F.least("l", "m").alias("l"), F.col("l").alias("was"))
        jumped = passed.join(label.select(F.col("u").alias("l"), F.col("l").alias("ll")), "l", "left").select("u", F.coalesce(F.least("ll", "l"), "l").alias("l"), "was")
        label = stage(jumped, "labels")
        if not label.where("l <> was").limit(1).count():
            break
        label = label.select("u", "l")
    else:
        raise RuntimeError(f"labels still changed after {rounds} rounds")
    degree = edges.groupBy("u").agg(F.count("*").alias("links"))
    return (
        membership.join(label.select(F.col("u").alias("class_id"), F.col("l").alias("group_id")), "class_id", "left")
        .join(degree.withColumnRenamed("u", "class_id"), "class_id", "left")
        .select("row_id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
    )


def class_table(membership: DataFrame, links: DataFrame) -> DataFrame:
    """``(row_id, class_id, copies, links)``: one row per record; ``links`` counts the other rows it is linked with, copies included.

    Together with ``row_pairs`` this says everything about large classes, whose copies are not paired with one another.
    """
    size = membership.groupBy("class_id").agg(F.count("*").alias("copies"))
    sides = links.select(F.explode(F.array(F.struct(F.col("class_a").alias("class_id"), F.col("class_b").alias("other")), F.struct(F.col("class_b").alias("class_id"), F.col("class_a").alias("other")))).alias("s")).select("s.*")
    far = sides.join(size.select(F.col("class_id").alias("other"), "copies"), "other").groupBy("class_id").agg(F.sum("copies").alias("far"))
    per = size.join(far, "class_id", "left").select("class_id", "copies", (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).cast("bigint").alias("links"))
    return membership.join(per, "class_id").select("row_id", "class_id", "copies", "links")

"""Writers of the stored forms. Every writer takes a frame and a path and returns nothing."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upserted(df: DataFrame, path: str, key: str, *latest: F.Column) -> None:
    """Add rows to the table at ``path``: the last row of every key stays, of those stored and those added.

    Rows without a key are dropped; at equal ``latest`` the added row wins. The new table is written
    beside the old one and takes its place when it is whole.
    """
    from lexdrift.operators.threads import upsert

    spark, new = df.sparkSession, f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    target, written = sc._jvm.org.apache.hadoop.fs.Path(path), sc._jvm.org.apache.hadoop.fs.Path(new)
    fs = target.getFileSystem(sc._jsc.hadoopConfiguration())
    added = df.withColumn("_added", F.lit(1))
    if fs.exists(target):
        added = spark.read.parquet(path).withColumn("_added", F.lit(0)).unionByName(added, allowMissingColumns=True)
    upsert(added, key, *latest, F.col("_added")).drop("_added").write.parquet(new)
    fs.delete(target, True)
    if not fs.rename(written, target):
        raise OSError(f"the new table stays at {new}")


def indexed_threads(df: DataFrame, path: str, key: str = "row_id") -> None:
    """Threads by forum, and beside them the search index partitioned by a hash of the token."""
    from lexdrift.operators.threads import inverted_index

    df.write.mode("overwrite").partitionBy("forum").parquet(f"{path}/threads")
    index = inverted_index(df, key).withColumn("part", F.pmod(F.hash("token"), F.lit(64)))
    index.repartition("part").sortWithinPartitions("token").write.mode("overwrite").partitionBy("part").parquet(f"{path}/index")


def training_text(lines: DataFrame, path: str, line: str = "line") -> None:
    """One line a thread: all forums together, and a folder per forum."""
    lines.select(line).write.mode("overwrite").text(f"{path}/all")
    lines.select("forum", line).write.mode("overwrite").partitionBy("forum").text(f"{path}/by_forum")


def thread_json(threads: DataFrame, path: str) -> None:
    """Threads as JSON lines: all together, and a folder per forum."""
    threads.write.mode("overwrite").json(f"{path}/all")
    threads.write.mode("overwrite").partitionBy("forum").json(f"{path}/by_forum")


def sorted_json(df: DataFrame, path: str, *order: str) -> None:
    """JSON lines in the order of the given columns: counts, comparisons, annotations, coverage."""
    df.orderBy(*order).write.mode("overwrite").json(path)


def dated_index(dated: DataFrame, threads: DataFrame, path: str) -> None:
    """Two tables: tokens with the dates of their threads, and the threads."""
    dated.write.mode("overwrite").parquet(f"{path}/tokens")
    threads.write.mode("overwrite").parquet(f"{path}/threads")


def vocabulary_text(vocab: DataFrame, path: str) -> None:
    """``word cn gcn bcn`` in the order of the numbers."""
    vocab.orderBy("idx").select(F.concat_ws(" ", "word", "cn", "gcn", "bcn")).write.mode("overwrite").text(path)


def vectors_text(vectors: DataFrame, path: str) -> None:
    """Header ``words dim``, then ``word v1 ... vd``; one file, in the order of the numbers."""
    n = vectors.count()
    dim = len(vectors.first()["vector"]) if n else 0
    head = vectors.sparkSession.createDataFrame([(-1, f"{n} {dim}")], "idx bigint, value string")
    body = vectors.select("idx", F.concat_ws(" ", "word", F.array_join(F.transform("vector", lambda x: x.cast("string")), " ")).alias("value"))
    head.union(body).repartitionByRange(1, "idx").sortWithinPartitions("idx").select("value").write.mode("overwrite").text(path)


def vectors_binary(vectors: DataFrame, path: str, parts: int = 1) -> None:
    """The binary form: a folder of ``parts`` native files, each with its header, in the order of the numbers.

    Every file is written by its task, straight to the file system of the path.
    """

    def run(batches):
        from pyarrow import fs

        rows = [(w, v) for b in batches for w, v in zip(b.column(1).to_pylist(), b.column(2))]
        system, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
        system.create_dir(inner, recursive=True)
        name = f"{inner.rstrip('/')}/part-{TaskContext.get().partitionId():05d}.bin"
        with system.open_output_stream(f"{name}.tmp") as f:
            f.write(f"{len(rows)} {len(rows[0][1]) if rows else 0}\n".encode())
            for w, v in rows:
                f.write(w.encode() + b" " + v.values.to_numpy(zero_copy_only=False).astype("<f4").tobytes() + b"\n")
        system.move(f"{name}.tmp", name)  # a task that is run again replaces its file
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], names=["n"])

    ordered = vectors.select("idx", "word", "vector").repartitionByRange(parts, "idx").sortWithinPartitions("idx")
    ordered.mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def output_matrix(weights, words: DataFrame, path: str, binary: bool = False) -> None:
    """The output matrix of a training (``syn1``, ``syn1neg``), a row per word, in the form of vectors."""
    from lexdrift.operators.training import as_vectors

    (vectors_binary if binary else vectors_text)(as_vectors(words, {"out": weights}).select("idx", "word", "vector"), path)


def classes_text(classes: DataFrame, path: str) -> None:
    """``word class``, by class and word."""
    classes.orderBy("class", "word").select(F.concat_ws(" ", "word", "class")).write.mode("overwrite").text(path)


def matrix(cells: DataFrame, path: str) -> None:
    """Non-zero cells in long form."""
    cells.where("value <> 0").write.mode("overwrite").parquet(path)


def evaluation_csv(cands: DataFrame, missed: DataFrame, path: str) -> None:
    """Ranked candidates without a header, and the missed annotations with one."""
    cands.orderBy("rank").write.mode("overwrite").csv(f"{path}/candidates")
    missed.orderBy("word").write.mode("overwrite").option("header", "true").csv(f"{path}/missed")


def simulated(lines: DataFrame, plan: DataFrame, path: str) -> None:
    """The changed corpus and its answers."""
    lines.orderBy("line_id").select("line").write.mode("overwrite").text(f"{path}/corpus")
    plan.orderBy("word").select(F.concat_ws("\t", "word", "n", "target", "target_n")).write.mode("overwrite").text(f"{path}/answers")


def linear_maps(maps: DataFrame, path: str) -> None:
    maps.write.mode("overwrite").parquet(path)


def plot_points(points: DataFrame, path: str) -> None:
    """Tables of points for the panels of a plot: measure, value, occurrence; drawing is left to others."""
    points.write.mode("overwrite").partitionBy("measure").json(path)


def phrase_text(lines: DataFrame, path: str) -> None:
    """Lines ``(line_id, tokens)`` with their phrases, as text in the order of the numbers."""
    lines.orderBy("line_id").select(F.array_join("tokens", " ")).write.mode("overwrite").text(path)


def comparison_json(report: DataFrame, path: str) -> None:
    """One JSON object a line and word: occurrences, distances and the two nested lists ``most_probable`` and ``most_occurred``."""
    report.orderBy("word").select(F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"})).write.mode("overwrite").text(path)


def comparison_stats_json(details: DataFrame, stats: DataFrame, path: str) -> None:
    """``stats``: measure to its statistics; ``details``: a line a word."""
    pairs = F.sort_array(F.collect_list(F.struct("measure", F.struct(*(c for c in stats.columns if c != "measure")).alias("s"))))  # a row per measure
    stats.agg(F.to_json(F.map_from_entries(pairs))).write.mode("overwrite").text(f"{path}/stats")
    details.orderBy("word").write.mode("overwrite").json(f"{path}/details")


def annotation_json(tokens: DataFrame, path: str) -> None:
    """``token`` to its triples ``[forum, type, tagger]``, one object a line."""
    triples = F.sort_array(F.collect_set(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("forum", "type", "tagger")))))
    tokens.groupBy("token").agg(triples.alias("triples")).orderBy("token").select(F.to_json(F.create_map("token", "triples"))).write.mode("overwrite").text(path)

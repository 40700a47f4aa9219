"""Readers of the stored forms: posts and pages, threads, text corpora, vocabularies, vectors, matrices, annotations."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexdrift.operators.vocabulary import indexed
from lexdrift.session import partitions

QUESTIONS = 10_000  # lines that look for their header in one task
VOCAB = T.StructType([T.StructField("word", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("cn", "gcn", "bcn"))])


def jdbc_posts(spark: SparkSession, url: str, posts: str = "post", users: str | None = "user", key: str = "userid", partition: str | None = None, lower: int = 0, upper: int = 0, tasks: int = 1, **options) -> DataFrame:
    """Posts of a relational store, with their users joined if a user table is named.

    The join is left to the Spark side, so both scans can be read in parallel by ``partition`` ranges and
    filters and columns are pushed down.
    """
    reader = lambda t: spark.read.format("jdbc").options(url=url, dbtable=t, **options)
    r = reader(posts)
    if partition:
        r = r.options(partitionColumn=partition, lowerBound=lower, upperBound=upper, numPartitions=tasks)
    out = r.load()
    return out.join(reader(users).load(), key, "left") if users else out


def threads(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Stored threads; only the named columns are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def pages(spark: SparkSession, path: str, pattern: str = "index.php*topic*", recursive: bool = False) -> DataFrame:
    """``(path, html)`` of page files one level down, or anywhere below with ``recursive``."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    r = r.option("recursiveFileLookup", "true").load(path) if recursive else r.load(f"{path.rstrip('/')}/*")
    return r.select("path", F.decode("content", "UTF-8").alias("html"))


def crawled_pages(spark: SparkSession, path: str, body: str = "response_body", meta: str = "meta", without: str | None = None) -> DataFrame:
    """``(path, url, html)``: files named ``body`` anywhere below, with the url of the JSON file ``meta`` beside each."""
    read = lambda name: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(path).select(
        F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.decode("content", "UTF-8").alias("text")
    )
    out = read(body).join(read(meta).select("dir", F.get_json_object("text", "$.url").alias("url")), "dir", "left")
    out = out.where(~F.col("dir").contains(without)) if without else out
    return out.select(F.col("dir").alias("path"), "url", F.col("text").alias("html"))


def like_pages(pages: DataFrame, column: str = "url", unlike: list[str] | None = None, prefix: str | None = None) -> DataFrame:
    """Pages whose address has the prefix and is like none of the patterns; the prefix reaches the scan."""
    out = pages.where(F.col(column).startswith(prefix)) if prefix else pages
    for p in unlike or []:
        out = out.where(~F.col(column).like(p))
    return out


def _numbered(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """``(line_id, value, file, last)`` of a text file or of the files of a folder, numbered from 0 in file order.

    A line's number is its place in its part of a file, as Spark splits it, after the lines of the parts before;
    a part is one row of the table of offsets. ``last`` marks the last line of a file.
    """
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    lines = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    parts = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    order = Window.orderBy("file", "block")  # a row per part of a file
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("file", "block", "n", "first", before.alias("before"), (F.row_number().over(Window.partitionBy("file").orderBy(F.desc("block"))) == 1).alias("end"))
    place = F.col("at") - F.col("first")
    return lines.join(offsets, ["file", "block"]).select((F.col("before") + place).alias("line_id"), "value", "file", (F.col("end") & (place == F.col("n") - 1)).alias("last"))


def line_corpus(spark: SparkSession, path: str, chunk: int = 10_000) -> DataFrame:
    """``(line_id, part, tokens)``: one sentence a line, longer ones in chunks."""
    tokens = F.filter(F.split("value", r"\s+"), lambda t: t != "")
    rows = _numbered(spark, path).select("line_id", tokens.alias("t")).where(F.size("t") > 0)
    cut = F.expr(f"transform(sequence(0, cast((size(t) - 1) div {chunk} as int)), k -> slice(t, k * {chunk} + 1, {chunk}))")
    return rows.select("line_id", F.posexplode(cut).alias("part", "tokens"))


def flat_stream(spark: SparkSession, path: str, chunk: int = 10_000) -> DataFrame:
    """``(part, tokens)`` of one endless line of tokens, read token by token at the blanks, so that it is split like any text."""
    pieces = _numbered(spark, path, " ").select("line_id", F.filter(F.split("value", r"\s+"), lambda t: t != "").alias("t")).where(F.size("t") > 0)
    numbered = pieces.select("line_id", F.posexplode("t").alias("pos", "token"))
    # blanks that follow one another make empty pieces, so the chunks are cut by the number of pieces before
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_id", "pos", "token"))), _token)
    return numbered.groupBy(F.expr(f"line_id div {chunk}").alias("part")).agg(ordered.alias("tokens"))


def _token(piece):
    return piece["token"]


def native_words(spark: SparkSession, path: str, cut: int = 99, end: str = "</s>") -> DataFrame:
    """``(line_id, tokens)``: tokens between blanks and tabs, cut to ``cut`` bytes, every line ended by its mark.

    A file that does not end with a line break loses the token that touches its end, and that line its mark.
    """
    tokens = F.filter(F.split(F.replace("value", F.lit("\r"), F.lit("")), "[ \t]+"), lambda t: t != "")
    cut_off = F.transform(tokens, lambda t: F.when(F.octet_length(t) > cut, F.substring(t.cast("binary"), 1, cut).cast("string")).otherwise(t))
    ends = _paths(spark, path).mapInArrow(_terminated, "file string, ended boolean")
    rows = _numbered(spark, path).join(ends, "file", "left")
    open_end = F.col("last") & ~F.coalesce("ended", F.lit(True))
    blank = F.col("value").rlike("[ \t]$")
    return rows.select("line_id", F.when(open_end, F.slice(cut_off, 1, F.greatest(F.size(tokens) - F.when(blank, 0).otherwise(1), F.lit(0)))).otherwise(F.concat(cut_off, F.array(F.lit(end)))).alias("tokens"))


def _paths(spark: SparkSession, path: str) -> DataFrame:
    """``(path)`` of the files; their contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path")


def _open(path: str):
    """A file of a local or shared file system, opened for reading at any place."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return system.open_input_file(inner)


def _terminated(batches):
    for b in batches:
        ended = []
        for p in b.column(0).to_pylist():
            with _open(p) as f:
                f.seek(max(0, f.size() - 1))
                ended.append(f.read(1) in (b"\n", b""))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ended, pa.bool_())], names=["file", "ended"])


def whole_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_id, text)``: every line a document."""
    return _numbered(spark, path).select("line_id", F.col("value").alias("text"))


def vocabulary(spark: SparkSession, path: str, min_count: int = 0) -> DataFrame:
    """``(idx, word, cn, gcn, bcn)`` of a file of four columns; lines that do not fit are dropped.

    The end mark comes first, the others by falling count; words below ``min_count`` are left out, except the end mark.
    """
    rows = spark.read.schema(VOCAB).option("sep", " ").option("mode", "DROPMALFORMED").option("quote", "").csv(path)
    return indexed(rows, min_count)


def vectors_text(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """``(idx, word, vector)`` of a text file with a header ``words dim``; lines of another length are skipped. ``first`` keeps the words of lowest numbers."""
    rows = _numbered(spark, path).select("line_id", F.split(F.trim("value"), " ").alias("f"))
    dim = rows.where("line_id = 0").select(F.expr("try_cast(get(f, 1) as int)").alias("dim"))
    body = rows.where("line_id > 0").crossJoin(F.broadcast(dim)).where(F.size("f") == F.col("dim") + 1)  # the header is one row
    out = body.select((F.col("line_id") - 1).alias("idx"), F.get("f", F.lit(0)).alias("word"), F.transform(F.slice("f", F.lit(2), F.col("dim")), lambda x: x.try_cast("double")).alias("vector"))
    return out.where(F.col("idx") < first) if first else out


RANGE_BYTES = 16 << 20  # of one range of records


class _Records:
    """Records ``word blank numbers`` of a native binary file, read through a buffer of bounded size."""

    def __init__(self, f, at: int, payload: int) -> None:
        self.f, self.payload, self.base, self.held = f, payload, at, b""
        f.seek(at)
        self.next = at

    def _need(self, size: int) -> bool:
        while self.next + size > self.base + len(self.held):
            more = self.f.read(max(1 << 20, size))
            if not more:
                return False
            self.held = self.held[self.next - self.base :] + more
            self.base = self.next
        return True

    def one(self):
        """``(place, word, numbers)`` of the next record, or None at the end of the file."""
        while True:
            if not self._need(1):
                return None
            if self.held[self.next - self.base] not in b"\n\r":
                break
            self.next += 1
        begin, size = self.next, 128
        while (blank := self.held.find(b" ", self.next - self.base)) < 0:
            if not self._need(size):
                return None
            size *= 2
        stop = self.base + blank
        word = self.held[self.next - self.base : blank]
        if not self._need(stop + 1 - self.next + self.payload):
            return None
        at = stop + 1 - self.base
        numbers = self.held[at : at + self.payload]
        self.next = stop + 1 + self.payload
        return begin, word.decode("utf-8", "replace"), numbers


def _ranges(kind: str, number: int):
    """One row per range of records: ``(path, at, place, rows, payload)``. The words are walked through, one task a file."""

    def run(batches):
        for b in batches:
            for p in b.column(0).to_pylist():
                out = []
                with _open(p) as f:
                    head = f.read(100).split(b"\n", 1)[0]
                    counts = list(map(int, head.split()))
                    payload = number * (counts[0] if kind == "matrix" else counts[1])
                    step = max(1, RANGE_BYTES // (payload + 16))
                    records, place = _Records(f, len(head) + 1, payload), 0
                    while place < counts[0] and (r := records.one()):
                        if place % step == 0:
                            out.append([p, r[0], place, 0, payload])
                        out[-1][3] += 1
                        place += 1
                columns = list(zip(*out)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.int64()] * 4))], names=["path", "at", "place", "rows", "payload"])

    return run


def _ranged(spark: SparkSession, path: str, kind: str, number: int) -> DataFrame:
    """Ranges of all files with ``before``, the records of the files before; a range is some MB, so they are few numbers."""
    found = _paths(spark, path).mapInArrow(_ranges(kind, number), "path string, at bigint, place bigint, rows bigint, payload bigint")
    order = Window.orderBy("path", "place").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("before", F.coalesce(F.sum("rows").over(order), F.lit(0)))


def vectors_binary(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """``(idx, word, vector)`` of the binary form: word, blank, little-endian floats; a folder is read in the order of its files.

    Files of any size: one pass finds where ranges of records begin, which are then read in parallel.
    """

    def run(batches):
        for b in batches:
            for p, at, rows, payload, before in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4, 5))):
                with _open(p) as f:
                    records = _Records(f, at, payload)
                    got = [records.one() for _ in range(rows)]
                numbers = np.frombuffer(b"".join(r[2] for r in got), "<f4").astype(np.float64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * (payload // 4), pa.int32()), pa.array(numbers))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(before, before + rows)), pa.array([r[1] for r in got]), lists], names=["idx", "word", "vector"])

    ranges = _ranged(spark, path, "vectors", 4)
    ranges = ranges.where(F.col("before") < first) if first else ranges
    out = ranges.repartition(partitions(spark), "path", "at").mapInArrow(run, "idx bigint, word string, vector array<double>")
    return out.where(F.col("idx") < first) if first else out


def matrix_binary(spark: SparkSession, path: str, kind: str = "f") -> DataFrame:
    """``(row, word, col, value)``, the cells other than 0 of a dump: number of words, then per row its word, a blank and as many 32-bit floats (``f``) or 64-bit integers (``q``)."""
    size = struct.calcsize("<" + kind)

    def run(batches):
        for b in batches:
            for p, at, rows, payload, before in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4, 5))):
                with _open(p) as f:
                    records = _Records(f, at, payload)
                    for row in range(before, before + rows):
                        _, word, numbers = records.one()
                        values = np.frombuffer(numbers, "<f4" if kind == "f" else "<i8").astype(float)
                        some = np.flatnonzero(values)
                        yield pa.RecordBatch.from_arrays([pa.array([row] * len(some), pa.int64()), pa.array([word] * len(some), pa.string()), pa.array(some), pa.array(values[some])], names=["row", "word", "col", "value"])

    return _ranged(spark, path, "matrix", size).repartition(partitions(spark), "path", "at").mapInArrow(run, "row bigint, word string, col bigint, value double")


def matrix_npy(spark: SparkSession, path: str) -> DataFrame:
    """``(row, col, value)`` of the cells other than 0 of a two-dimensional array file of any size, read by ranges of rows."""

    def header(f):
        version = np.lib.format.read_magic(f)
        shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if len(shape) != 2 or fortran or kind.hasobject:
            raise ValueError("only two-dimensional arrays of numbers in row order are read")
        return shape, kind

    def ranges(batches):
        for b in batches:
            for p in b.column(0).to_pylist():
                with _open(p) as f:
                    shape, kind = header(f)
                    step = max(1, RANGE_BYTES // max(1, shape[1] * kind.itemsize))
                    at = list(range(0, shape[0], step))
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array([min(step, shape[0] - a) for a in at], pa.int64())], names=["path", "at", "rows"])

    def run(batches):
        for b in batches:
            for p, at, rows in zip(*(b.column(i).to_pylist() for i in range(3))):
                with _open(p) as f:
                    shape, kind = header(f)
                    f.seek(f.tell() + at * shape[1] * kind.itemsize)
                    m = np.frombuffer(f.read(rows * shape[1] * kind.itemsize), kind).reshape(rows, shape[1])
                r, c = np.nonzero(m)
                yield pa.RecordBatch.from_arrays([pa.array(r + at), pa.array(c), pa.array(m[r, c].astype(float))], names=["row", "col", "value"])

    found = _paths(spark, path).mapInArrow(ranges, "path string, at bigint, rows bigint")
    return found.repartition(partitions(spark), "path", "at").mapInArrow(run, "row bigint, col bigint, value double")


def map_matrices(spark: SparkSession, path: str) -> DataFrame:
    """``(cluster, heldout, x, y)`` for the linear maps: a folder per cluster with the files ``train.x``, ``train.y``, ``heldout.x`` and ``heldout.y``.

    Each line is a key and its numbers; the two sides are joined by the key, within a cluster and a half.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.split(F.trim("value"), r"\s+").alias("f"), F.col("_metadata.file_path").alias("file")).where(F.size("f") > 1)
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    rows = lines.select(
        F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("cluster"), name.startswith("heldout").alias("heldout"), F.regexp_extract(name, r"^(?:train|heldout)\.([xy])", 1).alias("side"),
        F.get("f", F.lit(0)).alias("key"), F.transform(F.slice("f", F.lit(2), F.size("f")), lambda x: x.cast("double")).alias("v"),
    )
    x, y = (rows.where(F.col("side") == s).select("cluster", "heldout", "key", F.col("v").alias(s)) for s in "xy")
    return x.join(y, ["cluster", "heldout", "key"]).select("cluster", "heldout", "x", "y")


def aligned(a: DataFrame, b: DataFrame, key: str = "word") -> DataFrame:
    """Inner join of two matrices' rows after checking that both have the same keys."""
    ka, kb = a.select(key).distinct(), b.select(key).distinct()
    odd = ka.join(kb, key, "left_anti").union(kb.join(ka, key, "left_anti")).limit(1).collect()
    if odd:
        raise ValueError(f"{odd[0][0]!r} is in one of the two only")
    return a.join(b, key)


def counters_json(spark: SparkSession, path: str) -> DataFrame:
    """``(word, n)`` of a JSON object of counts."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,bigint>")).alias("word", "n"))


def annotations(spark: SparkSession, path: str, forum: str, long: bool = False) -> DataFrame:
    """``(forum, code, tagger, start, end_pos)`` of lines ``code tagger start end``, or ``code tagger start _ end`` if ``long``; short lines are skipped."""
    f = spark.read.option("pathGlobFilter", "*.txt").text(path).select(F.split(F.trim("value"), " ").alias("f")).where(F.size("f") >= (5 if long else 4))
    at = lambda i: F.get("f", F.lit(i))
    return f.select(F.lit(forum).alias("forum"), at(0).alias("code"), at(1).alias("tagger"), F.expr("try_cast(get(f, 2) as int)").alias("start"), F.expr(f"try_cast(get(f, {4 if long else 3}) as int)").alias("end_pos")).where("start is not null and end_pos is not null").distinct()


def tokenized_texts(spark: SparkSession, path: str, forum: str, typed: bool = True) -> DataFrame:
    """``(forum, code, type, text)``: files ``...<code>.txt.tok``; typed ones lie in a folder per annotation type and begin with ``0-initiator``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "0-initiator*txt.tok" if typed else "*txt.tok").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    code = name if forum == "hackforums" else F.regexp_extract(name, r"^.+?(\d+)\.txt\.tok", 1)
    kind = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1) if typed else F.lit(None).cast("string")
    return files.select(F.lit(forum).alias("forum"), code.alias("code"), kind.alias("type"), F.decode("content", "UTF-8").alias("text"))


def analogy_questions(spark: SparkSession, path: str) -> DataFrame:
    """``(qid, section, a, b, c, d)``: lines of four words under headers ``: section``, words in upper case.

    The header of a line is the last one before it, carried along in the order of the lines: within a part of
    the file, and from part to part by the last header of each.
    """
    rows = _numbered(spark, path).withColumn("block", F.expr(f"line_id div {QUESTIONS}"))
    head = F.when(F.col("value").startswith(":"), F.trim(F.expr("substring(value, 2)")))
    seen = rows.withColumn("own", F.last(head, ignorenulls=True).over(Window.partitionBy("block").orderBy("line_id")))
    ends = rows.groupBy("block").agg(F.max_by(head, F.when(head.isNotNull(), F.col("line_id"))).alias("end"))
    carried = ends.withColumn("before", F.last("end", ignorenulls=True).over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).select("block", "before")  # a row per block of lines
    q = seen.join(carried, "block").where(~F.col("value").startswith(":")).select("line_id", F.coalesce("own", "before").alias("section"), F.split(F.trim(F.upper("value")), r"\s+").alias("w")).where(F.size("w") == 4)
    return q.select(F.col("line_id").alias("qid"), "section", *(F.get("w", F.lit(i)).alias(c) for i, c in enumerate("abcd")))

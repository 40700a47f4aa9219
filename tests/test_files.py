"""Readers and writers: what is written is read back; files of the native forms are read."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexdrift.sources import readers as R
from lexdrift.sources import writers as W


def test_text_readers(spark, tmp_path):
    p = tmp_path / "c.txt"
    p.write_text("a b\tc\r\n\n" + "x" * 150 + " y\n")
    assert [r.tokens for r in R.native_words(spark, str(p)).orderBy("line_id").collect()] == [["a", "b", "c", "</s>"], ["</s>"], ["x" * 99, "y", "</s>"]]
    assert [(r.part, r.tokens) for r in R.line_corpus(spark, str(p), 2).orderBy("line_id", "part").collect()] == [(0, ["a", "b"]), (1, ["c"]), (0, ["x" * 150, "y"])]
    assert R.whole_lines(spark, str(p)).count() == 3
    flat = tmp_path / "flat"
    flat.write_text(" ".join(str(i) for i in range(25)))
    assert [len(r.tokens) for r in R.flat_stream(spark, str(flat), 10).orderBy("part").collect()] == [10, 10, 5]


def test_vocabulary_and_vectors(spark, tmp_path):
    v = spark.createDataFrame([(0, "</s>", 3, 1, 2), (1, "é\"x", 9, 4, 5)], "idx bigint, word string, cn bigint, gcn bigint, bcn bigint")
    W.vocabulary_text(v, str(tmp_path / "vocab"))
    assert [tuple(r) for r in R.vocabulary(spark, str(tmp_path / "vocab")).orderBy("idx").collect()] == [(0, "</s>", 3, 1, 2), (1, "é\"x", 9, 4, 5)]
    assert [r.word for r in R.vocabulary(spark, str(tmp_path / "vocab"), 10).collect()] == ["</s>"]
    m = spark.createDataFrame([(0, "a", [0.5, -1.0]), (1, "bé", [2.0, 0.25])], "idx bigint, word string, vector array<double>")
    W.vectors_text(m, str(tmp_path / "t"))
    W.vectors_binary(m, str(tmp_path / "b.bin"))
    want = [(0, "a", [0.5, -1.0]), (1, "bé", [2.0, 0.25])]
    assert [tuple(r) for r in R.vectors_text(spark, str(tmp_path / "t")).orderBy("idx").collect()] == want
    assert [tuple(r) for r in R.vectors_binary(spark, str(tmp_path / "b.bin")).orderBy("idx").collect()] == want
    assert R.vectors_text(spark, str(tmp_path / "t"), 1).count() == R.vectors_binary(spark, str(tmp_path / "b.bin"), 1).count() == 1


def _small_parts(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")


@pytest.fixture
def many_parts(spark):
    _small_parts(spark, "20000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_numbers_in_files_of_several_parts(spark, tmp_path, many_parts):
    n = 20_000
    (tmp_path / "v").write_text(f"{n} 3\n" + "".join(f"w{i} {i} 0.5 -1\n" for i in range(n)))
    got = R.vectors_text(spark, str(tmp_path / "v"))
    assert spark.read.text(str(tmp_path / "v")).rdd.getNumPartitions() > 4
    assert got.where("word = concat('w', idx) and vector[0] = idx").count() == got.count() == n
    assert R.vectors_text(spark, str(tmp_path / "v"), 15_000).count() == 15_000
    (tmp_path / "q").write_text("".join(f": s{i}\n" + "a b c d\n" * 3 for i in range(15_000)))
    q = R.analogy_questions(spark, str(tmp_path / "q"))
    assert q.where("section = concat('s', qid div 4)").count() == q.count() == 45_000
    (tmp_path / "flat").write_text(" ".join(f"t{i}" for i in range(n)))
    flat = R.flat_stream(spark, str(tmp_path / "flat"), 100).collect()
    assert sorted(r.part for r in flat) == list(range(200)) and all(r.tokens == [f"t{i}" for i in range(r.part * 100, r.part * 100 + 100)] for r in flat)


def test_binary_files_by_ranges(spark, tmp_path, monkeypatch):
    m = spark.range(3000).select(F.col("id").alias("idx"), F.concat(F.lit("wé"), "id").alias("word"), F.array(F.col("id").cast("double"), F.lit(0.5).cast("double")).alias("vector"))
    W.vectors_binary(m, str(tmp_path / "b"), parts=3)
    assert len(list((tmp_path / "b").glob("*.bin"))) == 3
    monkeypatch.setattr(R, "RANGE_BYTES", 1000)
    got = R.vectors_binary(spark, str(tmp_path / "b"))
    assert got.where("word = concat('wé', idx) and vector[0] = idx and vector[1] = 0.5").count() == got.count() == 3000
    assert R.vectors_binary(spark, str(tmp_path / "b"), 1700).agg(F.max("idx")).first()[0] == 1699
    big = np.arange(600.0).reshape(200, 3)
    np.save(tmp_path / "m.npy", big)
    assert {(r.row, r.col, r.value) for r in R.matrix_npy(spark, str(tmp_path / "m.npy")).collect()} == {(i, j, big[i, j]) for i in range(200) for j in range(3) if big[i, j]}


def test_native_words_at_the_end_of_a_file(spark, tmp_path):
    for text, want in (("a b\nc d", [["a", "b", "</s>"], ["c"]]), ("a b\nc d\n", [["a", "b", "</s>"], ["c", "d", "</s>"]]), ("a ", [["a"]])):
        (tmp_path / "n").write_text(text)
        assert [r.tokens for r in R.native_words(spark, str(tmp_path / "n")).orderBy("line_id").collect()] == want
    (tmp_path / "n").write_text("é" * 60 + " x\n")
    assert len(R.native_words(spark, str(tmp_path / "n")).selectExpr("cast(tokens[0] as binary) b").first()[0]) == 99


def test_map_matrices(spark, tmp_path):
    (tmp_path / "c1").mkdir()
    for name, text in (("train.x", "a 1 2\nb 3 4\n"), ("train.y", "b 0 1\na 1 0\n"), ("heldout.x", "c 5 6\n"), ("heldout.y", "c 7 8\n")):
        (tmp_path / "c1" / name).write_text(text)
    assert {(r.cluster, r.heldout, tuple(r.x), tuple(r.y)) for r in R.map_matrices(spark, str(tmp_path)).collect()} == {("c1", False, (1, 2), (1, 0)), ("c1", False, (3, 4), (0, 1)), ("c1", True, (5, 6), (7, 8))}


def test_matrices(spark, tmp_path):
    m = np.array([[0.0, 1.5], [2.0, 0.0]])
    np.save(tmp_path / "m.npy", m)
    assert {tuple(r) for r in R.matrix_npy(spark, str(tmp_path / "m.npy")).collect()} == {(0, 1, 1.5), (1, 0, 2.0)}
    (tmp_path / "p.bin").write_bytes(b"2\na " + struct.pack("<2f", *m[0]) + b"\nb " + struct.pack("<2f", *m[1]) + b"\n")
    (tmp_path / "o.bin").write_bytes(b"2\na " + struct.pack("<2q", 0, 7) + b"\nb " + struct.pack("<2q", 3, 0) + b"\n")
    p, o = R.matrix_binary(spark, str(tmp_path / "p.bin")), R.matrix_binary(spark, str(tmp_path / "o.bin"), "q")
    assert {tuple(r) for r in p.collect()} == {(0, "a", 1, 1.5), (1, "b", 0, 2.0)} and {r.value for r in o.collect()} == {7.0, 3.0}
    assert R.aligned(p, o.withColumnRenamed("value", "n")).count() == 2
    with pytest.raises(ValueError):
        R.aligned(p, o.where("word = 'a'"))


def test_pages_and_annotations(spark, tmp_path):
    (tmp_path / "in/1").mkdir(parents=True)
    (tmp_path / "in/1/index.php?topic=3").write_text("<p>é</p>")
    (tmp_path / "in/1/other").write_text("x")
    assert [r.html for r in R.pages(spark, str(tmp_path / "in"))  .collect()] == ["<p>é</p>"]
    (tmp_path / "crawl/a/b").mkdir(parents=True)
    (tmp_path / "crawl/a/b/response_body").write_text("<p>x</p>")
    (tmp_path / "crawl/a/b/meta").write_text(json.dumps({"url": "http://r/1"}))
    crawled = R.crawled_pages(spark, str(tmp_path / "crawl"))
    assert [(r.url, r.html) for r in crawled.collect()] == [("http://r/1", "<p>x</p>")]
    assert R.like_pages(crawled, prefix="http://r", unlike=["%page=%"]).count() == 1 and R.like_pages(crawled, prefix="ftp").count() == 0
    (tmp_path / "ann").mkdir()
    (tmp_path / "ann/1.txt").write_text("12 bob 3 9\nshort 1\n12 bob x 9\n")
    assert [tuple(r) for r in R.annotations(spark, str(tmp_path / "ann"), "f").collect()] == [("f", "12", "bob", 3, 9)]
    (tmp_path / "ann2").mkdir()
    (tmp_path / "ann2/1.txt").write_text("c t 3 _ 9\nc t 3 4\n")
    assert [tuple(r) for r in R.annotations(spark, str(tmp_path / "ann2"), "hackforums", long=True).collect()] == [("hackforums", "c", "t", 3, 9)]
    (tmp_path / "tok/buy").mkdir(parents=True)
    (tmp_path / "tok/buy/0-initiator77.txt.tok").write_text("some text")
    (tmp_path / "tok/buy/1-reply77.txt.tok").write_text("other")
    assert [tuple(r) for r in R.tokenized_texts(spark, str(tmp_path / "tok"), "f").collect()] == [("f", "77", "buy", "some text")]


def test_questions_and_counters(spark, tmp_path):
    (tmp_path / "q").write_text("a b c d\n: one\nw x y z\nw x y\n: two\np q r s\n")
    got = R.analogy_questions(spark, str(tmp_path / "q")).orderBy("qid").collect()
    assert [(r.section, r.a, r.d) for r in got] == [(None, "A", "D"), ("one", "W", "Z"), ("two", "P", "S")]
    (tmp_path / "c.json").write_text('{"a": 3,\n "b": 1}')
    assert {tuple(r) for r in R.counters_json(spark, str(tmp_path / "c.json")).collect()} == {("a", 3), ("b", 1)}


def test_writers(spark, tmp_path):
    t = spark.createDataFrame([("f", 1, ["x y", "z"], "x y z"), ("g", 2, ["x"], "x")], "forum string, row_id bigint, comments array<string>, line string")
    at = lambda n: str(tmp_path / n)
    W.indexed_threads(t, at("fts"))
    assert {tuple(r) for r in spark.read.parquet(at("fts") + "/index").select("token", "row_id").collect()} == {("x", 1), ("y", 1), ("z", 1), ("x", 2)}
    W.training_text(t, at("txt"))
    assert spark.read.text(at("txt") + "/all").count() == 2 and spark.read.text(at("txt") + "/by_forum/forum=g").first()[0] == "x"
    W.thread_json(t, at("json"))
    assert R.threads(spark, at("fts") + "/threads", "forum").count() == spark.read.json(at("json") + "/all").count() == 2
    W.upserted(t.union(t), at("up"), "row_id", F.col("line"))
    assert spark.read.parquet(at("up")).count() == 2
    W.upserted(t.where("row_id = 1").withColumn("line", F.lit("zz")), at("up"), "row_id", F.col("line"))
    W.upserted(t.where("row_id = 2").withColumn("line", F.lit("a")), at("up"), "row_id", F.col("line"))
    W.upserted(t.where("row_id = 2").withColumn("row_id", F.lit(3).cast("bigint")), at("up"), "row_id", F.col("line"))
    assert {(r.row_id, r.line) for r in spark.read.parquet(at("up")).collect()} == {(1, "zz"), (2, "x"), (3, "x")}
    W.phrase_text(spark.createDataFrame([(2, ["c"]), (1, ["a_b", "d"])], "line_id int, tokens array<string>"), at("phr"))
    assert [r[0] for r in spark.read.text(at("phr")).collect()] == ["a_b d", "c"]
    W.annotation_json(spark.createDataFrame([("t", "f", None, 1), ("t", "f", "x", 1)], "token string, forum string, type string, tagger int"), at("annj"))
    assert json.loads(spark.read.text(at("annj")).first()[0]) == {"t": [["f", "None", "1"], ["f", "x", "1"]]}
    W.comparison_stats_json(spark.createDataFrame([("w", 1.5)], "word string, jac40_gb double"), spark.createDataFrame([("jac40_gb", 1.0), ("pvalue", 2.0)], "measure string, mean double"), at("cmp"))
    assert json.loads(spark.read.text(at("cmp") + "/stats").first()[0]) == {"jac40_gb": {"mean": 1.0}, "pvalue": {"mean": 2.0}}
    W.sorted_json(t.select("row_id"), at("sorted"), "row_id")
    W.dated_index(t.select("row_id"), t, at("dated"))
    W.classes_text(spark.createDataFrame([("a", 1), ("b", 0)], "word string, class int"), at("classes"))
    assert [r[0] for r in spark.read.text(at("classes")).collect()] == ["b 0", "a 1"]
    W.matrix(spark.createDataFrame([(0, 1, 0.0), (1, 1, 2.0)], "row int, col int, value double"), at("m"))
    assert spark.read.parquet(at("m")).count() == 1
    c = spark.createDataFrame([(2, "b"), (1, "a")], "rank int, word string")
    W.evaluation_csv(c, c, at("csv"))
    assert spark.read.csv(at("csv") + "/candidates").first()[1] == "a"
    W.simulated(spark.createDataFrame([(1, "a b")], "line_id int, line string"), spark.createDataFrame([("a", 1, "b", 2)], "word string, n int, target string, target_n int"), at("sim"))
    W.linear_maps(c, at("maps"))
    W.plot_points(c.withColumn("measure", F.lit("sim")), at("plot"))
    assert spark.read.text(at("sim") + "/answers").first()[0] == "a\t1\tb\t2"

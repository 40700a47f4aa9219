"""Queries do the whole job: every row, every list and the defaults, on small tables."""

import oracle
import pytest
from pyspark.sql import functions as F

from lexdrift.operators import training as TR
from lexdrift.plans import evaluation as PE
from lexdrift.plans import models as PM
from lexdrift.plans import registry as R
from lexdrift.plans import vectors as PV
from lexdrift.plans import vocabulary as PW


def _write(df, d, name):
    df.write.parquet(f"{d}/{name}.parquet")


def test_embedding_trains_on_every_language_with_the_defaults(spark, tmp_path, monkeypatch):
    rows = [(i, c, lang, text) for i, (c, lang, text) in enumerate([(c, lang, text) for lang, text in (("en", "one two"), ("de", "drei vier"), (None, "cinq six")) for c in ("good", "bad")] * 3)]
    _write(spark.createDataFrame(rows + [(99, None, "en", "lost " * 9), (98, "good", "en", None)], "doc_id bigint, corpus string, lang string, text string"), tmp_path, "documents")
    used = []
    train = TR.train
    monkeypatch.setattr(TR, "train", lambda encoded, vocab, opt: used.append(opt) or train(encoded, vocab, opt))
    got = {r.word: r.sim for r in PM.embed_cotrained(spark, str(tmp_path)).collect()}
    assert set(got) == {"one", "two", "drei", "vier", "cinq", "six"} and used == [TR.Options()]
    assert all(-1 <= s <= 1 for s in got.values())


def _vectors(spark, d, n):
    x = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(F.col("idx") * i * F.when(F.col("model") == "good", 1.7).otherwise(2.9) + i))
    rows = spark.range(n).withColumnRenamed("id", "idx").crossJoin(spark.createDataFrame([("good",), ("bad",)], "model string"))
    _write(rows.select("model", "idx", F.concat(F.lit("w"), "idx").alias("word"), x.cast("array<float>").alias("vector")), d, "syn0")


def test_predictions_are_compared_over_a_thousand(spark, tmp_path):
    _vectors(spark, tmp_path, 1400)
    d = str(tmp_path)
    seen = []
    correlate = PV.E.rank_correlation
    PV.E.rank_correlation = lambda lists, a, b: seen.append(lists.select(F.min(F.size(a)), F.min(F.size(b))).first()) or correlate(lists, a, b)
    try:
        assert PV.prediction_correlation(spark, d).count() == 70
    finally:
        PV.E.rank_correlation = correlate
    assert tuple(seen[0]) == (1000, 1000)
    con = oracle.connect(d)
    for name in ("prediction_overlap_long", "prediction_spread_long"):
        assert oracle.assert_same(R.queries()[name](spark, d), con, R.oracle_sql()[name], name) == 70


def test_aligned_sentences_of_both_sides_are_of_shared_or_frequent_words(spark, tmp_path):
    texts = {
        "nulled": ["shared words here. only dark stays.", "often " * 200], "hackforums": ["shared words."], "darkode": ["often shared."], "reddit": ["shared words here. only white leaves."],
    }
    for name, comments in texts.items():
        _write(spark.createDataFrame([(1, comments)], "row_id bigint, comments array<string>"), tmp_path, name)
    got = {(r.side, r.forum): r.line.split() for r in PW.aligned_sentences(spark, str(tmp_path)).collect()}
    assert set(got) == {("dark", "nulled"), ("dark", "hackforums"), ("dark", "darkode"), ("white", "reddit")}
    assert not {"dark", "stays", "white", "leaves"} & {w for line in got.values() for w in line}
    assert "often" in got["dark", "darkode"] and "words" in got["white", "reddit"]


def test_candidates_have_all_neighbours_and_sample_lines(spark, tmp_path):
    _vectors(spark, tmp_path, 150)
    d = str(tmp_path)
    _write(spark.range(150).select(F.concat(F.lit("w"), "id").alias("word"), F.lit(40).alias("cn"), F.lit(20).alias("gcn"), F.lit(20).alias("bcn")), d, "goodbad_vocab")
    for name in ("nulled", "hackforums", "darkode", "reddit"):
        _write(spark.createDataFrame([(1, [f"W{i} in {name}\nelse w{i}x" for i in range(150)])], "row_id bigint, comments array<string>"), d, name)
    _write(spark.createDataFrame([(0, "s", "nowhere w1")], "doc_id bigint, source string, text string"), d, "documents")
    _write(spark.createDataFrame([(0, 1)], "doc_id bigint, level int"), d, "level_labels")
    got = PE.explained_candidates(spark, d).collect()
    assert got
    for r in got:
        w = r.word[1:]
        assert all(len(x.split()) == 100 for x in (r.good_interpretation, r.bad_interpretation, r.normal_interpretation))
        assert r.bad_sen == "...... ".join(f"[{n}] W{w} in {n}" for n in ("darkode", "hackforums", "nulled")) and r.good_sen == f"[reddit] W{w} in reddit"
    missed = {r.word: r for r in PE.explained_missed(spark, d).collect()}
    assert missed["nowhere"].good_interpretation == ""
    assert {"w1"} & ({r.word for r in got} | set(missed)) and all(len(r.normal_interpretation.split()) == 100 for w, r in missed.items() if w == "w1")


def test_huffman_codes_refuse_a_cut_vocabulary(spark, tmp_path, monkeypatch):
    _write(spark.range(6).select(F.concat(F.lit("w"), "id").alias("word"), F.lit(9).alias("cn"), F.lit(5).alias("gcn"), F.lit(4).alias("bcn")), tmp_path, "goodbad_vocab")
    monkeypatch.setattr(TR, "WORDS_AT_MOST", 6)
    assert PM.huffman_codes(spark, str(tmp_path)).count() == 6
    monkeypatch.setattr(TR, "WORDS_AT_MOST", 5)
    with pytest.raises(ValueError, match="more than 5 words"):
        PM.huffman_codes(spark, str(tmp_path))


def test_compare_pred_command(spark, tmp_path):
    from lexdrift.plans import commands as C
    from lexdrift.sources import writers as W

    _vectors(spark, tmp_path, 60)
    vecs = spark.read.parquet(f"{tmp_path}/syn0.parquet").withColumn("vector", F.col("vector").cast("array<double>"))
    got = C.run("compare_pred", vecs, vecs.where("model = 'good' and idx % 20 = 0"), ks=(5, 10))
    assert {r.word for r in got["details"].collect()} == {"w0", "w20", "w40"}
    assert {r.measure for r in got["stats"].collect()} == {"jac5_gb", "jac5_bb", "jac10_gb", "jac10_bb", "correlation", "pvalue", "prob_std1"}
    W.comparison_stats_json(got["details"], got["stats"], str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/details")).count() == 3

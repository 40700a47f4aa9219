"""Vector queries: comparison of models, neighbours, analogies, predictions. Queries are the words whose number is divisible by 20."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexdrift.functions import text as T
from lexdrift.functions import vector as V
from lexdrift.operators import evaluation as E
from lexdrift.operators import phrases as P
from lexdrift.operators import vectors as X
from lexdrift.plans.common import SQL_COUNTS, SQL_VECTORS, table, vectors, word_counts
from lexdrift.session import stage

LONG = 1000  # predictions of a word that are compared; the queries with SQL of 100 keep theirs
_JACS = [f"jac{k}_{a}" for k in (40, 100, LONG) for a in ("gb", "bb")]


def _queries(rows):
    return rows.where("idx % 20 = 0").select(F.col("idx").alias("qid"), "vec", F.array().cast("array<bigint>").alias("skip"))


def _raw(v, model):
    return v.where(F.col("model") == model).select("idx", F.col("vector").alias("vec"))


def cross_model_cosine(spark, d):
    return X.cross_model(vectors(spark, d)).select("word", "idx", F.round("sim", 6).alias("sim"))


def vector_compare(spark, d):
    return X.cross_model(vectors(spark, d)).select("word", "idx", F.round("cosine_distance", 6).alias("cosine_distance"), F.round("l1", 5).alias("l1"))


def vector_distances(spark, d):
    both = X.compare_models(vectors(spark, d))
    a, b = (F.transform(c, lambda x: F.abs(x)) for c in ("a", "b"))
    return both.select("idx", F.round(V.bhattacharyya(a, b), 6).alias("log10"), F.round(V.bhattacharyya_observed(F.transform(a, lambda x: x / V.total(a)), b), 6).alias("ln"))


def knn(spark, d):
    rows = X.unit_rows(vectors(spark, d), "good")
    q = _queries(rows).withColumn("skip", F.array("qid"))
    return X.top_products(q, rows, 40)


def phrase_query_knn(spark, d):
    rows = X.unit_rows(vectors(spark, d), "good")
    terms = rows.where("idx % 20 < 2").select((F.col("idx") - F.col("idx") % 20).alias("qid"), "idx")
    both = terms.groupBy("qid").count().where("count = 2").select("qid")
    return X.top_products(X.phrase_queries(terms.join(both, "qid"), rows), rows, 40)


def cosine_matrix(spark, d):
    rows = X.unit_rows(vectors(spark, d), "bad")
    return X.product_rows(_queries(rows), rows)


def cross_model_neighbours(spark, d):
    v = vectors(spark, d)
    return X.top_products(_queries(X.unit_rows(v, "bad")), X.unit_rows(v, "good"), 100)


def _questions(v):
    return v.where("model = 'good' and idx % 20 = 0").select(F.col("idx").alias("qid"), F.col("idx").alias("a"), (F.col("idx") + 1).alias("b"), (F.col("idx") + 2).alias("c"), (F.col("idx") + 3).alias("expected"), F.concat(F.lit("s"), ((F.col("idx") / 20).cast("bigint") % 8)).alias("section"))


def analogy(spark, d):
    v = vectors(spark, d)
    return X.analogies(_questions(v).select("qid", "a", "b", "c"), X.unit_rows(v, "good"), 5)


def analogy_accuracy(spark, d):
    v = vectors(spark, d)
    q = _questions(v)
    return X.accuracy(X.analogies(q.select("qid", "a", "b", "c"), X.unit_rows(v, "good"), 1), q)


def softmax_prediction(spark, d):
    v = vectors(spark, d)
    return X.predictions(_queries(_raw(v, "bad")), _raw(v, "good"), 40, clamp=False)


def softmax_prediction_clamped(spark, d):
    v = vectors(spark, d)
    return X.predictions(_queries(_raw(v, "bad")), _raw(v, "good"), 40, clamp=True)


def _observed(spark, d, v):
    lines = table(spark, d, "dark_texts").select("line_id", T.blank_tokens(F.coalesce("texts", F.lit(""))).alias("tokens"))
    words = v.where("model = 'good'").select("idx", "word")
    pairs = P.cooccurrences(lines, words, 5)
    return pairs.join(words.where("idx % 20 = 0").select(F.col("idx").alias("qid"), F.col("word").alias("center")), "center").join(words.withColumnRenamed("word", "context"), "context").select("qid", "idx", "n")


def distribution_compare(spark, d):
    v = vectors(spark, d)
    r = X.distribution_report(_observed(spark, d, v), _raw(v, "bad").where("idx % 20 = 0").withColumnRenamed("idx", "qid"), _raw(v, "good"))
    return r.select("qid", "occurrences", "contexts", F.round("bhattacharyya", 6).alias("bhattacharyya"), F.round("cosine", 6).alias("cosine"))


def _top_lists(v, k):
    out = None
    for name, a, b in (("gb", "bad", "good"), ("gg", "good", "good"), ("bb", "bad", "bad")):
        top = X.top_products(_queries(_raw(v, a)), _raw(v, b), k)
        listed = top.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "idx"))), lambda x: x["idx"]).alias(name))
        out = listed if out is None else out.join(listed, "qid")
    return out


def _overlap(lists, *ks):
    jac = lambda a, b, k: F.round(V.jaccard(F.slice(a, 1, k), F.slice(b, 1, k)), 9)
    return lists.select("qid", *(jac(a, "gg", k).alias(f"jac{k}_{a}") for k in ks for a in ("gb", "bb")))


def prediction_overlap(spark, d):
    return _overlap(_top_lists(vectors(spark, d), 100), 40, 100)


def prediction_overlap_long(spark, d):
    return _overlap(_top_lists(vectors(spark, d), LONG), 40, 100, LONG)


def prediction_stats_long(spark, d):
    s = E.describe(prediction_overlap_long(spark, d), *_JACS)
    return s.select("measure", *(F.round(c, 6).alias(c) for c in ("mean", "max", "min", "median", "std")))


def prediction_stats(spark, d):
    s = E.describe(prediction_overlap(spark, d), "jac40_gb", "jac100_gb", "jac40_bb", "jac100_bb")
    return s.select("measure", *(F.round(c, 6).alias(c) for c in ("mean", "max", "min", "median", "std")))


def prediction_correlation(spark, d):
    lists = _top_lists(vectors(spark, d), LONG)
    return E.rank_correlation(lists, "gb", "gg").select("qid", F.round("correlation", 6).alias("correlation"), F.round("pvalue", 6).alias("pvalue"))


def prediction_rho(spark, d):
    """The rank correlations alone, without their p-values, which SQL has no function for."""
    return prediction_correlation(spark, d).select("qid", "correlation")


def _spread(v, k):
    p = X.predictions(_queries(_raw(v, "bad")), _raw(v, "good"), k, clamp=False)
    return p.groupBy("qid").agg(F.round(F.stddev_pop("p"), 8).alias("prob_std"))


def prediction_spread(spark, d):
    return _spread(vectors(spark, d), 100)


def prediction_spread_long(spark, d):
    return _spread(vectors(spark, d), LONG)


def observed_contexts(spark, d):
    """The 40 contexts that stand most often beside each word; ``softmax_prediction_clamped`` has the 40 most probable."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("n"), "idx")).cast("bigint")
    return _observed(spark, d, vectors(spark, d)).withColumn("rank", rank).where("rank <= 40")


def comparison_report(spark, d):
    """The whole report of predicted against observed contexts, ready for ``writers.comparison_json``: counts, distances and the 40 best of both sides."""
    v = stage(vectors(spark, d), "vectors")
    counts, words = word_counts(spark, d), v.where("model = 'good'").select("idx", "word")
    seen = stage(_observed(spark, d, v), "observed")
    r = X.distribution_report(seen, _raw(v, "bad").where("idx % 20 = 0").withColumnRenamed("idx", "qid"), _raw(v, "good"))
    predicted = X.predictions(_queries(_raw(v, "bad")), _raw(v, "good"), 40).where("p > 0").select("qid", "idx", "rank", F.col("p").alias("value"))
    observed = seen.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("n"), "idx"))).where("rank <= 40").select("qid", "idx", "rank", F.col("n").cast("double").alias("value"))
    lists = None
    for name, best in (("most_probable", predicted), ("most_occurred", observed)):
        named = best.join(words, "idx").join(counts.select("word", "cn"), "word", "left")
        pairs = F.transform(F.array_sort(F.collect_list(F.struct("rank", "word", "value", "cn"))), _entry)
        listed = named.groupBy("qid").agg(F.map_from_entries(pairs).alias(name))
        lists = listed if lists is None else lists.join(listed, "qid", "full")
    named = r.join(words.withColumnRenamed("idx", "qid"), "qid").join(counts.select("word", "gcn", "bcn"), "word", "left").join(lists, "qid", "left")
    return named.select("word", F.col("gcn").alias("good_occurrence"), F.col("bcn").alias("bad_occurrence"), F.round("bhattacharyya", 6).alias("bhattacharyya"), F.round(1 - F.col("cosine"), 6).alias("cosine"), "most_probable", "most_occurred")


def _entry(x):
    return F.struct(x["word"], F.array(x["value"], x["cn"].cast("double")))


def comparison_lists(spark, d):
    """The two lists of ``comparison_report`` as rows: side, word, context, value and count of the context."""
    r = comparison_report(spark, d)
    sides = [r.select(F.lit(side).alias("side"), "word", F.explode(side).alias("context", "x")) for side in ("most_probable", "most_occurred")]
    return sides[0].union(sides[1]).select("side", "word", "context", F.round(F.get("x", F.lit(0)), 9).alias("value"), F.get("x", F.lit(1)).cast("bigint").alias("cn"))


def plot_panels(spark, d):
    """Points of the three panels of the plot, finite ones only: distances against occurrences and against one another."""
    return E.panels(comparison_report(spark, d).select("word", "good_occurrence", "bhattacharyya", "cosine"))


QUERIES = [
    prediction_rho, comparison_lists, plot_panels, cross_model_cosine, vector_compare, vector_distances, knn, phrase_query_knn, cosine_matrix, cross_model_neighbours, analogy, analogy_accuracy, softmax_prediction, softmax_prediction_clamped,
    distribution_compare, prediction_overlap, prediction_stats, prediction_correlation, prediction_spread,
    prediction_overlap_long, prediction_stats_long, prediction_spread_long, observed_contexts,
]

_BOTH = f"WITH {SQL_VECTORS}, both_ AS (SELECT g.word, g.idx, g.vector AS a, b.vector AS b FROM vectors g JOIN vectors b ON g.idx = b.idx WHERE g.model = 'good' AND b.model = 'bad')"
_COS = "round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6)"
_UNIT = f"{SQL_VECTORS}, unit AS (SELECT model, idx, list_transform(vector, lambda x: x / sqrt(list_dot_product(vector, vector))) AS vec FROM vectors)"
_TOP = "SELECT qid, idx, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) AS rank FROM s QUALIFY rank <= {k}"


def _norm(v: str) -> str:
    return f"list_transform({v}, lambda x: x / sqrt(list_dot_product({v}, {v})))"


def _minus_plus(b: str, a: str, c: str) -> str:
    return f"list_transform(list_zip({b}, {a}, {c}), lambda x: x[1] - x[2] + x[3])"


_QUESTIONS = f"""questions AS (SELECT idx AS qid, idx AS a, idx + 1 AS b, idx + 2 AS c, idx + 3 AS expected, 's' || ((idx // 20) % 8) AS section FROM vectors WHERE model = 'good' AND idx % 20 = 0),
targets AS (SELECT q.*, {_minus_plus('y.vec', 'x.vec', 'z.vec')} AS t FROM questions q JOIN unit x ON x.idx = q.a AND x.model = 'good' JOIN unit y ON y.idx = q.b AND y.model = 'good' JOIN unit z ON z.idx = q.c AND z.model = 'good'),
s AS (SELECT qid, u.idx, round(list_dot_product({_norm('t')}, u.vec), 6) AS score FROM targets q JOIN unit u ON u.model = 'good' AND u.idx NOT IN (q.a, q.b, q.c)),
answers AS (SELECT qid, idx, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) AS rank FROM s WHERE score > 0 QUALIFY rank <= 5)"""


def _softmax(clamp: bool) -> str:
    w = "CASE WHEN s > 6 THEN 1.0::DOUBLE WHEN s < -6 THEN 0.0::DOUBLE ELSE exp(s) END" if clamp else "exp(s)"
    return f"""WITH {SQL_VECTORS}, dots AS (SELECT q.idx AS qid, c.idx, list_dot_product(q.vector, c.vector) AS s FROM vectors q JOIN vectors c ON c.model = 'good' WHERE q.model = 'bad' AND q.idx % 20 = 0),
w AS (SELECT qid, idx, {w} AS w FROM dots), p AS (SELECT qid, idx, round(w / sum(w) OVER (PARTITION BY qid), 9) AS p FROM w)"""


def _lists(k: int) -> str:
    parts = ", ".join(
        f"""{n} AS (SELECT qid, list(idx ORDER BY s DESC, idx) AS l FROM (SELECT q.idx AS qid, c.idx, round(list_dot_product(q.vector, c.vector), 6) AS s FROM vectors q JOIN vectors c ON c.model = '{b}'
  WHERE q.model = '{a}' AND q.idx % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.idx ORDER BY s DESC, c.idx) <= {k}) GROUP BY qid)"""
        for n, a, b in (("gb", "bad", "good"), ("gg", "good", "good"), ("bb", "bad", "bad"))
    )
    return f"WITH {SQL_VECTORS}, {parts}"


def _jac(a: str, k: int) -> str:
    x, y = f"{a}.l[1:{k}]", f"gg.l[1:{k}]"
    return f"round(len(list_intersect({x}, {y})) / CAST(len({x}) + len({y}) - len(list_intersect({x}, {y})) AS DOUBLE), 9) AS jac{k}_{a}"


_OVERLAP = f"{_lists(100)}, o AS (SELECT gb.qid, {', '.join(_jac(a, k) for k in (40, 100) for a in ('gb', 'bb'))} FROM gb JOIN gg ON gb.qid = gg.qid JOIN bb ON gb.qid = bb.qid)"
_OVERLAP_LONG = f"{_lists(LONG)}, o AS (SELECT gb.qid, {', '.join(_jac(a, k) for k in (40, 100, LONG) for a in ('gb', 'bb'))} FROM gb JOIN gg ON gb.qid = gg.qid JOIN bb ON gb.qid = bb.qid)"
_ROOTS = "list_sum(list_transform(list_zip(a, b), lambda x: sqrt(abs(x[1]) * abs(x[2]))))"
_SUM = "list_sum(list_transform({0}, lambda x: abs(x)))"
_REPORT = rf"""WITH {SQL_VECTORS}, words AS (SELECT idx, word FROM vectors WHERE model = 'good'),
w AS (SELECT line_id, generate_subscripts(t, 1) AS pos, unnest(t) AS word FROM (SELECT line_id, regexp_extract_all(texts, '\S+') AS t FROM dark_texts)),
k AS (SELECT line_id, idx, row_number() OVER (PARTITION BY line_id ORDER BY pos) AS i FROM w JOIN words USING (word)),
o AS (SELECT x.idx AS qid, y.idx, count(*) AS n FROM k x JOIN k y ON x.line_id = y.line_id AND x.i <> y.i AND abs(x.i - y.i) <= 5 AND (x.i - 1) // 1000 = (y.i - 1) // 1000 WHERE x.idx % 20 = 0 GROUP BY ALL),
dots AS (SELECT q.idx AS qid, c.idx, list_dot_product(q.vector, c.vector) AS s FROM vectors q JOIN vectors c ON c.model = 'good' WHERE q.model = 'bad' AND q.idx % 20 = 0),
ws AS (SELECT qid, idx, CASE WHEN s > 6 THEN 1.0::DOUBLE WHEN s < -6 THEN 0.0::DOUBLE ELSE exp(s) END AS w FROM dots),
p AS (SELECT qid, idx, w / sum(w) OVER (PARTITION BY qid) AS p FROM ws), z AS (SELECT qid, sum(p * p) AS pp FROM p GROUP BY qid),
report AS (SELECT o.qid, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS contexts, round(-ln(sum(sqrt(p * n)) / sqrt(sum(n))), 6) AS bhattacharyya, round(sum(p * n) / (sqrt(any_value(pp)) * sqrt(sum(n * n))), 6) AS cosine
FROM o JOIN p ON o.qid = p.qid AND o.idx = p.idx JOIN z ON o.qid = z.qid GROUP BY o.qid)"""
_NAMED = f"""{_REPORT}, {SQL_COUNTS},
sides AS (SELECT 'most_probable' AS side, qid, idx, round(p, 9) AS value FROM p WHERE round(p, 9) > 0 AND qid IN (SELECT qid FROM report) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(p, 9) DESC, idx) <= 40
  UNION ALL SELECT 'most_occurred', qid, idx, CAST(n AS DOUBLE) FROM o QUALIFY row_number() OVER (PARTITION BY qid ORDER BY n DESC, idx) <= 40),
named AS (SELECT word, gcn AS good_occurrence, bhattacharyya AS bhattacharyya, round(1 - cosine_, 6) AS cosine FROM (SELECT r.*, w.word, r.cosine AS cosine_ FROM report r JOIN words w ON w.idx = r.qid) LEFT JOIN word_counts USING (word))"""
ORACLES = {
    "cross_model_cosine": f"{_BOTH} SELECT word, idx, {_COS} AS sim FROM both_",
    "vector_compare": f"{_BOTH} SELECT word, idx, round(1 - list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) AS cosine_distance, round(list_sum(list_transform(list_zip(a, b), lambda x: abs(x[1] - x[2]))), 5) AS l1 FROM both_",
    "vector_distances": f"""{_BOTH} SELECT idx, round(-log10({_ROOTS} / sqrt({_SUM.format('a')} * {_SUM.format('b')})), 6) AS log10, round(-ln({_ROOTS} / sqrt({_SUM.format('a')}) / sqrt({_SUM.format('b')})), 6) AS ln FROM both_""",
    "knn": f"WITH {_UNIT}, s AS (SELECT q.idx AS qid, c.idx, round(list_dot_product(q.vec, c.vec), 6) AS score FROM unit q JOIN unit c ON c.model = 'good' AND c.idx <> q.idx WHERE q.model = 'good' AND q.idx % 20 = 0) {_TOP.format(k=40)}",
    "phrase_query_knn": f"""WITH {_UNIT}, t AS (SELECT a.idx AS qid, b.idx AS other, list_transform(list_zip(a.vec, b.vec), lambda x: x[1] + x[2]) AS v FROM unit a JOIN unit b ON b.idx = a.idx + 1 AND b.model = 'good' WHERE a.model = 'good' AND a.idx % 20 = 0),
s AS (SELECT qid, c.idx, round(list_dot_product({_norm('v')}, c.vec), 6) AS score FROM t JOIN unit c ON c.model = 'good' AND c.idx <> qid AND c.idx <> other) {_TOP.format(k=40)}""",
    "cosine_matrix": f"WITH {_UNIT} SELECT q.idx AS qid, c.idx, round(list_dot_product(q.vec, c.vec), 6) AS score FROM unit q JOIN unit c ON c.model = 'bad' WHERE q.model = 'bad' AND q.idx % 20 = 0",
    "cross_model_neighbours": f"WITH {_UNIT}, s AS (SELECT q.idx AS qid, c.idx, round(list_dot_product(q.vec, c.vec), 6) AS score FROM unit q JOIN unit c ON c.model = 'good' WHERE q.model = 'bad' AND q.idx % 20 = 0) {_TOP.format(k=100)}",
    "analogy": f"WITH {_UNIT}, {_QUESTIONS} SELECT * FROM answers",
    "analogy_accuracy": f"""WITH {_UNIT}, {_QUESTIONS}, j AS (SELECT q.section, q.expected, a.idx AS answer FROM questions q LEFT JOIN answers a ON a.qid = q.qid AND a.rank = 1)
SELECT section, CAST(count(*) FILTER (WHERE answer = expected) AS BIGINT) AS correct, count(answer) AS seen, count(*) AS total FROM j GROUP BY ROLLUP (section)""",
    "softmax_prediction": f"{_softmax(False)} SELECT qid, idx, p, row_number() OVER (PARTITION BY qid ORDER BY p DESC, idx) AS rank FROM p QUALIFY rank <= 40",
    "softmax_prediction_clamped": f"{_softmax(True)} SELECT qid, idx, p, row_number() OVER (PARTITION BY qid ORDER BY p DESC, idx) AS rank FROM p QUALIFY rank <= 40",
    "prediction_spread": f"{_softmax(False)} SELECT qid, round(stddev_pop(p), 8) AS prob_std FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY qid ORDER BY p DESC, idx) <= 100) GROUP BY qid",
    "prediction_overlap": f"{_OVERLAP} SELECT * FROM o",
    "prediction_stats": f"""{_OVERLAP}, u AS (UNPIVOT o ON jac40_gb, jac100_gb, jac40_bb, jac100_bb INTO NAME measure VALUE x)
SELECT measure, round(avg(x), 6) AS mean, round(max(x), 6) AS max, round(min(x), 6) AS min, round(median(x), 6) AS median, round(stddev_pop(x), 6) AS std FROM u GROUP BY measure""",
    "prediction_overlap_long": f"{_OVERLAP_LONG} SELECT * FROM o",
    "prediction_stats_long": f"""{_OVERLAP_LONG}, u AS (UNPIVOT o ON {', '.join(_JACS)} INTO NAME measure VALUE x)
SELECT measure, round(avg(x), 6) AS mean, round(max(x), 6) AS max, round(min(x), 6) AS min, round(median(x), 6) AS median, round(stddev_pop(x), 6) AS std FROM u GROUP BY measure""",
    "prediction_spread_long": f"{_softmax(False)} SELECT qid, round(stddev_pop(p), 8) AS prob_std FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY qid ORDER BY p DESC, idx) <= {LONG}) GROUP BY qid",
    "distribution_compare": f"{_REPORT} SELECT * FROM report",
    "prediction_rho": f"""{_lists(LONG)}, z AS (SELECT gb.qid, unnest(gb.l[1:least(len(gb.l), len(gg.l))]) AS x, unnest(gg.l[1:least(len(gb.l), len(gg.l))]) AS y FROM gb JOIN gg ON gb.qid = gg.qid),
r AS (SELECT qid, rank() OVER (PARTITION BY qid ORDER BY x) AS rx, rank() OVER (PARTITION BY qid ORDER BY y) AS ry FROM z) SELECT qid, round(corr(rx, ry), 6) AS correlation FROM r GROUP BY qid""",
    "observed_contexts": f"{_REPORT} SELECT qid, idx, n, row_number() OVER (PARTITION BY qid ORDER BY n DESC, idx) AS rank FROM o QUALIFY rank <= 40",
    "comparison_lists": f"{_NAMED} SELECT side, w.word, c.word AS context, value, cn FROM sides JOIN words w ON w.idx = sides.qid JOIN words c ON c.idx = sides.idx LEFT JOIN word_counts n ON n.word = c.word",
    "plot_panels": f"""{_NAMED} SELECT 'bhattacharyya' AS measure, word, bhattacharyya AS x, CAST(good_occurrence AS DOUBLE) AS y FROM named WHERE isfinite(bhattacharyya) AND isfinite(cosine)
UNION ALL SELECT 'cosine', word, cosine, CAST(good_occurrence AS DOUBLE) FROM named WHERE isfinite(cosine) UNION ALL SELECT 'both', word, cosine, bhattacharyya FROM named WHERE isfinite(bhattacharyya) AND isfinite(cosine)""",
}

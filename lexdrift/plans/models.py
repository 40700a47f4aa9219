"""Iterative queries: word classes, linear map, simulated shift, Huffman codes, training."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexdrift.functions import text as T
from lexdrift.operators import models as M
from lexdrift.operators import training as TR
from lexdrift.operators import vectors as X
from lexdrift.operators import vocabulary as V
from lexdrift.plans.common import table, vectors, word_counts
from lexdrift.session import stage


def kmeans_classes(spark, d):
    v = vectors(spark, d).where("model = 'good'").select("idx", F.col("vector").alias("vec"))
    return M.spherical_kmeans(v, 20, 10)


def kmeans_first_round(spark, d):
    v = vectors(spark, d).where("model = 'good'").select("idx", F.col("vector").alias("vec"))
    return M.spherical_kmeans(v, 5, 1).groupBy("class").agg(F.count("*").alias("members"), F.min("idx").alias("first"), F.sum("idx").alias("total"))


def linear_map(spark, d):
    both = X.compare_models(vectors(spark, d))
    pairs = both.select((F.col("idx") % 3).alias("cluster"), (F.col("idx") % 5 == 0).alias("heldout"), F.col("a").alias("x"), F.col("b").alias("y"))
    return M.linear_maps(pairs).select("cluster", "n", "heldout_n", F.round("heldout_loss", 4).alias("heldout_loss"))


def _tokens(spark, d):
    return table(spark, d, "dark_texts").select("line_id", T.blank_tokens(F.coalesce("texts", F.lit(""))).alias("tokens"))


def shift_plan(spark, d):
    counts = _tokens(spark, d).select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return M.shift_plan(counts, 10, 250, 1)


def simulate_shift(spark, d):
    return M.simulate_shift(_tokens(spark, d), shift_plan(spark, d), 0.5, 1)


def huffman_codes(spark, d):
    counts = word_counts(spark, d).where("cn >= 5").orderBy(F.desc("cn"), "word").limit(TR.WORDS_AT_MOST + 1).select("word", "cn").collect()
    if len(counts) > TR.WORDS_AT_MOST:
        raise ValueError(f"more than {TR.WORDS_AT_MOST} words of a count of 5 at least")
    return spark.createDataFrame([(w, c) for w, c, _ in V.huffman([(r["word"], r["cn"]) for r in counts])], "word string, code string")


def embed_cotrained(spark, d):
    lines = table(spark, d, "documents").where("corpus is not null").select(
        F.when(F.col("corpus") == "good", 0).otherwise(1).alias("corpus"), F.col("doc_id").alias("line_id"), T.alphabetic_tokens(F.lower("text")).alias("tokens")
    )
    counts = V.two_corpus_counts(lines.select(F.when(F.col("corpus") == 0, "good").otherwise("bad").alias("corpus"), F.explode("tokens").alias("word")), lines.limit(0).select(F.lit("good").alias("corpus")))
    vocab = stage(V.indexed(counts, 5), "vocab")
    encoded = stage(TR.encode(lines, vocab), "encoded")
    w_in, _, _ = TR.train(encoded, vocab, TR.Options())
    return X.cross_model(TR.as_vectors(vocab, {"good": w_in[0], "bad": w_in[1]})).select("word", F.round("sim", 6).alias("sim"))


QUERIES = [kmeans_classes, kmeans_first_round, linear_map, shift_plan, simulate_shift, huffman_codes, embed_cotrained]

_PLAN = r"""w AS (SELECT line_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS word FROM (SELECT line_id, regexp_extract_all(texts, '\S+') AS t FROM dark_texts)),
c AS (SELECT word, count(*) AS n FROM w GROUP BY word), chosen AS (SELECT word, n FROM c WHERE n > 250 ORDER BY md5(word || ':1'), word LIMIT 10),
plan AS (SELECT x.word, x.n, c.word AS target, c.n AS target_n FROM chosen x JOIN c ON c.n >= x.n / 10.0 AND c.n <= x.n * 10.0 AND c.word NOT IN (SELECT word FROM chosen)
  QUALIFY row_number() OVER (PARTITION BY x.word ORDER BY md5(x.word || ':' || c.word || ':1'), c.word) = 1)"""
_KMEANS_START = """v AS (SELECT DISTINCT ON (idx) idx, CAST(vector AS DOUBLE[]) AS vec FROM syn0
  WHERE model = 'good' AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
a0 AS (SELECT idx, idx % 5 AS class FROM v)"""


def _kmeans_round(i: int, classes: int) -> str:
    """Centres of the classes so far, and the class of the nearest of them."""
    return f"""s{i} AS MATERIALIZED (SELECT class, i, sum(x) AS x FROM (SELECT class, generate_subscripts(vec, 1) AS i, unnest(vec) AS x FROM v JOIN a{i} USING (idx)) GROUP BY ALL),
l{i} AS MATERIALIZED (SELECT class, list(x ORDER BY i) AS s FROM s{i} GROUP BY class), c{i} AS MATERIALIZED (SELECT class, list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) AS c FROM l{i}),
a{i + 1} AS MATERIALIZED (SELECT idx, class FROM v, c{i} QUALIFY row_number() OVER (PARTITION BY idx ORDER BY list_dot_product(vec, c) DESC, class) = 1)"""


ORACLES = {
    "shift_plan": f"WITH {_PLAN} SELECT * FROM plan",
    "simulate_shift": f"""WITH {_PLAN} SELECT line_id, string_agg(CASE WHEN target IS NOT NULL AND CAST('0x' || substr(md5(line_id || ':' || pos || ':1'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.5 THEN target ELSE w.word END, ' ' ORDER BY pos) AS line
FROM w LEFT JOIN plan ON w.word = plan.word GROUP BY line_id""",
    "kmeans_first_round": f"WITH {_KMEANS_START}, {_kmeans_round(0, 5)} SELECT CAST(class AS BIGINT) AS class, count(*) AS members, min(idx) AS first, CAST(sum(idx) AS BIGINT) AS total FROM a1 GROUP BY class",
    "kmeans_classes": f"WITH {_KMEANS_START.replace('% 5', '% 20')}, {', '.join(_kmeans_round(i, 20) for i in range(10))} SELECT idx, CAST(class AS BIGINT) AS class FROM a10",
}

"""Vocabulary queries: counts per corpus, coverage, alignment, phrases, co-occurrence."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexdrift.functions import text as T
from lexdrift.operators import phrases as P
from lexdrift.operators import vocabulary as V
from lexdrift.plans import commands
from lexdrift.plans.common import DARK, FORUMS, SQL_COUNTS, WHITE, table, threads, word_counts
from lexdrift.plans.text import sentences_sql


def _corpus(spark, d):
    return table(spark, d, "documents").where("corpus is not null and text is not null").select("corpus", "doc_id", T.alphabetic_tokens(F.lower("text")).alias("tokens"))


def _counts(spark, d):
    rows = _corpus(spark, d)
    return V.two_corpus_counts(rows.select("corpus", F.explode("tokens").alias("word")), rows.select("corpus"))


def two_corpus_vocab(spark, d):
    return V.indexed(_counts(spark, d), 5)


def common_vocab(spark, d):
    return V.common(_counts(spark, d)).select("word", "cn", "gcn", "bcn")


def vocab_totals(spark, d):
    kept = _counts(spark, d).where("cn >= 5 and word <> '</s>'")
    return kept.agg(F.count("*").alias("words"), *(F.sum(c).alias(f"{c}_total") for c in ("cn", "gcn", "bcn")))


def merged_vocab(spark, d):
    return word_counts(spark, d)


def shared_or_frequent(spark, d):
    dark = table(spark, d, "dark_texts").select(F.explode(T.blank_tokens(F.col("texts"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    white = table(spark, d, "reddit").select(F.explode(T.blank_tokens(F.col("texts"))).alias("word")).distinct()
    return V.shared_or_frequent(dark, white)


def aligned_sentences(spark, d):
    sides = commands.prepare(*(threads(spark, d, names, "row_id", "comments") for names in (DARK, WHITE)))
    dark, white = (sides[n].select(F.lit(n).alias("side"), "forum", "row_id", "line") for n in ("dark", "white"))
    return dark.union(white)


def without_rare_words(spark, d):
    lines = table(spark, d, "dark_texts").select("line_id", T.blank_tokens(F.col("texts")).alias("tokens"))
    return V.without_rare_words(lines, 10).select("line_id", F.array_join("tokens", " ").alias("line"))


def _forum_vocab(spark, d):
    rows = threads(spark, d, FORUMS, "texts").select("forum", F.explode(T.blank_tokens(F.col("texts"))).alias("word"))
    each = rows.groupBy("forum", "word").agg(F.count("*").alias("n"))
    side = F.when(F.col("forum") == "reddit", "white").otherwise("dark")
    combined = each.groupBy(side.alias("label"), "word").agg(F.sum("n").alias("n"))
    return each.select(F.col("forum").alias("label"), "word", "n"), combined


def coverage_summary(spark, d):
    each, combined = _forum_vocab(spark, d)
    return V.coverage_summary(each.union(combined), 10)


def coverage_histogram(spark, d):
    return V.coverage_histogram(_forum_vocab(spark, d)[1], 10, 5)


def _frequent(spark, d):
    v = _forum_vocab(spark, d)[1].where("n > 10")
    return v.where("label = 'dark'").select("word", "n"), v.where("label = 'white'").select("word")


def missed_words(spark, d):
    dark, white = _frequent(spark, d)
    return dark.join(white, "word", "left_anti")


def common_words(spark, d):
    dark, white = _frequent(spark, d)
    return dark.join(white, "word", "left_semi")


def coverage_ratio(spark, d):
    dark, white = _frequent(spark, d)
    both = dark.join(white.withColumn("both", F.lit(1)), "word", "left")
    return both.agg(F.round(F.count("both") / F.count("*"), 9).alias("unique_coverage"), F.round(F.sum(F.when(F.col("both") == 1, F.col("n")).otherwise(0)) / F.sum("n"), 9).alias("word_coverage"))


def subsample_probability(spark, d):
    v = word_counts(spark, d).where("cn > 0")
    return v.crossJoin(F.broadcast(v.agg(F.sum("cn").alias("total")))).select("word", F.round(V.keep_probability(F.col("cn"), F.col("total")), 9).alias("p"))  # one row


def negative_distribution(spark, d):
    return V.negative_distribution(word_counts(spark, d).where("cn > 0")).select("word", F.round("p", 10).alias("p"))


def _lines(spark, d):
    return table(spark, d, "dark_texts").select("line_id", T.blank_tokens(F.coalesce("texts", F.lit(""))).alias("tokens"))


def bigram_counts(spark, d):
    return P.bigrams(_lines(spark, d))


def phrase_scores(spark, d):
    return P.scores(_lines(spark, d), 5).select("a", "b", "n", F.round("score", 6).alias("score"))


def phrase_merge(spark, d):
    lines = _lines(spark, d)
    return P.merge(lines, P.scores(lines, 5), 100.0)


def cooccurrence(spark, d):
    lines = _lines(spark, d)
    vocab = P.unigrams(lines).where("n >= 5")
    return P.cooccurrences(lines, vocab, 5)


QUERIES = [
    two_corpus_vocab, common_vocab, vocab_totals, merged_vocab, shared_or_frequent, aligned_sentences, without_rare_words, coverage_summary, coverage_histogram, missed_words,
    common_words, coverage_ratio, subsample_probability, negative_distribution, bigram_counts, phrase_scores, phrase_merge, cooccurrence,
]

_TOKENS = r"tokens AS (SELECT corpus, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}_]+')) AS word FROM documents WHERE corpus IS NOT NULL AND text IS NOT NULL)"
_TWO = f"""{_TOKENS}, counts AS (SELECT word, count(*) AS cn, CAST(count(*) FILTER (WHERE corpus = 'good') AS BIGINT) AS gcn, CAST(count(*) FILTER (WHERE corpus = 'bad') AS BIGINT) AS bcn
  FROM (SELECT corpus, word FROM tokens UNION ALL SELECT corpus, '</s>' FROM documents WHERE corpus IS NOT NULL AND text IS NOT NULL) GROUP BY word)"""
_SPLIT = r"unnest(regexp_extract_all(texts, '\S+'))"
_LABELS = " UNION ALL ".join(f"SELECT '{f}' AS forum, texts FROM {f}" for f in FORUMS)
_VOCAB = f"""each_ AS (SELECT forum AS label, word, count(*) AS n FROM (SELECT forum, {_SPLIT} AS word FROM ({_LABELS})) GROUP BY ALL),
combined AS (SELECT CASE WHEN label = 'reddit' THEN 'white' ELSE 'dark' END AS label, word, CAST(sum(n) AS BIGINT) AS n FROM each_ GROUP BY ALL)"""
_FREQ = f"""WITH {_VOCAB}, dark AS (SELECT word, n FROM combined WHERE label = 'dark' AND n > 10), white AS (SELECT word FROM combined WHERE label = 'white' AND n > 10)"""
_POS = rf"""w AS (SELECT line_id, generate_subscripts(t, 1) AS pos, unnest(t) AS word FROM (SELECT line_id, regexp_extract_all(texts, '\S+') AS t FROM dark_texts)),
ordered AS (SELECT *, lag(word) OVER (ORDER BY line_id, pos) AS prev FROM w), big AS (SELECT prev AS a, word AS b, count(*) AS n FROM ordered WHERE prev IS NOT NULL GROUP BY ALL),
uni AS (SELECT word, count(*) AS n FROM w GROUP BY word),
scored AS (SELECT a, b, big.n, (big.n - 5) / CAST(x.n AS DOUBLE) / CAST(y.n AS DOUBLE) * (SELECT count(*) FROM w) AS score FROM big JOIN uni x ON a = x.word JOIN uni y ON b = y.word WHERE x.n >= 5 AND y.n >= 5)"""
ORACLES = {
    "two_corpus_vocab": f"WITH {_TWO} SELECT row_number() OVER (ORDER BY word <> '</s>', cn DESC, word) - 1 AS idx, word, cn, gcn, bcn FROM counts WHERE cn >= 5 OR word = '</s>'",
    "common_vocab": f"WITH {_TWO} SELECT word, cn, gcn, bcn FROM counts WHERE gcn > 0 AND bcn > 0",
    "vocab_totals": f"WITH {_TWO} SELECT count(*) AS words, CAST(sum(cn) AS BIGINT) AS cn_total, CAST(sum(gcn) AS BIGINT) AS gcn_total, CAST(sum(bcn) AS BIGINT) AS bcn_total FROM counts WHERE cn >= 5 AND word <> '</s>'",
    "merged_vocab": f"WITH {SQL_COUNTS} SELECT * FROM word_counts",
    "shared_or_frequent": f"""WITH dark AS (SELECT word, count(*) AS n FROM (SELECT {_SPLIT} AS word FROM dark_texts) GROUP BY word), white AS (SELECT DISTINCT {_SPLIT} AS word FROM reddit)
SELECT word FROM dark WHERE n >= 200 OR word IN (SELECT word FROM white)""",
    "aligned_sentences": f"""WITH {sentences_sql(DARK + WHITE)}, x AS (SELECT CASE WHEN forum = 'reddit' THEN 'white' ELSE 'dark' END AS side, forum, row_id, i, generate_subscripts(s, 1) AS j, unnest(s) AS tokens FROM t),
n AS (SELECT side, word, count(*) AS n FROM (SELECT side, unnest(tokens) AS word FROM x) GROUP BY ALL),
allowed AS (SELECT word FROM n WHERE side = 'dark' AND (n >= 200 OR word IN (SELECT word FROM n WHERE side = 'white'))),
f AS (SELECT DISTINCT forum, row_id, i, j FROM (SELECT forum, row_id, i, j, unnest(tokens) AS word FROM x) WHERE word NOT IN (SELECT word FROM allowed))
SELECT side, forum, row_id, string_agg(array_to_string(tokens, ' '), ' ' ORDER BY i, j) AS line FROM x ANTI JOIN f USING (forum, row_id, i, j) GROUP BY side, forum, row_id""",
    "without_rare_words": rf"""WITH w AS (SELECT line_id, generate_subscripts(t, 1) AS pos, unnest(t) AS word FROM (SELECT line_id, regexp_extract_all(texts, '\S+') AS t FROM dark_texts)),
f AS (SELECT word FROM w GROUP BY word HAVING count(*) > 10) SELECT line_id, string_agg(word, ' ' ORDER BY pos) AS line FROM w SEMI JOIN f USING (word) GROUP BY line_id""",
    "coverage_summary": f"""WITH {_VOCAB} SELECT label, CAST(sum(n) AS BIGINT) AS total, count(*) AS words, CAST(count(*) FILTER (WHERE n > 10) AS BIGINT) AS frequent_words,
  CAST(coalesce(sum(n) FILTER (WHERE n > 10), 0) AS BIGINT) AS frequent_total, round(coalesce(sum(n) FILTER (WHERE n > 10), 0) / CAST(sum(n) AS DOUBLE), 9) AS coverage
FROM (SELECT * FROM each_ UNION ALL SELECT * FROM combined) GROUP BY label""",
    "coverage_histogram": f"""WITH {_VOCAB}, per AS (SELECT label, n, count(*) AS words, (SELECT count(*) FROM combined c WHERE c.label = v.label) AS all_words,
  array_to_string(list_slice(list(word ORDER BY md5(word), word), 1, 5), ',') AS samples FROM combined v WHERE n <= 10 GROUP BY label, n)
SELECT label, n, words, CAST(all_words - sum(words) OVER (PARTITION BY label ORDER BY n) AS BIGINT) AS remain, samples FROM per""",
    "missed_words": f"{_FREQ} SELECT word, n FROM dark ANTI JOIN white USING (word)",
    "common_words": f"{_FREQ} SELECT word, n FROM dark SEMI JOIN white USING (word)",
    "coverage_ratio": f"{_FREQ} SELECT round(count(w.word) / CAST(count(*) AS DOUBLE), 9) AS unique_coverage, round(sum(CASE WHEN w.word IS NULL THEN 0 ELSE n END) / CAST(sum(n) AS DOUBLE), 9) AS word_coverage FROM dark LEFT JOIN white w ON dark.word = w.word",
    "subsample_probability": f"""WITH {SQL_COUNTS}, t AS (SELECT 0.001::DOUBLE * sum(cn) AS t FROM word_counts WHERE cn > 0)
SELECT word, round(least((sqrt(cn / t) + 1) * t / cn, 1.0::DOUBLE), 9) AS p FROM word_counts, t WHERE cn > 0""",
    "negative_distribution": f"WITH {SQL_COUNTS} SELECT word, round(pow(CAST(cn AS DOUBLE), 0.75::DOUBLE) / (SELECT sum(pow(CAST(cn AS DOUBLE), 0.75::DOUBLE)) FROM word_counts WHERE cn > 0), 10) AS p FROM word_counts WHERE cn > 0",
    "bigram_counts": f"WITH {_POS} SELECT a, b, n FROM big",
    "phrase_scores": f"WITH {_POS} SELECT a, b, n, round(score, 6) AS score FROM scored",
    "phrase_merge": f"""WITH {_POS}, inline_ AS (SELECT line_id, pos, word, lag(word) OVER (PARTITION BY line_id ORDER BY pos) AS prev FROM w),
hit AS (SELECT l.*, s.a IS NOT NULL AS hit FROM inline_ l LEFT JOIN scored s ON l.prev = s.a AND l.word = s.b AND s.score > 100),
runs AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY line_id ORDER BY pos) AS miss FROM hit),
nth AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY line_id, miss ORDER BY pos) AS nth FROM runs)
SELECT line_id, string_agg(CASE WHEN pos = 1 THEN '' WHEN hit AND nth % 2 = 1 THEN '_' ELSE ' ' END || word, '' ORDER BY pos) AS line FROM nth GROUP BY line_id""",
    "cooccurrence": rf"""WITH {_POS}, k AS (SELECT line_id, word, row_number() OVER (PARTITION BY line_id ORDER BY pos) AS i FROM w WHERE word IN (SELECT word FROM uni WHERE n >= 5))
SELECT x.word AS center, y.word AS context, count(*) AS n FROM k x JOIN k y ON x.line_id = y.line_id AND x.i <> y.i AND abs(x.i - y.i) <= 5 AND (x.i - 1) // 1000 = (y.i - 1) // 1000 GROUP BY ALL""",
}

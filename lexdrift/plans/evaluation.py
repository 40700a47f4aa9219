"""Evaluation queries: candidates of changed meaning, explanations, annotations, dated tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexdrift.functions import text as T
from lexdrift.operators import evaluation as E
from lexdrift.plans.common import DARK, SQL_COUNTS, SQL_VECTORS, WHITE, table, threads, vectors, word_counts
from lexdrift.session import stage

# The test vectors are unrelated across models, so floors and ceiling are smaller than the defaults.
LIMITS = {"least_good": 10, "least_bad": 5, "ceiling": 0.3}


def _inputs(spark, d):
    """Vectors and counts, staged: the plans read them several times."""
    return stage(vectors(spark, d), "vectors"), stage(word_counts(spark, d), "counts")


def _candidates(spark, d, v=None, counts=None):
    return E.candidates(*((v, counts) if v is not None else (vectors(spark, d), word_counts(spark, d))), **LIMITS)


def shift_candidates(spark, d):
    return _candidates(spark, d)


def candidate_neighbours(spark, d):
    v, counts = _inputs(spark, d)
    c = E.explained(_candidates(spark, d, v, counts), v, counts, 40, 10)
    return c.select("rank", "word", "sim", *(F.coalesce(x, F.lit("")).alias(x) for x in ("good_interpretation", "bad_interpretation", "normal_interpretation")))


_NEAR = ["good_interpretation", "bad_interpretation", "normal_interpretation"]


def explained_candidates(spark, d):
    """The candidates with all 100 neighbours of sufficient count and their sample lines."""
    v, counts = _inputs(spark, d)
    cands = stage(_candidates(spark, d, v, counts), "candidates")
    c = E.explained(cands, v, counts)
    full = E.with_samples(c, threads(spark, d, DARK, "comments"), threads(spark, d, WHITE, "comments"))
    return full.select("rank", "word", "sim", *(F.coalesce(x, F.lit("")).alias(x) for x in _NEAR), "bad_sen", "good_sen")


def explained_missed(spark, d):
    v, counts = _inputs(spark, d)
    m = E.missed_explained(_candidates(spark, d, v, counts), annotation_labels(spark, d), v, counts)
    return m.select("word", "sim", "gcn", "bcn", *(F.coalesce(x, F.lit("")).alias(x) for x in _NEAR), "bad_sen", "good_sen", "label")


def _spans(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    start = F.col("doc_id") % 50
    spans = docs.select(F.coalesce("source", F.lit("none")).alias("forum"), F.col("doc_id").alias("code"), start.cast("int").alias("start"), (start + 12).cast("int").alias("end_pos"), (F.col("doc_id") % 3).alias("tagger"))
    levels = table(spark, d, "level_labels").groupBy("doc_id").agg(F.max("level").cast("string").alias("type"))
    texts = docs.join(levels, "doc_id", "left").select(F.coalesce("source", F.lit("none")).alias("forum"), F.col("doc_id").alias("code"), "type", "text")
    return spans, texts


def annotation_tokens(spark, d):
    return E.annotation_tokens(*_spans(spark, d))


def annotation_labels(spark, d):
    return E.labels(annotation_tokens(spark, d))


def labelled_candidates(spark, d):
    return E.labelled(_candidates(spark, d), annotation_labels(spark, d))


def missed_annotations(spark, d):
    v, counts = _inputs(spark, d)
    return E.missed(_candidates(spark, d, v, counts), annotation_labels(spark, d), v, counts)


def _dated(spark, d):
    rows = table(spark, d, "dark_texts").where("tid is not null").select(F.concat_ws(":", "forum", "tid").alias("thread"), "posted_at", "texts")
    return rows.select("thread", F.explode(T.blank_tokens(F.col("texts"))).alias("token")), rows.select("thread", F.col("posted_at").alias("ts"))


def token_dates(spark, d):
    return E.dated_tokens(*_dated(spark, d)).select("token", "thread", *(F.unix_micros(c).alias(c) for c in ("start_date", "end_date")))


def token_first_last(spark, d):
    return E.dated_tokens(*_dated(spark, d)).groupBy("token").agg(F.unix_micros(F.min("start_date")).alias("first"), F.unix_micros(F.max("end_date")).alias("last"), F.count("*").alias("threads"))


def thread_date_range(spark, d):
    return _dated(spark, d)[1].groupBy("thread").agg(F.unix_micros(F.min("ts")).alias("start_date"), F.unix_micros(F.max("ts")).alias("end_date"))


def event_dates(spark, d):
    e = table(spark, d, "events")
    return E.dated_tokens(e.select(F.col("user_id").alias("thread"), F.col("event_type").alias("token")), e.select(F.col("user_id").alias("thread"), "ts"), 2).groupBy("token").agg(F.count("*").alias("threads"))


def similarity_points(spark, d):
    """Points of the similarity panel: finite similarities with their counts; ``writers.plot_points`` writes them."""
    s = E.X.cross_model(vectors(spark, d)).where("not isnan(sim)").join(word_counts(spark, d), "word")
    return s.select("word", F.round("sim", 6).alias("sim"), F.col("cn").alias("occurrence"))


QUERIES = [shift_candidates, candidate_neighbours, explained_candidates, explained_missed, annotation_tokens, annotation_labels, labelled_candidates, missed_annotations, token_dates, token_first_last, thread_date_range, event_dates, similarity_points]

_CANDS = f"""{SQL_VECTORS}, {SQL_COUNTS},
sims AS (SELECT g.word, g.idx, round(list_dot_product(g.vector, b.vector) / (sqrt(list_dot_product(g.vector, g.vector)) * sqrt(list_dot_product(b.vector, b.vector))), 6) AS sim
  FROM vectors g JOIN vectors b ON g.idx = b.idx WHERE g.model = 'good' AND b.model = 'bad'),
cands AS (SELECT row_number() OVER (ORDER BY sim, idx) AS rank, word, idx, sim, gcn, bcn FROM sims JOIN word_counts USING (word) WHERE gcn >= 10 AND bcn >= 5 AND sim < 0.3)"""
_ANN = r"""lv AS (SELECT doc_id, CAST(max(level) AS VARCHAR) AS type FROM level_labels GROUP BY doc_id),
ann AS (SELECT DISTINCT unnest(regexp_extract_all(lower(trim(substring(text, CAST(doc_id % 50 AS INT) + 1, 12))), '[\p{L}\p{N}_-]+')) AS token, coalesce(source, 'none') AS forum, type, doc_id % 3 AS tagger
  FROM documents LEFT JOIN lv USING (doc_id) WHERE text IS NOT NULL),
marks AS (SELECT token, array_to_string(list_sort(list(DISTINCT forum)), '/') || ' ' || array_to_string(list_sort(list(DISTINCT coalesce(type, 'None'))), '/') AS label FROM ann WHERE length(token) > 1 GROUP BY token)"""
_DATED = r"""rows_ AS (SELECT forum || ':' || tid AS thread, posted_at, texts FROM dark_texts WHERE tid IS NOT NULL),
ranges AS (SELECT thread, min(posted_at) AS s, max(posted_at) AS e FROM rows_ WHERE posted_at IS NOT NULL GROUP BY thread),
once AS (SELECT DISTINCT thread, unnest(regexp_extract_all(texts, '\S+')) AS token FROM rows_),
dated AS (SELECT token, once.thread, epoch_us(s) AS start_date, epoch_us(e) AS end_date FROM once JOIN ranges USING (thread) WHERE thread IN (SELECT thread FROM once GROUP BY thread HAVING count(*) > 3))"""


def _near(a: str, b: str, count: str) -> str:
    return f"""(SELECT qid, string_agg(word, ' ' ORDER BY r) AS l FROM (SELECT c.idx AS qid, y.idx, row_number() OVER (PARTITION BY c.idx ORDER BY round(list_dot_product(x.vec, y.vec), 6) DESC, y.idx) AS r
  FROM cands c JOIN unit x ON x.idx = c.idx AND x.model = '{a}' JOIN unit y ON y.model = '{b}' QUALIFY r <= 40) t JOIN words USING (idx) JOIN word_counts USING (word) WHERE {count} >= 10 GROUP BY qid)"""


ORACLES = {
    "shift_candidates": f"WITH {_CANDS} SELECT * FROM cands",
    "candidate_neighbours": f"""WITH {_CANDS}, unit AS (SELECT model, idx, list_transform(vector, lambda x: x / sqrt(list_dot_product(vector, vector))) AS vec FROM vectors), words AS (SELECT idx, word FROM vectors WHERE model = 'good'),
g AS {_near('bad', 'good', 'gcn')}, b AS {_near('bad', 'good', 'bcn')}, n AS {_near('good', 'good', 'gcn')}
SELECT rank, c.word, sim, coalesce(g.l, '') AS good_interpretation, coalesce(b.l, '') AS bad_interpretation, coalesce(n.l, '') AS normal_interpretation
FROM cands c LEFT JOIN g ON g.qid = c.idx LEFT JOIN b ON b.qid = c.idx LEFT JOIN n ON n.qid = c.idx""",
    "annotation_tokens": f"WITH {_ANN} SELECT token, forum, type, tagger FROM ann WHERE length(token) > 1",
    "annotation_labels": f"WITH {_ANN} SELECT * FROM marks",
    "labelled_candidates": f"WITH {_CANDS}, {_ANN} SELECT rank, c.word, sim, label IS NOT NULL AS labeled, coalesce(label, '') AS label FROM cands c LEFT JOIN marks m ON m.token = c.word",
    "missed_annotations": f"""WITH {_CANDS}, {_ANN} SELECT m.token AS word, sim, gcn, bcn, CAST(NULL AS VARCHAR) AS bad_sen, CAST(NULL AS VARCHAR) AS good_sen, label
FROM marks m LEFT JOIN sims s ON s.word = m.token LEFT JOIN word_counts w ON w.word = m.token WHERE m.token NOT IN (SELECT word FROM cands)""",
    "token_dates": f"WITH {_DATED} SELECT * FROM dated",
    "token_first_last": f"WITH {_DATED} SELECT token, min(start_date) AS first, max(end_date) AS last, count(*) AS threads FROM dated GROUP BY token",
    "thread_date_range": f"WITH {_DATED} SELECT thread, epoch_us(min(posted_at)) AS start_date, epoch_us(max(posted_at)) AS end_date FROM rows_ GROUP BY thread",
    "event_dates": "WITH o AS (SELECT DISTINCT user_id, event_type FROM events) SELECT event_type AS token, count(*) AS threads FROM o WHERE user_id IN (SELECT user_id FROM o GROUP BY user_id HAVING count(*) > 2) GROUP BY event_type",
    "similarity_points": f"WITH {_CANDS} SELECT word, sim, cn AS occurrence FROM sims JOIN word_counts USING (word)",
}

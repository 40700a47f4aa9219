"""The queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexdrift.llm import markup, mixing, near_duplicates, packing, personal_info, reading_level, repeated_lines, sentences, similar_vectors, term_counts
from lexdrift.llm.common import table, tagged


def _private_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every text of problem 1 as an array; those of hackforums are arrays of the one field ``texts``."""
    return tagged(spark, d, ["nulled"], "row_id", "comments").union(tagged(spark, d, ["hackforums"], "row_id", F.array("texts").alias("comments")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    find = personal_info.finder(table(spark, d, "name_list"))
    found = personal_info.mentions(_private_texts(spark, d), find, "comments")
    place = F.when(F.col("tbl") == "hackforums", F.lit(-1)).otherwise(F.col("comment_ix")).cast("bigint")
    return found.select("tbl", "row_id", place.alias("comment_ix"), "kind", "start_pos")


def p1_masked(spark: SparkSession, d: str) -> DataFrame:
    find = personal_info.finder(table(spark, d, "name_list"))
    return personal_info.masked(_private_texts(spark, d), find, "comments")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_vectors.similar_pairs(table(spark, d, "syn0"), 5, 0.85)


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar words, whatever their cosine, of every word whose number is divisible by 20."""
    found = similar_vectors.most_similar(table(spark, d, "syn0"), 10, queries="idx % 20 = 0", probes=24, recall=0.96)
    return found.select("model", "idx", "near", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("bigint"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = tagged(spark, d, ["hackforums", "darkode"], "row_id", "comments")
    membership, links = near_duplicates.near_duplicates(rows, "row_id", "comments", width=3, least_words=20, threshold=0.5)
    return near_duplicates.row_pairs(membership, links)


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """The classes of equal records behind ``p3_found``, with the number of links of every row."""
    rows = tagged(spark, d, ["hackforums", "darkode"], "row_id", "comments")
    return near_duplicates.class_table(*near_duplicates.near_duplicates(rows, "row_id", "comments", width=3, least_words=20, threshold=0.5))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = tagged(spark, d, ["hackforums", "darkode"], "row_id", "comments")
    return near_duplicates.groups(*near_duplicates.near_duplicates(rows, "row_id", "comments", width=5, least_words=20, threshold=0.8))


SITES = ["nulled", "silkroad_fts"]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_line_occurrences(tagged(spark, d, SITES, "row_id", "comments"))


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    kept = repeated_lines.without_repeated_lines(tagged(spark, d, SITES, "row_id", "comments"))
    return kept.select("tbl", "row_id", F.posexplode("comments").alias("comment_ix", "comment")).select("tbl", "row_id", F.col("comment_ix").cast("bigint"), "comment")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(tagged(spark, d, ["nulled", "reddit"], "row_id", "comments"))


def p5_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(tagged(spark, d, ["nulled", "reddit"], "row_id", "comments"), with_text=True)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    texts, vocab = table(spark, d, "dark_texts"), table(spark, d, "goodbad_vocab")
    rows = texts.count()
    total = vocab.where("word is not null").agg(F.sum("cn")).first()[0] or 0
    dark = term_counts.marks(term_counts.term_counts(texts, "texts"), "recs", 3, 0.1 * rows)
    words = term_counts.marks(term_counts.weighted_counts(vocab, "word", "cn"), "occ", 5, 0.005 * total)
    return dark.select(F.lit("dark_texts").alias("field_of"), "term", "mark").union(words.select(F.lit("goodbad_vocab").alias("field_of"), "term", "mark"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows = tagged(spark, d, SITES, "row_id", "raw_comments", "comments")
    return markup.elements(rows, markup.model(rows))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    rows = tagged(spark, d, SITES, "row_id", "raw_comments", "comments")
    return markup.clean(rows, markup.model(rows))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "bin_sizes"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_packed(spark, d))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.share_report(p9_mixture(spark, d), table(spark, d, "mix_targets"))


def p9_margins(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and actual shares of sources, languages and topics."""
    made = mixing.plan(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return mixing.margin_report(mixing.draw(made), made)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = reading_level.fit_levels(docs, table(spark, d, "level_labels"))
    return reading_level.levels(docs.where("lang = 'en' and length(text) >= 300"), model).select("doc_id", "level")


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    """The level of every document, whatever its language and length; ``p10_found`` has those of its definition."""
    docs = table(spark, d, "documents")
    model = reading_level.fit_levels(docs, table(spark, d, "level_labels"))
    return reading_level.levels(docs, model).select("doc_id", "level")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.term_counts(table(spark, d, "dark_texts"), "texts")


_FREQUENT = r"""
WITH rows_ AS (
  SELECT 'nulled' AS tbl, row_id, comments FROM nulled
  UNION ALL SELECT 'silkroad_fts', row_id, comments FROM silkroad_fts
), coms AS (
  SELECT tbl, row_id, generate_subscripts(comments, 1) - 1 AS comment_ix, unnest(comments) AS comment FROM rows_
), parts AS (
  SELECT tbl, row_id, comment_ix, comment, string_split(comment, chr(10)) AS ls FROM coms
), lines AS (
  SELECT tbl, row_id, comment_ix, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line FROM parts WHERE comment IS NOT NULL
), keyed AS (
  SELECT *, lower(regexp_replace(line, '\P{L}+', '', 'g')) AS k FROM lines
), totals AS (
  SELECT tbl, count(*) AS n_rows FROM rows_ GROUP BY tbl
), frequent AS (
  SELECT k.tbl, k.k FROM keyed k JOIN totals t ON k.tbl = t.tbl WHERE k.k <> ''
  GROUP BY k.tbl, k.k, t.n_rows
  HAVING count(DISTINCT k.row_id) >= 4 AND count(DISTINCT k.row_id) >= 0.02 * t.n_rows
)
"""

ORACLES = {
    "p4_found": _FREQUENT + """
SELECT k.tbl, k.row_id, CAST(k.comment_ix AS BIGINT) AS comment_ix, CAST(k.line_no AS BIGINT) AS line_no
FROM keyed k SEMI JOIN frequent f ON k.tbl = f.tbl AND k.k = f.k""",
    "p4_clean": _FREQUENT + """
, kept AS (
  SELECT k.tbl, k.row_id, k.comment_ix, string_agg(k.line, chr(10) ORDER BY k.line_no) AS comment
  FROM keyed k ANTI JOIN frequent f ON k.tbl = f.tbl AND k.k = f.k GROUP BY ALL
)
SELECT c.tbl, c.row_id, CAST(c.comment_ix AS BIGINT) AS comment_ix, CASE WHEN c.comment IS NULL THEN NULL ELSE coalesce(x.comment, '') END AS comment
FROM coms c LEFT JOIN kept x ON c.tbl = x.tbl AND c.row_id = x.row_id AND c.comment_ix = x.comment_ix""",
    "p6_counts": r"""
SELECT term, CAST(count(*) AS BIGINT) AS occ, CAST(count(DISTINCT line_id) AS BIGINT) AS recs
FROM (SELECT line_id, unnest(regexp_extract_all(texts, '[^ \t]+')) AS term FROM dark_texts) GROUP BY term""",
    "p6_found": r"""
WITH t AS (SELECT line_id, unnest(regexp_extract_all(texts, '[^ \t]+')) AS term FROM dark_texts),
d AS (SELECT term, count(DISTINCT line_id) AS n FROM t GROUP BY term),
v AS (SELECT word AS term, coalesce(sum(cn), 0) AS n FROM goodbad_vocab WHERE word IS NOT NULL GROUP BY word),
m AS (
  SELECT 'dark_texts' AS field_of, term, CASE WHEN n < 3 THEN 'rare' WHEN n > 0.1 * (SELECT count(*) FROM dark_texts) THEN 'common' END AS mark FROM d
  UNION ALL
  SELECT 'goodbad_vocab', term, CASE WHEN n < 5 THEN 'rare' WHEN n > 0.005 * (SELECT sum(cn) FROM goodbad_vocab WHERE word IS NOT NULL) THEN 'common' END FROM v)
SELECT * FROM m WHERE mark IS NOT NULL""",
}

_QUERIES = [p1_found, p1_masked, p2_found, p2_neighbours, p3_found, p3_classes, p3_groups, p4_found, p4_clean, p5_found, p5_sentences, p6_found, p6_counts, p7_found, p7_clean, p8_packed, p8_fill, p9_mixture, p9_shares, p9_margins, p10_found, p10_levels]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

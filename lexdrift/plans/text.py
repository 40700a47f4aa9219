"""Text queries: masks, tokens, recipes, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexdrift.functions import text as T
from lexdrift.plans.common import FORUMS, table, threads

STOP_SQL = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOPWORDS) + ")"


def word_count(spark, d):
    return table(spark, d, "dark_texts").select("forum", F.explode(T.blank_tokens(F.col("texts"))).alias("token")).groupBy("forum", "token").agg(F.count("*").alias("n"))


def deaccent_tokens(spark, d):
    return table(spark, d, "documents").select(F.explode(T.word_tokens(T.deaccent(F.lower("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def alphabetic_tokens(spark, d):
    return (
        table(spark, d, "reddit").select(F.explode("comments").alias("c")).select(F.explode(T.alphabetic_tokens(F.lower("c"))).alias("token"))
        .groupBy("token").agg(F.count("*").alias("n"))
    )


def stopword_free_count(spark, d):
    tokens = table(spark, d, "documents").where("lang = 'en'").select(F.explode(T.alphabetic_tokens(F.lower("text"))).alias("token"))
    return tokens.where(T.not_stopword(F.col("token"))).groupBy("token").agg(F.count("*").alias("n"))


def hash_masks(spark, d):
    rows = threads(spark, d, ["nulled", "reddit"], "row_id", F.explode("comments").alias("c"))
    masked = F.regexp_replace(F.lower("c"), T.HASH, T.HASH_TOKEN)
    return rows.select("forum", (F.size(F.split(masked, "HASH__TOKEN")) - 1).cast("bigint").alias("n")).where("n > 0").groupBy("forum").agg(F.sum("n").alias("hashes"))


def mask_counts(spark, d):
    """Mask tokens of each kind per board."""
    rows = table(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), T.mask(F.lower("text")).alias("m"))
    count = lambda t: F.sum(F.size(F.split("m", t)) - 1).cast("bigint")
    return rows.where("m is not null").groupBy("source").agg(count("EMAIL__TOKEN").alias("emails"), count("URL__TOKEN").alias("urls"), count("HASH__TOKEN").alias("hashes"))


def pure_texts(spark, d):
    rows = threads(spark, d, FORUMS, "row_id", "title", "comments", "authors")
    return rows.select("forum", "row_id", F.array_join(T.pure_tokens(F.col("title"), F.col("comments"), F.col("authors")), " ").alias("texts"))


def simple_texts(spark, d):
    return threads(spark, d, FORUMS, "row_id", "title", "comments").select("forum", "row_id", F.array_join(T.simple_tokens(F.col("title"), F.col("comments")), " ").alias("texts"))


def sentence_tokens(spark, d):
    rows = threads(spark, d, FORUMS, "row_id", "comments").select("forum", "row_id", F.posexplode(T.sentence_tokens(F.col("comments"))).alias("comment_ix", "sentences"))
    return rows.select("forum", "row_id", F.col("comment_ix").cast("bigint").alias("comment_ix"), F.posexplode("sentences").alias("sent_ix", "tokens")).select(
        "forum", "row_id", "comment_ix", F.col("sent_ix").cast("bigint").alias("sent_ix"), F.array_join("tokens", " ").alias("tokens")
    )


def prose_threads(spark, d):
    rows = threads(spark, d, FORUMS, "row_id", T.prose(F.col("comments")).alias("texts"))
    return rows.where(F.length("texts") > 100)


def code_ratio(spark, d):
    c = F.col("c")
    rows = table(spark, d, "nulled").select("row_id", F.posexplode("raw_comments").alias("ix", "c"))
    return rows.select("row_id", F.col("ix").cast("bigint").alias("comment_ix"), F.round(T.code_share(c), 9).alias("share")).where("share is not null")


def cut_between_markers(spark, d):
    return table(spark, d, "hackforums").where("texts is not null").select("row_id", T.cut_between(F.col("texts"), "price is", "included").alias("texts"))


def pgp_removed(spark, d):
    return table(spark, d, "dark_texts").where("texts is not null").select("line_id", T.without_pgp(F.col("texts")).alias("texts"))


def json_lists(spark, d):
    back = F.from_json(F.to_json("authors", {"ignoreNullFields": "false"}), "array<string>")
    rows = threads(spark, d, ["nulled", "silkroad_fts"], "row_id", back.alias("authors"))
    return rows.select("forum", "row_id", F.posexplode("authors").alias("ix", "author")).select("forum", "row_id", F.col("ix").cast("bigint").alias("ix"), "author")


def content_hashes(spark, d):
    return threads(spark, d, ["hackforums", "darkode"], "row_id", T.content_hash(F.col("title"), F.col("comments")).alias("digest"))


def letters_only(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.letters_only(F.replace("text", F.lit("\n"), F.lit(" "))).alias("text"))


def spaced_punctuation(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.spaced_punctuation(F.col("text")).alias("text"))


def wiki_text(spark, d):
    rows = table(spark, d, "silkroad_fts").select("row_id", F.posexplode("raw_comments").alias("ix", "c")).where("c is not null")
    return rows.select("row_id", F.col("ix").cast("bigint").alias("comment_ix"), T.wiki_text(F.col("c")).alias("text"))


def sigmoid_table(spark, d):
    x = (F.col("id").cast("double") / 1000 * 2 - 1) * 6
    return spark.range(1000).select("id", F.round(T.clamped_sigmoid(x + 1e-9), 9).alias("y"))


QUERIES = [
    word_count, deaccent_tokens, alphabetic_tokens, stopword_free_count, hash_masks, mask_counts, pure_texts, simple_texts, sentence_tokens, prose_threads, code_ratio,
    cut_between_markers, pgp_removed, json_lists, content_hashes, letters_only, spaced_punctuation, wiki_text, sigmoid_table,
]


def _replaced(column: str, rules) -> str:
    for pattern, to in rules:
        quoted = pattern.replace("'", "''")
        column = f"regexp_replace({column}, '{quoted}', '{to.replace('$1', chr(92) + '1')}', 'g')"
    return column


def _cut_sql(column: str, start: str, end: str) -> str:
    return f"array_to_string(list_transform(string_split({column}, '{start}'), lambda p: CASE WHEN instr(p, '{end}') > 0 THEN substring(p, instr(p, '{end}') + {len(end)}) ELSE p END), ' ')"


def _pgp_sql() -> str:
    out = "texts"
    for s, e in T.PGP:
        out = f"CASE WHEN contains({out}, '{s}') THEN {_cut_sql(out, s, e)} ELSE {out} END"
    return out


_HASHED = r"regexp_replace(lower(c), '\b[a-f0-9]{32}\b|\b[a-f0-9]{40}\b|\b[a-f0-9]{64}\b', 'HASH__TOKEN ', 'g')"
def _sql_regex(pattern: str) -> str:
    return pattern.replace("'", "''")


def _masked_sql(column: str) -> str:
    for pattern, token in ((T.EMAIL, T.EMAIL_TOKEN), (T.URL, T.URL_TOKEN), (T.HASH, T.HASH_TOKEN)):
        column = f"regexp_replace({column}, '{_sql_regex(pattern)}', '{token}', 'g')"
    return column


def deaccent_sql(column: str) -> str:
    return rf"regexp_replace(translate({column}, '{T.accent_map()[0]}', '{T.accent_map()[1]}'), '\p{{Mn}}', '', 'g')"


_FLAT = "coalesce(array_to_string(list_transform(list_filter(comments, lambda c: c IS NOT NULL), lambda c: replace(c, chr(10), ' ')), chr(10)), '')"


def forums_sql(columns: str, names: list[str] = FORUMS) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS forum, {columns} FROM {f}" for f in names)


def _unescaped_sql(column: str) -> str:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("#x27", "''"), ("nbsp", "\u00a0"), ("amp", "&")):
        column = f"replace({column}, '&{name};', '{char}')"
    return column


def sentences_sql(names: list[str]) -> str:
    """Common table ``t(forum, row_id, i, s)``: the sentences of each kept comment, as lists of tokens."""
    return rf"""c AS (SELECT forum, row_id, generate_subscripts(comments, 1) AS i, unnest(comments) AS c FROM ({forums_sql('row_id, comments', names)})),
l AS (SELECT forum, row_id, i, string_split(regexp_replace(regexp_replace({_masked_sql('lower(trim(c))')}, '[\n\r\x0B\f\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(10), 'g'), chr(10)) AS s FROM c WHERE {_KEPT}),
t AS (SELECT forum, row_id, i, list_filter(list_transform(s, lambda x: list_filter(list_transform(list_filter(regexp_extract_all({deaccent_sql('x')}, '[\p{{L}}\p{{N}}_-]+'),
  lambda t: NOT regexp_full_match(t, '\p{{Nd}}+') AND length(t) > 1 AND t NOT IN {STOP_SQL}), lambda t: trim(t, '-_ ')), lambda t: t <> '')), lambda x: len(x) > 0) AS s FROM l)"""


_KEPT = "c IS NOT NULL AND (i <= 2 OR length(trim(c)) >= 20)"
ORACLES = {
    "mask_counts": f"""WITH m AS (SELECT coalesce(source, 'none') AS source, {_masked_sql('lower(text)')} AS m FROM documents WHERE text IS NOT NULL)
SELECT source, CAST(sum(len(string_split(m, 'EMAIL__TOKEN')) - 1) AS BIGINT) AS emails, CAST(sum(len(string_split(m, 'URL__TOKEN')) - 1) AS BIGINT) AS urls, CAST(sum(len(string_split(m, 'HASH__TOKEN')) - 1) AS BIGINT) AS hashes FROM m GROUP BY source""",
    "pure_texts": rf"""WITH r AS ({forums_sql('row_id, title, comments, authors')}),
t AS (SELECT forum, row_id, authors, regexp_extract_all({deaccent_sql(_masked_sql(f"lower(coalesce(title, '') || ' ' || {_FLAT})"))}, '[\p{{L}}\p{{Nl}}\p{{No}}_]+') AS t FROM r),
n AS (SELECT forum, row_id, list_transform(t, lambda x: CASE WHEN list_contains(coalesce(authors, []), x) THEN 'AUTHOR__TOKEN' ELSE x END) AS t FROM t)
SELECT forum, row_id, array_to_string(list_filter(list_transform(list_filter(t, lambda x: x NOT IN {STOP_SQL}), lambda x: trim(x, '_ ')), lambda x: x <> ''), ' ') AS texts FROM n""",
    "prose_threads": rf"""WITH r AS ({forums_sql('row_id, comments')}),
m AS (SELECT forum, row_id, list_transform(list_filter(comments, lambda c, i: {_KEPT}), lambda c: {_masked_sql('trim(c)')}) AS m FROM r),
p AS (SELECT forum, row_id, array_to_string(list_filter(m, lambda c: NOT (length(c) > 200 AND length(regexp_replace(c, '[^(){{}}\[\].;"]', '', 'g')) / CAST(length(c) AS DOUBLE) > 0.05)), '.' || chr(10) || chr(10)) AS texts FROM m)
SELECT * FROM p WHERE length(texts) > 100""",
    "sentence_tokens": f"WITH {sentences_sql(FORUMS)} SELECT forum, row_id, CAST(i - 1 AS BIGINT) AS comment_ix, CAST(generate_subscripts(s, 1) - 1 AS BIGINT) AS sent_ix, array_to_string(unnest(s), ' ') AS tokens FROM t",
    "page_text": r"""WITH c AS (SELECT row_id, generate_subscripts(raw_comments, 1) - 1 AS i, unnest(raw_comments) AS c FROM hackforums),
p AS (SELECT row_id, i, list_filter(string_split_regex(regexp_replace(c, '<code\b[^>]*>.*?</code>', '<x>', 'gs'), '<[a-zA-Z/!][^>]*>'), lambda x: x <> '') AS p FROM c WHERE c IS NOT NULL)
SELECT row_id, CAST(i AS BIGINT) AS comment_ix, html_unescape(array_to_string(p, ' ')) AS text FROM p""".replace("html_unescape(array_to_string(p, ' '))", _unescaped_sql("array_to_string(p, ' ')")),
    "word_count": r"SELECT forum, token, count(*) AS n FROM (SELECT forum, unnest(regexp_extract_all(texts, '\S+')) AS token FROM dark_texts) GROUP BY ALL",
    "alphabetic_tokens": r"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(c), '[\p{L}\p{Nl}\p{No}_]+')) AS token FROM (SELECT unnest(comments) AS c FROM reddit)) GROUP BY ALL",
    "stopword_free_count": rf"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{Nl}}\p{{No}}_]+')) AS token FROM documents WHERE lang = 'en') WHERE token NOT IN {STOP_SQL} GROUP BY ALL",
    "deaccent_tokens": rf"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace(translate(lower(text), '{T.accent_map()[0]}', '{T.accent_map()[1]}'), '\p{{Mn}}', '', 'g'), '[\p{{L}}\p{{N}}_-]+')) AS token FROM documents) GROUP BY ALL",
    "hash_masks": f"""WITH r AS (SELECT 'nulled' AS forum, unnest(comments) AS c FROM nulled UNION ALL SELECT 'reddit', unnest(comments) FROM reddit)
SELECT forum, CAST(sum(n) AS BIGINT) AS hashes FROM (SELECT forum, len(string_split({_HASHED}, 'HASH__TOKEN')) - 1 AS n FROM r) WHERE n > 0 GROUP BY forum""",
    "simple_texts": rf"""WITH r AS ({forums_sql('row_id, title, comments')}) SELECT forum, row_id, array_to_string(list_filter(regexp_extract_all(
  {deaccent_sql("lower(coalesce(title, '') || ' ' || coalesce(replace(array_to_string(comments, ' '), chr(10), ' '), ''))")}, '[\p{{L}}\p{{Nl}}\p{{No}}_]+'), lambda t: t NOT IN {STOP_SQL}), ' ') AS texts FROM r""",
    "code_ratio": r"""SELECT row_id, CAST(ix AS BIGINT) AS comment_ix, round(length(regexp_replace(c, '[^(){}\[\].;"]', '', 'g')) / CAST(length(c) AS DOUBLE), 9) AS share
FROM (SELECT row_id, generate_subscripts(raw_comments, 1) - 1 AS ix, unnest(raw_comments) AS c FROM nulled) WHERE length(c) > 0""",
    "cut_between_markers": f"SELECT row_id, {_cut_sql('texts', 'price is', 'included')} AS texts FROM hackforums WHERE texts IS NOT NULL",
    "pgp_removed": f"SELECT line_id, trim({_pgp_sql()}) AS texts FROM dark_texts WHERE texts IS NOT NULL",
    "json_lists": """WITH r AS (SELECT 'nulled' AS forum, row_id, authors FROM nulled UNION ALL SELECT 'silkroad_fts', row_id, authors FROM silkroad_fts)
SELECT forum, row_id, CAST(generate_subscripts(authors, 1) - 1 AS BIGINT) AS ix, unnest(authors) AS author FROM r""",
    "content_hashes": """WITH r AS (SELECT 'hackforums' AS forum, row_id, title, comments FROM hackforums UNION ALL SELECT 'darkode', row_id, title, comments FROM darkode)
SELECT forum, row_id, md5(coalesce(title, '') || CASE WHEN comments IS NULL THEN '' ELSE chr(31) || array_to_string(list_transform(comments, lambda c: coalesce(c, '')), chr(31)) END) AS digest FROM r""",
    "letters_only": r"""SELECT doc_id, trim(regexp_replace(regexp_replace(translate(lower(replace(text, chr(10), ' ')), '’‘`', ''''''''), '[^a-z0-9_'' ]', ' ', 'g'), ' +', ' ', 'g')) AS text FROM documents WHERE text IS NOT NULL""",
    "spaced_punctuation": r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(translate(lower(text), '’‘`', ''''''''), '([.,()!?;:"/])', ' \1 ', 'g'), '[0-9]', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text
FROM documents WHERE text IS NOT NULL""",
    "wiki_text": rf"""SELECT row_id, CAST(ix AS BIGINT) AS comment_ix, trim(regexp_replace({_replaced('c', T.WIKI_RULES)}, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text
FROM (SELECT row_id, generate_subscripts(raw_comments, 1) - 1 AS ix, unnest(raw_comments) AS c FROM silkroad_fts) WHERE c IS NOT NULL""",
    "sigmoid_table": """SELECT CAST(i AS BIGINT) AS id, round(exp((i / 1000.0::DOUBLE * 2 - 1) * 6) / (exp((i / 1000.0::DOUBLE * 2 - 1) * 6) + 1), 9) AS y FROM range(1000) t(i)""",
}

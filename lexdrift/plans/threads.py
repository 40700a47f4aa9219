"""Thread queries: assembly, joins, upsert, index, parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexdrift.operators import parsing as P
from lexdrift.operators import threads as O
from lexdrift.plans.common import DARK, FORUMS, WHITE, table, threads
from lexdrift.plans.text import deaccent_sql


def _posts(spark, d, names=("nulled", "darkode")):
    rows = threads(spark, d, list(names), "row_id", "authors", F.posexplode("comments").alias("seq", "body"))
    author = F.get("authors", F.when(F.size("authors") > 0, F.col("seq") % F.size("authors")))
    return rows.select(F.concat_ws(":", "forum", "row_id").alias("thread_id"), F.col("seq").cast("bigint").alias("seq"), author.alias("author"), "body")


_POSTS = """rows_ AS (SELECT 'nulled' AS forum, row_id, authors, comments FROM nulled UNION ALL SELECT 'darkode', row_id, authors, comments FROM darkode),
posts AS (SELECT forum || ':' || row_id AS thread_id, CAST(seq AS BIGINT) AS seq, CASE WHEN len(authors) > 0 THEN authors[1 + seq % len(authors)] END AS author, body
  FROM (SELECT *, generate_subscripts(comments, 1) - 1 AS seq, unnest(comments) AS body FROM rows_))"""


def thread_assembly(spark, d):
    return O.assemble(_posts(spark, d)).select("thread_id", F.array_join("comments", "|").alias("comments"), F.array_join("authors", "|").alias("authors"))


def post_user_left_join(spark, d):
    users = threads(spark, d, ["nulled", "darkode"], F.explode("authors").alias("author")).where("author <> '' and author not like '%zz'").groupBy("author").agg(F.count("*").alias("threads"))
    return O.posts_with_users(_posts(spark, d), users, "author").groupBy(F.col("threads").isNotNull().alias("known")).agg(F.count("*").alias("posts"), F.coalesce(F.sum("threads"), F.lit(0)).alias("threads"))


def posts_topics_inner_join(spark, d):
    topics = table(spark, d, "nulled").where("tid is not null").select("tid", "title")
    return table(spark, d, "dark_texts").where("forum = 'nulled'").join(topics, "tid").groupBy("tid").agg(F.count("*").alias("pairs"), F.max("title").alias("title"))


def title_full_outer(spark, d):
    lines = table(spark, d, "dark_texts").where("forum = 'darkode'").groupBy("tid").agg(F.count("*").alias("lines"))
    titles = table(spark, d, "darkode").groupBy("tid").agg(F.max("title").alias("title"))
    return O.with_titles(lines, titles, "tid").select("tid", "lines", "title")


def upsert_latest(spark, d):
    rows = threads(spark, d, ["nulled", "hackforums", "darkode"], "row_id", "tid", "fetched_at", "title").withColumn("key", F.when(F.col("tid").isNotNull(), F.concat_ws(":", "forum", "tid")))
    return O.upsert(rows, "key", F.col("fetched_at"), F.col("row_id")).select("key", "row_id", "title")


def upsert_by_url(spark, d):
    return O.upsert(table(spark, d, "reddit").select("url", "fetched_at", "row_id", "title"), "url", F.col("fetched_at"), F.col("row_id")).select("url", "row_id", "title")


def page_filter(spark, d):
    url = F.col("url")
    rows = threads(spark, d, ["reddit", "silkroad_fts"], "row_id", "url")
    return rows.select("forum", "row_id", url.startswith("http").alias("prefixed"), (~url.like("%page%")).alias("no_paging")).where("prefixed or no_paging")


def search_index(spark, d):
    return O.inverted_index(threads(spark, d, FORUMS, "row_id", "comments")).select("token", "row_id", F.col("comment_ix").cast("bigint").alias("comment_ix"))


def sentence_search(spark, d):
    words = table(spark, d, "goodbad_vocab").where("word is not null").groupBy("word").agg(F.sum("bcn").alias("n")).where("n > 0").select("word")
    return O.search_lines(threads(spark, d, DARK + WHITE, "comments"), words).groupBy("word", "forum").agg(F.count("*").alias("lines"))


def page_text(spark, d):
    rows = P.html_texts(table(spark, d, "hackforums").select("row_id", "raw_comments"), "raw_comments")
    return rows.select("row_id", F.posexplode("raw_comments").alias("ix", "text")).select("row_id", F.col("ix").cast("bigint").alias("comment_ix"), "text").where("text is not null")


def board_pages(spark, d):
    """Pages built round the stored posts and read back."""
    posts = F.array_join(F.transform(F.filter("raw_comments", lambda c: c.isNotNull()), lambda c: F.concat(F.lit("<table class='tborder'><tr><td class='post_author'><span class='largetext'>x</span></td><td>"), c, F.lit("</td></tr></table>"))), "\n")
    html = F.concat(F.lit("<html><script>no()</script><div id='content'><div class='navigation'><a>1</a> <a>2</a> <a>3</a><span>"), F.coalesce("title", F.lit("")), F.lit("</span></div><div id='posts'>"), posts, F.lit("</div></div></html>"))
    pages = table(spark, d, "hackforums").where("raw_comments is not null").select("row_id", html.alias("html"))
    return P.parse_pages(pages, "board", "row_id").select(F.col("id").cast("bigint").alias("row_id"), "title", F.posexplode("raw_comments").alias("ix", "raw")).select("row_id", "title", F.col("ix").cast("bigint").alias("ix"), "raw")


QUERIES = [thread_assembly, post_user_left_join, posts_topics_inner_join, title_full_outer, upsert_latest, upsert_by_url, page_filter, search_index, sentence_search, page_text, board_pages]

_ALL = " UNION ALL ".join(f"SELECT '{f}' AS forum, unnest(comments) AS c FROM {f}" for f in DARK + WHITE)
_WORDS = r"'[\p{L}\p{N}_-]+'"


def _tokens(column: str) -> str:
    return f"regexp_extract_all({deaccent_sql(f'lower({column})')}, {_WORDS})"


ORACLES = {
    "thread_assembly": f"""WITH {_POSTS} SELECT thread_id, array_to_string(list(coalesce(body, '') ORDER BY seq, coalesce(body, '')), '|') AS comments,
  coalesce(array_to_string(list_sort(list(DISTINCT lower(author)) FILTER (WHERE author <> '')), '|'), '') AS authors FROM posts GROUP BY thread_id""",
    "post_user_left_join": f"""WITH {_POSTS}, users AS (SELECT author, count(*) AS threads FROM (SELECT unnest(authors) AS author FROM rows_) WHERE author <> '' AND author NOT LIKE '%zz' GROUP BY author)
SELECT u.threads IS NOT NULL AS known, count(*) AS posts, CAST(coalesce(sum(u.threads), 0) AS BIGINT) AS threads FROM posts p LEFT JOIN users u ON p.author = u.author GROUP BY 1""",
    "posts_topics_inner_join": "SELECT t.tid, count(*) AS pairs, max(n.title) AS title FROM dark_texts t JOIN nulled n ON t.tid = n.tid WHERE t.forum = 'nulled' GROUP BY t.tid",
    "title_full_outer": """WITH l AS (SELECT tid, count(*) AS lines FROM dark_texts WHERE forum = 'darkode' GROUP BY tid), t AS (SELECT tid, max(title) AS title FROM darkode GROUP BY tid)
SELECT coalesce(l.tid, t.tid) AS tid, lines, title FROM l FULL OUTER JOIN t ON l.tid = t.tid""",
    "upsert_latest": """WITH r AS (SELECT 'nulled' AS forum, row_id, tid, fetched_at, title FROM nulled UNION ALL SELECT 'hackforums', row_id, tid, fetched_at, title FROM hackforums UNION ALL SELECT 'darkode', row_id, tid, fetched_at, title FROM darkode)
SELECT forum || ':' || tid AS key, row_id, title FROM r WHERE tid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY forum, tid ORDER BY fetched_at DESC NULLS LAST, row_id DESC) = 1""",
    "upsert_by_url": "SELECT url, row_id, title FROM reddit WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC NULLS LAST, row_id DESC) = 1",
    "page_filter": """WITH r AS (SELECT 'reddit' AS forum, row_id, url FROM reddit UNION ALL SELECT 'silkroad_fts', row_id, url FROM silkroad_fts)
SELECT forum, row_id, starts_with(url, 'http') AS prefixed, url NOT LIKE '%page%' AS no_paging FROM r WHERE starts_with(url, 'http') OR url NOT LIKE '%page%'""",
    "search_index": f"""SELECT DISTINCT token, row_id, comment_ix FROM (SELECT row_id, comment_ix, unnest({_tokens('c')}) AS token
  FROM (SELECT row_id, CAST(generate_subscripts(comments, 1) - 1 AS BIGINT) AS comment_ix, unnest(comments) AS c FROM ({' UNION ALL '.join(f'SELECT row_id, comments FROM {f}' for f in FORUMS)})))""",
    "sentence_search": f"""WITH words AS (SELECT word FROM goodbad_vocab WHERE word IS NOT NULL GROUP BY word HAVING sum(bcn) > 0),
lines AS (SELECT forum, unnest(string_split(c, chr(10))) AS line FROM ({_ALL})), tokens AS (SELECT DISTINCT forum, line, unnest({_tokens('line')}) AS word FROM lines)
SELECT word, forum, count(DISTINCT line) AS lines FROM tokens SEMI JOIN words USING (word) GROUP BY word, forum""",
    "board_pages": """SELECT row_id, coalesce(title, '') AS title, CAST(generate_subscripts(r, 1) - 1 AS BIGINT) AS ix, unnest(r) AS raw
FROM (SELECT row_id, title, list_filter(raw_comments, lambda c: c IS NOT NULL) AS r FROM hackforums WHERE raw_comments IS NOT NULL)""",
}

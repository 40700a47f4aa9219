"""Text expressions on columns: masks, tokenizers, recipes. All of them stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three mask patterns and their tokens.
URL = (
    r"(?i)\b([a-z]{3,7}://)((([a-zA-Z*]|[a-zA-Z*][*a-zA-Z0-9\-]*[a-zA-Z0-9])\.)+([A-Za-z]|[A-Za-z][A-Za-z0-9\-]*[A-Za-z0-9])"
    r"(\/([^\s\[\]\(\)\{\}'\"]*)[a-zA-Z0-9/=])?|(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
    r"(\/[^\s\[\]\(\)\{\}'\"]*[a-zA-Z0-9/=])?)\/?(\b|\s)"
)
EMAIL = r"(?i)\b[a-zA-Z0-9][a-zA-Z0-9._-]+\s*@\s*(([a-zA-Z][a-zA-Z0-9\-]*[a-zA-Z0-9]|[a-zA-Z])\.)+([A-Za-z][A-Za-z0-9\-]*[A-Za-z0-9]|[A-Za-z])\b"
HASH = r"(?i)\b[a-fA-F\d]{32}\b|\b[a-fA-F\d]{40}\b|\b[a-fA-F\d]{64}\b"
EMAIL_TOKEN, URL_TOKEN, HASH_TOKEN, AUTHOR_TOKEN = "EMAIL__TOKEN ", "URL__TOKEN ", "HASH__TOKEN ", "AUTHOR__TOKEN"
CODE_SIGNS = '(){}[].;"'
# English stopwords.
STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself it it's its itself they them "
    "their theirs themselves what which who whom this that that'll these those am is are was were be been being have has had having do does did doing a an the and but if or because "
    "as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y "
    "ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn "
    "shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()


def mask(text: Column) -> Column:
    """E-mail addresses, URLs and hex digests replaced by their tokens, in this order."""
    text = F.regexp_replace(text, EMAIL, EMAIL_TOKEN)
    text = F.regexp_replace(text, URL, URL_TOKEN)
    return F.regexp_replace(text, HASH, HASH_TOKEN)


@lru_cache(maxsize=1)
def accent_map() -> tuple[str, str]:
    """Characters that lose a mark, and what remains: those whose decomposition without marks is one other character."""
    plain, marked = [], []
    for code in range(0x80, 0x10000):
        c = chr(code)
        if 0xD800 <= code < 0xE000:
            continue
        bare = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"))
        if bare != c and len(bare) == 1:
            marked.append(c)
            plain.append(bare)
    return "".join(marked), "".join(plain)


def deaccent(text: Column) -> Column:
    """Decomposed marks removed. Hangul and others that only decompose stay as they are."""
    marked, plain = accent_map()
    return F.regexp_replace(F.translate(text, marked, plain), r"\p{Mn}", "")


def alphabetic_tokens(text: Column) -> Column:
    """Maximal runs of word characters that are no decimal digits."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{Nl}\p{No}_]+)"), F.lit(1))


def word_tokens(text: Column) -> Column:
    """Maximal runs of word characters and hyphens."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_-]+)"), F.lit(1))


def blank_tokens(text: Column) -> Column:
    """Tokens between white space; none for a blank text."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def not_stopword(token: Column) -> Column:
    return ~token.isin(STOPWORDS)


def strip_edges(token: Column, signs: str = "-_ ") -> Column:
    return F.trim(token, F.lit(signs))


def pure_tokens(title: Column, comments: Column, authors: Column) -> Column:
    """Tokens of the full recipe: masked, deaccented, author names replaced, stopwords out, edges stripped.

    Null titles, comments and authors count as empty.
    """
    flat = F.array_join(F.transform(comments, lambda c: F.replace(c, F.lit("\n"), F.lit(" "))), "\n")
    raw = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(flat, F.lit(""))))
    names = F.coalesce(authors, F.array().cast("array<string>"))
    tokens = F.transform(alphabetic_tokens(deaccent(mask(raw))), lambda t: F.when(F.coalesce(F.array_contains(names, t), F.lit(False)), F.lit(AUTHOR_TOKEN)).otherwise(t))
    kept = F.transform(F.filter(tokens, not_stopword), lambda t: strip_edges(t, "_ "))
    return F.filter(kept, lambda t: t != "")


def simple_tokens(title: Column, comments: Column) -> Column:
    """Title and comments in one line, lower-cased, deaccented, stopwords out."""
    flat = F.replace(F.array_join(comments, " "), F.lit("\n"), F.lit(" "))
    raw = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(flat, F.lit(""))))
    return F.filter(alphabetic_tokens(deaccent(raw)), not_stopword)


def kept_comment(comment: Column, ix: Column) -> Column:
    """The first two comments, and later ones of at least 20 characters (trimmed)."""
    return (ix <= 1) | (F.length(F.trim(comment)) >= 20)


def split_rule(paragraph: Column) -> Column:
    """Sentences of one line: a break after end marks that white space follows."""
    return F.split(F.regexp_replace(paragraph, r"([.!?])\s+", "$1\n"), "\n")


def sentence_tokens(comments: Column) -> Column:
    """For every comment its sentences as arrays of tokens; comments that are too short are null.

    Lower-cased and masked; tokens of more than one character that are not all digits; stopwords out
    before the edges are stripped, so ``-the-`` survives as ``the``; empty sentences out.
    """

    def tokens(sentence: Column) -> Column:
        found = F.filter(word_tokens(deaccent(sentence)), lambda t: ~t.rlike(r"^\p{Nd}+$") & (F.length(t) > 1) & not_stopword(t))
        return F.filter(F.transform(found, lambda t: strip_edges(t)), lambda t: t != "")

    def one(comment: Column, ix: Column) -> Column:
        lines = F.split(mask(F.lower(F.trim(comment))), r"[\n\r\x0B\f\x1C-\x1E\x85  ]")
        sentences = F.flatten(F.transform(lines, split_rule))
        return F.when(kept_comment(comment, ix), F.filter(F.transform(sentences, tokens), lambda s: F.size(s) > 0))

    return F.transform(comments, one)


def code_share(text: Column) -> Column:
    """Share of characters that are signs of code; null for empty texts."""
    return F.try_divide(F.length(F.regexp_replace(text, r"[^(){}\[\].;\"]", "")).cast("double"), F.length(text).cast("double"))


def prose(comments: Column) -> Column:
    """Masked comments that are long enough and not code, joined; case is kept."""
    masked = F.transform(F.filter(comments, lambda c, i: c.isNotNull() & kept_comment(c, i)), lambda c: mask(F.trim(c)))
    return F.array_join(F.filter(masked, lambda c: ~((F.length(c) > 200) & (code_share(c) > 0.05))), ".\n\n")


def cut_between(text: Column, start: str, end: str) -> Column:
    """What stands from each start marker to the first end marker after it is cut; without an end marker the piece stays."""
    pieces = F.split(text, F.lit(r"\Q" + start + r"\E"))
    return F.array_join(F.transform(pieces, lambda p: F.when(F.instr(p, end) > 0, F.substring(p, F.instr(p, end) + F.lit(len(end)), F.length(p))).otherwise(p)), " ")


PGP = [(f"begin pgp {what}", f" end pgp {what}") for what in ("public key block", "private key block", "message")]


def without_pgp(text: Column) -> Column:
    """Bodies of PGP keys and messages cut out."""
    for start, end in PGP:
        text = F.when(F.contains(text, F.lit(start)), cut_between(text, start, end)).otherwise(text)
    return F.trim(text)


def span(text: Column, start: Column, end: Column) -> Column:
    """``text[start:end]``, trimmed and lower-cased."""
    return F.lower(F.trim(F.substring(text, start + 1, end - start)))


def content_hash(title: Column, comments: Column) -> Column:
    """MD5 of a canonical form of a thread: title and comments, divided by the unit separator."""
    return F.md5(F.concat_ws("\x1f", F.coalesce(title, F.lit("")), F.array_join(comments, "\x1f", "")).cast("binary"))


def letters_only(text: Column) -> Column:
    """Quotes unified, everything but ASCII letters, digits, quotes and underscores blank, lower case."""
    text = F.translate(F.lower(text), "’‘`", "'''")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9_' ]", " "), " +", " "))


def spaced_punctuation(text: Column) -> Column:
    """Lower case, punctuation set off by blanks, digits blanked."""
    text = F.translate(F.lower(text), "’‘`", "'''")
    text = F.regexp_replace(text, r"([.,()!?;:\"/])", " $1 ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[0-9]", " "), r"\s+", " "))


def wiki_text(text: Column) -> Column:
    """Wiki markup taken away: comments, references, tables, templates, tags, links to their labels, emphasis."""
    for pattern, to in WIKI_RULES:
        text = F.regexp_replace(text, pattern, to)
    return F.trim(F.regexp_replace(text, r"\s+", " "))


WIKI_RULES = [
    (r"(?s)<!--.*?-->", ""),
    (r"(?s)<ref[^>]*>[^<]*</ref>", ""),
    (r"(?s)\{\|[^{}]*\|\}", ""),
    (r"\{\{[^{}]*\}\}", ""),
    (r"<[^<>]*>", " "),
    (r"\[\[[^\[\]|]*\|([^\[\]|]*)\]\]", "$1"),
    (r"\[\[([^\[\]|]*)\]\]", "$1"),
    (r"\[https?://[^ \]]* ([^\[\]]*)\]", "$1"),
    (r"'''?", ""),
    (r"(?m)^[=*#:;]+ *|=+ *$", ""),
    (r"&lt;", "<"), (r"&gt;", ">"), (r"&nbsp;", " "), (r"&amp;", "&"),
]


def clamped_sigmoid(x: Column, limit: float = 6.0, bins: int = 1000) -> Column:
    """The logistic function as a table of ``bins`` steps on [-limit, limit] gives it."""
    ix = F.floor((x + limit) * (bins / limit / 2))
    y = F.exp((ix / bins * 2 - 1) * limit)
    return F.when(x > limit, 1.0).when(x < -limit, 0.0).otherwise(y / (y + 1))



"""Registered queries over text: ranking, term statistics, sentences and passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import folds
from ..operators import lexical as L
from ..runtime import table

QUERY = ["the", "tion", "erat", "method", "data", "the"]
TERMS = ["the", "of", "ening", "onth"]
STOP = ["the", "and", "of", "to", "in", "de", "la", "le", "der", "die"]
DOCS = "documents"

TOKENS = "list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '')"


def tokens(c: str = "text") -> str:
    return TOKENS.format(c)


def _documents(spark, sf_dir):
    return table(spark, sf_dir, DOCS)


def bm25_topk(spark, sf_dir):
    scored = L.okapi(_documents(spark, sf_dir), "doc_id", X.search_tokens(F.col("text")), QUERY)
    best = scored.orderBy(F.round("score", 9).desc(), "doc").limit(20)
    return best.select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


def okapi_sql(rows: str, query: list[str], key: str, part: str = "") -> str:
    """Scores by BM25 of the relation ``rows`` (part, key, toks)."""
    p = f"{part}, " if part else ""
    on = f"USING ({part})" if part else "ON true"
    terms = ", ".join(f"('{t}', {query.count(t)})" for t in dict.fromkeys(query))
    return f"""
size AS (SELECT {p}count(*) AS n, avg(len(toks)) AS a FROM {rows} {f'GROUP BY {part}' if part else ''}),
freq AS (SELECT {p}term, count(*) AS df FROM (SELECT {p}unnest(list_distinct(toks)) AS term FROM {rows}) GROUP BY ALL),
raw AS (SELECT {p}term, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM freq JOIN size {on}),
flo AS (SELECT {p}avg(raw) * 0.25 AS f FROM raw {f'GROUP BY {part}' if part else ''}),
idf AS (SELECT {p}term, CASE WHEN raw < 0 THEN f ELSE raw END AS idf FROM raw JOIN flo {on}),
wanted(term, times) AS (VALUES {terms}),
tfs AS (SELECT {p}{key}, len(toks) AS dl, term, times, len(list_filter(toks, lambda t: t = term)) AS tf FROM {rows}, wanted),
scored AS (
  SELECT {p}{key}, coalesce(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 0) AS score
  FROM tfs JOIN size {on} LEFT JOIN idf USING ({p}term) GROUP BY ALL)"""


BM25_TOPK = f"""
WITH d AS (SELECT doc_id, {tokens()} AS toks FROM documents), {okapi_sql('d', QUERY, 'doc_id')}
SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY round(score, 9) DESC, doc_id LIMIT 20
"""


def idf_table(spark, sf_dir):
    return L.idf_table(_documents(spark, sf_dir), "doc_id", X.search_tokens(F.col("text"))).select("term", "df", F.round("idf", 6).alias("idf"))


IDF = f"""
WITH t AS (SELECT unnest(list_distinct({tokens()})) AS term FROM documents)
SELECT term, count(*) AS df, round(ln((n - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf
FROM t, (SELECT count(*) AS n FROM documents) GROUP BY term, n
"""


def tfidf_top_terms(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    weights = L.tfidf(L.postings(docs, "doc_id", X.search_tokens(F.col("text"))), docs.count())
    best = L.top(weights, ["doc"], [F.round("weight", 9).desc(), F.col("term")], 5)
    return best.select(F.col("doc").alias("doc_id"), "term", F.round("weight", 6).alias("weight"), "rank")


TFIDF = f"""
WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tokens()}) AS term FROM documents) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT doc_id, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM p JOIN f USING (term), (SELECT count(*) AS n FROM documents)),
u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS u FROM w)
SELECT doc_id, term, round(u, 6) AS weight, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(u, 9) DESC, term) AS rank FROM u) WHERE rank <= 5
"""


def ctfidf_lang(spark, sf_dir):
    posted = L.postings(_documents(spark, sf_dir), "lang", X.search_tokens(F.col("text"))).withColumnRenamed("doc", "class")
    return L.ctfidf(posted).select(F.col("class").alias("lang"), "term", F.round("score", 6).alias("score"), "rank")


CTFIDF = f"""
WITH t AS (SELECT lang, term, count(*) AS tf FROM (SELECT lang, unnest({tokens()}) AS term FROM documents) GROUP BY ALL),
c AS (SELECT lang, sum(tf) AS of_class FROM t GROUP BY lang),
m AS (SELECT term, sum(tf) AS of_term, count(*) AS df FROM t GROUP BY term),
s AS (SELECT lang, term, tf / of_class * ln(1 + classes / df) * everything / of_term AS score
      FROM t JOIN c USING (lang) JOIN m USING (term), (SELECT sum(of_class) AS everything, count(*) AS classes FROM c))
SELECT lang, term, round(score, 6) AS score, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(score, 9) DESC, term) AS rank FROM s) WHERE rank <= 12
"""


def function_words(spark, sf_dir):
    return L.function_words(L.postings(_documents(spark, sf_dir), "lang", X.letter_tokens(F.col("text"))))


FUNCTION_WORDS = """
SELECT term, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(text, '\\p{L}+'))) AS term FROM documents)
GROUP BY term ORDER BY n DESC, term LIMIT 40
"""


def lexical_cosine(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    posted = L.postings(docs, "doc_id", X.search_tokens(F.col("text")))
    pairs = docs.select(F.col("doc_id").alias("left"), (F.col("doc_id") + 1).alias("right"))
    pairs = pairs.join(docs.select(F.col("doc_id").alias("right")), "right", "left_semi")
    return L.lexical_cosine(posted, posted, pairs).select("left", "right", F.round("cosine", 6).alias("cosine"))


COSINE = f"""
WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tokens()}) AS term FROM documents) GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(tf * tf)) AS norm FROM p GROUP BY doc_id),
x AS (SELECT a.doc_id AS l, sum(a.tf * b.tf) AS dot FROM p a JOIN p b ON b.doc_id = a.doc_id + 1 AND a.term = b.term GROUP BY l)
SELECT d.doc_id AS "left", d.doc_id + 1 AS "right", round(coalesce(dot / (na.norm * nb.norm), 0), 6) AS cosine
FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1 LEFT JOIN x ON x.l = d.doc_id
     LEFT JOIN n na ON na.doc_id = d.doc_id LEFT JOIN n nb ON nb.doc_id = d.doc_id + 1
"""


def _fields():
    lines = F.split("text", "\n")
    return {"title": X.search_tokens(F.get(lines, F.lit(0))), "literature": X.search_tokens(F.array_join(F.slice(lines, 2, 3), " "))}


def _summaries(docs, query):
    return L.weighted(docs, "doc_id", _fields(), query, L.FIELD_WEIGHTS)


def _bodies(docs, query):
    return L.weighted(docs, "doc_id", {"body": X.search_tokens(F.col("text"))}, query, {})


def weighted_sql(name: str, fields: dict[str, str], query: list[str], weights: dict[str, float]) -> str:
    """CTEs that end in ``name`` (doc_id, score), by fielded BM25."""
    cols = ", ".join(f"{sql} AS f{k}" for k, sql in enumerate(fields.values()))
    length = " + ".join(f"len(f{k})" for k in range(len(fields)))
    hits = lambda k, t: f"len(list_filter(f{k}, lambda x: x = '{t}'))"
    tfs = ", ".join(
        " + ".join(f"{weights.get(f, 1.0)} * {hits(k, t)}" for k, f in enumerate(fields)) + f" AS t{q}" for q, t in enumerate(query)
    )
    dfs = ", ".join(f"count(*) FILTER (t{q} > 0) AS d{q}" for q in range(len(query)))
    part = " + ".join(
        f"(CASE WHEN ln((n - d{q} + 0.5) / (d{q} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d{q} + 0.5) / (d{q} + 0.5)) END) * t{q} * 2.2 / (t{q} + 1.2 * (0.25 + 0.75 * dl / a))"
        for q in range(len(query))
    )
    every = " AND ".join(f"t{q} > 0" for q in range(len(query)))
    return f"""
{name}_f AS (SELECT doc_id, {cols} FROM documents),
{name}_t AS (SELECT doc_id, {length} AS dl, {tfs} FROM {name}_f),
{name}_s AS (SELECT count(*) AS n, avg(dl) AS a, {dfs} FROM {name}_t),
{name} AS (SELECT doc_id, -({part}) AS score FROM {name}_t, {name}_s WHERE {every})"""


FIELDS_SQL = {
    "title": tokens("string_split(text, chr(10))[1]"),
    "literature": tokens("array_to_string(string_split(text, chr(10))[2:4], ' ')"),
}
SEARCH = ["the", "of"]


def bm25_weighted_fields(spark, sf_dir):
    return _summaries(_documents(spark, sf_dir), SEARCH).select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


WEIGHTED = f"WITH {weighted_sql('s', FIELDS_SQL, SEARCH, L.FIELD_WEIGHTS)} SELECT doc_id, round(score, 6) AS score FROM s"


def _found(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return L.two_tier(_summaries(docs, SEARCH), _bodies(docs, SEARCH))


def search_two_tier(spark, sf_dir):
    return L.page_of(_found(spark, sf_dir), 20).select(F.col("doc").alias("doc_id"), "tier", F.round("score", 6).alias("score"))


def search_page(spark, sf_dir):
    return L.page_of(_found(spark, sf_dir), 20, 40).select(F.col("doc").alias("doc_id"), "tier", F.round("score", 6).alias("score"))


def search_count(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    both = _summaries(docs, SEARCH).select("doc").union(_bodies(docs, SEARCH).select("doc"))
    return both.distinct().agg(F.count(F.lit(1)).alias("n"))


_TIERS = f"""
WITH {weighted_sql('s', FIELDS_SQL, SEARCH, L.FIELD_WEIGHTS)}, {weighted_sql('b', {"body": tokens()}, SEARCH, {})},
found AS (SELECT doc_id, 0 AS tier, score FROM s UNION ALL SELECT doc_id, 1, score FROM b WHERE doc_id NOT IN (SELECT doc_id FROM s))
"""
TWO_TIER = _TIERS + "SELECT doc_id, tier, round(score, 6) AS score FROM found ORDER BY tier, round(score, 9), doc_id LIMIT 20"
PAGE = TWO_TIER + " OFFSET 40"
COUNT = _TIERS + "SELECT count(*) AS n FROM (SELECT doc_id FROM s UNION SELECT doc_id FROM b)"


def search_browse(spark, sf_dir):
    title = X.title_from_text(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", title.alias("title")).orderBy("title", "doc_id").limit(20)


BROWSE = """
SELECT doc_id, trim(ltrim(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13))), lambda l: l <> '')[1], '#')) AS title
FROM documents ORDER BY title, doc_id LIMIT 20
"""


def search_snippets(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", F.explode(F.array(X.search_tokens(F.col("text")))).alias("toks"))
    hits = docs.filter(F.arrays_overlap("toks", F.array(*map(F.lit, SEARCH))))
    return hits.select("doc_id", L.snippet(F.col("toks"), SEARCH).alias("snippet"))


SNIPPETS = f"""
WITH t AS (SELECT doc_id, {tokens()} AS toks FROM documents),
h AS (SELECT *, greatest(len(toks) - 12, 0) AS last FROM t WHERE list_has_any(toks, ['the', 'of'])),
w AS (SELECT *, unnest(range(last + 1)) AS s FROM h),
n AS (SELECT *, len(list_filter(toks[s + 1 : s + 12], lambda t: t IN ('the', 'of'))) AS hits FROM w),
b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, s) = 1)
SELECT doc_id, (CASE WHEN s > 0 THEN '... ' ELSE '' END) ||
  array_to_string(list_transform(toks[s + 1 : s + 12], lambda t: CASE WHEN t IN ('the', 'of') THEN '[' || t || ']' ELSE t END), ' ') ||
  (CASE WHEN s < last THEN ' ...' ELSE '' END) AS snippet
FROM b
"""

SENTENCES_SQL = "list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])[\\s\\x0B]+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"


def sentences(spark, sf_dir):
    return L.sentence_rows(_documents(spark, sf_dir), "doc_id", X.sentences(F.col("text"))).select(F.col("doc").alias("doc_id"), "pos", "sentence")


SENTENCES = f"""
SELECT doc_id, (unnest(range(len(s))))::INT AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {SENTENCES_SQL.format('text')} AS s FROM documents)
"""


def sentence_noise(spark, sf_dir):
    rows = L.sentence_rows(_documents(spark, sf_dir), "doc_id", X.sentences(F.col("text")))
    return rows.groupBy(F.col("doc").alias("doc_id")).agg(F.count(F.lit(1)).alias("sentences"), F.count_if(X.looks_noisy(F.col("sentence"))).alias("noisy"))


NOISY_SQL = """(NOT regexp_matches({0}, '^\\p{{Lu}}') OR NOT regexp_matches({0}, '[.!?"''”’]$')
  OR (length({0}) - length(regexp_replace({0}, '\\p{{Nd}}', '', 'g'))) / length({0}) > 0.06 OR regexp_matches({0}, '\\b\\d{{4}}\\.\\d{{1,3}}\\b')
  OR regexp_matches({0}, '\\bInterviews?\\b') OR len(regexp_extract_all({0}, '\\b(?:19|20)\\d\\d\\b')) >= 3)"""
NOISE = f"""
WITH s AS (SELECT doc_id, unnest({SENTENCES_SQL.format('text')}) AS s FROM documents)
SELECT doc_id, count(*) AS sentences, count(*) FILTER ({NOISY_SQL.format('s')}) AS noisy FROM s GROUP BY doc_id
"""


def central_sentence(spark, sf_dir):
    return L.central_sentences(_documents(spark, sf_dir), "doc_id", F.col("text"), STOP).select(F.col("doc").alias("doc_id"), "pos", "sentence")


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP)
CENTRAL = f"""
WITH s AS (SELECT doc_id, unnest(range(len(s)))::INT AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {SENTENCES_SQL.format('text')} AS s FROM documents)),
t AS (SELECT doc_id, pos, unnest(regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM s),
p AS (SELECT doc_id, pos, term, count(*) AS tf FROM t WHERE length(term) > 1 AND term NOT IN ({_STOP_SQL}) GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT doc_id, term, count(*) AS df FROM p GROUP BY ALL),
w AS (SELECT doc_id, pos, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM p JOIN f USING (doc_id, term) JOIN n USING (doc_id)),
u AS (SELECT doc_id, pos, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, pos)) AS u FROM w),
c AS (SELECT doc_id, pos, sum(u * everything) AS c FROM (SELECT *, sum(u) OVER (PARTITION BY doc_id, term) AS everything FROM u) GROUP BY ALL)
SELECT doc_id, pos, sentence FROM s LEFT JOIN c USING (doc_id, pos)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(coalesce(c, 0), 9) DESC, pos) = 1
"""


def salient_sentences(spark, sf_dir):
    return L.salient(_documents(spark, sf_dir), "doc_id", F.col("text"), TERMS).select(F.col("doc").alias("doc_id"), "pos", "sentence", "rank")


_QUOTABLE_SQL = "list_transform(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+([A-Z0-9\"''(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> ''), lambda s: trim(regexp_replace(regexp_replace(s, '([a-z])-\\s*\\n\\s*([a-z])', '\\1\\2', 'g'), '\\s+', ' ', 'g')))"
SALIENT = f"""
WITH q AS (SELECT doc_id, list_filter({_QUOTABLE_SQL}, lambda s: len(string_split(s, ' ')) BETWEEN 8 AND 60 AND NOT {NOISY_SQL.format('s')}) AS s FROM documents),
r AS (SELECT doc_id, unnest(range(len(s)))::INT AS pos, unnest(s) AS sentence FROM q),
d AS (SELECT *, {tokens('sentence')} AS toks FROM r), {okapi_sql('d', TERMS, 'pos', 'doc_id')}
SELECT doc_id, pos, sentence, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN n > 12 THEN round(score, 9) END DESC, pos) AS rank
  FROM r JOIN scored USING (doc_id, pos) JOIN size USING (doc_id)) WHERE rank <= 12
"""


def word_count(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", X.word_count(F.col("text")).alias("words"))


WORD_COUNT = "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::INT AS words FROM documents"


def paragraphs_packed(spark, sf_dir):
    packed = folds.paragraphs(F.col("text"), block_break="\n")
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(packed).alias("pos", "paragraph"))


def passages_truncated(spark, sf_dir):
    cut = folds.passages(F.col("text"), block_break="\n")
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(cut).alias("pos", "passage"))


#: A running buffer as a recursive CTE over a document's lines; {join} stands between two blocks.
PACK_SQL = """
WITH RECURSIVE b AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13))), lambda l: l <> '') AS l FROM documents),
w AS (
  SELECT doc_id, l, 0 AS i, '' AS buf, NULL::VARCHAR AS done FROM b
  UNION ALL
  SELECT doc_id, l, i + 1,
    CASE WHEN length(CASE WHEN buf = '' THEN l[i + 1] ELSE buf || {join} || l[i + 1] END) >= 200 THEN '' ELSE CASE WHEN buf = '' THEN l[i + 1] ELSE buf || {join} || l[i + 1] END END,
    CASE WHEN length(CASE WHEN buf = '' THEN l[i + 1] ELSE buf || {join} || l[i + 1] END) >= 200 THEN CASE WHEN buf = '' THEN l[i + 1] ELSE buf || {join} || l[i + 1] END END
  FROM w WHERE i < len(l)),
made AS (
  SELECT doc_id, i, done AS t, true AS full_ FROM w WHERE done IS NOT NULL
  UNION ALL SELECT doc_id, i + 1, buf, false FROM w WHERE i = len(l) AND buf <> '')
"""
PASSAGES = PACK_SQL.format(join="chr(10) || chr(10)") + """
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS pos, CASE WHEN full_ THEN substr(t, 1, 1500) ELSE t END AS passage FROM made
"""


def selected_passages(spark, sf_dir):
    kept = L.select_passages(_documents(spark, sf_dir), "doc_id", folds.passages(F.col("text"), block_break="\n"), TERMS)
    return kept.select(F.col("doc").alias("doc_id"), "pos", "passage")


SELECTED = PACK_SQL.format(join="chr(10) || chr(10)") + f""",
r AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS pos, CASE WHEN full_ THEN substr(t, 1, 1500) ELSE t END AS passage FROM made),
d AS (SELECT *, {tokens('passage')} AS toks FROM r), {okapi_sql('d', TERMS, 'pos', 'doc_id')}
SELECT doc_id, pos, passage FROM r JOIN scored USING (doc_id, pos)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, pos) <= 12
"""

FILLERS = folds.QUALITY_FILLERS


def filler_check(spark, sf_dir):
    return folds.quality_issues(_documents(spark, sf_dir), "doc_id", F.col("text")).select(F.col("doc").alias("doc_id"), "pos", "type", "detail")


_FILLER_SQL = ", ".join(f"('{f}')" for f in FILLERS)
FILLER_CHECK = f"""
WITH s AS (SELECT doc_id, unnest(range(len(s)))::INT AS pos, unnest(s) AS s FROM (
  SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents)),
c AS (SELECT *, len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '')) AS n FROM s)
SELECT doc_id, pos, 'long_sentence' AS type, n || ' words' AS detail FROM c WHERE n > 45
UNION ALL SELECT doc_id, pos, 'filler', f FROM c, (VALUES {_FILLER_SQL}) AS t(f) WHERE contains(lower(s), f)
"""

QUERIES = {
    "bm25_topk": (bm25_topk, BM25_TOPK),
    "idf_table": (idf_table, IDF),
    "tfidf_top_terms": (tfidf_top_terms, TFIDF),
    "ctfidf_lang": (ctfidf_lang, CTFIDF),
    "function_words": (function_words, FUNCTION_WORDS),
    "lexical_cosine": (lexical_cosine, COSINE),
    "bm25_weighted_fields": (bm25_weighted_fields, WEIGHTED),
    "search_two_tier": (search_two_tier, TWO_TIER),
    "search_page": (search_page, PAGE),
    "search_count": (search_count, COUNT),
    "search_browse": (search_browse, BROWSE),
    "search_snippets": (search_snippets, SNIPPETS),
    "sentences": (sentences, SENTENCES),
    "sentence_noise": (sentence_noise, NOISE),
    "central_sentence": (central_sentence, CENTRAL),
    "salient_sentences": (salient_sentences, SALIENT),
    "word_count": (word_count, WORD_COUNT),
    "paragraphs_packed": (paragraphs_packed, None),
    "passages_truncated": (passages_truncated, PASSAGES),
    "selected_passages": (selected_passages, SELECTED),
    "filler_check": (filler_check, FILLER_CHECK),
}

"""Postings, ranking and term statistics in long form.

``postings`` is the one table everything else starts from: (doc, term, tf), partitioned by whatever the next shuffle
needs. Statistics are map-combined aggregates; a query's terms are a literal list, so their postings are filtered before
any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..runtime import cut

# The ranking libraries' defaults and the field weights.
OKAPI_K1, OKAPI_B, OKAPI_EPSILON = 1.5, 0.75, 0.25
FTS_K1, FTS_B = 1.2, 0.75
FIELD_WEIGHTS = {"title": 5.0, "authors_raw": 2.0}
RRF_K = 60
# End of fixed values.


def postings(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """doc, term, tf."""
    return (
        docs.select(F.col(id_col).alias("doc"), F.explode(tokens).alias("term"))
        .groupBy("doc", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf_table(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """term, df, idf = ln((N - df + 0.5) / (df + 0.5))."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    distinct = docs.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return distinct.crossJoin(F.broadcast(n)).select("term", "df", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def okapi(docs: DataFrame, id_col: str, tokens: Column, query: list[str]) -> DataFrame:
    """doc, score of every document by BM25 with the mean-idf floor for terms in over half of them.

    A repeated query term counts repeatedly. Texts are tokenised twice: once into slim rows of the query's own term
    frequencies, which are kept, and once for the document frequencies of all terms, which the floor is the mean of.
    """
    terms = list(dict.fromkeys(query))
    base = docs.select(F.col(id_col).alias("doc"), tokens.alias("__tokens"))
    slim = cut(base.select("doc", F.size("__tokens").alias("__len"), *[_count("__tokens", t).alias(f"__tf{k}") for k, t in enumerate(terms)]))
    size = F.broadcast(slim.agg(F.count(F.lit(1)).alias("__n"), F.avg("__len").alias("__avg")))
    df = base.select(F.explode(F.array_distinct("__tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.join(size, F.lit(True)).select("term", F.log((F.col("__n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw"))
    # one row, as is the size
    weights = raw.agg((F.avg("raw") * OKAPI_EPSILON).alias("__floor"), *[F.max(F.when(F.col("term") == t, F.col("raw"))).alias(f"__raw{k}") for k, t in enumerate(terms)])
    scored = slim.join(size, F.lit(True)).join(F.broadcast(weights), F.lit(True))
    part, norm = F.lit(0.0), OKAPI_K1 * (1 - OKAPI_B + OKAPI_B * F.col("__len") / F.col("__avg"))
    for k, term in enumerate(terms):
        weight = F.when(F.col(f"__raw{k}") < 0, F.col("__floor")).otherwise(F.coalesce(f"__raw{k}", F.lit(0.0)))
        part = part + query.count(term) * weight * F.col(f"__tf{k}") * (OKAPI_K1 + 1) / (F.col(f"__tf{k}") + norm)
    return scored.select("doc", part.alias("score"))


def okapi_within(docs: DataFrame, tokens: str, query: list[str]) -> DataFrame:
    """The rows with ``scores``: BM25 of each token array in the row's array of them, by the statistics of that row alone.

    Nothing shuffles: a row's terms are sorted, and one pass over them gives the mean idf.
    """
    n, terms = F.nullif(F.size(tokens), F.lit(0)), list(dict.fromkeys(query))
    idf = lambda df: F.log((n - df + 0.5) / (df + 0.5))
    distinct = F.array_sort(F.flatten(F.transform(tokens, F.array_distinct)))
    start = F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).alias("df"), F.lit(0).alias("terms"), F.lit(0.0).alias("sum"))

    def step(state: Column, term: Column) -> Column:
        more = F.struct(term.alias("term"), (state["df"] + 1).alias("df"), state["terms"].alias("terms"), state["sum"].alias("sum"))
        new = F.struct(
            term.alias("term"), F.lit(1).alias("df"), (state["terms"] + 1).alias("terms"),
            (state["sum"] + F.when(state["df"] > 0, idf(state["df"])).otherwise(0.0)).alias("sum"),
        )
        return F.when(state["term"] == term, more).otherwise(new)

    done = lambda s: F.when(s["terms"] > 0, (s["sum"] + idf(s["df"])) / s["terms"])
    df = [F.size(F.filter(tokens, _holding(t))) for t in terms]
    weighed = docs.withColumns({
        "__avg": F.aggregate(tokens, F.lit(0), lambda a, x: a + F.size(x)) / n,
        "__floor": F.aggregate(distinct, start, step, done) * OKAPI_EPSILON,
        "__df": F.array(*df),
    })
    raw = [idf(F.col("__df")[k]) for k in range(len(terms))]
    weighed = weighed.withColumn("__idf", F.array(*[F.when(F.col("__df")[k] == 0, 0.0).when(r < 0, F.col("__floor")).otherwise(r) for k, r in enumerate(raw)]))

    def score(own: Column) -> Column:
        # a row without any token, as of a text in another script, has no mean length
        length = F.coalesce(F.size(own) / F.nullif(F.col("__avg"), F.lit(0.0)), F.lit(0.0))
        part, norm = F.lit(0.0), OKAPI_K1 * (1 - OKAPI_B + OKAPI_B * length)
        for k, term in enumerate(terms):
            tf = _count(own, term)
            part = part + query.count(term) * F.col("__idf")[k] * tf * (OKAPI_K1 + 1) / (tf + norm)
        return part

    return weighed.withColumn("scores", F.transform(tokens, score)).drop("__avg", "__floor", "__df", "__idf")


def _count(tokens: Column | str, term: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == term))


def _holding(term: str):
    return lambda tokens: F.array_contains(tokens, term)


def weighted(docs: DataFrame, id_col: str, fields: dict[str, Column], query: list[str], weights: dict[str, float]) -> DataFrame:
    """doc, score (lower is better) of the documents that hold every query term in some field: fielded BM25.

    Term frequency is the weighted sum over fields, length the number of tokens of all fields.
    """
    base = docs.select(F.col(id_col).alias("doc"), *[t.alias(f"__{f}") for f, t in fields.items()])
    base = base.withColumn("__len", sum((F.size(f"__{f}") for f in fields), F.lit(0)))
    for k, term in enumerate(query):
        base = base.withColumn(f"__tf{k}", sum((F.lit(weights.get(f, 1.0)) * _count(f"__{f}", term) for f in fields), F.lit(0.0)))
        base = base.withColumn(f"__has{k}", sum((_count(f"__{f}", term) for f in fields), F.lit(0)) > 0)
    # one pass over slim rows gives all statistics; the result is one row
    stats = base.agg(
        F.count(F.lit(1)).alias("__n"), F.avg("__len").alias("__avg"), *[F.count_if(f"__has{k}").alias(f"__df{k}") for k in range(len(query))]
    )
    every = F.lit(True)
    for k in range(len(query)):
        every = every & F.col(f"__has{k}")
    score = F.lit(0.0)
    for k in range(len(query)):
        raw = F.log((F.col("__n") - F.col(f"__df{k}") + 0.5) / (F.col(f"__df{k}") + 0.5))
        idf = F.when(raw <= 0, 1e-6).otherwise(raw)
        tf = F.col(f"__tf{k}")
        score = score - idf * tf * (FTS_K1 + 1) / (tf + FTS_K1 * (1 - FTS_B + FTS_B * F.col("__len") / F.col("__avg")))
    return base.filter(every).join(F.broadcast(stats), F.lit(True)).select("doc", score.alias("score"))


def two_tier(summaries: DataFrame, bodies: DataFrame) -> DataFrame:
    """doc, score, tier: summary hits first, then full-text hits that no summary has."""
    rest = bodies.join(summaries.select("doc"), "doc", "left_anti")
    return summaries.withColumn("tier", F.lit(0)).unionByName(rest.withColumn("tier", F.lit(1)))


def page_of(found: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return found.orderBy("tier", F.round("score", 9), "doc").offset(offset).limit(limit)


def snippet(tokens: Column, query: list[str], width: int = 12) -> Column:
    """The first window of ``width`` tokens with most hits, hits in brackets, dots where text is left out.

    Give a column, not an expression that makes the tokens: it is looked at once for each window.
    """
    hit = lambda t: t.isin(query)
    last = F.greatest(F.size(tokens) - width, F.lit(0))
    best = F.array_max(
        F.transform(F.sequence(F.lit(0), last), lambda s: F.struct(F.size(F.filter(F.slice(tokens, s + 1, width), hit)).alias("hits"), (-s).alias("at")))
    )
    at = -best["at"]
    words = F.transform(F.slice(tokens, at + 1, width), lambda t: F.when(hit(t), F.concat(F.lit("["), t, F.lit("]"))).otherwise(t))
    return F.concat(F.when(at > 0, "... ").otherwise(""), F.array_join(words, " "), F.when(at < last, " ...").otherwise(""))


def top(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def tfidf(posted: DataFrame, n_docs: int) -> DataFrame:
    """doc, term, weight = tf * (ln((1 + N) / (1 + df)) + 1), unit length per document."""
    df = document_frequency(posted)
    raw = posted.join(df, "term").withColumn("w", F.col("tf") * (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1))
    norm = raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "doc").select("doc", "term", (F.col("w") / F.col("norm")).alias("weight"))


def ctfidf(classes: DataFrame, k: int = 12) -> DataFrame:
    """class, term, score, rank of the most distinctive terms from (class, term, tf) rows."""
    tf = classes.groupBy("class", "term").agg(F.sum("tf").alias("tf"))
    total = tf.groupBy("class").agg(F.sum("tf").alias("of_class"))
    terms = tf.groupBy("term").agg(F.sum("tf").alias("of_term"), F.count(F.lit(1)).alias("df"))
    whole = total.agg(F.sum("of_class").alias("all"), F.count(F.lit(1)).alias("classes"))
    score = F.col("tf") / F.col("of_class") * F.log(1 + F.col("classes") / F.col("df")) * F.col("all") / F.col("of_term")
    scored = tf.join(total, "class").join(terms, "term").join(F.broadcast(whole), F.lit(True)).select("class", "term", score.alias("score"))
    return top(scored, ["class"], [F.round("score", 9).desc(), F.col("term")], k)


def function_words(posted: DataFrame, k: int = 40) -> DataFrame:
    """The k most frequent terms with their counts."""
    return posted.groupBy("term").agg(F.sum("tf").alias("n")).orderBy(F.col("n").desc(), "term").limit(k)


def lexical_cosine(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """left, right, cosine of the term counts of the pairs (left, right); 0 without a shared term."""
    norm = lambda p, name: p.groupBy("doc").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf")).cast("double")).alias(name))
    a = pairs.join(left.withColumnsRenamed({"doc": "left", "tf": "a"}), "left")
    dots = a.join(right.withColumnsRenamed({"doc": "right", "tf": "b"}), ["right", "term"]).groupBy("left", "right").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    return (
        pairs.join(dots, ["left", "right"], "left")
        .join(norm(left, "na").withColumnRenamed("doc", "left"), "left", "left")
        .join(norm(right, "nb").withColumnRenamed("doc", "right"), "right", "left")
        .select("left", "right", F.coalesce(F.col("dot") / (F.col("na") * F.col("nb")), F.lit(0.0)).alias("cosine"))
    )


def rrf(ranked: DataFrame, key: str = "doc", k: int = RRF_K) -> DataFrame:
    """key, score: sum of 1 / (k + rank) over (key, rank) rows, ranks from 1."""
    return ranked.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"))


def sentence_rows(docs: DataFrame, id_col: str, found: Column) -> DataFrame:
    """doc, pos, sentence."""
    return docs.select(F.col(id_col).alias("doc"), F.posexplode(found).alias("pos", "sentence"))


def central_sentences(docs: DataFrame, id_col: str, text: Column, stop_words: list[str]) -> DataFrame:
    """doc, pos, sentence: the one with the largest sum of TF-IDF similarities to the document's others.

    The row sums of X X' are each sentence's weights times the column sums, so no pair of sentences is formed. Terms are
    dealt by document once, and all sums are taken in that dealing.
    """
    rows = docs.select(F.col(id_col).alias("doc"), X.sentences(text).alias("sentences"))
    terms = F.filter(X.letter_or_digit_tokens(F.col("sentence")), lambda t: (F.length(t) > 1) & ~t.isin(stop_words))
    each = rows.select("doc", F.size("sentences").alias("n"), F.posexplode("sentences").alias("pos", "sentence"))
    posted = each.select("doc", "n", "pos", F.explode(terms).alias("term")).repartition("doc").groupBy("doc", "n", "pos", "term").agg(F.count(F.lit(1)).alias("tf"))
    by_term, by_sentence = Window.partitionBy("doc", "term"), Window.partitionBy("doc", "pos")
    weighed = posted.withColumn("w", F.col("tf") * (F.log((1.0 + F.col("n")) / (1.0 + F.count(F.lit(1)).over(by_term))) + 1))
    unit = weighed.withColumn("u", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(by_sentence)))
    central = unit.withColumn("all", F.sum("u").over(by_term)).groupBy("doc", "pos").agg(F.round(F.sum(F.col("u") * F.col("all")), 9).alias("centrality"))
    best = central.groupBy("doc").agg(F.max(F.struct("centrality", -F.col("pos"))).alias("best")).select("doc", (-F.col("best.col2")).alias("pos"))
    # a document whose sentences hold no term has its first one
    placed = rows.join(best, "doc", "left").withColumn("pos", F.coalesce("pos", F.lit(0)))
    return placed.select("doc", "pos", F.get("sentences", F.col("pos")).alias("sentence")).filter("sentence is not null")


def _ranked(rows: DataFrame, held: str, k: int) -> DataFrame:
    """The rows with ``order``: struct(minus rounded score, pos, rank) of each array element, best first, all in order if few."""
    n = F.size(held)
    scored = F.transform("scores", lambda s, i: F.struct(F.when(n > k, -F.round(s, 9)).otherwise(0.0).alias("by"), i.alias("pos")))
    order = F.transform(F.array_sort(scored), lambda x, i: F.struct(x["pos"].alias("pos"), (i + 1).alias("rank")))
    # explode of one array: a filter on the order, which Spark adds below a later explode, would work the scores out again
    return rows.select("doc", held, F.explode(F.array(order)).alias("order"))


def salient(docs: DataFrame, id_col: str, text: Column, terms: list[str], k: int = 12) -> DataFrame:
    """doc, pos, sentence, rank: a document's quotable sentences, all in order if few, else the best by BM25."""
    rows = docs.select(F.col(id_col).alias("doc"), F.explode(F.array(X.quotable(text))).alias("held"))
    rows = rows.select("doc", "held", F.explode(F.array(F.transform("held", X.search_tokens))).alias("tokens"))
    rows = okapi_within(rows, "tokens", terms)
    best = _ranked(rows, "held", k).select("doc", "held", F.explode(F.slice("order", 1, k)).alias("x"))
    return best.select("doc", "x.pos", F.get("held", F.col("x.pos")).alias("sentence"), "x.rank")


def select_passages(docs: DataFrame, id_col: str, passages: Column, terms: list[str], k: int = 12) -> DataFrame:
    """doc, pos, passage: all if few, else the best k by BM25 and every section opener, in document order (X11)."""
    # explode of one array keeps the fold over a text from being worked out again wherever its result is used
    rows = docs.select(F.col(id_col).alias("doc"), F.explode(F.array(passages)).alias("held"))
    rows = rows.select("doc", "held", F.explode(F.array(F.transform("held", X.search_tokens))).alias("tokens"))
    rows = okapi_within(rows, "tokens", terms)
    each = _ranked(rows, "held", k).select("doc", "held", F.explode("order").alias("x"))
    placed = each.select("doc", "x.pos", F.get("held", F.col("x.pos")).alias("passage"), "x.rank")
    return placed.filter((F.col("rank") <= k) | F.col("passage").rlike(X.KEPT_SECTION)).drop("rank")

"""Registered queries over label sequences and segmentations; users' events stand for papers' moves."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import folds, metrics
from ..operators import sequences as S
from ..runtime import table

TYPES = ["click", "view", "purchase", "login", "logout", "search", "signup", "cart"]
ROWS = "r AS (SELECT user_id AS base, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS label, value FROM events)"
ISLANDS = f"""{ROWS},
f AS (SELECT *, CASE WHEN lag(label) OVER o IS DISTINCT FROM label THEN 1 ELSE 0 END AS new FROM r WINDOW o AS (PARTITION BY base ORDER BY pos)),
g AS (SELECT *, sum(new) OVER (PARTITION BY base ORDER BY pos) AS run FROM f),
i AS (SELECT base, run::BIGINT AS run, label, min(pos) AS first, max(pos) AS last, count(*) AS n FROM g GROUP BY ALL)"""


def _rows(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("base"), (F.row_number().over(order) - 1).cast("long").alias("pos"), F.col("event_type").alias("label"), "value")


def _labels(spark, sf_dir):
    """The known labels: all types but the last in order, which stands for OTHER."""
    return [r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").collect()][:-1]


KNOWN = "k AS (SELECT DISTINCT label FROM r WHERE label < (SELECT max(label) FROM r))"


def islands_events(spark, sf_dir):
    return S.islands(_rows(spark, sf_dir))


def rle_events(spark, sf_dir):
    return S.run_length_text(_rows(spark, sf_dir))


RLE = f"WITH {ISLANDS} SELECT base, string_agg(CASE WHEN n > 1 THEN label || ' x' || n ELSE label END, ', ' ORDER BY run) AS runs FROM i GROUP BY base"


def move_distribution(spark, sf_dir):
    return S.distribution(_rows(spark, sf_dir), _labels(spark, sf_dir)).select("base", "label", F.round("share", 6).alias("share"))


DISTRIBUTION = f"""
WITH {ROWS}, {KNOWN}, n AS (SELECT base, label, count(*) AS n FROM r WHERE label IN (SELECT label FROM k) GROUP BY ALL)
SELECT base, label, round(n / sum(n) OVER (PARTITION BY base), 6) AS share FROM n
"""


def hellinger_nn(spark, sf_dir):
    rows, labels = _rows(spark, sf_dir), _labels(spark, sf_dir)
    stages = rows.filter("base % 50 = 1").select(F.concat(F.lit("s"), (F.col("base") % 100).cast("string")).alias("skeleton"), "label", F.col("value").alias("typical_share"))
    near = S.hellinger_nearest(S.distribution(rows, labels), S.skeleton_distribution(stages, labels), rows.select("base").distinct())
    return near.select("skeleton", "base", F.round("distance", 6).alias("distance"), "rank")


HELLINGER = f"""
WITH {ROWS}, {KNOWN}, n AS (SELECT base, label, count(*) AS n FROM r WHERE label IN (SELECT label FROM k) GROUP BY ALL),
p AS (SELECT base, label, n / sum(n) OVER (PARTITION BY base) AS share FROM n),
s0 AS (SELECT 's' || (base % 100) AS skeleton, label, sum(value) AS n FROM r WHERE base % 50 = 1 AND label IN (SELECT label FROM k) GROUP BY ALL),
s AS (SELECT skeleton, label, n / sum(n) OVER (PARTITION BY skeleton) AS share FROM s0 WHERE n > 0),
g AS (SELECT skeleton, base, label FROM (SELECT DISTINCT skeleton FROM s), (SELECT DISTINCT base FROM r), k),
d AS (SELECT g.skeleton, g.base, sqrt(sum((sqrt(coalesce(p.share, 0)) - sqrt(coalesce(s.share, 0))) ** 2)) AS distance
      FROM g LEFT JOIN p ON p.base = g.base AND p.label = g.label LEFT JOIN s ON s.skeleton = g.skeleton AND s.label = g.label GROUP BY ALL)
SELECT skeleton, base, round(distance, 6) AS distance, row_number() OVER (PARTITION BY skeleton ORDER BY round(distance, 6), base)::INT AS rank FROM d QUALIFY rank <= 20
"""


def length_band(spark, sf_dir):
    return S.length_band(S.islands(_rows(spark, sf_dir)).withColumn("third", F.col("base") % 30), ["label", "third"])


BAND = f"""
WITH {ISLANDS}, l AS (SELECT label, base % 30 AS third, list(n ORDER BY n) AS v, count(*) AS c FROM i GROUP BY ALL),
q AS (SELECT *, greatest(1, least(floor((c + 1) * 0.25)::BIGINT, c - 1)) AS a, greatest(1, least(floor((c + 1) * 0.75)::BIGINT, c - 1)) AS b FROM l)
SELECT label, third, CASE WHEN c < 4 THEN v[1] ELSE greatest(1, round_even(v[a] + ((c + 1) * 0.25 - a) * (v[a + 1] - v[a]), 0))::BIGINT END AS low,
  CASE WHEN c < 4 THEN v[c] ELSE greatest(1, round_even(v[b] + ((c + 1) * 0.75 - b) * (v[b + 1] - v[b]), 0))::BIGINT END AS high FROM q
"""


def monotone_stage(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    sections = F.array(*map(F.lit, [*S.SECTIONS, "unknown"]))
    picked = F.get(sections, F.pmod(F.floor(F.col("value")), F.lit(7)).cast("int"))
    return S.monotone(rows, picked).select("base", "pos", "assigned")


MONOTONE = f"""
WITH {ROWS}, m AS (SELECT base, pos, floor(value)::BIGINT % 7 AS s FROM r)
SELECT base, pos, max((CASE WHEN s = 6 THEN 3 ELSE s END)::INT) OVER (PARTITION BY base ORDER BY pos) AS assigned FROM m
"""


def move_sections(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("move")).unionByName(
        table(spark, sf_dir, "region").select(F.concat(F.lit("method - "), "r_name").alias("move"))
    ).select("move", S.section_of(F.col("move")).alias("section")).distinct()


SECTIONS_SQL = """
WITH m AS (SELECT event_type AS move FROM events UNION SELECT 'method - ' || r_name FROM region)
SELECT move, CASE WHEN move LIKE 'method%' THEN 'methods' ELSE 'findings' END AS section FROM m
"""


def runs_increasing(spark, sf_dir):
    order = F.array_sort(F.collect_list(F.struct("l_linenumber", F.when(F.col("l_quantity") > 5, F.col("l_quantity").cast("int")).alias("q"))))
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(order, lambda x: x["q"]).alias("nums"))
    runs = folds.increasing_runs(F.col("nums"))
    return lists.select("l_orderkey", F.size(runs).alias("runs"), F.size(folds.missing_numbers(F.col("nums"))).alias("missing"), F.round(folds.inversions(F.filter("nums", lambda x: x.isNotNull())), 6).alias("inversions"))


RUNS = """
WITH l AS (SELECT l_orderkey, l_quantity::INT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity::INT) AS pos FROM lineitem WHERE l_quantity > 5),
f AS (SELECT *, lag(q) OVER (PARTITION BY l_orderkey ORDER BY pos) AS before FROM l),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR q <= before THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY pos) AS run FROM f),
m AS (SELECT l_orderkey, run, list(q) AS qs, count(*) AS n, min(q) AS a, max(q) AS b FROM g GROUP BY ALL),
x AS (SELECT DISTINCT l_orderkey, unnest(list_filter(range(a, b + 1), lambda v: NOT list_contains(qs, v::INT))) AS v FROM m WHERE n >= 3)
SELECT o.l_orderkey, coalesce((SELECT max(run) FROM g WHERE g.l_orderkey = o.l_orderkey), 0)::INT AS runs,
  (SELECT count(*) FROM x WHERE x.l_orderkey = o.l_orderkey)::INT AS missing,
  round(coalesce((SELECT CASE WHEN count(*) < 2 THEN 0 ELSE count(*) FILTER (q < before) / (count(*) - 1) END FROM f WHERE f.l_orderkey = o.l_orderkey), 0), 6) AS inversions
FROM (SELECT DISTINCT l_orderkey FROM lineitem) o
"""


def batch_packing(spark, sf_dir):
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("s")))), lambda x: x["s"])
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(sizes.alias("sizes"))
    return lists.select("l_orderkey", F.posexplode(folds.pack_by_size(F.col("sizes"), 3, 60)).alias("pos", "batch"))


PACKING = """
WITH RECURSIVE l AS (SELECT l_orderkey, list(l_quantity::BIGINT ORDER BY l_linenumber, l_quantity::BIGINT) AS s FROM lineitem GROUP BY 1),
w AS (
  SELECT l_orderkey, s, 0 AS i, 0 AS batch, 0 AS n, 0::BIGINT AS sum FROM l
  UNION ALL
  SELECT l_orderkey, s, i + 1, batch + (CASE WHEN n > 0 AND (n >= 3 OR sum + s[i + 1] > 60) THEN 1 ELSE 0 END),
    CASE WHEN n > 0 AND (n >= 3 OR sum + s[i + 1] > 60) THEN 1 ELSE n + 1 END,
    CASE WHEN n > 0 AND (n >= 3 OR sum + s[i + 1] > 60) THEN s[i + 1] ELSE sum + s[i + 1] END
  FROM w WHERE i < len(s))
SELECT l_orderkey, (i - 1)::INT AS pos, batch FROM w WHERE i > 0
"""


def _segmentation(spark, sf_dir):
    """Gold and predicted line labels made from events."""
    rows = _rows(spark, sf_dir)
    gold = F.get(F.array(*map(F.lit, ["HEAD", "PARA", "CONT", "CONT", "LIST", "DROP"])), F.pmod(F.floor("value"), F.lit(6)).cast("int"))
    pred = F.get(F.array(*map(F.lit, ["PARA", "PARA", "CONT", "LIST", "LIST", "CONT"])), F.pmod(F.floor(F.col("value") + F.col("pos") % 2), F.lit(6)).cast("int"))
    return rows.select(F.col("base").alias("doc"), "pos", gold.alias("gold"), pred.alias("pred"))


SEG = f"""{ROWS},
s AS (SELECT base AS doc, pos, ['HEAD', 'PARA', 'CONT', 'CONT', 'LIST', 'DROP'][(floor(value)::BIGINT % 6) + 1] AS gold,
  ['PARA', 'PARA', 'CONT', 'LIST', 'LIST', 'CONT'][(floor(value + pos % 2)::BIGINT % 6) + 1] AS pred FROM r),
x AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY pos) - 1 AS i, gold, pred FROM s WHERE gold <> 'DROP'),
b AS (SELECT *, gold IN ('HEAD', 'PARA', 'LIST') AND i > 0 AS gb, pred IN ('HEAD', 'PARA', 'LIST') AND i > 0 AS pb,
  coalesce(lead(gold IN ('HEAD', 'PARA', 'LIST')) OVER o, true)::INT AS ge, coalesce(lead(pred IN ('HEAD', 'PARA', 'LIST')) OVER o, true)::INT AS pe
  FROM x WINDOW o AS (PARTITION BY doc ORDER BY i)),
c AS (SELECT doc, count(*) AS lines, count(*) FILTER (gb) AS g, count(*) FILTER (pb) AS p, count(*) FILTER (gb AND pb) AS tp,
  count(*) FILTER (gb AND pb AND gold = pred) AS typed, greatest(2, round_even(count(*) / (2 * greatest(sum(ge), 1)), 0)::INT) AS k FROM b GROUP BY doc),
l AS (SELECT doc, list(ge ORDER BY i) AS gl, list(pe ORDER BY i) AS pl FROM b GROUP BY doc),
w AS (SELECT c.doc, list_sum(gl[j + 1 : j + k]) AS gs, list_sum(pl[j + 1 : j + k]) AS ps FROM c JOIN l USING (doc), unnest(range(greatest(lines - k, 0))) AS u(j)),
e AS (SELECT doc, count(*) AS n, count(*) FILTER ((gs > 0) <> (ps > 0)) AS pk, count(*) FILTER (gs <> ps) AS wd FROM w GROUP BY doc),
j AS (SELECT doc, count(*) FILTER (gold = 'DROP') AS junk FROM s GROUP BY doc),
scores AS (SELECT j.doc, coalesce(lines, 0) AS lines, junk, coalesce(g, 0) AS gold_boundaries, coalesce(p, 0) AS pred_boundaries,
  CASE WHEN p > 0 THEN tp / p ELSE 1.0 END AS prec, CASE WHEN g > 0 THEN tp / g ELSE 1.0 END AS rec, coalesce(p - tp, 0) AS over_seg, coalesce(g - tp, 0) AS under_seg,
  CASE WHEN tp > 0 THEN typed / tp ELSE 1.0 END AS type_acc, CASE WHEN n > 0 THEN pk / n ELSE 0.0 END AS pk, CASE WHEN n > 0 THEN wd / n ELSE 0.0 END AS wd
  FROM j LEFT JOIN c USING (doc) LEFT JOIN e USING (doc))"""


def boundary_f1(spark, sf_dir):
    s = metrics.boundary_scores(_segmentation(spark, sf_dir))
    return s.select("doc", "lines", "junk", "gold_boundaries", "pred_boundaries", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "type_acc")], "over_seg", "under_seg")


F1 = f"""WITH {SEG} SELECT doc, lines, junk, gold_boundaries, pred_boundaries, round(prec, 6) AS precision, round(rec, 6) AS recall,
  round(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END, 6) AS f1, round(type_acc, 6) AS type_acc, over_seg, under_seg FROM scores"""


def pk_windowdiff(spark, sf_dir):
    return metrics.boundary_scores(_segmentation(spark, sf_dir)).select("doc", F.round("pk", 6).alias("pk"), F.round("windowdiff", 6).alias("windowdiff"))


def segmentation_overall(spark, sf_dir):
    out = metrics.overall_boundaries(metrics.boundary_scores(_segmentation(spark, sf_dir)))
    return out.select("files", *[F.round(c, 6).alias(c) for c in ("f1", "pk", "windowdiff")], "lines", "junk", "over_seg", "under_seg")


OVERALL = f"""WITH {SEG} SELECT count(*) AS files, round(avg(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END), 6) AS f1, round(median(pk), 6) AS pk,
  round(median(wd), 6) AS windowdiff, sum(lines)::BIGINT AS lines, sum(junk)::BIGINT AS junk, sum(over_seg)::BIGINT AS over_seg, sum(under_seg)::BIGINT AS under_seg FROM scores"""


def tolerant_match(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    gold = rows.filter("value > 60").select(F.col("base").alias("doc"), F.col("pos").alias("at"))
    pred = rows.filter("value > 50 and value < 90").select(F.col("base").alias("doc"), (F.col("pos") + F.col("pos") % 3).alias("at"))
    return metrics.tolerant_scores(gold, pred)


def last_n_turns(spark, sf_dir):
    return S.last_turns(table(spark, sf_dir, "conversations").filter("role = 'user'"), 6).select("conv_id", "turn", "text")


LAST = "SELECT conv_id, turn, text FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6"


def question_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), "text")
    return S.chunks(rows, 3).select("doc", "chunk", F.array_join("items", "|").alias("items"))


CHUNKS = "SELECT conv_id AS doc, turn // 3 AS chunk, string_agg(text, '|' ORDER BY turn) AS items FROM conversations GROUP BY ALL"


def major_moves(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    stages = rows.select(F.col("base").alias("skeleton"), "label", "pos", F.concat(F.lit("i"), F.col("pos").cast("string")).alias("intent"), (F.col("value") / 200).alias("typical_share"))
    return S.major_moves(stages).select("skeleton", "label", "intent")


MAJOR = f"WITH {ROWS} SELECT base AS skeleton, label, 'i' || pos AS intent FROM r WHERE value / 200 >= 0.1 QUALIFY row_number() OVER (PARTITION BY base, label ORDER BY value DESC, pos) = 1"

QUERIES = {
    "islands_events": (islands_events, f"WITH {ISLANDS} SELECT base, run, label, first, last, n FROM i"),
    "rle_events": (rle_events, RLE),
    "move_distribution": (move_distribution, DISTRIBUTION),
    "hellinger_nn": (hellinger_nn, HELLINGER),
    "length_band": (length_band, BAND),
    "monotone_stage": (monotone_stage, MONOTONE),
    "move_sections": (move_sections, SECTIONS_SQL),
    "runs_increasing": (runs_increasing, RUNS),
    "batch_packing": (batch_packing, PACKING),
    "boundary_f1": (boundary_f1, F1),
    "pk_windowdiff": (pk_windowdiff, f"WITH {SEG} SELECT doc, round(pk, 6) AS pk, round(wd, 6) AS windowdiff FROM scores"),
    "segmentation_overall": (segmentation_overall, OVERALL),
    "tolerant_match": (tolerant_match, None),
    "last_n_turns": (last_n_turns, LAST),
    "question_chunks": (question_chunks, CHUNKS),
    "major_moves": (major_moves, MAJOR),
}

"""Queries of the evaluation operators on the driver's tables.

The tables hold no judge data, so each has a stand-in: labels give gold, rules on documents give judges, events give
rollouts, conversations messages, embeddings classes, parts and suppliers offers and profiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as X
from ..functions.status import Response
from ..operators import embed, metrics, rank, recon, report, sampling, scores, votes
from ..sources import field_values_of, schema_profile
from ..sources.scratch import written
from ..streaming.follow import windowed_counts, work_list
from .registry import QUERIES, SQL, query, table

EVENT_LABELS = ("click", "error", "purchase", "signup", "view")

GOLD = "gold AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'DENIAL' WHEN toxic = 1 THEN 'EVASIVE' ELSE 'COMPLETE' END AS expected FROM labels)"
JUDGES = """judged AS (SELECT doc_id, lang, source, n_chars,
  CASE n_chars % 4 WHEN 0 THEN 'DENIAL' WHEN 1 THEN 'EVASIVE' ELSE 'COMPLETE' END AS a,
  CASE WHEN doc_id % 5 = 0 THEN 'EVASIVE' WHEN lang = 'de' THEN 'DENIAL' ELSE 'COMPLETE' END AS b,
  CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 'ERROR_JUDGE_FORMAT' WHEN (n_chars + doc_id) % 3 = 0 THEN 'COMPLETE' WHEN (n_chars + doc_id) % 3 = 1 THEN 'DENIAL' ELSE 'EVASIVE' END AS c
  FROM documents)"""
JOINED = f"WITH {GOLD}, {JUDGES}, joined AS (SELECT * FROM gold JOIN judged USING (doc_id))"


def gold(spark: SparkSession, d: str) -> DataFrame:
    expected = F.when(F.col("quality") == 0, "DENIAL").when(F.col("toxic") == 1, "EVASIVE").otherwise("COMPLETE")
    return table(spark, d, "labels").select("doc_id", expected.alias("expected"))


def judged(spark: SparkSession, d: str) -> DataFrame:
    n, i = F.col("n_chars"), F.col("doc_id")
    a = F.when(n % 4 == 0, "DENIAL").when(n % 4 == 1, "EVASIVE").otherwise("COMPLETE")
    b = F.when(i % 5 == 0, "EVASIVE").when(F.col("lang") == "de", "DENIAL").otherwise("COMPLETE")
    c = F.when(i % 11 == 0, None).when(i % 13 == 0, "ERROR_JUDGE_FORMAT").when((n + i) % 3 == 0, "COMPLETE").when((n + i) % 3 == 1, "DENIAL").otherwise("EVASIVE")
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", a.alias("a"), b.alias("b"), c.alias("c"))


def joined(spark: SparkSession, d: str) -> DataFrame:
    return gold(spark, d).join(judged(spark, d), "doc_id")


@query(f"WITH {JUDGES} SELECT lang, source, a AS label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY lang, source), 6) AS pct FROM judged GROUP BY lang, source, a")
def label_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return metrics.category_summary(judged(spark, d).withColumnRenamed("a", "label"), ["lang", "source"], "label")


@query(f"""WITH {JUDGES}, cells AS (SELECT source, lang, count(*) AS n, count(*) FILTER (a = 'COMPLETE') AS complete, count(*) FILTER (a = 'EVASIVE') AS evasive, count(*) FILTER (a = 'DENIAL') AS denial, count(*) FILTER (a = 'ERROR') AS error FROM judged GROUP BY source, lang)
SELECT source, lang, n, complete, evasive, denial, error, round(100.0 * complete / n, 3) AS complete_pct, round(100.0 * sum(complete) OVER (PARTITION BY source) / sum(n) OVER (PARTITION BY source), 3) AS score FROM cells""")
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return metrics.leaderboard(judged(spark, d), "source", "lang", "a")


@query("SELECT l.lang, s.source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN (SELECT DISTINCT source FROM documents) s LEFT JOIN (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source) c ON c.lang = l.lang AND c.source = s.source")
def dense_grid(spark: SparkSession, d: str) -> DataFrame:
    return metrics.dense_grid(table(spark, d, "documents").select("lang", "source"), "lang", "source")


GROUPED = """SELECT CASE WHEN grouping(lang) = 1 AND grouping(source) = 1 THEN 'overall' WHEN grouping(source) = 1 THEN 'lang' ELSE 'source' END AS dimension,
 CASE WHEN grouping(lang) = 1 AND grouping(source) = 1 THEN NULL WHEN grouping(source) = 1 THEN lang ELSE source END AS value, {0} FROM joined GROUP BY GROUPING SETS ((), (lang), (source))"""


@query(f"{JOINED} " + GROUPED.format("count(*) AS rows, count(c) AS matched, count(*) - count(c) AS missing, count(*) FILTER (c = expected) AS correct, round(100.0 * count(*) FILTER (c = expected) / count(*), 3) AS accuracy_pct, round(100.0 * count(c) / count(*), 3) AS coverage_pct"))
def accuracy_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return metrics.judge_accuracy(joined(spark, d), ["lang", "source"], "expected", "c")


@query(f"{JOINED} SELECT expected, c AS observed, count(*) AS n FROM joined WHERE c IS NOT NULL GROUP BY expected, c")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(joined(spark, d).withColumnRenamed("c", "observed"))


@query(f"{JOINED}, grid AS (SELECT e.x AS expected, o.x AS observed FROM (VALUES ('COMPLETE'), ('DENIAL'), ('EVASIVE')) e(x) CROSS JOIN (VALUES ('COMPLETE'), ('DENIAL'), ('EVASIVE'), ('UNPARSED')) o(x)), n AS (SELECT expected, CASE WHEN c IN ('COMPLETE', 'DENIAL', 'EVASIVE') THEN c ELSE 'UNPARSED' END AS observed, count(*) AS n FROM joined GROUP BY 1, 2) SELECT expected, observed, coalesce(n, 0) AS n FROM grid LEFT JOIN n USING (expected, observed)")
def dense_confusion(spark: SparkSession, d: str) -> DataFrame:
    return metrics.dense_confusion(joined(spark, d).withColumnRenamed("c", "observed"))


@query(f"{JOINED} " + GROUPED.format("""count(*) AS rows, count(*) FILTER (c = expected) AS correct, round(100.0 * count(*) FILTER (c = expected) / count(*), 3) AS accuracy_pct,
 count(*) FILTER (c IN ('COMPLETE', 'DENIAL', 'EVASIVE')) AS parseable, round(100.0 * count(*) FILTER (c IN ('COMPLETE', 'DENIAL', 'EVASIVE')) / count(*), 3) AS parseable_pct,
 count(*) FILTER (n_chars > 4000) AS truncated, round(avg(n_chars // 4), 3) AS mean_tokens, max(n_chars // 4) AS max_tokens"""))
def rollout_report(spark: SparkSession, d: str) -> DataFrame:
    rows = joined(spark, d).withColumnRenamed("c", "observed").withColumn("is_truncated", F.col("n_chars") > 4000).withColumn("generated_tokens", F.expr("n_chars div 4"))
    return metrics.rollout_summary(rows, ["lang", "source"])


@query("WITH m AS (SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)) SELECT lang, coalesce(CAST(quality AS VARCHAR), 'MISSING') AS label, count(*) AS n FROM m GROUP BY 1, 2")
def coverage_left_join(spark: SparkSession, d: str) -> DataFrame:
    observed = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    return recon.left_with_missing(table(spark, d, "documents").select("doc_id", "lang"), observed, "doc_id", "label").groupBy("lang", "label").agg(recon.one())


@query(f"""WITH {JUDGES}, q AS (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0), r AS (SELECT doc_id FROM documents WHERE doc_id % 9 <> 0), an AS (SELECT doc_id FROM labels),
u AS (SELECT doc_id, 1 AS q, 0 AS r, 0 AS a FROM q UNION ALL SELECT doc_id, 0, 1, 0 FROM r UNION ALL SELECT doc_id, 0, 0, 1 FROM an), s AS (SELECT doc_id, sum(q) AS nq, sum(r) AS nr, sum(a) AS na FROM u GROUP BY doc_id)
SELECT CASE WHEN nr > 1 OR na > 1 THEN 'duplicate' WHEN nq = 0 THEN 'extra' WHEN nr = 0 THEN 'missing_response' WHEN na = 0 THEN 'missing_analysis' ELSE 'complete' END AS state, count(*) AS n FROM s GROUP BY 1""")
def recon_full_outer(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    return recon.reconcile(docs.filter("doc_id % 7 <> 0"), docs.filter("doc_id % 9 <> 0"), table(spark, d, "labels").select("doc_id"), "doc_id").groupBy("state").agg(recon.one())


BINARY = "count(*) FILTER (expected = 'COMPLETE' AND {0} = 'COMPLETE') AS tp, count(*) FILTER (expected <> 'COMPLETE' AND {0} = 'COMPLETE') AS fp, count(*) FILTER (expected = 'COMPLETE' AND {0} <> 'COMPLETE') AS fn, count(*) FILTER (expected <> 'COMPLETE' AND {0} <> 'COMPLETE') AS tn"


@query(f"{JOINED}, s AS (SELECT lang, {BINARY.format('a')} FROM joined GROUP BY lang) SELECT lang, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tn / nullif(tn + fn, 0), 6) AS npv, round((tp + tn) / greatest(1, tp + tn + fp + fn), 6) AS accuracy FROM s")
def binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    return joined(spark, d).groupBy("lang").agg(*metrics.binary_metrics(F.col("expected"), F.col("a")))


VALID = "c IN ('COMPLETE', 'DENIAL', 'EVASIVE')"


@query(f"""{JOINED}, s AS (SELECT source, count(*) AS expected_rows, count(c) AS matched_rows, count(*) FILTER ({VALID}) AS valid, count(*) FILTER ({VALID} AND c = expected) AS exact_correct, count(*) FILTER ({VALID} AND (c = 'COMPLETE') = (expected = 'COMPLETE')) AS binary_correct FROM joined GROUP BY source)
SELECT source, expected_rows, matched_rows, valid, expected_rows - matched_rows AS missing_rows, round(100.0 * matched_rows / expected_rows, 3) AS coverage_pct, round(100.0 * valid / expected_rows, 3) AS valid_coverage_pct, exact_correct, round(100.0 * exact_correct / expected_rows, 3) AS exact_pct, CASE WHEN valid = 0 THEN 0.0 ELSE round(100.0 * exact_correct / valid, 3) END AS exact_valid_pct,
 binary_correct, round(100.0 * binary_correct / expected_rows, 3) AS binary_pct, CASE WHEN valid = 0 THEN 0.0 ELSE round(100.0 * binary_correct / valid, 3) END AS binary_valid_pct FROM s""")
def metric_block(spark: SparkSession, d: str) -> DataFrame:
    return joined(spark, d).groupBy("source").agg(*metrics.metric_block(F.col("expected"), F.col("c"), F.col("c").isNotNull()))


@query(f"""{JOINED}, s AS (SELECT expected AS e, coalesce(c, 'MISSING') AS o FROM joined)
SELECT count(*) AS rows, count(*) FILTER (e = o) AS total_correct, count(*) FILTER ((e = 'COMPLETE') = (o = 'COMPLETE')) AS complete_binary_correct,
 round(100.0 * count(*) FILTER (e = 'COMPLETE' AND o = 'COMPLETE') / count(*) FILTER (e = 'COMPLETE'), 3) AS complete_recall_pct, round(100.0 * count(*) FILTER (e = 'DENIAL' AND o = 'DENIAL') / count(*) FILTER (e = 'DENIAL'), 3) AS denial_recall_pct, round(100.0 * count(*) FILTER (e = 'EVASIVE' AND o = 'EVASIVE') / count(*) FILTER (e = 'EVASIVE'), 3) AS evasive_recall_pct,
 count(*) FILTER (e <> 'COMPLETE' AND o = 'COMPLETE') AS false_complete, count(*) FILTER (e = 'COMPLETE' AND o IN ('DENIAL', 'EVASIVE')) AS missed_complete, count(*) FILTER (e <> 'COMPLETE' AND o = 'COMPLETE') - count(*) FILTER (e = 'COMPLETE' AND o IN ('DENIAL', 'EVASIVE')) AS net_complete_bias,
 count(*) FILTER (o = 'ERROR_JUDGE_FORMAT') AS unparseable, count(*) FILTER (starts_with(o, 'ERROR')) AS error_count, count(*) FILTER (o = 'ERROR_JUDGE_CONTENT_FILTER') AS content_filter FROM s""")
def qualification(spark: SparkSession, d: str) -> DataFrame:
    return metrics.qualification(joined(spark, d), "expected", "c")


@query("""WITH s AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER ((quality = 0) = (toxic = 1)) AS same, CAST(count(*) FILTER (quality = 0) AS DOUBLE) AS ca, CAST(count(*) FILTER (toxic = 1) AS DOUBLE) AS cb, count(*) FILTER (quality = 0 OR toxic = 1) AS n_either, count(*) FILTER (quality = 0 AND toxic = 1) AS n_both FROM labels JOIN documents USING (doc_id) GROUP BY source),
p AS (SELECT *, same / n AS po, (ca * cb + (n - ca) * (n - cb)) / (n * n) AS pe FROM s)
SELECT source, CAST(n AS BIGINT) AS n, round(CASE WHEN n_either = 0 THEN 1.0 ELSE n_both / n_either END, 6) AS jaccard, round(po, 6) AS agree, round(CASE WHEN abs(1 - pe) > 1e-9 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM p""")
def kappa_jaccard(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    a, b = F.col("quality") == 0, F.col("toxic") == 1
    return rows.groupBy("source").agg(recon.one(), F.round(metrics.refusal_jaccard(a, b), 6).alias("jaccard"), F.round(metrics.agreement(a, b), 6).alias("agree"), F.round(metrics.kappa(a, b), 6).alias("kappa"))


LONG = "runs AS (SELECT doc_id, expected, 'a' AS run, a AS label FROM joined UNION ALL SELECT doc_id, expected, 'b', b FROM joined UNION ALL SELECT doc_id, expected, 'c', c FROM joined WHERE c IS NOT NULL)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("run"), F.col(x).alias("label")) for x in "abc"])).alias("s")
    return joined(spark, d).select("doc_id", "expected", pairs).select("doc_id", "expected", "s.*").filter("label IS NOT NULL")


@query(f"""{JOINED}, {LONG} SELECT l.run AS left_run, r.run AS right_run, count(*) AS rows, count(*) FILTER (l.label = r.label) AS agree, count(*) FILTER ((l.label = 'COMPLETE') = (r.label = 'COMPLETE')) AS binary_agree,
 count(*) FILTER (l.label = l.expected AND r.label <> l.expected) AS left_only_correct, count(*) FILTER (l.label <> l.expected AND r.label = l.expected) AS right_only_correct, round(100.0 * count(*) FILTER (l.label = r.label) / count(*), 3) AS agree_pct FROM runs l JOIN runs r ON l.doc_id = r.doc_id AND l.run < r.run GROUP BY 1, 2""")
def all_pairs(spark: SparkSession, d: str) -> DataFrame:
    return recon.all_pairs(_runs(spark, d), "doc_id", "run", "label", "expected")


@query(f"""{JOINED} SELECT count(*) AS rows, count(*) FILTER (a = b) AS agree, count(*) FILTER ((a = 'COMPLETE') = (b = 'COMPLETE')) AS binary_agree, count(*) FILTER (a = expected AND b <> expected) AS left_only_correct, count(*) FILTER (a <> expected AND b = expected) AS right_only_correct,
 count(*) FILTER ((a = 'COMPLETE') = (expected = 'COMPLETE') AND (b = 'COMPLETE') <> (expected = 'COMPLETE')) AS left_only_binary, count(*) FILTER ((a = 'COMPLETE') <> (expected = 'COMPLETE') AND (b = 'COMPLETE') = (expected = 'COMPLETE')) AS right_only_binary FROM joined""")
def paired_compare(spark: SparkSession, d: str) -> DataFrame:
    return metrics.paired(joined(spark, d), True, "expected", "a", "b")


@query(f"""{JOINED}, l AS (SELECT doc_id, c AS label FROM joined WHERE doc_id % 3 <> 0 AND c IS NOT NULL), r AS (SELECT doc_id, a AS label FROM joined WHERE doc_id % 4 <> 0), f AS (SELECT l.label AS ll, r.label AS rl, l.doc_id AS li, r.doc_id AS ri FROM l FULL JOIN r ON l.doc_id = r.doc_id)
SELECT count(*) FILTER (ri IS NULL) AS left_only, count(*) FILTER (li IS NULL) AS right_only, count(*) FILTER (li = ri) AS common, count(*) FILTER (li = ri AND ll NOT LIKE 'ERROR%') AS valid, count(*) FILTER (li = ri AND ll = rl) AS agree, round(100.0 * count(*) FILTER (li = ri AND ll = rl) / count(*) FILTER (li = ri), 3) AS agree_pct FROM f""")
def partial_comparison(spark: SparkSession, d: str) -> DataFrame:
    rows = joined(spark, d)
    left = rows.filter("doc_id % 3 <> 0 AND c IS NOT NULL").select("doc_id", F.col("c").alias("label"))
    right = rows.filter("doc_id % 4 <> 0").select("doc_id", F.col("a").alias("label"))
    return metrics.partial_comparison(left, right, "doc_id", "label")


@query(f"{JOINED}, s AS (SELECT *, coalesce(a = expected, false) AS x, coalesce(c = expected, false) AS y FROM joined) " + GROUPED.format("""count(*) AS rows, count(*) FILTER (x AND y) AS both_correct, count(*) FILTER (x AND NOT y) AS regressed, count(*) FILTER (NOT x AND y) AS improved, count(*) FILTER (NOT x AND NOT y) AS both_wrong,
 count(*) FILTER (y) - count(*) FILTER (x) AS delta_correct, round(round(100.0 * count(*) FILTER (y) / count(*), 3) - round(100.0 * count(*) FILTER (x) / count(*), 3), 3) AS delta_accuracy_pct""").replace("FROM joined", "FROM s"))
def shift_report(spark: SparkSession, d: str) -> DataFrame:
    return metrics.shift(joined(spark, d), ["lang", "source"], "expected", "a", "c")


@query(f"{JOINED} SELECT coalesce(a, 'MISSING') AS a, coalesce(c, 'MISSING') AS c, count(*) AS n FROM joined GROUP BY 1, 2")
def shift_transition(spark: SparkSession, d: str) -> DataFrame:
    return metrics.transitions(joined(spark, d), "a", "c")


@query(f"""{JOINED}, s AS (SELECT count(*) AS n, count(*) FILTER (a = 'COMPLETE') - count(*) FILTER (expected = 'COMPLETE') AS c, count(*) FILTER (a = 'DENIAL') - count(*) FILTER (expected = 'DENIAL') AS d, count(*) FILTER (a = 'EVASIVE') - count(*) FILTER (expected = 'EVASIVE') AS e FROM joined), r AS (SELECT round(100.0 * c / n, 6) AS x, round(100.0 * d / n, 6) AS y, round(100.0 * e / n, 6) AS z FROM s)
SELECT x AS complete_delta_pp, y AS denial_delta_pp, z AS evasive_delta_pp, round(abs(x) + abs(y) + abs(z), 6) AS total_abs_delta_pp FROM r""")
def divergence(spark: SparkSession, d: str) -> DataFrame:
    return metrics.divergence(joined(spark, d), "expected", "a")


@query(f"{JOINED} SELECT expected || '->' || CASE WHEN c LIKE 'ERROR%' THEN 'OTHER' ELSE c END AS pair, count(*) AS n FROM joined WHERE c <> expected GROUP BY 1")
def disagreement_breakdown(spark: SparkSession, d: str) -> DataFrame:
    rows = joined(spark, d).withColumnRenamed("c", "observed")
    return metrics.disagreements(metrics.confusion(rows)).withColumn("n", F.col("n").cast("long"))


PEERS = """labelled AS (SELECT doc_id // 20 AS question_id, source AS model, min(CASE n_chars % 3 WHEN 0 THEN 'COMPLY' ELSE 'REFUSE' END) AS b FROM documents GROUP BY 1, 2)"""


@query(f"""WITH {PEERS}, p AS (SELECT o.model, t.b = 'REFUSE' AS x, o.b = 'REFUSE' AS y FROM labelled o JOIN labelled t ON o.question_id = t.question_id AND t.model = 'src0' AND o.model <> 'src0'),
s AS (SELECT model, count(*) AS n, count(*) FILTER (x OR y) AS n_either, count(*) FILTER (x AND y) AS n_both, count(*) FILTER (x = y) / count(*) AS po, CAST(count(*) FILTER (x) AS DOUBLE) AS ca, CAST(count(*) FILTER (y) AS DOUBLE) AS cb FROM p GROUP BY model),
k AS (SELECT *, (ca * cb + (n - ca) * (n - cb)) / (CAST(n AS DOUBLE) * n) AS pe FROM s),
f AS (SELECT model, n, round(CASE WHEN n_either = 0 THEN 1.0 ELSE n_both / n_either END, 6) AS jaccard, round(po, 6) AS agree, round(CASE WHEN abs(1 - pe) > 1e-9 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM k)
SELECT * FROM f ORDER BY coalesce(jaccard, -1) DESC, coalesce(agree, -1) DESC, coalesce(kappa, -1) DESC, model LIMIT 10""")
def refusal_peers(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    rows = docs.groupBy(F.expr("doc_id div 20").alias("question_id"), F.col("source").alias("model")).agg(F.min(F.when(F.col("n_chars") % 3 == 0, "COMPLY").otherwise("REFUSE")).alias("binary"))
    return metrics.refusal_peers(rows, "src0")


ROLL = "roll AS (SELECT user_id AS id, (ARRAY['click', 'error', 'purchase', 'signup', 'view'])[1 + user_id % 5] AS expected, event_type AS observed, value > 40 AS is_truncated, event_id FROM events)"
VOTED = f"""WITH {ROLL}, n AS (SELECT id, expected, observed, count(*) AS c FROM roll GROUP BY 1, 2, 3), t AS (SELECT id, max(c) AS top, sum(c) AS total FROM n GROUP BY id), w AS (SELECT id, count(*) AS winners, min(observed) AS winner FROM n JOIN t USING (id) WHERE c = top GROUP BY id),
h AS (SELECT id, -sum(c / total * log2(c / total)) AS entropy FROM n JOIN t USING (id) GROUP BY id), r AS (SELECT id, expected, count(*) AS rollouts, count(*) FILTER (observed = expected) AS correct_votes, count(*) FILTER (is_truncated) AS truncated_rollouts FROM roll GROUP BY 1, 2),
voted AS (SELECT r.*, t.top AS top_count, CASE WHEN winners = 1 THEN winner END AS plurality, winners, round(entropy, 6) AS entropy FROM r JOIN t USING (id) JOIN w USING (id) JOIN h USING (id))"""


def _voted(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in EVENT_LABELS])
    rows = table(spark, d, "events").select(F.col("user_id").alias("id"), names[(F.col("user_id") % 5).cast("int")].alias("expected"), F.col("event_type").alias("observed"), (F.col("value") > 40).alias("is_truncated"))
    return votes.votes(rows, labels=EVENT_LABELS, positive="purchase")


@query(f"{VOTED} SELECT id, expected, rollouts, correct_votes, truncated_rollouts, top_count, plurality, entropy, coalesce(plurality = expected, false) AS plurality_correct, CASE WHEN correct_votes = 0 THEN 'all_wrong' WHEN correct_votes = rollouts THEN 'all_correct' ELSE 'mixed' END AS category FROM voted")
def votes_plurality(spark: SparkSession, d: str) -> DataFrame:
    return _voted(spark, d).select("id", "expected", "rollouts", "correct_votes", "truncated_rollouts", "top_count", "plurality", "entropy", "plurality_correct", "category")


@query(f"""{VOTED} SELECT count(*) AS items, count(*) FILTER (plurality = expected) AS plurality_correct, round(100.0 * count(*) FILTER (plurality = expected) / count(*), 3) AS plurality_pct, count(*) FILTER (plurality = expected AND top_count >= rollouts // 2 + 1) AS majority_correct,
 count(*) FILTER (correct_votes > 0) AS any_correct, count(*) FILTER (correct_votes = rollouts) AS all_correct, count(*) FILTER (top_count = rollouts) AS unanimous, count(*) FILTER (winners > 1) AS ties, round(avg(entropy), 6) AS mean_entropy FROM voted""")
def rollout_vote_summary(spark: SparkSession, d: str) -> DataFrame:
    return votes.rollout_summary(_voted(spark, d))


@query(f"{VOTED} SELECT correct_votes, count(*) AS items FROM voted GROUP BY 1")
def vote_histogram(spark: SparkSession, d: str) -> DataFrame:
    return votes.vote_histogram(_voted(spark, d))


@query(f"""{JOINED}, {LONG}, n AS (SELECT doc_id, expected, label, count(*) AS judges, min(run) AS seen FROM runs WHERE label <> expected AND label NOT LIKE 'ERROR%' GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY judges DESC, seen) AS r FROM n)
SELECT doc_id, expected, label, judges FROM r WHERE r = 1 AND judges >= 2""")
def consensus_against_gold(spark: SparkSession, d: str) -> DataFrame:
    return votes.consensus_against_gold(_runs(spark, d), "doc_id", "expected", "label", "run", 2)


@query(f"{JOINED}, {LONG} SELECT doc_id, min(label) AS label FROM runs GROUP BY doc_id HAVING count(*) = 3 AND count(DISTINCT label) = 1")
def unanimous_panel(spark: SparkSession, d: str) -> DataFrame:
    return votes.unanimous(_runs(spark, d), "doc_id", "label", 3)


QSTATS = """stats AS (SELECT source, count(*) AS total, count(*) FILTER (a = 'COMPLETE') AS c, count(*) FILTER (a = 'DENIAL') AS d, count(*) FILTER (a = 'EVASIVE') AS e FROM judged GROUP BY source), rated AS (SELECT source, total, round(c / total, 6) AS complete_rate, round(d / total, 6) AS denial_rate, round(e / total, 6) AS evasive_rate,
 CASE WHEN c = greatest(c, d, e) THEN 'COMPLETE' WHEN d = greatest(c, d, e) THEN 'DENIAL' ELSE 'EVASIVE' END AS majority, round(1 - greatest(c, d, e) / total, 6) AS contention,
 round((CASE WHEN c > 0 THEN -c / total * log2(c / total) ELSE 0 END + CASE WHEN d > 0 THEN -d / total * log2(d / total) ELSE 0 END + CASE WHEN e > 0 THEN -e / total * log2(e / total) ELSE 0 END) / log2(3), 6) AS entropy FROM stats)"""


@query(f"WITH {JUDGES}, {QSTATS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY total >= 10 AND complete_rate > 0 ORDER BY complete_rate, denial_rate DESC, evasive_rate DESC, total DESC, source) AS r FROM rated) SELECT * EXCLUDE (r), CASE WHEN total >= 10 AND complete_rate > 0 THEN r ELSE -1 END AS hard_rank FROM ranked")
def hard_rank(spark: SparkSession, d: str) -> DataFrame:
    return rank.hard_rank(rank.question_stats(judged(spark, d), "source", "a"), "source")


@query("SELECT doc_id, n_chars, (rank() OVER (ORDER BY n_chars) - 1 + 0.5 * count(*) OVER (PARTITION BY n_chars)) / count(*) OVER () AS pct FROM documents")
def midrank_percentile(spark: SparkSession, d: str) -> DataFrame:
    return rank.midrank_percentile(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "pct")


FEATURES = """feats AS (SELECT doc_id, length(text) AS response_chars, length(text) - length(replace(text, chr(10), '')) + 1 AS response_lines, len(w) AS response_tokens, CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0.0 END AS unique_ratio,
 CASE WHEN length(text) > 0 THEN (4 * length(text) - length(replace(text, '#', '')) - length(replace(text, '*', '')) - length(replace(text, '`', '')) - length(replace(text, '|', ''))) / length(text) ELSE 0.0 END AS markdown_density FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '[A-Za-z0-9_'']+') AS w FROM documents))"""


def _features(spark: SparkSession, d: str) -> DataFrame:
    made = X.features(F.col("text"), F.col("counts"))
    return table(spark, d, "documents").select("doc_id", "text", X.token_counts(F.col("text")).alias("counts")).select("doc_id", *[c.alias(n) for n, c in made.items()])


@query(f"WITH {FEATURES} SELECT doc_id, response_chars, response_lines, response_tokens, round(unique_ratio, 6) AS unique_ratio, round(markdown_density, 6) AS markdown_density FROM feats")
def text_features(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d).withColumn("unique_ratio", F.round("unique_ratio", 6)).withColumn("markdown_density", F.round("markdown_density", 6))


def _mid(c: str, name: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) - 1 + 0.5 * count(*) OVER (PARTITION BY {c})) / count(*) OVER () AS {name}"


@query(f"""WITH {FEATURES}, f AS (SELECT doc_id, response_chars, response_lines, round(markdown_density, 9) AS md, CASE WHEN response_tokens >= 80 THEN round(1 - unique_ratio, 9) ELSE 0.0 END AS rep FROM feats), p AS (SELECT *, {_mid('response_chars', 'lp')}, {_mid('response_lines', 'np')}, {_mid('md', 'mp')}, {_mid('rep', 'rp')} FROM f)
SELECT doc_id, round(0.45 * lp + 0.2 * np + 0.15 * mp + 0.2 * rp, 6) AS weird_score, array_to_string(list_filter([CASE WHEN lp >= 0.98 THEN 'very_long' END, CASE WHEN np >= 0.98 THEN 'many_lines' END, CASE WHEN mp >= 0.98 AND md > 0 THEN 'high_markdown_density' END, CASE WHEN rp >= 0.98 AND rep > 0 THEN 'low_token_diversity' END], lambda x: x IS NOT NULL), ',') AS weird_reasons FROM p""")
def weird_score(spark: SparkSession, d: str) -> DataFrame:
    rep = F.when(F.col("response_tokens") >= 80, F.round(1 - F.col("unique_ratio"), 9)).otherwise(0.0)
    rows = _features(spark, d).select("doc_id", "response_chars", "response_lines", F.round("markdown_density", 9).alias("md"), rep.alias("rep"))
    out = rank.weird_score(rows, "response_chars", "response_lines", "md", "rep")
    return out.select("doc_id", "weird_score", F.array_join("weird_reasons", ",").alias("weird_reasons"))


@query("""WITH w AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[A-Za-z0-9_'']+') AS w FROM documents), s AS (SELECT source, len(w) AS n, len(list_distinct(w)) AS v FROM w), pooled AS (SELECT source, count(DISTINCT x) AS v, count(*) AS n FROM (SELECT source, unnest(w) AS x FROM w) GROUP BY source),
a AS (SELECT source, count(*) AS texts, round(avg(CASE WHEN n > 0 THEN v / sqrt(n) ELSE 0 END), 6) AS mean_root_ttr, round(avg(CASE WHEN n > 1 AND v > 1 THEN (ln(n) - ln(v)) / (ln(n) * ln(n)) ELSE 0 END), 6) AS mean_maas FROM s GROUP BY source) SELECT source, texts, mean_root_ttr, mean_maas, round(v / sqrt(n), 6) AS global_root_ttr FROM a JOIN pooled USING (source)""")
def lexical_diversity(spark: SparkSession, d: str) -> DataFrame:
    once = X.let(X.tokens(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.array_distinct(w).alias("w")))
    rows = written(table(spark, d, "documents").select("source", once.alias("t")).select("source", "t.n", F.size("t.w").cast("long").alias("v"), "t.w"), "tokens")
    means = [F.round(F.avg(f(F.col("n"), F.col("v"))), 6).alias(name) for name, f in (("mean_root_ttr", X.root_ttr), ("mean_maas", X.maas))]
    each = rows.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"), *means)
    words = rows.select("source", F.explode("w").alias("x")).distinct().groupBy("source").agg(recon.one("kinds"))
    pooled = each.select("source", "n").join(words, "source").select("source", (F.col("kinds") / F.sqrt("n")).alias("g"))
    return each.join(pooled, "source").select("source", "texts", "mean_root_ttr", "mean_maas", F.round("g", 6).alias("global_root_ttr"))


@query(r"SELECT sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def norm_hash_dups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(X.text_hash(F.col("text")).alias("hash")).agg(recon.one()).filter("n > 1")


@query(r"""WITH h AS (SELECT doc_id, source, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS hash FROM documents), art AS (SELECT hash FROM h WHERE doc_id % 17 = 0) SELECT source, count(*) AS kept FROM h WHERE hash NOT IN (SELECT hash FROM art) GROUP BY source""")
def decontaminate_exact(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", X.text_hash(F.col("text")).alias("hash"))
    return recon.exclude_by_text(rows, rows.filter("doc_id % 17 = 0"), "hash").groupBy("source").agg(recon.one("kept"))


@query(r"""WITH rws AS (SELECT doc_id AS key, doc_id // 3 AS question_id, sha256(text) AS response_hash FROM documents), g AS (SELECT question_id, response_hash FROM rws WHERE key % 41 = 0), a AS (SELECT question_id, NULL AS response_hash, 'q' AS tag FROM rws WHERE key % 29 = 0 UNION ALL SELECT NULL, response_hash, 'h' FROM rws WHERE key % 31 = 0),
t AS (SELECT key, array_to_string(list_sort(list_distinct(list(tag))), ',') AS contact FROM (SELECT key, tag FROM rws JOIN a USING (question_id) UNION ALL SELECT key, tag FROM rws JOIN a USING (response_hash)) GROUP BY key)
SELECT key, CASE WHEN question_id IN (SELECT question_id FROM g) THEN 'question_id' WHEN response_hash IN (SELECT response_hash FROM g) THEN 'response_hash' END AS excluded_by, coalesce(contact, '') AS contact FROM rws LEFT JOIN t USING (key)""")
def exclusions_with_contact(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.expr("doc_id div 3").alias("question_id"), F.sha2("text", 256).alias("response_hash"))
    gold_pairs = rows.filter("key % 41 = 0").select("question_id", "response_hash")
    none = F.lit(None)
    artifacts = rows.filter("key % 29 = 0").select("question_id", none.cast("string").alias("response_hash"), F.lit("q").alias("tag")).unionByName(rows.filter("key % 31 = 0").select(none.cast("long").alias("question_id"), "response_hash", F.lit("h").alias("tag")))
    return recon.apply_exclusions(rows, gold_pairs, artifacts).select("key", "excluded_by", F.array_join("contact", ",").alias("contact"))


@query("SELECT conv_id, turn, role, length(text) AS chars FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def last_turn(spark: SparkSession, d: str) -> DataFrame:
    return rank.latest(table(spark, d, "conversations"), ["conv_id"], [F.desc("turn")]).select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'UNPARSED' WHEN turn % 4 = 2 THEN 'EVASIVE' ELSE CASE WHEN length(text) % 2 = 0 THEN 'COMPLETE' ELSE 'DENIAL' END END AS last_label, CASE WHEN turn % 4 = 3 THEN 'ERROR_JUDGE_FORMAT' ELSE CASE WHEN length(text) % 2 = 0 THEN 'COMPLETE' ELSE 'DENIAL' END END AS judge_label FROM conversations""")
def label_parse(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.length("text") % 2 == 0, "COMPLETE").otherwise("denial")
    made = F.when(F.col("turn") % 4 == 3, F.concat(F.lit("<think> open "), "text")).otherwise(F.concat(F.lit("ANALYSIS: x\nCOMPLIANCE: ["), label, F.lit("]"), F.when(F.col("turn") % 4 == 2, "\nLabel: *evasive*").otherwise("")))
    return table(spark, d, "conversations").select("conv_id", "turn", L.last_label(made).alias("last_label"), L.judge_fields(made)["label"].alias("judge_label"))


@query("SELECT doc_id, CASE WHEN regexp_matches('q' || doc_id, '(^|[^0-9])[1-4]$') THEN 'type' || right(CAST(doc_id AS VARCHAR), 1) ELSE 'other' END AS question_type FROM documents")
def question_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", L.question_type(F.concat(F.lit("q"), F.col("doc_id").cast("string"))).alias("question_type"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'success' WHEN 1 THEN 'truncation' WHEN 2 THEN 'moderation' WHEN 3 THEN 'provider_error' WHEN 4 THEN 'metadata_error' ELSE 'unknown_metadata' END AS status FROM documents""")
def response_status(spark: SparkSession, d: str) -> DataFrame:
    shapes = ['{"choices":[{"finish_reason":"stop","message":{"content":"ok"}}]}', '{"choices":[{"finish_reason":"length","message":{"content":"ok"}}]}', '{"choices":[{"finish_reason":"content_filter","message":{"content":""}}]}', '{"error":{"code":500,"message":"overloaded"}}', '{"choices":[{"finish_reason":null,"message":{"content":"ok"}}]}', '{"choices":[{"finish_reason":"strange","message":{"content":"ok"}}]}']
    json = F.array(*[F.lit(s) for s in shapes])[(F.col("doc_id") % 6).cast("int")]
    return table(spark, d, "documents").select("doc_id", json.alias("json")).select("doc_id", Response(F.col("json"), F.lit("m")).status()["status"].alias("status"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return rank.latest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.asc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_type, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1, 2")
def dedup_first_last(spark: SparkSession, d: str) -> DataFrame:
    from ..sources import load

    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    keys = ["user_id", "event_type"]
    first = load(e, keys, "first", ["event_id"]).withColumnRenamed("event_id", "first_id")
    return first.join(load(e, keys, "last", ["event_id"]).withColumnRenamed("event_id", "last_id"), keys)


@query("""WITH done AS (SELECT l_orderkey AS k, max(l_shipdate) AS seen_at FROM lineitem GROUP BY 1) SELECT o_orderkey, CASE WHEN k IS NULL THEN 'new' ELSE 'stale' END AS reason FROM orders LEFT JOIN done ON k = o_orderkey WHERE k IS NULL OR seen_at < o_orderdate""")
def incremental_worklist(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("analysed_at"))
    todo = work_list(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), done, ["o_orderkey"], "o_orderdate")
    return todo.select("o_orderkey", F.when(F.col("analysed_at").isNull(), "new").otherwise("stale").alias("reason"))


@query("""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), r AS (SELECT lang, n, round(97 * CAST(n AS DOUBLE) / sum(n) OVER (), 9) AS raw FROM c), f AS (SELECT *, floor(raw) AS fl FROM r), k AS (SELECT *, row_number() OVER (ORDER BY raw - fl DESC, lang DESC) AS rk, 97 - sum(fl) OVER () AS rest FROM f)
SELECT lang, n, CAST(fl + CASE WHEN rk <= rest THEN 1 ELSE 0 END AS BIGINT) AS allocated FROM k""")
def largest_remainder(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").groupBy("lang").agg(recon.one())
    return sampling.allocate(c, "lang", F.col("n").cast("double"), 97)


MD5 = "md5('{0}|' || doc_id)"


@query(f"SELECT doc_id, lang, source, r AS round FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY {MD5.format('rr')}, doc_id) AS r FROM documents) ORDER BY r, lang, source, doc_id LIMIT 120")
def stratified_roundrobin(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_sample(table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], 120, "rr", "doc_id")


@query(f"SELECT doc_id, lang, CASE WHEN r <= 20 THEN 'dev' WHEN r <= 60 THEN 'sft' ELSE 'rl' END AS split FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {MD5.format('split')}, doc_id) AS r FROM documents) WHERE r <= 100")
def split_disjoint(spark: SparkSession, d: str) -> DataFrame:
    return sampling.disjoint_splits(table(spark, d, "documents").select("doc_id", "lang"), ["lang"], {"dev": 20, "sft": 40, "rl": 40}, "split", "doc_id")


@query("SELECT doc_id, CAST(f AS BIGINT) AS frame, f / count(*) OVER (PARTITION BY source) AS sampling_weight FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS f FROM documents) WHERE doc_id % 6 = 0")
def ht_weights(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    framed = docs.join(docs.groupBy("source").agg(recon.one("frame")), "source").filter("doc_id % 6 = 0")
    return sampling.design_weights(framed, ["source"], "frame").select("doc_id", "frame", "sampling_weight")


@query("SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 5 AS fold FROM labels")
def kfold_deal(spark: SparkSession, d: str) -> DataFrame:
    return rank.deal(table(spark, d, "labels").select("doc_id", "quality"), ["quality"], [F.col("doc_id")], 5)


@query(f"SELECT doc_id, lang, r AS round FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {MD5.format('bal')}, doc_id) AS r FROM documents) WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))")
def balanced_buckets(spark: SparkSession, d: str) -> DataFrame:
    return sampling.balanced(table(spark, d, "documents").select("doc_id", "lang"), ["lang"], "bal", "doc_id")


@query(f"""WITH r AS (SELECT doc_id, expected, (row_number() OVER (PARTITION BY expected ORDER BY {MD5.format('mix')}, doc_id) - 1) // CASE expected WHEN 'EVASIVE' THEN 2 ELSE 1 END AS round FROM (WITH {GOLD} SELECT * FROM gold)),
m AS (SELECT min(n // CASE expected WHEN 'EVASIVE' THEN 2 ELSE 1 END) AS k FROM (SELECT expected, count(*) AS n FROM r GROUP BY expected)) SELECT doc_id, expected, CAST(round AS BIGINT) AS round FROM r WHERE round < (SELECT k FROM m)""")
def evasive_mix(spark: SparkSession, d: str) -> DataFrame:
    return sampling.mix_by_ratio(gold(spark, d), "expected", {"EVASIVE": 2, "COMPLETE": 1, "DENIAL": 1}, "mix", "doc_id")


@query(f"""SELECT doc_id, source FROM (SELECT doc_id, source, -ln(greatest((CAST(CAST('0x' || substr({MD5.format('w')}, 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0, 1e-12)) / greatest(CAST(n_chars AS DOUBLE), 1e-9) AS k FROM documents) ORDER BY k, doc_id LIMIT 60""")
def weighted_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.weighted_sample(table(spark, d, "documents").select("doc_id", "source", "n_chars"), F.col("n_chars").cast("double"), 60, "w", "doc_id").select("doc_id", "source")


@query(f"""WITH RECURSIVE o AS (SELECT doc_id, source, lang, row_number() OVER (ORDER BY {MD5.format('greedy')}, doc_id) AS r FROM documents),
f AS (SELECT CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS doc_id, false AS ok, CAST(0 AS BIGINT) AS pick, CAST([] AS VARCHAR[]) AS s, CAST([] AS VARCHAR[]) AS l UNION ALL
SELECT o.r, o.doc_id, k.ok, f.pick + CASE WHEN k.ok THEN 1 ELSE 0 END, CASE WHEN k.ok THEN list_append(f.s, o.source) ELSE f.s END, CASE WHEN k.ok THEN list_append(f.l, o.lang) ELSE f.l END
FROM f JOIN o ON o.r = f.r + 1, LATERAL (SELECT len(list_filter(f.s, lambda x: x IS NOT DISTINCT FROM o.source)) < 5 AND len(list_filter(f.l, lambda x: x IS NOT DISTINCT FROM o.lang)) < 40 AS ok) k WHERE f.pick < 80)
SELECT doc_id, source, lang, pick FROM f JOIN documents USING (doc_id) WHERE ok""")
def greedy_capped_selection(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    return sampling.select_capped(docs, [X.hash_order("greedy", F.col("doc_id"))], {"source": 5, "lang": 40}, 80, "doc_id")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount * 400 AS d, l_tax * 500 AS t FROM lineitem), n AS (SELECT *, (q + d + t) / 3 AS m FROM s), z AS (SELECT *, sqrt(((q - m) * (q - m) + (d - m) * (d - m) + (t - m) * (t - m)) / 3) AS sd FROM n), k AS (SELECT l_orderkey, l_linenumber, round((q - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS a, round((d - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS b, round((t - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS c FROM z)
SELECT l_orderkey, l_linenumber, CASE WHEN a = greatest(a, b, c) THEN 'COMPLETE' WHEN b = greatest(a, b, c) THEN 'DENIAL' ELSE 'EVASIVE' END AS label, round(greatest(a, b, c) - (a + b + c - greatest(a, b, c) - least(a, b, c)), 6) AS margin FROM k""")
def score_normalise_argmax(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), (F.col("l_discount") * 400).alias("d"), (F.col("l_tax") * 500).alias("t"))
    z = scores.normalize([F.col(c) for c in "qdt"], "z")
    rows = rows.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(n) for c, n in zip(z, "abc", strict=True)])
    three = [F.col(c) for c in "abc"]
    rest = F.col("a") + F.col("b") + F.col("c") - F.greatest(*three) - F.least(*three)
    return rows.select("l_orderkey", "l_linenumber", scores.argmax(three).alias("label"), F.round(F.greatest(*three) - rest, 6).alias("margin"))


@query(f"""{JOINED}, p AS (SELECT doc_id, lang, expected, (n_chars % 97) / 97.0 AS x, (n_chars % 89) / 89.0 AS y, (n_chars % 83) / 83.0 AS z FROM joined), g AS (SELECT a.i * 9 + b.i AS n, CAST(-1.0 + a.i * 0.25 AS DOUBLE) AS cb, CAST(-1.0 + b.i * 0.25 AS DOUBLE) AS eb FROM range(9) a(i) CROSS JOIN range(9) b(i)),
o AS (SELECT n, cb, eb, expected, CASE WHEN x + cb >= y AND x + cb >= z + eb THEN 'COMPLETE' WHEN y >= z + eb THEN 'DENIAL' ELSE 'EVASIVE' END AS o FROM p CROSS JOIN g),
m AS (SELECT n, cb, eb, count(*) FILTER (expected = o) AS correct, count(*) FILTER ((expected = 'COMPLETE') = (o = 'COMPLETE')) AS "binary", count(*) FILTER (expected <> 'COMPLETE' AND o = 'COMPLETE') AS fp, count(*) FILTER (expected = 'COMPLETE' AND o <> 'COMPLETE') AS fn, count(*) FILTER (expected = 'EVASIVE' AND o = 'EVASIVE') AS evasive FROM o GROUP BY 1, 2, 3)
SELECT * FROM m ORDER BY correct DESC, "binary" DESC, evasive DESC, fp, fn, n LIMIT 1""")
def grid_calibration(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    rows = joined(spark, d).select("expected", ((n % 97) / 97.0).alias("x"), ((n % 89) / 89.0).alias("y"), ((n % 83) / 83.0).alias("z"))
    steps = [i * 0.25 - 1.0 for i in range(9)]
    return scores.bias_search(rows, [F.col(c) for c in "xyz"], "expected", steps, steps).drop("weight").withColumnsRenamed({"complete_bias": "cb", "evasive_bias": "eb"})


CENTROIDS = """x AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM x GROUP BY 1, 2), l AS (SELECT label, sqrt(sum(m * m)) AS len FROM m GROUP BY label)"""


@query(f"WITH {CENTROIDS} SELECT a.label AS \"left\", b.label AS \"right\", round(sum(a.m * b.m) / (la.len * lb.len), 4) AS cosine FROM m a JOIN m b ON a.i = b.i AND a.label < b.label JOIN l la ON la.label = a.label JOIN l lb ON lb.label = b.label GROUP BY a.label, b.label, la.len, lb.len")
def centroid_cosine(spark: SparkSession, d: str) -> DataFrame:
    c = embed.centroids(table(spark, d, "embeddings"), "label", "embedding")
    return embed.centroid_cosines(c, "label").withColumn("cosine", F.round("cosine", 4))


@query("SELECT 'k' AS field, count(*) AS n FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_profile(spark: SparkSession, d: str) -> DataFrame:
    return schema_profile(table(spark, d, "events"), "props")


@query("SELECT coalesce(json_extract_string(props, '$.k'), '[missing]') AS value, count(*) AS n FROM events GROUP BY 1")
def json_values(spark: SparkSession, d: str) -> DataFrame:
    return field_values_of(table(spark, d, "events"), "props", "k")


@query("SELECT coalesce(source, 'TOTAL') AS source, CAST(sum(n_chars // 4) AS BIGINT) AS tokens FROM documents GROUP BY ROLLUP (source)")
def rollup_tokens(spark: SparkSession, d: str) -> DataFrame:
    return report.token_totals(table(spark, d, "documents").select("source", F.expr("n_chars div 4").alias("t")), "source", "t")


@query("""WITH p AS (SELECT s_suppkey, s_nationkey, 1 + s_nationkey % 25 AS brand, s_acctbal FROM supplier), m AS (SELECT p_partkey, s_suppkey, p_retailprice * (1 + s_nationkey) / 3600 AS cost, row_number() OVER (PARTITION BY p_partkey ORDER BY p_retailprice * (1 + s_nationkey) / 3600, s_suppkey) AS r FROM part JOIN p ON regexp_matches(p_brand, '^Brand#' || brand || '$') AND s_acctbal >= p_size * 10)
SELECT p_partkey, s_suppkey, round(cost, 6) AS cost FROM m WHERE r = 1""")
def cost_rank_theta(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", F.concat(F.lit("^Brand#"), (1 + F.col("s_nationkey") % 25).cast("string"), F.lit("$")).alias("pattern"))
    offers = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    cost = scores.run_cost(F.col("p_retailprice"), 1 + F.col("s_nationkey"))
    best = recon.theta_first(offers, p, "p_brand", "pattern", F.col("p_size") * 10, F.col("s_acctbal"), ["s_nationkey"], cost, "s_suppkey", "p_partkey")
    return best.select("p_partkey", "s_suppkey", F.round(cost, 6).alias("cost"))


@query(r"SELECT doc_id, len(regexp_extract_all(CASE WHEN doc_id % 4 = 0 THEN text || '中文' || doc_id || '漢字' ELSE text END, '[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2EBEF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]+')) AS spans FROM documents")
def cjk_spans(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("中文"), F.col("doc_id").cast("string"), F.lit("漢字"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(X.cjk_spans(text)).cast("long").alias("spans"))


@query("SELECT p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) > 1 AS again FROM part) ORDER BY again, p_retailprice DESC, p_partkey LIMIT 40")
def diverse_topk(spark: SparkSession, d: str) -> DataFrame:
    return rank.diverse(table(spark, d, "part"), "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], 40).select("p_partkey", "p_brand")


@query("""WITH l AS (SELECT o_orderkey AS key, 'panel' AS layer, o_orderstatus AS label, 0 AS p FROM orders UNION ALL SELECT l_orderkey, 'rerun', min(l_returnflag), 1 FROM lineitem GROUP BY 1 UNION ALL SELECT o_orderkey, 'human', 'H', 2 FROM orders WHERE o_orderkey % 9 = 0) SELECT key, layer, label FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY p DESC) = 1""")
def override_layers(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    panel = o.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("label"))
    rerun = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.min("l_returnflag").alias("label"))
    human = o.filter("o_orderkey % 9 = 0").select(F.col("o_orderkey").alias("key"), F.lit("H").alias("label"))
    return recon.override_layers([("panel", panel), ("rerun", rerun), ("human", human)], "key").select("key", "layer", "label")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS in_window FROM events")
def rolling_rate(spark: SparkSession, d: str) -> DataFrame:
    return rank.rolling_count(table(spark, d, "events"), ["user_id"], "ts", 3600).select("event_id", "in_window")


@query("SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(e, "ts", "1 hour", "1 hour", "event_type").select(F.col("window.start").cast("long").alias("start"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, s""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(recon.one()).select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


@query("""WITH e AS (SELECT *, event_type = 'error' AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS g FROM events), r AS (SELECT user_id, g, count(*) AS n FROM e WHERE f GROUP BY 1, 2) SELECT user_id, max(n) AS longest_run FROM r GROUP BY 1""")
def error_runs(spark: SparkSession, d: str) -> DataFrame:
    return rank.runs_of(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "error")


@query("WITH s AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT " + ", ".join(f"CAST(max(CASE WHEN i = CAST(floor((n - 1) * {q}) AS BIGINT) THEN n_chars END) AS DOUBLE) AS p{q * 100:g}" for q in (0.5, 0.9, 0.95, 0.99)) + " FROM s")
def length_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return rank.index_percentile(table(spark, d, "documents"), "n_chars", (0.5, 0.9, 0.95, 0.99))


@query("""WITH q AS (SELECT DISTINCT n_chars % 20 AS question_id, lang FROM documents) SELECT question_id FROM q GROUP BY question_id HAVING count(*) = (SELECT count(DISTINCT lang) FROM documents)""")
def common_questions(spark: SparkSession, d: str) -> DataFrame:
    return sampling.common_questions(table(spark, d, "documents").select((F.col("n_chars") % 20).alias("question_id"), "lang"), "question_id", "lang")


@query("""WITH r AS (SELECT user_id AS id, (ARRAY['COMPLETE', 'DENIAL', 'EVASIVE'])[1 + user_id % 3] AS expected, (ARRAY['COMPLETE', 'DENIAL', 'EVASIVE'])[1 + event_id % 3] AS observed, CAST(value AS BIGINT) AS tokens, event_id FROM events),
c AS (SELECT id, expected, first(event_id ORDER BY tokens, event_id) AS chosen FROM r WHERE observed = expected GROUP BY 1, 2), w AS (SELECT id, observed AS rejected_label, first(event_id ORDER BY tokens, event_id) AS rejected, count(*) AS n_wrong FROM r WHERE observed <> expected GROUP BY 1, 2)
SELECT id, expected, CAST(chosen AS VARCHAR) AS chosen, rejected_label, CAST(rejected AS VARCHAR) AS rejected, n_wrong, expected || '->' || rejected_label AS boundary FROM c JOIN w USING (id)""")
def preference_pairs(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in L.LABELS])
    pick = lambda c: names[(F.col(c) % 3).cast("int")]
    r = table(spark, d, "events").select(F.col("user_id").alias("id"), pick("user_id").alias("expected"), pick("event_id").alias("observed"), F.rint("value").cast("long").alias("generated_tokens"), F.col("event_id").alias("rollout_index"), F.col("event_id").cast("string").alias("raw_judge_response"))
    sources = r.select("id", "expected").distinct()
    tokens = F.col("generated_tokens")
    shortest = F.struct(tokens.isNull(), tokens, "rollout_index")  # nulls last, as in SQL
    return recon.preference_pairs(sources, r, shortest).select("id", "expected", "chosen", "rejected_label", "rejected", "n_wrong", "boundary")


@query("""WITH s AS (SELECT doc_id, source, lang, quality, CASE WHEN quality IS NULL THEN 'missing_gold' WHEN doc_id % 3 = 0 THEN 'missing_votes' END AS skip FROM documents LEFT JOIN labels USING (doc_id)) SELECT coalesce(skip, 'used') AS reason, count(*) AS n FROM s GROUP BY 1""")
def join_with_reasons(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    votes_side = docs.filter("doc_id % 3 <> 0").select("doc_id")
    out = recon.join_with_reasons(docs, [("gold", table(spark, d, "labels").select("doc_id", "quality")), ("votes", votes_side)], "doc_id")
    return out.groupBy(F.coalesce("skip", F.lit("used")).alias("reason")).agg(recon.one())


@query(f"""WITH {JUDGES} SELECT doc_id, CASE WHEN c IS NULL OR c LIKE 'ERROR%' THEN a ELSE c END AS label, CASE WHEN c IS NULL OR c LIKE 'ERROR%' THEN 'fallback' ELSE 'primary' END AS source FROM judged""")
def merge_recovered(spark: SparkSession, d: str) -> DataFrame:
    rows = judged(spark, d)
    bad = F.col("label").isNull() | F.col("label").startswith("ERROR")
    out = recon.merge_recovered(rows.select("doc_id", F.col("c").alias("label")), rows.select("doc_id", F.col("a").alias("label")), "doc_id", "label", bad)
    return out.select("doc_id", "label", F.col("provenance.source").alias("source"))


@query("""WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('blk|' || doc_id), doc_id) - 1 AS step_index FROM documents), s AS (SELECT * FROM r WHERE step_index < 20) SELECT doc_id, lang, step_index, row_number() OVER (PARTITION BY step_index ORDER BY md5('pos|' || doc_id)) - 1 AS step_position FROM s""")
def step_blocks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return rank.step_blocks(docs, ["lang"], [X.hash_order("blk", F.col("doc_id")), F.col("doc_id")], X.hash_order("pos", F.col("doc_id")), 20)


@query("SELECT CASE WHEN event_type = 'error' THEN 'ERROR' WHEN value > 20 THEN 'COMPLETE' ELSE 'EVASIVE' END AS label, count(*) AS n FROM events GROUP BY 1")
def follow_stream(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.follow import follow_once

    return follow_once(spark, d)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return accuracy_grouping_sets(spark, d)


__all__ = ["QUERIES", "SQL", "flagship"]

"""Queries of searches over grids, brackets, surveys, lemmas, nested texts, cross tables and numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import hash_order
from ..operators import brackets, recon, report, rows, scores, surveys
from ..sources import numbered
from ..sources.scratch import scratch_path, written
from .catalog import JOINED, JUDGES, joined, judged
from .registry import query, table

# -- grids -------------------------------------------------------------------------------------------------------------

_STEPS = ([i * 0.125 - 0.5 for i in range(9)], [i * 0.0625 - 0.5 for i in range(17)], [i / 10 for i in range(11)])
_TWO = "(n_chars % 97) / 97.0 AS c1, (n_chars % 89) / 89.0 AS d1, (n_chars % 83) / 83.0 AS e1, (n_chars % 79) / 79.0 AS c2, (n_chars % 73) / 73.0 AS d2, (n_chars % 71) / 71.0 AS e2"
_COUNTS = """count(*) FILTER (expected = o) AS correct, count(*) FILTER ((expected = 'COMPLETE') = (o = 'COMPLETE')) AS "binary", count(*) FILTER (expected <> 'COMPLETE' AND o = 'COMPLETE') AS fp, count(*) FILTER (expected = 'COMPLETE' AND o <> 'COMPLETE') AS fn, count(*) FILTER (expected = 'EVASIVE' AND o = 'EVASIVE') AS evasive"""
_LABEL = "CASE WHEN d - c <= cb + 1e-9 AND e - c <= cb - eb + 1e-9 THEN 'COMPLETE' WHEN d - e >= eb - 1e-9 THEN 'DENIAL' ELSE 'EVASIVE' END"


def _two_scores(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    return joined(spark, d).select("doc_id", "lang", "expected", *[((n % m) / float(m)).alias(c) for c, m in (("c1", 97), ("d1", 89), ("e1", 83), ("c2", 79), ("d2", 73), ("e2", 71))])


@query(f"""{JOINED}, p AS (SELECT expected, {_TWO} FROM joined), g AS (SELECT (w.i * 9 + a.i) * 17 + b.i AS n, w.i / 10.0 AS weight, a.i * 0.125 - 0.5 AS cb, b.i * 0.0625 - 0.5 AS eb FROM range(11) w(i), range(9) a(i), range(17) b(i)),
s AS (SELECT g.*, expected, weight * c1 + (1 - weight) * c2 AS c, weight * d1 + (1 - weight) * d2 AS d, weight * e1 + (1 - weight) * e2 AS e FROM p CROSS JOIN g), o AS (SELECT n, weight, cb, eb, expected, {_LABEL} AS o FROM s)
SELECT n, round(CAST(weight AS DOUBLE), 6) AS weight, CAST(cb AS DOUBLE) AS complete_bias, CAST(eb AS DOUBLE) AS evasive_bias, {_COUNTS} FROM o GROUP BY n, weight, cb, eb""")
def blend_grid(spark: SparkSession, d: str) -> DataFrame:
    """The counts of every weight and pair of biases."""
    p = _two_scores(spark, d)
    first, second = ([F.col(f"{x}{i}") for x in "cde"] for i in (1, 2))
    return scores.bias_counts(p, first, "expected", *_STEPS[:2], second=second, weights=_STEPS[2]).withColumn("weight", F.round("weight", 6))


@query(f"""{JOINED}, p AS (SELECT lang, expected, {_TWO} FROM joined), g AS (SELECT (w.i * 9 + a.i) * 17 + b.i AS n, w.i / 10.0 AS weight, a.i * 0.125 - 0.5 AS cb, b.i * 0.0625 - 0.5 AS eb FROM range(11) w(i), range(9) a(i), range(17) b(i)),
s AS (SELECT g.*, lang, expected, weight * c1 + (1 - weight) * c2 AS c, weight * d1 + (1 - weight) * d2 AS d, weight * e1 + (1 - weight) * e2 AS e FROM p CROSS JOIN g), o AS (SELECT lang, n, weight, cb, eb, expected, {_LABEL} AS o FROM s),
m AS (SELECT lang, n, weight, cb, eb, {_COUNTS} FROM o GROUP BY lang, n, weight, cb, eb)
SELECT lang, n, round(CAST(weight AS DOUBLE), 6) AS weight, CAST(cb AS DOUBLE) AS complete_bias, CAST(eb AS DOUBLE) AS evasive_bias, correct, "binary", fp, fn, evasive FROM m QUALIFY row_number() OVER (PARTITION BY lang ORDER BY "binary" DESC, fp, correct DESC, evasive DESC, fn, n) = 1""")
def blend_search(spark: SparkSession, d: str) -> DataFrame:
    """The best weight and biases of each language, few false completes first."""
    first, second = ([F.col(f"{x}{i}") for x in "cde"] for i in (1, 2))
    best = scores.bias_search(_two_scores(spark, d), first, "expected", *_STEPS[:2], second=second, weights=_STEPS[2], group=["lang"], objective="complete_low_fp")
    return best.withColumn("weight", F.round("weight", 6))


# -- brackets and surveys ----------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE s AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY md5('seat|' || doc_id), doc_id) - 1 AS seat, count(*) OVER (PARTITION BY source) AS n FROM documents),
b AS (SELECT source, doc_id, n_chars, seat, n AS open, n, 0 AS won, 0 AS byes FROM s
 UNION ALL SELECT l.source, CASE WHEN k THEN l.doc_id ELSE r.doc_id END, CASE WHEN k THEN l.n_chars ELSE r.n_chars END, l.seat // 2, (l.open + 1) // 2, l.n, CASE WHEN k THEN l.won ELSE r.won END + CASE WHEN r.doc_id IS NULL THEN 0 ELSE 1 END, CASE WHEN k THEN l.byes ELSE r.byes END + CASE WHEN r.doc_id IS NULL THEN 1 ELSE 0 END
 FROM b l LEFT JOIN b r ON r.source IS NOT DISTINCT FROM l.source AND r.seat = l.seat + 1, LATERAL (SELECT r.doc_id IS NULL OR coalesce((l.n_chars * 7 + r.n_chars * 3) % 5 < 3, true) AS k) WHERE l.seat % 2 = 0 AND l.open > 1)
SELECT source, doc_id, CAST(won AS INTEGER) AS matches_won, CAST(byes AS INTEGER) AS byes, n AS candidates FROM b WHERE open = 1""")
def best_answers(spark: SparkSession, d: str) -> DataFrame:
    """Sources as questions, documents as answers; the comparison depends on both and on who sits left."""
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars", hash_order("seat", F.col("doc_id")).alias("order"))
    out = brackets.single_elimination(docs, "source", ["order", "doc_id"], lambda left, right: (left["n_chars"] * 7 + right["n_chars"] * 3) % 5 < 3)
    return out.select("source", "doc_id", "matches_won", "byes", "candidates")


#: Lines that a task of the survey holds at most, but for the unevenness of hashes.
_LINES_A_TASK = 250_000


@query("""WITH a AS (SELECT l_orderkey, o_orderpriority AS survey, l_linenumber AS i, CAST(l_quantity AS BIGINT) % 7 AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
r AS (SELECT DISTINCT l_orderkey, survey FROM a), q AS (SELECT survey, i, CASE WHEN i = 7 THEN '' WHEN i % 2 = 0 THEN 'even' ELSE 'odd' END AS category, (i + length(survey)) % 3 = 0 AS inverted FROM (SELECT DISTINCT survey FROM a), range(1, 8) t(i)),
e AS (SELECT r.l_orderkey AS respondent, survey, category, CASE WHEN v BETWEEN 1 AND 5 THEN CASE WHEN inverted THEN 6 - v ELSE v END END AS v FROM r JOIN q USING (survey) LEFT JOIN (SELECT l_orderkey, i, max(v) AS v FROM a GROUP BY 1, 2) x ON x.l_orderkey = r.l_orderkey AND x.i = q.i)
SELECT respondent, survey, category, count(*) AS items, count(v) AS answered, CASE WHEN count(v) > 0 AND count(*) - count(v) <= 0.5 * count(*) THEN round(avg(v), 6) END AS score FROM e GROUP BY 1, 2, 3""")
def survey_scoring(spark: SparkSession, d: str) -> DataFrame:
    """Section 2.15: orders as respondents, their priorities as surveys, lines as answers; some lie off the scale, some are missing."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // _LINES_A_TASK)  # a task's memory stays as tables grow
    li = lines.select("l_orderkey", "l_linenumber", "l_quantity").repartition(n, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_quantity").cast("long") % 7).alias("v"))
    given = li.groupBy(F.col("l_orderkey").alias("respondent")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("i"), F.col("l_linenumber").cast("string")), "v"))).alias("answers"))
    orders = orders.select(F.col("o_orderkey").alias("respondent"), F.col("o_orderpriority").alias("survey")).repartition(n, "respondent")
    item = lambda i: F.struct(F.concat(F.lit("i"), i.cast("string")).alias("id"), F.when(i == 7, F.lit(None)).when(i % 2 == 0, "even").otherwise("odd").alias("category"), ((i + F.length("survey")) % 3 == 0).alias("inversion"))
    made = orders.select("survey").distinct().select(F.col("survey").alias("name"), F.struct(F.lit(1).alias("min"), F.lit(5).alias("max")).alias("scale"), F.transform(F.sequence(F.lit(1), F.lit(7)), item).alias("items"))
    return surveys.survey_scores(given.join(orders, "respondent"), made).withColumn("score", F.round("score", 6))


# -- texts -------------------------------------------------------------------------------------------------------------


def _lemma_sql(w: str) -> str:
    quoted = lambda x: f"'{x}'"
    cases = [f"WHEN {w} = {quoted(a)} THEN {quoted(b)}" for a, b in X.IRREGULAR.items()] + [f"WHEN suffix({w}, {quoted(e)}) THEN {w}" for e in X.SINGULARS]
    cases += [f"WHEN suffix({w}, {quoted(e)}) AND length({w}) >= {len(e) + least} THEN left({w}, length({w}) - {len(e)}) || {quoted(s)}" for e, s, least in X.PLURALS]
    return f"CASE {' '.join(cases)} ELSE {w} END"


_STOP = ("the", "of", "and", "a", "to", "in", "is", "der", "die", "und", "le", "la", "de", "et")


@query(rf"""WITH t AS (SELECT doc_id, source, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_'']+'), lambda w: regexp_full_match(w, '\p{{L}}+') AND NOT list_contains({list(_STOP)!r}, w)) AS w FROM documents),
l AS (SELECT doc_id, source, list_transform(w, lambda w: {_lemma_sql("w")}) AS w FROM t), s AS (SELECT source, len(w) AS n, len(list_distinct(w)) AS v FROM l),
p AS (SELECT source, count(*) AS n, count(DISTINCT x) AS v FROM (SELECT source, unnest(w) AS x FROM l) GROUP BY source)
SELECT s.source, count(*) AS texts, any_value(p.n) AS words, any_value(p.v) AS lemmas, round(avg(CASE WHEN s.n > 0 THEN s.v / sqrt(s.n) ELSE 0 END), 6) AS mean_root_ttr, round(avg(CASE WHEN s.n > 1 AND s.v > 1 THEN (ln(s.n) - ln(s.v)) / (ln(s.n) * ln(s.n)) ELSE 0 END), 6) AS mean_maas, round(any_value(p.v) / sqrt(any_value(p.n)), 6) AS global_root_ttr
FROM s JOIN p ON p.source = s.source GROUP BY s.source""")
def lemma_diversity(spark: SparkSession, d: str) -> DataFrame:
    """Section 2.11, A25 to A27: lexical diversity of lemmas, stop words left out."""
    once = X.let(X.lemmas(F.coalesce("text", F.lit("")), _STOP), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.array_distinct(w).alias("w")))
    each = written(table(spark, d, "documents").filter("source IS NOT NULL").select("source", once.alias("t")).select("source", "t.n", F.size("t.w").cast("long").alias("v"), "t.w"), "lemmas")
    means = [F.round(F.avg(f(F.col("n"), F.col("v"))), 6).alias(name) for name, f in (("mean_root_ttr", X.root_ttr), ("mean_maas", X.maas))]
    kinds = each.select("source", F.explode("w").alias("x")).distinct().groupBy("source").agg(recon.one("lemmas"))
    out = each.groupBy("source").agg(recon.one("texts"), F.sum("n").alias("words"), *means).join(kinds, "source")
    return out.select("source", "texts", "words", "lemmas", "mean_root_ttr", "mean_maas", F.round(F.col("lemmas") / F.sqrt("words"), 6).alias("global_root_ttr"))


_RUN = r"[\x{3000}-\x{303F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{20000}-\x{2EBEF}]+"


@query(rf"""WITH t AS (SELECT doc_id, doc_id % 3 AS k, replace(coalesce(text, ''), '. ', '。中 ') || CASE WHEN doc_id % 2 = 0 THEN '、' ELSE '' END AS t FROM documents),
s AS (SELECT *, regexp_extract_all(t, '{_RUN}') AS hits, string_split_regex(t, '{_RUN}') AS parts FROM t), u AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM s),
x AS (SELECT doc_id, k, t, hits[i] AS match_text, CAST(coalesce(list_sum(list_transform(parts[1:i], lambda p: length(p))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda p: length(p))), 0) AS BIGINT) AS start FROM u)
SELECT doc_id, CASE k WHEN 0 THEN '$' WHEN 1 THEN 'choices[0].message.content' ELSE 'extra.a.b[1][0].c.d.e.text' END AS field_path, CAST(start AS BIGINT) AS start, match_text, CASE WHEN start > 60 THEN '…' ELSE '' END || substr(t, greatest(start - 60, 0) + 1, start + length(match_text) + 60 - greatest(start - 60, 0)) || CASE WHEN start + length(match_text) + 60 < length(t) THEN '…' ELSE '' END AS snippet FROM x""")
def cjk_report(spark: SparkSession, d: str) -> DataFrame:
    """P5, F11, section 2.13: every run of CJK characters in whole texts, at depths from none to eight."""
    text = F.concat(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit("。中 ")), F.when(F.col("doc_id") % 2 == 0, "、").otherwise(""))
    leaf = F.struct(F.struct(F.struct(F.struct(F.col("t").alias("text")).alias("e")).alias("d")).alias("c"), F.lit(1).alias("n"))
    deep = F.to_json(F.struct(F.lit("x").alias("id"), F.struct(F.struct(F.array(F.array(F.lit(None).cast(leaf_type())), F.array(leaf)).alias("b")).alias("a")).alias("extra")))
    usual = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("t").alias("content")).alias("message"), F.lit("stop").alias("finish_reason"))).alias("choices")))
    alone = F.regexp_extract(F.to_json(F.struct("t")), r"(?s)^\{\"t\":(.*)\}$", 1)
    docs = table(spark, d, "documents").select("doc_id", text.alias("t"))
    body = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, alone).when(F.col("doc_id") % 3 == 1, usual).otherwise(deep).alias("j"))
    return rows.cjk_report(body, "j", "doc_id").withColumn("start", F.col("start").cast("long"))


def leaf_type() -> str:
    return "struct<c:struct<d:struct<e:struct<text:string>>>,n:int>"


# -- reports and lines -------------------------------------------------------------------------------------------------


@query(f"""WITH {JUDGES}, j AS (SELECT coalesce(lang, 'none') AS lang, a, coalesce(c, 'none') AS c, n_chars FROM judged), v AS (SELECT DISTINCT c FROM j),
g AS (SELECT CASE WHEN grouping(lang) = 1 THEN 'total' ELSE lang END AS lang, CASE WHEN grouping(c) = 1 THEN 'total' ELSE c END AS c, round(avg(n_chars), 6) AS m FROM j GROUP BY CUBE (lang, c))
SELECT lang, max(m) FILTER (c = 'COMPLETE') AS "COMPLETE", max(m) FILTER (c = 'DENIAL') AS "DENIAL", max(m) FILTER (c = 'ERROR_JUDGE_FORMAT') AS "ERROR_JUDGE_FORMAT", max(m) FILTER (c = 'EVASIVE') AS "EVASIVE", max(m) FILTER (c = 'none') AS "none", max(m) FILTER (c = 'total') AS total FROM g GROUP BY lang""")
def label_cross_table(spark: SparkSession, d: str) -> DataFrame:
    """Section 2.14: mean length by language and label, labels as measured columns, with totals."""
    return report.cross_table(judged(spark, d), "lang", "c", F.round(F.avg("n_chars"), 6))


@query(f"""{JOINED}, l AS (SELECT doc_id, unnest(['gold', 'a', 'b', 'c']) AS judge, unnest([expected, a, b, c]) AS label FROM joined), k AS (SELECT * FROM l WHERE label IS NOT NULL),
p AS (SELECT x.judge AS judge, y.judge AS other, round(100.0 * count(*) FILTER (x.label = y.label) / count(*), 6) AS pct FROM k x JOIN k y USING (doc_id) GROUP BY 1, 2)
SELECT judge, max(pct) FILTER (other = 'a') AS a, max(pct) FILTER (other = 'b') AS b, max(pct) FILTER (other = 'c') AS c, max(pct) FILTER (other = 'gold') AS gold FROM p GROUP BY judge""")
def agreement_heatmap(spark: SparkSession, d: str) -> DataFrame:
    """Section 2.14: agreement of each judge with each other and with gold, as a matrix."""
    long = joined(spark, d).select("doc_id", F.expr("stack(4, 'gold', expected, 'a', a, 'b', b, 'c', c) AS (judge, label)"))
    return report.agreement_matrix(long, "doc_id", "judge", "label")


@query("""SELECT doc_id, doc_id % 17 = 0 AS bad, CASE WHEN doc_id % 17 <> 0 THEN md5(coalesce(text, '')) END AS text_md5, true AS numbered FROM documents""")
def numbered_lines(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as JSON lines, replaced twice, read by ranges of 256 kB; one line in 17 is broken."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    path = scratch_path(spark, "numbered")
    line = F.to_json(F.struct("doc_id", "text"))
    numbered.replace_lines(docs.select(line.alias("line")), path)
    broken = F.when(F.col("doc_id") % 17 == 0, F.left(line, F.length(line) - 1)).otherwise(line)
    numbered.replace_lines(docs.select(broken.alias("line")), path)
    read = written(numbered.read_numbered(spark, path, 1 << 18), "numbered-read")
    files = read.groupBy("file").agg(F.count_distinct("line_number").alias("kinds"), F.max("line_number").alias("last"), recon.one())
    numbers = files.agg(F.bool_and((F.col("kinds") == F.col("n")) & (F.col("last") == F.col("n"))).alias("numbered"))
    bad = numbered.malformed(read).select("file", "line_number", F.lit(True).alias("bad"))
    each = read.join(bad, ["file", "line_number"], "left").select(F.regexp_extract("line", r'^\{"doc_id":(\d+)', 1).cast("long").alias("doc_id"), F.coalesce("bad", F.lit(False)).alias("bad"), F.get_json_object("line", "$.text").alias("t"))
    return each.select("doc_id", "bad", F.when(~F.col("bad"), F.md5("t")).alias("text_md5")).crossJoin(F.broadcast(numbers))

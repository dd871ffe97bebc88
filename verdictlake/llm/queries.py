"""The production query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_cascade

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = quality_cascade(_table(spark, sf_dir, "documents").select("doc_id", "text"), report=base, already=failed)
    return out.select("doc_id", *base, failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    out = pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary=vocabulary())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract_text

    return extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import shared_passages

    return shared_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_texts

    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"), held_out=held_out)


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, num=85, den=100)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import BASE, find_pii

    out = find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")  # noqa: E731
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return out.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import line_dedup

    out = line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"), keys=("doc_id",), copy_column="copy")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import periodic_runs

    return periodic_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"), repeated=True)


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .turns import damaged, repair_conversations

    return repair_conversations(damaged(_table(spark, sf_dir, "conversations")))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import repeated_bytes

    return repeated_bytes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Query]:
    names = [n for n in globals() if n.startswith("op") and n[2].isdigit()]
    return {n: globals()[n] for n in sorted(names, key=lambda n: int(n[2:].split("_")[0]))}


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, l, translate(trim(l, e' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), first_holder AS (
  SELECT k, min(doc_id) AS keep FROM lines WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) < max(doc_id)
)
SELECT lines.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (keep < lines.doc_id) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (keep IS NULL OR keep >= lines.doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN first_holder USING (k) GROUP BY lines.doc_id
"""

OP10_SQL = r"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
m AS (SELECT source, n, power(CAST(n AS DOUBLE), 0.5) AS mass FROM n),
rate AS (SELECT source, round(1.0 * (SELECT sum(n) FROM m) * mass / (SELECT sum(mass) FROM m) / n, 9) AS rate FROM m),
split AS (SELECT d.*, rate, CAST(greatest(1, ceil(rate / 8.0)) AS BIGINT) AS draws FROM documents d JOIN rate r ON d.source IS NOT DISTINCT FROM r.source WHERE rate > 0),
drawn AS (SELECT *, rate / draws AS mean, unnest(range(draws)) AS draw FROM split),
u AS (SELECT *, CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || draw), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM drawn),
term AS (
  SELECT *, exp(-mean) AS p, exp(-mean) AS c, 0 AS k FROM u
  UNION ALL
  SELECT * EXCLUDE (p, c, k), p * mean / (k + 1), c + p * mean / (k + 1), k + 1 FROM term WHERE u >= c AND k < 49
), count_of AS (SELECT * EXCLUDE (p, c, k), max(k) AS k FROM term GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, draw * 48 + copy AS "copy" FROM (SELECT *, unnest(range(k)) AS copy FROM count_of)
"""


OP1_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
d AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d, range(3) x(k) GROUP BY doc_id),
s AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(text, '\P{Lu}', '', 'g')) AS n_upper, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR 100 * n_symbols > 30 * n_words OR (100 * n_upper > 40 * word_chars AND n_words >= 5) OR 100 * n_dup_lines > 50 * n_lines OR word_chars > 20 * n_words OR 2 * word_chars < 3 * n_words) AS kept FROM b
"""

OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i] || chr(10) || coalesce(w[i + 1], '') || chr(10) || coalesce(w[i + 2], '') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN ways l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.b AS component_id, c.b = d.doc_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) c ON c.a = d.doc_id
"""


def _op12_sql() -> str:
    """The edits as a forward recursion that keeps the least (cost, audit, text) of each state, one turn a step."""
    turn = "chr(10) || {0} || ':' || {1}"

    def option(state: str, put: int, letter: str, cost: str, added: str) -> str:
        return f"struct_pack(c := p.{state}.c + {5 * put} + {cost}, a := p.{state}.a || '{'I' * put}{letter}', t := p.{state}.t || {added})"

    def least(options: list[str]) -> str:
        return f"list_sort(list_filter([{', '.join(options)}], lambda x: x.c IS NOT NULL))[1]"

    own, user, assistant = (turn.format(*x) for x in (("r.role", "r.text"), ("'user'", "r.text"), ("'assistant'", "r.text")))
    cut = "CASE WHEN r.fault = 'truncated' THEN 5 ELSE 0 END"
    may = "CASE WHEN r.fault IN ('blank', 'duplicate') THEN NULL ELSE 0 END"
    keep = lambda x: f"CASE WHEN r.initial = '{x}' THEN 0 END + {may} + {cut}"  # noqa: E731
    role = f"1 + {may} + {cut}"
    put_user, put_assistant = "chr(10) || 'user:' || ", "chr(10) || 'assistant:' || "
    to_u = [option(q, n, letter, cost, (put_assistant if n else "") + text) for q, n in (("e", 0), ("s", 0), ("a", 0), ("u", 1)) for letter, cost, text in (("K", keep("u"), own), ("R", role, user))]
    to_a = [option(q, n, letter, cost, (put_user if n else "") + text) for q, n in (("u", 0), ("e", 1), ("s", 1), ("a", 1)) for letter, cost, text in (("K", keep("a"), own), ("R", role, assistant))]
    to_s = [option("e", 0, "K", keep("s"), own)]
    drop = lambda q: option(q, 0, "D", "2", "''")  # noqa: E731
    none = "struct_pack(c := CAST(NULL AS BIGINT), a := CAST(NULL AS VARCHAR), t := CAST(NULL AS VARCHAR))"
    ends = [option("e", 0, "", "0", "''"), option("a", 0, "", "0", "''"), option("u", 1, "", "0", "chr(10) || 'assistant:'"), option("s", 2, "", "0", "chr(10) || 'user:' || chr(10) || 'assistant:'")]
    return rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(key) + 1), lambda i: [CAST(ascii(key[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % 20 AS h FROM k),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS n FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN right(trim(text, e' 	

'), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS former FROM o),
s AS (SELECT conv_id, count(turn) AS n, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (former IS NOT NULL AND former || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS last FROM f GROUP BY conv_id),
p AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, struct_pack(c := CAST(0 AS BIGINT), a := '', t := '') AS e, {none} AS s, {none} AS u, {none} AS a FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT p.conv_id, p.i + 1, {least([drop("e")])}, {least([drop("s"), *to_s])}, {least([drop("u"), *to_u])}, {least([drop("a"), *to_a])} FROM p JOIN f r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1
), z AS (SELECT p.conv_id, {least(ends)} AS z, s.* EXCLUDE (conv_id, n, last) FROM p LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM p.conv_id WHERE p.i = coalesce(s.last, 0))
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(z.c AS BIGINT) AS cost, z.a AS audit, sha256(substr(z.t, 2)) AS repaired_sha256 FROM z
"""


OP12_SQL = _op12_sql()


def oracle_sql() -> dict[str, str]:
    return {"op12_turn_repair": OP12_SQL, "op1_quality_rules": OP1_SQL, "op7_neardup": OP7_SQL, "op9_line_dedup": OP9_SQL, "op10_mixing": OP10_SQL}

"""Operator 1: quality rules as a short-circuit cascade, ordered by rejections per cost on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, let, without, words

#: Rows on which costs and rejections are estimated.
SAMPLE_ROWS = 2000
SYMBOLS = "[#*$%&|<>]"


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def repeat_words_of(w: Column) -> Column:
    """Words inside 3-word windows that stand twice or more in the word array w, the first one included.

    Windows are compared by 64-bit hashes.  Only texts that have a repeated window sort theirs.
    """
    hashes = F.when(F.size(w) >= 3, F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(1))))

    def covered(h: Column) -> Column:
        def places(s: Column) -> Column:
            same = F.filter(s, lambda x, i: x["h"].eqNullSafe(F.get(s, i - 1)["h"]) | x["h"].eqNullSafe(F.get(s, i + 1)["h"]))
            return F.array_sort(F.transform(same, lambda x: x["i"]))

        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"))
        return F.aggregate(let(by_hash, places), F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), step)["n"]

    return F.coalesce(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0)), F.lit(0)).cast("long")


#: What statistics are made of, from the text.
SOURCES: dict[str, Callable[[Column], Column]] = {"text": lambda t: t, "words": words, "lines": _lines}
#: Each statistic: its source, and how it is made of that.
STATISTICS: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "n_words": ("words", F.size),
    "word_chars": ("words", lambda w: F.length(F.array_join(w, ""))),
    "n_symbols": ("text", lambda t: F.regexp_count(t, F.lit(SYMBOLS))),
    "n_upper": ("text", lambda t: F.regexp_count(t, F.lit("\\p{Lu}"))),
    "n_lines": ("lines", F.size),
    "n_dup_lines": ("lines", lambda a: F.size(a) - F.size(F.array_distinct(a))),
    "n_repeat_words": ("words", repeat_words_of),
}


def _make(name: str, known: dict[str, Column]) -> Column:
    source, f = STATISTICS[name]
    return f(known[source]).cast("long")


def _whole(name: str, text: Column) -> Column:
    """A statistic from the text alone."""
    source = STATISTICS[name][0]
    return let(SOURCES[source](text), lambda v: _make(name, {source: v}))


@dataclass(frozen=True)
class Rule:
    """Rejects a text where the expression over its statistics is true."""

    name: str
    rejects: str
    needs: tuple[str, ...]


def rules(min_words: int = 50) -> list[Rule]:
    """The rules of the production queries.  Each is a share of the text's own size, so long and short texts are held to the same."""
    return [
        Rule("short", f"n_words < {min_words}", ("n_words",)),
        Rule("repeated words", "100 * n_repeat_words > 50 * n_words", ("n_repeat_words", "n_words")),
        Rule("symbols", "100 * n_symbols > 30 * n_words", ("n_symbols", "n_words")),
        Rule("capitals", "100 * n_upper > 40 * word_chars AND n_words >= 5", ("n_upper", "word_chars", "n_words")),
        Rule("repeated lines", "100 * n_dup_lines > 50 * n_lines", ("n_dup_lines", "n_lines")),
        Rule("word length", "word_chars > 20 * n_words OR 2 * word_chars < 3 * n_words", ("word_chars", "n_words")),
    ]


def _condition(rule: Rule, known: dict[str, Column]) -> Column:
    """The rule's expression over statistics that are at hand."""
    text = rule.rejects
    for s in sorted(rule.needs, key=len, reverse=True):
        text = text.replace(s, f"{{{rule.needs.index(s)}}}")
    return _parse(text, [known[s] for s in rule.needs])


def cascade(ordered: list[Rule], known: dict[str, Column]) -> Column:
    """Name of the first rule that rejects, or null.

    known holds the text, and what has been made of it.  What a rule needs besides is made once, where the rules before it
    let the row pass, and stays at hand for the rules after it.
    """
    if not ordered:
        return F.lit(None).cast("string")
    rule = ordered[0]
    sources = [x for x in dict.fromkeys(STATISTICS[s][0] for s in rule.needs if s not in known) if x not in known]
    if sources:
        return let(SOURCES[sources[0]](known["text"]), lambda v: cascade(ordered, known | {sources[0]: v}))
    lacking = [s for s in rule.needs if s not in known]
    if lacking:
        return let(F.struct(*[_make(s, known).alias(s) for s in lacking]), lambda v: cascade(ordered, known | {s: v[s] for s in lacking}))
    return F.when(_condition(rule, known), F.lit(rule.name)).otherwise(cascade(ordered[1:], known))


def _parse(template: str, parts: list[Column]) -> Column:
    """Conditions of the form `a * x < b * y`, joined by AND or OR, as columns."""
    def term(t: str) -> Column:
        out = F.lit(1).cast("long")
        for f in t.split("*"):
            f = f.strip()
            out = out * (parts[int(f[1:-1])] if f[0] == "{" else F.lit(int(f)).cast("long"))
        return out

    def comparison(t: str) -> Column:
        for sign, make in ((">=", Column.__ge__), ("<", Column.__lt__), (">", Column.__gt__)):
            if sign in t:
                a, b = t.split(sign)
                return make(term(a), term(b))
        raise ValueError(t)

    whole = None
    for either in template.split(" OR "):
        part = None
        for both in either.split(" AND "):
            part = comparison(both) if part is None else part & comparison(both)
        whole = part if whole is None else whole | part
    return whole


def order_rules(docs: DataFrame, todo: list[Rule], *, text: str = "text", sample_rows: int = SAMPLE_ROWS, have: Sequence[str] = ()) -> list[tuple[Rule, float, float]]:
    """The rules in order, with the share of the rows still there that each rejects, and its seconds on the sample.

    On a kept sample of rows every source and statistic is timed, the quicker of two runs, and all verdicts are counted
    together.  The next rule is the one with most rejections, of rows that no rule before it rejects, for each second of what
    isn't made yet (`have` names statistics that are there anyway).  The order changes how much is computed, never a verdict.
    """
    n = docs.count()
    if not n:
        return [(r, 0.0, 0.0) for r in todo]
    sample = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).sample(min(1.0, 1.2 * sample_rows / n), seed=7).limit(sample_rows).repartition(1).persist(StorageLevel.MEMORY_AND_DISK)
    seconds: dict[str, float] = {}

    def clock(name: str, value: Column) -> None:
        took = []
        for _ in range(2):
            began = time.perf_counter()
            sample.agg(F.max(value)).collect()
            took.append(time.perf_counter() - began)
        seconds[name] = min(took)

    try:
        size = sample.count()
        if not size:
            return [(r, 0.0, 0.0) for r in todo]
        t = F.col("t")
        clock("text", F.length(t))
        for x in ("words", "lines"):
            clock(x, F.size(SOURCES[x](t)))
        needed = dict.fromkeys(s for r in todo for s in r.needs)
        for s in needed:
            clock(s, _whole(s, t))
        stats = sample.select(*[_whole(s, t).alias(s) for s in needed])
        verdicts = stats.groupBy(*[_condition(r, {s: F.col(s) for s in r.needs}).alias(f"r{i}") for i, r in enumerate(todo)]).agg(F.count(F.lit(1)).alias("n")).collect()  # sample_rows at most
    finally:
        sample.unpersist()
    idle = seconds["text"]
    least = 1e-5
    cost = {x: max(least, seconds[x] - idle) for x in ("words", "lines")} | {"text": 0.0}
    cost |= {s: max(least, seconds[s] - idle - cost[STATISTICS[s][0]]) for s in needed}
    made = {"text", *have, *(STATISTICS[s][0] for s in have)}
    left, out, rows = list(range(len(todo))), [], [(r.asDict(), r["n"]) for r in verdicts]
    while left:
        there = max(1, sum(k for _, k in rows))
        share = {i: sum(k for v, k in rows if v[f"r{i}"]) / there for i in left}
        price = {i: least + sum(cost[x] for x in {y for s in todo[i].needs if s not in made for y in (s, STATISTICS[s][0])} - made) for i in left}
        i = min(left, key=lambda j: (-share[j] / price[j], todo[j].name))
        out.append((todo[i], share[i], price[i]))
        made |= {y for s in todo[i].needs for y in (s, STATISTICS[s][0])}
        rows = [(v, k) for v, k in rows if not v[f"r{i}"]]
        left.remove(i)
    return out


def statistics(docs: DataFrame, *, text: str = "text", shown: Sequence[str] = tuple(STATISTICS)) -> DataFrame:
    """docs with statistics as columns; each array of words or lines is made once for a row."""
    docs = without(docs, *shown)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    names = {x: free_name(docs, f"__{x}") for x in dict.fromkeys(STATISTICS[s][0] for s in shown)}
    parts = docs.select(*columns, *[SOURCES[x](whole).alias(n) for x, n in names.items()])
    made = {x: F.col(n) for x, n in names.items()}
    return parts.select(*columns, *[(let(made["words"], lambda w: _make("n_repeat_words", {"words": w})) if s == "n_repeat_words" else _make(s, made)).alias(s) for s in shown])


def quality_cascade(docs: DataFrame, todo: list[Rule] | None = None, *, text: str = "text", report: Sequence[str] = (), already: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with `rejected_by`: the first rule of the cascade that rejects the row, null if none does.

    The rules run in the order of order_rules; a row that one rejects isn't looked at by the next, and what rules share is
    made once a row, where the first rule that needs it is reached.  `report` names statistics that become columns for all
    rows; rows for which `already`, over those columns, is true go by the name "base" without any further rule.  A null text
    counts as empty.  Columns of docs with the names of new ones are replaced.  Rows are never merged.
    """
    todo = todo or rules()
    ordered = [m[0] for m in order_rules(docs, todo, text=text, sample_rows=sample_rows, have=report)]
    if report:
        docs = statistics(docs, text=text, shown=report)
    docs = without(docs, "rejected_by")
    known = {"text": F.coalesce(F.col(f"`{text}`"), F.lit(""))} | {s: F.col(s) for s in report}
    verdict = cascade(ordered, known)
    return docs.withColumn("rejected_by", verdict if already is None else F.when(already, "base").otherwise(verdict))


__all__ = ["STATISTICS", "Rule", "cascade", "order_rules", "quality_cascade", "rules", "statistics"]

"""Judge labels: parsing, question types and rules over labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = ("COMPLETE", "DENIAL", "EVASIVE")
# The forms in which a judge may write a label.
_ANY = "(COMPLETE|DENIAL|EVASIVE)"
NAMED_LABEL = rf"(?i)\b(?:COMPLIANCE|FINAL\s+LABEL|LABEL|VERDICT)\s*:\s*[\[\(\"'`*]*\s*{_ANY}\b"
OWN_LINE_LABEL = rf"(?im)^\s*[\[\(\"'`*#>-]*\s*{_ANY}\s*[\]\)\"'`*.,!;:]*\s*$"
JUDGE_LABEL = r"(?i)COMPLIANCE:\s*\[?(COMPLETE|EVASIVE|DENIAL|INCOMPLETE)\]?"
LABEL_AFTER_COMPLIANCE = r"(?is)COMPLIANCE:\s*\[?\s*(?=COMPLETE|DENIAL|EVASIVE)"
THOUGHT = r"(?is)<\|channel>thought\b.*?<channel\|>"
JUDGE_ANALYSIS = r"(?is)ANALYSIS:\s*(.*?)(?:\nCOMPLIANCE:|\z)"


def is_label(label: Column) -> Column:
    return F.coalesce(label.isin(*LABELS), F.lit(False))


def _or_null(found: Column) -> Column:
    return F.when(found != "", found)


def judge_fields(text: Column) -> Column:
    """Struct (analysis, label) of a judge's answer."""
    analysis = F.when(text.rlike(JUDGE_ANALYSIS), F.btrim(F.regexp_extract(text, JUDGE_ANALYSIS, 1), F.lit(" \t\n\r\x0b\x0c"))).otherwise("<missing>")
    label = F.coalesce(F.upper(_or_null(F.regexp_extract(text, JUDGE_LABEL, 1))), F.lit("ERROR_JUDGE_FORMAT"))
    return F.struct(analysis.alias("analysis"), label.alias("label"))


def last_label(text: Column) -> Column:
    """The last label after the end of thought; UNPARSED while thought is still open."""
    lowered = F.lower(text)
    closed = F.contains(lowered, F.lit("</think>"))
    rest = F.when(closed, F.right(text, F.length(F.substring_index(lowered, "</think>", -1)))).otherwise(text)
    named = F.regexp_extract_all(rest, F.lit(NAMED_LABEL), F.lit(1))
    alone = F.regexp_extract_all(rest, F.lit(OWN_LINE_LABEL), F.lit(1))
    found = F.coalesce(F.try_element_at(named, F.lit(-1)), F.try_element_at(alone, F.lit(-1)))
    return F.when(~closed & text.rlike(r"(?i)^\s*<think\b"), "UNPARSED").otherwise(F.coalesce(F.upper(found), F.lit("UNPARSED")))


def first_label(text: Column) -> Column:
    """The first named label."""
    return F.coalesce(F.upper(_or_null(F.regexp_extract(text, NAMED_LABEL, 1))), F.lit("UNPARSED"))


def observed_label(text: Column, reasoning: Column, plain: str | None = None, decision: str | None = None) -> Column:
    """Struct (label, source): the content's label, else a plain one, else one from the reasoning.

    plain and decision are patterns with the label in group 1; a pattern that isn't given isn't tried.
    """
    content = last_label(text)
    pair = lambda label, source: F.struct(label.alias("label"), F.lit(source).alias("source"))
    last = lambda column, pattern: F.upper(F.try_element_at(F.regexp_extract_all(column, F.lit(pattern), F.lit(1)), F.lit(-1)))
    out = F.when(is_label(content), pair(content, "content"))
    if plain:
        out = out.when(is_label(last(text, plain)), pair(last(text, plain), "plain_label"))
    if decision:
        out = out.when(is_label(last(reasoning, decision)), pair(last(reasoning, decision), "reasoning_decision"))
    return out.otherwise(pair(content, "unparsed"))


def prefix_to_label(text: Column) -> Column:
    """The text up to its last label after `COMPLIANCE:`, thought spans kept; labels inside thought don't count; or null."""
    pieces, thoughts = F.split(text, THOUGHT, -1), F.regexp_extract_all(text, F.lit(THOUGHT), F.lit(0))
    places = F.sequence(F.lit(0), F.size(pieces) - 1)
    last = F.array_max(F.filter(places, lambda i: F.get(pieces, i).rlike(LABEL_AFTER_COMPLIANCE)))
    before = F.filter(places, lambda i: i < last)
    whole = F.array_join(F.transform(before, lambda i: F.concat(F.get(pieces, i), F.get(thoughts, i))), "")
    return F.when(last.isNotNull(), F.concat(whole, F.regexp_extract(F.get(pieces, last), rf"(?is)^(.*{LABEL_AFTER_COMPLIANCE})", 1)))


def question_type(question_id: Column) -> Column:
    """type1 to type4 by the last digit if no digit stands before it, else other."""
    return F.when(question_id.rlike(r"(?<![0-9])[1-4]$"), F.concat(F.lit("type"), F.right(question_id, F.lit(1)))).otherwise("other")


def question_type_or_unknown(question_id: Column) -> Column:
    """The same with the default `type?`."""
    return F.concat(F.lit("type"), F.coalesce(_or_null(F.regexp_extract(question_id, r"(?<!\d)([1-4])$", 1)), F.lit("?")))


def numeric_tail_type(question_id: Column) -> Column:
    """Question type by all digits at the end, as the shift report has it."""
    digits = F.regexp_extract(question_id, r"(\d+)$", 1)
    return F.when(digits != "", F.concat(F.lit("type"), digits)).otherwise("unknown")


def to_binary(label: Column, aliases: tuple[str, ...] = ("DENY", "DENIED", "REFUSE", "REFUSAL")) -> Column:
    """COMPLY or REFUSE, null for errors."""
    up = F.upper(F.trim(label))
    return F.when(up == "COMPLETE", "COMPLY").when(up.isin("DENIAL", "EVASIVE", *aliases), "REFUSE")


def adjudication_status(pool: Column, local: Column, judge: Column) -> Column:
    """Whom an adjudicating judge agrees with."""
    return F.when(~is_label(judge), "unparseable").when((judge == pool) & (judge == local), "all_agree").when(judge == pool, "judge_confirms_pool").when(judge == local, "judge_confirms_local").otherwise("judge_third_label")


def target_status(expected: Column, rejected: Column, adjudicated: Column) -> Column:
    """What became of a preference target."""
    return F.when(adjudicated == expected, "confirmed_original").when(adjudicated == rejected, "flipped_to_rejected").otherwise("third_label")


def complete_side(expected: Column, rejected: Column) -> Column:
    """Which side of the COMPLETE boundary a pair trains, or null."""
    expected, rejected = F.upper(expected), F.upper(rejected)
    return F.when((expected == "COMPLETE") & rejected.isin("DENIAL", "EVASIVE"), "true_complete_recovery").when(expected.isin("DENIAL", "EVASIVE") & (rejected == "COMPLETE"), "false_complete_suppression")


def preference_weight(expected: Column, observed: Column) -> Column:
    """Loss weight by the boundary that is crossed."""
    return F.when((observed == "COMPLETE") & (expected != "COMPLETE"), 2.0).when((expected == "COMPLETE") & (observed != "COMPLETE"), 1.5).otherwise(1.0)


def shaped_reward(observed: Column, answer: Column, correct: float = 1.0, wrong: float = 0.0, evasive: float = -1.0, unparsed: float = -0.5) -> Column:
    """Reward of a judged rollout."""
    return F.when(~is_label(observed), unparsed).when(observed == answer, correct).when((observed == "EVASIVE") & (answer != "EVASIVE"), evasive).otherwise(wrong)


def label_completion(raw: Column, label: Column, rendered: Column) -> Column:
    """The raw judge text if it parses to the label, else the rendered one."""
    return F.when(judge_fields(raw)["label"] == label, raw).otherwise(rendered)

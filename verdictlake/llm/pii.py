"""Operator 8: personal data by weak supervision: labelers vote, EM weighs them, and a span classifier is trained on the result."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, let, materialize, without

# The base patterns.  Possessive repeats and the look-behinds give the same leftmost matches without backtracking.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Further forms of personal data that are put to the vote.
MASKED = r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\{at\}) ?[a-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[a-z0-9-]++)++"
LOCAL = r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9]|[.-][0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
NAME = r"(?<![\p{L}\p{N}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Sr|Sra|Señor|Señora)\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){0,2}"
# Forms of keys that services publish, and values that are given to a word for a secret.
KEY = (
    r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35}|sk-[A-Za-z0-9_-]{20,}+"
    r"|eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)(?![A-Za-z0-9_-])|-----BEGIN [A-Z ]*+(?<=PRIVATE KEY)-----(?:[^-]*+-----END [A-Z ]*+-----)?"
)
VALUE = r"(?i)(?<![a-z0-9+/_.-])(?=[^\s\"'`,;<>]{8})(?<=(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?[ ]{0,2}[:=][ ]{0,2}[\"']?)[^\s\"'`,;<>]++"
# Loose forms, of which most matches are harmless: capitalised words in a row, bare numbers, strings that look like keys.
PERSON = r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++){1,2}+(?![\p{L}\p{N}])"
NUMBER = r"(?<![\p{L}\p{N}.,+/-])(?<![0-9] )[0-9](?:[ -]?[0-9]){8,18}+(?![\p{L}\p{N}])(?![ .,/-][0-9])"
OPAQUE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])"
BASE = ("email", "ip", "card", "phone")
LOOSE = ("person", "number", "opaque")
SECRETS = ("secret_key", "secret_value")
EXTRA = ("masked_email", "local_phone", "ssn", "iban", "name", *SECRETS, *LOOSE)
PATTERNS = dict(zip(BASE + EXTRA, (EMAIL, IP, CARD, PHONE, MASKED, LOCAL, SSN, IBAN, NAME, KEY, VALUE, PERSON, NUMBER, OPAQUE), strict=True))
#: What a text must hold for the pattern to be tried at all.
NEEDS = {"email": ("@",), "phone": ("+",), "secret_value": ("=", ":")}
# Gazetteers and context words.
DOMAINS = "com net org edu gov mil int info biz io co ai de fr es it nl uk us eu ch at be pt pl se no dk fi jp cn in br ru ca au mx test example invalid localhost"
GIVEN = "james john robert michael william david mary patricia jennifer linda elizabeth susan hans peter karl anna maria juan carlos luis pedro marie jean pierre paul sophie camille thomas martin laura julia"
NEAR = r"(?i)(?:e-?mail|mail to|contact|write to|call|phone|tel\b|tél|mobile|fax|whatsapp|card|visa|account|konto|iban|ssn|social security|ip address|\bip\b|host|reach|appel|ruf|llam|correo|name is|dear|signed|patient|attn)[^\n]{0,24}$"
AGAINST = r"(?i)(?:version|\bv\.?|release|order|invoice|isbn|issn|doi|section|chapter|page|figure|serial|part no|sku|tracking|hash|token|[=\"'#$])[^\n\p{L}]{0,3}$"

# Context words of secrets, and values that only stand for one.
NEAR_SECRET = r"(?i)(?:key|secret|token|passw|pwd|credential|auth|bearer|login)[^\n]{0,24}$"
AGAINST_SECRET = r"(?i)(?:example|sample|dummy|placeholder|sha1|sha256|md5|commit|checksum)[^\n]{0,12}$"
STAND_IN = r"(?i)^(?:your|example|sample|changeme|placeholder|null|none|true|false|x{4}|\*{3}|\$\{)"

#: Spans of each kind that the classifier is fitted on at most: those with the smallest hashes.
FIT_SPANS = 1000
#: What the classifier sees of a span, and how many values each feature has: length, shares of digits and of distinct
#: characters, whether 13 to 19 digits bear a check digit, the characters beside it, and the word before it by its hash.
FEATURES = {"size": 8, "digits": 5, "distinct": 5, "check": 3, "left": 5, "right": 5, "word": 64}
VOTES = ("form", "gazetteer", "context", "against", "edges")


def matches(text: Column, kind: str) -> Column:
    """array of (kind, start, end, match, before, after) for each match, leftmost first; positions count code points."""
    pattern = F.lit(PATTERNS[kind])
    tried = F.lit(kind in BASE and kind in NEEDS) | text.rlike(PATTERNS[kind])
    if kind in NEEDS:
        tried = reduce(or_, [text.contains(x) for x in NEEDS[kind]]) & tried

    def pieces(both: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            gap, hit = both["parts"][i], both["hits"][i]
            start = acc["at"] + F.length(gap)
            end = start + F.length(hit)
            row = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), hit.alias("hit"), F.right(gap, F.lit(48)).alias("before"), F.left(both["parts"][i + 1], F.lit(8)).alias("after"))
            return F.struct(end.alias("at"), F.array_append(acc["rows"], row).alias("rows"))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("rows"))
        return F.when(F.size(both["hits"]) > 0, F.aggregate(F.sequence(F.lit(0), F.size(both["hits"]) - 1), zero, add)["rows"])

    found = F.struct(F.split(text, PATTERNS[kind], -1).alias("parts"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"))
    return F.coalesce(F.when(tried, let(found, pieces)), F.array().cast(SPANS))


SPANS = "array<struct<kind:string,start:int,end:int,hit:string,before:string,after:string>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(x: Column, i: Column) -> Column:
        n = x.cast("int")
        twice = F.when(n > 4, 2 * n - 9).otherwise(2 * n)
        return F.when(i % 2 == 1, twice).otherwise(n)

    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda x: x != ""), value)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _form(s: Column) -> Column:
    """Does the match pass the checks of its kind?  For base kinds these are the contract's."""
    kind, digits = s["kind"], _digits(s["hit"])
    parts = F.forall(F.split(s["hit"], "\\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.try_to_number(F.right(p, F.lit(3)), F.lit("999")) <= 255))
    return (
        F.when(kind == "ip", parts)
        .when(kind == "card", F.length(digits).between(14, 19) & _luhn(digits))
        .when(kind == "phone", F.length(digits).between(10, 15))
        .when(kind == "ssn", ~digits.rlike("^(000|666|9)|^...00|0000$"))
        .when(kind == "local_phone", ~digits.rlike("^[01]"))
        .when(kind == "secret_value", s["hit"].rlike("[0-9]"))
        .when(kind == "iban", F.length(F.regexp_replace(s["hit"], " ", "")).between(15, 34))
        .when(kind == "number", F.length(digits).between(13, 19) & _luhn(digits))
        .when(kind == "opaque", s["hit"].rlike("[a-z]") & s["hit"].rlike("[A-Z]") & s["hit"].rlike("[0-9].*[0-9]"))
        .when(kind == "person", F.lit(None))
        .otherwise(True)
    )


def _votes(s: Column) -> Column:
    """The labelers: 1 for personal data, -1 against, 0 to abstain."""
    low = F.lower(s["hit"])
    last = F.element_at(F.split(low, "[^a-z0-9-]+"), -1)
    listed = F.array(*[F.lit(x) for x in DOMAINS.split()])
    given = F.array(*[F.lit(x) for x in GIVEN.split()])
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    mail = s["kind"].isin("email", "masked_email")
    secret = s["kind"].isin(*SECRETS, "opaque")
    private = s["hit"].rlike("^(10|127|0|255)\\.|^192\\.168\\.")
    return F.struct(
        vote(_form(s), ~_form(s)).alias("form"),
        F.when(mail, vote(F.array_contains(listed, last), last.rlike("^[0-9]*$")))
        .when(s["kind"] == "name", vote(F.arrays_overlap(F.split(low, " "), given), F.lit(False)))
        .when(s["kind"] == "person", vote(F.array_contains(given, F.substring_index(low, " ", 1)), ~F.arrays_overlap(F.split(low, " "), given)))
        .when(s["kind"] == "opaque", vote(s["hit"].rlike(KEY), s["hit"].rlike("^[0-9A-Fa-f]+$|^[0-9A-Fa-f]{8}-") | (F.length(_digits(s["hit"])) < 3)))
        .when(s["kind"] == "ip", vote(F.lit(False), private))
        .when(s["kind"] == "card", vote(s["hit"].rlike("^[3-6]"), s["hit"].rlike("^0")))
        .when(secret, vote((s["kind"] == "secret_key") | s["hit"].rlike("^[0-9A-Fa-f]{16,}$|^[A-Za-z0-9+/_-]{24,}={0,2}$"), s["hit"].rlike(STAND_IN)))
        .otherwise(0).alias("gazetteer"),
        vote(F.when(secret, s["before"].rlike(NEAR_SECRET)).otherwise(s["before"].rlike(NEAR)), F.lit(False)).alias("context"),
        vote(F.lit(False), F.when(secret, s["before"].rlike(AGAINST_SECRET)).otherwise(s["before"].rlike(AGAINST))).alias("against"),
        vote(F.lit(False), s["before"].rlike("[\\p{L}\\p{N}_/]$") | (~secret & s["before"].endswith("=")) | s["after"].rlike("^[\\p{L}\\p{N}_/=@]")).alias("edges"),
    )


def _features(s: Column) -> Column:
    """What the classifier sees; FEATURES holds the number of values of each."""
    n = F.length(s["hit"])

    def beside(c: Column, at: str) -> Column:
        pattern = lambda x: f"^{x}" if at == "^" else f"{x}$"
        return F.when(c == "", 0).when(c.rlike(pattern("\\s")), 1).when(c.rlike(pattern("[\\p{L}\\p{N}]")), 2).when(c.rlike(pattern("[\"'=:(<\\[]")), 3).otherwise(4)

    share = lambda part: F.least(F.lit(4), F.floor(4 * part / n).cast("int"))
    word = F.lower(F.regexp_extract(s["before"], "(\\p{L}+)\\P{L}*$", 1))
    return F.struct(
        F.least(F.lit(7), F.floor(F.log2(n)).cast("int")).alias("size"),
        share(F.length(_digits(s["hit"]))).alias("digits"),
        share(F.size(F.array_distinct(F.split(s["hit"], "")))).alias("distinct"),
        F.when(F.length(_digits(s["hit"])).between(13, 19), F.when(_luhn(_digits(s["hit"])), 1).otherwise(2)).otherwise(0).alias("check"),
        beside(s["before"], "$").alias("left"),
        beside(s["after"], "^").alias("right"),
        F.pmod(F.xxhash64(word), F.lit(FEATURES["word"])).cast("int").alias("word"),
    )


@dataclass(frozen=True)
class Model:
    """Log-odds of the final classifier: one for each kind and one for each value of each feature."""

    kinds: dict[str, float]
    features: dict[str, list[float]]

    def score(self, s: Column) -> Column:
        total = F.create_map(*[F.lit(x) for pair in self.kinds.items() for x in pair])[s["kind"]]
        for name, weights in self.features.items():
            total = total + F.array(*[F.lit(w) for w in weights])[s["features"][name]]
        return total


def weigh(patterns: list[dict]) -> tuple[list[float], dict[str, float]]:
    """EM over vote patterns with counts: each pattern's chance to be personal data, and each labeler's reliability.

    Each pattern is a kind, the labelers' votes and how many spans show them; there are at most 14 * 3 ** 5.  EM has a rate
    of personal data for each kind and for each labeler a chance of each vote in either class (Dawid and Skene), smoothed
    by a prior under which a vote is right three times in four; so the classes can't change places.  Who abstains says
    nothing: labelers know some kinds only, and kinds they don't know aren't the less personal.
    """
    prior = {(v, c): 0.75 if (v > 0) == c else 0.25 for v in (-1, 1) for c in (True, False)}
    chance = {(name, v, c): prior[v, c] for name in VOTES for v in (-1, 1) for c in (True, False)}
    rate = dict.fromkeys(PATTERNS, 0.5)
    strength = 8.0
    posterior = [0.5] * len(patterns)
    for _ in range(30):
        for i, p in enumerate(patterns):
            odds = math.log(rate[p["kind"]] / (1 - rate[p["kind"]]))
            odds += sum(math.log(chance[n, p[n], True] / chance[n, p[n], False]) for n in VOTES if p[n])
            posterior[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for kind in PATTERNS:
            of = [(q, p["n"]) for q, p in zip(posterior, patterns, strict=True) if p["kind"] == kind]
            rate[kind] = (sum(q * n for q, n in of) + 1) / (sum(n for _, n in of) + 2)
        for name in VOTES:
            for c in (True, False):
                mass = {v: strength * prior[v, c] for v in (-1, 1)}
                for q, p in zip(posterior, patterns, strict=True):
                    if p[name]:
                        mass[p[name]] += p["n"] * (q if c else 1 - q)
                whole = sum(mass.values())
                for v in mass:
                    chance[name, v, c] = mass[v] / whole
    return posterior, {n: chance[n, 1, True] / (chance[n, 1, True] + chance[n, 1, False]) for n in VOTES}


def train(spans: list[dict]) -> Model:
    """A logistic classifier of kind and features, fitted to the chances `q` of at most FIT_SPANS spans of each kind.

    The labelers' votes are no features: the classifier carries what EM believes of them over to how spans look.
    """
    kinds = list(PATTERNS)
    starts = np.cumsum([0, len(kinds), *FEATURES.values()])
    w = np.zeros(starts[-1])
    if spans:
        spans = sorted(spans, key=lambda s: (s["kind"], *(s[f] for f in FEATURES), s["q"]))  # sums don't depend on Spark's order
        at = np.array([[kinds.index(s["kind"]), *(s[f] + o for f, o in zip(FEATURES, starts[1:], strict=False))] for s in spans])
        q = np.array([s["q"] for s in spans])
        for _ in range(600):
            error = (q - 1 / (1 + np.exp(-np.clip(w[at].sum(axis=1), -30, 30)))) / len(q)
            w += 1.0 * (np.bincount(at.ravel(), np.repeat(error, at.shape[1]), len(w)) - 1e-4 * w)
    w = np.round(w, 9)
    return Model(dict(zip(kinds, w.tolist(), strict=False)), {f: w[o : o + n].tolist() for (f, n), o in zip(FEATURES.items(), starts[1:], strict=False)})


def fitted(candidates: DataFrame) -> Model:
    """The classifier for a table of spans (column s): EM over the votes of all of them, then the fit on a bounded sample."""
    votes = [F.col(f"s.votes.{n}").alias(n) for n in VOTES]
    patterns = [r.asDict() for r in candidates.groupBy("s.kind", *votes).agg(F.count(F.lit(1)).alias("n")).collect()]  # at most 14 * 3 ** 5 rows
    patterns.sort(key=lambda p: (p["kind"], *(p[n] for n in VOTES)))
    if not patterns:
        return train([])
    chance, _ = weigh(patterns)
    of = {(p["kind"], *(p[n] for n in VOTES)): q for p, q in zip(patterns, chance, strict=True)}
    # smallest hashes of each kind: a threshold from the counts leaves a few times FIT_SPANS, the window takes the first
    number = F.xxhash64("s.kind", "s.start", "s.hit", "s.votes", "s.features")
    counts = dict.fromkeys(PATTERNS, 0)
    for p in patterns:
        counts[p["kind"]] += p["n"]
    bound = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(2**31 * min(1.0, 4 * FIT_SPANS / max(1, n))))])
    near = candidates.select("s.kind", *votes, *[F.col(f"s.features.{f}").alias(f) for f in FEATURES], number.alias("h")).filter(F.pmod(F.col("h"), F.lit(2**31)) < bound[F.col("kind")])
    order = Window.partitionBy("kind").orderBy(F.pmod(F.col("h"), F.lit(2**31)), "h")
    sample = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= FIT_SPANS).drop("h", "r").collect()  # 14 * FIT_SPANS rows
    return train([r.asDict() | {"q": of[(r["kind"], *(r[n] for n in VOTES))]} for r in sample])


def find_pii(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """docs without the text, and with spans: array of (kind, start, end, base, hit), by start and then by the order of kinds.

    Base spans are the four kinds' matches that pass their checks; they always stay.  The other kinds' matches stay if
    they pass the checks of their kind, overlap no base span (secrets: lie in none), and the classifier that was trained on
    what EM makes of the labelers' votes takes them for personal data.  Matches of the loose kinds (capitalised words in a
    row, bare numbers, strings that look like keys) have no checks to pass: the classifier alone tells which are personal,
    and those that overlap a match of another kind that passes its checks go.  The
    whole text is read once; candidates are written, so that training and the result see the same.  A null text is empty
    and has no spans; an empty table trains on nothing.  A column named spans is replaced.  All of it is Spark SQL but for
    the driver's arithmetic on vote counts.
    """
    docs = without(docs, "spans") if text != "spans" else docs
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    t, candidates = free_name(docs, "__t"), free_name(docs, "__candidates")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = docs.select(*rest, body.alias(t)).select(*rest, F.concat(*[matches(F.col(t), kind) for kind in PATTERNS]).alias(candidates))
    judged = F.transform(candidates, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), _votes(s).alias("votes"), _features(s).alias("features")))
    table = materialize(found.select(*rest, judged.alias(candidates)), "pii-candidates")
    model = fitted(table.select(F.explode(candidates).alias("s")))
    base = lambda s: s["kind"].isin(*BASE) & (s["votes"]["form"] == 1)
    order = F.create_map(*[F.lit(x) for i, k in enumerate(PATTERNS) for x in (k, i)])

    def select(c: Column) -> Column:
        firm = F.filter(c, base)
        over = lambda s, b: (b["start"] < s["end"]) & (s["start"] < b["end"]) & (~s["kind"].isin(*SECRETS) | ((b["start"] <= s["start"]) & (s["end"] <= b["end"])))
        strict = F.filter(c, lambda s: ~s["kind"].isin(*LOOSE) & (s["votes"]["form"] >= 0))
        beside = lambda s: F.exists(strict, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        tight = lambda s: F.when(s["kind"].isin(*LOOSE), ~beside(s)).otherwise((s["votes"]["form"] >= 0) & ~F.exists(F.filter(c, base), lambda b: over(s, b)))
        more = F.filter(c, lambda s: ~s["kind"].isin(*BASE) & (model.score(s) > 0) & tight(s))
        keyed = F.transform(F.concat(firm, more), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("o"), s["end"].alias("end"), s["kind"].alias("kind"), base(s).alias("base"), s["hit"].alias("hit")))
        return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), s["hit"].alias("hit")))

    return table.select(*rest, F.when(F.size(candidates) > 0, let(F.col(candidates), select)).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,base:boolean,hit:string>>")).alias("spans"))

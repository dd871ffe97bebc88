"""Text features, hashes and keys as columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z0-9_']+"
# Unicode ranges of CJK characters and punctuation.
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2EBEF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]+"


def normalized(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def stripped(text: Column) -> Column:
    """Text without ASCII white space at its ends."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def text_hash(text: Column) -> Column:
    """sha256 of the normalized text."""
    return F.sha2(normalized(text), 256)


def excerpt(text: Column, limit: int) -> Column:
    """The normalized text, cut to `limit` with three dots."""
    compact = normalized(text)
    return F.when(F.length(compact) <= limit, compact).otherwise(F.concat(F.left(compact, F.lit(limit - 3)), F.lit("...")))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


#: Endings of plurals and what stands for them, the longest first; a stem keeps `least` letters.
PLURALS = (("sses", "ss", 1), ("ches", "ch", 1), ("shes", "sh", 1), ("xes", "x", 1), ("zes", "z", 1), ("oes", "o", 1), ("ies", "y", 2), ("ves", "f", 2), ("men", "man", 0), ("s", "", 2))
#: Endings of words that are no plurals.
SINGULARS = ("ss", "us", "is", "ics")
#: Words that no ending tells.
IRREGULAR = {
    "children": "child", "feet": "foot", "teeth": "tooth", "geese": "goose", "mice": "mouse", "lice": "louse", "oxen": "ox", "people": "person", "criteria": "criterion", "phenomena": "phenomenon", "analyses": "analysis", "hypotheses": "hypothesis", "theses": "thesis", "crises": "crisis",
    "indices": "index", "matrices": "matrix", "vertices": "vertex", "data": "datum", "media": "medium", "knives": "knife", "lives": "life", "wives": "wife", "moves": "move", "gives": "give", "gloves": "glove", "movies": "movie", "ties": "tie", "lies": "lie", "shoes": "shoe",
    "does": "doe", "buses": "bus", "gases": "gas", "has": "has", "was": "was", "as": "as", "gas": "gas", "always": "always", "perhaps": "perhaps", "news": "news", "series": "series", "species": "species", "specimen": "specimen", "abdomen": "abdomen", "omen": "omen", "lens": "lens",
}


def lemma(word: Column) -> Column:
    """Section 2.11: the singular of a lower-case noun by its ending; other words stay.

    An exception comes first, then endings of words that are no plurals, then the longest plural ending whose stem is long enough.
    """
    known = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    out = F.when(F.try_element_at(known, word).isNotNull(), F.try_element_at(known, word))
    for end in SINGULARS:
        out = out.when(F.endswith(word, F.lit(end)), word)
    for end, stands, least in PLURALS:
        out = out.when(F.endswith(word, F.lit(end)) & (F.length(word) >= len(end) + least), F.concat(F.left(word, F.length(word) - len(end)), F.lit(stands)))
    return out.otherwise(word)


def lemmas(text: Column, stop: Sequence[str] = ()) -> Column:
    """Section 2.11: lemmas of a text's words of letters alone, stop words left out."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_']+"), F.lit(0))
    real = F.filter(words, lambda w: w.rlike(r"^\p{L}+$") & ~(w.isin(*stop) if stop else F.lit(False)))
    return F.transform(real, lemma)


def token_counts(text: Column) -> Column:
    """struct (n, v): all and distinct tokens; the text is cut into tokens once."""
    return let(tokens(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("v")))


def features(text: Column, counts: Column) -> dict[str, Column]:
    """Characters, lines, tokens, share of distinct tokens, markdown marks a character; counts is token_counts of the text."""
    marks = sum((occurrences(text, m) for m in ("#", "*", "`", "|")), F.lit(0))
    return {
        "response_chars": F.length(text).cast("long"),
        "response_lines": (occurrences(text, "\n") + 1).cast("long"),
        "response_tokens": counts["n"],
        "unique_ratio": F.when(counts["n"] > 0, counts["v"] / counts["n"]).otherwise(0.0),
        "markdown_density": F.when(F.length(text) > 0, marks / F.length(text)).otherwise(0.0),
    }


def root_ttr(n: Column, v: Column) -> Column:
    """Distinct words (v) over the root of all words (n)."""
    return F.when(n > 0, v / F.sqrt(n)).otherwise(0.0)


def maas(n: Column, v: Column) -> Column:
    """(ln n - ln v) / (ln n)^2, 0 where n or v is 1 or less."""
    return F.when((n > 1) & (v > 1), (F.log(n) - F.log(v)) / F.pow(F.log(n), F.lit(2.0))).otherwise(0.0)


def entropy_bits(counts: Column) -> Column:
    """Shannon entropy of an array of counts, in bits."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(F.filter(counts, lambda x: x > 0), F.lit(0.0), lambda a, x: a - x / total * F.log2(x / total))


def cjk_spans(text: Column) -> Column:
    """runs of CJK characters; neighbours are one span."""
    return F.regexp_extract_all(text, F.lit(CJK), F.lit(0))


def cjk_hits(text: Column, around: int = 60) -> Column:
    """array of (start, end, match, snippet) of each run; a snippet has up to `around` characters on both sides."""
    found = F.struct(F.split(text, CJK, -1).alias("parts"), F.regexp_extract_all(text, F.lit(CJK), F.lit(0)).alias("hits"), text.alias("text"))

    def hits(both: Column) -> Column:
        def add(a: Column, i: Column) -> Column:
            start = a["at"] + F.length(both["parts"][i])
            end = start + F.length(both["hits"][i])
            left, right = F.greatest(start - around, F.lit(0)), F.least(end + around, F.length(both["text"]))
            shown = F.concat(F.when(left > 0, "…").otherwise(""), F.substring(both["text"], left + 1, right - left), F.when(right < F.length(both["text"]), "…").otherwise(""))
            row = F.struct(start.alias("start"), end.alias("end"), both["hits"][i].alias("match"), shown.alias("snippet"))
            return F.struct(end.alias("at"), F.array_append(a["rows"], row).alias("rows"))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast(CJK_HITS).alias("rows"))
        return F.when(F.size(both["hits"]) > 0, F.aggregate(F.sequence(F.lit(0), F.size(both["hits"]) - 1), zero, add)["rows"]).otherwise(F.array().cast(CJK_HITS))

    return F.when(text.isNotNull(), F.transform(F.array(found), hits)[0])


CJK_HITS = "array<struct<start:int,end:int,match:string,snippet:string>>"


def single_character(text: Column) -> Column:
    """Text made of one character over and over."""
    return text.rlike(r"(?s)^(.)\1*\z")


def composite_key(model: Column, question_id: Column) -> Column:
    """P19."""
    return F.concat_ws("::", model, question_id)


def alias_keys(model: Column, question_id: Column, category: Column, *own: Column) -> Column:
    """P20: all keys under which a row may be known, distinct and not empty."""
    pair = F.when((model != "") & (question_id != ""), composite_key(model, question_id))
    scoped = F.concat_ws("::", F.coalesce(F.when(category != "", category), F.lit("us_hard")), pair)
    keys = F.array(*own, pair, F.when(pair.isNotNull(), scoped), F.concat(F.lit("gold::"), pair))
    return F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & (k != "")))


def pair_ids(questions: Column, models: Column, keys: Column) -> Column:
    """(question_id, model) pairs from every question with every model, and from keys of the form `...model::question`."""
    known = lambda a: F.filter(a, lambda x: x.isNotNull() & (x != ""))
    crossed = F.flatten(F.transform(known(questions), lambda q: F.transform(known(models), lambda m: F.struct(q.alias("question_id"), m.alias("model")))))

    def parse(key: Column) -> Column:
        parts = F.split(key, "::")
        return F.struct(F.try_element_at(parts, F.lit(-1)).alias("question_id"), F.try_element_at(parts, F.lit(-2)).alias("model"))

    parsed = F.filter(F.transform(known(keys), parse), lambda p: (p["model"] != "") & (p["question_id"] != ""))
    return F.array_distinct(F.concat(crossed, parsed))


def error_family(source: str, status_code: Column, code: Column, type_: Column, message: Column, limit: int = 120) -> Column:
    """The error's family; parts that are null are left out."""
    part = lambda name, c: F.concat(F.lit(f"{name}="), c.cast("string"))
    return F.concat_ws(";", F.lit(source), part("status_code", status_code), part("code", code), part("type", type_), part("message", F.left(normalized(message), F.lit(limit))))


def finish_pair(finish: Column, native: Column) -> Column:
    """P25: both reasons as literals."""
    shown = lambda c: F.coalesce(F.concat(F.lit("'"), c, F.lit("'")), F.lit("None"))
    return F.concat(F.lit("finish="), shown(finish), F.lit(";native="), shown(native))


def content_signature(error: Column, text: Column) -> Column:
    """Struct (kind, empty, digest) of a response's content."""
    return F.when(error, F.struct(F.lit("error").alias("kind"), F.lit(None).cast("boolean").alias("empty"), F.lit(None).cast("string").alias("digest"))).otherwise(F.struct(F.lit("text").alias("kind"), (text == "").alias("empty"), F.when(text != "", F.sha2(text, 256)).alias("digest")))


def prompt_tokens(total_chars: Column) -> Column:
    """A quarter of the characters, halves to even."""
    return F.bround(total_chars / 4).cast("long")


def truncate_model(name: Column, most: int = 45) -> Column:
    """A long model name cut, its provider kept where there is room."""
    provider, model = F.substring_index(name, "/", 1), F.regexp_replace(name, "^[^/]*/", "")
    room = F.lit(most) - F.length(provider) - 1
    cut = F.when(F.length(model) > room, F.concat(F.left(model, room - 3), F.lit("..."))).otherwise(model)
    return F.when(F.length(name) <= most, name).when(F.contains(name, F.lit("/")) & (room > 10), F.concat_ws("/", provider, cut)).otherwise(F.concat(F.left(name, F.lit(most - 3)), F.lit("...")))


def tag_body(text: Column, tag: str) -> Column:
    """What stands inside a tag, trimmed; null without the tag."""
    found = F.regexp_extract(text, rf"(?is)<{tag}>(.*?)</{tag}>", 1)
    return F.when(text.rlike(rf"(?is)<{tag}>.*?</{tag}>"), stripped(found))


def rendered(template: str, **columns: Column) -> Column:
    """A template with {name} places filled from columns."""
    parts: list[Column] = []
    rest = template
    while rest:
        names = [(rest.find(f"{{{n}}}"), n) for n in columns if f"{{{n}}}" in rest]
        if not names:
            parts.append(F.lit(rest))
            break
        at, name = min(names)
        parts += [F.lit(rest[:at]), F.coalesce(columns[name], F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def think_text(reasoning: Column, answer: Column) -> Column:
    """Answer with its reasoning in think tags, where there is any."""
    return F.when(stripped(reasoning) != "", F.concat(F.lit("<think>\n"), stripped(reasoning), F.lit("\n</think>\n"), answer)).otherwise(answer)


def chat_messages(messages: Column, prompt: Column) -> Column:
    """The messages as role and content, or the prompt as the user's only message."""
    given = F.transform(messages, lambda m: F.struct(m["role"].cast("string").alias("role"), m["content"].cast("string").alias("content")))
    return F.when(F.size(messages) > 0, given).otherwise(F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))))


def subproviders(value: Column) -> Column:
    """Distinct lower-cased names of a comma list."""
    return F.array_distinct(F.filter(F.transform(F.split(value, ","), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def hmac_sha256(secret: str, message: Column) -> Column:
    """Hex HMAC-SHA256 with a fixed key, from sha2 on binary values."""
    key = secret.encode()
    if len(key) > 64:
        import hashlib

        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def uuid5(namespace: str, name: Column) -> Column:
    """Version 5 UUID from sha1."""
    import uuid

    digest = F.substring(F.sha1(F.concat(F.lit(uuid.UUID(namespace).bytes), name.cast("binary"))), 1, 32)
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab89ab89ab89ab"]), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") + 1)
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def stale(response_time: Column, analysis_time: Column) -> Column:
    """the analysis is older than the response; compared as times where both parse, else as text."""
    at, rt = F.try_to_timestamp(analysis_time), F.try_to_timestamp(response_time)
    return F.coalesce(F.when((response_time == "") | (analysis_time == ""), F.lit(False)), at < rt, analysis_time < response_time, F.lit(False))


def missing_category(value: Column) -> Column:
    """F4."""
    return value.isNull() | F.lower(F.trim(value)).isin("", "undefined")


def hash_order(salt: str, *keys: Column) -> Column:
    """A place in a random-looking order that every engine and partitioning agrees on."""
    return F.md5(F.concat_ws("|", F.lit(salt), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]))


def hash_uniform(salt: str, *keys: Column) -> Column:
    """A number in (0, 1) from the same hash."""
    return (F.conv(F.substring(hash_order(salt, *keys), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)

"""Operator 12: the cheapest repair of a conversation's turns, by a DP over the turns that are retained."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Prices of the edits; an undeleted truncated row pays CUT more.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: States of a repaired conversation: nothing yet, or the initial of its last turn.
STATES = ("", "s", "u", "a")
NAMES = {"u": "user", "a": "assistant"}
#: What an edited or inserted turn becomes after each state.
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
LEGAL = {"su", "ua", "au"}
NEVER = 1 << 60
#: Turns that must be put in to end after each state.
END = {"": 0, "s": 2 * INSERT, "u": INSERT, "a": 0}
SPACES = " \t\n\x0b\x0c\r"
#: A conversation of more rows or text is repaired in blocks of 2^BLOCK_BITS consecutive rows.
MOST_ROWS, MOST_TEXT, BLOCK_BITS = 4096, 8 << 20, 14
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows with the faults that crc32(`conv_id:turn`) deals; dropped rows stay as gone."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    out = rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), (fault == 0).alias("gone"), fault.alias("__fault"))
    return out.withColumn("__n", F.explode(F.array_repeat(F.lit(1), F.when(F.col("__fault") == 3, 2).otherwise(1)))).drop("__fault", "__n")


def blank(text: Column) -> Column:
    return ~text.rlike("[^\\x20\\x09-\\x0D]")


def truncated(text: Column) -> Column:
    return ~F.substring(F.rtrim(F.translate(text, SPACES, " " * len(SPACES))), -1, 1).isin(".", "!", "?")


def inserts(state: str, role: str) -> int:
    """Turns to put in between a state and the next retained role: the pair says how many; NEVER where none helps."""
    if role == "s":
        return 0 if state == "" else NEVER
    return int(NEXT[state] != role)


def solve(rows: list[tuple[str, bool, bool]], after: dict[str, int]) -> tuple[dict[str, int], dict[str, tuple[str, str]]]:
    """Least cost from each state before the rows, and the ASCII-least cheapest edits with the state they lead to.

    A row is (initial, must go, truncated); `after` prices what follows the rows for each state behind them.  The DP
    goes over retained rows from the last to the first.  A gap between two retained rows costs its rows' deletions, a
    difference of prefix sums, and what the pair of roles says is to be inserted; so for each role one running minimum
    over the rows behind is enough.  Among equal costs a longer run of deletions comes first, then more insertions,
    then a kept row: the order of the letters D, I, K, R.
    """
    n = len(rows)
    gone = [DELETE * i for i in range(n + 1)]
    end = {q: gone[n] + after[q] for q in STATES}
    best: dict[str, tuple[int, int, str]] = {}  # role: cost with all rows before deleted, row, letter
    choice: list[dict[str, tuple]] = [{} for _ in range(n)]

    def pick(state: str) -> tuple:
        """(cost, -row, -inserted, letter, role) of the best way on, row n standing for none."""
        found = (end[state], -n, 0, "", "")
        for role, (cost, row, letter) in best.items():
            put = inserts(state, role)
            if put < NEVER:
                found = min(found, (cost + INSERT * put, -row, -put, letter, role))
        return found

    for j in range(n - 1, -1, -1):
        initial, dead, cut = rows[j]
        if dead:
            continue
        new = {}
        for role in ("s", "u", "a"):
            if role != initial and role == "s":
                continue
            on = pick(role)
            choice[j][role] = on
            cost = (0 if role == initial else REROLE) + (CUT if cut else 0) + on[0] - gone[j + 1] + gone[j]
            new[role] = (cost, j, "K" if role == initial else "R")
        for role, it in new.items():
            if role not in best or it[0] < best[role][0]:
                best[role] = it
    costs, edits = {}, {}
    for q in STATES:
        on, at, out, state = pick(q), 0, [], q
        costs[q] = min(on[0], NEVER)
        while on[3]:
            row, put, letter, role = -on[1], -on[2], on[3], on[4]
            out.append("D" * (row - at) + "I" * put + letter)
            at, state, on = row + 1, role, choice[row][role]
        edits[q] = ("".join(out) + "D" * (n - at), state)
    return costs, edits


def tail(state: str) -> str:
    return "I" * (END[state] // INSERT)


class Repaired:
    """The repaired text of a conversation, hashed while edits and rows go by."""

    def __init__(self) -> None:
        self.state, self.any, self.sha = "", False, hashlib.sha256()

    def _turn(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.any = True

    def edit(self, letter: str, role: str = "", text: str = "") -> None:
        if letter == "K":
            self.state = role[:1]
        elif letter != "D":
            self.state = NEXT[self.state]
            role, text = NAMES[self.state], text if letter == "R" else ""
        if letter != "D":
            self._turn(role, text)


def faults(rows: list[tuple]) -> list[tuple[str, bool, bool, str]]:
    """(initial, must go, truncated, fault) of each row (turn, role, text) of a whole conversation."""
    seen, out = set(), []
    for _, role, text in rows:
        bare, again = text.strip(SPACES), (role, text) in seen
        seen.add((role, text))
        fault = "blank" if not bare else "duplicate" if again else "" if bare[-1] in ".!?" else "truncated"
        out.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated", fault))
    return out


def illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def gaps(turns: list[int | None]) -> int:
    real = {t for t in turns if t is not None}
    return max(real) - min(real) + 1 - len(real) if real else 0


def repair(rows: list[tuple]) -> dict:
    """The result for one whole conversation given as (turn, role, text) in order."""
    marks = faults(rows)
    kinds, (costs, edits) = [m[3] for m in marks], solve([m[:3] for m in marks], END)
    audit, state = edits[""]
    audit += tail(state)
    out, at = Repaired(), iter(rows)
    for letter in audit:
        out.edit(letter, *(next(at)[1:] if letter != "I" else ()))
    return {"gaps": gaps([r[0] for r in rows]), **{k: kinds.count(k) for k in ("blank", "duplicate", "truncated")}, "illegal": illegal([m[0] for m in marks]), "cost": costs[""], "audit": audit, "repaired_sha256": out.sha.hexdigest()}


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _dead(row: dict) -> bool:
    return row["is_blank"] or not row["first"]


def repair_conversations(rows: DataFrame, *, most_rows: int = MOST_ROWS, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Faults and the cheapest repair of every conversation of `rows` (conv_id, turn, role, text, gone).

    Rows stand in the order of turn (nulls first), then role, then text; rows with `gone` only say that the conversation
    exists.  A null conv_id is a conversation of its own; role and text must not be null.  Other columns are left out.
    Repeated rows are repeated turns.  An empty table gives no rows.

    The table is sorted once by ranges.  A conversation that lies within a range is repaired where it lies.  One that
    crosses ranges, or has over `most_rows` rows or eight million bytes, is repaired in blocks of 2^block_bits rows: each block
    gives the least costs from state to state, these are composed from the last block on, and every block then chooses
    its edits for each state before it.  Only such rows move again, and no task holds more than a block.
    """
    conv = rows.schema["conv_id"].dataType
    salted = rows.select("conv_id", "turn", "role", "text", "gone", F.monotonically_increasing_id().alias("salt"), F.left("text", F.lit(64)).alias("head"))
    ranged = salted.repartitionByRange("conv_id", "turn", "role", "head", "salt").sortWithinPartitions("conv_id", "turn", "role", "text").drop("salt", "head")
    row_type = T.StructType([T.StructField("conv_id", conv), T.StructField("pos", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("gone", T.BooleanType())])
    result = T.StructType.fromDDL(RESULT)
    both = T.StructType([*row_type.fields, T.StructField("found", result)])
    arrow = _arrow(both)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Repair conversations that lie between two others; hand on the rows of the first, the last and the large ones."""
        held: list[dict] = []
        size, edge, out = 0, True, []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["conv_id"] != held[-1]["conv_id"]:
                    if edge:
                        out += [r | {"found": None} for r in held]
                    else:
                        real = [(r["turn"], r["role"], r["text"]) for r in held if not r["gone"]]
                        out.append(dict.fromkeys(arrow.names) | {"conv_id": held[-1]["conv_id"], "found": repair(real)})
                    held, size, edge = [], 0, False
                held.append(row)
                size += len(row["text"])
                if len(held) > most_rows or size > MOST_TEXT:
                    edge = True
                if edge and len(held) > 1:  # the last row stays to know the conversation by
                    out += [r | {"found": None} for r in held[:-1]]
                    held, size = held[-1:], len(held[-1]["text"])
            if out:
                yield _table(out, arrow)
                out = []
        if held:
            yield _table([r | {"found": None} for r in held], arrow)

    first = materialize(ranged.select("conv_id", F.monotonically_increasing_id().alias("pos"), F.col("turn").cast("long").alias("turn"), "role", "text", "gone").mapInArrow(near, both), "turns-near")
    done = first.filter(F.col("found").isNotNull()).select("conv_id", "found.*")
    left = first.filter(F.col("found").isNull()).select("conv_id", "pos", F.shiftright("pos", block_bits).alias("block"), "turn", "role", "text", "gone")
    return done.unionByName(_in_blocks(left, conv, result))


def _in_blocks(left: DataFrame, conv: T.DataType, result: T.StructType) -> DataFrame:
    """The same for conversations whose rows (with `pos` in order, `block`) may be more than a task should hold."""
    real = left.filter(~F.col("gone"))
    marks = real.select("block", "pos", "conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), blank(F.col("text")).alias("is_blank"), truncated(F.col("text")).alias("cut"), F.lit(False).alias("first"))
    firsts = real.filter(~blank(F.col("text"))).groupBy("conv_id", "role", F.md5("text")).agg(F.min("pos").alias("pos"), F.min_by("block", "pos").alias("block"))
    marked_type = marks.schema

    def mark(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        first = {r["pos"] for r in rows if r["first"]}
        kept = sorted((r for r in rows if not r["first"]), key=lambda r: r["pos"])
        return pa.Table.from_pylist([r | {"first": r["pos"] in first} for r in kept], schema=_arrow(marked_type))

    noted = firsts.select("block", "pos", F.lit(None).cast(conv).alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("initial"), F.lit(False).alias("is_blank"), F.lit(False).alias("cut"), F.lit(True).alias("first"))
    marked = materialize(marks.unionByName(noted).groupBy("block").applyInArrow(mark, marked_type), "turns-marked")

    def pieces(rows: list[dict]) -> Iterator[list[dict]]:
        """Runs of rows of one conversation in a block."""
        rows.sort(key=lambda r: r["pos"])
        lo = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i]["conv_id"] != rows[lo]["conv_id"]:
                yield rows[lo:i]
                lo = i

    costs_type = T.StructType([T.StructField("conv_id", conv), T.StructField("block", T.LongType()), T.StructField("costs", T.ArrayType(T.LongType()))])

    def price(table: pa.Table) -> pa.Table:
        out = []
        for piece in pieces(table.to_pylist()):
            feats = [(r["initial"], _dead(r), r["cut"]) for r in piece]
            costs = [[0] * 4 for _ in range(4)]
            for k, behind in enumerate(STATES):
                got, _ = solve(feats, {q: 0 if q == behind else NEVER for q in STATES})
                for i, q in enumerate(STATES):
                    costs[i][k] = got[q]
            out.append({"conv_id": piece[0]["conv_id"], "block": piece[0]["block"], "costs": [c for line in costs for c in line]})
        return pa.Table.from_pylist(out, schema=_arrow(costs_type))

    def compose(table: pa.Table) -> pa.Table:
        """costs becomes what follows each block, from each state behind it."""
        out, after = [], [END[q] for q in STATES]
        for row in sorted(table.to_pylist(), key=lambda r: -r["block"]):
            out.append(row | {"costs": after})
            after = [min(min(row["costs"][4 * i + k] + after[k] for k in range(4)), NEVER) for i in range(4)]
        return pa.Table.from_pylist(out, schema=_arrow(costs_type))

    after = marked.groupBy("block").applyInArrow(price, costs_type).groupBy("conv_id").applyInArrow(compose, costs_type)
    chosen_type = T.StructType([T.StructField("conv_id", conv), T.StructField("block", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("blank", "duplicate", "truncated", "illegal", "low", "high", "turns")], T.StructField("head", T.StringType()), T.StructField("last", T.StringType()), T.StructField("audits", T.ArrayType(T.StringType())), T.StructField("states", T.ArrayType(T.StringType())), T.StructField("cost", T.LongType())])

    def choose(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        behind = {r["conv_id"]: r["costs"] for r in rows if r["costs"] is not None}
        out = []
        for piece in pieces([r for r in rows if r["costs"] is None]):
            costs, edits = solve([(r["initial"], _dead(r), r["cut"]) for r in piece], dict(zip(STATES, behind[piece[0]["conv_id"]], strict=True)))
            turns = [r["turn"] for r in piece if r["turn"] is not None]
            out.append({
                "conv_id": piece[0]["conv_id"], "block": piece[0]["block"], "blank": sum(r["is_blank"] for r in piece), "duplicate": sum(not r["is_blank"] and not r["first"] for r in piece),
                "truncated": sum(not _dead(r) and r["cut"] for r in piece), "illegal": illegal([r["initial"] for r in piece]), "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns)),
                "head": piece[0]["initial"], "last": piece[-1]["initial"], "audits": [edits[q][0] for q in STATES], "states": [edits[q][1] for q in STATES], "cost": costs[""],
            })
        return pa.Table.from_pylist(out, schema=_arrow(chosen_type))

    priced = after.select("block", F.lit(-1).cast("long").alias("pos"), "conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("initial"), F.lit(False).alias("is_blank"), F.lit(False).alias("cut"), F.lit(False).alias("first"), "costs")
    chosen = marked.withColumn("costs", F.lit(None).cast("array<bigint>")).unionByName(priced).groupBy("block").applyInArrow(choose, chosen_type)

    # a conversation's blocks and texts in order, each block's choice before its texts
    none = left.select("conv_id").distinct().select("conv_id", F.lit(-2).cast("long").alias("block"))
    lines = real.select("conv_id", "block", "pos", "role", "text")
    stream = chosen.withColumn("pos", F.lit(-1).cast("long")).unionByName(lines, allowMissingColumns=True).unionByName(none, allowMissingColumns=True)
    out_type = T.StructType([T.StructField("conv_id", conv), *result.fields])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = out = now = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] == -2:
                    if known:
                        yield _finished(known, out, out_type)
                    known, out = {"conv_id": row["conv_id"], "audit": [], "low": None, "high": None, "turns": 0, "last": None} | dict.fromkeys(COUNTS, 0), Repaired()
                elif row["audits"] is not None:
                    now = iter(row["audits"][STATES.index(out.state)])
                    piece = row["audits"][STATES.index(out.state)]
                    known["cost"] = known["cost"] if known["audit"] else row["cost"]
                    known["audit"].append(piece)
                    for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
                        known[c] += row[c]
                    known["illegal"] += known["last"] is not None and known["last"] + row["head"] not in LEGAL
                    known["last"] = row["last"]
                    if row["low"] is not None:
                        known["turns"] -= known["high"] == row["low"]
                        known["low"] = row["low"] if known["low"] is None else known["low"]
                        known["high"] = row["high"]
                else:
                    letter = next(now)
                    while letter == "I":
                        out.edit("I")
                        letter = next(now)
                    out.edit(letter, row["role"], row["text"])
        if known:
            yield _finished(known, out, out_type)

    return stream.repartition("conv_id").sortWithinPartitions("conv_id", "block", "pos").select("conv_id", "block", "role", "text", *[f.name for f in chosen_type.fields[2:]]).mapInArrow(write, out_type)


def _finished(known: dict, out: Repaired, schema: T.StructType) -> pa.RecordBatch:
    ends = tail(out.state)
    for letter in ends:
        out.edit(letter)
    row = {f.name: known.get(f.name) for f in schema.fields}
    row |= {"gaps": 0 if known["low"] is None else known["high"] - known["low"] + 1 - known["turns"], "audit": "".join(known["audit"]) + ends, "repaired_sha256": out.sha.hexdigest()}
    return _table([row], _arrow(schema))

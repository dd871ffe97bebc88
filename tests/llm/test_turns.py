import random
import zlib
from collections import defaultdict

import pytest
from brute import repair as plain

from verdictlake.llm.turns import END, damaged, repair, repair_conversations, solve

NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
ROLES = ["system", "user", "user", "assistant", "assistant", "tool", "", "u2"]
TEXTS = ["Yes.", "No!", "cut off", "", " \t", "Why? \n", "same.", "same.", "é", "."]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


@pytest.mark.parametrize("seed", range(6))
def test_repair_is_the_cheapest_with_the_least_audit(seed):
    r = random.Random(seed)
    for _ in range(400):
        rows = ordered((r.choice([None, *range(8)]), r.choice(ROLES), r.choice(TEXTS) + r.choice(["", str(r.randint(0, 9)) + "."])) for _ in range(r.randint(0, 9)))
        assert tuple(repair(rows)[k] for k in NAMES) == plain(rows), rows


def test_blocks_compose_to_the_whole():
    r = random.Random(9)
    for _ in range(200):
        rows = [(r.choice("suax"), r.random() < 0.2, r.random() < 0.2) for _ in range(12)]
        whole, edits = solve(rows, END)
        after, _ = solve(rows[5:], END)
        before, first = solve(rows[:5], after)
        assert before == whole
        for q in ("", "s", "u", "a"):
            audit, state = first[q]
            assert audit + solve(rows[5:], END)[1][state][0] == edits[q][0]


def damage(conv, rows):
    out = []
    for turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        out += [(turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def conversations():
    r = random.Random(4)
    rows = []
    for c in [None, *range(60)]:
        for t in [*range(r.randint(1, 9)), None, 3]:
            text = r.choice([*TEXTS, None])
            rows.append((c, t, r.choice([*ROLES, None]), None if text is None else text + r.choice(["", f"{r.randint(0, 9)}."])))
    rows += [(99, t, r.choice(["user", "assistant"]), f"turn {t % 700}{r.choice(['.', '.', ''])}") for t in range(2500)]  # half of all rows
    rows += [(98, t, "user", "x" * 100_000 + ".") for t in range(3)]  # long texts
    rows += [(97, 1, "user", "again.")] * 40  # repeated rows
    dropped = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return [*rows, (dropped, 0, "user", "nothing is left of this one")]


@pytest.mark.parametrize(("most_rows", "bits", "parts"), [(4096, 14, 3), (4, 3, 5), (1, 0, 2), (50, 5, 7)])
def test_conversations_match_brute_force(spark, most_rows, bits, parts):
    rows = conversations()
    groups = defaultdict(list)
    for conv, *row in rows:
        groups[conv].append(tuple(row))
    want = {conv: plain(ordered(damage(conv, g))) for conv, g in groups.items()}
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, gone string").repartition(parts)
    got = repair_conversations(damaged(frame), most_rows=most_rows, block_bits=bits).collect()
    assert len(got) == len(want)
    assert {r.conv_id: tuple(r[k] for k in NAMES) for r in got} == want


def test_empty_table_and_string_ids(spark):
    assert repair_conversations(damaged(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))).count() == 0
    one = repair_conversations(spark.createDataFrame([("b", 1, "user", "Well?", False), ("b", 2, "assistant", "Well.", False)], "conv_id string, turn int, role string, text string, gone boolean")).collect()
    assert [(r.conv_id, r.cost, r.audit) for r in one] == [("b", 0, "KK")]

"""Conversation repair against exhaustive search and plain reading of the rules."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from halyard.llm import repair

WELL = re.compile(r"(s?(ua)+)?")


def cheapest(symbols):
    """(cost, letters) by search over all edits in the order of (cost, letters)."""
    queue, done = [(0, "", 0, repair.START)], set()
    while queue:
        cost, letters, at, state = heapq.heappop(queue)
        if at == len(symbols) and state in (repair.START, repair.ASSISTANT):
            return cost, letters
        if (at, state) in done:
            continue
        done.add((at, state))
        heapq.heappush(queue, (cost + 2, letters + "I", at, repair.NEXT[state]))
        if at < len(symbols):
            for letter, extra, after in repair.edits(state, symbols[at]):
                heapq.heappush(queue, (cost + extra, letters + letter, at + 1, after))
    raise AssertionError


@pytest.mark.parametrize("block", [1, 2, 4])
def test_blocks_give_the_cheapest_and_least_letters(block):
    draw = random.Random(block)
    table = repair.Tables(block)
    for n in [0, 1, 2, 3, 4, 5, 7, 8, 9, 13, 40]:
        for _ in range(60):
            symbols = bytes(draw.randrange(repair.SYMBOLS) for _ in range(n))
            assert table.repair(symbols) == cheapest(symbols), list(symbols)


def test_vectors_are_few():
    assert len(repair.tables().vectors) < 64


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        name = f"{conv if conv is not None else ' '}:{turn if turn is not None else ' '}"
        hit = zlib.crc32(name.encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return out


def plain(rows):
    found = {}
    left = damaged(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in left if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        counts, symbols, seen = [0, 0, 0], [], set()
        for _, role, text in mine:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            if fault:
                counts[fault - 1] += 1
            symbols.append(repair.symbol(" sua".find(role[:1] or "-") if role[:1] in list("sua") else 0, fault in (1, 2), fault == 3))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, letters = cheapest(bytes(symbols))
        lines, state, at = [], repair.START, 0
        for letter in letters:
            role, text = (mine[at][1], mine[at][2]) if letter != "I" else ("", "")
            at += letter != "I"
            if letter == "D":
                continue
            state = repair.AFTER[state, " sua".index(role[0])] if letter == "K" else repair.NEXT[state]
            lines.append(f"{role if letter == 'K' else repair.ROLES[state]}:{text}")
        assert WELL.fullmatch("".join(x[0] for x in lines))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        found[conv] = (gaps, *counts, illegal, cost, letters, digest)
    return found


SCHEMA = "conv_id long, turn long, role string, text string, fault string, earlier int, kind int"


def audited(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    out = repair.audited(repair.damaged(frame, "conv_id", "turn", "role", "text")).collect()
    found = {r.conv: tuple(r)[1:] for r in out}
    assert len(found) == len(out)
    return found


def test_rows_against_plain_reading(spark):
    draw = random.Random(3)
    texts = ["Hello there.", "What?", "no end", "", " \t\n", "Same text!", None, "Ends with blanks. \n\t", "é…", "a\x0bb."]
    roles = ["user", "assistant", "system", "tool", "User", None, ""]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(draw.randint(1, 9)):
            number = None if draw.random() < 0.05 else turn + draw.randint(0, 1)
            rows.append((conv, number, draw.choices(roles, [8, 8, 3, 1, 1, 1, 1])[0], draw.choice(texts)))
    rows += rows[:20]  # repeated rows
    draw.shuffle(rows)
    assert audited(spark, rows) == plain(rows)


def test_a_conversation_that_loses_all_rows(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert audited(spark, [(conv, 0, "user", "Hi.")]) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_a_long_conversation_and_an_empty_table(spark):
    rows = [(1, t, ["user", "assistant", "user"][t % 3], f"Row {t}" + "." * (t % 5)) for t in range(30_000)]
    found = audited(spark, rows)[1]
    assert found[5] > 0 and len(found[6]) >= len(damaged(rows))
    assert found[6].count("D") + found[6].count("K") + found[6].count("R") == len(damaged(rows))
    assert audited(spark, []) == {}


def test_repaired_rows_read_as_asked(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = repair.damaged(frame, "conv_id", "turn", "role", "text")
    found = repair.repairs(rows).cache()
    digests = {r.conv: r.repaired_sha256 for r in repair.digests(rows, found).collect()}
    lines = {}
    for r in repair.repaired(rows, found).collect():
        lines.setdefault(r.conv, []).append((r.place, f"{r.role}:{r.text}"))
    for conv, digest in digests.items():
        mine = [x for _, x in sorted(lines.get(conv, []))]
        assert WELL.fullmatch("".join(x[0] for x in mine))
        assert hashlib.sha256("\n".join(mine).encode()).hexdigest() == digest

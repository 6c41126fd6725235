import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from metertide.llm import conversations
from metertide.llm.conversations import (
    END,
    NOTHING,
    SPECULATIVE,
    closing_edits,
    converged,
    cost_of,
    fixed_up,
    repair_reports,
    traced,
    vectors_of,
)

SCHEMA = "conv_id long, turn long, role string, text string, part string, audit string, codes string"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    result = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        result += [(conv, turn, role, text)] * ((kind != 0) + (kind == 3))
    return result


def cheapest(turns):
    """Cost, audit and repaired turns by plain dynamic programming over (turn, what was put out)."""
    n = len(turns)

    @cache
    def best(i, last, out):
        found = []
        if i == n and last in ("", "a"):
            found.append((0, "", ()))
        if i < n:
            role, text, fault = turns[i]
            cost, audit, kept = best(i + 1, last, out)
            found.append((cost + 3, "D" + audit, kept))
            if fault not in ("blank", "duplicate"):
                stays = 1 if fault == "truncated" else 0
                for edit, new, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if follows(last, new[:1]):
                        cost, audit, kept = best(i + 1, new[:1], True)
                        found.append((cost + price + stays, edit + audit, (f"{new}:{text}", *kept)))
        if out < 2:
            for new in ("user", "assistant"):
                if follows(last, new[0]):
                    cost, audit, kept = best(i, new[0], (out if out is not True else 0) + 1)
                    found.append((cost + 2, "I" + audit, (f"{new}:", *kept)))
        return min(found, default=(10**9, "", ()))

    return best(0, "", 0)


def follows(last, initial):
    return initial in {"": "su", "s": "u", "u": "a", "a": "u"}.get(last, "") and initial != ""


def expected(rows):
    result = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in damage([r for r in rows if r[0] == conv])]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3][:64].encode()))
        faults, seen = [], set()
        for _, _, role, text in own:
            words = WORD.findall(text)
            fault = "fine"
            if not words:
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            elif words[-1] not in ".!?":
                fault = "truncated"
            seen.add((role, text))
            faults.append(fault)
        known = {t for _, t, _, _ in own if t is not None}
        roles = [r[2][:1] for r in own]
        cost, audit, kept = cheapest(tuple((r[2], r[3], f) for r, f in zip(own, faults, strict=True)))
        result[conv] = (
            max(known) - min(known) + 1 - len(known) if known else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False)),
            cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest(),
        )
    return result


def found(spark, rows, partitions=3):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(partitions)
    result = repair_reports(df).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )
    rows = [tuple(r) for r in result.collect()]
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: r[1:] for r in rows}


def talk(rng, conv, turns, roles=("user", "assistant")):
    rows = [(conv, 0, "system", "Be kind.")] if rng.random() < 0.4 else []
    for i in range(turns):
        role = rng.choice(["user", "assistant", "system", "tool", "", None]) if rng.random() < 0.2 else roles[i % 2]
        text = rng.choice([f"Say {i} of {conv}.", f"Cut off {i}", "Yes.", "", None, " \n", "Oui ! ", "é?"])
        rows.append((conv, rng.choice([i + 1, i + 1, i + 3, None]), role, text))
    return rows


def test_whole_conversations_against_plain_programming(spark):
    rng = random.Random(1)
    rows = [r for conv in [*range(60), None] for r in talk(rng, conv, rng.randint(1, 9))]
    rows += rng.sample(rows, 20)  # repeated rows
    assert found(spark, rows) == expected(rows)


@pytest.mark.parametrize("seed", [2, 3])
def test_one_conversation_over_many_tasks_and_chunks(spark, monkeypatch, seed):
    monkeypatch.setattr(conversations, "STRETCH_ROWS", 5)
    monkeypatch.setattr(conversations, "CHUNK_STRETCHES", 3)
    rng = random.Random(seed)
    rows = talk(rng, 7, 300) + talk(rng, None, 90) + talk(rng, 8, 3)
    # Stretches of turns that map each vector to another one, so that passes must go on.
    rows += [(9, i, "tool", f"Turn {i}.") for i in range(120)]
    assert found(spark, rows, 6) == expected(rows)


def test_a_third_of_all_rows_is_one_turn(spark, monkeypatch):
    monkeypatch.setattr(conversations, "STRETCH_ROWS", 40)
    rng = random.Random(4)
    rows = [r for conv in range(20) for r in talk(rng, conv, 5)]
    rows += [(3, 2, "user", "Yes.")] * 230 + [(4, None, "user", "")] * 50
    assert found(spark, rows) == expected(rows)


def test_nothing_left_and_empty_table(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert found(spark, [(dropped, 0, "user", "Gone.")]) == {
        dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    }
    assert found(spark, []) == {}


def test_passes_follow_the_vectors_not_the_length(spark, monkeypatch):
    monkeypatch.setattr(conversations, "STRETCH_ROWS", 8)
    monkeypatch.setattr(conversations, "CHUNK_STRETCHES", 1)
    passes = []

    def counted(codes):
        known, n = converged(codes)
        passes.append(n)
        return known, n

    monkeypatch.setattr(conversations, "converged", counted)
    rows = [(1, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(400)]
    found(spark, rows)
    assert passes and max(passes) <= 3


@pytest.mark.parametrize("seed", range(40))
def test_edits_of_codes_are_the_least_of_the_cheapest(seed):
    rng = random.Random(seed)
    codes = bytes(rng.randrange(9) for _ in range(rng.randint(0, 12)))
    letters, state = traced(codes, END, NOTHING)
    letters.append(closing_edits(state))
    roles = ["system", "user", "assistant", "tool"]
    turns = tuple(
        (roles[c & 3], f"t{i}", "blank" if c == 8 else "truncated" if c & 4 else "fine")
        for i, c in enumerate(codes)
    )
    cost, audit, _ = cheapest(turns)
    assert (cost_of(codes, letters), "".join(letters)) == (cost, audit)


@pytest.mark.parametrize("seed", range(40))
def test_a_fixed_up_chunk_is_one_worked_on_anew(seed):
    rng = random.Random(seed)
    codes = bytes(rng.choice([rng.randrange(9), 3, 8]) for _ in range(rng.randint(0, 60)))
    guess = vectors_of(codes, SPECULATIVE)[1]
    assert fixed_up(codes, SPECULATIVE, END, guess) == vectors_of(codes, END)[1]

"""Conversation repair: the agenda against all edit strings, and the jobs against row-by-row code."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from contactlake.llm import repair
from contactlake.session import Scratch

SCHEMA = "conv_id bigint, turn bigint, role string, text string, at string, part string, conv string"


def exhaustive(codes: str) -> tuple[int, str]:
    """The least (cost, audit) of all edit strings that cost no more than deleting every row."""
    done, open_ = [], [(0, "", "", 0)]
    while open_:
        i, state, audit, cost = open_.pop()
        if cost > repair.DELETE * len(codes):
            continue
        if i == len(codes) and state in ("", "a"):
            done.append((cost, audit))
        open_ += [(i, r, audit + "I", cost + 3) for r in "ua" if (state, r) in repair.FOLLOWS]
        if i < len(codes):
            open_.append((i + 1, state, audit + "D", cost + 4))
            own, more = codes[i].lower(), 3 if codes[i].isupper() else 0
            if own in "sua" and (state, own) in repair.FOLLOWS:
                open_.append((i + 1, own, audit + "K", cost + more))
            if own != "-":
                open_ += [
                    (i + 1, r, audit + "R", cost + more + 3) for r in "ua" if r != own and (state, r) in repair.FOLLOWS
                ]
    return min(done)


def chained(codes: str) -> tuple[int, str]:
    """The same for long strings: whole audits carried from row to row."""
    best = {"": (0, "")}

    def with_insertions():
        out = []
        for state, (cost, audit) in best.items():
            for _ in range(4):
                out.append((state, cost, audit))
                state = next(r for r in "ua" if (state, r) in repair.FOLLOWS)
                cost, audit = cost + 3, audit + "I"
        return out

    for code in codes:
        new: dict = {}
        for state, cost, audit in with_insertions():
            for letter, role, more in repair._edits(code):
                if not role or (state, role) in repair.FOLLOWS:
                    weight, key = (cost + more, audit + letter), role or state
                    new[key] = min(new.get(key, weight), weight)
        best = new
    return min((cost, audit) for state, cost, audit in with_insertions() if state in ("", "a"))


def test_lightest_derivation_is_the_least_of_all_edit_strings():
    draw = random.Random(2)
    for _ in range(300):
        codes = "".join(draw.choice("sua-SUAXx") for _ in range(draw.randint(1, 5)))
        assert repair.derive(codes, "", True)["goal"] == exhaustive(codes) == chained(codes), codes


@pytest.mark.parametrize("chunk", [1, 2, 3, 7])
def test_chunks_compose_to_the_whole(monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    draw = random.Random(chunk)
    for _ in range(150):
        codes = "".join(draw.choice("sua-SUAXxuauaua") for _ in range(draw.randint(1, 40)))
        assert repair.part_repair(codes, "", None) == chained(codes), codes


def brute(rows):
    """What the query returns, by conversation; rows are those after damage."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(
            (r for r in rows if r[0] == conv),
            key=lambda r: (r[1] is not None, r[1] or 0, r[2][:32].encode(), r[3][:32].encode(),
                           hashlib.sha1(f"{r[2]}\n{r[3]}".encode()).digest()),
        )
        seen, codes, faults = set(), "", ""
        for _, _, role, text in own:
            said = text.strip(repair.SPACE)
            fault = "b" if not said else "d" if (role, text) in seen else "." if said[-1] in ".!?" else "t"
            seen.add((role, text))
            symbol = role[:1] if role[:1] in ("s", "u", "a") else "x"
            faults += fault
            codes += "-" if fault in "bd" else symbol.upper() if fault == "t" else symbol
        cost, audit = chained(codes)
        state, i, said = "", 0, []
        for letter in audit:
            if letter == "I" or letter == "R":
                state = next(r for r in "ua" if (state, r) in repair.FOLLOWS)
                said.append(f"{repair.ROLES[state]}:{own[i][3] if letter == 'R' else ''}")
            if letter == "K":
                state = own[i][2][0]
                said.append(f"{own[i][2]}:{own[i][3]}")
            i += letter != "I"
        turns = [r[1] for r in own if r[1] is not None]
        initials = [r[2][:1] for r in own]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"),
            faults.count("t"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(said).encode()).hexdigest(),
        )
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        place = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        case = zlib.crc32(place.encode()) % 20
        if case == 1:
            text = ""
        if case == 2:
            text = re.sub("[.!?]", "", text)
        if case == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    return out


def conversations(draw, convs=40, longest=9):
    texts = ["Yes.", "No", "", " \n", "Well!", "So it goes?", "é😀.", None, "x" * 5000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "unknown", "Ü"]
    rows = []
    for conv in [None, *range(convs)]:
        for turn in range(draw.randint(1, longest)):
            role = ["user", "assistant"][turn % 2] if draw.random() < 0.7 else draw.choice(roles)
            text = f"Turn {turn} of {conv}." if draw.random() < 0.6 else draw.choice(texts)
            rows.append((conv, turn if draw.random() < 0.9 else draw.choice([None, 2]), role, text))
    return rows


def results(spark, rows):
    df = spark.createDataFrame([(*r, "a", "p", "c") for r in rows], SCHEMA)
    found = repair.repair(repair.damage(df))
    table = repair.merge_facts(found.facts, repair.repaired_digests(found))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha256"]
    return {r.conv: tuple(r[c] for c in counts) for r in table.collect()}, found


@pytest.mark.parametrize("chunk", [3, 256])
def test_jobs_equal_row_by_row_code(spark, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rows = conversations(random.Random(chunk))
    # one conversation holds a third of all rows, so its parts lie in several partitions
    rows += [(7, 100 + i, ["user", "assistant"][i % 3 % 2], f"Said {i % 90}{'.' if i % 5 else ''}") for i in range(300)]
    got, found = results(spark, rows)
    assert got == brute(damaged(rows))
    assert found.parts.filter("conv = 7").count() > 1
    left = repair.repaired_rows(found).filter("conv = 7").orderBy("at", "step").collect()
    text = "\n".join(f"{r.role}:{r.text}" for r in left)
    assert hashlib.sha256(text.encode()).hexdigest() == got[7][-1]
    assert "".join(r.edit for r in left) == got[7][-2].replace("D", "")


def test_equal_rows_and_ties_in_turn(spark):
    rows = [(1, None, "user", "a.")] * 40 + [(1, None, "assistant", "b.")] * 2 + [(2, 5, "system", "s.")] * 3
    got, _ = results(spark, rows)
    assert got == brute(damaged(rows))


def test_empty_table(spark):
    got, found = results(spark, [])
    assert got == {} and repair.repaired_rows(found).isEmpty()


def test_query_keeps_conversations_without_rows(spark, tmp_path):
    from contactlake.llm.queries import op11_repair

    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hello."), (1001, 1, "user", "Hi."), (1001, 2, "assistant", "Ho.")]
    spark.createDataFrame([(*r, "a", "p", "c") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in op11_repair(spark, str(tmp_path)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(got[gone]) == (gone, 0, 0, 0, 0, 0, 0, "", empty)
    want = brute(damaged(rows))
    assert tuple(got[1001])[1:] == want[1001]


def test_parts_are_scratch_tables(spark):
    scratch = Scratch(spark, "repair")
    df = spark.createDataFrame([(1, 0, "user", "a.", "", "", "")], SCHEMA)
    found = repair.repair(df, scratch=scratch)
    assert found.facts.select(F.sum("cost")).head()[0] == 3 and found.parts.head().audit == "KI"

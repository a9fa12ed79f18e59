"""Repair of conversations against a plain dynamic program over whole conversations, and that one against all edits of short ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from clausemill.llm import conversations as cv
from clausemill.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"
VALID = re.compile(r"(s?(ua)+)?$")
EMPTY = hashlib.sha256(b"").hexdigest()


def faults(rows):
    """One fault or none for each (role, text) of a conversation in order."""
    out, before = [], set()
    for role, text in rows:
        bare = text.strip("\t\n\x0b\x0c\r ")
        out.append("blank" if not bare else "duplicate" if (role, text) in before else "truncated" if bare[-1] not in ".!?" else None)
        before.add((role, text))
    return out


def cheapest(rows, marks):
    """(cost, edits, repaired): least cost, then least edits, from the end of the conversation on."""
    roles = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    def with_insertions(ways, row_best):
        # more insertions lead to further states; two are as many as help
        best = dict(row_best)
        for _ in range(2):
            for st in roles:
                more = best.get(roles[st])
                if more is not None:
                    way = (more[0] + 2, "I" + more[1], [(full[roles[st]], ""), *more[2]])
                    if best.get(st) is None or way[:2] < best[st][:2]:
                        best[st] = way
        return best

    best = with_insertions(None, {"": (0, "", []), "a": (0, "", [])})
    for (role, text), mark in zip(reversed(rows), reversed(marks), strict=True):
        now = {}
        for st in roles:
            ways = []
            if st in best:
                c, e, r = best[st]
                ways.append((c + 3, "D" + e, r))
            if mark not in ("blank", "duplicate"):
                cut, to = int(mark == "truncated"), roles[st]
                if role[:1] == to and to in best:
                    c, e, r = best[to]
                    ways.append((c + cut, "K" + e, [(role, text), *r]))
                if st == "" and role[:1] == "s" and "s" in best:
                    c, e, r = best["s"]
                    ways.append((c + cut, "K" + e, [(role, text), *r]))
                if to in best:
                    c, e, r = best[to]
                    ways.append((c + 2 + cut, "R" + e, [(full[to], text), *r]))
            if ways:
                now[st] = min(ways, key=lambda w: w[:2])
        best = with_insertions(None, now)
    return best[""]


def report(rows):
    """Rows (turn, role, text) of a conversation in order."""
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", EMPTY)
    said = [(r, t) for _, r, t in rows]
    marks = faults(said)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(said))
    cost, audit, repaired = cheapest(said, marks)
    assert VALID.match("".join(r[0] for r, _ in repaired))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
    return (gaps, *[marks.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [(conv, turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return out


def brute(rows):
    by = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in damaged(rows):
        by[conv].append((turn, role, text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return sorted(((conv, *report(sorted(v, key=order))) for conv, v in by.items()), key=repr)


def found(spark, rows, tmp_path, parts=4):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"conv": F.lit("clash"), "block": F.lit(1), "copies": F.lit("x")})
    df.repartition(parts).write.parquet(f"{tmp_path}/conversations.parquet")
    return sorted((tuple(r) for r in queries.op11_conversation_repair(spark, str(tmp_path)).collect()), key=repr)


def some(rng, conv, n, step=1):
    out, turn = [], rng.randint(0, 3)
    for _ in range(n):
        role = rng.choice(["user", "assistant"] * 6 + ["system", "tool", "usher", "User", "", None])
        text = rng.choice(["Yes.", "No!", "maybe", "", " \t", None, "Why?  ", "\x85", "é.", "One.\nTwo"]) if rng.random() < 0.5 else f"Text {rng.random()}."
        out.append((conv, turn if rng.random() < 0.97 else None, role, text))
        turn += rng.choice([0, 1, 1, 1, 2]) * step
    return out


def test_mixed(spark, tmp_path):
    rng = random.Random(1)
    rows = [r for conv in range(400) for r in some(rng, conv, rng.randint(1, 9))]
    rows += some(rng, None, 40) + some(rng, -5, 700) + some(rng, 10**12, 300, 3)
    rows += [(7000, None, None, None)] * 3 + [(7001, None, "user", "Hi.")] * 5
    assert found(spark, rows, tmp_path) == brute(rows)


def test_regular_long_conversation_over_blocks(spark, tmp_path):
    rows = [(1, t, ["user", "assistant"][t % 2], f"Word {t}.") for t in range(1500)]
    rows += [(2, t, "user", f"Only {t}.") for t in range(600)] + [(3, t, "assistant", "Same.") for t in range(600)]
    assert found(spark, rows, tmp_path) == brute(rows)


def test_rows_that_repeat_in_a_turn(spark, tmp_path):
    rows = [(1, 5, "user", "Hello.")] * 3000 + [(1, 6, "assistant", "Yes.")] * 2 + [(2, 1, "system", "Be kind.")]
    assert found(spark, rows, tmp_path) == brute(rows)


def test_long_texts(spark, tmp_path):
    rows = [(1, 1, "user", "long " * 500000 + "."), (1, 2, "assistant", "x" * 2000000), (2, 1, "user", "\n" * 1000000)]
    assert found(spark, rows, tmp_path) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert found(spark, [], tmp_path) == []


def test_repaired_rows(spark):
    rows = [(1, 1, "assistant", "Good day."), (1, 2, "user", "Hi."), (1, 3, "user", ""), (1, 4, "tool", "Done.")]
    got = cv.repair_conversations(spark.createDataFrame(rows, SCHEMA)).rows().orderBy("conv", "place").collect()
    assert [(r.conv, r.place, r.role, r.text) for r in got] == [(":1", 0, "user", ""), (":1", 1, "assistant", "Good day."), (":1", 2, "user", "Hi."), (":1", 3, "assistant", "Done.")]


def every_edit(symbols, most=7):
    """Least (cost, edits) over all edit texts of bounded length."""
    best = None
    for n in range(most + 1):
        for edits in itertools.product("DIKR", repeat=n):
            if sum(e != "I" for e in edits) != len(symbols):
                continue
            cost, row, made = 0, 0, [""]
            for e in edits:
                if e == "I":
                    cost += 2
                    made = [m + r for m in made for r in "ua"]
                    continue
                s, row = symbols[row], row + 1
                if e == "D":
                    cost += 3
                elif s == "x":
                    made = []
                else:
                    cost += s.isupper() + (2 if e == "R" else 0)
                    made = [m + r for m in made for r in ("ua" if e == "R" else s.lower())]
            if any(VALID.match(m) for m in made) and (best is None or (cost, "".join(edits)) < best):
                best = (cost, "".join(edits))
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_plain_program_is_the_least_of_all_edits(n):
    role = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for symbols in itertools.product("xsuaoUA", repeat=n):
        rows = [(role.get(s.lower(), "user"), str(i)) for i, s in enumerate(symbols)]
        marks = ["blank" if s == "x" else "truncated" if s.isupper() else None for s in symbols]
        assert cheapest(rows, marks)[:2] == every_edit(symbols, n + 3), symbols


def test_products_do_not_depend_on_the_grammar(spark):
    rng = random.Random(3)
    seqs = ["".join(rng.choice("xsuaoSUAO" + "ua" * 9) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    rules = cv.grammar(spark.createDataFrame([(s, 3) for s in seqs], "seq string, n long"), rounds=5, per_round=4)
    assert 10 < len(rules) <= 20
    with_rules, without = cv.rule_matrices(rules), cv.rule_matrices([])
    for s in seqs:
        short = cv.replaced(s, rules)
        a = b = None
        for c in short:
            a = with_rules[c] if a is None else cv.times(a, with_rules[c])
        for c in s:
            b = without[c] if b is None else cv.times(b, without[c])
        assert {k: (c, cv.flat(r)) for k, (c, r) in a.items()} == {k: (c, cv.flat(r)) for k, (c, r) in b.items()}
        assert len(short) < len(s) or len(s) < 4

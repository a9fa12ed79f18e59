"""Repair of conversation structure: cheapest edits by min-plus matrices over a Re-Pair grammar of role and fault symbols."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import cmp_to_key

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, Scratch, hot_keys, salted_join, shuffle_partitions

# Symbols of rows: what must go (blank or seen before), and the role's initial (o: any other), in capitals where the text is cut off.
GONE, CLEAN, CUT = "x", "suao", "SUAO"
# States: nothing said yet, after a system, a user, an assistant row. Valid ends: nothing, or an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
NEXT_ROLE = {NOTHING: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}  # what may follow, besides system at the start
AFTER = {"user": USER, "assistant": ASSISTANT}
AFTER_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
REROLE, DELETE, INSERT, LEFT_CUT = 2, 3, 2, 1  # costs
RULES_FROM = 0xE000  # characters that stand for rules: a private range
BLOCK_ROWS, BLOCK_BYTES = 256, 1 << 20


# --- ropes: "" or a text of edits, or a pair of ropes; parts are shared, texts are made only of what is wanted


def leaves(rope) -> Iterator[str]:
    stack = [rope]
    while stack:
        r = stack.pop()
        if isinstance(r, str):
            yield r
        else:
            stack += (r[1], r[0])


def flat(rope) -> str:
    return "".join(leaves(rope))


def compare(a, b) -> int:
    """Order of two ropes' texts, read only up to where they differ."""
    for x, y in zip(*((c for leaf in leaves(r) for c in leaf) for r in (a, b)), strict=False):
        if x != y:
            return -1 if x < y else 1
    return len(flat(a)) - len(flat(b))


def join(a, b):
    return b if a == "" else a if b == "" else (a, b)


# --- transfer matrices: {(from, to): (cost, rope)}, with the cheapest way, of equal ones the least in ASCII


def _better(new, old) -> bool:
    return old is None or new[0] < old[0] or new[0] == old[0] and compare(new[1], old[1]) < 0


def times(x: dict, y: dict) -> dict:
    """Min-plus product. Ways of equal cost between two states are never the beginning of each other, so the least of a whole is made of least parts."""
    out: dict = {}
    for (i, k), (c1, r1) in x.items():
        for j in STATES:
            if (k, j) in y:
                c2, r2 = y[k, j]
                old = out.get((i, j))
                if old is None or c1 + c2 <= old[0]:
                    new = (c1 + c2, join(r1, r2))
                    if _better(new, old):
                        out[i, j] = new
    return out


def _insertions() -> dict:
    """None, one or two inserted rows: more lead to a state that fewer reach."""
    out = {}
    for i in STATES:
        at, text = i, ""
        for _ in range(3):
            out.setdefault((i, at), (INSERT * len(text), text))
            at, text = AFTER[NEXT_ROLE[at]], text + "I"
    return out


def _row(symbol: str) -> dict:
    """Insertions before a row, then what becomes of it."""
    step = {(i, i): (DELETE, "D") for i in STATES}
    if symbol != GONE:
        cut = LEFT_CUT * (symbol in CUT)
        for i in STATES:
            to = NEXT_ROLE[i]
            kept = to[0] == symbol.lower()
            step[i, AFTER[to]] = (cut, "K") if kept else (REROLE + cut, "R")
        if symbol.lower() == "s":
            step[NOTHING, SYSTEM] = (cut, "K")
    return times(_insertions(), step)


def end_costs() -> dict[int, tuple[int, str]]:
    """From each state the cheapest valid end."""
    ways = _insertions()
    return {i: min(ways[i, j] for j in (NOTHING, ASSISTANT) if (i, j) in ways) for i in STATES}


# --- the grammar


def replaced(text: str, rules: list[str]) -> str:
    """Pairs replaced from left to right, rule by rule."""
    for n, pair in enumerate(rules):
        text = text.replace(pair, chr(RULES_FROM + n))
    return text


def grammar(sequences: DataFrame, rounds: int = 6, per_round: int = 32) -> list[str]:
    """Re-Pair: the most frequent pairs of neighbours over all (seq, n) become symbols, again and again, until no pair occurs twice.

    A round counts the pairs of all sequences in the tasks and takes up to per_round of the most frequent ones that share no
    symbol at their touching ends, so that their replacements don't get in each other's way. Rounds bound the number of rules, not what is repaired.
    """
    rules: list[str] = []
    for _ in range(rounds):

        def pairs(frames: Iterator[pd.DataFrame], known=tuple(rules)) -> Iterator[pd.DataFrame]:
            counts: Counter = Counter()
            for f in frames:
                for seq, n in zip(f["seq"], f["n"].tolist(), strict=True):
                    s, at = replaced(seq, known), 0
                    while at < len(s) - 1:
                        counts[s[at : at + 2]] += n
                        # of three equal symbols one pair can be replaced
                        at += 2 if s[at : at + 3] == s[at] * 3 else 1
            yield pd.DataFrame(counts.items(), columns=["pair", "n"])

        top = sequences.mapInPandas(pairs, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        top = [r.pair for r in top.orderBy(F.desc("n"), "pair").limit(4 * per_round).collect()]
        firsts, seconds, new = set(), set(), []
        for a, b in top:
            if len(new) < per_round and a not in seconds and b not in firsts:
                new.append(a + b)
                firsts.add(a)
                seconds.add(b)
        if not new:
            break
        rules += new
    return rules


def rule_matrices(rules: list[str]) -> dict[str, dict]:
    """A matrix for each symbol and, bottom-up, each rule; ropes of a rule share those of its parts."""
    out = {s: _row(s) for s in GONE + CLEAN + CUT}
    for n, (a, b) in enumerate(rules):
        out[chr(RULES_FROM + n)] = times(out[a], out[b])
    return out


def _moves(frames: Iterator[pd.DataFrame], rules: list[str], tables: dict[str, dict]) -> Iterator[pd.DataFrame]:
    """For each sequence costs, order of the texts of edits among those from one state, and the texts, for from * 4 + to."""
    for f in frames:
        out = []
        for seq in f["seq"]:
            m = None
            for symbol in replaced(seq, rules):
                m = tables[symbol] if m is None else times(m, tables[symbol])
            cost, rank, audit = [None] * 16, [None] * 16, [None] * 16
            for i in STATES:
                to = sorted((j for j in STATES if (i, j) in m), key=cmp_to_key(lambda a, b: compare(m[i, a][1], m[i, b][1])))
                for place, j in enumerate(to):
                    cost[4 * i + j], rank[4 * i + j], audit[4 * i + j] = m[i, j][0], place, flat(m[i, j][1])
            out.append((seq, cost, rank, audit))
        yield pd.DataFrame(out, columns=["seq", "cost", "rank", "audit"])


# --- blocks of conversations, and the ways through them


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order as blocks of one conversation, bounded in rows and bytes. A text that must go stays behind."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    conv, seq, roles, texts, size, illegal, first, last = None, [], [], [], 0, 0, "", ""
    done: list[tuple] = []

    def close() -> None:
        nonlocal block, seq, roles, texts, size, illegal
        if seq:
            done.append((conv, block, "".join(seq), roles, texts, first, last, illegal))
            block, seq, roles, texts, size, illegal = block + 1, [], [], [], 0, 0

    def out() -> pd.DataFrame:
        f = pd.DataFrame(done, columns=["conv", "block", "seq", "roles", "texts", "first", "last", "illegal"])
        done.clear()
        return f

    for f in frames:
        for c, role, text, copies, gone, cut in zip(f["conv"], f["role"], f["text"], f["copies"].tolist(), f["gone"].tolist(), f["cut"].tolist(), strict=True):
            if c != conv:
                close()
                conv = c
            initial = role[:1]
            for nth in range(copies):
                if len(seq) >= BLOCK_ROWS or size >= BLOCK_BYTES:
                    close()
                    if len(done) >= 1024:
                        yield out()
                if not seq:
                    first = initial
                elif last + initial not in ("su", "ua", "au"):
                    illegal += 1
                last = initial
                if gone or nth:
                    seq.append(GONE)
                else:
                    symbol = initial if initial and initial in "sua" else "o"
                    seq.append(symbol.upper() if cut else symbol)
                    roles.append(role)
                    texts.append(text)
                    size += len(text)
        if done:
            yield out()
    close()
    yield out()


_BLOCKS = "conv string, block long, seq string, roles array<string>, texts array<string>, first string, last string, illegal long"
_WAYS = "conv string, block long, state int, edits string, at long, cost long, illegal long"
_DONE = "conv string, block long, at long, edits string, roles array<string>, texts array<string>"
_BACK = "conv string, block long, way array<int>, total long, audit array<string>, first string, last string, illegal long"


def _backward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks from the last to the first of each conversation: the state to leave each for, by the one it is entered in.

    Only the costs of what follows are carried along. Of ways of equal cost the one whose text comes first in this block wins: where one is the
    beginning of the other, the longer one only inserts what the shorter one's rest could insert as well.
    """
    conv, ahead = None, {}
    for f in frames:
        out = []
        for b in f.itertuples():
            if b.conv != conv:
                conv, ahead = b.conv, {i: c for i, (c, _) in end_costs().items()}
            way, now = [], {}
            for i in STATES:
                c, _, j = min((b.cost[4 * i + j] + ahead[j], b.rank[4 * i + j], j) for j in STATES if pd.notna(b.cost[4 * i + j]))
                way.append(j)
                now[i] = int(c)
            ahead = now
            out.append((b.conv, b.block, way, ahead[NOTHING], b.audit, b.first, b.last, b.illegal))
        yield pd.DataFrame(out, columns=["conv", "block", "way", "total", "audit", "first", "last", "illegal"])


def _forward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks from the first to the last: the state each is entered in, its edits, its place and what came before."""
    ends = end_costs()
    conv, state, at, last, held = None, NOTHING, 0, "", None
    names = ["conv", "block", "state", "edits", "at", "cost", "illegal"]
    for f in frames:
        out = []
        for b in f.itertuples():
            first, across = b.conv != conv, 0
            if first:
                if held:
                    held[3] += ends[state][1]
                conv, state, at = b.conv, NOTHING, 0
            else:
                across = int(last + b.first not in ("su", "ua", "au"))
            if held:
                out.append(held)
            to = int(b.way[state])
            edits = b.audit[4 * state + to]
            held = [b.conv, int(b.block), state, edits, at, int(b.total) if first else 0, int(b.illegal) + across]
            at += len(edits) - edits.count("D")
            state, last = to, b.last
        yield pd.DataFrame(out, columns=names)
    if held:
        held[3] += ends[state][1]
        yield pd.DataFrame([held], columns=names)


def _applied(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A block's rows after its edits. What a state allows tells the roles of new and changed rows."""
    for f in frames:
        out = []
        for b in f.itertuples():
            state, row, kept, roles, texts = b.state, 0, 0, [], []
            for e in b.edits:
                role, text = NEXT_ROLE[state], ""
                if e != "I":
                    if b.seq[row] != GONE:
                        role, text, kept = b.roles[kept] if e == "K" else role, b.texts[kept], kept + 1
                    row += 1
                if e != "D":
                    state = AFTER_INITIAL[role[0]]
                    roles.append(role)
                    texts.append(text)
            out.append((b.conv, b.block, b.at, b.edits, roles, texts))
        yield pd.DataFrame(out, columns=["conv", "block", "at", "edits", "roles", "texts"])


def key_of(conv_id: Column) -> Column:
    """Ids as text that tells null from the others."""
    return F.coalesce(F.concat(F.lit(":"), conv_id.cast("string")), F.lit(""))


class Repair:
    """blocks: repaired rows and edits by conversation and block; summary: a row for each conversation with rows."""

    def __init__(self, blocks: DataFrame, summary: DataFrame):
        self.blocks, self.summary = blocks, summary

    def rows(self) -> DataFrame:
        """conv, place (0, 1, ... within a conversation), role, text."""
        at = self.blocks.select("conv", "at", F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "r"))
        return at.select("conv", (F.col("at") + F.col("i")).alias("place"), F.col("r.roles").alias("role"), F.col("r.texts").alias("text"))


def repair_conversations(rows: DataFrame) -> Repair:
    """Cheapest edits that make each conversation's roles nothing, or system (at will) and then user and assistant by turns.

    rows: conv_id, turn, role, text; other columns are not looked at. A null id is a conversation of its own, a null role or text one blank.
    Rows go by turn (nulls first), those of one turn by role and text. Faults, the first counts: blank, duplicate (role and text seen
    earlier, compared by SHA-256), truncated (the last character that isn't blank is none of .!?). Blank and duplicate rows go.
    Keep costs 0, re-role 2, delete 3, insert 2, a truncated row that stays 1; of the cheapest edits those least in ASCII are taken.
    An empty table gives no rows.

    Equal rows are counted before anything is sorted, and the earliest turn of a role and text is looked up with hot ones salted.
    Rows are range-sorted, so that a conversation that holds much of the table is dealt to many tasks, and packed in blocks of symbols
    of at most BLOCK_ROWS rows and about BLOCK_BYTES bytes. Distinct blocks are counted, a grammar is made of all of them, and each distinct block is
    evaluated once. Two passes over narrow rows choose the ways through blocks; they carry four costs, or one state, from block to block.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    text, role = F.coalesce(F.col("text"), F.lit(" ")), F.coalesce(F.col("role"), F.lit(" "))
    every = rows.select(key_of(F.col("conv_id")).alias("conv"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    bare = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    each = every.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    each = each.withColumns({
        "same": F.xxhash64("conv", "role", F.sha2("text", 256)), "whole": F.sha2(F.concat_ws("\x00", F.sha2("conv", 256), F.sha2("role", 256), F.sha2("text", 256)), 256),
        "blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "cut": ~F.right(bare, F.lit(1)).isin(".", "!", "?"),
        "when": F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn")),
    })
    each = scratch.write(each, "rows")
    firsts = scratch.write(each.groupBy("same", "whole").agg(F.min("when").alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
    hot = [r.same for r in firsts.where(F.col("n") > max(512, each.count() // HOT_SHARE)).select("same").collect()]
    firsts = firsts.groupBy("same").agg(F.map_from_entries(F.collect_list(F.struct("whole", "first"))).alias("firsts"))  # one key, but for equal hashes
    told = salted_join(each, firsts, "same", hot, "turn", "left")
    seen = F.coalesce(F.col("when") > F.element_at("firsts", F.col("whole")), F.lit(False)) & ~F.col("blank")
    told = told.select("conv", "turn", "role", "text", "copies", "blank", seen.alias("seen"), "cut")
    known = scratch.write(told, "known")
    scratch.drop(each)
    counts = scratch.write(_counts(known), "counts")

    parts, order = shuffle_partitions(spark), ["conv", F.asc_nulls_first("turn"), "role"]
    # the beginning of a text helps to deal the rows of one turn; they are sorted by all of it
    dealt = known.repartitionByRange(parts, *order, F.left("text", F.lit(32))).sortWithinPartitions(*order, "text")
    gone = F.col("blank") | F.col("seen")
    dealt = dealt.select("conv", "role", F.when(gone, "").otherwise(F.col("text")).alias("text"), "copies", gone.alias("gone"), "cut")
    blocks = scratch.write(dealt.mapInPandas(_packed, _BLOCKS), "blocks")
    scratch.drop(known)

    counted = scratch.write(blocks.groupBy("seq").agg(F.count("*").alias("n")), "sequences")
    rules = grammar(counted)
    tables = rule_matrices(rules)
    moves = counted.select("seq").mapInPandas(lambda it: _moves(it, rules, tables), "seq string, cost array<long>, rank array<int>, audit array<string>")
    moves = scratch.write(moves, "moves")
    hot = hot_keys(counted, "seq", "n", counted.agg(F.sum("n")).first()[0] or 0)
    told = salted_join(blocks.drop("roles", "texts"), moves, "seq", hot, "block")
    told = told.select("conv", "block", "cost", "rank", "audit", "first", "last", "illegal").repartition(parts, "conv")
    back = told.sortWithinPartitions("conv", F.desc("block")).mapInPandas(_backward, _BACK)
    ways = scratch.write(back.sortWithinPartitions("conv", "block").mapInPandas(_forward, _WAYS), "ways")

    done = blocks.select("conv", "block", "seq", "roles", "texts").join(ways.hint("merge"), ["conv", "block"]).mapInPandas(_applied, _DONE)
    costs = ways.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    return Repair(done, counts.join(costs.hint("merge"), "conv"))


def _counts(known: DataFrame) -> DataFrame:
    """Gaps and faults of each conversation."""
    copies, zero = F.col("copies"), F.lit(0)
    once = F.when(F.col("blank") | F.col("seen"), zero).otherwise(1)
    by_turn = known.groupBy("conv", "turn").agg(
        F.sum(F.when(F.col("blank"), copies).otherwise(zero)).alias("blank"), F.sum(F.when(F.col("blank"), zero).otherwise(copies - once)).alias("duplicate"),
        F.sum(once * F.col("cut").cast("int")).alias("truncated"))
    turn = F.col("turn").cast("long")
    gaps = F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count("turn"), zero).cast("long")
    return by_turn.groupBy("conv").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])


def digests(blocks: DataFrame) -> DataFrame:
    """conv, audit (all edits in order) and the SHA-256 of the repaired rows as role:text, joined by newlines; rows are hashed as they come by."""
    parts = shuffle_partitions(blocks.sparkSession)
    return blocks.repartition(parts, "conv").sortWithinPartitions("conv", "block").mapInPandas(_digests, "conv string, audit string, repaired_sha256 string")


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["conv", "audit", "repaired_sha256"]
    conv, edits, sha, none = None, [], hashlib.sha256(), True
    for f in frames:
        out = []
        for b in f.itertuples():
            if b.conv != conv:
                if conv is not None:
                    out.append((conv, "".join(edits), sha.hexdigest()))
                conv, edits, sha, none = b.conv, [], hashlib.sha256(), True
            edits.append(b.edits)
            for role, text in zip(b.roles, b.texts, strict=True):
                sha.update(f"{'' if none else chr(10)}{role}:{text}".encode())
                none = False
        yield pd.DataFrame(out, columns=names)
    if conv is not None:
        yield pd.DataFrame([(conv, "".join(edits), sha.hexdigest())], columns=names)


def damaged(rows: DataFrame) -> DataFrame:
    """conversations with planted faults, by crc32 of conv_id:turn modulo 20: a row is dropped (0), emptied (1), loses its ends of sentences (2), is repeated (3) or becomes the user's (4)."""
    as_text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn"))) % 20
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace(as_text("text"), "[.!?]", "")).otherwise(as_text("text"))
    role = F.when(how == 4, "user").otherwise(as_text("role"))
    copies = F.explode(F.when(how == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy")
    return rows.where(how != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("_copy")

"""N-gram Jaccard self join: exact set similarity by universe-partition pigeonhole."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Aside, Scratch, connected_components, give_back, heavy_values, hot_keys, salted_join, shuffle_partitions
from .shingles import distinct, mix, shingle_set


@dataclass(frozen=True)
class Scheme:
    """How sets of one size band are cut: segments, whether each also has its one-deletion neighbourhood, and spare segments."""

    band: int
    segments: int
    deletions: bool
    spare: int


def band_of(n: int, percent: int) -> int:
    """Bands are wide enough that linked sets are in the same or in neighbouring bands."""
    return int(math.log(n) / math.log(100 / percent) + 1e-9)


def _largest(band: int, percent: int) -> int:
    n = max(1, int((100 / percent) ** (band + 1)) + 2)
    while band_of(n, percent) > band:
        n -= 1
    return n


def allocate(band: int, sets: int, percent: int) -> Scheme | None:
    """The cheapest complete allocation for pairs whose smaller set is in band.

    With at most `gap` elements in just one set of a pair, gap + 1 + spare segments leave
    spare + 1 equal ones; then empty segments, which say nothing, need not be indexed by a
    set that has at most `spare` of them. Or half as many segments leave one that
    differs by at most one element, found through one-deletion neighbourhoods. The cost
    counts index entries and, for sets^2, chance meetings in segments without elements.
    """
    big = _largest(band, percent)
    gap = (big + big * 100 // percent) * (100 - percent) // (100 + percent)
    if gap < 1:
        return None
    n = big * (1 + percent / 100) / 2
    options = []
    for spare in (0, 1, 2, 4, 8, 16):
        m = gap + 1 + spare
        p = math.exp(-n / m)
        more = 1 - sum(math.comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(spare + 1))
        meet = sets * sets * m * (p * max(0.0, more)) ** 2
        options.append((m * sets + meet, Scheme(band, m, False, spare)))
    m = gap // 2 + 1
    p = (1 + n / m) * math.exp(-n / m)
    options.append(((m + n) * sets + sets * sets * m * p * p, Scheme(band, m, True, m)))
    return min(options, key=lambda x: x[0])[1]


def signatures(s: np.ndarray, scheme: Scheme, seed: int) -> np.ndarray:
    """Index entries of one set under a scheme. Equal segments, or ones equal after one deletion, share an entry."""
    keyed = mix(s ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1)))
    seg = ((keyed >> np.uint64(32)) % np.uint64(scheme.segments)).astype(np.int64)
    order = np.argsort(seg, kind="stable")
    seg, val = seg[order], mix(keyed[order] + np.uint64(0x51ED270B))
    held, first = np.unique(seg, return_index=True)
    sums = np.add.reduceat(val, first)
    tag = mix(np.uint64(seed * 1_000_003 + scheme.band * 4 + 1) + (np.arange(scheme.segments, dtype=np.uint64) << np.uint64(20)))
    out = [mix(sums ^ tag[held])]
    if scheme.deletions:
        out.append(mix((np.repeat(sums, np.diff([*first, len(seg)])) - val) ^ tag[seg]))
    if scheme.segments - len(held) > (0 if scheme.deletions else scheme.spare):
        empty = np.setdiff1d(np.arange(scheme.segments), held, assume_unique=True)
        out.append(mix(tag[empty]))
    return distinct(np.concatenate(out))


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the set's elements in 2**j >= 2n bins, 64 to a word. Two sketches differ in at most as many bins as the sets do in elements."""
    bits = max(64, 2 << max(0, int(len(s) - 1)).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _folded(x: Column) -> Column:
    half = (F.size(x) / 2).cast("int")
    return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda a, b: a.bitwiseXOR(b))


def _apart(x: Column, y: Column) -> Column:
    """A lower bound of the number of elements in just one of two sets, from their sketches; 0 where widths differ by more than a factor of 2.

    Sets that may link differ by at most that, from 50 percent on.
    """
    wide, narrow = F.when(F.size(x) >= F.size(y), x).otherwise(y), F.when(F.size(x) >= F.size(y), y).otherwise(x)
    level = F.when(F.size(wide) > F.size(narrow), _folded(wide)).otherwise(wide)
    differ = F.zip_with(level, narrow, lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    return F.coalesce(F.aggregate(differ, F.lit(0), lambda acc, n: acc + n), F.lit(0))


def _may_link(n: Column, m: Column, x: Column, y: Column, percent: int) -> Column:
    """Two sets' sizes and sketches don't rule out that they link."""
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (_apart(x, y) * (100 + percent) <= (n + m) * (100 - percent))


def fingerprint(s: np.ndarray) -> int:
    """64 bits of a whole set, 0 for the empty one."""
    if not len(s):
        return 0
    h = mix(np.add.reduce(mix(s + np.uint64(77))) + np.uint64(len(s)))
    return int(np.asarray(h, np.uint64).view(np.int64)) or 1


def _meetings(docs: DataFrame, k: int, percent: int, schemes: dict[int, Scheme], buckets: int, block_bytes: int) -> DataFrame:
    """(sig, fp, leader) for each index entry that at least two different sets have; leader is the least fp there.

    Entries travel packed: a task collects those of up to block_bytes of text, and sends
    to each bucket of the hash space one row with 6 bytes of each entry and the number of its set.
    """

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sigs: list[np.ndarray] = []
        nos: list[np.ndarray] = []
        fps: dict[int, int] = {}
        size = 0

        def flush():
            nonlocal sigs, nos, fps, size
            if not sigs:
                return None
            sig, no = np.concatenate(sigs), np.concatenate(nos)
            at = (sig % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            sig, no, at = sig[order], no[order], at[order]
            held, first = np.unique(at, return_index=True)
            table = np.array(list(fps), np.int64)
            rows = []
            for b, i, j in zip(held.tolist(), first, [*first[1:], len(at)], strict=True):
                used, back = np.unique(no[i:j], return_inverse=True)
                high = (sig[i:j] >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]
                rows.append((b, np.ascontiguousarray(high).tobytes(), back.astype(np.uint16).tobytes(), table[used].tobytes()))
            sigs, nos, fps, size = [], [], {}, 0
            return pd.DataFrame(rows, columns=["bucket", "sigs", "nos", "fps"])

        for f in frames:
            for t in f["text"]:
                s = shingle_set(t, k)
                fp = fingerprint(s)
                if not fp or fp in fps:
                    continue
                own = band_of(len(s), percent)
                got = [signatures(s, schemes[b], 0) for b in (own - 1, own) if b in schemes]
                if not got:
                    continue
                entries = np.concatenate(got)
                sigs.append(entries)
                nos.append(np.full(len(entries), len(fps), np.int32))
                fps[fp] = len(fps)
                size += len(t)
                if size > block_bytes or len(fps) == 1 << 16:
                    yield flush()
        if (last := flush()) is not None:
            yield last
        give_back()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        high = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, 6) for x in pdf["sigs"]])
        sig = np.zeros((len(high), 8), np.uint8)
        sig[:, :6] = high
        sig = sig.view(np.int64).reshape(-1)
        fp = np.concatenate([np.frombuffer(t, np.int64)[np.frombuffer(x, np.uint16)] for x, t in zip(pdf["nos"], pdf["fps"], strict=True)])
        order = np.lexsort((fp, sig))
        sig, fp = sig[order], fp[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (fp[1:] != fp[:-1])
        sig, fp = sig[new], fp[new]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        count = np.diff([*start, len(sig)])
        leader = np.repeat(fp[start], count)
        keep = np.repeat(count > 1, count)
        # buckets are told apart by the part of the entry that did not travel
        return pd.DataFrame({"sig": sig[keep] * buckets + int(pdf["bucket"].iloc[0]), "fp": fp[keep], "leader": leader[keep]})

    packed = docs.select(F.col("text").cast("binary").alias("text")).mapInPandas(pack, "bucket int, sigs binary, nos binary, fps binary")
    return packed.groupBy("bucket").applyInPandas(meet, "sig long, fp long, leader long")


def _same(s: np.ndarray, t: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    both = np.concatenate([s, t])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _crowd_pairs(x: pd.DataFrame, percent: int, within: bool, half: int, one: bool) -> pd.DataFrame:
    """(a, b, an, bn, key): pairs of sets of x (fp, component, n, sketch) in different components that sizes and sketches don't tell apart.

    Of all sets, or of the first half with the others. one: of each set only the pair with the least other set. key is the component of a.
    """
    raw = [np.asarray(r, np.int64).view(np.uint64) for r in x["sketch"]]
    n, fp, comp = (x[c].to_numpy(np.int64) for c in ("n", "fp", "component"))
    widths = np.array([len(r) for r in raw])
    by_size = np.argsort(n, kind="stable")
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for width in np.unique(widths):
        # wider sketches fold to this width; partners are at most one width apart
        own = by_size[widths[by_size] == width]
        near = by_size[(widths[by_size] == width) | (widths[by_size] == 2 * width)]
        table = np.array([raw[i] if len(raw[i]) == width else raw[i][:width] ^ raw[i][width:] for i in near])
        sizes = n[near]
        at = 0
        while at < len(own):
            # sets in the order of their sizes: partners are a range
            lo = np.searchsorted(sizes, math.ceil(n[own[at]] * percent / 100))
            hi = np.searchsorted(sizes, n[own[at]] * 100 // percent, "right")
            rows = own[at : at + max(1, (1 << 21) // max(1, (hi - lo) * width))]
            hi = np.searchsorted(sizes, n[rows[-1]] * 100 // percent, "right")
            at += len(rows)
            some = near[lo:hi]
            mine = np.array([raw[i] for i in rows])
            apart = np.bitwise_count(mine[:, None, :] ^ table[None, lo:hi, :]).sum(2, dtype=np.int64)
            ok = apart * (100 + percent) <= (n[rows][:, None] + n[some][None, :]) * (100 - percent)
            ok &= comp[rows][:, None] != comp[some][None, :]
            if within:
                ok &= (rows[:, None] < some[None, :]) | (widths[some][None, :] > width)
            else:
                ok &= (rows[:, None] < half) != (some[None, :] < half)
            if one:
                held = np.flatnonzero(ok.any(1))
                least = np.where(ok[held], fp[some][None, :], np.iinfo(np.int64).max).argmin(1)
                found.append((rows[held], some[least]))
            else:
                i, j = np.nonzero(ok)
                found.append((rows[i], some[j]))
    i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    flip = fp[i] > fp[j]
    i, j = np.where(flip, j, i), np.where(flip, i, j)
    return pd.DataFrame({"a": fp[i], "b": fp[j], "an": n[i], "bn": n[j], "key": comp[i]})


def crowd_links(hot: DataFrame, links: DataFrame, docs: DataFrame, sets: DataFrame, k: int, percent: int, scratch: Scratch, block: int = 4096, *, elements: int = 1 << 24) -> DataFrame:
    """links, and those among sets that meet in crowded entries; hot has (sig, fp).

    Sets that crowded entries chain together form a crowd. A crowd is dealt to blocks of about
    `block` sets, or fewer where those hold more than `elements` shingles, and every two of its blocks are compared in one task, by bit operations
    on sketches, so that a crowd of many texts that are alike, but not enough to link, needs no row per pair. A first round takes
    one pair of each set, a second one all pairs in components that are still apart; the pairs are then compared as wholes.
    """
    lead = hot.groupBy("sig").agg(F.min("fp").alias("a"))
    edges = hot.join(lead.hint("merge"), "sig").select("a", F.col("fp").alias("b")).distinct()
    crowds = scratch.write(connected_components(edges, scratch), "crowds").select(F.col("node").alias("fp"), F.col("component").alias("crowd"))
    members = crowds.join(sets.select("fp", "n", "sketch").hint("merge"), "fp")
    sizes = members.groupBy("crowd").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / elements)).cast("int").alias("blocks"))
    members = salted_join(members, scratch.write(sizes, "sizes"), "crowd", heavy_values(crowds, "crowd"), "fp")
    members = scratch.write(members.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")), "members")

    def comparing(one: bool):
        def compare(pdf: pd.DataFrame) -> pd.DataFrame:
            first, second = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
            pdf = pdf.sort_values(["own", "fp"], ignore_index=True)
            return _crowd_pairs(pdf, percent, first == second, int((pdf["own"] == first).sum()), one)

        return compare

    for one in (True, False):
        labels = scratch.write(connected_components(links, scratch), "labels")
        now = members.join(labels.select(F.col("node").alias("fp"), "component").hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
        dealt = now.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("crowd", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp", "component", "n", "sketch")
        close = dealt.groupBy("crowd", "i", "j").applyInPandas(comparing(one), "a long, b long, an long, bn long, key long").distinct()
        close = scratch.write(close, "close")
        links = links.union(_compared(close, docs, sets, k, percent, scratch))
        scratch.drop(close, labels)
    scratch.drop(members)
    return links


ELEMENTS = 1 << 21  # shingles that a task compares at a time


def set_links(docs: DataFrame, told: DataFrame, k: int, percent: int, scratch: Scratch, crowd: int = 64, block_bytes: int = 6 << 20) -> DataFrame:
    """(a, b): links between fingerprints of different sets, enough of them to connect all that links connect.

    A first round compares each set with the least set it meets anywhere. Sets that
    are then connected need no more comparing; a second round compares all others that meet:
    as pairs, or as a crowd where more than `crowd` do.
    """
    sets = told.where("n > 0").groupBy("fp").agg(F.min("_row").alias("_row"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    sets = scratch.write(sets, "sets")
    width = math.log(100 / percent)
    # one row for each size band: their number is the logarithm of the longest text
    banded = sets.groupBy(F.floor(F.log(F.col("n")) / F.lit(width) + F.lit(1e-9)).cast("int").alias("band")).agg(F.count("*").alias("sets"), F.sum("n").alias("n")).collect()
    sizes = {r["band"]: r["sets"] for r in banded}
    schemes = {b: x for b in {b for own in sizes for b in (own - 1, own) if b >= 0} if (x := allocate(b, sizes.get(b, 0) + sizes.get(b + 1, 0), percent))}
    entries = sum(r["n"] for r in banded) * 2 * (100 - percent) / percent + 1
    buckets = max(shuffle_partitions(docs.sparkSession), math.ceil(entries / 500_000))
    met = scratch.write(_meetings(docs, k, percent, schemes, buckets, block_bytes), "met")

    first = met.groupBy("fp").agg(F.min("leader").alias("a")).where("a <> fp").select("a", F.col("fp").alias("b"))
    links = _compared(_close(first, sets, percent, scratch).withColumn("key", F.col("a")), docs, sets, k, percent, scratch)
    labels = scratch.write(connected_components(links, scratch), "labels")
    known = met.join(labels.hint("merge"), F.col("fp") == F.col("node"), "left").select("sig", "fp", F.coalesce("component", "fp").alias("component"))
    known = scratch.write(known, "known")
    scratch.drop(met, labels)
    mixed = known.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("held")).where("lo <> hi").select("sig", "held")
    open_ = known.join(mixed.hint("merge"), "sig").join(sets.select("fp", "n", "sketch").hint("merge"), "fp")
    open_ = scratch.write(open_, "open")
    scratch.drop(known)
    calm = open_.where(F.col("held") <= crowd).select("sig", "fp", "component", "n", "sketch")
    hot = open_.where(F.col("held") > crowd).select("sig", "fp")
    # sizes and sketches are part of the join: at most `crowd` sets meet in an entry, and only pairs that may link leave it
    l, r = calm.alias("l"), calm.alias("r")
    met_again = (F.col("l.sig") == F.col("r.sig")) & (F.col("l.component") < F.col("r.component"))
    pairs = l.join(r.hint("merge"), met_again & _may_link(F.col("l.n"), F.col("r.n"), F.col("l.sketch"), F.col("r.sketch"), percent))
    flip = F.col("l.fp") > F.col("r.fp")
    pick = lambda c, x, y: F.when(flip, F.col(f"{y}.{c}")).otherwise(F.col(f"{x}.{c}"))
    close = pairs.select(pick("fp", "l", "r").alias("a"), pick("fp", "r", "l").alias("b"), pick("n", "l", "r").alias("an"), pick("n", "r", "l").alias("bn")).distinct()
    all_links = _connecting(scratch.write(close, "close"), links, docs, sets, k, percent, scratch)
    if not hot.isEmpty():
        all_links = crowd_links(hot, all_links, docs, sets, k, percent, scratch)
    scratch.drop(sets, open_)
    return all_links


def _close(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b, an, bn): the pairs that sizes and sketches don't tell apart."""
    pairs = scratch.write(pairs, "pairs")
    hot = heavy_values(pairs, "a")
    a = sets.select(F.col("fp").alias("a"), F.col("n").alias("an"), F.col("sketch").alias("ask"))
    b = sets.select(F.col("fp").alias("b"), F.col("n").alias("bn"), F.col("sketch").alias("bsk"))
    close = salted_join(pairs, a, "a", hot, "b").join(b.hint("merge"), "b")
    close = close.where(_may_link(F.col("an"), F.col("bn"), F.col("ask"), F.col("bsk"), percent))
    close = scratch.write(close.select("a", "b", "an", "bn"), "close")
    scratch.drop(pairs)
    return close


def _compared(close: DataFrame, docs: DataFrame, sets: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs of close (a, b, an, bn, key) whose sets have 100 * intersection >= percent * union.

    Whole sets don't travel. Pairs are dealt to groups of about ELEMENTS shingles by their key, pairs of a key with more
    than that by a and b as well, and a group gets the text of each of its sets once.
    """
    close = close.select("key", "a", "b", "an", "bn")
    held = close.select("key", F.col("a").alias("fp"), F.col("an").alias("n")).union(close.select("key", "b", "bn")).distinct()
    keys = held.groupBy("key").agg(F.sum("n").alias("size"), F.count("*").alias("n"))
    total, rows, large = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("size") > ELEMENTS, 1))).first()
    if large:
        keys = scratch.write(keys, "keys")
        slots = keys.where(F.col("size") > ELEMENTS).select("key", F.ceil(F.col("size") * 2 / ELEMENTS).cast("int").alias("slots"))
        dealt = salted_join(close, slots, "key", hot_keys(keys, "key", "n", rows), "b", "left").withColumn("slots", F.coalesce("slots", F.lit(1)))
    else:
        dealt = close.withColumn("slots", F.lit(1))
    slot = lambda c: F.pmod(F.xxhash64(c), F.col("slots"))
    group = F.when(F.col("slots") == 1, F.pmod(F.xxhash64("key"), F.lit(max(1, math.ceil(total / ELEMENTS))))).otherwise(F.xxhash64("key", slot("a"), slot("b")))
    dealt = scratch.write(dealt.select("a", "b", group.alias("g")), "dealt")
    if large:
        scratch.drop(keys)
    members = dealt.select(F.col("g").alias("group"), F.col("a").alias("fp")).union(dealt.select("g", F.col("b"))).distinct()
    members = members.join(sets.select("fp", "_row").hint("merge"), "fp")
    texts = docs.select("_row", F.col("text").cast("binary").alias("text")).join(members.hint("merge"), "_row")
    # dealt by group first, so that telling apart equal rows and grouping need no further shuffle
    texts = texts.select("group", "fp", "text").repartition("group").dropDuplicates(["group", "fp"])

    def compare(texts: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        held = {fp: shingle_set(t, k) for fp, t in zip(texts["fp"], texts["text"], strict=True)}
        keep = []
        for a, b in zip(pairs["a"], pairs["b"], strict=True):
            x, y = held[a], held[b]
            shared = _same(x, y)
            keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
        return pairs.loc[keep, ["a", "b"]]

    found = scratch.write(texts.groupBy("group").cogroup(dealt.groupBy("g")).applyInPandas(compare, "a long, b long"), "links")
    scratch.drop(dealt)
    return found


def _open(close: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs of close whose ends labels (node, component) don't connect, with key, the component of a."""
    of = lambda end, name: labels.select(F.col("node").alias(end), F.col("component").alias(name)).hint("merge")
    rows = close.join(of("a", "_ca"), "a", "left").join(of("b", "_cb"), "b", "left")
    rows = rows.withColumns({"_ca": F.coalesce("_ca", "a"), "_cb": F.coalesce("_cb", "b")})
    return rows.where("_ca <> _cb").select("a", "b", "an", "bn", F.col("_ca").alias("key"))


def _connecting(close: DataFrame, links: DataFrame, docs: DataFrame, sets: DataFrame, k: int, percent: int, scratch: Scratch, rounds: int = 1) -> DataFrame:
    """links, and those of close that connect what all links of close connect.

    Sets that many pairs connect need few of them compared: rounds that compare each b with one a only leave out pairs that are connected
    by then. Pairs that no round decides are all compared.
    """
    for _ in range(rounds):
        pairs, ends = close.agg(F.count("*"), F.count_distinct("b")).first()
        if pairs <= 2 * ends:
            break
        one = close.groupBy("b").agg(F.min(F.struct("a", "an", "bn")).alias("m")).select("m.a", "b", "m.an", "m.bn", F.col("m.a").alias("key"))
        one = scratch.write(one, "one")
        links = links.union(_compared(one, docs, sets, k, percent, scratch))
        labels = scratch.write(connected_components(links, scratch), "labels")
        rest = close.join(one.select("a", "b").hint("merge"), ["a", "b"], "left_anti")
        rest = scratch.write(_open(rest, labels).drop("key"), "close")
        scratch.drop(one, labels, close)
        close = rest
    labels = scratch.write(connected_components(links, scratch), "labels")
    out = links.union(_compared(scratch.write(_open(close, labels), "left"), docs, sets, k, percent, scratch))
    scratch.drop(close, labels)
    return out


def _components(keyed: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """(doc_id, _row, n, c, component_id) for every row of keyed (doc_id, _row, text); c is the key of the component."""
    told = scratch.write(_described(keyed, k), "told")
    links = set_links(keyed, told, k, percent, scratch)
    labels = scratch.write(connected_components(links, scratch), "labels")
    found = told.join(labels.hint("merge"), told["fp"] == labels["node"], "left").select("doc_id", "_row", "n", F.coalesce("component", "fp").alias("c"))
    found = scratch.write(found, "found")
    scratch.drop(told, labels)
    least = scratch.write(found.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("component_id")), "least")
    out = salted_join(found, least, "c", heavy_values(found, "c"), "_row", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.withColumn("component_id", component)


def _keyed(docs: Aside) -> DataFrame:
    return docs.rows.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), F.xxhash64(docs["doc_id"], docs["text"]).alias("_row"))


def ngram_join(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text).

    Words are separated by blanks, A-Z lowered; a text's set holds its distinct k-word
    shingles, or its whole word sequence if that is shorter. Sets link when 100 *
    intersection >= percent * union, and component_id is the smallest doc_id that links
    reach. Null and wordless texts have no shingles and are alone. Repeated rows and
    copies share a set and so a component; a null doc_id counts only where all ids of a
    component are null; extra columns are not looked at.

    Shingles are compared as 64-bit hashes, sets with equal 64-bit fingerprints as one.
    """
    out = _components(_keyed(Aside(docs)), k, percent, Scratch(docs.sparkSession))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _described(keyed: DataFrame, k: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n, fp, sketch = [], [], []
            for t in f["text"]:
                s = shingle_set(t, k)
                n.append(len(s))
                fp.append(fingerprint(s))
                sketch.append(parity_sketch(s))
            yield pd.DataFrame({"doc_id": f["doc_id"], "_row": f["_row"], "n": n, "fp": fp, "sketch": sketch})
        give_back()

    plain = keyed.select(F.col("doc_id").cast("string").alias("doc_id"), "_row", F.col("text").cast("binary").alias("text"))
    return plain.mapInPandas(run, "doc_id string, _row long, n long, fp long, sketch array<long>").withColumn("doc_id", F.col("doc_id").cast("long"))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of linked documents: that with the smallest doc_id, then the least hash of id and text; a null id comes last.

    Documents without words are all kept, but for repeated rows of one doc_id: rows with equal doc_id and text
    count as one document. All columns stay as they are, whatever their names.
    """
    side = Aside(docs)
    scratch = Scratch(docs.sparkSession)
    joined = scratch.write(_components(_keyed(side), k, percent, scratch).select("_row", "doc_id", "n", "c"), "joined")
    first = joined.where("n > 0").groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")).alias("m"))
    kept = first.select(F.col("m._row").alias("_row")).union(joined.where("n = 0").select("_row"))
    kept = scratch.write(kept.distinct(), "kept")
    scratch.drop(joined)
    row = F.xxhash64(side["doc_id"], side["text"])
    return side.rows.withColumn("_row", row).join(kept.hint("merge"), "_row", "left_semi").dropDuplicates(["_row"]).select(*side.back())

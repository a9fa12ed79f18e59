"""Clashing columns, repeated rows, null ids, ties, long texts, and brute-force versions of what SQL can't express."""

import math
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clausemill.llm import context_mixing as cm
from clausemill.llm.common import Aside, Scratch, fold, heavy_values, numbered
from clausemill.llm.decontaminate import drop_leaks, find_leaks, normal
from clausemill.llm.langid import _fit, has_letter, keep_known_languages, predict_language, subword_counts, train_language_id
from clausemill.llm.licenses import TEMPLATES, scan_licenses
from clausemill.llm.lines import dedup_lines
from clausemill.llm.lm_scoring import score_texts
from clausemill.llm.mixing import mix_sources, mixed_stream
from clausemill.llm.ngram_join import drop_near_copies, ngram_join
from clausemill.llm.secrets import RULES, scan_secrets
from clausemill.llm.sharding import shard_documents

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string"
LINE = "a line of more than forty characters that many documents hold"
# names that operators give their own or their working columns
NAMES = ["N_bytes", "shard_id", "depth", "shard_bytes", "_hash", "_row", "_p", "n_lines", "n_dropped", "kept_text", "secrets", "_kinds", "n_words", "labels", "score", "size",
         "source_size", "target", "taken", "finish", "_key", "lang_pred", "rejected", "key", "line", "sha", "n", "c", "fp", "a", "b", "row", "token", "held_out", "_drop", "rep"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocab = ["the", "house", "was", "built", "with", "stone", "and", "wood", "by", "people", "of", "town"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = [say(rng.randint(1, 40)) for _ in range(30)]
    out = [(i, f"{t}\n{LINE}" if i % 2 else t, ["en", "de", None][i % 3], ["x", "y", None][i % 3]) for i, t in enumerate(base)]
    out += [(40 + i, base[0] + " " + base[1], "en", "x") for i in range(6)]
    out += [(None, base[2], "en", "x"), (None, None, None, None), (50, "", "en", "y"), (51, "½ ² 12 !", "en", "y"), (52, "token = 0123456789abcdef0123", "en", "z")]
    out += [(53, "w" * 300_000, "en", "z"), (53, "w" * 300_000, "en", "z"), (54, "under the mit license " * 3, "de", "z"), (54, "under the mit license " * 3, "de", "z")]
    return out


@pytest.fixture(scope="module")
def clash(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({n: F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) for n in NAMES}).repartition(3)


def whole(df, names):
    return sorted(repr([r[n] for n in names]) for r in df.select(*[F.col(f"`{n}`") for n in names]).collect())


ADDING = {
    "shard": (lambda d: shard_documents(d, byte_limit=2000), ("n_bytes", "shard_id", "depth", "shard_bytes")),
    "mix": (mix_sources, ("size", "source_size", "target", "taken", "finish")),
    "lines": (dedup_lines, ("n_lines", "n_dropped", "kept_text")),
    "secrets": (scan_secrets, ("secrets",)),
    "licenses": (scan_licenses, ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")),
    "language": (lambda d: predict_language(d, None), ("lang_pred", "score", "rejected")),
}


@pytest.mark.parametrize("name", ADDING)
def test_added_columns_win_and_others_stay(clash, tmp_path, name):
    run, added = ADDING[name]
    stay = [c for c in clash.columns if c.lower() not in added]
    out = run(clash)
    assert out.columns == [*stay, *added]
    out.write.parquet(str(tmp_path / "out"))  # no name twice
    assert whole(out, stay) == whole(clash, stay)
    assert whole(out, ["doc_id", "text", *added]) == whole(run(clash.select("doc_id", "text", "lang", "source")), ["doc_id", "text", *added]) or name in ("shard", "mix")


@pytest.mark.parametrize("run", [ngram_join, lambda d: score_texts(d, fold(F.col("doc_id"), 10) == 0), lambda d: find_leaks(d, d.limit(0).selectExpr("doc_id AS item_id", "text"))])
def test_other_columns_are_not_looked_at(clash, run):
    narrow = run(clash.select("doc_id", "text"))
    assert whole(run(clash), narrow.columns) == whole(narrow, narrow.columns)


def test_filters_keep_rows_as_they_are(clash, rows):
    whole_rows = set(whole(clash, clash.columns))
    bench = clash.sparkSession.createDataFrame([(1, rows[0][1])], "item_id long, text string")
    kept = drop_near_copies(clash)
    assert kept.columns == clash.columns and set(whole(kept, clash.columns)) <= whole_rows
    want = {i for i, (n, c) in brute.ngram_join([(i, t) for i, t, *_ in rows if i is not None], 5, 80).items() if n == 0 or c == i}
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1
    left = drop_leaks(clash, bench)
    assert left.columns == clash.columns and set(whole(left, clash.columns)) < whole_rows
    said = keep_known_languages(clash, None)
    assert said.columns == clash.columns and said.count() == 0
    mixed = mixed_stream(clash)
    assert mixed.columns == clash.columns and set(whole(mixed, clash.columns)) <= whole_rows


def test_repeated_rows_and_null_ids(clash, rows):
    got = ngram_join(clash).collect()
    assert len(got) == len(rows)
    of = {}
    for r in got:
        of.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert of[53] == {(1, 53)} and len({c for i in range(40, 46) for _, c in of[i]}) == 1
    assert {x.n_dropped for x in dedup_lines(clash).where("doc_id IN (53, 54)").collect()} == {0}
    scores = score_texts(clash, F.lit(False)).collect()
    assert len(scores) == len(rows) and len({r.score for r in scores if r.doc_id == 53}) == 1 and sum(r.doc_id is None for r in scores) == 2
    mixed = mix_sources(clash).select("doc_id", "size", "taken").collect()
    assert all(0 <= r.taken <= 2 * r.size for r in mixed) and len(mixed) == len(rows)
    again = mix_sources(clash.repartition(2)).select("doc_id", "size", "taken").collect()
    assert sorted(map(repr, again)) == sorted(map(repr, mixed))


def test_shards_against_a_plain_directory(spark):
    """The same buckets as splitting one by one, given each row's hash."""
    rng = random.Random(3)
    sizes = [rng.randint(0, 900) for _ in range(300)] + [5000] * 3
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(sizes)], "doc_id long, text string")
    hashed = {r.doc_id: r.h for r in df.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 4).alias("h")).collect()}

    def split(ids, depth):
        if depth < 60 and len(ids) > 1 and sum(sizes[i] for i in ids) > 2000:
            low = [i for i in ids if not hashed[i] >> (59 - depth) & 1]
            return [*split(low, depth + 1), *split([i for i in ids if i not in set(low)], depth + 1)]
        return [(depth, i) for i in ids]

    want = {i: d for d, i in split(list(range(len(sizes))), 0)}
    for steps in (18, 2):
        got = shard_documents(df, byte_limit=2000, spare_bits=1, step_bits=steps).collect()
        assert {r.doc_id: r.depth for r in got} == want
        assert all(r.shard_id == f"{r.depth}:" + (f"{hashed[r.doc_id] >> (60 - r.depth):0{r.depth}b}" if r.depth else "") for r in got)


def test_numbers_of_equal_rows(spark):
    scratch = Scratch(spark)
    df = scratch.write(spark.range(1000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id % 5 END AS k", "id"), "rows")
    got = {}
    for r in numbered(df, "k", scratch, parts=4).collect():
        got.setdefault(r.k, []).append(r._no)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in got.values())
    assert heavy_values(df, "k") and 7 in heavy_values(df, "k")


def test_model_scores_against_a_plain_loop(spark):
    """costs() of a fitted model, bit by bit."""
    texts = [b"the cat sat on the mat", b"the dog sat on the log", b"a cat and a dog"] * 4
    code, n = cm.counted(cm.codes_of(texts)[0])
    tables = []
    for k in range(cm.DENSE):
        zero, one = np.zeros(1 << cm.SLOT_BITS[k]), np.zeros(1 << cm.SLOT_BITS[k])
        for c, w in zip(code.tolist(), n.tolist(), strict=True):
            for node, bit in cm.bits_of(np.array([c])):
                (one if bit[0] else zero)[cm.slots(np.array([c]), node, k)[0]] += w
        tables.append(cm.quantised(zero, one))
    model = cm.Model(tables)
    cm.learn(model, code, n)
    model.refine = cm.refined(*cm.refinement(model, code, n))
    got = model.costs(code, n)

    def counts(k, c, j):
        zeros = ones = 0
        for d, w in zip(code.tolist(), n.tolist(), strict=True):
            if (d >> 8) % (1 << 8 * k) == (c >> 8) % (1 << 8 * k) and (d & 255) >> (8 - j) == (c & 255) >> (8 - j):
                if d >> (7 - j) & 1:
                    ones += w
                else:
                    zeros += w
        return zeros, ones

    by_gate = model.params[: cm.GATES * (cm.ORDERS + 1)].reshape(cm.GATES, -1)
    by_node = model.params[cm.GATES * (cm.ORDERS + 1) :].reshape(256, -1)
    for at in (0, 7, len(code) // 2, len(code) - 1):
        c, total = int(code[at]), 0.0
        for j in range(8):
            node, bit = 1 << j | (c & 255) >> (8 - j), c >> (7 - j) & 1
            st, gate = [], 0
            for k in range(cm.ORDERS):
                a, b = counts(k, c, j)
                st.append(math.log((b + 0.1) / (a + 0.1)))
                if k >= 3:
                    gate = gate * 4 + sum(a + b >= x for x in (1, 3, 16))
            x = by_gate[gate, cm.ORDERS] + sum((by_gate[gate, k] + by_node[node, k]) * st[k] for k in range(cm.ORDERS))
            p = 1 / (1 + math.exp(-max(-20, min(20, x))))
            p = (p + model.refine[node, max(-16, min(16, round(x * 2))) + 16]) / 2
            p = min(max(p, 1e-6), 1 - 1e-6)
            total += math.log10(p if bit else 1 - p)
        assert abs(total - got[at]) < 1e-4


def plain_leaks(rows, items, rate=0.08):
    """Every item against every text by a full table of edit distances."""
    found = {}
    for d, t in rows:
        for i, item in items:
            p, s = normal(item), normal(t)
            if p and s and (dist := brute.edit_distance_within(p, s)) <= int(len(p) * rate):
                found[d, i] = dist
    return found


def test_leaks_against_every_distance(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 14)))) for i in range(12)] + [(20, "short one"), (21, ""), (None, "an item without a number here")]
    rows = []
    for d in range(60):
        parts = [word() for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 2)):
            t = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 4)):
                if t:
                    at = rng.randrange(len(t))
                    t[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "E"])
            parts.insert(rng.randint(0, len(parts)), "".join(t))
        rows.append((d, " ".join(parts)))
    rows += [(100, ("word " * 20000) + items[0][1].upper()), (101, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in find_leaks(df, bench, block_chars=120).collect()}
    want = plain_leaks([r for r in rows if r[0] != 100], items)
    assert {k: v for k, v in got.items() if k[0] != 100} == want and got[100, 0] == 0


def test_language_by_plain_sums():
    rng = random.Random(1)
    say = {"en": ["the", "house", "thing"], "de": ["der", "schön", "nicht"]}
    texts = [(" ".join(rng.choice(say[l]) for _ in range(rng.randint(1, 9))), l) for _ in range(60) for l in say]
    model = _fit([subword_counts(t) for t, _ in texts], [l for _, l in texts], 3, 0.5, 1)
    for t in ["the house", "schön", "x", "der nicht " * 200_000]:
        b = b"   " + b" ".join(bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in t.lower().encode()).split()) + b"   "
        b = b[:5000] if len(b) < 5000 else b
        if len(b) < 10_000:
            k, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
            z = np.zeros(2)
            for i in range(len(b) - 3):
                three = int.from_bytes(b[i : i + 3], "big")
                four = int.from_bytes(b[i : i + 4], "big")
                z += model.table[((three + 1) * k & mask) >> 47] + model.table[(((four + 1) * k & mask) >> 47) + (1 << 17)].astype(float)
            z = (z / (2 * (len(b) - 3)) + model.bias) / model.temperature
            p = np.exp(z - z.max())
            assert np.allclose(model.probabilities([t])[0], p / p.sum(), atol=1e-5)
    # a long text, slice by slice, is scored like the short one it repeats
    assert np.allclose(model.probabilities(["der nicht " * 200_000]), model.probabilities(["der nicht " * 2000]), atol=1e-3)


def test_training_draws_rows_apart(spark):
    say = {"en": "the house with a thing number", "de": "der schöne und nicht das haus nummer"}
    df = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.when(F.col("id") % 2 == 0, say["en"]).otherwise(say["de"]), F.lit(" "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"))
    assert train_language_id(df, F.lit(True), sample_docs=200).labels == ["de", "en"]
    same = df.limit(1).crossJoin(spark.range(5000)).drop("id").unionByName(df.limit(300))
    assert train_language_id(same, F.lit(True), sample_docs=200).labels == ["de", "en"]
    assert train_language_id(df.withColumn("text", F.lit("½ 12")), F.lit(True)) is None


def test_letters():
    assert not any(map(has_letter, ["", "½ ²", "123", "!?", "٣"])) and all(map(has_letter, ["a", "1ß", "щ", "中"]))


def test_und_for_texts_without_letters(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    model = train_language_id(df, F.lit(True))
    got = {r.doc_id: r for r in predict_language(df.where("doc_id IS NOT NULL"), model).collect()}
    assert got[51].lang_pred == "und" and got[51].rejected and got[50].lang_pred == "und" and got[53].lang_pred != "und"


EXTRA = {
    "github": ("ghp_" + "a1B2" * 10, "xghp_short"), "slack": ("xoxb-" + "1234567890ab", "xox-1234567890ab"), "google": ("AIza" + "Ab3_" * 8 + "xyz", "AIza" + "short"),
    "jwt": ("eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + ".sig_9", "eyJa.eyJb.c"), "pem": ("-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PUBLIC KEY-----"),
}


def test_added_secret_kinds(spark):
    rows = [(i, f"é {EXTRA[r.kind][0]} end") for i, r in enumerate(RULES) if r.kind in EXTRA] + [(100 + i, EXTRA[r.kind][1]) for i, r in enumerate(RULES) if r.kind in EXTRA]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.secrets if s.kind in EXTRA] for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, r in enumerate(RULES):
        if r.kind in EXTRA:
            assert got[i] == [(r.kind, 2, 2 + len(EXTRA[r.kind][0]))] and got[100 + i] == []


def test_license_labels_against_plain_cover(spark):
    """A template counts where grams on diagonals within 3 words of each other cover 60 % of it."""
    rng = random.Random(2)
    rows = []
    for i, (name, t) in enumerate(TEMPLATES.items()):
        w = t.split()
        rows += [(10 * i, " ".join(["x"] * rng.randint(0, 5) + w)), (10 * i + 1, " ".join(w[: len(w) // 3])), (10 * i + 2, " ".join(w[: len(w) // 2] + ["odd", "words"] + w[len(w) // 2 :]))]

    def labels(text):
        w, out = text.split(), set()
        for name, t in TEMPLATES.items():
            tw = t.split()
            grams = {}
            for i in range(len(tw) - 2):
                grams.setdefault(tuple(tw[i : i + 3]), []).append(i)
            hits = sorted((p - i, i) for p in range(len(w) - 2) for i in grams.get(tuple(w[p : p + 3]), ()))
            spans = []
            for d, i in hits:
                if spans and d - spans[-1][0] <= 3:
                    spans[-1][0] = d
                    spans[-1][1].add(i)
                else:
                    spans.append([d, {i}])
            if any(len(c) >= 0.6 * (len(tw) - 2) for _, c in spans):
                out.add(name)
        return out

    got = {r.doc_id: set(r.labels.split(",")) - {""} - {"mit", "apache-2", "cc-by-nc"} for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: labels(t) for d, t in rows}


@pytest.fixture(scope="module")
def sf(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    items = [(1, "a benchmark passage of words that no other text has in this very order and form")]
    leak = [(60, "the house and " + items[0][1] + " and more", "en", "x")]
    spark.createDataFrame([*rows, *leak], SCHEMA).withColumns({"rejected": F.lit("r"), "target": F.lit("t"), "_row": F.lit(5), "n_chars": F.length("text")}).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_pipeline_stage_by_stage(spark, sf, rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns == columns or name == "sharding"
        docs = Scratch(spark).write(out, name)
        seen[name] = docs.collect()
    first = {r.doc_id for r in seen["language_id"]}
    assert not {50, 51} & first and {0, 1, 53, 60} <= first and all((r.rejected, r.target, r._row) == ("r", "t", 5) for r in seen["mixing"])
    groups = brute.ngram_join([(r.doc_id, r.text) for r in seen["language_id"] if r.doc_id is not None], 5, 80)
    assert {r.doc_id for r in seen["near_copies"]} - {None} == {i for i, (n, c) in groups.items() if n == 0 or c == i}
    assert {r.doc_id for r in seen["near_copies"]} - {r.doc_id for r in seen["decontamination"]} == {60}
    assert {r.doc_id for r in seen["mixing"]} <= {r.doc_id for r in seen["decontamination"]} and len(seen["sharding"]) == len(seen["mixing"])
    run = corpus_pipeline.run(spark, sf)
    assert sorted(map(repr, run.collect())) == sorted(map(repr, seen["sharding"]))


def test_stages_take_empty_tables(spark, sf):
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).collect() == []


def test_aside_keeps_names(spark):
    side = Aside(spark.createDataFrame([(1, 2)], "A long, b long"))
    assert side.rows.select(*side.back("a")).columns == ["b"] and "B" in side and "c" not in side


def test_scratch_is_released(spark, tmp_path):
    scratch = Scratch(spark)
    scratch.write(spark.range(3), "x")
    scratch.release()
    assert not shutil.os.path.exists(scratch.root)

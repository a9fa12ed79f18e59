"""Language ID: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Aside, give_back

BITS = 18
DIM = 16
SLICE = 1 << 19  # bytes of text whose subwords are hashed at once
_SPACE = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    """Whether any character is of a letter category; a number such as one half is none."""
    return any(map(str.isalpha, text))


def _normal(text: str) -> bytes:
    """Lower case, what is no letter of ASCII and no further byte of UTF-8 as one blank, three blanks around."""
    return b"   " + b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACE).split()) + b"   "


def _buckets(b: np.ndarray) -> np.ndarray:
    """The bucket of the 3-byte and that of the 4-byte subword at each place but the last three, side by side."""
    b = b.astype(np.uint64)
    three = (b[:-3] << np.uint64(16)) | (b[1:-2] << np.uint64(8)) | b[2:-1]
    four = (three << np.uint64(8)) | b[3:]
    k = np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - BITS + 1)
    # the halves of the table keep the two lengths apart
    a = ((three + np.uint64(1)) * k) >> shift
    c = (((four + np.uint64(1)) * k) >> shift) + np.uint64(1 << (BITS - 1))
    return np.stack([a, c], 1).astype(np.int64)


def _subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed buckets of all 3- and 4-byte subwords of the texts' words, and each text's number of them.

    Words are padded by one blank on both sides; subwords of one text come together.
    """
    normal = [_normal(t) for t in texts]
    lengths = np.array([len(x) for x in normal], np.int64)
    b = np.frombuffer(b"".join(normal), np.uint8)
    # windows that begin in a text's last three bytes run over into the next text's padding
    keep = np.ones(len(b), bool)
    for j in range(1, 4):
        keep[np.cumsum(lengths) - j] = False
    return _buckets(b)[keep[:-3]].reshape(-1), 2 * (lengths - 3)


def subword_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's subwords and how often each occurs; slice by slice, so that scratch memory is bounded."""
    b = np.frombuffer(_normal(text), np.uint8)
    total = None
    for at in range(0, len(b) - 3, SLICE):
        u, n = np.unique(_buckets(b[at : at + SLICE + 3]), return_counts=True)
        if total is None and at + SLICE + 3 >= len(b):
            return u, n
        total = np.zeros(1 << BITS, np.int64) if total is None else total
        total[u] += n
    u = np.flatnonzero(total)
    return u, total[u]


@dataclass
class LanguageModel:
    labels: list[str]
    table: np.ndarray  # a row of logits for each bucket: embedding times weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def means(self, texts: list[str]) -> np.ndarray:
        """Each text's average logits."""
        buckets, counts = _subwords(texts)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        logits = np.stack([np.add.reduceat(self.table[:, j][buckets], starts, dtype=np.float64) for j in range(len(self.labels))], 1)
        return logits / np.maximum(counts, 1)[:, None]

    def long_mean(self, text: str) -> np.ndarray:
        u, n = subword_counts(text)
        return (n @ self.table[u].astype(np.float64)) / max(1, n.sum())

    def probabilities(self, texts: list[str]) -> np.ndarray:
        z = np.zeros((len(texts), len(self.labels)))
        short = [i for i, t in enumerate(texts) if len(t) <= SLICE]
        if short:
            z[short] = self.means([texts[i] for i in short])
        for i in set(range(len(texts))) - set(short):
            z[i] = self.long_mean(texts[i])
        z = (z + self.bias) / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def _fit(counts: list[tuple[np.ndarray, np.ndarray]], labels: list[str], epochs: int, rate: float, seed: int) -> LanguageModel | None:
    """SGD over single documents, each given by its subword counts; every fifth is held back for temperature and threshold."""
    names = sorted(set(labels))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in labels])
    seen = [(u, (n / max(1, n.sum())).astype(np.float32)) for u, n in counts]
    emb = (rng.random((1 << BITS, DIM), np.float32) - 0.5) / DIM
    w = np.zeros((DIM, len(names)), np.float32)
    bias = np.zeros(len(names), np.float32)
    held = np.arange(len(seen)) % 5 == 4 if len(seen) >= 50 else np.zeros(len(seen), bool)
    train = np.flatnonzero(~held)
    total, done = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            u, f = seen[i]
            lr = rate * (1 - done / total)
            done += 1
            h = f @ emb[u]
            z = h @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = w @ p
            w -= lr * np.outer(h, p)
            bias -= lr * p * 0.01
            emb[u] -= (lr * len(u)) * np.outer(f, back) if len(u) < 64 else (lr * 64) * np.outer(f, back)
    model = LanguageModel(names, (emb @ w).astype(np.float32), bias, 1.0, 0.0)
    check = np.flatnonzero(held) if held.any() else train
    logits = np.stack([seen[i][1] @ model.table[seen[i][0]] + bias for i in check])
    truth = y[check]

    def soft(t: float) -> np.ndarray:
        e = np.exp((logits - logits.max(1, keepdims=True)) / t)
        return e / e.sum(1, keepdims=True)

    grid = np.geomspace(0.1, 10, 41)
    loss = [-np.log(np.maximum(soft(t)[np.arange(len(check)), truth], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = soft(model.temperature)
    right = p.max(1)[p.argmax(1) == truth]
    # rejects what is less sure than nearly all right answers, and never what is surer than an even bet
    model.threshold = float(min(np.quantile(right, 0.001) * 0.9, 0.5)) if len(right) else 0.0
    return model


def _packed_counts(text: str) -> bytes:
    u, n = subword_counts(text)
    return zlib.compress(u.astype(np.int32).tobytes() + n.astype(np.int32).tobytes(), 1)


def _unpacked_counts(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(packed), np.int32)
    return both[: len(both) // 2], both[len(both) // 2 :]


def train_language_id(docs: DataFrame, where: Column, sample_docs: int = 6000, epochs: int = 4, rate: float = 0.5, seed: int = 7) -> LanguageModel | None:
    """Fits on the sample_docs labelled rows with the smallest digests among those of where.

    The bound on rows is a parameter; each row is read whole, as the counts of its subwords, of
    which a row has at most 2**BITS. Rows need a language and a letter in their text. The digest
    covers id, text and language: rows with a common or null id are drawn apart from each
    other, rows equal in all three count once. No usable row: None.
    """
    usable = where & F.col("lang").isNotNull() & F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False))
    digest = F.shiftrightunsigned(F.xxhash64("doc_id", "text", "lang"), 1)
    rows = docs.where(usable).select(digest.alias("k"), "text", F.col("lang").cast("string").alias("lang"))
    n = rows.count()
    share = 4 * sample_docs / max(1, n)
    while True:
        # few digests leave each task, whatever the input; more where rows repeat so often that these are too few
        low = rows.where(F.col("k") < int(share * 2**63)) if share < 1 else rows
        drawn = [r["k"] for r in low.select("k").distinct().orderBy("k").limit(sample_docs).collect()]
        if len(drawn) == sample_docs or share >= 1:
            break
        share *= 8
    if not drawn:
        return None

    @F.pandas_udf("binary")
    def packed(text: pd.Series) -> pd.Series:
        return pd.Series([_packed_counts(t) for t in text])

    sample = rows.where(F.col("k") <= drawn[-1]).select("k", "lang", packed("text").alias("counts")).dropDuplicates(["k"])
    got = sorted((r["k"], r["lang"], bytes(r["counts"])) for r in sample.toLocalIterator())
    model = _fit([_unpacked_counts(c) for _, _, c in got], [x for _, x, _ in got], epochs, rate, seed)
    got.clear()
    give_back()
    return model


def _predicted(docs: DataFrame, model: LanguageModel | None, text: Column, chunk_bytes: int) -> DataFrame:
    """docs with _p, a struct of lang_pred, score and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(text: pd.Series) -> pd.DataFrame:
        m = shared.value
        lang, score = np.full(len(text), "und", object), np.zeros(len(text))
        held = np.ones(len(text), bool)
        if m is not None:
            queue: list[int] = []
            size = 0
            spoken = [i for i, t in enumerate(text) if isinstance(t, str) and has_letter(t)]
            for i in [*spoken, -1]:
                if i >= 0:
                    queue.append(i)
                    size += len(text.iloc[i])
                if queue and (i < 0 or size > chunk_bytes):
                    p = m.probabilities([text.iloc[j] for j in queue])
                    best = p.argmax(1)
                    lang[queue] = np.array(m.labels, object)[best]
                    score[queue] = p[np.arange(len(queue)), best]
                    held[queue] = score[queue] < m.threshold
                    queue, size = [], 0
        return pd.DataFrame({"lang_pred": lang, "score": score, "rejected": held})

    return docs.withColumn("_p", predict(text))


def predict_language(docs: DataFrame, model: LanguageModel | None, chunk_bytes: int = 1 << 19) -> DataFrame:
    """docs with lang_pred, score and rejected.

    Only the text is looked at, whole. Null text, and text without a letter, has lang_pred
    "und", score 0 and is rejected; else lang_pred is the likeliest label, score its
    calibrated probability, and rejected says that it is below the model's threshold.
    Without a model all is "und". Repeated rows get the same again; extra columns stay, but for
    those named like an added one, which gives the added one's values.
    """
    side = Aside(docs)
    out = _predicted(side.rows, model, side["text"], chunk_bytes)
    added = ("lang_pred", "score", "rejected")
    return out.select(*side.back(*added), *[F.col(f"_p.{a}").alias(a) for a in added])


def keep_known_languages(docs: DataFrame, model: LanguageModel | None, chunk_bytes: int = 1 << 19) -> DataFrame:
    """The rows of docs that predict_language doesn't reject, with all their columns as they are, whatever their names."""
    side = Aside(docs)
    return _predicted(side.rows, model, side["text"], chunk_bytes).where(~F.col("_p.rejected")).select(*side.back())

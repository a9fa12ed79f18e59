"""Fill-in-the-middle forms of texts; the cuts are found by ranks in a wavelet matrix over character classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Aside, give_back

# Fixed tags of the forms.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

# Classes of the bytes of UTF-8 text. The first byte of a character tells its class, the others continue it.
CONTINUES, NEWLINE, BLANK, WORD_START, WORD_REST = range(5)
CLASS_BITS = 3
# Units whose starts a class marks; each text's first unit starts with the text, whatever stands there.
STARTS = {"char": (NEWLINE, BLANK, WORD_START, WORD_REST), "word": (WORD_START,), "line": (NEWLINE,)}
MIXED_BYTES = 1 << 22  # texts whose matrix is built at once; a longer text has one of its own
_BLANKS = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])


def classes(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The class of each byte of texts that lie one behind the other and begin at the given places."""
    blank = _BLANKS[data]
    after_blank = np.empty(len(data), bool)
    after_blank[1:] = blank[:-1]
    after_blank[begins[begins < len(data)]] = True
    out = np.where(after_blank, WORD_START, WORD_REST).astype(np.uint8)
    out[blank] = BLANK
    out[data == 10] = NEWLINE
    out[data & 0xC0 == 0x80] = CONTINUES
    return out


class Bits:
    """A bit vector with the number of ones before each block of 64 bits."""

    def __init__(self, bits: np.ndarray):
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each of the places."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)


class WaveletMatrix:
    """Values of CLASS_BITS bits, one bit vector for each bit from the highest; a level is sorted by the bit above it, zeros first."""

    def __init__(self, values: np.ndarray):
        self.n, self.levels = len(values), []
        for k in reversed(range(CLASS_BITS)):
            bits = (values >> k & 1).astype(bool)
            self.levels.append((k, Bits(bits), len(bits) - int(bits.sum())))
            values = np.concatenate([values[~bits], values[bits]])

    def rank(self, value: int, at: np.ndarray) -> np.ndarray:
        """How often the value stands before each of the places."""
        low, high = np.zeros_like(at), at
        for k, bits, zeros in self.levels:
            low1, high1 = bits.rank(low), bits.rank(high)
            low, high = (zeros + low1, zeros + high1) if value >> k & 1 else (low - low1, high - high1)
        return high - low

    def starts(self, unit: str, at: np.ndarray) -> np.ndarray:
        """Starts of units before each of the places, as a sum of ranks."""
        return sum(self.rank(c, at) for c in STARTS[unit])


def unit_counts(matrix: WaveletMatrix, unit: str, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Units of each text; a newline ends a line, so that a text has a line more than newlines. An empty text has none."""
    marks = matrix.starts(unit, end) - matrix.starts(unit, begin)
    return np.where(end > begin, marks + (unit == "line"), 0)


def cut_places(matrix: WaveletMatrix, unit: str, begin: np.ndarray, end: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Where the given number of units of each text ends: where the next one starts, by bisection on ranks.

    No unit ends where the text begins, all of them where it ends. Lines start behind a newline.
    """
    marks = units if unit == "line" else units + 1  # starts that lie before the place, that of the next unit among them
    base = matrix.starts(unit, begin)
    low, high = begin.copy(), end.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        enough = matrix.starts(unit, np.minimum(mid + 1, end)) - base >= marks
        high = np.where(open_ & enough, mid, high)
        low = np.where(open_ & ~enough, mid + 1, low)
    place = np.minimum(low + (unit == "line"), end)
    return np.where(units <= 0, begin, place)


def _cut(batches: Iterator[pa.RecordBatch], unit: str, plain_from: int, spm_below: int) -> Iterator[pa.RecordBatch]:
    """Adds n, form, prefix_units, middle_units and fim_text to batches with the columns text, h1 to h4."""
    for whole in batches:
        texts = whole.column("_text").cast(pa.large_binary())
        edges = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + MIXED_BYTES, "right")) - 1)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[at] : edges[to]]
            yield _cut_part(whole.slice(at, to - at), data, edges[at : to + 1] - edges[at], unit, plain_from, spm_below)
            at = to
        give_back()


def _cut_part(rows: pa.RecordBatch, data: np.ndarray, edges: np.ndarray, unit: str, plain_from: int, spm_below: int) -> pa.RecordBatch:
    begin, end = edges[:-1], edges[1:]
    matrix = WaveletMatrix(classes(data, begin))
    n = unit_counts(matrix, unit, begin, end)
    h1, h2, h3, h4 = (rows.column(f"_h{i}").to_numpy() for i in (1, 2, 3, 4))
    first, second = h1 % (n + 1), h2 % (n + 1)
    first, second = np.minimum(first, second), np.maximum(first, second)
    one, two = cut_places(matrix, unit, begin, end, first), cut_places(matrix, unit, begin, end, second)
    raw, form, out = data.tobytes(), [], []
    for i in range(len(n)):
        b, p, m, e = int(begin[i]), int(one[i]), int(two[i]), int(end[i])
        text = raw[b:e]
        if not text or h3[i] % 100 >= plain_from or any(t.encode() in text for t in (PREFIX, SUFFIX, MIDDLE)):
            form.append("plain")
            out.append(text)
        elif h4[i] % 100 < spm_below:
            form.append("spm")
            out.append(b"".join((b"<S>", raw[m:e], b"<P>", raw[b:p], b"<M>", raw[p:m])))
        else:
            form.append("psm")
            out.append(b"".join((b"<P>", raw[b:p], b"<S>", raw[m:e], b"<M>", raw[p:m])))
    cut = np.array([f != "plain" for f in form], bool)
    some = lambda v: pa.array(v, pa.int64(), mask=~cut)
    kept = [rows.column(i) for i, name in enumerate(rows.schema.names) if not name.startswith("_")]
    names = [name for name in rows.schema.names if not name.startswith("_")]
    added = [pa.array(n, pa.int64()), pa.array(form), some(first), some(second - first), pa.array(out, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(kept + added, names=names + ["_n", "_form", "_prefix", "_middle", "_out"])


def fill_in_middle(docs: DataFrame, unit: str = "char", seed: str = "1", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """docs without text, with n_units, form, prefix_units, middle_units and fim_text: the text cut in three and put in another order.

    Units are characters (code points), words or lines. Four numbers come from the SHA-256 of seed, colon and doc_id (a
    null one counts as the text "null"): the first two, modulo n_units + 1, are where prefix and middle end, the third leaves a share of texts plain,
    the fourth tells the form. Plain are also empty texts and those that hold a tag; null counts as empty. A plain text's
    units of prefix and middle are null. Equal rows get equal results. Nothing is shuffled; a text is read whole, as bytes. Columns of docs that are
    named like an added one give way to it.
    """
    side = Aside(docs)
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(side["doc_id"].cast("string"), F.lit("null"))), 256)
    numbers = {f"_h{i}": F.conv(F.substring(hexed, 8 * i - 7, 8), 16, 10).cast("long") for i in (1, 2, 3, 4)}
    names = {"n_units": "_n", "form": "_form", "prefix_units": "_prefix", "middle_units": "_middle", "fim_text": "_out"}
    kept = side.rows.select(*[c for c, n in zip(side.rows.columns, side.names, strict=True) if n.lower() != "text"])
    added = T.StructType.fromDDL("_n long, _form string, _prefix long, _middle long, _out string")
    rows = side.rows.select(*kept.columns, F.coalesce(side["text"].cast("string"), F.lit("")).alias("_text"), *[v.alias(k) for k, v in numbers.items()])
    done = rows.mapInArrow(lambda b: _cut(b, unit, plain_from, spm_below), T.StructType(kept.schema.fields + added.fields))
    return done.select(*side.back("text", *names), *[F.col(v).alias(k) for k, v in names.items()])


def restored(form: Column, fim_text: Column) -> Column:
    """The text that a form was made of. No tag stands in a text that was cut, so the first of each kind parts the pieces."""

    def pieces(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substring(fim_text, len(first) + 1, 1 << 30)
        a = F.substring_index(rest, second, 1)
        rest = rest.substr(F.length(a) + len(second) + 1, F.lit(1 << 30))
        b = F.substring_index(rest, MIDDLE, 1)
        return a, b, rest.substr(F.length(b) + len(MIDDLE) + 1, F.lit(1 << 30))

    prefix, suffix, middle = pieces(PREFIX, SUFFIX)
    suffix2, prefix2, middle2 = pieces(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(fim_text)

"""Document fingerprints by locally consistent parsing.

A text is a string of code points. Runs of equal symbols become single symbols, then
deterministic coin tossing (Cole and Vishkin) labels each symbol by the lowest bit in
which it differs from the one before it; a few rounds leave labels from a small set
with neighbours still different, and where a label is a local maximum a phrase begins. A phrase's
name is a hash of its symbols. The names are the symbols of the next level, and so on
until one is left. Where a phrase begins depends on a few symbols around it only, so a
substring has the same phrases inside it wherever it lies in whatever text.

A fingerprint is a sketch of the set of names: names of ``FIRST_LEVEL`` and above fall
into bins, each of which keeps its smallest. Likeness is the share of bins, of those
that either has, in which two fingerprints agree: about the Jaccard similarity of the
sets of phrases. All texts of a batch are parsed together as one numpy array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

ROUNDS = 3
#: Phrases of this level and above (about ten characters and more) count; and the name of a whole text.
FIRST_LEVEL = 2
BINS = 64
#: Code points parsed together.
BATCH_CHARS = 1 << 18
EMPTY = "----"

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the SplitMix64 generator."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _coin(x: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Twice the place of the lowest bit in which x differs from before, plus x's bit there."""
    differs = x ^ before
    lowest = differs & (~differs + x.dtype.type(1))
    if x.dtype == np.uint32:  # the exponent of a power of two is its place
        place = (lowest.astype(np.float32).view(np.uint32) >> np.uint32(23)).astype(np.uint8) - np.uint8(127)
    else:
        place = ((lowest.astype(np.float64).view(np.uint64) >> _U(52)) - _U(1023)).astype(np.uint8)
    return (place << np.uint8(1)) + ((x & lowest) != 0)


#: What the further rounds give, for any two different labels under 128.
_AGAIN = _coin(np.repeat(np.arange(128, dtype=np.uint32), 128), np.tile(np.arange(128, dtype=np.uint32), 128)).astype(np.uint8)


def _toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A round of coin tossing. The first symbol of a text is held against another one."""
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[first] = x[first] ^ x.dtype.type(1)
    if x.dtype == np.uint8:
        return _AGAIN[(x.astype(np.uint16) << np.uint16(7)) | before]
    return _coin(x, before)


def parse_level(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the next level, and the indices in them of the texts' first symbols.

    ``x``: symbols of all texts; ``first``: where each (non-empty) text begins.
    """
    edge = np.zeros(len(x), bool)
    edge[first] = True
    head = edge.copy()
    head[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(head)
    runs = np.diff(np.append(at, len(x)))
    symbol, edge = x[at], edge[at]
    begin = np.flatnonzero(edge)
    label = symbol
    for _ in range(ROUNDS):
        label = _toss(label, begin)
    cut = edge.copy()
    inner = np.zeros(len(cut), bool)
    inner[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    inner[:-1] &= ~edge[1:]  # the last symbol of a text has no right neighbour
    inner[1:] &= ~edge[:-1]  # a phrase holds two symbols at least
    cut |= inner
    start = np.flatnonzero(cut)
    length = np.diff(np.append(start, len(symbol)))
    place = np.arange(len(symbol)) - np.repeat(start, length)
    power = np.cumprod(np.full(int(length.max()) + 1, 0x9E3779B97F4A7C15, _U))
    term = symbol.astype(_U) + (runs.astype(_U) << _U(32))
    term = (term ^ (term >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    term = (term ^ (term >> _U(32))) * power[place]
    names = _mix(np.add.reduceat(term, start) + length.astype(_U))
    return names, np.flatnonzero(edge[start])


def phrases(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of text, name) for the counted phrases of all ``texts``."""
    data = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    which = np.array([i for i, d in enumerate(data) if len(d)], np.int64)
    if not len(which):
        return np.empty(0, np.int64), np.empty(0, _U)
    data = [data[i] for i in which]
    x = np.concatenate(data)
    first = np.concatenate(([0], np.cumsum([len(d) for d in data])[:-1]))
    owners, names, level = [], [], 0
    while len(which):
        x, first = parse_level(x, first)
        level += 1
        size = np.diff(np.append(first, len(x)))
        whole = size == 1
        if level >= FIRST_LEVEL:
            owners.append(np.repeat(which, size))
            names.append(_mix(x ^ _U(level)))
        elif whole.any():
            owners.append(which[whole])
            names.append(_mix(x[first[whole]] ^ _U(level)))
        if whole.any():
            keep = np.repeat(~whole, size)
            x, which, size = x[keep], which[~whole], size[~whole]
            first = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else np.empty(0, np.int64)
    return np.concatenate(owners), np.concatenate(names)


def sketches(texts: list[str]) -> np.ndarray:
    """len(texts) x BINS: 16 bits of the smallest name in each bin, -1 for none."""
    out = np.full((len(texts), BINS), -1, np.int32)
    begin = 0
    while begin < len(texts):
        end, chars = begin, 0
        while end < len(texts) and (end == begin or chars + len(texts[end]) <= BATCH_CHARS):
            chars += len(texts[end])
            end += 1
        owner, name = phrases(texts[begin:end])
        if len(owner):
            slot = owner * BINS + (name % _U(BINS)).astype(np.int64)
            low = np.full((end - begin) * BINS, 1 << 32, _U)
            np.minimum.at(low, slot, name >> _U(32))
            out[begin:end] = np.where(low < _U(1 << 32), low & _U(0xFFFF), _U(0xFFFFFFFF)).astype(np.uint32).view(np.int32).reshape(-1, BINS)
        begin = end
    return out


def as_text(sketch: np.ndarray) -> str:
    """Four hex digits for each bin; ``----`` for a bin that is empty."""
    if (sketch < 0).any():
        return "".join(EMPTY if v < 0 else f"{v:04x}" for v in sketch.tolist())
    return sketch.astype(">u2").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.array([-1 if fingerprint[i : i + 4] == EMPTY else int(fingerprint[i : i + 4], 16) for i in range(0, len(fingerprint), 4)], np.int32)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, 0 to 1. Two empty texts are alike, an empty one and another are not."""
    either = ((a >= 0) | (b >= 0)).sum(1)
    agree = ((a == b) & (a >= 0)).sum(1)
    return np.where(either > 0, agree / np.maximum(either, 1), 1.0)


def fingerprint_column(text):
    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([as_text(s) for s in sketches([t or "" for t in texts])], dtype=object)

    return of(text)


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as much of the beginning of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Bytes of text in a partition, about.
PARTITION_BYTES = 32 << 20


def _compared(ids: list, texts: list[str], nexts: list[str]) -> pd.DataFrame:
    """Rows of OUT for texts whose next is known; a next that is also the following text is parsed once."""
    changed = [edited(t, n) for t, n in zip(texts, nexts)]
    chained = [i + 1 < len(texts) and nexts[i] is texts[i + 1] for i in range(len(texts))]
    mine = sketches(texts + [n for n, c in zip(nexts, chained) if not c])
    extra = iter(range(len(texts), len(mine)))
    place = [i + 1 if c else next(extra) for i, c in enumerate(chained)]
    own, following, edit = mine[: len(texts)], mine[place], sketches(changed)
    return pd.DataFrame({
        "doc_id": pd.array(ids, dtype="Int64"), "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
        "fingerprint": [as_text(s) for s in own], "edited_fingerprint": [as_text(s) for s in edit],
        "near_edited": likeness(own, edit), "near_next": likeness(own, following),
    })


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per row of ``docs`` in the columns of ``OUT``.

    The next document is that of the next smaller id (after the last: the first). Equal
    ids follow in the order of their texts' hashes; null ids come last. A null text is
    empty; the next document of the only one is itself. Fingerprints of empty texts are
    all ``----``. Repeated rows give repeated rows; other columns aren't read.

    Texts are dealt once, by ranges of (id, hash of the text, partition that it was read in), so
    rows that repeat an id, or have none, go to as many tasks as it takes. Of each partition
    only the last row lacks its next; it is compared with the first text of the following one
    afterwards. The driver gets the numbers of the partitions that have rows, and no ids or texts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.spark_partition_id().alias("part")).withColumn("tie", F.xxhash64("text"))
    if partitions is None:
        size = docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(64))).first()[0] or 0
        partitions = max(spark.sparkContext.defaultParallelism, -(-size // PARTITION_BYTES))

    def of(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = TaskContext.get().partitionId()
        held: list[tuple] = []  # rows whose next is known: (id, text, next)
        chars, last = 0, None

        def end(kind: str, i, text: str) -> pd.DataFrame:
            return pd.DataFrame({c: pd.Series([{"doc_id": i, "place": place, "end": kind, "text": text}.get(c)], dtype=object) for c in columns})

        def between() -> pd.DataFrame:
            made = _compared(*map(list, zip(*held)))
            return made.assign(**{c: pd.Series([None] * len(made), dtype=object) for c in columns[-3:]})

        for frame in frames:
            for i, text in zip(frame["id"], frame["text"]):
                i = None if pd.isna(i) else int(i)
                if last is None:
                    yield end("head", i, text)
                else:
                    held.append((*last, text))
                    chars += len(last[1])
                    if chars >= BATCH_CHARS:
                        yield between()
                        held, chars = [], 0
                last = (i, text)
        if held:
            yield between()
        if last is not None:
            yield end("tail", *last)

    def pairs(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield _compared([None if pd.isna(i) else int(i) for i in frame["doc_id"]], frame["text"].tolist(), frame["next"].tolist())

    columns = [c.split()[0] for c in OUT.split(", ")] + ["place", "end", "text"]
    order = [F.col("id").desc_nulls_last(), F.col("tie"), F.col("part")]
    dealt = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).select("id", "text")
    found, _ = written(dealt.mapInPandas(of, f"{OUT}, place int, end string, text string"), "compared")
    heads = found.where("end = 'head'").select(F.col("place").alias("following"), F.col("text").alias("next"))
    tails = found.where("end = 'tail'").select("doc_id", "place", "text")
    filled = sorted(r["place"] for r in tails.select("place").collect())  # as many as partitions
    after = spark.createDataFrame(list(zip(filled, filled[1:] + filled[:1])), "place int, following int")
    return found.where("end IS NULL").select(*columns[:-3]).unionByName(tails.join(after, "place").join(heads, "following").select("doc_id", "text", "next").mapInPandas(pairs, OUT))

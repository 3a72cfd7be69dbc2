"""Ranked lexical search by block-max pruning.

The index has a row for each block of consecutive documents: the block's terms (as 64-bit
hashes, in order), each term's document count and its largest gain in the block, and the
forward part, which is each document's terms with their gains. A gain is what an occurrence
of the term adds to a score for each unit of its weight; it depends on the document and the collection
alone, so all maxima are exact.

A query's bound on a block is the sum of its weights times the maxima. Each task takes its
blocks in descending order of that bound and scores them from the forward part, until the
bound drops below the threshold: the score of the last of the best k so far. The
threshold starts at what a first wave has found: there each task scores the best block
of each query only, and the largest k-th best score of all tasks is a lower bound of the final one. So the
second wave skips nearly all blocks, and hands on only rows that may be in the result.
All numbers are integers, and a block goes only if its bound is smaller than the threshold: results
are exact, ties included.

Queries that have equal texts are searched once. They are taken in groups of bounded size, which are what is
sent to all tasks; each group is a search of its own over the whole index.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch

#: Documents and postings at which a block is closed.
BLOCK_DOCS, BLOCK_POSTINGS = 64, 1 << 18
#: Blocks that a task sorts at a time.
CHUNK = 256
#: Queries of a group, and the bytes of their texts.
GROUP_QUERIES, GROUP_BYTES = 2048, 4 << 20
#: Numbers of the score: a gain is ONE * tf div (1000 * tf + 12 * m), m = BASE + SLOPE * n * N div L.
ONE, SLOPE, BASE = 1_000_000_000, 25, 75

_TERMS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of letters and digits and of everything beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()


class Hashes(dict):
    """64-bit hashes of terms as a worker meets them; emptied when it has many."""

    def __missing__(self, term: bytes) -> int:
        if len(self) > 1 << 20:
            self.clear()
        h = self[term] = xxhash.xxh64_intdigest(term) - (1 << 63)
        return h


FORWARD = "docs binary, nameless binary, lens binary, starts binary, terms binary, codes binary, tfs binary, n_docs bigint, n_terms bigint"
INDEX = "docs binary, nameless binary, starts binary, terms binary, counts binary, maxima binary, codes binary, gains binary"


def _forward(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of documents that have terms: each document's terms and how often it has them."""
    hashes = Hashes()
    docs: list[int] = []
    nameless: list[bool] = []
    lens: list[int] = []
    sizes: list[int] = []
    keys: list[int] = []
    tfs: list[int] = []

    def block() -> pd.DataFrame:
        own, codes = np.unique(np.array(keys, np.int64), return_inverse=True)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        row = (np.array(docs, np.int64).tobytes(), np.array(nameless, bool).tobytes(), np.array(lens, np.int64).tobytes(), starts.astype(np.int32).tobytes(), own.tobytes(), codes.astype(np.int32).tobytes(), np.array(tfs, np.int32).tobytes(), len(docs), sum(lens))
        for x in (docs, nameless, lens, sizes, keys, tfs):
            x.clear()
        return pd.DataFrame([row], columns=["docs", "nameless", "lens", "starts", "terms", "codes", "tfs", "n_docs", "n_terms"])

    for frame in frames:
        for doc, none, text in zip(frame["id"], frame["none"], frame["text"]):
            found = terms(text)
            if not found:
                continue
            counted = Counter(found)
            docs.append(doc)
            nameless.append(none)
            lens.append(len(found))
            sizes.append(len(counted))
            keys += map(hashes.__getitem__, counted)
            tfs += counted.values()
            if len(docs) == BLOCK_DOCS or len(keys) >= BLOCK_POSTINGS:
                yield block()
    if docs:
        yield block()


def _with_gains(n_docs: int, n_terms: int):
    """From forward blocks to blocks of the index, given the whole collection's counts."""

    def blocks(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                starts, own = np.frombuffer(r.starts, np.int32), np.frombuffer(r.terms, np.int64)
                codes, tfs = np.frombuffer(r.codes, np.int32), np.frombuffer(r.tfs, np.int32).astype(np.int64)
                m = np.array([BASE + SLOPE * n * n_docs // n_terms for n in np.frombuffer(r.lens, np.int64).tolist()], np.int64)
                gains = ONE * tfs // (1000 * tfs + 12 * np.repeat(m, np.diff(starts)))
                order = np.argsort(codes, kind="stable")
                counts = np.bincount(codes, minlength=len(own))
                maxima = np.maximum.reduceat(gains[order], np.cumsum(counts) - counts)
                rows.append((r.docs, r.nameless, r.starts, r.terms, counts.astype(np.int32).tobytes(), maxima.astype(np.int32).tobytes(), r.codes, gains.astype(np.int32).tobytes()))
            yield pd.DataFrame(rows, columns=["docs", "nameless", "starts", "terms", "counts", "maxima", "codes", "gains"])

    return blocks


@dataclass
class Index:
    """The blocks, as a written table, and how many documents and terms the collection has."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all rows of ``docs`` that have a term. The texts are read once and not shuffled."""
    forward = scratch.written(docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.col(id_col).isNull().alias("none"), F.col(text_col).alias("text")).mapInPandas(_forward, FORWARD), "forward")
    n_docs, n_terms = forward.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    blocks = scratch.written(forward.drop("n_docs", "n_terms").mapInPandas(_with_gains(n_docs, n_terms), INDEX), "index")
    return Index(blocks, n_docs, n_terms)


class Queries:
    """A group of queries against one vocabulary: by query the places of its terms, and their weights times how often it has them."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        hashes = Hashes()
        counted = [Counter(map(hashes.__getitem__, terms(t))) for t in texts]
        self.vocabulary = np.array(sorted({h for c in counted for h in c}), np.int64)
        place = {h: i for i, h in enumerate(self.vocabulary.tolist())}
        self.places = [np.array([place[h] for h in c], np.int64) for c in counted]
        self.times = [np.array(list(c.values()), np.int64) for c in counted]
        self.weights: list[np.ndarray] = []

    def weigh(self, n_docs: int, found_in: dict[int, int]) -> None:
        w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * found_in.get(h, 0) + 1))) for h in self.vocabulary.tolist()], np.int64)
        self.weights = [w[p] * t for p, t in zip(self.places, self.times)]

    def held(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of a block's terms (in order) are in the vocabulary, and their places there."""
        at = np.searchsorted(self.vocabulary, own)
        at[at == len(self.vocabulary)] = 0
        mine = np.flatnonzero(self.vocabulary[at] == own) if len(self.vocabulary) else np.empty(0, np.int64)
        return mine, at[mine]


class Block:
    """What a group of queries can use of a block: maxima, and postings of the vocabulary's terms."""

    def __init__(self, row, queries: Queries):
        mine, place = queries.held(np.frombuffer(row.terms, np.int64))
        self.place, self.maxima = place, np.frombuffer(row.maxima, np.int32)[mine].astype(np.int64)
        of = np.full(len(row.terms) // 8, -1, np.int64)
        of[mine] = place
        codes = of[np.frombuffer(row.codes, np.int32)]
        kept = np.flatnonzero(codes >= 0)
        starts = np.searchsorted(kept, np.frombuffer(row.starts, np.int32))
        some = np.flatnonzero(np.diff(starts))  # documents with a term of the vocabulary
        ids, nameless = np.frombuffer(row.docs, np.int64)[some].tolist(), np.frombuffer(row.nameless, bool)[some].tolist()
        self.docs = [None if none else doc for doc, none in zip(ids, nameless)]
        self.starts, self.codes = starts[some], codes[kept].astype(np.int32)
        self.gains = np.frombuffer(row.gains, np.int32)[kept]

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Of all its documents, given a weight for each place of the vocabulary."""
        return np.add.reduceat(weights[self.codes] * self.gains, self.starts) if len(self.docs) else np.empty(0, np.int64)


class Best:
    """The k best of a query: highest scores first, then smallest ids; a missing id comes last."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor, self.heap = k, max(1, floor), []

    @property
    def threshold(self) -> int:
        return max(self.floor, self.heap[0][0]) if len(self.heap) == self.k else self.floor

    def add(self, scores: np.ndarray, docs: list) -> None:
        for i in np.flatnonzero(scores >= self.threshold).tolist():
            entry = (int(scores[i]), -docs[i] if docs[i] is not None else -math.inf)
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)


def pruned(frames: Iterable[pd.DataFrame], queries: Queries, k: int, floors: list[int], blocks_each: int | None) -> list[Best]:
    """The best of a task's blocks for each query; of each CHUNK blocks at most ``blocks_each`` are scored, if given."""
    best = [Best(k, f) for f in floors]
    weights = np.zeros(len(queries.vocabulary), np.int64)
    most = np.zeros(len(queries.vocabulary), np.int64)
    lists = [i for i, p in enumerate(queries.places) if len(p)]
    places = np.concatenate([queries.places[i] for i in lists]) if lists else np.empty(0, np.int64)
    by_place = np.concatenate([queries.weights[i] for i in lists]) if lists else np.empty(0, np.int64)
    begin = np.cumsum([0] + [len(queries.places[i]) for i in lists])[:-1]

    def search(chunk: list[Block]) -> None:
        bounds = np.empty((len(chunk), len(lists)), np.int64)
        for b, block in enumerate(chunk):
            most[block.place] = block.maxima
            bounds[b] = np.add.reduceat(most[places] * by_place, begin)
            most[block.place] = 0
        for j, q in enumerate(lists):
            own, bound = best[q], bounds[:, j]
            possible = np.flatnonzero(bound >= own.threshold)
            if not len(possible):
                continue
            weights[queries.places[q]] = queries.weights[q]
            for b in possible[np.argsort(-bound[possible], kind="stable")][:blocks_each].tolist():
                if bound[b] < own.threshold:
                    break
                own.add(chunk[b].scores(weights), chunk[b].docs)
            weights[queries.places[q]] = 0

    chunk: list[Block] = []
    for frame in frames:
        for row in frame.itertuples():
            chunk.append(Block(row, queries))
            if len(chunk) == CHUNK:
                search(chunk)
                chunk = []
    if chunk and lists:
        search(chunk)
    return best


def _search(spark: SparkSession, index: Index, texts: list[str], k: int) -> DataFrame:
    """(query, doc_id, score) of rows among which are the ``k`` best of each query of a group."""
    queries = Queries(texts)
    vocabulary = spark.sparkContext.broadcast(queries)

    def count(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(len(vocabulary.value.vocabulary), np.int64)
        for frame in frames:
            for own, counts in zip(frame["terms"], frame["counts"]):
                mine, place = vocabulary.value.held(np.frombuffer(own, np.int64))
                n[place] += np.frombuffer(counts, np.int32)[mine]
        some = np.flatnonzero(n)
        yield pd.DataFrame({"term": vocabulary.value.vocabulary[some], "n": n[some]})

    found_in = index.blocks.select("terms", "counts").mapInPandas(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    queries.weigh(index.n_docs, {r["term"]: r["n"] for r in found_in.collect()})  # one row for a term of the group at most
    sent = spark.sparkContext.broadcast(queries)
    searched = index.blocks.select("docs", "nameless", "starts", "terms", "maxima", "codes", "gains")

    def first_wave(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = pruned(frames, sent.value, k, [1] * len(texts), 1)
        full = [(q, b.threshold) for q, b in enumerate(best) if len(b.heap) == k]
        yield pd.DataFrame(full, columns=["q", "floor"]).astype("int64")

    seeds = searched.mapInPandas(first_wave, "q bigint, floor bigint").groupBy("q").agg(F.max("floor").alias("floor"))
    known = {r["q"]: r["floor"] for r in seeds.collect()}  # one row for a query of the group at most
    floors = [known.get(q, 1) for q in range(len(texts))]

    def second_wave(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = pruned(frames, sent.value, k, floors, None)
        rows = [(texts[q], -doc if doc != -math.inf else None, score) for q, b in enumerate(best) for score, doc in b.heap]
        yield pd.DataFrame({"query": pd.Series([r[0] for r in rows], dtype=object), "doc_id": pd.array([r[1] for r in rows], "Int64"), "score": pd.array([r[2] for r in rows], "Int64")})

    return searched.mapInPandas(second_wave, "query string, doc_id bigint, score bigint")


def search(docs: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item, rank, doc_id, score): the ``k`` best documents of each query with a score above 0.

    Whole texts are searched. Null and empty texts have no terms: such documents are in no
    result and don't count for the collection, such queries have no rows. Equal scores go by ascending id,
    missing ids last. Every row is a document of its own, also if its id or text
    repeats; a repeated query row gets its result once for each row. Empty tables give no rows. Columns besides the named ones are not read.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    index = build_index(docs, scratch, id_col, text_col)
    items = queries.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("query"))
    texts = items.where("query IS NOT NULL").select("query").distinct()
    seen = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("query")), F.lit(0)).alias("bytes")).first()
    groups = max(1, -(-seen["n"] // GROUP_QUERIES), -(-seen["bytes"] // GROUP_BYTES))
    grouped = texts.withColumn("group", F.pmod(F.xxhash64("query"), F.lit(groups)))
    if groups > 1:
        grouped = scratch.written(grouped, "queries")
    found = spark.createDataFrame([], "query string, doc_id bigint, score bigint")
    for g in range(groups):
        group = [r["query"] for r in grouped.where(F.col("group") == g).select("query").collect()]  # about GROUP_QUERIES
        if not group:
            continue
        rows = _search(spark, index, group, k)
        found = found.unionByName(scratch.written(rows, "found") if groups > 1 else rows)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return scratch.result(items.join(ranked, "query").select(F.col("item_id").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(id_col), "score"), "ranked")

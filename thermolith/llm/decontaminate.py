"""Benchmark decontamination: a BM25 index of test items, queried by every passage.

Items of like length (powers of two) share an index; passages for it are windows of two
and a half times the longest item's length, each half overlapping the next, so that a
copy of an item lies whole in one of them. An item's weights are its BM25 weights,
scaled such that 1 is the least score of any passage that could hold the asked share of
its word shingles: the item's full score less its heaviest terms, as many as can be
missing then. So retrieving everything at 1 or above loses nothing that would pass the
verification.

Retrieval is block-max WAND with the fixed threshold 1. A term's postings are items in
order with weights, in blocks with their largest weight. Cursors of a passage's terms stand
in the order of their items; the pivot is the first at which the terms' bounds add up to the
threshold, and nothing before it can be a result. If the bounds of the blocks at the pivot
fall short too, all cursors skip past the nearest block end; else they move to the pivot,
which is scored. All passages of a batch take their steps at the same time, each with its own cursors
and pivot, as numpy arrays. Whether a passage has any pivot at all is asked first,
by running sums of bounds, as most have none. What scores 1 or above is verified by
its five-word shingles, of the question's part and of the answer's part.

The index is in parts of bounded size, built by the executors and written to the shared
folder. Number of items, document frequencies and mean length are those of all items, so a score doesn't
depend on how items are dealt into parts. Parts of SENT_BYTES together are sent to the executors; if there are more,
each such group is a pass over the texts of its own.
"""

from __future__ import annotations

import pickle
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, fresh, written

SHINGLE = 5
K1, B = 1.2, 0.75
#: Postings in a block.
BLOCK = 8
#: Bounds of one part of the index, and of all parts that are sent to the executors at once.
PART_ITEMS, PART_BYTES, SENT_BYTES = 4096, 8 << 20, 64 << 20
#: Texts, and bytes of texts, that are searched at a time; a longer one is searched alone.
BATCH_TEXTS, BATCH_BYTES = 500, 2 << 20
#: Where no answer is given: the last quarter of an item's words.
ANSWER_SHARE = 0.25
#: What a score may lack of the threshold by rounding.
SLACK = 1e-6

_SPACE = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words; every ASCII character but letters and digits parts them."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACE).split()


class Postings:
    """Inverted lists: by term its items in order with weights, in blocks of BLOCK with their last item and
    largest weight. All lists lie in one array of keys, ``term * span + item``, each closed by an
    item that is none, so one binary search moves any number of cursors."""

    def __init__(self, lists: list[list[tuple[int, float]]], items: int):
        self.span = items + 1
        kind = np.int32 if (len(lists) + 1) * self.span < 2**31 else np.int64
        sizes = np.array([len(x) for x in lists], np.int64)
        closed = sizes + 1
        self.start = np.concatenate(([0], np.cumsum(closed)[:-1])).astype(np.int32)
        self.items = np.full(int(closed.sum()), items, kind)
        self.weights = np.zeros(len(self.items))
        place = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(lists)), sizes)
        self.items[place] = [j for x in lists for j, _ in x]
        self.weights[place] = [w for x in lists for _, w in x]
        self.keys = (np.repeat(np.arange(len(lists)), closed) * self.span + self.items).astype(kind)
        nth = np.arange(len(self.items)) - np.repeat(self.start, closed)
        closing = self.items == items
        self.block = (np.cumsum((nth % BLOCK == 0) | closing) - 1).astype(np.int32)  # of each posting; what closes a list is one of its own
        first = np.flatnonzero(np.diff(self.block, prepend=-1))
        self.most = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        self.last = np.maximum.reduceat(self.items, first) if len(first) else np.zeros(0, kind)
        #: By term the largest weight; the last, for places without a term, has none.
        self.bound = np.array([max((w for _, w in x), default=0.0) for x in lists])

    def wand(self, terms: np.ndarray, threshold: float = 1 - SLACK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of all items that score ``threshold`` or more, by block-max WAND.

        ``terms``: passages x terms, each term once in a row, filled up with a term whose list is empty. Each
        passage has its own cursors and pivot; all that are not done take a step at the same time.
        """
        passage, pos, bound = np.arange(len(terms)), self.start[terms], self.bound[terms]
        base = (terms * self.span).astype(self.keys.dtype)  # of each term's keys
        out: list[tuple] = []
        while len(passage):
            item = self.items[pos]
            order = np.argsort(item, axis=1, kind="stable")
            order += np.arange(len(order))[:, None] * order.shape[1]
            item, pos, base, bound = (x.reshape(-1)[order] for x in (item, pos, base, bound))
            bound[item == self.span - 1] = 0.0
            reached = np.cumsum(bound, axis=1) >= threshold
            live = reached[:, -1]
            if not live.all():
                passage, item, pos, base, bound, reached = (x[live] for x in (passage, item, pos, base, bound, reached))
                if not len(passage):
                    break
            row = np.arange(len(passage))
            pivot = item[row, reached.argmax(1)][:, None]
            upto = item <= pivot  # the cursors up to the pivot, and those at its item
            behind = item < pivot
            there = pos.copy()  # where each would stand at the pivot or after it
            there[behind] = np.searchsorted(self.keys, (base + pivot)[behind])
            block = self.block[there]
            possible = np.where(upto, self.most[block], 0.0).sum(1) >= threshold
            aligned = item[:, 0] == pivot[:, 0]
            scored = np.flatnonzero(possible & aligned)
            if len(scored):
                score = np.where(upto[scored], self.weights[pos[scored]], 0.0).sum(1)
                good = score >= threshold
                out.append((passage[scored[good]], pivot[scored[good], 0], score[good]))
            # No item before the nearest block end, nor before the next cursor, can reach the threshold where the blocks don't.
            beyond = np.where(upto, self.last[block] + 1, item).min(1)
            target = np.where(possible, pivot[:, 0] + aligned, np.maximum(beyond, pivot[:, 0] + 1))
            target = np.minimum(target, self.span - 1).astype(self.keys.dtype)[:, None]
            stay = possible & ~aligned  # these move to the pivot, which was looked up
            pos[stay] = np.where(behind[stay], there[stay], pos[stay])
            move = (item < target) & ~stay[:, None]
            pos[move] = np.searchsorted(self.keys, (base + target)[move])
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        return tuple(np.concatenate(x) for x in zip(*out))


@dataclass
class LengthClass:
    """The index of the items of one length class."""

    window: int
    items: list[int]
    list_of: np.ndarray  # term: its list in the postings; terms without one have the last, which is empty
    postings: Postings


@dataclass
class Index:
    terms: dict[bytes, int]
    classes: list[LengthClass]
    item_ids: list[int]
    shingles: list[tuple[frozenset, frozenset]]  # of the question's part and of the answer's


def _shingles(ids: list[int]) -> list[tuple[int, ...]]:
    if len(ids) < SHINGLE:
        return [tuple(ids)] if ids else []
    return [tuple(ids[i : i + SHINGLE]) for i in range(len(ids) - SHINGLE + 1)]


def item_words(text: str, answer: str | None) -> tuple[list[bytes], int]:
    """An item's words, question and answer, and where the answer begins."""
    question = tokens(text)
    if answer is None:
        return question, len(question) - max(1, round(len(question) * ANSWER_SHARE))
    return question + tokens(answer), len(question)


@dataclass
class Collection:
    """What weights need to know of all items: their number, their mean length, and how many have each word."""

    items: int
    mean: float
    having: dict[bytes, int]

    @classmethod
    def of(cls, words: list[list[bytes]]) -> Collection:
        return cls(len(words), sum(map(len, words)) / max(1, len(words)), Counter(w for own in words for w in set(own)))


def build_index(items: list[tuple[int, str, str | None]], similarity: float = 0.8, whole: Collection | None = None) -> Index:
    """From (item id, text, answer or None); items without words are left out. ``whole``: the collection that these are part of."""
    split = []
    for item_id, text, answer in items:
        words, at = item_words(text, answer)
        if words:
            split.append((item_id, words, at))
    whole = whole or Collection.of([words for _, words, _ in split])
    terms: dict[bytes, int] = {}
    coded = [[terms.setdefault(w, len(terms)) for w in words] for _, words, _ in split]
    having = [whole.having[w] for w in terms]
    idf = np.array([np.log(1 + (whole.items - k + 0.5) / (k + 0.5)) for k in having]) if terms else np.zeros(0)
    mean = whole.mean
    shingles, by_class = [], {}
    for k, ((_, _, at), ids) in enumerate(zip(split, coded)):
        own = _shingles(ids)
        answer = {s for i, s in enumerate(own) if i + len(s) > at}
        shingles.append((frozenset(own) - answer, frozenset(answer)))
        by_class.setdefault(max(2, (len(ids) - 1).bit_length()), []).append(k)
    classes = []
    for size, members in sorted(by_class.items()):
        lists: dict[int, list[tuple[int, float]]] = {}
        for j, k in enumerate(members):
            ids = coded[k]
            weights = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(ids) / mean)) for t, f in Counter(ids).items()}
            may_lack = int((1 - similarity) * len(shingles[k][0] | shingles[k][1]) + 1e-9)
            least = sum(sorted(weights.values())[: max(1, len(weights) - may_lack)])
            for t, w in weights.items():
                lists.setdefault(t, []).append((j, float(w / least * (1 + 1e-5))))
        list_of = np.full(len(terms) + 1, len(lists), np.int64)
        list_of[list(lists)] = np.arange(len(lists))
        classes.append(LengthClass(2 * (-(-5 * (1 << size) // 4)), members, list_of, Postings([*lists.values(), []], len(members))))
    return Index(terms, classes, [s[0] for s in split], shingles)


class Searcher:
    def __init__(self, index: Index, similarity: float):
        self.index, self.similarity = index, similarity

    def search(self, texts) -> list[list[tuple[int, float, float, float, float]]]:
        """For each text its items: (item id, score, overlap, question's, answer's), best window first."""
        index = self.index
        none = len(index.terms)
        get = index.terms.get
        out: list[dict[int, tuple]] = [{} for _ in texts]
        parts = [np.array([get(w, none) for w in tokens(t)], np.int64) for t in texts]
        ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
        begin = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        for c in index.classes:
            half = c.window // 2
            lists = c.list_of[ids]
            added = np.concatenate(([0.0], np.cumsum(c.postings.bound[lists])))
            n = np.diff(begin)
            count = np.where(n > 0, np.maximum(1, -(-n // half) - 1), 0)
            doc = np.repeat(np.arange(len(parts)), count)
            first = begin[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * half
            last = np.minimum(first + c.window, begin[doc + 1])
            may = np.flatnonzero(added[last] - added[first] >= 1 - SLACK)
            step = max(1, (1 << 19) // c.window)
            for i in range(0, len(may), step):
                self._passages(c, ids, lists, doc, first, last, may[i : i + step], out)
        return [sorted(d.values(), key=lambda r: (-r[1], r[0] is None, r[0] or 0)) for d in out]

    def _passages(self, c, ids, lists, doc, first, last, chosen, out) -> None:
        """Queries the index with each of the chosen passages that has a pivot at all."""
        empty = len(c.postings.bound) - 1
        place = first[chosen][:, None] + np.arange(c.window)
        terms = np.where(place < last[chosen][:, None], lists[np.minimum(place, len(ids) - 1)], empty)
        terms.sort(axis=1)
        terms[:, 1:][terms[:, 1:] == terms[:, :-1]] = empty  # each term once
        keep = c.postings.bound[terms].sum(1) >= 1 - SLACK
        terms, chosen = np.sort(terms[keep], axis=1), chosen[keep]
        if not len(chosen):
            return
        terms = terms[:, : max(1, int((terms < empty).sum(1).max()))]
        for p, j, score in zip(*(x.tolist() for x in c.postings.wand(terms))):
            passage = chosen[p]
            self._verify(c.items[j], score, ids[first[passage] : last[passage]].tolist(), out[doc[passage]])

    def _verify(self, k: int, score: float, passage: list[int], found: dict[int, tuple]) -> None:
        question, answer = self.index.shingles[k]
        sizes = {len(s) for s in question | answer}
        held = {tuple(passage[i : i + n]) for n in sizes for i in range(len(passage) - n + 1)}
        q, a = len(question & held), len(answer & held)
        whole = (q + a) / max(1, len(question) + len(answer))
        if whole >= self.similarity - 1e-9 and (a or not answer) and (q or not question):
            row = (self.index.item_ids[k], score, whole, q / len(question) if question else 1.0, a / len(answer) if answer else 1.0)
            if k not in found or found[k][1:] < row[1:]:
                found[k] = row


HITS = "array<struct<item_id:bigint,score:double,overlap:double,question_overlap:double,answer_overlap:double>>"
_NAMES = ("item_id", "score", "overlap", "question_overlap", "answer_overlap")


def _parts_of(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Items with the number of their part."""
    part, n, size = TaskContext.get().partitionId() << 24, 0, 0
    for frame in frames:
        numbers = []
        for t, a in zip(frame["text"], frame["answer"]):
            if n >= PART_ITEMS or size >= PART_BYTES:
                part, n, size = part + 1, 0, 0
            n, size = n + 1, size + 4 * (len(t) + len(a if isinstance(a, str) else ""))
            numbers.append(part)
        yield frame.assign(part=numbers)


def _words_of(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many items of a part have each word; under the empty word, how many there are and, as ``length``, all their words."""
    for frame in frames:
        for part, rows in frame.groupby("part"):
            own = [w for w in (item_words(t, a if isinstance(a, str) else None)[0] for t, a in zip(rows["text"], rows["answer"])) if w]
            having = Counter(x for w in own for x in set(w))
            yield pd.DataFrame({"part": part, "word": [b"", *having], "n": [len(own), *having.values()], "length": [sum(map(len, own)), *[0] * len(having)]})


def _items_of(frame: pd.DataFrame) -> list[tuple]:
    return [(None if none else int(i), t, a if isinstance(a, str) else None) for i, none, t, a in zip(frame["id"], frame["none"], frame["text"], frame["answer"])]


def _packed(index: Index) -> pd.DataFrame:
    data = pickle.dumps(index)
    return pd.DataFrame({"part": [data], "bytes": [len(data)]})


def index_parts(items: DataFrame, id_col: str, text_col: str, answer_col: str | None, similarity: float) -> DataFrame:
    """The index as a written table (part binary, bytes long): parts of at most PART_ITEMS items
    and about PART_BYTES of text, each built by the task that has its items."""
    answer = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    key = F.col(id_col).cast("long")
    rows = items.select(F.coalesce(key, F.lit(0)).alias("id"), key.isNull().alias("none"), F.col(text_col).alias("text"), answer.alias("answer")).where("text IS NOT NULL")
    seen = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text") + F.coalesce(F.length("answer"), F.lit(0))), F.lit(0)).alias("chars")).first()
    parts = max(1, -(-seen["n"] // PART_ITEMS), -(-4 * seen["chars"] // PART_BYTES))
    ddl = "part binary, bytes long"
    if parts == 1:

        def build(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = [x for frame in frames for x in _items_of(frame)]
            if own:
                yield _packed(build_index(own, similarity))

        return written(rows.coalesce(1).sortWithinPartitions("id", "text").mapInPandas(build, ddl), "index")[0]
    scratch = Scratch(items.sparkSession)
    dealt = scratch.written(rows.repartitionByRange(parts, "id", "text").sortWithinPartitions("id", "text").mapInPandas(_parts_of, "id long, none boolean, text string, answer string, part long"), "items")
    words = scratch.written(dealt.groupBy("part").applyInPandas(lambda rows: pd.concat(_words_of([rows])), "part long, word binary, n long, length long"), "words")
    having = words.groupBy("word").agg(F.sum("n").alias("all"))
    of_part = words.where("word <> X''").join(having, "word").select("part", "word", "all")
    n, length = words.where("word = X''").agg(F.sum("n"), F.sum("length")).first()

    def build_part(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        whole = Collection(n, length / max(1, n), dict(zip(known["word"], known["all"])))
        own = own.sort_values(["id", "text"], kind="stable")
        return _packed(build_index(_items_of(own), similarity, whole))

    return scratch.result(dealt.groupBy("part").cogroup(of_part.groupBy("part")).applyInPandas(build_part, ddl), "index")


def _batches(texts: list) -> Iterator[tuple[int, int]]:
    """Places of texts that are searched together."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += 4 * len(t or "")
        if i > begin and (i - begin == BATCH_TEXTS or size > BATCH_BYTES):
            yield begin, i
            begin, size = i, 4 * len(t or "")
    if begin < len(texts):
        yield begin, len(texts)


def _found(searchers: Iterable[Searcher], texts: list) -> list[list[dict]]:
    """The hits of some texts in some parts of the index."""
    out: list[list[dict]] = [[] for _ in texts]
    for own in searchers:
        for begin, end in _batches(texts):
            for k, rows in enumerate(own.search(texts[begin:end]), begin):
                out[k] += [dict(zip(_NAMES, r)) for r in rows]
    return out


def _groups(parts: DataFrame) -> list[list[int]]:
    """Numbers of the parts, in groups of SENT_BYTES together (a larger one alone)."""
    out, size = [[]], 0
    for r in parts.select("nth", "bytes").orderBy("nth").collect():  # two numbers a part
        if out[-1] and size + r["bytes"] > SENT_BYTES:
            out.append([])
            size = 0
        out[-1].append(r["nth"])
        size += r["bytes"]
    return out


def hits_column(text: Column, parts: DataFrame, chosen: list[int], similarity: float) -> Column:
    """The hits in the chosen parts, SENT_BYTES or so, which every Python worker unpacks once."""
    spark = parts.sparkSession
    sent = spark.sparkContext.broadcast([bytes(r["part"]) for r in parts.where(F.col("nth").isin(chosen)).orderBy("nth").select("part").collect()])
    name = uuid.uuid4().hex

    @F.pandas_udf(HITS)
    def of(texts: pd.Series) -> pd.Series:
        if _OPEN.get("of") != name:
            _OPEN.clear()
            _OPEN.update(of=name, searchers=[Searcher(pickle.loads(p), similarity) for p in sent.value])
        return pd.Series(_found(_OPEN["searchers"], texts.tolist()), dtype=object)

    return of(text)


#: The searchers of the index that a Python worker last met, kept for the next batch.
_OPEN: dict = {}


def with_hits(docs: DataFrame, items: DataFrame, similarity: float = 0.8, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, out_col: str = "hits") -> DataFrame:
    """``docs`` with the test items that each text holds, as an array (see HITS).

    An item is held if a passage has at least ``similarity`` of its five-word shingles,
    some of the question's and some of the answer's among them. Null and empty texts
    hold none; items without words are held by none; an item shorter than five words is
    one shingle. Repeated items are separate items, an item without an id is named null.
    Texts are read to their end. Repeated documents give repeated rows, empty tables no
    rows or no hits. Other columns stay; one named ``out_col`` is replaced. Memory goes by the bytes of the texts that are searched together
    (BATCH_BYTES, or one longer text).
    """
    own, _ = written(index_parts(items, item_col, item_text_col, answer_col, similarity).withColumn("nth", F.monotonically_increasing_id()), "parts")
    first, *more = _groups(own)
    out = docs.withColumn(out_col, hits_column(F.col(text_col), own, first, similarity))
    for chosen in more:
        again = fresh(docs, "__more")
        out, _ = written(out, "hits")
        out = out.withColumn(again, hits_column(F.col(text_col), own, chosen, similarity)).withColumn(out_col, F.concat(out_col, again)).drop(again)
    return out


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, item_id, score, overlap, question_overlap, answer_overlap): a row for each
    document and item that it holds. Repeated documents give repeated rows."""
    found = with_hits(docs.select(id_col, F.col(options.get("text_col", "text"))), items, **options)
    # An inner explode would have Spark search each text twice, once to see whether its array is empty.
    return found.select(id_col, F.explode_outer("hits").alias("hit")).where("hit IS NOT NULL").select(id_col, "hit.*")


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their own columns."""
    hits = fresh(docs, "__hits")
    return with_hits(docs, items, out_col=hits, **options).where(F.size(hits) == 0).select(*docs.columns)

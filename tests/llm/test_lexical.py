"""Ranked lexical search against scoring every document."""

import math
import random
import re
from collections import Counter

import pytest

from thermolith.llm import lexical, queries
from thermolith.llm.shared import Scratch, table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, k):
    said = [(d, Counter(split(t))) for d, t in docs if split(t)]
    n_docs, n_terms = len(said), sum(sum(c.values()) for _, c in said)
    df = Counter(t for _, c in said for t in c)
    out = []
    for item, text in items:
        rows = []
        for doc, c in said:
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in split(text) if t in c)
            if score > 0:
                rows.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, r[3], -r[0]) for rank, r in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_query_scores_as_every_document_would(spark, folder):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, folder, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, folder, "benchmark").collect()]
    assert rows(queries.op11_block_max(spark, folder)) == by_hand(docs, items, 20)


@pytest.mark.parametrize("seed", [1, 2])
def test_many_small_blocks_copies_and_ties(spark, monkeypatch, seed):
    """A third of all rows are copies, so a tie stands at the last rank; blocks of three documents, several query groups."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 3)
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(400)] + [(1000 - i, "aa bb the same copy cc") for i in range(200)]
    docs += [(None, "aa bb cc"), (7, "aa aa"), (7, "aa aa"), (2**53 + 1, "aa aa aa aa"), (3, None)]
    rng.shuffle(docs)
    items = [(i, " ".join(word() for _ in range(rng.randint(0, 9)))) for i in range(30)] + [(40, "aa bb AA"), (40, "aa bb AA"), (None, "cc"), (41, None), (42, "?!"), (43, "nowhere")]
    monkeypatch.setattr(lexical, "GROUP_QUERIES", 10)
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), k=7)
    assert rows(got) == by_hand(docs, items, 7)


def test_blocks_go_unscored(monkeypatch):
    """The best documents stand in one block: the others are passed over."""
    import pandas as pd

    frame = pd.DataFrame({"id": range(1000), "none": [False] * 1000, "text": ["rare rare words"] * 10 + ["common words of no use"] * 990})
    forward = list(lexical._forward([frame]))
    blocks = list(lexical._with_gains(1000, 10 * 3 + 990 * 5)(forward))
    asked = lexical.Queries(["rare words"])
    asked.weigh(1000, {h: n for h, n in zip(asked.vocabulary.tolist(), (10, 1000) if lexical.Hashes()[b"rare"] < lexical.Hashes()[b"words"] else (1000, 10))})
    scored = []
    plain = lexical.Block.scores
    monkeypatch.setattr(lexical.Block, "scores", lambda self, w: scored.append(1) or plain(self, w))
    best = lexical.pruned(blocks, asked, 10, [1], None)
    assert len(blocks) == 16 and len(scored) == 1 and sorted(-d for _, d in best[0].heap) == list(range(10))


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (4, "日本 W5X5")], "item_id long, text string")
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert rows(lexical.search(odd_docs, items)) == by_hand(docs, [(r[0], r[1]) for r in items.collect()], 20)
    assert lexical.search(no_docs, items).count() == lexical.search(odd_docs, items.where("false")).count() == 0


def test_index_is_of_all_rows_with_terms(spark, odd_docs):
    index = lexical.build_index(odd_docs, Scratch(spark))
    docs = [split(r["text"]) for r in odd_docs.collect()]
    assert (index.n_docs, index.n_terms) == (sum(map(bool, docs)), sum(map(len, docs)))

"""Decontamination, URL rules, sharding."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermolith.llm import decontaminate as dc
from thermolith.llm import queries, sharding, urlfilter
from thermolith.llm.shared import table


def shingles(text):
    w = dc.tokens(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def held(text, items):
    s = dc.tokens(text)
    out = set()
    for i, t in items:
        want = shingles(t)
        n = {len(x) for x in want}
        own = {tuple(s[k : k + m]) for m in n for k in range(len(s) - m + 1)}
        if want and len(want & own) >= 0.8 * len(want) - 1e-9:
            out.add(i)
    return out


def test_matches_are_those_of_brute_force(spark, folder):
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    rows = [(r["item_id"], r["text"]) for r in items.collect()]
    want = {(r["doc_id"], i) for r in docs.collect() for i in held(r["text"], rows)}
    assert {(r["doc_id"], r["item_id"]) for r in dc.matches(docs, items).collect()} == want
    assert {r["doc_id"] for r in dc.clean(docs, items).collect()} == {r["doc_id"] for r in docs.collect()} - {d for d, _ in want}


def test_edited_and_cut_leaks(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(3, 70)))) for i in range(60)]
    docs = []
    for i, t in items * 3:
        w = t.split()
        kind = rng.randrange(3)
        if kind == 0:
            w = w[: max(1, int(len(w) * rng.uniform(0.7, 1)))]
        elif kind == 1:
            w[rng.randrange(len(w))] = word()
        docs.append((len(docs), " ".join([word() for _ in range(rng.randint(0, 300))] + w + [word() for _ in range(rng.randint(0, 300))])))
    want = {(d, i) for d, t in docs for i in held(t, items)}
    got = dc.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert got == want and len(want) > 60


@pytest.mark.parametrize("sent", [64 << 20, 1])
def test_one_part_and_many_give_the_same_rows_and_scores(spark, monkeypatch, sent):
    folder = "/root/testdata/sf0.01"
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    rows = lambda: sorted(((r["doc_id"], r["item_id"], *(round(r[c], 9) for c in ("score", "overlap", "question_overlap", "answer_overlap"))) for r in dc.matches(docs, items).collect()))
    whole = rows()
    monkeypatch.setattr(dc, "PART_ITEMS", 9)
    monkeypatch.setattr(dc, "SENT_BYTES", sent)
    assert dc.index_parts(items, "item_id", "text", None, 0.8).count() > 3
    assert rows() == whole and len(whole) > 20


def test_batches_go_by_bytes(monkeypatch):
    monkeypatch.setattr(dc, "BATCH_BYTES", 400)
    monkeypatch.setattr(dc, "BATCH_TEXTS", 4)
    assert list(dc._batches(["x" * 30] * 9)) == [(0, 3), (3, 6), (6, 9)]
    assert list(dc._batches([None] * 9)) == [(0, 4), (4, 8), (8, 9)]
    assert list(dc._batches(["x" * 1000, "y", "z" * 1000, "z" * 99])) == [(0, 1), (1, 2), (2, 3), (3, 4)] and list(dc._batches([])) == []


def test_query_rows_have_the_scores_of_the_collection(spark, folder):
    """op2's own rows: items by brute force, weights by their definition."""
    import math

    items = {r["item_id"]: dc.tokens(r["text"]) for r in table(spark, folder, "benchmark").collect()}
    n, mean = len(items), sum(map(len, items.values())) / len(items)
    df = {w: sum(w in own for own in map(set, items.values())) for x in items.values() for w in x}
    held_by = {}
    for r in table(spark, folder, "documents").collect():
        for i in held(r["text"], [(i, " ".join(w.decode() for w in ws)) for i, ws in items.items()]):
            held_by[r["doc_id"], i] = r["text"]
    got = queries.op2_bm25_wand(spark, folder).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == set(held_by)
    for r in got:
        words = items[r["item_id"]]
        weights = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * words.count(t) * (dc.K1 + 1) / (words.count(t) + dc.K1 * (1 - dc.B + dc.B * len(words) / mean)) for t in set(words)}
        may_lack = int(0.2 * len(shingles(" ".join(w.decode() for w in words))) + 1e-9)
        least = sum(sorted(weights.values())[: max(1, len(weights) - may_lack)])
        assert 1 - 1e-6 <= r["score"] <= sum(weights.values()) / least * (1 + 2e-5)
        if set(words) <= set(dc.tokens(held_by[r["doc_id"], r["item_id"]])) and r["overlap"] == 1.0:
            assert abs(r["score"] - sum(weights.values()) / least * (1 + 1e-5)) < 1e-9


@pytest.mark.parametrize("threshold", [0.3, 1.0, 2.5])
def test_wand_is_exhaustive_scoring(threshold):
    rng = random.Random(int(threshold * 10))
    for _ in range(20):
        lists = [[(j, rng.choice([0.02, 0.05, 0.1, 0.9]) * rng.random()) for j in sorted(rng.sample(range(300), rng.randint(1, 120)))] for _ in range(30)]
        own = dc.Postings([*lists, []], 300)
        queries = [rng.sample(range(30), rng.randint(0, 12)) for _ in range(25)]
        terms = np.array([q + [30] * (12 - len(q)) for q in queries])
        want = {}
        for p, q in enumerate(queries):
            for t in q:
                for j, w in lists[t]:
                    want[p, j] = want.get((p, j), 0) + w
        got = {(p, j): x for p, j, x in zip(*(v.tolist() for v in own.wand(terms, threshold)))}
        assert got.keys() == {k for k, x in want.items() if x >= threshold} and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_wand_passes_over_what_cannot_score(monkeypatch):
    """A rare term and one of all items: few postings are ever looked at, and blocks with small weights are skipped whole."""
    common = [(j, 0.5) for j in range(10_000)]
    own = dc.Postings([[(5000, 0.6)], common, []], 10_000)
    steps = []
    real = np.argsort
    monkeypatch.setattr(dc.np, "argsort", lambda *a, **k: steps.append(1) or real(*a, **k))
    assert [x.tolist() for x in own.wand(np.array([[0, 1]]), 1.0)] == [[0], [5000], [1.1]] and len(steps) < 6
    steps.clear()
    uneven = [(j, 0.6 if j == 7777 else 0.1) for j in range(10_000)]
    own = dc.Postings([uneven, [(j, 0.5 if j % 997 == 801 or j == 7777 else 0.01) for j in range(10_000)], []], 10_000)
    assert own.wand(np.array([[0, 1]]), 1.0)[1].tolist() == [7777] and len(steps) < 10_000 / dc.BLOCK + 20


def test_large_indexes_are_read_part_by_part(spark, folder, monkeypatch):
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    whole = sorted(map(tuple, dc.matches(docs, items).select("doc_id", "item_id", "overlap").collect()))
    monkeypatch.setattr(dc, "SENT_BYTES", 0)
    monkeypatch.setattr(dc, "PART_ITEMS", 7)
    assert sorted(map(tuple, dc.matches(docs, items).select("doc_id", "item_id", "overlap").collect())) == whole


def test_parts_and_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(dc, "PART_ITEMS", 2)
    items = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (4, "words again and again and again"), (5, "one two")], "item_id long, text string")
    out = dc.clean(odd_docs, items)
    assert out.columns == odd_docs.columns
    assert {r["doc_id"] for r in out.collect()} == {1, 2, 3, 4, 5, 9, None}
    assert dc.matches(odd_docs.where("doc_id = 6"), items).count() == 2
    nameless = items.unionByName(spark.createDataFrame([(None, "one two"), (None, "one two")], items.schema))
    assert sorted(str(r["item_id"]) for r in dc.matches(odd_docs.where("doc_id = 6"), nameless).collect()) == ["1", "5", "None", "None"]
    assert dc.matches(odd_docs.where("doc_id = 7"), items).count() == 4  # repeated rows
    assert dc.clean(no_docs, items).count() == 0 and dc.clean(odd_docs, items.where("false")).count() == odd_docs.count()
    own = spark.createDataFrame([(7, "what is asked here today friend", "the answer text")], "item_id long, q string, a string")
    doc = spark.createDataFrame([(1, "so what is asked here today friend the answer text ok"), (2, "what is asked here today friend and no more")], "doc_id long, text string")
    assert [r["doc_id"] for r in dc.matches(doc, own, item_text_col="q", answer_col="a").collect()] == [1]


RULES = [urlfilter.Rule("allow", "org/"), urlfilter.Rule("block", "example.org/es/"), urlfilter.Rule("block", "example.org/en/1"), urlfilter.Rule("allow", "com/fr/"), urlfilter.Rule("block", "com/de/")]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    best = None
    for r in RULES:
        h, p = r.parts
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(r.text) > len(best.text)):
            best = r
    return host, path, best.text if best else None, best.verdict if best else "allow"


def test_url_rules(spark, folder):
    odd = ["", None, "no scheme/org/", "http://", "http://ORG/", "http://org", "http://a.org/?x", "x://evilorg/", "http://www.Example.ORG/es/1", "http://e.com/x.org/", "http://u@example.com/de/#a", "http://ex\u0000ample.org/en/1", "http://.org/", "a://b://example.org/en/12", "http://example.org/" + "x" * 100_000, "http://日本.org/é"]
    rows = [(i, u) for i, u in enumerate(odd)] + [(1000 + r["page_id"], r["url"]) for r in table(spark, folder, "pages").collect()]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit(1))
    got = {r["page_id"]: tuple(r)[1:] for r in urlfilter.judge(pages, RULES).collect()}
    assert got == {i: judged(u) for i, u in rows}
    again = spark.createDataFrame([(1, "http://a.org/"), (1, "http://a.org/"), (None, "http://a.org/"), (None, None)], "page_id long, url string")
    assert sorted((str(r["page_id"]), str(r["rule"])) for r in urlfilter.judge(again, RULES).collect()) == [("1", "org/"), ("1", "org/"), ("None", "None"), ("None", "org/")]
    assert urlfilter.judge(pages.where("false"), RULES).count() == 0


def test_many_rules_over_many_words():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 4)))
    rules = [urlfilter.Rule("block", f"{word()}.{word()}/{word()}") for _ in range(60)]
    auto, ordered = urlfilter.compile_rules(rules)
    assert auto.words > 5
    urls = [(f"{word()}.{word()}.{word()}", f"/{word()}{word()}") for _ in range(500)]
    got = auto.match([f".{h}\0{p}".encode() for h, p in urls])
    for (h, p), k in zip(urls, got):
        want = next((i for i, r in enumerate(ordered) if (h == r.parts[0] or h.endswith("." + r.parts[0])) and p.startswith(r.parts[1])), -1)
        assert k == want


def test_ring_fills_every_shard():
    rng = random.Random(7)
    counts = {c: rng.randint(0, 40) for c in range(sharding.CELLS)}
    counts[17] = 90_000  # one cell holds a third
    placed = {n: sharding.place(counts, n, 64) for n in (40, 41)}
    total = sum(counts.values())
    for n, ranges in placed.items():
        size = [0] * n
        seen = {}
        for cell, lo, hi, shard in ranges:
            size[shard] += hi - lo
            assert seen.get(cell, 0) == lo
            seen[cell] = hi
        assert max(size) - min(size) <= 1 and sum(size) == total and seen == {c: k for c, k in counts.items() if k}


def test_one_shard_more_moves_little():
    """Of even keys an ideal ring moves 1/41; with bounds, and nodes that give way, some more."""
    rng = random.Random(5)
    for hot in (0, 60_000):
        counts = {c: rng.randint(10, 30) for c in range(sharding.CELLS)}
        counts[99] += hot
        at = {}
        for n in (40, 41):
            for cell, lo, hi, shard in sharding.place(counts, n, 64):
                at.setdefault(cell, {}).setdefault(n, []).append((lo, hi, shard))
        moved = 0
        for cell, k in counts.items():
            for lo, hi, shard in at[cell][40]:
                same = sum(max(0, min(hi, b) - max(lo, a)) for a, b, s in at[cell][41] if s == shard)
                moved += hi - lo - same
        assert 1 / 41 <= moved / sum(counts.values()) < (0.075 if not hot else 0.2)


def walked(keys, shards, vnodes):
    """Shards and slots of (cell, order) keys, one at a time: each shard takes what waits at its nodes in clockwise order, in rounds."""
    cells, owner = sharding.ring(shards, vnodes)
    keys = sorted(keys)
    room = [len(keys) // shards + (s < len(keys) % shards) for s in range(shards)]
    waiting = [(k, next((i for i, x in enumerate(cells) if x >= k[0]), 0)) for k in keys]
    got = {}
    while waiting:
        left = []
        for k, node in sorted(waiting, key=lambda w: (w[1], w[0])):
            if room[owner[node]]:
                room[owner[node]] -= 1
                got[k] = owner[node]
            else:
                left.append((k, node))
        waiting = []
        for k, node in left:
            node = (node + 1) % len(cells)
            while not room[owner[node]]:
                node = (node + 1) % len(cells)
            waiting.append((k, node))
    return got


def test_rows_of_the_query_by_brute_force(spark, folder):
    import struct
    import zlib

    import xxhash

    from thermolith.llm import queries

    signed = lambda x: x - 2**64 if x >= 2**63 else x
    keys, rows = {}, {}
    for r in table(spark, folder, "documents").select("doc_id", "text").collect():
        data = (r["text"] or "").encode()
        crc = zlib.crc32(data)
        cell = signed(xxhash.xxh64_intdigest(struct.pack("<q", r["doc_id"]), 42)) % sharding.CELLS
        keys[r["doc_id"]] = (cell, crc % sharding.SUBS, r["doc_id"], crc)
        rows[r["doc_id"]] = (len(data) + 16, crc)
    shard = walked(keys.values(), 40, 64)
    slots, want = {}, {}
    for k in sorted(keys.values()):
        slots[shard[k]] = slots.get(shard[k], -1) + 1
        want[k[2]] = (*rows[k[2]], "rows", shard[k], slots[shard[k]], None)
    got = {r["doc_id"]: tuple(r[c] for c in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")) for r in queries.op5_bounded_ring(spark, folder).collect()}
    assert got == want


@pytest.mark.parametrize("key", [None, 3])
def test_equal_rows_are_split(spark, monkeypatch, key):
    docs = spark.createDataFrame([(key, "the same text")] * 3000 + [(i, f"text {i}") for i in range(100)], "doc_id long, text string").repartition(8)
    pdf = sharding.shard_rows(docs, shards=7).toPandas()
    sizes = pdf.groupby("shard")["slot"].agg(["count", "min", "max"])
    assert len(pdf) == 3100 and sizes["count"].max() - sizes["count"].min() <= 1 and (sizes["max"] == sizes["count"] - 1).all() and not pdf.duplicated(["shard", "slot"]).any()


def test_ring_is_the_plain_walk():
    """Against one key at a time, in rounds: each shard takes what waits at its nodes in clockwise order."""
    rng = random.Random(9)
    counts = {rng.randrange(sharding.CELLS): rng.randint(1, 5) for _ in range(200)}
    cells, owner = sharding.ring(5, 8)
    room = [sum(counts.values()) // 5 + (s < sum(counts.values()) % 5) for s in range(5)]
    keys = [(c, k) for c in sorted(counts) for k in range(counts[c])]
    at = {k: next((i for i, x in enumerate(cells) if x >= k[0]), 0) for k in keys}
    got, waiting = {}, list(keys)
    while waiting:
        left = []
        for node in range(len(cells)):
            for k in [k for k in waiting if at[k] == node]:
                if room[owner[node]]:
                    room[owner[node]] -= 1
                    got[k] = owner[node]
                else:
                    left.append(k)
        for k in left:
            step = 1
            while not room[owner[(at[k] + step) % len(cells)]]:
                step += 1
            at[k] = (at[k] + step) % len(cells)
        waiting = sorted(left, key=lambda k: (k[0], k[1]))
    mine = {(c, r): s for c, lo, hi, s in sharding.place(counts, 5, 8) for r in range(lo, hi)}
    assert mine == got


def test_shards(spark, folder, odd_docs, no_docs):
    for docs in (table(spark, folder, "documents"), odd_docs):
        pdf = sharding.shard_rows(docs, shards=7).toPandas()
        assert len(pdf) == docs.count()
        sizes = pdf.groupby("shard")["slot"].agg(["count", "min", "max"])
        assert (sizes["max"] == sizes["count"] - 1).all() and (sizes["min"] == 0).all() and not pdf.duplicated(["shard", "slot"]).any()
        assert len(pdf) < 7 or sizes["count"].max() - sizes["count"].min() <= 1
    assert sharding.shard_rows(no_docs).count() == 0
    odd = sharding.shard_rows(odd_docs, shards=3).where("doc_id = 1").first()
    assert (odd["size"], odd["text_crc32"]) == (16, 0)


def test_too_many_nodes():
    with pytest.raises(ValueError):
        sharding.ring(1000, 1000)

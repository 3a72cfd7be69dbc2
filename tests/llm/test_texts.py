"""Quality, pieces, fingerprints by parsing, HTML, preference pairs, archives."""

import base64
import hashlib
import io
import os
import random
import re
import subprocess
import sys
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermolith.llm import html_layout, lcp, pieces, preference, quality, warc
from thermolith.llm.shared import table


# Quality -----------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    out = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) for i in out["doc_id"])
    assert (out["predicted"] == out["quality"]).mean() > 0.95
    assert out[out["quality"] == 1]["predicted"].mean() > 0.98


def test_labels_held_out_are_never_read(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.classify(docs, x).select("doc_id", "score").orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (6, 0), (9, None), (None, 1), (10, 1)], "doc_id long, quality int")
    for x in (labels, labels.where("false"), labels.where("doc_id = 10")):
        out = quality.classify(odd_docs, x).collect()
        assert len(out) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in out)
        kept = quality.keep_good(odd_docs, x)
        assert kept.columns == odd_docs.columns
        assert kept.where("score IS NULL").count() == 0
    assert quality.classify(no_docs, labels).count() == 0


def test_scores_of_the_query_by_brute_force(spark):
    """Every score again from the fitted dictionaries and weights, by plain calls of the compressor."""
    import math

    import zstandard

    from thermolith.llm import queries

    folder = "/root/testdata/sf0.001"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality.fit(quality.training_rows(docs.select("doc_id", "text"), labels, "doc_id", "text", "quality"))
    got = {r["doc_id"]: (r["held_out"], r["score"], r["predicted"]) for r in queries.op4_compression_quality(spark, folder).collect()}

    def packed(data, book):
        pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(book), write_content_size=False, write_checksum=False)
        return sum(len(pack.compress(data[i : i + 8192])) for i in range(0, max(1, len(data)), 8192))

    rows = docs.select("doc_id", "text").collect()
    assert len(rows) == len(got)
    for r in rows:
        data = (r["text"] or "").encode()
        good, bad, n = packed(data, model.good), packed(data, model.bad), len(data) + 1
        share = math.log((good + bad) / 2 / n)
        x = [(bad - good) / n, (bad - good) / (bad + good) * math.log(n), share, share * math.log(n)]
        z = model.weights[4] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights, x, model.mean, model.scale))
        score = 1 / (1 + math.exp(-max(-30, min(30, z))))
        held, mine, predicted = got[r["doc_id"]]
        assert held == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and abs(mine - score) < 1e-9 and predicted == (mine >= 0.5)


def test_a_late_bad_part_counts_like_an_early_one(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    rows = labels.select("quality", "text").collect()
    good, bad = (" ".join(r["text"] for r in rows if r["quality"] == k and 200 < len(r["text"]) < 4000) for k in (1, 0))
    model = quality.fit(quality.training_rows(docs, table(spark, folder, "labels"), "doc_id", "text", "quality"))
    mixed = spark.createDataFrame([(i, t) for i, t in enumerate([good[:8192] + bad[:24576], bad[:24576] + good[:8192]])], "doc_id long, text string")
    a, b = (r["score"] for r in quality.score(mixed, model).orderBy("doc_id").collect())
    assert abs(a - b) < 0.2


# Pieces ------------------------------------------------------------------------------------

ALPHABET = "abcdehinorstuáé 日本▁<>0123456789  \n\t(){}_-.,🤗"


def odd_texts(n=600):
    rng = random.Random(11)
    return ["", " ", "  a  b ", "\n", "▁", "aaaaaaaaaaaaaaaaaaaaaaaa", "Hello  world\n é <s> </s>", "\u0000퟿"] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 80))) for _ in range(n)]


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.read_model())


@pytest.fixture(scope="module")
def sentencepiece():
    return pytest.importorskip("sentencepiece")


def test_bpe_ids_are_the_library_s(spark, folder, encoder, sentencepiece):
    own = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    texts = odd_texts() + [r["text"] for r in table(spark, folder, "documents").collect()]
    for t, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == own.encode(t)
        assert encoder.model.decode(ids) == own.decode(ids.tolist())


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_rows_are_those_of_ids_one_text_at_a_time(spark, sentencepiece, size):
    """op6's own rows: number and hash of the library's ids, and whether they spell the text again."""
    from thermolith.llm import queries

    folder = f"/root/testdata/{size}"
    own = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    docs = [(r["doc_id"], r["text"] or "") for r in table(spark, folder, "documents").collect()]
    ids = {i: own.encode(t) for i, t in docs}
    hashed = spark.createDataFrame(list(ids.items()), "doc_id long, ids array<int>").select("doc_id", F.xxhash64("ids").alias("h"))
    want = {r["doc_id"]: r["h"] for r in hashed.collect()}
    for r in queries.op6_piece_viterbi(spark, folder).collect():
        assert (r["n_pieces"], r["ids_xxhash64"]) == (len(ids[r["doc_id"]]), want[r["doc_id"]])
        assert r["round_trip"]


RUNS = {
    "letters": lambda rng, n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)), "one letter": lambda rng, n: "a" * n, "period": lambda rng, n: "thethetion" * (n // 10),
    "base64": lambda rng, n: base64.b64encode(rng.randbytes(3 * n // 4)).decode(), "script": lambda rng, n: "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(n)),
}


@pytest.mark.parametrize("kind", sorted(RUNS))
def test_long_runs_without_a_break(encoder, sentencepiece, kind):
    text = RUNS[kind](random.Random(5), 100_000)
    begin = time.process_time()
    ids = encoder.encode([text])[0].tolist()
    assert time.process_time() - begin < 5
    assert ids == sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL).encode(text)
    assert not any(len(name) > pieces.LONGEST_KEPT for name in encoder.known.young)


def test_memory_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 20_000)
    own, rng = pieces.Encoder(pieces.read_model()), random.Random(4)
    for _ in range(40):
        texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(60))]
        assert own.encode(texts)[0].tolist() == own.encode(texts)[0].tolist()
        assert own.known.held < 20_000 + 200 * 300 and len(own.known.old) < 200


WORKER = """
import re
import pandas as pd
from pyspark.sql import functions as F
from thermolith.llm import pieces
from thermolith.session import session

def held(batches):
    for batch in batches:
        own = re.findall(r"Pss_(?:Anon|Shmem):\\s+([0-9]+)", open("/proc/self/smaps_rollup").read())
        yield pd.DataFrame({"mb": [sum(map(int, own)) / 1024]})

spark = session("local[1]", **{"spark.ui.showConsoleProgress": "false"})
words = F.transform(F.sequence(F.lit(1), F.lit(450)), lambda i: F.substring(F.sha1(F.concat_ws("/", (F.col("id") * 450 + i) % 300000).cast("binary")), 1, 7))
docs = spark.range(0, 6000, 1, 1).select("id", F.array_join(words, " ").alias("text"))
assert pieces.encode(docs).where(F.size("ids") >= 450).count() == 6000
print("MB", spark.range(0, 1, 1, 1).mapInPandas(held, "mb double").first()["mb"])
"""


def test_a_worker_gives_back_what_encoding_took():
    """The worker lives on beside other stages: of 20 MB of text encoded it keeps the model and some words."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    ran = subprocess.run([sys.executable, "-c", WORKER], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": root})
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert float(ran.stdout.split("MB")[-1]) < 200


def test_one_at_a_time_is_the_batch(encoder, monkeypatch):
    texts = odd_texts(200)
    want = [x.tolist() for x in encoder.encode(texts)]
    for few in (0, 10**9):
        monkeypatch.setattr(pieces, "FEW", few)
        assert [x.tolist() for x in pieces.Encoder(pieces.read_model()).encode(texts)] == want


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + np.float32(value).tobytes()
    return varint(number << 3 | 2) + varint(len(value)) + value


def toy_unigram():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab▁c") for _ in range(rng.randint(2, 5))) for _ in range(60)} - {""})
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), *((c, -5.0 - i / 7, 1) for i, c in enumerate("abc▁")), *((w, -rng.uniform(2, 9), 1) for w in words if "▁" not in w[1:])]
    body = b"".join(field(1, field(1, p.encode()) + field(2, float(s)) + field(3, k)) for p, s, k in rows)
    return body + field(2, field(3, 1)) + field(3, field(3, 1) + field(4, 0) + field(5, 1))


@pytest.mark.parametrize("few", [0, 10**9])
def test_unigram_is_the_best_path(monkeypatch, few):
    monkeypatch.setattr(pieces, "FEW", few)
    data = toy_unigram()
    own = pieces.Encoder(data)
    m = own.model
    score = {p: s for p, s, k in zip(m.pieces, m.scores, m.kinds) if k == pieces.NORMAL}
    rng = random.Random(6)
    for _ in range(200):
        t = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 14)))
        spelt = m.normal(t)
        best = [0.0] + [-1e9] * len(spelt)
        for e in range(1, len(spelt) + 1):
            best[e] = max((best[s] + score[spelt[s:e]] for s in range(e) if spelt[s:e] in score), default=-1e9)
        ids = own.encode([t])[0]
        assert "".join(m.pieces[i] for i in ids) == spelt
        assert abs(sum(m.scores[i] for i in ids) - best[-1]) < 1e-9


def test_pieces_odd_rows(odd_docs, no_docs):
    out = pieces.decode(pieces.encode(odd_docs)).collect()
    assert len(out) == odd_docs.count()
    for r in out:
        assert r["decoded"] == (r["text"] or "").replace("▁", " ")
    assert [tuple(r[c] for c in ("doc_id", "ids", "decoded")) for r in pieces.encode_and_decode(odd_docs).collect()] == [tuple(r[c] for c in ("doc_id", "ids", "decoded")) for r in out]
    assert pieces.encode(no_docs).count() == 0


# Locally consistent parsing ----------------------------------------------------------------


MASK = 2**64 - 1


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def tossed(x, before):
    """Twice the place of the lowest differing bit, plus x's bit there."""
    place = next(i for i in range(64) if (x ^ before) >> i & 1)
    return 2 * place + (x >> place & 1)


def plain_level(symbols):
    """Names of the next level, one symbol at a time: runs, three rounds of coins, a phrase at each inner local maximum."""
    runs = []
    for x in symbols:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    label = [x for x, _ in runs]
    for _ in range(3):
        label = [tossed(x, label[i - 1] if i else x ^ 1) for i, x in enumerate(label)]
    starts = [0] + [i for i in range(2, len(runs) - 1) if label[i - 1] < label[i] > label[i + 1]]
    names = []
    for a, b in zip(starts, starts[1:] + [len(runs)]):
        total, power = 0, 1
        for x, times in runs[a:b]:
            power = power * 0x9E3779B97F4A7C15 & MASK
            term = x + (times << 32) & MASK
            term = (term ^ (term >> 29)) * 0xBF58476D1CE4E5B9 & MASK
            total = total + (term ^ (term >> 32)) * power & MASK
        names.append(mixed(total + (b - a) & MASK))
    return names


def plain_fingerprint(text):
    symbols, level, low = [ord(c) for c in text], 0, [None] * lcp.BINS
    while symbols:
        symbols, level = plain_level(symbols), level + 1
        for x in symbols if level >= lcp.FIRST_LEVEL or len(symbols) == 1 else ():
            name = mixed(x ^ level)
            k = name % lcp.BINS
            low[k] = name >> 32 if low[k] is None else min(low[k], name >> 32)
        if len(symbols) == 1:
            break
    return "".join("----" if x is None else f"{x & 0xFFFF:04x}" for x in low)


def alike(a, b):
    pairs = [(a[i : i + 4], b[i : i + 4]) for i in range(0, len(a), 4)]
    either = [p for p in pairs if p != ("----", "----")]
    return sum(x == y for x, y in either) / len(either) if either else 1.0


def compared_plainly(rows):
    """The rows of the contract for (id, text) in the order of descending ids."""
    out = {}
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 3
        want = t[: len(t) - k] + n[:k]
        mine, edit, after = map(plain_fingerprint, (t, want, n))
        out[i] = (len(t), hashlib.sha256(want.encode()).hexdigest(), mine, edit, alike(mine, edit), alike(mine, after))
    return out


def test_rows_of_the_lcp_query_by_brute_force(spark, folder):
    from thermolith.llm import queries

    docs = [(r["doc_id"], r["text"] or "") for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    want = compared_plainly(sorted(docs, reverse=True))
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op8_locally_consistent(spark, folder).collect()}
    assert got == want


def test_edit_and_order(spark, odd_docs, no_docs):
    docs = odd_docs.select("doc_id", "text").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = [(r["doc_id"], r["text"] or "") for r in docs.orderBy(F.col("doc_id").desc()).collect()]
    want = compared_plainly(rows)
    for partitions in (1, 3, 20):
        got = {r["doc_id"]: tuple(r)[1:] for r in lcp.compare_with_next(docs, partitions=partitions).collect()}
        assert got == want
    assert lcp.compare_with_next(odd_docs).count() == odd_docs.count()
    assert lcp.compare_with_next(no_docs).count() == 0
    one = lcp.compare_with_next(docs.where("doc_id = 4")).first()
    assert one["near_next"] == 1.0


@pytest.mark.parametrize("key", [None, 7])
def test_rows_without_an_id_and_repeated_ids_are_spread(spark, key):
    texts = [f"text number {i} of them all" for i in range(300)] + ["the same"] * 300
    docs = spark.createDataFrame([(key, t) for t in texts], "doc_id long, text string").repartition(8)
    out = lcp.compare_with_next(docs, partitions=8)
    assert out.count() == 600 and out.where("doc_id IS NULL").count() == (600 if key is None else 0)
    assert out.where("fingerprint IS NULL OR near_next IS NULL").count() == 0
    same = out.where(F.col("n_chars") == 8).select("near_next").collect()
    assert len(same) == 300 and sum(r[0] == 1.0 for r in same) >= 299  # copies follow one another


def test_phrases_do_not_depend_on_offset():
    rng = random.Random(8)
    body = "".join(rng.choice("abcdefghij klmnop") for _ in range(4000))
    sets = []
    for head in ("", "x", "some other beginning, of any length. "):
        owner, name = lcp.phrases([head + body])
        sets.append(set(name.tolist()))
    assert all(len(sets[0] & s) > 0.9 * len(sets[0]) for s in sets)


def test_batches_do_not_matter():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 400))) for _ in range(60)] + ["", "a", "aa", "aaaaaaaaa", "ab" * 50]
    whole = lcp.sketches(texts)
    assert (whole == np.concatenate([lcp.sketches([t]) for t in texts])).all()
    for t, s in zip(texts, whole):
        assert (lcp.from_text(lcp.as_text(s)) == s).all()


# HTML --------------------------------------------------------------------------------------

PAGES = {
    "<p>one<p>two  <b>bold</b>\n text<br>next": "one\n\ntwo bold text\nnext",
    "<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>": "* a\n* b\n\n  3. c\n  4. d",
    "<table><tr><th>Name<th>Qty<tr><td>apple<td>10<tr><td>fig<td>2</table>": "Name   Qty\napple  10\nfig    2",
    "<table><tr><td rowspan=2>r<td>1<tr><td>2<tr><td>s<td>3</table>": "r  1\n   2\ns  3",
    "<head><title>t</title><style>.x, #y {display: none}</style></head><div class='a x'>no</div><div id=y>no</div><p style='visibility:hidden'>no</p><p hidden>no</p>yes<script>var a='</p>'</script>": "yes",
    "a &lt; b &amp; c < d<!-- no -->": "a < b & c < d",
    "<pre>\n a\n   b</pre>": " a\n   b",
    "<div>a</div><div>b</div>": "a\nb",
    "<h1>h</h1>text": "h\n\ntext",
    "<dl><dt>t<dd>d</dl>": "t\n  d",
    "": "",
    "<p>": "",
    "<div style='visibility:hidden'>no<span style='visibility:visible'>yes</span>no</div>": "yes",
    "<style>div.x{display:none} nav > a{display:none} ul .y{visibility:hidden} p{margin:0}</style><div class=x>no</div><p class=x>yes</p><nav><a>no</a><b><a>one</a></b></nav><ul><li>a<li><b class=y>no</b>b</ul>": "yes\n\none\n\n* a\n* b",
    "<style>#k{display:none} #k.on{display:block} [hidden]{color:red}</style><p id=k class=on>yes</p><p id=k>no</p><p hidden>no</p><p hidden style='display:block'>also</p>": "yes\n\nalso",
    "<table><td>a<td>b<tfoot><tr><td>cc<td>d</table>": "a   b\ncc  d",
    "<style>tbody{display:none}</style><table><tr><td>no<thead><tr><td>head</table>": "head",
    "<table><tr><td>" + "w" * 90 + "<td>b<tr><td>y<td>c</table>": "w" * 90 + "  b\ny" + " " * 91 + "c",
    "<ul><li><ul><li>a</ul><li><li>b</ul>": "* * a\n*\n* b",
    "<blockquote>a<p>b</blockquote>c": "  a\n\n  b\n\nc",
    "<a title='x>y' href=\"'\">t</a> <a b='c>u": "t u",
    "<!-- a --!>b<!-->c<!----x-->d<!-- e": "bcd",
    "<table><tr><td>a<table><tr><td>1<td>2<tr><td>33<td>4</table><td>z</table>": "a      z\n\n1   2\n33  4",
}


@pytest.mark.parametrize("page", sorted(PAGES))
def test_layout(page):
    assert html_layout.render(page) == PAGES[page]


@pytest.mark.parametrize("deep", ["<div>", "<font>", "<b><span>"])
def test_depth_keeps_the_tree(deep):
    many = deep * 3000
    assert html_layout.render(many + "a<div style=display:none>no<div>no</div>no</div><noscript>no</noscript><svg>no</svg>b") == "ab"
    assert html_layout.render("<div hidden>" + many + "<div>no</div>no") == ""
    assert html_layout.render(many + "<table><tr><td>a<td>b<tr><td>cc<td>d</table><ul><li>e</ul>") == "a   b\ncc  d\n\n* e"


STYLES = {
    "@media print{nav,.ads{display:none}}": True, "@media (max-width: 600px){.ads{display:none}}": True, "@media screen{.ads{display:none}}": False,
    "@media screen and (min-width:900px){.ads{display:none}}": False, "@media print{p{color:red}} .ads{display:none}": False, ".ads{display:none}.ads{display:block}": True,
    ".ads{display:block}.ads{display:none}": False, ".ads{display:none!important}.ads{display:block}": False, "#a{display:block} .ads{display:none}": True,
    "@import 'x.css'; .ads{display:none}": False, "@keyframes k{from{x:y}} @supports (display:grid){.ads{visibility:hidden}}": False, ".ads{content:'}';display:none": False,
}


@pytest.mark.parametrize("style", sorted(STYLES))
def test_styles_of_the_screen(style):
    assert html_layout.render(f"<style>{style}</style><p id=a class=ads>text</p>") == ("text" if STYLES[style] else "")


HOSTILE = {
    "tags without an end": "<a" * 500_000, "quotes without an end": '<a "' * 250_001, "quoted ends": '<a ">"' * 160_001, "deep": "<b>" * 330_000 + "x", "deep lists": "<ul><li>" * 20_000 + "x",
    "paragraph over inline and blocks": "<p>" + "<b><div>" * 120_000, "wall": "<p><table><tr><td>" + "<b><div>" * 110_000, "comments": "<!--a-->" * 120_000, "script": "<script>" + "</script " * 110_000,
    "wide and tall": "<table><tr><td>" + "x" * 400_000 + "<tr>" + "<tr><td>a<td>b" * 40_000, "end tags": "<font>" * 100_000 + "</b>" * 100_000, "attributes": "<a " + "x=y " * 240_000 + ">",
    "rules": "<style>" + "".join(f".a .b{i}{{display:none}}" for i in range(10_000)) + "</style>" + "".join(f"<p class='a b{i}'>" for i in range(10_000)), "ancestors": "<style>div span{display:none}</style>" + "<span><b>" * 100_000,
    "large spans": "<table>" + "<tr><td rowspan=1000 colspan=1000>x" * 29_000, "spans side by side": "<table>" + ("<tr>" + "<td rowspan=999>x" * 60) * 900, "wide cells": "<table><tr>" + "<td colspan=1000>x" * 55_000,
    "lists with text": "<ul><li>x" * 110_000, "quotes with text": "<blockquote>x" * 75_000, "tables with text": "<table><tr><td>x" * 62_000, "tables in second cells": "<table><tr><td>a<td>" * 50_000,
    "tables in third cells": "<table><tr><td>a<td>b<td>x" * 38_000, "lists and tables": "<ul><li>x<table><tr><td>y<td>" * 33_000, "text behind tables": "<table><tr><td>" * 40_000 + "x</table>y" * 40_000,
    "many small tables": ("<table><tr><td>" + "w" * 350 + "<tr><td><td>y" * 23 + "</table>") * 1400, "tall cells": "<table><tr><td>" + "<br>q" * 100_000 + "<td>" + "z<br>" * 90_000,
}


@pytest.mark.parametrize("kind", sorted(HOSTILE))
def test_a_megabyte_takes_seconds(kind):
    begin = time.process_time()
    text = html_layout.render(HOSTILE[kind])
    assert time.process_time() - begin < 15 and len(text) < 20_000_000


def test_nested_text_is_whole_and_stops_moving_right():
    """Lists, quotes and tables of 300 levels, each with a word of its own."""
    for open_, least in (("<ul><li>", 300), ("<blockquote>", 0), ("<table><tr><td>", 0), ("<table><tr><td>k<td>", 300)):
        text = html_layout.render("".join(f"{open_}w{i} " for i in range(300)))
        assert re.findall(r"w\d+", text) == [f"w{i}" for i in range(300)] and len(re.findall(r"[*k]", text)) == least
        assert max(len(line) - len(line.lstrip()) for line in text.split("\n")) <= html_layout.DEEPEST


def spans_by_grid(rows):
    """Columns of cells (across, down), by a grid of taken places."""
    taken, out = {}, []
    for cells in rows:
        column, row, new = 0, [], {}
        for across, down in cells:
            while taken.get(column, 0) > 0:
                column += 1
            row.append(column)
            if down > 1:
                new |= {column + k: down for k in range(across)}
            column += across
        taken = {k: v - 1 for k, v in (taken | new).items() if v > 1}
        out.append(row)
    return out


def test_spans_as_intervals_are_those_of_a_grid():
    rng = random.Random(3)
    for _ in range(500):
        rows = [[(rng.choice([1, 1, 2, 3, 7]), rng.choice([1, 1, 2, 3, 5])) for _ in range(rng.randint(0, 6))] for _ in range(rng.randint(1, 9))]
        table = html_layout.Table()
        table.rows = [[(html_layout.Lines(), *c) for c in cells] for cells in rows]
        assert [[c for c, *_ in row] for row in table.placed()] == spans_by_grid(rows)


def test_nested_lists_keep_their_bullets():
    assert html_layout.render("<ul><li>" * 60 + "x") == "* " * 60 + "x"


def test_extract_odd_rows(spark):
    rows = [(1, None, "t"), (2, "", "t"), (3, "<p>x", "t"), (3, "<p>x", "t"), (None, "y<br>" * 50_000, "t")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string").withColumn("lines", F.lit(1))
    out = html_layout.extract(pages)
    assert out.columns == pages.columns
    assert sorted((r["page_id"] or 0, r["text"][:5]) for r in out.collect()) == [(0, "y\ny\ny"), (1, ""), (2, ""), (3, "x"), (3, "x")]
    assert html_layout.extract(pages.where("false")).count() == 0


def test_inline_style_and_media_of_a_sheet():
    assert html_layout.render("<style>.x{display:none}</style><p class=x style='display:block'>text") == "text"
    assert html_layout.render("<style media=print>.x{display:none}</style><p class=x>text") == "text"


def test_any_string_renders():
    rng = random.Random(1)
    bits = ["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<li>", "<ul>", "</ul>", "<b", "x y", "&amp;", "<!--", "-->", "<script>", "</script>", "\"", "'", ">", "<", "</", "<br/>", "<select><option>"]
    for _ in range(400):
        html_layout.render("".join(rng.choice(bits) for _ in range(rng.randint(1, 60))))
    for deep in ("<div>", "<table>", "<table><tr><td>", "<ul><li>", "<b>", "<blockquote>"):
        assert html_layout.render(deep * 3000 + "end").strip(" *\n").endswith("end")


def plain_text(page):
    """The words of a page of the tables by the standard library's parser: all text outside of script, style and head."""
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.out = [], []

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style", "title"):
                self.inside.append(tag)

        def handle_endtag(self, tag):
            if self.inside and tag == self.inside[-1]:
                self.inside.pop()

        def handle_data(self, data):
            if not self.inside:
                self.out.append(data)

    own = Words()
    own.feed(page)
    own.close()
    return "".join(own.out)


def test_every_letter_of_the_pages_is_there_in_order(spark):
    """What the standard library's parser finds outside of hidden elements, bullets and numbers aside."""
    letters = lambda t: [c for c in t if not c.isspace() and c not in "*"]
    rows = html_layout.extract(table(spark, "/root/testdata/sf0.01", "pages")).select("html", "text").collect()
    assert len(rows) == 250
    for r in rows:
        assert letters(r["text"]) == letters(plain_text(r["html"]))


# Preference pairs --------------------------------------------------------------------------


def test_preference_pairs(spark):
    kind = "pair_id long, turn long, role string, text string"
    chosen = spark.createDataFrame([(1, 0, "user", "q"), (1, 2, "assistant", "good"), (1, 3, "user", "more"), (1, 4, "assistant", "end"), (2, 0, "user", "q"), (3, 0, None, None), (None, 0, "user", "x"), (5, 0, "user", "same")], kind)
    rejected = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "bad"), (2, 0, "user", "other"), (3, 0, None, None), (4, 0, "assistant", "alone"), (5, 0, "user", "same")], kind)
    got = {r["pair_id"]: r for r in preference.format_pairs(chosen, rejected).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    r = got[1]
    assert r["prompt"] == "<|user|>\nq\n<|end|>\n" and r["chosen"].startswith("<|assistant|>\ngood") and r["rejected"] == "<|assistant|>\nbad\n<|end|>\n"
    assert (r["prompt_turns"], r["chosen_turns"], r["rejected_turns"]) == (1, 3, 1)
    whole = r["prompt"] + r["chosen"]
    assert [whole[a:b] for a, b in r["chosen_mask"]] == ["good\n<|end|>\n", "end\n<|end|>\n"]
    assert got[2]["prompt"] == "" and got[3]["chosen"] == "" and got[3]["prompt_turns"] == 1
    assert got[4]["prompt"] == got[4]["chosen"] == "" and got[4]["rejected_turns"] == 1
    assert got[5]["chosen"] == got[5]["rejected"] == ""
    assert preference.format_pairs(chosen.where("false"), rejected.where("false")).count() == 0


def plain_pair(own, bad):
    """Prompt, completions, numbers of turns and masks of two lists of (turn, role, text)."""
    import re

    esc = lambda t: re.sub(r"<(\\*)\|", lambda m: "<" + m[1] + "\\|", t or "")
    piece = lambda t: f"<|{esc(t[1])}|>\n{esc(t[2])}\n<|end|>\n"
    n = 0
    while n < min(len(own), len(bad)) and own[n][1:] == bad[n][1:]:
        n += 1
    prompt = "".join(map(piece, own[:n]))

    def mask(turns):
        at, out = len(prompt), []
        for t in turns[n:]:
            if t[1] == "assistant":
                out.append((at + len(f"<|{esc(t[1])}|>\n"), at + len(piece(t))))
            at += len(piece(t))
        return out

    return prompt, "".join(map(piece, own[n:])), "".join(map(piece, bad[n:])), n, len(own) - n, len(bad) - n, mask(own), mask(bad)


def test_rows_of_the_preference_query_by_brute_force(spark):
    from thermolith.llm import queries

    folder = "/root/testdata/sf0.01"
    spans = lambda text: [tuple(map(int, x.split("-"))) for x in text.split(",") if x]
    out = {r["conv_id"]: (*tuple(r)[1:7], *(spans(r[m]) for m in ("chosen_mask", "rejected_mask"))) for r in queries.op10_preference_pairs(spark, folder).collect()}
    by = {}
    for r in table(spark, folder, "conversations").collect():
        by.setdefault(r["conv_id"], set()).add((r["turn"], r["role"], r["text"]))
    want = {}
    for i, turns in by.items():
        own, other = sorted(turns), sorted(by.get(i ^ 1, ()))
        last = max((k for k, t in enumerate(own) if t[1] == "assistant"), default=None)
        reply = next((t[2] for t in reversed(other) if t[1] == "assistant"), None)
        want[i] = plain_pair(own, [(t[0], t[1], reply) if k == last else t for k, t in enumerate(own) if k != last or reply is not None])
    assert out == want


def test_preference_odd_rows(spark):
    kind = "pair_id long, turn long, role string, text string, side int, t string"
    rng = random.Random(3)
    rows = [(1, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 1, "assistant", "b"), (2, None, "user", None), (2, 0, None, "x<|end|>y<\\|"), (2, 1, "assistant", "<|user|>"), (3, 0, "assistant", "long " * 100_000), (None, 0, "user", "x")]
    rows += [(4, i, rng.choice(["user", "assistant"]), f"turn {i}") for i in range(1500)]
    other = [(i, t, r, x + "!" if i == 4 and t is not None and t > 700 else x) for i, t, r, x in rows]
    chosen, rejected = (spark.createDataFrame([(*x, 9, "z") for x in y], kind) for y in (rows, other))
    got = {r["pair_id"]: (*tuple(r)[1:7], *([tuple(x) for x in r[m]] for m in ("chosen_mask", "rejected_mask"))) for r in preference.format_pairs(chosen, rejected).collect()}
    order = lambda t: ((t[0] is not None, t[0] or 0), (t[1] is not None, t[1] or ""), (t[2] is not None, t[2] or ""))
    for i in (1, 2, 3, 4):
        a, b = (sorted({x[1:] for x in y if x[0] == i}, key=order) for y in (rows, other))
        assert got[i] == plain_pair(a, b)
    assert set(got) == {1, 2, 3, 4} and got[4][3] == 701 and got[1][:3] == (got[1][0], "", "")
    assert preference.format_pairs(*preference.partner_pairs(chosen, "pair_id")).count() == 4
    assert preference.format_pairs(*preference.partner_pairs(chosen.where("false"), "pair_id")).count() == 0


# Archives ----------------------------------------------------------------------------------


def archive(n=120, compress=None):
    rng = random.Random(3)
    out = []
    for i in range(n):
        body = bytes(rng.randrange(256) for _ in range(rng.choice([0, 50, 3000])))
        out.append(warc.response_record(f"urn:page:{i}", "http://a b/\n", body, hashlib.sha256(body).hexdigest(), None, i % 3 != 0 if compress is None else compress))
    return out


@pytest.mark.parametrize("chunk", [64, 1 << 20])
def test_whole_archive(monkeypatch, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    recs = archive()
    data = b"".join(recs)
    out = list(warc.salvage(warc.Source(io.BytesIO(data), len(data))))
    assert len(out) == len(recs) and all(isinstance(x, warc.Record) for x in out)


def test_damage_is_quarantined():
    recs = archive()
    at = np.concatenate(([0], np.cumsum([len(r) for r in recs])))
    data = bytearray(b"".join(recs))
    hit = (4, 31, 32, 77)  # compressed ones; a plain record's headers have no checksum
    for k in hit:
        data[at[k] + len(recs[k]) // 2] ^= 0x5A
    data = bytes(data[: at[100]]) + b"junk WARC/1.0\r\n \x1f\x8b\x08" + bytes(data[at[100] : at[119] + 20])
    out = list(warc.salvage(warc.Source(io.BytesIO(data), len(data))))
    got = {warc.page_of(x.headers["warc-record-id"]) for x in out if isinstance(x, warc.Record)}
    assert got == set(range(119)) - set(hit)
    gaps = [x for x in out if isinstance(x, warc.Gap)]
    assert sum(x.length for x in gaps) + sum(x.end - x.offset for x in out if isinstance(x, warc.Record)) == len(data)
    assert len(gaps) == 5


def test_round_trip_rows(spark):
    big = "<p>" + "é" * 200
    rows = [(5, "u", big), (3, "u\r\nX: y", big), (9, None, big), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (None, "u", "no id"), (3, "u", big), (7, "u", "z" * 500_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = min((j for j, _, x in rows if j is not None and (x or "").encode() == b), default=None)
        again = len(b) >= 100 and i != first
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.where("false")).count() == 0


FALSE_HEADS = {
    "huge lengths": b"WARC/1.0\r\nContent-Length: 999999999999\r\n\r\n", "lengths that fit": b"WARC/1.0\r\nContent-Length: 1000000\r\n\r\n", "headers without an end": b"WARC/1.0\r\nA: b\r\n",
    "heads in fields": b"A: WARC/1.0\r\n", "bare heads": b"WARC/1.1\r\n", "gzip heads": b"\x1f\x8b\x08\x00abcdefgh",
}


@pytest.mark.parametrize("kind", sorted(FALSE_HEADS))
def test_false_heads_take_linear_time_and_little_memory(kind):
    """16 MB of them (2 of the shortest ones), then a record: it is found, and all before is one gap."""
    head = FALSE_HEADS[kind]
    size = (16 if kind == "huge lengths" else 2) << 20
    body = b"payload " * 20
    whole = warc.response_record("urn:page:7", None, body, hashlib.sha256(body).hexdigest(), None, False)
    data = head * (size // len(head)) + b"\r\n" + whole
    begin = time.process_time()
    source = warc.Source(io.BytesIO(data), len(data))
    out = list(warc.salvage(source))
    assert time.process_time() - begin < 30 and len(source.held) < 8 << 20
    gaps, records = [x for x in out if isinstance(x, warc.Gap)], [x for x in out if isinstance(x, warc.Record)]
    assert len(gaps) == 1 and gaps[0].length == len(data) - len(whole) and [warc.page_of(r.headers["warc-record-id"]) for r in records] == [7]


def test_a_hot_payload_and_missing_ids(spark):
    rows = [(i, "u", "hot " * 50) for i in range(200)] + [(None, "u", "hot " * 50)] * 2 + [(500 + i, "u", "") for i in range(100)] + [(900, "u", "own " * 40), (901, None, None), (901, "u", "two " * 40), (901, "u", "two " * 40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((tuple(r) for r in warc.deduplicated(pages).select("id", "first", F.length("html")).collect()), key=str)
    want = sorted([(i, 0, 200) for i in range(200)] + [(None, 0, 200)] * 2 + [(500 + i, None, 0) for i in range(100)] + [(900, None, 160), (901, None, 0), (901, 901, 160), (901, 901, 160)], key=str)
    assert got == want


def test_reader_logs_gaps_and_payloads(spark, tmp_path):
    recs = archive(10, True)
    (tmp_path / "a.warc.gz").write_bytes(b"".join(recs[:4]) + b"lost" + b"".join(recs[4:]))
    rows = warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",), (None,)], "path string")).collect()
    assert sum(r["kind"] == "response" for r in rows) == 10
    gap = [r for r in rows if r["kind"] == "gap"]
    assert len(gap) == 1 and gap[0]["length"] == 4 and gap[0]["reason"]
    assert all(hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] for r in rows if r["kind"] == "response")


def test_reader_takes_other_digests_and_none(spark, tmp_path):
    body = b"<p>some page"
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    chunked = b"5\r\n<p>so\r\n7\r\nme page\r\n0\r\n\r\n"

    def record(i, digest, content=body, http=b"HTTP/1.1 200 OK\r\n\r\n"):
        named = f"WARC-Payload-Digest: {digest}\r\n" if digest else ""
        return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\n{named}Content-Length: {len(http + content)}\r\n\r\n".encode() + http + content + b"\r\n\r\n"

    good = [f"sha1:{sha1}", f"SHA-1:{hashlib.sha1(body).hexdigest()}", None, "blake9:abc", f"md5:{hashlib.md5(body).hexdigest()}", f"sha256:{hashlib.sha256(body).hexdigest().upper()}"]
    data = [record(i, d) for i, d in enumerate(good)] + [record(6, f"sha1:{sha1}", chunked, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"), record(7, f"sha1:{sha1}", body, b"")]
    bad = [record(8, f"sha1:{sha1}", b"<p>some pagE"), record(9, "sha256:" + "0" * 64), record(10, "sha1:")]
    (tmp_path / "b.warc").write_bytes(b"".join(data + bad))
    rows = warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/b.warc",)], "path string")).collect()
    kept = {int(r["record_id"][9:]): r for r in rows if r["kind"] == "response"}
    assert set(kept) == {0, 1, 2, 3, 4, 5, 6, 7, 10}
    assert all(hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] for r in kept.values())
    assert [r["reason"] for r in rows if r["kind"] == "gap"] == ["wrong payload digest"] * 2

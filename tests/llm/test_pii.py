"""Rules and contexts for personal data against plain versions."""

import hashlib
import random
import re
from collections import Counter

import pytest

from thermolith.llm import pii, queries
from thermolith.llm.shared import table

RULES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
}


def base(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in RULES.items() for m in re.finditer(p, text) if ok(m.group())]


def plain_candidates(text, taken):
    for m in re.finditer(r"[^ \t-\r]+(?:[ \t-\r][^ \t-\r]+)*", text):
        words = [(x.start() + m.start(), x.end() + m.start()) for x in re.finditer(r"[^ \t-\r]+", m.group())]
        row = []
        for a, b in [*words, (None, None)]:
            if a is not None and re.search("[0-9@]", text[a:b]):
                row.append((a, b))
                continue
            if row:
                a, b = row[0][0], row[-1][1]
                while a < b and not (text[a].isalnum() or text[a] == "+"):
                    a += 1
                while b > a and not text[b - 1].isalnum():
                    b -= 1
                if 0 < b - a <= 64 and ("@" in text[a:b] or len(re.findall("[0-9]", text[a:b])) >= 4) and not any(x < b and y > a for _, x, y in taken):
                    yield a, b
            row = []


def plain_norm(s):
    return re.sub("[\t-\r]", " ", re.sub("[0-9]", "0", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)))


def brute(texts):
    """All spans of each text, by the rounds of the method on plain lists."""
    texts = [t or "" for t in texts]
    all_mentions, corpus = [], [[w for w in plain_norm(t).split(" ") if w] for t in texts]
    for i, t in enumerate(texts):
        found = base(t)
        for kind, a, b in found + [(None, a, b) for a, b in plain_candidates(t, found)]:
            before, behind = plain_norm(t[:a]).rstrip(" "), plain_norm(t[b:]).lstrip(" ")
            words = before.split(" ")
            one = words[-1]
            rest = before[: len(before) - len(one)].rstrip(" ")
            two = rest.split(" ")[-1]
            short = lambda *w: all(len(x.encode()) <= 64 for x in w)
            patterns = [p for p in (("before", two, one), ("around", one, behind.split(" ")[0])) if one and short(*p[1:])]
            all_mentions.append((i, kind, a, b, t[a:b].lower(), patterns))
    places = Counter()
    for w in corpus:
        places.update(("before", *x) for x in zip(w, w[1:]))
        places.update(("around", *x) for x in zip(w, w[2:]))
    known = {}
    for _ in range(pii.ROUNDS):
        met, times, weight, seeds, unseen = {}, Counter(), Counter(), {}, set()
        for _, kind, _, _, name, patterns in all_mentions:
            for p in patterns:
                times[p] += 1
                if kind is None:
                    unseen.add(p)
                k, score = (kind, 1.0) if kind else known.get(name, (None, 0))
                if (name, kind) in met.setdefault(p, set()):
                    continue
                met[p].add((name, kind))
                if k:
                    weight[p, k] += score
                    seeds.setdefault((p, k), set()).add((name, kind))
        trusted = {}
        for p in unseen:
            w, n, _, k = max((round(weight[p, k], 12), len(seeds.get((p, k), ())), -i, k) for i, k in enumerate(RULES))
            confidence = round(w / (len(met[p]) + max(0, places[p] - times[p])), 9)
            if n >= pii.SEEDS and confidence >= pii.CONFIDENT:
                trusted[p] = (k, confidence)
        left = {}
        for name, ps in {(m[4], p) for m in all_mentions if m[1] is None for p in m[5]}:
            if ps in trusted:
                k, c = trusted[ps]
                left[name, k] = left.get((name, k), 1.0) * (1 - min(c, 1 - 1e-9))
        now = {}
        for (name, k), x in sorted(left.items()):
            if round(1 - x, 9) >= pii.ACCEPTED and (name not in now or now[name][1] < round(1 - x, 9)):
                now[name] = (k, round(1 - x, 9))
        if now == known:
            break
        known = now
    order = list(RULES)
    out = []
    for i, t in enumerate(texts):
        spans = base(t) + [(known[m[4]][0], m[2], m[3]) for m in all_mentions if m[0] == i and m[1] is None and m[4] in known]
        out.append(sorted(spans, key=lambda s: (order.index(s[0]), *s[1:])))
    return out, known


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def got(df):
    return sorted(((r["doc_id"], [tuple(s) for s in r["base"]], [tuple(s) for s in r["spans"]]) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_against_plain_rules_and_rounds(spark, size):
    folder = f"/root/testdata/{size}"
    docs = [(r["doc_id"], r["text"]) for r in table(spark, folder, "documents").collect()]
    spans, _ = brute([t for _, t in docs])
    want = sorted((d, *(sum(k == kind for k, *_ in base(t or "")) for kind in RULES), sha(base(t or "")), ",".join(f"{k}:{a}:{b}" for k, a, b in s)) for (d, t), s in zip(docs, spans))
    rows = queries.op12_bootstrapped_pii(spark, folder).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").collect()
    assert sorted(map(tuple, rows)) == want


def test_rules_are_the_regular_expressions():
    rng = random.Random(5)
    parts = ["@", ".", "a", "b-c", "1", "22", "255", "256", "00009", "+", "+1", " ", "-", "(", ")", "4111 1111 1111 1111", "4111111111111111", "é", "@x.y", "1.2.3.4", "\n", "_%", "9" * 20]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == base(text), text
        taken = base(text)
        assert [(a, b) for k, a, b, *_ in pii.mentions(text) if k < 0] == list(plain_candidates(text, taken)), text


def corpus():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    docs = [f"{word()} {word()} reach me at: user{i}@mail{i}.example.org thanks {word()}" for i in range(40)]
    docs += [f"Phone number: +49 30 {1000000 + 7 * i} or {word()}, call me on +49 40 {2000000 + i} today" for i in range(40)]
    docs += [f"{word()} phone number: 030 55512{i:02d} or {word()}" for i in range(3)] + ["Reach me at: hidden(at)mail1234 thanks", "é ü phone number: 030 5551201\nthe end"]
    docs += [f"in the year {1900 + i} of the lord and in the {word()}" for i in range(30)] + [f"in the 4.{i}.2.1 {word()}" for i in range(8)] + [f"in the {word()}" for _ in range(60)]
    docs += [f"now call me on 0171 12345{i}" for i in range(2)]
    docs += [docs[80]] * 20 + [None, "", "no digits here", "1234 " * 5000]
    return docs


def test_contexts_find_what_the_rules_do_not(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    want, known = brute(texts)
    assert got(pii.extract(df)) == sorted(((i, base(t or ""), s) for i, (t, s) in enumerate(zip(texts, want))), key=str)
    assert {"030 5551200", "030 5551201", "hidden(at)mail1234"} <= set(known) and not any(k.startswith("19") for k in known)


def test_patterns_in_groups_give_the_same(spark, monkeypatch):
    texts = corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(pii, "SENT_BYTES", 60)
    assert [s for _, _, s in sorted(got(pii.extract(df)))] == brute(texts)[0]


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    want, _ = brute([t for _, t in rows])
    assert got(pii.extract(odd_docs)) == sorted(((d, base(t or ""), s) for (d, t), s in zip(rows, want)), key=str)
    assert pii.extract(no_docs).count() == 0


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 150_000, "+1" + "(" * 300_000, "a" * 150_000 + "@" + "b" * 150_000, "1 " * 150_000, "x1" * 150_000])
def test_hostile_texts_take_linear_time(text):
    import time

    begun = time.process_time()
    pii.mentions(text)
    assert time.process_time() - begun < 6

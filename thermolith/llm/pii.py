"""Personal data by rules, and by the contexts in which it stands.

Rules find e-mail addresses, IP addresses, card numbers and phone numbers in whole texts. These are the seeds of a
bootstrapped extraction. A mention is a seed, or anything else that looks like an identifier (words
with digits or an at sign; see :func:`mentions`). Its two patterns are the two words before it, and the word before
and the word behind it. Mentions and patterns are the two sides of a graph, which Spark scores in rounds:

* A pattern's confidence for a kind of data is the sum of the scores of the different identifiers that it meets (a seed has 1, what nobody
  has found 0) over their number and that of all other places of the corpus where its words stand, whatever is there. So words that mostly stand
  beside other things are no pattern, however many seeds they have. It needs SEEDS different identifiers, and is trusted
  from CONFIDENT on. Copies of a document add no identifiers.
* A mention that no rule has found scores 1 less the product of what its trusted patterns leave open. From ACCEPTED on it counts
  as found in the next round, where it supports further patterns, until nothing changes or ROUNDS are over.

What is accepted is personal data wherever it is mentioned. Numbers of places are counted in a scan of the texts for
patterns that have enough seeds only, in groups of a bounded size; each is counted once. Words of over LONGEST bytes are in no pattern.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

KINDS = ("email", "ip", "card", "phone")
#: Different identifiers that a pattern must have met; confidence from which it is trusted; score from which a mention counts as found.
SEEDS, CONFIDENT, ACCEPTED = 3, 0.8, 0.9
ROUNDS = 4
#: Digits that an identifier without an at sign has at least, and characters that any has at most.
DIGITS, LONGEST = 4, 64
#: Bytes of the patterns that are counted in one scan.
SENT_BYTES = 8 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_SIGN = re.compile(r"[0-9@]")
_SPACE = re.compile(r"[ \t-\r]")
#: A-Z lower-cased, every digit 0, every white space a space.
_CONTEXT = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x30 if 0x30 <= c <= 0x39 else 0x20 if 9 <= c <= 13 else c for c in range(256))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """An address's local part is all that fits before its at sign, so the at signs are looked for and not the words."""
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Numbers with dots between, four at a time from the left."""
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        start = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield start, end
            start = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end) of all that the rules find, in order of kind and start."""
    if not _SIGN.search(text):
        return []
    return [(k, *span) for k, find in enumerate((emails, addresses, cards, phones)) for span in find(text)]


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Words that have a digit or an at sign, several in a row as one, without punctuation around them: those with DIGITS
    digits or an at sign, of LONGEST characters at most."""
    at = 0
    while m := _SIGN.search(text, at):
        start = m.start()
        while start > at and not _SPACE.match(text, start - 1):
            start -= 1
        end = m.end()
        while True:
            stop = _SPACE.search(text, end)
            end = stop.start() if stop else len(text)
            following = _SPACE.search(text, end + 1)
            if end + 1 < len(text) and (sign := _SIGN.search(text, end + 1, following.start() if following else len(text))):
                end = sign.end()
            else:
                break
        at = end
        while start < end and not (text[start].isalnum() or text[start] == "+"):
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        word = text[start:end]
        if start < end <= start + LONGEST and ("@" in word or sum("0" <= c <= "9" for c in word) >= DIGITS):
            yield start, end


def mentions(text: str) -> list[tuple[int, int, int, str, str | None, str | None]]:
    """(kind or -1, start, end, identifier, pattern of the two words before, pattern of the words around) of all seeds and
    of the candidates that don't touch any. A mention without a word before it has no pattern."""
    found = base_spans(text)
    if not _SIGN.search(text):
        return []
    taken = sorted((a, b) for _, a, b in found)
    rest, i = [], 0
    reach = 0  # end of the seeds that begin before the candidate's end
    for a, b in candidates(text):
        while i < len(taken) and taken[i][0] < b:
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= a:
            rest.append((-1, a, b))
    raw = text.encode("utf-8", "surrogatepass").translate(_CONTEXT)
    places = sorted({x for _, a, b in (*found, *rest) for x in (a, b)})
    offset = dict(zip(places, places))
    if len(raw) != len(text):
        at = last = 0
        for x in places:
            at += len(text[last:x].encode("utf-8", "surrogatepass"))
            last, offset[x] = x, at
    out = []
    for kind, a, b in (*found, *rest):
        one, start = _word_before(raw, offset[a])
        left = around = None
        if one:
            two, _ = _word_before(raw, start)
            begin = offset[b]
            while begin < len(raw) and raw[begin] == 32:
                begin += 1
            end = raw.find(b" ", begin, begin + LONGEST + 1)
            end = end if end >= 0 else min(len(raw), begin + LONGEST + 1)
            left = None if two is None else (b"%b %b _" % (two, one)).decode("utf-8", "replace")
            around = None if end - begin > LONGEST else (b"%b _ %b" % (one, raw[begin:end])).decode("utf-8", "replace")
        out.append((kind, a, b, text[a:b].lower(), left, around))
    return out


def _word_before(raw: bytes, at: int) -> tuple[bytes | None, int]:
    """The word that ends before ``at``, None if it has over LONGEST bytes, and where it begins."""
    while at > 0 and raw[at - 1] == 32:
        at -= 1
    start = max(0, raw.rfind(b" ", max(0, at - LONGEST - 1), at) + 1, at - LONGEST - 1)
    return (raw[start:at] if at - start <= LONGEST else None), start


_MENTION = "array<struct<kind:int,start:int,end:int,identifier:string,left:string,around:string>>"
_NAMES = ("kind", "start", "end", "identifier", "left", "around")


def _mentions(texts: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(_NAMES, m)) for m in mentions(t)] if t else [] for t in texts], dtype=object)


def _places(docs: DataFrame, patterns: DataFrame, scratch: Scratch) -> DataFrame:
    """(pattern, places): where the words of each pattern stand in the texts, whatever is between or behind them."""
    size = patterns.agg(F.coalesce(F.sum(F.octet_length("pattern") + 40), F.lit(0))).first()[0]
    groups = max(1, -(-size // SENT_BYTES))
    out = None
    for g in range(groups):
        chosen = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(groups)) == g) if groups > 1 else patterns
        before, around = {}, {}
        for r in chosen.select("pattern").collect():  # SENT_BYTES or so
            one, two = r["pattern"].encode().split(b" _")
            if two:
                around[one, two[1:]] = r["pattern"]
            else:
                before[tuple(one.split(b" "))] = r["pattern"]
        sent = docs.sparkSession.sparkContext.broadcast((before, around))

        def count(frames: Iterable[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            before, around = sent.value
            n: Counter = Counter()
            for frame in frames:
                for text in frame["text"]:
                    words = text.encode("utf-8", "surrogatepass").translate(_CONTEXT).split()
                    n.update(map(before.__getitem__, filter(before.__contains__, zip(words, words[1:]))))
                    n.update(map(around.__getitem__, filter(around.__contains__, zip(words, words[2:]))))
            yield pd.DataFrame({"pattern": pd.Series(list(n), dtype=object), "places": pd.Series(list(n.values()), dtype="int64")})

        rows = docs.where("text IS NOT NULL").mapInPandas(count, "pattern string, places bigint").groupBy("pattern").agg(F.sum("places").alias("places"))
        rows = scratch.written(chosen.select("pattern").join(rows, "pattern", "left").fillna(0, ["places"]), "places")
        out = rows if out is None else out.unionByName(rows)
    return out


def accepted(docs: DataFrame, found: DataFrame, scratch: Scratch) -> tuple[DataFrame | None, DataFrame | None]:
    """(identifier, kind, score) of what the patterns have discovered, and (pattern, kind, confidence) of the trusted ones, from the
    texts and their mentions; None if no pattern has enough seeds.

    An edge is a pattern with a different identifier, and how often they meet. Patterns are aggregated before they are shuffled.
    """
    each = found.select(F.explode("mentions").alias("m")).select("m.kind", "m.identifier", F.explode(F.array("m.left", "m.around")).alias("pattern")).where("pattern IS NOT NULL")
    edges = scratch.written(each.groupBy("pattern", "identifier", "kind").agg(F.count("*").alias("n")), "edges")
    by_kind = [F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(f"w{k}") for k in range(4)] + [F.count_if(F.col("kind") == k).alias(f"s{k}") for k in range(4)]
    seeds = edges.withColumn("score", F.lit(1.0)).groupBy("pattern").agg(F.count("*").alias("met"), F.sum("n").alias("times"), F.count_if(F.col("kind") < 0).alias("unseen"), *by_kind)
    seeds = scratch.written(seeds.where("unseen > 0 OR s0 + s1 + s2 + s3 >= 1"), "seeds")
    unseen = edges.where("kind < 0").drop("kind")
    counted = known = trusted = None
    last = None
    for _ in range(ROUNDS):
        stats = seeds
        if known is not None:
            more = unseen.join(known, "identifier").groupBy("pattern").agg(*by_kind)
            stats = seeds.unionByName(more, allowMissingColumns=True).groupBy("pattern").agg(*(F.sum(c).alias(c) for c in seeds.columns[1:]))
        best = F.array_max(F.array(*(F.struct(F.col(f"w{k}").alias("weight"), F.col(f"s{k}").alias("seeds"), F.lit(-k).alias("kind")) for k in range(4))))
        # Only patterns that meet something unseen can discover it.
        able = stats.where("unseen > 0").select("pattern", "met", "times", best.alias("best")).where((F.col("best.seeds") >= SEEDS) & (F.col("best.weight") >= CONFIDENT * F.col("met")))
        able = scratch.written(able, "able")
        new = able.select("pattern") if counted is None else able.select("pattern").join(counted, "pattern", "left_anti")
        new = scratch.written(new, "new-patterns")
        if not new.isEmpty():
            found_in = _places(docs, new, scratch)
            counted = found_in if counted is None else counted.unionByName(found_in)
        if counted is None:
            return None, None
        confidence = F.round(F.col("best.weight") / (F.col("met") + F.greatest(F.col("places") - F.col("times"), F.lit(0))), 9)
        trusted = able.join(counted, "pattern").select("pattern", (-F.col("best.kind")).alias("kind"), confidence.alias("confidence")).where(F.col("confidence") >= CONFIDENT)
        trusted = scratch.written(trusted, "trusted")
        score = F.round(1 - F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(1 - 1e-9))))), 9)
        scored = unseen.join(trusted, "pattern").groupBy("identifier", "kind").agg(score.alias("score")).where(F.col("score") >= ACCEPTED)
        known = scratch.written(scored.groupBy("identifier").agg(F.max(F.struct("score", (-F.col("kind")).alias("kind"))).alias("b")).select("identifier", (-F.col("b.kind")).alias("kind"), "b.score"), "known")
        state = tuple(known.agg(F.count("*"), F.sum(F.xxhash64("identifier", "kind", "score").cast("decimal(38,0)"))).first())
        if state == last or not state[0]:
            break
        last = state
    return known, trusted


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) for each row of ``docs``: arrays of (kind, start, end) in code points, end exclusive, by kind as in KINDS and
    then by start: what the rules find, and that with what the patterns discover.

    Whole texts are read; null texts are empty ones. Every row has its own result, also if its id repeats or is null. Empty tables give no rows.
    Documents without digits and at signs have no spans. Columns besides the two are not read. A seed in copies of a document is one identifier.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = scratch.written(texts.select("id", F.pandas_udf(_mentions, _MENTION)("text").alias("mentions")).withColumn("row", F.monotonically_increasing_id()), "mentions")
    known, _ = accepted(texts.select("text"), found, scratch)
    span = lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"))
    out = found.withColumn("base", F.array_sort(F.transform(F.filter("mentions", lambda m: m["kind"] >= 0), span)))
    if known is None or known.isEmpty():
        out = out.withColumn("spans", F.col("base"))
    else:
        more = found.select("row", F.explode(F.filter("mentions", lambda m: m["kind"] < 0)).alias("m")).select("row", F.col("m.identifier").alias("identifier"), "m.start", "m.end").join(known.drop("score"), "identifier")
        more = more.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
        out = out.join(more, "row", "left").withColumn("spans", F.array_sort(F.concat("base", F.coalesce("more", F.slice("base", 1, 0)))))
    kinds = F.array(*map(F.lit, KINDS))
    named = lambda c: F.transform(c, lambda s: F.struct(F.get(kinds, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return scratch.result(out.select(F.col("id").alias(id_col), named("base").alias("base"), named("spans").alias("spans")), "spans")

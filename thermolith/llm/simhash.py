"""SimHash near-duplicates by pivot distance tables.

A fingerprint is a point of the 64-bit Hamming cube. Its table row holds its
distances to many reference fingerprints (pivots), computed once. Two fingerprints that
differ in ``k`` bits have distances to any pivot that differ by ``k`` at most, so a pair
whose largest coordinate difference is over ``k`` is discarded by the table alone; what
survives is verified by the Hamming distance itself.

The pivots are zero and one mask of two neighbouring bits for each of 32 blocks, plus
pseudo-random ones. With d0 and dj the distances to zero and to mask j, ``(d0 + 2 -
dj) / 2`` is the number of bits that a fingerprint has set in block j; a changed bit
moves one such coordinate by one. Two changed bits leave at least three of five groups
of blocks alone, so each of the ten choices of three groups gives a bucket key and no
link is lost. Pairs of a bucket are discarded by the distances to the other pivots, seven
of which are packed in one long, so that all seven are held against each other at once.
A bucket of up to ``bucket_cap`` fingerprints is compared pair by pair.
Larger ones (many near copies) go an exact linear way: fingerprints at most two bits
apart share a fingerprint one bit or none from both, so each is joined to the smallest
one under each of its 65 neighbours.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, connected_components, hub_copies, joined_salted, joined_with_hubs, written

BLOCKS = 32
GROUPS, KEPT = 5, 3
#: Coordinates in a packed long, and longs: so many pseudo-random pivots.
PACKED, LONGS = 7, 3
#: Pseudo-random reference fingerprints for the coordinate test: multiples of the golden ratio's odd 64-bit constant, mixed.
RANDOM_PIVOTS = tuple(((x := (0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**64) ^ (x >> 29)) for i in range(PACKED * LONGS))


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def shingle_hashes(text: str | None, words_in: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle, repeats included, as uint64."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, "u8")
    if len(words) < words_in:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], "u8")
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    first = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], seed) for a, b in zip(first[: len(words) - words_in + 1].tolist(), ends[words_in - 1 :].tolist())], "u8")


def simhash(text: str | None, words_in: int = 3) -> int:
    """Bit b is 1 if set in over half of the shingles' hashes; 0 for a text without words."""
    h = shingle_hashes(text, words_in)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprint_column(text: Column, words_in: int = 3) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(simhash(t, words_in)) for t in texts], dtype="int64")

    return of(text)


def pivot_table(points: DataFrame) -> DataFrame:
    """Adds ``blocks`` (the coordinates from the block pivots, two bits each, packed)
    and ``far0`` and on (the distances to the random pivots, a byte each, PACKED of
    them in a long) to ``points`` (fp)."""
    to = lambda pivot: F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(pivot)).cast("long")))
    packed = F.lit(0).cast("long")
    for j in range(BLOCKS):
        ones = ((to(0) + F.lit(2) - to(0b11 << (2 * j))) / 2).cast("long")
        packed = packed.bitwiseOR(F.shiftleft(ones, 2 * j))
    out = points.withColumn("blocks", packed)
    for n in range(LONGS):
        far = F.lit(0).cast("long")
        for i, pivot in enumerate(RANDOM_PIVOTS[n * PACKED : (n + 1) * PACKED]):
            far = far.bitwiseOR(F.shiftleft(to(pivot).cast("long"), 8 * i))
        out = out.withColumn(f"far{n}", far)
    return out


def coordinates_near(a: str, b: str, max_bits: int) -> Column:
    """Whether no coordinate of the packed distances of rows ``a`` and ``b`` differs by more
    than ``max_bits``. A byte holds 0 to 64, so 128 + k plus the one less the other stays
    in its byte, and its upper bit tells whether the difference is -k or more."""
    each = sum(1 << (8 * i) for i in range(PACKED))
    near = F.lit(True)
    for n in range(LONGS):
        x, y, base, upper = F.col(f"{a}.far{n}"), F.col(f"{b}.far{n}"), F.lit((128 + max_bits) * each).cast("long"), F.lit(128 * each).cast("long")
        near = near & ((x + base - y).bitwiseAND(y + base - x).bitwiseAND(upper) == upper)
    return near


def _keys() -> list[int]:
    """A mask of the packed coordinates for each choice of groups of blocks."""
    bounds = [round(i * BLOCKS / GROUPS) for i in range(GROUPS + 1)]
    part = [sum(0b11 << (2 * j) for j in range(bounds[g], bounds[g + 1])) for g in range(GROUPS)]
    return [sum(part[g] for g in chosen) for chosen in combinations(range(GROUPS), KEPT)]


def bucket_members(points: DataFrame) -> DataFrame:
    """(choice, key, n, fp, far0 ...): the table's rows under each key that two or more share."""
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("choice"), F.col("blocks").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for i, m in enumerate(_keys())])
    table = pivot_table(points)
    keyed = table.select("fp", *[f"far{n}" for n in range(LONGS)], F.explode(keys).alias("k"))
    shared = table.select(F.explode(keys).alias("k")).groupBy("k").agg(F.count("*").alias("n")).where("n > 1").withColumn("members", F.col("n"))
    # A crowd's fingerprints have equal keys: such a key is a hub.
    held = joined_with_hubs(keyed, shared, "k", max(1, points.count() * len(_keys())))
    return held.select("k.choice", "k.key", F.col("members").alias("n"), "fp", *[f"far{n}" for n in range(LONGS)])


def bucket_pairs(members: DataFrame, max_bits: int) -> DataFrame:
    """(a, b, survives): the pairs of each bucket, and whether the table keeps them."""
    left, right = members.alias("l"), members.alias("r")
    same = (F.col("l.choice") == F.col("r.choice")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.fp") < F.col("r.fp"))
    return left.join(right, same).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"), coordinates_near("l", "r", max_bits).alias("survives"))


def links(points: DataFrame, max_bits: int = 2, bucket_cap: int = 64, tmp: Scratch | None = None) -> DataFrame:
    """Edges (a, b) between different fingerprints of ``points`` (fp, distinct) such
    that the connected components are those of all links of at most ``max_bits``.

    ``max_bits`` may be 0 to 2, which is what the keys are exact for. Buckets over
    ``bucket_cap`` lose nothing: see the module's text.
    """
    if not 0 <= max_bits <= GROUPS - KEPT:
        raise ValueError("max_bits must be 0, 1 or 2")
    members = (tmp or Scratch(points.sparkSession)).written(bucket_members(points), "buckets")
    survivors = bucket_pairs(members.where(F.col("n") <= bucket_cap), max_bits).where("survives")
    pairs = survivors.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b")

    # A fingerprint and its neighbours: for 2 bits they meet half way; for 1 or 0 the pair itself is tested.
    hot = members.where(F.col("n") > bucket_cap).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)).cast("long") for i in range(64)]) if max_bits else F.array(F.lit(0).cast("long"))
    around = hot.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("mid"))
    if max_bits == 1:
        star = around.join(hot.select(F.col("fp").alias("mid")), "mid", "left_semi").select(F.col("fp").alias("a"), F.col("mid").alias("b"))
    else:
        heads = around.groupBy("mid").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("mid", "b")
        star = around.join(heads, "mid").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(star.where("a <> b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2, bucket_cap: int = 64, words_in: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (bigint), ``component_id`` (the
    smallest id reachable over links) and ``n_component`` (documents of the component).

    Null and empty texts have fingerprint 0 and link like any other. Rows without an
    id keep their row, take part in links, and never name a component (its id is null
    if no row of it has one). Repeated rows give repeated rows. Other columns of
    ``docs`` aren't touched or returned. Copies share one fingerprint, which is one
    point of the table however many they are.
    """
    tmp = Scratch(docs.sparkSession)
    prints, _ = written(docs.select(F.col(id_col).alias("doc"), fingerprint_column(F.col(text_col), words_in).alias("fp")), "fingerprints")
    points = tmp.written(prints.groupBy("fp").agg(F.min("doc").alias("low"), F.count("*").alias("n_docs")), "points")
    parts = connected_components(links(points.select("fp"), max_bits, bucket_cap, tmp))
    named = points.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    whole = named.groupBy("component").agg(F.min("low").alias("component_id"), F.sum("n_docs").alias("n_component"))
    by_print = tmp.result(named.select("fp", "component", F.col("n_docs").alias("n")).join(whole, "component").select("fp", "component_id", "n_component", "n"), "groups")
    total = prints.count()
    return joined_with_hubs(prints, by_print, "fp", total).select(F.col("doc").alias(id_col), F.col("fp").alias("fingerprint"), "component_id", "n_component")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Odd multipliers: one permutation of 64-bit hashes for each place of each view's sample.
def _multipliers(n: int) -> np.ndarray:
    x, out = 0x2545F4914F6CDD1D, []
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(x | 1)
    return np.array(out, "u8")


def sampled_simhashes(text: str | None, views: int, sample: int, words_in: int) -> list[int]:
    """One fingerprint a view: the SimHash of ``sample`` shingles, those that come first
    in as many random orders. Texts of Jaccard similarity s draw equal samples, so equal
    fingerprints, with probability s to the power of ``sample``."""
    h = np.unique(shingle_hashes(text, words_in))
    if not len(h):
        return []
    by = _multipliers(views * sample)
    least = np.full(len(by), 2**64 - 1, "u8")
    for i in range(0, len(h), 1024):
        np.minimum(least, (h[i : i + 1024, None] * by).min(0), out=least)
    least = (least ^ (least >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    least ^= least >> np.uint64(29)
    bits = np.unpackbits(least.astype(">u8").view(np.uint8).reshape(views, sample, 8), axis=2).sum(1)
    prints = np.packbits(2 * bits > sample, axis=1).view(">u8").reshape(-1)
    return [_signed(int(p) ^ int(by[v])) for v, p in enumerate(prints)]


#: A block of a crowd holds about so much: the shingles of its texts, and ROW for each text.
BLOCK, ROW = 1 << 18, 256


def _linked(crowd: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Pairs (a, b) of components that texts of similarity ``similarity`` or more link, no
    more than a forest has. Rows (component, s, side): those of side bit 1 are compared
    with those of bit 2, by exact common counts of their sets ``s``."""
    sets, side = crowd["s"].tolist(), crowd["side"].to_numpy()
    left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    part, names = pd.factorize(crowd["component"])
    sizes = np.array([len(x) for x in sets])
    _, token, times = np.unique(np.concatenate([np.asarray(x, np.int64) for x in sets]), return_inverse=True, return_counts=True)
    at = np.repeat(np.arange(len(sets)), sizes)
    again = times[token] > 1  # a shingle of one text is common to none
    at, token = at[again], (np.cumsum(times > 1) - 1)[token[again]]
    order = np.argsort(token, kind="stable")
    at, token = at[order], token[order]
    common = np.zeros((len(left), len(right)), np.float32)
    width = max(64, (4 << 20) // len(sets))
    for low in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        a, b = np.searchsorted(token, (low, low + width))
        has = np.zeros((len(sets), width), np.float32)
        has[at[a:b], token[a:b] - low] = 1
        common += has[left] @ has[right].T
    either = sizes[left][:, None] + sizes[right][None, :] - common.astype(np.float64)
    near = (common >= similarity * either - 1e-9) & (part[left][:, None] != part[right][None, :])
    x, y = np.nonzero(near)
    found = np.unique(np.sort(np.stack([part[left[x]], part[right[y]]], axis=1), axis=1), axis=0)
    up, out = list(range(len(names))), []
    for i, j in found.tolist():
        while up[i] != i:
            up[i] = i = up[up[i]]
        while up[j] != j:
            up[j] = j = up[up[j]]
        if i != j:
            up[j] = i
            out.append((names[i], names[j]))
    return pd.DataFrame(out, columns=["a", "b"])


def _links_in_crowds(placed: DataFrame, sets: DataFrame, similarity: float, tmp: Scratch) -> DataFrame:
    """Pairs (a, b) of components of ``placed`` (fp, rep, component, own) such that with
    them every two texts of one ``fp`` that are ``similarity`` alike are in one component.
    ``sets`` (rep, s) has the texts' shingles, ``own`` is their number.

    Only texts of different components are compared. A crowd is dealt into blocks of
    bounded size, and each two blocks are one task, so no task grows with the crowd and
    no pair of texts is ever a row. A large component has blocks of its own, which are
    not held against one another. Crowds and components are hubs while their rows are
    narrow; the shingles join last, by text.
    """
    mixed = placed.groupBy("fp").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low <> high").select("fp", "n")
    open_ = tmp.written(joined_with_hubs(placed, mixed, "fp", placed.count()), "crowds").withColumn("kin", F.struct("fp", "component"))
    kin = open_.groupBy("kin", "fp", "component").agg(F.sum(F.col("own") + F.lit(ROW)).alias("size"), F.count("*").alias("rows"))
    kin = tmp.written(kin, "kin")
    pool = kin.groupBy("fp").agg(F.sum(F.when(F.col("size") < BLOCK, F.col("size"))).alias("pooled"), F.count("*").alias("n"))
    sized = joined_with_hubs(kin, pool, "fp", max(1, kin.count())).select("kin", "size", "pooled", F.col("rows").alias("n"))
    parts = lambda c: F.ceil(F.col(c) / F.lit(BLOCK))
    large = F.col("size") >= BLOCK
    block = F.struct(
        F.when(large, F.array("component")).otherwise(F.slice(F.array("component"), 1, 0)).alias("of"),
        F.when(large, F.pmod(F.xxhash64("rep"), parts("size"))).otherwise(F.pmod(F.xxhash64("component"), parts("pooled"))).alias("nth"),
    )
    dealt = joined_with_hubs(open_, tmp.written(sized, "sized"), "kin", max(1, open_.count()))
    dealt = tmp.written(dealt.select("fp", "rep", "component", block.alias("block")), "blocks")
    blocks = dealt.select("fp", "block").distinct()
    x, y = blocks.select("fp", F.col("block").alias("x")), blocks.select("fp", F.col("block").alias("y"))
    two = x.join(y, "fp").where((F.col("x") <= F.col("y")) & ((F.size("x.of") == 0) | (F.col("x.of") != F.col("y.of")))).withColumn("task", F.xxhash64("fp", "x", "y"))
    one = F.col("x") == F.col("y")
    sides = two.select("fp", "task", F.explode(F.when(one, F.array(F.struct(F.col("x").alias("block"), F.lit(3).alias("side")))).otherwise(F.array(F.struct(F.col("x").alias("block"), F.lit(1).alias("side")), F.struct(F.col("y").alias("block"), F.lit(2).alias("side"))))).alias("e"))
    compared = dealt.join(sides.select("fp", "task", "e.block", "e.side"), ["fp", "block"]).select("task", "rep", "component", "side").join(sets, "rep").drop("rep")
    kind = placed.schema["component"].dataType.simpleString()
    return compared.groupBy("task").applyInPandas(lambda crowd: _linked(crowd, similarity), f"a {kind}, b {kind}")


def text_key(text: Column) -> Column:
    """16 bytes that equal texts share; null is an empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, words_in: int = 5, views: int = 12, sample: int = 4, bucket_cap: int = 6) -> DataFrame:
    """(id, key, n, group, keeps): for each id and text of it (``key``, see :func:`text_key`), how
    many rows have both, the smallest id of its group of exact and near copies, and
    whether this is the text that the group keeps: that of the smallest id, of several the
    one of the smallest key.

    Near copies have word shingles of Jaccard similarity ``similarity`` or more, which
    is computed exactly for every candidate pair. Candidates are texts whose
    fingerprints link by the pivot tables, and texts with an equal fingerprint in one
    of ``views`` samples (a whole text's fingerprint differs in up to 14 bits at 0.8,
    which no table of 64 bits can search). With 12 views of 4 shingles a pair at 0.8
    is missed with probability 0.002. All pairs of a bucket of ``bucket_cap`` texts are
    candidates. Larger ones (crowds) first join each text to four leads: the first in
    three orders of texts that all buckets share, and the one that shares its buckets with
    most texts, as an original does. What that leaves apart is compared pair by pair, in
    blocks (:func:`_links_in_crowds`), so a crowd loses no link whatever its size.

    Texts are linked, not ids: an id with several texts is in several groups. Equal texts are one text
    from the start, so copies are never joined to one another. Null and empty texts are
    equal texts. Rows with a null id are not in the result. An empty table gives no rows.
    """
    @F.pandas_udf("array<long>")
    def prints_of(texts: pd.Series) -> pd.Series:
        return pd.Series([[_signed(simhash(t, words_in)), *sampled_simhashes(t, views, sample, words_in)] for t in texts], dtype=object)

    @F.pandas_udf("array<long>")
    def set_of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, words_in).view(np.int64)) for t in texts], dtype=object)

    tmp = Scratch(docs.sparkSession)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), text_key(F.col(text_col)).alias("key"))
    printed = tmp.written(rows.select("id", "key", prints_of("text").alias("prints")), "prints")
    texts = tmp.written(printed.groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("n"), F.first("prints").alias("prints")), "texts")

    whole = texts.select(F.col("key").alias("rep"), F.col("prints")[0].alias("fp"))
    heads = tmp.written(whole.groupBy("fp").agg(F.min("rep").alias("head"), F.count("*").alias("n")), "heads")
    far = tmp.written(links(heads.select("fp"), 2, tmp=tmp), "links")
    near = far.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("ha")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("hb")), "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    shared = heads.where("n > 1")
    equal = joined_with_hubs(whole, shared, "fp", max(1, shared.agg(F.sum("n")).first()[0] or 1)).where("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b"))

    viewed = texts.select(F.col("key").alias("rep"), F.explode(F.slice("prints", 2, views)).alias("fp"))
    buckets = viewed.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1")
    shared_views = buckets.withColumn("members", F.col("n"))
    members = joined_with_hubs(viewed, shared_views, "fp", max(1, views * texts.count())).withColumnRenamed("members", "n")
    members = tmp.written(members, "views")  # texts that share a view: few of all; a boilerplate's view is a hub
    few = members.where(F.col("n") <= bucket_cap)
    inside = few.select("fp", F.col("rep").alias("a")).join(few.select("fp", F.col("rep").alias("b")), "fp").where("a < b").select("a", "b")
    many = members.where(F.col("n") > bucket_cap)
    company = many.groupBy("rep").agg(F.sum("n").alias("company"))
    orders = [F.min(F.struct(F.xxhash64("rep", F.lit(i)).alias("at"), F.col("rep").alias("rep")))["rep"].alias(f"h{i}") for i in range(3)]
    leads = many.join(company, "rep").groupBy("fp").agg(*orders, F.max(F.struct("company", "rep"))["rep"].alias("h3"), F.first("n").alias("n"))
    leads = tmp.written(leads.select("fp", F.array("h0", "h1", "h2", "h3").alias("leads"), "n"), "leads")
    crowded = max(1, leads.agg(F.sum("n")).first()[0] or 1)
    led = joined_with_hubs(many.select("fp", F.col("rep").alias("a")), leads, "fp", crowded).select("a", F.explode("leads").alias("b"))
    pairs = near.unionByName(equal).unionByName(inside).unionByName(led).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = tmp.written(pairs, "pairs")

    # The sets of each text once: its row of the smallest id.
    involved = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(texts.select("key", "low"), "key")
    first = rows.join(involved.select(F.col("low").alias("id"), F.col("key").alias("wanted")).hint("merge"), "id").where("key = wanted").select("key", "text")
    sets = tmp.written(first.select(F.col("key").alias("rep"), set_of("text").alias("s")).dropDuplicates(["rep"]), "sets")
    n_pairs = pairs.count()
    by_a, by_b = (tmp.written(hub_copies(pairs, c, n_pairs), "hubs") for c in ("a", "b"))
    both = joined_salted(pairs, sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a", "b", by_a)
    both = joined_salted(both, sets.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b", "a", by_b)
    common = F.size(F.array_intersect("sa", "sb"))
    alike = F.when(F.size("sa") + F.size("sb") == 0, F.lit(True)).otherwise(common >= F.lit(similarity) * (F.size("sa") + F.size("sb") - common) - 1e-9)
    parts = tmp.written(connected_components(both.where(alike).select("a", "b")), "parts")

    apart = many.select("fp", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    apart = tmp.written(apart.join(sets.select("rep", F.size("s").alias("own")), "rep"), "placed")
    merged = tmp.written(connected_components(_links_in_crowds(apart, sets, similarity, tmp)).select(F.col("node").alias("component"), F.col("component").alias("group")), "merged")
    alone = merged.select(F.col("component").alias("node")).join(parts, "node", "left_anti").select("node", F.col("node").alias("component"))
    linked = tmp.written(parts.unionByName(alone), "linked")
    named = linked.groupBy("component").agg(F.count("*").alias("n")).join(merged, "component", "left").select("component", F.coalesce("group", "component").alias("part"), "n")
    linked = joined_with_hubs(linked, tmp.written(named, "components"), "component", max(1, linked.count())).select(F.col("node").alias("key"), "part")

    placed = tmp.written(texts.select("key", "low", F.col("n").alias("rows")).join(linked, "key", "left").withColumn("part", F.coalesce("part", "key")), "parts")
    kept = placed.groupBy("part").agg(F.min(F.struct("low", "key")).alias("kept"), F.count("*").alias("n"))
    groups = joined_with_hubs(placed, tmp.written(kept, "kept"), "part", max(1, placed.count()))
    groups = tmp.written(groups.select("key", F.col("kept.low").alias("group"), (F.col("kept.key") == F.col("key")).alias("first"), F.col("rows").alias("n")), "named")
    every = joined_with_hubs(printed.select("id", "key"), groups, "key", max(1, printed.count()))
    found = every.groupBy("id", "key", "group", "first").agg(F.count("*").alias("n")).select(F.col("id").alias(id_col), "key", "n", "group", (F.col("first") & (F.col("id") == F.col("group"))).alias("keeps"))
    return tmp.result(found, "copies")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of :func:`near_copies`: its smallest id with the
    text that the group keeps, in its own columns. Of repeated rows of that id and text one
    stays, any of them. Rows with a null id stay all."""
    found = near_copies(docs, id_col, text_col, **options)
    gone = found.where("NOT keeps").select(F.col(id_col).alias("__id"), F.col("key").alias("__key"))
    again = found.where("keeps AND n > 1").select(F.col(id_col).alias("__id"), F.col("key").alias("__key"))
    same = (docs[id_col] == F.col("__id")) & (text_key(docs[text_col]) == F.col("__key"))
    # What goes grows with the data, so it is merged with the rows and never sent to them, whatever its number.
    single = docs.join(gone.unionByName(again).hint("merge"), same, "left_anti")
    one = docs.join(again.hint("merge"), same).groupBy("__id", "__key").agg(F.first(F.struct(*[docs[c] for c in docs.columns])).alias("__row"))
    return single.unionByName(one.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns]))

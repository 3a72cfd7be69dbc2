"""URL rules by a bit-parallel wildcard automaton.

A rule is a glob over a canonical URL. All globs together are one multiword Shift-And
automaton: a bit for each place in each pattern, a mask of the bits that each byte may
enter, and a mask of the bits (stars) that each byte lets stay. One pass over the bytes
steps all patterns of a whole batch of URLs at once.

The canonical URL is ``.host``, a separator byte, then the path, so the rule
``example.org/es/`` is the glob ``*.example.org<sep>/es/*`` whose first star may not
pass the separator: it fits the host, every subdomain, and no path that merely looks
like a host.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = 0x00
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str

    @property
    def parts(self) -> tuple[str, str]:
        host, slash, path = self.text.partition("/")
        return host, slash + path


class Automaton:
    """``match(urls)`` gives for each canonical URL the index of the first pattern that
    fits, or -1. Patterns are lists of bytes, with None for a star over any byte and
    -1 for a star over any byte but the separator."""

    def __init__(self, patterns: list[list[int | None]]):
        bits = sum(1 + sum(x is not None and x >= 0 for x in p) for p in patterns)
        self.words = max(1, -(-bits // 64))
        enter = np.zeros((256, self.words), np.uint64)
        stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.final = []
        put = lambda mask, k: mask.__setitem__(k // 64, mask[k // 64] | np.uint64(1 << (k % 64)))
        k = 0
        for p in patterns:
            put(self.start, k)
            for x in p:
                if x is None or x == -1:
                    for c in range(256):
                        if x is None or c != SEPARATOR:
                            put(stay[c], k)
                else:
                    k += 1
                    put(enter[x], k)
            self.final.append(k)
            k += 1
        self.enter, self.stay = enter, stay

    def match(self, urls: list[bytes]) -> np.ndarray:
        first = np.full(len(urls), -1, np.int64)
        if not urls or not self.final:
            return first
        order = np.argsort([-len(u) for u in urls], kind="stable")  # longest first: those still read are a prefix
        lengths = np.array([len(urls[i]) for i in order])
        state = np.tile(self.start, (len(urls), 1))
        flat = np.frombuffer(b"".join(urls[i] for i in order), np.uint8)
        begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        live = np.arange(len(urls))
        for j in range(int(lengths[0]) if len(lengths) else 0):
            live = live[: np.searchsorted(-lengths[live], -j, "left")]
            if not len(live):
                break
            c = flat[begin[live] + j]
            now = state[live]
            moved = now << np.uint64(1)
            if self.words > 1:
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            now = (moved & self.enter[c]) | (now & self.stay[c])
            state[live] = now
            if j % 64 == 63:  # patterns that can still move or stay
                live = live[now.any(axis=1)]
        for i, k in reversed(list(enumerate(self.final))):
            hit = (state[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
            first[order[hit.astype(bool)]] = i
        return first


def host_column(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or without ``://``: empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_column(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def compile_rules(rules: list[Rule]) -> tuple[Automaton, list[Rule]]:
    """Longest rule first; of equally long ones the one given first."""
    ordered = sorted(rules, key=lambda r: -len(r.text))
    globs = []
    for r in ordered:
        host, path = r.parts
        host = host.translate(str.maketrans(UPPER, LOWER))
        globs.append([-1, *f".{host}".encode(), SEPARATOR, *path.encode(), None])
    return Automaton(globs), ordered


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict), one row per row of ``pages``.

    The longest rule that fits gives the verdict; where none fits, ``rule`` is null and
    ``default`` holds. A null URL or one without ``://`` has no host and no path, and
    no rule fits it. URLs are read to their end whatever their length. Repeated rows
    give repeated rows. Zero bytes of a URL count as U+FFFD to the automaton.
    """
    automaton, ordered = compile_rules(rules)

    @F.pandas_udf("int")
    def which(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        urls = [b"." + h.replace("\0", "�").encode() + b"\0" + p.replace("\0", "�").encode() if h or p else b"" for h, p in zip(hosts, paths)]
        return pd.Series(automaton.match(urls), dtype="int32")

    texts = F.array(*[F.lit(r.text) for r in ordered]) if ordered else F.array(F.lit(None).cast("string"))
    verdicts = F.array(*[F.lit(r.verdict) for r in ordered]) if ordered else F.array(F.lit(None).cast("string"))
    parted = pages.select(F.col(id_col), host_column(F.col(url_col)).alias("host"), path_column(F.col(url_col)).alias("path"))
    found = parted.withColumn("which", which("host", "path"))
    hit = F.col("which") >= 0
    return found.select(
        id_col, "host", "path",
        F.when(hit, F.element_at(texts, F.col("which") + 1)).alias("rule"),
        F.when(hit, F.element_at(verdicts, F.col("which") + 1)).otherwise(F.lit(default)).alias("verdict"),
    )

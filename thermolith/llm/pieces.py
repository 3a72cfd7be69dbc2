"""SentencePiece encoding and decoding by a batched numpy Viterbi.

All distinct words of a batch that have the same length advance together, one position
at a time. At each position every substring that ends there is looked up by its hash in
the sorted hashes of the pieces; of those that can end a best path, vectorised maxima
pick the winner and store its length as the backpointer.

Two kinds of model use the one lattice:

* unigram: a path's score is the sum of its pieces' scores, and the best is kept.
* BPE: the result of the merges is the one path whose neighbouring pieces would each
  stay apart if merged alone, and for every prefix exactly one last piece extends such
  a path. So candidates are those compatible with the piece that the backpointer at
  their start names; where several could be, the longest wins the maximum. Whether two
  pieces stay apart is decided by undoing their merges, for all open pairs at once, and
  remembered.

Where fewer than ``FEW`` words have one length (a long run without a break, say), each
goes by the same recurrence alone: arrays of a few places cost more than they save.

A word is a run of the space mark ``▁`` and what follows up to the next one. Models with
a piece that holds the mark after another character, where words would not be
independent, are taken as one word a text. The model file is read on the driver and
must be at most ``MOST_MODEL_BYTES``; its bytes go to the executors.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MOST_MODEL_BYTES = 64 << 20
MARK = "▁"
#: Remembered pairs of pieces: 2 to this power.
MEMO_BITS = 20
#: Bytes of words, with their pieces, that a Python worker remembers in each of two generations; what an entry
#: takes besides its text and ids; and the longest word (characters) that is remembered.
REMEMBERED, ENTRY, LONGEST_KEPT = 16 << 20, 200, 100
#: Bytes of text split into words together, and words of one length that advance together (characters).
AT_ONCE, LOCKSTEP = 3 << 20, 400_000
#: Fewer words of one length go one at a time.
FEW = 6
#: Longer words are cut where no piece can lie before they are looked at.
SHORT = 24
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message: ints, bytes, or four or eight raw bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


class Model:
    """Pieces, scores and kinds of a serialised SentencePiece model."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        scores, kinds = [], []
        self.model_type, self.dummy_prefix, self.squeeze, self.escape = 1, True, True, True
        charsmap = b""
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode("utf-8"))
                scores.append(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0])
                kinds.append(own.get(3, NORMAL))
            elif number == 2:
                self.model_type = dict(_fields(value)).get(3, 1)
            elif number == 3:
                own = dict(_fields(value))
                charsmap = own.get(2, b"")
                self.dummy_prefix, self.squeeze, self.escape = bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))
        if self.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models are known")
        if charsmap:
            raise ValueError("models with a character map need their own normaliser")
        self.scores, self.kinds = np.array(scores, np.float64), np.array(kinds)
        self.unk = kinds.index(UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if kinds[i] == BYTE}
        self.byte_fallback = len(self.byte_ids) == 256
        self.independent = not any(MARK in p.lstrip(MARK) for p, k in zip(self.pieces, kinds) if k in (NORMAL, USER))
        self.lattice = Lattice(self)
        self.after_mark = self.escape and self.dummy_prefix and not self.squeeze and self.independent
        spell = {BYTE: lambda p: bytes([int(p[3:5], 16)]), UNKNOWN: lambda p: " \u2047 ".encode(), CONTROL: lambda p: b""}
        self.spelling = [spell.get(k, lambda p: p.replace(MARK, " ").encode("utf-8"))(p) for p, k in zip(self.pieces, kinds)]
        self.spelt_size = np.array([len(x) for x in self.spelling], np.int32)
        self.spelt_at = np.concatenate(([0], np.cumsum(self.spelt_size)[:-1])).astype(np.int32)
        self.spelt = np.frombuffer(b"".join(self.spelling), np.uint8)
        self.leads = np.array([x[:1] == b" " for x in self.spelling], np.int32)

    def normal(self, text: str) -> str:
        """The text as the pieces spell it."""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if text and self.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.escape else text

    def words(self, text: str) -> list[str]:
        """The words of a text, each named by what follows its first mark. A word without a
        mark has one that no other can have, as none holds a mark inside."""
        if self.after_mark and MARK not in text and "  " not in text and text[:1] != " " and text[-1:] != " ":
            return text.split(" ") if text else []  # all words of plain prose follow one mark
        normal = self.normal(text)
        if not self.independent:
            return [f"\0{MARK}{normal}"] if normal else []
        return [w[1:] if w[0] == MARK else f"\0{MARK}{w}" for w in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", normal)]

    @staticmethod
    def word(name: str) -> str:
        return name[2:] if name[:2] == f"\0{MARK}" else MARK + name

    def decode(self, ids: Iterable[int]) -> str:
        """The text that the pieces spell; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.spelling.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text

    def decode_all(self, flat: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts that ``flat`` spells, the k-th from ``ends[k]`` to ``ends[k + 1]``."""
        size, at = self.spelt_size[flat], self.spelt_at[flat]
        if self.dummy_prefix:
            first = ends[:-1][ends[1:] > ends[:-1]]
            lead = self.leads[flat[first]]
            size[first] -= lead
            at[first] += lead
        end = np.concatenate(([0], np.cumsum(size, dtype=np.int32)))
        place = np.repeat(at - end[:-1], size)
        place += np.arange(end[-1], dtype=np.int32)
        out = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(end[ends].astype(np.int32)), pa.py_buffer(self.spelt[place]))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            return pa.array([self.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.string())
        return out


class Lattice:
    def __init__(self, model: Model):
        self.m = model
        usable = [i for i, k in enumerate(model.kinds) if k in (NORMAL, USER) and model.pieces[i]]
        self.longest = max((len(model.pieces[i]) for i in usable), default=1)
        powers = np.cumprod(np.full(self.longest + 1, _BASE, _U))
        self.powers = powers
        keys = np.array([self._key(model.pieces[i]) for i in usable], _U)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(usable, np.int64)[order]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces have one hash")
        # Where in the sorted keys those with the same upper 18 bits begin, and whether there are any.
        self.begin = np.searchsorted(self.keys, np.arange(1 << 18, dtype=_U) << _U(46)).astype(np.int32)
        self.begin = np.append(self.begin, np.int32(len(self.keys)))
        self.any = np.diff(self.begin) > 0
        self.most = int(np.diff(self.begin).max(initial=0))
        self.by_text = {model.pieces[i]: i for i in usable}
        #: Neighbouring characters that some piece holds; between any other two no piece can lie.
        inside = {(ord(p[k]) << 21) | ord(p[k + 1]) for i in usable for p in (model.pieces[i],) for k in range(len(p) - 1)}
        self.bigrams = np.array(sorted(inside), np.int64)
        self.floor = float(model.scores[usable].min()) - 10.0 if usable else -10.0
        self.score = model.scores.tolist()
        if model.model_type == 2:
            self._merges(usable)

    def _key(self, piece: str) -> int:
        total = 0
        for k, c in enumerate(piece):
            total = (total + (ord(c) + 1) * int(self.powers[k])) % 2**64
        return total ^ len(piece)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 for none."""
        out = np.full(len(key), -1, np.int32)
        upper = (key >> _U(46)).astype(np.int32)
        live = np.flatnonzero(self.any[upper])
        key, upper = key[live], upper[live]
        here, end = self.begin[upper], self.begin[upper + 1]
        for _ in range(self.most):
            hit = self.keys[here] == key
            out[live[hit]] = self.ids[here[hit]]
            more = np.flatnonzero(~hit & (here + 1 < end))
            if not len(more):
                break
            live, key, here, end = live[more], key[more], here[more] + 1, end[more]
        return out

    def _merges(self, usable: list[int]) -> None:
        """Each piece's rank (best score first) and the two pieces its last merge joins."""
        m = self.m
        by_rank = sorted(usable, key=lambda i: (-m.scores[i], i))
        n = len(m.pieces)
        self.rank = np.full(n + 1, 1 << 40, np.int64)
        self.rank[by_rank] = np.arange(len(by_rank))
        self.left, self.right = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
        for i in by_rank:
            parts = self._merge_alone(m.pieces[i], self.by_text, i)
            if len(parts) == 2:
                self.left[i], self.right[i] = parts
            elif len(m.pieces[i]) > 1:
                self.rank[i] = 1 << 40  # the merges never arrive at this piece
        self.reached = self.rank[:n] < 1 << 40  # by piece; index -1 is never asked for alone
        self.memo = np.full(1 << MEMO_BITS, -2, np.int64)  # pair * 2 + whether they stay apart
        self.size = np.array([len(p) for p in m.pieces])
        full = 2**64
        self.raw = np.array([sum((ord(c) + 1) * int(self.powers[k]) for k, c in enumerate(p)) % full if len(p) <= self.longest else 0 for p in m.pieces], _U)
        self.shift = np.concatenate(([_U(1)], self.powers))
        self.rank_of, self.left_of, self.right_of = self.rank.tolist(), self.left.tolist(), self.right.tolist()
        self.pairs: dict[tuple[int, int], bool] = {}

    def _merge_alone(self, piece: str, by_text: dict[str, int], but: int) -> list[int]:
        """The merges on one piece's characters, without those that make the piece itself."""
        parts = list(piece)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = by_text.get(parts[k] + parts[k + 1])
                if i is not None and i != but and self.rank[i] < 1 << 40 and (best is None or self.rank[i] < best):
                    best, at = self.rank[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [by_text.get(p, -1) for p in parts]

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the piece that a and b spell together, or a huge one."""
        size = self.size[a] + self.size[b]
        fits = size <= self.longest
        key = self.raw[a] + self.raw[b] * self.shift[np.where(fits, self.size[a], 0)]
        return np.where(fits, self.rank[self.find(key ^ size.astype(_U))], 1 << 40)  # id -1: the last rank, a huge one

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of pieces a and b gives a and b again. Answers are kept
        in a table of fixed size, where a newer pair takes an older one's place."""
        pair = a * (len(self.m.pieces) + 1) + b
        slot = ((pair.astype(_U) * _BASE) >> _U(64 - MEMO_BITS)).astype(np.int64)
        held = self.memo[slot]
        out = (held & 1).astype(bool)
        missed = np.flatnonzero((held >> 1) != pair)
        if len(missed):
            fresh, back = np.unique(pair[missed], return_inverse=True)
            n = len(self.m.pieces) + 1
            answer = self._undo(fresh // n, fresh % n)
            out[missed] = answer[back]
            self.memo[slot[missed]] = pair[missed] * 2 + answer[back]
        return out

    def _undo(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undoes the later merge of the two again and again: they do not stay apart if
        the pieces then at the border would have merged before it."""
        a, b = a.copy(), b.copy()
        held = np.ones(len(a), bool)
        limit = np.full(len(a), 1 << 40, np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            joined = self._joined(x, y)
            crossed = joined < limit[live]
            held[live[crossed]] = False
            live, x, y = live[~crossed], x[~crossed], y[~crossed]
            rx, ry = self.rank[x], self.rank[y]
            simple_x, simple_y = self.right[x] < 0, self.left[y] < 0
            # Of two merges the one of the larger rank came last. At equal rank the left one came first.
            undo_x = ~simple_x & (simple_y | (rx > ry))
            undo_y = ~simple_y & ~undo_x
            i = live[undo_x]
            limit[i] = np.minimum(limit[i], rx[undo_x])
            a[i] = self.right[x[undo_x]]
            i = live[undo_y]
            limit[i] = np.minimum(limit[i], ry[undo_y] + 1)
            b[i] = self.left[y[undo_y]]
            live = live[undo_x | undo_y]
        return held

    def parts(self, words: list[str]) -> list[list[str]]:
        """Each word cut wherever no piece could hold the two characters that meet."""
        whole = "".join(words)
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        meet = (code[:-1] << 21) | code[1:]
        at = np.minimum(np.searchsorted(self.bigrams, meet), max(0, len(self.bigrams) - 1))
        cut = np.ones(len(code) + 1, bool)
        cut[1:-1] = (self.bigrams[at] != meet) if len(self.bigrams) else True
        ends = np.cumsum([len(w) for w in words])
        cut[ends] = True
        places = np.flatnonzero(cut)
        spans = [whole[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist())]
        last = np.searchsorted(places, ends).tolist()
        return [spans[a:b] for a, b in zip([0, *last[:-1]], last)]

    def encode_words(self, words: list[str]) -> tuple[list[bytes], list[int]]:
        """Piece ids (int32) of each word, -1 - code point where no piece spells a character,
        and the indices of the words that have such a one."""
        out, lacking = [b""] * len(words), []
        lengths = np.array([len(w) for w in words], np.int64)
        order = np.argsort(lengths, kind="stable")
        sizes, begin = np.unique(lengths[order], return_index=True)
        for n, a, b in zip(sizes.tolist(), begin.tolist(), np.append(begin[1:], len(order)).tolist()):
            if n and b - a < FEW:
                for k in order[a:b].tolist():
                    ids = self._alone(words[k])
                    out[k] = array("i", ids).tobytes()
                    if min(ids) < 0:
                        lacking.append(k)
            elif n:
                block = max(1, LOCKSTEP // n)
                for i in range(a, b, block):
                    part = order[i : min(i + block, b)].tolist()
                    found, bare = self._advance([words[j] for j in part])
                    for k, ids in zip(part, found):
                        out[k] = ids
                    lacking += [part[k] for k in bare]
        return out, lacking

    def _advance(self, words: list[str]) -> tuple[list[bytes], list[int]]:
        """All words, of one length, one position at a time."""
        n, rows = len(words[0]), len(words)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(rows, n).T.astype(_U) + _U(1)
        last = np.full((n + 1, rows), -1, np.int32)  # the piece that ends at each position
        back = np.zeros((n + 1, rows), np.int8 if self.longest < 128 else np.int32)  # its length: the backpointer
        best = np.zeros((n + 1, rows)) if self.m.model_type == 1 else None
        window = min(self.longest, n)
        hashes, longer = np.zeros((window, rows), _U), np.zeros((window, rows), _U)  # of the substrings that end here, by size
        marks = np.arange(1, window + 1, dtype=_U)[:, None]
        for end in range(1, n + 1):
            c, sizes = code[end - 1], min(window, end)
            np.multiply(self.powers[:sizes, None], c, out=longer[:sizes])
            longer[1:sizes] += hashes[: sizes - 1]
            hashes, longer = longer, hashes
            piece = self.find((hashes[:sizes] ^ marks[:sizes]).reshape(-1)).reshape(sizes, rows)
            alone = piece[0] < 0  # a character without a piece is a step of its own
            if self.m.model_type == 1:
                self._best(end, sizes, piece, alone, last, back, best)
            else:
                self._only(end, sizes, piece, alone, last, back)
        if (back[n] == 0).any():
            raise ValueError("the model has no pieces for a word")
        at, live, steps = np.full(rows, n), np.arange(rows), []
        while len(live):
            here = at[live]
            ids = last[here, live]
            steps.append((live, np.where(ids == len(self.m.pieces), -code[here - 1, live].astype(np.int64), ids)))
            at[live] -= back[here, live]
            live = live[at[live] > 0]
        found = np.zeros((rows, len(steps)), np.int32)  # paths were followed from the end: they stand at the right
        count = np.zeros(rows, np.int64)
        for k, (those, ids) in enumerate(steps):
            found[those, len(steps) - 1 - k] = ids
            count[those] += 1
        flat = found[np.arange(len(steps)) >= (len(steps) - count)[:, None]].tobytes()
        ends = np.cumsum(4 * count).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)], np.flatnonzero((found < 0).any(1)).tolist()

    def _alone(self, word: str) -> list[int]:
        """One word, by the same recurrence."""
        n, get, unigram = len(word), self.by_text.get, self.m.model_type == 1
        last, back, best = [-1] * (n + 1), [0] * (n + 1), [0.0] * (n + 1)
        for end in range(1, n + 1):
            pick = 0
            for size in range(min(self.longest, end), 0, -1):
                i = get(word[end - size : end])
                if i is None:
                    continue
                if unigram:
                    value = self.score[i] + best[end - size]
                    if not pick or value >= best[end]:
                        best[end], pick, last[end] = value, size, i
                elif self.rank_of[i] < 1 << 40 and (last[end - size] < 0 or self._apart(last[end - size], i)):
                    pick, last[end] = size, i
                    break
            if get(word[end - 1]) is None and (not pick or unigram and best[end - 1] + self.floor > best[end]):
                pick, last[end], best[end] = 1, -1 - ord(word[end - 1]), best[end - 1] + self.floor
            back[end] = pick
            if not pick and not unigram and end == n:
                raise ValueError("the model has no pieces for a word")
        ids, end = [], n
        while end:
            ids.append(last[end])
            end -= back[end]
        return ids[::-1]

    def _apart(self, a: int, b: int) -> bool:
        """:meth:`stay_apart` of one pair."""
        held = self.pairs.get((a, b))
        if held is None:
            limit, x, y = 1 << 40, a, b
            rank, get, pieces = self.rank_of, self.by_text.get, self.m.pieces
            while True:
                joined = get(pieces[x] + pieces[y])
                if joined is not None and rank[joined] < limit:
                    held = False
                    break
                more_x, more_y = self.right_of[x] >= 0, self.left_of[y] >= 0
                if more_x and (not more_y or rank[x] > rank[y]):
                    limit, x = min(limit, rank[x]), self.right_of[x]
                elif more_y:
                    limit, y = min(limit, rank[y] + 1), self.left_of[y]
                else:
                    held = True
                    break
            if len(self.pairs) >= 1 << MEMO_BITS - 2:
                self.pairs.clear()
            self.pairs[a, b] = held
        return held

    def _best(self, end, sizes, piece, alone, last, back, best) -> None:
        """Unigram: the path of the largest sum of scores."""
        value = np.where(piece[:sizes] >= 0, self.m.scores[piece[:sizes]] + best[end - 1 - np.arange(sizes)], -np.inf)
        value[0, alone] = best[end - 1, alone] + self.floor
        pick = value.argmax(0)
        rows = np.arange(value.shape[1])
        best[end] = value[pick, rows]
        ids = piece[pick, rows]
        last[end] = np.where(ids < 0, len(self.m.pieces), ids)
        back[end] = pick + 1

    def _only(self, end, sizes, piece, alone, last, back) -> None:
        """BPE: the one piece that can end this prefix. Where a single one is there it is
        that; where there are several, those that the merges rule out go, and the longest left wins."""
        there = (piece[:sizes] >= 0) & self.reached[piece[:sizes]]
        count = there.sum(0, dtype=np.int8)
        pick = sizes - 1 - there[::-1].argmax(0)
        many = np.flatnonzero(count + alone > 1)
        if len(many):
            short, k = np.nonzero(there[:, many])
            at = many[k]
            before, ids = last[end - 1 - short, at].astype(np.int64), piece[short, at].astype(np.int64)
            test = np.flatnonzero((before >= 0) & (before < len(self.m.pieces)))
            out = test[~self.stay_apart(before[test], ids[test])]
            there[short[out], at[out]] = False
            left = there[:, many]
            pick[many] = sizes - 1 - left[::-1].argmax(0)
            count[many] = left.any(0)
        rows = np.arange(len(pick))
        none = (count == 0) & alone
        last[end] = np.where(none, len(self.m.pieces), piece[pick, rows])
        back[end] = np.where(none, 1, np.where(count > 0, pick + 1, 0))


class Memory:
    """Two generations of about REMEMBERED bytes at most: what is used in the younger one lives on."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def lacking(self, names: set[str]) -> list[str]:
        """Those that are in neither generation; the others are in the younger one now."""
        missed = names.difference(self.young)
        again = missed.intersection(self.old) if self.old else ()
        self.keep({name: self.old[name] for name in again})
        return list(missed.difference(again)) if again else list(missed)

    def keep(self, found: dict[str, bytes]) -> None:
        self.young.update(found)
        self.held += sum(map(len, found)) + sum(map(len, found.values())) + ENTRY * len(found)

    def turn(self) -> None:
        """Between batches: a full generation becomes the old one."""
        if self.held > REMEMBERED:
            self.old, self.young, self.held = self.young, {}, 0


class Encoder:
    """Encodes whole texts, with a memory of the words it has met."""

    def __init__(self, data: bytes):
        self.model = Model(data)
        self.known = Memory()

    def _spell(self, ids: bytes) -> bytes:
        """Final ids: a character without a piece becomes its bytes' pieces, or one unknown for a run of them."""
        m, out, unknown = self.model, [], False
        for i in array("i", ids):
            if i >= 0:
                out.append(i)
            elif m.byte_fallback:
                out += [m.byte_ids[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")]
            elif not unknown:
                out.append(m.unk)
            unknown = i < 0
        return array("i", out).tobytes()

    def _new(self, words: list[str]) -> list[bytes]:
        """The final ids of words. With byte fallback, a word longer than SHORT is first cut
        where no piece can lie; without, a run of unknown characters is one piece."""
        lattice = self.model.lattice
        long = [k for k, w in enumerate(words) if len(w) > SHORT] if self.model.byte_fallback else []
        if not long:
            return self._final(words)
        cut = lattice.parts([words[k] for k in long])
        parts = list({x for c in cut for x in c})
        spelt = dict(zip(parts, self._final(parts)))
        whole = set(long)
        short = iter(self._final([w for k, w in enumerate(words) if k not in whole]))
        joined = iter(cut)
        return [b"".join(map(spelt.__getitem__, next(joined))) if k in whole else next(short) for k in range(len(words))]

    def _final(self, words: list[str]) -> list[bytes]:
        found, lacking = self.model.lattice.encode_words(words)
        for k in lacking:
            found[k] = self._spell(found[k])
        return found

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Some texts at a time, so that the words held do not grow with the batch."""
        out, held, chars = [], [], 0
        for t in texts:
            held.append(t or "")
            chars += len(held[-1])
            if chars >= AT_ONCE:
                out += self._encode(held)
                held, chars = [], 0
        return [np.frombuffer(x, np.int32) for x in out + self._encode(held)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as int32 bytes."""
        self.known.turn()
        names = set()
        for t in texts:  # split again for the ids, so that no word is held twice in between
            names.update(self.model.words(t))
        new, known = self.known.lacking(names), self.known.young
        found = dict(zip(new, self._new(list(map(self.model.word, new)))))
        once = [name for name in new if len(name) > LONGEST_KEPT]
        known.update((name, found.pop(name)) for name in once)
        self.known.keep(found)
        out = [b"".join(map(known.__getitem__, self.model.words(t))) for t in texts]
        for name in once:
            del known[name]
        return out

    def arrays(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each text's begin and end."""
        found = self._encode([t or "" for t in texts])
        return np.frombuffer(b"".join(found), np.int32), np.concatenate(([0], np.cumsum([len(x) // 4 for x in found]))).astype(np.int32)


def read_model(path: str = DEFAULT_MODEL) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MOST_MODEL_BYTES + 1)
    if len(data) > MOST_MODEL_BYTES:
        raise ValueError("the model file is too large to be sent to the executors")
    return data


_ENCODERS: dict[int, Encoder] = {}


def _encoder(data: bytes) -> Encoder:
    """One encoder for each model in a Python worker, kept for the next task."""
    key = hash(data)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(data)
    return _ENCODERS[key]


def _lists(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))


def _cuts(column: pa.Array) -> list[int]:
    """Row numbers that part a column into pieces of about AT_ONCE bytes, or of one row that has more."""
    size = (pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length)(column)
    total = np.cumsum(np.nan_to_num(size.to_numpy(zero_copy_only=False)) + 1)
    out = [0]
    while out[-1] < len(column):
        done = total[out[-1] - 1] if out[-1] else 0
        out.append(max(out[-1] + 1, int(np.searchsorted(total, done + AT_ONCE))))
    out[-1] = len(column)
    return out


def _give_back() -> None:
    """Memory that Arrow and the C library keep after it was freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def _some_at_a_time(docs: DataFrame, of, added: list[tuple[str, str, pa.DataType]], needs: str) -> DataFrame:
    """``docs`` with columns that ``of`` makes from column ``needs``: Arrow in and out, and
    never more than some rows of it, so what is held does not grow with the batch. What is
    freed goes back to the system, as the worker lives on beside other stages."""
    names = [n for n, _, _ in added]
    kept = [c for c in docs.columns if c not in names]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, T._parse_datatype_string(kind)) for n, kind, _ in added])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = _cuts(batch.column(needs))
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                made = of(part.column(needs))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + made, names=kept + names)
                part = made = None
                _give_back()
        batch = None
        _give_back()

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str = DEFAULT_MODEL, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with the piece ids of each text in ``out_col`` (array<int>).

    Null and empty texts have no pieces. Texts are encoded whole, however long they or
    their words are; a row of itself is never split. Repeated rows give repeated rows, an
    empty table an empty one. Other columns stay; one named ``out_col`` is replaced.
    """
    model = read_model(path)
    return _some_at_a_time(docs, lambda x: [_lists(*_encoder(model).arrays(x.to_pylist()))], [(out_col, "array<int>", pa.list_(pa.int32()))], text_col)


def decode(docs: DataFrame, path: str = DEFAULT_MODEL, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with the texts that the ids spell (null: empty)."""
    model = read_model(path)

    def of(x: pa.Array) -> list[pa.Array]:
        full = x.fill_null([]) if x.null_count else x
        ends = full.offsets.to_numpy().astype(np.int64)
        return [_encoder(model).model.decode_all(full.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.int32), ends - ends[0])]

    return _some_at_a_time(docs, of, [(out_col, "string", pa.string())], ids_col)


def encode_and_decode(docs: DataFrame, path: str = DEFAULT_MODEL, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Both in one pass: ids, and the text spelt from these very ids."""
    model = read_model(path)

    def of(x: pa.Array) -> list[pa.Array]:
        own = _encoder(model)
        flat, ends = own.arrays(x.to_pylist())
        return [_lists(flat, ends), own.model.decode_all(flat, ends)]

    return _some_at_a_time(docs, of, [(ids_col, "array<int>", pa.list_(pa.int32())), (out_col, "string", pa.string())], text_col)

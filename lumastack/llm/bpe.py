"""Merge replay: byte-pair merges applied to many words at once, in the order of their ranks.

An inverted index leads from each token pair (by the rank of its merge) to the positions where it stands. The lowest rank
is taken from a heap, all its positions merge together, and only the two neighbours of each are looked at again. So the
cost follows the merges made, not words times vocabulary.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import regex

from lumastack.llm.shared import Interner, gather

NONE = np.int32(2**31 - 1)


@dataclass
class Merges:
    """Pairs of token ids (left << 32 | right, ascending), the rank of each, and the id that a merge of a rank gives."""

    keys: np.ndarray
    ranks: np.ndarray
    ids: np.ndarray

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where there is no merge or an id is negative."""
        wanted = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == wanted) & (right >= 0), self.ranks[at], NONE)


def replay(merges: Merges, tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Apply every merge to words given as token ids; word i is tokens[starts[i]:starts[i + 1]], none is empty.

    Returns the new ids, their starts, and the words in which a merge made a pair of a lower rank than its own. Taking all
    positions of a rank together may then differ from taking one pair at a time, so the caller does those words singly.
    """
    n = len(tokens)
    if not n:
        return tokens.astype(np.int32), starts, np.zeros(0, np.int64)
    tok = np.append(tokens.astype(np.int32), np.int32(-1))
    nxt, prv = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    nxt[n] = n
    nxt[starts[1:] - 1] = n
    prv[starts[:-1]] = n
    rank = np.full(n + 1, NONE, np.int32)
    rank[:n] = merges.find(tok[:n], tok[nxt[:n]])
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    odd: list[np.ndarray] = []

    def add(places: np.ndarray, ranks: np.ndarray, heap: list[int]) -> None:
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for r, i, j in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
            if r in index:
                index[r].append(places[i:j])
            else:
                index[r] = [places[i:j]]
                heapq.heappush(heap, r)

    heap: list[int] = []
    first = np.flatnonzero(rank < NONE)
    if len(first):
        add(first, rank[first], heap)
    while heap:
        r = heapq.heappop(heap)
        found = index.pop(r)
        pos = found[0] if len(found) == 1 else np.concatenate(found)
        pos = pos[rank[pos] == r]
        if not len(pos):
            continue
        mid = nxt[pos]
        if (rank[mid] == r).any():  # pairs that overlap: from the left, each that is still free
            taken, free = set(), []
            for p, m in sorted(set(zip(pos.tolist(), mid.tolist(), strict=True))):
                if p not in taken:
                    free.append(p)
                    taken.add(m)
            pos = np.array(free, np.int64)
            mid = nxt[pos]
        end = nxt[mid]
        tok[pos] = merges.ids[r]
        nxt[pos] = end
        prv[end] = pos
        rank[mid] = NONE
        alive[mid] = False
        before = prv[pos]
        near = np.concatenate((pos, before[before < n]))
        new = merges.find(tok[near], tok[nxt[near]])
        rank[near] = new
        is_pair = new < NONE
        if is_pair.any():
            near, new = near[is_pair], new[is_pair]
            if int(new.min()) < r:
                odd.append(near[new < r])
            add(near, new, heap)
    sizes = np.add.reduceat(alive, starts[:-1])
    words = np.unique(np.searchsorted(starts, np.concatenate(odd), side="right") - 1) if odd else np.zeros(0, np.int64)
    return tok[:n][alive], np.concatenate(([0], np.cumsum(sizes))), words


def join_words(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Words' ids as one array, and their starts."""
    return (np.concatenate(words) if words else np.zeros(0, np.int32)), np.cumsum([0, *map(len, words)])


def with_words(ids: np.ndarray, starts: np.ndarray, other: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The same words, with those of other in place of their own."""
    if not other:
        return ids, starts
    words = [other[i] if i in other else ids[starts[i] : starts[i + 1]] for i in range(len(starts) - 1)]
    return join_words(words)


def regroup(ids: np.ndarray, starts: np.ndarray, order: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of pieces put in order, and where each group of pieces (group g is order[groups[g]:groups[g + 1]]) starts."""
    ends = np.concatenate(([0], np.cumsum((starts[1:] - starts[:-1])[order])))
    return gather(ids, starts, order), ends[groups]


class Coder:
    """Codes distinct texts in bulk and remembers a bounded number of them for the next blocks of the same worker."""

    #: Texts that a worker remembers, about 100 bytes each.
    REMEMBERED = 600_000

    def __init__(self):
        self.cache: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode_new(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct texts, none empty: flat, and where each text starts."""
        place = np.fromiter(map(self.cache.get, texts, repeat(-1)), np.int64, len(texts))
        unseen = np.flatnonzero(place < 0)
        new = [texts[i] for i in unseen.tolist()]
        ids, starts = self.encode_new(new)
        ids, starts = np.concatenate((self.ids, ids)), np.concatenate((self.starts[:-1], self.starts[-1] + starts))
        place[unseen] = len(self.cache) + np.arange(len(new))
        if room := max(0, self.REMEMBERED - len(self.cache)):
            self.cache.update(zip(new[:room], range(len(self.cache), len(self.cache) + len(new)), strict=False))
            self.starts = starts[: len(self.cache) + 1].copy()
            self.ids = ids[: self.starts[-1]].copy()
        return regroup(ids, starts, place, np.arange(len(texts) + 1))


class RankCoder(Coder):
    """Byte-level coding by a rank file (base64 token and rank a line) and a pattern that cuts text before the merges."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(left << 32 | right, r) for token, r in self.ranks.items() for i in range(1, len(token)) if (left := self.ranks.get(token[:i])) is not None and (right := self.ranks.get(token[i:])) is not None]
        keys, ranks = np.array(pairs, np.int64).reshape(-1, 2).T
        order = np.argsort(keys)
        self.merges = Merges(keys[order], ranks[order].astype(np.int32), np.arange(max(self.ranks.values()) + 1, dtype=np.int32))
        size = max(self.ranks.values()) + 1
        table = [b""] * size
        for token, r in self.ranks.items():
            table[r] = token
        self.token_bytes = np.frombuffer(b"".join(table), np.uint8)
        self.token_starts = np.cumsum([0, *map(len, table)])

    def one(self, piece: bytes) -> list[int]:
        """A single piece, one merge at a time: the lowest rank first, the leftmost of equals."""
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], NONE), i) for i in range(len(parts) - 1))
            if best == NONE:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def cut(self, units: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct pieces of texts, none of them empty, in order of their first place; each text's pieces as places among them, and where each text starts."""
        pieces, used, sizes, cut = Interner(), [], [0], self.pattern.findall
        for unit in units:
            if (unit[1:] if unit[0] == " " else unit).isalpha():  # the pattern keeps such a unit whole
                used.append(pieces[unit])
                sizes.append(1)
            else:
                found = cut(unit)
                used.extend(map(pieces.__getitem__, found))
                sizes.append(len(found))
        return list(pieces), np.array(used, np.int64), np.cumsum(sizes)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, all merged together by one replay: flat, and where each piece starts."""
        known = list(map(str.encode, pieces))
        direct = np.array(list(map(self.ranks.get, known, repeat(-1))), np.int64)
        rest, whole = np.flatnonzero(direct < 0), np.flatnonzero(direct >= 0)
        words = [known[i] for i in rest.tolist()]
        ids, starts, odd = replay(self.merges, self.byte_ids[np.frombuffer(b"".join(words), np.uint8)], np.cumsum([0, *map(len, words)]))
        ids, starts = with_words(ids, starts, {i: np.array(self.one(words[i]), np.int32) for i in odd.tolist()})
        place = np.empty(len(known), np.int64)  # the merged pieces come first, then those that are tokens as they are
        place[rest], place[whole] = np.arange(len(rest)), len(rest) + np.arange(len(whole))
        ids = np.concatenate((ids, direct[whole].astype(np.int32)))
        starts = np.concatenate((starts, starts[-1] + 1 + np.arange(len(whole))))
        return regroup(ids, starts, place, np.arange(len(known) + 1))

    def encode_new(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts, none empty: flat, and where each text starts. The distinct pieces of all texts are merged together."""
        pieces, used, starts = self.cut(units)
        return regroup(*self.encode_pieces(pieces), used, starts)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        return gather(self.token_bytes, self.token_starts, ids).tobytes()


class WordCoder(Coder):
    """Ids of words under a tokenizer file with byte-level symbols and word ends, without special tokens.

    Words of plain Latin characters go through merge replay; the library itself codes the others, where normal forms,
    unusual white space or the strings of special tokens could matter.
    """

    #: Letters, digits and signs below U+0250 without white space, controls and U+0130.
    PLAIN = regex.compile(r"[!-~¡-ÿĀ-įı-ɏ]*")

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.suffix = spec["model"]["end_of_word_suffix"]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # byte-level BPE writes these bytes as themselves,
        rest = iter(range(256, 512))  # and the others as the characters from 256 on
        signs = {b: chr(b) if b in printable else chr(next(rest)) for b in range(256)}
        self.inner = np.array([vocab[signs[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[signs[b] + self.suffix] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_ranks = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.merges = Merges(keys[order], np.arange(len(pairs), dtype=np.int32)[order], np.array([vocab[a + b] for a, b in pairs], np.int32))

    def one(self, ids: list[int]) -> list[int]:
        """A single piece, one merge at a time."""
        while len(ids) > 1:
            best, at = min((self.pair_ranks.get((ids[i], ids[i + 1]), NONE), i) for i in range(len(ids) - 1))
            if best == NONE:
                break
            ids[at : at + 2] = [int(self.merges.ids[best])]
        return ids

    def encode_new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that hold no ASCII white space: flat, and where each word starts."""
        pieces, used, sizes, cut = Interner(), [], [0], self.pattern.findall
        other: dict[int, np.ndarray] = {}
        for i, word in enumerate(words):
            if word.isascii() and word.isalpha():
                used.append(pieces[word.lower()])
                sizes.append(1)
            elif self.PLAIN.fullmatch(word) and not ("<|" in word and any(s in word for s in self.special)):
                found = cut(word.lower())
                used.extend(map(pieces.__getitem__, found))
                sizes.append(len(found))
            else:
                sizes.append(0)
                other[i] = np.array(self.library.encode(word, add_special_tokens=False).ids, np.int32)
        known = list(map(str.encode, pieces))
        data, starts = np.frombuffer(b"".join(known), np.uint8), np.cumsum([0, *map(len, known)])
        flat = self.inner[data]
        if known:
            flat[starts[1:] - 1] = self.last[data[starts[1:] - 1]]
        ids, ends, odd = replay(self.merges, flat, starts)
        ids, ends = with_words(ids, ends, {i: np.array(self.one(flat[starts[i] : starts[i + 1]].tolist()), np.int32) for i in odd.tolist()})
        return with_words(*regroup(ids, ends, np.array(used, np.int64), np.cumsum(sizes)), other)


@functools.lru_cache(maxsize=4)
def rank_coder(path: str, pattern: str) -> RankCoder:
    """One coder for each Python worker."""
    return RankCoder(path, pattern)


@functools.lru_cache(maxsize=4)
def word_coder(path: str) -> WordCoder:
    """One coder for each Python worker."""
    return WordCoder(path)

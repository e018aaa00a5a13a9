"""Lattices of many words at a time, in the tasks of ``unigram``: words of one length are rows of the same arrays, by place of a
piece's end, length of the piece less one, and word.  Each rule is that of the fold of the same purpose in ``unigram``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from versify.operators.bpe import code_points

# Entries of the arrays that are worked on at once.
ENTRIES = 1 << 17
# No piece.
NONE = -1
# Bits of a code point.
POINT = 21


def ramp(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def by_length(words: list[str], max_len: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, codes) of the words of one length at a time, but empty ones: a column of codes for each row."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes, starts = code_points("".join(words)).astype(np.int64), np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        n = int(sizes[rows[0]]) if len(rows) else 0
        step = max(1, ENTRIES // max(1, n * min(n, max_len)))
        for first in range(0, len(rows) if n else 0, step):
            part = rows[first : first + step]
            yield part, codes[starts[part] + np.arange(n)[:, None]]


class Lattices:
    """The pieces of a model as a tree of characters: its nodes are numbered by depth, then by parent and character, from 1 for
    the first below the root, so that the children of a depth are one sorted array.  Past the last piece stands the unknown one."""

    def __init__(self, pieces: list[str], lp: np.ndarray, unknown: float, max_len: int):
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        codes, starts = code_points("".join(pieces)).astype(np.int64), np.cumsum(sizes) - sizes
        node = np.zeros(len(pieces), np.int64)
        self.max_len, self.size, self.keys, self.first = max_len, len(pieces), [], [1]
        for depth in range(min(max_len, int(sizes.max(initial=0)))):
            live = np.flatnonzero(sizes > depth)
            keys, place = np.unique(node[live] << POINT | codes[starts[live] + depth], return_inverse=True)
            node[live] = self.first[-1] + place
            self.keys.append(keys)
            self.first.append(self.first[-1] + len(keys))
        own = np.flatnonzero((sizes > 0) & (sizes <= max_len))
        self.piece = np.full(self.first[-1], NONE, np.int32)
        self.piece[node[own]] = own
        self.lp = np.array([*lp, unknown, -np.inf])

    def edges(self, codes: np.ndarray) -> np.ndarray:
        """The piece that ends at each place with each length; a character without a piece has the unknown one."""
        n, words = codes.shape
        longest = min(n, self.max_len)
        out = np.full((n, longest, words), NONE, np.int32)
        flat, text = out.reshape(-1), codes.reshape(-1)
        at, node = np.arange(n * words), np.zeros(n * words, np.int64)
        for depth, keys in enumerate(self.keys[:longest]):
            inside = at < (n - depth) * words
            end = at[inside] + depth * words
            wanted = node[inside] << POINT | text[end]
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            found = keys[place] == wanted
            end, node = end[found], self.first[depth] + place[found]
            at = end - depth * words
            flat[(end // words * longest + depth) * words + end % words] = self.piece[node]
        out[:, 0][out[:, 0] == NONE] = self.size
        return out


def log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(0)
    return top + np.log(np.exp(x - top).sum(0))


def shares(lp: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """Expected number of each edge in the words, times their frequency: sums over all segmentations up to and from each place."""
    n, longest, words = lp.shape
    before, after = np.zeros((n + 1, words)), np.zeros((n + 1, words))
    for e in range(1, n + 1):
        k = min(longest, e)
        before[e] = log_sum(lp[e - 1, :k] + before[e - k : e][::-1])
    for s in range(n - 1, -1, -1):
        i = np.arange(min(longest, n - s))
        after[s] = log_sum(lp[s + i, i] + after[s + 1 : s + 1 + len(i)])
    out = np.full(lp.shape, -np.inf)
    for e in range(1, n + 1):
        k = min(longest, e)
        out[e - 1, :k] = before[e - k : e][::-1] + lp[e - 1, :k] + after[e] - before[n]
    return freq * np.exp(out)


def best_parts(lattices: Lattices, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score, parts) of the best segmentation of each word: its pieces in order in a row, ``NONE`` before the first.  Ties go to
    the longer last piece."""
    n, longest, words = edges.shape
    lp, each = lattices.lp[edges], np.arange(words)
    score, size = np.zeros((n + 1, words)), np.zeros((n + 1, words), np.int64)
    for e in range(1, n + 1):
        k = min(longest, e)
        reached = score[e - k : e] + lp[e - 1, :k][::-1]
        best = reached.argmax(0)  # the first of equal ones, which stand by falling length
        score[e], size[e] = reached[best, each], k - best
    at, parts = np.full(words, n), []
    while at.any():
        parts.append(np.where(at > 0, edges[at - 1, size[at, each] - 1, each], NONE))
        at = at - size[at, each]
    return score[n], np.array(parts[::-1]).T


def best_of(lattices: Lattices, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, pieces) of the best segmentations of words, one after the other."""
    sizes, held = np.zeros(len(words), np.int64), []
    for rows, codes in by_length(words, lattices.max_len):
        _, parts = best_parts(lattices, lattices.edges(codes))
        sizes[rows] = (parts != NONE).sum(1)
        held.append((rows, parts[parts != NONE]))
    starts, out = np.cumsum(sizes) - sizes, np.empty(sizes.sum(), np.int64)
    for rows, pieces in held:
        out[np.repeat(starts[rows], sizes[rows]) + ramp(sizes[rows])] = pieces
    return sizes, out


# Parts of a path whose choices fit a number of 64 bits, four bits for each: a place has no more than 16 pieces.
DIGITS, DIGIT = 16, 4


class Several:
    """Up to ``top`` best segmentations of each of some words of one length, best first, ties by their ids.  ``odd``: words whose ties
    are of paths too long to be told by a number."""

    def __init__(self, lattices: Lattices, edges: np.ndarray, ids: np.ndarray, top: int):
        n, longest, words = edges.shape
        lp, each, told = lattices.lp[edges], np.arange(words)[:, None], n <= DIGITS and longest <= 1 << DIGIT
        self.edges, self.odd = edges, np.zeros(words, bool)
        held = (n + 1, words, top)  # the best paths up to each place, in no order but up to the last
        self.score, self.size, self.slot = np.full(held, -np.inf), np.zeros(held, np.int16), np.zeros(held, np.int16)
        way, depth = np.zeros(held if told else 0, np.uint64), np.zeros(held if told else 0, np.uint64)
        rank = self.ranks(edges, ids) if told else None
        self.score[0, :, 0], width = 0.0, [1]
        for e in range(1, n + 1):
            found = edges[e - 1, : min(longest, e)] != NONE
            by = np.argsort(~found, axis=0, kind="stable")[: int(found.sum(0).max())].T  # lengths less one, first those that are there
            w = max(width[e - 1 - k] for k in np.flatnonzero(found.any(1)))
            reached = (self.score[:, :, :w][e - 1 - by, each] + lp[e - 1, by, each][:, :, None]).reshape(words, -1)
            kept = reached > -np.inf
            if (over := reached.shape[1] - top) > 0:
                least = np.partition(reached, (over - 1, over), axis=1)[:, over - 1 : over + 1]
                kept &= reached >= least[:, 1:]
                tied = np.flatnonzero((least[:, 0] == least[:, 1]) & (least[:, 1] > -np.inf))
                if len(tied):
                    self.odd[tied] |= not told
                    ways = self.ways(way, depth, rank, e, by[tied], w, tied) if told else reached[tied]
                    kept[tied] = False
                    kept[tied[:, None], np.lexsort((~ways if told else ways, -reached[tied]), axis=1)[:, :top]] = True
            row, at = np.nonzero(kept)
            many = kept.sum(1)
            place, k, slot = ramp(many), by[row, at // w], at % w
            self.score[e, row, place], self.size[e, row, place], self.slot[e, row, place] = reached[row, at], k + 1, slot
            if told:
                before = depth[e - 1 - k, row, slot]
                way[e, row, place] = way[e - 1 - k, row, slot] | rank[e - 1, k, row] << (DIGIT * (DIGITS - 1) - DIGIT * before)
                depth[e, row, place] = before + np.uint64(1)
            width.append(int(many.max()))
        order = np.argsort(-self.score[n], axis=1)
        last = np.take_along_axis(self.score[n], order, 1)
        tied = np.flatnonzero(((last[:, 1:] == last[:, :-1]) & (last[:, 1:] > -np.inf)).any(1))
        if len(tied) and told:
            order[tied] = np.lexsort((~way[n, tied], -self.score[n, tied]), axis=1)
        self.odd[tied] |= not told
        for x in (self.score, self.size, self.slot):
            x[n] = np.take_along_axis(x[n], order, 1)
        self.last = self.score[n]

    @staticmethod
    def ranks(edges: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The rank of each edge by its id among those that start where it does."""
        n, longest, words = edges.shape
        out = np.zeros(edges.shape, np.uint64)
        for s in range(n):
            k = np.arange(min(longest, n - s))
            own = edges[s + k, k]
            held = np.where(own == NONE, np.iinfo(np.int32).max, ids[own])
            out[s + k, k] = (held[:, None] > held).sum(1)
        return out

    @staticmethod
    def ways(way: np.ndarray, depth: np.ndarray, rank: np.ndarray, e: int, by: np.ndarray, w: int, rows: np.ndarray) -> np.ndarray:
        """The choices of the candidates at a place, a row for each of the words."""
        at = (e - 1 - by[:, :, None], rows[:, None, None], np.arange(w))
        held = way[at] | rank[e - 1, by, rows[:, None]][:, :, None] << (DIGIT * (DIGITS - 1) - DIGIT * depth[at])
        return held.reshape(len(rows), -1)

    def paths(self, slot: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The pieces of paths in order in a row, ``NONE`` before the first."""
        at, parts = np.full(len(word), len(self.edges)), []
        while at.any():
            size = self.size[at, word, slot].astype(np.int64)
            parts.append(np.where(at > 0, self.edges[at - 1, size - 1, word], NONE))
            slot, at = self.slot[at, word, slot], at - size
        return np.array(parts[::-1], np.int64).reshape(-1, len(word)).T


# The sines and turns of md5, and the place of the word that a round reads.
SINES = [np.uint32(int(abs(np.sin(np.float64(i + 1))) * 2**32)) for i in range(64)]
TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
PLACES = [(1, 0), (5, 1), (3, 5), (7, 0)]
# Bytes of a message that one block holds; messages digested at once.
BLOCK, DIGESTED = 55, 1 << 14


def md5_starts(messages: np.ndarray) -> np.ndarray:
    """The first 32 bits of the md5 of messages of one block, padded: a row of 64 bytes each.  They are the word that the 61st
    round makes."""
    words = np.ascontiguousarray(messages.view("<u4").T)
    a, b, c, d = (np.full(len(messages), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    used = [bool(x.any()) for x in words]
    for i in range(61):
        kind = i // 16
        if kind == 0:
            f = d ^ (b & (c ^ d))
        elif kind == 1:
            f = c ^ (d & (b ^ c))
        elif kind == 2:
            f = b ^ c ^ d
        else:
            f = c ^ (b | ~d)
        f += a
        f += SINES[i]
        place = (PLACES[kind][0] * i + PLACES[kind][1]) % 16
        if used[place]:
            f += words[place]
        turn = TURNS[kind][i % 4]
        high = f << np.uint32(turn)
        f >>= np.uint32(32 - turn)
        f |= high
        f += b
        a, d, c, b = d, c, b, f
    return (b + np.uint32(0x67452301)).byteswap()


def numbered_starts(starts: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The first 32 bits of the md5 of each start followed by 0, 1, ... up to its size, all that fit one block."""
    out, first = np.empty(int(sizes.sum()), np.uint32), np.frombuffer(b"".join(s.ljust(64, b"\0") for s in starts), np.uint8).reshape(-1, 64)
    own, number = np.repeat(np.arange(len(starts)), sizes), ramp(sizes)
    length = np.fromiter(map(len, starts), np.int64, len(starts))
    for begin in range(0, len(out), DIGESTED):
        doc, left = own[begin : begin + DIGESTED], number[begin : begin + DIGESTED].copy()
        digits = np.ones(len(doc), np.int64)
        for power in range(1, len(str(left.max(initial=0)))):
            digits += left >= 10**power
        each, end = np.arange(len(doc)), length[doc] + digits
        rows = first[doc]
        rows[each, end] = 0x80
        for place in range(int(digits.max(initial=0))):
            here = digits > place
            rows[each[here], end[here] - 1 - place] = 48 + left[here] % 10
            left //= 10
        rows[:, 56], rows[:, 57] = end * 8 & 255, end * 8 >> 8
        out[begin : begin + len(doc)] = md5_starts(rows)
    return out

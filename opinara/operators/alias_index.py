"""All whole-word hits of many aliases in a batch of texts, with numpy.

The aliases form a trie whose edges lie in one sorted array.  A hit begins at a word boundary, so the walk
begins at all boundaries of a slice of texts at once and takes one character per step; what has
no edge falls out.  The cost follows the text and the length of partial matches, not the number of aliases.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from opinara import config

#: Characters that are walked together; a longer text is a slice by itself.
SLICE_CHARS = 1 << 20
COUNTS = "array<struct<subject:string,n:int,first_start:int>>"


class Trie:
    """Distinct words; ``walk`` gives the number of each one found."""

    def __init__(self, words: list[str]):
        alphabet = sorted({ord(c) for w in words for c in w})
        code = {c: i for i, c in enumerate(alphabet)}
        self.size = max(len(alphabet), 1)
        self.code = np.full(max(alphabet, default=0) + 2, -1, np.int32)
        self.code[alphabet] = np.arange(len(alphabet))
        edges: dict[int, int] = {}
        ends: dict[int, int] = {}
        count = 1
        for number, word in enumerate(words):
            state = 0
            for c in word:
                key = state * self.size + code[ord(c)]
                if key not in edges:
                    edges[key] = count
                    count += 1
                state = edges[key]
            ends[state] = number
        self.keys = np.array(sorted(edges), np.int64)
        self.targets = np.array([edges[k] for k in self.keys.tolist()], np.int64)
        self.word = np.full(count, -1, np.int64)
        self.word[list(ends)] = list(ends.values())

    def walk(self, chars: np.ndarray, boundary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and word of every hit between two boundaries, by start and end."""
        starts, ends, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        code = self.code[np.minimum(chars, len(self.code) - 1)]
        start = np.flatnonzero(boundary[:-1])
        start = start[code[start] >= 0]
        state = np.zeros(len(start), np.int64)
        place = start
        while len(start):
            symbol = code[place]
            live = np.flatnonzero(symbol >= 0)
            key = state[live] * self.size + symbol[live]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[edge] == key
            live, state = live[hit], self.targets[edge[hit]]
            start, place = start[live], place[live] + 1
            done = (self.word[state] >= 0) & boundary[place]
            starts.append(start[done])
            ends.append(place[done])
            found.append(self.word[state[done]])
            inside = place < len(chars)
            start, place, state = start[inside], place[inside], state[inside]
        start, end, word = np.concatenate(starts), np.concatenate(ends), np.concatenate(found)
        by = np.lexsort((end, start))
        return start[by], end[by], word[by]


class AliasIndex:
    """Counts the mentions of subjects.  ``rows``: subject, alias, and whether it is ambiguous.

    A subject's longer aliases come first, then by alphabet.  Hits of one alias do not overlap; a hit that starts
    inside an accepted one does not count; an ambiguous alias needs a cue nearby if ``strict``.
    """

    def __init__(self, rows: list[tuple[str, str, bool]], strict: bool, cues: tuple[str, ...]):
        rows = sorted({(s, a, bool(m)) for s, a, m in rows if a}, key=lambda r: (r[0], -len(r[1]), r[1]))
        words = sorted({a for _, a, _ in rows})
        number = {a: i for i, a in enumerate(words)}
        self.subjects = sorted({s for s, _, _ in rows})
        place = {s: i for i, s in enumerate(self.subjects)}
        order = sorted(range(len(rows)), key=lambda i: number[rows[i][1]])
        # rows of word w: those from first[w] up to first[w + 1]
        self.row_subject = np.array([place[rows[i][0]] for i in order], np.int64)
        self.row_rank = np.array(order, np.int64)
        self.row_ambiguous = np.array([rows[i][2] and strict for i in order], bool)
        self.first = np.searchsorted(np.array([number[rows[i][1]] for i in order], np.int64), np.arange(len(words) + 1))
        self.trie = Trie(words)
        self.cues = Trie(sorted(set(cues))) if strict and self.row_ambiguous.any() and cues else None
        self.longest_cue = max(map(len, cues), default=0)
        said = "|".join(map(re.escape, sorted(set(cues), key=len, reverse=True)))
        self.at_head, self.at_tail = re.compile(rf"\b(?:{said})\b"), re.compile(rf"\b(?:{said})\b\Z")
        self.is_word = np.array([chr(c).isalnum() for c in range(0x110000)])
        self.is_word[ord("_")] = True

    def _boundaries(self, chars: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Places 0 to n where a word character meets another one, or an end of a text."""
        word = self.is_word[chars]
        before, after = np.concatenate([[False], word]), np.concatenate([word, [False]])
        out = before != after
        ends = bounds[1:-1]
        out[ends] = before[ends] | after[ends]
        return out

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, subject, mentions and first start of all pairs with mentions, by text and subject."""
        joined = "".join(texts)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        boundary = self._boundaries(chars, bounds)
        start, end, word = self.trie.walk(chars, boundary)
        text = np.searchsorted(bounds, start, "right") - 1
        # empty texts share a place with the next one; a hit may not leave its text
        inside = end <= bounds[text + 1]
        start, end, word, text = start[inside], end[inside], word[inside], text[inside]
        start, end, word, text = self._apart(start, end, word, text)
        size = self.first[word + 1] - self.first[word]
        hit = np.repeat(np.arange(len(word)), size)
        total = np.cumsum(size)
        row = np.arange(total[-1] if len(total) else 0) - np.repeat(total - size, size) + np.repeat(self.first[word], size)
        if self.row_ambiguous.any():
            asked = np.flatnonzero(self.row_ambiguous[row])
            good = np.ones(len(row), bool)
            good[asked] = self._near_cue(joined, chars, boundary, bounds, start[hit[asked]], text[hit[asked]])
            hit, row = hit[good], row[good]
        start, end, text = start[hit], end[hit], text[hit]
        subject, rank = self.row_subject[row], self.row_rank[row]
        by = np.lexsort((end, start, subject, text))
        start, end, text, subject, rank = start[by], end[by], text[by], subject[by], rank[by]
        counted = self._accepted(start, end, text, subject, rank)
        start, text, subject = start[counted], text[counted], subject[counted]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (subject[1:] != subject[:-1])
        heads = np.flatnonzero(new)
        return text[heads], subject[heads], np.diff(np.append(heads, len(text))), start[heads] - bounds[text[heads]]

    @staticmethod
    def _apart(start, end, word, text):
        """Hits of one alias that do not overlap, from the left."""
        by = np.lexsort((start, word))
        s, e, w = start[by], end[by], word[by]
        clash = np.flatnonzero((w[1:] == w[:-1]) & (s[1:] < e[:-1])) + 1
        keep = np.ones(len(s), bool)
        last = -1
        for i in clash.tolist():
            if i <= last:
                continue
            until, j = e[i - 1], i
            while j < len(s) and w[j] == w[i] and s[j] < e[j - 1]:
                keep[j] = s[j] >= until
                until = e[j] if keep[j] else until
                j += 1
            last = j - 1
        by = np.sort(by[keep])
        return start[by], end[by], word[by], text[by]

    def _near_cue(self, joined: str, chars, boundary, bounds, start, text) -> np.ndarray:
        """Is there a cue, as a whole word of the surroundings, around each hit?"""
        if self.cues is None or not len(start):
            return np.zeros(len(start), bool)
        left = np.maximum(bounds[text], start - config.CUE_WINDOW_CHARS)
        right = np.minimum(bounds[text + 1], start + config.CUE_WINDOW_CHARS)
        cue_start, cue_end, _ = self.cues.walk(chars, boundary)
        least = np.append(np.minimum.accumulate(cue_end[::-1])[::-1], np.iinfo(np.int64).max)
        good = least[np.searchsorted(cue_start, left)] <= right
        for i in np.flatnonzero(~good).tolist():  # the edge of the surroundings may cut a longer word down to a cue
            near = joined[int(left[i]):int(right[i])]
            tail = near[-self.longest_cue - 1:]
            good[i] = bool(self.at_head.match(near) or self.at_tail.search(tail) and self.at_tail.search(near))
        return good

    @staticmethod
    def _accepted(start, end, text, subject, rank) -> np.ndarray:
        """Which hits count; only groups in which hits overlap have to be looked at."""
        n = len(start)
        keep = np.ones(n, bool)
        if not n:
            return keep
        group = np.cumsum(np.concatenate([[True], (text[1:] != text[:-1]) | (subject[1:] != subject[:-1])]))
        clash = np.unique(group[1:][(group[1:] == group[:-1]) & (start[1:] < end[:-1])])
        # by start, a hit that overlaps a later one overlaps the next one too
        lo, hi = np.searchsorted(group, clash), np.searchsorted(group, clash, "right")
        for a, b in zip(lo.tolist(), hi.tolist()):
            # alias by alias: accepted spans by start, with the farthest end so far
            taken, ends, reach = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            for r in np.unique(rank[a:b]):
                mine = np.flatnonzero(rank[a:b] == r) + a
                if len(taken):
                    before = np.searchsorted(taken, start[mine], "right") - 1
                    covered = (before >= 0) & (reach[before] > start[mine])
                    keep[mine[covered]] = False
                    mine = mine[~covered]
                taken, ends = np.concatenate([taken, start[mine]]), np.concatenate([ends, end[mine]])
                by = np.argsort(taken, kind="stable")
                taken, ends = taken[by], ends[by]
                reach = np.maximum.accumulate(ends)
        return keep

    def arrays(self, column: pa.Array) -> pa.Array:
        """``count`` of a string column, as an array of structs per row."""
        sizes, subjects, numbers, firsts = [], [], [], []
        names = np.array(self.subjects, object)
        for texts in _slices(column):
            text, subject, n, first = self.count(texts)
            sizes.append(np.bincount(text, minlength=len(texts)))
            subjects.append(subject)
            numbers.append(n)
            firsts.append(first)
        flat = np.concatenate(subjects) if subjects else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1)
        values = pa.StructArray.from_arrays(
            [pa.array(names[flat] if len(flat) else [], pa.string()), pa.array(np.concatenate(numbers) if numbers else [], pa.int32()),
             pa.array(np.concatenate(firsts) if firsts else [], pa.int32())], ["subject", "n", "first_start"])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def _slices(column: pa.Array) -> Iterator[list[str]]:
    texts, size = [], 0
    for value in column:
        text = value.as_py() or ""
        if texts and size + len(text) > SLICE_CHARS:
            yield texts
            texts, size = [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield texts

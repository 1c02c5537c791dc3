"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The distinct words of a batch are encoded together: one flat array of symbols, in every round
the best pair of each word merged at once, then compaction, until no pair is in the
vocabulary.  A word is a run of blanks with what follows it; no piece crosses from other
characters to a blank, so words merge independently.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import text_slices

#: Words whose ids a worker remembers; beyond that it starts anew (about 100 MB).
REMEMBERED = 400_000
BLANK = "▁"
_NONE = np.int64(2**62)


class Vocabulary:
    """Pieces of a SentencePiece BPE model with byte fallback and the identity normaliser."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.end = model.eos_id()
        special = {i for i in range(n) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(n):
            if model.is_byte(i):
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        score = np.array([model.get_score(i) for i in range(n)], np.float64)
        # equal scores share a rank: of those the leftmost pair merges first
        ranks = np.searchsorted(np.unique(-score), -score).astype(np.int64)
        self.char_ids = {p: i for p, i in ids.items() if len(p) == 1}
        # symbols: pieces keep their id, other characters get n + code point
        self.n = n
        pairs, unsafe = {}, set()
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                a, b = piece[:k], piece[k:]
                left = ids.get(a, n + ord(a) if len(a) == 1 else None)
                right = ids.get(b, n + ord(b) if len(b) == 1 else None)
                if left is not None and right is not None:
                    pairs[(left << 32) | right] = i
                for part in (a, b):
                    j = ids.get(part)
                    if j is not None and len(part) > 1 and ranks[i] <= ranks[j]:
                        unsafe.add(j)
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys = keys
        self.pair_ids = np.array([pairs[int(k)] for k in keys], np.int64)
        self.rank = ranks
        #: A merge into such a piece can open a pair of a better rank: then only the leftmost one is made.
        self.unsafe = np.zeros(n, bool)
        self.unsafe[list(unsafe)] = True
        shared = np.bincount(ranks)[ranks] > 1
        self.unsafe |= shared
        text = [b"" if i in special else p.replace(BLANK, " ").encode() for i, p in enumerate(self.pieces)]
        text[model.unk_id()] = " ⁇ ".encode()
        for value, i in enumerate(self.byte_ids):
            text[i] = bytes([value])
        self.is_byte = np.zeros(n, bool)
        self.is_byte[self.byte_ids] = True
        self.sizes = np.array([len(t) for t in text], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(text), np.uint8)
        self.leads = np.array([p[:1] == BLANK for p in self.pieces])
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.ids, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of each pair's piece, or -1."""
        keys = (left << np.int64(32)) | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ids[at], -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words, and each word's number of ids."""
        joined = b"".join(words)
        points = np.frombuffer(joined.decode().replace(" ", BLANK).encode("utf-32-le"), np.uint32).astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        chars = np.concatenate([[0], np.cumsum((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80)])
        size = np.diff(np.concatenate([[0], chars[ends]]))
        table, inverse = np.unique(points, return_inverse=True)
        known = np.array([self.char_ids.get(chr(c), self.n + int(c)) for c in table], np.int64)
        symbol = known[inverse] if len(table) else points
        word = np.repeat(np.arange(len(words)), size)
        done_symbol, done_word = [], []
        pair = self._pairs(symbol, word)
        while len(symbol):
            rank = np.where(pair >= 0, self.rank[pair], _NONE)
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            length = np.diff(np.append(head, len(word)))
            best = np.minimum.reduceat(rank, head)
            active = np.repeat(best < _NONE, length)
            if not active.all():
                done_symbol.append(symbol[~active])
                done_word.append(word[~active])
                symbol, word, pair, rank = symbol[active], word[active], pair[active], rank[active]
                head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else head[:0]
                length = np.diff(np.append(head, len(word)))
                best = best[best < _NONE]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, length))
            first = np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])
            # a run of overlapping pairs (aaa) merges its first, third, ...; unsafe pieces only at the leftmost
            run = np.flatnonzero(np.concatenate([[True], hit[1:] != hit[:-1] + 1]))
            place = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            hit = hit[np.where(self.unsafe[pair[hit]], first, place % 2 == 0)]
            symbol[hit] = pair[hit]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            symbol, word, pair = symbol[keep], word[keep], pair[keep]
            at = place[hit]
            touched = np.zeros(len(symbol), bool)
            touched[at] = touched[np.maximum(at - 1, 0)] = True
            near = np.flatnonzero(touched)
            pair[near] = self._pairs(symbol, word, near)
        if done_symbol:
            symbol, word = np.concatenate(done_symbol), np.concatenate(done_word)
            by = np.argsort(word, kind="stable")
            symbol, word = symbol[by], word[by]
        return self._with_bytes(symbol, word, len(words))

    def _pairs(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Piece of each symbol with its right neighbour in the same word, or -1."""
        at = np.arange(len(symbol)) if at is None else at
        right = np.minimum(at + 1, len(symbol) - 1)
        inside = (at + 1 < len(symbol)) & (word[at] == word[right])
        out = np.full(len(at), -1, np.int64)
        out[inside] = self.merged(symbol[at[inside]], symbol[right[inside]])
        return out

    def _with_bytes(self, symbol: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the ids of their UTF-8 bytes."""
        lost = symbol >= self.n
        if lost.any():
            spelled = {int(s): self.byte_ids[list(chr(int(s) - self.n).encode())] for s in np.unique(symbol[lost])}
            size = np.ones(len(symbol), np.int64)
            size[lost] = [len(spelled[int(s)]) for s in symbol[lost]]
            out = np.repeat(symbol, size)
            word = np.repeat(word, size)
            out[np.repeat(lost, size)] = np.concatenate([spelled[int(s)] for s in symbol[lost]])
            symbol = out
        return symbol, np.bincount(word, minlength=n_words)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts between ``bounds`` of UTF-8 bytes, each with the end id, and their counts.

        An empty text is the end id alone.
        """
        full = np.diff(bounds) > 0
        data = np.insert(data, bounds[:-1][full], 32)
        bounds = bounds + np.concatenate([[0], np.cumsum(full)])
        start = data == 32
        start[1:] &= data[:-1] != 32
        start[bounds[:-1][full]] = True
        starts = np.flatnonzero(start)
        offsets = np.append(starts, len(data)).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        words = words.dictionary_encode()
        places = self._slots_of(words.dictionary.to_pylist())[words.indices.to_numpy()] if len(starts) else starts
        at = np.cumsum(self.size) - self.size
        size = self.size[places]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.repeat(at[places] - total[:-1], size) + np.arange(total[-1])]
        ends = total[np.searchsorted(starts, bounds)]
        return np.insert(flat, ends[1:], self.end), np.diff(ends) + 1

    def _slots_of(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the words among the remembered ones; unknown words are encoded together."""
        if len(self.slots) > REMEMBERED:
            self._forget()
        new = [w for w in words if w not in self.slots]
        if new:
            ids, size = self.encode_words(new)
            self.slots.update(zip(new, range(len(self.size), len(self.size) + len(new))))
            self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])
        return np.array([self.slots[w] for w in words], np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of id sequences: control ids vanish, bytes are joined as UTF-8, one leading blank goes."""
        size = self.sizes[ids]
        at = np.cumsum(size) - size
        spelled = self.bytes[np.repeat(self.starts[ids] - at, size) + np.arange(size.sum())].tobytes()
        ends = np.cumsum(counts)
        bounds = np.append(at, len(spelled))
        out = []
        for start, end in zip(ends - counts, ends):
            part = spelled[bounds[start]:bounds[end]]
            said = ids[start:end][size[start:end] > 0]
            if len(said) and self.leads[said[0]]:
                part = part[1:]
            try:
                out.append(part.decode())
            except UnicodeDecodeError:
                out.append(self._decode_broken(ids[start:end]))
        return out

    def _decode_broken(self, ids: np.ndarray) -> str:
        """Byte ids that form no character give a replacement character each."""
        out, pending = [], bytearray()

        def flush() -> None:
            while pending:
                for n in range(min(4, len(pending)), 0, -1):
                    try:
                        out.append(bytes(pending[:n]).decode())
                        break
                    except UnicodeDecodeError:
                        if n == 1:
                            out.append("�")
                del pending[:n]
        for i in ids:
            spelled = self.bytes[self.starts[i]:self.starts[i] + self.sizes[i]].tobytes()
            if self.is_byte[i]:
                pending += spelled
            else:
                flush()
                out.append(spelled.decode())
        flush()
        said = ids[self.sizes[ids] > 0]
        return "".join(out)[int(self.leads[said[0]]):]


_loaded: dict[str, Vocabulary] = {}


def _vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``(doc_id, ids)``: the ids of each whole text (null: empty) with the end id, one row per row.

    ``model`` is the vocabulary file, the same path on every executor.  Other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(model)
        for batch in batches:
            texts = pc.replace_substring(batch.column(1), BLANK, " ")  # the model writes a blank as that character
            for i, j, data, bounds in text_slices(texts):
                ids, counts = vocabulary.encode(data, bounds)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))],
                    ["doc_id", "ids"])
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded(doc_id, ids)`` with the ``text`` that the ids stand for (null ids: empty)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(model)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                ids = part.column(1)
                counts = np.array([len(x) if x.is_valid else 0 for x in ids], np.int64)
                flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                texts = vocabulary.decode(flat, counts)
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")

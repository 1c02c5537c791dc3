"""Line dedup by an exact set-similarity join: rarity order, prefix, length, position and bitmap filters.

A line is the set of its words (runs without ASCII white space).  A line goes when an earlier
line, by (doc_id, line number), has a Jaccard similarity of 0.8 or more with it; whether that
earlier line itself stays does not matter, so every line can be decided by itself.  Three scans:

1. word frequencies, in a table of fixed size (words share ``2**FREQUENCY_BITS`` counters);
2. per line its set key and, for the rarest words that a match must share, a posting with set
   size, position and a parity bitmap of 64 to 1,024 bits by size, packed into blobs by cell of
   the word (two sets differ in at least as many words as their bitmaps differ in bits);
3. the texts of candidate lines, on which the similarity is verified.

Equal sets collapse per task and then per key, so a line in a third of all documents costs a
row per task; its repeats within a batch are spread over the tasks.  A line with many possible
matches names ``FIRST`` of them per word and is not compared further; only if all of those fail
are its other candidates looked up, without a limit.  Under a word where it had no more than that
it has met all of them, so the second lookup only sends the postings of words that left a line open.

A word in the prefixes of many sets (estimated on a sample, which only shapes the work) is dealt
to blocks of about ``BLOCK`` sets.  A line first meets the sets of its own block; a line without
a confirmed match there is open, and in the second lookup it meets the sets of all blocks, both
sides in blocks, so that no task gets the whole list of a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOBS, blobs, hash_words, keep_keys, mix, saved, shuffle_partitions, summed, text_slices, with_text

FREQUENCY_BITS = 18
LOW_BITS = 26
#: Cells per shuffle partition, at least; a word or set key falls into one by its top bits.
CELLS_PER_PARTITION = 4
FIRST = 2
#: Sets under one word that a task takes as one side; about so many, as they are dealt by hash.
BLOCK = 1 << 15
#: Lines that go for an equal one of their own batch, sent at once.
GONE_ROWS = 4096
#: Words on whose lines the sets per word are estimated, about.
SAMPLED = 1 << 23
#: Pairs of postings that a task compares at once.
COMPARED = 1 << 16
#: Bits of the filter that a second lookup uses to pick out its lines; a fixed 1 MB.
FILTER_BITS = 1 << 23
FREQUENCY_CHUNK = 4096
WHITE = "[\\x09-\\x0D\\x20]+"

LINE = np.dtype([("key", "u8"), ("other", "u4"), ("doc", "i8"), ("line", "u4")])
_FIELDS = [("word", "u4"), ("set", "u4"), ("doc", "i8"), ("line", "u4"), ("size", "u4"), ("at", "u2")]
#: Words of 64 bits in the bitmap of a set, by class, and the largest size of the lower classes.
BITMAP_WORDS, CLASS_SIZES = (1, 4, 16), (96, 384)
POSTING = tuple(np.dtype([*_FIELDS, ("bits", "u8", (w,))]) for w in BITMAP_WORDS)
CLASSES = len(POSTING)
#: Postings of class c are of kind POSTINGS + c; MARKED + c has those of dealt words or, in the second lookup, the probes.
EQUAL, GONE, OPEN, POSTINGS, MARKED = 0, 1, 2, 3, 3 + CLASSES

Batches = Iterator[pa.RecordBatch]


def word_frequencies(docs: DataFrame) -> np.ndarray:
    """Occurrences of all words of all documents, by the top bits of the word hash."""
    def count(batches: Batches) -> Batches:
        total = np.zeros(2**FREQUENCY_BITS, np.int64)
        for batch in batches:
            for _, _, data, bounds in text_slices(batch.column(0)):
                words, _, _ = hash_words(data, bounds)
                total += np.bincount((words >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64), minlength=len(total))
        yield blobs(total, FREQUENCY_CHUNK)

    parts = docs.select("text").mapInArrow(count, BLOBS)
    return summed(parts, 2**FREQUENCY_BITS, FREQUENCY_CHUNK, "int64")


def _rarity(counts: np.ndarray) -> np.ndarray:
    """Place of each counter when the rarest comes first."""
    place = np.empty(len(counts), np.uint64)
    place[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.uint64)
    return place


def _mixed(order: np.ndarray) -> np.ndarray:
    return mix(order + np.uint64(0x9E3779B97F4A7C15))


def _line_sets(data: np.ndarray, bounds: np.ndarray, place: np.ndarray, percent: int, wanted=None):
    """Row, line number, size, hashes and bitmap of every line with words; line, position, word and counter of its postings.

    ``wanted`` is a function of words and counters: lines without any word that it wants are left out.
    """
    words, starts, _ = hash_words(data, bounds)
    newlines = np.flatnonzero(data == 10)
    row = np.searchsorted(bounds, starts, "right") - 1
    before = np.searchsorted(newlines, starts)
    new = np.ones(len(words), bool)
    new[1:] = (row[1:] != row[:-1]) | (before[1:] != before[:-1])
    order = (place[words >> np.uint64(64 - FREQUENCY_BITS)] << np.uint64(LOW_BITS)) | (words & np.uint64(2**LOW_BITS - 1))
    if wanted is not None:
        line = np.cumsum(new) - 1
        has = np.zeros(line[-1] + 1, bool)
        has[line[wanted(_mixed(order), (order >> np.uint64(LOW_BITS)).astype(np.int64))]] = True
        whole = has[line]
        row, before, order, new = row[whole], before[whole], order[whole], new[whole]
    first = np.flatnonzero(new)
    row_of, line_of = row[first], before[first] - np.searchsorted(newlines, bounds[row[first]])
    dense = np.cumsum(new) - 1
    mask, shift = np.uint64(2**(FREQUENCY_BITS + LOW_BITS) - 1), np.uint64(FREQUENCY_BITS + LOW_BITS)
    step = 2**(64 - FREQUENCY_BITS - LOW_BITS)
    lines, sets = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for low in range(0, len(first), step):  # as many lines as fit above the word's order
        a, b = first[low], first[low + step] if low + step < len(first) else len(order)
        both = np.sort(((dense[a:b] - low).astype(np.uint64) << shift) | order[a:b])
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
        lines.append((both >> shift).astype(np.int64) + low)
        sets.append(both & mask)
    line, word = np.concatenate(lines), np.concatenate(sets)
    head = np.flatnonzero(np.diff(line, prepend=-1))
    size = np.diff(np.append(head, len(line)))
    mixed = _mixed(word)
    key = np.add.reduceat(mixed, head) if len(head) else mixed
    other = (np.add.reduceat(mix(mixed ^ np.uint64(0xD6E8FEB86659FD93)), head) if len(head) else mixed).astype(np.uint32)
    slot = (mixed >> np.uint64(54)).astype(np.int64)
    bits = np.zeros((len(size), BITMAP_WORDS[-1]), np.uint64)
    group = np.searchsorted(CLASS_SIZES, size)
    for c, count in enumerate(BITMAP_WORDS):
        mine = np.flatnonzero(group == c)
        if not len(mine):
            continue
        member = group[line] == c
        one, place = np.uint64(1) << (slot[member] & 63).astype(np.uint64), (slot[member] >> 6) % count
        at = np.cumsum(size[mine]) - size[mine]
        for w in range(count):
            bits[mine, w] = np.bitwise_xor.reduceat(np.where(place == w, one, np.uint64(0)), at)
    prefix = size - (percent * size + 99) // 100 + 1
    prefix[100 * size < percent * (size + 1)] = 0  # only an equal set can match
    at = np.arange(len(line)) - head[line]
    chosen = np.flatnonzero(at < prefix[line])
    counter = (word[chosen] >> np.uint64(LOW_BITS)).astype(np.int64)
    return row_of, line_of, size, key, other, bits, line[chosen], at[chosen], mixed[chosen], counter


def _blocks_of_words(docs: DataFrame, counts: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """Blocks to deal the sets under a word to, by the place of its counter.

    From the distinct sets of a sample of documents: a wrong estimate makes blocks smaller or larger.
    """
    every = max(1, int(counts.sum()) // SAMPLED)

    def postings(batches: Batches) -> Batches:
        for batch in batches:
            for _, _, data, bounds in text_slices(batch.column(0)):
                if not _wordless(data):
                    *_, key, _, _, line, _, _, counter = _line_sets(data, bounds, place, percent)
                    yield pa.RecordBatch.from_arrays([pa.array(counter.astype(np.int32)), pa.array(key[line].view(np.int64))],
                                                     ["counter", "key"])

    sample = docs.where(F.expr(f"pmod(xxhash64(doc_id), {every}) = 0")).select("text")
    large = (sample.mapInArrow(postings, "counter int, key long").distinct().groupBy("counter").count()
             .where(F.col("count") * every > BLOCK))
    blocks = np.ones(2**FREQUENCY_BITS, np.int32)
    for counter, n in large.collect():
        blocks[counter] = -(-n * every // BLOCK)
    return blocks


def _blobs(kind: int, cells: np.ndarray, records: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    by = np.argsort(cells, kind="stable")
    cells, records = cells[by], records[by]
    edges = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1], [True]]))
    for a, b in zip(edges[:-1], edges[1:]):
        yield kind, int(cells[a]), records[a:b].tobytes()


def _copies(word: np.ndarray, sets: np.ndarray, blocks: np.ndarray, probes: np.ndarray | None, wanted: np.ndarray | None):
    """Which postings to send under which word and whether marked, a copy of each at a time.

    In the first lookup a set goes to its own block.  In the second targets go to their block once
    per block of probes, and ``wanted`` sets as probes once per block of targets.
    """
    def under(which: np.ndarray, i: np.ndarray | int, j: np.ndarray | int) -> np.ndarray:
        pair = (np.zeros(len(which), np.int64) + i << 32) + j + 1
        return np.where(blocks[which] > 1, mix(word[which] ^ mix(pair.astype(np.uint64))), word[which])

    j = sets.astype(np.int64) % blocks
    if wanted is None:
        every = np.arange(len(word))
        own = under(every, 0, j)
        for marked in (False, True):
            which = np.flatnonzero((blocks > 1) == marked)
            yield which, own[which], marked
        return
    for i in range(int(probes.max(initial=0))):
        which = np.flatnonzero(probes > i)
        yield which, under(which, i, j[which]), False
    wanted = np.flatnonzero(wanted)
    i = mix(sets[wanted].astype(np.uint64)).astype(np.int64) % probes[wanted]
    for k in range(int(blocks[wanted].max(initial=0))):
        more = blocks[wanted] > k
        yield wanted[more], under(wanted[more], i[more], k), True


def _extract(place: np.ndarray, percent: int, cell_bits: int, blocks: np.ndarray,
             only: tuple[np.ndarray, np.ndarray] | None, probe_blocks: int):
    """Blobs of a batch of texts.  ``only`` has the filters of a second lookup, of its lines and of their words."""
    top = np.uint64(64 - cell_bits)

    def sought(word: np.ndarray, counter: np.ndarray) -> np.ndarray:
        return (blocks[counter] > 1) | _marked(only[1], word.astype(np.uint32), np.zeros(1, np.int64))

    def batch_of(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        kinds, cells, blobs = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(cells, pa.int32()),
                                           pa.array(blobs, pa.binary())], ["kind", "cell", "blob"])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            found, posted = [], [[] for _ in POSTING]
            for i, _, data, bounds in text_slices(batch.column(1)):
                if _wordless(data):
                    continue
                row, line_no, size, key, other, bits, line, at, word, counter = _line_sets(
                    data, bounds, place, percent, None if only is None else sought)
                if only is not None:
                    mine = np.flatnonzero(sought(word, counter))
                    line, at, word, counter = line[mine], at[mine], word[mine], counter[mine]
                records = np.empty(len(key), LINE)
                records["key"], records["other"] = key, other
                records["doc"], records["line"] = ids[i + row], line_no
                base = sum(map(len, found))
                found.append(records)
                for c, count in enumerate(BITMAP_WORDS):
                    mine = np.flatnonzero(np.searchsorted(CLASS_SIZES, size[line]) == c)
                    of = line[mine]
                    posting = np.empty(len(mine), POSTING[c])
                    posting["set"], posting["bits"] = other[of], bits[of, :count]
                    posting["doc"], posting["line"] = records["doc"][of], records["line"][of]
                    posting["size"], posting["at"] = size[of], np.minimum(at[mine], 65535)
                    posted[c].append((of + base, word[mine], blocks[counter[mine]], posting))
            if not found:
                continue
            lines = np.concatenate(found)
            by = np.lexsort((lines["line"], lines["doc"], lines["other"], lines["key"]))
            ordered = lines[by]
            repeat = np.zeros(len(by), bool)
            repeat[1:] = (ordered["key"][1:] == ordered["key"][:-1]) & (ordered["other"][1:] == ordered["other"][:-1])
            earliest = np.ones(len(by), bool)
            earliest[by[repeat]] = False
            gone = ordered[repeat & ~_twins(ordered)] if only is None else ordered[:0]
            out = [] if only is not None else list(_blobs(EQUAL, (ordered["key"] >> top).astype(np.int64)[~repeat], ordered[~repeat]))
            if len(gone):
                # need no meeting: pieces of bounded size, each where its first line leads
                piece = np.arange(len(gone)) // GONE_ROWS
                to = mix(gone["doc"][::GONE_ROWS].astype(np.uint64) + mix(gone["line"][::GONE_ROWS].astype(np.uint64)))
                out += _blobs(GONE, (to >> top).astype(np.int64)[piece], gone)
            if out:
                yield batch_of(out)
            for c, parts in enumerate(posted):
                owner, word, dealt, posting = (np.concatenate(x) for x in zip(*parts))
                mine = earliest[owner]
                word, dealt, posting = word[mine], dealt[mine], posting[mine]
                wanted = None if only is None else _marked(only[0], posting["doc"], posting["line"])
                for which, under, marked in _copies(word, posting["set"], dealt, np.minimum(dealt, probe_blocks), wanted):
                    if len(which):
                        copy = posting[which]
                        copy["word"] = under.astype(np.uint32)
                        yield batch_of(list(_blobs((MARKED if marked else POSTINGS) + c, (under >> top).astype(np.int64), copy)))
    return run


def _wordless(data: np.ndarray) -> bool:
    return not len(data) or not ((data > 32) | (data < 9) | ((data > 13) & (data < 32))).any()


def _twins(lines: np.ndarray) -> np.ndarray:
    """Of sorted lines those at the very place of the one before: a row came twice."""
    twin = np.zeros(len(lines), bool)
    twin[1:] = (lines[1:] == lines[:-1])
    return twin


def _later_equals(lines: np.ndarray) -> np.ndarray:
    """Lines that have an equal set before them."""
    lines = lines[np.lexsort((lines["line"], lines["doc"], lines["other"], lines["key"]))]
    same = (lines["key"][1:] == lines["key"][:-1]) & (lines["other"][1:] == lines["other"][:-1])
    return lines[1:][same & ~_twins(lines)[1:]]


def _position(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Bit of a line in the filter of a second lookup."""
    return mix(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + line.astype(np.uint64)) % np.uint64(FILTER_BITS)


def _marked(filter_bits: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Whether the filter of a second lookup has the bits of these lines."""
    at = _position(doc, line).astype(np.int64)
    return (filter_bits[at >> 3] >> (at & 7).astype(np.uint8) & 1) > 0


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps of more words xored down to ``width`` words: what they tell of fewer, wider slots."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), bits.shape[1] // width, width), axis=1)


def _candidates(parts: list[list[np.ndarray]], percent: int, first: int | None):
    """Pairs (later, earlier) of lines that the filters let pass, some at a time; and lines that have more of them.

    ``parts`` has the postings by kind.  With ``first`` every posting is compared until it has more
    than so many candidates; without it the marked postings are compared with all others.
    """
    each = [np.concatenate(p) if p else np.zeros(0, t) for p, t in zip(parts, POSTING * 2)]
    posts = {n: np.concatenate([e[n] for e in each]) for n, _ in _FIELDS}
    near = np.concatenate([_folded(e["bits"], 1)[:, 0] for e in each])
    kind = np.repeat(np.arange(len(each)), [len(e) for e in each])
    place = np.concatenate([np.arange(len(e)) for e in each])
    by = np.argsort(posts["word"])
    word = posts["word"][by]
    alone = np.ones(len(word), bool)
    same = word[1:] == word[:-1]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    by = by[~alone]
    by = by[np.lexsort([*(posts[n][by] for n in ("line", "doc", "set", "size")), kind[by] >= CLASSES, posts["word"][by]])]
    fresh = np.ones(len(by), bool)  # equal sets under one word: the earliest stands for all
    fresh[1:] = (near[by[1:]] != near[by[:-1]]) | (kind[by[1:]] != kind[by[:-1]])
    for n in ("word", "size", "set"):
        fresh[1:] |= posts[n][by[1:]] != posts[n][by[:-1]]
    by = by[fresh]
    posts, kind, place = {n: v[by] for n, v in posts.items()}, kind[by], place[by]
    group = kind % CLASSES
    bits, slots = [near[by][:, None]], [np.arange(len(by))]
    for c in range(1, CLASSES):  # wider bitmaps only of the sets that have them
        rows = np.flatnonzero(group >= c)
        wide = np.empty((len(rows), BITMAP_WORDS[c]), np.uint64)
        for k in range(len(each)):
            if k % CLASSES >= c:
                mine = kind[rows] == k
                wide[mine] = _folded(each[k]["bits"][place[rows[mine]]], BITMAP_WORDS[c])
        slot = np.zeros(len(by), np.int64)
        slot[rows] = np.arange(len(rows))
        bits.append(wide)
        slots.append(slot)
    del each, near
    word, size, at, doc = (posts[n].astype(t) for n, t in (("word", np.uint64), ("size", np.int64), ("at", np.int64), ("doc", np.int64)))
    line = posts["line"].astype(np.int64)
    n = len(by)
    rank, by = np.empty(n, np.int64), np.lexsort((line, doc))
    rank[by] = np.cumsum(np.concatenate([[False], (doc[by[1:]] != doc[by[:-1]]) | (line[by[1:]] != line[by[:-1]])])[:n])
    target = np.arange(n) if first is not None else np.flatnonzero(kind < CLASSES)
    probe = np.arange(n) if first is not None else np.flatnonzero(kind >= CLASSES)
    if not len(target) or not len(probe):
        return
    target = target[np.lexsort((rank[target], size[target], word[target]))]
    runs = (word[target] << np.uint64(32)) | size[target].astype(np.uint64)  # the sets of one size under a word
    new = np.concatenate([[True], runs[1:] != runs[:-1]])
    head, spot = np.flatnonzero(new), (np.cumsum(new) - 1) * n + rank[target]
    runs = runs[head]
    least = np.searchsorted(runs, (word[probe] << np.uint64(32)) | ((percent * size[probe] + 99) // 100).astype(np.uint64))
    own = np.searchsorted(runs, (word[probe] << np.uint64(32)) | size[probe].astype(np.uint64))
    end = np.searchsorted(runs, (word[probe] << np.uint64(32)) | (100 * size[probe] // percent).astype(np.uint64), "right")
    seen, more = np.zeros(n, np.int64), np.zeros(n, bool)

    def passing(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left = np.minimum(size[a] - at[a], size[b] - at[b])
        ok = (100 + percent) * left >= percent * (size[a] + size[b])
        ok[at[a] >= 65535] = True
        a, b = a[ok], b[ok]
        for c, (words, slot) in enumerate(zip(bits, slots)):
            most = (100 - percent) * (size[a] + size[b]) // (100 + percent)
            wide = np.minimum(group[a], group[b]) >= c
            ok = ~wide
            ok[wide] = np.bitwise_count(words[slot[a[wide]]] ^ words[slot[b[wide]]]).sum(axis=1, dtype=np.int64) <= most[wide]
            a, b = a[ok], b[ok]
        return a, b

    away = 0  # own size first, then the sizes around it: the most similar ones
    while True:
        still = ((own + abs(away) < end) | (own - abs(away) >= least)) & ~more[probe]
        probes, least, own, end = probe[still], least[still], own[still], end[still]
        if not len(probes):
            break
        inside = (own + away < end) & (own + away >= least)
        probe, run = probes[inside], own[inside] + away
        start = head[run]
        many = np.searchsorted(spot, run * n + rank[probe]) - start  # targets of that size before the probe
        active, done = np.flatnonzero(many > 0), 0
        while len(active):
            width = max(1, COMPARED // len(active))
            for low in range(0, len(active), COMPARED // width):
                mine = active[low:low + COMPARED // width]
                count = np.minimum(width, many[mine] - done)
                i = np.repeat(mine, count)
                step = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + done
                # each probe begins elsewhere, so that no target is everyone's candidate
                s, t = passing(probe[i], target[start[i] + (rank[probe[i]] * 2654435761 + step) % many[i]])
                if first is not None and len(s):
                    of = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                    nth = np.arange(len(s)) - np.repeat(of, np.diff(np.append(of, len(s))))
                    keep = seen[s] + nth < first
                    more[s[~keep]] = True
                    s, t = s[keep], t[keep]
                    np.add.at(seen, s, 1)
                if len(s):
                    yield doc[s], line[s], doc[t], line[t], POSTINGS
            done += width
            active = active[(many[active] > done) & ~more[probe[active]]]
        probe = probes
        away = -away if away > 0 else 1 - away
    s = np.flatnonzero(more)
    if len(s):
        yield doc[s], line[s], word[s].astype(np.int64), line[s], OPEN


MATCHES = "doc long, line int, with_doc long, with_line int, kind int"


def _resolve(percent: int, first: int | None):
    """Of blobs sorted by cell: lines that go for an equal one, candidate pairs, and lines that have more of them.

    An open line comes with the word that left it open, or -1 for a dealt one.  A task holds a cell at a time.
    """
    def rows(found: list[tuple]) -> pa.RecordBatch:
        d, l, wd, wl = (np.concatenate([x[k] for x in found]) for k in range(4))
        kinds = np.repeat(np.array([x[4] for x in found], np.int32), [len(x[0]) for x in found])
        return pa.RecordBatch.from_arrays(
            [pa.array(d.astype(np.int64)), pa.array(l.astype(np.int32)), pa.array(wd.astype(np.int64)),
             pa.array(wl.astype(np.int32)), pa.array(kinds)], ["doc", "line", "with_doc", "with_line", "kind"])

    def decided(equal: list, gone: list, posted: list[list]) -> Batches:
        if equal:
            gone.append(_later_equals(np.concatenate(equal)))
        found = [(x["doc"], x["line"], x["doc"], x["line"], GONE) for x in gone]
        if first is not None:  # a line under a dealt word has met one block only
            found += [(x["doc"], x["line"], np.full(len(x), -1), x["line"], OPEN) for part in posted[CLASSES:] for x in part]
        held = 0
        for pairs in _candidates(posted, percent, first) if any(posted) else ():
            found.append(pairs)
            held += len(pairs[0])
            if held > COMPARED:
                yield rows(found)
                found, held = [], 0
        if found:
            yield rows(found)

    def run(batches: Batches) -> Batches:
        cell, equal, gone, posted = None, [], [], [[] for _ in POSTING * 2]
        for batch in batches:
            for kind, at, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if at != cell:
                    yield from decided(equal, gone, posted)
                    cell, equal, gone, posted = at, [], [], [[] for _ in POSTING * 2]
                blob = blob.as_py()
                if kind >= POSTINGS:
                    posted[kind - POSTINGS].append(np.frombuffer(blob, POSTING[(kind - POSTINGS) % CLASSES]))
                else:
                    (equal if kind == EQUAL else gone).append(np.frombuffer(blob, LINE))
        yield from decided(equal, gone, posted)
    return run


def _matches(docs: DataFrame, place: np.ndarray, percent: int, blocks: np.ndarray,
             only: tuple[np.ndarray, np.ndarray] | None = None, probe_blocks: int = 1) -> DataFrame:
    partitions = shuffle_partitions(docs.sparkSession)
    cell_bits = min(24, max(8, (CELLS_PER_PARTITION * partitions - 1).bit_length()))
    blobs = docs.mapInArrow(_extract(place, percent, cell_bits, blocks, only, probe_blocks), "kind int, cell int, blob binary")
    # by the cell alone: sets of different classes under a word must meet
    return blobs.repartition(partitions, "cell").sortWithinPartitions("cell").mapInArrow(_resolve(percent, FIRST if only is None else None), MATCHES)


def _pairs_of(found: DataFrame) -> DataFrame:
    """The candidate pairs of two lines; a line and its repeat in a row of the same doc_id are one line."""
    return found.where((F.col("kind") == POSTINGS) & ~((F.col("doc") == F.col("with_doc")) & (F.col("line") == F.col("with_line"))))


def _words(column: str):
    return F.array_distinct(F.filter(F.split(column, WHITE), lambda w: w != ""))


def _verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The ``(doc, line)`` of pairs whose whole word sets reach the threshold."""
    pairs = saved(pairs.select("doc", "line", "with_doc", "with_line").distinct(), "line-pairs")
    wanted = saved(pairs.select("doc", "line").union(pairs.select("with_doc", "with_line")).distinct(), "lines-wanted")
    texts = keep_keys(docs.withColumnRenamed("doc_id", "doc"), saved(wanted.select("doc").distinct(), "docs-wanted"), ["doc"])
    lines = (texts.select("doc", F.posexplode(F.split("text", "\n")).alias("line", "value"))
             .join(wanted, ["doc", "line"]))
    other = lines.toDF("with_doc", "with_line", "with_value")
    # lines travel as text; word sets are made where both sides have met
    both = (pairs.join(lines, ["doc", "line"]).join(other, ["with_doc", "with_line"])
            .select("doc", "line", _words("value").alias("words"), _words("with_value").alias("others"))
            .withColumn("common", F.size(F.array_intersect("words", "others"))))
    return (both.where(100 * F.col("common") >= percent * (F.size("words") + F.size("others") - F.col("common")))
            .select("doc", "line").distinct())


def _filter_of(lines: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with the bit of every given line, or of other pairs of numbers, set."""
    def bits(batches: Batches) -> Batches:
        for batch in batches:
            at = _position(batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64) + 1)], ["bit"])
    marked = np.zeros(FILTER_BITS // 8, np.uint8)
    parts = (lines.mapInArrow(bits, "bit long")
             .groupBy(F.expr("bitmap_bucket_number(bit)").alias("bucket"))
             .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bitmap")))
    for bucket, bitmap in parts.collect():
        part = np.frombuffer(bitmap, np.uint8)  # bucket k has the values (k - 1) * 32768 + 1 to k * 32768
        marked[(bucket - 1) * len(part):bucket * len(part)] = part
    return marked


def later_matches(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``(doc_id, line)``: the lines (numbered from 0, split at ``\\n``) that match an earlier line.

    Wordless lines never match.  Rows without doc_id or text take no part.  Rows that repeat a
    doc_id are one document: its lines are decided by number, a line and its own repeat do not
    match each other.  An empty table gives no lines.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    counts = word_frequencies(docs)
    place = _rarity(counts)
    blocks = _blocks_of_words(docs, counts, place, percent)
    found = saved(_matches(docs, place, percent, blocks), "line-matches")
    gone = found.where(F.col("kind") == GONE).select("doc", "line")
    pairs = _pairs_of(found).join(gone, ["doc", "line"], "left_anti")
    sure = saved(_verified(pairs, docs, percent), "lines-similar")
    gone = gone.union(sure)
    left_open = saved(found.where(F.col("kind") == OPEN).select("doc", "line", F.col("with_doc").alias("word")).distinct()
                      .join(gone, ["doc", "line"], "left_anti"), "lines-open")
    open_lines = left_open.select("doc", "line").distinct()
    n_open = open_lines.count()
    if n_open:
        words = left_open.where("word >= 0").select("word", F.lit(0).alias("line")).distinct()
        only = _filter_of(open_lines), _filter_of(words)
        again = _matches(docs, place, percent, blocks, only, -(-n_open // BLOCK))
        rest = saved(_pairs_of(again).join(open_lines, ["doc", "line"], "left_semi"), "line-matches")
        gone = gone.union(_verified(rest, docs, percent))
    return gone.distinct().select(F.col("doc").alias("doc_id"), "line")


def removed_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``(doc_id, lines)``: the sorted numbers of the lines that go, for documents that lose any."""
    return later_matches(docs, percent).groupBy("doc_id").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def drop_repeated_lines(docs: DataFrame, percent: int = 80, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with the later matches cut out of ``text`` and ``n_chars``, if there is one, set anew.

    A document whose worded lines all go repeats earlier ones as a whole: it keeps its row with
    what is left, or goes too with ``drop_emptied``.  Null texts stay null, wordless ones as
    they are.  Other columns are returned as they came.
    """
    gone = removed_lines(docs, percent).select(F.col("doc_id").alias("__doc"), F.col("lines").alias("__gone"))
    joined = docs.join(gone, docs["doc_id"] == gone["__doc"], "left")
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("__gone", i))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    cut = joined.withColumn("__text", text)
    if drop_emptied:
        cut = cut.where("__gone is null or __text is null or regexp_like(__text, '[^\\x09-\\x0D\\x20]')")
    return with_text(cut, "__text", docs)

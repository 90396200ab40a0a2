"""Fuzzy line deduplication over the whole corpus.

Lines are normalised to their words (A-Z lower-cased; ASCII letters, digits and
everything beyond ASCII) with one space between. Lines with the same words, told by a
128-bit digest, are one class. Two classes link when their normalised lines have an edit
similarity of 0.8 or more and they meet under a key. Keys are of three kinds:

* Blocks of a 128-bit SimHash. Of ``SIM_BLOCKS`` blocks three differing bits leave one
  untouched, so any two lines within three bits share a block.
* Triples of MinHashes, which find the many near lines that are farther apart than that:
  one changed word of ten moves a quarter of a SimHash. Their features are a line's long
  words or, where it has few (short lines, scripts without spaces), its byte n-grams.
* All spellings with one character left out, for lines of which only one edit may part
  near ones; these find every such pair.

One pass over the texts deals keys out to fragments of their hash range. A map task sends
a key and a class at most once: repeats within the task are settled there, so a line or a
key of a third of all rows costs its fragment one entry per task. A fragment keeps only
keys that two classes share. Of every connected group of classes the first occurrence
stays, in the order of document id, text hash and line number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklens.llm.common import as_long, drop_table, materialize, null_safe_eq, part_bytes, pick, pieces_for, scratch
from blocklens.llm.components import linked_components
from blocklens.llm.wordhash import eights, fold_ascii, keep_masks, mix, padded_bytes, span_hashes, word_class

BITS = 3
SIM_BLOCKS = BITS + 1
SIMILARITY = 80
#: Keys by MinHashes, each of three; lines with n-gram features, which are short, have more.
BANDS, GRAM_BANDS, ROWS = 12, 24, 3
#: Bytes of a long word; a line has word features from ``WORDS`` such words on, and n-gram
#: features up to ``FEW_WORDS``, so that lines around the border have both.
LONG_WORD, WORDS, FEW_WORDS = 5, 5, 7
#: N-grams by the bytes of the line: size, least and most bytes. Ranges overlap by what 0.8 allows.
GRAMS = ((3, 6, 24), (5, 20, 120), (8, 96, 1 << 40))
#: Lines of so many characters are 80 % alike if one edit parts them, and by no more edits.
ONE_EDIT = (5, 9)
#: Lengths are kept as whole logarithms to this base.
LENGTH_BASE = 1.2
#: Of the 128 bits of two lines' SimHashes by words, and of the first 64 by n-grams of
#: ``SIM_GRAM`` bytes, so many may differ for the lines to be compared.
FAR_BITS, FAR_GRAM_BITS, SIM_GRAM = 48, 23, 4
#: Kinds of lines: with n-gram features only, with both, with word features only.
BARE, BORDER, WORDY = 0, 1, 2
#: Wanted lines up to this many are sent to the texts; more are joined.
SEND_LINES = 500_000
#: Bytes of lines, and lines that go, that a map task holds before it sends them.
FLUSH, FLUSH_GONE = 1 << 23, 250_000
#: Elements of the arrays that pairs are verified in; lines of more characters, fewer pairs of a
#: length, and batches of more different characters are compared one pair at a time.
LANES, LONGEST, FEW_PAIRS, MOST_SIGNS = 1 << 14, 2048, 64, 512
#: Rows of a key's list that meet at a time, pairs that are looked at at a time, and pairs that are
#: compared before those that are joined up by then are left out.
LIST_PART, PAIRS, COMPARED = 4096, 1 << 20, 1 << 17
NEWLINE, SPACE = 0x0A, 0x20

CLASS = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("id", "<i8"), ("th", "<i8"), ("line", "<i8"), ("sim", "<u8"), ("sim2", "<u8"), ("gsim", "<u8"), ("size", "u1"), ("kind", "u1"), ("null", "?")])
#: The lowest bit of ``key`` marks a key that two classes of one task share.
ENTRY = np.dtype([("key", "<u4"), ("h1", "<u8")])
OUT = "id long, th long, line long, h1 long, h2 long, sim long, sim2 long, gsim long, size int, kind int, tok long"


class Lines:
    """The lines of a run of rows: each one's normalised bytes, row and number."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        rows = len(offsets) - 1
        # Every row ends in a newline of its own, so that lines never cross rows.
        raw = np.insert(data, offsets[1:], NEWLINE)
        begins = offsets[:-1] + np.arange(rows)
        ends = np.flatnonzero(raw == NEWLINE)
        first = np.searchsorted(ends, begins)
        counts = np.diff(np.append(first, len(ends)))
        self.row = np.repeat(np.arange(rows), counts)
        self.number = np.arange(len(ends)) - np.repeat(first, counts)
        inside = word_class("alnum")[raw]
        keep = inside.copy()
        keep[1:] |= inside[:-1]
        self.text = np.where(inside, fold_ascii()[raw], SPACE)[keep].astype(np.uint8)
        # A kept newline or sign closes a word; the last one of a line is no part of it.
        upto = np.cumsum(np.add.reduceat(keep.view(np.uint8), np.append(0, ends[:-1] + 1), dtype=np.int64)) if len(ends) else np.zeros(0, np.int64)
        self.begins = np.append(0, upto[:-1])[: len(ends)]
        self.sizes = np.maximum(upto - self.begins - 1, 0)

    def words(self, i: int) -> bytes:
        a = int(self.begins[i])
        return self.text[a : a + int(self.sizes[i])].tobytes()


def line_runs(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, Lines]]:
    """First row and lines of runs of rows of about ``limit`` bytes; a longer row is a run of its own."""
    data, offsets = part_bytes(column)
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = min(rows, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1))
        yield lo, Lines(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@cache
def minhash_parts() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return (rng.integers(0, 1 << 32, GRAM_BANDS * ROWS, np.uint64) | np.uint64(1)).astype(np.uint32), rng.integers(0, 1 << 32, GRAM_BANDS * ROWS, np.uint64).astype(np.uint32)


def minhash_keys(features: np.ndarray, cuts: np.ndarray, kind: int) -> np.ndarray:
    """A row of keys per line; ``cuts`` are where each line's 32-bit features begin, and the end."""
    keys = np.zeros((len(cuts) - 1, GRAM_BANDS if kind else BANDS), np.uint64)
    for i, (w, c) in enumerate(zip(*minhash_parts(), strict=True)):
        if i // ROWS == keys.shape[1]:
            break
        least = np.minimum.reduceat(features * w ^ c, cuts[:-1])
        keys[:, i // ROWS] = mix(keys[:, i // ROWS] * np.uint64(3) + least + np.uint64(1 + i // ROWS + (kind << 8)))
    return keys


@cache
def spread_bits() -> np.ndarray:
    """Of each byte, a number whose eight bytes are its bits."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8").ravel()


def simhashes(features: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A row of two numbers per line, its SimHash: each bit is the features' majority."""
    size = np.diff(cuts)
    out = np.zeros((len(size), 2), np.uint64)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + (1 << 13), "right")) - 1)
        own, begins = features[cuts[lo] : cuts[hi]].astype(np.uint64), cuts[lo:hi] - cuts[lo]
        for half in range(2):
            packed = mix(own + np.uint64(half << 40)).astype("<u8").view(np.uint8).reshape(-1, 8)
            if size[lo:hi].max() < 256:
                # Counts of less than 256 features need a byte each: eight are added as one number.
                votes = np.add.reduceat(spread_bits()[packed.T], begins, axis=1).T.copy().view(np.uint8).astype(np.int32)
            else:
                votes = np.add.reduceat(np.unpackbits(packed, axis=1, bitorder="little"), begins, axis=0, dtype=np.int32)
            out[lo:hi, half] = np.packbits(2 * votes > size[lo:hi, None], axis=1, bitorder="little").view("<u8").ravel()
        lo = hi
    return out


def block_keys(sims: np.ndarray) -> np.ndarray:
    """A row of keys per line, one for each block of its SimHash."""
    blocks = [x for half in sims.T for x in (half & np.uint64(0xFFFFFFFF), half >> np.uint64(32))]
    return np.stack([mix(b + np.uint64((n + 1) << 40)) for n, b in enumerate(blocks)], axis=1)


def length_codes(text: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The lines' lengths in characters, on a logarithmic scale."""
    later = np.flatnonzero((text & 0xC0) == 0x80)
    chars = sizes - np.searchsorted(later, begins + sizes) + np.searchsorted(later, begins)
    return np.minimum(255, np.log(np.maximum(1, chars)) / np.log(LENGTH_BASE)).astype(np.uint8)


def line_keys(text: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(line, key)`` of all keys of the given lines, in any order; SimHashes (two numbers by words, one by n-grams); kinds."""
    padded = padded_bytes(text)
    at, keys, sims = [], [], np.zeros((len(begins), 3), np.uint64)

    def put(lines: np.ndarray, made: np.ndarray) -> None:
        at.append(np.repeat(lines, made.shape[1]))
        keys.append(made.ravel())

    # Long words: stretches between spaces.
    gap = text == SPACE
    ends = np.flatnonzero(gap)
    starts = np.append(0, ends[:-1] + 1)
    long = np.flatnonzero(ends - starts >= LONG_WORD)
    owner = np.searchsorted(begins, starts[long], "right") - 1
    inside = (owner >= 0) & (starts[long] < begins[owner] + sizes[owner])
    long, owner = long[inside], owner[inside]
    count = np.bincount(owner, minlength=len(begins))
    wordy = np.flatnonzero(count >= WORDS)
    if len(wordy):
        chosen = count[owner] >= WORDS
        features = (span_hashes(padded, starts[long[chosen]], (ends - starts)[long[chosen]]) >> np.uint64(32)).astype(np.uint32)
        cuts = np.append(0, np.cumsum(count[wordy]))
        put(wordy, minhash_keys(features, cuts, 0))
        sims[wordy, :2] = simhashes(features, cuts)
        put(wordy, block_keys(sims[wordy, :2]))
    few = count <= FEW_WORDS

    def grams(chosen: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
        n = sizes[chosen] - gram + 1
        cuts = np.append(0, np.cumsum(n))
        place = np.arange(cuts[-1]) + np.repeat(begins[chosen] - cuts[:-1], n)
        return (mix((eights(padded)[place] & keep_masks()[gram]) + np.uint64(gram)) >> np.uint64(32)).astype(np.uint32), cuts

    for kind, (gram, least, most) in enumerate(GRAMS, 1):
        chosen = np.flatnonzero(few & (sizes >= least) & (sizes <= most))
        if len(chosen):
            put(chosen, minhash_keys(*grams(chosen, gram), kind))
    chosen = np.flatnonzero(few & (sizes >= SIM_GRAM))
    if len(chosen):
        made = simhashes(*grams(chosen, SIM_GRAM))
        sims[chosen, 2] = made[:, 0]
        bare = count[chosen] < WORDS
        if bare.any():
            put(chosen[bare], block_keys(made[bare]))
    least, most = ONE_EDIT
    for i in np.flatnonzero((sizes >= least) & (sizes <= 4 * most)).tolist():
        word = text[begins[i] : begins[i] + sizes[i]].tobytes().decode("utf-8", "replace")
        if least <= len(word) <= most:
            spelt = {word, *(word[:j] + word[j + 1 :] for j in range(len(word)))}
            put(np.array([i]), np.array([[int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8, key=b"short").digest(), "little") for x in spelt]], np.uint64))
    at, keys = (np.concatenate(at), np.concatenate(keys)) if at else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return at, keys, sims, np.where(count < WORDS, BARE, np.where(few, BORDER, WORDY))


class Sender:
    """What a map task knows of its lines, and the rows it sends to the fragments."""

    def __init__(self, bits: int, salt: int):
        self.bits, self.salt = bits, salt
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.classes: list[tuple] = []
        self.gone: list[tuple] = []
        self.texts: list[bytes] = []
        self.held = 0

    def add(self, ids: list, hashes: list, lo: int, lines: Lines) -> None:
        raw, place = lines.text.tobytes(), self.place
        some = np.flatnonzero(lines.sizes)
        for row, number, a, n in zip(lines.row[some].tolist(), lines.number[some].tolist(), lines.begins[some].tolist(), lines.sizes[some].tolist(), strict=True):
            words = raw[a : a + n]
            name = hashlib.blake2b(words, digest_size=16).digest()
            i = ids[lo + row]
            at = (i is None, i or 0, hashes[lo + row], number)
            known = place.setdefault(name, len(self.classes))
            if known == len(self.classes):
                self.classes.append((name, at))
                self.texts.append(words)
                self.held += n + 1
            else:
                # Of two occurrences in this task the later one is a repeat, whatever the rest holds.
                first = self.classes[known][1]
                if at != first:
                    self.classes[known], at = (name, min(at, first)), max(at, first)
                    self.gone.append(at)

    def rows(self) -> pa.RecordBatch:
        """All that is held, as rows ``(fragment, classes, entries)``."""
        held = np.zeros(len(self.classes), CLASS)
        names = np.frombuffer(b"".join(name for name, _ in self.classes), "<u8")
        held["h1"], held["h2"] = names[::2], names[1::2]
        for k, column in enumerate(("null", "id", "th", "line")):
            held[column] = [at[k] for _, at in self.classes]
        sizes = np.array([len(t) for t in self.texts], np.int64)
        begins = np.cumsum(sizes + 1) - sizes - 1
        text = np.frombuffer(b" ".join(self.texts) + b" ", np.uint8)
        at, keys, sims, held["kind"] = line_keys(text, begins, sizes)
        held["sim"], held["sim2"], held["gsim"], held["size"] = *sims.T, length_codes(text, begins, sizes)
        shift = np.uint64(64 - self.bits)
        order = np.argsort(keys, kind="stable")
        at, keys = at[order], keys[order]
        entries = np.zeros(len(keys), ENTRY)
        entries["key"] = (keys << np.uint64(self.bits)) >> np.uint64(33) << np.uint64(1)
        entries["h1"] = held["h1"][at]
        # A key that two of this task's classes have is shared: the classes after the first are
        # listed from here; the first goes on to its fragment, marked.
        again = np.zeros(len(keys), bool)
        again[1:] = keys[1:] == keys[:-1]
        leads = ~again
        leads[:-1] &= again[1:]
        leads[-1:] = False
        entries["key"][leads] += 1
        listed = pa.RecordBatch.from_pydict({"fragment": [-1 - self.salt], "classes": [self.gone_bytes()], "entries": [entries[again].tobytes()], "tops": [(keys[again] >> shift).astype("<u8").tobytes()]})
        entries, tops = entries[~again], (keys[~again] >> shift).astype(np.int64)
        spots = (held["h1"] >> shift).astype(np.int64)
        by_spot = np.argsort(spots, kind="stable")
        held, spots = held[by_spot], spots[by_spot]
        every = np.unique(np.concatenate((tops, spots)))
        cuts, places = (np.searchsorted(x, np.append(every, 1 << 62)) for x in (tops, spots))
        sent = pa.RecordBatch.from_pydict({
            "fragment": every,
            "classes": [held[a:b].tobytes() for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)],
            "entries": [entries[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)],
            "tops": [b""] * len(every),
        })
        self.clear()
        return pa.Table.from_batches([sent.cast(PIECES), listed.cast(PIECES)]).combine_chunks().to_batches()[0]

    def gone_bytes(self) -> bytes:
        out = np.zeros(len(self.gone), CLASS)
        for k, column in enumerate(("null", "id", "th", "line")):
            out[column] = [at[k] for at in self.gone]
        return out.tobytes()


PIECES = pa.schema([("fragment", pa.int64()), ("classes", pa.binary()), ("entries", pa.binary()), ("tops", pa.binary())])


def settled(table: pa.Table) -> pa.Table:
    """What one fragment finds: repeats of its classes, the classes, and lists of shared keys.

    Rows with neither ``h1`` nor ``tok`` are lines that go; rows with ``h2`` are classes;
    rows with ``tok`` are postings.
    """
    fragment = table.column("fragment")[0].as_py()
    classes = np.frombuffer(b"".join(table.column("classes").to_pylist()), CLASS)
    entries = np.frombuffer(b"".join(table.column("entries").to_pylist()), ENTRY)
    if fragment < 0:
        gone, classes = classes, classes[:0]
        tops = np.frombuffer(b"".join(table.column("tops").to_pylist()), "<u8")
    else:
        order = np.lexsort([classes[c] for c in ("line", "th", "id", "null", "h2", "h1")])
        classes = classes[order]
        first = np.ones(len(classes), bool)
        first[1:] = (classes["h1"][1:] != classes["h1"][:-1]) | (classes["h2"][1:] != classes["h2"][:-1])
        # Copies of one row hold the same line; where it stays, it stays in all of them.
        stays = classes[np.maximum.accumulate(np.where(first, np.arange(len(classes)), 0))]
        gone, classes = classes[classes != stays], classes[first]
        keys, marked = entries["key"] >> 1, entries["key"] & 1
        order = np.lexsort((entries["h1"], keys))
        entries, keys, marked = entries[order], keys[order], marked[order]
        new = np.ones(len(entries), bool)
        new[1:] = keys[1:] != keys[:-1]
        group = np.cumsum(new) - 1
        other = np.ones(len(entries), bool)
        other[1:] = new[1:] | (entries["h1"][1:] != entries["h1"][:-1])
        # Shared: by two classes here, or by two of one task.
        shared = (np.bincount(group, other) > 1) | (np.bincount(group, marked) > 0) if len(entries) else np.zeros(0, bool)
        entries = entries[other & shared[group]] if len(entries) else entries
        tops = np.full(len(entries), fragment, np.uint64)

    def column(*parts: np.ndarray | int, kind: pa.DataType = pa.int64()) -> pa.ChunkedArray:
        return pa.chunked_array([pa.nulls(p, kind) if isinstance(p, int) else p if isinstance(p, pa.Array) else pa.array(p.copy(), kind) for p in parts], kind)

    def ids(part: np.ndarray) -> pa.Array:
        return pa.array(part["id"].copy(), mask=part["null"].copy())

    g, c, e = len(gone), len(classes), len(entries)
    tok = tops << np.uint64(32) | (entries["key"] >> 1).astype(np.uint64)
    return pa.table({
        "id": column(ids(gone), ids(classes), e),
        "th": column(gone["th"], classes["th"], e),
        "line": column(gone["line"], classes["line"], e),
        "h1": column(g, as_long(classes["h1"].copy()), as_long(entries["h1"].copy())),
        "h2": column(g, as_long(classes["h2"].copy()), e),
        "sim": column(g, as_long(classes["sim"].copy()), e),
        "sim2": column(g, as_long(classes["sim2"].copy()), e),
        "gsim": column(g, as_long(classes["gsim"].copy()), e),
        "size": column(g, classes["size"].astype(np.int32), e, kind=pa.int32()),
        "kind": column(g, classes["kind"].astype(np.int32), e, kind=pa.int32()),
        "tok": column(g, c, as_long(tok)),
    })


def key_table(docs: DataFrame) -> DataFrame:
    """The rows of ``settled`` of all fragments; ``docs`` has ``id, th, text``."""
    bits = (pieces_for(docs, most=1 << 20) - 1).bit_length()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId()
        sender = Sender(bits, salt % (1 << bits))
        for batch in batches:
            ids, hashes = batch.column("id").to_pylist(), batch.column("th").to_pylist()
            for lo, lines in line_runs(batch.column("text")):
                sender.add(ids, hashes, lo, lines)
                if sender.held >= FLUSH or len(sender.gone) >= FLUSH_GONE:
                    yield sender.rows()
                    salt += 7919
                    sender.salt = salt % (1 << bits)
        if sender.classes:
            yield sender.rows()

    pieces = docs.select("id", "th", "text").mapInArrow(cut, "fragment long, classes binary, entries binary, tops binary")
    return pieces.groupBy("fragment").applyInArrow(settled, OUT)


def edit_distance(x: str, y: str, most: int | None = None) -> int:
    """Levenshtein distance, a column of the table at a time as bits of one integer (Myers 1999).

    What is more than ``most`` may be told as any number above it: each column that is left
    lowers the score by one at best.
    """
    if not x or not y:
        return len(x) + len(y)
    where: dict[str, int] = {}
    for i, c in enumerate(x):
        where[c] = where.get(c, 0) | 1 << i
    full, top, plus, minus, score = (1 << len(x)) - 1, 1 << len(x) - 1, (1 << len(x)) - 1, 0, len(x)
    limit = len(y) + (max(len(x), len(y)) if most is None else most)
    for done, c in enumerate(y):
        if score + done > limit:
            return score + done - len(y)
        eq = where.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(horizontal | plus)), plus & horizontal
        score += bool(up & top) - bool(down & top)
        up = up << 1 | 1
        plus = full & (down << 1 | ~(vertical | up))
        minus = full & up & vertical
    return score


def shared_start(x: str, y: str) -> int:
    lo, hi = 0, min(len(x), len(y))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if x[lo:mid] == y[lo:mid] else (lo, mid - 1)
    return lo


def word_distance(x: list[str], y: list[str], allowed: int, reach: int = 4) -> int:
    """A bound from above on the edit distance: words that differ are replaced as a whole.

    Where words differ, the nearest pair of equal words within ``reach`` ends the gap.
    """
    i, j, n, m, cost = 0, 0, len(x), len(y), 0
    while i < n and j < m:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        for gap in range(1, 2 * reach + 1):
            found = next(((p, gap - p) for p in range(max(0, gap - reach), min(reach, gap) + 1) if i + p < n and j + gap - p < m and x[i + p] == y[j + gap - p]), None)
            if found:
                break
        else:
            break
        p, q = found
        cost += max(sum(map(len, x[i : i + p])) + p, sum(map(len, y[j : j + q])) + q)
        if cost > allowed:
            return cost
        i, j = i + p, j + q
    return cost + max(sum(map(len, x[i:])) + n - i, sum(map(len, y[j:])) + m - j)


def similar(x: str, y: str, percent: int) -> bool:
    """Whether one minus the edit distance over the longer length is at least ``percent``."""
    allowed = (100 - percent) * max(len(x), len(y)) // 100
    if abs(len(x) - len(y)) > allowed:
        return False
    if word_distance(x.split(" "), y.split(" "), allowed) <= allowed:
        return True
    start = shared_start(x, y)
    x, y = x[start:], y[start:]
    end = shared_start(x[::-1], y[::-1])
    x, y = x[: len(x) - end], y[: len(y) - end]
    return max(len(x), len(y)) <= allowed or edit_distance(x, y, allowed) <= allowed


def near_pairs(texts: list[str], a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """``similar(texts[a], texts[b], percent)`` of each pair, many pairs at a time."""
    size = np.array([len(t) for t in texts], np.int64)
    # The shorter line is the pattern: its characters are bits, the longer one's are steps.
    short, long = np.where(size[a] <= size[b], a, b), np.where(size[a] <= size[b], b, a)
    allowed = (100 - percent) * size[long] // 100
    out = np.zeros(len(a), bool)
    fits = np.flatnonzero((size[long] - size[short] <= allowed) & (size[short] > 0))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(int(points.max(initial=0)) + 1, bool)
    seen[points] = True
    signs = int(seen.sum())
    codes = (np.cumsum(seen) - 1)[points]
    begins = np.cumsum(size) - size
    words = (size[short[fits]] + 63) // 64
    alone = (size[long[fits]] > LONGEST) | (np.bincount(words)[words] < FEW_PAIRS) | (signs > MOST_SIGNS)
    for i in fits[alone].tolist():
        out[i] = similar(texts[a[i]], texts[b[i]], percent)
    fits, words = fits[~alone], words[~alone]
    fits = fits[np.lexsort((size[long[fits]], words))]
    words = np.sort(words)
    lo = 0
    while lo < len(fits):
        # Pairs of one number of words, about as long.
        w = int(words[lo])
        hi = min(int(np.searchsorted(words, w, "right")), lo + max(64, LANES // w))
        some = fits[lo:hi]
        out[some] = distances_within(codes, signs, begins, size, short[some], long[some], allowed[some], w)
        lo = hi
    return out


def distances_within(codes: np.ndarray, signs: int, begins: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray, allowed: np.ndarray, words: int) -> np.ndarray:
    """Whether pairs of lines are at most ``allowed`` edits apart: ``edit_distance`` with a column per pair.

    All patterns ``x`` take ``words`` words of 64 bits, the lowest first.
    """
    out, at = np.zeros(len(x), bool), np.arange(len(x))
    used, place = np.unique(x, return_inverse=True)
    where = np.zeros((words, len(used) * signs), np.uint64)
    own = np.arange(len(used))
    for i in range(int(size[used].max())):
        has = own[size[used] > i]
        where[i // 64, has * signs + codes[begins[used[has]] + i]] |= np.uint64(1 << i % 64)
    base, first, ends = place * signs, begins[y], size[y]
    one, last = np.uint64(1), np.uint64(63)
    top = (size[x] - 1).astype(np.uint64) & last
    score, limit = size[x].copy(), ends + allowed
    plus, minus = np.full((words, len(x)), np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros((words, len(x)), np.uint64)
    for step in range(int(ends.max())):
        if step % 16 == 0:
            # Pairs that have ended keep their result; those too far apart already leave.
            stay = (ends > step) & (score + step <= limit)
            if not stay.all():
                if not stay.any():
                    break
                at, base, first, ends, top, score, limit = (v[stay] for v in (at, base, first, ends, top, score, limit))
                plus, minus = plus[:, stay], minus[:, stay]
        eq = np.take(where, base + codes[np.minimum(first + step, len(codes) - 1)], axis=1)
        vertical = eq | minus
        held = eq & plus
        total = held + plus
        carry = total < held
        for w in range(1, words):
            total[w] += carry[w - 1]
            carry[w] |= (total[w] == 0) & carry[w - 1]
        total ^= plus
        total |= eq
        up = minus | ~(total | plus)
        down = plus & total
        score += (up[-1] >> top & one).astype(np.int64)
        score -= (down[-1] >> top & one).astype(np.int64)
        over_up, over_down = up[:-1] >> last, down[:-1] >> last
        up <<= one
        down <<= one
        up[1:] |= over_up
        down[1:] |= over_down
        up[0] |= one
        plus = down | ~(vertical | up)
        minus = up & vertical
        over = ends == step + 1
        if over.any():
            out[at[over]] = score[over] <= limit[over] - ends[over]
    return out


def possible_pairs(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, apart: int) -> np.ndarray:
    """The condition ``possible`` of ``repeated_lines`` on rows ``i`` and ``j``."""
    kind = x["kind"]
    least, most = np.minimum(kind[i], kind[j]), np.maximum(kind[i], kind[j])
    ok = (np.abs(x["size"][i] - x["size"][j]) <= apart) & (most - least < 2)
    differ = lambda c: np.bitwise_count(x[c][i] ^ x[c][j]).astype(np.int64)
    ok &= (least == BARE) | (differ("sim") + differ("sim2") <= FAR_BITS)
    return ok & ((most == WORDY) | (differ("gsim") <= FAR_GRAM_BITS))


class Forest:
    """Which of ``names`` are joined up, and the links that joined them: less than there are names."""

    def __init__(self, names: np.ndarray):
        self.names, self.up = names, np.arange(len(names))
        self.links: list[tuple[int, int]] = []

    def tops(self) -> np.ndarray:
        while not np.array_equal(upper := self.up[self.up], self.up):
            self.up = upper
        return self.up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        up = self.up.tolist()

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = top(x), top(y)
            if p != q:
                up[max(p, q)] = min(p, q)
                self.links.append((x, y))
        self.up = np.array(up)


def list_links(table: pa.Table, similarity: int, apart: int) -> pa.RecordBatch:
    """Links ``(a, b)`` among components of rows of whole lists, sorted by ``tok, part``; see ``linked_components``.

    A pair that meets in several lists is compared in the one of the least ``tok``. Pairs
    whose components are joined up already are not compared, and only links that join two
    components are stated, so that they grow with the rows and not with their pairs.
    """
    x = {c: table.column(c).to_numpy() for c in ("tok", "part", "cid", "comp", "home", "sim", "sim2", "gsim", "size", "kind")}
    for c in ("sim", "sim2", "gsim"):
        x[c] = x[c].view(np.uint64)
    away = table.column("away").to_numpy(zero_copy_only=False)
    new = np.ones(len(away), bool)
    new[1:] = (x["tok"][1:] != x["tok"][:-1]) | (x["part"][1:] != x["part"][:-1])
    group = np.cumsum(new) - 1
    goes, rest = np.flatnonzero(away), np.flatnonzero(~away)
    lo, hi = (np.searchsorted(group[rest], group[goes], side) for side in ("left", "right"))
    met, found = np.cumsum(hi - lo), []
    at = 0
    while at < len(goes):
        upto = max(at + 1, int(np.searchsorted(met, (met[at - 1] if at else 0) + PAIRS, "right")))
        n = hi[at:upto] - lo[at:upto]
        i = np.repeat(goes[at:upto], n)
        j = rest[np.arange(n.sum()) + np.repeat(lo[at:upto] - np.cumsum(n) + n, n)]
        ok = (x["comp"][i] != x["comp"][j]) & ((x["comp"][j] == x["home"][j]) | (x["cid"][i] < x["cid"][j]))
        i, j = i[ok], j[ok]
        ok = possible_pairs(x, i, j, apart)
        found.append((i[ok], j[ok]))
        at = upto
    i, j = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    rows, place = np.unique(np.concatenate((i, j)), return_inverse=True)
    listed = [frozenset(t) for t in table.column("toks").take(pa.array(rows)).to_pylist()]
    i_at, j_at = place[: len(i)], place[len(i) :]
    own = np.array([min(listed[p] & listed[q]) == t for p, q, t in zip(i_at.tolist(), j_at.tolist(), x["tok"][i].tolist(), strict=True)], bool)
    i, j, i_at, j_at = i[own], j[own], i_at[own], j_at[own]
    texts = table.column("words").take(pa.array(rows)).to_pylist()
    names, comp = np.unique(x["comp"][rows], return_inverse=True)
    forest, at = Forest(names), 0
    while at < len(i_at):
        p, q = i_at[at : at + COMPARED], j_at[at : at + COMPARED]
        tops = forest.tops()
        apart_yet = tops[comp[p]] != tops[comp[q]]
        p, q = p[apart_yet], q[apart_yet]
        if len(p):
            same = near_pairs(texts, p, q, similarity)
            forest.join(comp[p[same]], comp[q[same]])
        at += COMPARED
    a, b = (names[np.array(c, np.int64)] for c in zip(*forest.links, strict=True)) if forest.links else (np.zeros(0, np.int64),) * 2
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def whole_lists(batches: Iterator[pa.RecordBatch], rows: int = 1 << 14) -> Iterator[pa.Table]:
    """Runs of about ``rows`` sorted rows that end where a list ends."""
    held, n = [], 0

    def last_list(batch: pa.RecordBatch) -> int:
        """Where the last list of a batch begins."""
        tok, part = (batch.column(c).to_numpy() for c in ("tok", "part"))
        other = np.flatnonzero((tok != tok[-1]) | (part != part[-1]))
        return int(other[-1]) + 1 if len(other) else 0

    for batch in batches:
        if not batch.num_rows:
            continue
        if n >= rows:
            cut = last_list(batch)
            head = batch.slice(0, cut)
            if cut:
                yield pa.Table.from_batches([*held, head]).combine_chunks()
                held, n, batch = [], 0, batch.slice(cut)
        held.append(batch)
        n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def row_of(left: DataFrame, right: DataFrame) -> Column:
    """Rows are told apart by id and text hash; null ids are equal."""
    return null_safe_eq(left["id"], right["of_id"]) & (left["th"] == right["of_th"])


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(h, h2, words)``: the normalised line of each of ``wanted(id, th, line, h, h2)``.

    Up to ``SEND_LINES`` wanted lines are sent to where the texts are; more are joined.
    """
    lists = wanted.groupBy(F.col("id").alias("of_id"), F.col("th").alias("of_th")).agg(F.collect_list(F.struct("line", "h", "h2")).alias("asked"))
    lists = F.broadcast(lists) if wanted.count() <= SEND_LINES else lists
    found = docs.join(lists, row_of(docs, lists)).select("text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple[int, int], str] = {}
            asked = batch.column("asked").to_pylist()
            for lo, lines in line_runs(batch.column("text")):
                first = np.searchsorted(lines.row, np.arange(int(lines.row[-1]) + 1)).tolist() if len(lines.row) else []
                for row, at in enumerate(first):
                    for want in asked[lo + row]:
                        out[want["h"], want["h2"]] = lines.words(at + want["line"]).decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.int64()), pa.array([k[1] for k in out], pa.int64()), pa.array(list(out.values()), pa.string())], ["h", "h2", "words"])

    # One class per 64-bit name; another that shares it takes no part in fuzzy groups.
    texts = found.mapInArrow(run, "h long, h2 long, words string")
    return texts.groupBy("h").agg(F.min(F.struct("h2", "words")).alias("t")).select("h", "t.h2", "t.words")


def repeated_lines(docs: DataFrame, *, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, th, line)`` of every line that repeats, exactly or nearly, one that stays.

    Rows are named by ``id`` and ``th``, the hash of their text.
    """
    rows = named_rows(docs, id_col, text_col).filter("text IS NOT NULL")
    table = materialize(key_table(rows), "lines", free=True)
    exact = table.filter("h1 IS NULL").select("id", "th", "line")
    classes = table.filter("h2 IS NOT NULL").withColumnRenamed("h1", "h").drop("tok")
    apart = int(np.ceil(np.log(100 / similarity) / np.log(LENGTH_BASE)))

    def possible(a: str, b: str) -> str:
        words = f"bit_count({a}.sim ^ {b}.sim) + bit_count({a}.sim2 ^ {b}.sim2) <= {FAR_BITS}"
        grams = f"bit_count({a}.gsim ^ {b}.gsim) <= {FAR_GRAM_BITS}"
        # What two lines both have is compared; those with nothing in common are too far apart.
        return f"abs({a}.size - {b}.size) <= {apart} AND abs({a}.kind - {b}.kind) < 2 AND (least({a}.kind, {b}.kind) = {BARE} OR {words}) AND (greatest({a}.kind, {b}.kind) = {WORDY} OR {grams})"

    posts = table.filter("tok IS NOT NULL").select("tok", F.col("h1").alias("cid"))
    listed = posts = materialize(posts.join(classes.select(F.col("h").alias("cid"), "sim", "sim2", "gsim", "size", "kind"), "cid"), "listed", free=True)
    # Most lines that share a key are strangers; they leave here.
    posts = posts.alias("x").join(posts.alias("y"), F.expr("x.tok = y.tok AND x.cid != y.cid AND " + possible("x", "y")), "left_semi").distinct()
    posts = materialize(posts, "postings", free=True)
    drop_table(listed)
    wanted = classes.join(posts.select(F.col("cid").alias("h")).distinct(), "h")
    wanted = materialize(wanted.select("id", "th", "line", "h", "h2"), "wanted")
    texts = materialize(line_texts(rows, wanted), "texts", free=True)

    def verify(pairs: DataFrame) -> DataFrame:
        full = pairs.join(texts.select(F.col("h").alias("a"), F.col("words").alias("wa")), "a").join(texts.select(F.col("h").alias("b"), F.col("words").alias("wb")), "b")

        def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                # Most of these are near, which ``similar`` tells by their words.
                same = [similar(x, y, similarity) for x, y in zip(batch.column("wa").to_pylist(), batch.column("wb").to_pylist(), strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

        return full.select("a", "b", "wa", "wb").mapInArrow(alike, "a long, b long")

    def within(lists: DataFrame) -> DataFrame:
        known = texts.select(F.col("h").alias("cid"), "words").join(posts.groupBy("cid").agg(F.collect_list("tok").alias("toks")), "cid")
        dealt = lists.join(known, "cid").repartition(pieces_for(posts, 1 << 21, least=24), "tok", "part").sortWithinPartitions("tok", "part")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in whole_lists(batches):
                yield list_links(table, similarity, apart)

        return dealt.mapInArrow(run, "a long, b long").distinct()

    labels = linked_components(posts, possible, verify, [F.lit(1), F.xxhash64("cid")], within, LIST_PART)
    # Only the verified class of a name is in its group.
    grouped = wanted.join(texts.select("h", "h2"), ["h", "h2"]).join(labels.withColumnRenamed("v", "h"), "h")
    at = F.struct(F.col("id").isNull().alias("null"), "id", "th", "line")
    stays = grouped.groupBy("label").agg(F.min(at).alias("stays"))
    nearly = grouped.withColumn("at", at).join(stays, "label").filter("at != stays").select("id", "th", "line")
    return exact.unionByName(nearly)


def named_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    return rows.select("id", F.xxhash64("text").alias("th"), "text")


def without_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """Per row of ``docs``: ``id, text`` (without the repeated lines), ``n_lines, n_removed``.

    Lines are what newlines part. Lines without any word stay where they are. Null texts
    stay null with 0 lines; null ids come last in the order; rows of one id with different
    texts are rows of their own; repeated rows (one id, one text) are one row that comes
    several times: their copies lose the same lines. An empty table gives an empty result;
    other columns are ignored.
    """
    with scratch(docs.sparkSession):
        gone = repeated_lines(docs, id_col=id_col, text_col=text_col, similarity=similarity)
        gone = gone.groupBy(F.col("id").alias("of_id"), F.col("th").alias("of_th")).agg(F.collect_set("line").alias("gone"))
        gone = materialize(gone, "gone", keep=True)
    rows = named_rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column("text").to_pylist(), batch.column("gone").to_pylist()
            out, n, removed = [], [], []
            for text, gone in zip(texts, lists, strict=True):
                lines = text.split("\n") if text is not None else []
                drop = set(gone or ())
                out.append("\n".join(x for i, x in enumerate(lines) if i not in drop) if text is not None else None)
                n.append(len(lines))
                removed.append(len(drop))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], ["id", "text", "n_lines", "n_removed"])

    joined = rows.join(gone, row_of(rows, gone), "left").select("id", "text", "gone")
    return joined.mapInArrow(run, "id long, text string, n_lines long, n_removed long")

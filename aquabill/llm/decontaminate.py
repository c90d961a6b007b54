r"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are normalised: lower case, and every run of characters that are neither letters nor digits is one blank. Benchmark
items are cut into windows of `window` characters, one every tenth of that, and of PART characters, one every STRIDE (the
last one flush with the item's end; a shorter item is one window). A document leaks an item when some window lies within
`max_errors` x its length edits of a part of it. Where none of these does, windows at every place are tried, of each length from PART up to
`window` at which one more edit is allowed (50, 60 and 80 characters for 5 %). They find every passage of PART characters or more with
edits of up to `max_errors` x its own length, wherever it begins and the edits lie: a passage shorter than `window` holds the
window of its own budget, and of the halves of a longer one (PART or more for a `window` of twice that) one has no more than its share of the edits.

A window of m characters with at most e edits shares at least m + 1 - q (e + 1) of its q-grams with that part, and all of
them lie on diagonals (place in the document less place in the item) that differ by at most e. So shared q-grams are
counted (each place of the window once) in bands of 2 * step diagonals that overlap by half, for an item first and for its
windows where that is enough; windows that meet the bound in a band are verified by an alignment over the band's diagonals.
The bound never drops a true match: q is Q, or less where a window's edits need that for the bound to be 1 or more, and step
is STEP, or more where edits need that. A `max_errors` for which q would fall below LEAST_Q is refused.

Documents are worked through in parts of CHUNK bytes, and shared q-grams of a part at most HITS at a time, so memory does not
grow with the input; one text is held whole. Benchmark items are a
stated query set: they are read in blocks of at most `block_chars` characters, each block one broadcast index and one pass
over the documents, so the benchmark may grow too.

Defined results: null and empty texts and items match nothing. Items shorter than LEAST match only a document that is equal to
them after normalisation. Rows repeat as they do in the input; rows of items that repeat an item_id count as that item. Empty
tables give an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aquabill.llm import common

Q, WINDOW, STEP = 12, 100, 8
PART, STRIDE = 50, 5
#: Characters of an item that is searched for inside of documents, and the shortest q-grams.
LEAST, LEAST_Q = 12, 4
CHUNK, BATCH, TRIES, HITS = 1_000_000, 2048, 250_000, 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
RESULT = "doc_id long, item_id long, start int, end int, edits int"
_wordish: list[np.ndarray] = []
#: start in the items, length, edits allowed, first diagonal, item
Windows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def wordish() -> np.ndarray:
    """Which code points of the first plane are letters or digits; all higher ones count as letters."""
    if not _wordish:
        _wordish.append(np.array([unicodedata.category(chr(i))[0] in "LNM" for i in range(0xFFFF)] + [True]))
    return _wordish[0]


def lowered(text: str) -> str:
    """Lower case, code point for code point."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with a zero after each, the place of each in its text, and where each text starts."""
    codes = np.frombuffer("\0".join([*map(lowered, texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) + 1 for t in texts])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    blank = ~wordish()[np.minimum(codes, 0xFFFF)]
    ends = starts[1:] - 1
    blank[ends] = False
    follows = np.concatenate([[True], blank[:-1]])
    follows[starts[:-1]] = True  # no blank at a text's start
    keep = ~(blank & follows)
    before_end = np.zeros(len(codes), bool)
    before_end[ends] = True
    out = np.where(blank, 32, codes).astype(np.uint32)
    out[ends] = 0
    place = np.arange(len(codes)) - np.repeat(starts[:-1], lengths)
    kept = np.flatnonzero(keep)
    out, place, is_end = out[kept], place[kept], before_end[kept]
    # a blank right before a text's end goes too
    tail = np.concatenate([(out[:-1] == 32) & is_end[1:], [False]]) if len(out) else np.zeros(0, bool)
    out, place, is_end = out[~tail], place[~tail], is_end[~tail]
    stops = np.flatnonzero(is_end)
    return out, place, np.concatenate([[0], stops + 1])


def qgrams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram that starts at each place; shorter by q - 1."""
    n = len(codes) - q + 1
    h = np.zeros(max(n, 0), np.uint64)
    for j in range(q if n > 0 else 0):
        h = h * BASE + codes[j : j + n]
    return h ^ (h >> np.uint64(29))


def window_starts(n: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of the windows of an item of n characters."""
    out = {(s, m): None for m, step in ((window, max(window // 10, 1)), (min(PART, window), STRIDE)) for s in [*range(0, max(n - m, 0), step), max(n - m, 0)]}
    return sorted({(s, min(m, n)) for s, m in out})


def _expanded(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), first[1], ..."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)


def _slices(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of about TRIES in all, of one at least."""
    ends, a = np.cumsum(n), 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TRIES, "right")))
        yield a, b
        a = b


class Index:
    """q-grams of a block of items, each place once, and the items' windows."""

    def __init__(self, items: list[tuple[int, str]], max_errors: float, window: int):
        self.whole: dict[bytes, list[int]] = {}
        names, owners, texts, cuts, sizes, at = [], [], [], [], [], 0
        for item, text in items:
            codes = normalised([text])[0]  # a zero at the end
            n = len(codes) - 1
            if n < LEAST:
                if n:
                    self.whole.setdefault(codes[:-1].tobytes(), []).append(item)
                continue
            own = window_starts(n, window)
            names += [item] * len(own)
            owners.append(item)
            cuts += [(at + s, m) for s, m in own]
            sizes.append((at, n, len(own)))
            texts.append(codes)
            at += n + 1
        self.items, self.names = np.array(names, np.int64), np.array(owners, np.int64)
        self.starts, self.lengths = np.array(cuts, np.int64).reshape(-1, 2).T
        self.item_starts, self.item_lengths, self.n_windows = np.array(sizes, np.int64).reshape(-1, 3).T
        self.first_window = np.cumsum(self.n_windows) - self.n_windows
        self.codes = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
        self.edits = np.floor(self.lengths * max_errors + 1e-9).astype(np.int64)
        self.q, self.step = min(Q, int((self.lengths // (self.edits + 1)).min(initial=Q))), max(STEP, int(self.edits.max(initial=0)))
        if self.q < LEAST_Q:
            raise ValueError(f"max_errors {max_errors} would need q-grams of {self.q} characters; at least {LEAST_Q} are needed")
        self.least = self.lengths + 1 - self.q * (self.edits + 1)
        # windows at every place: the shortest length of each number of edits
        budgets = range(int(np.floor(PART * max_errors + 1e-9)), int(np.floor(window * max_errors + 1e-9)) + 1)
        sizes = {max(PART, -int(-k // max_errors) if max_errors else PART): k for k in budgets}
        self.ladder = [(m, k, m + 1 - self.q * (k + 1)) for m, k in sizes.items() if m < max(window, PART + 1)]
        least_of = np.array([x for *_, x in self.ladder] + [1 << 30])
        fits = np.array([m for m, *_ in self.ladder] + [0]) <= self.item_lengths[:, None]
        self.item_least = np.minimum.reduceat(self.least, self.first_window) if texts else self.least
        self.item_least = np.minimum(self.item_least, np.where(fits, least_of, 1 << 30).min(axis=1)) if texts else self.item_least
        h = qgrams(self.codes, self.q)
        zeros = np.concatenate([[0], np.cumsum(self.codes == 0)])
        places = np.flatnonzero(zeros[self.q :] == zeros[: len(h)]) if len(h) else np.zeros(0, np.int64)  # within one item
        h = h[places]
        order = np.argsort(h, kind="stable")
        self.keys, self.first, self.counts = np.unique(h[order], return_index=True, return_counts=True)
        self.places = places[order]
        self.shift = self.step * (len(self.codes) // self.step + 4)  # makes diagonals positive
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    @property
    def windows(self) -> list[np.ndarray]:
        return [self.codes[s : s + m] for s, m in zip(self.starts, self.lengths)]

    def candidates(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, band, hits) of the bands of diagonals that share enough q-grams for some window of an item, some at a time.

        Shared q-grams are gathered from left to right, at most about HITS at once; a band is judged when no later place of
        the text can be on it.
        """
        h = qgrams(codes, self.q)
        at = np.flatnonzero(self.seen[(h >> np.uint64(42)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.keys, h[at]), max(len(self.keys) - 1, 0))
        good = self.keys[slot] == h[at] if len(self.keys) else np.zeros(len(at), bool)
        at, slot = at[good], slot[good]
        # of a run of one q-gram (as in 0000...) every step-th place and the last one reach the same bands
        same = np.concatenate([[False], (slot[1:] == slot[:-1]) & (at[1:] == at[:-1] + 1)])[: len(at)]
        last = np.append(~same[1:], True)[: len(at)]
        begin = np.maximum.accumulate(np.where(same, 0, at)) if len(at) else at
        need = ~same | last | ((at - begin) % self.step == 0)
        at, slot = at[need], slot[need]
        ends = np.cumsum(self.counts[slot])
        open_, a = np.zeros(0, np.int64), 0
        while a < len(at):
            done = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, done + HITS, "right")))
            n = self.counts[slot[a:b]]
            place = self.places[np.repeat(self.first[slot[a:b]] - (ends[a:b] - n - done), n) + np.arange(ends[b - 1] - done)]
            band = (np.repeat(at[a:b], n) - place + self.shift) // self.step
            # band b covers diagonals from b * step up to (b + 2) * step; hits are sorted by band and place, each once
            hits = np.unique(np.concatenate([open_, band << 32 | place, (band - 1) << 32 | place]))
            item = np.searchsorted(self.item_starts, hits & 0xFFFFFFFF, "right") - 1
            until = ((hits >> 32) + 2) * self.step - self.shift + self.item_starts[item] + self.item_lengths[item]
            over = until < at[b] if b < len(at) else np.ones(len(hits), bool)
            open_, a = hits[~over], b
            hits, item = hits[over], item[over]
            new = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (hits[1:] >> 32 != hits[:-1] >> 32)])) if len(hits) else np.zeros(0, np.int64)
            shared = np.diff(np.append(new, len(hits)))
            new = new[shared >= self.item_least[item[new]]]
            yield item[new], hits[new] >> 32, hits

    def _enough(self, band: np.ndarray, start: np.ndarray, length: np.ndarray, least: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """Which windows share enough q-grams in their bands."""
        low = band << 32 | start
        return np.searchsorted(hits, low + length - self.q, "right") - np.searchsorted(hits, low) >= least

    def coarse(self, item: np.ndarray, band: np.ndarray, hits: np.ndarray) -> Iterator[Windows]:
        """The items' own windows that share enough q-grams; TRIES or one item's are tried at a time."""
        for a, b in _slices(self.n_windows[item]):
            n = self.n_windows[item[a:b]]
            owner, own = _expanded(self.first_window[item[a:b]], n), np.repeat(band[a:b], n)
            good = self._enough(own, self.starts[owner], self.lengths[owner], self.least[owner], hits)
            owner, own = owner[good], own[good]
            yield self.starts[owner], self.lengths[owner], self.edits[owner], own * self.step - self.shift + self.starts[owner], np.repeat(item[a:b], n)[good]

    def fine(self, item: np.ndarray, band: np.ndarray, hits: np.ndarray) -> Iterator[Windows]:
        """Windows of the ladder's lengths at every place of the items that share enough q-grams."""
        for m, k, least in self.ladder:
            long = np.flatnonzero(self.item_lengths[item] >= m)
            places = self.item_lengths[item[long]] - m + 1
            for a, b in _slices(places):
                which, n = long[a:b], places[a:b]
                start, own = _expanded(self.item_starts[item[which]], n), np.repeat(band[which], n)
                good = np.flatnonzero(self._enough(own, start, m, least, hits))
                start, own = start[good], own[good]
                every = np.full(len(good), 1)
                yield start, every * m, every * k, own * self.step - self.shift + start, np.repeat(item[which], n)[good]

    def verify(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edits of each window within its band, and the place after its last character."""
        edits, stops = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        width = 4 * self.step  # the band and room for edits at both sides
        for m in np.unique(length):
            every = np.flatnonzero(length == m)
            for a in range(0, len(every), BATCH):
                rows = every[a : a + BATCH]
                pattern = self.codes[start[rows][:, None] + np.arange(m)[None]]
                left = diagonal[rows] - self.step
                place = left[:, None] + np.arange(m + width)[None]
                text = np.where((place >= 0) & (place < len(codes)), codes[np.clip(place, 0, len(codes) - 1)], 0)
                ramp = np.arange(width)
                cost = np.zeros((len(rows), width), np.int64)
                for i in range(m):
                    new = cost + (text[:, i : i + width] != pattern[:, i : i + 1])  # match or replace
                    new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)  # leave a pattern character out
                    cost = np.minimum.accumulate(new - ramp, axis=1) + ramp  # take a text character in
                best = cost.argmin(axis=1)
                edits[rows], stops[rows] = cost[np.arange(len(rows)), best], left + best + m
        return edits, stops

    def _add(self, windows: Windows, codes: np.ndarray, place: np.ndarray, starts: np.ndarray, text_of, found: dict) -> None:
        """Verifies windows and adds the leaks among them to found."""
        start, length, allowed, diagonal, item = windows
        edits, stops = self.verify(codes, start, length, diagonal)
        good = np.flatnonzero(edits <= allowed)
        length, edits, stops, item = length[good], edits[good], stops[good], item[good]
        t = text_of(stops - 1)
        last = np.maximum(np.minimum(np.clip(stops - 1, 0, len(codes) - 1), starts[t + 1] - 2), starts[t])  # not the zero after the text
        first = np.maximum(stops - length, starts[t])
        pair, which = np.unique(np.stack([t, self.names[item]]), axis=1, return_inverse=True)
        which = which.ravel()
        low, high, least = np.full(pair.shape[1], 1 << 62), np.zeros(pair.shape[1], np.int64), np.full(pair.shape[1], 1 << 62)
        np.minimum.at(low, which, place[first])
        np.maximum.at(high, which, place[last] + 1)
        np.minimum.at(least, which, edits)
        for key, span in zip(zip(*pair.tolist()), zip(low.tolist(), high.tolist(), least.tolist())):
            old = found.get(key, span)
            found[key] = (min(old[0], span[0]), max(old[1], span[1]), min(old[2], span[2]))

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, least edits) of every leaked item; start and end are code points of the text."""
        codes, place, starts = normalised(texts)
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        if self.whole:
            for t in range(len(texts)):
                own = codes[starts[t] : starts[t + 1] - 1]
                for item in self.whole.get(own.tobytes(), []) if len(own) < LEAST else []:
                    found[t, item] = (0, len(texts[t]), 0)
        text_of = lambda place: np.searchsorted(starts, np.clip(place, 0, len(codes) - 1), "right") - 1
        for item, band, hits in self.candidates(codes) if len(self.items) else []:
            for windows in self.coarse(item, band, hits):
                self._add(windows, codes, place, starts, text_of, found)
            for start, length, edits, diagonal, own in self.fine(item, band, hits):
                # not where the item was found in the text in which the window's middle would lie
                t = text_of(diagonal + length // 2)
                new = np.array([(x, y) not in found for x, y in zip(t.tolist(), self.names[own].tolist())], bool)
                self._add((start[new], length[new], edits[new], diagonal[new], own[new]), codes, place, starts, text_of, found)
        return [(t, item, *span) for (t, item), span in sorted(found.items())]


def leaks(docs: DataFrame, items: DataFrame, max_errors: float = 0.05, window: int = WINDOW, block_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, start, end, edits): one row per document row and item that it leaks. items has item_id and text."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    told = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    blocks = max(1, -(-(told.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    out = None
    for b in range(blocks):
        # about block_chars characters: the block's bound is what the driver and each worker hold
        own = told.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in own.collect()], max_errors, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, hits = batch.column("doc_id").to_pylist(), []
                for a, _, texts in common.text_parts(batch.column("text"), CHUNK):
                    hits += [(ids[a + t], *rest) for t, *rest in shared.value.search(texts)]
                columns = list(zip(*hits)) or [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "start", "end", "edits"])

        part = rows.mapInArrow(run, RESULT)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the documents that leak an item."""
    gone = leaks(docs, items).where("doc_id is not null").select(F.col("doc_id").alias("leak_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["leak_gone"], "left_anti")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

r"""Alignment of the tokens of two tokenizers by interval coalescing.

Tokens are byte intervals of blank + text. All tokens of both tokenizers are sorted by start (`lexsort`), the running maximum of
their ends is taken (`maximum.accumulate`), and a group ends where a start reaches the running maximum. Within a group the pairs of
tokens that overlap are its links; those of a token are neighbours in the other list, so two binary searches give their
range, and ranges are expanded flat.

Texts are cut before each blank that follows something else than white space. Both tokenizers end a token there (the one cuts
words there by its pattern; no piece of the other holds a blank after another character, which `Pair` checks), so the tokens and groups of a text
are those of its chunks. A chunk is encoded and aligned once and then looked up: a task keeps at most MAX_CHUNKS of them
and MAX_BYTES of their text and starts anew beyond that, so its memory does not grow with the input.

How often an id pair is linked is counted in two passes. The first gives for each part of a batch the pairs of its
documents with the number of documents that hold each, which Spark adds up. The second adds these counts up for each
document. It looks them up in a broadcast table while that holds `max_pairs` rows or fewer (16 bytes a row, sorted); a larger table, which two
large vocabularies may make, is joined by (a, b) instead, the most frequent pairs apart from the others.

Defined results: null and empty texts, and texts whose tokens of either side do not spell blank + text (U+2581 in a text),
have no tokens: zeros, and an empty `groups`. Special tokens in a text are plain text. Each row counts as a document, also where doc_ids
repeat. Rows are otherwise independent; only doc_id and text are read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aquabill.llm import bpe, common

BYTE_TOKENS, PIECE_TOKENS = "byte_bpe_50k.json", "piece_bpe_32k.model"
MAX_CHUNKS, MAX_BYTES, MAX_PAIRS = 400_000, 40_000_000, 4_000_000
#: Chunks that are encoded as one text, and characters beyond which the slower but steadier encoder takes a text.
BLOCK, MOST_AT_ONCE = 2_000, 200_000
#: A blank after something else than white space begins a chunk.
CHUNK = re.compile(r"(?<=\S) ")
SHIFT = np.int64(32)
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
PAIRS = "a int, b int, n long"


def expanded(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), first[1], ..."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)


class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        import tokenizers

        self.byte = tokenizers.Tokenizer.from_file(byte_path)
        self.byte.encode_special_tokens = True  # their strings in a text are plain text
        self.byte.no_truncation()
        self.byte.no_padding()
        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        code = {c: b for b, c in enumerate(bpe.byte_letters())}
        vocabulary = self.byte.get_vocab(with_added_tokens=True)
        # where ids follow the merges, the ids are ranks: then a faster encoder of the same vocabulary gives the same ids
        model = json.load(open(byte_path, encoding="utf-8"))["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = None
        if [model["vocab"][a + b] for a, b in merges] == list(range(256, 256 + len(merges))):
            ranks = {bytes(map(code.__getitem__, t)): i for t, i in model["vocab"].items() if i < 256 + len(merges)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(code[c] for c in token) if all(c in code for c in token) else token.encode()
        names = [self.piece.id_to_piece(i) for i in range(self.piece.vocab_size())]
        self.b_bytes = [bytes([int(t[1:-1], 16)]) if self.piece.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(names)]
        # otherwise a piece could reach over the start of a chunk
        self.local = not any(" " in t.decode("utf-8", "replace").lstrip(" ") for i, t in enumerate(self.b_bytes) if not self.piece.is_byte(i))
        self.names = [f"{i}{sign}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for sign in (",", "|", ";", "")]
        self.blank = self.piece.piece_to_id("▁")
        self.a_size, self.b_size = np.array(list(map(len, self.a_bytes))), np.array(list(map(len, self.b_bytes)))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text that begins with a blank, which the second tokenizer adds by itself."""
        if self.ranks and len(text) <= MOST_AT_ONCE:
            a = self.ranks.encode_ordinary(text)
        else:
            a = self.byte.encode_batch_fast([text], add_special_tokens=False)[0].ids
        b = self.piece.encode(text[1:], num_threads=1) if text != " " else [self.blank]  # nothing at all gets no blank
        return np.array(a, np.int64), np.array(b, np.int64)

    def spell(self, ids: tuple[np.ndarray, np.ndarray], data: bytes) -> bool:
        """Whether the tokens of both sides spell data."""
        return all(b"".join(map(own.__getitem__, x.tolist())) == data for own, x in zip((self.a_bytes, self.b_bytes), ids))

    def encode_chunks(self, chunks: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Flat ids of both sides, how many tokens each chunk has, and whether its tokens spell it.

        Chunks that end with something else than white space are encoded as one text, since both tokenizers end a token after each; the
        ends of the tokens tell the chunks apart. Where that does not come out, and for all others, each chunk is a text of its own.
        """
        data = [c.encode("utf-8", "surrogatepass") for c in chunks]
        ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
        ids, cuts = self.encode("".join(chunks)), []
        if self.spell(ids, b"".join(data)):
            for x, size in zip(ids, (self.a_size, self.b_size)):
                stops = np.cumsum(size[x])
                at = np.searchsorted(stops, ends)
                if not np.array_equal(stops[at], ends):
                    break
                cuts.append(np.diff(at + 1, prepend=0))
        if len(cuts) == 2:
            return [*ids], cuts, np.ones(len(chunks), bool)
        if len(chunks) > 1:
            half = len(chunks) // 2
            left, right = self.encode_chunks(chunks[:half]), self.encode_chunks(chunks[half:])
            return [*map(np.concatenate, zip(left[0], right[0]))], [*map(np.concatenate, zip(left[1], right[1]))], np.concatenate([left[2], right[2]])
        return [np.zeros(0, np.int64)] * 2, [np.zeros(1, np.int64)] * 2, np.zeros(1, bool)

    def chunks(self, text: str) -> list[str]:
        """blank + text in chunks that both tokenizers encode by themselves."""
        if not self.local:
            return [" " + text]
        out = CHUNK.split(" " + text)
        return [out[0], *[" " + c for c in out[1:]]]


class Aligned:
    """What the passes need of each chunk, flat; chunks have numbers 0, 1, ... The first pass does without the groups' text."""

    def __init__(self, pair: Pair, shown: bool = True):
        self.pair, self.shown = pair, shown
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.bytes = 0
        self.counts = np.zeros((0, len(COUNTS)), np.int64)
        self.good = np.zeros(0, bool)
        self.groups: list[str] = []
        self.links, self.starts = np.zeros(0, np.int64), np.zeros(1, np.int64)  # a << 32 | b of each link, by chunk

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Chunk numbers of all texts, and where those of each text begin (one more entry than texts)."""
        if len(self.index) > MAX_CHUNKS or self.bytes > MAX_BYTES:
            self.clear()
        chunks, ends = [], [0]
        for t in texts:
            if t:
                chunks += self.pair.chunks(t)
            ends.append(len(chunks))
        if new := list(set(chunks) - self.index.keys()):
            self._learn(new)
        return np.fromiter(map(self.index.__getitem__, chunks), np.int64, len(chunks)), np.array(ends)

    def _learn(self, new: list[str]) -> None:
        joint = [c for c in new if not c[-1].isspace()]
        blocks = [joint[i : i + BLOCK] for i in range(0, len(joint), BLOCK)] + [[c] for c in new if c[-1].isspace()]
        if not blocks:
            return
        got = [self.pair.encode_chunks(block) for block in blocks]
        (a, b), (na, nb) = ([np.concatenate([x[k][side] for x in got]) for side in (0, 1)] for k in (0, 1))
        good = np.concatenate([x[2] for x in got])
        counts, groups, links, sizes = align(a, na, b, nb, self.pair, self.shown)
        names = [c for block in blocks for c in block]
        self.index.update(zip(names, range(len(self.good), len(self.good) + len(names))))
        self.bytes += sum(map(len, names)) + sum(map(len, groups))
        self.good = np.concatenate([self.good, good])
        self.counts = np.concatenate([self.counts, counts])
        self.groups += groups
        self.links = np.concatenate([self.links, links])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])


def align(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, pair: Pair, shown: bool = True) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Of pieces of text with tokens of both sides that spell the same bytes: COUNTS, groups, links (a << 32 | b), links a piece.

    a and b are the flat ids, na and nb how many each piece has. Groups are left out unless they are to be shown.
    """
    n = len(na)
    # pieces lie one after the other on one line of bytes, so no token overlaps one of another piece
    end_a, end_b = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    start_a, start_b = end_a - pair.a_size[a], end_b - pair.b_size[b]
    starts, ends = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
    order = np.lexsort((ends, starts))
    reached = np.maximum.accumulate(ends[order]) if len(order) else ends
    breaks = np.concatenate([[True], starts[order][1:] >= reached[:-1]])[: len(order)]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    # tokens that overlap: of the other list from the one that ends after my start up to the one that starts before my end
    first, last = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
    links = np.repeat(a, last - first) << SHIFT | b[expanded(first, last - first)]
    piece_a, piece_b = np.repeat(np.arange(n), na), np.repeat(np.arange(n), nb)
    n_links = np.bincount(piece_a, last - first, n).astype(np.int64)
    n_groups = np.bincount(piece_a[np.diff(group[: len(a)], prepend=-1) > 0], minlength=n)
    counts = np.stack([na, nb, n_groups, n_links], axis=1)
    groups = _shown_groups(np.concatenate([a, b]), group, np.concatenate([piece_a, piece_b]), len(a), n, pair) if shown else []
    return counts, groups, links, n_links


def _shown_groups(ids: np.ndarray, group: np.ndarray, piece: np.ndarray, n_a: int, n: int, pair: Pair) -> list[str]:
    """The groups of each piece as text: every id with the sign that follows it, put together piece by piece."""
    side = np.arange(len(ids)) >= n_a
    order = np.lexsort((side, group))  # stable: tokens of a group and side stay in order
    group, side, piece = group[order], side[order], piece[order]
    same, inside = np.append(group[1:] == group[:-1], False)[: len(ids)], np.append(piece[1:] == piece[:-1], False)[: len(ids)]
    turns = np.append(side[1:] != side[:-1], False)[: len(ids)]
    sign = np.where(same, np.where(turns, 1, 0), np.where(inside, 2, 3))
    words = list(map(pair.names.__getitem__, (ids[order] * 4 + sign).tolist()))
    cuts = [0, *np.cumsum(np.bincount(piece, minlength=n)).tolist()]
    return ["".join(words[i:j]) for i, j in zip(cuts[:-1], cuts[1:])]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def pair_counts(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(a, b, n): id pairs, and how many rows of docs hold each linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Aligned(Pair(*paths), shown=False)
        for batch in batches:
            for _, _, texts in common.text_parts(batch.column("text")):
                chunk, starts = known.of(texts)
                doc = np.repeat(np.arange(len(texts)), np.diff(starts))
                bad = np.bincount(doc[~known.good[chunk]], minlength=len(texts)) > 0
                held = np.unique(doc << SHIFT | chunk)
                held = held[~bad[held >> SHIFT]]
                chunk, doc = held & 0xFFFFFFFF, held >> SHIFT
                n = known.starts[chunk + 1] - known.starts[chunk]
                pairs, which = np.unique(known.links[expanded(known.starts[chunk], n)], return_inverse=True)
                own = np.unique(np.repeat(doc, n) * max(len(pairs), 1) + which)
                counts = np.bincount(own % max(len(pairs), 1), minlength=len(pairs))
                yield pa.RecordBatch.from_arrays([pa.array(pairs >> SHIFT, pa.int32()), pa.array(pairs & 0xFFFFFFFF, pa.int32()), pa.array(counts, pa.int64())], ["a", "b", "n"])

    return _rows(docs).select("text").mapInArrow(run, PAIRS).groupBy("a", "b").agg(F.sum("n").alias("n"))


def align_docs(docs: DataFrame, paths: tuple[str, str] | None = None, max_pairs: int = MAX_PAIRS, digest: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each row; with digest groups_sha256 in place of groups."""
    paths = paths or (public_tokenizers.path(BYTE_TOKENS), public_tokenizers.path(PIECE_TOKENS))
    spark, rows = docs.sparkSession, _rows(docs)
    counts = common.materialise(pair_counts(docs, paths), "pair-counts")
    best = counts.groupBy("a").agg(F.max("n").alias("most"))
    told = counts.join(best, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
    last = "groups_sha256" if digest else "groups"
    if counts.count() <= max_pairs:
        table = told.toArrow()
        keys = table["a"].to_numpy().astype(np.int64) << SHIFT | table["b"].to_numpy()
        order = np.argsort(keys)
        sums = spark.sparkContext.broadcast((keys[order], table["n"].to_numpy()[order] * 2 + table["best"].to_numpy()[order]))
        schema = "doc_id long, " + ", ".join(f"{c} long" for c in [*COUNTS, "n_best", "count_sum"]) + f", {last} string"
        return rows.mapInArrow(lambda batches: _with_sums(batches, paths, digest, last, sums.value), schema)
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + f", {last} string, links array<struct<a int, b int, times int>>"
    linked = rows.mapInArrow(lambda batches: _with_links(batches, paths, digest, last), schema)
    linked = common.materialise(linked.withColumn("align_row", F.monotonically_increasing_id()), "links")
    each = linked.select("align_row", F.explode("links").alias("link")).select("align_row", "link.*")
    held = common.join_by_key(each, told, ["a", "b"], "n")
    sums = held.groupBy("align_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = linked.join(sums, "align_row", "left")
    return out.select("doc_id", *COUNTS, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], last)


def _totals(known: Aligned, values: np.ndarray, chunk: np.ndarray, starts: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Sums over the chunks of each text of values, which have a row a chunk; 0 for bad texts."""
    sums = np.concatenate([np.zeros((1, values.shape[1]), np.int64), np.cumsum(values[chunk], axis=0)])
    return np.where(bad[:, None], 0, sums[starts[1:]] - sums[starts[:-1]])


def _shown(known: Aligned, chunk: np.ndarray, starts: np.ndarray, bad: np.ndarray, digest: bool) -> pa.Array:
    out, numbers = [], chunk.tolist()
    for i, j, none in zip(starts[:-1].tolist(), starts[1:].tolist(), bad.tolist()):
        text = "" if none else ";".join([known.groups[k] for k in numbers[i:j]])
        out.append(hashlib.sha256(text.encode()).hexdigest() if digest and text else text)
    return pa.array(out, pa.string())


def _parts(batches: Iterator[pa.RecordBatch], known: Aligned):
    """(doc_ids, chunk, starts, bad) of parts of the batches."""
    for batch in batches:
        for i, j, texts in common.text_parts(batch.column("text")):
            chunk, starts = known.of(texts)
            wrong = np.concatenate([[0], np.cumsum(~known.good[chunk])])
            yield batch.column("doc_id").slice(i, j - i), chunk, starts, wrong[starts[1:]] > wrong[starts[:-1]]


def _with_sums(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], digest: bool, last: str, sums: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    known, (keys, told) = Aligned(Pair(*paths)), sums
    values, seen = np.zeros((0, 6), np.int64), None
    for ids, chunk, starts, bad in _parts(batches, known):
        if seen is not known.index:  # the chunks were dropped
            values, seen = np.zeros((0, 6), np.int64), known.index
        if len(values) < len(known.good):
            at = known.starts[len(values)]
            slot = np.searchsorted(keys, known.links[at:])
            # texts that do not spell themselves have chunks whose pairs no other text may hold
            slot = np.minimum(slot, max(len(keys) - 1, 0))
            got = np.where(keys[slot] == known.links[at:], told[slot], 0) if len(keys) else np.zeros(len(slot), np.int64)
            ends = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(np.stack([got & 1, got >> 1], axis=1), axis=0)])
            cut = known.starts[len(values) :] - at
            values = np.concatenate([values, np.concatenate([known.counts[len(values) :], ends[cut[1:]] - ends[cut[:-1]]], axis=1)])
        out = _totals(known, values, chunk, starts, bad)
        yield pa.RecordBatch.from_arrays([ids, *map(pa.array, out.T), _shown(known, chunk, starts, bad, digest)], ["doc_id", *COUNTS, "n_best", "count_sum", last])


def _with_links(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], digest: bool, last: str) -> Iterator[pa.RecordBatch]:
    known = Aligned(Pair(*paths))
    kind = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("times", pa.int32())])
    for ids, chunk, starts, bad in _parts(batches, known):
        n = np.where(np.repeat(bad, np.diff(starts)), 0, known.starts[chunk + 1] - known.starts[chunk])
        pairs, which = np.unique(known.links[expanded(known.starts[chunk], n)], return_inverse=True)
        doc = np.repeat(np.repeat(np.arange(len(bad)), np.diff(starts)), n)
        own, times = np.unique(doc * max(len(pairs), 1) + which, return_counts=True)
        pair, doc = pairs[own % max(len(pairs), 1)], own // max(len(pairs), 1)
        links = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (pair >> SHIFT, pair & 0xFFFFFFFF, times)], fields=list(kind))
        offsets = np.searchsorted(doc, np.arange(len(bad) + 1))
        out = _totals(known, known.counts, chunk, starts, bad)
        yield pa.RecordBatch.from_arrays([ids, *map(pa.array, out.T), _shown(known, chunk, starts, bad, digest), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), links)], ["doc_id", *COUNTS, last, "links"])


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_docs(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)

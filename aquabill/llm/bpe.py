r"""BPE encoding and decoding by batched numpy merge rounds.

A text is split at special tokens, normalised (NFC, lower case), and cut into words by the tokenizer's own pattern. Words
that a worker has not seen are encoded together: the symbols of all of them lie in one flat array, and each round looks
up all neighbouring pairs by binary search over the sorted pair keys, takes every word's lowest-rank pair and merges its
occurrences from left to right. Texts are then gathered from the word table. A worker keeps about MAX_WORDS words for all of
its tasks; beyond that those that it met most stay. It works through a batch in parts of a bounded size, so its memory does
not grow with the input.

Merging all occurrences of a pair in one round equals merging them one by one unless a merged symbol enters a pair of lower
rank; `Vocabulary` checks that, and merges only the leftmost occurrence for such ranks.

Defined results: null text is empty text and has no ids. Rows are independent; other columns are not read. Code points
that a newer Unicode version made letters can be cut otherwise than by a library built on an older one.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aquabill.llm import common

TOKENIZER = "word_bpe_49k.json"
MAX_WORDS = 200_000
#: Letters, numbers and blanks of Latin-1, for patterns that run on most texts without Unicode tables.
LATIN = {r"\p{L}": "a-zA-Zªµºß-öø-ÿÀ-ÖØ-Þ", r"\p{N}": "0-9²³¹¼-¾", r"\s": "\t-\r \x85\xa0"}
#: Rank of a pair that no merge joins.
NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, other = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in letters:
            letters[b], other = chr(other), other + 1
    return [letters[b] for b in range(256)]


class Vocabulary:
    """What a tokenizer file holds, as arrays."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        ids, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        self.size = len(self.tokens)
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters], np.int32)
        self.last = np.array([ids[c + suffix] for c in letters], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = np.array([[ids[a], ids[b]] for a, b in merges], np.int64).T
        made = np.array([ids[a + b] for a, b in merges], np.int32)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        # the lowest rank that uses each symbol; a rank that makes a symbol used earlier must go one at a time
        first_use = np.full(self.size, NONE)
        rank = np.arange(len(merges), dtype=np.int32)
        np.minimum.at(first_use, left, rank)
        np.minimum.at(first_use, right, rank)
        self.one_by_one = first_use[made] < rank
        # ranks of all pairs of two bytes, by the same search: the first round asks for nothing else
        pairs = self.inner[:, None].astype(np.int64) * self.size + np.stack([self.inner, self.last])[:, None, :]
        self.byte_ranks = self.rank_of(pairs.ravel()).reshape(2, 256, 256)

    def rank_of(self, pairs: np.ndarray) -> np.ndarray:
        """Ranks of pair keys by binary search, NONE for pairs that no merge joins."""
        found = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[found] == pairs, self.ranks[found], np.int32(NONE))


class Numbers(dict):
    """Words with their numbers; a word that is asked for and not there gets the next one."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Coder:
    """Encodes and decodes lists of texts; holds a bounded table of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.word = regex.compile(vocabulary.pattern)
        latin = vocabulary.pattern
        for name, signs in LATIN.items():
            latin = latin.replace(name, signs)
        self.latin_word = re.compile(latin)
        self.mark = os.path.commonprefix([*vocabulary.special])  # texts without it hold no special token; '' is in all
        self.split = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        # special tokens have entries that no word can have, since words hold no letters after other signs
        self.index = Numbers({"\0" + s: i for i, s in enumerate(vocabulary.special)})
        self.flat = np.array(list(vocabulary.special.values()), np.int32)
        self.starts = np.arange(len(vocabulary.special) + 1, dtype=np.int64)
        self.uses = np.zeros(len(vocabulary.special), np.int64)

    def _shrink(self) -> None:
        """Keeps the special tokens and half of MAX_WORDS words, those met most; what was met earlier counts half from then on."""
        stay = np.zeros(len(self.uses), bool)
        stay[np.argsort(-self.uses, kind="stable")[: MAX_WORDS // 2]] = True
        stay[: len(self.v.special)] = True
        sizes = np.diff(self.starts)
        self.flat, self.starts = self.flat[np.repeat(stay, sizes)], np.concatenate([[0], np.cumsum(sizes[stay])])
        self.uses = self.uses[stay] // 2
        self.index = Numbers(zip(compress(self.index, stay.tolist()), range(len(self.uses))))

    def words(self, text: str) -> list[str]:
        if self.split and self.mark in text and (found := list(self.split.finditer(text))):
            out, at = [], 0
            for m in found:
                out += [*self._plain(text[at : m.start()]), "\0" + m[0]]
                at = m.end()
            return out + self._plain(text[at:])
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # no final sigma
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.word.findall(text)
        return self.latin_word.findall(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and where each text's ids start (one more entry than texts)."""
        words, ends = [], [0]
        for t in texts:
            words += self.words(t)
            ends.append(len(words))
        if len(self.index) > MAX_WORDS:
            self._shrink()
        known = len(self.index)
        which = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if len(self.index) > known:
            self._learn(list(islice(self.index, known, None)))
        self.uses += np.bincount(which, minlength=len(self.uses))
        sizes = np.diff(self.starts)[which]
        stops = np.concatenate([[0], np.cumsum(sizes)])
        take = np.arange(stops[-1]) + np.repeat(self.starts[which] - stops[:-1], sizes)
        return self.flat[take], stops[np.array(ends)]

    def _learn(self, new: list[str]) -> None:
        ids, sizes = self.merge([w.encode("utf-8", "surrogatepass") for w in new])
        self.flat = np.concatenate([self.flat, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one flat array, and how many each word has."""
        lengths = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols, owner = self.v.inner[data], np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        ends = np.cumsum(lengths)[lengths > 0] - 1
        symbols[ends] = self.v.last[data[ends]]
        done_symbols, done_owner = [], []
        ends_word = np.zeros(len(data) + 1, np.int8)
        ends_word[ends] = 1
        ranks = np.append(self.v.byte_ranks[ends_word[1:-1], data[:-1], data[1:]], np.int32(NONE)) if len(data) else np.zeros(0, np.int32)
        ranks[ends] = NONE  # no pair spans two words
        while len(symbols):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.repeat(np.minimum.reduceat(ranks, first), np.diff(first, append=len(owner)))
            over = best == NONE
            if over.any():
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
                symbols, owner, ranks, best = symbols[~over], owner[~over], ranks[~over], best[~over]
                if not len(symbols):
                    break
            hit = ranks == best
            at = np.flatnonzero(hit)
            # of overlapping occurrences (a a a) every second one counts; of ranks that go one by one the first of a word
            run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, np.arange(len(at)), 0))
            good = (np.arange(len(at)) - run) % 2 == 0
            single = self.v.one_by_one[best[at]]
            good &= ~single | (np.diff(owner[at], prepend=-1) > 0)
            at = at[good]
            symbols[at] = self.v.made[best[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, owner, ranks = symbols[stay], owner[stay], ranks[stay]
            # only pairs that hold a merged symbol have a new rank
            at -= np.arange(len(at))
            at = np.concatenate([at, at[at > 0] - 1])
            ranks[at] = self._ranks(symbols, owner, at)
        if not done_symbols:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=len(words))

    def _ranks(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that start at the given symbols."""
        out = np.full(len(at), NONE, np.int32)
        inside = np.flatnonzero(at + 1 < len(symbols))
        left = at[inside]
        same = owner[left] == owner[left + 1]
        left = left[same]
        out[inside[same]] = self.v.rank_of(symbols[left].astype(np.int64) * self.v.size + symbols[left + 1])
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks, as a tokenizer without a decoder does."""
        return " ".join(map(self.v.tokens.__getitem__, ids))


@lru_cache(maxsize=1)
def coder(vocabulary: Vocabulary) -> Coder:
    """The process's coder of a vocabulary (a broadcast one is one object in a worker), so that tasks of a worker know its words."""
    return Coder(vocabulary)


def load(path: str | None = None) -> Vocabulary:
    return Vocabulary(path or public_tokenizers.path(TOKENIZER))


def encode(docs: DataFrame, vocabulary: Vocabulary, decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) of each row's whole text, and decoded: the string that the ids decode to."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of the vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(shared.value)
        for batch in batches:
            for a, b, texts in common.text_parts(batch.column("text")):
                ids, starts = c.encode(texts)
                columns = [batch.column("doc_id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))]
                if decoded:
                    whole = ids.tolist()
                    columns.append(pa.array([c.decode(whole[i:j]) for i, j in zip(starts[:-1], starts[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * decoded)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), load(), decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

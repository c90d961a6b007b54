r"""Language ID by segmentation-marginalised unigrams.

Each language has probabilities over the lower-cased letter pieces of a fixed public vocabulary. A word's probability is the
sum over all its segmentations into pieces, by the forward algorithm; a text's is the product over its words, and the
prediction is the language of the highest posterior under equal priors. Piece probabilities are learned by expectation
maximisation from the word counts of a bounded sample: about `per_lang` labelled documents a language, chosen by a hash.

`surprise` says how far a text is from the language that it is given: its negative log-likelihood a letter by that of the
sample of the language. Natural text has about 1, gibberish and languages unlike the learned ones 2.5 and more. PRIOR_LETTERS
letters of surprise 1 are added, so a short text must be odder than a long one.

A word is a run of letters, lower-cased; words over MAX_WORD letters are cut every MAX_WORD letters, so whole texts count.
The words of a part of a batch are looked up once each, and a task keeps about MAX_WORDS of them.

Defined results: null text or text without a letter is `und` with score and surprise 0. Ties go to the language that sorts first. With no
labelled document every text is `und`. Labelled rows without a doc_id are sampled by their texts. Rows are independent, so repeated rows repeat and an empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aquabill.llm import common

VOCABULARY = "piece_bpe_32k.model"
UNKNOWN = "und"
MARK = "▁"
WORD = re.compile(r"[^\W\d_]+")
MAX_PIECE, MAX_WORD, MAX_WORDS = 10, 32, 100_000
#: Probability of a letter that no piece holds, and pseudo-count of a piece.
RARE, PSEUDO = 1e-7, 0.01
PRIOR_LETTERS = 20
BASE = np.uint64(0x9E3779B97F4A7C15)


def pieces(path: str | None = None) -> list[str]:
    """Distinct lower-cased pieces of letters, with the word mark where they have it."""
    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in found if len(p) <= MAX_PIECE and (p == MARK or p.removeprefix(MARK).isalpha()))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, one row each, padded by zeros; lengths."""
    lengths = np.array([len(w) for w in words])
    out = np.zeros((len(words), lengths.max(initial=1)), np.uint64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, lengths


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    for j in range(codes.shape[1]):
        out[:, j + 1] = out[:, j] * BASE + codes[:, j]
    return out


class Lattice:
    """Finds pieces inside words."""

    def __init__(self, vocabulary: list[str]):
        self.n = len(vocabulary)
        codes, lengths = _codes(vocabulary)
        keys = _prefix_hashes(codes)[np.arange(self.n), lengths]
        self.by_length = {}
        for k in range(1, MAX_PIECE + 1):
            own = np.flatnonzero(lengths == k)
            own = own[np.argsort(keys[own])]
            seen = np.zeros(1 << 18, bool)
            seen[(keys[own] >> np.uint64(46)).astype(np.int64)] = True
            self.by_length[k] = (keys[own], own, seen)

    def edges(self, words: list[str]) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray, np.ndarray]]]:
        """Lengths, and (end, piece length, words, pieces) in order of ends. Piece n stands for an unknown letter."""
        codes, lengths = _codes(words)
        hashes, out = _prefix_hashes(codes), []
        for end in range(1, codes.shape[1] + 1):
            live = np.flatnonzero(lengths >= end)
            for k in range(1, min(end, MAX_PIECE) + 1):
                keys, ids, seen = self.by_length[k]
                h = hashes[live, end] - hashes[live, end - k] * np.uint64(pow(int(BASE), k, 1 << 64))
                may = np.flatnonzero(seen[(h >> np.uint64(46)).astype(np.int64)])
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, h[may]), len(keys) - 1)
                    good = keys[at] == h[may]
                    may, found = may[good], ids[at[good]]
                else:
                    may, found = may[:0], ids[:0]
                if k == 1:  # a letter without a piece of its own
                    rest = np.setdiff1d(np.arange(len(live)), may)
                    may, found = np.concatenate([may, rest]), np.concatenate([found, np.full(len(rest), self.n)])
                if len(may):
                    out.append((end, k, live[may], found))
        return lengths, out


def forward(lengths: np.ndarray, edges: list, p: np.ndarray) -> np.ndarray:
    """alpha[word, end, language]: summed probability of all segmentations of each prefix."""
    alpha = np.zeros((len(lengths), lengths.max(initial=1) + 1, p.shape[1]))
    alpha[:, 0] = 1
    for end, k, w, piece in edges:
        alpha[w, end] += alpha[w, end - k] * p[piece]
    return alpha


def fit(lattice: Lattice, words: list[str], counts: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """Piece probabilities of one language by expectation maximisation, the last one for unknown letters; and the words' negative log-likelihood a letter."""
    use = np.zeros(lattice.n + 1)
    parts = []
    for a in range(0, len(words), 20_000):
        lengths, edges = lattice.edges(words[a : a + 20_000])
        parts.append((lengths, edges, counts[a : a + 20_000]))
        for _, k, w, piece in edges:
            use += np.bincount(piece, parts[-1][2][w] * (1 if k == 1 else k * k), lattice.n + 1)
    for step in range(steps + 1):
        p = (use[:-1] + PSEUDO) / (use[:-1].sum() + PSEUDO * lattice.n)
        p = np.append(p, RARE)[:, None]
        if step == steps:
            break
        use = np.zeros(lattice.n + 1)
        for lengths, edges, n in parts:
            alpha = forward(lengths, edges, p)[:, :, 0]
            beta = np.zeros_like(alpha)
            beta[np.arange(len(lengths)), lengths] = 1
            weight = n / alpha[np.arange(len(lengths)), lengths]
            for end, k, w, piece in reversed(edges):
                into = p[piece, 0] * beta[w, end]
                use += np.bincount(piece, weight[w] * alpha[w, end - k] * into, lattice.n + 1)
                beta[w, end - k] += into
    like = sum((n * np.log(forward(lengths, edges, p)[np.arange(len(lengths)), lengths, 0])).sum() for lengths, edges, n in parts)
    return p[:, 0], -like / sum((n * lengths).sum() for lengths, _, n in parts)


def cut(word: str) -> list[str]:
    """The word with its mark, in parts of MAX_WORD characters."""
    word = MARK + word
    return [word] if len(word) <= MAX_WORD else [word[i : i + MAX_WORD] for i in range(0, len(word), MAX_WORD)]


def learnable(docs: DataFrame) -> DataFrame:
    """Rows that may teach: labelled, with text, and not held out."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, vocabulary: list[str], per_lang: int = 400, steps: int = 3) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, their piece probabilities, one column each, and their negative log-likelihoods a letter. per_lang bounds the documents of a language."""
    rows = learnable(docs).select("doc_id", "lang", "text")
    n = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not n:
        return [], np.zeros((len(vocabulary) + 1, 0)), np.zeros(0)
    # a hash below a bound that leaves about per_lang documents of each language
    bound = F.lit(-1)
    for lang, count in n.items():
        bound = F.when(F.col("lang") == lang, int(min(1.0, per_lang / count) * (1 << 30))).otherwise(bound)
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < bound)
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).groupBy("lang", "word").count()

    def learn(key, table: pd.DataFrame) -> pd.DataFrame:
        lattice, parts, counts = Lattice(vocabulary), [], []
        for word, count in zip(table["word"], table["count"]):
            own = cut(word)
            parts += own
            counts += [count] * len(own)
        p, typical = fit(lattice, parts, np.array(counts, float), steps)
        return pd.DataFrame({"lang": key[0], "p": [p], "typical": typical})

    # a group holds the distinct words of about per_lang documents
    learned = words.groupBy("lang").applyInPandas(learn, "lang string, p array<double>, typical double").collect()
    learned = sorted(learned, key=lambda r: r["lang"])
    p = np.array([r["p"] for r in learned]).T.reshape(len(vocabulary) + 1, len(learned))
    return [r["lang"] for r in learned], p, np.array([r["typical"] for r in learned])


class Scorer:
    """Log-likelihoods of texts; keeps the scores of words it has seen."""

    def __init__(self, vocabulary: list[str], p: np.ndarray):
        self.lattice, self.p = Lattice(vocabulary), p
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.scores = np.zeros((0, self.p.shape[1]))
        self.letters = np.zeros(0)

    def score_words(self, words: list[str]) -> np.ndarray:
        parts, owner = [], []
        for i, w in enumerate(words):
            own = cut(w)
            parts += own
            owner += [i] * len(own)
        order = np.argsort([len(w) for w in parts], kind="stable")  # words of like length together
        out = np.zeros((len(words), self.p.shape[1]))
        owner = np.array(owner)
        for a in range(0, len(order), 8192):
            ids = order[a : a + 8192]
            lengths, edges = self.lattice.edges([parts[i] for i in ids])
            np.add.at(out, owner[ids], np.log(forward(lengths, edges, self.p)[np.arange(len(ids)), lengths]))
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each text in each language, and the letters and marks of its words with a letter."""
        words, ends = [], [0]
        for t in texts:
            words += WORD.findall(t.lower())
            ends.append(len(words))
        if len(self.index) > MAX_WORDS:
            self._clear()
        if new := list(set(words) - self.index.keys()):
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            scores = self.score_words(new)
            scores[[not any(map(str.isalpha, w)) for w in new]] = np.nan  # numerals such as a superscript two
            self.scores = np.concatenate([self.scores, scores])
            self.letters = np.concatenate([self.letters, [len(w) + 1 for w in new]])
        which = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        got = self.scores[which]
        letter = ~np.isnan(got[:, :1])
        total = np.concatenate([np.zeros((1, got.shape[1])), np.cumsum(np.where(letter, got, 0), axis=0)])
        number = np.concatenate([[0], np.cumsum(np.where(letter[:, 0], self.letters[which], 0))])
        ends = np.array(ends)
        return total[ends[1:]] - total[ends[:-1]], number[ends[1:]] - number[ends[:-1]]


def predictor(spark: SparkSession, langs: list[str], vocabulary: list[str], p: np.ndarray, typical: np.ndarray):
    """A column function: text -> struct(lang, score, surprise)."""
    shared = spark.sparkContext.broadcast((vocabulary, p))  # the vocabulary's size times the number of languages

    @F.arrow_udf("struct<lang:string,score:double,surprise:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            names, scores, odd = [], [], []
            for a, b, texts in common.text_parts(batch):
                if not langs:
                    names, scores, odd = names + [UNKNOWN] * (b - a), scores + [0.0] * (b - a), odd + [0.0] * (b - a)
                    continue
                like, n = scorer.score(texts)
                best = like.argmax(axis=1)
                posterior = 1 / np.exp(like - like.max(axis=1, keepdims=True)).sum(axis=1)
                names += [langs[k] if m else UNKNOWN for k, m in zip(best, n)]
                scores += np.where(n > 0, posterior, 0.0).tolist()
                surprise = (PRIOR_LETTERS - like.max(axis=1) / typical[best]) / (PRIOR_LETTERS + n)
                odd += np.where(n > 0, surprise, 0.0).tolist()
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(odd, pa.float64())], ["lang", "score", "surprise"])

    return predict


def identify(docs: DataFrame, vocabulary: list[str] | None = None, per_lang: int = 400):
    """Trains on docs and returns the column function that predict() of other tables can use too."""
    vocabulary = vocabulary or pieces()
    langs, p, typical = train(docs, vocabulary, per_lang)
    return predictor(docs.sparkSession, langs, vocabulary, p, typical)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    got = docs.select("doc_id", identify(docs)("text").alias("got"))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("got.lang").alias("lang_pred"), F.col("got.score").alias("score"))

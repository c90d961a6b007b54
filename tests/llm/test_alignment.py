"""Cross-tokenizer alignment against the libraries on whole texts and a plain alignment."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from aquabill.llm import alignment, bpe

PATHS = public_tokenizers.path(alignment.BYTE_TOKENS), public_tokenizers.path(alignment.PIECE_TOKENS)
ODD = [
    None, "", " ", "  ", "a", "a ", " a  b   c ", "x\n\n  y\t z\r\n", "it's   don't", "<|endoftext|> <s> </s> <0x41> <unk>", "▁x", "a▁b c", "\0 \x1c \x85   z", "naïve façade ñandú 東京 🙂🙂 é",
    "a" * 3000, "ab " * 2000, "0" * 500 + " " * 500 + "0" * 300, "#$%&//\\\\ 12345678901234567890 ...", "   x ​ y", "﻿start", "tab\t\t tab \t x",
]


def brute(rows):
    """One row a document, by definition: whole texts, all pairs of tokens."""
    a_of, b_of = tokenizers.Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a_of.encode_special_tokens = True
    code = {c: b for b, c in enumerate(bpe.byte_letters())}

    def spans(ids, data):
        out, at = [], 0
        for i, d in zip(ids, data):
            out.append((i, at, at + len(d)))
            at += len(d)
        return out

    links, groups, sizes = [], [], []
    for _, text in rows:
        links.append([]), groups.append(""), sizes.append((0, 0, 0))
        if not text:
            continue
        e, ids = a_of.encode(" " + text, add_special_tokens=False), b_of.encode(text)
        da = [bytes(code[c] for c in t) for t in e.tokens]
        db = [bytes([int(p[1:-1], 16)]) if b_of.is_byte(i) else p.replace("▁", " ").encode() for i in ids for p in [b_of.id_to_piece(i)]]
        if b"".join(da) != (" " + text).encode() or b"".join(db) != (" " + text).encode():
            continue
        a, b = spans(e.ids, da), spans(ids, db)
        j = 0
        for x, s, t in a:
            while b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < t:
                links[-1].append((x, b[k][0]))
                k += 1
        cuts = sorted({t for *_, t in a} & {t for *_, t in b})
        shown, low = [], 0
        ai = bi = 0
        for c in cuts:
            left, right = [], []
            while ai < len(a) and a[ai][2] <= c:
                left.append(str(a[ai][0]))
                ai += 1
            while bi < len(b) and b[bi][2] <= c:
                right.append(str(b[bi][0]))
                bi += 1
            shown.append(f"{','.join(left)}|{','.join(right)}")
        groups[-1], sizes[-1] = ";".join(shown), (len(a), len(b), len(cuts))
    counts = Counter(p for own in links for p in set(own))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    return [(i, *size, len(own), sum(counts[p] == best[p[0]] for p in own), sum(counts[p] for p in own), g) for (i, _), size, own, g in zip(rows, sizes, links, groups)]


def texts(n, seed=1):
    rng = random.Random(seed)
    letters = "abcdefg ABC  '.,!?\n\t0123éß東🙂" + " " * 6
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 120))) for _ in range(n)]


@pytest.mark.parametrize("max_pairs", [alignment.MAX_PAIRS, 10])
def test_equals_brute_force(spark, max_pairs):
    rows = list(enumerate([*ODD, *texts(300), "same words here", "same words here"]))
    rows += [(7, "an id that repeats"), (None, "no id at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_a": F.lit("mine"), "links": F.lit(1)}).repartition(5)
    got = alignment.align_docs(docs, PATHS, max_pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: tuple(r) for r in alignment.op12(spark, sf_dir).collect()}
    want = {r[0]: (*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in brute(rows)}
    assert got == want


def test_chunks_that_are_dropped_come_again(spark, monkeypatch):
    pair = alignment.Pair(*PATHS)
    known, one = alignment.Aligned(pair), alignment.Aligned(pair)
    monkeypatch.setattr(alignment, "MAX_CHUNKS", 5)
    for part in (texts(20, 2), texts(20, 3), texts(20, 2)):
        chunk, starts = known.of(part)
        one.clear()
        again, _ = one.of(part)
        assert [known.groups[c] for c in chunk] == [one.groups[c] for c in again] and len(starts) == len(part) + 1


def test_empty_table(spark):
    for most in (alignment.MAX_PAIRS, -1):
        assert alignment.align_docs(spark.createDataFrame([], "doc_id long, text string"), PATHS, most).count() == 0

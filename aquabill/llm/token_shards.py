r"""Training-order materialisation of token sequences in fixed-stride binary shards.

Texts become BPE ids, or come as ids, and are cut into sequences of `length` ids; the last one of a text ends with END and is
filled with PAD. All N sequences of the table are numbered, and a keyed Feistel permutation with cycle-walking gives each
number a slot in [0, N). Rows are range-partitioned by shard (a run of `per_shard` slots), sorted by slot and written:
sequence i of shard s is the record at byte i * stride of the one file in folder shard=s, and holds slot s * per_shard + i.
A reader that stopped after a slot goes on at that byte. Each record begins with the doc_id, the sequence's number in its
document and its number of ids, so shards describe themselves and need no join.

Ids take `width` bytes, 2 or 4 (little end first); the two largest numbers of that width are END and PAD, and ids that reach
them are refused. A record ends with a line feed, which the text sink adds, so that Spark's own commit protocol writes the
shards and a lost task is simply run again.

`encoded` writes each text's ids once to a table, with the writing task's number and the count of that task's sequences
before them. A text's first number is then that count plus the sequences of all earlier tasks, so numbering needs no shuffle
and the driver holds one number a task.

Records cross the shuffle compressed by a dictionary trained on sampled records, since they are too short and too mixed there
to compress by themselves; the dictionary decides nothing but their size.

Defined results: null or empty text (or null ids) is one sequence of END and PAD. Repeated rows are sequences of their own, and
null doc_ids stay null (the smallest 64-bit number stands for them in shards). Other columns are not read. An empty table
writes nothing and gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aquabill.llm import bpe, common

LENGTH, PER_SHARD, KEY = 512, 16_384, 20_240_601
ROUNDS = 6
#: Tasks that write shards, at most.
MAX_TASKS = 20_000
#: Before a record's ids: doc_id, seq_no, n_tokens.
HEAD, NO_ID = "<qiH", -(1 << 63)
HEAD_BYTES = struct.calcsize(HEAD)
#: Ids of a text that are sampled for the dictionary, and the dictionary's bytes.
SAMPLE_IDS, DICTIONARY_BYTES = 2048, 1 << 19
LEVEL = 5


def marks(width: int) -> tuple[int, int]:
    """END and PAD of ids of width bytes."""
    return (1 << 8 * width) - 2, (1 << 8 * width) - 1


def feistel(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slots of the numbers: a permutation of [0, n) chosen by key."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, half_ = np.uint64((1 << half) - 1), np.uint64(half)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half_, x & mask
        for r in range(ROUNDS):
            h = right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % (1 << 64))
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h ^ (h >> np.uint64(31))) & mask)
        out[todo] = left << half_ | right
        todo = todo[out[todo] >= n]  # walk on from places outside
    return out.astype(np.int64)


def encoded(table: DataFrame, path: str, length: int, vocabulary: bpe.Vocabulary | None = None, width: int = 2) -> DataFrame:
    """(doc_id, ids: `width` bytes each, part, before) of each row, written to path and read from there.

    table has doc_id and text, or without a vocabulary doc_id and ids array<int>. before counts the sequences that the
    task `part` cut before.
    """
    end = marks(width)[0]
    shared = table.sparkSession.sparkContext.broadcast(vocabulary) if vocabulary else None

    def flat(batch: pa.RecordBatch, coder: bpe.Coder | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        if coder:
            for a, b, texts in common.text_parts(batch.column("text")):
                yield a, b, *coder.encode(texts)
        else:
            column = batch.column("ids")
            sizes = [len(x) if x.is_valid else 0 for x in column]
            yield 0, len(batch), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, before, part = bpe.coder(shared.value) if shared else None, 0, TaskContext.get().partitionId()
        for batch in batches:
            for a, b, ids, starts in flat(batch, coder):
                if len(ids) and not 0 <= ids.min() <= ids.max() < end:
                    raise ValueError(f"ids from {ids.min()} to {ids.max()} do not fit in {width} bytes beside END and PAD")
                count = np.diff(starts) // length + 1
                at = before + np.cumsum(count) - count
                before += int(count.sum())
                buffers = [None, pa.py_buffer((starts * width).astype(np.int32)), pa.py_buffer(ids.astype(f"<u{width}"))]
                columns = [batch.column("doc_id").slice(a, b - a), pa.Array.from_buffers(pa.binary(), b - a, buffers), pa.array(np.full(b - a, part), pa.int32()), pa.array(at)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "part", "before"])

    schema = "doc_id long, ids binary, part int, before long"
    source = "text" if vocabulary else F.col("ids").cast("array<int>").alias("ids")
    rows = table.select(F.col("doc_id").cast("long").alias("doc_id"), source).mapInArrow(run, schema)
    rows.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "6").parquet(path)
    return table.sparkSession.read.schema(schema).parquet(path)


def offsets(ids: DataFrame, length: int, width: int) -> tuple[np.ndarray, int]:
    """The number of the first sequence of each task that wrote ids, and the number of all."""
    n = F.floor(F.octet_length("ids") / (length * width)).cast("long") + 1
    got = ids.groupBy("part").agg(F.max(F.col("before") + n).alias("n")).toArrow()  # one row a task
    counts = np.zeros(max(got.column("part").to_pylist(), default=-1) + 2, np.int64)
    counts[got.column("part").to_numpy() + 1] = got.column("n").to_numpy()
    ends = np.cumsum(counts)
    return ends[:-1], int(ends[-1])


def dictionary(ids: DataFrame, length: int, width: int, texts: int = 2000) -> bytes:
    """A compression dictionary for records, trained on those of at most so many texts; empty if these are too few."""
    rows = ids.select(F.substring("ids", 1, SAMPLE_IDS * width).alias("x")).where(F.octet_length("ids") > 0).limit(texts).collect()
    size = length * width
    records = [b"\0" * HEAD_BYTES + bytes(r["x"])[k : k + size] for r in rows for k in range(0, len(r["x"]), size)]
    if len(records) < 100:
        return b""
    total = sum(map(len, records))
    return zstandard.train_dictionary(min(DICTIONARY_BYTES, total // 4), records, level=LEVEL).as_bytes()


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def sequences(ids: DataFrame, length: int, key: int, trained: bytes = b"", width: int = 2) -> tuple[DataFrame, int]:
    """(slot, packed binary: HEAD and ids, compressed) of a table of encoded(), and the number of sequences."""
    size, (end, pad) = length * width, (m.to_bytes(width, "little") for m in marks(width))
    first, total = offsets(ids, length, width)
    shared = ids.sparkSession.sparkContext.broadcast(first)  # eight bytes a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(trained), write_checksum=False, write_dict_id=False).compress
        for batch in batches:
            docs, texts = batch.column("doc_id").to_pylist(), batch.column("ids")
            begin = shared.value[batch.column("part").to_numpy()] + batch.column("before").to_numpy()
            for a in range(0, len(batch), 1000):
                numbers, records = [], []
                for i in range(a, min(a + 1000, len(batch))):
                    data = (texts[i].as_py() or b"") + end
                    n = -(-len(data) // size)
                    numbers.append(np.arange(begin[i], begin[i] + n))
                    doc = NO_ID if docs[i] is None else docs[i]
                    whole = data + pad * ((n * size - len(data)) // width)
                    records += [pack(struct.pack(HEAD, doc, k, min(length, len(data) // width - k * length)) + whole[k * size : (k + 1) * size]) for k in range(n)]
                slots = feistel(np.concatenate(numbers), total, key)
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(records, pa.binary())], ["slot", "packed"])

    return ids.mapInArrow(run, "slot long, packed binary"), total


def write_shards(rows: DataFrame, total: int, path: str, per_shard: int, trained: bytes = b"") -> None:
    """Writes shards under path: one file a shard, records in slot order. trained must be the dictionary given to sequences()."""
    shards = max(1, -(-total // per_shard))
    parts = min(shards, MAX_TASKS)
    shard = F.floor(F.col("slot") / per_shard).cast("int")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = zstandard.ZstdDecompressor(dict_data=_dictionary(trained)).decompress
        for batch in batches:
            records = [whole(x) for x in batch.column("packed").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("slot"), pa.array(records, pa.binary())], ["slot", "record"])

    # the ranges are known, so no sampling pass is needed to find them: each task gets a run of whole shards
    task = F.floor(shard.cast("long") * parts / shards).cast("int")
    dealt = rows.repartitionById(parts, task).mapInArrow(unpack, "slot long, record binary").withColumn("shard", shard)
    # binary to string keeps the bytes as they are
    dealt.sortWithinPartitions("shard", "slot").select(F.col("record").cast("string").alias("value"), "shard").write.partitionBy("shard").option("lineSep", "\n").text(path)


def read_shards(spark: SparkSession, path: str, length: int, per_shard: int, first_slot: int = 0, width: int = 2) -> DataFrame:
    """(slot, shard, byte_offset, doc_id, seq_no, n_tokens, tokens) from first_slot on; earlier shards are not opened."""
    stride = HEAD_BYTES + length * width + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content")):
                data = content.as_py()
                if len(data) % stride:
                    raise ValueError(f"shard {shard} has a part of a record")
                begin = max(0, first_slot - shard * per_shard)
                for a in range(begin, len(data) // stride, 2000):
                    k = np.arange(a, min(a + 2000, len(data) // stride))
                    heads = [struct.unpack_from(HEAD, data, i * stride) for i in k.tolist()]
                    doc, seq, size = (list(x) for x in zip(*heads))
                    tokens = [data[i * stride + HEAD_BYTES : (i + 1) * stride - 1] for i in k.tolist()]
                    columns = [pa.array(k + shard * per_shard), pa.array(np.full(len(k), shard), pa.int32()), pa.array(k * stride), pa.array([None if d == NO_ID else d for d in doc], pa.int64()), pa.array(seq, pa.int32()), pa.array(size, pa.int32()), pa.array(tokens, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["slot", "shard", "byte_offset", "doc_id", "seq_no", "n_tokens", "tokens"])

    files = spark.read.format("binaryFile").load(path).where(F.col("shard") >= first_slot // per_shard)
    return files.select("shard", "content").mapInArrow(run, "slot long, shard int, byte_offset long, doc_id long, seq_no int, n_tokens int, tokens binary")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "shards")
    ids = encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), common.new_path(spark, "ids"), LENGTH, bpe.load())
    trained = dictionary(ids, LENGTH, 2)
    rows, total = sequences(ids, LENGTH, KEY, trained)
    if not total:
        return spark.createDataFrame([], "slot long, shard int, byte_offset long, doc_id long, seq_no int, n_tokens int, tokens_sha256 string")
    write_shards(rows, total, path, PER_SHARD, trained)
    back = read_shards(spark, path, LENGTH, PER_SHARD)
    return back.select("slot", "shard", "byte_offset", "doc_id", "seq_no", "n_tokens", F.sha2("tokens", 256).alias("tokens_sha256"))

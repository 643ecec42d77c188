"""Token ids in patched frame-of-reference segments.

Blocks of 128 ids: the block's minimum is subtracted, the rest packed at the
width that holds 90 % of the block, larger values go to the block's exception
list. A segment is self-contained (magic, index of block starts, blocks, CRC) and
holds whole documents; segments are rows of Parquet files in the shared folder, so
any store that Spark writes will do, and a repeated task replaces its output whole.

Documents are range-partitioned and sorted by id before they are encoded, so
that the files are in ascending order and only partition totals reach the driver.

Defined cases: a null text counts as empty and gives the end id alone; null ids
come first; rows with equal ids are ordered by a hash of the text, then the text; other columns are passed over.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from .bpe import byte_symbols
from .common import give_back, remembers, serve, shared_dir, small_batches

BLOCK = 128
#: The place, within a sorted block, of the value whose width the block gets.
PERCENTILE = (BLOCK * 9 + 9) // 10 - 1
#: Ids after which a segment is closed, at the next document's end.
SEGMENT = 1 << 18
MAGIC = b"PFR1"
#: Characters of a text that are encoded at once, at least.
PART = 1 << 18
BETWEEN_WORDS = re.compile("[a-z] (?=[a-z])")
#: Separators below U+0250 that not everyone counts as white space.
ODD_ASCII, ODD_SPACE = "\x1c\x1d\x1e\x1f", "\x85\xa0"


class WholeTextEncoder:
    """A byte-level BPE file over whole texts, one text at a time.

    Where the file is plain (no normalizer, the usual byte-level pieces, tokens numbered in
    the order of their merges) its vocabulary is also given to tiktoken, which takes a third of the
    time; texts of letters that all Unicode versions class alike go there. All else,
    texts that hold a special token among them, goes through the tokenizers library.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.core = plain_core(spec)

    def quick(self, text: str) -> bool:
        """Whether both libraries cut the text alike."""
        if self.core is None or any(t in text for t in self.special):
            return False
        return not any(c in text for c in ODD_ASCII) and (text.isascii() or max(text) < "\u0250" and not any(c in text for c in ODD_SPACE))

    def ids(self, text: str) -> np.ndarray:
        if self.quick(text):
            return np.array(self.core.encode_ordinary(text), self.dtype)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)

    def encode(self, text: str | None) -> bytes:
        """Packed ids. A very long text is cut between two letters' words, where a piece always begins."""
        text = (text or "").encode("utf-8", "replace").decode()
        out, start = [], 0
        while len(text) - start > 2 * PART and (cut := BETWEEN_WORDS.search(text, start + PART)):
            out.append(self.ids(text[start : cut.start() + 1]).tobytes())
            start = cut.start() + 1
        out.append(self.ids(text[start:]).tobytes())
        return out[0] if len(out) == 1 else b"".join(out)


def plain_core(spec: dict):
    """tiktoken's encoder of the same vocabulary, or None where the file is not plain."""
    model, pieces = spec["model"], spec["pre_tokenizer"] or {}
    usual = pieces.get("type") == "ByteLevel" and pieces.get("use_regex", True) and not pieces.get("add_prefix_space")
    odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
    if spec["normalizer"] or not usual or any(odd):
        return None
    byte_of, vocab = {c: b for b, c in enumerate(byte_symbols())}, model["vocab"]
    pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
    merged = [vocab["".join(p)] for p in pairs]
    special = {t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if i not in special}
    in_order = merged == list(range(256, 256 + len(merged))) and sorted(vocab[c] for c in byte_of) == list(range(256))
    if not in_order or len(ranks) != 256 + len(merged):
        return None
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe


@lru_cache(2)
def whole_text_encoder(path: str) -> WholeTextEncoder:
    remembers(__name__, whole_text_encoder.cache_clear)
    return WholeTextEncoder(path)


def pack(ids: np.ndarray) -> bytes:
    """One segment of unsigned ids below 2**32."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    x = np.empty(blocks * BLOCK, np.int64)
    x[:n] = ids
    x[n:] = ids[-1] if n else 0
    x = x.reshape(blocks, BLOCK)
    least = x.min(1) if n else np.zeros(0, np.int64)
    x -= least[:, None]
    powers = 1 << np.arange(33, dtype=np.int64)
    width = np.searchsorted(powers, np.partition(x, PERCENTILE, 1)[:, PERCENTILE], "right") if n else least
    high = x >> width[:, None]
    row, place = np.nonzero(high)
    extra = np.bincount(row, minlength=blocks)
    size = 6 + width * (BLOCK // 8) + 5 * extra
    start = np.concatenate([[0], np.cumsum(size)])
    body = np.zeros(start[-1], np.uint8)
    start = start[:-1]
    body[start[:, None] + np.arange(4)] = least.astype("<u4").view(np.uint8).reshape(-1, 4)
    body[start + 4], body[start + 5] = width, extra
    for w in np.unique(width):
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        kind, bits = ("<u2", 16) if w <= 16 else ("<u4", 32)
        low = (x[rows] & ((1 << int(w)) - 1)).astype(kind)
        flat = np.unpackbits(low.view(np.uint8).reshape(-1, bits // 8), axis=1, count=int(w), bitorder="little")
        body[start[rows][:, None] + 6 + np.arange(w * BLOCK // 8)] = np.packbits(flat.reshape(len(rows), -1), axis=1, bitorder="little")
    nth = np.arange(len(row)) - np.repeat(np.cumsum(extra) - extra, extra)
    at = start[row] + 6 + width[row] * (BLOCK // 8)
    body[at + nth] = place
    body[(at + extra[row] + 4 * nth)[:, None] + np.arange(4)] = high[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    head = MAGIC + np.array([n, blocks], "<u4").tobytes() + start.astype("<u4").tobytes()
    whole = head + body.tobytes()
    return whole + zlib.crc32(whole).to_bytes(4, "little")


def unpack(segment: bytes) -> np.ndarray:
    """The ids of a segment; a damaged one raises ValueError."""
    if segment[:4] != MAGIC or zlib.crc32(segment[:-4]) != int.from_bytes(segment[-4:], "little"):
        raise ValueError("damaged segment")
    n, blocks = np.frombuffer(segment, "<u4", 2, 4).tolist()
    start = np.frombuffer(segment, "<u4", blocks, 12).astype(np.int64)
    body = np.frombuffer(segment, np.uint8, offset=12 + 4 * blocks)
    least = np.ascontiguousarray(body[start[:, None] + np.arange(4)]).view("<u4").ravel().astype(np.int64)
    width, extra = body[start + 4].astype(np.int64), body[start + 5].astype(np.int64)
    x = np.zeros((blocks, BLOCK), np.int64)
    for w in np.unique(width):
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        kind, bits = ("<u2", 16) if w <= 16 else ("<u4", 32)
        flat = np.unpackbits(body[start[rows][:, None] + 6 + np.arange(w * BLOCK // 8)], axis=1, bitorder="little")
        wide = np.zeros((len(rows) * BLOCK, bits), np.uint8)
        wide[:, :w] = flat.reshape(-1, w)
        x[rows] = np.packbits(wide, axis=1, bitorder="little").view(kind).reshape(len(rows), BLOCK)
    row = np.repeat(np.arange(blocks), extra)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(extra) - extra, extra)
    at = start[row] + 6 + width[row] * (BLOCK // 8)
    high = np.ascontiguousarray(body[(at + extra[row] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").ravel()
    x[row, body[at + nth]] |= high.astype(np.int64) << width[row]
    return (x + least[:, None]).ravel()[:n].astype("<u4")


FILES = "part int, seq int, first bigint, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, payload binary"


def write_token_files(docs: DataFrame, path: str, end_id: int, target: str, *, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id``, and write segments in ascending id order."""
    spark = docs.sparkSession
    small_batches(spark)
    arrow = to_arrow_schema(T.StructType.fromDDL(FILES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve(__name__)
        encoder, part = whole_text_encoder(path), TaskContext.get().partitionId()
        end = np.array([end_id], encoder.dtype).tobytes()
        seq, first, held, owners, sizes, waiting = 0, 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), encoder.dtype)
            row = {"part": [part], "seq": [seq], "first": [first], "n_ids": [len(ids)], "doc_ids": [list(owners)], "lengths": [list(sizes)], "payload": [pack(ids)]}
            return pa.RecordBatch.from_pydict(row, schema=arrow)

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append(encoder.encode(text.as_py()) + end)
                owners.append(name)
                sizes.append(len(held[-1]) // encoder.dtype.itemsize)
                waiting += sizes[-1]
                if waiting >= SEGMENT:
                    yield close()
                    seq, first, held, owners, sizes, waiting = seq + 1, first + waiting, [], [], [], 0
        if owners:
            yield close()
        give_back()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    order = [F.asc_nulls_first(c) for c in ("doc_id", "hash", "text")]
    # the hash parts rows of one id, or of none, into several ranges
    dealt = rows.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)
    dealt.select("doc_id", "text").mapInArrow(run, FILES).write.parquet(target)


def read_token_files(spark, source: str, *, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids``.

    Each part's first id is the sum of the parts before it: one number a partition."""
    files = spark.read.schema(FILES).parquet(source)
    totals = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, at = [], 0
    for part, n in totals:
        before.append((part, at))
        at += n
    base = spark.createDataFrame(before, "part int, base bigint")
    schema = T.StructType.fromDDL("part int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                packed = unpack(row["payload"]).tobytes()
                size = np.array(row["lengths"], np.int64)
                stop = np.cumsum(size)
                cut = [packed[4 * (b - n) : 4 * b] for b, n in zip(stop.tolist(), size.tolist())]
                out = {
                    "part": [row["part"]] * len(size),
                    "doc_id": row["doc_ids"],
                    "local": row["first"] + stop - size,
                    "n_tokens": size,
                    "ids_crc32": [zlib.crc32(c) for c in cut],
                }
                yield pa.RecordBatch.from_pydict(out | ({"ids": cut} if with_ids else {}), schema=arrow)

    small_batches(spark)
    found = files.select("part", "first", "doc_ids", "lengths", "payload").mapInArrow(run, schema)
    return found.join(F.broadcast(base), "part").select(
        "doc_id", (F.col("local") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids
    )


def token_files(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    target = shared_dir(docs.sparkSession, "token-files")
    write_token_files(docs, path, end_id, target)
    return read_token_files(docs.sparkSession, target)

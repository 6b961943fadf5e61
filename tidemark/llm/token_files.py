"""Token-ID output: Parquet files of documents with a list column of ids, laid out for selective reads.

Documents are range-partitioned and sorted by doc_id, so a file holds one range and its statistics and page indexes
prune by id. Integer columns are delta-encoded (writer version 2, no dictionary), row groups and pages are small. A
reader of doc_id and n_tokens never touches the ids. Every row knows its place within its file (`part`, `local_start`);
the global place follows from the totals of the parts, which are as few as the files.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from .bpe import byte_alphabet
from .common import id_and_text, pieces, raw_texts, scratch_path, spans_of, tidy

END_ID = 2
ROW_GROUP_BYTES = 8 << 20
PAGE_BYTES = 64 << 10
MEMO = 400_000  # stretches of text in each of a worker's two generations
SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


class LibraryEncoder:
    """The tokenizers library behind a memo of bounded size.

    The vocabulary's words never span white space, so a text's ids are those of its stretches without white space, in
    turn; only new stretches of the lower-case text are given to the library. Of these, plain words of Latin letters need no
    normaliser and go to the library's model in its byte letters; others go through the whole tokenizer. So does the whole
    text where it may hold special tokens, isn't in normal form, has letters whose lower case depends on others, or
    control characters on which notions of white space differ.
    """

    MARKS = frozenset(".,;:!?")

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.letters = {b: c for b, c in byte_alphabet().items() if ord(c) != b}
        self.memo: dict[str, bytes] = {}  # by stretch; older ones move to the second dictionary
        self.old: dict[str, bytes] = {}
        self.marks = {m: self._ask(m) for m in self.MARKS}

    def _ask(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<i4").tobytes()

    def _stretch(self, chunk: str) -> bytes:
        if chunk in self.old:
            return self.old[chunk]
        if chunk[-1] in self.MARKS and len(chunk) > 1 and _plain(stem := chunk[:-1]):
            return (self.memo.get(stem) or self.old.get(stem) or self._word(stem)) + self.marks[chunk[-1]]
        return self._word(chunk) if _plain(chunk) else self._ask(chunk)

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("i", [t.id for t in self.model.tokenize(word)]).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if "<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return np.frombuffer(self._ask(text), "<i4")
        if not text.isascii() and ("\u03a3" in text or "\u0130" in text or not unicodedata.is_normalized("NFC", text)):
            return np.frombuffer(self._ask(text), "<i4")
        memo, chunks = self.memo, text.lower().split()
        if new := set(chunks).difference(memo):
            if len(memo) > MEMO:
                self.old, self.memo = memo, {}
                memo, new = self.memo, set(chunks)
            for c in new:
                memo[c] = self._stretch(c)
        out = np.frombuffer(b"".join(map(memo.__getitem__, chunks)), "<i4")
        for c in new:
            if len(c) > 64:
                del memo[c]
        return out


def _plain(word: str) -> bool:
    """Lower-case letters of the Latin blocks."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250")


@lru_cache(2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def encoded(docs: DataFrame, vocabulary_path: str, n_files: int, end_id: int = END_ID) -> DataFrame:
    """Rows of SCHEMA in ascending doc_id order: partition by partition, and within each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = library_encoder(vocabulary_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in pieces(batch, 4 << 20):
                ids = [encoder.encode(raw.decode("utf-8", "replace")) for raw in raw_texts(piece.column(1))]
                sizes = np.array([len(x) + 1 for x in ids])
                starts = start + spans_of(sizes)
                end = np.array([end_id], "<i4")
                flat = np.concatenate([y for x in ids for y in (x, end)])
                lists = pa.ListArray.from_arrays(pa.array(spans_of(sizes), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.record_batch([piece.column(0), pa.array(np.full(len(ids), part), pa.int32()), pa.array(starts[:-1], pa.int64()), pa.array(sizes, pa.int64()), lists], ["doc_id", "part", "local_start", "n_tokens", "ids"])
                start = int(starts[-1])

    # The checksum of the text divides the rows of one id, however many, between files.
    check = F.crc32(F.coalesce("text", F.lit("")))
    ordered = id_and_text(docs).withColumn("check", check).repartitionByRange(n_files, "doc_id", "check").sortWithinPartitions("doc_id", "check", "text").drop("check")
    return ordered.mapInArrow(tidy(run), SCHEMA)


def write_token_files(docs: DataFrame, path: str, vocabulary_path: str, n_files: int | None = None, end_id: int = END_ID) -> None:
    """Encodes every whole text (null: empty), appends end_id, and writes the files to path, in doc_id order.

    Ties of doc_id are ordered by the text's CRC-32, then by text; documents without doc_id come first; an empty table writes files without rows.
    """
    n_files = n_files or max(1, docs.rdd.getNumPartitions())
    (
        encoded(docs, vocabulary_path, n_files, end_id).write.option("compression", "zstd")
        .option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false")
        .option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES).option("parquet.page.row.count.limit", 2000)
        .parquet(path)
    )


def token_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def with_start(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """Adds `start`, the ids of all rows before it: the totals of the parts before, and its place in its own part.

    metadata: the same files' part and n_tokens; a few numbers for each file are summed, no ids are read.
    """
    totals = metadata.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("part", before.alias("base"))
    return rows.join(bases, "part").withColumn("start", F.col("base") + F.col("local_start"))


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of some documents: statistics and page indexes skip the pages of others."""
    return token_rows(spark, path).filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets = lists.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
            crc = [zlib.crc32(data[a * 4 : b * 4]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            sizes = np.diff(offsets).astype(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    rows = token_rows(spark, path)
    read = rows.select("doc_id", "part", "local_start", "ids").mapInArrow(tidy(run), "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return with_start(read, rows.select("part", "n_tokens")).select("doc_id", "start", "n_tokens", "ids_crc32")


def token_file_digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Writes the token files of docs to the shared scratch folder and returns token_digests() of them."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, vocabulary_path)
    return token_digests(docs.sparkSession, path)

"""Operator 1: token ids in ORC files.

Integer run-length encoding packs the id lists; row indexes and Bloom filters on doc_id let a reader skip
stripes; readers take stripes in parallel.  Documents are range-partitioned by id, so files and stripes follow
ascending ids, and each row keeps its start within its file's part.  Global starts come from one total per part.

Strings that name a special token get its id, as the library gives them.  Null and empty texts have just the end id.  Null ids come first; rows with equal ids are ordered by their text's hash
and each keeps its own row.  An empty table gives empty files.  Only the id and text columns of the input are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm import common

#: Pieces whose ids a worker remembers; beyond that it keeps those that came again, so memory is bounded.
CACHE_PIECES = 400_000
#: Words that the library encodes as one text.
TOGETHER = 64
#: Bytes of text that one pass of the encoder holds.
BLOCK_BYTES = 4 << 20
#: ORC writer settings: integer run-length encoding is the writer's default, Bloom filters and row indexes are named here.
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "2000",
    "orc.stripe.size": str(32 << 20),
}
STORED = "part int, local_start long, doc_id long, n_tokens long, ids array<int>"

#: Texts of ASCII and Latin-1 letters: normalisation leaves them, and spaces around runs of marks change no token.
_SIMPLE = re.compile(r"[\t\n -&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_MARKS = re.compile(r"[!-&(-/:-@\[-`{-~]+")
#: Pieces that the tokenizer's pattern takes as one word.
_WORD = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+|[!-&(-/:-@\[-`{-~]+")


class Encoder:
    """The library's tokenizer behind a bounded cache.

    No token of this vocabulary holds white space, so texts are cut at spaces and line ends, simple ones also at marks.
    Each new piece is encoded once.  Pieces that are one word go to the library many at a time as one text, whose ids
    fall apart at the tokens that end a word; other pieces are encoded one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that the library takes for special tokens before it looks at words.
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)", re.IGNORECASE)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.pieces: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str]:
        """Pieces that the tokenizer takes apart from each other; one that names a special token stays whole and goes to the library alone."""
        if _SIMPLE.fullmatch(text) and not self.special.search(text):
            return _MARKS.sub(r" \g<0> ", text.lower()).split()
        return text.replace("\n", " ").split(" ")

    def learn(self, new: list[str]) -> None:
        """Put new pieces into the cache."""
        words = [p for p in new if _WORD.fullmatch(p) and not self.special.search(p)]
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        for own, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<i4")
            at = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            raw = ids.tobytes()
            self.pieces.update(zip(own, (raw[i:j] for i, j in zip([0, *at[:-1]], at, strict=True)), strict=True))
        rest = [p for p in new if p not in self.pieces]
        for p, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False), strict=True):
            self.pieces[p] = np.array(e.ids, "<i4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers, as the library gives for the whole text."""
        cut = [self.cut(t) for t in texts]
        used = set().union(*cut)
        new = used - self.pieces.keys()
        self.learn(list(new))
        look = self.pieces.__getitem__
        out = [b"".join(map(look, ws)) for ws in cut]
        if len(self.pieces) > CACHE_PIECES:
            self.pieces = {p: self.pieces[p] for p in used - new}
        return out


_state: dict[str, Encoder] = {}


def encode_texts(texts: list[str], tokenizer_path: str) -> list[bytes]:
    """The ids of each text by this worker's encoder."""
    if tokenizer_path not in _state:
        _state.clear()
        _state[tokenizer_path] = Encoder(tokenizer_path)
    return _state[tokenizer_path].encode(texts)


def encode(docs: DataFrame, tokenizer_path: str, end_id: int, partitions: int | None = None) -> DataFrame:
    """(part, local_start, doc_id, n_tokens, ids), range-partitioned and sorted by doc_id."""
    common.bound_batches(docs.sparkSession)
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(n, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
    )
    end = np.array([end_id], "<i4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("token_orc", _state.clear)
        part, start = TaskContext.get().partitionId(), 0
        for whole in batches:
            for b in common.blocks(whole, 1, BLOCK_BYTES):
                rows = [x + end for x in encode_texts(common.texts(b.column(1)), tokenizer_path)]
                sizes = np.array([len(x) // 4 for x in rows], np.int64)
                starts = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                flat = np.frombuffer(b"".join(rows), "<i4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), part, np.int32)), pa.array(starts), b.column(0), pa.array(sizes), common.int_lists(flat, sizes)],
                    ["part", "local_start", "doc_id", "n_tokens", "ids"],
                )

    return ordered.select("doc_id", "text").mapInArrow(run, STORED)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, partitions: int | None = None) -> None:
    """Encode docs and write the ORC files."""
    encode(docs, tokenizer_path, end_id, partitions).write.options(**ORC_OPTIONS).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows; a filter on doc_id prunes stripes through their indexes and Bloom filters."""
    return spark.read.schema(STORED).orc(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, offset): ids before each part.  One row a part, so its size is bound by the number of parts."""
    totals = read(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("offset"))


def map_ids(stored: DataFrame, schema: str, per_list: Callable[[memoryview], int]) -> DataFrame:
    """(part, local_start, doc_id, n, value): a whole-number digest of each stored id list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            flat = memoryview(np.ascontiguousarray(pc.list_flatten(ids).to_numpy(zero_copy_only=False), "<i4").tobytes())
            ends = np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False)) * 4
            spans = list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)) if len(ends) else []
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([(e - s) // 4 for s, e in spans], pa.int64()), pa.array([per_list(flat[s:e]) for s, e in spans], pa.int64())],
                ["part", "local_start", "doc_id", "n_tokens", "value"],
            )

    return stored.select("part", "local_start", "doc_id", "ids").mapInArrow(run, schema)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files."""
    rows = map_ids(read(spark, path), "part int, local_start long, doc_id long, n_tokens long, value long", zlib.crc32)
    return rows.join(F.broadcast(starts(spark, path)), "part").select(
        "doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", F.col("value").alias("ids_crc32")
    )


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, write ORC, read it back."""
    import public_tokenizers

    path = common.scratch(spark, "token-orc")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return digest(spark, path)

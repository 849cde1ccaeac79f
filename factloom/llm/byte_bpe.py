"""Operator 6: byte-level BPE by merge replay over a corpus of words.

The texts of a block are cut into pattern matches; the distinct ones form one corpus of words.  An inverted index
leads from pairs of adjacent tokens to the positions where they stand in that corpus, and every merge that occurs is
applied in rank order to all its positions at once, touching the two neighbours of each position only.  Pairs that make
the same token share an entry, since where they overlap the leftmost goes first.  Merges never cross words, so the ids of a
block are those that a replay over the whole corpus would give, and blocks need no shuffle.

Null and empty texts have no ids.  Rows keep their order, repeats and ids, and other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import common

#: Words whose ids a worker remembers; beyond that it keeps those that came again in a later block, so memory is bounded.
CACHE_WORDS = 350_000
#: Bytes of text in a block, and so in one corpus of the replay.
BLOCK_BYTES = 4 << 20
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

#: Texts of ASCII and Latin-1 letters, for which the standard library's engine cuts as the pattern does, but faster.
_SIMPLE = re.compile(r"[\t\n -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
#: Fixed value: public_tokenizers.PATTERN with its character classes written out for such texts.
_SIMPLE_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+|\s+(?!\S)|\s+")


class MergeReplay:
    """Ranks of a vocabulary and the replay of its merges."""

    def __init__(self, rank_path: str):
        with open(rank_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {r: t for t, r in self.ranks.items()}
        self.byte = [self.ranks[bytes([i])] for i in range(256)]
        # every pair of tokens that joins to a token: about five for each token, so its size is bound by the vocabulary
        self.joined = {}
        for t, r in self.ranks.items():
            for k in range(1, len(t)):
                x, y = self.ranks.get(t[:k]), self.ranks.get(t[k:])
                if x is not None and y is not None:
                    self.joined[x << 20 | y] = r

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word.

        All words lie in one array, apart by a gap.  `at` is the inverted index: rank of the merge -> positions of its
        left token.  Ranks leave the heap in order, and a merge changes the pairs with its two neighbours only.  Where
        it makes a pair of a lower rank, that is replayed first, as it would be in the word alone.
        """
        if not words:
            return []
        ids: list[int] = []
        begins: list[int] = []
        for w in words:
            begins.append(len(ids))
            whole = self.ranks.get(w)  # as the library does: a word of the vocabulary is its own id
            ids += [whole] if whole is not None else [self.byte[x] for x in w]
            ids.append(-1)
        n = len(ids)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        join = self.joined.get
        at: dict[int, set[int]] = {}
        for i in range(n - 1):
            x, y = ids[i], ids[i + 1]
            if x >= 0 and y >= 0 and (r := join(x << 20 | y)) is not None:
                if r in at:
                    at[r].add(i)
                else:
                    at[r] = {i}
        heap = list(at)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            live = at.pop(rank)
            for i in sorted(live) if len(live) > 1 else tuple(live):  # leftmost first: overlapping pairs, as in a run, go away
                if i not in live:
                    continue
                live.discard(i)
                gone, before, lower = right[i], left[i], False
                after = right[gone]
                if before >= 0 and (x := ids[before]) >= 0:
                    if (r := join(x << 20 | ids[i])) is not None:
                        (live if r == rank else at.get(r, live)).discard(before)
                    if (r := join(x << 20 | rank)) is not None:
                        if r in at:
                            at[r].add(before)
                        else:
                            at[r] = {before}
                            heapq.heappush(heap, r)
                        lower = r < rank
                if after < n:
                    left[after] = i
                    if (y := ids[after]) >= 0:
                        if (r := join(ids[gone] << 20 | y)) is not None:
                            (live if r == rank else at.get(r, live)).discard(gone)
                        if (r := join(rank << 20 | y)) is not None:
                            if r in at:
                                at[r].add(i)
                            else:
                                at[r] = {i}
                                heapq.heappush(heap, r)
                            lower = lower or r < rank
                ids[i], ids[gone], right[i] = rank, -2, after
                if lower and live:
                    at[rank] = live
                    heapq.heappush(heap, rank)
                    break
        ends = [*begins[1:], n]
        return [[x for x in ids[b : e - 1] if x >= 0] for b, e in zip(begins, ends, strict=True)]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids."""
        return b"".join(map(self.token.__getitem__, ids))


class Encoder:
    """The replay behind a bounded cache of words."""

    def __init__(self, rank_path: str, pattern: str):
        import public_tokenizers
        import regex

        self.replay = MergeReplay(rank_path)
        self.match = regex.compile(pattern).findall
        self.simple = pattern == public_tokenizers.PATTERN
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.again: set[str] = set()

    def cut(self, text: str) -> list[str]:
        """The matches of the pattern, which lie side by side."""
        return _SIMPLE_PATTERN.findall(text) if self.simple and _SIMPLE.fullmatch(text) else self.match(text)

    def encode(self, block: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, decoded bytes) of each text of a block."""
        cut = [self.cut(t) for t in block]
        used = set().union(*cut)
        new = list(used - self.words.keys())
        self.again |= used & self.words.keys()
        for w, ids in zip(new, self.replay.encode([w.encode() for w in new]), strict=True):
            self.words[w] = (struct.pack(f"<{len(ids)}I", *ids), self.replay.decode(ids))
        look = self.words.__getitem__
        out = []
        for ws in cut:
            pairs = list(map(look, ws))
            out.append((b"".join([a for a, _ in pairs]), b"".join([b for _, b in pairs])))
        if len(self.words) > CACHE_WORDS:
            if len(self.again) > CACHE_WORDS * 2 // 3:
                self.again = used.difference(new)
            self.words = {w: self.words[w] for w in self.again}
        return out


_state: dict[tuple[str, str], Encoder] = {}


def encode_block(block: list[str], rank_path: str, pattern: str) -> list[tuple[bytes, bytes]]:
    """(ids as little-endian 32-bit integers, decoded bytes) of each text of a block, by this worker's encoder."""
    key = (rank_path, pattern)
    if key not in _state:
        _state.clear()
        _state[key] = Encoder(*key)
    return _state[key].encode(block)


def digests(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("byte_bpe", _state.clear)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for whole in batches:
            for b in common.blocks(whole, 1, BLOCK_BYTES):
                rows = encode_block(common.texts(b.column(1)), rank_path, pattern)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(a) // 4 for a, _ in rows], pa.int64()), pa.array([sha(a) for a, _ in rows], pa.string()), pa.array([sha(d) for _, d in rows], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


def encode(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("byte_bpe", _state.clear)
        for whole in batches:
            for b in common.blocks(whole, 1, BLOCK_BYTES):
                rows = [a for a, _ in encode_block(common.texts(b.column(1)), rank_path, pattern)]
                flat, sizes = np.frombuffer(b"".join(rows), "<i4"), [len(a) // 4 for a in rows]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), common.int_lists(flat, sizes)], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

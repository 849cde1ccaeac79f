"""Operator 12: repeated strings of texts found by deep-shallow suffix sorting, and texts without their later copies.

A suffix matters only where its first LENGTH bytes, a window, stand elsewhere too.  So suffixes are brought together by an
anchor: of the ANCHOR-byte strings in a window that of the least hash, the leftmost of equals.  Equal windows have one anchor at one
place, and neighbouring windows share theirs; a piece is a stretch of text with the windows of one anchor.

1. Anchors are counted, and those that stand once are left aside: a Bloom filter of fixed size holds the others.
2. Pieces with other anchors are dealt by anchor.  An anchor of very many pieces is dealt into parts.
3. Pieces of an anchor, and then the windows of those that differ, are ordered by deep-shallow sorting: multikey quicksort by eight
   bytes at a time down to SHALLOW bytes, and blind tries for the groups that still agree.  Strings that agree to their end are
   one class; all but its first place are repeats.
4. Windows that are first in their part of a dealt-out anchor meet again by their own hash, at most one a part, and are ordered likewise.
5. The repeats of a document come together with its text.

Definitions for odd rows: a null text is empty; null ids come first; rows of one id are ordered by the hash of their text; of rows
that agree in id and text one is first and the others repeat it.  Texts shorter than a window keep all.  Other columns are not
read, and an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import common

#: Bytes of a string that counts as a repeat.
LENGTH = 100
#: Bytes of an anchor.
ANCHOR = 32
#: Depth of the multikey quicksort; groups that agree so far are ordered by blind tries.
SHALLOW = 32
#: Bytes of text that are cut at once, small enough for the arrays to stay near the processor, and the longest segment of a text.
CUT_BYTES, SEGMENT = 256 << 10, 8 << 20
#: Pieces that a task sorts at once.
SORT_PIECES = 100_000
#: Anchors of more pieces than HOT, and than a HOT_SHARE-th of all, are dealt out: at most HOT_SHARE anchors.
HOT, HOT_SHARE = 10_000, 200_000
#: Bytes of the Bloom filter of repeated anchors; its size is fixed, beyond it more pieces are carried.
BLOOM_BYTES = 8 << 20

_POSITION = (1 << 24) - 1
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_NO_ID = -(1 << 63)
_PIECES = "bucket long, doc long, tie long, start long, lead int, piece binary"
_FOUND = "doc long, tie long, start long, stop long, piece binary"


# pieces -----------------------------------------------------------------------------------------------------------


def anchors(buf: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each string of ANCHOR bytes, place of the anchor of each window of `length` bytes)."""
    word = np.ndarray((len(buf) - 7,), "<u8", buffer=buf, strides=(1,)).copy()
    m = len(buf) - ANCHOR + 1
    h = word[:m] * _ODD[0]
    for j in range(8, ANCHOR, 8):
        part = word[j : j + m]
        h += (part ^ (part >> np.uint64(31))) * _ODD[j // 8]
    h ^= h >> np.uint64(32)
    h *= _ODD[3]
    h ^= h >> np.uint64(29)
    span = length - ANCHOR + 1
    rows = -(-m // span)
    key = np.full((rows + 1) * span, _MOST)
    key[:m] = h & ~np.uint64(_POSITION)
    key[:m] |= np.arange(m, dtype=np.uint64)
    key = key.reshape(-1, span)
    ahead = np.minimum.accumulate(key, axis=1).ravel()
    back = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(buf) - length + 1
    return h, (np.minimum(back[:n], ahead[span - 1 : span - 1 + n]) & np.uint64(_POSITION)).astype(np.int64)


def cut(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of texts: (buffer, text, start in the text, place in the buffer, bytes, hash of the anchor, place of the anchor in it)."""
    group: list[tuple[int, int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        for base in range(0, len(text) - length + 1, SEGMENT):
            part = text[base : base + SEGMENT + length - 1]
            group.append((i, base, part))
            size += len(part)
            if size >= CUT_BYTES:
                yield _cut(group, length)
                group, size = [], 0
    if group:
        yield _cut(group, length)


def _cut(group: list[tuple[int, int, bytes]], length: int):
    buf = b"".join([p for _, _, p in group])
    sizes = np.array([len(p) for _, _, p in group])
    h, at = anchors(buf, length)
    part = np.repeat(np.arange(len(group)), sizes)
    window = np.flatnonzero(part[: len(at)] == part[length - 1 :])
    at = at[window]
    opens = np.flatnonzero(np.diff(at, prepend=-1))
    place = window[opens]
    count = np.diff(opens, append=len(at))
    of = part[place]
    begin = np.cumsum(sizes) - sizes
    text = np.array([i for i, _, _ in group])[of]
    start = np.array([b for _, b, _ in group])[of] + place - begin[of]
    return buf, text, start, place, count + length - 1, h[at[opens]].view(np.int64), at[opens] - place


def _texts(docs: DataFrame) -> DataFrame:
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    return docs.select(doc.alias("doc"), F.xxhash64("text").alias("tie"), "text")


def counts(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(anchor, n) of the anchors of two pieces or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.blocks(whole, 0, 16 * CUT_BYTES):
                hashes = [h for *_, h, _ in cut(common.text_bytes(b.column(0)), length)]
                if hashes:
                    anchor, n = np.unique(np.concatenate(hashes), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n.astype(np.int64))], ["anchor", "n"])

    return texts.select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")


def bloom(keys: DataFrame) -> bytes:
    """The bits of a Bloom filter of anchors, which are hashes, of fixed size."""
    words = BLOOM_BYTES // 8
    bit = lambda low, at: f"struct(cast(shiftrightunsigned(anchor, {low}) & {words - 1}L as int) as w, shiftleft(1L, cast(shiftrightunsigned(anchor, {at}) & 63L as int)) as b)"
    got = keys.select(F.explode(F.expr(f"array({bit(0, 50)}, {bit(21, 42)})")).alias("x")).groupBy("x.w").agg(F.bit_or("x.b").alias("bits")).toArrow()
    out = np.zeros(words, np.int64)
    if len(got):
        out[got.column("w").to_numpy()] = got.column("bits").to_numpy()
    return out.tobytes()


def in_bloom(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter may hold."""
    x = keys.view(np.uint64)
    part = lambda shift, mask: ((x >> np.uint64(shift)) & np.uint64(mask)).astype(np.int64)
    hit = lambda low, at: (bits[part(low, len(bits) - 1)] >> part(at, 63)) & 1 == 1
    return hit(0, 50) & hit(21, 42)


def pieces(texts: DataFrame, repeated: DataFrame, hot: dict[int, int], length: int = LENGTH) -> DataFrame:
    """Pieces whose anchors stand twice or more.  hot: parts of the anchors that are dealt out.

    A piece whose bytes came before in the same block is no piece any more but a span, with a null piece.
    """
    spark = texts.sparkSession
    bits = spark.sparkContext.broadcast(bloom(repeated))
    many = spark.sparkContext.broadcast((np.array(sorted(hot), np.int64), np.array([hot[k] for k in sorted(hot)], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (keys, parts) = np.frombuffer(bits.value, np.int64), many.value
        for whole in batches:
            for b in common.blocks(whole, 2, 16 * CUT_BYTES):
                doc, tie = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
                order = np.lexsort((tie, doc))  # so that what comes first in the block comes first of all
                order = order[np.append(True, (np.diff(doc[order]) != 0) | (np.diff(tie[order]) != 0))]  # equal rows once
                doc, tie, block = doc[order], tie[order], common.text_bytes(b.column(2))
                known: set[bytes] = set()
                for buf, text, start, place, size, anchor, lead in cut([block[i] for i in order.tolist()], length):
                    keep = np.flatnonzero(in_bloom(table, anchor))
                    if not len(keep):
                        continue
                    text, start, size, anchor, lead = text[keep], start[keep], size[keep], anchor[keep], lead[keep]
                    strings: list[bytes | None] = []
                    for x, n in zip(place[keep].tolist(), size.tolist(), strict=True):
                        s = buf[x : x + n]
                        strings.append(None if s in known else s)
                        known.add(s)
                    bucket = anchor
                    if len(keys):
                        at = np.minimum(np.searchsorted(keys, anchor), len(keys) - 1)
                        salt = np.where(keys[at] == anchor, 1 + (doc[text] ^ tie[text]) % parts[at], 0)
                        bucket = (anchor.view(np.uint64) + salt.astype(np.uint64) * _ODD[1]).view(np.int64)
                        lead = np.where(salt > 0, ~lead, lead)  # negative: of a part
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket), pa.array(doc[text]), pa.array(tie[text]), pa.array(start), pa.array(np.where([s is None for s in strings], size, lead).astype(np.int32)), pa.array(strings, pa.binary())],
                        ["bucket", "doc", "tie", "start", "lead", "piece"],
                    )

    return texts.mapInArrow(run, _PIECES)


# deep-shallow sorting ---------------------------------------------------------------------------------------------


class BlindTrie:
    """Strings of one length in a trie that keeps of each branching only its depth and the bytes that follow.

    A search goes down by these bytes alone and ends at some leaf; one comparison with that leaf's string tells how much is shared, and so
    where the new leaf belongs.
    """

    def __init__(self, first: bytes, item: int):
        self.root: list | tuple = (first, [item])

    def add(self, s: bytes, item: int) -> None:
        """Put an item at the leaf of its string."""
        node = self.root
        while isinstance(node, list):
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other, items = node
        if s == other:
            items.append(item)
            return
        n = len(s)
        shared = n - (((int.from_bytes(s) ^ int.from_bytes(other)).bit_length() + 7) >> 3)
        up, node = None, self.root
        while isinstance(node, list) and node[0] < shared:
            up, node = node, node[1][s[node[0]]]
        leaf = (s, [item])
        if isinstance(node, list) and node[0] == shared:
            node[1][s[shared]] = leaf
            return
        branch = [shared, {s[shared]: leaf, other[shared]: node}]
        if up is None:
            self.root = branch
        else:
            up[1][s[up[0]]] = branch

    def leaves(self) -> Iterator[list[int]]:
        """The items of each string, strings in order."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
            else:
                yield node[1]


def deep_shallow(buf: bytes, place: np.ndarray, size: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> list[list[int]]:
    """The classes of two or more equal strings among those of a group, which have one size, as lists of places in `place`."""
    padded = buf + bytes(8)
    load = np.ndarray((len(padded) - 7,), ">u8", buffer=padded, strides=(1,))
    order = np.argsort(group, kind="stable")
    label = group[order]
    for depth in [None, *range(0, shallow, 8)]:
        if depth is not None:
            word = load[np.minimum(place[order] + depth, len(buf))].astype(np.uint64)
            over = depth + 8 - size[order]  # bytes behind the end of a short string do not count
            word = np.where(over <= 0, word, np.where(over < 8, word >> (np.clip(over, 0, 7) * 8).astype(np.uint64), 0))
            by = np.lexsort((word, label))
            order, label, word = order[by], label[by], word[by]
            label = np.cumsum(np.concatenate([[True], (label[1:] != label[:-1]) | (word[1:] != word[:-1])])) if len(order) else label
        if not len(order):
            return []
        edge = label[1:] != label[:-1]
        alone = np.concatenate([[True], edge]) & np.concatenate([edge, [True]])
        order, label = order[~alone], label[~alone]
    if not len(order):
        return []
    opens = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]])).tolist()
    out = []
    items, at, n = order.tolist(), place[order].tolist(), size[order].tolist()
    for a, b in zip(opens, [*opens[1:], len(items)], strict=True):
        trie = BlindTrie(buf[at[a] : at[a] + n[a]], items[a])
        add = trie.add
        for k in range(a + 1, b):
            add(buf[at[k] : at[k] + n[k]], items[k])
        out += [x for x in trie.leaves() if len(x) > 1]
    return out


def _numbers(*keys: np.ndarray) -> np.ndarray:
    """Numbers from 0 of the different rows of keys."""
    order = np.lexsort(keys)
    fresh = np.zeros(len(order), bool)
    for k in keys:
        fresh[1:] |= k[order[1:]] != k[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(fresh)
    return out


def _firsts(classes: list[list[int]], place: np.ndarray) -> np.ndarray:
    """All members of classes but that of the least place."""
    if not classes:
        return np.zeros(0, np.int64)
    sizes = [len(c) for c in classes]
    members = np.fromiter((x for c in classes for x in c), np.int64, sum(sizes))
    of = np.repeat(np.arange(len(classes)), sizes)
    by = np.lexsort((place[members], of))
    later = np.concatenate([[False], of[by][1:] == of[by][:-1]])
    return members[by][later]


def resolve(bucket: np.ndarray, doc: np.ndarray, tie: np.ndarray, start: np.ndarray, lead: np.ndarray, strings: list[bytes], length: int):
    """(piece, first, stop) of the windows that stand earlier in their bucket, as offsets in pieces; and (piece, offset) of the windows that are first in
    a part of a dealt-out anchor."""
    same = _numbers(start, tie, doc, bucket)
    once = np.unique(same, return_index=True)[1]  # rows that agree in id and text are one text
    rank = np.empty(len(bucket), np.int64)
    rank[np.lexsort((start, tie, doc))] = np.arange(len(bucket))
    size = np.array([len(s) for s in strings], np.int64)
    begin = np.cumsum(size) - size
    buf = b"".join(strings)
    classes = [once[c].tolist() for c in deep_shallow(buf, begin[once], size[once], _numbers(size[once], bucket[once]))]
    again = _firsts(classes, rank)
    spans = [(again, np.zeros(len(again), np.int64), size[again])]
    left = np.setdiff1d(once, again)
    part = lead < 0
    lead = np.where(part, ~lead, lead)
    count = size - length + 1
    left = left[np.argsort(bucket[left], kind="stable")]
    several = np.repeat((c := np.unique(bucket[left], return_counts=True)[1]) > 1, c)
    seen = left[several | part[left]]
    piece = np.repeat(seen, count[seen])
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(count[seen]) - count[seen], count[seen])
    alike = deep_shallow(buf, begin[piece] + offset, np.full(len(piece), length), _numbers(lead[piece] - offset, bucket[piece]))
    later = _firsts(alike, rank[piece])
    free = np.ones(len(piece), bool)
    free[later] = False
    later = np.sort(later)
    p, o = piece[later], offset[later]
    opens = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (o[1:] != o[:-1] + 1)])) if len(p) else np.zeros(0, np.int64)
    ends = np.append(opens[1:], len(p)) - 1 if len(p) else opens
    spans.append((p[opens], o[opens], o[ends] + length))
    keep = np.flatnonzero(free & part[piece])
    return tuple(np.concatenate(x) for x in zip(*spans, strict=True)), (piece[keep], offset[keep])


def repeats(rows: DataFrame, length: int = LENGTH, partitions: int | None = None) -> DataFrame:
    """(doc, tie, start, stop, piece): spans of windows that stand earlier in their bucket, and windows of parts, which have a piece and no stop.

    rows(bucket, doc, tie, start, lead, piece); a row without a piece is a span of `lead` bytes.
    """

    def solved(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        bucket, doc, tie, start, lead = (t.column(i).to_numpy() for i in range(5))
        strings = t.column(5).to_pylist()
        (piece, first, stop), (at, offset) = resolve(bucket, doc, tie, start, lead, strings, length)
        windows = [strings[i][o : o + length] for i, o in zip(at.tolist(), offset.tolist(), strict=True)]
        both = np.concatenate([piece, at])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(doc[both]), pa.array(tie[both]), pa.array(start[both] + np.concatenate([first, offset])),
                pa.array(np.concatenate([start[piece] + stop, np.zeros(len(at), np.int64)]), mask=np.arange(len(both)) >= len(piece)),
                pa.array([None] * len(piece) + windows, pa.binary()),
            ],
            ["doc", "tie", "start", "stop", "piece"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            spans = b.filter(b.column(5).is_null())
            if spans.num_rows:
                begin = spans.column(3).to_numpy()
                yield pa.RecordBatch.from_arrays([spans.column(1), spans.column(2), spans.column(3), pa.array(begin + spans.column(4).to_numpy()), spans.column(5)], ["doc", "tie", "start", "stop", "piece"])
            b = b.filter(b.column(5).is_valid())
            if not b.num_rows:
                continue
            bucket = b.column(0).to_numpy()
            last = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
            if size + last >= SORT_PIECES and (last or held[-1].column(0)[-1].as_py() != int(bucket[0])):
                yield solved([*held, b.slice(0, last)])
                held, size, b = [], 0, b.slice(last)
            held.append(b)
            size += b.num_rows
        if held:
            yield solved(held)

    dealt = rows.repartition(partitions, "bucket") if partitions else rows.repartition("bucket")
    return dealt.sortWithinPartitions("bucket").mapInArrow(run, _FOUND)


# documents --------------------------------------------------------------------------------------------------------


def spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc, tie, start, stop): bytes of texts that are in a window which stands earlier, as spans that may overlap."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    texts = _texts(docs)
    repeated = common.table(counts(texts, length), "anchors")
    total = repeated.agg(F.sum("n")).head()[0] or 0
    most = max(hot, total // HOT_SHARE)
    many = {r["anchor"]: -(-r["n"] // most) for r in repeated.where(F.col("n") > most).collect()}  # at most HOT_SHARE rows
    found = common.table(repeats(pieces(texts, repeated, many, length), length), "repeats", numbers=True)
    out = found.where("piece is null").select("doc", "tie", "start", "stop")
    if many:
        windows = found.where("piece is not null").select(F.xxhash64("piece").alias("bucket"), "doc", "tie", "start", F.lit(0).alias("lead"), "piece")
        out = out.union(repeats(windows, length).select("doc", "tie", "start", "stop"))
    return out


def _kept(text: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[bytes, list[dict[str, int]]]:
    """A text without its spans, and these made maximal."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    opens = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    a, b = starts[opens].tolist(), reach[np.append(opens[1:], len(starts)) - 1].tolist()
    kept = b"".join([text[x:y] for x, y in zip([0, *b], [*a, len(text)], strict=True)])
    return kept, [{"start": x, "stop": y} for x, y in zip(a, b, strict=True)]


def deduplicated(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, kept, spans): the bytes of each text that are in no repeat, and the maximal spans that were removed.

    Spans meet texts by id and hash of the text, rows that agree in both as one with their number.
    """
    removed = spans(docs, length, hot).groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))  # bounded by the text
    texts = _texts(docs).groupBy("doc", "tie").agg(F.first("text").alias("text"), F.count("*").alias("rows"))
    joined = texts.join(removed, ["doc", "tie"], "left").select("doc", "rows", "text", "spans.start", "spans.stop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for whole in batches:
            for b in common.blocks(whole, 2, 16 * CUT_BYTES):
                out = []
                for doc, rows, text, starts, stops in zip(*(b.column(i).to_pylist() for i in (0, 1)), common.text_bytes(b.column(2)), *(b.column(i).to_pylist() for i in (3, 4)), strict=True):
                    first = _kept(text, np.array(starts, np.int64), np.array(stops, np.int64)) if starts else (text, [])
                    out.append((doc, 1, len(text), *first))
                    if rows > 1:
                        again = (b"", [{"start": 0, "stop": len(text)}]) if len(text) >= length else (text, [])
                        out.append((doc, rows - 1, len(text), *again))
                doc, rows, size, kept, gone = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(rows, pa.int64()), pa.array(size, pa.int64()), pa.array(kept, pa.binary()), pa.array(gone, kinds)], ["doc", "rows", "n_bytes", "kept", "spans"])

    made = joined.mapInArrow(run, "doc long, rows long, n_bytes long, kept binary, spans array<struct<start: long, stop: long>>")
    each = made.withColumn("row", F.explode(F.sequence(F.lit(1), "rows")))
    return each.select(F.when(F.col("doc") != _NO_ID, F.col("doc")).alias("doc_id"), "n_bytes", "kept", "spans")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove repeated strings of 100 bytes from all documents."""
    found = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: All windows by their hash; texts are cut into pieces of 500 windows, since a place in a long string is slow to reach.
OP12_SQL = """
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), c AS (
  SELECT r, part * 500 AS base, substr(h, part * 1000 + 1, 1198) AS h FROM (SELECT r, h, unnest(range((len(h) // 2 - 100) // 500 + 1)) AS part FROM d WHERE len(h) >= 200)
), w AS (
  SELECT r, base + i AS i, md5_number(substr(h, 2 * i + 1, 200)) AS m FROM (SELECT r, base, h, unnest(range(len(h) // 2 - 99)) AS i FROM c)
), f AS (
  SELECT m, min(r * 4294967296 + i) AS first FROM w GROUP BY 1 HAVING count(*) > 1
), x AS (
  SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 100 AS joins FROM w JOIN f USING (m) WHERE r * 4294967296 + i > first
), n AS (
  SELECT r, i, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run FROM x
), s AS (
  SELECT r, run, min(i) AS a, max(i) + 100 AS b FROM n GROUP BY 1, 2
), g AS (
  SELECT r, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS stops FROM s GROUP BY 1
), k AS (
  SELECT doc_id, h, len(h) // 2 AS n_bytes, coalesce(starts, []) AS starts, coalesce(stops, []) AS stops FROM d LEFT JOIN g USING (r)
)
SELECT doc_id, n_bytes, CAST(coalesce(list_sum(stops) - list_sum(starts), 0) AS BIGINT) AS n_removed, len(starts) AS n_spans,
       sha256(unhex(array_to_string(list_transform(range(len(starts) + 1), lambda j: CASE WHEN j = 0 THEN substr(h, 1, 2 * coalesce(starts[1], n_bytes))
         ELSE substr(h, 2 * stops[j] + 1, 2 * (coalesce(starts[j + 1], n_bytes) - stops[j])) END), ''))) AS kept_sha256 FROM k
"""

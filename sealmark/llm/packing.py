"""Best-fit packing of tokenised documents into fixed-length sequences, bettered by swap-based local search."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealmark.llm import text as tx
from sealmark.scratch import written

#: Pieces per group that one task packs. A group leaves about one sequence partly empty.
GROUP_PIECES = 4096
#: Distinct spans of text whose ids a worker keeps; beyond them it starts anew.
KEPT_SPANS = 2_000_000
ENCODED_AT_ONCE = 2048
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,!?;:"]] = True


class SpanTokenizer:
    """Token ids of texts, each distinct span encoded once.

    For vocabularies that drop white space and split letters from punctuation before they merge: then the ids of a
    text are those of its spans, cut at ASCII white space and between an ASCII letter and one of .,!?;: . Spans are
    known by their exact bytes: a vocabulary's added tokens heed case even where its words don't.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys, self.where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts, self.sizes, self.ids, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.int32), 0

    def _learn(self, keys: np.ndarray, spans: list[str]) -> None:
        new = []
        for k in range(0, len(spans), ENCODED_AT_ONCE):  # an encoding is far larger than its ids
            new += [e.ids for e in self.model.encode_batch_fast(spans[k : k + ENCODED_AT_ONCE], add_special_tokens=False)]
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        total = int(sizes.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.int32)))
        self.ids[self.used : self.used + total] = np.fromiter((i for ids in new for i in ids), np.int32, total)
        starts = self.used + np.cumsum(sizes) - sizes
        self.used += total
        at = np.searchsorted(self.keys, keys)
        self.where = np.insert(self.where, at, len(self.starts) + np.arange(len(keys)))
        self.keys = np.insert(self.keys, at, keys)
        self.starts, self.sizes = np.concatenate((self.starts, starts)), np.concatenate((self.sizes, sizes))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and the n+1 bounds."""
        data, offsets = tx.raw(texts)
        a, b = data[:-1], data[1:]
        starts, ends, rows = tx.words(data, offsets, np.flatnonzero((_LETTER[a] & _STOP[b]) | (_STOP[a] & _LETTER[b])) + 1)
        hashes = tx.span_hashes(data, starts, ends, folded=False)
        keys, first, code = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > KEPT_SPANS:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        fresh = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        fresh[inside] = self.keys[at[inside]] != keys[inside]
        if fresh.any():
            whole = data.tobytes()
            self._learn(keys[fresh], [whole[starts[i] : ends[i]].decode() for i in first[fresh]])
            at = np.searchsorted(self.keys, keys)
        spot = self.where[at][code] if len(keys) else np.zeros(0, np.int64)
        sizes = self.sizes[spot]
        upto = np.cumsum(sizes)
        flat = self.ids[np.repeat(self.starts[spot] - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)]
        per_row = np.bincount(rows, weights=sizes, minlength=len(texts)).astype(np.int64)
        return flat, np.concatenate(([0], np.cumsum(per_row)))


_TOKENIZERS: dict[str, SpanTokenizer] = {}


def _tokenizer(path: str) -> SpanTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = SpanTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, length: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, spread): each document's ids and end_id, cut where longer than `length`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        for batch in batches:
            for at, to, texts in tx.slices(batch.column(1)):
                flat, bounds = tokenizer.encode(texts)
                n = to - at
                all_ids = np.full(len(flat) + n, end_id, "<u4")
                sizes = np.diff(bounds)
                all_ids[np.arange(len(flat)) + np.repeat(np.arange(n), sizes)] = flat
                begin, sizes = bounds[:-1] + np.arange(n), sizes + 1
                count = -(-sizes // length)
                row = np.repeat(np.arange(n), count)
                nr = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                size = np.minimum(length, sizes[row] - nr * length)
                raw, lo = memoryview(all_ids).cast("B"), (begin[row] + nr * length) * 4
                crc = np.fromiter((zlib.crc32(raw[a : a + 4 * s]) for a, s in zip(lo.tolist(), size.tolist())), np.int64, len(row))
                spread = tx.mix((crc * 65537 + np.arange(len(row))).astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n).take(pa.array(row)), pa.array(nr.astype(np.int32)), pa.array(nr * length), pa.array(size), pa.array(crc), pa.array(spread)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "spread"],
                )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long, spread long")


def best_fit(sizes: np.ndarray, room: int) -> np.ndarray:
    """The bin of each item: largest first, into the fullest bin that has room."""
    out = np.zeros(len(sizes), np.int64)
    free: list[tuple[int, int]] = []  # (room left, bin), sorted
    n = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        k = bisect_left(free, (s, -1))
        if k < len(free):
            left, b = free.pop(k)
        else:
            left, b, n = room, n, n + 1
        out[i] = b
        if left > s:
            insort(free, (left - s, b))
    return out


def local_search(sizes: np.ndarray, bins: np.ndarray, room: int) -> np.ndarray:
    """Better bins, by moves and one-for-one and two-for-one exchanges between underfull bins.

    Each step makes the sum of squared fills larger, so the search ends: when no such step is left over any items of
    any two bins, or when there are as few bins as the sizes' sum allows, so that none can still be emptied.
    """
    bins, sizes = bins.copy(), sizes.astype(np.int64)
    fill = np.bincount(bins, weights=sizes).astype(np.int64)
    used, least = int((fill > 0).sum()), -(-int(sizes.sum()) // room)
    moved = True
    while moved and used > least:
        moved = False
        for b in np.argsort(fill, kind="stable").tolist():
            while 0 < fill[b] < room and used > least:
                step = _best_step(sizes, bins, fill, room, b)
                if step is None:
                    break
                give, c, back = step
                more = int(sizes[give].sum()) - (int(sizes[back]) if back >= 0 else 0)
                bins[give] = c
                if back >= 0:
                    bins[back] = b
                fill[b] -= more
                fill[c] += more
                used -= fill[b] == 0
                moved = True
    return bins


def _best_step(sizes: np.ndarray, bins: np.ndarray, fill: np.ndarray, room: int, b: int) -> tuple[list[int], int, int] | None:
    """The step out of bin b that raises squared fill most: items given, bin that takes them, item it gives back or -1."""
    own = np.flatnonzero(bins == b)
    own = own[np.argsort(-sizes[own], kind="stable")]
    third = np.zeros(len(own), bool)
    third[2:] = sizes[own[2:]] == sizes[own[:-2]]  # a third item of a size adds no other sum
    own = own[~third]
    i, j = np.triu_indices(len(own), 1)
    sums, first = np.unique(np.concatenate((sizes[own], sizes[own[i]] + sizes[own[j]])), return_index=True)
    there = np.flatnonzero((fill > 0) & (fill < room) & (np.arange(len(fill)) != b))
    items = np.flatnonzero((fill[bins] < room) & (bins != b))
    back, where = np.concatenate((np.zeros(len(there), np.int64), sizes[items])), np.concatenate((there, bins[items]))
    left, ahead = room - fill[where], fill[where] - fill[b]
    best = (0, -1, -1)
    for k in range(0, len(sums), 256):
        more = sums[k : k + 256, None] - back[None, :]
        gains = np.where((more > 0) & (more <= left), more * (ahead + more), 0)
        at = int(np.argmax(gains)) if gains.size else 0
        if gains.size and gains.flat[at] > best[0]:
            best = (int(gains.flat[at]), k + at // len(back), at % len(back))
    if not best[0]:
        return None
    chosen, at = int(first[best[1]]), best[2]
    give = [int(own[chosen])] if chosen < len(own) else [int(own[i[chosen - len(own)]]), int(own[j[chosen - len(own)]])]
    return give, int(where[at]), int(items[at - len(there)]) if at >= len(there) else -1


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are those of its text (null: none) and end_id; only documents of more than `length` ids are
    cut, into pieces of `length`, the last shorter. Pieces are dealt by a hash into groups of about GROUP_PIECES,
    whatever their ids; each group is packed by best fit and then local search. Pieces of equal length are placed
    in order of id, piece and checksum, so reruns agree; rows that are equal in all of these may change places.
    Repeated rows and null ids are packed like others; very long texts are encoded whole; an empty table gives no
    rows. Other columns are not read.
    """
    parts = written(pieces(docs, tokenizer_path, length, end_id, id_col, text_col), "pieces")
    groups = max(1, round(parts.count() / GROUP_PIECES))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        sizes = pdf["length"].to_numpy(np.int64)
        whole = int((sizes == length).sum())  # sorted first
        bins = np.arange(len(sizes))
        if whole < len(sizes):
            rest = sizes[whole:]
            bins[whole:] = whole + local_search(rest, best_fit(rest, length), length)
        order = np.argsort(bins, kind="stable")
        placed, upto = bins[order], np.cumsum(sizes[order])
        first = np.concatenate(([True], placed[1:] != placed[:-1]))
        base = np.maximum.accumulate(np.where(first, upto - sizes[order], 0))
        offset = np.empty(len(sizes), np.int64)
        offset[order] = upto - sizes[order] - base
        return pdf.assign(sequence_id=(pdf["part"].to_numpy(np.int64) << 32) + bins, offset=offset).drop(columns="part")

    dealt = parts.withColumn("part", F.pmod("spread", F.lit(groups)).cast("int")).drop("spread")
    return dealt.groupBy("part").applyInPandas(work, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

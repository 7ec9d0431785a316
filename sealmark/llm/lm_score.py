"""Language-model scores from a log-frequency Bloom filter of word pairs.

A text's tokens are its words (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased) and one end. Counts are taken from the
documents that aren't held out. Single tokens are counted exactly. A pair with count c goes into the filter as
(pair, 1) .. (pair, q), q = 1 + floor(log2 c) being its quantised count; a probe asks for (pair, 1), (pair, 2)
and so on until one is absent, and takes the middle of the last level's counts. The filter is broadcast to the
workers in slices of bounded size, one pass over the tokens for each, without a shuffle; a pair lies in one slice.
A filter of more than MOST_SLICES slices stays where it is: then every block's distinct pairs are dealt once to the
filter's segments, probed there in the same way, and their levels go back to the block. Scores are the same.

The probability of w after h is (c(h w) + mu * p(w)) / (c(h) + mu), p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)).
The end is also what stands before a text's first word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealmark.llm import text as tx
from sealmark.scratch import written

U64 = np.uint64
END = U64(0x5851F42D4C957F2D)
#: Tokens per block of documents; a longer document is a block of its own.
BLOCK_TOKENS = 500_000
#: Blocks, and texts, that pass between Spark and a Python worker at once; a block has some megabytes.
BLOCKS_AT_ONCE, TEXTS_AT_ONCE = 2, 1000
#: Tokens of text for each part that the exact counts of single tokens are dealt to.
PART_TOKENS = 4_000_000
#: Pairs a filter segment is meant to hold, bits for each entry, probes for each.
SEGMENT_PAIRS, BITS_PER_ENTRY, PROBES = 1 << 18, 12, 6
#: Bytes of the filter that are broadcast at once.
SLICE_BYTES = 128 << 20
#: Passes over the tokens at most; a larger filter is probed where its segments lie.
MOST_SLICES = 8
#: Weight of the single-token probability against counted pairs.
MU = 400.0


def held_out(doc_id) -> bool:
    """crc32(id as text) mod 5 is 1; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


BLOCK = "block long, doc_ids array<long>, has_id array<boolean>, is_held_out array<boolean>, n_tokens array<int>, codes binary, vocabulary binary"


def token_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of documents: their token codes (uint32, in order) and the hashes the codes stand for.

    A block is numbered by its task and its place there; the numbers are for use once the blocks are written.
    """

    def pack(nr: int, ids: list, hashes: list[np.ndarray]) -> pa.RecordBatch:
        vocabulary, codes = np.unique(np.concatenate(hashes), return_inverse=True)
        vocabulary, codes = vocabulary.tobytes(), codes.astype("<u4").tobytes()
        lists = {
            "doc_ids": ([i or 0 for i in ids], pa.int64()), "has_id": ([i is not None for i in ids], pa.bool_()),
            "is_held_out": ([held_out(i) for i in ids], pa.bool_()), "n_tokens": ([len(h) for h in hashes], pa.int32()),
        }
        columns = {"block": pa.array([TaskContext.get().partitionId() << 32 | nr], pa.int64())}
        columns |= {k: pa.array([x], pa.list_(t)) for k, (x, t) in lists.items()}
        columns |= {"codes": pa.array([codes], pa.binary()), "vocabulary": pa.array([vocabulary], pa.binary())}
        return pa.RecordBatch.from_pydict(columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nr, ids, hashes, total = 0, [], [], 0
        for batch in batches:
            for at, to, texts in tx.slices(batch.column(1)):
                data, offsets = tx.raw(texts)
                starts, ends, rows = tx.words(data, offsets)
                own = tx.span_hashes(data, starts, ends)
                bounds = tx.runs(rows, to - at)
                for i, a, b in zip(batch.column(0).slice(at, to - at).to_pylist(), bounds[:-1], bounds[1:]):
                    if ids and total + b - a + 1 > BLOCK_TOKENS:
                        yield pack(nr, ids, hashes)
                        nr, ids, hashes, total = nr + 1, [], [], 0
                    ids.append(i)
                    hashes.append(np.append(own[a:b], END))
                    total += b - a + 1
        if ids:
            yield pack(nr, ids, hashes)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(work, BLOCK)


class _Block:
    """A row of token_blocks, unpacked."""

    def __init__(self, row: dict):
        self.block, self.doc_ids, self.has_id = row["block"], np.array(row["doc_ids"], np.int64), np.array(row["has_id"], bool)
        self.held = np.array(row["is_held_out"], bool)
        self.sizes = np.array(row["n_tokens"], np.int64)
        self.codes = np.frombuffer(row["codes"], "<u4").astype(np.int64)
        self.vocabulary = np.frombuffer(row["vocabulary"], U64)
        self.rows = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.counts = _counts(row["counts"]) if "counts" in row else None

    def pairs(self) -> np.ndarray:
        """A hash for each token and the one before it; a text's first token stands after the end."""
        now = self.vocabulary[self.codes]
        before = np.concatenate((END[None], now[:-1]))
        before[np.cumsum(self.sizes) - self.sizes] = END
        with np.errstate(over="ignore"):
            return tx.mix(before * U64(0x9FB21C651E98DF25) + tx.mix(now))


def _packed(counts: np.ndarray) -> bytes:
    """Counts by four bytes each, and one more byte at the end where they need eight."""
    return counts.astype("<u4").tobytes() if not len(counts) or counts.max() < 1 << 32 else counts.astype("<i8").tobytes() + b"8"


def _counts(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed[:-1], "<i8") if len(packed) % 4 else np.frombuffer(packed, "<u4").astype(np.int64)


@contextmanager
def _few_at_once(spark: SparkSession, rows: int = BLOCKS_AT_ONCE):
    """Small Arrow batches, for as long as the work inside takes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield _Block(batch.slice(k, 1).to_pylist()[0])


def _token_parts(blocks: DataFrame, parts: int) -> DataFrame:
    """(part, block, tokens, counts): every block's distinct tokens with their training counts, dealt by hash, packed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _unpacked(batches):
            counts = np.bincount(b.codes[~b.held[b.rows]], minlength=len(b.vocabulary)).astype("<u4")
            bounds = np.searchsorted(_segment(b.vocabulary, parts), np.arange(parts + 1))  # rises with the token
            some = np.flatnonzero(np.diff(bounds))
            cut = lambda x: pa.array([x[bounds[k] : bounds[k + 1]].tobytes() for k in some], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), b.block)), cut(b.vocabulary), cut(counts)], ["part", "block", "tokens", "counts"])

    return blocks.mapInArrow(work, "part int, block long, tokens binary, counts binary")


def token_counts(blocks: DataFrame, parts: int) -> DataFrame:
    """(block, part, counts, n, v): for a block's tokens in a part, in order, their counts in all training documents.

    n and v, on one row of each part, are the part's training tokens and distinct ones.
    """

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = np.array([len(t) // 8 for t in pdf["tokens"]])
        tokens, code = np.unique(np.frombuffer(b"".join(pdf["tokens"]), U64), return_inverse=True)
        total = np.bincount(code, weights=np.frombuffer(b"".join(pdf["counts"]), "<u4"), minlength=len(tokens)).astype("<i8")
        ends = np.cumsum(sizes)
        own = [_packed(total[code[e - s : e]]) for e, s in zip(ends, sizes)]
        first = np.arange(len(pdf)) == 0
        return pd.DataFrame({"block": pdf["block"], "part": pdf["part"], "counts": own, "n": np.where(first, total.sum(), 0), "v": np.where(first, (total > 0).sum(), 0)})

    return _token_parts(blocks, parts).groupBy("part").applyInPandas(work, "block long, part int, counts binary, n long, v long")


def _pair_counts(blocks: DataFrame, segments: int) -> DataFrame:
    """(segment, pairs, counts): per block, its distinct training pairs dealt to the filter's segments, packed.

    A pair is packed as the 40 bits below those that name its segment; counts over 1 come with their positions.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _unpacked(batches):
            keys, counts = np.unique(b.pairs()[~b.held[b.rows]], return_counts=True)
            place = _segment(keys, segments)  # rises with the key
            bounds = np.searchsorted(place, np.arange(segments + 1))
            low = _low(keys)
            some = np.flatnonzero(np.diff(bounds))
            pairs, more = [], []
            for s in some:
                a, z = bounds[s], bounds[s + 1]
                pairs.append(low[a:z].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes())
                at = np.flatnonzero(counts[a:z] > 1)
                more.append(np.stack((at, counts[a:z][at])).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(pairs, pa.binary()), pa.array(more, pa.binary())], ["segment", "pairs", "counts"])

    return blocks.mapInArrow(work, "segment int, pairs binary, counts binary")


def _segment(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys >> U64(40)) * U64(segments) >> U64(24)).astype(np.int64)


def _low(keys: np.ndarray) -> np.ndarray:
    return keys & U64((1 << 40) - 1)


def level_of(counts: np.ndarray) -> np.ndarray:
    """The quantised count, 1 + floor(log2 count)."""
    return np.frexp(counts.astype(np.float64))[1]


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level: 0, 1, 2.5, 5.5, 11.5 .."""
    return np.where(levels > 0, (3 * 2.0 ** (levels - 1) - 1) / 2, 0.0)


def _bits(low: np.ndarray, level: int | np.ndarray, size: np.ndarray):
    """The PROBES bit positions of entries (pair, level) in a segment of `size` bits."""
    with np.errstate(over="ignore"):
        a = tx.mix(low * U64(0xD6E8FEB86659FD93) + np.asarray(level).astype(U64))
        b = tx.mix(a) | U64(1)
        for k in range(PROBES):
            yield ((a + U64(k) * b) >> U64(32)) * size.astype(U64) >> U64(32)


def segment_filters(blocks: DataFrame, segments: int) -> DataFrame:
    """(segment, n_entries, bits): the Bloom filter of each segment, sized for the entries that it holds."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        lows, counts = [], []
        for pairs, more in zip(pdf["pairs"], pdf["counts"]):
            five = np.frombuffer(pairs, np.uint8).reshape(-1, 5)
            eight = np.zeros((len(five), 8), np.uint8)
            eight[:, :5] = five
            lows.append(eight.view("<u8").reshape(-1))
            own = np.ones(len(five), np.int64)
            at, n = np.frombuffer(more, "<u4").reshape(2, -1)
            own[at] = n
            counts.append(own)
        low, code = np.unique(np.concatenate(lows), return_inverse=True)
        levels = level_of(np.bincount(code, weights=np.concatenate(counts)))
        entries = int(levels.sum())
        size = -(-entries * BITS_PER_ENTRY // 64) * 64
        bits = np.zeros(size, bool)
        for level in range(1, int(levels.max()) + 1):
            for at in _bits(low[levels >= level], level, np.array(size)):
                bits[at.astype(np.int64)] = True
        return pd.DataFrame({"segment": [pdf["segment"].iat[0]], "n_entries": [entries], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    return _pair_counts(blocks, segments).groupBy("segment").applyInPandas(work, "segment int, n_entries long, bits binary")


class FilterSlice:
    """Segments of the filter from `first` on, side by side; sizes: their bytes."""

    def __init__(self, segments: int, first: int, sizes: np.ndarray, bits: bytes):
        self.segments, self.first, self.bits = segments, first, bits
        self.sizes = 8 * np.asarray(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def levels(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys lie in this slice, and their quantised counts by repeated membership probes (0: absent)."""
        place = _segment(keys, self.segments) - self.first
        mine = (place >= 0) & (place < len(self.sizes))
        out = np.zeros(len(keys), np.int64)
        at = np.flatnonzero(mine)
        at = at[self.sizes[place[at]] > 0]
        level, bits = 0, np.frombuffer(self.bits, np.uint8)
        while len(at):
            level += 1
            low, seg = _low(keys[at]), place[at]
            there = np.ones(len(at), bool)
            for bit in _bits(low, level, self.sizes[seg]):
                bit = bit.astype(np.int64) + self.starts[seg]
                there &= (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            at = at[there]
            out[at] = level
        return mine, out


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mu: float = MU, slice_bytes: int = SLICE_BYTES, most_slices: int = MOST_SLICES,
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    base_score is the single-token model's log10 probability, from exact counts; score is the pair model's. Null
    text: the end alone. Null id: doc_id null, learnt from. Repeated rows and ids are learnt from and scored each;
    counts and sums don't depend on an order, so ties can't matter. A
    very long text is a block of its own, scored whole. With no training tokens N and V are 0 and the formulas hold
    as they stand; an empty table gives no rows. Other columns are not read. The corpus is counted at the call; the
    scores are lazy. The filter grows with the corpus: beyond slice_bytes it is broadcast in several slices, each of
    which costs one more pass over the token blocks; beyond most_slices it is probed in place.
    """
    spark = docs.sparkSession
    with _few_at_once(spark, TEXTS_AT_ONCE):
        blocks = written(token_blocks(docs, id_col, text_col), "blocks")
    size = blocks.agg(F.sum(F.octet_length("codes") / 4)).first()[0] or 0
    with _few_at_once(spark):
        known = written(token_counts(blocks, max(1, round(size / PART_TOKENS))), "counts")
    n, v = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    known = known.select("block", "part", "counts")
    segments = max(1, round(n / SEGMENT_PAIRS))
    with _few_at_once(spark):
        filters = written(segment_filters(blocks, segments), "filter")
    total = filters.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0))).first()[0]
    count = max(1, -(-total // slice_bytes))
    if count == 1:
        shared = _slice(filters, segments, 0, segments)
        rows = written(_scores_at_once(blocks, known, shared, n, v, mu), "scores")
        shared.unpersist()
    elif count <= most_slices:
        coded, rows = written(_with_counts(blocks, known), "coded"), None
        bounds = [segments * k // count for k in range(count + 1)]  # equal hash ranges hold about equal shares of the filter
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            shared = _slice(filters, segments, lo, hi)
            with _few_at_once(spark):
                done = written(_slice_scores(coded, shared, lo == 0, n, v, mu), "scores")
            shared.unpersist()
            rows = done if rows is None else rows.union(done)
        rows = rows.groupBy("block", "place").agg(
            F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.max("n_known").alias("n_known"),
            F.max("base_score").alias("base_score"), F.sum("score").alias("score"),
        )
    else:
        coded = written(_with_counts(blocks, known), "coded")
        with _few_at_once(spark):
            rows = written(_scores_in_place(coded, filters, segments, n, v, mu), "scores")
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _slice(filters: DataFrame, segments: int, lo: int, hi: int):
    """Segments lo..hi - 1 of the filter, broadcast as plain values: a broadcast names its classes, and copies arrays."""
    own = filters.where(F.col("segment").between(lo, hi - 1)).select("segment", "bits").toArrow().combine_chunks()
    order = np.argsort(own["segment"].to_numpy())
    sizes = np.zeros(hi - lo, np.int64)
    sizes[own["segment"].to_numpy() - lo] = pc.binary_length(own["bits"]).to_numpy()
    bits = b"".join(own["bits"][int(i)].as_buffer() for i in order)
    del own
    return filters.sparkSession.sparkContext.broadcast((segments, lo, sizes, bits))


def _of_block(left: pd.DataFrame, right: pd.DataFrame) -> dict:
    """A block with `counts`: its vocabulary's counts in all training documents."""
    parts = [_counts(bytes(c)) for c in right.sort_values("part")["counts"]]  # parts rise with the token, as the vocabulary does
    return left.iloc[0].to_dict() | {"counts": _packed(np.concatenate(parts))}


def _with_counts(blocks: DataFrame, known: DataFrame) -> DataFrame:
    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_of_block(left, right)])

    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(work, BLOCK + ", counts binary")


def _scores_at_once(blocks: DataFrame, known: DataFrame, shared, n: int, v: int, mu: float) -> DataFrame:
    """Scores by a filter that is broadcast whole, where blocks meet their counts."""

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        part = FilterSlice(*shared.value)
        b = _Block(_of_block(left, right))
        mine, levels = part.levels(b.pairs())
        return pd.DataFrame(_scored(b, mine, levels, True, n, v, mu))

    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(work, SCORES)


SCORES = "block long, place int, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scored(b: _Block, mine: np.ndarray | bool, levels: np.ndarray, with_base: bool, n: int, v: int, mu: float) -> dict:
    """The columns of SCORES for a block, from its tokens' levels; only the terms of `mine` count towards score."""
    c, docs = b.counts, len(b.sizes)
    p = (c + 0.5) / (n + 0.5 * (v + 1))
    before = c[np.concatenate(([0], b.codes[:-1]))]
    before[np.cumsum(b.sizes) - b.sizes] = c[np.searchsorted(b.vocabulary, END)]
    term = np.where(mine, np.log10((count_of(levels) + mu * p[b.codes]) / (before + mu)), 0.0)
    add = lambda x: np.bincount(b.rows, weights=x, minlength=docs)
    return {
        "block": np.full(docs, b.block), "place": np.arange(docs, dtype=np.int32), "doc_id": pd.arrays.IntegerArray(b.doc_ids, ~b.has_id), "held_out": b.held, "n_tokens": b.sizes,
        "n_known": add((c > 0)[b.codes]).astype(np.int64) if with_base else np.zeros(docs, np.int64), "base_score": add(np.log10(p)[b.codes]) if with_base else np.full(docs, -np.inf),
        "score": add(term),
    }


def _slice_scores(coded: DataFrame, shared, with_base: bool, n: int, v: int, mu: float) -> DataFrame:
    """Scores of the tokens whose pairs lie in one broadcast slice; one of the slices also gives counts and base scores."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = FilterSlice(*shared.value)
        for b in _unpacked(batches):
            mine, levels = part.levels(b.pairs())
            yield pa.RecordBatch.from_pandas(pd.DataFrame(_scored(b, mine, levels, with_base, n, v, mu)), preserve_index=False)

    return coded.mapInArrow(work, SCORES)


def _scores_in_place(coded: DataFrame, filters: DataFrame, segments: int, n: int, v: int, mu: float) -> DataFrame:
    """Scores by dealing each block's distinct pairs to the filter's segments once, and their levels back."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _unpacked(batches):
            keys = np.unique(b.pairs())
            bounds = np.searchsorted(_segment(keys, segments), np.arange(segments + 1))
            some = np.flatnonzero(np.diff(bounds))
            pairs = [keys[bounds[s] : bounds[s + 1]].tobytes() for s in some]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), b.block)), pa.array(pairs, pa.binary())], ["segment", "block", "pairs"])

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        levels = []
        bits = bytes(right["bits"].iat[0]) if len(right) else b""
        part = FilterSlice(segments, int(left["segment"].iat[0]) if len(left) else 0, np.array([len(bits)]), bits)
        for pairs in left["pairs"]:
            levels.append(part.levels(np.frombuffer(pairs, U64))[1].astype(np.uint8).tobytes())
        return pd.DataFrame({"block": left["block"], "segment": left["segment"], "levels": levels})

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        b = _Block(left.iloc[0].to_dict())
        of_key = np.frombuffer(b"".join(right.sort_values("segment")["levels"]), np.uint8).astype(np.int64)
        _, code = np.unique(b.pairs(), return_inverse=True)
        return pd.DataFrame(_scored(b, True, of_key[code], True, n, v, mu))

    asks = coded.mapInArrow(ask, "segment int, block long, pairs binary")
    levels = asks.groupBy("segment").cogroup(filters.select("segment", "bits").groupBy("segment")).applyInPandas(probe, "block long, segment int, levels binary")
    return coded.groupBy("block").cogroup(levels.groupBy("block")).applyInPandas(finish, SCORES)

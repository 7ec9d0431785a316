"""Alignment of two tokenizers over a corpus: where their tokens end together, and how often which ids do.

One tokenizer is byte-level (`tokenizers`), the other a sentence piece model with byte fallback (`sentencepiece`).
Character spans, which both give, are the coarse cuts; where a token is part of a character, a byte of the fallback
or has a trimmed span, the bytes that it decodes to tell where it ends.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealmark.llm import text as tx
from sealmark.scratch import written

#: A worker keeps what it learned of so many distinct units of text, or bytes of them; beyond that it starts anew.
KEPT_UNITS, KEPT_BYTES = 400_000, 64 << 20
#: Units encoded in one call (an encoding is far larger than its ids), and characters of units that are encoded as one text.
ENCODED_AT_ONCE, JOINED = 16384, 16384
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def _bytes_of_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Bytes:
    """Bytes of every id of a vocabulary, one after another."""

    def __init__(self, entries: list[bytes]):
        self.sizes = np.fromiter(map(len, entries), np.int64, len(entries))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def __len__(self) -> int:
        return len(self.sizes)

    def of(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        upto = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[ids] - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


class Aligner:
    """Aligned token groups of texts; each distinct unit of text is encoded once.

    A unit reaches from a blank after a character that isn't white space to the next such blank. Neither tokenizer
    has tokens across its bounds, if the first splits words as byte-level ones do and no piece of the second holds a
    blank after another character; both are looked up, else a text is one unit.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _bytes_of_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        entries = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            entries[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.bytes_a = _Bytes(entries)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = _Bytes([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        # newer releases count the spans of a proto in bytes, older ones in characters
        self.spans_in_bytes = list(self.b.encode("é", return_type="proto").pieces)[-1].end == 2
        split = json.loads(self.a.to_str())["pre_tokenizer"]
        self.by_units = split is not None and split["type"] == "ByteLevel" and split.get("use_regex", True) and not any("▁" in p.lstrip("▁") for p in pieces)
        self.decimals = _Bytes([b"%d," % i for i in range(max(len(self.bytes_a), len(self.bytes_b)))])
        self.clear()

    def clear(self) -> None:
        self.keys, self.where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.n_a = self.n_b = self.starts = self.sizes = self.pairs = self.met = np.zeros(0, np.int64)
        self.whole = np.zeros(0, bool)
        self.groups: list[bytes] = []
        self.kept = 0

    def _forget(self) -> None:
        """Keep the units that were met in more than one call, if they are few enough."""
        old = np.flatnonzero(self.met > 1)
        if len(old) > KEPT_UNITS // 2 or self.kept > 2 * KEPT_BYTES:
            return self.clear()
        nr = np.full(len(self.met), -1)
        nr[old] = np.arange(len(old))
        stay = nr[self.where] >= 0
        self.keys, self.where = self.keys[stay], nr[self.where[stay]]
        sizes = self.sizes[old]
        upto = np.cumsum(sizes)
        self.pairs = self.pairs[np.repeat(self.starts[old] - (upto - sizes), sizes) + np.arange(upto[-1] if len(old) else 0)]
        self.n_a, self.n_b, self.whole, self.sizes, self.starts = self.n_a[old], self.n_b[old], self.whole[old], sizes, upto - sizes
        self.met = np.zeros(len(old), np.int64)
        self.groups = [self.groups[i] for i in old.tolist()]
        self.kept = sum(map(len, self.groups))

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start (of what follows the blank, if it is one), end and row of every unit."""
        first = offsets[:-1][np.diff(offsets) > 0]
        cuts = np.zeros(0, np.int64)
        if self.by_units and len(data) > 2:
            # before the blank no white space: an ASCII character, or the end of one of two bytes; after it the same text
            before, lead = data[:-2], np.concatenate(([0], data[:-3])).astype(np.uint8)
            sound = ((before < 128) & ~_GAP[before]) | ((before >= 128) & (lead >= 0xC3) & (lead < 0xE0))
            edge = np.zeros(len(data) + 1, bool)
            edge[offsets] = True
            cuts = np.flatnonzero((data[1:-1] == 32) & sound & ~edge[1:-2] & ~edge[2:-1]) + 1
        starts = np.sort(np.concatenate((first, cuts)))
        rows = np.searchsorted(offsets, starts, side="right") - 1
        ends = np.concatenate((starts[1:], [len(data)])) if len(starts) else starts
        return starts + np.isin(starts, cuts, assume_unique=True), ends, rows

    def _learn(self, keys: np.ndarray, units: list[str]) -> None:
        parts = [self._aligned(units[k : k + ENCODED_AT_ONCE]) for k in range(0, len(units), ENCODED_AT_ONCE)]
        n_a, n_b, whole, sizes, pairs = (np.concatenate([p[k] for p in parts]) for k in range(5))
        at = np.searchsorted(self.keys, keys)
        self.where = np.insert(self.where, at, len(self.n_a) + np.arange(len(keys)))
        self.keys = np.insert(self.keys, at, keys)
        self.starts = np.concatenate((self.starts, len(self.pairs) + np.cumsum(sizes) - sizes))
        self.n_a, self.n_b, self.sizes = np.concatenate((self.n_a, n_a)), np.concatenate((self.n_b, n_b)), np.concatenate((self.sizes, sizes))
        self.whole, self.pairs, self.met = np.concatenate((self.whole, whole)), np.concatenate((self.pairs, pairs)), np.concatenate((self.met, np.zeros(len(keys), np.int64)))
        for p in parts:
            self.groups += p[5]
            self.kept += sum(map(len, p[5]))

    def _texts(self, units: list[str], alone: bool) -> list[tuple[int, int]]:
        """Runs of units that are encoded as one text, first and end: as in a text, a blank after white space is no bound."""
        runs, first, size = [], 0, 0
        for i, unit in enumerate(units):
            size += len(unit) + 1
            last = unit[-1:]
            bound = last.isascii() and last > " " or "\x80" < last < "\u0800" and last.isalpha()
            if alone or size >= JOINED or not bound or not self.by_units:
                runs.append((first, i + 1))
                first, size = i + 1, 0
        return runs if first == len(units) else [*runs, (first, len(units))]

    def _aligned(self, units: list[str], alone: bool = False):
        """(n_a, n_b, whole, n_groups, pairs, groups) of each unit; pairs of all units in turn."""
        runs = self._texts(units, alone)
        texts = [" ".join(units[i:j]) for i, j in runs]
        encoded = self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)
        pieces = [list(p.pieces) for p in self.b.encode(texts, return_type="proto", num_threads=1)]
        n_a, n_b = np.array([len(e.ids) for e in encoded]), np.array([len(p) for p in pieces])
        ids_a = np.array([i for e in encoded for i in e.ids], np.int64)
        ids_b = np.array([p.id for ps in pieces for p in ps], np.int64)
        # bytes of all texts in a row, each after a blank; where its characters and units begin
        data = np.frombuffer((" " + " ".join(units)).encode(), np.uint8)
        byte_at = np.concatenate((np.flatnonzero((data & 0xC0) != 0x80), [len(data)]))
        chars = np.fromiter(map(len, units), np.int64, len(units)) + 1
        unit_ends = byte_at[np.cumsum(chars)]
        first, after = np.array(runs, np.int64).reshape(-1, 2).T
        size = unit_ends[after - 1] - np.where(first > 0, unit_ends[first - 1], 0)
        base = unit_ends[after - 1] - size
        char_base = (np.cumsum(chars) - chars)[first]
        coarse_a = byte_at[np.repeat(char_base, n_a) + np.array([o[1] for e in encoded for o in e.offsets], np.int64)]
        ends_b = np.array([p.end for ps in pieces for p in ps], np.int64) + 1  # after the blank that the model adds
        coarse_b = np.repeat(base, n_b) + ends_b if self.spans_in_bytes else byte_at[np.repeat(char_base, n_b) + ends_b]
        # texts that both tokenizers give back whole
        bounds_a, bounds_b = np.concatenate(([0], np.cumsum(n_a))), np.concatenate(([0], np.cumsum(n_b)))
        whole = np.ones(len(texts), bool)
        for ids, vocabulary, bounds, n in ((ids_a, self.bytes_a, bounds_a, n_a), (ids_b, self.bytes_b, bounds_b, n_b)):
            whole &= _sums(vocabulary.sizes[ids], bounds) == size
            fits = np.repeat(whole, size)
            differ = np.zeros(len(data), np.int64)
            differ[fits] = data[fits] != vocabulary.of(ids[np.repeat(whole, n)])
            whole &= _sums(differ, np.concatenate((base, [len(data)]))) == 0
        if not whole.all():
            keep_a, keep_b = np.repeat(whole, n_a), np.repeat(whole, n_b)
            ids_a, ids_b, coarse_a, coarse_b = ids_a[keep_a], ids_b[keep_b], coarse_a[keep_a], coarse_b[keep_b]
        n_a, n_b = np.where(whole, n_a, 0), np.where(whole, n_b, 0)
        ends = []
        for ids, vocabulary, n in ((ids_a, self.bytes_a, n_a), (ids_b, self.bytes_b, n_b)):
            sizes = vocabulary.sizes[ids]
            upto = np.cumsum(sizes)
            opened = np.repeat(np.cumsum(n) - n, n)  # the first token of each one's text
            ends.append(upto - (upto - sizes)[opened] + np.repeat(base, n))
        by_bytes_a, by_bytes_b = ends
        # coarse cuts where both have a span's end that their bytes confirm; then those inside characters
        sound_a, sound_b = coarse_a == by_bytes_a, coarse_b == by_bytes_b
        cuts = np.intersect1d(coarse_a[sound_a], coarse_b[sound_b], assume_unique=True)
        if not (sound_a.all() and sound_b.all()):
            cuts = np.union1d(cuts, np.union1d(np.intersect1d(by_bytes_a[~sound_a], by_bytes_b), np.intersect1d(by_bytes_a, by_bytes_b[~sound_b])))
        to_a, to_b = np.searchsorted(by_bytes_a, cuts) + 1, np.searchsorted(by_bytes_b, cuts) + 1
        pairs = ids_a[to_a - 1] * len(self.bytes_b) + ids_b[to_b - 1]
        blob, item_ends = self._shown(ids_a, ids_b, to_a, to_b)
        # cut back into units: both tokenizers end a token where one ends
        upto = np.searchsorted(cuts, unit_ends, side="right")
        met = np.zeros(len(units), bool)
        met[upto > 0] = cuts[upto[upto > 0] - 1] == unit_ends[upto > 0]
        of_text = np.repeat(np.arange(len(texts)), after - first)
        fine = whole & (np.bincount(of_text, weights=~met, minlength=len(texts)) == 0)
        before = np.concatenate(([0], upto[:-1]))
        tokens = lambda to: np.concatenate(([0], to))[upto] - np.concatenate(([0], to))[before]
        edges = np.concatenate(([0], item_ends))
        shown = [blob[i : max(i, j - 1)] for i, j in zip(edges[before].tolist(), edges[upto].tolist())]
        out = [tokens(to_a), tokens(to_b), fine[of_text], upto - before, pairs, shown]
        again = np.flatnonzero(~fine & (after - first > 1))
        if not len(again):
            return out
        # a unit that isn't given back whole spoils its neighbours: those texts are encoded unit by unit
        at = np.concatenate([np.arange(first[t], after[t]) for t in again])
        own = self._aligned([units[i] for i in at], alone=True)
        parts, mine = np.split(out[4], np.cumsum(out[3])[:-1]), np.split(own[4], np.cumsum(own[3])[:-1])
        for i, k in enumerate(at.tolist()):
            parts[k], out[5][k] = mine[i], own[5][i]
        for k in range(4):
            out[k] = out[k].copy()
            out[k][at] = own[k]
        out[4] = np.concatenate(parts)
        return out

    def _shown(self, ids_a: np.ndarray, ids_b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All groups as text, each with a semicolon after it, and where each ends; to_a, to_b: tokens up to each group's end."""
        before_b = np.concatenate(([0], to_b))[:-1]
        at_a = np.arange(to_a[-1] if len(to_a) else 0) + np.repeat(before_b, np.diff(np.concatenate(([0], to_a))))
        at_b = np.arange(to_b[-1] if len(to_b) else 0) + np.repeat(to_a, np.diff(np.concatenate(([0], to_b))))
        item = np.empty(len(at_a) + len(at_b), np.int64)
        item[at_a], item[at_b] = ids_a[: len(at_a)], ids_b[: len(at_b)]
        text, upto = self.decimals.of(item), np.cumsum(self.decimals.sizes[item])
        text[upto[to_a + before_b - 1] - 1] = ord("|")
        text[upto[to_a + to_b - 1] - 1] = ord(";")
        return text.tobytes(), upto[to_a + to_b - 1]

    def align(self, texts: pa.Array):
        """(n_a, n_b, groups, pair bounds, pairs, how often) of each text."""
        n = len(texts)
        data, offsets = tx.raw(texts)
        starts, ends, rows = self._units(data, offsets)
        keys, first, code = np.unique(tx.span_hashes(data, starts, ends, folded=False), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > KEPT_UNITS or self.kept > KEPT_BYTES:
            self._forget()
        fresh = np.ones(len(keys), bool)
        at = np.searchsorted(self.keys, keys)
        inside = at < len(self.keys)
        fresh[inside] = self.keys[at[inside]] != keys[inside]
        if fresh.any():
            held = data.tobytes()
            self._learn(keys[fresh], [held[starts[i] : ends[i]].decode() for i in first[fresh]])
        known = self.where[np.searchsorted(self.keys, keys)] if len(keys) else np.zeros(0, np.int64)
        self.met[known] += 1
        spot = known[code]
        per_row = lambda x: np.bincount(rows, weights=x[spot], minlength=n).astype(np.int64)
        sound = per_row(~self.whole) == 0
        n_a, n_b = (np.where(sound, per_row(x), 0) for x in (self.n_a, self.n_b))
        bounds = tx.runs(rows, n).tolist()
        names = list(map(self.groups.__getitem__, spot.tolist()))
        groups = [b";".join(names[i:j]) if ok else b"" for ok, i, j in zip(sound.tolist(), bounds, bounds[1:])]
        kept = sound[rows]
        spot, rows = spot[kept], rows[kept]
        sizes = self.sizes[spot]
        upto = np.cumsum(sizes)
        pairs = self.pairs[np.repeat(self.starts[spot] - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)]
        most = len(self.bytes_a) * len(self.bytes_b)
        both, times = np.unique(np.repeat(rows, sizes) * most + pairs, return_counts=True)
        return n_a, n_b, groups, tx.runs(both // most, n), both % most, times


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def alignments(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_a, n_b, groups, links): tokens and aligned groups of each text.

    Both tokenizers read a blank and the text. groups: `a1,a2|b1;a3|b2,b3`, ids of the two in order, cut where tokens
    of both end. links: array of struct(a, b, n), how often which ids end a group together.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        base = len(aligner.bytes_b)
        for batch in batches:
            for at, to, texts in tx.slices(batch.column(1)):
                n_a, n_b, groups, bounds, pairs, times = aligner.align(texts)
                links = pa.StructArray.from_arrays([pa.array((pairs // base).astype(np.int32)), pa.array((pairs % base).astype(np.int32)), pa.array(times)], ["a", "b", "n"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array(n_a), pa.array(n_b), pa.array(groups, pa.string()), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), links)],
                    [batch.schema.names[0], "n_a", "n_b", "groups", "links"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    out = source.mapInArrow(work, f"doc {kind}, n_a long, n_b long, groups string, links array<struct<a:int,b:int,n:long>>")
    return out.withColumnRenamed("doc", id_col)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, count, best): links of each pair of ids in the corpus, and whether no other pair of the same b has more.

    Of two ids that end together one's bytes end with the other's, so pairs are bounded by the vocabularies (for
    50 257 and 32 000 entries of the public files by 324 302), whatever the corpus.
    """
    links = aligned.select(F.explode("links").alias("l")).select("l.*")
    counts = links.groupBy("a", "b").agg(F.sum("n").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", show=lambda groups: groups) -> DataFrame:
    """(id_col, n_a, n_b, groups, n_groups, n_links, n_best, count_sum) of each row, links weighed by the whole corpus.

    `show` is applied to the groups before they are stored (their digest, say). n_best: links whose pair is the most
    frequent of its b, ties included; count_sum: the counts of all links' pairs. Null and empty texts, and texts that
    either tokenizer doesn't give back byte by byte after a blank, have no tokens: zeros and empty groups. Very long
    texts are encoded unit by unit. Repeated rows and ids, and null ids, are rows of their own; other columns of docs
    aren't read, so their names don't matter. An empty table gives no rows.
    """
    rows = alignments(docs, path_a, path_b, id_col, text_col).withColumn("groups", show(F.col("groups")))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = written(pair_counts(rows), "pairs")
    links = rows.select("row", F.explode("links").alias("l")).select("row", "l.*")
    weighed = links.join(F.broadcast(counts), ["a", "b"])  # bounded by the vocabularies
    sums = weighed.groupBy("row").agg(F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = rows.drop("links").join(sums, "row", "left")
    return out.select(id_col, "n_a", "n_b", "groups", zero("n_links").alias("n_groups"), zero("n_links"), zero("n_best"), zero("count_sum"))

"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates.

A document's set holds its distinct shingles of `width` words (words split at ASCII white space, A-Z lower-cased);
a text of fewer words is one shingle, a text without words has an empty set and links with nothing. Two documents
are linked when their sets' Jaccard similarity is at least `percent` / 100, confirmed on the full sets (of 64-bit
shingle hashes). Documents with equal sets are one class from the start and go through the search once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealmark.llm import text as tx
from sealmark.operators.components import connected_components
from sealmark.scratch import written

U64 = np.uint64
#: Classes up to this many (40 bytes each) are broadcast; a longer list is joined by a shuffle.
BROADCAST_CLASSES = 250_000
#: Members of a bucket that are paired with its centres under one join key; a fuller bucket is split.
SALT_MEMBERS = 2048


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of every text, one after another, and the n+1 bounds."""
    data, offsets = tx.raw(texts)
    starts, ends, rows = tx.words(data, offsets)
    hashes = tx.span_hashes(data, starts, ends)
    n = len(texts)
    bounds = tx.runs(rows, n)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(hashes) - width + 1), U64)
        for k in range(width):
            rolled += hashes[k : k + len(rolled)] * U64(2 * (0x51ED270B * (k + 1)) + 1)
        rolled = tx.mix(rolled)
        sets = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= width:
                own = np.sort(rolled[a : b - width + 1])
                sets.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
            elif b > a:
                whole = U64(b - a)
                for h in hashes[a:b]:
                    whole = tx.mix(np.array([whole + h]))[0] * U64(0x2545F4914F6CDD1D)
                sets.append(np.array([whole], U64))
            else:
                sets.append(np.zeros(0, U64))
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, U64)), np.concatenate(([0], np.cumsum(sizes)))


def _probes(bins: int, tries: int) -> np.ndarray:
    """probes[t, i]: the bin that the empty bin i looks at in try t."""
    seeds = np.arange(tries * bins, dtype=U64).reshape(tries, bins)
    return (tx.mix(seeds + U64(0xA0761D6478BD642F)) % U64(bins)).astype(np.int64)


def signatures(values: np.ndarray, bounds: np.ndarray, bins: int, tries: int = 160) -> np.ndarray:
    """One-permutation signatures: the least hash of each bin; an empty bin takes that of the first filled bin
    among its pseudo-random probes (the same for all texts), or of the next filled one when no probe meets any."""
    n = len(bounds) - 1
    rows = np.repeat(np.arange(n), np.diff(bounds))
    place = ((values >> U64(32)) * U64(bins) >> U64(32)).astype(np.int64)
    first = np.ones(len(values), bool)
    first[1:] = (place[1:] != place[:-1]) | (rows[1:] != rows[:-1])
    out, filled = np.zeros((n, bins), U64), np.zeros((n, bins), bool)
    out[rows[first], place[first]] = values[first]
    filled[rows[first], place[first]] = True
    r, c = np.nonzero(~filled & filled.any(1, keepdims=True))
    for probe in _probes(bins, tries):
        if not len(r):
            break
        hit = filled[r, probe[c]]
        out[r[hit], c[hit]] = out[r[hit], probe[c[hit]]]
        r, c = r[~hit], c[~hit]
    for k in range(1, bins):
        if not len(r):
            break
        other = (c + k) % bins
        hit = filled[r, other]
        out[r[hit], c[hit]] = out[r[hit], other[hit]]
        r, c = r[~hit], c[~hit]
    return out


def _set_hashes(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every whole set."""
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, U64), np.cumsum(values)))
        mixed = np.concatenate((np.zeros(1, U64), np.cumsum(tx.mix(values ^ U64(0x8EBC6AF09C88C6E3)))))
        return tuple(tx.mix(x[bounds[1:]] - x[bounds[:-1]]).view(np.int64) for x in (sums, mixed))


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, band_rows: int, least: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, buckets): two hashes of the whole set, and the band buckets of sets of `least` or more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, texts in tx.slices(batch.column(1)):
                values, bounds = shingle_sets(texts, width)
                sizes = np.diff(bounds)
                keys = np.zeros((to - at, bands), U64)
                large = np.flatnonzero(sizes >= least)
                if len(large):
                    with np.errstate(over="ignore"):
                        own = np.concatenate([values[bounds[i] : bounds[i + 1]] for i in large])
                        sig = signatures(own, np.concatenate(([0], np.cumsum(sizes[large]))), bands * band_rows)
                        sig = sig.reshape(len(large), bands, band_rows)
                        key = np.arange(bands, dtype=U64)[None, :] * U64(0xE7037ED1A0B428DB) + U64(1)
                        for k in range(band_rows):
                            key = tx.mix(key * U64(0x9FB21C651E98DF25) + sig[:, :, k])
                        keys[large] = key
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(sizes >= least, bands, 0)))).astype(np.int32)), pa.array(keys[sizes >= least].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at).cast(pa.int64()), pa.array(sizes), *map(pa.array, _set_hashes(values, bounds)), lists],
                    ["doc_id", "n_shingles", "set_a", "set_b", "buckets"],
                )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(work, "doc_id long, n_shingles long, set_a long, set_b long, buckets array<long>")


def full_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, set_a, set_b, shingles): the hashes of every text's set, and its sorted distinct shingle hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, texts in tx.slices(batch.column(1)):
                values, bounds = shingle_sets(texts, width)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *map(pa.array, _set_hashes(values, bounds)), lists], ["doc_id", "set_a", "set_b", "shingles"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(work, "doc_id long, set_a long, set_b long, shingles array<long>")


def _sets_of(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(class_key, shingles) of the classes (class_key, class_id, set_a, set_b); only their documents' texts are read again."""
    few = classes.count() <= BROADCAST_CLASSES
    small = F.broadcast if few else lambda df: df
    wanted = docs.join(small(classes.select("class_id")), docs[id_col] == F.col("class_id"), "left_semi")
    sets = full_sets(wanted, id_col, text_col, width).join(small(classes.withColumnRenamed("class_id", "doc_id")), ["doc_id", "set_a", "set_b"])
    one = sets.dropDuplicates(["class_key"] if few else ["doc_id", "set_a", "set_b"])  # rows repeated whole
    return written(one.select("class_key", "shingles"), "sets")


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs of classes that are linked by their full sets."""
    left = sets.select(F.col("class_key").alias("a"), F.col("shingles").alias("set_of_a"))
    right = sets.select(F.col("class_key").alias("b"), F.col("shingles").alias("set_of_b"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("set_of_a", "set_of_b"))
    union = F.size("set_of_a") + F.size("set_of_b") - common
    return both.where(common * 100 >= union * percent).select("a", "b")


def _mixed(placed: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component, with the bucket's least set size and its salts."""
    several = placed.groupBy("bucket").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n_shingles").alias("smallest"), F.ceil(F.count("*") / SALT_MEMBERS).cast("int").alias("salts")
    )
    return placed.drop("smallest", "salts").join(several.where("lo < hi").select("bucket", "smallest", "salts"), "bucket")


def _able(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """placed with `n_common`, without members that can't be linked with any other member.

    n_common counts the shingles of a member that some other member has too. A link of x and y needs
    percent / (100 + percent) * (|x| + |y|) common shingles or more, and |y| is at least the least size in x's
    buckets; a member with fewer is out. This is exact: it drops no link.
    """
    ids = placed.groupBy("class_key").agg(F.min("smallest").alias("smallest"), F.any_value("n_shingles").alias("n_shingles"))
    each = sets.join(ids.select("class_key"), "class_key", "left_semi").select("class_key", F.explode("shingles").alias("shingle"))
    twice = each.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").select("shingle")
    common = each.join(twice, "shingle", "left_semi").groupBy("class_key").agg(F.count("*").alias("n_common"))
    partner = F.greatest(F.ceil(F.col("n_shingles") * percent / 100), F.col("smallest"))
    able = common.join(ids, "class_key").where(F.col("n_common") * (100 + percent) >= (F.col("n_shingles") + partner) * percent)
    return _mixed(placed.drop("n_common").join(able.select("class_key", "n_common"), "class_key"))


def bands_for(percent: int, band_rows: int, missed: float = 1e-6) -> int:
    """Bands by which a link at the threshold shares no bucket with a chance below `missed`; 32 at least."""
    alike = (percent / 100) ** band_rows
    return max(32, int(np.ceil(np.log(missed) / np.log1p(-alike)))) if alike < 1 else 32


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85,
    bands: int | None = None, band_rows: int = 6, centres: tuple[int | None, ...] = (8, None),
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links), kept (it is its own).

    Members of a bucket are paired with a centre, the member that shares most bucket places with others, so a
    bucket of n gives n - 1 pairs. That can miss links between two members of which the centre is too far, so
    buckets which still hold more than one component are searched again with more centres, and at last with
    every member as a centre. Those searches leave out pairs inside a component, and pairs that can't be linked
    by counts of the shingles which members share; each pair is formed in the first bucket that it shares. Unless
    given, bands are so many that a link at the threshold shares no bucket with a chance below 1e-6, and 32 at least:
    (1 - 0.85^6)^32, (1 - 0.80^6)^46.

    Null or empty texts: empty set, own component. A null id is in no link: component_id null, kept. Rows that
    repeat an id count as one document: their texts, equal or not, are linked through the id, an empty one too.
    Very long texts are hashed whole; one text's set of shingle hashes must fit a task. Equal sizes or hashes need
    no order: components don't depend on it. An empty table gives no rows. Other columns of docs are not read. The
    result is lazy; the search for links runs at the call.
    """
    least = int(np.ceil(percent / (100 - percent) - 1e-9)) if percent < 100 else 1 << 40
    if bands is None:
        bands = bands_for(percent, band_rows)
    marks = written(sketches(docs, id_col, text_col, width, bands, band_rows, least), "sketches")
    some = marks.where("n_shingles > 0 and doc_id is not null")
    own = ["n_shingles", "set_a", "set_b"]
    # Classes are told apart by a number given when the table is written: an id can stand in several.
    classes = some.groupBy(*own).agg(F.min("doc_id").alias("class_id"), F.any_value("buckets").alias("buckets"))
    classes = written(classes.withColumn("class_key", F.monotonically_increasing_id()), "classes")
    repeated = marks.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    through = written(some.join(repeated, "doc_id").join(classes.drop("buckets", "class_id"), own).select("doc_id", "class_key").distinct(), "repeated")
    firsts = through.groupBy("doc_id").agg(F.min("class_key").alias("a"))
    pooled = through.join(firsts, "doc_id").select("a", F.col("class_key").alias("b")).where("a <> b")
    members = classes.where(F.size("buckets") > 0).select("class_key", "n_shingles", F.explode("buckets").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = written(members.join(shared, "bucket"), "buckets")
    places = members.groupBy("class_key").agg(F.sum("n").alias("places"), F.any_value("n_shingles").alias("n_shingles"))
    wanted = classes.join(places.select("class_key"), "class_key", "left_semi").select("class_key", "class_id", "set_a", "set_b")
    sets = _sets_of(docs, written(wanted, "shared"), id_col, text_col, width)
    top = F.max(F.struct("places", -F.col("class_key"), "n_shingles"))
    star = members.select("bucket", "class_key").join(places, "class_key").groupBy("bucket").agg(top.alias("c"))
    star = star.select("bucket", (-F.col("c.col2")).alias("centre"), F.col("c.n_shingles").alias("centre_size"))
    fits = F.least("n_shingles", "centre_size") * 100 >= F.greatest("n_shingles", "centre_size") * percent
    ends = (F.least("class_key", "centre").alias("a"), F.greatest("class_key", "centre").alias("b"))
    pairs = written(members.join(star, "bucket").where((F.col("class_key") != F.col("centre")) & fits).select(*ends).distinct(), "pairs")
    links = written(pooled.union(_confirmed(sets, pairs, percent)), "links")
    for slots in centres:
        at = connected_components(links).withColumnRenamed("node", "class_key")
        placed = members.drop("n").join(at, "class_key", "left").withColumn("component", F.coalesce("component", "class_key"))
        placed = written(_mixed(placed), "mixed")
        for _ in range(2):  # the second time without the shingles of those that fell out
            placed = written(_able(placed, sets, percent), "able")
        if placed.isEmpty():
            break
        placed = placed.drop("smallest").join(classes.select("class_key", "buckets"), "class_key")
        chosen = placed
        if slots is not None:
            best = F.min(F.struct(F.xxhash64("class_key").alias("h"), "class_key", "n_shingles", "component", "n_common", "buckets", "salts"))
            chosen = placed.groupBy("bucket", F.pmod(F.xxhash64("class_key"), F.lit(slots)).alias("slot")).agg(best.alias("c")).select("bucket", "c.*")
        chosen = chosen.select(
            "bucket", F.col("class_key").alias("centre"), F.col("n_shingles").alias("centre_size"), F.col("component").alias("other"),
            F.col("n_common").alias("centre_common"), F.col("buckets").alias("centre_buckets"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        )
        enough = F.least("n_common", "centre_common") * (100 + percent) >= (F.col("n_shingles") + F.col("centre_size")) * percent
        once = F.get(F.array_intersect("buckets", "centre_buckets"), F.lit(0)) == F.col("bucket") if slots is None else F.lit(True)
        half = F.col("class_key") < F.col("centre") if slots is None else F.col("class_key") != F.col("centre")
        salted = placed.withColumn("salt", F.pmod(F.xxhash64("class_key"), F.col("salts")).cast("int"))
        pairs = salted.join(chosen, ["bucket", "salt"]).where((F.col("component") != F.col("other")) & half & fits & enough & once)
        pairs = written(pairs.select(*ends).distinct(), "pairs")
        links = written(links.union(_confirmed(sets, pairs, percent)), "links")
    found = connected_components(links).withColumnRenamed("node", "class_key")
    linked = found.join(classes.select("class_key", "class_id"), "class_key")
    linked = linked.join(linked.groupBy("component").agg(F.min("class_id").alias("least_id")), "component").select("class_key", "least_id")
    placed = classes.join(linked, "class_key", "left").select(*own, "class_key", F.coalesce("least_id", "class_id").alias("component_id"))
    out = marks.drop("buckets").join(placed.drop("class_key"), own, "left")
    blank = marks.where("n_shingles = 0").join(through.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id").distinct()
    if not blank.isEmpty():  # empty texts under an id that has others
        of_id = through.join(blank, "doc_id").join(placed, "class_key").groupBy("doc_id").agg(F.min("component_id").alias("of_id"))
        out = out.join(of_id, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "of_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))

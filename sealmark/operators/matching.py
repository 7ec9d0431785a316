"""Face matching: scores, identification in a gallery, evaluation pairs, template protection."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealmark.scratch import written

#: Bytes of vectors (as floats) in a block of the gallery and of the probes, and rows of each that are compared at once.
GALLERY_BYTES, PROBE_BYTES = 64 << 20, 64 << 20
BLOCK, GALLERY_ROWS = 1024, 8192


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def match_score(a: Column, b: Column) -> Column:
    """(a.b + 1) / 2 of unit vectors, held to 0..1, 4 decimals; null, empty or unequal lengths give 0."""
    ok = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(F.coalesce(ok, F.lit(False)), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dot(a, b) + 1) / 2)), 4)).otherwise(0.0)


def _blocks(rows: DataFrame, name: str, most_bytes: int, tasks: int) -> tuple[DataFrame, int]:
    """rows with `name`, the number of a block of about most_bytes of vectors or less, by a hash of the id; and how many there are."""
    size, n = rows.agg(F.coalesce(F.sum(F.size("embedding") * 4 + 64), F.lit(0)), F.count("*")).first()
    blocks = max(1, -(-size // most_bytes), min(tasks, n // BLOCK))
    return rows.withColumn(name, F.pmod(F.xxhash64(rows.columns[0]), F.lit(blocks)).cast("int")), blocks


def unit_scores(probes: np.ndarray, gallery: np.ndarray) -> np.ndarray:
    """Scores of unit vectors, a row of `probes` with a row of `gallery`: (a.b + 1) / 2, held to 0..1."""
    return np.clip((probes @ gallery.T + 1) / 2, 0, 1)


def identify(probes: DataFrame, gallery: DataFrame, threshold: float = 0.72, scorer=unit_scores) -> DataFrame:
    """(probe_id, face_id, score): per probe the best active profile, ties by face_id; face_id null below threshold.

    The score is compared with 4 decimals and reported with 2; one of 0 finds nobody. probes: probe_id, embedding;
    gallery: face_id, active, embedding. `scorer` takes two matrices of the same width, a vector in each row, and
    gives a matrix of scores; it runs inside tasks, on at most BLOCK x GALLERY_ROWS pairs at once.

    Exact: every probe meets every template of its length. Both sides are cut into blocks of bounded size, as few as
    keep the tasks busy, since each block of one side is sent once per block of the other; each pair of blocks is one
    task's work, and a probe keeps one row per block. Nothing passes the driver.
    """
    kind = probes.schema["probe_id"].dataType.simpleString()
    tasks = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vectors = lambda df, key: df.select(key, F.col("embedding").cast("array<float>").alias("embedding"))
    own, n_own = _blocks(vectors(gallery.where("active and embedding is not null and size(embedding) > 0"), "face_id"), "own", GALLERY_BYTES, round(tasks**0.5))
    asked, n_asked = _blocks(vectors(probes, "probe_id"), "asked", PROBE_BYTES, round(tasks**0.5))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("own", every(n_own)).select("asked", "own", "probe_id", "embedding")
    right = own.withColumn("asked", every(n_asked)).select("asked", "own", "face_id", "embedding")

    def match(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        ids, scores = np.full(len(mine), None, object), np.zeros(len(mine))
        theirs = theirs.sort_values("face_id")
        sizes = mine["embedding"].map(lambda v: 0 if v is None else len(v)).to_numpy()
        for d, group in theirs.groupby(theirs["embedding"].map(len)):
            rows = np.flatnonzero(sizes == d)
            if not len(rows):
                continue
            names, asks = group["face_id"].to_numpy(), np.stack(mine["embedding"].to_numpy()[rows])
            for start in range(0, len(names), GALLERY_ROWS):
                matrix = np.stack(group["embedding"].to_numpy()[start : start + GALLERY_ROWS]).astype(np.float64)
                for at in range(0, len(rows), BLOCK):
                    part = rows[at : at + BLOCK]
                    s = np.round(scorer(asks[at : at + BLOCK].astype(np.float64), matrix), 4)
                    j = s.argmax(1)  # the first of equals: names are sorted
                    top = s[np.arange(len(part)), j]
                    better = top > scores[part]  # an equal one further on has a later name
                    ids[part[better]], scores[part[better]] = names[start + j[better]], top[better]
        return pd.DataFrame({"probe_id": mine["probe_id"], "face_id": ids, "score4": scores})

    found = left.groupBy("asked", "own").cogroup(right.groupBy("asked", "own")).applyInPandas(match, f"probe_id {kind}, face_id string, score4 double")
    top = F.max("score4")
    best = found.groupBy("probe_id").agg(top.alias("score4"), F.min_by("face_id", F.struct(-F.col("score4"), F.col("face_id").isNull(), "face_id")).alias("face_id"))
    hit = (F.col("score4") >= threshold) & F.col("face_id").isNotNull()
    return best.select("probe_id", F.when(hit, F.col("face_id")).alias("face_id"), F.round("score4", 2).alias("score"))


def protection_matrix(key: bytes, dim: int) -> np.ndarray:
    """An orthonormal matrix that the key determines: QR of a seeded normal matrix, signs fixed by R's diagonal."""
    seed = int.from_bytes(hashlib.sha256(key + b"|" + str(dim).encode()).digest(), "big")
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def protect_templates(rows: DataFrame, key: bytes | None, column: str = "embedding") -> DataFrame:
    """rows with the templates turned by the key's matrix: products stay, another key makes them strangers. No key: as is."""
    if not key:
        return rows

    @F.pandas_udf("array<double>")
    def turn(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), dtype=object)
        sizes = vectors.map(lambda v: -1 if v is None else len(v))
        for d in sizes.unique():
            at = np.flatnonzero(sizes == d)
            if d > 0:
                turned = np.stack(vectors.to_numpy()[at]).astype(np.float64) @ protection_matrix(key, int(d)).T
                for i, v in zip(at, turned):
                    out.iat[i] = v
            elif d == 0:
                for i in at:
                    out.iat[i] = []
        return out

    return rows.withColumn(column, turn(F.col(column)))


def split_references(files: DataFrame, hints: tuple[str, ...]) -> DataFrame:
    """files (identity, name) with role: reference for the first name that holds a hint, else the first; selfie for the
    rest; skipped when an identity has one file only."""
    hint = F.lower("name").rlike("|".join(hints))
    place = F.row_number().over(Window.partitionBy("identity").orderBy(F.desc(hint), "name"))
    n = F.count("*").over(Window.partitionBy("identity"))
    return files.withColumn("role", F.when(n < 2, "skipped").when(place == 1, "reference").otherwise("selfie"))


def genuine_pairs(references: DataFrame, selfies: DataFrame) -> DataFrame:
    """Scores of each reference with the selfies of its own identity. Both: identity, vec_id, embedding."""
    r, s = (x.select("identity", F.col("vec_id").alias(f"{n}_id"), F.col("embedding").alias(f"{n}_vector")) for x, n in ((references, "ref"), (selfies, "selfie")))
    return r.join(s, "identity").select(F.lit("genuine").alias("pair"), "ref_id", "selfie_id", match_score(F.col("ref_vector"), F.col("selfie_vector")).alias("score"))


def _numbered(rows: DataFrame, *order) -> DataFrame:
    """rows with `place`, from 0 in order: counted inside range partitions, whose offsets are a row each."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    inside = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    inside = written(inside, "ordered").withColumns({"part": F.shiftright("at", 33), "nth": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = inside.groupBy("part").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row per partition
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return inside.join(F.broadcast(offsets), "part").select(*rows.columns, (F.col("before") + F.col("nth")).alias("place"))


def impostor_pairs(references: DataFrame, selfies: DataFrame, most: int = 8) -> DataFrame:
    """Scores of each reference with at most `most` selfies of other identities, whole identities first.

    Identities stand in a circle by the hash of their names; a reference meets the `most` that follow it, one or more
    selfies each, so no pairs beyond most * identities are made. Repeatable.
    """
    ring = _numbered(references.select("identity").distinct(), F.md5(F.col("identity").cast("string")), "identity")
    n = ring.agg(F.count("*").alias("n"))
    steps = ring.crossJoin(F.broadcast(n)).select("identity", "n", "place", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("j")).where("j < n")
    meets = steps.withColumn("other_place", (F.col("place") + F.col("j")) % F.col("n"))
    others = ring.select(F.col("identity").alias("other"), F.col("place").alias("other_place"))
    meets = meets.join(others, "other_place").select("identity", "other", "j")
    few = selfies.withColumn("nth", F.row_number().over(Window.partitionBy("identity").orderBy("vec_id"))).where(F.col("nth") <= most)
    few = few.select(F.col("identity").alias("other"), F.col("vec_id").alias("selfie_id"), F.col("embedding").alias("selfie_vector"))
    r = references.select("identity", F.col("vec_id").alias("ref_id"), F.col("embedding").alias("ref_vector"))
    pairs = r.join(meets, "identity").join(few, "other")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("ref_id").orderBy("j", "selfie_id"))).where(F.col("rank") <= most)
    return pairs.select(F.lit("impostor").alias("pair"), "ref_id", "selfie_id", match_score(F.col("ref_vector"), F.col("selfie_vector")).alias("score"))

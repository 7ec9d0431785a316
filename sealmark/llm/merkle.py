"""A Merkle manifest of a dataset, and versions of it in which leaves were tampered with.

Leaves of a group (a language) are numbered in order and dealt to aligned blocks; a block's tree is built in one
task, the levels above by grouping in Spark. A version shares all nodes of the tree but the ancestors of its leaf:
inside a block these are copied, above it they follow from the block's path, which a distributed pass over the upper
levels has written.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealmark.llm.ordered import in_parts
from sealmark.scratch import written

WIDTH = 8
#: Levels inside a block: 8 ** 4 leaves.
BLOCK_LEVELS = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(*values: Column) -> Column:
    """The digest of values, each as its UTF-8 byte count, a colon and itself, or - for null."""
    said = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return digest(F.concat(*said))


def tampered_here(id_col: Column) -> Column:
    """Is a row's text lower-cased after its leaf was made? By the crc of its id; a row without one is not."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def _numbered(leaves: DataFrame, by: str, *order: str) -> DataFrame:
    """leaves with `nr`, their place from 0 among those of the same `by` (not null), and `n`, how many these are.

    A range sort, then per part the place among the rows of a key; before it come the key's rows in earlier parts.
    """
    placed = in_parts(leaves, "sorted", by, *order)
    runs = placed.groupBy(by, "part").agg(F.count("*").alias("size"), F.min("at").alias("first"))
    own = Window.partitionBy(by)
    upto = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col(by).alias("run_by"), F.col("part").alias("run_part"), "first", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("before"), F.sum("size").over(own).alias("n"))
    rows = placed.join(runs, (F.col(by) == F.col("run_by")) & (F.col("part") == F.col("run_part")))
    return rows.withColumn("nr", F.col("before") + F.col("at") - F.col("first")).drop("run_by", "run_part", "first", "before", "at", "part")


def _members(nodes: DataFrame) -> DataFrame:
    """(g, nr, n, run): the node above each run of nodes (g, nr, n, hash), with the digests of the run in order."""
    run = F.sort_array(F.collect_list(F.struct("nr", "hash")))["hash"]
    up = F.floor(F.col("nr") / WIDTH).alias("up")
    return nodes.groupBy("g", up).agg(F.max("n").alias("n"), run.alias("run")).select("g", F.col("up").alias("nr"), F.ceil(F.col("n") / WIDTH).alias("n"), "run")


def paths(nodes: DataFrame) -> DataFrame:
    """(g, nr, path, top) of nodes (g, nr, n, hash), each group g a row of n nodes numbered from 0.

    top is what remains when runs of 8 have become their digest until one is left. path has, for every level below
    it, struct(before, after): the digests of the node's run on its left and right. Levels are joined from the top
    down; there are log8(n) of them, each an eighth of the one below.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels = []
    while most > 1:
        runs = written(_members(nodes.where("n > 1")), "runs")
        levels.append(runs)
        # groups of one node are done; they rejoin on the way down
        nodes = runs.select("g", "nr", "n", digest(F.array_join("run", "")).alias("hash")).union(nodes.where("n = 1").select("g", "nr", "n", "hash"))
        most = -(-most // WIDTH)
    down = nodes.select("g", "nr", F.array().cast("array<struct<before:string,after:string>>").alias("path"), F.col("hash").alias("top"))
    for runs in reversed(levels):
        here = runs.withColumnsRenamed({"g": "run_g", "nr": "run_nr"})
        there = down.join(here, (F.col("g") == F.col("run_g")) & (F.col("nr") == F.col("run_nr")), "left")
        side = lambda a, n: F.array_join(F.slice("run", a, n), "")
        child = F.transform("run", lambda h, i: F.struct(
            (F.col("nr") * WIDTH + i).alias("nr"), F.concat(F.array(F.struct(side(F.lit(1), i).alias("before"), side(i + 2, F.lit(WIDTH)).alias("after"))), F.col("path")).alias("path"),
        ))
        # a group that had one node already has no run here
        child = F.when(F.col("run").isNull(), F.array(F.struct("nr", "path"))).otherwise(child)
        down = written(there.select("g", "top", F.explode(child).alias("c")).select("g", "c.nr", "c.path", "top"), "paths")
    return down


def sha2_hex(text: str) -> str:
    return sha256(text.encode()).hexdigest()


class Block:
    """The tree over the leaves of an aligned block: levels of digests, shared by all versions."""

    def __init__(self, leaves: list[str], levels: int | None):
        """levels: how many rounds, or until one node is left."""
        self.levels = [leaves]
        while len(self.levels) <= levels if levels is not None else len(self.levels[-1]) > 1:
            row = self.levels[-1]
            self.levels.append([sha2_hex("".join(row[k : k + WIDTH])) for k in range(0, len(row), WIDTH)])
        self.top = self.levels[-1][0]

    def siblings(self, i: int) -> str:
        """The digests beside the i-th leaf and its ancestors, up to the top."""
        out = []
        for row in self.levels[:-1]:
            low = i - i % WIDTH
            out += row[low:i] + row[i + 1 : low + WIDTH]
            i //= WIDTH
        return "".join(out)

    def version(self, i: int, leaf: str) -> list[str]:
        """The nodes copied when the i-th leaf becomes `leaf`: that leaf and its ancestors, up to a top of its own."""
        copied = [leaf]
        for row in self.levels[:-1]:
            low = i - i % WIDTH
            copied.append(sha2_hex("".join([*row[low:i], copied[-1], *row[i + 1 : low + WIDTH]])))
            i //= WIDTH
        return copied


def _block(leaves: list[str], n: int) -> Block:
    return Block(leaves, BLOCK_LEVELS if n > WIDTH**BLOCK_LEVELS else None)


def blocks(docs: DataFrame, id_col: str, group_col: str, fields: tuple[str, ...], text_col: str) -> tuple[DataFrame, DataFrame]:
    """Two tables of aligned blocks of at most 4096 leaves: (g, block, n, leaves), and (g, block, n, hash), the node above each.

    g codes the group so that null comes first; n is the number of its leaves. leaves: struct(nr, id, leaf, changed),
    changed being the leaf after tampering, null where there is none. Rows are numbered by id, null first, those that
    repeat one by their leaf.
    """
    # the fields as they are, and with a lower-cased text
    bare = F.translate(F.col(text_col).cast("string"), UPPER, LOWER)
    changed = F.when(tampered_here(F.col(id_col)), leaf(*(bare if f == text_col else F.col(f) for f in fields)))
    g = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("-"))
    rows = docs.select(g.alias("g"), F.col(id_col).alias("id"), leaf(*(F.col(f) for f in fields)).alias("leaf"), changed.alias("changed"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    rows = _numbered(rows, "g", "id", "leaf", "row")
    per = rows.groupBy("g", F.floor(F.col("nr") / WIDTH**BLOCK_LEVELS).alias("block"), "n")
    dealt = written(per.agg(F.sort_array(F.collect_list(F.struct("nr", "id", "leaf", "changed"))).alias("leaves")), "blocks")

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_block(leaves.as_py(), n.as_py()).top for leaves, n in zip(batch.column(3), batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.string())], ["g", "block", "n", "hash"])

    above = dealt.select("g", "block", "n", F.col("leaves.leaf").alias("leaves")).mapInArrow(tops, "g string, block long, n long, hash string")
    return dealt, written(above, "tops")


def manifest(
    docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text",
) -> DataFrame:
    """(id_col, leaf, subroot, root, siblings, changed, folded_root, copied) of every row.

    A leaf is the digest of the row's fields; leaves of a group ascend by id, runs of 8 become their digest until a
    subroot is left, and subroots by group (null first) likewise give the root. siblings: the digests beside the leaf
    and its ancestors, all levels joined. changed: the leaf after tampering, null if the row isn't; folded_root: the
    root of its version; copied: how many nodes that version has of its own.

    Null fields, and empty and very long texts, are leaves like others (a text is hashed where it is read and not
    moved). Null ids come first in their group and aren't tampered with; rows that repeat an id stand by their leaf,
    equal rows are leaves of their own. Other columns of docs aren't read, so their names don't matter. An empty
    table gives no rows.
    """
    dealt, tops = blocks(docs, id_col, group_col, fields, text_col)
    count = F.when(F.col("n") > WIDTH**BLOCK_LEVELS, F.ceil(F.col("n") / WIDTH**BLOCK_LEVELS)).otherwise(1)
    inside = paths(tops.select("g", F.col("block").alias("nr"), count.cast("long").alias("n"), "hash"))
    subroots = inside.where("nr = 0").select("g", F.col("top").alias("hash"))
    ranked = _numbered(subroots.withColumn("all", F.lit("")), "all", "g").select(F.col("all").alias("g"), "nr", "n", "hash", F.col("g").alias("name"))
    ranked = written(ranked, "subroots")
    over = paths(ranked.select("g", "nr", "n", "hash")).select(F.col("nr").alias("group_nr"), F.col("path").alias("group_path"), F.col("top").alias("root"))
    over = ranked.join(over, F.col("nr") == F.col("group_nr")).select(F.col("name").alias("group_name"), "group_path", "root")
    way = inside.join(over, F.col("g") == F.col("group_name")).select(
        F.col("g").alias("way_g"), F.col("nr").alias("way_block"), F.concat("path", "group_path").alias("path"), F.col("top").alias("subroot"), "root"
    )
    whole = dealt.join(way, (F.col("g") == F.col("way_g")) & (F.col("block") == F.col("way_block"))).select("n", "path", "subroot", "root", "leaves")
    kind = docs.schema[id_col].dataType.simpleString()

    def versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one block at a time as Python values
                (row,) = batch.slice(k, 1).to_pylist()
                tree = _block([x["leaf"] for x in row["leaves"]], row["n"])
                beside = "".join(s["before"] + s["after"] for s in row["path"])
                fold = lambda top, path=row["path"]: reduce(lambda h, s: sha2_hex(s["before"] + h + s["after"]), path, top)
                as_is = fold(tree.top)
                out = []
                for i, x in enumerate(row["leaves"]):
                    own = [] if x["changed"] is None else tree.version(i, x["changed"])
                    root = fold(own[-1]) if own else as_is
                    out.append((x["id"], x["leaf"], row["subroot"], row["root"], tree.siblings(i) + beside, x["changed"], root, len(own) and len(own) + len(row["path"])))
                    if len(out) == 512:
                        yield _rows(out, id_type)
                        out = []
                if out:
                    yield _rows(out, id_type)

    id_type = pa.int64() if kind in ("bigint", "int", "smallint", "tinyint") else pa.string()
    if id_type == pa.string():
        whole = whole.withColumn("leaves", F.transform("leaves", lambda x: x.withField("id", x["id"].cast("string"))))
    fields_out = "leaf string, subroot string, root string, siblings string, changed string, folded_root string, copied long"
    made = whole.mapInArrow(versions, f"id {'bigint' if id_type == pa.int64() else 'string'}, {fields_out}")
    return made.select(F.col("id").cast(kind).alias(id_col), "leaf", "subroot", "root", "siblings", "changed", "folded_root", "copied")


def _rows(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [id_type, *[pa.string()] * 6, pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["id", "leaf", "subroot", "root", "siblings", "changed", "folded_root", "copied"])

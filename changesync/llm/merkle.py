"""Merkle manifest of a dataset: a digest per row, per group and for the whole, with proofs.

Leaves are numbered inside their group and cut into aligned blocks. A block keeps each of its
levels as one string of hex digests, so a node is a fixed-width substring, a parent is the hash
of the next `fan` of them, and the siblings of a node are the substrings on its two sides. The
block roots are the nodes of the next tier, cut into blocks again, until one node a group is
left; the groups' roots form a tree of their own in the same way.

Proofs go down tier by tier: a block hands its nodes the siblings above them, so a row meets its
siblings where its block is opened, and no list longer than a block is ever gathered.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from changesync.storage import Scratch

HEX = 64  # characters of a digest
PATH = "ARRAY<STRUCT<l: STRING, r: STRING>>"


@dataclass(frozen=True)
class Tree:
    """Children of a node, and how many levels a block spans."""

    fan: int = 16
    levels: int = 2

    @property
    def block(self) -> int:
        return self.fan**self.levels


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value: no two rows write alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _numbered(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """`rows` with `pos` and `n`, their place in their group `g` and its size.

    The rows are dealt by ranges of (g, order) and written; places inside a part are counted
    from the written order, and the parts of a group are summed, one row a part and group.
    """
    ranged = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    placed = scratch.keep(ranged.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "placed")
    held = placed.groupBy("part", "g").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    group = Window.partitionBy("g")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = held.select(
        "part", "g", (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("held").over(group).alias("n"),
    )
    return placed.join(shifts, ["part", "g"]).select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "n")


def _parents(level: Column, tree: Tree) -> Column:
    """The next level of a block: every `fan` digests hashed to one."""
    wide = HEX * tree.fan
    runs = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(level) / wide).cast("int"), F.lit(1)) - 1)
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * wide + 1, F.lit(wide)).cast("binary"), 256)), "")


def _tier(nodes: DataFrame, tree: Tree, payload: list[str]) -> DataFrame:
    """Blocks of `nodes` (g, pos, n, digest): (g, block, n, rises, level0.., top, members).

    A group rises one level at a time while it has several nodes, so a block of a small group
    has fewer levels. `members` are the payloads in the order of the nodes.
    """
    gathered = nodes.groupBy("g", F.floor(F.col("pos") / tree.block).alias("block"), "n").agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", *payload))).alias("all")
    )
    rises = F.lit(tree.levels)
    for done in reversed(range(tree.levels)):
        rises = F.when(F.col("n") <= tree.fan**done, F.lit(done)).otherwise(rises)
    out = gathered.select(
        "g", "block", "n", rises.alias("rises"), F.array_join(F.col("all.digest"), "").alias("level0"),
        F.transform("all", lambda m: F.struct(m["pos"].alias("pos"), *[m[c].alias(c) for c in payload])).alias("members"),
    )
    top = F.col("level0")
    for i in range(1, tree.levels + 1):
        out = out.withColumn(f"level{i}", F.when(F.col("rises") >= i, _parents(F.col(f"level{i - 1}"), tree)))
        top = F.coalesce(F.col(f"level{i}"), top)
    return out.withColumn("top", top)


def _tiers(nodes: DataFrame, tree: Tree, scratch: Scratch, payload: list[str]) -> list[DataFrame]:
    """The blocks of every tier, each written; the last one has a single block a group."""
    tiers = [scratch.keep(_tier(nodes, tree, payload), "blocks")]
    while (tiers[-1].agg(F.max("n")).first()[0] or 0) > tree.block:
        above = tiers[-1].select(
            "g", F.col("block").alias("pos"), F.ceil(F.col("n") / tree.block).alias("n"), F.col("top").alias("digest")
        )
        tiers.append(scratch.keep(_tier(above, tree, []), "blocks"))
    return tiers


def _roots(tiers: list[DataFrame], tree: Tree) -> DataFrame:
    """(g, digest): the one node that is left of each group, in the tier where it becomes one."""
    done = [t.filter(F.col("n").between(1 if i == 0 else 2, tree.block)).select("g", F.col("top").alias("digest")) for i, t in enumerate(tiers)]
    roots = done[0]
    for more in done[1:]:
        roots = roots.unionByName(more)
    return roots


def _flanks(at: Column, tree: Tree) -> Column:
    """Siblings of the node at place `at` of a block, on each level that the block rises."""
    steps = []
    for i in range(tree.levels):
        here = F.floor(at / tree.fan**i).cast("int")
        first = (F.floor(here / tree.fan) * tree.fan).cast("int")
        level = F.col(f"level{i}")
        left = F.substring(level, first * HEX + 1, (here - first) * HEX)
        right = F.substring(level, (here + 1) * HEX + 1, (first + tree.fan - 1 - here) * HEX)
        steps.append(F.when(F.col("rises") > i, F.struct(left.alias("l"), right.alias("r"))))
    return F.array_compact(F.array(*steps)).cast(PATH)


def _opened(blocks: DataFrame, tree: Tree, carried: list[str]) -> DataFrame:
    """A row per node of `blocks` (with `path`, the siblings above): pos, digest and whole path."""
    nodes = blocks.select("*", F.posexplode("members").alias("at", "member"))
    return nodes.select(
        "g", "member.*", F.substring("level0", F.col("at") * HEX + 1, F.lit(HEX)).alias("digest"),
        F.concat(_flanks(F.col("at"), tree), "path").alias("path"), *carried,
    )


def _descend(tiers: list[DataFrame], above: DataFrame, tree: Tree, carried: list[str]) -> DataFrame:
    """The nodes of the lowest tier with all their siblings. `above` has a row per group: g, the path from
    its root on, and what every node of the group is to carry."""
    met = None
    for i in reversed(range(len(tiers))):
        # A group whose last tier this is has one block, whose path is that of the group.
        last = F.col("n") <= tree.block
        fresh = tiers[i].filter(last & (F.lit(i == 0) | (F.col("n") > 1))).join(above, "g")
        blocks = fresh
        if met is not None:
            paths = met.select("g", F.col("pos").alias("block"), "path", *carried)
            blocks = fresh.unionByName(tiers[i].filter(~last).join(paths, ["g", "block"]).select(*fresh.columns))
        met = _opened(blocks, tree, carried)
    return met


def folded(start: Column, path: str = "path") -> Column:
    """The root that a leaf and its siblings, level by level, lead to."""
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(s["l"], node, s["r"]).cast("binary"), 256))


def manifest(
    docs: DataFrame, fields: tuple[str, ...], claimed: Column | None = None, group: str = "source", key: str = "doc_id",
    tree: Tree = Tree(), with_path: bool = False,
) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of `docs`.

    A leaf is the digest of `fields`; per `group` the leaves ascend by `key` (nulls first, ties
    by their digest, so equal rows may stand for each other), and the groups by name (null
    first, bytewise). `claimed` is the digest of what another copy of the row holds, null for
    the leaf itself; `folded_root` is computed from it and the siblings, and `verified` says whether it
    is the root. `with_path` adds the siblings themselves. Nulls are values of their own, repeated rows
    are leaves of their own, other columns are ignored, and an empty table has an empty manifest.
    """
    spark = docs.sparkSession
    passing, kept = Scratch(spark), Scratch(spark)
    name = F.col(group).cast("string")
    leaves = passing.keep(docs.select(
        F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("g"), F.col(key).cast("long").alias("doc_id"),
        leaf(*[F.col(f) for f in fields]).alias("digest"), (F.lit(None) if claimed is None else claimed).cast("string").alias("claimed"),
    ), "leaves")
    tiers = _tiers(_numbered(leaves, ["doc_id", "digest"], passing), tree, kept, ["doc_id", "claimed"])

    roots = kept.keep(_roots(tiers, tree), "subroots")
    ordered = _numbered(roots.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), ["name"], passing)
    upper = _tiers(ordered, tree, kept, ["name"])
    root = _roots(upper, tree).select("g", F.col("digest").alias("root")).withColumn("path", F.lit(None).cast(PATH))
    subroots = _descend(upper, root.withColumn("path", F.expr(f"CAST(array() AS {PATH})")), tree, ["root"])
    above = kept.keep(subroots.select(F.col("name").alias("g"), F.col("digest").alias("subroot"), "root", "path"), "above")
    passing.delete()

    rows = _descend(tiers, above, tree, ["subroot", "root"])
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), "")
    out = rows.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"),
        folded(F.coalesce("claimed", "digest")).alias("folded_root"), *(["path"] if with_path else []),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered_leaf() -> Column:
    """The digest of a copy whose text lost its capitals A-Z, for rows where 5 divides the CRC-32 of the
    decimal doc_id; null elsewhere, and where doc_id is null."""
    values = [F.translate("text", CAPITALS, CAPITALS.lower()) if f == "text" else F.col(f) for f in FIELDS]
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf(*values))

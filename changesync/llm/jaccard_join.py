"""Exact set-similarity self-join on word shingles, with skipping by relations between sets.

Two sets link when 100 * |x & y| >= 85 * |x | y|. Their answers are wanted as classes (connected
components), with no link between different texts lost.

1. Equal sets become one: a class of copies is represented by one row.
2. Prefix index. Shingles have a global order, rarest first (by a count sketch of fixed size; any
   order is right, a good one makes lists short). Linked sets share a shingle among the first
   |x| - ceil(0.85 |x|) + 1 of each. The index lists the sets per prefix shingle, each with how
   many elements it has from there on. In the list of the first shingle that two sets share, the
   overlap is no larger than the smaller of these two numbers, so in any list a pair that its positions
   rule out is skipped: if it links, its first list has it.
3. Index-level skipping. A passage that many sets share gives one list per shingle, all equal:
   equal lists are found by fingerprint and the earliest in the order is kept, which has the
   positions that count. Lists in which no set stands early enough to link are left out.
4. Answer-level skipping. Per list a few centres, drawn at random, are compared with all
   members. A member's answers are then derived from its centre's: members of one class need no
   comparison, and by the triangle inequality of the Jaccard distance neither do members whose
   distances to a centre differ by more than 0.15.
5. What is left of a list, pairs of different classes, is compared block by block of bounded
   size. The members of a block stand in the order of their sizes, so that a set skips from the
   first one whose size it cannot link to, and leaves out those that positions rule out. A set
   meets the likeliest few others first; once their classes are joined few pairs are of different ones,
   and rounds go on until all that are left were compared.
6. Once the classes are known, the links of each set are counted: linked sets are of one class, so
   every two blocks of a class meet once. A set goes there as its difference from the centre of its
   class. Distances to the centre decide what they can (too far apart, or near enough to it); for
   the other pairs the overlap follows from the two differences alone.

Comparisons first bound the overlap by the parity of bit maps (exact: it never drops a link; a map
has about as many bits as its set has elements, the larger of two is folded), then intersect the whole sets. Classes need stars, not all pairs; the counts of step 6 leave a
block as one number per set, so no table holds a row per pair of a large group.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from changesync.llm import words as W
from changesync.llm.components import components
from changesync.llm.counters import tree_sum
from changesync.storage import Scratch


@dataclass(frozen=True)
class Join:
    width: int = 4  # words in a shingle
    percent: int = 85
    sketch_bits: int = 20  # 8 MB of counters, whatever the size of the data
    map_bits: int = 1 << 24  # of the parity bit map of a set at most, a power of two from 64
    centres: int = 3  # per list
    block: int = 512  # members of a list or class that are compared at a time
    block_elements: int = 1 << 20  # of the sets in a block of a class, on average

    def needed(self, n):
        """Overlap that a set of n must have with any set it links to."""
        return (self.percent * n + 99) // 100


def _sets(texts: pa.Array, how: Join) -> tuple[np.ndarray, np.ndarray]:
    row, value = W.shingles(W.split(texts), how.width)
    return W.distinct_per_row(row, value, len(texts))


def _source(docs: DataFrame, row: str | None = None) -> DataFrame:
    number = [F.col(row).alias("row")] if row else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *number)


def shingle_counts(docs: DataFrame, how: Join) -> np.ndarray:
    """In how many texts the shingles of each hash bucket occur: a fixed number of counters,
    summed over all texts along a tree of tasks."""
    size = 1 << how.sketch_bits

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for part in W.slices(batch, most=W.SLICE_BYTES // 4):
                found, _ = _sets(part.column("text"), how)
                total += np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], ["counts"])

    total = tree_sum(_source(docs).select("text").mapInArrow(W.trimmed(run), "counts BINARY"), "<i8")
    return np.zeros(size, np.int64) if total is None else total


SET = "row LONG, doc_id LONG, n LONG, sig BINARY, prefix ARRAY<LONG>, bits BINARY"


def _parity(values: np.ndarray, offsets: np.ndarray, most: int) -> list[bytes]:
    """The parity bit map of each set: bit i says whether an odd number of elements hash to it. The
    number of bits is the next power of two from the set's size on, 64 at least and `most` at most."""
    n = np.diff(offsets)
    bits = np.minimum(1 << np.maximum(np.ceil(np.log2(np.maximum(n, 1))), 6).astype(np.int64), most)
    ends = np.cumsum(bits)
    at = np.repeat(ends - bits, n) + ((values >> np.uint64(40)).astype(np.int64) & np.repeat(bits - 1, n))
    odd = np.packbits((np.bincount(at, minlength=ends[-1] if len(ends) else 0) & 1).astype(np.uint8)).tobytes()
    return [odd[(end - size) // 8 : end // 8] for size, end in zip(bits.tolist(), ends.tolist())]


def _maps(found: list[bytes], size: int) -> np.ndarray:
    """Bit maps of one length as rows of words, folded to `size` bytes."""
    maps = np.frombuffer(b"".join(found), np.uint64).reshape(len(found), -1)
    while maps.shape[1] * 8 > size:
        maps = maps[:, : maps.shape[1] // 2] ^ maps[:, maps.shape[1] // 2 :]
    return maps


def _apart(xs: list[bytes], ys: list[bytes]) -> np.ndarray:
    """The least size of the symmetric difference of the sets of each pair of bit maps."""
    out, sizes = np.empty(len(xs), np.int64), {}
    for i, size in enumerate(zip(map(len, xs), map(len, ys))):
        sizes.setdefault(size, []).append(i)
    for size, at in sizes.items():
        x, y = (_maps([maps[i] for i in at], min(size)) for maps in (xs, ys))
        out[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def describe(docs: DataFrame, how: Join, counts: np.ndarray, row: str | None = None) -> DataFrame:
    """Per row: the size of its set, a signature, the prefix in global order and a bit map."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # of fixed size

    def run(batches):
        first_row, common = TaskContext.get().partitionId() << 33, shared.value
        for batch in batches:
            for part in W.slices(batch, most=W.SLICE_BYTES // 4):
                values, offsets = _sets(part.column("text"), how)
                n = np.diff(offsets)
                size = np.where(n > 0, n - how.needed(n) + 1, 0)
                rank = common[(values & np.uint64(len(common) - 1)).astype(np.int64)]
                kept, sigs = [], []
                for a, b, p in zip(offsets[:-1].tolist(), offsets[1:].tolist(), size.tolist()):
                    mine = values[a:b]
                    order = np.lexsort((mine, rank[a:b]))[:p]
                    kept.append(mine[order])
                    sigs.append(xxhash.xxh3_128_digest(mine.tobytes()) if b > a else None)
                flat = np.concatenate(kept) if kept else np.empty(0, np.uint64)
                cuts = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                rows = part.column("row") if row else pa.array(np.arange(first_row, first_row + len(n)))
                yield pa.RecordBatch.from_arrays(
                    [rows, part.column("doc_id"), pa.array(n), pa.array(sigs, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat.view(np.int64))), pa.array(_parity(values, offsets, how.map_bits), pa.binary())],
                    ["row", "doc_id", "n", "sig", "prefix", "bits"],
                )
                first_row += len(n)

    return _source(docs, row).mapInArrow(W.trimmed(run), SET)


def _enough(how: Join, overlap, n, m):
    return 100 * overlap >= how.percent * (n + m - overlap)


def index(reps: DataFrame, how: Join, scratch: Scratch) -> DataFrame:
    """(token, rep, n, left, members): the lists with at least two sets, one of equal lists. `left` is
    the number of elements of the set from the token on, in the global order."""
    postings = reps.select("rep", "n", F.posexplode("prefix").alias("pos", "token"))
    postings = postings.select("token", "rep", "n", (F.col("n") - F.col("pos")).alias("left"))
    # The smaller set of a pair must stand early enough for one of its own size.
    early = _enough(how, F.col("left"), F.col("n"), F.col("n"))
    shared = postings.groupBy("token").agg(F.count("*").alias("members"), F.bool_or(early).alias("early"))
    passing = Scratch(reps.sparkSession)
    live = passing.keep(postings.join(shared.filter("members > 1 AND early").drop("early"), "token"), "postings")
    prints = live.groupBy("token", "members").agg(
        F.bit_xor(F.xxhash64("rep")).alias("f1"), F.bit_xor(F.xxhash64("rep", F.lit(7))).alias("f2"), F.sum("left").alias("left")
    )
    one = prints.groupBy("f1", "f2", "members").agg(F.max_by("token", F.struct("left", "token")).alias("token")).select("token")
    lists = scratch.keep(live.join(one, "token", "left_semi"), "lists")
    passing.delete()
    return lists


def stars(lists: DataFrame, how: Join) -> DataFrame:
    """Distinct (a, b) of list centres and the members they could link to."""
    pairs = None
    for seed in range(how.centres):
        centre = lists.groupBy("token").agg(F.min(F.struct(F.xxhash64("rep", F.lit(seed)).alias("draw"), "rep", "n", "left")).alias("c"))
        centre = centre.select("token", F.col("c.rep").alias("centre"), F.col("c.n").alias("m"), F.col("c.left").alias("beyond"))
        can = _enough(how, F.least("left", "beyond"), F.col("n"), F.col("m"))
        found = lists.join(centre, "token").filter((F.col("rep") != F.col("centre")) & can)
        found = found.select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b"))
        pairs = found if pairs is None else pairs.unionByName(found)
    return pairs.distinct()


def _with(pairs: DataFrame, facts: DataFrame, *columns: str) -> DataFrame:
    """`pairs` with columns of both ends, as a_... and b_..."""
    for end in "ab":
        pairs = pairs.join(facts.select(F.col("rep").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns]), end)
    return pairs


def by_bit_map(pairs: DataFrame, reps: DataFrame, how: Join) -> DataFrame:
    """The pairs whose bit maps allow a link."""

    def run(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("a_n", "b_n"))
            most = (n + m - _apart(W.values(batch.column("a_bits")), W.values(batch.column("b_bits")))) // 2
            yield batch.select(["a", "b"]).filter(pa.array(_enough(how, most, n, m)))

    return _with(pairs, reps, "n", "bits").select("a", "b", "a_n", "b_n", "a_bits", "b_bits").mapInArrow(W.trimmed(run), "a LONG, b LONG")


def whole_sets(docs: DataFrame, reps: DataFrame, pairs: DataFrame, how: Join) -> DataFrame:
    """(rep, elements) of the sets in `pairs` only. Texts are found by doc_id and recognised by the signature."""
    ends = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    wanted = reps.select("rep", "doc_id", "sig").join(ends, "rep")
    ids = wanted.select(F.col("doc_id").alias("_want")).distinct()
    source = _source(docs)

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, most=W.SLICE_BYTES // 4):
                values, offsets = _sets(part.column("text"), how)
                raw = [values[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(r) if r else None for r in raw], pa.binary()), pa.array(raw, pa.binary())], ["sig", "elements"]
                )

    texts = source.join(ids, F.col("doc_id").eqNullSafe(F.col("_want")), "left_semi").select("text")
    found = texts.mapInArrow(W.trimmed(run), "sig BINARY, elements BINARY")
    return wanted.select("rep", "sig").join(found, "sig").dropDuplicates(["rep"]).select("rep", "elements")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, overlap, n, m) by intersection of the whole sets."""

    def run(batches):
        for batch in batches:
            xs, ys = (W.values(batch.column(c)) for c in ("a_elements", "b_elements"))
            both = [(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(xs, ys)]
            common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in both]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(common, pa.int64()),
                 pa.array([len(x) for x, _ in both], pa.int64()), pa.array([len(y) for _, y in both], pa.int64())],
                ["a", "b", "overlap", "n", "m"],
            )

    joined = _with(pairs, sets, "elements").select("a", "b", "a_elements", "b_elements")
    return joined.mapInArrow(W.trimmed(run), "a LONG, b LONG, overlap LONG, n LONG, m LONG")


def verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, how: Join, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(a, b, overlap, n, m, link) of the pairs that their bit maps do not rule out, and their sets."""
    likely = scratch.keep(by_bit_map(pairs, reps, how), "likely")
    sets = scratch.keep(whole_sets(docs, reps, likely, how), "sets")
    found = overlaps(likely, sets)
    return scratch.keep(found.withColumn("link", _enough(how, F.col("overlap"), F.col("n"), F.col("m"))), "verified"), sets


CLASSES_EACH = 8  # other classes that a set meets in a block in the first round


def leftovers(lists: DataFrame, roots: DataFrame, reps: DataFrame, known: DataFrame, how: Join, most_each: int, scratch: Scratch) -> DataFrame:
    """(a, b, more): pairs of one list and different classes that neither sizes, positions, bit maps nor the
    distances to the list's first centre rule out. Of a set and the members of one class, the
    `most_each` likeliest, and of those for all classes `CLASSES_EACH` times as many; `more` says that there are others."""
    labelled = lists.filter("members > 2").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    centre = labelled.groupBy("token").agg(
        F.min(F.struct(F.xxhash64("rep", F.lit(0)).alias("draw"), "rep")).alias("c"), F.min("root").alias("_lo"), F.max("root").alias("_hi")
    )
    mixed = centre.filter("_lo <> _hi").select("token", F.col("c.rep").alias("centre"))
    rows = labelled.join(mixed, "token").withColumns({"a": F.least("rep", "centre"), "b": F.greatest("rep", "centre")})
    rows = rows.join(known.select("a", "b", "overlap", F.col("n").alias("_n"), F.col("m").alias("_m")), ["a", "b"], "left")
    distance = F.when(F.col("rep") == F.col("centre"), F.lit(0.0)).otherwise(1 - F.col("overlap") / (F.col("_n") + F.col("_m") - F.col("overlap")))
    rows = scratch.keep(rows.select("token", "rep", "n", "left", "root", "members", distance.alias("d")), "mixed")

    # Members are dealt to blocks, and every two blocks of a list meet in one small group.
    blocks = F.greatest(F.lit(1), F.ceil(F.col("members") / how.block)).cast("int")
    own = F.pmod(F.xxhash64("rep", F.lit(1)), blocks).cast("int")
    meets = F.explode(F.sequence(F.lit(0), blocks - 1))
    dealt = rows.withColumn("own", own).withColumn("other", meets)
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    dealt = dealt.join(reps.select("rep", "bits"), "rep").select("token", "i", "j", "own", "rep", "n", "left", "root", "d", "bits")
    reach = 1 - how.percent / 100 + 1e-9

    def run(key, table):
        table = table.sort_by([("n", "ascending"), ("rep", "ascending")])
        rep, n, left, root, own = (table.column(c).to_numpy() for c in ("rep", "n", "left", "root", "own"))
        d = table.column("d").to_numpy(zero_copy_only=False).astype(float)  # null: unknown
        bits = table.column("bits").to_pylist()
        size = np.fromiter(map(len, bits), np.int64, len(bits))  # rises with n
        maps = {}  # of each size: the first member with it, and the maps from there on as far as they can be met
        for length in np.unique(size).tolist():
            first, beyond = np.searchsorted(size, [length, length + 1]).tolist()
            stop = int(np.searchsorted(n, n[beyond - 1] * 100 // how.percent, side="right"))
            parts = np.split(np.arange(first, stop), np.flatnonzero(np.diff(size[first:stop])) + 1)
            maps[length] = first, np.concatenate([_maps([bits[y] for y in part], length) for part in parts])
        i, j = key[1].as_py(), key[2].as_py()
        out = []
        for x in range(len(rep)):
            end = int(np.searchsorted(n, n[x] * 100 // how.percent, side="right"))  # sizes beyond are skipped
            ys = np.arange(x + 1, end)
            ys = ys[root[ys] != root[x]]
            if i != j:
                ys = ys[own[ys] != own[x]]
            ys = ys[_enough(how, np.minimum(left[ys], left[x]), n[x], n[ys])]
            if not np.isnan(d[x]):
                ys = ys[~(np.abs(d[ys] - d[x]) > reach)]
            first, known_maps = maps[int(size[x])]
            most = (n[x] + n[ys] - np.bitwise_count(known_maps[ys - first] ^ known_maps[x - first]).sum(axis=1, dtype=np.int64)) // 2
            fits = _enough(how, most, n[x], n[ys])
            ys, most = ys[fits], most[fits]
            if not len(ys):
                continue
            order = np.lexsort((ys, -most, root[ys]))
            ys = ys[order]
            starts = np.flatnonzero(np.concatenate([[True], root[ys][1:] != root[ys][:-1]]))
            rank = np.arange(len(ys)) - np.repeat(starts, np.diff(np.append(starts, len(ys))))
            near = rank < most_each
            likeliest = ys[near][np.argsort(-most[order][near], kind="stable")[: CLASSES_EACH * most_each]]
            more = len(likeliest) < len(ys)
            out.extend((min(rep[x], rep[y]), max(rep[x], rep[y]), more) for y in likeliest.tolist())
        a, b, more = zip(*out) if out else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "more": pa.array(more, pa.bool_())})

    return scratch.keep(dealt.groupBy("token", "i", "j").applyInArrow(run, "a LONG, b LONG, more BOOLEAN"), "leftovers")


def _count_links(own: np.ndarray, n: np.ndarray, c: np.ndarray, diffs: list[np.ndarray], across: bool, how: Join) -> np.ndarray:
    """How many of the others each set links to; with `across`, of those with another `own`.

    A set is known by its size and what it differs in from the centre of its class (of c elements):
    |x ^ y| is the size of the difference of the differences, so equal parts are never compared.
    """
    order = np.argsort(n, kind="stable")
    n, c, own, diffs = n[order], c[order], own[order], [diffs[i] for i in order]
    size = np.array([len(d) for d in diffs])
    _, flat = np.unique(np.concatenate(diffs), return_inverse=True)
    starts = np.cumsum(size) - size
    mark, counts, reach = np.zeros(len(flat) + 1, bool), np.zeros(len(n), np.int64), 1 - how.percent / 100
    before = np.concatenate([[0], np.cumsum(size)])

    def common(x, ys):
        """Overlaps of a set with several."""
        mine = flat[starts[x] : starts[x] + size[x]]
        mark[mine] = True
        hits = np.concatenate([[0], np.cumsum(mark[flat[W.spread(starts[ys], size[ys])]])])
        mark[mine] = False
        ends = np.cumsum(size[ys])
        apart = size[x] + size[ys] - 2 * (hits[ends] - hits[ends - size[ys]])
        return (n[x] + n[ys] - apart) // 2

    d = 2 * size / (n + c + size)  # distance to the centre
    for x in range(len(n)):
        ys = np.arange(x + 1, int(np.searchsorted(n, n[x] * 100 // how.percent, side="right")))
        if across:
            ys = ys[own[ys] != own[x]]
        ys = ys[np.abs(d[ys] - d[x]) <= reach + 1e-9]
        sure = d[ys] + d[x] <= reach - 1e-9
        linked, ys = ys[sure], ys[~sure]
        if len(ys):
            linked = np.concatenate([linked, ys[_enough(how, common(x, ys), n[x], n[ys])]])
        counts[x] += len(linked)
        counts[linked] += 1
    out = np.empty(len(n), np.int64)
    out[order] = counts
    return out


def _differences(members: DataFrame, centres: DataFrame) -> DataFrame:
    """(rep, root, n, c, diff): each member's difference from the centre of its class, of c elements."""

    def run(batches):
        for batch in batches:
            xs, cs = (W.values(batch.column(c)) for c in ("elements", "centre"))
            diffs = [np.setxor1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True).tobytes() for x, y in zip(xs, cs)]
            sizes = [pa.array([len(v) // 8 for v in vs], pa.int64()) for vs in (xs, cs)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("root"), *sizes, pa.array(diffs, pa.binary())], ["rep", "root", "n", "c", "diff"]
            )

    both = members.join(centres.withColumnRenamed("elements", "centre"), "root").select("rep", "root", "elements", "centre")
    return both.mapInArrow(W.trimmed(run), "rep LONG, root LONG, n LONG, c LONG, diff BINARY")


def link_counts(roots: DataFrame, sets: DataFrame, how: Join, scratch: Scratch) -> DataFrame:
    """(rep, n_links): the exact number of sets that each set of a class links to. Of each set only
    its difference from the centre of its class goes to the blocks."""
    of = roots.select(F.col("node").alias("rep"), "root")
    size = of.groupBy("root").agg(F.count("*").alias("members"))
    # A class of two has one link.
    two = of.join(size.filter("members = 2").select("root"), "root").select("rep", F.lit(1).cast("long").alias("n_links"))
    large = of.join(size.filter("members > 2").select("root"), "root")
    centres = sets.join(large.filter("rep = root").select("rep"), "rep").select(F.col("rep").alias("root"), "elements")
    members = scratch.keep(_differences(sets.join(large, "rep"), centres), "differences")

    totals = members.groupBy("root").agg(F.count("*").alias("members"), F.sum(F.length("diff") / 8).alias("total"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("members") / how.block), F.ceil(F.col("total") / how.block_elements)).cast("int")
    rows = members.join(totals.select("root", parts.alias("blocks")), "root")
    own = F.pmod(F.xxhash64("rep", F.lit(1)), "blocks").cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "n", "c", "diff")

    def run(key, table):
        diffs = [np.frombuffer(e, np.uint64) for e in table.column("diff").to_pylist()]
        own, n, c = (table.column(x).to_numpy() for x in ("own", "n", "c"))
        counts = _count_links(own, n, c, diffs, key[1].as_py() != key[2].as_py(), how)
        return pa.table({"rep": table.column("rep"), "n_links": pa.array(counts, pa.int64())})

    counted = dealt.groupBy("root", "i", "j").applyInArrow(run, "rep LONG, n_links LONG").groupBy("rep").agg(F.sum("n_links").alias("n_links"))
    return scratch.keep(counted.unionByName(two), "link-counts")


def classes(docs: DataFrame, how: Join = Join(), row: str | None = None, count_links: bool = True) -> DataFrame:
    """One row per row of `docs` (doc_id, text): row, doc_id, n_shingles, component_id, n_links, kept.

    `row` names a column of distinct longs that stands for the row in the result; without it rows
    are numbered as they are read. `kept` marks one row of each class, that of the smallest doc_id.
    component_id is the smallest doc_id of the connected component, null doc_ids apart (a class
    of null doc_ids alone has none). n_links is the number of different sets that the
    row's set links to, null without `count_links`. A null text is empty; a text without words has no
    shingles, links with nothing and has its own doc_id. Repeated rows are linked copies. An
    empty table gives an empty one; other columns are ignored.
    """
    scratch, passing = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    described = passing.keep(describe(docs, how, shingle_counts(docs, how), row), "described")
    every = scratch.keep(described.select("row", "doc_id", "n", "sig"), "rows")
    copies = every.filter("n > 0").groupBy("sig").agg(F.min("row").alias("rep"))
    rep_rows = described.join(copies.select(F.col("rep").alias("row")), "row", "left_semi").withColumnRenamed("row", "rep")
    reps = scratch.keep(rep_rows.drop("prefix"), "reps")
    # Prefixes are joined to the sets anew, not carried along: only the index wants them.
    prefixes = described.select(F.col("row").alias("rep"), "n", "prefix").join(reps.select("rep"), "rep", "left_semi")
    lists = index(prefixes, how, scratch)
    passing.delete()
    known, sets = verified(docs, reps, stars(lists, how), how, scratch)
    roots = components(known.filter("link").select("a", "b"), scratch)
    # Two near classes need one link, not all: first the likeliest pairs, more of them only
    # where classes stay apart, until every pair left was compared.
    most_each = 1
    while True:
        found = leftovers(lists, roots, reps, known, how, most_each, scratch)
        rest = scratch.keep(found.select("a", "b").distinct().join(known.select("a", "b"), ["a", "b"], "left_anti"), "rest")
        if not rest.isEmpty():
            again, more_sets = verified(docs, reps, rest, how, scratch)
            known, sets = known.unionByName(again), sets.unionByName(more_sets.join(sets.select("rep"), "rep", "left_anti"))
            roots = components(known.filter("link").select("a", "b"), scratch)
        if found.filter("more").isEmpty():
            break
        most_each *= 8
    return _membership(every, copies, roots, link_counts(roots, sets, how, scratch) if count_links else None, scratch)


def _membership(every: DataFrame, copies: DataFrame, roots: DataFrame, links: DataFrame | None, scratch: Scratch) -> DataFrame:
    none = F.lit(None if links is None else 0).cast("long")
    of = copies.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    of = of.withColumn("n_links", none) if links is None else of.join(links, "rep", "left")
    of = of.select("sig", F.coalesce("root", "rep").alias("root"), F.coalesce("n_links", none).alias("n_links"))
    rows = every.select("row", "doc_id", F.col("n").alias("n_shingles"), "sig").join(of, "sig", "left")
    rows = scratch.keep(rows.withColumn("root", F.coalesce("root", "row")).drop("sig"), "members")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")  # a class may be large: combined before the shuffle
    lowest = rows.groupBy("root").agg(F.min(rank).alias("low"))
    return rows.join(lowest, "root").select(
        "row", "doc_id", "n_shingles", F.col("low.doc_id").alias("component_id"), F.coalesce("n_links", none).alias("n_links"),
        (F.col("row") == F.col("low.row")).alias("kept"),
    )

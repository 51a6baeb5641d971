"""Toxic passages as maximal scoring segments, calibrated by extreme-value statistics.

1. Token evidence: log-odds of toxic against clean training texts with an informative Dirichlet
   prior (the pooled frequencies), for a word and for its beginnings of 3 to 6 letters, since
   toxic stems come in many forms. What counts is the number of different contexts (the words
   before and after), so a text copied thirty times is no stronger evidence than once. The
   different (label, bucket, context) are counted exactly, dealt by context so that a frequent
   bucket is spread over all tasks. Evidence is shrunk by a multiple of its standard error; a
   token takes its strongest kind.
2. Scan: with a small drift subtracted, the linear-time scan finds all maximal scoring segments.
3. Calibration: for clean texts the best segment of n tokens follows an extreme-value law,
   P(S >= x) = 1 - exp(-K n exp(-lambda x)). lambda solves E exp(lambda s) = 1 over clean tokens,
   K is the maximum-likelihood value over clean texts. A segment is significant when its expected
   number in a clean text of that length, K n exp(-lambda S), is small.
4. The score is a logistic function, fitted to training labels, of the strongest segment and of
   the sum over segments beyond what chance explains.

Labels are learned from a sample of at most `max_training_rows` labelled rows (by hash of the
doc_id, so all of them where there are fewer); that bounds the join side that is broadcast.
"""

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from changesync.llm import words as W
from changesync.llm.counters import tree_sum
from changesync.storage import Scratch


@dataclass(frozen=True)
class Settings:
    buckets_log2: int = 20
    beginnings: tuple[int, ...] = (3, 4, 5, 6)
    prior: float = 0.05  # weight of the pooled frequencies against the counts of a class
    errors: float = 2.0  # standard errors that evidence is shrunk by
    drift: float = 0.15  # subtracted from every token
    max_training_rows: int = 200_000
    significant: float = 0.05  # expected number of such segments in a clean text
    threshold: float = 0.7


@dataclass(frozen=True)
class Model:
    weights: np.ndarray = field(repr=False)  # evidence per hash bucket
    lam: float
    k: float
    coef: tuple[float, ...]  # of the logistic function


EDGES = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "«»“”„‘’…–—¿¡"


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _buckets(dictionary: pa.Array, how: Settings) -> np.ndarray:
    """Hash buckets of each word's kinds of evidence; -1 where the word is too short."""
    mask, digest = (1 << how.buckets_log2) - 1, xxhash.xxh3_64_intdigest
    out = np.full((len(dictionary), 1 + len(how.beginnings)), -1, np.int64)
    for i, word in enumerate(W.values(dictionary)):
        word = word.lower().strip(EDGES)
        if not word:
            continue
        out[i, 0] = digest(word, 0) & mask
        for k, size in enumerate(how.beginnings, 1):
            if len(word) <= size:
                break
            out[i, k] = digest(word[:size], k) & mask
    return out


def _token_scores(dictionary: pa.Array, weights: np.ndarray, how: Settings) -> np.ndarray:
    at = _buckets(dictionary, how)
    each = np.where(at >= 0, weights[at], 0.0)
    if not len(each):
        return np.empty(0)
    return each[np.arange(len(each)), np.abs(each).argmax(axis=1)] - how.drift


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, beyond last, score) of a sequence, in linear time:
    every one is a segment whose proper parts all score less, and none can be extended."""
    positive = scores > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], positive, [False]]).astype(np.int8)))
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []  # first, beyond last, sum before, sum after
    for first, beyond in zip(edge[::2].tolist(), edge[1::2].tolist()):
        new = [first, beyond, total[first], total[beyond]]
        at = len(found) - 1
        while True:
            while at >= 0 and found[at][2] >= new[2]:
                at -= 1
            if at < 0 or found[at][3] >= new[3]:
                found.append(new)
                break
            new = [found[at][0], new[1], found[at][2], new[3]]
            del found[at:]
            at -= 1
    return [(a, b, float(after - before)) for a, b, before, after in found]


def _scan(texts: pa.Array, weights: np.ndarray, how: Settings):
    """Per text: number of tokens, its segments."""
    split = W.split(texts)
    scores = _token_scores(split.dictionary, weights, how)[split.codes]
    for a, b in zip(split.offsets[:-1].tolist(), split.offsets[1:].tolist()):
        mine = scores[a:b]
        yield b - a, segments(mine) if b > a and mine.max() > 0 else []


def _training(docs: DataFrame, labels: DataFrame, how: Settings) -> DataFrame:
    """(text, toxic) of the training sample."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.max_training_rows)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", F.col("_toxic").alias("toxic"))


def log_odds(toxic: np.ndarray, clean: np.ndarray, n1: float, n0: float, how: Settings) -> np.ndarray:
    """Shrunk log-odds per bucket, from its counts and their totals."""
    pooled = (toxic + clean + 0.01) / (n1 + n0)
    a, b = toxic + how.prior * n1 * pooled, clean + how.prior * n0 * pooled
    n1, n0 = (1 + how.prior) * n1, (1 + how.prior) * n0
    delta = np.log(a / np.maximum(n1 - a, 1)) - np.log(b / np.maximum(n0 - b, 1))
    error = np.sqrt(1 / a + 1 / b)
    return (np.sign(delta) * np.maximum(np.abs(delta) - how.errors * error, 0)).astype(np.float32)


def _contexts(split: W.Words) -> np.ndarray:
    """A 64-bit hash of the words around each token of a text."""
    hashes = W.hash_words(split.dictionary)[split.codes] if len(split.codes) else np.empty(0, np.uint64)
    before, after = np.roll(hashes, 1), np.roll(hashes, -1)
    inner = split.offsets[:-1][np.diff(split.offsets) > 0]
    before[inner] = 1
    after[split.offsets[1:][np.diff(split.offsets) > 0] - 1] = 2
    return W.mix(before * np.uint64(3) + after)


SHARDS = 64  # groups that contexts are dealt to; a training sample of any size is bounded


def _counted(training: DataFrame, how: Settings) -> np.ndarray | None:
    """The number of different contexts of all buckets, clean ones first. None without training texts."""
    size, rest = 1 << how.buckets_log2, np.uint64(63 - how.buckets_log2)  # bits of a key: label and bucket, then the context

    def keys(batches):
        for batch in batches:
            for part in W.slices(batch, most=W.SLICE_BYTES // 2):
                split = W.split(part.column("text"))
                label = part.column("toxic").to_numpy()[split.rows()].astype(np.int64) * size
                at, context = _buckets(split.dictionary, how), _contexts(split) >> np.uint64(64 - int(rest))
                shard = (context & np.uint64(SHARDS - 1)).astype(np.uint8)
                order = np.argsort(shard, kind="stable")
                ends = np.cumsum(np.bincount(shard, minlength=SHARDS)).tolist()
                for i, (a, b) in enumerate(zip([0, *ends], ends)):
                    mine = order[a:b]
                    bucket = at[split.codes[mine]]
                    found = ((bucket + label[mine, None]).astype(np.uint64) << rest) | context[mine, None]
                    found = np.unique(found[bucket >= 0])
                    if len(found):
                        packed = zstandard.compress(np.diff(found, prepend=np.uint64(0)).astype("<u8").tobytes())
                        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([packed], pa.binary())], ["shard", "keys"])

    def count(table: pa.Table) -> pa.Table:
        met = np.empty(0, np.uint64)
        waiting, held = [], 0
        for packed in [*table.column("keys").to_pylist(), None]:
            if packed is not None:
                waiting.append(np.cumsum(np.frombuffer(zstandard.decompress(packed), "<u8"), dtype=np.uint64))
                held += len(waiting[-1])
            if packed is None or held > max(1 << 20, len(met)):  # merged as they come: copies never pile up
                met, waiting, held = np.unique(np.concatenate([met, *waiting])), [], 0
        total = np.bincount((met >> rest).astype(np.int64), minlength=2 * size)
        return pa.table({"total": pa.array([total.astype("<i4").tobytes()], pa.binary())})

    dealt = training.mapInArrow(W.trimmed(keys), "shard INT, keys BINARY")
    return tree_sum(dealt.groupBy("shard").applyInArrow(count, "total BINARY"), "<i4")


LAMBDAS = np.geomspace(0.05, 3, 60)


def fit(docs: DataFrame, labels: DataFrame, how: Settings = Settings()) -> Model | None:
    """Learn from the labelled texts; None if they are not of both kinds."""
    spark, size = docs.sparkSession, 1 << how.buckets_log2
    training = _training(docs, labels, how)
    counts = _counted(training, how)
    if counts is None or not counts[:size].any() or not counts[size:].any():
        return None
    n0, n1 = (float(half.sum(dtype=np.int64)) for half in (counts[:size], counts[size:]))
    parts = [slice(at, at + (1 << 16)) for at in range(0, size, 1 << 16)]
    weights = np.concatenate([log_odds(counts[size:][p], counts[:size][p], n1, n0, how) for p in parts])
    del counts
    shared = spark.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, most=W.SLICE_BYTES // 2):
                split = W.split(part.column("text"))
                token = _token_scores(split.dictionary, shared.value, how)
                rows = split.rows()
                found = [(n, [s for _, _, s in segs]) for n, segs in _scan(part.column("text"), shared.value, how)]
                # Sums over the tokens of the part's clean texts, with its first row.
                clean = part.column("toxic").to_numpy()[rows] == 0
                uses = np.bincount(split.codes[clean], minlength=len(split.dictionary))
                moment = [np.array([uses @ np.exp(x * token) for x in LAMBDAS])] + [np.zeros(len(LAMBDAS))] * (len(found) - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.list_(pa.float64())),
                     part.column("toxic").cast(pa.int32()), pa.array([int(uses.sum())] + [0] * (len(found) - 1), pa.int64()),
                     pa.array([m.tolist() for m in moment], pa.list_(pa.float64()))],
                    ["n", "scores", "toxic", "tokens", "moment"],
                )

    scanned = Scratch(spark).keep(training.mapInArrow(W.trimmed(run), "n LONG, scores ARRAY<DOUBLE>, toxic INT, tokens LONG, moment ARRAY<DOUBLE>"), "scanned")
    sums = scanned.filter("tokens > 0").select("tokens", F.posexplode("moment").alias("i", "v")).groupBy("i").agg(F.sum("v"), F.sum("tokens")).collect()
    mean = {r[0]: r[1] / r[2] for r in sums}  # one row per lambda of the grid
    lam = max((x for i, x in enumerate(LAMBDAS.tolist()) if mean.get(i, 0) <= 1), default=float(LAMBDAS[0]))
    best = F.coalesce(F.array_max("scores"), F.lit(0.0))
    docs_, weight = scanned.filter("toxic = 0 AND n > 0").agg(F.count("*"), F.sum(F.col("n") * F.exp(-F.lit(lam) * best))).first()
    k = docs_ / weight if docs_ else 1.0
    # At most max_training_rows rows of three numbers.
    chance = F.log(F.greatest(F.lit(float(k)) * F.greatest("n", F.lit(1)), F.lit(1e-9)))
    excess = F.aggregate("scores", F.lit(0.0), lambda total, s: total + F.greatest(F.lit(0.0), s * F.lit(lam) - chance))
    sample = scanned.select(F.log1p(excess).alias("sum"), F.least(F.lit(30.0), best * F.lit(lam) - chance).alias("best"), "toxic").toPandas()
    return Model(weights, lam, float(k), _logistic(sample[["sum", "best"]].to_numpy(float), sample["toxic"].to_numpy(float)))


def _features(n: int, scores: list[float], lam: float, k: float) -> tuple[float, float]:
    chance = math.log(max(k * max(n, 1), 1e-9))
    excess = [max(0.0, lam * s - chance) for s in scores]
    return math.log1p(sum(excess)), min(30.0, lam * max(scores, default=0.0) - chance)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Maximum-likelihood fit with a small ridge, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        grad = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


PASSAGES = "ARRAY<STRUCT<first: INT, beyond: INT, score: DOUBLE, expected: DOUBLE>>"


def score(docs: DataFrame, model: Model | None, how: Settings = Settings(), score_as: str = "score", passages_as: str = "passages") -> DataFrame:
    """All columns of `docs` plus the score, 0 to 1, and the significant passages (word positions,
    segment score, expected number in a clean text).

    A null text counts as empty; an empty one has no passage and the score of chance alone.
    Without a model (labels of one kind or none) every score is 0. Columns that already have
    the new names are replaced. Equal texts have equal scores.
    """
    spark = docs.sparkSession
    docs = docs.drop(score_as, passages_as)
    shared = spark.sparkContext.broadcast(model)  # of fixed size
    kind = pa.list_(pa.struct([("first", pa.int32()), ("beyond", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in W.slices(batch, most=W.SLICE_BYTES // 2):
                scores, found = [], []
                if m is None:
                    scores, found = [0.0] * part.num_rows, [[]] * part.num_rows
                else:
                    for n, segs in _scan(part.column("text"), m.weights, how):
                        x = _features(n, [s for _, _, s in segs], m.lam, m.k)
                        z = m.coef[0] + m.coef[1] * x[0] + m.coef[2] * x[1]
                        scores.append(1 / (1 + math.exp(-max(-35.0, min(35.0, z)))))
                        chance = [(a, b, s, m.k * n * math.exp(-m.lam * s)) for a, b, s in segs]
                        found.append([dict(zip(("first", "beyond", "score", "expected"), c)) for c in chance if c[3] <= how.significant])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64()), pa.array(found, kind)], [*part.schema.names, score_as, passages_as])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(W.trimmed(run), f"{schema}, `{score_as}` DOUBLE, `{passages_as}` {PASSAGES}")

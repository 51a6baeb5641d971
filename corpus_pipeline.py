"""A training corpus from raw documents: five stages, each one operator over all rows before it.

A stage takes the table of documents that the one before wrote. Where an operator's decisions
are joined back, the rows are numbered and written once, and both the operator and the join read
that table, so rows with equal or null doc_ids stay apart however the reads are split. A stage
frees the scratch tables of the one before, whose result is the table it takes.
"""

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from changesync.llm import best_fit, grace_dedup, jaccard_join, mixing, tokens, toxicity
from changesync.session import configure
from changesync.storage import Lease, Scratch

NEAR = jaccard_join.Join(width=5, percent=80)


# By data folder, the scratch tables of the stage that ran last.
_left: dict[str, Lease] = {}


def _freeing(stage):
    """The stage takes what the one before has written, so that one's scratch tables can go."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if sf_dir in _left:
            _left.pop(sf_dir).delete()
        with Lease() as mine:
            out = stage(spark, docs, sf_dir)
        if stage is not pack_sequences.__wrapped__:  # its result is handed out unwritten
            _left[sf_dir] = mine
        return out

    return run


@_freeing
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled texts of `docs`; a document at or above the threshold goes."""
    how = toxicity.Settings()
    model = toxicity.fit(docs, configure(spark).read.parquet(f"{sf_dir}/labels.parquet"), how)
    score, passages = _free("__toxicity", docs), _free("__passages", docs)
    scored = toxicity.score(docs, model, how, score_as=score, passages_as=passages)
    return scored.filter(F.col(score) < how.threshold).select(*docs.columns)


def _free(name: str, docs: DataFrame) -> str:
    """`name`, made longer until no column of `docs` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _numbered(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a column of row numbers, as a written table (every read of it has the same numbers), and
    the column's name."""
    row = _free("__row", docs)
    return Scratch(configure(spark)).keep(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


@_freeing
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the row with the smallest doc_id stays."""
    rows, row = _numbered(spark, docs)
    decided = grace_dedup.dedup(rows, row=row)
    return rows.join(decided.filter("kept").select(F.col("row").alias(row)), row, "left_semi").select(*docs.columns)


@_freeing
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts linked by five-word shingles at a Jaccard similarity of 0.8 or more, the
    row with the smallest doc_id stays; texts without words are alike in having none, and each stays."""
    rows, row = _numbered(spark, docs)
    decided = jaccard_join.classes(rows, NEAR, row=row, count_links=False)
    return rows.join(decided.filter("kept").select(F.col("row").alias(row)), row, "left_semi").select(*docs.columns)


@_freeing
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each document as often as its leaf's budget takes it."""
    configure(spark)
    return mixing.mixed(docs)


@_freeing
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the mixture with its place in a training sequence."""
    configure(spark)
    return best_fit.packed(docs, tokens.public_path("word_bpe_49k.json"), end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

# The learned scores of the first stage, and so all that follows, are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each written and read again as the next one's input."""
    scratch = Scratch(configure(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

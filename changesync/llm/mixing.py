"""Mixing sources to target weights, with DataFrame functions only.

A tree domain - language - source has integer weights per node. A token budget runs down it: a
node's budget is shared among its children by weight, no child getting more than its documents
can give in `max_epochs` passes; what one cannot take goes to its siblings first, and only what
the whole family cannot take falls to the parent's siblings (water-filling per family, with the
capacity of a subtree as its cap). Each leaf then takes whole passes over its documents and a
prefix, in tokens, of the next pass, whose order is seeded by the number of the pass.

The prefix of a leaf is found digit by digit of the order hash: token sums per (leaf, digit), a
running sum over the digits, and only the rows of the digit where the budget ends go on. So no
task sorts a whole leaf, which may hold a third of all rows.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from changesync.storage import Scratch

LEAF = ["domain", "lang", "source"]
UNKNOWN = "unknown"


@dataclass(frozen=True)
class Mix:
    """Weights by name at each level (others: `other`); the budget in percent of all tokens."""

    domains: dict[str, int] = field(default_factory=lambda: {"domain0": 40, "domain1": 30, "domain2": 20, "domain3": 10})
    langs: dict[str, int] = field(default_factory=lambda: {"en": 50, "de": 20, "fr": 20, "es": 10})
    sources: dict[str, int] = field(default_factory=dict)
    other: int = 10
    budget_percent: int = 80
    max_epochs: int = 2
    seed: int = 7


def domain_of(source: Column) -> Column:
    """The domain of a source where a table names none: one of four, by its name."""
    return F.concat(F.lit("domain"), (F.conv(F.substring(F.md5(source), 1, 1), 16, 10).cast("int") % 4).cast("string"))


def n_tokens(text: Column) -> Column:
    """Words of a text."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _weight(names: dict[str, int], column: str, other: int) -> Column:
    out = F.lit(other)
    for name, weight in names.items():
        out = F.when(F.col(column) == name, F.lit(weight)).otherwise(out)
    return out.cast("long")


def _share(nodes: DataFrame, family: list[str], name: str, weight: Column) -> DataFrame:
    """Split `budget`, given per family, over children with `cap`; replaces `budget`."""
    all_ = Window.partitionBy(*family)
    by_fill = all_.orderBy(F.col("cap") / F.col("_w"), name)
    nodes = nodes.withColumn("_w", weight)
    nodes = nodes.withColumns({
        "_caps": F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_ws": F.sum("_w").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    # In this order the children that fill up come first.
    nodes = nodes.withColumn("_full", F.col("cap") * F.col("_ws") <= (F.col("budget") - F.col("_caps")) * F.col("_w"))
    nodes = nodes.withColumns({
        "_taken": F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(F.lit(0))).over(all_),
        "_open": F.sum(F.when(F.col("_full"), F.lit(0)).otherwise(F.col("_w"))).over(all_),
    })
    part = F.expr("((budget - _taken) * _w) div greatest(_open, 1)")
    return nodes.withColumn("budget", F.when(F.col("_full"), F.col("cap")).otherwise(F.least("cap", part))).drop("_w", "_caps", "_ws", "_full", "_taken", "_open")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """`leaves` (domain, lang, source, tokens) with `budget`."""
    leaves = leaves.withColumn("cap", F.col("tokens") * mix.max_epochs)
    domains = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("_tokens")).withColumn("_root", F.lit(0))
    root = Window.partitionBy("_root")
    domains = domains.withColumns({"_all": F.sum("_tokens").over(root), "_most": F.sum("cap").over(root)})
    domains = domains.withColumn("budget", F.least(F.expr(f"_all * {mix.budget_percent} div 100"), "_most"))
    domains = _share(domains, ["_root"], "domain", _weight(mix.domains, "domain", mix.other)).select("domain", "budget")
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(domains, "domain")
    langs = _share(langs, ["domain"], "lang", _weight(mix.langs, "lang", mix.other)).select("domain", "lang", "budget")
    out = leaves.join(langs, ["domain", "lang"])
    return _share(out, ["domain", "lang"], "source", _weight(mix.sources, "source", mix.other))


def _by_digit(rows: DataFrame, keys: list[str], digit: str) -> DataFrame:
    """Rows with `start` and `end`: tokens of their leaf's pass before and up to the end of their digit."""
    sums = rows.groupBy(*keys, "base", digit).agg(F.sum("tokens").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.col("base") + F.coalesce(F.sum("_sum").over(before), F.lit(0))).withColumn("end", F.col("start") + F.col("_sum"))
    return rows.drop("base").join(sums.select(*keys, digit, "start", "end"), [*keys, digit])


def select(docs: DataFrame, mix: Mix = Mix(), domain: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """All columns of `docs` plus: domain, tokens, whole_copies (full passes) and extra_tokens (how
    many of its tokens the prefix of the next pass takes).

    `domain` and `tokens` are expressions over `docs`; by default the domain comes from the source and
    the tokens are the words of `text`. Names null, in lang or source, are the name "unknown". A text without words has no tokens
    and is never taken; null texts are empty. Rows with equal doc_ids follow one another in
    the order of the table, those without a doc_id stand each in a place of its own. Integer shares are rounded down, so a family may leave a few
    tokens. Columns of `docs` named like the new ones are replaced; an empty table gives an empty one.
    """
    keep = [c for c in docs.columns if c not in ("domain", "tokens", "whole_copies", "extra_tokens")]
    named = docs.select(F.struct(*keep).alias("_doc"), _name("lang").alias("lang"), _name("source").alias("source"),
                        (domain if domain is not None else domain_of(_name("source"))).alias("domain"),
                        (tokens if tokens is not None else n_tokens(F.coalesce("text", F.lit("")))).cast("long").alias("tokens"))
    scratch = Scratch(docs.sparkSession)
    named = scratch.keep(named.withColumn("row", F.monotonically_increasing_id()), "named")
    narrow = named.select("row", F.col("_doc.doc_id").alias("doc_id"), *LEAF, "tokens")
    plan = leaf_budgets(narrow.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens")), mix).filter("tokens > 0")
    plan = scratch.keep(plan.select(*LEAF, F.expr("budget div tokens").alias("whole_copies"), F.expr("budget % tokens").alias("rest")), "plan")

    order = F.md5(F.concat_ws("|", F.lit(mix.seed), F.col("whole_copies") + 1, F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), "row"))))
    rows = narrow.join(plan, LEAF).withColumn("digest", order).withColumn("base", F.lit(0).cast("long"))
    rows = rows.withColumns({"d1": F.substring("digest", 1, 3), "d2": F.substring("digest", 4, 3)})
    done, decided = [], F.when(F.col("end") <= F.col("rest"), F.col("tokens")).otherwise(F.lit(0))
    keys = list(LEAF)
    for digit in ("d1", "d2"):
        rows = scratch.keep(_by_digit(rows, keys, digit), f"by-{digit}")
        ends_here = (F.col("start") < F.col("rest")) & (F.col("end") > F.col("rest"))
        done.append(rows.filter(~ends_here).select("row", "whole_copies", decided.alias("extra_tokens")))
        rows, keys = rows.filter(ends_here).withColumn("base", F.col("start")).drop("start", "end"), [*keys, digit]
    before = Window.partitionBy(*keys).orderBy("digest", "row").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("tokens").over(before), F.lit(0))
    last = rows.withColumn("start", start).select("row", "whole_copies", F.least("tokens", F.greatest(F.lit(0), F.col("rest") - F.col("start"))).alias("extra_tokens"))
    taken = done[0].unionByName(done[1]).unionByName(last)
    out = named.join(taken, "row", "left")
    return out.select(
        "_doc.*", "domain", "tokens", F.coalesce("whole_copies", F.lit(0)).alias("whole_copies"),
        F.when(F.col("tokens") > 0, F.coalesce("extra_tokens", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("extra_tokens"),
    )


def _name(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(UNKNOWN))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mixture itself: the rows of `docs`, each as often as it is taken. A document that the
    prefix only partly takes is there whole. All columns of `docs` stay as they are, those named like
    the operator's own too."""
    own = ("domain", "tokens", "whole_copies", "extra_tokens", "_copy")
    clash, held = [c for c in docs.columns if c.lower() in own], "_held"
    while held in docs.columns:
        held += "_"
    rest = [c for c in docs.columns if c not in clash]
    taken = select(docs.select(*rest, F.struct(*clash).alias(held)) if clash else docs, mix)
    copies = (F.col("whole_copies") + (F.col("extra_tokens") > 0).cast("long")).cast("int")
    times = F.when((copies > 0) & (F.col("tokens") > 0), copies).otherwise(F.lit(0))
    taken = taken.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times)))
    return taken.select(*[F.col(held)[c].alias(c) if c in clash else F.col(c) for c in docs.columns])

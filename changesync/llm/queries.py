"""The dealt operators as queries over the tables, with production parameters."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from changesync.llm import (
    best_fit, bottom_k, fill_in_middle, grace_dedup, harmonic, jaccard_join, line_dedup, maxent_lm, merkle, mixing, token_files, tokens, toxicity, viterbi_count,
)
from changesync.storage import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORD_BPE, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_line_dedup")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(documents(spark, sf_dir)).drop("row")


@query("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark).root}/tokens"
    token_files.write_tokens(documents(spark, sf_dir), path, tokens.public_path(WORD_BPE), end_id=2)
    read = token_files.read_tokens(spark, path)
    return token_files.global_starts(token_files.checksums(read), read).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, how = documents(spark, sf_dir), toxicity.Settings()
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), how)
    scored = toxicity.score(docs.select("doc_id", "text"), model, how)
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= how.threshold).cast("int").alias("predicted"),
        "passages",
    )


def _share_sql(rows: str, out: str, family: str, name: str, keys: str) -> str:
    """Steps that split a family's budget by weight, children that fill up first."""
    order = f"PARTITION BY {family} ORDER BY cap / w, {name}"
    return f"""
    {rows}_1 AS (
        SELECT *, coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
               sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM {rows}
    ), {rows}_2 AS (SELECT *, cap * ws <= (budget - caps) * w AS filled FROM {rows}_1),
    {rows}_3 AS (
        SELECT *, sum(CASE WHEN filled THEN cap ELSE 0 END) OVER (PARTITION BY {family}) AS taken,
               sum(CASE WHEN filled THEN 0 ELSE w END) OVER (PARTITION BY {family}) AS open FROM {rows}_2
    ), {out} AS (
        SELECT {keys}, CASE WHEN filled THEN cap ELSE least(cap, (budget - taken) * w // greatest(open, 1)) END AS budget FROM {rows}_3
    )"""


# Tree budgets by integer shares, family by family, then each leaf's prefix of its seeded pass.
MIXING_SQL = f"""
    WITH doc AS (
        SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
               len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens
        FROM documents
    ), dom AS (SELECT *, 'domain' || ((instr('0123456789abcdef', md5(source)[1:1]) - 1) % 4) AS domain FROM doc),
    leaf AS (SELECT domain, lang, source, sum(tokens) AS tokens, sum(tokens) * 2 AS cap FROM dom GROUP BY ALL),
    total AS (SELECT least(sum(tokens) * 80 // 100, sum(cap)) AS budget FROM leaf),
    d AS (
        SELECT 0 AS root, domain, sum(cap) AS cap, (SELECT budget FROM total) AS budget,
               CASE domain WHEN 'domain0' THEN 40 WHEN 'domain1' THEN 30 WHEN 'domain2' THEN 20 ELSE 10 END AS w
        FROM leaf GROUP BY domain
    ), {_share_sql("d", "domains", "root", "domain", "domain")}, l AS (
        SELECT domain, lang, sum(cap) AS cap, any_value(domains.budget) AS budget,
               CASE lang WHEN 'en' THEN 50 WHEN 'de' THEN 20 WHEN 'fr' THEN 20 ELSE 10 END AS w
        FROM leaf JOIN domains USING (domain) GROUP BY domain, lang
    ), {_share_sql("l", "langs", "domain", "lang", "domain, lang")}, s AS (
        SELECT leaf.*, langs.budget, 10 AS w FROM leaf JOIN langs USING (domain, lang)
    ), {_share_sql("s", "leaves", "domain, lang", "source", "domain, lang, source, tokens AS held")}, plan AS (
        SELECT domain, lang, source, (budget // held)::BIGINT AS whole_copies, budget % held AS rest FROM leaves WHERE held > 0
    ), placed AS (
        SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY digest RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                  - sum(tokens) OVER (PARTITION BY domain, lang, source, digest) AS start
        FROM (SELECT dom.*, whole_copies, rest, md5('7|' || (whole_copies + 1) || '|' || doc_id) AS digest FROM dom JOIN plan USING (domain, lang, source))
    )
    SELECT doc_id, domain, lang, source, tokens, whole_copies, least(tokens, greatest(0, rest - start))::BIGINT AS extra_tokens FROM placed
    UNION ALL
    SELECT doc_id, domain, lang, source, tokens, 0, 0 FROM dom ANTI JOIN plan USING (domain, lang, source)
"""


@query("op4_mixing", MIXING_SQL)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "lang", "source", mixing.n_tokens(F.coalesce("text", F.lit(""))).alias("words"))
    taken = mixing.select(docs, tokens=F.col("words"))
    return taken.select(
        "doc_id", "domain", F.coalesce("lang", F.lit(mixing.UNKNOWN)).alias("lang"), F.coalesce("source", F.lit(mixing.UNKNOWN)).alias("source"),
        "tokens", "whole_copies", "extra_tokens",
    )


@query("op5_maxent_lm")
def op5_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(documents(spark, sf_dir))


@query("op6_viterbi_count")
def op6_viterbi_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi_count.count_tokens(documents(spark, sf_dir), tokens.public_path(PIECES))


@query("op7_jaccard_join")
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "n_links")


@query("op8_best_fit")
def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = best_fit.packed(documents(spark, sf_dir), tokens.public_path(WORD_BPE), end_id=0)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op9_bottom_k")
def op9_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottom_k.against_next(documents(spark, sf_dir))


@query("op10_grace_dedup", r"""
    WITH t AS (
        SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
    ), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY ALL)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
""")
def op10_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace_dedup.dedup(documents(spark, sf_dir)).drop("row")


@query("op11_harmonic")
def op11_harmonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = harmonic.packed(documents(spark, sf_dir), tokens.public_path(WORD_BPE), end_id=2)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op13_fill_in_middle", """
    WITH t AS (
        SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
    ), d AS (
        SELECT *, ('0x' || h[1:8])::UBIGINT % (n + 1) AS a, ('0x' || h[9:16])::UBIGINT % (n + 1) AS b,
               CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::UBIGINT % 100 >= 90 THEN 'plain'
                    WHEN ('0x' || h[25:32])::UBIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t
    ), c AS (SELECT *, least(a, b)::BIGINT AS x, greatest(a, b)::BIGINT AS y FROM d), p AS (
        SELECT *, substring(text, 1, x) AS prefix, substring(text, x + 1, y - x) AS middle, substring(text, y + 1, n - y) AS suffix FROM c
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                  ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM p
""")
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = fill_in_middle.Middle()
    rows = fill_in_middle.restore(fill_in_middle.transform(documents(spark, sf_dir), how), how)
    return rows.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


def _leaf_sql(text: str) -> str:
    values = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in values) + ")"


def _crc32_sql(digits: str) -> str:
    """CRC-32 of ASCII text bit by bit; DuckDB has no such function."""
    return f"""xor(list_reduce(
        flatten(list_transform(range(1, length({digits}) + 1), lambda i: [ascii({digits}[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
        lambda c, x: CASE WHEN xor(c, x) & 1 = 1 THEN xor(xor(c, x) >> 1, 3988292384) ELSE xor(c, x) >> 1 END, 4294967295::BIGINT
    ), 4294967295)"""


def _climb_sql(tree: str, rows: str, out: str, start: str) -> str:
    """Steps that fold the nodes `rows` up one of the trees, with the siblings met on the way."""
    return f"""
    {out} AS (
        SELECT id, source, 0 AS level, {start} AS pos, node, proof FROM {rows}
        UNION ALL
        SELECT id, w.source, w.level + 1, w.pos // 16, sha256(array_to_string(r.ds[: w.pos % 16] || [w.node] || r.ds[w.pos % 16 + 2 :], '')),
               w.proof || array_to_string(r.ds[: w.pos % 16] || r.ds[w.pos % 16 + 2 :], '')
        FROM {out} w JOIN runs r ON r.tree = {tree} AND r.level = w.level AND r.run = w.pos // 16 AND ({tree} = 1 OR r.source IS NOT DISTINCT FROM w.source)
    )"""


_RISE = "sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16"

# Levels of both trees, their runs of 16 as lists, and every leaf climbing first to its subroot, then to the root.
MERKLE_SQL = f"""
    WITH RECURSIVE leaves AS (
        SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
               CASE WHEN {_crc32_sql("(doc_id::VARCHAR)")} % 5 = 0 THEN {_leaf_sql(f"translate(text, '{merkle.CAPITALS}', '{merkle.CAPITALS.lower()}')")} END AS claimed
        FROM documents
    ), t0 AS (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves
    ), t AS (
        SELECT 0 AS level, source, pos, leaf AS digest, n FROM t0
        UNION ALL SELECT level + 1, source, pos // 16, {_RISE} FROM t WHERE n > 1 GROUP BY level, source, pos // 16
    ), subs AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1),
    u AS (
        SELECT 0 AS level, place AS pos, subroot AS digest, n FROM subs
        UNION ALL SELECT level + 1, pos // 16, {_RISE} FROM u WHERE n > 1 GROUP BY level, pos // 16
    ), runs AS (
        SELECT 0 AS tree, level, source, pos // 16 AS run, list(digest ORDER BY pos) AS ds FROM t WHERE n > 1 GROUP BY level, source, pos // 16
        UNION ALL SELECT 1, level, NULL, pos // 16, list(digest ORDER BY pos) FROM u WHERE n > 1 GROUP BY level, pos // 16
    ), start AS (SELECT row_number() OVER () AS id, *, coalesce(claimed, leaf) AS node, '' AS proof FROM t0),
    {_climb_sql("0", "start", "w", "pos")},
    mid AS (
        SELECT w.id, w.source, subs.place, arg_max(w.node, w.level) AS node, arg_max(w.proof, w.level) AS proof
        FROM w JOIN subs ON subs.source IS NOT DISTINCT FROM w.source GROUP BY ALL
    ), {_climb_sql("1", "mid", "x", "place")},
    ends AS (SELECT id, arg_max(node, level) AS node, arg_max(proof, level) AS proof FROM x GROUP BY id),
    root AS (SELECT digest AS root FROM u WHERE n = 1)
    SELECT doc_id, leaf, subroot, root, sha256(ends.proof) AS proof_sha256, ends.node AS folded_root, ends.node = root AS verified
    FROM start JOIN ends USING (id) JOIN subs ON subs.source IS NOT DISTINCT FROM start.source CROSS JOIN root
"""


@query("op12_merkle_manifest", MERKLE_SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir), merkle.FIELDS, merkle.lowered_leaf())

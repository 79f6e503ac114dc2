"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bpe, html, language, merkle, mixing, packing, pii, quality, repair, simhash, suffixes, vectors, whitening
from riskloom.llm.common import QUERIES, read, register, tokenizer

ORACLES: dict[str, str] = {}

MERKLE_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


@register("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.quality(docs, read(spark, sf_dir, "labels"))
    return out.select("doc_id", *[F.col(f"stats.{c}").alias(c) for c in quality.BASE], "base_failed", "kept")


@register("op9_pii")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents"))
    # (a Python lambda of two parameters would get the place in the array as its second)
    counts = [F.expr(f"size(filter(base, x -> x.k = {i}))").cast("long").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.joined("base"), 256).alias("base_sha256"),
                        pii.joined("concat(base, added)").alias("spans"), F.size("added").cast("long").alias("n_added"))


@register("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), capacity=4096, end_id=1)


@register("op6_bpe_transducer")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@register("op10_token_ids")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.write_and_read(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2)


@register("op1_simhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, distance=4)


@register("op5_embedding_near_dups")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.98)


@register("op7_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


@register("op2_html_text")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


@register("op4_suffix_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(read(spark, sf_dir, "documents"))


@register("op11_mixing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@register("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"), keep=4)


@register("op13_merkle")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    # only where a text changes, so that all other rows carry nothing
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    hit = (F.crc32(F.col("doc_id").cast("string")) % 3 == 0) & F.col("text").rlike("[A-Z]")
    altered = merkle.leaf_digest(*[F.translate("text", upper, upper.lower()) if c == "text" else F.col(c) for c in MERKLE_COLUMNS])
    found = merkle.manifest(docs, F.col("lang"), F.col("doc_id"), merkle.leaf_digest(*map(F.col, MERKLE_COLUMNS)),
                            carry={"altered": F.when(hit, altered)})
    folded = found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("proof")), 256).alias("proof_sha256"),
                          merkle.fold(F.coalesce("altered", "leaf"), F.col("proof")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string in DuckDB, bit by bit over the bytes."""
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), "
            f"lambda c, b: {bits}), 4294967295)")


def _climb_sql(source: str, group: str, order: str, digest: str, levels: int, name: str) -> str:
    """Levels 0.. of runs of 8: place, digest and the siblings' text of every node, as DuckDB CTEs.

    A tree that is down to one node keeps it; ``levels`` levels are enough for 8 ** levels rows."""
    out = [f"{name}0 AS (SELECT *, {digest} AS d, row_number() OVER (PARTITION BY {group} ORDER BY {order}) - 1 AS p0, "
           f"count(*) OVER (PARTITION BY {group}) AS n0 FROM {source})"]
    # nodes of level k + 1, from one row for each node of level k
    out.append(f"{name}_l0 AS (SELECT {group} AS g, p0 AS p, d, n0 AS n FROM {name}0)")
    for k in range(levels):
        out.append(f"{name}_l{k + 1} AS (SELECT g, p // 8 AS p, CASE WHEN n = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY p)) END AS d, "
                   f"CASE WHEN n = 1 THEN 1 ELSE (n + 7) // 8 END AS n FROM {name}_l{k} GROUP BY g, p // 8, n)")
        out.append(f"{name}_r{k} AS (SELECT g, p, n, coalesce(string_agg(d, '') OVER (PARTITION BY g, p // 8 ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lt, "
                   f"coalesce(string_agg(d, '') OVER (PARTITION BY g, p // 8 ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rt FROM {name}_l{k})")
    return ", ".join(out)


def merkle_sql(levels: int = 6) -> str:
    """DuckDB SQL of op13 for up to 8 ** levels rows a language, and as many languages."""
    fields = lambda t: "concat(" + ", ".join(
        f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen({c}::VARCHAR), ':', {c}::VARCHAR) END"
        for c in [t if c == "text" else c for c in MERKLE_COLUMNS]) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [f"docs AS (SELECT doc_id, coalesce('=' || lang, '') AS grp, sha256({fields('text')}) AS leaf, "
            f"CASE WHEN doc_id IS NOT NULL AND {_crc32_sql('doc_id::VARCHAR')} % 3 = 0 THEN sha256({fields(lower)}) END AS altered FROM documents)",
            _climb_sql("docs", "grp", "doc_id NULLS FIRST, leaf", "leaf", levels, "a"),
            f"subs AS (SELECT g AS grp, 'r' AS one, min(d) AS sub FROM a_l{levels} GROUP BY g)",
            _climb_sql("subs", "one", "grp", "sub", levels, "b")]
    # the folded digest and the siblings' text, level by level
    ctes.append("f0 AS (SELECT doc_id, leaf, grp, p0, coalesce(altered, leaf) AS acc, '' AS proof FROM a0)")
    at = 0
    for name, key in (("a", "grp"), ("b", "'r'")):
        if name == "b":
            ctes.append(f"f{at + 1} AS (SELECT f.doc_id, f.leaf, f.grp, b0.p0, acc, proof FROM f{at} f JOIN b0 ON f.grp = b0.grp)")
            at += 1
        for k in range(levels):
            ctes.append(f"f{at + 1} AS (SELECT doc_id, leaf, grp, p0, CASE WHEN r.n = 1 THEN acc ELSE sha256(concat(lt, acc, rt)) END AS acc, "
                        f"proof || lt || rt AS proof FROM f{at} f JOIN {name}_r{k} r ON r.g = {key.replace('grp', 'f.grp')} AND r.p = p0 // {8**k})")
            at += 1
    return (f"WITH {', '.join(ctes)} SELECT doc_id, leaf, sub AS subroot, t.d AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = t.d AS verified "
            f"FROM f{at} f JOIN subs ON f.grp = subs.grp CROSS JOIN (SELECT min(d) AS d FROM b_l{levels}) t")


ORACLES["op13_merkle"] = merkle_sql()

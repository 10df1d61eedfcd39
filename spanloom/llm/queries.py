"""The registered queries of this subpackage: each operator over its whole table, cut to the columns that are compared."""
from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.llm import oracles

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("op3_language")
def language(spark, d):
    from spanloom.llm.language import identify
    return identify(table(spark, d, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score", "known")


@query("op8_neardup", oracles.OP8)
def neardup(spark, d):
    from spanloom.llm.neardup import near_duplicates
    return near_duplicates(table(spark, d, "documents"), k=3, percent=85)


@query("op2_decontamination", oracles.OP2)
def decontamination(spark, d):
    from spanloom.llm.decontaminate import contained_items
    return contained_items(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op7_packing")
def packing(spark, d):
    import public_tokenizers
    from spanloom.llm.packing import pack_documents
    return pack_documents(table(spark, d, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


@query("op5_secrets", oracles.OP5)
def secrets(spark, d):
    from spanloom.llm.secrets import digest_columns, scan
    return digest_columns(scan(table(spark, d, "documents").select("doc_id", "text", "source"), keep_text=False))


@query("op9_topk", oracles.OP9)
def topk(spark, d):
    from spanloom.llm.topk import top_k
    return top_k(table(spark, d, "embeddings"))


@query("op4_sharding")
def sharding(spark, d):
    from spanloom.llm.sharding import sharded
    return sharded(table(spark, d, "documents").select("doc_id", "text"), keep_text=False).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query("op6_quality")
def quality(spark, d):
    from spanloom.llm.quality import scored
    return scored(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op10_html")
def html(spark, d):
    from spanloom.llm.html import extracted
    return extracted(table(spark, d, "pages").select("page_id", "url", "html"))


@query("op1_licenses")
def licenses(spark, d):
    """Documents as files: source is the root, hundreds and tens of thousands of doc_id are directories."""
    from spanloom.llm.licenses import scan
    n = F.coalesce(F.col("doc_id"), F.lit(-1))
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(n / 10000).cast("string"), F.floor(n / 100).cast("string"), F.concat(n.cast("string"), F.lit(".txt")))
    return scan(table(spark, d, "documents").select("doc_id", path.alias("path"), "text"))


@query("op11_repair", oracles.OP11)
def repair(spark, d):
    from spanloom.llm.repair import audited
    return audited(table(spark, d, "conversations"))


@query("op12_pii")
def pii(spark, d):
    from spanloom.llm.pii import digest_columns, scan
    return digest_columns(scan(table(spark, d, "documents").select("doc_id", "text"), keep_text=False))


@query("op13_whitening")
def whitening(spark, d):
    from spanloom.llm.whitening import whitened
    return whitened(table(spark, d, "embeddings"))


@query("pipeline")
def pipeline(spark, d):
    import corpus_pipeline
    return corpus_pipeline.run(spark, d)

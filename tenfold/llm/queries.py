"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tenfold.llm import bpe, common, lengths, merkle, mixing, neighbours, packing, perplexity, pii, setjoin, sharding, substrings, tokens, toxicity, whitening
from tenfold.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


# ------------------------------------------------------------ 1 mixing

MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.75, 2, 23


def mix_levels() -> dict:
    """Domains are groups of sources, by the first digit of a hash of the name."""
    digit = F.conv(F.substring(F.md5(F.coalesce(F.col("source"), F.lit("")).cast("binary")), 1, 1), 16, 10).cast("int")
    return {"domain": F.concat(F.lit("d"), (digit % 4).cast("string")), "lang": F.col("lang"), "source": F.col("source")}


def mix_weights() -> dict:
    """Whole numbers, which both engines add exactly; sources weigh alike."""
    return {
        "domain": F.when(F.col("domain") == "d0", 4).when(F.col("domain") == "d1", 3).when(F.col("domain") == "d2", 2).otherwise(1),
        "lang": F.when(F.col("lang") == "en", 3).otherwise(2),
    }


#: Stages of the mixture in SQL, over a stage ``docs_in`` (doc_id, text, lang, source).
MIX_SQL = f"""
rows_in AS (
  SELECT doc_id, 'd' || (CAST('0x' || substr(md5(coalesce(source, '')), 1, 1) AS INT) % 4) AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '{common.WORD}')) AS tokens
  FROM docs_in),
mix_rows AS (SELECT * FROM rows_in WHERE tokens > 0),
leaves AS (
  SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, (sum(tokens) * {MIX_EPOCHS})::DOUBLE AS cap FROM mix_rows GROUP BY ALL),
root AS (SELECT least(floor(sum(tokens) * {MIX_SHARE}::DOUBLE), sum(cap)) AS budget FROM leaves),
n1 AS (
  SELECT d.*, r.budget FROM (
    SELECT domain, sum(cap) AS cap, CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END::DOUBLE AS w
    FROM leaves GROUP BY domain) d, root r),
f1 AS (
  SELECT *, cap * sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
         <= w * (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS filled
  FROM n1),
b1 AS (
  SELECT domain, CASE WHEN filled THEN cap ELSE w * (budget - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ())
         / sum(CASE WHEN filled THEN 0 ELSE w END) OVER () END AS budget FROM f1),
n2 AS (
  SELECT l.*, b1.budget FROM (
    SELECT domain, lang, sum(cap) AS cap, CASE WHEN lang = 'en' THEN 3 ELSE 2 END::DOUBLE AS w
    FROM leaves GROUP BY domain, lang) l JOIN b1 USING (domain)),
f2 AS (
  SELECT *, cap * sum(w) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
         <= w * (budget - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS filled
  FROM n2),
b2 AS (
  SELECT domain, lang, CASE WHEN filled THEN cap ELSE w * (budget - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER (PARTITION BY domain))
         / sum(CASE WHEN filled THEN 0 ELSE w END) OVER (PARTITION BY domain) END AS budget FROM f2),
n3 AS (SELECT l.*, 1::DOUBLE AS w, b2.budget FROM leaves l JOIN b2 USING (domain, lang)),
f3 AS (
  SELECT *, cap * sum(w) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
         <= w * (budget - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS filled
  FROM n3),
b3 AS (
  SELECT domain, lang, source, tokens AS leaf_tokens,
         floor(CASE WHEN filled THEN cap ELSE w * (budget - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER (PARTITION BY domain, lang))
         / sum(CASE WHEN filled THEN 0 ELSE w END) OVER (PARTITION BY domain, lang) END)::BIGINT AS target FROM f3),
epochs AS (
  SELECT r.*, leaf_tokens, target, unnest(range(0, target // leaf_tokens + 1)) AS epoch
  FROM mix_rows r JOIN b3 USING (domain, lang, source) WHERE target > 0),
streamed AS (
  SELECT *, least(leaf_tokens, target - epoch * leaf_tokens) AS part,
         sum(tokens) OVER (PARTITION BY domain, lang, source, epoch
             ORDER BY CAST('0x' || substr(md5('{MIX_SEED}|' || epoch || '|' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT), doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM epochs),
mixed AS (
  SELECT doc_id, domain, lang, source, epoch, tokens::BIGINT AS tokens, least(tokens, part - upto + tokens)::BIGINT AS take_tokens
  FROM streamed WHERE upto - tokens < part)"""


@query("op1_mixing", f"WITH docs_in AS (SELECT * FROM documents), {MIX_SQL} SELECT * FROM mixed")
def op1_mixing(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mixing.mix(docs, mix_levels(), mix_weights(), MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    return mixed.select("doc_id", "domain", "lang", "source", "epoch", "tokens", "take_tokens")


# ------------------------------------------------------------ 2 packing


@query("op2_packing")
def op2_packing(spark, sf_dir):
    return packing.pack(common.table(spark, sf_dir, "documents"), tokens.word_bpe_path())


# ------------------------------------------------------------ 3 token counts


@query("op3_length_histogram")
def op3_length_histogram(spark, sf_dir):
    hist = lengths.histogram(common.table(spark, sf_dir, "documents"), tokens.word_bpe_path(), by=["lang"])
    return lengths.suffix_sums(common.written(hist, "lengths"), by=["lang"])  # two readers, one encoding


# ------------------------------------------------------------ 4 personal data

#: For the registered query only; a job passes its own key from where it keeps secrets.
PUBLIC_KEY = b"a key that everybody may know"


@query("op4_pseudonyms")
def op4_pseudonyms(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PUBLIC_KEY)


# ------------------------------------------------------------ 5 toxicity


@query("op5_factorization_machine")
def op5_factorization_machine(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    held = toxicity.held_out(F.col("doc_id")).alias("held_out")
    rows = docs.select("doc_id", held, "text")
    return toxicity.score(rows, machine).select("doc_id", "held_out", "score", "predicted")


# ------------------------------------------------------------ 8 quality rules


@query("op8_perplexity_bands")
def op8_perplexity_bands(spark, sf_dir):
    return perplexity.judge(common.table(spark, sf_dir, "documents"), carry=["doc_id"])


# ------------------------------------------------------------ 9 sharding


@query("op9_sharding")
def op9_sharding(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    text = common.text_column()
    size = (F.octet_length(text) + 1).cast("long")
    path = scratch_path(spark, "llm-shards")
    sharding.write_shards(sharding.dealt(docs, ["doc_id", "text"], size, shards=16), path)
    whole = StructType([StructField("row", docs.schema), StructField("slot", LongType()), StructField("shard", IntegerType())])
    arrived = spark.read.schema(whole).parquet(path)
    text = common.text_column("row.text")
    return arrived.select(
        F.col("row.doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


# ------------------------------------------------------------ 10 nearest neighbours


@query("op10_cross_polytope")
def op10_cross_polytope(spark, sf_dir):
    found = neighbours.search(common.table(spark, sf_dir, "embeddings"), F.expr("pmod(id, 20) = 0"), k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


# ------------------------------------------------------------ 7 n-gram Jaccard join


@query("op7_jaccard_groups")
def op7_jaccard_groups(spark, sf_dir):
    return setjoin.join(common.table(spark, sf_dir, "documents"))


# ------------------------------------------------------------ 6 repeated substrings


@query("op6_prefix_doubling")
def op6_prefix_doubling(spark, sf_dir):
    return substrings.remove_repeats(common.table(spark, sf_dir, "documents"))


# ------------------------------------------------------------ 12 BPE encoding and decoding


@query("op12_bpe_round_trip")
def op12_bpe_round_trip(spark, sf_dir):
    docs, path = common.table(spark, sf_dir, "documents").select("doc_id", "text"), tokens.word_bpe_path()
    coded = bpe.decode(bpe.encode(docs, path, carry=["doc_id"]), path, carry=["doc_id", "ids"])
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


# ------------------------------------------------------------ 13 Merkle dataset manifest

@query("op13_merkle_manifest")
def op13_merkle_manifest(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.manifest(merkle.of_documents(docs, tampered)).withColumnRenamed("id", "doc_id")


# ------------------------------------------------------------ 11 whitening


@query("op11_spectrum_slicing")
def op11_spectrum_slicing(spark, sf_dir):
    rows = whitening.components_of(*whitening.whiten(common.table(spark, sf_dir, "embeddings"), components=32))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long")).withColumnRenamed("id", "vec_id")

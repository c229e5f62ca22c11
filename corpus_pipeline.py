"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept.
Its rows are written to the shared folder and read again as the next one's docs.
All but the last return the columns they were given; a row travels as one struct,
so columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenfold.llm import common, mixing, packing, perplexity, pii, queries, setjoin, tokens

#: The mixture takes nine tenths of the tokens that reach it, with no source read more than twice.
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.9, 2, 29

#: The setting with the secret key of the pseudonyms; without it a public key is used, which anyone can reverse.
KEY_SETTING = "spark.tenfold.pseudonyms.key"


def _row(docs: DataFrame, *named: str) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *named)


def _with_text(docs: DataFrame, rows: DataFrame, changed) -> DataFrame:
    """The rows again, with ``text`` where it was changed, and n_chars to match."""
    out = []
    for c in docs.columns:
        old = F.col("_row").getField(c)
        if c == "text":
            old = F.when(changed, F.col("text")).otherwise(old)
        elif c == "n_chars":
            old = F.when(changed, F.char_length("text").cast(docs.schema[c].dataType)).otherwise(old)
        out.append(old.alias(c))
    return rows.select(*out)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's perplexity band."""
    others = _row(docs, "text", "lang").withColumn("_row", F.col("_row").dropFields("text"))
    kept = perplexity.judge(others, carry=["_row"], with_text=True).where("kept")  # a missing text is not kept
    return kept.select(*[(F.col("_text").cast(docs.schema[c].dataType) if c == "text" else F.col("_row").getField(c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return setjoin.one_of_each(_row(docs, "doc_id", "text")).select("_row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms for personal numbers, dates and addresses, under the key of the session."""
    key = spark.conf.get(KEY_SETTING, None)
    rows = pii.pseudonymise(_row(docs, "text"), key.encode() if key else queries.PUBLIC_KEY)
    return _with_text(docs, rows, F.col("n_replaced") > 0)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources; where a source's prefix ends inside a document, only its first words stay."""
    rows = _row(docs, "doc_id", "text", "lang", "source")
    mixed = mixing.mix(rows, queries.mix_levels(), queries.mix_weights(), MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    part = F.col("take_tokens") < F.col("tokens")
    cut = F.when(part, mixing.word_prefix(common.text_column(), F.col("take_tokens"))).otherwise(F.col("text"))
    return _with_text(docs, mixed.withColumn("text", cut), part)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs, tokens.word_bpe_path())


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("source mixture", source_mixture),
    ("packing", packed_sequences),
]

#: Perplexity, pseudonyms and token ids are beyond SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.written(docs, name.replace(" ", "-"))
    return docs

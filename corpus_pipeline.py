"""From raw documents to packed training sequences, in five stages.

Each stage takes all that its predecessor kept. The caller writes what a stage returns and hands the reread table
to the next; ``run`` does the same through the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verigrain.llm.columns import free_name
from verigrain.llm.langid import UNDETERMINED, identify_language, train_language_model
from verigrain.llm.line_dedup import line_dedup
from verigrain.llm.mixing import mix_sources
from verigrain.llm.ngram_join import ngram_jaccard_join
from verigrain.llm.packing import pack_documents
from verigrain.llm.queries import MIX_SEED, MIX_WEIGHTS
from verigrain.llm.sampling import crc_fold
from verigrain.plans.durable import durable

#: Below this score an ambiguous answer counts as a rejection.
LEAST_SCORE = 0.5
END_ID = 1


def beside(docs: DataFrame, added: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``work`` makes of ``docs``, with the columns of ``docs`` alone. Those named like the columns that ``work``
    adds keep their own values."""
    held = {c: free_name(docs, c) for c in docs.columns if c.lower() in added}
    done = work(docs.withColumnsRenamed(held))
    return done.drop(*added).withColumnsRenamed({v: k for k, v in held.items()}).select(docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined: ``und`` goes, and so does an ambiguous answer of a low score.

    Null, empty and letterless texts go; null ids, ties and repeated rows are judged by their texts alone.
    """
    model = train_language_model(docs, crc_fold("doc_id", 4) != 2)

    def accepted(rows: DataFrame) -> DataFrame:
        rejected = (F.col("lang_pred") == UNDETERMINED) | (F.col("ambiguous") & (F.col("score") < LEAST_SCORE))
        return identify_language(rows, model).where(~rejected)

    return beside(docs, ("lang_pred", "score", "ambiguous"), accepted)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines; a document of which nothing is left goes."""

    def cleaned(rows: DataFrame) -> DataFrame:
        left = line_dedup(rows).where((F.col("n_dropped") == 0) | (F.trim("text") != ""))
        return left.withColumn("n_chars", F.length("text").cast("long"))

    return beside(docs, ("n_lines", "n_dropped"), cleaned)


def row_key(doc_id: Column, text: Column) -> Column:
    """A number for each id and text, in the order of ids; a row without an id comes behind all others."""
    half = F.lit(str(2**63)).cast("decimal(19,0)")
    tail = F.shiftrightunsigned(F.xxhash64(text), 1).cast("decimal(19,0)")
    return (F.coalesce(doc_id.cast("decimal(19,0)"), half).cast("decimal(19,0)") * half + tail).cast("decimal(38,0)")


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link, the one with the smallest id; repeated rows once.

    Rows without an id take part one by one, and go before any other does. Texts without words are linked with nothing;
    null text is such a text. An empty table gives an empty result.
    """
    key, own = free_name(docs, "key"), F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), own))
    found = ngram_jaccard_join(keyed.select(key, "text"), id_col=key)
    kept = found.where(F.col(key) == F.col("component_id")).select(key).distinct()
    return keyed.join(kept, key, "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources reach their target weights, in shuffled order.

    A row without an id draws by its text, a null source belongs to the group of sources not named, and null and empty
    texts weigh nothing. An empty table stays empty.
    """
    return beside(docs, ("copy", "n_copies", "shuffle_key"), lambda rows: mix_sources(rows, MIX_WEIGHTS, MIX_SEED))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences.

    Null and empty texts are one end token, long ones several pieces; null ids and repeated rows are packed as they are.
    """
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_join", near_copy_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the trained classifier of the first stage or the packing of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
    return docs

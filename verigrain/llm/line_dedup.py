"""Line dedup with a fixed-depth log-template tree.

A line's path in the tree is its token count and its leading tokens; the leaf below holds all lines with that path.
Tokens with a digit are variable from the start. Inside a leaf, a token stays constant at its position if enough
documents have it there; any other becomes a variable field. Lines whose constants agree share a template, and a
template that recurs in enough documents is dropped everywhere but at its first occurrence.

Only leaves that enough documents reach can hold a recurring template, so only their lines are ever split into
tokens or shuffled; a fixed-size bitmap of those leaves filters the others in the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verigrain.llm.columns import bitmap_of, free_name, salted_join, text_or_empty, with_bitmap_flag
from verigrain.plans.durable import durable

VARIABLE = "<*>"
#: Tokens of a line that are hashed together.
BLOCK = 64


def line_table(docs: DataFrame, id_col: str, text_col: str, depth: int) -> DataFrame:
    """One row per line that is not blank: row_id, text_key, pos (from 0), masked, n_tokens, leaf.

    masked has blanks folded and trimmed, and the variable mark for each token that holds a digit. Both are done
    on the whole text, and only where it has something to fold or mask.
    """
    text = F.col("text")
    uneven = F.lit(False)
    for blank in ("  ", "\t", "\x0b", "\x0c", "\r"):
        uneven = uneven | F.contains(text, F.lit(blank))
    folded = F.when(uneven, F.regexp_replace(text, "[\\x09\\x0b\\x0c\\x0d ]+", " ")).otherwise(text)
    marked = F.when(text.rlike("[0-9]"), F.regexp_replace(text, "(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*", VARIABLE)).otherwise(text)
    lines = (
        docs.select(F.col(id_col).alias("row_id"), text_or_empty(text_col).alias("text"))
        .select("row_id", F.xxhash64("text").alias("text_key"), folded.alias("text"))
        .select("row_id", "text_key", marked.alias("text"))
        .select("row_id", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("row_id", "text_key", "pos", F.trim("line").alias("masked"))
        .where("masked <> ''")
    )
    n_tokens = F.length("masked") - F.length(F.replace(F.col("masked"), F.lit(" "), F.lit(""))) + 1
    leaf = F.xxhash64("n_tokens", F.substring_index("masked", " ", depth))
    return lines.withColumn("n_tokens", n_tokens).withColumn("leaf", leaf)


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = 3,
    min_docs: int = 10,
    min_constant: float = 0.8,
) -> DataFrame:
    """``docs`` with recurring lines removed from ``text_col``; adds n_lines and n_dropped (bigint).

    A template recurs if at least ``min_docs`` documents have a line of it and it has a constant token, as must be at
    least the share ``min_constant`` of its tokens without a digit. Its first line, by id and then position, stays;
    the other lines of the template go. Lines are what line feeds separate; they may be of any length, so that
    ``min_docs`` copies of a document vanish whole and leave no stubs of their short lines.

    * Null or empty text: no lines count, the text becomes empty. Blank lines always stay.
    * A document is a row: rows that repeat an id with another text are separate; rows that repeat both id and
      text are one document and are treated alike. A null id sorts first.
    * Columns named n_lines or n_dropped are replaced; all others are kept, whatever their names.
    * Empty table: empty result.
    """
    docs = docs.drop("n_lines", "n_dropped")
    lines = line_table(docs, id_col, text_col, depth)
    slim = durable(lines.select("row_id", "text_key", "pos", "leaf", "n_tokens", F.xxhash64("masked").alias("line")))

    held = slim.select("row_id", "text_key", "leaf", "line").distinct()
    leaf_docs = held.select("row_id", "text_key", "leaf").distinct().groupBy("leaf").count()
    leaves = durable(leaf_docs.where(F.col("count") >= min_docs).select("leaf"))
    bitmap = bitmap_of(leaves, F.col("leaf"))

    texts = (
        with_bitmap_flag(lines, F.col("leaf"), bitmap, "busy").where("busy")
        .groupBy("leaf", F.xxhash64("masked").alias("line")).agg(F.min("masked").alias("masked"))
    )
    line_docs = held.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("n_docs"))
    candidates = line_docs.join(leaves, "leaf", "left_semi").join(texts, ["leaf", "line"])
    tokens = durable(
        candidates.select("leaf", "line", "n_docs", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    )
    constant = (
        tokens.where(F.col("token") != VARIABLE)
        .groupBy("leaf", "at", "token").agg(F.sum("n_docs").alias("seen"))
        .where(F.col("seen") >= min_docs).select("leaf", "at", "token", F.lit(1).alias("fixed"))
    )
    field = F.struct("at", F.when(F.col("fixed") == 1, F.col("token")).otherwise(F.lit(VARIABLE)).alias("as"))
    # The tokens of one line may be very many: they meet in blocks, whose hashes make the template.
    blocks = (
        tokens.join(constant, ["leaf", "at", "token"], "left")
        .groupBy("leaf", "line", (F.col("at") / BLOCK).cast("int").alias("block"))
        .agg(
            F.xxhash64(F.sort_array(F.collect_list(field))).alias("fields"),  # at most ``BLOCK``
            F.sum(F.coalesce("fixed", F.lit(0))).alias("n_fixed"),
            F.count_if(F.col("token") != VARIABLE).alias("n_plain"),
            F.max("n_docs").alias("n_docs"),
        )
    )
    templates = (
        blocks.groupBy("leaf", "line")
        .agg(F.sort_array(F.collect_list(F.struct("block", "fields"))).alias("fields"), F.sum("n_fixed").alias("n_fixed"), F.sum("n_plain").alias("n_plain"), F.max("n_docs").alias("n_docs"))
        .where((F.col("n_fixed") > 0) & (F.col("n_fixed") >= F.lit(min_constant) * F.col("n_plain")))
        .select("leaf", "line", "n_docs", F.xxhash64("leaf", "fields").alias("template"))
    )
    # One line, or one template, may be in a third of all documents.
    with_template = salted_join(slim, durable(templates), ["leaf", "line"], "n_docs").where("template IS NOT NULL")
    placed = durable(with_template.select("row_id", "text_key", "pos", "template"))
    per_doc = placed.select("row_id", "text_key", "template").distinct()
    recurring = per_doc.groupBy("template").count().where(F.col("count") >= min_docs).withColumnRenamed("count", "n_docs")
    first = placed.groupBy("template").agg(F.min(F.struct("row_id", "pos")).alias("first"))
    gone = (
        salted_join(placed, durable(first.join(recurring, "template")), ["template"], "n_docs")
        .where(F.col("first").isNotNull() & ~(F.struct("row_id", "pos").eqNullSafe(F.col("first"))))
        .select("row_id", "text_key", "pos").distinct()
        .groupBy("row_id", "text_key").agg(F.collect_list("pos").alias("gone"))  # as many as one text has lines
    )
    key, row, drop = free_name(docs, "key"), free_name(docs, "row"), free_name(docs, "gone")
    gone = gone.select(F.col("row_id").alias(row), F.col("text_key").alias(key + "_"), F.col("gone").alias(drop))
    text = text_or_empty(text_col)
    kept = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(F.col(drop), i))
    joined = docs.join(gone, F.col(id_col).eqNullSafe(F.col(row)) & (F.xxhash64(text) == F.col(key + "_")), "left")
    n_dropped = F.coalesce(F.size(F.col(drop)), F.lit(0))
    return (
        joined.withColumn("n_lines", F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, "\n", -1))).cast("long"))
        .withColumn("n_dropped", F.when(F.col(drop).isNull(), F.lit(0)).otherwise(n_dropped).cast("long"))
        .withColumn(text_col, F.when(F.col(drop).isNull(), text).otherwise(F.array_join(kept, "\n")))
        .drop(row, key + "_", drop)
    )

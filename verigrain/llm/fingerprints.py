"""Document fingerprints: a wide digest of a text's canonical form.

The canonical form is Unicode normalised (NFKC), case folded, and has white space folded to single blanks. Its
128-bit XXH3 digest is the fingerprint. Texts of equal digest count as alike only if their canonical bytes agree.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from verigrain.llm.columns import bitmap_of, salted_join, with_bitmap_flag
from verigrain.llm.textkit import sliced_by_bytes
from verigrain.plans.durable import batches_of, durable

#: Rows sent to a Python worker at once.
BATCH_ROWS = 500
#: Bytes of text taken from a batch at a time, and bytes of canonical forms that a task holds for comparison.
BYTES_AT_A_TIME, HELD_FORMS = 4 << 20, 32 << 20


def canonical(text: str) -> bytes:
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode()


def digest(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


def likeness(a: bytes, b: bytes) -> float:
    """1 if the digests are equal and the canonical bytes too, else 0."""
    return float(xxhash.xxh3_128_intdigest(a) == xxhash.xxh3_128_intdigest(b) and a == b)


def edited_text(text: str, after: str) -> str:
    """``text`` with its last half (rounded down) replaced by as much of the start of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _row(text: str, after: str) -> tuple:
    edited = edited_text(text, after)
    own, changed, following = canonical(text), canonical(edited), canonical(after)
    return (
        len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(own), digest(changed), likeness(own, changed), likeness(own, following),
        hashlib.sha256(text.encode()).hexdigest(),
    )


FIELDS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def canonical_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, fingerprint, group_id (smallest id with the same canonical form), group_size.

    Rows are grouped by digest. Canonical bytes are read only for digests under which texts differ, and compared where
    they are read; should they differ, the bucket is split by the bytes' SHA-256.

    Null text counts as empty; a null id is larger than every other and stays alone only if its text does; repeated
    rows count; an empty table gives an empty result; other columns are ignored.
    """

    @arrow_udf("string")
    def fingerprint(texts: pa.Array) -> pa.Array:
        return pa.array([digest(canonical(t or "")) for t in texts.to_pylist()], pa.string())

    rows = docs.select(F.col(id_col).alias("row_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marked = durable(rows.select("row_id", fingerprint("text").alias("fingerprint"), F.sha2("text", 256).alias("raw")))
    return grouped(marked, rows.select("text")).select(F.col("row_id").alias(id_col), "fingerprint", "group_id", "group_size")


def grouped(marked: DataFrame, texts: DataFrame) -> DataFrame:
    """``marked`` (with row_id, fingerprint and raw, the SHA-256 of the text) plus group_id and group_size.

    ``texts`` holds all of their texts; those of equal fingerprint but unequal SHA-256 are read once more.
    """

    buckets = durable(marked.groupBy("fingerprint").agg(F.min("raw").alias("a"), F.max("raw").alias("b"), F.min("row_id").alias("group_id"), F.count(F.lit(1)).alias("group_size")))
    mixed = buckets.where("a <> b").select("fingerprint")
    raws = durable(marked.select("raw", "fingerprint").distinct().join(mixed, "fingerprint", "left_semi").select("raw"))
    chosen = with_bitmap_flag(texts.withColumn("raw", F.sha2("text", 256)), F.xxhash64("raw"), bitmap_of(raws, F.xxhash64("raw")), "chosen").where("chosen")
    kinds = durable(compared(chosen.select("raw", "text")).distinct())
    clashing = kinds.groupBy("fingerprint").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("fingerprint")
    part = durable(kinds.join(clashing, "fingerprint", "left_semi"))
    if part.isEmpty():
        return salted_join(marked, buckets.drop("a", "b"), ["fingerprint"], "group_size").drop("raw")
    keyed = durable(marked.join(part, ["raw", "fingerprint"], "left").withColumn("part", F.coalesce("part", F.lit(""))))
    groups = durable(keyed.groupBy("fingerprint", "part").agg(F.min("row_id").alias("group_id"), F.count(F.lit(1)).alias("group_size")))
    return salted_join(keyed, groups, ["fingerprint", "part"], "group_size").drop("raw", "part")


def compared(rows: DataFrame) -> DataFrame:
    """raw, fingerprint and part of each row of raw and text: of equal fingerprints, equal bytes have equal parts.

    A task compares the bytes of a form with the last one that it met under the fingerprint, of the ``HELD_FORMS`` bytes
    that it holds; what tasks say is brought together by the SHA-256 of the bytes, so no text leaves its task.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[bytes, str]] = {}
        size = 0
        for batch in batches:
            for some in sliced_by_bytes(batch, 1, BYTES_AT_A_TIME):
                prints, parts = [], []
                for text in some.column(1):
                    form = canonical(text.as_py())
                    key = digest(form)
                    before, part = held.get(key, (None, ""))
                    if before != form:
                        part = hashlib.sha256(form).hexdigest()
                        size += len(form) - len(before or b"")
                        if size > HELD_FORMS:
                            held, size = {}, len(form)
                        held[key] = form, part
                    prints.append(key)
                    parts.append(part)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(prints, pa.string()), pa.array(parts, pa.string())], ["raw", "fingerprint", "part"])

    return rows.mapInArrow(compare, "raw string, fingerprint string, part string")


def fingerprints_with_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``fingerprint_with_next`` plus group_id and group_size, as ``canonical_groups`` has them, from the same digests."""
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    with batches_of(docs.sparkSession, BATCH_ROWS):
        found = durable(fingerprint_with_next(docs, id_col, text_col, with_raw=True))
        groups = grouped(found.withColumnRenamed(id_col, "row_id"), texts)
    return groups.withColumnRenamed("row_id", id_col).select(id_col, *FIELDS, "group_id", "group_size")


def fingerprint_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, with_raw: bool = False) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and its likeness to that text and to the next document.

    The next document is the one with the next larger id; after the last comes the first. Columns: ``id_col`` and
    those of ``FIELDS``, and raw (SHA-256 of the text) ``with_raw``. One range shuffle brings neighbours together; only the last row of each partition waits
    for the first of the following one, and those few rows meet in a second, small step.

    Null text counts as empty. A null id comes before all others; rows that repeat an id follow each other in the
    order of their texts. A single document is its own next. Empty table: empty result. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("row_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(partitions, "row_id") if partitions else rows.repartitionByRange("row_id")
    kind = rows.schema["row_id"].dataType.simpleString()
    schema = f"row_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, raw string, part int, edge string, text string"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), None
        for batch in batches:
            names = ("row_id", *FIELDS, "raw", "part", "edge", "text")
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(ids), 256):
                out = []
                for row_id, text in zip(ids.slice(at, 256).to_pylist(), texts.slice(at, 256).to_pylist(), strict=True):
                    if before is None:
                        out.append((row_id, *[None] * 7, part, "first", text))
                    else:
                        out.append((before[0], *_row(before[1], text), part, None, None))
                    before = row_id, text
                yield _record(names, out, batch.schema.field(0).type)
        if before is not None:
            yield _record(("row_id", *FIELDS, "raw", "part", "edge", "text"), [(before[0], *[None] * 7, part, "last", before[1])], ids.type)

    walked = durable(dealt.sortWithinPartitions("row_id", "text").mapInArrow(walk, schema))
    firsts = walked.where("edge = 'first'").select(F.col("part").alias("part_"), F.col("text").alias("after"))
    # One row per partition of the shuffle: the following partition that has rows, the first after the last.
    order = Window.orderBy("part_")
    parts = firsts.select("part_")
    following = parts.select(
        F.col("part_").alias("part"),
        F.coalesce(F.lead("part_").over(order), F.min("part_").over(Window.partitionBy(F.lit(0)))).alias("part_"),
    )
    lasts = walked.where("edge = 'last'").select("row_id", "part", "text").join(following, "part").join(firsts, "part_")

    @arrow_udf("struct<n_chars:bigint,edited_sha256:string,fingerprint:string,edited_fingerprint:string,near_edited:double,near_next:double,raw:string>")
    def meet(texts: pa.Array, after: pa.Array) -> pa.Array:
        found = [_row(t, a) for t, a in zip(texts.to_pylist(), after.to_pylist(), strict=True)]
        names = (*FIELDS, "raw")
        return pa.array([dict(zip(names, r, strict=True)) for r in found], pa.struct(list(zip(names, _TYPES, strict=True))))

    met = lasts.withColumn("met", meet("text", "after")).select("row_id", "met.*")
    inner = walked.where("edge IS NULL").select("row_id", *FIELDS, "raw")
    found = inner.unionByName(met).withColumnRenamed("row_id", id_col)
    return found if with_raw else found.drop("raw")


_TYPES = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string())


def _record(names: tuple[str, ...], rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = (id_type, *_TYPES, pa.int32(), pa.string(), pa.string())
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(names))

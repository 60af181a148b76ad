"""A corpus pipeline: five stages over ``documents``, each one operator of the library.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before
it kept; its result is written as Parquet and read as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import encode_decode
from tidemark.llm.common import released, written
from tidemark.llm.language_id import fit_text_model, identify_documents
from tidemark.llm.line_dedup import dedup_lines, drop_repeated_runs
from tidemark.llm.mixing import mix
from tidemark.llm.ngram_join import jaccard_components

#: Near duplicates: five-word shingles, a similarity of 0.8.
WIDTH, PERCENT = 5, 80


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` lacks."""
    while name in docs.columns:
        name += "_"
    return name


def _without(docs: DataFrame, key: str, gone: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is not in ``gone``, a table whose written size decides how they meet."""
    return docs.join(written(gone.distinct(), name), key, "left_anti").drop(key)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled documents have; those that no evidence puts there go.

    A null or short text is told by its declared language and source, and goes
    without them. Rows that share id and text are told alike; a null id is an
    id. An empty table stays empty.
    """
    model = fit_text_model(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    key = _unused(docs, "row_key")
    keyed = docs.withColumn(key, F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("\n"), F.coalesce("text", F.lit("")))))
    told = identify_documents(keyed, model, id_col=key)
    return _without(keyed, key, told.where("not accepted").select(key), "pipeline-rejected").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the long runs and the chunks of lines that an earlier document has; a document that loses all of them goes.

    Null and blank texts that lose nothing stay. Repeated rows are treated alike
    by the runs, as one owner by the chunks. An empty table stays empty.
    """
    light = docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]).alias("rest"))
    done = dedup_lines(written(drop_repeated_runs(light), "pipeline-runs"))
    gone = (F.col("removed_chunks") + F.col("run_lines") > 0) & (F.length(F.trim("text")) == 0)
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return done.where(~gone).select(*[F.col(c) if c in ("doc_id", "text") else size.alias(c) if c == "n_chars" else F.col(f"rest.`{c}`") for c in docs.columns])


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of least id; rows without an id come last, by their text.

    Repeated rows are one; of rows that share an id, those that are equal in id and text.
    """
    key = _unused(docs, "row_key")
    late = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2)
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), late))
    comp = jaccard_components(keyed, id_col=key, width=WIDTH, percent=PERCENT)
    kept = _without(keyed.withColumn(_unused(keyed, "again"), F.col(key)), key, comp.where(F.col(key) != F.col("component_id")).select(key), "pipeline-near")
    again = kept.columns[-1]
    twice = written(comp.groupBy(key).count().where("count > 1").select(F.col(key).alias(again)), "pipeline-repeated")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    alike = Window.partitionBy(again, F.md5(F.coalesce("text", F.lit("")))).orderBy(*[F.col(f"`{c}`").cast("string") for c in docs.columns if c != "text"])
    first = kept.join(twice, again, "left_semi").withColumn(key, F.row_number().over(alike)).where(F.col(key) == 1)
    return kept.join(twice, again, "left_anti").select(*docs.columns).union(first.select(*docs.columns))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Rows are told apart by all their columns, so shared and missing ids keep to
    their own row. Equal rows are interchangeable: one of them gives the copies
    of all. Null texts have no words and go; an empty table stays empty.
    """
    key, copies, rows, one = (_unused(docs, c) for c in ("row_key", "row_copies", "row_rows", "row_copy"))
    keyed = docs.withColumn(key, F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))))
    taken = mix(keyed, keep=(key,)).groupBy(key).agg(F.sum("copies").cast("int").alias(copies), F.count(F.lit(1)).alias(rows))
    taken = written(taken.where(F.col(copies) > 0), "pipeline-copies")
    met = keyed.join(taken.where(F.col(rows) == 1).drop(rows), key)
    again = taken.where(F.col(rows) > 1).drop(rows)
    if not again.isEmpty():
        met = met.union(keyed.join(written(again, "pipeline-again"), key).dropDuplicates([key]).select(*met.columns))
    return met.withColumn(one, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes: a row for each row, a null text as the empty one, nothing for nothing."""
    # written here, so that the batches which go to Python stay as small as ``written`` has them
    return written(encode_decode(docs), "pipeline-ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

#: The stages hash, sample and merge in ways that SQL cannot express; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every one but the last is written to the shared folder, and goes when the next stands."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            released(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

"""Quality rules whose cutoffs come from mergeable quantile sketches of each language and source.

Everything here is DataFrame and SQL functions. A text is measured where it is
read. A measure is a whole number (a rate in thousandths), and its sketch is a
histogram over buckets that grow with the value: 32 to each doubling, so a
quantile is off by a 32nd of itself at most. Sketches merge by adding counts, in
any order and with the same result, so a source with a third of the rows is
summed before it is shuffled, and a retried task changes nothing. The sketch of
a source in a language is used if it holds ``MIN_GROUP`` documents; a smaller
one is told by its language's, and a small language by that of all.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import released, text_of, written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Fixed rules that come before the adaptive ones.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A sketch of fewer documents says too little of its own.
MIN_GROUP = 100
#: A cutoff stands this many spreads (between the quartiles) beyond a quartile.
REACH = 3
#: Buckets to each doubling of a value: 2 to this power.
FINE = 5
#: Measure, its least spread in thousandths, and whether low values are as odd as high ones.
MEASURES: dict[str, tuple[int, bool]] = {
    "word_rate": (500, True),  # characters to 1000 words
    "symbol_rate": (50, False),  # symbols to 1000 words
    "dup_line_rate": (200, False),  # repeated lines to 1000 lines with a word
    "repeat_rate": (100, False),  # words in repeated windows to 1000 words
    "upper_rate": (50, False),  # capitals to 1000 characters of words
}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of three that occurs twice or more in the text."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda at, j: F.least(F.coalesce(F.get(starts, j + 1) - at, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)

    def starts_of(ordered: Column) -> Column:
        def mark(x: Column, j: Column) -> Column:
            twice = x["window"].eqNullSafe(F.get(ordered, j - 1)["window"]) | x["window"].eqNullSafe(F.get(ordered, j + 1)["window"])
            return F.when(twice, x["at"])

        return F.array_sort(F.filter(F.transform(ordered, mark), lambda at: at.isNotNull()))

    def windows(w: Column) -> Column:
        each = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("window"), i.alias("at")),
        )
        return let(let(F.sort_array(each), starts_of), covered)

    return F.when(F.size(words) >= 4, let(words, windows)).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, *keep: Column | str, text: str = "text") -> DataFrame:
    """``keep`` and the measures of each row's whole text; a null text has no words."""
    raw = docs.select(*keep, text_of(text).alias("_text"))
    kept = [c for c in raw.columns if c != "_text"]
    bare = F.regexp_replace("_text", SPACE, "")
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    per = let(
        words_of(F.col("_text")),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")),
    )
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    out = raw.select(
        *kept,
        per.alias("_w"),
        by_line.alias("_l"),
        let(bare, lambda b: F.struct(F.length(b).cast("long").alias("chars"), (F.length(b) - F.length(F.regexp_replace(b, "[A-Z]+", ""))).cast("long").alias("upper"))).alias("_c"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    return out.select(
        *kept,
        F.col("_w.n_words").alias("n_words"),
        F.col("_c.chars").alias("word_chars"),
        "n_symbols",
        F.col("_l.dup").alias("n_dup_lines"),
        F.col("_w.n_repeat_words").alias("n_repeat_words"),
        F.col("_l.n").alias("n_lines"),
        F.col("_c.upper").alias("n_upper"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def rates() -> dict[str, Column]:
    """The measures in thousandths; a text without words has them as zero."""

    def rate(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.expr(f"(1000 * {part}) div {whole}")).otherwise(F.lit(0).cast("long"))

    return {
        "word_rate": rate("word_chars", "n_words"),
        "symbol_rate": rate("n_symbols", "n_words"),
        "dup_line_rate": rate("n_dup_lines", "n_lines"),
        "repeat_rate": rate("n_repeat_words", "n_words"),
        "upper_rate": rate("n_upper", "word_chars"),
    }


def bucket_of(value: Column) -> Column:
    """Bucket of a whole number: itself below 64, else its doubling and the five bits after the first."""
    return let(
        F.greatest(F.length(F.bin(value)) - (FINE + 1), F.lit(0)),
        lambda e: e.cast("long") * (1 << FINE) + F.call_function("shiftright", value, e),
    )


def bucket_low(bucket: Column) -> Column:
    """The least value of a bucket."""
    width = 1 << FINE
    e = F.greatest(F.call_function("shiftright", bucket, F.lit(FINE)) - 1, F.lit(0).cast("long")).cast("int")
    return F.call_function("shiftleft", bucket - e * width, e)


def sketches(measures: DataFrame, *by: str) -> DataFrame:
    """``by``, measure, bucket, n: one sketch for each group and measure; they merge by adding ``n``."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket_of(v).alias("bucket")) for m, v in rates().items()]))
    return measures.select(*by, cells.alias("_c")).groupBy(*by, F.col("_c.measure").alias("measure"), F.col("_c.bucket").alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *by: str) -> DataFrame:
    return sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def cutoffs(sketch: DataFrame, *by: str) -> DataFrame:
    """``by``, n and the range of each measure: its quartiles, ``REACH`` spreads further out."""
    groups = Window.partitionBy(*by, "measure")
    run = sketch.select(*by, "measure", "bucket", F.sum("n").over(groups.orderBy("bucket")).alias("upto"), F.sum("n").over(groups).alias("all"))
    quart = run.groupBy(*by, "measure").agg(
        F.max("all").alias("n"),
        F.min(F.when(4 * F.col("upto") >= F.col("all"), F.col("bucket"))).alias("b1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("all"), F.col("bucket"))).alias("b3"),
    )
    q1, q3 = bucket_low(F.col("b1")), bucket_low(F.col("b3") + 1) - 1
    least = reduce(lambda c, m: c.when(F.col("measure") == m, MEASURES[m][0]), list(MEASURES)[1:], F.when(F.col("measure") == next(iter(MEASURES)), next(iter(MEASURES.values()))[0]))
    spread = REACH * F.greatest(q3 - q1, least)
    ends = quart.select(*by, "measure", "n", (q1 - spread).alias("low"), (q3 + spread).alias("high"))
    ranges = [F.max(F.when(F.col("measure") == m, F.struct("low", "high"))).alias(m) for m in MEASURES]
    return ends.groupBy(*by).agg(F.max("n").alias("n"), *ranges)


def adaptive_cutoffs(measures: DataFrame, lang: str = "lang", source: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """``lang``, ``source`` and the ranges of the smallest sketch around them that holds ``min_group`` documents."""
    cells = written(sketches(measures, lang, source), "quality-sketches")
    own = cutoffs(cells, lang, source)
    by_lang = cutoffs(merged(cells, lang), lang)
    by_all = cutoffs(merged(cells))

    def renamed(df: DataFrame, mark: str, *keys: str) -> DataFrame:
        return df.select(*[F.col(k).alias(f"{mark}_{k}") for k in keys], F.col("n").alias(f"{mark}_n"), F.struct(*MEASURES).alias(f"{mark}_ranges"))

    wide = renamed(own, "own", lang, source).join(renamed(by_lang, "lang", lang), F.col(f"own_{lang}").eqNullSafe(F.col(f"lang_{lang}")), "left")
    wide = wide.join(F.broadcast(renamed(by_all, "all")), F.lit(True), "left")  # one row
    best = F.when(F.col("own_n") >= min_group, F.col("own_ranges")).when(F.col("lang_n") >= min_group, F.col("lang_ranges")).otherwise(F.col("all_ranges"))
    out = written(wide.select(F.col(f"own_{lang}").alias(lang), F.col(f"own_{source}").alias(source), best.alias("ranges")), "quality-cutoffs")
    released(cells)
    return out


def _judged(measures: DataFrame, cuts: DataFrame, lang: str, source: str) -> DataFrame:
    """Measures with ``base_failed`` and ``kept``. Rows of groups in which every row fails the base rules have no cutoffs."""
    cuts = cuts.select(F.col(lang).alias("_lang"), F.col(source).alias("_source"), "ranges")
    met = measures.join(cuts, F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source")), "left")
    fits = F.lit(True)
    for m, v in rates().items():
        fits &= v <= F.col(f"ranges.{m}.high")
        if MEASURES[m][1]:
            fits &= v >= F.col(f"ranges.{m}.low")
    return met.select("*", base_failed().alias("base_failed"), F.when(base_failed(), False).otherwise(fits).alias("kept")).drop("_lang", "_source", "ranges")


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row a document: its id, measures, ``base_failed`` and ``kept``.

    Cutoffs come from the documents that pass the base rules. Null languages and
    sources are groups of their own; a null or blank text has no words and fails;
    repeated rows and ids are judged each; an empty table gives an empty result.
    Columns of the input beyond the four that are read do not matter.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col("text"))
    measures = written(measured(rows, "doc_id", "lang", "source"), "quality-measures")
    return _judged(measures, adaptive_cutoffs(measures.where(~base_failed())), "lang", "source").drop("lang", "source")


def kept_documents(docs: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that pass, with all their columns; texts are measured twice in place of being written."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col("text"))
    cuts = adaptive_cutoffs(measured(rows.drop("doc"), "lang", "source").where(~base_failed()))
    return _judged(measured(rows, "doc", "lang", "source"), cuts, "lang", "source").where("kept").select("doc.*")

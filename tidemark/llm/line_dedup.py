"""Line dedup over content-defined chunks of lines, in DataFrame functions alone.

Each line has a hash; a rolling hash over the last two line hashes ends a chunk
where it is divisible by ``every``, so an insertion moves boundaries near it
only. A line of at least ``long_words`` words is a chunk by itself. Chunks of
two or more lines, and long lines, that occur more than once in the corpus are
removed but for their first document. Equal chunks are found by grouping on
their bytes and compared byte by byte once more where they are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

EVERY = 3
LONG_WORDS = 50


def line_hash(line: Column) -> Column:
    """The first 32 bits of a line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def is_long(line: Column, long_words: int) -> Column:
    """At least ``long_words`` words parted by single spaces."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) >= long_words - 1


def chunks_of(text: Column, every: int, long_words: int) -> Column:
    """``array<struct<chunk, lines, removable>>`` whose chunks joined by line feeds are the text."""
    lines = F.split(text, "\n", -1)

    def build(rows: Column) -> Column:
        n = F.size(rows)

        def ends(i: Column) -> Column:
            here, after, before = F.get(rows, i), F.get(rows, i + 1), F.get(rows, i - 1)
            rolled = (F.coalesce(before["h"], F.lit(0)) * 31 + here["h"]) % every == 0
            return (i == n - 1) | here["long"] | F.coalesce(after["long"], F.lit(False)) | rolled

        cuts = F.filter(F.sequence(F.lit(0), n - 1), ends)

        def pick(c: Column) -> Column:
            def one(end: Column, k: Column) -> Column:
                start = F.when(k == 0, F.lit(0)).otherwise(F.get(c, k - 1) + 1)
                own = F.slice(rows, start + 1, end - start + 1)
                return F.struct(F.array_join(own["line"], "\n").alias("chunk"), F.size(own).alias("lines"), ((F.size(own) > 1) | own[0]["long"]).alias("removable"))

            return F.transform(c, one)

        return F.get(F.transform(F.array(cuts), pick), 0)

    rows = F.transform(lines, lambda x: F.struct(x.alias("line"), line_hash(x).alias("h"), is_long(x, long_words).alias("long")))
    return F.get(F.transform(F.array(rows), build), 0)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY, long_words: int = LONG_WORDS) -> DataFrame:
    """``docs`` with ``text_col`` less its repeated chunks, plus ``chunks``, ``removed_chunks`` and ``removed_lines``.

    A chunk's first occurrence stays and all further ones go, in the order of
    ids, then of texts, then of places; rows without an id come last and are
    told apart by their texts. Repeated rows (equal id and text) count as one
    and stay alike. Null texts stay null, empty texts stay empty and are never
    removed. All columns are kept, whatever their names; those named as the
    added ones are replaced. An empty table gives an empty result.
    """
    added = ("chunks", "removed_chunks", "removed_lines")
    names = [c for c in docs.columns if c not in added]
    # everything that the input holds moves as one struct, so no name of it can clash
    rows = docs.select(F.struct(F.lit(0).alias("\0"), *[F.col(f"`{c}`") for c in names if c != text_col]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    body = F.coalesce("text", F.lit(""))
    chunks = chunks_of(body, every, long_words)
    own = F.when(F.col("id").isNull(), F.md5(body)).otherwise(F.hex(F.xxhash64(body))).alias("own")
    each = rows.select("id", own, F.posexplode(chunks).alias("at", "c")).where(F.col("c.removable") & (F.length(F.trim("c.chunk")) > 0))
    each = each.select("id", "own", "at", F.col("c.chunk").alias("chunk"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "own", "at")
    # Grouping by the chunk itself compares bytes; copies meet on the map side first.
    repeated = each.groupBy("chunk").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last")
    repeated = repeated.select(F.xxhash64("chunk").alias("h"), "chunk", "first")
    again = each.select("id", "own", "at", F.xxhash64("chunk").alias("h")).join(repeated, "h")
    again = again.where(~place.eqNullSafe(F.col("first"))).select("id", "own", F.struct("at", "chunk").alias("gone")).distinct()
    gone = again.groupBy(F.col("id").alias("of_id"), F.col("own").alias("of_own")).agg(F.map_from_entries(F.collect_list("gone")).alias("gone"))
    joined = rows.withColumn("own", own).join(gone, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("own") == F.col("of_own")), "left")

    def keep(all_chunks: Column) -> Column:
        left = F.filter(all_chunks, lambda c, i: ~F.coalesce(F.element_at("gone", i) == c["chunk"], F.lit(False)))
        lost = F.aggregate(all_chunks, F.lit(0), lambda a, c: a + c["lines"]) - F.aggregate(left, F.lit(0), lambda a, c: a + c["lines"])
        return F.struct(F.array_join(left["chunk"], "\n").alias("text"), F.size(all_chunks).alias("chunks"), (F.size(all_chunks) - F.size(left)).alias("removed_chunks"), lost.alias("removed_lines"))

    whole = F.struct("text", F.size(chunks).alias("chunks"), F.lit(0).alias("removed_chunks"), F.lit(0).alias("removed_lines"))
    done = joined.select("row", F.when(F.col("gone").isNull(), whole).otherwise(F.get(F.transform(F.array(chunks), keep), 0)).alias("out"))
    return done.select(*[F.col("out.text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in names], *[F.col(f"out.{c}") for c in added])


def drop_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LONG_WORDS) -> DataFrame:
    """``docs`` with ``text_col`` less every run of lines of ``least_words`` words or more that came before, plus ``run_lines``.

    From each line on, and back from each, the fewest lines that reach
    ``least_words`` words are a window; the windows inside a shared run depend
    on the run alone and cover it whole, wherever it starts. Windows meet by
    the MD5 of their lines. All occurrences but the first go, in the order of
    ids (rows without one come last and are parted by their text), then of
    lines; an occurrence that overlaps the first in its own text stays. Lines
    without words do not count and go with the lines around them. Null texts
    stay null; repeated rows lose or keep the same lines, as one text of one id;
    an empty table gives an empty result; all columns are kept, one named as the
    added one is replaced.
    """
    names = [c for c in docs.columns if c != "run_lines"]
    body = docs.select(F.struct(F.lit(0).alias("\0"), *[F.col(f"`{c}`") for c in names if c != text_col]).alias("row"), F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    text = F.coalesce("text", F.lit(""))
    body = body.withColumn("__h", F.md5(text))
    each = body.select("__id", "__h", F.posexplode(F.split(text, "\n", -1)).alias("i", "line"))
    each = each.select("__id", "__h", "i", F.size(F.array_remove(F.split("line", r"[ \t\r]+"), "")).cast("long").alias("words"), F.md5("line").alias("d")).where("words > 0")
    each = each.groupBy("__id", "__h", "i").agg(F.first("words").alias("words"), F.first("d").alias("d"))  # a repeated row counts once
    own = Window.partitionBy("__id", "__h")
    each = each.withColumn("e", F.sum("words").over(own.orderBy("i"))).withColumn("s", F.col("e") - F.col("words"))
    on, back = own.orderBy("s").rangeBetween(0, least_words - 1), own.orderBy("e").rangeBetween(1 - least_words, 0)
    seen = each
    for name, frame in (("on", on), ("back", back)):
        made = F.struct(F.min("i").over(frame).alias("at"), F.max("i").over(frame).alias("end"), F.md5(F.array_join(F.collect_list("d").over(frame), "")).alias("key"))
        seen = seen.withColumn(name, F.when(F.sum("words").over(frame) >= least_words, made))
    seen = seen.select("__id", "__h", F.explode(F.array_compact(F.array_distinct(F.array("on", "back")))).alias("w")).select("__id", "__h", "w.*")
    seen = written(seen, "line-windows")
    place = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__h").alias("h"), F.col("at"), F.col("end"))
    first = seen.groupBy("key").agg(F.min(place).alias("f"), F.max(place).alias("l")).where("f != l").select("key", "f")
    same = F.col("__id").eqNullSafe(F.col("f.id")) & (F.col("__h") == F.col("f.h"))
    gone = seen.join(first, "key").where(~same | (F.col("at") > F.col("f.end"))).select("__id", "__h", "at", "end").distinct()
    # windows that touch are one range
    before = F.max("end").over(own.orderBy("at", "end").rowsBetween(Window.unboundedPreceding, -1))
    gone = gone.withColumn("new", F.coalesce(F.col("at") > before + 1, F.lit(True)).cast("int"))
    gone = gone.withColumn("part", F.sum("new").over(own.orderBy("at", "end").rowsBetween(Window.unboundedPreceding, 0)))
    gone = gone.groupBy("__id", "__h", "part").agg(F.min("at").alias("at"), F.max("end").alias("end"))
    gone = gone.groupBy("__id", "__h").agg(F.collect_list(F.struct("at", "end")).alias("__gone"), F.sum(F.col("end") - F.col("at") + 1).cast("int").alias("__n"))
    gone = gone.select(F.col("__id").alias("__owner"), F.col("__h").alias("__of"), "__gone", "__n")
    joined = body.join(gone, F.col("__id").eqNullSafe(F.col("__owner")) & (F.col("__h") == F.col("__of")), "left")
    left = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.exists("__gone", lambda g: (g["at"] <= i) & (i <= g["end"])))
    cut = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return joined.select(*[cut.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in names], F.coalesce("__n", F.lit(0)).alias("run_lines"))

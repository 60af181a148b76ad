"""Byte-level BPE encoding and decoding.

Encoding splits each text by the vocabulary's pattern, folds the ranked merges
over the ids of the corpus's distinct pieces with higher-order functions and a
literal table of the pairs that join, and puts the ids back in place; decoding
concatenates the binary pieces of the ids.

Pieces go to where they are needed by block: a block is a run of documents that
one task reads (tens of MB of text, or one long document), held as numbers while
its batches of a few MB stream by. The distinct pieces of
all blocks meet by their bytes, the first of each is folded and the block gets
back one code book. Of the texts, only packed piece numbers are shuffled, and no
broadcast grows with the data.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import give_back, lean, text_of

BUCKETS = 1 << 10
#: Longer pieces (runs of punctuation or letters) are merged with a heap, as folding them would be quadratic.
FOLD_BYTES = 48
#: Bits of a token's id, and of a byte's place in a piece that is folded, in the numbers that a fold holds.
ID_BITS, PLACE_BITS = 18, 6
BLOCK_PIECES = 1 << 23


@lru_cache(maxsize=4)
def library_class(name: str) -> str:
    """All code points of a class as the tokenizer's library has it, asked of the library itself."""
    import tiktoken

    probe = tiktoken.Encoding("probe", pat_str=rf"\p{{{name}}}", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    found = lambda a: bytes(probe.encode_ordinary("".join(chr(c) for c in range(a, a + 4096) if not 0xD800 <= c < 0xE000))).decode()
    return "".join(map(found, range(0, 0x110000, 4096)))


_patterns: dict[str, tuple[str, str | None]] = {}


def _patterns_of(spark: SparkSession) -> tuple[str, str | None]:
    """The pattern for any text, and the class of the letters and digits that Java's tables lack (null if they lack none)."""
    java = spark._jvm.java.lang.System.getProperty("java.version")
    if java not in _patterns:
        row = spark.createDataFrame([(library_class("L"), library_class("N"))], "l string, n string")
        lacks = row.select(F.regexp_replace("l", r"\p{L}+", ""), F.regexp_replace("n", r"\p{N}+", "")).first()
        letters, digits = (_ranges(sorted(map(ord, x))) for x in lacks)
        also = lambda r: rf"[\x{{80}}-\x{{10FFFF}}&&[{r}]]" if r else ""  # noqa: E731  the cheap range first
        other = rf"[\P{{IsWhite_Space}}&&\P{{L}}&&\P{{N}}&&[^{letters}{digits}]]" if letters or digits else r"[^\p{IsWhite_Space}\p{L}\p{N}]"
        least = min(map(ord, "".join(lacks)), default=0)
        new = rf"[\x{{{least:X}}}-\x{{10FFFF}}&&[{letters}{digits}]]" if letters or digits else None
        _patterns[java] = PATTERN.replace(r"[\p{L}]", rf"[\p{{L}}{also(letters)}]").replace(r"[\p{N}]", rf"[\p{{N}}{also(digits)}]").replace(r"[^\p{IsWhite_Space}\p{L}\p{N}]", other), new
    return _patterns[java]


#: The vocabulary's pattern with ``\s`` spelled as the property it means in the library; words come before the endings
#: with an apostrophe, as the two never begin alike and most pieces are words.
PATTERN = r" ?[\p{L}]+| ?[\p{N}]+|'(?:[stmd]|re|ve|ll)| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"


def split_pattern(spark: SparkSession) -> str:
    """The vocabulary's pattern for Java, whose tables lack the letters and digits that Unicode added last.

    Those are found once a process, by one row, and written out as ranges.
    """
    return _patterns_of(spark)[0]


def pieces_of(spark: SparkSession, text: Column) -> Column:
    """A text's pieces; only texts that hold a new letter or digit pay for the ranges."""
    full, new = _patterns_of(spark)
    split = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(new), split(full)).otherwise(split(PATTERN)) if new else split(PATTERN)


def _ranges(points: list[int]) -> str:
    """Ascending code points as the inside of a character class."""
    runs: list[list[int]] = []
    for c in points:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a base64 piece and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def _buckets(path: str) -> list[dict[str, list]]:
    """The tokens that merging would not give as one, in small buckets by checksum, each with its pieces (base64) and their ranks."""
    ranks = read_ranks(path)
    known = {bytes([b]): -1 for b in range(256)} | ranks
    table: list[dict[str, list]] = [{"k": [], "r": []} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        if heap_merges(piece, known) == [rank]:
            continue
        own = table[zlib.crc32(piece) % BUCKETS]
        own["k"].append(base64.b64encode(piece).decode())
        own["r"].append(rank)
    return table


@lru_cache(maxsize=4)
def pair_table(path: str) -> dict[str, list[int] | int]:
    """Which pairs of ids join to a token, in one look: ``cells[starts[a] + b]`` is ``a << ID_BITS | rank of the joined piece``.

    The rows of all first ids lie in each other's gaps, so a cell of another id
    says that a and b do not join. ``bytes`` has the id of each byte; one that is
    no token has an id behind all ranks. The id behind those, ``edge``, joins with none.
    """
    import numpy as np

    ranks = read_ranks(path)
    behind = max(ranks.values()) + 1
    edge = behind + 256
    if (edge + 1) >> ID_BITS:
        raise ValueError(f"ranks must stay below {(1 << ID_BITS) - 257}")
    id_of = {bytes([b]): behind + b for b in range(256)} | ranks
    cuts = ((piece[:k], piece[k:], rank) for piece, rank in ranks.items() for k in range(1, len(piece)))
    rows: dict[int, list[tuple[int, int]]] = {}
    for a, b, rank in cuts:
        if a in id_of and b in id_of:
            rows.setdefault(id_of[a], []).append((id_of[b], rank))
    starts, at, few = np.zeros(edge + 1, np.int64), 0, False
    more = lambda: (np.zeros(256 + 2 * edge, bool), np.full(256 + 2 * edge, (edge + 1) << ID_BITS))
    taken, cells = more()
    for a in sorted(rows, key=lambda a: -len(rows[a])):  # the widest first, from where the one before fitted
        b, rank = np.array(rows[a]).T
        if not few and len(b) <= 8:
            at, few = 0, True
        while True:
            if at + 256 + edge > len(taken):
                taken, cells = (np.concatenate(x) for x in zip((taken, cells), more()))
            fits = np.flatnonzero(~taken[np.arange(at, at + 256)[:, None] + b].any(1))
            if len(fits):
                break
            at += 256
        at += fits[0]
        starts[a] = at
        taken[at + b] = True
        cells[at + b] = a << ID_BITS | rank
    cells = cells[: starts.max() + edge + 1]
    # where id 0 does not look, an empty cell may be 0, which is one object in Java
    cells[(cells == (edge + 1) << ID_BITS) & (np.abs(2 * (np.arange(len(cells)) - starts[0]) - edge) > edge)] = 0
    return {"cells": cells.tolist(), "starts": starts.tolist(), "bytes": [id_of[bytes([b])] for b in range(256)], "edge": edge}


def rank_map(path: str) -> Column:
    """The ranks of a file as one literal: by pairs of ids, and by pieces where pairs do not lead to them."""
    ranks = json.dumps({"pieces": _buckets(path)} | pair_table(path), separators=(",", ":"))
    return F.from_json(F.lit(ranks), "pieces array<struct<k:array<binary>,r:array<int>>>, cells array<long>, starts array<long>, bytes array<long>, edge long")


def rank_of(ranks: Column, piece: Column) -> Column:
    """Rank of a binary piece that is a token and would not be merged to it, else null."""
    bucket = F.get(ranks["pieces"], (F.crc32(piece) % BUCKETS).cast("int"))
    return F.get(F.transform(F.array(bucket), lambda b: F.get(b["r"], (F.array_position(b["k"], piece) - 1).cast("int"))), 0)


def fold_merges(piece: Column, path: str) -> Column:
    """Ids of one binary piece: while an adjacent pair is a token, the pair of least rank merges, the first of equals."""
    # The literal is bound to a lambda variable, so the plan holds it once.
    return F.get(F.transform(F.array(rank_map(path)), lambda bound: _fold(piece, bound)), 0)


def _fold(piece: Column, ranks: Column) -> Column:
    """A part is one number: the rank that it and the next part would have as one, then its place, then its id.

    So the least part is the first of the pairs of least rank, and that rank is the id of the two as one. The
    parts stand between two edges. Ahead of all stands a number with a bit for each place where a part begins,
    which tells how many parts stand before a place (``array_position`` would throw where it finds).
    """
    none = F.lit(1 << ID_BITS)
    own = (1 << (PLACE_BITS + ID_BITS)) - 1  # place and id
    rank = lambda x: F.shiftright(x, PLACE_BITS + ID_BITS)
    id_of = lambda x: x.bitwiseAND(F.lit((1 << ID_BITS) - 1))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x, ID_BITS).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int"))

    def part(place_and_id: Column, a: Column, b: Column) -> Column:
        # what another row's cell leaves is more than any rank
        joined = ranks["cells"][ranks["starts"][a] + b].bitwiseXOR(F.shiftleft(a, ID_BITS))
        return F.shiftleft(joined, PLACE_BITS + ID_BITS).bitwiseOR(place_and_id)

    chars = F.split(F.decode(piece, "ISO-8859-1"), "")
    ids = F.concat(F.array(ranks["edge"]), F.transform(chars, lambda c: F.get(ranks["bytes"], F.ascii(c))), F.array(ranks["edge"]))
    paired = lambda x: F.transform(x, lambda a, i: part(F.shiftleft(i.cast("long"), ID_BITS).bitwiseOR(a), a, F.coalesce(F.get(x, i + 1), ranks["edge"])))
    start = F.concat(F.array(F.lit(2**63 - 1)), F.get(F.transform(F.array(ids), paired), 0))

    def step(parts: Column, _: Column) -> Column:
        def merged(at: Column) -> Column:
            before, low, gone, behind = (F.get(parts, at + k) for k in (-1, 0, 1, 2))
            begins = F.get(parts, 0).bitwiseXOR(bit(gone))
            left = part(before.bitwiseAND(F.lit(own)), id_of(before), rank(low))
            both = part(low.bitwiseAND(F.lit(own >> ID_BITS << ID_BITS)).bitwiseOR(rank(low)), rank(low), id_of(behind))
            joined = F.concat(F.array(begins), F.slice(parts, F.lit(2), at - 2), F.array(left, both), F.slice(parts, at + 3, F.lit(FOLD_BYTES)))
            return F.when(rank(low) >= none, parts).otherwise(joined)

        at = F.bit_count(F.get(parts, 0).bitwiseAND(bit(F.array_min(parts)) - 1)) + 1
        # transform over the one position binds it, so it is found once
        return F.get(F.transform(F.array(at), merged), 0)

    n = F.octet_length(piece)
    steps = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    folded = F.aggregate(steps, start, step, lambda parts: F.transform(F.slice(parts, F.lit(3), F.size(parts) - 3), lambda x: id_of(x).cast("int")))
    return F.coalesce(F.transform(F.array(rank_of(ranks, piece)), lambda x: F.when(x.isNotNull(), F.array(x)))[0], folded)


def heap_merges(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long piece: a heap of pairs over a linked list."""
    import heapq

    n = len(piece)
    start, nxt, prv = list(range(n)), [*range(1, n + 1)], [*range(-1, n - 1)]
    end, alive = [*range(1, n + 1)], [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or nxt[i] >= n or end[nxt[i]] != stop:
            continue
        j = nxt[i]
        alive[j], end[i], nxt[i] = False, stop, nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        for a in (prv[i], i):
            if a >= 0 and nxt[a] < n and (r := ranks.get(piece[start[a] : end[nxt[a]]])) is not None:
                heapq.heappush(heap, (r, a, end[nxt[a]]))
    return [ranks[piece[start[i] : end[i]]] for i in range(n) if alive[i]]


def _blocks(path: str, payload: bool):
    """Documents to blocks, the same ones at each call.

    With ``payload``: ids, pieces a document, packed piece numbers and the codes
    of long pieces; else the distinct short pieces, null where one is long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: list[tuple[pa.Array, pa.DictionaryArray, np.ndarray]] = []  # ids, coded pieces, pieces a document
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        def block() -> pa.RecordBatch:
            own = pa.concat_arrays([h[0] for h in held])
            coded = pa.chunked_array([h[1] for h in held]).unify_dictionaries()
            lens = np.concatenate([h[2] for h in held])
            held.clear()
            at = np.concatenate([np.asarray(c.indices) for c in coded.chunks]).astype("<i4", copy=False)
            distinct = coded.chunk(0).dictionary
            del coded
            name = hashlib.blake2b(at, digest_size=8)
            name.update(lens.tobytes() + repr(own.to_pylist()).encode())
            key = pa.array([int.from_bytes(name.digest(), "little", signed=True)], pa.int64())
            long = pc.greater(pc.binary_length(distinct), FOLD_BYTES)
            if not payload:
                return pa.RecordBatch.from_arrays([key, one(pc.if_else(long, pa.scalar(None, distinct.type), distinct))], ["block", "words"])
            known = read_ranks(path)
            no = np.flatnonzero(np.asarray(long))
            raw = [x.as_py().encode() for x in distinct.take(pa.array(no))]
            ids_of_long = pa.array([[known[x]] if x in known else heap_merges(x, known) for x in raw], pa.list_(pa.int32()))
            n, n_words = len(at), len(distinct)
            # byte planes of small numbers compress to about a byte and a half a piece
            planes = np.ascontiguousarray(at.view(np.uint8).reshape(-1, 4).T)
            del at
            packed = pa.compress(pa.py_buffer(planes), codec="zstd", asbytes=True)
            del planes
            cells = [key, one(own), pa.array([lens.tobytes()], pa.binary()), pa.array([n], pa.int64()), pa.array([packed], pa.binary()), pa.array([n_words], pa.int32()), one(pa.array(no, pa.int32())), one(ids_of_long)]
            return pa.RecordBatch.from_arrays(cells, ["block", "ids", "lens", "n_pieces", "at", "n_words", "long_no", "long_ids"])

        for batch in batches:
            words = batch.column("pieces")
            held.append((batch.column("id"), pc.dictionary_encode(words.flatten()), np.asarray(pc.list_value_length(words)).astype("<i4")))
            if sum(len(h[1]) for h in held) >= BLOCK_PIECES:
                yield block()
        if held:
            yield block()

    return run


def _assemble(path: str):
    """Blocks and their code books to one row a document: ids as packed integers and the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        ranks = read_ranks(path)
        size = max(ranks.values()) + 1
        texts = [b""] * size
        for piece, rank in ranks.items():
            texts[rank] = piece
        piece_len = np.array([len(x) for x in texts], np.int64)
        piece_at = np.concatenate([[0], np.cumsum(piece_len)[:-1]])
        piece_bytes = np.frombuffer(b"".join(texts), np.uint8)

        def spread(lengths):
            """0..n-1 for each n, one after another."""
            total = int(lengths.sum())
            return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)

        for batch in batches:
            for i in range(batch.num_rows):
                lens = np.frombuffer(batch.column("lens")[i].as_py(), "<i4")
                n_pieces, n_words = batch.column("n_pieces")[i].as_py(), batch.column("n_words")[i].as_py()
                planes = pa.decompress(batch.column("at")[i].as_py(), decompressed_size=4 * n_pieces, codec="zstd", asbytes=True)
                at = np.frombuffer(np.frombuffer(planes, np.uint8).reshape(4, -1).T.tobytes(), "<i4")
                del planes
                code_len, code_at = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64)
                long_no, long_ids = np.asarray(batch.column("long_no")[i].values), batch.column("long_ids")[i].values
                code_len[long_no] = np.asarray(pc.list_value_length(long_ids))
                code_at[long_no] = np.cumsum(code_len[long_no]) - code_len[long_no]
                codes = np.asarray(long_ids.flatten()).astype(np.int64)
                no, book = (batch.column(c)[i].values for c in ("book_no", "book_ids"))
                if n_words - len(long_no) != (0 if book is None else len(book)):
                    raise ValueError("a block came without its code book: the input gave its rows in another order when it was read again")
                if book is not None and len(book):
                    offsets = np.frombuffer(book.buffers()[1], np.int32)[book.offset : book.offset + len(book) + 1].astype(np.int64)
                    raw = np.frombuffer(book.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
                    no = np.asarray(no)
                    code_len[no] = np.diff(offsets) // 3
                    code_at[no] = np.cumsum(code_len[no]) - code_len[no] + len(codes)
                    codes = np.concatenate([codes, raw.reshape(-1, 3).astype(np.int64) @ np.array([1 << 16, 1 << 8, 1])])
                doc_ends = np.cumsum(lens)
                n_tokens, id_hash, text_hash = [], [], []
                for doc, end in enumerate(doc_ends):
                    own = at[end - lens[doc] : end]
                    k = code_len[own]
                    ids = codes[np.repeat(code_at[own], k) + spread(k)]
                    n = piece_len[ids]
                    decoded = piece_bytes[np.repeat(piece_at[ids], n) + spread(n)]
                    n_tokens.append(len(ids))
                    id_hash.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    text_hash.append(hashlib.sha256(decoded.tobytes()).hexdigest())
                ids = batch.column("ids")[i].values
                yield pa.RecordBatch.from_arrays([ids, pa.array(n_tokens, pa.int64()), pa.array(id_hash), pa.array(text_hash)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """``block, no, ids`` of ``words(block, no, word)``: the rows of a word meet, the first is folded and the others take its ids, three bytes each."""
    alike = Window.partitionBy("word")
    first = F.row_number().over(alike.orderBy("block", "no")) == 1
    ids = fold_merges(F.col("word").cast("binary"), path)
    folded = F.when(F.col("first"), F.unhex(F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i), 6, "0")), "")))
    coded = words.withColumn("first", first).withColumn("ids", folded)
    return coded.select("block", "no", F.first("ids", ignorenulls=True).over(alike).alias("ids"))


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256`` of every row.

    Null and empty texts have no ids. Repeated rows and null ids are kept as
    rows; other columns are ignored, whatever their names; an empty table gives
    an empty result. Text is never cut. Letters and digits are those of the
    tokenizer's library. The input is read twice; one that gives its rows in
    another order the second time (a shuffle that nothing has stored) fails.
    """
    path = path or default_ranks()
    id_type = docs.schema[id_col].dataType.simpleString()
    pieces = pieces_of(docs.sparkSession, text_of(text_col)).alias("pieces")
    split = docs.select(F.col(id_col).alias("id"), pieces)
    words = split.mapInArrow(lean(_blocks(path, False)), "block long, words array<string>")
    words = words.select("block", F.posexplode("words").alias("no", "word")).where("word is not null")
    book = encode_words(words, path).groupBy("block").agg(F.collect_list("no").alias("book_no"), F.collect_list("ids").alias("book_ids"))  # neither is ever null, so they stand side by side
    whole = split.mapInArrow(lean(_blocks(path, True)), f"block long, ids array<{id_type}>, lens binary, n_pieces long, at binary, n_words int, long_no array<int>, long_ids array<array<int>>")
    out = whole.join(book, "block", "left").mapInArrow(lean(_assemble(path)), f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    give_back()  # what the driver took to build the rank map
    return out.withColumnRenamed("id", id_col)

"""Byte-level BPE: encoding by folds of ranked merges over the bytes of distinct words, decoding by concatenated pieces.

A text is cut into words by the vocabulary's pattern. Every piece of the vocabulary over a byte comes from one merge: the
pair that its own bytes end in, if the pair of least rank is merged as long as there is one. A word begins as the string of
its bytes, `(61)(62)(63)`; the merges of all pieces that stand in it are sorted by rank and folded over that string, each
replacing its pair wherever it stands. The ranks are a literal of the plan: maps from byte string to rank and pair, dealt by
CRC-32 into an array, so that a look-up meets a few entries. All of it is Spark's higher-order functions.

A fold in rank order does what the tokenizer's library does (the leftmost pair of least rank first, again and again) if no
merge gives rise to a pair of lower rank than its own. Were that to happen in a word, it would happen in the piece that the
lower pair makes, as nothing was merged over that piece's ends; so `Vocabulary` tries it on its pieces.

Words are counted over the whole table, and the most frequent ones (`DICTIONARY` of them at most, whatever the table's
size) are encoded once and broadcast. What a document holds besides is encoded with the document, each distinct word once.
The dictionary saves time and decides nothing: no word of the texts is shuffled but for the counts.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from twinspark.sources.written import materialize

#: Words that are encoded once for the whole table, and bytes of the longest of them.
DICTIONARY = 1 << 20
DICTIONARY_BYTES = 64
#: Longer words (in bytes) are merged by a heap, as each merge of a fold goes through the whole word.
FOLD_BYTES = 1024
#: Digits of a rank in the literal.
DIGITS = 7
#: Maps that the ranks are dealt into; a power of two.
MAPS = 1 << 15
#: Steps of the histogram of counts to a doubling.
STEPS = 8
#: Documents of an Arrow batch that leaves a task at once.
OUT_ROWS = 1024


class Vocabulary:
    """Byte strings with ranks, and the pattern that cuts texts into words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if sorted(ranks.values()) != list(range(len(ranks))) or any(bytes([i]) not in ranks for i in range(256)):
            raise ValueError("ranks must be 0, 1, ... and hold every single byte")
        self.ranks, self.pattern = ranks, pattern
        self.pieces = sorted(ranks, key=ranks.get)
        self.pairs = {p: _last_pair(ranks, p) for p in self.pieces if len(p) > 1}
        self.longest = max(map(len, ranks))

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """From a file with a line `base64 rank` for each byte string."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def literal(self) -> Column:
        """The ranks as array<map<string, string>>, a constant that the optimizer evaluates once: for a byte string its
        rank in `DIGITS` digits and the pair that makes it."""
        maps: list[dict[str, str]] = [{} for _ in range(MAPS)]
        for piece, rank in self.ranks.items():
            key = piece.hex().upper()
            maps[zlib.crc32(key.encode()) % MAPS][key] = f"{rank:0{DIGITS}}" + "".join(f"({x.hex().upper()})" for x in self.pairs.get(piece, ()))
        return F.from_json(F.lit(json.dumps(maps, separators=(",", ":"))), "array<map<string,string>>")

    def java_pattern(self) -> str:
        """The pattern for Java's regular expressions: white space as in Unicode, and letters and numbers as the tokenizer's
        library knows them, since a Java release may know a younger or older Unicode."""
        found = "(?U)" + self.pattern
        for kind in ("L", "N"):
            found = found.replace(rf"\p{{{kind}}}", _java_class(kind))
        return found


def public_vocabulary() -> Vocabulary:
    """The byte-level vocabulary of the installed tokenizer files."""
    import public_tokenizers

    return Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@lru_cache
def _java_class(kind: str) -> str:
    """A class of Java that holds what the tokenizer's library calls \\p{kind}. Java's own class comes first; what it lacks is
    looked up in the ranges above Greek, which other characters of common texts don't reach."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    tell = tiktoken.Encoding(kind, pat_str=rf"\p{{{kind}}}", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    codes = np.array(sorted({ord(c) for c in bytes(tell.encode_ordinary(every)).decode()} - set(range(0x370))))
    ends = np.flatnonzero(np.diff(codes) > 1)
    ranges = zip(codes[np.append(0, ends + 1)], codes[np.append(ends, len(codes) - 1)])
    listed = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)
    return rf"[\p{{{kind}}}[\x{{370}}-\x{{10FFFF}}&&[{listed}]]]"


def _known(maps: Column, piece: Column) -> Column:
    """Rank and pair of a byte string, whose digits are given as binary; null if it is no piece."""
    return F.try_element_at(F.get(maps, F.crc32(piece).bitwiseAND(MAPS - 1).cast("int")), piece.cast("string"))


def _one(value: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _merged(maps: Column, digits: Column, longest: int) -> Column:
    """Ids of a word given as hexadecimal digits, as binary (places in a string are counted from its start each time)."""
    size = F.length(digits)
    rank = lambda known: F.substring(known, 1, DIGITS).cast("int")
    # the merges of all pieces of two bytes and more in the word, by rank; a word of one byte is a piece and doesn't come here
    ends = lambda i: F.sequence(F.lit(4), F.least(size - i + 1, F.lit(2 * longest)), F.lit(2))
    parts_of = lambda i: F.transform(ends(i), lambda n: F.substring(digits, i, n))
    within = F.transform(F.sequence(F.lit(1), size - 3, F.lit(2)), lambda i: F.transform(parts_of(i), lambda piece: _known(maps, piece)))
    merges = F.array_sort(F.array_compact(F.flatten(within)))
    start = F.regexp_replace(digits.cast("string"), "(..)", "($1)")

    def merge(parts: Column, known: Column) -> Column:
        pair = F.substring(known, F.lit(DIGITS + 1), F.length(known))
        return F.replace(parts, pair, F.replace(pair, F.lit(")("), F.lit("")))

    def ids(parts: Column) -> Column:
        return F.transform(F.regexp_extract_all(parts, F.lit("[0-9A-F]+"), F.lit(0)), lambda p: rank(_known(maps, p.cast("binary"))))

    whole = lambda known: F.when(known.isNotNull(), F.array(rank(known))).otherwise(F.aggregate(merges, start, merge, ids))
    return _one(_known(maps, digits), whole)


def encoded_words(words: Column, vocabulary: Vocabulary) -> Column:
    """array<array<int>>: the ids of each word of an array; null for words over `FOLD_BYTES`."""
    ids = lambda maps, w: F.when(F.octet_length(w) <= FOLD_BYTES, _one(F.hex(F.encode(w, "UTF-8")).cast("binary"), lambda h: _merged(maps, h, vocabulary.longest)))
    return _one(vocabulary.literal(), lambda maps: F.transform(words, lambda w: ids(maps, w)))


def _last_pair(ranks: dict[bytes, int], piece: bytes) -> tuple[bytes, bytes]:
    """The pair that is merged last as a piece's bytes are merged; an error if they don't end in the piece by rising ranks."""
    parts, last = [piece[i : i + 1] for i in range(len(piece))], -1
    while len(parts) > 2:
        rank, at = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=(-1, 0))
        if rank < last:
            break
        parts[at : at + 2], last = [parts[at] + parts[at + 1]], rank
    if len(parts) != 2 or ranks[piece] < last:
        raise ValueError(f"ranks are no ranks of merges: {piece!r} doesn't come from its bytes by rising ranks")
    return parts[0], parts[1]


def by_heap(ranks: dict[bytes, int], word: bytes) -> list[int]:
    """Ids of a long word: the pair of least rank, the leftmost of these, is merged as long as there is one."""
    end = len(word)
    after, before = list(range(1, end + 1)), list(range(-1, end - 1))  # of the piece that starts here
    piece = [word[i : i + 1] for i in range(end)]
    heap = [(r, i) for i in range(end - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if not piece[i] or j >= end or ranks.get(piece[i] + piece[j]) != r:
            continue  # what stood here has been merged
        piece[i], piece[j], after[i] = piece[i] + piece[j], b"", after[j]
        if after[i] < end:
            before[after[i]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < end and (r := ranks.get(piece[a] + piece[after[a]])) is not None:
                heapq.heappush(heap, (r, a))
    return [ranks[p] for p in piece if p]


def _frequent(words: DataFrame, vocabulary: Vocabulary, most: int) -> tuple[pa.Array, pa.Array]:
    """About the `most` most frequent words that recur, and their ids."""
    counts = words.where(F.octet_length("word") <= DICTIONARY_BYTES).groupBy("word").count().where("count > 1")
    level = F.floor(F.log2("count") * STEPS)
    counts = materialize(counts.withColumn("level", level), "words")
    left, least, share = most, 0, 0.0  # words of `least` and more are taken, of the level below a share by hash
    for r in counts.groupBy("level").count().orderBy(F.desc("level")).collect():  # some hundred levels at most
        if r["count"] > left:
            least, share = r["level"] + 1, left / r["count"]
            break
        left -= r["count"]
    drawn = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20))
    taken = counts.where((F.col("level") >= least) | ((F.col("level") == least - 1) & drawn))
    taken = taken.repartition(F.xxhash64("word") % (4 * words.sparkSession.sparkContext.defaultParallelism))  # a few words would otherwise stand in one task
    table = taken.select("word", F.get(encoded_words(F.array("word"), vocabulary), F.lit(0)).alias("ids")).toArrow().combine_chunks()
    if not table.num_rows:
        return pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))
    return table["word"].combine_chunks().cast(pa.string()), table["ids"].combine_chunks().cast(pa.list_(pa.int32()))


def encode(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", packed: bool = False, decoded: bool = False, most: int = DICTIONARY) -> DataFrame:
    """`id_col` and ids, array<int>: each text's tokens, as the tokenizer's library gives them without special tokens.

    With `packed`, ids is binary: little-endian unsigned 32-bit integers. With `decoded` there is also bytes, what `decode`
    makes of the ids, without another pass over them. Null and empty texts have no ids; whole texts are
    encoded, however long (words over `FOLD_BYTES` bytes by a heap instead of a fold); repeated rows and null ids are each
    answered, an empty table with none. Other columns aren't read.
    """
    spark = df.sparkSession
    cut = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(vocabulary.java_pattern()), F.lit(0))
    texts = df.select(F.col(id_col).alias("id"), cut.alias("pieces"))
    words, ids = _frequent(texts.select(F.explode("pieces").alias("word")), vocabulary, most)
    known, coded, pieces = (spark.sparkContext.broadcast(x) for x in (words, ids, vocabulary.pieces))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each word its place in the dictionary, or -1 - k for the k-th of the document's other words."""
        for b in batches:
            lists = b.column(1)
            starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            values = lists.flatten()
            at = pc.index_in(values, value_set=known.value).fill_null(-1).to_numpy(zero_copy_only=False).copy()
            missed = np.flatnonzero(at < 0)
            rare, rare_at = values.take(pa.array(missed)).dictionary_encode(), np.zeros(len(starts), np.int64)
            if len(missed):
                doc = np.searchsorted(starts, missed, side="right") - 1
                pair = doc * len(rare.dictionary) + rare.indices.to_numpy()
                own, place = np.unique(pair, return_inverse=True)
                rare_at = np.searchsorted(own, np.arange(len(starts)) * len(rare.dictionary))
                at[missed] = -1 - (place - rare_at[doc])
                others = rare.dictionary.take(pa.array(own % len(rare.dictionary)))
            else:
                others = pa.array([], pa.string())
            out = [b.column(0), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(at, pa.int32())), pa.ListArray.from_arrays(pa.array(rare_at, pa.int32()), others.cast(pa.string()))]
            yield pa.RecordBatch.from_arrays(out, ["id", "at", "others"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ids of the words, one after the other."""
        table, ranks = pa.array(pieces.value, pa.binary()), None
        for whole in batches:
            for first in range(0, whole.num_rows, OUT_ROWS):
                b = whole.slice(first, OUT_ROWS)
                at, others, own = b.column(1), b.column(2), b.column(3)
                starts = at.offsets.to_numpy() - at.offsets[0].as_py()
                place, doc = at.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(b.num_rows), np.diff(starts))
                rare_at = own.offsets.to_numpy() - own.offsets[0].as_py()
                folded = own.flatten()
                if folded.null_count:
                    ranks = ranks or {p: i for i, p in enumerate(pieces.value)}
                    long = zip(folded.is_null().to_pylist(), others.flatten(), folded)
                    folded = pa.array([by_heap(ranks, w.as_py().encode()) if null else x.as_py() for null, w, x in long], pa.list_(pa.int32()))
                both = pa.concat_arrays([coded.value, folded.cast(pa.list_(pa.int32()))])
                picked = both.take(pa.array(np.where(place >= 0, place, len(coded.value) + rare_at[doc] - 1 - place)))
                tokens = picked.flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False)
                ends = (picked.offsets.to_numpy() - picked.offsets[0].as_py())[starts]
                if packed:
                    out = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(tokens)])
                else:
                    out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens, pa.int32()))
                joined = [_concatenated(table, tokens, ends)] if decoded else []
                yield pa.RecordBatch.from_arrays([b.column(0), out, *joined], ["id", "ids", "bytes"][: 2 + len(joined)])

    kind = texts.schema["id"].dataType.simpleString()
    looked = texts.mapInArrow(look, f"id {kind}, at array<int>, others array<string>")
    folded = looked.select("id", "at", "others", encoded_words(F.col("others"), vocabulary).alias("own"))
    found = folded.mapInArrow(put, f"id {kind}, ids {'binary' if packed else 'array<int>'}{', bytes binary' if decoded else ''}")
    return found.withColumnRenamed("id", id_col)


def _concatenated(table: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The pieces of ids from each of `ends` to the next, one after the other: what `take` has put into one buffer."""
    if not len(ids):
        return pa.array([b""] * (len(ends) - 1), pa.binary())
    taken = table.take(pa.array(ids, pa.int64()))
    at = np.frombuffer(taken.buffers()[1], np.int32)[ends]
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(at.copy()), taken.buffers()[2]])


def decode(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out_col: str = "bytes") -> DataFrame:
    """All columns, and `out_col`, binary: the pieces of the ids (an array, or packed as `encode` does) one after the other.

    Null for null, empty for no ids; an id that the vocabulary doesn't have is an error. `out_col` may not be a column yet.
    """
    packed = df.schema[ids_col].dataType.simpleString() == "binary"
    rows = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), df[f"`{ids_col}`"].alias("ids"))  # whatever the columns are called
    pieces = df.sparkSession.sparkContext.broadcast(vocabulary.pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(pieces.value, pa.binary())
        for whole in batches:
            for first in range(0, max(1, whole.num_rows), OUT_ROWS):
                b = whole.slice(first, OUT_ROWS)
                given = b.column(1)
                if packed:
                    data = [x or b"" for x in given.to_pylist()]
                    ids, counts = np.frombuffer(b"".join(data), "<u4"), [len(x) // 4 for x in data]
                else:
                    ids, counts = given.flatten().to_numpy(zero_copy_only=False), given.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                out = _concatenated(table, ids, np.append(0, np.cumsum(counts)).astype(np.int64))
                if given.null_count:
                    out = pc.if_else(given.is_valid(), out, pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([b.column(0), out], ["row", "bytes"])

    schema = StructType([rows.schema["row"], StructField("bytes", BinaryType())])
    return rows.mapInArrow(run, schema).select("row.*", F.col("bytes").alias(out_col))

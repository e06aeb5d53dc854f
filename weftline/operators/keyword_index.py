"""An index of texts for keyword search: which texts hold which runs of two and three characters.

A text that contains a word contains all of the word's runs of three characters (of two, for a word of two), so candidates
are found by intersecting a few postings, and only they are tested, each text for all words at once. Texts and words are
compared with their case folded. Texts are indexed in chunks, and an index is three tables:

    chunks        chunk, ids            the ids of a chunk's texts, by their places in it
    postings      gram, chunk, places   sorted by gram, so a lookup reads few row groups
    frequencies   gram, n               in how many texts a gram is

places are 16-bit numbers, or a bit for each text of the chunk where that is shorter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import folded
from ..storage import new_path, remove, written

#: A chunk's texts and bytes at most; a longer text is a chunk of its own.
CHUNK_TEXTS, CHUNK_BYTES = 8_192, 4_000_000
#: Characters of a text whose grams are told apart at a time.
STRETCH = 1 << 20
#: Ids of texts to be tested that may be broadcast, and found words that a task holds before it gives them out.
MOST_SENT, MOST_HELD = 100_000, 200_000


@dataclass
class KeywordIndex:
    chunks: DataFrame
    postings: DataFrame
    frequencies: DataFrame


def grams_of_word(word: Column) -> Column:
    """The grams that a text with this word (of two characters at least) must have: of three characters, or the word itself if it has two."""
    of_three = F.transform(F.sequence(F.lit(1), F.char_length(word) - 2), lambda i: F.substring(word, i, F.lit(3)))
    return F.when(F.char_length(word) == 2, F.array(word)).otherwise(F.array_distinct(of_three))


def gram_codes(text: str) -> np.ndarray:
    """The distinct runs of two and three characters, each as a number of 63 bits: 21 for a character, the last first; no character is 0 but NUL, which counts as one."""
    found = np.empty(0, np.int64)
    for a in range(0, max(1, len(text) - 1), STRETCH):
        c = np.frombuffer(text[a : a + STRETCH + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        two = c[:-1] | c[1:] << 21
        found = np.unique(np.concatenate([found, two, two[:-1] | c[2:] << 42]))
    return found


def gram_text(code: int) -> str:
    return "".join(chr((code >> s & 0x1FFFFF) - 1) for s in (0, 21, 42) if code >> s & 0x1FFFFF)


def pack(places: np.ndarray, n: int) -> bytes:
    """Ascending places among n texts, behind a byte that tells their form."""
    if 2 * len(places) <= n // 8:
        return b"n" + places.astype("<u2").tobytes()
    bits = np.zeros(n, np.uint8)
    bits[places] = 1
    return b"b" + np.packbits(bits, bitorder="little").tobytes()


def unpack(packed: bytes) -> np.ndarray:
    if packed[:1] == b"n":
        return np.frombuffer(packed, "<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, offset=1), bitorder="little"))


def _bits(packed: bytes) -> int:
    """The places as bits of a number."""
    if packed[:1] == b"n":
        places = unpack(packed)
        bits = np.zeros(places[-1] + 1, np.uint8)
        bits[places] = 1
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return int.from_bytes(packed[1:], "little")


def _places(bits: int) -> np.ndarray:
    return unpack(b"b" + bits.to_bytes(-(-bits.bit_length() // 8), "little"))


def _cut(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and (i - start == CHUNK_TEXTS or held + size > CHUNK_BYTES):
            yield start, i
            start, held = i, 0
        held += size
    if len(sizes):
        yield start, len(sizes)


def build_index(texts: DataFrame, path: str | None = None, id_col: str = "id", text_col: str = "content") -> KeywordIndex:
    """Write an index of the texts to path and return it. Null and empty texts are left out; ids are of any type and tell texts apart."""
    spark = texts.sparkSession
    path = path or new_path(spark, "keyword-index")
    _write(texts, path, id_col, text_col)
    return _sorted(spark, path, spark.read.parquet(f"{path}/posted"))


def _held(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts.select(F.col(id_col).alias("id"), folded(text_col).alias("text")).filter("text <> ''")


def _write(texts: DataFrame, path: str, id_col: str, text_col: str) -> None:
    """Append the texts' chunks and unsorted postings."""
    id_type = texts.schema[id_col].dataType
    arrow = pa.schema([("chunk", pa.string()), ("ids", pa.list_(to_arrow_type(id_type))), ("gram", pa.string()), ("places", pa.binary()), ("n", pa.int32())])

    def post(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _cut(pc.binary_length(batch.column(1)).to_numpy()):
                name, n = uuid.uuid4().hex, b - a
                each = [gram_codes(t) for t in batch.column(1).slice(a, n).to_pylist()]
                codes, place = np.concatenate(each), np.repeat(np.arange(n), [len(x) for x in each])
                order = np.argsort(codes, kind="stable")
                codes, place = codes[order], place[order]
                first = np.flatnonzero(np.diff(codes, prepend=-1))
                parts = np.split(place, first[1:]) if len(first) else []
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([batch.column(0).slice(a, n).to_pylist()], arrow.field("ids").type), *(pa.nulls(1, f.type) for f in list(arrow)[2:])], schema=arrow)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(first), pa.string()), pa.nulls(len(first), arrow.field("ids").type), pa.array(map(gram_text, codes[first].tolist()), pa.string()), pa.array([pack(p, n) for p in parts], pa.binary()), pa.array(map(len, parts), pa.int32())], schema=arrow)

    posted = _held(texts, id_col, text_col).mapInArrow(post, f"chunk string, ids array<{id_type.simpleString()}>, gram string, places binary, n int")
    posted.write.mode("append").parquet(f"{path}/posted")


def _sorted(spark: SparkSession, path: str, posted: DataFrame) -> KeywordIndex:
    posted.filter("ids IS NOT NULL").select("chunk", "ids").write.parquet(f"{path}/chunks")
    rows = posted.filter("ids IS NULL").select("gram", "chunk", "places", "n")
    rows.repartitionByRange("gram", "chunk").sortWithinPartitions("gram").write.parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.sum("n").cast("long").alias("n")).sort("gram").write.parquet(f"{path}/frequencies")
    remove(spark, f"{path}/posted")
    return load_index(spark, path)


def load_index(spark: SparkSession, path: str) -> KeywordIndex:
    return KeywordIndex(*(spark.read.parquet(f"{path}/{t}") for t in ("chunks", "postings", "frequencies")))


def add_texts(index: KeywordIndex, path: str, texts: DataFrame, id_col: str = "id", text_col: str = "content") -> KeywordIndex:
    """Write an index of the old and of new texts, whose ids are new, to path. The old texts aren't read."""
    spark = texts.sparkSession
    _write(texts, path, id_col, text_col)
    new = spark.read.parquet(f"{path}/posted")
    old = index.chunks.unionByName(index.postings, allowMissingColumns=True)
    return _sorted(spark, path, new.unionByName(old.select(*new.columns)))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """folded, chunk, places, n of rows that come sorted by chunk and word: the places that all of a word's grams have, packed; of words to be tested all places together, at a chunk's end and with no word."""
    names, types = ["folded", "chunk", "places", "n"], [pa.string(), pa.string(), pa.binary(), pa.int32()]
    key, needs, has, common, texts = (None, None), 0, 0, 0, 0
    out: list[tuple] = []

    def put(word: str | None, chunk: str, bits: int) -> int:
        """The places where the word is to be tested."""
        if bits and word and len(word) > 3:
            out.append((word, chunk, None, bits.bit_count()))
            return bits
        if bits:
            places = _places(bits)
            out.append((word, chunk, pack(places, int(places[-1]) + 1), len(places)))
        return 0

    def close(chunk: str | None) -> None:
        nonlocal texts
        if key[0] is not None and has == needs:
            texts |= put(key[1], key[0], common)
        if key[0] != chunk:
            put(None, key[0], texts)
            texts = 0

    for batch in batches:
        for word, chunk, packed, need in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (chunk, word) != key:
                close(chunk)
                key, needs, has, common = (chunk, word), need, 0, -1
            has, common = has + 1, common & _bits(packed)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)
        out.clear()
    close(None)
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)


def _automaton(words: list[str]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word in words:
        automaton.add_word(word, word)
    automaton.make_automaton()
    return automaton


def _spotted(automaton, texts: list[str], ids: pa.Array, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """folded, id: each text's id with each of the automaton's words that it contains."""
    words, rows = [], []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), ids.take(pa.array(rows, pa.int64()))], schema=arrow)

    for i, text in enumerate(texts):
        found = {w for _, w in automaton.iter(text)}
        words += found
        rows += [i] * len(found)
        if len(words) >= MOST_HELD:
            yield made()
            words, rows = [], []
    yield made()


def containing(index: KeywordIndex, texts: DataFrame, words: DataFrame, rarest: int = 3, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """word, id: the texts, which are those of the index, that contain each word (of two characters at least) of words.word, but for case.

    Of each word the `rarest` grams that fewest texts have are looked up; a word with a gram that no text has is found
    nowhere. A word of two or three characters is a gram itself; of longer ones, what the postings leave is tested on the
    text: candidates stay places in a chunk, and the candidate texts are gone through once for all words together, as in
    scanned(); where most texts are candidates, all are. A word that many texts hold has its postings dealt by chunk.
    """
    wanted = words.select(folded("word").alias("folded")).filter(F.char_length("folded") >= 2).distinct()
    parts = wanted.select("folded", F.explode(grams_of_word(F.col("folded"))).alias("gram")).join(index.frequencies, "gram", "left")
    least = Window.partitionBy("folded").orderBy("n", "gram")  # a word has few grams
    parts = parts.withColumn("_place", F.row_number().over(least)).withColumn("_unknown", F.max(F.col("n").isNull()).over(Window.partitionBy("folded")))
    looked = parts.filter((F.col("_place") <= rarest) & ~F.col("_unknown")).withColumn("needs", F.count("*").over(Window.partitionBy("folded"))).select("folded", "gram", "needs")
    rows = index.postings.join(looked, "gram").select("folded", "chunk", "places", F.col("needs").cast("int").alias("needs"))
    met = rows.repartition("chunk").sortWithinPartitions("chunk", "folded").mapInArrow(_meet, "folded string, chunk string, places binary, n int")
    met = written(met, "keyword-candidates")
    places = F.udf(lambda packed: unpack(packed).tolist(), "array<int>")
    ids = F.transform(places("places"), lambda p: F.get("ids", p))
    short = met.filter(F.char_length("folded") <= 3).join(index.chunks, "chunk").select("folded", F.explode(ids).alias("id"))
    read = met.filter("folded IS NULL")
    at = read.join(index.chunks, "chunk").select(F.explode(ids).alias("of_id"))
    n, held = read.agg(F.sum("n")).first()[0] or 0, _held(texts, id_col, text_col)
    if n <= MOST_SENT or 2 * n < index.chunks.agg(F.sum(F.size("ids"))).first()[0]:
        # Spark sizes exploded ids as one row a chunk, so by itself it may broadcast any number of them
        held = held.join(F.broadcast(at) if n <= MOST_SENT else at.hint("merge"), F.col("id").eqNullSafe(F.col("of_id")), "left_semi")
    tested = _spot(held, met.filter(F.char_length("folded") > 3).select("folded").distinct())
    spelled = words.select("word", folded("word").alias("folded")).distinct()
    return short.unionByName(tested).join(spelled, "folded").select("word", "id")


def keyword_order() -> list[Column]:
    return [F.desc(F.col("n_minority") > 0), F.desc("n_minority"), F.desc("n_majority"), F.desc("score"), F.asc("chunk_id")]


def scanned(texts: DataFrame, words: DataFrame, id_col: str = "id", text_col: str = "content", wave_bytes: int = 8_000_000) -> DataFrame:
    """What containing() gives, without an index: one pass over the texts looks for all words at once (Aho-Corasick).

    Words of more than wave_bytes bytes are looked for in several passes, by a hash of the word.
    """
    wanted = words.select("word", folded("word").alias("folded")).filter(F.char_length("folded") >= 2).distinct()
    return _spot(_held(texts, id_col, text_col), wanted.select("folded").distinct(), wave_bytes).join(wanted, "folded").select("word", "id")


def _spot(held: DataFrame, wanted: DataFrame, wave_bytes: int = 8_000_000) -> DataFrame:
    """folded, id: the folded texts of held (id, text) that contain each of the words of wanted.folded, which are distinct."""
    spark, id_type = held.sparkSession, held.schema["id"].dataType
    arrow = pa.schema([("folded", pa.string()), ("id", to_arrow_type(id_type))])
    size = wanted.agg(F.sum(F.octet_length("folded").cast("long"))).first()[0] or 0
    out = None
    for p in range(passes := max(1, -(-size // wave_bytes))):
        mine = wanted if passes == 1 else wanted.filter(F.pmod(F.xxhash64("folded"), F.lit(passes)) == p)
        shared = spark.sparkContext.broadcast(sorted(r.folded for r in mine.toLocalIterator()))
        found = held.mapInArrow(_finder(shared, arrow), f"folded string, id {id_type.simpleString()}")
        out = found if out is None else out.unionByName(found)
    return out


def _finder(shared, arrow: pa.Schema):
    def run(batches):
        if not shared.value:
            return
        automaton = _automaton(shared.value)
        for batch in batches:
            yield from _spotted(automaton, batch.column(1).to_pylist(), batch.column(0), arrow)

    return run


def keyword_hits(chunks: DataFrame, words: DataFrame, k: int = 50, index: KeywordIndex | None = None) -> DataFrame:
    """query_id, chunk_id, doc_id, n_minority, n_majority, score: the k best chunks of each question that hold any of its keywords.

    words: query_id, minority, majority, as retrieval.keyword_lists() leaves them. With an index of the chunks only candidates
    are read, without one all chunks are, once. Questions with the same keywords are answered once. A task keeps its best k
    chunks of a question before they are shuffled; k = 0 gives no rows.
    """
    asked = words.withColumn("key", F.sha2(F.to_json(F.struct("minority", "majority")), 256))
    lists = asked.select("key", "minority", "majority").dropDuplicates(["key"])
    each = lists.select("key", F.explode("minority").alias("word"), F.lit(1).alias("rare")).unionByName(lists.select("key", F.explode("majority").alias("word"), F.lit(0).alias("rare")))
    each = written(each, "keywords")
    named = each.select("word").distinct()
    hits = (scanned(chunks, named) if index is None else containing(index, chunks, named)).join(each, "word")
    counted = hits.groupBy("key", F.col("id").alias("chunk_id")).agg(F.sum("rare").alias("n_minority"), F.sum(1 - F.col("rare")).alias("n_majority"))
    scored = counted.withColumn("score", (10 * F.col("n_minority") + F.col("n_majority")).cast("double"))
    best = scored.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(*keyword_order()))).filter(F.col("_n") <= k).drop("_n")
    best = best.join(chunks.select(F.col("id").alias("chunk_id"), "doc_id"), "chunk_id")
    return asked.select("query_id", "key").join(best, "key").select("query_id", "chunk_id", "doc_id", "n_minority", "n_majority", "score")

"""Token ids in a binary file format of directly addressable codes.

Each id is split into chunks of `WIDTHS` bits, lowest first. Level k holds the
k-th chunk of every id that has one, and a bitmap that says which of them
continue on the next level; a rank directory (ones before every 512 bits) turns
a position on one level into the position on the next. So any id is read from
its position alone: no block has to be decoded.

A file image holds the documents of one run in order; it is closed once it has
`FILE_TOKENS` ids. Layout, little-endian:

    magic 'DAC1', u32 levels, u64 ids, u64 documents
    per level: u32 width in bits, u64 chunks
    u64 first position per document, and after the last one
    per level: chunks (1, 2 or 4 bytes); but on the top level also bitmap (u64 words) and ranks (u64 per 8 words)

Spark writes the images as rows (run, part, first token, doc_ids, image) of a
Parquet table: so they land on whatever file system the path names, and a task
that is tried again replaces what it wrote.

Defined cases: a null or empty text is one id, the end of document; null ids of
documents come first; rows that repeat a doc_id are documents in the order of
their texts; an empty table gives no image.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialgrid.llm.common import pick, tidied
from trialgrid.session import scratch_path

MAGIC = b"DAC1"
WIDTHS = (8, 8, 16)
FILE_TOKENS = 1 << 20
PER_RANK = 8  # words of 64 bits
END_ID = 2
CACHED_WORDS, ENCODED_BYTES = 150_000, 1 << 21


def default_vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


# ---------------------------------------------------------------- the code

def _pack(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmap words and rank directory."""
    padded = np.zeros(-(-len(bits) // 64) * 64, np.uint8)
    padded[:len(bits)] = bits
    words = np.packbits(padded, bitorder="little").view("<u8")
    ones = np.bitwise_count(words).astype(np.uint64)
    before = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
    return words, before[:-1][::PER_RANK]


def encode_image(ids: np.ndarray, starts: np.ndarray) -> bytes:
    """The file image of `ids`, whose documents begin at `starts` (and end at its last value)."""
    levels, rest = [], ids.astype(np.uint32)
    for k, width in enumerate(WIDTHS):
        top = k == len(WIDTHS) - 1
        chunk = (rest & np.uint32((1 << width) - 1)).astype(f"<u{width // 8}")
        rest = rest >> np.uint32(width)
        more = (rest > 0) & (not top)
        levels.append((width, chunk, None if top else more))
        if top or not more.any():
            break
        rest = rest[more]
    head = [MAGIC, struct.pack("<IQQ", len(levels), len(ids), len(starts) - 1)]
    head += [struct.pack("<IQ", width, len(chunk)) for width, chunk, _ in levels]
    body = [starts.astype("<u8").tobytes()]
    for _, chunk, more in levels:
        body.append(chunk.tobytes())
        if more is not None:
            words, ranks = _pack(more)
            body += [words.tobytes(), ranks.tobytes()]
    return b"".join(head + body)


class Image:
    """Random access to a file image."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        n_levels, self.n_ids, self.n_documents = struct.unpack_from("<IQQ", data, 4)
        at, shapes = 24, []
        for _ in range(n_levels):
            shapes.append(struct.unpack_from("<IQ", data, at))
            at += 12
        self.starts = np.frombuffer(data, "<u8", self.n_documents + 1, at).astype(np.int64)
        at += 8 * (self.n_documents + 1)
        self.levels, below = [], 0
        for width, n in shapes:
            chunks = np.frombuffer(data, f"<u{width // 8}", n, at)
            at += n * width // 8
            words = ranks = None
            if below + width < sum(WIDTHS):
                words = np.frombuffer(data, "<u8", -(-n // 64), at)
                at += 8 * len(words)
                ranks = np.frombuffer(data, "<u8", -(-len(words) // PER_RANK), at)
                at += 8 * len(ranks)
            self.levels.append((below, chunks, words, ranks))
            below += width

    def _rank(self, words: np.ndarray, ranks: np.ndarray, position: int) -> int:
        word = position // 64
        first = word // PER_RANK * PER_RANK
        inside = int(words[word]) & ((1 << (position % 64)) - 1)
        return int(ranks[word // PER_RANK]) + sum(int(w).bit_count() for w in words[first:word]) + inside.bit_count()

    def __getitem__(self, position: int) -> int:
        """One id, by its position alone."""
        if not 0 <= position < self.n_ids:
            raise IndexError(position)
        value = 0
        for below, chunks, words, ranks in self.levels:
            value |= int(chunks[position]) << below
            if words is None or not int(words[position // 64]) >> (position % 64) & 1:
                break
            position = self._rank(words, ranks, position)
        return value

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids from `first` to before `last`: per level one slice, found by rank."""
        values = np.zeros(last - first, np.uint32)
        at, low, high = np.arange(last - first), first, last
        for below, chunks, words, ranks in self.levels:
            values[at] |= chunks[low:high].astype(np.uint32) << np.uint32(below)
            if words is None or low == high:
                break
            word = low // 64
            bits = np.unpackbits(words[word:-(-high // 64)].view(np.uint8), bitorder="little")
            more = bits[low - 64 * word:high - 64 * word].astype(bool)
            low, at = self._rank(words, ranks, low), at[more]
            high = low + len(at)
            if low == high:
                break
        return values


# ---------------------------------------------------------------- tokenizing

class WordEncoder:
    """Ids of whole texts by the given tokenizer, word by word.

    The tokenizer drops white space, and neither its normaliser nor its
    splitting looks across it, so the ids of a text are those of its words;
    and it cuts a letter from the punctuation behind it. `separable` checks
    that on the vocabulary file's own settings; texts go through the tokenizer
    whole where it doesn't hold. Texts without added tokens and below U+0300, where lower-casing
    and composing don't interact, are lower-cased and cut before the lookup, which
    leaves fewer words to learn. New words of plain letters are learned many
    at a time: each is one run of letters, whose last id is a word end."""

    #: A letter and the punctuation behind it, but for the apostrophe of short forms.
    CUT = r"([a-z\x{e0}-\x{f6}\x{f8}-\x{ff}])([!-&(-/:-@\[-`{-~])"
    HIGH = r"[\x{300}-\x{10ffff}]"
    PLAIN = re.compile(r"[a-z\xe0-\xf6\xf8-\xff]+")
    AT_ONCE = 1000

    def __init__(self, vocabulary: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            settings = json.load(f)
        self.separable = self._separable(settings)
        ends = [i for token, i in settings["model"].get("vocab", {}).items() if token.endswith("</w>")]
        self.added = [t["content"].lower() for t in settings.get("added_tokens") or []]
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.is_end[ends] = True
        self.end = np.array([end_id], "<u4").tobytes()
        self.words: dict[bytes, bytes] = {}
        self.old_words: dict[bytes, bytes] = {}

    @staticmethod
    def _separable(settings: dict) -> bool:
        normal = settings.get("normalizer") or {}
        steps = [s.get("type") for s in normal.get("normalizers", [normal])]
        split = (settings.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        pattern = split.get("pattern", {}).get("Regex", "")
        added = settings.get("added_tokens") or []
        return (steps == ["NFC", "Replace", "Lowercase"] and split.get("behavior") == "Removed"
                and split.get("invert") is True and pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
                and settings["model"].get("end_of_word_suffix") == "</w>" and settings.get("post_processor") is None
                and not any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in added))

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(found.ids, "<u4") for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, wanted: set[bytes]) -> None:
        """Fill the table for all these words. A full one steps back and serves
        a second time, so that frequent words stay."""
        if len(self.words) > CACHED_WORDS:
            self.words, self.old_words = {}, self.words
        plain, other = [], []
        for word in wanted - self.words.keys():
            known = self.old_words.get(word)
            if known is not None:
                self.words[word] = known
                continue
            text = word.decode()
            some, learn = (plain, self._learn_plain) if self.PLAIN.fullmatch(text) else (other, self._learn_other)
            some.append((word, text))
            if len(some) == self.AT_ONCE:
                learn(some)
                some.clear()
        if plain:
            self._learn_plain(plain)
        if other:
            self._learn_other(other)

    def _learn_plain(self, some: list[tuple[bytes, str]]) -> None:
        ids = self._ids([" ".join(text for _, text in some)])[0]
        bounds = np.flatnonzero(self.is_end[ids]) + 1
        if len(bounds) != len(some):
            raise ValueError("the tokenizer doesn't end each word of letters once")
        data, at = ids.tobytes(), 0
        for (word, _), end in zip(some, (4 * bounds).tolist(), strict=True):
            self.words[word] = data[at:end]
            at = end

    def _learn_other(self, some: list[tuple[bytes, str]]) -> None:
        found = self._ids([text for _, text in some])
        self.words.update((word, ids.tobytes()) for (word, _), ids in zip(some, found, strict=True))

    def _words_of(self, texts: pa.Array) -> pa.Array:
        """Lists of words: runs without ASCII white space (an empty one may come first or last)."""
        low = pc.ascii_lower(texts)
        whole = pc.match_substring_regex(texts, self.HIGH)
        for token in self.added:
            whole = pc.or_(whole, pc.match_substring(low, token))
        return pc.ascii_split_whitespace(pc.if_else(whole, texts, pc.replace_substring_regex(low, self.CUT, r"\1 \2")))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, with the end id."""
        if not self.separable:
            return [ids.tobytes() + self.end for ids in self._ids(texts)]
        # an array of its own: string functions read a slice of a batch at a wrong offset
        split = self._words_of(pa.array(texts, pa.large_string()))
        bounds = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
        word = coded.indices.to_numpy(zero_copy_only=False)
        del split, coded  # the words themselves aren't needed any longer
        wanted = set(distinct)
        if not wanted <= self.words.keys():
            self._learn(wanted)
        own = [self.words[w] for w in distinct]
        del wanted, distinct
        # the ids of all words, gathered from those of the distinct ones
        sizes = np.fromiter(map(len, own), np.int64, len(own)) >> 2
        first, ids = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(own), "<u4")
        many = sizes[word]
        upto = np.cumsum(many)
        place = np.repeat(first[word] - upto + many, many)
        place += np.arange(len(place))
        found = ids[place]
        at = np.concatenate([[0], upto])[bounds - bounds[0]].tolist()
        del place, upto, many, word
        data = found.tobytes()
        return [data[4 * low:4 * high] + self.end for low, high in zip(at[:-1], at[1:], strict=True)]


@lru_cache(1)
def shared_encoder(vocabulary: str, end_id: int) -> WordEncoder:
    """One encoder for all tasks of a Python worker."""
    return WordEncoder(vocabulary, end_id)


# ---------------------------------------------------------------- Spark

IMAGES = pa.schema([("run", pa.int32()), ("part", pa.int64()), ("first_token", pa.int64()), ("n_ids", pa.int64()),
                    ("doc_ids", pa.list_(pa.int64())), ("image", pa.binary())])
IMAGES_DDL = "run int, part bigint, first_token bigint, n_ids bigint, doc_ids array<bigint>, image binary"


def _together(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Texts (column 1) that are encoded together, so that each distinct word is looked
    up once for all of them: `ENCODED_BYTES` and at most one text more."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = (np.cumsum(sizes) - sizes) // ENCODED_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    return (batch.slice(low, high - low) for low, high in zip(cuts[:-1], cuts[1:], strict=True) if low < high)


def write_images(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Encode every text and write the images in ascending order of ids: runs
    ascend as range partitions do, parts and first tokens inside a run."""
    vocabulary = vocabulary or default_vocabulary()

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, run = shared_encoder(vocabulary, end_id), TaskContext.get().partitionId()
        part = first = size = 0
        pieces, doc_ids, starts = [], [], [0]

        def image():
            data = encode_image(np.frombuffer(b"".join(pieces), "<u4"), np.array(starts, np.uint64))
            row = (run, part, first, size, doc_ids, data)
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, IMAGES, strict=True)],
                                              schema=IMAGES)

        for batch in batches:
            for some in _together(batch):
                encoded = encoder.encode([text or "" for text in some.column(1).to_pylist()])
                for doc_id, ids in zip(some.column(0).to_pylist(), encoded, strict=True):
                    pieces.append(ids)
                    size += len(ids) // 4
                    doc_ids.append(doc_id)
                    starts.append(size)
                    if size >= FILE_TOKENS:
                        yield image()
                        part, first, size = part + 1, first + size, 0
                        pieces, doc_ids, starts = [], [], [0]
        if size:
            yield image()

    texts = pick(documents, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("bigint"), "text")
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (ordered.mapInArrow(tidied(images), IMAGES_DDL).write.mode("errorifexists")
     .option("compression", "zstd").parquet(path))


ROWS = pa.schema([("run", pa.int32()), ("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64()),
                  ("ids_crc32", pa.int64())])
ROWS_DDL = "run int, doc_id bigint, first bigint, n_tokens bigint, ids_crc32 bigint"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, read from the written images: doc_id, start (ids
    of all documents before it), n_tokens, ids_crc32."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, base, doc_ids, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                image = Image(data)
                bounds = list(zip(image.starts[:-1].tolist(), image.starts[1:].tolist(), strict=True))
                crcs = [zlib.crc32(image.ids(low, high).astype("<u4").tobytes()) for low, high in bounds]
                columns = ([run] * len(bounds), doc_ids, [base + low for low, _ in bounds],
                           [high - low for low, high in bounds], crcs)
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, ROWS, strict=True)],
                                                 schema=ROWS)

    stored = spark.read.schema(IMAGES_DDL).parquet(path)
    found = stored.select("run", "first_token", "doc_ids", "image").mapInArrow(tidied(rows), ROWS_DDL)
    before = Window.partitionBy(F.lit(1)).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (stored.groupBy("run").agg(F.sum("n_ids").alias("n"))  # one row per run
               .select(F.col("run").alias("of_run"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")))
    return (found.join(offsets, F.col("run") == F.col("of_run"))
            .select("doc_id", (F.col("ahead") + F.col("first")).cast("bigint").alias("start"), "n_tokens", "ids_crc32"))


def token_output(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
                 end_id: int = END_ID) -> DataFrame:
    """Write all texts as file images in the shared folder and read them back."""
    spark = documents.sparkSession
    path = scratch_path(spark, "token-images")
    write_images(documents, path, id_col, text_col, vocabulary, end_id)
    return read_documents(spark, path)

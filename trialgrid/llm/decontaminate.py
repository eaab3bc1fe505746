"""Benchmark decontamination: a BM25 index of test items, searched by every training passage.

Test items are cut into chunks of at most `CHUNK` words, which are the
documents of an inverted index with block maxima: chunks stand in blocks of
`BLOCK`, and for each word and block the largest impact is kept. Impacts are
divided by the chunk's score against itself, so that a passage holding a whole
chunk scores 1 and one threshold serves chunks of any length.

Each training text is cut into passages of `2 * CHUNK` words, each half
overlapping the next, so every chunk that occurs lies whole in one of them. For
all passages of a batch at once the sum of block maxima bounds their score in
each block (words common enough to be in many blocks enter as one constant per
block); in the blocks that can reach the threshold a WAND search with pivots
retrieves every chunk at or above it. An item retrieved for a document is then
verified on the whole text: 5-word shingles found there must cover
`least_overlap` of the words of its question and of its answer (its last
sentence, unless the table has a column of answers).

The texts are read once and never shuffled. The index travels to the tasks by
shards of items with at most `SHARD_CHARS` characters, one pass each: document
frequencies come from the whole test table, so the results don't depend on the
number of shards.

Defined cases: a null or empty text holds nothing; an item without words
matches nothing; an item of fewer than 5 words must occur as a whole; repeated
rows are found again each; rows with a null id are found under the null id;
empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialgrid.llm.common import pick, tidied
from trialgrid.session import written

CHUNK, BLOCK, SHINGLE = 64, 2, 5
K1, B = 0.9, 0.4
SHARD_CHARS = 4_000_000
BATCH_WORDS, BATCH_CELLS = 100_000, 1_000_000
WORDS = re.compile(r"\w+")
SENTENCE_END = re.compile(r"[.?!\n](?=\s*\w)")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def split_item(text: str | None, answer: str | None = None) -> tuple[list[str], int]:
    """The item's words, and how many of them are the question. Without an
    answer of its own the last sentence is the answer; a single sentence is both."""
    if answer is not None:
        question = words_of(text)
        return question + words_of(answer), len(question)
    ends = list(SENTENCE_END.finditer(text or ""))
    question = words_of(text[:ends[-1].end()]) if ends else []
    return words_of(text), len(question)


class Index:
    """Block-max inverted index over chunks."""

    def __init__(self, items: list, frequency: dict[str, int], n_chunks: int, mean_words: float, threshold: float):
        """items: (item_id, words, number of question words). The statistics are the whole test table's."""
        self.items, self.threshold = items, threshold
        self.chunk_item, chunks = [], []
        for k, (_, words, _) in enumerate(items):
            for at in range(0, len(words), CHUNK):
                self.chunk_item.append(k)
                chunks.append(words[at:at + CHUNK])
        self.terms: dict[str, int] = {}
        docs, impacts = [], []
        for d, chunk in enumerate(chunks):
            counts = Counter(chunk)
            norm = K1 * (1 - B + B * len(chunk) / mean_words)
            raw = {w: math.log(1 + (n_chunks - frequency[w] + 0.5) / (frequency[w] + 0.5)) * n * (K1 + 1) / (n + norm)
                   for w, n in counts.items()}
            own = sum(raw.values())
            for w, impact in raw.items():
                t = self.terms.setdefault(w, len(docs))
                if t == len(docs):
                    docs.append([])
                    impacts.append([])
                docs[t].append(d)
                impacts[t].append(impact / own)
        self.docs, self.impacts = docs, impacts
        self.n_blocks = -(-len(chunks) // BLOCK)
        self._block_maxima()
        self.shingles: dict[tuple, list] = {}
        for k, (_, words, _) in enumerate(items):
            size = min(SHINGLE, len(words))
            for at in range(len(words) - size + 1 if size else 0):
                self.shingles.setdefault(tuple(words[at:at + size]), []).append((k, at))
        self.sizes = sorted({min(SHINGLE, len(words)) for _, words, _ in items} - {0})

    def _block_maxima(self) -> None:
        """Per term its blocks and their maxima; the most common terms only as one constant per block."""
        tops = []
        for d, x in zip(self.docs, self.impacts, strict=True):
            top: dict[int, float] = {}
            for doc, impact in zip(d, x, strict=True):
                top[doc // BLOCK] = max(top.get(doc // BLOCK, 0.0), impact)
            tops.append(top)
        self.constant = np.zeros(self.n_blocks)
        common = set()
        for t in sorted(range(len(tops)), key=lambda t: (-len(self.docs[t]), t)):
            added = self.constant.copy()
            for b, top in tops[t].items():
                added[b] += top
            if len(tops[t]) <= 4 or added.max(initial=0) > 0.3 * self.threshold:
                break
            self.constant = added
            common.add(t)
        counts = np.array([0 if t in common else len(top) for t, top in enumerate(tops)], np.int64)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        rare = [top for t, top in enumerate(tops) if t not in common]
        self.blocks = np.array([b for top in rare for b in top], np.int64)
        self.maxima = np.array([x for top in rare for x in top.values()])
        self.tops = tops

    def passages(self, terms: np.ndarray, bounds: list[int]) -> Iterator[tuple[int, int, int, int]]:
        """(document, first and last position, block) of every passage and
        block whose bound reaches the threshold. bounds: where documents begin in `terms`, and the end."""
        starts, cell_doc = [], []
        for d, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            starts += range(low, high, CHUNK)
            cell_doc += [d] * -(-(high - low) // CHUNK)
        if not starts or not self.n_blocks:
            return
        starts_at = np.array(starts)
        at = np.flatnonzero(terms >= 0)
        at = at[self.first[terms[at] + 1] > self.first[terms[at]]]
        # each rare term once per cell
        own = np.unique((np.searchsorted(starts_at, at, "right") - 1) * len(self.docs) + terms[at])
        t = own % len(self.docs)
        n = self.first[t + 1] - self.first[t]
        cell = np.repeat(own // len(self.docs), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        entry = np.repeat(self.first[t], n) + inside
        sums = np.bincount(cell * self.n_blocks + self.blocks[entry], self.maxima[entry], len(starts) * self.n_blocks)
        bound = sums.reshape(len(starts), self.n_blocks)
        # a passage is a cell and the next one of its document
        doc = np.array(cell_doc)
        joined = np.append(doc[1:] == doc[:-1], False)
        bound = bound.astype(float, copy=False)  # without entries the sums are whole numbers
        bound[:-1] += bound[1:] * joined[:-1, None]
        bound += self.constant
        cells, blocks = np.nonzero(bound >= self.threshold - 1e-9)
        for c, b in zip(cells.tolist(), blocks.tolist(), strict=True):
            last = min(starts[c] + (2 * CHUNK if joined[c] else CHUNK), bounds[cell_doc[c] + 1])
            yield cell_doc[c], starts[c], last, b

    def search(self, terms: set[int], block: int) -> list[tuple[int, float]]:
        """WAND within a block: all chunks that score the threshold or more for the passage's distinct terms."""
        low, high, threshold = block * BLOCK, (block + 1) * BLOCK, self.threshold - 1e-9
        cursors = []  # [current chunk, place, end, postings, impacts, block maximum]
        for t in terms:
            top = self.tops[t].get(block)
            if top is not None:
                docs = self.docs[t]
                first = bisect_left(docs, low)
                cursors.append([docs[first], first, bisect_left(docs, high), docs, self.impacts[t], top])
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[5]
                if bound >= threshold:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            if cursors[0][0] == pivot:
                score = 0.0
                for c in cursors:
                    if c[0] != pivot:
                        break
                    score += c[4][c[1]]
                    c[1] += 1
                if score >= threshold:
                    found.append((pivot, score))
            else:
                for c in cursors:
                    if c[0] >= pivot:
                        break
                    c[1] = bisect_left(c[3], pivot, c[1], c[2])
            cursors = [c for c in cursors if c[1] < c[2]]
            for c in cursors:
                c[0] = c[3][c[1]]
        return found

    def overlaps(self, words: list[str], wanted: set[int]) -> dict[int, tuple[float, float]]:
        """Shares of question and answer words that shingles of the text cover, for the wanted items."""
        covered = {k: bytearray(len(self.items[k][1])) for k in wanted}
        for size in self.sizes:
            for shingle in set(zip(*(words[i:] for i in range(size)), strict=False)):
                for k, at in self.shingles.get(shingle, ()):
                    if k in wanted:
                        covered[k][at:at + size] = b"\1" * size
        shares = {}
        for k, marks in covered.items():
            n_question = self.items[k][2]
            question, answer = marks[:n_question] or marks, marks[n_question:] or marks
            shares[k] = sum(question) / len(question), sum(answer) / len(answer)
        return shares

    def leaks(self, texts: list, least_overlap: float) -> list[list[tuple]]:
        """Per text the items found in it: (place of the item, best score, question overlap, answer overlap)."""
        out: list[list[tuple]] = [[] for _ in texts]
        todo, first, size = [], 0, 0
        most = min(BATCH_WORDS, CHUNK * BATCH_CELLS // max(1, self.n_blocks))
        for k, text in enumerate(texts):
            todo.append(words_of(text))
            size += len(todo[-1])
            if size >= most or k == len(texts) - 1:
                self._leaks(todo, least_overlap, out, first)
                todo, first, size = [], k + 1, 0
        return out

    def _leaks(self, texts: list[list[str]], least_overlap: float, out: list, first: int) -> None:
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(int).tolist()
        get = self.terms.get
        terms = np.empty(bounds[-1], np.int64)
        for words, low, high in zip(texts, bounds[:-1], bounds[1:], strict=True):
            terms[low:high] = np.fromiter(map(get, words, repeat(-1)), np.int64, high - low)
        best: dict[tuple[int, int], float] = {}
        passage, own = None, set()
        for doc, low, high, block in self.passages(terms, bounds):
            if passage != (low, high):
                passage, own = (low, high), set(terms[low:high].tolist()) - {-1}
            for chunk, score in self.search(own, block):
                key = doc, self.chunk_item[chunk]
                best[key] = max(best.get(key, 0.0), score)
        wanted: dict[int, set] = {}
        for doc, item in best:
            wanted.setdefault(doc, set()).add(item)
        for doc, items in wanted.items():
            for k, (question, answer) in sorted(self.overlaps(texts[doc], items).items()):
                if min(question, answer) >= least_overlap:
                    out[first + doc].append((k, best[doc, k], question, answer))


def _shards(benchmark: DataFrame, threshold: float, item_col: str, text_col: str, answer_col: str | None):
    """Broadcast indexes, one per shard of items."""
    spark = benchmark.sparkSession
    columns = {"item_id": item_col, "text": text_col} | ({"answer": answer_col} if answer_col else {})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            split = [split_item(r["text"], (r["answer"] or "") if answer_col else None) for r in rows]
            yield pa.RecordBatch.from_pydict(
                {"item_id": [r["item_id"] for r in rows], "words": [w for w, _ in split],
                 "n_question": [n for _, n in split]},
                schema=pa.schema([("item_id", pa.int64()), ("words", pa.list_(pa.string())), ("n_question", pa.int32())]))

    items = pick(benchmark, **columns).withColumn("item_id", F.col("item_id").cast("bigint"))
    items = written(items.mapInArrow(tidied(cut), "item_id bigint, words array<string>, n_question int"), "benchmark-items")
    chunks = items.select(F.explode(F.transform(
        F.sequence(F.lit(0), F.floor((F.size("words") - 1) / CHUNK).cast("int")),
        lambda k: F.slice("words", k * CHUNK + 1, F.lit(CHUNK)))).alias("chunk")).where(F.size("chunk") > 0)
    n_chunks, n_words, n_chars = chunks.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.size("chunk")), F.lit(0)),
        F.coalesce(F.sum(F.aggregate("chunk", F.lit(0), lambda n, w: n + F.length(w) + 1)), F.lit(0))).first()
    frequency = chunks.select(F.explode(F.array_distinct("chunk")).alias("word")).groupBy("word").count()
    n_shards = -(-n_chars // SHARD_CHARS)
    for k in range(n_shards):
        part = items.where((F.size("words") > 0) & (F.pmod(F.xxhash64("words"), F.lit(n_shards)) == k))
        known = part.select(F.explode("words").alias("word")).distinct()
        rows = sorted(((r[0], r[1], r[2]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        counts = dict(frequency.join(known, "word").collect())  # at most the shard's own words
        yield spark.sparkContext.broadcast(Index(rows, counts, n_chunks, n_words / n_chunks, threshold))


FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()),
                   ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
FOUND_DDL = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"


def find_leaks(documents: DataFrame, benchmark: DataFrame, threshold: float = 0.5, least_overlap: float = 0.75,
               id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
               answer_col: str | None = None) -> DataFrame:
    """A row for each document and test item found in it: doc_id, item_id, best
    score of a passage, overlaps."""
    texts = pick(documents, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("bigint"), "text")
    found = None
    for index in _shards(benchmark, threshold, item_col, item_text_col, answer_col):

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaks = index.value.leaks(batch.column(1).to_pylist(), least_overlap)
                rows = [(doc_id, index.value.items[k][0], score, q, a)
                        for doc_id, own in zip(batch.column(0).to_pylist(), leaks, strict=True) for k, score, q, a in own]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(FOUND)],
                                                 schema=FOUND)

        part = texts.mapInArrow(tidied(search), FOUND_DDL)
        found = part if found is None else found.unionAll(part)
    return documents.sparkSession.createDataFrame([], FOUND_DDL) if found is None else found


def clean_documents(documents: DataFrame, benchmark: DataFrame, threshold: float = 0.5, least_overlap: float = 0.75,
                    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                    answer_col: str | None = None) -> DataFrame:
    """The rows of `documents` in which no test item is found; rows that go are
    dropped where they are read, so no text is shuffled."""
    names = documents.columns
    at = names.index(text_col)
    documents = documents.toDF(*[f"c{i}" for i in range(len(names))])  # by position: names may repeat or clash
    schema = documents.schema
    for index in _shards(benchmark, threshold, item_col, item_text_col, answer_col):

        def clean(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaks = index.value.leaks(batch.column(at).to_pylist(), least_overlap)
                yield batch.filter(pa.array([not own for own in leaks], pa.bool_()))

        documents = documents.mapInArrow(tidied(clean), schema)
    return documents.toDF(*names)

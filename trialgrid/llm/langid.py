"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get a probability per language. A word
(a run of letters, behind the vocabulary's word mark) has the probability of
all its segmentations into pieces, summed by a forward algorithm; a text has
the product over its words. The probabilities are learned by expectation
maximisation: a forward-backward pass over the words of the learning rows gives
expected piece counts. Letters that no piece covers count as one unknown piece.

Learning takes a bounded sample (`sample_rows` per language in expectation,
chosen by a hash of the id) and whole texts; its word counts are summed by
Spark and stay distributed, each round returns at most one number per piece and
language to the driver. Prediction reads every text once without a shuffle;
the scores of about `CACHED_WORDS` words are kept per task.

Defined cases: a null text, or one without a letter, is `und` with score 0; rows
with a null language teach nothing; without any learning row every text is
`und`; ties go to the language that sorts first; repeated rows are predicted
alike; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialgrid.llm.common import pick
from trialgrid.session import written

MARK = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
CACHED_WORDS, PREDICT_TEXTS = 500_000, 250
LONG_WORD = 24
UNKNOWN = 0
UND = "und"


def default_vocabulary() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> list[str]:
    """The vocabulary's pieces of lower-case letters, with or without the word mark; place 0 is the unknown piece."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = (model.id_to_piece(i) for i in range(model.get_piece_size())
             if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    fits = {t for t in texts if t == t.lower() and LETTERS.fullmatch(t[1:] if t.startswith(MARK) and len(t) > 1 else t)}
    return ["", *sorted(fits | {MARK})]


class Lattice:
    """All pieces at all places of a list of words, in order of their place in
    the word, so that one step of a pass serves every word at once."""

    def __init__(self, pieces: Pieces, words: list[str]):
        marked = [MARK + w for w in words]
        length = np.fromiter(map(len, marked), np.int64, len(marked))
        codes = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
        ends = np.cumsum(length)
        left = np.repeat(ends, length) - np.arange(len(codes))
        place = np.repeat(length, length) - left
        begin, size, piece = pieces.find(codes, left)
        order = np.argsort(place[begin], kind="stable")
        self.word = np.repeat(np.arange(len(words)), length)[begin][order]
        # a word of n places has n + 1 forward values
        shift = np.repeat(np.arange(len(words)), length)[begin][order]
        self.begin, self.piece = begin[order] + shift, piece[order]
        self.end = self.begin + size[order]
        steps = place[begin][order]
        self.bounds = np.searchsorted(steps, np.arange(int(length.max(initial=0)) + 1))
        self.first, self.last = ends - length + np.arange(len(words)), ends + np.arange(len(words))
        self.places = len(codes) + len(words)

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Forward values (places x columns of p). Within a step no two pieces of a word end at the same place."""
        ahead = np.zeros((self.places, p.shape[1]))
        ahead[self.first] = 1.0
        for low, high in zip(self.bounds[:-1], self.bounds[1:], strict=True):
            ahead[self.end[low:high]] += ahead[self.begin[low:high]] * p[self.piece[low:high]]
        return ahead

    def backward(self, p: np.ndarray) -> np.ndarray:
        """Backward values for one column of probabilities."""
        behind = np.zeros(self.places)
        behind[self.last] = 1.0
        for low, high in zip(self.bounds[-2::-1], self.bounds[:0:-1], strict=True):
            np.add.at(behind, self.begin[low:high], behind[self.end[low:high]] * p[self.piece[low:high]])
        return behind


class Pieces:
    """The vocabulary as a table of hashes of its pieces and of their prefixes."""

    FACTOR, MIX, BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 19

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces))
        id_of = {p: i for i, p in enumerate(pieces) if p}
        keys = sorted({p[:k] for p in id_of for k in range(1, len(p) + 1)})
        self.bits = max(self.BITS, (4 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.ids = np.full(1 << self.bits, -1, np.int64)
        mask = (1 << 64) - 1
        for key in keys:
            h = 0
            for c in key:
                h = (h * int(self.FACTOR) + ord(c) + 1) & mask
            slot = ((h * int(self.MIX)) & mask) >> (64 - self.bits)
            while self.keys[slot]:
                slot = (slot + 1) % len(self.keys)
            self.keys[slot], self.ids[slot] = h, id_of.get(key, -1)

    def find(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, piece) of all pieces in the code points, none longer
        than what is left of its word; places that no piece of one letter
        covers get the unknown piece."""
        at, hashes = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        begin, size, piece = [], [], []
        for k in range(1, self.longest + 1):
            fits = left[at] >= k
            at, hashes = at[fits], hashes[fits]
            hashes = hashes * self.FACTOR + codes[at + k - 1] + np.uint64(1)
            slot = ((hashes * self.MIX) >> np.uint64(64 - self.bits)).astype(np.int64)
            todo = np.flatnonzero((self.keys[slot] != hashes) & (self.keys[slot] != 0))
            while len(todo):
                slot[todo] = (slot[todo] + 1) % len(self.keys)
                todo = todo[(self.keys[slot[todo]] != hashes[todo]) & (self.keys[slot[todo]] != 0)]
            known = self.keys[slot] == hashes
            found = np.where(known, self.ids[slot], -1)
            if k == 1:
                found_at, found_id = at, np.where(found < 0, UNKNOWN, found)
            else:
                hit = found >= 0
                found_at, found_id = at[hit], found[hit]
            begin.append(found_at)
            size.append(np.full(len(found_at), k))
            piece.append(found_id)
            at, hashes = at[known], hashes[known]
            if not len(at):
                break
        return np.concatenate(begin), np.concatenate(size), np.concatenate(piece)


class Model:
    """Piece probabilities (pieces x languages) and the forward algorithm."""

    def __init__(self, pieces: Pieces, probabilities: np.ndarray, languages: list[str], prior: np.ndarray):
        self.pieces, self.p, self.languages, self.prior = pieces, probabilities, languages, prior
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, len(languages)))

    def __getstate__(self):
        return {**self.__dict__, "place": {}, "rows": self.rows[:0]}

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Words x languages: logarithms of the sum over all segmentations. Words
        above `LONG_WORD` letters go letter by letter with rescaling."""
        out = np.zeros((len(words), len(self.languages)))
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        if short:
            lattice = Lattice(self.pieces, [words[i] for i in short])
            out[short] = np.log(lattice.forward(self.p)[lattice.last])
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[i] = self._long(w)
        return out

    def _long(self, word: str) -> np.ndarray:
        ahead = [np.ones(len(self.languages))] + [np.zeros(len(self.languages))] * self.pieces.longest
        scale = np.zeros(len(self.languages))
        lattice = Lattice(self.pieces, [word])
        for low, high in zip(lattice.bounds[:-1], lattice.bounds[1:], strict=True):
            now = ahead.pop(0)
            ahead.append(np.zeros(len(self.languages)))
            for k, piece in zip((lattice.end - lattice.begin)[low:high].tolist(), lattice.piece[low:high].tolist(), strict=True):
                ahead[k - 1] = ahead[k - 1] + now * self.p[piece]
            factor = 1 / ahead[0]
            scale -= np.log(factor)
            ahead = [a * factor for a in ahead]
        return np.log(ahead[0]) + scale

    def expected(self, words: list[str], language: int, counts: np.ndarray) -> np.ndarray:
        """Expected piece counts of words of one language, by forward and
        backward passes; words above `LONG_WORD` letters are cut into such runs."""
        if max(map(len, words), default=0) > LONG_WORD:
            cut = [(w[i:i + LONG_WORD], n) for w, n in zip(words, counts, strict=True) for i in range(0, len(w), LONG_WORD)]
            words, counts = [w for w, _ in cut], np.array([n for _, n in cut])
        lattice, p = Lattice(self.pieces, words), self.p[:, language]
        forward, backward = lattice.forward(p[:, None])[:, 0], lattice.backward(p)
        share = counts / forward[lattice.last]
        flow = forward[lattice.begin] * p[lattice.piece] * backward[lattice.end] * share[lattice.word]
        return np.bincount(lattice.piece, flow, len(p))

    def _learn(self, words: list[str]) -> None:
        found = self.log_probabilities(words)
        self.place.update(zip(words, range(len(self.rows), len(self.rows) + len(words)), strict=True))
        self.rows = np.vstack([self.rows, found])

    def predict(self, texts: list) -> list[tuple[str, float]]:
        out = []
        for first in range(0, len(texts), PREDICT_TEXTS):
            split = [LETTERS.findall(text.lower()) if text else [] for text in texts[first:first + PREDICT_TEXTS]]
            if not self.languages:
                out += [(UND, 0.0)] * len(split)
                continue
            wanted = set().union(*split)
            if not wanted <= self.place.keys():
                if len(self.place) > CACHED_WORDS:
                    self.place, self.rows = {}, self.rows[:0]
                self._learn([w for w in wanted if w not in self.place])
            for words in split:
                if not words:
                    out.append((UND, 0.0))
                    continue
                at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
                scores = self.prior + self.rows[at].sum(axis=0)
                best = int(np.argmax(scores))
                out.append((self.languages[best], float(1 / np.exp(scores - scores[best]).sum())))
        return out


COUNTS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])


def learn(rows: DataFrame, vocabulary: str | None = None, sample_rows: int = 1000, rounds: int = 3,
          smoothing: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from rows with a language; all of `rows` may be learned from."""
    named = pick(rows, doc_id=id_col, text=text_col, lang=lang_col).where(F.col("lang").isNotNull())
    sizes = {r[0]: r[1] for r in named.groupBy("lang").count().collect()}  # one row per language
    languages = sorted(sizes)
    pieces = load_pieces(vocabulary or default_vocabulary())
    finder, shape = Pieces(pieces), (len(pieces), len(languages))
    if not languages:
        return Model(finder, np.zeros(shape), [], np.zeros(0))

    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, sample_rows / sizes[lang]))) for lang in languages])
    drawn = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 30)) < share * (1 << 30)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words.setdefault(lang, Counter()).update(LETTERS.findall((text or "").lower()))
            flat = [(lang, w, n) for lang, own in words.items() for w, n in own.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], t.type) for i, t in enumerate(COUNTS)],
                                             schema=COUNTS)

    counted = (named.where(drawn).select("lang", "text").mapInArrow(count, "lang string, word string, n bigint")
               .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    spark = rows.sparkSession
    counted = written(counted, "langid-words").repartition(2 * spark.sparkContext.defaultParallelism, "word")
    prior = np.log(np.array([sizes[lang] for lang in languages], float) / sum(sizes.values()))
    # the start: pieces alike, but a letter more costs as much as in a text of even letters
    start = np.array([30.0 ** -max(1, len(p)) for p in pieces])
    probabilities = np.repeat((start / start.sum())[:, None], len(languages), axis=1)
    place = {lang: i for i, lang in enumerate(languages)}
    for _ in range(rounds):
        model = Model(finder, probabilities, languages, prior)
        shared = spark.sparkContext.broadcast(model)  # pieces x languages numbers

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                own: dict[str, tuple[list, list]] = {}
                for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    words, numbers = own.setdefault(lang, ([], []))
                    words.append(word)
                    numbers.append(float(n))
                for lang, (words, numbers) in own.items():
                    sums[lang] = sums.get(lang, 0.0) + shared.value.expected(words, place[lang], np.array(numbers))
            for lang, total in sums.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "piece": at.astype(np.int32), "n": total[at]})

        sums = (counted.mapInArrow(expect, "lang string, piece int, n double")
                .groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect())
        shared.unpersist()
        expected = np.full(shape, smoothing)
        for lang, piece, n in sums:
            expected[piece, place[lang]] += n
        probabilities = expected / expected.sum(axis=0)
    return Model(finder, probabilities, languages, prior)


PREDICTED = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])


def predict(documents: DataFrame, model: Model, carry: dict[str, str] | None = None, text_col: str = "text") -> DataFrame:
    """Columns `carry` (name in the result: column), lang_pred and score of every row."""
    carry = carry or {"doc_id": "doc_id"}
    rows = pick(documents, **{f"_{i}": c for i, c in enumerate(carry.values())}, _text=text_col)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found = shared.value.predict(texts)
            columns = [*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()),
                       pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "lang_pred", "score"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(score, f"{kinds}, lang_pred string, score double").toDF(*carry, "lang_pred", "score")


def held_out(doc_id: Column) -> Column:
    """Rows that a model for evaluation doesn't learn from: a quarter by checksum of the id (a null id isn't held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(documents: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                lang_col: str = "lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that aren't held out, predicted for all."""
    rows = pick(documents, doc_id=id_col, text=text_col, lang=lang_col)
    rows = rows.withColumn("held_out", held_out(F.col("doc_id")))
    model = learn(rows.where(~F.col("held_out")), vocabulary, **options)
    return predict(rows, model, {"doc_id": "doc_id", "held_out": "held_out"})

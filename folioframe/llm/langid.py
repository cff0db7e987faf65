"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary (lower-case letters, with its mark of a word's start), plus all single
bytes, so every word has a segmentation. Per language each piece has a probability; the probability of a word is the sum
over all its segmentations, found by a forward pass over its bytes; a text's is the product over its words. Training is
expectation maximisation: forward-backward gives the expected use of each piece, Spark sums it over all distinct words of
the sample, and the driver holds pieces x languages numbers only.

The sample: of each language about ``max_train_docs`` labelled documents, chosen by a hash of the id against a threshold
that follows from exact counts. Prediction reads the text and nothing else.

Defined results: null texts and texts without a letter get ``und`` and score 0; so does every text if no language was
learned; ties go to the first language in alphabetical order; repeated rows give repeated result rows; documents with
null language are not learned from; a null id counts as the empty text; other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..session import materialize
from .common import map_texts

DEFAULT_VOCABULARY = "piece_bpe_32k.model"
MAX_TRAIN_DOCS = 3000
MAX_LANGUAGES = 500
ROUNDS = 3
SMOOTHING = 0.01
UNKNOWN = "und"
START = "▁"
LETTERS = regex.compile(r"\p{L}+")


class Pieces:
    """The vocabulary as a byte trie: ``step[node, byte]`` is the next node, ``piece[node]`` the piece that ends there."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = sorted({p for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i) and not model.is_byte(i)
                        for p in [model.id_to_piece(i)] if p == p.lower() and all(c.isalpha() or c == START for c in p)})
        units = sorted({n.encode() for n in names} | {bytes([b]) for b in range(256)})
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for k, unit in enumerate(units):
            at = 0
            for b in unit:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    ends.append(-1)
                at = children[at][b]
            ends[at] = k
        self.step = np.full((len(children), 256), -1, dtype=np.int32)
        for at, nexts in enumerate(children):
            for b, to in nexts.items():
                self.step[at, b] = to
        self.piece = np.array(ends, dtype=np.int32)
        self.size = len(units)

    def lattice(self, words: list[str]) -> Lattice:
        return Lattice(self, words)


class Lattice:
    """All pieces that match anywhere in some words, ordered by where they end.

    Position 0 of a word is its start; ``first`` is the place of that in arrays over all positions of all words.
    """

    def __init__(self, pieces: Pieces, words: list[str]):
        raw = [(START + w).encode() for w in words]
        lengths = np.array([len(r) for r in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.first = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        self.last = self.first + lengths
        self.positions = int(lengths.sum()) + len(words)
        word_of = np.repeat(np.arange(len(words)), lengths)
        begin = np.cumsum(lengths) - lengths
        rel = np.arange(len(data)) - begin[word_of]
        left = lengths[word_of] - rel               # bytes from here to the word's end
        node, at = np.zeros(len(data), dtype=np.int32), np.arange(len(data))
        found = []
        k = 0
        while len(at):
            node = pieces.step[node, data[at + k]]
            k += 1
            good = node >= 0
            node, at = node[good], at[good]
            ends = pieces.piece[node]
            hit = ends >= 0
            found.append((at[hit], np.full(int(hit.sum()), k), ends[hit]))
            more = left[at] > k
            node, at = node[more], at[more]
        start = np.concatenate([f[0] for f in found]) if found else np.zeros(0, dtype=np.int64)
        size = np.concatenate([f[1] for f in found]) if found else np.zeros(0, dtype=np.int64)
        self.piece = np.concatenate([f[2] for f in found]) if found else np.zeros(0, dtype=np.int32)
        source = self.first[word_of[start]] + rel[start]
        target = source + size
        step = rel[start] + size
        order = np.lexsort((target, step))
        self.source, self.target, self.piece, self.word = source[order], target[order], self.piece[order], word_of[start][order]
        step = step[order]
        # the pieces that end at one position of one word are neighbours: (from, to, first of each position, position)
        self.steps = []
        borders = np.concatenate([np.nonzero(np.diff(step, prepend=-1))[0], [len(step)]])
        for lo, hi in zip(borders, borders[1:]):
            heads = np.nonzero(np.diff(self.target[lo:hi], prepend=-1))[0]
            self.steps.append((lo, hi, heads, self.target[lo:hi][heads]))

    def forward(self, logp: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all segmentations up to each position; ``logp`` is pieces x languages."""
        alpha = np.full((self.positions, logp.shape[1]), -np.inf)
        alpha[self.first] = 0
        for lo, hi, heads, places in self.steps:
            value = alpha[self.source[lo:hi]] + logp[self.piece[lo:hi]]
            top = np.maximum.reduceat(value, heads, axis=0)
            value -= np.repeat(top, np.diff(heads, append=hi - lo), axis=0)
            alpha[places] = top + np.log(np.add.reduceat(np.exp(value), heads, axis=0))
        return alpha

    def words_logp(self, logp: np.ndarray) -> np.ndarray:
        return self.forward(logp)[self.last]

    def expected(self, logp: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece in ``counts`` copies of the words; ``logp`` has one column."""
        alpha = self.forward(logp)[:, 0]
        beta = np.full(self.positions, -np.inf)
        beta[self.last] = 0
        for lo, hi, _, _ in reversed(self.steps):
            np.logaddexp.at(beta, self.source[lo:hi], beta[self.target[lo:hi]] + logp[self.piece[lo:hi], 0])
        weight = alpha[self.source] + logp[self.piece, 0] + beta[self.target] - alpha[self.last][self.word]
        return np.bincount(self.piece, np.exp(weight) * counts[self.word], len(logp))


@functools.lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def _word_counts(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    rows = df.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        for batch in batches:
            counts: dict = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = counts.setdefault(lang, {})
                for word in LETTERS.findall(text.lower()) if text else ():
                    own[word] = own.get(word, 0) + 1
            flat = [(lang, w, n) for lang, own in counts.items() for w, n in own.items()]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([f[0] for f in flat], pa.string()), "word": pa.array([f[1] for f in flat], pa.string()),
                                              "n": pa.array([f[2] for f in flat], pa.int64())})

    return rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _expected_use(words: DataFrame, path: str, tables: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    def run(batches):
        pieces = pieces_of(path)
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            rows = batch.to_pandas()
            for lang, part in rows.groupby("lang"):
                got = pieces.lattice(part["word"].tolist()).expected(tables[lang][:, None], part["n"].to_numpy(dtype=float))
                totals[lang] = totals.get(lang, 0) + got
        for lang, total in totals.items():
            used = np.nonzero(total)[0]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(used), pa.string()), "piece": pa.array(used, pa.int32()), "n": pa.array(total[used], pa.float64())})

    size = len(next(iter(tables.values())))
    sums = words.mapInArrow(run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    out = {lang: np.zeros(size) for lang in tables}
    got = sums.toPandas()           # at most pieces x languages rows
    for lang, part in got.groupby("lang"):
        out[lang][part["piece"].to_numpy()] = part["n"].to_numpy()
    return out


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", path: str | None = None,
          max_train_docs: int = MAX_TRAIN_DOCS, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Language -> log probability of each piece, learned from the labelled rows of ``df``."""
    where = path or public_tokenizers.path(DEFAULT_VOCABULARY)
    labelled = df.where(F.col(f"`{lang_col}`").isNotNull())
    counts = labelled.groupBy(F.col(f"`{lang_col}`").alias("lang")).count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    span = 1 << 30
    draw = F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(span))
    bound = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(span, span * max_train_docs // r["count"])))])
    sample = labelled.where(draw < bound[F.col(f"`{lang_col}`")])
    words = materialize(_word_counts(sample, text_col, lang_col), "langid-words")
    size = pieces_of(where).size
    tables = {r["lang"]: np.full(size, -np.log(size)) for r in counts}
    for _ in range(rounds):
        for lang, n in _expected_use(words, where, tables).items():
            tables[lang] = np.log((n + SMOOTHING) / (n.sum() + SMOOTHING * size))
    return tables


def predict(df: DataFrame, model: dict[str, np.ndarray], keep: list[str], text_col: str = "text", path: str | None = None) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score``, the posterior of that language under equal priors."""
    where = path or public_tokenizers.path(DEFAULT_VOCABULARY)
    langs = sorted(model)
    logp = np.stack([model[x] for x in langs], axis=1) if langs else np.zeros((0, 0))       # pieces x languages
    shared = df.sparkSession.sparkContext.broadcast(logp)
    schema = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def make():
        pieces, table = pieces_of(where), shared.value

        def run(texts: list) -> list:
            number: dict[str, int] = {}
            ids, sizes = [], []
            for text in texts:
                found = LETTERS.findall(text.lower()) if text and langs else []
                sizes.append(len(found))
                ids.extend([number.setdefault(w, len(number)) for w in found])
            named = [UNKNOWN] * len(texts)
            score = np.zeros(len(texts))
            size = np.array(sizes)
            full = np.nonzero(size)[0]
            if len(full):
                each = pieces.lattice(list(number)).words_logp(table)
                # exact sums: equal texts get equal scores in whatever piece they come
                counts = np.add.reduceat(np.round(each * 2 ** 20).astype(np.int64)[np.array(ids)], (np.cumsum(size) - size)[full], axis=0)
                total = counts / 2 ** 20
                total -= total.max(axis=1, keepdims=True)
                best = total.argmax(axis=1)
                posterior = 1 / np.exp(total).sum(axis=1)
                for i, b, p in zip(full, best, posterior):
                    named[i] = langs[b]
                    score[i] = p
            return [named, score]

        return run

    return map_texts(df, text_col, keep, schema, make)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % 4 == 2


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", path: str | None = None,
             max_train_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """Learn from the rows outside the fold and predict every row: id, ``held_out``, ``lang_pred``, ``score``."""
    model = train(df.where(~held_out(id_col)), text_col, lang_col, id_col, path, max_train_docs)
    rows = df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("__body"))
    return predict(rows, model, [id_col], "__body", path).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")

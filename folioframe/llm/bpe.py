"""BPE encoding by depth-first traversal of a prefix trie, and decoding.

The encoding of a prefix ends in exactly one token, and a sequence of tokens is an encoding exactly if each pair of
neighbours is: no merge across their border would have been made before either side was complete. So the state of a
prefix is its last token: the token that ends there and is compatible with the state where it starts. The distinct words
of a piece of text are inserted into a trie, and one traversal gives each node its state; a prefix that many words share
is encoded once. A word's ids are read off its path backwards.

Words that carry an end-of-word suffix end in a symbol of their own, so they are leaves.

Defined results: a null or empty text has no ids and decodes to the empty string; repeated rows give repeated result
rows; an empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType
from tokenizers import Regex, pre_tokenizers

from .common import map_texts

DEFAULT_VOCABULARY = "word_bpe_49k.json"
# encoded chunks and words in each of the two generations that a worker remembers
REMEMBERED = 250_000
# white space of the vocabulary's patterns; str.split() also cuts at these four controls
CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f")
WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")
LAST = 256      # added to the byte of a symbol that ends a word


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tokens as strings of symbols (``chr(byte)``, or ``chr(byte + LAST)`` at a word's end) and how they merge."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        byte_of = {c: b for b, c in enumerate(byte_letters())}

        def symbols(name: str) -> str:
            ends = bool(suffix) and name.endswith(suffix)
            body = [byte_of[c] for c in (name[:-len(suffix)] if ends else name)]
            return "".join(map(chr, body[:-1])) + chr(body[-1] + LAST * ends)

        self.marks_end = bool(suffix)
        self.id_of = {}
        for name, i in model["vocab"].items():
            if i not in self.special.values() and all(c in byte_of for c in name.removesuffix(suffix)) and name != suffix:
                self.id_of[symbols(name)] = i
        self.rank, self.parts = {}, {}
        for r, pair in enumerate(model["merges"]):
            a, b = (symbols(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.rank[a, b] = r
            self.parts.setdefault(a + b, (a, b, r))
        self._spines: tuple[dict, dict] = ({}, {})
        # a token that its own merges do not reach is never an ending
        self.tokens = {s for s in self.id_of if len(s) == 1 or s in self.parts and self.fits(*self.parts[s][:2], within=self.parts[s][2])}
        self.longest = max(map(len, self.tokens))
        # True for a token, False for what only ends one: a walk back from a position stops where this has no entry
        self.endings = {s[-n:]: False for s in self.tokens for n in range(1, len(s) + 1)} | dict.fromkeys(self.tokens, True)
        self.follow: dict[str, dict[str, bool]] = {}

    def _spine(self, token: str, side: int) -> list:
        """What stands at one end of a token while it is built: (part, rank of the merge that ends it), bottom up."""
        if (got := self._spines[side].get(token)) is None:
            got, end = [], float("inf")
            while True:
                got.append((token, end))
                if token not in self.parts:
                    break
                a, b, end = self.parts[token]
                token = b if side else a
            got.reverse()
            self._spines[side][got[-1][0]] = got
        return got

    def fits(self, left: str, right: str, within: float = float("inf")) -> bool:
        """True if no merge across the border comes before both tokens are complete (before rank ``within``)."""
        a, b = self._spine(left, 1), self._spine(right, 0)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            r = self.rank.get((x, y))
            # of equal merges the leftmost is made first
            if r is not None and r < within and r < x_ends and r <= y_ends:
                return False
            if i == len(a) - 1 and j == len(b) - 1:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(maxsize=4)
def token_names(path: str) -> np.ndarray:
    """The string of each id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    names = {i: s for s, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return np.array([names.get(i, "") for i in range(max(names) + 1)], dtype=object)


def build_trie(words: list[str]) -> dict:
    """Nested dictionaries from symbol to child; a word of symbols ends at an empty one, or one marked by ''."""
    root: dict = {}
    for word in words:
        node = root
        for symbol in word:
            nxt = node.get(symbol)
            if nxt is None:
                nxt = node[symbol] = {}
            node = nxt
        node[""] = word
    return root


def encode_trie(trie: dict, vocab: Vocabulary) -> dict[str, list[int]]:
    """Ids of every word of ``trie``, by one depth-first traversal."""
    endings, follow, id_of, longest = vocab.endings.get, vocab.follow, vocab.id_of, vocab.longest
    out: dict[str, list[int]] = {}
    states: list = [None]               # states[d]: last token of the path's first d symbols
    stack = [(trie, "", 0)]
    while stack:
        node, tail, depth = stack.pop()
        if depth:
            del states[depth:]
            state = None
            for n in range(1, len(tail) + 1):
                token = tail[-n:]
                kind = endings(token)
                if kind is None:
                    break
                if kind:
                    if n == depth:
                        state = token
                        break
                    before = states[depth - n]
                    if before is not None:
                        known = follow.get(before)
                        if known is None:
                            known = follow[before] = {}
                        good = known.get(token)
                        if good is None:
                            good = known[token] = vocab.fits(before, token)
                        if good:
                            state = token
                            break
            states.append(state)
        for symbol, child in node.items():
            if symbol:
                stack.append((child, (tail + symbol)[-longest:], depth + 1))
            else:
                ids, at = [], depth
                while at > 0:
                    token = states[at]
                    ids.append(id_of[token])
                    at -= len(token)
                ids.reverse()
                out[child] = ids
    return out


def word_symbols(word: str, marks_end: bool) -> str:
    raw = word.encode("utf-8").decode("latin-1")
    return raw[:-1] + chr(ord(raw[-1]) + LAST) if marks_end else raw


class Encoder:
    """Encodes whole texts; remembers the ids of words and of the chunks between white space."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.vocab, self.remembered = vocabulary(path), remembered
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.older: tuple[dict, dict] = ({}, {})
        # the library's own rule decides where a chunk is cut, as classes of letters differ between Unicode versions
        self.cut = pre_tokenizers.Split(Regex(self.vocab.pattern), "removed", invert=True).pre_tokenize_str
        special = sorted(self.vocab.special, key=len, reverse=True)
        self.specials = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.hints = {s[:2] for s in special}

    def _split(self, text: str) -> list[str]:
        """The text's normal form, cut at white space."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()       # letter by letter, so without the final form
        if any(c in text for c in CONTROLS):
            return [c for c in WHITE.split(text) if c]
        return text.split()

    def _words(self, chunk: str) -> list[str]:
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk]
            if chunk[:-1].isalpha() and not chunk[-1].isalnum():
                return [chunk[:-1], chunk[-1]]
        return [w for w, _ in self.cut(chunk)]

    def _learn(self, chunks: set[str]) -> None:
        """Encode new chunks: those of their words that are new go through one trie."""
        for chunk in chunks & self.older[0].keys():
            self.chunks[chunk] = self.older[0][chunk]
        words_of = {c: self._words(c) for c in chunks.difference(self.chunks)}
        for word in {w for words in words_of.values() for w in words} & self.older[1].keys():
            self.words[word] = self.older[1][word]
        new = {w for words in words_of.values() for w in words}.difference(self.words)
        form = {word_symbols(w, self.vocab.marks_end): w for w in new}
        for symbols, ids in encode_trie(build_trie(list(form)), self.vocab).items():
            self.words[form[symbols]] = struct.pack(f"<{len(ids)}I", *ids)
        words, join = self.words, b"".join
        for chunk, parts in words_of.items():
            self.chunks[chunk] = words[parts[0]] if len(parts) == 1 else join([words[w] for w in parts])

    def encode(self, texts: list) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        rows: list[list[tuple[int | None, list[str]]]] = []
        for text in texts:
            if not text:
                rows.append([])
            elif self.specials is None or not any(h in text for h in self.hints):
                rows.append([(None, self._split(text))])
            else:
                rows.append([(self.vocab.special[part], []) if k % 2 else (None, self._split(part))
                             for k, part in enumerate(self.specials.split(text))])
        asked = set().union(*[chunks for row in rows for _, chunks in row])
        if len(self.chunks) + len(self.words) + len(asked) > self.remembered:
            self.older, self.chunks, self.words = (self.chunks, self.words), {}, {}
        self._learn(asked.difference(self.chunks))
        known, join = self.chunks.__getitem__, b"".join
        return [join([join(map(known, chunks)) if one is None else struct.pack("<I", one) for one, chunks in row]) for row in rows]


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(df: DataFrame, keep: list[str], text_col: str = "text", path: str | None = None) -> DataFrame:
    """``keep`` columns with ``n_tokens``, ``ids`` and ``ids_sha256`` (over little-endian unsigned 32-bit integers)."""
    where = path or public_tokenizers.path(DEFAULT_VOCABULARY)
    schema = StructType([StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType())), StructField("ids_sha256", StringType())])

    def make():
        enc = encoder(where)

        def run(texts: list) -> list:
            raw = enc.encode(texts)
            counts = [len(r) // 4 for r in raw]
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), dtype="<i4")))
            return [counts, ids, [hashlib.sha256(r).hexdigest() for r in raw]]

        return run

    return map_texts(df, text_col, keep, schema, make)


def decode(df: DataFrame, keep: list[str], ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``keep`` columns with ``decoded``: the tokens' strings, joined by blanks as a vocabulary without a decoder does."""
    where = path or public_tokenizers.path(DEFAULT_VOCABULARY)
    schema = StructType([StructField("decoded", StringType())])

    def make():
        names = token_names(where)

        def run(lists: pa.ListArray) -> list:
            offsets = lists.offsets.to_numpy()
            strings = names[lists.values.to_numpy()[offsets[0]:offsets[-1]]].tolist()
            at = (offsets - offsets[0]).tolist()
            return [[" ".join(strings[a:b]) for a, b in zip(at, at[1:])]]

        return run

    return map_texts(df, ids_col, keep, schema, make)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row: ``id_col``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``."""
    encoded = encode(df, [id_col], text_col, path)
    back = decode(encoded, [id_col, "n_tokens", "ids_sha256"], "ids", path)
    return back.select(id_col, "n_tokens", "ids_sha256", F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))

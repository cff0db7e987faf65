import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from folioframe.llm import bpe
from tokenizers import Tokenizer

PATH = public_tokenizers.path(bpe.DEFAULT_VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    rnd = random.Random(5)
    fixed = ["", " \n\t", "don't I'LL we've", "<|endoftext|>x<|startoftext|><|endoftext|> <|end", "ΑΣ ΣΑΣ. İstanbul ﬁ", "a\x1cb\x1f \x85c\xa0d",
             "é́ é ́ Ⅳ½² 漢字かな 👩‍👩‍👧", "aaaaaaa bbbbbbbbb!!!!!!!!????", "֋֌͸x", "ab" * 3000, "1234567 12,5 a1b2"]
    alphabet = "ab'sth!?. é12ñ\n"
    return fixed + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 50))) for _ in range(500)] + \
        ["".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(160, 0x24F), rnd.randint(0x370, 0x52F), rnd.randint(0x3041, 0x9FFF)])) for _ in range(30)) for _ in range(300)]


def test_ids_equal_the_librarys(library):
    enc = bpe.Encoder(PATH, remembered=2000)          # small enough to change generations on the way
    texts = odd_texts()
    for lo in range(0, len(texts), 100):
        part = texts[lo:lo + 100]
        got = [np.frombuffer(r, dtype="<u4").tolist() for r in enc.encode(part)]
        assert got == [x.ids for x in library.encode_batch(part, add_special_tokens=False)]


def test_prefixes_are_encoded_once(monkeypatch):
    vocab = bpe.vocabulary(PATH)
    words = [bpe.word_symbols(w, True) for w in ("inter", "internal", "international", "internationally")]
    trie = bpe.build_trie(words)

    def nodes(t):
        return sum(1 + nodes(c) for s, c in t.items() if s)

    assert nodes(trie) < sum(map(len, words))
    assert set(bpe.encode_trie(trie, vocab)) == set(words)


def test_query_on_whole_table(spark, sf_dir, library):
    from folioframe.llm.queries import QUERIES
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op6_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(odd_docs, library):
    rows = bpe.encode(odd_docs, ["doc_id", "n"], "text").collect()
    texts = {r.n: r.text for r in odd_docs.collect()}
    assert len(rows) == odd_docs.count()
    back = bpe.decode(bpe.encode(odd_docs, ["doc_id"], "text"), ["doc_id"]).collect()
    assert {r.decoded for r in back if r.doc_id in (1, 2, 3)} == {""}
    for r in rows:
        if r.doc_id is not None:
            text = next(x.text for x in odd_docs.where(f"doc_id = {r.doc_id}").collect())
            assert r.ids == library.encode(text or "", add_special_tokens=False).ids
    assert len(texts)
    assert bpe.round_trip(odd_docs.where("false")).count() == 0

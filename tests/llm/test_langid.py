import math

import numpy as np
import public_tokenizers
import pytest
from folioframe.llm import langid
from pyspark.sql import functions as F

PATH = public_tokenizers.path(langid.DEFAULT_VOCABULARY)


def strings(pieces):
    out = {}
    todo = [(0, b"")]
    while todo:
        node, text = todo.pop()
        if pieces.piece[node] >= 0:
            out[text] = int(pieces.piece[node])
        todo += [(int(n), text + bytes([b])) for b, n in enumerate(pieces.step[node]) if n >= 0]
    return out


def brute(text, number, logp):
    """All segmentations of some bytes: their summed probability and the expected uses of each piece."""
    found = []

    def walk(at, used):
        if at == len(text):
            found.append(used)
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in number:
                walk(end, [*used, number[text[at:end]]])

    walk(0, [])
    p = [math.exp(sum(logp[i] for i in f)) for f in found]
    use = {}
    for f, w in zip(found, p):
        for i in f:
            use[i] = use.get(i, 0) + w / sum(p)
    return math.log(sum(p)), use


def test_forward_and_expected_against_all_segmentations():
    pieces = langid.pieces_of(PATH)
    number = strings(pieces)
    assert len(number) == pieces.size
    rng = np.random.default_rng(1)
    logp = np.log(rng.dirichlet(np.ones(pieces.size)))
    words = ["the", "über", "a", "ñandú", "zz"]
    lattice = pieces.lattice(words)
    got = lattice.words_logp(logp[:, None])[:, 0]
    use = lattice.expected(logp[:, None], np.array([1.0, 2, 3, 4, 5]))
    want = np.zeros(pieces.size)
    for w, n, g in zip(words, (1, 2, 3, 4, 5), got):
        total, each = brute(("▁" + w).encode(), number, logp)
        assert g == pytest.approx(total)
        for i, x in each.items():
            want[i] += n * x
    assert np.allclose(use, want)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    rows = langid.identify(docs).join(docs, "doc_id").where("held_out")
    right = rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right[0] >= 0.98 and right[1] > 150
    assert rows.where("score < 0 or score > 1").count() == 0


def test_labels_and_ids_are_not_inputs(make_docs):
    """Equal texts get equal answers whatever stands beside them, and nothing is learned from held-out rows."""
    import zlib
    texts = {"en": "the house and the river with the morning", "de": "das haus und der fluss mit dem morgen"}
    rows = [(i, texts["en" if i % 2 else "de"], "en" if i % 2 else "de") for i in range(200)]
    rows += [(1000 + i, "the house and the river", ["de", None, "xx"][i % 3]) for i in range(200) if zlib.crc32(str(1000 + i).encode()) % 4 == 2]
    got = langid.identify(make_docs(rows)).collect()
    assert {(r.lang_pred, r.score) for r in got if r.doc_id >= 1000} == {("en", next(r.score for r in got if r.doc_id >= 1000))}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_odd_rows(odd_docs):
    rows = langid.identify(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id in (1, 2, 3)} == {("und", 0.0)}
    assert all(r.lang_pred in ("en", "de", "fr", "und") for r in rows)
    assert langid.identify(odd_docs.where("false")).count() == 0
    assert {r.lang_pred for r in langid.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}

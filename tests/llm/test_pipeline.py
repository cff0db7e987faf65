import numpy as np
import public_tokenizers
from folioframe.llm import bpe, mixing, quality
from pyspark.sql import functions as F
from test_linedup import brute as lines_brute
from test_mixing import brute as mixing_brute
from test_neardup import brute as groups_brute
from tokenizers import Tokenizer

import corpus_pipeline


def test_against_plain_stages(spark, sf_dir):
    """Each stage does to its input what the plain version does to it, and the whole is their chain."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table, columns = docs, docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in table.collect()}
        copies = table.count()
        table = corpus_pipeline.materialize(stage(spark, table, sf_dir), f"test-{name}")
        rows = table.collect()
        if name == "quality_rules":
            kept = {r.doc_id for r in quality.rate(docs).where("kept").collect()}
            assert {r.doc_id for r in rows} == kept and 0 < len(kept) < len(before)
        elif name == "line_dedup":
            assert {r.doc_id: r.text for r in rows} == lines_brute([(i, r.text) for i, r in before.items()])
        elif name == "near_dedup":
            assert {r.doc_id for r in rows} == set(groups_brute([(i, r.text) for i, r in before.items()]).values())
        elif name == "mix_sources":
            total = sum(len(r.text.split()) for r in before.values())
            want, _ = mixing_brute([(i, r.text, r.source) for i, r in sorted(before.items())], corpus_pipeline.MIX_ENTROPY, corpus_pipeline.MIX_REPEATS,
                                   int(total * corpus_pipeline.MIX_BUDGET), mixing.BLOCK_TOKENS)
            assert sorted(r.doc_id for r in rows) == sorted(want.elements())
        else:
            assert len(rows) == copies
            library = Tokenizer.from_file(public_tokenizers.path(bpe.DEFAULT_VOCABULARY))
            for r in rows:
                assert r.ids == library.encode(before[r.doc_id].text, add_special_tokens=False).ids
        if name != "encode":
            assert table.columns == columns
        seen.append(sorted((r.doc_id for r in rows)))
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()) == seen[-1]
    assert np.all([len(s) > 0 for s in seen])


def test_odd_rows_through_all_stages(spark, odd_docs):
    for make in (odd_docs, odd_docs.where("false"), odd_docs.select(*[F.lit(None).cast(t).alias(c) for c, t in odd_docs.dtypes])):
        table = make
        for name, stage in corpus_pipeline.STAGES:
            table = corpus_pipeline.materialize(stage(spark, table, ""), f"odd-{name}")
            if name != "encode":
                assert table.columns == odd_docs.columns
        assert table.count() <= make.count()

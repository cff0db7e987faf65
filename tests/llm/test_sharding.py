import hashlib

from folioframe.llm import sharding


def brute(sizes, limit):
    """Extendible hashing by hand: (id, bytes) -> leading bits of its shard."""
    bits = {i: format(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), "060b") for i, _ in sizes}
    buckets = {"": [i for i, _ in sizes]}
    size = dict(sizes)
    while over := [b for b, ids in buckets.items() if sum(size[i] for i in ids) > limit and len({bits[i] for i in ids}) > 1]:
        for b in over:
            ids = buckets.pop(b)
            for bit in "01":
                if part := [i for i in ids if bits[i][len(b)] == bit]:
                    buckets[b + bit] = part
    return {i: b for b, ids in buckets.items() for i in ids}


def test_against_brute_force(make_docs):
    rows = [(i, "x" * (i * 37 % 300)) for i in range(400)] + [(1000, "y" * 5000)]
    want = brute([(i, len(t)) for i, t in rows], 700)
    for page_bits in (15, 3):           # 3: the directory has several pages
        got = sharding.assign(make_docs(rows), limit_bytes=700, page_bits=page_bits).collect()
        assert {r.doc_id: r.shard for r in got} == want
        assert all(r.fits == (r.shard_bytes <= 700) for r in got)
        assert [r.doc_id for r in got if not r.fits] == [1000]
        assert len({r.depth for r in got}) > 1


def test_native_plan(make_docs):
    plan = sharding.assign(make_docs([(1, "a"), (2, "b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowEval", "Python")


def test_written_shards(spark, make_docs, tmp_path):
    rows = [(i, "z" * 50) for i in range(60)]
    sharding.write_shards(make_docs(rows), str(tmp_path / "out"), limit_bytes=1000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 60
    assert all(r["count"] * 50 <= 1000 for r in back.groupBy("__shard").count().collect())


def test_odd_rows(odd_docs):
    rows = sharding.assign(odd_docs, limit_bytes=100).collect()
    assert len(rows) == odd_docs.count()
    assert {r.bytes for r in rows if r.doc_id in (1, 2)} == {0}
    same = [r for r in rows if r.doc_id == 5]
    assert len(same) == 2 and same[0].shard == same[1].shard
    assert not next(r for r in rows if r.doc_id == 7).fits
    assert sharding.assign(odd_docs.where("false")).count() == 0

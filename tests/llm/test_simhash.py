import random
from itertools import combinations

import pytest
import xxhash
from folioframe.llm import simhash


def fingerprint(text, words=4):
    w = [x for x in "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()]
    parts = [b" ".join(w[i:i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, words=4):
    fps = {i: fingerprint(t, words) for i, t in rows}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (fps[i], find(i)) for i in fps}


def test_position_sets_cover():
    for width, shared in ((3, 4), (4, 4), (2, 3)):
        sets = simhash.position_sets(width, shared)
        assert all(any(set(s) <= set(q) for s in sets) for q in combinations(range(8), shared))
    assert len(simhash.position_sets(3, 4)) == 20


def corpus(seed=3):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        base = rnd.choices(words, k=rnd.choice([3, 5, 80, 200]))
        rows.append((i * 10, " ".join(base)))
        for k in range(rnd.randint(0, 4)):
            changed = list(base)
            changed[rnd.randrange(len(base))] = rnd.choice(words)
            rows.append((i * 10 + 1 + k, " ".join(changed)))
    return rows + [(9001, ""), (9002, None), (9003, " \n"), (9004, "W1 W2"), (9005, "w1 w2")]


@pytest.mark.parametrize("wide_from", [0, 10 ** 6])
def test_against_brute_force(make_docs, monkeypatch, wide_from):
    monkeypatch.setattr(simhash, "WIDE_FROM", wide_from)
    monkeypatch.setattr(simhash.links, "__defaults__", ("simhash", 4, wide_from))
    rows = corpus()
    want = brute(rows)
    got = {r.doc_id: (r.fp & (2 ** 64 - 1), r.component_id) for r in simhash.near_duplicates(make_docs(rows)).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_links_over_chains(spark):
    """Fingerprints in a chain of single steps, and a dense ball, end in one component each."""
    chain = [(1 << k) - 1 for k in range(0, 60, 3)]
    ball = [(0xABCDEF0123456789 ^ (1 << a) ^ (1 << b)) for a in range(20) for b in range(a)]
    far = [0x5555555555555555]
    signed = [x - 2 ** 64 if x >= 2 ** 63 else x for x in chain + ball + far]
    fps = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = simhash.components(simhash.links(fps), "t")
    groups = {}
    for r in roots.collect():
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, groups.values())) == [len(chain), len(ball)]


def test_keep_one_and_odd_rows(odd_docs):
    got = simhash.keep_one(odd_docs)
    assert got.columns == odd_docs.columns
    rows = got.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 4, 5, 7, 8, 9]      # 2, 3 and a row without id are blank like 1
    assert [r.text for r in rows if r.doc_id is None] == ["without an id at all"]
    full = simhash.near_duplicates(odd_docs).collect()
    assert len(full) == odd_docs.count()
    assert {r.component_id for r in full if r.doc_id in (1, 2, 3)} == {1}


def test_empty_table(odd_docs):
    assert simhash.near_duplicates(odd_docs.where("false")).count() == 0
    assert simhash.keep_one(odd_docs.where("false")).count() == 0

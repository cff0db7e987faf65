import random
from itertools import combinations

from folioframe.llm import neardup
from test_simhash import brute as fingerprint_groups

import corpus_pipeline


def shingles(text, k=5):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows):
    """doc_id -> smallest id of its group; groups by Jaccard similarity of five-word shingles of 0.8 or more."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"w{int(rnd.paretovariate(0.8)) % 500}" for _ in range(900)]
    rows = []
    for i in range(40):
        base = rnd.choices(words, k=rnd.choice([1, 3, 6, 40, 90, 250]))
        rows.append((i * 20, " ".join(base)))
        for k in range(rnd.randint(0, 12)):        # chains too: each copy is made from the one before
            base = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                base[rnd.randrange(len(base))] = rnd.choice(words)
            rows.append((i * 20 + 1 + k, " ".join(base)))
    return rows + [(9001, ""), (9002, None), (9003, " \n"), (9004, "W1 W2"), (9005, "w1 w2")]


def test_stage_against_brute_force(spark, make_docs):
    """Fails with groups of 4 bits of a fingerprint, which miss most texts that are alike and not equal."""
    rows = corpus(1)
    want = set(brute(rows).values())
    got = corpus_pipeline.near_dedup(spark, make_docs(rows, 3), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)
    assert len(want) < len({c for _, c in fingerprint_groups(rows, corpus_pipeline.SHINGLE_WORDS).values()})


def test_repeated_ids_and_odd_rows(make_docs, odd_docs):
    text = " ".join(f"a{i}" for i in range(50))
    rows = [(1, text), (2, text + " end"), (2, "quite another text stands under the same id"), (3, "x y z"), (3, "x y z")]
    got = neardup.keep_one(make_docs(rows))
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted({rows[0], rows[2], rows[3]})
    got = neardup.keep_one(odd_docs)
    assert got.columns == odd_docs.columns
    rows = got.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 4, 5, 7, 8, 9]
    assert [r.text for r in rows if r.doc_id is None] == ["without an id at all"]
    assert neardup.keep_one(odd_docs.where("false")).count() == 0


def test_simhash_names_the_first_pairs(make_docs, monkeypatch):
    """The stage takes pairs from fingerprints, and the prefix join adds those that differ in more bits."""
    asked = []
    monkeypatch.setattr(neardup, "links", lambda fps, label, real=getattr(neardup, "links", None): asked.append(fps.count()) or real(fps, label))
    text = " ".join(f"a{i}" for i in range(300))
    far = " ".join(f"b{i}" for i in range(60))
    rows = [(1, text), (2, text + " end"), (3, far), (4, far.replace("b30", "c")), (5, "alone")]
    got = corpus_pipeline.near_dedup(None, make_docs(rows), "")
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 5] and asked and asked[0] >= 3

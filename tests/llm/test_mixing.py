import hashlib
import math
from collections import Counter, defaultdict

import pytest
from folioframe.llm import mixing


def number(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def brute(rows, entropy, max_repeats, budget, block_tokens):
    """Copies of each (doc_id, text, source) that are taken, by plain loops."""
    toks = {i: len(t.split()) for i, t, _ in rows}
    total = Counter()
    for i, _, s in rows:
        total[s] += toks[i]
    total = {s: n for s, n in total.items() if n}
    share = {s: n / sum(total.values()) for s, n in total.items()}
    top = 1 << mixing.GRID

    def weights(k):
        u = {s: p ** (k / top) for s, p in share.items()}
        return {s: x / sum(u.values()) for s, x in u.items()}

    def h(k):
        return -sum(w * math.log(w) for w in weights(k).values())

    def repeats(k):
        return max(w * budget / total[s] for s, w in weights(k).items())

    lo, hi = 0, top
    if h(top) < entropy * math.log(len(share)):
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if h(mid) >= entropy * math.log(len(share)) else (lo, mid)
        k = lo
    else:
        k = top
    if repeats(k) > max_repeats:
        lo, hi = 0, top
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if repeats(mid) <= max_repeats else (mid, hi)
        k = max(k, hi)
    taken = Counter()
    for s, w in weights(k).items():
        want = math.floor(round(w, 12) * budget)
        docs = [i for i, _, x in rows if x == s]
        n = max(1, math.ceil(total[s] / block_tokens))
        blocks = defaultdict(list)
        for i in docs:
            blocks[number("mix", i) % n].append(i)
        for e in range(1, want // total[s] + 2):
            left = want - (e - 1) * total[s]
            for b in sorted(blocks, key=lambda b: (number("mix", e, "=" + s, b), b)):
                for i in sorted(blocks[b], key=lambda i: number("mix", e, i)):
                    if left > 0:
                        taken[i] += 1
                    left -= toks[i]
    return taken, weights(k)


ROWS = [(i, " ".join(["w"] * (1 + i * 7 % 40)), "big" if i % 3 else ("mid" if i % 2 else f"small{i % 4}")) for i in range(400)]


@pytest.mark.parametrize("entropy,max_repeats,ratio", [(0.9, 4.0, 1.0), (1.0, 1.5, 1.2), (0.2, 9.0, 0.3)])
def test_against_brute_force(make_docs, entropy, max_repeats, ratio):
    total = sum(len(t.split()) for _, t, _ in ROWS)
    docs = make_docs([(i, t, "en", s) for i, t, s in ROWS])
    options = dict(entropy=entropy, max_repeats=max_repeats, budget_ratio=ratio, block_tokens=200)
    got = mixing.select(docs, **options).collect()
    want, weight = brute(ROWS, entropy, max_repeats, math.floor(total * ratio), 200)
    assert Counter(r.doc_id for r in got) == want
    sources, _ = mixing.plan(docs, **options)
    for r in sources.collect():
        assert r.weight == pytest.approx(weight[r.src[1:]])
    # each source's tokens are its part of the budget, within one document
    tokens = Counter()
    for r in got:
        tokens[r.source] += r.tokens
    for s, w in weight.items():
        assert 0 <= tokens[s] - math.floor(w * math.floor(total * ratio)) <= 40
    assert sorted(mixing.mix(docs, **options).toPandas()["doc_id"]) == sorted(want.elements())


def test_blocks_are_whole_and_in_order(make_docs):
    docs = make_docs([(i, t, "en", s) for i, t, s in ROWS])
    rows = mixing.select(docs, block_tokens=200, budget_ratio=2.0).collect()
    by = defaultdict(set)
    for r in rows:
        by[r.source, r.epoch].add((r.block_place, r.block))
        assert 0 <= r.schedule < 1
    for places in by.values():
        assert sorted(p for p, _ in places) == list(range(1, len(places) + 1))


def test_odd_rows(odd_docs):
    out = mixing.mix(odd_docs, budget_ratio=1.0, entropy=None, max_repeats=None)
    assert out.columns == odd_docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(5) == 2 and ids.count(4) == 1
    assert mixing.select(odd_docs.where("false")).count() == 0
    assert mixing.mix(odd_docs.where("text is null")).count() == 0

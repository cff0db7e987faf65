import random

import numpy as np
import pyarrow as pa

from folioframe.llm import linedup


def tokens(line):
    return frozenset("".join(c.lower() if c.isascii() else c for c in line).encode().split())


def brute(rows):
    """(doc_id, text) -> text without lines that match an earlier one; ids ascending and unique."""
    seen, out = [], {}
    for i, text in sorted(rows):
        if text is None:
            out[i] = None
            continue
        kept = []
        for line in text.split("\n"):
            t = tokens(line)
            if t:
                if any(5 * len(t & s) >= 4 * len(t | s) for s in seen):
                    seen.append(t)
                    continue
                seen.append(t)
            kept.append(line)
        out[i] = "\n".join(kept)
    return out


def corpus(seed, docs=40):
    rnd = random.Random(seed)
    words = [f"v{int(rnd.paretovariate(0.7)) % 400}" for _ in range(600)]
    base = [" ".join(rnd.choices(words, k=rnd.choice([1, 2, 3, 4, 5, 8, 12, 30]))) for _ in range(80)]
    rows = []
    for i in range(docs):
        lines = []
        for _ in range(rnd.randint(0, 8)):
            line = rnd.choice(base).split()
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                line[rnd.randrange(len(line))] = rnd.choice(words)
            lines.append(" ".join(line).upper() if rnd.random() < 0.1 else "  ".join(line))
        rows.append((i, "\n".join(lines)))
    return rows


def test_against_brute_force(make_docs):
    for seed in (1, 2):
        rows = corpus(seed)
        want = brute(rows)
        got = {r.doc_id: r.text for r in linedup.dedupe(make_docs(rows, 3)).collect()}
        assert got == want
        assert got != dict(rows)


def test_hot_line_and_edges(make_docs):
    hot = "this line is in every one of the documents"
    rows = [(i, f"{hot}\nown words number {i} of {i * 7} and {i * 13}") for i in range(300)]
    got = {r.doc_id: r.text for r in linedup.dedupe(make_docs(rows, 4)).collect()}
    assert got[0].startswith(hot)
    assert sum(hot in t for t in got.values()) == 1
    # 4 of 5 tokens: exactly the threshold counts as a match; 7 of 9 does not
    rows = [(1, "a b c d"), (2, "a b c d e"), (3, "p q r s t u v w"), (4, "p q r s t u v x")]
    got = {r.doc_id: r.text for r in linedup.dedupe(make_docs(rows)).collect()}
    assert got == {1: "a b c d", 2: "", 3: rows[2][1], 4: rows[3][1]}


def test_odd_rows(odd_docs):
    out = linedup.dedupe(odd_docs)
    assert out.columns == odd_docs.columns
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    assert [r.text for r in rows if r.doc_id == 5] == ["same text here twice"] * 2
    assert [r.text for r in rows if r.doc_id == 6] == [""]
    assert [r.text for r in rows if r.doc_id == 1] == [None]
    assert [r.text for r in rows if r.doc_id == 3] == ["  \n \t\n"]
    assert linedup.dedupe(odd_docs.where("false")).count() == 0


def test_words_and_hashes_of_odd_lines():
    long = "x" * 63
    texts = ["  A b\ta\x0b\x0c\r B ", "", "\u00c9\u0130 \u3000z\x85q\xa0 a\x1cb a\x00 a", None, f"{long} {long}y {long}yy {long}yz abcdefgh abcdefghi abcdefgh"]
    words, ids, place = linedup._words(pa.array(texts, pa.string()).slice(1))
    want = [(t, w) for t, text in enumerate(texts[1:]) for w in (text or "").encode().lower().split()]
    assert [(t, words[i].as_py().encode()) for t, i in zip(place.tolist(), ids.tolist())] == want
    hashes = linedup._hashes(words)
    assert len(set(hashes.tolist())) == len(words) == len(words.unique())
    # a word's hash depends on nothing beside it
    assert [linedup._hashes(words.slice(i, 1))[0] for i in range(len(words))] == hashes.tolist()
    assert [linedup._hashes(pa.array([w]))[0] for w in words.to_pylist()] == hashes.tolist()


def test_wide_marks_are_those_of_each_set():
    rnd = np.random.default_rng(3)
    sizes = np.array([4, 16, 17, 100, 5])
    token = rnd.integers(0, 1 << 63, sizes.sum(), dtype=np.uint64)
    marks, words = linedup.wide_marks(token, sizes)
    assert words.tolist() == [1, 1, 2, 8, 1]
    for i, start in enumerate(np.cumsum(sizes) - sizes):
        one, _ = linedup.wide_marks(token[start:start + sizes[i]], sizes[i:i + 1])
        assert marks[words[:i].sum():words[:i + 1].sum()].tolist() == one.tolist()
        flipped = [0] * (64 * words[i])
        for t in token[start:start + sizes[i]].tolist():
            flipped[t % len(flipped)] ^= 1
        assert [int(w) >> b & 1 for w in one.view(np.uint64) for b in range(64)] == flipped


def test_words_held_once_are_in_no_list(make_docs):
    df = make_docs([(1, "a b c d once"), (2, "a b c d e"), (3, "a b c d e f")])
    rows = linedup.lines(df, linedup.token_counts(df)).orderBy("id").collect()
    # the word held once comes first, keeps its place and is in no list
    assert [[t is None for t in r.prefix] for r in rows] == [[True, False], [False, False], [True, False]]
    assert {r.doc_id: r.text for r in linedup.dedupe(df).collect()} == {1: "a b c d once", 2: "a b c d e", 3: ""}

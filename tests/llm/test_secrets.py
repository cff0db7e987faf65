import hashlib
import random
import re

import numpy as np
from folioframe.llm import secrets

BASE = [r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"AKIA[A-Z0-9]+", r"[0-9a-f]+"]


def plain(text):
    out = []
    for k, (p, least) in enumerate(zip(BASE, (6, 20, 24))):
        p = p.replace("(?ai:", "(?i:")
        for m in re.finditer(p, text or "", re.ASCII):
            if len(m[1] if k == 0 else m[0]) >= least:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{['assign', 'access', 'hex'][k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_against_plain_patterns(spark, sf_dir):
    rnd = random.Random(1)
    parts = ["password", "PassWD", "api_key", "apikey", "ſecret", "secret", "token", " ", ":", "=", "\"", "'", "abcdef0123456789abcdef01", "AKIA", "ABCDEFGHIJKLMNOP1234",
             "f" * 30, "x9/+_-.", "é", "漢", "\n", "12345", "deadbeef" * 3, "AKIAAKIA"]
    for _ in range(500):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert secrets.show(secrets.base_spans(text)) == plain(text)
    from folioframe.llm.queries import QUERIES
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op8_secrets"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(want.count(k + ":") for k in ("assign", "access", "hex"))
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


def english(rnd, n):
    words = "the of and nation restore counter inter mutual gover ment order other with ation able under over stand hundred thousand".split()
    return " ".join(rnd.choice(words) for _ in range(n))


def test_random_strings_are_found_and_words_are_not(make_docs):
    rnd = random.Random(7)
    alphabets = ["abcdefghijklmnopqrstuvwxyz0123456789", secrets.SYMBOLS[:62], secrets.SYMBOLS[:26] + "234567", secrets.DIGITS + "ABCDEF"]
    rows, planted = [], {}
    for i in range(200):
        text = english(rnd, 150)
        if i % 4 == 0:
            key = "".join(rnd.choice(alphabets[i // 4 % 4]) for _ in range(40))
            planted[i] = (len(text) + 1, len(text) + 41)
            text = f"{text} {key} {english(rnd, 20)}"
        else:
            text += " internationalgovernmentorderation another_snake_case_identifier_name some/path/to/the/restore/counter 12345678901234567890123"
        rows.append((i, text))
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == 3] for r in secrets.find(make_docs(rows)).collect()}
    hits = sum(got[i] == [place] for i, place in planted.items())
    assert hits >= 0.9 * len(planted)
    assert sum(len(v) for i, v in got.items() if i not in planted) == 0


def test_laws_of_random_strings():
    """Under randomness, each test rejects about as often as it should."""
    rng = np.random.default_rng(3)
    battery = secrets.Battery(secrets.DIGITS + "abcdef", np.ones((len(secrets.SYMBOLS),) * 2))
    runs = ["".join(rng.choice(list(battery.code), 40)) for _ in range(4000)]
    rejected = sum(not battery.test(r)[0] for r in runs) / len(runs)
    assert rejected < 0.01
    assert not battery.test("0" * 40)[0] and not battery.test("0123456789abcdef" * 3)[0]


def test_odd_rows(odd_docs):
    rows = secrets.report(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows if r.doc_id in (1, 2, 3))
    assert [r.n_hex for r in rows if r.doc_id == 8] == [1]
    assert secrets.report(odd_docs.where("false")).count() == 0


def test_recall_by_encoding_and_length(spark, sf_dir, capsys):
    """Random keys of every encoding inside the given documents; nothing else may be reported."""
    rnd = random.Random(11)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    kinds = {"base62": secrets.SYMBOLS[:62], "base64": secrets.ENCODINGS["base64"], "lower": secrets.DIGITS + secrets.LOWER, "HEX": secrets.ENCODINGS["HEX"],
             "base32": secrets.ENCODINGS["base32"], "base64url": secrets.ENCODINGS["base64url"]}
    rows, planted, plain_docs = [(i, t) for i, t in enumerate(texts)], {}, len(texts)
    for name, alphabet in kinds.items():
        for n in (20, 24, 32, 40, 64):
            for _ in range(10):
                words = (texts[len(rows) % plain_docs] or "x").split(" ")
                at, key = rnd.randint(0, len(words)), "".join(rnd.choice(alphabet) for _ in range(n))
                planted[len(rows)] = (name, n, key)
                rows.append((len(rows), " ".join([*words[:at], key, *words[at:]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    by_text = dict(rows)
    got = {r.doc_id: {by_text[r.doc_id][s.start:s.end] for s in r.spans if s.kind == 3} for r in secrets.find(docs).collect()}
    cells = {}
    for i, (name, n, key) in planted.items():
        cells.setdefault((name, n), []).append(any(key.strip("=") == g or (len(g) >= n - 2 and g in key) for g in got[i]))
    table = {c: sum(v) / len(v) for c, v in cells.items()}
    with capsys.disabled():
        print({f"{k}/{n}": v for (k, n), v in table.items()}, "false:", sum(bool(got[i]) for i in range(plain_docs)))
    assert all(v >= 0.9 for (_, n), v in table.items() if n >= 32)
    assert sum(bool(got[i]) for i in range(plain_docs)) == 0

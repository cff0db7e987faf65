import hashlib
import math
import random
import re
from collections import defaultdict

from folioframe.llm import pii

P = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
     "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def plain(text):
    out = []
    for k, (kind, p) in enumerate(P.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) \
                    or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{list(P)[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_against_plain_patterns(make_docs):
    rnd = random.Random(1)
    parts = ["a.b", "@", "x-y.com", ".", "1", "255", "256", "0", "4111 1111 1111 1111", "5500-0000-0000-0004", " ", "-", "+", "(", ")", "é", "👩", "\n", "%", "_", "12", "007", "..", "@@", "+49 30 123456"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))) for i in range(1500)]
    rows += [(2000, "1.2.3.4.5.6.7.8 000000255.01.1.1 1.2.3.999"), (2001, "a@b.co.%x@d.e a@b..c a@-.-"), (2002, "9" * 400), (2003, " ".join(["a@b.cd"] * 300))]
    got = {r.doc_id: r for r in pii.report(make_docs(rows)).collect()}
    for i, text in rows:
        want = plain(text)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), text
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(want.count(k + ":") for k in P)


def test_contexts_find_unseen_identifiers(make_docs):
    rows = [(i, f"Hello there. You can reach me at +1 (555) 010-{1000 + i} any time.") for i in range(20)]
    rows += [(100, "Well, reach me at 555-0199 tonight."), (101, "Chapter 12345 is about version 20.1 only."), (102, "Later reach me at x99 or so.")]
    rows += [(200 + i, f"Some text of section {1000 + i} follows.") for i in range(20)]
    got = {r.doc_id: [(s.value, s.start, s.end) for s in r.found] for r in pii.find(make_docs(rows)).collect()}
    text = rows[20][1]
    at = text.index("555-0199")
    assert got[100] == [("555-0199", at, at + 8)]
    assert sum(map(len, got.values())) == 1


def test_contexts_by_one_rule(make_docs):
    """Seeds and mentions after a number, two mentions or a very long word have the same context."""
    long = "w" * 200
    rows = [(i, f"reach user 42 a{i}@b.com") for i in range(12)] + [(20 + i, f"row 7 8 10.1.2.{i}") for i in range(12)]
    rows += [(40 + i, f"say {long} (x{i}@y.org)") for i in range(12)]
    rows += [(100, "reach user 42 bob77"), (101, "row 7 8 host99"), (102, f"say {long} (kim55)"), (103, "bob78 is another user")]
    got = {r.doc_id: [(s.value, s.start, s.end) for s in r.found] for r in pii.find(make_docs(rows)).collect()}
    assert got.pop(100) == [("bob77", 14, 19)]
    assert got.pop(101) == [("host99", 8, 14)]
    assert got.pop(102) == [("kim55", 206, 211)]
    assert not any(got.values())


def test_scores_against_loops(spark):
    rnd = random.Random(4)
    seen = [(f"p{rnd.randint(0, 8)}", f"i{int(rnd.paretovariate(0.6)) % 60}", None) for _ in range(300)]
    kinds = {f"i{k}": k % 2 for k in range(0, 14)}
    seen = [(p, i, kinds.get(i)) for p, i, _ in seen]
    edges = {(p, i) for p, i, _ in seen}
    members = defaultdict(set)
    for p, i in edges:
        members[p].add(i)
    seeds = {i: (k, 1.0) for i, k in kinds.items() if any(i == x for _, x in edges)}
    found = {}
    for _ in range(pii.ROUNDS):
        known = seeds | found
        conf = {}
        for p, ids in members.items():
            for k in (0, 1):
                c = round(sum(known[i][1] for i in ids if i in known and known[i][0] == k) / (len(ids) + 1), 9)
                if len(ids) >= 3 and c >= 0.2:
                    conf[p, k] = c
        found = {}
        for i in {i for _, i in edges} - set(seeds):
            best = max(((round(1 - math.prod(1 - conf[p, k] for p in members if i in members[p] and (p, k) in conf), 9), -k) for k in (0, 1)
                        if any(i in members[p] and (p, k) in conf for p in members)), default=None)
            if best:
                found[i] = (-best[1], best[0])
    got = {r.instance: (r.kind, r.score) for r in pii.score(spark.createDataFrame(seen, "pattern string, instance string, kind int"), confident=0.2).collect()}
    assert found and got.keys() == found.keys()
    for i in found:
        assert got[i][0] == found[i][0] and abs(got[i][1] - found[i][1]) < 1e-6


def test_native_plan(make_docs):
    plan = pii.base_spans(make_docs([(1, "a@b.cd")]), "text")._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_odd_rows(odd_docs):
    rows = pii.report(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows if r.doc_id in (1, 2, 3))
    assert pii.report(odd_docs.where("false")).count() == 0

import re

import pytest
from pyspark.sql import functions as F

from folioframe.functions import markdown as M
from folioframe.functions import querylog as Q
from folioframe.functions import text as T
from folioframe.functions import tokens as K


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


def estimate(text):
    wide = len(re.findall("[㐀-鿿]", text))
    return wide + -(-(len(text) - wide) // 4)


def test_budget_sweep(spark):
    texts = ["", "plain ascii words " * 9, "中文字符与 mixed text " * 7, "全" * 40, "a全" * 30]
    df = spark.createDataFrame([(t, b) for t in texts for b in range(0, 32)], "t string, b int")
    for r in df.select("t", "b", K.truncate_text("t", F.col("b")).alias("x")).collect():
        assert estimate(r.x) <= r.b
        if estimate(r.t) <= r.b:
            assert r.x == r.t
        elif r.b > 1:
            # the prefix kept is the longest that fits next to the marker
            marker = K.TRUNCATION_MARKER if estimate(K.TRUNCATION_MARKER) <= r.b else "..."
            room = r.b - estimate(marker)
            best = max(n for n in range(len(r.t) + 1) if estimate(r.t[:n]) <= room)
            assert r.x == r.t[:best].rstrip() + marker


def test_heading_levels_follow_the_sequential_rule(spark):
    import random
    rng, rows = random.Random(5), []
    for i in range(60):
        rows.append((i, "\n".join(rng.choice(["text", "#" * rng.randint(1, 6) + " h", ""]) for _ in range(12))))
    got = {r.i: r.x for r in spark.createDataFrame(rows, "i int, t string").select(
        "i", M.normalize_heading_levels("t").alias("x")).collect()}
    for i, text in rows:
        last, out = 0, []
        for line in text.split("\n"):
            if line.startswith("#"):
                level = len(line.split(" ")[0])
                level = last + 1 if last and level > last + 1 else level
                last = level
                line = "#" * level + " h"
            out.append(line)
        assert got[i] == "\n".join(out)


def test_clean_markdown_steps(spark):
    raw = "# A\x01 [x](u) \n\nhd\none\nhd\n### C\nPage 3\nhd  \n```\n# [y](z)\n```\n\n\n\nend \t"
    assert one(spark, M.clean_markdown(F.lit(raw))) == "# A x\n\none\n\n## C\n\n```\n# [y](z)\n```\n\nend"


def test_links_reach_a_fixpoint(spark):
    assert one(spark, M.clean_link_label(F.lit(" [![a](d)](e)  x "))) == "a x"
    assert one(spark, M.clean_link_label(F.lit("![im](q)  and [l](u)"))) == "im and l"


def test_redaction_leaves_no_secret(spark):
    text = "api_key=abc123 Authorization: Bearer xyz.1 http://h/?token=zz&k=1 then Bearer qqq password: p4ss"
    out = one(spark, T.redact(F.lit(text)))
    for secret in ("abc123", "xyz.1", "zz", "qqq", "p4ss"):
        assert secret not in out
    assert one(spark, T.redact(F.lit("x" * 30), 10)) == "x" * 10 + "...[TRUNCATED]"


@pytest.mark.parametrize("url,want", [
    ("http://A.b.com:80?x=1#f", "http://a.b.com:80/?x=1"), ("https://EX.com./a?b", "https://ex.com/a?b"),
    ("https://127.0.0.1/x", None), ("http://10.2.3.4/", None), ("http://[::1]/", None), ("http://u:p@h.com/", None),
    ("ftp://x", None), ("http://localhost/", None), ("http://a.localhost/", None), ("http://172.20.0.1", None)])
def test_guard_url(spark, url, want):
    assert one(spark, T.guard_url(F.lit(url))) == want


def test_snippets_and_titles(spark):
    assert one(spark, T.search_snippet(F.lit("x" * 10 + " Needle " + "y" * 10), "nEEDLE", 3, "empty")) == "...xx Needle yy..."
    assert one(spark, T.search_snippet(F.lit("abc"), "zz", 1, "empty")) == ""
    assert one(spark, T.search_snippet(F.lit("abcdef"), "zz", 2, "head")) == "abcd"
    assert one(spark, T.conversation_title(F.lit("  "))) == "新对话"
    title = one(spark, T.conversation_title(F.lit("word " * 30)))
    assert len(title) <= 80 and title.endswith("...")


def test_like_wildcards_are_literal(spark):
    df = spark.createDataFrame([("100% done",), ("100 done",)], "t string")
    assert df.filter(T.contains_literal("t", "100%")).count() == 1


def test_normalize_strings_keeps_first_of_each(spark):
    col = T.normalize_strings(F.array(*[F.lit(v) for v in (" A", "a", "Straße", "STRASSE", "", "b")]), F.array(F.lit("B")))
    assert one(spark, col) == ["A", "Straße"]


def test_query_log_labels(spark):
    q = lambda fn, s: one(spark, fn(F.lit(s)))
    assert q(Q.classify_intent, "帮我总结一下") == "summarize"
    assert q(Q.classify_intent, "删除笔记 a") == "delete_note"
    assert q(Q.is_fast_path, "什么是向量？") and not q(Q.is_fast_path, "比较两种方法？")
    assert q(Q.needs_context, "它的作用") and q(Q.extract_filename, "删除笔记 foo") == "foo"


def test_tokenizers(spark):
    assert one(spark, K.tokenize(F.lit("Étion, the 3 的 向量"))) == ["tion", "the", "3", "向", "量", "向量"]
    assert one(spark, K.tokenize_eval(F.lit("A-b 1.5% é"))) == ["a", "-", "b", "1.5%", "é"]


def test_strip_looks_at_the_ends_only(spark):
    from folioframe.functions import common as C
    symbols = spark.range(0x3100).filter("id < 55296").select(F.udf(lambda i: chr(i), "string")("id").alias("c"))
    texts = symbols.select(*[F.concat(*[F.col("c") if x == "c" else F.lit(x) for x in form]).alias(f"t{i}") for i, form in enumerate(["c", "ccacc", "\u3000ca c\t", "acb"])])
    for name in texts.columns:
        pattern = F.regexp_replace(name, rf"\A{C.WS}+|{C.TAIL}", "")
        assert texts.filter(~C.strip(name).eqNullSafe(pattern)).count() == 0
    assert texts.select(C.strip(F.lit(None).cast("string"))).first()[0] is None
    assert "regexp" not in texts.select(C.strip("t0"))._jdf.queryExecution().analyzed().toString()

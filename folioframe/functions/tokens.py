"""Tokenizers and token budgets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import WS, chars, col, let, rstrip

# Stop words of the lexical tokenizer.
STOP_WORDS = [
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人",
    "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去",
    "你", "会", "着", "没有", "看", "好", "自己", "这", "那",
    "个", "我们", "可以", "就", "把", "来", "用", "能", "对",
    "及", "等", "与", "为", "或", "而", "但", "如果", "则", "因为",
    "所以", "虽然", "但是", "而且", "或者", "还是", "只是",
]
# Fixed value: appended where a text was cut to fit a budget.
TRUNCATION_MARKER = "\n...[内容已按上下文预算截断]"

_CJK_RUN = "[\\u4e00-\\u9fa5]"
_RUNS = "([a-zA-Z0-9]+|[\\u4e00-\\u9fa5]+)"
# words with an optional decimal part and percent sign, CJK runs, single symbols
EVAL_PIECES = ("([\\u4e00-\\u9fd5]+|[a-z0-9]+(?:\\.[0-9]+)?%?|[^\\u4e00-\\u9fd5a-z0-9"
               + WS[1:-1] + "])")
_WIDE = "[\\u3400-\\u9fff]"


def ngrams(run: Column) -> Column:
    """Default CJK segmentation: every character and every adjacent pair."""
    n = F.length(run)
    single = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(run, i, F.lit(1)))
    pairs = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1),
                                       lambda i: F.substring(run, i, F.lit(2))))
    return F.concat(single, F.coalesce(pairs, F.array().cast("array<string>")))


def tokenize(text) -> Column:
    """Case-preserving lexical tokens: ASCII runs as they are, CJK runs as n-grams, stop words out.

    Every other character is a separator. Stop words are CJK only, so plain ASCII documents
    skip the filter.
    """
    text = F.coalesce(col(text), F.lit(""))
    runs = F.regexp_extract_all(text, F.lit(_RUNS), 1)
    wide = F.filter(
        F.flatten(F.transform(runs, lambda r: F.when(r.rlike(_CJK_RUN), ngrams(r))
                              .otherwise(F.array(r)))),
        lambda t: ~t.isin(STOP_WORDS))
    return F.when(text.rlike(_CJK_RUN), wide).otherwise(runs)


def tokenize_eval(text) -> Column:
    """Evaluation tokens: lower case, word runs and single symbols, nothing filtered but blanks."""
    text = F.lower(F.coalesce(col(text), F.lit("")))
    pieces = F.regexp_extract_all(
        text, F.lit(EVAL_PIECES), 1)
    wide = F.flatten(F.transform(pieces, lambda r: F.when(r.rlike("[\\u4e00-\\u9fd5]"), ngrams(r))
                                 .otherwise(F.array(r))))
    return F.when(text.rlike("[\\u4e00-\\u9fd5]"), wide).otherwise(pieces)


def estimate_tokens(text) -> Column:
    """Wide characters count one each, four others count one."""
    text = F.coalesce(col(text), F.lit(""))
    rest = F.length(F.regexp_replace(text, _WIDE, ""))
    return (F.length(text) - rest + F.ceil(rest / F.lit(4))).cast("int")


def fitting_prefix(text: Column, budget: Column) -> Column:
    """Length of the longest prefix whose estimate stays within ``budget``."""
    # four characters per token is the most a budget can hold, so no more need be looked at
    head = F.substring(text, F.lit(1), budget * 4)

    def step(acc, ch):
        wide = acc["wide"] + F.when(ch.rlike(_WIDE), 1).otherwise(0)
        seen = acc["seen"] + 1
        fits = wide + F.ceil((seen - wide) / F.lit(4)).cast("int") <= budget
        return F.struct(seen.alias("seen"), wide.alias("wide"),
                        F.when(fits, seen).otherwise(acc["best"]).alias("best"))

    zero = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("wide"), F.lit(0).alias("best"))
    folded = F.aggregate(chars(head), zero, step, lambda acc: acc["best"])
    return F.when(head.rlike(_WIDE), folded).otherwise(F.length(head))


def truncate_text(text, budget) -> Column:
    """Cut to a token budget, marking the cut; the result never exceeds the budget."""
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    marker_cost = estimate_tokens(F.lit(TRUNCATION_MARKER))
    marker = F.when(marker_cost > budget, F.lit("...")).otherwise(F.lit(TRUNCATION_MARKER))
    room = F.greatest(F.lit(0), budget - F.when(marker_cost > budget, 1).otherwise(marker_cost))

    def body(t):
        cut = F.concat(rstrip(F.substring(t, F.lit(1), fitting_prefix(t, room))), marker)
        return (F.when(budget <= 0, F.lit(""))
                .when(estimate_tokens(t) <= budget, t).otherwise(cut))

    return let(F.coalesce(col(text), F.lit("")), body)


def serialize_context(value) -> Column:
    """JSON text with sorted keys of a map column (strings pass through)."""
    value = col(value)
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(value))))


def serialize_json(text) -> Column:
    """JSON text with the keys of every object sorted, at any depth; numbers, booleans and nulls keep their kind.

    Text that is no JSON, or that repeats a key within an object, passes through; numbers take their shortest form.
    """
    return F.coalesce(F.to_json(F.try_parse_json(col(text))), col(text))


def limit_context(text, budget) -> Column:
    """struct<text, estimated_tokens, used_tokens, token_budget, truncated>."""
    text = F.coalesce(col(text), F.lit(""))
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    return let(truncate_text(text, budget), lambda cut: F.struct(
        cut.alias("text"), estimate_tokens(text).alias("estimated_tokens"),
        estimate_tokens(cut).alias("used_tokens"),
        F.greatest(F.lit(0), budget).alias("token_budget"), (cut != text).alias("truncated")))


def message_tokens(role, content) -> Column:
    """Chat message cost: fixed overhead of 4 plus role and content."""
    return F.lit(4) + estimate_tokens(role) + estimate_tokens(content)

"""Labels for logged questions: intent, fast path, anaphora, dates, tags, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import NWS, WS, col, strip

# Intent families in the order they are tried.
INTENT_PATTERNS = [
    ("summarize", "总结|摘要|概括|归纳|复习卡片|生成卡片"),
    ("search", "^搜索|^查找|^查一下|^找一下|^看看|是什么|有哪些|复习|什么是"),
    ("create_note", "创建笔记|新建笔记|添加笔记|^记录|^记一下"),
    ("update_note", "更新笔记|修改笔记|编辑笔记"),
    ("delete_note", "删除笔记|移除笔记|删掉"),
    ("list_notes", "列出.*笔记|显示.*笔记|所有笔记|笔记列表|有哪些笔记"),
    ("time_query", "现在.*时间|今天.*日期|几点|星期"),
]
# Words that make a question eligible or ineligible for the single-turn path.
QUESTION_MARKERS = ["什么", "为何", "为什么", "怎么", "如何", "哪些", "有哪些", "是否", "能否",
                    "区别", "优势", "作用", "流程", "原理", "介绍", "解释", "含义", "是什么"]
MUTATION_PATTERNS = [
    "^(?:请|帮我)?(?:创建|新增|更新|修改|删除|写入|保存|记录|导出|上传|重命名|替换|清空|取消|确认)",
    "(?:把|将|帮我把).{0,80}(?:创建|新增|更新|修改|删除|写入|保存|记录|导出|上传|重命名|替换|清空)",
    "(?:保存|写入|记录|添加|更新|修改|删除|替换|重命名).{0,40}(?:到|进|为|成)(?:知识库|笔记|页面|文档|Wiki)",
    "(?:总结|归纳|生成复习|整理成)",
]
COMPLEX_MARKERS = "比较|对比|分别|同时|以及|并且|结合|如果|然后|优缺点|差异|完整流程|详细说明"
CONTEXT_MARKERS = ["它", "这个", "那个", "上面", "刚才", "前者", "后者", "该问题"]
TAG_PHRASE = rf'标签[是为]{WS}*["“]?((?:(?!["“]){NWS})+)["”]?'
HASH_TAG = rf"#((?:(?![#，。,.]){NWS})+)"
FILE_NAME_PATTERNS = [
    rf'(?:笔记|文件){WS}*[名叫是为：:]{WS}*[「"“]?([^」"”，。,.]+)',
    rf"(?:笔记|文件){WS}+(.+?)(?:{WS}|$)",
]
FILE_NAME_PARTICLES = ["的", "了", "吗", "吧", "呢"]


def classify_intent(query, patterns=INTENT_PATTERNS) -> Column:
    q = F.lower(col(query))
    out = F
    for name, pattern in patterns:
        out = out.when(q.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit("search"))


def is_fast_path(query, has_context=None, max_chars: int = 160) -> Column:
    q = F.regexp_replace(F.coalesce(col(query), F.lit("")), rf"{WS}+", "")
    blocked = (q == "") | (F.length(q) > max_chars) | q.rlike(COMPLEX_MARKERS)
    for pattern in MUTATION_PATTERNS:
        blocked = blocked | q.rlike(pattern)
    if has_context is not None:
        blocked = blocked | has_context
    return ~blocked & (q.rlike("[?？]\\z") | q.rlike("|".join(QUESTION_MARKERS)))


def needs_context(query) -> Column:
    return F.coalesce(col(query), F.lit("")).rlike("|".join(CONTEXT_MARKERS))


def extract_date_range(query, today) -> Column:
    """struct<from,to> for the date word in the query relative to ``today``; NULL without one."""
    q, today = F.lower(col(query)), col(today)
    day, monday = F.date_trunc("day", today), F.date_trunc("week", today)
    last = F.expr("INTERVAL '0 23:59:59.999999' DAY TO SECOND")

    def span(start, end):
        return F.struct(start.alias("date_from"), (end + last).alias("date_to"))

    one, six, seven = (F.expr(f"INTERVAL {n} DAYS") for n in (1, 6, 7))
    return (F.when(q.contains("今天"), span(day, day))
            .when(q.contains("昨天"), span(day - one, day - one))
            .when(q.rlike("本周|这星期"), span(monday, day))
            .when(q.rlike("上周|上星期"), span(monday - seven, monday - seven + six))
            .when(q.rlike("本月|这个月"), span(F.date_trunc("month", today), day)))


def extract_tag_filter(query) -> Column:
    q = col(query)
    phrase, tag = F.regexp_extract(q, TAG_PHRASE, 1), F.regexp_extract(q, HASH_TAG, 1)
    return strip(F.coalesce(F.nullif(phrase, F.lit("")), F.nullif(tag, F.lit(""))))


def extract_tags(query) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(query), F.lit(HASH_TAG), 1))


def extract_filename(query) -> Column:
    names = [F.nullif(strip(F.regexp_extract(col(query), p, 1)), F.lit("")) for p in FILE_NAME_PATTERNS]
    return F.coalesce(*[F.when(~n.isin(FILE_NAME_PARTICLES), n) for n in names])


def parse_search_params(query, today) -> Column:
    """struct<query, tag_filter, date_from, date_to>; the query never becomes empty."""
    q = col(query)
    dates, tag = extract_date_range(q, today), extract_tag_filter(q)
    dated = F.regexp_replace(F.regexp_replace(q, r"(上|本|这|下)?(周|月|年)\d{0,2}", ""),
                             r"\d{4}[-/]\d{1,2}[-/]\d{0,2}", "")
    text = F.when(dates.isNotNull(), dated).otherwise(q)
    for particle in ("是", "为", ""):
        phrase = F.concat(F.lit("标签" + particle), tag)
        text = F.when(tag.isNotNull(), F.replace(text, phrase, F.lit(""))).otherwise(text)
    return F.struct(
        F.coalesce(F.nullif(strip(text), F.lit("")), q).alias("query"), tag.alias("tag_filter"),
        dates["date_from"].alias("date_from"), dates["date_to"].alias("date_to"))

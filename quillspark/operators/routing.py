"""Routing of questions by phrases and patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the compared results depend on. Domain words are the caller's.
FORCE_RAG = ["use rag", "use retrieval", "search the docs", "search docs", "use the docs", "according to the docs", "according to documentation", "based on the knowledge base", "based on local docs", "from the knowledge base", "with references", "cite sources", "基于文档", "根据文档", "根据知识库", "查知识库", "搜索知识库", "检索知识库", "使用检索", "引用资料", "带引用"]
FORCE_DIRECT = ["do not use rag", "don't use rag", "without rag", "no rag", "do not retrieve", "don't retrieve", "without retrieval", "no retrieval", "answer directly", "不要用rag", "不用rag", "不要检索", "不用检索", "不要查库", "不要查知识库", "不用知识库", "直接回答", "别查"]
DIRECT_TASKS = [
    r"\b(write|draft|compose|create|generate)\b.{0,80}\b(poem|joke|email|cover letter|resume|linkedin)\b",
    r"\b(tell|make)\b.{0,40}\bjoke\b",
    r"\btranslate\b",
    r"\bsummarize my resume\b",
    r"^\s*(hi|hello|hey|thanks|thank you)[!.?\s]*$",
    r"(写|创作|生成).{0,40}(诗|邮件|简历)",
    r"讲.{0,20}笑话",
    r"翻译",
    r"简历",
    r"^\s*(你好|您好|谢谢|感谢)[！!。.\s]*$",
]
TECH_TERMS = ["postgresql", "postgres", "mysql", "sqlite", "duckdb", "clickhouse", "python", "fastapi", "javascript", "typescript", "redis", "kafka", "flink", "spark", "sql", "api", "database", "db"]
FOLLOW_UPS = ["这个呢", "那个呢", "它呢", "他们呢", "后续呢", "然后呢", "继续", "继续讲", "继续说", "展开", "展开讲", "详细说说", "再展开", "接着说", "刚才那个呢", "上面那个呢", "前面那个呢", "这个为什么", "为什么会这样", "这是什么意思", "这怎么来的", "这个怎么来的", "这有什么风险", "这个有什么风险", "这个问题呢", "这个计划呢", "这个事件呢", "what about that", "what about it", "how about that", "and then", "what happened next", "continue", "go on", "elaborate", "tell me more", "why is that", "what does that mean"]
FOLLOW_UP_PATTERNS = [
    r"^(那|那么|所以)?(这个|那个|它|他们|上述|上面|前面|刚才).{0,12}(呢|吗|为什么|怎么|如何|啥意思|什么意思|后续|风险|问题)[？?。!！\s]*$",
    r"^(继续|接着|展开|详细).{0,8}(讲|说|解释|分析)?[。！？?\s]*$",
    r"^(后续|之后|然后).{0,12}(呢|是什么|有哪些|怎么|如何|节点)?[？?。!！\s]*$",
]


def any_phrase(text: Column, phrases: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(text, p)) if phrases else F.lit(False)


def any_pattern(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(f"(?i){p}")
    return out


def tech_term(text: Column) -> Column:
    return text.rlike("(?i)(^|[^A-Za-z0-9_])(" + "|".join(TECH_TERMS) + ")([^A-Za-z0-9_]|$)")


def follow_up(question: Column) -> Column:
    q = F.trim(question)
    low = F.lower(q)
    plain = F.regexp_replace(low, r"[\s。！？!?，,、；;：:]+", "")
    bare = F.regexp_replace(low, r"^[ \t\r\n.!?。！？]+|[ \t\r\n.!?。！？]+$", "")
    short = (q != "") & (F.length(q) <= 80) & (F.size(F.regexp_extract_all(low, F.lit(r"(?U)\w+"), F.lit(0))) <= 14)
    return short & ~tech_term(low) & (plain.isin(FOLLOW_UPS) | bare.isin(FOLLOW_UPS) | any_pattern(q, FOLLOW_UP_PATTERNS))


def route(question: Column, used_rag: Column, had_contexts: Column, domain: list[str]) -> Column:
    """The route by the first rule that speaks; null-safe previous state."""
    low = F.lower(F.trim(question))
    state = F.coalesce(used_rag, F.lit(False)) & F.coalesce(had_contexts, F.lit(False))
    return (
        F.when(any_phrase(low, FORCE_DIRECT), "keyword_direct")
        .when(any_phrase(low, FORCE_RAG), "keyword_rag")
        .when(any_pattern(low, DIRECT_TASKS), "keyword_direct")
        .when(any_phrase(low, domain), "keyword_rag")
        .when(tech_term(low), "keyword_direct")
        .when(state & follow_up(question), "state_rag")
        .otherwise("fallback_rag")
    )


def verdict(raw: Column) -> Column:
    """true, false or null from a model's reply: the answer's JSON, or the one of the words that it holds."""
    body = F.regexp_extract(raw, r"(?is)</?answer>\s*(.*?)\s*</answer>", 1)
    source = F.when(body != "", body).otherwise(raw)
    json = F.regexp_extract(source, r"(?s)\{.*\}", 0)
    value = F.lower(F.get_json_object(F.when(json != "", json).otherwise(F.trim(source)), "$.use_rag"))
    low = F.lower(source)
    yes, no = F.contains(low, F.lit("true")), F.contains(low, F.lit("false"))
    word = F.when(yes & ~no, True).when(no & ~yes, False)
    whole = F.try_parse_json(F.when(json != "", json).otherwise(F.trim(source))).isNotNull()
    return F.when(whole, F.when(value == "true", True).when(value == "false", False)).otherwise(word)

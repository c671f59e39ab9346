"""Conversation analytics: summaries, history windows, rolling summaries, follow-up scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import text as T

MIN_MESSAGES, SUMMARY_MESSAGES = 8, 200
DEFAULT_BUDGET, MIN_BUDGET, BUDGET_SHARE = 6000, 256, 0.8
SUMMARY_LINE, SUMMARY_CHARS = 240, 4000
MAX_REFERENCES, REFERENCE_CHARS, REFERENCES_TOTAL = 5, 1200, 4000
VERY_SHORT, SHORT, INVOKE = 12, 24, 3

# fixed values: the heading of a rolling summary, and its last line where messages were left out
SUMMARY_HEAD = "以下是本会话较早内容的滚动摘要，按时间顺序保留关键事实；每条都带有当时的 Agent 模式：\n"
SUMMARY_TAIL = "- 更早的细节仍保存在 SQLite 原始消息中，本轮仅注入摘要视图。\n"
# fixed values: signs that a question leans on what was said before
REFERENCE_WORDS = (
    "(它|他们|她们|这个|那个|这些|那些|这种|那种|这段|那段|这份|那份|这条|那条|这里|上面|前面|上文|前文|之前|刚才|刚刚|刚提到|刚说|上面提到|前面提到|你说的|"
    "上一(个|条|轮|次)|前一(个|条|轮|次)|前者|后者|该|其|其中|这个呢|那个呢|那(应该|要|可以|能|该|怎么办|怎么|如何|有没有|是否))"
)
CONTINUATION_WORDS = (
    "(继续|展开|详细|详解|补充|拓展|延伸|举例|例子|示例|代码|案例|实现|写一下|写个|生成|给我|demo|Demo|总结|小结|归纳|再来|还有|换一个|换种|对比|比较|区别|优缺点|适用场景|"
    "怎么实现|怎么用|怎么配置|怎么部署|怎么排查|怎么修复|怎么优化|怎么办|咋办|咋整|怎么处理|如何处理|能不能|可以吗|有没有|是否支持)"
)
ACTION_WORDS = (
    "(继续|展开|详细|详解|说明|解释|介绍|补充|拓展|举例|例子|示例|代码|案例|实现|写一下|写个|生成|demo|Demo|总结|小结|归纳|再来|对比|比较|区别|优缺点|适用场景|怎么实现|怎么用|"
    "怎么配置|怎么部署|怎么排查|怎么修复|怎么优化|怎么办|咋办|咋整|怎么处理|如何处理)"
)
ELLIPSIS_WORDS = "(哪个|哪些|哪种|哪一个|更适合|有没有|是否|支持吗|能吗|可以吗|多少钱|价格|费用|证书|退款|试听|分期|有什么影响|怎么治疗|吃什么药|应该怎么|应该吃|怎么做|怎么弄)"
# word boundaries are those of ASCII words, written out: \b means other things to other Java versions
ENGLISH_REFINEMENT = (
    r"(?i)(?<![A-Za-z0-9_])((in|for|about|within|on)\s+[A-Za-z][A-Za-z0-9_+#.\-]{2,}|what about|how about|and then|also|more about|continue|details?|example|"
    r"code sample|implementation|compare|difference|pros and cons|summari[sz]e)((?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
)
LATIN_TOPIC = r"[A-Za-z][A-Za-z0-9_+#.\-]{2,}"
HAN_TOPIC = r"\p{IsHan}{2,}(是什么|怎么|如何|为什么|区别|原理|流程|配置|实现|问题|方案)"


def history_budget(window: int | None) -> int:
    """Tokens that history may take of a model's window."""
    return DEFAULT_BUDGET if not window or window <= 0 else max(MIN_BUDGET, int(window * BUDGET_SHARE))


def session_summaries(messages: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """(conv_id, messages, user_messages, assistant_messages, last_seq), sessions without messages included."""
    out = messages.groupBy("conv_id").agg(
        F.count("*").alias("messages"), F.count_if(F.col("role") == "USER").alias("user_messages"), F.count_if(F.col("role") == "ASSISTANT").alias("assistant_messages"),
        F.max("seq").alias("last_seq"),
    )
    if sessions is None:
        return out
    out = sessions.select("conv_id").join(out, "conv_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("messages", "user_messages", "assistant_messages")})


def message_tokens() -> Column:
    """Tokens of a message: its text and four of overhead, at least one."""
    return F.greatest(T.mixed_tokens("text") + 4, F.lit(1))


def history_window(messages: DataFrame, budget: int, minimum: int = MIN_MESSAGES) -> DataFrame:
    """The newest messages of each conversation that fit the budget; the newest ``minimum`` (2 at least) always stay.

    Older messages stop at the first one that doesn't fit.  Token counts are at least 1, so the running sum rises
    and a plain comparison finds that stop.
    """
    minimum = max(2, minimum)
    w = Window.partitionBy("conv_id").orderBy(F.col("seq").desc())
    rows = messages.withColumn("tokens", message_tokens())
    rows = rows.withColumns({"_n": F.row_number().over(w), "_sum": F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.filter((F.col("_n") <= minimum) | (F.col("_sum") <= budget)).drop("_n", "_sum")


def context_usage(messages: DataFrame, window: int, minimum: int = MIN_MESSAGES) -> DataFrame:
    """(conv_id, total, recent, used, ratio, compressed) of each conversation under a model window."""
    budget = history_budget(window)
    total = messages.groupBy("conv_id").agg(F.count("*").alias("total"), F.sum(message_tokens()).alias("all_tokens"))
    kept = history_window(messages, budget, minimum).groupBy("conv_id").agg(F.count("*").alias("recent"), F.sum("tokens").cast("long").alias("used"))
    full = (F.col("total") > max(SUMMARY_MESSAGES, minimum + 2)) | (F.col("all_tokens") > budget)
    return total.join(kept, "conv_id").select(
        "conv_id", "total", "recent", "used", F.greatest(F.lit(0), F.lit(budget) - F.col("used")).cast("long").alias("available"),
        F.round(F.least(F.lit(1.0), F.col("used") / float(budget)), 6).alias("ratio"), full.alias("summarise"),
    )


def messages_between(messages: DataFrame, after: int | None, up_to: int | None = None) -> DataFrame:
    """Messages that come after a sequence, up to another one with it; None leaves a side open."""
    rows = messages if after is None else messages.filter(F.col("seq") > after)
    return rows if up_to is None else rows.filter(F.col("seq") <= up_to)


def rolling_summary(messages: DataFrame, minimum: int = MIN_MESSAGES, line: int = SUMMARY_LINE, most: int = SUMMARY_CHARS, agent: Column | None = None) -> DataFrame:
    """(conv_id, up_to, summary): all but the newest ``minimum`` messages, after a heading a line each with agent and role.

    Lines stop at the first one that goes beyond ``most`` characters, and a last line says so; ``up_to`` covers all of
    these messages even so.  ``agent`` is null where a message has none.
    """
    newest = Window.partitionBy("conv_id").orderBy(F.col("seq").desc())
    oldest = Window.partitionBy("conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = messages.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") > minimum)
    who = F.when(F.col("role") == "USER", "用户").otherwise("助手")
    name = F.coalesce(F.lit(None).cast("string") if agent is None else agent, F.lit("UNKNOWN"))
    rows = rows.withColumn("_line", F.concat(F.lit("- ["), name, F.lit("] "), who, F.lit("："), T.ellipsis(T.collapse_ws(F.coalesce("text", F.lit(""))), line), F.lit("\n")))
    fits = F.lit(len(SUMMARY_HEAD)) + F.sum(F.length("_line")).over(oldest) <= most
    rows = rows.withColumn("_fits", fits).groupBy("conv_id").agg(
        F.max("seq").alias("up_to"), F.every("_fits").alias("_all"), F.array_sort(F.collect_list(F.when(F.col("_fits"), F.struct("seq", "_line")))).alias("_lines")
    )
    text = F.concat(F.lit(SUMMARY_HEAD), F.array_join(F.transform("_lines", lambda x: x["_line"]), ""), F.when(F.col("_all"), "").otherwise(SUMMARY_TAIL))
    return rows.select("conv_id", "up_to", T.trim_ws(text).alias("summary"))


def has_topic(x: Column) -> Column:
    return x.rlike(LATIN_TOPIC) | x.rlike(HAN_TOPIC)


def follow_up_score(question: Column) -> Column:
    """How much a question leans on the conversation before it."""
    return T.let(T.collapse_ws(F.coalesce(question, F.lit(""))), _score)


def _score(q: Column) -> Column:
    n, topic, points = F.length(q), has_topic(q), lambda c, k: F.when(c, k).otherwise(0)
    refers, refines = q.rlike(REFERENCE_WORDS), q.rlike(ENGLISH_REFINEMENT)
    fragment = ~topic & ((n <= SHORT) | q.endswith("呢"))
    return (
        F.when(n <= VERY_SHORT, 2).when(n <= SHORT, 1).otherwise(0) + points(refers, 4) + points(q.rlike(CONTINUATION_WORDS), 2)
        + F.when(q.rlike(ELLIPSIS_WORDS), F.when(topic, 1).otherwise(2)).otherwise(0) + points(refines, 2) + points(fragment, 1)
        + points(topic & ~refers & ~refines, -3)
    )


def follow_ups(messages: DataFrame) -> DataFrame:
    """(conv_id, seq, score, reason, invoke) of each user message."""
    w = Window.partitionBy("conv_id").orderBy("seq")
    rows = messages.filter(F.col("role") != "SYSTEM").withColumn("_first", F.row_number().over(w) == 1).filter(F.col("role") == "USER")
    score = F.when(F.col("_first") | T.is_blank("text"), 0).otherwise(follow_up_score(F.col("text")))
    reason = F.when(F.col("_first"), "auto_no_history").when(T.is_blank("text"), "auto_blank_question").when(score >= INVOKE, "auto_follow_up_score").otherwise("auto_standalone_question")
    return rows.select("conv_id", "seq", score.cast("int").alias("score"), reason.alias("reason"), (score >= INVOKE).alias("invoke"))


def is_action_follow_up(x: Column) -> Column:
    q = T.collapse_ws(F.coalesce(x, F.lit("")))
    return (q != "") & (F.length(q) <= SHORT) & (q.rlike(ACTION_WORDS) | q.rlike(ENGLISH_REFINEMENT)) & ~has_topic(q)


def latest_topics(messages: DataFrame) -> DataFrame:
    """(conv_id, seq, topic_seq): the latest earlier user message with a topic of its own."""
    w = Window.partitionBy("conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    topical = F.when((F.col("role") == "USER") & has_topic(T.collapse_ws("text")), F.col("seq"))
    return messages.withColumn("topic_seq", F.last(topical, ignorenulls=True).over(w)).filter(F.col("role") == "USER").select("conv_id", "seq", "topic_seq")


def fallback_query(topic: Column, current: Column, most: int = 800) -> Column:
    """The earlier topic, shortened, and the question."""
    q = T.collapse_ws(current)
    room = F.greatest(F.lit(0), F.lit(most) - F.length(q) - 1)
    return F.when(topic.isNull(), q).otherwise(F.substring(F.concat_ws(" ", T.collapse_ws(topic).substr(F.lit(1), room), q), 1, most))


def limit_references(refs: Column) -> Column:
    """References without repeats, at most five, each and all together cut to their lengths; order is kept.

    ``refs`` is an array of structs with message_id and snippet.
    """
    kept = F.slice(F.array_distinct(F.filter(refs, lambda r: ~T.is_blank(r["snippet"]))), 1, MAX_REFERENCES)
    cut = F.transform(kept, lambda r: F.struct(r["message_id"].alias("message_id"), F.substring(r["snippet"], 1, REFERENCE_CHARS).alias("snippet")))
    before = lambda i: F.aggregate(F.slice(cut, 1, i), F.lit(0), lambda a, r: a + F.length(r["snippet"]))
    limited = F.transform(cut, lambda r, i: F.struct(r["message_id"].alias("message_id"), r["snippet"].substr(F.lit(1), F.greatest(F.lit(0), F.lit(REFERENCES_TOTAL) - before(i))).alias("snippet")))
    return F.filter(limited, lambda r: r["snippet"] != "")


def render_history(messages: DataFrame, last: int = 6) -> DataFrame:
    """(conv_id, history): the last messages as lines."""
    w = Window.partitionBy("conv_id").orderBy(F.col("seq").desc())
    rows = messages.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= last)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), T.collapse_ws(x["text"])))
    return rows.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("history"))


def agent_type(stored: Column, role: Column, mode: Column) -> Column:
    """The agent of a message; older rows show it by their retrieval mode, users have none."""
    return F.when(stored.isNotNull(), stored).when(role != "ASSISTANT", F.lit(None)).when(mode.isNotNull(), "KNOWLEDGE_BASE").otherwise("GENERAL_CHAT")


def isolated(messages: DataFrame, agent: str) -> DataFrame:
    """Answers of another agent become background for this one."""
    other = (F.col("role") == "ASSISTANT") & F.col("agent").isNotNull() & (F.col("agent") != agent)
    return messages.withColumn("role", F.when(other, "BACKGROUND").otherwise(F.col("role")))


def stored_answers(events: DataFrame) -> DataFrame:
    """What is stored of answer streams (stream_id, n, event, data): (stream_id, text, status).

    Deltas are joined up to the first end; ``done`` is DONE, ``error`` is ERROR, no end is STOPPED; blank answers
    aren't stored.
    """
    w = Window.partitionBy("stream_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col("event").isin("done", "error").cast("int")).over(w), F.lit(0))
    rows = events.withColumn("_e", ended).filter("_e = 0")
    deltas = F.array_sort(F.collect_list(F.when(F.col("event") == "delta", F.struct("n", "data"))))
    out = rows.groupBy("stream_id").agg(F.array_join(F.transform(deltas, lambda x: x["data"]), "").alias("text"), F.max(F.when(F.col("event").isin("done", "error"), F.upper("event"))).alias("_s"))
    return out.filter(~T.is_blank("text")).select("stream_id", "text", F.coalesce("_s", F.lit("STOPPED")).alias("status"))


def route(use_knowledge_base: Column) -> Column:
    """The agent that answers a message."""
    return F.when(F.coalesce(use_knowledge_base, F.lit(False)), "KNOWLEDGE_BASE").otherwise("GENERAL_CHAT")

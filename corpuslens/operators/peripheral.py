"""Smaller transforms: catalogues, web results, event-stream frames, outlines, rewrites, settings."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators.graph import salvage_json

MAX_QUERY = 800

# fixed values: categories of system issues
ISSUE_CATEGORIES = {
    "retrieval": ["INDEX_INCONSISTENT"],
    "capability": ["EMBEDDING_UNCONFIGURED"],
    "graph": ["GRAPH_STALE"],
    "content-risk": ["DUPLICATE_DOCUMENT_CONTENT", "POSSIBLE_VERSION_CONFLICT"],
}


def web_results(rows: DataFrame) -> DataFrame:
    """Web results with a url: id, url, title, the highlights as lines, and the score (0 if there is none)."""
    keep = rows.filter(~T.is_blank("url"))
    return keep.select(T.web_source_id("url").alias("id"), "url", T.trim_ws(F.coalesce("title", F.lit(""))).alias("title"), F.array_join("highlights", "\n").alias("content"), F.coalesce("score", F.lit(0.0)).alias("score"))


def numbered(local: DataFrame, web: DataFrame, order: str = "rank") -> DataFrame:
    """Sources numbered in hit order; web sources go on after the local ones.  Both are short lists of hits."""
    both = local.withColumn("_w", F.lit(0)).unionByName(web.withColumn("_w", F.lit(1)))
    return both.withColumn("number", F.row_number().over(Window.partitionBy("query_id").orderBy("_w", order))).drop("_w")


def model_options(rows: DataFrame, json: str = "json") -> DataFrame:
    """(id, owner) of the entries of ``data`` in a catalogue's JSON, without blank ids, each once."""
    parsed = F.from_json(json, "data array<struct<id: string, owned_by: string>>")
    out = rows.select(F.explode(parsed["data"]).alias("d")).select(T.trim_ws("d.id").alias("id"), F.col("d.owned_by").alias("owner"))
    return out.filter(F.coalesce("id", F.lit("")) != "").groupBy("id").agg(F.min("owner").alias("owner"))


def capability(node_fields: Column, model_id: Column, embedding: list[str], chat: list[str]) -> Column:
    """EMBEDDING, CHAT or UNKNOWN by hints in the capability fields, then by embedding hints in the id."""
    has = lambda c, hints: c.rlike("|".join(f"\\Q{h}\\E" for h in hints))
    fields, name = F.lower(F.coalesce(node_fields, F.lit(""))), F.lower(F.coalesce(model_id, F.lit("")))
    return F.when(has(fields, embedding), "EMBEDDING").when(has(fields, chat), "CHAT").when(has(name, embedding), "EMBEDDING").otherwise("UNKNOWN")


#: A string of a JSON text: a name (group 1 is empty then) or a value (group 1, with its escapes).
_JSON_STRING = r'"(?:[^"\\]|\\.)*"\s*:|"((?:[^"\\]|\\.)*)"'


def string_values(json: Column, field: str) -> Column:
    """All strings that are values in a field of a JSON object, at any depth; none if the text is no JSON or lacks the field."""
    inside = F.to_json(F.try_variant_get(F.try_parse_json(json), f"$.{field}", "variant"))
    return F.filter(F.coalesce(F.regexp_extract_all(inside, F.lit(_JSON_STRING), F.lit(1)), F.array().cast("array<string>")), lambda x: x != "")


def json_capability(json: Column, fields: list[str], model_id: Column, embedding: list[str], chat: list[str]) -> Column:
    """:func:`capability` by the strings inside some fields of a catalogue's entry, however deep they are nested."""
    values = F.array_join(F.concat(*[string_values(json, f) for f in fields]), "\n")
    return capability(values, model_id, embedding, chat)


def rank_options(options: DataFrame, role: str, group: str) -> DataFrame:
    """Options of each ``group`` with their ``place``: those that fit the role, those of which nothing is known, the others; then by id."""
    fits, other = ("EMBEDDING", "CHAT") if role == "EMBEDDING" else ("CHAT", "EMBEDDING")
    rank = F.when(F.col("capability") == fits, 0).when(F.col("capability") == other, 2).otherwise(1)
    return options.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(rank, "id")))


def frames(lines: DataFrame, stream: str = "stream_id", n: str = "n", line: str = "line") -> DataFrame:
    """Events of event streams given line by line: (stream, frame, event, data), data lines joined.

    A blank line ends a frame; one blank after ``data:`` is a separator; frames without data are nothing.
    """
    w = Window.partitionBy(stream).orderBy(n).rowsBetween(Window.unboundedPreceding, -1)
    text = F.regexp_replace(line, "\r$", "")
    rows = lines.withColumn("_l", text).withColumn("frame", F.coalesce(F.sum((F.col("_l") == "").cast("int")).over(w), F.lit(0)))
    rows = rows.filter("_l <> ''")
    name = F.when(F.col("_l").startswith("event:"), T.trim_ws(F.substring("_l", 7, 1 << 30)))
    data = F.when(F.col("_l").startswith("data:"), F.regexp_replace(F.substring("_l", 6, 1 << 30), "^ ", ""))
    got = rows.groupBy(stream, "frame").agg(
        F.coalesce(F.max_by(name, F.when(name.isNotNull(), F.col(n))), F.lit("message")).alias("event"),
        F.array_sort(F.collect_list(F.when(data.isNotNull(), F.struct(F.col(n).alias("n"), data.alias("d"))))).alias("_d"),
    )
    return got.filter(F.size("_d") > 0).select(stream, F.col("frame").cast("long").alias("frame"), "event", F.array_join(F.transform("_d", lambda x: x["d"]), "\n").alias("data"))


def unfinished(events: DataFrame, stream: str = "stream_id", ends: tuple[str, ...] = ("done", "error")) -> DataFrame:
    """Streams without a closing event."""
    return events.groupBy(stream).agg(F.bool_or(F.col("event").isin(*ends)).alias("_e")).filter("NOT _e").select(stream)


def outline(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Headings (levels 1 to 4) of Markdown texts with their parents: key, line, level, label, type, mentions, parent.

    The parent is the latest heading one level up that no heading above that level has closed.
    """
    flat = rows.select(key, F.posexplode(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n")).alias("line", "_t")).withColumn("_t", T.trim_ws("_t"))
    flat = flat.filter(F.col("_t").rlike(r"^#{1,4}\s+.+$"))
    level, label = F.length(F.regexp_extract("_t", "^(#+)", 1)), T.trim_ws(F.regexp_extract("_t", r"^#+\s+(.+)$", 1))
    entity = r"^(.+?)\s+\[([^\]]+)]\s+[xX](\d+)$"
    flat = flat.withColumns({"level": level, "_label": label})
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.lit(None).cast("int")
    for k in (2, 3, 4):
        up = F.last(F.when(F.col("level") == k - 1, F.col("line")), ignorenulls=True).over(w)
        closed = F.last(F.when(F.col("level") < k - 1, F.col("line")), ignorenulls=True).over(w)
        parent = F.when(F.col("level") == k, F.when(closed.isNull() | (up > closed), up)).otherwise(parent)
    mark = F.col("_label").rlike(entity)
    kind = F.when(F.col("level") == 1, "SCOPE").when(F.col("level") == 2, "DOCUMENT").when(F.col("level") == 3, "HEADING").when(mark, F.regexp_extract("_label", entity, 2)).otherwise("ENTITY")
    return flat.select(
        key, "line", "level", F.when(mark, F.regexp_extract("_label", entity, 1)).otherwise(F.col("_label")).alias("label"), kind.alias("type"),
        F.when(mark, F.regexp_extract("_label", entity, 3).cast("int")).otherwise(0).alias("mentions"), parent.alias("parent"),
    )


def rewrite_verdict(question: Column, response: Column, most: int = MAX_QUERY) -> Column:
    """Struct (query, rewritten, reason, confidence) from a model's answer; anything amiss keeps the question."""
    p = F.from_json(salvage_json(response), "shouldRewrite boolean, rewrittenQuery string, reason string, confidence double")
    new = T.trim_ws(F.coalesce(p["rewrittenQuery"], F.lit("")))
    why = (
        F.when(p.isNull(), "invalid_json")
        .when(p["shouldRewrite"].isNull() | p["reason"].isNull() | p["confidence"].isNull(), "contextualizer_fields_missing")
        .when(~p["shouldRewrite"], F.coalesce(F.nullif(T.trim_ws(p["reason"]), F.lit("")), F.lit("model_kept_original")))
        .when(new == "", "rewritten_query_blank")
        .when(F.length(new) > most, "rewritten_query_too_long")
    )
    ok = why.isNull()
    return F.struct(
        F.when(ok, new).otherwise(question).alias("query"), ok.alias("rewritten"),
        F.coalesce(why, F.nullif(T.trim_ws(p["reason"]), F.lit("")), F.lit("model_rewrote_query")).alias("reason"),
        F.when(ok, F.least(F.lit(1.0), F.greatest(F.lit(0.0), p["confidence"]))).otherwise(0.0).alias("confidence"),
    )


def issue_categories(issues: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """(category, issues, active): issues of each category, and the weight of those that aren't ignored."""
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(code).alias("code")) for c, codes in ISSUE_CATEGORIES.items() for code in codes])
    kinds = issues.sparkSession.range(1).select(F.explode(pairs).alias("p")).select("p.*")
    rows = issues.join(F.broadcast(kinds), "code")
    if ignored is not None:
        rows = rows.join(ignored.select("code", "scope_id", F.lit(True).alias("_i")), ["code", "scope_id"], "left")
    else:
        rows = rows.withColumn("_i", F.lit(None).cast("boolean"))
    weight = F.when(F.col("_i").isNull(), F.when(F.col("count") > 0, F.col("count")).otherwise(1)).otherwise(0)
    return rows.groupBy("category").agg(F.count("*").alias("issues"), F.sum(weight).cast("long").alias("active"))


def setting(stored: Column, default) -> Column:
    """A stored setting, or the configured one where none is stored."""
    return F.coalesce(stored, F.lit(default))


def clamped(requested: Column, existing: Column, default, low, high) -> Column:
    """A number by request, else as it is, else by default; kept within its bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(requested, existing, F.lit(default))))


def promote(configs: DataFrame) -> DataFrame:
    """Each role has one active configuration: the first active one, or the latest if none is."""
    w = Window.partitionBy("role").orderBy(F.col("active").desc(), F.desc("updated_at"), "id")
    return configs.withColumn("active", F.row_number().over(w) == 1)


def activate(configs: DataFrame, config_id: str) -> DataFrame:
    """Make one configuration the active one of its role."""
    role = configs.filter(F.col("id") == config_id).select(F.col("role").alias("_role"))
    rows = configs.join(F.broadcast(role), F.col("role") == F.col("_role"), "left")
    return rows.withColumn("active", F.when(F.col("_role").isNull(), F.col("active")).otherwise(F.col("id") == config_id)).drop("_role")


def embed(rows: DataFrame, text: str, embedder, dimensions: int, batch: int = 16) -> DataFrame:
    """``embedding`` of a text column by an injected function of a list of texts; sizes are checked."""
    batch = max(1, min(128, batch))

    def run(texts: pd.Series) -> pd.Series:
        out: list = []
        values = texts.fillna("").tolist()
        for i in range(0, len(values), batch):
            got = embedder(values[i : i + batch])
            if len(got) != len(values[i : i + batch]) or any(len(v) != dimensions for v in got):
                raise ValueError(f"the embedder gave vectors of another number or size than {dimensions}")
            out += [[float(x) for x in v] for v in got]
        return pd.Series(out)

    return rows.withColumn("embedding", F.pandas_udf(run, "array<float>")(text))


class SearchTool:
    """The one tool a model may call: a web search with a cap on the calls of a turn; failures are returned as data.

    ``search`` takes a query and gives results; every call is recorded with its query, result and success.
    """

    def __init__(self, search: Callable[[str], list[dict]], max_calls: int = 3):
        self._search, self._max, self._calls = search, max_calls, 0
        self.records: list[dict] = []

    def __call__(self, query: str | None) -> dict:
        text = " ".join((query or "").split())[:300]
        if not text:
            return self._record("", {"success": False, "message": "the query is empty", "results": []})
        try:
            self._calls += 1
            if self._calls > self._max:
                raise RuntimeError("no more searches in this turn")
            out = {"success": True, "message": None, "results": list(self._search(text))}
        except Exception as e:  # noqa: BLE001  a failure is an answer
            out = {"success": False, "message": str(e), "results": []}
        return self._record(text, out)

    def _record(self, query: str, out: dict) -> dict:
        self.records.append({"tool": "searchWeb", "query": query, **out})
        return out

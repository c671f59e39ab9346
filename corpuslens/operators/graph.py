"""Knowledge graph: cached extractions, evidence-checked merge, degrees, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import canonical as C
from corpuslens.functions import text as T
from corpuslens.session import written_once

MAX_NODES, MAX_EDGES = 24, 32
NAME_CHARS, DESCRIPTION_CHARS, QUOTE_CHARS = 120, 280, 260
TOP_NODES, TOP_ENTITIES = 100, 12
PAYLOAD = (
    "nodes array<struct<name: string, type: string, description: string, confidence: double, quote: string>>, "
    "edges array<struct<source: string, target: string, type: string, displayLabel: string, description: string, confidence: double, quote: string>>"
)


def cached(chunks: DataFrame, extractions: DataFrame, prompt_version: str, model_config_id: str | None) -> DataFrame:
    """Chunks whose stored extraction is still good: same content, prompt and model."""
    good = extractions.filter((F.col("status") == "EXTRACTED") & (F.col("prompt_version") == prompt_version) & F.col("model_config_id").eqNullSafe(F.lit(model_config_id)))
    return chunks.join(good.select("chunk_id", "content_hash", "extraction_json"), ["chunk_id", "content_hash"])


def salvage_json(x: str | Column) -> Column:
    """From the first opening to the last closing brace; null without both."""
    x = F.col(x) if isinstance(x, str) else x
    return F.nullif(F.regexp_extract(x, r"(?s)\{.*\}", 0), F.lit(""))


def sanitise(payload: Column) -> Column:
    """At most MAX_NODES and MAX_EDGES with names, trimmed texts and confidences from 0 to 1."""
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0))))
    nodes = F.slice(F.filter(F.coalesce(payload["nodes"], F.array()), lambda n: ~T.is_blank(n["name"])), 1, MAX_NODES)
    edges = F.slice(F.filter(F.coalesce(payload["edges"], F.array()), lambda e: ~T.is_blank(e["source"]) & ~T.is_blank(e["target"])), 1, MAX_EDGES)
    return F.struct(
        F.transform(nodes, lambda n: F.struct(
            C.shown(n["name"], NAME_CHARS).alias("name"), C.node_type(n["type"]).alias("type"), C.shown(n["description"], DESCRIPTION_CHARS).alias("description"),
            unit(n["confidence"]).alias("confidence"), C.shown(n["quote"], QUOTE_CHARS).alias("quote"))).alias("nodes"),
        F.transform(edges, lambda e: F.struct(
            C.shown(e["source"], NAME_CHARS).alias("source"), C.shown(e["target"], NAME_CHARS).alias("target"), C.relation_type(e["type"]).alias("type"),
            C.display_label(e["displayLabel"]).alias("label"), C.shown(e["description"], DESCRIPTION_CHARS).alias("description"),
            unit(e["confidence"]).alias("confidence"), C.shown(e["quote"], QUOTE_CHARS).alias("quote"))).alias("edges"),
    )


def parse_extractions(rows: DataFrame) -> DataFrame:
    """chunk_id, document_id, content and the sanitised payload of ``extraction_json``."""
    p = F.from_json(salvage_json("extraction_json"), PAYLOAD, {"mode": "PERMISSIVE"})
    return rows.select("chunk_id", "document_id", "content", T.let(p, sanitise).alias("payload"))


#: Where quotes are joined, so that all of a chunk's are prepared at once.
_BETWEEN = "\u0001"


def _quotes(items: Column) -> Column:
    """The quotes of all items as evidence text, between marks."""
    return C.evidence_text(F.array_join(F.transform(items, lambda x: F.translate(F.coalesce(x["quote"], F.lit("")), _BETWEEN, "")), _BETWEEN))


def _checked(items: Column, quotes: Column, text: Column) -> Column:
    """Array of (x, found): each item, and whether its quote stands in the text, which is evidence text."""
    # bound, so that the text is prepared once and not for every item
    found = lambda b: F.zip_with(items, b["quotes"], lambda x, q: F.struct(x.alias("x"), ((q != "") & F.contains(b["text"], q)).alias("found")))
    return F.slice(T.let(F.struct(text.alias("text"), F.split(quotes, _BETWEEN, -1).alias("quotes")), found), 1, F.size(items))


NODE_KEY, EDGE_KEY = ["canonical", "node_type"], ["a_name", "a_type", "b_name", "b_type", "type", "label"]
_NODE_ORDER, _EDGE_ORDER = ["document_id", "chunk_id", "kind", "pos"], ["document_id", "chunk_id", "pos"]


def _first_of_each(items: Column, *key: str) -> Column:
    """Items of an array without those whose key an earlier one has."""

    def kept(xs: Column) -> Column:
        keys = F.transform(xs, lambda x: F.struct(*[x[k] for k in key]))
        return T.let(keys, lambda ks: F.filter(xs, lambda x, i: F.array_position(ks, F.struct(*[x[k] for k in key])) == i + 1))

    return T.let(items, kept)


def _named(parsed: DataFrame, canonical, unique: bool) -> DataFrame:
    """A row for each chunk: its nodes and edges with canonical names and whether their quotes were found."""
    text = C.evidence_text(F.translate(F.coalesce("content", F.lit("")), _BETWEEN, ""))
    p = {c: F.coalesce(F.col(f"payload.{c}"), F.array()) for c in ("nodes", "edges")}
    names = F.concat(p["nodes"]["name"], p["edges"]["source"], p["edges"]["target"])
    rows = parsed.select("document_id", "chunk_id", "payload", text.alias("_text"), _quotes(p["nodes"]).alias("_n"), _quotes(p["edges"]).alias("_e"), canonical(names).alias("names"))
    own = {c: _checked(p[c], F.col(q), F.col("_text")).alias(c) for c, q in (("nodes", "_n"), ("edges", "_e"))}
    rows = rows.select("document_id", "chunk_id", *own.values(), "names")
    if unique:
        return rows
    every = F.array_sort(F.collect_list(F.struct("nodes", "edges", "names")))
    rows = rows.groupBy("document_id", "chunk_id").agg(every.alias("_all"))
    part = lambda f: F.flatten(F.transform("_all", f))
    ends = lambda k: part(lambda r: F.slice(r["names"], F.size(r["nodes"]) + 1 + k * F.size(r["edges"]), F.size(r["edges"])))
    named = F.concat(part(lambda r: F.slice(r["names"], 1, F.size(r["nodes"]))), ends(0), ends(1))
    return rows.select("document_id", "chunk_id", part(lambda r: r["nodes"]).alias("nodes"), part(lambda r: r["edges"]).alias("edges"), named.alias("names"))


def _accepted(row: Column) -> Column:
    """Edges of a chunk whose quote was found and whose two different ends it names; an end is the first node of its name."""
    n, m = F.size(row["nodes"]), F.size(row["edges"])
    own = T.let(F.slice(row["names"], 1, n), lambda names: F.transform(row["edges"], lambda e, i: F.struct(
        e.alias("e"), i.alias("pos"), F.array_position(names, F.get(row["names"], n + i)).alias("_a"), F.array_position(names, F.get(row["names"], n + m + i)).alias("_b"))))
    met = F.filter(own, lambda e: e["e"]["found"] & (e["_a"] > 0) & (e["_b"] > 0))

    def filled(e: Column) -> Column:
        ends = []
        for c in ("a", "b"):
            at = (e[f"_{c}"] - 1).cast("int")
            node = F.get(row["nodes"], at)["x"]
            ends += [F.get(row["names"], at).alias(f"{c}_name"), node["type"].alias(f"{c}_type"), node["name"].alias(f"{c}_shown")]
        x = e["e"]["x"]
        return F.struct("document_id", "chunk_id", e["pos"].alias("pos"), *ends, *[x[c].alias(c) for c in ("type", "label", "description", "confidence", "quote")])

    return F.filter(F.transform(met, filled), lambda e: (e["a_name"] != e["b_name"]) | (e["a_type"] != e["b_type"]))


def evidence(parsed: DataFrame, canonical=C.canonical_names, unique: bool = False) -> tuple[DataFrame, DataFrame]:
    """Evidence of nodes and of edges of sanitised extractions, each once for a chunk and quote.

    A node needs a quote found in its chunk; an edge needs one too, and two different ends that its chunk names.
    An accepted edge is evidence for its ends.  All of that is decided inside the chunk's row, whose nodes and edges are
    bounded, so neither text nor evidence is shuffled.  ``canonical`` gives the canonical names of an array of names;
    ``unique`` says that ``parsed`` has one row for each chunk, else the rows of a chunk are put together first.
    """
    rows, row = _named(parsed, canonical, unique), F.struct("nodes", "edges", "names")
    keep = ["document_id", "chunk_id"]
    node_schema = [*_NODE_ORDER, *NODE_KEY, "name", "description", "confidence", "quote"]

    def node_items(r: Column) -> Column:
        def own(n: Column, i: Column) -> Column:
            x = n["x"]
            return F.struct(*keep, F.lit(0).alias("kind"), i.alias("pos"), F.get(r["names"], i).alias("canonical"), x["type"].alias("node_type"), x["name"].alias("name"), x["description"].alias("description"), x["confidence"].alias("confidence"), x["quote"].alias("quote"), n["found"].alias("found"))

        def end(e: Column, c: str) -> Column:
            return F.struct(*keep, F.lit(1).alias("kind"), e["pos"].alias("pos"), e[f"{c}_name"].alias("canonical"), e[f"{c}_type"].alias("node_type"), e[f"{c}_shown"].alias("name"), F.lit("").alias("description"), e["confidence"].alias("confidence"), e["quote"].alias("quote"), F.lit(True).alias("found"))

        mine = F.filter(F.transform(r["nodes"], own), lambda n: n["found"])
        ends = F.flatten(F.transform(_accepted(r), lambda e: F.array(end(e, "a"), end(e, "b"))))
        return _first_of_each(F.concat(mine, ends), *NODE_KEY, "quote")

    def flat(items, columns: list[str]) -> DataFrame:
        # outer, as the optimizer would else evaluate the array once more to filter by its size
        return rows.select(F.explode_outer(T.let(row, items)).alias("i")).filter(F.col("i").isNotNull()).select(*[F.col(f"i.{c}").alias(c) for c in columns])

    nodes = flat(node_items, node_schema).select("document_id", "chunk_id", "pos", *NODE_KEY, "name", "description", "confidence", "quote", "kind")
    edges = flat(lambda r: _first_of_each(_accepted(r), *EDGE_KEY, "quote"), [*_EDGE_ORDER, *EDGE_KEY, "description", "confidence", "quote"])
    return nodes, edges


def _partials(rows: DataFrame, key: list[str], order: list[str], name: str | None) -> DataFrame:
    at = [F.col(c) for c in order]
    shown = {"shown": F.min(F.struct(*at, F.col(name).alias("value")))} if name else {}
    aggs = {"mentions": F.count("*"), "total": F.sum("confidence"), **shown, "described": F.min(F.when(F.col("description") != "", F.struct(*at, F.col("description").alias("value"))))}
    return rows.groupBy(*key, "document_id").agg(*[c.alias(n) for n, c in aggs.items()])


def node_partials(node_evidence: DataFrame) -> DataFrame:
    """What each document adds to each node: a table that can be kept, and that deltas are made of."""
    return _partials(node_evidence, NODE_KEY, _NODE_ORDER, "name")


def edge_partials(edge_evidence: DataFrame) -> DataFrame:
    return _partials(edge_evidence, EDGE_KEY, _EDGE_ORDER, None)


def _combined(partials: DataFrame, key: list[str]) -> DataFrame:
    shown = [F.min("shown")["value"].alias("display_name")] if "shown" in partials.columns else []
    return partials.groupBy(*key).agg(
        F.sum("mentions").alias("mention_count"), (F.sum("total") / F.sum("mentions")).alias("confidence"), *shown, F.coalesce(F.min("described")["value"], F.lit("")).alias("description"),
    )


def nodes_of(partials: DataFrame) -> DataFrame:
    return _combined(partials, NODE_KEY).withColumn("id", T.stable_id(F.concat_ws("|", *NODE_KEY)))


def edges_of(partials: DataFrame) -> DataFrame:
    return _combined(partials, EDGE_KEY)


def apply_delta(partials: DataFrame, rows: DataFrame, new: DataFrame, changed: DataFrame, key: list[str], rows_of) -> tuple[DataFrame, DataFrame]:
    """Partials and rows of a graph after documents changed, whose rows elsewhere stay as they are.

    ``new``: partials of the documents as they are now; ``changed``: document_id of all that were added, edited or
    deleted.  Only keys that one of those documents has, or had, are put together again.
    """
    gone = partials.join(changed, "document_id", "left_semi")
    touched = written_once(gone.select(*key).unionByName(new.select(*key)).distinct())
    now = partials.join(changed, "document_id", "left_anti").unionByName(new)
    again = rows_of(now.join(touched, key, "left_semi"))
    return now, rows.join(touched, key, "left_anti").unionByName(again.select(*rows.columns))


def merge(parsed: DataFrame, canonical=C.canonical_names, unique: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and evidence of sanitised extractions; both ends of an edge are among the nodes, as it is evidence for them."""
    node_evidence, edge_evidence = evidence(parsed, canonical, unique)
    first = F.struct(*_NODE_ORDER)
    node_rows = node_evidence.groupBy(*NODE_KEY).agg(
        F.count("*").alias("mention_count"), F.avg("confidence").alias("confidence"), F.min_by("name", first).alias("display_name"),
        F.coalesce(F.min_by("description", F.when(F.col("description") != "", first)), F.lit("")).alias("description"),
    )
    node_rows = node_rows.withColumn("id", T.stable_id(F.concat_ws("|", *NODE_KEY)))
    at = F.struct(*_EDGE_ORDER)
    edge_rows = edge_evidence.groupBy(*EDGE_KEY).agg(F.count("*").alias("mention_count"), F.avg("confidence").alias("confidence"), F.coalesce(F.min_by("description", F.when(F.col("description") != "", at)), F.lit("")).alias("description"))
    return node_rows, edge_rows.select(*EDGE_KEY, "mention_count", "confidence", "description"), node_evidence.drop("kind")


def degrees(edges: DataFrame, a: str = "source", b: str = "target") -> DataFrame:
    """(node, degree): edges that end at a node, on either side."""
    return edges.select(F.explode(F.array(a, b)).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def induced(edges: DataFrame, nodes: DataFrame, node: str = "node", a: str = "source", b: str = "target") -> DataFrame:
    """Edges whose ends are both among the nodes."""
    n = nodes.select(F.col(node).alias("_n"))
    return edges.join(n, F.col(a) == F.col("_n"), "left_semi").join(n, F.col(b) == F.col("_n"), "left_semi")


def top_nodes(nodes: DataFrame, edges: DataFrame, most: int = TOP_NODES) -> DataFrame:
    """The nodes of the graph view: most mentions, then highest degree, then name."""
    d = degrees(edges)
    out = nodes.join(d, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return out.orderBy(F.desc("mentions"), F.desc("degree"), F.lower(F.upper("node")), "node").limit(most)


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """(type, n): blank types count as UNKNOWN."""
    kind = F.when(T.is_blank(column), "UNKNOWN").otherwise(T.trim_ws(column))
    return rows.groupBy(kind.alias("type")).agg(F.count("*").alias("n"))


def top_entities(mentions: DataFrame, most: int = TOP_ENTITIES) -> DataFrame:
    """(doc_id, heading, node, n, rank): the most mentioned nodes under each heading."""
    n = mentions.groupBy("doc_id", "heading", "node").agg(F.count("*").alias("n"))
    w = Window.partitionBy("doc_id", "heading").orderBy(F.desc("n"), F.lower(F.upper("node")), "node")
    return n.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def mind_map(top: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, file_name, headings): nested view of the top entities under each heading."""
    inner = top.groupBy("doc_id", "heading").agg(F.array_sort(F.collect_list(F.struct("rank", "node", "n"))).alias("entities"))
    outer = inner.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("heading", "entities"))).alias("headings"))
    return docs.select("doc_id", "file_name").join(outer, "doc_id").orderBy(F.lower(F.upper("file_name")), "doc_id")


def view_flags(views: DataFrame) -> DataFrame:
    """(scope_type, scope_id, has_mindmap, has_graph) of each scope, null ids together."""
    return views.groupBy("scope_type", "scope_id").agg(F.bool_or(F.col("view_type") == "MINDMAP").alias("has_mindmap"), F.bool_or(F.col("view_type") == "GRAPH").alias("has_graph"))


def filter_generated(graphs: DataFrame, keyword: str | None = None, scope_type: str | None = None, view: str | None = None) -> DataFrame:
    """Generated graphs whose name, subtitle or kind of scope has the keyword, of one kind of scope, and with a view that is ready.

    ``graphs`` has scope_type, scope_name, scope_subtitle, has_mindmap and has_graph; None leaves a part out.
    """
    word = (keyword or "").strip().lower()
    if word:
        blank = lambda c: F.nullif(F.col(c), F.lit(""))
        graphs = graphs.filter(F.contains(F.lower(F.concat_ws(" ", blank("scope_name"), blank("scope_subtitle"), blank("scope_type"))), F.lit(word)))
    if scope_type:
        graphs = graphs.filter(F.col("scope_type") == scope_type)
    return graphs if view is None else graphs.filter({"MINDMAP": "has_mindmap", "GRAPH": "has_graph"}[view])


def mind_map_filter(nodes: DataFrame, edges: DataFrame, query: str | None = None, types: list[str] | None = None, depth: int = 4) -> tuple[DataFrame, DataFrame]:
    """Nodes of a mind map that match, with all their ancestors and their own children, and the edges between those.

    ``nodes`` has id, label, kind and type, ``edges`` source (the parent) and target; a map has at most ``depth``
    levels (scope, document, heading, entity).  Types hold for entities only.  Where nothing matches and no query was
    given, everything is shown.
    """
    word = (query or "").strip().lower()
    kinds = (F.col("kind") != "entity") | F.col("type").isin(*types) if types else F.lit(True)
    hit = nodes.filter(kinds & (F.contains(F.lower("label"), F.lit(word)) if word else F.lit(True))).select("id")
    kept, level = hit, hit
    for _ in range(depth - 1):
        level = edges.join(level, F.col("target") == F.col("id"), "left_semi").select(F.col("source").alias("id"))
        kept = kept.unionByName(level)
    kept = kept.unionByName(edges.join(hit, F.col("source") == F.col("id"), "left_semi").select(F.col("target").alias("id"))).distinct()
    if not word:
        none = hit.agg((F.count("*") == 0).alias("none"))  # one row
        kept = kept.unionByName(nodes.join(F.broadcast(none)).filter("none").select("id")).distinct()
    shown = nodes.join(kept, "id", "left_semi")
    return shown, induced(edges, shown, "id")


def explorer_filter(nodes: DataFrame, edges: DataFrame, types: list[str] | None, label: str | None, relations: list[str] | None, min_weight: int) -> tuple[DataFrame, DataFrame]:
    """Nodes by type and label; edges between kept nodes by relation and weight."""
    if types:
        nodes = nodes.filter(F.col("type").isin(*types))
    if label and label.strip():
        nodes = nodes.filter(F.contains(F.lower("node"), F.lit(label.strip().lower())))
    edges = edges.filter(F.col("weight") >= min_weight)
    if relations:
        edges = edges.filter(F.col("relation").isin(*relations))
    return nodes, induced(edges, nodes)


def delete_scope(tables: dict[str, DataFrame], scope_type: str, scope_id: str | None) -> dict[str, DataFrame]:
    """All tables of the graph without one scope; evidence goes with its nodes and edges."""
    mine = (F.col("scope_type") == scope_type) & F.col("scope_id").eqNullSafe(F.lit(scope_id))
    gone = {n: tables[n].filter(mine).select("id") for n in ("nodes", "edges", "runs")}
    evidence = tables["evidence"]
    for column, name in (("node_id", "nodes"), ("edge_id", "edges"), ("run_id", "runs")):
        evidence = evidence.join(gone[name].select(F.col("id").alias(column)), column, "left_anti")
    return {n: t.filter(~mine) for n, t in tables.items() if n != "evidence"} | {"evidence": evidence.select(*tables["evidence"].columns)}


def co_occurrences(docs: DataFrame, most: int = MAX_NODES) -> tuple[DataFrame, DataFrame]:
    """A stand-in extractor: capitalised words are entities, neighbours in a row's list of them are related.

    Returns mentions (doc_id, node) and edges (doc_id, source, target); a row, which should be a chunk, gives at most ``most`` entities.
    """
    words = F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Z][a-z]{3,}"), F.lit(0))), 1, most)
    rows = docs.select("doc_id", words.alias("w"))
    mentions = rows.select("doc_id", F.explode("w").alias("node"))
    pairs = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("source"), F.get("w", i + 1).alias("target"))), lambda p: p["target"].isNotNull())
    return mentions, rows.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.source", "p.target")


def evidence_star(evidence: DataFrame, chunks: DataFrame, documents: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Evidence with its chunk and document, its node or its edge, and the edge's ends; best first."""
    n = nodes.select("id", "name")
    end = lambda c: n.select(F.col("id").alias(f"_{c}"), F.col("name").alias(c))
    out = evidence.join(chunks.select("chunk_id", "chunk_index"), "chunk_id").join(documents.select("document_id", "file_name"), "document_id")
    out = out.join(end("node_name"), F.col("node_id") == F.col("_node_name"), "left")
    out = out.join(edges.select(F.col("id").alias("_e"), "source", "target", "label"), F.col("edge_id") == F.col("_e"), "left")
    out = out.join(end("source_name"), F.col("source") == F.col("_source_name"), "left").join(end("target_name"), F.col("target") == F.col("_target_name"), "left")
    return out.select("id", "file_name", "chunk_index", "quote", "confidence", "node_name", "label", "source_name", "target_name")


def enrich_view(view_edges: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of a stored view, with what older views lack taken from the edge table."""
    e = edges.select(F.col("id").alias("_id"), F.col("label").alias("_label"), F.col("description").alias("_description"), F.col("confidence").alias("_confidence"))
    out = view_edges.join(e, F.col("id") == F.col("_id"), "left")
    pick = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}"))
    return out.select("id", pick("label").alias("label"), pick("description").alias("description"), F.coalesce("confidence", "_confidence").alias("confidence"))


def scope_documents(docs: DataFrame, scope_type: str, scope_id=None) -> DataFrame:
    """The documents of a scope; a folder that is off, or isn't there, is an error."""
    if scope_type == "ALL":
        return docs.filter(F.col("folder").isNull() | F.col("enabled"))
    found = docs.filter(F.col("folder" if scope_type == "KNOWLEDGE_FOLDER" else "doc_id") == scope_id)
    if found.filter("enabled").isEmpty():
        raise ValueError(f"no documents to use in {scope_type} {scope_id}")
    return found.filter("enabled")


def scope_names(flags: DataFrame, names: DataFrame, gone: str = "(deleted)") -> DataFrame:
    """Scopes with the names of what they stand for, or a stand-in where that is gone."""
    n = names.select(F.col("scope_type").alias("_t"), F.col("scope_id").alias("_i"), "name")
    out = flags.join(n, (F.col("scope_type") == F.col("_t")) & F.col("scope_id").eqNullSafe(F.col("_i")), "left")
    return out.select(*flags.columns, F.when(F.col("scope_type") == "ALL", "ALL").otherwise(F.coalesce("name", F.lit(gone))).alias("name"))


def graph_status(runs: DataFrame, nodes: DataFrame, edges: DataFrame, views: DataFrame) -> DataFrame:
    """One row for each scope with runs: its latest status, node and edge counts, and when its views were made."""
    key = ["scope_type", "scope_id"]
    last = runs.groupBy(*key).agg(F.max_by("status", F.struct("created_at", "run_id")).alias("status"), F.count("*").alias("runs"))

    def counted(rows: DataFrame, name: str, what=None) -> DataFrame:
        return rows.groupBy(F.col("scope_type").alias(f"_{name}t"), F.col("scope_id").alias(f"_{name}i")).agg((F.count("*") if what is None else what).alias(name))

    for rows, name, what in ((nodes, "nodes", None), (edges, "edges", None), (views, "generated_at", F.max("updated_at"))):
        c = counted(rows, name, what)
        last = last.join(c, (F.col("scope_type") == F.col(f"_{name}t")) & F.col("scope_id").eqNullSafe(F.col(f"_{name}i")), "left").drop(f"_{name}t", f"_{name}i")
    return last.withColumns({"nodes": F.coalesce("nodes", F.lit(0)).cast("long"), "edges": F.coalesce("edges", F.lit(0)).cast("long")})


#: What stands for a heading that a text doesn't have (a fixed value), and how deep headings go.
NO_HEADING, LEVELS = "未命名片段", 6


def headed_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n, line, heading, path) of the lines of Markdown texts that aren't headings.

    ``path`` is the stack of headings that are open at the line: of each level the latest, unless one of a higher level
    came after it.  ``heading`` is its last one, or the default.
    """
    lines = docs.select(key, F.posexplode(F.split(T.unify_newlines(F.coalesce(F.col(text), F.lit(""))), "\n", -1)).alias("n", "line"))
    marks = F.regexp_extract("line", r"^\s*(#{1,6})\s+\S", 1)
    lines = lines.withColumns({"_level": F.length(marks), "_title": T.trim_ws(F.regexp_replace("line", r"^\s*#{1,6}\s+", ""))})
    so_far = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    last = {f"_h{k}": F.max(F.when(F.col("_level") == k, F.struct("n", "_title"))).over(so_far) for k in range(1, LEVELS + 1)}
    lines = lines.withColumns(last)
    at = lambda k: F.coalesce(F.col(f"_h{k}.n"), F.lit(-1))
    still = [F.when(at(k) > F.greatest(F.lit(-1), F.lit(-1), *[at(j) for j in range(1, k)]), F.col(f"_h{k}._title")) for k in range(1, LEVELS + 1)]
    path = F.array_compact(F.array(*still))
    rows = lines.filter("_level = 0").withColumn("path", path)
    return rows.select(key, "n", "line", F.coalesce(F.get("path", F.size("path") - 1), F.lit(NO_HEADING)).alias("heading"), "path")


def entities_by_heading(lines: DataFrame, entity: str = "[A-Z][a-z]{3,}", key: str = "doc_id", most: int = TOP_ENTITIES) -> DataFrame:
    """(key, heading, place, node, n, rank): the entities named most under each heading; headings in the order in which they come."""
    first = lines.groupBy(key, "heading").agg(F.min("n").alias("_n"))
    first = first.select(key, "heading", F.row_number().over(Window.partitionBy(key).orderBy("_n")).alias("place"))
    found = lines.select(key, "heading", F.explode(F.regexp_extract_all("line", F.lit(entity), F.lit(0))).alias("node")).groupBy(key, "heading", "node").agg(F.count("*").alias("n"))
    w = Window.partitionBy(key, "heading").orderBy(F.desc("n"), F.lower(F.upper("node")), "node")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).join(first, [key, "heading"]).select(key, "heading", "place", "node", "n", "rank")


def evidence_places(evidence: DataFrame, of: str) -> DataFrame:
    """Evidence with its ``place`` in the list of what it is evidence of: most confident first, then newest, then by id."""
    w = Window.partitionBy(of).orderBy(F.desc("confidence"), F.desc("created_at"), "id")
    return evidence.withColumn("place", F.row_number().over(w))


def _outlines(top: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, file_name, t): the outline of each document: its name, headings in order, entities with counts."""
    entity = F.format_string("#### %s [%s] x%d", F.col("node"), F.col("type"), F.col("n"))
    heads = top.groupBy("doc_id", "heading").agg(F.array_sort(F.collect_list(F.struct("rank", entity.alias("line")))).alias("e"))
    lines = F.array_join(F.concat(F.array(F.concat(F.lit("### "), F.col("heading"))), F.transform("e", lambda x: x["line"])), "\n")
    per = heads.select("doc_id", F.struct("heading", lines.alias("lines")).alias("h")).groupBy("doc_id").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    per = per.join(docs.select("doc_id", "file_name"), "doc_id")
    text = F.array_join(F.concat(F.array(F.concat(F.lit("## "), F.col("file_name"))), F.transform("hs", lambda x: x["lines"])), "\n")
    return per.select("doc_id", "file_name", text.alias("t"))


def mind_map_markdown(top: DataFrame, docs: DataFrame, title: str) -> DataFrame:
    """(markdown): the mind map as an outline: scope, documents by name, headings in order, entities with counts.

    A view is one text; it is bounded by its scope and by the entities kept under each heading.
    """
    whole = _outlines(top, docs).agg(F.array_sort(F.collect_list(F.struct(F.lower(F.upper("file_name")).alias("o"), "doc_id", "t"))).alias("d"))
    return whole.select(F.array_join(F.concat(F.array(F.lit(f"# {title}")), F.transform("d", lambda x: x["t"])), "\n").alias("markdown"))


def document_markdown(top: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, markdown): the outline of each document's own scope, so that no text has to hold them all."""
    return _outlines(top, docs).select("doc_id", F.concat(F.lit("# "), "file_name", F.lit("\n"), "t").alias("markdown"))


def graph_view(nodes: DataFrame, edges: DataFrame, most: int = TOP_NODES) -> DataFrame:
    """One row: the payload of a graph view with its shown nodes, hidden count, induced edges and histograms."""
    top = top_nodes(nodes, edges, most)
    shown = top.agg(F.count("*").alias("shown"), F.array_sort(F.collect_list(F.struct(F.negative("mentions").alias("o"), "node", "mentions", "degree"))).alias("nodes"))
    total = nodes.agg(F.count("*").alias("total"))
    inside = induced(edges, top).agg(F.count("*").alias("edge_count"), F.array_sort(F.collect_list(F.struct("source", "target"))).alias("edges"))
    kinds = histogram(nodes, "type").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("types"))
    row = shown.join(F.broadcast(total)).join(F.broadcast(inside)).join(F.broadcast(kinds))  # one row each
    return row.select("total", "shown", (F.col("total") - F.col("shown")).alias("hidden"), "edge_count", F.transform("nodes", lambda x: x.dropFields("o")).alias("nodes"), "edges", "types")

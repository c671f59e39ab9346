"""Text functions, chunking and canonical names against small cases and plain Python models."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslens.functions import canonical as C
from corpuslens.functions import text as T
from corpuslens.functions import urls
from corpuslens.operators import chunk


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def many(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_plain_window_sizes():
    assert list(map(len, chunk.chunk_section("a" * 1850))) == [1800, 250]
    assert list(map(len, chunk.chunk_section("a" * 1800))) == [1800]


def test_clean_keeps_code_indents():
    text = "one\r\n\r\n\r\n\r\ntwo \t  three\n```py\n\tif x:\n\t\ty    = 1\n```\nend"
    assert chunk.clean_text(text) == "one\n\ntwo three\n```py\n\tif x:\n\t\ty    = 1\n```\nend"


def test_small_fence_is_one_chunk():
    text = "# Title\n\n```java\nclass A {}\n```"
    assert chunk.chunk_section(chunk.clean_text(text)) == ["# Title\n```java\nclass A {}\n```"]


def test_long_diagram_pieces_are_whole():
    text = "```mermaid\nflowchart TD\n" + "\n".join(f"  A{i} --> B{i}" for i in range(260)) + "\n```"
    pieces = chunk.chunk_section(chunk.clean_text(text))
    assert len(pieces) > 1
    assert all(p.startswith("```mermaid\nflowchart TD\n") and p.endswith("```") and len(p) <= 1800 for p in pieces)
    assert [x for p in pieces for x in p.split("\n")[2:-1]] == text.split("\n")[2:-1]


def test_unclosed_fence_is_protected():
    assert chunk.clean_text("a\n```\n\tx  y") == "a\n```\n\tx  y"


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab \n`", min_size=0, max_size=400), st.integers(12, 60))
def test_pieces_hold_every_word(text, width):
    cleaned = chunk.clean_text(text)
    if "```" in cleaned:
        return
    pieces = chunk.chunk_section(cleaned, width, width // 4)
    assert all(p == p.strip() and 0 < len(p) for p in pieces)
    joined = "".join(pieces).replace(" ", "").replace("\n", "")
    assert set(joined) == set(cleaned.replace(" ", "").replace("\n", ""))


def test_sections_number_through_the_document(spark):
    df = spark.createDataFrame([(1, [("a" * 1850, "H", 1), ("second", None, 2), (" ", None, 3)])], "doc_id int, sections array<struct<content: string, heading: string, page_number: int>>")
    rows = chunk.chunk_sections(df).orderBy("chunk_index").collect()
    assert [(r.chunk_index, len(r.content), r.heading, r.page_number, r.token_count) for r in rows] == [(0, 1800, "H", 1, 450), (1, 250, "H", 1, 63), (2, 6, None, 2, 2)]


def test_text_functions(spark):
    assert many(spark, ["", "ab", "abcde", "中文", "a中b", " ", None], T.mixed_tokens) == [0, 1, 2, 2, 3, 0, 0]
    assert many(spark, ["x\n ## Two words \n# n", "none", "##\n# b"], T.first_heading) == ["Two words", None, "b"]
    assert one(spark, T.title(F.lit("a" * 19))) == "a" * 18 + "..."
    assert one(spark, T.identifier_parts(F.lit("my.HTTPServer/fooBar_baz"))) == ["my", "HTTP", "Server", "foo", "Bar", "baz"]
    assert one(spark, T.code_terms(F.lit("Flowchart TD"))) == ["Flowchart", "Flowchart", "TD", "TD", "flowchart"]
    assert one(spark, T.stable_id(F.lit("hello"))) == "5d41402a-bc4b-3a76-b971-9d911017c592"
    assert many(spark, [0, 1023, 1024, 1536, 5 << 20], T.byte_size, "long") == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "5.0 MB"]


def test_version_families(spark):
    names = ["plan v2.md", "plan final.pdf", "readme_v1.md", "plan-2024-01.md", "plain.md", "a_v1.md", "方案v2.md", "报告终稿.docx", None]
    assert many(spark, names, T.version_family) == ["plan", "plan", None, "plan 01", None, None, "方案", "报告", None]


def test_canonical_names(spark):
    assert many(spark, ["  Ａpp  Server ", None], C.canonical_name) == ["app server", None]
    assert many(spark, ["STRUCTURAL", "part of", "no such", None], C.relation_type) == ["STRUCTURAL", "STRUCTURAL", "RELATED", "RELATED"]
    assert many(spark, ["依赖", "依 赖", "㐀包", "uses", " ", "一二三四五六七八九"], C.display_label) == ["依赖", "依赖", "㐀包", "相关", "相关", "相关"]
    made = C.relation_description(F.lit("A"), F.lit("B"), F.lit("依赖"), F.lit("A uses B"))
    assert one(spark, made) == "A 依赖 B。"
    assert one(spark, C.relation_description(F.lit("A"), F.lit("B"), F.lit("依赖"), F.lit("甲用乙"))) == "甲用乙"
    assert one(spark, C.quote_found(F.lit("Hello,  World!"), F.lit("hello world"))) and not one(spark, C.quote_found(F.lit("x"), F.lit(" ")))


def test_urls(spark):
    given_ = [" https://h/v1/chat/completions/ ", "http://h/v1", "ftp://h", "https://h?x=1", "https://", None]
    assert many(spark, given_, urls.base_url) == ["https://h/v1", "http://h/v1", None, None, None, None]
    fixed = lambda c: urls.fixed_host_url(c, "api.example.com", "/api/v1", ["/compat", "/compat/v1"], "https://api.example.com")
    assert many(spark, ["https://api.example.com/", "https://api.example.com/compat/v1", "https://other/x", "https://api.example.com/own"], fixed) == [
        "https://api.example.com/api/v1", "https://api.example.com/api/v1", "https://api.example.com", "https://api.example.com/own"]

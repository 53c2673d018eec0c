"""Golden tests for the text rules (expected values worked out by hand)."""

from pyspark.sql import functions as F

from tiermill.functions import lang as L
from tiermill.functions import prompts as PR
from tiermill.functions import text as TX


def one(spark, col, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(col.alias("o")).first()["o"]


def test_py_strip_unicode(spark):
    assert one(spark, TX.py_strip("v"), "   x y \t\n　") == "x y"
    assert one(spark, TX.blank("v"), "  \t") is True
    assert one(spark, TX.blank("v"), None) is True


def test_tokens(spark):
    assert one(spark, TX.tokens("v"), "  a b\n\nc  ") == ["a", "b", "c"]
    assert one(spark, TX.tokens("v"), "") == []


def test_first_fence(spark):
    assert one(spark, TX.first_fence("v"), "intro\n```python\nx = 1\n```\n```js\ny\n```") == "x = 1"
    assert one(spark, TX.first_fence("v"), "```int x```") == "x"          # first word eaten as tag
    assert one(spark, TX.first_fence("v"), "```c#\nint x;```") == "#\nint x;"  # '#' stays in the body
    assert one(spark, TX.first_fence("v"), "  no fence ") == "no fence"


def test_strip_fences(spark):
    assert one(spark, TX.strip_fences("v"), "```c++\nint a;\n```") == "++\nint a;"
    assert one(spark, TX.strip_fences("v"), "```python\nprint(1)\n```") == "print(1)"


def test_after_marker_priority(spark):
    t = "<|im_start|>system\nS<|im_end|>\n<|im_start|>assistant\nA<|im_start|>assistant\nB<|im_end|>"
    assert one(spark, TX.clean_answer("v"), t) == "B"                # ChatML: last piece
    assert one(spark, TX.after_marker("v"), "x @@ Response 1 @@ Response 2") == " 1 "  # piece [1] only
    assert one(spark, TX.after_marker("v"), "no marker") == "no marker"


def test_strip_comments_order(spark):
    # line comments first: the URL is cut and a block comment holding // breaks
    assert one(spark, TX.strip_comments("v"), "a = 'http://x' /* c // d */ b") == "a = 'http:"
    assert one(spark, TX.strip_comments("v"), "a /* one\n two */ b // end") == "a  b "


def test_one_line_and_java(spark):
    assert one(spark, TX.to_line_format("v"), "Sure:\n```Java\nint a; // x\n/* y */ int b;\n```") == "int a; int b;"


def test_class_name(spark):
    assert one(spark, TX.class_name("v"), "public class Foo {}") == "Foo"
    assert one(spark, TX.class_name("v"), "int main() {}") == "Main"
    assert one(spark, TX.class_name("v"), "class\u00a0Äpfel2 {") == "Äpfel2"


def test_direction(spark):
    p = L.parse_direction(F.col("v"))
    assert one(spark, p, "Translate from C++ to Java.").asDict() == {"category": "cpp2java", "lang": "java"}
    assert one(spark, p, "please go from csharp to python").asDict() == {"category": "c_sharp2python", "lang": "python"}
    assert one(spark, p, "no direction here").asDict() == {"category": "unknown", "lang": "python"}
    assert one(spark, p, "from Rust to Zig\nmore").asDict() == {"category": "rust2zig", "lang": "zig"}


def test_detect_language_quirk(spark):
    df = spark.createDataFrame([("Port this to JavaScript", "x"), ("to python", "```java\nx```"),
                                ("nothing", "y")], "i string, g string")
    got = [r["o"] for r in df.select(L.detect_language("i", "g").alias("o")).collect()]
    assert got == ["java", "java", "cpp"]  # " to java" also matches "to javascript"


def test_pair_target(spark):
    assert one(spark, L.pair_target("v"), "java-python") == "python"
    assert one(spark, L.pair_target("v"), "java") is None


def test_prompt_rules(spark):
    df = spark.createDataFrame([("do it", "   "), ("do it", ""), ("do it", None), ("do it", "ctx {x}")], "i string, n string")
    strip = [r["o"] for r in df.select(PR.build_prompt("i", "n", "A {instruction} | {input}", "B {instruction}", "strip").alias("o")).collect()]
    empty = [r["o"] for r in df.select(PR.build_prompt("i", "n", "A {instruction} | {input}", "B {instruction}", "empty").alias("o")).collect()]
    assert strip == ["B do it", "B do it", "B do it", "A do it | ctx {x}"]
    assert empty == ["A do it |    ", "B do it", "B do it", "A do it | ctx {x}"]
    w = PR.wrap_prompt(F.col("v"), "P\n", "\nEND")
    assert one(spark, w, "q") == "P\nq\nEND"
    assert one(spark, w, "q\n### Response:\n") == "q\n### Response:\n"

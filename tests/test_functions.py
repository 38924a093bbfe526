"""Column functions on literal edge cases."""

import pytest
from pyspark.sql import functions as F

from gradeloom import constants as C
from gradeloom.functions.arrays import ngrams, paired_bag, shared_count
from gradeloom.functions.diagrams import check_diagram, preflight_diagram
from gradeloom.functions.messages import assistant_text
from gradeloom.functions.requests import image_uri, parse_request_id
from gradeloom.functions.similarity import exact_match, token_prf, vector_cosine
from gradeloom.functions.text import normalise_code, strip_think


@pytest.mark.parametrize("code, body", [
    (None, ""), ("", ""), ("@startuml\n@enduml", ""), ("@StartUML x\nA\n@EndUML y", "a"),
    ("@startuml name\nA  ->\tB\n@enduml", "a -> b"), ("a b c\x1cd\x85e", "a b c d e"),
    ("  A  ", "a"), ("x @startuml rest\ny", "x y"),
])
def test_normalise_code(evaluate, code, body):
    assert evaluate("c string", [(code,)], normalise_code(F.col("c"))) == [body]


@pytest.mark.parametrize("text, clean", [
    ("plain", "plain"), ("<think>a</think>b<think>c</think>d", "bd"),
    ("<think>a\nb</think> c", "c"), ("<think>open", "<think>open"), ("\t\n x  ", "x"),
])
def test_strip_think(evaluate, text, clean):
    assert evaluate("c string", [(text,)], strip_think(F.col("c"))) == [clean]


@pytest.mark.parametrize("code, error", [
    ("", C.EMPTY_RESPONSE), (None, C.EMPTY_RESPONSE), ("   ", C.MISSING_START),
    ("@startuml\n \n@enduml", C.EMPTY_BODY), ("@startuml@enduml", C.EMPTY_BODY),
    ("@startuml\nA\n@enduml\n@enduml ", ""), ("\n@startuml\nA\n@enduml\t", ""),
    ("@StartUML\nA\n@EndUML", C.MISSING_START), ("@startuml\nA\n@EndUML", C.MISSING_END),
    ("text @startuml A @enduml", C.MISSING_START),
])
def test_check_diagram(evaluate, code, error):
    [row] = evaluate("c string", [(code,)], check_diagram(F.col("c")))
    assert (row.valid, row.error) == (error == "", error)


def test_preflight_is_case_insensitive(evaluate):
    rows = [("@STARTUML x @EndUml",), ("@enduml",), ("a @startuml b",)]
    assert evaluate("c string", rows, preflight_diagram(F.col("c"))) == [
        None, C.PREFLIGHT_MISSING_START, C.PREFLIGHT_MISSING_END]


PARTS = "array<struct<role:string,content:array<struct<type:string,text:string>>>>"


@pytest.mark.parametrize("messages, text", [
    ([], ""), ([("user", [("text", "u")])], ""), ([("assistant", [])], ""),
    ([("assistant", [("image", None), ("text", "a")])], "a"),
    ([("assistant", [("image", None)]), ("assistant", [("text", "b")])], "b"),
    ([("assistant", [("text", "a")]), ("assistant", [("text", "b")])], "a"),
    ([("assistant", [("text", None)]), ("assistant", [("text", "b")])], ""),
])
def test_assistant_text_from_parts(spark, messages, text):
    df = spark.createDataFrame([(messages,)], f"m {PARTS}")
    assert df.select(assistant_text(F.col("m"), df.schema["m"].dataType)).first()[0] == text


def test_assistant_text_from_strings(spark):
    df = spark.createDataFrame(
        [([("user", "u"), ("assistant", None), ("assistant", "s")],), ([("assistant", "")],)],
        "m array<struct<role:string,content:string>>")
    out = df.select(assistant_text(F.col("m"), df.schema["m"].dataType)).collect()
    assert [r[0] for r in out] == ["s", ""]


def test_image_uri_has_no_line_breaks(evaluate):
    [uri] = evaluate("b binary", [(bytes(range(256)) * 4,)], image_uri(F.col("b")))
    import base64
    assert uri == C.IMAGE_URI_PREFIX + base64.b64encode(bytes(range(256)) * 4).decode()


def test_parse_request_id(evaluate):
    assert evaluate("c string", [("req_12",), ("req_x",), ("req",)],
                    parse_request_id(F.col("c"))) == [12, None, None]


def test_pair_measures(evaluate):
    rows = [("", ""), ("", "a"), ("a b", "a b"), ("a b", "c"), ("a a b", "a c")]
    match = evaluate("p string, r string", rows, exact_match(F.col("p"), F.col("r")))
    assert match == [1.0, 0.0, 1.0, 0.0, 0.0]
    got = evaluate("p string, r string", rows, token_prf(F.col("p"), F.col("r")))
    assert [tuple(g) for g in got] == [
        (0, 0, 0), (0, 0, 0), (1, 1, 1), (0, 0, 0), (0.5, 0.5, 0.5)]


def test_vector_cosine(evaluate):
    rows = [([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])]
    assert evaluate("a array<float>, b array<float>", rows,
                    vector_cosine(F.col("a"), F.col("b"))) == [1.0, 0.0, 0.0]


BAGS = [([], []), (["a"], []), ([], ["a"]), (["a", "b", "a"], ["a", "a", "c", "a"]),
        (["b", "a b", "a"], ["a b", "a b", "ab"]), (["x"] * 5, ["x"] * 3), (["a", "b"], ["b", "a"])]


@pytest.mark.parametrize("first", [True, False])
def test_shared_count(evaluate, first):
    from collections import Counter
    got = evaluate("l array<string>, r array<string>", BAGS,
                   shared_count(F.col("l"), F.col("r"), mostly_distinct=first))
    assert got == [(Counter(a) & Counter(b)).total() for a, b in BAGS]


def test_paired_bag(evaluate):
    from collections import Counter
    got = evaluate("l array<string>, r array<string>", BAGS, paired_bag(F.col("l"), F.col("r")))
    for bag, (a, b) in zip(got, BAGS):
        left, right = Counter(a), Counter(b)
        want = {(t, False, n, 0) for t, n in left.items()} | {
            (t, True, n, left[t]) for t, n in right.items()}
        assert {tuple(e) for e in bag} == want and len(bag) == len(want)


def test_ngrams_of_short_texts(evaluate):
    rows = [([],), (["a"],), (["a", "b", "c"],)]
    assert evaluate("t array<string>", rows, ngrams(F.col("t"), F.col("t"), 2)) == [
        [], [], ["a b", "b c"]]

import pytest
from pyspark.sql import functions as F

from colloquy.functions import json as J
from colloquy.functions import messages as M
from colloquy.functions import text as X

MSG = "array<struct<role:string,content:string>>"


def one(spark, column, **values):
    kinds = {str: "string", int: "int", float: "double", list: MSG, type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw,want", [(" \t a b \n", "a b"), (" x", "x"), ("", ""), (None, None)])
def test_strip_takes_every_white_space(spark, raw, want):
    assert one(spark, X.strip(F.col("t")), t=raw) == want


def test_collapse(spark):
    assert one(spark, X.collapse(F.col("t")), t="  A \n\n b\tC ") == "a b c"


def test_tokens_are_unicode_aware(spark):
    assert one(spark, X.count_tokens(F.col("t")), t="Über uns, ja!") == 5


def test_reasoning_blocks(spark):
    assert one(spark, X.strip_reasoning(F.col("t")), t=" <THINK>a\nb</think> hi <think>x</think>") == "hi <think>x</think>"
    assert one(spark, X.strip_empty_reasoning(F.col("t")), t="<think> \n</think>\nhi") == "hi"
    assert one(spark, X.strip_empty_reasoning(F.col("t")), t="<think>a</think>hi") == "<think>a</think>hi"


def test_keywords_at_boundaries(spark):
    words = ["green", "top-up", "blue moon"]
    for text, want in (("the greenery grew", False), ("Green!", True), ("one top-up more", True), ("once in a blue moon", True), (None, False)):
        assert one(spark, X.has_keyword(F.col("t"), words), t=text) is want
    assert one(spark, X.has_keyword(F.col("t"), []), t="green") is False


def test_redaction_counts_cards_before_phones(spark):
    text, count = X.redact(F.col("t"))
    raw = "mail a.b@example.com, card 4111 1111 1111 1111, call 415-555-0101"
    assert one(spark, text, t=raw) == "mail [EMAIL], card [CARD], call [PHONE]"
    assert one(spark, count, t=raw) == 3
    assert one(spark, count, t=None) == 0


def test_edit_share(spark):
    assert one(spark, X.edit_share(F.col("a"), F.col("b")), a="abc", b="ABD") == pytest.approx(1 / 3)
    assert one(spark, X.edit_share(F.col("a"), F.col("b")), a="", b=" ") == 0


@pytest.mark.parametrize("a,b,want", [("abc", "abd", 2), ("ab", "abc", 2), ("x", "x", None), ("", "x", 0)])
def test_first_difference(spark, a, b, want):
    assert one(spark, X.first_difference(F.col("a"), F.col("b")), a=a, b=b) == want


def test_merge_hoist_and_cut(spark):
    m = [("user", "a"), ("user", "b"), ("system", "s"), ("assistant", "c"), ("user", "d"), ("system", "t")]
    merged = [tuple(x) for x in one(spark, M.merge_runs(F.col("m")), m=m[:2] + m[3:5])]
    assert merged == [("user", "a\nb"), ("assistant", "c"), ("user", "d")]
    assert [tuple(x) for x in one(spark, M.hoist_system(F.col("m")), m=m)] == [("system", "s\nt"), ("user", "a\nb"), ("assistant", "c"), ("user", "d")]
    assert [tuple(x) for x in one(spark, M.cut_tail(F.col("m")), m=m)] == m[:4]
    assert one(spark, M.cut_tail(F.col("m")), m=[("user", "a")]) == []
    assert one(spark, M.merge_runs(F.col("m")), m=[]) == []


CASES = [
    ([("user", "a"), ("assistant", "b")], 1, "en", []),
    ([("user", "a"), ("user", "b"), ("assistant", "c")], 1, "en", ["role_sequence"]),
    ([("user", "a"), ("assistant", "b"), ("user", "c")], 1, "en", ["not_assistant_last"]),
    ([("user", "a"), ("system", "s"), ("assistant", "b")], 1, "en", ["system_not_first"]),
    ([("system", "a"), ("system", "s"), ("user", "a"), ("assistant", "b")], 1, "en", ["system_not_first"]),
    ([("assistant", "b")], 1, "en", ["role_sequence"]),
    ([("user", " "), ("assistant", "b")], 1, "en", ["blank_content"]),
    ([("user", "a"), ("assistant", "b")], 2, "en", ["n_turns"]),
    ([("user", "a"), ("assistant", "b")], 1, "fr", ["lang"]),
    ([], 0, "en", ["empty"]),
]


@pytest.mark.parametrize("m,n,lang,want", CASES)
def test_validation(spark, m, n, lang, want):
    assert one(spark, M.validation_errors(F.col("m"), F.col("n"), F.col("l")), m=m, n=n, l=lang) == want


def test_contexts_and_samples(spark):
    m = [("user", "a"), ("assistant", "b")]
    assert [tuple(x) for x in one(spark, M.select_context(F.col("m")), m=m)] == m[:1]
    assert one(spark, M.select_context(F.col("m")), m=m[1:]) is None
    prompt, gold = M.prompt_and_gold(F.col("m"))
    assert one(spark, gold, m=m) == "b" and one(spark, prompt, m=m[:1]) is None


def test_chat_and_spans(spark):
    m = [("user", "a"), ("assistant", "bc"), ("user", "d"), ("assistant", "")]
    text = one(spark, M.render_chat(F.col("m")), m=m)
    spans = one(spark, M.assistant_spans(M.render_chat(F.col("m"))), m=m)
    assert [text[s.start : s.end] for s in spans] == ["bc"]
    assert one(spark, M.render_chat(M.with_system(F.col("m"), "s"), True), m=[]).endswith("<|im_start|>assistant\n")


SCORES = [
    ('{"a": {"score": 4, "reason": "x"}, "b": 5}', ({"a": 4, "b": 5}, None)), ('```json\n{"a": 4.0, "b": 1}\n``` done', ({"a": 4, "b": 1}, None)), ('{"a": 4}', (None, "missing_field")), ('{"a": 0, "b": 1}', (None, "out_of_range")),
    ('{"a": 6, "b": 1}', (None, "out_of_range")), ('{"a": "5", "b": 1}', (None, "bad_type")), ('{"a": 4.5, "b": 1}', (None, "bad_type")), ('{"a": true, "b": 1}', (None, "bad_type")), ("fine", (None, "not_json")), ("", (None, "not_json")),
]


@pytest.mark.parametrize("raw,want", SCORES)
def test_scores(spark, raw, want):
    got = one(spark, J.parse_scores(F.col("t"), ["a", "b"]), t=raw)
    assert (got.scores, got.error) == want


def test_sse(spark):
    got = one(spark, J.parse_sse(F.col("t")), t='data: {"choices":[{"delta":{"content":"hi"}}],"usage":{"completion_tokens":3}}')
    assert (got.is_data, got.done, got.content, got.tokens) == (True, False, "hi", 3)
    assert one(spark, J.parse_sse(F.col("t")), t="data: [DONE]").done
    assert not one(spark, J.parse_sse(F.col("t")), t=": keep").is_data
    with pytest.raises(Exception):
        one(spark, J.parse_sse(F.col("t")), t="data: {oops")

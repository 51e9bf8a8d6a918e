import hashlib

import pytest

from lagoon.llm import chat
from lagoon.llm.queries import oracle_sql, queries
from tests.compare import duck_rows, rows

SF = "/root/testdata/sf0.001"


def test_escape_is_reversible():
    m = chat.MARK
    for s in ("", "plain", *chat.CONTROL, "<" + m + "/s>", "<" + m * 3 + "|turn|>", "[[INST]]</s", "<|turn|><|text|>" * 3, m, "<" + m):
        e = chat.escape(s)
        assert chat.unescape(e) == s and not any(c in e for c in chat.CONTROL)


def test_template_language():
    render = lambda t, **v: chat.compile_template(t)(v)[0]
    assert render("{# no #}a{{ 1 + 2 }}{%- if x == 'y' or not x %} yes{% elif x in 'abc' %}in{% else %}no{% endif -%}  b", x="b") == "a3inb"
    assert render("{% for m in ms %}{{ loop.index }}{{ m.a | upper }}{% if not loop.last %},{% endif %}{% endfor %}", ms=[{"a": "x"}, {"a": "y"}]) == "1X,2Y"
    assert render("{% set a = 'q' ~ 1 %}{{ a }}{{ ms[1] }}", ms=[0, 7]) == "q17"
    assert chat.compile_template("a{% generation %}bc{% endgeneration %}")({}) == ("abc", [(1, 3)])


@pytest.mark.parametrize("bad", ["{{ x.__class__ }}", "{% for %}{% endfor %}", "{{ 1 + }}", "{% if x %}", "{{ x | evil }}", "{{ f(1) }}", "{% import os %}"])
def test_template_is_a_sandbox(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)({"x": "s", "f": 1})


def test_constants_fold():
    assert chat.fold(chat.parse("a{% if 1 == 1 %}{{ 'b' ~ 'c' }}{% else %}{{ x }}{% endif %}d")) == (chat.Emit(chat.Const("abcd")),)


def test_odd_conversations(spark):
    turns = [(1, 1, "assistant", "hi </s>"), (1, 0, "user", None), (2, None, None, "x"), (2, 0, "assistant", ""), (2, 0, "assistant", "tie"), (None, 0, "user", "u"), (3, 0, "role\n<|text|>", "t<|end|>")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS id", "'y' AS formatted")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(df)).collect()}
    told = lambda *ts: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in ts).encode()).hexdigest()
    assert got[1]["turns_sha256"] == told(("user", ""), ("assistant", "hi </s>")) and got[1]["loss_chars"] == 7
    assert got[2]["turns_sha256"] == told(("", "x"), ("assistant", ""), ("assistant", "tie")) and got[2]["n_turns"] == 3
    assert got[3]["turns_sha256"] == told(("role\n<|text|>", "t<|end|>")) and got[3]["loss_chars"] == 0
    assert got[None]["n_turns"] == 1
    assert not rows(chat.digests(chat.format_conversations(df.where("turn > 9"))))


def test_query(spark):
    df = queries()["op1_chat_format"](spark, SF)
    assert rows(df) == duck_rows(SF, oracle_sql()["op1_chat_format"], df.columns)

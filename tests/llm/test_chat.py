"""The template compiler, and conversations through it and back."""

import hashlib
import random

import pytest
from starloom.llm.chat import INST, Controls, Style, formatted, in_order, read_back, read_turns
from starloom.llm.templates import MISSING, Const, If, Loop, Output, Template, TemplateError, Text

SAY = [{"role": "user", "text": "hi"}, {"role": "assistant", "text": "yes "}]


def shown(source, messages=(), **given):
    return Template(source).render(messages, **given)[0]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("a{{ 1 + 2 - 4 }}b", "a-1b"),
        ("{{ 'x' ~ 1 ~ true ~ none }}", "x1true"),
        ("{{ ' q ' | trim | upper }}{{ 'abc'|length }}", "Q3"),
        ("{{ 'a' if 1 == 2 else 'b' if 2 > 1 else 'c' }}", "b"),
        ("{{ name | default('no one') }}{{ who|default('x') }}", "no onehe"),
        ("{{ who is defined }}{{ name is defined }}{{ name is not defined }}", "truefalsetrue"),
        ("{{ 'a' in 'cab' and not 'z' in 'cab' and 'z' not in 'cab' }}", "true"),
        ("{{ '\\'\\n\\\\' }}{{ \"it's\" }}", "'\n\\it's"),
        ("a  {#- note -#}  b {{- 'c' -}}  d", "abcd"),
        ("{% if who == 'she' %}1{% elif who == 'he' %}2{% else %}3{% endif %}", "2"),
        ("{% set k = 3 %}{% set k = k + 1 %}{{ k }}{{ d.e }}{{ d['e'] }}{{ d.f.g }}{{ who[0] }}{{ who[9] }}", "4EEh"),
        ("{{ (1 < 2) or who.x }}{{ -1 }}", "true-1"),
    ],
)
def test_expressions(source, want):
    assert shown(source, who="he", d={"e": "E"}) == want


def test_loop():
    source = "<{% for m in messages %}{{ loop.index }}{{ m.role }}{% if loop.previtem is defined %}<{{ loop.previtem.role }}{% endif %}{% if loop.first %}F{% endif %}{% if loop.last %}L{% endif %};{% endfor %}>"
    assert shown(source, SAY) == "<1userF;2assistant<userL;>" and shown(source) == "<>"


def test_generation_ranges():
    text, spans = Template("A{% for m in messages %}[{% generation %}{{ m.text }}{% endgeneration %}]{% endfor %}").render(SAY)
    assert text == "A[hi][yes ]" and [text[a:b] for a, b in spans] == ["hi", "yes "]


def test_folding():
    t = Template("a{{ 'b' | upper }}{% if 1 == 1 and true %}c{% else %}{{ gone }}{% endif %}{% for m in messages %}{% if m.role == 'x' ~ 'y' %}{{ '' }}{% endif %}{{ 'u' if false else m.text }}{% endfor %}d{{ 1 + 1 }}")
    head, loop, tail = t.tree
    assert head == Text("aBc") and tail == Text("d2") and isinstance(loop, Loop) and len(loop.body) == 1 and isinstance(loop.body[0], Output)
    (branch,) = Template("{% if who == 'x' ~ 'y' %}1{% endif %}").tree
    assert isinstance(branch, If) and branch.condition.args[1] == Const("xy")


@pytest.mark.parametrize(
    "source",
    ["{{ }}", "{{ a", "}}", "{% if a %}", "{% endif %}", "{% else %}", "{% for m in x %}{% endfor %}", "{% if a %}{% for m in messages %}{% endfor %}{% endif %}", "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}", "{% for m in messages %}{% endfor %}{% for m in messages %}{% endfor %}", "{{ messages }}", "{{ a() }}", "{{ a|nofilter }}", "{{ a * 9 }}", "{{ 'a' + 1 }}", "{{ 1 2 }}", "{% generation %}{% if a %}{% generation %}{% endgeneration %}{% endif %}{% endgeneration %}", "{% import os %}", "{{ in }}", "{{ 'a'|upper( }}", "{{ 'a'|upper(1) }}", "{% set if = 1 %}"],
)
def test_what_the_language_refuses(source):
    with pytest.raises(TemplateError):
        Template(source)


@pytest.mark.parametrize("source", ["{{ who.__class__ }}", "{{ who['__class__'] }}", "{{ f.__globals__ }}", "{{ f }}", "{{ who + 1 }}", "{{ who < 1 }}", "{{ d }}"])
def test_nothing_outside_is_in_reach(source):
    with pytest.raises(TemplateError):
        shown(source, who="he", f=len, d={})
    assert shown("{{ d.__class__ }}{{ d.items }}", d={}) == ""


def hostile(r, n=30):
    return "".join(r.choice([*INST.marks, "\\", "\\", "<", "[", "]", "s>", "/s>", "INST]", " ", "\n", "é😀", "a"]) for _ in range(r.randrange(n)))


def test_escapes():
    r, c = random.Random(3), Controls(INST.marks)
    for _ in range(20_000):
        t = hostile(r, 12)
        e = c.escape(t)
        assert c.unescape(e) == t and not any(m in e for m in c.marks)
    for marks in (["a"], ["a\\b"], ["ab", "abc"], ["ab", "bc"], ["aa"]):
        with pytest.raises(ValueError):
            Controls(marks)


@pytest.fixture(scope="module")
def rows():
    r, out = random.Random(4), []
    for conv in range(60):
        out += [(conv, t, r.choice(["user", "assistant", "system", "tool", None, "[ROLE]", "us\ner"]), r.choice([None, "", hostile(r), hostile(r)])) for t in range(r.randrange(1, 9))]
    out += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (60, 1, "assistant", "b"), (60, 1, "assistant", "a"), (60, 1, "assistant", "a"), (60, None, "user", "x"), (None, 0, "user", "n"), (None, 1, "assistant", "m"), (61, 0, "assistant", "<s>é" * 200_000)]
    out += [(62, t, ["user", "assistant"][t % 2], f"turn {t}") for t in range(3000)]
    r.shuffle(out)
    return out


def test_there_and_back(spark, rows):
    want = {}
    for conv, turn, role, text in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "2 AS spans", "3 AS Loop")
    for chars in (1 << 20, 40):
        parts = formatted(table, part_chars=chars)
        size = {r.conv_id: r.n for r in parts.groupBy("conv_id").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
        assert size[62] > 100 if chars == 40 else max(size.values()) == 1
        got = {r.conv_id: tuple(r)[1:] for r in read_back(parts).collect()}
        assert set(got) == set(want)
        for conv, said in want.items():
            loss = "".join(t for role, t in said if role == "assistant")
            turns = hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in said).encode()).hexdigest()
            assert got[conv][:4] == (len(said), turns, len(loss), hashlib.sha256(loss.encode()).hexdigest())
        back = {}
        for r in read_turns(in_order(parts.repartition(5))).collect():
            back.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
        assert {c: [x[1:] for x in sorted(v)] for c, v in back.items()} == want
    assert formatted(table.where("false")).count() == 0 and read_back(formatted(table.where("false"))).count() == 0


def test_another_style(spark):
    style = Style("{% for m in messages %}<role>{{ m.role|escape }}</role>{% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}{% else %}{{ m.text|escape }}{% endif %}<end>{% endfor %}", (), ("<role>", "</role>", "<end>"), ("<role>", "</role>", "<end>"))
    with pytest.raises(Exception, match="no turn begins"):
        read_back(spark.createDataFrame([(1, 0, "odd", [])], "conv_id long, part long, text string, spans array<struct<start: long, end: long>>")).collect()
    table = spark.createDataFrame([(1, 0, "user", "a<end>"), (1, 1, "assistant", "b\\")], "conv_id long, turn long, role string, text string")
    assert [(r.role, r.text) for r in read_turns(formatted(table, style), style).collect()] == [("user", "a<end>"), ("assistant", "b\\")]


def test_missing_is_false():
    assert not MISSING

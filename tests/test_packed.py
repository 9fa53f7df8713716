import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from sievelake.operators.packed import PackedGrammar, split_packed

KEYS = ["Тип услуги", "Тип услуги автосервиса", "Услуга", "Услуги", "Марка авто"]
G = PackedGrammar(KEYS)


def values(text):
    return [(k, v) for k, v, _, _ in G.parse(text)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Услуга: Чистка•\"Под ключ \"\"всё\"\"\"", [("Услуга", "Чистка"), ("Услуга", 'Под ключ "всё"')]),
        ("Тип услуги автосервиса «Кузов | окраска»\tШины,Масло, фильтр", [("Тип услуги автосервиса", "Кузов | окраска"), ("Тип услуги автосервиса", "Шины"), ("Тип услуги автосервиса", "Масло, фильтр")]),
        ("прочее; Услуга Кран / Душ;;|", [("Услуга", "Кран"), ("Услуга", "Душ")]),
        ("- «Услуга x» Услуга y", [("Услуга", "y")]),
        ("Услуги:Кран Марка авто\nЛада\nВолга", [("Услуги", "Кран"), ("Марка авто", "Лада"), ("Марка авто", "Волга")]),
        ("Услугами доволен", []),
        ("Услуга «Марка авто x; y» Марка авто z", [("Услуга", "Марка авто x; y"), ("Марка авто", "z")]),
        ("Услуга", []), ("", []), (None, []), ("   ", []),
    ],
)
def test_values(text, want):
    assert values(text) == want


def test_malformed_quotes_become_bare_values_with_a_flag():
    assert G.parse("Услуга «Кран; Душ") == [("Услуга", "«Кран", "bare", "unclosed_quote"), ("Услуга", "Душ", "bare", "")]
    assert G.parse("Услуга «Кран» и душ") == [("Услуга", "«Кран» и душ", "bare", "text_after_quote")]


def test_brackets_shield_separators_if_asked_for():
    g = PackedGrammar(KEYS, brackets=[("[", "]")])
    assert g.parse("Услуга [a; [b]] | c") == [("Услуга", "a; [b]", "bracketed", ""), ("Услуга", "c", "bare", "")]
    assert [v for _, v, _, _ in g.parse("Услуга [a; b")] == ["[a", "b"]


@given(st.lists(st.text("абв «»\"12", min_size=1, max_size=6).filter(lambda s: s.strip()), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_round_trip_of_quoted_values(parts):
    text = "Услуга " + ";".join('"' + p.replace('"', '""') + '"' for p in parts)
    assert [v for _, v in values(text)] == [p.strip() for p in parts if p.strip()]


def test_long_text_is_read_whole():
    text = "Услуга " + ";".join(f"v{i}" for i in range(20000))
    assert len(values(text)) == 20000


def test_table(spark):
    schema = "id long, packed string, pos string, key string"
    df = spark.createDataFrame([(1, "Услуга a;b", "x", "y"), (1, "Услуга a;b", "x", "y"), (2, None, None, None), (3, "", "", ""), (None, "Марка авто c", None, None)], schema)
    got = sorted((str(r[0]), r[1], r[2], r[3]) for r in split_packed(df, "packed", ["id"], G).collect())
    assert got == [("1", 1, "Услуга", "a"), ("1", 1, "Услуга", "a"), ("1", 2, "Услуга", "b"), ("1", 2, "Услуга", "b"), ("None", 1, "Марка авто", "c")]
    assert split_packed(df.limit(0), "packed", ["id"], G).count() == 0
    assert split_packed(df, "packed", ["id"], PackedGrammar([])).count() == 0
    with pytest.raises(ValueError):
        split_packed(df, "packed", ["pos"], G)
    assert split_packed(df, "packed", ["id"], G).schema[1].dataType == T.IntegerType()


def test_malformed_fields_take_linear_time():
    import time

    grammar = PackedGrammar(["k"], (("(", ")"),))
    for part in ('«x;', '"a;', '"a""b;', "(x;", '"";', '"""a;', "«»x;"):
        text, began = "k " + part * (100_000 // len(part)), time.time()
        assert grammar.parse(text) is not None
        assert time.time() - began < 3, part


@given(st.text(alphabet='"a; «»()', max_size=14))
@settings(max_examples=300, deadline=None)
def test_doubled_signs_close_as_the_pattern_says(text):
    """The value of a quote that opens a field's text, against the plain pattern."""
    import re

    got = PackedGrammar(["k"]).parse('k "' + text)
    m = re.match(r'"((?:[^"]|"")*)"(?=\s*(?:[;|•\t\n\r\x0b\x0c]|\s/\s|,(?!\s)|\Z)|\s+k(?:[\s:;|]|\Z))', '"' + text)
    if m and m[1].strip():
        assert got[0][1] == m[1].replace('""', '"').strip() and got[0][2] == "quoted"

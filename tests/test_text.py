"""Cleaning, parsing and answer functions on small examples."""

import pytest
from pyspark.sql import functions as F

from labelforge.functions import answers, arrays, text
from labelforge.operators import cleaning, nested


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn("x").alias("y")).first()[0]


@pytest.mark.parametrize("raw, want", [
    ("cafÃ© Ãx", "cafe Ax"), ("â€œquotedâ€\u009d donâ€™t", '"quoted" don\'t'), ("Straße naïve — œuvre…", "Strasse naive - oeuvre..."),
    ("see https://a.b/c?d=1, ok", "see <URL> ok"), ("www.site.org", "<URL>"), ("mail a.b+c@d.example.org.", "mail <EMAIL>."),
    ("call +1 555-123-4567 now", "call <PHONE> now"), ("(555) 123 4567", "<PHONE>"), ("in 2024 and 12 345", "in 2024 and 12 345"),
    ("  a \t b \n\n \n c  ", "a b\nc"), ("日本 x", "x"), ("Â£5", "5"), ("5â‚¬", "5EUR"),
])
def test_clean_text(spark, raw, want):
    assert one(spark, raw, text.clean_text) == want


@pytest.mark.parametrize("raw, want", [("Two words.", 3), ("", 0), ("  \n", 0), (None, 0), ("a-b", 3)])
def test_count_tokens(spark, raw, want):
    assert one(spark, raw, text.count_tokens) == want


def test_remove_phrase(spark):
    df = spark.createDataFrame([("We at ACME (Co.) do", "acme (co.)"), ("a\\E b.c bxc", "b.c"), (" keep ", "")], "t string, p string")
    got = [r[0] for r in df.select(text.remove_phrase("t", "p")).collect()]
    assert got == ["We at  do", "a\\E  bxc", "keep"]


def test_length_filter_is_half_open(spark):
    df = spark.createDataFrame([(n, " ".join(["w"] * n)) for n in (4, 5, 6, 9, 10)], "n int, text string")
    kept = cleaning.length_filter(cleaning.measure(df), 5, 10)
    assert sorted(r.n for r in kept.collect()) == [5, 6, 9] and kept.columns == ["n", "text"]


def test_strict_mapping_fails(spark):
    df = spark.createDataFrame([("a",), ("z",)], "label string")
    table = spark.createDataFrame([("a", "A")], "key string, value string")
    assert sorted(str(r[0]) for r in cleaning.map_values(df, "label", table).collect()) == ["A", "None"]
    with pytest.raises(Exception, match="unmapped value: z"):
        cleaning.map_values(df, "label", table, mode="strict").collect()


def test_answers(spark):
    full = "Label: [Yes]\nExplanation: abc\ndef"
    assert one(spark, full, answers.parse_label) == "Yes"
    assert one(spark, full, answers.parse_explanation) == "abc\ndef"
    assert one(spark, "nothing here", answers.parse_label) is None
    assert one(spark, "Label: x\nExplanation: y\nrest", answers.swap_label_and_explanation) == "Explanation: y\nLabel: x\nrest"
    assert one(spark, "a [STARTPROMPT]\n b\nc [ENDPROMPT] [ENDPROMPT]", answers.extract_prompt) == "b\nc"
    assert one(spark, "a", answers.extract_prompt) == answers.PROMPT_MISSING
    assert one(spark, "x<|end_header_id|>**Label**: y", answers.transcript_tail) == "Label: y"


def test_lists(spark):
    assert one(spark, "['a', 'b']", text.parse_string_list) == ["a", "b"]
    assert one(spark, "{'votes': ['SUPPORTS', 'None', 'REFUTES']}", text.parse_votes) == ["SUPPORTS", None, "REFUTES"]
    assert one(spark, "A thing, The  Last", text.last_part) == "the  last"
    assert [tuple(e) for e in one(spark, "[('q', 's', [1, 2]), ('r', 't', 3)]", nested.as_evidence_list)] == [("q", "s", [1, 2]), ("r", "t", [3])]
    assert [tuple(e) for e in one(spark, "['q', 's', 3]", nested.as_evidence_list)] == [("q", "s", [3])]


def test_array_functions(spark):
    df = spark.createDataFrame([([0.0, 2.0, 1.0], ["b", "a", "a", "b", None], [None])], "l array<double>, v array<string>, w array<string>")
    r = df.select(arrays.argmax("l"), arrays.majority_vote("v"), arrays.majority_vote("w"), F.array_max(arrays.softmax("l")), arrays.sigmoid_flags("l")).first()
    assert r[0] == 1 and r[1] == "a" and r[2] is None and abs(r[3] - 0.66524096) < 1e-6 and r[4] == [0, 1, 1]


def test_phrases_of_any_script_go(spark):
    """Against a loop with the other engine's idea of case."""
    import re

    data = [("Äpfel sind äPFEL, Apfel nicht", "äpfel"), ("ЯБЛОКО яблоко ок", "Яблоко"), ("a.b axb A.B", "a.b"), ("東京都は東京", "東京"), ("x", ""), ("x", None), (None, "x"), ("$1 \\d 5", "$1"), ("é.😀! é.😀", "😀!")]
    from labelforge.functions.text import remove_phrase

    got = [r[0] for r in spark.createDataFrame(data, "t string, p string").select(remove_phrase("t", "p")).collect()]
    for (t, p), g in zip(data, got):
        assert g == (None if t is None else re.sub(re.escape(p), "", t, flags=re.I).strip() if p else t)


def test_languages_by_broadcast_equal_the_join(spark, monkeypatch):
    from pyspark.sql import functions as F

    from labelforge.operators import language

    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, "собака и кошка", "ru"), (4, "1234 !!", None), (5, None, "en"), (6, "zzz qqq", "de")], "id long, text string, lang string")
    profiles = language.fit_profiles(docs.filter("lang is not null"))
    near = language.detect(docs, profiles, "id")
    monkeypatch.setattr(language, "small_table", lambda df: None)
    by_id = lambda df: {(r.id, r.language, r.gibberish): r.score for r in df.collect()}
    a, b = by_id(near), by_id(language.detect(docs, profiles, "id"))
    assert len(a) == 6
    assert a.keys() == b.keys()
    assert all(abs((a[k] or 0) - (b[k] or 0)) < 1e-9 for k in a)

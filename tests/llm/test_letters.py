"""A text without a letter has no language: numerals and marks are none."""

from __future__ import annotations

from ledgerflow.llm import ppm_language


def test_texts_without_letters_are_und(spark):
    rows = [(k, f"the quick brown fox number {k} runs over the lazy dog", "en") for k in range(40)] + [(k, f"der schnelle braune Fuchs Nummer {k} springt über den Hund", "de") for k in range(40, 80)]
    odd = {80: "½ ² ①", 81: "Ⅷ", 82: "12 34", 83: "¡!", 84: None, 85: "", 86: "_", 87: "½ a", 88: "ⅷ ß", 89: "日"}
    d = spark.createDataFrame(rows + [(k, t, None) for k, t in odd.items()], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in ppm_language.identify(d).collect()}
    assert {k for k in odd if got[k] == "und"} == {80, 81, 82, 83, 84, 85, 86}
    assert {got[k] for k in got if k not in odd or k > 86} <= {"en", "de"}

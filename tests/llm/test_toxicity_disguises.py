"""Disguises are undone whatever their case or form, and the shortcut for clean texts does not hide them."""

import unicodedata

import pytest

from fluxgrid.llm import toxicity

DISGUISED = ["YOU MОRОN", "ΜORON, MΟRON", "you mоrоn", "idiót", "IDIÓT", unicodedata.normalize("NFD", "ìdïôt"), "i​dio​́t", "idiо́t", "ｉｄｉｏｔ", "ＩＤＩÓＴ", "İDİOT", "m0rón"]
CLEAN = ["", "oxymórón", "МОРЕ и небо", "йод", "naïve café", "한국어 é", "ΣΑΣ İstanbul"]


@pytest.mark.parametrize("text", DISGUISED + CLEAN)
def test_shortcut_equals_folding(text):
    lexicon, plain = (toxicity.Lexicon({"moron ": 3.0, "idiot ": 3.0, "vequ": 3.0}) for _ in range(2))
    plain.absent = lambda _: False
    assert lexicon.score(text) == plain.score(text)
    assert (lexicon.matched(text)[1] > 0) == (text in DISGUISED)


def test_other_scripts_keep_their_letters():
    assert toxicity.fold("Йод 한국어 naïve") == " йoд 한국어 naive "

"""Threats whose target follows them."""
import pytest

from sourceloom.llm import toxicity

W = toxicity.FIXED_WEIGHT


@pytest.mark.parametrize("text, want", [
    ("I will kill you", [0, W, 0, 0]), ("we shall hurt them", [0, W, 0, 0]), ("kill and then all of you", [0, 0, 0, 0]),
    ("kill and destroy you", [0, 2 * W, 0, 0]), ("töten werde ich dich", [0, W, 0, 0]), ("je vais tuer vous", [0, W, 0, 0]),
    ("voy a matar a ustedes", [0, W, 0, 0]), ("I will not hurt you", [0, 0, W, 0]), ("Anna said we kill them", [0, 0, 0, W]),
    ("kill time. you come", [0, 0, 0, 0]), ("you I will kill", [0, W, 0, 0]), ("you I kill you", [0, W, 0, 0]),
    ("kill you, you idiot", [0, 2 * W, 0, 0]), ("kill idiot you", [0, 2 * W, 0, 0])])
def test_verb_before_target(text, want):
    assert toxicity.matches(text, toxicity.Lexicon({}, {})).tolist() == want


def test_such_a_text_is_rejected():
    assert toxicity.Model().score("I will kill you", toxicity.Lexicon({}, {})) > 0.5

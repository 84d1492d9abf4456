import random
import unicodedata

import pytest

from textloom.operators import clean

TEXTS = ["Un été très doux à l'école, où l'on naît.", "Größe und Übermaß der Straßen", "Zażółć gęślą jaźń, łódź", "Съешь ещё этих мягких французских булок", "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία", "naïve café", "日本語のテキスト", "señor – “quoted” … 5 €", "smörgåsbord à la crème", "a 😀 face"]


def read_as(text, encoding):
    table = {b: c for c, b in clean.byte_of(encoding).items()}
    return "".join(chr(b) if b < 0x80 else table[b] for b in text.encode())


@pytest.mark.parametrize("encoding", clean.ENCODINGS)
def test_one_and_two_misreadings_are_undone(encoding):
    for text in TEXTS:
        want = clean.repair(text)
        once = read_as(text, encoding)
        assert clean.repair(once) == want, (text, once)
        assert clean.repair(read_as(once, encoding)) == want, text


def test_misreadings_in_different_encodings_are_undone_in_turn():
    for text in TEXTS[:5]:
        for first, second in (("cp1252", "latin-1"), ("cp1251", "cp1252"), ("latin-1", "mac-roman"), ("cp437", "cp1252")):
            assert clean.repair(read_as(read_as(text, first), second)) == clean.repair(text), (text, first, second)


def test_sound_texts_stay_as_they_are():
    for text in [*TEXTS, "É©", "Ça va", "ŠŽ", "С", "ΑΒ", "½ × ¼", "±5°", "¿Qué?", "ÀÉÎ", "Łódź Č", "™ ® ©", "ÄÖÜ", "“É”"]:
        assert clean.repair(text) == unicodedata.normalize("NFC", text.translate(clean.QUOTES)), text


def test_a_misread_stretch_in_a_sound_text():
    assert clean.repair("Größe — Ã©tÃ©, œuvre") == "Größe — été, œuvre"


def test_random_texts_survive_a_misreading():
    rng, letters = random.Random(2), "abc .,éèüßñçœžłąйцукаβγδ日本"
    for _ in range(500):
        text = unicodedata.normalize("NFC", "".join(rng.choice(letters) for _ in range(rng.randint(5, 40))))
        if not text.isascii():
            assert clean.repair(read_as(text, "cp1252")) == clean.repair(text)


def test_long_and_odd_texts():
    for text in ("é" * 200_000, "Ã" * 200_000, "Ã©" * 100_000, "\x80" * 10_000, "", "a" * 100_000):
        clean.repair(text)
    assert clean.repair(None) is None


def test_lone_marks_are_no_likelier_than_a_capital_in_a_word():
    for text in ("Etaioiené enéE. Etaioiené", "querçéTion é é querétion"):
        assert clean.repair(read_as(text, "latin-1")) == text

"""Letters by category, and spans of many notices in linear time."""

import time

from vocspark.llm import langid, licenses


def test_number_signs_are_no_letters():
    for text in ("½", "²", "Ⅷ", "①", "٣", "_", "123 !?", "", None, "\U0001f600"):
        assert not langid.has_letter(text)
    for text in ("a", "1é", "ª", "字", "ß½"):
        assert langid.has_letter(text)


def test_spans_name_their_words():
    found = licenses.notices()
    text = "x gnu general publik license y MIT Licence. apache license z"
    got = licenses.scan(text, found)
    words = licenses.words_of(text).decode().split()
    assert got["spans"] and got["first_word"] == got["last_word"] == 8
    for s in got["spans"]:
        assert " ".join(words[s["first_word"]:s["last_word"] + 1]) == s["text"]


def test_many_notices_in_a_long_text():
    found = licenses.notices()
    seconds = []
    for n in (2_000, 16_000):
        text = "mit license and more words here. " * n
        at = time.process_time()
        got = licenses.scan(text, found)
        seconds.append(time.process_time() - at)
        assert got["n_base"] == n and got["last_word"] == 6 * (n - 1)
    assert seconds[1] < 20 * seconds[0] + 1

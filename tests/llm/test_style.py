"""Shapes of words: few differ, however many words do."""

from quirework.llm.hashed import Cached, bucket, shape, style, word_terms


def test_words_of_one_shape_are_one_entry():
    table = Cached(word_terms), Cached(lambda kinds: bucket(f"shape:{shape(kinds)}"))
    text = " ".join(f"{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k % 6]}," for k in range(500)) + " THE!! 中文 ²5"
    row = style(text, table)
    assert set(table[1]) == {"aaa,", "AAA!!", "aa", "99"}
    assert row[bucket("shape:a,")] == (500 / 503) ** 0.5 and row[bucket("shape:A!")] == (1 / 503) ** 0.5


def test_beginnings_and_signs():
    assert word_terms("naïvetés") == tuple(map(bucket, ("naïvetés", "4:naïv", "5:naïve")))
    assert word_terms("a-b_c!") == tuple(map(bucket, ("a", "b_c")))

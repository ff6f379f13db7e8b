"""The two libraries of patterns split alike."""

import random

import public_tokenizers
import regex

from merceris.llm import word_table


def test_both_libraries_split_alike():
    theirs, own, draw = regex.compile(public_tokenizers.PATTERN).findall, word_table.Splitter(public_tokenizers.PATTERN), random.Random(3)
    for pool in (word_table.PLAIN + " \n's't'll" * 20, word_table.PLAIN + "\x1c\x85\xa0漢́İ" * 9):
        for _ in range(3000):
            text = "".join(draw.choices(pool, k=draw.randrange(40)))
            assert own.find(text) == theirs(text)


def test_plain_texts_need_no_slow_library():
    own = word_table.Splitter(public_tokenizers.PATTERN)
    own.any = None
    assert own.find("Größe, it's 12\n\nx") == ["Größe", ",", " it", "'s", " 12", "\n", "\n", "x"]

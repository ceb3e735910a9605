"""Features of the quality and language models, written out in plain Python, on odd texts."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa

from folioflow.llm import langid, quality
from folioflow.llm.shared import mix

ODD = [
    None, "", " ", "\n", "a", "A", "One two\tTWO  one!\n\nThree, 3.14 (four)?", "é É ﬁ 日本語 😀", "x" * 5000 + " y", "$%^&*_+ \x00\x1f",
    "line\n" * 300, "Word " * 2000, "ß ẞ no-break", "tab\tonly\tLINE\r\nreturn",
]


def statistics(text: str | None) -> list[float]:
    data = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]

    def share(part, whole, usual, weight):
        return math.log((part + weight * usual) / (whole + weight))

    def count(chars: bytes) -> int:
        return sum(b in chars for b in data)

    filled = sum(b > 32 for b in data)
    digits, stops = bytes(range(48, 58)), b".,;:'\"?-()"
    upper, lower = bytes(range(65, 91)), bytes(range(97, 123))
    wide = sum(b >= 128 for b in data)
    signs = filled - wide - count(digits) - count(stops) - count(b"!") - count(upper) - count(lower)
    lines = data.count(b"\n") + 1
    folded = {w.lower() for w in words}
    return [
        math.log1p(len(data)), math.log1p(len(words)), math.log(lines), share(filled, len(words), 5, 10),
        math.log(max(map(len, words), default=0) + 10), share(len(words), lines, 20, 2), share(count(upper), filled, 0.02, 100),
        share(count(digits), filled, 0.002, 100), share(count(stops), filled, 0.03, 100), share(count(b"!"), filled, 0.002, 100),
        share(signs, filled, 0.002, 100), share(wide, filled, 0.03, 100), share(len(folded), len(words), 1, 30),
        share(sum(w[0] in upper for w in words), len(words), 0.1, 10),
    ]


def test_quality_statistics_equal_plain_python():
    found = quality.statistics(pa.array(ODD))
    assert found.shape == (len(ODD), len(quality.FEATURES))
    for row, text in zip(found, ODD, strict=True):
        np.testing.assert_allclose(row, statistics(text), rtol=1e-12, err_msg=repr(text)[:40])


def test_gram_counts_equal_plain_python():
    texts = [t or "" for t in ODD]
    found = langid.gram_counts(texts)
    for row, text in zip(found, texts, strict=True):
        codes = [ord(c) for c in f" {text.lower()} "]
        expected = np.zeros(langid.DIMENSIONS)
        for order in range(langid.ORDERS):
            for at in range(len(codes) - order):
                gram = codes[at]
                for step in range(1, order + 1):
                    gram = (gram * 0x100000001B3 + codes[at + step] + step) % (1 << 64)
                expected[(int(mix(np.array([gram], np.uint64))[0]) >> 40) % langid.DIMENSIONS] += 1
        assert (row == expected).all()


def test_the_first_language_wins_a_tie():
    model = langid.LanguageModel(["de", "en"], np.ones(langid.DIMENSIONS), np.zeros((langid.DIMENSIONS, 2)), 1.0)
    p = model.probabilities(["text", ""])
    assert p.tolist() == [[0.5, 0.5]] * 2 and p.argmax(axis=1).tolist() == [0, 0]

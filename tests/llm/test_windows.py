"""Toxicity windows at every word."""

import numpy as np
import pytest

from kerbside.llm import toxicity
from kerbside.llm.toxicity import WINDOW, Model, words_of


class ByName(Model):
    """Words weigh what their name says."""

    def of_words(self, words):
        return np.array([float(w[1:]) if w[0] == "t" else -1.0 for w in words])


@pytest.mark.parametrize("before", range(2 * WINDOW))
def test_an_insult_scores_alike_wherever_it_stands(before):
    clean = [f"c{i}" for i in range(100)]
    text = " ".join([*clean[:before + WINDOW], "t9", "t8", "t10", *clean[before + WINDOW:]])
    assert ByName(np.zeros(1)).scores([text])[0] == pytest.approx(1 / (1 + np.exp(-(27 - 5) / WINDOW)))


def test_windows_against_brute_force():
    pick = np.random.default_rng(4)
    for n in range(1, 40):
        text = " ".join(f"t{pick.integers(0, 50)}" if pick.random() < 0.5 else f"c{i}" for i in range(n))
        words = words_of(text)
        values = ByName(np.zeros(1)).of_words(words)
        best = max(values[i:i + WINDOW].sum() for i in range(max(1, len(words) - WINDOW + 1))) / WINDOW
        assert ByName(np.zeros(1)).scores([text])[0] == pytest.approx(1 / (1 + np.exp(-best)))


def test_sample():
    assert toxicity.SAMPLE == 3000

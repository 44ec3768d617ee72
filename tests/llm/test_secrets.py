"""Secrets of any length."""

import random
import time

import pytest

from kerbside.llm import pii


class Everything:
    def accepts(self, patterns):
        return [True] * len(patterns)


@pytest.mark.parametrize("n", [8, 128, 129, 140, 256, 257, 403, 1000])
def test_long_secrets_are_masked_whole(n):
    pick = random.Random(n)
    token = "".join(pick.choice("abcdefXYZ_-") for _ in range(n))
    assert pii.masked(f"token={token} end", Everything()) == "token=[SECRET] end"
    if n >= 32:
        key = "".join(pick.choice("abcdef0") for _ in range(n))
        assert pii.masked(f"so {key} end", Everything()) == "so [SECRET] end"


def test_long_runs_take_linear_time():
    start = time.perf_counter()
    pii.more_spans("token=" + "a" * 10 ** 6 + " " + "0a" * 10 ** 6 + "g token: " * 10 ** 5)
    assert time.perf_counter() - start < 20

"""The pipeline's stages against plain Python, with columns named like the operators' own, and with texts that had been cut short."""

import pytest
from pyspark.sql import functions as F

from kerbside.llm import pii
from kerbside.llm.common import unused
from kerbside.llm.neardup import keep_one
from kerbside.llm.packing import pack_documents
from kerbside.llm.pii import MAIL, mask_documents, masked
from kerbside.llm.quality import keep_good, quality_rules
from kerbside.llm.toxicity import keep_clean, score_toxicity

THEIRS = ("__text", "__q", "__lang", "__source", "__limits", "__kept", "__masked", "__toxicity", "__quality", "whole_text", "text_hash",
          "masked", "toxicity", "quality", "q_counts", "kept_id", "Q_LANG")


@pytest.fixture(scope="module")
def crowded(hard):
    return hard.select("*", *(F.lit("theirs").alias(n) for n in THEIRS))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 0, 0), (7, 0, 0), (12, 1, 1), (13, 0, 0)], "doc_id bigint, quality int, toxic int")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_unused(spark):
    df = spark.createDataFrame([], "a int, b int, B_ int")
    assert unused(df, "c") == "c" and unused(df, "A") == "A_" and unused(df, "b") == "b__"


def test_stages_keep_columns_of_any_name(hard, crowded, labels):
    stages = {"toxicity": lambda d: keep_clean(d, labels), "quality": keep_good, "near_dedup": keep_one, "personal_data": mask_documents}
    for name, stage in stages.items():
        plain, full = stage(hard), stage(crowded)
        assert full.columns == crowded.columns, name
        assert rows(full, *hard.columns) == rows(plain, *hard.columns), name
        assert full.select(*THEIRS).distinct().count() == 1, name


def test_stages_act_on_their_operators_verdicts(hard, labels):
    clean = {r["doc_id"] for r in score_toxicity(hard, labels).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in keep_clean(hard, labels).collect()} == clean
    good = sorted((r["doc_id"] for r in quality_rules(hard).where("kept").collect()), key=repr)
    assert sorted((r["doc_id"] for r in keep_good(hard).collect()), key=repr) == good


def test_rows_that_share_an_id_but_no_text_stay(spark):
    one, two = "one two three four five six seven", "quite another text that shares nothing at all"
    docs = spark.createDataFrame([(1, one), (1, two), (1, two), (2, one), (3, "alone in the world of texts")], "doc_id bigint, text string")
    assert rows(keep_one(docs), "doc_id", "text") == sorted([(1, one), (1, two), (3, "alone in the world of texts")], key=repr)


class All(pii.SpanClassifier):
    def accepts(self, patterns):
        return [True] * len(patterns)


@pytest.mark.parametrize("text,want", [
    ("x" * 80 + " [at] mail.example.org", "[MAIL]"), ("me [at] a.b.c.d.e.f.org", "[MAIL]"), ("me (at) a [dot] b (dot) org now", "[MAIL] now"),
    ("write me [at] host.org. Then wait. And go.", "write [MAIL]. Then wait. And go."), ("[at] host.org", "[at] host.org")])
def test_masked_mail_is_whole(text, want):
    assert masked(text, All(None)) == want


def test_mail_is_linear():
    import time

    start = time.perf_counter()
    for text in ("a" * 300_000, "a." * 150_000, "a [at] " * 50_000, "a [at] " + "b." * 150_000, "a [at] " + "b [dot] " * 50_000):
        MAIL.findall(text)
    assert time.perf_counter() - start < 5


def test_sequences_follow_the_proportions(spark):
    """Two sources with three and one quarter of the tokens: so has every whole sequence, within two documents' tokens."""
    import public_tokenizers

    text = " ".join(["word"] * 15)
    docs = spark.createDataFrame([(i, text, "big" if i % 4 else "small") for i in range(4000)], "doc_id bigint, text string, source string")
    pieces = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, length=512, window=16 * 512)
    of = pieces.groupBy("sequence_id").pivot("source", ["big", "small"]).sum("length").collect()
    assert len(of) == 125 and all(abs(r["small"] - 128) <= 32 for r in of)

"""Quality rules: a fixed base, then thresholds that follow each language and source.

Per document four measures in whole thousandths. Each (lang, source) group keeps a quantile sketch per measure: counts of
log-linear buckets, which keep the highest five bits of a value (an error of 1/16 at most) and merge by adding. Groups of
few documents use the merged sketch of their language, then of the corpus. A measure fails beyond
median + 6 x (median - first decile) + slack: the lower half of a group says how much it varies, so junk in the upper half
doesn't move the threshold until it is half of the group. Thresholds are joined to the documents, which are then filtered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.common import beside, field, stored, unused

#: Documents from which a group's own sketch counts.
ENOUGH = 200
SPREADS = 6
#: What a measure may lie above the spread, in its unit: thousandths, and hundredths of a character for word_length.
SLACK = {"symbols": 20, "dup_lines": 400, "stutter": 150, "word_length": 600}
#: Rows of thresholds up to which they are broadcast; beyond, a shuffled join that Spark may split where it is skewed.
SMALL_ROWS = 50_000

COUNTS = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_lines:bigint,n_dup_lines:bigint,n_repeat_words:bigint,n_same_next:bigint>"
SPACE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def counts(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_same_next of one whole text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    chars = len(text) - sum(text.count(c) for c in SPACE)
    symbols = sum(data.count(c) for c in b"#*$%&|<>")
    lines = [x for x in data.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen: set[tuple] = set()
        twice = {w for w in windows if w in seen or seen.add(w)}
        end = 0
        for i, w in enumerate(windows):
            if w in twice:
                repeated += i + 5 - max(i, end)
                end = i + 5
    return len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), repeated, sum(a == b for a, b in zip(words, words[1:]))


def measures(c: str = "__q") -> dict[str, Column]:
    def part(of: str, all_: str, unit: int = 1000) -> Column:
        return F.expr(f"({unit} * {c}.{of}) div greatest({c}.{all_}, 1)")

    return {"symbols": part("n_symbols", "word_chars"), "dup_lines": part("n_dup_lines", "n_lines"),
            "stutter": part("n_same_next", "n_words"), "word_length": part("word_chars", "n_words", 100)}


def bucket(v: Column) -> Column:
    """The smallest value of v's bucket: v without all but its highest five bits."""
    drop = F.greatest(F.length(F.bin(v)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def thresholds(judged: DataFrame) -> DataFrame:
    """lang, source, measure, limit: one row per group and measure, from documents that have words.

    `judged` has lang, source and the counts. Counting buckets is one partial aggregation, so a group that holds a third of
    all rows reaches its reducer as a few hundred counts. The sketches then merge upwards.
    """
    each = judged.where("__q.n_words > 0").select("lang", "source", F.explode(F.map_from_arrays(
        F.array(*(F.lit(m) for m in SLACK)), F.array(*(bucket(measures()[m]) for m in SLACK)))).alias("measure", "value"))
    own = each.groupBy("lang", "source", "measure", "value").count()
    of_lang = own.groupBy("lang", "measure", "value").agg(F.sum("count").alias("count"))
    of_all = of_lang.groupBy("measure", "value").agg(F.sum("count").alias("count"))

    def limits(sketch: DataFrame, by: list[str]) -> DataFrame:
        group = Window.partitionBy(*by, "measure")
        cum = sketch.select(*by, "measure", "value", F.sum("count").over(group.orderBy("value")).alias("upto"),
                            F.sum("count").over(group).alias("n"))
        low = F.min(F.when(F.col("upto") * 10 >= F.col("n"), F.col("value")))
        mid = F.min(F.when(F.col("upto") * 2 >= F.col("n"), F.col("value")))
        slack = F.create_map(*(F.lit(x) for pair in SLACK.items() for x in pair))[F.col("measure")]
        return cum.groupBy(*by, "measure").agg(F.max("n").alias("n"), (mid + SPREADS * (mid - low)).alias("fence")).select(
            *by, "measure", "n", (F.col("fence") + slack).alias("limit"))

    a, b, c = limits(own, ["lang", "source"]).alias("a"), limits(of_lang, ["lang"]).alias("b"), limits(of_all, []).alias("c")
    joined = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.measure") == F.col("b.measure"))).join(
        c, F.col("a.measure") == F.col("c.measure"))
    return joined.select("a.lang", "a.source", "a.measure", F.when(F.col("a.n") >= ENOUGH, F.col("a.limit")).when(
        F.col("b.n") >= ENOUGH, F.col("b.limit")).otherwise(F.col("c.limit")).alias("limit"))


def judge(docs: DataFrame, name: str) -> DataFrame:
    """docs with one more column `name`: the counts, base_failed, kept, and the measures beyond their limit.

    base_failed: fewer than 10 words, or more than 20 % of them in repeated 5-word windows. kept: not base_failed and no
    measure beyond its group's limit. A missing text has no words, a missing lang or source counts as "". Two passes over
    the texts: sketches, then verdicts.
    """
    keys = {k: F.coalesce(field(docs, k, "string"), F.lit("")) for k in ("lang", "source")}
    q, at_lang, at_source, at_limits = (unused(docs, n) for n in ("q_counts", "q_lang", "q_source", "q_limits"))
    counted = beside(docs, q, COUNTS, lambda texts: [dict(zip(NAMES, counts(t))) for t in texts])
    found = thresholds(counted.select(keys["lang"].alias("lang"), keys["source"].alias("source"), F.col(q).alias("__q")))
    wide = found.groupBy(F.col("lang").alias(at_lang), F.col("source").alias(at_source)).agg(
        F.map_from_entries(F.collect_list(F.struct("measure", "limit"))).alias(at_limits))
    wide = stored(wide, "quality-limits")
    limits = F.broadcast(wide) if wide.count() <= SMALL_ROWS else wide
    joined = counted.join(limits, (keys["lang"] == F.col(at_lang)) & (keys["source"] == F.col(at_source)), "left")
    beyond = F.array_compact(F.array(*(F.when(value > F.col(at_limits)[m], F.lit(m)) for m, value in measures(q).items())))
    base = (F.col(q)["n_words"] < 10) | (100 * F.col(q)["n_repeat_words"] > 20 * F.col(q)["n_words"])
    verdict = F.struct(f"{q}.*", base.alias("base_failed"), beyond.alias("beyond"), (~base & (F.size(beyond) == 0)).alias("kept"))
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), verdict.alias(name))


NAMES = [c.split(":")[0] for c in COUNTS[7:-1].split(",")]


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: the counts, base_failed, kept, and which measures were beyond their limit."""
    narrow = docs.select(field(docs, "doc_id", "bigint"), *(field(docs, c, "string") for c in ("text", "lang", "source")))
    return judge(narrow, "quality").select("doc_id", *(f"quality.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")),
        F.array_join("quality.beyond", ",").alias("beyond"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns, whatever those are called. An empty table stays one; a missing or
    empty text has no words and goes."""
    name = unused(docs, "quality")
    return judge(docs, name).where(F.col(name)["kept"]).drop(name)

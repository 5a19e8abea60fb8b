"""Quality rules as weak supervision, in DataFrame functions only.

Rules vote good (1), bad (0) or abstain (null). Expectation-maximisation over the vote patterns
estimates how often each rule is right on good and on bad documents, and the share of good ones; a
document's posterior probability of being good replaces an all-must-pass filter. The two accuracies
differ: a rule that finds one kind of junk passes most other junk, so its good votes say little and its bad ones much. Each round sees all documents, aggregated to the distinct vote
patterns (at most 3 to the number of rules, which is seven), so the driver handles a table of proven size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltline.session import cut

#: The word separators: space and TAB..CR.
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines), whole texts; null: empty."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    base = base.select("doc_id", "t", F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), "").alias("w"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.translate(x, BLANK, "") != "")
    shingles = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    base = base.select("doc_id", "t", F.size("w").alias("n"), lines.alias("lines"), F.when(F.size("w") >= 4, shingles).alias("h"))
    # most texts repeat no shingle: a hash set tells, and only the others are sorted
    ranked = F.sort_array(F.transform("h", lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
    base = base.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), ranked))
    return base.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.translate("t", BLANK, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered("s"), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length("t") - F.length(F.translate("t", UPPER, ""))).cast("long").alias("n_upper"),
    )


def _covered(ranked: str) -> Column:
    """Words in windows of 3 that occur twice or more; ranked: (hash, position) in order."""
    s = F.col(ranked)
    last = F.size(s) - 1
    twice = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(s, i + 1)["h"] == x["h"])))
    places = F.sort_array(F.transform(twice, lambda x: x["p"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-9).alias("at"))
    return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["at"])).alias("n"), p.alias("at")), lambda a: a["n"])


def ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def default_rules() -> dict[str, Column]:
    """Votes on the features: 1 good, 0 bad, null abstains."""
    vote = lambda good, bad: F.when(bad, F.lit(0)).when(good, F.lit(1))
    n = F.col("n_words")
    mean = ratio("word_chars", "n_words")
    return {
        "length": vote(n >= 80, n < 50),
        "word_length": vote((mean >= 3) & (mean <= 9), (mean < 2.5) | (mean > 12)),
        "symbols": vote(ratio("n_symbols", "n_words") < 0.05, ratio("n_symbols", "n_words") > 0.3),
        "symbol_share": vote(ratio("n_symbols", "word_chars") < 0.02, ratio("n_symbols", "word_chars") > 0.1),
        "dup_lines": vote((F.col("n_dup_lines") == 0) & (F.col("n_lines") > 1), (F.col("n_dup_lines") >= 2) & (ratio("n_dup_lines", "n_lines") > 0.3)),
        "shouting": vote(ratio("n_upper", "word_chars") < 0.15, ratio("n_upper", "word_chars") > 0.3),
        "repeats": vote((ratio("n_repeat_words", "n_words") < 0.2) & (n >= 50), ratio("n_repeat_words", "n_words") > 0.5),
    }


def fit(votes: DataFrame, rules: Sequence[str], rounds: int = 60, prior: float = 0.8, start: tuple[float, float] = (0.95, 0.3)) -> dict:
    """Accuracies per rule, (on good documents, on bad ones), and the prior, by expectation-maximisation over the vote patterns.

    Each accuracy is the probability that a vote, when given, is right. They are smoothed by one right and one wrong
    vote, and a rule's bad vote always speaks against a document: its accuracies add up to more than 1.
    The prior keeps to [0.05, 0.95]. No rows: the start values.
    """
    patterns = votes.groupBy(*rules).count().collect()  # at most 3 ** len(rules) rows
    acc, p = dict.fromkeys(rules, start), prior
    for _ in range(rounds if patterns else 0):
        right = {r: [1.0, 1.0] for r in rules}
        given = {r: [2.0, 2.0] for r in rules}
        good, total = 0.0, 0
        for row in patterns:
            post = posterior_of({r: row[r] for r in rules}, acc, p)
            good, total = good + post * row["count"], total + row["count"]
            for r in rules:
                for k, weight in enumerate((post, 1 - post)):
                    if row[r] is not None:
                        given[r][k] += weight * row["count"]
                        right[r][k] += weight * row["count"] * (row[r] == 1 - k)
        acc = {}
        for r in rules:
            on_good, on_bad = (min(0.999, max(0.001, right[r][k] / given[r][k])) for k in (0, 1))
            acc[r] = (on_good, max(on_bad, 1.02 - on_good))
        p = min(0.95, max(0.05, good / total))
    return {"accuracy": acc, "prior": p}


def weights(accuracy: tuple[float, float]) -> tuple[float, float]:
    """Log-odds that a good and a bad vote add."""
    on_good, on_bad = accuracy
    return math.log(on_good / (1 - on_bad)), math.log((1 - on_good) / on_bad)


def posterior_of(votes: dict, acc: dict, prior: float) -> float:
    odds = math.log(prior / (1 - prior))
    for r, v in votes.items():
        if v is not None:
            odds += weights(acc[r])[1 - v]
    return 1 / (1 + math.exp(-odds))


def posterior(model: dict) -> Column:
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for r, accuracy in model["accuracy"].items():
        for_good, for_bad = weights(accuracy)
        odds = odds + F.when(F.col(r) == 1, for_good).when(F.col(r) == 0, for_bad).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows (doc_id, features, rule votes, posterior, base_failed, kept), one per row of docs.

    base_failed: n_words < 50, or 100 * n_repeat_words > 50 * n_words. kept: not base_failed and posterior >= threshold.
    Null texts count as empty (they fail the base rule); repeated rows and null ids stay; only the two named columns are read.
    """
    found = measured(docs, id_col, text_col)
    rules = default_rules()
    voted = found.select("*", *(c.cast("int").alias(r) for r, c in rules.items()))
    voted = cut(voted)  # numbers only, so that texts are read a single time
    model = fit(voted, list(rules))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = voted.withColumn("posterior", posterior(model)).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


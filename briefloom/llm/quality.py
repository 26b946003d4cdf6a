"""Quality rules under weak supervision.

Every rule looks at a few features of a whole text and votes 1 (good), -1 (bad) or 0
(abstains).  Rules vote independently given the unknown class, each with its own rates
(Dawid and Skene, 1979).  Votes are counted over all documents by their pattern: with R
rules there are at most 3^R patterns whatever the number of rows, and only these counts
reach the driver, where expectation-maximisation fits the rates.  A document is kept when
its posterior probability of being good is at least the threshold; no rule has a veto but
the base limits, where the caller asks for them.

Null and empty texts have no word: all features are 0 and, with base limits, they fail.
Equal rows are rated alike, each on its own.  Other columns are passed through untouched.
An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import small_batches, staged
from .textscan import Block, SPACE, blocks, mixed, per_text, release, span_hashes, tidy, windows, words

# Characters that count as symbols; sentence ends; commonest words by language.
SYMBOLS = "#*$%&|<>"
ENDS = ".!?\"'"
COMMON_WORDS = (
    "the of and to in that is for with on as was at by it from are this be have not or an "
    "de la le les et des en un une du que dans pour est pas au sur qui ne se "
    "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es "
    "el los las del por con una su para al lo como"
)

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_letter_words", "n_common_words")
_TYPE = ", ".join(f"{x}: bigint" for x in FEATURES)

_SYMBOL = np.isin(np.arange(256), list(SYMBOLS.encode()))
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])
_END = np.isin(np.arange(256), list(ENDS.encode()))


def _common() -> np.ndarray:
    text = " ".join(sorted(set(COMMON_WORDS.split())))
    return np.sort(words(next(blocks(pa.array([text]))), lower=True)[1])


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def block_features(block: Block, common: np.ndarray) -> list[np.ndarray]:
    """The features of each text of a block, in the order of FEATURES."""
    n, data = len(block.offsets) - 1, block.data
    count = lambda at: np.bincount(at, minlength=n).astype(np.int64)
    own = mixed(np.arange(n, dtype=np.uint64) + np.uint64(1))
    text, hashes = words(block, lower=False)
    n_words = count(text)
    word_chars = per_text(block, ~SPACE[data] & ((data & 0xC0) != 0x80))
    n_symbols = per_text(block, _SYMBOL[data])

    at, runs = windows(text, hashes, 3)
    first = np.flatnonzero(text[:-2] == text[2:]) if len(text) > 2 else at
    again = first[_repeats(runs ^ own[at])]
    inside = np.zeros(len(text), bool)
    for i in range(3):
        inside[again + i] = True
    n_repeat = count(text[inside])

    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([block.offsets[:-1], feeds + 1]))
    ends = np.sort(np.concatenate([feeds, block.offsets[1:]]))
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~SPACE[data], out=solid[1:])
    full = solid[ends] > solid[starts]
    starts, ends = starts[full], ends[full]
    of = np.searchsorted(block.offsets, starts, "right") - 1
    _, earliest = np.unique(span_hashes(data, starts, ends) ^ own[of], return_index=True)
    later = np.ones(len(of), bool)
    later[earliest] = False
    last = np.flatnonzero(~SPACE[data])
    stop = last[solid[ends] - 1] if len(ends) else ends
    ended = _END[data[stop]] if len(ends) else later

    begins = np.flatnonzero(~SPACE[data] & np.concatenate([[True], SPACE[data[:-1]]])) if len(data) else feeds
    letters = _LETTER[data[begins]]
    letters_of = np.searchsorted(block.offsets, begins[letters], "right") - 1
    low = words(block, lower=True)[1]
    known = common[np.minimum(np.searchsorted(common, low), len(common) - 1)] == low
    return [n_words, word_chars, n_symbols, count(of[later]), n_repeat, count(of), count(of[ended]), np.minimum(count(letters_of), n_words), count(text[known])]


def features(text: Column) -> Column:
    """A struct of FEATURES of the whole text."""

    def measured(column: pa.Array) -> pa.Array:
        release()
        common = _common()
        found = [block_features(x, common) for x in blocks(column)]
        parts = [np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in range(len(FEATURES))]
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in parts], names=list(FEATURES))

    return F.arrow_udf(tidy(measured), f"struct<{_TYPE}>")(text)


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def votes(f: Column) -> dict[str, Column]:
    """The rules' votes: 1 good, -1 bad, 0 abstains."""
    n = F.greatest(f["n_words"], F.lit(1)).cast("double")
    lines = F.greatest(f["n_lines"], F.lit(1)).cast("double")

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    enough = f["n_words"] >= 20
    return {
        "length": vote(f["n_words"] >= 60, f["n_words"] < 30),
        "word_length": vote((f["word_chars"] / n).between(3, 9), ~(f["word_chars"] / n).between(2, 14)),
        "symbols": vote(f["n_symbols"] / n < 0.02, f["n_symbols"] / n > 0.1),
        "lines": F.when(f["n_lines"] < 3, 0).otherwise(vote(f["n_dup_lines"] / lines < 0.05, (f["n_dup_lines"] / lines > 0.3) & (f["n_dup_lines"] >= 3))),
        "repeats": vote(enough & (f["n_repeat_words"] / n < 0.15), f["n_repeat_words"] / n > 0.4),
        "ends": F.when(f["n_lines"] < 3, 0).otherwise(vote(f["n_ended_lines"] / lines > 0.6, f["n_ended_lines"] / lines < 0.12)),
        "letters": vote(f["n_letter_words"] / n > 0.85, f["n_letter_words"] / n < 0.6),
        "common": F.when(~enough, 0).otherwise(vote(f["n_common_words"] / n > 0.08, f["n_common_words"] / n < 0.01)),
    }


#: What is believed before any vote is counted, and how many votes that belief weighs, as a share of all documents.
GOOD_SHARE, WRONG_ALARM, RIGHT_ALARM, BELIEF = 0.9, 0.001, 0.3, 0.02


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> tuple[float, np.ndarray]:
    """Expectation-maximisation over the distinct vote patterns.

    patterns holds a row of votes for each pattern, counts how many documents have it.
    Returns the log-odds of good before any vote, and what each rule's vote (-1, 0, 1) adds.
    A rule that abstains says nothing.  The search starts from, and is held near, the belief that rules seldom call a good
    document bad, while a bad one is called bad by some rules only."""
    n_rules, total = patterns.shape[1], counts.sum()
    weigh = max(1.0, BELIEF * total)
    alarm = np.tile([[RIGHT_ALARM], [WRONG_ALARM]], (1, n_rules))  # of bad and of good documents
    share, good = GOOD_SHARE, np.zeros(len(counts))
    for _ in range(rounds):
        weight = np.zeros((n_rules, 3))
        weight[:, 0] = np.log(alarm[1] / alarm[0])
        weight[:, 2] = np.log((1 - alarm[1]) / (1 - alarm[0]))
        prior = math.log(share / (1 - share))
        odds = prior + sum(weight[r, patterns[:, r] + 1] for r in range(n_rules))
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        moved, good = np.abs(new - good).max(initial=0), new
        if moved < tolerance:
            break
        for k, (part, belief) in enumerate(((1 - good, RIGHT_ALARM), (good, WRONG_ALARM))):
            mass = (counts * part)[:, None]
            called, spoke = ((patterns == -1) * mass).sum(axis=0), ((patterns != 0) * mass).sum(axis=0)
            alarm[k] = (called + weigh * belief) / (spoke + weigh)
        share = ((counts * good).sum() + weigh * GOOD_SHARE) / (total + weigh)
    return prior, weight


def posterior(cast: dict[str, Column], prior: float, weight: np.ndarray) -> Column:
    """The probability of good as an expression over the votes."""
    odds = F.lit(float(prior))
    for r, vote in enumerate(cast.values()):
        bad, none, good = map(float, weight[r])
        odds = odds + F.when(vote == -1, bad).when(vote == 1, good).otherwise(none)
    return 1 / (1 + F.exp(-odds))


def learned(df: DataFrame, f: str) -> tuple[float, np.ndarray]:
    """Fits the rules' rates to all rows of df, whose struct column f has the features."""
    cast = votes(F.col(f))
    rows = df.select(*[v.cast("tinyint").alias(k) for k, v in cast.items()]).groupBy(*cast).count().collect()
    if not rows:
        return 0.0, np.zeros((len(cast), 3))
    table = np.array([tuple(x) for x in sorted(rows)], np.int64)
    return fit(table[:, :-1], table[:, -1].astype(float))


def rated(measured: DataFrame, feature_column: str = "_features", probability: str = "_quality") -> DataFrame:
    """measured, whose struct column has the features, with the posterior probability that each row is good."""
    prior, weight = learned(measured, feature_column)
    return measured.withColumn(probability, posterior(votes(F.col(feature_column)), prior, weight))


def good_documents(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that pass the base limits and are good with at least the given probability."""
    held = docs.select(F.struct(*docs.columns).alias("doc"))
    small_batches(docs.sparkSession)
    out = rated(held.withColumn("f", features(F.col("doc")[text])), "f", "p")
    return out.where(~base_failed(F.col("f")) & (F.col("p") >= threshold)).select("doc.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    small_batches(spark)
    f = F.col("_features")
    measured = staged(docs.select("doc_id", features(F.col("text")).alias("_features")), "features")  # both passes read these few numbers
    return rated(measured).select(
        "doc_id",
        *[f[x].alias(x) for x in FEATURES[:5]],
        base_failed(f).alias("base_failed"),
        (~base_failed(f) & (F.col("_quality") >= 0.5)).alias("kept"),
        F.round("_quality", 9).alias("quality"),
    )

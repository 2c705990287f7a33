"""Quality rules by weak supervision.

Each rule looks at a document's counts and votes good, bad or abstains.  A latent-class
model takes the votes as independent given the true quality; expectation-maximisation
estimates the prior and how each rule votes in either class (its accuracies) from the
counts of vote patterns over all documents.  There are at most 3 ** len(RULES) patterns,
whatever the corpus; only these counts reach the driver.  A document is kept on its
posterior probability, not on passing every rule.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.llm.common import checkpointed, fresh, map_blocks
from quillspark.llm.textstats import line_counts, word_stats

COUNTS = ("n_words", "word_chars", "n_symbols", "caps_words", "same_words", "plain_words", "exclaims", "distinct_words", "n_repeat_words", "n_lines", "n_dup_lines")
#: The struct column that holds the counts beside a row's own columns.
HELD = "__counts"
BAD, ABSTAIN, GOOD = 0, 1, 2


def with_counts(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """The rows with their counts in the struct column ``__counts``, which replaces one of that name;
    the text goes unless ``keep_text``."""
    text = fresh(docs, "__t")
    fields = [f for f in docs.schema.fields if f.name != HELD and (keep_text or f.name != text_col)]
    carried = [f.name for f in fields]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(text).to_pylist()
        stats = word_stats(texts)
        lines = np.array([line_counts(t) for t in texts], np.int64).reshape(-1, 2)
        stats["n_lines"], stats["n_dup_lines"] = lines[:, 0], lines[:, 1]
        counts = pa.StructArray.from_arrays([pa.array(stats[c].astype(np.int64)) for c in COUNTS], names=list(COUNTS))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), counts], names=[*carried, HELD])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    held = f"{HELD} struct<{','.join(f'{c}:long' for c in COUNTS)}>"
    return map_blocks(docs.select(*carried, F.col(text_col).cast("binary").alias(text)), run, f"{kinds}, {held}" if kinds else held, text)


def _c(name: str) -> Column:
    return F.col(f"{HELD}.{name}")


def _share(name: str, of: str = "n_words") -> Column:
    return _c(name) / F.greatest(_c(of), F.lit(1))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def rules() -> dict[str, Column]:
    """The votes by rule: 0 bad, 1 abstain, 2 good."""
    n = _c("n_words")
    enough = n >= 10
    chars = _share("word_chars")
    return {
        "length": _vote(n < 5, n >= 30),
        "word_size": _vote((chars < 1.5) | (chars > 20), chars.between(2.5, 12)),
        "symbols": _vote(_share("n_symbols") > 0.1, _share("n_symbols") <= 0.02),
        "capitals": _vote(enough & (_share("caps_words") > 0.3), _share("caps_words") < 0.1),
        "stutter": _vote(enough & (_share("same_words") > 0.2), _share("same_words") < 0.05),
        "exclaims": _vote(enough & (_share("exclaims") > 0.3), _share("exclaims") < 0.1),
        "plain_words": _vote(enough & (_share("plain_words") < 0.7), _share("plain_words") > 0.9),
        "variety": _vote(enough & (_share("distinct_words") < 0.25) & (n <= 400), (_share("distinct_words") > 0.4) | (n > 400)),
        # repeats that whole repeated lines explain are left to the rule on lines
        "repeats": _vote(enough & (_share("n_repeat_words") > 0.2) & (_c("n_dup_lines") == 0), _share("n_repeat_words") < 0.02),
        "lines": _vote((_c("n_lines") >= 3) & (_share("n_dup_lines", "n_lines") > 0.5), _share("n_dup_lines", "n_lines") < 0.1),
    }


@dataclass(frozen=True)
class Model:
    prior: float  # P(good)
    votes: dict[str, list[list[float]]]  # rule -> P(vote | class), class 0 bad, 1 good

    def accuracy(self, rule: str) -> tuple[float, float]:
        """Share of right votes among its votes on bad and on good documents."""
        bad, good = self.votes[rule]
        return bad[BAD] / (bad[BAD] + bad[GOOD]), good[GOOD] / (good[BAD] + good[GOOD])

    def posterior(self) -> Column:
        """P(good | votes) as an expression over the counts."""
        odds = F.lit(float(np.log(self.prior / (1 - self.prior))))
        for name, vote in rules().items():
            bad, good = self.votes[name]
            gain = [float(np.log(g / b)) for b, g in zip(bad, good)]
            odds = odds + F.when(vote == BAD, gain[BAD]).when(vote == GOOD, gain[GOOD]).otherwise(gain[ABSTAIN])
        return 1 / (1 + F.exp(-odds))


def estimate(patterns: np.ndarray, counts: np.ndarray, names: list[str], rounds: int = 200, smooth: float = 1.0) -> Model:
    """Expectation-maximisation over vote patterns (rows of 0, 1, 2) and their counts.

    It begins from the majority: the share of good among a pattern's votes.  ``smooth`` is
    added to every count, so no rule is ever taken as certain; without documents all
    votes stay even.
    """
    good, bad = (patterns == GOOD).sum(1), (patterns == BAD).sum(1)
    p = (good + 1) / (good + 3 * bad + 2)  # a bad vote is the rarer evidence
    one_hot = (patterns[:, :, None] == np.arange(3)).astype(float)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - p), counts * p])
        prior = (weight[1].sum() + smooth) / (counts.sum() + 2 * smooth)
        table = np.einsum("cp,prv->crv", weight, one_hot) + smooth
        table /= table.sum(2, keepdims=True)
        logs = np.einsum("prv,crv->cp", one_hot, np.log(table))
        odds = np.log(prior / (1 - prior)) + logs[1] - logs[0]
        new = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        if np.abs(new - p).max(initial=0) < 1e-9:
            break
        p = new
    return Model(float(prior), {n: table[:, r].tolist() for r, n in enumerate(names)})


def fit(counted: DataFrame) -> Model:
    """The model of all rows of ``with_counts``."""
    votes = rules()
    names = list(votes)
    rows = counted.select(*(v.alias(n) for n, v in votes.items())).groupBy(*names).count().collect()
    table = np.array([[r[n] for n in names] for r in rows], np.int64).reshape(-1, len(names))
    return estimate(table, np.array([r["count"] for r in rows], float), names)


def base_failed() -> Column:
    return (_c("n_words") < 10) | (100 * _c("n_repeat_words") > 20 * _c("n_words"))


def judge(docs: DataFrame, text_col: str = "text", cut: float = 0.5, keep_text: bool = True) -> DataFrame:
    """The rows with ``__counts`` and the struct ``__verdict`` of base_failed, good (posterior) and kept
    (posterior of at least ``cut``); without their text unless ``keep_text``.

    Texts are read once: rows and counts are checkpointed, and both the fit and the verdict read them there.

    Null and empty texts have counts of zero; equal rows are judged alike; an empty table
    gives no rows; the other columns, null or not, are carried and not looked at, but for
    columns named ``__counts`` or ``__verdict``, which are replaced.
    """
    counted = checkpointed(with_counts(docs, text_col, keep_text))
    good = fit(counted).posterior()
    return counted.withColumn("__verdict", F.struct(base_failed().alias("base_failed"), good.alias("good"), (good >= cut).alias("kept")))


def keep_good(docs: DataFrame, text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """The input rows whose posterior quality is at least ``cut``."""
    return judge(docs, text_col, cut).filter("__verdict.kept").select(*docs.columns)

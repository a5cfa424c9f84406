"""Quality rules as weak supervision.

Each rule votes good or bad, or abstains. How often each rule votes what on good and on bad documents is not known; it is
estimated by expectation-maximisation over the table of vote patterns, which all documents fill and which has at
most 3**rules rows. Bad documents come in kinds, and most damage comes alone: so the model has one class of good documents and one class of bad
ones for each kind of damage, in which the rules for that kind vote as they do on such damage and all others as on good documents. A rule that
fires alone is heard, unless the other rules for its kind contradict it. A document's verdict is the posterior probability that it is
good given its votes. Priors for the rates weigh as much as a share of the documents, at any size of the table; what votes coincide
with what moves them. No labels are used.

Nulls: null text has no words and fails the base rules; a null doc_id is carried. Empty texts fail. Very long texts are counted whole. Ties: a
probability of exactly ``keep_from`` is kept. Repeated rows count, and are judged, each on its own. Clashing columns are carried as one
struct. An empty table gives an empty one.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postalloom.llm.common import cut, table
from postalloom.llm.text_stats import COUNTS, counted, counted_rows

NAME = "op4_weak_quality"
ORACLE = None

GOOD, ABSTAIN, BAD = 1, 0, -1
VOTES = (BAD, ABSTAIN, GOOD)
KEEP_FROM = 0.5
MIN_WORDS = 50
MOST_REPEATED = 50  # per cent of the words


def _share(part: str, whole: str = "n_words") -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(bad: Column, good: Column | None = None) -> Column:
    votes = F.when(bad, F.lit(BAD))
    if good is not None:
        votes = votes.when(good, F.lit(GOOD))
    return votes.otherwise(F.lit(ABSTAIN))


#: Before any document is seen: how often a rule votes bad on good documents, for extreme thresholds and for weaker ones.
STRICT, LOOSE = 0.005, 0.05
#: And its votes (bad, abstain, good) on documents with the damage that it looks for.
CAUGHT = (0.7, 0.2, 0.1)
#: P(good), and what these priors weigh as a share of all documents; that of misfires weighs FIRM.
GOOD_SHARE, PRIOR, FIRM = 0.85, 0.02, 0.2


@dataclass(frozen=True)
class Rule:
    """A vote, the kind of damage it looks for, and how often it misfires by prior."""

    vote: Column
    kind: str
    misfires: float


def rules() -> dict[str, Rule]:
    few = F.col("n_words") < 10
    lines = F.col("n_lines")
    mean_length = _share("word_chars")
    symbols, capitals, exclaims, repeats = (_share(c) for c in ("n_symbols", "n_caps_words", "n_exclaims", "n_repeat_words"))
    variety = F.col("n_distinct_words") / F.sqrt(F.greatest("n_words", F.lit(1)))
    copies, ended = _share("n_dup_lines", "n_lines"), _share("n_ended_lines", "n_lines")
    return {
        "symbols": Rule(_vote(~few & (symbols > 0.2), ~few & (symbols < 0.02)), "markup", STRICT),
        "word_length": Rule(_vote(~few & ((mean_length < 2) | (mean_length > 20)), ~few & mean_length.between(3, 10)), "layout", LOOSE),
        "capitals": Rule(_vote(~few & (capitals > 0.4), ~few & (capitals < 0.1)), "shouting", STRICT),
        "exclaims": Rule(_vote(~few & (exclaims > 0.3), ~few & (exclaims < 0.05)), "shouting", STRICT),
        "repeats": Rule(_vote(repeats > 0.45, ~few & (repeats < 0.15)), "repetition", STRICT),
        "variety": Rule(_vote((F.col("n_words") >= MIN_WORDS) & (variety < 2), (F.col("n_words") >= MIN_WORDS) & (variety > 4)), "repetition", LOOSE),
        "dup_lines": Rule(_vote((lines >= 4) & (copies > 0.3), (lines >= 4) & (copies < 0.1)), "repetition", LOOSE),
        "line_ends": Rule(_vote((lines >= 8) & (ended < 0.1), (lines >= 4) & (ended > 0.5)), "layout", LOOSE),
    }


@dataclass
class LabelModel:
    """Shares of the classes, the good one first; per rule the probabilities of the three votes (bad, abstain, good) on good documents and on the damage it looks for; and which class that is."""

    shares: np.ndarray
    good: np.ndarray
    bad: np.ndarray
    own: np.ndarray

    @classmethod
    def start(cls, kinds: list[str], misfires: list[float]) -> LabelModel:
        """The priors, from each rule's kind of damage and misfires."""
        classes = list(dict.fromkeys(kinds))
        shares = np.array([GOOD_SHARE, *[(1 - GOOD_SHARE) / len(classes)] * len(classes)])
        return cls(shares, np.array([[m, 0.3, 0.7 - m] for m in misfires]), np.tile(CAUGHT, (len(kinds), 1)), np.array([1 + classes.index(k) for k in kinds]))

    def classes(self, patterns: np.ndarray) -> np.ndarray:
        """P(class) of each row of votes."""
        rules, at = np.arange(patterns.shape[1]), patterns + 1
        usual, damage = np.log(self.good[rules, at]), np.log(self.bad[rules, at])
        logs = np.log(self.shares) + usual.sum(axis=1, keepdims=True) + (damage - usual) @ (self.own[:, None] == np.arange(len(self.shares)))
        weights = np.exp(logs - logs.max(axis=1, keepdims=True))
        return weights / weights.sum(axis=1, keepdims=True)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good) of each row of votes."""
        return self.classes(patterns)[:, 0]

    def fit(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, tolerance: float = 1e-9, weight: float = PRIOR) -> LabelModel:
        """Expectation-maximisation from the priors, which weigh as much as the share ``weight`` of the documents, or one at least.

        Rates on good documents are taken from these alone, so that a document with two kinds of damage is no misfire of either's rules. Votes alone
        can't tell a rule that misfires from damage that no other rule sees; so what is known of misfires weighs more.
        """
        if not len(patterns):
            return self
        total = counts.sum()
        weight = max(1.0, weight * total)
        firm = FIRM / PRIOR * weight
        found = self
        for _ in range(rounds):
            mass = found.classes(patterns) * counts[:, None]
            size = mass.sum(axis=0)
            damaged = mass[:, self.own]
            hits = np.stack([(damaged * (patterns == v)).sum(axis=0) for v in VOTES], axis=1)
            usual = np.stack([mass[:, 0] @ (patterns == v) for v in VOTES], axis=1)
            misfires = (usual + firm * self.good)[:, :1] / (size[0] + firm)
            rest = (usual + weight * self.good)[:, 1:]
            good = np.hstack([misfires, (1 - misfires) * rest / rest.sum(axis=1, keepdims=True)])
            after = LabelModel((size + weight * self.shares) / (total + weight), good, (hits + weight * self.bad) / (size[self.own, None] + weight), self.own)
            moved, found = np.abs(after.shares - found.shares).max(), after
            if moved < tolerance:
                break
        return found


def voted(counts: DataFrame) -> DataFrame:
    return counts.withColumns({name: rule.vote for name, rule in rules().items()})


def fit(counts: DataFrame) -> LabelModel:
    """The model from every row's counts; what comes to the driver is a row per vote pattern that occurs."""
    names = list(rules())
    rows = voted(counts).groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()
    patterns = np.array([[r[c] for c in names] for r in rows], np.int64).reshape(-1, len(names))
    own = rules().values()
    return LabelModel.start([r.kind for r in own], [r.misfires for r in own]).fit(patterns, np.array([r["n"] for r in rows], float))


def judge(counts: DataFrame, model: LabelModel, keep_from: float = KEEP_FROM) -> DataFrame:
    """``counts`` with base_failed, p_good and kept. All 3**rules patterns are rated, 6,561 rows that are broadcast, so those that ``fit`` has not seen are too."""
    names = list(rules())
    every = np.array(list(itertools.product(VOTES, repeat=len(names))), np.int64)
    places = 3 ** np.arange(len(names))
    rated = [(int(code), float(p)) for code, p in zip((every + 1) @ places, model.posterior(every), strict=True)]
    by_code = counts.sparkSession.createDataFrame(rated, "_code int, p_good double")
    code = sum(((F.col(name) + 1) * int(place) for name, place in zip(names, places, strict=True)), F.lit(0))
    done = voted(counts).withColumn("_at", code).drop(*names).join(F.broadcast(by_code), F.col("_at") == F.col("_code")).drop("_at", "_code")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return done.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep_from))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns as they were. Texts are counted twice rather than shuffled."""
    return judge(counted_rows(docs), fit(counted(docs, []))).where("kept").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, whether it fails the base rules, and the verdict."""
    counts = cut(counted(table(spark, sf_dir, "documents"), ["doc_id"]))
    done = judge(counts, fit(counts))
    return done.select("doc_id", *COUNTS[:5], "base_failed", "kept", F.round("p_good", 6).alias("p_good"))

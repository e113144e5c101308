"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or nothing on every document.  The votes are
counted by pattern over the whole corpus (a table bounded by the number of
patterns); expectation-maximisation over it estimates how reliable each heuristic is, and
gives every pattern the posterior probability of a good document.  The
posteriors label a bounded sample of documents, on which a linear scorer over
hashed features is fitted; it scores all documents by their whole texts.

Nulls and edge cases: a null text is an empty one; on texts without words every
heuristic but the one for emptiness abstains.  Repeated rows count as often as they stand.
An empty table gives an empty result.  Only the text is read; other columns stay as they are,
unless one has the name of an output column, which is replaced.
"""

from __future__ import annotations

import zlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, with_text_results

GOOD, BAD, ABSTAIN = 1, 0, 2
LABELLERS = ["capitals", "symbols", "separators", "neighbours", "lines", "compression", "endings", "words"]
# How often a labeller is thought to vote bad, good, nothing on bad and on good documents.
PRIOR_RATES = {BAD: (0.3, 0.5, 0.2), GOOD: (0.01, 0.79, 0.2)}
PRIOR_WEIGHT = 0.5
# Documents the scorer is fitted on: at most so many of either posterior class.
FIT_DOCUMENTS = 2000
# Hashed features: of pairs of bytes, and of shapes of words.
PAIRS, SHAPES = 1024, 512

_LETTER_CASE = np.zeros(256, np.int8)
_LETTER_CASE[ord("a") : ord("z") + 1] = 1
_LETTER_CASE[ord("A") : ord("Z") + 1] = 2
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[byte for byte in range(33, 127) if not chr(byte).isalnum() and chr(byte) not in ".,;:'\"-()?"]] = True


def _vote(value: float, bad_above: float, good_below: float) -> int:
    return BAD if value > bad_above else GOOD if value < good_below else ABSTAIN


def measures(text: str) -> dict[str, float]:
    """What the heuristics look at, as shares between 0 and 1; empty without words."""
    data = text.encode()
    words = data.split()
    if not words:
        return {}
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lower, upper = counts[_LETTER_CASE == 1].sum(), counts[_LETTER_CASE == 2].sum()
    lines = [line for line in data.split(b"\n") if line.strip()]
    last = np.array([word[-1] for word in words], dtype=np.uint8)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return {
        "n_words": len(words),
        "n_lines": len(lines),
        "capitals": upper / max(1, lower + upper),
        "symbols": counts[_SYMBOL].sum() / len(data),
        "separators": sum(len(word) == 1 and _SYMBOL[word[0]] for word in words) / len(words),
        "neighbours": same / max(1, len(words) - 1),
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
        "compression": len(zlib.compress(data, 1)) / len(data),
        "endings": _SYMBOL[last].mean(),
    }


def votes(found: dict[str, float]) -> list[int]:
    """One vote per labeller; ``found`` as ``measures`` gives it."""
    if not found:
        return [ABSTAIN] * (len(LABELLERS) - 1) + [BAD]
    long = found["n_words"] >= 40
    return [
        _vote(found["capitals"], 0.4, 0.15),
        _vote(found["symbols"], 0.06, 0.02),
        _vote(found["separators"], 0.1, 0.02),
        _vote(found["neighbours"], 0.2, 0.05),
        _vote(found["lines"], 0.5, 0.1) if found["n_lines"] >= 4 else ABSTAIN,
        _vote(-found["compression"], -0.25, -0.32) if long else ABSTAIN,
        _vote(found["endings"], 0.2, 0.05),
        GOOD if found["n_words"] >= 20 else ABSTAIN,
    ]


def _pattern(text: str) -> str:
    return "".join(map(str, votes(measures(text))))


def weak_labels(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(pattern, key)`` of every row: its votes as digits, and a hash of its text to choose samples by."""

    def label(texts: list[str]) -> list[pa.Array]:
        return [pa.array([_pattern(text) for text in texts], pa.string())]

    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(text.alias("text"), F.xxhash64(text).alias("key"))
    return with_text_results(keyed, "text", T.StructType().add("pattern", T.StringType()), label).select("pattern", "key")


def fit_labellers(patterns: list[str], counts: list[int], rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """``(posterior of each pattern, rates, prior)`` by expectation-maximisation.

    ``rates[labeller, class, vote]`` is how often a labeller votes so on documents of the class.
    Labellers are independent given the class.  A prior says that they seldom call a good
    document bad (``PRIOR_RATES``), with the weight of ``PRIOR_WEIGHT`` times the documents of the
    class; it tells the classes apart, and holds together bad documents of different kinds.
    """
    table = np.array([[int(vote) for vote in pattern] for pattern in patterns])
    weight = np.array(counts, dtype=float)
    agree = (table == GOOD).sum(axis=1) - 2.0 * (table == BAD).sum(axis=1)
    posterior = 1 / (1 + np.exp(-agree))
    prior, rates = 0.5, np.zeros((table.shape[1], 2, 3))
    for _ in range(rounds):
        good, bad = weight * posterior, weight * (1 - posterior)
        prior = (good.sum() + 1) / (weight.sum() + 2)
        for vote in (BAD, GOOD, ABSTAIN):
            for side, members in ((GOOD, good), (BAD, bad)):
                before = PRIOR_RATES[side][vote] * (PRIOR_WEIGHT * members.sum() + 1)
                rates[:, side, vote] = members @ (table == vote) + before
        rates /= rates.sum(axis=2, keepdims=True)
        places = np.arange(table.shape[1])
        odds = np.log(rates[places, 1, table]).sum(axis=1) - np.log(rates[places, 0, table]).sum(axis=1)
        updated = 1 / (1 + np.exp(-np.clip(odds + np.log(prior / (1 - prior)), -30, 30)))
        if np.abs(updated - posterior).max() < 1e-9:
            break
        posterior = updated
    return posterior, rates, prior


def features(text: str) -> np.ndarray:
    """Hashed features of a whole text: pairs of bytes, shapes of words, and the measures in steps."""
    out = np.zeros(PAIRS + SHAPES, np.float32)
    data = np.frombuffer(text.encode(), np.uint8)
    if len(data) > 1:
        shaped = data.astype(np.uint16)
        pairs = (shaped[:-1] * 263 + shaped[1:] * 31) % PAIRS
        out[:PAIRS] = np.sqrt(np.bincount(pairs, minlength=PAIRS) / len(pairs))
    found = measures(text)
    for name in LABELLERS[:-1]:
        if name in found:
            step = int(min(19, 20 * found[name]))
            out[PAIRS + zlib.crc32(f"{name}{step}".encode()) % SHAPES] += 1
    out[PAIRS + zlib.crc32(f"words{min(12, int(found.get('n_words', 0)).bit_length())}".encode()) % SHAPES] += 1
    return out


def fit_scorer(rows: np.ndarray, targets: np.ndarray, rounds: int = 300, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer of soft targets; both classes weigh alike."""
    weights, bias = np.zeros(rows.shape[1], np.float32), 0.0
    share = np.clip(targets.mean(), 1e-3, 1 - 1e-3)
    importance = (targets / share + (1 - targets) / (1 - share)) / (2 * len(targets))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        error = (1 / (1 + np.exp(-np.clip(rows @ weights + bias, -30, 30))) - targets) * importance
        slope = error @ rows + 1e-5 * weights
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        weights = weights - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        bias -= rate * float(error.sum())
    return weights.astype(np.float32), float(bias)


def fit(docs: DataFrame, text_col: str = "text", fit_documents: int = FIT_DOCUMENTS) -> tuple[np.ndarray, float] | None:
    """The scorer of a corpus, or None for an empty one.

    Patterns are counted over all rows.  Of the rows whose posterior favours
    either class, the ``fit_documents`` with the smallest hashes of their text teach the scorer.
    """
    spark = docs.sparkSession
    labelled = materialize(weak_labels(docs, text_col), "weak-labels")
    table = labelled.groupBy("pattern").count().orderBy("pattern").toPandas()
    if table.empty:
        return None
    table["posterior"] = fit_labellers(table["pattern"].tolist(), table["count"].tolist())[0]
    posteriors = spark.createDataFrame(table[["pattern", "posterior"]], "pattern string, posterior double")
    rated = labelled.join(F.broadcast(posteriors), "pattern").groupBy("key").agg(F.min("posterior").alias("posterior"))
    sides = [
        rated.where(side).orderBy("key").limit(fit_documents) for side in (F.col("posterior") >= 0.5, F.col("posterior") < 0.5)
    ]
    # At most twice the bound of rows, 16 bytes each.
    chosen = F.broadcast(sides[0].unionByName(sides[1]))
    text = F.coalesce(F.col(text_col), F.lit(""))
    taught = (
        docs.select(text.alias("text"), F.xxhash64(text).alias("key")).join(chosen, "key").groupBy("key")
        .agg(F.first("text").alias("text"), F.first("posterior").alias("posterior")).orderBy("key").collect()
    )
    rows = np.stack([features(row["text"]) for row in taught])
    return fit_scorer(rows, np.array([row["posterior"] for row in taught]))


def score(docs: DataFrame, text_col: str = "text", fit_documents: int = FIT_DOCUMENTS) -> DataFrame:
    """``docs`` with ``quality`` (0 to 1, higher is better) and ``keep``."""
    kept = [name for name in docs.columns if name not in ("quality", "keep")]
    source = docs.select(*kept)
    model = fit(docs, text_col, fit_documents)
    if model is None:
        return source.withColumns({"quality": F.lit(None).cast("double"), "keep": F.lit(None).cast("boolean")})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(texts: list[str]) -> list[pa.Array]:
        weights, bias = shared.value
        logits = np.array([float(features(text) @ weights) + bias for text in texts])
        quality = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
        return [pa.array(quality), pa.array(quality >= 0.5)]

    added = T.StructType().add("quality", T.DoubleType()).add("keep", T.BooleanType())
    return with_text_results(source, text_col, added, scored)

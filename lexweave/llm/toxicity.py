"""Toxicity by a small bidirectional gated recurrent network over overlapping windows of words.

A word enters as an embedding of its own and as the mean embedding of its character
trigrams, so that unseen forms of a word are known by their parts; what occurs in few
training documents has the embedding 0.  Two
gated recurrent layers read a window forwards and backwards, attention pools their
states, and a linear layer gives the window's logit.  A document's score is that of
its most toxic window, calibrated on the training documents.

The network is trained on the driver, in numpy, on a sample of labelled documents
bounded by ``Settings.train_documents`` per class and ``Settings.train_windows`` per document.
Everything else reads whole texts: the scores are computed in the tasks, over all
windows, in blocks of bounded size.

Nulls and edge cases: a null text is an empty one; a text without words has one
empty window.  Null labels are left out.  With labels of one class only, or none,
every score is the smoothed share of label 1.  Repeated rows and ids are scored row by row.
Only the named columns are read; labels, language, source and id are never inputs.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_text_results

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    window: int = 48
    stride: int = 32
    least_documents: int = 3
    least_share: float = 0.005
    embedding: int = 8
    hidden: int = 8
    train_documents: int = 1500
    calibration_share: float = 0.25
    train_windows: int = 6
    epochs: int = 7
    least_steps: int = 300
    warm_epochs: int = 2
    batch: int = 256
    rate: float = 0.02
    seed: int = 17


# Characters whose words are held at once, and windows computed at once.
BLOCK_BYTES = 2 << 20
BLOCK_WINDOWS = 4096


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Vocabulary:
    """The distinct words of a block of texts: their hashes and those of their trigrams; word 0 is padding."""

    def __init__(self, settings: Settings):
        self.settings, self.places = settings, {}

    def ids(self, words: list[str]) -> list[int]:
        places = self.places
        return [places.setdefault(word, len(places) + 1) for word in words]

    def hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(word hashes, trigrams, first trigram of each word)`` of the words from 1 on."""
        if not self.places:
            none = np.empty(0, np.uint64)
            return none, none, np.empty(0, np.int64)
        encoded = [b"^" + word.encode() + b"$" for word in self.places]
        data = np.frombuffer(b"".join(encoded), np.uint8).astype(np.uint64)
        lengths = np.array([len(item) for item in encoded], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        # A polynomial over the bytes, reduced modulo 2**64.
        at = np.arange(len(data)) - np.repeat(starts, lengths)
        powers = np.full(int(lengths.max()), 1099511628211, dtype=np.uint64).cumprod()
        mixed = np.add.reduceat((data + np.uint64(1)) * powers[at], starts)
        grams = data[:-2] * np.uint64(65536) + data[1:-1] * np.uint64(256) + data[2:]
        inside = at[:-2] <= np.repeat(lengths, lengths)[:-2] - 3
        return mixed, grams[inside], np.cumsum(lengths - 2) - (lengths - 2)


def _rows_of(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The table row (from 1) of each asked value, 0 for those that are not known."""
    if not len(known):
        return np.zeros(len(asked), dtype=np.int64)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return np.where(known[at] == asked, at + 1, 0)


def _frequent(values: np.ndarray, documents: Iterable[np.ndarray], least: int) -> np.ndarray:
    """The sorted distinct ``values`` that ``least`` documents or more have; a document is a list of places in ``values``."""
    distinct, names = np.unique(values, return_inverse=True)
    counts = np.zeros(len(distinct), np.int32)
    for places in documents:
        counts[np.unique(names[places])] += 1
    return distinct[counts >= least]


def windows_of(ids: list[int], settings: Settings) -> np.ndarray:
    """Overlapping windows, padded with 0; every word is in one at least."""
    length = settings.window
    starts = np.arange(0, max(1, len(ids) - (length - settings.stride)), settings.stride)
    padded = np.zeros(int(starts[-1]) + length, dtype=np.int32)
    padded[: len(ids)] = ids
    return padded[starts[:, None] + np.arange(length)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Weights and the forward and backward pass; all arrays are float32."""

    def __init__(self, settings: Settings, known_words: np.ndarray, known_grams: np.ndarray):
        self.settings, self.known_words, self.known_grams = settings, known_words, known_grams
        rng = np.random.default_rng(settings.seed)
        e, h = settings.embedding, settings.hidden
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.weights = {
            "words": draw(len(known_words) + 1, e, scale=0.01),
            "chars": draw(len(known_grams) + 1, e, scale=0.01),
            "attend": draw(2 * h, scale=0.3),
            "out": draw(2 * h, scale=0.5),
            "bias": np.zeros(1, np.float32),
        }
        for side in ("forward", "backward"):
            self.weights[f"{side}_in"] = draw(2 * e, 3 * h, scale=0.4)
            self.weights[f"{side}_state"] = draw(h, 3 * h, scale=0.3)
            self.weights[f"{side}_bias"] = np.zeros(3 * h, np.float32)
        # Row 0 stands for all that the training documents hardly have.
        self.weights["words"][0] = self.weights["chars"][0] = 0
        self.slope, self.shift = 1.0, 0.0

    def inputs(self, vocabulary: Vocabulary) -> np.ndarray:
        """The input of each word; row 0 is padding."""
        e = self.settings.embedding
        rows = np.zeros((len(vocabulary.places) + 1, 2 * e), np.float32)
        if vocabulary.places:
            word, grams, firsts = vocabulary.hashes()
            rows[1:, :e] = self.weights["words"][_rows_of(self.known_words, word)]
            counts = np.diff(np.append(firsts, len(grams)))[:, None]
            rows[1:, e:] = np.add.reduceat(self.weights["chars"][_rows_of(self.known_grams, grams)], firsts) / counts
        return rows

    def _layer(self, inputs: np.ndarray, windows: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """States (window, place, hidden) of one direction."""
        h = self.settings.hidden
        state_weights = self.weights[f"{side}_state"]
        projected = inputs @ self.weights[f"{side}_in"] + self.weights[f"{side}_bias"]
        states = np.zeros((windows.shape[1], len(windows), h), np.float32)
        state = np.zeros((len(windows), h), np.float32)
        places = range(windows.shape[1]) if side == "forward" else reversed(range(windows.shape[1]))
        for at in places:
            here = windows[:, at]
            x, s = projected[here], state @ state_weights
            gates = _sigmoid(x[:, : 2 * h] + s[:, : 2 * h])
            update, reset = gates[:, :h], gates[:, h:]
            new = np.tanh(x[:, 2 * h :] + reset * s[:, 2 * h :])
            mask = (here > 0)[:, None]
            following = (new + update * (state - new)) * mask
            if keep is not None:
                keep.append((at, state, update, reset, new, s[:, 2 * h :], mask))
            states[at] = state = following
        return states

    def logits(self, inputs: np.ndarray, windows: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._layer(inputs, windows, side) for side in ("forward", "backward")], axis=2)
        weights = self._attention(both, windows)
        return np.einsum("twh,tw,h->w", both, weights, self.weights["out"], optimize=True) + self.weights["bias"]

    def _attention(self, both: np.ndarray, windows: np.ndarray) -> np.ndarray:
        scores = np.where(windows.T > 0, both @ self.weights["attend"], -1e9)
        scores = np.exp(scores - scores.max(axis=0))
        return scores / scores.sum(axis=0)

    def gradients(self, inputs: np.ndarray, windows: np.ndarray, targets: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean weighted log loss, for the weights and for the inputs of the words."""
        h = self.settings.hidden
        kept = {side: [] for side in ("forward", "backward")}
        both = np.concatenate([self._layer(inputs, windows, side, kept[side]) for side in kept], axis=2)
        weights = self._attention(both, windows)
        pooled = np.einsum("twh,tw->wh", both, weights)
        error = (_sigmoid(pooled @ self.weights["out"] + self.weights["bias"]) - targets) * weight / len(targets)
        found = {"out": error @ pooled, "bias": error.sum(keepdims=True)}
        to_pooled = error[:, None] * self.weights["out"]
        to_weights = np.einsum("twh,wh->tw", both, to_pooled)
        to_scores = weights * (to_weights - (weights * to_weights).sum(axis=0))
        found["attend"] = np.einsum("twh,tw->h", both, to_scores)
        to_both = weights[:, :, None] * to_pooled + to_scores[:, :, None] * self.weights["attend"]
        to_inputs = np.zeros_like(inputs)
        for side, part in (("forward", to_both[:, :, :h]), ("backward", to_both[:, :, h:])):
            state_weights = self.weights[f"{side}_state"]
            to_projected = np.zeros((len(inputs), 3 * h), np.float32)
            to_state_weights = np.zeros_like(state_weights)
            carried = np.zeros((len(windows), h), np.float32)
            for at, state, update, reset, new, inner, mask in reversed(kept[side]):
                total = (part[at] + carried) * mask
                to_new = total * (1 - update) * (1 - new**2)
                to_update = total * (state - new) * update * (1 - update)
                to_reset = to_new * inner * reset * (1 - reset)
                to_state = np.concatenate([to_update, to_reset, to_new * reset], axis=1)
                to_state_weights += state.T @ to_state
                carried = total * update + to_state @ state_weights.T
                np.add.at(to_projected, windows[:, at], np.concatenate([to_update, to_reset, to_new], axis=1))
            found[f"{side}_state"] = to_state_weights
            found[f"{side}_bias"] = to_projected.sum(axis=0)
            found[f"{side}_in"] = inputs.T @ to_projected
            to_inputs += to_projected @ self.weights[f"{side}_in"].T
        return found, to_inputs

    def score(self, logits: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * logits + self.shift)


class _Adam:
    def __init__(self, weights: dict, rate: float):
        self.weights, self.rate, self.steps, self.sizes = weights, rate, 0, {}
        self.first = {name: np.zeros_like(value) for name, value in weights.items()}
        self.second = {name: np.zeros_like(value) for name, value in weights.items()}

    def step(self, gradients: dict, rows: dict[str, np.ndarray]) -> None:
        """``rows``: the rows of a table that a gradient belongs to; others stand still.

        A table moves by its gradients over their overall size, so that rare rows move
        little and are not learned by heart.
        """
        self.steps += 1
        scale = np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        for name, gradient in gradients.items():
            if not gradient.size:
                continue
            if name in rows:
                size = self.sizes[name] = 0.95 * self.sizes.get(name, 0.0) + 0.05 * float(np.abs(gradient).max())
                self.weights[name][rows[name]] -= 5 * self.rate * gradient / (size / (1 - 0.95**self.steps) + 1e-8)
                continue
            first = self.first[name] = 0.9 * self.first[name] + 0.1 * gradient
            second = self.second[name] = 0.99 * self.second[name] + 0.01 * gradient**2
            self.weights[name] -= self.rate * scale * first / (np.sqrt(second) + 1e-6)


def train(texts: list[str], labels: list[int], settings: Settings = Settings()) -> Network:  # noqa: B008
    """A network fitted on documents with labels 0 and 1, and calibrated on a share of them it has not seen."""
    rng = np.random.default_rng(settings.seed)
    order, apart = rng.permutation(len(texts)), []
    for label in (0, 1):
        side = [at for at in order.tolist() if labels[at] == label]
        apart += side[: int(len(side) * settings.calibration_share)]
    unseen = set(apart)
    seen = [at for at in range(len(texts)) if at not in unseen]
    network = _fit([texts[at] for at in seen], [labels[at] for at in seen], settings)
    used = apart if len({labels[at] for at in apart}) == 2 else seen
    logits = np.concatenate([_best_logits(network, texts[at : at + 1]) for at in used])
    _calibrate(network, logits, np.array([labels[at] for at in used], dtype=np.float32))
    return network


def _fit(texts: list[str], labels: list[int], settings: Settings) -> Network:
    """The weights.

    All windows of a toxic document start as toxic, with a small weight.  After
    ``settings.warm_epochs`` only those count that the network finds toxic, and the most
    toxic one of each document; the other windows of toxic documents say nothing.
    """
    rng, vocabulary = np.random.default_rng(settings.seed), Vocabulary(settings)
    parts, owners, words = [], [], []
    for at, text in enumerate(texts):
        ids = vocabulary.ids(words_of(text))
        words.append(np.unique(ids).astype(np.int64) - 1)
        found = windows_of(ids, settings)
        if len(found) > settings.train_windows:
            found = found[np.sort(rng.choice(len(found), settings.train_windows, replace=False))]
        parts.append(found)
        owners += [at] * len(found)
    windows, owners = np.concatenate(parts), np.array(owners)
    truth = np.array(labels, dtype=np.float32)
    targets = truth[owners]
    weight = np.where(targets > 0, 0.3, 1).astype(np.float32)
    hashes, codes, firsts = vocabulary.hashes()
    counts = np.diff(np.append(firsts, len(codes)))

    def grams_of(mine: np.ndarray) -> np.ndarray:
        sizes = counts[mine]
        return np.repeat(firsts[mine] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())

    least = max(settings.least_documents, int(settings.least_share * len(texts)))
    network = Network(
        settings,
        _frequent(hashes, words, least),
        _frequent(codes, (grams_of(mine) for mine in words), least),
    )
    word, grams = _rows_of(network.known_words, hashes), _rows_of(network.known_grams, codes)
    e = settings.embedding
    optimizer = _Adam(network.weights, settings.rate)
    batches = -(-len(windows) // settings.batch)
    stretch = max(1, -(-settings.least_steps // (batches * settings.epochs)))
    for epoch in range(settings.epochs * stretch):
        if epoch >= settings.warm_epochs * stretch:
            seen = _all_logits(network, network.inputs(vocabulary), windows)
            best = np.full(len(truth), -np.inf)
            np.maximum.at(best, owners, seen)
            weight = np.where((targets == 0) | (seen > 1) | (seen == best[owners]), 1, 0).astype(np.float32)
        order = rng.permutation(np.flatnonzero(weight))
        for start in range(0, len(order), settings.batch):
            batch = order[start : start + settings.batch]
            used, local = np.unique(windows[batch], return_inverse=True)
            if used[0] != 0:
                used, local = np.append(0, used), local + 1
            local = local.reshape(len(batch), -1)
            sizes = counts[used[1:] - 1]
            place = np.repeat(np.arange(len(sizes)), sizes)
            inside = firsts[used[1:] - 1][place] + np.arange(len(place)) - (np.cumsum(sizes) - sizes)[place]
            rows = np.zeros((len(used), 2 * e), np.float32)
            rows[1:, :e] = network.weights["words"][word[used[1:] - 1]]
            np.add.at(rows[1:, e:], place, network.weights["chars"][grams[inside]])
            rows[1:, e:] /= sizes[:, None]
            found, to_rows = network.gradients(rows, local, targets[batch], weight[batch])
            touched = {}
            touched["words"], back = np.unique(word[used[1:] - 1], return_inverse=True)
            found["words"] = np.zeros((len(touched["words"]), e), np.float32)
            np.add.at(found["words"], back, to_rows[1:, :e])
            touched["chars"], back = np.unique(grams[inside], return_inverse=True)
            found["chars"] = np.zeros((len(touched["chars"]), e), np.float32)
            np.add.at(found["chars"], back, (to_rows[1:, e:] / sizes[:, None])[place])
            optimizer.step(found, touched)
            network.weights["words"][0] = network.weights["chars"][0] = 0
    return network


def _all_logits(network: Network, inputs: np.ndarray, windows: np.ndarray) -> np.ndarray:
    blocks = range(0, len(windows), BLOCK_WINDOWS)
    return np.concatenate([network.logits(inputs, windows[at : at + BLOCK_WINDOWS]) for at in blocks])


def _best_logits(network: Network, texts: list[str]) -> np.ndarray:
    """The logit of the most toxic window of each text."""
    return _window_logits(network, texts)[0]


def _window_logits(network: Network, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    settings, vocabulary = network.settings, Vocabulary(network.settings)
    parts = [windows_of(vocabulary.ids(words_of(text)), settings) for text in texts]
    counts = np.array([len(part) for part in parts])
    logits = _all_logits(network, network.inputs(vocabulary), np.concatenate(parts))
    firsts = np.cumsum(counts) - counts
    worst = [int(logits[at : at + n].argmax()) * settings.stride for at, n in zip(firsts, counts, strict=True)]
    return np.maximum.reduceat(logits, firsts), np.array(worst)


def _calibrate(network: Network, logits: np.ndarray, truth: np.ndarray) -> None:
    """The threshold that separates the documents best (the middle of the widest such gap), and a slope around it."""
    order = np.argsort(logits, kind="stable")
    sorted_logits, sorted_truth = logits[order], truth[order]
    weight = np.where(sorted_truth > 0, 0.5 / max(1, truth.sum()), 0.5 / max(1, (1 - truth).sum()))
    # Errors of a cut below each document: toxic ones under it, clean ones above it.
    under = np.append(0, np.cumsum(weight * (sorted_truth > 0)))
    above = np.append(np.cumsum((weight * (sorted_truth == 0))[::-1])[::-1], 0)
    errors = under + above
    edges = np.concatenate([[sorted_logits[0] - 1], sorted_logits, [sorted_logits[-1] + 1]])
    gaps = np.where(errors <= errors.min() + 1e-9, np.diff(edges), -1)
    at = int(gaps.argmax())
    cut = float(edges[at] + edges[at + 1]) / 2
    network.slope, network.shift = 1.0, -cut


def score_block(network: Network, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The score of each text and the word its most toxic window starts at."""
    best, worst = _window_logits(network, texts)
    return network.score(best), worst


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that take no part in learning: CRC-32 of the id as text, divisible by ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0


def training_sample(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[list[str], list[int]]:  # noqa: B008
    """At most ``train_documents`` texts of each class that are not held out, chosen by a hash of their id."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = usable.select("doc_id", "toxic").dropDuplicates(["doc_id"])
    chosen = None
    for label in (0, 1):
        side = ids.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.train_documents)
        chosen = side if chosen is None else chosen.unionByName(side)
    # At most twice the bound of rows, 16 bytes each.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic").collect()
    return [row["text"] for row in rows], [row["toxic"] for row in rows]


def score(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """``docs`` with ``score`` (0 to 1), ``predicted`` and ``worst_window`` (the word it starts at)."""
    texts, truth = training_sample(docs, labels, settings)
    kept = [name for name in docs.columns if name not in ("score", "predicted", "worst_window")]
    source = docs.select(*kept)
    if len(set(truth)) < 2:
        share = (sum(truth) + 1) / (len(truth) + 2)
        return source.withColumns(
            {"score": F.lit(share), "predicted": F.lit(int(share >= 0.5)), "worst_window": F.lit(0).cast("long")}
        )
    model = docs.sparkSession.sparkContext.broadcast(train(texts, truth, settings))

    def scored(texts: list[str]) -> list[pa.Array]:
        scores, worst = score_block(model.value, texts)
        return [pa.array(scores, pa.float64()), pa.array(scores >= 0.5).cast(pa.int32()), pa.array(worst, pa.int64())]

    added = T.StructType().add("score", T.DoubleType()).add("predicted", T.IntegerType()).add("worst_window", T.LongType())
    return with_text_results(source, "text", added, scored, BLOCK_BYTES)

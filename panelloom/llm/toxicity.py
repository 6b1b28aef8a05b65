"""Toxicity by weak supervision.

Many voters look at a text: hand-written lexicons in four languages, patterns, and
lexicons of word stems drawn from labelled text, dealt to several voters.  A generative
model with one hidden class gets the share of texts each voter fires on in
either class; it is fitted by expectation maximisation on the counts of vote
patterns over all documents, where training labels, as far as known, fix the
class.  The correlation of every two voters within a class is what the patterns
hold beyond independence, and discounts the evidence of voters that repeat one another.  The
posterior of the sampled texts trains a linear classifier over hashed words and
word beginnings, which scores every whole text.

What reaches the driver is bounded: a sample of labelled rows (``per_class`` of each
class) and the pattern counts, at most 2**16.  Votes and scores are one pass
over the texts each, without a shuffle of texts.

Edge cases: null and empty texts get no votes and the score of a text without features;
labels other than 0 and 1 count as unlabelled; without labels the hand-written voters alone
fit the model; repeated rows come back once per row; a null id is not held out; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .samples import fold, labelled_sample, logistic, sigmoid
from .stages import read

U = np.uint64
PER_CLASS = 2000
LEAST = 3  # toxic texts that hold a feature
STEMS = (4, 5, 6, 7)  # bytes of the word beginnings that are features
SELECTED = 800  # features of the classifier, at most
GAIN = 4.0  # standard errors by which such a feature must differ between the classes
PENALTY = 0.3
DRAWN = 6  # voters made of stems from labelled text
SUPPORT, LIFT = 0.01, 20.0  # of such a stem: least share of toxic texts, and ratio to its share of others

# Hand-written voters: words, and pairs of neighbouring words.
LEXICONS = {
    "insult_en": "idiot idiots moron morons loser losers clown clowns imbecile fool fools jerk dumb dumbass stupid pathetic "
    "worthless disgusting scum trash garbage creep freak coward liar pig swine vermin lowlife braindead retard",
    "profanity_en": "fuck fucking fucker shit shitty bullshit bitch bastard asshole crap damn dick piss slut whore cunt",
    "threat_en": "kill die murder hurt destroy hang burn shoot beat rape stab choke",
    "insult_de": "idiot trottel dummkopf depp arschloch scheiße schlampe hure wichser missgeburt abschaum drecksau versager",
    "insult_fr": "idiot imbécile crétin connard connasse salope merde putain débile abruti ordure enculé minable",
    "insult_es": "idiota imbécil estúpido pendejo cabrón puta mierda gilipollas basura asqueroso inútil maldito escoria",
}
PAIRS = {
    "address_en": "you idiot|you moron|you loser|you clown|you fool|you scum|you pig|stupid person|shut up|go die|get lost|drop dead|hate you",
}
SHAPES = ("shouting", "masked")


class Voters(NamedTuple):
    names: list[str]
    words: np.ndarray  # sorted hashes of words, stems and pairs
    bits: np.ndarray  # the vote of each


def word_hash(text: str) -> np.ndarray:
    raw = np.frombuffer(text.lower().encode(), dtype=np.uint8)
    return H.words(raw, np.array([0, len(raw)]), "alnum")[0]


def pair_hashes(hashes: np.ndarray) -> np.ndarray:
    return H.mix(hashes[:-1] * U(0xC2B2AE3D27D4EB4F) + hashes[1:])


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(hash, text) of all words and of their beginnings; the words come first, their number last."""
    words, per_text, stems = H.words_and_beginnings(raw, offsets, "alnum", STEMS)
    owner = np.repeat(np.arange(len(per_text)), per_text)
    return (
        np.concatenate([words, *(hashes for hashes, _ in stems)]),
        np.concatenate([owner, *(owner[at] for _, at in stems)]),
        len(words),
    )


def hand_written() -> Voters:
    names, words, bits = [], [], []
    for name, lexicon in LEXICONS.items():
        hashes = word_hash(lexicon)
        names.append(name)
        words.append(hashes)
        bits.append(np.full(len(hashes), 1 << (len(names) - 1), dtype=np.int64))
    for name, pairs in PAIRS.items():
        hashes = np.concatenate([pair_hashes(word_hash(p)) for p in pairs.split("|")])
        names.append(name)
        words.append(hashes)
        bits.append(np.full(len(hashes), 1 << (len(names) - 1), dtype=np.int64))
    names += SHAPES
    return Voters(names, np.concatenate(words), np.concatenate(bits))


def presence(texts: list[str], label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (feature, text) of a list of texts, of features that at least LEAST toxic ones hold.

    A first pass counts toxic texts per bucket of features, so that the second keeps few others.
    """

    def distinct():
        for lo, _, raw, offsets in H.slices(pa.array(texts, pa.large_string())):
            h, o, _ = features(raw, offsets)
            order = np.lexsort((h, o))
            h, o = h[order], o[order]
            fresh = np.ones(len(h), dtype=bool)
            fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
            yield h[fresh], o[fresh] + lo

    counts = np.zeros(1 << 22, dtype=np.int32)
    for h, o in distinct():
        np.add.at(counts, (h[label[o] == 1] >> U(42)).astype(np.int64), 1)
    hashes, owner = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for h, o in distinct():
        keep = counts[(h >> U(42)).astype(np.int64)] >= LEAST
        hashes.append(h[keep])
        owner.append(o[keep])
    return np.concatenate(hashes), np.concatenate(owner)


def with_drawn_stems(voters: Voters, hashes: np.ndarray, owner: np.ndarray, label: np.ndarray) -> Voters:
    """Adds voters of words and stems that labelled toxic texts hold far more often than others."""
    values, inverse = np.unique(hashes, return_inverse=True)
    toxic = np.bincount(inverse, weights=label[owner], minlength=len(values))
    clean = np.bincount(inverse, weights=1 - label[owner], minlength=len(values))
    n1, n0 = max(label.sum(), 1), max((1 - label).sum(), 1)
    lift = ((toxic + 0.1) / n1) / ((clean + 0.5) / n0)
    chosen = values[(toxic >= np.maximum(LEAST + 1, SUPPORT * n1)) & (lift >= LIFT)]
    group = (H.mix(chosen ^ U(0x5BD1E995)) % U(DRAWN)).astype(np.int64)
    return Voters(
        voters.names + [f"drawn_{i}" for i in range(DRAWN)],
        np.concatenate([voters.words, chosen]),
        np.concatenate([voters.bits, 1 << (len(voters.names) + group)]),
    )


def compact(voters: Voters) -> Voters:
    """Hashes sorted and distinct, the bits of equal ones combined."""
    order = np.argsort(voters.words)
    words, first = np.unique(voters.words[order], return_index=True)
    return Voters(voters.names, words, np.bitwise_or.reduceat(voters.bits[order], first))


def lookup(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Position in the sorted table, or -1."""
    if not len(table):
        return np.full(len(hashes), -1)
    marks = np.zeros(1 << 16, dtype=bool)
    marks[(table >> U(48)).astype(np.int64)] = True
    out = np.full(len(hashes), -1)
    maybe = np.flatnonzero(marks[(hashes >> U(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(table, hashes[maybe]), len(table) - 1)
    hit = table[at] == hashes[maybe]
    out[maybe[hit]] = at[hit]
    return out


def votes(voters: Voters, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bit mask of the voters that fire, per text."""
    n = len(offsets) - 1
    mask = np.zeros(n, dtype=np.int64)
    hashes, owner, n_words = features(raw, offsets)
    words, text_of = hashes[:n_words], owner[:n_words]
    if n_words > 1:
        same = text_of[1:] == text_of[:-1]
        hashes = np.concatenate([hashes, pair_hashes(words)[same]])
        owner = np.concatenate([owner, text_of[1:][same]])
    at = lookup(voters.words, hashes)
    np.bitwise_or.at(mask, owner[at >= 0], voters.bits[at[at >= 0]])
    total = np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90))])
    upper = total[offsets[1:]] - total[offsets[:-1]]
    total = np.concatenate([[0], np.cumsum((raw >= 97) & (raw <= 122))])
    lower = total[offsets[1:]] - total[offsets[:-1]]
    total = np.concatenate([[0], np.cumsum(np.isin(raw, np.frombuffer(b"*@#$%", np.uint8)))])
    signs = total[offsets[1:]] - total[offsets[:-1]]
    first = voters.names.index(SHAPES[0])
    mask |= (upper > lower).astype(np.int64) << first
    mask |= (signs * 50 > np.diff(offsets)).astype(np.int64) << (first + 1)
    return mask


def vote_rows(voters: Voters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in H.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(votes(voters, raw, offsets))], names=["id", "mask"]
                )

    return run


class LabelModel(NamedTuple):
    prior: float
    rates: np.ndarray  # (class, voter): share of texts on which the voter fires
    correlation: np.ndarray  # (voter, voter), within classes
    discount: np.ndarray  # what of a voter's evidence counts

    def posterior(self, fires: np.ndarray) -> np.ndarray:
        on = np.log(self.rates[1] / self.rates[0])
        off = np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        evidence = fires * on + (1 - fires) * off
        return sigmoid(np.log(self.prior / (1 - self.prior)) + evidence @ self.discount)


def fit_label_model(masks: np.ndarray, label: np.ndarray, count: np.ndarray, n_voters: int, rounds: int = 50) -> LabelModel:
    """Expectation maximisation over (vote pattern, label or -1, count)."""
    fires = (masks[:, None] >> np.arange(n_voters) & 1).astype(float)
    known = label >= 0
    one = np.ones(n_voters)
    model = LabelModel(0.1, np.array([0.02 * one, 0.3 * one]), np.eye(n_voters), one)
    if known.any() and 0 < (count * (label == 1)).sum() < (count * known).sum():
        start = np.where(known, label, np.nan)
        rates = [((count * (start == c))[:, None] * fires).sum(0) + 0.5 for c in (0, 1)]
        sizes = [(count * (start == c)).sum() + 1 for c in (0, 1)]
        model = model._replace(prior=sizes[1] / sum(sizes), rates=np.array([r / s for r, s in zip(rates, sizes)]))
    for _ in range(rounds):
        p = np.where(known, label, model.posterior(fires))
        share = [count * (1 - p), count * p]
        rates = np.array([((s[:, None] * fires).sum(0) + 0.5) / (s.sum() + 1) for s in share])
        prior = np.clip(share[1].sum() / count.sum(), 1e-4, 0.5)
        moved = np.abs(rates - model.rates).max()
        model = model._replace(prior=prior, rates=rates)
        if moved < 1e-7:
            break
    # Covariance within classes, beyond what independence gives.
    p = np.where(known, label, model.posterior(fires))
    covariance = np.zeros((n_voters, n_voters))
    for weight, rate in ((count * (1 - p), model.rates[0]), (count * p, model.rates[1])):
        centred = fires - rate
        covariance += (weight[:, None] * centred).T @ centred
    spread = np.sqrt(np.maximum(np.diag(covariance), 1e-12))
    correlation = covariance / np.outer(spread, spread)
    shared = np.maximum(correlation - np.diag(np.diag(correlation)), 0).sum(axis=1)
    return model._replace(correlation=correlation, discount=1 / (1 + shared))


class Classifier(NamedTuple):
    hashes: np.ndarray  # sorted
    weights: np.ndarray
    constant: float


def fit_classifier(hashes: np.ndarray, owner: np.ndarray, target: np.ndarray, weight: np.ndarray) -> Classifier:
    """Ridge logistic regression on the features that differ most between the classes."""
    n = len(target)
    values, inverse = np.unique(hashes, return_inverse=True)
    toxic = np.bincount(inverse, weights=target[owner], minlength=len(values))
    clean = np.bincount(inverse, weights=1 - target[owner], minlength=len(values))
    n1, n0 = max(target.sum(), 1e-9), max((1 - target).sum(), 1e-9)
    rate1, rate0 = toxic / n1, clean / n0
    gain = (rate1 - rate0) / np.sqrt((rate1 + 0.5 / n1) / n1 + (rate0 + 0.5 / n0) / n0)
    frequent = np.flatnonzero((toxic >= np.maximum(LEAST, SUPPORT * n1 / 2)) & (gain >= GAIN))
    chosen = np.sort(frequent[np.argsort(-gain[frequent], kind="stable")[:SELECTED]])
    column = np.full(len(values), -1)
    column[chosen] = np.arange(len(chosen))
    at = column[inverse]
    x = np.zeros((n, len(chosen)))
    x[owner[at >= 0], at[at >= 0]] = 1
    beta = logistic(x, target, weight, PENALTY, steps=12)
    return Classifier(values[chosen], beta[:-1], float(beta[-1]))


def score_rows(model: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in H.slices(batch.column(1)):
                hashes, owner, _ = features(raw, offsets)
                at = lookup(model.hashes, hashes)
                both = np.unique(owner[at >= 0] * (len(model.hashes) + 1) + at[at >= 0])
                text, feature = np.divmod(both, len(model.hashes) + 1)
                z = model.constant + np.bincount(text, weights=model.weights[feature], minlength=hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sigmoid(z))], names=["id", "score"])

    return run


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS
) -> DataFrame:
    """Per row: id, held_out (crc32 of the id modulo 4 is 2), score, predicted."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    usable = F.coalesce(fold(F.col("id"), 4) != 2, F.lit(True))
    sample = labelled_sample(docs, labels, label_col, id_col, text_col, usable, per_class)
    texts = [t for t, _, _ in sample]
    label = np.array([y for _, y, _ in sample], dtype=float)
    hashes, owner = presence(texts, label)
    voters = compact(with_drawn_stems(hand_written(), hashes, owner, label))

    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(
        usable & F.col("label").isin(0, 1)
    )
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    masks = rows.mapInArrow(vote_rows(voters), f"id {kind}, mask bigint")
    patterns = (
        masks.join(known, "id", "left").groupBy("mask", F.coalesce("label", F.lit(-1)).alias("label")).agg(F.count("*").alias("n"))
    )
    # At most 2**16 patterns, three labels each.
    counted = np.array([tuple(r) for r in patterns.collect()], dtype=np.int64).reshape(-1, 3)
    if not len(counted):
        counted = np.array([[0, -1, 1]])
    model = fit_label_model(counted[:, 0], counted[:, 1], counted[:, 2].astype(float), len(voters.names))
    classifier = train(model, voters, texts, hashes, owner, model.prior)
    scored = rows.mapInArrow(score_rows(classifier), f"id {kind}, score double")
    return scored.select(
        F.col("id").alias(id_col),
        F.coalesce(fold(F.col("id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def train(model: LabelModel, voters: Voters, texts: list[str], hashes: np.ndarray, owner: np.ndarray, prior: float) -> Classifier:
    """The classifier on the posterior of the sampled texts, weighted to the share of the class."""
    if not texts:
        return Classifier(np.zeros(0, U), np.zeros(0), float(np.log(prior / (1 - prior))))
    masks = np.concatenate([votes(voters, raw, offsets) for _, _, raw, offsets in H.slices(pa.array(texts, pa.large_string()))])
    target = model.posterior((masks[:, None] >> np.arange(len(voters.names)) & 1).astype(float))
    mean = float(np.clip(target.mean(), 1e-6, 1 - 1e-6))
    weight = target * prior / mean + (1 - target) * (1 - prior) / (1 - mean)
    return fit_classifier(hashes, owner, target, weight)


def op4_toxicity_weak_supervision(spark, sf_dir: str) -> DataFrame:
    return toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))

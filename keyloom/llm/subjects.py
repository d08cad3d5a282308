"""Subject areas of documents.

A document can be about several subjects, each in a sentence or two, so sentences are what is
classified, and a document has every subject that one of its sentences has.

Complement naive Bayes: the weight of a feature for a class is the negative log of its share in
all other classes.  The classes are the subjects and "nothing".  Training starts from labelled
documents and is refined by expectation-maximization: in a labelled document each sentence
belongs to one of the document's labels or to nothing, in any other to any class.  Every document
takes part in every round, and labelled ones once more with their labels.  The margins of the
labelled documents calibrate one monotone curve for each subject, which turns the largest margin
of a document's sentences into an independent posterior.

Features are words, pairs of neighbouring words, and the whole sentence, hashed to ``dimensions``
buckets, half of them for sentences, so that the many sentences do not crowd out the words.  The number is chosen from
the vocabulary of the corpus (within ``FEWEST`` and ``MOST``) unless it is given; so the model, and what a pass sends to
the driver, is bounded whatever the corpus.  Texts are cleaned and split once; the hashed words are written to the
checkpoint folder, and every pass works on these numbers.  A pass adds up expected counts inside each partition, and only
counts are shuffled.

Calibration is held out: labelled documents fall into ``FOLDS`` folds, and a document's margins come from weights
of counts without the labels of its fold, in which it counts like any document without labels.

What counts for nothing is taken away first (markup, names of quoted users, addresses,
signatures) or learned as the class "nothing" (greetings, figures of speech, advertising).

Defined results: null, empty and blank texts have no subject; a label of an unknown document or
an unknown subject is ignored; repeated labels count once; a null label says that there is no
subject; without any labels no document has a subject; documents keep their multiplicity.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.session import checkpointed, guarded_broadcast, stored

FEWEST, MOST = 1 << 19, 1 << 20  # buckets
BUCKETS_A_WORD = 64  # buckets for each word of the vocabulary, as it has many more pairs and sentences
FOLDS = 4
SMOOTHING = 0.1
PRIOR, SHARPNESS, DECISIVENESS = 0.3, 2.0, 4.0
LABEL_WEIGHT = 3.0
PRIOR_DOCUMENTS = 2.0
BINS, REACH = 120, 30.0  # of the calibration histogram: margins from -REACH to REACH

_LINE = re.compile(r"<br\s*/?>|</?(?:p|div|li|tr)\b[^<>]*>", re.I)
_WHO = re.compile(r"<cite>[^<>]{0,200}</cite>|\[quote[^\[\]]{0,200}\]", re.I)
_IMAGE = re.compile(r"\[(img|url)[^\[\]]{0,300}\][^\[\]]{0,500}\[/\1\]|(?:https?://|www\.)\S+", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,300}>|\[/?[a-zA-Z*][^\[\]\n]{0,100}\]")
_MARKS = re.compile(r"^[ \t]*(?:(?:>|\|)[ \t]?)+", re.M)
_WRITES = ("wrote", "writes", "schrieb", "a écrit", "escribió")
_WROTE = re.compile(rf"^.{{0,80}}\b(?:{'|'.join(_WRITES)})[ \t]*:[ \t]*$", re.M | re.I)
_SIGNED = re.compile(r"^(?:--|-- |—|_{3,})[ \t]*$", re.M)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
_WORD = re.compile(r"[^\W_]+", re.UNICODE)


def visible(text: str) -> str:
    """The text without markup, addresses, quoted names and signature."""
    # a pattern is only tried where a mark that it cannot do without is there
    tags, brackets, plain = "<" in text, "[" in text, text.lower()
    if tags:
        text = _LINE.sub("\n", text)
    if tags or brackets:
        text = _WHO.sub("\n", text)
    if brackets or "http" in plain or "www." in plain:
        text = _IMAGE.sub(" ", text)
    if tags or brackets:
        text = _TAG.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    if ">" in text or "|" in text:
        text = _MARKS.sub("", text)
    if ":" in text and any(w in text.lower() for w in _WRITES):
        text = _WROTE.sub("", text)
    signed = list(_SIGNED.finditer(text)) if "--" in text or "—" in text or "___" in text else []
    # a signature is the few short lines after the last mark
    if signed and len(text) - signed[-1].end() <= 300 and text[signed[-1].end() :].count("\n") <= 6:
        text = text[: signed[-1].start()]
    return text


def words_of(part: str) -> list[str]:
    """The words of a sentence, lower case, without accents, digits as 0."""
    plain = part.casefold()
    if not plain.isascii():
        plain = "".join(c for c in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(c))
    return ["0" if w.isdigit() else w for w in _WORD.findall(plain)]


def sentences(text: str | None) -> Iterator[list[str]]:
    """The words of each sentence that has any."""
    for part in _SENTENCE.split(visible(text)) if text else ():
        if words := words_of(part):
            yield words


class Reader:
    """Hashed words of sentences, with a bounded memory of those seen (posts quote each other)."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}
        self.known: dict[str, np.ndarray] = {}

    def word(self, word: str) -> int:
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) > 500_000:
                self.seen.clear()
            got = self.seen[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return got

    def sentence(self, part: str) -> np.ndarray:
        got = self.known.get(part)
        if got is None:
            got = np.array([self.word(w) for w in words_of(part)], np.uint32).view(np.int32)
            if len(part) <= 400:
                if len(self.known) >= 50_000:
                    self.known.clear()
                self.known[part] = got
        return got


def sentence_words(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>, words, sizes``: the hashed words of each document and how many each of its sentences has.

    Written once; all that follows reads these numbers and no text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            words, sizes, word_ends, size_ends, start = [], [], [0], [0], 0
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                for part in _SENTENCE.split(visible(text)) if text else ():
                    got = reader.sentence(part)
                    if len(got):
                        words.append(got)
                        sizes.append(len(got))
                word_ends.append(sum(sizes[size_ends[-1] :]) + word_ends[-1])
                size_ends.append(len(sizes))
                # long texts: several batches rather than one of unbounded size
                if word_ends[-1] >= 2_000_000 or i + 1 == batch.num_rows:
                    flat = np.concatenate(words) if words else np.zeros(0, np.int32)
                    columns = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(v, pa.int32())) for e, v in ((word_ends, flat), (size_ends, sizes))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, i + 1 - start), *columns], [key, "words", "sizes"])
                    words, sizes, word_ends, size_ends, start = [], [], [0], [0], i + 1

    kind = documents.schema[key].dataType.simpleString()
    return stored(documents.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {kind}, words array<int>, sizes array<int>"))


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def batch_features(batch: pa.RecordBatch, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat features; where each sentence starts in them; the row each sentence belongs to.

    A sentence of n words has n words, n - 1 pairs and itself.
    """
    words, sizes = batch.column(batch.schema.get_field_index("words")), batch.column(batch.schema.get_field_index("sizes"))
    owner = np.repeat(np.arange(batch.num_rows), np.diff(sizes.offsets.to_numpy()))
    word = words.flatten().to_numpy(zero_copy_only=False).view(np.uint32).astype(np.uint64)
    size = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(size) - size
    if not len(size):
        return np.zeros(0, np.int64), start, owner
    half = np.uint64(dimensions // 2 - 1)
    at, n = np.repeat(start, size), np.repeat(size, size)
    place = np.arange(len(word))
    flat = np.empty(2 * len(word), np.int64)
    flat[place + at] = _mixed(word) & half
    inner = np.flatnonzero(place - at < n - 1)
    flat[inner + at[inner] + n[inner]] = _mixed((word[inner] << np.uint64(32)) + word[inner + 1]) & half
    whole = np.add.reduceat(_mixed(word + ((place - at).astype(np.uint64) << np.uint64(32))), start)
    flat[2 * start + 2 * size - 1] = (_mixed(whole) & half) + half + np.uint64(1)
    return flat, 2 * start, owner


def _dimensions(words: DataFrame) -> int:
    """A power of two from the number of different words."""
    n = words.select(F.explode("words").alias("w")).agg(F.approx_count_distinct("w")).first()[0]
    return min(max(1 << (BUCKETS_A_WORD * n - 1).bit_length() if n else 0, FEWEST), MOST)


def weights(counts: np.ndarray, total: np.ndarray | None = None, features: int | None = None) -> np.ndarray:
    """Complement naive Bayes weights, features by classes.

    Each feature counts as far as it tells classes apart (1 - entropy of the class given the
    feature), so that the many words that every subject uses do not outvote the few that matter.
    ``total`` and ``features``, by default those of ``counts``, are given where ``counts`` are some of the rows.
    """
    total = counts.sum(0) if total is None else total
    features = len(counts) if features is None else features
    rest = counts.sum(1, keepdims=True) - counts
    share = (rest + SMOOTHING) / (total.sum() - total + SMOOTHING * features)
    w = -np.log(share)
    w -= w.mean(1, keepdims=True)
    prior = (total + 1) / (total + 1).sum()
    # counts by class as if all classes were of the same size
    level = counts / (prior * len(prior))
    given = (level + PRIOR / counts.shape[1]) / (level.sum(1, keepdims=True) + PRIOR)
    entropy = -(given * np.log(given)).sum(1, keepdims=True) / np.log(counts.shape[1])
    return (w * (1 - entropy) ** SHARPNESS).astype(np.float32)


class Counts:
    """Expected counts of the features that occur: ``rows`` by classes, the features' numbers in ``used``."""

    def __init__(self, used: np.ndarray, rows: np.ndarray, dimensions: int):
        order = np.argsort(used, kind="stable")
        self.used, self.rows, self.dimensions = used[order], rows[order], dimensions

    def weights(self, without: Counts | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The features and their weights, as they are sent; of all counts, or for the features of a part without that part."""
        if without is None:
            used, rows, total = self.used, self.rows, self.rows.sum(0)
        else:
            used, total = without.used, np.maximum(self.rows.sum(0) - without.rows.sum(0), 0)
            rows = np.maximum(self.rows[np.searchsorted(self.used, used)] - without.rows, 0)
        out = np.empty(rows.shape, np.float32)
        for a in range(0, len(rows), 50_000):
            out[a : a + 50_000] = weights(rows[a : a + 50_000], total, self.dimensions)
        return used.astype(np.int32), out


def sentence_scores(model: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``model`` is classes by features: one class at a time stays in the cache."""
    if not len(starts):
        return np.zeros((0, len(model)), np.float32)
    return np.stack([np.add.reduceat(weight.take(flat), starts) for weight in model], 1)


def posteriors(scores: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
    if allowed is not None:
        scores = np.where(allowed, scores, -np.inf)
    top = scores.max(1, keepdims=True)
    p = np.exp(np.clip(DECISIVENESS * (scores - top), -60, 0)) * (1 if allowed is None else allowed)
    return p / p.sum(1, keepdims=True)


def margins(scores: np.ndarray) -> np.ndarray:
    """How far each class is ahead of the best other class."""
    order = np.sort(scores, axis=1)
    best, second = order[:, -1:], order[:, -2:-1]
    return np.where(scores == best, best - second, scores - best)


def document_margins(model: np.ndarray, flat: np.ndarray, starts: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """For each text and subject the largest margin of its sentences, at least -REACH."""
    out = np.full((texts, len(model) - 1), -REACH, np.float32)
    if len(starts):
        got = margins(sentence_scores(model, flat, starts))[:, :-1]
        heads = np.flatnonzero(np.r_[True, np.diff(owner) != 0])
        out[owner[heads]] = np.clip(np.maximum.reduceat(got, heads, axis=0), -REACH, REACH)
    return out


def _unpacked(sent: tuple[np.ndarray, np.ndarray] | None, dimensions: int) -> np.ndarray | None:
    if sent is None:
        return None
    out = np.zeros((sent[1].shape[1], dimensions), np.float32)
    out[:, sent[0]] = sent[1].T
    return out


class SubjectModel:
    """Weights of features (for the subjects and, last, "nothing"), the subjects, and a curve for each."""

    def __init__(self, subjects: list[str], dimensions: int, weight: tuple[np.ndarray, np.ndarray], curves: np.ndarray | None = None):
        self.subjects, self.dimensions, self.weight, self.curves = subjects, dimensions, weight, curves


def _expected_counts(docs: DataFrame, classes: int, dimensions: int, model: tuple[np.ndarray, np.ndarray] | None, labels: bool = True) -> Counts:
    """One pass over ``words, sizes, mask``: expected counts.

    ``mask`` has the allowed classes as bits; such documents count ``LABEL_WEIGHT`` times.  Without ``labels``
    each document counts once with all classes allowed.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = _unpacked(sent.value, dimensions), None
        for batch in batches:
            flat, starts, owner = batch_features(batch, dimensions)
            if not len(starts):
                continue
            if labels:
                bits = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)[owner]
                allowed = (bits[:, None] >> np.arange(classes)) & 1 > 0
            if weight is not None:
                p = posteriors(sentence_scores(weight, flat, starts), allowed if labels else None)
            else:
                # to begin with, a sentence belongs to the labels of its document in equal parts
                p = np.concatenate([allowed[:, :-1], ~allowed[:, :-1].any(1, keepdims=True)], 1).astype(np.float64)
                p /= p.sum(1, keepdims=True)
            if total is None:
                total = np.zeros((classes, dimensions))
            sizes = np.diff(np.r_[starts, len(flat)])
            for k in range(classes):
                total[k] += np.bincount(flat, np.repeat(p[:, k] * (LABEL_WEIGHT if labels else 1.0), sizes), dimensions)
        if total is not None:
            used = np.flatnonzero(total.any(0))
            for a in range(0, len(used), 20_000):
                rows = used[a : a + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), *[pa.array(total[k, rows]) for k in range(classes)]], ["feature", *[f"c{k}" for k in range(classes)]])

    parts = docs.select("words", "sizes", "mask").mapInArrow(run, "feature int, " + ", ".join(f"c{k} double" for k in range(classes)))
    table = parts.groupBy("feature").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(classes)]).toArrow()  # at most MOST rows
    sent.destroy()
    return Counts(table["feature"].to_numpy(), np.stack([table[f"c{k}"].to_numpy() for k in range(classes)], 1), dimensions)


def _together(parts: list[Counts], dimensions: int, classes: int) -> Counts:
    total = np.zeros((dimensions, classes))
    for c in parts:
        total[c.used] += c.rows
    used = np.flatnonzero(total.any(1))
    return Counts(used, total[used], dimensions)


def _masks(labels: DataFrame, subjects: list[str], key: str) -> DataFrame:
    """The labels of each document as bits (the last bit: nothing, always allowed), and its fold."""
    bit = F.lit(0).cast("bigint")
    for i, subject in enumerate(subjects):
        bit = F.when(F.col("subject") == subject, F.lit(1 << i).cast("bigint")).otherwise(bit)
    known = labels.where(F.col(key).isNotNull() & (F.col("subject").isNull() | F.col("subject").isin(*subjects)))
    masks = known.groupBy(F.col(key).alias("label_key")).agg(F.bit_or(bit).alias("mask"))
    return masks.select("label_key", F.col("mask").bitwiseOR(F.lit(1 << len(subjects)).cast("bigint")).alias("mask"), F.pmod(F.xxhash64("label_key"), F.lit(FOLDS)).cast("int").alias("fold"))


def _calibrate(labelled: DataFrame, subjects: list[str], dimensions: int, counts: Counts, folds: list[Counts]) -> np.ndarray:
    """A curve for each subject, from histograms of the labelled documents' margins under the weights without the labels of their fold."""
    n = len(subjects)
    hist = np.zeros((n, BINS, 2))
    for f, own in enumerate(folds):
        sent = labelled.sparkSession.sparkContext.broadcast(counts.weights(own))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            weight = _unpacked(sent.value, dimensions)
            hist = np.zeros((n, BINS, 2), np.int64)
            for batch in batches:
                got = document_margins(weight, *batch_features(batch, dimensions), batch.num_rows)
                bits = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                at = _bins(got)
                for k in range(n):
                    np.add.at(hist[k], (at[:, k], (bits >> k) & 1), 1)
            k, b, y = np.nonzero(hist)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(b), pa.array(y), pa.array(hist[k, b, y])], ["k", "b", "y", "n"])

        mine = labelled.where(F.col("fold") == f).select("words", "sizes", "mask")
        # at most BINS rows for each subject and answer
        for r in mine.mapInArrow(run, "k bigint, b bigint, y bigint, n bigint").groupBy("k", "b", "y").agg(F.sum("n").alias("n")).collect():
            hist[r["k"], r["b"], r["y"]] += r["n"]
        sent.destroy()
    return np.stack([_curve(h) for h in hist])


def _bins(margin: np.ndarray) -> np.ndarray:
    return np.clip(((margin + REACH) / (2 * REACH) * BINS).astype(int), 0, BINS - 1)


def _curve(h: np.ndarray) -> np.ndarray:
    """The posterior of each bin of margins: an isotonic fit without the labels' noise.

    Some labels are wrong however clear the text is; their shares show at both ends of the margins
    and are taken out, so that the middle of the curve stays where texts turn doubtful.  A weak
    prior (a few documents a bin) fills bins that no labelled document falls into.
    """
    x = (np.arange(BINS) + 0.5) / BINS * 2 * REACH - REACH
    n = h.sum(1)
    ends = [x <= -REACH / 3, x >= REACH / 3]
    low, high = (h[e, 1].sum() / n[e].sum() if n[e].sum() else d for e, d in zip(ends, (0.0, 1.0)))
    yes = np.clip((h[:, 1] - low * n) / (high - low), 0, n) if high - low > 0.5 else h[:, 1]
    prior = 1 / (1 + np.exp(-(x - 1.5)))
    return _isotonic((yes + PRIOR_DOCUMENTS * prior) / (n + PRIOR_DOCUMENTS), n + PRIOR_DOCUMENTS)


def _isotonic(share: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The closest rising sequence: neighbours that fall are pooled."""
    pools: list[list[float]] = []
    for s, w in zip(share, weight):
        pools.append([s, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(k), s) for s, _, k in pools])


def _read(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``documents`` may be texts, or what ``sentence_words`` made of them."""
    return documents if {"words", "sizes"} <= set(documents.columns) else sentence_words(documents, key, text)


def train(documents: DataFrame, labels: DataFrame, subjects: list[str], key: str = "doc_id", text: str = "text", rounds: int = 2, dimensions: int | None = None) -> SubjectModel:
    """Fit weights and curves; ``rounds`` passes (at least one) of expectation-maximization over all documents.

    ``dimensions``: the number of feature buckets, a power of two; by default it follows from the vocabulary.
    """
    subjects = sorted({s for s in subjects if s is not None})
    classes = len(subjects) + 1
    words = _read(documents, key, text)
    dimensions = dimensions or _dimensions(words)
    if dimensions < 2 or dimensions & (dimensions - 1):
        raise ValueError("dimensions must be a power of two")
    masks = guarded_broadcast(checkpointed(_masks(labels, subjects, key)))
    docs = words.join(masks, F.col(key) == F.col("label_key"), "left").select("words", "sizes", "mask", "fold")
    labelled = checkpointed(docs.where(F.col("mask").isNotNull()))
    counts = _expected_counts(labelled, classes, dimensions, None)
    if not len(counts.used):
        return SubjectModel(subjects, dimensions, (np.zeros(0, np.int32), np.zeros((0, classes), np.float32)))
    # first among the labelled documents alone, to tell their subjects from nothing
    for _ in range(2):
        counts = _expected_counts(labelled, classes, dimensions, counts.weights())
    folds: list[Counts] = []
    for i in range(rounds):
        model = counts.weights()
        parts = [labelled] if i + 1 < rounds else [labelled.where(F.col("fold") == f) for f in range(FOLDS)]
        folds = [_expected_counts(part, classes, dimensions, model) for part in parts]
        counts = _together([_expected_counts(docs, classes, dimensions, model, labels=False), *folds], dimensions, classes)
    curves = _calibrate(labelled, subjects, dimensions, counts, folds)
    return SubjectModel(subjects, dimensions, counts.weights(), curves)


def subject_posteriors(documents: DataFrame, model: SubjectModel, key: str = "doc_id", text: str = "text", least: float = 0.9) -> DataFrame:
    """``<key>, subject, posterior`` for every subject whose posterior is at least ``least``."""
    sent = documents.sparkSession.sparkContext.broadcast((model.subjects, model.dimensions, model.weight, model.curves))
    documents = _read(documents, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subjects, dimensions, weight, curves = sent.value
        weight = _unpacked(weight, dimensions)
        for batch in batches:
            if curves is None:
                continue
            got = document_margins(weight, *batch_features(batch, dimensions), batch.num_rows)
            p = curves[np.arange(len(subjects))[None, :], _bins(got)]
            p[got <= -REACH] = 0
            row, k = np.nonzero(p >= max(least, 1e-12))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array([subjects[i] for i in k], pa.string()), pa.array(p[row, k].astype(np.float64))],
                [key, "subject", "posterior"],
            )

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, "words", "sizes").mapInArrow(run, f"{key} {kind}, subject string, posterior double")

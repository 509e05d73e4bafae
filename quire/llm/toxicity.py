"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words and word beginnings is learned from one half of the labelled rows by smoothed log-odds, and every
text is described by lexicon densities, how near hits stand to the second person, capitals, punctuation and
obfuscation. Trees are fitted on the other half. The calibration is cross-fitted: each quarter of that half is judged by
trees of the other three quarters, and one isotonic map is fitted to all these margins. All this is the same at every
size. Labelled rows are taken up to a stated number in the order of a hash; all texts are scored whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .shared import Workspace, giving_back

FIT_ROWS = 20_000
"""The most labelled rows that a classifier is fitted on."""
FOLDS = 4
"""Of how many parts the calibration is cross-fitted."""
# Insults known from the start, second-person words, and look-alikes of letters.
SEED = "idiot moron stupid loser pathetic worthless trash scum clown disgusting dumb garbage ugly fool jerk filth vermin".split()
YOU = set("you your yours yourself u ur ya du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos ti tú tus usted ustedes vosotros".split())
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": None, "_": None, "-": None, ".": None})
BEGINNINGS = (4, 5, 6)
_EDGE = "\"'()[]{}<>.,;:!?¡¿«»…*_-"
_LONG = re.compile(r"(\w)\1\1")
_MIXED = re.compile(r"[^\W\d_][\d@$!|*_.]+[^\W\d_]|[\d@$|]+[^\W\d_]{2}")
_CAPS = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _CAPS | ((np.arange(256) >= 97) & (np.arange(256) <= 122))


def forms(word: str) -> tuple[str, str]:
    """A word in lower case without edge punctuation, and with look-alikes replaced if letters are mixed with signs."""
    core = word.strip(_EDGE).lower()
    return core, core.translate(LEET) if _MIXED.search(word) else core


def entries(core: str) -> list[str]:
    """What a word is looked up as: itself, and its beginnings (marked by a final ``+``)."""
    return [core, *[core[:n] + "+" for n in BEGINNINGS if len(core) > n]] if len(core) > 2 else []


class Words:
    """Weights and flags of distinct words, remembered in this process up to ``most``."""

    def __init__(self, lexicon: dict[str, float], most: int = 1_000_000):
        self.lexicon, self.most = lexicon, most
        self.hashes, self.weight, self.flags = np.empty(0, np.uint64), np.empty(0), np.empty(0, np.uint8)

    def describe(self, word: str) -> tuple[float, int]:
        core, plain = forms(word)
        hit = max((self.lexicon.get(x, 0.0) for x in entries(core)), default=0.0)
        flags = 0
        if plain != core:
            flags |= 1
            other = max((self.lexicon.get(x, 0.0) for x in entries(plain)), default=0.0)
            if other > hit:
                hit, flags = other, flags | 2
        if core in YOU:
            flags |= 4
        if len(word) > 2 and word.isupper():
            flags |= 8
        if _LONG.search(core):
            flags |= 16
        if plain in _SEEDS:
            flags |= 32
        return hit, flags

    def __call__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distinct, where, back = np.unique(kernel.span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        row = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        new = self.hashes[row] != distinct if len(self.hashes) else np.ones(len(distinct), bool)
        hashes, weight, flags = self.hashes, self.weight, self.flags
        if new.any():
            raw = buf.tobytes()
            found = [self.describe(raw[a:b].decode("utf-8")) for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)]
            hashes = np.concatenate([hashes, distinct[new]])
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            weight = np.concatenate([weight, np.array([w for w, _ in found])])[order]
            flags = np.concatenate([flags, np.array([f for _, f in found], np.uint8)])[order]
            if len(hashes) <= self.most:
                self.hashes, self.weight, self.flags = hashes, weight, flags
        at = np.searchsorted(hashes, distinct)[back]
        return weight[at], flags[at]


_SEEDS = set(SEED)
FEATURES = ["weight_rate", "top_weight", "hit_rate", "hits", "strong", "seed_rate", "near_rate", "near", "capitals", "shouted", "exclamations", "questions", "mixed", "unmasked", "elongated", "words"]


def features(words: Words, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    starts, ends, first = kernel.word_bounds(buf, offsets)
    n = len(offsets) - 1
    weight, flags = words(buf, starts, ends) if len(starts) else (np.empty(0), np.empty(0, np.uint8))

    def per_doc(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return total[at[1:]] - total[at[:-1]]

    hit = weight > 1
    # Hits with a second person within five words in the same text.
    doc = np.repeat(np.arange(n), np.diff(first))
    you = np.flatnonzero(flags & 4)
    near = np.zeros(len(weight))
    h = np.flatnonzero(hit)
    if len(you) and len(h):
        after = np.searchsorted(you, h)
        for k in (np.maximum(after - 1, 0), np.minimum(after, len(you) - 1)):
            near[h] = np.maximum(near[h], (np.abs(you[k] - h) <= 5) & (doc[you[k]] == doc[h]))
    size = np.maximum(np.diff(first), 1).astype(float)
    chars = np.maximum(np.diff(offsets), 1).astype(float)
    letters = np.maximum(per_doc(_LETTER[buf], offsets), 1)
    top = np.zeros(n)
    np.maximum.at(top, doc, weight)
    return np.stack(
        [
            per_doc(np.where(hit, weight, 0), first) / size, top, per_doc(hit, first) / size, np.log1p(per_doc(hit, first)), np.log1p(per_doc(weight > 2, first)),
            per_doc(flags & 32 > 0, first) / size, per_doc(near, first) / size, np.log1p(per_doc(near, first)),
            per_doc(_CAPS[buf], offsets) / letters, per_doc(flags & 8 > 0, first) / size, per_doc(buf == 33, offsets) / chars, per_doc(buf == 63, offsets) / chars,
            per_doc(flags & 1 > 0, first) / size, per_doc(flags & 2 > 0, first) / size, per_doc(flags & 16 > 0, first) / size, np.log1p(np.diff(first)),
        ],
        1,
    )


@dataclass
class Trees:
    """Boosted trees for the logistic loss over binned features; a tree is arrays of feature, bin, children and value."""

    edges: list[np.ndarray]
    start: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], 1)
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
            out += value[node]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, smooth: float = 1.0, least: float = 1.0) -> Trees:
    """Newton boosting with histograms; a node that gains nothing sends all rows to its left child."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    rate_of = min(max(y.mean(), 1e-3), 1 - 1e-3)
    out = Trees(edges, float(np.log(rate_of / (1 - rate_of))), [], depth)
    margin = np.full(len(y), out.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, 10**6)
        value, node = np.zeros(2 ** (depth + 1) - 1), np.zeros(len(y), np.int64)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == k)
                best = 1e-6
                if len(rows) > 1:
                    total_g, total_h = g[rows].sum(), h[rows].sum()
                    whole = total_g**2 / (total_h + smooth)
                    for f in range(x.shape[1]):
                        a = np.cumsum(np.bincount(binned[rows, f], g[rows], bins))[:-1]
                        b = np.cumsum(np.bincount(binned[rows, f], h[rows], bins))[:-1]
                        gain = a**2 / (b + smooth) + (total_g - a) ** 2 / (total_h - b + smooth) - whole
                        gain[(b < least) | (total_h - b < least)] = -1
                        c = int(np.argmax(gain))
                        if gain[c] > best:
                            best, feature[k], cut[k] = gain[c], f, c
                node[rows] = 2 * k + 1 + (binned[rows, feature[k]] > cut[k])
        for k in range(2**depth - 1, 2 ** (depth + 1) - 1):
            rows = node == k
            if rows.any():
                value[k] = -rate * g[rows].sum() / (h[rows].sum() + smooth)
        out.trees.append((feature, cut, value))
        margin += value[node]
    return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: margins and the non-decreasing rates between which a score is interpolated."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of margins, of labels, count
    for m, t in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([m, t, 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


@dataclass
class Classifier:
    """Lexicon, trees and isotonic map; without trees every score is the share of toxic rows."""

    lexicon: dict[str, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated rates."""
        if self.trees is None:
            return np.full(len(x), self.prior)
        return np.clip(np.interp(self.trees.margin(x), *self.knots), 0, 1)


def labelled(docs: DataFrame, labels: DataFrame, fold: int, folds: int, most: int) -> DataFrame:
    """text, toxic and part (0 to 7, by hash) of up to ``most`` labelled rows of ``docs`` outside the fold: those whose doc_id
    has the least hashes. A doc_id labelled more than once counts as toxic if one label says so."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    known = labels.where("doc_id is not null and toxic is not null").where(F.crc32(name.cast("binary")) % folds != fold).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    # Labels of other documents must not take places.
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "doc_id", "left_semi")
    chosen = known.withColumn("order", F.xxhash64("doc_id", F.lit("fit"))).orderBy("order", "doc_id").limit(most).select("doc_id", "toxic", F.pmod("order", F.lit(2 * FOLDS)).cast("int").alias("part"))
    # At most ``most`` rows are broadcast.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic", "part")


_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _signed(batches):
    """Adds a sign that near copies share: a text's least run of five words."""
    for batch in batches:
        words = [_WORDS.findall(t) for t in batch.column(0).to_pylist()]
        signs = [" ".join(min((w[i : i + 5] for i in range(max(1, len(w) - 4))), default=[])) for w in words]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signs)], names=["text", "toxic", "sign"])


def _count_entries(only: frozenset | None):
    """Documents that hold an entry; "" counts all."""

    def run(batches):
        for batch in batches:
            totals: dict[str, int] = {"": 0}
            for text in batch.column(0).to_pylist():
                found = {e for w in set(_WORDS.findall(text)) for e in entries(forms(w)[1])}
                for e in found if only is None else found & only:
                    totals[e] = totals.get(e, 0) + 1
                totals[""] += 1
            yield pa.RecordBatch.from_pydict({"entry": list(totals), "n": list(totals.values())}, pa.schema([("entry", pa.string()), ("n", pa.int64())]))

    return run


def learn_lexicon(rows: DataFrame, least: int = 4) -> dict[str, float]:
    """Entries of at least ``least`` toxic texts whose log-odds of standing in a toxic text are above 1 even at the lower end
    of their error. Near copies with one label count once. What reaches the driver is bounded by the sample of rows."""
    schema = "entry string, n long"
    signed = rows.select("text", "toxic").mapInArrow(_signed, "text string, toxic int, sign string").groupBy("sign", "toxic").agg(F.min("text").alias("text"))
    toxic = {r.entry: r.n for r in signed.where("toxic = 1").select("text").mapInArrow(_count_entries(None), schema).groupBy("entry").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()}
    if not toxic:
        return dict.fromkeys(SEED, 3.0)
    clean = {r.entry: r.n for r in signed.where("toxic = 0").select("text").mapInArrow(_count_entries(frozenset(toxic)), schema).groupBy("entry").agg(F.sum("n").alias("n")).collect()}
    n_toxic, n_clean = toxic.pop("", 0), clean.get("", 0)
    found = {}
    for e, t in toxic.items():
        c = clean.get(e, 0)
        odds = np.log((t + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1))
        low = float(odds - 1.64 * np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)))
        if low > 1:
            found[e] = low
    return dict.fromkeys(SEED, 2.0) | found


def _describe(lexicon: dict[str, float]):
    def run(batches):
        words = Words(lexicon)
        for batch in batches:
            buf, offsets = kernel.strings(batch.column(0))
            for i, j in kernel.slices(offsets):
                x = features(words, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(list(x), pa.list_(pa.float64()))], names=["toxic", "part", "x"])

    return run


def calibrated(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[Trees, tuple[np.ndarray, np.ndarray]]:
    """Trees of all rows, and an isotonic map of the margins that each fold gets from trees of the other folds. Without
    other folds of both labels a fold gets the log-odds of the rest."""
    margin = np.zeros(len(y))
    for f in np.unique(fold):
        own = fold == f
        if 0 < y[~own].sum() < (~own).sum():
            margin[own] = fit_trees(x[~own], y[~own]).margin(x[own])
        else:
            rate = min(max(y[~own].mean() if (~own).any() else 0.5, 1e-3), 1 - 1e-3)
            margin[own] = np.log(rate / (1 - rate))
    return fit_trees(x, y), isotonic(margin, y)


def fit(docs: DataFrame, labels: DataFrame, fold: int = 1, folds: int = 3, most: int = FIT_ROWS) -> Classifier:
    """Fit on up to ``most`` labelled rows outside the fold: the lexicon on a half of them, the trees and their calibration on
    the other half. Where that half lacks a label, every score is the share of toxic rows (0 without any rows)."""
    keep = Workspace(docs.sparkSession)
    rows = keep.save(labelled(docs, labels, fold, folds, most), "labelled")
    n, toxic = rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    prior = float(toxic or 0) / n if n else 0.0
    if not n or not 0 < toxic < n:
        return Classifier({}, None, None, prior)
    lexicon = learn_lexicon(rows.where(F.col("part") < FOLDS))
    got = rows.where(F.col("part") >= FOLDS).select("text", "toxic", "part").mapInArrow(giving_back(_describe(lexicon)), "toxic int, part int, x array<double>").toArrow()
    keep.drop(rows)
    x, y, part = np.array(got.column("x").to_pylist()).reshape(-1, len(FEATURES)), got.column("toxic").to_numpy().astype(float), got.column("part").to_numpy()
    if not 0 < y.sum() < len(y):
        return Classifier(lexicon, None, None, prior)
    order = np.lexsort(np.column_stack([x, y, part]).T[::-1])
    trees, knots = calibrated(x[order], y[order], part[order])
    return Classifier(lexicon, trees, knots, prior)


def _scoring(model: Classifier, text: int):
    """Append ``toxicity`` to batches whose column ``text`` has the texts."""

    def run(batches):
        words = Words(model.lexicon)
        for batch in batches:
            buf, offsets = kernel.strings(batch.column(text))
            for i, j in kernel.slices(offsets):
                x = features(words, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(x))], names=[*part.schema.names, "toxicity"])

    return run


def score(docs: DataFrame, labels: DataFrame, fold: int = 1, folds: int = 3, threshold: float = 0.7, most: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text). Null and empty texts are scored as
    texts without words; null and repeated doc_ids are kept; a null doc_id counts as an empty name for the fold; an empty
    table gives no rows. Labels without a doc_id, a label or a document take no part."""
    model = fit(docs, labels, fold, folds, most)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.crc32(name.cast("binary")) % folds == fold).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = "doc_id long, held_out boolean, text string, toxicity double"
    out = rows.mapInArrow(giving_back(_scoring(model, 2)), schema)
    return out.select("doc_id", "held_out", F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, each judged for itself, with their columns as they are; null and
    empty texts as in score(). They are written here, as batches of whole rows are held small only while that is done."""
    keep = Workspace(docs.sparkSession)
    model = fit(docs, labels)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    run = _scoring(model, 1)

    def passing(batches):
        for batch in run(batches):
            kept = batch.filter(pa.array(batch.column(2).to_numpy() < threshold))
            yield pa.RecordBatch.from_arrays([kept.column(0)], names=["_row"])

    return keep.save(rows.mapInArrow(giving_back(passing), rows.select("_row").schema).select("_row.*"), "clean")

"""Toxicity by boosted trees over dense features, with isotonic calibration.

Features: densities of two lexicons (a short fixed list of insults, and words that the labelled sample
shows to go with toxic texts) in plain words and in words with disguises undone, how near
second-person words are, capitals, punctuation, and rates of disguised words. The sample is
bounded; every whole text is scored. Null, empty and blank texts have features of zero and
a score like any other; rows are kept one by one, whatever their id; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.boosting import BoostParams, Isotonic, Trees, fit_isotonic, fit_trees
from ledgerscope.llm.labelled import features_of, labelled_sample, scored
from ledgerscope.llm.text_bytes import (
    LOWER,
    U64,
    Texts,
    Words,
    by_block,
    byte_class,
    hash_text,
    split,
    sums_by_text,
    texts_of,
)

# Common insults, and words that address the reader in the four languages.
INSULTS = (
    "idiot idiots moron stupid dumb worthless pathetic disgusting loser clown trash garbage scum jerk "
    "fool imbecile hate ugly vermin freak idiota imbécil estúpido asqueroso basura dumm dummkopf "
    "trottel abschaum ekelhaft widerlich crétin débile ordure pourriture"
).split()
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous "
    "votre vos tú usted ustedes vosotros"
).split()
# Characters that stand for letters in disguised words.
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

LETTER = byte_class((65, 90), (97, 122), (128, 255))
NOT_BLANK = byte_class((0x00, 0x08), (0x0E, 0x1F), (0x21, 0xFF))
UPPER = byte_class((65, 90))
MARKS = {
    "bang": byte_class((33, 33)),
    "question": byte_class((63, 63)),
    "stop": byte_class((46, 46)),
    "comma": byte_class((44, 44)),
    "symbol": byte_class((35, 38), (42, 43), (60, 62), (64, 64), (94, 96), (124, 126)),
    "digit": byte_class((48, 57)),
}
_UNMASKED = LOWER.copy()
for _mark, _letter in DISGUISES.items():
    _UNMASKED[ord(_mark)] = ord(_letter)
# Between the letters of a disguised word: anything that is neither a blank, a letter nor a disguise.
_FILLER = NOT_BLANK & ~LETTER
for _mark in DISGUISES:
    _FILLER[ord(_mark)] = False


@dataclass(frozen=True)
class ToxicityParams:
    sample_rows: int = 20_000  # bound of the labelled sample that is fitted
    folds: int = 5  # rows whose crc32 leaves 0 are held out
    threshold: float = 0.5
    near: int = 5  # words between a second-person word and a lexicon word
    lexicon_words: int = 200
    lexicon_texts: int = 5  # sampled texts that a learned word must be in
    lexicon_odds: float = 2.0  # log odds against the share of toxic texts
    boost: BoostParams = field(default_factory=lambda: BoostParams(trees=60, depth=3))


def _unmasked(texts: Texts) -> Words:
    """Words between blanks with disguises undone, fillers left out and spelled-out words put together."""
    texts = _kept(Texts(_UNMASKED[texts.data], texts.offsets), ~_FILLER[texts.data])
    words = Words(texts, NOT_BLANK)
    spelled = _spelled_out(words)
    gap = np.flatnonzero(spelled[:-1] & spelled[1:] & (words.starts[1:] - words.ends[:-1] == 1))
    gap = gap[words.owners()[gap] == words.owners()[gap + 1]]
    if not len(gap):
        return words
    keep = np.ones(len(texts.data), dtype=bool)
    keep[words.ends[gap]] = False
    return Words(_kept(texts, keep), NOT_BLANK)


def _kept(texts: Texts, keep: np.ndarray) -> Texts:
    """The texts without some of their bytes."""
    return Texts(texts.data[keep], np.concatenate([[0], np.cumsum(keep)])[texts.offsets])


def _spelled_out(words: Words) -> np.ndarray:
    """Whether each word is one letter in a run of three or more such words."""
    one = (words.ends - words.starts == 1) & np.concatenate([[True], words.owners()[1:] == words.owners()[:-1]])[: len(words)]
    padded = np.concatenate([[False, False], one, [False, False]])
    run = padded[:-2] & padded[1:-1] & padded[2:]
    return (run[:-2] | run[1:-1] | run[2:])[: len(words)] if len(words) else one


def _contains(sorted_hashes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(sorted_hashes) or not len(hashes):
        return np.zeros(len(hashes), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_hashes, hashes), len(sorted_hashes) - 1)
    return sorted_hashes[at] == hashes


def _hashes(words: list[str]) -> np.ndarray:
    return np.array(sorted({hash_text(w) for w in words}), dtype=U64)


_INSULTS, _SECOND = _hashes(INSULTS), _hashes(SECOND_PERSON)


@dataclass(frozen=True)
class Lexicon:
    """Hashes of learned words with their log odds, sorted by hash."""

    words: np.ndarray
    odds: np.ndarray


def _near(marked: np.ndarray, others: np.ndarray, owners: np.ndarray, reach: int) -> np.ndarray:
    """For each place in ``marked``, whether one of ``others`` lies within ``reach`` words in the same text."""
    out = np.zeros(len(marked), dtype=bool)
    if not len(others):
        return out
    for side in (-1, 0):
        at = np.clip(np.searchsorted(others, marked) + side, 0, len(others) - 1)
        other = others[at]
        out |= (np.abs(other - marked) <= reach) & (owners[other] == owners[marked])
    return out


def features(column: pa.Array, lexicon: Lexicon, params: ToxicityParams) -> np.ndarray:
    """One row of features per text."""
    texts = texts_of(column)
    n = len(texts)
    size = np.maximum(np.diff(texts.offsets), 1)
    plain = Words(texts.lowered(), LETTER)
    hashes, owners = plain.hashes(), plain.owners()
    count = np.maximum(plain.counts, 1)
    open_words = _unmasked(texts)
    open_hashes, open_owners = open_words.hashes(), open_words.owners()
    views = []
    for words, found, who in ((plain, hashes, owners), (open_words, open_hashes, open_owners)):
        each = np.maximum(words.counts, 1)
        insult, learned = _contains(_INSULTS, found), _contains(lexicon.words, found)
        places = np.flatnonzero(learned)
        odds = lexicon.odds[np.searchsorted(lexicon.words, found[places])] if len(places) else np.zeros(0)
        total = np.bincount(who[places], weights=odds, minlength=n)
        n_insult, n_learned = sums_by_text(insult, words.first), sums_by_text(learned, words.first)
        both = np.flatnonzero(insult | learned)
        second = np.flatnonzero(_contains(_SECOND, found))
        close = _near(both, second, who, params.near)
        views.append(
            [
                n_insult, n_insult / each, n_learned, n_learned / each, total, total / np.maximum(n_learned, 1),
                np.bincount(who[both[close]], minlength=n), np.bincount(who[second], minlength=n) / each,
            ]
        )
    # The larger of both views, so that a disguised word counts as the plain one does in the sample.
    columns = [np.log1p(plain.counts), *(np.maximum(a, b) for a, b in zip(*views, strict=True))]
    columns += [sums_by_text(UPPER[texts.data], texts.offsets) / size]
    columns += [sums_by_text(table[texts.data], texts.offsets) / size for table in MARKS.values()]
    raw = Words(texts, NOT_BLANK)
    each = np.maximum(raw.counts, 1)
    letters = np.concatenate([[0], np.cumsum(LETTER[texts.data])])
    uppers = np.concatenate([[0], np.cumsum(UPPER[texts.data])])
    length = raw.ends - raw.starts
    inside = length - (letters[raw.ends] - letters[raw.starts])
    inner = inside - (~LETTER[texts.data[raw.starts]]).astype(int) - (~LETTER[texts.data[raw.ends - 1]]).astype(int)
    shouted = (uppers[raw.ends] - uppers[raw.starts] >= 2) & (2 * (uppers[raw.ends] - uppers[raw.starts]) > length)
    columns += [
        sums_by_text(shouted, raw.first) / each,
        sums_by_text((inner > 0) & (inside < length), raw.first) / each,
        np.maximum(views[1][0] - views[0][0], 0) + np.maximum(views[1][2] - views[0][2], 0),
        plain.counts / size,
    ]
    return np.stack([np.asarray(c, dtype=float) for c in columns], axis=1) if count.size else np.zeros((0, len(columns)))


def learn_lexicon(sample: DataFrame, params: ToxicityParams) -> Lexicon:
    """Words of the sample that toxic texts have far more often; counted by text, at most
    ``lexicon_words`` of the highest log odds."""

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(block.column("text"))
        label = block.column("label").to_numpy()
        found, toxic = [], []
        both = [(w.hashes(), w.owners()) for w in (Words(texts.lowered(), LETTER), _unmasked(texts))]
        hashes = np.concatenate([h for h, _ in both])
        owners = np.concatenate([o for _, o in both])
        order = np.lexsort((hashes, owners))
        hashes, owners = hashes[order], owners[order]
        first = np.ones(len(hashes), dtype=bool)
        first[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
        found, place = np.unique(hashes[first], return_inverse=True)
        marks = label[owners[first]]
        toxic = np.bincount(place, weights=marks, minlength=len(found)).astype(np.int64)
        texts_with = np.bincount(place, minlength=len(found)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(found.view(np.int64)), pa.array(toxic), pa.array(texts_with)], ["word", "toxic", "n"]
        )

    totals = sample.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    base = np.log(((totals["toxic"] or 0) + 1) / (totals["n"] - (totals["toxic"] or 0) + 1))
    odds = F.log((F.col("toxic") + 0.5) / (F.col("n") - F.col("toxic") + 0.5)) - float(base)
    rows = (
        sample.mapInArrow(by_block("text", work), "word long, toxic long, n long")
        .groupBy("word")
        .agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
        .where(F.col("n") >= params.lexicon_texts)
        .select("word", odds.alias("odds"))
        .where(F.col("odds") >= params.lexicon_odds)
        .orderBy(F.desc("odds"), "word")
        .limit(params.lexicon_words)
        .collect()
    )
    words = np.array([r["word"] for r in rows], dtype=np.int64).view(U64)
    order = np.argsort(words)
    return Lexicon(words[order], np.array([r["odds"] for r in rows], dtype=float)[order])


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    trees: Trees
    calibration: Isotonic

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.calibration(self.trees.score(x))


def fit_toxicity(docs: DataFrame, labels: DataFrame, params: ToxicityParams) -> Model:
    """Lexicon and trees from four fifths of the sample; the lexicon's own fifth of calibration is left out."""
    learn = (split("doc_id") % params.folds) != 0
    sample = labelled_sample(docs, labels, "toxic", learn, params.sample_rows)
    grow = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5)) != 0
    lexicon = learn_lexicon(sample.where(grow), params)
    marked = sample.select("doc_id", "text", "label", grow.alias("grow"))
    parts = []
    for part in (marked.where("grow"), marked.where("not grow")):
        x, y, _ = features_of(part, lambda column: features(column, lexicon, params))
        parts.append((x, y))
    trees = fit_trees(*parts[0], params.boost)
    return Model(lexicon, trees, fit_isotonic(trees.score(parts[1][0]), parts[1][1]))


def toxicity(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit_toxicity(docs, labels, params)
    return scored(docs, lambda column: features(column, model.lexicon, params), model).select(
        "doc_id",
        (split("doc_id") % params.folds == 0).alias("held_out"),
        "score",
        (F.col("score") >= params.threshold).cast("int").alias("predicted"),
    )

"""Toxicity by compression distance.

Zstandard dictionaries are trained on the text of labelled documents: `parts` of them on toxic and as many on ordinary texts, each on its own share of the
documents. A window is one word with its borders (long words are cut), repeated to FRAME bytes: zstandard stores what it can't shrink, and a
repetition shrinks always, so that the length tells what the first occurrence costs. A window's distances set its compressed lengths under the ordinary
dictionaries against those under the toxic ones: the least ordinary one less the greatest toxic one (what all toxic dictionaries know and no
ordinary one does; a word that one dictionary holds by chance doesn't count), less the median toxic one, and mean less mean. A text is described by the distribution of each
distance over its distinct windows: the largest, how many reach 2, 4 and 6 bytes, the mean and the 95 % quantile. A logistic
curve over these, fitted on other labelled texts than the dictionaries, turns them into a score, whose threshold is calibrated: of those ordinary texts, at most
`false_share` may score LEVEL or more.

Learning reads labels of at most about `sample` texts of each class, drawn by a hash of doc_id, and of these at most `most_bytes` for a dictionary; labels of
one document that disagree count as toxic. Dictionaries are trained on executors. Scores read whole texts and nothing else.

Defined results: a null or wordless text has no windows and gets the score of that; where no toxic or no ordinary
labels exist all scores are 0; equal rows, and texts of the same words, get equal scores; an empty table gives an empty result; a very long
text is cut into its distinct words, a megabyte at a time, whose distances are remembered; further columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldloom.llm.common import pieces, stored

LONGEST = 32
FRAME = 40
STEPS = (2, 4, 6)
EDGE = b".,;:!?#$%&*|\"'()[]{}<>-_=+/\\"
REMEMBERED = 700_000
#: words of a training sample
LINE = 16
LEVEL = 0.3


def windows(text: str | bytes | None) -> list[bytes]:
    """Lower-case words without outer ASCII punctuation, cut to LONGEST bytes."""
    data = text if isinstance(text, bytes) else (text or "").lower().encode("utf-8", "replace")
    out = []
    for word in data.split():
        word = word.strip(EDGE)
        if len(word) > LONGEST:
            out += [word[k : k + LONGEST] for k in range(0, len(word), LONGEST)]
        elif word:
            out.append(word)
    return out


def distinct(text: str | None) -> list[bytes]:
    """The distinct windows of a text, in order."""
    held: set[bytes] = set()
    for part in pieces((text or "").lower().encode("utf-8", "replace")):
        held.update(windows(part))
    return sorted(held)


def train(texts: list[str], size: int, most_bytes: int) -> bytes:
    """A dictionary of about `size` bytes from texts, in lines of LINE words; of more than most_bytes, lines by chance.

    Where there is too little to train on, the lines themselves.
    """
    words = [windows(t) for t in texts]
    lines = sorted(b" " + b" ".join(w[k : k + LINE]) + b" " for w in words for k in range(0, len(w), LINE))
    random.Random(0).shuffle(lines)
    total = np.cumsum([len(x) for x in lines]) if lines else np.zeros(0)
    lines = lines[: int(np.searchsorted(total, most_bytes)) + 1]
    try:
        return zstandard.train_dictionary(size, lines, k=16, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(lines)[-size:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=14, chain_log=14, search_log=6, min_match=4, target_length=8, strategy=zstandard.STRATEGY_LAZY, write_content_size=0, write_dict_id=0, write_checksum=0
    )
    kind = zstandard.DICT_TYPE_FULLDICT if dictionary[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=kind)
    data.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=params)


def framed(word: bytes) -> bytes:
    return (b" " + word) * -(-FRAME // (len(word) + 1)) + b" "


@dataclass
class Model:
    """Dictionaries of both classes, and the curve over features: how each is scaled, its weight, and the shift that the threshold takes."""

    toxic: list[bytes]
    ordinary: list[bytes]
    middle: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    shift: float = 0.0
    met: dict[bytes, int] = field(default_factory=dict)

    def __getstate__(self):
        return {"toxic": self.toxic, "ordinary": self.ordinary, "middle": self.middle, "scale": self.scale, "weights": self.weights, "shift": self.shift, "met": {}}

    def distances(self, words: list[bytes]) -> np.ndarray:
        """Three distances of each window."""
        if not hasattr(self, "pairs"):
            self.pairs = [[_compressor(d) for d in side] for side in (self.toxic, self.ordinary)]
            self.table = np.zeros((REMEMBERED, 3), np.float32)
        fresh = [w for w in words if w not in self.met]
        if len(self.met) + len(fresh) > REMEMBERED:
            self.met, fresh = {}, words
        if len(fresh) > REMEMBERED:
            return np.concatenate([self.distances(words[k : k + REMEMBERED]) for k in range(0, len(words), REMEMBERED)])
        if fresh:
            frames = [framed(w) for w in fresh]
            toxic, ordinary = (np.array([[len(x) for x in c.multi_compress_to_buffer(frames, threads=0)] for c in side]) for side in self.pairs)
            first, least = len(self.met), ordinary.min(axis=0)
            self.table[first : first + len(fresh)] = np.stack([least - toxic.max(axis=0), least - np.median(toxic, axis=0), ordinary.mean(axis=0) - toxic.mean(axis=0)], 1)
            self.met.update(zip(fresh, range(first, first + len(fresh)), strict=True))
        return self.table[np.fromiter(map(self.met.__getitem__, words), np.int64, len(words))].astype(np.float64)

    def features(self, text: str | None) -> np.ndarray:
        """1, the number of distinct windows, and of each distance: the largest, how many reach each step, the mean, the 95 % quantile."""
        words = distinct(text)
        if not words:
            return np.zeros(2 + 3 * (3 + len(STEPS))) + np.eye(1, 2 + 3 * (3 + len(STEPS)))[0]
        d = np.sort(self.distances(words), axis=0)
        each = [np.maximum(d[-1], 0), *(np.log1p((d >= s).sum(axis=0)) for s in STEPS), d.mean(axis=0), d[int(0.95 * (len(d) - 1))]]
        return np.concatenate([[1.0, np.log1p(len(d))], np.concatenate(each)])

    def levels(self, rows: np.ndarray) -> np.ndarray:
        # row by row, so that equal rows get equal numbers in batches of any size
        return (((rows - self.middle) / self.scale) * self.weights).sum(axis=1) - self.shift

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.levels(rows), -30, 30)))

    def calibrate(self, rows: np.ndarray, bad: np.ndarray, parts: np.ndarray, false_share: float) -> None:
        """Fit the curve, and shift it so that at most false_share of the ordinary rows score LEVEL or more (of at least 1 / false_share rows)."""
        self.middle, self.scale = rows.mean(axis=0), rows.std(axis=0) + 1e-9
        self.middle[0], self.scale[0] = 0.0, 1.0
        self.weights, self.shift = _logistic((rows - self.middle) / self.scale, bad, parts), 0.0
        ordinary = np.sort(self.levels(rows[bad == 0]))
        allowed = int(false_share * len(ordinary))
        if allowed:
            self.shift = max(0.0, float(ordinary[-allowed]) - math.log(LEVEL / (1 - LEVEL)))


def _logistic(rows: np.ndarray, marks: np.ndarray, parts: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic curve; parts weigh the rows. Newton steps with a ridge."""
    weights, parts = np.zeros(rows.shape[1]), parts / parts.mean()
    shrink = np.diag([0.0] + [ridge * len(rows)] * (rows.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        slope = rows.T @ (parts * (p - marks)) + shrink @ weights
        bend = (rows * (parts * p * (1 - p))[:, None]).T @ rows + shrink + 1e-9 * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights = weights - step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def fit(
    docs: DataFrame, labels: DataFrame, sample: int = 3000, parts: int = 4, toxic_size: int = 65_536, ordinary_size: int = 262_144, most_bytes: int = 32_000_000, false_share: float = 0.01
) -> Model | None:
    """A model from docs (doc_id, text) and labels (doc_id, toxic)."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    fine = 1 << 30
    shares = {k: min(1.0, sample / n) for k, n in sizes.items()}
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(fine)) < F.when(F.col("toxic") == 1, int(fine * shares[1])).otherwise(int(fine * shares[0]))
    dealt = lambda word, k: F.pmod(F.xxhash64("doc_id", F.lit(word)), F.lit(k)).cast("int")
    chosen = marks.where(drawn).select("doc_id", "toxic", dealt("half", 2).alias("half"), dealt("part", parts).alias("part"))
    # about 2 x sample short rows at most: the bound of this broadcast
    texts = stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        toxic = int(rows["toxic"].iloc[0])
        made = train(sorted(t for t in rows["text"] if t), toxic_size if toxic else ordinary_size, most_bytes)
        return pd.DataFrame({"toxic": [toxic], "part": rows["part"].iloc[:1].to_numpy(), "made": [made]})

    half = texts.where("half = 0 and text is not null").select("toxic", "part", "text").distinct()
    learned = half.groupBy("toxic", "part").applyInPandas(learn, "toxic int, part int, made binary").collect()  # at most 2 x parts dictionaries
    side = lambda k: [bytes(r["made"]) for r in sorted(learned, key=lambda r: r["part"]) if r["toxic"] == k and len(r["made"]) >= 8]
    model = Model(side(1), side(0))
    if not model.toxic or not model.ordinary:
        return None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "row": [shared.value.features(t) for t in batch["text"]]})

    rows = texts.where("half = 1").select("text", "toxic").mapInPandas(describe, "toxic int, row array<double>").toPandas()  # some numbers a sampled text
    if rows["toxic"].nunique() < 2:
        return None
    data, bad = np.stack(rows["row"].to_numpy()), rows["toxic"].to_numpy(np.float64)
    order = np.lexsort(np.column_stack([data, bad]).T)
    data, bad = data[order], bad[order]
    model.calibrate(data, bad, np.where(bad == 1, 1 / shares[1], 1 / shares[0]), false_share)
    return model


def score(model: Model | None, docs: DataFrame, text: Column) -> Column:
    """The calibrated chance of a toxic text."""
    if model is None:
        return F.lit(0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for batch in batches:
            yield pd.Series(model.scores(np.stack([model.features(t) for t in batch])) if len(batch) else [], dtype="float64")

    return of(text)

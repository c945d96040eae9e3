"""Toxicity by compression distance: a toxic and an ordinary zstandard dictionary.

A window (a few words of running text, one window after the other) reads as
toxic if it compresses to fewer bytes with the dictionary trained on toxic text
than with the one trained on ordinary text. Both dictionaries begin with the
same base, trained on ordinary prose, so that what both kinds of text share
costs the same; behind it each has a part trained on its own class.

A toxic document is mostly ordinary prose, so the parts are trained twice over:
first on whole texts of the class, then on those windows of each document that
dictionaries of *other* documents tell apart best (four of a toxic document, the
one most like toxic text of an ordinary document). Only what recurs between
documents survives that. A document's score is a logistic
function of the gains of all its windows: how many there are, how many come how
near to the calibrated gain, their share, and the best. Gain, weights and
threshold are calibrated on a third of the documents that the dictionaries never
saw.

Training uses a bounded sample of labelled documents (``n_toxic`` and
``n_ordinary`` of at most ``sample_chars`` characters each, chosen by a hash of
the id); scoring reads every window of every whole text. Words are made of
characters other than ASCII white space; A-Z are lower-cased.

Defined results: null and empty texts have no windows and get the score of a
document with no gain; repeated rows get equal scores; without labelled rows of
both classes every score is 0; where there are too few windows to train a
dictionary, the windows themselves are it; an empty table gives no rows; extra
columns, whatever their names, do not matter to ``score`` and stay in
``keep_clean``.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

LEVEL = 7
#: Both dictionaries end with this and it follows each window: alone, so few bytes would be stored raw, and no match may begin in the last eight.
CARRIER = bytes(range(128, 192))
BETWEEN = b" " + CARRIER + b" "
#: Scores from here on mean toxic.
THRESHOLD = 0.7
#: Windows compressed in one call.
AT_ONCE = 1 << 15
#: Windows kept of each toxic and of each ordinary document, and the gain they must have.
KEPT = (4, 1)
LEAST_GAIN = 2


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    words: int = 1  # in a window
    gain: int = 1  # a window of at least this gain counts as toxic
    weights: list[float] = field(default_factory=list)

    def scorer(self) -> Scorer:
        return Scorer(self)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def windows(text: str | None, words: int) -> list[bytes]:
    """Runs of `words` words, a blank between them, one after the other; the last one may be shorter."""
    return re.findall(rb"[^ ]+(?: [^ ]+){0,%d}" % (words - 1), b" ".join(words_of(text)))


class Scorer:
    """Gains of windows and scores of documents."""

    def __init__(self, model: Model):
        import zstandard as z

        self.model = model
        if model.toxic:
            self.buffers, self.toxic, self.ordinary = z.BufferWithSegments, *(self.compressor(z, raw) for raw in (model.toxic, model.ordinary))

    @staticmethod
    def compressor(z, raw: bytes):
        """The window must reach over the whole dictionary, which a short input alone would not ask for."""
        own = z.ZstdCompressionParameters.from_level(LEVEL, window_log=18, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)
        return z.ZstdCompressor(compression_params=own, dict_data=z.ZstdCompressionDict(raw))

    def lengths(self, compressor, texts) -> np.ndarray:
        out = compressor.multi_compress_to_buffer(texts)
        return np.fromiter(map(len, out), np.int64, len(out))

    def gains(self, own: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each window against the ordinary one."""
        out = [np.zeros(0, np.int64)]
        for i in range(0, len(own), AT_ONCE):
            part = own[i : i + AT_ONCE]
            sizes = np.fromiter(map(len, part), np.int64, len(part)) + len(BETWEEN)
            places = np.column_stack([np.cumsum(sizes) - sizes, sizes]).astype("<u8")
            texts = self.buffers(b" " + BETWEEN.join(part) + BETWEEN, places.tobytes())  # each window between blanks, then CARRIER
            out.append(self.lengths(self.ordinary, texts) - self.lengths(self.toxic, texts))
        return np.concatenate(out)

    def score(self, text: str | None) -> float:
        if not self.model.toxic:
            return 0.0
        z = float(np.dot(self.model.weights, traits(self.gains(windows(text, self.model.words)), self.model.gain)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def traits(gains: np.ndarray, least: int) -> list[float]:
    """What the calibration sees of a document: constant, size, windows by how far they reach the gain, their share, the best."""
    own = gains - least
    hits = int((own >= 0).sum())
    tiers = [math.log1p(int((own >= t).sum())) for t in (-2, -1, 0, 1, 2)]
    return [1.0, math.log1p(len(own)), *tiers, 10 * hits / max(20, len(own)), float(max(-3, min(6, own.max()))) if len(own) else -3.0]


def dictionary(samples: list[bytes], size: int, segment: int, fit: int) -> bytes:
    """A zstandard dictionary trained on the samples; the last of them as they are where training needs more."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples, k=segment, d=fit, level=LEVEL).as_bytes()
    except z.ZstdError:
        return b"".join(samples)[-size:]


def stretches(texts: list[str], size: int = 512) -> list[bytes]:
    return [x[i : i + size] for t in texts if (x := b" " + b" ".join(words_of(t)) + b" ") for i in range(0, len(x), size)]


def chunks(parts: list[bytes], n: int = 16) -> list[bytes]:
    return [b"".join(parts[i : i + n]) for i in range(0, len(parts), n)]


def train(toxic: list[str], ordinary: list[str], words: int = 2, rounds: int = 1, base_size: int = 32 << 10, first_size: int = 32 << 10, sizes: tuple[int, int] = (2 << 10, 4 << 10)) -> Model:
    """Fit dictionaries, gain and weights on labelled texts (exact copies count once)."""
    toxic, ordinary = sorted(set(toxic)), sorted(set(ordinary))
    if not toxic or not ordinary:
        return Model(words=words)
    rng = np.random.default_rng(9)
    draw = lambda x, n: [x[i] for i in sorted(rng.permutation(len(x))[:n].tolist())]
    base = dictionary(draw(stretches(ordinary), 8000), base_size, 48, 6)

    def made(own: list[list[bytes]], sizes: tuple[int, int], segment: int, fit: int) -> Model:
        """own: training samples of each class, (toxic, ordinary)."""
        raw = [base + dictionary(x, n, segment, fit) + CARRIER for x, n in zip(own, sizes, strict=True)]
        return Model(*raw, words=words)

    # Two parts of the documents make the dictionaries, a third one calibrates them.
    parts = [(toxic[h::3], ordinary[h::3]) for h in range(3)]
    cut = [[[windows(t, words) for t in texts] for texts in part] for part in parts]
    models = [made([stretches(texts) for texts in part], (first_size, first_size), 48, 6) for part in parts[:2]]
    kept: list[list[list[bytes]]] = []
    for _ in range(rounds):
        kept = []
        for part, model in zip(cut[:2], reversed(models), strict=True):
            scorer, own = model.scorer(), []
            for docs, most in zip(part, KEPT, strict=True):
                best = []
                for doc in docs:
                    gains = scorer.gains(doc)
                    best += [b" " + doc[i] + b" " for i in np.argsort(-gains, kind="stable")[:most] if gains[i] >= LEAST_GAIN]
                own.append([best[i] for i in rng.permutation(len(best))])
            kept.append(own)
        models = [made([chunks(x) for x in own], sizes, 24, 8) for own in kept]
    out = made([chunks(kept[0][c] + kept[1][c]) for c in (0, 1)], sizes, 24, 8)
    scorer = out.scorer()
    gains = [[scorer.gains(doc) for doc in (cut[2][c] or cut[0][c])] for c in (0, 1)]  # with one or two documents there is no third part
    best = (-2.0, 1)
    for least in range(1, 13):
        found = [np.mean([bool((g >= least).any()) for g in side]) for side in gains]
        best = max(best, (float(found[0] - found[1]), least))
    out.gain = best[1]
    x = np.array([traits(g, out.gain) for side in gains for g in side])
    n = len(gains[0])
    w = logistic(x, (np.arange(len(x)) < n).astype(float))
    # The score is THRESHOLD where the classes are told apart best.
    w[0] += math.log(THRESHOLD / (1 - THRESHOLD)) - divide(x[:n] @ w, x[n:] @ w)
    out.weights = w.tolist()
    return out


def divide(high: np.ndarray, low: np.ndarray) -> float:
    """The middle of the gap with the largest share of `high` above less four times that of `low`."""
    at = np.unique(np.concatenate([high, low]))
    if len(at) < 2:
        return float(at[0])
    cuts = (at[1:] + at[:-1]) / 2
    worth = (1 - np.searchsorted(np.sort(high), cuts) / len(high)) - 4 * (1 - np.searchsorted(np.sort(low), cuts) / len(low))
    best = np.flatnonzero(worth >= worth.max() - 1e-12)
    return float(cuts[best[np.argmax(np.diff(at)[best])]])


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 0.3) -> np.ndarray:
    """Ridge logistic regression by Newton steps, both classes weighing alike."""
    each = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (each * (p - y)) + ridge * w
        curve = (x * (each * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: Column) -> Column:
    """Rows whose labels training never sees: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, n_toxic: int, n_ordinary: int, sample_chars: int) -> tuple[list[str], list[str]]:
    """Texts of at most n_toxic and n_ordinary labelled documents, the least by a hash of the id; (toxic, ordinary)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    order = F.xxhash64(F.lit(9), F.col("doc_id"))
    own = [known.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(n) for c, n in ((0, n_ordinary), (1, n_toxic))]
    texts = docs.where(F.length("text") <= sample_chars).select("doc_id", F.col("text").cast("string").alias("text"))
    # At most n_toxic + n_ordinary ids are broadcast, and as many texts of bounded length collected.
    rows = texts.join(F.broadcast(own[0].unionByName(own[1])), "doc_id").orderBy("doc_id", "text", "toxic").limit(n_toxic + n_ordinary).collect()
    return [r.text for r in rows if r.toxic == 1], [r.text for r in rows if r.toxic == 0]


def fit(docs: DataFrame, labels: DataFrame, n_toxic: int = 3000, n_ordinary: int = 6000, sample_chars: int = 4000, **options) -> Model:
    """Train on a bounded sample of the labelled rows that are not held out."""
    return train(*sample(docs, labels, n_toxic, n_ordinary, sample_chars), **options)


SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""

    def scored(batches):
        scorer = model.scorer()
        for batch in batches:
            values = [scorer.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], schema=SCORES)

    out = arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), scored, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold."""
    at = docs.columns.index(text_col)

    def kept(batches):
        scorer = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return arrow_map(docs, kept, docs.schema)


def fold(doc_id: int | None) -> bool:
    """held_out in Python."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1

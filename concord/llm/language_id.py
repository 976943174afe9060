"""Language identification: averaged hashed subword embeddings with a linear softmax.

A word's subwords are its character n-grams with word ends marked, hashed into a table of
embeddings; a text's vector is their average, and a softmax over it gives the languages.
Embeddings and softmax are trained together by stochastic gradient descent (Adagrad steps) in numpy, on the
driver, from ``train_rows`` labelled rows of each language (all it has, if fewer), however long. A temperature
fitted on rows set aside makes the probabilities calibrated, and a prediction whose probability is below ``reject_below`` is
rejected. As the probability only compares the learned languages, a text is also rejected if
too few of its 4-grams stand in the rows learned from: the least share lies between the shares
of rows set aside and of the same rows with the letters of each word shuffled. As everything before the softmax is linear, each distinct word has one vector of
scores, which a task computes once and keeps in a bounded table.

Texts that are null or have no letters (characters of Unicode's letter categories; number
signs such as ½ or Ⅷ are none) get ``und`` with score 0 and are rejected. Rows with a null
label are never learned from. Without any labelled row every text is ``und``. Languages of
equal probability: the first by code point. Repeated rows repeat in the result, an empty
table gives an empty one, and extra columns are ignored, whatever their names. Whole texts
are read, however long, in slices.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import bounded_sample_by, segment_sums, ship, slices, texts_of

ship(__name__)

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
WORD_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")


def has_letter(text: str) -> bool:
    """Whether a character is a letter; LETTER also finds number signs."""
    return any(m[0].isalpha() for m in LETTER.finditer(text))


@dataclass(frozen=True)
class Settings:
    """``train_rows`` labelled rows a language bound the sample; a fifth of it is for calibration.

    Of a sampled text of more than ``train_words`` words that many are learned from, evenly spread
    over the whole text, and of a word its first ``train_chars`` characters.
    """

    train_rows: int = 400
    train_words: int = 2000
    train_chars: int = 40
    buckets: int = 1 << 14
    dim: int = 12
    grams: tuple[int, int] = (1, 4)
    epochs: int = 4
    least_steps: int = 300
    batch: int = 16
    rate: float = 0.05
    seed: int = 2
    reject_below: float = 0.4
    table_words: int = 300_000
    seen_gram: int = 4
    seen_buckets: int = 1 << 22
    word_grams: int = 12


def seen_grams(words: list[bytes], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the ``seen_gram``-grams of words as one row (-1: none begins there, or its word has no letter), and the columns where words begin."""
    found, begin = subwords(words, (settings.seen_gram, settings.seen_gram), settings.seen_buckets)
    lettered = np.array([WORD_LETTER.search(w) is not None for w in words], bool)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return np.where(np.repeat(lettered, sizes), found[0], -1), begin


def seen_counts(words: list[bytes], seen: np.ndarray, settings: Settings) -> np.ndarray:
    """Seen grams and all grams of each word by the mask ``seen``; a word counts as ``word_grams`` grams at most, so one token decides no text."""
    found, begin = seen_grams(words, settings)
    counts = np.add.reduceat(np.stack([seen[found], found >= 0], axis=1).astype(np.float32), begin, axis=0)
    return counts * np.minimum(1, settings.word_grams / np.maximum(1, counts[:, 1:]))


def seen_share(text: bytes, seen: np.ndarray, settings: Settings) -> float:
    """Share of a text's grams that are seen; nan without grams."""
    words = text.split()
    have, total = seen_counts(words, seen, settings).sum(axis=0) if words else (0, 0)
    return float(have / total) if total else float("nan")


def least_seen(texts: list[bytes], seen: np.ndarray, settings: Settings) -> float:
    """The share of seen grams below which a text is rejected: a third of the way from texts with shuffled letters to ``texts``."""
    rng = np.random.default_rng(settings.seed)
    noise = ["".join(w[i] for i in rng.permutation(len(w))) for t in texts for w in [*t.decode("utf-8", "replace").split(), "\n"]]
    noise = [x.encode() for x in " ".join(w or "\n" for w in noise).split("\n")]
    good, bad = (np.array([x for x in (seen_share(t, seen, settings) for t in some) if x == x]) for some in (texts, noise))
    if not len(good) or not len(bad):
        return 0.0
    hi, lo = np.quantile(good, 0.01), np.quantile(bad, 0.99)
    return float(min(hi, lo + (hi - lo) / 3))


def subwords(words: list[bytes], grams: tuple[int, int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets (one row a length, a column a byte; -1: none begins there) of the n-grams of words with their ends marked, and the columns where words begin."""
    joined = np.frombuffer(b"".join(b"<%b>" % w for w in words).lower(), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begin = np.cumsum(sizes) - sizes
    left = np.repeat(begin + sizes, sizes) - np.arange(len(joined))
    lo, hi = grams
    out = np.full((hi - lo + 1, len(joined)), -1, np.int64)
    h = np.zeros(len(joined), np.uint32)
    for n in range(1, hi + 1):
        h[: len(h) - n + 1] = h[: len(h) - n + 1] * np.uint32(0x01000193) + joined[n - 1 :] + np.uint32(1)
        if n >= lo:
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(n)
            x ^= x >> np.uint32(13)
            out[n - lo] = np.where(left >= n, (x % np.uint32(buckets)).astype(np.int64), -1)
    return out, begin


@dataclass
class Model:
    """Scores of each bucket for each language (embedding times softmax weights), offsets, temperature, grams seen and their least share."""

    langs: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    settings: Settings
    seen: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    least: float = 0.0

    def seen_mask(self) -> np.ndarray:
        mask = np.zeros(self.settings.seen_buckets + 1, bool)  # -1: no gram
        mask[self.seen] = True
        return mask

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def train(texts: list[bytes], labels: list[str], settings: Settings) -> Model | None:
    """Fit embeddings and softmax; ``texts`` in a seeded order, the last fifth for calibration."""
    langs = sorted(set(labels))
    if not langs:
        return None
    rng = np.random.default_rng(settings.seed)
    y = np.array([langs.index(x) for x in labels])
    bags = []
    for t in texts:
        found = subwords(t.split(), settings.grams, settings.buckets)[0]
        counts = np.bincount(found[found >= 0], minlength=settings.buckets).astype(np.float32)
        used = np.flatnonzero(counts)
        bags.append((used, counts[used] / max(1.0, counts.sum())))
    fit = max(1, len(bags) * 4 // 5)
    weight = len(y) / (len(langs) * np.bincount(y, minlength=len(langs)))  # a language counts alike, however many rows it has
    emb = rng.normal(0, 0.1, (settings.buckets, settings.dim)).astype(np.float32)
    out = np.zeros((settings.dim, len(langs)), np.float32)
    bias = np.zeros(len(langs), np.float32)
    square, emb_square = {}, np.zeros_like(emb)
    epochs = max(settings.epochs, -(-settings.least_steps * settings.batch // fit))
    steps, done = epochs * -(-fit // settings.batch), 0
    for _ in range(epochs):
        order = rng.permutation(fit)
        for lo in range(0, fit, settings.batch):
            rate = settings.rate * (1 - done / steps)
            done += 1
            rows = order[lo : lo + settings.batch]
            x = np.stack([bags[i][1] @ emb[bags[i][0]] for i in rows])
            z = x @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= (weight[y[rows]] / len(rows))[:, None].astype(np.float32)
            back = p @ out.T
            for x_, g in ((out, x.T @ p), (bias, p.sum(axis=0))):
                square[id(x_)] = square.get(id(x_), 0) + g * g
                x_ -= rate * g / (np.sqrt(square[id(x_)]) + 1e-6)
            for g, i in zip(back, rows, strict=True):
                used, part = bags[i]
                step = part[:, None] * g
                emb_square[used] += step * step
                emb[used] -= rate * step / (np.sqrt(emb_square[used]) + 1e-6)
    model = Model(langs, emb @ out, bias, 1.0, settings)
    held = range(fit, len(bags)) if fit < len(bags) else range(len(bags))
    logits = np.stack([bags[i][1] @ model.scores[bags[i][0]] + bias for i in held])
    truth = y[list(held)]

    def loss(t):
        model.temperature = t
        return -np.log(model.probabilities(logits)[np.arange(len(truth)), truth] + 1e-12).mean()

    model.temperature = min(np.geomspace(0.1, 4.0, 33), key=loss)
    known = np.unique(np.concatenate([np.unique(seen_grams(t.split(), settings)[0]) for t in texts[:fit]]))
    model.seen = known[known >= 0]
    model.least = least_seen([texts[i] for i in held], model.seen_mask(), settings)
    return model


def fit(docs: DataFrame, where: Column, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Train on the rows that ``where`` admits, at most ``train_rows`` of each language, chosen by a hash of id and text."""
    rows = docs.where(where & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("y"), F.xxhash64(F.col(text_col).cast("string")).alias("k"))
    # each of these is computed once a row: a lambda that held the split would repeat it for every word
    rows = rows.withColumn("w", F.split("t", r"[\x20\x09-\x0D]+")).withColumn("step", F.greatest(F.lit(1), F.ceil(F.size("w") / settings.train_words)))
    cut = F.transform(F.filter("w", lambda w, i: i % F.col("step") == 0), lambda w: F.substring(w, 1, settings.train_chars))
    got = bounded_sample_by(rows.select("i", "k", "y", F.array_join(cut, " ").alias("t")), "y", [F.lit(settings.seed), "i", "k"], settings.train_rows)
    got = [r for r in got if has_letter(r["t"])]
    return train([r["t"].encode() for r in got], [r["y"] for r in got], settings)


class WordScores:
    """Distinct words with the sum and number of their subwords' scores; emptied before a slice when it holds more than ``table_words``."""

    def __init__(self, model: Model):
        self.model = model
        self.padded = np.zeros((len(model.scores) + 1, len(model.langs) + 1), np.float32)  # -1: no subword
        self.padded[:-1, :-1], self.padded[:-1, -1] = model.scores, 1
        self.seen = model.seen_mask()
        self.clear()

    def clear(self) -> None:
        self.row: dict[bytes, int] = {}
        self.values = np.zeros((0, len(self.model.langs) + 1), np.float32)
        self.grams = np.zeros((0, 2), np.float32)

    def rows(self, words: list[bytes]) -> np.ndarray:
        """Scores and number of subwords of each word."""
        return self.both(words)[0]

    def both(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Scores and number of subwords of each word; how many grams of it are seen, and how many it has."""
        s = self.model.settings
        if len(self.row) > s.table_words:
            self.clear()
        get = self.row.get
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = list(dict.fromkeys(words[i] for i in missing))
            parts, grams, lo = [self.values], [self.grams], 0
            while lo < len(new):
                hi, size = lo, 0
                while hi < len(new) and (hi == lo or size + len(new[hi]) < 200_000):
                    size += len(new[hi])
                    hi += 1
                found, begin = subwords(new[lo:hi], s.grams, s.buckets)
                total = self.padded[found[0]]
                for own in found[1:]:
                    total += self.padded[own]
                parts.append(np.add.reduceat(total, begin, axis=0))
                grams.append(seen_counts(new[lo:hi], self.seen, s))
                lo = hi
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            self.values, self.grams = np.concatenate(parts), np.concatenate(grams)
            at[missing] = [self.row[words[i]] for i in missing]
        return self.values[at], self.grams[at]


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score (calibrated probability) and rejected, beside the columns named by ``keep`` as struct ``kept``."""
    kept = [F.struct(*[F.col(c) for c in keep]).alias("kept")] if keep else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *kept)

    def run(batches):
        table = WordScores(model) if model else None
        for batch in batches:
            texts = texts_of(batch.column("text"))
            langs, scores, strange = [], [], []
            for lo, hi in slices(texts):
                part = [t.split() if model and has_letter(t.decode("utf-8", "replace")) else [] for t in texts[lo:hi]]
                lengths = np.fromiter(map(len, part), np.int64, len(part))
                if not lengths.sum():
                    langs += [UNKNOWN] * len(part)
                    scores += [0.0] * len(part)
                    strange += [False] * len(part)
                    continue
                values, grams = table.both([w for words in part for w in words])
                sums, grams = segment_sums(values, lengths), segment_sums(grams, lengths)
                strange += (grams[:, 0] < model.least * grams[:, 1]).tolist()
                p = model.probabilities(sums[:, :-1] / np.maximum(1, sums[:, -1:]) + model.bias)
                best = p.argmax(axis=1)
                langs += [model.langs[b] if n else UNKNOWN for b, n in zip(best, lengths, strict=True)]
                scores += [float(x[b]) if n else 0.0 for x, b, n in zip(p, best, lengths, strict=True)]
            low = model.settings.reject_below if model else 1.0
            cols = [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array([x < low or odd for x, odd in zip(scores, strange, strict=True)], pa.bool_())]
            names = ["doc_id", "lang_pred", "score", "rejected"]
            if keep:
                cols, names = [*cols, batch.column("kept")], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(cols, names)

    from pyspark.sql import types as T

    schema = T._parse_datatype_string("doc_id long, lang_pred string, score double, rejected boolean")
    return rows.mapInArrow(run, schema.add("kept", rows.schema["kept"].dataType) if keep else schema)


def accepted(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with its columns."""
    keep = list(docs.columns)
    out = predict(docs, model, id_col, text_col, keep).where(~F.col("rejected"))
    return out.select(*[F.col("kept")[c].alias(c) for c in keep])

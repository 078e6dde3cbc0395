"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word from both sides and labels every position with a
language; a document pools the probabilities of all its positions. It is trained in numpy by
backpropagation through time on a bounded sample of words. Sequences are words (longer ones
are cut into windows), so a word that returns is labelled once per worker and counted as
often as it stands there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T

HIDDEN = 8
#: Bytes of one sequence; a longer word is several sequences.
WINDOW = 32
#: The fitting sample: documents per language, and words of each of them.
FIT_DOCS, FIT_WORDS = 150, 120
EPOCHS, BATCH, RATE = 4, 512, 0.01
#: Steps of the optimiser at least: a small sample is gone through more often.
LEAST_STEPS = 300
CACHE_WORDS = 300_000
UNKNOWN = "und"


def normalise(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the UTF-8 capitals of Latin-1 in lower case."""
    out = T.lower(data)
    if len(out) > 1:
        after = out[:-1] == 0xC3
        after &= (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][after] += 0x20
    return out


def sequences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, sequences before each text): words, cut into windows of ``WINDOW`` bytes."""
    starts, ends, counts = T.word_spans(data, offsets)
    lens = ends - starts
    parts = -(-lens // WINDOW)
    if len(parts) and parts.max() > 1:
        before = np.concatenate(([0], np.cumsum(parts)))
        nth = np.arange(before[-1]) - np.repeat(before[:-1], parts)
        starts = np.repeat(starts, parts) + nth * WINDOW
        lens = np.minimum(np.repeat(lens, parts) - nth * WINDOW, WINDOW)
        counts = before[counts]
    return starts, lens, counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def init(classes: int, hidden: int = HIDDEN, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights of both directions (f, b) and of the output layer."""
    rng = np.random.default_rng(seed)
    w = {}
    for d in "fb":
        w[f"x{d}"] = rng.normal(0, 0.1, (256, 3 * hidden)).astype(np.float32)
        w[f"h{d}"] = (rng.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        w[f"c{d}"] = np.zeros(3 * hidden, np.float32)
    w["o"] = rng.normal(0, 0.3, (2 * hidden, classes)).astype(np.float32)
    w["oc"] = np.zeros(classes, np.float32)
    return w


def _run(w: dict, d: str, x: np.ndarray, live: np.ndarray, tape: list | None) -> np.ndarray:
    """Hidden states (time, batch, hidden) of direction ``d``; positions past a word's end keep the state."""
    steps, size = x.shape
    n = w[f"h{d}"].shape[0]
    h = np.zeros((size, n), np.float32)
    out = np.zeros((steps, size, n), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        gx = w[f"x{d}"][x[t]] + w[f"c{d}"]
        gh = h @ w[f"h{d}"]
        zr = _sigmoid(gx[:, :2 * n] + gh[:, :2 * n])
        z, r = zr[:, :n], zr[:, n:]
        c = np.tanh(gx[:, 2 * n:] + r * gh[:, 2 * n:])
        new = c + z * (h - c)
        if tape is not None:
            tape.append((t, h, z, r, c, gh[:, 2 * n:]))
        h = np.where(live[t][:, None], new, h)
        out[t] = h
    return out


def forward(w: dict, x: np.ndarray, live: np.ndarray, tapes: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities (time, batch, class), hidden states of both directions)."""
    both = np.concatenate([_run(w, d, x, live, None if tapes is None else tapes.setdefault(d, [])) for d in "fb"], 2)
    s = both @ w["o"] + w["oc"]
    s -= s.max(2, keepdims=True)
    p = np.exp(s)
    return p / p.sum(2, keepdims=True), both


def gradients(w: dict, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy over live positions and its gradients, by backpropagation through time."""
    tapes: dict = {}
    p, both = forward(w, x, live, tapes)
    count = max(1, int(live.sum()))
    index = np.arange(len(y))
    loss = -float((np.log(p[:, index, y] + 1e-12) * live).sum()) / count
    ds = p.copy()
    ds[:, index, y] -= 1
    ds *= live[:, :, None] / np.float32(count)
    flat = ds.reshape(-1, ds.shape[2])
    g = {"o": both.reshape(-1, both.shape[2]).T @ flat, "oc": flat.sum(0)}
    dboth = ds @ w["o"].T
    n = w["hf"].shape[0]
    for d, part in (("f", dboth[:, :, :n]), ("b", dboth[:, :, n:])):
        gx, gh, gc = np.zeros_like(w[f"x{d}"]), np.zeros_like(w[f"h{d}"]), np.zeros_like(w[f"c{d}"])
        dh = np.zeros((x.shape[1], n), np.float32)
        for t, h, z, r, c, ghc in reversed(tapes[d]):
            dh = dh + part[t]
            on = live[t][:, None]
            dnew = dh * on
            dz, dc = dnew * (h - c) * z * (1 - z), dnew * (1 - z) * (1 - c * c)
            dr = dc * ghc * r * (1 - r)
            through = np.concatenate([dz, dr, dc * r], 1)
            dgx = np.concatenate([dz, dr, dc], 1)
            np.add.at(gx, x[t], dgx)
            gc += dgx.sum(0)
            gh += h.T @ through
            dh = dh * ~on + dnew * z + through @ w[f"h{d}"].T
        g |= {f"x{d}": gx, f"h{d}": gh, f"c{d}": gc}
    return loss, g


def _padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, words))
    x = np.zeros((len(words), steps), np.uint8)
    for i, b in enumerate(words):
        x[i, :len(b)] = np.frombuffer(b, np.uint8)
    lens = np.array(list(map(len, words)))
    return np.ascontiguousarray(x.T), np.arange(steps)[:, None] < lens


def fit(words: list[bytes], labels: np.ndarray, classes: int, seed: int = 7, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Adam over shuffled batches of words of like length."""
    w = init(classes, seed=seed)
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v2 = {k: np.zeros_like(v) for k, v in w.items()}
    order = np.argsort([len(b) for b in words], kind="stable")
    batches = [order[i:i + BATCH] for i in range(0, len(order), BATCH)]
    epochs = max(epochs, -(-LEAST_STEPS // max(1, len(batches))))
    step, total = 0, epochs * max(1, len(batches))
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            i = batches[k]
            _, g = gradients(w, *_padded([words[j] for j in i]), labels[i])
            step += 1
            rate = RATE * (1 - step / (total + 1)) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for name, d in g.items():
                m[name] += 0.1 * (d - m[name])
                v2[name] += 0.001 * (d * d - v2[name])
                w[name] -= (rate * m[name] / (np.sqrt(v2[name]) + 1e-8)).astype(np.float32)
    return w


class Labeller:
    """Pooled position probabilities of words, with a bounded cache; one per worker."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        self.classes = len(weights["oc"])
        self.clear()

    def clear(self) -> None:
        self.at: dict[int, int] = {}
        self.sums = np.zeros((1024, self.classes), np.float32)

    def _label(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        out = np.empty((len(starts), self.classes), np.float32)
        order = np.argsort(lens, kind="stable")
        for i in range(0, len(order), 4096):
            o = order[i:i + 4096]
            steps = int(lens[o[-1]])
            live = np.arange(steps)[:, None] < lens[o]
            x = data[np.minimum(starts[o] + np.arange(steps)[:, None], len(data) - 1)]
            p, _ = forward(self.w, x, live)
            out[o] = (p * live[:, :, None]).sum(0)
        return out

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probability of each language over all positions of each text (no position: zeros)."""
        data = normalise(data)
        starts, lens, counts = sequences(data, offsets)
        if not len(starts):
            return np.zeros((len(offsets) - 1, self.classes))
        keys, first, back = np.unique(T.span_hashes(data, starts, starts + lens), return_index=True, return_inverse=True)
        names = keys.tolist()
        slot = np.array([self.at.get(k, -1) for k in names], np.int64)
        new = np.flatnonzero(slot < 0)
        if len(self.at) + len(new) > CACHE_WORDS:
            self.clear()
            new = np.arange(len(names))
        if len(new):
            base = len(self.at)
            if base + len(new) > len(self.sums):
                self.sums = np.concatenate([self.sums, np.zeros((base + 2 * len(new), self.classes), np.float32)])
            self.sums[base:base + len(new)] = self._label(data, starts[first[new]], lens[first[new]])
            slot[new] = np.arange(base, base + len(new))
            self.at.update((names[i], base + j) for j, i in enumerate(new.tolist()))
        per_word = self.sums[slot][back].astype(np.float64)
        sums = np.concatenate([np.zeros((1, self.classes)), np.cumsum(per_word, 0)])
        size = np.concatenate(([0], np.cumsum(lens)))
        total = size[counts[1:]] - size[counts[:-1]]
        return (sums[counts[1:]] - sums[counts[:-1]]) / np.maximum(total, 1)[:, None]


def training_words(labelled: DataFrame) -> tuple[list[bytes], list[str]]:
    """Evenly spaced words of ``FIT_DOCS`` documents per language, chosen by a hash of the id."""
    per_lang = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (labelled.where("lang is not null and text is not null")
              .withColumn("nth", F.row_number().over(per_lang)).where(F.col("nth") <= FIT_DOCS)
              .select("lang", "text"))

    def run(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for a, _, data, offsets in T.slices(batch.column(1)):
                low = normalise(data)
                starts, lens, counts = sequences(low, offsets)
                for i, (b, e) in enumerate(zip(counts[:-1].tolist(), counts[1:].tolist())):
                    pick = np.unique(np.linspace(b, e - 1, FIT_WORDS).astype(int)) if e > b else []
                    found = [low[starts[j]:starts[j] + lens[j]].tobytes() for j in pick]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([langs[a + i]] * len(found), pa.string()), pa.array(found, pa.binary())],
                        ["lang", "word"])

    rows = sorted((r.lang, bytes(r.word)) for r in chosen.mapInArrow(run, "lang string, word binary").collect())
    return [w for _, w in rows], [g for g, _ in rows]


_LABELLERS: dict[int, Labeller] = {}


def predict(df: DataFrame, weights: dict[str, np.ndarray], langs: list[str]) -> DataFrame:
    """``df``'s doc_id with lang_pred and score, from the whole text alone."""
    shared = df.sparkSession.sparkContext.broadcast(weights)
    names = np.array([*langs, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = id(shared.value)
        if key not in _LABELLERS:
            _LABELLERS.clear()
            _LABELLERS[key] = Labeller(shared.value)
        labeller = _LABELLERS[key]
        for batch in batches:
            lettered = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in T.slices(batch.column(1)):
                p = labeller.documents(data, offsets)
                best = p.argmax(1)
                score = np.clip(p[np.arange(len(p)), best], 0.0, 1.0)
                known = lettered[a:b] & (score > 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(names[np.where(known, best, len(langs))], pa.string()),
                     pa.array(np.where(known, score, 0.0), pa.float64())], ["doc_id", "lang_pred", "score"])

    src = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                    F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return src.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id="doc_id"):
    """Documents kept from fitting: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string")) % 3 == 1, F.lit(False))


def identify(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score.

    Learns from text and lang of the documents that are not held out and have an id and a
    lang. ``und`` with score 0 stands for a null text, a text without a letter, and for all
    texts when there is nothing to learn from. A null id stays null (not held out); repeated
    rows are predicted each; other columns are ignored; an empty table gives no rows.
    """
    words, labels = training_words(documents.where(F.col("doc_id").isNotNull() & ~held_out()))
    langs = sorted(set(labels))
    if langs:
        weights = fit(words, np.array([langs.index(g) for g in labels]), len(langs))
    else:
        weights = init(1)
        langs = [UNKNOWN]
    out = predict(documents, weights, langs)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred",
                      F.when(F.col("lang_pred") == UNKNOWN, 0.0).otherwise(F.col("score")).alias("score"))

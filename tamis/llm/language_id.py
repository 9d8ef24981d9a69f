"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of the lower-cased text in both directions, words, digits and marks alike, and
labels every byte position with language probabilities. It is trained in numpy by backpropagation through time on
windows of a bounded sample of labelled rows. Texts of any length are read whole, in windows of :data:`CORE` bytes,
each with :data:`CONTEXT` bytes of its neighbours on either side for the state to settle. A document's probabilities
are the mean over the positions of all its letters.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, read, slices

#: Bound of the training sample: rows, and windows of each, evenly spaced over its whole text.
SAMPLE_ROWS, SAMPLE_WINDOWS = 1500, 24
#: Sizes of the byte embedding and of each direction's state.
EMBED, HIDDEN = 8, 8
STEPS, BATCH, RATE = 300, 192, 0.012
#: Bytes of a training window.
WINDOW = 48
#: Bytes of a scored window, and of its context on either side.
CORE, CONTEXT = 224, 16
#: Windows that run through the network together.
TOGETHER = 2048
UNDETERMINED = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def bytes_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the lower-cased text, and which of them belong to a letter."""
    text = text.lower()
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if len(raw) == len(text):
        return raw, _letters()[raw]
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    return raw, np.repeat(_letters()[points], width)


def sample_windows(text: str, n: int = SAMPLE_WINDOWS, width: int = WINDOW) -> list[tuple[bytes, bytes]]:
    """At most ``n`` windows of bytes and letter marks, evenly spaced over the whole text, with half a context of zeros before and after it."""
    raw, letter = (x.tobytes() for x in bytes_of(text))
    edge = b"\0" * (CONTEXT // 2)
    raw, letter = (edge + x + edge for x in (raw, letter))
    raw, letter = raw.ljust(width, b"\0"), letter.ljust(width, b"\0")
    starts = np.unique(np.linspace(0, len(raw) - width, n).astype(np.int64)).tolist()
    return [(raw[i : i + width], letter[i : i + width]) for i in starts if any(letter[i : i + width])]


class ByteBiGru:
    """Parameters and passes of the network; all batches hold sequences of one length."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.classes = classes
        self.p = {"E": draw(256, EMBED) * 4, "V": draw(2 * HIDDEN, len(classes)), "c": np.zeros(len(classes), np.float32)}
        for d in "fb":
            self.p |= {f"Wx{d}": draw(EMBED, 3 * HIDDEN), f"Wh{d}": draw(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}

    def _run(self, x: np.ndarray, d: str, keep: np.ndarray) -> tuple[np.ndarray, list]:
        """States and tape of one direction. State is zero at zero bytes, which stand before and after a text."""
        n, length, _ = x.shape
        gx = x @ self.p[f"Wx{d}"] + self.p[f"b{d}"]
        h, out, tape = np.zeros((n, HIDDEN), np.float32), np.empty((n, length, HIDDEN), np.float32), []
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            gh = h @ self.p[f"Wh{d}"]
            gates = _sigmoid(gx[:, t, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(gx[:, t, 2 * HIDDEN :] + r * gh[:, 2 * HIDDEN :])
            tape.append((t, h, z, r, c, gh))
            h = (c + z * (h - c)) * keep[:, t]
            out[:, t] = h
        return out, tape

    def forward(self, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Language probabilities (sequence, position, class)."""
        x, keep = self.p["E"][ids], (ids != 0)[:, :, None].astype(np.float32)
        (hf, tf), (hb, tb) = self._run(x, "f", keep), self._run(x, "b", keep)
        h = np.concatenate([hf, hb], axis=2)
        logits = h @ self.p["V"] + self.p["c"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        return e / e.sum(axis=2, keepdims=True), (x, keep, h, tf, tb)

    def _back(self, x, keep, dh_all, tape, d, g):
        """Backpropagation through time of one direction; adds to ``g``, returns the gradient of the input."""
        wh, wx = self.p[f"Wh{d}"], self.p[f"Wx{d}"]
        dx, dh = np.zeros_like(x), np.zeros((len(x), HIDDEN), np.float32)
        for t, before, z, r, c, gh in reversed(tape):
            dh = (dh + dh_all[:, t]) * keep[:, t]
            dz, dc = dh * (before - c) * z * (1 - z), dh * (1 - z) * (1 - c * c)
            dr = dc * gh[:, 2 * HIDDEN :] * r * (1 - r)
            dgx = np.concatenate([dz, dr, dc], axis=1)
            dgh = np.concatenate([dz, dr, dc * r], axis=1)
            g[f"Wh{d}"] += before.T @ dgh
            g[f"Wx{d}"] += x[:, t].T @ dgx
            g[f"b{d}"] += dgx.sum(axis=0)
            dx[:, t] = dgx @ wx.T
            dh = dh * z + dgh @ wh.T
        return dx

    def gradients(self, ids: np.ndarray, y: np.ndarray, letter: np.ndarray | None = None) -> tuple[float, dict]:
        """Mean loss over the marked positions (all, if none are given) and its gradient."""
        prob, (x, keep, h, tf, tb) = self.forward(ids)
        n, length, k = prob.shape
        share = (np.ones((n, length)) if letter is None else letter).astype(prob.dtype)
        share = share / max(1.0, float(share.sum()))
        loss = -(np.log(prob[np.arange(n), :, y] + 1e-9) * share).sum()
        dlogits = prob.copy()
        dlogits[np.arange(n), :, y] -= 1
        dlogits *= share[:, :, None]
        g = {name: np.zeros_like(v) for name, v in self.p.items()}
        g["V"] = h.reshape(-1, 2 * HIDDEN).T @ dlogits.reshape(-1, k)
        g["c"] = dlogits.sum(axis=(0, 1))
        dh = dlogits @ self.p["V"].T
        dx = self._back(x, keep, dh[:, :, :HIDDEN], tf, "f", g) + self._back(x, keep, dh[:, :, HIDDEN:], tb, "b", g)
        np.add.at(g["E"], ids.ravel(), dx.reshape(-1, EMBED))
        return float(loss), g

    def fit(self, windows: np.ndarray, letters: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 11) -> "ByteBiGru":
        """Adam over batches of windows, languages drawn evenly."""
        rng = np.random.default_rng(seed)
        of = [np.flatnonzero(y == k) for k in range(len(self.classes))]
        of = [x for x in of if len(x)]
        m, s = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(x, max(1, BATCH // len(of))) for x in of])
            _, g = self.gradients(windows[pick], y[pick], letters[pick])
            rate = RATE * (1 - 0.9 * step / steps)
            for k, v in g.items():
                np.clip(v, -1, 1, out=v)
                m[k] += 0.1 * (v - m[k])
                s[k] += 0.01 * (v * v - s[k])
                self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)
        return self

    def label(self, ids: np.ndarray) -> np.ndarray:
        """Language probabilities (position, sequence, class) of sequences laid out by (position, sequence).

        The same as :meth:`forward`, without a tape: byte tables stand for the input products, a sigmoid is a tangent.
        """
        length, n = ids.shape
        ids = ids.astype(np.intp)
        blank = [np.flatnonzero(row == 0) for row in ids]
        logits = np.empty((length, n, len(self.classes)), np.float32)
        two = np.empty((n, 2 * HIDDEN), np.float32)
        one, gate = np.empty((n, HIDDEN), np.float32), np.empty((n, 2 * HIDDEN), np.float32)
        c = np.empty((n, HIDDEN), np.float32)
        for d in "fb":
            table = (self.p["E"] @ self.p[f"Wx{d}"] + self.p[f"b{d}"]).astype(np.float32)
            wh = self.p[f"Wh{d}"].astype(np.float32)
            t2, t1 = np.ascontiguousarray(table[:, : 2 * HIDDEN]) / 2, np.ascontiguousarray(table[:, 2 * HIDDEN :])
            w2, w1 = np.ascontiguousarray(wh[:, : 2 * HIDDEN]) / 2, np.ascontiguousarray(wh[:, 2 * HIDDEN :]) / 2
            v = np.ascontiguousarray(self.p["V"][:HIDDEN] if d == "f" else self.p["V"][HIDDEN:], np.float32)
            h = np.zeros((n, HIDDEN), np.float32)
            for k in range(length) if d == "f" else range(length - 1, -1, -1):
                np.take(t2, ids[k], axis=0, out=two, mode="clip")
                np.dot(h, w2, out=gate)
                gate += two
                np.tanh(gate, out=gate)  # twice the gates, less one
                np.dot(h, w1, out=one)
                np.multiply(gate[:, HIDDEN:], one, out=c)
                c += one
                np.take(t1, ids[k], axis=0, out=one, mode="clip")
                c += one
                np.tanh(c, out=c)
                z = gate[:, :HIDDEN]
                z *= 0.5
                z += 0.5
                h -= c
                h *= z
                h += c
                if len(blank[k]):
                    h[blank[k]] = 0
                if d == "f":
                    np.dot(h, v, out=logits[k])
                else:
                    logits[k] += h @ v
        logits += self.p["c"].astype(np.float32)
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def pool(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: mean probabilities over the positions of its letters, and their number."""
        total, count = np.zeros((len(texts), len(self.classes))), np.zeros(len(texts), np.int64)
        parts = [bytes_of(t) for t in texts]
        size = np.array([len(raw) for raw, _ in parts], np.int64)
        windows = -(-size // CORE)
        room = windows * CORE + CONTEXT  # zeros after each text; the first context stands before all
        base = CONTEXT + np.cumsum(room) - room
        buf = np.zeros(CONTEXT + int(room.sum()) + CONTEXT, np.uint8)
        marks = np.zeros(len(buf), bool)
        for at, (raw, letter) in zip(base.tolist(), parts):
            buf[at : at + len(raw)] = raw
            marks[at : at + len(raw)] = letter
        doc = np.repeat(np.arange(len(texts)), windows)
        start = base[doc] + CORE * (np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows))
        core, span = np.arange(CORE)[:, None], np.arange(-CONTEXT, CORE + CONTEXT)[:, None]
        for k in range(0, len(doc), TOGETHER):
            at = start[k : k + TOGETHER]
            prob = self.label(buf[at + span])[CONTEXT : CONTEXT + CORE]
            mark = marks[at + core]
            own = np.einsum("lnk,ln->nk", prob, mark.astype(np.float32))
            np.add.at(total, doc[k : k + TOGETHER], own)
            np.add.at(count, doc[k : k + TOGETHER], mark.sum(axis=0))
        return total / np.maximum(count, 1)[:, None], count

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and probability of every text; of equal probabilities the first language in order of name."""
        fresh = list(dict.fromkeys(t for t in texts if t))
        mean, count = self.pool(fresh) if fresh else (np.zeros((0, 1)), np.zeros(0))
        of = {t: (self.classes[int(m.argmax())], float(min(1.0, m.max()))) if n else (UNDETERMINED, 0.0) for t, m, n in zip(fresh, mean, count)}
        return [of[t] if t else (UNDETERMINED, 0.0) for t in texts]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", holdout: tuple[int, int] = (3, 1), rows: int = SAMPLE_ROWS) -> ByteBiGru | None:
    """Fits the network on at most ``rows`` labelled rows outside the held-out fold, taken in the order of a hash of the id.

    Of each such row :data:`SAMPLE_WINDOWS` windows, evenly spaced over its whole text, are a bounded sample for
    fitting; predictions read whole texts. None if no row has a label and a letter.
    """
    usable = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (crc_of_id(id_col) % holdout[0] != holdout[1]))
    n = usable.count()
    pick = F.xxhash64(F.col(id_col), F.lit("fit"))
    if n > 4 * rows:  # so that a task hands over few more rows than are kept
        usable = usable.filter(F.pmod(pick, F.lit(n // (2 * rows))) == 0)
    windows = usable.select(pick.alias("k"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(_sampled, "k long, lang string, windows binary, letters binary")
    sample = windows.orderBy("k", "lang", "windows").limit(rows).collect()
    langs = sorted({r["lang"] for r in sample if r["windows"]})
    if not langs:
        return None
    shape = lambda x: np.frombuffer(b"".join(x), np.uint8).reshape(-1, WINDOW)
    y = np.repeat([langs.index(r["lang"]) for r in sample if r["windows"]], [len(r["windows"]) // WINDOW for r in sample if r["windows"]])
    return ByteBiGru(langs).fit(shape(r["windows"] for r in sample), shape(r["letters"] for r in sample), y)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole):
            found = [sample_windows(t) for t in b.column("text").to_pylist()]
            cols = [pa.array([b"".join(w[i] for w in own) for own in found], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("lang"), *cols], names=["k", "lang", "windows", "letters"])


def predict(docs: DataFrame, net: ByteBiGru | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns plus lang_pred and score; ``und`` and 0 for null texts, texts without a letter, or without a network."""
    schema = docs.select(*keep).schema
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(net)  # a few kB, fixed by EMBED and HIDDEN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for whole in batches:
            for batch in slices(whole, "__text"):
                texts = batch.column("__text").to_pylist()
                got = net.predict(texts) if net else [(UNDETERMINED, 0.0)] * len(texts)
                cols = [batch.column(i) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*names, "lang_pred", "score"])

    names = [*keep]
    out = schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, out)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score. Null ids hash as empty text; extra columns are ignored."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    net = train(plain)
    rows = plain.select("doc_id", (crc_of_id() % 3 == 1).alias("held_out"), "text")
    return predict(rows, net, ["doc_id", "held_out"])


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))


#: Documents below this score, or without a letter, are rejected by :func:`keep_identified`.
MIN_SCORE = 0.3


def keep_identified(docs: DataFrame) -> DataFrame:
    """Drops documents whose language can't be told; the others keep all their columns."""
    net = train(docs)
    tagged = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # clashing or odd names are out of the way
    at = docs.columns.index("text")
    scored = predict(tagged, net, tagged.columns, f"c{at}")
    kept = scored.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= MIN_SCORE))
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))

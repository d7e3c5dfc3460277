"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The network reads a text's UTF-8 bytes in windows of fixed length from both sides, labels every position with
language probabilities and pools them to the document's. It is trained by backpropagation through time on a
bounded sample of labelled windows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, named

HIDDEN = 8  # units a direction
WINDOW = 96  # bytes that the network reads from zero state
SAMPLE = 6000  # labelled windows at most, in all languages; beyond SHARED languages so many more as keep each one's share
STEPS = 300
BATCH = 192
SHARED = 64
UND = "und"
LETTER = r"\p{L}"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Direction:
    """One gated recurrent layer read in one direction; parameters by name in a dict of float arrays.

    z, r = sigmoid(x_zr + U_zr h);  c = tanh(x_c + r * (U_c h + b));  h = (1 - z) c + z h
    """

    @staticmethod
    def init(rng: np.random.Generator, hidden: int, p: str) -> dict[str, np.ndarray]:
        s = 1 / math.sqrt(hidden)
        return {p + "x": rng.normal(0, 0.3, (256, 3 * hidden)), p + "u": rng.normal(0, s, (hidden, 3 * hidden)), p + "b": np.zeros(hidden)}

    @staticmethod
    def forward(w: dict[str, np.ndarray], p: str, x: np.ndarray) -> tuple[np.ndarray, list]:
        """x: (time, rows) bytes -> states (time, rows, hidden) and what backpropagation needs."""
        hid = w[p + "b"].shape[0]
        h = np.zeros((x.shape[1], hid))
        out, kept = np.empty((*x.shape, hid)), []
        for t in range(len(x)):
            a = w[p + "x"][x[t]]
            u = h @ w[p + "u"]
            zr = _sigmoid(a[:, : 2 * hid] + u[:, : 2 * hid])
            z, r = zr[:, :hid], zr[:, hid:]
            q = u[:, 2 * hid :] + w[p + "b"]
            c = np.tanh(a[:, 2 * hid :] + r * q)
            kept.append((h, z, r, q, c))
            h = c + z * (h - c)
            out[t] = h
        return out, kept

    @staticmethod
    def backward(w: dict[str, np.ndarray], p: str, x: np.ndarray, kept: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients through time, from those of all states."""
        hid = w[p + "b"].shape[0]
        g = {p + k: np.zeros_like(w[p + k]) for k in "xub"}
        dh = np.zeros_like(d_out[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, q, c = kept[t]
            dh = dh + d_out[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * q * r * (1 - r)
            dq = dc * r
            da = np.concatenate([dz, dr, dc], axis=1)
            du = np.concatenate([dz, dr, dq], axis=1)
            np.add.at(g[p + "x"], x[t], da)
            g[p + "u"] += h.T @ du
            g[p + "b"] += dq.sum(axis=0)
            dh = dh * z + du @ w[p + "u"].T
        return g


def loss_and_gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted mean cross-entropy of all positions and its gradients. x: (time, rows); y, weight: (rows,)."""
    f, kf = Direction.forward(w, "f", x)
    b, kb = Direction.forward(w, "b", x[::-1])
    h = np.concatenate([f, b[::-1]], axis=2)
    s = h @ w["o"] + w["ob"]
    s -= s.max(axis=2, keepdims=True)
    prob = np.exp(s)
    prob /= prob.sum(axis=2, keepdims=True)
    rows = np.arange(len(y))
    scale = weight / (weight.sum() * len(x))
    loss = float(-(np.log(prob[:, rows, y] + 1e-12) * scale).sum())
    d = prob
    d[:, rows, y] -= 1
    d *= scale[None, :, None]
    g = {"o": np.tensordot(h, d, ([0, 1], [0, 1])), "ob": d.sum(axis=(0, 1))}
    dh = d @ w["o"].T
    hid = f.shape[2]
    g |= Direction.backward(w, "f", x, kf, dh[:, :, :hid])
    g |= Direction.backward(w, "b", x[::-1], kb, dh[::-1, :, hid:])
    return loss, g


def train(windows: np.ndarray, labels: np.ndarray, langs: int, hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on batches of windows (rows, time); languages weigh alike however many windows they have."""
    rng = np.random.default_rng(seed)
    w = Direction.init(rng, hidden, "f") | Direction.init(rng, hidden, "b") | {"o": rng.normal(0, 0.3, (2 * hidden, langs)), "ob": np.zeros(langs)}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    share = np.bincount(labels, minlength=langs).astype(float)
    weights = (1 / np.maximum(share, 1))[labels]
    for t in range(1, steps + 1):
        pick = rng.choice(len(windows), min(batch, len(windows)), replace=False)
        _, g = loss_and_gradients(w, windows[pick].T, labels[pick], weights[pick])
        norm = math.sqrt(sum(float((v * v).sum()) for v in g.values()))
        cut = min(1.0, 1.0 / (norm + 1e-12))
        for k in w:
            gk = g[k] * cut
            first[k] = 0.9 * first[k] + 0.1 * gk
            second[k] = 0.99 * second[k] + 0.01 * gk * gk
            w[k] -= rate * (1 - t / (steps + 1)) * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in w.items()}


class Reader:
    """Inference: rows of windows side by side, states as (units, rows), all in float32."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.hid = hid = w["fb"].shape[0]
        self.langs = w["ob"].shape[0]
        half = np.ones(3 * hid, np.float32)
        half[: 2 * hid] = 0.5  # sigmoid(x) = (1 + tanh(x / 2)) / 2
        self.x = {p: np.ascontiguousarray(w[p + "x"] * half) for p in "fb"}
        self.u = {p: np.ascontiguousarray((w[p + "u"] * half).T) for p in "fb"}
        self.b = {p: w[p + "b"][:, None] for p in "fb"}
        self.o = {"f": np.ascontiguousarray(w["o"][:hid].T), "b": np.ascontiguousarray(w["o"][hid:].T)}
        self.ob = w["ob"][:, None]

    def _scores(self, p: str, x: np.ndarray, out: np.ndarray) -> None:
        hid, rows = self.hid, x.shape[1]
        h, u, b = np.zeros((hid, rows), np.float32), self.u[p], self.b[p]
        table, o = self.x[p], self.o[p]
        g, a = np.empty((3 * hid, rows), np.float32), np.empty((rows, 3 * hid), np.float32)
        for t in range(len(x)) if p == "f" else range(len(x) - 1, -1, -1):
            np.take(table, x[t], axis=0, out=a, mode="clip")
            np.matmul(u, h, out=g)
            at = a.T
            zr = g[: 2 * hid]
            zr += at[: 2 * hid]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            q = g[2 * hid :]
            q += b
            q *= zr[hid:]
            q += at[2 * hid :]
            np.tanh(q, out=q)
            h -= q
            h *= zr[:hid]
            h += q
            out[t] += o @ h

    def positions(self, x: np.ndarray) -> np.ndarray:
        """(time, rows) bytes -> (time, languages, rows) probabilities."""
        s = np.empty((len(x), self.langs, x.shape[1]), np.float32)
        s[:] = self.ob
        self._scores("f", x, s)
        self._scores("b", x, s)
        s -= s.max(axis=1, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=1, keepdims=True)
        return s

    def documents(self, texts: list[bytes], window: int = WINDOW, rows: int = 1024) -> np.ndarray:
        """(documents, languages): means of the log probabilities of all positions, as probabilities.

        Texts are cut into windows from the start; the last window of a text ends with it and so may overlap
        the one before, whose positions then count once. Texts shorter than a window are padded with spaces,
        which do not count.
        """
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        n_win = -(-lens // window)
        doc = np.repeat(np.arange(len(texts)), n_win)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
        raw = np.frombuffer(b"".join(texts) + b" " * window, np.uint8)
        begin = np.cumsum(lens) - lens
        at = np.maximum(np.minimum(k * window, lens[doc] - window), 0)
        first = k * window - at  # positions before this were read by the window before
        last = np.minimum(window, lens[doc] - at)
        total = np.zeros((len(texts), self.langs))
        step = np.arange(window)
        for i in range(0, len(doc), rows):
            d, a = doc[i : i + rows], at[i : i + rows]
            x = raw[(begin[d] + a)[None, :] + step[:, None]]
            live = (step[:, None] >= first[i : i + rows]) & (step[:, None] < last[i : i + rows])
            x = np.where(step[:, None] < last[i : i + rows], x, np.uint8(32))
            logs = np.log(self.positions(x) + np.float32(1e-6))
            got = np.einsum("tlr,tr->rl", logs, live.astype(np.float32), optimize=False)
            np.add.at(total, d, got)
        mean = total / np.maximum(lens, 1)[:, None]
        e = np.exp(mean - mean.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def sample_windows(docs: DataFrame, held_out, sample: int = SAMPLE, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[np.ndarray, np.ndarray, list[str]]:
    """At most ``sample`` labelled windows, as many a language as there are, from hashed places of the texts.

    Every labelled language is learned: beyond SHARED of them the sample grows with their number.

    Documents are drawn by a hash of their id at rates that follow from the languages' counts. Only the
    windows reach the driver, so what does is bounded by that many times ``window`` characters.
    """
    known = docs.filter(F.col(lang).isNotNull() & ~held_out & F.col(text).rlike(LETTER))
    counts = dict(known.groupBy(lang).count().collect())
    langs = sorted(counts)
    if not langs:
        return np.zeros((0, window), np.uint8), np.zeros(0, np.int64), []
    sample = max(sample, -(-sample * len(langs) // SHARED))
    each = sample // len(langs)
    rates = {name: min(1.0, 1.5 * each / counts[name]) for name in langs}
    rate = F.element_at(F.create_map(*[F.lit(x) for pair in rates.items() for x in pair]), F.col(lang))
    order = F.xxhash64(F.lit("window"), F.col(doc_id).cast("string"), F.octet_length(text))
    place = F.pmod(F.xxhash64(F.lit("place"), F.col(doc_id).cast("string")), F.greatest(F.length(text) - window, F.lit(1))).cast("int")
    drawn = known.withColumn("_h", order).filter(F.pmod("_h", F.lit(1 << 30)) < rate * (1 << 30))
    rows = drawn.select(lang, F.substring(text, place + 1, F.lit(window)).alias("w"), "_h").orderBy("_h", lang, "w").limit(sample).collect()
    out = np.full((len(rows), window), 32, np.uint8)
    for i, r in enumerate(rows):
        b = np.frombuffer(r["w"].encode()[:window], np.uint8)
        out[i, : len(b)] = b
    return out, np.array([langs.index(r[lang]) for r in rows], np.int64), langs


def fit(docs: DataFrame, held_out, **columns) -> tuple[dict[str, np.ndarray], list[str]]:
    """The trained network and its languages; no languages where nothing is labelled."""
    windows, labels, langs = sample_windows(docs, held_out, **columns)
    if not langs or not len(windows):
        return {}, []
    return train(windows, labels, len(langs), steps=-(-STEPS * max(len(langs), SHARED) // SHARED)), langs


def predict(docs: DataFrame, model: tuple[dict[str, np.ndarray], list[str]], keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``(keep..., lang_pred, score)`` of every whole text; a text that is kept goes to Python once.

    Null texts and texts without a letter get ``und`` and 0.0, as does every text where nothing was learned.
    Repeated rows are labelled each; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    letter = F.coalesce(named(text).rlike(LETTER), F.lit(False))
    lean(docs.sparkSession)
    sent = keep if text in keep else (*keep, text)
    at = sent.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, langs = shared.value
        reader = Reader(w) if langs else None
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            ok = batch.column(len(sent)).to_pylist()
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size < 1 << 20):
                    size += len(texts[j] or b"")
                    j += 1
                use = [k for k in range(i, j) if ok[k] and reader is not None]
                pred, score = [UND] * (j - i), [0.0] * (j - i)
                if use:
                    prob = reader.documents([texts[k] for k in use])
                    for k, best, s in zip(use, prob.argmax(axis=1).tolist(), prob.max(axis=1).tolist()):
                        pred[k - i], score[k - i] = langs[best], s
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(len(keep))), pa.array(pred), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])
                i = j

    kinds = "".join("`" + c.replace("`", "``") + f"` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*map(named, sent), letter.alias("_letter")).mapInArrow(run, f"{kinds}lang_pred string, score double")


def is_held_out(doc_id: str = "doc_id"):
    """Whether the document's crc32 (of its id as text) modulo 4 is 2; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``: learned from the labelled documents that are not held out."""
    model = fit(docs, is_held_out())
    return predict(docs, model).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")

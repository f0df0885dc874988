"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks. A bidirectional LSTM in numpy reads each block's tag path and hashed
words and labels it as main text or not, in view of all blocks before and behind it. It is trained on made-up pages of
many layouts whose texts are drawn from a bounded sample of the corpus; no label of the corpus is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import blobs, free_name, plain, slices
from eventlens.llm.features import threshold
from eventlens.llm.html_blocks import PATH, WIDTH, Block, blocks, vectors
from eventlens.llm.html_layouts import MARKS, Layouts

#: Blocks of one batch of pages, and of one piece of a longer page.
BATCH = 4096


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, h: np.ndarray, c: np.ndarray, keep: bool = False) -> tuple:
    """Hidden states [time, rows, h] of inputs [time, rows, e] from a state (h, c), the state at the end, and with keep what learning needs."""
    n = h.shape[1]
    z = x @ w + b
    out, kept = np.empty((len(x), *h.shape), x.dtype), []
    for t in range(len(x)):
        a = z[t] + h @ u
        gates = _sigmoid(a[:, : 3 * n])
        i, f, o, g = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :], np.tanh(a[:, 3 * n :])
        before = (h, c)
        c = f * c + i * g
        d = np.tanh(c)
        h = o * d
        out[t] = h
        if keep:
            kept.append((i, f, o, g, d, *before))
    return out, (h, c), kept


def lstm_back(x: np.ndarray, w: np.ndarray, u: np.ndarray, kept: list, grad: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gradients of (x, w, u, b) from those of the hidden states."""
    dz = np.empty((*x.shape[:2], w.shape[1]), x.dtype)
    dh, dc, du = np.zeros_like(grad[0]), np.zeros_like(grad[0]), np.zeros_like(u)
    for t in range(len(x) - 1, -1, -1):
        i, f, o, g, d, h, c = kept[t]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - d * d)
        dz[t] = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * d * o * (1 - o), dc * i * (1 - g * g)], 1)
        du += h.T @ dz[t]
        dh, dc = dz[t] @ u.T, dc * f
    return dz @ w.T, _product(x, dz), du, dz.sum((0, 1))


def _product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum over time and rows of the outer products of two [time, rows, ...] arrays."""
    return x.reshape(-1, x.shape[2]).T @ y.reshape(-1, y.shape[2])


def _turned(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each column of [time, rows, ...] in reverse within its own size; what lies behind stays."""
    at = np.arange(len(x))[:, None]
    return x[np.where(at < size, size - 1 - at, at), np.arange(x.shape[1])]


@dataclass
class BlockLabeller:
    """Weights by name: e* of the input layer, f* and r* of the two directions, o* of the output."""

    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, inner: int = 32, hidden: int = 24, seed: int = 5, kind=np.float32) -> BlockLabeller:
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(kind)
        w = {"ew": (rng.standard_normal((WIDTH, inner)) * 0.1).astype(kind), "eb": np.zeros(inner, kind)}
        for d in "fr":
            bias = np.zeros(4 * hidden, kind)
            bias[hidden : 2 * hidden] = 1
            w |= {f"{d}w": draw(inner, 4 * hidden), f"{d}u": draw(hidden, 4 * hidden), f"{d}b": bias}
        return cls(w | {"ow": draw(2 * hidden + inner, 1), "ob": np.zeros(1, kind)})

    def _start(self, rows: int) -> tuple[np.ndarray, np.ndarray]:
        n = self.weights["fu"].shape[0]
        zero = np.zeros((rows, n), self.weights["fu"].dtype)
        return zero, zero

    def loss(self, x: np.ndarray, size: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of labels y [time, rows] of pages x [time, rows, width], and its gradients."""
        w = self.weights
        e = np.tanh(x @ w["ew"] + w["eb"])
        back = _turned(e, size)
        hf, _, kf = lstm(e, w["fw"], w["fu"], w["fb"], *self._start(x.shape[1]), keep=True)
        hr, _, kr = lstm(back, w["rw"], w["ru"], w["rb"], *self._start(x.shape[1]), keep=True)
        joint = np.concatenate([hf, _turned(hr, size), e], 2)
        logit = (joint @ w["ow"])[..., 0] + w["ob"]
        real = np.arange(len(x))[:, None] < size
        total = np.where(real, np.logaddexp(0, logit) - y * logit, 0).sum() / real.sum()
        d = (np.where(real, _sigmoid(logit) - y, 0) / real.sum())[..., None].astype(x.dtype)
        out = {"ow": _product(joint, d), "ob": d.sum((0, 1))}
        dj, n = d @ w["ow"].T, hf.shape[2]
        de, out["fw"], out["fu"], out["fb"] = lstm_back(e, w["fw"], w["fu"], kf, dj[..., :n])
        db, out["rw"], out["ru"], out["rb"] = lstm_back(back, w["rw"], w["ru"], kr, _turned(dj[..., n : 2 * n], size))
        de = (de + _turned(db, size) + dj[..., 2 * n :]) * (1 - e * e)
        out["ew"], out["eb"] = _product(x, de), de.sum((0, 1))
        return float(total), out

    def _inner(self, found: list[Block]) -> np.ndarray:
        return np.tanh(vectors(found) @ self.weights["ew"] + self.weights["eb"])

    def _long(self, found: list[Block]) -> np.ndarray:
        """Logits of one page of any length, piece by piece; each direction carries its state over."""
        w, cuts = self.weights, range(0, len(found), BATCH)
        hf, state = [], self._start(1)
        for i in cuts:
            h, state, _ = lstm(self._inner(found[i : i + BATCH])[:, None], w["fw"], w["fu"], w["fb"], *state)
            hf.append(h[:, 0])
        out, state = [None] * len(hf), self._start(1)
        for k in reversed(range(len(hf))):
            e = self._inner(found[cuts[k] : cuts[k] + BATCH])
            h, state, _ = lstm(e[::-1, None], w["rw"], w["ru"], w["rb"], *state)
            out[k] = np.concatenate([hf[k], h[::-1, 0], e], 1) @ w["ow"][:, 0] + w["ob"]
        return np.concatenate(out) if out else np.zeros(0)

    def logits(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """A logit for each block of each page: above 0 it is main text. Pages of like length go together."""
        w, out = self.weights, [np.zeros(0)] * len(pages)
        order = sorted((len(p), i) for i, p in enumerate(pages) if p)
        while order:
            size, i = order[-1]
            if size > BATCH:
                out[i] = self._long(pages[i])
                order.pop()
                continue
            take = order[-max(1, BATCH // size) :]
            del order[-len(take) :]
            n, at = np.array([s for s, _ in take]), [i for _, i in take]
            flat = self._inner([b for i in at for b in pages[i]])
            e = np.zeros((size, len(at), flat.shape[1]), flat.dtype)
            rows = np.repeat(np.arange(len(at)), n)
            times = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            e[times, rows] = flat
            hf = lstm(e, w["fw"], w["fu"], w["fb"], *self._start(len(at)))[0]
            hr = _turned(lstm(_turned(e, n), w["rw"], w["ru"], w["rb"], *self._start(len(at)))[0], n)
            logit = (np.concatenate([hf, hr, e], 2) @ w["ow"])[..., 0] + w["ob"]
            for j, i in enumerate(at):
                out[i] = logit[: n[j], j]
        return out

    def main_text(self, pages: list[list[Block]]) -> list[tuple[str, int]]:
        """(main text, its blocks) of pages."""
        out = []
        for page, logit in zip(pages, self.logits(pages), strict=True):
            kept = [b.text for b, keep in zip(page, logit > 0, strict=True) if keep]
            out.append(("\n\n".join(kept), len(kept)))
        return out


def labelled(page: str) -> tuple[list[Block], np.ndarray]:
    """Blocks of a made-up page without their marks, and their labels."""
    found, y = [], []
    for b in blocks(page):
        label = b.text[0] == MARKS[1]
        text = " ".join(b.text.replace(MARKS[0], "").replace(MARKS[1], "").split())
        if text:
            found.append(b._replace(text=text, linked=min(b.linked, len(text))))
            y.append(label)
    return found, np.array(y, np.float32)


def fit_labeller(pool: list[str], made_up: int = 2500, epochs: int = 12, batch: int = 24, rate: float = 0.006, seed: int = 5) -> BlockLabeller:
    """Train on made-up pages with texts of pool, by Adam; the same for the same pool."""
    layouts = Layouts(seed, pool)
    made = sorted((labelled(layouts.page()) for _ in range(made_up)), key=lambda p: len(p[0]))
    made = [p for p in made if len(p[0])]
    data = []
    for i in range(0, len(made), batch):  # pages of like length together
        group = made[i : i + batch]
        size = np.array([len(b) for b, _ in group])
        x, y = np.zeros((size.max(), len(group), WIDTH), np.float32), np.zeros((size.max(), len(group)), np.float32)
        for j, (b, label) in enumerate(group):
            x[: len(b), j], y[: len(b), j] = vectors(b), label
        data.append((x, size, y))
    model, rng, t = BlockLabeller.fresh(seed=seed), np.random.default_rng(seed), 0
    m = {k: np.zeros_like(v) for k, v in model.weights.items()}
    v = {k: np.zeros_like(x) for k, x in model.weights.items()}
    for epoch in range(epochs):
        for i in rng.permutation(len(data)):
            x, size, y = data[i]
            # of some blocks the path is hidden, of others words and shape, so that each part and the neighbours count
            hidden, x = rng.random(x.shape[:2]), x * (rng.random(x.shape, dtype=np.float32) > 0.05)
            x[hidden < 0.05, :PATH] = 0
            x[hidden > 0.65, PATH:] = 0
            _, grad = model.loss(x, size, y)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            t += 1
            step = rate * (1 - epoch / epochs)
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                model.weights[k] = (model.weights[k] - step * m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return model


def train_labeller(pages: DataFrame, most: int = 300, chars: int = 400, html_col: str = "html", **how) -> BlockLabeller:
    """A labeller whose made-up pages draw texts from the blocks of at most `most` pages, those of least hash.

    Of each such page up to 40 blocks lend their first `chars` code points: the sample is bounded, and only what is
    learned depends on it. Null and empty pages lend nothing; without any text words are made of syllables.
    """
    n = pages.where(F.col(html_col).isNotNull()).count()
    h = F.xxhash64(F.lit(17), F.col(html_col))
    rows = pages.where(F.col(html_col).isNotNull()).select(h.alias("h"), F.col(html_col).alias("html")).where(F.col("h") <= threshold(2 * most, n))

    def run(batches):
        for b in slices(batches, "html", 4 << 20):
            texts = []
            for page in blobs(b.column("html")):
                found = [x.text[:chars] for x in blocks(page.decode("utf-8", "replace"))]
                texts.append(found[:: max(1, len(found) // 40)][:40])
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(texts, pa.list_(pa.string()))], ["h", "texts"])

    # repeated pages have one hash and are taken once; an empty row keeps the task alive without any
    lent = rows.mapInArrow(run, "h long, texts array<string>").dropDuplicates(["h"]).orderBy("h").limit(most)
    lent = lent.unionByName(pages.sparkSession.range(1).select(F.lit(None).cast("long").alias("h"), F.array().cast("array<string>").alias("texts")))

    def fit(batches):
        """In one task, which may be run again elsewhere; numpy has one thread there."""
        texts = [(h, t) for b in batches for h, t in zip(b.column("h").to_pylist(), b.column("texts").to_pylist(), strict=True) if h is not None]
        model = fit_labeller([t for _, found in sorted(texts) for t in found], **how)
        names = sorted(model.weights)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([list(model.weights[k].shape) for k in names], pa.list_(pa.int64())), pa.array([model.weights[k].tobytes() for k in names], pa.binary())], ["name", "shape", "data"])

    found = lent.repartition(1).mapInArrow(fit, "name string, shape array<long>, data binary").collect()
    return BlockLabeller({r["name"]: np.frombuffer(r["data"], np.float32).reshape(r["shape"]) for r in found})


def extract_main_text(pages: DataFrame, model: BlockLabeller, html_col: str = "html") -> DataFrame:
    """pages with main_text, n_chars, n_blocks and n_main_blocks added (each under a free name).

    A page's main blocks stand in page order, joined by two line feeds; none give an empty text, as do null, empty and
    blank pages. Pages of any length are read whole, labelled in pieces whose states carry over. Rows may repeat, and an
    empty table gives no rows.
    """
    extra = {free_name(pages, "main_text"): "string", free_name(pages, "n_chars"): "long", free_name(pages, "n_blocks"): "long", free_name(pages, "n_main_blocks"): "long"}
    schema = pages.withColumns({k: F.lit(None).cast(v) for k, v in extra.items()}).schema
    arrow, names = plain(schema), pages.columns

    def run(batches):
        for b in slices(batches, html_col, 4 << 20):
            found = [blocks((page or b"").decode("utf-8", "replace")) for page in blobs(b.column(html_col))]
            text = model.main_text(found)
            new = [[t for t, _ in text], [len(t) for t, _ in text], [len(p) for p in found], [n for _, n in text]]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array(v, f.type) for v, f in zip(new, list(arrow)[len(names) :], strict=True))], schema=arrow)

    return pages.mapInArrow(run, schema)


def op11_html_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = extract_main_text(pages, train_labeller(pages))
    return found.select("page_id", "url", F.col("main_text").alias("text"), "n_chars", "n_blocks", "n_main_blocks")

"""Language identification by a byte convolutional network, trained here in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter's largest response in a
window goes through a linear layer and a softmax. The filters of all widths lie in one matrix of the largest width,
the places beyond a filter's own width held at zero. A text is cut into windows that cover all of it, and its
prediction is the mean of the windows' logits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellate.llm.common import bounded_batches, by_bytes

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 8  # of each width
EMBED = 6
#: The bound of the training sample: documents of each language, and windows of each of them.
TRAIN_DOCS, TRAIN_WINDOWS = 500, 4
EPOCHS, BATCH, RATE = 6, 64, 0.01
CHUNK = 256


def windows(text: bytes) -> np.ndarray:
    """Rows of WINDOW bytes that cover the text, the last one filled up with zeros."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, WINDOW)


class ByteCNN:
    def __init__(self, labels: list[str], seed: int = 42):
        rng = np.random.default_rng(seed)
        self.labels, self.wide = labels, max(WIDTHS)
        n = FILTERS * len(WIDTHS)
        own = np.repeat(WIDTHS, FILTERS)
        self.mask = (np.arange(self.wide)[:, None, None] < own).astype(np.float32) * np.ones((1, EMBED, 1), np.float32)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "conv": (rng.normal(0, 1, (self.wide, EMBED, n)) / np.sqrt(own * EMBED)).astype(np.float32) * self.mask,
            "bias": np.zeros(n, np.float32),
            "out": (rng.normal(0, 1, (n, len(labels))) / np.sqrt(n)).astype(np.float32),
            "shift": np.zeros(len(labels), np.float32),
        }

    def _responses(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place, wide * EMBED) inputs and (window, place, filter) responses."""
        padded = np.zeros((len(rows), WINDOW + self.wide - 1), np.uint8)
        padded[:, :WINDOW] = rows
        x = np.ascontiguousarray(self.p["embed"][padded])
        s = x.strides
        seen = np.lib.stride_tricks.as_strided(x, (len(rows), WINDOW, self.wide * EMBED), (s[0], s[1], s[2]))
        flat = np.ascontiguousarray(seen).reshape(-1, self.wide * EMBED)
        return flat.reshape(seen.shape), (flat @ self.p["conv"].reshape(self.wide * EMBED, -1)).reshape(len(rows), WINDOW, -1)

    def logits(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), len(self.labels)), np.float32)
        for i in range(0, len(rows), CHUNK):
            top = self._responses(rows[i : i + CHUNK])[1].max(axis=1)
            out[i : i + CHUNK] = np.maximum(top + self.p["bias"], 0) @ self.p["out"] + self.p["shift"]
        return out

    def gradients(self, rows: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        seen, z = self._responses(rows)
        at = z.argmax(axis=1)
        w, f = np.arange(len(rows))[:, None], np.arange(z.shape[2])[None, :]
        pre = z[w, at, f] + self.p["bias"]
        act = np.maximum(pre, 0)
        score = act @ self.p["out"] + self.p["shift"]
        prob = np.exp(score - score.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        d = prob
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        back = (d @ self.p["out"].T) * (pre > 0)
        fields = seen[w, at]  # window, filter, wide * EMBED
        conv = np.einsum("nf,nfk->kf", back, fields).reshape(self.p["conv"].shape) * self.mask
        kernel = self.p["conv"].reshape(-1, z.shape[2]).T
        to_embed = (back[:, :, None] * kernel[None]).reshape(len(rows), z.shape[2], self.wide, EMBED)
        padded = np.zeros((len(rows), WINDOW + self.wide - 1), np.uint8)
        padded[:, :WINDOW] = rows
        read = padded[w[:, :, None], at[:, :, None] + np.arange(self.wide)]
        embed = np.zeros_like(self.p["embed"])
        np.add.at(embed, read, to_embed)
        return {"embed": embed, "conv": conv, "bias": back.sum(0), "out": act.T @ d, "shift": d.sum(0)}

    def fit(self, rows: np.ndarray, y: np.ndarray, seed: int = 42) -> None:
        """Adam over shuffled batches."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for i in range(0, len(rows), BATCH):
                step += 1
                for k, g in self.gradients(rows[order[i : i + BATCH]], y[order[i : i + BATCH]]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The label of each text and its probability."""
        rows = [windows(t) for t in texts]
        starts = np.cumsum([0, *map(len, rows)])
        logits = self.logits(np.concatenate(rows))
        mean = np.add.reduceat(logits, starts[:-1], axis=0) / np.diff(starts)[:, None]
        prob = np.exp(mean - mean.max(axis=1, keepdims=True)).astype(np.float64)
        prob /= prob.sum(axis=1, keepdims=True)
        best = prob.argmax(axis=1)
        return [self.labels[i] for i in best], prob[np.arange(len(best)), best]


def held_out(id_col: str):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, train_windows: int = TRAIN_WINDOWS) -> ByteCNN | None:
    """A network from documents that are not held out and have a language: of each language the `train_docs` different
    texts with the least hashes, of each of those `train_windows` windows spread over all of it. None without any."""
    usable = docs.filter(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    known = usable.select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["n"] for r in known.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    labels = sorted(sizes)
    least = F.lit(None).cast("double")
    for lang in labels:
        least = F.when(F.col("lang") == lang, F.lit(2.0 * min(1.0, 2 * train_docs / sizes[lang]) - 1)).otherwise(least)

    def run(batches):
        for b in by_bytes(batches, "text"):
            rows = []
            for lang, h, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                w = windows(t.encode())
                full = w[:-1] if len(w) > 1 else w
                rows += [(lang, h, full[k * len(full) // n].tobytes()) for n in [min(train_windows, len(full))] for k in range(n)]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["lang", "h", "row"])

    sample = bounded_batches(known).filter(F.col("h") / F.lit(float(1 << 63)) <= least).mapInArrow(run, "lang string, h long, row binary").distinct()  # copies of a text are one before anything is gathered
    by: dict[str, dict[int, list[bytes]]] = {lang: {} for lang in labels}
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["h"], r["row"])):
        by[r["lang"]].setdefault(r["h"], []).append(bytes(r["row"]))
    rows, y = [], []
    for k, lang in enumerate(labels):
        for h in sorted(by[lang])[:train_docs]:
            got = by[lang][h][:train_windows]
            rows += got
            y += [k] * len(got)
    net = ByteCNN(labels)
    net.fit(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, WINDOW), np.array(y))
    return net


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row for each row of `docs`: the id, held_out, lang_pred and score (0 to 1).

    lang_pred is `und` with score 0 where the text is null or has no letter, and everywhere if there is nothing to
    learn from. Whole texts are read; the language, the source and the id are no inputs. A null id is not held out and
    not learned from. Equal texts get equal predictions; of equally probable languages the first by name is given.
    Texts of any length are read whole, in windows; an empty table gives no rows; columns that aren't named are not read.
    """
    net = train(docs, id_col, text_col, lang_col, train_docs)
    src = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = sent.value
        for b in by_bytes(batches, "text"):
            texts = b.column(2).to_pylist()
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            real = [i for i, t in enumerate(texts) if net is not None and t and any(map(str.isalpha, t))]  # isalpha: the letters of \\p{L}
            if real:
                found, prob = net.predict([texts[i].encode() for i in real])
                scores[real] = prob
                for i, lang in zip(real, found, strict=True):
                    langs[i] = lang
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores)], ["id", "held_out", "lang_pred", "score"])

    return bounded_batches(src).mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)

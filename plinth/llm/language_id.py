"""Language identification with a convolutional network over bytes.

Filters of several widths slide over the bytes of fixed-length windows; the largest
response of each filter goes through a softmax.  The network is trained in numpy on the
driver, on windows of a bounded sample of labelled texts (``per_language`` texts of each
language, ``max_rows`` in all).  It is applied to every window of the whole text; a text's
language is the largest mean probability.  Embedding and filter weights are multiplied out
beforehand, so a response is a sum of table rows for byte pairs and single bytes.

Defined results: null text, empty text and text without a letter are ``und`` with score 0;
so is every text if nothing can be learned; texts shorter than a window are padded with
zero bytes; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.shared import bounded_batches, texts_of

WINDOW = 256
WIDTHS = (2, 3, 4)
# The sample of a language is drawn in this many parts first, so that no task meets a whole language.
SALTS = 64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def windows_of(text: str) -> np.ndarray:
    """All windows of a text, the last padded with zeros."""
    data = text.encode("utf-8", "surrogatepass").translate(_LOWER)
    data += bytes(-len(data) % WINDOW)
    return np.frombuffer(data, np.uint8).reshape(-1, WINDOW)


@dataclass
class Network:
    languages: list[str]
    pairs: list[np.ndarray]  # for each width, tables of byte pairs: (65536, filters)
    singles: list[np.ndarray | None]  # and for odd widths of the last byte: (256, filters)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def probabilities(self, windows: np.ndarray, step: int = 256) -> np.ndarray:
        found = [self._some(windows[i : i + step]) for i in range(0, len(windows), step)]
        return np.concatenate(found) if found else np.zeros((0, len(self.languages)))

    def _some(self, windows: np.ndarray) -> np.ndarray:
        wide = windows.astype(np.int32)
        pair = wide[:, :-1] * 256 + wide[:, 1:]
        peaks = []
        for k, width in enumerate(WIDTHS):
            n = WINDOW - width + 1
            response = self.pairs[k][0][pair[:, :n]]
            for j, table in enumerate(self.pairs[k][1:], 1):
                response += table[pair[:, 2 * j : 2 * j + n]]
            if self.singles[k] is not None:
                response += self.singles[k][wide[:, width - 1 : width - 1 + n]]
            peaks.append(response.max(axis=1))
        hidden = np.maximum(np.concatenate(peaks, 1) + self.bias, 0)
        return _softmax(hidden @ self.out + self.out_bias)

    def label(self, texts: list[str]) -> tuple[list[str], list[float]]:
        parts = [windows_of(t) for t in texts]
        p = self.probabilities(np.concatenate(parts)) if self.languages and parts else np.zeros((0, 1))
        languages, scores, at = [], [], 0
        for text, part in zip(texts, parts):
            mean = p[at : at + len(part)].mean(axis=0) if self.languages and len(part) else None
            at += len(part)
            if mean is None or not any(map(str.isalpha, text)):
                languages.append("und")
                scores.append(0.0)
            else:
                best = int(mean.argmax())
                languages.append(self.languages[best])
                scores.append(float(min(1.0, mean[best])))
        return languages, scores


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(
    windows: np.ndarray, labels: np.ndarray, languages: list[str], filters: int = 16, size: int = 8, epochs: int = 5,
    batch: int = 64, rate: float = 0.01, seed: int = 7,
) -> Network:
    """Adam on the cross-entropy; through the pooling only the largest response of a filter passes a gradient."""
    rng = np.random.default_rng(seed)
    n_out = max(1, len(languages))
    p = {
        "embed": rng.normal(0, 0.5, (256, size)),
        **{f"w{w}": rng.normal(0, (2 / (w * size)) ** 0.5, (w, size, filters)) for w in WIDTHS},
        "bias": np.zeros(len(WIDTHS) * filters),
        "out": rng.normal(0, 0.2, (len(WIDTHS) * filters, n_out)),
        "out_bias": np.zeros(n_out),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    mean = {k: np.zeros_like(v) for k, v in p.items()}
    square = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(epochs if len(languages) > 1 else 0):
        order = rng.permutation(len(windows))
        for chosen in np.array_split(order, max(1, len(order) // batch)):
            x, rows = windows[chosen], np.arange(len(chosen))[:, None]
            vectors = p["embed"][x]
            peak, place = [], []
            for w in WIDTHS:
                n = WINDOW - w + 1
                response = sum(vectors[:, j : j + n] @ p[f"w{w}"][j] for j in range(w))
                place.append(response.argmax(axis=1))
                peak.append(np.take_along_axis(response, place[-1][:, None], 1)[:, 0])
            before = np.concatenate(peak, 1) + p["bias"]
            hidden = np.maximum(before, 0)
            error = _softmax(hidden @ p["out"] + p["out_bias"])
            error[np.arange(len(chosen)), labels[chosen]] -= 1
            error /= len(chosen)
            back = (error @ p["out"].T) * (before > 0)
            grad = {"out": hidden.T @ error, "out_bias": error.sum(0), "bias": back.sum(0), "embed": np.zeros_like(p["embed"])}
            for k, w in enumerate(WIDTHS):
                own = back[:, k * filters : (k + 1) * filters]
                grad[f"w{w}"] = np.zeros_like(p[f"w{w}"])
                for j in range(w):
                    at = x[rows, place[k] + j]
                    grad[f"w{w}"][j] = np.einsum("bf,bfd->df", own, p["embed"][at])
                    np.add.at(grad["embed"], at, own[:, :, None] * p[f"w{w}"][j].T[None])
            step += 1
            for name, g in grad.items():
                mean[name] += 0.1 * (g - mean[name])
                square[name] += 0.001 * (g * g - square[name])
                speed = rate * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                p[name] = (p[name] - speed * mean[name] / (np.sqrt(square[name]) + 1e-8)).astype(np.float32)
    # Multiply out: a pair of bytes a, b contributes embed[a] @ w[j] + embed[b] @ w[j + 1].
    pairs, singles = [], []
    for w in WIDTHS:
        byte = [p["embed"] @ p[f"w{w}"][j] for j in range(w)]
        pairs.append([(byte[j][:, None] + byte[j + 1][None]).reshape(65536, filters) for j in range(0, w - 1, 2)])
        singles.append(byte[-1] if w % 2 else None)
    return Network(languages, pairs, singles, p["bias"], p["out"], p["out_bias"])


def fit(
    docs: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", per_language: int = 1500, max_rows: int = 20_000, windows_each: int = 2,
) -> Network:
    """Learn from at most ``windows_each`` windows, spread over the text, of each sampled text."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    if usable is not None:
        known = known.where(usable)
    order = F.xxhash64(id_col)
    slim = known.select(F.col(id_col).alias("_li_id"), F.col(lang_col).alias("_li_lang"), order.alias("_li_h"))

    def rank(*parts) -> Column:
        return F.row_number().over(Window.partitionBy("_li_lang", *parts).orderBy("_li_h", "_li_id"))

    # A part gives twice its share and a few more, so the parts together hold enough.
    salted = slim.withColumn("_li_rank", rank(F.pmod("_li_h", F.lit(SALTS))))
    salted = salted.where(F.col("_li_rank") <= 2 * per_language // SALTS + 8)
    ranked = salted.withColumn("_li_rank", rank())
    sample = ranked.where(F.col("_li_rank") <= per_language).orderBy("_li_rank", "_li_h").limit(max_rows)
    chosen = known.select(F.col(id_col).alias("_li_id"), F.col(lang_col).alias("_li_lang"), F.col(text_col).alias("_li_text")).join(
        F.broadcast(sample.select("_li_id").distinct()), "_li_id"  # at most max_rows ids
    )
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, text in zip(batch.column("_li_lang").to_pylist(), texts_of(batch, "_li_text")):
                parts = windows_of(text)
                for i in np.unique(np.linspace(0, len(parts) - 1, windows_each).astype(int)) if len(parts) else ():
                    rows.append((lang, parts[i].tobytes()))
            columns = list(zip(*rows)) or [(), ()]
            yield pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary())], ["lang", "window"])

    rows = sorted((r["lang"], bytes(r["window"])) for r in chosen.mapInArrow(run, "lang string, window binary").collect())
    languages = sorted({lang for lang, _ in rows})
    number = {lang: i for i, lang in enumerate(languages)}
    windows = np.frombuffer(b"".join(w for _, w in rows), np.uint8).reshape(-1, WINDOW)
    return train(windows, np.array([number[lang] for lang, _ in rows], int), languages)


def identify(docs: DataFrame, network: Network, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of every row (all by default), with ``lang_pred`` and ``score``."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(network)  # tables of fixed size
    bounded_batches(docs.sparkSession)
    own = text_col in names  # then it need not travel twice
    source = docs.select(*names, *([] if own else [F.col(text_col).alias("_li_text")]))
    column = text_col if own else "_li_text"
    carried = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields if f.name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, scores = shared.value.label(texts_of(batch, column))
            yield pa.record_batch({
                **{c: batch.column(c) for c in names},
                "lang_pred": pa.array(languages, pa.string()), "score": pa.array(scores, pa.float64()),
            })

    return source.mapInArrow(run, carried + "lang_pred string, score double")

"""Language identification by a byte convolutional network.

Windows of fixed length over the whole UTF-8 text pass an embedding, filters of several widths, a
maximum over each window's places and a softmax. Training is numpy alone, on windows drawn from
labelled texts; a document's score is the mean probability over its windows.

The trainer sees at most ``WINDOWS`` windows a language (a documented bound on the sample), drawn
evenly over whole texts by hash. Prediction covers every byte. Null texts and texts without a letter
are `und` with score 0; ties go to the first language by code point; without any labelled text every
text is `und`; equal texts get equal results."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import flat, slices

WINDOW, WIDTHS, FILTERS, EMBEDDING = 256, (2, 3, 4, 5), 8, 12
WINDOWS, EPOCHS, RATE, MAX_LANGUAGES = 600, 12, 0.01, 1000
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    languages: list[str]
    tables: list[list[np.ndarray]]  # for each width and place: what a byte adds to the filters
    biases: list[np.ndarray]
    dense: np.ndarray
    offset: np.ndarray

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Softmax for rows of WINDOW bytes."""
        pooled = []
        for table, bias in zip(self.tables, self.biases):
            w = len(table)
            total = table[0][windows[:, : WINDOW - w + 1]]
            for j in range(1, w):
                total += table[j][windows[:, j : WINDOW - w + 1 + j]]
            pooled.append(np.maximum(total.max(axis=1) + bias, 0))
        z = np.concatenate(pooled, axis=1) @ self.dense + self.offset
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows over each row's bytes and their rows; the last is filled with zero bytes."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    rows = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = offsets[rows] + nth * WINDOW
    index = at[:, None] + np.arange(WINDOW)
    inside = index < offsets[rows + 1][:, None]
    return np.where(inside, data[np.minimum(index, max(0, len(data) - 1))], 0).astype(np.uint8) if len(rows) else np.zeros((0, WINDOW), np.uint8), rows


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """Adam on cross-entropy; each filter's gradient flows to the window place that held its maximum."""
    rng = np.random.default_rng(seed)
    n, k = len(windows), len(languages)
    emb = rng.normal(0, 0.3, (256, EMBEDDING)).astype(np.float32)
    filters = [rng.normal(0, 0.3, (w, EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS]
    biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    dense = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), k)).astype(np.float32)
    offset = np.zeros(k, np.float32)
    params = [emb, *filters, *biases, dense, offset]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(n), max(1, n // 64)):
            x, y = windows[rows], labels[rows]
            m = len(rows)
            pooled, places = [], []
            for f, b in zip(filters, biases):
                w = len(f)
                total = sum((emb @ f[j])[x[:, j : WINDOW - w + 1 + j]] for j in range(w))
                at = total.argmax(axis=1)
                pooled.append(np.take_along_axis(total, at[:, None, :], 1)[:, 0] + b)
                places.append(at)
            raw = np.concatenate(pooled, axis=1)
            hidden = np.maximum(raw, 0)
            z = hidden @ dense + offset
            e = np.exp(z - z.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            p[np.arange(m), y] -= 1
            p /= m
            grads = [np.zeros_like(emb)] + [np.zeros_like(f) for f in filters] + [np.zeros_like(b) for b in biases] + [hidden.T @ p, p.sum(axis=0)]
            back = (p @ dense.T) * (raw > 0)
            for i, f in enumerate(filters):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                grads[1 + len(filters) + i] = g.sum(axis=0)
                for j in range(len(f)):
                    bytes_ = x[np.arange(m)[:, None], places[i] + j]  # m x FILTERS
                    grads[1 + i][j] = np.einsum("mfe,mf->ef", emb[bytes_], g)
                    np.add.at(grads[0], bytes_, g[:, :, None] * f[j].T[None])
            step += 1
            for q, g, (a, b) in zip(params, grads, moments):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    tables = [[(emb @ f[j]).astype(np.float32) for j in range(len(f))] for f in filters]
    return Network(languages, tables, biases, dense, offset)


def fit(docs: DataFrame, learn: Column, windows: int = WINDOWS) -> Network | None:
    """Trains on the rows for which ``learn`` holds and that have a text and a lang; the sample is bounded by ``windows`` a language in expectation and cut at twice that."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "doc_id", F.col("text").cast("binary").alias("text"))
    rows = rows.withColumn("n", F.ceil(F.octet_length("text") / WINDOW))
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum("n").alias("n")).limit(MAX_LANGUAGES + 1).collect() if r["n"]}
    if not totals:
        return None
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    shares = F.create_map(*[x for a, n in totals.items() for x in (F.lit(a), F.lit(min(1.0, windows / n)))])
    drawn = rows.where("n > 0").withColumn("share", shares[F.col("lang")]).withColumn("nth", F.explode(F.expr("sequence(0L, n - 1)")))
    drawn = drawn.where(F.pmod(F.xxhash64("doc_id", "nth", F.lit("langid")), F.lit(1 << 40)) < F.col("share") * float(1 << 40))
    # a bound for tables in which rows repeat: the least hashes of each language
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id", "nth", F.lit("place")), "doc_id", "nth", "text"))
    drawn = drawn.withColumn("place", place).where(F.col("place") <= 2 * windows)
    got = drawn.select("lang", F.expr(f"substring(text, cast(nth * {WINDOW} + 1 as int), {WINDOW})").alias("w")).toArrow()
    langs = sorted(totals)
    pairs = sorted(zip(got["lang"].to_pylist(), got["w"].to_pylist()))  # the same order in each run
    x = np.zeros((len(pairs), WINDOW), np.uint8)
    for i, (_, w) in enumerate(pairs):
        x[i, : len(w)] = np.frombuffer(w, np.uint8)
    y = np.array([langs.index(a) for a, _ in pairs])
    return train(x, y, langs)


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """docs with lang_pred and score."""
    model = docs.sparkSession.sparkContext.broadcast(network)  # its size depends on the number of languages alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            text = batch.column("text")
            data, offsets = flat(text)
            for i, j in slices(offsets, 1 << 18):
                part = batch.slice(i, j - i)
                letters = np.array([bool(_LETTER.search(t)) for t in part.column("text").fill_null("").to_pylist()])
                lang, score = np.full(j - i, "und", object), np.zeros(j - i)
                own = offsets[i : j + 1] - offsets[i]
                if net and letters.any():
                    w, rows = windows_of(data[offsets[i] : offsets[j]], own)
                    p = np.zeros((j - i, len(net.languages)))
                    for a in range(0, len(w), 512):
                        np.add.at(p, rows[a : a + 512], net.probabilities(w[a : a + 512]))
                    p /= np.maximum(1, np.bincount(rows, minlength=j - i))[:, None]
                    best = p.argmax(axis=1)
                    lang = np.where(letters, np.array(net.languages, object)[best], "und")
                    score = np.where(letters, np.clip(p.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang.tolist(), pa.string()), pa.array(score)], [*part.schema.names, "lang_pred", "score"])

    kept = docs.drop("lang_pred", "score")
    return kept.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", lang_pred string, score double")

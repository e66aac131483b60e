"""Token counts of all texts by regression, corrected by tokenized holdouts.

For each language a bounded sample of texts is tokenized. On one third a least-squares model from counted features
(bytes, words, digits, punctuation, white space, code points of each script) to tokens is fitted, each text weighted by
1 / bytes, as the error grows with length. On the second, the holdout, the ratio of true to predicted totals is measured,
and every prediction is multiplied by it. The third tells the error of what comes out. The features of all texts are then counted, whole, and
the models applied; no text outside the sample is tokenized.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import shingles as S
from millrace.llm.tokenizers import VOCABULARY, counter
from millrace.shared import bounded, cut

#: Classes of bytes, by the byte and the one before it. A multi-byte code point counts at its second byte.
CLASSES = (
    "word_start", "lower", "upper_start", "upper", "hump", "digit_start", "digit", "mark_start", "mark", "underscore", "space", "space_run",
    "newline", "newline_run", "lead", "tail", "latin", "greek_cyrillic", "arabic", "indic", "thai", "kana", "han", "wide_mark", "other_script", "astral",
)
_AT = {c: k for k, c in enumerate(CLASSES)}


def _pair_classes() -> np.ndarray:
    out = np.full(65536, _AT["tail"], np.uint8)
    kinds = ["lead" if c >= 0xC0 else "tail" if c >= 0x80 else "lower" if chr(c).islower() else "upper" if chr(c).isupper() else "digit" if chr(c).isdigit() else "underscore" if c == 95 else "newline" if c in (10, 13) else "space" if c in (9, 11, 12, 32) else "mark" for c in range(256)]
    for p in range(256):
        for c in range(256):
            before, kind = kinds[p], kinds[c]
            if kind == "lower":
                name = "lower" if before in ("lower", "upper") else "word_start"
            elif kind == "upper":
                name = "hump" if before == "lower" else "upper" if before == "upper" else "upper_start"
            elif kind == "digit":
                name = "digit" if before == "digit" else "digit_start"
            elif kind == "mark":
                name = "mark" if before == "mark" else "mark_start"
            elif kind == "space":
                name = "space_run" if before in ("space", "newline") else "space"
            elif kind == "newline":
                name = "newline_run" if before == "newline" else "newline"
            elif kind == "tail" and before == "lead":
                if p < 0xCD:
                    name = "latin"
                elif p < 0xD6:
                    name = "greek_cyrillic"
                elif p < 0xE0:
                    name = "arabic"
                elif p == 0xE0:
                    name = "indic" if c < 0xB8 else "thai"
                elif p == 0xE3:
                    name = "wide_mark" if c == 0x80 else "kana" if c < 0x84 else "han"
                elif 0xE4 <= p <= 0xE9:
                    name = "han"
                elif p == 0xEF:
                    name = "wide_mark"
                else:
                    name = "astral" if p >= 0xF0 else "other_script"
            else:
                name = kind
            out[p << 8 | c] = _AT[name]
    return out


_PAIRS = _pair_classes()


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts of the classes for each text of a block of UTF-8 bytes."""
    n = len(at) - 1
    pair = data.astype(np.uint16)
    pair[1:] |= data[:-1].astype(np.uint16) << np.uint16(8)
    starts = at[:-1][at[:-1] < at[1:]]
    pair[starts] &= np.uint16(255)
    row = np.repeat(np.arange(n, dtype=np.int32) * len(CLASSES), np.diff(at))
    row += _PAIRS[pair]
    return np.bincount(row, minlength=n * len(CLASSES)).reshape(n, len(CLASSES))


def _columns(x: np.ndarray) -> np.ndarray:
    return np.column_stack((np.ones(len(x)), x))


@dataclass(frozen=True)
class Budget:
    """fitted, held, tested: sampled texts of a language for the fit, for the correction and for the error. least: sampled texts
    under which a language has no model of its own. vocabulary: path of the tokenizer."""

    fitted: int = 384
    held: int = 384
    tested: int = 384
    least: int = 6 * len(CLASSES)
    vocabulary: str = VOCABULARY

    @property
    def sampled(self) -> int:
        return self.fitted + self.held + self.tested


#: Models of their own that are sent to the tasks, at most; more languages raise ValueError.
MOST_MODELS = 30_000


def _sample(texts: DataFrame, size: int) -> DataFrame:
    """(id, label, text, rank): `size` texts of each label, those with the least hashed ids; the label null takes all texts.

    The scan passes texts whose hash is under a bound from the label's count, four times the sample on average, so that no more are
    ranked; if a label has fewer under its bound (many rows that repeat few ids), its sample is smaller.
    """
    each = F.explode(F.array(F.col("language"), F.lit(None).cast("string")))
    counts = bounded(texts.select(each.alias("label")).groupBy("label").agg(F.count("*").alias("n")), "counts")
    hashed = F.shiftrightunsigned(F.xxhash64("id"), 11) / float(1 << 53)
    labelled = texts.select("id", "text", each.alias("label"), hashed.alias("hash"))
    near = labelled.join(counts.withColumnRenamed("label", "_label"), F.col("label").eqNullSafe(F.col("_label"))).where(F.col("hash") * F.col("n") < 4 * size)
    order = Window.partitionBy("label").orderBy("hash", "id")
    ranked = near.dropDuplicates(["id", "label"]).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= size).select("id", "label", "text", "rank")


def models(texts: DataFrame, how: Budget = Budget()) -> DataFrame:
    """One row for each language (label null: the shared model, from texts of all languages): `own`, whether it has a model of its own, n_fitted,
    n_held, n_tested, bias, error, weights.

    `texts` has id, language and text. The sample depends on ids alone, not on partitioning. `error` is the mean absolute error of the
    corrected counts on the tested texts, by text, as a share of the mean; nothing of them takes part in fit or correction. A language with
    fewer than `least` sampled texts uses the shared model; a shared model of so few is fitted on all of them, with bias 1 and no error.
    """
    sample = _sample(texts, how.sampled)

    def counted(it):
        count = counter(how.vocabulary)
        for b in it:
            n = np.array(count([t or "" for t in b.column("text").to_pylist()]), np.int64)
            for r, e, data, at in S.blocks(b.column("text")):
                x = features(data, at)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1).astype(np.float64)), len(CLASSES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column("label").slice(r, e - r), b.column("rank").slice(r, e - r), pa.array(n[r:e]), lists], ["label", "rank", "n_tokens", "x"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        label = pdf["label"].iloc[0]
        label = None if pd.isna(label) else label
        pdf = pdf.sort_values("rank")
        x, y = np.stack(pdf["x"].to_numpy()), pdf["n_tokens"].to_numpy(float)
        few = len(y) < how.least
        if few and label is not None:
            return pd.DataFrame({"label": [label], "own": [False], "n_fitted": [0], "n_held": [0], "n_tested": [0], "bias": [None], "error": [None], "weights": [None]})
        place = np.arange(len(y)) * how.sampled // len(y)  # the order is that of hashes
        a = np.ones(len(y), bool) if few else place < how.fitted
        held = np.zeros(len(y), bool) if few else (place >= how.fitted) & (place < how.fitted + how.held)
        tested = np.zeros(len(y), bool) if few else place >= how.fitted + how.held
        weight = 1 / np.sqrt(x.sum(1) + 16)
        left, right = _columns(x[a]) * weight[a, None], y[a] * weight[a]
        scale = np.sqrt((left**2).mean(0)) + 1e-9
        left = left / scale
        w = np.linalg.solve(left.T @ left + 1e-4 * a.sum() * np.eye(left.shape[1]), left.T @ right) / scale
        guess = np.maximum(_columns(x) @ w, 0)
        bias = float(y[held].sum() / guess[held].sum()) if guess[held].sum() > 0 else 1.0
        error = float(np.abs(guess[tested] * bias - y[tested]).mean() / max(y[tested].mean(), 1e-9)) if tested.any() else None
        return pd.DataFrame({"label": [label], "own": [True], "n_fitted": [int(a.sum())], "n_held": [int(held.sum())], "n_tested": [int(tested.sum())], "bias": [bias], "error": [error], "weights": [w.tolist()]})

    kind = "label string, rank int, n_tokens bigint, x array<double>"
    out = "label string, own boolean, n_fitted bigint, n_held bigint, n_tested bigint, bias double, error double, weights array<double>"
    fitted = sample.select("label", "rank", "text").mapInArrow(counted, kind).groupBy("label").applyInPandas(fit, out)
    return cut(fitted, "models")


def estimates(texts: DataFrame, fitted: DataFrame) -> DataFrame:
    """(id, n_bytes, n_tokens) of each id of `texts` (id, language, text), by the models of `models`.

    Rows that repeat an id count once; a null or empty text has 0 tokens. A language without a model of its own takes the shared one.
    At most MOST_MODELS models are sent to the tasks.
    """
    rows = fitted.where("own").select("label", "weights", "bias").limit(MOST_MODELS + 1).collect()
    if len(rows) > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} languages with models of their own")
    known = {r["label"]: np.array(r["weights"]) * r["bias"] for r in rows}
    shared = known.get(None, np.zeros(len(CLASSES) + 1))

    def batches(it):
        for b in it:
            labels = b.column("language").dictionary_encode()
            table = np.stack([known.get(x, shared) for x in labels.dictionary.to_pylist()] + [shared])
            which = labels.indices.fill_null(len(table) - 1).to_numpy()
            for r, e, data, at in S.blocks(b.column("text")):
                x = features(data, at)
                n = np.maximum((_columns(x) * table[which[r:e]]).sum(1), 0)
                size = np.diff(at)
                n = np.where(size > 0, np.maximum(np.rint(n), 1), 0).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("id").slice(r, e - r), pa.array(size), pa.array(n)], ["id", "n_bytes", "n_tokens"])

    rows = texts.select("id", "language", "text").mapInArrow(batches, "id bigint, n_bytes bigint, n_tokens bigint")
    return rows.groupBy("id").agg(F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"))


def totals(counts: DataFrame, labels: DataFrame, by: list[str | Column]) -> DataFrame:
    """n_texts, n_bytes and n_tokens of each combination of `by`, columns of `labels` (id, ...); null is a label like others."""
    return (
        counts.join(labels.select("id", *by).dropDuplicates(["id"]), "id")
        .groupBy(*by)
        .agg(F.count("*").alias("n_texts"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
    )

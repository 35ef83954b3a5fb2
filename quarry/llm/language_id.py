"""Language identification: averaged hashed subword embeddings and a linear softmax, fitted in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import lean, small_batches, texts_of, trim, unused

UND = "und"
#: Texts are worked on in runs of about so many bytes.
RUN_BYTES = 1 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not (65 <= b < 91 or 97 <= b < 123)]] = 32  # all ASCII but letters parts words


def subwords(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 3- and 4-byte subwords of all texts, and the text that each is from; a word counts with one blank on either side.

    Windows that hold a blank inside, thus reach over two words, are left out.
    """
    joined = _FOLD[np.frombuffer(b" " + b"  ".join(texts) + b" ", np.uint8)]
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    b = joined.astype(np.uint32)
    blank = joined == 32
    out, who = [], []
    for n in (3, 4):
        if len(b) < n:
            continue
        end = len(b) - n + 1
        ok = ~blank[1 : end + 1]
        for k in range(2, n - 1):
            ok &= ~blank[k : end + k]
        h = np.full(end, 2166136261 + n, np.uint32)
        for k in range(n):
            h = (h ^ b[k : end + k]) * np.uint32(16777619)
        at = np.flatnonzero(ok)
        out.append(((h[at] ^ (h[at] >> np.uint32(15))) % np.uint32(buckets)).astype(np.int32))
        who.append(owner[at])
    return (np.concatenate(out), np.concatenate(who)) if out else (np.zeros(0, np.int32), np.zeros(0, np.int64))


@dataclass(frozen=True)
class Model:
    """Labels, the product of embeddings and weights by bucket, the bias, the softmax temperature and the least score kept."""

    labels: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def logits(self, texts: list[bytes]) -> np.ndarray:
        ids, who = subwords(texts, len(self.table))
        n = np.maximum(np.bincount(who, minlength=len(texts)), 1)
        return np.stack([np.bincount(who, self.table[ids, k], len(texts)) / n for k in range(len(self.labels))], 1) + self.bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(texts: list[bytes], langs: list[str], buckets: int = 1 << 15, width: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 0, reject: float = 0.0005) -> Model:
    """SGD on cross-entropy over (text, language) pairs; every fifth pair calibrates the temperature and the rejection.

    The least score kept is the `reject` quantile of the top scores of calibration texts, 0.5 at most.
    """
    labels = tuple(sorted(set(langs)))
    rng = np.random.default_rng(seed)
    y = np.array([labels.index(x) for x in langs])
    counted = (np.unique(subwords([t], buckets)[0], return_counts=True) for t in texts)
    rows = [(ids.astype(np.int32), n.astype(np.float32)) for ids, n in counted]
    emb = rng.normal(0, 0.1, (buckets, width))
    w, bias = rng.normal(0, 0.1, (width, len(labels))), np.zeros(len(labels))
    held = np.arange(len(texts)) % 5 == 4
    train = np.flatnonzero(~held) if (~held).any() else np.arange(len(texts))
    share = np.bincount(y[train], minlength=len(labels)) / max(len(train), 1)
    weight = 1 / np.maximum(share * len(labels), 1e-3)  # languages count alike
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(train):
            ids, n = rows[i]
            if not len(ids):
                continue
            part = (n / n.sum())[:, None]
            mean = (emb[ids] * part).sum(0)
            z = mean @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= min(weight[y[i]], 4.0) * step
            back = w @ p
            w -= np.outer(mean, p)
            bias -= 0.1 * p
            emb[ids] -= part * back[None, :] * 4
    table = (emb @ w).astype(np.float32)
    raw = Model(labels, table, bias, 1.0, 0.0)
    cal = np.flatnonzero(held) if held.any() else train
    z = np.concatenate([raw.logits([texts[i]]) for i in cal]) if len(cal) else np.zeros((0, len(labels)))
    grid = np.geomspace(0.1, 5, 40)
    loss = [-np.log(softmax(z / t)[np.arange(len(cal)), y[cal]] + 1e-12).mean() if len(cal) else 0 for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    top = softmax(z / temperature).max(1) if len(cal) else np.ones(1)
    return Model(labels, table, bias, temperature, float(min(0.5, np.quantile(top, reject))))


def examples(docs: DataFrame, learn: Column, sample: int, least: int = 200) -> pd.DataFrame:
    """text and lang of at most about `sample` different labelled texts for which `learn` holds: of each language its share of
    the different texts, or `least` if it has so many (or sample / 4 in all are fewer); the first by a hash of the text.

    Equal texts are chosen together and become one before any reaches the driver. Languages are counted by sketches.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("hash", 0.02).alias("n")).collect()}
    total = sum(sizes.values())
    floor = min(least, sample // (4 * max(1, len(sizes))))
    quota = {lang: max(floor, round(sample * n / total)) for lang, n in sizes.items()}
    plan = [(lang, quota[lang], int(min(1.0, 1.2 * quota[lang] / max(1, sizes[lang])) * 1_000_000)) for lang in sorted(sizes)]
    wanted = docs.sparkSession.createDataFrame(plan, "q_lang string, quota int, keep int")
    chosen = rows.join(F.broadcast(wanted), F.col("lang") == F.col("q_lang")).where(F.pmod("hash", F.lit(1_000_000)) < F.col("keep"))
    nth = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("text", F.lit(3)), "text"))
    out = chosen.select("text", "lang", "quota").distinct().withColumn("nth", nth).where("nth <= quota")
    return out.select("text", "lang").toPandas().sort_values(["text", "lang"])


def train(docs: DataFrame, learn: Column, sample: int = 6000, **options) -> Model | None:
    """The model of whole texts of at most about `sample` labelled rows for which `learn` holds (see examples).

    None if no row has a text and a language.
    """
    some = examples(docs, learn, sample)
    if not len(some):
        return None
    order = np.random.default_rng(1).permutation(len(some))
    model = fit([some["text"].iloc[i].encode() for i in order], [some["lang"].iloc[i] for i in order], **options)
    del some
    trim()
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred, score and accepted; only the text counts.

    A text that is null or has no letter is `und` with score 0 and not accepted; so is each text if there is no model.
    accepted: the score reaches the model's calibrated least score. Texts are read whole, whatever their length;
    equal texts, and rows that repeat, get equal results. Columns of these three names that docs has already are
    replaced; no other name clashes.
    """
    small_batches(docs.sparkSession)
    fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "accepted")]
    names = [f.name for f in fields]
    text_name, letters = unused(docs.columns, "text", "letters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, known = texts_of(batch.column(text_name)), np.array(batch.column(letters).to_pylist(), bool)
            scores = np.zeros((len(texts), len(model.labels) if model else 1))
            if model:
                size = np.cumsum([len(t) + 2 for t in texts])
                for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(size // RUN_BYTES)) + 1) if len(texts) else []:
                    scores[part] = model.scores([texts[i] for i in part])
            else:
                known[:] = False
            best = scores.argmax(1)
            top = np.where(known, scores[np.arange(len(texts)), best], 0.0) if len(texts) else np.zeros(0)
            labels = [model.labels[b] if k else UND for b, k in zip(best.tolist(), known.tolist(), strict=True)] if model else [UND] * len(texts)
            made = [pa.array(labels, pa.string()), pa.array(top, pa.float64()), pa.array(known & (top >= (model.least if model else 0)), pa.bool_())]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), *made], names=[*names, "lang_pred", "score", "accepted"])

    text = F.col("text").cast("string")
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    return docs.select(*names, text.alias(text_name), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias(letters)).mapInArrow(lean(run), schema)


def held_out(remainder: int, modulus: int) -> Column:
    """Whether crc32(doc_id as text) mod `modulus` is `remainder`; false without doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def accuracy(predicted: pd.DataFrame) -> float:
    """Share of rows with a language whose prediction is right."""
    rows = predicted[predicted["lang"].notna()]
    return float((rows["lang"] == rows["lang_pred"]).mean()) if len(rows) else 1.0

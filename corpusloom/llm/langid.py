"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are learned with follow-the-regularised-leader (FTRL-proximal) under an elastic-net penalty, then one
temperature is fitted on rows kept out of the training. Document frequencies are counted over every training row;
the weights are fitted on a bounded sample (Params.per_lang rows of each language, chosen by hash); every whole text
is predicted. Hashed features bound the model: dim x languages floats, whatever the corpus size.

Null text, or a text without any letter: `und`, score 0. A table without labelled rows gives `und` everywhere.
Repeated rows get equal answers. Rows with a null id are predicted but never learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from corpusloom.functions.shipping import ship
from corpusloom.llm.common import bound_batches, map_rows, release, texts


@dataclass(frozen=True)
class Params:
    bits: int = 16  # 2**bits hashed features
    per_lang: int = 600  # bound of the training sample, rows of each language
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    scale: float = 20.0  # of the TF-IDF values
    piece: int = 1 << 20  # code points that are featurised at a time


_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def _ids(cp: np.ndarray, bits: int) -> np.ndarray:
    """Hashed 1- to 3-grams of code points."""
    c = cp.astype(np.uint64)
    shift = np.uint64(64 - bits)
    one = (c + np.uint64(1)) * _K[0]
    two = (one[:-1] ^ (c[1:] + np.uint64(7)) * _K[1]) * _K[0] if len(c) > 1 else c[:0]
    three = (two[:-1] ^ (c[2:] + np.uint64(13)) * _K[2]) * _K[0] if len(c) > 2 else c[:0]
    return np.concatenate([one >> shift, two >> shift, three >> shift]).astype(np.int64)


def _pieces(text: str, p: Params):
    """Hashed n-grams of the whole text, some code points at a time; pieces overlap by two, so an n-gram is seen in one piece as it would be in the whole."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = (cp == 32) | ((cp >= 9) & (cp <= 13))
    digit = (cp >= 48) & (cp <= 57)
    cp = np.where(space, np.uint32(32), np.where(digit, np.uint32(48), cp))
    for at in range(0, len(cp), p.piece):
        yield _ids(cp[max(0, at - 2) : at + p.piece], p.bits)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _document_frequencies(train: DataFrame, p: Params) -> tuple[np.ndarray, int]:
    """Over every training row: one vector for each task, summed by feature; at most 2**bits rows reach the driver."""
    dim = 1 << p.bits

    def each(rows):
        df, n = np.zeros(dim, dtype=np.int64), 0
        for (text,) in rows:
            n += 1
            seen = np.zeros(dim, dtype=bool)
            for ids in _pieces(text, p):
                seen[ids] = True
            df += seen
        yield -1, n
        for i in np.flatnonzero(df):
            yield int(i), int(df[i])

    counts = map_rows(train.select("text"), each, "feature int, n long", pa.schema([("feature", pa.int32()), ("n", pa.int64())]), 1 << 16)
    found = counts.groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(dim, dtype=np.int64)
    rows = found[found.feature >= 0]
    df[rows.feature.to_numpy()] = rows.n.to_numpy()
    return df, int(found[found.feature < 0].n.sum())


def _sample(train: DataFrame, p: Params) -> tuple[list[str], list[tuple[int, np.ndarray, np.ndarray]]]:
    counts = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return [], []
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, p.per_lang / counts[lang]))).otherwise(share)
    unit = (F.xxhash64("doc_id", F.lit("sample")).bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))).alias("unit")
    chosen = train.select("doc_id", "lang", "text", unit).where(F.col("unit") < share)

    def each(rows):
        for key, lang, text, _ in rows:
            counted = np.zeros(1 << p.bits, dtype=np.int64)
            for ids in _pieces(text, p):
                counted += np.bincount(ids, minlength=len(counted))
            at = np.flatnonzero(counted)
            yield key, lang, at.astype("<u4").tobytes(), counted[at].astype("<u4").tobytes()

    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("ids", pa.binary()), ("counts", pa.binary())])
    rows = map_rows(chosen, each, "doc_id long, lang string, ids binary, counts binary", schema, 200).toArrow().sort_by([("doc_id", "ascending"), ("ids", "ascending"), ("lang", "ascending")])
    index = {lang: i for i, lang in enumerate(langs)}
    sample = []
    for lang, ids, n in zip(*(rows.column(c).to_pylist() for c in ("lang", "ids", "counts"))):
        sample.append((index[lang], np.frombuffer(ids, "<u4").astype(np.int64), np.frombuffer(n, "<u4").astype(np.float64)))
    return langs, sample


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # dim x languages: IDF times weight times scale
    bias: np.ndarray
    temperature: float
    params: Params

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for ids in _pieces(text, self.params):
            total += self.table[ids].sum(axis=0, dtype=np.float64)
            n += len(ids)
        return self.bias + total / max(1, n)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        z = self.logits(text) / self.temperature
        e = np.exp(z - z.max())
        at = int(np.argmax(z))
        return self.langs[at], float(e[at] / e.sum())


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(sample: list[tuple[int, np.ndarray, np.ndarray]], classes: int, dim: int, p: Params) -> np.ndarray:
    """FTRL-proximal; feature dim is the bias. Returns (dim + 1) x classes weights, sparse through the l1 penalty."""
    z, n = np.zeros((dim + 1, classes)), np.zeros((dim + 1, classes))

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= p.l1, 0.0, -(zz - np.sign(zz) * p.l1) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2))

    order = np.random.default_rng(0)
    for _ in range(p.epochs):
        for i in order.permutation(len(sample)):
            y, ids, x = sample[i]
            w = weights(ids)
            g = _softmax(x @ w)
            g[y] -= 1.0
            step = x[:, None] * g[None, :]
            sigma = (np.sqrt(n[ids] + step * step) - np.sqrt(n[ids])) / p.alpha
            z[ids] += step - sigma * w
            n[ids] += step * step
    return weights(slice(None))


def fit(train: DataFrame, p: Params = Params()) -> Model:
    """train: doc_id, text, lang; rows without an id, a label or a letter are no use and not read further."""
    train = train.where("doc_id is not null and lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    langs, raw = _sample(train, p)
    dim = 1 << p.bits
    if not langs:
        return Model([], np.zeros((dim, 0), np.float32), np.zeros(0), 1.0, p)
    df, n = _document_frequencies(train, p)
    idf = np.log((1 + n) / (1 + df)) + 0.1
    rows = []
    for y, ids, counts in raw:
        x = counts / counts.sum() * idf[ids] * p.scale
        rows.append((y, np.append(ids, dim), np.append(x, 1.0)))
    held = [r for i, r in enumerate(rows) if i % 5 == 4] or rows
    learn = [r for i, r in enumerate(rows) if i % 5 != 4] or rows
    w = ftrl(learn, len(langs), dim, p)
    logits = np.stack([x @ w[ids] for _, ids, x in held])
    gold = np.array([y for y, _, _ in held])
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(gold)), gold], 1e-12)).mean() for t in grid]
    return Model(langs, (w[:dim] * (idf * p.scale)[:, None]).astype(np.float32), w[dim], float(grid[int(np.argmin(loss))]), p)


def predict(df: DataFrame, model: Model) -> DataFrame:
    """df: doc_id, text. One row per input row: doc_id, lang_pred, score."""
    shipped = df.sparkSession.sparkContext.broadcast(model)  # dim x languages floats, a fixed size

    def each(rows):
        m = shipped.value
        for key, text in rows:
            yield key, *m.predict(text)

    return map_rows(df.select(F.col("doc_id").cast("long"), "text"), each, "doc_id long, lang_pred string, score double", pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())]))


def annotate(df: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """df's rows as they are, with the prediction's two columns. names must not be among df's columns."""
    ship(df.sparkSession)
    bound_batches(df.sparkSession)
    shipped = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))  # mapInArrow takes no names with dots or quotes
    schema = StructType([*plain.schema.fields, StructField("pred", StringType()), StructField("score", DoubleType())])

    def run(source):
        m = shipped.value
        for b in source:
            found = [m.predict(x) for x in b.column(at).to_pylist()]
            lang, score = pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, lang, score], [*b.schema.names, "pred", "score"])
        release()

    return plain.mapInArrow(run, schema).toDF(*df.columns, *names)


def remainder():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("lang")).where((remainder() != 2))


def identify(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Fit on the training share of docs and predict all of it."""
    return predict(docs, fit(training_rows(docs), p))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents")
    return identify(docs).select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


__all__ = ["Model", "Params", "annotate", "fit", "ftrl", "identify", "op9_language_id", "predict", "training_rows"]

"""Language identification with error-correcting output codes.

Every language has a codeword of +1/-1 bits. For each bit a binary linear classifier over hashed
byte n-grams (1 to 4 bytes, inside a word with one blank on either side) predicts on which side
a text stands. Decoding sums, for each language, the logistic loss of the predicted margins
against its codeword, each bit weighted by how well its classifier did on that language in
training, and takes the language of least loss. A text whose best and second language come
close is flagged as ambiguous.

The classifiers are fitted on a bounded sample of labelled documents: for every language the
`per_language` doc_ids of smallest hash, at most `rows` in all (of more languages than that, the commonest); their texts are read whole.
Only text and lang of rows whose crc32(doc_id as text) mod 4 is not 2 are used.

Defined results: a null text, an empty one or one without a letter is `und` with score 0; with no
labelled row every text is `und`; with one language every text with a letter is that language;
rows with null lang or null doc_id teach nothing; a null doc_id is not held out; repeated rows
and other columns make no difference (a doc_id teaches a language once, by the text that sorts first); a text of any length is judged as a whole, a chunk
of texts at a time. Equal losses go to the language that sorts first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import LOWER, SPACED, Chunk, chunks, mix64, ranges, word_hashes, words

FOLDS, HELD_OUT = 4, 2
PER_LANGUAGE, ROWS = 400, 4000
BITS = 13
GRAMS = (1, 2, 3, 4)
#: Least difference of the two best languages' shares of the decoded weight.
AMBIGUOUS = 0.05
UNKNOWN = "und"
RESULT = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of the chunk: feature of each gram and the word's first gram; then for every word of the chunk its distinct word, and the texts' word offsets."""
    w = words(chunk, SPACED)
    _, first, which = np.unique(word_hashes(w), return_index=True, return_inverse=True)
    size = w.end[first] - w.start[first]
    at = np.concatenate([[0], np.cumsum(size + 1)])
    buf = np.full(int(at[-1]) + 1, 0x20, np.uint8)
    buf[ranges(at[:-1] + 1, size)] = LOWER[w.data[ranges(w.start[first], size)]]
    blank = buf == 0x20
    wide = buf.astype(np.uint64)
    n_pos, gram = len(buf), np.zeros(len(buf), np.uint64)
    found, owner = [], []
    word_of = np.repeat(np.arange(len(size)), size + 1)
    inner = np.zeros(n_pos, bool)  # a blank between the gram's ends
    for n in GRAMS:
        m = n_pos - n + 1
        if m <= 0:
            break
        gram = gram[:m] * np.uint64(256) + wide[n - 1 :]
        if n > 2:
            inner = inner[:m] | blank[n - 2 : n - 2 + m]
        ok = ~inner[:m]
        if n <= 2:
            ok = ok & ~(blank[:m] & blank[n - 1 :])
        ok = ok[: len(word_of)]
        p = np.flatnonzero(ok)
        found.append((mix64(gram[p] + np.uint64(n << 40)) >> np.uint64(64 - BITS)).astype(np.int64))
        owner.append(word_of[p])
    owner = np.concatenate(owner) if owner else np.empty(0, np.int64)
    order = np.argsort(owner, kind="stable")
    found = np.concatenate(found)[order] if len(owner) else owner
    return found, np.searchsorted(owner[order], np.arange(len(size) + 1)), which, w.offsets


def lettered(chunk: Chunk) -> np.ndarray:
    """Flags of the texts that hold a letter."""
    total = np.concatenate([[0], np.cumsum(_LETTER[chunk.data])])[chunk.offsets]
    flag = np.diff(total) > 0
    high = np.concatenate([[0], np.cumsum(chunk.data >= 0x80)])[chunk.offsets]
    for i in np.flatnonzero(~flag & (np.diff(high) > 0)):
        flag[i] = any(c.isalpha() for c in chunk.data[chunk.offsets[i] : chunk.offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return flag


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values[starts[i]:starts[i+1]], rows or numbers; empty ranges give 0."""
    out = np.zeros((len(starts) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(starts) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, starts[full], axis=0)
    return out


def codewords(n: int) -> np.ndarray:
    """(n, bits) of +1/-1: all splits for up to five languages, else the best of some dense random codes."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= 5:
        bits = np.arange(1, 2 ** (n - 1))
        return np.where((bits >> np.arange(n)[:, None]) & 1, 1.0, -1.0)
    size, best, far = int(np.ceil(10 * np.log2(n))), None, -1
    for seed in range(64):
        code = np.where(np.random.default_rng(seed).random((n, size)) < 0.5, 1.0, -1.0)
        apart = ((size - code @ code.T) / 2 + size * np.eye(n)).min()
        if apart > far and (np.abs(code.sum(0)) < n).all():
            best, far = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    trust: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: list[str], steps: int = 150, ridge: float = 1e-3) -> Model:
        """Logistic regressions of all bits together, by accelerated gradient steps; each language counts alike."""
        names = sorted(set(y))
        code = codewords(len(names))
        label = np.array([names.index(v) for v in y], np.int64)
        target = code[label] if len(names) else np.zeros((0, 0))
        n_bits = code.shape[1]
        w, b = np.zeros((x.shape[1] if x.ndim == 2 else 1 << BITS, n_bits), np.float32), np.zeros(n_bits, np.float32)
        if n_bits:
            share = (1 / np.bincount(label, minlength=len(names)) / len(names))[label].astype(np.float32)[:, None]
            rate = np.float32(4 / ((x**2).sum(1).max() + 1))
            vw, vb = w.copy(), b.copy()
            for k in range(steps):
                m = x @ vw + vb
                g = -target.astype(np.float32) / (1 + np.exp(np.clip(target * m, -30, 30))).astype(np.float32) * share
                nw, nb = vw - rate * 8 * (x.T @ g + np.float32(ridge) * vw), vb - rate * 8 * g.sum(0)
                push = np.float32(k / (k + 3))
                vw, vb, w, b = nw + push * (nw - w), nb + push * (nb - b), nw, nb
            right = ((x @ w + b) * target > 0).astype(float)
            trust = np.array([right[label == i].mean(0) for i in range(len(names))])
        else:
            trust = np.ones(code.shape)
        trust = np.maximum(trust, 1e-3)
        return cls(names, code, trust / trust.sum(1, keepdims=True) if n_bits else trust, w, b)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share, and whether the second comes close."""
        n = len(margins)
        if len(self.languages) < 2:
            return np.zeros(n, np.int64), np.ones(n), np.zeros(n, bool)
        loss = (np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.trust[None]).sum(2)
        best = loss.argmin(1)
        share = np.exp(-self.code.shape[1] * (loss - loss.min(1, keepdims=True)) / 2)
        share /= share.sum(1, keepdims=True)
        two = np.partition(share, -2, axis=1)[:, -2:]
        return best, share[np.arange(n), best], two[:, 1] - two[:, 0] < AMBIGUOUS

    def margins(self, chunk: Chunk) -> np.ndarray:
        gram, starts, which, offsets = features(chunk)
        word = sums(self.weights[gram], starts)[which]
        size = np.diff(starts)[which].astype(np.float64)
        total = sums(word.astype(np.float64), offsets)
        return total / np.maximum(np.sqrt(sums(size, offsets)), 1)[:, None] + self.bias


def vectors(chunk: Chunk):
    """For each text its gram counts over the root of their number, as 16-bit floats."""
    gram, starts, which, offsets = features(chunk)
    size = np.diff(starts)[which]
    ends = np.concatenate([[0], np.cumsum(size)])[offsets]
    every = gram[ranges(starts[:-1][which], size)]
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        yield (np.bincount(every[a:b], minlength=1 << BITS) / np.sqrt(max(b - a, 1))).astype(np.float16).tobytes()


def _rows(docs: DataFrame) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), (fold != HELD_OUT).alias("teaches"))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, rows: int = ROWS) -> Model:
    taught = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string").alias("lang")).where(
        (F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    spark = docs.sparkSession
    sizes = taught.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()
    if not sizes:
        return Model.fit(np.zeros((0, 1 << BITS), np.float32), [])
    each = max(1, min(per_language, rows // len(sizes)))
    # the least hashes of each language: first in 64 parts, so that no task sees a whole language
    ids = taught.select("lang", "doc_id").distinct().withColumn("h", F.xxhash64("doc_id")).withColumn("part", F.pmod(F.xxhash64("h", "lang"), F.lit(64)))
    for by in (("lang", "part"), ("lang",)):
        ids = ids.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id"))).where(F.col("place") <= each)
    known = [r["lang"] for r in sizes]
    picked = [(r["lang"], r["doc_id"], r["h"]) for r in ids.where(F.col("lang").isin(known)).select("lang", "doc_id", "h").collect()]  # `rows` at most
    chosen = taught.join(F.broadcast(spark.createDataFrame(picked, "lang string, doc_id long, h long")), ["lang", "doc_id"]).groupBy("lang", "doc_id", "h").agg(F.min("text").alias("text"))

    def vectorised(batches):
        for batch in batches:
            for chunk in chunks(batch.column("text"), 1 << 18):
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(chunk.first, len(chunk)), batch.column("h").slice(chunk.first, len(chunk)), pa.array(list(vectors(chunk)), pa.binary())], ["lang", "h", "x"])

    got = chosen.select("lang", "h", "text").mapInArrow(vectorised, "lang string, h long, x binary").toArrow().sort_by([("lang", "ascending"), ("h", "ascending")])
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(-1, 1 << BITS)
    return Model.fit(x.astype(np.float32), got.column("lang").to_pylist())


def _predicted(model: Model, chunk: Chunk) -> tuple[list[str], np.ndarray, np.ndarray]:
    flag = lettered(chunk) & bool(model.languages)
    best, share, close = model.decode(model.margins(chunk))
    return [model.languages[b] if f else UNKNOWN for b, f in zip(best.tolist(), flag.tolist())], np.where(flag, share, 0.0), close | ~flag


def identified(docs: DataFrame, per_language: int = PER_LANGUAGE, rows: int = ROWS) -> DataFrame:
    """Per document: predicted language, its share of the decoded weight, and the ambiguity flag (RESULT)."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, per_language, rows))

    def predict(batches):
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                lang, score, close = _predicted(shared.value, chunk)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(chunk.first, len(chunk)), batch.column("held_out").slice(chunk.first, len(chunk)), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())],
                    ["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
                )

    return _rows(docs).select("doc_id", "text", "held_out").mapInArrow(predict, RESULT)


def recognised(docs: DataFrame, per_language: int = PER_LANGUAGE, rows: int = ROWS) -> DataFrame:
    """The rows of docs, all columns, whose text has a language: neither `und` nor ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, per_language, rows))

    def keep(batches):
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                lang, _, close = _predicted(shared.value, chunk)
                yield batch.slice(chunk.first, len(chunk)).filter(pa.array([a != UNKNOWN for a in lang]) if len(shared.value.languages) < 2 else pa.array(~close))

    return docs.mapInArrow(keep, docs.schema)

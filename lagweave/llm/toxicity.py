"""Toxicity by weak supervision.

Voters look at the words of a text, and at how they begin (5 to 8 bytes), and vote toxic (+1), clean (-1) or abstain (0): lexicon
voters (a seed list in groups, and groups mined from labelled rows) and pattern voters (an
insult close to a second-person word, repeated insults, density). A generative label model
estimates by EM how often each voter votes which way on either class, and the correlations
between voters within a class; voters that repeat one another count less. A linear
classifier over word presence is then trained on the posterior labels; it alone makes the score.

All three are fitted on a bounded sample: at most `per_label` labelled rows of each label and
`unlabelled` others, those of smallest hash, their texts read whole; near copies in the
sample count once. Only rows whose crc32(doc_id as text) mod 5 is not 0 are used, and of
labels only toxic, for mining lexicon groups and the class balance.

Defined results: a null or empty text has the score of a text without any feature; labels that are null
or appear for no document teach nothing, of several labels of a document the largest counts; without any labelled row only the seed
lexicon votes; a null doc_id is not held out and teaches nothing; repeated rows get a row each, and a doc_id teaches once, by the text that sorts first;
a text of any length is scored as a whole; equal scores need no order; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import documents
from .text import ALNUM, Chunk, buffers, chunks, gram_hashes, mix64, word_hashes, words

FOLDS, HELD_OUT = 5, 0
PER_LABEL, UNLABELLED = 2000, 1000
FEATURES = 2000
GROUPS = 6
NEAR = 6
RESULT = "doc_id long, held_out boolean, score double, predicted int"
#: Common English insults, as a start; more are mined from labelled rows.
SEED = (
    "idiot idiots moron morons stupid dumb fool",
    "scum trash garbage filth vermin worthless",
    "loser losers clown pathetic disgusting",
    "bastard bitch asshole shit fuck fucking damn crap",
)
YOU = "you your you're du dein deine dich tu ton ta te vous votre tú tu usted eres"


def codes(text: str) -> np.ndarray:
    """Codes of the words of a line."""
    return profile(next(iter(chunks(pa.array([text])))))[0][:, 0]


#: Columns of a profile: the word, then its first bytes of these lengths.
BEGINNINGS = (5, 6, 7, 8)
WIDTH = 1 + len(BEGINNINGS)


def profile(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """32-bit codes of all words and their beginnings (0: the word is no longer than that), and the texts' word offsets."""
    w = words(chunk, ALNUM, lower=True)
    out = np.zeros((len(w.start), WIDTH), np.uint32)
    out[:, 0] = (word_hashes(w) >> np.uint64(32)) | np.uint64(1)
    for k, n in enumerate(BEGINNINGS, 1):
        longer = np.flatnonzero(w.end - w.start > n)
        begun = word_hashes(replace(w, start=w.start[longer], end=w.start[longer] + n))
        out[longer, k] = (mix64(begun + np.uint64(n)) >> np.uint64(32)) | np.uint64(1)
    return out, w.offsets


def member(sorted_codes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Index in sorted_codes of each of `of`, or -1."""
    if not len(sorted_codes):
        return np.full(len(of), -1)
    at = np.minimum(np.searchsorted(sorted_codes, of), len(sorted_codes) - 1)
    return np.where(sorted_codes[at] == of, at, -1)


@dataclass
class Voters:
    lexicon: np.ndarray
    group: np.ndarray
    n_groups: int
    you: np.ndarray

    def votes(self, code: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, voters) in {-1, 0, 1}."""
        n = len(offsets) - 1
        at = member(self.lexicon, code.ravel())
        p = np.flatnonzero(at >= 0)
        found, p = self.group[at[p]], p // WIDTH
        text = np.searchsorted(offsets, p, "right") - 1
        in_group = np.zeros((n, self.n_groups), np.int64)
        np.add.at(in_group, (text, found), 1)
        hits, size = in_group.sum(1), np.diff(offsets)
        you = np.flatnonzero(member(self.you, code[:, 0]) >= 0)
        close = np.zeros(n, bool)
        if len(you) and len(p):
            k = np.searchsorted(you, p)
            for near in (np.maximum(k - 1, 0), np.minimum(k, len(you) - 1)):
                ok = (np.abs(you[near] - p) <= NEAR) & (np.searchsorted(offsets, you[near], "right") - 1 == text)
                close[text[ok]] = True
        kinds = (in_group > 0).sum(1)
        pattern = np.stack([np.where(close, 1, 0), np.where(hits >= 2, 1, np.where(hits == 0, -1, 0)), np.where(hits * 200 >= np.maximum(size, 1), 1, -1), np.where(kinds >= 2, 1, 0)], axis=1)
        return np.concatenate([np.where(in_group > 0, 1, 0), pattern], axis=1)


@dataclass
class LabelModel:
    """P(vote | class) of each voter, correlations within a class, and the posterior of class 1."""

    table: np.ndarray
    weight: np.ndarray
    correlation: np.ndarray
    prior: float

    @classmethod
    def fit(cls, votes: np.ndarray, prior: float, rounds: int = 30) -> LabelModel:
        n, m = votes.shape
        strength = votes.sum(1)
        post = np.where(strength > 0, 0.9, 0.05 if n else 0.0).astype(float)
        one_hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
        model = None
        for _ in range(rounds):
            each = np.stack([1 - post, post])
            table = (np.einsum("cn,nmv->cmv", each, one_hot) + 0.1) / (each.sum(1)[:, None, None] + 0.3)
            mean = each @ votes / np.maximum(each.sum(1), 1e-9)[:, None]
            covariance = np.zeros((m, m))
            for c in (0, 1):
                off = votes - mean[c]
                covariance += (off * each[c][:, None]).T @ off
            scale = np.sqrt(np.maximum(np.diag(covariance), 1e-9))
            correlation = covariance / scale[:, None] / scale[None]
            np.fill_diagonal(correlation, 1)
            weight = 1 / np.maximum(correlation, 0).sum(1)
            model = cls(table, weight, correlation, prior)
            fresh = model.posterior(votes)
            if n and np.abs(fresh - post).max() < 1e-4:
                break
            post = fresh
        return model

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = np.log(self.table[1]) - np.log(self.table[0])
        total = (np.take_along_axis(odds[None], (votes + 1)[:, :, None], axis=2)[:, :, 0] * self.weight).sum(1)
        return 1 / (1 + np.exp(-np.clip(total + np.log(self.prior / (1 - self.prior)), -30, 30)))


@dataclass
class Classifier:
    vocabulary: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, code: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        at = member(self.vocabulary, code.ravel())
        p = np.flatnonzero(at >= 0)
        pair = np.unique((np.searchsorted(offsets, p // WIDTH, "right") - 1) * max(1, len(self.vocabulary)) + at[p])
        text, feature = np.divmod(pair, max(1, len(self.vocabulary)))
        total = np.bincount(text, self.weights[feature] if len(pair) else None, minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))


def salience(present: np.ndarray, owner: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words in (word, text) pairs: hash, texts of weight label=1, texts, and signed z of the difference of both shares."""
    word, which = np.unique(present, return_inverse=True)
    n1, n = label.sum(), len(label)
    a = np.bincount(which, label[owner], minlength=len(word))
    total = np.bincount(which, minlength=len(word)).astype(float)
    expected = total * n1 / max(n, 1)
    spread = np.sqrt(np.maximum(expected * (1 - n1 / max(n, 1)), 1e-9))
    return word, a, total, (a - expected) / np.maximum(spread, 0.5)


@dataclass
class Model:
    voters: Voters
    labels: LabelModel
    classifier: Classifier


def train(code: np.ndarray, offsets: np.ndarray, label: np.ndarray) -> Model:
    """From a sample's words; label: 1, 0, or -1 where unknown."""
    grams = gram_hashes(mix64(code[:, 0]), 3)
    low = np.array([grams[a : b - 2].min() if b - a >= 3 else code[a:b, 0].astype(np.uint64).sum() for a, b in zip(offsets[:-1], offsets[1:])], np.uint64)
    _, once = np.unique(low ^ (label + 1).astype(np.uint64), return_index=True)
    once = np.sort(once)
    begin, sizes, label = offsets[:-1][once], np.diff(offsets)[once], label[once]
    own = [np.unique(code[a : a + n]) for a, n in zip(begin.tolist(), sizes.tolist())]
    own = [x[x > 0] for x in own]
    owner = np.repeat(np.arange(len(once), dtype=np.int32), [len(x) for x in own])
    word = np.concatenate([np.empty(0, np.uint32), *own])
    del own
    lexicon, group = [], []
    for g, line in enumerate(SEED):
        c = np.unique(codes(line))
        lexicon.append(c)
        group.append(np.full(len(c), g))
    known = label >= 0
    n1 = int((label == 1).sum())
    if n1 and n1 < known.sum():
        number = np.cumsum(known) - 1
        mine = known[owner]
        w, a, total, z = salience(word[mine], number[owner[mine]], label[known].astype(float))
        best = np.flatnonzero((z >= 5) & (a >= max(5, 0.01 * n1)) & (a >= 0.9 * total))
        best = best[np.argsort(-z[best], kind="stable")][:200]
        best = best[member(np.sort(np.concatenate(lexicon)), w[best]) < 0]
        lexicon.append(w[best])
        group.append(len(SEED) + np.arange(len(best)) % GROUPS)
    flat, groups = np.concatenate(lexicon), np.concatenate(group)
    order = np.argsort(flat, kind="stable")
    voters = Voters(flat[order], groups[order].astype(np.int64), len(SEED) + GROUPS, np.unique(codes(YOU)))
    votes = np.concatenate([np.empty((0, len(SEED) + GROUPS + 4), np.int64), *(voters.votes(code[a : a + n], np.array([0, n])) for a, n in zip(begin.tolist(), sizes.tolist()))])
    prior = min(max(n1 / max(1, known.sum()), 0.01), 0.5)
    labels = LabelModel.fit(votes, prior)
    post = labels.posterior(votes)
    w, a, total, z = salience(word, owner, post)
    best = np.flatnonzero((np.abs(z) >= 3) & (total >= 5))
    best = np.sort(best[np.argsort(-np.abs(z[best]), kind="stable")][:FEATURES])
    at = member(w[best], word)
    use = at >= 0
    x = np.zeros((len(once), len(best) + 1), np.float32)
    x[owner[use], at[use]] = 1
    x[:, -1] = 1
    weights, bias = logistic(x, post)
    return Model(voters, labels, Classifier(w[best], weights, bias))


def logistic(x: np.ndarray, target: np.ndarray, steps: int = 300, ridge: float = 3e-4) -> tuple[np.ndarray, float]:
    """Weights and bias (of the last column, all ones) for soft targets, by accelerated gradient steps; the bias is not shrunk."""
    n, m = x.shape
    if not n:
        return np.zeros(m - 1), -3.0
    v = np.random.default_rng(0).random(m).astype(np.float32)
    for _ in range(10):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) + 1e-12
    rate = 4 * n / (float(np.linalg.norm(x.T @ (x @ v))) + 1e-9)
    w = np.zeros(m, np.float32)
    u = w.copy()
    shrink = np.full(m, ridge, np.float32)
    shrink[-1] = 0
    for k in range(steps):
        g = x.T @ ((1 / (1 + np.exp(-np.clip(x @ u, -30, 30))) - target).astype(np.float32)) / n + shrink * u
        fresh = u - np.float32(rate) * g
        u, w = fresh + np.float32(k / (k + 3)) * (fresh - w), fresh
    return w[:-1].astype(float), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, unlabelled: int = UNLABELLED) -> Model:
    spark = docs.sparkSession
    teach = F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT
    marks = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic")).where(teach & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    narrow = docs.select(F.col("doc_id").cast("long")).where(teach).distinct().join(marks, "doc_id", "left").select("doc_id", F.coalesce("toxic", F.lit(-1)).alias("toxic"), F.xxhash64("doc_id").alias("h"))
    chosen = None
    for kind, most in ((1, per_label), (0, per_label), (-1, unlabelled)):
        part = narrow.where(F.col("toxic") == kind).orderBy("h").limit(most)
        chosen = part if chosen is None else chosen.unionAll(part)
    picked = [(r["doc_id"], r["toxic"]) for r in chosen.collect()]  # bounded by 2 * per_label + unlabelled
    small = spark.createDataFrame(picked or [(None, -1)], "doc_id long, toxic int")

    def profiled(batches):
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                code, offsets = profile(chunk)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(chunk.first, len(chunk)), batch.column("toxic").slice(chunk.first, len(chunk)), pa.array([code[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())],
                    ["doc_id", "toxic", "words"],
                )

    # one row for each doc_id, the text that sorts first
    rows = documents(docs).join(F.broadcast(small), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    got = rows.mapInArrow(profiled, "doc_id long, toxic int, words binary").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("words", "ascending")])
    data, offsets = buffers(got.column("words"))
    return train(data.view(np.uint32).reshape(-1, WIDTH), offsets // (4 * WIDTH), got.column("toxic").to_numpy().astype(np.int64))


def scored(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, unlabelled: int = UNLABELLED) -> DataFrame:
    """Per document: held_out, score and predicted label (RESULT)."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_label, unlabelled).classifier)

    def score(batches):
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                code, offsets = profile(chunk)
                s = shared.value.score(code, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(chunk.first, len(chunk)), batch.column("held_out").slice(chunk.first, len(chunk)), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False)).alias("held_out")
    return documents(docs).select("doc_id", "text", held).mapInArrow(score, RESULT)

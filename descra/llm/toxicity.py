"""Operator 5: toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Labels are learned only from rows outside the held-out fold (crc32 of the doc_id
as text, modulo ``folds``, is 0), and from a sample of about ``sample`` of them,
drawn by a hash of doc_id; the sample's texts are a written table.

1. Lexicon: words and beginnings of words whose document frequency among toxic
   sample rows stands out, counted over the sample in one grouping, in two
   tiers of log odds, beside a fixed list of second-person words.
2. Features of a whole text, all from numpy over its bytes: lexicon densities,
   counts and spread, second-person words near lexicon words, capitals,
   punctuation, digits, runs of one character, words of letters and digits mixed,
   and words that reach the lexicon only once look-alike signs are undone.
3. Trees and calibration: histogram trees with second-order gains on three
   quarters of the sample, pool-adjacent-violators on the fourth.

Texts are scored in one pass without a shuffle; the model is a few kilobytes.

Defined results: null and empty texts have zero features and the score of those;
a null doc_id is not held out and never learned from; labels other than 0 and 1
are not learned from, of several for one doc_id the largest is; rows with the same doc_id are scored each; without labels
of both kinds every score is the share of toxic ones (0 without any); an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descra.llm import kit, words
from descra.llm.tokens import as_strings, slices

FOLDS, SAMPLE, SLICE_BYTES = 5, 30_000, 2 << 20
#: Bytes of the beginnings that count as lexicon entries beside whole words, and bounds of an entry's log odds.
BEGINNINGS, STRONG, WEAK, LEAST_DOCS, MOST_ENTRIES = (4, 5, 6), 3.5, 2.0, 6, 4000
NEAR = 5
SECOND_PERSON = "you your yours yourself u ur ye thou tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer usted ustedes tus vosotros vuestro ti contigo".split()
#: Signs that stand for letters.
ALIKE = np.arange(256, dtype=np.uint8)
ALIKE[[ord(c) for c in "013457@$!|"]] = [ord(c) for c in "oieastasil"]
ALIKE_WORD = words.ALNUM.copy()
ALIKE_WORD[[ord(c) for c in "@$!|"]] = True


def entries(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """For each word the hashes by which the lexicon may know it: whole, and its beginnings (0 where the word is no longer than that)."""
    out = [words.hashes(data, begin, end)]
    for n in BEGINNINGS:
        short = end - begin <= n
        with np.errstate(over="ignore"):
            h = words.mix(words.hashes(data, begin, np.minimum(end, begin + n)) + np.uint64(n))
        out.append(np.where(short, np.uint64(0), h))
    return out


def member(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def lexicon_rows(sample: DataFrame) -> DataFrame:
    """entry, toxic: each document's distinct entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(as_strings(batch.column(0)), SLICE_BYTES):
                toxic = batch.column(1).to_numpy()[at : at + len(texts)]
                data, offsets = words.raw(texts)
                begin, end, first = words.cut(data, offsets, words.ALNUM)
                doc = np.repeat(np.arange(len(texts)), np.diff(first))
                rows = []
                for h in entries(data, begin, end):
                    order = np.lexsort((h, doc))
                    h, d = h[order], doc[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                    new &= h != 0
                    rows.append((h[new], d[new]))
                h, d = (np.concatenate(x) for x in zip(*rows))
                # Summed within the slice: a row for each entry and label.
                key, index = np.unique(h, return_inverse=True)
                hit = np.bincount(index, toxic[d], len(key)).astype(np.int64)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(hit), pa.array(np.bincount(index, minlength=len(key)).astype(np.int64) - hit)], names=["entry", "toxic", "clean"])

    return sample.select("text", "toxic").transform(kit.arrow(run, "entry long, toxic long, clean long")).groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


FEATURES = [
    "log_words", "strong_density", "weak_density", "log_strong", "log_weak", "strong_kinds", "strong_gap", "alike_density", "second_person", "second_person_near",
    "capital_share", "capital_words", "exclamation", "question", "punctuation", "digit_share", "mixed_words", "runs", "masked", "long_words", "non_ascii",
]


def features(texts: pa.Array, strong: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """A row of dense features for each text."""
    data, offsets = words.raw(texts)
    n = len(texts)
    out = np.zeros((n, len(FEATURES)))
    if not len(data):
        return out
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "")
    begin, end, first = words.cut(data, offsets, words.ALNUM)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(n), n_words)
    known = entries(data, begin, end)
    hit_strong, hit_weak = (np.logical_or.reduce([member(x, h) for h in known]) for x in (strong, weak))
    second = member(np.sort(word_hashes(SECOND_PERSON)), known[0])

    def per_doc(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc[mask], minlength=n)

    def beside(mask: np.ndarray) -> np.ndarray:
        """Words with a marked word of the same text within NEAR words."""
        total = np.concatenate([[0], np.cumsum(mask)])
        i = np.arange(len(mask))
        return total[np.minimum(i + NEAR + 1, first[1:][doc])] - total[np.maximum(i - NEAR, first[:-1][doc])] > 0

    # Bytes by text: sums of marks between offsets.
    _, raw_offsets, buffer = texts.buffers()
    start = int(np.frombuffer(raw_offsets, np.int64)[texts.offset])
    raw = np.frombuffer(buffer, np.uint8)[start : start + len(data)]

    def bytes_(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[offsets[1:]] - total[offsets[:-1]]

    upper = raw != data
    letters = np.maximum(bytes_((data >= 97) & (data <= 122)), 1)
    digit = (data >= 48) & (data <= 57)
    size = np.maximum(np.diff(offsets), 1)
    many = np.maximum(n_words, 1)
    digits_in, uppers_in = (np.concatenate([[0], np.cumsum(m)]) for m in (digit, upper))
    length = end - begin
    word_digits, word_uppers = digits_in[end] - digits_in[begin], uppers_in[end] - uppers_in[begin]
    # Look-alike signs undone: other bytes, other words.
    plain = ALIKE[data]
    b2, e2, f2 = words.cut(data, offsets, ALIKE_WORD)
    changed = np.concatenate([[0], np.cumsum(plain != data)])
    odd = changed[e2] > changed[b2]
    b2, e2, doc2 = b2[odd], e2[odd], np.repeat(np.arange(n), np.diff(f2))[odd]
    alike = np.logical_or.reduce([member(strong, h) for h in entries(plain, b2, e2)]) if len(b2) else np.zeros(0, bool)
    triple = np.zeros(len(data), bool)
    triple[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & (data[2:] > 32)
    star = np.zeros(len(data), bool)
    star[1:-1] = np.isin(data[1:-1], [42, 35, 64, 36]) & words.ALNUM[data[:-2]] & words.ALNUM[data[2:]]
    hits = per_doc(hit_strong)
    kinds = np.unique(np.stack([doc[hit_strong], known[0][hit_strong].view(np.int64)]), axis=1)[0] if hit_strong.any() else np.zeros(0, np.int64)
    out[:] = np.stack(
        [
            np.log1p(n_words), hits / many, per_doc(hit_weak) / many, np.log1p(hits), np.log1p(per_doc(hit_weak)), np.log1p(np.bincount(kinds, minlength=n)), np.where(hits > 0, n_words / np.maximum(hits, 1), 0),
            np.bincount(doc2[alike], minlength=n) / many, per_doc(second) / many, per_doc(second & beside(hit_strong)) / many,
            bytes_(upper) / letters, per_doc((word_uppers == length) & (length > 1)) / many, bytes_(data == 33) / size, bytes_(data == 63) / size, bytes_((data > 32) & ~words.ALNUM[data]) / size,
            bytes_(digit) / size, per_doc((word_digits > 0) & (word_digits < length)) / many, bytes_(triple) / size, bytes_(star) / many, per_doc(length > 14) / many, bytes_(data >= 128) / size,
        ],
        axis=1,
    )
    return out


def word_hashes(some: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(some).encode(), np.uint8)
    end = np.cumsum([len(w.encode()) for w in some])
    return words.hashes(data, end - np.array([len(w.encode()) for w in some]), end)


@dataclass
class Model:
    """Boosted trees over binned features, then a monotone map."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, bin, value by node
    x: np.ndarray = field(default_factory=lambda: np.zeros(0))
    y: np.ndarray = field(default_factory=lambda: np.zeros(0))
    depth: int = 3

    def bins(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, rows[:, k], "left") for k, c in enumerate(self.cuts)], 1) if self.cuts else np.zeros(rows.shape, np.int64)

    def margin(self, rows: np.ndarray) -> np.ndarray:
        b, total = self.bins(rows), np.full(len(rows), self.base)
        for feature, at, value in self.trees:
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[np.arange(len(rows)), feature[node]] > at[node])
            total += value[node]
        return total

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Calibrated; a trace of the uncalibrated score keeps the order within a step."""
        p = 1 / (1 + np.exp(-self.margin(rows)))
        return 0.999 * np.interp(p, self.x, self.y) + 0.001 * p if len(self.x) else p


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the ends of each level with its mean."""
    order = np.argsort(x, kind="stable")
    levels: list[list[float]] = []  # sum, weight, first x, last x
    for a, b in zip(x[order], y[order]):
        levels.append([b, 1, a, a])
        while len(levels) > 1 and (levels[-2][0] * levels[-1][1] >= levels[-1][0] * levels[-2][1] or levels[-2][3] == levels[-1][2]):
            s, w, _, last = levels.pop()
            levels[-1][0] += s
            levels[-1][1] += w
            levels[-1][3] = last
    at = [v for s, w, a, b in levels for v in ((a, s / w), (b, s / w))]
    return np.array([a for a, _ in at]), np.array([b for _, b in at])


def train(rows: np.ndarray, labels: np.ndarray, apart: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.2, most_bins: int = 48, ridge: float = 1.0, least: float = 2.0) -> Model:
    """rows and labels to learn from; apart marks those that only calibrate."""
    share = float(labels.mean()) if len(labels) else 0.0
    model = Model(depth=depth, base=float(np.log(share / (1 - share))) if 0 < share < 1 else (-30.0 if share == 0 else 30.0))
    fit = ~apart
    if not 0 < share < 1 or len(set(labels[fit])) < 2:
        return model
    x, y = rows[fit], labels[fit].astype(float)
    model.cuts = [np.unique(np.quantile(x[:, k][x[:, k] != 0], np.linspace(0, 1, most_bins)[:-1])) if (x[:, k] != 0).any() else np.zeros(0) for k in range(x.shape[1])]
    model.cuts = [np.unique(np.concatenate([[0.0], c])) for c in model.cuts]
    b = model.bins(x)
    width, n_features = most_bins + 2, x.shape[1]
    total = np.full(len(x), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        nodes = 2 ** (depth + 1) - 1
        feature, at, value, node = np.zeros(nodes, np.int64), np.full(nodes, width), np.zeros(nodes), np.zeros(len(x), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            cell = (local[:, None] * n_features + np.arange(n_features)) * width + b
            sums = [np.bincount(cell.ravel(), np.repeat(w, n_features), count * n_features * width).reshape(count, n_features, width).cumsum(2) for w in (g, h)]
            (gl, hl), (gt, ht) = sums, (s[:, :1, -1:] for s in sums)
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = 0
            best = gain.reshape(count, -1).argmax(1)
            ok = gain.reshape(count, -1).max(1) > 1e-9
            feature[first : first + count] = best // width
            at[first : first + count] = np.where(ok, best % width, width)
            node = 2 * node + 1 + (b[np.arange(len(x)), feature[node]] > at[node])
        gs, hs = (np.bincount(node, w, nodes) for w in (g, h))
        value = -rate * gs / (hs + ridge)
        model.trees.append((feature, at, value))
        total += value[node]
    held = apart if len(set(labels[apart])) == 2 else fit
    model.x, model.y = isotonic(1 / (1 + np.exp(-model.margin(rows[held]))), labels[held].astype(float))
    return model


def held_out(column: str = "doc_id", folds: int = FOLDS):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == 0, F.lit(False))


@dataclass
class Scorer:
    strong: np.ndarray
    weak: np.ndarray
    model: Model

    def score(self, texts: pa.Array) -> np.ndarray:
        return self.model.score(features(texts, self.strong, self.weak))


def learn(docs: DataFrame, labels: DataFrame, *, folds: int = FOLDS, sample: int = SAMPLE) -> Scorer:
    """The lexicon and the model, from about ``sample`` labelled rows outside the held-out fold."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out("doc_id", folds)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("long")).alias("toxic"))
    n = known.count()
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < sample) if n > sample else known
    # drawn has about ``sample`` rows of two numbers, whatever the number of labels.
    texts = kit.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id"), "labelled")
    n_toxic, n_all = texts.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    n_clean = n_all - n_toxic
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    found = lexicon_rows(texts).where(F.col("toxic") >= LEAST_DOCS).withColumn("odds", odds).where(F.col("odds") > WEAK).orderBy(F.desc("odds"), "entry").limit(MOST_ENTRIES).collect()
    strong, weak = (np.sort(np.array([r.entry for r in found if (r.odds > STRONG) == is_strong], np.int64).view(np.uint64)) for is_strong in (True, False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in slices(as_strings(batch.column(1)), SLICE_BYTES):
                rows = features(some, strong, weak)
                yield pa.record_batch([batch.column(0).slice(at, len(some)), batch.column(2).slice(at, len(some)), pa.array(list(rows), pa.list_(pa.float64()))], names=["doc_id", "toxic", "row"])

    got = sorted(texts.select("doc_id", "text", "toxic").transform(kit.arrow(run, "doc_id long, toxic long, row array<double>")).collect())
    rows, y = np.array([r.row for r in got]).reshape(-1, len(FEATURES)), np.array([r.toxic for r in got], np.int64)
    apart = np.array([zlib.crc32(f"apart {r.doc_id}".encode()) % 4 == 0 for r in got], bool)
    return Scorer(strong, weak, train(rows, y, apart))


def with_scores(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """docs with a last column toxicity (0 to 1)."""
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in slices(as_strings(batch.column(text)), SLICE_BYTES):
                part = batch.slice(at, len(some))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scorer.score(some))], names=[*part.schema.names, "_score"])

    own = docs.toDF(*[f"in_{i}" for i in range(len(docs.columns))])
    schema = own.withColumn("_score", F.lit(0.0)).schema
    return own.transform(kit.arrow(run, schema)).toDF(*docs.columns, "toxicity")


def remove_toxic(docs: DataFrame, labelled: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **options) -> DataFrame:
    """docs without the rows that score threshold or more; learned from labelled (doc_id, text) and labels."""
    names = docs.columns
    scored = with_scores(docs.toDF(*[n if n == "text" else f"c_{i}" for i, n in enumerate(names)]), learn(labelled, labels, **options))
    return scored.where(F.col("toxicity") < threshold).drop("toxicity").toDF(*names)


def op5_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kit.read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_scores(docs, learn(docs, kit.read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))

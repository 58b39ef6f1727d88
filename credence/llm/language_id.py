"""Operator 4: language ID by averaged hashed subword embeddings with a linear softmax.

Subwords are runs of 2 to 4 characters inside words (with a mark at the ends of a word), hashed to
BUCKETS rows of an embedding.  A text is the mean of its subwords' rows; a linear softmax reads the label.
Both are trained together by stochastic gradient descent in numpy, in one task, from a bounded sample:
at most SAMPLE_ROWS rows in all, spread evenly over the labels (more labels than rows are an error) and picked by a hash of the id, each as a
whole and as two short passages.  That task gets hashed counts, not texts; the driver gets the two factors.  A fifth of the sample is
not trained on: there the temperature of the softmax is fitted, and from there comes the score below which
a text is rejected (at most REJECT_CORRECT of correct validation rows fall below it).

Every prediction reads the whole text, and nothing but the text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and is rejected; very long
texts are counted in pieces; equal texts get equal predictions; without a single labelled row everything
is ``und``; other columns pass through; a column named like one that is added is an error.
"""

from __future__ import annotations

import functools
import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.llm.common import give_back, refuse_clash, small_batches, table, worker_state

BUCKETS = 1 << 15
WIDTH = 16
#: The bound on the training sample, over all labels, and so on the number of labels: with more, training is an error.
SAMPLE_ROWS = 1600
EPOCHS, RATE = 12, 0.5
REJECT_CORRECT = 0.002
UNKNOWN = "und"
PIECE = 1 << 20
BATCH_ROWS = 256


@functools.lru_cache(maxsize=1)
def _letters():
    """Lower-case letter of each code point, 32 for what is no letter."""
    import numpy as np

    out = np.full(0x110000, 32, "u4")
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def subword_counts(text: str):
    """How often each bucket occurs among the subwords of the whole text."""
    import numpy as np

    total = np.zeros(BUCKETS, "i8")
    for at in range(0, len(text), PIECE):
        piece = text[max(0, at - 3) : at + PIECE]  # three characters again, for subwords across the cut
        new = 3 if at else 0
        c = _letters()[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "u4")].astype("u8")
        if not at:
            c, new = np.concatenate([[np.uint64(32)], c]), 0
        if at + PIECE >= len(text):
            c = np.concatenate([c, [np.uint64(32)]])
        space = c == 32
        hashed, inner_space = c * np.uint64(0x9E3779B97F4A7C15), None
        for n in (2, 3, 4):
            if len(c) < n:
                break
            hashed = (hashed[:-1] ^ (hashed[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c[n - 1 :] * np.uint64(0x94D049BB133111EB)
            if n == 2:
                ok = ~(space[:-1] & space[1:])
                inner_space = np.zeros(len(c) - 2 if len(c) > 2 else 0, bool) | space[1:-1]
            else:
                ok = ~inner_space[: len(hashed)]
                if n == 3 and len(c) > 3:
                    inner_space = space[1:-2] | space[2:-1]
            skip = max(0, new - n + 1)  # those wholly in the repeated characters were counted before
            picked = hashed[skip:][ok[skip:]]
            total += np.bincount((picked >> np.uint64(64 - 15)).astype("i8"), minlength=BUCKETS)
    return total


def _features(batches: Iterator) -> Iterator:
    """Sparse counts of each sampled text, and of two passages of it."""
    import pyarrow as pa

    for batch in batches:
        for label, text in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
            n = len(text)
            parts = [text] if n <= 200 else [text, text[n // 3 : n // 3 + 80], text[2 * n // 3 : 2 * n // 3 + 160]]
            for i, part in enumerate(parts):
                counts = subword_counts(part)
                at = counts.nonzero()[0]
                if len(at):
                    yield pa.RecordBatch.from_pylist([{"label": label, "place": i, "at": at.astype("u2").tobytes(), "n": counts[at].astype("u4").tobytes()}], schema=pa.schema([("label", pa.string()), ("place", pa.int32()), ("at", pa.binary()), ("n", pa.binary())]))


class Model:
    """``table[bucket, label]``: the embedding times the softmax's weights; scores are means of its rows."""

    def __init__(self, labels: list[str], scores, bias, temperature: float, reject_below: float):
        self.labels, self.scores, self.bias, self.temperature, self.reject_below = labels, scores, bias, temperature, reject_below

    def logits(self, counts):
        at = counts.nonzero()[0]
        if not len(at):
            return self.bias
        return counts[at] @ self.scores[at] / counts[at].sum() + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        import numpy as np

        if not has_letter(text) or not self.labels:
            return UNKNOWN, 0.0
        z = self.logits(subword_counts(text)) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.labels[best], float(p[best])

    def dump(self) -> bytes:
        import numpy as np

        out = io.BytesIO()
        np.savez(out, labels=np.array(self.labels, "U"), scores=self.scores, bias=self.bias, rest=np.array([self.temperature, self.reject_below]))
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Model:
        import numpy as np

        with np.load(io.BytesIO(data)) as x:
            return Model([str(v) for v in x["labels"]], x["scores"], x["bias"], float(x["rest"][0]), float(x["rest"][1]))


def _softmax(z):
    import numpy as np

    p = np.exp(z - z.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


def train(rows: list[tuple[str, int, bytes, bytes]], seed: int = 7) -> dict:
    """SGD over the sampled rows, at least one; every fifth is for calibration.  The factors of the model, by name."""
    import numpy as np

    labels = sorted({r[0] for r in rows})
    data = []
    for label, _, at, n in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        w = np.frombuffer(n, "u4").astype("f8")
        data.append((labels.index(label), np.frombuffer(at, "u2").astype("i8"), w / w.sum()))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(data))
    held = [data[i] for i in order[::5]] if len(data) >= 10 else data
    used = [data[i] for i in order if len(data) < 10 or i not in set(order[::5].tolist())]
    emb = rng.normal(0, 0.3, (BUCKETS, WIDTH))
    out, bias = rng.normal(0, 0.3, (WIDTH, len(labels))), np.zeros(len(labels))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(used)):
            y, at, w = used[i]
            x = w @ emb[at]
            error = _softmax(x @ out + bias)
            error[y] -= 1
            back = out @ error
            out -= rate * np.outer(x, error)
            bias -= 0.1 * rate * error
            # The row's mean is spread over its buckets, so each moves by its share of a fixed step.
            emb[at] -= rate * np.outer(w / w.max(), back) * 0.3
    scores = emb @ out
    z = np.array([w @ scores[at] + bias for _, at, w in held])
    y = np.array([d[0] for d in held])
    grid = np.geomspace(0.05, 20, 80)
    loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(z / temperature)
    right = p.max(1)[p.argmax(1) == y]
    reject_below = min(0.5, float(np.quantile(right, REJECT_CORRECT))) if len(right) else 0.0
    return {"labels": np.array(labels, "U"), "emb": emb, "out": out, "bias": bias, "rest": np.array([temperature, reject_below])}


def _trained(batches: Iterator) -> Iterator:
    """The factors, from all rows of the sample."""
    import numpy as np
    import pyarrow as pa

    rows = [(r["label"], r["place"], r["at"], r["n"]) for batch in batches for r in batch.to_pylist()]
    if rows:
        out = io.BytesIO()
        np.savez(out, **train(rows))
        rows.clear()
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["factors"])


def _model(factors: list[bytes]) -> Model:
    """The model of the factors; without any, one that knows no label."""
    import numpy as np

    if not factors:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    with np.load(io.BytesIO(factors[0])) as x:
        return Model([str(v) for v in x["labels"]], x["emb"] @ x["out"], x["bias"], float(x["rest"][0]), float(x["rest"][1]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "lang") -> Model:
    """Train on rows that are not held out and have a label and a text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(label).cast("string").alias("label"))
    rows = rows.filter(~held_out(F.col("id")) & F.col("label").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    # All labels, each of which has a row in the sample.
    sizes = rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(SAMPLE_ROWS + 1).collect()
    if len(sizes) > SAMPLE_ROWS:
        raise ValueError(f"more than {SAMPLE_ROWS} labels")
    quota = SAMPLE_ROWS // max(1, len(sizes))
    # A label's rows below this share of the hash are about twice its quota, so that only those are ranked.
    shares = docs.sparkSession.createDataFrame([(r["label"], min(1.0, (2 * quota + 100) / r["count"])) for r in sizes], "__label string, share double")
    place = F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(1 << 53))
    low = rows.select("id", "label", place.alias("place")).join(F.broadcast(shares), F.col("label") == F.col("__label")).filter("place < share")
    order = Window.partitionBy("label").orderBy("place", "id")
    picked = low.select("id", "label", "place").distinct().withColumn("k", F.row_number().over(order)).filter(F.col("k") <= quota)
    # At most SAMPLE_ROWS ids: bounded, so they may be broadcast.  A repeated id counts once with a label.
    chosen = picked.select(F.col("id").alias("__id"), F.col("label").alias("__l"))
    sample = rows.join(F.broadcast(chosen), F.col("id").eqNullSafe(F.col("__id")) & (F.col("label") == F.col("__l")), "left_semi").groupBy("id", "label").agg(F.min("text").alias("text"))
    found = sample.select("label", "text").mapInArrow(_features, "label string, place int, at binary, n binary")
    # The sample is bounded, so one task can train; in the driver it would take memory in the JVM and again in Python.
    return _model([bytes(r["factors"]) for r in found.repartition(1).mapInArrow(_trained, "factors binary").collect()])


def predict(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score", rejected: str = "rejected") -> DataFrame:
    """Add the predicted label, its calibrated probability and whether the text is rejected."""
    names = [lang, score, rejected]
    refuse_clash(docs, set(names))
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model.dump())
    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType(), False), T.StructField(score, T.DoubleType(), False), T.StructField(rejected, T.BooleanType(), False)])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        worker_state("language_id")
        own = Model.load(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                found = [own.predict(v) for v in part.column(part.schema.get_field_index(text)).to_pylist()]
                made = [pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64()), pa.array([a == UNKNOWN or b < own.reject_below for a, b in found], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *names])

    return docs.mapInArrow(run, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang"))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")

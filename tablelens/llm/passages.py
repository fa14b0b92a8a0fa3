"""Document quality by attention over passages (multiple-instance learning)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import from_arrow_schema

from tablelens.llm.common import in_pieces, mixed, pin_batches, utf8, word_hashes, words, written
from tablelens.llm.features import held_out, labelled_sample

WORDS = 64  # words of a passage
SAMPLE_PER_CLASS = 3000  # labelled documents that the model is fitted on, at most, of each label
SAMPLE_PASSAGES = 300_000  # and passages of theirs
KEEP = 0.7
_KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:", "!?", "#$%&*@^~", "|<>=+_/\\`{}[]", "\"'()-", "\n")
_KIND = np.full(256, len(_KINDS), np.uint8)
for _k, _letters in enumerate(_KINDS):
    for _letter in _letters:
        _KIND[ord(_letter)] = _k
_KIND[128:] = len(_KINDS) + 1  # bytes of non-ASCII characters
FEATURES = len(_KINDS) + 2 + 9


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Passages per text and the features of each passage, in order; a text without words is one passage of zeros."""
    raw, offsets = utf8(texts)
    starts, ends, owner = words(raw, offsets)
    n = np.bincount(owner, minlength=len(texts))
    per_text = np.maximum(-(-n // WORDS), 1)
    first_passage = np.cumsum(per_text) - per_text
    out = np.zeros((int(per_text.sum()), FEATURES))
    if not len(starts):
        return per_text, out
    place = np.arange(len(starts)) - (np.cumsum(n) - n)[owner]
    passage = first_passage[owner] + place // WORDS
    begin = np.flatnonzero(np.diff(passage, prepend=-1))
    here = passage[begin]
    count = np.diff(np.append(begin, len(starts)))
    low, high = starts[begin], ends[np.append(begin[1:], len(starts)) - 1]
    size = np.maximum(high - low, 1)
    kinds = _KIND[raw]
    for kind in range(len(_KINDS) + 2):
        sums = np.concatenate([[0], np.cumsum(kinds == kind, dtype=np.int32)])
        out[here, kind] = (sums[high] - sums[low]) / size
    at = len(_KINDS) + 2
    hashes, lengths = word_hashes(raw, starts, ends), ends - starts
    new = np.zeros(len(starts))
    order = np.lexsort((hashes, passage))
    sorted_passage, sorted_hash = passage[order], hashes[order]
    new[order] = np.append(True, (sorted_passage[1:] != sorted_passage[:-1]) | (sorted_hash[1:] != sorted_hash[:-1]))
    again = np.zeros(len(starts))
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    symbol = (_KIND[raw[ends - 1]] >= 4) & (_KIND[raw[ends - 1]] <= 6)
    bare = (_KIND[raw[starts]] >= 2) & (_KIND[raw[starts]] <= len(_KINDS)) & (lengths == 1)
    total = lambda x: np.add.reduceat(x.astype(float), begin)
    mean = total(lengths) / count
    extra = (
        total(new) / count, total(again) / count, total(symbol) / count, total(bare) / count, mean / 10,
        np.sqrt(np.maximum(total(lengths * lengths) / count - mean * mean, 0)) / 10, np.log1p(count) / 5,
        total(_KIND[raw[starts]] == 1) / count, np.minimum(n[owner[begin]], 1000) / 1000,
    )
    for step, values in enumerate(extra):
        out[here, at + step] = values
    return per_text, out


@dataclass
class AttentionModel:
    """Encoder, gated attention and classifier over the attended representation of a document."""

    centre: np.ndarray
    scale: np.ndarray
    encoder: np.ndarray
    encoder_bias: np.ndarray
    tanh_gate: np.ndarray
    sigmoid_gate: np.ndarray
    attention: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    prior: float = 0.0

    def forward(self, x: np.ndarray, bag: np.ndarray, bags: int) -> dict[str, np.ndarray]:
        """Every step from standardised passages to the documents' logits; ``bag`` is the document of each passage."""
        h = np.tanh(x @ self.encoder + self.encoder_bias)
        t, g = np.tanh(h @ self.tanh_gate), _s(h @ self.sigmoid_gate)
        score = (t * g) @ self.attention
        first = np.searchsorted(bag, np.arange(bags))
        top = np.maximum.reduceat(score, first)
        e = np.exp(score - top[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "logit": z @ self.out + self.out_bias[0]}

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -6, 6)

    def score(self, texts: pa.Array) -> np.ndarray:
        """P(label 1) of each text."""
        out = np.zeros(len(texts))
        for first, part in in_pieces(texts):
            n, x = encode(part)
            bag = np.repeat(np.arange(len(part)), n)
            out[first : first + len(part)] = _s(self.forward(self.standard(x), bag, len(part))["logit"] + self.prior)
        return out


def _s(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(x: np.ndarray, bag: np.ndarray, label: np.ndarray, share: float, hidden: int = 16, gate: int = 8,
        epochs: int = 30, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 1) -> AttentionModel:
    """Learn from document labels by Adam; ``share`` of label 1 in all labels sets the prior of the scores."""
    random = np.random.default_rng(seed)
    scale = x.std(0) if len(x) else np.ones(FEATURES)
    model = AttentionModel(
        x.mean(0) if len(x) else np.zeros(FEATURES), np.where(scale > 1e-6, scale, 1.0),
        random.normal(0, FEATURES**-0.5, (FEATURES, hidden)), np.zeros(hidden),
        random.normal(0, hidden**-0.5, (hidden, gate)), random.normal(0, hidden**-0.5, (hidden, gate)),
        random.normal(0, gate**-0.5, gate), random.normal(0, hidden**-0.5, hidden), np.zeros(1),
    )
    names = [field.name for field in fields(AttentionModel)][2:-1]
    moments = {name: (np.zeros_like(getattr(model, name)), np.zeros_like(getattr(model, name))) for name in names}
    x, step = model.standard(x), 0
    first = np.searchsorted(bag, np.arange(len(label) + 1))
    for _ in range(epochs if len(label) else 0):
        order = random.permutation(len(label))
        for begin in range(0, len(order), batch):
            docs = order[begin : begin + batch]
            sizes = first[docs + 1] - first[docs]
            rows = np.repeat(first[docs] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            grads = _gradients(model, x[rows], np.repeat(np.arange(len(docs)), sizes), label[docs])
            step += 1
            for name in names:
                value, (m, v) = getattr(model, name), moments[name]
                slope = grads[name] + decay * value
                m += 0.1 * (slope - m)
                v += 0.001 * (slope * slope - v)
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    seen = np.clip(label.mean() if len(label) else 0.5, 0.01, 0.99)
    share = np.clip(share, 0.01, 0.99)
    model.prior = float(np.log(share / (1 - share)) - np.log(seen / (1 - seen)))
    return model


def _gradients(model: AttentionModel, x: np.ndarray, bag: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean log loss."""
    f = model.forward(x, bag, len(label))
    h, t, g, a = f["h"], f["t"], f["g"], f["a"]
    wrong = (_s(f["logit"]) - label) / len(label)
    to_z = wrong[:, None] * model.out
    to_a = (to_z[bag] * h).sum(1)
    first = np.searchsorted(bag, np.arange(len(label)))
    to_score = a * (to_a - np.add.reduceat(a * to_a, first)[bag])
    to_gated = to_score[:, None] * model.attention
    to_t, to_g = to_gated * g * (1 - t * t), to_gated * t * g * (1 - g)
    to_h = a[:, None] * to_z[bag] + to_t @ model.tanh_gate.T + to_g @ model.sigmoid_gate.T
    to_line = to_h * (1 - h * h)
    return {
        "encoder": x.T @ to_line, "encoder_bias": to_line.sum(0), "tanh_gate": h.T @ to_t, "sigmoid_gate": h.T @ to_g,
        "attention": to_score @ (t * g), "out": f["z"].T @ wrong, "out_bias": np.array([wrong.sum()]),
    }


_BAG = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("passages", pa.int64()), ("x", pa.list_(pa.float32()))])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, part in in_pieces(batch.column(2)):
            n, x = encode(part)
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32) * FEATURES
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(first, len(part)), batch.column(1).slice(first, len(part)), pa.array(n),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.float32).ravel())),
            ], schema=_BAG)


def passage_bound(n: np.ndarray, limit: int) -> int:
    """The largest number of passages per document with which all documents together stay within ``limit``; at least 1."""
    low, high = 1, max(int(n.max(initial=1)), 1)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if np.minimum(n, middle).sum() <= limit else (low, middle - 1)
    return low


def _thinned(bound: int):
    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                n = one.column(2)[0].as_py()
                if n > bound:
                    chosen = np.sort(np.argsort(mixed(np.arange(n, dtype=np.uint64)), kind="stable")[:bound])
                    x = one.column(3).flatten().to_numpy().reshape(-1, FEATURES)[chosen]
                    cells = pa.ListArray.from_arrays(pa.array([0, x.size], pa.int32()), pa.array(x.ravel()))
                    one = pa.RecordBatch.from_arrays([one.column(0), one.column(1), pa.array([bound], pa.int64()), cells], schema=_BAG)
                yield one

    return thinned


def train(docs: DataFrame, labels: DataFrame) -> AttentionModel:
    """Fit on at most 3,000 labelled documents of each label that are not held out.

    If they hold more than 300,000 passages, the longest are thinned to hashed passages, all to one bound, and none is
    left out; Spark makes the features, the driver sees only those of the sample (at most about 25 MB).
    """
    chosen, share = labelled_sample(labels, "quality", SAMPLE_PER_CLASS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(written(chosen, "chosen")), "doc_id").select("doc_id", "label", "text")
    bags = written(rows.mapInArrow(_bags, from_arrow_schema(_BAG)), "bags")
    sizes = bags.select("doc_id", "passages").toArrow()
    ids, n = sizes["doc_id"].to_numpy(), sizes["passages"].to_numpy()
    order = np.lexsort((ids, mixed(ids.astype(np.int64).view(np.uint64))))
    bound = passage_bound(n, SAMPLE_PASSAGES)
    fitting = np.cumsum(np.minimum(n, bound)[order]) <= SAMPLE_PASSAGES  # all, unless the rows alone are more
    most = np.unique(ids[order[fitting]]).tolist()
    wanted = docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(most, pa.int64())}))
    got = bags.join(F.broadcast(wanted), "doc_id").select(*_BAG.names)
    if n.max(initial=0) > bound:
        got = got.mapInArrow(_thinned(bound), from_arrow_schema(_BAG))
    got = got.orderBy("doc_id").toArrow()
    x = got["x"].combine_chunks().flatten().to_numpy().astype(float).reshape(-1, FEATURES) if len(got) else np.zeros((0, FEATURES))
    bag = np.repeat(np.arange(len(got)), got["passages"].to_numpy())
    return fit(x, bag, got["label"].to_numpy().astype(float), share)


def score_quality(df: DataFrame, model: AttentionModel, text_column: str = "text", name: str = "score") -> DataFrame:
    """Add P(label 1) from the whole text, cut into passages of 64 words.

    Passages are encoded by character kinds, repetition and word shape; the attention, learned from
    document labels alone, weighs them, and the weighted representation is scored. Rows are
    independent, nothing is shuffled; only the text is an input. Null and empty texts are one empty
    passage; repeated rows get equal scores; an earlier column ``name`` is replaced, others are kept.
    """
    spark = pin_batches(df.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(sent.value.score(texts))

    return df.withColumn(name, score(F.coalesce(F.col(f"`{text_column}`"), F.lit(""))))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train, then score every document: ``doc_id``, ``held_out``, ``score`` and ``predicted`` (score >= 0.7)."""
    scored = score_quality(docs, train(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted")
    )

"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.batches import bound_batches, flat_bytes, groups, tidied

# Labelled rows that the network is fitted on, half of them of either label, drawn by a
# hash, and the longest text among them. Bounds the fit, whatever the number of labels.
TRAIN_ROWS = 2400
TRAIN_TEXT_BYTES = 40_000
PIECES = 16
EPOCHS = 12
RATE = 0.01

CHUNK, STRIDE = 512, 448
EMBED, WIDTH, STEP, FILTERS, HIDDEN = 6, 6, 2, 24, 12

# Chunks that are scored in one go.
CHUNKS = 256


@dataclass
class Net:
    """byte -> embedding -> filters -> maximum over a chunk -> hidden layer -> maximum,
    minimum and mean over the chunks of a document -> probability."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.dense, self.dense_bias, self.out, self.out_bias]


def new_net(seed: int = 7) -> Net:
    rng = np.random.default_rng(seed)

    def draw(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    embed = rng.standard_normal((257, EMBED)).astype(np.float32)  # 256: beyond a text's end
    zero = lambda n: np.zeros(n, np.float32)
    return Net(embed, draw(WIDTH * EMBED, FILTERS), zero(FILTERS), draw(FILTERS, HIDDEN), zero(HIDDEN), draw(3 * HIDDEN, 1)[:, 0], zero(1))


def cut(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping chunks over all bytes of all texts, and how many each text has. The
    last chunk ends where the text does; a text shorter than a chunk, or empty, is filled
    up with 256."""
    sizes = np.diff(starts)
    n = np.maximum(1, -(-(sizes - (CHUNK - STRIDE)) // STRIDE))
    text = np.repeat(np.arange(len(n)), n)
    at = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    at = np.minimum(at, np.maximum(0, sizes[text] - CHUNK))
    place = at[:, None] + np.arange(CHUNK)
    inside = place < sizes[text][:, None]
    chunks = np.full(place.shape, 256, np.int32)
    chunks[inside] = flat[(starts[:-1][text][:, None] + place)[inside]]
    return chunks, n


def windows(net: Net, chunks: np.ndarray) -> np.ndarray:
    """Embedded windows: chunk, position, value."""
    values = net.embed[chunks].reshape(len(chunks), CHUNK * EMBED)
    count = (CHUNK - WIDTH) // STEP + 1
    shape = (len(chunks), count, WIDTH * EMBED)
    steps = (values.strides[0], STEP * EMBED * values.itemsize, values.itemsize)
    return np.lib.stride_tricks.as_strided(values, shape, steps)


def pooled(net: Net, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximum of each filter over each chunk, and the window it is at."""
    seen = windows(net, chunks)
    answers = (np.ascontiguousarray(seen).reshape(-1, WIDTH * EMBED) @ net.filters).reshape(len(chunks), -1, FILTERS)
    at = answers.argmax(axis=1)
    return np.take_along_axis(answers, at[:, None, :], 1)[:, 0, :] + net.bias, at


def hidden(net: Net, chunks: np.ndarray) -> np.ndarray:
    """The hidden layer of each chunk, CHUNKS at a time."""
    out = np.empty((len(chunks), HIDDEN), net.filters.dtype)
    for i in range(0, len(chunks), CHUNKS):
        seen = windows(net, chunks[i : i + CHUNKS])
        answers = np.ascontiguousarray(seen).reshape(-1, WIDTH * EMBED) @ net.filters
        top = answers.reshape(len(seen), -1, FILTERS).max(axis=1) + net.bias
        out[i : i + CHUNKS] = np.tanh(np.maximum(top, 0) @ net.dense + net.dense_bias)
    return out


def combine(net: Net, layers: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One number for each text from its chunks' hidden layers."""
    at = np.cumsum(n) - n
    most, least = np.maximum.reduceat(layers, at), np.minimum.reduceat(layers, at)
    mean = np.add.reduceat(layers, at) / n[:, None]
    return np.hstack([most, least, mean]) @ net.out + net.out_bias[0]


def probability(net: Net, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of every whole text, chunk by chunk: memory follows the bytes given."""
    out = np.zeros(len(starts) - 1)
    for first, last in groups(starts, CHUNKS * STRIDE):
        if last == first + 1 and starts[last] - starts[first] > CHUNKS * STRIDE:
            out[first] = _long(net, flat[starts[first] : starts[last]])
            continue
        chunks, n = cut(flat[starts[first] : starts[last]], starts[first : last + 1] - starts[first])
        out[first:last] = combine(net, hidden(net, chunks), n)
    return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def _long(net: Net, text: np.ndarray) -> float:
    """One long text: the same chunks as `cut` makes, cut part by part."""
    layers = []
    total = max(1, -(-(len(text) - (CHUNK - STRIDE)) // STRIDE))
    for i in range(0, total, CHUNKS):
        part = text[i * STRIDE : (min(total, i + CHUNKS) - 1) * STRIDE + CHUNK]
        chunks, _ = cut(part, np.array([0, len(part)]))
        layers.append(hidden(net, chunks))
    return float(combine(net, np.vstack(layers), np.array([total]))[0])


def train(texts: pa.Array, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Net:
    """Fit by Adam on the logistic loss, the two labels weighing the same. Besides each
    text the network sees a short piece of it, so that short texts are judged by what is
    in them."""
    net = new_net(seed)
    flat, starts = flat_bytes(with_pieces(texts, np.random.default_rng(seed)))
    labels = np.concatenate([labels, labels])
    chunks, n = cut(flat, starts)
    firsts = np.cumsum(n) - n
    weight = np.where(labels == 1, 0.5 / max(1e-9, labels.mean()), 0.5 / max(1e-9, 1 - labels.mean()))
    rng = np.random.default_rng(seed)
    momentum = [np.zeros_like(p) for p in net.parts()]
    square = [np.zeros_like(p) for p in net.parts()]
    turn = 0
    for epoch in range(epochs):
        order = rng.permutation(len(n))
        for group in np.array_split(order, max(1, len(order) // 24)):
            own = np.concatenate([np.arange(firsts[i], firsts[i] + n[i]) for i in group])
            slopes = gradients(net, chunks[own], n[group], labels[group], weight[group])
            turn += 1
            rate = RATE * (1 - 0.9 * epoch / epochs)
            for p, g, m, s in zip(net.parts(), slopes, momentum, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(s / (1 - 0.999**turn)) + 1e-6)
    return net


def with_pieces(texts: pa.Array, rng: np.random.Generator) -> pa.Array:
    """The texts, then as many pieces of 15 to 300 characters."""
    whole = texts.to_pylist()
    sizes, places = rng.integers(15, 300, len(whole)), rng.random(len(whole))
    pieces = [t[(i := int(p * max(1, len(t) - n))) : i + n] for t, n, p in zip(whole, sizes, places, strict=True)]
    return pa.array(whole + pieces, pa.string())


def gradients(net: Net, chunks: np.ndarray, n: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    top, at = pooled(net, chunks)
    active = np.maximum(top, 0)
    layers = np.tanh(active @ net.dense + net.dense_bias)
    doc = np.repeat(np.arange(len(n)), n)
    begin = np.cumsum(n) - n
    most, least = np.maximum.reduceat(layers, begin), np.minimum.reduceat(layers, begin)
    mean = np.add.reduceat(layers, begin) / n[:, None]
    joined = np.hstack([most, least, mean])
    p = 1 / (1 + np.exp(-(joined @ net.out + net.out_bias[0])))
    d = ((p - labels) * weight / len(n)).astype(np.float32)
    d_joined = d[:, None] * net.out
    d_layers = d_joined[:, 2 * HIDDEN :][doc] / n[doc][:, None]
    for k, pick in enumerate((most, least)):
        hit = layers == pick[doc]
        share = hit / np.add.reduceat(hit, begin, dtype=np.float32)[doc]  # equal chunks share it
        d_layers = d_layers + share * d_joined[:, k * HIDDEN : (k + 1) * HIDDEN][doc]
    d_sum = (d_layers * (1 - layers**2)).astype(np.float32)
    d_top = (d_sum @ net.dense.T) * (top > 0)
    # Only the window at each filter's maximum takes part.
    g_filters, g_embed = np.zeros_like(net.filters), np.zeros_like(net.embed)
    rows = np.arange(len(chunks))
    for f in range(FILTERS):
        spot = at[:, f, None] * STEP + np.arange(WIDTH)
        bytes_ = chunks[rows[:, None], spot]
        g_filters[:, f] = d_top[:, f] @ net.embed[bytes_].reshape(len(rows), -1)
        flow = d_top[:, f, None, None] * net.filters[:, f].reshape(WIDTH, EMBED)
        np.add.at(g_embed, bytes_.ravel(), flow.reshape(-1, EMBED))
    return [
        g_embed, g_filters, d_top.sum(axis=0), active.T @ d_sum, d_sum.sum(axis=0),
        (joined.T @ d).astype(np.float32), np.array([d.sum()], np.float32),
    ]


def bounded(text: str) -> Column:
    """A text of TRAIN_TEXT_BYTES at most: of a longer one PIECES pieces from its beginning
    to its end, one a line."""
    n = F.char_length(text)
    size = F.greatest(F.lit(1), F.floor(n * (TRAIN_TEXT_BYTES / PIECES) / F.octet_length(text)) - 1).cast("int")
    piece = lambda i: F.substr(F.col(text), F.floor(i * (n - size) / (PIECES - 1)).cast("int") + 1, size)
    pieces = F.array_join(F.array(*[piece(F.lit(i)) for i in range(PIECES)]), "\n")
    return F.when(F.octet_length(text) > TRAIN_TEXT_BYTES, pieces).otherwise(F.col(text))


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> Net | float:
    """Fit on a bounded sample of labelled texts: of each label the first TRAIN_ROWS / 2 ids
    by their hash, texts whole up to TRAIN_TEXT_BYTES and in pieces beyond.

    `labels` holds `id` and a label 0 or 1; other labels and nulls are left out. With one
    label only, its value is returned in place of a network, 0.5 without any.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(label).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 0.5))
    drawn = [known.where(F.col("label") == x).dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS // 2) for x in (0, 1)]
    # TRAIN_ROWS ids at most, so they may be broadcast; of an id that is repeated one text is taken.
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(drawn[0].unionByName(drawn[1])), "id")
    sample = rows.groupBy("id", "label").agg(F.min(bounded("text")).alias("text")).toArrow().sort_by([("id", "ascending"), ("text", "ascending"), ("label", "ascending")])
    values = sample["label"].to_numpy().astype(np.float32)
    if len(set(values)) < 2:
        return float(values[0]) if len(values) else 0.5
    return train(sample["text"].combine_chunks(), values)


def score_quality(docs: DataFrame, net: Net | float, text: str = "text") -> DataFrame:
    """Add `score` (0 to 1, higher: label 1 likelier) and `predicted` (1 from 0.5 on) to
    `docs`; columns of these names are replaced.

    Null and empty texts are scored as one empty chunk. Repeated rows are scored each; an
    empty table gives none; very long texts are taken in parts.
    """
    bound_batches(docs.sparkSession)
    frozen = docs.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    @tidied("quality_net")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = frozen.value
        for texts in batches:
            if isinstance(net, float):
                yield pa.array(np.full(len(texts), net))
            else:
                # Sums depend on which texts share a product, far behind the sixth place.
                yield pa.array(probability(net, *flat_bytes(texts)).round(6))

    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    scored = docs.select(F.struct(*docs.columns).alias("row"), score(F.col(text)).alias("score")).select(*[F.col("row")[c].alias(c) for c in kept], "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

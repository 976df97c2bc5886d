"""Language of a text by a byte convolutional network."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.arrays import chunks
from millrace.llm.rows import fresh

#: Bytes of a window. Every text is cut into windows from its first byte to its last; zeros fill the last one.
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
#: Labelled rows of each language from which the network is fitted, at most, and characters of each.
ROWS_PER_LANGUAGE = 600
PIECE = 320
EPOCHS = 8
UNKNOWN = "und"
_BATCH = 256


class Network(NamedTuple):
    """`filters[k][j]` weighs the byte at place j of a window of `WIDTHS[k]` bytes, for each filter."""

    languages: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from fitting: crc32 of the id as text, mod 4, is 2. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def windows(texts: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Of runs of texts: the rows, their windows, the text of each window, and its number of bytes."""
    for chunk in chunks(texts):
        length = np.diff(chunk.begin) - 1
        number = np.maximum(-(-length // WINDOW), 1)
        first = np.cumsum(number) - number
        text = np.repeat(np.arange(chunk.n), number)
        flat = np.zeros(int(number.sum()) * WINDOW, np.uint8)
        inner = np.arange(int(length.sum()))
        own = np.repeat(np.arange(chunk.n), length)
        behind = np.cumsum(length) - length
        flat[inner - behind[own] + first[own] * WINDOW] = chunk.data[inner + own]
        size = np.clip(length[text] - (np.arange(len(text)) - first[text]) * WINDOW, 1, WINDOW)
        yield chunk.rows, flat.reshape(-1, WINDOW), text, size


def _convolve(net: Network, x: np.ndarray) -> list[np.ndarray]:
    """For each width, the filters' answers at every place of the windows."""
    found = []
    for width, table in zip(WIDTHS, net.filters):
        places = WINDOW - width + 1
        z = table[0].take(x[:, :places], axis=0)
        for j in range(1, width):
            z += table[j].take(x[:, j : j + places], axis=0)
        found.append(z)
    return found


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _paired(net: Network) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each width, parts `(place, bytes, table)`: a table of two bytes at once saves half of the look-ups."""
    both = lambda t, j: (t[j][None, :, :] + t[j + 1][:, None, :]).reshape(-1, FILTERS)
    return [[(j, 2, both(t, j)) if j + 1 < len(t) else (j, 1, t[j]) for j in range(0, len(t), 2)] for t in net.filters]


def log_probabilities(net: Network, x: np.ndarray, tables: list | None = None) -> np.ndarray:
    """Of each language, for each window."""
    tables = tables or _paired(net)
    out = np.zeros((len(x), len(net.languages)), np.float32)
    for at in range(0, len(x), _BATCH):
        one = x[at : at + _BATCH].astype(np.intp)
        two = one[:, :-1] + (one[:, 1:] << 8)
        pooled = []
        for width, parts in zip(WIDTHS, tables):
            places = WINDOW - width + 1
            z = None
            for j, size, table in parts:
                part = table.take((two if size == 2 else one)[:, j : j + places], axis=0)
                z = part if z is None else np.add(z, part, out=z)
            pooled.append(z.max(axis=1))
        out[at : at + _BATCH] = _log_softmax(np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0) @ net.out + net.out_bias)
    return out


def fit(texts: list[str], labels: list[str], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """A network fitted by Adam on the windows of labelled texts. With no texts it knows no language."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    net = Network(
        languages,
        [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS), np.float32),
        rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    for table in net.filters:
        table[:, 0] = 0  # the zeros that fill a window
    if len(languages) < 2:
        return net
    number = {name: k for k, name in enumerate(languages)}
    parts = [(x, np.array([number[n] for n in labels[rows]])[text]) for rows, x, text, _ in windows(pa.array(texts, pa.string()))]
    x, y = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    weights = [*net.filters, net.bias, net.out, net.out_bias]
    moment = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 128):
            some = order[at : at + 128]
            own, gold = x[some], y[some]
            answers = _convolve(net, own)
            best = [z.argmax(axis=1) for z in answers]
            pooled = np.concatenate([np.take_along_axis(z, b[:, None], 1)[:, 0] for z, b in zip(answers, best)], axis=1)
            hidden = np.maximum(pooled + net.bias, 0)
            delta = np.exp(_log_softmax(hidden @ net.out + net.out_bias))
            delta[np.arange(len(gold)), gold] -= 1
            delta /= len(gold)
            back = (delta @ net.out.T) * (hidden > 0)
            grads = []
            for k, width in enumerate(WIDTHS):
                share = back[:, k * FILTERS : (k + 1) * FILTERS]
                grad = np.zeros_like(net.filters[k])
                for j in range(width):
                    byte = np.take_along_axis(own, best[k] + j, 1).astype(np.int64)
                    cell = byte * FILTERS + np.arange(FILTERS)
                    grad[j] = np.bincount(cell.ravel(), share.ravel(), 256 * FILTERS).reshape(256, FILTERS)
                grad[:, 0] = 0
                grads.append(grad)
            grads += [back.sum(axis=0), hidden.T @ delta, delta.sum(axis=0)]
            step += 1
            for w, g, (m, v) in zip(weights, grads, moment):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE, seed: int = 7) -> Network:
    """Fits the network on a bounded sample: of each label, the `rows_per_language` labelled rows outside the held-out
    part that come first by a hash, and of each a piece of `PIECE` characters. Rows without text or label are passed over."""
    usable = ~held_out(id_col) & F.col(label_col).isNotNull() & F.col(text_col).isNotNull()
    # a row for each label, of which the network holds weights anyway
    held = {r[0]: r[1] for r in docs.where(usable).groupBy(label_col).count().collect()}
    if not held:
        return fit([], [], seed=seed)
    key = F.xxhash64(F.col(id_col), F.lit(seed))
    piece = F.substr(F.col(text_col), F.lit(1) + F.pmod(key, F.greatest(F.length(text_col) - PIECE, F.lit(1))).cast("int"), F.lit(PIECE))
    # this filter alone leaves about four times as many rows as are taken
    share = F.create_map(*[F.lit(x) for k, n in held.items() for x in (k, 4.0 * rows_per_language / n)])[F.col(label_col)]
    early = key.cast("double") / F.lit(2.0**64) + 0.5 < share
    near = docs.where(usable & early).select(F.col(label_col).alias("label"), key.alias("key"), piece.alias("piece"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("key", "piece")))
    taken = ranked.where(F.col("rank") <= rows_per_language).orderBy("label", "rank").select("label", "piece").collect()
    return fit([r.piece for r in taken], [r.label for r in taken], seed=seed)


def identify(net: Network, texts: pa.Array, has_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the language of each text (-1: unknown) and its probability. The windows' answers are averaged by
    their bytes."""
    best, score = np.full(len(texts), -1), np.zeros(len(texts))
    if net.languages:
        tables = _paired(net)
        for rows, x, text, size in windows(texts):
            weighed = log_probabilities(net, x, tables) * size[:, None]
            first = np.searchsorted(text, np.arange(rows.stop - rows.start))
            mean = np.add.reduceat(weighed, first, axis=0) / np.add.reduceat(size, first)[:, None]
            p = np.exp(_log_softmax(mean.astype(np.float64)))
            best[rows], score[rows] = p.argmax(axis=1), p.max(axis=1)
    best[~has_letter], score[~has_letter] = -1, 0
    return best, np.clip(score, 0, 1)


def _has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, held_out, lang_pred, score)` of every row, from its whole text alone. Null texts and texts without a
    letter get `und` and score 0, as do all texts if the network knows no language. One row in, one row out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"), _has_letter(text_col).alias("letter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*net.languages, UNKNOWN]
        for batch in batches:
            best, score = identify(net, batch.column("text"), batch.column("letter").to_numpy(zero_copy_only=False))
            lang = pa.array([names[k] for k in best.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), lang, pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, net: Network, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose language the network names with at least `min_score`. Texts that are null
    or have no letter go."""
    flag = fresh(docs, "letter")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = identify(net, batch.column(text_col), batch.column(flag).to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array((best >= 0) & (score >= min_score))).drop_columns([flag])

    return docs.withColumn(flag, _has_letter(text_col)).mapInArrow(run, docs.schema)

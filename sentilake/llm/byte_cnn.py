"""Text quality by a byte-level convolutional network in numpy.

Bytes become vectors, filters of ``WIDTH`` bytes run over them at every fourth place, and each chunk of ``CHUNK`` bytes (the
next one begins before it ends, so that together they cover the whole text) keeps its largest answer to each filter. A small
layer turns these into the chunk's log-odds; the text's are their mean, weighted by bytes. A chunk that says the same thing
over and over answers few filters, one full of symbols or capitals answers its own: both show after the pooling.

Training takes a bounded sample: of each class the ``SAMPLE`` labelled rows of least hash, and of each of their texts
``PIECES`` pieces, evenly spread. Scoring reads every byte of every text.
"""

import pickle

import numpy as np
from pyspark.sql import functions as F

from sentilake.llm.bytehash import parts, string_column
from sentilake.llm.common import small_batches

SAMPLE = 1200
PIECES = 4
WIDTH, STRIDE, DIMENSION, FILTERS, HIDDEN = 16, 4, 8, 24, 16
CHUNK, OVERLAP = 512, 64
BLOCK = OVERLAP  # chunks are runs of whole blocks
PER_CHUNK = CHUNK // BLOCK
EPOCHS, BATCH, RATE, SEED = 20, 64, 0.004, 11
PART = 1 << 18


def initial(seed=SEED):
    rng = np.random.Generator(np.random.PCG64(seed))
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return {
        "embed": normal(256, DIMENSION, scale=0.5),
        "filters": normal(WIDTH, DIMENSION, FILTERS, scale=(WIDTH * DIMENSION) ** -0.5),
        "bias": np.zeros(FILTERS, dtype=np.float32),
        "hidden": normal(FILTERS + 1, HIDDEN, scale=FILTERS**-0.5),
        "hidden_bias": np.zeros(HIDDEN, dtype=np.float32),
        "out": normal(HIDDEN, scale=HIDDEN**-0.5),
        "out_bias": np.zeros(1, dtype=np.float32),
    }


def laid_out(data, offsets):
    """Texts one after the other, each padded by zero bytes so far that no window which begins in it sees the next one."""
    sizes = np.diff(offsets)
    blocks = -(-(sizes + WIDTH - STRIDE) // BLOCK)
    first = np.cumsum(blocks) - blocks
    out = np.zeros(int(blocks.sum()) * BLOCK + WIDTH, dtype=np.uint8)
    out[np.repeat(first * BLOCK - offsets[:-1], sizes) + np.arange(len(data))] = data
    inside = np.zeros(int(blocks.sum()) * BLOCK // STRIDE, dtype=bool)  # windows that begin in a text
    windows = np.maximum(1, -(-sizes // STRIDE))
    inside[np.repeat(first * (BLOCK // STRIDE) - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())] = True
    return out, first, blocks, inside


def answers(model, laid):
    """Each filter's answer at each place of a padded buffer; windows are four groups of four bytes, so no window is copied."""
    groups = model["embed"][laid[: len(laid) // STRIDE * STRIDE]].reshape(-1, STRIDE * DIMENSION)
    weights = model["filters"].reshape(WIDTH // STRIDE, STRIDE * DIMENSION, FILTERS)
    n = len(groups) - WIDTH // STRIDE + 1
    out = groups[:n] @ weights[0]
    for i in range(1, WIDTH // STRIDE):
        out += groups[i : i + n] @ weights[i]
    return out


def chunk_places(first, blocks, sizes):
    """Text, first block, blocks and bytes of every chunk."""
    step = PER_CHUNK - 1
    chunks = np.maximum(1, -(-(blocks - 1) // step))
    text = np.repeat(np.arange(len(blocks)), chunks)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    begin = first[text] + nth * step
    length = np.minimum(PER_CHUNK, first[text] + blocks[text] - begin)
    size = np.clip(sizes[text] - nth * step * BLOCK, 0, length * BLOCK)
    return text, begin, length, size


def pooled(model, data, offsets):
    """(text, bytes, largest answers, their places) of every chunk; the buffer is worked on in parts of whole chunks."""
    laid, first, blocks, inside = laid_out(data, offsets)
    text, begin, length, size = chunk_places(first, blocks, np.diff(offsets))
    per = BLOCK // STRIDE
    best, place = [], []
    at = 0
    while at < len(begin):
        stop = max(at + 1, int(np.searchsorted(begin, begin[at] + PART // BLOCK)))
        lo, hi = int(begin[at]), int((begin[at:stop] + length[at:stop]).max())
        y = answers(model, laid[lo * BLOCK : hi * BLOCK + WIDTH])[: (hi - lo) * per]
        y[~inside[lo * per : hi * per]] = -np.inf
        y = y.reshape(hi - lo, per, FILTERS)
        where = y.argmax(axis=1)
        top = np.take_along_axis(y, where[:, None, :], axis=1)[:, 0]
        index = begin[at:stop, None] - lo + np.minimum(np.arange(PER_CHUNK)[None, :], length[at:stop, None] - 1)
        block = top[index].argmax(axis=1)
        chosen = np.take_along_axis(index, block, axis=1)
        best.append(top[chosen, np.arange(FILTERS)])
        place.append((chosen + lo) * BLOCK + STRIDE * where[chosen, np.arange(FILTERS)])
        at = stop
    return text, size, np.concatenate(best), np.concatenate(place), laid


def log_odds(model, size, best):
    """Of each chunk, and what the way back needs."""
    x = np.concatenate([np.maximum(best + model["bias"], 0), np.log1p(size)[:, None].astype(np.float32) / 6], axis=1).astype(np.float32)
    h = np.maximum(x @ model["hidden"] + model["hidden_bias"], 0)
    return h @ model["out"] + model["out_bias"][0], x, h


def probabilities(model, data, offsets):
    """Of label 1 for each text; a few texts are worked on at a time."""
    found = [_probabilities(model, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in parts(offsets, PART)]
    return np.concatenate(found) if found else np.zeros(0)


def _probabilities(model, data, offsets):
    n = len(offsets) - 1
    text, size, best, _, _ = pooled(model, data, offsets)
    z, _, _ = log_odds(model, size, best)
    weight = size + 1.0
    mean = np.bincount(text, weight * z, n) / np.bincount(text, weight, n)
    return 1 / (1 + np.exp(-np.clip(mean, -30, 30)))


def _slopes(model, data, offsets, labels, weights):
    """Gradient of the weighted log loss, through the places of the largest answers."""
    n = len(labels)
    text, size, best, place, laid = pooled(model, data, offsets)
    z, x, h = log_odds(model, size, best)
    share = size + 1.0
    share = share / np.bincount(text, share, n)[text]
    p = 1 / (1 + np.exp(-np.clip(np.bincount(text, share * z, n), -30, 30)))
    dz = ((p - labels) * weights / weights.sum())[text] * share
    dz = dz.astype(np.float32)
    dh = dz[:, None] * model["out"] * (h > 0)
    dx = (dh @ model["hidden"].T)[:, :FILTERS] * (x[:, :FILTERS] > 0)
    seen = laid[place[:, :, None] + np.arange(WIDTH)]
    vectors = model["embed"][seen]
    filters = np.einsum("ck,ckwd->wdk", dx, vectors, optimize=True)
    embed = np.zeros_like(model["embed"])
    np.add.at(embed, seen.reshape(-1), np.einsum("ck,wdk->ckwd", dx, model["filters"], optimize=True).reshape(-1, DIMENSION))
    return {
        "embed": embed,
        "filters": filters,
        "bias": dx.sum(axis=0),
        "hidden": x.T @ dh,
        "hidden_bias": dh.sum(axis=0),
        "out": h.T @ dz,
        "out_bias": dz.sum(keepdims=True),
    }


def fit(texts, labels, epochs=EPOCHS, seed=SEED):
    """The network trained on texts (bytes) and labels (0 or 1); classes weigh the same. Without both classes it stays as it began."""
    model = initial(seed)
    labels = np.asarray(labels, dtype=np.float64)
    if len(set(labels.tolist())) < 2:
        return model
    rng = np.random.Generator(np.random.PCG64(seed))
    # A short slice of every text beside it: few answers alone must not look like one thing said over and over.
    begins = [int(rng.integers(0, max(1, len(t) - 20))) for t in texts]
    texts = [*texts, *(t[b : b + int(rng.integers(15, 200))] for t, b in zip(texts, begins, strict=True))]
    labels = np.concatenate([labels, labels])
    weights = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for s in range(0, len(order), BATCH):
            take = order[s : s + BATCH]
            data = np.frombuffer(b"".join(texts[i] for i in take), dtype=np.uint8)
            offsets = np.append(0, np.cumsum([len(texts[i]) for i in take]))
            step += 1
            for k, g in _slopes(model, data, offsets, labels[take], weights[take]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
                model[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def bucket(column):
    """crc32 of an id as text, modulo 3: rows with 1 are held out."""
    return F.crc32(column.cast("string").cast("binary")) % 3


def train(docs, labels, id_col="doc_id", text_col="text", label_col="quality", sample=SAMPLE):
    """A network from a bounded sample of labelled rows that are not held out; pieces of their texts go to one task."""
    small = labels.filter(F.col(label_col).isin(0, 1) & (bucket(F.col(id_col)) != 1)).select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).dropDuplicates(["id"])
    order = F.xxhash64("id")
    chosen = None
    for y in (0, 1):
        part = small.filter(F.col("y") == y).orderBy(order, "id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = (F.length("t") / PIECES).cast("int")
    pieces = F.when(F.length("t") <= PIECES * CHUNK, F.col("t")).otherwise(
        F.array_join(F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substring("t", i * step + 1, F.lit(CHUNK))), "")
    )
    found = docs.select(F.col(id_col).alias("id"), text.alias("t")).join(F.broadcast(chosen), "id")
    sampled = found.select("id", "y", pieces.alias("p")).dropDuplicates(["id"]).select(F.col("id").cast("string").alias("id"), F.col("y").cast("int").alias("y"), "p")
    # The sample is bounded, so one task learns from it; only the weights come back.
    weights = sampled.coalesce(1).mapInArrow(_train_rows, "model binary").collect()
    return pickle.loads(weights[0]["model"]) if weights else initial()


def _train_rows(batches):
    import pyarrow as pa

    rows = sorted((r["y"], r["id"], r["p"].encode()) for batch in batches for r in batch.to_pylist())
    if rows:
        model = fit([p for *_, p in rows], [y for y, *_ in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def _score_rows(model, at):
    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            p = probabilities(model, *string_column(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "__score"])

    return rows


def score(docs, model, text_col="text", name="score"):
    """docs with the probability of label 1 of each whole text; null text counts as empty. Any columns, any rows; an empty table stays empty."""
    small_batches(docs.sparkSession)
    spread = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spread.schema)
    out = spread.mapInArrow(_score_rows(model, docs.columns.index(text_col)), f"{schema}, __score double")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)), F.col("__score").alias(name))


def classify(docs, labels, id_col="doc_id", text_col="text", label_col="quality", sample=SAMPLE):
    """(id_col, held_out, score, predicted) of each row of docs.

    Only rows whose bucket is not 1 are learned from, and of them no column but the text and the label. Rows that repeat an
    id are scored each; a null id is never learned from and not held out. Without labels of both classes scores say nothing.
    """
    model = train(docs, labels, id_col, text_col, label_col, sample)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    held = F.coalesce(bucket(F.col("id")) == 1, F.lit(False))
    got = score(narrow, model)
    return got.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

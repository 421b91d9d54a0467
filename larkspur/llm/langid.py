"""Language identification by a bidirectional gated recurrent network over bytes.

Forward and backward units read the UTF-8 bytes of a segment; a linear layer labels every position, and a
document's probabilities are the mean over all its positions. Training is backpropagation through time in
numpy on a bounded sample; prediction runs over whole texts on the executors, in segments whose state starts
anew, so that texts of any length are read in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import cut_lineage, texts_of

#: Labelled rows that training reads, by lowest hash: so many of each language at most, so many of all together
#: as long as that leaves each language its least number. No language is left out.
ROWS_PER_LANG, ROWS_OF_ALL, LEAST_ROWS = 400, 25_600, 20
#: How far above chance the stage's least score lies, between 1 / languages and 1.
ABOVE_CHANCE = 1 / 15
#: Code points of the window that each of those rows gives.
WINDOW_CHARS = 320
#: Units of each direction; bytes of a segment in training and in prediction; segments run side by side.
UNITS, TRAIN_BYTES, SEGMENT, SIDE = 8, 64, 256, 1024
STEPS, BATCH, RATE = 150, 256, 0.02
UNKNOWN = "und"
#: Languages whose shares are broadcast at most; more are joined by a shuffle.
BROADCAST_LANGS = 100_000


@dataclass
class Network:
    """Weights; the two directions lie along the first axis. Gates are reset, update, candidate."""

    langs: list[str]
    bytes_in: np.ndarray  # 2 x 256 x 3U
    state_in: np.ndarray  # 2 x U x 3U
    out: np.ndarray  # 2U x L
    bias: np.ndarray  # L

    def parameters(self) -> list[np.ndarray]:
        return [self.bytes_in, self.state_in, self.out, self.bias]


def _start(langs: list[str], seed: int) -> Network:
    rng, u = np.random.default_rng(seed), UNITS
    draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    return Network(langs, draw(2, 256, 3 * u, by=0.3), draw(2, u, 3 * u, by=u**-0.5), draw(2 * u, len(langs), by=0.3), np.zeros(len(langs), np.float32))


def _states(net: Network, codes: np.ndarray) -> tuple[np.ndarray, list]:
    """States (2 x T x B x U) of both directions with what their gradients need; codes is 2 x T x B.

    The second direction comes reversed. A sigmoid is half of one plus the tanh of half its argument, so one
    tanh serves both gates.
    """
    u, (_, t, b) = UNITS, codes.shape
    hs, h, tape = np.empty((2, t, b, u), np.float32), np.zeros((2, b, u), np.float32), []
    gates_h = np.ascontiguousarray(net.state_in[:, :, : 2 * u]) * np.float32(0.5)
    cand_h = np.ascontiguousarray(net.state_in[:, :, 2 * u :])
    x_in = net.bytes_in.copy()
    x_in[:, :, : 2 * u] *= 0.5
    for i in range(t):
        x = np.stack((x_in[0].take(codes[0, i], axis=0), x_in[1].take(codes[1, i], axis=0)))
        g = np.matmul(h, gates_h)
        g += x[:, :, : 2 * u]
        np.tanh(g, out=g)
        g += 1
        g *= 0.5
        r, z = g[:, :, :u], g[:, :, u:]
        n = np.matmul(r * h, cand_h)
        n += x[:, :, 2 * u :]
        np.tanh(n, out=n)
        tape.append((h, r.copy(), z.copy(), n))
        h = n + z * (h - n)
        hs[:, i] = h
    return hs, tape


def _log_soft(net: Network, hs: np.ndarray) -> np.ndarray:
    """Log-probabilities (T x B x L) of every position."""
    u = UNITS
    y = hs[0] @ net.out[:u] + hs[1, ::-1] @ net.out[u:] + net.bias
    y -= y.max(axis=2, keepdims=True)
    return y - np.log(np.exp(y).sum(axis=2, keepdims=True))


def _both(codes: np.ndarray) -> np.ndarray:
    return np.stack((codes, codes[::-1]))


def gradients(net: Network, codes: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over all positions and its gradients; codes is T x B, labels B."""
    u, (t, b) = UNITS, codes.shape
    two = _both(codes)
    hs, tape = _states(net, two)
    logp = _log_soft(net, hs)
    d = np.exp(logp)
    d[:, np.arange(b), labels] -= 1
    d /= t * b
    loss = -float(logp[:, np.arange(b), labels].mean())
    flat = d.reshape(-1, d.shape[2])
    d_out = np.concatenate((hs[0].reshape(-1, u).T @ flat, np.ascontiguousarray(hs[1, ::-1]).reshape(-1, u).T @ flat))
    dh_all = np.stack((d @ net.out[:u].T, (d @ net.out[u:].T)[::-1]))
    d_x, d_state, dh = np.zeros_like(net.bytes_in), np.zeros_like(net.state_in), np.zeros((2, b, u), np.float32)
    for i in range(t - 1, -1, -1):
        h, r, z, n = tape[i]
        dh = dh + dh_all[:, i]
        dz, dn = dh * (h - n) * z * (1 - z), dh * (1 - z) * (1 - n * n)
        drh = np.matmul(dn, net.state_in[:, :, 2 * u :].transpose(0, 2, 1))
        dg = np.concatenate((drh * h * r * (1 - r), dz), axis=2)
        d_state[:, :, : 2 * u] += np.matmul(h.transpose(0, 2, 1), dg)
        d_state[:, :, 2 * u :] += np.matmul((r * h).transpose(0, 2, 1), dn)
        dx = np.concatenate((dg, dn), axis=2)
        for k in range(2):
            np.add.at(d_x[k], two[k, i], dx[k])
        dh = dh * z + drh * r + np.matmul(dg, net.state_in[:, :, : 2 * u].transpose(0, 2, 1))
    return loss, [d_x, d_state, d_out, d.sum(axis=(0, 1))]


def train(texts: list[bytes], langs: list[str], steps: int = STEPS, seed: int = 7) -> Network:
    """Fit on (text, language) pairs by Adam; every language is drawn equally often."""
    names = sorted(set(langs))
    net, rng = _start(names, seed), np.random.default_rng(seed)
    of = {x: np.array([i for i, l in enumerate(langs) if l == x and texts[i]]) for x in names}
    names_with = [k for k, x in enumerate(names) if len(of[x])]
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    for step in range(1, steps + 1 if names_with else 1):
        labels = rng.choice(names_with, BATCH)
        codes = np.full((BATCH, TRAIN_BYTES), 32, np.intp)
        for row, label in enumerate(labels):
            raw = texts[rng.choice(of[names[label]])]
            at = rng.integers(0, max(1, len(raw) - TRAIN_BYTES + 1))
            part = np.frombuffer(raw[at : at + TRAIN_BYTES], np.uint8)
            codes[row, : len(part)] = part
        _, grads = gradients(net, np.ascontiguousarray(codes.T), labels)
        norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
        for p, g, m, v in zip(net.parameters(), grads, first, second, strict=True):
            g = g * np.float32(min(1.0, 1.0 / (norm + 1e-9)))
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.001) * (g * g - v)
            p -= np.float32(RATE) * (m / np.float32(1 - 0.9**step)) / (np.sqrt(v / np.float32(1 - 0.999**step)) + np.float32(1e-8))
    return net


def _position_sums(net: Network, forward: np.ndarray, backward: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum over a segment's positions of their probabilities, L x B; byte arrays are T x B, the second reversed.

    Segments come longest first. A shorter one stands at the start of the first array and at the end of the
    second, so its backward state is held at zero until its own last byte.

    Gates live in arrays of their own, so that every step runs over contiguous memory. A sigmoid is half of one
    plus the tanh of half its argument; the halves are folded into the weights.
    """
    u, (t, b) = UNITS, forward.shape
    half = np.float32(0.5)
    tables = [np.ascontiguousarray(net.bytes_in[:, :, k * u : (k + 1) * u]) * f for k, f in ((0, half), (1, half), (2, np.float32(1)))]
    mixes = [np.ascontiguousarray(net.state_in[:, :, k * u : (k + 1) * u]) * half for k in range(3)]
    hs = np.empty((t + 1, 2, b, u), np.float32)
    hs[0] = 0
    x = [np.empty((2, b, u), np.float32) for _ in range(3)]
    g, d = np.empty((2, b, u), np.float32), np.empty((2, b, u), np.float32)
    begun = (sizes[None, :] >= t - np.arange(t)[:, None]).sum(axis=1)
    for i in range(t):
        for table, own in zip(tables, x, strict=True):
            np.take(table[0], forward[i], axis=0, out=own[0], mode="clip")
            np.take(table[1], backward[i], axis=0, out=own[1], mode="clip")
        h, (r, z, n) = hs[i], x
        np.matmul(h, mixes[0], out=g)
        r += g
        np.tanh(r, out=r)
        r += 1
        r *= h
        np.matmul(h, mixes[1], out=g)
        z += g
        np.tanh(z, out=z)
        z += 1
        z *= half
        np.matmul(r, mixes[2], out=g)
        n += g
        np.tanh(n, out=n)
        np.subtract(h, n, out=d)
        d *= z
        np.add(d, n, out=hs[i + 1])
        if begun[i] < b:
            hs[i + 1, 1, begun[i] :] = 0
    total = np.zeros((len(net.langs), b))
    # The backward unit has read position i, from the right, after t - i steps.
    for at in range(0, t, 32):
        end = min(t, at + 32)
        f = hs[at + 1 : end + 1, 0].reshape(-1, u)
        k = hs[t - end + 1 : t - at + 1, 1][::-1].reshape(-1, u)
        y = net.out[:u].T @ f.T + net.out[u:].T @ k.T + net.bias[:, None]
        y -= y.max(axis=0)
        np.exp(y, out=y)
        y /= y.sum(axis=0)
        y = y.reshape(len(net.langs), end - at, b)
        if end > sizes[-1]:  # segments come longest first
            y *= np.arange(at, end)[:, None] < sizes[None, :]
        total += y.sum(axis=1)
    return total


def probabilities(net: Network, raws: list[bytes]) -> np.ndarray:
    """Mean position probabilities of each text (rows) by language; every byte of every text takes part."""
    total = np.zeros((len(raws), len(net.langs)))
    cuts = [(min(SEGMENT, len(raw) - at), k, at) for k, raw in enumerate(raws) for at in range(0, len(raw), SEGMENT)]
    cuts.sort(reverse=True)
    for i in range(0, len(cuts), SIDE):
        own = cuts[i : i + SIDE]
        t = own[0][0]
        forward, backward = np.full((len(own), t), 32, np.uint8), np.full((len(own), t), 32, np.uint8)
        for row, (n, k, at) in enumerate(own):
            part = np.frombuffer(raws[k], np.uint8, n, at)
            forward[row, :n] = part
            backward[row, t - n :] = part[::-1]
        sums = _position_sums(net, forward.T.astype(np.intp, order="C"), backward.T.astype(np.intp, order="C"), np.array([n for n, _, _ in own]))
        np.add.at(total, [k for _, k, _ in own], sums.T)
    return total / np.maximum(1, [[len(r)] for r in raws])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def may_learn(doc_id: Column) -> Column:
    """Whether a row's text and language may be learned from: crc32 of its id, as text, modulo 3 is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, part)``: a bounded number of rows of every language, by lowest hash.

    Counts by language set a hash bound that leaves a few times as many rows as needed; only those meet in the
    window that ranks them, so a frequent language sends no more rows there than a rare one.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    own = own.where(may_learn(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = cut_lineage(own.groupBy("lang").agg(F.count("*").alias("n")))
    langs = sizes.count()
    rows = min(ROWS_PER_LANG, max(LEAST_ROWS, ROWS_OF_ALL // max(1, langs)))
    shares = sizes.select("lang", F.least(F.lit(1.0), F.lit(2.0 * rows + 50) / F.col("n")).alias("share"))
    shares = F.broadcast(shares) if langs <= BROADCAST_LANGS else shares
    few = own.withColumn("order", F.xxhash64("id", "text")).join(shares, "lang").where((F.pmod("order", F.lit(1 << 40)) / float(1 << 40)) < F.col("share"))
    span = F.greatest(F.length("text") - WINDOW_CHARS, F.lit(0)) + 1
    few = few.select("lang", "order", F.substring("text", (F.pmod(F.col("order"), span) + 1).cast("int"), F.lit(WINDOW_CHARS)).alias("part"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "part"))
    return few.withColumn("rank", rank).where(F.col("rank") <= rows).select("lang", "part")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network:
    """A network fitted on the sample: some 8 MB at the driver, and 6 kB for each language beyond 1,280."""
    rows = sorted((r["lang"], bytes(r["part"])) for r in training_rows(docs, id_col, text_col, lang_col).select("lang", F.col("part").cast("binary").alias("part")).collect())
    return train([part for _, part in rows], [lang for lang, _ in rows])


def identify(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` in place of other columns but the id; map-side, no shuffle.

    A null text, one without a letter, and any text where nothing could be learned are ``und`` with score 0.
    Repeated rows and null ids keep their rows; at equal probabilities the first language by name wins; very long
    texts are read whole, segment by segment; bytes that are no UTF-8 count as U+FFFD; an empty table gives an empty
    result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = texts_of(part.column(1))
                known = [bool(x) and bool(net.langs) and has_letter(x) for x in texts]
                p = probabilities(net, [x.encode() if k else b"" for x, k in zip(texts, known, strict=True)])
                best = p.argmax(axis=1) if net.langs else np.zeros(len(texts), int)
                lang = [net.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                score = [float(min(1.0, p[i, b])) if k else 0.0 for i, (b, k) in enumerate(zip(best, known, strict=True))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, lang_pred string, score double")


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", net: Network | None = None) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row of ``docs``; fits on ``docs`` unless given a network."""
    net = net or fit(docs, id_col, text_col, lang_col)
    found = identify(docs, net, id_col, text_col)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", above_chance: float = ABOVE_CHANCE) -> DataFrame:
    """The rows of ``docs``, with their own columns, whose language is known well enough.

    The least score is that of chance, one in so many languages as were learned, and ``above_chance`` of the way
    from there to 1: 0.3 for four languages. It rejects little more than texts without letters: short clean texts
    may score low. Where one language was learned, every text with a letter stays; where none was, no text does.

    The predictor runs beside the rows, so no join is needed and repeated or null ids change nothing. Null texts
    go; very long ones are read whole; an empty table gives an empty one; columns may have any names.
    """
    net = fit(docs, id_col, text_col, lang_col)
    names = docs.columns
    chance = 1 / max(1, len(net.langs))
    least = chance + above_chance * (1 - chance) - 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = texts_of(part.column(names.index(text_col)))
                known = [bool(x) and bool(net.langs) and has_letter(x) for x in texts]
                p = probabilities(net, [x.encode() if k else b"" for x, k in zip(texts, known, strict=True)])
                good = [k and float(p[i].max()) >= least for i, k in enumerate(known)]
                yield part.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

Training: backpropagation through time on pieces of a bounded sample of labelled documents (at most
about ``SAMPLE`` of them, shared evenly among the languages, of which as many are learned at most, the
most frequent; chosen by a hash of the id and spread over each text from its beginning to its end). The
weights, some kilobytes, go to the executors with the function. Prediction: every byte of every text.
Texts are cut in pieces of ``PIECE`` bytes that run side by side as one batch, each begun ``LEAD`` bytes
early on either side, so that a position knows its neighbours; each position gets label probabilities,
and a document's are their mean over its letters' positions.

Defined cases: null text, and text without a letter, is ``und`` with score 0; so is everything if no
labelled row is left to learn from; with one language, that language. Repeated rows are predicted
alike; a null id is not held out but never trained on either; an empty table gives an empty result;
very long texts are labelled whole, in batches of pieces; further columns, whatever their names, are
ignored by the query and kept by ``accepted``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bucket_of, packed, slices, table, unpacked

FOLDS, HELD_OUT = 4, 2
#: Bound of the training sample, in documents; and what is cut from each: pieces of so many bytes.
SAMPLE, PIECES, PIECE_TRAINED = 3000, 4, 64
HIDDEN, EMBED, STEPS, BATCH, RATE, SEED = 8, 8, 260, 384, 0.02, 11
PIECE, LEAD = 192, 8
#: Texts whose pooled probability is lower, hardly above chance among four languages, are rejected by ``accepted``.
LEAST_SCORE = 0.3
UNKNOWN = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")
#: Bytes that can belong to a letter: A-Z, a-z, and all of longer UTF-8 sequences.
_LETTER_BYTES = np.array([(65 <= b <= 90) or (97 <= b <= 122) or b >= 128 for b in range(256)])


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def _sigmoid(x):
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def init(classes: int, hidden: int = HIDDEN, embed: int = EMBED, seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-1])).astype(np.float32)
    out = {"E": draw(256, embed)}
    for d in "fb":  # forward and backward; gates in the order update, reset, candidate
        out |= {f"W{d}": draw(3 * hidden, embed), f"U{d}": draw(3 * hidden, hidden), f"c{d}": np.zeros((3 * hidden, 1), np.float32)}
    return out | {"V": draw(classes, 2 * hidden), "o": np.zeros((classes, 1), np.float32)}


def _states(x: np.ndarray, p: dict, d: str) -> tuple[np.ndarray, list]:
    """Hidden states (time, hidden, batch) of one direction over bytes x (time, batch), and what the way back needs."""
    steps, batch = x.shape
    hidden = p[f"U{d}"].shape[1]
    inputs = (p["E"] @ p[f"W{d}"].T + p[f"c{d}"].T).T.copy()
    u_gates, u_new = p[f"U{d}"][: 2 * hidden], p[f"U{d}"][2 * hidden :]
    h = np.zeros((hidden, batch), np.float32)
    out, kept = np.empty((steps, hidden, batch), np.float32), []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        a = inputs[:, x[t]]
        gates = _sigmoid(a[: 2 * hidden] + u_gates @ h)
        z, r = gates[:hidden], gates[hidden:]
        n = np.tanh(a[2 * hidden :] + u_new @ (r * h))
        kept.append((t, h, z, r, n))
        h = n + z * (h - n)
        out[t] = h
    return out, kept


def _back(x, p, d, grad_out, kept, grads) -> None:
    hidden = p[f"U{d}"].shape[1]
    u_gates, u_new = p[f"U{d}"][: 2 * hidden], p[f"U{d}"][2 * hidden :]
    g_in = np.zeros((256, 3 * hidden), np.float32)
    carry = np.zeros_like(grad_out[0])
    for t, h, z, r, n in reversed(kept):
        g = grad_out[t] + carry
        gn = g * (1 - z) * (1 - n * n)
        gz = g * (h - n) * z * (1 - z)
        back = u_new.T @ gn
        gr = back * h * r * (1 - r)
        ga = np.concatenate([gz, gr, gn])
        grads[f"U{d}"][: 2 * hidden] += ga[: 2 * hidden] @ h.T
        grads[f"U{d}"][2 * hidden :] += gn @ (r * h).T
        np.add.at(g_in, x[t], ga.T)
        carry = g * z + back * r + u_gates.T @ ga[: 2 * hidden]
    grads[f"c{d}"] += g_in.sum(axis=0)[:, None]
    grads[f"W{d}"] += g_in.T @ p["E"]
    grads["E"] += g_in @ p[f"W{d}"]


def loss_and_grads(x: np.ndarray, y: np.ndarray, mask: np.ndarray, p: dict) -> tuple[float, dict]:
    """Mean cross entropy over the masked positions of pieces x (time, batch) with labels y (batch)."""
    fwd, kept_f = _states(x, p, "f")
    bwd, kept_b = _states(x, p, "b")
    both = np.concatenate([fwd, bwd], axis=1)
    logits = np.einsum("ch,thb->tcb", p["V"], both) + p["o"]
    logits -= logits.max(axis=1, keepdims=True)
    prob = np.exp(logits)
    prob /= prob.sum(axis=1, keepdims=True)
    total = max(float(mask.sum()), 1.0)
    loss = -float((np.log(prob[:, y, np.arange(len(y))] + 1e-9) * mask).sum()) / total
    prob[:, y, np.arange(len(y))] -= 1
    prob *= (mask / total)[:, None, :]
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    grads["V"] += np.einsum("tcb,thb->ch", prob, both)
    grads["o"] += prob.sum(axis=(0, 2))[:, None]
    back = np.einsum("ch,tcb->thb", p["V"], prob)
    hidden = fwd.shape[1]
    _back(x, p, "f", back[:, :hidden], kept_f, grads)
    _back(x, p, "b", back[:, hidden:], kept_b, grads)
    return loss, grads


def pieces_of(text: bytes, count: int = PIECES, size: int = PIECE_TRAINED) -> list[bytes]:
    """``count`` pieces spread evenly over the text; the whole text if it is no longer than one."""
    if len(text) <= size:
        return [text] if text else []
    return [text[int(i * (len(text) - size) / max(count - 1, 1)) :][:size] for i in range(count)]


def train(samples: list[tuple[bytes, int]], classes: int, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> dict:
    """Adam over random batches of (piece, class); each class is drawn equally often."""
    p, rng = init(classes, seed=seed), np.random.default_rng(seed)
    x = np.zeros((len(samples), PIECE_TRAINED), np.uint8)
    length = np.array([len(s) for s, _ in samples])
    y = np.array([c for _, c in samples])
    for i, (s, _) in enumerate(samples):
        x[i, : len(s)] = np.frombuffer(s, np.uint8)
    weight = 1 / np.bincount(y, minlength=classes)[y]
    weight /= weight.sum()
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        at = rng.choice(len(y), batch, p=weight)
        xs = x[at].T.copy()
        mask = ((np.arange(PIECE_TRAINED)[:, None] < length[at]) & _LETTER_BYTES[xs]).astype(np.float32)
        _, grads = loss_and_grads(xs, y[at], mask, p)
        now = rate * min(1.0, 3 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            np.clip(g, -1, 1, out=g)
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            p[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    return p


def _run(x: np.ndarray, table: tuple, backward: bool, logits: np.ndarray) -> None:
    """Adds a direction's share of the logits (time, classes, batch); buffers are reused at each step.

    With q = tanh(half of a gate's input), the gate is (1 + q) / 2: the halves are in the tables.
    """
    in_z, in_r, in_n, u_z, u_r, u_n, v = table
    batch, hidden = x.shape[1], len(u_n)
    h = np.zeros((batch, hidden), np.float32)
    z, r, n, a = (np.empty_like(h) for _ in range(4))
    share = np.empty((len(v), batch), np.float32)
    for t in range(len(x) - 1, -1, -1) if backward else range(len(x)):
        for gate, inputs, u in ((z, in_z, u_z), (r, in_r, u_r)):
            np.take(inputs, x[t], axis=0, out=gate, mode="clip")
            gate += np.matmul(h, u, out=a)
            np.tanh(gate, out=gate)
        r *= h
        r += h
        np.take(in_n, x[t], axis=0, out=n, mode="clip")
        n += np.matmul(r, u_n, out=a)
        np.tanh(n, out=n)
        np.subtract(h, n, out=a)
        a *= z
        h += n
        h += a
        h *= 0.5
        logits[t] += np.matmul(v, h.T, out=share)


def _tables(p: dict) -> dict:
    out = {}
    for d in "fb":
        hidden = p[f"U{d}"].shape[1]
        inputs = p["E"] @ p[f"W{d}"].T + p[f"c{d}"].T
        parts = [slice(k * hidden, (k + 1) * hidden) for k in range(3)]
        half = np.float32(0.5)
        own = slice(0, hidden) if d == "f" else slice(hidden, 2 * hidden)
        rows = [np.ascontiguousarray(inputs[:, k]) * s for k, s in zip(parts, (half, half, np.float32(1)), strict=True)]
        turns = [np.ascontiguousarray(p[f"U{d}"][k].T) * half for k in parts]
        out[d] = (*rows, *turns, p["V"][:, own].copy())
    return out


def document_probabilities(texts: list[bytes], p: dict, piece: int = PIECE, lead: int = LEAD, most: int = 2048) -> np.ndarray:
    """(document, class): the mean of the position probabilities over all letter bytes of each text (0 if none)."""
    tables, classes = _tables(p), len(p["o"])
    owner = np.repeat(np.arange(len(texts)), [-(-len(t) // piece) for t in texts])
    sums, count = np.zeros((len(texts), classes)), np.zeros(len(texts))
    wide = piece + 2 * lead
    rows = np.zeros((len(owner), wide), np.uint8)
    ends = np.zeros(len(owner), np.int32)
    at = 0
    for t in texts:
        view = np.frombuffer(t, np.uint8)
        for s in range(0, len(t), piece):
            low, high = max(0, s - lead), min(len(t), s + piece + lead)
            rows[at, lead - (s - low) : lead - (s - low) + high - low] = view[low:high]
            ends[at] = lead + min(piece, len(t) - s)
            at += 1
    steep = float(np.abs(p["V"]).sum(axis=1).max() + np.abs(p["o"]).max()) > 80
    for i in range(0, len(owner), most):
        x = rows[i : i + most].T.astype(np.intp)
        logits = np.zeros((wide, classes, x.shape[1]), np.float32)
        logits += p["o"]
        for d in "fb":
            _run(x, tables[d], d == "b", logits)
        logits = logits[lead : lead + piece]
        time = np.arange(lead, lead + piece)[:, None]
        mask = (time < ends[i : i + most]) & _LETTER_BYTES[x[lead : lead + piece]]
        if steep:
            logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        each = np.einsum("tcb,tb->cb", logits, (mask / logits.sum(axis=1)).astype(np.float32))
        for c in range(classes):
            sums[:, c] += np.bincount(owner[i : i + most], each[c], len(texts))
        count += np.bincount(owner[i : i + most], mask.sum(axis=0), len(texts))
    return sums / np.maximum(count, 1)[:, None]


def learn(documents: DataFrame, most: int = SAMPLE, **options) -> tuple[list[str], dict | None]:
    """(languages, weights) from text and lang of the rows outside the held-out fold."""
    rows = documents.select("doc_id", "text", "lang").filter("lang is not null and text is not null and doc_id is not null").filter(bucket_of(F.col("doc_id"), FOLDS) != HELD_OUT)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()}
    if not counts:
        return [], None
    langs, each = sorted(counts), max(1, most // len(counts))
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, each / n))).otherwise(share)
    picked = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    step = (F.length("text") - PIECE_TRAINED) / (PIECES - 1)
    cuts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substring("text", (F.greatest(F.floor(i * step), F.lit(0)) + 1).cast("int"), F.lit(PIECE_TRAINED))))
    got = picked.select(F.xxhash64("doc_id").alias("h"), "lang", cuts.alias("cuts")).orderBy("h", "lang", "cuts").limit(2 * most).collect()
    samples = [(c.encode()[:PIECE_TRAINED], langs.index(r["lang"])) for r in got for c in r["cuts"] if c]
    if not samples:
        return [], None
    return langs, train(samples, len(langs), **options)


def predict(documents: DataFrame, langs: list[str], weights: dict | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, *keep) for every row; only the text decides."""

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            label, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
            for low, high in slices(texts, 3_000_000):
                use = [i for i in range(low, high) if weights is not None and has_letter(texts[i])]
                if use:
                    prob = document_probabilities([texts[i].encode() for i in use], weights)
                    best = prob.argmax(axis=1)
                    label[use] = np.array(langs, dtype=object)[best]
                    score[use] = np.clip(prob[np.arange(len(use)), best], 0, 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(label.tolist(), pa.string()), pa.array(score), *[b.column(f"_{c}") for c in keep]], names=["doc_id", "lang_pred", "score", *keep])

    schema = StructType([documents.schema["doc_id"], *StructType.fromDDL("lang_pred string, score double"), *[documents.schema[c] for c in keep]])
    return documents.select("doc_id", "text", *[F.col(c).alias(f"_{c}") for c in keep]).mapInArrow(run, schema)


def accepted(documents: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows whose text has a language that the model is sure enough of, with their columns as they are."""
    langs, weights = learn(documents)
    if weights is None:
        return documents.limit(0)
    found = predict(packed(documents, "doc_id", "text"), langs, weights, keep=("row",))
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*unpacked(documents.columns))


def query(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    langs, weights = learn(documents)
    held = F.coalesce(bucket_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return predict(documents, langs, weights).select("doc_id", held.alias("held_out"), "lang_pred", "score")

"""Language identification: a bidirectional gated recurrent network over bytes.

Both directions are gated recurrent units, trained in numpy by backpropagation through
time; their activation is x / (1 + |x|), a fraction of the cost of a hyperbolic tangent, and
half of it plus one half for the gates.  The network reads a whole text, A-Z lower-cased, blanks and all, in windows of
WINDOW bytes that overlap by twice MARGIN: a byte is labelled in the window in which it has
MARGIN bytes or more on both sides, or the end of its text.  Every position gets a
distribution over the languages from both directions' states, and a document's
distribution is the mean over all its positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import textscan as ts
from plumbline.llm.session import ship

WINDOW, MARGIN = 512, 32
TRAINED = (64, 16)  # bytes of the windows that are fitted on; what is left of a text is cut by the second
UNKNOWN = "und"


def _bend(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), whose slope at the value y is (1 - |y|) squared."""
    return x / (1 + np.abs(x))


def _gate(x: np.ndarray) -> np.ndarray:
    """From 0 to 1; the slope at the value y is (1 - |2 y - 1|) squared / 2."""
    return 0.5 + 0.5 * _bend(x)


@dataclass
class Network:
    """Weights: for each direction an input table (256 bytes x 3 gates), a recurrent matrix, biases; one output layer."""

    languages: list[str]
    hidden: int
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, languages: list[str], hidden: int, seed: int) -> "Network":
        rng = np.random.default_rng(seed)
        w = {}
        for d in ("f", "b"):
            w[f"{d}x"] = rng.normal(0, 0.3, (256, 3 * hidden))
            w[f"{d}h"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
            w[f"{d}c"] = np.zeros(3 * hidden)
        w["o"] = rng.normal(0, 0.3, (2 * hidden, len(languages)))
        w["oc"] = np.zeros(len(languages))
        return cls(languages, hidden, {k: v.astype(np.float32) for k, v in w.items()})

    def _run(self, d: str, bytes_: np.ndarray) -> tuple[np.ndarray, list]:
        """States (time, rows, hidden) of one direction, and what its steps went through; bytes_ is (time, rows) in reading order."""
        n = self.hidden
        x, u, c = (self.weights[d + k] for k in "xhc")
        table = x + c
        h = np.zeros((bytes_.shape[1], n), dtype=np.float32)
        states, tape = np.empty((*bytes_.shape, n), dtype=np.float32), []
        for t in range(len(bytes_)):
            a, b = table[bytes_[t]], h @ u
            zr = _gate(a[:, : 2 * n] + b[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            new = _bend(a[:, 2 * n :] + r * b[:, 2 * n :])
            before, h = h, (1 - z) * new + z * h
            states[t] = h
            tape.append((before, z, r, new, b[:, 2 * n :]))
        return states, tape

    def _logits(self, d: str, bytes_: np.ndarray) -> np.ndarray:
        """What one direction adds to every position's logits (time, languages, rows); the steps of _run() without a tape."""
        n = self.hidden
        table, u = self.weights[d + "x"] + self.weights[d + "c"], self.weights[d + "h"]
        last = np.ascontiguousarray((self.weights["o"][:n] if d == "f" else self.weights["o"][n:]).T)
        h = np.zeros((bytes_.shape[1], n), dtype=np.float32)
        out = np.empty((len(bytes_), len(self.languages), bytes_.shape[1]), dtype=np.float32)
        for t in range(len(bytes_)):
            a, b = table[bytes_[t]], h @ u
            zr = a[:, : 2 * n] + b[:, : 2 * n]
            size = np.abs(zr)
            size += 1
            zr /= size
            zr *= 0.5
            zr += 0.5
            new = b[:, 2 * n :] * zr[:, n:]
            new += a[:, 2 * n :]
            size = np.abs(new)
            size += 1
            new /= size
            h -= new
            h *= zr[:, :n]
            h += new
            np.matmul(last, h.T, out=out[t])
        return out

    def positions(self, rows: np.ndarray, length: np.ndarray | None = None) -> np.ndarray:
        """(rows, time) bytes -> (time, languages, rows): the distribution at every position before each row's length."""
        longest = rows.shape[1]
        y = self._logits("f", np.ascontiguousarray(rows.T))
        if length is None or (length == longest).all():
            y += self._logits("b", np.ascontiguousarray(rows.T[::-1]))[::-1]
        else:  # a row read backwards begins at its own last byte
            turned = np.clip(length - 1 - np.arange(longest)[:, None], 0, None)
            back = self._logits("b", np.take_along_axis(rows.T, turned, 0))
            y += np.take_along_axis(back, turned[:, None, :], 0)
        y += self.weights["oc"][:, None].astype(np.float32)
        y -= y.max(axis=1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=1, keepdims=True)
        return y

    def gradients(self, rows: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Cross-entropy over all positions, and its gradients, by backpropagation through time."""
        w, n = self.weights, self.hidden
        seen = {"f": rows.T, "b": rows.T[::-1]}
        runs = {d: self._run(d, seen[d]) for d in seen}
        both = np.concatenate([runs["f"][0], runs["b"][0][::-1]], axis=2)
        y = both @ w["o"] + w["oc"]
        y = np.exp(y - y.max(axis=2, keepdims=True))
        y /= y.sum(axis=2, keepdims=True)
        scale = weight / (weight.sum() * rows.shape[1])
        at = np.arange(len(rows))
        loss = float(-(np.log(y[:, at, label] + 1e-9) * scale).sum())
        y[:, at, label] -= 1
        y *= scale[None, :, None].astype(np.float32)
        g = {"o": np.einsum("trh,trl->hl", both, y), "oc": y.sum((0, 1))}
        back = y @ w["o"].T
        given = {"f": back[:, :, :n], "b": back[::-1, :, n:]}
        for d, (_, tape) in runs.items():
            u = w[d + "h"]
            gu, das = np.zeros_like(u), np.empty((len(tape), len(rows), 3 * n), dtype=np.float32)
            dh = np.zeros((len(rows), n), dtype=np.float32)
            for t in range(len(tape) - 1, -1, -1):
                before, z, r, new, b = tape[t]
                dh = dh + given[d][t]
                dn = dh * (1 - z) * (1 - np.abs(new)) ** 2
                dz = dh * (before - new) * (1 - np.abs(2 * z - 1)) ** 2 / 2
                dr = dn * b * (1 - np.abs(2 * r - 1)) ** 2 / 2
                da = np.concatenate([dz, dr, dn], axis=1, out=das[t])
                db = np.concatenate([dz, dr, dn * r], axis=1)
                gu += before.T @ db
                dh = dh * z + db @ u.T
            at_byte = seen[d].reshape(-1)
            gx = np.stack([np.bincount(at_byte, weights=col, minlength=256) for col in das.reshape(-1, 3 * n).T], axis=1)
            g[d + "x"], g[d + "h"], g[d + "c"] = gx.astype(np.float32), gu, das.sum((0, 1))
        return loss, g


def fit(
    segments: list[tuple[np.ndarray, np.ndarray, np.ndarray]],
    languages: list[str],
    hidden: int = 8,
    epochs: int = 8,
    batch: int = 256,
    rate: float = 0.03,
    seed: int = 7,
    least_steps: int = 150,
) -> Network:
    """Adam over batches of segments of one length: (rows, label, weight) for each length.

    With few segments there are more epochs, until there are least_steps batches.
    """
    net = Network.fresh(languages, hidden, seed)
    m = {k: np.zeros_like(v) for k, v in net.weights.items()}
    v = {k: np.zeros_like(w) for k, w in net.weights.items()}
    rng, step = np.random.default_rng(seed), 0
    each = sum(-(-len(s[0]) // batch) for s in segments)
    epochs = max(epochs, -(-least_steps // max(each, 1)))
    total = epochs * each
    for _ in range(epochs):
        runs = [(i, k) for i, s in enumerate(segments) for k in range(0, len(s[0]), batch)]
        orders = [rng.permutation(len(s[0])) for s in segments]
        for j in rng.permutation(len(runs)):
            i, k = runs[j]
            pick = orders[i][k : k + batch]
            _, g = net.gradients(*(a[pick] for a in segments[i]))
            step += 1
            now = rate * (1 - 0.9 * step / (total + 1))
            for name, d in g.items():
                m[name] = 0.9 * m[name] + 0.1 * d
                v[name] = 0.99 * v[name] + 0.01 * d * d
                net.weights[name] -= (now * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def _windows(offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all documents: each window's document, start, length, and the part of it that is labelled (from, to)."""
    size = np.diff(offs)
    own = WINDOW - 2 * MARGIN
    count = np.where(size > WINDOW, 1 + -(-(size - WINDOW) // own), (size > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(size)), count)
    number = ts.ragged(np.zeros(len(size), dtype=np.int64), count)
    start = number * own
    length = np.minimum(WINDOW, size[doc] - start)
    low = np.where(number > 0, MARGIN, 0)
    high = np.where(number < count[doc] - 1, WINDOW - MARGIN, length)
    return doc, offs[doc] + start, length, low, high


def distributions(net: Network, part: ts.Slice) -> np.ndarray:
    """The mean distribution over all positions of every document; zeros of an empty one."""
    n = len(net.languages)
    doc, start, length, low, high = _windows(part.offs)
    out = np.zeros((part.n_docs, n))
    rows = max(64, min(1024, (1 << 22) // (WINDOW * n)))
    order = np.argsort(length, kind="stable")
    for k in range(0, len(order), rows):
        some = order[k : k + rows]
        time = np.arange(int(length[some].max()))
        bytes_ = part.buf[start[some][:, None] + np.minimum(time, length[some][:, None] - 1)]
        y = net.positions(bytes_, length[some])
        y *= ((time[:, None] >= low[some]) & (time[:, None] < high[some]))[:, None, :]
        np.add.at(out, doc[some], y.sum(axis=0, dtype=np.float64).T)
    return out / np.maximum(np.diff(part.offs), 1)[:, None]


def _has_letter(data: bytes) -> bool:
    return any(c.isalpha() for c in data.decode("utf-8", "replace"))


_ASCII_LETTER = np.zeros(256, dtype=np.int64)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = 1


def _predict(batches: Iterator[pa.RecordBatch], net: Network, names: list[str], text: int, at: list[int]) -> Iterator[pa.RecordBatch]:
    """names: of the columns put out; text: the column of the text; at: those of what is carried."""
    for batch in batches:
        found, scores = [], []
        for part in ts.slices(batch.column(text), lower=True):
            pooled = distributions(net, part)
            letters = ts.per_doc(_ASCII_LETTER[part.buf], part.offs) if len(part.buf) else np.zeros(part.n_docs)
            best = pooled.argmax(axis=1)
            for i in range(part.n_docs):
                if letters[i] or _has_letter(part.buf[part.offs[i] : part.offs[i + 1]].tobytes()):
                    found.append(net.languages[best[i]])
                    scores.append(round(min(1.0, max(0.0, float(pooled[i, best[i]]))), 4))
                else:
                    found.append(UNKNOWN)
                    scores.append(0.0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in at] + [pa.array(found, pa.string()), pa.array(scores, pa.float64())],
            names=names,
        )


def train(labelled: DataFrame, each: int = 250, most_bytes: int = 1 << 17, most_rows: int = 1000, **fitting) -> Network | None:
    """(doc_id, text, lang) -> a network, or None if no row has a language and a word.

    Fitted on a bounded sample: for each language the `each` doc_ids that hash lowest, most_rows
    of their rows (more only where doc_ids repeat), and most_bytes of their texts, cut between
    documents.  lang labels the rows and is nothing that a prediction reads.
    """
    ids = labelled.where("lang is not null").select("doc_id", "lang", F.xxhash64("doc_id").alias("_h"))
    # of each language first a share of the hashes that holds about 4 * each rows, so that what
    # meets in one task does not grow with the table
    sizes = ids.groupBy("lang").agg(F.count("*").alias("n")).collect()
    bound = F.lit(-1)
    for r in sizes:
        share = min(1.0, (4 * each + 64) / r["n"])
        bound = F.when(F.col("lang") == r["lang"], F.lit(min(2**63 - 1, -(2**63) + int(share * 2**64)))).otherwise(bound)
    low = ids.where(F.col("_h") <= bound).distinct()
    order = Window.partitionBy("lang").orderBy("_h", "doc_id")
    chosen = low.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each).select("doc_id").distinct()
    chosen = [r[0] for r in chosen.collect()]
    rows = labelled.where("lang is not null").where(F.col("doc_id").isin(chosen)).select("lang", "doc_id", "text").orderBy("lang", F.xxhash64("doc_id"), "doc_id", "text")
    rows = rows.limit(most_rows * max(len(sizes), 1)).toArrow()
    langs = rows.column("lang").to_pylist()
    languages = sorted(set(langs))
    if not languages:
        return None
    number, used = {x: i for i, x in enumerate(languages)}, dict.fromkeys(languages, 0)
    seen: dict[int, list] = {}
    for part in ts.slices(rows.column("text"), lower=True):
        worded = np.diff(part.words()[2]) > 0
        for i in range(part.n_docs):
            lang, data = langs[part.first + i], part.buf[part.offs[i] : part.offs[i + 1]]
            if not worded[i] or used[lang] and used[lang] + len(data) > most_bytes:
                continue
            used[lang] += len(data)
            for size in (*TRAINED, len(data)):
                n = len(data) // size if 0 < size <= len(data) and (size in TRAINED or len(data) < TRAINED[-1]) else 0
                if n:
                    seen.setdefault(size, []).append((data[: n * size].reshape(n, size), number[lang]))
                    data = data[n * size :]
    weight_of = np.array([1.0 / max(used[x], 1) for x in languages])
    segments = []
    for n in sorted(seen):
        label = np.concatenate([np.full(len(r), i) for r, i in seen[n]])
        segments.append((np.concatenate([r for r, _ in seen[n]]), label, n * weight_of[label]))
    if not segments:
        return None
    return fit(segments, languages, **fitting)


def identify(docs: DataFrame, net: Network | None, carried: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """(text, carried columns) -> carried, lang_pred, score; one row per row.

    score is the pooled probability of lang_pred, in ten-thousandths.  A null text, one without
    a letter, and every text if there is no network, is 'und' with score 0.  A carried column
    named like one of `names` is replaced.
    """
    ship(docs.sparkSession)
    carried = [c for c in carried if c not in names]
    if net is None:
        return docs.select(*carried, F.lit(UNKNOWN).alias(names[0]), F.lit(0.0).alias(names[1]))
    kinds = "".join(f"`{n}` {t}, " for n, t in docs.select(*carried).dtypes)
    if dict(docs.dtypes)["text"] == "string" and "text" in carried:  # a carried text is sent once
        rows, text, at = docs.select(*carried), carried.index("text"), list(range(len(carried)))
    else:
        rows, text, at = docs.select(F.col("text").cast("string").alias("_text"), *carried), 0, list(range(1, len(carried) + 1))
    return rows.mapInArrow(lambda b: _predict(b, net, [*carried, *names], text, at), f"{kinds}`{names[0]}` string, `{names[1]}` double")


def held_out(doc_id: Column) -> Column:
    """crc32 of the doc_id as text leaves 1 when divided by 3; a null doc_id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def confident(found: DataFrame, least: float = 0.4, names: tuple[str, str] = ("lang_pred", "score")) -> Column:
    """What a filter keeps: a language was found, and its pooled probability reaches `least`."""
    return (found[names[0]] != UNKNOWN) & (found[names[1]] >= least)

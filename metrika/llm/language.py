"""Language ID: a bidirectional gated recurrent network over bytes.

The two recurrences run over the running bytes of a text, white space included, and every
position gets probabilities of the languages from both states; a document's are their mean over all
its positions. A text is cut into chunks of CORE bytes that are run side by side; each
recurrence begins LEAD bytes outside of its chunk, so that it has a state when it gets there
(a text of up to CORE bytes is one chunk, from its first byte to its last). The network is
trained in numpy by backpropagation through time on windows of running bytes.

Bound of the training sample: `per_language` documents of each language (smallest hash of
their ids) and of each `per_document` windows of SAMPLE bytes, from anywhere in texts of any
length. Prediction reads every whole text. Defined cases: `und` with score 0 if the text is
null or has no letter, or nothing was learnt; a document with a null id or language isn't
learnt from (and is predicted like any other; held_out is null for a null id); repeated rows
each count; among equal probabilities the first language by name; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, lean, map_texts, table

HIDDEN = 8
CORE, LEAD = 448, 32
SAMPLE = 64
LANES = 1024


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def padded(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes as [piece, position], lengths); zeros fill up."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    width = int(lengths.max()) if len(pieces) else 0
    flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8)
    return flat.reshape(len(pieces), width), lengths


class Network:
    """Parameters by name: for each direction x (byte table), u (recurrent); v and c for the output."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden, n = languages, hidden, len(languages)
        self.p = {f"x{d}": rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32) for d in "fb"}
        self.p |= {f"u{d}": rng.normal(0, 0.3, (hidden, 3 * hidden)).astype(np.float32) for d in "fb"}
        self.p |= {"v": rng.normal(0, 0.3, (2 * hidden, n)).astype(np.float32), "c": np.zeros(n, np.float32)}

    def walk(self, data: np.ndarray, lengths: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """States [position, piece, hidden] of one direction; a padded position leaves the state alone."""
        h, size = self.hidden, len(data)
        x, u = self.p["x" + way], self.p["u" + way]
        states = np.zeros((data.shape[1], size, h), np.float32)
        state = np.zeros((size, h), np.float32)
        steps = range(data.shape[1]) if way == "f" else range(data.shape[1] - 1, -1, -1)
        for t in steps:
            a, b = x[data[:, t]], state @ u
            zr = _sigmoid(a[:, : 2 * h] + b[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(a[:, 2 * h :] + r * b[:, 2 * h :])
            live = (t < lengths)[:, None]
            following = np.where(live, (1 - z) * new + z * state, state)
            if keep is not None:
                keep.append((t, state, z, r, new, b[:, 2 * h :], live))
            states[t] = state = following
        return states

    def prepare(self) -> None:
        """Parameters of both directions side by side, lanes last; gates are scaled so that one tanh does for a sigmoid."""
        h = self.hidden
        scale = np.concatenate([np.full(2 * h, 0.5), np.ones(h)]).astype(np.float32)
        self.x2 = [np.ascontiguousarray((self.p["x" + d] * scale).T) for d in "fb"]
        self.u2 = np.stack([(self.p["u" + d] * scale).T for d in "fb"])
        self.v2 = np.stack([self.p["v"][:h].T, self.p["v"][h:].T])

    def both_ways(self, data: np.ndarray, back: np.ndarray) -> np.ndarray:
        """[direction, step, language, lane]: what the states add to the logits; data and back: [lane, step] bytes in reading order."""
        lanes, steps = data.shape
        h = self.hidden
        columns = np.ascontiguousarray(data.T).astype(np.intp), np.ascontiguousarray(back.T).astype(np.intp)
        out = np.empty((2, steps, self.p["v"].shape[1], lanes), np.float32)
        state, a, b = np.zeros((2, h, lanes), np.float32), np.empty((2, 3 * h, lanes), np.float32), np.empty((2, 3 * h, lanes), np.float32)
        gates, new, r, z = a[:, : 2 * h], b[:, 2 * h :], a[:, h : 2 * h], a[:, :h]
        for t in range(steps):
            for k in (0, 1):
                np.take(self.x2[k], columns[k][t], axis=1, out=a[k], mode="clip")
            np.matmul(self.u2, state, out=b)
            gates += b[:, : 2 * h]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            new *= r
            new += a[:, 2 * h :]
            np.tanh(new, out=new)
            state -= new
            state *= z
            state += new
            np.matmul(self.v2, state, out=out[:, t])
        return out

    def sums(self, chunks: list[tuple[bytes, int, int]]) -> np.ndarray:
        """For each (bytes, first, end) the sum of the probabilities of its positions first to end; chunks of like length run together."""
        out = np.zeros((len(chunks), len(self.languages)), np.float64)
        sizes = np.fromiter((len(c[0]) for c in chunks), np.int64, len(chunks))
        order = np.argsort(sizes, kind="stable")
        for i in range(0, len(chunks), LANES):
            at = order[i : i + LANES]
            data, lengths = padded([chunks[j][0] for j in at])
            steps = np.arange(data.shape[1])[None, :]
            turned = np.maximum(lengths[:, None] - 1 - steps, 0)  # the step at which a position is read backwards, and the reverse
            both = self.both_ways(data, np.take_along_axis(data, turned, axis=1))
            logits = both[0] + np.take_along_axis(both[1], turned.T[:, None, :], axis=0) + self.p["c"][:, None]
            logits -= logits.max(axis=1, keepdims=True)
            np.exp(logits, out=logits)
            logits /= logits.sum(axis=1, keepdims=True)
            first, end = (np.array([chunks[j][k] for j in at]) for k in (1, 2))
            logits *= ((steps >= first[:, None]) & (steps < end[:, None])).T[:, None, :]
            out[at] = logits.sum(axis=0, dtype=np.float64).T
        return out

    def gradients(self, data: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[dict, float]:
        """Backpropagation through time of the mean cross entropy over all positions."""
        h = self.hidden
        kept: dict = {"f": [], "b": []}
        both = np.concatenate([self.walk(data, lengths, d, kept[d]) for d in "fb"], axis=2)
        logits = both @ self.p["v"] + self.p["c"]
        prob = np.exp(logits - logits.max(axis=2, keepdims=True))
        prob /= prob.sum(axis=2, keepdims=True)
        live = (np.arange(data.shape[1])[:, None] < lengths[None, :]).astype(np.float32)
        total = max(1.0, float(live.sum()))
        pieces = np.arange(len(data))
        loss = float(-(np.log(prob[:, pieces, labels] + 1e-9) * live).sum() / total)
        d = prob.copy()
        d[:, pieces, labels] -= 1
        d *= live[:, :, None] / total
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["v"] = np.tensordot(both, d, ([0, 1], [0, 1]))
        g["c"] = d.sum(axis=(0, 1))
        into = d @ self.p["v"].T
        for k, way in enumerate("fb"):
            u, carry = self.p["u" + way], np.zeros((len(data), h), np.float32)
            for t, state, z, r, new, bn, on in reversed(kept[way]):
                whole = carry + into[t][:, k * h : (k + 1) * h]
                dh = np.where(on, whole, 0)
                dn = dh * (1 - z) * (1 - new * new)
                dz = dh * (state - new) * z * (1 - z)
                dr = dn * bn * r * (1 - r)
                da = np.concatenate([dz, dr, dn], axis=1)
                db = np.concatenate([dz, dr, dn * r], axis=1)
                np.add.at(g["x" + way], data[:, t], da)
                g["u" + way] += state.T @ db
                carry = np.where(on, dh * z + db @ u.T, whole)
        return g, loss

    def train(self, pieces: list[bytes], labels: np.ndarray, steps: int = 400, batch: int = 256, rate: float = 0.02, seed: int = 2) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for i in range(1, steps + 1):
            at = rng.choice(len(pieces), min(batch, len(pieces)), replace=False)
            data, lengths = padded([pieces[j] for j in at])
            g, _ = self.gradients(data, lengths, labels[at])
            step = rate * (1 - 0.9 * i / steps)
            for k, v in g.items():
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.99 * s[k] + 0.01 * v * v
                self.p[k] -= (step * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)


def chunks_of(raw: bytes) -> list[tuple[bytes, int, int]]:
    """(bytes, first, end): chunks with what leads to them on both sides; first to end are the chunk's own."""
    out = []
    for at in range(0, len(raw), CORE):
        begin, end = max(0, at - LEAD), min(len(raw), at + CORE)
        out.append((raw[begin : end + LEAD], at - begin, end - begin))
    return out


def windows_of(raw: bytes, n: int, seed: int) -> list[bytes]:
    """Up to n windows of SAMPLE bytes from anywhere in the text; of a short text the whole."""
    if len(raw) <= SAMPLE:
        return [raw] if raw else []
    starts = np.random.default_rng(seed).integers(0, len(raw) - SAMPLE + 1, min(n, -(-len(raw) // SAMPLE)))
    return [raw[i : i + SAMPLE] for i in starts.tolist()]


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


class Labeller:
    """Languages and probabilities of documents."""

    def __init__(self, net: Network):
        self.net = net
        net.prepare()

    def __call__(self, texts: list) -> list:
        langs, scores, held, size = [], [], [], 0
        for t in texts:
            held.append(t)
            size += len(t or "")
            if size >= 4 * LANES * CORE:  # so that lanes are full
                self.add(held, langs, scores)
                held, size = [], 0
        self.add(held, langs, scores)
        return [langs, scores]

    def add(self, texts: list, langs: list, scores: list) -> None:
        raw = [t.encode() if has_letter(t) and self.net.languages else b"" for t in texts]
        chunks, owner = [], []
        for i, r in enumerate(raw):
            own = chunks_of(r)
            chunks += own
            owner += [i] * len(own)
        total = np.zeros((len(raw), max(1, len(self.net.languages))))
        if chunks:
            np.add.at(total, owner, self.net.sums(chunks))
        for r, t in zip(raw, total):
            best = int(t.argmax())
            langs.append(self.net.languages[best] if r else "und")
            scores.append(float(min(1.0, t[best] / len(r))) if r else 0.0)


def sample(docs: DataFrame, text: str, lang: str, per_language: int, per_document: int) -> list:
    """Rows (language, windows) of the sampled documents."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}  # a row a language
    if not sizes:
        return []
    # about twice as many as are wanted pass by their hash, of which the smallest are taken
    place, span = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), 1 << 40
    limit = F.coalesce(*[F.when(F.col(lang) == F.lit(k), F.lit(min(span, span * (2 * per_language + 50) // n))) for k, n in sizes.items()])
    few = known.where(place < limit).select(F.col(lang).alias("__lang"), F.col("doc_id").alias("__id"), place.alias("__place"))
    by: dict = {}
    for name, i, at in few.distinct().collect():  # some 2 * per_language ids a language
        by.setdefault(name, []).append((at, i))
    ids = [(i,) for own in by.values() for _, i in sorted(own)[:per_language]]
    wanted = docs.sparkSession.createDataFrame(ids, f"__id {docs.schema['doc_id'].dataType.simpleString()}")

    def run(batches):
        for batch in batches:
            kept = [(k, i, windows_of(t.encode(), per_document, abs(hash(i)) if isinstance(i, int) else 0)) for k, t, i in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in kept], pa.string()), pa.array([str(i) for _, i, _ in kept], pa.string()), pa.array([w for _, _, w in kept], pa.list_(pa.binary()))], names=["lang", "id", "windows"])

    texts = known.join(F.broadcast(wanted), F.col("doc_id") == F.col("__id"))
    rows = texts.select(F.col(lang).cast("string"), F.col(text).cast("string"), "doc_id").mapInArrow(lean(run), "lang string, id string, windows array<binary>").collect()
    return sorted((r["lang"], r["id"], [bytes(w) for w in r["windows"]]) for r in rows)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 150, per_document: int = 40, steps: int = 400) -> Network:
    """A network fitted to a bounded sample of documents with a language."""
    rows = sample(docs, text, lang, per_language, per_document)
    languages = sorted({r[0] for r in rows})
    net = Network(languages)
    windows = [w for r in rows for w in r[2]]
    if windows:
        net.train(windows, np.repeat([languages.index(r[0]) for r in rows], [len(r[2]) for r in rows]), steps=steps)
    return net


def label(docs: DataFrame, net: Network, keep: list[str], text: str = "text") -> DataFrame:
    return map_texts(docs, keep, text, [("lang_pred", "string"), ("score", "double")], lambda: Labeller(net))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 4) == 2
    net = train(docs.where(~held))
    return label(docs, net, ["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", "score")

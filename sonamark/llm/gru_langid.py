"""Language ID by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

Each byte is looked up in an input table for the three gates; a forward and a backward layer of HIDDEN units run over STEPS bytes;
a softmax over both layers' states labels every position. A text is cut into pieces of STEPS bytes, all of them are read, and
the document's probabilities are the mean over its positions. A padding byte holds the update gate shut, so it changes no state.

Fitting uses a bounded sample: about PER_LABEL windows of STEPS characters for each label, fewer where all labels together would pass MOST windows, from
documents chosen by a hash of the id, at a place chosen by another hash. Labels are counted over all documents, and every label that has one is learned (the
column holds names of languages, so there are some hundreds at most). The weights are some thousands of numbers, so they are sent to all tasks.

Null texts, empty ones and those without a letter are `und` with score 0; so is everything if there is nothing to learn from.
Rows with a null label teach nothing. A null id takes the fold of the empty string. Repeated rows are predicted each. A very long text is read whole, LANES
pieces at a time. Empty tables give empty results. Other columns are not read; where all columns are kept, new ones get names that no column has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, crc_mod, fresh

HIDDEN, STEPS, LANES, PAD = 8, 64, 2048, 256
PER_LABEL, MOST, EPOCHS, BATCH, RATE = 800, 50_000, 14, 96, 0.01
#: Steps of fitting at least: a small sample is gone through more often.
STEPS_LEAST = 400
MODULUS, HELD_OUT = 5, 0
NONE = "und"


class BiGru:
    """Parameters by name: for f (forward) and b (backward), the input table x (3H, 257), recurrent u (3H, H), bias of the candidate's recurrent part; output w, v."""

    def __init__(self, labels: list[str], seed: int = 7, hidden: int = HIDDEN):
        rng, self.labels, self.h = np.random.default_rng(seed), labels, hidden
        self.p = {f"x{d}": rng.normal(0, 0.3, (3 * hidden, PAD + 1)) for d in "fb"} | {f"u{d}": rng.normal(0, hidden**-0.5, (3 * hidden, hidden)) for d in "fb"} | {f"c{d}": np.zeros((hidden, 1)) for d in "fb"}
        self.p |= {"w": rng.normal(0, 0.3, (len(labels), 2 * hidden)), "v": np.zeros((len(labels), 1))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.shut()

    def shut(self) -> None:
        for d in "fb":
            self.p[f"x{d}"][:, PAD] = 0
            self.p[f"x{d}"][: self.h, PAD] = 30

    def layer(self, d: str, rows: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (steps, H, lanes) for bytes (steps, lanes), in the order of rows."""
        h, x, u, c = self.h, self.p[f"x{d}"], self.p[f"u{d}"], self.p[f"c{d}"]
        lanes = rows.shape[1]
        out = np.empty((len(rows), h, lanes), np.float32)
        state, g, a = np.zeros((h, lanes), np.float32), np.empty((3 * h, lanes), np.float32), np.empty((3 * h, lanes), np.float32)
        for t, row in enumerate(rows):
            np.take(x, row, axis=1, out=a, mode="clip")
            np.matmul(u, state, out=g)
            gates = a[: 2 * h]
            gates += g[: 2 * h]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r, n, q = a[:h], a[h : 2 * h], a[2 * h :], g[2 * h :]
            q += c
            n += r * q
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((state, z.copy(), r.copy(), n.copy(), q.copy()))
            state = np.add(n, z * (state - n), out=out[t])
        return out

    def probabilities(self, rows: np.ndarray, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(labels, steps, lanes) probabilities of every position, and the states (2H, steps * lanes)."""
        f = self.layer("f", rows, None if keep is None else keep.setdefault("f", []))
        b = self.layer("b", rows[::-1], None if keep is None else keep.setdefault("b", []))[::-1]
        states = np.concatenate((f, b), axis=1).transpose(1, 0, 2).reshape(2 * self.h, -1)
        s = self.p["w"] @ states + self.p["v"]
        s -= s.max(axis=0)
        np.exp(s, out=s)
        s /= s.sum(axis=0)
        return s.reshape(len(self.labels), *rows.shape), states

    def gradients(self, rows: np.ndarray, target: np.ndarray) -> tuple[dict, float]:
        """Of the mean cross-entropy over all positions that aren't padding; target: a label's number for each lane."""
        keep: dict[str, list] = {}
        prob, states = self.probabilities(rows, keep)
        real = rows != PAD
        ds = prob.copy()
        ds[target, :, np.arange(len(target))] -= 1
        ds *= real / max(1, real.sum())
        loss = -float((np.log(prob[target, :, np.arange(len(target))].T + 1e-9) * real).sum() / max(1, real.sum()))
        flat = ds.reshape(len(self.labels), -1)
        g = {"w": flat @ states.T, "v": flat.sum(axis=1, keepdims=True)}
        back = (self.p["w"].T @ flat).reshape(2 * self.h, *rows.shape)
        for d, part, order in (("f", back[: self.h], rows), ("b", back[self.h :, ::-1], rows[::-1])):
            g |= self.through_time(d, part, order, keep[d])
        return g, loss

    def through_time(self, d: str, given: np.ndarray, rows: np.ndarray, keep: list) -> dict:
        h, u = self.h, self.p[f"u{d}"]
        gx, gu, gc, carried = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(u), np.zeros((h, 1), np.float32), 0
        for t in range(len(rows) - 1, -1, -1):
            was, z, r, n, q = keep[t]
            dh = given[:, t] + carried
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (was - n) * z * (1 - z)
            dr = dn * q * r * (1 - r)
            da, dg = np.concatenate((dz, dr, dn)), np.concatenate((dz, dr, dn * r))
            carried = dh * z + u.T @ dg
            gu += dg @ was.T
            gc += dg[2 * h :].sum(axis=1, keepdims=True)
            np.add.at(gx.T, rows[t], da.T)
        return {f"x{d}": gx, f"u{d}": gu, f"c{d}": gc}

    def fit(self, rows: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> list[float]:
        """Adam over shuffled batches; rows (steps, samples)."""
        rng, losses, step = np.random.default_rng(seed), [], 0
        epochs = max(epochs, -(-STEPS_LEAST // -(-len(target) // BATCH)))
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order, total = rng.permutation(len(target)), 0.0
            rate = RATE * (1 - 0.9 * epoch / max(1, epochs))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                g, loss = self.gradients(rows[:, own], target[own])
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                total, step = total + loss * len(own), step + 1
                for k, x in g.items():
                    x = x * min(1.0, 1.0 / (norm + 1e-9))
                    m1[k] = 0.9 * m1[k] + 0.1 * x
                    m2[k] = 0.999 * m2[k] + 0.001 * x * x
                    self.p[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                self.shut()
            losses.append(total / max(1, len(order)))
        return losses

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """(texts, labels): mean probabilities over all positions of each (non-empty) text."""
        pieces = [-(-len(t) // STEPS) for t in texts]
        lanes = np.full((sum(pieces), STEPS), PAD, np.int16)
        at = 0
        for t, k in zip(texts, pieces):
            lanes[at : at + k].reshape(-1)[: len(t)] = np.frombuffer(t, np.uint8)
            at += k
        sums = np.empty((len(lanes), len(self.labels)))
        for at in range(0, len(lanes), LANES):
            rows = np.ascontiguousarray(lanes[at : at + LANES].T).astype(np.intp)
            prob, _ = self.probabilities(rows)
            sums[at : at + LANES] = (prob * (rows != PAD)).sum(axis=1).T
        starts = np.cumsum([0, *pieces[:-1]])
        return np.add.reduceat(sums, starts, axis=0) / np.array([len(t) for t in texts])[:, None]


def windows(docs: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int, modulus: int, held_out: int) -> list:
    """About per_label rows (label, window) for each label of training documents, MOST * 1.5 in all at most."""
    train = docs.where(F.col(label_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & (crc_mod(F.col(id_col), modulus) != held_out))
    counts = train.groupBy(F.col(label_col).cast("string").alias("label")).count().orderBy("label").collect()
    if not counts:
        return []
    per_label = min(per_label, -(-MOST // len(counts)))
    share = F.create_map(*(x for r in counts for x in (F.lit(r["label"]), F.lit(min(1.0, 1.2 * per_label / r["count"])))))
    chance = F.pmod(F.xxhash64(F.lit(1), F.col(id_col).cast("string")), F.lit(1_000_000)) / 1_000_000
    label = F.col(label_col).cast("string")
    place = F.pmod(F.xxhash64(F.lit(2), F.col(id_col).cast("string")), F.greatest(F.lit(1), F.length(text_col) - STEPS + 1)).cast("int") + 1
    drawn = train.where(chance < share[label]).select(label.alias("label"), F.substring(F.col(text_col), place, F.lit(STEPS)).alias("window"), chance.alias("chance"))
    return drawn.orderBy("label", "chance", "window").limit(int(1.5 * per_label * len(counts))).collect()


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = PER_LABEL, modulus: int = MODULUS, held_out: int = HELD_OUT) -> BiGru | None:
    rows = windows(docs, id_col, text_col, label_col, per_label, modulus, held_out)
    if not rows:
        return None
    labels = sorted({r["label"] for r in rows})
    x = np.full((STEPS, len(rows)), PAD, np.intp)
    for k, r in enumerate(rows):
        raw = r["window"].encode("utf-8", "surrogatepass")[:STEPS]
        x[: len(raw), k] = np.frombuffer(raw, np.uint8)
    model = BiGru(labels)
    model.fit(x, np.array([labels.index(r["label"]) for r in rows]))
    return model


def predict(docs: DataFrame, model: BiGru | None, text_col: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two more columns, label and score; its other columns pass through unread."""
    arrow_rows(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        net = sent.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            fit = [k for k, t in enumerate(texts) if net is not None and t and any(map(str.isalpha, t))]
            labels, scores = [NONE] * len(texts), [0.0] * len(texts)
            if fit:
                mean = net.documents([texts[k].encode("utf-8", "surrogatepass") for k in fit])
                for k, best, top in zip(fit, mean.argmax(axis=1), mean.max(axis=1)):
                    labels[k], scores[k] = net.labels[best], min(1.0, float(top))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, label, score])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())]))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", modulus: int = MODULUS, held_out: int = HELD_OUT) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score."""
    model = learn(docs, id_col, text_col, label_col, modulus=modulus, held_out=held_out)
    rows = docs.select(F.col(id_col).alias("doc_id"), (crc_mod(F.col(id_col), modulus) == held_out).alias("held_out"), F.col(text_col).alias("text"))
    return predict(rows, model).drop("text")


#: A document is of a language learned if its mean probability is this much of the way from that of a guess among the labels to certainty.
MARGIN = 0.15


def least_score(labels: int, margin: float = MARGIN) -> float:
    return 1 / labels + margin * (1 - 1 / labels)


def keep_identified(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """docs whose language is recognised, with the columns unchanged; `und` goes, and what is hardly better than a guess. With nothing to learn from, all go."""
    model = learn(docs)
    pred = fresh(docs, "lang_pred")
    score = fresh(docs, "lang_score")
    out = predict(docs, model, label=pred, score=score)
    least = least_score(len(model.labels), margin) if model else 1.0
    return out.where((F.col(f"`{pred}`") != NONE) & (F.col(f"`{score}`") >= least)).select(*(F.col(f"`{c}`") for c in docs.columns))

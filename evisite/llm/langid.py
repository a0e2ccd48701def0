"""Operator 10: language identification by a bidirectional gated recurrent network over bytes.

Every byte position is labelled from a forward and a backward state; a document's class probabilities are the mean over
its positions. The network is trained here, in numpy, by backpropagation through time on windows of labelled texts.
Whole texts are processed, as windows of 128 bytes; both states start anew 16 bytes before a window on their side of it,
so that no letters at a border go unseen. Windows of many documents step together. The training sample is bounded: ``per_language`` windows of each language, chosen by a hash of text and id.

Cases: a null text, or one without a letter, is ``und`` with score 0. Without labelled rows everything is ``und``.
A row without an id is never learned from and counts as held out. Ties of probability go to the first language in
order. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evisite.llm.common import fresh, low_hash, tidy

STEPS, LEAD = 128, 16  # bytes of a window that count, and bytes on both sides that only lead in
ROWS = 2048  # windows that step together


class BiGru:
    """Byte table (input gates), recurrent weights and output weights of both directions. Gate order: z, r, n."""

    def __init__(self, classes: list[str], hidden: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes, self.h = classes, hidden
        def put(*shape, scale):
            return rng.normal(0, scale, shape).astype(np.float32)

        self.p = {}
        for d in "fb":
            self.p["x" + d] = put(256, 3 * hidden, scale=0.3)
            self.p["u" + d] = put(hidden, 3 * hidden, scale=hidden**-0.5)
            self.p["w" + d] = put(hidden, len(classes), scale=hidden**-0.5)
        self.p["c"] = np.zeros(len(classes), np.float32)

    def _states(self, d: str, x: np.ndarray, mask: np.ndarray):
        """Yields (t, state, parts) along a direction, for training; ``x``: rows by steps."""
        n, h = len(x), self.h
        table, u = self.p["x" + d], self.p["u" + d]
        state = np.zeros((n, h), np.float32)
        for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
            gx, gh = table[x[:, t]], state @ u
            zr = np.tanh((gx[:, : 2 * h] + gh[:, : 2 * h]) * np.float32(0.5))
            zr *= np.float32(0.5)
            zr += np.float32(0.5)
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(gx[:, 2 * h :] + r * gh[:, 2 * h :])
            before, state = state, new + z * (state - new)
            state = state * mask[:, t, None]
            yield t, state, (before, z, r, new, gh[:, 2 * h :])

    def _sweep(self, d: str, x: np.ndarray, mask: np.ndarray | None):
        """Yields (t, states) along a direction for many windows at once; ``x``: steps by rows, states: hidden by rows."""
        h, n = self.h, x.shape[1]
        half = np.float32(0.5)
        table, u = self.p["x" + d].T.copy(), self.p["u" + d].T.copy()
        table[: 2 * h] *= half  # sigmoid(a) = 0.5 + 0.5 tanh(a / 2)
        u[: 2 * h] *= half
        state, gx, gh = np.zeros((h, n), np.float32), np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            np.take(table, x[t], axis=1, out=gx, mode="clip")
            np.dot(u, state, out=gh)
            zr = gx[: 2 * h]
            zr += gh[: 2 * h]
            np.tanh(zr, out=zr)
            zr *= half
            zr += half
            new, un = gx[2 * h :], gh[2 * h :]
            un *= zr[h:]
            new += un
            np.tanh(new, out=new)
            state -= new
            state *= zr[:h]
            state += new
            if mask is not None:
                state *= mask[t]
            yield t, state

    def position_sums(self, x: np.ndarray, mask: np.ndarray | None = None, lead: int = 0) -> np.ndarray:
        """Sum over positions, without ``lead`` at both ends, of the class probabilities of each window."""
        x = np.ascontiguousarray(x.T).astype(np.intp)
        mask = None if mask is None else np.ascontiguousarray(mask.T)
        wf, wb, c = self.p["wf"].T.copy(), self.p["wb"].T.copy(), self.p["c"][:, None]
        low, high = lead, len(x) - lead
        logits = np.empty((len(x), len(self.classes), x.shape[1]), np.float32)
        for t, state in self._sweep("f", x, mask):
            if low <= t < high:
                np.dot(wf, state, out=logits[t])
        logits[low:high] += c
        total = np.zeros((len(self.classes), x.shape[1]), np.float32)
        for t, state in self._sweep("b", x, mask):
            if not low <= t < high:
                continue
            e = logits[t]
            e += wb @ state
            np.clip(e, -30, 30, out=e)
            np.exp(e, out=e)
            e /= e.sum(axis=0)
            total += e if mask is None else e * mask[t]
        return total.T

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients of all parameters, by backpropagation through time in both directions."""
        n, steps = x.shape
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        run, logits = {}, np.zeros((steps, n, len(self.classes)), np.float32) + self.p["c"]
        for d in "fb":
            run[d] = list(self._states(d, x, mask))
            for t, state, _ in run[d]:
                logits[t] += state @ self.p["w" + d]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        prob = e / e.sum(axis=2, keepdims=True)
        weight = (mask.T / mask.sum())[:, :, None].astype(np.float32)
        target = np.zeros_like(prob)
        target[:, np.arange(n), y] = 1
        loss = float(-(np.log(prob[:, np.arange(n), y] + 1e-9) * weight[:, :, 0]).sum())
        wrong = (prob - target) * weight
        grads["c"] = wrong.sum(axis=(0, 1))
        h = self.h
        for d in "fb":
            u, w = self.p["u" + d], self.p["w" + d]
            back = np.zeros((n, h), np.float32)
            for t, state, (before, z, r, new, un) in reversed(run[d]):
                grads["w" + d] += state.T @ wrong[t]
                back = (back + wrong[t] @ w.T) * mask[:, t, None]
                dn = back * (1 - z) * (1 - new * new)
                dz = back * (before - new) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                gate = np.concatenate([dz, dr, dn], axis=1)
                np.add.at(grads["x" + d], x[:, t], gate)
                gate[:, 2 * h :] *= r
                grads["u" + d] += before.T @ gate
                back = back * z + gate @ u.T
        return loss, grads

    def train(self, texts: list[bytes], labels: list[int], steps: int = 260, batch: int = 96, rate: float = 0.02, seed: int = 11) -> list[float]:
        """Adam over random windows, languages drawn evenly."""
        rng, losses = np.random.default_rng(seed), []
        of = [np.flatnonzero(np.array(labels) == c) for c in range(len(self.classes))]
        one = {k: np.zeros_like(v) for k, v in self.p.items()}
        two = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            y = rng.integers(0, len(of), batch)
            picked = [texts[rng.choice(of[c])] for c in y]
            x, mask = windows(picked, 64, [int(rng.integers(0, max(1, len(t) - 63))) for t in picked])
            loss, grads = self.gradients(x, y, mask)
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            now = rate * min(1.0, 3 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.99 * two[k] + 0.01 * g * g
                self.p[k] -= now * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-8)
        return losses

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Class probabilities of whole documents (rows; zeros where a text is empty)."""
        size = np.array([len(t) for t in texts], np.int64)
        n_windows = -(-size // STEPS)
        ends = np.cumsum(n_windows)
        total = int(ends[-1]) if len(ends) else 0
        sums = np.zeros((total, len(self.classes)), np.float32)
        pad = b"\0" * LEAD
        data = np.frombuffer(b"".join([pad + t.ljust(int(n) * STEPS, b"\0") + pad for t, n in zip(texts, n_windows) if n]), np.uint8)
        owner = np.repeat(np.arange(len(texts)), n_windows)
        nth = np.arange(total) - np.repeat(ends - n_windows, n_windows)
        first = nth * STEPS + np.repeat(np.cumsum(np.where(n_windows > 0, n_windows * STEPS + 2 * LEAD, 0)) - (n_windows * STEPS + 2 * LEAD), n_windows)
        wide = STEPS + 2 * LEAD
        have = np.minimum(size[owner] - nth * STEPS + LEAD, wide)  # bytes up to the last real one
        whole, part = np.flatnonzero((nth > 0) & (have == wide)), np.flatnonzero((nth == 0) | (have < wide))
        place = np.arange(wide)
        for at in range(0, len(whole), ROWS):
            of = whole[at : at + ROWS]
            sums[of] = self.position_sums(data[first[of][:, None] + place], lead=LEAD)
        part = part[np.argsort(have[part], kind="stable")]
        for at in range(0, len(part), ROWS):
            of = part[at : at + ROWS]
            mask = (place[None, :] < have[of][:, None]) & ((place[None, :] >= LEAD) | (nth[of] > 0)[:, None])
            longest = int(min(have[of].max(), STEPS + LEAD) + LEAD)  # what lies beyond has no real byte
            sums[of] = self.position_sums(data[first[of][:, None] + place[:longest]], mask[:, :longest].astype(np.float32), lead=LEAD)
        out = np.zeros((len(texts), len(self.classes)), np.float64)
        np.add.at(out, owner, sums)
        return out / np.maximum(size, 1)[:, None]


def windows(texts: list[bytes], steps: int, starts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Byte windows (rows by steps) and their masks."""
    x, mask = np.zeros((len(texts), steps), np.uint8), np.zeros((len(texts), steps), np.float32)
    for k, (t, s) in enumerate(zip(texts, starts)):
        b = np.frombuffer(t[s : s + steps], np.uint8)
        x[k, : len(b)], mask[k, : len(b)] = b, 1
    return x, mask


def held_out(id_col, folds: int = 5) -> F.Column:
    """Whether a row is kept from learning: crc32 of its id as text is a multiple of ``folds``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


def fit(docs: DataFrame, per_language: int = 400, window_chars: int = 600, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> BiGru | None:
    """Trains on at most ``per_language`` windows of ``window_chars`` characters for each language; None without labels."""
    text = F.col(text_col)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key", "piece"))
    key = F.xxhash64(F.lit(5), F.col(id_col))
    start = F.pmod(F.xxhash64(F.lit(6), F.col(id_col)), F.greatest(F.lit(1), F.length(text) - window_chars)).cast("int") + 1
    labelled = docs.filter(F.col(lang_col).isNotNull() & ~held_out(id_col)).withColumn(known := fresh(docs, "known"), F.col(lang_col).cast("string"))
    sizes = labelled.groupBy(F.col(known).alias("lang")).agg(F.count(F.lit(1)).alias("total"))
    worded = labelled.filter(text.isNotNull() & text.rlike(r"\p{L}")).select(F.col(known).alias("lang"), key.alias("key"), text.substr(start, F.lit(window_chars)).alias("piece"))

    def first(rows: DataFrame) -> list:
        return rows.withColumn("rank", rank).filter(F.col("rank") <= per_language).select("lang", "rank", "piece").collect()

    total = {r.lang: r.total for r in sizes.collect()}  # the classes of the model
    if not total:
        return None
    of = F.try_element_at(F.create_map(*[F.lit(x) for pair in total.items() for x in pair]), F.col("lang"))
    rows = first(worded.filter(low_hash(F.col("key"), per_language, of)))
    if any(sum(r.lang == lang for r in rows) < min(per_language, n) for lang, n in total.items()):
        rows = first(worded)  # many rows of a language have no letter
    rows = sorted(rows, key=lambda r: (r.lang, r.rank))
    if not rows:
        return None
    model = BiGru(sorted({r.lang for r in rows}))
    if len(model.classes) > 1:
        model.train([r.piece.encode() for r in rows], [model.classes.index(r.lang) for r in rows])
    return model


def classify(docs: DataFrame, model: BiGru | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score``."""
    names = docs.columns
    at = [c.lower() for c in names].index(text_col.lower())
    schema = docs.drop("lang_pred", "score")
    kept = [k for k, c in enumerate(names) if c.lower() not in ("lang_pred", "score")]

    def labelled(batches):
        for batch in batches:
            texts = batch.column(at)
            has = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            pred, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            rows = np.flatnonzero(has) if model is not None else []
            step, held = [], 0
            for n, k in enumerate(rows):
                step.append((k, texts[int(k)].as_py().encode()))
                held += len(step[-1][1])
                if held > 4 << 20 or n == len(rows) - 1:
                    p = model.documents([t for _, t in step])
                    best = p.argmax(axis=1)
                    of = [k for k, _ in step]
                    pred[of] = [model.classes[c] for c in best]
                    score[of] = np.clip(p[np.arange(len(of)), best], 0, 1)
                    step, held = [], 0
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], pa.array(pred, pa.string()), pa.array(score)], names=[*[names[k] for k in kept], "lang_pred", "score"])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.schema.fields)
    return docs.mapInArrow(tidy(labelled), f"{fields}, lang_pred string, score double")

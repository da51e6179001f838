"""Toxicity of whole texts: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Method
    Words (runs of ASCII letters and digits and of all non-ASCII characters) enter as word inputs (a hashed embedding and a
    smoothed log-odds) and character inputs (the same for the character n-grams of the word: all 4-grams and the beginnings
    of 3 to 6 bytes, pooled over the word). A recurrent layer reads every window of ``WINDOW`` words in both directions; the
    windows overlap and cover the whole text. Attention pools a window's states into one logit. The score of a text is a
    logistic function of its largest window logit and its number of windows, fitted on the training texts.

    Training takes a bounded sample of the labelled rows (``per_class`` of each class, the smallest hashes of the id, equal
    texts once). Log-odds come from this sample by cross-fitting: the sample is dealt to folds, and a text is learnt from with
    the log-odds of the other folds, so they look in training as they will on new texts. In a toxic text the window with the
    most evidence is the positive one, in a clean text the hardest and some other windows are negative. Gradients are
    computed by back-propagation through time. One fold takes no part in the steps; the parameters that do best on it are kept.
    New texts are scored with the log-odds of all folds.

Defined results
    Null and empty texts, and texts without words, score 0. Equal texts score equally. Rows with a null label or a null id
    are not learnt from; if one class is missing, every text scores 0. Repeated rows give repeated results; an empty table
    gives an empty result. Texts of any length are scored whole, ``LEXICON_BYTES`` or one text at a time. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from meshlake.llm.common import Scratch, bound_batches, release, same_columns
from meshlake.llm.wordhash import _INV, _LOWER_BYTE, _POW, PUNCTUATION, U64, chunks, mix, text_buffers, words

WINDOW, STRIDE = 32, 24
HIDDEN, EMBED = 16, 4
#: Bytes of text whose distinct words are embedded together, when scoring and in one step of training.
LEXICON_BYTES, STEP_BYTES = 1 << 19, 1 << 17
WORD_SLOTS = GRAM_SLOTS = 1 << 18
PRIOR = 5.0
STATS = 3
INPUT = STATS + 2 * EMBED


def _gram_slots(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the character n-grams of words at byte ranges, word after word, and where each word's slots begin."""
    n = len(raw)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum(_LOWER_BYTE[raw] * _POW.upto(n), out=total[1:])
    inv = _INV.upto(n)
    length = end - start
    inner = np.maximum(0, length - 3)
    count = inner + 4
    first = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(first[-1], dtype=U64)
    # beginnings of 3, 4, 5 and 6 bytes (the whole word if it is shorter), told apart from inner n-grams
    for k, size in enumerate((3, 4, 5, 6)):
        stop = np.minimum(end, start + size)
        out[first[:-1] + k] = mix((total[stop] - total[start]) * inv[start] + U64(0x51ED270B + k))
    word = np.repeat(np.arange(len(start)), inner)
    at = np.arange(len(word)) - np.repeat(np.cumsum(inner) - inner, inner)
    pos = start[word] + at
    out[first[word] + 4 + at] = mix((total[pos + 4] - total[pos]) * inv[pos])
    return (out & U64(GRAM_SLOTS - 1)).astype(np.int64), first


class Lexicon:
    """The distinct words of one chunk of text: slots of the word and of its character n-grams."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        h, start, end, self.first = words(raw, off, gaps=PUNCTUATION)
        unique, at, self.word = np.unique(h, return_index=True, return_inverse=True)
        self.word_slot = (unique & U64(WORD_SLOTS - 1)).astype(np.int64)
        self.gram, self.gram_first = _gram_slots(raw, start[at], end[at])
        self.rows = len(off) - 1

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """``(row, words)``: per window its text and its word numbers; a short text's last places hold the pad word."""
        n = np.diff(self.first)
        count = np.where(n == 0, 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)))
        row = np.repeat(np.arange(self.rows), count)
        k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        begin = np.minimum(k * STRIDE, np.maximum(0, n[row] - WINDOW))
        at = begin[:, None] + np.arange(WINDOW)
        inside = at < n[row][:, None]
        at = np.minimum(self.first[row][:, None] + at, max(0, len(self.word) - 1))
        return row, np.where(inside, self.word[at], len(self.word_slot))


class Network:
    """Parameters, forward pass and gradients."""

    def __init__(self, seed: int = 11):
        rng = np.random.RandomState(seed)
        f = np.float32
        self.word_stat, self.gram_stat = np.zeros(WORD_SLOTS, f), np.zeros(GRAM_SLOTS, f)
        self.word_embed = (rng.randn(WORD_SLOTS, EMBED) * 0.1).astype(f)
        self.gram_embed = (rng.randn(GRAM_SLOTS, EMBED) * 0.1).astype(f)
        self.p = {}
        for d in "fb":
            self.p[f"wx{d}"] = (rng.randn(INPUT, 3 * HIDDEN) / np.sqrt(INPUT)).astype(f)
            self.p[f"wh{d}"] = (rng.randn(HIDDEN, 3 * HIDDEN) / np.sqrt(HIDDEN)).astype(f)
            self.p[f"b{d}"] = np.zeros(3 * HIDDEN, f)
        self.p["att"] = (rng.randn(2 * HIDDEN) * 0.3).astype(f)
        self.p["out"] = (rng.randn(2 * HIDDEN) * 0.3).astype(f)
        self.p["bias"] = np.full(1, -1.0, f)
        self.calibration = np.array([1.0, 0.0, -2.0])  # of the largest logit, the log of the windows, and one
        self.trained = False

    def see(self, odds: dict[str, np.ndarray]) -> None:
        """Take these log-odds of words and n-grams as inputs from now on."""
        self.word_stat, self.gram_stat = odds["word"], odds["gram"]

    def inputs(self, lex: Lexicon) -> np.ndarray:
        """One input row per distinct word."""
        size = np.diff(lex.gram_first).astype(np.float32)[:, None]
        first = lex.gram_first[:-1]
        x = np.empty((len(lex.word_slot), INPUT), np.float32)
        stat = self.gram_stat[lex.gram]
        x[:, 0] = self.word_stat[lex.word_slot]
        x[:, 1] = np.maximum.reduceat(stat, first)
        x[:, 2] = np.add.reduceat(stat, first) / size[:, 0]
        x[:, STATS : STATS + EMBED] = self.word_embed[lex.word_slot]
        x[:, STATS + EMBED :] = np.add.reduceat(self.gram_embed[lex.gram], first, axis=0) / size
        return x

    def _projected(self, x: np.ndarray, d: str) -> np.ndarray:
        """Inputs times weights, and a last row for the pad word, which leaves the state as it is."""
        pad = np.zeros((1, 3 * HIDDEN), np.float32)
        pad[:, HIDDEN : 2 * HIDDEN] = 40
        return np.vstack([x @ self.p[f"wx{d}"] + self.p[f"b{d}"], pad])

    def forward(self, x: np.ndarray, at: np.ndarray, keep: bool = False):
        """Logit of each window ``at`` (word numbers); with ``keep`` also what the gradients need."""
        n, steps = at.shape
        states, trace = {}, {}
        for d in "fb":
            proj, wh = self._projected(x, d), self.p[f"wh{d}"]
            h = np.zeros((n, HIDDEN), np.float32)
            hs = np.empty((steps, n, HIDDEN), np.float32)
            log = []
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                g, u = proj[at[:, t]], h @ wh
                rz = np.tanh((g[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN]) * np.float32(0.5))
                rz += 1
                rz *= np.float32(0.5)
                r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
                c = np.tanh(g[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
                if keep:
                    log.append((t, h, r, z, c, u[:, 2 * HIDDEN :]))
                h = c + z * (h - c)
                hs[t] = h
            states[d], trace[d] = hs, log
        a = states["f"] @ self.p["att"][:HIDDEN] + states["b"] @ self.p["att"][HIDDEN:]
        a[(at == len(x)).T] = -60
        e = np.exp(a - a.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = np.hstack([(alpha[:, :, None] * states[d]).sum(axis=0) for d in "fb"])
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, pooled, alpha, states, trace) if keep else logit

    def gradients(self, x: np.ndarray, at: np.ndarray, target: np.ndarray, weight: np.ndarray):
        logit, pooled, alpha, states, trace = self.forward(x, at, keep=True)
        d_logit = ((1 / (1 + np.exp(-logit)) - target) * weight / len(target)).astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["out"], grad["bias"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * self.p["out"]
        score = sum((states[d] * d_pooled[None, :, k * HIDDEN : (k + 1) * HIDDEN]).sum(axis=2) for k, d in enumerate("fb"))
        d_a = alpha * (score - (alpha * score).sum(axis=0))
        d_x = np.zeros_like(x)
        for k, d in enumerate("fb"):
            part = slice(k * HIDDEN, (k + 1) * HIDDEN)
            grad["att"][part] = np.einsum("tn,tnh->h", d_a, states[d])
            d_h_out = alpha[:, :, None] * d_pooled[None, :, part] + d_a[:, :, None] * self.p["att"][part]
            wx, wh = self.p[f"wx{d}"], self.p[f"wh{d}"]
            d_h = np.zeros((len(target), HIDDEN), np.float32)
            d_proj = np.zeros((len(x) + 1, 3 * HIDDEN), np.float32)
            for t, h, r, z, c, un in reversed(trace[d]):
                d_h = d_h + d_h_out[t]
                d_c = d_h * (1 - z) * (1 - c * c)
                d_z = d_h * (h - c) * z * (1 - z)
                d_r = d_c * un * r * (1 - r)
                d_u = np.hstack([d_r, d_z, d_c * r])
                grad[f"wh{d}"] += h.T @ d_u
                np.add.at(d_proj, at[:, t], np.hstack([d_r, d_z, d_c]))
                d_h = d_h * z + d_u @ wh.T
            d_proj = d_proj[:-1]
            grad[f"wx{d}"], grad[f"b{d}"] = x.T @ d_proj, d_proj.sum(axis=0)
            d_x += d_proj @ wx.T
        return grad, d_x

    def scores(self, column: pa.Array):
        """Score of every text of a string column."""
        if not self.trained:
            return np.zeros(len(column))
        raw, off = text_buffers(column)
        best, count = self.best_logits(raw, off)
        z = np.stack([best, np.log(np.maximum(count, 1)), np.ones(len(best))], axis=1) @ self.calibration
        return np.where(count > 0, 1 / (1 + np.exp(-np.clip(z, -60, 60))), 0.0)

    def best_logits(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, count = np.full(len(off) - 1, -np.inf), np.zeros(len(off) - 1, dtype=np.int64)
        for a, b in chunks(off, LEXICON_BYTES):
            lex = Lexicon(raw[off[a] : off[b]], off[a : b + 1] - off[a])
            if not len(lex.word):
                continue
            row, at = lex.windows()
            x = self.inputs(lex)
            for k in range(0, len(row), 4096):
                np.maximum.at(best, a + row[k : k + 4096], self.forward(x, at[k : k + 4096]))
            count[a:b] = np.bincount(row, minlength=b - a)
        return np.where(count > 0, best, -60.0), count


def _counts(raw: np.ndarray, off: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """Texts of each class that hold a word or n-gram, by its slot."""
    counts = {k: np.zeros((2, n), np.float32) for k, n in (("word", WORD_SLOTS), ("gram", GRAM_SLOTS))}
    for a, b in chunks(off, LEXICON_BYTES):
        lex = Lexicon(raw[off[a] : off[b]], off[a : b + 1] - off[a])
        text = np.repeat(np.arange(b - a), np.diff(lex.first))
        pairs = np.unique(text * len(lex.word_slot) + lex.word) if len(lex.word) else np.zeros(0, np.int64)
        text, word = np.divmod(pairs, max(1, len(lex.word_slot)))
        seen = np.unique(text * WORD_SLOTS + lex.word_slot[word])
        np.add.at(counts["word"], (toxic[a + seen // WORD_SLOTS], seen % WORD_SLOTS), 1)
        size = np.diff(lex.gram_first)[word]
        at = np.repeat(lex.gram_first[word], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        seen = np.unique(np.repeat(text, size) * GRAM_SLOTS + lex.gram[at])
        np.add.at(counts["gram"], (toxic[a + seen // GRAM_SLOTS], seen % GRAM_SLOTS), 1)
    return counts


def _log_odds(counts: dict[str, np.ndarray], share: float) -> dict[str, np.ndarray]:
    """Log-odds of words and n-grams, smoothed towards the share of toxic texts."""
    out = {}
    for kind, (clean, bad) in counts.items():
        out[kind] = np.log((bad + PRIOR * share) / (clean + PRIOR * (1 - share))) - np.log(share / (1 - share))
    return out


def _chosen_windows(lex: Lexicon, toxic: np.ndarray, net: Network, rng) -> tuple[np.ndarray, np.ndarray]:
    """Windows to learn from: of a toxic text the strongest, of a clean one the strongest and two others."""
    row, at = lex.windows()
    x = net.inputs(lex)
    value = np.append(np.maximum(x[:, 0], x[:, 1]), -9)[at]
    strength = np.sort(value, axis=1)[:, -2:].sum(axis=1)
    order = np.lexsort((-strength, row))
    first = np.searchsorted(row[order], np.arange(lex.rows))
    has = np.diff(lex.first) > 0
    picks = [order[first[has]]]
    clean = np.flatnonzero(has & (toxic == 0))
    n = np.bincount(row, minlength=lex.rows)
    picks += [order[first[clean] + rng.randint(0, n[clean])] for _ in range(2)]
    chosen = np.concatenate(picks)
    bad = toxic[row[chosen]]
    # a toxic text without evidence says nothing about which window is the toxic one
    use = (bad == 0) | (strength[chosen] > 1.0)
    return at[chosen[use]], bad[use]


def _log_loss(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    z = np.clip(x @ _logistic(x, y, weight), -40, 40)
    return float(((np.log1p(np.exp(z)) - y * z) * weight).sum() / weight.sum())


def train(texts: pa.Array, toxic: np.ndarray, class_weight: tuple[float, float] = (1.0, 1.0), *, epochs: int = 3, least_steps: int = 200, folds: int = 5, seed: int = 5) -> Network:
    """Fit a network on texts and their labels (0 or 1). ``class_weight``: labelled rows that one sampled row stands for.

    At least ``epochs`` passes and ``least_steps`` gradient steps are made.
    """
    net = Network()
    toxic = np.asarray(toxic).astype(np.int64)
    if len(set(toxic.tolist())) < 2:
        return net
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    fold = np.empty(len(toxic), np.int64)
    fold[np.argsort(toxic, kind="stable")] = np.arange(len(toxic)) % folds  # both classes in every fold
    rows = [np.flatnonzero(fold == f) for f in range(folds)]
    buffers = [text_buffers(texts.take(pa.array(r))) for r in rows]
    counts = [_counts(raw, off, toxic[r]) for (raw, off), r in zip(buffers, rows, strict=True)]
    total = {k: sum(c[k] for c in counts) for k in counts[0]}
    share = toxic.mean()
    stats = [_log_odds({k: total[k] - c[k] for k in total}, share) for c in counts]
    weight = np.where(toxic == 1, class_weight[1], class_weight[0])

    def judged(f: int) -> np.ndarray:
        net.see(stats[f])
        best, count = net.best_logits(*buffers[f])
        return np.stack([best, np.log(np.maximum(count, 1)), np.ones(len(best))], axis=1)

    rng = np.random.RandomState(seed)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step, best, test = 0, None, folds - 1
    per_epoch = sum(len(list(chunks(off, STEP_BYTES))) for f, (_, off) in enumerate(buffers) if f != test)
    epochs = max(epochs, -(-least_steps // max(1, per_epoch)))
    for epoch in range(epochs):
        rate = 0.02 * 0.1 ** (epoch / epochs)
        parts = [(f, a, b) for f, (_, off) in enumerate(buffers) if f != test for a, b in chunks(off, STEP_BYTES)]
        for f, a, b in (parts[k] for k in rng.permutation(len(parts))):
            raw, off = buffers[f]
            lex = Lexicon(raw[off[a] : off[b]], off[a : b + 1] - off[a])
            if not len(lex.word):
                continue
            net.see(stats[f])
            at, bad = _chosen_windows(lex, toxic[rows[f][a:b]], net, rng)
            if not len(bad):
                continue
            words_used, at = np.unique(at, return_inverse=True)
            at = at.reshape(-1, WINDOW)
            real = words_used < len(lex.word_slot)
            x = net.inputs(lex)[words_used[real]]
            each = np.where(bad == 1, len(bad) / max(1, 2 * (bad == 1).sum()), len(bad) / max(1, 2 * (bad == 0).sum()))
            grad, d_x = net.gradients(x, at, bad, np.minimum(each, 8))
            step += 1
            for k, v in net.p.items():
                m, s = moment[k]
                m += 0.1 * (grad[k] - m)
                s += 0.01 * (grad[k] ** 2 - s)
                v -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            slots = lex.word_slot[words_used[real]]
            np.add.at(net.word_embed, slots, -rate * 5 * d_x[:, STATS : STATS + EMBED])
            g0, g1 = lex.gram_first[words_used[real]], lex.gram_first[words_used[real] + 1]
            size = g1 - g0
            of = np.repeat(np.arange(len(size)), size)
            at_gram = np.repeat(g0, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            np.add.at(net.gram_embed, lex.gram[at_gram], -rate * 5 * d_x[of, STATS + EMBED :] / size[of, None])
        if epoch % max(1, epochs // 4) == 0 or epoch == epochs - 1:
            loss = _log_loss(judged(test), toxic[rows[test]], weight[rows[test]])
            if best is None or loss < best[0]:
                best = (loss, {k: v.copy() for k, v in net.p.items()}, net.word_embed.copy(), net.gram_embed.copy())
    _, net.p, net.word_embed, net.gram_embed = best
    seen = np.concatenate(rows)
    net.calibration = _logistic(np.concatenate([judged(f) for f in range(folds)]), toxic[seen], weight[seen])
    net.see(_log_odds(total, share))
    net.trained = True
    return net


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(h, g)
        w -= move * min(1.0, 5 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-6:
            break
    return w


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows that are never learnt from: the CRC-32 of the id as text is 2 modulo 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, per_class: tuple[int, int] = (4000, 2000), sample_bytes: int = 32 << 20) -> Network:
    """Train on at most ``per_class`` labelled rows of each class (clean, toxic) that are not held out.

    Their texts are taken in the order of the ids' hashes as long as they fit ``sample_bytes`` together.
    """
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    picked = [usable.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class[c]).toArrow() for c in (0, 1)]
    ids = pa.concat_tables(picked)
    # the bound on the sample bounds this broadcast
    sample = F.broadcast(spark.createDataFrame(list(zip(*(ids.column(c).to_pylist() for c in ("doc_id", "toxic")), strict=True)), "doc_id long, toxic int"))
    rows = docs.select("doc_id", "text").join(sample, "doc_id").where("text is not null").groupBy(F.xxhash64("text").alias("h")).agg(F.min(F.struct("doc_id", "toxic", "text")).alias("r"))
    rows = Scratch(spark, "toxicity").keep(rows.select("r.*"))
    sizes = rows.select("doc_id", F.xxhash64("doc_id").alias("h"), F.octet_length("text").alias("bytes")).toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending")])
    taken, used = [], 0
    for doc_id, size in zip(sizes.column("doc_id").to_pylist(), sizes.column("bytes").to_pylist(), strict=True):  # no more than the sample
        if used + size <= sample_bytes:
            taken.append((doc_id,))
            used += size
    chosen = F.broadcast(spark.createDataFrame(taken, "doc_id long"))
    rows = rows.join(chosen, "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id")).toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending")])
    toxic = rows.column("toxic").to_numpy().astype(np.int64)
    weight = tuple(totals.get(c, 0) / max(1, int((toxic == c).sum())) for c in (0, 1))
    network = train(rows.column("text"), toxic, weight)
    del rows
    release(spark)
    return network


def score(docs: DataFrame, network: Network, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a last column ``score_col``, in place of a column of that name (in any case) if there is one."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    bound_batches(docs.sparkSession)

    def run(batches):
        net = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(net.scores(batch.column(batch.schema.names.index(text_col))), pa.float64())], [*batch.schema.names, score_col])

    docs = docs.select(*(c for name, c in zip(docs.columns, same_columns(docs), strict=True) if name.lower() != score_col.lower()))
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    out = score(docs.select("doc_id", "text"), fit(spark, docs, labels))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

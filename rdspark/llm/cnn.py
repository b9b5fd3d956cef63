"""A convolutional classifier for toxic text, in NumPy.

Words (runs of letters and digits, lower case) are hashed to rows of an embedding table. Filters of several widths slide over the whole text, each
keeps its largest answer, and a logistic unit sums up. Scores are shifted by language so that 0.5 is the best threshold for each:
the language is guessed from the text's own function words, never taken from a column.

Training takes every labelled row. Up to ``SHARD`` texts are learned in one task; more are dealt out, each round every task goes on from the same model with
its own texts, and what the tasks have changed is averaged (``_joined``). Thresholds are set over all held rows, by their counts in fine steps of the score. Scoring
reads every text whole, in slabs, and cuts a longer text into overlapping stretches whose maxima are joined.

Defined results: null and empty texts get the score that no word at all gives; rows without an id are scored but never learned from; labels that are
null or other than 0 and 1 are left out; with one class or none the score is constant; repeated rows are repeated; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rdspark.llm.tables import fresh, written
from rdspark.llm.words import NOT_ALNUM, hashes, slabs, spans, LOWER


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 15
    width: int = 12
    widths: tuple = (1, 2, 3)
    filters: int = 8
    steps: int = 24_000      # texts seen in training, in 4 to 40 rounds
    batch: int = 64
    rate: float = 0.01
    least_held: int = 20     # rows of label 1 among those held for the thresholds
    least_seen: int = 3      # labelled texts that hold a word, else it is read as unknown
    stretch: int = 1 << 15
    seed: int = 7


#: Function words by language, to guess the language of a text; fixed values.
MARKERS = {
    "en": "the and of to is that it was with for this are from".split(),
    "de": "der die und das ist ein nicht den von mit sich des auf".split(),
    "fr": "le la les et des que un une pour par est dans qui au".split(),
    "es": "el los las de que y en un por con para del su".split(),
}
LANGUAGES = tuple(MARKERS)


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = spans(data, np.array([0, len(data)]), NOT_ALNUM)
    return hashes(data, starts, ends)


def _marker_table(buckets: int) -> np.ndarray:
    """Languages x buckets: 1 where a function word of the language falls."""
    out = np.zeros((buckets, len(MARKERS)), np.float32)
    for k, words in enumerate(MARKERS.values()):
        out[(_hash_words(words) % np.uint64(buckets)).astype(int), k] = 1
    return out


def word_ids(data: np.ndarray, offs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[data]
    starts, ends, before = spans(data, offs, NOT_ALNUM)
    return (hashes(data, starts, ends) % np.uint64(buckets)).astype(np.int32), before


class Model:
    """Embedding, filters, output unit, and the shift of each language. ``constant`` stands in where there was nothing to learn."""

    def __init__(self, s: Settings, constant: float | None = None):
        r = np.random.default_rng(s.seed)
        self.s, self.constant = s, constant
        self.embedding = r.normal(0, 0.1, (s.buckets, s.width)).astype(np.float32)
        self.filters = [r.normal(0, 0.3, (w, s.width, s.filters)).astype(np.float32) for w in s.widths]
        self.bias = np.zeros(len(s.widths) * s.filters, np.float32)
        self.out = r.normal(0, 0.3, len(s.widths) * s.filters).astype(np.float32)
        self.out_bias = 0.0
        self.shift = np.zeros(len(LANGUAGES) + 1)      # the last: no function words
        self.place = np.arange(s.buckets, dtype=np.int32)      # bucket 0 stands for all words that training has hardly seen
        self._table = None

    def pooled(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Rows x filters: the largest answer of each filter in each text (0 where the text has fewer words than the filter)."""
        s, rows, ids = self.s, len(before) - 1, self.place[ids]
        if self._table is None:      # what each word adds at each place of each filter
            self._table = [np.concatenate([self.embedding @ f[j] for j in range(len(f))], 1) for f in self.filters]
        out = np.zeros((rows, len(self.bias)), np.float32)
        lengths = np.diff(before)
        for w, table, at in zip(s.widths, self._table, range(0, len(self.bias), s.filters)):
            bias = self.bias[at:at + s.filters]
            for a in range(0, len(ids), s.stretch):
                part = table[ids[a:a + s.stretch + w - 1]]
                n = len(part) - w + 1
                if n <= 0:
                    continue
                z = part[:n, :s.filters]
                for j in range(1, w):
                    z = z + part[j:j + n, j * s.filters:(j + 1) * s.filters]
                # Rows that have windows among those that start at a .. a + n.
                first, last = np.maximum(before[:-1], a) - a, np.minimum(before[1:] - w + 1, a + n) - a
                hit = np.flatnonzero(last > first)
                if len(hit):
                    edges = np.stack([first[hit], np.minimum(last[hit], n)], 1).ravel()
                    top = np.maximum.reduceat(np.concatenate([z, np.full((1, s.filters), -np.inf, np.float32)]), edges, axis=0)[::2]
                    out[hit, at:at + s.filters] = np.maximum(out[hit, at:at + s.filters], top + bias)
        out[lengths == 0] = 0
        return out

    def logits(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        return self.pooled(ids, before).astype(np.float64) @ self.out + self.out_bias

    def languages(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Index of the guessed language of each row."""
        if self._table is None or not hasattr(self, "_markers"):
            self._markers = _marker_table(self.s.buckets)
        hits = np.concatenate([np.zeros((1, len(LANGUAGES))), np.cumsum(self._markers[ids], 0, dtype=np.float64)])
        per = hits[before[1:]] - hits[before[:-1]]
        return np.where(per.max(1, initial=0) > 0, per.argmax(1), len(LANGUAGES))

    def scores(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(before) - 1, self.constant)
        z = self.logits(ids, before) - self.shift[self.languages(ids, before)]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def packed(self) -> "Model":
        self._table = None
        if hasattr(self, "_markers"):
            del self._markers
        return self


class _Learner:
    """Adam on the logistic loss. Gradients reach a filter only through the window of its maximum, so a step is cheap."""

    def __init__(self, model: Model):
        self.model, self.step = model, 0
        self.touched = np.zeros(model.s.buckets, bool)
        self.state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in
                      [*((n, getattr(model, n)) for n in ("embedding", "bias", "out")), *((f"f{k}", f) for k, f in enumerate(model.filters))]}

    def _adam(self, value, grad, key, rows=None):
        m, v = self.state[key]
        pick = slice(None) if rows is None else rows
        m[pick] = 0.9 * m[pick] + 0.1 * grad
        v[pick] = 0.999 * v[pick] + 0.001 * grad * grad
        value[pick] -= self.model.s.rate * (m[pick] / (1 - 0.9 ** self.step)) / (np.sqrt(v[pick] / (1 - 0.999 ** self.step)) + 1e-8)

    def learn(self, rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> None:
        """One step. ``rows`` are the word ids of some texts, at their places in the table."""
        model, s, pad = self.model, self.model.s, max(self.model.s.widths)
        self.step += 1
        g_emb_at, g_emb, g_f = [], [], [np.zeros_like(f) for f in model.filters]
        g_bias, g_out, g_b = np.zeros_like(model.bias), np.zeros_like(model.out), 0.0
        for ids, label, weight in zip(rows, labels, weights):
            if len(ids) < pad:
                continue
            x, pooled, tops = model.embedding[ids], [], []
            for f in model.filters:
                w = len(f)
                z = x[:len(x) - w + 1] @ f[0]
                for j in range(1, w):
                    z += x[j:len(x) - w + 1 + j] @ f[j]
                top = z.argmax(0)
                tops.append(top)
                pooled.append(z[top, np.arange(s.filters)])
            h = np.concatenate(pooled) + model.bias
            active = np.maximum(h, 0)
            p = 1 / (1 + np.exp(-np.clip(active @ model.out + model.out_bias, -40, 40)))
            d = weight * (p - label) / len(rows)
            g_out += d * active
            g_b += d
            dh = (d * model.out * (h > 0)).astype(np.float32)
            g_bias += dh
            for a, (f, top) in enumerate(zip(model.filters, tops)):
                part = dh[a * s.filters:(a + 1) * s.filters]
                for j in range(len(f)):
                    g_f[a][j] += x[top + j].T * part
                    g_emb_at.append(ids[top + j])
                    g_emb.append(f[j].T * part[:, None])
        if g_emb_at:
            at, inverse = np.unique(np.concatenate(g_emb_at), return_inverse=True)
            grad = np.zeros((len(at), s.width), np.float32)
            np.add.at(grad, inverse, np.concatenate(g_emb))
            self._adam(model.embedding, grad, "embedding", at)
            self.touched[at] = True
        for a, f in enumerate(model.filters):
            self._adam(f, g_f[a], f"f{a}")
        self._adam(model.bias, g_bias, "bias")
        self._adam(model.out, g_out.astype(np.float32), "out")
        model.out_bias -= s.rate * g_b

    def learn_all(self, rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, r: np.random.Generator) -> None:
        order = r.permutation(len(rows))
        for k in range(0, len(order), self.model.s.batch):
            group = order[k:k + self.model.s.batch]
            self.learn([rows[i] for i in group], labels[group], weights[group])


#: Texts that are learned in one task, one after the other.
SHARD = 8_000
#: Texts of a task that are learned in one random order, whatever the size of the batches they come in.
TOGETHER = 10_000
#: Steps of a logit in which scores are counted for the thresholds.
FINE = 1024
_DENSE = -1      # block of everything but the embedding


def _changed(learner: _Learner, seen: int) -> pa.RecordBatch:
    """(block, seen, at, values): the parameters after learning; of the embedding the rows that were touched, in blocks of 1024."""
    model = learner.model
    dense = np.concatenate([*(f.ravel() for f in model.filters), model.bias, model.out, [model.out_bias]]).astype("<f4")
    at = np.flatnonzero(learner.touched).astype(np.int32)
    parts = [x for x in np.split(at, np.flatnonzero(np.diff(at >> 10)) + 1) if len(x)]
    return pa.record_batch([pa.array([_DENSE, *(int(x[0] >> 10) for x in parts)], pa.int32()), pa.array([seen] * (len(parts) + 1), pa.int64()),
                            pa.array([b"", *(x.tobytes() for x in parts)], pa.binary()),
                            pa.array([dense.tobytes(), *(model.embedding[x].astype("<f4").tobytes() for x in parts)], pa.binary())], names=["block", "seen", "at", "values"])


def _mean(table: pa.Table) -> pa.Table:
    """The parameters of a block, averaged over the tasks that have touched them by the texts they saw."""
    block, total, weight = table.column("block")[0].as_py(), None, None
    for n, at, x in zip(table.column("seen").to_pylist(), table.column("at"), table.column("values")):
        values = np.frombuffer(x.as_buffer(), "<f4").astype(np.float64)
        if block == _DENSE:
            total, weight = (0 if total is None else total) + n * values, (weight or 0) + n
            continue
        if total is None:
            width = len(values) // (len(at.as_buffer()) // 4)
            total, weight = np.zeros((1024, width)), np.zeros(1024)
        rows = np.frombuffer(at.as_buffer(), np.int32) & 1023
        total[rows] += n * values.reshape(len(rows), -1)
        weight[rows] += n
    if block == _DENSE:
        at, values = np.zeros(0, np.int32), total / weight
    else:
        at = np.flatnonzero(weight).astype(np.int32)
        values = total[at] / weight[at, None]
        at = at + (block << 10)
    return pa.table({"block": pa.array([block], pa.int32()), "at": pa.array([at.tobytes()], pa.binary()), "values": pa.array([values.astype("<f4").tobytes()], pa.binary())})


def _joined(model: Model, rounds: DataFrame) -> None:
    """Takes the averages of what tasks have learned into the model; the driver gets one row a block, whatever the number of tasks."""
    got = rounds.groupBy("block").applyInArrow(_mean, "block int, at binary, values binary").toArrow()
    for block, at, x in zip(got.column("block").to_pylist(), got.column("at"), got.column("values")):
        values = np.frombuffer(x.as_buffer(), "<f4")
        if block != _DENSE:
            model.embedding[np.frombuffer(at.as_buffer(), np.int32)] = values.reshape(-1, model.s.width)
            continue
        for f in model.filters:
            f[:], values = values[:f.size].reshape(f.shape), values[f.size:]
        n = len(model.bias)
        model.bias[:], model.out[:], model.out_bias = values[:n], values[n:2 * n], float(values[2 * n])
    model.packed()


def _stored(s: Settings) -> str:
    """The type of word ids in tables."""
    return "<u2" if s.buckets <= 1 << 16 else "<i4"


def _texts(batch: pa.RecordBatch, s: Settings) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), _stored(s)) for x in batch.column("ids")]


def train(coded: DataFrame, s: Settings = Settings()) -> Model:
    """A model of the rows (label, held, ids) of a written table. Held rows set the thresholds, the others are learned from."""
    count = {(r["label"], r["held"]): r["n"] for r in coded.groupBy("label", "held").agg(F.count(F.lit(1)).alias("n")).collect()}      # four rows
    per = {k: count.get((k, True), 0) + count.get((k, False), 0) for k in (0, 1)}
    n = per[0] + per[1]
    if not per[0] or not per[1]:
        return Model(s, 0.5 if not n else float(per[1] > 0))
    model, weight = Model(s), np.array([n / (2 * per[0]), n / (2 * per[1])])

    def words(batches):
        total = np.zeros(s.buckets, np.int64)
        for batch in batches:
            for ids in _texts(batch, s):
                total[np.unique(ids)] += 1
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["word", "n"])
    got = coded.select("ids").mapInArrow(words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()      # a row a bucket at most
    seen = np.zeros(s.buckets, np.int64)
    seen[got.column("word").to_numpy()] = got.column("n").to_numpy()
    model.place[seen < s.least_seen] = 0

    learned = coded.where("not held").select("label", "ids")
    size = count.get((0, False), 0) + count.get((1, False), 0)
    rounds, alone = min(40, max(4, s.steps // n)), size <= SHARD
    for k in range(1 if alone else rounds):
        def run(batches, k=k):
            learner, r, rows, labels, total = _Learner(model), np.random.default_rng([s.seed, k]), [], [], 0
            for batch in batches:
                texts, label = [model.place[x] for x in _texts(batch, s)], batch.column("label").to_numpy().astype(int)
                rows, labels, total = rows + texts, [*labels, *label], total + len(texts)
                while not alone and len(rows) >= TOGETHER:      # alone: SHARD texts at most
                    some = np.array(labels[:TOGETHER], int)
                    learner.learn_all(rows[:TOGETHER], some, weight[some], r)
                    rows, labels = rows[TOGETHER:], labels[TOGETHER:]
            if rows:
                labels = np.array(labels, int)
                for _ in range(rounds if alone else 1):
                    learner.learn_all(rows, labels, weight[labels], r)
            if total:
                yield _changed(learner, total)
        # Alone: one task has all rows, in a fixed order.
        source = learned.coalesce(1) if alone else learned
        _joined(model, source.mapInArrow(run, "block int, seen long, at binary, values binary"))
    # Few held rows say little about a threshold: then all rows set it.
    _calibrate(model, coded.where("held") if count.get((1, True), 0) >= s.least_held else coded)
    return model


def _calibrate(model: Model, coded: DataFrame) -> None:
    """For each language the shift that makes 0.5 the threshold with the best F1 on rows not trained on; few rows: that of all. All rows count, in
    steps of 1 / FINE: what comes to the driver is a number for each language, label and step that occurs."""
    def run(batches):
        for batch in batches:
            ids = _texts(batch, model.s)
            before = np.r_[0, np.cumsum([len(x) for x in ids])].astype(int)
            flat = np.concatenate(ids).astype(np.int32) if before[-1] else np.zeros(0, np.int32)
            z = np.floor(np.clip(model.logits(flat, before), -40, 40) * FINE).astype(np.int64)
            yield pa.record_batch([pa.array(model.languages(flat, before), pa.int64()), pa.array(z), batch.column("label")], names=["lang", "z", "label"])
    got = coded.select("label", "ids").mapInArrow(run, "lang long, z long, label int").groupBy("lang", "z").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("hits")).toArrow()
    lang, z, n, hits = (got.column(c).to_numpy() for c in ("lang", "z", "n", "hits"))

    def best(own):
        zs, at = np.unique(-z[own], return_inverse=True)
        n_, h = (np.cumsum(np.bincount(at, x[own], len(zs))) for x in (n, hits))
        if not len(zs) or not h[-1] or h[-1] == n_[-1]:
            return 0.0
        k = int((2 * h / (n_ + h[-1])).argmax())
        low = -zs[k]      # the lower edge of the last step above the threshold
        return float((low + (1 - zs[k + 1])) / 2 if k + 1 < len(zs) else low - FINE) / FINE
    model.shift[:] = best(np.ones(len(z), bool))
    for k in range(len(LANGUAGES)):
        own = lang == k
        if hits[own].sum() >= 20 and (n[own] - hits[own]).sum() >= 20:
            model.shift[k] = best(own)
    model.packed()


#: Training rows of one id, at most.
ROWS_PER_ID = 4


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, allowed, per_class: int) -> DataFrame:
    """(doc_id, label): at most ``per_class`` ids of each class, by the smallest hash of the id. Only labels that meet a row of ``docs`` count."""
    good = labels.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & allowed).groupBy("doc_id").agg(
        F.round(F.avg(column)).cast("int").alias("label"))
    parts = [good.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def labelled_rows(docs: DataFrame, labels: DataFrame, column: str, allowed, per_class: int) -> DataFrame:
    """(doc_id, label, at, text) of the sample: equal rows once, and of an id with many texts one of each of ROWS_PER_ID parts by hash, so the rows are
    bounded as the ids are. Partial minima come first, so no id's rows meet in one task."""
    picked = labelled_sample(docs, labels, column, allowed, per_class)
    # Two classes of ``per_class`` rows of 12 bytes: a bounded broadcast.
    rows = docs.where(F.col("doc_id").isNotNull()).join(F.broadcast(picked), "doc_id").select(
        "doc_id", "label", F.coalesce("text", F.lit("")).alias("text")).withColumn("at", F.xxhash64("text"))
    return rows.groupBy("doc_id", "label", F.pmod("at", F.lit(ROWS_PER_ID)).alias("part")).agg(F.min(F.struct("at", "text")).alias("row")).select(
        "doc_id", "label", "row.at", "row.text")


def coded_texts(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, at, ids) of the rows with an id: the hash of the text and its word ids, whole, in as few bytes an id as the table needs."""
    def code(batches):
        for batch in batches:
            for _, part, data, offs in slabs(batch):
                ids, before = word_ids(data, offs, s.buckets)
                ids = ids.astype(_stored(s))
                yield pa.record_batch([part.column("doc_id"), part.column("at"), pa.array([ids[a:b].tobytes() for a, b in zip(before[:-1], before[1:])], pa.binary())],
                                      names=["doc_id", "at", "ids"])
    text = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return text.select("doc_id", F.xxhash64("text").alias("at"), "text").mapInArrow(code, "doc_id long, at long, ids binary")


def labelled(docs: DataFrame, labels: DataFrame, column: str, allowed, s: Settings) -> DataFrame:
    """(doc_id, label, at, ids): all labelled rows; ``at`` is the hash of the text. Labels of one id are averaged. What meets the labels are word ids, a
    third of the text, and both sides are dealt by id whatever their size: a text is never moved, and labels are never sent whole to every task."""
    good = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & allowed).groupBy("doc_id").agg(F.round(F.avg(column)).cast("int").alias("label"))
    return coded_texts(docs, s).join(good.hint("merge"), "doc_id").select("doc_id", "label", "at", "ids")


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", allowed=None, s: Settings = Settings()) -> Model:
    """Train on all labelled rows. Word ids are made and kept by the executors; a text comes as its ids, whole."""
    allowed = F.lit(True) if allowed is None else allowed
    shards = max(1, -(-labels.where(F.col(column).isin(0, 1) & allowed).count() // SHARD))
    # Dealt out by hash, so every shard is a random share; equal rows meet in it, and stand in the same order in every run.
    dealt = labelled(docs, labels, column, allowed, s).repartition(shards, "doc_id", "at")
    once = dealt.groupBy("doc_id", "label", "at").agg(F.first("ids").alias("ids")).sortWithinPartitions("at", "doc_id")
    coded = written(once.select("label", (F.pmod(F.xxhash64("at", "doc_id", F.lit(s.seed)), F.lit(5)) == 0).alias("held"), "ids"), "labelled")
    return train(coded, s)


def score(docs: DataFrame, model: Model, *keep: str, out: str = "score") -> DataFrame:
    """``keep`` columns and the score, named ``out``, for each row. The model, of fixed size, travels with the function."""
    text = fresh(docs, "_scored_text")
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("text", F.lit("")).alias(text))
    model.packed()

    def run(batches):
        for batch in batches:
            for _, part, data, offs in slabs(batch, text):
                ids, before = word_ids(data, offs, model.s.buckets)
                yield pa.record_batch([*[part.column(c) for c in keep], pa.array(model.scores(ids, before))], names=[*keep, out])
    kept = source.select(*[F.col(f"`{c}`") for c in keep])
    return source.mapInArrow(run, kept.withColumn(out, F.lit(0.0)).schema)

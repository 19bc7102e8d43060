"""Subject areas of documents: averaged word and subword embeddings with independent logistic outputs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.text import fold, sentences, visible, without_links, words
from threadlake.plans.lineage import Stages
from threadlake.sources.tables import table

#: Hashed rows of the embedding table (a row number fits 16 bits) and their width.
BUCKETS, WIDTH = 1 << 16, 16
#: Labelled documents that the model is fitted on at most (chosen by hash).
SAMPLE = 20_000
#: Rounds of fitting whole documents, then sentences with the labels their document allows. A round sums the gradients of
#: about ``BATCH`` documents over all partitions; the parts of a larger sample take turns.
DOCUMENT_ROUNDS, SENTENCE_ROUNDS, BATCH = 8, 20, 4000
#: First step length; it falls to a fifth. Decay of the running means of the gradient and its square.
RATE, MEAN, SQUARE = 0.25, 0.9, 0.98
#: Gradients a round brings to the driver at most (a partition each, 4.5 MB at most).
SHARDS = 12
#: Share of a text's rows that a training step sees: no single word may carry a label.
KEPT = 0.5
#: Logit under which a sentence of a labelled document counts as small talk.
UNLIKELY = -4.0
#: Share of a document's sentences that must deal with a subject.
SHARE = 1 / 3
#: Stretches without punctuation are judged in windows of about so many words.
WINDOW, LONGEST = 16, 40
#: Stretches of fewer words are joined with the next.
SHORTEST = 5
#: Letters of a subword.
SUBWORD = 4
#: Words that a worker remembers; beyond that it starts over between batches.
REMEMBERED = 400_000


class Vocabulary(dict):
    """Stretch without white space -> numbers of its folded words; a word is hashed when first met.

    ``hashes``: per word; ``wordy``: more than a letter and not all digits; ``subs``: rows of the word and its subwords.
    """

    def __init__(self):
        self.number: dict[str, int] = {}
        self.hashes: list[int] = []
        self.wordy: list[bool] = []
        self.subs: list[list[int]] = []

    def __missing__(self, stretch: str) -> tuple[int, ...]:
        found = self[stretch] = tuple([self._word(w) for w in words(fold(stretch))])
        return found

    def _word(self, w: str) -> int:
        k = self.number.get(w)
        if k is None:
            k = self.number[w] = len(self.hashes)
            marked = f"<{w}>"
            names = [w, *[marked[i : i + SUBWORD] for i in range(len(marked) - SUBWORD + 1)]]
            self.hashes.append(zlib.crc32(w.encode()))
            self.wordy.append(len(w) > 1 and not w.isdigit())
            self.subs.append([zlib.crc32(x.encode()) % BUCKETS for x in names])
        return k

    def units_of(self, text: str | None) -> list[list[int]]:
        """Words of each sentence; long stretches without punctuation in windows."""
        out: list[list[int]] = []
        wordy = 0  # of the last one
        for s in sentences(without_links(visible(text or ""))):
            w = list(chain.from_iterable(map(self.__getitem__, s.split())))
            parts = max(1, round(len(w) / WINDOW)) if len(w) > LONGEST else 1
            for i in range(parts):
                piece = w[len(w) * i // parts : len(w) * (i + 1) // parts]
                if out and wordy < SHORTEST:  # a line break or mark inside a sentence
                    out[-1] = out[-1] + piece
                    wordy += sum([self.wordy[x] for x in piece])
                elif piece:
                    out.append(piece)
                    wordy = sum([self.wordy[x] for x in piece])
        if len(out) > 1 and wordy < SHORTEST:
            out.pop()  # numbers, code and other scraps are no sentence
        return out


def _pair_rows(hashes: np.ndarray) -> np.ndarray:
    """Rows of each word with the next one, from the words' 32-bit hashes."""
    mixed = hashes[:-1] * np.uint64(0x9E3779B1) + hashes[1:] * np.uint64(0x85EBCA77) + (hashes[:-1] >> np.uint64(15))
    return ((mixed >> np.uint64(16)) % np.uint64(BUCKETS)).astype(np.int64)


def _encoded(vocabulary: Vocabulary, units: list[list[int]]) -> tuple[bytes, bytes, bytes, bytes]:
    """Words per sentence (32 bit), rows per word (16), rows of the words, rows of the pairs inside sentences (16)."""
    size = np.array([len(u) for u in units], np.uint32)
    ids = list(chain.from_iterable(units))
    subs = [vocabulary.subs[i] for i in ids]
    owner = np.repeat(np.arange(len(size)), size)
    pairs = _pair_rows(np.array([vocabulary.hashes[i] for i in ids], np.uint64))[owner[1:] == owner[:-1]]
    count = np.minimum([len(x) for x in subs], 0xFFFF).astype(np.uint16)
    rows = np.array(list(chain.from_iterable([x[:0xFFFF] for x in subs])), np.uint16)
    return size.tobytes(), count.tobytes(), rows.tobytes(), pairs.astype(np.uint16).tobytes()


class Model:
    """embedding (buckets x width), output (width x subjects), bias."""

    def __init__(self, subjects: list[str]):
        rng = np.random.default_rng(7)
        self.subjects = subjects
        e = (rng.uniform(-1, 1, (BUCKETS, WIDTH)) / WIDTH).astype(np.float32)
        self.parameters = [e, rng.normal(0, 0.3, (WIDTH, len(subjects))).astype(np.float32), np.full(len(subjects), -1.0, np.float32)]


class Packed:
    """Rows and weights of sentences laid end to end, from what ``_encoded`` made of documents.

    A token (a word with its subwords, or a pair of neighbours) weighs one, a text is the mean of its tokens.
    """

    def __init__(self, size: np.ndarray, count: np.ndarray, rows: np.ndarray, pairs: np.ndarray):
        size, count = size.astype(np.int64), count.astype(np.int64)
        word_of = np.repeat(np.arange(len(size)), size)
        self.tokens = 2 * size - 1
        sub_of = np.repeat(word_of, count)
        pair_of = np.repeat(np.arange(len(size)), size - 1)
        # a sentence's words, then its pairs: each part moves on by what the other part holds before it
        held = np.bincount(sub_of, minlength=len(size))
        at = np.concatenate([np.arange(len(sub_of)) + (np.cumsum(size - 1) - (size - 1))[sub_of], np.arange(len(pair_of)) + np.cumsum(held)[pair_of]])
        self.owner, self.rows, self.weights = np.empty(len(at), np.int64), np.empty(len(at), np.int64), np.empty(len(at), np.float32)
        for own, part in ((self.owner, (sub_of, pair_of)), (self.rows, (rows, pairs)), (self.weights, (np.repeat(1 / count, count), np.ones(len(pairs))))):
            own[at] = np.concatenate(part)

    def means(self, embedding: np.ndarray, group: np.ndarray, kept: np.ndarray | None = None):
        """Means per group of sentences (``group``: ascending, of each sentence); with the rows, weights, groups they came from."""
        rows, weights, owner = (self.rows, self.weights, self.owner) if kept is None else (self.rows[kept], self.weights[kept], self.owner[kept])
        g = group[owner]
        weights = weights / np.bincount(group, self.tokens).astype(np.float32)[g]
        if kept is not None:
            weights = weights / np.float32(KEPT)
        out = np.zeros((group[-1] + 1, embedding.shape[1]), np.float32)
        if len(g):
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            out[g[first]] = np.add.reduceat(embedding[rows] * weights[:, None], first)
        return out, rows, weights, g


def _targets(z: np.ndarray, first: np.ndarray, n: np.ndarray, given: np.ndarray):
    """What each sentence should answer, from its document's labels and what the model thinks so far (logits ``z``).

    A label means that a third of the sentences deal with the subject: at least that many of the likeliest, and any the
    model is sure of; others it thinks of first are left open. A missing label only means that fewer do: sentences the
    model is sure of are left out of the loss.
    """
    target = np.zeros_like(z)
    best = z.argmax(1)
    for a, m, y in zip(first, n, given):
        at = np.arange(a, a + m)
        has = np.flatnonzero(y)
        need = max(1, int(np.ceil(m * SHARE - 1e-9)))
        for k in has:
            target[at[np.argsort(-z[at, k], kind="stable")[:need]], k] = 1
            target[at[z[at, k] > 0], k] = 1
            if len(has) > 1:  # of two labels a sentence takes the likelier one
                worse = at[np.isin(best[at], has) & (best[at] != k) & (z[at, k] < 0)]
                target[worse, k] = 0
    labelled = np.repeat(given, n, axis=0) == 1
    open_ = labelled & (target == 0) & (best[:, None] == np.arange(z.shape[1])) & (z > UNLIKELY)
    return target, np.where((~labelled & (z > 0.5)) | open_, 0.0, 1.0)


def _gradients(shared, phase: str, seed: int):
    """The summed gradient of one partition's documents: rows of the embedding it touches, the outputs, the bias."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        held = [f for f in frames if len(f)]
        if not held:
            return
        pdf = pd.concat(held)
        model: Model = shared.value
        e, o, b = model.parameters
        texts = Packed(*[np.frombuffer(b"".join(pdf[c]), t) for c, t in (("size", np.uint32), ("count", np.uint16), ("rows", np.uint16), ("pairs", np.uint16))])
        n = (pdf["size"].str.len() // 4).to_numpy()
        given = np.stack([np.isin(model.subjects, list(x)).astype(np.float32) for x in pdf["labels"]])
        if phase == "documents":
            group, target, mask = np.repeat(np.arange(len(n)), n), given, np.float32(1)
        else:
            group = np.arange(len(texts.tokens))
            target, mask = _targets(texts.means(e, group)[0] @ o + b, np.cumsum(n) - n, n, given)
        kept = np.flatnonzero(np.random.default_rng([seed, int(pdf["h"].iloc[0]) & 0xFFFF]).random(len(texts.rows), np.float32) < KEPT)
        x, rows, weights, owner = texts.means(e, group, kept)
        p = 1 / (1 + np.exp(-np.clip(x @ o + b, -30, 30)))
        d = ((p - target) * mask).astype(np.float32)
        dx = d @ o.T
        touched = np.flatnonzero(np.bincount(rows, minlength=BUCKETS))
        de = np.stack([np.bincount(rows, dx[owner, k] * weights, minlength=BUCKETS)[touched] for k in range(WIDTH)], 1).astype(np.float32)
        parts = [touched.astype(np.int32), de, (x.T @ d).astype(np.float32), d.sum(0), np.array([len(x)], np.int64)]
        yield pd.DataFrame([[np.ascontiguousarray(v).tobytes() for v in parts]], columns=list("abcde"))

    return run


class _Descent:
    """Steps along the synchronised gradient, scaled by running means of it and of its square."""

    def __init__(self, model: Model):
        self.model, self.t = model, 0
        self.mean = [np.zeros_like(p) for p in model.parameters]
        self.square = [np.zeros_like(p) for p in model.parameters]

    def step(self, gradients: list, rate: float) -> None:
        total = [np.zeros_like(p) for p in self.model.parameters]
        n = max(1, sum(int(np.frombuffer(g["e"], np.int64)[0]) for g in gradients))
        for g in gradients:
            rows = np.frombuffer(g["a"], np.int32)
            total[0][rows] += np.frombuffer(g["b"], np.float32).reshape(len(rows), WIDTH)
            total[1] += np.frombuffer(g["c"], np.float32).reshape(total[1].shape)
            total[2] += np.frombuffer(g["d"], np.float32)
        self.t += 1
        for p, m, v, g in zip(self.model.parameters, self.mean, self.square, total):
            g = g / np.float32(n)
            m *= np.float32(MEAN)
            m += np.float32(1 - MEAN) * g
            v *= np.float32(SQUARE)
            v += np.float32(1 - SQUARE) * g * g
            p -= np.float32(rate / (1 - MEAN**self.t)) * m / (np.sqrt(v / np.float32(1 - SQUARE**self.t)) + np.float32(1e-8))


def _cut(frames: Iterator) -> Iterator:
    import pandas as pd

    vocabulary = Vocabulary()
    for pdf in frames:
        units = [vocabulary.units_of(t) for t in pdf["text"]]
        some = np.array([len(u) > 0 for u in units], bool)
        coded = [_encoded(vocabulary, u) for u in units if u]
        out = pdf.loc[some, ["h", "labels"]].reset_index(drop=True)
        for k, c in enumerate(("size", "count", "rows", "pairs")):
            out[c] = [x[k] for x in coded]
        yield out


def fit(documents: DataFrame, labels: DataFrame, subjects: DataFrame, *, sample: int = SAMPLE) -> Model | None:
    """Fits the model on at most ``sample`` labelled documents; None without any.

    Each round broadcasts the parameters (a fixed 4.2 MB); every partition sums the gradient of its documents at these very
    parameters, the driver adds the partitions' sums (so how documents are spread does not matter) and takes one step. First
    whole documents learn their labels, then sentences learn which of their document's labels they carry; wrong labels of
    single documents are outvoted. The hashed form of the sample is written once and read by every round without a shuffle.
    """
    spark = documents.sparkSession
    names = sorted(r["subject"] for r in subjects.select("subject").filter(F.col("subject").isNotNull()).distinct().collect())
    h = F.xxhash64("doc_id")
    marked = (
        labels.select("doc_id", "subject").filter(F.col("subject").isin(names)).groupBy("doc_id").agg(F.collect_set("subject").alias("labels"))
        .orderBy(h, "doc_id").limit(sample)
    )
    with Stages(spark, "subjects") as stages:
        texts = documents.select("doc_id", "text").filter(F.col("text").isNotNull()).join(marked, "doc_id").select(h.alias("h"), "labels", "text")
        train = stages.keep(texts.mapInPandas(_cut, "h long, labels array<string>, size binary, count binary, rows binary, pairs binary"))
        n = train.count() if names else 0
        if not n:
            return None
        model = Model(names)
        descent = _Descent(model)
        parts = max(1, round(n / BATCH))
        plan = ["documents"] * DOCUMENT_ROUNDS + ["sentences"] * SENTENCE_ROUNDS
        for k, phase in enumerate(plan):
            shared = spark.sparkContext.broadcast(model)
            turn = train if parts == 1 else train.filter(F.pmod(F.shiftright("h", 8), F.lit(parts)) == k % parts)
            found = turn.coalesce(SHARDS).mapInPandas(_gradients(shared, phase, k), "a binary, b binary, c binary, d binary, e binary").collect()
            descent.step(found, RATE * (1 - 0.8 * k / len(plan)))
            shared.destroy()
    return model


class Scorer:
    """Adds up what words and pairs contribute to the logits, from tables, over a batch of texts at once."""

    def __init__(self, model: Model):
        e, o, self.bias = model.parameters
        self.subjects = model.subjects
        self.pairs = e @ o
        self.vocabulary = Vocabulary()
        self.words = np.zeros((1 << 12, len(self.subjects)), np.float32)
        self.hashes = np.zeros(1 << 12, np.uint64)
        self.n = 0

    def _learn(self) -> None:
        v = self.vocabulary
        while len(v.subs) > len(self.words):
            self.words, self.hashes = np.concatenate([self.words, np.zeros_like(self.words)]), np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        if self.n < (m := len(v.subs)):
            new = v.subs[self.n : m]
            size = np.array([len(x) for x in new])
            rows = np.fromiter(chain.from_iterable(new), np.int64, size.sum())
            self.words[self.n : m] = np.add.reduceat(self.pairs[rows], np.cumsum(size) - size) / size[:, None]
            self.hashes[self.n : m] = v.hashes[self.n : m]
            self.n = m

    def shares(self, texts: list[str | None]) -> np.ndarray:
        """Per text and subject the share of sentences that deal with it."""
        if len(self.vocabulary) > REMEMBERED:
            self.vocabulary, self.n = Vocabulary(), 0
        units = [self.vocabulary.units_of(t) for t in texts]
        self._learn()
        n = np.array([len(u) for u in units])
        out = np.zeros((len(texts), len(self.subjects)))
        if not n.sum():
            return out
        size = np.fromiter((len(s) for u in units for s in u), np.int64, n.sum())
        ids = np.fromiter((i for u in units for s in u for i in s), np.int64, size.sum())
        owner = np.repeat(np.arange(len(size)), size)
        total = self.words[ids]
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        total[inside] += self.pairs[_pair_rows(self.hashes[ids])[inside]]
        logits = np.add.reduceat(total, np.cumsum(size) - size) / (2 * size - 1)[:, None] + self.bias
        some = np.flatnonzero(n)
        out[some] = np.add.reduceat((logits > 0).astype(float), (np.cumsum(n) - n)[some]) / n[some][:, None]
        return out


_SCORERS: dict[bytes, Scorer] = {}


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        key = model.parameters[1].tobytes()
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(model)
        scorer = _SCORERS[key]
        names = np.array(scorer.subjects, object)
        for b in batches:
            share = scorer.shares(b.column("text").to_pylist())
            r, k = np.nonzero(share > 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(r)), pa.array(names[k], pa.string()), pa.array(share[r, k])], names=["doc_id", "subject", "share"])

    return run


def subject_shares(documents: DataFrame, labels: DataFrame, subjects: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """doc_id, subject, share of the document's sentences that deal with the subject; no row where none does.

    Every document is scored whole, where it lies, without a shuffle. Null, empty and wordless texts give no rows; a
    repeated document row gives its rows again; without labelled documents or subjects the result is empty; other columns
    are ignored. Labels of unknown subjects or documents play no part; repeated labels count once.
    """
    spark = documents.sparkSession
    model = fit(documents, labels, subjects, sample=sample)
    schema = "doc_id long, subject string, share double"
    if model is None:
        return spark.createDataFrame([], schema)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").isNotNull()).mapInArrow(_score(spark.sparkContext.broadcast(model)), schema)


def found(documents: DataFrame, labels: DataFrame, subjects: DataFrame, **options) -> DataFrame:
    """doc_id, subject where at least a third of the sentences deal with the subject."""
    return subject_shares(documents, labels, subjects, **options).filter(F.col("share") >= SHARE - 1e-9).select("doc_id", "subject")


def composition(documents: DataFrame, labels: DataFrame, subjects: DataFrame, **options) -> DataFrame:
    """subject, n_documents: what the corpus is made of."""
    return found(documents, labels, subjects, **options).groupBy("subject").agg(F.count("*").alias("n_documents"))


def queries() -> dict:
    def on(f):
        return lambda s, d: f(table(s, d, "documents"), table(s, d, "subject_labels"), table(s, d, "subject_areas"))

    return {"p9_found": on(found), "p9_composition": on(composition)}


def oracle_sql() -> dict[str, str]:
    return {}

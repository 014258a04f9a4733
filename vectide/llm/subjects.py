"""Subjects of documents: complement naive Bayes over sentences, refined by expectation-maximization, calibrated.

A sentence is a bag of hashed words, word pairs and, for scripts without spaces, character pairs and triples. The
weight of a feature for a subject is the log of its rate in sentences of that subject over its rate in all other
sentences (the complement); a sentence's score for a subject is the sum of its weights.

1. Labelled documents give the first counts: each sentence counts for its document's subjects in equal parts.
2. Expectation: every sentence of every document, labelled or not, gets a posterior over the subjects and "none";
   in a labelled document, subjects that nobody named are made unlikely, not impossible, as labels can be wrong.
   Maximization: the posteriors are the new counts, added up in Spark. Repeated `rounds` times.
3. Calibration, on labelled documents kept out of the training: for each subject an independent logistic curve maps the
   score to the probability that the sentence is about it (its posterior where the labels are known), and another the
   mean of a document's sentences to the probability that the document is labelled so; a further part of the labelled
   documents measures the latter (Brier score).
4. A document has every subject that at least `share` of its sentences are about (posterior of one half or more).

Bounds: labels of at most `max_labelled` documents are used (those with the smallest hash of their id); the counts have
at most 2**HASH_BITS x (subjects + 1) cells, whatever the corpus. All other steps read every document.
Defined cases: null and empty texts, and texts without a sentence, have no subject; labels are compared trimmed, in
lower case, with blanks as underscores, and unknown ones are ignored; repeated rows are judged alike; very long texts
are read whole. Texts are turned into slots once (bags), which all rounds read. Without labels there is nothing to learn and no row comes out.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.sources.storage import scratch

HASH_BITS = 18
TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
SPLIT = re.compile(r"[\n\r]+|(?<=[.!?])\s+|(?<=[。！？])")
TOKEN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
IDEOGRAPH = re.compile(r"[぀-ヿ㐀-鿿]")
END = frozenset(".!?。！？")
#: Labelled documents are dealt into FOLDS parts by hash of the id: the first calibrates, the second measures the
#: calibration, the others train.
FOLDS = 20


def sentences(text: str) -> list[str]:
    """Sentences that hold at least one word. What doesn't end with a mark (headings, page marks) is no sentence."""
    return [s for s in SPLIT.split(TAG.sub("\n", text)) if s.rstrip("\"')]»”* \t")[-1:] in END and TOKEN.search(s)]


class Numbers(dict):
    """63 bits of each word."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        raw = word.encode("utf-8", "surrogatepass")
        at = self[word] = zlib.crc32(raw) << 31 | zlib.crc32(raw, 0x5BD1E995) >> 1
        return at


_number = Numbers().__getitem__


@dataclass
class Bag:
    """Sentences of some documents: slots of all of them, where each begins, and the document of each."""

    slots: np.ndarray
    starts: np.ndarray
    owner: np.ndarray

    @staticmethod
    def of(texts: Sequence[str | None]) -> Bag:
        """The distinct slots of each sentence's words and word pairs, and of character pairs and triples in scripts without
        spaces."""
        words, pairs, at, owner = array("q"), array("b"), array("q"), array("q")  # of the words: numbers and whether they pair up
        for i, text in enumerate(texts):
            for s in sentences(text) if text else ():
                n = len(words)
                found = TOKEN.findall(s.lower())
                if not IDEOGRAPH.search(s):
                    words.extend(map(_number, found))
                    pairs.extend(b"\1" * len(found))
                else:
                    for word in found:
                        grams = [word[j : j + size] for size in (2, 3) for j in range(len(word) - size + 1)] if IDEOGRAPH.match(word) else [word]
                        words.extend(map(_number, grams))
                        pairs.extend((b"\0" if IDEOGRAPH.match(word) else b"\1") * len(grams))
                if len(words) > n:
                    at.append(n)
                    owner.append(i)
        w, plain = np.array(words, np.uint64), np.array(pairs, bool)
        starts = np.array(at, np.int64)
        sentence = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(w)]))
        both = plain[:-1] & plain[1:] & (sentence[:-1] == sentence[1:])
        pair = (w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:])[both]
        every = np.concatenate([w, pair]) * np.uint64(0xD6E8FEB86659FD93)
        key = np.concatenate([sentence, sentence[:-1][both]]) << HASH_BITS | (every >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        key.sort()
        key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
        sentence = key >> HASH_BITS
        return Bag(key & ((1 << HASH_BITS) - 1), np.searchsorted(sentence, np.arange(len(starts))), np.array(owner, np.int64))

    @staticmethod
    def packed(lengths: Sequence[bytes], slots: Sequence[bytes]) -> Bag:
        """From the rows of a table of bags."""
        counts = [len(x) // 4 for x in lengths]
        size = np.frombuffer(b"".join(lengths), np.int32).astype(np.int64)
        return Bag(np.frombuffer(b"".join(slots), np.int32).astype(np.int64), np.cumsum(size) - size, np.repeat(np.arange(len(counts)), counts))

    def lengths(self) -> np.ndarray:
        return np.diff(np.r_[self.starts, len(self.slots)])

    def scores(self, weights: np.ndarray, telling: np.ndarray) -> np.ndarray:
        """(sentences, subjects); weights: (slots, subjects); telling: the slots whose weights are not all 0."""
        n, subjects = len(self.starts), weights.shape[1]
        use = telling[self.slots]
        sentence, rows = np.repeat(np.arange(n), self.lengths())[use], weights[self.slots[use]]
        return np.stack([np.bincount(sentence, rows[:, c], n) for c in range(subjects)], axis=1) if n else np.zeros((0, subjects))

    def add_to(self, total: np.ndarray, rows: np.ndarray, least: float = 1e-3) -> None:
        """Add each sentence's row to its slots' counts; parts below `least` of a sentence go to its largest part."""
        rows = np.where(rows < least, 0, rows)
        rows[np.arange(len(rows)), rows.argmax(axis=1)] += 1 - rows.sum(axis=1)
        length = self.lengths()
        for c in range(rows.shape[1]):
            use = rows[:, c] > 0
            if use.any():
                take = np.repeat(use, length)
                total[:, c] += np.bincount(self.slots[take], np.repeat(rows[use, c], length[use]), len(total))


def weigh(counts: np.ndarray, smooth: float = 5.0, dead: float = 2.0, lean: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """(slots, subjects) log rates over the complement's and the subjects' priors, from counts (slots, subjects + 1),
    the last being "none".

    smooth occurrences, shared by size, are added to both sides, so that a feature seen once weighs next to nothing;
    weights below `dead` count as 0, so that the many features of common phrasing don't add up to a subject.
    """
    subjects, seen = counts[:, :-1], counts.sum(axis=1, keepdims=True)
    part = np.clip(subjects.sum(axis=0) / max(counts.sum(), 1e-9), 1e-6, 1 - 1e-6)
    own = (subjects + smooth * part) / part
    rest = (seen - subjects + smooth * (1 - part)) / (1 - part)
    w = np.log(own / np.maximum(rest, 1e-12))
    w[np.abs(w) < dead] = 0
    return w.astype(np.float32), (lean * np.log(part / part.max())).astype(np.float32)


def posteriors(scores: np.ndarray, named: np.ndarray, none_at: float, doubt: float = 0.02) -> np.ndarray:
    """(sentences, subjects + 1): of each subject and of none. named: 1 where the sentence's document bears the
    subject's label or no label at all, else 0. none_at: the score at which a subject is as likely as none."""
    prior = np.where(named > 0, 1.0, doubt)
    logit = np.concatenate([scores + np.log(prior), np.full((len(scores), 1), none_at)], axis=1)
    p = np.exp(np.clip(logit - logit.max(axis=1, keepdims=True), -60, 0))
    return p / p.sum(axis=1, keepdims=True)


def platt(score: np.ndarray, n: np.ndarray, yes: np.ndarray, none_at: float, hold: float = 0.01, steps: int = 60) -> tuple[float, float]:
    """Slope and offset of the logistic curve from scores to the part of sentences that are about a subject, by
    Newton's method on a histogram (n sentences, of which `yes` are); held near slope 1 and offset -none_at with a
    strength of `hold` of the sentences."""
    a, b = 1.0, -none_at
    keep = hold * n.sum() + 1
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        g, v = n * p - yes, n * p * (1 - p)
        h = np.array([[(v * score * score).sum() + keep, (v * score).sum()], [(v * score).sum(), v.sum() + keep / 10]])
        step = np.linalg.solve(h, [(g * score).sum() + keep * (a - 1), g.sum() + keep / 10 * (b + none_at)])
        step *= min(1, 2 / max(np.abs(step).max(), 1e-9))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 0.1)), float(b)


@dataclass
class Model:
    """Bounded by the hash space, whatever the corpus."""

    subjects: list[str]
    weights: np.ndarray
    priors: np.ndarray
    slope: np.ndarray
    offset: np.ndarray
    none_at: float
    #: Slope and offset of each subject's curve from the logit of a document's mean posterior to the part of documents labelled so.
    whole: np.ndarray
    #: (subject, documents, labelled, mean posterior, Brier score) on labelled documents that neither trained nor calibrated.
    report: list[tuple]

    def __getstate__(self) -> dict:
        """Only the slots with weights travel to the tasks."""
        rows = np.nonzero(self.weights.any(axis=1))[0].astype(np.int32)
        return self.__dict__ | {"weights": (len(self.weights), rows, self.weights[rows])}

    def __setstate__(self, state: dict) -> None:
        size, rows, own = state["weights"]
        weights = np.zeros((size, own.shape[1]), own.dtype)
        weights[rows] = own
        self.__dict__.update(state | {"weights": weights})

    @staticmethod
    def of(subjects: list[str], counts: np.ndarray, none_at: float) -> Model:
        weights, priors = weigh(counts)
        n = len(subjects)
        return Model(subjects, weights, priors, np.ones(n), np.full(n, -none_at), none_at, np.tile([1.0, 0.0], (n, 1)), [])

    def scores(self, bag: Bag) -> np.ndarray:
        return bag.scores(self.weights, self.weights.any(axis=1)) + self.priors

    def posterior(self, mean: np.ndarray) -> np.ndarray:
        """(documents, subjects): calibrated probability that a document would be labelled so."""
        return 1 / (1 + np.exp(-np.clip(self.whole[:, 0] * logit(mean) + self.whole[:, 1], -30, 30)))

    def judge(self, bag: Bag, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, subjects): part of each document's sentences that are about the subject, and their mean posterior."""
        p = 1 / (1 + np.exp(-np.clip(self.slope * self.scores(bag) + self.offset, -30, 30)))
        about, mean = np.zeros((n, len(self.subjects))), np.zeros((n, len(self.subjects)))
        for c in range(len(self.subjects)):
            about[:, c] = np.bincount(bag.owner, p[:, c] >= 0.5, n)
            mean[:, c] = np.bincount(bag.owner, p[:, c], n)
        size = np.maximum(np.bincount(bag.owner, minlength=n), 1)[:, None]
        return about / size, mean / size


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def bags(documents: DataFrame) -> DataFrame:
    """(i, lengths, slots): the sentences of each document as slots, 4 bytes each; each text is read once, and the table, which
    is kept in the shared folder, is what all rounds work on. documents: doc_id, text; null texts are left out."""
    docs = documents.select(F.col("doc_id").alias("i"), F.col("text").alias("t")).where("t is not null")
    schema = T.StructType([docs.schema["i"], T.StructField("lengths", T.BinaryType()), T.StructField("slots", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = size = 0
            for end in range(1, batch.num_rows + 1):
                size += len(batch.column("t")[end - 1].as_py())
                if size >= 1_000_000 or end == batch.num_rows:
                    bag = Bag.of(batch.column("t").slice(at, end - at).to_pylist())
                    lengths, slots = bag.lengths().astype(np.int32), bag.slots.astype(np.int32)
                    first = np.searchsorted(bag.owner, np.arange(end - at + 1))
                    edge = np.append(bag.starts, len(slots))[first]
                    cut = lambda x, e: pa.array([x[a:b].tobytes() for a, b in zip(e, e[1:])], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column("i").slice(at, end - at), cut(lengths, first), cut(slots, edge)], names=["i", "lengths", "slots"])
                    at, size = end, 0

    folder = scratch(docs.sparkSession, "bags")
    docs.mapInArrow(run, schema).write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(schema).parquet(folder)


def _read(batches: Iterator[pa.RecordBatch], size: int = 4_000_000) -> Iterator[tuple[list, Bag]]:
    """Ids and sentences of batches of bags, some million slots at a time."""
    ids, lengths, slots, held = [], [], [], 0
    for batch in batches:
        for i, a, b in zip(batch.column("i").to_pylist(), batch.column("lengths").to_pylist(), batch.column("slots").to_pylist()):
            ids.append(i)
            lengths.append(a)
            slots.append(b)
            held += len(b)
            if held >= size:
                yield ids, Bag.packed(lengths, slots)
                ids, lengths, slots, held = [], [], [], 0
    if ids:
        yield ids, Bag.packed(lengths, slots)


def labels(df: DataFrame, subjects: Sequence[str], max_labelled: int) -> dict:
    """(fold, subjects that anybody named, as numbers) of at most max_labelled documents, by hash of the id."""
    name = F.regexp_replace(F.lower(F.btrim("subject")), r"[\s-]+", "_")
    known = df.select("doc_id", name.alias("subject")).where("doc_id is not null").where(F.col("subject").isin(*subjects))
    rows = known.groupBy("doc_id").agg(F.collect_set("subject").alias("s")).orderBy(F.xxhash64("doc_id")).limit(max_labelled)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS))
    return {r["doc_id"]: (r["fold"], sorted(subjects.index(s) for s in r["s"])) for r in rows.withColumn("fold", fold).collect()}


def _counted(docs: DataFrame, n_subjects: int, rows_of) -> np.ndarray:
    """Sum over all sentences of docs, a table of bags, of the rows that rows_of(ids, bag) gives them, by slot."""
    names = [f"c{k}" for k in range(n_subjects + 1)]
    schema = T.StructType([T.StructField("slot", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << HASH_BITS, n_subjects + 1))
        for ids, bag in _read(batches):
            if len(bag.starts):
                bag.add_to(total, rows_of(ids, bag))
        used = np.nonzero(total.any(axis=1))[0]
        for at in range(0, len(used), 20_000):
            part = used[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *[pa.array(total[part, c]) for c in range(n_subjects + 1)]], names=["slot", *names])

    sums = docs.mapInArrow(run, schema).groupBy("slot").agg(*[F.sum(c).alias(c) for c in names])
    table = sums.toArrow()
    out = np.zeros((1 << HASH_BITS, n_subjects + 1))
    out[table["slot"].to_numpy()] = np.stack([table[c].to_numpy() for c in names], axis=1)
    return out


def fit(documents: DataFrame, labelled: DataFrame, subjects: Sequence[str], rounds: int = 2, none_at: float = 4.0, max_labelled: int = 20_000) -> Model | None:
    """documents: doc_id, text, or their bags; labelled: doc_id, subject. None without usable labels."""
    subjects = sorted(subjects)
    n = len(subjects)
    spark = documents.sparkSession
    known = labels(labelled, subjects, max_labelled)
    if not known:
        return None
    shared = spark.sparkContext.broadcast(known)
    docs = documents if "slots" in documents.columns else bags(documents)
    # at most max_labelled ids
    few = spark.createDataFrame([(i,) for i in known], docs.select("i").schema)
    own = docs.join(F.broadcast(few), "i", "left_semi")

    def named(ids: list, bag: Bag, held: bool = False) -> np.ndarray:
        """1 for the subjects a sentence's document is labelled with; the labels of the first two folds count where held."""
        rows = np.ones((len(ids), n))
        for k, i in enumerate(ids):
            s = shared.value.get(i)
            if s is not None and (held or s[0] > 1):
                rows[k] = 0
                rows[k, s[1]] = 1
        return rows[bag.owner]

    def first(ids: list, bag: Bag) -> np.ndarray:
        rows = named(ids, bag)
        blind = rows.all(axis=1)  # a held-out document's sentences teach nothing yet
        rows = np.concatenate([rows / rows.sum(axis=1, keepdims=True), np.zeros((len(rows), 1))], axis=1)
        rows[blind] = np.eye(n + 1)[n]
        return rows

    trained = docs.join(F.broadcast(spark.createDataFrame([(i,) for i, s in known.items() if s[0] > 1], few.schema)), "i", "left_semi")
    model = Model.of(subjects, _counted(trained, n, first), none_at)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def expected(ids: list, bag: Bag, sent=sent) -> np.ndarray:
            return posteriors(sent.value.scores(bag), named(ids, bag), none_at)

        model = Model.of(subjects, _counted(docs, n, expected), none_at)
        sent.destroy()
    curves = calibrated(own, model, named, known)

    def everything(ids: list, bag: Bag, sent=spark.sparkContext.broadcast(model)) -> np.ndarray:
        return posteriors(sent.value.scores(bag), named(ids, bag, held=True), none_at)

    # once calibrated, the held-out labels teach as well
    final = Model.of(subjects, _counted(docs, n, everything), none_at)
    return replace(curves, weights=final.weights, priors=final.priors)


def calibrated(own: DataFrame, model: Model, named, known: dict) -> Model:
    """The model with logistic curves fitted on labelled documents that did not train it: for sentences by histograms of
    their scores against the posteriors that the labels leave, for documents against the labels themselves."""
    n, edge, step = len(model.subjects), 20, 0.25
    bins = int(2 * edge / step) + 1
    spark = own.sparkSession
    sent, folds = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast({i: s[0] for i, s in known.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, n, bins))
        for ids, bag in _read(batches):
            score = sent.value.scores(bag)
            p = posteriors(score, named(ids, bag, held=True), sent.value.none_at)
            use = np.array([folds.value[i] == 0 for i in ids], bool)[bag.owner]
            at = np.rint((np.clip(score, -edge, edge) + edge) / step).astype(int)[use]
            for k in range(n):
                total[0, k] += np.bincount(at[:, k], minlength=bins)
                total[1, k] += np.bincount(at[:, k], p[use, k], bins)
        k, at = np.nonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[0, k, at]), pa.array(total[1, k, at])], names=["k", "at", "n", "yes"])

    rows = own.mapInArrow(run, "k int, at int, n double, yes double").groupBy("k", "at").agg(F.sum("n").alias("n"), F.sum("yes").alias("yes")).collect()
    slope, offset = np.ones(n), np.full(n, -model.none_at)
    for k in range(n):
        mine = [r for r in rows if r["k"] == k]
        if mine:
            slope[k], offset[k] = platt(np.array([r["at"] * step - edge for r in mine]), np.array([r["n"] for r in mine]), np.array([r["yes"] for r in mine]), model.none_at)
    model = replace(model, slope=slope, offset=offset)
    again = spark.sparkContext.broadcast(model)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, bag in _read(batches):
            use = [j for j, i in enumerate(ids) if folds.value[i] < 2]
            if use:
                mean = again.value.judge(bag, len(ids))[1][use]
                yield pa.RecordBatch.from_arrays([pa.array([ids[j] for j in use], own_type), pa.array(list(mean), pa.list_(pa.float64()))], names=["i", "mean"])

    from pyspark.sql.pandas.types import to_arrow_type

    own_type = to_arrow_type(own.schema["i"].dataType)
    # two tenths of at most max_labelled documents
    held = own.mapInArrow(means, T.StructType([own.schema["i"], T.StructField("mean", T.ArrayType(T.DoubleType()))])).collect()
    mean = np.array([r["mean"] for r in held]).reshape(-1, n)
    truth = np.zeros((len(held), n))
    for j, r in enumerate(held):
        truth[j, known[r["i"]][1]] = 1
    measures = np.array([known[r["i"]][0] == 1 for r in held], bool)
    whole = model.whole.copy()
    for k in range(n):
        if (~measures).any():
            whole[k] = platt(logit(mean[~measures, k]), np.ones((~measures).sum()), truth[~measures, k], 0.0)
    model = replace(model, whole=whole)
    p, y = model.posterior(mean[measures]), truth[measures]
    report = [(s, int(measures.sum()), int(y[:, k].sum()), float(p[:, k].mean()), float(((p[:, k] - y[:, k]) ** 2).mean())) for k, s in enumerate(model.subjects)] if measures.any() else []
    return replace(model, report=report)


def reliability(model: Model | None, spark: SparkSession) -> DataFrame:
    """(subject, n_documents, n_labelled, mean_posterior, brier) on the labelled documents kept back to measure calibration."""
    return spark.createDataFrame(model.report if model else [], "subject string, n_documents bigint, n_labelled bigint, mean_posterior double, brier double")


def assign(documents: DataFrame, model: Model | None, share: float = 0.25) -> DataFrame:
    """(doc_id, subject, share, posterior): subjects that at least `share` of a document's sentences are about, and the
    calibrated probability that the document would be labelled so. documents: doc_id, text, or their bags."""
    docs = documents if "slots" in documents.columns else documents.select("doc_id", "text")
    own = docs.schema["i" if "slots" in docs.columns else "doc_id"]
    schema = T.StructType([T.StructField("doc_id", own.dataType), T.StructField("subject", T.StringType()), T.StructField("share", T.DoubleType()), T.StructField("posterior", T.DoubleType())])
    if model is None:
        return documents.sparkSession.createDataFrame([], schema)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(sent.value.subjects, object)
        for batch in batches:
            kind = batch.schema.field("i").type
            for ids, bag in _read(iter([batch])):
                about, mean = sent.value.judge(bag, len(ids))
                p = sent.value.posterior(mean)
                d, k = np.nonzero(about >= share - 1e-9)
                if len(d):
                    yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in d], kind), pa.array(names[k], pa.string()), pa.array(about[d, k]), pa.array(p[d, k])], names=schema.names)

    return (docs if "slots" in docs.columns else bags(docs)).mapInArrow(run, schema)

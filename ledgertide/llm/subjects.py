"""Subject areas of documents from a latent Dirichlet topic model fitted on labelled documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgertide.operators.storage import written

#: The model is fitted on at most so many labelled documents, those with the smallest hash of their id.
MAX_LABELLED = 20_000
#: At most so many subjects; the list is held by the driver and by every task.
MAX_SUBJECTS = 1_000
#: Topics per subject, and topics that belong to none.
TOPICS_PER_SUBJECT, OTHER_TOPICS = 4, 4
#: A term is used if so many labelled documents hold it and this share of them has the same subject.
MIN_DOCUMENTS, MIN_PEAK, SMOOTHING = 2, 0.4, 1.5
#: Passes over the labelled documents; inner steps per document in a pass and when subjects are assigned.
PASSES, INNER, FINAL = 20, 5, 10
#: Dirichlet weights of topics in a document and of terms in a topic; what other subjects' topics may hold of
#: a labelled document, as labels are at times wrong.
ALPHA, ETA, LEAK = 0.05, 0.01, 0.02
#: A topic belongs to the subject that has this share of the evidence of its top terms, else to none.
TOP_TERMS, MIN_EVIDENCE = 20, 0.3
#: A document belongs to each subject with this share of its proportions, and to the one with the largest.
MIN_SHARE = 0.15
#: Terms remembered by spelling in a task, then forgotten; only speed depends on it.
REMEMBERED = 300_000

# What is taken off both ends of a word.
MARKS = ".,;:()[]{}\"'“”«»!?/\\-–—*#=+<>0123456789%"


def term(word: str) -> str:
    """A word as a term: lower case, without marks around it or an elided article before it; '' if too short."""
    word = word.strip(MARKS).lower()
    if "'" in word:
        word = word.rsplit("'", 1)[1]
    return word if len(word) > 2 else ""


@dataclass
class SubjectModel:
    subjects: list[str]
    terms: list[str]
    topics: np.ndarray  #: topic x term, the terms' shares of each topic
    subject_of: np.ndarray  #: per topic the place in ``subjects``, -1 for none
    prior: np.ndarray  #: share of each subject among the labelled documents

    def top_terms(self, count: int = 10) -> list[tuple[str | None, list[str]]]:
        """Each topic's subject and first terms, to be looked through."""
        order = np.argsort(-self.topics, axis=1)[:, :count]
        return [(self.subjects[s] if s >= 0 else None, [self.terms[t] for t in row]) for s, row in zip(self.subject_of, order)]


class _Known(dict):
    """A function of a word, computed once per spelling."""

    def __init__(self, function) -> None:
        self.function = function

    def __missing__(self, word: str):
        value = self.function(word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value
        return value


def _code(subject: Column) -> Column:
    return F.lower(F.btrim(subject))


def fit(documents: DataFrame, labels: DataFrame, areas: DataFrame, doc_id: str = "doc_id", text: str = "text") -> SubjectModel:
    """Fit topics on labelled documents and map them to subjects.

    ``labels`` (``doc_id``, ``subject``) is read in any letter case, without repeats; labels that are no
    code in ``areas.subject`` are left out. Of the labelled documents at most ``MAX_LABELLED`` take part,
    chosen by hash; their words are counted once into a table that each pass reads.

    Each subject has ``TOPICS_PER_SUBJECT`` topics, and ``OTHER_TOPICS`` more take what belongs to none
    and never get a subject; a labelled document draws on the topics of its labels and on the others. A
    pass is a job: each task runs the variational step for its documents under the topics of the last
    pass, which are broadcast, and gives a row of expected term counts per topic; the rows of a topic are
    added up by one task, so that the driver gets one row per topic, however many tasks there are. What is
    broadcast has the size of the model: topics times terms, four bytes each. Afterwards the ``TOP_TERMS``
    of each subject topic are inspected: each term speaks for the subjects of the labelled documents that
    hold it, in proportion, and the topic goes to the subject with most of that evidence, be it the one it
    began with or not, if it has ``MIN_EVIDENCE`` of it.

    Without labelled documents the model has no terms, and without areas no subjects.
    """
    subjects = [r[0] for r in areas.select(_code(F.col("subject")).alias("s")).where("s is not null").distinct().orderBy("s").limit(MAX_SUBJECTS + 1).collect()]
    if len(subjects) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    place = {s: i for i, s in enumerate(subjects)}
    known = labels.select(F.col("doc_id").alias("label_id"), _code(F.col("subject")).alias("s")).where(F.col("s").isin(subjects) & F.col("label_id").isNotNull())
    sample = known.groupBy("label_id").agg(F.sort_array(F.collect_set("s")).alias("labels")).orderBy(F.xxhash64("label_id"), "label_id").limit(MAX_LABELLED)
    rows = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    rows = rows.join(F.broadcast(sample), F.col("id") == F.col("label_id")).groupBy("id", "labels").agg(F.min("text").alias("text"))
    bags = written(rows.mapInArrow(_bags, "labels array<string>, terms array<string>, counts array<int>"), "bags")

    totals = bags.select(F.explode("labels").alias("s"), (1 / F.size("labels")).alias("w")).groupBy("s").agg(F.sum("w").alias("w")).collect()
    prior = np.full(max(1, len(subjects)), 1e-9)
    for r in totals:
        prior[place[r.s]] += r.w
    prior /= prior.sum()
    terms, spread = _vocabulary(bags, subjects, prior)
    leaning, weight = (spread + SMOOTHING * prior) / (spread.sum(1, keepdims=True) + SMOOTHING), spread.sum(1)
    if not terms:
        return SubjectModel(subjects, [], np.zeros((0, 0), np.float32), np.zeros(0, np.int64), prior)

    rng = np.random.default_rng(1)
    count = TOPICS_PER_SUBJECT * len(subjects)
    topics = rng.gamma(1.0, 1.0, (count + OTHER_TOPICS, len(terms))) * weight
    topics[:count] *= np.repeat(leaning.T, TOPICS_PER_SUBJECT, axis=0)
    topics /= topics.sum(1, keepdims=True)
    for _ in range(PASSES):
        sent = bags.sparkSession.sparkContext.broadcast((topics.astype(np.float32), terms))
        sums = bags.mapInArrow(_pass_over(sent, place), _ROWS).groupBy("topic").applyInArrow(_added, _ROWS).collect()
        sent.unpersist()
        topics = np.full(topics.shape, ETA)
        for r in sums:
            topics[r.topic] += np.frombuffer(r.counts, np.float64)
        topics /= topics.sum(1, keepdims=True)

    top = np.argsort(-topics[:count], axis=1)[:, :TOP_TERMS]
    spoken = np.stack([(topics[k, t][:, None] * leaning[t]).sum(0) / topics[k, t].sum() for k, t in enumerate(top)])
    subject_of = np.full(len(topics), -1)
    subject_of[:count] = np.where(spoken.max(1) >= MIN_EVIDENCE, spoken.argmax(1), -1)
    return SubjectModel(subjects, terms, topics.astype(np.float32), subject_of, prior)


def _vocabulary(bags: DataFrame, subjects: list[str], prior: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The terms that ``MIN_DOCUMENTS`` labelled documents hold and of whose evidence one subject has ``MIN_PEAK``, and that evidence.

    They are chosen where they are counted; only the chosen ones come to the driver.
    """
    known = F.broadcast(bags.sparkSession.createDataFrame([(s, i, float(p)) for i, (s, p) in enumerate(zip(subjects, prior))], "s string, at int, prior double"))
    shares = bags.select(F.explode("terms").alias("term"), "labels").select("term", F.explode("labels").alias("s"), (1 / F.size("labels")).alias("w"))
    each = shares.groupBy("term", "s").agg(F.sum("w").alias("w")).join(known, "s")
    by_term = each.groupBy("term").agg(F.sum("w").alias("n"), F.collect_list(F.struct("at", "w")).alias("by"), F.max(F.col("w") + SMOOTHING * F.col("prior")).alias("most"))
    peak = F.greatest("most", F.lit(SMOOTHING * float(prior.max()))) / (F.col("n") + SMOOTHING)
    found = by_term.where((F.col("n") > MIN_DOCUMENTS - 0.5) & (peak >= MIN_PEAK)).orderBy("term").collect()
    spread = np.zeros((len(found), max(1, len(subjects))))
    for i, r in enumerate(found):
        for x in r.by:
            spread[i, x.at] = x.w
    return [r.term for r in found], spread


_ROWS = "topic int, counts binary"


def _added(rows: pa.Table) -> pa.Table:
    """The sum of the count rows of one topic."""
    total = np.sum([np.frombuffer(c.as_buffer(), np.float64) for c in rows.column("counts")], axis=0)
    return pa.table({"topic": rows.column("topic")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of each text with their counts."""
    from collections import Counter

    known = _Known(term)
    for b in batches:
        bags = [Counter(map(known.__getitem__, t.split())) for t in b.column("text").to_pylist()]
        for bag in bags:
            bag.pop("", None)
        yield pa.RecordBatch.from_arrays(
            [b.column("labels"), pa.array([list(x) for x in bags], pa.list_(pa.string())), pa.array([list(x.values()) for x in bags], pa.list_(pa.int32()))],
            names=["labels", "terms", "counts"],
        )


def _pass_over(sent: Broadcast, place: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topics, terms = sent.value
        index = {t: i for i, t in enumerate(terms)}
        total = np.zeros(topics.shape)
        for b in batches:
            labels, names = b.column("labels"), b.column("terms")
            ids = np.fromiter((index.get(t, -1) for t in names.values.to_pylist()), np.int64, len(names.values))
            counts = b.column("counts").values.to_numpy().astype(np.float32)
            doc = np.repeat(np.arange(b.num_rows), np.diff(names.offsets.to_numpy()))
            used = ids >= 0
            if not used.any():
                continue
            allowed = np.ones((b.num_rows, len(topics)), np.float32)
            own = np.full((b.num_rows, len(place)), LEAK, np.float32)
            for i, ls in enumerate(labels.to_pylist()):
                own[i, [place[s] for s in ls]] = 1
            allowed[:, : TOPICS_PER_SUBJECT * len(place)] = np.repeat(own, TOPICS_PER_SUBJECT, axis=1)
            _, shares = proportions(doc[used], ids[used], counts[used], b.num_rows, topics, INNER, allowed)
            for k in range(len(topics)):
                total[k] += np.bincount(ids[used], shares[:, k], topics.shape[1])
        rows = [pa.array(range(len(total)), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())]
        yield pa.RecordBatch.from_arrays(rows, names=["topic", "counts"])

    return run


def proportions(
    doc: np.ndarray, ids: np.ndarray, counts: np.ndarray, documents: int, topics: np.ndarray, steps: int, allowed: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens of each topic in each document, and of each topic in each (document, term) entry.

    ``doc`` ascends. Fixed-point steps of a document's topic proportions under given topics.
    """
    weight = np.full((documents, len(topics)), 1 / len(topics), np.float32)
    if allowed is not None:
        weight *= allowed
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    here = doc[starts]
    by_term = topics.T[ids]
    expected = np.zeros_like(weight)
    for _ in range(steps):
        shares = weight[doc]
        shares *= by_term
        shares *= (counts / np.maximum(shares.sum(1), 1e-30))[:, None]
        expected[here] = np.add.reduceat(shares, starts, axis=0)
        weight = expected + np.float32(ALPHA)
        if allowed is not None:
            weight *= allowed
        weight /= weight.sum(1, keepdims=True)
    return expected, shares


def assign(documents: DataFrame, model: SubjectModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(<doc_id>, subject)``: the subjects of each document, one at least.

    One pass over the texts without a shuffle: the terms of a text give its topic proportions; those of
    the topics of a subject add up to the subject's, as shares of all topics that have a subject. A
    document has every subject with ``MIN_SHARE`` or more and the one with the largest share. Texts that
    are null, empty or without any known term get the most frequent subject of the labelled documents.
    Each row is judged by itself, repeated ``doc_id`` too, and a null ``doc_id`` stays null. A model
    without subjects gives no rows. Extra columns are not looked at.
    """
    rows = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        index = {t: i for i, t in enumerate(model.terms)}
        known = _Known(lambda word: index.get(term(word), -1))
        member = np.zeros((len(model.topics), len(model.subjects)), np.float32)
        has = np.flatnonzero(model.subject_of >= 0)
        member[has, model.subject_of[has]] = 1
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                found = [np.unique(_ids(known, t), return_counts=True) if t else (np.zeros(0, np.int64),) * 2 for t in b.column("text").to_pylist()]
                doc = np.repeat(np.arange(b.num_rows), [len(i) for i, _ in found])
                share = np.tile(model.prior.astype(np.float32), (b.num_rows, 1))[:, : len(model.subjects)]
                if len(doc):
                    ids, counts = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                    expected, _ = proportions(doc, ids, counts.astype(np.float32), b.num_rows, model.topics, FINAL)
                    sums = expected @ member
                    total = sums.sum(1, keepdims=True)
                    share = np.where(total > 0, sums / np.maximum(total, 1e-9), share)
                if not share.shape[1]:
                    continue
                chosen = share >= MIN_SHARE
                unknown = np.ones(b.num_rows, bool)
                unknown[doc] = False
                chosen[unknown] = False
                chosen[np.arange(b.num_rows), share.argmax(1)] = True
                row, subject = np.nonzero(chosen)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(row)), pa.array([model.subjects[s] for s in subject], pa.string())], names=["id", "subject"]
                )

    return rows.mapInArrow(run, f"id {kind}, subject string").withColumnRenamed("id", doc_id)


def _ids(known: _Known, text: str) -> np.ndarray:
    ids = np.fromiter(map(known.__getitem__, text.split()), np.int64)
    return ids[ids >= 0]

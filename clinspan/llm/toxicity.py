"""Toxicity: a linear-chain conditional random field that tags toxic spans.

Labels are given by document. Token labels come from them: a feature of words (the word, its beginnings and ends) whose
rate of use in toxic training documents is many times its rate in clean ones marks the words of toxic documents that have
it; all words of clean documents are outside, also those with such a feature. On these labelled tokens a chain of two
states (outside, toxic) is fitted by its penalised likelihood. Forward-backward marginals then give each word's
probability in its context; they aggregate to a document's score (a logistic function of their noisy-or, sum and share
over distinct words, fitted on a third of the sample that the chain hasn't seen) and to the offsets of the words at fault.

The model is fitted by the driver on a bounded sample of labelled rows (``Settings.documents`` of each label, of at most
``Settings.chars`` code points each) and broadcast; scoring maps over whole texts without a shuffle. Inputs of a score are
the text's words alone.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import id_and_text, read_table

#: Longer runs of letters (text without blanks) are tagged piece by piece; underscores part words as blanks do.
WORD_CHARS = 40
TOKEN = re.compile(rf"[^\W_]{{1,{WORD_CHARS}}}")
#: Word scores that a worker keeps, and tokens that are tagged at once.
CACHE_ENTRIES, BATCH_TOKENS = 500_000, 1_000_000
SPAN_LEVEL = 0.5
#: Smaller marginals don't count for a document.
LEAST_MARGINAL = 0.02

SCORE_SCHEMA = "doc_id long, score double, predicted int, n_tokens long, n_toxic long, spans array<struct<start:int,end:int,probability:double>>"


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample and of the fit."""

    documents: int = 1200
    chars: int = 20_000
    most_ids: int = 1_000_000  # ids of a label that are asked for texts at most, should most of them lack a fit one
    least_documents: int = 4
    rate_ratio: float = 4.0
    penalty: float = 0.02
    rounds: int = 60
    rate: float = 0.3


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]  # a feature's score of toxic against outside
    bias: float
    start: float  # toxic against outside at the first word
    steps: tuple[float, float, float]  # outside to toxic, toxic to outside, toxic to toxic, against outside to outside
    link: tuple[float, ...]  # of document features; the first is the constant


def lowered(text: str) -> str:
    """text in lower case, code point by code point: U+0130, whose lower case is two, becomes i."""
    return text.replace("\u0130", "i").lower()


def features(word: str) -> list[str]:
    out = [f"w{word}"]
    out += [f"p{word[:n]}" for n in range(3, 8) if len(word) >= n]
    out += [f"s{word[-n:]}" for n in (3, 4, 5) if len(word) > n]
    return out


# Chains of several documents, packed: step t holds word t of those documents that have one, longest documents first.


class Packed:
    def __init__(self, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        self.sizes = lengths[order]
        longest = int(self.sizes[0]) if len(lengths) else 0
        self.active = np.searchsorted(-self.sizes, -np.arange(longest), side="left")  # documents longer than t
        self.begin = np.concatenate([[0], np.cumsum(self.active)])
        rank = np.empty(len(lengths), dtype=np.int64)
        rank[order] = np.arange(len(lengths))
        first = np.cumsum(lengths) - lengths
        step = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        self.place = self.begin[step] + np.repeat(rank, lengths)
        self.ends = self.sizes[self.sizes > 0] - 1


def marginals(odds: np.ndarray, chain: Packed, start: float, steps: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """odds: score of toxic against outside of each word, packed. Returns P(toxic) packed, the expected numbers of the
    three kinds of steps, the log of the sums over all tag sequences, and P(toxic) of first words.

    Forward and backward values are kept as log odds and, for the sum, one log scale each, so long texts do not overflow.
    """
    ot, to, tt = steps
    n = len(odds)
    forward, backward = np.empty(n), np.empty(n)
    longest = len(chain.active)
    total = 0.0
    if not longest:
        return forward, np.zeros(3), total, np.zeros(0)
    k = chain.active[0]
    last = start + odds[:k]
    forward[:k] = last
    scale = np.zeros(k)  # log forward value of outside
    for t in range(1, longest):
        k = chain.active[t]
        at = chain.begin[t]
        before = last[:k]
        outside = np.logaddexp(0.0, before + to)
        last = np.logaddexp(ot, before + tt) - outside + odds[at : at + k]
        forward[at : at + k] = last
        scale[:k] += outside
    final = np.empty(chain.active[0])
    final[:] = forward[chain.begin[chain.ends] + np.arange(len(chain.ends))]
    total = float((scale + np.logaddexp(0.0, final)).sum())
    expected = np.zeros(3)
    later = np.zeros(0)
    for t in range(longest - 1, -1, -1):
        k, at = chain.active[t], chain.begin[t]
        here = np.zeros(k)
        if len(later):
            m = len(later)
            nxt = later + odds[chain.begin[t + 1] : chain.begin[t + 1] + m]
            outside = np.logaddexp(0.0, ot + nxt)
            here[:m] = np.logaddexp(to, tt + nxt) - outside
            f = forward[at : at + m]
            # Joint weights of two neighbours against outside-outside.
            joint = np.stack([np.zeros(m), ot + nxt, f + to, f + tt + nxt])
            joint = np.exp(joint - joint.max(axis=0))
            expected += (joint / joint.sum(axis=0))[1:].sum(axis=1)
        backward[at : at + k] = here
        later = here
    tox = _sigmoid(forward + backward)
    return tox, expected, total, tox[: chain.active[0]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def signature(words: list[str]) -> tuple[int, ...]:
    """The four smallest hashes of a text's words: alike for its copies, near ones mostly too."""
    return tuple(sorted(zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in set(words))[:4])


def weak_labels(texts: list[list[str]], toxic: list[int], least_documents: int, rate_ratio: float) -> list[np.ndarray]:
    """1 for the words of toxic documents that have a telling feature: one in at least least_documents of them whose rate
    (documents that have it, for all their words) is rate_ratio times that in clean ones, by cautious bounds of both."""
    having = (Counter(), Counter())
    totals = [1, 1]
    of_word: dict[str, list[str]] = {}
    for words, label in zip(texts, toxic, strict=True):
        totals[label] += len(words)
        having[label].update({f for w in set(words) for f in of_word.setdefault(w, features(w))})
    marks = set()
    for f, n in having[1].items():
        if n >= least_documents:
            clean = having[0][f]
            low, high = n - n**0.5, clean + (clean + 1) ** 0.5
            if low / totals[1] >= rate_ratio * high / totals[0]:
                marks.add(f)
    known = {w: any(f in marks for f in fs) for w, fs in of_word.items()}
    return [np.array([known[w] for w in words] if label else [0] * len(words), dtype=np.int8) for words, label in zip(texts, toxic, strict=True)]


def document_features(texts: list[list[str]], tox: np.ndarray) -> np.ndarray:
    """Constant, noisy-or as log odds, log of the expected toxic words, log of their share; one row per document. Each
    distinct word counts once, by its largest marginal, so a text that repeats one word says no more than the word."""
    out = np.zeros((len(texts), 4))
    out[:, 0] = 1
    at = 0
    for k, words in enumerate(texts):
        part = tox[at : at + len(words)]
        at += len(words)
        best: dict[str, float] = {}
        for i in np.flatnonzero(part > LEAST_MARGINAL).tolist():
            best[words[i]] = max(best.get(words[i], 0.0), part[i])
        p = np.minimum(np.array(list(best.values())), 1 - 1e-9)
        none, mass = np.log1p(-p).sum(), p.sum()
        out[k, 1] = np.clip(np.log(-np.expm1(min(none, -1e-9))) - none, -8, 8)
        out[k, 2] = np.log(mass + 0.1)
        out[k, 3] = np.log((mass + 0.1) / (len(set(words)) + 20))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Newton's method on weighted rows with an L2 penalty; the constant is free."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(30):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[str, int]], settings: Settings = Settings(), population: tuple[int, int] | None = None) -> Model:
    """rows: (text, toxic 0 or 1). population: how many rows of each label the sample stands for; scores follow these
    rates. With one label only, every score is that label's rate, drawn a little to the middle."""
    labels = np.array([y for _, y in rows], dtype=np.int64)
    if not len(rows) or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(rows) + 2.0) if len(rows) else 0.25
        return Model({}, -20.0, -5.0, (-5.0, 0.0, 0.0), (float(np.log(share / (1 - share))), 0.0, 0.0, 0.0))
    shared: dict[str, str] = {}  # one string for each word, however often it occurs
    texts = [[shared.setdefault(w, w) for w in TOKEN.findall(lowered(t))] for t, _ in rows]
    del shared
    first_of: dict[tuple[int, ...], int] = {}
    for i, t in enumerate(texts):
        first_of.setdefault(signature(t), i)
    chosen = sorted(first_of.values())  # copies of a text would pass for many texts that share its words
    # Every third text is kept for the document score, since marginals are too sure on the texts that the chain has learnt.
    judged = chosen[2::3]
    chosen = [i for k, i in enumerate(chosen) if k % 3 != 2]
    judged_texts, judged_labels = [texts[i] for i in judged], labels[judged]
    texts, labels = [texts[i] for i in chosen], labels[chosen]
    tags = weak_labels(texts, labels.tolist(), settings.least_documents, settings.rate_ratio)
    lengths = np.array([len(t) for t in texts])
    vocabulary: dict[str, int] = {}
    word_of = np.array([vocabulary.setdefault(w, len(vocabulary)) for t in texts for w in t], dtype=np.int64)
    counts: Counter = Counter()
    n_word = np.bincount(word_of, minlength=len(vocabulary))
    of_word = [features(w) for w in vocabulary]
    for fs, n in zip(of_word, n_word.tolist(), strict=True):
        for f in fs:
            counts[f] += n
    names = {f: i for i, f in enumerate(f for f, n in counts.items() if n >= settings.least_documents)}
    pairs = np.array([(w, names[f]) for w, fs in enumerate(of_word) for f in fs if f in names], dtype=np.int64).reshape(-1, 2)
    chain = Packed(lengths)
    y = np.empty(len(word_of))
    y[chain.place] = np.concatenate(tags) if len(tags) else []
    word_packed = np.empty(len(word_of), dtype=np.int64)
    word_packed[chain.place] = word_of
    # Observed steps, and the parameters as one vector: feature weights, bias, start, three steps.
    seen = np.zeros(3)
    for tag in tags:
        a, b = tag[:-1], tag[1:]
        seen += [((a == 0) & (b == 1)).sum(), ((a == 1) & (b == 0)).sum(), ((a == 1) & (b == 1)).sum()]
    first_seen = float(sum(t[0] for t in tags if len(t)))
    theta = np.zeros(len(names) + 5)
    theta[len(names)], theta[len(names) + 1 :] = -4.0, (-1.0, -1.0, 0.0, 0.0)
    moment, spread = np.zeros_like(theta), np.zeros_like(theta)
    for r in range(1, settings.rounds + 1):
        by_word = np.bincount(pairs[:, 0], weights=theta[pairs[:, 1]], minlength=len(vocabulary))
        tox, expected, _, first = marginals(by_word[word_packed] + theta[len(names)], chain, theta[len(names) + 1], tuple(theta[len(names) + 2 :]))
        left = np.bincount(word_packed, weights=y - tox, minlength=len(vocabulary))
        grad = np.concatenate([np.bincount(pairs[:, 1], weights=left[pairs[:, 0]], minlength=len(names)), [(y - tox).sum(), first_seen - first.sum()], seen - expected])
        grad -= settings.penalty * theta
        moment, spread = 0.9 * moment + 0.1 * grad, 0.99 * spread + 0.01 * grad**2
        theta += settings.rate * (1 - r / (settings.rounds + 1)) * (moment / (1 - 0.9**r)) / (np.sqrt(spread / (1 - 0.99**r)) + 1e-3)
    weights = {f: float(theta[i]) for f, i in names.items() if abs(theta[i]) > 1e-3}
    model = Model(weights, float(theta[len(names)]), float(theta[len(names) + 1]), tuple(map(float, theta[len(names) + 2 :])), ())
    if len(set(judged_labels.tolist())) < 2:  # too few for a part of their own
        judged_texts, judged_labels = texts, labels
    tox, _ = Tagger(model).tag_words(judged_texts)
    sampled = np.bincount(judged_labels, minlength=2)
    shares = np.array(population if population and min(population) else sampled, dtype=float)
    weight = (shares / shares.sum() * len(judged_labels) / np.maximum(sampled, 1))[judged_labels]
    link = _logistic(document_features(judged_texts, tox), judged_labels.astype(float), weight)
    return Model(model.weights, model.bias, model.start, model.steps, tuple(map(float, link)))


class Tagger:
    """A model with the scores of the words that this worker has met."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def _odds(self, words: list[str]) -> list[float]:
        try:
            return list(map(self.known.__getitem__, words))
        except KeyError:
            pass
        if len(self.known) > CACHE_ENTRIES:
            self.known = {}
        known, weights, bias, local = self.known, self.model.weights, self.model.bias, {}
        for w in set(words):
            if w not in known:
                local[w] = bias + sum(weights.get(f, 0.0) for f in features(w))
        known.update(local)
        return list(map(known.__getitem__, words))

    def tag_words(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(P(toxic) of all words of all texts one after another, words of each text)."""
        odds = [self._odds(w) for w in words]
        lengths = np.array([len(o) for o in odds], dtype=np.int64)
        chain = Packed(lengths)
        packed = np.empty(int(lengths.sum()))
        packed[chain.place] = np.concatenate(odds) if len(odds) else []
        return marginals(packed, chain, self.model.start, self.model.steps)[0][chain.place], lengths

    def tag(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As tag_words, and the texts' scores."""
        words = [TOKEN.findall(lowered(t)) for t in texts]
        tox, lengths = self.tag_words(words)
        return tox, lengths, _sigmoid(document_features(words, tox) @ np.array(self.model.link))


def offending(text: str, tox: np.ndarray, level: float = SPAN_LEVEL) -> list[dict]:
    """Code points of the words whose marginal reaches level; neighbours as one span with the largest marginal."""
    marked = np.flatnonzero(tox >= level)
    if not len(marked):
        return []
    places = [m.span() for m in TOKEN.finditer(lowered(text))]
    out, last = [], -2
    for i in marked.tolist():
        if i == last + 1:
            out[-1]["end"], out[-1]["probability"] = places[i][1], max(out[-1]["probability"], float(tox[i]))
        else:
            out.append({"start": places[i][0], "end": places[i][1], "probability": float(tox[i])})
        last = i
    return out


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[tuple[str, int]], tuple[int, int]]:
    """A bounded sample, and how many labelled rows of each label there are: of each label the settings.documents rows of the smallest hash among labelled rows whose
    crc32(doc_id as text) mod 5 is not 0 and whose text has at most settings.chars code points. An id that is repeated
    counts once, with the smallest of its texts, so that no task gets more texts than ids were asked for."""
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & ~held_out("doc_id"))
    texts = id_and_text(docs, id_col, text_col).where(F.length("text") <= settings.chars)
    hash_ = F.xxhash64("doc_id")
    counts = {r["toxic"]: (r["n"], r["ids"]) for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("ids")).collect()}
    # Twice as many ids as are wanted, since some texts are missing or too long; ids alone are sorted, then few texts join,
    # both labels' in one scan. Only where those ids don't give enough texts are more of them taken.
    asked = 2 * settings.documents
    first = Window.partitionBy("toxic").orderBy(hash_, "text")
    while True:
        each = [known.where(F.col("toxic") == label).select("doc_id", "toxic").distinct().orderBy(hash_).limit(asked) for label in (0, 1)]
        some = texts.join(F.broadcast(each[0].unionByName(each[1])), "doc_id").groupBy("toxic", "doc_id").agg(F.min("text").alias("text"))
        some = some.withColumn("_n", F.row_number().over(first))
        rows = [(r["text"], r["toxic"]) for r in some.where(F.col("_n") <= settings.documents).orderBy("toxic", "_n").select("text", "toxic").collect()]
        short = [label for label in (0, 1) if sum(y == label for _, y in rows) < settings.documents and counts.get(label, (0, 0))[1] > asked]
        if not short or asked >= settings.most_ids:
            break
        asked *= 4
    return rows, tuple(counts.get(label, (0, 0))[0] for label in (0, 1))


def _runs(texts: list[str]):
    """(first, end) of stretches of texts of a bounded number of characters, one text at least."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and chars < 6 * BATCH_TOKENS:
            chars += len(texts[end]) + 1
            end += 1
        yield at, end
        at = end


def held_out(name: str):
    return F.crc32(F.col(name).cast("string").cast("binary")) % 5 == 0


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1), predicted (score >= 0.5), n_tokens, n_toxic, spans.

    Null and empty texts have no words and the score of a text without toxic words; rows without an id and repeated rows
    are scored like others, equal texts alike; an empty table gives an empty result; other columns are ignored, whatever
    their names. Texts are read whole.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        tagger = Tagger(held.value)
        struct = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for at, end in _runs(texts):
                part = texts[at:end]
                tox, lengths, scores = tagger.tag(part)
                upto = np.cumsum(lengths)
                each = [tox[b - n : b] for b, n in zip(upto.tolist(), lengths.tolist(), strict=True)]
                scores = np.round(scores, 9)
                yield pa.RecordBatch.from_arrays([ids.slice(at, end - at), pa.array(scores), pa.array((scores >= 0.5).astype("int32")), pa.array(lengths), pa.array([int((t >= SPAN_LEVEL).sum()) for t in each], pa.int64()), pa.array([offending(x, t) for x, t in zip(part, each, strict=True)], struct)], names=["doc_id", "score", "predicted", "n_tokens", "n_toxic", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCORE_SCHEMA)


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Those rows of docs, all columns, whose score is below 0.5; null texts count as empty."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at_text = docs.columns.index(text_col)

    def run(batches):
        tagger = Tagger(held.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(at_text).to_pylist()]
            for at, end in _runs(texts):
                scores = tagger.tag(texts[at:end])[2]
                yield batch.slice(at, end - at).filter(pa.array(np.round(scores, 9) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    rows, population = training_rows(docs, labels)
    model = fit(rows, population=population)
    scored = score_documents(docs, model)
    # Offending code points as start:end, in order, comma-joined.
    places = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted", places.alias("toxic_spans"))

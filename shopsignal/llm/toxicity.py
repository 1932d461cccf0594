"""Toxicity by a support vector machine over a gapped subsequence kernel with Nystroem landmarks.

The kernel compares words by their subsequences of three characters within a span of five; a
subsequence counts DECAY to the power of its span, so inserted characters lower a match without
ending it. Words are taken without marks and digits, so i.d.i.o.t is one word, and runs of single
letters are joined. Training takes the words of labelled sentences: those much more frequent in
sentences of toxic documents are positive, words of other documents negative, the hardest of them
found in rounds. Kernel values to the landmarks, whitened by the landmarks' own kernel matrix, are
the SVM's features; words with an inserted character join the positive ones. As the machine is linear in the kernel's feature space, its decision is one
weight per subsequence. A document's score is a logistic function of its words' highest decisions,
fitted on the whole texts of documents left out of the word lists.
"""
from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopsignal.llm.common import append_columns, as_bytes, fresh_names, hash_sample, kept, materialize, steps
from shopsignal.llm.token_counts import Memory

#: lower-case letters and bytes of other characters stay, white space becomes a blank, the rest goes
FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c in b"\t\n\v\f\r" else c for c in range(256))
DROPPED = bytes(c for c in range(128) if not (65 <= c <= 90 or 97 <= c <= 122 or c in b" \t\n\v\f\r"))
SENTENCE = re.compile(r"[.!?\n]+")
DECAY = 0.6
OFFSETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
WEIGHTS = np.array([DECAY ** (j + 1) for _, j in OFFSETS], np.float32)
WIDTH = 30                       # longer words are cut into windows that overlap
START, STOP = 59, 60
TABLE = 1 << 18                  # three characters of six bits
TOXIC_DOCS, CLEAN_DOCS, SENTENCES = 2000, 4000, 60
PIECE = 2000                     # characters; longer sentences are learned from in pieces
LANDMARKS = 384
LIFT = 8.0                       # a positive word is so much more frequent in toxic documents
POSITIVE = 1500
GAIN = 24.0                      # log-likelihood ratio that makes a word positive
MEMORY_WORDS = 250_000            # words whose decisions a worker remembers, in two generations
THRESHOLD = 0.7


def words_of(text: str | None) -> list[bytes]:
    """The text's words without marks and digits; runs of three or more single letters are joined."""
    words = (text or "").lower().encode().translate(FOLD, DROPPED).split()
    single = np.fromiter(map(len, words), np.int64, len(words)) == 1
    if single.sum() < 3:
        return words
    edge = np.flatnonzero(np.diff(np.concatenate(([0], single.view(np.int8), [0]))))
    joined = [b"".join(words[a:b]) for a, b in zip(edge[::2], edge[1::2]) if b - a >= 3]
    return words + joined


def _codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (and windows of long ones) as rows of six-bit codes, with their lengths and owners."""
    owner, parts = [], []
    for i, w in enumerate(words):
        if len(w) <= WIDTH:
            owner.append(i)
            parts.append(w)
        else:
            for a in range(0, len(w) - 5, WIDTH - 6):
                owner.append(i)
                parts.append(w[a:a + WIDTH])
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.frombuffer(b"".join(parts), np.uint8)
    codes = np.where(flat >= 128, 27 + (flat & 31), flat & 31).astype(np.int32)
    out = np.zeros((len(parts), int(n.max(initial=0)) + 6), np.int32)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) + 1
    out[np.repeat(np.arange(len(parts)), n), col] = codes
    out[:, 0] = START
    out[np.arange(len(parts)), n + 1] = STOP
    return out, n + 2, np.array(owner, np.int64)


def _subsequences(codes: np.ndarray):
    """For each offset pair: table index of the subsequence at each position (0 beyond the end)."""
    m = codes.shape[1] - 4
    for (i, j), w in zip(OFFSETS, WEIGHTS):
        last = codes[:, j:j + m]
        index = (codes[:, :m] << 12) | (codes[:, i:i + m] << 6) | last
        yield np.where(last > 0, index, 0), w


def _norms(lengths: np.ndarray) -> np.ndarray:
    """Length-only norm: the root of the summed squared weights of a word's subsequences."""
    total = np.zeros(len(lengths))
    for (_, j), w in zip(OFFSETS, WEIGHTS):
        total += w * w * np.maximum(lengths - j, 0)
    return np.sqrt(np.maximum(total, 1e-9))


def kernel(words: list[bytes], others: list[bytes]) -> np.ndarray:
    """Kernel values; a word longer than WIDTH counts by its best window, an other by its first."""
    codes, n, owner = _codes(others)
    first = np.unique(owner, return_index=True)[1]
    parts = [(np.where(ix > 0, ix, 0), w / _norms(n[first])) for ix, w in _subsequences(codes[first])]
    used = np.unique(np.concatenate([[0], *(ix.ravel() for ix, _ in parts)]))
    place = np.zeros(TABLE, np.int32)
    place[used] = np.arange(len(used))
    table = np.zeros((len(used), len(others)), np.float32)
    for ix, w in parts:
        np.add.at(table, (place[ix], np.arange(len(others))[:, None]), w[:, None].astype(np.float32))
    table[0] = 0
    out = np.zeros((len(words), len(others)), np.float32)
    for a in range(0, len(words), 256):
        left, ln, lowner = _codes(words[a:a + 256])
        value = np.zeros((len(left), len(others)), np.float32)
        for ix, w in _subsequences(left):
            rows, cols = np.nonzero(place[ix])
            np.add.at(value, rows, w * table[place[ix[rows, cols]]])
        np.maximum.at(out, a + lowner, value / _norms(ln)[:, None].astype(np.float32))
    return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-6, rounds: int = 40) -> np.ndarray:
    """Squared-hinge linear SVM by Newton steps; the last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    total = weight.sum()
    for _ in range(rounds):
        slack = 1 - y * (x @ w)
        on = slack > 0
        xo, wo = x[on], weight[on] / total
        grad = ridge * w - (xo * (wo * y[on] * slack[on])[:, None]).sum(0)
        step = np.linalg.solve(ridge * np.eye(len(w)) + (xo * wo[:, None]).T @ xo, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    """``table`` and ``bias`` decide on words; ``link`` turns a document's decisions into a score."""
    table: np.ndarray
    bias: float
    link: np.ndarray

    def decide(self, words: list[bytes]) -> np.ndarray:
        out = np.full(len(words), -2.0, np.float32)
        for a in range(0, len(words), 8192):
            codes, n, owner = _codes(words[a:a + 8192])
            value = sum(self.table[ix].sum(1) * w for ix, w in _subsequences(codes)) / _norms(n) + self.bias
            np.maximum.at(out, a + owner, np.clip(value, -2, 2).astype(np.float32))
        return out

    def document(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        z = self.link[0] * first + self.link[1] * second + self.link[2]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


CONSTANT = Model(np.zeros(TABLE, np.float32), -2.0, np.array([0.0, 0.0, -60.0]))


def _landmarks(words: list[bytes], n: int) -> list[bytes]:
    """Words far from one another: each next one has the least kernel value to those taken."""
    if len(words) <= n:
        return words
    taken = [0]
    near = kernel(words, [words[0]])[:, 0]
    while len(taken) < n:
        k = int(near.argmin())
        taken.append(k)
        near = np.maximum(near, kernel(words, [words[k]])[:, 0])
    return [words[i] for i in taken]


def _gains(k1: np.ndarray, k0: np.ndarray) -> np.ndarray:
    """Log-likelihood ratios of words held by k1 places of toxic sentences and k0 of others; 0 below LIFT."""
    n1, n0 = max(k1.sum(), 1), max(k0.sum(), 1)
    p1, p0, p = k1 / n1, k0 / n0, (k1 + k0) / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(a > 0, a * np.log(q / r), 0) for a, q, r in
                 ((k1, p1, p), (n1 - k1, 1 - p1, 1 - p), (k0, p0, p), (n0 - k0, 1 - p0, 1 - p))]
    return np.where(p1 >= LIFT * p0, 2 * sum(parts), 0)


def _places(sequence: list[int], labels: list[int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct places (a word and its two neighbours) of either label each word has.

    ``sequence`` holds word numbers, 0 between sentences. A place seen in a clean document is clean;
    copies of a passage are the same places, so they teach once.
    """
    w, label = np.array(sequence, np.uint64), np.array(labels, np.int8)
    middle = np.flatnonzero(w[1:-1] > 0) + 1
    code = (w[middle - 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (w[middle] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (w[middle + 1] * np.uint64(0x165667B19E3779F9))
    order = np.lexsort((label[middle], code))
    first = order[np.flatnonzero(np.concatenate(([True], code[order][1:] != code[order][:-1])))] if len(order) else order
    own, toxic = w[middle[first]].astype(np.int64), label[middle[first]] == 1
    return np.bincount(own[toxic], minlength=size), np.bincount(own[~toxic], minlength=size)


def fit(documents: list[tuple[int, int, list[str]]], landmarks: int = LANDMARKS, seed: int = 7,
        whole: Callable[[Model, list], dict] | None = None) -> Model:
    """A model from (doc_id, label, sentences) of labelled documents; CONSTANT without both labels.

    ``whole`` gives the two highest decisions of the whole texts of the ids it is asked for, by id;
    without it the sentences are the texts.
    """
    rng = np.random.default_rng(seed)
    documents = sorted(documents, key=lambda d: (d[0], d[1]))
    left_out = rng.random(len(documents)) < 0.3
    numbers: dict[bytes, int] = {b"": 0}
    sequence, labels, bags = [0], [0], []
    for (_, label, sentences), out in zip(documents, left_out):
        held = set()
        for s in sentences:
            own = [numbers.setdefault(w, len(numbers)) for w in words_of(s)]
            held.update(own)
            if not out:
                sequence += [*own, 0]
                labels += [label] * (len(own) + 1)
        bags.append((label, np.array(sorted(held), np.int64)))
    names = list(numbers)
    k1, k0 = _places(sequence, labels, len(names))
    del sequence, labels
    if not k1.sum() or not k0.sum():
        return CONSTANT
    inside = [bag for bag, o in zip(bags, left_out) if not o]
    d1, d0 = (np.bincount(np.concatenate([np.empty(0, np.int64), *(h for y, h in inside if y == label)]), minlength=len(names)) for label in (1, 0))
    n1, n0 = (sum(y == label for y, _ in inside) for label in (1, 0))
    rare = d1 * n0 >= LIFT * d0 * n1                          # by documents, too
    gain = np.where(rare & np.array([len(w) >= 3 for w in names]), _gains(k1, k0), 0)
    chosen = np.empty(0, np.int64)
    for least in (GAIN, GAIN / 2, GAIN / 4):
        chosen = np.flatnonzero(gain >= least)
        if len(chosen):
            break
    if not len(chosen):
        return CONSTANT
    chosen = chosen[np.lexsort((chosen, -gain[chosen]))][:POSITIVE]
    positive = [names[i] for i in chosen]
    variants = [w[:i] + bytes([97 + int(c)]) + w[i:] for w in positive[:300] for i, c in zip(rng.integers(1, len(w), 3), rng.integers(0, 26, 3))]
    variants = sorted({v for v in variants if not k0[numbers.get(v, 0)]} - set(positive))
    own = np.sqrt(k1[chosen])
    own = np.concatenate([own, np.full(len(variants), 0.3 * own.sum() / max(1, len(variants)))])
    model = _train(positive, variants, own, [names[i] for i in np.flatnonzero(k0)], np.sqrt(k0[k0 > 0]), landmarks, rng)
    out = [i for i, o in enumerate(left_out) if o]
    if len({bags[i][0] for i in out}) < 2:
        out = list(range(len(bags)))
    if whole is None:
        used = np.unique(np.concatenate([bags[i][1] for i in out]))
        decided = np.full(len(names), -2.0)
        decided[used] = model.decide([names[i] for i in used])
        tops = np.array([np.sort(np.concatenate([[-2.0, -2.0], decided[bags[i][1]]]))[-2:][::-1] for i in out])
    else:
        found = whole(model, [documents[i][0] for i in out])
        tops = np.array([found[documents[i][0]] for i in out])
    model.link = _logistic(tops, np.array([1.0 if bags[i][0] else -1.0 for i in out]))
    return model


def _train(positive: list[bytes], variants: list[bytes], own: np.ndarray, clean: list[bytes], often: np.ndarray, landmarks: int, rng) -> Model:
    """The word machine: positive words (weights ``own``) against clean ones, the hardest found in rounds.

    ``often``: weights of the clean words, as a frequent word's error costs more.
    """
    negative = rng.permutation(len(clean))[:4000].tolist()
    marks = _landmarks(positive, 3 * landmarks // 4) + _landmarks([clean[i] for i in negative[:1000]], landmarks // 4)
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    good = values > 1e-4 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    codes, n, owner = _codes(marks)
    first = np.unique(owner, return_index=True)[1]
    seen = kernel(positive + variants + [clean[i] for i in negative], marks)
    model = CONSTANT
    for _ in range(6):
        # the last row is a word like no other, which is clean
        y = np.concatenate([np.ones(len(own)), -np.ones(len(negative) + 1)])
        weight = np.concatenate([own / own.sum(), often[negative] / often[negative].sum(), [0.2]])
        w = svm(np.concatenate([seen @ whiten, np.zeros((1, whiten.shape[1]))]), y, weight)
        table = np.zeros(TABLE, np.float32)
        for ix, decay in _subsequences(codes[first]):
            np.add.at(table, ix, (decay * (whiten @ w[:-1]) / _norms(n[first]))[:, None].astype(np.float32))
        table[0] = 0
        model = Model(table, float(w[-1]), CONSTANT.link)
        decided = model.decide(clean)
        taken = set(negative)
        order = np.argsort(-(decided + 1) * often, kind="stable")[:3000].tolist()
        hard = [i for i in order if decided[i] > -0.8 and i not in taken]
        if not hard:
            break
        negative += hard
        seen = np.concatenate([seen, kernel([clean[i] for i in hard], marks)])
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Logistic regression, classes weighted alike, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    w, keep = np.zeros(3), np.diag([1, 1, 0.01]) * ridge
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-y * (x @ w)))
        grad = keep @ w - (x * (weight * y * (1 - p))[:, None]).sum(0)
        step = np.linalg.solve(keep + (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(3), grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, *, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id",
          toxic: str = "toxic", toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS, sentences: int = SENTENCES) -> Model:
    """A model from the labelled rows for which ``learnable`` (over the labels' columns) holds.

    At most ``toxic_docs`` and ``clean_docs`` documents, the first by a hash of the id, and of each
    ``sentences`` sentences (pieces of at most PIECE characters), spread evenly over the text. The
    link is fitted on whole texts. Of rows that share an id the least text is learned from. Null ids, labels and texts are not learned
    from; a document with several labels is toxic if one says so.
    """
    known = labels.filter(learnable & F.col(label_id).isNotNull() & F.col(toxic).isNotNull()) \
        .groupBy(F.col(label_id).alias("id")).agg((F.max(toxic) >= 1).cast("int").alias("label"))
    chosen = None
    for value, n in ((1, toxic_docs), (0, clean_docs)):
        part = hash_sample(known.filter(F.col("label") == value), n, "id")
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = materialize(docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).filter("text is not null")
                       .join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label")),
                       "labelled")                            # at most toxic_docs + clean_docs rows

    def cut(batches):
        import pyarrow as pa
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                own = [s[a:a + PIECE] for s in SENTENCE.split(t) if s.strip() for a in range(0, len(s), PIECE)]
                at = np.unique(np.linspace(0, len(own) - 1, min(sentences, len(own))).astype(int)) if own else []
                out.append([own[i] for i in at])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.list_(pa.string()))], names=["id", "label", "sentences"])
    kind = rows.schema["id"].dataType.simpleString()
    sample = rows.select("id", "text", "label").mapInArrow(cut, f"id {kind}, label int, sentences array<string>").collect()

    def whole(model: Model, ids: list) -> dict:
        """The two highest decisions of the whole texts of ``ids``, one Spark pass over the sample."""
        sent, wanted = docs.sparkSession.sparkContext.broadcast(model), set(ids)

        def tops(batches):
            import pyarrow as pa
            scorer = Scorer(sent.value)
            for batch in batches:
                taken = [i for i, x in enumerate(batch.column(0).to_pylist()) if x in wanted]
                part = batch.take(pa.array(taken, pa.int64()))
                start = 0
                for texts in steps(part.column(1)):
                    first, second = scorer.tops(as_bytes(texts))
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(start, len(texts)), pa.array(first), pa.array(second)], names=["id", "first", "second"])
                    start += len(texts)
        found = rows.select("id", "text").mapInArrow(tops, f"id {kind}, first double, second double").collect()
        return {r[0]: (r[1], r[2]) for r in found}
    return fit([(r.id, r.label, r.sentences) for r in sample], whole=whole)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.memory = model, Memory(MEMORY_WORDS)

    def tops(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The highest and the second highest decision of the different words of each whole text."""
        words: list[bytes] = []
        ends = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            words += words_of(t.decode()) if t else []
            ends[i] = len(words)
        memory, old = self.memory, self.memory.old
        d = np.fromiter(map(memory.get, words, repeat(-9.0)), np.float32, len(words))
        missing = np.flatnonzero(d < -8)
        if len(missing):
            new = list({words[i] for i in missing.tolist()})
            memory.update((w, old[w]) for w in new if w in old)
            unseen = [w for w in new if w not in old]
            memory.update(zip(unseen, self.model.decide(unseen).tolist()))
            d[missing] = [memory[words[i]] for i in missing.tolist()]
            memory.turn()
        first, second = np.full(len(texts), -2.0), np.full(len(texts), -2.0)
        a = 0
        for i, b in enumerate(ends.tolist()):
            own = d[a:b]
            if b - a > 1:
                own = np.fromiter(dict(zip(words[a:b], own.tolist())).values(), np.float32)   # different words, as in fit
            if len(own) > 1:
                two = np.partition(own, len(own) - 2)[-2:]
                second[i], first[i] = float(two[0]), float(two[1])
            elif len(own):
                first[i] = float(own[0])
            a = b
        return first, second

    def scores(self, texts: list[bytes | None]) -> list[float]:
        return self.model.document(*self.tops(texts)).tolist()


def score_texts(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the ``score`` (0 to 1) and ``predicted`` (0 or 1) of every whole text; the names used.

    Only the text counts. Null, empty and blank texts get the score of a text without insults;
    repeated rows get equal scores; an empty table gives no rows; without a toxic and a clean
    labelled document every score is 0; clashing columns are renamed as the dict says.
    """
    names, key = fresh_names(docs.columns, ("score", "predicted")), uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast(model)    # one table of 2**18 weights

    def score(texts):
        return [kept(("scorer", key), lambda: Scorer(sent.value)).scores(texts)]
    out = append_columns(docs, text, [(names["score"], "double")], score, keep)
    return out.withColumn(names["predicted"], (F.col(names["score"]) >= threshold).cast("int")), names

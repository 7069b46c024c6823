"""Toxicity by a support vector machine over a subsequence string kernel.

The kernel compares two words by their common subsequences of three characters, gaps included: each counts with a
weight that falls with the stretch it covers. Nyström landmarks make the kernel a finite map, k(x, landmarks) K^-1/2,
on which a linear machine is trained. Without the norm the kernel is a dot product over subsequences, so the landmarks
and the machine fold into one weight for each three characters, and a word costs a lookup for each of its subsequences.

A text is cut into sentences, which have its label, and a sentence is a bag of words, as toxic as its worst one. Which words make a toxic sentence toxic is
not labelled, so the machine learns from bags: it starts from words whose runs of characters many toxic and hardly any clean documents have; once it is trained, it names the
words of toxic sentences itself, of those that no clean sentence has: the ones it held and still puts on the toxic side, and others beyond the margin. On these it is
trained again, until they stay the same. In each turn the clean words it fails on are added. Inserted characters, separators and repeats are trained on and tolerated; letters that stand alone are
read together as a word. A sentence ends at a full stop, question or exclamation mark that follows a word and precedes white space, in training as in scoring.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, texts, written
from .ragged import give_back, row_by_row, sliced

#: The documented bound of the training sample: labelled documents of each label, taken by hash, of at most so many characters.
TRAIN_DOCS = 1500
TRAIN_CHARS = 10_000
DECAY = 0.6
LONGEST = 24  # characters of a word that are compared; longer ones are compared in overlapping windows
LOW = -2.0  # margin of a word without characters
LANDMARKS = 128
#: Bounds of training, beside those of the sample: toxic words (the most frequent first), clean words to begin with and added in a round,
#: turns of naming toxic words, rounds of adding clean ones, and contexts that are remembered of a run of characters.
TOXIC_WORDS, CLEAN_WORDS, MORE_WORDS, TURNS, ROUNDS, CONTEXTS = 400, 1500, 1000, 3, 4, 64
ALPHABET = 40
SENTENCE = re.compile(r"(?<=\w\w)[.!?]+(?=\s)")
#: Characters that separate letters within a word, and that are read as letters.
MARKS = re.compile(r"[\W_]+")


def crc_mod(doc_id, n: int = 5):
    """crc32 of the doc_id as text, modulo n."""
    return F.crc32(doc_id.cast("string")) % n


def code_of(text: str) -> np.ndarray:
    """Codes from 2 on for the characters; 0 is a word's start and 1 its end. Letters of other scripts share codes by their remainder."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where((points >= 97) & (points <= 122), points - 95, 28 + (points * 2654435761 >> 7) % (ALPHABET - 28))


def chunks_of(sentence: str) -> list[str]:
    """Words of a sentence in lower case; runs of single letters are read as one word too."""
    words, run, out = sentence.lower().split(), [], []
    for w in [*words, ""]:
        bare = MARKS.sub("", w)
        if len(bare) == 1:
            run.append(bare)
            continue
        if len(run) >= 3:
            out.append("".join(run))
        run = []
        if bare:
            out.append(bare)
    return out


def _combos(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences of three in n characters, and their weights by the stretch they cover."""
    at = np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3)
    return at, (DECAY ** (at[:, 2] - at[:, 0] - 2.0)).astype(np.float32)


_COMBOS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def features(words: list[str]):
    """For each length, the places in the list, the characters' codes, the subsequences of each word as numbers, and their weights."""
    by: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by.setdefault(min(len(w), LONGEST), []).append(k)
    by.pop(0, None)
    for n, places in by.items():
        if n + 2 not in _COMBOS:
            _COMBOS[n + 2] = _combos(n + 2)
        at, weight = _COMBOS[n + 2]
        step = max(1, 500_000 // len(at))
        for k in range(0, len(places), step):
            part = places[k : k + step]
            codes = np.ones((len(part), n + 2), np.int64)
            codes[:, 0] = 0
            codes[:, 1:-1] = code_of("".join(words[i][:LONGEST] for i in part)).reshape(len(part), n)
            keys = (codes[:, at[:, 0]] * ALPHABET + codes[:, at[:, 1]]) * ALPHABET + codes[:, at[:, 2]]
            yield np.array(part), codes, keys, weight


def norms(codes: np.ndarray) -> np.ndarray:
    """Length of each word's vector: the root of its kernel with itself.

    same[a, b] marks equal characters; three of them are chained with the weight of the stretch between them on either side.
    """
    n = codes.shape[1]
    apart = np.arange(n)[None, :] - np.arange(n)[:, None]
    fade = np.where(apart > 0, DECAY ** np.maximum(apart, 0), 0.0).astype(np.float32)
    same = (codes[:, :, None] == codes[:, None, :]).astype(np.float32)
    chain = same
    for _ in range(2):
        half = (chain.reshape(-1, n) @ fade).reshape(-1, n, n).transpose(0, 2, 1)
        chain = same * (half.reshape(-1, n) @ fade).reshape(-1, n, n)
    return np.sqrt(chain.sum(axis=(1, 2)) / np.float32(DECAY**4))


def vectors(words: list[str]) -> np.ndarray:
    """A dense, normalised row for each word; for the few words of training."""
    size = ALPHABET**3
    out = np.zeros((len(words), size), np.float32)
    for part, _, keys, weight in features(words):
        for row, own in zip(part.tolist(), keys, strict=True):
            out[row] = np.bincount(own, weight, size)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    """weights: one for each three characters; a word's margin is their sum over its subsequences, by its norm, plus the bias.

    of_text turns what a text's margins sum up to (see `summary`) into log odds.
    """

    weights: np.ndarray
    bias: float
    of_text: np.ndarray

    def words(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), LOW)
        for part, codes, keys, weight in features(words):
            out[part] = (self.weights[keys] @ weight) / np.maximum(norms(codes), 1e-9) + self.bias
        return out

    def probability(self, summaries: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(summaries @ self.of_text).clip(-30, 30)))


def windows(words: list[str]) -> list[str]:
    """Words, and windows of those that are longer than LONGEST."""
    out = []
    for w in words:
        out += [w] if len(w) <= LONGEST else [w[k : k + LONGEST] for k in range(0, len(w) - LONGEST // 2, LONGEST // 2)]
    return out


def disguised(word: str, rng: np.random.Generator) -> str:
    """The word with a character inserted, doubled or left out; a word of the same class for training."""
    at = int(rng.integers(1, max(2, len(word))))
    kind = rng.integers(3)
    if kind == 0:
        return word[:at] + "abcdefghijklmnopqrstuvwxyz0123456789"[int(rng.integers(36))] + word[at:]
    return word[:at] + word[at - 1] + word[at:] if kind == 1 or len(word) < 6 else word[:at] + word[at + 1 :]


def machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, c: float = 30.0) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps on its active rows; y is -1 or 1."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        active = y * (x1 @ w) < 1
        a, b = x1[active], cost[active] * c
        new = np.linalg.solve(ridge + 2 * (a * b[:, None]).T @ a, 2 * (a * b[:, None]).T @ y[active])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def grams(word: str) -> set[str]:
    """Runs of four characters, the word's end among them, and starts of words of up to eight."""
    marked = f"<{word}>"
    return {marked[k : k + 4] for k in range(max(1, len(marked) - 3))} | {marked[:k] for k in range(5, min(10, len(marked)))}


def summary(first: np.ndarray, second: np.ndarray, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A row for each text: its two highest margins, how many reach 0, and its length."""
    clip = lambda x: np.clip(x, LOW, 1.0)
    return np.column_stack([np.ones(len(first)), clip(first), clip(second), np.log1p(hits), np.log1p(words) / 4, np.log1p(hits) * np.log1p(words) / 8])


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(len(w))
    for _ in range(40):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + keep, x.T @ (p - y) + keep @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(rows: list[tuple[str, int]], seed: int = 7) -> Model:
    """rows: text and label of the training documents, whose sentences have the document's label.

    What is kept of them is bounded by the sample's size and the constants above; without toxic words to begin with, no text is toxic.
    """
    rng = np.random.default_rng(seed)
    one: dict[str, str] = {}
    once = lambda w: one.setdefault(w, w)  # noqa: E731  equal words of different texts share their memory
    bags = [([once(w) for w in sorted({w for s in SENTENCE.split(text) for w in windows(chunks_of(s))})], label) for text, label in rows]
    clean: dict[str, int] = {}
    for words, label in bags:
        for w in () if label else words:
            clean[w] = clean.get(w, 0) + 1
    n_toxic, n_clean = sum(label for _, label in bags), sum(1 - label for _, label in bags)
    if not n_toxic or not n_clean:
        return Model(np.zeros(ALPHABET**3, np.float32), -1.0, np.r_[-4.0 if not n_toxic else 4.0, np.zeros(5)])
    in_toxic: dict[str, int] = {}
    for words, label in bags:
        for g in {g for w in words for g in grams(w)} if label else ():
            in_toxic[g] = in_toxic.get(g, 0) + 1
    in_toxic = {g: n for g, n in in_toxic.items() if n >= 4}
    in_clean = dict.fromkeys(in_toxic, 0)
    for words, label in bags:
        for g in {g for w in words for g in grams(w) if g in in_clean} if not label else ():
            in_clean[g] += 1
    # A copied passage repeats its grams as well, but always beside the same words.
    beside: dict[str, set] = {g: set() for g, n in in_toxic.items() if n / n_toxic > 10 * (in_clean[g] + 0.5) / n_clean}
    for text, label in rows:
        for s in SENTENCE.split(text) if label else ():
            words = chunks_of(s)
            for k, w in enumerate(words):
                for g in grams(w):
                    if g in beside and len(beside[g]) < CONTEXTS:
                        beside[g].add((*words[max(0, k - 1) : k], *words[k + 1 : k + 2]))
    excess = lambda g: in_toxic[g] - 20 * in_clean[g] * n_toxic / n_clean
    telling = {g: excess(g) for g, contexts in beside.items() if excess(g) > 2 and len(contexts) > 0.6 * min(CONTEXTS, in_toxic[g])}
    # In each toxic document, the words with its most telling gram; each is a positive example.
    positive: dict[str, int] = {}
    for words, label in bags:
        value = {w: max((telling[g] for g in grams(w) if g in telling), default=0) for w in words} if label else {}
        top = max(value.values(), default=0)
        for w, v in value.items():
            if v and v >= 0.3 * top:
                positive[w] = positive.get(w, 0) + 1
    yes = sorted(positive, key=lambda w: (-positive[w], w))[:TOXIC_WORDS]
    if not yes:
        return Model(np.zeros(ALPHABET**3, np.float32), -1.0, np.r_[-4.0, np.zeros(5)])
    no = sorted(w for w in clean if not any(g in telling for g in grams(w)))
    rng.shuffle(no)
    pool, no = no, no[:CLEAN_WORDS]
    marks = yes[: LANDMARKS // 2]
    marks = marks + no[: LANDMARKS - len(marks)]
    base = vectors(marks)
    gram = (base @ base.T).astype(np.float64)
    value, vector = np.linalg.eigh(gram + 1e-6 * np.eye(len(gram)))
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
    fold = lambda ws: np.vstack([vectors(ws[k : k + 100]) @ base.T for k in range(0, len(ws), 100)]) @ root
    x_no = fold(no)
    only_toxic = [[w for w in words if w not in clean] for words, label in bags if label]
    candidates = sorted({w for words in only_toxic for w in words})
    for _ in range(TURNS):
        words = yes + [disguised(w, rng) for w in yes for _ in range(2)]
        x_yes = fold(words)
        for _ in range(ROUNDS):
            x, y = np.vstack([x_yes, x_no]), np.r_[np.ones(len(x_yes)), -np.ones(len(x_no))]
            cost = np.r_[np.full(len(yes), 4.0), np.full(len(words) - len(yes), 1.0), np.full(len(no), 2.0)]
            w, bias = machine(x, y, cost)
            model = Model((base.T @ (root @ w)).astype(np.float32), bias, np.zeros(6))
            margins = model.words(pool)
            worst = [pool[k] for k in np.argsort(-margins)[:MORE_WORDS] if margins[k] > -0.8]
            more = sorted(set(worst) - set(no))
            if not more:
                break
            no, x_no = no + more, np.vstack([x_no, fold(more)])
        margin = dict(zip(candidates, model.words(candidates).tolist(), strict=True))
        # a word stays on its side of the plane, and a new one is taken from outside the margin
        named, held = {}, set(yes)
        for own in only_toxic:
            for word in own:
                if margin[word] >= (0.0 if word in held else 1.0):
                    named[word] = named.get(word, 0) + 1
        again = sorted(named, key=lambda w: (-named[w], w))[:TOXIC_WORDS]
        if not again or set(again) == set(yes):
            break
        yes = again
    known: dict[str, float] = {}
    parts = [summaries(pd.DataFrame({"text": [text for text, _ in rows[k : k + 200]]}), model, known) for k in range(0, len(rows), 200)]
    model.of_text = fitted(np.vstack(parts), np.array([label for _, label in rows], float))
    return model


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> list[tuple[str, int]]:
    """Whole labelled documents outside the held-out fold, of each label at most `most`, by a hash of the id."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where("toxic in (0, 1) and doc_id is not null").where(crc_mod(F.col("doc_id")) != 0)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = [marked.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    sample = written(few[0].unionByName(few[1]))  # at most twice `most` rows
    rows = docs.where(F.char_length("text") <= TRAIN_CHARS).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic")
    return [(r.text, r.toxic) for r in sorted(rows.collect(), key=lambda r: (r.doc_id, r.text))]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def opened():
        model, known = shared.value, {}
        return lambda rows: _scores(rows, model, known)

    return row_by_row(docs.select("doc_id", "text"), ["doc_id"], opened, "score double, predicted int")


def _scores(rows: pd.DataFrame, model: Model, known: dict[str, float]) -> pd.DataFrame:
    score = model.probability(summaries(rows, model, known))
    return pd.DataFrame({"score": score, "predicted": (score >= 0.5).astype(np.int32)})


def summaries(rows: pd.DataFrame, model: Model, known: dict[str, float]) -> np.ndarray:
    """The summary of each whole text; each distinct word is compared once, and kept in `known`."""
    if len(known) > 200_000:
        known.clear()
    lists = pc.utf8_split_whitespace(pa.array(rows["text"], pa.large_string()))
    ends, words = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
    ends, names, at = ends - ends[0], words.dictionary.to_pylist(), words.indices.to_numpy()
    fresh = [w for w in names if w not in known]
    if fresh:
        parts = [windows([MARKS.sub("", w.lower())]) for w in fresh]
        margins = model.words(list(chain.from_iterable(parts)))
        known.update(zip(fresh, np.maximum.reduceat(margins, np.cumsum([0, *map(len, parts)])[:-1]).tolist(), strict=True))
    value = np.fromiter(map(known.__getitem__, names), float, len(names))[at]
    n = len(rows)
    first, second, hits = np.full(n, LOW), np.full(n, LOW), np.zeros(n)
    full = np.flatnonzero(ends[1:] > ends[:-1])
    if len(full):
        starts = ends[:-1][full]
        first[full] = np.maximum.reduceat(value, starts)
        hits[full] = np.add.reduceat((value >= 0).astype(float), starts)
        doc = np.repeat(np.arange(n), np.diff(ends))
        top = np.flatnonzero(value == first[doc])
        rest = value.copy()
        rest[top[np.unique(doc[top], return_index=True)[1]]] = LOW
        second[full] = np.maximum.reduceat(rest, starts)
        # Letters that stand alone, three or more in a row, are a word.
        single = np.array([len(w) < 8 and len(MARKS.sub("", w)) == 1 for w in names], bool)[at]
        edge = np.flatnonzero(np.diff(np.r_[False, single, False].astype(np.int8)))
        for a, b in edge.reshape(-1, 2).tolist():
            if b - a < 3:
                continue
            for d in range(doc[a], doc[b - 1] + 1):
                letters = [MARKS.sub("", names[k]).lower() for k in at[max(a, ends[d]) : min(b, ends[d + 1])].tolist()]
                if len(letters) < 3:
                    continue
                word = "".join(letters)
                if word not in known:
                    known[word] = float(model.words(windows([word])).max())
                m = known[word]
                second[d] = max(second[d], min(first[d], m))
                first[d] = max(first[d], m)
                hits[d] += m >= 0
    return summary(first, second, hits, np.diff(ends))


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, with all their columns, whose texts score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known: dict[str, float] = {}
        for batch in batches:
            text = pd.DataFrame({"text": batch.column("text").fill_null("").to_pandas()})
            parts = [shared.value.probability(summaries(rows, shared.value, known)) < threshold for rows in sliced(text)]
            yield batch.filter(pa.array(np.concatenate(parts))) if parts else batch
        give_back()

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted.

    The machine learns from a sample of the labelled documents, at most TRAIN_DOCS of each label and of at most TRAIN_CHARS characters, and scores whole texts of any length.
    Null, empty and wordless texts score low. Only the text is scored. Labels of ids that repeat count as toxic where one of them is;
    null labels and labels without a document are ignored, and without labels of both kinds all texts score alike. Repeated rows each
    return, a null doc_id is scored and is not held out; other columns are ignored; an empty table gives no rows.
    """
    docs = texts(docs)
    model = train(training_rows(docs, labels))
    held = F.coalesce(crc_mod(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return scored(docs, model).select("doc_id", held, "score", "predicted")


def query(spark, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

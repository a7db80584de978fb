"""Abusive, hateful or sexually explicit content: a score for every document.

Words are undisguised first (invisible and look-alike characters, digits for letters, spaced, masked, stretched or swapped letters),
then an FTRL-proximal logistic regression over hashed word n-grams and skip-grams scores every stretch of a few words; a
document's score is that of its worst stretch, so long texts dilute nothing. Labels name documents, not places: in training, the
stretch of a document that the model so far finds worst stands for it. Per-coordinate rates and L1 leave few weights, which are
broadcast.
"""

from __future__ import annotations

import io
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіѕјһԁкмтвнӏԛԝгαεοιυνκρτχ", "aeopcyxisjhdkmtbhlqwraeoiuvkptx")
#: Digits and signs that stand for letters.
DIGITS = str.maketrans("0134578@$€!|+", "oieastbaseiit")
DIGITS_L = str.maketrans("0134578@$€!|+", "oleastbaselit")

_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_SPREAD = re.compile(r"(?<![^\W_])[^\W_](?:([.\-_*·•])[^\W_](?:\1[^\W_])+)(?![^\W_])")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?: [^\W\d_]){2,}(?![^\W_])")
_WORD = re.compile(r"[぀-ヿ一-鿿]|[^\W_]+(?:[*@$!|'’·][^\W_]+|[*]+[^\W_]*)*|[*]+[^\W_]+")
_RUN = re.compile(r"(.)\1+")
_MIXED = re.compile(r"[a-z]")
_MARK = re.compile("[̀-ͯ]")


@dataclass(frozen=True)
class ContentRules:
    """most_labelled: labelled documents that training takes at most, those of the smallest hash of doc_id. bits: of the hash space.
    stretches: their lengths in words. alpha, beta, l1, l2: of FTRL-proximal. rounds: passes. The words known for undisguising are
    all that two labelled documents have."""

    most_labelled: int = 20_000
    bits: int = 20
    stretches: tuple[int, ...] = (3, 5, 8, 14)
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.6
    l2: float = 0.5
    rounds: int = 4
    seed: int = 7


def _plain(word: str) -> str:
    """A word in its plainest form: one script, no marks, letters for digits, no letter twice in a row."""
    if not word.isascii():
        word = _MARK.sub("", unicodedata.normalize("NFD", word))
        if _MIXED.search(word):
            word = word.translate(LOOKALIKES)
    if word.isdigit():
        return "#"
    if any(c in "0134578@$€!|+" for c in word):
        letters = sum(c.isalpha() for c in word)
        if letters and len(word) >= 3:
            word = word.translate(DIGITS)
        elif not letters:
            return "#"
    return _RUN.sub(r"\1", word)


def split_words(text: str) -> list[str]:
    """The words of a text as written, letter-spread words joined, in lower case."""
    t = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).lower()
    t = _SPREAD.sub(lambda m: m.group(0).replace(m.group(1), ""), t)
    t = _SPACED.sub(lambda m: m.group(0).replace(" ", ""), t)
    return _WORD.findall(t)


class Words:
    """Known words; resolves disguised ones to the most frequent known word they can be."""

    def __init__(self, known: dict[str, int]) -> None:
        self.known, self.cache = known, {}
        self.sorted: dict[str, str] = {}
        self.ends: dict[str, list[str]] = defaultdict(list)
        for w in sorted(known, key=lambda w: (-known[w], w)):
            if len(w) > 3:
                self.sorted.setdefault("".join(sorted(w)), w)
            self.ends[w[:1]].append(w)

    def resolve(self, raw: str) -> str:
        out = self.cache.get(raw)
        if out is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            out = self.cache[raw] = self._resolve(raw)
        return out

    def _resolve(self, raw: str) -> str:
        if "*" in raw:
            parts = [_RUN.sub(r"\1", p) for p in re.split(r"\*+", raw.translate(DIGITS))]
            if len("".join(parts)) >= 2:
                among = self.ends.get(parts[0][:1], ()) if parts[0] else sorted(self.known, key=lambda w: (-self.known[w], w))
                stars = iter(re.findall(r"\*+", raw))
                exact = re.escape(parts[0]) + "".join(f".{{{len(next(stars))}}}" + re.escape(p) for p in parts[1:])
                # as many letters as stars first, then any few
                for shape in (re.compile(exact), re.compile(".{1,4}".join(map(re.escape, parts)))):
                    for w in among:
                        if shape.fullmatch(w):
                            return w
            return _RUN.sub(r"\1", raw.replace("*", ""))
        w = _plain(raw)
        best = self.known.get(w, 0)
        if best >= 3 or len(w) < 4:
            return w
        other = _RUN.sub(r"\1", raw.translate(DIGITS_L)) if "1" in raw else ""
        if self.known.get(other, 0) > best:
            return other
        swap = self.sorted.get("".join(sorted(w)))
        return swap if swap and self.known[swap] > 3 * best and sum(a != b for a, b in zip(w, swap)) <= 3 else w


def _hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def buckets(h: np.ndarray, bits: int) -> np.ndarray:
    """5 x n hash buckets: the word, the pair and the three words that end there, and the pairs with one and two words between.
    Bucket 0 stands for none."""
    n = len(h)
    out = np.zeros((5, n), np.int64)
    a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    shift = np.uint64(64 - bits)

    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return np.maximum(((x ^ (x >> np.uint64(29))) * a >> shift).astype(np.int64), 1)

    with np.errstate(over="ignore"):
        out[0] = mix(h)
        if n > 1:
            out[1, 1:] = mix(h[:-1] * a + h[1:] * b)
        if n > 2:
            out[2, 2:] = mix(h[:-2] * a + h[1:-1] * b + h[2:] * c)
            out[3, 2:] = mix(h[:-2] * b + h[2:] * c + np.uint64(1))
        if n > 3:
            out[4, 3:] = mix(h[:-3] * c + h[3:] * a + np.uint64(2))
    return out


def _worst(parts: np.ndarray, lengths: tuple[int, ...]) -> tuple[int, int, float]:
    """Start, length and sum of the stretch, of one of the given lengths, with the greatest sum; shorter texts are one stretch."""
    n = len(parts)
    run = np.concatenate(([0.0], np.cumsum(parts)))
    best = (0, n, float(run[-1])) if n <= lengths[-1] else (0, 0, -math.inf)
    for k in lengths:
        if k >= n:
            break
        sums = run[k:] - run[:-k]
        i = int(np.argmax(sums))
        if sums[i] > best[2]:
            best = (i, k, float(sums[i]))
    return best


class Model:
    """Sparse weights, bias, known words and the threshold of a flag."""

    def __init__(self, weights: np.ndarray, bias: float, known: dict[str, int], rules: ContentRules, threshold: float = 0.0) -> None:
        self.weights, self.bias, self.words, self.rules, self.threshold = weights, bias, Words(known), rules, threshold

    def buckets_of(self, text: str | None) -> np.ndarray:
        words = [self.words.resolve(w) for w in split_words(text or "")]
        return buckets(_hashes(words), self.rules.bits) if words else np.zeros((5, 0), np.int64)

    def margin(self, b: np.ndarray) -> float:
        return self.bias + (_worst(self.weights[b].sum(axis=0), self.rules.stretches)[2] if b.shape[1] else 0.0)

    def score(self, text: str | None) -> float:
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, self.margin(self.buckets_of(text))))))

    def dump(self) -> bytes:
        at = np.flatnonzero(self.weights)
        out = io.BytesIO()
        names = sorted(self.words.known)
        np.savez_compressed(out, at=at, w=self.weights[at], bias=self.bias, threshold=self.threshold, names=np.array(names, dtype=str), counts=np.array([self.words.known[n] for n in names], np.int64))
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes, rules: ContentRules) -> Model:
        z = np.load(io.BytesIO(data))
        w = np.zeros(1 << rules.bits)
        w[z["at"]] = z["w"]
        return cls(w, float(z["bias"]), dict(zip(z["names"].tolist(), z["counts"].tolist())), rules, float(z["threshold"]))


def _ftrl(docs: list[np.ndarray], labels: np.ndarray, rules: ContentRules) -> tuple[np.ndarray, float]:
    """Weights and bias. Each pass takes the worst stretch of each document, and of those without such content a random one too."""
    size = 1 << rules.bits
    rng = np.random.default_rng(rules.seed)
    seen = [np.zeros(size), np.zeros(size)]
    for b, y in zip(docs, labels):
        seen[int(y)][np.unique(b)] += 1
    n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    start = np.where(seen[1] + seen[0] >= 3, np.clip(odds, -3, 3), 0.0)
    start[0] = 0.0
    z, n = np.zeros(size), np.zeros(size)
    zb = nb = 0.0

    def weight(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= rules.l1, 0.0, -(zz - np.sign(zz) * rules.l1) / ((rules.beta + np.sqrt(n[at])) / rules.alpha + rules.l2))

    def learn(at: np.ndarray, y: float) -> None:
        nonlocal zb, nb
        w = weight(at)
        bias = -zb / ((rules.beta + math.sqrt(nb)) / rules.alpha)
        p = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, float(w.sum()) + bias))))
        g = p - y
        step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / rules.alpha
        z[at] += g - step * w
        n[at] += g * g
        zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / rules.alpha * bias
        nb += g * g

    for turn in range(rules.rounds):
        for i in rng.permutation(len(docs)):
            b = docs[i]
            if not b.shape[1]:
                continue
            current = start[b] if turn == 0 else weight(b)
            at, length, _ = _worst(current.sum(axis=0), rules.stretches)
            stretches = [(at, length)]
            if not labels[i]:
                words = int(rng.choice(rules.stretches))
                stretches.append((int(rng.integers(0, max(1, b.shape[1] - words + 1))), words))
            for s, words in stretches:
                own = np.unique(b[:, s : s + words])
                learn(own[own > 0], float(labels[i]))
    w = weight(np.arange(size))
    w[0] = 0.0
    return w, -zb / ((rules.beta + math.sqrt(nb)) / rules.alpha)


def train(texts: list[str | None], labels: list[int], rules: ContentRules = ContentRules()) -> Model:
    """A model from labelled texts. Texts said to be harmless that a model of the other half clearly contradicts are left out; the
    threshold is the one with the best F1 on what the other half's model says. Without both classes, the model flags nothing."""
    y = np.array(labels, float)
    count = Counter(w for t in texts for w in {_plain(x) for x in split_words(t or "") if "*" not in x})
    known = {w: c for w, c in sorted(count.items()) if c >= 2}
    model = Model(np.zeros(1 << rules.bits), -10.0, known, rules, 1.1)
    if len(y) < 4 or y.min() == y.max():
        return model
    docs = [model.buckets_of(t) for t in texts]
    half = np.random.default_rng(rules.seed).permutation(len(y)) % 2
    out = np.zeros(len(y))
    for side in (0, 1):
        own = np.flatnonzero(half != side)
        if y[own].min() == y[own].max():
            continue
        m = Model(*_ftrl([docs[i] for i in own], y[own], rules), known, rules)
        for i in np.flatnonzero(half == side):
            out[i] = m.margin(docs[i])
    keep = np.flatnonzero((y == 1) | (out <= 1.0))
    if y[keep].min() == y[keep].max():
        keep = np.arange(len(y))
    model.weights, model.bias = _ftrl([docs[i] for i in keep], y[keep], rules)
    order = np.argsort(-out)
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(len(y)) + 1 + y.sum())
    best = int(np.argmax(f1))
    cut = (out[order[best]] + (out[order[best + 1]] if best + 1 < len(y) else out[order[best]])) / 2
    cut = max(cut, model.bias + 0.25)  # words that the model doesn't know are no evidence
    model.threshold = 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, cut))))
    return model


_TRAINED = pa.schema([("model", pa.binary()), ("n_labelled", pa.int64())])


def labelled_texts(docs: DataFrame, labels: DataFrame, rules: ContentRules = ContentRules()) -> DataFrame:
    """doc_id, text, label of the labelled documents: 1 where most verdicts name such content, 0 where most say `none`.

    Null, blank and unknown verdicts don't count, letter case doesn't matter; documents with equally many of both are left out.
    """
    verdict = F.lower(F.trim("verdict"))
    vote = labels.where(verdict.isin("none", "abusive", "hateful", "sexual")).groupBy("doc_id").agg(F.avg((verdict != "none").cast("double")).alias("share")).where(F.col("share") != 0.5)
    some = vote.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rules.most_labelled).select("doc_id", (F.col("share") > 0.5).cast("int").alias("label"))
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most most_labelled rows of two numbers


def fit(docs: DataFrame, labels: DataFrame, rules: ContentRules = ContentRules()) -> bytes:
    """The model, some hundred kB, trained in one task on at most rules.most_labelled labelled documents."""

    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
        texts, y = rows["text"].to_pylist(), rows["label"].to_pylist()
        return pa.Table.from_pylist([{"model": train([texts[i] for i in order], [y[i] for i in order], rules).dump(), "n_labelled": len(y)}], schema=_TRAINED)

    sample = labelled_texts(docs, labels, rules).withColumn("_all", F.lit(1))
    found = sample.groupBy("_all").applyInArrow(run, "model binary, n_labelled bigint").collect()
    return bytes(found[0]["model"]) if found else Model(np.zeros(1 << rules.bits), -10.0, {}, rules, 1.1).dump()


def score_documents(docs: DataFrame, model: bytes, rules: ContentRules = ContentRules(), keep: tuple[str, ...] = (), most_bytes: int = 256 << 20) -> DataFrame:
    """(doc_id, score, flagged, and the columns named in keep) for each row of docs; null, empty and blank texts have the score of no
    words and are never flagged. The model goes to every worker; its size follows from the labelled documents, and one of more
    than most_bytes raises."""
    if len(model) > most_bytes:
        raise ValueError(f"a model of {len(model)} bytes is too large to be sent to every worker; train it on fewer labelled documents")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[F.col(f"`{c}`") for c in keep]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.load(shared.value, rules)
        for b in batches:
            texts = b.column(1).to_pylist()
            scores = [m.score(t) for t in texts]
            flags = pa.array([bool(t and t.strip()) and s >= m.threshold for s, t in zip(scores, texts)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), flags, *b.columns[2:]], names=["doc_id", "score", "flagged", *keep])

    out = StructType([StructField("doc_id", LongType()), StructField("score", DoubleType()), StructField("flagged", BooleanType()), *kept.fields])
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, out)

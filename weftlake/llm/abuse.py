"""Abusive, hateful or sexually explicit content (problem 10): a character n-gram linear classifier on naive Bayes ratios.

Texts are normalised against disguise (compatibility forms, invisible characters, signs for letters, stretched and spaced
letters, signs put between letters). The features are the character n-grams that occur, each scaled by its naive Bayes
log-count ratio between abusive and other training text; a regularised logistic regression is fitted on them.

Training text is labelled: that of `abuse_texts`, with variants as disguise makes them, and bounded samples of texts that
are clean by who wrote them (`labelled_clean`). Of a further sample without labels, a sentence trains as clean only if the
fit on the labelled text alone does not call it abusive, however often it occurs. The documents to be scored never train:
a document's score depends on its own text and the model only.

A document's score is that of its most abusive stretch: the largest sum of n-gram weights over any run of characters of a
sentence, so that a slur counts no less for standing in a long text. All n-grams of a batch are hashed and summed as
arrays; a document costs the same per character whatever it holds.
"""

from __future__ import annotations

import functools
import html
import random
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlake.llm import abuse_texts
from weftlake.llm.language import SEED as SEED_TEXTS

#: Bounds of the samples of texts that are clean by who wrote them, and of texts without a label.
FIT_DOCS, FIT_UNLABELLED = 6000, 4000
#: Log-odds of a text without any known n-gram.
PRIOR = -4.0
ORDERS = (1, 2, 3, 4, 5)
TABLE_BITS = 22
#: Smoothing of counts, strength of regularisation, rounds and seed of the fit.
ALPHA, L2, STEPS, SEED = 0.5, 2e-4, 60, 11
#: Rounds in which the most abusive-looking stretches of clean sentences are added as clean examples of their own.
MINING = 3
#: Score from which on a document counts as abusive.
THRESHOLD = 0.68
#: Log-odds from which on even a text that should be clean does not train as such.
SURE_ABUSE = 4.0

_INVISIBLE = re.compile(r"[­​-‏‪-‮⁠-⁤﻿️]")
_TAGS = re.compile(r"<[^<>]+>")
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "$": "s", "@": "a", "!": "i", "|": "i", "€": "e"})
_ROMAN = "a-zà-ɏḀ-ỿ"
_MIXED = re.compile(rf"(?<![{_ROMAN}0-9$@])[{_ROMAN}0-9$@!|€]*(?:[{_ROMAN}][0134578$@!|€]|[0134578$@€][{_ROMAN}])[{_ROMAN}0-9$@!|€]*")
_BETWEEN = re.compile(r"(?<=[^\W\d_])[*・·•_~^`´'’\-.#+=|]+(?=[^\W\d_])")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*·・]){2,}[^\W\d_](?![^\W_])")
_SPLIT = re.compile(r"[.!?。！？;；\n\r…]+")
_NOT_LETTER = re.compile(r"[^\w\n]+")
_NUMBERS = re.compile(r"\d+")


def _unleet(m: re.Match) -> str:
    word = m.group()
    letters = sum(c.isalpha() for c in word)
    # Codes and prices have many digits.
    return word.rstrip("!|").translate(_LEET) + " " if letters >= 2 and sum(c.isdigit() for c in word) < 4 else word


def normalised(text: str) -> list[str]:
    """The sentences of a text, in lower case, letters and single blanks only, digits as 0, disguise undone."""
    t = _TAGS.sub("\n", html.unescape(text)) if "<" in text or "&" in text else text
    t = _INVISIBLE.sub("", unicodedata.normalize("NFKC", t)).lower()
    t = _MIXED.sub(_unleet, t)
    t = _BETWEEN.sub(lambda m: "" if m.group()[0] not in ".-'’" or len(m.group()) > 1 else m.group(), t)
    t = _SPACED.sub(lambda m: re.sub(r"[ .\-_*·・]", "", m.group()), t)
    t = _NOT_LETTER.sub(" ", _NUMBERS.sub("0", _SPLIT.sub("\n", t)))
    return [s for s in map(str.strip, t.split("\n")) if s]


def _encoded(sentences: list[str]) -> np.ndarray:
    """Code points of the sentences, each ended by 0; a letter that is stretched to three or more stands once."""
    cps = np.frombuffer("".join(" " + s + " \0" for s in sentences).encode("utf-32-le", "replace"), np.uint32)
    if len(cps) < 3:
        return cps
    same = np.concatenate([[False], cps[1:] == cps[:-1], [False]])
    run = np.cumsum(~same[:-1])
    length = np.bincount(run)
    return cps[~same[:-1] | (length[run] < 3) | (cps == 0)]


def without_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.replace("đ", "d").replace("Đ", "D")) if unicodedata.category(c) != "Mn") if not re.search(r"[぀-ヿ]", text) else text


def misread(text: str) -> str:
    """The text as it looks when its bytes are read in the wrong encoding; empty if that changes nothing."""
    return "" if text.isascii() else text.encode().decode("cp1252", errors="ignore")


_PRIME = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(1)
def _wide() -> np.ndarray:
    """Whether a code point belongs to a script whose single letters say something."""
    wide = np.zeros(0x10000, bool)
    wide[0x3040:0x3100] = wide[0x3400:0xA000] = True
    return wide


def gram_hashes(cps: np.ndarray) -> list[np.ndarray]:
    """For each order, the hash of the n-gram that ends at each place; 0 where there is none (it holds a sentence end).

    Single letters and pairs count in scripts of many letters only.
    """
    out = []
    codes = cps.astype(np.uint64)
    ends = cps == 0
    wide = _wide()[np.minimum(cps, 0xFFFF)]
    h = np.zeros(len(cps), np.uint64)
    bad = np.zeros(len(cps), bool)
    for n in range(1, max(ORDERS) + 1):
        k = n - 1
        shifted = np.concatenate([np.zeros(k, np.uint64), codes[: len(codes) - k]]) if k else codes
        h = (h ^ (shifted + np.uint64(n))) * _PRIME
        h ^= h >> np.uint64(29)
        bad = bad | (np.concatenate([np.ones(k, bool), ends[: len(ends) - k]]) if k else ends)
        if n in ORDERS:
            skip = bad if n > 2 else bad | ~wide
            out.append(np.where(skip, np.uint64(0), h | np.uint64(1)))
    return out


class Weights:
    """The fitted weights in an open table: slot by hash, with a fingerprint to keep strangers out."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray, bias: float) -> None:
        self.hashes, self.values, self.bias = hashes, values, bias

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        slot = (self.hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        order = np.argsort(np.abs(self.values))  # on a clash the heavier weight stays
        mark = np.zeros(1 << TABLE_BITS, np.uint32)
        value = np.zeros(1 << TABLE_BITS, np.float32)
        mark[slot[order]] = (self.hashes[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        value[slot[order]] = self.values[order]
        return mark, value

    def scores(self, table: tuple[np.ndarray, np.ndarray], docs: list[list[str]]) -> np.ndarray:
        """Per document, the log-odds of its most abusive stretch; minus infinity for one without letters."""
        mark, value = table
        out = np.full(len(docs), -np.inf)
        cps = _encoded([s for d in docs for s in d])
        if not len(cps):
            return out
        gain = np.zeros(len(cps), np.float32)
        for h in gram_hashes(cps):
            slot = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            hit = (mark[slot] == (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)) & (h != 0)
            gain += np.where(hit, value[slot], 0)
        best, _ = _runs(gain, cps)
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        np.maximum.at(out, owner, best + self.bias)
        return out


def _runs(gain: np.ndarray, cps: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Of each sentence, the largest sum of gain over a run of places, and where the run begins and ends.

    It is the prefix sum less the least prefix sum before it. A step down at every sentence, deeper than sentences can
    differ, keeps sentences apart.
    """
    ends = cps == 0
    sentence = np.cumsum(ends) - ends
    prefix = np.cumsum(gain.astype(np.float64))
    depth = 2 * (np.abs(gain).sum(dtype=np.float64) + 1)
    low = prefix - depth * sentence
    before = low - gain
    least = np.minimum.accumulate(before)
    best = low - least
    starts = np.flatnonzero(np.concatenate([[True], ends[:-1]]))
    top = np.maximum.reduceat(best, starts)
    place = np.arange(len(cps))
    stop = np.minimum.reduceat(np.where(best == top[sentence], place, len(cps)), starts)
    origin = np.maximum.accumulate(np.where(before == least, place, 0))
    return top, (origin[stop], stop)


def variants(sentence: str, rng: random.Random) -> list[str]:
    """The sentence and what disguise makes of it: accents gone, a letter gone or another in its place."""
    out = [sentence, without_accents(sentence)]
    for _ in range(5):
        words = sentence.split(" ") if " " in sentence else [sentence]
        for _ in range(2):
            i = rng.randrange(len(words))
            w = words[i]
            if len(w) > 2:
                k = rng.randrange(1, len(w) - 1)
                words[i] = w[:k] + rng.choice(["", "", "v", "x", "o"]) + w[k + 1 :] if " " in sentence else w
        out.append(" ".join(words))
    half = len(sentence) // 2
    if " " in sentence:
        parts = [p for p in re.split(r",\s*", sentence) if len(p.split()) > 1]
    else:
        parts = [p for p in re.split("[、，]", sentence) if len(p) > 2]
    return out + (parts if len(parts) > 1 else []) if half else [sentence]


def spellings(phrase: str) -> list[str]:
    """A word or phrase, and if it is long enough to stay itself, the same without accents and with a letter gone."""
    out = [phrase]
    if len(phrase) >= 8 and " " in phrase:
        out.append(without_accents(phrase))
    if len(phrase) >= 5 and phrase.isascii():
        out += [phrase[:k] + phrase[k + 1 :] for k in range(1, len(phrase) - 1) if phrase[k] in "aeiou"][:2]
    return out


def fit(abusive: list[str], clean: list[str]) -> Weights:
    """Naive Bayes log-count ratios times the weights of a logistic regression on the scaled features.

    As a text is scored by its worst stretch, clean sentences train not only whole: in a few rounds, the stretch of each
    that scores highest is added as a clean example.
    """
    cps = _encoded(abusive + clean)
    ends = cps == 0
    sentence = np.cumsum(ends) - ends
    n = len(abusive) + len(clean)
    hashes = gram_hashes(cps)
    features = np.unique(np.concatenate([h[h != 0] for h in hashes]))
    columns = [np.where(h != 0, np.searchsorted(features, h), -1) for h in hashes]

    def pairs(row_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, column), each pair once, of the places that belong to a row."""
        keys = np.concatenate([(row_of * len(features) + c)[(c >= 0) & (row_of >= 0)] for c in columns])
        keys = np.unique(keys)
        return keys // len(features), keys % len(features)

    row, col = pairs(sentence)
    y = np.concatenate([np.ones(len(abusive)), np.zeros(len(clean))])
    p = ALPHA + np.bincount(col, weights=y[row], minlength=len(features))
    q = ALPHA + np.bincount(col, weights=1 - y[row], minlength=len(features))
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    w = np.full(len(features), 0.05)
    for mining in range(MINING + 1):
        m, v = np.zeros_like(w), np.zeros_like(w)
        x = ratio[col]
        weight = np.where(y > 0, 0.5 / max(int(y.sum()), 1), 0.5 / max(int((1 - y).sum()), 1))
        for step in range(1, STEPS + 1):
            z = np.bincount(row, weights=x * w[col], minlength=len(y)) + PRIOR
            g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
            gw = np.bincount(col, weights=g[row] * x, minlength=len(features)) + L2 * (w - 0.05)
            m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
            w -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        if mining == MINING:
            break
        value = np.append(w * ratio, 0.0).astype(np.float32)
        top, (start, stop) = _runs(sum(value[c] for c in columns), cps)
        hard = np.flatnonzero((np.arange(n) >= len(abusive)) & (top + PRIOR > -2))
        if not len(hard):
            break
        rows = np.full(len(cps), -1)
        for k, i in enumerate(hard):
            rows[start[i] : stop[i] + 1] = len(y) + k
        more_row, more_col = pairs(rows)
        row, col = np.concatenate([row, more_row]), np.concatenate([col, more_col])
        y = np.concatenate([y, np.zeros(len(hard))])
    return Weights(features, (w * ratio).astype(np.float32), PRIOR)


def training(own: bool = True) -> tuple[list[str], list[str]]:
    """(abusive, clean) sentences of the labelled text, with variants; without `own`, no whole sentences train."""
    rng = random.Random(SEED)
    abusive, clean = [], []
    for words, sentences in abuse_texts.abusive().values():
        abusive += [n for w in words for x in spellings(w) for n in normalised(x)]
        abusive += [n for s in sentences for x in _both(s) for n in normalised(x)]
    for sentences in [*abuse_texts.clean().values(), *SEED_TEXTS.values()]:
        clean += [n for s in sentences for x in _both(s) for n in normalised(x)]
    if own:
        abusive += [n for group in abuse_texts.ABUSIVE.values() for s in group for x in variants(s, rng) for n in normalised(x)]
        clean += [n for group in abuse_texts.CLEAN.values() for s in group for x in _both(s) for n in normalised(x)]
    for lang, (words, sentences) in abuse_texts.abusive().items():
        clean += innocent(words, sentences + (abuse_texts.ABUSIVE[lang] if own else []))
    return abusive, clean


def innocent(words: list[str], sentences: list[str]) -> list[str]:
    """What abusive sentences in a script with blanks say besides abusive words: alone it is clean.

    Each longest stretch of words none of which occurs in the abusive words and phrases, each word of it, and each word of
    an abusive phrase that is not listed as abusive by itself.
    """
    phrases = [n for phrase in words for x in _both(phrase) for n in normalised(x)]
    alone = {n for n in phrases if " " not in n}
    bad = {w for n in phrases for w in n.split()}
    out = {w for n in phrases if " " in n for w in n.split()} - alone
    for sentence in sentences:
        for x in _both(sentence):
            for n in normalised(x):
                if " " not in n:
                    continue
                run: list[str] = []
                for w in [*n.split(), ""]:
                    if w and w not in bad:
                        run.append(w)
                    else:
                        if 0 < len(run) <= 3:
                            out.add(" ".join(run))
                        out.update(run)
                        run = []
    return sorted(out)


def _both(text: str) -> list[str]:
    """A text, and the same without accents if that is another."""
    plain = without_accents(text)
    return [text] if plain == text else [text, plain]


def sample(texts: DataFrame, text_col: str, bound: int) -> list[str]:
    """At most `bound` different texts, those of the lowest hashes, whatever the order of the rows.

    A threshold on the hash, from the number of different texts, keeps what leaves the tasks near the bound, whatever the
    size of the table and however often a text is repeated.
    """
    rows = texts.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    many = rows.agg(F.approx_count_distinct("h")).first()[0]
    low = min(int(1.5 * bound / max(many, 1) * 2**64), 2**64 - 1) - 2**63
    found = sorted((r.h, r.text) for r in rows.where(F.col("h") <= low).distinct().collect())
    return [t for _, t in found[:bound]]


def fit_on_sample(clean: DataFrame | None, text_col: str, unlabelled: DataFrame | None = None, docs: int = FIT_DOCS, more: int = FIT_UNLABELLED) -> Weights:
    """The classifier from the labelled text and bounded samples of two tables, either of which may be missing or empty.

    clean: texts that are clean by who wrote them, at most `docs` of them. unlabelled: others, at most `more`.
    """
    return fit_on_texts(sample(clean, text_col, docs) if clean is not None else [], sample(unlabelled, text_col, more) if unlabelled is not None else [])


def fit_on_texts(clean: list[str], unlabelled: list[str] | tuple[str, ...] = (), own: bool = True) -> Weights:
    """The classifier from the labelled text, further texts that are clean, and texts without a label.

    Of both, a sentence that the labelled text alone says is abusive does not train, however often it repeats.
    """
    abusive, labelled = training(own)
    first = fit(abusive, labelled)
    kept = labelled
    for texts in (clean, unlabelled):
        new = sorted({s for text in texts for s in normalised(text)})
        if new:
            scores = first.scores(first.table(), [[s] for s in new])
            bar = SURE_ABUSE if texts is clean else 0.0
            kept = kept + sorted({n for s, z in zip(new, scores, strict=True) if z < bar for x in (s, without_accents(s), misread(s)) for n in normalised(x)})
            first = fit(abusive, kept)
    return first


def save(spark: SparkSession, weights: Weights, path: str) -> None:
    """Writes a fitted classifier, a row per n-gram."""
    rows = pd.DataFrame({"hash": weights.hashes.view(np.int64), "value": weights.values.astype(np.float64), "bias": weights.bias})
    spark.createDataFrame(rows, "hash long, value double, bias double").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Weights:
    """A saved classifier; its rows are the n-grams of the bounded training text."""
    rows = spark.read.parquet(path).toPandas().sort_values("hash")
    hashes = rows["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Weights(hashes[order], rows["value"].to_numpy(np.float32)[order], float(rows["bias"].iloc[0]))


def score(documents: DataFrame, id_col: str, text_col: str, weights: Weights, keep: list[str] | None = None) -> DataFrame:
    """(id, kept columns, score) of every document: the probability that it holds abusive content.

    Null, empty and blank texts score 0. One pass without a shuffle; repeated rows give repeated rows.
    """
    keep = keep or []
    fields = [documents.schema[c] for c in [id_col, *keep]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.table()
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                docs = [normalised(t) if t else [] for t in part.column(part.num_columns - 1).to_pylist()]
                s = 1 / (1 + np.exp(-np.clip(weights.scores(table, docs), -60, 60)))
                s = np.where([bool(d) for d in docs], s, 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(s, pa.float64())], names=[f.name for f in fields] + ["score"])

    return documents.select(id_col, *keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def rates(scored: DataFrame, source_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(source, documents, abusive, rate) of scored documents; a null source is a group of its own."""
    flag = F.col("score") >= threshold
    return scored.groupBy(source_col).agg(F.count(F.lit(1)).alias("documents"), F.count_if(flag).alias("abusive"), F.round(F.avg(flag.cast("double")), 6).alias("rate"))

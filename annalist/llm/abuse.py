"""Problem 10: abusive, hateful or sexual content, by multiple-instance learning.

A document is a bag of sentences.  A sentence has a probability from a linear model over its words, pairs of words and
pieces of words, after disguises are undone; a document's probability is the noisy-or of its sentences.  Only documents
carry labels: the model is trained through the noisy-or, which lets it find the sentences that earn a document its
label, and the same sentence scores then locate the offence.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.llm.mixing import source_key
from annalist.session import cut, ship

#: The classifier is fitted on at most this many labelled documents, chosen by the hash of their id.
TRAIN_DOCS = 12_000
#: Documents without a label that stand in as mostly clean background, and their weight together, as a share of that
#: of all labels.
BACKGROUND_DOCS = 6_000
BACKGROUND_SHARE = 0.25
#: Characters of the documents of both kinds together.
TRAIN_CHARS = 80_000_000
#: Models, each fitted without the labels of one part of the documents.
FOLDS = 5
BITS = 18
SIZE = 1 << BITS
#: Documents from this score on are flagged.
THRESHOLD = 0.5
BATCH = 500
_SENTENCE = re.compile(r"[^\n]+?(?:[.!?…]+(?=\s)|;(?=\s)|(?=\n)|$)")
_SPACED = re.compile(r"(?<![^\W_])[^\W_]([ ._*-])[^\W_](?:\1[^\W_]){2,}(?![^\W_])")
_WORD = re.compile(r"[^\W_](?:[\w*@$+!'’|]*[\w*])?")
# Letters that look like Latin ones, and signs that stand for letters.
_ALIKE = str.maketrans("аеорсухіјѕԁһӏкмтвнгАЕОРСУХІЈЅКМТВНαορενικτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhlkmtbhrAEOPCYXIJSKMTBHaopevikTuABEZHIKMNOPTYX".replace("T", "t", 1))
_HIDDEN = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x180E, 0x34F])
_LEET = str.maketrans("013457@$+!|8", "oieastasTiib".replace("T", "t"))
_RUNS = re.compile(r"(.)\1+")


def open_text(text: str) -> str:
    """The text without hidden signs, look-alike letters and letters set apart."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text.translate(_HIDDEN).translate(_ALIKE))

    def join(m: re.Match) -> str:
        x = re.sub(r"[ ._*-]", "", m[0])
        return x if sum(c.isalpha() for c in x) * 2 > len(x) else m[0]

    return _SPACED.sub(join, text)


def open_word(w: str) -> str:
    """A word in lower case without accents, digits for letters, and repeated letters."""
    w = w.lower()
    if any(c.isalpha() for c in w) and not w.isalpha():
        w = w.translate(_LEET)
    if not w.isascii():
        w = "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))
    return _RUNS.sub(r"\1", w)


def _hash(x: str) -> int:
    return zlib.crc32(x.encode()) & (SIZE - 1)


def word_features(w: str, watch: dict[str, str]) -> list[int]:
    if not any(c.isalpha() for c in w):
        return [_hash("<number>")]
    f = [_hash("w " + w)]
    if len(w) > 3:
        b = f"<{w}>"
        f += [_hash("g " + b[i : i + 4]) for i in range(len(b) - 3)]
    if w in watch:
        f += [_hash("watched"), _hash("watched " + watch[w])]
    return f


def watch_list(rows: list[tuple[str, str]]) -> dict[str, str]:
    return {open_word(t.strip()): c for t, c in rows if t and t.strip() and c}


class Words:
    """Words met so far: hashed features, a hash for pairs, and (once weighted) the scores of the word by itself."""

    def __init__(self, watch: dict[str, str], weights: np.ndarray | None = None):
        self.watch, self.weights = watch, weights
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.features: list[list[int]] = []
        self.pair: list[int] = []
        self.score = np.zeros((len(self.weights) if self.weights is not None else 1, 1024))

    def of(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words), dtype=np.int64)
        index = self.index
        for i, w in enumerate(words):
            k = index.get(w)
            if k is None:
                k = self._new(w)
            out[i] = k
        return out

    def _new(self, w: str) -> int:
        o = open_word(w)
        k = self.index[w] = len(self.pair)
        f = word_features(o, self.watch)
        self.pair.append(zlib.crc32(("p " + (o if any(c.isalpha() for c in o) else "<number>")).encode()))
        if self.weights is None:
            self.features.append(f)
        else:
            if k == self.score.shape[1]:
                self.score = np.concatenate([self.score, np.zeros_like(self.score)], axis=1)
            self.score[:, k] = self.weights[:, f].sum(axis=1)
        return k


def sentences(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Words of all texts, the sentence of each word, the text of each sentence, and where each sentence stands.

    Positions refer to the text with disguises undone.  What has no word that begins with a letter is no sentence.
    """
    words: list[str] = []
    counts: list[int] = []
    docs: list[int] = []
    spans: list[tuple[int, int]] = []
    for i, t in enumerate(texts):
        for m in _SENTENCE.finditer(t):
            w = _WORD.findall(m[0])
            if any(c[0].isalpha() for c in w):
                words += w
                counts.append(len(w))
                docs.append(i)
                spans.append(m.span())
    return words, np.repeat(np.arange(len(counts)), counts), np.array(docs, dtype=np.int64), spans


def pairs(ids: np.ndarray, sentence: np.ndarray, pair_hash: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of neighbouring and next-but-one words, and the sentence of each."""
    h = pair_hash[ids].astype(np.uint64)
    out, of = [], []
    for gap in (1, 2):
        same = sentence[gap:] == sentence[:-gap]
        x = (h[:-gap] * np.uint64(0x9E3779B1) + h[gap:] * np.uint64(0x85EBCA77) + np.uint64(gap)) >> np.uint64(7)
        out.append((x & np.uint64(SIZE - 1)).astype(np.int64)[same])
        of.append(sentence[gap:][same])
    return np.concatenate(out), np.concatenate(of)


def fold_of(text: str, folds: int) -> int:
    """Fold of a text; copies share it."""
    return zlib.crc32(text.encode()) % folds


class Model:
    """One linear model per fold, each fitted without the texts of its fold.

    Every document is scored by the model of its own fold, so that no labelled document, nor a copy of it, is judged by
    a model that has seen its label.
    """

    def __init__(self, weights: np.ndarray, bias: np.ndarray, threshold: float, watch: dict[str, str]):
        self.weights, self.bias, self.threshold, self.watch = weights, bias, threshold, watch
        self.words = Words(watch, weights)

    def sentence_scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """Probability of each sentence of the opened texts, its text, and its place."""
        words, sentence, docs, spans = sentences(texts)
        if not words:
            return np.zeros(0), docs, spans
        if len(self.words.pair) > 500_000:
            self.words.reset()  # the cache of words is bounded
        ids = self.words.of(words)
        fold = np.array([fold_of(t, len(self.weights)) for t in texts])[docs]
        s = np.bincount(sentence, weights=self.words.score[fold[sentence], ids], minlength=len(docs)) + self.bias[fold]
        f, of = pairs(ids, sentence, np.asarray(self.words.pair))
        s += np.bincount(of, weights=self.weights[fold[of], f], minlength=len(docs))
        return 1.0 / (1.0 + np.exp(-np.clip(s, -30, 30))), docs, spans


#: How sure a sentence has to be to count in full: a smooth weight p / (p + SOFT) keeps long clean texts from adding up to
#: an offence.  Training and scoring use the same bag.
SOFT = 0.02


def bag_scores(p: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """Noisy-or of the weighted sentences."""
    return noisy_or(p * p / (p + SOFT), docs, n)


def bag_slope(p: np.ndarray) -> np.ndarray:
    """Change of a bag with the score of a sentence, as a share of the chance 1 - P that is left."""
    return p * p * (p + 2 * SOFT) * (1 - p) / ((p + SOFT) * (p + SOFT - p * p))


def noisy_or(p: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    return 1.0 - np.exp(np.bincount(docs, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))


#: Raters err: chance that a clean document is called toxic, and that a toxic one is called clean.
FALSE_YES, FALSE_NO = 0.06, 0.06


class Bags:
    """Training sentences: words and pairs of words per sentence, features per distinct word."""

    def __init__(self, texts: list[str], watch: dict[str, str]):
        table, parts, n_s = Words(watch), [], 0
        for at in range(0, len(texts), BATCH):
            words, sentence, docs, _ = sentences(texts[at : at + BATCH])
            if not words:
                continue
            ids = table.of(words)
            f, of = pairs(ids, sentence, np.array(table.pair))
            parts.append([x.astype(np.int32) for x in (ids, sentence + n_s, docs + at, f, of + n_s)])
            n_s += len(docs)
        joined = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, dtype=np.int32)] * 5
        self.ids, self.sentence, self.docs, self.pair_feature, self.pair_of = joined
        self.n = len(texts)
        self.word_of = np.repeat(np.arange(len(table.features), dtype=np.int32), [len(f) for f in table.features])
        self.word_feature = np.fromiter((x for f in table.features for x in f), dtype=np.int32, count=len(self.word_of))
        # What only one document has says nothing about others.
        doc = self.docs[self.sentence]
        low, high = np.full(len(table.features), self.n), np.full(len(table.features), -1)
        np.minimum.at(low, self.ids, doc)
        np.maximum.at(high, self.ids, doc)
        first, last = np.full(SIZE, self.n), np.full(SIZE, -1)
        np.minimum.at(first, self.word_feature, low[self.word_of])
        np.maximum.at(last, self.word_feature, high[self.word_of])
        doc = self.docs[self.pair_of]
        np.minimum.at(first, self.pair_feature, doc)
        np.maximum.at(last, self.pair_feature, doc)
        self.shared = first < last
        # Their weights stay 0, so the passes leave them out.
        kept = self.shared[self.word_feature]
        self.word_of, self.word_feature = self.word_of[kept], self.word_feature[kept]
        kept = self.shared[self.pair_feature]
        self.pair_feature, self.pair_of = self.pair_feature[kept], self.pair_of[kept]

    def scores(self, w: np.ndarray, b: float) -> np.ndarray:
        by_word = np.bincount(self.word_of, weights=w[self.word_feature], minlength=int(self.ids.max(initial=-1)) + 1)
        s = np.bincount(self.sentence, weights=by_word[self.ids], minlength=len(self.docs))
        return s + np.bincount(self.pair_of, weights=w[self.pair_feature], minlength=len(self.docs)) + b

    def gradient(self, g: np.ndarray) -> np.ndarray:
        """Of all weights, from that of the sentence scores."""
        by_word = np.bincount(self.ids, weights=g[self.sentence], minlength=int(self.word_of.max(initial=-1)) + 1)
        out = np.bincount(self.word_feature, weights=by_word[self.word_of], minlength=SIZE)
        return out + np.bincount(self.pair_feature, weights=g[self.pair_of], minlength=SIZE)


def _descend(bags: Bags, y: np.ndarray, weight: np.ndarray, epochs: int, rate: float, l2: float) -> tuple[np.ndarray, float]:
    """Adagrad on the log loss of noisy-or under labels that are wrong now and then; every step sees all bags.

    A label says yes with probability q = FALSE_YES + (1 - FALSE_YES - FALSE_NO) P.  A clean document called toxic then
    pulls only weakly on sentences that nothing else speaks against, instead of forcing them up.
    """
    w, b = np.zeros(SIZE), -4.0
    h, hb = np.full(SIZE, 1e-6), 1e-6
    total = weight.sum()
    slope = 1 - FALSE_YES - FALSE_NO
    for _ in range(epochs):
        p = 1.0 / (1.0 + np.exp(-np.clip(bags.scores(w, b), -30, 30)))
        bag = np.clip(bag_scores(p, bags.docs, bags.n), 1e-6, 1 - 1e-9)
        # d P / d s of a sentence is slope (1 - P); d loss / d P is (1 - y) / (1 - q) - y / q, times the slope of q.
        q = FALSE_YES + slope * bag
        g = bag_slope(p) * ((1 - bag) * slope * ((1 - y) / (1 - q) - y / q) * weight)[bags.docs]
        grad = np.where(bags.shared, bags.gradient(g) / total + l2 * w, 0.0)
        gb = g.sum() / total
        h += grad**2
        hb += gb * gb
        w -= rate * grad / np.sqrt(h)
        b -= 0.3 * rate * gb / np.sqrt(hb)
    return w, float(b)


def fit_fold(texts: list[str], y: np.ndarray, weight: np.ndarray, watch: dict[str, str], k: int, epochs: int = 60, rate: float = 0.25, l2: float = 3e-6) -> tuple[np.ndarray, float]:
    """Weights and bias of the model of fold ``k``, which has not seen the labels of the texts of that fold."""
    opened = [open_text(t) for t in texts]
    seen = [i for i, t in enumerate(opened) if fold_of(t, FOLDS) != k]
    return _descend(Bags([opened[i] for i in seen], watch), y[seen], weight[seen], epochs, rate, l2)


def _one_per_task(spark: SparkSession) -> list[int]:
    """For each fold a key that ``repartition(FOLDS, key)`` sends to a partition of its own."""
    d = spark.range(64 * FOLDS).groupBy(F.expr(f"pmod(hash(id), {FOLDS})").alias("p")).agg(F.min("id").alias("k"))
    return [r["k"] for r in d.orderBy("p").collect()]


def sample(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The bounded sample a model is fitted on: ``doc_id``, ``text``, ``yes``, ``n`` (opinions, 0 for the background).

    At most TRAIN_DOCS labelled documents, BACKGROUND_DOCS others and TRAIN_CHARS characters, by the hash of their ids.
    """
    votes = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.sum(F.col("toxic").cast("double")).alias("yes"), F.count(F.lit(1)).alias("n"))
    votes = votes.withColumn("h", F.xxhash64("doc_id", F.lit(3))).orderBy("h", "doc_id").limit(TRAIN_DOCS)
    d = documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    own = d.join(F.broadcast(votes), "doc_id").select("doc_id", "text", "yes", "n", "h")
    rest = d.join(labels.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "text", F.lit(0.0).alias("yes"), F.lit(0).cast("bigint").alias("n"), F.xxhash64("doc_id", F.lit(4)).alias("h"))
    chosen = cut(own.unionByName(rest.orderBy("h", "doc_id").limit(BACKGROUND_DOCS)), "sample")
    # At most TRAIN_DOCS + BACKGROUND_DOCS rows, without their texts.
    w = Window.orderBy("h", "doc_id")
    kept = chosen.select("doc_id", "h", F.length("text").alias("k")).withColumn("upto", F.sum("k").over(w)).where(F.col("upto") <= TRAIN_CHARS).select("doc_id")
    return chosen.join(F.broadcast(kept), "doc_id", "left_semi").drop("h")


def fit(documents: DataFrame, labels: DataFrame, watch_terms: DataFrame) -> Model:
    """The classifier from a bounded sample of labelled documents, one fold per task.

    Each opinion of a rater counts as one label; a document on which raters differ is thus half and half.  Without any
    label only the watched terms speak.  ``watch_terms`` is a list made by hand, all of which is used.
    """
    spark = documents.sparkSession
    watch = watch_list([(r["term"], r["category"]) for r in watch_terms.select("term", "category").collect()])
    d = cut(sample(documents, labels), "sample")
    opinions, n_rest = d.agg(F.sum("n"), F.count_if(F.col("n") == 0)).first()
    if not opinions:
        w = np.zeros((1, SIZE), dtype=np.float32)
        w[0, _hash("watched")] = 6.0
        return Model(w, np.array([-4.0]), THRESHOLD, watch)
    light = min(0.5, BACKGROUND_SHARE * float(opinions) / max(1, n_rest))
    keys = _one_per_task(spark)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(parts)
        if parts:
            pdf = pd.concat(parts).sort_values("doc_id")
            n = pdf["n"].to_numpy(dtype=float)
            y = pdf["yes"].to_numpy() / np.maximum(n, 1)
            k = keys.index(int(pdf["key"].iloc[0]))
            w, b = fit_fold(pdf["text"].tolist(), y, np.where(n > 0, n, light), watch, k)
            yield pd.DataFrame({"k": [k], "w": [w.astype(np.float32).tobytes()], "b": [b]})

    ship(spark)
    # The sample is bounded, so each fold may have all of it in one task.
    spread = d.withColumn("key", F.explode(F.array(*[F.lit(k) for k in keys]))).repartition(FOLDS, "key")
    fits = sorted(spread.mapInPandas(run, "k int, w binary, b double").collect(), key=lambda r: r["k"])
    return Model(np.stack([np.frombuffer(r["w"], dtype=np.float32) for r in fits]), np.array([r["b"] for r in fits]), THRESHOLD, watch)


_WORKER: dict = {}


def _load(sent) -> Model:
    """The model of this worker process; ``sent`` names it by a digest of all it holds."""
    key, weights, bias, threshold, watch = sent.value
    if _WORKER.get("key") != key:
        _WORKER["model"], _WORKER["key"] = Model(weights, bias, threshold, watch), key
    return _WORKER["model"]


def origin(text: str) -> tuple[str, list[int]]:
    """``open_text`` of a text, and where each of its characters stands in the text (empty where that cannot be told)."""
    opened = open_text(text)
    chars = [(c, i) for i, c in enumerate(text)]
    if not text.isascii():
        chars = [(x, i) for c, i in chars for x in c.translate(_HIDDEN).translate(_ALIKE)]
        joined: list[tuple[str, int]] = []
        at = 0
        while at < len(chars):
            end = at + 1
            while end < len(chars) and unicodedata.combining(chars[end][0]):
                end += 1
            joined += [(x, chars[at][1]) for x in unicodedata.normalize("NFC", "".join(c for c, _ in chars[at:end]))]
            at = end
        chars = joined
    plain = "".join(c for c, _ in chars)
    gone: set[int] = set()
    for m in _SPACED.finditer(plain):
        letters = [k for k in range(*m.span()) if plain[k] not in " ._*-"]
        if sum(plain[k].isalpha() for k in letters) * 2 > len(letters):
            gone |= set(range(*m.span())) - set(letters)
    chars = [x for k, x in enumerate(chars) if k not in gone]
    return opened, [i for _, i in chars] if "".join(c for c, _ in chars) == opened else []


def as_it_stands(text: str, start: int, end: int) -> str:
    """The part of a text whose opened form is ``open_text(text)[start:end]``; that form where it cannot be found."""
    opened, at = origin(text)
    if not at:
        return opened[start:end].strip()
    past = at[end] if end < len(at) else len(text)
    return text[at[start] : past].strip()


def score(documents: DataFrame, model: Model, located: bool = False) -> DataFrame:
    """``doc_id``, ``score``, ``n_sentences``, ``flagged`` of every document; with ``located`` one row per offending
    sentence of flagged documents instead: ``doc_id``, ``sentence_no``, ``sentence`` (as it stands), ``score``.

    Null and empty texts score 0.
    """
    ship(documents.sparkSession)
    key = hashlib.sha256(pickle.dumps((model.weights.tobytes(), model.bias.tobytes(), model.threshold, sorted(model.watch.items())))).hexdigest()
    sent = documents.sparkSession.sparkContext.broadcast((key, model.weights, model.bias, model.threshold, model.watch))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = _load(sent)
        for pdf in parts:
            for at in range(0, len(pdf), BATCH):
                some = pdf.iloc[at : at + BATCH]
                texts = [open_text(t) if t else "" for t in some["text"]]
                p, docs, spans = m.sentence_scores(texts)
                bag = bag_scores(p, docs, len(texts)) if len(p) else np.zeros(len(texts))
                ids = some["doc_id"].to_numpy()
                if not located:
                    yield pd.DataFrame({"doc_id": ids, "score": bag, "n_sentences": np.bincount(docs, minlength=len(texts)).astype(np.int64), "flagged": bag >= m.threshold})
                    continue
                first = np.searchsorted(docs, np.arange(len(texts)))
                best = np.zeros(len(texts))
                np.maximum.at(best, docs, p)
                hit = np.flatnonzero((bag >= m.threshold)[docs] & ((p >= 0.5) | (p >= best[docs])))
                yield pd.DataFrame({"doc_id": ids[docs[hit]], "sentence_no": hit - first[docs[hit]], "sentence": [as_it_stands(some["text"].iloc[docs[k]], *spans[k]) for k in hit], "score": p[hit]})

    schema = "doc_id bigint, sentence_no bigint, sentence string, score double" if located else "doc_id bigint, score double, n_sentences bigint, flagged boolean"
    return documents.select("doc_id", "text").where("doc_id IS NOT NULL").mapInPandas(run, schema)


def found(documents: DataFrame, labels: DataFrame, watch_terms: DataFrame) -> DataFrame:
    """p10_found: the documents whose score reaches the threshold."""
    return score(documents, fit(documents, labels, watch_terms)).where("flagged").select("doc_id")


def rates(documents: DataFrame, scored: DataFrame) -> DataFrame:
    """Documents, flagged documents, their share and the mean score per source (spellings unified; '' for none)."""
    d = scored.join(documents.select("doc_id", F.coalesce(source_key(F.col("source")), F.lit("")).alias("src")), "doc_id")
    n = F.sum(F.col("flagged").cast("bigint"))
    return d.groupBy(F.col("src").alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), n.alias("n_flagged"), F.round(n / F.count(F.lit(1)), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))

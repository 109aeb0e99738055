"""Finding and replacing personal items over whole tables."""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.pii import crf, weak
from annalist.llm.pii.tokens import ARTICLES, BA, BP, EMAIL, IA, ID, IP, PARTICLES, PHONE, STREETS, TITLES, email_parts, shared_mailbox
from annalist.session import ship

#: The model is fitted on at most this many texts, chosen by the hash of their row.
TRAIN_TEXTS = 5_000
TRAIN_AUTHORS = 2_500
#: Longest piece of a text in the sample.
PIECE = 4_000
BATCH = 2_000
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person": "[PERSON]"}


def texts(events: DataFrame, commits: DataFrame) -> DataFrame:
    """``tbl``, ``row_id``, ``field``, ``text`` of all fields that may hold personal items; null and empty ones have
    nothing to find and are left out."""
    e = events.select(F.lit("event_log").alias("tbl"), "row_id", F.inline(F.array(F.struct(F.lit("body").alias("field"), F.col("body").alias("text")), F.struct(F.lit("summary").alias("field"), F.col("summary").alias("text")))))
    c = commits.select(F.lit("commits").alias("tbl"), "row_id", F.lit("author").alias("field"), F.col("author").alias("text"))
    return e.unionByName(c).where("row_id IS NOT NULL AND text IS NOT NULL AND text <> ''").withColumn("row_id", F.col("row_id").cast("bigint"))


def _sample(df: DataFrame, text: str, n: int) -> list[str]:
    """At most ``n`` pieces of at most PIECE characters, by hash: every text takes part, a long one with several pieces."""
    pieces = F.regexp_extract_all(F.col(text), F.lit(rf"(?s).{{1,{PIECE}}}(?=\s|\z)|\S{{{PIECE}}}"), F.lit(0))
    d = df.where(F.col(text).isNotNull()).select("row_id", F.posexplode(F.when(F.length(text) <= PIECE, F.array(F.col(text))).otherwise(pieces)).alias("k", "t"))
    return [r["t"] for r in d.select(F.xxhash64("row_id", "k", F.lit(5)).alias("h"), "t").orderBy("h", "t").limit(n).collect()]


def given_names(commits: DataFrame) -> frozenset[str]:
    """Given names of the authors of all commits, each met twice or more.

    Authors are counted batch by batch where they are read; only the names that pass reach the driver.
    """
    ship(commits.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            n = pdf["author"].value_counts()
            d = pd.DataFrame({"name": [weak.given_name(a) for a in n.index], "n": n.to_numpy(dtype=np.int64)})
            yield d.dropna().groupby("name", as_index=False)["n"].sum()

    d = commits.where("author IS NOT NULL").select("author").mapInPandas(run, "name string, n bigint")
    return frozenset(r["name"] for r in d.groupBy("name").agg(F.sum("n").alias("n")).where("n >= 2").select("name").collect())


def fit(events: DataFrame, commits: DataFrame) -> crf.Model | None:
    """The field model, fitted on a bounded sample with labels from the rules and the given names of all authors; None
    where there is no text at all."""
    authors = _sample(commits, "author", TRAIN_AUTHORS)
    bodies = _sample(events.select("row_id", F.concat_ws("\n", "body", "summary").alias("t")), "t", TRAIN_TEXTS)
    chosen = [t for t in bodies + authors if t]
    if not chosen:
        return None
    given = given_names(commits)
    evident = weak.evident_shapes(chosen)
    return crf.train(chosen, [weak.label(t, given, evident) for t in chosen], given)


def _exact(kind: int, text: str, start: int, end: int) -> tuple[int, int] | None:
    """The item's exact borders, or None where the labelled text cannot be an item of its kind."""
    while start < end and text[start].isspace():
        start += 1
    x = text[start:end]
    if kind == EMAIL:
        return (start, end) if email_parts(x) and not shared_mailbox(x) else None
    if kind == PHONE:
        m = re.match(r"\(+(?!\d+\))", x)
        if m:
            start += len(m[0])
            x = text[start:end]
        last = max((i for i, c in enumerate(x) if c.isdigit()), default=-1)
        return (start, start + last + 1) if sum(c.isdigit() for c in x) >= 6 else None
    if kind == ID:
        x2 = x.strip("()")
        return (start + x.index(x2), start + x.index(x2) + len(x2)) if sum(c.isdigit() for c in x2) >= 5 else None
    while start < end and not text[start].isalnum():
        start += 1
    x = text[start:end]
    if kind == BP:
        m = re.match(r"(?:(\w+)\.?\s+)", x)
        if m and m[1].lower() in TITLES and len(m[1]) > 1:
            start += len(m[0])
        while end > start and not text[end - 1].isalnum():
            end -= 1
        words = re.findall(r"[^\W\d_]+", text[start:end])
        if words and words[-1].lower() in PARTICLES and (m := re.match(r"(?:\s+(?:[a-z]{2,3}\s+)?)[^\W\d_][\w'’-]+", text[end:])):
            end += len(m[0])  # a name does not end with a particle
            words = re.findall(r"[^\W\d_]+", text[start:end])
        return (start, end) if len(words) >= 2 and sum(len(w) > 1 for w in words) >= 1 else None
    x = text[start:end]
    if x[:1].isdigit():
        # Behind a house number the street ends with the word for its kind, unless it begins with it.
        kinds = [w for w in re.finditer(r"[^\W\d_]+", x) if w[0].lower() in STREETS]
        if kinds and kinds[0].start() > len(re.match(r"\d+[A-Za-z]?\s*", x)[0]):
            rest = re.match(r"\.?(?: (?:[NSEW]|NE|NW|SE|SW)\b)?", x[kinds[-1].end() :])
            end = start + kinds[-1].end() + len(rest[0])
            x = text[start:end]
    if (words := re.findall(r"[^\W\d_]+", x)) and words[-1].lower() in ARTICLES and (m := re.match(r"\s+(?:[a-z]{1,3}[ '’]\s*)*[^\W\d_a-z][\w'’-]*(?: [^\W\d_a-z][\w'’-]*)*", text[end:])):
        end += len(m[0])  # a street does not end with an article
        x = text[start:end]
    short = re.search(r"(?i)\b(?:st|ave|rd|blvd|ln|dr|ct|pl|sq)\.$", x)
    while end > start and not text[end - 1].isalnum() and not (short and text[end - 1] == "."):
        end -= 1
    if text[end : end + 1] == "." and re.search(r"\b(?:St|Ave|Rd|Ln|Ct|Pl|Sq)$", text[start:end]):
        end += 1
    x = text[start:end].lower()
    if re.search(r"[^\W\d_]{4,}[.!?;] ", x):
        return None  # it runs over the end of a sentence
    return (start, end) if re.search(r"\d", x) and re.search(r"[^\W\d_]{2}", x) else None


def spans(model: crf.Model, batch: list[str]) -> Iterator[tuple[int, str, int, int]]:
    """(text number, kind, start, end) of every item, in order."""
    tokens, doc, start = crf.tokenize(batch)
    if not tokens:
        return
    y = model.label(model.types.of(tokens), doc)
    at = np.flatnonzero(y)
    names = {EMAIL: "email", PHONE: "phone", ID: "id_number", BP: "person", BA: "address"}
    i = 0
    while i < len(at):
        k = at[i]
        kind = int(y[k])
        j = i + 1
        inner = {BP: IP, BA: IA}.get(kind)
        while inner and j < len(at) and at[j] == at[j - 1] + 1 and doc[at[j]] == doc[k] and y[at[j]] == inner:
            j += 1
        last = at[j - 1]
        i = j
        if kind not in names:
            continue
        text = batch[doc[k]]
        found = _exact(kind, text, int(start[k]), int(start[last]) + len(tokens[last]))
        if found:
            yield int(doc[k]), names[kind], *found


def _with_model(model: crf.Model, spark: SparkSession):
    ship(spark)
    parts = (model.own, model.keys, model.given, model.w_own, model.w_key, model.trans, model.skip)
    key = hashlib.sha256(pickle.dumps((list(model.own), list(model.keys), sorted(model.given), *(x.tobytes() for x in parts[3:])))).hexdigest()
    return spark.sparkContext.broadcast((key, *parts))


#: The model of this worker process and what it was loaded from.
_WORKER: dict = {}


def _load(sent) -> crf.Model:
    key, own, keys, given, w_own, w_key, trans, skip = sent.value
    held = _WORKER.get("model") if _WORKER.get("key") == key else None
    if held is None:
        held = crf.Model(own, keys, given)
        held.w_own, held.w_key, held.trans, held.skip = w_own, w_key, trans, skip
        held.prepare()
        _WORKER["model"], _WORKER["key"] = held, key
    if len(held.types.rows) > 400_000:
        held.prepare()  # the cache of tokens is bounded
    return held


def find(fields: DataFrame, model: crf.Model) -> DataFrame:
    """Distinct items: ``tbl``, ``row_id``, ``field``, ``kind``, ``item``."""
    sent = _with_model(model, fields.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            m = _load(sent)
            rows = []
            for at in range(0, len(pdf), BATCH):
                cut = pdf.iloc[at : at + BATCH]
                t = cut["text"].tolist()
                meta = list(zip(cut["tbl"], cut["row_id"], cut["field"]))
                rows += [(*meta[i], kind, t[i][a:b]) for i, kind, a, b in spans(m, t)]
            out = pd.DataFrame(rows, columns=["tbl", "row_id", "field", "kind", "item"])
            # All items of a field come from one row, so repeated ones meet here without a shuffle.
            yield out.drop_duplicates()

    return fields.mapInPandas(run, "tbl string, row_id bigint, field string, kind string, item string")


def redact(fields: DataFrame, model: crf.Model) -> DataFrame:
    """Texts with every item replaced by its placeholder: ``tbl``, ``row_id``, ``field``, ``text``, ``n_items``."""
    sent = _with_model(model, fields.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            m = _load(sent)
            new, counts = [], []
            for at in range(0, len(pdf), BATCH):
                t = pdf["text"].iloc[at : at + BATCH].tolist()
                found: dict[int, list] = {}
                for i, kind, a, b in spans(m, t):
                    found.setdefault(i, []).append((a, b, kind))
                for i, x in enumerate(t):
                    out, end = [], 0
                    for a, b, kind in sorted(found.get(i, ())):
                        out += [x[end:a], PLACEHOLDER[kind]]
                        end = b
                    new.append("".join([*out, x[end:]]))
                    counts.append(len(found.get(i, ())))
            yield pdf.assign(text=new, n_items=np.array(counts, dtype=np.int64))[["tbl", "row_id", "field", "text", "n_items"]]

    return fields.mapInPandas(run, "tbl string, row_id bigint, field string, text string, n_items bigint")


def _empty(fields: DataFrame) -> DataFrame:
    return fields.select("tbl", "row_id", "field", F.lit("").alias("kind"), F.lit("").alias("item")).limit(0)


def found(events: DataFrame, commits: DataFrame) -> DataFrame:
    """p4_found: one row for each distinct personal item in a field.  Empty tables give no rows."""
    fields = texts(events, commits)
    model = fit(events, commits)
    return find(fields, model) if model is not None else _empty(fields)


def redacted(events: DataFrame, commits: DataFrame) -> DataFrame:
    """p4_redacted: every text field with typed placeholders instead of its items."""
    fields = texts(events, commits)
    model = fit(events, commits)
    return redact(fields, model) if model is not None else fields.withColumn("n_items", F.lit(0).cast("bigint"))

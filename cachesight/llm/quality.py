"""Quality classifier with hierarchical empirical Bayes.

A document's own evidence is the log-odds of two logistic models, of junk and of toxic text, over measures of its form
and over a lexicon of words and word beginnings that tell labelled documents apart. Hosts (``source``) and paths
(``source`` and ``lang``) get posteriors from sums over their documents: a path shrinks toward its host and a host toward
the whole, the more the fewer documents it has. A document's log-odds move by its path's posterior against the whole, from
the sums without the document itself.

The models are fitted on at most ``sample`` labelled documents, those of the smallest hashes of their ids. Lexicon and
coefficients have a fixed size; everything else covers all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cachesight.llm.common import WordHashes, chunks, materialize, stand_in, table, tidy, without

SAMPLE = 20_000
#: Entries of the lexicon for each model; least z-score, log-odds, documents and share of the bad documents of an entry.
LEXICON, LEAST_Z, LEAST_ODDS, LEAST_DOCS, LEAST_SHARE = 192, 5.0, 1.5, 4, 0.02
PREFIXES = (4, 5, 6)
HEADS = ("junk", "toxic")
#: What the decision on a document depends on.
DECIDING = ["text", "source", "lang"]
FORM = ("upper", "punctuation", "digits", "marks", "bars", "signs", "distinct", "repeats", "top", "length", "words", "empty")

_b = np.arange(256)
_LETTER_OR_DIGIT = (_b >= 48) & (_b <= 57) | (_b >= 65) & (_b <= 90) | (_b >= 97) & (_b <= 122) | (_b >= 128)
_CLASSES = {
    "upper": (_b >= 65) & (_b <= 90), "punctuation": ~_LETTER_OR_DIGIT & (_b > 32), "digits": (_b >= 48) & (_b <= 57),
    "marks": _b == ord("!"), "bars": _b == ord("|"), "signs": np.isin(_b, np.frombuffer(b"#$%&*@^~", np.uint8)),
}


def _per_text(h: WordHashes, values: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(total[h.offset])


def form(texts: list[bytes]) -> tuple[np.ndarray, WordHashes, np.ndarray]:
    """Measures of form (a row for each text, columns as in FORM), word hashes and each word's text number."""
    h = WordHashes(texts, ~_LETTER_OR_DIGIT)
    n = np.diff(h.first)
    doc = np.repeat(np.arange(len(texts)), n)
    size = np.maximum(np.diff(h.offset) - 1, 1)
    some = np.maximum(n, 1)
    sums = {k: _per_text(h, v[h.bytes]) for k, v in _CLASSES.items()}
    order = np.lexsort((h.words, doc))
    d, w = doc[order], h.words[order]
    new = np.ones(len(w), bool)
    new[1:] = (d[1:] != d[:-1]) | (w[1:] != w[:-1])
    begin = np.flatnonzero(new)
    distinct = np.bincount(d[begin], minlength=len(texts))
    top = np.zeros(len(texts), np.int64)
    np.maximum.at(top, d[begin], np.diff(np.append(begin, len(w))))
    same = np.zeros(len(w), bool)
    same[1:] = (h.words[1:] == h.words[:-1]) & (doc[1:] == doc[:-1])
    repeats = np.bincount(doc, same, len(texts))
    length = np.bincount(doc, h.end - h.start, len(texts))
    x = np.column_stack([sums["upper"] / size, sums["punctuation"] / size, sums["digits"] / size, sums["marks"] / some, sums["bars"] / some, sums["signs"] / some, distinct / some, repeats / some, top / some, length / some, np.log1p(n), n == 0])
    return x.astype(float), h, doc


def tokens(h: WordHashes, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text numbers, hashes) of words and of their beginnings."""
    yield doc, h.words
    for size in PREFIXES:
        longer = h.end - h.start > size
        yield doc[longer], h.prefixes(size)[longer]


def _once(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    new = np.ones(len(k), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    return d[new], k[new]


def _token_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        labels = b[list(HEADS)].to_numpy(np.int64)
        for at, part in chunks(b["text"]):
            _, h, doc = form(part)
            for d, k in tokens(h, doc):
                d, k = _once(d, k)
                keys, where = np.unique(k, return_inverse=True)
                own = labels[at + d]
                yield pd.DataFrame({"token": keys.view(np.int64), "n": np.bincount(where, minlength=len(keys))} | {f"n_{x}": np.bincount(where, own[:, c], len(keys)).astype(np.int64) for c, x in enumerate(HEADS)})


@dataclass
class Model:
    """Logistic coefficients of each head for the standardised measures of form and for the presence of lexicon entries."""

    keys: np.ndarray  # the lexicon, sorted
    mean: np.ndarray
    scale: np.ndarray
    coefficients: np.ndarray  # a row for each head: intercept, form, entries

    def hits(self, h: WordHashes, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text number, entry) pairs."""
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        if len(self.keys):
            for d, k in tokens(h, doc):
                at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
                hit = self.keys[at] == k
                out.append(_once(d[hit], at[hit]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def log_odds(self, texts: list[bytes]) -> np.ndarray:
        x, h, doc = form(texts)
        f = len(FORM)
        z = np.clip((x - self.mean[:f]) / self.scale[:f], -8, 8)
        absent, present = (np.clip((v - self.mean[f:]) / self.scale[f:], -8, 8) for v in (0.0, 1.0))
        c = self.coefficients
        odds = c[:, 0] + z @ c[:, 1 : f + 1].T + c[:, f + 1 :] @ absent
        d, e = self.hits(h, doc)
        for k in range(len(HEADS)):
            odds[:, k] += np.bincount(d, ((present - absent) * c[k, f + 1 :])[e], len(texts))
        return odds


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 25) -> np.ndarray:
    """Newton's method with a ridge penalty on all but the intercept."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled documents. Labels that repeat an id count as bad if one of them is; null labels count as good."""
    bad = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(1 - F.coalesce("quality", F.lit(1))).cast("int").alias("junk"), F.max(F.coalesce("toxic", F.lit(0))).cast("int").alias("toxic"))
    chosen = bad.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # this bounds what is broadcast
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    own = own.groupBy("doc_id").agg(F.min("text").alias("text"), *[F.first(x).alias(x) for x in HEADS])  # a row for each id
    known = materialize(own, "labelled")
    totals = known.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in HEADS]).first()
    if not totals["n"]:
        return Model(np.empty(0, np.uint64), np.zeros(len(FORM)), np.ones(len(FORM)), np.zeros((2, len(FORM) + 1)))
    counts = known.mapInPandas(tidy(_token_counts), "token long, n long, n_junk long, n_toxic long").groupBy("token").agg(*[F.sum(c).alias(c) for c in ("n", "n_junk", "n_toxic")]).where(F.col("n") >= LEAST_DOCS)
    counts = materialize(counts, "token-counts")
    n = totals["n"]
    chosen_tokens = []
    for x in HEADS:
        a, rest = totals[x], n - totals[x]
        if not a or not rest:
            continue
        p = F.col("n") / n
        p1, p0 = (F.col(f"n_{x}") + 10 * p) / (a + 10), (F.col("n") - F.col(f"n_{x}") + 10 * p) / (rest + 10)
        z = (p1 - p0) / F.sqrt(p * (1 - p) * (1 / a + 1 / rest) + 1e-12)
        own = counts.withColumn("z", z).where((F.col("z") >= LEAST_Z) & (F.log(p1 / p0) >= LEAST_ODDS) & (F.col(f"n_{x}") >= LEAST_SHARE * a))
        chosen_tokens += [r.token for r in own.orderBy(F.desc("z"), "token").limit(LEXICON).select("token").collect()]
    keys = np.unique(np.array(chosen_tokens, np.int64).view(np.uint64))
    model = Model(keys, np.empty(0), np.empty(0), np.empty(0))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at, part in chunks(b["text"]):
                own = b.iloc[at : at + len(part)]
                x, h, doc = form(part)
                d, e = model.hits(h, doc)
                order = np.argsort(d, kind="stable")
                entries = np.split(e[order], np.searchsorted(d[order], np.arange(1, len(part))))
                yield pd.DataFrame({"doc_id": own["doc_id"].to_numpy(), "x": list(x), "entries": entries} | {x: own[x].to_numpy() for x in HEADS})

    rows = known.mapInPandas(tidy(measure), "doc_id long, x array<double>, entries array<long>, junk int, toxic int").toPandas()  # at most ``sample``
    rows = rows.sort_values("doc_id", kind="stable")
    x = np.zeros((len(rows), len(FORM) + len(keys)))
    x[:, : len(FORM)] = np.stack(rows["x"].to_numpy())
    for n, e in enumerate(rows["entries"]):
        x[n, len(FORM) + np.asarray(e, int)] = 1
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    model.coefficients = np.stack([fit_logistic(z, rows[k].to_numpy(float)) for k in HEADS])
    return model


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(p / (1 - p))


def score(docs: DataFrame, model: Model, digest: bool = False) -> DataFrame:
    """doc_id, source, lang, junk and toxic (log-odds from the document alone) and bad (the probability of either); with
    ``digest`` also what stands for a null id."""
    own_columns = ["doc_id", "source", "lang", *(["digest"] if digest else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at, part in chunks(b["text"]):
                own = b.iloc[at : at + len(part)]
                o = np.clip(model.log_odds(part), -30, 30)
                good = 1 / (1 + np.exp(o))
                yield pd.DataFrame({c: own[c].to_numpy() for c in own_columns} | {"junk": o[:, 0], "toxic": o[:, 1], "bad": 1 - good.prod(axis=1)})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    wide = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text", *([stand_in(*DECIDING).alias("digest")] if digest else []))
    return wide.mapInPandas(tidy(run), f"doc_id {id_type}, source string, lang string, {'digest string, ' if digest else ''}junk double, toxic double, bad double")


def posteriors(scored: DataFrame) -> DataFrame:
    """source, lang, host and path posteriors of bad documents, and the whole's, with the sums behind them and the prior's weight.

    The prior's weight comes from how far hosts differ beyond chance: with mean m and variance v of their shares, it is
    m (1 - m) / v - 1 documents, at least one. Sums by path are made before the shuffle, so a large host is no large task.
    """
    paths = materialize(scored.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("bad").alias("s")), "paths")
    hosts = paths.groupBy("source").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    share = F.col("host_s") / F.col("host_n")
    whole = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_s").alias("s"), F.var_samp(share).alias("v"), F.avg(1 / F.col("host_n")).alias("one")).first()
    m = min(max(whole.s / whole.n, 1e-6), 1 - 1e-6) if whole.n else 0.5
    chance = m * (1 - m) * (whole.one or 0.0)
    between = max((whole.v or 0.0) - chance, 1e-9)
    weight = min(max(m * (1 - m) / between - 1, 1.0), 1e6)
    host = (F.col("host_s") + weight * m) / (F.col("host_n") + weight)
    both = paths.join(hosts.withColumn("host", host), "source")
    path = (F.col("s") + weight * F.col("host")) / (F.col("n") + weight)
    return both.select("source", "lang", "host", path.alias("path"), F.lit(m).alias("whole"), "n", "s", "host_n", "host_s", F.lit(weight).alias("weight"))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.5, digest: bool = False) -> DataFrame:
    """For each row: doc_id, junk, toxic, host, path, bad (the posterior probability) and keep (bad < ``threshold``); with
    ``digest`` also what stands for a null id.

    Null texts and texts without words are scored by their form; null hosts and languages are groups of their own; repeated
    rows are each scored. Without labels all evidence is neutral and all are kept at a threshold over one half.
    """
    scored = materialize(score(docs, train(docs, labels, sample), digest), "scored")
    joined = scored.join(posteriors(scored), ["source", "lang"])
    # a document's own evidence counts once: the prior of its path comes from the others
    weight = F.col("weight")
    host = (F.col("host_s") - F.col("bad") + weight * F.col("whole")) / (F.col("host_n") - 1 + weight)
    path = (F.col("s") - F.col("bad") + weight * host) / (F.col("n") - 1 + weight)
    odds = _logit(F.col("bad")) + _logit(path) - _logit(F.col("whole"))
    bad = 1 / (1 + F.exp(-odds))
    return joined.select("doc_id", "junk", "toxic", "host", "path", bad.alias("bad"), (bad < threshold).alias("keep"), *(["digest"] if digest else []))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without rejected documents; rows of one id go together if one is rejected, those of a null id each by
    itself."""
    return without(docs, classify(docs, labels, sample, digest=True).where(~F.col("keep")).select("doc_id", "digest"), DECIDING)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return classify(docs, table(spark, sf_dir, "labels")).where("keep")

"""Language identification by multilingual mixture inference.

``learn`` counts character trigrams of a bounded sample of labelled texts for
every language.  In prediction a text is a mixture: each word comes from one
language with the document's proportions.  Expectation-maximisation estimates
the proportions from the words' trigram likelihoods; a language stays in the
document's set only if leaving it out costs more log-likelihood than the
penalty (half the logarithm of the number of words, as in the Bayesian
information criterion); the proportions are then estimated anew over the set.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text if nothing could be learned; repeated rows give the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.tokens import LETTER, classes, text_chunks

CELLS = 1 << 16        # hashed trigrams
SAMPLE = 2_000         # labelled texts of a language, on average, that are learned from
ROUNDS, AGAIN = 8, 4   # EM rounds over all languages, and over the chosen set
PENALTY = 0.5


def trigrams(texts: list[str]):
    """(cells, word of each cell, text of each word): trigrams of the lower-cased
    letter runs with a blank on either side, of the whole texts."""
    lower = [t.lower() for t in texts]
    cp = np.frombuffer((" " + " ".join(lower) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = classes()[cp] == LETTER
    owner_end = np.cumsum(np.fromiter(map(len, lower), np.int64, len(lower)) + 1)  # index of the blank behind each text
    c = np.where(letter, cp, np.uint32(32))
    # a trigram around every letter: of what stands before it, itself, and behind it
    at = np.flatnonzero(letter)
    cells = ((c[at - 1] * np.uint32(0x9E3779B1)) ^ (c[at] * np.uint32(0x85EBCA77)) ^ (c[at + 1] * np.uint32(0xC2B2AE3D)))
    cells = ((cells ^ (cells >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    starts = at[~letter[at - 1]] if len(at) else at
    first = np.searchsorted(at, starts)
    return cells, first, np.searchsorted(owner_end, starts)


def fold(doc_id):
    """crc32 of the id as text, modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def learn(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log-probability of every cell by language) from ``docs`` (doc_id, text, lang)."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((CELLS, 0), np.float32)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample / sizes[k])))])
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("learn")), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for part, texts in text_chunks(batches):
            names = np.array(part.column(part.schema.get_field_index("lang")).to_pylist(), object)
            for k in set(names.tolist()):
                cells, _, _ = trigrams([t for t, x in zip(texts, names == k) if x])
                total[k] = total.get(k, 0) + np.bincount(cells, minlength=CELLS)
        for k, n in total.items():
            cell = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(cell), pa.string()), pa.array(cell, pa.int32()), pa.array(n[cell], pa.int64())],
                                             ["lang", "cell", "n"])

    rows = drawn.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros((CELLS, len(langs)))
    n[rows["cell"].to_numpy(), [langs.index(x) for x in rows["lang"]]] = rows["n"]
    return langs, np.log((n + 0.1) / (n.sum(axis=0) + 0.1 * CELLS)).astype(np.float32)


def mixture(like: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Proportions (texts, languages) of texts whose words have the likelihoods
    ``like`` (words, languages); ``first`` and ``size``: each text's words."""
    text = np.repeat(np.arange(len(first)), size)
    langs = like.shape[1]

    def step(theta):
        r = like * theta[text]
        r /= r.sum(axis=1, keepdims=True)
        return np.add.reduceat(r, first, axis=0) / size[:, None]

    def fit(theta):
        return np.add.reduceat(np.log((like * theta[text]).sum(axis=1)), first)

    theta = np.full((len(first), langs), 1 / langs)
    for _ in range(ROUNDS):
        theta = np.maximum(step(theta), 1e-9)
        theta /= theta.sum(axis=1, keepdims=True)
    whole = fit(theta)
    loss = np.empty_like(theta)
    for k in range(langs):
        less = theta.copy()
        less[:, k] = 1e-12
        loss[:, k] = whole - fit(less / less.sum(axis=1, keepdims=True))
    chosen = loss > PENALTY * np.log(np.maximum(size, 2))[:, None]
    chosen[np.arange(len(theta)), theta.argmax(axis=1)] = True
    theta = np.where(chosen, theta, 1e-12)
    theta /= theta.sum(axis=1, keepdims=True)
    for _ in range(AGAIN):
        theta = np.where(chosen, np.maximum(step(theta), 1e-9), 1e-12)
        theta /= theta.sum(axis=1, keepdims=True)
    return np.where(chosen, theta, 0)


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the chosen languages of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(logp)  # CELLS x languages

    def run(batches):
        table = shared.value
        for part, texts in text_chunks(batches, limit=1_000_000):
            pred, score, sets = ["und"] * len(texts), [0.0] * len(texts), [""] * len(texts)
            cells, first, owner = trigrams(texts)
            if len(cells) and langs:
                ll = np.add.reduceat(table[cells].astype(np.float64), first, axis=0)
                like = np.exp(np.maximum(ll - ll.max(axis=1, keepdims=True), -60))
                at = np.flatnonzero(np.concatenate([[True], np.diff(owner) != 0]))
                theta = mixture(like, at, np.diff(np.append(at, len(owner))))
                for d, t in zip(owner[at].tolist(), theta):
                    pred[d], score[d] = langs[int(t.argmax())], float(min(1.0, t.max()))
                    sets[d] = ",".join(x for x, y in zip(langs, t) if y > 0)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pred), pa.array(score), pa.array(sets)],
                                             ["doc_id", "held_out", "lang_pred", "score", "languages"])

    rows = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, languages string")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learn from the rows that aren't held out, predict all."""
    learned = learn(docs.where(F.coalesce(fold(F.col("doc_id")) != 2, F.lit(False))), sample)
    return predict(docs, *learned)

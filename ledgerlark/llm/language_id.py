"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability sums over all its
segmentations into pieces by the forward algorithm, and a text's is the product over its words. The probabilities come
from expectation maximisation over a bounded sample of labelled documents. Short words are computed many at a time;
words of more than LONG bytes one at a time in logarithms, whatever their length.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import SPACES, _U, buffers, discard, held_out, lowered, materialize, mix, powers, prefix_hash, word_hashes, word_spans
from ledgerlark.session import table

#: A file of lines "base64 rank", a byte-level vocabulary.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Bytes, the leading space counted, up to which products of probabilities stay far from the smallest float.
LONG = 32
#: Bytes of text whose words are computed at a time.
SLICE = 1 << 18
#: Words whose scores a task keeps.
KEPT_WORDS = 300_000


class Vocabulary:
    """Pieces of bytes, in lower case, with a hash table; every single byte is a piece."""

    def __init__(self, pieces: set[bytes]) -> None:
        self.pieces = sorted({p.lower() for p in pieces if p} | {bytes([i]).lower() for i in range(256)})
        self.sizes = sorted({len(p) for p in self.pieces})
        flat = np.frombuffer(b"".join(self.pieces), dtype=np.uint8)
        end = np.cumsum([len(p) for p in self.pieces])
        start = end - [len(p) for p in self.pieces]
        h = self.hash_of(prefix_hash(flat), start, end)
        order = np.argsort(h)
        self.hashes, self.ids = h[order], order
        self.mask = np.zeros(1 << 20, dtype=bool)
        self.mask[h >> _U(44)] = True

    @staticmethod
    def hash_of(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((p[end] - p[start]) * powers(len(p))[1][start] + (end - start).astype(np.uint64))

    def found(self, p: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the starts begin a piece of this size, and which piece."""
        h = self.hash_of(p, start, start + size)
        rows = np.flatnonzero(self.mask[h >> _U(44)])
        at = np.minimum(np.searchsorted(self.hashes, h[rows]), len(self.hashes) - 1)
        hit = self.hashes[at] == h[rows]
        return rows[hit], self.ids[at[hit]]

    def lattice(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each end position from 1 the arcs (piece length, words, pieces) into it; words are sorted longest first."""
        p = prefix_hash(buf)
        arcs = []
        for j in range(1, int(length[0]) + 1 if len(length) else 1):
            n = int(np.searchsorted(-length, -j, "right"))
            here = []
            for size in self.sizes:
                if size > j:
                    break
                rows, ids = self.found(p, start[:n] + (j - size), size)
                if len(rows):
                    here.append((size, rows, ids))
            arcs.append(here)
        return arcs

    def arcs_of(self, word: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each end position from 1 of one word the starts and pieces of its arcs."""
        p = prefix_hash(word)
        found = [(rows, rows + size, ids) for size in self.sizes if size <= len(word) for rows, ids in [self.found(p, np.arange(len(word) - size + 1), size)]]
        begin, end, ids = (np.concatenate([f[i] for f in found]) for i in range(3))
        order = np.argsort(end, kind="stable")
        cuts = np.searchsorted(end[order], np.arange(1, len(word) + 2))
        return [(begin[order[a:b]], ids[order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def read_pieces(path: str) -> set[bytes]:
    """The pieces of a vocabulary file; read by the driver alone, which sends the vocabulary to the tasks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(line.split()[0]) for line in lines if line.strip()}


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(read_pieces(path))


def spaced(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts, lengths (longest first) and numbers of words, each after a space."""
    size = end - start + 1
    owner = np.argsort(-size, kind="stable")
    length = size[owner]
    at = np.cumsum(length) - length
    inner = np.arange(int(length.sum())) - np.repeat(at, length)
    flat = buf[np.maximum(np.repeat(start[owner], length) + inner - 1, 0)]
    flat[inner == 0] = 32
    return flat, at, length, owner


def _log_sum(x: np.ndarray) -> np.ndarray:
    most = x.max(axis=0)
    return most + np.log(np.exp(x - most).sum(axis=0))


def _forward(arcs: list[tuple[np.ndarray, np.ndarray]], logs: np.ndarray) -> np.ndarray:
    """(length + 1) x languages: the log of the summed probability of each prefix of a word."""
    alpha = np.zeros((len(arcs) + 1, logs.shape[1]))
    for j, (begin, ids) in enumerate(arcs, 1):
        alpha[j] = _log_sum(alpha[begin] + logs[ids])
    return alpha


def log_likelihoods(vocab: Vocabulary, probs: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words x languages: the log of each word's probability summed over its segmentations; probs is pieces x languages."""
    out = np.zeros((len(start), probs.shape[1]))
    is_long = end - start >= LONG
    if is_long.any():
        logs = np.log(probs)
        for i in np.flatnonzero(is_long).tolist():
            out[i] = _forward(vocab.arcs_of(np.concatenate([[np.uint8(32)], buf[start[i] : end[i]]])), logs)[-1]
    short = np.flatnonzero(~is_long)
    flat, at, length, owner = spaced(buf, start[short], end[short])
    alpha = [np.ones((len(length), probs.shape[1]))]
    for j, here in enumerate(vocab.lattice(flat, at, length), 1):
        now = np.zeros((int(np.searchsorted(-length, -j, "right")), probs.shape[1]))
        for size, rows, ids in here:
            now[rows] += alpha[j - size][rows] * probs[ids]
        alpha.append(now)
    for size in np.unique(length).tolist():
        rows = np.flatnonzero(length == size)
        out[short[owner[rows]]] = np.log(alpha[size][rows])
    return out


def _expect_long(vocab: Vocabulary, logs: np.ndarray, word: np.ndarray, times: float, total: np.ndarray) -> None:
    """Adds a long word's expected counts; logs is of the word's language alone."""
    arcs = vocab.arcs_of(word)
    alpha = _forward(arcs, logs[:, None])[:, 0]
    beta = np.full(len(word) + 1, -np.inf)
    beta[-1] = 0.0
    for j in range(len(word), 0, -1):
        if beta[j] > -np.inf:
            begin, ids = arcs[j - 1]
            through = logs[ids] + beta[j]
            beta[begin] = np.logaddexp(beta[begin], through)  # an end has one arc from each start
            np.add.at(total, ids, times * np.exp(alpha[begin] + through - alpha[-1]))


def _expected(batches: Iterator[pa.RecordBatch], shared, langs: list[str], probs) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """Expected counts of pieces in each language's words, by the forward-backward algorithm."""
    vocab, probs = shared.value, probs.value
    total = np.zeros((len(langs), len(vocab.pieces)))
    place = {x: i for i, x in enumerate(langs)}
    logs = np.log(probs)
    for batch in batches:
        lang = np.array([place[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
        times = batch.column("n").to_numpy().astype(np.float64)
        for lo, hi, buf, offs in buffers(batch.column("word"), SLICE):
            is_long = np.diff(offs) >= LONG
            for i in np.flatnonzero(is_long).tolist():
                k = lang[lo + i]
                _expect_long(vocab, logs[:, k], np.concatenate([[np.uint8(32)], buf[offs[i] : offs[i + 1]]]), times[lo + i], total[k])
            short = np.flatnonzero(~is_long)
            flat, at, length, owner = spaced(buf, offs[:-1][short], offs[1:][short])
            of, n = lang[lo:hi][short[owner]], times[lo:hi][short[owner]]
            arcs = vocab.lattice(flat, at, length)
            alpha = [np.ones(len(length))]
            for j, here in enumerate(arcs, 1):
                now = np.zeros(int(np.searchsorted(-length, -j, "right")))
                for size, rows, ids in here:
                    now[rows] += alpha[j - size][rows] * probs[ids, of[rows]]
                alpha.append(now)
            beta = [np.zeros(len(a)) for a in alpha]
            for j in range(len(arcs), 0, -1):
                ended = np.flatnonzero(length[: len(beta[j])] == j)
                beta[j][ended] = n[ended] / alpha[j][ended]
                for size, rows, ids in arcs[j - 1]:
                    through = probs[ids, of[rows]] * beta[j][rows]
                    beta[j - size][rows] += through
                    np.add.at(total, (of[rows], ids), through * alpha[j - size][rows])
    at, piece = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[at, piece])], names=["lang", "piece", "count"])


def fit(docs: DataFrame, path: str = VOCABULARY, sample: int = 400, rounds: int = 3, smoothing: float = 0.02, most_languages: int = 256) -> tuple[list[str], np.ndarray]:
    """Languages and pieces x languages, learnt from at most sample documents of each language outside the held-out fold
    (those of the smallest id hashes), by rounds of expectation maximisation from uniform probabilities.

    Documents are told apart by id: rows that repeat one are one document with several texts. The model has a column for
    each language; more than most_languages of them raise a ValueError, so what is broadcast here is bounded.
    """
    spark = docs.sparkSession
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = known.select("doc_id", "lang").withColumn("h", F.xxhash64("doc_id"))
    # The smallest hashes of a language lie under a bound that its number of different ids tells, with room to spare; so
    # few rows are moved and ranked, however many a language has.
    counts = materialize(known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")), "counts")
    if counts.count() > most_languages:
        raise ValueError(f"more than {most_languages} languages to learn")
    bound = F.lit(-float(1 << 63)) + F.lit(float(1 << 63)) * 2 * F.least(F.lit(1.0), F.lit(4.0 * sample + 100) / F.col("n"))
    near = ids.join(F.broadcast(counts), "lang").where(F.col("h").cast("double") <= bound)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = materialize(near.select("doc_id", "lang", "h").distinct().withColumn("rank", rank).where(F.col("rank") <= sample).select("doc_id", "lang"), "sample")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])  # at most sample rows per language
    words = texts.select("lang", F.explode(F.split(lower, SPACES)).alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    words = materialize(words, "words")
    langs = sorted(r[0] for r in words.select("lang").distinct().collect())
    vocab = vocabulary(path)
    shared = spark.sparkContext.broadcast(vocab)
    probs = np.full((len(vocab.pieces), len(langs)), 1 / len(vocab.pieces))
    for _ in range(rounds if langs else 0):
        now = spark.sparkContext.broadcast(probs)
        told = words.mapInArrow(lambda it, now=now: _expected(it, shared, langs, now), "lang int, piece int, count double")
        told = told.groupBy("lang", "piece").agg(F.sum("count").alias("count")).toArrow()  # no more than the model holds
        summed = np.full((len(langs), len(probs)), smoothing)
        summed[told["lang"].to_numpy(), told["piece"].to_numpy()] += told["count"].to_numpy()
        probs = (summed / summed.sum(axis=1, keepdims=True)).T.copy()
    discard(words, chosen, counts)
    return langs, probs


class _WordScores:
    """Scores of the words met so far, at most KEPT_WORDS before it starts anew."""

    def __init__(self, vocab: Vocabulary, probs: np.ndarray) -> None:
        self.vocab, self.probs = vocab, probs
        self.clear()

    def clear(self) -> None:
        self.hashes, self.scores = np.zeros(0, dtype=np.uint64), np.zeros((0, self.probs.shape[1]))

    def of(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        unique, first, back = np.unique(word_hashes(buf, start, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, unique)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == unique[known]
        out = np.empty((len(unique), self.probs.shape[1]))
        out[known] = self.scores[at[known]]
        new = first[~known]
        if len(new):
            out[~known] = log_likelihoods(self.vocab, self.probs, buf, start[new], end[new])
            if len(self.hashes) > KEPT_WORDS:
                self.clear()
            merged = np.concatenate([self.hashes, unique[~known]])
            order = np.argsort(merged, kind="stable")
            self.hashes, self.scores = merged[order], np.concatenate([self.scores, out[~known]])[order]
        return out[back]


def _identified(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    vocab, langs, probs = model.value
    scores = _WordScores(vocab, probs)
    for batch in batches:
        lettered = pc.fill_null(pc.match_substring_regex(batch.column("text"), r"\p{L}"), False).to_numpy(zero_copy_only=False)
        for lo, hi, buf, offs in buffers(batch.column("text"), SLICE):
            small = lowered(buf)
            start, end, doc = word_spans(small, offs)
            total = np.zeros((hi - lo, len(langs)))
            if len(start) and langs:
                each = scores.of(small, start, end)
                for i in range(len(langs)):
                    total[:, i] = np.bincount(doc, weights=each[:, i], minlength=hi - lo)
            said, sure = np.full(hi - lo, "und", dtype=object), np.zeros(hi - lo)
            if langs:
                good = lettered[lo:hi]
                best = total.argmax(axis=1)
                share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                said[good], sure[good] = np.array(langs, dtype=object)[best[good]], share[good]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(said, pa.string()), pa.array(sure)], names=["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str = VOCABULARY) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, lang_pred, score.

    score is the posterior of the predicted language, each language equally likely before. A null text, or one without
    a letter, is 'und' with score 0, as is everything where no language was learnt. Repeated rows are predicted alike;
    an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary(path), *model))  # of the vocabulary's size times the languages
    return docs.select("doc_id", "text").mapInArrow(lambda it: _identified(it, shared), f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def op7_segmentation_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_segmentation_unigrams": op7_segmentation_unigrams}

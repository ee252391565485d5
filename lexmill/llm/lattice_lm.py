"""Language-model scoring by subword lattices.

A word's probability is the sum over all its segmentations into pieces of a fixed, public
subword vocabulary of the product of the pieces' probabilities: a forward recursion over the
word's lattice, in log space.  A document is its words and one end event.

Piece probabilities begin with the vocabulary's own scores, which rank the pieces, read as
Zipf weights, and are re-estimated on the training documents by expectation-maximisation over
the word table: expected piece counts from forward and backward passes, weighted by how often
each word stands in the corpus.  The vocabulary itself is never changed.  Every byte has a
piece of its own, so every text has a probability.

Words of the whole corpus form one table (word, count), summed in each task before they move.
A document gets the values of its words through blocks: documents are dealt into blocks by a
hash, each block asks once for every distinct word it holds, and is then scored whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import shuffle_width, staged

VOCABULARY = "piece_bpe_32k.model"
#: Bytes of text in a block of documents, and words of one vectorised pass.
BLOCK_BYTES, _PASS = 16_000_000, 50_000
#: Words over so many bytes are scored one by one.
_LONG = 48
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LN10 = math.log(10)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


class Lattice:
    """The vocabulary as a trie over bytes; the mark before a word is byte 0x20."""

    def __init__(self, pieces: list[bytes], ranks: list[int]):
        """``ranks`` order the pieces: 0 is the best.  Pieces 0..255 of the result are the bytes."""
        kept = [(p, r) for p, r in zip(pieces, ranks) if p and b" " not in p[1:] and p == p.translate(_LOWER)]
        self.pieces = [bytes([b]) for b in range(256)] + [p for p, _ in kept]
        used = sorted({b for p, _ in kept for b in p})
        self.width = len(used) + 1
        self.letter = np.zeros(256, np.int32)  # 0: in no piece
        self.letter[used] = np.arange(1, self.width)
        children: dict[tuple[int, int], int] = {}
        at_piece: dict[int, int] = {}
        for i, (p, _) in enumerate(kept):
            node = 0
            for b in p:
                node = children.setdefault((node, b), len(children) + 1)
            at_piece.setdefault(node, 256 + i)
        self.next = np.zeros((len(children) + 1, self.width), np.int32)  # 0: no such piece
        for (node, b), to in children.items():
            self.next[node, self.letter[b]] = to
        self.piece = np.full(len(children) + 1, -1, np.int32)
        self.piece[list(at_piece)] = list(at_piece.values())
        self.known = {p: 256 + i for i, (p, _) in reversed(list(enumerate(kept)))}
        self.longest = max(map(len, self.pieces))
        weight = np.concatenate([np.full(256, 1 / (max(ranks, default=0) + 1000)), [1 / (r + 10) for _, r in kept]])
        self.prior = weight / weight.sum()

    def _moves(self, w: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) of all lattice edges of same-length words, by start."""
        n, length = w.shape
        letters, everyone = self.letter[w], np.arange(n)
        for i in range(length):
            yield i, i + 1, everyone, w[:, i].astype(np.int64)
            rows, nodes = everyone, self.next[0, letters[:, i]]
            for end in range(i + 1, length + 1):
                alive = nodes > 0
                rows, nodes = rows[alive], nodes[alive]
                if not len(rows):
                    break
                found = self.piece[nodes]
                hit = found >= 0
                if hit.any():
                    yield i, end, rows[hit], found[hit]
                if end < length:
                    nodes = self.next[nodes, letters[rows, end]]

    def forward(self, words: list[bytes], log_p: np.ndarray) -> np.ndarray:
        """Natural log of each word's marginal probability."""
        out = np.empty(len(words))
        for rows, w in self._groups(words):
            out[rows] = self._alpha(w, self._moves(w), log_p)[-1]
        for i, word in enumerate(words):
            if len(word) >= _LONG:
                out[i] = self._one(word, log_p)[-1]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations, words weighted by ``counts``."""
        total = np.zeros(len(self.pieces))
        for rows, w in self._groups(words):
            moves = list(self._moves(w))
            alpha = self._alpha(w, moves, log_p)
            beta = np.full(alpha.shape, -np.inf)
            beta[-1] = 0
            ids, mass, weight = [], [], counts[rows]
            for i, end, who, piece in reversed(moves):
                through = log_p[piece] + beta[end, who]
                beta[i, who] = np.logaddexp(beta[i, who], through)
                ids.append(piece)
                mass.append(np.exp(alpha[i, who] + through - alpha[-1, who]) * weight[who])
            total += np.bincount(np.concatenate(ids), np.concatenate(mass), len(total))
        for i, word in enumerate(words):
            if len(word) >= _LONG:
                self._count_one(word, float(counts[i]), log_p, total)
        return total

    def _groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of one length as a byte matrix with the mark before them."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(sizes[sizes < _LONG]).tolist():
            rows = np.flatnonzero(sizes == size)
            w = np.empty((len(rows), size + 1), np.uint8)
            w[:, 0] = 32
            w[:, 1:] = np.frombuffer(b"".join(words[i] for i in rows.tolist()), np.uint8).reshape(-1, size)
            yield rows, w

    @staticmethod
    def _alpha(w: np.ndarray, moves, log_p: np.ndarray) -> np.ndarray:
        alpha = np.full((w.shape[1] + 1, len(w)), -np.inf)
        alpha[0] = 0
        for i, end, who, piece in moves:
            alpha[end, who] = np.logaddexp(alpha[end, who], alpha[i, who] + log_p[piece])
        return alpha

    def _edges(self, word: bytes, i: int) -> Iterator[tuple[int, int]]:
        yield i + 1, word[i]
        node = 0
        for end in range(i + 1, len(word) + 1):
            node = int(self.next[node, self.letter[word[end - 1]]])
            if not node:
                return
            if self.piece[node] >= 0:
                yield end, int(self.piece[node])

    def _one(self, word: bytes, log_p: np.ndarray) -> np.ndarray:
        word = b" " + word
        alpha = np.full(len(word) + 1, -np.inf)
        alpha[0] = 0
        for i in range(len(word)):
            for end, piece in self._edges(word, i):
                alpha[end] = np.logaddexp(alpha[end], alpha[i] + log_p[piece])
        return alpha

    def _count_one(self, word: bytes, count: float, log_p: np.ndarray, total: np.ndarray) -> None:
        alpha = self._one(word, log_p)
        word = b" " + word
        beta = np.full(len(word) + 1, -np.inf)
        beta[-1] = 0
        for i in range(len(word) - 1, -1, -1):
            for end, piece in self._edges(word, i):
                beta[i] = np.logaddexp(beta[i], log_p[piece] + beta[end])
                total[piece] += count * math.exp(alpha[i] + log_p[piece] + beta[end] - alpha[-1])


@lru_cache(maxsize=2)
def lattice(vocabulary: str = VOCABULARY) -> Lattice:
    """The lattice of a public vocabulary file, whose piece scores give the ranks."""
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    ordered = sorted(ids, key=lambda i: (-model.get_score(i), i))
    return Lattice([model.id_to_piece(i).replace("▁", " ").encode() for i in ordered], list(range(len(ordered))))


def _passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined to passes that are worth vectorising."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _PASS:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def word_table(docs: DataFrame) -> DataFrame:
    """(word, c): every distinct word of ``docs`` (text, training) and its count in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "c"])

        seen: Counter[bytes] = Counter()
        for batch in batches:
            others: set[bytes] = set()
            for text, training in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (seen.update if training else others.update)(words_of(text))
            for word in others:
                seen[word] += 0
            if len(seen) > 500_000:  # bounds memory; the sums go on after the shuffle
                yield emit()
                seen.clear()
        yield emit()

    return docs.select("text", "training").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def train(words: DataFrame, rounds: int = 2, prior_strength: float = 1000.0, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Piece log-probabilities after ``rounds`` of expectation-maximisation over (word, c)."""
    model = lattice(vocabulary)
    p = model.prior
    known = words.where("c > 0")
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast(np.log(p))  # as long as the vocabulary

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, total = lattice(vocabulary), 0.0
            for part in _passes(batches):
                total = total + own.expected(part.column(0).to_pylist(), part.column(1).to_numpy().astype(float), shared.value)
            if not isinstance(total, float):
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.float64())], ["piece", "n"])

        sums = known.select("word", "c").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        expected = np.zeros(len(p))
        for piece, n in sums.collect():  # at most one row a piece
            expected[piece] = n
        p = (expected + prior_strength * model.prior) / (expected.sum() + prior_strength)
    return np.log(p)


def score(
    df: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, block_bytes: int = BLOCK_BYTES, vocabulary: str = VOCABULARY
) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    ``training`` is a boolean column of ``df`` that says which rows are learned from (null: not).
    A null text counts as empty: its one token is the end.  Without any training rows all counts
    are zero and the pieces keep their prior.  Repeated rows count as often as they stand; an
    empty table gives an empty result; other columns are not read.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    words = staged(word_table(docs), "lm-words")
    totals = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    sizes = docs.agg(F.count_if("training"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    ends, n = sizes[0], totals[0] + sizes[0]
    distinct = totals[1] + (ends > 0)
    log_p = spark.sparkContext.broadcast(train(words, rounds, vocabulary=vocabulary))
    end_p = ends / n if n else 0.5
    bottom = n + 0.5 * (distinct + 1)
    end_base, end_score, go_on = math.log10((ends + 0.5) / bottom), math.log10(end_p) if ends else math.log10(0.5), math.log10(1 - end_p) if end_p < 1 else 0.0

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(vocabulary)
        for part in _passes(batches):
            logs = own.forward(part.column(0).to_pylist(), log_p.value) / LN10 + go_on
            yield pa.RecordBatch.from_arrays([part.column(0).combine_chunks(), part.column(1).combine_chunks(), pa.array(logs)], ["word", "c", "log10_p"])

    blocks = max(shuffle_width(spark), -(-sizes[1] // block_bytes))
    dealt = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"))

    def asks(part: pa.Table) -> pa.Table:
        seen: set[bytes] = set()
        for text in part.column("text").to_pylist():
            seen.update(words_of(text))
        return pa.table({"word": pa.array(list(seen), pa.binary()), "block": pa.array([part.column("block")[0].as_py()] * len(seen), pa.int32())})

    asked = dealt.groupBy("block").applyInArrow(asks, "word binary, block int")
    told = asked.join(words.select("word", "c").mapInArrow(values, "word binary, c long, log10_p double"), "word")

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        number = {w: i for i, w in enumerate(right.column("word").to_pylist())}
        c, log10_p = right.column("c").to_numpy(), right.column("log10_p").to_numpy()
        base = np.log10((c + 0.5) / bottom)
        out = []
        for text in left.column("text").to_pylist():
            ids = np.fromiter(map(number.__getitem__, words_of(text)), np.int64)
            out.append((len(ids) + 1, int((c[ids] > 0).sum()) + (ends > 0), n, float(base[ids].sum()) + end_base, float(log10_p[ids].sum()) + end_score))
        names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
        kinds = [pa.int64()] * 3 + [pa.float64()] * 2
        return pa.table([left.column("doc_id"), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], names=["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(tell, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("doc_id", id_col)

"""Tokenise documents and pack them into sequences by vector best-fit.

A sequence has three capacities: tokens, documents and attention cost.  Attention within
documents is computed in square tiles of TILE tokens, so a piece of n tokens costs
ceil(n / TILE)**2 tiles, and a sequence affords those of one full piece and an eighth more: many
tiny pieces can exhaust it, or the document count, before the tokens.  Pieces are placed longest first.  Among the open sequences whose residual
fits the piece in every dimension, the one is taken that scores best: by the smallest norm
of what would remain, or by the largest dot product of piece and residual, each dimension
as a share of its capacity and weighted.  Sequences with the same residual are alike, so the
choice is among distinct residuals only.

Documents longer than a sequence are cut from the end into full pieces; the remainder comes
first.  Full pieces fill a sequence alone and never enter the search.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .arrow_map import Mapper, columns_of, map_texts
from .runtime import staged

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Pieces that a sequence holds at most, so that its table of boundaries has a fixed size, and tokens
#: in a tile's side.
DOCUMENTS, TILE = 64, 64
#: Scripts in which both engines split words alike; any other character takes the slower one.
_USUAL = re.compile(r"[\x00-ʯͰ-ϿЀ-ӿ֐-ۿ‐-‧‰-⁞₠-₿぀-ヿ一-鿿가-힣]*")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(name: str):
    """text -> uint32 ids, those of ``name`` with add_special_tokens=False.  Texts of usual scripts
    without an added token's text are encoded by a faster engine given the same vocabulary, which
    yields the same ids."""
    path = public_tokenizers.path(name)
    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    vocabulary, added = told["model"]["vocab"], [t["content"] for t in told["added_tokens"]]
    as_byte = _byte_of_char()
    ranks = {bytes(as_byte[c] for c in token): i for token, i in vocabulary.items() if all(c in as_byte for c in token)}
    ranks = {token: i for token, i in ranks.items() if i < len(vocabulary) - 1 or len(token) == 1}  # the last is special
    fast = tiktoken.Encoding("lexmill", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if _USUAL.fullmatch(text) and not any(t in text for t in added):
            return fast.encode_to_numpy(text, disallowed_special=())
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones from the end, the remainder first."""
    first = n % size or min(n, size)
    return [(0, first), *((at, size) for at in range(first, n, size))] if n else []


def tokenised(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece of every row."""

    def setup() -> Mapper:
        encode = encoder(tokenizer)

        def mapper(texts: list[str | None]) -> tuple[list[int], list]:
            rows, out = [], []
            for i, text in enumerate(texts):
                ids = np.append(encode(text or ""), END_ID).astype("<u4")
                for k, (at, n) in enumerate(cut(len(ids), size)):
                    rows.append(i)
                    out.append((k, at, n, zlib.crc32(ids[at : at + n])))
            return rows, columns_of(out, 4)

        return mapper

    return map_texts(df, id_col, text_col, setup, "piece int, start long, length long, ids_crc32 long")


def tiles(n: int, tile: int = TILE) -> int:
    """Attention cost of a piece of n tokens."""
    return (-(-n // tile)) ** 2


def best_fit(lengths: list[int], tokens: int, documents: int, attention: int, tile: int = TILE, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> list[tuple[int, int]]:
    """(bin, offset) of each length under all three capacities.

    A residual is (tokens, documents, attention).  Distinct residuals of open bins are kept
    in arrays; each maps to its bins, of which the newest is used.
    """
    if rule not in ("norm", "dot"):
        raise ValueError("rule is norm or dot")
    caps = np.array([tokens, documents, attention], float)
    w = np.array(weights) / caps**2
    out: list[tuple[int, int]] = [(-1, -1)] * len(lengths)
    where: dict[tuple[int, int, int], list[int]] = {}
    residual = np.empty((0, 3), np.int64)
    count, fresh = 0, (tokens, documents, attention)
    grown = np.empty((256, 3), np.int64)
    used = 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = (lengths[i], 1, tiles(lengths[i], tile))
        if any(n > c for n, c in zip(need, fresh)):
            raise ValueError(f"a piece of {lengths[i]} tokens fits no sequence")
        residual = grown[:used]
        left = residual - need
        fits = np.flatnonzero((left >= 0).all(1))
        if len(fits):
            score = ((left[fits] ** 2) * w).sum(1) if rule == "norm" else -((residual[fits] * need) * w).sum(1)
            row = int(fits[score.argmin()])
            state = tuple(residual[row].tolist())
            bins = where[state]
            at = bins.pop()
            if not bins:
                del where[state]
                used -= 1
                grown[row] = grown[used]
        else:
            at, state, count = count, fresh, count + 1
        out[i] = (at, tokens - state[0])
        after = tuple(s - n for s, n in zip(state, need))
        if min(after[:2]) > 0 and after[2] > 0:
            if after not in where:
                if used == len(grown):
                    grown = np.concatenate([grown, np.empty_like(grown)])
                grown[used] = after
                used += 1
            where.setdefault(after, []).append(at)
    return out


def pack(
    pieces: DataFrame, size: int = 1024, documents: int = DOCUMENTS, attention: int | None = None, tile: int = TILE, group: int = 20_000, rule: str = "norm"
) -> DataFrame:
    """``pieces`` with (sequence_id, offset).  ``attention`` is in tiles; by default those of one
    piece of ``size`` tokens and an eighth more.

    Only the pieces shorter than a sequence are searched, in groups of about ``group`` rows
    dealt by a hash: each is large enough that what its last sequences leave is negligible,
    and bounded, so no task grows with the input.  Repeated rows are packed each on their own.
    """
    attention = attention or tiles(size, tile) * 9 // 8
    names = pieces.columns
    full = pieces.where(F.col("length") >= size)
    part = pieces.where(F.col("length") < size)
    groups = max(1, -(-part.count() // group))
    # A group's number and a running number in it make the id; full pieces count after all groups.
    dealt = part.withColumn("_group", F.pmod(F.xxhash64("doc_id", "ids_crc32", "length", F.monotonically_increasing_id()), F.lit(groups)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "ids_crc32", "start"], ascending=[False, True, True], kind="stable", ignore_index=True)
        placed = best_fit(pdf["length"].tolist(), size, documents, attention, tile, rule=rule)
        first = int(pdf["_group"].iloc[0])
        pdf["sequence_id"] = [b * groups + first for b, _ in placed]
        pdf["offset"] = [o for _, o in placed]
        return pdf[[*names, "sequence_id", "offset"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    searched = dealt.groupBy("_group").applyInPandas(run, schema)
    alone = full.select(*names, (-F.lit(1) - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return searched.unionByName(alone)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, documents: int = DOCUMENTS, tokenizer: str = TOKENIZER, rule: str = "norm") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece, the end id.  Repeated rows are packed as often as they
    stand; a null id stays null.  An empty table gives an empty result; only the two columns
    are read.
    """
    pieces = staged(tokenised(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), size=size, tokenizer=tokenizer), "pieces")
    return pack(pieces, size, documents, rule=rule).withColumnRenamed("doc_id", id_col)

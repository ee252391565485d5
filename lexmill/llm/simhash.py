"""SimHash near-duplicates by multi-index hashing, and their connected components.

A fingerprint is cut into segments.  Two fingerprints that differ in at most r bits lie,
in at least one segment, within a small Hamming ball (the pigeonhole principle with the
ball radii of multi-index hashing: r = a*m + b gives radius a in the first b+1 of m
segments and a-1 in the others).  Each fingerprint enumerates the balls of its segments,
fetches the table entries of these keys by a join, and keeps the pairs whose complete
distance is small enough.

Only distinct fingerprints are joined, so exact copies cost one row.  A key that many
fingerprints share (a cluster of near copies) isn't expanded into pairs: its members
enumerate the ball of half the radius around their whole fingerprint and are tied to the
smallest fingerprint of each ball centre, which is exact for an even radius (two points
are within 2h bits if and only if some point lies within h bits of both) and linear.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow_map import Mapper, map_texts
from .runtime import bucketed, checkpointed, staged

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
#: Hashes whose bits are unpacked at once.
_BLOCK = 1 << 16


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Unsigned XXH64 (seed 42) of every shingle of ``size`` words, repeats included."""
    words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, 42) for g in grams), np.uint64)


def simhash(text: str | None, size: int = 3) -> int:
    """A bit is 1 if it is set in over half of the shingle hashes; 0 for no words."""
    return fingerprint(shingle_hashes(text, size))


def fingerprint(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        part = np.ascontiguousarray(hashes[i : i + _BLOCK].astype(">u8"))
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big") if len(hashes) else 0


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp): the 64 bits as a signed long.  A null or blank text has fingerprint zero."""

    def setup() -> Mapper:
        return lambda texts: (None, [np.fromiter((simhash(t, size) for t in texts), np.uint64, len(texts)).view(np.int64)])

    return map_texts(df, id_col, text_col, setup, "fp long")


def segments(n_segments: int, radius: int) -> list[tuple[int, int, int]]:
    """(shift, bits, ball radius) of each segment; -1 where a segment needs no probe."""
    a, b = divmod(radius, n_segments)
    cuts = [64 * i // n_segments for i in range(n_segments + 1)]
    return [(lo, hi - lo, a if i <= b else a - 1) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]


def ball(bits: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` of ``bits`` bits, as signed longs."""
    masks = [sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(bits), k)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, radius: int = 2, n_segments: int = 2, heavy: int = 64) -> DataFrame:
    """Edges (src, dst), src > dst, that connect all fingerprints within ``radius`` bits.

    ``fps`` has distinct ``fp``.  A table key with up to ``heavy`` fingerprints yields its
    verified pairs; beyond that its members are tied by ball centres (see above), which keeps
    the same components with at most one edge for each member and centre.

    No join broadcasts: what is small on the wire can be far larger in the driver.  Crowded keys
    are joined by another name of the value, so that both sides are shuffled for it and adaptive
    execution can split a key.
    """
    if radius % 2:
        raise ValueError("an even radius is needed")
    plan = [(i, *s) for i, s in enumerate(segments(n_segments, radius)) if s[2] >= 0]

    def key(i: int, shift: int, bits: int, _r: int) -> Column:
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1))
        return F.struct(F.lit(i).alias("seg"), value.alias("val"))

    entries = fps.select("fp", F.explode(F.array(*[key(*p) for p in plan])).alias("k")).select("fp", "k.seg", "k.val")
    probes = fps.select("fp", F.explode(F.array(*[key(*p) for p in plan])).alias("k"))
    masks = F.create_map(*[x for i, _, bits, r in plan for x in (F.lit(i), F.lit(ball(bits, r)))])
    probes = probes.select("fp", "k.seg", F.explode(F.transform(masks[F.col("k.seg")], lambda m: F.col("k.val").bitwiseXOR(m))).alias("val"))

    counted = entries.groupBy("seg", "val").agg(F.count("*").alias("n"))
    named = F.col("val").bitwiseXOR(F.lit(1).cast("long")).alias("k")
    crowded = counted.where(F.col("n") > heavy).select("seg", named).hint("merge")
    light = entries.select("fp", "seg", "val", named).join(crowded, ["seg", "k"], "left_anti").select(F.col("fp").alias("dst"), "seg", "val")
    pairs = probes.join(light.hint("merge"), ["seg", "val"]).where("fp > dst OR fp < dst").where(distance(F.col("fp"), F.col("dst")) <= radius)
    pairs = pairs.select(F.greatest("fp", "dst").alias("src"), F.least("fp", "dst").alias("dst"))

    # Everyone whose probe reaches a heavy key takes part in that key's centres.
    near = probes.select("fp", "seg", named).join(crowded, ["seg", "k"], "left_semi").select("fp").distinct()
    centres = near.select("fp", F.explode(F.transform(F.lit(ball(64, radius // 2)), lambda m: F.col("fp").bitwiseXOR(m))).alias("centre"))
    least = centres.groupBy("centre").agg(F.min("fp").alias("dst"), F.count("*").alias("n")).where("n > 1").drop("n")
    tied = centres.join(least.hint("merge"), "centre").where("fp <> dst").select(F.col("fp").alias("src"), "dst")
    return pairs.unionByName(tied).distinct()


def _with_least(edges: DataFrame, own: bool) -> DataFrame:
    """``edges`` (u, v) with m, the least v of u (u itself included if ``own``).

    The least values are summed up in each task before they move.  They are joined by another
    name of u, so both sides of the join are shuffled for it and adaptive execution can split
    the edges of a hub.
    """
    named = lambda c: F.col(c).bitwiseXOR(F.lit(1).cast("long")).alias("k")
    low = edges.select(F.col("u").alias("w"), F.col("v").alias("p")).groupBy("w").agg(F.min("p").alias("p"))
    low = low.select(named("w"), (F.least("w", "p") if own else F.col("p")).alias("m"))
    return edges.select("u", "v", named("u")).join(low.hint("merge"), "k").select("u", "v", "m")


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that reaches a smaller one.

    Alternates large-star and small-star steps until the edges no longer change, each
    round written as a reliable checkpoint.  All state is distributed.
    """
    now = checkpointed(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, own=True).where("v > u")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_least(large, own=False)
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = checkpointed(small.select("e.u", "e.v").where("u <> v").distinct())
        same = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() == now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = new
        if same:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2, n_segments: int = 2, heavy: int = 64) -> DataFrame:
    """(id, fingerprint, component_id), one row per input row.

    Texts without words (null, blank) share fingerprint zero and are linked like others;
    repeated ids keep their rows; a row with a null id links others as any row does, gets its
    component's id and is never chosen as one unless the whole component has no other.  Only
    the two columns are read.  An empty table gives an empty result.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = staged(fingerprints(docs, size=size), "fingerprints")
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fp-nodes")
    roots = components(links(nodes.select("fp"), radius, n_segments, heavy))
    root = F.coalesce("root", "fp")
    classes = nodes.join(roots.hint("merge"), nodes["fp"] == roots["node"], "left").select("fp", "rep", root.alias("root"), root.bitwiseXOR(F.lit(1).cast("long")).alias("k"))
    least = classes.groupBy("root").agg(F.min("rep").alias("component_id")).select(F.col("root").bitwiseXOR(F.lit(1).cast("long")).alias("k"), "component_id")
    named = classes.join(least.hint("merge"), "k").select("fp", "component_id")
    out = prints.join(named.hint("merge"), "fp")
    return out.select(F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Near copies by similarity: fingerprints tie most of them, prefixes of the shingle sets find every
# other candidate, the whole sets decide on both.

#: One row in SAMPLE is read for the common shingles, of which at most COMMON are told to the tasks.
SAMPLE = 16
COMMON = 200_000
#: Bytes kept of a shingle's hash, and slots of a sketch.
WIDTH = 5
SKETCH = 128
#: Pairs whose sketches estimate less than the similarity by MARGIN, over five standard errors, aren't compared whole.
MARGIN = 0.2
#: Up to so many open members of a key are compared with each other, more by their edits to one of them.
CROWDED = 32
#: Far above what sums of counts and shares of them err by, far below what they differ by.
_EPS = 1e-6
_LOT = 1 << 16


def _packed(hashes: np.ndarray) -> np.ndarray:
    """The sorted distinct hashes of the shingles, as they are kept."""
    return np.unique(hashes & np.uint64((1 << 8 * WIDTH) - 1)).astype("<i8")


def _unpacked(lot: bytes) -> np.ndarray:
    out = np.zeros((len(lot) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(lot, np.uint8).reshape(-1, WIDTH)
    return out.view("<i8").ravel()


def _sketch(grams: np.ndarray) -> np.ndarray:
    """One-permutation minima: seven bits of the least rank of the hashes in each of SKETCH slots,
    -1 for an empty slot.  Equal slots among those in use estimate Jaccard similarity, never by
    much too little: unequal ranks may agree in the bits kept, equal ones do."""
    least = np.full(SKETCH, np.iinfo(np.int64).max)
    np.minimum.at(least, grams % SKETCH, grams // SKETCH)
    return np.where(least == np.iinfo(np.int64).max, -1, least & 0x7F).astype(np.int8)


def _word_digest(text: str | None) -> tuple[int, int]:
    digest = xxhash.xxh3_128_intdigest(b" ".join(_WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))))
    return digest >> 64, digest & ((1 << 64) - 1)


def word_digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, same, also): both halves of a 128-bit digest of the word sequence.  Copies have equal digests."""

    def setup() -> Mapper:
        def mapper(texts: list[str | None]) -> tuple[None, list]:
            found = [_word_digest(t) for t in texts]
            return None, [np.fromiter((f[k] for f in found), np.uint64, len(found)).view(np.int64) for k in (0, 1)]

        return mapper

    return map_texts(df, id_col, text_col, setup, "same long, also long")


def shingle_sets(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, same, also, fp, grams, sketch): the digest of ``word_digests``, the SimHash fingerprint of
    the ``size``-word shingles, their sorted distinct hashes and their sketch."""

    def setup() -> Mapper:
        def one(text: str | None) -> tuple[int, int, int, bytes, bytes]:
            hashes = shingle_hashes(text, size)
            grams = _packed(hashes if len(hashes) else np.array([xxhash.xxh64_intdigest(b"", 42)], np.uint64))
            return *_word_digest(text), fingerprint(hashes), grams.view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes(), _sketch(grams).tobytes()

        def mapper(texts: list[str | None]) -> tuple[None, list]:
            found = [one(t) for t in texts]
            longs = [np.fromiter((f[k] for f in found), np.uint64, len(found)).view(np.int64) for k in (0, 1, 2)]
            return None, [*longs, [f[3] for f in found], [f[4] for f in found]]

        return mapper

    return map_texts(df, id_col, text_col, setup, "same long, also long, fp long, grams binary, sketch binary")


def common_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many rows share, by a sample, with their counts.  They only move to the end
    of the order of shingles: any order gives the same pairs, this one gives few candidates."""

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(_unpacked(lot.as_py()))], ["key"])

    seen = sets.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).select("grams").mapInArrow(all_of, "key long")
    rows = seen.groupBy("key").agg(F.count("*").alias("n")).where("n > 3").orderBy(F.desc("n"), "key").limit(COMMON).collect()
    keys, counts = np.array([r.key for r in rows], np.int64), np.array([r.n for r in rows], np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def _weights(grams: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    keys, counts = common
    if not len(keys):
        return np.zeros(len(grams), np.int64)
    at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
    return np.where(keys[at] == grams, counts[at], 0)


def prefixes(sets: DataFrame, similarity: float, common: Broadcast) -> DataFrame:
    """(key, node, at, rare): the first shingles of each set of n, rare ones before common ones; ``at``
    is place << 32 | n, ``rare`` the thousandths of the set that are not ``common``.  Two sets of
    ``similarity`` or more share at least one of them."""

    def first_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lot_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], ["key", "node", "at", "rare"])

        rows, held = [], 0
        for batch in batches:
            for node, lot in zip(batch.column(0), batch.column(1)):
                grams = _unpacked(lot.as_py())
                weight = _weights(grams, common.value)
                n = len(grams)
                part = grams[np.argsort(weight, kind="stable")][: n - math.ceil(similarity * n - 1e-9) + 1]  # grams are sorted
                rare = np.full(len(part), 1000 * np.count_nonzero(weight == 0) // n, np.int16)
                rows.append((part, np.full(len(part), node.as_py()), np.arange(len(part)) << 32 | n, rare))
                held += len(part)
                if held >= _LOT:
                    yield lot_of(rows)
                    rows, held = [], 0
        if rows:
            yield lot_of(rows)

    return sets.select("node", "grams").mapInArrow(first_of, "key long, node long, at long, rare smallint")


def _possible(a: str, b: str, similarity: float) -> Column:
    """Whether two sets that share the shingle at ``pos`` can reach ``similarity`` at all."""
    n, m = (F.col(f"{x}.at").bitwiseAND(F.lit((1 << 32) - 1)) for x in (a, b))
    i, j = (F.shiftright(F.col(f"{x}.at"), 32) for x in (a, b))
    most = F.least(i, j) + F.least(n - i, m - j)
    return most * (1 + similarity) >= (n + m) * similarity - 1e-6


def _estimate(x: bytes, y: bytes) -> float:
    x, y = np.frombuffer(x, np.int8), np.frombuffer(y, np.int8)
    used = (x >= 0) | (y >= 0)
    return ((x == y) & used).sum() / used.sum()


def _jaccard(x: bytes, y: bytes) -> float:
    x, y = _unpacked(x), _unpacked(y)
    inner = len(np.intersect1d(x, y, assume_unique=True))
    return inner / (len(x) + len(y) - inner)


def _beside(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """The ``pairs`` (a, b) with x and y, the ``column`` of each."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    one = sets.select("node", F.col(column).alias("v")).join(needed.hint("shuffle_hash"), "node", "left_semi")
    return pairs.join(one.select(F.col("node").alias("a"), F.col("v").alias("x")), "a").join(one.select(F.col("node").alias("b"), F.col("v").alias("y")), "b")


def _passing(pairs: DataFrame, sets: DataFrame, column: str, measure: Callable[[bytes, bytes], float], least: float) -> DataFrame:
    """The pairs (a, b) whose ``column`` has a ``measure`` of ``least`` or more; a written table."""
    both = _beside(pairs, sets, column)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [measure(x.as_py(), y.as_py()) >= least - 1e-9 for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return staged(both.select("a", "b", "x", "y").mapInArrow(judge, "a long, b long"), "near-pairs")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): the pairs (a, b) whose whole sets have a Jaccard similarity of ``similarity`` or more."""
    likely = _passing(staged(pairs.distinct(), "near-met"), sets, "sketch", _estimate, similarity - MARGIN)
    return _passing(likely, sets, "grams", _jaccard, similarity).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def fingerprint_edges(sets: DataFrame, similarity: float, radius: int = 2, n_segments: int = 2, heavy: int = 64) -> DataFrame:
    """(src, dst): of the nodes whose fingerprints multi-index hashing links, edges of Jaccard
    ``similarity`` or more: each node with the least of its fingerprint, these with each other."""
    nodes = sets.select("node", "fp")
    leads = staged(nodes.groupBy("fp").agg(F.min("node").alias("lead")), "near-prints")
    own = nodes.join(leads.hint("merge"), "fp").where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    named = lambda fp, lead: leads.select(F.col("fp").alias(fp), F.col("lead").alias(lead)).hint("merge")
    linked = links(leads.select("fp"), radius, n_segments, heavy).join(named("src", "a"), "src").join(named("dst", "b"), "dst").select("a", "b")
    pairs = own.unionByName(linked)
    return _alike(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), sets, similarity)


def _edits(x: np.ndarray, head: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[bool, np.ndarray, int, int]:
    """Whether ``x`` is as similar to ``head`` as asked; the shingles that only one of them has,
    those first that few sets near ``head`` have as edits; how many of them ``x`` shows as the
    lesser and as the greater of a pair (see ``edit_pairs``)."""
    c = (1 - similarity) / (1 + similarity)
    extra, lost = np.setdiff1d(x, head, assume_unique=True), np.setdiff1d(head, x, assume_unique=True)
    often = np.concatenate([_weights(extra, common), _weights(head, common).max() - _weights(lost, common)])
    grams = np.concatenate([extra, lost])
    grams = grams[np.lexsort((grams, often))]
    d, n = len(grams), len(x)
    inner = n - len(extra)
    near = inner / (n + len(lost)) >= similarity - 1e-9
    w, far = d - c * n, c * len(head)
    shown = lambda least: max(d - max(math.ceil(least - _EPS), 1) + 1, 0)
    return near, grams, shown((max(w, far) + w) / 2), 0 if near else shown((w + max(w - 2 * c * n / similarity, -c * n / similarity)) / 2)


def edit_pairs(stars: DataFrame, sets: DataFrame, similarity: float, common: Broadcast) -> tuple[DataFrame, DataFrame]:
    """Of ``stars`` (a: a node, b: its head, root: its component): edges (src, dst) of the nodes to
    similar heads, and pairs (a, b) with every other similar pair of nodes that share a head.

    Let d(x) be the number of shingles that only one of x and the head has, its edits, and w(x)
    = d(x) - c |x| with c = (1 - s) / (1 + s).  Then x is similar to the head if w(x) <= c |head|, and x
    and y are similar if they share (w(x) + w(y)) / 2 edits or more.  So unless both are similar to the
    head, which ties them, they share an edit, and the prefix filter holds for edits: what all have
    in common meets no one.  The greater of a pair by w isn't similar to the head, which bounds the
    edits that the lesser has to show; the greater shows more, as w(y) >= w(x) - 2 c |y| and
    |y| <= |x| / s.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["head", "node", "root", "d", "n", "key", "place", "lesser", "greater"]
        for batch in batches:
            for a, b, root, x, y in zip(*(batch.column(k) for k in range(5))):
                x, y = _unpacked(x.as_py()), _unpacked(y.as_py())
                near, grams, lesser, greater = _edits(x, y, common.value, similarity)
                place = np.arange(max(lesser, greater))
                m = len(place) + near  # a similar head has a row without a key
                same = [pa.array(np.full(m, v)) for v in (b.as_py(), a.as_py(), root.as_py(), len(grams), len(x))]
                keys = pa.array([*grams[: len(place)].tolist(), *[None] * near], pa.int64())
                places = np.append(place, [-1] * near).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*same, keys, pa.array(places), pa.array((places >= 0) & (places < lesser)), pa.array((places >= 0) & (places < greater))], names)

    shown = _beside(stars, sets, "grams").select("a", "b", "root", "x", "y").mapInArrow(told, "head long, node long, root long, d long, n long, key long, place long, lesser boolean, greater boolean")
    shown = staged(shown, "near-edits")
    w = F.col("d") - F.col("n") * F.lit((1 - similarity) / (1 + similarity))
    told_by = lambda role: shown.where(role).select("head", "key", F.struct("node", "root", w.alias("w"), (F.col("d") - F.col("place")).alias("left")).alias(role))
    x, y = F.col("greater"), F.col("lesser")
    met = told_by("greater").join(told_by("lesser"), ["head", "key"]).where((x["root"] != y["root"]) & (y["w"] <= x["w"] + _EPS) & (2 * F.least(x["left"], y["left"]) >= x["w"] + y["w"] - _EPS))
    ends = x["node"], y["node"]
    return shown.where("key IS NULL").select(F.col("node").alias("src"), F.col("head").alias("dst")), met.select(F.greatest(*ends).alias("a"), F.least(*ends).alias("b"))


def similar_edges(sets: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): edges with the same components as all pairs of ``sets`` (node, fp, grams, sketch),
    one row a node and best dealt by node, of Jaccard ``similarity`` or more.

    First come the pairs whose fingerprints multi-index hashing links.  What they leave apart is met
    by shared prefixes.  Twice the members of each shared key are compared with one of them, that of
    the fewest rare shingles and then that of the least hash, which all keys of a cluster or of a common
    passage share, so they are tied by few pairs.  Then the pairs that are still in different components
    are compared: all of a key of up to CROWDED members, of others those that share edits to the one
    of the fewest rare shingles.
    """
    member, key = F.struct("node", "at", "rare"), Window.partitionBy("key")
    tied = fingerprint_edges(sets, similarity)
    common = sets.sparkSession.sparkContext.broadcast(common_shingles(sets))
    told = prefixes(sets, similarity, common).select("key", member.alias("me"), F.min("node").over(key).alias("lo"), F.max("node").over(key).alias("hi"))
    members = staged(told.where("lo < hi").select("key", "me").distinct(), "near-keys")

    def still_open() -> DataFrame:
        """Members of the keys that several components share."""
        now = members.join(components(tied), F.col("me.node") == F.col("node"), "left").select("key", "me", F.coalesce("root", "me.node").alias("root"))
        now = now.withColumns({"lo": F.min("root").over(key), "hi": F.max("root").over(key)}).where("lo < hi")
        return staged(now.select("key", "me", "root"), "near-open")

    def headed(rooted: DataFrame, order: Column) -> DataFrame:
        head = F.min(F.struct(order.alias("order"), F.xxhash64("me.node").alias("draw"), "me", "root")).over(key)
        return rooted.select("me", "root", head.alias("h"), F.count("*").over(key).alias("size"))

    rooted = still_open()
    for order in (F.col("me.rare"), F.xxhash64(F.lit(1), "me.node")):
        stars = headed(rooted, order).where("root <> h.root").select("me", F.col("h.me").alias("head")).where(_possible("me", "head", similarity))
        tied = tied.unionByName(_alike(stars.select(F.greatest("me.node", "head.node").alias("a"), F.least("me.node", "head.node").alias("b")), sets, similarity))
        rooted = still_open()
    sized = rooted.withColumn("size", F.count("*").over(key))
    x = sized.where(F.col("size") <= CROWDED).drop("size")
    y = x.select("key", F.col("me").alias("you"), F.col("root").alias("other"))
    rest = x.join(y, "key").where("me.node > you.node AND root <> other").where(_possible("me", "you", similarity)).select(F.col("me.node").alias("a"), F.col("you.node").alias("b"))
    stars = headed(rooted, F.col("me.rare")).where((F.col("size") > CROWDED) & (F.col("me.node") != F.col("h.me.node")))
    near, edited = edit_pairs(stars.select(F.col("me.node").alias("a"), F.col("h.me.node").alias("b"), "root").distinct(), sets, similarity, common)
    return tied.unionByName(near).unionByName(_alike(rest.unionByName(edited), sets, similarity))


def keep_representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, heavy: int = 16) -> DataFrame:
    """One row of each group of near copies, that of the smallest id; all columns as they are.

    Copies have the same words in the same order (case aside); near copies have a Jaccard
    similarity of ``similarity`` or more of their ``size``-word shingles.  SimHash fingerprints, looked up by
    multi-index hashing, meet most of them, prefixes of the sets all others (see MARGIN).  Groups are closed transitively.  Null and blank texts are copies of each other.  A
    row with a null id stays unless a copy with an id does; of wholly repeated rows one stays.
    An empty table stays empty; columns may have any names.
    ``heavy`` is accepted for callers of old and changes nothing.
    """
    k1, k2 = (next(n for n in (f"_k{i}" + "_" * j for j in range(len(df.columns) + 1)) if n.lower() not in {c.lower() for c in df.columns}) for i in (1, 2))
    keys = [F.xxhash64(id_col, text_col), F.xxhash64(text_col, id_col)]  # null-safe name of a row
    row = df.select(F.struct(F.col(id_col).alias("id"), keys[0].alias("k1"), keys[1].alias("k2")).alias("row"), F.col(text_col).alias("text"))
    found = staged(word_digests(row, "row", "text").select("row.*", F.col("same").alias("node"), "also"), "near-rows")
    # Sets are wide: they are kept once, dealt by node, and made from the texts again rather than written before.
    wide = shingle_sets(row, "row", "text", size).select("row.id", F.col("same").alias("node"), "fp", "grams", "sketch")
    once = wide.where("id IS NOT NULL").groupBy("node").agg(F.first("fp").alias("fp"), F.first("grams").alias("grams"), F.first("sketch").alias("sketch"))
    edges = similar_edges(bucketed(once, "near-sets", "node", compression="none"), similarity)
    # A node is a distinct text, not an id: texts that share an id stay apart.  Should different
    # texts ever share the half of the digest that names the node, all but one count by themselves.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("first")
    nodes = found.groupBy("node", "also").agg(first).withColumn("main", F.min("also").over(Window.partitionBy("node"))).join(components(edges), "node", "left")
    kept = nodes.groupBy(F.coalesce("root", "node").alias("root"), F.when(F.col("also") != F.col("main"), F.col("also")).alias("apart")).agg(F.min("first").alias("first"))
    kept = staged(kept.select("first.k1", "first.k2"), "kept")
    named = kept.select(F.col("k1").alias(k1), F.col("k2").alias(k2))
    rows = df.select("*", keys[0].alias(k1), keys[1].alias(k2)).join(named, [k1, k2], "left_semi")
    repeated = found.join(kept, ["k1", "k2"], "left_semi").groupBy("k1", "k2").count().where("count > 1")
    if not repeated.isEmpty():  # only wholly repeated rows need another look
        rows = rows.dropDuplicates([k1, k2])
    return rows.select(*df.columns)

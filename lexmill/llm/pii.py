"""Information-theoretic sanitisation, in DataFrame functions only.

The base scan finds e-mail addresses, IP addresses, payment cards and phone numbers: the
protected entities.  The corpus then says which other terms reveal them.  With N documents,
n(t) of them holding term t, n(e) entity e and n(t,e) both of them anywhere in the text,

    PMI(t;e) = log(N n(t,e) / (n(t) n(e))),     IC(e) = -log(n(e) / N)

PMI is at most IC, which it reaches if t stands nowhere but beside e: t then discloses e
wholly.  In documents that hold e, every occurrence of t is generalised from ``generalise`` of
IC on, to the broader term that its shape tells (a code, an acronym, a name, a word), and removed
from ``remove`` of IC on.  Pairs are judged by this ratio alone, however few
documents hold them.  The ratio also guards common terms: for an entity in n(e) documents, a
term in more than n(e)^g N^(1-g) of them never reaches the share g.

All counts are of the documents that hold something, so entities that stand in the same documents
have the same counts with every term.  They are judged as one class: a log with thousands of
addresses of its own is one class beside its terms, not thousands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import staged

KINDS = ("email", "ip", "card", "phone", "term")

#: The base patterns, written so that no text makes them backtrack: a match of ``email`` or
#: ``ip`` can only begin where its run of characters begins or the last match ended (\G),
#: and a repetition that nothing after it could shorten is possessive.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has none of the pattern above.
CHEAP = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
TERM = r"\p{L}[\p{L}\p{Nd}]{2,}+"
SPAN = "array<struct<start:int,end:int,value:string>>"
#: The broader terms, by shape.
GENERAL = ("[WORD]", "[NAME]", "[ACRONYM]", "[CODE]")
#: Matches put together at a time, and characters of a stretch of text, so that arrays and strings
#: aren't copied whole for each match of a long text.
BLOCK, STRETCH = 200, 1024
#: Parts that an entity's rows are dealt over in joins.
SALTS = 16


def _parts(text: Column, pattern: str) -> Column:
    """The gap before each match and the match; the last has none."""
    return F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("value"))
    )


def _placed(parts: Column) -> Column:
    """(at, out): where the last match ends, and the matches with their places."""

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        hit = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.when(x["value"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(hit)).alias("out")))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), add)


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks_of(items: Column) -> Column:
    last = F.floor((F.size(items) - 1) / BLOCK).cast("int")
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.filter(F.array(items), lambda x: F.lit(False)))


def located(text: Column, pattern: str) -> Column:
    """Matches with their places, from the lengths of the matches and of the gaps between them,
    block by block."""

    def shifted(x: Column, by: Column) -> Column:
        return F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["value"].alias("value"))

    def whole(parts: Column) -> Column:
        blocks = F.transform(_blocks_of(parts), _placed)
        joined = lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.transform(b["out"], lambda x: shifted(x, acc["at"]))).alias("out"))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), joined)["out"]

    return _once(_parts(text, pattern), whole)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, k: Column) -> Column:
        d = F.substring(digits, k, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when((F.length(digits) - k) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _small(part: Column) -> Column:
    value = F.regexp_replace(part, "^0+", "")
    return (F.length(value) <= 3) & (F.coalesce(value.try_cast("int"), F.lit(0)) <= 255)


_VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), _small),
    "card": lambda v: F.when(F.length(_digits(v)).between(12, 19), _luhn(_digits(v))).otherwise(False),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def base_spans(text: Column, kind: str) -> Column:
    """Valid matches of one kind; failing matches are dropped without a retry."""
    maybe = text.contains(CHEAP[kind]) if kind == "email" else text.rlike(CHEAP[kind])
    hits = F.filter(located(text, PATTERNS[kind]), lambda x: _VALID[kind](x["value"]))
    return F.when(maybe, hits).otherwise(F.array().cast(SPAN))


def _named(term: Column) -> Column:
    return F.xxhash64(F.lower(term))


def _blanked(text: Column, kind: str) -> Column:
    """``text`` with as many control characters in place of each valid match of one kind."""
    hits = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    shown = lambda gap, hit: F.concat(gap, F.when(hit.isNull(), "").when(_VALID[kind](hit), F.repeat(F.lit("\x01"), F.length(hit))).otherwise(hit))
    return F.array_join(F.zip_with(F.split(text, PATTERNS[kind], -1), hits, shown), "")


def _without(text: Column, kind: str) -> Column:
    held = F.exists("spans", lambda b: b["kind"] == kind)
    return _once(text, lambda t: F.when(held, _blanked(t, kind)).otherwise(t))


def _shape(term: Column) -> Column:
    """Which of GENERAL is broader than the term."""
    return F.when(term.rlike(r"\p{Nd}"), 3).when(~term.rlike(r"\p{Ll}"), 2).when(term.rlike(r"^\p{Lu}"), 1).otherwise(0)


def _free(text: Column) -> Column:
    """(t, start, end, shape) of all terms of a text whose base spans are blanked; t names the term."""
    told = lambda x: F.struct(_named(x["value"]).alias("t"), x["start"].alias("start"), x["end"].alias("end"), _shape(x["value"]).alias("shape"))
    return F.transform(located(text, TERM), told)


def _tagged(order: int, kind: str) -> Column:
    def tag(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["value"].alias("value"))

    return F.transform(F.col(kind), tag)


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def scan(df: DataFrame, id_col: str, text_col: str, *carried: Column) -> DataFrame:
    """(carried, doc_id, text, h, spans): base spans by start and kind; h tells texts apart."""
    docs = df.select(*carried, F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kept = docs.columns
    by_kind = docs.select(*kept, *[base_spans(F.col("text"), k).alias(k) for k in PATTERNS])
    tagged = [_tagged(order, kind) for order, kind in enumerate(PATTERNS)]
    return by_kind.select(*kept, F.xxhash64("text").alias("h"), F.array_sort(F.concat(*tagged)).alias("spans"))


def term_counts(df: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(t, n_t): in how many rows each of ``terms`` stands.  Counts are combined before they move."""
    found = F.transform(F.regexp_extract_all(F.col(text_col), F.lit(TERM), F.lit(0)), _named)
    # An inner join: a semi-join would be pushed below the counts, onto every word of the corpus.
    return df.select(F.explode(F.array_distinct(found)).alias("t")).groupBy("t").agg(F.count("*").alias("n_t")).join(terms, "t")


def with_classes(dirty: DataFrame) -> DataFrame:
    """``dirty`` (row, entities, ...) with ``classes`` in place of ``entities``: entities of the
    same rows are one class, named by sums of the rows' hashes."""
    held = dirty.select("row", F.explode("entities").alias("e"))
    # One entity may stand in a third of all rows: its rows are dealt over salts.
    held = held.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    thirds = [F.sum(F.shiftrightunsigned(F.xxhash64(F.lit(k), "row"), 33)).alias(f"s{k}") for k in range(3)]
    parts = held.groupBy("e", "salt").agg(F.count("*").alias("n"), *thirds)
    whole = parts.groupBy("e").agg(F.xxhash64(F.sum("n"), *[F.sum(f"s{k}") for k in range(3)]).alias("c"))
    told = held.join(parts.select("e", "salt").join(whole, "e"), ["e", "salt"])
    return dirty.drop("entities").join(told.groupBy("row").agg(F.collect_set("c").alias("classes")), "row")


def disclosing(df: DataFrame, dirty: DataFrame, n_docs: int, text_col: str, generalise: float) -> DataFrame:
    """(e, t, ratio) of the pairs whose PMI is at least ``generalise`` of the entity's IC.
    ``dirty`` has the classes of entities and the free terms of the rows with base spans."""
    each = dirty.select(F.explode("classes").alias("e"), F.array_distinct(F.col("free.t")).alias("ts"))
    entities = each.groupBy("e").agg(F.count("*").alias("n_e"))
    pairs = staged(each.select("e", F.explode("ts").alias("t")).groupBy("e", "t").agg(F.count("*").alias("n_te")), "pii-pairs")
    counts = staged(term_counts(df, pairs.select("t").distinct(), text_col), "pii-counts")
    n = F.lit(float(n_docs))
    pmi = F.log(n * F.col("n_te") / (F.greatest("n_t", "n_te") * F.greatest("n_e", "n_te")))
    ic = -F.log(F.col("n_e") / n)
    # Terms in a thousandth of all rows are few and stand in many pairs: they are broadcast, the others joined.
    many = F.col("n_t") * 1000 >= n
    often = F.broadcast(counts.where(many))
    told = pairs.join(often, "t").unionByName(pairs.join(often, "t", "left_anti").join(counts.where(~many), "t"))
    return told.join(entities, "e").select("e", "t", F.when(ic > 0, pmi / ic).alias("ratio")).where(F.col("ratio") >= generalise)


def find_private(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = 0.75, remove: float = 0.9, salts: int = SALTS
) -> tuple[DataFrame, DataFrame]:
    """(scanned, terms): ``scan`` without texts, and for rows with disclosing terms
    (doc_id, h, terms: start, order, kind, end, value).  What is read more than once is a written table."""
    base = scan(df, id_col, text_col)
    entities = F.array_distinct(F.transform("spans", lambda b: F.xxhash64(b["kind"], F.lower(b["value"]))))
    plain = F.col("text")
    for kind in PATTERNS:
        plain = _without(plain, kind)
    free = F.when(F.size("spans") > 0, _free(plain))
    scanned = staged(base.select(F.monotonically_increasing_id().alias("row"), "doc_id", "h", "spans", entities.alias("entities"), free.alias("free")), "pii-scan")
    n_docs = scanned.count()
    dirty = staged(with_classes(scanned.where(F.size("spans") > 0).select("row", "doc_id", "h", "entities", "free")), "pii-dirty")
    telling = disclosing(df, dirty, n_docs, text_col, generalise)
    # A class may hold a third of all rows: the pairs are spread over salts before the join.
    telling = telling.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    near = dirty.select("doc_id", "h", F.explode("classes").alias("e"), "free").select("doc_id", "h", "e", F.explode("free").alias("f")).select("doc_id", "h", "e", "f.*")
    spread = near.withColumn("salt", F.pmod(F.xxhash64("doc_id", "h", "start"), F.lit(salts)).cast("int"))
    hits = spread.join(telling, ["e", "t", "salt"]).groupBy("doc_id", "h", "start", "end").agg(F.max("ratio").alias("ratio"), F.first("shape").alias("shape"))
    value = F.when(F.col("ratio") >= remove, "").otherwise(F.get(F.array(*map(F.lit, GENERAL)), F.col("shape")))
    one = F.struct(F.col("start"), F.lit(4).alias("order"), F.lit("term").alias("kind"), F.col("end"), value.alias("value"))
    terms = hits.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(one)).alias("terms"))
    return scanned.drop("row", "entities", "free"), terms


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _both(left: DataFrame, terms: DataFrame) -> DataFrame:
    """``terms`` beside each row of ``left``; null ids match each other, rows may repeat."""
    t = terms.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "terms")
    return left.join(t, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")), "left").drop("_d", "_h")


def base_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts of the base spans and their digest.  No shuffle."""
    found = scan(df, id_col, text_col)
    return found.select(F.col("doc_id").alias(id_col), *[_count(kind) for kind in PATTERNS], F.sha2(_listed(F.col("spans")), 256).alias("base_sha256"))


def private_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: float) -> DataFrame:
    """One row per input row: counts of base spans, their digest, and all spans.

    A null text counts as empty; an empty text has no spans.  Repeated rows repeat their
    result and count as documents of their own in the statistics.  Ties in start are
    ordered by kind.  Other columns are not read.  An empty table gives an empty result.
    """
    scanned, terms = find_private(df, id_col, text_col, **limits)
    full = _both(scanned, terms)
    counts = [_count(kind) for kind in PATTERNS]
    everything = F.array_sort(F.concat("spans", F.coalesce("terms", F.filter("spans", lambda x: F.lit(False)))))
    return full.select(
        F.col("doc_id").alias(id_col), *counts, F.sha2(_listed(F.col("spans")), 256).alias("base_sha256"), _listed(everything).alias("spans"),
        F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_term"),
    )


_CUTS = "array<struct<from:int,to:int,mark:string>>"


def _cut(stretches: Column, start: Column, end: Column) -> Column:
    """The text from start to end, of its stretches."""
    i, j = (start / STRETCH).cast("int"), (end / STRETCH).cast("int")
    first = F.get(stretches, i)
    many = F.concat(
        F.coalesce(F.substring(first, start % STRETCH + 1, F.lit(STRETCH)), F.lit("")),
        F.array_join(F.slice(stretches, i + 2, F.greatest(j - i - 1, F.lit(0))), ""),
        F.coalesce(F.substring(F.get(stretches, j), F.lit(1), end % STRETCH), F.lit("")),
    )
    return F.when(end <= start, "").when(i == j, F.substring(first, start % STRETCH + 1, end - start)).otherwise(many)


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span's place taken by its mark; overlapping spans become one."""
    none = F.array().cast(_CUTS)

    def add(acc: Column, x: Column) -> Column:
        mark = F.when(x["kind"] == "term", x["value"]).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        cut = F.struct(acc["at"].alias("from"), x["start"].alias("to"), mark.alias("mark"))
        fresh = F.struct(x["end"].alias("at"), F.concat(acc["out"], F.array(cut)).alias("out"))
        inside = F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(x["start"] >= acc["at"], fresh).otherwise(inside)

    def block(acc: Column, spans: Column) -> Column:
        own = F.aggregate(spans, F.struct(acc["at"].alias("at"), none.alias("out")), add)
        return _once(own, lambda b: F.struct(b["at"].alias("at"), F.concat(acc["out"], b["out"]).alias("out")))

    def shown(x: Column) -> Column:
        parts = F.transform(x["cuts"]["out"], lambda c: F.concat(_cut(x["text"], c["from"], c["to"]), c["mark"]))
        return F.concat(F.array_join(parts, ""), _cut(x["text"], x["cuts"]["at"], F.length(text)))

    cuts = F.aggregate(_blocks_of(spans), F.struct(F.lit(0).alias("at"), none.alias("out")), block)
    return _once(F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)).alias("text"), cuts.alias("cuts")), shown)


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, **limits: float) -> DataFrame:
    """``df`` with every private span masked in ``text_col``; all other columns as they are,
    but for ``length_col``, which then holds the masked text's length.

    Rows without any base span are not joined to anything.  Null texts stay null.
    """
    _, terms = find_private(df, id_col, text_col, **limits)
    names = df.columns
    found = scan(df, id_col, text_col, F.struct(*names).alias("_row"))
    clean = found.where(F.size("spans") == 0).select("_row.*")
    dirty = _both(found.where(F.size("spans") > 0), terms)
    everything = F.array_sort(F.concat("spans", F.coalesce("terms", F.filter("spans", lambda x: F.lit(False)))))
    shown = dirty.select("_row", masked(F.col("_row")[text_col], everything).alias("_text"))
    replaced = {text_col: F.col("_text")} | ({length_col: F.length("_text").cast(df.schema[length_col].dataType)} if length_col else {})
    return clean.unionByName(shown.select(*[replaced.get(c, F.col("_row")[c]).alias(c) for c in names]))

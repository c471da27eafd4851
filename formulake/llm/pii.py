"""Personal data: base patterns, and information-theoretic sanitisation. DataFrame functions only.

The values of base spans are protected entities. The corpus tells how strongly
a term reveals an entity with which it shares documents: with document
probabilities, the disclosure of t about e is log(p(e, t) / (p(e) p(t))) / -log
p(e), the part of e's information that t gives away; 1 means that t occurs with
e alone. Terms above a threshold become spans of their own wherever they stand
in the documents that hold the entity; sanitize() generalises all spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

#: Order of kinds at equal starts.
KINDS = ("email", "ip", "card", "phone", "term")
#: The fewest letters of a term.
LEAST_TERM = 4
#: A term is told with an entity in so many documents at least, and discloses so much of it.
SUPPORT, DISCLOSURE = 2, 0.8
#: Most bytes of terms (and 64 for each) that are sent to all tasks; beyond, all words are counted and joined by a shuffle.
BROADCAST_BYTES = 16 << 20

# Each gives the leftmost, non-overlapping matches of the contract's pattern (but for runs of digits too short for a card) without going over a run of characters again and again.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap conditions without which a pattern can't match.
_MAY = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"), "card": lambda t: t.rlike(PATTERNS["card"]), "phone": lambda t: t.contains("+")}
_TERM = rf"[\p{{L}}\p{{M}}]{{{LEAST_TERM},}}+"
_SPAN = "struct<s: int, k: int, e: int, v: string>"
_CHUNK = 64


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    def total(d: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            n = F.substr(d, -i, F.lit(1)).cast("int")
            twice = 2 * n
            return acc + F.when(i % 2 == 1, n).when(twice > 9, twice - 9).otherwise(twice)

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0

    return let(_digits(m), lambda d: F.when(F.length(d).between(12, 19), total(d)).otherwise(False))


def _small_parts(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda x: (F.length(x) <= 3) & (F.when(F.length(x) <= 3, F.when(x == "", F.lit(0)).otherwise(x.cast("int"))).otherwise(999) <= 255)))


_HOLDS = {"email": lambda m: F.lit(True), "ip": _small_parts, "card": _luhn, "phone": lambda m: F.length(_digits(m)).between(9, 15)}


def placed(text: Column, pattern: str) -> Column:
    """(start, match) of all matches: lengths of what stands between matches, summed up in chunks, and over chunks. No step copies what is done."""
    one = "struct<s: int, m: string>"

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["gap"])
        return F.struct((at + F.length(x["m"])).alias("at"), F.concat(acc["out"], F.array(F.struct(at.alias("s"), x["m"].alias("m")))).alias("out"))

    def begins(chunks: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<int>)").alias("out"))
        return F.aggregate(chunks, start, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    def of(found: Column) -> Column:
        pairs = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
        empty = F.struct(F.lit(0).alias("at"), F.expr(f"CAST(array() AS array<{one}>)").alias("out"))

        def chunked(p: Column) -> Column:
            size = F.greatest(F.lit(_CHUNK), F.ceil(F.cbrt(2 * F.size(p))).cast("int"))  # the fewest copies in and over chunks
            return F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / size).cast("int")), lambda i: F.aggregate(F.slice(p, i * size + 1, size), empty, step))

        whole = lambda c: F.flatten(F.zip_with(c, begins(c), lambda x, at: F.transform(x["out"], lambda y: F.struct((y["s"] + at).alias("s"), y["m"].alias("m")))))
        return let(let(pairs, chunked), whole)

    nothing = F.expr(f"CAST(array() AS array<{one}>)")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, of(found)).otherwise(nothing))


def base_spans(text: Column, kind: str) -> Column:
    """Spans (s, k, e, v) of one kind: start, number of the kind, end, value."""
    k = KINDS.index(kind)
    good = F.filter(placed(text, PATTERNS[kind]), lambda x: _HOLDS[kind](x["m"]))
    spans = F.transform(good, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), (x["s"] + F.length(x["m"])).alias("e"), x["m"].alias("v")))
    return F.when(_MAY[kind](text), spans).otherwise(F.expr(f"CAST(array() AS array<{_SPAN}>)"))


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, key, base, words) for each row: its base spans in order, and, where it has any, all words outside them with their places."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("key", F.xxhash64("text"))
    rows = rows.withColumn("base", F.array_sort(F.concat(*(base_spans(F.col("text"), k) for k in KINDS[:4]))))
    found = F.transform(placed(F.col("text"), _TERM), lambda w: F.struct(F.lower(w["m"]).alias("t"), w["s"].alias("s"), (w["s"] + F.length(w["m"])).cast("int").alias("e")))
    none = F.expr("CAST(array() AS array<struct<t: string, s: int, e: int>>)")
    # A word inside another span is no term.
    outside = F.filter(found, lambda w: ~F.exists("base", lambda b: (b["s"] < w["e"]) & (w["s"] < b["e"])))
    return rows.withColumn("words", F.when(F.size("base") > 0, outside).otherwise(none))


def disclosing(base: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, terms): the terms of each text that disclose one of its entities above the threshold; counts are of documents and cover all of them."""
    total = float(max(docs.count(), 2))
    own = base.filter(F.size("base") > 0).select("key", F.array_distinct(F.transform("base", lambda b: F.lower(b["v"]))).alias("entities"), F.array_distinct(F.transform("words", lambda w: w["t"])).alias("terms"))
    # Entities and terms follow from the text, so copies are one row with their number.
    texts = cut(own.groupBy("key").agg(F.first("entities").alias("entities"), F.first("terms").alias("terms"), F.count(F.lit(1)).alias("n")))
    told = texts.select("key", "n", F.explode("entities").alias("entity"))
    entities = cut(told.groupBy("entity").agg(F.sum("n").alias("n_entity")).filter(F.col("n_entity") >= SUPPORT))
    told = cut(told.join(entities, "entity"))
    # Both stand together in no more documents than the entity stands in, so a term in more than that leaves too little to disclose.
    most = lambda n: F.pow(n.cast("double"), F.lit(DISCLOSURE)) * total ** (1 - DISCLOSURE) * (1 + 1e-9)
    met = texts.join(told.select("key").distinct(), "key", "left_semi").select("key", "n", F.explode("terms").alias("term"))
    terms = cut(met.groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= SUPPORT).select("term"))
    words = docs.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(_TERM), F.lit(0)), lambda w: F.lower(w)))).alias("term"))
    if (terms.agg(F.sum(F.octet_length("term") + 64).alias("n")).first()["n"] or 0) <= BROADCAST_BYTES:
        n_terms = words.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    else:
        n_terms = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).join(terms, "term", "left_semi")
    largest = entities.agg(F.max("n_entity").alias("n")).first()["n"] or 0
    n_terms = cut(n_terms.filter(F.col("n_term") <= most(F.lit(largest))))
    pairs = cut(met.drop("n").join(n_terms, "term")).join(told, "key").filter(F.col("n_term") <= most(F.col("n_entity")))
    both = pairs.groupBy("entity", "term").agg(F.sum("n").alias("both"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term")).filter(F.col("both") >= SUPPORT)
    info = F.log(F.lit(total) / F.col("n_entity"))
    share = F.log(F.col("both") * F.lit(total) / (F.col("n_entity") * F.col("n_term"))) / F.greatest(info, F.lit(1e-9))
    good = cut(both.filter(F.least(share, F.lit(1.0)) >= DISCLOSURE).select("entity", "term"))
    return cut(pairs.join(good, ["entity", "term"], "left_semi").groupBy("key").agg(F.collect_set("term").alias("terms")))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, base, spans) for each row of ``docs``: its base spans, and these with its disclosing terms, in order."""
    base = find_base(docs, id_col, text_col)
    terms = disclosing(base, docs, text_col).withColumnRenamed("key", "_key")
    out = base.join(terms, base["key"] == terms["_key"], "left")
    plain = F.transform("base", lambda b: F.struct(b["s"].alias("s"), b["k"].alias("k"), b["e"].alias("e")))
    added = F.transform(F.filter("words", lambda w: F.array_contains("terms", w["t"])), lambda w: F.struct(w["s"].alias("s"), F.lit(4).alias("k"), w["e"].alias("e")))
    return out.select("id", "text", "base", F.array_sort(F.when(F.col("terms").isNull(), plain).otherwise(F.concat(plain, added))).alias("spans"))


def _count(k: int) -> Column:
    return F.size(F.filter("base", lambda b: b["k"] == k)).cast("long")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, counts by base kind, digest of the base spans, all spans.

    Offsets are code points, ends exclusive. Null texts count as empty; null ids
    and repeated rows give a row each (rows with equal id and text count twice
    in the corpus); an empty table gives none. Texts of any length are read whole.
    """
    out = find_spans(docs, id_col, text_col)
    counts = [_count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    return out.select(F.col("id").alias(id_col), *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def generalized(text: Column, spans: Column) -> Column:
    """The whole text with each span replaced by its kind in brackets; spans that overlap are one, of the first's kind."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def step(acc: Column, x: Column) -> Column:
        apart = x["s"] >= acc["at"]
        piece = F.concat(F.substr(text, acc["at"] + 1, x["s"] - acc["at"]), F.element_at(names, x["k"] + 1))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(apart, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<string>)").alias("out"))
    done = let(F.aggregate(spans, start, step), lambda r: F.concat(F.array_join(r["out"], ""), F.substr(text, r["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def sanitize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) for each row of ``docs``: its whole text with base spans and disclosing terms generalised; null texts are empty."""
    out = find_spans(docs, id_col, text_col)
    return out.select(F.col("id").alias(id_col), generalized(F.col("text"), F.col("spans")).alias(text_col))

"""Inverted index and search (survey X1-X10, F5-F10, U2, T3-T7)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import latex, sets

# Weights of fields, scores of kinds of search.
WEIGHTS = {"statement": 3.0, "description": 2.0, "assumptions": 1.5, "type": 1.0}
SYMBOL_WEIGHT = 2.0
SCORES = {"symbol": 0.9, "type": 0.95, "status": 0.8, "transformation": 0.7}


def text_postings(rows: DataFrame, fields: dict[str, str], id_col: str = "id") -> DataFrame:
    """(token, id, field, weight): one for each distinct token of a field; ``fields`` maps field to column."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(WEIGHTS[f]).alias("weight"), latex.search_tokens(F.coalesce(F.col(c), F.lit(""))).alias("tokens")) for f, c in fields.items()))
    found = rows.select(F.col(id_col).alias("id"), F.explode(each).alias("f"))
    return found.select(F.explode("f.tokens").alias("token"), "id", "f.field", "f.weight")


def symbol_postings(rows: DataFrame, symbols: str, statement: str, id_col: str = "id") -> DataFrame:
    found = F.array_distinct(F.transform(F.array_union(symbols, latex.latex_symbols(F.col(statement))), latex.canonical_symbol))
    return rows.select(F.explode(found).alias("token"), F.col(id_col).alias("id"), F.lit("symbol").alias("field"), F.lit(SYMBOL_WEIGHT).alias("weight"))


def metadata_postings(rows: DataFrame, values: dict[str, Column], id_col: str = "id") -> DataFrame:
    """(key, value, id) for each metadata value; arrays give one for each element."""
    each = F.concat(*(_tagged(k, v) for k, v in values.items()))
    return rows.select(F.explode(each).alias("m"), F.col(id_col).alias("id")).select("m.*", "id")


def _tagged(key: str, values: Column) -> Column:
    return F.transform(values, lambda x: F.struct(F.lit(key).alias("key"), x.cast("string").alias("value")))


def text_search(postings: DataFrame, total: int, query: str, n: int | None = None, reasons: int = 3) -> DataFrame:
    """(id, score, fields, reasons) by the sum of rarity times weight over the query's tokens, at most 1; the first ``n`` by score and id, if given.

    Rarity is rows over postings of the token. Only the query's postings are
    read: the filter on tokens reaches the scan. ``reasons`` are the first
    matches, by the tokens' order in the query and the field's name.
    """
    spark = postings.sparkSession
    tokens = [r[0] for r in spark.range(1).select(F.explode(latex.search_tokens(F.lit(query)))).collect()]
    if not tokens:
        return postings.limit(0).select("id", F.lit(0.0).alias("score"), F.array("field").alias("fields"), F.array("field").alias("reasons"))
    mine = postings.filter(F.col("token").isin(*tokens))
    rarity = F.broadcast(mine.groupBy("token").agg((F.lit(float(total)) / F.count(F.lit(1))).alias("idf")))  # one row a query token
    place = F.array_position(F.array(*map(F.lit, tokens)), F.col("token"))
    told = F.struct(place.alias("p"), "field", F.concat(F.lit("Matched '"), "token", F.lit("' in "), "field").alias("r"))
    hits = mine.join(rarity, "token").groupBy("id").agg(F.least(F.sum(F.col("idf") * F.col("weight")) / len(tokens), F.lit(1.0)).alias("score"), F.array_sort(F.collect_set("field")).alias("fields"), F.array_sort(F.collect_list(told)).alias("t"))
    out = hits.select("id", "score", "fields", F.transform(F.slice("t", 1, reasons), lambda x: x["r"]).alias("reasons"))
    return out if n is None else top(out, n, F.desc(F.round("score", 9)), "id")


def build_index(postings: DataFrame, path: str, buckets: int = 256) -> None:
    """Writes postings by a hash of their token, so a search reads the folders of its tokens only."""
    postings.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")).repartition("bucket").sortWithinPartitions("token").write.mode("overwrite").partitionBy("bucket").parquet(path)


def search_index(spark: SparkSession, path: str, total: int, query: str, n: int | None = None, buckets: int = 256) -> DataFrame:
    """``text_search`` over a written index: folders are pruned by the tokens' hashes."""
    tokens = [r[0] for r in spark.range(1).select(F.explode(F.transform(latex.search_tokens(F.lit(query)), lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int")))).collect()]
    return text_search(spark.read.parquet(path).filter(F.col("bucket").isin(*tokens or [-1])).drop("bucket"), total, query, n)


#: Suggestions of a search.
SUGGESTIONS = {
    "fuzzy": "Try enabling **Fuzzy Search** for approximate matching", "symbol": "Try enabling **Symbol Search** - your query contains mathematical symbols", "filters": "Try removing some **filters** to broaden your search",
    "fewer": "Try using **fewer keywords** for broader results", "more": "Try adding **more descriptive terms** to your query",
}


def suggestions(query: Column, kinds: Column, filtered: Column, most: int = 3) -> Column:
    """The first suggestions for a search of ``query`` with ``kinds`` of search; ``filtered`` tells whether it had filters."""
    words = F.size(F.filter(F.split(F.trim(query), r"\s+"), lambda w: w != ""))
    told = {"fuzzy": ~F.array_contains(kinds, "fuzzy"), "symbol": ~F.array_contains(kinds, "symbol") & query.rlike("[∀∃∈∑∏∫]"), "filters": filtered, "fewer": words > 3, "more": words == 1}
    return F.slice(F.array_compact(F.array(*(F.when(c, F.lit(SUGGESTIONS[k])) for k, c in told.items()))), 1, most)


#: What results are ordered by.
ORDERS = {"relevance": "score", "confidence": "confidence", "type": "theorem_type", "validation": "pass_rate"}


def ordered_by(results: DataFrame, by: str = "relevance", descending: bool = True, id_col: str = "id") -> DataFrame:
    """Results in the order of one of ``ORDERS``, relevance for unknown ones; ties by id."""
    c = F.col(ORDERS.get(by, "score"))
    return results.orderBy(c.desc() if descending else c.asc(), id_col)


def by_value(rows: DataFrame, column: str, *values: object) -> DataFrame:
    """Rows whose ``column`` is one of ``values``: look-up by id or type; the filter reaches the scan."""
    return rows.filter(F.col(column).isin(*values))


def with_relevance(rows: DataFrame, results: DataFrame, id_col: str = "id") -> DataFrame:
    """``rows`` with the ``relevance`` of their search result, null for those that weren't found."""
    return rows.join(results.select(F.col("id").alias("__id"), F.col("score").alias("relevance")), F.col(id_col) == F.col("__id"), "left").drop("__id")


def first_of_each(rows: DataFrame, by: str, k: int, *order: Column | str) -> DataFrame:
    """The first ``k`` rows of each value of ``by`` in a total order."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")


def fuzzy_search(rows: DataFrame, query: str, columns: list[str], threshold: float = 0.7, id_col: str = "id") -> DataFrame:
    """(id, score) by Jaccard of word sets, the best column, from ``threshold`` on."""
    words = F.array_distinct(F.array(*(F.lit(w) for w in query.lower().split())))

    def of(c: str) -> Column:
        return sets.jaccard(words, F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"\s+"), lambda w: w != "")))

    score = of(columns[0]) if len(columns) == 1 else F.greatest(*(of(c) for c in columns))
    return rows.select(F.col(id_col).alias("id"), score.alias("score")).filter(F.col("score") >= threshold)


def merge_results(*results: DataFrame, reasons: int = 5) -> DataFrame:
    """(id, score, kinds) from results (id, score, kind): the best score, the distinct kinds, in order."""
    both = results[0]
    for r in results[1:]:
        both = both.unionByName(r)
    return both.groupBy("id").agg(F.max("score").alias("score"), F.slice(F.array_sort(F.collect_set("kind")), 1, reasons).alias("kinds"))


def top(results: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows of a total order."""
    return results.orderBy(*order).limit(n)


@dataclass(frozen=True)
class Filters:
    """Conditions of a search; those that are None aren't asked for."""

    types: list[str] | None = None
    statuses: list[str] | None = None
    confidence: tuple[float, float] | None = None
    least: float | None = None
    most: float | None = None
    symbols: list[str] | None = None
    methods: list[str] | None = None

    def columns(self, kind="theorem_type", status="status", confidence="confidence", symbols="symbols", methods="chain") -> list[Column]:
        any_of = lambda c, own: F.arrays_overlap(c, F.array(*(F.lit(x) for x in own)))
        found = [
            F.col(kind).isin(*self.types) if self.types else None, F.col(status).isin(*self.statuses) if self.statuses else None, F.col(confidence).between(*self.confidence) if self.confidence else None,
            F.col(confidence) >= self.least if self.least else None, F.col(confidence) <= self.most if self.most else None, any_of(symbols, self.symbols) if self.symbols else None,
            any_of(methods, self.methods) if self.methods else None,
        ]
        return [c for c in found if c is not None]


def apply_filters(rows: DataFrame, filters: Filters, mode: str = "and", **names: str) -> DataFrame:
    """Rows that meet all conditions, or any; without conditions all rows."""
    found = filters.columns(**names)
    if not found:
        return rows
    both = found[0]
    for c in found[1:]:
        both = both & c if mode == "and" else both | c
    return rows.filter(both)


def page(rows: DataFrame, number: int, size: int, *order: Column | str) -> tuple[DataFrame, dict]:
    """One page of a total order, its number clamped to the pages there are, and where it stands."""
    total = rows.count()
    pages = max(1, -(-total // size))
    number = min(max(1, number), pages)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size), {"page": number, "pages": pages, "total": total, "first": (number - 1) * size + 1 if total else 0, "last": min(number * size, total)}


def upsert(index: DataFrame, new: DataFrame, id_col: str = "id") -> DataFrame:
    """``index`` with all postings of the ids in ``new`` replaced."""
    return index.join(new.select(id_col).distinct(), id_col, "left_anti").unionByName(new)


def sample(rows: DataFrame, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """``n`` rows, the same for the same seed."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))), id_col).limit(n)


def best_of(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__r = 1").drop("__r")

"""Queries on extraction and on LaTeX text, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import latex as L
from ..operators import extract
from . import corpus
from .registry import cte, n_of, query, rep, sub, table, text

D, FO = corpus.DOCUMENTS_SQL, corpus.FORMULAS_SQL
STRIP = (r"^\s+|\s+$", "")


def _all(patterns, kind: str, source: str = "text", sql_patterns=None) -> str:
    return " UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS kind, {i} AS pattern, generate_subscripts(m, 1) - 1 AS n, unnest(m) AS raw FROM (SELECT doc_id, regexp_extract_all({source}, {text('(?s)' + p)}, 1) AS m FROM documents_)"
        for i, p in enumerate(patterns)
    )


# RE2 has no lookaround: display mathematics and runs of dollars go first.
INLINE_SOURCE = sub("text", (r"\$\$[^$]*\$\$", " "), (r"\$\$+", " "))
INLINE_SQL = " UNION ALL ".join(
    f"SELECT doc_id, 'inline' AS kind, {i} AS pattern, generate_subscripts(m, 1) - 1 AS n, unnest(m) AS raw FROM (SELECT doc_id, regexp_extract_all({src}, {text('(?s)' + p)}, 1) AS m FROM documents_)"
    for i, (src, p) in enumerate(((INLINE_SOURCE, r"\$([^$\n]+)\$"), ("text", L.INLINE[1])))
)
FOUND = f"found AS ({INLINE_SQL} UNION ALL {_all(L.DISPLAY, 'block')})"


def confidence_sql(c: str, display: str | None = None) -> str:
    inner = sub(c, STRIP)
    base = f"(0.3::DOUBLE + least({n_of(c, L.INDICATOR)} * 0.1::DOUBLE, 0.4) + least({n_of(c, L.COMMAND)} * 0.05::DOUBLE, 0.2) + least({n_of(c, L.OPERATOR)} * 0.02::DOUBLE, 0.1))"
    base += f" * CASE WHEN length({inner}) < 5 THEN 0.8::DOUBLE ELSE 1 END * CASE WHEN regexp_matches({c}, '^[\\d\\s]+$') OR regexp_matches({c}, '^[a-zA-Z\\s]+$') THEN 0.5::DOUBLE ELSE 1 END"
    score = f"CASE WHEN {c} IS NULL OR length({inner}) < 3 THEN 0::DOUBLE ELSE least({base}, 1) END"
    return score if display is None else f"CASE WHEN {display} THEN least({score} + 0.2::DOUBLE, 1) ELSE {score} END"


def preclean_sql(c: str) -> str:
    return sub(c, STRIP, (r"\s+", " "), (r"%.*$", ""), (r"\\text(?:bf|it|rm|sf|tt)\{([^}]*)\}", r"\1"), (r"\\(?:bf|it|rm|sf|tt)\s+", ""), (r"\\label\{[^}]*\}", ""), (r"\\tag\{[^}]*\}", ""), STRIP)


GOOD = f"""scored AS (SELECT doc_id, kind, pattern, n, {preclean_sql("raw")} AS expression, {confidence_sql("raw", "kind = 'block'")} AS confidence FROM found),
 good AS (SELECT *, row_number() OVER (PARTITION BY doc_id, expression ORDER BY confidence DESC, kind DESC, pattern, n) AS r FROM scored
 WHERE length(expression) BETWEEN 3 AND 1000 AND confidence >= 0.1 AND NOT regexp_matches({sub("expression", STRIP)}, '^\\d+$') AND NOT regexp_matches({sub("expression", STRIP)}, '^[a-zA-Z]$'))"""


@query("extract_display", cte(D) + _all(L.DISPLAY, "block"))
def extract_display(spark, d):
    return extract.expressions(corpus.documents(spark, d), inline=False)


@query("extract_inline", cte(D) + INLINE_SQL)
def extract_inline(spark, d):
    return extract.expressions(corpus.documents(spark, d), display=False)


@query("extract_env", cte(D) + " UNION ALL ".join(f"SELECT doc_id, '{e}' AS environment, unnest(regexp_extract_all(text, {text(rf'(?s)\\begin\{{{e}\*?\}}(.*?)\\end\{{{e}\*?\}}')}, 1)) AS raw FROM documents_" for e in L.ENVIRONMENTS))
def extract_env(spark, d):
    found = F.map_from_arrays(F.array(*(F.lit(e) for e in L.ENVIRONMENTS)), F.array(*(L.environment(F.col("text"), e) for e in L.ENVIRONMENTS)))
    return corpus.documents(spark, d).select("doc_id", F.explode(found).alias("environment", "m")).select("doc_id", "environment", F.explode("m").alias("raw"))


@query("pattern_counts", cte(D) + "SELECT doc_id, " + ", ".join(f"{n_of('text', p)} AS {k}" for k, p in L.FAMILIES.items()) + " FROM documents_")
def pattern_counts(spark, d):
    return corpus.documents(spark, d).select("doc_id", *(L.count(F.col("text"), p).cast("long").alias(k) for k, p in L.FAMILIES.items()))


@query("pattern_positions", cte(D) + f"""SELECT doc_id, CAST(sum(length(gap) + length(raw)) OVER (PARTITION BY doc_id ORDER BY i) - length(raw) AS BIGINT) AS start, raw FROM (
 SELECT doc_id, generate_subscripts(m, 1) AS i, unnest(m) AS raw, unnest(list_slice(g, 1, len(m))) AS gap FROM (SELECT doc_id, regexp_extract_all(text, {text(L.COMMAND)}) AS m, regexp_split_to_array(text, {text(L.COMMAND)}) AS g FROM documents_))""")
def pattern_positions(spark, d):
    return extract.with_positions(corpus.documents(spark, d), L.COMMAND).select("doc_id", F.col("start").cast("long").alias("start"), "raw")


@query("confidence_score", cte(FO) + f"SELECT id, round({confidence_sql('formula')}, 6) AS inline_score, round({confidence_sql('formula', 'TRUE')}, 6) AS display_score FROM formulas")
def confidence_score(spark, d):
    f = F.col("formula")
    return corpus.formulas(spark, d).select("id", F.round(L.confidence(f), 6).alias("inline_score"), F.round(L.confidence(f, F.lit(True)), 6).alias("display_score"))


@query("filter_dedup", cte(D, FOUND, GOOD) + "SELECT doc_id, expression, kind, round(confidence, 6) AS confidence FROM good WHERE r = 1")
def filter_dedup(spark, d):
    return extract.extract_formulas(corpus.documents(spark, d)).withColumn("confidence", F.round("confidence", 6))


ENV_SUMS = ", ".join(f"sum(len(regexp_extract_all(text, {text(rf'(?s)\\begin\{{{e}\*?\}}(.*?)\\end\{{{e}\*?\}}')}, 1))) AS n_{e}" for e in L.ENVIRONMENTS)


@query("math_statistics", cte(D, FOUND, GOOD) + f"""SELECT a.bucket, n_equation::BIGINT AS n_equation, n_align::BIGINT AS n_align, n_gather::BIGINT AS n_gather, n_multline::BIGINT AS n_multline, coalesce(total, 0) AS total, coalesce(n_inline, 0) AS n_inline,
 coalesce(n_block, 0) AS n_block, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low FROM (SELECT doc_id % 10 AS bucket, {ENV_SUMS} FROM documents_ GROUP BY 1) a LEFT JOIN (SELECT doc_id % 10 AS bucket, count(*) AS total,
 count(*) FILTER (kind = 'inline') AS n_inline, count(*) FILTER (kind = 'block') AS n_block, count(*) FILTER (confidence > 0.8) AS high, count(*) FILTER (confidence BETWEEN 0.5 AND 0.8) AS medium, count(*) FILTER (confidence < 0.5) AS low
 FROM good WHERE r = 1 GROUP BY 1) b ON a.bucket = b.bucket""")
def math_statistics(spark, d):
    return extract.math_statistics(corpus.documents(spark, d).withColumn("bucket", F.col("doc_id") % 10), "bucket")


SIGNS = sorted(set(L.SYMBOLS.values()))
UNICODE = " + ".join(f"(length(formula) - length(replace(formula, {text(s)}, ''))) // {len(s)}" for s in SIGNS)


@query("symbol_statistics", cte(FO) + f"""SELECT count(*) AS total, sum({n_of("formula", L.COMMAND)})::BIGINT AS commands, sum({UNICODE})::BIGINT AS unicode_symbols, sum({n_of("formula", L.FRACTION)})::BIGINT AS fractions,
 sum({n_of("formula", L.SCRIPT["superscripts"])})::BIGINT AS superscripts, sum({n_of("formula", L.SCRIPT["subscripts"])})::BIGINT AS subscripts, sum({n_of("formula", L.FUNCTION)})::BIGINT AS functions FROM formulas""")
def symbol_statistics(spark, d):
    return extract.symbol_statistics(corpus.formulas(spark, d))


@query("ingest_report", """SELECT lang, source, count(*) AS files, count(*) FILTER (n_chars >= 100) AS succeeded, count(*) FILTER (n_chars < 100) AS failed, sum(len(list_filter(string_split(text, chr(10)), lambda x: length(x) >= 10)))::BIGINT AS blocks,
 sum(len(regexp_extract_all(text, '[0-9]+')))::BIGINT AS formulas FROM documents GROUP BY lang, source""")
def ingest_report(spark, d):
    t = table(spark, d, "documents")
    blocks = F.size(F.filter(F.split("text", "\n"), lambda x: F.length(x) >= 10))
    results = t.select("lang", "source", blocks.alias("n_blocks"), L.count(F.col("text"), "[0-9]+").alias("n_formulas"), F.when(F.col("n_chars") < 100, "too short").alias("error"))
    return extract.ingestion_report(results, ["lang", "source"])


MAP = "MAP {" + ", ".join(f"{text(chr(92) + k)}: {text(v)}" for k, v in L.SYMBOLS.items()) + "}"


def unicode_sql(c: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({c}, {text(r'(?s)\\[a-zA-Z]+|[^\\]+|\\')}), lambda t: coalesce({MAP}[t], t)), '')"


def clean_sql(c: str, unicode: bool = True) -> str:
    c = sub(c, STRIP, (r"\s+", " "))
    if unicode:
        c = unicode_sql(c)
    part = r"\s*([^{}\\\s][^{}\\]{0,1}[^{}\\\s]|[^{}\\\s]{1,2})\s*"
    c = sub(c, (rf"\\[dt]?frac\{{{part}\}}\{{{part}\}}", r"(\1)/(\2)"), (r"\\[dt]?frac\{\s*([^{}]+?)\s*\}\{\s*([^{}]+?)\s*\}", r"frac(\1, \2)"))
    c = rep(c, *((rf"\{s}{b}", t) for s, b, t in (("left", "(", "("), ("right", ")", ")"), ("left", "[", "["), ("right", "]", "]"), ("left", r"\{", "{"), ("right", r"\}", "}"), ("left", "|", "|"), ("right", "|", "|"), ("left", r"\langle", "⟨"), ("right", r"\rangle", "⟩"))))
    c = sub(c, (r"\^\{([^}])\}", r"^\1"), (r"\^\{([^}]{2,})\}", r"^(\1)"), (r"\^\{\}", "^"), (r"_\{([^}])\}", r"_\1"), (r"_\{([^}]{2,})\}", r"_(\1)"), (r"_\{\}", "_"))
    stray = (r"\\([^a-zA-Z]|$)", r"\1")
    return sub(c, (r"\{\}", ""), (r"\\(?:[,;!]|qquad|quad)", " "), stray, stray, stray, (r"\s*([+\-*/=<>≤≥≠±])\s*", r" \1 "), (r"\s+", " "), STRIP)


@query("clean_unicode", cte(FO) + f"SELECT id, {clean_sql('formula')} AS cleaned FROM formulas")
def clean_unicode(spark, d):
    return corpus.formulas(spark, d).select("id", L.batch_clean(F.col("formula")).alias("cleaned"))


INFIX_SQL = sub(clean_sql("formula", False), (r"\\frac\{([^{}]+)\}\{([^{}]+)\}", r"(\1)/(\2)"), (r"\\sqrt\{([^{}]+)\}", r"sqrt(\1)"), *((rf"\\{k}([^a-zA-Z0-9_]|$)", rf"{v}\1") for k, v in L.INFIX_NAMES.items()), (r"\\[a-zA-Z]+", ""), (r"[{}]", ""), STRIP)


@query("clean_infix", cte(FO) + f"SELECT id, {INFIX_SQL} AS infix FROM formulas")
def clean_infix(spark, d):
    return corpus.formulas(spark, d).select("id", L.to_infix(F.col("formula")).alias("infix"))


COMMANDS = "[" + ", ".join(text("\\" + k) for k in L.SYMBOLS) + "]"
ANY_SIGN = "|".join(sorted({v if v.isalpha() else f"[{v}]" for v in L.SYMBOLS.values()}))


@query("notation_lint", cte(FO) + f"""SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(formula, {text(L.COMMAND)}), lambda x: NOT list_contains({COMMANDS}, x)))), ',') AS unknown,
 regexp_matches(formula, {text(L.COMMAND)}) AND regexp_matches(formula, {text(ANY_SIGN)}) AS mixed, regexp_matches(formula, {text(r"\\[a-zA-Z]*[^a-zA-Z\\]")}) AS malformed FROM formulas""")
def notation_lint(spark, d):
    f = F.col("formula")
    return corpus.formulas(spark, d).select("id", F.array_join(L.unknown_commands(f), ",").alias("unknown"), L.is_mixed(f).alias("mixed"), L.is_malformed(f).alias("malformed"))


@query("latex_comments", cte(D) + f"SELECT doc_id, {sub('text', ('%[^' + chr(92) + 'n]*' + chr(92) + 'n', ''))} AS source FROM documents_")
def latex_comments(spark, d):
    return corpus.documents(spark, d).select("doc_id", L.strip_comments(F.col("text")).alias("source"))


BLOCKS_SQL = sub(sub(sub(sub("text", ("%[^\\n]*\\n", "")), *(("(?s)" + p, "") for p in L.DISPLAY)), (r"\$([^$\n]+)\$", ""), ("(?s)" + L.INLINE[1], "")), (r"\\[a-zA-Z]+\{[^}]*\}", ""), (L.COMMAND, ""), (r"[{}]", ""))


@query("latex_blocks", cte(D) + f"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split({BLOCKS_SQL}, chr(10) || chr(10)), lambda x: {sub("x", STRIP)}), lambda x: length(x) >= 10), '|') AS blocks FROM documents_""")
def latex_blocks(spark, d):
    return corpus.documents(spark, d).select("doc_id", F.array_join(L.text_blocks(L.strip_comments(F.col("text"))), "|").alias("blocks"))


NAMES = "MAP {'cdot': '*', 'times': '*', 'div': '/', 'frac': '', 'ln': 'log', 'e': 'E'}"


@query("validator_preclean", cte(FO) + f"SELECT id, array_to_string(list_transform(regexp_extract_all(replace(formula, '\\', ''), '(?s)[a-zA-Z]+|[^a-zA-Z]+'), lambda t: coalesce({NAMES}[t], t)), '') AS cleaned FROM formulas")
def validator_preclean(spark, d):
    return corpus.formulas(spark, d).select("id", L.validator_clean(F.col("formula")).alias("cleaned"))


@query("display_projections", cte(FO, corpus.THEOREMS_SQL) + f"""SELECT t.id, trim({rep("formula", *L.DISPLAY_SIGNS)}) AS shown, CASE WHEN length(formula || repeat('z', t.id::INT % 120)) > 100 THEN substring(formula || repeat('z', t.id::INT % 120), 1, 97) || '...' ELSE formula || repeat('z', t.id::INT % 120) END AS short,
 replace(concat('THM_', upper(substring(md5(formula), 1, 8))), 'THM_', '') AS short_id, array_to_string(list_transform(string_split(theorem_type, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS type_display, md5(concat(statement, ':', formula)) AS cache_key,
 CASE WHEN len(list_distinct(symbols)) <= 3 THEN array_to_string(list_sort(list_distinct(symbols)), ', ') ELSE array_to_string(list_sort(list_distinct(symbols))[1:3], ', ') || ', ... (' || len(list_distinct(symbols)) || ' total)' END AS symbol_summary
 FROM formulas f JOIN theorems t ON f.id = t.id""")
def display_projections(spark, d):
    both = corpus.formulas(spark, d).join(corpus.theorems(spark, d), "id")
    f, long = F.col("formula"), F.expr("concat(formula, repeat('z', cast(id % 120 AS int)))")
    return both.select(
        "id", L.display_statement(f).alias("shown"), L.truncated(long).alias("short"), F.replace(F.concat(F.lit("THM_"), F.upper(F.left(F.md5(f), F.lit(8)))), F.lit("THM_"), F.lit("")).alias("short_id"),
        F.initcap(F.replace("theorem_type", F.lit("_"), F.lit(" "))).alias("type_display"), L.content_hash(F.col("statement"), f).alias("cache_key"), symbol_summary(F.col("symbols")).alias("symbol_summary"),
    )


def symbol_summary(symbols):
    own = F.array_sort(F.array_distinct(symbols))
    more = F.concat(F.array_join(F.slice(own, 1, 3), ", "), F.lit(", ... ("), F.size(own).cast("string"), F.lit(" total)"))
    return F.when(F.size(own) <= 3, F.array_join(own, ", ")).otherwise(more)


WORDS = "MAP {" + ", ".join(f"{text(k)}: {text(v)}" for k, v in L.WORDS.items()) + "}"


@query("formula_words", cte(corpus.THEOREMS_SQL) + f"SELECT id, array_to_string(list_transform(regexp_extract_all(statement, {text(r'\*\*|[a-zA-Z]+|[0-9.]+|\S')}), lambda t: coalesce({WORDS}[t], t)), ' ') AS words FROM theorems")
def formula_words(spark, d):
    return corpus.theorems(spark, d).select("id", L.formula_words(F.col("statement")).alias("words"))


@query("infix_to_latex", cte(corpus.THEOREMS_SQL) + f"""SELECT id, {sub(rep("statement", *L.LATEX_SIGNS), ("([0-9A-Za-z_]+)/([0-9A-Za-z_]+)", r"\\frac{\1}{\2}"), ("([0-9A-Za-z_])_([0-9A-Za-z_])", r"\1_{\2}"))} AS latex,
 {" OR ".join(f"contains(lower(statement), {text(m)})" for m in L.LATEX_MARKS)} AS compatible FROM theorems""")
def infix_to_latex(spark, d):
    s = F.col("statement")
    return corpus.theorems(spark, d).select("id", L.infix_to_latex(s).alias("latex"), L.is_latex_compatible(s).alias("compatible"))


@query("identifiers", cte(corpus.THEOREMS_SQL) + """SELECT id, CASE WHEN regexp_matches(c, '^[^a-zA-Z]') THEN 'theorem_' || c WHEN c = '' THEN 'unnamed_theorem' ELSE c END AS name FROM (SELECT id, regexp_replace(CASE WHEN id % 17 = 0 THEN '' ELSE statement END, '[^a-zA-Z0-9_]', '_', 'g') AS c FROM theorems)""")
def identifiers(spark, d):
    return corpus.theorems(spark, d).select("id", L.identifier(F.when(F.col("id") % 17 == 0, "").otherwise(F.col("statement"))).alias("name"))


@query("latex_symbols", cte(FO) + "SELECT id, array_to_string(list_sort(list_distinct(list_filter(" + " || ".join(f"regexp_extract_all(formula, {text(p)}, {g})" for p, g in [(r"\\([a-zA-Z]+)", 1), (r"\\([a-zA-Z]+)\{([^}]+)\}", 1), (r"\\([a-zA-Z]+)\{([^}]+)\}", 2), (r"([a-zA-Z])_\{([^}]+)\}", 1), (r"([a-zA-Z])_\{([^}]+)\}", 2), (r"([a-zA-Z])\^\{([^}]+)\}", 1), (r"([a-zA-Z])\^\{([^}]+)\}", 2)]) + ", lambda s: s <> ''))), '|') AS symbols FROM formulas")
def latex_symbols(spark, d):
    return corpus.formulas(spark, d).select("id", F.array_join(L.latex_symbols(F.col("formula")), "|").alias("symbols"))


@query("flagship", cte(D, FOUND, GOOD) + f"""SELECT shape, kind, count(*) AS formulas, count(DISTINCT doc_id) AS docs, round(avg(confidence), 6) AS mean_confidence, min(cleaned) AS first_cleaned, sum(commands)::BIGINT AS commands
 FROM (SELECT doc_id, doc_id % 20 AS shape, kind, confidence, {clean_sql("expression")} AS cleaned, {n_of("expression", L.COMMAND)} AS commands FROM good WHERE r = 1) GROUP BY shape, kind""")
def flagship(spark, d):
    e = extract.extract_formulas(corpus.documents(spark, d))
    e = e.select("doc_id", (F.col("doc_id") % 20).alias("shape"), "kind", "confidence", L.clean(F.col("expression")).alias("cleaned"), L.count(F.col("expression"), L.COMMAND).alias("commands"))
    return e.groupBy("shape", "kind").agg(
        F.count(F.lit(1)).alias("formulas"), F.count_distinct("doc_id").alias("docs"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.min("cleaned").alias("first_cleaned"), F.sum("commands").alias("commands")
    )

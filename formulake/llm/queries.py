"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fim, html, licenses, linededup, packing, pii, quality, resampling, secrets, simhash, tokenfiles, tokens
from .common import checkpoint_dir, read, remove

#: Production parameters.
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
CAPACITY = 1024
END_ID = 2


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokens.vocabulary(TOKENIZER), CAPACITY, END_ID)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(read(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read(spark, sf_dir, "documents"), tokens.vocabulary(TOKENIZER), CAPACITY)


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), radius=2, words=3)
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=13)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(read(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read(spark, sf_dir, "documents"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read(spark, sf_dir, "documents"), tokens.vocabulary(RANKS))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), percent=10, grams=1, buckets=10_000, min_words=20, seed=2024)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(read(spark, sf_dir, "documents"), unit="line", rate=100, spm_rate=50, seed=7)
    restored = fim.restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
    tokenfiles.write_token_files(read(spark, sf_dir, "documents"), folder, tokens.vocabulary(TOKENIZER), END_ID)
    found = tokenfiles.read_token_files(spark, folder)  # follows from its own checkpoint
    remove(spark, folder)
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_best_fit_packing, op2_html_extraction, op3_token_counts, op4_license_scans, op5_quality_rules, op6_simhash_near_dedup,
        op7_benchmark_decontamination, op8_line_dedup, op9_pii, op10_secret_scans, op11_importance_resampling, op12_fill_in_middle, op13_token_files,
    ]
    return {f.__name__: f for f in found}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '{licenses.WORD}')"


def _licenses_sql() -> str:
    """Base phrases by comparing slices of the words at every place; templates as patterns of the joined words."""

    def stands(parts: list) -> str:
        pattern = "".join(f"( [^ ]+){{{{{x}}}}}" if isinstance(x, int) else f" {x}" for x in parts).replace("{{", "{").replace("}}", "}")
        return f"contains(joined, ' {parts[0]} ')" if len(parts) == 1 else f"regexp_matches(joined, '{pattern} ')"

    base = " || ".join(f"list_filter(range(1, len(w) + 1), lambda i: w[i:i + {len(p.split()) - 1}] = {p.split()})" for p in licenses.BASE)
    given = ", ".join(f"CASE WHEN {stands([p])} THEN '{label}' END" for p, label in licenses.BASE.items())
    more = ", ".join(f"CASE WHEN {stands(parts)} THEN '{label}' END" for label, parts in licenses.LICENSES.items())
    names = lambda own: f"list_sort(list_distinct(list_filter([{own}], lambda x: x IS NOT NULL)))"
    return f"""SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word, array_to_string(base, ',') AS base_labels, array_to_string(labels, ',') AS labels,
 1 - power(0.5::DOUBLE, len(labels)) AS score FROM (SELECT doc_id, w, {base} AS places, {names(given)} AS base, {names(f"{given}, {more}")} AS labels FROM (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS joined FROM (SELECT doc_id, {_WORDS} AS w FROM documents)))"""


def _decontamination_sql(window: int = 13) -> str:
    """Windows of documents and items joined by their words; hit words counted once."""
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
 iw AS (SELECT DISTINCT item_id, least({window}, len(w)) AS n, array_to_string(w[k:k + least({window}, len(w)) - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - least({window}, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
 dw AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS t FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
 hits AS (SELECT r, k, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.t = iw.t),
 words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hits) GROUP BY r),
 items AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS own FROM hits GROUP BY r)
 SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(own), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(own, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
 FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""


_BYTES = "list_transform(range(0, len({0}), 2), lambda k: ('0x' || substr({0}, k + 1, 2))::BIGINT)"


def _resampling_sql() -> str:
    """CRC-32 of the distinct words, byte by byte over its table of 256; the rest by joins and a sort."""
    table = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    step = "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), dw AS (SELECT r, unnest(w) AS x FROM d), bw AS (SELECT unnest({_WORDS}) AS x FROM benchmark),
 own AS (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM dw UNION SELECT x FROM bw)),
 hashed AS (SELECT x, xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES.format("h")}), {step}), 4294967295) % 10000 AS bucket FROM own, (SELECT {table} AS t)),
 s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (x) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM bw JOIN hashed USING (x) GROUP BY bucket), total AS (SELECT (SELECT count(*) FROM dw) AS s_all, (SELECT count(*) FROM bw) AS t_all),
 gains AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1.0)::DOUBLE * (s_all + 10000)::DOUBLE / ((s.n + 1.0)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), total),
 weights AS (SELECT r, sum(gain)::BIGINT AS weight FROM dw JOIN hashed USING (x) JOIN gains USING (bucket) GROUP BY r),
 scored AS (SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN weights USING (r)),
 ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
 SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)"""


def _fill_in_middle_sql() -> str:
    """Lines by pattern; the parts by slices of the list of lines; texts restored from the output's parts."""
    h = [f"('0x' || substr(h, {1 + 8 * k}, 8))::BIGINT" for k in range(4)]
    return f"""WITH own AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
 cuts AS (SELECT doc_id, x, u, len(u) AS n, {h[0]} % (len(u) + 1) AS a, {h[1]} % (len(u) + 1) AS b, CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') THEN 'plain' WHEN {h[3]} % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM own),
 parts AS (SELECT *, coalesce(array_to_string(u[1:least(a, b)], ''), '') AS p, coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') AS m, coalesce(array_to_string(u[greatest(a, b) + 1:], ''), '') AS s FROM cuts),
 made AS (SELECT *, CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM parts)
 SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars, sha256(output) AS output_sha256,
 sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN substr(split_part(output, '<S>', 1), 4) || split_part(output, '<M>', 2) || split_part(split_part(output, '<S>', 2), '<M>', 1) ELSE split_part(split_part(output, '<P>', 2), '<M>', 1) || split_part(output, '<M>', 2) || substr(split_part(output, '<P>', 1), 4) END) AS restored_sha256 FROM made"""


def oracle_sql() -> dict[str, str]:
    """The others have no SQL form: tokenizers, HTML, XXH64, possessive patterns. Tests hold them against brute force."""
    return {"op4_license_scans": _licenses_sql(), "op7_benchmark_decontamination": _decontamination_sql(), "op11_importance_resampling": _resampling_sql(), "op12_fill_in_middle": _fill_in_middle_sql()}

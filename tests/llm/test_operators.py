"""Every operator against a plain version, on real rows and on edge cases."""

import math
import random
import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from formulake.llm import decontam, html, licenses, linededup, neardup, packing, pii, quality, queries, secrets, simhash, tokens

from . import brute


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    own = pd.DataFrame({"doc_id": range(10**6, 10**6 + len(brute.EDGE)), "text": brute.EDGE, "lang": "en", "source": "edge"})
    own["n_chars"] = own.text.fillna("").str.len()
    both = pd.concat([real, own], ignore_index=True)
    return both


@pytest.fixture(scope="module")
def table(spark, docs):
    rows = [(int(a), b, c, d, int(e)) for a, b, c, d, e in docs[["doc_id", "text", "lang", "source", "n_chars"]].itertuples(index=False)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    # extra columns with clashing names
    return spark.createDataFrame(rows, schema).selectExpr("*", "1 AS key", "'x' AS part", "2 AS n", "3 AS score", "4 AS matches", "5 AS __id").repartition(5).cache()


def by_id(df, columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def library(texts):
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(tokens.vocabulary()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_counts(table, docs):
    got = by_id(tokens.count_tokens(table, tokens.vocabulary(), 1024), ["n_bytes", "n_tokens", "over_limit"])
    for key, text, ids in zip(docs.doc_id, docs.text, library(docs.text), strict=True):
        assert got[key] == (len((text or "").encode()), len(ids), len(ids) > 1024), repr(text)[:80]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(table, docs, name):
    few = table.filter("doc_id >= 1000000 OR doc_id < 30")
    path = tokens.vocabulary(name)
    got = by_id(tokens.count_tokens(few, path, 1024), ["n_tokens"])
    if name.endswith(".model"):
        import sentencepiece

        count = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t))
    else:
        from tokenizers import Tokenizer

        count = lambda t: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids)
    for key, text in zip(docs.doc_id, docs.text, strict=True):
        if key in got and key % 3 == 0:
            assert got[key] == (count(text or ""),)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_chunks(docs, monkeypatch, name):
    """Long texts cut into chunks, small batches, a small table: counts stay those of the whole texts."""
    path = tokens.vocabulary(name)
    if name.endswith(".model"):
        import sentencepiece

        count = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t))
    else:
        from tokenizers import Tokenizer

        count = lambda t, e=Tokenizer.from_file(path): len(e.encode(t, add_special_tokens=False).ids)
    texts = [t or "" for t in [*docs.text[:60], *brute.EDGE]]
    texts += ["no\xa0break space and more words here it's 7 o'clock ok " * 20, "one <|endoftext|> two three <|startoftext|> " * 30, "漢字 かな " * 200, "a  b   c \n\n d\t e " * 90, "x" * 3000]
    for chunk, batch, table in ((40, 100, 10), (7, 1 << 20, 250_000)):
        for k, v in (("CHUNK_CHARS", chunk), ("BATCH_BYTES", batch), ("CACHE_PARTS", table)):
            monkeypatch.setattr(tokens, k, v)
        encoder = tokens.PartEncoder(path, len, sum)
        assert encoder.chunk_end and len(list(encoder._chunks("some words of a text " * 50))) > 10
        got = encoder.encode(texts)
        for text, n in zip(texts, got, strict=True):
            assert n == count(text), repr(text)[:100]
        if name.startswith("byte"):
            ids = tokens.PartEncoder(path, tokens.to_bytes, b"".join).encode(texts)
            assert [len(x) // 4 for x in ids] == got


def test_packing(table, docs):
    got = packing.pack_documents(table, tokens.vocabulary()).toPandas()
    expected = {(key, k): (a, n, c) for key, ids in zip(docs.doc_id, library(docs.text), strict=True) for k, a, n, c in brute.pieces([*ids, 2])}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == expected
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        at = 0
        for r in own.itertuples():
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert got.sequence_id.nunique() <= -(-int(got.length.sum()) // 1024) + 12


def test_minimum_bin_slack():
    rng = random.Random(1)
    for _ in range(30):
        cap = rng.choice([7, 30, 100])
        left = {rng.randint(1, cap): rng.randint(1, 9) for _ in range(8)}
        used = {}
        for bins, combination in packing.minimum_bin_slack(left, cap):
            assert bins > 0 and sum(x * k for x, k in combination.items()) <= cap
            for x, k in combination.items():
                used[x] = used.get(x, 0) + bins * k
        assert used == left
        room, best = rng.randint(0, cap), {0}
        for x, k in left.items():
            best |= {b + x * j for b in best for j in range(k + 1) if b + x * j <= room}
        assert sum(x * k for x, k in packing.fullest(left, room).items()) == max(best)


def test_licenses(table, docs):
    got = by_id(licenses.scan_licenses(table), ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
    seen = 0
    for key, text in zip(docs.doc_id, docs.text, strict=True):
        *own, labels, score = got[key]
        assert tuple(own) == brute.licenses(text), repr(text)[:200]
        expected = {*filter(None, own[4].split(",")), *brute.license_labels(text, licenses.LICENSES)}
        assert labels == ",".join(sorted(expected)) and score == 1 - 0.5 ** len(expected)
        seen += "mit" in expected
    assert seen


def test_license_templates(spark):
    """Every template stands in its own text, with any words in its gaps; a changed word or gap takes it away."""
    whole, broken = {}, {}
    for k, (label, parts) in enumerate(licenses.LICENSES.items()):
        words = " ".join(" ".join(f"gap{i}" for i in range(p)) if isinstance(p, int) else p for p in parts).split()
        whole[2 * k] = (label, "Some text before: " + ", ".join(words).upper() + " and after it.")
        at = len(words) // 2
        broken[2 * k + 1] = (label, " ".join([*words[:at], "changed", *words[at:]]))
    rows = [(k, t) for k, (_, t) in {**whole, **broken}.items()]
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (label, text) in {**whole, **broken}.items():
        assert got[k] - {"gpl", "reserved", "cc-by", ""} == brute.license_labels(text, licenses.LICENSES), label
        assert (label in got[k]) == (k in whole), label


def test_quality(spark, sf_dir, table, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.judge(table, labels)
    got = by_id(judged, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])
    for key, text in zip(docs.doc_id, docs.text, strict=True):
        assert got[key] == brute.quality(text), repr(text)[:200]
    kept = by_id(judged, ["kept", "base_failed", "score"])
    verdicts = brute.quality_verdicts(list(zip(docs.doc_id, docs.text, strict=True)), [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    for key, (score, keep) in zip(docs.doc_id, verdicts, strict=True):
        assert kept[key][0] == keep and kept[key][2] == pytest.approx(score, abs=1e-9), key
    assert not any(k and b for k, b, _ in kept.values())
    both = [(kept[r["doc_id"]][0], r["quality"]) for r in labels.collect()]
    assert sum(k for k, q in both if q == 1) >= 0.93 * sum(q == 1 for _, q in both)
    assert sum(not k for k, q in both if q == 0) >= 0.9 * sum(q == 0 for _, q in both)


def test_quality_counts_all_trusted(spark, monkeypatch):
    """More trusted documents than once were looked at; ids that are sent and ids that are joined give one result."""
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices([f"w{k}" for k in range(i % 7 * 40, i % 7 * 40 + 400)], k=21))) for i in range(28_000)]
    labels = [(i, 1, 0) for i in range(28_000) if i % 7 < 6]
    table, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    verdicts = {i: v for (i, _), v in zip(docs, brute.quality_verdicts(docs, labels), strict=True)}
    for most in (1_000_000, 100):
        monkeypatch.setattr(quality, "BROADCAST_ROWS", most, raising=False)
        for r in quality.judge(table, known).select("doc_id", "score", "kept").collect():
            assert r["score"] == pytest.approx(verdicts[r["doc_id"]][0], abs=1e-9) and r["kept"] == verdicts[r["doc_id"]][1]


def test_quality_scores_held_out_once(spark, sf_dir, monkeypatch):
    plans, place = [], quality.ranks
    monkeypatch.setattr(quality, "ranks", lambda rows, order: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or place(rows, order))
    quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert len(plans) == 1 and "xxhash64" not in plans[0] and "Join" not in plans[0]


def test_quality_columns(spark):
    """Columns named like helpers pass through."""
    names = ["__words", "__one", "__two", "__eight", "__held", "__trusted", "__id", "__text", "other"]
    docs = spark.createDataFrame([(1, "a few words " * 9), (2, None)], "doc_id long, text string").selectExpr("*", *(f"{i} AS `{c}`" for i, c in enumerate(names)))
    out = quality.judge(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert out.columns[: 2 + len(names)] == docs.columns
    assert all(r[c] == i for r in out.collect() for i, c in enumerate(names))


def test_quality_plan_is_native(spark, sf_dir, table):
    for df in (quality.judge(table, spark.read.parquet(f"{sf_dir}/labels.parquet")), licenses.scan_licenses(table), pii.find_pii(table)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow(?!ToR)", plan)


def test_simhash(table, docs):
    got = by_id(simhash.near_duplicates(table), ["fp", "component_id"])
    fps = [brute.fingerprint(t) for t in docs.text]
    assert [got[k][0] % 2**64 for k in docs.doc_id] == fps
    assert [got[k][1] for k in docs.doc_id] == brute.components(list(docs.doc_id), fps)


def test_near_links_splits_hot_shards(spark):
    rng = random.Random(3)
    center = rng.getrandbits(64)
    values = {center}
    for _ in range(1500):
        x = center
        for b in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << b
        values.add(x)
    values = sorted(values)
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    links = [(r.src % 2**64, r.dst % 2**64) for r in simhash.near_links(df, 2, limit=40).collect()]
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        assert a in root and b in root
        root[find(b)] = find(a)
    expected = brute.components(list(range(len(values))), values)
    groups = {}
    for v, c in zip(values, expected, strict=True):
        groups.setdefault(c, set()).add(find(v))
    assert all(len(x) == 1 for x in groups.values()) and len({x for g in groups.values() for x in g}) == len(groups)


def edited(rng, text, share):
    """The text with about ``share`` of its words replaced, dropped or doubled."""
    out = []
    for w in text.split():
        kind = rng.random() / share
        out += [w] if kind > 1 else [] if kind < 0.3 else [w, w] if kind < 0.5 else [f"{w}{rng.randint(0, 9)}"]
    return " ".join(out)


def test_forest():
    """The bucketed tree links what all pairs link, with and without a check."""
    rng = random.Random(9)
    values = []
    for _ in range(12):
        center = rng.getrandbits(128)
        for _ in range(rng.randint(1, 25)):
            values.append(center ^ sum(1 << b for b in rng.sample(range(128), rng.randint(0, 40))))
    prints = np.array([[v >> 64, v & (2**64 - 1)] for v in values], np.uint64)
    for check in (None, lambda i, j: (i * j) % 3 > 0):
        expected = list(range(len(values)))
        for i, x in enumerate(values):
            for j in range(i):
                if (x ^ values[j]).bit_count() <= 32 and (check is None or check(j, i)):
                    expected = [expected[i] if e == expected[j] else e for e in expected]
        got = list(range(len(values)))
        for i, j in neardup.forest(prints, 32, check):
            assert got[i] != got[j]
            got = [got[i] if e == got[j] else e for e in got]
        assert len(set(zip(got, expected, strict=True))) == len(set(got)) == len(set(expected))


@pytest.mark.parametrize(("limit", "size"), [(neardup.SHARD_LIMIT, neardup.GROUP_BYTES), (6, neardup.GROUP_BYTES), (neardup.SHARD_LIMIT, 30_000)])
def test_near_groups(spark, docs, monkeypatch, limit, size):
    """Groups by exact similarity, also where shards and groups are split, by numbers or bytes; near copies at every distance."""
    monkeypatch.setattr(neardup, "GROUP_BYTES", size)
    rng = random.Random(6)
    texts = list(docs.text if (limit, size) == (neardup.SHARD_LIMIT, neardup.GROUP_BYTES) else docs.text[::3])
    long = [t for t in texts if t and 60 < len(t.split()) < 1000]
    texts += [edited(rng, rng.choice(long), s) for s in (0.005, 0.01, 0.015, 0.02, 0.025, 0.03) for _ in range(40)]
    one = long[0]  # a hot group of different texts
    texts += [edited(rng, one, 0.004) for _ in range(60)]
    expected = brute.near_groups(texts)
    rows, groups = neardup.near_groups(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5), limit=limit)
    of = {r["same"]: r["group"] for r in groups.collect()}
    got = {int(r["id"]): of.get(r["same"], r["same"]) for r in rows.collect()}
    pairs = {(expected[i], got[i]) for i in range(len(texts))}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert max(expected.count(c) for c in set(expected)) > 40


@pytest.mark.parametrize("hot", [neardup.HOT, 3])
def test_near_groups_that_sketches_lose(spark, docs, monkeypatch, hot):
    """Pairs at the threshold are found whatever min-hashes and fingerprints say, also under shingles that lead many sets."""
    monkeypatch.setattr(neardup, "HOT", hot, raising=False)
    monkeypatch.setattr(neardup, "_shards", lambda entries, radius, limit: entries.selectExpr("xxhash64(same) AS key", "1L AS n", "same", "a", "b").limit(0))
    rng = random.Random(8)
    texts = list(docs.text[:300])
    long = [t for t in texts if t and 60 < len(t.split()) < 1000]
    texts += [edited(rng, rng.choice(long), s) for s in (0.005, 0.01, 0.02, 0.025) for _ in range(20)] + [edited(rng, long[0], 0.004) for _ in range(20)]
    texts += ["a b c d", "a b c d", "x", "one two three four five six seven eight nine", "one two three four five six seven eight nine ten"]
    expected = brute.near_groups(texts)
    rows, groups = neardup.near_groups(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5))
    of = {r["same"]: r["group"] for r in groups.collect()}
    got = {int(r["id"]): of.get(r["same"], r["same"]) for r in rows.collect()}
    pairs = {(expected[i], got[i]) for i in range(len(texts))}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) < len(texts) - 60


def test_leading_shingles_among_many_frequent_ones():
    """A set's first shingles, also where some, all or none of it are frequent; the work follows the set, not the list of frequent ones."""
    rng = np.random.default_rng(4)
    last = np.unique(rng.integers(0, 1 << 63, 100_000).astype(np.uint64))
    for own in (rng.integers(0, 1 << 63, 40).astype(np.uint64), last[:30], last[-3:], np.concatenate([last[5000:5040], rng.integers(0, 1 << 63, 60).astype(np.uint64)])):
        own, often = np.unique(own), set(last.tolist())
        ordered = sorted(own.tolist(), key=lambda x: (x in often, x))
        expected = ordered[: len(own) - math.ceil(0.8 * len(own) - 1e-9) + 1]
        assert neardup.leading(own, 0.8, last).tolist() == expected
        assert neardup.leading(own, 0.8, last[:0]).tolist() == neardup.leading(own, 0.8).tolist()
    begin = time.process_time()
    for _ in range(1000):
        neardup.leading(own, 0.8, last)
    assert time.process_time() - begin < 2


def test_shingle_sets():
    """Runs of equal words at other places, orders and lengths are told apart; case, white space and copies are not."""
    of = lambda t, k=5: neardup.shingle_set(t, k).tolist()
    assert of("a b c d e") == of(" A\tb\nC d  e ") and len(of("a b c d e f")) == 2 and of("a b c d e")[0] in of("a b c d e f")
    assert len({tuple(of(t)) for t in ("a b c d e", "b a c d e", "e d c b a", "a b c d", "a", "a a", "a a a a a")}) == 7
    assert len(of("a a a a a a a")) == 1 and of(None) == of(" ") == [] and of("x y z x y z x y z", 3) == sorted(set(of("x y z x y", 3)))
    text = " ".join(f"w{i % 700}" for i in range(3000))
    assert len(of(text)) == len({tuple(f"w{(i + k) % 700}" for k in range(5)) for i in range(2996)})


def test_decontamination(spark, sf_dir, table, docs, monkeypatch):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr("cast(item_id AS string) item_id", "text")
    extra = spark.createDataFrame([("s1", "a b c"), ("s2", "Emoji"), ("n", None), ("s1", "one two")], "item_id string, text string")
    items = items.unionByName(extra).cache()
    listed = [(r["item_id"], r["text"]) for r in items.collect()]
    columns = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    expected = dict(zip(docs.doc_id, brute.decontam(docs.text, listed), strict=True))
    assert by_id(decontam.contamination(table, items), columns) == expected
    whole = by_id(decontam.find_matches(table, items, keep=["doc_id"]), ["n_words", "matches"])
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 4000)  # several blocks
    assert by_id(decontam.contamination(table, items), columns) == expected
    assert by_id(decontam.find_matches(table, items, keep=["doc_id"]), ["n_words", "matches"]) == whole
    kept = decontam.drop_contaminated(table, items)
    assert kept.columns == table.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {k for k, x in expected.items() if not x[4]}


def test_decontamination_longest(spark):
    item = " ".join(f"w{i}" for i in range(30))
    text = "start " + " ".join(f"w{i}" for i in range(5, 25)) + " gap " + item
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = decontam.find_matches(docs, spark.createDataFrame([("i", item)], "item_id string, text string")).first()["matches"]
    assert [tuple(m) for m in got] == [("i", 1, 5, 20), ("i", 22, 0, 30)]


def test_decontamination_shared_prefix():
    """A prefix that thousands of items share costs its places once: no product of places and items."""
    import tracemalloc

    prefix = " ".join(f"p{i}" for i in range(20))
    test = decontam.index_windows([(str(i), f"{prefix} own{i} words{i} follow{i}") for i in range(2000)], 13)
    lists = [decontam.words_of(f"{prefix} gap " * 1000), decontam.words_of("other words"), []]
    tracemalloc.start()
    found = [(d, starts, ends, decontam._items(test, k, w)) for d, starts, ends, k, w, _ in decontam._hits(lists, test, 13)]
    assert tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()
    (d, starts, ends, items), = found
    assert d == 0 and len(starts) == 1000 and all(b - a == 20 for a, b in zip(starts, ends, strict=True)) and len(items) == 2000


def test_near_duplicates_any_columns(spark):
    """Maps, structs and values that change places with nulls: rows differ by all their columns."""
    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, text, {"a": 1}, (1, None), "x", None), (2, text + " nine", {"a": 1}, (1, None), "x", None), (None, "p q r s t u", {"b": None}, None, None, "x"), (None, "p q r s t u", {"b": None}, None, "x", None), (7, "other words here", None, None, None, None), (7, "other words here", None, None, None, None)], "doc_id long, text string, m map<string,int>, s struct<a:int,b:string>, u string, v string")
    got = neardup.drop_near_duplicates(docs)
    assert got.schema == docs.schema
    assert sorted(((r["doc_id"], r["m"]) for r in got.collect()), key=str) == [(1, {"a": 1}), (7, None), (None, {"b": None})]
    keys = [r[0] for r in docs.select(neardup.row_key(docs)).collect()]
    assert len(set(keys)) == 5 and all(len(k) > 20 for k in keys)


def test_decontamination_any_columns(spark):
    """Columns that pandas can't hold pass through."""
    docs = spark.sql("SELECT 1 AS doc_id, 'a b c' AS text, CAST(1.25 AS decimal(20, 5)) AS price, TIMESTAMP '9999-12-31 00:00:00' AS at, named_struct('x', array(map('k', 1))) AS nested, 5 AS found, 6 AS doc UNION ALL SELECT 2, 'x y', null, null, null, 5, 6")
    items = spark.createDataFrame([(1, "x y")], "item_id long, text string")
    kept = decontam.drop_contaminated(docs, items)
    assert kept.schema == docs.schema and kept.select("doc_id", F.col("price").cast("string"), F.col("at").cast("string")).collect() == [(1, "1.25000", "9999-12-31 00:00:00")]


@pytest.mark.parametrize("mark", ["post-comments", "comment-body", "user-comments", "main-navigation", "site_navigation", "breadcrumb-nav", "footer-links", "sidebar-right", "cookie-law", "subscribe-box", "social-media"])
def test_html_landmarks_by_a_part_of_their_name(mark):
    text = lambda page: html.main_text(html.parse(page), lambda slot, text: False)
    for attribute in ("class", "id"):
        assert text(f"<body><div><p>What is read.</p></div><div {attribute}='{mark}'><p>What is not.</p></div></body>") == "What is read."
        # What holds the page's article or heading is none, nor are layouts and sections of the text.
        assert text(f"<body><div {attribute}='{mark}-wrapper'><div class='sidebar'>x</div><article><p>What is read.</p></article></div></body>") == "What is read."
    assert text("<body><div id='comments-42'><article class='comment'><p>A reader.</p></article></div><p>What is read.</p></body>") == "What is read."
    assert text("<body><article><p>What is read.</p></article><article class='comment-body'><p>A reader.</p></article></body>") == "What is read."
    assert text("<body><div class='page has-sidebar no-comments'><p>What is read.</p></div><div class='nav-area'><a>go</a></div></body>") == "What is read."


def test_html_teasers():
    text = lambda page: html.main_text(html.parse(page), lambda slot, text: False)
    long = "<article><p>" + "What is read. " * 20 + "</p></article>"
    read = ("What is read. " * 20).strip()
    assert text(f"<body>{long}<article class='teaser'><p>Somewhere else</p></article></body>") == read
    assert text(f"<body>{long}<article><a href='x'>Read this, too</a> soon</article></body>") == read
    assert text(f"<body>{long}<article><p>A short one of its own.</p></article></body>") == f"{read}\nA short one of its own."
    assert text("<body><article class='post-card'><p>The only one.</p></article></body>") == "The only one."


def test_tree_match_compares_what_differs():
    """Thousands of nodes: a tree with itself, and with another that has few nodes more."""
    import time

    rows = "".join(f"<tr><td>{i}</td><td class='{'ab'[i % 2]}'><p>x</p></td></tr>" + "<tr class='odd'><th>q</th></tr>" * (i % 3 > 0) for i in range(500))
    one = html.Tree(html.shape(html.parse(f"<body><table>{rows}</table></body>")))
    two = html.Tree(html.shape(html.parse(f"<body><ul><li>new</li></ul><table>{rows[:9000]}<tr><td>new<td>new</tr>{rows[9000:]}</table></body>")))
    began = time.process_time()
    assert len(one.labels) > 2000 and html.tree_match(one, one) == {i: i for i in range(len(one.labels))}
    match = html.tree_match(one, two)
    assert time.process_time() - began < 1.0 and len(match) >= len(one.labels) - 8 and all(one.labels[p] == two.labels[q] for q, p in match.items())


def test_line_dedup(table, docs):
    out = linededup.dedup_lines(table)
    assert out.columns == table.columns and out.count() == len(docs)
    got = by_id(out, ["text", "n_chars"])
    expected = brute.line_dedup(list(zip(docs.doc_id, docs.text, strict=True)))
    changed = 0
    for key, text, new in zip(docs.doc_id, docs.text, expected, strict=True):
        assert got[key] == (new, None if new is None else len(new)), key
        changed += new != text
    assert changed > 20


def test_line_dedup_small(spark):
    """Line ends stay as they are, blank lines are no lines, shared lines that are no window stay."""
    rows = [(1, "\n\na\nb\nc\nd\n\n"), (2, "x\na\nb\n\nc\ny\n\n"), (3, "\nb\nc\nd\n\n"), (4, "a\nb\nx"), (5, "one\ntwo"), (6, "a\nb\nc"), (None, "q\nr\ns"), (7, "q\nr\ns"), (8, "z\nz\nz\nz\nz"), (8, "z\nz\nz\nz\nz")]
    got = [(r["doc_id"], r["text"]) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(k, t) for (k, _), t in zip(rows, brute.line_dedup(rows), strict=True)], key=str)
    assert dict(got)[6] == "" and dict(got)[7] == "" and dict(got)[4] == "a\nb\nx"


@pytest.mark.parametrize("remembered", [0, 3, 100_000])
def test_line_dedup_of_a_notice_everywhere(spark, monkeypatch, remembered):
    """A notice in every batch of a task, in ids of any order: about one row of it leaves the task, and the result is that of the plain version."""
    monkeypatch.setattr(linededup, "BATCH_CHARS", 200)
    monkeypatch.setattr(linededup, "REMEMBERED", remembered)
    rng = random.Random(4)
    notice = "all of this\nis a notice\nto be seen\neverywhere\n"
    ids = rng.sample(range(1000), 120)
    rows = [(k, f"{rng.random()}\n{notice * rng.randint(1, 2)}{rng.choice('abc')}\nx\ny\n{rng.random()}\n") for k in ids]
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {k: t for (k, _), t in zip(rows, brute.line_dedup(rows), strict=True)}
    known, left = None, 0
    window = np.frombuffer(linededup.window_digests(notice.split("\n")[:3]), "<i8", 1)[0]
    for k in sorted(ids):
        text = dict(rows)[k]
        found, known = linededup._places(pd.DataFrame({"id": [k], "text": [text], "t": [k]}), known)
        left += int(((found["high"] == window) & ~found["sure"]).sum())
    assert left <= 12  # first places until one text repeats it


def common_run(a, b):
    """Words of the longest run that both texts hold."""
    x, y = a.split(), b.split()
    best, row = 0, [0] * (len(y) + 1)
    for w in x:
        row = [0, *(row[j] + 1 if w == y[j] else 0 for j in range(len(y)))]
        best = max(best, *row)
    return best


@pytest.mark.parametrize("ends", ["", ".", "mixed"])
def test_line_dedup_passages(spark, ends):
    """A passage of 51 words or more does not stay twice, at whatever offset in a long line it stands, with sentences of any length."""
    rng = random.Random(5)
    mark = lambda: ends if ends in ("", ".") else rng.choice(["", "", "", "", "", "", ".", "?"])
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) + mark()
    rows = []
    for k in range(60):
        passage = [word() for _ in range(rng.choice([51, 51, 52, 60, 90]))]
        for i in range(2):
            rows.append((2 * k + i, " ".join([*(word() for _ in range(rng.randint(0, 25))), *passage, *(word() for _ in range(rng.randint(0, 25)))])))
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(60):
        assert got[2 * k] == rows[2 * k][1] and common_run(got[2 * k], got[2 * k + 1]) <= 50


def test_pii(table, docs):
    got = by_id(pii.find_pii(table), ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
    for key, text in zip(docs.doc_id, docs.text, strict=True):
        *n, spans = brute.pii(text)
        assert got[key][:5] == (*n, brute.sha(spans)), repr(text)[:200]
    expected = brute.disclosing_terms(list(docs.text))
    assert [got[k][5] for k in docs.doc_id] == expected and sum("term:" in x for x in expected) > 5


def test_pii_without_broadcast(table, docs, monkeypatch):
    """More terms than may be broadcast: the same spans."""
    few = table.filter("doc_id % 3 = 0 OR doc_id >= 1000000")
    one = by_id(pii.find_pii(few), ["spans"])
    monkeypatch.setattr(pii, "BROADCAST_BYTES", 0)
    assert by_id(pii.find_pii(few), ["spans"]) == one and any("term:" in x for x, in one.values())


def test_pii_disclosing_terms(spark):
    rows = [(i, "Write to Zarkovian at secret@mail.org about other things") for i in range(5)] + [(9, "many other things about words")]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = rows[0][1]
    at = text.index("Zarkovian")
    assert f"term:{at}:{at + 9}" in got[0].split(",") and got[9] == "" and f"email:{text.index('secret')}" in got[0]


def test_pii_terms_anywhere(spark):
    """A disclosing term far from the entity counts and is marked at every place in the documents that hold the entity, and there alone."""
    far = "and many other plain words stand here between them " * 3
    text = f"Zarkovian came. {far}Write to secret@mail.org. {far}Then Zarkovian left"
    rows = [(i, text) for i in range(3)] + [(i, f"{far}Write came left Then") for i in range(10, 40)] + [(50, "Zarkovian alone"), (51, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs).collect()}
    places = [text.index("Zarkovian"), text.rindex("Zarkovian")]
    mail = text.index("secret")
    assert got[0] == got[2] == f"term:{places[0]}:{places[0] + 9},email:{mail}:{mail + 15},term:{places[1]}:{places[1] + 9}"
    assert got[10] == got[50] == got[51] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitize(docs).collect()}
    assert clean == {i: (t or "").replace("Zarkovian", "[TERM]").replace("secret@mail.org", "[EMAIL]") if i < 3 else t or "" for i, t in rows}


VOCABULARY = "byte_bpe_50k.tiktoken"


def test_secrets(table, docs):
    got = by_id(secrets.scan_secrets(table, tokens.vocabulary(VOCABULARY)), ["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    count = lambda x, e=secrets.load_encoding(tokens.vocabulary(VOCABULARY)): len(e.encode_ordinary(x))
    for key, text in zip(docs.doc_id, docs.text, strict=True):
        *n, spans = brute.secrets(text)
        assert got[key][:4] == (*n, brute.sha(spans)), repr(text)[:200]
        base = [x.split(":") for x in spans.split(",") if x]
        more = brute.random_runs(text, [(int(a), int(b)) for _, a, b in base], count)
        order = [(int(a), ("assign", "access", "hex").index(k), int(b), k) for k, a, b in base] + [(a, 3, b, "random") for a, b in more]
        assert got[key][4] == ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(order)), repr(text)[:200]


def test_secrets_random(spark):
    """Random strings with and without digits; digests, UUIDs and joined words are none."""
    rng = random.Random(2)
    letters, both = ("".join(rng.choice(a) for _ in range(24)) for a in ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
    plain = [
        "id 123e4567-e89b-12d3-a456-426614174000 internationalization-of-everything", "getUserAccountByIdentifier_2024_final SomeVeryLongClassNameFactoryBean", "D41D8CD98F00B204E9800998ECF8427E", "2024-01-01/2025-12-31/00000001",
        "shipping-label-00012345-large-998877-001", "MAX_CONNECTION_RETRY_COUNT_LIMIT", "", None,
    ]
    odd = ["xQ9vT2mZk8Lw4RpB7nYc1J", "xQvTmZkLwRpBnYcJAbCdEf", letters, both]
    rows = [(i, t) for i, t in enumerate(plain)] + [(100 + i, f"key {x} end") for i, x in enumerate(odd)]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), tokens.vocabulary(VOCABULARY)).collect()}
    assert got == {i: "" for i in range(len(plain))} | {100 + i: f"random:4:{4 + len(x)}" for i, x in enumerate(odd)}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><ul><li><a>Home</a></ul></nav>
<div class="ad">Buy</div><header><h1>Site</h1></header><article><header class="entry-header"><h1>Title {i} &amp; more</h1></header><p><b>First  {i}
line<br>tail.<p>Second &eacute; {i}</p><aside>Aside</aside><div class="comments"><p>Nice {i}</p></div></article><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE.format(i=i)) for i in range(30)] + [(90, None, None), (91, "http://[bad", ""), (92, "http://x.org", "plain <b>text</b> & more"), (93, "u", "<p>a" * 300)]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(30):
        text = f"Title {i} & more\nFirst {i} line tail.\nSecond é {i}"
        assert got[i] == (text, len(text))
    assert got[90] == got[91] == ("", 0) and got[92][0] == "plain text & more" and got[93][0] == "\n".join(["a"] * 300)


def test_html_real(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.extract_text(pages).collect()}
    import html as references

    for r in pages.collect():
        area = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        parts = [" ".join(references.unescape(re.sub(r"<[^>]*>", " " if False else "", re.sub("<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", area)]
        assert got[r["page_id"]] == "\n".join(x for x in parts if x)


def extracted(spark, bodies, host="h.org"):
    rows = [(i, f"http://{host}/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    got = {r["page_id"]: r["text"] for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [got[i].split("\n") for i in range(len(rows))]


def test_html_repeats_are_no_template(spark, monkeypatch):
    """One page of repeated paragraphs, copied pages, and template text among varying texts in one slot."""
    page = lambda i, more="": f"<article><h1>Title {i}</h1><p>First {i}</p><p>Second {i}</p>{more}</article>"
    bodies = [page(0, "<p>Again</p>" * 120), *map(page, range(1, 20))]
    for limit in (html.BROADCAST_BYTES, -1):
        monkeypatch.setattr(html, "BROADCAST_BYTES", limit)
        for i, got in enumerate(extracted(spark, bodies)):
            assert got == [f"Title {i}", f"First {i}", f"Second {i}", *["Again"] * (120 if i == 0 else 0)]
        for got, i in zip(extracted(spark, [page(k) for k in [0] * 12 + list(range(1, 13))]), [0] * 12 + list(range(1, 13)), strict=True):
            assert got == [f"Title {i}", f"First {i}", f"Second {i}"]
        for i, got in enumerate(extracted(spark, [page(i, "<p>Read more on our site</p>") for i in range(20)])):
            assert got == [f"Title {i}", f"First {i}", f"Second {i}"]


def test_html_join_form(spark, sf_dir, monkeypatch):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    one = {r["page_id"]: r["text"] for r in html.extract_text(pages).collect()}
    monkeypatch.setattr(html, "BROADCAST_BYTES", -1)
    assert {r["page_id"]: r["text"] for r in html.extract_text(pages).collect()} == one


def test_tree_matching():
    a, b = html.Tree("0 r\n1 x\n1 y\n2 z\n1 w"), html.Tree("0 r\n1 y\n2 z\n1 w")
    assert html.tree_match(a, b) == {0: 0, 1: 2, 2: 3, 3: 4}
    assert html.tree_match(a, html.Tree("0 q")) == {}
    html.add_shape(b, a)
    assert b.text() == "0 r\n1 x\n1 y\n2 z\n1 w"
    rng = random.Random(4)
    for _ in range(40):  # the size of the match against all order-preserving ones
        trees = []
        for _ in range(2):
            lines, depth = ["0 r"], 0
            for _ in range(rng.randint(0, 7)):
                depth = rng.randint(1, depth + 1)
                lines.append(f"{depth} {rng.choice('ab')}")
            trees.append(html.Tree("\n".join(lines)))
        x, y = trees

        def most(p, q, x=x, y=y):
            if x.labels[p] != y.labels[q]:
                return 0

            def row(u, v):
                if not u or not v:
                    return 0
                own = most(u[0], v[0])
                return max(row(u[1:], v), row(u, v[1:]), own and own + row(u[1:], v[1:]))

            return 1 + row(x.kids[p], y.kids[q])

        match = html.tree_match(x, y)
        assert len(match) == most(0, 0) and all(x.labels[p] == y.labels[q] for q, p in match.items())


def test_html_probes(spark):
    """Nothing of an article is lost: refrains, recrawls, odd class names, forms, formulas; deep and long pages do not crash."""
    song = "<article><h1>Song</h1>" + "".join(f"<p>Verse {i}</p><p>Refrain la la</p><p>Oh yes</p>" for i in range(6)) + "</article>"
    assert extracted(spark, [song]) == [["Song", *(x for i in range(6) for x in (f"Verse {i}", "Refrain la la", "Oh yes"))]]
    crawls = [f"<article><h1>Crawl {i}</h1><p>Text {i % 10} first</p><p>Text {i % 10} second</p></article>" for i in range(30)] + ["<article><h1>Again</h1><p>Text 0 first</p><p>Text 0 second</p></article>"] * 40
    for i, got in enumerate(extracted(spark, crawls)):
        assert got == [f"Crawl {i}" if i < 30 else "Again", f"Text {i % 10 if i < 30 else 0} first", f"Text {i % 10 if i < 30 else 0} second"]
    odd = [
        '<div class="layout has-sidebar"><article><p>One</p></article></div>', '<div id="content" class="no-sidebar"><p>Two</p></div>', "<form id=f><div><h1>T</h1><p>Three</p><button>Go</button></div></form>",
        '<p>See <a class="related" href="x">this</a> and <math><mi>x</mi><mo>+</mo><mn>1</mn></math> end.</p>', "<form><p>Only</p></form>", '<div class="widget"><p>Whole</p></div>',
        "<script><!-- no end </script><p>After</p>", "<head><title>t</title><p>Open head", "<p style='color: red'>Seen</p><p style='display:  none'>Unseen</p>",
    ]
    assert [extracted(spark, [x])[0] for x in odd] == [["One"], ["Two"], ["T", "Three"], ["See this and x+1 end."], ["Only"], ["Whole"], ["After"], ["Open head"], ["Seen"]]
    large = ["<div>" * 100_000 + "deep" + "</div>" * 100_000, "<script>var a = '</p>';</script>" * 300_000 + "<p>end", "</b></p>" * 100_000 + "x", "<p>a<b>" * 50_000, "<" * 200_000]
    got = extracted(spark, large)
    assert got[:3] == [["deep"], ["end"], ["x"]] and got[3] == ["a"] * 50_000 and got[4][0].startswith("<<<")


def test_html_alignment_decides(spark, monkeypatch):
    """Hosts without articles, landmarks or classes, with two layouts: a plain count of texts by place of the layout gives the template."""
    rng = random.Random(8)
    bodies, layouts = [], []
    for i in range(60):
        own = [f"Own {i} {k} {rng.random()}" for k in range(rng.randint(1, 4))]
        head, foot = "<div><ul><li>Home</li><li>About</li></ul></div>", "<div><h3>Legal</h3><p>All is well</p></div>"
        extra = "<div><table><tr><td>Weather</td></tr></table></div>" if i % 3 else ""
        if i % 2:
            bodies.append(f"{head}{extra}<div><h2>Title {i}</h2>{''.join(f'<p>{x}</p>' for x in own)}</div>{foot}")
        else:
            bodies.append(f"<table><tr><td>Index<td>Search</tr></table><div><h2>Title {i}</h2>{''.join(f'<blockquote>{x}</blockquote>' for x in own)}</div><ol><li>Mail us</ol>{extra}")
        # a text of the template in a slot of the content is content
        bodies[-1] = bodies[-1].replace("</h2>", "</h2><p>Home</p>", 1) if i == 7 else bodies[-1]
        layouts.append([f"Title {i}", *(["Home"] if i == 7 else []), *own])
    for limit in (html.BROADCAST_BYTES, -1):
        monkeypatch.setattr(html, "BROADCAST_BYTES", limit)
        assert extracted(spark, bodies) == layouts
        monkeypatch.setattr(html, "MERGED_SHAPES", 1)  # merged in parts


@pytest.mark.parametrize("kind", ["long pages", "many layouts"])
def test_html_slots_beyond_the_tree(spark, kind):
    """Template texts are found in slots that have no room in the host's tree, and texts that vary there stay."""
    rows, content = [], {}
    for i in range(12):
        if kind == "long pages":  # 6,001 blocks or more before the last ones, of which one page has more
            own = [f"story {i} {k}" for k in range(3_000 + i)]
            body = "".join(f"<div><h4>{t}</h4></div><p>{t} more</p>" for t in own)
            texts = [x for t in own for x in (t, f"{t} more")]
        else:  # 900 blocks of each page that no other page has; the tree is full with the first six
            texts = [f"story {i} {k}" for k in range(900)]
            body = "".join(f"<div class='c{chr(97 + i)}{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}'>{t}</div>" for k, t in enumerate(texts))
        last = f"<section><p>ever the same words</p><blockquote>said {i}</blockquote></section>" if kind == "long pages" or i >= 6 else f"said {i}"
        rows.append((i, "http://long.example/x", f"<html><body>{body}{last}</body></html>"))
        content[i] = "\n".join([*texts, f"said {i}"])
    got = {r["page_id"]: r["text"] for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == content


def test_html_columns_and_edges(spark):
    names = ["host", "shape", "slot", "text", "copy", "layout", "n", "fixed", "n_chars", "part", "node"]
    page = "<nav>x</nav><p>Body</p>"
    rows = [(None, "http://a/1", page), (5, None, page), (5, None, page), (6, "http://a/2", None), (7, "http://a/3", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", *(f"{i} AS `{c}`" for i, c in enumerate(names)))
    got = sorted(((r["page_id"], r["text"]) for r in html.extract_text(pages).collect()), key=str)
    assert got == sorted([(None, "Body"), (5, "Body"), (5, "Body"), (6, ""), (7, "")], key=str)


def test_empty_and_repeated(spark, sf_dir, tmp_path):
    """All operators on empty tables and on rows that repeat."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "Some words to see and count here, a@b.org among them. " * 3
    same = spark.createDataFrame([(1, text, "en", "s", 3), (1, text, "en", "s", 3), (None, text, None, None, None), (2, None, None, None, None)], schema)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    vocabulary = tokens.vocabulary()
    for docs, n in ((same, 4), (same.limit(0), 0)):
        assert tokens.count_tokens(docs, vocabulary, 10).count() == n
        assert packing.pack_documents(docs, vocabulary).count() == n
        assert licenses.scan_licenses(docs).count() == n
        assert quality.judge(docs, labels).count() == n
        assert simhash.near_duplicates(docs).count() == n
        assert decontam.contamination(docs, items).count() == n and decontam.find_matches(docs, items).count() == n
        assert linededup.dedup_lines(docs).count() == n
        assert pii.find_pii(docs).count() == n
        assert secrets.scan_secrets(docs, tokens.vocabulary("byte_bpe_50k.tiktoken")).count() == n
        assert decontam.drop_contaminated(docs, items).count() == n
    assert html.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]


def test_large_ids_beside_nulls(spark):
    """Ids over 2**53 stay exact in a partition that holds a null id."""
    big = 2**60 + 1
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen. " * 6
    docs = spark.createDataFrame([(big, text), (None, text), (big + 2, None)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    path = tokens.vocabulary()
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = docs.selectExpr("doc_id AS page_id", "'http://a' AS url", "text AS html")
    for made in (
        tokens.count_tokens(docs, path, 10), packing.pack_documents(docs, path), simhash.near_duplicates(docs), decontam.contamination(docs, items), decontam.find_matches(docs, items), linededup.dedup_lines(docs),
        secrets.scan_secrets(docs, tokens.vocabulary("byte_bpe_50k.tiktoken")), pii.find_pii(docs), licenses.scan_licenses(docs), quality.judge(docs, labels), html.extract_text(pages).withColumnRenamed("page_id", "doc_id"),
    ):
        assert {r["doc_id"] for r in made.select("doc_id").collect()} == {big, None, big + 2}
        assert dict(made.dtypes)["doc_id"] == "bigint"
    assert decontam.drop_contaminated(docs, items).select("doc_id").collect()[0][0] == big + 2


def test_long_texts(spark, sf_dir):
    """Texts of megabytes, and one word of a megabyte, go through every operator whole."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    tail = " mail a@b.org from 10.0.0.1, MIT license, password=abcdefgh12 end"
    long = " ".join(rng.choice(vocabulary) + rng.choice(["", "", ".", "\n"]) for _ in range(300_000)) + tail
    rows = [(1, long), (2, "x" * 1_000_000), (3, long.replace(" ", "  ", 1)), (4, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    items = spark.createDataFrame([("i", " ".join(long.split()[5000:5040]))], "item_id string, text string")
    n = len(long.split())
    alnum = len(brute.ALNUM.findall(long.translate(brute.LOWER)))
    assert by_id(tokens.count_tokens(docs, tokens.vocabulary(), 1024), ["n_tokens"])[1][0] == len(library([long])[0])
    packed = packing.pack_documents(docs, tokens.vocabulary()).filter("doc_id = 1").agg({"length": "sum"}).first()[0]
    assert packed == len(library([long])[0]) + 1
    got = by_id(licenses.scan_licenses(docs), ["n_words", "labels"])
    assert got[1] == (alnum, "mit") and got[2][0] == 1
    judged = by_id(quality.judge(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")), ["n_words", "base_failed"])
    assert judged[1] == (n, False) and judged[2] == (1, True)
    fps = by_id(simhash.near_duplicates(docs), ["fp", "component_id"])
    assert fps[1][0] % 2**64 == brute.fingerprint(long) and fps[3][1] == 1
    assert {r["doc_id"] for r in neardup.drop_near_duplicates(docs).collect()} == {1, 2, 4}
    found = by_id(decontam.contamination(docs, items), ["n_words", "n_hit", "contaminated"])
    assert found[1][0] == alnum and found[1][1] >= 40 and not found[1][2]
    lines = by_id(linededup.dedup_lines(docs), ["text"])
    assert lines[1][0] == long and lines[2][0] == "x" * 1_000_000 and len(lines[3][0]) < 100
    at = long.index("a@b.org")
    assert by_id(pii.find_pii(docs), ["n_email", "n_ip", "spans"])[1][:2] == (1, 1) and f"email:{at}:{at + 7}" in by_id(pii.find_pii(docs), ["spans"])[1][0]
    assert by_id(secrets.scan_secrets(docs, tokens.vocabulary(VOCABULARY)), ["n_assign"])[1] == (1,)

"""Each operator over Spark on small tables: edge rows, empty tables, extra columns, and brute-force results."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postmark.llm import ann, bpe, components, decontamination, html, licenses, linededup, neardup, pii, quality, queries, tables, tokenfile

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BASE = " ".join(f"word{i}" for i in range(60))
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE + " more"), (4, None), (5, ""), (6, "two words"), (7, "Two  words"), (8, "x" * 20000), (9, "long " * 20000), (None, "no id here at all, none"),
    (10, "first line\nshared boilerplate line of seven words here\nlast"), (11, "shared boilerplate line of seven words here\nown"), (11, "shared boilerplate line of seven words here\nown"),
    (12, "Released under the MIT License. mail me: a.b@c.example.com or +1 (988) 555-2485"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_licenses(docs, empty):
    got = by_id(licenses.scan_licenses(docs), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert got[12][1:] == (1, 3, 3, "mit", "mit,mit-notice", 1.0)
    assert got[4] == got[5] == (0, 0, None, None, "", "", 0.0)
    assert licenses.scan_licenses(docs).count() == len(TEXTS)
    assert licenses.scan_licenses(empty).count() == 0


def test_personal_data(docs, empty):
    got = by_id(pii.find_personal_data(docs), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    text = dict(TEXTS)[12]
    a, b = text.index("a.b@"), text.index("+1")
    said = f"email:{a}:{a + len('a.b@c.example.com')},phone:{b}:{len(text)}"
    assert got[12] == (1, 0, 0, 1, hashlib.sha256(said.encode()).hexdigest(), said)
    assert got[4][-1] == got[8][-1] == ""
    assert pii.find_personal_data(empty).count() == 0


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    rows = bpe.encode_documents(docs, with_ids=True).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = dict(TEXTS)[r["doc_id"]] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["token_ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode_documents(empty).count() == 0


def test_token_files_round_trip(spark, docs, empty):
    folder = tables.shared_dir(spark)
    manifest = tokenfile.write(docs, folder)
    rows = tokenfile.documents(manifest, folder, with_ids=True).collect()
    encoder = tokenfile.Encoder(tokenfile.default_vocabulary())
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((i for i, _ in TEXTS), key=lambda i: -1 if i is None else i)
    start = 0
    for r in rows:
        want = encoder.tokenizer.encode(dict(TEXTS)[r["doc_id"]] or "", add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["token_ids"]) == (start, len(want), want)
        assert r["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    folder = tables.shared_dir(spark)
    assert tokenfile.documents(tokenfile.write(empty, folder), folder).count() == 0


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, "word7 word8 word9 word10 word11 word12"), (2, None), (3, "two words"), (4, ""), (5, "nothing of this is in any document here")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["coverage"]) for r in decontamination.leaks(docs, bench).collect()}
    assert got == {(i, 1, 1.0) for i in (1, 2, 3)}
    assert decontamination.leaks(docs, bench.limit(0)).count() == 0
    assert decontamination.leaks(empty, bench).count() == 0
    extra = docs.withColumn("coverage", F.lit(1)).withColumn("item_id", F.lit("x"))
    left = decontamination.clean(extra, bench)
    assert left.columns == extra.columns
    assert left.count() == len(TEXTS) - 3
    # blocks of any size give the same leaks
    many = list(decontamination.blocks(bench, block_words=3))
    assert sum(len(b.ids) for b in many) == 5 and len(many) > 1


def _brute_lines(rows, percent):
    lines = sorted((d, n, frozenset(line.lower().strip(" \t\r").split(" "))) for d, t in rows for n, line in enumerate(t.split("\n")) if line.strip(" \t\r"))
    gone = defaultdict(int)
    for k, (d, _, s) in enumerate(lines):
        gone[d] += any(len(s & p) * (100 + percent) >= (len(s) + len(p)) * percent for _, _, p in lines[:k])
    return gone


def test_line_dedup(spark, docs, empty):
    rng = np.random.Generator(np.random.PCG64(3))
    vocabulary = [f"v{i}" for i in range(60)]
    pool = [list(rng.choice(vocabulary, int(rng.integers(1, 25)))) for _ in range(25)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(int(rng.integers(0, 6))):
            line = list(pool[int(rng.integers(len(pool)))])
            if rng.random() < 0.5:
                line[int(rng.integers(len(line)))] = "edit" + str(int(rng.integers(1000)))
            lines.append(" ".join(line))
        rows.append((d, "\n".join(lines)))
    got = by_id(linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")), "n_removed", "text")
    want = _brute_lines(rows, linededup.PERCENT)
    assert {d: n for d, (n, _) in got.items()} == {d: want[d] for d, _ in rows}
    out = linededup.dedup_lines(docs.withColumn("n_lines", F.lit("kept?")).withColumn("gone", F.lit(1)))
    texts = defaultdict(list)
    for r in out.collect():
        texts[r["doc_id"]].append(r["text"])
    assert texts[11] == ["own", "own"] and texts[10] == [dict(TEXTS)[10]] and texts[4] == [None] and texts[2] == [""]
    assert linededup.dedup_lines(empty).count() == 0


def test_line_ranks_stay_short_in_plans(spark, docs):
    sets = linededup.entries(docs, linededup.ranks(docs), linededup.PERCENT)
    assert len(sets._jdf.queryExecution().toString()) < 1_000_000  # the driver keeps such texts for each step


def test_line_words_are_sorted_as_plain_longs(spark, docs):
    ordered = docs.select(linededup._ordered(F.col("text"), linededup.ranks(docs)).alias("codes"))
    assert not ordered.schema["codes"].dataType.containsNull  # arrays that may hold nulls are sorted boxed, by a comparator


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 0), (9, 0, 0), (6, 1, None), (None, 1, 0), (7, None, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert quality.score(empty, quality.train(docs, labels.limit(0))).count() == 0
    extra = docs.withColumn("score", F.lit("x"))
    assert quality.accepted(extra, model).columns == extra.columns


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.query(spark, sf).join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95


def _brute_near(rows):
    sets = {}
    for i, t in rows:
        if i is None:
            continue
        w = (t or "").lower().split()
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    ids = sorted(sets)
    label = {i: i for i in ids}
    for x in ids:
        for y in ids:
            if x < y and any(100 * len(a & b) >= 75 * len(a | b) and a and b for a in sets[x] for b in sets[y]):
                a, b = label[x], label[y]
                label = {k: min(a, b) if v == max(a, b) else v for k, v in label.items()}
    return label


def test_near_duplicates(spark, docs, empty):
    rng = np.random.Generator(np.random.PCG64(8))
    rows = list(TEXTS)
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(int(rng.integers(5, 90)))]
        for k in range(12):
            words = list(base)
            for _ in range(int(rng.integers(0, 3))):
                words[int(rng.integers(len(words)))] = f"e{int(rng.integers(1000))}"
            rows.append((100 + 20 * g + k, " ".join(words)))
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(4)
    for tree in ({}, {"leaf": 4, "max_depth": 5}):  # the second branches on and compares in blocks
        got = neardup.near_duplicates(df, **tree).collect()
        assert len(got) == len(rows)
        want = _brute_near(rows)
        assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
        assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)
    assert neardup.near_duplicates(empty).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (5, 6), (6, 5)]
    got = components.components(spark.createDataFrame(links, "a long, b long"), tables.shared_dir(spark)).collect()
    assert {(r["id"], r["component"]) for r in got} == {(k, 0) for k in range(31)} | {(k, 100) for k in range(100, 140)}
    assert components.components(spark.createDataFrame([], "a long, b long"), tables.shared_dir(spark)).count() == 0


def test_nearest_vectors(spark):
    rng = np.random.Generator(np.random.PCG64(1))
    v = rng.normal(size=(3000, 16)).astype(np.float32)
    v[100:140] = v[100]  # ties
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [None] * 16), (5080, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 3000, 100))
    hits = 0
    for q, found in got.items():
        s = (v[q].astype(float) * v.astype(float)).sum(1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(3000), -s))[:20]
        hits += len(set(best) & {i for i, _ in found})
        assert [x for _, x in found] == sorted((x for _, x in found), reverse=True) and all(s[i] == x for i, x in found)
    assert hits / (20 * len(got)) >= 0.9
    few = ann.search(df.where("vec_id < 6"), F.col("vec_id") == 0).collect()
    assert [r["vec_id"] for r in sorted(few, key=lambda r: r["rank"])] == sorted(range(1, 6), key=lambda i: -(v[0].astype(float) * v[i]).sum())
    assert ann.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def _recall(v, every, found_by):
    hits = 0
    for q in range(0, len(v), every):
        s = v @ v[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & found_by.get(q, set()))
    return hits / (20 * len(range(0, len(v), every)))


def test_nearest_vectors_of_unequal_norm(spark):
    rng = np.random.Generator(np.random.PCG64(5))
    v = rng.normal(size=(6000, 32))
    v *= (np.exp(0.5 * rng.normal(size=6000)) / np.linalg.norm(v, axis=1))[:, None]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann.search(df, F.col("vec_id") % 50 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert _recall(v, 50, got) >= 0.93


def test_nearest_vectors_of_a_lonely_query(spark):
    rng = np.random.Generator(np.random.PCG64(6))
    v = np.eye(16)[0] + 0.03 * rng.normal(size=(3000, 16))
    v[:5] = 0.03 * rng.normal(size=(5, 16)) - np.eye(16)[0]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") < 10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert {q: len(found) for q, found in got.items()} == {q: 20 for q in range(10)}
    for q in range(5):
        s = v @ v[q]
        s[q] = -np.inf
        assert got[q] == np.argsort(-s)[:20].tolist()


def test_projections_give_way_where_no_move_reaches():
    v = np.random.Generator(np.random.PCG64(7)).normal(size=(2000, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    h = ann.measured(v, 1.0, 5, 20, 0.95, widths=(0.2,))  # neighbours are many cells apart
    assert h.k < 5 and h.probes <= 3**h.k


def test_probes_are_the_cheapest_moves():
    rng = np.random.Generator(np.random.PCG64(8))
    h = ann.Hashing(rng.normal(size=(2, 6, 9)), rng.uniform(0, 1, (2, 6)), 1.0, 1.0)
    v = rng.normal(size=(5, 8))
    every = h.visits(v, 3**6)
    assert (h.visits(v, 40) == every[..., :40]).all() and len(set(every[0, 0].tolist())) == 3**6


def test_a_small_share_of_clustered_vectors_is_looked_at():
    rng = np.random.Generator(np.random.PCG64(9))
    centres = rng.normal(size=(200, 32))
    v = centres[rng.integers(200, size=8000)] + 0.2 * rng.normal(size=(8000, 32))
    v /= np.linalg.norm(v, axis=1)[:, None]
    h = ann.measured(v, 1.0, 8, 20, 0.95)
    own, visits = h.names(np.floor(h.places(v)).astype(np.int64)), h.visits(v[:200], h.probes)
    share = np.mean([np.any([np.isin(own[:, t], visits[q, t]) for t in range(own.shape[1])], axis=0).mean() for q in range(200)])
    assert h.k >= 1 and share < 0.2, share


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>"), (2, None, None), (None, "v", "")], "page_id long, url string, html string").withColumn("text", F.lit("other"))
    got = {(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html.extract_pages(pages).collect()}
    assert got == {(1, "u", "x", 1), (2, None, "", 0), (None, "v", "", 0)}
    assert html.extract_pages(pages.limit(0)).count() == 0


def test_pipeline_stages_keep_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).cache()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "bpe_codec"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert out.count() <= docs.count()


def test_registered():
    numbers = {n.split("_")[0] for n in queries.QUERIES}
    assert numbers == {f"op{k}" for k in range(1, 11)} | {"pipeline"}
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def _without_lines(rows, percent):
    """The texts that line dedup leaves, by brute force over all pairs of lines."""
    lines = sorted((d, n, frozenset(line.lower().strip(" \t\r").split(" "))) for d, t in rows for n, line in enumerate((t or "").split("\n")) if line.strip(" \t\r"))
    bad = {(d, n) for k, (d, n, s) in enumerate(lines) if any(len(s & p) * (100 + percent) >= (len(s) + len(p)) * percent for _, _, p in lines[:k])}
    return {d: None if t is None else "\n".join(line for n, line in enumerate(t.split("\n")) if (d, n) not in bad) for d, t in rows}


def test_pipeline_against_brute_force(spark):
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels, where=quality._fold() != 0)
    good = {r["doc_id"] for r in quality.score(docs, model).collect() if r["predicted"] == 1}
    texts = _without_lines(sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good), linededup.PERCENT)
    label = _brute_near(list(texts.items()))
    left = {i: t for i, t in texts.items() if label[i] == i}
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = spark.createDataFrame(list(left.items()), "doc_id long, text string")
    leaked = {r["doc_id"] for r in decontamination.leaks(rows, bench).collect()}
    library = Tokenizer.from_file(bpe.default_vocabulary())
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in left.items() if i not in leaked}
    got = {r["doc_id"]: r["token_ids"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and len(got) > 50


@pytest.mark.parametrize("n", [0, 3])
def test_pipeline_of_empty_and_null_tables(spark, tmp_path, n):
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, "s", 0)][:n]
    spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None), (None, 1)][: n and 2], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (None, "a b")][: n and 2], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == n and all(r["n_tokens"] == 0 for r in out)

"""Stored indexes, containment and edit distance against brute force."""

import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright import queries
from pagewright.functions.analysis import analysed, stemmed
from pagewright.functions.distance import bit_distance, edit_distance
from pagewright.operators import blocks, evaluation, search
from pagewright.operators.lexical import LexicalIndex
from pagewright.operators.vectors import VectorIndex, nearest
from pagewright.sources import views


def corpus(n=240, topics=8, seed=1):
    """Texts of a topic each, with its own words beside common ones."""
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        own = [f"t{i % topics}w{k}" for k in range(12)]
        texts.append(" ".join(rng.choice(own if rng.random() < 0.5 else ["the", "of", "and", "a", "to"]) for _ in range(rng.randrange(0, 60))))
    return texts


def brute(texts, question):
    words = [re.findall(r"\w+", t.lower()) for t in texts]
    n, average = len(texts), sum(map(len, words)) / len(texts)
    out = {}
    for term in set(re.findall(r"\w+", question.lower())):
        df = sum(term in w for w in words)
        for i, w in enumerate(words):
            if term in w:
                tf = w.count(term)
                out[i] = out.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len(w) / average))
    return {i: round(s, 9) for i, s in out.items()}


def chunks(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_id long, content string")


def asked(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "query_id long, question string")


def test_best_by_bounds_is_brute_force(spark, tmp_path):
    texts = corpus()
    # Cells of one topic, as a locality of the corpus would give them: ids are dealt by hash, so the bounds must do without.
    index = LexicalIndex.build(chunks(spark, texts), str(tmp_path / "i"), cell=2, buckets=8)
    questions = ("t3w1 t3w2 the of", "t5w0", "nowhere", "", "a a to t1w1 t2w2 t3w3", "THE")
    all_scores = {(r.query_id, r.chunk_id): pytest.approx(r.score, abs=1e-8) for r in index.scores(asked(spark, *questions)).collect()}
    want = {(q, i): s for q, text in enumerate(questions) for i, s in brute(texts, text).items()}
    assert all_scores == want
    for k in (1, 5, 400):
        best, cells = index.pruned(asked(spark, *questions), k)
        got = {(r.query_id, r["rank"]): r.chunk_id for r in best.collect()}
        ranked = {q: sorted(((-s, i) for (p, i), s in want.items() if p == q)) for q in range(len(questions))}
        assert got == {(q, rank): i for q, rows in ranked.items() for rank, (_, i) in enumerate(rows[:k], 1)}
        if k == 5:
            every = index.bounds(index._terms(asked(spark, *questions))).count()
            assert cells.count() < every  # some cells cannot matter


def test_a_question_reads_its_buckets_alone(spark, tmp_path):
    texts = corpus()
    index = LexicalIndex.build(chunks(spark, texts), str(tmp_path / "i"), buckets=32)
    plan = index.scores(asked(spark, "t3w1 t3w2"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and "In(term, [t3w1,t3w2])" in plan and "content" not in plan
    bounds = index.bounds(index._terms(asked(spark, "t3w1")))._jdf.queryExecution().executedPlan().toString()
    assert "entries" not in bounds  # bounds come from the short columns


def test_index_of_other_versions_and_of_nothing(spark, tmp_path):
    path = str(tmp_path / "i")
    with pytest.raises(FileNotFoundError):
        LexicalIndex(spark, path)
    old = LexicalIndex.build(chunks(spark, ["le chat dort"]), path)
    new = LexicalIndex.build(chunks(spark, ["le chien dort", "rien"]), path, french=True)
    assert old.number == 1 and LexicalIndex(spark, path).number == 2
    assert [r.chunk_id for r in old.top(asked(spark, "chat"), 3).collect()] == [0]
    assert [r.chunk_id for r in new.top(asked(spark, "les chiens"), 3).collect()] == [0]  # stems, and no stop words
    nothing = LexicalIndex.build(chunks(spark, ["x"]).limit(0), str(tmp_path / "e"))
    assert nothing.top(asked(spark, "x"), 3).count() == 0 and nothing.scores(asked(spark, "x")).count() == 0


# Words of one stem each.
STEMS = (
    ("cheval", "chevaux"), ("maison", "maisons"), ("national", "nationale", "nationaux", "nationales"), ("chanteur", "chanteuse", "chanteurs"),
    ("acteur", "actrice", "actrices"), ("rapide", "rapidement"), ("actif", "active", "actives", "activité"), ("forêt", "foret", "forêts"), ("premier", "première", "premiers"),
)


def test_stems(spark):
    rows = spark.createDataFrame([(i, w) for i, words in enumerate(STEMS) for w in words], "i int, w string").select("i", "w", stemmed(F.col("w")).alias("s")).collect()
    by = {i: {r.s for r in rows if r.i == i} for i in range(len(STEMS))}
    assert all(len(s) == 1 for s in by.values()), by
    assert len(set.union(*by.values())) == len(STEMS)
    got = spark.createDataFrame([("L'été des MAISONS d’Alice",)], "t string").select(analysed(F.col("t"), french=True, stems=True)).first()[0]
    assert got == ["été", "maison", "alic"]


def vectors(spark, matrix):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], "chunk_id long, embedding array<float>")


def close(matrix, question, k):
    m = np.asarray(matrix, np.float32).astype(float)
    q = np.asarray(question, np.float32).astype(float)
    length = np.sqrt((m * m).sum(axis=1))
    scores = np.round(m @ q / np.where(length > 0, length, np.inf) / np.sqrt(q @ q), 9)
    return sorted((i for i in range(len(m)) if length[i] > 0), key=lambda i: (-scores[i], i))[:k]


def test_nearest_is_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    matrix = rng.normal(size=(300, 8))
    matrix[7], matrix[50] = 0, matrix[51]  # no direction; a tie
    questions = np.vstack([matrix[51], rng.normal(size=(4, 8)), np.zeros(8)])
    q = vectors(spark, questions).withColumnRenamed("chunk_id", "query_id")
    index = VectorIndex.build(vectors(spark, matrix), str(tmp_path / "v"), cells=7)
    for found in (nearest(vectors(spark, matrix), q, 10), index.top(q, 10), index.top(q, 10, 300)):
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.chunk_id)
        assert got == {i: close(matrix, v, 10) for i, v in enumerate(questions) if v.any()}


def test_few_candidates_find_most_of_clustered_vectors(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(25, 16))
    matrix = centres[rng.integers(0, 25, 1500)] + 0.15 * rng.normal(size=(1500, 16))
    index = VectorIndex.build(vectors(spark, matrix), str(tmp_path / "v"))
    q = vectors(spark, centres[rng.integers(0, 25, 30)] + 0.15 * rng.normal(size=(30, 16))).withColumnRenamed("chunk_id", "query_id")
    assert index.candidates < 500 and index.recall(q, 15, index.candidates) >= 0.9
    plan = index.top(q.limit(1), 15, index.candidates)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*cell", plan)


def test_recall_on_the_given_vectors(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index = VectorIndex.build(e.select(F.col("vec_id").alias("chunk_id"), "embedding"), str(tmp_path / "v"))
    assert index.recall(e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 15, index.candidates) >= 0.9


def test_vectors_of_nothing(spark, tmp_path):
    none = vectors(spark, [[1.0, 0.0]]).limit(0)
    index = VectorIndex.build(none, str(tmp_path / "v"))
    q = vectors(spark, [[1.0, 0.0]]).withColumnRenamed("chunk_id", "query_id")
    assert index.top(q, 3).count() == 0 and index.top(q, 3, 5).count() == 0
    one = VectorIndex.build(vectors(spark, [[1.0, 0.0]]), str(tmp_path / "w"))
    assert one.top(q.limit(0), 3).count() == 0 and one.top(q, 3, 1).count() == 1


def test_search_from_text_to_hits(spark, tmp_path):
    pages = spark.createDataFrame([(i, i // 2, i % 2 + 1, t) for i, t in enumerate(["aa bb", "bb cc", "cc dd", "ee"])], "chunk_id long, document_id long, page_number long, content string")
    model = lambda: lambda texts: [[float(t.count(c)) for c in "abcde"] for t in texts]
    from pagewright.functions.models import embedded

    lexical = LexicalIndex.build(pages, str(tmp_path / "l"))
    stored = VectorIndex.build(embedded(pages, model, 5), str(tmp_path / "v"))
    got = search.search(lexical, stored, pages, asked(spark, "dd cc"), model, 5, top_k=2).orderBy("rank").collect()
    assert [(r.chunk_id, r.document_id, r.page_number, r.content) for r in got] == [(2, 1, 1, "cc dd"), (1, 0, 2, "bb cc")]
    with pytest.raises(ValueError):
        search.search(lexical, stored, pages, asked(spark, "x"), model, 5, top_k=51)


def test_containment_is_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["ab", "b", "abc", "ca", "é", "x1"])
    texts = ["", " ", "ab b"] + [rng.choice([" ", "\n", "  "]).join(word() for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    questions = ["", " ", "b", "ab b", "zz", "b  b", *(t[a : a + rng.randrange(1, 40)] for t in texts for a in [rng.randrange(len(t) + 1)])]
    got = evaluation.containing(
        spark.createDataFrame(list(enumerate(texts)), "page_id long, text string"), spark.createDataFrame(list(enumerate(questions)), "query_id long, question string")
    ).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == {(q, p) for q, a in enumerate(questions) for p, t in enumerate(texts) if a in t}


def by_table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_bit_distance_is_brute_force():
    rng = random.Random(6)
    for n in (0, 1, 2, 5, 40, 130):
        for _ in range(12):
            a = "".join(rng.choice("abé😀") for _ in range(rng.randrange(n + 1)))
            b = "".join(rng.choice("abé😀") for _ in range(rng.randrange(n + 1))) if rng.random() < 0.5 else a[: n // 2] + "x" + a[n // 2 + 1 :]
            assert bit_distance(a, b) == by_table(a, b)


def test_distance_of_long_texts(spark):
    rng = random.Random(7)
    long = "".join(rng.choice("abcdefgh ") for _ in range(100_000))
    near = list(long)
    for _ in range(40):
        near[rng.randrange(len(near))] = "z"
    other = "".join(rng.choice("abcdefgh ") for _ in range(100_000))
    began = time.perf_counter()
    far = bit_distance(long, other)
    assert time.perf_counter() - began < 20  # a table would take hours
    rows = spark.createDataFrame([(1, long, "".join(near)), (2, long[:3000], other[:3000]), (3, None, "a"), (4, "", "abc"), (5, long, long)], "i int, a string, b string")
    got = {r.i: r.d for r in rows.select("i", edit_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert got == {1: sum(x != y for x, y in zip(long, near)), 2: bit_distance(long[:3000], other[:3000]), 3: None, 4: 3, 5: 0}
    assert 0 < far < 100_000


def test_knn_gives_every_question_and_every_vector(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr("pagewright.operators.vectors.BLOCK", 7)  # several blocks on both sides
    monkeypatch.setattr("pyspark.sql.DataFrame.toLocalIterator", None)  # no question passes through the driver
    asked, stored = views.questions(spark, sf_dir), views.vectors(spark, sf_dir)
    got = {(r.query_id, r.chunk_id): r.score for r in queries.QUERIES["ret_knn"](spark, sf_dir).collect()}
    a, b = ({r[0]: np.array(r[1], float) for r in df.select(i, "embedding").collect()} for df, i in ((asked, "query_id"), (stored, "chunk_id")))
    want = {(q, c): float(x @ y / np.sqrt((x @ x) * (y @ y))) for q, x in a.items() for c, y in b.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    best = {(r.query_id, r["rank"]): r.chunk_id for r in nearest(stored, asked, 5).collect()}
    order = {q: sorted(b, key=lambda c: (-round(want[q, c], 9), c)) for q in a}
    assert best == {(q, k + 1): order[q][k] for q in a for k in range(5)}
    one = blocks.Best(2, 2)
    for at, scores, ids in (([0, 1, 0], [1.0, 1.0, 1.0], [5, 6, 3]), ([0, 1], [1.0, 2.0], [4, 9])):
        one.add(np.array(at), np.array(scores), np.array(ids))
    assert one.ids.tolist() == [3, 4, 9, 6] and one.floor.tolist() == [1.0, 1.0]


@pytest.mark.parametrize("k", [1, 5, 400])
def test_a_larger_batch_is_scored_in_blocks(spark, tmp_path, monkeypatch, k):
    from pagewright.operators import lexical

    monkeypatch.setattr(lexical, "FEW", 0)
    monkeypatch.setattr(lexical, "CHUNKS", 60)
    monkeypatch.setattr(lexical.LexicalIndex, "_joined", None)  # pairs of question and cell are never rows
    monkeypatch.setattr("pyspark.sql.DataFrame.toArrow", None)  # and terms don't pass through the driver
    texts = corpus() + ["t3w1 t3w2 the"] * 9
    index = LexicalIndex.build(chunks(spark, texts), str(tmp_path / "i"))
    questions = ("t3w1 t3w2 the of", "t5w0", "nowhere", "", "a a to t1w1 t2w2 t3w3", "THE", "the of t3w2 t3w1")
    want = {q: brute(texts, text) for q, text in enumerate(questions)}
    if k == 1:
        assert {(r.query_id, r.chunk_id): pytest.approx(r.score, abs=1e-8) for r in index.scores(asked(spark, *questions)).collect()} == {(q, i): s for q, rows in want.items() for i, s in rows.items()}
    got = {(r.query_id, r["rank"]): r.chunk_id for r in index.top(asked(spark, *questions), k).collect()}
    assert got == {(q, n): i for q, rows in want.items() for n, (_, i) in enumerate(sorted((-round(s, 9), i) for i, s in rows.items())[:k], 1)}


@pytest.mark.parametrize("k", [1, 5, 400])
def test_a_batch_against_texts_without_an_index(spark, monkeypatch, k):
    from pagewright.operators import lexical

    monkeypatch.setattr(lexical, "CHUNKS", 60)
    monkeypatch.setattr(lexical.LexicalIndex, "build", None)
    texts = corpus() + ["t3w1 t3w2 the"] * 9 + ["", None]
    questions = ("t3w1 t3w2 the of", "t5w0", "nowhere", "", "a a to t1w1 t2w2 t3w3", "THE", "the of t3w2 t3w1")
    want = {q: brute([t or "" for t in texts], text) for q, text in enumerate(questions)}
    got = {(r.query_id, r["rank"]): r.chunk_id for r in lexical.best(chunks(spark, texts), asked(spark, *questions), k).collect()}
    assert got == {(q, n): i for q, rows in want.items() for n, (_, i) in enumerate(sorted((-round(s, 9), i) for i, s in rows.items())[:k], 1)}


@pytest.mark.parametrize("small", [0, 100_000])
def test_a_batch_reads_texts_where_they_lie(spark, monkeypatch, small):
    from pagewright.operators import lexical

    texts = corpus() + ["t3w1 t3w2 the " * 40, "", None]
    questions = ("t3w1 t3w2 the of", "nowhere", "", "a a to t1w1 t2w2 t3w3", "t3w1 t3w2")
    rows, queries_ = chunks(spark, texts).repartition(16).localCheckpoint(), asked(spark, *questions)
    monkeypatch.setattr(lexical, "CHUNKS", 60)
    monkeypatch.setattr(lexical, "SMALL", small)
    monkeypatch.setattr(type(rows), "repartition", None)  # no shuffle of texts that lie evenly
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # a chunk's terms come in several batches
    try:
        got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in lexical.best(rows, queries_, 5).collect()}
        held = evaluation.containing(rows.withColumnsRenamed({"chunk_id": "page_id", "content": "text"}), queries_).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {q: brute([t or "" for t in texts], text) for q, text in enumerate(questions)}
    assert got == {(q, n): (i, pytest.approx(-s, abs=1e-8)) for q, found in want.items() for n, (s, i) in enumerate(sorted((-round(s, 9), i) for i, s in found.items())[:5], 1)}
    assert sorted(map(tuple, held)) == sorted((q, p) for q, a in enumerate(questions) for p, t in enumerate(texts) if t is not None and a in t)


def test_only_rows_in_a_few_partitions_are_dealt(spark):
    rows = chunks(spark, ["x"] * 400).repartition(16).localCheckpoint()
    assert blocks.spread(rows, "chunk_id") is rows
    for uneven in (rows.coalesce(2), rows.coalesce(1).union(rows.limit(0))):
        assert "Exchange hashpartitioning" in blocks.spread(uneven, "chunk_id")._jdf.queryExecution().executedPlan().toString()
    assert blocks.spread(rows.limit(0), "chunk_id").count() == 0


def test_a_block_of_chunks_by_word():
    import pandas as pd

    from pagewright.operators import lexical

    places = [(5, 4, 0), (5, 4, 7), (5, 4, 0), (5, 4, -1), (3, 0, -1)], [(5, 4, 7), (9, 300, -1)] + [(9, 300, 7)] * 300
    rows = pd.concat(lexical._counted(pd.DataFrame(p, columns=["chunk_id", "length", "word"]) for p in places))
    (one,) = lexical._gathered(rows).itertuples(index=False)
    assert one.chunk_ids.tolist() == [3, 5, 9] and one.lengths.tolist() == [0, 4, 300]
    assert one.terms.tolist() == [0, 7] and one.counts.tolist() == [1, 2]
    assert lexical._wide(one.places, 3).tolist() == [1, 1, 2] and lexical._wide(one.tfs, 3).tolist() == [2, 2, 300]


def test_a_batch_of_questions_writes_no_index(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(LexicalIndex, "build", None)
    monkeypatch.setattr(VectorIndex, "build", None)
    monkeypatch.setattr(queries, "_stored", {})
    ranks = queries.QUERIES["win_first_expected_rank"](spark, sf_dir).collect()
    assert len(ranks) == views.questions(spark, sf_dir).count() and any(r["rank"] for r in ranks)


@pytest.mark.parametrize("small", [0, 100_000])
def test_all_scores_without_an_index_or_a_shuffle_of_them(spark, monkeypatch, small):
    from pagewright.operators import lexical

    monkeypatch.setattr(lexical, "CHUNKS", 60)
    monkeypatch.setattr(lexical, "SMALL", small)
    monkeypatch.setattr(lexical, "ROWS", 100)
    monkeypatch.setattr(lexical.LexicalIndex, "build", None)
    texts = corpus() + ["t3w1 t3w2 the"] * 9 + ["", None]
    questions = ("t3w1 t3w2 the of", "t5w0", "nowhere", "", "THE", "the of t3w2 t3w1", "a a to t1w1 t2w2 t3w3")
    names = asked(spark, *questions).withColumn("query_id", F.concat(F.lit("q"), "query_id"))
    found = lexical.every(chunks(spark, texts), names)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan  # as many rows as the result has are written once
    got = found.collect()
    assert len(got) == len({(r.query_id, r.chunk_id) for r in got})
    want = {q: brute([t or "" for t in texts], text) for q, text in enumerate(questions)}
    assert {(r.query_id, r.chunk_id): pytest.approx(r.score, abs=1e-8) for r in got} == {(f"q{q}", i): s for q, rows in want.items() for i, s in rows.items()}
    assert lexical.every(chunks(spark, texts).limit(0), names).count() == 0


def test_nulls_are_as_in_an_index(spark, tmp_path):
    from pagewright.operators import lexical

    texts, questions = corpus(60) + [None] * 30, ("t3w1 t3w2 the of", "t5w0")
    index = LexicalIndex.build(chunks(spark, texts), str(tmp_path / "i"))
    want = {(r.query_id, r.chunk_id): pytest.approx(r.score, abs=1e-8) for r in index.scores(asked(spark, *questions)).collect()}
    assert want and {(r.query_id, r.chunk_id): r.score for r in lexical.every(chunks(spark, texts), asked(spark, *questions), nulls=False).collect()} == want


def test_places_over_whole_rankings(spark, sf_dir, monkeypatch):
    rng = random.Random(6)
    lex = {(q, c): rng.randrange(40) / 8 for q in range(3) for c in range(300) if rng.random() < 0.7}
    near = {(q, c): rng.randrange(40) / 8 for q in range(4) for c in range(0, 300, 3)}
    wanted = [(0, 299), (0, 0), (1, 150), (2, 7), (2, 7), (3, 298)]
    scores, shares = (lambda rows: spark.createDataFrame([(*key, s) for key, s in rows.items()], "query_id long, chunk_id long, score double")), {}
    for rows in (lex, near):
        for q in range(4):
            for place, (_, c) in enumerate(sorted((-s, c) for (p, c), s in rows.items() if p == q), 1):
                shares.setdefault((q, c), []).append(1 / (60 + place))
    order = {q: sorted((-math.floor(sum(s) * 1e9 + 0.5) / 1e9, c) for (p, c), s in shares.items() if p == q) for q in range(4)}
    want = {(q, c): (rank, (q, c) in wanted) for q, rows in order.items() for rank, (_, c) in enumerate(rows, 1) if rank <= 20 or (q, c) in wanted}
    found = search.places(scores(lex), scores(near), spark.createDataFrame(wanted, "query_id long, chunk_id long"), 20)
    assert {(r.query_id, r.chunk_id): (r["rank"], r.wanted) for r in found.collect()} == want and max(rank for rank, _ in want.values()) > 100
    monkeypatch.setattr(queries, "hits", None)  # the evaluation asks for every page's rank, not for that of the few best
    asked_ = queries.QUERIES["ret_eval_questions"](spark, sf_dir).collect()
    held = {r.query_id for r in queries.expected(spark, sf_dir).collect()}
    assert held and {r.query_id for r in asked_ if r["rank"] is not None} == held


def test_no_more_passages_than_fit(spark):
    rows = [(0, r, r, r % 10, 0, "") for r in range(1, 400)]
    hits = spark.createDataFrame(rows, "query_id long, rank int, chunk_id long, page_number long, document_id long, content string")
    assert 100 < len(search.context(hits, 4000).first().sources) <= search.passages(4000) < 160


def test_one_batch_is_the_search_over_indexes(spark, tmp_path):
    from pagewright.functions.models import embedded

    texts = corpus(80)
    pages = spark.createDataFrame([(i, i // 10, i % 10 + 1, t) for i, t in enumerate(texts)], "chunk_id long, document_id long, page_number long, content string")
    model, questions = lambda: lambda texts: [[float(t.count(c)) for c in "taw123"] for t in texts], asked(spark, "t3w1 t3w2 the of", "t5w0 t1w1", "nowhere", "")
    stored = LexicalIndex.build(pages, str(tmp_path / "l")), VectorIndex.build(embedded(pages, model, 6), str(tmp_path / "v"))
    want = search.search(*stored, pages, questions, model, 6, exact=True).collect()
    assert len(want) > 10 and sorted(map(tuple, search.one_batch(pages, questions, model, 6).collect())) == sorted(map(tuple, want))


@pytest.mark.parametrize("name", ["ret_bm25", "topk_lexical", "ret_search"])
def test_queries_over_whole_batches_write_no_index(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(LexicalIndex, "build", None)
    monkeypatch.setattr(VectorIndex, "build", None)
    monkeypatch.setattr(queries, "_stored", {})
    found = queries.QUERIES[name](spark, sf_dir)
    asked_ = views.table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id") if name == "ret_search" else views.questions(spark, sf_dir)
    assert {r.query_id for r in found.select("query_id").distinct().collect()} == {r.query_id for r in asked_.select("query_id").collect()}


@pytest.mark.parametrize("small", [0, 100_000])
def test_containment_of_few_and_of_many_questions(spark, monkeypatch, small):
    monkeypatch.setattr(evaluation, "SMALL", small)
    texts = ["one two three four five six seven", "one two three", "two", None, "x one  two three four", "aone two threeb", ""]
    questions = ["one two three", "two three four five six sev", "two", "e two t", None, "one  two", "eight"]
    got = evaluation.containing(
        spark.createDataFrame(list(enumerate(texts)), "page_id long, text string"), spark.createDataFrame(list(enumerate(questions)), "query_id long, question string")
    )
    assert sorted(map(tuple, got.collect())) == sorted((q, p) for q, a in enumerate(questions) for p, t in enumerate(texts) if a is not None and t is not None and a in t)
    shuffled_texts = got._jdf.queryExecution().executedPlan().toString().count("BatchEvalPython") + got._jdf.queryExecution().executedPlan().toString().count("MapInPandas")
    assert bool(shuffled_texts) == bool(small)  # few questions: texts are compared where they are read


def test_a_batch_of_hits_meets_the_texts_without_a_shuffle_of_them(spark):
    texts = corpus()
    chunks = spark.createDataFrame([(i, i // 10, i % 10, t) for i, t in enumerate(texts)], "chunk_id long, document_id long, page_number long, content string")
    found = spark.createDataFrame([(q, r, (q * 7 + r) % len(texts), 1.0 / r) for q in range(20) for r in range(1, 6)], "query_id long, rank int, chunk_id long, score double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = search.shown(found, chunks)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        got = {(r.query_id, r["rank"]): (r.chunk_id, r.content) for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange hashpartitioning" not in plan
    assert got == {(q, r): ((q * 7 + r) % len(texts), texts[(q * 7 + r) % len(texts)]) for q in range(20) for r in range(1, 6)}

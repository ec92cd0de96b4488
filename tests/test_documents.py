"""The document operators on literal rows."""

import json
import random
from collections import Counter
from functools import reduce

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright import queries
from pagewright.functions import edits, images
from pagewright.functions import text as T
from pagewright.functions.edits import Tracked
from pagewright.functions.models import batches, embedded, generated, transcribed
from pagewright.operators import breaks, divergence, evaluation, jobs, layout, review, search, tables
from pagewright.plans import evaluation as evaluation_run
from pagewright.plans import pipeline
from pagewright.plans import report as evaluation_report
from pagewright.sources import sinks

NBSP = " "
INVOICE = """Facture 12
| Désignation | Qté | Prix | Total |
|---|---|---|---|
| papier | 2 | 28,90 | 57,80 |
| encre | 3 | 10,00 | 40,00 |
| colle | 1 | 1 234,56 | 1 234,56 |
| vide | | 1,00 | 1,00 |
| court | 2 |

| Total HT | 1 332,36 |
| Total TTC | 1 598,83 |
texte [illisible] et �� fin"""


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_numbers(spark):
    cells = {"28,90": "28.90", f"1{NBSP}234,56": "1234.56", "1.234,56": "1234.56", "1,234.56": "1234.56", "1.234.567": "1234567", "173,40 €": "173.40", "4.50": "4.50", "-3": "-3", "-": None, "6 cartouches": None, "": None, "Désignation": None, "1,2,3": "123"}
    rows = spark.createDataFrame([(k,) for k in cells], "t string").select("t", T.parse_number(F.col("t")).alias("n")).collect()
    assert {r.t: None if r.n is None else float(r.n) for r in rows} == {k: None if v is None else float(v) for k, v in cells.items()}


def test_number_tokens(spark):
    got = one(spark, T.number_tokens(F.col("t")), t=f"lots 6 et 28, I70, 2.250.000, 70/2.000, 28,90 II IO 1{NBSP}234 12 345 6 78")
    assert got == ["6", "28", "170", "2250000", "70/2000", "28,90", "1234", "12345", "6", "78"]


def test_fractions(spark):
    got = one(spark, T.fractions(F.col("t"), F.lit(1000)), t="250/1000 puis I50 / 1.000 et 3/100 et 600/1 000 7/10000")
    assert got == [250, 150, 600]


def test_text_functions(spark):
    assert one(spark, T.ustrip(F.col("t")), t=f"{NBSP}\n a b  ") == "a b"
    assert one(spark, T.layout_normalised(F.col("t")), t="exis-\n tence  --- et\tfin ") == "existence et fin"
    assert one(spark, T.first_accepted(F.col("t"), F.array(F.lit("8 000"), F.lit("7.700.000"))), t="Soit 7 700 000 francs") == "7.700.000"
    assert one(spark, T.unfenced(F.col("t")), t="```markdown\na\nb\n```") == "a\nb"
    assert one(spark, T.unfenced(F.col("t")), t="x ```a``` y") == "x ```a``` y"
    assert [one(spark, T.score_label(F.lit(x).cast("double"))) for x in (0.5, None)] == ["0,50", "—"]
    assert one(spark, T.html_escaped(F.col("t")), t="<a & 'b'>") == "&lt;a &amp; &#x27;b&#x27;&gt;"
    names = ["page10.png", "Page2.png", "page1.png", "a.png"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(T.natural_key(F.col("n"))).collect()
    assert [r.n for r in rows] == ["a.png", "page1.png", "Page2.png", "page10.png"]
    assert T.prompt_budget(8192, 512) == 13824
    got = one(spark, T.match_offsets(F.col("t"), "[0-9]+"), t="a😀12b3")
    assert [(m.start, m.end, m["match"]) for m in got] == [(2, 4, "12"), (5, 6, "3")]
    assert one(spark, T.select_index(F.array(F.lit("a"), F.lit("b")), F.lit("b"))) == 1 and one(spark, T.select_index(F.array(F.lit("a")), F.lit("z"))) == 0


def test_invoice_checks(spark):
    page = spark.createDataFrame([("p", INVOICE), ("q", "no table")], "page_id string, text string")
    rows = {INVOICE[r.row_start : r.row_end]: r for r in tables.table_rows(page).collect()}
    assert len(rows) == 7 and all(INVOICE[c.start : c.end] == c.text for r in rows.values() for c in r.cells)
    assert all(k.startswith("|") and k.endswith("|") for k in rows)
    found = {(INVOICE[b.start_offset : b.end_offset].split("|")[1].strip() if "|" in INVOICE[b.start_offset : b.end_offset] else INVOICE[b.start_offset : b.end_offset], b.score, b.method) for b in tables.analysed_pages(page).collect()}
    assert found == {("encre", 0.15, "arithmetic"), ("vide", 0.4, "structural"), ("court", 0.4, "structural"), ("[illisible]", 0.2, "structural"), ("��", 0.3, "structural")}
    wrong = page.withColumn("text", F.replace("text", F.lit("1 332,36"), F.lit("9 999,99")))
    assert tables.sum_blocks(tables.with_numbers(tables.table_rows(wrong))).count() == 2
    assert {r.page_id: r.score for r in tables.page_blocks(page).collect()} == {"p": 0.15, "q": 1.0}


def test_divergence():
    first = "Échéance : 30 jours\nTotal 28,90\nfin\n"
    assert divergence.divergences(first, "Échéance: 30 jours\nTotal 28,90\nfin") == []
    (block,) = divergence.divergences(first, "Échéance : 30 jours\nTotal 28,60\nfin\n")
    assert first[block["start_offset"] : block["end_offset"]] == "Total 28,90" and block["score"] == 0.2
    assert divergence.divergences("a\nb\n", "a\nx new line\nb\n") == []


def test_divergence_gate(spark):
    pairs = spark.createDataFrame([(1, "a\nb", "a\nc", 0.4), (2, "a\nb", "a\nc", 0.5)], "page_id int, first string, second string, score double")
    got = divergence.compared(pairs, below=0.5).collect()
    assert [r.page_id for r in got] == [1] and got[0].blocks[0].method == "double_pass"


def test_edits():
    t = Tracked("hello big world").edited([(5, 9, ""), (10, 10, "_"), (14, 15, "D!")])
    assert t.text == "hello _worlD!" and t.map[0] == 0 and t.map[7] == 5 and t.map[10] == 7 and t.map[15] == 13
    later = t.then(Tracked(t.text).edited([(0, 1, "")]))
    assert later.text == "ello _worlD!" and later.span(1, 5) == (0, 4)
    for bad in ([(0, 3, ""), (2, 4, "")], [(0, 99, "")], [(-1, 1, "")]):
        with pytest.raises(ValueError):
            Tracked("hello").edited(bad)


def laid(*texts, known=(), locked=()):
    return {p.number: p for p in layout.laid_out([(i, t, i not in locked) for i, t in enumerate(texts, 1)], known)}


def test_edit_columns_are_tracked_edits(spark):
    rng, rows = random.Random(13), []
    for k in range(120):
        text, at, own = "".join(rng.choice("abé😀\n") for _ in range(rng.randrange(0, 30))), 0, []
        while at <= len(text) and rng.random() < 0.8:
            start = rng.randrange(at, len(text) + 1)
            end = rng.randrange(start, min(len(text), start + 5) + 1)
            if own and (start, end) == own[-1][:2]:
                break
            own.append((start, end, rng.choice(["", "x", "yy", "😀"])))
            at = end
        rng.shuffle(own)
        rows.append((k, text, own))
    kind = "array<struct<start:int,end:int,replacement:string>>"
    df = spark.createDataFrame(rows, f"k int, text string, edits {kind}").withColumn("edits", edits.ordered(F.col("edits"), F.col("text")))
    places = F.transform(F.sequence(F.lit(0), F.char_length("text")), lambda p: edits.moved(p, F.col("edits")))
    for r in df.select("k", edits.rewritten(F.col("text"), F.col("edits")).alias("text"), places.alias("map")).collect():
        want = Tracked(rows[r.k][1]).edited(rows[r.k][2])
        assert (r.text, r.map) == (want.text, want.map)
    for bad in ([(0, 3, ""), (2, 4, "")], [(0, 99, "")]):
        with pytest.raises(Exception, match="overlaps"):
            spark.createDataFrame([("hello", bad)], f"text string, edits {kind}").select(edits.ordered(F.col("edits"), F.col("text"))).collect()


def test_layout_rules():
    assert laid("Le contrat-\nne contenait pas, ne dit rien au contrat.")[1].text == "Le contrat ne contenait pas, ne dit rien au contrat."
    assert laid("Une exis-\ntence longue")[1].text == "Une existence longue"
    assert laid("page vingt-\nsept du livre")[1].text == "page vingt-sept du livre"
    assert laid("mil neuf-- cent et vingt--trois")[1].text == "mil neuf cent et vingt-trois"
    assert laid("un,deux et 28,90")[1].text == "un, deux et 28,90"
    assert laid("```markdown\nLe texte.")[1].text == "Le texte."
    assert laid("Première phrase.\nDeuxième phrase.")[1].text == "Première phrase.\n\nDeuxième phrase."
    assert laid("TITRE\nsuite du texte")[1].text == "TITRE\n\nsuite du texte"
    assert laid("| a | b |\n| c | d |")[1].text == "| a | b |\n| c | d |"
    doubt = laid("il fut ma-\nrisés dit ma tante")[1]
    assert doubt.text[slice(*doubt.doubts[0])] == "ma-\nrisés"


def test_layout_over_pages():
    pages = laid("-3-\nLe début du long con-", "trat, signé ici.\n-4-", "-5-\nAutre texte.")
    assert [pages[i].text for i in (1, 2, 3)] == ["Le début du long contrat,", "signé ici.", "Autre texte."]
    assert set(laid("Le début con-", "trat signé.", locked=(2,))) == {1}
    with pytest.raises(ValueError, match="page 2"):
        layout.check_content([(1, "ab"), (2, "cd")], [(1, "ab"), (2, "xd")])


def test_layout_positions(spark):
    rows = spark.createDataFrame([("d", 1, "Une exis-\ntence  longue", True)], "document_id string, page_number int, text string, editable boolean")
    (got,) = layout.normalised(rows).collect()
    assert got.text == "Une existence longue" and len(got.positions) == 24 and got.text[got.positions[4] : got.positions[15]] == "existence"


REV = "page_id int, document_id int, page_number int, revision int, origin string, content string, is_validated boolean, bulk_validated boolean"


def revisions(spark):
    return spark.createDataFrame(
        [
            (1, 1, 1, 1, "ocr", "a1", False, False), (1, 1, 1, 2, "human", "a2", True, False), (1, 1, 1, 3, "human", "a3", False, False),
            (2, 1, 2, 1, "ocr", "b1", False, False), (2, 1, 2, 2, "normalized", "b2", False, False),
            (3, 2, 1, 1, "human", " c1 ", True, True), (5, 3, 1, 1, "human", "e1", False, False),
        ], REV,
    )


def test_review(spark):
    rows = revisions(spark)
    pages = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 2, 1), (4, 2, 2), (5, 3, 1)], "page_id int, document_id int, page_number int")
    blocks = spark.createDataFrame([(2, 2, 0.3), (2, 1, 0.1), (1, 3, -2.0)], "page_id int, revision int, score double")
    now = review.page_summaries(pages, rows, blocks)
    assert {r.page_id: (r.state, r.score, r.bulk_validated) for r in now.collect()} == {1: ("validated", 0.0, False), 2: ("to_review", 0.3, False), 3: ("validated", 1.0, True), 4: ("untranscribed", None, False), 5: ("draft", 1.0, False)}
    assert {r.page_id: r.content for r in review.latest_validated(rows).collect()} == {1: "a2", 3: " c1 "}
    assert {r.page_id: (r.content, r.origin) for r in review.machine_reading(rows).collect()} == {1: ("a1", "ocr"), 2: ("b2", "normalized")}
    assert {r.page_id: r.next_revision for r in review.next_revision(pages, rows).collect()} == {1: 4, 2: 3, 3: 2, 4: 1, 5: 2}
    assert [r.page_id for r in review.gallery(now, "alerts").orderBy("page_id").collect()] == [1, 2]
    with pytest.raises(ValueError):
        review.gallery(now, "other")
    assert {r.page_id: r.next_to_review for r in review.next_to_review(now).collect()} == {1: 2, 2: None, 3: 4, 4: None, 5: None}
    new = review.bulk_approved(rows)
    assert {(r.page_id, r.revision, r.origin, r.bulk_validated) for r in new.collect()} == {(2, 3, "human", True), (5, 2, "human", True)}
    assert review.appended(rows, new).count() == 9
    with pytest.raises(ValueError):
        review.appended(rows, rows)
    shown = spark.createDataFrame([(1, 1, 3), (1, 2, 1), (2, 3, 1), (2, 4, 0), (3, 6, 1)], "document_id int, page_id int, revision int")
    assert {r.document_id: r.conflict for r in review.conflicts(shown, now).collect()} == {1: 3, 2: 2, 3: 1}
    assert [(r.chunk_id, r.content) for r in review.chunks(pages, rows).orderBy("chunk_id").collect()] == [("1:1", "a2"), ("2:1", "c1")]
    assert review.collected_chunks(pages, rows).count() == 0
    typed = spark.createDataFrame([(1, "typed")], "page_id int, content string")
    reread = spark.createDataFrame([(1, "other"), (2, f" {NBSP}"), (3, "re")], "page_id int, content string")
    assert {r.page_id: (r.content, r.reference_origin) for r in review.references(typed, reread).collect()} == {1: ("typed", "typed"), 3: ("re", "reread")}


def test_jobs(spark):
    log = spark.createDataFrame([(1, 1, "preprocess", "done", "2024-01-01"), (2, 1, "transcribe", "failed", "2024-01-02"), (3, 2, "transcribe", "running", "2024-01-01"), (4, 3, "index", "failed", "2024-01-01")], "job_id int, document_id int, kind string, status string, created_at string")
    docs = spark.createDataFrame([(1, "failed"), (2, "preprocessed"), (3, "failed"), (4, "preprocessed")], "document_id int, status string")
    assert {r.document_id: r.verdict for r in jobs.ocr_admission(docs, log).collect()} == {1: "admitted", 2: "already running", 3: "refused", 4: "admitted"}
    assert sorted(r.document_id for r in jobs.deletable(docs, log).collect()) == [1, 3, 4]
    events = spark.createDataFrame([(1, "failed", "e", 2, 1), (1, "done", None, 3, 2)], "job_id int, status string, error string, at int, seq int")
    assert {r.job_id: r.status for r in jobs.state_events(log, events).collect()}[1] == "done"


def test_search(spark):
    chunks = spark.createDataFrame([("1:1", "1", 1, "le chat dort"), ("1:2", "1", 2, "le chien dort bien"), ("2:1", "2", 1, "rien")], "chunk_id string, document_id string, page_number int, content string")
    vectors = spark.createDataFrame([("1:1", [1.0, 0.0]), ("1:2", [0.0, 1.0]), ("2:1", [1.0, 1.0])], "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([("q", "chien", [1.0, 0.1])], "query_id string, question string, embedding array<float>")
    hits = search.hybrid(chunks, vectors, q, 3).orderBy("rank").collect()
    assert [h.chunk_id for h in hits] == ["1:2", "1:1", "2:1"] and hits[0].score == pytest.approx(1 / 61 + 1 / 63, abs=1e-8)
    with pytest.raises(ValueError):
        search.hybrid(chunks, vectors, q, 51)
    rows = search.hybrid(chunks, vectors, q, 3)
    full = search.context(rows, 10_000).first()
    assert full.context.startswith("[1] page 2 du document 1\nle chien dort bien\n\n[2] page 1") and len(full.sources) == 3
    assert search.context(rows, 60).first().sources == ["1:2"]
    long = rows.withColumn("content", F.repeat("content", 20))
    cut = search.context(long, 100).first()
    assert len(cut.context) == 100 and cut.context.endswith("du modèle]")
    none = spark.createDataFrame([("z", "?")], "query_id string, question string")
    assert search.prompts(none, search.context(rows, 100), "r").first().fixed_answer
    assert one(spark, search.analysed(F.col("t"), french=True), t="L'été de la maison d’Alice") == ["été", "maison", "alice"]


def test_evaluation(spark):
    pairs = spark.createDataFrame([(1, "abcd 28,90", "abxd 28,60"), (2, "", "x"), (3, "12 12 7", "12 7 7")], "page_id int, reference string, hypothesis string")
    got = {r.page_id: r.cer for r in evaluation.cer(pairs).collect()}
    assert got == {1: 0.2, 2: None, 3: pytest.approx(2 / 7)}
    acc = {r.page_id: (r.expected, r.read, r.correct) for r in evaluation.number_accuracy(pairs).collect()}
    assert acc == {1: (1, 1, 0), 2: (0, 0, 0), 3: (3, 3, 2)}
    assert evaluation.number_rates(evaluation.number_accuracy(pairs.filter("page_id = 2"))).first().recall is None
    controls = spark.createDataFrame([("t", 1, 3, 1000)], "control string, first_page int, last_page int, denominator bigint")
    declared = spark.createDataFrame([("t", 0, "a", 2, 1000), ("t", 1, "b", 0, 0), ("t", 2, "c", 2, 1000)], "control string, segment bigint, name string, lots bigint, total bigint")
    pages = [(1, "10/1000 990/1000 1000/1000 1000/1000"), (2, "400/1000"), (3, "600/1000")]
    make = lambda p: spark.createDataFrame(p, "page_number int, text string")
    seen = {r.name: (r.lots_read, r.total_read, r.closed, r.passed) for r in evaluation.table_controls(make(pages), controls, declared).collect()}
    assert seen == {"a": (2, 1000, True, True), "b": (0, 0, True, True), "c": (2, 1000, False, False)}
    assert all(r.missing_pages == [2] and not r.passed for r in evaluation.table_controls(make([pages[0], pages[2]]), controls, declared).collect())
    expected = spark.createDataFrame([("n", 1, 0, "28,90"), ("n", 1, 1, "28,90"), ("m", 9, 0, "5")], "control string, page_id int, position int, value string")
    text = spark.createDataFrame([(1, "28,90 et 3")], "page_id int, text string")
    done = {r.control: (r.found, r.missing, r.page_missing, r.passed) for r in evaluation.expected_number_controls(expected, text).collect()}
    assert done == {"n": (["28,90"], ["28,90"], False, False), "m": ([], ["5"], True, False)}
    ranks = spark.createDataFrame([("a", 1), ("b", 4), ("c", None)], "query_id string, rank int")
    assert {r.k: round(r.recall, 3) for r in evaluation.recall_at(ranks).collect()} == {1: 0.333, 3: 0.333, 5: 0.667, 10: 0.667}
    with pytest.raises(Exception, match="no question"):
        evaluation.recall_at(ranks.limit(0)).collect()
    report = evaluation.report({"recall": ranks.agg(F.count("rank").alias("n"))}).first()
    assert report.json == '{"recall":{"n":2}}'


def test_models(spark):
    assert batches(list(range(5)), 2, lambda x: x) == list(range(5))
    with pytest.raises(ValueError):
        batches([1, 2], 2, lambda x: x[:1])
    texts = spark.createDataFrame([(1, "abc"), (2, "de")], "id int, content string")
    got = embedded(texts, lambda: lambda b: [[len(t), 1] for t in b], 2).orderBy("id").collect()
    assert [r.embedding for r in got] == [[3.0, 1.0], [2.0, 1.0]]
    with pytest.raises(Exception, match="not 3"):
        embedded(texts, lambda: lambda b: [[1, 1] for _ in b], 3).collect()
    assert transcribed(texts, lambda: lambda b: ["```\nx\n```"] * len(b)).first().content_markdown == "x"
    prompts = spark.createDataFrame([(1, "p"), (2, None)], "id int, prompt string")
    assert {r.id: r.answer for r in generated(prompts, lambda: lambda b: ["ok"] * len(b), 10).collect()} == {1: "ok", 2: None}
    with pytest.raises(Exception, match="longer than the context"):
        generated(prompts, lambda: lambda b: ["ok"] * len(b), 0).collect()


def striped(angle):
    page = np.full((400, 300), 255, np.uint8)
    for y in range(40, 360, 20):
        page[y : y + 6, 30:270] = 0
    return images.rotated(page, -angle)


def test_images(spark):
    assert images.gray(np.dstack([np.full((2, 2), v, np.uint8) for v in (0, 255, 0)])).tolist() == [[150, 150], [150, 150]]
    assert images.downscaled(np.zeros((400, 200), np.uint8), 100).shape == (100, 50) and images.downscaled(np.zeros((4, 2), np.uint8), 100).shape == (4, 2)
    assert images.skew(np.full((300, 300), 255, np.uint8)) == 0.0
    for angle in (-4.0, 0.0, 3.0):
        page = striped(angle)
        tilt = images.skew(page)
        assert abs(abs(tilt) - abs(angle)) <= 0.5
        assert abs(images.skew(images.rotated(page, tilt))) <= 0.5
    with pytest.raises(ValueError):
        images.contrasted(striped(0), "other")
    assert set(np.unique(images.contrasted(striped(0), "adaptive_threshold"))) <= {0, 255} and images.contrasted(striped(0), "clahe").shape == (400, 300)
    page = striped(0)
    rows = spark.createDataFrame([(400, 300, 1, bytearray(page.tobytes()))], "height int, width int, nChannels int, data binary")
    got = images.preprocessed_images(rows, max_edge=200).first().page
    assert (got.height, got.width) == (200, 150) and got.steps == ["gray", "denoise", "downscale", "clahe"] and got.pixel_ratio == 0.25


def test_pipeline_resumes(spark):
    models = pipeline.Models(lambda: lambda b: [f"texte {len(x)} exis-\ntence" for x in b], lambda: lambda b: [[1.0, 0.0]] * len(b), 2)
    pages = spark.createDataFrame([(1, 1, 1, bytearray(b"abc")), (2, 1, 2, bytearray(b"de"))], "page_id int, document_id int, page_number int, content binary")
    none = spark.createDataFrame([], "page_id int, revision int, origin string, content string, is_validated boolean")
    first = pipeline.transcribe(pages, none, models).withColumn("is_validated", F.lit(False))
    done = none.unionByName(first.select(none.columns))
    assert done.count() == 2 and pipeline.transcribe(pages, done, models).count() == 0
    new = pipeline.normalise(pages.drop("content"), done)
    assert {(r.page_id, r.revision, r.content) for r in new.collect()} == {(1, 2, "texte 3 existence"), (2, 2, "texte 2 existence")}
    final = done.unionByName(new.withColumn("is_validated", F.col("page_id") > 0).select(none.columns))
    assert {r.chunk_id: r.embedding for r in pipeline.index(pages.drop("content"), final, models).collect()} == {"1:1": [1.0, 0.0], "1:2": [1.0, 0.0]}


def test_number_multiset_is_brute_force(spark, sf_dir):
    import re
    from collections import Counter

    pattern = re.compile(r"[0-9I](?:[0-9IO]|[.,/](?=[0-9IO])|[ \u00a0\u202f](?=[0-9IO]{3}(?![0-9IO])))*")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(10**6, "I70 1 234 567,5 2.250.000 70/2.000 12 34 IO 1\u202f000"), (10**6 + 1, "II I O"), (10**6 + 2, "")]
    got = {(r.page_id, r.token): r.n for r in evaluation.number_counts(spark.createDataFrame(rows, "page_id long, text string")).collect()}
    plain = str.maketrans("IO", "10", ". \u00a0\u202f")
    want = Counter((d, t.translate(plain)) for d, text in rows for t in pattern.findall(text or "") if re.search("[0-9]", t))
    assert got == want and got[10**6, "1234567,5"] == 1


def test_character_errors_are_brute_force(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, above = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != y)))
        return row[-1]

    pairs = [(0, "Échéance ñandú", "Echéance nandu"), (1, "", "abc"), (2, "großes Maß", "grosses Mass"), (3, "même", "même")]
    got = {r.page_id: r for r in evaluation.cer(spark.createDataFrame(pairs, "page_id long, reference string, hypothesis string")).collect()}
    assert {k: (r.distance, r.length) for k, r in got.items()} == {k: (distance(a, b), len(a)) for k, a, b in pairs} and got[1].cer is None


def test_context_budget_of_each_query(spark):
    budget = T.context_budget(100, "rules", F.col("q"))
    assert one(spark, budget, q="x" * 50) == 41
    with pytest.raises(Exception, match="no room"):
        one(spark, budget, q="x" * 91)
    rows = [(1, 1, "a", 1, "d", "p" * 50, 40), (1, 2, "b", 2, "d", "q" * 50, 40), (2, 1, "a", 1, "d", "p" * 50, 400), (2, 2, "b", 2, "d", "q" * 50, 400)]
    hits = spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, page_number int, document_id string, content string, budget int")
    got = {r.query_id: r for r in search.context(hits, F.col("budget")).collect()}
    assert got[1].sources == ["a"] and got[2].sources == ["a", "b"] and T.transcription_timeout(1.5) == 600


def test_thumbnails(spark):
    page = np.dstack([striped(0)] * 3)
    rows = spark.createDataFrame([(400, 300, 3, bytearray(page.tobytes())), (20, 30, 1, bytearray(bytes(600)))], "height int, width int, nChannels int, data binary")
    got = images.thumbnails(rows, 100).collect()
    sizes = [(int.from_bytes(r.thumbnail[16:20]), int.from_bytes(r.thumbnail[20:24]), r.thumbnail[25]) for r in got]
    assert sizes == [(100, 133, 2), (30, 20, 0)]
    with pytest.raises(ValueError):
        images.thumbnails(rows, 32)
    wide = np.zeros((10, 700, 3), np.uint8)
    assert images.thumbnail(wide, 240).shape == (3, 240, 3)


def test_thumbnail_files_can_be_read(spark, tmp_path):
    page = np.dstack([np.full((40, 300), v, np.uint8) for v in (10, 120, 250)])
    (tmp_path / "page.png").write_bytes(images.png(page))
    got = spark.read.format("image").load(str(tmp_path)).select("image.*").first()
    assert (got.height, got.width, got.nChannels) == (40, 300, 3) and bytes(got.data) == page.tobytes()


def test_enqueued(spark):
    documents = spark.createDataFrame([(1, "new"), (2, "new"), (3, "validated"), (4, "preprocessed"), (5, "indexed")], "document_id int, status string")
    log = spark.createDataFrame([("a", 2, "preprocess", "running"), ("b", 5, "index", "done")], "job_id string, document_id int, kind string, status string").withColumn("created_at", F.current_timestamp())
    at = F.to_timestamp(F.lit("2026-01-01"))
    ids = lambda kind: sorted(r.document_id for r in jobs.enqueued(documents, log, kind, at).collect())
    assert (ids("preprocess"), ids("transcribe"), ids("index")) == ([1], [4], [3, 5])


def test_normalisation_carries_second_pass_blocks(spark):
    block = "array<struct<start_offset:int,end_offset:int,score:double,method:string>>"
    text = "un mot cou-\npé ici"
    rows = [(1, 1, "ocr", text, [(15, 18, 0.2, "double_pass"), (3, 6, 0.3, "structural"), (15, 900, 0.1, "double_pass")]), (2, 1, "human", "rien", [])]
    revisions = spark.createDataFrame(rows, f"page_id int, revision int, origin string, content string, blocks {block}")
    pages = spark.createDataFrame([(1, 7, 1), (2, 7, 2)], "page_id int, document_id int, page_number int")
    known = spark.createDataFrame([(7, "coupé")], "document_id int, text string")
    (got,) = pipeline.normalise(pages, revisions, known).collect()
    assert (got.page_id, got.revision, got.content) == (1, 2, "un mot coupé ici")
    assert sorted((got.content[b.start_offset : b.end_offset], b.score) for b in got.blocks if b.method == "double_pass") == [("ici", 0.1), ("ici", 0.2)]
    documents = spark.createDataFrame([(7, "indexed"), (8, "transcribing")], "document_id int, status string")
    assert pipeline.normalise_document(documents, pages, revisions, 7, known).count() == 1
    with pytest.raises(ValueError):
        pipeline.normalise_document(documents, pages, revisions, 8)
    with pytest.raises(LookupError):
        pipeline.normalise_document(documents, pages, revisions, 9)


def test_drive():
    seen = iter(["new", "preprocessing", "preprocessed", "transcribing", "awaiting_validation"])
    launched = []
    assert evaluation_run.driven(lambda: next(seen), lambda: launched.append(1), 9, 9, 0) == "awaiting_validation" and launched == [1]
    assert evaluation_run.driven(lambda: "indexed", lambda: launched.append(1), 9, 9, 0) == "indexed" and launched == [1]
    with pytest.raises(RuntimeError):
        evaluation_run.awaited(lambda: "failed", {"indexed"}, 9, 0)
    with pytest.raises(TimeoutError):
        evaluation_run.awaited(lambda: "transcribing", {"indexed"}, 0.05, 0.01)


def test_evaluation_index_and_report(spark, tmp_path):
    models = pipeline.Models(lambda: lambda b: b, lambda: lambda b: [[1.0, 0.0]] * len(b), 2)
    pages = spark.createDataFrame([(1, 7, 1), (2, 7, 2)], "page_id int, document_id int, page_number int")
    revisions = spark.createDataFrame([(1, 1, "ocr", "brut"), (1, 2, "normalized", "lu"), (1, 3, "human", "corrigé"), (2, 1, "human", "saisi")], "page_id int, revision int, origin string, content string")
    index = str(tmp_path / "chunks")
    for _ in range(2):
        assert evaluation_run.build_index(spark, index, "fonds", pages, revisions, models) == 1
    assert [(r.chunk_id, r.content) for r in sinks.read_index(spark, evaluation_run.index_path(index, "fonds")).collect()] == [("7:1", "lu")]

    measured = spark.createDataFrame([(1, "typed", 1, 10, 0.1, 2, 2, 1), (2, "reread", 0, 30, 0.0, 0, 0, 0)], "page_number int, reference_origin string, distance int, length int, cer double, expected int, read int, correct int")
    tables_ = spark.createDataFrame([("lots", 0, "A", 2, 10, 2, 10, True, [], True), ("lots", 1, "B", 1, 5, 0, 0, False, [3], False)], "control string, segment int, name string, lots int, total int, lots_read int, total_read int, closed boolean, missing_pages array<int>, passed boolean")
    numbers = spark.createDataFrame([("prix", 1, ["12"], ["7", "8"], False, False)], "control string, page_id int, found array<string>, missing array<string>, page_missing boolean, passed boolean")
    asked = spark.createDataFrame([("q1", 1, [1, 2], "dix", "10"), ("q2", None, [2], None, None)], "query_id string, rank int, pages array<int>, answer string, found string")
    report = evaluation_run.markdown(spark, "fonds", 3, [3], {"modele": "m"}, {"ocr": 12.4}, measured, [3], tables_, numbers, asked)
    assert report.split("\n") == [
        "# Évaluation — fonds", "", "- modele : m", "- Pages transcrites : 2/3 (non transcrites : [3])", "- Durée ocr : 12 s", "",
        "## Transcription", "", "- Taux d'erreur par caractère : 2.5% sur 2 page(s) de référence", "  - saisies : 10.0% sur 1 page(s)",
        "  - relectures : 0.0% sur 1 page(s) — un minimum : la relecture part du texte de l'OCR",
        "- Nombres : 1 justes sur 2 attendus (rappel 50.0%, précision 50.0%)", "- Références sans transcription : [3]", "",
        "| Page | Origine | Taux d'erreur | Nombres justes |", "|---|---|---|---|", "| 1 | saisie | 10.0% | 1/2 |", "| 2 | relecture | 0.0% | 0/0 |", "",
        "## Contrôles objectifs (1/3)", "", "- ✓ lots — A : 2/2 lots, somme 10/10, ligne de total lue",
        "- ✗ lots — B : 0/1 lots, somme 0/5, ligne de total absente, pages non transcrites [3]", "- ✗ prix (page 1) : 1 trouvés, manquants ['7', '8']", "",
        "## Recherche", "", "- Rappel (2 questions) : @1 50.0%, @3 50.0%, @5 50.0%, @10 50.0%", "- Réponses exactes : 100.0%", "",
        "| | Question | Rang | Pages retrouvées | Valeur trouvée |", "|---|---|---|---|---|", "| ✓ | q1 | 1 | [1, 2] | 10 |", "| ✗ | q2 | — | [2] | — |", "",
    ]
    # The corpus' own order, and the same row as JSON.
    listed = [x.withColumn("declared_at", F.when(F.col(k) == v, 9).otherwise(1)) for x, k, v in ((tables_, "name", "A"), (numbers, "control", ""), (asked, "query_id", "q1"))]
    row = evaluation_report.report(spark, "fonds", 3, [3], {"modele": "m"}, {"ocr": 12.4}, measured, [3], *listed).first()
    whole = json.loads(row.json)
    assert [t["nom"] for t in whole["controles"]["tables"]] == ["B", "A"] and [q["id"] for q in whole["recherche"]["detail"]] == ["q2", "q1"]
    assert list(whole)[:4] == ["corpus", "pages", "pages_non_transcrites", "configuration"] and whole["transcription"]["nombres"] == {"attendus": 2, "lus": 2, "justes": 1, "rappel": 0.5, "precision": 0.5}
    assert whole["transcription"]["cer_par_origine"] == {"saisie": 0.1, "relecture": 0.0} and whole["recherche"]["detail"][0]["rang"] is None and whole["recherche"]["rappel_a_1"] == 0.5
    assert "- ✗ lots — B" in evaluation_report.rendered(row).split("\n- ✓ lots — A")[0]
    empty = evaluation_run.markdown(spark, "vide", 1, [1], {}, {}, measured.limit(0), [], tables_.limit(0), numbers.limit(0), asked.limit(0))
    assert "non mesuré (ni page saisie" in empty and "(0/0)" in empty and "aucune question" in empty


def test_breaks_are_those_of_the_layout(spark):
    """Lexicon, votes and kinds of breaks by joins, against the rules that lay a document out."""
    rng = random.Random(11)
    words = ["mai", "son", "maison", "quarante", "et", "un", "Le", "AB", "porte", "-", "--", "chef", "lieu", "chef-lieu", "a-t-il", ",", "é"]
    pages = []
    for document in range(6):
        for number in range(1, 6):
            text = "".join(rng.choice(words) + rng.choice([" ", " ", "-\n", " -\n", "\n", ".", "", "\n\n"]) for _ in range(rng.randrange(1, 90)))
            text = rng.choice(["- %d -\n" % (number + 3), "", "OI\n"]) + text + rng.choice(["\n%d" % (number + 4), "", " "])
            pages.append((document, number, text))
    df = spark.createDataFrame(pages, "document_id int, page_number int, text string").repartition(3)
    found = {d: set() for d in range(6)}
    for r in breaks.lexicon(df).collect():
        found[r.document_id].add(r.word)
    offsets = {r.document_id: (r.lag, r.votes) for r in breaks.page_offsets(df).collect()}
    for document in range(6):
        own = [layout.Page(n, t, True) for d, n, t in pages if d == document]
        lexicon = layout.Lexicon()
        for page in own:
            lexicon.read(page.live, is_page=True)
        assert found[document] == lexicon
        votes = Counter(lag for p in own for lag in dict.fromkeys(p.number - n for n in map(layout.printed_number, p.edges()) if n is not None))
        assert offsets.get(document) == (votes.most_common(1)[0] if votes else None)
    seen = breaks.line_breaks(df).unionByName(breaks.page_breaks(df))
    judged = breaks.judged_breaks(seen, breaks.lexicon(df)).collect()
    assert len(judged) == seen.distinct().count() > 50
    for r in judged:
        assert r.kind == layout.judged(r.left, r.apart, r.right, found[r.document_id])
    assert {r.kind for r in judged} == {layout.FILLER, layout.CUT, layout.JOINED, layout.DOUBT}


def test_accepted_values_and_their_sql_follow_one_rule(spark, tmp_path):
    texts = ["Under\nthe bridge", "pont  de   bois", "all the way de la", "1 2.3 4 de ", "x\x0bDE\x85y", "none\u200bde ", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: r.accepted for r in queries.QUERIES["fn_answer_contains"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    assert got == dict(con.sql(queries.SQL["fn_answer_contains"]).fetchall())
    assert got == {0: " the ", 1: " de ", 2: " the ", 3: " de ", 4: " de ", 5: None, 6: None, 7: None}


def test_coarse_tokens_lay_out_as_fine_ones_do(monkeypatch):
    import random

    rng, between = random.Random(3), [" "] * 9 + ["\n", "\n\n", "-\n", " - ", "--", "\t", ",", "  ", " -\n", "- ", "\n- ", ",\n", "-\n\n", " , ", "|", "\n| ", "-,", "```\n", "\n12\n", "\x0b", ". "]
    word = lambda: rng.choice(["deux", "Trois", "mai", "son", "maison", "vingt", "A", "12", "été"])
    documents = [[(n, "".join(word() + rng.choice(between) for _ in range(rng.randrange(0, 60))), rng.random() < 0.8) for n in range(1, 5)] for _ in range(150)]
    said = lambda: [[(p.number, p.text, p.positions, p.doubts) for p in layout.laid_out(d, ["porte-feuille"])] for d in documents]
    assert len(layout.cut_page("a b c\n" * 500)) < 1200 < len(layout.cut("a b c\n" * 500))
    coarse = said()
    monkeypatch.setattr(layout, "cut_page", layout.cut)
    assert coarse == said()


def test_small_table_of_pages_is_laid_out_by_more_than_one_task(spark):
    rows = spark.createDataFrame([(d, 1, "mai-\nson", True) for d in range(60)], "document_id long, page_number int, text string, editable boolean")
    done = layout.normalised(rows, placed=False)
    assert done.columns == ["document_id", "page_number", "text"]
    assert done.select(F.spark_partition_id().alias("p")).distinct().count() > 4 and {r.text for r in done.collect()} == {"maison"}


def test_white_space_is_that_of_the_pattern(spark):
    t = F.concat(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')"), F.lit("a b"), F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')"))
    rows = spark.range(1, 0xD800).select(t.alias("t"))
    pattern = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    assert rows.filter(T.ustrip(F.col("t")) != pattern).count() == 0 and rows.filter(F.col("t") != pattern).count() == len(T.WHITE)
    assert rows.filter(T.indent(F.col("t")) != F.char_length("t") - F.char_length(F.regexp_replace("t", r"(?U)^\s+", ""))).count() == 0


def test_cells_and_numbers_are_computed_once(spark):
    text = " \u00a0| a\u2003|  | 1 234,50 € |\n|---|---|---|\n|é | 2.000.000 |-3,5|x|\nno table"
    pages = spark.createDataFrame([(1, text)], "page_id long, text string")
    numbered = tables.with_numbers(tables.table_rows(pages))
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 0 and plan.count("split(text") <= 3
    (row,) = numbered.collect()
    assert [tuple(c) for c in row.cells] == [(c, text.index(c), text.index(c) + len(c)) for c in ("é", "2.000.000", "-3,5", "x")]
    assert [c.text for c in row.header] == ["a", "", "1 234,50 €"] and list(map(float, row.numbers)) == [2000000.0, -3.5]


def test_checks_of_tables_leave_places_and_cells_alone(spark):
    import random

    rng = random.Random(7)
    piece = lambda: rng.choice(["", " ", "Total", " somme ", "1 234,50 €", "-3", "2.000.000", "x y", "1,2,", " é", "12", "+7.5", "😀 1"])
    rows = lambda: "\n".join(rng.choice(["no pipe", "", "|---|---|", "| :-: |", *["|".join(piece() for _ in range(rng.randrange(1, 6))) for _ in range(6)], "| Qté | Total |"]) for _ in range(rng.randrange(1, 12)))
    texts = [rows() for _ in range(400)]
    found = tables.table_rows(spark.createDataFrame(list(enumerate(texts)), "page_id long, text string"))
    numbered = tables.with_totals(tables.with_numbers(found))
    values = F.array_compact(T.parse_numbers(F.col("cells.text")))
    numbered = numbered.withColumns({"want": values, "label": F.get("cells", F.lit(0))["text"].rlike("(?i)^(total|somme|montant total)")})
    got = numbered.collect()
    assert len(got) > 300
    for r in got:
        lines, cut = texts[r.page_id].split("\n"), texts[r.page_id]
        assert "|" in lines[r.line] and cut[r.row_start : r.row_end] == lines[r.line].strip()
        assert [c.text for c in r.cells] == r.texts and all(cut[c.start : c.end] == c.text for c in r.cells)
        assert (r.header is None) == (r.header_texts is None) and (r.header is None or [c.text for c in r.header] == r.header_texts)
        assert r.numbers == r.want and (r.stated is not None) == bool(r.label and len(r.numbers) == 1)
        top = r.line
        while top and "|" in lines[top - 1]:
            top -= 1
        assert r.table == sum("|" not in x for x in lines[:top]) - 1
    plan = tables.sum_blocks(tables.with_numbers(found))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "substring_index(text" not in plan and "aggregate(" not in plan  # into lines, not into cells


# One rule a pattern, as the SQL has them.
RULES_OF_HALVES = ((r"\p{L}+([ \t]+-)", "\x01$1"), (r"\p{L}+(-+(?:[ \t\n]|\z))", "\x01$1"), (r"(-+[ \t\n]+)\p{L}+", "$1\x01"), (r"((?:\A|[ \t\n])-+)\p{L}+", "$1\x01"), (r"\A([ \t\n]*)\p{Ll}\p{L}*", "$1\x01"))


def test_halves_in_fewer_passes(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abÉ- -\n\t.") for _ in range(rng.randrange(0, 24))) for _ in range(20_000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    hide = lambda halves: reduce(lambda c, half: F.regexp_replace(c, *half), halves, F.col("t"))
    assert df.filter(hide(breaks.HALVES) != hide(RULES_OF_HALVES)).limit(3).collect() == []


def test_breaks_meet_the_lexicon_without_a_sort_of_lines(spark):
    text = "ab cd-\nef -\ngh ij--\nkl- \n  mn-\nOP- \r\nqr é-\n- st\n-\nuv wx-"
    rows = breaks.line_breaks(spark.createDataFrame([(0, 1, text), (0, 2, None), (1, 1, "a-")], "document_id long, page_number long, text string"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan  # a line's next is in the same list
    got = [(r.line, r.left, r.apart, r.right) for r in rows.orderBy("page_number", "line").collect()]
    assert got == [(0, "cd", False, "ef"), (1, "ef", True, "gh"), (2, "ij", False, "kl"), (3, "kl", False, "mn"), (4, "mn", False, "OP"), (6, "é", False, "")]
    found = spark.createDataFrame([(0, 1, 0, "cd", False, "ef"), (0, 1, 1, "ef", True, "gh"), (0, 1, 2, "kl", False, "mn"), (0, 1, 3, "op", False, "qr"), (0, 1, 4, "AB", False, "cd")], "document_id long, page_number long, line int, left string, apart boolean, right string")
    words = spark.createDataFrame([(0, "cdef"), (0, "kl-mn"), (0, "op"), (1, "opqr")], "document_id long, word string")
    judged = breaks.judged_breaks(found, words)
    assert judged._jdf.queryExecution().analyzed().toString().count("Join") == 1
    assert {r.line: r.kind for r in judged.collect()} == {0: layout.CUT, 1: layout.FILLER, 2: layout.JOINED, 3: layout.DOUBT, 4: layout.DOUBT}

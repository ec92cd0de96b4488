"""Files, sinks, the stream, and every query against its SQL."""


import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagewright import queries, schemas
from pagewright.session import with_code
from pagewright.sources import files, sinks
from pagewright.streaming import jobs as stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_page_files(spark, tmp_path):
    for name in ("page10.png", "page2.PNG", "page1.jpg"):
        (tmp_path / name).write_bytes(name.encode())
    got = [(r.page_number, r.content.decode(), r.raw_image_path) for r in files.page_files(spark, str(tmp_path), "d").orderBy("page_number").collect()]
    assert got == [(1, "page1.jpg", "inbox/d/0001.jpg"), (2, "page2.PNG", "inbox/d/0002.png"), (3, "page10.png", "inbox/d/0003.png")]
    (tmp_path / "x.pdf").write_bytes(b"x")
    with pytest.raises(Exception, match="not a page image"):
        files.page_files(spark, str(tmp_path), "d").collect()
    (tmp_path / "x.pdf").unlink()
    (tmp_path / "empty.png").write_bytes(b"")
    with pytest.raises(Exception, match="empty file"):
        files.page_files(spark, str(tmp_path), "d").collect()


def test_corpus(spark, tmp_path):
    for sub in ("pages", "reference"):
        (tmp_path / sub).mkdir()
    for n in (1, 2):
        (tmp_path / f"pages/page-0{n}.jpg").write_bytes(b"x")
        (tmp_path / f"reference/page-0{n}.md").write_text(f"texte {n}\n", encoding="utf-8")
    (tmp_path / "questions.toml").write_text('[[questions]]\nid = "q"\nquestion = "Où ?"\npages = [2]\nvaleurs = ["ici"]\n', encoding="utf-8")
    (tmp_path / "controles.toml").write_text('[[nombres]]\nnom = "n"\npage = 1\nnombres = ["28,90"]\n', encoding="utf-8")
    root = str(tmp_path)
    assert files.corpus_pages(spark, root).count() == 2
    assert {r.page_number for r in files.corpus_references(spark, root).collect()} == {1, 2}
    assert files.corpus_questions(spark, root, 2).first().pages == [2]
    with pytest.raises(ValueError):
        files.corpus_questions(spark, root, 1)
    assert files.corpus_controls(spark, root)[2].first().value == "28,90"
    (tmp_path / "pages/page-04.jpg").write_bytes(b"x")
    with pytest.raises(ValueError):
        files.corpus_pages(spark, root)


def test_schemas(spark):
    old = spark.createDataFrame([("1", "p", 1)], "id string, page_id string, revision int")
    new = schemas.migrated(old, "revisions")
    assert new.columns == [f.name for f in schemas.schema("revisions")] and new.first().bulk_validated is False
    assert files.empty(spark, "jobs").count() == 0


def test_sinks(spark, tmp_path):
    root = str(tmp_path)
    one = spark.createDataFrame([("p", 1, "a")], "page_id string, revision int, content string")
    sinks.append_revisions(root, one)
    sinks.append_revisions(root, one.withColumn("revision", F.lit(2)))
    with pytest.raises(ValueError):
        sinks.append_revisions(root, one)
    with pytest.raises(ValueError):
        sinks.append_revisions(root, one.withColumn("revision", F.lit(3)).union(one.withColumn("revision", F.lit(3))))
    index = f"{root}/index"
    chunk = lambda key, doc, text, v: spark.createDataFrame([(key, doc, 1, text, v)], schemas.CHUNKS)
    assert sinks.upsert_chunks(spark, index, chunk("d:1", "d", "old", [1.0, 0.0]), 2) == 1
    sinks.upsert_chunks(spark, index, chunk("d:1", "d", "new", [1.0, 0.0]).union(chunk("e:1", "e", "x", [0.0, 1.0])), 2)
    assert {(r.chunk_id, r.content) for r in sinks.read_index(spark, index).collect()} == {("d:1", "new"), ("e:1", "x")}
    with pytest.raises(Exception, match="vector"):
        sinks.upsert_chunks(spark, index, chunk("f:1", "f", "x", [1.0]), 2)
    sinks.delete_document(spark, index, "d")
    assert [r.chunk_id for r in sinks.read_index(spark, index).collect()] == ["e:1"]
    sinks.delete_document(spark, f"{root}/none", "d")
    assert sinks.reindex(spark, index, chunk("g:1", "g", "x", [1.0, 1.0])) == 1
    assert sinks.delete_files(spark, index) and not sinks.delete_files(spark, index)
    sinks.write_report(spark.createDataFrame([('{"a":1}',)], "json string"), "# R", f"{root}/r")
    assert spark.read.text(f"{root}/r/rapport.md").first().value == "# R"
    sinks.export_markdown(spark.createDataFrame([("d", "x")], "document_id string, content string"), f"{root}/e")
    assert spark.read.text(f"{root}/e").first().value == "x"


def test_stream(spark, sf_dir, tmp_path):
    events = stream.event_stream(spark, sf_dir)
    counts = stream.tumbling_counts(stream.deduplicated(events))
    got = stream.to_memory(counts, "daily", str(tmp_path / "a"), "append")
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert 0 < got.agg(F.sum("n")).first()[0] <= batch.count()
    seen = []
    stream.run_available(stream.event_stream(spark, sf_dir), str(tmp_path / "b"), lambda df, k: seen.append(df.count()))
    assert sum(seen) == batch.count()
    stream.run_available(stream.event_stream(spark, sf_dir), str(tmp_path / "b"), lambda df, k: seen.append(df.count()))
    assert sum(seen) == batch.count()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return str(value) if hasattr(value, "isoformat") else tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](with_code(spark), sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in queries.SQL:
        result = duck.execute(queries.SQL[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == columns
        want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
        assert got == want

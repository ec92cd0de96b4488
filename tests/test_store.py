"""Stored tables: versions, crashes between steps, writers that meet, deletes that are finished later."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from pagewright import schemas
from pagewright.sources import files, sinks
from pagewright.sources.store import Duplicate, Log, Store

ROW = "id string, owner string, n int"


def store(spark, tmp_path, buckets=8):
    return Store(spark, f"{tmp_path}/table", ROW, ("id",), "owner", buckets)


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROW)


def content(table, values=None):
    return sorted(tuple(r) for r in table.read(values).collect())


BASE = [(f"{o}{k}", o, k) for o in "abcdefgh" for k in range(3)]


def test_changes_touch_their_buckets_alone(spark, tmp_path):
    t = store(spark, tmp_path)
    assert content(t) == [] and t.upsert(rows(spark, *BASE)) == 24
    before = t.version()
    assert content(t) == sorted(BASE) and len(before.folders) > 2
    assert t.upsert(rows(spark, ("a0", "a", 9), ("a7", "a", 7))) == 2
    after = t.version()
    mine = t._of(["a"], 8)
    assert {b for b in before.folders if before.folders[b] != after.folders[b]} == mine
    assert content(t, ["a"]) == [("a0", "a", 9), ("a1", "a", 1), ("a2", "a", 2), ("a7", "a", 7)]
    assert all(f"bucket_={b}" in p for b in mine for p in [str(t.read(["a"]).inputFiles())])
    t.delete(["b", "nobody"])
    assert {r[1] for r in content(t)} == set("acdefgh")
    assert t.replace(rows(spark, ("z", "z", 1))).number == 4 and content(t) == [("z", "z", 1)]
    t.delete(["z"])
    assert content(t) == [] and t.version().folders == {}


def test_old_versions_can_be_read_until_vacuum(spark, tmp_path):
    t = store(spark, tmp_path)
    t.upsert(rows(spark, *BASE))
    old = t.version()
    t.delete(list("abcd"))
    assert t.read(version=old).count() == 24
    assert t.vacuum() >= 0 and len(content(t)) == 12 and t.log.numbers() == [2]
    assert t.vacuum() == 0
    for k in range(4):
        t.append(rows(spark, (f"new{k}", "a", k)))
    assert max(map(len, t.version().folders.values())) >= 4
    kept = content(t)
    t.compact(most=2)
    assert content(t) == kept and max(map(len, t.version().folders.values())) <= 2


@pytest.mark.parametrize("where", ["write", "commit"])
def test_a_crash_leaves_the_old_version(spark, tmp_path, monkeypatch, where):
    t = store(spark, tmp_path)
    t.upsert(rows(spark, *BASE))
    before, seen = content(t), t.version()

    def dies(*_):
        raise KeyboardInterrupt

    for change in (lambda s: s.upsert(rows(spark, ("a0", "a", 9))), lambda s: s.delete(["a"]), lambda s: s.append(rows(spark, ("q", "q", 1))), lambda s: s.replace(rows(spark))):
        with monkeypatch.context() as m:
            m.setattr(*((Store, "_write", dies) if where == "write" else (Log, "take", dies)))
            if where == "write":
                m.setattr(Store, "_changed", dies)
            with pytest.raises(KeyboardInterrupt):
                change(t)
        assert content(t) == before and t.version() == seen
    t.vacuum()
    assert content(t) == before


def test_half_written_entries_are_never_seen(spark, tmp_path):
    log = Log(spark, f"{tmp_path}/log")
    assert log.latest() == (0, {}) and log.take(1, {"a": 1}) and not log.take(1, {"a": 2})
    (tmp_path / "log" / ".000000000002.json.half").write_text("{")
    assert log.latest() == (1, {"a": 1})


def interleaved(monkeypatch, other):
    """``other`` runs once, between the first commit's checks and the commit itself."""
    real, left = Store._commit, [other]

    def commit(self, *a):
        if left:
            left.pop()()
        return real(self, *a)

    monkeypatch.setattr(Store, "_commit", commit)


def test_one_of_two_writers_of_a_revision_wins(spark, tmp_path, monkeypatch):
    first, second = (spark.createDataFrame([("p", 1, text)], "page_id string, revision int, content string") for text in ("first", "second"))
    root = str(tmp_path)
    interleaved(monkeypatch, lambda: sinks.append_revisions(root, second))
    with pytest.raises(Duplicate):
        sinks.append_revisions(root, first)
    got = sinks.revisions_store(spark, root, first).read().collect()
    assert [(r.page_id, r.revision, r.content) for r in got] == [("p", 1, "second")]
    assert len(names(spark, f"{root}/revisions/data")) == 1  # the loser's files are gone


def names(spark, folder):
    from pagewright.sources.store import Files

    return Files(spark, folder).names(folder)


def test_writers_of_different_rows_both_win(spark, tmp_path, monkeypatch):
    t = store(spark, tmp_path, 2)
    t.upsert(rows(spark, *BASE))
    interleaved(monkeypatch, lambda: store(spark, tmp_path).append(rows(spark, ("a8", "a", 8))))
    t.append(rows(spark, ("a9", "a", 9)))
    interleaved(monkeypatch, lambda: store(spark, tmp_path).upsert(rows(spark, ("a0", "a", 50), ("b0", "b", 50))))
    t.upsert(rows(spark, ("a1", "a", 60), ("c0", "c", 60)))
    interleaved(monkeypatch, lambda: store(spark, tmp_path).append(rows(spark, ("d8", "d", 8))))
    t.delete(["d"])
    want = {r[0]: r for r in [*BASE, ("a8", "a", 8), ("a9", "a", 9), ("a0", "a", 50), ("b0", "b", 50), ("a1", "a", 60), ("c0", "c", 60)] if r[1] != "d"}
    assert content(t) == sorted(want.values())


def test_many_writers_at_once(spark, tmp_path):
    root = str(tmp_path)

    def write(k):
        try:
            sinks.append_revisions(root, spark.createDataFrame([("p", k % 3, f"by {k}")], "page_id string, revision int, content string"))
            return True
        except Duplicate:
            return False

    with ThreadPoolExecutor(6) as pool:
        won = list(pool.map(write, range(6)))
    assert sum(won) == 3
    got = files.stored(spark, root, "revisions")
    assert sorted(r.revision for r in got.collect()) == [0, 1, 2] and got.columns == [f.name for f in schemas.schema("revisions")]


# --- Deletes --------------------------------------------------------------------------------------------------------


def filled(spark, root):
    d = sinks.Deletes(spark, root, f"{root}/index", f"{root}/files")
    make = lambda name, *values: spark.createDataFrame(list(values), ", ".join(f"{c} string" for c in name))
    d.documents.append(make(("id", "status"), ("d1", "indexed"), ("d2", "indexed")))
    d.pages.append(make(("id", "document_id"), ("p1", "d1"), ("p2", "d1"), ("p3", "d2")))
    d.jobs.append(make(("id", "document_id", "status", "kind"), ("j1", "d1", "done", "index"), ("j2", "d2", "running", "index")))
    d.revisions.append(make(("page_id", "content_markdown"), ("p1", "x"), ("p2", "y"), ("p3", "z")).withColumn("revision", F.lit(1)))
    chunks = [(f"{doc}:1", doc, 1, "text", [1.0]) for doc in ("d1", "d2")]
    sinks.upsert_chunks(spark, d.index, spark.createDataFrame(chunks, schemas.CHUNKS), 1)
    images = [(f"images/{doc}/0001.png", b"bytes") for doc in ("d1", "d2")]
    assert sinks.write_bytes(spark, d.files, spark.createDataFrame(images, "path string, content binary")) == 2
    return d


def left(d):
    """Documents that each store still has something of."""
    pages = {"p1": "d1", "p2": "d1", "p3": "d2"}
    found = [{r.document_id for r in t.read().collect()} for t in (sinks.index_store(d.spark, d.index), d.pages, d.jobs)]
    found += [{pages[r.page_id] for r in d.revisions.read().collect()}, {r.id for r in d.documents.read().collect()}]
    return [*found, set(names(d.spark, f"{d.files}/images"))]


def test_delete_takes_all_of_a_document(spark, tmp_path):
    d = filled(spark, str(tmp_path))
    with pytest.raises(ValueError, match="running"):
        d.delete("d2")
    with pytest.raises(LookupError):
        d.delete("d3")
    d.delete("d1")
    assert left(d) == [{"d2"}] * 6 and d.resume() == []


@pytest.mark.parametrize(("step", "after"), [(s, False) for s in sinks.STEPS] + [("pages", True)])
def test_a_cut_off_delete_is_finished_by_the_next_run(spark, tmp_path, monkeypatch, step, after):
    d = filled(spark, str(tmp_path))
    real = sinks.Deletes._step

    def dies(self, name, *a):
        if name == step and not after:
            raise KeyboardInterrupt
        real(self, name, *a)
        if name == step:
            raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(sinks.Deletes, "_step", dies)
        with pytest.raises(KeyboardInterrupt):
            d.delete("d1")
    # What the index cites is there until the index has let go of it.
    if "d1" in left(d)[0]:
        assert all("d1" in s for s in left(d))
    assert sinks.Deletes(spark, d.root, d.index, d.files).resume() == ["d1"]
    assert left(d) == [{"d2"}] * 6


def test_write_bytes_stays_in_its_folder(spark, tmp_path):
    for path in ("../x.png", "/x.png", "a//x.png", None):
        with pytest.raises(ValueError):
            sinks.write_bytes(spark, str(tmp_path), spark.createDataFrame([(path, b"x")], "path string, content binary"))
    sinks.write_bytes(spark, str(tmp_path), spark.createDataFrame([("inbox/d/0001.png", b"x"), ("inbox/d/0002.png", b"")], "path string, content binary"))
    assert (tmp_path / "inbox/d/0001.png").read_bytes() == b"x" and (tmp_path / "inbox/d/0002.png").read_bytes() == b""


# --- Bulk validation ------------------------------------------------------------------------------------------------


def reviewed(spark, tmp_path):
    root = str(tmp_path)
    pages = spark.createDataFrame([("p1", "d1", 1), ("p2", "d1", 2), ("p3", "d2", 1), ("p4", "d3", 1)], "page_id string, document_id string, page_number int")
    schema = "page_id string, revision int, origin string, content string, is_validated boolean, bulk_validated boolean"
    rows = spark.createDataFrame([("p1", 1, "ocr", "a", False, False), ("p2", 1, "ocr", "b", False, False), ("p2", 2, "human", "b2", True, False), ("p3", 1, "ocr", "c", False, False)], schema)
    sinks.append_revisions(root, rows)
    jobs = Store(spark, f"{root}/jobs", schemas.schema("jobs"), ("id",), "document_id")
    documents = spark.createDataFrame([("d1", "awaiting_validation"), ("d2", "transcribing"), ("d3", "validated")], "document_id string, status string")
    return root, pages, rows, jobs, documents


def asked(spark, found_pages, revisions):
    from pagewright.operators import labels, review

    return labels.displayed_revisions(review.page_summaries(found_pages, revisions))


def test_bulk_validation_is_all_or_nothing(spark, tmp_path):
    from pagewright.plans.validation import validate, validation

    root, pages, rows, jobs, documents = reviewed(spark, tmp_path)
    at = F.to_timestamp(F.lit("2026-01-01"))
    table = sinks.revisions_store(spark, root, rows)
    shown = asked(spark, pages, rows)
    got = {r.document_id: tuple(r)[1:] for r in validate(root, jobs, validation(documents, pages, table.read(), shown, at)).collect()}
    assert got == {
        "d1": ("ok", [1], 1, "validated", True), "d2": ("not transcribed", [], 0, "transcribing", False), "d3": ("a page without text", [], 0, "validated", False),
    }
    assert [(r.page_id, r.revision, r.content, r.bulk_validated) for r in table.read(["p1"]).filter("is_validated").collect()] == [("p1", 2, "a", True)]
    assert [(j.document_id, j.kind, j.status) for j in jobs.read().collect()] == [("d1", "index", "queued")]
    # Shown before: a page has changed. Shown anew: nothing is left, no job.
    one = documents.filter("document_id = 'd1'")
    assert validation(one, pages, table.read(), shown, at).results.first().verdict == "a page has changed"
    again = validate(root, jobs, validation(one, pages, table.read(), asked(spark, pages, table.read()), at)).first()
    assert tuple(again)[1:] == ("ok", [], 2, "awaiting_validation", False) and jobs.read().count() == 1


def test_of_two_bulk_validations_one_is_refused(spark, tmp_path, monkeypatch):
    from pagewright.plans.validation import validate, validation

    root, pages, rows, jobs, documents = reviewed(spark, tmp_path)
    at, shown = F.to_timestamp(F.lit("2026-01-01")), asked(spark, pages, rows)
    make = lambda: validation(documents, pages, sinks.revisions_store(spark, root, rows).read(), shown, at)
    mine = make()
    interleaved(monkeypatch, lambda: validate(root, jobs, make()))
    with pytest.raises(Duplicate, match="another validation"):
        validate(root, jobs, mine)
    assert jobs.read().count() == 1 and sinks.revisions_store(spark, root, rows).read().count() == 5


# --- Versions of the schema -----------------------------------------------------------------------------------------


def test_round_trip_of_schema_versions(spark, tmp_path):
    from pagewright import migrations as m

    old = spark.createDataFrame([("p", 1, "ocr", True), ("p", 2, "human", False)], "page_id string, revision int, origin string, is_validated boolean")
    assert m.version_of(old) == 1
    new = m.at_version(old, "revisions")
    assert new.columns[-1] == "bulk_validated" and {r.bulk_validated for r in new.collect()} == {False}
    now = m.stamped(new.unionByName(new.limit(1).withColumns({"revision": F.lit(3), "origin": F.lit("normalized")})))
    assert m.version_of(now) == m.VERSION
    assert sorted(tuple(r) for r in m.at_version(now, "revisions", 1).collect()) == sorted(tuple(r) for r in old.collect())
    assert m.at_version(now, "revisions", 3).count() == 2 and "bulk_validated" in m.at_version(now, "revisions", 3).columns
    documents = m.stamped(spark.createDataFrame([("d", "preprocessed"), ("e", "new")], "id string, status string"))
    assert {r.id: r.status for r in m.at_version(documents, "documents", 1).collect()} == {"d": "preprocessing", "e": "new"}
    with pytest.raises(ValueError):
        m.at_version(old, "revisions", m.VERSION + 1)


def test_files_of_two_versions_are_read_as_one(spark, tmp_path, monkeypatch):
    from pagewright import migrations as m
    from pagewright.sources import store as store_module

    root = str(tmp_path)
    first = spark.createDataFrame([("p", 1, "ocr")], "page_id string, revision int, origin string")
    with monkeypatch.context() as old:
        old.setattr(store_module, "stamped", lambda df: m.stamped(df, 2))
        sinks.append_revisions(root, first)
    sinks.append_revisions(root, spark.createDataFrame([("p", 2, "normalized", True), ("q", 1, "human", True)], "page_id string, revision int, origin string, bulk_validated boolean"))
    got = files.stored(spark, root, "revisions")
    assert {(r.page_id, r.revision): r.bulk_validated for r in got.collect()} == {("p", 1): False, ("p", 2): True, ("q", 1): True}
    before = files.stored(spark, root, "revisions", version=2)
    assert {(r.page_id, r.revision) for r in before.collect()} == {("p", 1), ("q", 1)} and "bulk_validated" not in before.columns

"""The report of an evaluation: one nested row, from which its JSON and its Markdown both come.

Figures over all pages, by origin and by page come from one pass over the grouping sets. Lists stand in the order in which the
corpus declares them (``declared_at``), pages by their number. A corpus has at most MAX_PAGES pages and a declared list of
controls and questions, so the row is bounded. What isn't measured is null, never 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MAX_PAGES, NOT_MEASURED, RANKS, REPORT_TEXTS
from ..operators.evaluation import exact_answers, recall_at

SUMS = ("distance", "length", "expected", "read", "correct")
SCORE = ("attendus", "lus", "justes", "rappel", "precision")


def levels(measured: DataFrame) -> DataFrame:
    """level (all, origin, page), reference_origin, page_number, cer, characters, pages, expected, read, correct, recall, precision.

    ``measured``: page_number, reference_origin, distance, length, expected, read, correct of pages with a reference; no
    page gives no row.
    """
    keys = ("reference_origin", "page_number")
    sets = measured.groupingSets([[], [F.col(keys[0])], [F.col(k) for k in keys]], *(F.col(k) for k in keys))
    sums = sets.agg(F.grouping_id().alias("id"), *(F.sum(c).alias(c) for c in SUMS), F.count(F.lit(1)).alias("pages"))
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sums.select(
        F.when(F.col("id") == 3, "all").when(F.col("id") == 1, "origin").otherwise("page").alias("level"), *keys, share("distance", "length").alias("cer"), F.coalesce("length", F.lit(0)).alias("characters"),
        "pages", zero("expected"), zero("read"), zero("correct"), share("correct", "expected").alias("recall"), share("correct", "read").alias("precision"),
    )


def _at(df: DataFrame, *otherwise: str) -> Column:
    return F.struct(*([F.col("declared_at")] if "declared_at" in df.columns else []), *otherwise)


def _listed(df: DataFrame, order: Column, item: Column) -> DataFrame:
    """One row: the items in their order."""
    return df.agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("order"), item.alias("item")))), lambda x: x["item"]).alias("items"))


def _score() -> Column:
    return F.struct(*(F.col(c).alias(name) for c, name in zip(("expected", "read", "correct", "recall", "precision"), SCORE)))


def _transcription(measured: DataFrame, unread: list[int]) -> DataFrame:
    rows = levels(measured)
    is_ = lambda level: F.col("level") == level
    origin = lambda name: F.first(F.when(is_("origin") & (F.col("reference_origin") == name), F.struct("cer", "pages")), ignorenulls=True)
    page = F.struct(F.col("page_number").alias("page"), F.col("reference_origin").alias("origine"), "cer", F.col("characters").alias("caracteres"), _score().alias("nombres"))
    whole = rows.agg(
        F.first(F.when(is_("all"), F.struct("cer", "pages", _score().alias("score"))), ignorenulls=True).alias("all"), origin("typed").alias("typed"), origin("reread").alias("reread"),
        F.array_sort(F.collect_list(F.when(is_("page"), page))).alias("pages"),
    )
    nothing = F.struct(*(F.lit(v).cast(kind).alias(name) for name, v, kind in zip(SCORE, (0, 0, 0, None, None), ("long", "long", "long", "double", "double"))))
    missing = F.array(*(F.lit(n) for n in sorted(unread))).cast("array<int>")
    return whole.select(
        F.struct(
            F.col("all.cer").alias("cer_global"), F.struct(F.col("typed.cer").alias("saisie"), F.col("reread.cer").alias("relecture")).alias("cer_par_origine"),
            F.struct(F.coalesce("typed.pages", F.lit(0)).alias("saisie"), F.coalesce("reread.pages", F.lit(0)).alias("relecture")).alias("pages_par_origine"),
            "pages", missing.alias("references_sans_transcription"), F.coalesce("all.score", nothing).alias("nombres"),
        ).alias("transcription")
    )


def _controls(tables: DataFrame, numbers: DataFrame) -> DataFrame:
    table = F.struct(
        F.col("control").alias("controle"), F.col("name").alias("nom"), F.col("lots").alias("lots_attendus"), F.col("lots_read").alias("lots_lus"), F.col("total_read").alias("somme"), F.col("total").alias("total_attendu"),
        F.col("closed").alias("total_lu"), F.col("missing_pages").alias("pages_manquantes"), F.col("passed").alias("juste"),
    )
    number = F.struct(F.col("control").alias("nom"), F.col("page_id").alias("page"), F.col("found").alias("trouves"), F.col("missing").alias("manquants"), F.col("page_missing").alias("page_manquante"), F.col("passed").alias("juste"))
    a = _listed(tables, _at(tables, "control", "segment"), table).withColumnRenamed("items", "tables")
    b = _listed(numbers, _at(numbers, "control", "page_id"), number).withColumnRenamed("items", "nombres")
    good = F.size(F.filter("tables", lambda x: x["juste"])) + F.size(F.filter("nombres", lambda x: x["juste"]))
    return a.join(b).select(F.struct("tables", "nombres", good.alias("justes"), (F.size("tables") + F.size("nombres")).alias("total")).alias("controles"))  # one row each


def _search(questions: DataFrame) -> DataFrame:
    optional = lambda name, kind: F.col(name) if name in questions.columns else F.lit(None).cast(kind).alias(name)
    item = F.struct(
        F.col("query_id").alias("id"), optional("question", "string").alias("question"), optional("expected", "array<int>").alias("pages_attendues"), F.col("pages").alias("pages_retrouvees"), F.col("rank").alias("rang"),
        F.col("answer").alias("reponse"), F.col("found").alias("valeur_trouvee"),
    )
    rows = _listed(questions, _at(questions, "query_id"), item).withColumnRenamed("items", "detail")
    if questions.isEmpty():
        return rows.select(F.when(F.lit(False), F.struct("detail")).alias("recherche"))
    at = {k: F.first(F.when(F.col("k") == k, F.col("recall")), ignorenulls=True).alias(f"rappel_a_{k}") for k in RANKS}
    recalls = recall_at(questions, RANKS).agg(*at.values())
    both = rows.join(recalls).join(exact_answers(questions))  # one row each
    return both.select(F.struct(F.size("detail").alias("questions"), *(f"rappel_a_{k}" for k in RANKS), F.col("exact_answers").alias("reponses_exactes"), "detail").alias("recherche"))


def report(spark: SparkSession, corpus: str, pages: int, unread_pages: list[int], configuration: dict, seconds: dict[str, float], measured: DataFrame, unread: list[int], tables: DataFrame, numbers: DataFrame, questions: DataFrame) -> DataFrame:
    """One row: the fields of the report, nested, and ``json``, all of it as text."""
    if pages > MAX_PAGES:
        raise ValueError(f"{pages} pages, more than the {MAX_PAGES} of a document")
    shown = lambda values, kind: F.create_map(*(F.lit(x) for kv in values.items() for x in kv)).cast(kind) if values else F.create_map().cast(kind)
    head = spark.range(1).select(
        F.lit(corpus).alias("corpus"), F.lit(pages).alias("pages"), F.array(*(F.lit(n) for n in sorted(unread_pages))).cast("array<int>").alias("pages_non_transcrites"),
        shown({k: str(v) for k, v in configuration.items()}, "map<string,string>").alias("configuration"), shown({k: float(v) for k, v in seconds.items()}, "map<string,double>").alias("durees_secondes"),
    )
    whole = head.join(_transcription(measured, unread)).join(_controls(tables, numbers)).join(_search(questions))  # one row each
    return whole.withColumn("json", F.to_json(F.struct(*whole.columns), {"ignoreNullFields": "false", "pretty": "true"}))


# Rendering: from the row alone.


def _percent(share: float | None) -> str:
    return NOT_MEASURED if share is None else f"{share * 100:.1f}%"


def _mark(passed: bool) -> str:
    return "✓" if passed else "✗"


def _texts(t: dict):
    say, n = REPORT_TEXTS, t["nombres"]
    yield from (say["transcription"], "")
    count = len(t["pages"])
    yield say["cer"].format(cer=_percent(t["cer_global"]), n=count) if count and t["cer_global"] is not None else say["no_cer"].format(no=NOT_MEASURED)
    for origin in ("saisie", "relecture"):
        if t["pages_par_origine"][origin]:
            yield say[origin].format(cer=_percent(t["cer_par_origine"][origin]), n=t["pages_par_origine"][origin])
    yield say["numbers"].format(**{k: n[k] for k in ("justes", "attendus")}, rappel=_percent(n["rappel"]), precision=_percent(n["precision"]))
    if t["references_sans_transcription"]:
        yield say["unread"].format(pages=t["references_sans_transcription"])
    if count:
        yield from ("", say["page_head"], "|---|---|---|---|")
        names = {"typed": "saisie", "reread": "relecture"}
        for p in t["pages"]:
            yield f"| {p['page']} | {names[p['origine']]} | {_percent(p['cer'])} | {p['nombres']['justes']}/{p['nombres']['attendus']} |"
    yield ""


def _checks(c: dict):
    say = REPORT_TEXTS
    yield from (say["controls"].format(**{k: c[k] for k in ("justes", "total")}), "")
    for t in c["tables"]:
        absent = say["absent_pages"].format(pages=t["pages_manquantes"]) if t["pages_manquantes"] else ""
        yield say["table"].format(mark=_mark(t["juste"]), closed=say["read" if t["total_lu"] else "not_read"], absent=absent, **{k: t[k] for k in ("controle", "nom", "lots_lus", "lots_attendus", "somme", "total_attendu")})
    for x in c["nombres"]:
        detail = say["no_page"] if x["page_manquante"] else say["missing"].format(values=x["manquants"])
        yield say["number"].format(mark=_mark(x["juste"]), nom=x["nom"], page=x["page"], found=len(x["trouves"]), detail=detail)
    yield ""


def _found(s: dict | None):
    say = REPORT_TEXTS
    yield from (say["search"], "")
    if s is None:
        yield from (say["no_question"].format(no=NOT_MEASURED), "")
        return
    yield say["recall"].format(n=s["questions"], listed=", ".join(f"@{k} {_percent(s[f'rappel_a_{k}'])}" for k in RANKS))
    yield from (say["answers"].format(share=_percent(s["reponses_exactes"])), "", say["question_head"], "|---|---|---|---|---|")
    for q in s["detail"]:
        passed = q["rang"] is not None and (q["reponse"] is None or q["valeur_trouvee"] is not None)
        yield f"| {_mark(passed)} | {q['id']} | {'—' if q['rang'] is None else q['rang']} | {q['pages_retrouvees'][:5]} | {q['valeur_trouvee'] or '—'} |"
    yield ""


def rendered(row) -> str:
    """The Markdown of a report's row."""
    r, say = row.asDict(recursive=True), REPORT_TEXTS
    lines = [say["title"].format(corpus=r["corpus"]), "", *(f"- {k} : {v}" for k, v in r["configuration"].items())]
    absent = say["unread_pages"].format(pages=r["pages_non_transcrites"]) if r["pages_non_transcrites"] else ""
    lines.append(say["pages"].format(read=r["pages"] - len(r["pages_non_transcrites"]), pages=r["pages"], absent=absent))
    lines += [*(say["seconds"].format(step=step, s=s) for step, s in r["durees_secondes"].items()), ""]
    return "\n".join([*lines, *_texts(r["transcription"]), *_checks(r["controles"]), *_found(r["recherche"])])

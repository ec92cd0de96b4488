"""What the review screens say: counts with plurals, lists of pages, progress, why a bulk approval is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ALERT_ICON, BULK_ICON, PAGE_ICONS, REVIEWABLE, STATUS_LABELS, UNKNOWN_ICON
from ..functions.text import score_label
from .review import GALLERY, progress


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.when(n > 1, f" {word}s").otherwise(f" {word}"))


def page_list(numbers: Column) -> Column:
    """p. 1, 2, 3"""
    return F.concat(F.lit("p. "), F.array_join(F.transform(numbers, lambda n: n.cast("string")), ", "))


def pages_named(numbers: Column) -> Column:
    """page 1, or pages 1, 2"""
    listed = F.array_join(F.transform(numbers, lambda n: n.cast("string")), ", ")
    return F.concat(F.when(F.size(numbers) == 1, "page ").otherwise("pages "), listed)


def progress_labels(summaries: DataFrame) -> DataFrame:
    """document_id, label: validated pages of all, and the pages with an alert."""
    n, total, alerts = F.col("validated"), F.col("total"), F.col("alerts")
    done = F.concat(n.cast("string"), F.lit(" / "), total.cast("string"), F.when(total > 1, " pages validées").otherwise(" page validée"))
    warned = F.when(F.size(alerts) > 0, F.concat(F.lit(" · "), plural(F.size(alerts), "alerte"), F.lit(" ("), page_list(alerts), F.lit(")"))).otherwise("")
    return progress(summaries).select("document_id", F.concat(done, warned).alias("label"))


def _open_pages(summaries: DataFrame) -> DataFrame:
    """One row a document: how many pages aren't validated, which of them have no text, which an alert."""
    is_open = F.col("state") != "validated"
    where = lambda c: F.array_sort(F.collect_list(F.when(is_open & c, F.col("page_number"))))
    return summaries.groupBy("document_id").agg(F.count_if(is_open).alias("open"), where(F.col("state") == "untranscribed").alias("unread"), where(GALLERY["alerts"]()).alias("alerts"))


def bulk_refusals(documents: DataFrame, summaries: DataFrame) -> DataFrame:
    """document_id, refusal: why its pages can't be approved at once, null if they can. ``documents`` has document_id, status.

    A document without pages has none that is left to approve.
    """
    status = F.lit(None).cast("string")
    for code, label in STATUS_LABELS.items():
        status = F.when(F.col("status") == code, label).otherwise(status)
    rows = documents.select("document_id", "status").join(_open_pages(summaries), "document_id", "left")
    refusal = (
        F.when(F.coalesce("open", F.lit(0)) == 0, "Toutes les pages sont déjà validées.")
        .when(~F.col("status").isin(*REVIEWABLE), F.concat(F.lit("Document « "), F.coalesce(status, F.col("status")), F.lit(" » : la validation groupée attend la fin de la transcription.")))
        .when(F.size("unread") > 0, F.concat(F.lit("Pages sans transcription ("), page_list(F.col("unread")), F.lit(") : lancer l'OCR ou saisir leur texte d'abord.")))
    )
    return rows.select("document_id", refusal.alias("refusal"))


def bulk_confirmations(summaries: DataFrame) -> DataFrame:
    """document_id, text: what a bulk approval approves, with the doubtful pages named."""
    n = F.size("alerts")
    doubtful = F.concat(F.lit(" Parmi elles, "), n.cast("string"), F.when(n == 1, " porte").otherwise(" portent"), F.lit(" une alerte : "), page_list(F.col("alerts")), F.lit("."))
    text = F.concat(
        F.lit("Valider "), plural(F.col("open"), "page"), F.lit(" sans les relire une à une."), F.when(n > 0, doubtful).otherwise(""),
        F.lit(" Elles resteront marquées « validée en lot » et ne serviront pas de référence pour mesurer l'OCR."),
    )
    return _open_pages(summaries).select("document_id", text.alias("text"))


def displayed_revisions(summaries: DataFrame) -> DataFrame:
    """What a screen shows of each page, to be held against what is there later; 0 where it has no text."""
    return summaries.select("document_id", "page_id", F.coalesce("latest_revision", F.lit(0)).alias("revision"))


def thumbnails(summaries: DataFrame) -> DataFrame:
    """page_id, icon, state_label, score_label, alert, label: what a page's thumbnail says.

    An alert takes the place of the state's icon, whatever the state; the state's name stays.
    """
    known = F.create_map(*(F.lit(x) for code, shown in PAGE_ICONS.items() for x in (code, f"{shown[0]}|{shown[1]}")))
    bulk = (F.col("state") == "validated") & F.col("bulk_validated")
    shown = F.split(F.when(bulk, "|".join(BULK_ICON)).otherwise(F.coalesce(F.try_element_at(known, F.col("state")), F.concat(F.lit(f"{UNKNOWN_ICON}|"), F.col("state")))), r"\|")
    alert = GALLERY["alerts"]()
    rows = summaries.withColumns({"icon": F.when(alert, ALERT_ICON).otherwise(shown[0]), "state_label": shown[1], "score_label": score_label(F.col("score")), "alert": alert})
    label = F.concat(F.col("icon"), F.lit(" p. "), F.col("page_number").cast("string"), F.lit(" · "), F.col("score_label"))
    return rows.select("page_id", "icon", "state_label", "score_label", "alert", label.alias("label"))

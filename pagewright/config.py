"""Constants of the document domain, in one place."""

from __future__ import annotations

from dataclasses import dataclass

# Enumerations of the model.
DOCUMENT_STATUSES = ("new", "preprocessing", "preprocessed", "transcribing", "awaiting_validation", "validated", "indexed", "failed")
ORIGINS = ("ocr", "human", "normalized")
STATUS_LABELS = {
    "new": "importé", "preprocessing": "prétraitement…", "preprocessed": "prétraité", "transcribing": "OCR en cours…",
    "awaiting_validation": "à valider", "validated": "validé", "indexed": "indexé", "failed": "en échec",
}
PAGE_ICONS = {"untranscribed": ("⬜", "non transcrite"), "to_review": ("👁️", "à relire"), "draft": ("✏️", "brouillon"), "validated": ("✅", "validée")}
BULK_ICON, ALERT_ICON, UNKNOWN_ICON = ("☑️", "validée en lot"), "⚠️", "❔"
PAGE_STATES = ("untranscribed", "to_review", "draft", "validated")
JOB_STATUSES = ("queued", "running", "done", "failed")
REVIEWABLE = ("awaiting_validation", "validated", "indexed")
REINDEXABLE = ("validated", "indexed")
ACTIVE_JOBS = ("queued", "running")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".webp", ".bmp")

# Limits and thresholds.
MAX_PAGES = 200
MAX_PAGE_BYTES = 25 * 1024 * 1024
ALERT_BELOW = 0.5
PACKET = 24
THUMBNAIL_MIN, THUMBNAIL_WIDTH, THUMBNAIL_MAX = 64, 240, 512
REFRESH_SECONDS, POLL_SECONDS = 5, 10
NOT_MEASURED = "non mesuré"
EMBED_BATCH = 16
RRF_K = 60
CANDIDATE_FACTOR, MIN_CANDIDATES, VECTOR_FACTOR = 3, 10, 5
RANKS = (1, 3, 5, 10)
BM25_K1, BM25_B = 1.2, 0.75
CHARS_PER_TOKEN, CONTEXT_TOKENS, ANSWER_TOKENS = 1.8, 8192, 512
JOB_SECONDS, OCR_SECONDS, OCR_PASSES = 3600, 300, 2
INTERRUPTED = "interrompu : délai dépassé ou arrêt du worker"
CUT_MARK = "[passage coupé : trop long pour le contexte du modèle]"
NO_PASSAGE = "Aucun passage trouvé."

# The sentences of the evaluation report.
REPORT_TEXTS = {
    "title": "# Évaluation — {corpus}",
    "pages": "- Pages transcrites : {read}/{pages}{absent}",
    "unread_pages": " (non transcrites : {pages})",
    "seconds": "- Durée {step} : {s:.0f} s",
    "transcription": "## Transcription",
    "cer": "- Taux d'erreur par caractère : {cer} sur {n} page(s) de référence",
    "no_cer": "- Taux d'erreur par caractère : {no} (ni page saisie, ni relecture validée)",
    "saisie": "  - saisies : {cer} sur {n} page(s)",
    "relecture": "  - relectures : {cer} sur {n} page(s) — un minimum : la relecture part du texte de l'OCR",
    "numbers": "- Nombres : {justes} justes sur {attendus} attendus (rappel {rappel}, précision {precision})",
    "unread": "- Références sans transcription : {pages}",
    "page_head": "| Page | Origine | Taux d'erreur | Nombres justes |",
    "controls": "## Contrôles objectifs ({justes}/{total})",
    "table": "- {mark} {controle} — {nom} : {lots_lus}/{lots_attendus} lots, somme {somme}/{total_attendu}, ligne de total {closed}{absent}",
    "read": "lue",
    "not_read": "absente",
    "absent_pages": ", pages non transcrites {pages}",
    "number": "- {mark} {nom} (page {page}) : {found} trouvés, {detail}",
    "no_page": "page non transcrite",
    "missing": "manquants {values}",
    "search": "## Recherche",
    "no_question": "- {no} (aucune question)",
    "recall": "- Rappel ({n} questions) : {listed}",
    "answers": "- Réponses exactes : {share}",
    "question_head": "| | Question | Rang | Pages retrouvées | Valeur trouvée |",
}

# Scores of the confidence checks.
SCORES = {"arithmetic": 0.15, "illegible": 0.2, "replacement": 0.3, "empty_cell": 0.4, "ragged_row": 0.4, "numeric_divergence": 0.2, "uncertain_break": 0.45}
ABSOLUTE_TOLERANCE, RELATIVE_TOLERANCE = "0.02", "0.005"


@dataclass(frozen=True)
class Settings:
    """What a deployment may change."""

    embedding_dim: int = 1024
    second_pass_below: float = 0.5
    top_k: int = 5
    max_edge_px: int = 1600
    contrast: str = "clahe"

"""The starter rule pack: rules, dispute markers, sections, languages and wording are data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANGUAGES = ("ru", "en", "it", "fr")
DEFAULT_LANGUAGE = "ru"

RULES = (
    ("penalty", "high", ("penalty", "penale")),
    ("one_sided", "critical", ("unilateral", "sole discretion")),
    ("secrecy", "medium", ("confidential",)),
    ("indemnity", "medium", ("indemn",)),
)
DISPUTES = (
    ("open_terms", 0.7, ("by agreement of the parties",)),
    ("discretion", 0.65, ("is entitled",)),
    ("vague_time", 0.75, ("reasonable time", "délai raisonnable")),
)
SECTIONS = {
    "must_do": ("shall", "must", "deve", "обязан"),
    "payment_terms": ("pay", "prix", "оплатить"),
    "deadlines": ("days", "within", "giorni", "дней", "срок"),
    "penalties": ("penalty", "penale"),
    "should_review": ("may", "entitled"),
}

# Severity ranks and labels, placeholder of an empty text, pipeline states.
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
UI_ORDER = {"high": 0, "medium": 1, "low": 2}
SEVERITY_LABEL = {
    "ru": {"low": "Низкий риск", "medium": "Средний риск", "high": "Высокий риск", "critical": "Критический риск"},
    "en": {"low": "Low risk", "medium": "Medium risk", "high": "High risk", "critical": "Critical risk"},
    "it": {"low": "Rischio basso", "medium": "Rischio medio", "high": "Rischio alto", "critical": "Rischio critico"},
    "fr": {"low": "Risque faible", "medium": "Risque moyen", "high": "Risque eleve", "critical": "Risque critique"},
}
PLACEHOLDER = {
    "ru": "Текст документа пуст после этапа ingestion.",
    "en": "Document text is empty after ingestion stage.",
    "it": "Il testo del documento e vuoto dopo la fase di ingestion.",
    "fr": "Le texte du document est vide apres l'etape d'ingestion.",
}
LIFECYCLE = {"uploaded": "queued", "queued": "queued", "preprocessing": "processing", "analyzing": "processing", "report_ready": "completed", "failed": "failed"}
PROGRESS = {"uploaded": 5, "queued": 15, "preprocessing": 35, "analyzing": 75, "report_ready": 100, "failed": 0}
TRANSITIONS = {
    "uploaded": ("queued", "failed"),
    "queued": ("preprocessing", "failed"),
    "preprocessing": ("analyzing", "failed"),
    "analyzing": ("report_ready", "failed"),
    "report_ready": (),
    "failed": ("queued",),
}
MIME_MODES = {
    "text/plain": "local_first",
    "application/pdf": "server_assist",
    "application/msword": "server_assist",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "server_assist",
    "image/png": "server_assist",
    "image/jpeg": "server_assist",
}
ACCEPTED_MIMES = ("application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "text/plain")
MAX_UPLOAD_BYTES = 18 * 1024 * 1024
MAX_TEXT_CHARS = 500_000
MAX_BASE64_CHARS = 28_000_000


def rules(spark: SparkSession) -> DataFrame:
    rows = [(r, f"pack:{r}", i, s, list(k), {x: f"{r} ({x})" for x in LANGUAGES}) for i, (r, s, k) in enumerate(RULES)]
    return spark.createDataFrame(rows, "rule_id string, source_ref string, rule_index int, severity string, keywords array<string>, title map<string,string>")


def keywords(spark: SparkSession) -> DataFrame:
    """The pack as match rows."""
    return rules(spark).select("rule_id", "rule_index", "severity", F.explode("keywords").alias("keyword"))


def dispute_markers(spark: SparkSession) -> DataFrame:
    rows = [(d, i, c, list(m)) for i, (d, c, m) in enumerate(DISPUTES)]
    return spark.createDataFrame(rows, "dispute_id string, dispute_index int, confidence double, markers array<string>")


def section_markers(spark: SparkSession) -> DataFrame:
    rows = [(s, m.lower()) for s, ms in SECTIONS.items() for m in ms]
    return spark.createDataFrame(rows, "section string, marker string")


def values(rows) -> str:
    """Rows as a SQL VALUES list."""
    put = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(put, r)) + ")" for r in rows) + ")"


KEYWORDS_SQL = values([(r, i, s, k) for i, (r, s, ks) in enumerate(RULES) for k in ks]) + " AS k(rule_id, rule_index, severity, keyword)"
MARKERS_SQL = values([(d, i, c, m) for i, (d, c, ms) in enumerate(DISPUTES) for m in ms]) + " AS m(dispute_id, dispute_index, confidence, marker)"
SECTIONS_SQL = values([(s, m) for s, ms in SECTIONS.items() for m in ms]) + " AS s(section, marker)"
RANK_SQL = values(list(SEVERITY_RANK.items())) + " AS r(severity, rank)"
LABEL_SQL = values([(x, s, t) for x, by in SEVERITY_LABEL.items() for s, t in by.items()]) + " AS l(language, severity, label)"
PLACEHOLDER_SQL = values(list(PLACEHOLDER.items())) + " AS p(language, placeholder)"
TRANSITION_SQL = values([(a, b) for a, bs in TRANSITIONS.items() for b in bs]) + " AS t(from_status, to_status)"

# Fixed labels of report types, and of a risk without a clause.
TYPE_LABEL = {
    "ru": {"other": "Договор", "pdf": "PDF-договор", "docx": "DOCX-договор", "text": "Текстовый договор"},
    "en": {"other": "Contract", "pdf": "PDF contract", "docx": "DOCX contract", "text": "Text contract"},
    "it": {"other": "Contratto", "pdf": "Contratto PDF", "docx": "Contratto DOCX", "text": "Contratto testuale"},
    "fr": {"other": "Contrat", "pdf": "Contrat PDF", "docx": "Contrat DOCX", "text": "Contrat texte"},
}
TYPE_OF_MIME = dict(zip(ACCEPTED_MIMES, ("pdf", "docx", "text"), strict=True))
UNKNOWN_CLAUSE = {"ru": "Без номера пункта", "en": "Clause reference not found", "it": "Riferimento clausola non trovato", "fr": "Référence de clause introuvable"}
TYPE_LABEL_SQL = values([(x, k, t) for x, by in TYPE_LABEL.items() for k, t in by.items()]) + " AS y(language, kind, label)"
UNKNOWN_SQL = values(list(UNKNOWN_CLAUSE.items())) + " AS u(language, unknown)"
SHORT_PDF_CHARS = 160

# Wording of reports, our own: titles, notes and advice by rule ("none": nothing was found), and notices by code.
RULE_TITLE = {
    "penalty": {"ru": "Неустойка", "en": "Penalty", "it": "Penale", "fr": "Pénalité"},
    "one_sided": {"ru": "Одностороннее право", "en": "One-sided right", "it": "Diritto unilaterale", "fr": "Droit unilatéral"},
    "secrecy": {"ru": "Конфиденциальность", "en": "Confidentiality", "it": "Riservatezza", "fr": "Confidentialité"},
    "indemnity": {"ru": "Возмещение убытков", "en": "Indemnity", "it": "Manleva", "fr": "Indemnisation"},
    "none": {"ru": "Явных рисков не найдено", "en": "No evident risk", "it": "Nessun rischio evidente", "fr": "Aucun risque évident"},
}
RULE_NOTE = {
    "penalty": {"ru": "Пункт устанавливает санкции.", "en": "The clause sets sanctions.", "it": "La clausola fissa sanzioni.", "fr": "La clause fixe des sanctions."},
    "one_sided": {"ru": "Пункт даёт право одной стороне.", "en": "The clause gives one party a right of its own.", "it": "La clausola dà un diritto a una sola parte.", "fr": "La clause donne un droit à une seule partie."},
    "secrecy": {"ru": "Пункт требует хранить тайну.", "en": "The clause asks for secrecy.", "it": "La clausola chiede il segreto.", "fr": "La clause impose le secret."},
    "indemnity": {"ru": "Пункт возлагает возмещение убытков.", "en": "The clause shifts losses.", "it": "La clausola trasferisce le perdite.", "fr": "La clause transfère les pertes."},
    "none": {"ru": "Правила ничего не нашли.", "en": "No rule found anything.", "it": "Nessuna regola ha trovato nulla.", "fr": "Aucune règle n'a rien trouvé."},
}
MITIGATION = {
    "penalty": {"ru": "Ограничьте размер санкций.", "en": "Ask for a ceiling.", "it": "Chiedere un tetto.", "fr": "Demander un plafond."},
    "one_sided": {"ru": "Согласуйте взаимность.", "en": "Ask for the same right.", "it": "Chiedere lo stesso diritto.", "fr": "Demander le même droit."},
    "secrecy": {"ru": "Уточните срок и объём.", "en": "Settle term and scope.", "it": "Definire durata e oggetto.", "fr": "Préciser durée et portée."},
    "indemnity": {"ru": "Исключите косвенные убытки.", "en": "Leave out indirect losses.", "it": "Escludere i danni indiretti.", "fr": "Exclure les pertes indirectes."},
    "none": {"ru": "Прочтите договор целиком.", "en": "Read the whole contract.", "it": "Leggere tutto il contratto.", "fr": "Lire tout le contrat."},
}
ANALYZED = {"ru": "Договор разобран.", "en": "The contract was analysed.", "it": "Il contratto è stato analizzato.", "fr": "Le contrat a été analysé."}
SAFE_MODE = {
    "ru": "Разбор не удался, отчёт составлен без него.", "en": "The analysis failed; this report was made without it.",
    "it": "L'analisi non è riuscita; il rapporto ne fa a meno.", "fr": "L'analyse a échoué ; ce rapport est fait sans elle.",
}
REVIEW_TITLE = {"ru": "Нужна ручная проверка", "en": "Review by hand needed", "it": "Serve una verifica manuale", "fr": "Vérification manuelle nécessaire"}
REVIEW_ADVICE = {
    "ru": "Проверьте договор сами или отправьте его текстом.", "en": "Read the contract yourself, or send it as text.",
    "it": "Leggere il contratto o inviarlo come testo.", "fr": "Lire le contrat ou l'envoyer en texte.",
}
NOTICES = {
    "missing_payload": {"ru": "Нет содержимого.", "en": "Nothing was sent.", "it": "Nulla è stato inviato.", "fr": "Rien n'a été envoyé."},
    "invalid_base64": {"ru": "Содержимое не читается.", "en": "The payload can't be decoded.", "it": "Il contenuto non è decodificabile.", "fr": "Le contenu ne peut être décodé."},
    "invalid_utf8": {"ru": "Часть знаков потеряна.", "en": "Some characters were lost.", "it": "Alcuni caratteri sono andati persi.", "fr": "Des caractères ont été perdus."},
    "text_too_long": {"ru": "Текст слишком длинный.", "en": "The text is too long.", "it": "Il testo è troppo lungo.", "fr": "Le texte est trop long."},
    "payload_too_long": {"ru": "Файл слишком велик.", "en": "The file is too large.", "it": "Il file è troppo grande.", "fr": "Le fichier est trop grand."},
    "no_clauses": {"ru": "Пунктов не найдено.", "en": "There are no clauses.", "it": "Non ci sono clausole.", "fr": "Il n'y a pas de clauses."},
    "empty_text": {"ru": "Текст пуст.", "en": "The text is empty.", "it": "Il testo è vuoto.", "fr": "Le texte est vide."},
    "limited_pdf_text": {"ru": "Из PDF извлечено мало текста.", "en": "The PDF gave little text.", "it": "Il PDF ha dato poco testo.", "fr": "Le PDF a donné peu de texte."},
    "legacy_document": {"ru": "Старый формат документа.", "en": "The document has an old format.", "it": "Il documento ha un formato vecchio.", "fr": "Le document a un ancien format."},
}


def words_sql(tables: dict[str, dict[str, str]]) -> str:
    """(code, language, words) of a table of wording by code."""
    return values([(k, x, t) for k, by in tables.items() for x, t in by.items()])


# Wording of briefs, our own: what stands before the role, the number of clauses and the end; before each part; and where there is none.
BRIEF = {
    "for": {"ru": "Договор для стороны ", "en": "Contract for ", "it": "Contratto per ", "fr": "Contrat pour "},
    "with": {"ru": ", пунктов: ", "en": " with clauses: ", "it": ", clausole: ", "fr": ", clauses : "},
    "own": {"ru": "Обязанности: ", "en": "Obligations: ", "it": "Obblighi: ", "fr": "Obligations : "},
    "any": {"ru": "Общие обязанности: ", "en": "General obligations: ", "it": "Obblighi generali: ", "fr": "Obligations générales : "},
    "other": {"ru": "Другая сторона: ", "en": "Counterparty: ", "it": "Controparte: ", "fr": "Autre partie : "},
    "payment_terms": {"ru": "Оплата: ", "en": "Payment: ", "it": "Pagamento: ", "fr": "Paiement : "},
    "deadlines": {"ru": "Сроки: ", "en": "Deadlines: ", "it": "Scadenze: ", "fr": "Délais : "},
    "penalties": {"ru": "Санкции: ", "en": "Penalties: ", "it": "Penali: ", "fr": "Pénalités : "},
    "disputes": {"ru": "Спорных пунктов: ", "en": "Disputed clauses: ", "it": "Clausole controverse: ", "fr": "Clauses litigieuses : "},
    "nothing": {"ru": "Особых условий нет.", "en": "Nothing stands out.", "it": "Nulla di particolare.", "fr": "Rien de particulier."},
    "clauses": {"ru": "Пунктов: ", "en": "Clauses: ", "it": "Clausole: ", "fr": "Clauses : "},
    "risks": {"ru": ", рисков: ", "en": ", risks: ", "it": ", rischi: ", "fr": ", risques : "},
    "role_missing": {"ru": "Роль не названа в договоре: ", "en": "The contract does not name the role: ", "it": "Il contratto non nomina il ruolo: ", "fr": "Le contrat ne nomme pas le rôle : "},
}


def brief_sql(part: str, language: str = "language") -> str:
    """The words of a part as SQL over a language."""
    return f"CASE {language} " + " ".join(f"WHEN '{x}' THEN '" + t.replace("'", "''") + "'" for x, t in BRIEF[part].items()) + " END"

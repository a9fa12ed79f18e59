"""Pack of the deep analysis: signals, rules and dispute markers as data.

The phrases are a starter wording of our own, in the form in which text is searched (lower case, marks
folded); a user brings a pack of theirs (see packs). Score and passing condition of each rule are fixed values, stated
as SQL over the numbers of phrases found, by signal name, which the queries' counterparts use, and below as tables, which the queries use. Beside signals there are:
role (forms of the chosen role found), subject (the role opens an action), num and mon (the excerpt has a
number, an amount).
"""

from __future__ import annotations

SIGNALS = {
    "role_action": ("shall", "must", "undertakes", "pays", "обязан", "обязуется"),
    "unilateral_support": ("unilaterally", "at its sole discretion", "without consent"),
    "unilateral_change": ("change the price", "amend the terms", "modify"),
    "remedial": ("after notice of breach", "to cure"),
    "unilateral_negative": ("by mutual consent", "both parties may"),
    "penalty_support": ("penalty", "fine of", "неустойк"),
    "penalty_trigger": ("for each day", "for delay", "за каждыи день"),
    "liability_support": ("liable", "indemnif", "damages"),
    "liability_aggravating": ("in full", "unlimited"),
    "liability_hard": ("all losses", "lost profit", "without limit"),
    "liability_neutral": ("limited to", "mutual liability"),
    "acceptance_support": ("acceptance", "acceptance act"),
    "acceptance_escalation": ("deemed accepted", "accepted without objection"),
    "acceptance_negative": ("annex", "form of act"),
    "acceptance_clarity": ("within five days", "written reasons", "signed by both"),
    "acceptance_transfer": ("risk passes", "title passes", "transfer of goods"),
    "payment_support": ("payment", "pay the invoice", "оплат"),
    "payment_hard": ("full prepayment", "before delivery", "immediately"),
    "payment_neutral": ("by agreed schedule", "in equal parts"),
    "renewal_support": ("renewed automatically", "extended for the same term"),
    "jurisdiction_support": ("disputes", "claims"),
    "jurisdiction_hard": ("court of the seller", "foreign court"),
    "jurisdiction_neutral": ("court of the defendant",),
    "confidentiality_support": ("confidential", "secret"),
    "confidentiality_hard": ("for an unlimited term", "any information"),
    "confidentiality_neutral": ("publicly known",),
    "personal_data_support": ("personal data",),
    "personal_data_hard": ("to third parties", "across borders"),
    "force_majeure_support": ("force majeure",),
    "force_majeure_hard": ("any circumstance", "without notice"),
    "force_majeure_clarity": ("certificate of the chamber",),
    "collateral_support": ("collateral", "pledge"),
    "collateral_hard": ("out of court", "sell the pledge"),
    "guarantee_support": ("independent guarantee",),
    "guarantee_hard": ("on first demand", "irrevocabl"),
    "insurance_support": ("insurance", "insured event"),
    "insurance_hard": ("is excluded", "not covered"),
    "ip_support": ("exclusive right", "intellectual property"),
    "ip_hard": ("in all territories", "without further payment"),
    "operational_support": ("provide access", "depends on"),
    "operational_hard": ("at its own expense", "no extension"),
    "essential_terms": ("price", "terms", "scope"),
    "open_ended": ("to be agreed", "set by agreement of the parties"),
    "framework": ("framework agreement",),
    "amendment": ("amendments are made in writing",),
    "routine": ("working order",),
    "precise_timeline": ("calendar days", "business days", "days from"),
    "reference_neutral": ("reference only", "example", "not part of this agreement", "справочно"),
    "obligations": ("shall", "must", "undertakes", "обязан", "обязуется"),
    "payment": ("pay", "payment", "invoice", "оплат"),
    "deadlines": ("within", "days", "срок"),
    "exclude": ("example", "annex"),
    "carry_lead": ("following", "as follows", "следующее"),
}

# Severity, score and passing condition of each rule. Keywords are of our own pack.
RULES = (
    ("unilateral", "high", ("unilaterally", "sole discretion"),
     "4*unilateral_support + 4*unilateral_change + role + role_action - 6*remedial - 8*unilateral_negative",
     "total >= 8 AND remedial = 0 AND unilateral_change >= 1 AND unilateral_negative = 0"),
    ("penalties", "high", ("penalty", "fine of", "неустойк"),
     "4*penalty_support + 3*penalty_trigger + CASE WHEN mon THEN 3 ELSE 0 END + CASE WHEN num THEN 1 ELSE 0 END"
     " + CASE WHEN role > 0 AND subject THEN role WHEN role > 0 THEN -least(2*role, 4) WHEN role_action > 0 THEN -6 ELSE 0 END",
     "total >= 8 AND penalty_support >= 1 AND (penalty_trigger > 0 OR norm_mon)"),
    ("liability", "medium", ("liable", "indemnif", "damages"),
     "2*liability_support + 5*liability_aggravating + 4*liability_hard + role_action + CASE WHEN mon THEN 2 ELSE 0 END - 4*liability_neutral"
     " + CASE WHEN role > 0 AND subject THEN role WHEN role > 0 THEN -least(2*role, 4) WHEN role_action > 0 THEN -5 ELSE 0 END",
     "total >= 7 AND liability_support >= 1 AND liability_hard >= 1"),
    ("acceptance", "medium", ("acceptance", "accepted"),
     "3*acceptance_support + 5*acceptance_escalation + role_action + CASE WHEN num THEN 1 ELSE 0 END - 4*acceptance_negative"
     " - CASE WHEN acceptance_escalation > 0 THEN 2 ELSE 5 END * acceptance_clarity - 3*acceptance_transfer",
     "total >= 7 AND acceptance_support >= 1 AND (acceptance_clarity < 2 OR acceptance_escalation > 0) AND acceptance_transfer < 3"),
    ("payment-deadlines", "medium", ("payment", "prepayment", "оплат"),
     "3*payment_support + 5*payment_hard + role + role_action + CASE WHEN mon THEN 2 ELSE 0 END + CASE WHEN num THEN 1 ELSE 0 END - 4*payment_neutral",
     "total >= 8 AND payment_support >= 1 AND payment_hard >= 1"),
    ("auto-renewal", "medium", ("renewed", "extended"),
     "4*renewal_support + CASE WHEN num THEN 1 ELSE 0 END", "total >= 7"),
    ("jurisdiction-claim", "medium", ("court", "claims"),
     "3*jurisdiction_support + 5*jurisdiction_hard + role + role_action + CASE WHEN num THEN 1 ELSE 0 END - 6*jurisdiction_neutral",
     "total >= 8 AND jurisdiction_support >= 1 AND jurisdiction_hard >= 1 AND jurisdiction_neutral = 0"),
    ("confidentiality", "medium", ("confidential",),
     "3*confidentiality_support + 4*confidentiality_hard + role + role_action - 6*confidentiality_neutral",
     "total >= 8 AND confidentiality_support >= 1 AND confidentiality_neutral = 0"),
    ("personal-data", "high", ("personal data",),
     "4*personal_data_support + 4*personal_data_hard + role + role_action", "total >= 8 AND personal_data_support >= 1"),
    ("force-majeure", "medium", ("force majeure",),
     "3*force_majeure_support + 5*force_majeure_hard + role_action - 3*force_majeure_clarity",
     "total >= 8 AND force_majeure_support >= 1 AND force_majeure_hard >= 1"),
    ("collateral-enforcement", "high", ("pledge", "collateral"),
     "3*collateral_support + 5*collateral_hard + role + role_action + CASE WHEN mon THEN 2 ELSE 0 END",
     "total >= 8 AND collateral_support >= 1 AND (collateral_hard >= 1 OR role_action >= 1)"),
    ("independent-guarantee", "high", ("guarantee",),
     "4*guarantee_support + 5*guarantee_hard + role + role_action + CASE WHEN mon THEN 2 ELSE 0 END",
     "total >= 8 AND guarantee_support >= 1 AND (guarantee_hard >= 1 OR norm_mon)"),
    ("insurance-exclusions", "medium", ("insurance", "insured"),
     "3*insurance_support + 5*insurance_hard + role + role_action", "total >= 8 AND insurance_support >= 1 AND insurance_hard >= 1"),
    ("ip-scope", "medium", ("exclusive right", "intellectual"),
     "3*ip_support + 4*ip_hard + role + role_action", "total >= 8 AND ip_support >= 1 AND (ip_hard >= 1 OR open_ended >= 1)"),
    ("operational-dependencies", "medium", ("provide access", "depends on"),
     "3*operational_support + 5*operational_hard + role + role_action", "total >= 8 AND operational_support >= 1 AND operational_hard >= 1"),
)
DISPUTES = (
    ("reasonable-time", ("reasonable time", "promptly"), "CASE WHEN precise_timeline > 0 THEN -6 ELSE 3 END", "total >= 3 AND precise_timeline = 0"),
    ("future-agreement", ("to be agreed", "by agreement of the parties"),
     "3*essential_terms + 5*open_ended - 2*framework - 5*amendment - 6*routine - CASE WHEN precise_timeline > 0 THEN 2 ELSE 0 END",
     "total >= 6 AND essential_terms > 0 AND open_ended > 0 AND amendment = 0 AND routine = 0"),
    ("discretionary-right", ("is entitled", "sole discretion"), "CASE WHEN unilateral_support > 0 THEN 3 ELSE 0 END - 4*remedial", "total >= 4 AND remedial = 0"),
)

# The same scores and conditions as data. Weights: feature, weight, cap of the feature, and bounds (feature, from, to) that have
# to hold. Thresholds: of each list one bound has to hold.
def _acting(otherwise: int) -> list[tuple]:
    """Terms of a rule that counts for the role that acts, and against one that is only named, or when another acts."""
    return [("role", 1, None, [("subject", 1, None)]), ("role", -2, 2, [("subject", None, 0)]), ("one", otherwise, None, [("role", None, 0), ("role_action", 1, None)])]


WEIGHTS = {
    "unilateral": [("unilateral_support", 4), ("unilateral_change", 4), ("role", 1), ("role_action", 1), ("remedial", -6), ("unilateral_negative", -8)],
    "penalties": [("penalty_support", 4), ("penalty_trigger", 3), ("mon", 3), ("num", 1), *_acting(-6)],
    "liability": [("liability_support", 2), ("liability_aggravating", 5), ("liability_hard", 4), ("role_action", 1), ("mon", 2), ("liability_neutral", -4), *_acting(-5)],
    "acceptance": [("acceptance_support", 3), ("acceptance_escalation", 5), ("role_action", 1), ("num", 1), ("acceptance_negative", -4),
                   ("acceptance_clarity", -2, None, [("acceptance_escalation", 1, None)]), ("acceptance_clarity", -5, None, [("acceptance_escalation", None, 0)]), ("acceptance_transfer", -3)],
    "payment-deadlines": [("payment_support", 3), ("payment_hard", 5), ("role", 1), ("role_action", 1), ("mon", 2), ("num", 1), ("payment_neutral", -4)],
    "auto-renewal": [("renewal_support", 4), ("num", 1)],
    "jurisdiction-claim": [("jurisdiction_support", 3), ("jurisdiction_hard", 5), ("role", 1), ("role_action", 1), ("num", 1), ("jurisdiction_neutral", -6)],
    "confidentiality": [("confidentiality_support", 3), ("confidentiality_hard", 4), ("role", 1), ("role_action", 1), ("confidentiality_neutral", -6)],
    "personal-data": [("personal_data_support", 4), ("personal_data_hard", 4), ("role", 1), ("role_action", 1)],
    "force-majeure": [("force_majeure_support", 3), ("force_majeure_hard", 5), ("role_action", 1), ("force_majeure_clarity", -3)],
    "collateral-enforcement": [("collateral_support", 3), ("collateral_hard", 5), ("role", 1), ("role_action", 1), ("mon", 2)],
    "independent-guarantee": [("guarantee_support", 4), ("guarantee_hard", 5), ("role", 1), ("role_action", 1), ("mon", 2)],
    "insurance-exclusions": [("insurance_support", 3), ("insurance_hard", 5), ("role", 1), ("role_action", 1)],
    "ip-scope": [("ip_support", 3), ("ip_hard", 4), ("role", 1), ("role_action", 1)],
    "operational-dependencies": [("operational_support", 3), ("operational_hard", 5), ("role", 1), ("role_action", 1)],
    "reasonable-time": [("one", -6, None, [("precise_timeline", 1, None)]), ("one", 3, None, [("precise_timeline", None, 0)])],
    "future-agreement": [("essential_terms", 3), ("open_ended", 5), ("framework", -2), ("amendment", -5), ("routine", -6), ("one", -2, None, [("precise_timeline", 1, None)])],
    "discretionary-right": [("one", 3, None, [("unilateral_support", 1, None)]), ("remedial", -4)],
}


def _total(n: int, *found: str) -> list[list[tuple]]:
    """The total, and each of the features found."""
    return [[("total", n, None)], *[[(f, 1, None)] for f in found]]


THRESHOLDS = {
    "unilateral": [*_total(8, "unilateral_change"), [("remedial", None, 0)], [("unilateral_negative", None, 0)]],
    "penalties": [*_total(8, "penalty_support"), [("penalty_trigger", 1, None), ("norm_mon", 1, None)]],
    "liability": _total(7, "liability_support", "liability_hard"),
    "acceptance": [*_total(7, "acceptance_support"), [("acceptance_clarity", None, 1), ("acceptance_escalation", 1, None)], [("acceptance_transfer", None, 2)]],
    "payment-deadlines": _total(8, "payment_support", "payment_hard"),
    "auto-renewal": _total(7),
    "jurisdiction-claim": [*_total(8, "jurisdiction_support", "jurisdiction_hard"), [("jurisdiction_neutral", None, 0)]],
    "confidentiality": [*_total(8, "confidentiality_support"), [("confidentiality_neutral", None, 0)]],
    "personal-data": _total(8, "personal_data_support"),
    "force-majeure": _total(8, "force_majeure_support", "force_majeure_hard"),
    "collateral-enforcement": [*_total(8, "collateral_support"), [("collateral_hard", 1, None), ("role_action", 1, None)]],
    "independent-guarantee": [*_total(8, "guarantee_support"), [("guarantee_hard", 1, None), ("norm_mon", 1, None)]],
    "insurance-exclusions": _total(8, "insurance_support", "insurance_hard"),
    "ip-scope": [*_total(8, "ip_support"), [("ip_hard", 1, None), ("open_ended", 1, None)]],
    "operational-dependencies": _total(8, "operational_support", "operational_hard"),
    "reasonable-time": [*_total(3), [("precise_timeline", None, 0)]],
    "future-agreement": [*_total(6, "essential_terms", "open_ended"), [("amendment", None, 0)], [("routine", None, 0)]],
    "discretionary-right": [*_total(4), [("remedial", None, 0)]],
}

# Parties whose burden is no risk of the chosen role, and wording that says who bears or gains.
PARTIES = ("buyer", "seller", "supplier", "contractor", "исполнитель", "заказчик")
BURDEN = {"liability": ("indemnif", "is liable", "compensates"), "penalties": ("pays a penalty", "shall pay a penalty")}
BENEFIT = {"liability": ("is entitled to compensation", "recovers"), "penalties": ("is entitled to a penalty",), "unilateral": ("may", "is entitled")}
GENERIC_BENEFIT = {"liability": ("liability is excluded",), "penalties": ("no penalty is due",)}
RECOVERY_EXCLUDED = ("not recoverable", "recovery is excluded")
RECOVERY_SUBJECT = ("lost profit", "damages", "losses")

# What a reference fragment begins with, or holds.
REFERENCE_STARTS = ("reference only", "example", "sample clause", "справочно", "пример", "образец")
REFERENCE_PARTS = ("not part of this agreement", "не является частью договора")

# Endings of role names and the stems' case endings.
ROLE_ENDINGS = (
    ("ин", ("ина", "ину", "ином", "ине")),
    ("тель", ("теля", "телю", "телем", "теле")),
    ("чик", ("чика", "чику", "чиком", "чике")),
    ("ник", ("ника", "нику", "ником", "нике")),
    ("ец", ("ца", "цу", "цом", "це")),
    ("ка", ("ки", "ке", "ку", "кой")),
)

# Words by which long runs of letters are taken apart again (a starter list).
SEGMENT_WORDS = ("договор", "оплаты", "оплата", "товара", "товар", "срок", "сторона", "стороны", "поставки", "поставка", "заказчик", "исполнитель", "в", "и", "по", "на", "за", "работ", "услуг", "цена")

# What evidence within a report text begins with, by language.
EVIDENCE = {
    "en": ("detected in clause", "found in clause"),
    "ru": ("обнаружено в пункте",),
    "it": ("rilevato nella clausola",),
    "fr": ("détecté dans la clause",),
}

# The types of contracts, the first of equals first. Their words are of our own pack.
CONTRACT_TYPES = {
    "bankGuarantee": ("guarantee", "on first demand"),
    "surety": ("surety", "answers for the debtor"),
    "pledge": ("pledge", "collateral"),
    "insurance": ("insurance", "insured event"),
    "ipLicense": ("license", "exclusive right"),
    "rentLife": ("annuity", "for life"),
    "commission": ("commission agent", "on behalf of the principal"),
    "mandate": ("mandate", "power of attorney"),
    "bankAccount": ("bank account", "account holder"),
    "agency": ("agent", "principal"),
    "loan": ("loan", "interest rate"),
    "cession": ("assignment of claims", "assignee"),
    "education": ("education", "student"),
    "employment": ("employee", "employer"),
    "nda": ("confidential", "secret"),
    "contractWork": ("contractor", "work is done"),
    "supply": ("supplier", "deliver", "goods"),
    "rent": ("tenant", "landlord"),
    "services": ("services", "customer"),
}

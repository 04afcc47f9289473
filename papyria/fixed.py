"""Word lists, tables, patterns and limits that results depend on.

They are stated once, as they are; operators and the SQL they are checked against read them here. Patterns are in the
common part of the Java and RE2 dialects unless a comment says otherwise."""

# ------------------------------------------------------------------ forms and templates
PAGE_CONTINUATION = r"(?i)\bPAGE\s+(?:TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN|ELEVEN|TWELVE|THIRTEEN|FOURTEEN|FIFTEEN|SIXTEEN)\b"
#: Pattern and name, the more specific ones first. `(?!\d)` is Java only: RE2's \b before it says the same here.
TEMPLATE_PATTERNS = [
    (r"\b4[-.]?\s*750\b", "4-750"),
    (PAGE_CONTINUATION, "FD-36-cont"),
    (r"\bFD[-.]?\s*36\b(?!\d)", "FD-36"),
    (r"\bFD[-.]?\s*350\b", "FD-350"),
    (r"\bFD[-.]?\s*\d{1,3}\b", "FD-xxx"),
]
TEMPLATE_LINES = 20
DOC_KINDS = {"4-750": "deletion-sheet", "FD-36": "teletype", "FD-36-cont": "teletype-cont", "FD-350": "newspaper", "FD-xxx": "form"}
CONTINUATION_COMPATIBLE = ["teletype", "teletype-cont", "newspaper", "loose"]
COVER_MARKERS = r"(?i)FREEDOM\s+OF\s+INFORMATION|COVER\s+SHEET|THE\s+BEST\s+COPY"
COVER_PAGES = 3
CONTINUED_FROM = r"(?i)continued\s+from\b"
FORM_HEADER = r"(?i)^\s*(?:FD[-.]?\s*\d{1,3}|4[-.]?\s*750)\s*\(?(?:Rev|Mev|Rew|Hee|fev|Rey|Gev)"
FORM_HEADER_LINES = 6
FILE_NUMBER = r"\b88[-=~]?\s*\d{4,6}\b"
SHORT_STARTS = ["i", "a", "fm", "to", "re", "bt", "sa"]
SENTENCE_ENDS = [".", "!", "?", '"', "”"]

# ------------------------------------------------------------------ facts
DATE_PATTERNS = [
    r"(?i)\b(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]*\.?\s+\d{1,2},?\s+\d{4}\b",
    r"\b\d{1,2}/\d{1,2}/\d{2,4}\b",
    r"\b\d{1,2}-\d{1,2}-\d{2,4}\b",
    r"\b\d{4}-\d{1,2}-\d{1,2}\b",
]
DOLLAR = r"\$\s*\d[\d,]*(?:\.\d+)?"
CASE_NUMBER = r"\b\d{2,3}-\d{4,6}(?:-\d+)?\b"
FORM_REVISION_DATE = r"(?i)\(?\s*(?:Rev|Mev|Rew|Rey|Hee|fev|Gev|hev|Lee)\.?,?\s*\d{1,2}[-./]\d{1,2}[-./]\d{2,4}\b\)?"
PRINTING_MARK = r"(?i)\bGPO\b"
PRINTING_CODE = r"(?i)\bGPO\b\s*[:.\s][^\n]*"
EXEMPTION = r"(?i)\bb[1-9][A-E]?\b|\(b\)\s*\(\s*[1-9]\s*\)(?:\s*\(\s*[A-E]\s*\))?"
REDACTION_MARKER = r"(?i)\bb[1-9][A-E]?\b"
DELETION_REFERENCE = r"\b[A-Z]{2}\s*\d{2,3}-?\d{2,6}(?:-\d+)?(?:\s*p\.?\s*\d+)?"

# ------------------------------------------------------------------ redactions and lines
REDACTED = "[REDACTED]"
REDACTION_SYMBOLS = r"[@{}]|::"
REDACTION_SHARE = 0.3
SHORT_KEEPLIST = ["I", "A", "i", "a", "FM", "TO", "RE", "BT", "OK", "USA", "FBI", "AKA", "SA"]
VOWELS_ONLY = "^[aeiouAEIOU]+$"
SHORT_CAPS = "^[A-Z]{2,3}$"
SOUP_RATIO = 0.40
STAMP_WORDS = "SEARCHED|SERIALIZED|SERIALIZEO|INDEXED|FILED"
STAMP = rf"(?i)\b(?:{STAMP_WORDS})\b"
STAMP_ALONE = rf"(?i)^(?:{STAMP_WORDS})$"
STAMP_WITH_BLANK = rf"(?i)\b(?:{STAMP_WORDS})[_\s]*_+"
END_OF_TEXT = r"\bBT\b"
TELETYPE_FURNITURE = [
    r"(?i)^.*\bFD[-.]?\s*36\b.*$",
    r"(?i)^.*\bTRANSMIT\s+VIA\b.*$",
    r"(?i)^.*\bPRECEDENCE\b.*\bCLASSIFICATION\b.*$",
    r"(?i)^.*\b(?:Teletype|Facsimile|Airtel|TOP\s+SECRET|CONFIDENTIAL|[A-Z]{0,3}EFTO|[A-Z]?UEF\s+TO)\b.*$",
    r"(?i)^\s*[\W]*(?:\s*\b[A-Za-z]{1,4}\b\s*[\W]*){0,5}\bFBI\b[\W]*$",
    r"(?i)^\s*[\[(].{0,3}[\])]\s*CLEAR\b.*$",
    r"(?i)^.*\bGPO\b\s*[:.\s].*$",
    r"(?i)^.*\(\s*Number\s*\).*\(\s*Time\s*\).*$",
    r"(?i)^.*\bTransmitted\b\s*_+.*$",
    r"(?i)^.*\bApproved\b\s*_+.*$",
]
ROUTING_PROVENANCE = [
    r"(?i)^\s*(?:FM|TO|RE)\s+[A-Z]",
    r"^\s*[A-Z][A-Z\s]{2,}\s+(?:ROUTINE|PRIORITY|IMMEDIATE)\s*$",
    r"(?i)\bSSAN\s+\d{3}",
    r"(?i)^\s*Date\s*[:.]?\s*\d{1,2}[-./]\d{1,2}[-./]\d{2,4}\b",
]
CLIPPING_FIELDS = {
    "newspaper": r"(?m)^(?:Name\s+of\s+[Nn]ewspaper|Newspaper)\s*[:.;\-]\s*([^\n]+)",
    "city_state": r"(?m)^(?:City\s+and\s+[Ss]tate|City/State)\s*[:.;\-]\s*([^\n]+)",
    "date": r"(?m)^\s*Date\s*[:.;\-]\s*([^\n]+)",
    "edition": r"(?m)^\s*Edition\s*[:.;\-]\s*([^\n]+)",
    "author": r"(?m)^\s*Author\s*[:.;\-]\s*([^\n]+)",
    "title": r"(?m)^\s*Title\s*[:.;\-]\s*([^\n]+)",
}
MOUNT_CLIPPING = r"(?m)^.*Mount\s+[Cc]lipping\s+in\s+[Ss]pace\s+[Bb]elow.*$"
GENERIC_FORM_HEADER = r"(?i)^\s*FD-?\d{2,3}\s*\(?(?:Rev|Mev)"

# ------------------------------------------------------------------ sentences and chunks
TARGET_TOKENS, WHOLE_TOKENS, OVERLAP_TOKENS, CARRY_WORDS = 500, 600, 100, 100
ABBREVIATIONS = ["Mr", "Mrs", "Ms", "Dr", "St", "Jr", "Sr", "AUSA", "SA", "SAC", "USAO", "Inc", "Co", "Ltd", "Corp", "No", "vs", "v", "Sgt", "Lt", "Capt", "Col", "Gen", "Maj"]

# ------------------------------------------------------------------ opinions
ARGUMENT_START = [
    r"as (?:his|a|another)\b[^.]*\bpoint on appeal",
    r"next\b[^.]{0,50}?\b(?:argues|contends|questions|asserts|maintains|claims)",
    r"appellant (?:also|next|further)\b",
    r"[a-z]+(?:'s)? next point on appeal",
]
#: For each surname of an appellant, in lower case.
ARGUMENT_BY_NAME = r"{name}(?:'s)? (?:next|also|further)\b"

# ------------------------------------------------------------------ answers
REFUSAL_PHRASES = ["do not contain", "does not contain", "don't contain", "doesn't contain", "no information about", "not in the provided", "cannot answer", "unable to answer"]

# ------------------------------------------------------------------ audits
FACT_SIGNALS = {
    "date": r"(?i)\b(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]*\.?\s+\d{1,2},?\s+\d{4}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b|\b\d{1,2}-\d{1,2}-\d{2,4}\b",
    "dollar": DOLLAR,
    "case_number": CASE_NUMBER,
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"\b\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "height_weight": r"(?i)\b\d['’]\s*\d{0,2}\"?\b|\b\d{2,3}\s*LBS?\b",
    "routing": r"\b(?:FM|TO)\s+[A-Z][A-Z\s]{2,}\b",
    "place": r"(?i)\b(?:UTAH|COLORADO|WASHINGTON|VERMONT|ASPEN|SALT\s+LAKE|SEATTLE|DENVER|BURLINGTON|GLENWOOD|TALLAHASSEE|FLORIDA|PENSACOLA|MIAMI)\b",
    "name": r"(?i)\bTHEODORE\b|\bTED\b",
    "title": r"(?i)\b(?:AUSA|SA|SAC|USA|FBI|U\.\s*S\.\s*MAGISTRATE|COUNTY\s+ATTORNEY|JUDGE|DETECTIVE|SHERIFF|MARSHAL)\b",
    "legal": r"(?i)\b(?:TITLE\s+\d+|U\.\s*S\.\s*CODE|SECTION\s+\d+|VIOLATION|WARRANT|COMPLAINT|INDICTMENT|FUGITIVE|UFAC|UNLAWFUL\s+FLIGHT|ESCAPE|ARREST|CONVICTION)\b",
    "proper_noun_run": r"\b(?:[A-Z][a-z]+\s+){2,}[A-Z][a-z]+\b",
}
FURNITURE_LEFTOVERS = r"(?i)\b(?:FD-?\s*36|FD-?\s*350|TRANSMIT\s+VIA|PRECEDENCE|CLASSIFICATION|Mev\.?\s*\d|Rev\.?\s*\d|OEFTO|UEFTO|GPO\s*:|\(Number\)|\(Time\)|Mount\s+Clipping)\b"
#: The back reference is Java only.
REPEATED_CHARACTER = r"(.)\1{5,}"
TINY_WORDS = r"(?:\b\w{1,2}\b[\s,]+){5,}"

"""The shapes of the built-in categories in RE2's syntax, for the SQL that scans are compared with.

Written out by themselves, not made from the patterns that Spark runs, so that a slip in one of the two shows.
"""

from __future__ import annotations

# Fixed values: (category, country or "", shape); a shape with a group in front matches one character too many there.
RE2 = [
    ("email", "", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("url", "", r"""https?://[^\s<>"')\]]+|\bwww\.[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+(?:/(?:[^\s<>"')\],]*[^\s<>"')\],.;:!?])?)?"""),
    ("iban", "", r"\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?\b"),
    ("vat", "LU", r"\bLU[0-9]{8}\b"),
    ("vat", "FR", r"\bFR[0-9A-Z]{2}[0-9]{9}\b"),
    ("vat", "DE", r"\bDE[0-9]{9}\b"),
    ("vat", "ES", r"\bES[A-Z0-9][0-9]{7}[A-Z0-9]\b"),
    ("vat", "UK", r"\bGB(?:[0-9]{9}|[0-9]{12})\b"),
    ("matricule", "LU", r"(?:^|[^0-9])[0-9]{13}"),
    ("phone", "LU", r"(?:\+352|00352)(?:[ .\-/]?[0-9]{1,4}){2,5}"),
    ("phone", "FR", r"(?:\+33|0033)(?:[ .\-/]?[0-9])(?:[ .\-/]?[0-9]{2}){4}|\b0[1-9](?:[ .\-/]?[0-9]{2}){4}\b"),
    ("phone", "DE", r"(?:\+49|0049)(?:[ .\-/]?[0-9]{1,4}){3,5}|\b0[1-9][0-9]{1,4}(?:[ .\-/]?[0-9]{2,4}){2,3}\b"),
    ("phone", "ES", r"(?:\+34|0034)(?:[ .\-/]?[0-9]{3}){3}\b|\b[6789][0-9]{2}(?:[ .\-/]?[0-9]{3}){2}\b"),
    ("phone", "UK", r"(?:\+44|0044)(?:[ .\-/]?[0-9]{2,4}){3,4}|\b0(?:7[0-9]{3}|1[0-9]{2,4}|2[0-9]{2,4})(?:[ .\-/]?[0-9]{3,4}){2}\b"),
    ("amount", "", r"(?:€|EUR|USD|GBP|CHF|\$|£)[\s\x{00a0}\x{202f}\x{2009}]?[0-9]{1,3}(?:[.,'\x{00a0}\x{202f}\x{2009} ][0-9]{3})*(?:[.,][0-9]{1,2})?[kKmM]?"
     r"|\b[0-9]{1,3}(?:[.,'\x{00a0}\x{202f}\x{2009} ][0-9]{3})*(?:[.,][0-9]{1,2})?[kKmM]?[\s\x{00a0}\x{202f}\x{2009}]?(?:€|EUR|USD|GBP|CHF|\$|£)"),
    ("date", "", r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b|\b[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}\b"
     r"|\b[0-9]{1,2}(?:st|nd|rd|th)?\s(?:January|February|March|April|May|June|July|August|September|October|November|December|janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre)\s[0-9]{4}\b"
     r"|\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s[0-9]{1,2},?\s[0-9]{4}\b"),
    ("credit_card", "", r"\b[0-9]{13,19}\b|\b[0-9]{4}(?:[ \-][0-9]{4,6}){2,3}[0-9]?\b"),
    ("uk_nhs", "UK", r"\b[0-9]{3}[ \-]?[0-9]{3}[ \-]?[0-9]{4}\b|\b[0-9]{10}\b"),
    ("ip_address", "", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    ("ip_address", "", r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b|(?:[0-9A-Fa-f]{1,4}:){1,7}:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*"),
    ("mac_address", "", r"\b[0-9A-Fa-f]{2}(?:[:\-][0-9A-Fa-f]{2}){5}\b"),
    ("crypto", "", r"\b(?:[13][a-km-zA-HJ-NP-Z1-9]{25,34}|bc1[a-z0-9]{25,62})\b"),
    ("database_uri", "", r"""\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp|mssql|jdbc:[a-z]+)://[^\s<>"')\]]+"""),
    ("de_steuer_id", "DE", r"(?:^|[^0-9])[1-9][0-9]{10}"),
    ("bic", "", r"\b[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b"),
    ("postal_code", "LU", r"\bL-[0-9]{4}\b"),
    ("address", "LU FR", r"\b[0-9]{1,4}(?:[ ]?[a-zA-Z])?,[ ]?(?:rue|Rue|avenue|Avenue|boulevard|Boulevard|place|Place|impasse|Impasse|chemin|Chemin|route|Route|quai|Quai|allée|Allée|allee|Allee"
     r"|square|Square|street|Street|road|Road|lane|Lane|drive|Drive|esplanade|Esplanade|cours|Cours|montée|Montée|montee|Montee|voie|Voie|passage|Passage|rond-point|Rond-Point|cité|Cité|cite|Cite|val|Val|op|Op|am|Am)"
     r"(?:[ ](?:d[eu]s?|l[ae]|l'|d')?[ ]?[\pL][\pL'’\-]*){1,4}"),
    ("es_nif", "ES", r"\b[0-9]{8}[A-Za-z]\b"),
]

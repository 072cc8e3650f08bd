"""Categories, labels, countries and presets: the settings a run is resolved from."""

from __future__ import annotations

# Category names, their placeholder labels, countries and depth presets.
LABELS = {
    "entity_names": "ENTITY", "project_names": "PROJECT", "product_names": "PRODUCT", "brand_names": "BRAND",
    "person_names": "PERSON", "identifier_names": "ID", "other_names": "OTHER", "custom_patterns": "CUSTOM",
    "country_names": "COUNTRY", "nationality_names": "NATIONALITY", "business_sector_names": "BUSINESS_SECTOR",
    "email": "EMAIL", "phone": "PHONE", "iban": "IBAN", "vat": "VAT", "matricule": "NATIONAL_ID", "url": "URL",
    "amount": "AMOUNT", "date": "DATE", "credit_card": "CREDIT_CARD", "uk_nhs": "NHS", "ip_address": "IP",
    "mac_address": "MAC", "crypto": "CRYPTO", "database_uri": "DB_URI", "de_steuer_id": "DE_TAX_ID",
    "es_nif": "ES_NIF", "bic": "BIC", "postal_code": "POSTAL_CODE", "address": "ADDRESS",
}
PII_CATEGORIES = [
    "email", "url", "iban", "vat", "matricule", "phone", "amount", "date", "credit_card", "uk_nhs", "ip_address",
    "mac_address", "crypto", "database_uri", "de_steuer_id", "es_nif", "bic", "postal_code", "address",
]
VALUE_CATEGORIES = [
    "entity_names", "project_names", "product_names", "brand_names", "person_names", "identifier_names", "other_names",
    "custom_patterns", "country_names", "nationality_names", "business_sector_names",
]
COUNTRIES = ["LU", "FR", "DE", "ES", "UK"]
DEFAULT_COUNTRY = "LU"
#: Categories that exist in some countries only.
NATIONAL = {"matricule": ["LU"], "uk_nhs": ["UK"], "de_steuer_id": ["DE"], "es_nif": ["ES"], "postal_code": ["LU"], "address": ["LU", "FR"]}
COUNTRY_IDS = ["matricule", "de_steuer_id", "es_nif", "uk_nhs"]
ALWAYS_ON = ["custom_patterns"]
HARD = ["email", "url", "iban", "vat", "matricule", "phone", "credit_card", "uk_nhs", "ip_address", "mac_address", "crypto", "database_uri", "de_steuer_id", "es_nif", "bic"]
CONTEXTUAL = ["amount", "date", "address", "postal_code"]
SOFT_NAMES = ["entity_names", "project_names", "identifier_names"]
STANDARD_NAMES = ["person_names", "product_names", "brand_names"]
THOROUGH_NAMES = ["other_names", "country_names", "nationality_names", "business_sector_names"]
PRESETS = {
    ("patterns", "soft"): HARD,
    ("patterns", "standard"): HARD,
    ("patterns", "thorough"): HARD + CONTEXTUAL,
    ("names", "soft"): SOFT_NAMES,
    ("names", "standard"): SOFT_NAMES + STANDARD_NAMES,
    ("names", "thorough"): SOFT_NAMES + STANDARD_NAMES + THOROUGH_NAMES,
}
SCOPES = {"patterns": PII_CATEGORIES, "names": VALUE_CATEGORIES}
DEPTHS = ["soft", "standard", "thorough"]


def known_country(code: str) -> bool:
    return code in COUNTRIES


def applies_to(category: str, country: str) -> bool:
    """Does a pattern category exist in this country? An unknown category exists nowhere."""
    return category in PII_CATEGORIES and country in NATIONAL.get(category, COUNTRIES)


def depth_selection(depth: str, country: str = "") -> dict[str, bool]:
    """All categories with the preset's ones on; national identifiers only in their own country."""
    country = country or DEFAULT_COUNTRY
    on = {*PRESETS["patterns", depth], *PRESETS["names", depth], *ALWAYS_ON}
    on -= {c for c in COUNTRY_IDS if not applies_to(c, country)}
    return {c: c in on for c in PII_CATEGORIES + VALUE_CATEGORIES}


def default_selection(country: str = "") -> dict[str, bool]:
    return depth_selection("standard", country)


def apply_preset(selection: dict[str, bool], scope: str, depth: str, country: str = "") -> dict[str, bool]:
    """``selection`` with one scope set to a preset; the other scope stays."""
    wanted = depth_selection(depth, country)
    return selection | {c: wanted[c] for c in SCOPES[scope]}


def matching_presets(selection: dict[str, bool], scope: str, country: str = "") -> list[str]:
    """Depths whose preset equals the selection within the scope, in table order."""
    ignored = {*ALWAYS_ON, *(c for c in COUNTRY_IDS if not applies_to(c, country or DEFAULT_COUNTRY))}
    own = [c for c in SCOPES[scope] if c not in ignored]
    return [d for d in DEPTHS if all(bool(selection.get(c)) == (c in PRESETS[scope, d]) for c in own)]


def matching_preset(selection: dict[str, bool], scope: str, country: str = "") -> str:
    """The one name for the selection: standard where it fits, else the first fit, else ``""``."""
    found = matching_presets(selection, scope, country)
    return "standard" if "standard" in found else (found[0] if found else "")


def preset_key(scope: str, depth: str) -> str:
    return f"{scope}/depth/{depth}"


def split_preset_key(key: str) -> tuple[str, str] | None:
    parts = key.split("/")
    return (parts[0], parts[2]) if len(parts) == 3 and (parts[0], parts[2]) in PRESETS and parts[1] == "depth" else None


def all_preset_keys() -> list[str]:
    return [preset_key(s, d) for s, d in PRESETS]

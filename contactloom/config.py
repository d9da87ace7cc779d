"""Settings of the integration: names, rules, limits and match keys."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values: accepted formats, and the format each is stored as -------------------------
FORMATS = {
    "csv": "csv",
    "json": "json",
    "ndjson": "json",
    "pdf": "pdf",
    "xlsx": "xlsx",
    "xml": "xml",
}

# --- Fixed values: canonical field -> accepted source names (compared in lower case) ----------
ALIASES = {
    "email": ["email", "email_address", "e_mail", "emailaddress", "email address", "customer_email"],
    "phone": ["phone", "phone_number", "mobile", "telephone", "tel", "phone number", "mobile_number", "cell"],
    "first_name": ["first_name", "firstname", "given_name", "fname", "first name", "first", "given"],
    "last_name": ["last_name", "lastname", "surname", "family_name", "lname", "last name", "last", "family"],
    "full_name": ["full_name", "fullname", "name", "customer_name", "full name"],
    "address_line1": ["address", "address_line1", "address_line_1", "street", "street_address"],
    "address_line2": ["address_line2", "address_line_2", "apt", "suite"],
    "city": ["city", "town"],
    "state": ["state", "province", "region"],
    "postal_code": ["postal_code", "zip", "zip_code", "postcode", "postal code", "zip code"],
    "country": ["country", "nation"],
    "created_date": ["created_date", "date_created", "signup_date", "registration_date", "created_at", "join_date"],
}

# --- Fixed values: country spellings -> code --------------------------------------------------
COUNTRY_CODES = {
    "united states": "US", "usa": "US", "u.s.a.": "US", "us": "US",
    "united kingdom": "GB", "uk": "GB", "great britain": "GB",
    "canada": "CA", "ca": "CA",
    "australia": "AU", "au": "AU",
    "india": "IN", "in": "IN",
    "germany": "DE", "de": "DE",
    "france": "FR", "fr": "FR",
}

# --- Fixed values: field limits (code points) -------------------------------------------------
MAX_LENGTHS = {
    "email": 255,
    "phone": 30,
    "first_name": 100,
    "last_name": 100,
    "full_name": 255,
    "address_line1": 255,
    "address_line2": 255,
    "city": 100,
    "state": 100,
    "postal_code": 20,
    "country": 100,
}

# --- Fixed values: patterns -------------------------------------------------------------------
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
PHONE_PATTERN = r"^\+?[\d\s\-().]{7,20}$"
TEXT_PATTERNS = {
    "email": r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    "phone": r"\+?[\d][\d\s\-().]{6,18}[\d]",
    "postal_code": r"\b\d{5}(?:-\d{4})?\b",
}
LABEL_VALUE_PATTERN = r"([A-Za-z][A-Za-z _/\-]{0,30}?)\s*[:=]\s*(.+)"

# --- Fixed values: field lists ----------------------------------------------------------------
GOLDEN_FIELDS = [
    "email", "phone", "full_name", "first_name", "last_name", "address_line1",
    "address_line2", "city", "state", "postal_code", "country",
]
COMPLETENESS_FIELDS = [
    "email", "phone", "full_name", "first_name", "last_name", "city", "state", "country",
]
EXPORT_FIELDS = [
    "id", "email", "phone", "full_name", "first_name", "last_name",
    "address_line1", "address_line2", "city", "state", "postal_code",
    "country", "source_count", "is_duplicate", "created_at", "updated_at",
]
SORTABLE_FIELDS = [
    "id", "email", "full_name", "first_name", "last_name", "city", "state",
    "country", "created_at", "updated_at", "source_count",
]
SEARCH_FIELDS = ["email", "full_name", "first_name", "last_name", "phone", "city"]
ANSWER_SEARCH_FIELDS = [
    "email", "phone", "full_name", "first_name", "last_name", "city", "state", "country",
]
FILTER_FIELDS = ["city", "state", "country", "postal_code"]
STATUS_LABELS = {
    "queued": "Queued",
    "running": "Running",
    "completed": "Completed",
    "failed": "Failed",
}

# --- Fixed values: match keys in priority order -----------------------------------------------
FILE_MATCH_KEYS = (
    ("email",),
    ("phone", "full_name"),
    ("first_name", "last_name", "postal_code"),
)
BATCH_MATCH_KEYS = (
    ("email",),
    ("phone",),
    ("full_name", "city"),
    ("first_name", "last_name", "city"),
)


@dataclass(frozen=True)
class Config:
    """What a user may change; the defaults are the fixed values above."""

    aliases: dict = field(default_factory=lambda: dict(ALIASES))
    country_codes: dict = field(default_factory=lambda: dict(COUNTRY_CODES))
    max_lengths: dict = field(default_factory=lambda: dict(MAX_LENGTHS))
    required: tuple = ()
    important: tuple = ("email", "phone", "full_name")
    email_pattern: str = EMAIL_PATTERN
    phone_pattern: str = PHONE_PATTERN
    file_match_keys: tuple = FILE_MATCH_KEYS
    batch_match_keys: tuple = BATCH_MATCH_KEYS
    schema_sample_rows: int = 20
    max_upload_bytes: int = 50 * 1024 * 1024
    max_attributes: int = 50
    max_pages: int | None = None  # all pages

    def alias_lookup(self) -> dict:
        """Lower-case source name -> canonical field."""
        return {a.lower(): canon for canon, names in self.aliases.items() for a in names}


DEFAULT = Config()

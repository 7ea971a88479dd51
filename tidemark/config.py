"""Parameters of an analysed app. Nothing else in the package is specific to one."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

#: The beginning of the stop list of the Sastrawi stemmer for Indonesian (MIT licence), in its order; the whole list is a parameter.
GENERIC_STOPWORDS = ("yang", "untuk", "pada", "ke", "para", "namun", "menurut", "antara", "dia", "dua", "ia", "seperti", "jika", "sehingga", "kembali", "dan", "tidak", "ini", "karena", "kepada", "oleh", "saat", "harus", "sementara", "setelah", "belum", "kami", "sekitar", "bagi", "serta", "di", "dari", "telah", "sebagai", "masih", "hal", "ketika", "adalah", "itu", "dalam", "bisa", "bahwa", "atau", "hanya", "kita", "dengan", "akan", "juga", "ada", "mereka", "sudah", "saya", "terhadap", "secara", "agar", "lain", "anda")

#: Words added per app.
APP_STOPWORDS = {
    "app1": ("wondr", "bni", "aplikasi", "nya", "kok", "kalau", "kalo", "deh", "dulu", "mending", "banget", "sih", "ya"),
    "app2": ("byond", "bsi", "aplikasi", "bank", "banget", "mending", "lebih", "malah", "kalau", "kalo", "dulu", "dong", "deh", "sih", "ya", "kok", "nya"),
}

#: Keys of the base lexicon that must not be replaced.
PROTECTED_WORDS = ("apa", "nya", "sekali", "bener", "minta", "bukan")

#: The categories of manual labels.
TECHNICAL = ("Bug Report", "Feature Request", "User Experience")
NON_TECHNICAL = ("Rating (Praise/Dispraise)", "Non-Technical Complaint")
ALL_CATEGORIES = TECHNICAL + NON_TECHNICAL

#: Names of the drift quadrants (both high, only semantic high, only lexical high, both low).
DRIFT_LABELS = ("Stable", "Paraphrase", "Lexical-anchor drift", "Topic drift")
DRIFT_LABELS_LONG = ("Stable (D1 high + D2 high)", "Semantic-stable, Lexical-drift", "Lexical-stable, Semantic-drift", "Drift on both axes")


@dataclass(frozen=True)
class AppConfig:
    name: str
    launch: dt.date
    window_end: dt.datetime
    window_months: int = 12
    n_weeks: int = 52
    timezone: str = "Asia/Jakarta"
    labels: dict[int, str] = field(default_factory=dict)
    semantic_threshold: float = 0.95
    lexical_threshold: float = 0.60
    drift_labels: tuple[str, str, str, str] = DRIFT_LABELS


APPS = {
    "app1": AppConfig("app1", dt.date(2024, 7, 5), dt.datetime(2025, 7, 4, 23, 59, 59), semantic_threshold=0.90),
    "app2": AppConfig("app2", dt.date(2024, 11, 9), dt.datetime(2025, 11, 8, 23, 59, 59), lexical_threshold=0.65, drift_labels=DRIFT_LABELS_LONG),
}


def stopwords(app: str | None = None, generic: tuple[str, ...] = GENERIC_STOPWORDS) -> list[str]:
    """The generic words and the app's, each once, in order. KeyError for an unknown app."""
    return list(dict.fromkeys([*generic, *(APP_STOPWORDS[app] if app is not None else ())]))

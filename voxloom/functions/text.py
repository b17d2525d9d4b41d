"""Text normalization as Column expressions; only NFC needs Python, and only for rows that can change by it."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.sources.shared import bounded_batches

# Bracketed events, inline annotations and punctuation of the transcription convention.
EVENTS = (
    "risa", "risas", "susp", "suspiro", "tos", "carraspeo", "asentimiento", "negación", "gemido", "gruñido", "silencio", "ruido",
    "inintelig\\.?", "música", "musica", "aplausos",
)
PUNCTUATION = r"[¿¡!?\.,:;\"“”«»—–\-()\[\]/]"
ANNOTATION = r"\{\{[^}]*\}\}|\(\([^)]*\)\)|<[^>]*>"
# Java's \w and \s are ASCII only: these are their Unicode forms.
WORD_CHAR = r"[\p{L}\p{N}_]"
SPACE = r"(?U)\s+"
# Markup that the corpus report counts, by name.
MARKUP = {
    "[Anonim]": r"\[Anonim\]",
    "[RISAS]": r"\[RISAS\]",
    "[V-Sml]": r"\[V-Sml\]",
    "[Asent]": r"\[Asent\]",
    "[HS:…]": r"\[HS:[^\]]*\]",
    "[…] (other bracket)": r"\[[^\]]+\]",
    "= repair": rf"{WORD_CHAR}+={WORD_CHAR}+",
    "· mid-word pause": "·",
    "… ellipsis": "…",
}


@F.pandas_udf(T.StringType())
def _nfc_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """Canonical composition. Texts within U+0000 to U+02FF are composed already and stay in the JVM."""
    bounded_batches()
    return F.when(text.rlike(r"[^\x{0000}-\x{02FF}]"), _nfc_udf(F.when(text.rlike(r"[^\x{0000}-\x{02FF}]"), text))).otherwise(text)


def collapse(text: Column) -> Column:
    """Runs of white space become one space, none at the ends. Single spaces, which are most runs, are no matches."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s&&[^ ]]\s*+| \s++", " "))


def strip_nonspeech(text: Column) -> Column:
    """Without bracketed events and inline annotations."""
    text = F.regexp_replace(text, rf"(?iu)\[(?:{'|'.join(EVENTS)})\]", " ")
    return collapse(F.regexp_replace(text, ANNOTATION, " "))


def _composed(text: Column, compose: bool) -> Column:
    text = F.coalesce(text, F.lit(""))
    return nfc(text) if compose else text


def normalize_for_eval(text: Column, compose: bool = True) -> Column:
    """Lower-cased words without punctuation; apostrophes inside words stay. compose=False leaves out NFC."""
    text = F.lower(strip_nonspeech(_composed(text, compose)))
    text = F.regexp_replace(text, PUNCTUATION, " ")
    return collapse(F.regexp_replace(text, r"(?U)(?:^|\s)'+|'+(?=\s|$)", " "))


def post_edit_raw(text: Column, compose: bool = True) -> Column:
    """Events stripped and typographic quotes and dashes made plain; case stays."""
    return collapse(F.translate(strip_nonspeech(_composed(text, compose)), "“”‘’—–", "\"\"''--"))


def clean_markup(text: Column, compose: bool = True) -> Column:
    """Transcript markup off: embedded speakers, brackets, repairs ``said=standard`` (the standard stays), mid-word pauses."""
    text = _composed(text, compose)
    # possessive, as no other way can match: a bracket that stays open before a long text would else exhaust the stack
    text = F.regexp_replace(text, rf"\[H{WORD_CHAR}*+:(?:[^\[\]]++|\[[^\[\]]*+\])*+\]", " ")
    text = F.regexp_replace(text, r"\[[^\[\]]*\]", " ")
    text = F.regexp_replace(text, rf"\[H{WORD_CHAR}*:", " ")
    text = F.translate(text, "[]", "  ")
    # from a word's start only, and without giving back: each word is read once
    text = F.regexp_replace(text, rf"(?<!{WORD_CHAR}){WORD_CHAR}++=({WORD_CHAR}++)", "$1")
    return collapse(F.translate(text, "·", ""))


def explore_clean(text: Column) -> Column:
    """The corpus report's cleaner: every piece of markup becomes a space, repairs go entirely."""
    for pattern in MARKUP.values():
        text = F.regexp_replace(text, pattern, " ")
    return collapse(text)


def tokens(text: Column) -> Column:
    """Words between white space; none for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_tokens(text: Column) -> Column:
    """Runs of letters, digits, underscores and apostrophes, lower-cased after the match."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_']+"), F.lit(0))
    return F.transform(found, F.lower)


def stem_prefix(path: Column, mark: str = "__") -> Column:
    """File name without directories and extension, up to the mark."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.split_part(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit(mark), F.lit(1))


def accent_key(raw: Column) -> Column:
    """Lower case, blanks and hyphens as underscores; ``_`` for null or empty."""
    text = F.translate(F.lower(F.trim(F.coalesce(raw, F.lit("")))), " -", "__")
    return F.when(F.coalesce(raw, F.lit("")) == "", "_").otherwise(text)


def speaker_label(number: Column) -> Column:
    return F.format_string("SPEAKER_%02d", number)


def hms_seconds(text: Column) -> Column:
    """Seconds of ``h:m:s``."""
    part = F.split(text, ":")
    return F.get(part, 0).cast("double") * 3600 + F.get(part, 1).cast("double") * 60 + F.get(part, 2).cast("double")


def duration_text(seconds: Column) -> Column:
    """``h:mm:ss`` of whole seconds, fractions cut off."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)


def stable_fraction(key: Column, salt: str | int) -> Column:
    """A fraction in [0, 1] from the first 48 bits of SHA-1 of ``salt:key``."""
    head = F.substring(F.sha1(F.concat(F.lit(f"{salt}:"), key).cast("binary")), 1, 12)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(2**48 - 1))


@dataclass(frozen=True)
class DialectRule:
    """canonical and variants of a word or part of one; context: word_whole, word_suffix, word_prefix, syllable_coda or literal."""

    canonical: str
    variants: tuple[str, ...]
    context: str = "word_whole"
    applies_to: tuple[str, ...] = ("*",)

    def pattern(self, text: str) -> str:
        quoted = rf"\Q{text}\E"
        border = r"(?U)\b"
        after = "(?=[bcdfghjklmnñpqrstvwxyz]|\\b)"
        return {
            "word_whole": rf"(?iu){border}{quoted}\b",
            "word_suffix": rf"(?iu)(?U){quoted}\b",
            "word_prefix": rf"(?iu){border}{quoted}",
            "syllable_coda": rf"(?iu)(?U){quoted}{after}",
        }.get(self.context, quoted)


def dialect_to_canonical(text: Column, province: Column, rules: list[DialectRule]) -> Column:
    """Variants become canonical forms, rule after rule, where a rule applies to the province or to all."""
    for rule in rules:
        changed = text
        for variant in rule.variants:
            if variant != rule.canonical:
                changed = F.regexp_replace(changed, rule.pattern(variant), rule.canonical.replace("\\", "\\\\").replace("$", "\\$"))
        text = changed if "*" in rule.applies_to else F.when(province.isin(*rule.applies_to), changed).otherwise(text)
    return text


def canonical_to_dialect(text: Column, province: Column, rules: list[DialectRule]) -> Column:
    """Canonical forms become the first variant of each rule that applies."""
    for rule in rules:
        if not rule.variants:
            continue
        changed = F.regexp_replace(text, rule.pattern(rule.canonical), rule.variants[0].replace("\\", "\\\\").replace("$", "\\$"))
        text = changed if "*" in rule.applies_to else F.when(province.isin(*rule.applies_to), changed).otherwise(text)
    return text

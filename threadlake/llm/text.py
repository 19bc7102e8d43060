"""Normalising and cutting texts; plain functions that run inside Arrow batches."""

from __future__ import annotations

import unicodedata

import regex

#: Sentence ends: marks (with what closes or follows them), a smile, a line feed, a dash between spaces, emoji.
_SENTENCE_END = regex.compile(
    r"(?:[.!?…]+[\p{Pe}\p{Pf}\"']*(?=[\s\p{So}\p{Sk}\p{Cf}]|$)|:\)+|[\r\n]+|\s[-–—]\s|[\p{So}\p{Sk}‍️]+)[\p{So}\p{Sk}\p{Cf}️\s]*"
)
_WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
_LINKS = regex.compile(r"https?://\S+|www\.\S+|[#@][\p{L}\p{N}_]+")
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


#: Marks, invisible, unassigned, private and control characters; of control characters those that count as white space stay.
_HIDDEN = regex.compile(r"(?V1)[[\p{Cf}\p{Cc}\p{Cn}\p{Co}\p{Cs}]--[\t-\r\x1c-\x1f\x85]]+")
_MARKS_AND_HIDDEN = regex.compile(r"(?V1)[[\p{Mn}\p{Me}\p{Cf}\p{Cc}\p{Cn}\p{Co}\p{Cs}]--[\t-\r\x1c-\x1f\x85]]+")


def fold(text: str) -> str:
    """Compatibility-decomposed, case-folded, without marks and invisible characters."""
    if text.isascii() and text.isprintable():
        return text.lower()
    plain = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
    return _MARKS_AND_HIDDEN.sub("", plain).replace("đ", "d")  # a stroke is no mark, so decomposing keeps it


def visible(text: str) -> str:
    """Composed text without invisible and control characters."""
    if text.isascii() and text.isprintable():
        return text
    return _HIDDEN.sub("", unicodedata.normalize("NFKC", text))


def words(text: str) -> list[str]:
    """Runs of letters and digits."""
    return _WORD.findall(text)


def without_links(text: str) -> str:
    """The text without addresses, hashtags and mentions."""
    return _LINKS.sub(" ", text)


def sentences(text: str) -> list[str]:
    """The stretches between sentence ends that hold a letter."""
    return [s for s in _SENTENCE_END.split(text) if _LETTERS.search(s)]

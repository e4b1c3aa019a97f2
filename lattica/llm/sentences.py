"""Words and ends of sentences of dirty texts."""

from __future__ import annotations

import html
import re

_FENCE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`", re.S)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_INVISIBLE = re.compile("[­​-‏⁠﻿‪-‮]")
_QUOTE = re.compile(r"«[^«»\n]*»|“[^“”\n]*”|„[^“”„\n]*[“”]|\"[^\"\n]*\"")
#: A quote of fewer words is no sentence; two ideographs count as a word.
FEW_WORDS = 4
_HEADING = re.compile(r"^[ \t]*==.*?==[ \t]*$", re.M)
#: Names, pointers, keys and code rather than words: runs of ASCII with _ = # { } or a slash or dot inside.
_CODE = re.compile(r"(?<![!-~])(?=[!-~]*(?:[_=#{}\\]|/[!-~]|[A-Za-z]\.[A-Za-z]))[!-~]+?(?=[.!?;:,)\]]*(?:[^!-~]|\Z))")
_HAN = "㐀-䶿一-鿿豈-﫿"
_HAS_HAN = re.compile(f"[{_HAN}]")
_ENDS = r"[.!?…;:。！？；\n]+|/(?= )"
_TOKEN = re.compile(rf"[^\W\d_]+|{_ENDS}")
_TOKEN_HAN = re.compile(rf"[{_HAN}]|[^\W\d_{_HAN}]+|{_ENDS}")


def is_end(token: str) -> bool:
    return not token[0].isalpha()


def is_ideograph(token: str) -> bool:
    return _HAS_HAN.match(token) is not None


def _quoted(quote: re.Match) -> str:
    """Nothing for a quote of a few words, else its text as sentences of its own."""
    inner = quote.group()[1:-1]
    words = [w for w in _TOKEN_HAN.findall(_CODE.sub(" ", inner)) if not is_end(w)]
    han = sum(map(is_ideograph, words))
    return " " if len(words) - han + han / 2 < FEW_WORDS else f"\n{inner}\n"


def tokens(text: str) -> list[str]:
    """The words of a text in lower case, with the marks that end its sentences.

    Code, markup, invisible characters, quotes of a few words, headings, names, pointers, keys and numbers are left out
    first. An ideograph is a word. Lines end sentences too.
    """
    if "`" in text:
        text = _FENCE.sub("\n", text)
    if "<" in text:
        text = _TAG.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    plain = text.isascii()
    if not plain:
        text = _INVISIBLE.sub("", text)
    if '"' in text or not plain and ("«" in text or "“" in text or "„" in text):
        text = _QUOTE.sub(_quoted, text)
    if "==" in text:
        text = _HEADING.sub("\n", text)
    if "_" in text or "/" in text or "=" in text or "#" in text or "{" in text or "." in text.replace(". ", "").replace(".\n", ""):
        text = _CODE.sub(" ", text)
    return (_TOKEN if plain or not _HAS_HAN.search(text) else _TOKEN_HAN).findall(text.lower())

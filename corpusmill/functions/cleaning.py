"""Cleaning of extracted text, as a function of one text; compiled patterns behind cheap tests."""

from __future__ import annotations

import re

from corpusmill.functions.text import BOX_DRAWING, CARET, CARET_RUN, CONTROL, DOT_LEADERS, FORMAT_CODE, FORMULA, LINE_END, QUESTIONS, ZERO_WIDTH

_ZERO_WIDTH, _CONTROL, _LINE_END = re.compile(ZERO_WIDTH), re.compile(CONTROL), re.compile(LINE_END)
_MARKS = [(re.compile(p, re.A), sign) for p, sign in ((BOX_DRAWING, None), (CARET_RUN, "^"), (CARET, "^"))]
_ARTEFACTS = [(re.compile(p, re.A), sign) for p, sign in ((FORMULA, "="), (FORMAT_CODE, "%"), (QUESTIONS, "??"), (DOT_LEADERS, None))]
_REPEATED = re.compile(r"([^\w\s가-힣])\1{3,}")
_SPACED = re.compile(r"(?<![가-힣])(?:[가-힣]\s+){3,}[가-힣](?![가-힣])")
_BLANKS = re.compile("[ \t]{2,}")
_NOISE = re.compile(r"[-=*_~\s]{3,}|(?:\(?\^+\s*\d+[.)]?\)?\s*)+|\d+\s*/\s*\d+")
_EMPTY_LINES = re.compile("\n{3,}")


def _without(text: str, patterns: list[tuple[re.Pattern[str], str | None]]) -> str:
    for pattern, sign in patterns:
        if sign is None or sign in text:
            text = pattern.sub(" ", text)
    return text


def _tight(text: str) -> str:
    return _BLANKS.sub(" ", text).strip()


def _plain(text: str) -> str:
    text = _without(text, _ARTEFACTS)
    return _REPEATED.sub(r"\1\1", text)


def normalized(text: str | None) -> str:
    """White space in order, line by line; '' for null."""
    text = _CONTROL.sub(" ", _ZERO_WIDTH.sub("", (text or "").replace(" ", " "))).replace("\r\n", "\n").replace("\r", "\n")
    return "\n".join(_tight(line) for line in _LINE_END.split(text)).strip()


def clean(text: str | None) -> str:
    """Text without the traces of layout: box drawing, caret markers, formulas, format codes, leaders, repeated
    signs, spaced-out Hangul, noise lines and repeated lines.  '' for null."""
    value = _plain(_without(normalized(text), _MARKS))
    value = _SPACED.sub(lambda run: run.group().replace(" ", ""), value)
    kept: list[str] = []
    for line in _LINE_END.split(value):
        # What the first pass has pulled together may be an artefact of its own.
        line = _tight(_plain(line))
        if line and not _NOISE.fullmatch(line) and (not kept or kept[-1] != line):
            kept.append(line)
    return _tight(_EMPTY_LINES.sub("\n\n", "\n".join(kept)))


def clean_block(text: str | None) -> str:
    """:func:`clean` on one line."""
    return clean(text).replace("\n", " ")

"""Sentences by ordered rules, in one pass over a text.

First what must stay whole is marked: addresses, quotations, brackets, runs of dots. Then lists are
found by markers that count on. Then each stop and each line end is looked at once, with the
word before and the word after it, and the first rule that knows the case decides. All
looks are of bounded length, so the time is linear in the text; offsets count characters.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import Column

from .segment import WHITE, _splitter

# Words before a full stop, in lower case.
#: Titles and names' parts: the name follows.
TITLES = frozenset("mr mrs ms dr prof st mt ft gen col capt lt sgt cmdr rep sen gov pres rev hon fr sr messrs mme mlle adm maj brig supt msgr".split())
#: A number follows.
NUMBERED = frozenset("no nos nr n° p pp art vol vols fig figs sec ch eq para ed ex".split())
#: The sentence may go on after them.
ABBREVIATIONS = frozenset("co inc ltd corp bros dept est etc vs cf al approx ave blvd rd ext jan feb mar apr jun jul aug sep sept oct nov dec jr univ assn bldg min max tel".split())
#: Words that begin a sentence when they follow an abbreviation with a capital letter.
STARTERS = frozenset("A Are Being But Can Could Did Do Does For He Her His How However I If In Is It Its Many More Most My No Our She So Some That The Their Then There These They This Those To Was We Were What When Where Which Who Why Will Would You Your".split())
#: Names that end in an exclamation mark.
EXCLAIMED = frozenset(["Yahoo!", "Yum!", "Jeopardy!", "Mamma!"])

_ADDRESS = re.compile(r"(?:https?://|www\.)[^\s<>\"]+|[\w+-]+(?:\.[\w+-]+)*@[\w-]+(?:\.[\w-]+)+")
_QUOTED = re.compile(r"\"[^\"\n]+\"|“[^”“\n]+”|«[^»«\n]+»|„[^“”„\n]+[“”]|(?<![^\s(])'(?=\S)(?:[^'\n]|(?<=\w)'(?=\w))+'(?!\w)")
_BRACKETED = re.compile(r"\([^()\n]+\)|\[[^\[\]\n]+\]")
_DOTS = re.compile(r"\.(?:[ ]?\.){2,}")
_NUMBER_MARK = re.compile(r"(?<!\S)(?:[•⁃‣◦▪][ ]?)?(\d{1,3})(\.\)|\)|\.)(?=\s)")
_LETTER_MARK = re.compile(r"(?<!\S)([a-z])([.)])(?=\s)")
_BULLET = re.compile(r"(?<!\S)[•⁃‣◦▪](?=[ ]?\S)")
_STOP = re.compile(r"\n\s*|[.!?…。！？]+[\"'”’»)\]]*(?=\s|$)|(?<=[^\W_A-Z])\.(?=[A-Z][a-z])")
_NEXT = re.compile(r"\s+(\S)([^\W\d_]{0,20})")
_INITIALS = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]\Z")
#: Characters that are looked at before a stop.
_BACK = 24


def _marked(text: str) -> list[tuple[int, int, str]]:
    """Spans that stay whole, apart and in order; an earlier kind holds later ones."""
    out: list[tuple[int, int, str]] = []
    for kind, pattern, sign in (("address", _ADDRESS, ("@", "://", "www.")), ("quote", _QUOTED, ("\"", "“", "«", "„", "'")), ("bracket", _BRACKETED, ("(", "[")), ("dots", _DOTS, ("..", ". ."))):
        if not any(s in text for s in sign):
            continue
        held, starts = out, [s for s, _, _ in out]
        new = []
        for m in pattern.finditer(text):
            s, e = m.span()
            if kind == "address":
                e -= len(m[0]) - len(m[0].rstrip(".,;:!?)'\""))
            k = bisect_right(starts, s) - 1
            if (k < 0 or held[k][1] <= s) and e > s:
                new.append((s, e, kind))
        if new:  # spans that a new one holds go
            merged, end = [], -1
            for x in sorted([*held, *new], key=lambda x: (x[0], -x[1])):
                if x[0] >= end:
                    merged.append(x)
                    end = x[1]
            out = merged
    return out


def _items(text: str) -> tuple[list[int], set[int]]:
    """Where list items begin, and the ends of their markers."""
    begins, ends = [], set()
    for pattern, value in ((_NUMBER_MARK, int), (_LETTER_MARK, ord)):
        marks = [(m.start(), m.end(), value(m[1]), m[2]) for m in pattern.finditer(text)]
        for k, (s, e, n, style) in enumerate(marks):
            before, after = marks[k - 1] if k else None, marks[k + 1] if k + 1 < len(marks) else None
            counts_on = lambda a, b: a is not None and b is not None and a[2] + 1 == b[2] and a[3] == b[3]
            if counts_on(before, marks[k]) or counts_on(marks[k], after):
                begins.append(s)
                ends.add(e)
    if any(c in text for c in "•⁃‣◦▪"):
        begins += [m.start() for m in _BULLET.finditer(text)]
    return begins, ends


def _breaks(stop: str, word: str, after: str, following: str) -> bool:
    """Whether a stop ends a sentence. after: the next character that isn't white space; following: the word that begins with it."""
    capital = after.isupper()
    if stop == "!" and word + "!" in EXCLAIMED:
        return capital
    if stop != ".":
        return True
    low = word.lower()
    if low in TITLES:
        return False
    if low in NUMBERED and (after.isdigit() or after == "("):
        return False
    if low in ABBREVIATIONS or low in NUMBERED:
        return not (after.islower() or after.isdigit() or after == "(" or following == "I")
    if _INITIALS.match(word):
        if word in ("A.M", "P.M"):
            return capital
        return following in STARTERS
    if len(word) == 1 and word.isupper():
        return word == "I" and following in STARTERS
    return True


def ruled_sentences(text: str | None, join_lines: bool = False) -> list[tuple[str, int, int]]:
    """(content, start, end) of the sentences; [] for null and blank. ``join_lines``: a line that goes on in lower case isn't ended by its line end."""
    if not text:
        return []
    spans, (begins, marks) = _marked(text), _items(text)
    starts, cuts = [s for s, _, _ in spans], set(begins)

    def next_of(at: int) -> tuple[str, str]:
        m = _NEXT.match(text, at)
        return (m[1], m[1] + m[2] if m[1].isalpha() else m[1]) if m else ("", "")

    for s, e, kind in spans:
        after, _ = next_of(e)
        if kind in ("quote", "bracket"):
            if text[e - 2] in ".!?…" and after.isupper():
                cuts.add(e)
        elif kind == "dots":
            run, attached = text[s:e], s > 0 and not text[s - 1].isspace()
            if " " not in run:
                if after.isupper():
                    cuts.add(e)
            elif run.count(".") == 4 and after.isupper():
                cuts.add(s + 1 if attached else e)
    for m in _STOP.finditer(text):
        s, e = m.span()
        if text[s] == "\n":
            if not (join_lines and text[e : e + 1].islower() and text[max(0, s - _BACK) : s].rstrip(" ")[-1:] not in (".", "!", "?")):
                cuts.add(e)
            continue
        if e in marks:
            continue
        k = bisect_right(starts, s) - 1
        if k >= 0 and s < spans[k][1]:
            continue
        word = (text[max(0, s - _BACK) : s].split() or [""])[-1].lstrip("\"'“‘«([{") if s and not text[s - 1].isspace() else ""
        if "." in word and not _INITIALS.match(word):
            word = word.rpartition(".")[2]
        after, following = next_of(e) if e < len(text) and text[e].isspace() else (text[e : e + 1], "")
        if after and _breaks(m[0].rstrip("\"'”’»)]"), word, after, following):
            cuts.add(e)
    out, start = [], 0
    for end in [*sorted(cuts), len(text)]:
        piece = text[start:end]
        body = piece.strip(WHITE)
        if body:
            at = start + len(piece) - len(piece.lstrip(WHITE))
            out.append((body, at, at + len(body)))
        start = end
    return out


def sentences_by_rules(text: Column, join_lines: bool = False) -> Column:
    """array<SENTENCE> of a text, as ruled_sentences(); a splitter for chunk_rows()."""
    return _splitter(lambda t: ruled_sentences(t, join_lines))(text)

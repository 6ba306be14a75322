"""Sentence boundaries in many languages and scripts, by a finite transducer.

A text is read as symbols of a finite alphabet: line breaks with what the next line
begins with, stop marks with the classes of the words around them, quotation marks
and brackets, and spaces of scripts that write no stop mark. A symbol holds only what
is read near its place: two words before, the next word after, and whether an
opening mark is closed within its block. All rules are in the transducer. Its state
is the kind of block, whether a sentence has begun, and the quotations and brackets
that are open; its output says where a sentence ends. Transitions are made from the
rules when they are first needed, and kept.

Texts longer than ``CHUNK`` characters are cut in pieces that different tasks read
by the same symbols and transitions. Which open marks are closed in later pieces is
carried from right to left. As the state at the start of a piece is not known, a
piece is read for all states at once, unless a blank line in it makes them one: it is
a function from state to state. Functions are composed by a prefix scan in two levels
of at most ``FAN`` pieces a task, which gives each piece its state, and a second
reading gives its ends. Any ``CHUNK`` gives the same sentences.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

#: Characters of a text that are read in one piece, and what is read around a piece to tell its marks.
CHUNK, AROUND = 200_000, 4_000
#: Pieces that one task composes: a column holds less than 2**31 characters, so two levels do.
FAN = 128
#: Rule: how many quotations and brackets inside one another are told apart; further ones are plain characters.
DEPTH = 3
#: Rule: characters before a full stop that tell its word and the word before it.
LOOK_BACK = 130

# --- fixed values: abbreviations by language, without the last full stop, in lower case ---
#: After these a sentence goes on.
GOES_ON = set(
    """
    i.e e.g fig figs tab tabs eq eqs ref refs sec secs suppl ver vs cf ca resp max min viz approx no nos vol p pp dr prof mr mrs ms st n.b incl vers est dept ed eds
    z d u bzw vgl abb nr evtl ggf inkl bes sog hrsg mind bspw d.h z.b u.a o.ä kap gl
    ex éq env mme mlle mm éd chap p.ex
    ej ec aprox dra sr sra ud núm pág cap p.ej
    рис табл напр ср проф т тыс млн млрд см стр ур гл акад т.е
    π.χ βλ σχ πίν δρ καθ αρ σελ εξ
    डॉ प्रो श्री
    د أ م
    """.split()
)
#: These may stand at the end of a sentence.
MAY_END = set(
    """
    etc u.s u.k u.n e.u a.m p.m al inc ltd co corp jr sr
    usw usf u.a.m
    г гг др т.д т.п
    κ.λπ κλπ κ.ά
    i ii iii iv vi vii viii ix xi xii
    """.split()
)
#: Of two-part abbreviations, the second part after the first: whether a sentence may end there.
SECOND = {
    ("z", "b"): False, ("d", "h"): False, ("u", "a"): False, ("p", "ex"): False, ("p", "ej"): False, ("i", "d"): False, ("o", "g"): False,
    ("т", "е"): False, ("т", "д"): True, ("т", "п"): True,
}
#: Words before the initial of a name.
BEFORE_NAME = set(
    """
    asked answered wrote said replied noted added did by and with from of to for as
    fragte schrieb sagte antwortete von und mit laut
    demanda écrit écrivit dit répondit par et selon
    preguntó escribió dijo respondió por y según
    """.split()
)
#: Months that follow the number of a day.
MONTHS = set("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
#: Words before an ordinal number, which is written with a full stop.
BEFORE_ORDINAL = set("der die das dem den des im am vom zum zur beim ein eine einen einem einer jeder jede jedes".split())
#: Verbs that report what was quoted.
REPORTS = "asked|answered|wrote|said|replied|noted|added|explained|remarked"
#: Days that follow a time of day.
DAYS = set("monday tuesday wednesday thursday friday saturday sunday today yesterday tomorrow".split())
STOPS = ".!?…。！？｡．։।॥۔؟።፧፨;\u037e"
#: Marks that end a sentence wherever they stand.
FULL = set("。！？｡．։।॥۔؟።፧፨")
OPENERS = {"(": ")", "[": "]", "（": "）", "【": "】", "《": "》", "〈": "〉", "「": "」", "『": "』", "«": "»", "‹": "›", "„": "“", "“": "”"}
CLOSERS = set(OPENERS.values()) | {'"'}
BRACKETS = set(")]）】")
GO_ON_MARKS = set(",;:，、；：،؛՝)]）】》」』」—–-/")
MARKS = "\"“”„«»‹›「」『』（）()[]【】《》〈〉"

_CLASS = "".join(re.escape(c) for c in STOPS)
#: Places where a symbol may begin; a full stop within a number or a name is none.
_PLACES = rf"[\n\r\x0b\x0c\x85  ]|(?!\.[a-z0-9_,;:/])[{_CLASS}]+|[{re.escape(MARKS)}]"
EVENT = re.compile(_PLACES)
#: Scripts whose spaces end sentences.
THIN = re.compile("[฀-໿က-႟ក-៿᧠-᧿ꧠ-꧿ꩠ-ꩿ]")
EVENT_THIN = regex.compile(_PLACES + r"|(?P<thin>(?<=[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])(?:[^\S\r\n]|​)*[^\S\r\n](?:[^\S\r\n]|​)*(?=[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]))")
LEAD = regex.compile(
    r"""
    [\s​﻿]*
    (?:(?P<head>\#{1,6}[^\S\r\n])|(?P<log>\[?\d{4}-\d\d-\d\d[\ T]\d\d:)|(?P<bul>[-*•–◦▪‣][^\S\r\n])|(?P<num>\d{1,3}\.[^\S\r\n])|(?P<par>\d{1,3}\)[^\S\r\n])|(?P<abc>\([a-z]\)[^\S\r\n]))?
    """,
    regex.X,
)
BREAKS = regex.compile(r"(?>\r\n|[\n\r\x0b\x0c\x85  ])")
BLANK = regex.compile(r"(?>\r\n|[\n\r\x0b\x0c\x85 ])[^\S\r\n]*(?>\r\n|[\n\r\x85 ])| ")
SPACE = regex.compile(r"[\s​﻿]*")
FILLED, NAME = regex.compile(r"\S*"), regex.compile(r"\w*")
CONTENT = regex.compile(r"[^\s​﻿]")
REPORTED = regex.compile(rf"(?:\p{{Lu}}\p{{L}}{{0,4}}\.\s+)*\p{{Lu}}[\p{{L}}'’-]*\s+(?:{REPORTS})\b")
CASELESS = regex.compile(
    r"[\p{Lo}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}"
    r"\p{Arabic}\p{Hebrew}\p{Ethiopic}\p{Hangul}\p{Han}\p{Hiragana}\p{Katakana}]"
)
#: A sentence that begins right after a stop mark, its space left out.
GLUED = regex.compile(r"[«“„(¿¡]*(?:\p{Lu}\p{Ll}+(?=[\s’',.!?]|$)|\p{Lu}(?=[\s’']))")
ARMENIAN = regex.compile(r"\p{Armenian}")
GREEK = regex.compile(r"\p{Greek}")
LEADING = "([{\"“„«‘'’¿¡（「”—–-"


def is_space(c: str) -> bool:
    return c.isspace() or c in "​﻿"


@functools.lru_cache(maxsize=65536)
def caseless(c: str) -> bool:
    """Whether a character is of a script without case."""
    return c > "\x7f" and CASELESS.match(c) is not None


# --- symbols: classes of what stands near a place, without any rule -------------


def follows(text: str, at: int) -> tuple[str, bool, int]:
    """What comes after a mark: its kind, whether white space lies between, and where it is.

    ``P`` the end of the block, ``U`` a capital, ``l`` a small letter, ``n`` a name in small letters,
    ``d`` a digit, ``o`` an opening mark before a new sentence, ``q`` another opening mark, ``h`` a
    dash, ``c`` another mark that goes on, ``x`` a letter of a script without case, ``z`` anything else.
    """
    j, size = at, len(text)
    if j < size and text[j] == " " and j + 1 < size and not is_space(text[j + 1]):
        j += 1
    elif j < size and is_space(text[j]):
        j = SPACE.match(text, at).end()
        if j < size and BLANK.search(text, at, j):
            return "P", True, j
    gap = j > at
    if j >= size:
        return "P", gap, j
    c = text[j]
    if c.isupper() or c.istitle():
        return "U", gap, j
    if c.islower():
        word = FILLED.match(text, j, j + 40).group(0)
        bare = word.strip(".,;:!?)»”\"'")
        named = not bare.islower() or "_" in bare or any(x.isdigit() for x in bare)
        return ("n" if named else "l"), gap, j
    if c.isdigit():
        return "d", gap, j
    if c in "—–-":
        return "h", gap, j
    if c in GO_ON_MARKS:
        return "c", gap, j
    if c in OPENERS or c in "\"”¿¡‘":
        k = SPACE.match(text, j + 1).end()
        while k < size and (text[k] in OPENERS or text[k] in "\"¿¡‘"):
            k = SPACE.match(text, k + 1).end()
        fresh = c in "¿¡" or k < size and (text[k].isupper() or caseless(text[k]))
        return ("o" if fresh else "q"), gap, j
    if caseless(c):
        return "x", gap, j
    return "z", gap, j


def before(text: str, at: int) -> tuple[str, str]:
    """The word that ends at a place, without opening marks, and the word before it."""
    near = text[max(0, at - LOOK_BACK) : at]
    if "​" in near:
        near = near.replace("​", " ")
    if not near or near[-1].isspace():
        return "", (near.split() or [""])[-1]
    words = near.rsplit(None, 2)
    return words[-1].lstrip(LEADING), words[-2] if len(words) > 1 else ""


def word_class(text: str, a: int, j: int, kind: str) -> str:
    """The class of the word before a full stop, as its neighbours tell it."""
    word, previous = before(text, a)
    if not word:
        return "closed" if a > 0 and text[a - 1] in CLOSERS else "none"
    low = word.lower()
    if low[-1] > "\x7f" and ARMENIAN.match(low[-1]):
        return "armenian"
    if previous.endswith("."):
        pair = previous.rstrip(".").lstrip("([{\"“„«‘'¿¡").lower(), low
        if pair in SECOND:
            return "last of two" if SECOND[pair] else "part of two"
    if len(word) == 1 and word.isupper():
        if previous and (previous[-1].isdigit() or previous[-1] in "°"):
            return "unit"
        if word == "M" or previous in BEFORE_NAME:
            return "initial"
        return "letter" if previous.isalpha() and previous.islower() else "initial"
    if low in GOES_ON:
        return "abbreviation"
    if low.isdigit() and len(low) <= 3:
        if previous.lower() in BEFORE_ORDINAL:
            return "ordinal"
        month = kind == "U" and len(low) <= 2 and NAME.match(text, j, j + 12).group(0).lower() in MONTHS
        return "day number" if month else "word"
    if low in ("a.m", "p.m") and kind == "U":
        return "hour before day" if NAME.match(text, j, j + 12).group(0).lower() in DAYS else "hour"
    return "may end" if low in MAY_END else "word"


def stop_class(marks: str, before_: str, after: str) -> str:
    """The class of a run of stop marks."""
    if marks == "．" and before_.isdigit() and after.isdigit():
        return "decimal"
    if any(c in FULL for c in marks):
        return "full"
    if marks in (";", ";"):
        return "greek" if GREEK.match(before_) else "comma"
    if "!" in marks or "?" in marks:
        return "bang"
    return "dots" if "…" in marks or len(marks) > 1 else "stop"


class _Partners:
    """Whether the closing partner of an opening mark stands in the same block; each place is looked at once."""

    def __init__(self, text: str, high: int, beyond: str):
        self.text, self.high, self.beyond = text, high, beyond
        self.end, self.open = -1, False
        self.next: dict[str, int] = {}

    def __call__(self, at: int, c: str) -> bool:
        want = '"' if c == '"' else "“" if c == "”" else OPENERS.get(c)
        if want is None:
            return False
        if at > self.end:
            m = BLANK.search(self.text, at, self.high)
            self.end, self.open = (m.start(), False) if m else (self.high, True)
            self.next.clear()
        place = self.next.get(want, -2)
        if place == -2 or -1 < place < at:
            place = self.next[want] = self.text.find(want, at, self.end)
        return place >= 0 or self.open and want in self.beyond


def events(text: str, low: int, high: int, beyond: str = "") -> Iterator[tuple[int, int, tuple]]:
    """Symbols that begin in a range: where a sentence would end, where reading goes on, and the symbol.

    ``beyond`` are the closing marks that stand after ``high`` in the block that goes on there.
    """
    partner = _Partners(text, high, beyond)
    search = (EVENT_THIN if THIN.search(text) else EVENT).search
    size, at = len(text), low
    pos = max(0, low - AROUND)  # what began before is not read again in part
    first = pos == 0 and text != ""
    while True:
        if first:
            first, a, b, c = False, 0, 0, "\n"
        else:
            m = search(text, pos)
            if m is None or m.start() >= high:
                break
            a, b = m.span()
            c = text[a]
        if c in "\n\r\x0b\x0c\x85  ":
            lead = LEAD.match(text, a)
            pos = b = max(lead.end(), b)
            if a < low or a >= high:
                at = max(at, min(b, high))
                continue
            kind = lead.lastgroup or "text"
            end = lead.start(kind) if kind != "text" else b
            content = CONTENT.search(text, at, a) is not None
            blank = a == 0 or BLANK.search(text, a, end) is not None
            at = b if kind != "log" else end
            yield a, at, ("line", content, blank, kind)
            continue
        pos = b
        if a < low:
            late = c in STOPS and text[b : b + 1] in ("’", "'") and (b + 1 >= size or is_space(text[b + 1]))
            at = max(at, min(b + late, high))
            continue
        if c in MARKS:
            kind, gap, j = follows(text, b)
            k = a
            while k > 0 and is_space(text[k - 1]):
                k -= 1
            last = text[k - 1] if k else ""
            tight = a > 0 and k == a
            after = last != "" and last in STOPS and (last not in ";;" or GREEK.match(text[k - 2 : k - 1]) is not None)
            while k > 0 and (text[k - 1] in STOPS or is_space(text[k - 1])):
                k -= 1
            plain = k > 0 and caseless(text[k - 1])
            if kind == "U" and REPORTED.match(text, j):
                kind = "r"
            if kind == "h" and text[j] == "-" and BREAKS.search(text, b, j):
                kind = "P"
            led = "colon" if last in (":", "：") else "comma" if last in (",", "，", "،") else ""
            content = CONTENT.search(text, at, a) is not None
            at = b
            yield b, b, ("mark", c, content, kind, after, partner(b, c), led, tight, plain)
        elif is_space(c):
            at = b
            yield a, b, ("thin",)
        else:
            kind, gap, j = follows(text, b)
            glued = "" if gap or b >= size else "mark" if text[b] in CLOSERS or text[b] in "’'”“" else "caseless" if caseless(text[b]) else "capital" if GLUED.match(text, b) else "other"
            marks = stop_class(text[a:b], text[a - 1 : a], text[b : b + 1])
            k = a
            while k > 0 and is_space(text[k - 1]):
                k -= 1
            plain, direct = k > 0 and caseless(text[k - 1]), k == a
            word = word_class(text, a, j, kind) if marks == "stop" and glued != "other" else ""
            if b < size and text[b] in "’'" and (b + 1 >= size or is_space(text[b + 1])):
                b += 1
                pos = b
                j = SPACE.match(text, b).end()
            # closing marks come after the stop: they decide
            closing = b < size and text[b] in CLOSERS and text[b] != "“" or j < size and text[j] in "»›"
            at = b
            yield b, b, ("stop", marks, kind, gap, glued, plain, direct, word, closing)
    yield high, high, ("tail", CONTENT.search(text, min(at, high), high) is not None)


# --- the transducer -----------------------------------------------------------

#: A state: the kind of block, whether a sentence has yet to begin, and the open marks with the role of each.
START = ("text", True, ())


class BoundaryTransducer:
    """Transitions of the rules, made when first needed."""

    def __init__(self) -> None:
        self.made: dict[tuple, tuple[tuple, bool]] = {}

    def step(self, state: tuple, symbol: tuple) -> tuple[tuple, bool]:
        """The next state, and whether a sentence ends."""
        known = self.made.get((state, symbol))
        if known is None:
            known = self.made[state, symbol] = self._make(state, symbol)
        return known

    def _make(self, state: tuple, symbol: tuple) -> tuple[tuple, bool]:
        mode, fresh, stack = state
        kind = symbol[0]
        if kind == "tail":
            return (mode, fresh and not symbol[1], stack), False
        if kind == "line":
            _, content, blank, begin = symbol
            if blank:
                return (begin, True, ()), True
            if mode in ("head", "log"):
                return (begin, True, ()), True
            if begin in ("head", "log", "bul") or begin != "text" and begin == mode:
                return (begin if begin != "bul" or mode == "text" else mode, True, ()), True
            return (mode, fresh and not content, stack), False
        if mode in ("head", "log"):
            return (mode, False, ()), False
        if kind == "thin":
            return ((mode, True, ()), True) if not stack else (state, False)
        if kind == "stop":
            if stack or symbol[-1] or not self._stop_ends(*symbol[1:-1]):
                return (mode, False, stack), False
            return (mode, True, ()), True
        return self._mark(state, symbol)

    @staticmethod
    def _stop_ends(marks: str, follow: str, gap: bool, glued: str, plain: bool, direct: bool, word: str) -> bool:
        """Whether stop marks end a sentence, were they not within a quotation."""
        if marks in ("full", "decimal", "comma"):
            return marks == "full"
        if marks == "greek":
            return gap or follow == "P" or glued == "mark"
        if marks == "bang":
            if glued not in ("", "mark"):
                return glued in ("caseless", "capital")
            return plain if follow == "l" else follow != "c"
        if marks == "dots":
            return not plain and (glued == "capital" if glued else follow in "Udno")
        if glued == "other":
            return False
        if glued == "caseless":
            return plain and direct
        if word in ("closed", "unit"):
            return True
        if word in ("none", "armenian", "part of two", "initial", "abbreviation", "day number", "hour before day"):
            return False
        if word == "ordinal":
            return follow != "U" and follow != "c"
        if word in ("last of two", "letter", "may end"):
            return starts(follow)
        return word == "hour" or follow != "c"

    def _mark(self, state: tuple, symbol: tuple) -> tuple[tuple, bool]:
        mode, fresh, stack = state
        _, c, content, follow, after, partner, led, tight, plain = symbol
        fresh = fresh and not content
        if follow == "l" and plain:
            follow = "x"  # a name in another script, whose case tells nothing
        at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == c), None)
        if at is not None:  # it closes
            role = stack[at][1]
            left = stack[:at]
            if not left and after and self._quote_ends(c, role, follow, plain):
                return (mode, True, ()), True
            return (mode, False, left), False
        opens = c in OPENERS or c == '"' or c == "”" and not tight
        if opens and partner and len(stack) < DEPTH:
            closer = '"' if c == '"' else "“" if c == "”" else OPENERS[c]
            # only the role of the outermost mark is ever asked for
            role = "mid" if stack else "start" if fresh else (led or "mid")
            return (mode, False, (*stack, (closer, role))), False
        if not opens and not stack and after and (follow == "r" or starts(follow)) and follow != "x":
            return (mode, True, ()), True
        return (mode, False, stack), False

    @staticmethod
    def _quote_ends(c: str, role: str, follow: str, plain: bool) -> bool:
        """Whether a quotation or bracket that closes after a stop mark ends the sentence."""
        if follow == "P":
            return True
        if follow in "chl":
            return False
        if follow == "r":
            return c in BRACKETS and role == "start" or role in ("colon", "comma")
        if c in BRACKETS:
            return role == "start"
        if follow == "x" or plain:
            return role == "colon"
        return True


def starts(kind: str) -> bool:
    """Whether what follows can begin a sentence."""
    return kind in "UndoxzP"


_transducer = BoundaryTransducer()


def read(text: str, state: tuple, low: int, high: int, beyond: str = "") -> tuple[list[int], tuple]:
    """Ends of sentences in a range, and the last state."""
    made, make, cuts = _transducer.made, _transducer.step, []
    for end, _, symbol in events(text, low, high, beyond):
        known = made.get((state, symbol)) or make(state, symbol)
        state = known[0]
        if known[1]:
            cuts.append(end)
    return cuts, state


def spans(text: str | None) -> list[tuple[int, int]]:
    """The sentences of a text as half-open spans of code points; none for NULL, empty and blank texts."""
    if not text:
        return []
    cuts, _ = read(text, START, 0, len(text))
    return trimmed_spans(text, [0, *cuts, len(text)])


def trimmed_spans(text: str, cuts: list[int]) -> list[tuple[int, int]]:
    out = []
    for a, b in zip(cuts, cuts[1:]):
        while a < b and is_space(text[a]):
            a += 1
        while b > a and is_space(text[b - 1]):
            b -= 1
        if a < b:
            out.append((a, b))
    return out


# --- pieces of long texts -----------------------------------------------------

#: In the function of a piece, any open mark that the piece does not close.
OTHER = "*"


@functools.lru_cache(maxsize=256)
def all_states(closers: str) -> dict[tuple, int]:
    """Every state in which a piece that closes these marks can begin, up to ``DEPTH`` open marks, numbered.

    Heads and log lines open none, and with open marks a sentence has begun.
    """
    marks = [*closers, OTHER]
    stacks: list[tuple] = [()]
    last = [((c, r),) for c in marks for r in ("start", "colon", "comma", "mid")]
    for _ in range(DEPTH):
        stacks += last
        last = [(*s, (c, "mid")) for s in last for c in marks]
    bare = [(m, f, ()) for m in ("head", "log") for f in (True, False)]
    states = bare + [(m, f, s) for m in ("text", "bul", "num", "par", "abc") for s in stacks for f in ((True, False) if not s else (False,))]
    return {s: i for i, s in enumerate(states)}


class PieceFunction:
    """What a piece makes of the state before it.

    ``ends`` are the states it can end in and ``index`` the number of that end for each
    of ``all_states(closers)``; a piece with a blank line has one end and no index. Marks
    that the piece does not close are one, ``OTHER``: they stay where they are or go
    with those around them.
    """

    def __init__(self, closers: str, ends: list[tuple], index: list[int] | None):
        self.closers, self.ends, self.index = closers, ends, index

    def __call__(self, state: tuple) -> tuple:
        if self.index is None:
            return self.ends[0]
        mode, fresh, stack = state
        known = all_states(self.closers)[mode, fresh, tuple((c if c in self.closers else OTHER, r) for c, r in stack)]
        mode, fresh, left = self.ends[self.index[known]]
        return mode, fresh, tuple(stack[i] if c == OTHER else (c, r) for i, (c, r) in enumerate(left))

    def then(self, other: PieceFunction) -> PieceFunction:
        """The function of this piece and the next one together."""
        if other.index is None:
            return other
        if self.index is None:
            return PieceFunction("", [other(self.ends[0])], None)
        closers = "".join(sorted(set(self.closers) | set(other.closers)))
        return _function(closers, [other(self(s)) for s in all_states(closers)])

    def write(self) -> str:
        return json.dumps([self.closers, self.ends, self.index])

    @classmethod
    def read(cls, text: str) -> PieceFunction:
        closers, ends, index = json.loads(text)
        return cls(closers, [_freeze(e) for e in ends], index)


def _function(closers: str, after: list[tuple]) -> PieceFunction:
    ends: dict[tuple, int] = {}
    index = [ends.setdefault(s, len(ends)) for s in after]
    return PieceFunction(closers, list(ends), index)


def _freeze(x):
    return tuple(_freeze(y) for y in x) if isinstance(x, list) else x


def transition(text: str, low: int, high: int, beyond: str = "") -> PieceFunction:
    """The function of a piece. States that have become equal are carried on together."""
    symbols = [symbol for _, _, symbol in events(text, low, high, beyond)]
    blank = next((i for i in range(len(symbols) - 1, -1, -1) if symbols[i][0] == "line" and symbols[i][2]), None)
    if blank is not None:
        state = START
        for symbol in symbols[blank:]:
            state = _transducer.step(state, symbol)[0]
        return PieceFunction("", [state], None)
    closers = "".join(sorted({symbol[1] for symbol in symbols if symbol[0] == "mark"} & CLOSERS))
    starts_ = list(all_states(closers))
    ends, index = starts_, list(range(len(starts_)))
    for symbol in symbols:
        seen: dict[tuple, int] = {}
        moved = [seen.setdefault(_transducer.step(s, symbol)[0], len(seen)) for s in ends]
        ends, index = list(seen), index if len(seen) == len(ends) and moved == list(range(len(ends))) else [moved[i] for i in index]
    return PieceFunction(closers, ends, index)


def closed_ahead(text: str, low: int, high: int) -> tuple[str, bool]:
    """The closing marks of a piece before its first blank line, and whether it has one."""
    blank = BLANK.search(text, low, high)
    return "".join(sorted(CLOSERS & set(text[low : blank.start() if blank else high]))), blank is not None


def settle(text: str, place: int) -> int:
    """Where a piece begins that is cut at a place: white space belongs to the piece before."""
    if not 0 < place < len(text) or not (is_space(text[place - 1]) or is_space(text[place])):
        return place
    end = SPACE.match(text, place).end()
    return end if end < len(text) else place


SPANS = T.StructType([T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType())])


def sentences(df: DataFrame, key: str, text: str, chunk: int = CHUNK) -> DataFrame:
    """A row for each sentence: ``key``, ``start_char``, ``end_char`` in code points, half-open.

    NULL, empty and blank texts have none; a NULL key is kept, and repeated rows give
    their sentences each. Texts of up to ``chunk`` characters are read where they lie,
    without a shuffle; longer ones in pieces, with the same result.
    """
    rows = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *SPANS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                index, a, b = [], [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    for s, e in spans(t):
                        index.append(i)
                        a.append(s)
                        b.append(e)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(index, pa.int64())), pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema.names
                )

    short = rows.where(F.length("__text") <= chunk).mapInArrow(run, schema)
    return short.unionByName(_long(rows.where(F.length("__text") > chunk), key, schema, chunk))


#: What is known of a piece besides its text.
PIECE = ["id", "no", "low", "high", "from", "size", "part"]


def _pieces(docs: DataFrame, chunk: int) -> DataFrame:
    """A row for each piece with its surroundings, spread over tasks by text and number."""
    size = F.length("__text")
    cut = docs.select("id", size.alias("size"), "__text", F.posexplode(F.sequence(F.lit(0), size - 1, F.lit(chunk))).alias("no", "low"))
    cut = cut.select(
        "id", "no", "low", "size", F.least(F.col("low") + chunk, F.col("size")).alias("high"), F.greatest(F.col("low") - AROUND, F.lit(0)).alias("from"), "__text"
    )
    return cut.select(*PIECE[:-1], F.expr(f"substring(__text, from + 1, high - from + {AROUND})").alias("part")).repartition("id", "no")


def _map_pieces(pieces: DataFrame, work, out: str, extra: list[str] = []) -> DataFrame:
    """``id``, ``no`` and the columns ``out`` that ``work`` makes of a text, its settled range, and ``extra`` columns."""
    made = to_arrow_schema(T.StructType.fromDDL(out))
    width, types, names = len(made), made.types, ["id", "no", *made.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(width)]
            index = []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("low", "high", "from", "size", "part", *extra)]
            for i, (low, high, start, size, t, *more) in enumerate(zip(*columns)):
                for row in work(t, settle(t, low - start), settle(t, high - start) if high < size else high - start, start, *more):
                    index.append(i)
                    for column, v in zip(rows, row):
                        column.append(v)
            keys = [batch.column(batch.schema.get_field_index(c)).take(pa.array(index, pa.int64())) for c in ("id", "no")]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(r, k) for r, k in zip(rows, types))], names)

    return pieces.mapInArrow(run, f"id bigint, no int, {out}")


def _long(rows: DataFrame, key: str, schema: T.StructType, chunk: int) -> DataFrame:
    """Sentences of long texts: what is closed ahead, functions of pieces, their prefix scan, and a second reading."""
    docs = rows.groupBy(F.xxhash64("__key", "__text").alias("id")).agg(F.first("__key").alias("__key"), F.first("__text").alias("__text"), F.count(F.lit(1)).alias("times"))
    pieces = _pieces(docs, chunk)

    def ahead(pdf):
        # numbers of pieces are bounded by the size of a column: 2**31 / CHUNK
        pdf = pdf.sort_values("no", ascending=False)
        beyond, out = "", []
        for marks, blank in zip(pdf["marks"], pdf["blank"]):
            out.append(beyond)
            beyond = "".join(sorted(set(marks) | (set() if blank else set(beyond))))
        return pdf[["id", "no"]].assign(beyond=out)

    marks = _map_pieces(pieces, lambda t, low, high, start: [closed_ahead(t, low, high)], "marks string, blank boolean")
    beyond = marks.groupBy("id").applyInPandas(ahead, "id bigint, no int, beyond string")
    pieces = pieces.join(beyond, ["id", "no"])
    made = _map_pieces(pieces, lambda t, low, high, start, b: [(transition(t, low, high, b).write(),)], "f string", ["beyond"])
    made = made.withColumn("g", (F.col("no") / FAN).cast("int"))

    def together(pdf):
        f = [PieceFunction.read(x) for x in pdf.sort_values("no")["f"]]
        return pdf[["id", "g"]].iloc[:1].assign(f=[functools.reduce(PieceFunction.then, f).write()])

    def run_through(pdf, order: str, state: tuple):
        pdf, states = pdf.sort_values(order), [state]
        for f in pdf["f"].iloc[:-1]:
            states.append(PieceFunction.read(f)(states[-1]))
        return pdf[["id", order]].assign(state=[json.dumps(s) for s in states])

    groups = made.groupBy("id", "g").applyInPandas(together, "id bigint, g int, f string")
    begins = groups.groupBy("id").applyInPandas(lambda pdf: run_through(pdf, "g", START), "id bigint, g int, state string")
    within = made.join(begins, ["id", "g"]).groupBy("id", "g")
    states = within.applyInPandas(lambda pdf: run_through(pdf, "no", _freeze(json.loads(pdf["state"].iloc[0]))), "id bigint, no int, state string")

    def cuts(t: str, low: int, high: int, start: int, beyond: str, state: str, size: int):
        found, _ = read(t, _freeze(json.loads(state)), low, high, beyond)
        for c in [*found, *([0] if start + low == 0 else []), *([high] if start + high == size else [])]:
            a = b = c
            while a > 0 and is_space(t[a - 1]):
                a -= 1
            while b < len(t) and is_space(t[b]):
                b += 1
            yield start + a, start + b

    found = _map_pieces(pieces.join(states, ["id", "no"]).withColumn("whole", F.col("size")), cuts, "left bigint, right bigint", ["beyond", "state", "whole"])
    order = W.partitionBy("id").orderBy("left", "right")
    paired = found.withColumn("end_char", F.lead("left").over(order)).where(F.col("right") < F.col("end_char"))
    paired = paired.join(docs.select("id", "__key", "times"), "id").withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return paired.select(F.col("__key").alias(key), F.col("right").alias("start_char"), "end_char").select(*schema.names)

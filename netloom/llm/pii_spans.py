"""Spans of a text that may be personal details, with the votes of weak labelers on each."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from netloom.llm.dialogue import fold, repair, skeleton

#: Classes of each sort of candidate; a vote is a class, "-" where a labeler has none to give.
CLASSES = {"number": ("none", "phone", "id_number"), "email": ("none", "email"), "address": ("none", "address"), "person": ("none", "person")}
#: The labelers of each sort, in the order of their votes.
LABELERS = {
    "number": ("sign", "layout", "lead", "check digit", "size", "span", "before", "after"),
    "email": ("sign", "parts", "ending", "local part", "path", "size", "before", "after"),
    "address": ("house number", "kind of street", "capitals", "size", "before", "after"),
    "person": ("given names", "family names", "parts", "before", "after"),
}

# --- Fixed values: words of the details and around them --------------------------------------------------------------
STREETS_AFTER = ("Street", "St", "Avenue", "Ave.", "Ave", "Road", "Rd", "Lane", "Terrace", "Crescent", "Square", "Sq.", "Sq", "Close", "Drive", "Court", "Place", "Way")
STREETS_FR = ("rue", "avenue", "bd", "boulevard", "place", "allée", "impasse", "quai", "chemin")
STREETS_BEFORE = ("C/", "Calle", "Avenida", "Avda.", "Av.", "Plaza", "Paseo", "Camino", "Rua", "Travessa", "Praça", "Largo", "Alameda", "Estrada")
STREETS_DE = ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee")
NUMBER_WORDS = ("zero", "oh", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
DOMAIN_ENDS = ("com", "org", "net", "edu", "info", "io", "co", "test", "example", "invalid", "de", "fr", "es", "pt", "uk", "ru")
#: Words that tell what stands after or before them, by class; of several the nearest counts.
AROUND = {
    "phone": (
        "tel", "tel.", "telephone", "phone", "mobile", "cell", "call", "calling", "ring", "dial", "dialled", "dialed", "text me", "the number is", "number is", "fax", "hotline", "reach me", "ask for", "extension",
        "teléfono", "móvil", "llama", "llámame", "telefone", "telemóvel", "ligue", "liga", "téléphone", "portable", "appelle", "appelez", "telefon", "handy", "ruf", "anrufen", "durchwahl",
    ),
    "id_number": (
        "id", "identity", "identification", "passport", "licence number", "social security", "national insurance", "card", "identity card", "document", "ssn", "taxpayer", "tax number", "born",
        "dni", "nif", "nie", "documento", "carné", "cédula", "contribuinte", "cartão", "steuernummer", "steuer-id", "ausweis", "kennnummer", "personalausweis", "sécu", "sécurité sociale", "carte", "la carte", "numéro", "it says",
    ),
    "email": ("write to", "mail", "mail me", "email", "e-mail", "contact", "send it to", "send to", "corrections", "address", "escribe", "escreva", "schreib", "écris", "écrivez"),
    "address": (
        "live at", "lives at", "living at", "address", "bring it to", "deliver to", "house at", "home at", "fire was at", "resident of", "wohne", "wohnt", "bring es", "brand war", "vivo en", "vive en", "fue en", "llévalo a", "moro na", "moro no", "mora na", "foi na", "foi no",
        "leve até", "habite", "c'est au", "retrouve", "bell", "floor", "flat", "hurry",
    ),
    "person": ("mr", "mrs", "ms", "miss", "dr", "dr.", "doctor", "prof", "herr", "frau", "señor", "señora", "sr", "sra", "senhor", "senhora", "monsieur", "madame", "mademoiselle", "is that you", "my name is", "named", "called", "subtitles by", "translated by", "sync", "looking for", "arrested", "open up", "will see you"),
}
#: Words beside numbers, names and addresses that are no personal detail, by sort of candidate.
AGAINST = {
    "number": ("part no", "part no.", "part number", "lot", "case", "case file", "file", "channel", "score", "score was", "episode", "flight", "chapter", "costs", "price", "room", "grid", "verse", "page", "serial", "version", "that was", "year", "years", "reel", "copy"),
    "email": ("downloaded from", "download from", "visit"),
    "address": ("turn left on", "turn right on", "turn", "miles to", "meet me in", "down", "along"),
    "person": ("port", "hotel", "ship", "dear", "prize", "street", "city of", "gentlemen"),
}
#: Sizes of the groups of digits in which numbers are usually written, by class; other sizes are neither's.
LAYOUTS = {
    "phone": ((3, 4), (3, 3, 4), (2, 2, 2, 2, 2), (5, 6), (3, 4, 4), (3, 5, 3), (3, 8), (4, 7)),
    "id_number": ((3, 2, 4), (2, 2, 2, 2, 1), (2, 3, 3, 3), (1, 2, 2, 2, 3, 3, 2), (15,), (8, 1), (9,), (2, 3, 4), (2, 6, 1), (2, 3, 3, 1)),
}

# --- Patterns that bear misread signs --------------------------------------------------------------------------------
_D = r"[\dOoIlSB|]"
_SP = r"(?:[ \t ]+|[ \t]*\r?\n[ \t]*)"
_MISREAD = {"e": "[ec]", "l": "[lI1|i]", "i": "[iIl1|íî]", "o": "[o0]", "s": "[s5]", "a": "[aã]", "h": "(?:h|li|ll)", "m": "(?:m|rn)", "d": "(?:d|cl)", "g": "[gq]", "n": "n", "t": "[tf]", "b": "[b8]", "w": "(?:w|vv)"}


def tolerant(word: str) -> str:
    """A pattern for a word whose signs may be misread or wrongly decoded."""
    return "".join(r"[^\s\w]*" + re.escape(c) if c in "./" else _MISREAD.get(c.lower(), re.escape(c) if c.isascii() else r"\S{0,6}?") for c in word)


def _any(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(tolerant(w) for w in sorted(words, key=len, reverse=True)) + ")"


_NUM = rf"(?<![\w.,/+\-])(?=\w?\w?\w?\d){_D}{{1,4}}(?:[a-zA-Z]|-{_D}{{1,2}})?"
_NUM_LAST = rf"(?=\w?\w?\w?\d){_D}{{1,4}}(?:[a-zA-Z](?![a-zA-Z])|-{_D}{{1,2}})?(?![\w/])"
_NAME = r"(?:[^\W\d_]|[015�](?=[^\W\d_]))[^\s\d,;:!@<>()\[\]]{2,}"
_KIND_AFTER = "(?:" + "|".join(tolerant(w) if w.endswith(".") else tolerant(w) + r"(?![\w.]\w|\w)" for w in sorted(STREETS_AFTER, key=len, reverse=True)) + ")"
_SZ = r"(?:ß|ss|SS|ẞ|[^\w\s]{1,3}|я|Я|Ã\S{1,4}|)"
_STRASSE = rf"[Ss5]t[rR][aA]{_SZ}[eEcC](?!\w)"
_ADDRESSES = [
    ("en", re.compile(rf"{_NUM}{_SP}{_NAME}(?:{_SP}{_NAME})?{_SP}{_KIND_AFTER}", re.I)),
    ("fr", re.compile(rf"{_NUM}(?:{_SP}?b[il1í]s)?,?{_SP}{_any(STREETS_FR)}{_SP}(?:d[eu]s?{_SP}|de{_SP}la{_SP})?{_NAME}", re.I)),
    ("de", re.compile(rf"(?<!\w)(?:{_NAME}{_SP}{_STRASSE}|[Aa][mM]{_SP}{_NAME}|[^\W\d_][^\s\d,;:!?@<>()\[\]]{{2,}}?(?:{_STRASSE}|-?[Ss5]tr\.|[wW][eEcC][gGqQ]|[gG]a[s5]se|platz)){_SP}?{_NUM_LAST}", re.I)),
    ("es", re.compile(rf"(?<!\w){_any(STREETS_BEFORE)}{_SP}?(?:d[eoa]s?{_SP}|de{_SP}la{_SP})?{_NAME},?{_SP}(?:n[^\w\s]?\S{{0,2}}{_SP})?{_NUM_LAST}", re.I)),
    ("no number", re.compile(rf"(?<!\d ){_NAME}{_SP}{_KIND_AFTER}", re.I)),
]

_BEFORE, _AFTER = r"(?<![\w+#@])(?<![\d][-./,:])", r"(?![\w@]|[-./:]\d)"


def _number(body: str, flags: int = 0) -> re.Pattern:
    return re.compile(_BEFORE + body.replace("#", _D).replace("_", _SP) + _AFTER, flags)


#: Patterns of numbers; earlier ones take the span. What the number is, the labelers say.
_NUMBERS = [
    ("nir", _number(r"[12lI](?:_#{2}){3}(?:_#{3}){2}_#{2}")),
    ("nir joined", _number(r"[12lI]#{14}")),
    ("international", re.compile(rf"(?<![\w+])\(?\+{_D}{{1,3}}\)?(?:(?:{_SP}|[-./]|{_SP}?\({_D}\){_SP}?)?{_D}+){{1,7}}" + _AFTER)),
    ("steuer", _number(r"#{2}_#{3}_#{3}_#{3}")),
    ("joined 11", _number(r"#{11}")),
    ("ssn", _number(r"#{3}(?:-#{2}-|_#{2}_)#{4}")),
    ("nino", _number(r"[A-Z0]{2}_?#{2}_?#{2}_?#{2}_?[A-D](?![a-z])", re.I)),
    ("dni", _number(r"#{2}\.?#{3}\.?#{3}-?[A-Za-z]")),
    ("us", re.compile(rf"(?<![\w+])\({_D}{{3}}\){_SP}?{_D}{{3}}[-. ]{_D}{{4}}" + _AFTER)),
    ("us parted", _number(r"#{3}([-.])#{3}\1#{4}")),
    ("french", _number(r"[0oO]#(?:(?:_|\.)#{2}){4}")),
    ("uk mobile", _number(r"[0oO]#{4}_#{6}")),
    ("uk", _number(r"[0oO]#{2}_#{4}_#{4}")),
    ("german", _number(r"[0oO]#{2,3}(?:_|/)#{5}_?#{3}")),
    ("german mobile", _number(r"[0oO]#{3}(?:_|/)#{7}")),
    ("nine spaced", _number(r"#{3}_#{3}_#{3}")),
    ("nine dotted", _number(r"#{3}\.#{3}\.#{3}")),
    ("joined 9", _number(r"#{9}")),
    ("local", _number(r"#{3}-#{4}")),
    ("words", re.compile(rf"\b(?:{_any(NUMBER_WORDS)}(?:,?{_SP}|[-,] ?)){{5,}}{_any(NUMBER_WORDS)}(?!\w)", re.I)),
    ("other", re.compile(r"(?<![\w+#@.\-/])\d[\d./\-]{4,}[\dA-Z](?![\w@])")),
]
#: A number word within a token, however misread; the pattern "words" needs several.
_NUMBER_WORD = re.compile(rf"\b{_any(NUMBER_WORDS)}(?!\w)", re.I)

_DOT_WORD = tolerant("dot")
_AT, _DOT = rf"(?:{_SP}?[\[(]at[\])]{_SP}?|{_SP}at{_SP})", rf"(?:{_SP}?[\[(]{_DOT_WORD}[\])]{_SP}?|{_SP}{_DOT_WORD}{_SP})"
#: Signs written as words, besides an "at" between blanks.
_SPELLED = re.compile(rf"{_DOT_WORD}|\(at\)|\[at\]", re.I).search
_DOT_BETWEEN = re.compile(_DOT, re.I).search
_BRACKETS = re.compile(r"[\[(]at[\])]", re.I).search
_LOCAL, _PART = r"[^\s<>@(){}\[\],;:\"“”!?♪*]+", r"[\w\-]+"
_EMAILS = [
    ("sign", re.compile(rf"{_LOCAL}@{_PART}(?:\.{_PART})+")),
    ("words", re.compile(rf"{_LOCAL}{_AT}{_PART}(?:(?:\.|{_DOT}){_PART})+", re.I)),
    ("no domain", re.compile(rf"{_LOCAL}?@{_PART}")),
]


@dataclass(frozen=True)
class Span:
    """A candidate: where it stands, its sort, a vote of each labeler of that sort, and its shape for the classifier."""

    start: int
    end: int
    sort: str
    votes: str
    shape: str


GIVEN, FAMILY, GIVEN_LIKE, FAMILY_LIKE = 1, 2, 4, 8
#: Bits of a token with a number word, and with several.
NUMBER, NUMBERS = 16, 32


class Names:
    """Which words look like given and family names.

    The listed names are cut into stems and endings that other listed names share; what stems and endings make together
    counts as a name, and an unknown stem with a long known ending as like one. Signs that are misread or wrongly decoded,
    and accented letters that got lost, don't matter.
    """

    def __init__(self, listed: list[tuple[str, str]]):
        self.known: dict[str, int] = {}
        self.ends: list[tuple[int, tuple[str, ...]]] = []
        for bit, like, kind in ((GIVEN, GIVEN_LIKE, "given"), (FAMILY, FAMILY_LIKE, "family")):
            low = sorted({n.strip().lower() for n, k in listed if k == kind and n and len(n.strip()) > 2})
            heads, tails = Counter(w[:i] for w in low for i in range(2, len(w))), Counter(w[i:] for w in low for i in range(2, len(w)))
            ends: Counter[str] = Counter()
            for w in low:
                score, i = max(((heads[w[:i]] - 1) * (tails[w[i:]] - 1), -i) for i in range(2, len(w)))
                if score > 0:
                    ends[w[-i:]] += 1
            shared = [e for e, n in ends.items() if n > 1]
            stems = {w[: -len(e)] for w in low for e in [max((e for e in shared if w.endswith(e) and len(w) > len(e) + 1), key=len, default="")] if e}
            for w in {*low, *(h + t for h in stems for t in shared)}:
                bare = "".join(c for c in w if c.isascii())
                for form in {fold(w), *([bare] if len(bare) > 2 else []), *(x for x in (skeleton(w), skeleton(bare)) if len(x) > 4)}:
                    self.known[form] = self.known.get(form, 0) | bit
            self.ends.append((like, tuple({f for e in shared if len(e) > 2 for f in (fold(e), skeleton(e))})))
        self.cache: dict[str, int] = {}

    def of(self, token: str) -> int:
        """Bits of what the word may be; 0 for none. Words in small letters are none."""
        core = token.strip("“”\"'’‘()[]<>*♪_#.,!?…:;=-–—¿¡")
        if len(core) < 3:
            return 0
        if core[0].islower():  # a misread capital I looks like a small l
            return self.known.get(fold("I" + core[1:]), 0) if core[0] == "l" else 0
        f = fold(core)
        got = self.known.get(f) or self.known.get(skeleton(core), 0)
        if not got and not core.isascii():
            fixed = repair(core)
            f = fold(fixed)
            got = self.known.get(f) or self.known.get(skeleton(fixed), 0)
        if not got and core.count("-") == 1:
            a, b = core.split("-")
            x, y = self.of(a), self.of(b)
            both = (FAMILY | FAMILY_LIKE) if x & (FAMILY | FAMILY_LIKE) and y & (FAMILY | FAMILY_LIKE) else 0
            return FAMILY & both if (x | y) & FAMILY else FAMILY_LIKE & both
        if not got and len(f) > 4:
            for like, ends in self.ends:
                if f.endswith(ends):
                    got |= like
        return got

    def classes(self, tokens: list[str]) -> list[int]:
        """Bits of each token, of number words too."""
        cache = self.cache
        if len(cache) > 1_000_000:
            cache.clear()
        for t in set(tokens).difference(cache):
            n = len(_NUMBER_WORD.findall(t)) if len(t) > 1 else 0
            cache[t] = self.of(t) | (NUMBERS if n > 1 else NUMBER if n else 0)
        return [cache[t] for t in tokens]


def _words(s: str) -> list[str]:
    """Words parted by blanks and line breaks only; other spaces may be halves of wrongly decoded letters."""
    return s.replace("\r", " ").replace("\n", " ").replace("\t", " ").split(" ")


def _plain(s: str) -> str:
    """Words of a context without accents and case, misread signs as one."""
    if not s.isascii():
        s = repair(s)
    return " ".join(x for x in map(skeleton, s.split()) if x)


def _voters(sort: str) -> list[tuple[str, str]]:
    """Words and the vote each gives, for a sort of candidate."""
    said = [(w, str(i)) for i, c in enumerate(CLASSES[sort]) for w in (AROUND[c] if i else AGAINST[sort])]
    return sorted({(f" {_plain(w)} ", v) for w, v in said})


_CONTEXT = {sort: _voters(sort) for sort in CLASSES}


def _context(sort: str, cue: str, start: int, end: int) -> str:
    """Votes of the words before and after a span in its cue: of those with a vote, the nearest counts, of two there the longer."""
    left, right = f" {_plain(cue[:start])} ", f" {_plain(cue[end:])} "
    before, after = max(((x + len(w), len(w), v) for w, v in _CONTEXT[sort] if (x := left.rfind(w)) >= 0), default=(0, 0, "-")), min(((x, -len(w), v) for w, v in _CONTEXT[sort] if (x := right.find(w)) >= 0), default=(0, 0, "-"))
    return before[2] + after[2]


_DIGITS = str.maketrans("OoIlSB|", "0011581")


def _check_digits(d: str) -> bool:
    """Whether the digits hold under one of the public schemes: weights modulo 11 (nine digits), the iterated 11, 10 scheme
    (eleven), a key modulo 97 (fifteen)."""
    n = [int(c) for c in d]
    if len(n) == 9:
        rest = sum(w * x for w, x in zip(range(9, 1, -1), n, strict=False)) % 11
        return n[8] == (0 if rest < 2 else 11 - rest)
    if len(n) == 11:
        product = 10
        for x in n[:10]:
            product = ((product + x) % 10 or 10) * 2 % 11
        return n[10] == (11 - product) % 10
    return len(n) == 15 and int(d[:13]) % 97 + int(d[13:]) == 97


def _number_votes(text: str, name: str, context: str) -> tuple[str, str]:
    """Votes on a number, and its shape: spelled out or not, first sign, number of digits and of groups, a letter at an end."""
    if name == "words":
        return "1-----" + context, "words"
    groups = re.findall(r"[^\W_]+", text)
    lettered = groups[-1][-1:].isalpha() and groups[-1][-1] not in "OoIlSB" or groups[0][:1].isalpha() and groups[0][0] not in "OoIlSB"
    sizes: list[int] = []
    for g in groups:
        tail = g[-1].isalpha() and g[-1] not in "OoIlSB" and any(c.isdigit() for c in g)
        sizes += [len(g) - 1, 1] if tail else [len(g)]
    digits = "".join(c for c in "".join(groups).translate(_DIGITS) if c.isdigit())
    n, first = len(digits), text[0] if text[0] in "+(" else "0" if digits[:1] == "0" else "1"
    sign = "1" if first in "+(" else "2" if lettered else "-"
    layout = next((str(CLASSES["number"].index(k)) for k, all_ in LAYOUTS.items() if tuple(sizes) in all_), "-" if first == "+" or tuple(sizes) in ((3, 3, 3), (11,)) else "0")
    lead = "1" if first in "0+" and 9 <= n <= 13 and not lettered else "-"
    check = "2" if not lettered and _check_digits(digits) else "-"
    signs = sum(map(len, groups))
    size = "0" if signs < 7 or n > 15 else "-" if n > 8 or lettered else "1"
    span = "0" if len(sizes) == 2 and sizes[0] == sizes[1] or re.fullmatch(r"\d+\.\d\d?|\d{1,2}[./]\d{1,2}[./]\d{2,4}", text) else "-"
    return sign + layout + lead + check + size + span + context, f"{first}{n}/{len(groups)}{'a' if lettered else ''}"


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def _email(m: re.Match, a: int, b: int, name: str) -> Span:
    cue = m.string
    text = cue[a:b]
    plain = name == "words" and not _BRACKETS(text) and not _DOT_BETWEEN(text)
    at = re.search(r"@|[\[(]at[\])]|\sat\s", text, re.I)
    local, domain = text[: at.start()].strip(), text[at.end() :].strip()
    parts = [x for x in re.split(r"[\s.\[\]()]+", domain) if x and skeleton(x) != skeleton("dot")]
    ending = bool(parts) and any(skeleton(parts[-1]) == skeleton(e) for e in DOMAIN_ENDS)
    vote = (
        "0" if plain else "1", "1" if len(parts) > 1 else "0", "1" if ending else "0", "-" if not local.isalpha() or not plain else "0",
        "0" if cue[b : b + 1] == "/" else "-", "1" if local and b - a >= 12 else "0",
    )
    return Span(a, b, "email", "".join(vote) + _context("email", cue, a, b), f"{name}{min(len(parts), 2)}{'p' if plain else ''}")


def _address(cue: str, a: int, b: int, name: str) -> Span:
    words = cue[a:b].split()
    numbered = name != "no number" and _digits(cue[a:b]) > 0
    kind = "1" if name != "no number" and any(len(w) > 4 for w in words) else "-"
    names = [w for w in words if len(w) > 3 and w[0].isalpha()]
    capitals = "-" if cue[a:b].isupper() else "1" if names and all(w[0].isupper() for w in names) else "0" if name in ("en", "no number") else "-"
    return Span(a, b, "address", ("1" if numbered else "0") + kind + capitals + ("1" if 2 < len(words) < 8 or numbered else "0") + _context("address", cue, a, b), f"{'n' if numbered else ''}{capitals}")


def _in_cue(cue: str, names: Names, hot: bool, numbered: bool) -> list[Span]:
    out: list[Span] = []
    taken: list[tuple[int, int]] = []

    def free(a: int, b: int) -> bool:
        if any(a < y and x < b for x, y in taken):
            return False
        taken.append((a, b))
        return True

    if "@" in cue or "at" in cue.lower():
        for name, p in _EMAILS:
            spelled = name != "words" or _SPELLED(cue)
            for m in p.finditer(cue):
                a, b = m.start(), m.end()
                while a < b and cue[a] in "'-–—=.﻿¿¡":
                    a += 1
                while b > a and cue[b - 1] in ".-_":
                    b -= 1
                last = re.split(r"[\s.\])]+", cue[a:b].rstrip("]) "))[-1]
                if (spelled or any(skeleton(last) == skeleton(e) for e in DOMAIN_ENDS)) and free(a, b):
                    out.append(_email(m, a, b, name))
    digits = any(c.isdigit() for c in cue)
    if digits:
        for name, p in _ADDRESSES[:-1]:
            for m in p.finditer(cue):
                a, b = m.start(), m.end()
                while name == "fr" and cue[b - 1] in ".…-'’”\"":
                    b -= 1
                if free(a, b):
                    out.append(_address(cue, a, b, name))
    for m in _ADDRESSES[-1][1].finditer(cue):
        if free(m.start(), m.end()):
            out.append(_address(cue, m.start(), m.end(), "no number"))
    for name, p in _NUMBERS if digits else _NUMBERS[-2:-1] if numbered else ():
        for m in p.finditer(cue):
            a, b = m.start(), m.end()
            if cue[a] == "(" and ")" not in m[0]:
                continue
            n = sum(c.isalnum() for c in m[0])
            if name != "words" and (n < 5 or _digits(m[0]) < 0.6 * n) or not free(a, b):
                continue
            out.append(Span(a, b, "number", *_number_votes(cue[a:b], name, _context("number", cue, a, b))))
    if hot:
        out += _persons(cue, names)
    return out


_TOKEN = re.compile(r"[^ \t\r\n]+")
_MARKUP = re.compile(r"<[^<>\n]*>|\{[^{}\n]*\}")
_OPEN, _CLOSE = "“\"'‘(<[*♪_#-–—=¿¡", "”\"’')>]*♪_#.,!?…:;=-–—"


def _persons(cue: str, names: Names) -> list[Span]:
    """Pairs of given and family name, in either order, with initial or second family name; and names that stand alone."""
    clean = _MARKUP.sub(lambda m: " " * len(m[0]), cue) if "<" in cue or "{" in cue else cue
    found = [(m.start(), m.end()) for m in _TOKEN.finditer(clean)]
    bits = names.classes([cue[a:b] for a, b in found])
    tokens = []
    for (a, b), bit in zip(found, bits, strict=True):
        c, d = a, b
        while c < d and cue[c] in _OPEN:
            c += 1
        while d > c and cue[d - 1] in _CLOSE:
            d -= 1
        tokens.append((c, d, cue[d:b], bit))
    out: list[Span] = []
    n = len(tokens)

    def add(a: int, stop: int, of: list[int], shape: str) -> None:
        given, family = (("1" if any(tokens[k][3] & sure for k in of) else "-" if any(tokens[k][3] & like for k in of) else "0") for sure, like in ((GIVEN, GIVEN_LIKE), (FAMILY, FAMILY_LIKE)))
        out.append(Span(a, stop, "person", given + family + ("1" if len(of) > 1 else "0") + _context("person", cue, a, stop), shape))

    def initial(k: int) -> bool:
        return k < n and tokens[k][1] - tokens[k][0] == 1 and tokens[k][2].startswith(".") and cue[tokens[k][0]].isalpha()

    def is_(k: int, sure: int, like: int) -> bool:
        return k < n and bool(tokens[k][3] & (sure | like))

    i = 0
    while i < n:
        a, b, end, c = tokens[i]
        if not c:
            i += 1
            continue
        last, form = None, ""
        if c & (GIVEN | GIVEN_LIKE) and end in ("", "?"):  # given (a lost letter may stand as a question mark), perhaps an initial, family
            j = i + 1
            if initial(j):
                j += 1
            if is_(j, FAMILY, FAMILY_LIKE) and (c & GIVEN or tokens[j][3] & FAMILY):
                last, form = j, "given family"
                k = j + 1
                if not tokens[j][2] and k < n and tokens[k][3] & FAMILY and not tokens[k][3] & GIVEN and not (tokens[k][2] == "," and is_(k + 1, GIVEN, 0)):
                    last, form = k, "two families"
        if last is None and c & (FAMILY | FAMILY_LIKE) and end in ("", ",") and is_(i + 1, GIVEN, GIVEN_LIKE) and (c & FAMILY or tokens[i + 1][3] & GIVEN):
            comma = end == ","
            nxt = tokens[i + 1]
            if comma or (c & FAMILY and nxt[3] & GIVEN and not is_(i + 2, FAMILY, FAMILY_LIKE) and not (initial(i + 2) and is_(i + 3, FAMILY, FAMILY_LIKE))):
                last, form = i + 1, "family, given" if comma else "family given"
                if not nxt[2] and initial(i + 2) and not is_(i + 3, FAMILY, FAMILY_LIKE):
                    last = i + 2
        if last is not None:
            stop = tokens[last][1] + (1 if initial(last) else 0)
            add(a, stop, [i, last], form)
            i = last + 1
        else:  # a single name
            if c & (GIVEN | FAMILY):
                add(a, b, [i], "single")
            i += 1
    return out


_TIMES = re.compile(r"﻿?(?:[^>]{0,24}\d[^>]{0,24}-{1,2} ?>|[\dOolI;.,\s]+:[\dOolI:;.,\s]{4,16}(?:-*>|[-–—]+)[\dOolI;.,\s]+:)")
_HEADS = frozenset("0123456789OolI﻿")
_COUNT = re.compile(r"﻿?[\dOolI]{1,6}$")
_HINTS = re.compile(r"\d|@|\b(?:[Aa]t|AT)\b").search


def spans(text: str, names: Names) -> list[Span]:
    """All candidate spans of a text, cue by cue; positions are those of the text as it stands."""
    found = set(names.classes(_words(text)))
    hot_words, number_words = any(c & (GIVEN | FAMILY) for c in found), any(c & (NUMBER | NUMBERS) for c in found)
    out: list[Span] = []
    at, start, end = 0, -1, -1

    def close() -> None:
        nonlocal start
        if start >= 0:
            cue = text[start:end]
            bits = names.classes(_words(cue)) if hot_words or number_words else []
            hot = hot_words and any(c & (GIVEN | FAMILY) for c in bits)
            numbered = number_words and sum(2 if c & NUMBERS else 1 for c in bits if c & (NUMBER | NUMBERS)) > 1
            if hot or numbered or _HINTS(cue):
                out.extend(Span(x.start + start, x.end + start, x.sort, x.votes, x.shape) for x in _in_cue(cue, names, hot, numbered))
        start = -1

    for line in text.split("\n"):
        bare = line.strip()
        if not bare:
            close()
        elif bare[0] in _HEADS and (_TIMES.match(bare) or start < 0 and _COUNT.match(bare)):
            close()
        else:
            if start < 0:
                start = at
            end = at + len(line)
        at += len(line) + 1
    close()
    return out

"""The spoken words of a subtitle file, in a form that damage does not change."""

from __future__ import annotations

import re
import unicodedata

import regex

#: Bytes 0x80 to 0xBF as they look when UTF-8 is read as Windows-1252 (undefined ones as Latin-1).
_TAIL = {(bytes([b]).decode("cp1252", "ignore") or chr(b)): b for b in range(0x80, 0x100)}
_LOW = "".join(re.escape(c) for c, b in _TAIL.items() if b < 0xC0) + "".join(chr(b) for b in range(0x80, 0xA0))
_TWICE = re.compile(f"[Â-ô][{_LOW}]{{1,3}}")
_CYRILLIC = re.compile("[À-ÿ¨¸]{3,}")
_MIXED = re.compile(r"(?<=[a-zA-Z])[\u0400-\u045f]{1,2}(?![\u0400-\u045f])|(?<![\u0400-\u045f])[\u0400-\u045f]{1,2}(?=[a-zA-Z])")


def _bytes(s: str) -> bytes:
    return bytes(_TAIL.get(c, ord(c) & 0xFF) for c in s)


def repair(text: str) -> str:
    """Undoes UTF-8 read as Windows-1252, also several times over, and Windows-1251 and 1252 read as each other."""

    def again(m: re.Match) -> str:
        try:
            got = _bytes(m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]
        return m[0] if any("\u0530" <= c < "\u2000" or c > "\u2bff" for c in got) else got  # no letters of these languages

    for _ in range(3):
        fixed = _TWICE.sub(again, text)
        if fixed == text:
            break
        text = fixed
    hits = _CYRILLIC.findall(text)
    if hits and 4 * sum(map(len, hits)) > len(text):
        text = re.sub("[À-ÿ¨¸]+", lambda m: m[0].encode("latin-1").decode("cp1251", "replace"), text)
    return _MIXED.sub(lambda m: m[0].encode("cp1251", "ignore").decode("cp1252", "replace"), text)


#: Cue numbers and cue heads, also damaged ones: only digits, signs read as digits, and an arrow.
_HEAD = re.compile(r"[\dOolI]{1,6}$|[\dOolI;.,\s]+:[\dOolI:;.,\s]{4,16}(?:-*>|[-–—]+)[\dOolI;.,\s]+:|[^>]{0,24}\d[^>]{0,24}--? ?>")
_MARKS = re.compile(r"<[^<>\n]*>|\{[^{}\n]*\}|&(?:#\d+|\w{2,8});|\[[^\[\]]*\]|\([^()]*\)|(?<!\w)\*[^*]+\*")
_MARKED = re.compile(r"[<{&\[(*]").search
_LABEL = regex.compile(r"[\s\-–—♪#?]*(?:[\p{Lu}\d][\w.'’]*[ ]){0,2}[\p{Lu}\d][\w.'’]*[ ]?:(?=\s)")
_HINT = re.compile(r"\w[.,]\w|@|//|(?:[BbSs8][Yy]|[Vv][IiLl1][DdOo]|[Uu][Ss][EeCc][Rr])").search
_START = frozenset("0123456789OolI\ufeffWNS")


def _label(line: str) -> str:
    m = _LABEL.match(line)
    if m:
        letters = [c for c in m[0] if c.isalpha()]
        if 3 * sum(c.isupper() for c in letters) >= 2 * len(letters):
            return line[m.end() :]
    return line


#: Ends of sentences (no initials of names), of marked words, and of lines that may be the last of an advert.
_ENDS = re.compile(r"(?:(?<!\b\w)\.|[!?…])[\"'”’»)]*\s+|</\w{1,8}>\s+|(?<=[.!?…])</\w{1,8}>\s*|\n")
#: Words of a line in small letters that may still belong to the address in the line before ("all small letters").
_REST = 4


def _sign(part: str) -> bool:
    """Whether a sentence holds a sign of an advert or credit, however misread."""
    if not _HINT(part):
        return False
    low = part.lower().translate(_SKELETON)
    return any(k in low for k in _SIGNS)


def _site(word: str) -> bool:
    low = word.lower().translate(_SKELETON)
    return any(k in low for k in _SITES)


def _parts(cue: str) -> list[str]:
    """Sentences of a cue. A line break ends one only after an address or site, before a line that begins anew."""
    out, at = [], 0
    for m in _ENDS.finditer(cue):
        if m[0] == "\n":
            done, rest = cue[at : m.start()], cue[m.end() :].split("\n", 1)[0]
            first = next((c for c in rest if c.isalpha()), "")
            if not done.strip() or not _site(done.split()[-1]) or not (first.isupper() and not done.isupper() or len(rest.split()) > _REST):
                continue
        out.append(cue[at : m.end()])
        at = m.end()
    return [*out, cue[at:]]


def _without_adverts(cue: str) -> str:
    """A cue without the sentences that are adverts or credits."""
    if not _sign(cue):
        return cue
    parts = _parts(cue)
    gone = [_sign(p) for p in parts]
    for k in range(len(parts) - 1):  # "Corrections?" before an address
        words, after = parts[k].split(), parts[k + 1].split()
        if len(words) == 1 and words[0].endswith("?") and gone[k + 1] and after and _site(after[0]):
            gone[k] = True
    return "\n".join(p for p, g in zip(parts, gone, strict=True) if not g)


def dialogue(text: str) -> list[str]:
    """Words of the dialogue in order, parted by blanks, without cue numbers, times, markup, speaker labels, sound
    descriptions and adverts."""
    if not text.isascii():
        text = repair(text)
    out: list[str] = []
    cue: list[str] = []

    def close() -> None:
        body = "\n".join(cue)
        body = _without_adverts(body)
        if _MARKED(body):
            body = _MARKS.sub(" ", body)
        if ":" in body:
            body = "\n".join(map(_label, body.split("\n")))
        out.extend(body.split())

    for line in text.split("\n"):
        line = line.strip()
        if not line:
            if cue:
                close()
                cue = []
        elif line[0] in _START and (_HEAD.match(line.lstrip("\ufeff")) or line.lstrip("\ufeff").startswith(("WEBVTT", "NOTE", "STYLE"))):
            if cue and ">" in line:  # a head without a blank line before it
                close()
                cue = []
        else:
            cue.append(line)
    if cue:
        close()
    return out


#: Letters that Unicode doesn't take apart, and signs that character recognition mistakes for one another.
_SPLIT = {"œ": "oe", "æ": "ae", "ß": "ss", "ø": "o", "ł": "l", "đ": "d", "ı": "i"}
_CONFUSED = {"i": "l", "1": "l", "|": "l", "!": "l", "0": "o", "5": "s", "8": "b", "e": "c", "q": "g", "9": "g", "6": "b", "m": "rn", "h": "ll", "j": "l", "v": "u", "w": "uu", "d": "cl"}
_FOLD = str.maketrans(_SPLIT)
_SKELETON = str.maketrans(_CONFUSED)
_JUNK = regex.compile(r"[^\p{L}\p{N}|]+")


def fold(word: str) -> str:
    """A word without case, accents and punctuation; '' if nothing is left."""
    low = word.lower().translate(_FOLD)
    if not low.isascii():
        low = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
    return _JUNK.sub("", low)


def skeleton(word: str) -> str:
    """A folded word in which signs that look alike are one."""
    return fold(word.rstrip("!|").lstrip("!|")).translate(_SKELETON)


#: Signs of an address or site, and of an advert or credit.
_SITES = tuple(k.translate(_SKELETON) for k in ("www", "http", ".test", ".example", ".invalid", ".com", ".net", ".org", "@"))
_SIGNS = _SITES + tuple(
    k.translate(_SKELETON)
    for k in (
        "subtitles by", "translated by", "synced and", "sync:", "advertise your", "browser extension", "rate this subtitle", "best watched", "subtitles for any", "help other users",
    )
)

"""Sentence boundaries across languages and scripts.

A text falls into blocks: an empty or blank line ends one, heading and list lines are blocks of their own, fenced code is
left out. In a block the places where a sentence may end form a lattice of terminators: runs of end marks with the
closing quotes and brackets behind them, outside or at the end of a matched pair of brackets or quotes. Each place is judged by
what stands before it (abbreviation, initial, ordinal, ellipsis) and by the opening word behind it.

Scripts without spaces are read by a word lattice: the cheapest path over dictionary words around a gap gives the
word before and behind it. In Thai and Lao, which have no end marks, a space between their letters is a gap, and parts sentences only
where a final particle before it or an opening word behind it speaks for that; in Chinese and Japanese the word behind a closing quote tells
whether the sentence goes on. End marks are all characters that Unicode calls sentence terminals.

`learn` reads a corpus for what a list can't hold: words that carry on behind a full stop, and the beginnings and ends of the
stretches of spaceless letters that blocks begin and end with, so that gaps are also judged by where else such words stand.
"""

from __future__ import annotations

import base64
import re
import sys
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import regex

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.shared import cut, ship

# --- fixed values: abbreviations and words, by language ---------------------------------------------------

#: Abbreviations that don't end a sentence, whatever follows.
NEVER_ENDS = {
    # English
    "prof", "dr", "mr", "mrs", "ms", "st", "eq", "eqs", "approx", "vs", "vol", "fig", "figs", "sec", "app", "incl", "cf", "ch", "dept",
    "gen", "rev", "hon", "capt", "col", "lt", "sgt", "e.g", "i.e", "resp", "ref", "refs", "def", "thm", "prop",
    # German
    "bzw", "kap", "abschn", "max", "min", "ca", "gem", "abs", "vgl", "abb", "tab", "nr", "bd", "hrsg", "inkl", "ggf", "evtl", "sog", "z.b", "d.h", "u.a", "o.g", "art",
    # French
    "mm", "env", "chap", "c.-à-d", "ex", "p.ex", "av", "fém", "masc", "éd", "mlle",
    # Spanish
    "sra", "dra", "srta", "ud", "uds", "núm", "pág", "págs", "cap", "aprox", "ej", "p.ej", "ee", "fdo", "prol",
    # Russian
    "см", "рис", "гл", "ок", "напр", "тыс", "млн", "млрд", "стр", "табл", "ср", "им", "проф", "акад", "ул", "т.е", "т.к", "т.н",
    # Hindi
    "डॉ", "श्री", "प्रो", "पृ", "सं", "कु", "ए", "के", "बी", "सी", "डी", "ई", "एम", "एस", "आर", "जे", "पी", "वी", "एन", "एल", "टी", "जी",
}
#: Abbreviations that don't end a sentence before a number, a section mark or a roman number.
BEFORE_NUMBER = {"no", "nos", "p", "pp", "n", "s", "sig", "item", "art", "v", "№", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec"}
#: Titles, which end a sentence only where an opening word follows.
TITLES = {"gov", "sen", "rep", "pres", "adm", "maj", "supt", "insp", "hr", "fr", "frl", "sig", "sig.ra", "dott", "avv", "mons", "msgr", "don", "exmo", "sr", "г-н", "г-жа"}
#: Abbreviations that end a sentence where any capital follows.
MAY_END = {"etc", "usw", "al", "ff", "uu", "jr", "т.д", "т.п", "др", "д", "п"}
#: Abbreviations that end a sentence where an opening word follows, but not before a name.
BEFORE_NAME = {"u.s", "u.k", "e.u", "a.m", "p.m", "u.s.a", "inc", "ltd", "co", "corp", "bros", "ph.d"}
#: Abbreviations of nouns and measures, which end a sentence where an opening word follows.
NOUNS = {"st", "eq", "eqs", "vol", "fig", "figs", "sec", "app", "ch", "dept", "ref", "refs", "max", "min", "abs", "kap", "abschn", "abb", "tab", "chap", "cap", "рис", "гл", "табл"}
#: Words that open a sentence: articles, pronouns and conjunctions with a capital.
OPENERS = {
    "the", "a", "an", "this", "that", "these", "those", "it", "he", "she", "they", "we", "i", "you", "there", "here", "what", "when", "where", "why", "how", "if", "but", "and", "so", "then", "however", "in", "on", "at", "for", "as", "no", "all", "each", "its", "his", "her", "their", "our", "my",
    "der", "die", "das", "ein", "eine", "es", "er", "sie", "wir", "ich", "dies", "diese", "dieser", "dieses", "wenn", "aber", "und", "dann", "danach", "doch", "auch", "im", "am",
    "le", "la", "les", "un", "une", "il", "elle", "ils", "elles", "on", "nous", "vous", "je", "ce", "cette", "ces", "si", "mais", "et", "donc", "puis", "dans",
    "el", "los", "las", "una", "él", "ella", "ellos", "nosotros", "yo", "esto", "esta", "este", "pero", "y", "entonces", "en", "lo", "egli", "ella", "noi", "questo", "questa",
    "он", "она", "оно", "они", "мы", "я", "вы", "это", "этот", "эта", "эти", "если", "но", "и", "затем", "в", "на",
}
#: German words before an ordinal.
BEFORE_ORDINAL = {"im", "am", "vom", "zum", "beim", "ins", "der", "die", "das", "den", "dem", "des", "und", "bis", "ab", "seit", "zur", "jeder", "jeden", "dieser", "diesem", "ihrem", "seinem", "ihren", "seinen", "oder"}
MONTHS = {"januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember"}
#: Words of saying that carry a sentence on behind its opening quote.
SAYING = {
    "asked", "said", "says", "wrote", "writes", "replied", "answered", "noted", "shouted", "added", "fragte", "sagte", "schrieb", "meinte", "rief", "antwortete", "demanda", "dit", "affirme", "écrit", "répondit",
    "preguntó", "dijo", "escribió", "respondió", "спросил", "спросила", "сказал", "сказала", "написал", "написала", "ответил", "लिखा", "पूछा", "कहा", "बोला", "बोले", "كتب", "كتبت", "قال", "قالت", "سأل", "سألت", "أجاب", "أضاف",
}
#: Japanese particles that carry a sentence on behind a closing quote, longest first where they share a beginning.
PARTICLES_JA = ("という", "といった", "として", "って", "から", "まで", "より", "など", "だと", "と", "は", "が", "を", "に", "の", "も", "で", "へ", "や", "、", "，")
#: Chinese verbs of saying.
SAYING_ZH = ("写道", "问道", "说道", "答道", "喊道", "表示", "指出", "认为", "回答", "说", "问", "寫道", "問道", "說道", "答", "道")
#: Thai words that end a sentence; that open one; that carry one on before or behind a space; other frequent words.
FINAL_TH = ("ล่ะ", "นะ", "ครับ", "ค่ะ", "คะ", "จ้ะ", "แล้ว", "เสมอ", "เท่านั้น", "เด็ดขาด", "ทั้งหมด", "ทุกครั้ง", "ได้ดี", "เลย", "ด้วย", "ไหม", "หรือไม่", "นี้", "นั้น", "อีก", "กันเอง", "อยู่")
OPENING_TH = ("เพราะ", "เมื่อ", "ทำไม", "อย่า", "ถ้า", "หาก", "แต่", "ดังนั้น", "จากนั้น", "นอกจากนี้", "อย่างไรก็ตาม", "เรา", "เขา", "มัน", "ผม", "ฉัน", "ต่อไป", "ต่อมา", "โปรด", "กรุณา", "แม้", "ส่วน", "สำหรับ")
CARRY_BEFORE_TH = ("และ", "หรือ", "ของ", "ที่", "ซึ่ง", "ว่า", "คือ", "จาก", "กับ", "โดย", "เช่น", "ได้แก่", "ตาม", "ถึง", "เพื่อ", "ใน", "ชื่อ", "นาย", "นาง", "คุณ", "ดร", "เป็น", "ประมาณ")
CARRY_BEHIND_TH = ("และ", "หรือ", "ซึ่ง", "ว่า", "จึง", "ๆ", "ฯลฯ", "ที่", "ของ", "คือ")
WORDS_TH = ("จะ", "ไม่", "ต้อง", "มี", "ให้", "ได้", "ดี", "ไป", "มา", "กัน", "เอง", "ทุก", "ครั้ง", "เรื่อง", "คน", "วัน", "ปี", "งาน", "ทำงาน", "ค่า", "ไว้", "แบบ", "การ", "ความ", "ผู้", "เวลา", "ทำ", "ใช้", "บอก", "รู้", "เห็น", "อยาก", "ควร", "เคย", "กำลัง", "ยัง", "ก็", "ถูก", "มาก", "น้อย", "ใหม่", "เก่า", "ข้อมูล", "ระบบ", "วินาที", "ตรวจสอบ", "บันทึก", "เปลี่ยน", "รอ")
#: The same for Lao.
FINAL_LO = ("ແລ້ວ", "ເດີ", "ນະ", "ບໍ", "ສະເໝີ", "ເທົ່ານັ້ນ", "ທັງໝົດ", "ນີ້", "ນັ້ນ")
OPENING_LO = ("ຖ້າ", "ແຕ່", "ເພາະ", "ເມື່ອ", "ດັ່ງນັ້ນ", "ຂ້ອຍ", "ເຮົາ", "ເຂົາ", "ມັນ", "ຫຼັງຈາກນັ້ນ")
CARRY_LO = ("ແລະ", "ຫຼື", "ຂອງ", "ທີ່", "ວ່າ", "ຄື", "ຈາກ", "ກັບ", "ໃນ", "ຊື່")

# --- the lattice of words ---------------------------------------------------------------------------------


#: A public vocabulary for many languages, whose Han and kana words, by rank, serve as a dictionary with frequencies; another may be given by `dictionary`.
DICTIONARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
_HAN_OR_KANA = re.compile(r"[\u3041-\u30fe\u3400-\u9fff]{1,8}$")


def dictionary(path: str) -> dict[str, float]:
    """Costs of the words of a rank file, from 0.7 for the most frequent to 1.3; single characters cost more. Empty if there is no file."""
    found = []
    try:
        with open(path, "rb") as f:
            for line in f:
                word = base64.b64decode(line.split()[0]).decode("utf-8", "ignore").strip()
                if _HAN_OR_KANA.match(word):
                    found.append(word)
    except FileNotFoundError:
        return {}
    return {w: 1.3 if len(w) == 1 else 0.7 + 0.6 * k / len(found) for k, w in enumerate(found)}


class WordLattice:
    """Cheapest paths over dictionary words; a character outside any word costs more than a word."""

    def __init__(self, *lists: tuple[str, ...], more: dict[str, float] | None = None) -> None:
        self.words = (more or {}) | {w: 1.0 for ws in lists for w in ws}
        self.longest = max(map(len, self.words))

    def path(self, text: str) -> list[str]:
        """The words of the cheapest path, unknown characters joined into one word."""
        n = len(text)
        cost, step = [0.0] + [1e9] * n, [0] * (n + 1)
        for k in range(n):
            base = cost[k]
            if base + 1.6 < cost[k + 1]:
                cost[k + 1], step[k + 1] = base + 1.6, -1
            for size in range(1, min(self.longest, n - k) + 1):
                more = self.words.get(text[k : k + size])
                if more is not None and base + more < cost[k + size]:
                    cost[k + size], step[k + size] = base + more, size
        out: list[str] = []
        k, loose = n, ""
        while k:
            if step[k] < 0:
                loose = text[k - 1] + loose
                k -= 1
                continue
            if loose:
                out.append(loose)
                loose = ""
            out.append(text[k - step[k] : k])
            k -= step[k]
        return ([*out, loose] if loose else out)[::-1]


_LATTICE = WordLattice(FINAL_TH, OPENING_TH, CARRY_BEFORE_TH, CARRY_BEHIND_TH, WORDS_TH, FINAL_LO, OPENING_LO, CARRY_LO)
_FINAL, _OPENING = frozenset(FINAL_TH + FINAL_LO), frozenset(OPENING_TH + OPENING_LO)
_BEFORE, _BEHIND = frozenset(CARRY_BEFORE_TH + CARRY_LO), frozenset(CARRY_BEHIND_TH + CARRY_LO[:5])


@lru_cache(maxsize=1)
def _wide_lattices() -> tuple[WordLattice, WordLattice]:
    """The lattices of Japanese and Chinese, loaded once a worker by the first text that needs them. Without the dictionary sentences would end at other
    places, so its lack is a RuntimeError."""
    words = dictionary(DICTIONARY)
    if not words:
        raise RuntimeError(f"{DICTIONARY}: no such file, or no Han or kana words in it; Chinese and Japanese quotes can't be read without it, and it must be on every executor")
    return WordLattice(PARTICLES_JA, more={w: c for w, c in words.items() if len(w) > 1}), WordLattice(SAYING_ZH, more=words)


#: Letters of the scripts with gaps.
_GAPPED = "฀-๿຀-໿"
#: Code points of an edge of a stretch, least and most.
EDGE = range(3, 13)


@dataclass(frozen=True)
class Known:
    """What was learnt: abbreviations, words that carry on behind a full stop; openers, words that have a capital only where a sentence begins; for edges of stretches of spaceless letters, `starts` and `ends`, the
    share of those that stand at the edge of a block among all that stand at one or beside a gap."""

    abbreviations: frozenset[str] = frozenset()
    openers: frozenset[str] = frozenset()
    starts: dict[str, float] = field(default_factory=dict)
    ends: dict[str, float] = field(default_factory=dict)


NOTHING = Known()


def _edge(shares: dict[str, float], word: str, end: bool) -> float:
    """Evidence of the longest edge of a stretch that is known, from -1 to 1; 0 if none is."""
    for size in reversed(EDGE):
        if size <= len(word) and (share := shares.get(word[-size:] if end else word[:size])) is not None:
            return 1.0 if share >= 0.02 else -1.0
    return 0.0


def gap(before: str, behind: str, known: Known = NOTHING) -> bool:
    """Whether a space between two stretches of spaceless letters parts sentences: only on positive evidence, from final particles and
    opening words and from what is known of the edges, against words that join."""
    path, next_path = _LATTICE.path(before), _LATTICE.path(behind)
    last, first = path[-1], next_path[0]
    score = 1.5 * (last in _FINAL) + 1.5 * (first in _OPENING) - 4.0 * (last in _BEFORE) - 4.0 * (first in _BEHIND)
    if known.ends:
        score += _edge(known.ends, before, True) + _edge(known.starts, behind, False)
    return score > 0


# --- blocks -----------------------------------------------------------------------------------------------

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
_MARK = re.compile(r"\s*(?:(#{1,6})(?:\s+|$)|([-*+•])\s+|(\d{1,3})[.)]\s+)")
_FENCE = re.compile(r"\s{0,3}(`{3,}|~{3,})")


def _last(text: str, at: int) -> str:
    """The last character before `at` that isn't white space."""
    while at > 0 and text[at - 1].isspace():
        at -= 1
    return text[at - 1] if at else " "


def blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of each block, without marks of heading and list lines."""
    out: list[tuple[int, int]] = []
    open_at, fence, before = -1, "", ""
    for m in _LINE.finditer(text):
        at, end = m.span()
        if at == end:
            break
        line = m[0]
        mark = None
        head = line.lstrip()[:4]
        if head[:3] in ("```", "~~~") and (f := _FENCE.match(line)):
            kind = "fence"
            if not fence:
                fence = f[1][:3]
            elif f[1].startswith(fence):
                fence = ""
        elif fence:
            kind = "fence"
        elif not head:
            kind = "blank"
        elif head[0] in "#-*+•0123456789" and (mark := _MARK.match(line)):
            kind = "mark"
            if mark[3] and before == "text" and not (int(mark[3]) == 1 and _last(text, at) in ".:!?。；："):
                kind = "text"  # a wrapped line that happens to begin with a number
        else:
            kind = "text"
        if kind == "text":
            if open_at < 0:
                open_at = at
        elif open_at >= 0:
            out.append((open_at, at))
            open_at = -1
        if kind == "mark":
            out.append((at + mark.end(), end))
        before = kind
    if open_at >= 0:
        out.append((open_at, len(text)))
    return out


# --- spans of brackets and quotes -------------------------------------------------------------------------

_PAIRS = {")": "(", "]": "[", "}": "{", "）": "（", "］": "［", "】": "【", "》": "《", "〉": "〈", "」": "「", "』": "『", "｣": "｢"}
#: What else a quote may close, where that is open.
_OTHER = {'"': '"', "“": "„", "»": "«", "«": "»", "›": "‹", "‹": "›"}
_BRACKET = re.compile(r"[()\[\]{}（）［］【】《》〈〉「」『』｢｣\"“”„‟«»‹›]")


def spans(text: str, start: int, end: int) -> dict[int, tuple[int, int]]:
    """Outermost matched pairs in a block: place of the closing character -> (place of the opening one, 0)."""
    stack: list[tuple[str, int]] = []
    held: dict[str, int] = {}
    pairs: list[tuple[int, int]] = []
    for m in _BRACKET.finditer(text, start, end):
        c, at = m[0], m.start()
        if c in _PAIRS:
            wanted = _PAIRS[c]
        elif c == "”":
            wanted = "“" if held.get("“") else "„"
        else:
            wanted = _OTHER.get(c, "")
        if wanted and held.get(wanted):
            while True:  # what is open inside has no match
                opened, place = stack.pop()
                held[opened] -= 1
                if opened == wanted:
                    break
            pairs.append((place, at))
        elif c not in _PAIRS and c != "”":
            stack.append((c, at))
            held[c] = held.get(c, 0) + 1
    pairs.sort()
    out: dict[int, tuple[int, int]] = {}
    reach = -1
    for a, b in pairs:
        if a > reach:
            out[b] = (a, 0)
            reach = b
    return out


# --- terminators ------------------------------------------------------------------------------------------

#: All sentence terminals of Unicode, the Tibetan shads and the ellipsis. A Greek question mark looks like a semicolon.
_TERMINALS = "".join(regex.findall(r"[\p{SB=STerm}\p{SB=ATerm}…]", "".join(map(chr, (*range(0xD800), *range(0xE000, sys.maxunicode + 1))))))
_TERMINALS = "".join(c for c in _TERMINALS if c not in "․﹒") + "།༎"
_STRONG = frozenset(_TERMINALS) - frozenset(".…．!?؟۔‼‽⁇⁈⁉﹖﹗")
_EVERY = frozenset(_TERMINALS)


@lru_cache(maxsize=1 << 14)
def _ends(marks: frozenset[str], more: bool) -> re.Pattern:
    """Runs of those terminals that a text has, which are few and quickly found; and, if `more`, Greek question marks and gaps."""
    runs = f"[{re.escape(''.join(sorted(marks)))}]+" if marks else r"(?!)"
    return re.compile(runs + (rf"|(?<=[\u0370-\u03ff\u1f00-\u1fff])[;\u037e]|(?<=[{_GAPPED}])\s+(?=[{_GAPPED}])" if more else ""))


_GREEK_OR_GAPPED = re.compile(rf"[{re.escape(_TERMINALS)}]+|(?<=[\u0370-\u03ff\u1f00-\u1fff])[;\u037e]|(?<=[{_GAPPED}])\s+(?=[{_GAPPED}])")
_GREEK_OR_GAPPED = re.compile(rf"[\u0370-\u03ff\u1f00-\u1fff{_GAPPED}]")
_CLOSERS = "\"”“»«’')]}）］】》〉」』｣›"
_WORD_BEFORE = re.compile(r"[^\s(\[{（「『《“”„\"«»,;:，、；：—–。！？]+$")
_BREAKS = frozenset("([{（「『《“”„\"«»,;:，、；：—–。！？")
_STRETCH = re.compile(rf"[{_GAPPED}]+")
_IDENTIFIER = re.compile(r"[a-z]+\d|[A-Za-z]*[a-z][A-Z]|[A-Za-z]\w*(?:::|_)\w|v\d|[a-z]+\w*\.\w")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_MULTI = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]$")
_GLUED = re.compile(r"[A-Z][a-z]*\.?\s")
_OPENERS = "(（[［【《〈「『｢\"“„«»‹›¿¡'‘—–"
_SPACES = re.compile(r"\s*")
_BLANKS = " \u00a0\u2009\u202f"


def _cased(c: str) -> bool:
    return c.lower() != c.upper()


def _next(text: str, at: int, end: int) -> tuple[str, int]:
    """How what follows begins: end, upper, lower, identifier, digit, caseless or mark; and where."""
    at = _SPACES.match(text, at, end).end()
    if at >= end:
        return "end", at
    first = at
    while at < end and text[at] in _OPENERS:
        at += 1
        while at < end and text[at].isspace():
            at += 1
    if at >= end:
        return "mark", first
    c = text[at]
    if c.isalpha():
        if _IDENTIFIER.match(text, at, end):
            return "identifier", first
        if not _cased(c):
            return "caseless", first
        return ("upper" if c.isupper() else "lower"), first
    if c.isdigit():
        return "digit", first
    return ("opener" if first < at and c in ".?!…" else "mark"), first


def _word_before(text: str, start: int, at: int) -> int:
    """Where the word that ends at `at` begins, not before `start`."""
    near = max(start, at - 40)
    m = _WORD_BEFORE.search(text, near, at)
    k = m.start() if m else at
    if k == near:  # a long word: back to its beginning
        while k > start and not text[k - 1].isspace() and text[k - 1] not in _BREAKS:
            k -= 1
    return k


def _head(text: str, start: int, at: int) -> str:
    """The word before the one that begins at `at`."""
    while at > start and text[at - 1].isspace():
        at -= 1
    k = at
    while k > start and not text[k - 1].isspace():
        k -= 1
    return text[k:at]


def _weak_end(text: str, start: int, at: int, behind: int, end: int, run: str, known: Known) -> bool:
    """Whether a run of full stops or an ellipsis that ends at `behind` ends a sentence."""
    kind, follow = _next(text, behind, end)
    if kind == "end":
        return True
    if follow == behind and not _wide(text[behind]):
        if kind != "upper" or run != "." or not _GLUED.match(text, behind, end):
            return False
        word = text[_word_before(text, start, at) : at]
        return bool(word) and (word[0].islower() and len(word) > 1 or "." in word or "::" in word)
    if kind in ("lower", "mark"):
        return False
    last = text[at - 1] if at > start else ""
    if run != ".":
        if last.isspace() or _wide(last):
            return kind == "upper" and not last.isspace()
        if kind == "caseless":
            return _cased(last) or last.isdigit()
        return kind == "upper" or run == "…"
    begin = _word_before(text, start, at)
    low = text[begin:at].lower().lstrip("'’-")
    if low.isdigit():
        if len(low) <= 2 and kind in ("upper", "identifier"):
            if _head(text, start, begin).lower() in BEFORE_ORDINAL:
                return False
            name = _WORD.match(text, follow)
            return not (name and name[0].lower() in MONTHS)
        return True
    if low == "sr":  # after a name a part of it, after an article a title
        head = _head(text, start, begin)
        return len(head) > 3 and head[0].isupper()
    if low in MAY_END:
        if low in ("д", "п"):
            return _head(text, start, begin) in ("т.", ".") or text[start:begin].rstrip()[-2:] == "т."
        return True
    opens = kind != "upper" or _opener(text, follow, known)
    if low in BEFORE_NAME:
        return opens
    if low in NOUNS or low in TITLES:
        return kind == "upper" and opens
    if low in NEVER_ENDS:
        return False
    if low in BEFORE_NUMBER:
        return kind != "digit" and not (text[follow] in "§#(") and len(low) > 1
    if len(low) == 1 and low.isalpha():
        return False
    if _MULTI.match(low):
        return False
    if low in ("г", "гг") or low == "с":
        return kind != "identifier"
    if low in known.abbreviations:
        return kind == "upper" and opens
    return True


def _opener(text: str, at: int, known: Known) -> bool:
    if text[at] in _OPENERS:
        return True
    m = _WORD.match(text, at)
    return bool(m) and (m[0].lower() in OPENERS or m[0] in known.openers)


def _wide(c: str) -> bool:
    """Scripts written without spaces (not Thai)."""
    return "⺀" <= c <= "鿿" or "가" <= c <= "힣" or "豈" <= c <= "﫿" or "＀" <= c <= "￯" or "\U00020000" <= c <= "\U0003ffff"


def _goes_on(text: str, sentence: int, opened: int, close: int, end: int, marks: list[re.Match]) -> bool:
    """Whether a sentence goes on behind a bracket or quote whose content ends with an end mark."""
    opener = text[opened]
    kind, follow = _next(text, close, end)
    if kind == "end":
        return False
    if kind in ("lower", "mark"):
        return True
    at_start = not text[sentence:opened].strip(" \t\r\n—–")
    if opener in "(（[［【":
        return not at_start
    if opener in "《〈":
        return True
    c = text[follow]
    if _wide(c) or (kind == "identifier" and follow == close and _wide(text[close - 1])):
        if opener in "「『｢" or "぀" <= c <= "ヿ":
            first = _wide_lattices()[0].path(text[follow : _stop(marks, follow, end)])[:1]
            if first and first[0] in PARTICLES_JA:
                return True
        if not at_start or c in _OPENERS:
            return False
        return any(w in SAYING_ZH for w in _wide_lattices()[1].path(text[follow : _stop(marks, follow, end)]))
    if not at_start or c in _OPENERS:
        return False
    said = text[follow : _stop(marks, follow, end)].split()
    return any(w.strip(",;:").lower() in SAYING for w in (said[:3] if kind != "caseless" else said[:1] + said[-2:]))


def _stop(marks: list[re.Match], at: int, end: int) -> int:
    """The first end mark from `at` on."""
    k = bisect_left(marks, at, key=re.Match.start)
    return marks[k].start() if k < len(marks) else end


def sentences(text: str, known: Known = NOTHING) -> list[tuple[int, int]]:
    """(start, end) of each sentence, heading or list item of a text, in order; code points from 0."""
    out: list[tuple[int, int]] = []
    end = _ends(_EVERY.intersection(text), not text.isascii() and _GREEK_OR_GAPPED.search(text) is not None)
    for a, b in blocks(text):
        _block(text, a, b, out, end, known)
    return out


def _block(text: str, a: int, b: int, out: list[tuple[int, int]], terminals: re.Pattern, known: Known) -> None:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    if a >= b:
        return
    closed = spans(text, a, b) if _BRACKET.search(text, a, b) else {}
    inner = sorted((o, c) for c, (o, _) in closed.items())
    k, start = 0, a
    marks = list(terminals.finditer(text, a, b))
    for m in marks:
        at, behind = m.span()
        if at < start:
            continue
        run = m[0]
        while k < len(inner) and inner[k][1] < at:
            k += 1
        inside = k < len(inner) and inner[k][0] < at
        if run.isspace():
            first = at
            while first > start and _gapped(text[first - 1]):
                first -= 1
            if inside or not gap(text[first:at], _STRETCH.match(text, behind, b)[0], known):
                continue
            out.append((start, at))
            start = behind
            continue
        if inside:
            close = inner[k][1]
            if text[behind:close].strip(_CLOSERS + _BLANKS):
                continue  # not at the end of the bracket or quote
            close += 1
            if not _goes_on(text, start, inner[k][0], close, b, marks):
                start = _emit(text, start, close, b, out)
            else:
                # a full stop right behind the quote still ends the sentence; it is a run of its own
                continue
            continue
        strong = run.strip(".…")
        stop = behind
        while stop < b and text[stop] in "’')]”\"»" and stop not in closed and not _opens(text, stop, b):
            stop += 1
        if strong:
            c = strong[-1]
            if c in _STRONG or _wide(c):
                start = _emit(text, start, stop, b, out)
                continue
            kind, follow = _next(text, stop, b)
            if kind == "end" or (kind not in ("lower", "mark") and (follow > stop or _wide(text[follow]) or _GLUED.match(text, stop, b))):
                start = _emit(text, start, stop, b, out)
            continue
        if _weak_end(text, start, at, stop, b, run, known):
            start = _emit(text, start, stop, b, out)
    if start < b:
        _emit(text, start, b, b, out)


def _gapped(c: str) -> bool:
    return "฀" <= c <= "໿"


def _opens(text: str, at: int, end: int) -> bool:
    return text[at] in "\"«»“" and at + 1 < end and not text[at + 1].isspace()


def _emit(text: str, start: int, stop: int, end: int, out: list[tuple[int, int]]) -> int:
    """Add a sentence if it holds a letter or digit; the place where the next one starts."""
    last = stop
    while last > start and text[last - 1].isspace():
        last -= 1
    if any(c.isalnum() for c in text[start:last]):
        out.append((start, last))
    while stop < end and text[stop].isspace():
        stop += 1
    return stop


# --- learning ---------------------------------------------------------------------------------------------

#: A word before a full stop, and how what follows begins.
_STOPPED = re.compile(r"(?<![\w.])([^\W\d_]{2,12})\.(?:(,|;)|\s+(\w))")
#: A word with a capital behind white space or at the beginning.
_CAPITAL = re.compile(r"(?<!\S)([A-ZÀ-ÖØ-ÞĀ-ŽΆ-ΫЀ-Я][^\W\d_]*)(?!\w)")
#: Times that a word or an edge must be seen, at least; entries of each kind that are sent to the tasks, at most.
LEAST_SEEN, MOST_KNOWN = 5, 100_000


def _counted(text: str, counts: Counter) -> None:
    """Adds to (kind, key, certain) what a text shows."""
    for m in _STOPPED.finditer(text):
        counts["stop", m[1].lower(), bool(m[2]) or bool(m[3]) and m[3].islower()] += 1
    for m in _CAPITAL.finditer(text):
        at = m.start()
        k = at
        while k > 0 and text[k - 1].isspace():
            k -= 1
        c = text[k - 1] if k else ""
        if not c or c in "!?" or c == "." and k > 4 and text[k - 5 : k - 1].islower() or text.count("\n", k, at) > 1:
            counts["open", m[1], True] += 1
        elif c.isalnum() or c in ",;":
            counts["open", m[1], False] += 1
    if not _STRETCH.search(text):
        return
    for a, b in blocks(text):
        found = [m.span() for m in _STRETCH.finditer(text, a, b)]
        for n, (x, y) in enumerate(found):
            first, last = not text[a:x].strip(), not text[y:b].strip()
            before = n > 0 and text[found[n - 1][1] : x].isspace()
            behind = n + 1 < len(found) and text[y : found[n + 1][0]].isspace()
            for kind, certain, gapped in (("start", first, before), ("end", last, behind)):
                if certain or gapped:
                    for size in EDGE:
                        if size <= y - x:
                            counts[kind, text[x : x + size] if kind == "start" else text[y - size : y], certain] += 1


def learn(documents: DataFrame) -> Known:
    """What all rows (id, text) show, as `Known`. Counts are summed by task and then by key; what is rarer than LEAST_SEEN is left out, and of
    more than MOST_KNOWN entries of a kind the most frequent are taken, so that it can be sent to all tasks."""

    def batches(it):
        counts: Counter = Counter()
        for b in it:
            for t in b.column(0).to_pylist():
                if t:
                    _counted(t, counts)
            if len(counts) > 200_000:
                yield _rows(counts)
                counts.clear()
        yield _rows(counts)

    ship(documents.sparkSession)
    rows = documents.select("text").mapInArrow(batches, "kind string, key string, certain boolean, n bigint")
    seen = rows.groupBy("kind", "key").agg(F.sum(F.when(F.col("certain"), F.col("n")).otherwise(0)).alias("sure"), F.sum("n").alias("n")).where(F.col("n") >= LEAST_SEEN)
    seen = cut(seen, "seen")
    known: dict[str, dict[str, float]] = {}
    for kind, least in (("stop", 0.5), ("open", 0.9), ("start", 0.0), ("end", 0.0)):
        of = seen.where((F.col("kind") == kind) & (F.col("sure") >= F.col("n") * least))
        known[kind] = {r["key"]: r["sure"] / r["n"] for r in of.orderBy(F.desc("n"), "key").limit(MOST_KNOWN).collect()}
    return Known(frozenset(known["stop"]), frozenset(known["open"]), known["start"], known["end"])


def _rows(counts: Counter) -> pa.RecordBatch:
    keys = list(counts)
    columns = [pa.array([k[c] for k in keys], kind) for c, kind in enumerate((pa.string(), pa.string(), pa.bool_()))]
    return pa.RecordBatch.from_arrays([*columns, pa.array([counts[k] for k in keys], pa.int64())], ["kind", "key", "certain", "n"])


def sentence_units(documents: DataFrame, texts: bool = True, known: Known = NOTHING) -> DataFrame:
    """One row for each sentence of each row (id, text): id, sentence (from 0), start_pos, end_pos and, if `texts`, text. `known` is
    what `learn` found in these or other documents.

    Rows are taken as they are, further columns are ignored; null and blank texts give no row. Places count code points from 0.
    """

    def batches(it):
        for b in it:
            ids, number, start, end, said = [], [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not t:
                    continue
                found = sentences(t, shared.value)
                ids += [i] * len(found)
                number += range(len(found))
                start += [x for x, _ in found]
                end += [x for _, x in found]
                if texts:
                    said += [t[x:y] for x, y in found]
            columns = [pa.array(ids, pa.int64()), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())]
            names = ["id", "sentence", "start_pos", "end_pos"]
            if texts:
                columns.append(pa.array(said, pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = "id bigint, sentence int, start_pos bigint, end_pos bigint" + (", text string" if texts else "")
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(known)
    return documents.select("id", "text").mapInArrow(batches, kind)

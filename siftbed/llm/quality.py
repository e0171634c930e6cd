"""Per-document text statistics, and what kind of text a document is: prose, list, table, code or junk.

A document is described by distributions: of its function words against other words and of their distance from the
prose of the nearest language, of character classes, of word lengths, of line lengths, line beginnings, line ends and
line structures, of cells, and of what repeats, is broken or belongs to navigation. A structural profile is one such
set of distributions. Profiles are fitted on hand-labelled documents: labels that their nearest neighbours contradict
are left out, and the rest of each kind is divided into a few clusters by Jensen-Shannon divergence. A document gets the
kind of the nearest profile, by the weighted sum of the divergences of all its distributions.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftbed.llm.profile_texts import SEEDS
from siftbed.session import spread

KINDS = ("prose", "list", "table", "code", "junk")

# Function words of the languages with a profile, with their usual share of all words in per mille.
FUNCTION_WORDS = {
    "en": {"the": 60, "of": 30, "and": 28, "to": 26, "a": 23, "in": 20, "is": 11, "that": 11, "it": 10, "was": 9, "for": 9, "on": 7, "with": 7, "as": 7, "i": 10, "be": 6, "by": 5, "this": 5, "we": 5, "at": 5, "are": 5, "but": 5, "not": 5, "had": 4, "his": 4, "from": 4, "or": 4, "have": 4, "an": 3, "they": 3, "which": 3, "our": 2, "their": 3, "some": 2, "each": 1, "every": 1, "another": 1, "one": 3, "so": 3, "while": 1, "because": 1, "will": 2, "can": 2, "would": 2, "could": 1, "you": 6, "all": 3, "my": 3, "if": 2, "no": 2, "when": 2, "after": 1, "before": 1},
    "de": {"der": 33, "die": 35, "und": 28, "das": 14, "in": 20, "den": 13, "von": 12, "zu": 12, "mit": 9, "ist": 9, "sich": 8, "des": 7, "auf": 8, "für": 7, "nicht": 8, "ein": 8, "eine": 7, "im": 7, "dem": 8, "es": 6, "an": 6, "als": 5, "auch": 5, "wie": 4, "nach": 4, "vor": 3, "aus": 4, "wird": 4, "bei": 4, "ich": 6, "wir": 3, "einen": 3, "jede": 1, "unser": 1, "seit": 1, "weil": 1, "obwohl": 1, "niemand": 1, "dann": 2, "zum": 2},
    "fr": {"de": 45, "la": 28, "le": 26, "et": 22, "les": 18, "des": 15, "en": 12, "un": 11, "une": 10, "du": 10, "dans": 8, "que": 9, "est": 10, "qui": 7, "il": 7, "pour": 7, "au": 5, "sur": 6, "pas": 5, "par": 5, "ce": 5, "je": 6, "se": 4, "plus": 4, "ne": 5, "son": 4, "avec": 4, "parce": 1, "depuis": 1, "sans": 2, "tout": 2, "ensuite": 1, "personne": 1, "trop": 1, "même": 1, "comme": 2, "nous": 3, "cette": 2},
    "es": {"de": 50, "la": 33, "que": 26, "el": 25, "en": 22, "y": 21, "a": 18, "los": 13, "del": 10, "las": 9, "un": 9, "por": 8, "con": 8, "no": 8, "una": 8, "su": 6, "para": 7, "es": 7, "al": 6, "lo": 6, "como": 5, "más": 4, "se": 9, "o": 4, "pero": 3, "porque": 2, "todo": 2, "muy": 2, "mi": 2, "este": 2, "desde": 1, "aunque": 1, "nadie": 1, "mucho": 1, "luego": 1, "sin": 2},
}
CLASSES = ("lower", "upper", "digit", "space", "line", "sentence", "quote", "bracket", "operator", "rule", "accent", "broken")
# Words of navigation that remain of web pages.
_NAVIGATION = re.compile(r"(?i)^(?:skip to content|share|pricing|sign (?:in|up|out)|log ?(?:in|out)|©.*|copyright.*|cookie (?:settings|policy)|accept all cookies|follow us|next ?>?|< ?prev(?:ious)?|prev(?:ious)?|docs|home|menu|load more|contact(?: us)?|about(?: us)?|search|subscribe|privacy(?: policy)?|terms(?: of (?:use|service))?|back to top|read more|click here|help|careers|blog|newsletter|\W*)$")

# Phrases of navigation inside of running text, in any case and as they are written.
_PHRASES = ["skip to content", "pricing", "sign in", "sign up", "sign out", "log in", "log out", "cookie settings", "accept all cookies", "follow us", "load more", "back to top", "read more", "privacy policy", "terms of use", "terms of service", "contact us", "about us", "subscribe", "next >", "< prev"]
_CAPITALS = ["Home ", "Menu ", "Docs ", "Share ", "©"]
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_BULLET = re.compile(r"^\s*(?:(?:[-*+•–·▪◦‣●○]|\(?\d{1,4}[.):]|\(?[a-zA-Z][.)]|#\d+)\s+(?:\[[ xX]\]\s*)?|\[[ xX]\]\s+|[•▪◦‣●○])")
_RULE = re.compile(r"^\s*[|+:=\-_─│┼*#~. ]{3,}\s*$")
_HEADING = re.compile(r"^\s*#{1,6} \S|^\s*[A-Z][\w ]{0,40}:\s*$")
_HTML_ROW = re.compile(r"(?i)</?(?:table|thead|tbody|tr|td|th)\b")
_HEX = re.compile(r"^\s*[0-9a-fA-F]{4,8}:?\s+(?:[0-9a-fA-F]{2,4}\s+){6,}")
_SOLID = re.compile(r"^[A-Za-z0-9+/=_-]{40,}$")
_SPEAKER = re.compile(r"^\s*(?:user|assistant|system|human|bot|ai|you|me|[A-Z][a-z]+)\s?[:>]\s+(?=\S+ \S+ \S+)", re.I)
_MOJIBAKE = re.compile(r"Ã[\x80-\xbf©¨¼¤³º¶ŸœŒ¡±ªÂ«®¯°²´µ·¸¹»½¾¿§¦¥£¢]|â€|Â[\x80-\xbf°©®]|ï¿½|�")
_CODE = re.compile(
    r"""(?x)^\s*(?:
    (?:import|from)\s+[\w.{*]|def\s+\w+\(|class\s+\w+[(:{]|return\b|if\s.*[:{)]\s*$|elif\s|else\s*[:{]|for\s.*[:{;]\s*$|while\s.*[:{]|with\s.*:\s*$|try\s*[:{]|except\b.*:|raise\s|assert\s|async\s|await\s|print\(
    |(?:const|let|var)\s+[\w{]|export\s+(?:async|default|const|function|class|\w+=)|function\b|throw\s|module\.exports|func\s|type\s+\w+\s+(?:struct|interface)|package\s+\w|\w[\w.]*\s*:?=\s*\S|\w[\w.]*\(.*\)\s*;?\s*(?:\#.*|//.*)?$
    |[})\]]+[;,)]*\s*$|.*[{;]\s*$|//|/\*|\*/|\#\s?\S|--\s|@\w+|<\?|\#!|<[/!]?[\w-]+[^>]*>\s*$|<[\w-]+[^>]*>.*</[\w-]+>\s*$
    |(?:SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER|GRANT|FROM|WHERE|GROUP\sBY|ORDER\sBY|HAVING|JOIN|LEFT|INNER|VALUES|SET|AND|LIMIT|WITH)\b.*
    |(?:RUN|CMD|ENV|COPY|ADD|WORKDIR|EXPOSE|ENTRYPOINT|ARG)\s\S
    |\$\s|(?:sudo|git|docker|kubectl|grep|awk|sed|cat|echo|cd|ls|mv|cp|rm|mkdir|chmod|export|curl|wget|ssh|scp|tail|head|make|npm|pip|python3?|node|tar|find|do|done|fi|then|case|esac|psql|mysql|redis-cli|sshpass|helm|terraform)(?:\s+[-./~\w"$*|]|\s*$|;)(?!\w*\s(?:the|a|an|of|our|their)\s)
    |[\w.-]+:\s*(?:[\w./"'\[{$-][^\s]*)?\s*$|-\s+[\w.-]+:\s*\S*\s*$|\[[\w.\s"-]+\]\s*$|"[\w.$-]+"\s*:\s*.*[,{\[]?$|\{.*\}[,;]?\s*$|[\w-]+\s+[A-Z]+(?:\(\d+\))?(?:\sNOT\sNULL)?,?\s*$
    |\w+\s+\w+\s+`[^`]*`\s*$
    )"""
)
#: An entry of a list without marks: a few plain words or one path.
_ENTRY = re.compile(r"^[A-Z]?[\w-]+(?: [\w-]+){1,4}$|^[\w.-]+(?:[/\\][\w.-]+)+$|^[\w-]+\.[a-z]{1,5}$|^[A-Za-z][\w-]*$")
_LOG = re.compile(r"^\s*(?:\[?\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}|\d{1,3}(?:\.\d{1,3}){3}\s|(?:DEBUG|INFO|WARN|WARNING|ERROR|TRACE|FATAL)\b)")
_GAPS = re.compile(r"\S(?:\s{2,}|\t)(?=\S)")


def entropies(p: np.ndarray) -> np.ndarray:
    """Sum of p log p in bits along the last axis."""
    return (p * np.log2(p)).sum(axis=-1)


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of `p` from each row of `q`: 0 for equal, 1 for disjoint distributions."""
    p, q = np.maximum(p, 1e-12), np.maximum(q, 1e-12)
    return (entropies(p)[:, None] + entropies(q)[None, :]) / 2 - entropies((p[:, None, :] + q[None, :, :]) / 2)


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon divergence of two distributions in bits."""
    return float(divergences(p[None, :], q[None, :])[0, 0])


_BYTE_CLASS = np.full(256, CLASSES.index("accent"))
for _c in range(128):
    _ch = chr(_c)
    _BYTE_CLASS[_c] = CLASSES.index(
        "lower" if _ch.islower() else "upper" if _ch.isupper() else "digit" if _ch.isdigit() else "line" if _ch in "\n" else "space" if _ch in " \t\r" else "broken" if _c < 32 or _c == 127
        else "sentence" if _ch in ".,!?;:-" else "quote" if _ch in "'\"`" else "bracket" if _ch in "()[]{}<>" else "rule" if _ch in "|_~#*" else "operator"
    )


def class_counts(text: str) -> np.ndarray:
    """How many characters of each class; other letters count as accents, replacement characters as broken."""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    raw = np.bincount(_BYTE_CLASS[data], minlength=len(CLASSES)).astype(float)
    if len(data) != len(text):
        broken = text.count("�")
        raw[_ACCENT] = len(text) - np.count_nonzero(data < 128) - broken
        raw[_BROKEN] += broken
    return raw


_ACCENT, _BROKEN = CLASSES.index("accent"), CLASSES.index("broken")
_WORD_PROFILES = {language: np.append(q := np.array(list(shares.values())) / 1000, 1 - q.sum()) for language, shares in FUNCTION_WORDS.items()}


_WORD_PLACES = {language: {w: k for k, w in enumerate(shares)} for language, shares in FUNCTION_WORDS.items()}
_ANY_FUNCTION = {w for shares in FUNCTION_WORDS.values() for w in shares}


def known_words(counts: Counter) -> dict[str, int]:
    """How many words of a text are function words of each language."""
    common = counts.keys() & _ANY_FUNCTION
    return {language: sum(counts[w] for w in common if w in places) for language, places in _WORD_PLACES.items()}


def word_divergence(counts: Counter, total: int, known: dict[str, int] | None = None) -> tuple[float, str]:
    """The least divergence from a language's profile of function words, all other words being one class, and the language."""
    known = known or known_words(counts)
    most, best = max(known.values(), default=0), (1.0, "")
    common = counts.keys() & _ANY_FUNCTION
    for language, n in known.items():
        # Languages share a few words: one with far fewer of its own than another can't be the nearest.
        if not n or 2 * n < most:
            continue
            # A text prefers some function words to others; square roots temper that without changing their sum.
        places, own, q = _WORD_PLACES[language], [w for w in common if w in _WORD_PLACES[language]], _WORD_PROFILES[language]
        p = np.sqrt(np.array([counts[w] for w in own], dtype=float))
        p, at = np.append(p * (n / total / p.sum()), max(1e-12, 1 - n / total)), [places[w] for w in own] + [-1]
        # Words that don't occur add half of their share in the profile.
        q_at = q[at]
        m = (p + q_at) / 2
        far = (p * np.log2(p / m)).sum() / 2 + (q_at * np.log2(q_at / m)).sum() / 2 + (1 - q_at.sum()) / 2
        best = min(best, (max(0.0, float(far)), language))
    return best


_MARKS, _QUOTES = (".", "!", "?", "…", "。"), "'\"”’)»"


def _ends(s: str) -> bool:
    """Whether a stripped line ends a sentence, quotes aside."""
    return s.rstrip(_QUOTES).endswith(_MARKS)


def _cells(s: str, n: int) -> int:
    """The number of cells of a table row in the notation that a stripped line of `n` words seems to have; 0 if it is no row."""
    if "<" in s and _HTML_ROW.search(s):
        return 9
    if s.count("|") >= 2 and (s[0] == "|" or s[-1] == "|" or s.count(" | ") >= 2):
        return s.strip("|").count("|") + 1
    if "\t" in s and len(s.split("\t")) >= 2:
        return len(s.split("\t"))
    gaps = len(_GAPS.findall(s)) if "  " in s or not s.isascii() else 0
    if gaps >= 2 or gaps == 1 and n <= 6 and not _ends(s):
        return gaps + 1
    for mark in (",", ";", " & ", "|", "^", "~"):
        m = s.count(mark)
        if m >= 2 or m == 1 and mark in ",;|" and n <= 4:
            parts = s.rstrip(mark).split(mark)
            if len(parts) < 2:
                continue
            if sum(len(p.split()) for p in parts) <= 3 * len(parts) and not _ends(s) and max(len(p.split()) for p in parts) <= 4:
                return len(parts)
    return 0


def line_kinds(lines: list[str], stripped: list[str], numbers: list[int], cells: list[int], bullets: list[re.Match | None]) -> list[str]:
    """What each line is by its structure: rule, heading, list, table, code, junk or text, given what was seen of them."""
    kinds: list[str] = []
    for k, (line, s, n, bullet) in enumerate(zip(lines, stripped, numbers, bullets)):
        if len(s) > 80 and s[0].isalpha() and not _NO_PROSE.search(s):
            kinds.append("text")
            continue
        bare = s.rstrip(",;.")
        first = s[0]
        if first in _HEXADECIMAL and _HEX.match(line) or _SOLID.match(s) and not s.isalpha() or len(s) > 200 and n <= 2:
            kinds.append("junk")
        elif not first.isalnum() and _RULE.match(line):
            kinds.append("table" if "|" in s or "+" in s else "rule")
        elif "<" in s and _HTML_ROW.search(s):
            kinds.append("table")
        elif cells[k] and "|" in s and sum(bool(_NAVIGATION.match(c.strip())) for c in s.split("|")) >= 0.6 * (s.count("|") + 1):
            kinds.append("junk")
        elif _NAVIGATION.match(s):
            kinds.append("navigation")
        elif n <= 5 and not bullet and _ENTRY.match(bare) and cells[k] < 2 and not any(w.lower() in _ANY_FUNCTION for w in bare.split()):
            kinds.append("entry")
        elif cells[k] >= 2 and (near := cells[max(0, k - 2) : k] + cells[k + 1 : k + 3]).count(cells[k]) >= min(2, len(near)) and not (bullet and "|" not in s and "\t" not in s) and not _LOG.match(line) and not s.endswith((";", "{", "(", "),")):
            kinds.append("table")
        elif bullet and not re.match(r"-\s+[\w-]+:\s*[\w/.\"'$-]*$", s):
            body = line[bullet.end() :]
            words = [w.lower() for w in _WORD.findall(body)]
            known = sum(w in _ANY_FUNCTION for w in words)
            kinds.append("text" if len(words) > 8 and known >= 0.2 * len(words) else "list")
        elif _HEADING.match(line):
            kinds.append("heading")
        elif bullet or _CODE.match(line) or _LOG.match(line):
            kinds.append("code")
        elif n <= 6 and not _ends(s) and not any(w.lower() in _ANY_FUNCTION for w in _WORD.findall(s)) and not _SPEAKER.match(line):
            kinds.append("entry")
        else:
            kinds.append("text")
    return kinds


#: A long line that begins with a letter and has none of this is running text.
_NO_PROSE = re.compile(r"[|\t{}=<>»·;\\_]| {2}|^\S+$|,\S|\(\)|^[A-Z]+ ")
_HEXADECIMAL = frozenset("0123456789abcdefABCDEF")
_LINE_KINDS = ("text", "list", "table", "code", "junk", "entry", "navigation", "heading", "rule")
_LINE_PLACE = {kind: k for k, kind in enumerate(_LINE_KINDS)}
#: Upper ends of the classes of words in a line and of letters in a word.
LINE_WORDS, WORD_LETTERS = (1, 2, 3, 5, 8, 12, 20, 40), (1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 14, 20)
_ENDS = {c: k for k, chars in enumerate((".!?…。！？।؟", ",;:、，", "{}()[]<>", "\"'`”’»", "|\\/=+-*_~#")) for c in chars}
_STARTS = {c: k for k, chars in enumerate(("|+", "#/-", "\"'", "<", "{}()[]", "$@"), start=4) for c in chars}

#: The distributions of a document: their names, numbers of classes, and weights in the distance from a profile.
DISTRIBUTIONS = {
    "characters": (len(CLASSES), 1.0), "line_ends": (7, 1.0), "line_starts": (11, 1.0), "line_words": (len(LINE_WORDS) + 1, 1.0), "cells": (3, 2.0), "word_letters": (len(WORD_LETTERS) + 1, 1.0),
    "function_words": (2, 2.0), "language": (2, 2.0), "line_kinds": (len(_LINE_KINDS), 3.0), "repeated": (2, 8.0), "broken": (2, 8.0), "navigation": (2, 4.0), "wordless": (2, 1.0),
}
_EDGES = np.cumsum([0, *(n for n, _ in DISTRIBUTIONS.values())])


def _share(x: float) -> list[float]:
    x = min(1.0, max(0.0, x))
    return [x, 1 - x]


def described(text: str | None) -> tuple[np.ndarray, dict]:
    """The counts of a text's distributions, one after the other, and its statistics. Null counts as empty."""
    text = text or ""
    lines = [x for x in text.split("\n") if x.strip()]
    low = text.lower()
    words, tokens = _WORD.findall(low), text.split()
    counts, classes = Counter(words), class_counts(text)
    n = max(1, len(words))
    of_languages = known_words(counts)
    known = max(of_languages.values()) / n
    far, language = word_divergence(counts, n, of_languages)
    stripped = [x.strip() for x in lines]
    sizes, numbers = list(map(len, stripped)), [len(s.split()) for s in stripped]
    cells = list(map(_cells, stripped, numbers))
    bullets = list(map(_BULLET.match, lines))
    kinds = line_kinds(lines, stripped, numbers, cells, bullets)
    where = []
    for k, (s, n, c, bullet, kind) in enumerate(zip(stripped, numbers, cells, bullets, kinds)):
        last, first = s[-1], s[0]
        where.append((
            _ENDS.get(last, 5 if last.isalpha() else 6), 0 if bullet else 1 if first.isupper() else 2 if first.isalpha() else 3 if first.isdigit() else _STARTS.get(first, 10),
            bisect_left(LINE_WORDS, n), 0 if c < 2 else 2 if k and cells[k - 1] == c or cells[k + 1 : k + 2] == [c] else 1, _LINE_PLACE[kind],
        ))
    columns = zip(*where) if where else [()] * 5
    ends, starts, lengths, in_cells, by_kind = (np.bincount(np.array(c, dtype=np.int64), sizes, m) for c, m in zip(columns, (7, 11, len(LINE_WORDS) + 1, 3, len(_LINE_KINDS))))
    word_sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    letters = np.bincount(np.searchsorted(WORD_LETTERS, word_sizes), minlength=len(WORD_LETTERS) + 1)
    repeated = _repetition(lines, tokens)
    broken = ((0 if text.isascii() else len(_MOJIBAKE.findall(text))) + classes[CLASSES.index("broken")]) / n
    navigation = 10 * (sum(map(low.count, _PHRASES)) + sum(map(text.count, _CAPITALS))) / max(1, len(text))
    groups = [classes, ends, starts, lengths, in_cells, letters, _share(known), _share(far), by_kind, _share(repeated), _share(broken), _share(navigation), _share(5 * len(words) / max(1, len(text)))]
    out = np.concatenate(groups)
    size, mass = max(1.0, classes.sum()), max(1.0, sum(sizes))
    common = sum(counts[w] for w in counts.keys() & _ANY_FUNCTION)
    sentence = sum(map(_ends, stripped))
    return out, {
        "n_chars": len(text), "n_words": len(words), "n_lines": len(lines), "mean_word_length": float(word_sizes.mean()) if words else 0.0,
        "symbol_ratio": float(classes[[CLASSES.index(c) for c in ("quote", "bracket", "operator", "rule", "broken")]].sum() / size), "digit_ratio": float(classes[CLASSES.index("digit")] / size),
        "line_end_share": sentence / len(lines) if lines else 0.0, "common_word_share": common / len(words) if words else 0.0, "repetition": repeated, "broken_ratio": broken,
        "word_divergence": far, "language": language, **{f"share_{k}": float(v / mass) for k, v in zip(_LINE_KINDS, by_kind)},
    }


#: The least share of a class in a distribution, so that one odd character doesn't decide.
FLOOR = 1e-3


def _smoothed(rows: np.ndarray) -> list[np.ndarray]:
    """The distributions of described texts, apart, each with the floor; without any count all classes are alike."""
    out = []
    for a, b in zip(_EDGES, _EDGES[1:]):
        part = rows[:, a:b]
        total = part.sum(axis=1, keepdims=True)
        part = np.maximum(np.divide(part, total, out=np.full(part.shape, 1 / (b - a)), where=total > 0), FLOOR)
        out.append(part / part.sum(axis=1, keepdims=True))
    return out


def normalised(rows: np.ndarray) -> np.ndarray:
    return np.concatenate(_smoothed(rows), axis=1)


def distances(rows: np.ndarray, profiles: np.ndarray) -> np.ndarray:
    """The weighted sum of the divergences of all distributions, of each row from each profile, block by block."""
    weights, far = [w for _, w in DISTRIBUTIONS.values()], _smoothed(profiles)
    step = max(1, 1_000_000 // max(1, len(profiles) * max(n for n, _ in DISTRIBUTIONS.values())))
    parts = [sum(w * divergences(p, q) for w, p, q in zip(weights, _smoothed(rows[at : at + step]), far)) for at in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.zeros((0, len(profiles)))


#: Clusters of a kind; nearest neighbours of a labelled document, and how many of them must have its label.
CLUSTERS, NEIGHBOURS, AGREEING = 12, 5, 2


@functools.cache
def _seeds() -> tuple[np.ndarray, tuple[str, ...]]:
    texts = [(kind, text) for kind, texts in SEEDS.items() for text in texts]
    return normalised(np.array([described(text)[0] for _, text in texts])), tuple(kind for kind, _ in texts)


def fit_profiles(texts: list[tuple[str, str | None]]) -> tuple[np.ndarray, list[str]]:
    """(profiles, their kinds) of (label, text) pairs and of the seed texts, whose profiles stand in where labels are few."""
    seeds, kinds = _seeds()
    labelled = [(label, text) for label, text in sorted(set(texts), key=str) if label in KINDS and text]
    profiles, of = list(seeds), list(kinds)
    if not labelled:
        return np.array(profiles), of
    rows = normalised(np.array([described(text)[0] for _, text in labelled]))
    labels = np.array([label for label, _ in labelled])
    every, names = np.concatenate([rows, seeds]), np.concatenate([labels, kinds])
    near = distances(rows, every)
    near[np.arange(len(rows)), np.arange(len(rows))] = np.inf
    nearest = np.argsort(near, axis=1, kind="stable")[:, :NEIGHBOURS]
    kept = (names[nearest] == labels[:, None]).sum(axis=1) >= AGREEING
    for kind in KINDS:
        own = rows[kept & (labels == kind)]
        if not len(own):
            continue
        # Each next centre is the document farthest from all before; then the centres move to their clusters' means.
        centres = own[:1]
        while len(centres) < min(CLUSTERS, len(own)):
            centres = np.concatenate([centres, own[[distances(own, centres).min(axis=1).argmax()]]])
        for _ in range(8):
            cluster = distances(own, centres).argmin(axis=1)
            centres = np.array([own[cluster == k].mean(axis=0) if (cluster == k).any() else centres[k] for k in range(len(centres))])
        profiles += list(centres)
        of += [kind] * len(centres)
    return np.array(profiles), of


def _repetition(lines: list[str], tokens: list[str]) -> float:
    """The share of a text that repeats itself: of its lines, or of its runs of four words, whichever is larger."""
    by_lines = 1 - len({x.strip() for x in lines}) / len(lines) if len(lines) >= 8 else 0.0
    runs = len(tokens) - 3
    by_words = 1 - len(set(zip(tokens, tokens[1:], tokens[2:], tokens[3:]))) / runs if runs >= 24 else 0.0
    # Lines that repeat are few words each in lists and code too; only their text counts where they are long enough.
    return max(by_words, by_lines if by_words > 0.3 else 0.0)


_COLUMNS = {
    "n_chars": "bigint", "n_words": "bigint", "n_lines": "bigint", "mean_word_length": "double", "symbol_ratio": "double", "digit_ratio": "double", "line_end_share": "double", "common_word_share": "double",
    "repetition": "double", "broken_ratio": "double", "word_divergence": "double", "language": "string", **{f"share_{k}": "double" for k in _LINE_KINDS}, "profile_distance": "double", "kind": "string",
}


def assigned(rows: np.ndarray, profiles: np.ndarray, kinds: list[str]) -> tuple[list[float], list[str]]:
    """The distance from the nearest profile and its kind, of each row."""
    far = distances(rows, profiles)
    at = far.argmin(axis=1)
    return far[np.arange(len(rows)), at].tolist(), [kinds[k] for k in at]


def text_statistics(
    documents: DataFrame, labels: DataFrame | None = None, *, record: str = "doc_id", text: str = "text", label: str = "label", sample_rows: int = 1_500
) -> DataFrame:
    """record, the statistics of every document (see `described`), the distance from the nearest profile, and its kind.

    The profiles are fitted on the texts of at most `sample_rows` labelled documents, chosen by a hash of their ids;
    wrong, null and contradicting labels are borne. One pass over whole texts without a shuffle follows. Null and empty
    texts have zeros and are junk; repeated documents have a row each; other columns are left out.
    """
    kind = documents.schema[record].dataType.simpleString()
    types = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    sample: list[tuple[str, str | None]] = []
    if labels is not None:
        chosen = labels.where(F.col(label).isin(*KINDS)).select(record, F.col(label).alias("label")).distinct()
        chosen = chosen.orderBy(F.xxhash64(record, "label"), record, "label").limit(sample_rows)
        sample = [(r[0], r[1]) for r in documents.select(record, text).join(F.broadcast(chosen), record).select("label", text).limit(2 * sample_rows).collect()]
    fitted = documents.sparkSession.sparkContext.broadcast(fit_profiles(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, kinds = fitted.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                values = batch.column(1).to_pylist()
                both = [described(v) for v in values]
                far, found = assigned(np.array([x for x, _ in both]), profiles, kinds)
                rows = [s | {"profile_distance": d, "kind": k if (v or "").strip() else "junk"} for (_, s), d, k, v in zip(both, far, found, values)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[c] for r in rows], types[t]) for c, t in _COLUMNS.items())], ["record", *_COLUMNS])

    out = spread(documents.select(record, text)).mapInArrow(run, f"record {kind}, " + ", ".join(f"{c} {t}" for c, t in _COLUMNS.items()))
    return out.withColumnRenamed("record", record)

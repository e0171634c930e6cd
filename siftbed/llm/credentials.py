"""Credentials embedded in source code, configuration, shell lines and chat.

First all strings of a text are measured by their characters per subword under the vocabulary of a public tokenizer:
words of languages and of code have long pieces in it, random strings and made-up passwords have none. Only the strings
found unnatural that way can become credentials; a text without any is done. Context rules are then combined with the
measure: the value assigned to a credential name, the argument of a command-line flag, the body of a PEM block, a
vendor's prefix, or a word for a credential nearby. The more certain the context, the more natural a string may be; the
password of a URI may even be a word. References, masks and placeholders are turned down. Redaction writes asterisks
over each span, so every offset outside of it stays as it was.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftbed.session import spread

TOKENIZER_DIR = "/opt/tokenizers"

#: Characters per subword at or below which a string is unnatural, by the strength of its context; words have 3 to 6.
#: Strings of letters of one case have to be less natural than others, as rare words have short pieces too.
STRONG, WEAK, NEARBY, LETTERS = 3.05, 2.85, 2.2, 1.9
#: Letters of the shortest string that is measured, and its subwords: fewer are too few to tell.
SHORTEST, SUBWORDS = 6, 3


@functools.lru_cache(maxsize=4)
def _encoder(directory: str):
    """The byte-level vocabulary in `directory`, applied to whole strings: their class changes don't split them first."""
    import tiktoken

    ranks = {}
    with open(f"{directory}/byte_bpe_50k.tiktoken", "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("subwords", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})


def chars_per_subword(text: str, directory: str = TOKENIZER_DIR) -> float:
    """Mean characters per subword of a string; 0.0 for an empty one."""
    return len(text) / len(_encoder(directory).encode_ordinary(text)) if text else 0.0


@functools.lru_cache(maxsize=1 << 18)
def _measure(string: str, directory: str) -> float:
    return len(string) / len(_encoder(directory).encode_ordinary(string))


_STRING = re.compile(r"[^\s\"'`“”‘’<>(){}\[\],;|=:@/&?\\]{6,}")


def unnatural_strings(text: str, directory: str = TOKENIZER_DIR) -> list[tuple[int, int, float]]:
    """(start, end, characters per subword) of the strings of a text that are unnatural in the strongest context."""
    out = []
    for m in _STRING.finditer(text):
        string = m[0]
        # Long strings aren't kept in the cache; words are, as they come again and again.
        mean = _measure(string, directory) if len(string) <= 32 else chars_per_subword(string, directory)
        if mean <= STRONG and len(string) >= SUBWORDS * mean:
            out.append((*m.span(), mean))
    return out


# The words that a credential's name ends with, and the words before `key` that make it one.
_WORD = r"pass(?:word|phrase|wd|wort)?|pwd|secret|token|auth|credentials?"
_KEY = r"(?:api|access|secret|private|encryption|signing|account|auth|master|shared|storage|subscription|license|ssh)[_.-]?key(?:[_.-]?id)?"
_NAME = rf"(?:{_WORD}|{_KEY})"
_OPEN = r"\\?[\"'`“‘]"
_BARE = r"[^\s\"'`“”‘’<>(){},;\\]+"
_QUOTED = r"[^\s\"'`“”‘’\\]+"
_VALUE = rf"(?:{_OPEN}(?P<q>{_QUOTED})(?=\\?[\"'`”’])|(?P<b>{_BARE}))"

# Rules as (name, whether the context alone is weak, of which literals lower-case text that fits has one, pattern with the value in q or b).
_RULES: list[tuple[str, bool, tuple[str, ...], str]] = [
    ("assignment", False, (), rf"(?i){_NAME}{_OPEN}?\s?[\])]?\s*(?:=>|:=|=|:|,(?=\s*{_OPEN}))\s*(?:convertto-securestring\s+)?{_VALUE}"),
    ("attribute", False, ("value",), rf"(?i){_NAME}[\"']\s+value\s*=\s*{_VALUE}"),
    ("element", False, ("</",), rf"(?i)<[\w.:-]*{_NAME}>\s*(?P<b>[^\s<>]+)\s*</"),
    ("sentence", True, ("is", "was", "are"), rf"(?i){_NAME}\s+(?:is|was|are)\s*:?\s+{_VALUE}"),
    ("login", True, ("pass",), rf"(?i)\bpass(?:word|wd)?\s+(?:as\s+)?{_VALUE}"),
    ("secure string", False, ("securestring",), rf"(?i)convertto-securestring\s+(?:-string\s+)?{_VALUE}"),
    ("identified", False, ("identified",), rf"(?i)identified\s+(?:with\s+\w+\s+)?by\s+{_VALUE}"),
    ("environment", False, ("env",), rf"(?i)\benv\s+[\w.-]*{_NAME}\s+{_VALUE}"),
    ("named value", False, ("value:",), rf"(?i){_NAME}{_OPEN}?\s*\n\s*value:\s*{_VALUE}"),
    ("default", False, ("default",), rf"(?is)variable\s+\"[\w.-]*{_NAME}\"\s*\{{[^}}]*?default\s*=\s*{_VALUE}"),
    ("bare value", True, ("value", "default"), rf"(?i)^\s*(?:value|default)\s*[=:]\s*{_VALUE}"),
    ("long flag", False, ("--",), rf"(?i)--[\w-]*{_NAME}(?:\s+|=){_VALUE}"),
    ("password flag", True, ("-p", "-a", "-w"), rf"(?<![\w-])-[paw](?![a-z]+=)\s*{_VALUE}"),
    ("user flag", True, ("-u",), rf"(?<![\w-])-u\s+{_OPEN}?[\w.@-]+:(?P<b>{_BARE})"),
    ("bearer", False, ("bearer", "basic"), rf"(?i)\b(?:bearer|basic)\s+(?P<b>{_BARE})"),
    ("uri", False, ("://",), rf"(?i)\b[a-z][a-z0-9+.-]*://[^\s/:@\"'<>?#]*:<?(?P<b>[^\s/@\"'<>]+)>?@"),
    ("signature", False, ("sig", "signature"), rf"(?i)(?<![a-z])(?:sig|signature|x-amz-signature)=(?P<b>[a-z0-9%+/=_.~-]+)"),
]

#: Rules whose place holds nothing but a password.
_CERTAIN = {"uri", "identified"}

# Shapes of self-describing tokens, by their vendors' prefixes.
_VENDOR = [
    ("akia", r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])"),
    ("asia", r"ASIA[A-Z0-9]{16}(?![A-Z0-9])"),
    ("aiza", r"AIza[\w-]{33,40}"),
    ("gh", r"gh[pousr]_[A-Z0-9]{36,}"),
    ("github_pat_", r"github_pat_\w{30,}"),
    ("glpat-", r"glpat-[\w-]{20,}"),
    ("xox", r"xox[abeoprs]-[A-Z0-9-]{20,}"),
    ("k_live_", r"[sr]k_live_[A-Z0-9]{20,}"),
    ("sg.", r"SG\.[\w-]{16,}\.[\w-]{30,}"),
    ("sk-", r"sk-(?:proj|ant|svcacct|[a-z]+\d*)-[\w-]{30,}"),
    ("hf_", r"hf_[A-Z0-9]{30,}"),
    ("npm_", r"npm_[A-Z0-9]{36,}"),
    ("dop_v1_", r"dop_v1_[a-f0-9]{64}"),
    ("glsa_", r"glsa_[A-Z0-9]{32}_[a-f0-9]{8}"),
    ("eyj", r"eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{20,}"),
]
_PEM = r"(?is)-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:(?!-----BEGIN).)*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"

# Words that stand where a credential would.
_PLACEHOLDER = re.compile(r"(?i)change_?me|your[-_]|example|placeholder|dummy|redacted|insert[-_]|replace[-_]|todo|<[^>]*>?|\*{3,}|x{6,}|\.{3,}|^(?:none|null|true|false|undefined|string|secret|password)$")
_REFERENCE = re.compile(r"^(?:[$%#@]|\{\{|process\.env|os\.|env\.|ENV\[|getenv|vault:|ssm:|arn:|file:|/|\./|~/|https?:|[\w.]+\()|\$\{|\w\(|\w\[|\w\.\w+\(")
_LETTER = re.compile(r"[^\W\d_]")


#: The hit that stands for the name of a credential, which rules with _NAME need besides their own literals.
_NAMED = 300
#: Characters that the rules take for letters in any case, though their lower case is another.
_FOLDED = str.maketrans({"ſ": "s", "ı": "i", "İ": "i"})


@functools.lru_cache(maxsize=1)
def _triggers() -> ahocorasick.Automaton:
    """An automaton over lower-case text whose hits name the rules worth running."""
    automaton, found = ahocorasick.Automaton(), {}
    for rule, (_, _, literals, _) in enumerate(_RULES):
        for literal in literals:
            found.setdefault(literal, set()).add(rule)
    # What every credential name has in it.
    for word in ("pass", "pwd", "secret", "token", "auth", "credential", "key"):
        found.setdefault(word, set()).add(_NAMED)
    for k, (literal, _) in enumerate(_VENDOR):
        found.setdefault(literal, set()).add(100 + k)
    found.setdefault("private key", set()).add(200)
    for literal, rules in found.items():
        automaton.add_word(literal, tuple(sorted(rules)))
    automaton.make_automaton()
    return automaton


@functools.lru_cache(maxsize=1)
def _compiled() -> tuple[list[re.Pattern], list[re.Pattern], re.Pattern]:
    return [re.compile(r[3]) for r in _RULES], [re.compile(rf"(?i)(?<![A-Z0-9]){shape}") for _, shape in _VENDOR], re.compile(_PEM)


#: Names of code stand where a value would: constants, attributes, names in snake case.
_IDENTIFIER = re.compile(r"[A-Z]+(?:_[A-Z]+)+|[A-Za-z]+(?:[._-][A-Za-z]+)+|[A-Z]{1,10}")
#: In a weak context, words with a number (int64, pg-12), host names and words of one case are no credentials.
_ORDINARY = re.compile(r"[\w-]+(?:\.[\w-]+)+|[a-z]+[-_/]?\d+|[A-Za-z]+[.!?]*")


def _encoded(value: str, directory: str) -> bool:
    """Whether a value that begins like a path is an encoded one: nothing but unnatural characters of several classes."""
    return value[0] == "/" and bool(_MIXED.fullmatch(value)) and "." not in value and chars_per_subword(value, directory) <= LETTERS


def credible(value: str, weak: bool, directory: str = TOKENIZER_DIR, certain: bool = False) -> bool:
    """Whether a value in the place of a credential is one: unnatural enough for the place, and no placeholder or reference.

    Where the place holds nothing but passwords (`certain`), a word is one too.
    """
    if _PLACEHOLDER.search(value) or (_REFERENCE.search(value) and not _encoded(value, directory)):
        return False
    if certain:
        return len(value) >= 4
    if len(value) < SHORTEST or not _LETTER.search(value) or _IDENTIFIER.fullmatch(value):
        return False
    mean = _measure(value, directory) if len(value) <= 32 else chars_per_subword(value, directory)
    if value.isalpha() and (value.islower() or value.istitle()):
        return not weak and mean <= LETTERS and len(value) >= 8
    if weak:
        return mean <= WEAK and len(value) >= 8 and not _ORDINARY.fullmatch(value)
    return mean <= STRONG


#: What stands before a string that only a word nearby makes a credential: such a word in one of several languages.
_NEAR_WORD = re.compile(r"(?i)(?<![a-z])(?:pass(?:word|wort|phrase|code)?|pw|pwd|secret|token|credentials?|api[ _-]?key|kennwort|zugangsdaten|geheimnis|mot de passe|jeton|contrase[ñn]a|clave|palabra clave)(?![a-z])[^\n\w]{0,20}(?:(?:is|was|are|ist|lautet|est|es|now|for|the|new|old|neue|nouveau|nueva)[^\n\w]{1,5}){0,3}$")
_MIXED = re.compile(r"(?=.*\d)(?=.*[a-z])(?=.*[A-Z])[\w+/=!@#$%^&*~.-]{10,}")


def nearby(text: str, start: int, string: str, mean: float) -> bool:
    """Whether an unnatural string without a rule is a credential: mixed characters right after a word for one."""
    if mean > NEARBY or not _MIXED.fullmatch(string) or _PLACEHOLDER.search(string) or _REFERENCE.search(string):
        return False
    return bool(_NEAR_WORD.search(text, max(0, start - 80), start))


def _worth_running(text: str) -> set[int]:
    """The rules that may match somewhere in a text: all that do, and few others."""
    lower = text.lower() if text.isascii() else text.translate(_FOLDED).lower()
    hits = {rule for _, rules in _triggers().iter(lower) for rule in rules}
    named = _NAMED in hits
    hits.discard(_NAMED)
    hits |= {k for k, rule in enumerate(_RULES) if not rule[2]}
    return {k for k in hits if k >= len(_RULES) or named or _NAME not in _RULES[k][3]}


def find_credentials(text: str | None, directory: str = TOKENIZER_DIR) -> list[tuple[int, int, str]]:
    """(start, end, rule) of the credentials in a text in order, without overlaps; of overlapping spans the longest stays."""
    if not text:
        return []
    hits = _worth_running(text)
    strings = unnatural_strings(text, directory)
    if not strings:
        # Nothing to find but passwords that may be words.
        hits = {k for k in hits if k < 100 and _RULES[k][0] in _CERTAIN}
    if not hits and not strings:
        return []
    rules, vendors, pem = _compiled()
    spans: list[tuple[int, int, str]] = []
    if 200 in hits:
        spans += [(*m.span(), "private key") for m in pem.finditer(text)]
    for k in hits:
        if 100 <= k < 200:
            for m in vendors[k - 100].finditer(text):
                if not _PLACEHOLDER.search(m.group()):
                    spans.append((*m.span(), "token"))
    for k in hits:
        if k < 100:
            name, weak = _RULES[k][:2]
            for m in rules[k].finditer(text):
                group = "b" if m["b"] is not None else "q"
                start, value = m.start(group), m[group]
                if group == "b":
                    value = _trimmed(value, name)
                if credible(value, weak, directory, name in _CERTAIN):
                    spans.append((start, start + len(value), name))
    for a, b, mean in strings:
        b -= len(text[a:b]) - len(text[a:b].rstrip(".!?*"))
        if all(b <= x or a >= y for x, y, _ in spans) and nearby(text, a, text[a:b], mean):
            spans.append((a, b, "nearby"))
    spans.sort(key=lambda s: (s[0] - s[1], s[0]))
    kept: list[tuple[int, int, str]] = []
    for start, end, name in spans:
        if all(end <= a or start >= b for a, b, _ in kept):
            kept.append((start, end, name))
    return sorted(kept)


def _trimmed(value: str, rule: str) -> str:
    """A bare value without the punctuation of the sentence or URL around it."""
    if rule == "assignment":
        value = value.split("&", 1)[0]
    if rule in ("sentence", "login", "assignment"):
        value = value.rstrip(".?!:|*") if value[-1:] in ".?:|*" else value
    return value


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """`text` with asterisks over each span: the same length, line breaks kept."""
    parts, at = [], 0
    for start, end, _ in spans:
        parts += [text[at:start], re.sub(r"[^\r\n]", "*", text[start:end])]
        at = end
    return "".join([*parts, text[at:]])


_FOUND = "secrets array<string>, starts array<int>, rules array<string>, redacted string"


def scan_texts(texts: DataFrame, *, record: str = "message_id", text: str = "text", directory: str = TOKENIZER_DIR) -> DataFrame:
    """record, secrets, starts, rules, redacted: of every text the credentials, their offsets and the masked text.

    A null text has null in `redacted` and empty arrays; a text without credentials is its own redaction. Rows keep
    their number and other columns are left out. The scan is one pass over whole texts without a shuffle.
    """
    kind = texts.schema[record].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).to_pylist()
            found = [find_credentials(v, directory) for v in values]
            secrets = [[v[a:b] for a, b, _ in s] for v, s in zip(values, found)]
            arrays = [pa.array(secrets, pa.list_(pa.string())), pa.array([[a for a, _, _ in s] for s in found], pa.list_(pa.int32())), pa.array([[r for _, _, r in s] for s in found], pa.list_(pa.string()))]
            redacted = pa.array([redact(v, s) if s else v for v, s in zip(values, found)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, redacted], ["record", "secrets", "starts", "rules", "redacted"])

    return spread(texts.select(record, text)).mapInArrow(run, f"record {kind}, {_FOUND}").withColumnRenamed("record", record)


def shown_in_redaction(findings: DataFrame, *, record: str = "finding_id", directory: str = TOKENIZER_DIR) -> DataFrame:
    """record, secrets, redacted: the credentials of `matched_text` or `redacted_text` that `redacted_text` shows in full.

    `redacted` is `redacted_text` with them masked. Findings without a redacted text, or whose text hides all, give no row.
    """
    kind = findings.schema[record].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, secrets, redacted = [], [], []
            for i, (matched, shown) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                values = [(matched or "")[a:b] for a, b, _ in find_credentials(matched, directory)]
                # What is asterisks and brackets only around an otherwise full value still shows it.
                values += [shown[a:b].strip("*<>") for a, b, _ in find_credentials(shown, directory)]
                values = [v for v in dict.fromkeys(values) if v and v in shown]
                values = [v for v in values if not any(v != w and v in w for w in values)]
                if values:
                    ids.append(i)
                    secrets.append(values)
                    redacted.append(functools.reduce(lambda t, v: t.replace(v, re.sub(r"[^\r\n]", "*", v)), values, shown))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(secrets, pa.list_(pa.string())), pa.array(redacted, pa.string())], ["record", "secrets", "redacted"])

    # A redaction of up to four characters and asterisks shows no credential in full: those rows needn't be scanned.
    shown = findings.where(F.length("redacted_text") >= 4).where(~F.col("redacted_text").rlike(r"(?s)^.{0,4}\*+\.*$"))
    return spread(shown.select(record, "matched_text", "redacted_text")).mapInArrow(run, f"record {kind}, secrets array<string>, redacted string").withColumnRenamed("record", record)

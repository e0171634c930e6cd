"""Personal data of people in free text, replaced by typed placeholders.

High-recall generators propose overlapping spans of five types. Boosted trees score each span from its format and its
context, and a threshold for each type, calibrated on messages that the trees weren't fitted to, selects; of overlapping
spans of which several pass, the likeliest and then the longest stays.

The trees are fitted when the query runs, on a bounded sample of messages. Labels of mail addresses and of telephone and
identity numbers are the recorded findings of category PII alone, in messages that have some: no rule is asked. No
finding records names and addresses; their labels are the votes of labelling rules. A few written sentences are always
among the sample, so that every type has examples of both classes however small the table is.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftbed.llm.boosting import BoostedTrees, best_threshold
from siftbed.session import spread

TYPES = ("email", "phone", "id_number", "address", "name")
#: Rules of recorded findings, without their separators, by the type of what they find.
FINDING_TYPES = {"personemail": "email", "personphone": "phone", "personidnumber": "id_number"}

# Mailboxes that belong to a role, a team or a machine.
ROLES = {
    "abuse", "account", "accounts", "admin", "administrator", "alert", "alerts", "api", "billing", "bot", "build", "careers", "ci", "contact", "cron", "daemon", "deploy", "dev", "devops", "feedback",
    "git", "hello", "help", "helpdesk", "hostmaster", "hr", "info", "infra", "it", "jobs", "legal", "mail", "mailer-daemon", "marketing", "monitor", "monitoring", "news", "newsletter", "no-reply",
    "noc", "noreply", "notifications", "office", "on-call", "oncall", "ops", "payments", "postmaster", "press", "privacy", "root", "sales", "sec", "security", "service", "staff", "support", "svc",
    "sysadmin", "system", "team", "test", "user", "webmaster",
}

# Words before an identity number, in the languages of its kinds.
_ID_CUE = re.compile(
    r"(?i)(?:\bSSN|social[ -]security|national[ -]insurance|\bNINO|\bNI\b|\bDNI|\bNIE|\bNIF|aadhaar|passport|pasaporte|passeport|reisepass|personalausweis|driv(?:ing|er'?s?|ers)[ -]licen[cs]e|\bDL|identity card|national id(?:entity)?)"
    r"(?:\s*(?:number|num|no|nr|n°|#|card|code|id)\b\.?)?\s*(?:is|was|es|ist|est|=|:|#)?\s*[\"'(]?\s*$"
)
_OTHER_CUE = re.compile(r"(?i)\b(?:order|ticket|part|job|build|version|release|row|invoice|issue|commit|case|item|port|line|request|id|trace|tracking|serial|model|batch)(?:\s+(?:no|number|code))?\.?\s*[:#]?\s*$")
_PHONE_CUE = re.compile(r"(?i)(?:\btel|phone|mobile|cell|call|ring|text|unter|rappeler au|fax|alt|fon|contact|reach)\w*(?:\s+(?:me|us|him|her|them))?(?:\s+(?:at|on|au|under))?\s*[.:=]*[\"'(>]*\s*$")
_ADDRESS_CUE = re.compile(r"(?i)(?:address|adresse|anschrift|direcci[oó]n|lives at|on file|ship\b[^\n]*|street|home|mail to|deliver\w* to|ist|,|>|')\s*[:=]?\s*[\"'(>]*\s*$")
_NAME_CUE = re.compile(
    r"(?:\b(?:[Mm]y name is|[Ii]ch bin|[Ii]ch hei(?:ß|ss)e|[Mm]ein Name ist|[Ss]oy|[Mm]e llamo|[Jj]e suis|[Jj]e m'appelle|I am|I'm|[Tt]his is|[Cc]aller|[Pp]atient|[Cc]ustomer|[Uu]ser|[Rr]eported by|[Ss]igned by|[Ww]ritten by|[Aa]pproved by|[Hh]i|[Hh]ello|[Dd]ear|[Tt]hanks|[Hh]allo|[Bb]onjour|[Hh]ola|[Aa]ttn|[Cc]c|[Aa]sk|[Tt]ell|[Cc]ontact)[:,]?\s+"
    r"|(?:^|\n)[ \t]*(?:Author|From|To|Cc|NAME|Name|Attendees|Contact|Reviewer|Reported-by|Signed-off-by|Owner|Kunde|Nombre|Nom)\s*:\s*"
    r"|(?:[Rr]egards|[Cc]heers|[Ss]incerely|Grüße|[Ss]aludos|[Cc]ordialement|[Bb]est),?[ \t]*\r?\n\s*|\bto\s*\r?\n\s*|[Ff]irst_?[Nn]ame\W{1,5}|[Ll]ast_?[Nn]ame\W{1,5}|(?:[Ff]ull_?|[\"'])[Nn]ame\W{1,5}|Error\([\"'])$"
)
_TITLE = re.compile(r"\b(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Sir|Herr|Frau|Sr|Sra|Señora?|Mme|Mlle)\.?\s+$")
_ENCLOSED = re.compile(r"(?:[>\"'(,]|\n\s*)$"), re.compile(r"^(?:[<\"'),]|\s*\r?\n|\s*$|\s*<)")

_LOCAL, _HOST = r"[A-Za-z0-9][A-Za-z0-9._%+-]*", r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_EMAIL = re.compile(
    rf"{_LOCAL}(?:@|\s?[\[({{<]\s?(?:at|AT)\s?[\])}}>]\s?| (?:at|AT) ){_HOST}(?:(?:\.|\s?[\[({{]\s?(?:dot|DOT)\s?[\])}}]\s?| (?:dot|DOT) ){_HOST})+"
)
_MACHINE = re.compile(r"(?i)^(?:[a-z]+-?\d+\.|localhost|[\d.]+$)|\.(?:internal|local|lan)$")
_PHONE = re.compile(
    r"(?<![\w.+/-])(?<!\d[ -])(?:"
    r"(?:\+|00)\d{1,3}(?:[ .-]?\(0\))?(?:[ .-]?\(?\d{1,12}\)?){1,6}"
    r"|(?:1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}"
    r"|(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}"
    r"|0\d{2,5}[ /-]\d{3,8}(?:[ -]\d{2,6}){0,3}"
    r")(?![\w-]|\.\d)"
)
_ID = re.compile(r"(?<![\w.+/-])(?:\d{3}[- ]\d{2}[- ]\d{4}|\d{4}[ -]\d{4}[ -]\d{4}|[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Da-d]|\d{8}-?[A-Za-z]|[XYZ]-?\d{7}-?[A-Z]|[A-Za-z]{1,2}\d{6,14}|\d{9})(?![\w-]|\.\d)")

# The words that end the name of a street.
_WAY = r"(?:Street|St|Road|Rd|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Lane|Ln|Court|Ct|Place|Pl|Way|Parkway|Pkwy|Terrace|Gardens|Mews|Close|Row|Square|Sq|Crescent|Hill|Walk|Grove|Circle|Cir|Highway|Hwy|Trail|Alley)\.?"
_CAP = r"[A-ZÀ-Þ][\w'’-]*"
_CAPS = rf"{_CAP}(?: {_CAP}){{0,3}}"
_GAP = r"(?:,\s*|\s*\r?\n\s*|\s+)"
_UNIT = r"(?:Apt|Apartment|Suite|Ste|Unit|Flat|Floor|Room|#)\.?\s?#?[\w-]+"
_ADDRESS = re.compile(
    rf"(?<![\w-])(?:(?:{_UNIT}{_GAP})?\d{{1,5}}[A-Za-z]?\s{_CAPS}?\s?\b{_WAY}(?:{_GAP}{_UNIT})?|P\.?\s?O\.?\sBox\s\d+)"
    rf"{_GAP}(?:{_CAPS}{_GAP}(?:[A-Z]{{2}}\s)?\d{{5}}(?:-\d{{4}})?|{_CAPS}{_GAP}[A-Z]{{1,2}}\d{{1,2}}[A-Z]?\s\d[A-Z]{{2}})(?![\w-])"
    rf"|(?<![\w-])(?:(?:Am|An der|An den|Im|In der|Auf dem|Zum|Zur|Rue|Calle|Via)\s)?{_CAP}(?: {_CAP})? \d{{1,4}} ?[a-z]?(?:,\s*|\s*\r?\n\s*)\d{{5}}(?=\s[A-ZÀ-Þ])"
)
_PART = r"[A-ZÀ-Þ](?:[a-zß-ÿ]+|[A-ZÀ-Þ]+)(?:['’-][A-ZÀ-Þ](?:[a-zß-ÿ]+|[A-ZÀ-Þ]+))*"
_NAME = re.compile(rf"(?<![\w@./\\-]){_PART}(?:, {_PART}(?=;)|(?: (?:[A-Z]\.|{_PART}))*)(?![\w@/\\]|-\w)|(?<![\w@./\\-])[A-Z]\.(?: [A-Z]\.)* {_PART}(?![\w@/\\]|-\w)")
_WORD = re.compile(rf"{_PART}|[A-Z]\.")

FEATURES = (
    *TYPES, "length", "digits", "words", "upper", "id_cue", "other_cue", "phone_cue", "address_cue", "name_cue", "title", "enclosed", "role", "machine", "given_first", "given_any", "ordinary",
    "mail_match", "initial", "lower_next", "starts_sentence", "separators", "plus", "shape", "spelled", "uri_before", "comma", "word_before", "beside",
    "odd", "service", "local",
)
_PLACE = {name: k for k, name in enumerate(FEATURES)}

# Given names that are also ordinary words.
ORDINARY = {"art", "bill", "dawn", "frank", "grace", "hope", "ivy", "mark", "may", "rose", "will", "grant", "sue", "pat", "jack", "drew", "faith", "joy", "june", "april", "dean", "gene", "miles", "rich", "chip", "penny", "ray", "rob"}


# Words that begin a run of capitalised words without being part of a name.
_NO_NAME = {
    "hi", "hello", "hey", "dear", "thanks", "thank", "hallo", "hola", "bonjour", "mr", "mrs", "ms", "miss", "mx", "dr", "prof", "sir", "herr", "frau", "sr", "sra", "mme", "mlle", "from", "to", "cc", "author", "name",
    "attendees", "the", "a", "an", "i", "we", "you", "he", "she", "it", "they", "this", "that", "these", "those", "our", "their", "his", "her", "my", "your", "if", "when", "while", "project", "employee", "record",
    "kind", "best", "regards", "ask", "contact", "call", "please", "user", "id", "ssn", "dni", "address", "mail", "subject", "notes", "alt", "tel",
}


@dataclass(frozen=True)
class Candidate:
    kind: str
    start: int
    end: int
    vote: int  # what the labelling rules say: 1 or 0
    features: tuple[float, ...]


def _id_shape(text: str) -> int:
    """1 for a form that only an identity number has, 0 for one that any number may have."""
    return int(not text.isdigit())


def candidates(text: str | None, given: frozenset[str]) -> list[Candidate]:
    """All proposed spans of a text, each with its features and the vote of the labelling rules."""
    if not text:
        return []
    found: list[Candidate] = []
    locals_: list[str] = []

    def add(kind: str, start: int, end: int, vote: bool, **more: float) -> None:
        value = text[start:end]
        v = [0.0] * len(FEATURES)
        v[_PLACE[kind]] = 1.0
        v[_PLACE["length"]], v[_PLACE["digits"]] = float(len(value)), float(sum(c.isdigit() for c in value))
        v[_PLACE["words"]], v[_PLACE["upper"]] = float(len(value.split())), float(value.isupper())
        for name, x in more.items():
            v[_PLACE[name]] = float(x)
        found.append(Candidate(kind, start, end, int(vote), tuple(v)))

    if "@" in text or " at" in text or "(at" in text or "[at" in text or " AT " in text:
        for m in _EMAIL.finditer(text):
            value, start = m.group(), m.start()
            parts = re.split(r"@|\s?[\[({<]?\b(?:at|AT)\b[\])}>]?\s?", value, maxsplit=1)
            local, host = parts[0].lower(), re.sub(r"\s?[\[({]?\s?\b(?:dot|DOT)\b\s?[\])}]?\s?", ".", parts[-1]).lower()
            spelled = "@" not in value
            before = text[max(0, start - 100) : start]
            uri = bool(re.search(r"(?:://[^\s/]*|:|/)$", before)) and not before.lower().endswith("mailto:")
            role, machine = local in ROLES or bool(set(re.split(r"[-_.]", local)) & ROLES) and not re.search(r"\+", local) and local.split("-")[0] in ROLES | {"billing", "on", "no"}, bool(_MACHINE.search(host))
            tail = host.rsplit(".", 1)[-1]
            # A sentence has "at" before abbreviations and numbers too.
            odd = not tail.isalpha() or len(tail) < 2 or spelled and (len(local) < 4 or len(tail) < 3)
            service = bool(re.match(r"(?:app|batch|deploy|ro|svc|build|git)[_:]?", local)) and "_" in local and machine
            add("email", start, m.end(), not (role or machine or uri or odd or service), role=role, machine=machine, spelled=spelled, uri_before=uri, plus="+" in local, odd=odd, service=service, local=len(local))
            locals_.append(local)
    digits = any(c.isdigit() for c in text)
    if digits:
        for m in _PHONE.finditer(text):
            value, before = m.group().rstrip(" ()-./"), text[max(0, m.start() - 40) : m.start()]
            n = sum(c.isdigit() for c in value)
            other, cue, ident = bool(_OTHER_CUE.search(before)), bool(_PHONE_CUE.search(before)), bool(_ID_CUE.search(before))
            international = value[0] == "+" or value.startswith("00")
            right = 9 <= n <= 15 and not other and not ident
            add("phone", m.start(), m.start() + len(value), right, other_cue=other, phone_cue=cue, id_cue=ident, plus=international, separators=len(re.findall(r"[ ./()-]+", value)), shape=9 <= n <= 15)
        for m in _ID.finditer(text):
            before = text[max(0, m.start() - 48) : m.start()]
            cue, other = bool(_ID_CUE.search(before)), bool(_OTHER_CUE.search(before))
            add("id_number", m.start(), m.end(), cue, id_cue=cue, other_cue=other and not cue, shape=_id_shape(m.group()), separators=len(re.findall(r"[ -]", m.group())))
        for m in _ADDRESS.finditer(text):
            before = text[max(0, m.start() - 40) : m.start()]
            add("address", m.start(), m.end(), True, address_cue=bool(_ADDRESS_CUE.search(before)), other_cue=bool(_OTHER_CUE.search(before)))
    taken = [(c.start, c.end) for c in found if c.kind in ("email", "address", "phone") and c.vote]
    mails = " ".join(locals_)
    for m in _NAME.finditer(text):
        if not any(a <= m.start() < b for a, b in taken):
            _names(text, m, given, mails, any(0 <= a - m.end() <= 12 or 0 <= m.start() - b <= 6 for a, b in taken), add)
    return found


def _names(text: str, m: re.Match, given: frozenset[str], mails: str, beside: bool, add) -> None:
    """Proposes names within one run of capitalised words: the whole run, and what is left without its first words.

    `beside` says that another item of personal data stands next to the run.
    """
    words = [(w.start() + m.start(), w.end() + m.start(), w.group()) for w in _WORD.finditer(m.group())]
    comma = "," in m.group()
    for k in range(1 if comma else len(words)):
        start, end, parts = words[k][0], m.end(), [w[2] for w in words[k:]]
        if parts[0].lower() in _NO_NAME:
            continue
        before, after = text[max(0, start - 48) : start], text[end : end + 12]
        cue, title = bool(_NAME_CUE.search(before)), bool(_TITLE.search(before))
        plain = [p.lower() for p in parts if len(p) > 2]
        listed = [p.lower() in given for p in parts]
        mail = bool(mails) and any(len(p) > 2 and p.split("-")[0] in mails for p in plain)
        initial = parts[0].endswith(".")
        enclosed = bool(_ENCLOSED[0].search(before)) and bool(_ENCLOSED[1].match(after))
        cell = enclosed and beside and len(parts) > 1 and not any(p in _NO_NAME for p in plain)
        if not (cue or title or any(listed) or mail or initial or cell):
            continue
        lower_next = bool(re.match(r" [a-zà-ÿ]", after))
        first = not before or bool(re.search(r"(?:^|[.!?:\n\r])\s*$", before))
        ordinary = any(p in ORDINARY for p in plain)
        word_before = bool(re.search(r"[A-Za-zÀ-ÿ]\s$", before)) and not cue and not title
        people = 1 < len(parts) <= 4
        vote = (
            title
            or comma and any(listed + [cue])
            or cue and (people or listed[0] and not (lower_next and len(parts) == 1) or mail or bool(re.search(r"(?i)(?:hi|hello|dear|thanks|hallo|_?name\W*)\s*$", before)))
            or initial and people and len(parts[-1]) > 3
            or listed[0] and people and not ordinary
            or listed[0] and people and (mail or enclosed)
            or mail and (enclosed or people)
            or cell and people
            or len(parts) == 1 and listed[0] and not ordinary and not lower_next
        )
        add(
            "name", start, end, vote and plain != [], name_cue=cue, title=title, given_first=listed[0], given_any=any(listed), ordinary=ordinary, mail_match=mail, initial=initial, enclosed=enclosed,
            lower_next=lower_next, starts_sentence=first, comma=comma, word_before=word_before, beside=beside,
        )


# Written sentences with both classes of every type; they only make sure that a small table has examples of each.
SEED = [
    "my name is Alice Hartwell and I need help. reach me on alice.hartwell@home.example or text +1 555 201 4477",
    "order 1234 5678 9012 shipped from row 3, ticket 123-45-6789 is about part no. 321-54-9876, build 2024.100.2000",
    "Her SSN is 612-44-9081, passport no. K12345678, DNI 12345678Z; she lives at 12 Alder Street, Apt 3, Northfield, OH 44067 and calls.",
    "ping oncall@mq-1.cluster.example or no-reply@mail-2.host.example, git clone https://build:abc@repo-3.host.example/x.git",
    "Hope that helps. errors rose again in May. Grace period ends. Art assets are missing. Frank words were needed",
    "Hi Peter,\n\nthanks. Kind regards,\nLaura M. Whitcombe\n020 7946 0123\n",
    "Attendees: Hartwell, Nora; tel. (555) 201-4477. Escalated to Dr. Whitcombe, who lives at Lindenweg 4, 12345 Altdorf.",
]


@dataclass
class Model:
    """The fitted trees and the threshold of each type."""

    trees: BoostedTrees
    thresholds: dict[str, float]


def fit(rows: list[tuple[tuple[float, ...], int, bool]]) -> Model:
    """Fits the trees to (features, label, held) rows that aren't held, and calibrates a threshold for each type on those that are."""
    x, y = np.array([r[0] for r in rows], dtype=float).reshape(len(rows), len(FEATURES)), np.array([r[1] for r in rows], dtype=float)
    held = np.array([r[2] for r in rows], dtype=bool)
    trees = BoostedTrees(rounds=60).fit(x[~held], y[~held])
    p, limits = trees.predict(x), {}
    for k, kind in enumerate(TYPES):
        own = (x[:, k] == 1) & held
        limits[kind] = min(0.8, max(0.2, best_threshold(p[own], y[own])))
    return Model(trees, limits)


def select(text: str | None, proposed: list[Candidate], p: np.ndarray, model: Model) -> list[tuple[int, int, str]]:
    """(start, end, type) of the chosen spans in order: over the threshold and without overlaps, the likeliest and then longest first."""
    passed = [(c, x) for c, x in zip(proposed, p) if x >= model.thresholds[c.kind]]
    passed.sort(key=lambda cx: (-round(cx[1], 1), cx[0].start - cx[0].end, cx[0].start, cx[0].kind))
    kept: list[Candidate] = []
    for c, _ in passed:
        if all(c.end <= k.start or c.start >= k.end for k in kept):
            kept.append(c)
    return sorted((c.start, c.end, c.kind) for c in kept)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """`text` with a typed placeholder in the place of each span."""
    parts, at = [], 0
    for start, end, kind in spans:
        parts += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*parts, text[at:]])


def _letters(text: str | None) -> str:
    return re.sub(r"[\W_]+", "", text or "").lower()


#: Messages of which one in so many is held back from the trees to calibrate the thresholds.
HELD = 5


def training_rows(messages: DataFrame, findings: DataFrame | None, names: DataFrame, sample_rows: int, *, record: str, text: str) -> list[tuple[tuple[float, ...], int, bool]]:
    """(features, label, held) of the candidates of at most `sample_rows` messages, those with the least hashes of their ids.

    Half of them are messages with recorded findings. Without any findings table the rules label all types.
    """
    order = F.xxhash64(F.lit(7), record)
    chosen = messages.where(F.length(text) > 0).select(record).distinct().orderBy(order, record).limit(sample_rows // 2).withColumn("known", F.lit(None).cast("array<string>"))
    if findings is not None:
        kind = F.regexp_replace(F.lower("pattern_id"), "[^a-z]", "")
        types = F.create_map(*(F.lit(x) for pair in FINDING_TYPES.items() for x in pair))
        personal = F.coalesce(F.regexp_replace(F.lower("category"), "[^a-z]", ""), F.lit("pii")) == "pii"
        sure = findings.where(personal & kind.isin(*FINDING_TYPES) & F.col(record).isNotNull()).select(record, F.concat(types[kind], F.col("matched_text")).alias("one"))
        few = sure.select(record).distinct().orderBy(order, record).limit(sample_rows // 2)
        recorded = sure.join(F.broadcast(few), record).groupBy(record).agg(F.collect_set("one").alias("known"))
        chosen = chosen.join(F.broadcast(few), record, "left_anti").unionByName(recorded)
    sample = messages.where(F.length(text) > 0).select(record, text).join(F.broadcast(chosen), record).dropDuplicates([record])
    sample = sample.withColumn("held", F.pmod(F.xxhash64(record), F.lit(HELD)) == 0)
    listed = _listed(sample, names, record=record, text=text)
    rules = findings is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, known, held, given in zip(*(c.to_pylist() for c in batch.columns)):
                sure = None if known is None else {_letters(k) for k in known}
                for c in candidates(value, frozenset(given or ())):
                    by_rule = rules or c.kind in ("name", "address")
                    if by_rule or sure is not None:
                        rows.append((list(c.features), c.vote if by_rule else int(_letters(c.kind + value[c.start : c.end]) in sure), held))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.float64())), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.bool_())], ["features", "label", "held"])

    rows = listed.select(text, "known", "held", "listed").mapInArrow(run, "features array<double>, label int, held boolean").collect()
    rows = sorted((tuple(r[0]), r[1], r[2]) for r in rows)
    given = frozenset({"alice", "peter", "laura", "nora", "hope", "may", "grace", "art", "frank"})
    return rows + [(c.features, c.vote, False) for s in SEED for c in candidates(s, given) for _ in range(5)]


def _listed(texts: DataFrame, names: DataFrame, *, record: str, text: str) -> DataFrame:
    """`texts` with `listed`: those of a text's capitalised words that are listed given names, by a join on the words.

    This way takes any number of names; words are made distinct in each text before they are shuffled.
    """
    word = F.lower(F.regexp_replace(F.col("word"), "['’].*$", ""))
    words = texts.select(record, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\p{Lu}][\p{L}'’-]*"), F.lit(0)))).alias("word"))
    words = words.select(record, F.explode(F.array(F.lower("word"), word)).alias("word")).distinct()
    found = words.join(names.select(F.lower("given_name").alias("word")).distinct(), "word", "left_semi").groupBy(record).agg(F.collect_set("word").alias("listed"))
    return texts.join(found, record, "left")


_FOUND = "items array<struct<start:int,type:string,value:string>>, masked string"


def scan_texts(
    messages: DataFrame, given_names: DataFrame, findings: DataFrame | None = None, *, record: str = "message_id", text: str = "text", sample_rows: int = 6_000, most_names: int = 200_000
) -> DataFrame:
    """record, items, masked: of every text the personal data in it and the text with typed placeholders.

    `given_names` is a list of given names (column given_name): up to `most_names` every executor holds them, more are
    joined to the words of the texts. `findings` (record, pattern_id, category, matched_text) gives the labels of the
    training sample of at most `sample_rows` messages. A null text has null in `masked` and no items. Rows keep their
    number; other columns are left out.
    """
    names = given_names.select("given_name").where("given_name IS NOT NULL").distinct()
    held = [r[0].lower() for r in names.limit(most_names + 1).collect()]
    model = fit(training_rows(messages, findings, names, sample_rows, record=record, text=text))
    kind = messages.schema[record].dataType.simpleString()
    every = frozenset(held) if len(held) <= most_names else None
    fitted = messages.sparkSession.sparkContext.broadcast((model, every))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("start", pa.int32()), ("type", pa.string()), ("value", pa.string())])
        model, every = fitted.value
        for batch in batches:
            values = batch.column(1).to_pylist()
            given = [every] * len(values) if every is not None else [frozenset(g or ()) for g in batch.column(2).to_pylist()]
            proposed = [candidates(v, g) for v, g in zip(values, given)]
            x = np.array([c.features for cs in proposed for c in cs], dtype=float).reshape(-1, len(FEATURES))
            p, at, spans = model.trees.predict(x), 0, []
            for v, cs in zip(values, proposed):
                spans.append(select(v, cs, p[at : at + len(cs)], model))
                at += len(cs)
            items = [[{"start": a, "type": k, "value": v[a:b]} for a, b, k in s] for v, s in zip(values, spans)]
            out = [masked(v, s) if s else v for v, s in zip(values, spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.list_(item)), pa.array(out, pa.string())], ["record", "items", "masked"])

    rows = spread(messages.select(record, text))
    if every is None:
        rows = _listed(rows, names, record=record, text=text).select(record, text, "listed")
    return rows.mapInArrow(run, f"record {kind}, {_FOUND}").withColumnRenamed("record", record)

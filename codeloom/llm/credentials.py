"""Credentials in source and configuration files: find and redact.

Token formats, key armor, connection strings, assignments, command-line and header forms are rules of one
deterministic automaton (``automaton.py``). Texts are scanned in overlapping chunks; spans are absolute, and spans found
twice are kept once. What the automaton reports is then judged: boundaries, names, and whether the value is a
placeholder or a reference.

Defined cases
    * null and empty texts give no rows and are redacted to themselves.
    * Lines end at ``\\n``; a carriage return belongs to its line. Positions are code points.
    * Every good literal of an assigned call, tuple or list on its line counts; names are judged by their last 60 characters.
    * A private key counts once, on its BEGIN line, and reaches to its END whatever its length; an armor line without key material is a mention.
    * Overlapping findings merge into one span per start; the longest wins.
    * Redaction keeps the number of lines, quotes and the class of hexadecimal values, so the code stays intact.
    * Repeated rows and ids are judged each; results are distinct. Empty tables give empty results.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.automaton import Automaton

CHUNK = 1 << 16
OVERLAP = 1 << 13

# Public token formats (fixed values).
FORMATS = [
    r"AKIA[0-9A-Z]{16}", r"ASIA[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{30,}", r"github_pat_[A-Za-z0-9_]{22,}", r"gsk_[A-Za-z0-9]{20,}",
    r"sk_live_[A-Za-z0-9]{16,}", r"rk_live_[A-Za-z0-9]{16,}", r"pk_live_[A-Za-z0-9]{16,}", r"sk-[A-Za-z0-9_\-]{20,}", r"AIza[A-Za-z0-9_\-]{30,}", r"xox[abeoprs]-[A-Za-z0-9\-]{10,}",
    r"glpat-[A-Za-z0-9_\-]{20,}", r"npm_[A-Za-z0-9]{30,}", r"hf_[A-Za-z0-9]{30,}", r"pypi-[A-Za-z0-9_\-]{30,}", r"nvapi-[A-Za-z0-9_\-]{30,}", r"qk-(prod|live)-[A-Za-z0-9]{16,}",
    r"SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}", r"eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}",
]
FORMAT_TRIGGERS = ["akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "gsk_", "sk_live_", "rk_live_", "pk_live_", "sk-", "aiza",
                   "xoxa-", "xoxb-", "xoxe-", "xoxo-", "xoxp-", "xoxr-", "xoxs-", "glpat-", "npm_", "hf_", "pypi-", "nvapi-", "qk-", "sg.", "eyj"]
NAMES = ["password", "passwd", "passphrase", "passcode", "pwd", "pass", "pw", "secret", "token", "key", "auth", "credential",
         "passwort", "kennwort", "wachtwoord", "contrasena", "contrase\u00f1a", "motdepasse", "mot_de_passe", "senha", "parola"]
PASSWORDS = ("password", "passwd", "passphrase", "passcode", "passwort", "kennwort", "wachtwoord", "contrasena", "contrase\u00f1a", "motdepasse", "depasse", "senha", "parola")
_TAIL = r"[A-Za-z0-9_]*[\"'`\]]?[ \t]*(:[ \t]*&?('static )?[A-Za-z]+[ \t]*)?(=>|:=|\?=|[=:]|[ \t]to[ \t]|[ \t]is[ \t])[ \t]*"
RULES = (
    [("format", p) for p in FORMATS]
    + [
        ("armor", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY( BLOCK)?-----"),
        ("url", r"://[A-Za-z0-9_.\-%]*:[^@\s/\"'`]+@[A-Za-z0-9\[$<{]"),
        ("name", "(" + "|".join(f"[{x[0].upper()}{x[0]}]{x[1:]}|{x.upper()}" for x in NAMES) + ")" + _TAIL),
        ("bearer", r"[Bb]earer[ ]+[A-Za-z0-9+/_.=\-]{16,}"),
        ("basic", r"[Bb]asic[ ]+[A-Za-z0-9+/]{12,}=*"),
        ("curl", r"curl [^\n]*-u[ ]+[A-Za-z0-9_.\-]+:[^\s:@\"']+"),
        ("curl", r"(--user|--proxy-user)[ =]+[A-Za-z0-9_.\-]+:[^\s:@\"']+"),
        ("login", r"login was [^\s]+ / [^\s]+"),
    ]
)
TRIGGERS = [*FORMAT_TRIGGERS, "-----begin ", "://", *NAMES, "bearer ", "basic ", "curl ", "--user", "--proxy-user", "login was "]

_PLACEHOLDER = re.compile(
    r"(?i)^(?:none|null|nil|true|false|undefined|change[-_ ]?me|replace[-_ ]?me.*|todo.*|fixme|tbd|dummy.*|example.*|sample|your[-_ ].*|.*your[-_].*|my[-_]?(?:secret|password|token|key)|insert.*|enter.*"
    r"|(?:secret|password|passwd|pass|pwd|token|key|test|string|str|redacted|hidden|masked|removed|empty|unset|default|placeholder|value|env|prompt|xxx+|user|admin|root|abc123|123456\d*)"
    r"|[*xX.#_\-•?0]{3,}|<.*>|\[.*\]|\(.*\)|\$\{?.*|\{\{?.*\}?\}|%.*%|%[sdv(].*|@.*@|#\{.*|&[a-z]+;|.*(?:placeholder|redacted|changeme|replace_me|your_|<[a-z_ -]+>|\.\.\.).*)$"
)
_REFERENCE = re.compile(r"(?i)(?:^|[^a-z])(?:vault|secretsmanager|keyring|ssm|env|environ|getenv|process\.env|secrets?)[.:/(\[]|^(?:arn|vault|env|file|ref|kms|secret|ssm|op)[:/]|^(?:prod|stage|staging|dev|test)/")
_KEYISH = {"api", "access", "secret", "private", "provider", "service", "deploy", "auth", "signing", "encryption", "account", "master", "license", "admin", "client", "app", "ssh", "storage", "session", "webhook", "subscription", "apikey", "server", "ssl", "jwt", "hmac", "db"}
_WORDS = re.compile(r"[A-Z\u00d1]+(?![a-z\u00f1])|[A-Z]?[a-z\u00f1]+|\d+")
_QUOTED = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`")
_HEX = re.compile(r"[0-9a-fA-F]{16,}\Z")
_NESTING = re.compile(_QUOTED.pattern + r"|[\[\](){},;]")
# Key armor: its next mark, breaks between its lines (also escaped ones, and strings joined in code), header lines, and what stands round a line.
_ARMOR_MARK = re.compile(r"-----(BEGIN|END) [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_JOINT = r"[\"'`][ \t]*[+.,]?[ \t]*\\?(?:\r?\n[ \t]*[+.]?[ \t]*)?[rbfuRBFU]{0,2}[\"'`]"
_ARMOR_BREAK = re.compile(_JOINT + r"|\\[nr]|\r?\n")
_ARMOR_TEXT = re.compile(r"[\sA-Za-z0-9+/=:,\-]*")
_ARMOR_HEADER = re.compile(r"[A-Z][A-Za-z]*(?:-[A-Z][A-Za-z]*)*:[ \t][^\n]*")
_ARMOR_OPEN = re.compile(r"(?:(?:[ \t\r\n#*/|>]|\\[nr]|" + _JOINT + r")*[A-Z][A-Za-z]*(?:-[A-Z][A-Za-z]*)*:[ \t](?:(?!\\[nr])[^\n\"'`])*)*(?:[\sA-Za-z0-9+/=]|\\[nr]|[#*/|> ]|" + _JOINT + r")*")
_DECORATION = " \t\r\"'`+,.;#*|>()\\"
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>|]+")


_FORMATS, _NAMES = frozenset(FORMAT_TRIGGERS), frozenset(NAMES)
_LONG, _IDENTIFIER = re.compile(r"[A-Za-z0-9_]{4096}"), re.compile(r"[A-Za-z0-9_]*")
_NAME = re.compile("|".join(f"[{x[0].upper()}{x[0]}]{x[1:]}|{x.upper()}" for x in NAMES))


@functools.lru_cache(maxsize=1)
def machines():
    import ahocorasick

    ac = ahocorasick.Automaton()
    for t in TRIGGERS:
        ac.add_word(t, len(t))
    ac.make_automaton()
    return ac, Automaton(RULES)


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def placeholder(v: str) -> bool:
    return not v or bool(_PLACEHOLDER.match(v)) or bool(_REFERENCE.search(v)) or len(set(v)) < 3


def strong(v: str) -> bool:
    """Looks like generated key material."""
    if len(v) < 16 or " " in v or not re.fullmatch(r"[A-Za-z0-9+/_.=~%!@#$^&*:\-]+", v):
        return False
    if v.count("-") == 4 and re.fullmatch(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", v):
        return False
    return bool(re.search(r"\d", v)) and bool(re.search(r"[A-Za-z]", v)) and (_entropy(v) > 3.3 or (_HEX.match(v) is not None and _entropy(v) > 2.8)) and not re.fullmatch(r"[a-z]+(?:[-_./][a-z]+)*[-_./]?\d{0,4}", v)


def weak(v: str) -> bool:
    """A plausible human password: no blanks, and digits, capitals or signs mixed in."""
    if not 6 <= len(v) <= 80 or re.search(r"\s", v) or v.startswith(("/", "./", "http:", "https:", "--")):
        return False
    kinds = sum(bool(re.search(p, v)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z0-9]"))
    return kinds >= 3 or (kinds == 2 and bool(re.search(r"\d", v)) and bool(re.search(r"[A-Za-z]", v))) or (kinds >= 2 and bool(re.search(r"[!&%$^*~+?]", v)))


def _name_kind(words: list[str]) -> str | None:
    words = [w for w in words if not w.isdigit()]
    if not words:
        return None
    last, before = words[-1], words[-2] if len(words) > 1 else ""
    if last in ("pwd", "pass", "pw") or last.endswith(PASSWORDS) or last == "passe" and before == "de":
        return "password"
    if last in ("secret", "secrets", "credential", "credentials") or (last in ("bytes", "value", "hex") and before in ("secret", "key", "password", "token")):
        return "secret"
    if last == "auth":
        return "secret"
    if last == "token" or last == "apikey" or (last == "key" and before in _KEYISH):
        return "token"
    if last == "key" and len(words) == 1:
        return "key"
    return None


def _good(kind: str, v: str) -> bool:
    if placeholder(v):
        return False
    if kind in ("password", "secret"):
        return strong(v) or weak(v)
    return strong(v)


def _extent(text: str, at: int, line_end: int) -> int:
    """Where the bracketed or joined expression at ``at`` ends: before a bracket it did not open, or a comma or semicolon outside its brackets."""
    depth = 0
    for m in _NESTING.finditer(text, at, line_end):
        c = m.group(0)
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                return m.start()
        elif c in ",;" and depth == 0:
            return m.start()
    return line_end


def _values(text: str, at: int, end: int, kind: str) -> list[tuple[int, int]]:
    """(start, end) of every literal credential value that an assignment gives at ``at``."""
    line_end = text.find("\n", at, end)
    line_end = end if line_end < 0 else line_end
    first = text[at : at + 1]
    prefix = re.compile(r"(?:[rbfuRBFU]{1,2}(?=[\"']))?").match(text, at).end()
    m = _QUOTED.match(text, prefix, line_end)
    if m:
        g = m.lastindex
        v = m.group(g)
        if v == "" and text[prefix : prefix + 3] in ('"""', "'''"):
            return []
        if m.group(0)[0] in "\"`'" and ("#{" in v or "${" in v):
            return []
        return [m.span(g)] if _good(kind, v) else []
    call = re.compile(r"[A-Za-z_][\w.:]*(?:\[[\"'][^\"']*[\"']\])?(?:[(]|[ \t]*(?:\|\||\?\?)[ \t]*|[ \t]+or[ \t]+|\.)").match(text, at, line_end)
    if call or first in "({[|" and first:
        named = call and re.search(r"(?i)env|get|fetch|config|lookup|read|setting|option|argv|arg", call.group(0)) and "(" in call.group(0)
        decoded = call and re.search(r"(?i)env|get|fetch|fromhex|from_hex|b64|decode|bytes|str", call.group(0))

        def good(m: re.Match) -> bool:
            v = m.group(m.lastindex)
            return _good(kind, v) and bool(strong(v) or kind in ("password", "secret") and weak(v) and not call or decoded)

        return [m.span(m.lastindex) for m in itertools.islice(_QUOTED.finditer(text, at, _extent(text, at, line_end)), int(bool(named)), None) if good(m)]
    if first in ("", "\"", "'", "`", "\n"):
        return []
    m = _BARE.match(text, at, line_end)
    if not m:
        return []
    v = m.group(0).rstrip(".,")
    rest = text[m.end() : line_end].rstrip("\r")
    if rest.startswith(("(", "[")) or re.match(r"[ \t]*[;]?[ \t]*$|[ \t]*[#,\"'`\\]|[ \t]", rest) is None:
        return []
    if re.fullmatch(r"[A-Za-z_$][\w$]*(?:[.:]+[A-Za-z_$][\w$]*)+(?:\(\))?", v) and not strong(v):
        return []
    return [(at, at + len(v))] if _good(kind, v) else []


def _key_line(line: str) -> bool:
    return _ARMOR_TEXT.fullmatch(line.strip(_DECORATION)) is not None or _ARMOR_HEADER.fullmatch(line.strip(_DECORATION)) is not None


def _armor(text: str, at: int, head_end: int):
    """Span of a private key from its BEGIN to its END, whatever its length (or to where the key material stops)."""
    mark = _ARMOR_MARK.search(text, head_end)
    if mark and mark.group(1) == "END" and all(map(_key_line, _ARMOR_BREAK.split(text[head_end : mark.start()]))):
        end, stop = mark.end(), mark.start()
    else:
        end = stop = _ARMOR_OPEN.match(text, head_end).end()
    lines = [x for x in _ARMOR_BREAK.split(text[head_end:stop]) if not _ARMOR_HEADER.fullmatch(x.strip(_DECORATION))]
    material = re.sub(r"[^A-Za-z0-9+/]", "", "".join(lines))
    return (at, end) if len(material) >= 32 and len(set(material)) > 8 else None


def _assigned(text: str, at: int, end: int, stop: int) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the credentials that the name and operator reported from ``at`` to ``end`` are given."""
    if text[max(0, at - 2) : at] == "//":  # the user name of an address
        return []
    left = re.search(r"[A-Za-z0-9_.\-]*\Z", text[max(0, at - 60) : at]).group(0)
    head = re.match(r"[A-Za-z0-9_\u00f1\u00d1]*", text[at:end]).group(0)
    name = (left + head).lstrip("-.")
    kind = _name_kind([w.lower() for w in _WORDS.findall(name)])
    if kind is None or kind in ("token", "key") and text[end : end + 1] == "{":
        return []
    return [(*span, "password" if kind == "password" else "secret") for span in _values(text, end, stop, kind)]


def _judge(text: str, label: str, at: int, end: int):
    """(start, end, kind) of the credential that a report of the automaton stands for, or None."""
    before = text[at - 1] if at else " "
    if label == "format":
        v = text[at:end]
        if (before.isalnum() or before in "_+/") or (text[end : end + 1] or " ") in "+/" and v.startswith(("AKIA", "AIza")):
            return None
        if before == "-" and not text[max(0, at - 2) : at - 1].isspace():
            return None
        if re.search(r"(?i)example|x{6,}|0{8,}|1234567890|your|placeholder", v) or len(set(v)) < 8 or text[max(0, at - 60) : at].rpartition("\n")[2].rstrip().endswith("base64,"):
            return None
        if v.startswith("sk-") and not strong(v):
            return None
        return at, end, "api_key"
    if label == "armor":
        span = _armor(text, at, end)
        return (*span, "private_key") if span else None
    if label == "url":
        scheme = re.search(r"[A-Za-z][A-Za-z0-9+.\-]*\Z", text[max(0, at - 24) : at])
        colon = text.index(":", at + 3)
        v = text[colon + 1 : end - 2]
        if not scheme or placeholder(v) or v.startswith(("$", "<", "{", "%", "*", "#{")) or not v:
            return None
        if re.fullmatch(r"(?i)pass(?:word)?|secret|pw|pwd|user|x+", v):
            return None
        return colon + 1, end - 2, "connection_password"
    if label in ("bearer", "basic"):
        start = at + re.match(r"\w+ +", text[at:end]).end()
        v = text[start:end]
        return (start, end, "bearer" if label == "bearer" else "basic_auth") if not placeholder(v) and (strong(v) or label == "basic" and len(v) >= 16 and re.search(r"[A-Z].*\d|\d.*[A-Z]|=$", v)) else None
    if label == "curl":
        start = text.rindex(":", at, end) + 1
        v = text[start:end]
        return (start, end, "password") if not placeholder(v) and len(v) >= 4 else None
    if label == "login":
        start = text.rindex("/ ", at, end) + 2
        v = text[start:end]
        return (start, end, "password") if not placeholder(v) and weak(v) else None
    return None


def _moot(text: str, at: int, trigger: str) -> bool:
    """Whether a run from this trigger is known to give nothing new, which keeps long texts without blanks linear.

    A format is refused inside a word; of the names in a long identifier the last leads to the same value as the others.
    """
    if trigger in _FORMATS:
        before = text[at - 1] if at else " "
        return before.isalnum() or before in "_+/" or before == "-" and not text[max(0, at - 2) : at - 1].isspace()
    if trigger in _NAMES and _LONG.match(text, at):
        return _NAME.search(text, at + 1, _IDENTIFIER.match(text, at).end() if not _NAME.search(text, at + 1, at + 4096) else at + 4096) is not None
    return False


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """Sorted, disjoint (start, end, kind) of the credential values in a text."""
    ac, dfa = machines()
    best: dict[int, tuple[int, int, str]] = {}
    base, n = 0, len(text)
    while True:
        stop = min(n, base + CHUNK)
        chunk = text[base:stop].lower()
        if len(chunk) != stop - base:  # a character that lower-casing lengthens
            chunk = "".join(c if len(c) == 1 else " " for c in map(str.lower, text[base:stop]))
        for last, size in ac.iter(chunk):
            at = base + last + 1 - size
            if _moot(text, at, chunk[last + 1 - size : last + 1]):
                continue
            limit = n
            if size == 5 and text.startswith("curl ", at):  # what follows the next command is that command's
                limit = text.find("curl ", at + size)
                limit = n if limit < 0 else limit
            for label, end in dfa.run(text, at, limit):
                for got in _assigned(text, at, end, n) if label == "name" else [_judge(text, label, at, end)]:
                    if got and (got[0] not in best or best[got[0]][1] < got[1]):
                        best[got[0]] = got
        if stop >= n:
            break
        base = stop - OVERLAP
    out, reach = [], -1
    for s, e, k in sorted(best.values(), key=lambda x: (x[0], -x[1])):
        if s >= reach:
            out.append((s, e, k))
            reach = e
    return out


def _hide(m: re.Match) -> str:
    """REDACTED for a run of key material; escapes, string prefixes and the signs that join strings stay."""
    v, after = m.group(0), m.string[m.end() : m.end() + 1]
    return v if v[0] == "\\" or not any(map(str.isalnum, v)) or len(v) < 3 and after and after in "\"'" and v.lower().strip("rbfu") == "" else "REDACTED"


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for s, e, kind in spans:
        v = text[s:e]
        if kind == "private_key":
            head = re.match(r"-----[^\n-]+-----", v).end()
            tail = v.rfind("-----END")
            tail = len(v) if tail < 0 else tail
            new = v[:head] + re.sub(r"\\[nr]|\b[rbfuRBFU]{1,2}(?=[\"'])|[A-Za-z0-9+/=:,\-]+", _hide, v[head:tail]) + v[tail:]
        elif _HEX.match(v):
            new = "0" * len(v)
        else:
            new = "REDACTED_" + kind.upper()
        parts += [text[at:s], new]
        at = e
    parts.append(text[at:])
    return "".join(parts)


def find_credentials(df: DataFrame, id_col: str = "module_id", text_col: str = "content") -> DataFrame:
    """(id, line_no, start_char, end_char, kind), one row per credential value."""
    kind = dict(df.dtypes)[id_col]
    src = df.where(F.length(text_col) > 0).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"))

    def run(batches):
        for b in batches:
            rows = []
            for i, t in zip(b["id"], b["t"]):
                line, seen = 1, 0
                for s, e, k in find_spans(t):
                    line += t.count("\n", seen, s)
                    seen = s
                    rows.append((i, line, s, e, k))
            yield pd.DataFrame(rows, columns=["id", "line_no", "start_char", "end_char", "kind"])

    return src.mapInPandas(run, "id string, line_no long, start_char long, end_char long, kind string").withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def redact_credentials(df: DataFrame, id_col: str = "module_id", text_col: str = "content") -> DataFrame:
    """(id, n_found, text) with every credential replaced; texts without any come out unchanged."""
    kind = dict(df.dtypes)[id_col]
    src = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"))

    def run(batches):
        for b in batches:
            found = [find_spans(t) if t else [] for t in b["t"]]
            yield pd.DataFrame({"id": b["id"], "n_found": [len(f) for f in found], "t": [redact(t, f) if f else t for t, f in zip(b["t"], found)]})

    return src.mapInPandas(run, "id string, n_found int, t string").withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col).withColumnRenamed("t", text_col)

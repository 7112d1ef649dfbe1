"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a text: at-signs, schemes (://), plus signs, digits and identifier cues
(IBAN, account, token ...). At each anchor a deterministic parser expands to both sides and validates what it has found:
e-mail (local part to the left, dotted domain to the right), address (four dotted parts of at most 255; URLs with
a host), account (card numbers with Luhn's check, IBANs with mod 97, account numbers and secrets after their cue) and phone
numbers. A secret is an assigned value of 16 characters or more with letters and digits. Each parser reads a character once, so long texts take linear time.

The base kinds email, ip, card and phone are the leftmost non-overlapping matches of fixed patterns: a chain of
digits is parsed from its first digit, and a match that fails validation is dropped without another try.
Kinds added by the method are url, iban, account and secret.

Defined cases: null and empty texts have no spans (base_sha256 is the hash of the empty string); null or repeated
doc_ids and repeated rows come back as they are; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import configure, lean

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account", "secret")

# The characters and forms of the base kinds.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
URL_REST = re.compile(r"[^\s<>\"'`{}|\\^]+")
URL_HOST = re.compile(r"(?:[^\s/?#@]*@)?(?:[A-Za-z0-9-]+\.)+[A-Za-z0-9-]+(?::[0-9]+)?(?:[/?#]|$)")
IBAN = re.compile(r"[\x20:#.]{0,3}([A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30})")
ACCOUNT = re.compile(r"(?:[\x20]?(?:no|nr|num|number))?[.:#\x20]{0,4}([0-9][0-9-]{4,18}[0-9])(?![0-9])", re.I)
CUES = ("IBAN", "iban", "Iban", "account", "Account", "ACCOUNT", "acct", "Acct", "ACCT", "konto", "Konto", "cuenta", "Cuenta", "compte", "Compte")


SECRET = re.compile(r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_+/=.-]{16,})")
SECRET_CUES = ("token", "Token", "TOKEN", "secret", "Secret", "SECRET", "api_key", "API_KEY", "apikey", "password", "Password", "PASSWORD", "passwd")


def anchors():
    import ahocorasick

    a = ahocorasick.Automaton()
    for x in ("@", "://", "+", *"0123456789", *CUES, *SECRET_CUES):
        a.add_word(x, x)
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _iban(text: str, at: int):
    """The longest valid IBAN at a cue's end."""
    if m := IBAN.match(text, at):
        for end in range(m.end(1), m.start(1) + 14, -1):
            plain = text[m.start(1) : end].replace(" ", "")
            if text[end - 1] != " " and 15 <= len(plain) <= 34 and mod97(plain):
                return m.start(1), end
    return None


def find(text: str, automaton) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind, ascending; code points, end exclusive."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys((*KINDS, "dotted", "chain"), 0)
    for last, word in automaton.iter(text):
        at = last - len(word) + 1
        if "0" <= word <= "9":
            if at >= done["dotted"]:
                m = DOTTED.match(text, at)
                done["dotted"] = m.end()
                parts = [(x.start(), x.end()) for x in re.finditer("[0-9]+", m[0])] if "." in m[0] else []
                for i in range(0, len(parts) - 3, 4):
                    if all(y - x < 4 and int(m[0][x:y]) <= 255 or int(m[0][x:y][-3:]) <= 255 and not m[0][x : y - 3].strip("0") for x, y in parts[i : i + 4]):
                        out["ip"].append((at + parts[i][0], at + parts[i + 3][1]))
            if at >= done["chain"]:
                m = CHAIN.match(text, at)
                done["chain"] = m.end() if m else at + 1
                if m and 13 <= m.end() - at and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                    out["card"].append(m.span())
        elif word == "@":
            start = at
            while start > done["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                out["email"].append((start, m.end()))
                done["email"] = m.end()
        elif word == "+":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= len(_digits(m[0])) <= 15:
                    out["phone"].append(m.span())
        elif word == "://":
            start = at
            while start > done["url"] and text[start - 1] in SCHEME:
                start -= 1
            while start < at and not text[start].isalpha():
                start += 1
            if start < at and (m := URL_REST.match(text, at + 3)) and URL_HOST.match(m[0].rstrip(".,;:!?)]")):
                out["url"].append((start, at + 3 + len(m[0].rstrip(".,;:!?)]"))))
                done["url"] = out["url"][-1][1]
        elif word in ("IBAN", "iban", "Iban"):
            if at >= done["iban"] and (got := _iban(text, last + 1)):
                out["iban"].append(got)
                done["iban"] = got[1]
        elif word in SECRET_CUES:
            if at >= done["secret"] and (m := SECRET.match(text, last + 1)) and re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1]):
                out["secret"].append(m.span(1))
                done["secret"] = m.end(1)
        elif at >= done["account"] and (m := ACCOUNT.match(text, last + 1)):
            out["account"].append(m.span(1))
            done["account"] = m.end(1)
    return out


def joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each document, and n_private: its spans but for URLs."""
    configure(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        automaton = anchors()
        for batch in batches:
            counts, hashes, spans, private = {k: [] for k in BASE}, [], [], []
            for text in batch.column("text").to_pylist():
                got = find(text or "", automaton)
                for k in BASE:
                    counts[k].append(len(got[k]))
                hashes.append(hashlib.sha256(joined(got, BASE).encode()).hexdigest())
                spans.append(joined(got, KINDS))
                private.append(sum(len(v) for k, v in got.items() if k != "url"))
            columns = [batch.column("doc_id"), *[pa.array(counts[k], pa.int64()) for k in BASE], pa.array(hashes, pa.string()), pa.array(spans, pa.string()), pa.array(private, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans", "n_private"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(lean(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_private long")


def redact(text: str, automaton, mark: str = "[{}]") -> str:
    """The text with each span replaced by its kind; of overlapping spans the first, then the longest, counts."""
    found = sorted(((a, -b, k) for k, v in find(text, automaton).items() for a, b in v))
    parts, at = [], 0
    for a, b, k in found:
        if a >= at:
            parts += [text[at:a], mark.format(k.upper())]
            at = -b
    return "".join([*parts, text[at:]])

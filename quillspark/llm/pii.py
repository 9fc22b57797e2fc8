"""Personal data: patterns propose spans, checksums confirm them, context words score them.

Base kinds (email, ip, card, phone) follow fixed patterns, leftmost and non-overlapping
per kind; a match that fails its check is dropped and not retried. IBANs (length of their
country and mod 97), social security numbers and secrets (keys, tokens, passwords) are
further kinds. A kind starts from a score of its own, and whole words of the context
raise it; further kinds are kept by score, base spans always.

Each pattern is scanned in time linear in the text: starts are anchored at run
boundaries, and an address is found from its "@". Null texts count as empty; of equal
starts the kind listed first comes first; repeated rows are judged each; extra columns
are ignored or kept as asked.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import rows_of, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?= ?[A-Z0-9])")
#: Characters of an IBAN by country.
IBAN_LENGTH = dict(
    pair.split(":")
    for pair in (
        "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FO:18 FR:27 "
        "GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 "
        "MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 SA:24 SC:31 SE:24 SI:19 SK:24 SM:27 ST:25 SV:28 TL:23 "
        "TN:24 TR:26 UA:29 VA:22 VG:24 XK:20"
    ).split()
)
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
#: Secrets that name themselves, values given to a name, and bare runs of key characters.
NAMED_SECRET = re.compile(
    r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}+|sk_live_[A-Za-z0-9]{16,}+)(?![A-Za-z0-9])"
    r"|-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END (?:[A-Z]+ )?PRIVATE KEY-----)?"
)
GIVEN_SECRET = re.compile(
    r"(?<![A-Za-z])(?:password|passwd|pwd|secret|token|api[ _-]?key|access[ _-]?key|secret[ _-]?key|auth[ _-]?key)[\"']?[ \t]*[=:][ \t]*[\"']?([^\s\"',;<>]{5,}[^\s\"',;<>.)])", re.I
)
BARE_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}")
#: Lower-case words that speak for a kind within NEAR characters before or after a span.
CONTEXT = {
    "email": ("mail", "email", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "payment", "credit"),
    "phone": ("phone", "telephone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("token", "secret", "password", "passwd", "key", "apikey", "bearer", "credential", "credentials", "authorization"),
}
START_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.7, "ssn": 0.3, "secret": 0.3}
CONTEXT_GAIN, NEAR, LEAST_SCORE, NAMED = 0.3, 40, 0.5, 0.9
LETTERS = re.compile("[a-z]+")
WORDS = {k: frozenset(w) for k, w in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    cursor = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > cursor and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < m.start():
            yield start, m.end()
            cursor = m.end()


def base_spans(text: str) -> Iterator[tuple[int, int, str]]:
    if "@" in text:
        for a, b in emails(text):
            yield a, b, "email"
    if "." in text:
        for m in IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                yield m.start(), m.end(), "ip"
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.start(), m.end(), "card"
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                yield m.start(), m.end(), "phone"


@cache
def rest_of_iban(n: int) -> re.Pattern[str]:
    return re.compile(rf"(?: ?[A-Z0-9]){{{n}}}(?![A-Za-z0-9])")


def looks_random(run: str) -> bool:
    """Whether a run of key characters has digits and letters in turns, unlike words, paths and numbers."""
    digits = sum(map(run.count, "0123456789"))
    return digits >= 3 and len(run) - digits >= 3 and len(set(run)) >= 8


def more_spans(text: str) -> Iterator[tuple[int, int, str, float]]:
    """Spans of the further kinds with the score that they start from; of secrets that overlap the surer one."""
    for m in IBAN.finditer(text):
        rest = int(IBAN_LENGTH.get(m[1], 0)) - 4
        if rest > 0 and (tail := rest_of_iban(rest).match(text, m.end())) and mod97(text[m.start() : tail.end()].replace(" ", "")):
            yield m.start(), tail.end(), "iban", START_SCORE["iban"]
    if "-" in text:
        for m in SSN.finditer(text):
            yield m.start(), m.end(), "ssn", START_SCORE["ssn"]
    secrets = [(*m.span(), NAMED) for m in NAMED_SECRET.finditer(text)]
    if "=" in text or ":" in text:
        secrets += [(*m.span(1), NAMED) for m in GIVEN_SECRET.finditer(text) if not m[1].isalpha()]
    secrets += [(*m.span(), START_SCORE["secret"]) for m in BARE_SECRET.finditer(text) if looks_random(m[0])]
    end = 0
    for a, b, s in sorted(secrets, key=lambda x: (x[0], -x[2], -x[1])):
        if a >= end:
            yield a, b, "secret", s
            end = b


def score(text: str, start: int, end: int, kind: str, at_first: float) -> float:
    around = text[max(0, start - NEAR) : start].lower() + " " + text[end : end + NEAR].lower()
    return min(1.0, at_first + CONTEXT_GAIN * (not WORDS[kind].isdisjoint(LETTERS.findall(around))))


def spans(text: str | None) -> list[tuple[int, int, str, float]]:
    """All spans (start, end, kind, score) in order of start, then kind; ends are exclusive code points."""
    if not text or not re.search("[0-9@=:]", text):
        return []
    found = [(a, b, k, score(text, a, b, k, START_SCORE[k])) for a, b, k in base_spans(text)]
    for a, b, k, first in more_spans(text):
        if (s := score(text, a, b, k, first)) >= LEAST_SCORE:
            found.append((a, b, k, s))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def redact(text: str | None) -> str | None:
    """The text with each span as its kind in brackets; where spans overlap, the first names them all."""
    if not text:
        return text
    out, at = [], 0
    for a, b, k, _ in spans(text):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans as an array of (start, end, kind, score)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [[{"start": a, "end": b, "kind": k, "score": s} for a, b, k, s in spans(t)] for (t,) in rows_of(batch, ["text"])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, kind)], ["doc_id", "spans"])

    ddl = f"doc_id {id_type}, spans array<struct<start: long, end: long, kind: string, score: double>>"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, ddl)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with the personal data of `text` replaced; n_chars follows where docs has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("text")
            new = pa.array([redact(t) for t in batch.column(i).to_pylist()], batch.schema.field(i).type)
            yield batch.set_column(i, batch.schema.field(i), new)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = found_spans(table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    text = lambda array: F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score")
    return df.select("doc_id", *counts, F.sha2(text(of(*BASE)), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), best)

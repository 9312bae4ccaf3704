"""Secret scans by dictionary-primed zstandard novelty.

Plain rules find assignments, access keys and long hex runs. Beyond them, a string in a sensitive
context is a candidate; its novelty is the number of compressed bytes it adds to the text around it,
with a dictionary of common identifiers already known to the compressor. Words, names and repeated
values cost little; a random string costs close to its own entropy and is reported.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, rebatch, tidy

# The base rules, as the contract states them.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")
WORDS = ("password", "passwd", "secret", "token", "api")

# Dotted runs are one candidate. A sign = ends a name and may pad a value, but is no part of either.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]+(?:\.[A-Za-z0-9+/_-]+)*(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
PRIVATE = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----\s*([A-Za-z0-9+/=\s]+?)\s*-----END", re.ASCII)  # its lines are one candidate
SHORTEST, ALONE = 8, 20  # least characters after a separator, as the base rule's values, and after mere space, as in prose
NAMES = "key|auth|bearer|credential|pwd|pass|secret|token|private|signature|cookie|session|jwt|access|salt"
SENSITIVE = re.compile(NAMES, re.IGNORECASE | re.ASCII)
CONTEXT = re.compile(rf"""({NAMES})[A-Za-z0-9_.-]{{0,24}}["']?\s{{0,3}}([:=]|=>|\s)\s{{0,3}}["']?(?:Bearer\s|Basic\s)?["']?$""", re.IGNORECASE | re.ASCII)
HUMP = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HARD = re.compile(r"[b-df-hj-np-tv-xz]{5}", re.IGNORECASE | re.ASCII)
DATE = re.compile(r"[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}(?:T[0-9]{2})?")
AROUND = 256  # characters of text on either side that prime the compressor
# Identifiers and words that are common around configuration and code.
IDENTIFIERS = """
abstract access account admin application argument array assert async attribute auth authorization await
background backup base64 boolean bucket buffer build button bytes cache callback certificate channel class client
cluster code column command comment commit config configuration connection const constructor container content context
control controller cookie count create credential database datetime debug default define delete description development
directory document domain download element else email enable encoding endpoint environment error event example exception
export expression extends factory false field file filter final finally float format function generator github global
handler hash header height hidden host html http https identifier image implements import include index info initialize
input insert instance integer interface internal invalid issue item iterator java javascript json key label lambda language
length level library license list local localhost location logger login main manager mapping master memory message metadata
method middleware module name namespace network node null number object offset operation option output override package page
parameter parse partition password path pattern payload permission plugin pointer port position prefix private process
production project property protected protocol provider proxy public python query queue random read record reference region
register release remote render repository request require reset resource response result return role root route schema scope
script search secret security select self sequence server service session setting signature size socket source staging start
state static status storage stream string struct style subscribe success suffix super switch symbol sync system table tag
target template test text thread throw time timeout timestamp title token transaction transform true type undefined union
unique update upload user username utils valid value variable vector verify version video view virtual void volume warning
widget width window worker write yaml 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ
"""


@lru_cache(1)
def _compressor() -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=known, write_checksum=False, write_content_size=False)


def novelty(before: str, value: str, after: str) -> float:
    """Compressed bytes that the value adds to its surroundings, per byte."""
    c, size = _compressor(), len(value.encode())
    rest = (before + after).encode()
    return max(0, len(c.compress(rest + value.encode())) - len(c.compress(rest))) / max(1, size)


def expected(value: str) -> float:
    """Bytes per byte of a random string over the value's kinds of characters."""
    kinds = ((r"[0-9]", 10), (r"[a-f]", 6), (r"[g-z]", 20), (r"[A-F]", 6), (r"[G-Z]", 20), (r"[+/_=-]", 3))
    n = sum(k for p, k in kinds if re.search(p, value))
    return (n - 1).bit_length() / 8 if n > 1 else 0.1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def speech(value: str) -> bool:
    """Whether it reads as words, joined words or a date. Those are as new to the compressor as a random string:
    names and ordinary words after 'author:' or 'secret' are told from values by being pronounceable."""
    if DATE.fullmatch(value):
        return True
    humps = HUMP.findall(value)
    letters = sum(map(len, humps))
    if not humps or re.search(r"[0-9+=]", value) or letters < 3.5 * len(humps):
        return False
    return not any(HARD.search(h) for h in humps) and len(re.findall(r"[aeiouyAEIOUY]", value)) >= 0.2 * letters


def novel_spans(text: str, taken: list[tuple[int, int, str]], least: float) -> list[tuple[int, int, str]]:
    """Candidates outside the base spans whose novelty is at least that share of a random string's."""
    out = []
    if not SENSITIVE.search(text):  # no candidate can have a context
        return out
    if "PRIVATE KEY" in text:
        for m in PRIVATE.finditer(text):
            s, e = m.span(1)
            free = not any(a < e and s < b for a, b, _ in taken)
            if free and e - s >= ALONE and novelty(text[max(0, s - AROUND) : s], m[1], text[e : e + AROUND]) >= least * expected(m[1]):
                out.append((s, e, "novel"))
        taken = taken + out
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        if e - s < SHORTEST or any(a < e and s < b for a, b, _ in taken):
            continue
        context = CONTEXT.search(text, max(0, s - 64), s)
        if not context or (e - s < ALONE and context[2].isspace()) or speech(m[0]):
            continue
        if novelty(text[max(0, s - AROUND) : s], m[0], text[e : e + AROUND]) >= least * expected(m[0]):
            out.append((s, e, "novel"))
    return out


def scan(text: str, least: float = 0.8) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) in code points, by start, then kind."""
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, least), key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]], mask: str = "[SECRET]") -> str:
    """The text with each span, or run of overlapping spans, replaced by the mask."""
    out, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"


def _scan(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rebatch(batches):
            cols: list[list] = [[] for _ in range(6)]
            for t in b.column(1).to_pylist():
                spans = scan(t, least)
                kinds = [s[2] for s in spans]
                row = [kinds.count(k) for k in KINDS] + [hashlib.sha256(joined([s for s in spans if s[2] != "novel"]).encode()).hexdigest(), joined(spans)]
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds_ = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds_, strict=True))], names=[c.split()[0] for c in FOUND.split(", ")])

    return tidy(run)


def find_secrets(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """docs (doc_id, text, ...) -> a row per row: counts by kind, digest of the base spans, all spans.

    A null or empty text has none: zero counts, the digest of nothing, an empty string. Spans that start together are listed by kind; a novel
    span never overlaps a base one. Repeated rows and null ids are rows like others; texts of any length are read whole.
    An empty table gives an empty result; further columns are not read.
    """
    return id_text(docs).mapInArrow(_scan(least), FOUND)


def _redact(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rebatch(batches):
            at = b.schema.get_field_index("text")
            texts = [t and redact(t, scan(t, least)) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, pa.string()))

    return tidy(run)


def redact_secrets(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """docs with every span masked in ``text``; other columns and all rows stay, null and empty texts as they are. n_chars follows the text if it is there."""
    out = docs.mapInArrow(_redact(least), docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length("text"), F.col("n_chars")).cast(kind)))
    return out.select(docs.columns)

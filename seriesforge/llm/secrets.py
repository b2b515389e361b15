"""Secrets in text: strict patterns, and strings that compression can't explain.

Beside three fixed patterns, strings of key-like characters in a sensitive
context become candidates. Each is compressed with zstandard primed by a
dictionary of common identifiers and the text around it; the bytes it adds, as
a share of its length, are its novelty. Words, paths and identifiers that the
surroundings explain add little; a random key adds about all of its bytes. So
does a long word that nothing around it holds: strings made of words by their
letters' case and kind, and plain numbers, are no secrets.
From 64 bytes on zstandard codes literals by their frequency, which makes small
alphabets look explained, so longer strings are scored in shorter pieces.

Documents are scanned whole, each inside its task; nothing is shuffled.

Defined results: a null text counts as empty; a document without secrets has
zero counts, an empty span list and the hash of the empty string; null and
repeated ids are returned as they are; an empty table gives an empty result;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm.common import map_rows, table, texts_of

# The base patterns: fixed values. Matches that fail the length are dropped.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # of maximal runs, those of 32 or more
KINDS = ("assign", "access", "hex", "novel")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+")
#: Sensitive words, from border to border: no letter beside them, or a capital where small letters end (apiKey, but no monkey).
SENSITIVE = re.compile(
    r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))"
    r"(?i:(?:api|app|auth|access|secret|private|client|session|encryption|signing|master)?[_-]?(?:key|secret|token|password|passwd|passphrase|passw|pwd|credential)s?"
    r"|auth|authorization|authentication|bearer|private|signature|cookie|session|session_?id|conn(?:ection)?[_ ]?str(?:ing)?)"
    r"(?:(?![A-Za-z])|(?<=[a-z])(?=[A-Z]))"
)
#: What ordinary words look like: letters of one case or capitalised, several of them as in camelCase, with a short number or none; or a number no longer than those of cards and accounts.
WORDLIKE = re.compile(r"(?:[A-Z]?[a-z]+(?:[A-Z][a-z]{2,})*|[A-Z]+)\d{0,4}|\d{1,24}")
APART = re.compile(r"[-_/+=]+")
#: No word: so many letters without a vowel, or this share of letters that words of the Latin alphabet rarely use.
CONSONANTS, RARE_SHARE = re.compile(r"[bcdfghjklmnpqrstvwxz]{7}", re.I), 0.3
RARE = re.compile(r"[jkqvwxyz]", re.I)
#: Characters on either side of a candidate, or of adjoining ones, in which a sensitive word must stand.
NEAR = 48
#: What stands between the lines of one wrapped value: a line end amid white space, quotes and marks, or an escaped one, whose letter the next line gets.
MARKS = r"""\s"'`,;.>|*#\\"""
BETWEEN = re.compile(rf"[{MARKS}+]*[\r\n][{MARKS}]*|\\(?=[nr])")
#: The last line of a wrapped value, shorter than a candidate.
TAIL = re.compile(rf"""(?:{BETWEEN.pattern})([A-Za-z0-9+/_=-]{{1,15}}+)(?=["'`,;]*\s*(?:\Z|[\r\n]|\\[nr]))""")
#: Characters on either side that prime the compressor.
AROUND = 4096
#: From this share of its bytes on, a candidate is news.
NOVELTY = 0.8
#: Most characters of a piece; from 64 on literals are Huffman-coded.
PIECE = 63
IDENTIFIERS = (
    "public static void private protected class return import export function const let var async await def self None True False null true false "
    "application authorization authentication content-type configuration environment connection request response session cookie header "
    "https:// http:// www. .com .org .net /api/v1/ /users/ /login /static/ index.html localhost 127.0.0.1 example.com node_modules site-packages "
    "BEGIN PRIVATE KEY END PUBLIC KEY CERTIFICATE abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 xxxxxxxxxxxxxxxx "
    "your-secret-key-here your_api_key changeme placeholder insert_token_here example_password access_token refresh_token client_secret client_id"
).encode()


def novelty(candidate: bytes, around: bytes) -> float:
    """Bytes that the candidate adds to what surroundings and identifiers explain, as a share of its length."""
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + b"\n" + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False)
    return (len(packer.compress(candidate)) - len(packer.compress(b""))) / len(candidate)


def is_ordinary(candidate: str) -> bool:
    """Whether the candidate is words, alone, hyphenated or as a path or an identifier, or a number.

    Nothing around a long word may hold it, so that it adds its bytes like a key; its letters tell the two apart.
    """
    parts = [x for x in APART.split(candidate) if x]
    if not all(WORDLIKE.fullmatch(x) for x in parts):
        return False
    letters = "".join(x for x in candidate if x.isalpha())
    return not any(CONSONANTS.search(x) for x in parts) and len(RARE.findall(letters)) < RARE_SHARE * max(len(letters), 1)


def is_news(text: str, a: int, b: int) -> bool:
    """Whether some piece of text[a:b] is news after what stands before it, earlier pieces too, and after the whole."""
    after = "\n" + text[b : b + AROUND]
    n = -(-(b - a) // PIECE)
    cuts = [a + (b - a) * i // n for i in range(n + 1)]
    return any(novelty(text[x:y].encode(), (text[max(0, x - AROUND) : x] + after).encode("utf-8", "replace")) >= NOVELTY for x, y in zip(cuts, cuts[1:], strict=False))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns."""
    found = []
    low = text.lower()
    if any(x in low for x in ("password", "passwd", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def novel_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates in a sensitive context that no base span covers and compression can't explain.

    Candidates with nothing but line ends and the like between them share their
    context: a sensitive word beside one of them counts for all.
    """
    if not SENSITIVE.search(text):
        return []
    groups: list[list[tuple[int, int]]] = []
    for m in CANDIDATE.finditer(text):
        if groups and (gap := BETWEEN.match(text, groups[-1][-1][1])) and gap.end() == m.start():
            groups[-1].append(m.span())
        else:
            name = text.find("=", m.start(), m.end() - 16)  # NAME=value: the name is context
            groups.append([(name + 1 or m.start(), m.end())])
    taken = sorted((a, b) for a, _, b in base)
    out, k, reach = [], 0, 0
    for group in groups:
        sensitive = any(SENSITIVE.search(text, max(0, a - NEAR), a) or SENSITIVE.search(text, b, b + NEAR) for a, b in group)
        free = []
        for a, b in group:
            while k < len(taken) and taken[k][0] < b:
                reach = max(reach, taken[k][1])
                k += 1
            if reach <= a:
                free.append((a, b))
        found = [(a, 3, b) for a, b in free if not is_ordinary(text[a:b]) and is_news(text, a, b)] if sensitive else []
        out += found
        sizes = [b - a for a, b in group]
        # A wrapped value may end in a line too short for a candidate.
        if len(group) > 1 and found and found[-1][2] == group[-1][1] and (tail := TAIL.match(text, found[-1][2])) and abs(sizes[-1] - sizes[-2]) < 2:
            out.append((tail.start(1), 3, tail.end(1)))
    return out


def found_secrets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, spans array<struct<kind, start, end>> in code points, by start, then kind."""
    kind = "struct<kind:string,start:long,end:long>"

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for raw in texts_of(b["text"]):
            text = raw.decode("utf-8", "replace")
            base = base_spans(text)
            out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(base + novel_spans(text, base))])
        shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([b["doc_id"], pa.array(out, shape)], ["doc_id", "spans"])

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), "text", batch, f"doc_id long, spans array<{kind}>")


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def base_digest(text: str) -> str:
    return hashlib.sha256(said(base_spans(text)).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = found_secrets(table(spark, sf_dir, "documents"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", *(of_kind(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))

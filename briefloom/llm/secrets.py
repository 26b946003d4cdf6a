"""Secret scans with structural confirmation.

Base kinds are found by their patterns alone.  The further kinds are reported only once their
structure has been read: PEM blocks and base64 or hex runs are decoded, and what they hold must be
a private key whose nested lengths all agree (DER, or the OpenSSH format), or text that
itself holds a base secret; signed tokens must have a header and a payload that are JSON objects.

Spans are in code points, end exclusive, of the whole match.  Null and empty texts have none.
Rows are scanned one by one, so ties, repeated rows and other columns change nothing;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import small_batches
from .textscan import release, tidy

KINDS = ("assign", "access", "hex", "pem", "key", "jwt", "encoded")
BASE = KINDS[:3]

# The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

_NAMES = ("passw", "secret", "token", "api")
#: Characters of base64 and of hex that 16 bytes need, and the shortest line of a wrapped run.
_RUN_LEAST, _HEX_LEAST, _LINE_LEAST = 22, 32, 16
_RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{_RUN_LEAST},}}={{0,2}}")
_HEX_RUN = re.compile(rf"[0-9A-Fa-f]{{{_HEX_LEAST},}}")
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{{{_LINE_LEAST},}}+[ \t]*+\r?\n[ \t]*+)++(?:[A-Za-z0-9+/_-]++={{0,2}})?")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
#: How often encoded text may itself hold encoded text.
_MOST_DEPTH = 3
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----((?:\s*[A-Za-z-]{1,40}: [^\n]*\n)*)([^-]*)-----END \1-----")

INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30


def decoded64(text: str) -> bytes | None:
    """The bytes of base64 text in either alphabet, padded or not; None if it is none."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except binascii.Error:
        return None


def der_children(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """The (tag, content) of DER elements that fill data exactly; sequences within must be filled exactly as well."""
    found, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or depth > 12:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > len(data):
            return None
        content = data[at : at + size]
        if tag == SEQUENCE and der_children(content, depth + 1) is None:
            return None
        found.append((tag, content))
        at += size
    return found


def is_der_key(data: bytes) -> bool:
    """Whether data is one DER private key: PKCS#1, PKCS#8 (plain or encrypted) or SEC 1."""
    if data[:1] != bytes([SEQUENCE]):
        return False
    outer = der_children(data)
    if not outer or len(outer) != 1:
        return False
    inner = der_children(outer[0][1]) or []
    tags = [t for t, _ in inner]
    algorithm = lambda content: [t for t, _ in der_children(content) or []][:1] == [OID]
    if tags[:1] == [INTEGER] and len(inner[0][1]) <= 1:
        if len(tags) >= 6 and set(tags) == {INTEGER}:
            return True
        if tags[1:3] == [SEQUENCE, OCTETS]:
            return algorithm(inner[1][1])
        return tags[1:2] == [OCTETS] and len(inner[1][1]) in (24, 28, 32, 48, 66) and all(t in (0xA0, 0xA1) for t in tags[2:])
    return tags == [SEQUENCE, OCTETS] and algorithm(inner[0][1])


def is_openssh_key(data: bytes) -> bool:
    """Whether data is an OpenSSH private key: a magic word, then fields with lengths that end with the data."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, fields = len(magic), 0
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if fields == 3:  # the number of keys, which is no length
            at, fields = at + 4, fields + 1
            continue
        at, fields = at + 4 + size, fields + 1
    return at == len(data) and fields >= 6


def is_key(data: bytes | None) -> bool:
    return bool(data) and (is_der_key(data) or is_openssh_key(data))


def is_signed_token(text: str) -> bool:
    head, body, sign = text.split(".")
    try:
        header, claims = (json.loads(decoded64(x) or b"-") for x in (head, body))
    except ValueError:
        return False
    if not isinstance(header, dict) or not isinstance(claims, dict) or not isinstance(header.get("alg"), str):
        return False
    return bool(sign) or header["alg"] == "none"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of kind, end) of the base kinds."""
    found = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def holds_secret(data: bytes | None, depth: int = 0) -> bool:
    """Whether data is UTF-8 text that itself has a secret of any kind but hex."""
    if not data or len(data) < 16 or depth >= _MOST_DEPTH:
        return False
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return not _CONTROL.search(text) and any(kind != 2 for _, kind, _ in spans(text, depth + 1))


def _kind(data: bytes | None, depth: int) -> int | None:
    """The kind of what a run holds: a key, text with a secret, or neither."""
    return 4 if is_key(data) else 6 if holds_secret(data, depth) else None


def _wrapped(text: str):
    """(start, end, characters) of runs over several lines: lines of one width and a shorter last one, the same without the last,
    and all lines together."""
    for m in _WRAPPED.finditer(text):
        lines = [(x.start(), x.end(), x[0]) for x in _LINE.finditer(text, m.start(), m.end())]
        groups, at = [(0, len(lines))], 0
        while at < len(lines):
            end = at + 1
            while end < len(lines) and len(lines[end][2]) == len(lines[at][2]):
                end += 1
            groups.append((at, end))
            if end < len(lines) and len(lines[end][2]) < len(lines[at][2]):
                groups.append((at, end + 1))
            at = end
        for i, j in sorted({g for g in groups if g[1] - g[0] > 1}):
            yield lines[i][0], lines[j - 1][1], "".join(x[2] for x in lines[i:j])


def spans(text: str, depth: int = 0) -> list[tuple[int, int, int]]:
    """(start, number of kind, end) of all secrets, in order.  depth: of how many encodings the text was taken out."""
    longest = max(map(len, text.split()), default=0)
    if longest < ASSIGN_LEAST:  # every kind has so many characters without white space
        return []
    found = base_spans(text)
    if "PRIVATE KEY-----" in text:
        found += [(m.start(), 3, m.end()) for m in _PEM.finditer(text) if m[2].strip() or is_key(decoded64("".join(m[3].split())))]
    armoured = [(a, b) for a, kind, b in found if kind == 3]
    runs = []
    if longest >= _RUN_LEAST:
        runs += [(m.start(), m.end(), decoded64(m[0])) for m in _RUN.finditer(text)]
        hexes = {(m.start(), m.end()) for m in _HEX_RUN.finditer(text)} | {(a, b) for a, kind, b in found if kind == 2}
        runs += [(a, b, bytes.fromhex(text[a:b])) for a, b in hexes if (b - a) % 2 == 0]
    if longest >= _LINE_LEAST and "\n" in text:
        for a, b, joined in _wrapped(text):
            if not any(x <= a and b <= y for x, y in armoured):
                runs.append((a, b, decoded64(joined)))
                if len(joined) % 2 == 0 and _HEX_RUN.fullmatch(joined):
                    runs.append((a, b, bytes.fromhex(joined)))
    found += [(a, kind, b) for a, b, data in runs if (kind := _kind(data, depth)) is not None]
    if "eyJ" in text:
        found += [(m.start(), 5, m.end()) for m in _JWT.finditer(text) if is_signed_token(m[0])]
    return sorted(set(found))


def found_secrets(text: Column) -> Column:
    """An array of (kind, start, end) of the whole text."""

    def scanned(column: pa.Array) -> pa.Array:
        release()
        rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(x.as_py() or "")] for x in column]
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    return F.arrow_udf(tidy(scanned), "array<struct<kind: string, start: int, end: int>>")(text)


def without_secrets(text: str) -> str:
    """The text with each stretch of secrets replaced by a note of its first kind."""
    out, at, upto = [], 0, -1
    for start, kind, end in spans(text):
        if start >= upto:
            out += [text[at:start], f"[secret:{KINDS[kind]}]"]
        upto = max(upto, end)
        at = upto
    return "".join([*out, text[at:]])


def redacted(text: Column) -> Column:
    def cleaned(column: pa.Array) -> pa.Array:
        release()
        return pa.array([None if x is None else without_secrets(x) for x in column.to_pylist()], pa.string())

    return F.arrow_udf(tidy(cleaned), "string")(text)


def redact_documents(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with secrets replaced in the text; a column of the text's length follows it."""
    small_batches(docs.sparkSession)
    out = docs.withColumn(text, redacted(F.col(text)))
    return out.withColumn(length, F.char_length(text).cast(docs.schema[length].dataType)) if length in docs.columns else out


def sha256_of(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = docs.select("doc_id", found_secrets(F.col("text")).alias("s"))
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    number = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("s", lambda x: x["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[number(k) for k in BASE],
        sha256_of(F.array_join(F.transform(base, line), ",")).alias("base_sha256"),
        F.array_join(F.transform("s", line), ",").alias("spans"),
    )

"""Text rules as column expressions; one Arrow function for what Unicode forms need."""

from __future__ import annotations

import html
import re
import unicodedata
from html.parser import HTMLParser
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import by_slices

CJK = r"[㐀-䶿一-鿿]"
CJK_WIDE = r"[㐀-鿿]"

# Words of announcements that say nothing of what is announced.
_ANNOUNCE = re.compile(r"\b(introducing|announcing|launching|release[ds]?|new)\b")
_NOT_WORD = re.compile(r"[^\w一-鿿]+")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def truncated(text: Column, limit: int | Column) -> Column:
    """White space collapsed; what is longer than the limit ends in an ellipsis."""
    flat = collapsed(text)
    shown = max(0, limit - 1) if isinstance(limit, int) else F.greatest(F.lit(0), limit - 1)
    return F.when(F.char_length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, F.lit(1), F.lit(shown))), F.lit("…")))


def estimated_tokens(text: Column) -> Column:
    """One for each CJK character, one for each three other characters or part of three."""
    wide = F.regexp_count(text, F.lit(CJK_WIDE))
    return (wide + F.ceil((F.char_length(text) - wide) / 3)).cast("bigint")


def excerpt_within(value: str, frame_wide: int, frame_other: int, budget: int) -> str:
    """The longest beginning of a text on one line that fits beside a frame of so many wide and other characters, as JSON."""
    flat = " ".join(value.split())
    units = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = (units >= 0x3400) & (units <= 0x9FFF)
    # quotes, backslashes and backspaces take two characters of JSON, other control characters six
    size = 1 + np.isin(units, (0x22, 0x5C, 0x08)) + 5 * ((units < 0x20) & (units != 0x08))
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    n_wide, n_other = sums(wide), sums(np.where(wide, 0, size))
    tokens = lambda w, o: frame_wide + w + (frame_other + o + 2) // 3
    if tokens(n_wide[-1], n_other[-1]) <= budget:
        return flat
    # what is cut ends in one more character, the ellipsis, after the last character that is no space
    ends = np.arange(max(0, len(flat) - 1))
    ends -= (ends > 0) & (units[ends - 1] == 0x20)
    fit = int(np.searchsorted(tokens(n_wide[ends], n_other[ends] + 1), budget, "right"))
    return flat[: ends[fit - 1]] + "…" if fit else ""


def excerpt(text: Column, frame: Column, budget: int) -> Column:
    """The longest beginning of the text that, in the frame that a prompt puts around it, stays within a budget of estimated tokens."""

    def made(texts: list, wide: list, other: list) -> list:
        return [None if t is None else excerpt_within(t, w or 0, o or 0, budget) for t, w, o in zip(texts, wide, other)]

    wide = F.regexp_count(frame, F.lit(CJK_WIDE))
    return F.arrow_udf(by_slices(made, pa.string()), "string")(text, wide, F.char_length(frame) - wide)


def is_chinese(text: Column) -> Column:
    """Two CJK characters at least."""
    return F.coalesce(F.regexp_count(F.trim(text), F.lit(CJK)) >= 2, F.lit(False))


def all_chinese(texts: Column) -> Column:
    return F.forall(texts, is_chinese)


def is_calendar_date(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def is_rfc3339(text: Column) -> Column:
    shape = r"^\d{4}-(0[1-9]|1[0-2])-\d{2}T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)$"
    return F.coalesce(text.rlike(shape) & F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd").isNotNull(), F.lit(False))


# Forms of secrets in texts: an assignment to a telling name, then bearer values and well-known tokens.
ASSIGNED_SECRET = r"""(?i)(?<![A-Za-z0-9_-])((?:[A-Za-z][A-Za-z0-9_-]*[_-])?(?:api[_-]?key|access[_-]?token|token|secret|password))\s*[:=]\s*(?:"[^"]*"|'[^']*'|[^\s,;]+)"""
TOKENS = (
    r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{8,}",
    r"(?<![A-Za-z0-9])sk-[A-Za-z0-9_-]{8,}(?![A-Za-z0-9])",
    r"(?i)(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{20,}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}(?![A-Za-z0-9])",
)
#: What a text with any of these forms has.
SECRET_MARK = r"[:=]|sk-|[Gg][Hh][A-Za-z]_|eyJ|[Bb][Ee][Aa][Rr][Ee][Rr]"


def redacted(text: Column) -> Column:
    """Secrets replaced by a note; of an assignment its name stays.  Texts without a mark of one are looked through once."""
    out = F.regexp_replace(text, ASSIGNED_SECRET, "$1=[REDACTED]")
    for form in TOKENS:
        out = F.regexp_replace(out, form, "[REDACTED]")
    return F.when(text.rlike(SECRET_MARK), out).otherwise(text)


def slug_text(value: str) -> str:
    return quote(" ".join(unicodedata.normalize("NFKC", value).casefold().split()), safe="-$")


def title_text(value: str) -> str:
    value = _ANNOUNCE.sub(" ", unicodedata.normalize("NFKC", value).lower())
    return " ".join(_NOT_WORD.sub(" ", value).split())


def company_text(value: str) -> str:
    kinds = [(c, unicodedata.category(c)) for c in unicodedata.normalize("NFKC", value).casefold()]
    return " ".join("".join(" " if k[0] == "P" else c for c, k in kinds if k != "Cf").split())


def body_text(value: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", value).casefold().split())


def _mapped(function) -> object:
    return F.arrow_udf(by_slices(lambda column: [None if x is None else function(x) for x in column], pa.string()), "string")


def slug(text: Column) -> Column:
    return _mapped(slug_text)(text)


def slugs(texts: Column) -> Column:
    """The slugs of a list of texts, in its order; null texts are empty."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else [slug_text(t or "") for t in x] for x in column.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(texts)


def normal_title(text: Column) -> Column:
    return _mapped(title_text)(text)


def company_key(text: Column) -> Column:
    return _mapped(company_text)(text)


def normal_body(text: Column) -> Column:
    return _mapped(body_text)(text)


def fingerprint(*parts: Column) -> Column:
    """The slugs of the parts that identify an event; a missing part is empty."""
    return F.concat_ws("|", *[slug(F.coalesce(p, F.lit(""))) for p in parts])


class _Texts(HTMLParser):
    """Texts of a page; those inside the given elements are skipped."""

    def __init__(self, skip: frozenset[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.depth, self.texts, self.titles, self.in_title = skip, 0, [], [], False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.depth += tag in self.skip
        self.in_title |= tag == "title"

    def handle_endtag(self, tag: str) -> None:
        if tag in self.skip and self.depth:
            self.depth -= 1
        if tag == "title":
            self.in_title = False

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.titles.append(data)
        if not self.depth:
            self.texts.append(data)


_UNREAD = frozenset("script style template".split())
_SKIPPED = frozenset("script style nav footer noscript".split())


def _parsed(page: str, skip: frozenset[str]) -> _Texts:
    parser = _Texts(skip)
    parser.feed(page)
    parser.close()
    return parser


def cleaned_html(page: Column, limit: int = 2400) -> Column:
    """A page's text on one line, without what scripts and styles say."""
    return _mapped(lambda x: " ".join(" ".join(_parsed(html.unescape(x), _UNREAD).texts).split())[:limit])(page)


PAGE_BYTES, PAGE_CHARACTERS, LEAST_CHARACTERS = 1_000_000, 80_000, 80


def page_content(page: Column) -> Column:
    """title, text, truncated and status of a fetched page: its text without scripts, styles and navigation."""

    def made(column: list) -> list:
        rows = []
        for x in column:
            raw = (x or "").encode()
            found = _parsed(raw[:PAGE_BYTES].decode("utf-8", "ignore"), _SKIPPED)
            text = " ".join(" ".join(found.texts).split())
            cut = len(raw) > PAGE_BYTES or len(text) > PAGE_CHARACTERS
            good = len(text) >= LEAST_CHARACTERS and not cut
            rows.append({"title": " ".join("".join(found.titles).split()), "text": text[:PAGE_CHARACTERS], "truncated": cut, "status": "verified" if good else "insufficient"})
        return rows

    kind = pa.struct([("title", pa.string()), ("text", pa.string()), ("truncated", pa.bool_()), ("status", pa.string())])
    return F.arrow_udf(by_slices(made, kind), "struct<title: string, text: string, truncated: boolean, status: string>")(page)


def fetch_status(code: Column, content_type: Column, content_status: Column) -> Column:
    """What a fetch came to: refused, not a page, or what its content says."""
    return F.when(code.isin(401, 403, 429), "blocked").when((code >= 400) | ~F.lower(content_type).startswith("text/html"), "unavailable").otherwise(content_status)


def is_repository_name(title: Column) -> Column:
    """Whether a title is only the name of a repository, owner/name."""
    return F.coalesce(title.rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$"), F.lit(False))


def first_full(*texts: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def source_label(source: Column) -> Column:
    return F.split_part(source, F.lit(" · "), F.lit(1))


def escaped_markdown(text: Column, most_bytes: int) -> Column:
    """White space collapsed and marks escaped; what takes more bytes ends in an ellipsis after the last whole character that fits."""
    flat = F.substring(collapsed(text), 1, most_bytes + 1)  # a character takes a byte at least
    escaped = F.regexp_replace(flat, r"([\\\[\]*_`])", r"\\$1")
    units = F.regexp_extract_all(escaped, F.lit(r"(?s)(\\.|[^\\])"), F.lit(1))

    def add(done: Column, unit: Column) -> Column:
        left = done["left"] - F.octet_length(unit)
        fits = left >= 0
        return F.struct(F.when(fits, F.concat(done["text"], unit)).otherwise(done["text"]).alias("text"), F.when(fits, left).otherwise(-1).alias("left"))

    start = F.struct(F.lit("").alias("text"), F.lit(most_bytes - 3).alias("left"))
    short = F.concat(F.rtrim(F.aggregate(units, start, add, lambda x: x["text"])), F.lit("…"))
    return F.when(F.octet_length(escaped) <= most_bytes, escaped).otherwise(short)

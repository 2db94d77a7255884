"""Personal data found by anchor expansion: one Aho-Corasick pass finds anchors, local parsers find where a span ends.

Anchors are at-signs, plus signs, digits, URL schemes and words that announce an account. Each has a parser that looks
only at the text around it and says the same whatever stands elsewhere. The base kinds are defined by patterns, leftmost
and non-overlapping within a kind; a match that fails its check is dropped and not tried at another length:

- email: ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
- ip: ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, each part at most 255
- card: ``[0-9]([\\x20-]?[0-9])+``, 12 to 19 digits that pass the Luhn check
- phone: ``\\+[0-9][\\x20().0-9-]+[0-9]``, 9 to 15 digits

Anchors add further kinds, which may overlap these: ``spelled_email`` (name (at) host (dot) domain), ``url`` (a scheme and a
host), ``iban`` (after its name, check digits right), ``account`` (a number of 6 to 20 digits after a word for account) and ``ssn``
(after its name, in a range that is given out).

A null text has no spans; repeated rows are handled one by one; an empty table gives an empty table; other columns stay
as they are. Work and memory grow with the length of a text, which is never split.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vertexloom.llm.common import arrow_map, numbered, slices

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "spelled_email", "url", "iban", "account", "ssn"]
SPANS = "array<struct<kind: string, start: long, end: long>>"
SLICE_BYTES = 4_000_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DIGITS = re.compile(r"[0-9]++")
ADDRESS = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
CHAIN = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SPELLED_HOST = re.compile(r"[ ]{0,2}([A-Za-z0-9-]++(?:[ ]{0,2}(?:\.|[(\[{][Dd][Oo][Tt][)\]}])[ ]{0,2}[A-Za-z0-9-]++)++)")
HOST = re.compile(r"(?:[A-Za-z0-9._~%!$&'*+,;=:-]++@)?(?:[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+|\[[0-9A-Fa-f:.]++\])(?::[0-9]{1,5})?(?:[/?#][^\s<>\"]*+)?")
CONNECTOR = r"[ ]{0,2}(?:[Nn]umber|[Nn]ummer|NUMBER|[Nn]um|[Nn]ro?|[Nn]o|NO|NR)?\.?[ ]{0,2}[:#=]?[ ]{0,2}"
IBAN = re.compile(CONNECTOR + r"([A-Za-z]{2}[0-9]{2}(?:[ ]?[A-Za-z0-9]){11,30})(?![A-Za-z0-9])")
ACCOUNT = re.compile(CONNECTOR + r"([0-9](?:[ -]?[0-9])++)")
SOCIAL = re.compile(CONNECTOR + r"([0-9]{3})([ -]?)([0-9]{2})\2([0-9]{4})(?![0-9])")

SCHEMES = ["http://", "https://", "ftp://", "sftp://", "ssh://"]
AT_SIGNS = ["(at)", "[at]", "{at}"]
ACCOUNT_WORDS = ["account", "acct", "konto", "kontonummer", "compte", "cuenta"]

Span = tuple[int, int, int, str]  # start, number of the kind, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) << (i & 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def iban_holds(number: str) -> bool:
    """The check digits of an account number: its letters as numbers from 10, first four signs last, 1 modulo 97."""
    turned = number[4:] + number[:4]
    return int("".join(str(int(sign, 36)) for sign in turned)) % 97 == 1


class Finder:
    """The automaton of all anchors; ``spans`` runs it over a text."""

    def __init__(self) -> None:
        self.anchors = ahocorasick.Automaton()
        for sign in "0123456789":
            self.anchors.add_word(sign, (1, self._digits))
        self.anchors.add_word("@", (1, self._email))
        self.anchors.add_word("+", (1, self._phone))
        for names, parser in (
            (SCHEMES, self._url), (AT_SIGNS, self._spelled_email), (["iban"], self._iban), (ACCOUNT_WORDS, self._account), (["ssn"], self._ssn)
        ):
            for name in names:
                for written in {name, name.upper(), name.capitalize()}:
                    self.anchors.add_word(written, (len(written), parser))
        self.anchors.make_automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """``(kind, start, end)`` in code points by start, then kind as listed in ``KINDS``, then end."""
        self.text, self.found = text, []
        self.email_from = self.ip_from = self.card_from = self.url_from = 0
        parser: Callable[[int, int], None]
        for last, (length, parser) in self.anchors.iter(text):
            parser(last + 1 - length, last + 1)
        numbers = {kind: i for i, kind in enumerate(KINDS)}
        return sorted(set(self.found), key=lambda span: (span[1], numbers[span[0]], span[2]))

    def _add(self, kind: str, start: int, end: int) -> None:
        self.found.append((kind, start, end))

    def _local_start(self, end: int, least: int) -> int:
        start, text = end, self.text
        while start > least and text[start - 1] in LOCAL:
            start -= 1
        return start

    def _email(self, at: int, after: int) -> None:
        start = self._local_start(at, self.email_from)
        host = DOMAIN.match(self.text, after) if start < at else None
        if host:
            self.email_from = host.end()
            self._add("email", start, host.end())

    def _digits(self, at: int, after: int) -> None:
        if at >= self.ip_from:
            match = ADDRESS.match(self.text, at)
            if match:
                parts = (part.lstrip("0") for part in match.group().split("."))
                if all(len(part) <= 3 and int(part or 0) <= 255 for part in parts):
                    self._add("ip", at, match.end())
            self.ip_from = (match or DIGITS.match(self.text, at)).end()
        if at >= self.card_from:
            end = CHAIN.match(self.text, at).end()
            self.card_from = end
            if 12 <= end - at <= 37:  # 19 digits, one sign between each two
                digits = self.text[at:end].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    self._add("card", at, end)

    def _phone(self, at: int, after: int) -> None:
        match = PHONE.match(self.text, at)
        if match and 9 <= sum(map(str.isdigit, match.group())) <= 15:
            self._add("phone", at, match.end())

    def _url(self, at: int, after: int) -> None:
        if at < self.url_from or at and self.text[at - 1].isalnum():
            return  # inside a longer address or the end of a longer scheme
        host = HOST.match(self.text, after)
        if host:
            end = after + len(host.group().rstrip(".,;:!?'\")]}"))
            if end > after:
                self.url_from = end
                self._add("url", at, end)

    def _spelled_email(self, at: int, after: int) -> None:
        end = at
        while end and at - end < 2 and self.text[end - 1] == " ":
            end -= 1
        start = self._local_start(end, 0)
        host = SPELLED_HOST.match(self.text, after) if start < end else None
        if host:
            self._add("spelled_email", start, host.end())

    def _announced(self, pattern: re.Pattern[str], at: int, after: int) -> re.Match[str] | None:
        if at and self.text[at - 1].isalnum():
            return None
        return pattern.match(self.text, after)

    def _iban(self, at: int, after: int) -> None:
        match = self._announced(IBAN, at, after)
        if match and iban_holds(match.group(1).replace(" ", "")):
            self._add("iban", match.start(1), match.end(1))

    def _account(self, at: int, after: int) -> None:
        match = self._announced(ACCOUNT, at, after)
        if match and match.end(1) - match.start(1) < 40 and 6 <= sum(map(str.isdigit, match.group(1))) <= 20:
            self._add("account", match.start(1), match.end(1))

    def _ssn(self, at: int, after: int) -> None:
        match = self._announced(SOCIAL, at, after)
        if match and match.group(1) not in ("000", "666") and match.group(1) < "900" and match.group(3) != "00" and match.group(4) != "0000":
            self._add("ssn", match.start(1), match.end(4))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each stretch of spans that touch or overlap replaced by the kind of the first in brackets."""
    parts, place, limit = [], 0, -1
    for kind, start, end in spans:
        if start > limit:
            parts += [text[place:start], f"[{kind}]"]
        place = limit = max(limit, end)
    return "".join([*parts, text[max(place, 0) :]])


def personal_data(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, the ``spans`` of its texts (kind, start, end in code points, end exclusive; by start, then
    kind as listed, then end) and ``masked``, the text with the kinds in place of the spans."""
    plain, at = numbered(docs), docs.columns.index("text")
    schema = StructType([*plain.schema.fields, *StructType.fromDDL(f"spans {SPANS}, masked string").fields])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in slices(batches, f"_c{at}", SLICE_BYTES):
            texts = batch.column(at).to_pylist()
            found = [finder.spans(text or "") for text in texts]
            rows = [[dict(zip(("kind", "start", "end"), span)) for span in spans] for spans in found]
            hidden = [text if not spans else masked(text, spans) for text, spans in zip(texts, found)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rows, kind), pa.array(hidden, pa.string())], [*batch.schema.names, "spans", "masked"]
            )
    return arrow_map(plain, run, schema).toDF(*docs.columns, "spans", "masked")


def span_digests(found: DataFrame) -> DataFrame:
    """``doc_id``, the number of spans of each base kind, the digest of these spans and a list of all spans."""
    def listed(spans: Column) -> Column:
        written = F.transform(spans, lambda span: F.concat_ws(":", span.kind, span.start.cast("string"), span.end.cast("string")))
        return F.array_join(written, ",")

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda span: span.kind.isin(*kinds))
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(of(*BASE_KINDS)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))

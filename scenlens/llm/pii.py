"""Finds personal data from anchors: one Aho-Corasick pass, then local parsers around each hit.

The automaton finds at-signs, plus signs, URL schemes and cues of accounts and secrets; runs of digits are
the anchors of addresses and cards.  Each parser walks from its anchor to the ends of the value and checks it, so
the work follows the text's length however long its runs are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenlens.llm.shared import ready

BASE = ("email", "ip", "card", "phone")
#: Kinds that the method adds, after the base kinds.
MORE = ("account", "secret", "login")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a run of digits is tried from its start only: a match always takes the last run whole
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SECRET = re.compile(r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_+/.=-]{16,512})(?![A-Za-z0-9_+/.=-])")
_LOGIN = re.compile(r"[^\s/@:\"'<>]{1,256}:[^\s/@\"'<>]{1,256}@[A-Za-z0-9.-]{1,253}")

#: Cues and the parser that each one starts.
CUES = {
    "@": "email", "+": "phone", "://": "login", "iban": "account", "account": "account", "konto": "account",
    "compte": "account", "cuenta": "account", "token": "secret", "secret": "secret", "password": "secret",
    "passwd": "secret", "api_key": "secret", "apikey": "secret",
}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for cue, kind in CUES.items():
        found.add_word(cue, (len(cue), kind))
    found.make_automaton()
    return found


_FINDER: list[ahocorasick.Automaton] = []


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str, anchors: list[int]) -> Iterator[tuple[int, int]]:
    """From each at-sign to the left while the local part lasts, to the right over the domain's labels."""
    done = 0
    for at in anchors:
        if at < done:
            continue
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str, anchors: list[int]) -> Iterator[tuple[int, int]]:
    done = 0
    for at in anchors:
        if at >= done and (m := _PHONE.match(text, at)):
            done = m.end()
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                yield m.span()


def _accounts(text: str, anchors: list[int]) -> Iterator[tuple[int, int]]:
    """An account number within 24 characters after its cue, by its check digits."""
    done = 0
    for end in anchors:
        for at in range(max(end, done), min(end + 24, len(text))):
            if (m := _ACCOUNT.match(text, at)) and not text[at - 1].isalnum():
                # the longest leading part of whole groups that checks
                value = m.group()
                while value and not (15 <= len(value.replace(" ", "")) <= 34 and _mod97(value.replace(" ", ""))):
                    value = value.rpartition(" ")[0]
                if value:
                    yield at, at + len(value)
                    done = at + len(value)
                    break


def _secrets(text: str, anchors: list[int]) -> Iterator[tuple[int, int]]:
    """A long value with letters and digits that is assigned to the cue."""
    done = 0
    for end in anchors:
        if end >= done and (m := _SECRET.match(text, end)):
            value = m.group(1)
            if any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
                yield m.span(1)
                done = m.end()


def _logins(text: str, anchors: list[int]) -> Iterator[tuple[int, int]]:
    """User and password in an address, after its scheme."""
    done = 0
    for end in anchors:
        if end >= done and (m := _LOGIN.match(text, end)):
            yield m.span()
            done = m.end()


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans (start, end) in code points of every kind; of one kind they do not overlap."""
    if not _FINDER:
        _FINDER.append(_automaton())
    anchors: dict[str, list[int]] = {k: [] for k in CUES.values()}
    folded = text if text.islower() else text.lower()
    if len(folded) != len(text):  # a letter whose lower case has another length
        folded = "".join(c if len(low := c.lower()) != 1 else low for c in text)
    for last, (length, kind) in _FINDER[0].iter(folded):
        anchors[kind].append(last + (0 if length == 1 else 1))
    digits = any(d in text for d in "0123456789")
    return {
        "email": list(_emails(text, anchors["email"])) if anchors["email"] else [],
        "ip": list(_ips(text)) if digits else [],
        "card": list(_cards(text)) if digits else [],
        "phone": list(_phones(text, anchors["phone"])) if digits and anchors["phone"] else [],
        "account": list(_accounts(text, anchors["account"])) if anchors["account"] else [],
        "secret": list(_secrets(text, anchors["secret"])) if anchors["secret"] else [],
        "login": list(_logins(text, anchors["login"])) if anchors["login"] else [],
    }


def find_pii(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and spans (kind, start, end) of every row's whole text, by kind in the order of BASE and MORE, then start.

    Null text counts as empty and has none.  Repeated rows are rows of their own, an empty table gives none, and
    columns but the two named are not read.  Base kinds are the leftmost matches that do not overlap; a match whose
    numbers fail its check is dropped, and nothing inside it is tried again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, starts, stops, ends = [], [], [], [0]
            for value in batch.column(1).to_pylist():
                for kind, spans in (find_spans(value) if value else {}).items():
                    kinds += [kind] * len(spans)
                    starts += [a for a, _ in spans]
                    stops += [b for _, b in spans]
                ends.append(len(kinds))
            spans = pa.StructArray.from_arrays(
                [pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64())],
                names=["kind", "start", "end"],
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)], names=["doc_id", "spans"]
            )

    ready(docs.sparkSession)
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = dict(kept.dtypes)["doc_id"]
    return kept.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def joined_spans(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the checksum of their spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.withColumn("base", base).select(
        "doc_id", *[count(k) for k in BASE],
        F.sha2(joined_spans("base"), 256).alias("base_sha256"), joined_spans("spans").alias("spans"),
    )


"""Secret scans: keyword prefilter, anchored patterns near hits, checksums.

One Aho-Corasick automaton of all keywords runs over the whole text, lower-cased
in ASCII; each kind's pattern is then tried only at the places its keywords
mark.  Kinds whose format embeds a checksum (six base-62 digits of the CRC-32 of
the body) count only if it holds.  Runs of hexadecimal digits have no keyword;
one scan of their own finds them.

Positions: the automaton and the patterns work on UTF-8 bytes; spans are code
points, end exclusive.  Matches of a kind are leftmost and don't overlap; a match
that fails its kind's test is dropped but still consumes its text.

Edges: null or empty text has no spans; repeated rows stay rows; an empty table
gives an empty result; other columns pass through.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_digits(body: bytes) -> bytes:
    """CRC-32 of a token's body as six base-62 digits."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _BASE62[d] + out
    return out.encode()


def _checksum(match: re.Match) -> bool:
    body = match[0].partition(b"_")[2]
    return crc_digits(body[:-6]) == body[-6:]


@dataclass(frozen=True)
class Kind:
    """``keywords`` (lower case) mark where ``pattern`` is tried, ``back`` bytes
    earlier; ``valid`` tests a match."""

    name: str
    keywords: tuple[str, ...]
    pattern: bytes
    valid: Callable[[re.Match], bool]
    ignore_case: bool = False


# Published formats of credentials, base kinds first.
KINDS = (
    Kind("assign", ("password", "passwd", "secret", "token", "api_key", "apikey"),
         rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         lambda m: len(m[2]) >= 6, ignore_case=True),
    Kind("access", ("akia",), rb"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    Kind("hex", (), rb"[0-9a-f]{24,}", lambda m: True),
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])", _checksum),
    Kind("npm", ("npm_",), rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])", _checksum),
    Kind("slack", ("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), rb"xox[bpars]-[0-9]+-[A-Za-z0-9-]+", lambda m: len(m[0]) >= 24),
    Kind("google", ("aiza",), rb"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])", lambda m: True),
    Kind("stripe", ("sk_live_", "rk_live_"), rb"[sr]k_live_[A-Za-z0-9]{24,}", lambda m: True),
    Kind("pem", ("-----begin ",), rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", lambda m: True),
)
BASE = ("assign", "access", "hex")


class Scanner:
    """Automaton and patterns of some kinds; built once per task."""

    def __init__(self, kinds: tuple[Kind, ...] = KINDS):
        self.kinds = kinds
        self.patterns = [re.compile(k.pattern, re.I if k.ignore_case else 0) for k in kinds]
        marks: dict[str, list[int]] = {}
        for i, k in enumerate(kinds):
            for word in k.keywords:
                marks.setdefault(word, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for word, which in marks.items():
            self.automaton.add_word(word, (len(word), tuple(which)))
        if marks:
            self.automaton.make_automaton()
        self.free = [i for i, k in enumerate(kinds) if not k.keywords]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, kind's place) of all secrets, by start, then kind."""
        raw = text.encode()
        found = []
        hits: dict[int, list[int]] = {}
        if len(self.automaton):
            for end, (length, which) in self.automaton.iter(raw.lower().decode("latin-1")):  # one character a byte
                for i in which:
                    hits.setdefault(i, []).append(end + 1 - length)
        for i, starts in hits.items():
            last = 0
            for at in sorted(set(starts)):
                if at >= last and (m := self.patterns[i].match(raw, at)):
                    last = m.end()
                    if self.kinds[i].valid(m):
                        found.append((m.start(), last, i))
        for i in self.free:
            found += [(m.start(), m.end(), i) for m in self.patterns[i].finditer(raw) if self.kinds[i].valid(m)]
        if found and len(raw) != len(text):
            chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
            found = [(int(chars[a]), int(chars[b]), i) for a, b, i in found]
        return sorted(found, key=lambda x: (x[0], x[2]))


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(text: str, out: str, kinds: tuple[Kind, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(kinds)
        for batch in batches:
            rows = [[{"kind": kinds[i].name, "start": a, "end": b} for a, b, i in scanner.spans(x.as_py())]
                    for x in pc.fill_null(batch.column(text), "")]
            yield batch.drop_columns([text]).append_column(out, pa.array(rows, _SPANS_ARROW))
    return run


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with its text replaced by ``out``: array of (kind, start, end); a
    column named ``out`` gives way to it."""
    docs = docs.drop(out)
    fields = [f for f in docs.schema.fields if f.name != text]
    return docs.mapInArrow(_scan(text, out, kinds), T.StructType([*fields, T.StructField(out, _SPANS)]))

"""Token counts by offset-mapped attribution.

A document's fields are joined into one text, which is encoded once; counts of
fields and of sections (lines, with their line break) come from the tokens'
character spans.  An interval join gives each token the sections that it
overlaps; a token that crosses a boundary goes to the section that holds most of
its characters, to the earlier one on a tie.  A character whose bytes are split
over tokens counts as covered by each of them.  Every token goes to exactly one
section, so the counts of a document add up to its encoding.

The byte-level vocabulary (a ``.tiktoken`` file of ranks) is read once by the
driver and broadcast.

Edges: null fields count as empty; an empty field still ends with its line break;
an empty text has one section without characters or tokens; repeated rows stay
rows; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-tokenization pattern of this byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Blanks that the pattern is not tried on together (any number gives the same tokens).
LONG_RUN = 10_000
_LONG_RUNS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)
#: Fields before the text, each ended by a line break.
FIELDS = ("source", "lang")


class Encoder:
    """Vocabulary with the byte length of each token."""

    def __init__(self, ranks: bytes):
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.length = np.zeros(max(table.values()) + 1, np.int64)
        for token, rank in table.items():
            self.length[rank] = len(token)

    def tokens(self, text: str) -> np.ndarray:
        """Token numbers of a text.

        The pattern's engine tries a run of blanks blank by blank and gives up on
        about a million.  The pattern parts such a run from what stands before it
        and cuts it before its last blank (or not, at the end of the text), so a
        long run is encoded as the one piece that it is, without the pattern.
        """
        if len(text) < LONG_RUN:
            return self._encode(text)
        parts, at = [], 0
        for run in _LONG_RUNS.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            parts += [self._encode(text[at:run.start()]), np.asarray(self.encoding._encode_single_piece(text[run.start():end]), np.int64)]
            at = end
        return np.concatenate([*parts, self._encode(text[at:])])

    def _encode(self, text: str) -> np.ndarray:
        return np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=()), np.int64)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and end character of each token."""
        raw = np.frombuffer(text.encode(), np.uint8)
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.cumsum(self.length[self.tokens(text)])
        starts = np.concatenate([[0], ends[:-1]])
        if len(raw) == len(text):
            return starts, ends
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        return char[starts], char[ends - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and how many of them cross a boundary.  ``bounds``:
    section ends, ascending; a section without characters holds no token."""
    first, last = np.searchsorted(bounds, starts, "right"), np.searchsorted(bounds, ends - 1, "right")
    home = first.copy()
    crossing = np.flatnonzero(first != last)
    begins, best = np.concatenate([[0], bounds]), np.zeros(len(crossing), np.int64)
    for k in range(int((last - first)[crossing].max(initial=-1)) + 1):  # at most a token's characters
        s = np.minimum(first[crossing] + k, last[crossing])
        overlap = np.minimum(bounds[s], ends[crossing]) - np.maximum(begins[s], starts[crossing])
        more = overlap > best
        home[crossing[more]], best[more] = s[more], overlap[more]
    return np.bincount(home, minlength=len(bounds)), np.bincount(home[crossing], minlength=len(bounds))


def _count(ranks, fields: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for batch in batches:
            heads = [[(x or "") + "\n" for x in batch.column(f).to_pylist()] for f in fields]
            ids, n = batch.column("doc_id"), len(fields)
            out: list[list] = [[] for _ in range(6)]
            for i, text in enumerate(pc.fill_null(batch.column("text"), "")):
                text = text.as_py()
                parts = [h[i] for h in heads]
                whole = "".join(parts) + text
                lines = [len(x) for x in text.split("\n")]
                sizes = np.array([*map(len, parts), *(x + 1 for x in lines[:-1]), lines[-1]], np.int64)
                if len(lines) > 1 and not lines[-1]:
                    sizes = sizes[:-1]  # the last line break ends a line, it doesn't start one
                bounds = np.cumsum(sizes)
                counts, crossing = attribute(*encoder.spans(whole), bounds)
                out[0].append(np.full(len(sizes), i))
                out[1].append(np.minimum(np.arange(len(sizes)), n))
                out[2].append(np.maximum(np.arange(len(sizes)) - n, 0))
                for column, x in zip(out[3:], (sizes, counts, crossing), strict=True):
                    column.append(x)
            if not out[0]:
                continue
            row, field, section, size, tokens, crossing = (np.concatenate(x) for x in out)
            names = pa.array([*fields, "text"]).take(pa.array(field))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), names, *(pa.array(x.astype(np.int64)) for x in (section, size, tokens, crossing))],
                                             ["doc_id", "field", "section", "n_chars", "n_tokens", "n_crossing"])
    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """doc_id, field, section (line number in the text, 0 for other fields),
    n_chars, n_tokens, n_crossing (tokens counted here that cross a boundary)."""
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())  # the size of one vocabulary file
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", *fields, "text").mapInArrow(
        _count(ranks, fields), f"doc_id {kind}, field string, section long, n_chars long, n_tokens long, n_crossing long")

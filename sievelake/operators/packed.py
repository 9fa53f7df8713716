"""Splitting fields that pack keys with several values into one text.

The field is read by a parsing expression grammar with ordered choice:

    field   <- junk? (key ':'? values)*
    values  <- (value? separator)* value?
    value   <- quoted / bracketed / bare
    quoted  <- open inner close &(blank* (separator / key / end))
    bare    <- (!separator !key char)+

An alternative that fails (a quote that never closes, or text right after the
closing quote) gives its input back and the next one is tried, so a malformed
quote becomes part of a bare value, which then carries an error flag.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the field format: quote pairs, and whether a doubled close stands for itself.
QUOTES = (("«", "»", False), ("“", "”", False), ('"', '"', True))
SEPARATORS = r"[;|•\t\n\r\x0b\x0c  ]|\s/(?=\s)|,(?!\s)"
#: Value kinds and error flags of the output.
QUOTED, BRACKETED, BARE = "quoted", "bracketed", "bare"
UNCLOSED, TRAILING = "unclosed_quote", "text_after_quote"


@dataclass
class PackedGrammar:
    """Compiled grammar. ``brackets`` lists pairs that shield separators, none by default."""

    keys: Sequence[str]
    brackets: Sequence[tuple[str, str]] = ()
    _key: re.Pattern = field(init=False)

    def __post_init__(self) -> None:
        names = sorted({k for k in self.keys if k}, key=lambda k: (-len(k), k))
        alt = "|".join(map(re.escape, names)) or r"(?!)"
        key = rf"(?:{alt})(?=[\s:;|]|\Z)"
        self._key = re.compile(rf"({alt})(?=[\s:;|]|\Z):?")
        self._gap = re.compile(r"\s+")
        self._sep = re.compile(SEPARATORS)
        self._bare = re.compile(rf"(?s:.+?)(?={SEPARATORS}|\s{key}|\Z)")
        self._end = re.compile(rf"\s*(?:{SEPARATORS}|\Z)|\s+{key}")
        self._runs = {b: re.compile(f"{re.escape(b)}+") for _, b, twice in QUOTES if twice}

    def _at_key(self, text: str, at: int) -> re.Match | None:
        if at and not (text[at - 1].isspace() or text[at - 1] in ";|"):
            return None
        return self._key.match(text, at)

    def _close(self, text: str, at: int, sign: str, twice: bool, seen: dict) -> int:
        """Where the quote opened at ``at`` closes, or -1. ``seen`` holds what is known of the text, so that no stretch of it is searched for each opening sign."""
        if not twice:
            if seen.get(sign, len(text)) <= at:  # no closing sign from there on
                return -1
            found = text.find(sign, at + 1)
            if found < 0:
                seen[sign] = at
            return found
        # doubled signs stand for themselves, so a quote closes at the end of the next run that is odd, its own opening sign left out
        if sign not in seen:
            seen[sign] = [m.span() for m in self._runs[sign].finditer(text)]
            seen[sign, "odd"] = [e - 1 for s, e in seen[sign] if (e - s) % 2]
            seen[sign, "ends"] = [e for _, e in seen[sign]]
        end = seen[sign, "ends"][bisect_right(seen[sign, "ends"], at)]
        if (end - at - 1) % 2:
            return end - 1
        odd = seen[sign, "odd"]
        k = bisect_left(odd, end)
        return odd[k] if k < len(odd) else -1

    def _quote(self, text: str, at: int, seen: dict) -> tuple[str, int, str]:
        """(value, end, flag); end -1 where the alternative fails."""
        for a, b, twice in QUOTES:
            if text[at] == a:
                close = self._close(text, at, b, twice, seen)
                if close < 0:
                    return "", -1, UNCLOSED
                if not self._end.match(text, close + 1):
                    return "", -1, TRAILING
                value = text[at + 1 : close]
                return (value.replace(b + b, b) if twice else value), close + 1, ""
        return "", -1, ""

    def _bracket(self, text: str, at: int, seen: dict) -> tuple[str, int]:
        for a, b in self.brackets:
            if text[at] == a:
                if (a, b) not in seen:
                    pairs, stack = seen.setdefault((a, b), {}), []
                    for m in re.finditer(f"[{re.escape(a)}{re.escape(b)}]", text):
                        if m[0] == a:
                            stack.append(m.start())
                        elif stack:
                            pairs[stack.pop()] = m.start()
                close = seen[a, b].get(at, -1)
                return (text[at + 1 : close], close + 1) if close >= 0 and self._end.match(text, close + 1) else ("", -1)
        return "", -1

    def parse(self, text: str | None) -> list[tuple[str, str, str, str]]:
        """(key, value, kind, error flag) of each value, in the field's order."""
        if not text:
            return []
        seen: dict = {}
        out, at, end, key = [], 0, len(text), ""  # what comes before the first key has no key and is dropped
        while at < end:
            if gap := self._gap.match(text, at):
                at = gap.end()
                # a slash between blanks is a separator whose first blank was just read
                if at < end and text[at] == "/" and (at + 1 == end or text[at + 1].isspace()):
                    at += 1
                    continue
                if at >= end:
                    break
            if m := self._at_key(text, at):
                key, at = m[1], m.end()
                continue
            if m := self._sep.match(text, at):
                at = m.end()
                continue
            value, stop, flag = self._quote(text, at, seen)
            kind = QUOTED
            if stop < 0 and self.brackets:
                value, stop = self._bracket(text, at, seen)
                kind = BRACKETED
            if stop < 0:
                m = self._bare.match(text, at)
                value, stop, kind = m[0], m.end(), BARE
            at = stop
            value = value.strip()
            if value and key:
                out.append((key, value, kind, flag if kind == BARE else ""))
        return out


def split_packed(
    df: DataFrame, packed: str, carry: Sequence[str], grammar: PackedGrammar, *, names: Sequence[str] = ("pos", "param_key", "param_value", "value_kind", "value_error")
) -> DataFrame:
    """One row per value of ``packed``: the columns ``carry``, then position (from 1), key, value, kind, flag.

    Null, empty and blank fields, and fields without a key, give no rows; so does an empty table. Repeated
    rows are split each on their own. Names of ``names`` may not occur in ``carry``. No shuffle: rows
    are parsed where they are read, in Arrow batches, and only ``carry`` and ``packed`` are read.
    """
    clash = set(carry) & set(names)
    if clash:
        raise ValueError(f"output names clash with carried columns: {sorted(clash)}")
    kept = df.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{packed}`").alias("__packed")).where(F.length(F.trim("__packed")) > 0)
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
    schema = ", ".join([*types, f"`{names[0]}` int", *(f"`{n}` string" for n in names[1:])])
    carried = list(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list] = {}
        for batch in batches:
            rows, cols = [], ([], [], [], [], [])
            for i, text in enumerate(batch.column(len(carried)).to_pylist()):
                values = memo.get(text)
                if values is None:
                    values = grammar.parse(text)
                    if len(memo) >= 20_000:  # bounds the worker's memory, not the result
                        memo.clear()
                    memo[text] = values
                for pos, (k, v, kind, flag) in enumerate(values, 1):
                    rows.append(i)
                    for column, x in zip(cols, (pos, k, v, kind, flag)):
                        column.append(x)
            take = pa.array(rows, pa.int64())
            arrays = [batch.column(j).take(take) for j in range(len(carried))]
            arrays += [pa.array(cols[0], pa.int32()), *(pa.array(c, pa.string()) for c in cols[1:])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*carried, *names])

    return kept.mapInArrow(run, schema)

"""Splitting oversized texts at natural boundaries, with overlap.

Balanced targets: the fewest pieces that can hold the text are planned as equally long ones, each planned end is snapped to
the strongest boundary near it, and the plan gets one more piece whenever a limit fails. Where no plan of that kind fits
(long stretches without white space) the text is placed piece by piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundaries, strongest first; a cut is made where the match ends.
BOUNDARIES = (
    ("paragraph", re.compile(r"\r?\n[^\S\n]*\r?\n\s*|\x0c\s*")),
    ("line", re.compile(r"\s*[\r\n  ]\s*")),
    ("sentence", re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？]\s*")),
    ("clause", re.compile(r"[;:,–—][\"'”’»)\]]*\s+")),
    ("word", re.compile(r"\s+")),
)
SPACE = re.compile(r"\s")
#: A cut is made after white space or after a stop of scripts that set none.
BREAK = re.compile(r"[\s。！？]")

Piece = tuple[int, int, str]


def _snap(text: str, target: int, low: int, high: int) -> tuple[int, str] | None:
    """The strongest boundary in [low, high], the nearest to the target among equals, the earlier one of a tie."""
    if low > high:
        return None
    # a match may begin before the window: sentence marks and white space before the cut
    begin = max(0, low - 8)
    part = text[begin:high]
    for name, pattern in BOUNDARIES:
        best = None
        for m in pattern.finditer(part):
            at = begin + m.end()
            if low <= at <= high and at < len(text) and BREAK.match(text[at - 1]) and (best is None or abs(at - target) < abs(best - target)):
                best = at
        if best is not None:
            return best, name
    return None


def _planned(text: str, limit: int, overlap: int, pieces: int, reach: int) -> list[Piece] | None:
    """The text in so many pieces with equal targets, None if a limit fails."""
    n, stride = len(text), (len(text) - overlap) / pieces
    out: list[Piece] = []
    start, end = 0, 0
    for i in range(pieces - 1):
        target = round(overlap + (i + 1) * stride)
        high = min(start + limit, target + reach)
        low = max(end + 1, overlap + 1, target - reach)
        found = _snap(text, min(target, high), low, high)
        if found is None:
            return None
        end, kind = found
        out.append((start, end, kind))
        start = end - overlap
    if n - start > limit or end >= n:
        return None
    out.append((start, n, "end"))
    return out


def _piecewise(text: str, limit: int, overlap: int, reach: int) -> list[Piece]:
    """Balanced anew after every piece; shortens an overlap rather than cut inside a word, cuts inside one if it must."""
    n, out, start, end = len(text), [], 0, 0
    while n - start > limit:
        left = n - start
        pieces = -(-(left - overlap) // (limit - overlap))
        target = start + overlap + round((left - overlap) / pieces)
        high = start + limit
        floor = max(end + 1, overlap + 1)
        found = _snap(text, min(target, high), max(floor, target - reach), min(high, target + reach)) or _snap(text, high, floor, high)
        if found is None and SPACE.match(text[high]):
            found = high, "word"  # just before white space
        if found is None and end > 0:
            # no white space up to the limit: give up a part of the overlap
            m = BREAK.search(text, high, min(n, end + limit + 1))
            if m:
                cut = min(m.end(), end + limit)
                start = max(start, cut - limit)
                if cut >= n:
                    break
                found = cut, "word"
            elif n - end <= limit:
                start = n - limit
                break
        if found is None and end == 0:
            found = _snap(text, overlap, 1, overlap)  # a short first piece rather than a cut inside a word
        cut, kind = found or (high, "forced")
        out.append((start, cut, kind))
        start, end = max(cut - overlap, start + 1), cut
    out.append((start, n, "end"))
    return out


def split_text(text: str, limit: int = 2000, overlap: int = 200, reach: int = 250) -> list[Piece]:
    """Pieces as (start, end, boundary at the end), in characters; they cover the text, none is longer than limit.

    Each piece begins `overlap` characters before the end of the piece before; the overlap is shorter only where it would
    force a cut inside a word. A text up to the limit is one piece. `reach` is how far an end may move from its target. One
    piece more is planned whenever a limit fails, up to the number at which two neighbouring targets and both reaches fit
    into a piece: from there on only a stretch without any boundary of two reaches or more can make a plan fail, which more
    pieces don't mend, and the text is placed piece by piece. boundary is one of paragraph, line, sentence, clause, word,
    forced (inside a stretch without a boundary longer than the limit), end.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    if len(text) <= limit:
        return [(0, len(text), "end")]
    fewest = -(-(len(text) - overlap) // (limit - overlap))
    most = -(-(len(text) - overlap) // max(1, limit - overlap - 2 * reach))
    for pieces in range(fewest, max(fewest, most) + 1):
        found = _planned(text, limit, overlap, pieces, reach)
        if found:
            return found
    return _piecewise(text, limit, overlap, reach)


PIECE = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("overlap", pa.int32()), ("boundary", pa.string())]))


def split_oversized(df: DataFrame, text: str, keys: list[str], limit: int = 2000, overlap: int = 200, with_text: bool = True) -> DataFrame:
    """The pieces of every text longer than limit: keys, piece (from 1), start, end (0-based, in characters), overlap (with
    the piece before), boundary and piece_text (if with_text).

    Texts up to the limit, empty texts and NULL are not oversized and give no row. Rows are independent: repeated rows come
    out repeatedly, and nothing is shuffled.
    """
    # one string column besides the keys goes to Python; pieces come back as offsets
    big = df.where(F.length(text) > limit).select(*keys, F.col(text).alias("__text"))
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in big.schema.fields), "__pieces array<struct<piece:int,start:int,end:int,overlap:int,boundary:string>>"])
    names = [*big.columns, "__pieces"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(len(keys)).to_pylist():
                before, rows = 0, []
                for i, (s, e, kind) in enumerate(split_text(t, limit, overlap)):
                    rows.append({"piece": i + 1, "start": s, "end": e, "overlap": before - s if i else 0, "boundary": kind})
                    before = e
                out.append(rows)
            own = b.columns if with_text else [*b.columns[:-1], pa.nulls(b.num_rows, pa.string())]
            yield pa.RecordBatch.from_arrays([*own, pa.array(out, PIECE)], names)

    flat = big.mapInArrow(cut, ddl).select(*keys, "__text", F.inline("__pieces"))
    if not with_text:
        return flat.drop("__text")
    return flat.withColumn("piece_text", F.expr("substring(__text, start + 1, end - start)")).drop("__text")

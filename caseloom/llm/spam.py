"""Pages of repeated keywords, link lists and product tags instead of sentences.

A text is read in segments (lines, and within lines sentences). Each segment is held against the signs of such pages: links
by its words, separators between short items, prices and item codes, repetition of the same content words and word pairs,
and missing function words. Sound sentences are held against the whole text: lines that come again and again, and pairs of
content words or single ones that make up an unusual share of it.

A first step measures every text; what the measures mean is calibrated per language in a second, from all documents: the
function words that its sentences usually have, the words that usually stand between separators and in a sentence, the shares
that a text's most frequent line, pair and word usually have. Limits follow these within bounds, so that a language whose
documents are mostly such pages doesn't count them as usual. A document is spam when more than half of its characters lie in
such segments.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import cut_lineage
from .lang import FUNCTION, GRAMMAR, LANGUAGES_OF, SCRIPTS, SPACELESS, script

#: A line, pair or word that comes less often than this in a text is no repetition.
AGAIN = 3
#: The share of a text from which its words and pairs are looked at as repeated inside a segment.
HOT = 0.015
#: Limits per language: (least, times what is usual, most). Of the documents of a language nine in ten stay within what is
#: usual for shares, half of them for the others.
LIMITS = {
    "grammar": (0.04, 0.4, 0.2),  # share of function words below which a segment lacks them
    "items": (4.0, 0.5, 6.0),  # words an item, up to which separators make a list
    "links": (10.0, 0.8, 16.0),  # words a link, up to which links make a list
    "hot": (HOT, 1.0, 0.025),  # share of a text that a pair repeated inside a segment has
    "pair": (0.1, 5.0, 0.15),  # share of a text that a pair of its sound sentences has
    "word": (0.12, 4.0, 0.2),  # the same of a word
}
#: Lines: (least, most), in between as far as usual lines are repeated.
LINE = (0.5, 0.8)
USUAL = {"grammar": 0.5, "items": 0.5, "links": 0.5, "hot": 0.9, "line": 0.9, "pair": 0.9, "word": 0.9}
#: What a language without enough documents or function words counts as usual.
DEFAULT = {"grammar": 0.3, "items": 10.0, "links": 17.5, "hot": 0.0, "line": 0.0, "pair": 0.0, "word": 0.0}

LINK = re.compile(r"(?:https?://|www\.)[^\s)\]>]+|(?<![@\w])[\w-]+(?:\.[\w-]+)+/[^\s)\]>]*|<a\b[^>]*>|(?<=\]\()[^)\s]+\)")
SENTENCE = re.compile(r"(?<=[.!?])[\"'”’»)\]]*\s+(?=[^a-zß-öø-ÿ\s])|(?<=[。！？])")
TOKEN = re.compile(r"[぀-ヿ一-鿿]|[^\W\d_]+(?:[’'][^\W\d_]+)?")
END = re.compile(r"[.!?。！？][\"'”’»)\]]*(?:\s*\[\d+\])*\s*$")
STRONG = re.compile(r"\s[|·•»>›→]\s|(?<=\S)\s?[|•·»]\s?(?=\S)")
WEAK = re.compile(r"\s*[,;+/]\s+|\s+[-–—+*~=]+\s+|\s*\|\s*|[，、；]")
TAG = re.compile(r"#[^\W\d_]\w*|#\d+[^\W\d_]\w*")
PRICE = re.compile(r"(?:\b(?:EUR|USD|GBP|CHF|SEK|JPY|CAD|AUD)|[€$£¥])\s?\d[\d.,]*|\d[\d.,]*\s?(?:€|\$|£|EUR|USD|GBP|CHF|SEK)(?!\w)")
CODE = re.compile(r"\b(?=[\w./-]*\d)(?:[A-Za-z]{1,5}[-./]?\d{2,}[\w./-]*|\d{2,}[-./][A-Z]\w*)\b")
ROW = re.compile(r"^\s*\|.*\|\s*$")
MAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
#: A line of a form: what stands there, then its value.
LABEL = re.compile(r"^\W*\w[\w .]{0,30}:\**\s")


_STOP = frozenset().union(*GRAMMAR.values()) | frozenset("of for in de du des d’ à pour von für para en".split())


#: Words inside search phrases: "modelo de contrato" counts as the pair (modelo, contrato).
_INNER = frozenset("of for in de du des d’ à del von für".split())


_SKIP: dict[str | None, frozenset[str]] = {k: _STOP | v for k, v in FUNCTION.items()}
_SKIP[None] = _SKIP["en"]
for _lang, _ in SCRIPTS:
    _SKIP.setdefault(_lang, _STOP)


def _runs(words: list[str], width: int) -> Iterator[tuple[str, ...]]:
    return zip(words, words[1:]) if width == 2 else zip(*(words[i:] for i in range(width)))


def _hot(words: list[str], counts: Counter, width: int) -> dict[tuple[str, ...], int]:
    """Pairs of content words (or as many characters) that make up an unusual share of a text, with their number."""
    least = max(3, HOT * len(words))
    often = {w for w, c in counts.items() if c >= least and w not in _STOP}
    if len(often) < 2:
        return {(w,) * width: counts[w] for w in often}
    pairs = Counter(p for p in _runs(words, width) if often.issuperset(p))
    return {p: c for p, c in pairs.items() if c >= least}


def segments(text: str) -> list[str]:
    """Lines, and the sentences of lines that hold several."""
    return [x for line in text.splitlines() if line.strip() for x in SENTENCE.split(line) if x.strip()]


Found = tuple[float, float, float, float, int]
SOUND = (-1.0, 0.0, 0.0, 1.0)


def profile(text: str | None) -> tuple:
    """Of a text: language, characters in segments; segments that may be spam with their measures (share of function words,
    words an item, words a link, share of the repeated pair; a measure that doesn't matter passes every limit); sound
    sentences by the shares of their line, pair and word; the text's own usual measures (function words of its sentences,
    words an item, words a sentence, shares of the most frequent line, pair and word)."""
    if not text or not text.strip():
        return None, 0, [], [], None, None, None, 0.0, 0.0, 0.0
    parts = segments(text)
    raw_of = [TOKEN.findall(MAIL.sub(" ", p) if "@" in p else LINK.sub(" ", p) if "/" in p or "www." in p else p) for p in parts]
    words_of = [" ".join(ws).lower().split(" ") if ws else [] for ws in raw_of]
    everything = [w for ws in words_of for w in ws]
    counts = Counter(everything)
    lang = _language(counts, text)
    own = FUNCTION.get(lang or "en", frozenset())
    # a pair of words is about four characters where these count as words, function words are rarer among them
    width, dense = (4, 16) if lang in SPACELESS else (2, 8)
    hot = _hot([w for w in everything if w not in _INNER], counts, width)
    lines = Counter(p.strip().lower() for p in parts)
    # pairs inside a segment; a pair of the same word twice is none
    skip = _SKIP[lang]
    pair_of = [{x for x in _runs([w for w in ws if w not in skip], width) if x[0] != x[1]} for ws in words_of]
    pairs = Counter(x for own_pairs in pair_of for x in own_pairs)
    size_of_text = max(1, len(everything))
    top_line, top_pair = max(lines.values(), default=0), max(pairs.values(), default=0)
    top_word = next((c for w, c in counts.most_common() if w not in skip), 0)
    # what no limit can reach isn't looked up
    big = [c >= AGAIN and c > least * n for c, least, n in ((top_line, LINE[0], len(parts)), (top_pair, LIMITS["pair"][0], size_of_text), (top_word, LIMITS["word"][0], size_of_text))]
    maybe: Counter[tuple[float, float, float, float]] = Counter()
    repeats: Counter[tuple[float, float, float]] = Counter()
    total = 0
    shares, items_of, lengths = [], [], []
    for p, raw, ws, own_pairs in zip(parts, raw_of, words_of, pair_of):
        size, n = len(p), len(ws)
        total += size
        grams = sum(w in own for w in ws)
        linked = "/" in p or "www." in p
        ended = p[-1:] in ".!?。！？" or END.search(p) is not None
        inner = [w for w in ws if w not in _INNER] if hot else []
        repeated = [x for x in _runs(inner, width) if x in hot]
        if repeated:
            # the same content pair twice in a sentence, or such pairs nearly all of it
            again = len(repeated) - len(set(repeated))
            cover = min(1.0, 2 * len(repeated) / len(inner))
            if again and cover >= 0.25 or cover >= 0.6 and (not ended or not grams) and not LABEL.match(p):
                maybe[(-1.0, 0.0, 0.0, max(hot[x] for x in repeated) / size_of_text)] += size
                continue
        if ended and grams >= 2 and n >= 6 and not linked and grams * dense >= n:
            shares.append(grams / n)
            lengths.append(n)
            items_of.append(n / (1 + sum(map(p.count, (", ", "; ", "，", "、")))))
            if any(big):
                c = lines[p.strip().lower()] if big[0] else 0
                k = max((pairs[x] for x in own_pairs), default=0) if big[1] else 0
                m = max((counts[w] for w in ws if w not in skip), default=0) if big[2] else 0
                found = tuple(x / y if x >= AGAIN else 0.0 for x, y in ((c, len(parts)), (k, size_of_text), (m, size_of_text)))
                if any(found) and not LABEL.match(p):
                    repeats[found] += size
            continue
        if linked and (links := LINK.findall(p)):
            rest = size - sum(map(len, links))
            if not (ended and grams >= 2) and (rest <= 120 or len(links) >= 3):
                per = n / len(links)
                if per <= LIMITS["links"][2]:
                    maybe[(-1.0, 0.0, per, 1.0)] += size
                    continue
        if "#" in p and (tags := TAG.findall(p)) and len(tags) * 2 >= len(p.split()) and (len(tags) >= 3 or sum(map(len, tags)) * 4 >= 3 * size):
            maybe[SOUND] += size
            continue
        digits = sum(map(str.isdigit, p))
        if digits and ROW.match(p):
            continue  # a table's row
        if digits and grams <= 1 and PRICE.search(p) and CODE.search(p) and not (ended and n > 12 and grams):
            maybe[SOUND] += size
            continue
        if not n or digits * 5 >= size:
            continue
        strong = STRONG.split(p)
        most = LIMITS["items"][2]
        if len(strong) >= 4 and n <= most * len(strong):
            maybe[(-1.0, n / len(strong), 0.0, 1.0)] += size
            continue
        items = WEAK.split(p)
        lower = sum(w == w.lower() or len(w) > 3 and w.isupper() for w in raw) / n
        listed = len(items) >= 4 and n <= most * len(items)
        if digits and not listed and LABEL.match(p):
            continue  # a line of a form
        if lower >= 0.6 and (not ended or n <= 6 and not grams) or repeated and cover >= 0.3:
            # words without the end of a sentence: spam if they lack function words
            maybe[(grams / n, 0.0, 0.0, 1.0)] += size
        elif listed and (lower >= 0.6 or not ended):
            maybe[(grams / n, n / len(items), 0.0, 1.0)] += size
    mean = lambda x: sum(x) / len(x) if x else None
    usual = [c / n if c >= AGAIN else 0.0 for c, n in ((top_line, max(1, len(parts))), (top_pair, size_of_text), (top_word, size_of_text))]
    return lang, total, [(*k, v) for k, v in maybe.items()], [(*k, v) for k, v in repeats.items()], mean(shares), mean(items_of), mean(lengths), *usual


def _language(counts: Counter, text: str) -> str | None:
    """The language by all short words of a text, or by its script."""
    if not text.isascii():
        name = script(text)
        if name:
            return name
    found: dict[str, int] = {}
    for w, c in counts.items():
        for lang in LANGUAGES_OF.get(w, ()):
            found[lang] = found.get(lang, 0) + c
    return max(found, key=lambda x: (found[x], x in GRAMMAR, x)) if found else None


MAYBE = ("grammar", "items", "links", "pair")
REPEATS = ("line", "pair", "word")
OWN = ("grammar", "items", "links", "line", "pair", "word")
_struct = lambda names: "array<struct<" + ",".join(f"{n}:double" for n in names) + ",size:int>>"
SCHEMA = f"lang string, total int, maybe {_struct(MAYBE)}, repeats {_struct(REPEATS)}, " + ", ".join(f"own_{n} double" for n in OWN)


def _limit(name: str) -> Column:
    """The limit of a measure in the row's language: times what is usual there, within bounds."""
    low, times, high = LIMITS[name]
    usual = "pair" if name == "hot" else name
    return F.least(F.lit(high), F.greatest(F.lit(low), times * F.coalesce(f"usual_{usual}", F.lit(DEFAULT[name]))))


def spam_scores(documents: DataFrame, key: str, text: str) -> DataFrame:
    """key, language, spam_share: the share of each text's characters that lie in keyword, link or product segments.

    NULL, empty and blank texts have the share 0. A repeated row comes out repeatedly. In a language without a list of
    function words only the other signs count.
    """
    kind = documents.schema[key].dataType.simpleString()
    names = [key, *(c.split(" ")[0] for c in SCHEMA.split(", "))]
    kinds = [pa.string(), pa.int32(), *[pa.list_(pa.struct([*((n, pa.float64()) for n in x), ("size", pa.int32())])) for x in (MAYBE, REPEATS)], *[pa.float64()] * len(OWN)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [list(c) for c in zip(*[profile(t) for t in b.column(1).to_pylist()])] or [[] for _ in kinds]
            for i, x in ((2, MAYBE), (3, REPEATS)):
                cols[i] = [[dict(zip((*x, "size"), f)) for f in r] for r in cols[i]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    seen = cut_lineage(documents.select(key, text).mapInArrow(read, f"`{key}` {kind}, {SCHEMA}"))
    # a row per language: a handful, whatever the size of the corpus
    usual = seen.where("lang is not null and own_grammar is not null").groupBy("lang").agg(*[F.percentile_approx(f"own_{n}", USUAL[n], 1000).alias(f"usual_{n}") for n in OWN])
    both = seen.join(F.broadcast(usual), "lang", "left")
    known = F.coalesce("lang", F.lit("en")).isin(*FUNCTION)
    limit = {n: _limit(n) for n in LIMITS}
    lacks = lambda x: (x["grammar"] < 0) | known & (x["grammar"] < limit["grammar"])
    listed = F.aggregate("maybe", F.lit(0), lambda a, x: a + F.when(lacks(x) & (x["items"] <= limit["items"]) & (x["links"] <= limit["links"]) & (x["pair"] >= limit["hot"]), x["size"]).otherwise(0))
    # where repetition is usual, it takes more
    line = F.least(F.lit(LINE[1]), F.lit(LINE[0]) + (1 - LINE[0]) * F.coalesce("usual_line", F.lit(0.0)))
    again = F.aggregate("repeats", F.lit(0), lambda a, x: a + F.when((x["line"] > line) | (x["pair"] > limit["pair"]) | (x["word"] > limit["word"]), x["size"]).otherwise(0))
    share = F.when(F.col("total") > 0, (listed + again) / F.col("total")).otherwise(F.lit(0.0))
    return both.select(key, F.col("lang").alias("language"), share.alias("spam_share"))

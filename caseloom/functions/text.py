"""Text functions as column expressions, and the few that need Arrow functions.

White space, word characters and word bounds are spelled out, since engines differ on what \\s, \\w and \\b mean beyond ASCII:
white space is Unicode's, word characters and bounds are ASCII, letters and digits are Unicode's.
NULL in gives NULL out, unless a docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
NOT_WS = WS.replace("[", "[^", 1)
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(s: Column | str) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(_c(s), rf"^{WS}+|{WS}+\z", "")


def collapse(s: Column | str) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return strip(F.regexp_replace(_c(s), rf"{WS}+", " "))


def escape_pattern(s: Column | str) -> Column:
    """The text as a pattern that matches itself."""
    return F.regexp_replace(_c(s), r"([.*+?^${}()|\[\]\\])", r"\\$1")


def normalize_words(s: Column | str) -> Column:
    """Letters, digits and single blanks in lower case; everything else dropped."""
    return F.lower(collapse(F.regexp_replace(_c(s), r"[^\p{L}\p{N}" + WS[1:-1] + "]", "")))


def normalize_label(s: Column | str) -> Column:
    """Lower case without closing marks and quotes around; blanks before a closing mark stay."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(s)), "[.!?\"'`*]+\\z", ""), "^[\"'`*]+", "")


def normalize_answer(s: Column | str) -> Column:
    """Lower case without ASCII punctuation and English articles, single blanks."""
    bare = F.regexp_replace(F.lower(_c(s)), PUNCTUATION, "")
    return collapse(F.regexp_replace(bare, r"(?<![A-Za-z0-9_])(?:a|an|the)(?![A-Za-z0-9_])", " "))


def extract_choice(output: Column | str, choices: Column | str) -> Column:
    """The label that an output chooses: the whole output, else its first line, else the only label that occurs in it as a
    word (in any case); NULL if there is none or several. A label that is listed twice is never the only one."""
    text, labels = normalize_label(output), F.transform(_c(choices), normalize_label)
    first = normalize_label(F.get(F.split(_c(output), "\n"), 0))
    word = F.lit("(?i)(?<![A-Za-z0-9_])")
    found = F.filter(labels, lambda x: F.rlike(_c(output), F.concat(word, escape_pattern(x), F.lit("(?![A-Za-z0-9_])"))))
    return F.when(F.array_contains(labels, text), text).when(F.array_contains(labels, first), first).when(F.size(found) == 1, F.get(found, 0))


def sentences(s: Column | str) -> Column:
    """Sentences: cut at white space after . ! ? before a capital, a digit, a quote or an opening bracket."""
    parts = F.split(_c(s), rf"(?<=[.!?]){WS}+(?=[A-Z0-9\"'(\[])")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def _numbers(s: Column | str, n: Column | str, pattern: str) -> Column:
    found = F.transform(F.regexp_extract_all(_c(s), F.lit(pattern), F.lit(1)), lambda x: x.try_cast("bigint") - 1)
    return F.array_distinct(F.filter(found, lambda i: (i >= 0) & (i < _c(n))))


def citations(s: Column | str, n: Column | str) -> Column:
    """0-based passages cited as [k, in order, each once, those of the n that exist; the closing bracket isn't needed."""
    return _numbers(s, n, r"\[([0-9]+)")


def citations_closed(s: Column | str, n: Column | str) -> Column:
    """As `citations`, but only [k] with its closing bracket counts."""
    return _numbers(s, n, r"\[([0-9]+)\]")


def remove_citations(s: Column | str) -> Column:
    return collapse(F.regexp_replace(_c(s), rf"{WS}*\[[0-9]+\]", ""))


def passages_text(docs: Column, refs: Column) -> Column:
    """The passages at the 0-based places, each under its title."""
    return F.array_join(F.transform(refs, lambda i: F.concat(F.lit("Title: "), F.coalesce(F.get(docs, i.cast("int")).getField("title"), F.lit("")), F.lit("\n"), F.coalesce(F.get(docs, i.cast("int")).getField("text"), F.lit("")))), "\n")


def format_docs(docs: Column) -> Column:
    """Numbered passages, one a line."""
    return F.array_join(
        F.transform(docs, lambda d, i: F.concat(F.lit("Document ["), (i + 1).cast("string"), F.lit("](Title: "), F.coalesce(d.getField("title"), F.lit("")), F.lit("): "), F.coalesce(d.getField("text"), F.lit("")))),
        "\n",
    )


def flexible_pattern(span: Column | str) -> Column:
    """A span as a pattern in which any white space matches any."""
    return F.regexp_replace(escape_pattern(strip(span)), rf"{WS}+", WS.replace("\\", r"\\") + "+")


def contains_span(text: Column | str, span: Column | str) -> Column:
    """Whether a span occurs in any case, with any white space, not inside a run of letters and digits. An empty span occurs
    nowhere."""
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])"), flexible_pattern(span), F.lit(r"(?![\p{L}\p{N}])"))
    return F.when(strip(span) == "", F.lit(False)).otherwise(F.rlike(_c(text), pattern))


def tokens(s: Column | str) -> Column:
    """Runs of at least three letters or digits, lower case."""
    return F.regexp_extract_all(F.lower(_c(s)), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0))


def strip_reasoning(s: Column | str) -> Column:
    return strip(F.regexp_replace(_c(s), r"(?s)<think>.*?</think>", ""))


def says_yes(s: Column | str) -> Column:
    return F.rlike(_c(s), F.lit(rf"(?i)^{WS}*yes(?![A-Za-z0-9_])"))


def verdict_word(s: Column | str) -> Column:
    """The first of yes, keep, no in a reply; no if there is none."""
    found = F.lower(F.regexp_extract(_c(s), r"(?i)(?<![A-Za-z0-9_])(yes|keep|no)(?![A-Za-z0-9_])", 1))
    return F.when(found == "", F.lit("no")).otherwise(found)


def clause_type(s: Column | str) -> Column:
    found = F.regexp_extract(_c(s), 'contain a "([^"]+)" clause', 1)
    return F.when(found == "", F.lit("such")).otherwise(found)


# fixed values: the patterns of personal data, in the order in which they are applied
PII = (
    ("email", r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+"),
    ("phone", r"\+?[0-9][0-9 .-]{7,}[0-9]"),
    ("ipv4", r"(?<![A-Za-z0-9_])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9_])"),
    ("ipv6", r"(?i)(?<![A-Za-z0-9_])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![A-Za-z0-9_])"),
)
MARK = "[REDACTED]"


def scrub(s: Column | str, patterns: tuple[tuple[str, str], ...] = PII) -> Column:
    out = _c(s)
    for _, p in patterns:
        out = F.regexp_replace(out, p, MARK)
    return out


def scrub_findings(s: Column | str, patterns: tuple[tuple[str, str], ...] = PII) -> Column:
    """What `scrub` replaces, as label:match, pattern by pattern on the text that the patterns before left."""
    def named(label: str, matches: Column) -> Column:
        return F.transform(matches, lambda m: F.concat(F.lit(label + ":"), m))

    text, found = _c(s), []
    for label, p in patterns:
        found.append(named(label, F.regexp_extract_all(text, F.lit(p), F.lit(0))))
        text = F.regexp_replace(text, p, MARK)
    return F.concat(*found)


def scrub_items(s: Column | str, items: Column | str) -> Column:
    """Listed items replaced one after another, in any case, with any white space, also inside words; blank ones are none."""
    return F.aggregate(F.filter(_c(items), lambda i: strip(i) != ""), _c(s), lambda acc, i: F.regexp_replace(acc, F.concat(F.lit("(?i)"), flexible_pattern(i)), F.lit("[REDACTED]")))


def remove_spans(s: Column | str, spans: Column | str) -> Column:
    """Spans replaced by a blank one after another, literally; empty ones are none."""
    return F.aggregate(F.filter(_c(spans), lambda x: x != ""), _c(s), lambda acc, x: F.replace(acc, x, F.lit(" ")))


def bracketed_list(s: Column | str) -> Column:
    """The strings of the JSON array between the first [ and the last ]: trimmed, each once, of two characters at least;
    empty if there is no such array."""
    part = F.regexp_extract(_c(s), r"(?s)\[.*\]", 0)
    items = F.from_json(part, T.ArrayType(T.StringType()))
    good = F.filter(F.transform(items, strip), lambda x: x.isNotNull() & (F.length(x) >= 2))
    return F.array_distinct(F.coalesce(good, F.array().cast("array<string>")))


def quote_lines(s: Column | str) -> Column:
    """Lines of the form [k] "quote" as structs of the 0-based passage and the quote."""
    lines = F.filter(F.split(_c(s), "\n"), lambda x: x.rlike(rf"^{WS}*\[[0-9]+\]{WS}*\"?.+?\"?{WS}*\z"))
    pattern = rf"^{WS}*\[([0-9]+)\]{WS}*\"?(.+?)\"?{WS}*\z"
    return F.transform(lines, lambda x: F.struct((F.regexp_extract(x, pattern, 1).try_cast("bigint") - 1).alias("passage"), strip(F.regexp_extract(x, pattern, 2)).alias("text")))


def bare_lines(s: Column | str) -> Column:
    """Lines as quotes: without [k], bullet or number before and quotes around; blank lines and `none` are none."""
    bare = F.transform(F.split(_c(s), "\n"), lambda x: strip(F.regexp_replace(F.regexp_replace(x, rf"^{WS}*(?:\[[0-9]+\]|[-*•]|[0-9]+[.)])?{WS}*", ""), r'(?s)^"(.*)"\z', "$1")))
    return F.filter(bare, lambda x: (x != "") & ~x.rlike("(?i)^none(?![A-Za-z0-9_])"))


def insert_citations(claim: Column | str, cites: Column | str) -> Column:
    """The citations before the claim's final punctuation."""
    pattern = r"(?s)^(.*?)([.!?]*)\z"
    return F.concat(F.regexp_extract(_c(claim), pattern, 1), F.lit(" "), _c(cites), F.regexp_extract(_c(claim), pattern, 2))


def cite_marks(refs: Column | str) -> Column:
    return F.array_join(F.transform(_c(refs), lambda i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]"))), "")


def padded_id(prefix: Column | str, n: Column | str) -> Column:
    """prefix-007; numbers of more digits are not cut."""
    return F.format_string("%s-%03d", _c(prefix), _c(n))


def word_count(s: Column | str) -> Column:
    """Words between white space."""
    return F.regexp_count(_c(s), F.lit(f"{NOT_WS}+"))


def split_count(s: Column | str) -> Column:
    """Parts between white space, with the empty ones at the ends."""
    return F.size(F.split(_c(s), rf"{WS}+"))


def container_name(s: Column | str) -> Column:
    return F.regexp_replace(_c(s), "[^a-zA-Z0-9_.-]", "-")


def html_escape(s: Column | str) -> Column:
    out = _c(s)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def suite_of_case(s: Column | str) -> Column:
    """The case id without its number; ids that don't end in digits stay (use the case's own suite where there is one)."""
    return F.regexp_replace(_c(s), r"-[0-9]+\z", "")


def contains_normalized(text: Column | str, part: Column | str) -> Column:
    return F.contains(normalize_words(text), normalize_words(part))


@F.pandas_udf(T.IntegerType())
def _longest_run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for claims, texts in batches:
        yield pd.Series([longest_run_of(c, t) for c, t in zip(claims, texts)], dtype="Int32")


def longest_run_of(claim: str | None, text: str | None) -> int | None:
    """The most consecutive words of a normalized claim that stand in a normalized text, as a substring."""
    if claim is None or text is None:
        return None
    words = claim.split(" ")
    best = at = 0
    # a run that starts later can only win by being longer than the best so far
    while at + best < len(words):
        if " ".join(words[at : at + best + 1]) in text:
            best += 1
        else:
            at += 1
    return best


def longest_run(claim: Column | str, text: Column | str) -> Column:
    """Consecutive words of the claim that the text has, most; runs may begin or end inside a word of the text. An empty claim
    has a run of one (it stands in any text)."""
    return _longest_run(normalize_words(claim), normalize_words(text))


def has_run(claim: Column | str, text: Column | str, k: int) -> Column:
    """Whether k consecutive words of the claim stand in the text; stays in the JVM."""
    words = F.split(normalize_words(claim), " ")
    n = F.size(words) - k + 1
    runs = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))
    # the text is bound once: an expression inside a lambda would be worked out for every run
    inside = F.exists(F.array(normalize_words(text)), lambda t: F.exists(runs, lambda r: F.contains(t, r)))
    return F.when(n < 1, F.lit(False)).otherwise(inside)

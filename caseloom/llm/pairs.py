"""Broken prompt and response pairs, each with its defect.

Every response is looked at once beside its case: has it answer text of its own, does it give back the prompt, which language
are its own words in, does it end; and does it answer at all: does it cite, name a choice, rewrite its input or say that
something is missing from the material. The phrases of its opening (names and numbers masked) are clustered by MinHash over
five-word shingles, each link verified by the exact similarity.

Refusals are read off the clusters. A cluster is a template of refusals if it recurs over unrelated prompts (several
responses, cases and topics) whose responses don't answer and mostly have no content word of their own case. The wording of
the responses so revealed (their sequences of two and three words, against those of all other responses) is learned from the
corpus and reveals those whose own phrases came only once. Last, a response that stands alone counts if it denies something
in the first person outside quotations, names no number and has mostly other content words than its case: a minor sign that
never decides alone and never against a phrase that recurs in one topic with the words of its cases.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import cut_lineage
from .lang import LANGUAGES_OF, WORDS, evidence, language

SHINGLE, SIMILARITY, OPENING = 5, 0.8, 32
BANDS, ROWS = 8, 4

# what is no answer text
THINK = re.compile(r"<(think|thinking|reasoning|scratchpad)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
COMMENT = re.compile(r"<!--.*?-->", re.S)
TAG = re.compile(r"</?[A-Za-z][\w-]*(?:\s+[\w-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+))*\s*/?>")
FENCE = re.compile(r"^\s*(?:```|~~~)[\w-]*\s*$", re.M)
CITE = re.compile(r"\[\s*\d+(?:\s*[,;–-]\s*\d+)*\s*\]")
LEAD = re.compile(r"^\W*(?:final\s+)?(?:answer|label|response|result|output|réponse|antwort|respuesta|risposta)\s*(?:is)?\s*[:\-–]", re.I)
INVISIBLE = re.compile(r"[​-‏⁠﻿­᠎]")
# fixed values: words that stand for nothing
NOTHING = frozenset("none null nil n/a na nan undefined empty void tbd todo nothing blank missing -".split()) | {"no answer", "no response", "no output", "not applicable", "not available", "not provided", "no answer given", "(none)", "(empty)", "sans réponse", "aucune réponse", "keine antwort", "sin respuesta", "nichts", "néant", "nada", "rien"}

QUOTED = re.compile(r"\"[^\"\n]+\"|«[^»]+»|„[^“”\n]+[“”]|“[^”\n]+”|‘[^’\n]{12,}’")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
#: What may follow the end of an answer beside citations: closing marks, markup.
CLOSING = " \t\r\n\f\v\u00a0\u2028\u2029\u202f\u3000\"'”’»“)]}*_`>"
STOPS = ".!?。！？।؟"

# fixed values: first persons, words of denial, and what answers speak of; none of them decides alone
PERSON = frozenset("i we my our me us i'm i'd i'll i've we're we'd we've je j'ai mes nos moi m'est m'interdit m'appartient ich wir mir mich mein meine meinen meiner unser unsere yo me mi mis nosotros io mi noi eu nós minhas ik mijn wij".split())
DENIAL = frozenset("no not none cannot can't won't unable decline refuse abstain forbids prohibits nobody never ne pas refuse refuser décliner interdit impossible nicht kein keine keinen ablehnen lehne verweigere verweigern untersagt rechazar rechazo declinar niego prohibido non rifiuto rifiutare não recuso recusar niet geen weiger".split()) | {"can't", "don't", "won't"}
MATERIAL = re.compile(r"\b(?:claus|passage|pasaje|klausel|cláusula|provision|disposi|bestimmung|section|abschnitt|article|artikel|artículo|contract|contrat|vertrag|agreement|accord\b|acuerdo|document|dokument)", re.I)
LACKS = re.compile(r"\b(?:no|not|none|nothing|without|absent|lacks?|missing|aucune?|pas|absente?|kein|keine|keinen|nicht|fehlt|ningún|ninguna|falta)\b", re.I)
POLAR = frozenset("yes no oui non ja nein sí si sim não nee nej tak nie".split())
#: Content words that a response needs so that none of them being its case's tells something.
TELLING = 2
PLACE = re.compile(r"[\[<({][^\[\]<>(){}\n]{1,60}[\]>)}]|\*{2,}\w*|_{3,}\w*|█+|#{3,}|X{3,}\b")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower().replace("’", "'"))


def _values(value: object) -> list[str]:
    if isinstance(value, str):
        return [value]
    if isinstance(value, dict):
        return [x for v in value.values() for x in _values(v)]
    if isinstance(value, list):
        return [x for v in value for x in _values(v)]
    return []


def answer_text(output: str) -> tuple[str, bool]:
    """The answer's own text, without hidden reasoning, markup and the shell of JSON; and whether it was complete JSON."""
    text = INVISIBLE.sub("", output)
    if "<" in text:
        text = TAG.sub(" ", COMMENT.sub(" ", THINK.sub(" ", text)))
    if "```" in text or "~~~" in text:
        text = FENCE.sub("", text)
    text = text.strip()
    if text[:1] in '{["':
        try:
            value = json.loads(text)
        except ValueError:
            return text, False
        if isinstance(value, (dict, list, str)):
            return "\n".join(_values(value)).strip(), True
    return text, False


def is_empty(text: str) -> bool:
    """Whether an answer's text says nothing: only citations, marks, an announcement of an answer or a word for nothing."""
    bare = CITE.sub(" ", text).strip()
    bare = LEAD.sub("", bare).strip()
    if not any(c.isalnum() for c in bare):
        return True
    bare = bare.strip(" \t\r\n.!,;:\"'`*_()[]{}<>-–—").lower()
    return bare in NOTHING or re.fullmatch(r"(?:answer|label|response|réponse|antwort|respuesta)", bare) is not None


def before_trail(text: str) -> str:
    """A text without the closing marks and citations at its end."""
    while True:
        bare = text.rstrip(CLOSING)
        tail = text[len(bare) :]
        at = bare.rfind("[") if "]" in tail else -1
        if at >= 0 and CITE.fullmatch(bare[at:] + "]"):
            text = bare[:at]
            continue
        return bare


def ends(text: str) -> bool:
    """Whether a text breaks off nowhere: it ends with a stop, closing marks or a citation, not with an ellipsis."""
    if re.fullmatch(r"\s*(?:\d+[.)]|[-*•–])\s*", text.rsplit("\n", 1)[-1]):
        return False  # an item of a list that was only begun
    few = text.split()
    if len(few) <= 2 and text[-1:].isalnum() and evidence(few[0]).keys() <= {"la"} | ({*WORDS} if len(few) == 1 else set()):
        return True  # a bare label; two words that begin like a sentence are none
    bare = before_trail(text)
    if not bare:
        return True
    tail = text[len(bare) :]
    if bare.endswith(("...", "…")):
        # a shortened quotation closes its quote
        return any(c in tail for c in "\"”»“")
    if bare[-1] in STOPS:
        return True
    return any(c in tail for c in "]\"”»“)}") and not re.search(r"[\[({„«]$", bare)


def _subsequence(short: list[str], long: list[str]) -> int:
    """How many words of `short` are met in their order in `long`."""
    i = 0
    for w in long:
        if i < len(short) and short[i] == w:
            i += 1
    return i


def gives_back_question(own: list[str], question: list[str]) -> bool:
    """Whether the words are the question again: in its order, hardly any left out, nothing added; also twice over."""
    if not own or not question:
        return False
    ahead = len(own) - len(question)
    if 0 < ahead <= 4 and own[ahead:] == question:
        return True  # announced by a few words
    if own[0] in ("question", "re", "q", "frage", "pregunta", "task") and question[0] != own[0]:
        own = own[1:]
    half = len(own) // 2
    if half and own[:half] == own[half:]:
        own = own[:half]
    if len(own) < 0.6 * len(question) or len(own) > len(question) + 1 or own[-1] not in question[-3:]:
        return False
    # at most a tenth of the words is not found in order; one in ten words may be skipped by a greedy match
    met = max(_subsequence(own, question), _subsequence(own[::-1], question[::-1]))
    return met >= 0.9 * len(own) and (met >= 3 or own == question)


def shingles(tokens: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)} or ({tuple(tokens)} if tokens else set())


def gives_back_input(own: list[str], prompt: list[str], least: float = 0.9, cover: float = 0.6) -> bool:
    """Whether nearly all shingles of the words are the prompt's and cover most of it."""
    if len(own) < 5 or len(own) < cover * len(prompt):
        return False
    a = [tuple(own[i : i + SHINGLE]) for i in range(len(own) - SHINGLE + 1)]
    b = shingles(prompt)
    return sum(x in b for x in a) >= least * len(a)


def rewrite_ends(output: str, prompt: str) -> bool:
    """Whether a rewritten text (placeholders for parts of it) comes to the end of the original."""
    a = [x for x in output.strip().split("\n") if x.strip()]
    b = [x for x in prompt.strip().split("\n") if x.strip()]
    if not a or not b:
        return False
    last, goal = a[-1].strip().strip("`*"), b[-1].strip().strip("`*")
    if last == goal:
        return True
    parts = PLACE.split(last)
    at = 0
    for i, p in enumerate(parts):
        p = p.strip(" *")
        if not p:
            continue
        found = goal.rfind(p) if i == len(parts) - 1 and len(parts) > 1 else goal.find(p, at)
        if found < at:
            return False
        at = found + len(p)
    tail = parts[-1].strip(" *")
    if tail and at < len(goal.rstrip(" *")):
        return False
    return len(a) >= 0.8 * len(b)


def case_language(question: str, text: str) -> str:
    """The languages of a question and of a text, joined by a comma; '' if nothing tells."""
    found = []
    for t in (QUOTED.sub(" ", question or ""), text or ""):
        name = language(t)
        if name and name not in found:
            found.append(name)
    return ",".join(found)


def other_language(text: str, allowed: str, rewrite: bool) -> bool:
    """Whether the text's own words (without quotations) are in none of the allowed languages.

    The best language needs twice the evidence of the allowed ones, or clearly more in longer texts; a rewritten text, which
    keeps lines of names and numbers, at least five words of it.
    """
    if not allowed:
        return False
    own = CITE.sub(" ", text) if "[" in text else text
    if any(c in own for c in "\"«„“‘"):
        own = QUOTED.sub(" ", own)
    if rewrite:
        own = PLACE.sub(" ", own)
    found = evidence(own)
    if not found:
        return False
    accepted = allowed.split(",")
    name = max(found, key=lambda x: (found[x], x in accepted))
    if name in accepted:
        return False
    if name not in WORDS:  # another script
        return True
    best, most = found[name], max(found.get(x, 0) for x in accepted)
    if rewrite and best < 5:
        return False
    return best >= 2 * most if best < 6 else best >= 1.4 * most


MASK = re.compile(r"[A-ZÀ-Þ][\w’'-]*|\w*\d\w*")
CLAUSE = re.compile(r"[.!?;:,()\[\]\"«»“”„–—\n\r。！？，]+")
FIRST = frozenset(("I", "I’m", "I'm", "I’d", "I'd", "I’ve", "I've", "I’ll", "I'll"))


def phrases(text: str, shout: bool | None = None) -> list[str]:
    """The opening's phrases: its first words (OPENING of them) cut at punctuation, lower case, names and numbers masked."""
    shout = text.isupper() if shout is None else shout
    out, left = [], OPENING
    begin = 0
    while left > 0 and begin <= len(text):
        cut = CLAUSE.search(text, begin)
        end = cut.start() if cut else len(text)
        found = []
        for m in WORD.finditer(text, begin, end):
            w = m.group()
            found.append(w.lower() if shout or w in FIRST or not out and not found and not any(map(str.isdigit, w)) else "#" if MASK.fullmatch(w) else w.lower())
            if len(found) == left:
                break
        left -= len(found)
        if found:
            out.append(" ".join(found).replace("’", "'"))
        begin = cut.end() if cut else len(text) + 1
    return out


SEEN = "defect string, answers boolean, free boolean, apart boolean, denies boolean, opening array<string>"


class Case:
    """What a case's texts are made of; those of the case looked at last are kept, as its responses come together."""

    last: tuple = ()
    words_of: list[str] = []
    known: frozenset[str] = frozenset()

    def __init__(self, question: str | None, prompt: str | None, instructions: str | None):
        own = (question, prompt, instructions)
        if Case.last != own:
            Case.words_of = words(prompt or "")
            Case.known = frozenset(words(question or "")) | frozenset(Case.words_of)
            Case.last = own
        self.given, self.known = Case.words_of, Case.known


def _content(tokens: list[str]) -> set[str]:
    return {w for w in tokens if len(w) >= 4 and w.isalpha() and w not in LANGUAGES_OF}


def says_lacking(text: str) -> bool:
    """Whether a clause says, without a first person, that the material lacks something: that is an answer."""
    return any(LACKS.search(c) and MATERIAL.search(c) and PERSON.isdisjoint(words(c)) for c in CLAUSE.split(text))


def look(output: str | None, question: str | None, prompt: str | None, instructions: str | None, choices: list[str] | None, allowed: str, rewrite: bool) -> tuple[str | None, bool, bool, bool, bool, list[str]]:
    """Of one response: its defect apart from refusals (or None); whether it answers; whether it may decline
    (it neither answers nor breaks off nor gives back the prompt); whether it has content words but none
    of its case; whether it denies something in the first person, names no number and has mostly other content words than its
    case; the phrases of its opening.

    prompt: the case's input, or None where that can't change anything (see `needs_prompt`).
    """
    if output is None:
        return "empty", False, False, False, False, []
    text, complete = answer_text(output)
    if is_empty(text):
        return "empty", False, False, False, False, []
    plain = text.replace("’", "'").lower()
    labels = {c.strip().lower() for c in choices or [] if c and c.strip()}
    if labels and LEAD.sub("", plain).strip(" \t\n.!*\"'`_") in labels:
        return None, True, False, False, False, []
    last = plain.rstrip().split("\n")[-1]
    cites = CITE.search(text) is not None
    labelled = any(re.search(rf"(?:label|answer|is)\W+{re.escape(c)}\W*$|^\W*{re.escape(c)}\W*$", last) for c in labels)
    head = phrases(text)
    own = words(plain)
    # a text that ends in a choice or speaks of a longer one, or ends in a bare yes or no, answers
    named = any(re.search(rf"(?<!\w){re.escape(c)}\W*$", plain) or len(c) >= 4 and re.search(rf"(?<!\w){re.escape(c)}(?!\w)", plain) for c in labels)
    answers = cites or labelled or named or (words(CLAUSE.split(plain.rstrip(" .!\n"))[-1]) or [""])[0] in POLAR and own[-1] in POLAR or says_lacking(text)
    apart = denies = False
    asked = words(question or "")
    case = Case(question, prompt, instructions) if prompt is not None else None
    if rewrite and case and not answers:
        content = _content(own)
        answers = len(content & case.known) * 5 >= 3 * len(content)
    if not answers:
        content = _content(own)
        apart = len(content) >= TELLING and case is not None and bool(case.known) and content.isdisjoint(case.known)
        unquoted = QUOTED.sub(" ", plain)
        denies = case is not None and 3 * len(content & case.known) <= len(content) and not any(map(str.isdigit, plain)) and any(not PERSON.isdisjoint(w) and not DENIAL.isdisjoint(w) for w in map(words, CLAUSE.split(unquoted)))
    if gives_back_question(own, asked):
        return "copy", answers, False, apart, denies, head
    if case and not labelled and (gives_back_input(own, case.given) or instructions and gives_back_input(own, words(instructions) + asked + case.given)):
        return "copy", answers, False, apart, denies, head
    free = not answers and ends(text)
    if other_language(text, allowed, rewrite):
        return "other_language", answers, free, apart, denies, head
    if complete or labelled:
        broken = False
    elif rewrite:
        broken = prompt is None or not rewrite_ends(text, prompt)
    else:
        broken = not ends(text) or text[:1] == "{"
    return "truncated" if broken else None, answers, free, apart, denies, head


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)[^\W_]+(?:['’][^\W_]+)*"))


def needs_prompt(output: Column, prompt_words: Column, rewrite: Column) -> Column:
    """Whether the input (of so many words, see `words_in`) can change what `look` says: for rewritten texts, where nothing is
    cited, and where the output has enough words to give it back (runs of letters and digits are no fewer than words)."""
    return rewrite | ~output.rlike(CITE.pattern) | (F.regexp_count(output, F.lit(r"(?U)[^\W_]+")) >= 0.6 * prompt_words)


def responses(pairs: DataFrame) -> DataFrame:
    """key, case_id, topic and what `look` sees of every response.

    pairs: key, case_id, topic, output, question, prompt (see `needs_prompt`), instructions, choices, allowed (languages),
    rewrite. Rows of the same case should come together.
    """
    kind = pairs.schema["key"].dataType.simpleString()
    columns = ["output", "question", "prompt", "instructions", "choices", "allowed", "rewrite"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*[look(*r) for r in zip(*(b.column(i + 3).to_pylist() for i in range(len(columns))))])) or [()] * 6
            kinds = (pa.string(), *[pa.bool_()] * 4, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["key", "case_id", "topic", "defect", "answers", "free", "apart", "denies", "opening"])

    return pairs.select("key", "case_id", "topic", *columns).mapInArrow(run, f"key {kind}, case_id string, topic string, {SEEN}")


_hash = np.random.default_rng(5).integers(1, 2**61, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def _bands(tokens: list[str]) -> list[int]:
    h = np.array([xxhash.xxh3_64_intdigest(" ".join(s)) for s in shingles(tokens)], np.uint64)
    with np.errstate(over="ignore"):
        mixed = h[:, None] * _hash[0] + _hash[1]
        low = (mixed ^ (mixed >> np.uint64(31))).min(0).reshape(BANDS, ROWS)
    return [xxhash.xxh3_64_intdigest(row.tobytes(), seed=i) - 2**63 for i, row in enumerate(low)]


def bucket_links(sets: list[set]) -> Iterator[tuple[int, int]]:
    """Verified links (later, earlier) between the sets of one bucket; their components are those of all pairs that are
    similar enough.

    Each set belongs to a leader that it resembles. The Jaccard distance is a metric, so what is more than twice the
    allowed distance from a leader resembles none of its followers; between that, all followers are compared, unless a
    link joined them already.
    """
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    stars: list[list[int]] = []  # the leader first
    for i, s in enumerate(sets):
        led = False
        for star in stars:
            if find(star[0]) == find(i):
                continue
            both, n = len(s & sets[star[0]]), len(s) + len(sets[star[0]])
            other = None
            if both >= SIMILARITY * (n - both):
                other = star[0]
                if not led:
                    star.append(i)
                    led = True
            elif both >= (2 * SIMILARITY - 1 - 1e-9) * (n - both):
                other = next((j for j in star[1:] if (c := len(s & sets[j])) >= SIMILARITY * (len(s) + len(sets[j]) - c)), None)
            if other is not None:
                root[find(i)] = find(other)
                yield i, other
        if not led:
            stars.append([i])


def components(links: DataFrame) -> DataFrame:
    """node, root: the nodes of links (a, b; b < a) that are not the least of their connected component, with that least one.

    Large stars and small stars in turn: every node's neighbours are tied to the least of them, until only stars are left.
    """
    edges = cut_lineage(links.where("a != b").distinct())
    while True:
        down = edges.groupBy("a").agg(F.count("*").alias("n"))
        tied = down.where("n > 1").select("a").unionByName(down.select("a").join(edges.select(F.col("b").alias("a")).hint("merge"), "a", "left_semi"))
        if tied.isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())


def clusters(openings: DataFrame) -> DataFrame:
    """opening, cluster: each distinct opening with the least opening of its cluster, maybe itself.

    Clusters are the connected components of all pairs of openings that share a MinHash bucket and are verified to be
    similar enough.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_bands(t.split(" ")) for t in texts], pa.list_(pa.int64()))], ["opening", "bands"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(bucket: list[str]) -> pa.RecordBatch:
            pairs = [(bucket[i], bucket[j]) for i, j in bucket_links([shingles(t.split(" ")) for t in bucket])]
            return pa.RecordBatch.from_arrays([pa.array([max(p) for p in pairs], pa.string()), pa.array([min(p) for p in pairs], pa.string())], ["a", "b"])

        band, bucket = None, []
        for b in batches:  # a bucket may go on in the next batch
            for own, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if own != band:
                    if len(bucket) > 1:
                        yield linked(bucket)
                    band, bucket = own, []
                bucket.append(text)
        if len(bucket) > 1:
            yield linked(bucket)

    signed = openings.select("opening").mapInArrow(sign, "opening string, bands array<bigint>").select(F.explode("bands").alias("band"), "opening")
    links = signed.repartition("band").sortWithinPartitions("band", "opening").mapInArrow(link, "a string, b string")
    roots = components(links)
    return openings.select("opening").join(roots.withColumnRenamed("node", "opening").hint("merge"), "opening", "left").select("opening", F.coalesce("root", "opening").alias("cluster"))


def _grams(phrase: Column) -> Column:
    """The sequences of two and three words of a phrase, with their first word's place: array of (gram, at, n)."""
    w = F.split(phrase, " ")
    some = lambda n: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.struct(F.array_join(F.slice(w, i, n), " ").alias("gram"), i.alias("at"), F.lit(n).alias("n")))
    none = F.array().cast("array<struct<gram:string,at:int,n:int>>")
    return F.concat(F.when(F.size(w) >= 2, some(2)).otherwise(none), F.when(F.size(w) >= 3, some(3)).otherwise(none))


def refusals(seen: DataFrame, least: int = 3) -> DataFrame:
    """key, way: the responses that decline, and what reveals them: template, wording or sign.

    template: a phrase of the opening belongs to a cluster of at least `least` responses from different cases and topics that
    don't answer, while at most a tenth of all its responses answer and more than half have no content word of their case.
    wording: at least half of the opening's words lie in sequences of two or three words that are met in several topics of
    the template's responses and at least as often there as in all others. sign: see the module. A response that answers,
    breaks off or only gives back its question declines nothing. Phrases with fewer than three words that aren't masked tell nothing.
    """
    row = seen.where("size(opening) > 0").select("key", "case_id", "topic", "free", "answers", "apart", F.explode(F.array_distinct("opening")).alias("phrase"))
    free = lambda c: F.when(F.col("free"), F.col(c))
    each = row.groupBy("phrase").agg(
        F.count("*").alias("n"), F.count_if("answers").alias("answered"), F.count_if(F.col("free") & F.col("apart")).alias("aparts"), F.count_if("free").alias("frees"),
        F.min(free("case_id")).alias("c0"), F.max(free("case_id")).alias("c1"), F.min(free("topic")).alias("t0"), F.max(free("topic")).alias("t1"),
    )
    each = cut_lineage(each)
    telling = each.where(F.size(F.filter(F.split("phrase", " "), lambda w: w != "#")) >= 3)
    member = cut_lineage(clusters(telling.select(F.col("phrase").alias("opening"))).withColumnRenamed("opening", "phrase"))
    whole = telling.join(member.hint("merge"), "phrase").groupBy("cluster").agg(
        *[F.sum(c).alias(c) for c in ("n", "answered", "aparts", "frees")], *[F.min(c).alias(c) for c in ("c0", "t0")], *[F.max(c).alias(c) for c in ("c1", "t1")]
    )
    recurs = (F.col("frees") >= least) & (F.col("c0") != F.col("c1"))
    template = recurs & (F.col("t0") != F.col("t1")) & (F.col("answered") <= 0.1 * F.col("n")) & (F.col("aparts") * 2 > F.col("frees"))
    # the phrases grow with the corpus: their joins are by merging, never by broadcasting what compresses well on disk
    kinds = whole.select("cluster", F.when(template, "template").when(recurs & (F.col("t0") == F.col("t1")), "bound").alias("kind")).where("kind is not null")
    kinds = cut_lineage(member.join(kinds.hint("merge"), "cluster").select("phrase", "kind"))
    loose = cut_lineage(row.where("free").select("key", "topic", "phrase"))
    told = loose.join(kinds.hint("merge"), "phrase").groupBy("key").agg(F.bool_or(F.col("kind") == "template").alias("template"), F.bool_or(F.col("kind") == "bound").alias("bound"))
    told = cut_lineage(told)
    first = told.where("template").select("key")
    # the wording of those revealed, against all others
    theirs = loose.join(first.hint("merge"), "key", "left_semi").groupBy("phrase").agg(F.count("*").alias("own"), F.min("topic").alias("t0"), F.max("topic").alias("t1"))
    spread = lambda df, *more: df.select(F.inline(_grams(F.col("phrase"))), *more)
    said = spread(theirs, "own", "t0", "t1").where("gram not like '%#%'").groupBy("gram").agg(F.sum("own").alias("own"), F.min("t0").alias("t0"), F.max("t1").alias("t1")).where("own >= 2 and t0 != t1")
    every = spread(each.select("phrase", F.col("n").alias("all")), "all").groupBy("gram").agg(F.sum("all").alias("all"))
    declining = said.join(every.hint("merge"), "gram").where("2 * own >= all").select("gram")
    rest = cut_lineage(loose.join(first.hint("merge"), "key", "left_anti").select("key", "phrase"))
    hits = spread(rest.select("phrase").distinct(), "phrase").join(declining.hint("merge"), "gram").groupBy("phrase").agg(F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1))))).alias("hit"))
    learned = rest.join(hits.hint("merge"), "phrase", "left").groupBy("key").agg(F.sum(F.size(F.split("phrase", " "))).alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("hit")).where("2 * hit >= n").select("key")
    alone = seen.where("free and denies").select("key").join(told.select("key").hint("merge"), "key", "left_anti").join(learned.hint("merge"), "key", "left_anti")
    way = lambda df, name: df.select("key", F.lit(name).alias("way"))
    return way(first, "template").unionByName(way(learned, "wording")).unionByName(way(alone, "sign"))


def defects(seen: DataFrame, least: int = 3) -> DataFrame:
    """key, defect: responses with a defect, from what `responses` saw. An empty response has no opening and is empty; a
    response that only gives back its prompt is a copy; else a refusal is a refusal, whatever its language."""
    found = seen.join(refusals(seen, least).hint("merge"), "key", "left")
    return found.select("key", F.when(F.col("way").isNotNull(), "refusal").otherwise(F.col("defect")).alias("defect")).where("defect is not null")

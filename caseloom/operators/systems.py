"""Systems as dataflows over cases, around a model that is a plain function of prompts.

A system turns cases (one row a job, with a unique id) into run records: output, error, what the calls took, findings, trace.
What can be done by column expressions is; the model is reached through a gateway (`gateway.ask`), which counts the calls. It
stands around a function prompt -> reply; `scripted` is one that answers from the prompt alone, so runs are reproducible and
tasks can be repeated.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.session import cut_lineage
from .gateway import Gateway, Model, ask, gateway_of

# fixed values: batch sizes of the two scanning systems, and when a quotation needs no model
SCAN_BATCH, EXCERPT_BATCH = 5, 3
QUOTE_WORDS, REST_WORDS = 8, 12


def few_shot_prompt(instructions: Column, examples: Column, text: Column) -> Column:
    """Instructions, worked examples, the input, and a last line that says what comes next."""
    demos = F.transform(F.coalesce(examples, F.array().cast("array<struct<q:string,a:string>>")), lambda e: F.concat(F.lit("\n\n"), e["q"], F.lit("\nAnswer: "), e["a"]))
    return F.concat(instructions, F.array_join(demos, ""), F.lit("\n\n"), text, F.lit("\nAnswer:"))


def label_prompt(instructions: Column, text: Column, question: Column, choices: Column) -> Column:
    return F.concat(instructions, F.lit("\n\n"), text, F.lit("\n\n"), question, F.lit("\nOne of: "), F.array_join(choices, ", "), F.lit("\nLabel:"))


def scripted(prompt: str) -> str:
    """A deterministic model: the last line of the prompt says what is asked, the rest is what it answers from."""
    body, _, last = prompt.rpartition("\n")
    if last.startswith("Label"):
        found = re.search(r"\nOne of: (.*)$", body)
        choices = found.group(1).split(", ") if found else [""]
        return choices[len(body) % len(choices)]
    if last.startswith("Quotes"):
        out = []
        for n, t in re.findall(r"Document \[(\d+)\]\(Title: [^\n]*?\): ([^\n]*)", body)[::2]:
            words = t.split()
            if len(words) >= 10:
                out.append(f'[{n}] "{" ".join(words[:10])}"')
        return "\n".join(out) or "none"
    if last.startswith("Verbatim"):
        lines = [x for x in body.rpartition("Excerpt:\n")[2].split("\n") if len(x.split()) >= 10]
        return "\n".join("- " + " ".join(x.split()[:10]) for x in lines[:2]) or "None"
    if last.startswith("Passages"):
        claim = re.search(r"\nClaim: (.*)$", body)
        words = set(re.findall(r"\w{4,}", claim.group(1).lower())) if claim else set()
        hit = [n for n, t in re.findall(r"Document \[(\d+)\]\(Title: [^\n]*?\): ([^\n]*)", body) if words and len(words & set(re.findall(r"\w{4,}", t.lower()))) * 2 >= len(words)]
        return "".join(f"[{n}]" for n in hit[:2]) or ("keep" if " no " in f" {claim.group(1) if claim else ''} " else "none")
    if last.startswith(("Supported", "About")):
        return "yes" if last.startswith("Supported") and len(body) % 3 else "keep" if last.startswith("About") and " no " in body else "no"
    if last.startswith("JSON"):
        return "[" + ", ".join(f'"{x}"' for x in dict.fromkeys(re.findall(r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", body))) + "]"
    if last.startswith("Findings answer"):
        found = re.findall(r'^\[(\d+)\] "(.*)"$', body, re.M)
        return " ".join(f'It says "{t}" [{n}].' for n, t in found) or "The documents contain no such clause."
    if last.startswith("Resulting"):
        return body.rpartition("Document:\n")[2].strip()
    heads = re.findall(r"Document \[(\d+)\]\(Title: [^\n]*?\): ([^.!?\n]*[.!?])", body)
    return " ".join(f"{t.rstrip('.!?')} [{n}]." for n, t in heads[:3]) or body.strip().split("\n")[-1][:200]


def _record(df: DataFrame, system: str, output: Column, error: Column, findings: Column, source: Column, sent: Column, raw: Column, gate: Gateway) -> DataFrame:
    """The jobs' records, with what the gateway counted; a job that asked nothing made no calls."""
    changed = F.coalesce(output != raw, F.lit(False))
    out = df.select(
        "id", F.lit(system).alias("system"), F.when(error.isNull(), output).otherwise(F.lit("")).alias("output"), error.alias("error"), findings.alias("findings"),
        F.when((F.size(findings) > 0) | changed, "modified").otherwise("pass").alias("decision"), F.struct(source.alias("source"), sent.alias("transformed_source"), raw.alias("raw_output"), output.alias("released_output")).alias("trace"),
    )
    used = gate.usage(requests=True)
    if used is None:
        return out
    both = out.join(used, "id", "left")
    return both.withColumns({c: F.coalesce(c, F.lit(0)).cast(t) for c, t in (("model_calls", "int"), ("tokens_in", "bigint"), ("tokens_out", "bigint"), ("latency_ms", "bigint"))})


def _none() -> Column:
    return F.array().cast("array<string>")


def _prompt(instructions: Column, text: Column, asked: Column, choices: Column, examples: Column) -> Column:
    document = F.concat(instructions, F.lit("\n\nDocument:\n"), text, F.lit("\n\nResulting document:"))
    return F.when(choices.isNotNull(), label_prompt(instructions, text, F.coalesce(asked, F.lit("")), choices)).when(F.col("suite") == "redaction", document).otherwise(few_shot_prompt(instructions, examples, text))


def direct(cases: DataFrame, model: Model | Gateway = scripted) -> DataFrame:
    """One prompt, one call."""
    gate = gateway_of(model)
    r = ask(cases, ["id"], _prompt(F.col("instructions"), F.col("input"), F.col("question"), F.col("choices"), F.col("examples")), "__r", gate)
    return _record(r, "direct", F.col("__r"), F.col("__r_error"), _none(), F.col("input"), F.col("input"), F.col("__r"), gate)


def placeholder(cases: DataFrame, model: Model | Gateway = scripted) -> DataFrame:
    """Personal data scrubbed by patterns before the call and after it, in redaction cases."""
    gate = gateway_of(model)
    redact = F.col("suite") == "redaction"
    c = cases.withColumn("__in", F.when(redact, X.scrub("input")).otherwise(F.col("input"))).withColumn("__f", F.when(redact, X.scrub_findings("input")).otherwise(_none()))
    r = ask(c, ["id"], _prompt(F.col("instructions"), F.col("__in"), F.col("question"), F.col("choices"), F.col("examples")), "__r", gate)
    out = F.when(redact, X.scrub("__r")).otherwise(F.col("__r"))
    found = F.concat("__f", F.coalesce(F.when(redact, X.scrub_findings("__r")), _none()))
    return _record(r, "placeholder", out, F.col("__r_error"), found, F.col("input"), F.col("__in"), F.col("__r"), gate)


def legal(cases: DataFrame, model: Model | Gateway = scripted) -> DataFrame:
    """Patterns, then what a safety model lists, are scrubbed before the call and after it, in redaction cases."""
    gate = gateway_of(model)
    redact = F.col("suite") == "redaction"

    def hybrid(df: DataFrame, text: str, out: str) -> DataFrame:
        df = df.withColumn("__s", F.when(redact, X.scrub(text)).otherwise(F.col(text)))
        df = ask(df, ["id"], F.when(redact, F.concat(F.lit("List the personal data.\n"), F.col("__s"), F.lit("\nJSON array:"))), f"__l_{out}", gate, "safety")
        items = F.coalesce(X.bracketed_list(f"__l_{out}"), _none())
        df = df.withColumn("__items", F.when(redact, F.filter(items, lambda i: F.rlike(F.col("__s"), F.concat(F.lit("(?i)"), X.flexible_pattern(i))))).otherwise(_none()))
        found = F.when(redact, F.concat(X.scrub_findings(text), F.transform("__items", lambda i: F.concat(F.lit("llm:"), i)))).otherwise(_none())
        return df.withColumn(out, F.when(redact, X.scrub_items("__s", "__items")).otherwise(F.col("__s"))).withColumn(f"{out}_f", F.coalesce(found, _none())).drop("__s", "__items")

    c = hybrid(cases, "input", "__in")
    r = ask(c, ["id"], _prompt(F.col("instructions"), F.col("__in"), F.col("question"), F.col("choices"), F.col("examples")), "__r", gate)
    r = hybrid(r, "__r", "__out")
    return _record(r, "legal-v1", F.col("__out"), F.col("__r_error"), F.concat("__in_f", "__out_f"), F.col("input"), F.col("__in"), F.col("__r"), gate)


def cite(cases: DataFrame, model: Model | Gateway = scripted) -> DataFrame:
    """A draft; every sentence then gets the passages that support it, is kept as speaking of the documents, or dropped."""
    gate = gateway_of(model)
    texts = cases.select("id", F.coalesce("docs", F.array().cast("array<struct<title:string,text:string>>")).alias("__docs"))
    d = ask(cases, ["id"], few_shot_prompt(F.col("instructions"), F.col("examples"), F.col("input")), "__r", gate)
    s = d.select("id", F.coalesce(F.size("docs"), F.lit(0)).alias("__n"), F.posexplode(X.sentences("__r")).alias("s", "sent")).withColumn("claim", X.remove_citations("sent"))
    s = s.withColumn("__n", F.greatest("__n", F.lit(0)))
    prompt = F.concat(F.lit("Which passages support the claim?\n"), X.format_docs(F.col("__docs")), F.lit("\nClaim: "), F.col("claim"), F.lit("\nPassages:"))
    s = ask(s, ["id", "s"], prompt, "v", gate, texts=texts)
    refs, before = X.citations_closed(F.coalesce("v", F.lit("")), F.col("__n")), X.citations_closed("sent", F.col("__n"))
    keep = F.coalesce(F.rlike(F.col("v"), F.lit(r"(?i)^\s*keep(?![A-Za-z0-9_])")), F.lit(False))
    same = F.size(refs) == F.size(F.array_intersect(refs, before))
    same = same & (F.size(refs) == F.size(before))
    text = F.when(keep, F.col("claim")).when(F.size(refs) > 0, X.insert_citations("claim", X.cite_marks(refs)))
    name = F.concat(F.lit("s"), (F.col("s") + 1).cast("string"), F.lit(": "))
    was = F.when(F.size(before) > 0, X.cite_marks(before)).otherwise(F.lit("none"))
    found = F.when(keep, F.concat(name, F.lit("stays uncited, it speaks of the documents"))).when(F.size(refs) == 0, F.concat(name, F.lit("removed, nothing supports it"))).otherwise(F.concat(name, was, F.lit(" => "), X.cite_marks(refs), F.when(same, "").otherwise(", new")))
    return _assembled(d, s.select("id", "s", text.alias("text"), found.alias("finding")), "cite-v1", _none(), gate)


def _assembled(drafts: DataFrame, sentences: DataFrame, system: str, scanned: Column, gate: Gateway) -> DataFrame:
    """The released sentences in order, with the findings of the check."""
    ordered = sentences.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("s", "text", "finding"))).alias("x"))
    both = drafts.join(ordered, "id", "left")
    rows = F.coalesce("x", F.array().cast("array<struct<s:int,text:string,finding:string>>"))
    out = F.array_join(F.filter(F.transform(rows, lambda r: r["text"]), lambda t: t.isNotNull()), " ")
    return _record(both, system, out, F.col("__r_error"), F.concat(scanned, F.transform(rows, lambda r: r["finding"])), F.col("input"), F.col("input"), F.col("__r"), gate)


def scan_batches(cases: DataFrame, size: int) -> DataFrame:
    """id, batch, places: a case's passages in batches of `size`, 0-based places."""
    places = F.sequence(F.lit(0), F.size("docs") - 1)
    flat = cases.where("size(docs) > 0").select("id", F.explode(places).alias("k"))
    return flat.groupBy("id", F.floor(F.col("k") / size).cast("int").alias("batch")).agg(F.array_sort(F.collect_list("k")).alias("places"))


def review(cases: DataFrame, model: Model | Gateway = scripted, bare: bool = False) -> DataFrame:
    """Scan all passages for quotations, compose the answer from them, check every sentence.

    bare: the scanning model sees plain excerpts and answers with bare lines, which are located in the first passage that
    contains them; else it sees numbered passages and names the passage of each quotation, which must contain it. A sentence
    that is nearly all quotation needs no model.
    """
    gate = gateway_of(model)
    size = EXCERPT_BATCH if bare else SCAN_BATCH
    c = cases.withColumn("asked", X.strip(F.coalesce("question", F.get(F.split("input", r"\n\nDocument \[1\]"), 0))))
    docs = c.select("id", "docs")
    b = scan_batches(c, size)
    texts = F.transform("places", lambda k: F.get("docs", k.cast("int")).getField("text"))
    numbered = F.array_join(F.transform("places", lambda k: F.concat(F.lit("Document ["), (k + 1).cast("string"), F.lit("](Title: "), F.coalesce(F.get("docs", k.cast("int")).getField("title"), F.lit("")), F.lit("): "), F.coalesce(F.get("docs", k.cast("int")).getField("text"), F.lit("")))), "\n")
    if bare:
        prompt = F.concat("asked", F.lit("\n\nExcerpt:\n"), F.array_join(texts, "\n"), F.lit("\n\nVerbatim quotes:"))
    else:
        prompt = F.concat(F.lit("Quote what answers the question.\nQuestion: "), F.col("asked"), F.lit("\n\n"), numbered, F.lit("\n\nQuotes:"))
    r = ask(b, ["id", "batch"], prompt, "v", gate, texts=c.select("id", "docs", "asked"))
    holds = lambda k, q: F.coalesce(X.contains_normalized(F.get("docs", k.cast("int")).getField("text"), q), F.lit(False))
    if bare:
        q = r.select("id", "batch", "places", F.posexplode(X.bare_lines(F.coalesce("v", F.lit("")))).alias("at", "text")).join(docs, "id")
        q = q.withColumn("passage", F.get(F.filter("places", lambda k: holds(k, F.col("text"))), 0).cast("bigint"))
    else:
        q = r.select("id", "batch", "places", F.posexplode(X.quote_lines(F.coalesce("v", F.lit("")))).alias("at", "q")).select("id", "batch", "places", "at", F.col("q.passage").alias("named"), F.col("q.text").alias("text"))
        q = q.where(F.array_contains("places", F.col("named").cast("int"))).join(docs, "id").withColumn("passage", F.when(holds(F.col("named"), F.col("text")), F.col("named")))
    quotes = cut_lineage(q.select("id", "batch", "at", "passage", "text"))
    kept = quotes.where("passage is not null").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("passage", "batch", "at", "text"))).alias("quotes"))
    lost = quotes.groupBy("id").agg(F.count_if(F.col("passage").isNull()).alias("discarded"))
    batches = b.groupBy("id").agg(F.count("*").alias("batches"))
    d = c.join(kept, "id", "left").join(lost, "id", "left").join(batches, "id", "left")
    d = d.withColumn("quotes", F.coalesce("quotes", F.array().cast("array<struct<passage:bigint,batch:int,at:int,text:string>>")))
    listed = F.array_join(F.transform("quotes", lambda x: F.concat(F.lit("["), (x["passage"] + 1).cast("string"), F.lit('] "'), x["text"], F.lit('"'))), "\n")
    d = ask(d, ["id"], F.concat("instructions", F.lit("\n\nQuestion: "), F.col("asked"), F.lit("\n\n"), F.when(listed == "", F.lit("none")).otherwise(listed), F.lit("\nFindings answer:")), "__r", gate)
    s = d.select("id", F.greatest(F.lit(0), F.coalesce(F.size("docs"), F.lit(0))).alias("__n"), F.posexplode(X.sentences("__r")).alias("s", "sent"))
    s = s.withColumn("claim", X.remove_citations("sent")).withColumn("refs", X.citations_closed("sent", F.col("__n")))
    cited = F.array_join(F.transform("refs", lambda i: F.coalesce(F.get("docs", i.cast("int")).getField("text"), F.lit(""))), "\n")
    s = s.join(docs, "id").withColumn("cited", cited).withColumn("run", F.when(F.size("refs") > 0, X.longest_run("claim", "cited")).otherwise(0))
    s = cut_lineage(s.select("id", "s", "sent", "claim", "refs", "run"))
    rest = F.size(F.split(X.normalize_words("claim"), " ")) - F.col("run")
    s = s.withColumn("quoted", (F.col("run") >= QUOTE_WORDS) & (rest <= REST_WORDS))
    supported = F.concat(F.lit("Do the passages support the claim?\n"), cited, F.lit("\nClaim: "), F.col("claim"), F.lit("\nSupported (yes or no):"))
    about = F.concat(F.lit("Sentence: "), F.col("claim"), F.lit("\nAbout the documents (keep or no):"))
    s = ask(s, ["id", "s"], F.when(~F.col("quoted"), F.when(F.size("refs") > 0, supported).otherwise(about)), "v", gate, texts=docs)
    word = F.when(F.col("quoted"), "quoted").otherwise(X.verdict_word(F.coalesce("v", F.lit("no"))))
    has = F.size("refs") > 0
    good = has & word.isin("quoted", "yes") | ~has & (word == "keep")
    name = F.concat(F.lit("s"), (F.col("s") + 1).cast("string"), F.lit(": "))
    marks = F.when(has, X.cite_marks("refs")).otherwise(F.lit("none"))
    found = F.when(good & (word == "quoted"), F.concat(name, marks, F.lit(" confirmed as a quotation"))).when(good & has, F.concat(name, marks, F.lit(" found to support it"))).when(good, F.concat(name, F.lit("stays, it speaks of the documents"))).otherwise(F.concat(name, marks, F.lit(" removed, "), F.when(has, "no support").otherwise("no statement about the documents")))
    places = F.array_sort(F.array_distinct(F.transform("quotes", lambda x: x["passage"])))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    summary = F.concat(count(F.greatest(F.lit(0), F.size("docs"))), F.lit(" passages scanned in "), count("batches"), F.lit(" calls; quotations: "), F.size("quotes").cast("string"), F.when(F.size("quotes") > 0, F.concat(F.lit(" from "), X.cite_marks(places))).otherwise(F.lit("")), F.lit(", not found in the text: "), count("discarded"))
    return _assembled(d, s.select("id", "s", F.when(good, F.col("sent")).alias("text"), found.alias("finding")), "review-ft" if bare else "review-v1", F.array(summary), gate)


SYSTEMS: dict[str, Callable[..., DataFrame]] = {
    "direct": direct, "placeholder": placeholder, "legal-v1": legal, "cite-v1": cite, "review-v1": review, "review-ft": lambda cases, model=scripted: review(cases, model, bare=True),
}

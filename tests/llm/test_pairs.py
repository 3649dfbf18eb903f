"""Defects of responses, one by one and through the clusters of openings."""

import random

import pytest
from pyspark.sql import functions as F

from caseloom.llm import pairs as P

INPUT = "Question: Who paid for the bridge near Alton in 1849?\n\nDocument [1](Title: Bridge): The bridge near Alton was built in 1849 and the town council paid for it."
ASKED = "Who paid for the bridge near Alton in 1849?"


def defect(output, question=ASKED, prompt=None, choices=None, allowed="en", rewrite=False, instructions=None):
    return P.look(output, question, prompt, instructions, choices, allowed, rewrite)[0]


EMPTY = [None, "", "  \n", "﻿", "​", "{}", "[]", '""', "-", "...", "N/A", "None", "null", "```\n```", "<answer></answer>", "<p> </p>", "<think>why not</think>\n", "<think>cut off", "**Answer:**", "Answer:", "[1]", "[2][3]", '{"answer": null}', "<!-- nothing -->", "(none)", "—"]
SOUND = [
    "Yes", "No.", "The council paid [1].", "There is no such clause.", "I cannot see a reason for doubt here. The council paid [1].", "Sorry for the length; the council of the town paid for it [1].",
    'Passage 1 reads "The bridge near Alton was built in" [1]', 'It says "The bridge near Alton…" [1]', f"{ASKED}\nThe council paid for it [1].", '{"answer": "The council paid for it."}', "The council of the town paid.", "- The council paid.\n- The town agreed.", f"{ASKED} Nobody.",
]
TRUNCATED = ["The council of the town pai", "The council of the town [", "The council paid, which says: \"The bridge", "The council of the town because the…", "The council paid of ...", "There are three reasons:\n1. The council paid.\n2.", '```json\n{"answer": "The council paid.", "passages": [1,', "The town council,", "It was paid by -"]
COPY = [ASKED, ASKED.upper(), f"> {ASKED}", f"{ASKED} {ASKED}", "who paid the bridge near alton in 1849?", f'"{ASKED}"', f"Question: {ASKED}", f"You asked: {ASKED}"]
OTHER = ["La société ne peut pas livrer les pièces sans accord écrit, voir l’article 3.", "Да, договор требует передать документы.", "该条款将金额限制在每年以内。", "Ja, de overeenkomst bepaalt dat de partij de stukken binnen 277 dagen levert [2].", "Nein, keineswegs.", "Segundo o trecho, a ponte foi construída em 1976 por 3070 pessoas.", "La clausola limita la somma a 3 per ogni anno a favore di Alton."]


@pytest.mark.parametrize(("kind", "outputs"), [("empty", EMPTY), (None, SOUND), ("truncated", TRUNCATED), ("copy", COPY), ("other_language", OTHER)])
def test_one_by_one(kind, outputs):
    assert {o: defect(o) for o in outputs} == dict.fromkeys(outputs, kind)


def test_labels_and_languages():
    assert defect("yes", choices=["Yes", "No"]) is None and defect("The name tells nothing.\n**Yes**", choices=["Yes", "No"]) is None
    assert defect("Answer: arbitrary", choices=["arbitrary"]) is None
    assert defect("Aucun passage ne prévoit cette clause.", allowed="fr") is None
    assert defect("According to the passage it was sold in 1956.", allowed="es") == "other_language"
    assert defect("Nach dem Text bleibt es bis 1931 so, und die Firma behält es weiterhin.", allowed="de,en") is None
    assert defect("Zrx qwv", allowed="") is None


def test_copies_of_the_input():
    assert defect(INPUT, prompt=INPUT) == "copy"
    facts = "To show that the ledger was kept, its page 784 of 24 August 1987 is read aloud by the clerk of the town."
    assert defect(facts, "Is there hearsay?", facts, ["Yes", "No"]) == "copy" and defect(facts + "\nAnswer: Yes", "Is there hearsay?", facts, ["Yes", "No"]) is None
    half = "The bridge near Alton was built in 1849"
    assert defect(f'It says "{half}", so the council paid for it, as the passage shows. [1]', prompt=INPUT) is None


def test_rewritten_texts():
    source = "Passport no. Z1234 was checked.\nApproved by Ann Lee for the team.\nHome address: 4 Mill Lane, Alton"
    look = lambda out, prompt=source: defect(out, "", prompt, rewrite=True, instructions="Replace personal data.")
    good = "Passport no. [ID_1] was checked.\nApproved by [NAME_1] for the team.\nHome address: [STREET_1]"
    assert look(good) is None and look(good.replace("[ID_1]", "***1")) is None
    assert look(good[:-4]) == "truncated" and look(good[:60]) == "truncated" and look(good.split("\n")[0]) == "truncated"
    assert look(source) == "copy" and look("Replace personal data.\n" + source) == "copy" and look("Passport", None) == "truncated"


DDL = "key bigint, case_id string, topic string, output string, question string, prompt string, instructions string, choices array<string>, allowed string, rewrite boolean"


ASKS = ["Who paid for the bridge near Alton?", "When was the mill sold?", "Which fee falls due in May?"]


def judged(spark, rows):
    """key -> defect of (key, case_id, topic, output, question, prompt, choices) rows."""
    full = [(k, c, t, o, q, p, None, ch, "en", False) for k, c, t, o, q, p, ch in rows]
    return {r.key: r.defect for r in P.defects(P.responses(spark.createDataFrame(full, DDL))).collect()}


def spread(text, first, n=6, prompts=ASKS):
    """The text (or what a function of the number gives) as response to n cases of three topics."""
    return [(first + i, f"c{i}", f"t{i % 3}", text(i) if callable(text) else text, ASKS[i % 3], prompts[i % 3], None) for i in range(n)]


def test_recurrence_over_unrelated_prompts_reveals_refusals(spark):
    rows = spread("The request is declined.", 0) + spread("Regrettably, answering falls outside the mandate given to this assistant.", 10)
    rows += spread("Matters like yours exceed whatever gets handled around here, kindly seek somebody qualified elsewhere.", 20)
    assert judged(spark, rows) == dict.fromkeys([r[0] for r in rows], "refusal")


def test_wording_learned_from_templates(spark):
    rows = spread("Regrettably, answering falls outside the mandate given to this assistant.", 0) + spread("Kindly seek somebody qualified elsewhere.", 10)
    once = [(30, "x", "t0", "Answering falls outside the mandate, seek somebody qualified.", ASKS[0], ASKS[0], None)]
    ways = {r.key: r.way for r in P.refusals(P.responses(spark.createDataFrame([(k, c, t, o, q, p, None, ch, "en", False) for k, c, t, o, q, p, ch in rows + once], DDL))).collect()}
    assert ways == {**dict.fromkeys([r[0] for r in rows], "template"), 30: "wording"}


def test_what_answers_is_no_refusal_however_often_it_recurs(spark):
    rows = spread("There is no such clause anywhere among those pages, regardless how carefully somebody looks through everything.", 0)
    # recurring words, each time with the case's own
    rows += spread(lambda i: f"Everything considered together and weighed carefully over again, that would probably be {('the bridge', 'the mill', 'the fee')[i % 3]} near Alton.", 10)
    # reasoning that ends in a label, and a quoted refusal beside a citation
    rows += [(*r[:6], ["Yes", "No"]) for r in spread("Everything considered together and weighed carefully over again, somebody qualified would conclude this makes it No.", 20)]
    rows += spread('The letter reads "I cannot help with that request and must decline it" [1].', 30)
    # the same wording for one topic only, broken off ones, questions given back
    rows += [(40 + i, f"d{i}", "t0", "Whatever seems plausible remains doubtful until somebody qualified looks thoroughly into everything again.", ASKS[0], ASKS[0], None) for i in range(6)]
    assert judged(spark, rows) == {}
    assert set(judged(spark, spread("Everything considered together and weighed carefully over again", 0)).values()) == {"truncated"}
    assert set(judged(spark, spread(lambda i: ASKS[i % 3], 0)).values()) == {"copy"}


def test_denial_alone_is_no_refusal(spark):
    supplier = "The supplier says that it cannot accept the delay under clause 5. How long is the notice?"
    seller = "The seller wrote that late orders must be declined. How long is the period?"
    rows = [
        (0, "a", "t0", "The supplier says: I cannot accept the delay under clause 5, so notice is 30 days.", supplier, supplier, None),
        (1, "b", "t1", "Seller wrote that we must decline late orders. The period is 30 days.", seller, seller, None),
        (2, "c", "t1", 'It says "I cannot help and must decline" in the letter of the seller.', seller, seller, None),
        (3, "d", "t2", "I must decline.", seller, seller, None), (4, "e", "t2", "I'm sorry, but I can't help with that.", seller, seller, None), (5, "f", "t2", None, None, None, None), (6, "g", "t2", "", "", "", []),
    ]
    assert judged(spark, rows) == {3: "refusal", 4: "refusal", 5: "empty", 6: "empty"}


def test_clusters_are_verified(spark):
    base = " ".join(f"w{i}" for i in range(16))
    near = " ".join(f"w{i}" for i in range(1, 17))
    df = spark.createDataFrame([(base,), (near,), ("one two three four five six",)], "opening string")
    c = {r.opening: r.cluster for r in P.clusters(df).collect()}
    assert len(c) == 3 and c[near] == min(base, near) and c["one two three four five six"] == "one two three four five six"


def _parts(nodes, links):
    """Connected components, the plain way: each node with the least of its component."""
    of = {n: n for n in nodes}
    while True:
        less = [(max(of[a], of[b]), min(of[a], of[b])) for a, b in links if of[a] != of[b]]
        if not less:
            return of
        for big, small in less:
            of = {n: small if r == big else r for n, r in of.items()}


def _similar(a, b):
    p, q = P.shingles(a.split(" ")), P.shingles(b.split(" "))
    return len(p & q) >= P.SIMILARITY * len(p | q)


def _template_family(n, seed):
    r = random.Random(seed)
    body = " ".join(f"w{i}" for i in range(14))
    return sorted({f"{r.choice('abcdefgh')} {body} {r.choice('klmnopqr')}" for _ in range(n)})


def test_links_of_a_bucket_join_what_brute_force_joins():
    for seed in range(20):
        r = random.Random(seed)
        texts = _template_family(30, seed) + [" ".join(r.choices("xyz", k=r.randint(1, 16))) for _ in range(20)]
        texts = sorted(set(texts))
        r.shuffle(texts)
        found = list(P.bucket_links([P.shingles(t.split(" ")) for t in texts]))
        assert all(_similar(texts[i], texts[j]) for i, j in found)
        every = [(a, b) for k, a in enumerate(texts) for b in texts[k + 1 :] if _similar(a, b)]
        assert _parts(texts, [(texts[i], texts[j]) for i, j in found]) == _parts(texts, every)


def test_components(spark):
    r = random.Random(3)
    for n, m in ((60, 50), (40, 80)):
        links = [tuple(sorted(r.sample(range(n), 2), reverse=True)) for _ in range(m)] + [(k + 1, k) for k in range(100, 140)]
        out = {x.node: x.root for x in P.components(spark.createDataFrame(links, "a int, b int")).collect()}
        want = _parts({x for l in links for x in l}, links)
        assert out == {k: v for k, v in want.items() if k != v}


def test_variants_of_a_template_are_one_cluster_and_strangers_their_own(spark):
    # variants that differ at both ends resemble each other only through others
    family = _template_family(40, 1)
    strangers = ["one two three four five six", "alone"]
    df = spark.createDataFrame([(x,) for x in family + strangers], "opening string")
    c = {r.opening: r.cluster for r in P.clusters(df).collect()}
    assert c == {**dict.fromkeys(family, min(family)), **{x: x for x in strangers}}
    assert P.clusters(df.where("false")).count() == 0


def test_the_input_is_given_wherever_it_matters(spark):
    df = spark.createDataFrame([("one two three", "one two three four", False), ("one [1]", "one two three four", False), ("one", "one two three four", False), ("one [1]", "one two three four", True), ("l’un deux [1] trois", "l'un deux trois quatre", False)], "o string, p string, r boolean")
    assert [r[0] for r in df.select(P.needs_prompt(F.col("o"), P.words_in(F.col("p")), F.col("r"))).collect()] == [True, False, True, True, True]


def test_length_alone_changes_no_defect():
    for n in (1, 500):
        assert {defect(x * n) for x in ("[1]", "---\n", "* * *\n", "[1, 2] ")} == {"empty"}
        quote = "La société ne peut pas livrer les pièces sans accord écrit. " * (1 + n // 10)
        for a, b in ('""', "«»", "„“", "“”", "‘’"):
            assert P.QUOTED.sub(" ", f"{a}{quote}{b}") == " "
            assert defect(f"The clause that the council of the town has accepted is this: {a}{quote}{b}") is None
        long = "The council of the town paid" + " [1]" * 300
        assert defect(long.replace("paid", "paid.")) is None and P.before_trail(long) == "The council of the town paid"


def test_phrases():
    assert P.phrases("I'm sorry, but I can't help Ann Lee with 3 of them. Thank you!") == ["i'm sorry", "but i can't help # # with # of them", "# you"]
    assert P.phrases("HELLO! I CAN'T.") == ["hello", "i can't"] and P.phrases("") == [] and P.phrases("...") == []
    assert sum(len(p.split()) for p in P.phrases("word " * 100)) == P.OPENING

"""Spam pages of every kind, and honest texts that look a little like them."""

import pytest

from caseloom.llm.lang import language
from caseloom.llm.spam import spam_scores

PROSE = "The supplier shall deliver the storage tanks within thirty days after the notice, and the council that accepts them pays the fee. Neither party may assign the contract without the consent of the other, unless the law says so. "
FR = "Le fournisseur doit livrer les réservoirs dans un délai de trente jours après la notification, et la ville qui les accepte paie le montant. Aucune partie ne peut céder le contrat sans accord. "
WORDS = ["lease form", "nda template", "escrow service", "legal bot", "contract review", "clause finder"]
PHRASES = [f"{a} {w} {b}".strip() for w in WORDS for a in ("free", "best", "") for b in ("online", "near me", "pdf")]

SPAM = {
    "bars": " | ".join(["lease form"] * 40),
    "commas": ", ".join(PHRASES),
    "lines": "\n".join(PHRASES),
    "sentences": " ".join(f"Our nda template nda template offers {p} and nda template. Need nda template?" for p in PHRASES[:20]),
    "french": " ".join(f"Contrat de licence pour contrat de licence et {p}. Achetez contrat de licence, contrat de licence !" for p in ("modèle gratuit", "avis juridique", "outil pdf", "clause type") * 4),
    "tags": "\n".join("#" + p.title().replace(" ", "") for p in PHRASES),
    "links": "\n".join(f"* [{p}](https://a{i}.example/x/{i})" for i, p in enumerate(PHRASES)),
    "numbered": "\n".join(f"{i}. {p}: www.a{i}.example/y?id={i}" for i, p in enumerate(PHRASES)),
    "menu": "\n".join("Home > Pricing > Login > Forms > Contact > Blog > " + p for p in PHRASES),
    "products": "\n".join(f"SKU {1000 + i}-A {p} USD {i}5,990 Add to cart" for i, p in enumerate(PHRASES)),
    "shouting": " ".join(p.upper() if i % 2 else p for i, p in enumerate(PHRASES)),
    "short ends": ". ".join(PHRASES) + ".",
    "with prose": PROSE + "\n\n" + "\n".join(PHRASES),
}
HONEST = {
    "prose": PROSE * 4,
    "french prose": FR * 3,
    "same lines": "\n".join(f"Row X{i}: paid in cash, receipt kept in folder two." for i in range(30)),
    "form": "\n".join(f"Contact person: Ann Lee{i}, reachable under +00 555 0{i}\n- Email: a{i}@b.example" for i in range(9)),
    "table": "\n".join(f"| Alton{i} | {i}% | {i}00 ms |" for i in range(9)) + "\n\n" + PROSE,
    "references": PROSE * 2 + "\n" + "\n".join(f"[{i}] Alton, https://a{i}.example/x" for i in range(4)),
    "a list": PROSE * 3 + "\n" + "\n".join(f"- {p}" for p in PHRASES[:8]),
    "contents": "\n".join(f"Section {i}.{i} Exit Notice .... {i}" for i in range(9)) + "\n" + PROSE * 2,
    "some spam": PROSE * 8 + "\n" + "\n".join(PHRASES[:12]),
    "empty": "", "blank": " \n ", "null": None, "one word": "Contract",
}


def test_pages(spark):
    texts = SPAM | HONEST
    df = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id string, text string, lang string")
    share = {r.doc_id: r.spam_share for r in spam_scores(df, "doc_id", "text").collect()}
    assert {k: share[k] > 0.5 for k in texts} == {k: k in SPAM for k in texts}, share
    assert share["empty"] == share["blank"] == share["null"] == 0.0
    assert spam_scores(df.where("false"), "doc_id", "text").count() == 0


def test_repeated_rows_and_long_texts(spark):
    df = spark.createDataFrame([(1, PROSE * 2000), (1, PROSE * 2000), (2, ", ".join(PHRASES * 300))], "doc_id int, text string")
    rows = [(r.doc_id, r.spam_share > 0.5) for r in spam_scores(df, "doc_id", "text").collect()]
    assert sorted(rows) == [(1, False), (1, False), (2, True)]


@pytest.mark.parametrize(("text", "lang"), [(PROSE, "en"), (FR, "fr"), ("Der Händler muss den Bericht für die Firma binnen zwei Tagen erneuern.", "de"), ("El fabricante deberá entregar las piezas según la cláusula.", "es"), ("Да, договор требует", "ru"), ("該条款は、契約のとおり", "ja"), ("12345", None), ("", None)])
def test_language(text, lang):
    assert language(text) == lang


def test_repetition_dressed_as_sentences(spark):
    line = "You will find the best lease form for your company and the team here."
    long = "The supplier shall deliver the storage tanks within thirty days after the notice, and the council that accepts them pays the fee."
    varied = [f"{a} nda template {b}." for a in ("Get the", "We have an", "This is a", "They sell our") for b in ("for the firm", "that is good", "and an offer", "with the form", "on the page")]
    texts = {
        "sentences": " ".join([line] * 200), "lines": "\n".join([line] * 200), "long line": "\n".join([long] * 200), "phrase": " ".join(varied * 3),
        "german": " ".join(["Hier ist der beste Mietvertrag für die Firma und das Team."] * 50),
    }
    honest = {"prose": PROSE * 4, "twice": long + " " + long, "a refrain": "\n".join(f"{PROSE}\n{line}" for _ in range(4)), "a name": " ".join(f"The composer {x} wrote about the river in the year of {x} and sold copies (the Skokara Agreement)." for x in "abcdefgh")}
    df = spark.createDataFrame(list((texts | honest).items()) + [(f"p{i}", PROSE + FR) for i in range(80)], "doc_id string, text string")
    share = {r.doc_id: r.spam_share for r in spam_scores(df, "doc_id", "text").collect()}
    assert {k for k in share if share[k] > 0.5} == set(texts), share


OTHERS = {
    "it": ("Il fornitore deve consegnare i serbatoi entro trenta giorni dopo la notifica, e la città che li accetta paga la somma. Nessuna parte può cedere il contratto senza il consenso della altra. ", "modello contratto, contratto affitto, avvocato franchising, modulo gratuito"),
    "nl": ("De leverancier moet de tanks binnen dertig dagen na de kennisgeving leveren, en de gemeente die ze aanvaardt betaalt het bedrag. Geen partij mag het contract overdragen zonder dat de andere het weet. ", "huurcontract voorbeeld, gratis formulier, advocaat franchise, sjabloon pdf"),
    "ru": ("Поставщик должен передать оборудование в течение тридцати дней после уведомления, и город, который его принимает, платит эту сумму. Ни одна из сторон не может передать договор без согласия другой. ", "образец договора, договор аренды, юрист онлайн, бланк скачать"),
    "zh": ("供应商应当在通知之后的三十日之内交付储罐，而接受储罐的市政府将支付该笔款项。任何一方在没有另一方的同意时不得转让本协议，这是法律所要求的。", "合同模板，租赁合同，律师在线，免费下载"),
}


def test_languages_beyond_those_with_grammar(spark):
    rows = [(f"{lang} prose {i}", prose * (2 + i)) for lang, (prose, _) in OTHERS.items() for i in range(5)]
    rows += [(f"{lang} spam", "\n".join([", ".join([words] * 4)] * 10)) for lang, (_, words) in OTHERS.items()]
    rows += [(f"{lang} half", prose + "\n" + "\n".join(words.replace(", ", "\n").replace("，", "\n") for _ in range(12))) for lang, (prose, words) in OTHERS.items()]
    seen = {r.doc_id: r for r in spam_scores(spark.createDataFrame(rows, "doc_id string, text string"), "doc_id", "text").collect()}
    assert {k for k, r in seen.items() if r.spam_share > 0.5} == {k for k, _ in rows if not k.split()[1].startswith("prose")}, {k: r.spam_share for k, r in seen.items()}
    assert all(r.language == k[:2] for k, r in seen.items() if "prose" in k)


def test_top_word_and_single_lines(spark):
    word = " ".join(f"{a} escrow {b} escrow {c}." for a in ("The best", "An honest", "This quick") for b, c in (("is an", "for the firm"), ("and the", "of our team"), ("with a", "on that page"), ("as your", "by the hour")))
    short = "Buy forms. Get forms. New forms. Top forms."  # a line of less than 60 characters holds sentences too
    df = spark.createDataFrame([("word", word), ("short", "\n".join([short] * 6)), *[(f"p{i}", PROSE + FR) for i in range(40)]], "doc_id string, text string")
    assert {r.doc_id for r in spam_scores(df, "doc_id", "text").where("spam_share > 0.5").collect()} == {"word", "short"}

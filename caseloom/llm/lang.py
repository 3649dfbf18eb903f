"""Languages told by their short words and scripts."""

from __future__ import annotations

import re

# fixed values: frequent short words by language, chosen so that the languages tell apart
WORDS: dict[str, frozenset[str]] = {
    lang: frozenset(words.split())
    for lang, words in {
        "en": "a the of and to in is that for it was with as on be by this are from at or an which not have has had its but they their been were will would can could should who what when there any all under into within than other such these those does do did may shall must if you your i we my our me how many where no yes unless before after because",
        "fr": "le la les de du des et à un une que qui dans pour est au aux sur par ne pas se ce cette il elle ils sont été avec son sa ses ou où plus mais ont être sous selon d’après sans leur entre jusqu’en quand aucun aucune cet ces doit peut oui non je nous vous mes mon ma ici donner suis absolument certainement aucunement",
        "de": "der die das und den dem des ein eine einer eines einem einen ist nicht von für mit zu auf im in nach bis sich auch als an aus bei durch wird werden wurde ist sind war dass oder über unter vom zum zur keine kein nur noch wenn ich wir mir meine ihr sie es hier darf kann ohne gegenüber binnen gemäß siehe ja nein laut eindeutig keineswegs eher sicher gewiss doch klar durchaus",
        "es": "el la los las de del y a en un una que es por para con no se su sus lo al como más pero ha fue son este esta cada según sin sobre entre desde hasta cuando o ni muy ya también donde quién qué puede debe deberá sí yo mi mis me aquí porque ningún ninguna tras véase quedan hay duda absoluto creo claro seguro",
        "it": "il lo la gli le di del della dei delle e che è un una uno in per con non si da dal dalla al alla sono stato fu più ma anche come o ogni questo questa secondo nel nella sul sulla degli agli sì no niente ho mi dopo entro fino senza certamente affatto",
        "pt": "o a os as de do da dos das e em um uma que é por para com não se no na nos nas ao à foi são mais mas como ou pelo pela segundo até sem sobre entre quando você seu sua esta este também já sim construída trecho prevê deve pode muito nem",
        "nl": "de het een en van in op te dat is voor met niet aan zijn er door om bij ook als tot uit werd wordt naar over dan of maar per volgens binnen geen ja nee deze dit die aan heeft kan moet mag onder na zonder zeker beslist",
        "sv": "och att det som en ett är på av för med den till inte har de om var vid från eller kan ska enligt inom under efter utan ja nej jag inget ingen detta denna skall måste",
        "da": "og at det som en et er på af for med den til ikke har de om var ved fra eller kan skal ifølge inden under efter uden ja nej jeg ingen dette denne blev",
        "no": "og at det som en et er på av for med den til ikke har de om var ved fra eller kan skal ifølge innen under etter uten ja nei jeg ingen dette denne ble",
        "fi": "ja on ei se että oli hän mutta kun kuin sen ovat joka mukaan tai jos niin vain myös ole kyllä sopimus jälkeen ennen ilman kanssa",
        "pl": "i w na z do nie się że jest to o za od po dla przez jak był była są oraz który która które tak co ale lub według umowa zgodnie bez przed tego tej",
        "cs": "a v na se je že s z do o to za k od po pro by jako byl byla jsou které který podle nebo ale ano ne smlouva bez před této toho",
        "hu": "a az és hogy nem is egy van volt ez meg csak de már szerint el mint vagy igen ha ki szerződés után alatt között",
        "ro": "și în de la cu pe nu se că este un o din pentru care sunt a fost al ale mai sau conform prin după fără da nu este contractul",
        "tr": "ve bir bu da de için ile olarak göre değil çok daha olan en ne gibi kadar var yok evet hayır sonra sözleşme tarafından",
        "la": "et in est non ad ut cum sed qui quae quod ex ab per sunt aut nec enim",
        "id": "yang dan di dari untuk dengan pada ini itu tidak adalah ke dalam oleh atau akan menurut ya kontrak",
    }.items()
}

# fixed values: words that make a sentence rather than a search phrase (articles, pronouns, auxiliaries, conjunctions)
GRAMMAR: dict[str, frozenset[str]] = {
    lang: frozenset(words.split())
    for lang, words in {
        "en": "the a an and or that which who whose this these those it its they their them he his she her is are was were be been being has have had will would shall must may can could should cannot not if when while because since although but than as by with from into at on under after before until unless any each all neither nor either both between such other to",
        "fr": "le la les un une et ou que qui dont ce cet cette ces il elle ils elles on se son sa ses leur leurs est sont était été sera seront a ont avait doit doivent peut ne pas si quand lorsque mais car comme avec dans sur par sous selon après avant jusqu’au jusqu’en dès au aux l d qu n s c",
        "de": "der die das den dem des ein eine einen einem einer eines und oder dass welche welcher welches dieser diese dieses diesem diesen er sie es sich sein seine ihr ihre ist sind war waren wurde wurden wird werden hat haben darf muss kann nicht kein keine wenn während weil aber als mit von vom nach bei bis durch auf im zum zur in an gegenüber binnen sofern",
        "es": "el la los las un una y o que quien cuyo este esta estos estas ese esa él ella se su sus lo le es son era fue fueron ser ha han debe deberá puede no si cuando mientras pero como con en por según tras hasta desde al del sobre entre cada ni",
    }.items()
}

# fixed values: the same for languages told by their script; Chinese and Japanese by characters
_SCRIPTED: dict[str, str] = {
    "ru": "и в во на с со не что по как он она они это этот для от из к у за то же но так или если когда который которая которые был была были его их мы я все при до после",
    "el": "ο η το οι τα του της των τον την και να σε με για από που ότι δεν είναι ήταν θα στο στη στην στον ή αν όταν μετά πριν",
    "zh": "的 是 在 和 了 有 不 为 與 与 或 以 及 将 将 由 其 该 該 之 于 並 并 也 就 而 被 把 从 向 对 如 若 时 后 前 所 者 这 那 我 你 他 们",
    "ja": "の は が を に へ と で も や か ら り る た て な い し す こ そ あ れ さ ま",
    "ko": "이 그 저 것 수 및 또는 그리고 에 를 을 는 은 의 가",
}
#: Words that make a sentence, of every language that has a list.
FUNCTION: dict[str, frozenset[str]] = WORDS | {k: frozenset(v.split()) for k, v in _SCRIPTED.items()} | GRAMMAR
#: Scripts without spaces: their characters count as words.
SPACELESS = frozenset(("zh", "ja"))

WORD = re.compile(r"[^\W\d_]+(?:[’'][^\W\d_]+)?")
SCRIPTS = (
    ("zh", re.compile(r"[一-鿿]")),
    ("ja", re.compile(r"[぀-ヿ]")),
    ("ko", re.compile(r"[가-힯]")),
    ("ru", re.compile(r"[Ѐ-ӿ]")),
    ("el", re.compile(r"[Ͱ-Ͽ]")),
    ("ar", re.compile(r"[؀-ۿ]")),
    ("he", re.compile(r"[֐-׿]")),
    ("hi", re.compile(r"[ऀ-ॿ]")),
    ("th", re.compile(r"[฀-๿]")),
)
LATIN = re.compile(r"[A-Za-zÀ-ɏ]")


LANGUAGES_OF: dict[str, tuple[str, ...]] = {}
for _lang, _words in WORDS.items():
    for _w in _words:
        LANGUAGES_OF[_w] = (*LANGUAGES_OF.get(_w, ()), _lang)


def scores(words: list[str]) -> dict[str, int]:
    """How many of the words (lower case) are short words of each language."""
    out: dict[str, int] = {}
    for w in words:
        for lang in LANGUAGES_OF.get(w, ()):
            out[lang] = out.get(lang, 0) + 1
    return out


def _by_script(text: str) -> tuple[str, int] | None:
    """The script other than Latin that has at least a fifth of the letters (kana before Han), and its letters."""
    other = [(name, n) for name, pattern in SCRIPTS if (n := len(pattern.findall(text)))]
    if not other:
        return None
    name, n = max(other, key=lambda x: x[1])
    if n * 4 < len(LATIN.findall(text)) and n < 12:
        return None
    return ("ja" if name == "zh" and any(x == "ja" for x, _ in other) else name), n


def script(text: str) -> str | None:
    """The language that the letters of a text tell, if most of them aren't Latin."""
    found = _by_script(text)
    return found[0] if found and found[1] >= len(LATIN.findall(text)) else None


def evidence(text: str) -> dict[str, int]:
    """Words (or letters of a script) that speak for each language.

    A script other than Latin that has at least a fifth of the letters decides by itself (kana before Han).
    """
    if not text.isascii() and (found := _by_script(text)):
        return dict([found])
    words = WORD.findall(text.lower().replace("'", "’"))
    found = scores(words)
    if "’" in text or "'" in text:
        elided = sum(w[1:2] == "’" and w[0] in "ldnsjcmtq" for w in words)  # elided articles: l’article, d’après
        if elided:
            found["fr"] = found.get("fr", 0) + elided
    return found


def language(text: str) -> str | None:
    """The language of a text; None if nothing tells."""
    found = evidence(text)
    return max(found, key=lambda x: (found[x], x in GRAMMAR, x)) if found else None

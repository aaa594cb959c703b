"""Broken prompt and response pairs: empty, copying, refusing, wrong-language and truncated answers.

Prompt and response are aligned as token sequences. Copies: containment of the response's shingles in the prompt finds
possible ones, the longest common subsequence confirms them. Refusals: templates are sequences of notions (I, can, not, help,
may, rules, beyond, ...), each notion a few stems in each language; a sentence is aligned with every template by a longest
common subsequence that pays for gaps and may leave slots out, so wordings that nobody listed fit as well. Against the best
alignment stands the substance of the answer: what it says beyond the question in words that are commoner in ordinary
answers than in declining ones, as counted over the corpus. Languages: the n-gram model of the document languages, for
question and answer. Truncation is read off the tail: prose that ends without a closing mark, fewer list items than the
answer announces, and list items that end as no complete list item of the corpus does (counts over all answers).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redolent.llm import language
from redolent.session import materialize

#: Words that a placeholder for nothing is made of, folded; one of the first list must be among them.
NOTHING = frozenset("na n none null nil nan undefined empty blank missing tbd todo noanswer noresponse noreply answer answered response reply br keineantwort antwort cevap yanit respuesta reponse risposta nichts yok vacio vide leer vuoto".split())
AROUND = frozenset("a no not yet available applicable provided given found here the is was keine kein sin pas de aucune nessuna p".split())
#: The notions of refusals by their stems, folded, in en, de, fr, es, it, pt and tr; * stands for any ending.
NOTIONS = {
    "self": "i im ive id we us me my myself mine our assistant* ai bot model ich mir mich wir uns mein* assistent* je j moi nous mon ma mes assistente modele yo nosotros mi mis asistente modelo io noi mio mia miei nao eu ben biz bana asistan* benim",
    "not": "not t no never cannot cant wont dont none nothing neither nor unable without isnt nicht nichts kein* nie weder ohne ne n pas aucun* rien jamais sans non nunca ningun* nada sin tampoco nessun* nulla niente mai nao nunca degil* yok* hicbir* hic olmaz",
    "can": "can could able capable capacity cannot cant unable possible kann konnen konnte imstande lage moglich peux pouvons pouvoir puis saurais sais capable mesure possible puedo podemos poder podria capaz posible posso possiamo grado potrei consigo podia",
    "wish": "want wish willing will won wont would prefer* rather going care intend inclined mochte* will wollen wollte bevorzuge lieber bereit veux voulons souhait* prefer* tiens envie aimerais quiero queremos prefier* prefer* deseo gustaria voy vamos voglio vorrei desidero prefiro quero gostaria ister* tercih* niyetinde* dusunm*",
    "act": "help* assist* answer* respond* repl* advis* advice recommend* suggest* comment* provid* offer* giv* discuss* talk* speak say* tell* opinion* opin* weigh* pronounce engag* address* do make serve handle take accept* fulfil* fulfill* comply choos* choice* decid* pick* guidance guid* helf* weiterhelf* beantwort* antwort* empfehl* rate raten rat beraten auskunft sag* aussern* geb* abgeb* urteil* erteil* machen tun meinung bedienen nachkomm* unterstutz* wahl* auswahl* aid* repon* conseil* recommand* donn* dire prononc* parler avis commenter proposer faire traiter chois* ayud* respond* contest* recomend* aconsej* decir opinar opinion* dar doy hablar ofrec* hacer atender pronunciarme eleg* escog* aiut* rispond* consigli* raccomand* dire dare parlare esprim* fornir* ajud* recomend* aconselh* yardim* cevap* yanit* oner* tavsiye* yorum* soyle* fikir* gorus* konus* bilgi* destek* secmek secim*",
    "decline": "declin* refus* pass skip* abstain* refrain* abstention turn opt bow sit stay steer dodge avoid* withhold* sidestep leave reject* deny denied weiger* verweiger* ablehn* abzulehnen abgelehnt lehn* absag* enthalt* zuruckhalt* verzicht* passe passen refus* declin* abstien* absten* ecart* evit* rechaz* niego negar* declin* absteng* abstener* evit* rehus* rifiut* declin* asteng* asten* recus* reddet* redded* cekimser kacin* geri cevir*",
    "allow": "allow* permi* permission* authori* licens* supposed entitled cleared darf durfen durfte erlaub* berechtigt befugt gestattet zulassig zugelassen autoris* permis* permet* droit habilit* autoriz* permit* permis* derecho autorizz* permess* consent* izin* izni* yetki* musaade*",
    "rule": "guideline* polic* rule* restriction* instruction* terms regulation* limits richtlinie* regel* vorgaben vorschrift* bestimmung* regle* politique* consigne* directive* norma* regla* politica* directri* instruccion* regole regola politica linee kural* ilke* politika* yonerge* talimat*",
    "forbid": "against forbid* prohibit* prevent* prohibi* bar* stop* violat* contrary gegen verbiet* verbot* untersag* widersprich* verstoss* hinder* contre interdi* empech* contra prohib* impid* prohib* contro viet* impedis* aykiri yasak* engel* izin*",
    "fit": "comfortable comfort position place qualified equipped ready prepared meant designed able expertise competent competence business job role right suited wohl lage position recht stelle qualifiziert zustandig kompetent aufgabe gedacht vorgesehen aise mesure position place role qualifie competent* habilite preparado condiciones posicion comod* competente cualificado lugar agio grado posizione preparato competente rahat konum* yetkin* uygun gorev* isim",
    "beyond": "beyond outside out scope remit past above exceed* league limits fur ausserhalb ubersteig* jenseits uberfordert hors dehors depass* dela portee perimetre fuera alla supera* excede* alcance fuori oltre supera* ambito disinda disi* asiyor asar kapsam*",
    "matter": "this that it these those request* question* one topic subject matter query anfrage* frage* thema bitte sache das dies* hier dazu daruber davon cela ca ce cette demande question* sujet esto eso esta este peticion pregunta* tema solicitud consulta questo questa richiesta domanda argomento pedido bu bunu bunun buna istek* istegi* soru* konu* talep* talebi*",
}
#: Refusals as sequences of notions.
TEMPLATES = tuple(tuple(t.split()) for t in """self can not act|can self not act|can not self act|self not can act|not can act|act can self not|matter can self not act|matter not act self can
self decline|decline self|decline matter|self wish decline matter
self wish not act|self not wish act|wish self not act|matter wish self not act|self act not wish
self not allow act|allow self not act|self allow not|not self allow|matter not allow|rule not allow|self allow matter not|not allow act
matter forbid rule|rule forbid act|rule forbid matter|forbid self rule|rule self forbid
self not fit act|not fit act|fit self not act|self not fit|matter not self fit
matter beyond self|beyond self matter|self beyond act|matter beyond rule|beyond self act
self not act act|self act not act|act act not self|act not act self|matter self not act""".replace("\n", "|").split("|"))
#: What an answer can't do about a fact, which is no refusal, and how it says that nothing fits.
FACTS = "verif* confirm* find* found see determin* establish* locat* check* matches match fits bestatig* finde* prufen ermittel* feststell* confirm* verifi* trouv* determin* confirm* verific* encontr* hall* determin* confermar* trov* verific* dogrul* bulam* teyit* saptay* eslesm* uyan uymuy*"
NO_MATCH = re.compile(r"\b(no|none|nothing|not one|neither|kein\w*|nichts|aucun\w*|rien|ningun\w*|nada|nessun\w*|hicbir\w*)\b(?: \w+){0,7}? (match\w*|fit|fits|meet\w*|satisf\w*|qualif\w*|pass\w*|erfull\w*|entsprech\w*|entspricht|correspond\w*|convien\w*|cumpl\w*|coincid\w*|encaj\w*|corrispond\w*|uy\w*|eslesm\w*|karsilam\w*)\b")
#: A refusal's alignment less SHARE times its substance is at least LEAST; a gap word costs GAP, a fact verb FACT,
#: a sentence without anything to decline (only I, not, can and the like) BARE.
LEAST, SHARE, GAP, FACT, BARE = 0.62, 0.04, 0.03, 0.3, 0.15
#: Weight of each notion in a template; the others have 1.
WEIGHT = {"self": 0.5, "matter": 0.5}
#: Most that one word counts as substance, and what its log ratio must exceed.
MOST, OVER = 2.0, 1.0
#: Nats of tempered likelihood by which the answer must fit its language better than the question's, and the question its own than any other.
CLEAR = 2.0
#: The languages' names, folded, as a question asks for one.
NAMED = {
    "en": frozenset("english ingilizce englisch anglais ingles".split()),
    "tr": frozenset("turkish turkce turkisch turc turco".split()),
    "de": frozenset("german almanca deutsch allemand aleman".split()),
    "fr": frozenset("french fransizca franzosisch francais frances".split()),
    "es": frozenset("spanish ispanyolca spanisch espagnol espanol".split()),
    "it": frozenset("italian italyanca italienisch italien italiano".split()),
    "pt": frozenset("portuguese portekizce portugiesisch portugais portugues".split()),
    "nl": frozenset("dutch hollandaca niederlandisch neerlandais holandes neerlandes".split()),
    "ru": frozenset("russian rusca russisch russe ruso".split()),
}
_WORDS = re.compile(r"[^\W_]+")
#: Record cards: a marked block up to an empty line, wherever it stands, and lines of "key: value | key: value".
_CARDS = re.compile(r"\[PERFUMES\].*?(?:\n\s*\n|\[/PERFUMES\]|\Z)\s*|^[^\n|:]{1,40}:[^\n|]*\|[^\n|:]{1,40}:[^\n]*$", re.DOTALL | re.IGNORECASE | re.MULTILINE)
_TAG = re.compile(r"<[^<>]*>")
_ITEM = re.compile(r"^\s*(?:[-•*–·]|\d+\s*[.)])\s*\S")
_CUT = re.compile(r"\s*(?:\[\w*\.*\]?|<\w*|\(\w*|…|\.\.\.+)\s*$")


@lru_cache(maxsize=100_000)
def _letters(word: str) -> str:
    low = word.lower().replace("\u0307", "").replace("ß", "ss")
    return low if low.isascii() else "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c)).replace("ı", "i")


def raw_words(text: str) -> list[str]:
    """Runs of letters and digits in compatibility form, as written."""
    return _WORDS.findall(text if text.isascii() else unicodedata.normalize("NFKC", text).replace("\u0307", ""))


def tokens(text: str) -> list[str]:
    """Words: runs of letters and digits without case, marks or compatibility forms."""
    return [_letters(w) for w in raw_words(text)]


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits: one big-integer step a token."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def shingles(words: list[str], n: int = 3) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def is_empty(answer: str | None) -> bool:
    """Absent, blank, only marks, or a placeholder for nothing."""
    if answer is None:
        return True
    if len(answer) > 400:
        return answer.isspace() or not tokens(answer)
    words = tokens(_TAG.sub(" ", answer)) or tokens(answer) * bool(_TAG.sub("", answer).strip("\u200b\ufeff \t\r\n"))
    return not words or (all(w in NOTHING or w in AROUND for w in words) and any(w in NOTHING for w in words)) or "".join(words) in NOTHING


def _matcher(stems: str) -> re.Pattern:
    return re.compile("|".join(x[:-1] + r"\w*" if x.endswith("*") else x for x in dict.fromkeys(stems.split())))


_BITS = {k: 1 << i for i, k in enumerate(NOTIONS)}
_STEMS = [(_BITS[k], _matcher(v)) for k, v in NOTIONS.items()]
_ACTS = sum(_BITS[k] for k in ("act", "decline", "allow", "rule", "forbid", "fit", "beyond"))
_FACT, _FACTS = 1 << len(_BITS), _matcher(FACTS)
#: Turkish verbs in the first person say not, can't and I in their endings.
_CANT = re.compile(r"\w+?(?:ama|eme)(?:m|yiz|yacag\w*|yeceg\w*)|\w+?(?:a|e)m[iu]yor(?:um|uz)")
_DONT = re.compile(r"\w+?m[iu]yor(?:um|uz)|\w+?(?:ma|me)(?:m|yiz|yacag[iu]\w*|yeceg[iu]\w*)|\w+?m(?:amay|emey)\w*")
_LIGHT = re.compile(r"(?:ver|yap|et|ed|ol|getir|bulun|kal|al)\w*")
_SLOTS = tuple((tuple(_BITS[n] for n in t), tuple(WEIGHT.get(n, 1.0) for n in t)) for t in TEMPLATES)


@lru_cache(maxsize=100_000)
def notions(word: str) -> int:
    """The notions of a folded word, as bits."""
    bits = sum(b for b, p in _STEMS if p.fullmatch(word))
    if _FACTS.fullmatch(word):
        bits |= _FACT
    elif len(word) > 4 and (cant := bool(_CANT.fullmatch(word)) or bool(_DONT.fullmatch(word))):
        bits |= _BITS["not"] | _BITS["self"] | (_BITS["can"] if _CANT.fullmatch(word) else _BITS["wish"])
        if cant and _LIGHT.fullmatch(word):
            bits |= _BITS["act"]
    return bits


def alignment(slots: tuple[int, ...], weights: tuple[float, ...], sentence: list[int]) -> float:
    """Share of a template's weight that a sentence has in order, less GAP for each word between; a word may fill several slots."""
    best = 0.0
    ends: dict[int, float] = {}  # for each number of slots done with: the best weight so far, brought back to the start of the sentence
    for at, bits in enumerate(sentence):
        if not bits:
            continue
        states = {0: 0.0} | {state: v for state, back in ends.items() if (v := back - GAP * at) > 0.0}
        for state, have in states.items():
            v, left = have, bits
            for k in range(state, len(slots)):  # fill the next slots with the word's notions, once each, leaving out those it doesn't fit
                if slots[k] & left:
                    v, left = v + weights[k], left & ~slots[k]
                    ends[k + 1] = max(ends.get(k + 1, 0.0), v + GAP * (at + 1))
                    best = max(best, v)
    return best / sum(weights)


def decline(sentence: list[str]) -> float:
    """How well a sentence (folded words) fits the best refusal template."""
    bits = [notions(w) for w in sentence]
    there = 0
    for b in bits:
        there |= b
    best = 0.0
    for slots, weights in _SLOTS:
        bound = sum(w for s, w in zip(slots, weights, strict=True) if s & there) / sum(weights)
        if bound > max(best, LEAST):
            best = max(best, alignment(slots, weights, bits))
    return best - (FACT if there & _FACT else 0.0) - (0.0 if there & _ACTS else BARE)


def declines(answer: str) -> float:
    """The best fit of a sentence of the answer."""
    return max((decline(w) for x in re.split(r"(?<=[.!?;])\s+|\n+", answer) if (w := tokens(x))), default=0.0)


def digits_alike(word: str) -> str:
    return re.sub(r"\d", "0", word) if any(c.isdigit() for c in word) else word


def substance(asked: set[str], answer: str, weights: dict[str, float]) -> float:
    """What an answer says beyond the question: the weights of its other words, and names (two words with a capital side by side)."""
    total, seen, before = 0.0, set(), False
    for raw in raw_words(answer):
        word = _letters(raw)
        if word in seen or word in asked:
            before = False
            continue
        seen.add(word)
        total += weights.get(digits_alike(word), 0.0)
        capital = raw[0].isupper() and not raw.isupper()
        total += capital and before
        before = capital
    if NO_MATCH.search(" ".join(tokens(answer))):
        total += 2 * MOST
    return total + sum(bool(_ITEM.match(x)) for x in answer.split("\n"))


def is_refusal(question: set[str], answer: str, weights: dict[str, float]) -> bool:
    """Declines and gives nothing: the best template's fit outweighs the substance. question: its words, folded."""
    said = substance(question, answer, weights)
    if 1.0 - SHARE * said < LEAST:  # no fit is above 1
        return False
    return declines(answer) - SHARE * said >= LEAST


def is_copy(question: list[str], answer: list[str]) -> bool:
    """Gives the question back, fully or nearly, and adds nothing. Both as folded words."""
    there = set(question)
    if not answer or not question or sum(w in there for w in answer) < 0.75 * len(answer):  # no subsequence is longer
        return False
    sa, sq = shingles(answer), shingles(question)
    if len(sa & sq) < 0.4 * len(sa):
        return False
    both = lcs(question, answer)
    return both >= 0.75 * len(answer) and both >= 0.6 * len(question)


def telling(text: str) -> list[str]:
    """The words that tell a text's language: those without a capital, as names have one; of short texts also the first of each sentence.

    None for a text of capitals only in up to three words: that is a name."""
    own = [w for w in raw_words(text) if w.isalpha()]
    small = [w for w in own if w.islower()]
    if len(small) < 6:
        first = [w for x in re.split(r"(?<=[.!?:])\s+|\n+", text) if (f := [w for w in raw_words(x) if w.isalpha()]) for w in f[:1] if not w.islower()]
        if small or len(own) > 3:
            small += [w.lower() for w in first]
        if len(small) < 2 and len(own) > 3:
            small = [w.lower() for w in own]
    return small


def other_languages(pairs_: list[tuple[str, str]], model: language.Model) -> list[bool]:
    """For each (question without cards, answer): answered in another language than asked in, unless the question names that language."""
    q, a = [telling(x) for x, _ in pairs_], [telling(y) for _, y in pairs_]
    some = [i for i in range(len(pairs_)) if q[i] and a[i]]
    out = [False] * len(pairs_)
    if not some:
        return out
    sq, sa = model.scores([q[i] for i in some]), model.scores([a[i] for i in some])
    of_q, of_a = sq.argmax(axis=1), sa.argmax(axis=1)
    rows = np.arange(len(some))
    margin_q = sq.max(axis=1) - np.partition(sq, -2, axis=1)[:, -2] if sq.shape[1] > 1 else np.zeros(len(some))
    apart = (of_q != of_a) & (margin_q >= CLEAR) & (sa[rows, of_a] - sa[rows, of_q] >= CLEAR)
    for r in np.flatnonzero(apart).tolist():
        i = some[r]
        named = NAMED.get(model.langs[of_a[r]], frozenset())
        out[i] = not any(w.startswith(n) for w in tokens(pairs_[i][0]) for n in named)
    return out


def line_end(line: str) -> str:
    """The last two words of a line without closing symbols, digits made alike."""
    words = re.findall(r"[\w.,]*\w", unicodedata.normalize("NFKC", line).lower())
    return re.sub(r"\d", "0", " ".join(words[-2:]))


def _bare(text: str) -> str:
    """Without pictures, symbols and white space at the end."""
    end = len(text)
    while end and (text[end - 1].isspace() or unicodedata.category(text[end - 1]) in ("So", "Sk", "Cf", "Mn", "Cn", "Co")):
        end -= 1
    return text[:end]


def is_truncated(answer: str, ends: frozenset[str]) -> bool:
    """Breaks off in a word, a sentence or a list item. ends: how complete list items of the corpus end."""
    text = _bare(answer)
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return False
    items = [bool(_ITEM.match(x)) for x in lines]
    if any(items):
        at = items.index(True)
        told = re.findall(r"(?<![\w.,])([2-9]|1\d)(?![\w.,])", lines[at - 1]) if at and lines[at - 1].rstrip().endswith(":") else []
        if len(told) == 1 and sum(items) < int(told[0]):
            return True
    open_end = _bare(_CUT.sub("", text))
    if re.search(r"[.!?。！？][\"”’»')\]*_]*$", open_end):
        return False
    if not items[-1]:
        return not re.search(r"[\"”»]$", open_end)
    last = open_end.split("\n")[-1]
    end = line_end(last)
    known = ends | {line_end(x) for x in lines[:-1] if _ITEM.match(x)}
    if open_end != text or end not in known:
        word = end.split()[-1] if end else ""
        slip = open_end == text and any(len(word) >= len(k) and len(k) > 4 and k[:3] == word[:3] and abs(len(word) - len(k)) < 2 and sum(x != y for x, y in zip(word, k, strict=False)) < 3 for k in {e.split()[-1] for e in known if e})
        return not slip
    return False


class Known(NamedTuple):
    """What the corpus tells: how complete list items end, the substance of words, and the language model (None: languages aren't asked)."""

    ends: frozenset[str] = frozenset()
    weights: dict[str, float] = {}
    model: language.Model | None = None


def defects(questions: list[str | None], answers: list[str | None], known: Known) -> list[str | None]:
    """The defect of each pair, null if it has none; of several, the one that leaves least of the answer."""
    out: list[str | None] = [None] * len(answers)
    later: list[int] = []
    asked: dict[int, str] = {}
    for i, (question, answer) in enumerate(zip(questions, answers, strict=True)):
        if is_empty(answer):
            out[i] = "empty"
            continue
        words = tokens(answer)
        whole = tokens(question) if question else []
        bare = _CARDS.sub("", question) if question else ""
        own = tokens(bare) if bare != question else whole
        if is_copy(own, words) or (own is not whole and is_copy(whole, words)):
            out[i] = "copy"
        elif is_refusal(set(whole), answer, known.weights):
            out[i] = "refusal"
        else:
            later.append(i)
            asked[i] = bare
    if known.model is not None:
        for i, other in zip(later, other_languages([(asked[i], answers[i]) for i in later], known.model), strict=True):
            if other:
                out[i] = "language"
    for i in later:
        if out[i] is None and is_truncated(answers[i], known.ends):
            out[i] = "truncated"
    return out


def defect(question: str | None, answer: str | None, known: Known) -> str | None:
    """The defect of one pair."""
    return defects([question], [answer], known)[0]


def pairs(messages: DataFrame) -> DataFrame:
    """(sample_id, question, answer): one row a record. Rows delivered twice count once (the latest by ingested_at); a null
    sample_id is no record; a record without an answer row has a null answer."""
    latest = F.struct("ingested_at", "content")
    by = messages.where("sample_id IS NOT NULL AND role IN ('user', 'model', 'assistant')").select("sample_id", F.when(F.col("role") == "user", latest).alias("u"), F.when(F.col("role") != "user", latest).alias("a"))
    return by.groupBy("sample_id").agg(F.max("u").alias("u"), F.max("a").alias("a")).select("sample_id", F.col("u.content").alias("question"), F.col("a.content").alias("answer"))


def learn(messages: DataFrame, share: float = 1 / 20_000, least: int = 3) -> tuple[frozenset[str], dict[str, float]]:
    """(ends, weights) from one pass over all answers.

    ends: how list items end that are followed by another line. weights: the substance of a word, the log of its share of the
    words of ordinary answers over that of answers which decline (alignment alone, in at most two sentences), less OVER, at
    most MOST. Ends and words that make up less than a share of all are left out, so there are at most 1 / share of each,
    whatever the corpus; they are counted over all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[tuple[str, str]] = Counter()
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                words = [digits_alike(w) for w in tokens(text)]
                short = text.count("\n") == 0 and len(re.findall(r"[.!?](?:\s|$)", text)) <= 2
                kind = "declining" if short and declines(text) >= LEAST else "ordinary"
                counts.update((kind, w) for w in words)
                counts.update(("end", line_end(x)) for x in text.split("\n")[:-1] if _ITEM.match(x))
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([w for _, w in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], names=["kind", "word", "n"])

    answers = messages.where("role IN ('model', 'assistant') AND content IS NOT NULL").select("content")
    counts = materialize(answers.mapInArrow(run, "kind string, word string, n long").groupBy("kind", "word").agg(F.sum("n").alias("n")), "words")
    totals = {r.kind: r.n for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    enough = F.lit(False)
    for kind, n in totals.items():
        enough = enough | ((F.col("kind") == kind) & (F.col("n") > max(least - 1, share * n)))
    found: dict[str, dict[str, int]] = {"end": {}, "ordinary": {}, "declining": {}}
    for r in counts.where(enough).collect():
        found[r.kind][r.word] = r.n
    few = 50.0  # words of declining answers that stand for those not seen
    all_o, all_d = max(1, totals.get("ordinary", 0)), totals.get("declining", 0) + few
    weights = {}
    for w, n in found["ordinary"].items():
        ratio = math.log(n / all_o) - math.log((found["declining"].get(w, 0) + few * n / all_o) / all_d) if all_d > few else 2 * OVER
        if ratio > OVER:
            weights[w] = min(MOST, ratio - OVER)
    return frozenset(found["end"]), weights


def defective_pairs(messages: DataFrame, model: language.Model | None = None) -> DataFrame:
    """(sample_id, defect): one row for each record whose answer is unusable.

    model: of language.fit; without one languages aren't compared. Null roles and contents, empty and very long texts,
    repeated rows and records without a question are fine: without a question an answer can be empty, a refusal or
    truncated only. An empty table gives no rows. One shuffle by record.
    """
    ends, weights = learn(messages)
    shared = messages.sparkSession.sparkContext.broadcast((ends, weights, model and (model.langs, model.table)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ends, own_weights, own_model = shared.value
        known = Known(own_ends, own_weights, language.Model(*own_model) if own_model else None)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                ids, questions, answers = (c.to_pylist() for c in batch.slice(at, 1000).columns)
                found = [(k, d) for k, d in zip(ids, defects(questions, answers, known), strict=True) if d]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([d for _, d in found], pa.string())], names=["sample_id", "defect"])

    return pairs(messages).mapInArrow(run, "sample_id long, defect string")

"""Answers that are no proper reply: empty, truncated, refusing, copied from the question, or in another language."""

from __future__ import annotations

from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from veldspar.llm.common import one_row_each

_re = cache(regex.compile)

# Markers for a missing value, as words
MISSING = frozenset("none null nil nan na n/a undefined empty blank missing void".split()) | {"no answer", "no response", "no reply", "not available", "not applicable", "no data", "(none)"}
# Frequent words by language
FREQUENT = {
    "en": "the a an of and to in is was are for that with by on at this not be as which from it what when how does do why where who can some each between if than more only before explain compare tell give my your have has i you",
    "de": "der die das und ist nicht ein eine einen dem den des im in zu von mit auf für dass wird werden aus bei nach aber auch wie warum wann wer wo wenn sich ich man kann nur seit laut was welche welcher braucht lange",
    "fr": "le la les un une des du de et est pas que qui dans pour sur par avec ne se ce cette au aux en mais il elle on après où quand comment pourquoi combien selon depuis sont je quel quelle temps faut fait",
    "es": "el la los las un una de del y es no que en por para con se su al lo pero como cuando cuánto qué según desde falta está son después dónde quién más sigue solo aunque sabe tarda hace",
    "it": "il lo la i gli le un una di del della dei e è non che in per con si al ma come quando quanto perché dopo secondo dall' sono dove chi più solo cosa viene abbiamo manca anche nel della sa serve fa succede",
    "ru": "и в не на что с по как это из за к от у но для а о то же так только где когда почему сколько после известно тем следует нужно если при хотя бы чем кто его через было",
}
WORDS_OF = {lang: frozenset(words.split()) for lang, words in FREQUENT.items()}
# Names of languages, as a question may ask for them
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés ingles inglese английском английский",
    "de": "german deutsch allemand alemán aleman tedesco немецком немецкий",
    "fr": "french französisch francais français francés frances francese французском французский",
    "es": "spanish spanisch espagnol español espanol spagnolo испанском испанский",
    "it": "italian italienisch italien italiano итальянском итальянский",
    "ru": "russian russisch russe ruso russo русском русский",
}
LANGUAGE_OF = {name: lang for lang, names in LANGUAGE_NAMES.items() for name in names.split()}
# Abbreviations that end in a full stop
ABBREVIATIONS = frozenset("dr mr mrs ms prof st no nr vs etc approx e.g i.e z.b d.h p.ej rev fig vol ca bzw usw sig av".split())
# Words that a phrase does not end with
OPEN_WORDS = frozenset(
    "a an the of and or to in is was are for that with by on at this as which from than between if when because whether but its their his her our my your into near about per via without "
    "der die das den dem und oder ein eine einen im zu von mit auf für dass aus bei aber wenn weil "
    "le la les un une des du de et ou dans pour sur par avec que qui mais au aux si "
    "el los las del y o en por con pero al su il lo i gli di della dei e per ma che nel "
    "и в на что с по как из за к от у но для а о".split()
)
# Ways to open, to refuse and to close; in order: English, German, French, Spanish, Italian, Russian
OPENING = (
    r"(?:(?:i'm|i am|we're|we are) (?:so |very |really )?sorry|(?:so |very )?sorry|(?:my )?apolog(?:ies|y|i[sz]e)|unfortunately|regrettably|sadly|as an? (?:ai|assistant|language model|ai assistant|ai language model)"
    r"|i understand (?:the|your) \w+|(?:i'm|i am) afraid|thank(?:s| you)(?: for \w+)?(?: \w+)?|i appreciate (?:the|your) \w+|i regret|leider|entschuldigung|es tut mir leid|tut mir leid|désolée?|je regrette|je suis désolée?|malheureusement"
    r"|lo siento|lamentablemente|perdón|disculpe|mi dispiace|spiacente|purtroppo|к сожалению|извините|простите|сожалею)"
)
REFUSING = regex.compile(
    r"(?:\b(?:i|we) (?:cannot|can not|can't|could not|couldn't|won't|will not|shall not|must not|may not|mustn't|refuse|decline|must (?:decline|refuse|abstain)|have to (?:decline|refuse|pass|skip)|prefer not|would prefer not|would rather not|don't|do not|am (?:not|unable)|are (?:not|unable))\b"
    r"|\bi'(?:m (?:not|unable)|d (?:rather not|prefer (?:not|to (?:skip|pass|leave)))|ll (?:have to )?(?:pass|decline|skip))\b|\bwe're (?:not|unable)\b"
    r"|\bunable to (?:help|assist|answer|comment|respond|say|discuss)|\bnot (?:able|allowed|permitted|authori[sz]ed) to\b.*\b(?:help|assist|answer|comment|respond|say|discuss|provide|share)|^(?:can't|cannot|won't|unable to) \w+"
    r"|\b(?:off|beyond|outside|out of)\b.*\b(?:limits|what i|my \w+)\b|\bmy (?:rules|guidelines|instructions|polic\w+|principles|settings)\b|\bno (?:reply|answer|response|comment|information|help|statement)\b.*\b(?:can|will|may) be\b"
    r"|\bno way for me\b|\bnothing can be said\b|\b(?:isn't|is not|not) possible for me\b|\blook elsewhere\b|\b(?:let us|let's) (?:leave|skip|drop)\b|\bnot something i\b|\bbe(?:yond|yond) what i\b"
    r"|^(?:request |question )?(?:declined|refused|denied|rejected)$|^no comment$|\bagainst (?:my|our) \w+|\bfrom my side\b"
    r"|\b(?:kann|darf|möchte|will|werde|muss|müssen|können|dürfen) (?:ich|wir)\b.*\b(?:nicht|nichts|keine\w*|ablehnen|verweigern|passen)\b|\b(?:ich|wir) (?:kann|darf|möchte|will|werde|muss|können|dürfen)\b.*\b(?:nicht|nichts|keine\w*|ablehnen|verweigern|passen)\b|\b(?:abgelehnt|verweigert)$|\bmir (?:leider )?nicht (?:erlaubt|möglich|gestattet)"
    r"|\bje (?:ne |n')\w+ (?:pas|rien)\b|\bje (?:dois|préfère|vais) (?:refuser|décliner|ne pas|passer)|\bje refuse\b|\bil m'est (?:impossible|interdit)|\b(?:il )?ne m'est pas (?:possible|permis)|\bje ne suis pas (?:autorisée?|en mesure)|^(?:demande )?refusée?$"
    r"|\bno (?:puedo|debo|quiero|podemos|podré|me es posible|me está permitido|estoy autorizad[oa])\b|\b(?:debo|tengo que|prefiero) (?:rechazar|declinar|negarme|no )|\bme niego\b|^(?:solicitud )?rechazad[ao]$"
    r"|\bnon (?:posso|devo|voglio|possiamo|potrò|mi è (?:possibile|permesso|consentito)|sono (?:autorizzat[oa]|in grado))\b|\b(?:devo|preferisco) (?:rifiutare|declinare|non )|\bmi rifiuto\b|^(?:richiesta )?rifiutat[ao]$"
    r"|\bне (?:могу|можем|буду|имею права|вправе|смогу|в состоянии|стану)\b|\b(?:вынужден\w*|должен|должна|приходится) (?:отказ\w+|отклонить)|\bотказываюсь\b|\bмне (?:нельзя|не разрешено|запрещено)|^(?:запрос |отказано|отклонено)\w*$)"
)
CLOSING = regex.compile(
    r"^(?:please (?:ask|contact|consult|see|try|refer|speak|check|reach|turn|get)\b.*|try (?:rephrasing|asking|again|another|something)\b.*|thank(?:s| you)\b.{0,40}|is there (?:something|anything) else\b.*|(?:can|may|could) i help (?:you )?with (?:something|anything) else\b.*"
    r"|(?:let me know|feel free)\b.*|i hope (?:you|this|that)\b.{0,40}|(?:have|enjoy) a \w+ day|bitte (?:wenden|fragen|versuchen)\b.*|danke\b.{0,40}|vielen dank\b.{0,40}|merci\b.{0,40}|veuillez\b.*|gracias\b.{0,40}|por favor\b.*|grazie\b.{0,40}|per favore\b.*|si prega\b.*|спасибо\b.{0,40}|пожалуйста\b.*)$"
)
OPENED = regex.compile(rf"^(?:{OPENING}(?:$|\s*[,:;.!–—-]+\s*|\s+(?=but\b|aber\b|mais\b|pero\b|ma\b|но\b|i\b|we\b|that\b|this\b|nothing\b|no\b|je\b|no\b|non\b|не\b|kann\b|darf\b|dazu\b|das\b))(?:(?:but|however|aber|doch|mais|pero|ma|но|однако)\b,?\s*)?)+")
TURN = regex.compile(r"[,;:–—-]\s*(?:but|still|however|yet|though|although|nevertheless|instead|aber|jedoch|dennoch|mais|cependant|pero|sin embargo|ma|tuttavia|но|однако)\b(.*)$")
SENTENCES = regex.compile(r"(?<=[.!?…。])[\"'”’»)\]*_]*\s+|\n+")
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:['’][\p{L}]+)?")
LIST_ENTRY = regex.compile(r"^\s*(?:[-*•–+]|\(?\d{1,3}[.)]|\(?[a-z][.)])\s+")
TAIL_MARKS = regex.compile(r"(?:\s*(?:\[\d+\]|\((?:see|cf\.?|siehe|voir|véase|vedi|см\.?)[^()]*\)|[✓✔☑✅👍🙂]️?|\*{1,3}|_{1,3}|[\"”’»'“]|~+))+$")
TERMINAL = regex.compile(r"[.!?…。！？]$")
# Tags that need an end
MARKUP = regex.compile(r"`+|<(?P<end>/?)(?P<tag>ul|ol|li|p|b|i|em|strong|code|pre|table|tr|td|th|div|span|blockquote|h[1-6]|a)(?:\s[^<>]*)?>|(?<![*\w])\*\*(?!\*)|\*\*(?![*])", regex.I)
INVISIBLE = regex.compile(r"[\p{White_Space}\p{C}\p{M}ㅤᅟᅠ⠀]+")


def plain(text: str) -> str:
    return INVISIBLE.sub(" ", text.replace("’", "'").replace("ʼ", "'")).strip().lower()


def is_empty(answer: str | None) -> bool:
    """Nothing, or nothing but white space, invisible characters, punctuation, or a marker for a missing value."""
    if answer is None:
        return True
    t = plain(answer)
    if not _re(r"[\p{L}\p{N}]").search(t):
        return not _re(r"[\p{Sc}\p{So}]").search(t)
    t = t.strip(" <>[](){}\"'`*_-–—.:;!|/\\")
    return t in MISSING


def tokens(text: str) -> list[str]:
    return [w for w in _re(r"[\p{L}\p{N}]+").findall(plain(text))]


def tiles(question: list[str], answer: list[str], least: int = 3) -> list[tuple[int, int, int]]:
    """Greedy string tiling (Wise 1993): the longest common runs first, as (question place, answer place, length).

    A place of the answer belongs to one tile; the question may be used again, so that a repeated copy is covered as well.
    """
    taken = [False] * len(answer)
    where: dict[tuple[str, ...], list[int]] = {}
    for i in range(len(question) - least + 1):
        where.setdefault(tuple(question[i : i + least]), []).append(i)
    runs = []
    for j in range(len(answer) - least + 1):
        for i in where.get(tuple(answer[j : j + least]), ()):
            if i and j and question[i - 1] == answer[j - 1]:
                continue
            n = least
            while i + n < len(question) and j + n < len(answer) and question[i + n] == answer[j + n]:
                n += 1
            runs.append((n, i, j))
    out = []
    for n, i, j in sorted(runs, key=lambda r: (-r[0], r[2], r[1])):
        while n >= least and taken[j]:
            i, j, n = i + 1, j + 1, n - 1
        k = 0
        while k < n and not taken[j + k]:
            k += 1
        if k >= least:
            taken[j : j + k] = [True] * k
            out.append((i, j, k))
    return out


def is_copy(question: str | None, answer: str) -> bool:
    """Whether the answer is the question, once or more, behind at most five framing words."""
    q, a = tokens(question or ""), tokens(answer)
    if not q or len(a) < len(q):
        return False
    if len(q) < 3:
        k = len(a) % len(q)
        return k <= 4 and a[k:] == q * (len(a) // len(q)) and len(a) >= len(q) and (k == 0 or len(q) > 1)
    found = tiles(q, a)
    covered = sum(n for _, _, n in found)
    whole = {i for p, _, n in found for i in range(p, p + n)}
    if len(whole) < 0.9 * len(q) or not found:
        return False
    start = min(j for _, j, _ in found)
    rest = len(a) - start - covered
    repeats = max(1, round(covered / len(q)))
    return start <= 5 and rest <= 4 * (repeats - 1) and rest <= 0.1 * len(a) + 4 * (repeats - 1) and max(j + n for _, j, n in found) == len(a)


def is_refusal(answer: str) -> bool:
    """Whether every sentence opens, refuses or closes, and one refuses."""
    text = TAIL_MARKS.sub("", answer.strip())
    refused = False
    for s in SENTENCES.split(text):
        t = plain(s or "").strip(" .!?…\"”“»«*_")
        if not t:
            continue
        core = OPENED.sub("", t).strip(" ,.:;-–—")
        if not core or CLOSING.match(core) or CLOSING.match(t):
            continue
        turn = TURN.search(core)
        if turn and len(turn[1].split()) >= 3 and not REFUSING.search(turn[1]):
            return False
        if not REFUSING.search(core):
            return False
        refused = True
    return refused


class Parser:
    """A pushdown parser of code fences, lists, brackets, quotations and markup, all on one stack; what is left there was cut off.

    Symbols are the mark that opened: a fence, ``-`` for a list of lines, a bracket or quotation mark, an HTML tag as ``<tag``, ``**`` or backticks.  A closing mark
    takes with it what was opened after its own, where that can be left open.  Emphasis and inline code end with their paragraph, a list with the first line that neither is an entry nor goes on with one.
    """

    PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
    OPEN = frozenset("([{“«")
    SPECIAL = _re(r"[()\[\]{}“”«»\"]")

    def __init__(self, text: str):
        self.stack: list[str] = []
        entry = False
        for line in text.split("\n"):
            if _re(r"\s*(?:```|~~~)").match(line):
                whole = len(line.strip()) > 6 and line.strip().endswith("```")
                if not whole:
                    self._close("```") if "```" in self.stack else self.stack.append("```")
                continue
            if "```" in self.stack:
                continue
            if not line.strip():
                self.stack = [m for m in self.stack if m[0] not in "`*"]
                continue
            was, entry = entry, bool(LIST_ENTRY.match(line))
            if entry and "-" not in self.stack:
                self.stack.append("-")
            elif not entry and not was and "-" in self.stack:
                self.stack.remove("-")
            self._mark(line)
            if self.SPECIAL.search(line):
                self._brackets(line)

    def _close(self, mark: str) -> None:
        while self.stack.pop() != mark:
            pass

    def _brackets(self, line: str) -> None:
        quotes = 0
        for i, c in enumerate(line):
            if c in self.OPEN:
                if c != "“" or self.open != "“":
                    self.stack.append(c)
            elif c in self.PAIRS:
                if c == ")" and i < 6 and _re(r"^\s*(?:\d{1,3}|[a-z])\)").match(line):
                    continue
                if self.PAIRS[c] in self.stack:
                    at = len(self.stack) - 1 - self.stack[::-1].index(self.PAIRS[c])
                    self.stack[at:] = [m for m in self.stack[at:] if m[0] in "<`*-"]
            elif c == '"':
                quotes += 1
        if quotes % 2:
            self.stack.remove('"') if '"' in self.stack else self.stack.append('"')

    def _mark(self, line: str) -> None:
        """Push and pop the markup of a line; within inline code nothing else counts."""
        for m in MARKUP.finditer(line):
            mark = m[0]
            code = next((x for x in self.stack if x[0] == "`"), None)
            if code or mark[0] == "`":
                if not code:
                    self.stack.append(mark)
                elif mark == code:
                    self.stack.remove(mark)
            elif mark[0] == "<":
                tag = "<" + m["tag"].lower()
                if m["end"]:
                    if tag in self.stack:
                        at = len(self.stack) - 1 - self.stack[::-1].index(tag)
                        self.stack[at:] = [x for x in self.stack[at:] if x[0] not in "<*"]
                elif not mark.endswith("/>"):
                    if tag in ("<li", "<p") and tag == next((x for x in reversed(self.stack) if x[0] == "<"), None):
                        continue  # the one before ends without a tag
                    self.stack.append(tag)
            elif mark in self.stack:
                self.stack.remove(mark)
            elif line[m.end() : m.end() + 1].strip() and not line[: m.start()][-1:].isalnum():
                self.stack.append(mark)

    @property
    def open(self) -> str | None:
        """The last bracket or quotation left open."""
        return next((m for m in reversed(self.stack) if m[0] not in "<`*-"), None)

    @property
    def cut(self) -> bool:
        """Whether a fence, inline code, emphasis, or a tag that needs an end is left open."""
        return any(m[0] in "`*" or m[0] == "<" and m not in ("<p", "<li") for m in self.stack)


def ends_open(line: str) -> bool:
    """Whether a line breaks off: a word that nothing ends with, an open mark, or an abbreviation."""
    if _re(r"[,:;(\[{=+/\\&–—-]$").search(line):
        return True
    words = WORD.findall(plain(line))
    return bool(words) and words[-1] in OPEN_WORDS


def is_truncated(answer: str) -> bool:
    text = INVISIBLE.sub(lambda m: "\n" if "\n" in m[0] else " ", answer).strip()
    p = Parser(text)
    if p.cut:
        return True
    lines = [x for x in text.split("\n") if x.strip()]
    last = lines[-1].strip()
    if _re(r"(?:```|~~~)").match(last) or last.endswith("```"):
        return False
    bare = TAIL_MARKS.sub("", last).rstrip()
    marked = bare != last
    if not bare:
        return False
    if p.open and not marked:
        return True
    if TERMINAL.search(bare):
        word = _re(r"([\p{L}.]+)\.$").search(bare)
        if word and word[1].lower().strip(".") in ABBREVIATIONS and not marked and len(bare.split()) > 3:
            return True
        return bool(_re(r"(?:\.\.\.|…)$").search(bare)) and len(bare) > 30 and not marked
    entry = LIST_ENTRY.match(bare)
    if "-" in p.stack:
        body = bare[entry.end() :] if entry else bare
        others = [LIST_ENTRY.sub("", x).strip() for x in lines[:-1] if LIST_ENTRY.match(x)]
        if ends_open(body) or not body:
            return True
        if others:
            if sum(bool(TERMINAL.search(TAIL_MARKS.sub("", x))) for x in others) * 2 > len(others):
                return True  # the other entries are sentences
            shared = frozenset.intersection(*(frozenset(WORD.findall(x.lower())) for x in others))
            mine = frozenset(WORD.findall(body.lower()))
            return bool(shared & OPEN_WORDS) and not shared & OPEN_WORDS & mine
        return len(WORD.findall(body)) <= 1 and not _re(r"\d").search(body)
    if marked:
        return False
    if ends_open(bare):
        return True
    sentence = SENTENCES.split(bare)[-1]
    words = WORD.findall(sentence)
    if len(SENTENCES.split(bare)) > 1:
        return True
    # a finished number, a short phrase, a title
    return len(words) > 5


def languages(text: str | None) -> dict[str, float]:
    """How much speaks for each language: the script, frequent words and special letters."""
    letters = _re(r"\p{L}").findall(text or "")
    if not letters:
        return {}
    cyrillic = sum(1 for c in letters if "\u0400" <= c <= "\u04ff")
    if cyrillic * 2 > len(letters) or cyrillic >= 12 and cyrillic * 3 > len(letters):
        return {"ru": 9.0}
    low = text.lower()
    words = _re(r"\p{L}+").findall(low)
    scores = {lang: float(sum(w in known for w in words)) for lang, known in WORDS_OF.items()}
    for marks, lang in (("ß", "de"), ("äöü", "de"), ("ñ¿¡", "es"), ("çœêûëï", "fr"), ("ìò", "it"), ("áíó", "es")):
        scores[lang] += 0.5 * sum(low.count(c) for c in marks)
    return scores


def is_other_language(question: str | None, answer: str) -> bool:
    """Whether the answer's likely language is neither the question's nor one the question names.

    The question's language must lead by one frequent word, and the answer's beat the question's by two, so that a short
    answer counts for any language.
    """
    q = sorted(languages(question).items(), key=lambda x: (-x[1], x[0]))
    if not q or q[0][1] - (q[1][1] if len(q) > 1 else 0) < 1:
        return False
    asked = q[0][0]
    own = _re(r"(?s)```.*?(?:```|$)|“[^”]*”|«[^»]*»|„[^“”]*[“”]|\"[^\"]*\"").sub(" ", answer)  # neither code nor quotations
    scores = languages(own if _re(r"\p{L}{2}").search(own) else answer)
    if not scores:
        return False
    given = max(scores, key=lambda lang: (scores[lang], lang == asked, lang))
    named = {LANGUAGE_OF[w] for w in _re(r"\p{L}+").findall((question or "").lower()) if w in LANGUAGE_OF}
    return given != asked and scores[given] - scores.get(asked, 0.0) >= 2 and given not in named


def defect(question: str | None, answer: str | None) -> str | None:
    """The defect of an answer, the first that holds of: empty, copy, refusal, truncated, language."""
    if is_empty(answer):
        return "empty"
    if is_copy(question, answer):
        return "copy"
    if is_refusal(answer):
        return "refusal"
    if is_truncated(answer):
        return "truncated"
    if is_other_language(question, answer):
        return "language"
    return None


def _classify(batches):
    for b in batches:
        kinds = [defect(q, a) for q, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kinds, pa.string())], names=["turn_id", "defect"])


def broken_replies(turns: DataFrame) -> DataFrame:
    """``(turn_id, defect)`` of the turns ``(turn_id bigint, user_msg, ai_msg)`` whose answer is defective, each once.

    Whole messages are read.  A null answer is ``empty``; a null question alone is no defect, and an answer to it can be
    neither ``copy`` nor ``language``.  Null ids are dropped; of several rows of a turn, the first by question and answer
    counts, so the result is the same in any order.
    """
    return one_row_each(turns, "turn_id", "user_msg", "ai_msg").mapInArrow(_classify, "turn_id bigint, defect string").where("defect is not null")

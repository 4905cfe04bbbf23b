"""Template residue, filler and error pages, by a linear classifier of n-grams, lengths and titles.

The expressions below label a bounded sample for training and are used nowhere else: what a document is, the classifier says from the hashes of its n-grams.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm.common import GOLDEN, mix

CLASSES = ("content", "frame", "error", "notice", "filler", "placeholder")
CONTENT, FRAME, ERROR, NOTICE, FILLER, PLACEHOLDER = range(6)
SIZE = 1 << 17
SAMPLE_DOCS, SAMPLE_SEGMENTS = 20_000, 40_000
SAMPLE_CHARACTERS = 50_000
SPAN, STEP = 14, 3  # tokens of a window, and from one window to the next

# What fills a placeholder
FIELD = r"(?:(?:first|last|full|family|given|middle|user)?[ _-]?(?:name|title|date|city|company|email|e-mail|phone|address|location|product|amount|price|author|signature|section|summary|reference|contact|text|content|description|topic|subject|recipient|customer|client|country|number|url|link|position|department|code|id|username|street|zip|state|day|month|year|time|body|headline|image|logo|keyword)s?)"
SHAPES = [
    ("braces", regex.compile(r"\{\{\s*[\w.]+\s*(?:\|\s*\w+\s*)?\}\}")),
    ("dollar", regex.compile(r"\$\{\s*[\w.]+\s*\}")),
    ("erb", regex.compile(r"<%[=-]?\s*[\w.@]+\s*[-]?%>")),
    ("block", regex.compile(r"\{%-?\s*\w[^{}]*%\}")),
    ("guillemets", regex.compile(rf"[«‹]\s*{FIELD}\s*[»›]", regex.I)),
    ("underscores", regex.compile(r"(?<!\w)__[A-Za-z][A-Za-z0-9_ ]*?__(?!\w)")),
    ("ats", regex.compile(r"@@[A-Za-z]\w*@@")),
    ("percents", regex.compile(r"%%?[A-Za-z]\w+%%?(?!\w)")),
    ("hashes", regex.compile(r"##?[A-Za-z]\w+##?(?!\w)(?<=#)")),
    ("single", regex.compile(rf"(?<![\w{{$]){{\s*{FIELD}\s*}}", regex.I)),
    ("angle", regex.compile(rf"<\s*(?:(?:insert|enter|your|add|type|the|choose|select)\s+[\w ]{{2,30}}|{FIELD})\s*>", regex.I)),
    ("square", regex.compile(rf"\[\s*(?:(?:insert|enter|your|add|type|choose|select|placeholder|fill in|put)\b[\w ,'’-]{{0,40}}|{FIELD}|[\w ]{{2,40}} (?:pending|here|to be (?:supplied|added|announced|confirmed|determined)|tbd|tba|goes here))\s*\]", regex.I)),
    ("crosses", regex.compile(r"(?<!\w)[Xx]{4,}(?!\w)")),
    ("todo", regex.compile(r"\b(?:TODO|FIXME|TBC|TBA|TBD|TKTK)\b")),
    ("lorem", regex.compile(r"\blorem\s+ipsum\b", regex.I)),
]
# How texts speak about placeholders, as opposed to holding one
ABOUT = regex.compile(
    r"\b(?:such as|for example|for instance|e\.g|like|called|named|means?|expands?|explain\w*|swaps?|replaced?|replaces|stored value|rendered|template engine|engine|escap\w*|syntax|variables?|shell|manual|style guide|generic type|"
    r"typesetters?|printf|prints?|marks?|serves? to|documentation|notation|write|written as|reads? it as|tag|square brackets|so-called|the (?:word|string|token|text|phrase|marker|tag|field)s?|sums? over)\b",
    regex.I,
)
# Filler sentences
FILLERS = regex.compile(
    r"^(?:\W*(?:(?:your|body|main|some|more|sample|example|dummy|placeholder|add|insert|short|long|page|article|section|description|teaser|text|content|title|headline|copy|subtitle|caption|summary) ?)+\b(?:goes|comes|to go) here\W*"
    r"|(?:this is )?(?:a |an |some )?(?:sample|dummy|placeholder|example|filler|blind) (?:text|copy|paragraph|content|sentence|page|post|block|heading|title)(?: \w+)?\W*|click to edit\b.*|double.click to edit\b.*|replace this \w+\b.{0,30}|(?:add|put|insert|type|enter|write) (?:your |some |a |the )?(?:own )?(?:content|text|words|description|title|something|paragraph|copy)\b.{0,40}"
    r"|coming soon\W*|edit this (?:text|block|page)\b.*|dies ist ein (?:blindtext|typoblindtext|platzhalter|beispieltext)\b.*|hier steht (?:ihr|dein|der) text\b.*|(?:ceci est un )?texte? (?:factice|d'exemple|de remplissage)\b.*|(?:este es un )?texto de (?:ejemplo|relleno|prueba)\b.*|(?:questo è un )?testo (?:segnaposto|di esempio|di prova)\b.*|это (?:пример|образец) текста\b.*|(?:здесь )?(?:будет )?ваш текст\b.*)$",
    regex.I,
)
# Words made to look like Latin, as filler has them
LATIN = regex.compile(r"^(?:lorem|ipsum|dolor|sit|amet|consectetur|adipiscing|elit|sed|eiusmod|tempor|incididunt|labore|dolore|magna|aliqua|enim|minim|veniam|quis|nostrud|exercitation|ullamco|laboris|nisi|aliquip|commodo|consequat|duis|aute|irure|reprehenderit|voluptate|velit|esse|cillum|fugiat|nulla|pariatur|excepteur|sint|occaecat|cupidatat|proident|sunt|culpa|officia|deserunt|mollit|anim|laborum)$")
# What an error page says
ERRORS = regex.compile(
    r"\b(?:[45]\d\d\b.{0,3}(?:$|error|not|bad|internal|service|gateway|forbidden|page|the page|unauthor|too|gone|access|temporar)|(?:error|errors?|status|http|code|fehler|erreur|errore|ошибка)\s*[:#(]?\s*[45]\d\d|not found|forbidden|bad gateway|bad request|internal (?:server )?error|server error|unavailable|time(?:d)?[ -]?out|access (?:is )?denied|permission|not (?:authori[sz]ed|allowed|available)|unauthori[sz]ed"
    r"|too many requests|slow down|retry (?:after|in)|went wrong|something broke|unexpected (?:problem|error)|could not|can(?:no|')t (?:seem to )?(?:find|be found|reach|connect|load|open)|no longer (?:here|available|exist\w*)|does ?n[o']t (?:exist|lead)|(?:session|link|page|token) (?:has )?expired|sign in again|log in again|maintenance|blocked by|invalid (?:reply|response|request)|too long to respond"
    r"|unknown host|outdated link|may be broken|gone|traceback|\w+(?:error|exception)|file \S+, line \d+|stack trace|at this address|out of (?:order|service)|nicht (?:gefunden|erreichbar|verfügbar)|gibt es nicht mehr|zugriff verweigert|fehler\b|introuvable|ne marche plus|indisponible|accès (?:refusé|interdit)|erreur\b|no (?:encontrad[ao]|disponible|existe)|acceso denegado|error (?:del?|interno)|vuelva a intentarlo|non (?:trovat[ao]|disponibile|esiste)|accesso negato|errore\b|не найден\w*|недоступ\w*|доступ запрещ\w*|ошибка)\b",
    regex.I,
)
# What a notice that scripts are required says
NOTICES = regex.compile(
    r"(?:java ?script|\bjs\b|\bno ?script\b|\bscripts?\b|\bscripting\b|\bskripte?n?\b|скрипт\w*|checking your browser|not a robot|\bcookies?\b.{0,30}\b(?:enable|accept|must|required)|(?:enable|accept|allow).{0,30}\bcookies?\b)",
    regex.I,
)
# What surrounds a page's text
FRAMES = regex.compile(
    r"^\W*(?:powered by\b.*|back to (?:start|home|top|the)\b.*|home\b.*\babout\b.*|menu\b.*|search or\b.*|log ?in\W*|sign (?:in|up)\W*|request(?: id)? [\w-]+|ref(?:erence)? [\w-]+|if this persists\b.*|please (?:try|go back|reload|change|contact|write)\b.*|go (?:back|home)\b.*|return to\b.*|try again\b.*|contact\W*|sorry\b.{0,20}|oops\W*|whoops\W*|skip to\b.*|copyright\b.*|©.*|all rights reserved\W*|page \d+(?: of \d+)?|loading\b.{0,30}|(?:check|change|adjust|see) (?:the|this|your)\b.{0,40}|(?:our|the) team (?:was|has been)\b.*|we (?:are|were) (?:told|notified|informed)\b.*|click here\b.*|subscribe\W*|share\W*|privacy\b.{0,20}|terms\b.{0,20})$",
    regex.I,
)
SENTENCE = regex.compile(r"(?<=[.!?…])[\"”»)]*\s+(?=[\p{Lu}\p{N}\[<{($@%_\"“«])|\n+")
TAGS = regex.compile(r"</?(?:div|p|br|b|i|em|strong|span|a|ul|ol|li|h[1-6]|table|tr|td|th|tbody|section|article|header|footer|nav|img|hr|pre|code|html|body|head|title|meta|script|style|blockquote)\b[^<>]*>", regex.I)


def segments(text: str | None) -> list[tuple[str, bool]]:
    """Lines and sentences, each with whether it is code; HTML tags are dropped, and code tags and fences mark code."""
    if not text:
        return []
    out, fence = [], False
    if "&" in text:
        text = html.unescape(text)
    text = regex.sub(r"(?is)<(pre|code)\b[^>]*>(.*?)</\1>", lambda m: "\n```\n" + m[2] + "\n```\n", text)
    for block in text.split("\n"):
        if block.strip().startswith(("```", "~~~")):
            fence = not fence
            continue
        if fence:
            out.append((block.strip(), True))
    plain, fence = [], False
    for block in text.split("\n"):
        if block.strip().startswith(("```", "~~~")):
            fence = not fence
        elif not fence:
            plain.append(block.rstrip())
    # soft wraps join: a line that goes on in lower case belongs to the one before
    joined: list[str] = []
    for line in plain:
        if joined and joined[-1] and line[:1].islower() and not regex.search(r"[.!?:]$", joined[-1]):
            joined[-1] += " " + line
        else:
            joined.append(line)
    for s in SENTENCE.split(TAGS.sub("\n", "\n".join(joined))):
        if s and s.strip():
            out.append((s.strip(), False))
    return out


# Characters without which no placeholder of the above can be
MARKS = regex.compile(r"[{<_@%#\[«‹]|[Xx]{4}|TODO|FIXME|TB[CAD]|TKTK|lorem", regex.I)


def _spots(segment: str) -> list[tuple[str, tuple[int, int]]]:
    """Placeholders outside of inline code, by form and place."""
    if not MARKS.search(segment):
        return []
    bare = regex.sub(r"`[^`]*`", lambda m: " " * len(m[0]), segment)
    return [(name, m.span()) for name, pattern in SHAPES if (m := pattern.search(bare))]


def repeats(words: list[str]) -> bool:
    """Whether one or two words are all there is, again and again."""
    w = [x.lower() for x in words if x[0].isalpha()]
    return len(w) >= 6 and len(set(w)) <= 2


def latin_share(words: list[str]) -> float:
    """Share of words with the endings of made-up Latin; filler has little else."""
    w = [x for x in words if x.isalpha() and len(x) > 3]
    if len(w) < 6:
        return 0.0
    return sum(bool(LATIN.match(x)) or x.endswith(("um", "us", "is", "or", "et", "em", "am", "at", "ur", "ra", "ia", "as", "ro", "it")) for x in w) / len(w)


def weak_label(segment: str, code: bool, page: bool) -> int | None:
    """A label by phrases and status codes, or none; errors, notices and frames are labelled where a page has little else."""
    low = segment.lower()
    n = len(segment.split())
    if code:
        return CONTENT
    about = bool(ABOUT.search(low)) and n > 5
    found = [name for name, _ in _spots(segment)]
    if found and found != ["lorem"]:
        return CONTENT if about else PLACEHOLDER
    if found and not about:
        return FILLER
    if FILLERS.match(low.strip()):
        return FILLER
    words = [w.lower() for w in regex.findall(r"\p{L}+", segment)]
    if latin_share(words) > 0.85 or repeats(words):
        return FILLER
    if not page:
        return CONTENT
    if NOTICES.search(low):
        return NOTICE
    if ERRORS.search(low):
        return ERROR
    if FRAMES.match(low.strip()):
        return FRAME
    return CONTENT if n >= 7 else None


def mostly_messages(parts: list[tuple[str, bool]]) -> bool:
    """Whether most words of a document stand in segments that speak of errors or scripts, or frame a page."""
    all_, hit = 0, 0
    for s, code in parts:
        n, low = len(s.split()), s.lower()
        all_ += n
        if not code and (NOTICES.search(low) or ERRORS.search(low) or FRAMES.match(low.strip())):
            hit += n
    return 2 * hit > all_


TOKEN = re.compile(r"\w+|[^\w\s]+")
UPPER, LOWER, DIGIT = re.compile(r"[^\W\d_a-zß-ÿа-я]+"), re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


HARD = re.compile(r"[{}\[\]<>$%@#_«»|]")  # marks that a placeholder has, and much else


def shape(token: str) -> str:
    """Letter case and punctuation of a token: ``__Name__`` has the shape ``__Aa__``."""
    if len(token) > 3 and len(set(token.lower())) == 1:
        return "=" + token[0].lower()
    return DIGIT.sub("0", LOWER.sub("a", UPPER.sub("A", token)).replace("Aa", "A") if not token.islower() else LOWER.sub("a", token))


class Grams:
    """Buckets of a token's n-grams: the word, the word and one or two before, the last letters, and the same of shapes."""

    COUNT = 8

    def __init__(self):
        self.seen: dict[str, tuple[int, int, int]] = {}

    def __call__(self, tokens: list[str], starts: np.ndarray) -> np.ndarray:
        """A row of buckets per token; ``starts`` are the places where a segment begins, before which nothing is looked at."""
        seen, h = self.seen, xxhash.xxh3_64_intdigest
        if len(seen) > 200_000:
            seen.clear()
        for t in set(tokens):
            if t not in seen:
                low = DIGIT.sub("0", t.lower().replace("’", "'"))
                seen[t] = (h("w" + low), h("s" + shape(t)), h("e" + low[-2:]))
        word, form, end = np.array([seen[t] for t in tokens], np.uint64).reshape(-1, 3).T
        at = np.arange(len(tokens))
        since = at - np.repeat(starts, np.diff(np.append(starts, len(tokens))))

        def before(x: np.ndarray, k: int) -> np.ndarray:
            out = np.full(len(x), GOLDEN)
            ok = since >= k
            out[ok] = x[at[ok] - k]
            return out

        pair = lambda x, y, salt: mix(x * np.uint64(3) + mix(y ^ np.uint64(salt)))
        w1, f1 = before(word, 1), before(form, 1)
        f2 = before(form, 2)
        again = np.uint64(xxhash.xxh3_64_intdigest("again"))
        grams = [word, np.where(word == w1, again, pair(word, w1, 11)), pair(pair(word, w1, 12), before(word, 2), 13), end, form, pair(form, f1, 14), pair(pair(form, f1, 15), f2, 16), pair(form, w1, 17)]
        return np.stack([(g % np.uint64(SIZE)).astype(np.int32) for g in grams], axis=1)


def _bucket(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) % SIZE


def traits(parts: list[tuple[str, bool]], sizes: list[int], distinct: list[int], title: str | None) -> list[list[int]]:
    """Buckets of what holds for a whole segment: lengths, how much of it repeats, code, place, and the words of the document's title."""
    total = int(np.log2(sum(sizes) + 1))
    named = [_bucket(f"=title {w}") for w in set(TOKEN.findall(title.lower()))] if title else []
    out = []
    for i, ((s, code), n, d) in enumerate(zip(parts, sizes, distinct)):
        marks = ["=bias", f"=n{min(n, 64) // 4}", f"=log{int(np.log2(n + 1))}", f"=doc{total}", f"=parts{min(len(parts), 12)}", *[f"=distinct{int(8 * d / max(n, 1))}-{min(n, 16) // 8}-{k}" for k in range(3)]]
        marks += [f"=first{s[-1:] in '.!?'}{n <= 12}"] * (i == 0) + ["=upper"] * s.isupper() + ["=code"] * code
        out.append([_bucket(m) for m in marks] + named)
    return out


class Model:
    """A softmax classifier with an L2 penalty, fitted by Adagrad; ``least`` are the probabilities that a placeholder and a filler need."""

    def __init__(self, weights: np.ndarray, least: tuple[float, float] = (0.5, 0.5)):
        self.weights, self.least = weights, least

    @staticmethod
    def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 12, rate: float = 0.25, penalty: float = 1e-5, seed: int = 3) -> Model:
        k = len(CLASSES)
        w, g2 = np.zeros((SIZE, k)), np.full((SIZE, k), 1e-3)
        if not len(rows):
            return Model(w.astype(np.float32))
        count = np.bincount(labels, minlength=k)
        weight = np.clip(np.sqrt(len(labels) / (k * np.maximum(count, 1))), 0.5, 8)[labels]
        lengths = np.array([len(r) for r in rows])
        flat = np.concatenate(rows)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for s in range(0, len(order), 256):
                part = order[s : s + 256]
                n = lengths[part]
                idx = np.concatenate([flat[starts[i] : starts[i + 1]] for i in part])
                off = np.concatenate([[0], np.cumsum(n)[:-1]])
                score = np.add.reduceat(w[idx], off, axis=0) / np.sqrt(n)[:, None]
                score -= score.max(axis=1, keepdims=True)
                p = np.exp(score)
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(part)), labels[part]] -= 1
                p *= (weight[part] / np.sqrt(n))[:, None] / len(part)
                used, inv = np.unique(idx, return_inverse=True)
                each = np.repeat(p, n, axis=0)
                grad = penalty * w[used] + np.stack([np.bincount(inv, each[:, c], len(used)) for c in range(k)], axis=1)
                g2[used] += grad * grad
                w[used] -= rate * grad / np.sqrt(g2[used])
        return Model(w.astype(np.float32))

    def scores(self, docs: list[Document]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the classes of each segment as a whole, and the greatest one of a placeholder in any of its windows."""
        grams = np.concatenate([d.grams for d in docs]) if docs else np.empty((0, Grams.COUNT), np.int32)
        ends = np.cumsum([n for d in docs for n in d.sizes])
        begins = ends - np.array([n for d in docs for n in d.sizes])
        own = [t for d in docs for t in d.traits]
        if not own:
            return np.empty((0, len(CLASSES))), np.empty(0)
        lengths = np.array([len(t) for t in own])
        base = np.add.reduceat(self.weights[np.concatenate(own)], np.cumsum(lengths) - lengths, axis=0)
        sums = np.zeros((len(grams) + 1, len(CLASSES)))
        np.cumsum(self.weights[grams].sum(axis=1), axis=0, out=sums[1:])
        whole = _softmax((base + sums[ends] - sums[begins]) / np.sqrt(lengths + Grams.COUNT * (ends - begins))[:, None])
        # windows: every STEP tokens, the last one at the end of the segment
        many = np.maximum(1, -(-(ends - begins - SPAN) // STEP) + 1)
        seg = np.repeat(np.arange(len(ends)), many)
        at = np.arange(len(seg)) - np.repeat(np.cumsum(many) - many, many)
        lo = np.maximum(np.minimum(begins[seg] + at * STEP, ends[seg] - SPAN), begins[seg])
        hi = np.minimum(lo + SPAN, ends[seg])
        window = _softmax((base[seg] + sums[hi] - sums[lo]) / np.sqrt(lengths[seg] + Grams.COUNT * (hi - lo))[:, None])
        return whole, np.maximum.reduceat(window[:, PLACEHOLDER], np.cumsum(many) - many)

    def kinds(self, docs: list[Document]) -> np.ndarray:
        """The class of each segment: a placeholder or filler if it reaches its least probability, else the likeliest of the others."""
        return self.told(*self.scores(docs))

    def told(self, whole: np.ndarray, spot: np.ndarray) -> np.ndarray:
        if not len(whole):
            return np.empty(0, np.int64)
        out = whole[:, :FILLER].argmax(axis=1)
        out[(whole[:, FILLER] >= self.least[1]) & (whole[:, FILLER] >= whole[:, :FILLER].max(axis=1))] = FILLER
        out[np.maximum(spot, whole[:, PLACEHOLDER]) >= self.least[0]] = PLACEHOLDER
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


class Document:
    """A text's segments with their buckets."""

    def __init__(self, text: str | None, title: str | None, grams: Grams):
        self.parts = segments(text)
        tokens = [TOKEN.findall(s) for s, _ in self.parts]
        self.tokens = tokens
        self.sizes = [len(t) for t in tokens]
        flat = [t for ts in tokens for t in ts]
        starts = np.cumsum([0, *self.sizes])[:-1]
        self.grams = grams(flat, starts[np.array(self.sizes) > 0] if self.sizes else starts) if flat else np.empty((0, Grams.COUNT), np.int32)
        self.traits = traits(self.parts, self.sizes, [len(set(t)) for t in tokens], title)


def training_rows(docs: list[tuple], grams: Grams, most: int = SAMPLE_SEGMENTS) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets and weak labels of ``(id, text, title)``: all segments that are not content, and content up to the bound.

    A segment with the form of a placeholder, or content with a mark that placeholders have, gives the windows around it as well, and other content a window at a place by its hash.
    """
    rare, common = [], []
    every = max(2, 16 * len(docs) // most)  # of the segments that are plainly content, one in so many
    for key, text, title in docs:
        d = Document(text, title, grams)
        page = mostly_messages(d.parts)
        end = 0
        for i, (s, code) in enumerate(d.parts):
            start, end = end, end + d.sizes[i]
            label = weak_label(s, code, page)
            if label is None:
                continue
            spots = _spots(s)
            turn = xxhash.xxh64_intdigest(f"{key} {i}")
            hard = [m.start() for m in HARD.finditer(s)] if label == CONTENT and not spots else []
            if label == CONTENT and not spots and not hard and turn % every:
                continue
            own = np.array(d.traits[i], np.int32)
            spans = [(start, end)]
            if d.sizes[i] > SPAN:
                place = [len(TOKEN.findall(s[:x])) for x in [m[0] for _, m in spots] + hard[:1]] or [turn // every % (d.sizes[i] - SPAN + 1) + 5]
                # a text about a placeholder is content in whatever window it is seen, one with a placeholder in those that show what is before it
                offsets = range(0, SPAN - 1, STEP) if label == CONTENT else range(4, 9, 2)
                los = {max(0, min(x - o, d.sizes[i] - SPAN)) for x in place for o in offsets}
                spans += [(start + lo, start + lo + SPAN) for lo in sorted(los)]
            for k, (lo, hi) in enumerate(spans):
                (common if label == CONTENT and not spots and not hard else rare).append((turn, k, np.concatenate([own, d.grams[lo:hi].reshape(-1)]), label))
    rare = sorted(rare, key=lambda r: r[:2])[: most // 2]
    common = sorted(common, key=lambda r: r[:2])[: min(most // 2, max(4000, 12 * len(rare)))]
    return [r[2] for r in rare + common], np.array([r[3] for r in rare + common], np.int64)


def verdict(parts: list[tuple[str, bool]], kinds: np.ndarray) -> str | None:
    """The kind of residue of a document, from the classes of its segments, or none."""
    if not parts:
        return None
    sizes = np.array([len(s.split()) for s, _ in parts])
    if (kinds == PLACEHOLDER).any():
        return "placeholder"
    if (kinds == FILLER).any():
        return "filler"
    bad = (kinds == ERROR) | (kinds == NOTICE)
    if not bad.any():
        return None
    content = kinds == CONTENT
    title = int(np.argmax(content)) if content.any() else -1
    if title >= 0 and title < int(np.argmax(bad)) and sizes[title] <= 14 and parts[title][0][-1:] not in ".!?":
        content[title] = False  # the page's title, behind its frame or not
    if sizes[content].sum() > 1.5 * sizes[bad].sum() or any(content & (sizes >= 10)):
        return None
    return "notice" if (kinds == NOTICE).any() else "error"


def _apply(model: Model):
    def run(batches):
        grams = Grams()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                docs = [Document(t, title, grams) for t, title in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                kinds = model.kinds(docs)
                ends = np.cumsum([len(d.parts) for d in docs])
                kind = [verdict(d.parts, kinds[e - len(d.parts) : e]) for d, e in zip(docs, ends.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kind, pa.string())], names=["doc_id", "kind"])

    return run


def _least(scores: np.ndarray, true: np.ndarray) -> float:
    """The probability at which a class is told best, by its F1; half where there is nothing to learn it from."""
    if not true.any() or true.all():
        return 0.5
    tried = np.round(np.arange(0.3, 0.96, 0.05), 2)
    f1 = [2 * (true & (scores >= t)).sum() / max(1, true.sum() + (scores >= t).sum()) for t in tried]
    return float(tried[np.array(f1) >= max(f1) - 0.01].max())


def train(docs: DataFrame, most_docs: int = SAMPLE_DOCS) -> tuple[Model, dict[str, float]]:
    """The model, fitted on about ``most_docs`` documents, and its agreement with the weak labels on unseen hosts.

    The sample are the documents below a threshold of their hash, those of at most 50,000 characters, so that its size in bytes is bounded too.  A quarter of the
    sources, by hash, is held out; on it the least probabilities of placeholders and fillers are chosen and the figures measured.  The model is then fitted on all of it.
    """
    title = F.col("title") if "title" in docs.columns else F.lit(None).cast("string")
    n = docs.count()
    below = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, most_docs / max(n, 1))))
    drawn = docs.where(below & (F.length("text") <= SAMPLE_CHARACTERS)).select("doc_id", "text", title.alias("title"), "source").toArrow()
    rows = sorted(zip(*(drawn.column(c).to_pylist() for c in ("doc_id", "text", "title", "source"))), key=lambda r: str(r[0]))
    unseen = [xxhash.xxh32_intdigest(str(r[3])) % 4 == 0 for r in rows]
    grams = Grams()
    x, y = training_rows([r[:3] for r, u in zip(rows, unseen) if not u], grams)
    model = Model.fit(x, y)
    held = [r for r, u in zip(rows, unseen) if u]
    labels, whole, spot = [], [np.empty((0, len(CLASSES)))], [np.empty(0)]
    for at in range(0, len(held), 500):
        part = [Document(r[1], r[2], grams) for r in held[at : at + 500]]
        for d in part:
            page = mostly_messages(d.parts)
            labels += [weak_label(s, code, page) for s, code in d.parts]
        w, p = model.scores(part)
        whole.append(w)
        spot.append(p)
    whole, spot = np.concatenate(whole), np.concatenate(spot)
    known = np.array([x is not None for x in labels], bool)
    true = np.array([-1 if x is None else x for x in labels])
    if known.any():
        model.least = (_least(np.maximum(spot, whole[:, PLACEHOLDER])[known], true[known] == PLACEHOLDER), _least(whole[known, FILLER], true[known] == FILLER))
    told = model.told(whole, spot)
    figures = {"accuracy": float((told == true)[known].mean()) if known.any() else 1.0, "segments": float(known.sum()), "placeholder_least": model.least[0], "filler_least": model.least[1]}
    for k, name in enumerate(CLASSES):
        hit = ((told == k) & (true == k))[known].sum()
        figures[f"{name}_f1"] = float(2 * hit / max(1, (told == k)[known].sum() + (true == k)[known].sum()))
    hx, hy = training_rows([r[:3] for r, u in zip(rows, unseen) if u], grams)
    return Model(Model.fit(x + hx, np.concatenate([y, hy])).weights, model.least), figures


def residue(docs: DataFrame, most_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``(doc_id, kind)`` of the documents ``(doc_id, text, source[, title])`` that hold residue: placeholder, filler, error or notice.

    Segments (lines and sentences) of every whole text are classified by a model trained on weak labels of a bounded sample
    (see ``train``), whatever their length and that of the document.  A document is residue if a segment is a filler or has a window with a placeholder, or if, apart from a title and a page
    frame, it has only error messages or script notices.  Code is content.  Null and blank texts have no row; null sources
    are one host.
    """
    model, _ = train(docs, most_docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    title = F.col("title") if "title" in docs.columns else F.lit(None).cast("string")
    return docs.select("doc_id", "text", title.alias("title")).mapInArrow(_apply(model), f"doc_id {kind}, kind string").where("kind is not null").distinct()

"""Broken pairs of source text and answer: clauses tagged by a conditional random field, summed up to a defect.

The clauses (lines) of an answer are tagged as answer, refusal, echo, foreign or unfinished
by a linear-chain conditional random field over features of the clause, its source and its
neighbours: what languages it is near to, markup and where it comes from, how it ends, and,
for refusals, whether it speaks of itself, denies, regrets, declines, addresses the reader
and has words that its source lacks. The field is fitted on pairs built from samples of known language: right
answers, refusals, echoes of markup, answers in another language and cut answers. The
coverage of the tags gives a pair's defect; a pair has at most one:

    empty           nothing to read
    copy            most characters are echo of the source's markup
    refusal         most running words are refusal
    other_language  most running words are foreign
    truncated       the last clause is unfinished

An answer without a source, or whose status isn't the given one, is no pair. Null and
empty source texts leave the language open. Repeated rows give one result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import split_join
from .answers import _BLOCK_TAG, _FRONT, ending, is_empty, place_in_source, squeezed, unwrapped
from .arrowtext import sliced
from .language import IDENTIFIER, IDENTIFIER_SIGNS, Profiles, sample_rows

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
FEATURES = (
    "bias", "block tags", "tags of the source", "foreign lead", "native", "aside", "running",
    "last", "last and inside source", "last and at end of source", "last and open", "last and bare", "last and marked", "markup page", "between tags", "foreign best",
    "speaks", "speaks and denies", "sorry", "sorry and denies", "declines", "of itself", "of the task", "addresses", "unseen", "unseen and speaks", "unseen and sorry", "unseen and declines", "unseen and of itself", "unseen and addresses", "speaks in quotes", "speaks short",
)
_AT = {name: k for k, name in enumerate(FEATURES)}
#: Shares of characters or running words that make a defect.
MOST = 0.5
#: Words from which a clause's language counts.
CLAUSE_WORDS = 3
#: Characters of a first line with a colon at its end that is a preface, not answer.
PREFACE = 200
#: Sample rows from which training pairs are built, at most.
TRAINING_ROWS = 600

# Classes of words in six languages. A word with * stands for all words that begin like it.
CLASSES = {
    # a speaker, or what only a speaker says of itself
    "speaks": "я мне меня мой моя могу смогу буду хочу имею i i'm i'll i've i'd im me my ich mir mein* yo me mi puedo podré puedo quiero estoy soy tengo debo eu meu minha posso consigo poderei quero estou sou tenho devo мені мене мій моя можу зможу хочу маю kann darf möchte muss werde can cannot can't cant could must won't we unable able able not",
    "denies": "не нет нельзя невозможно ні немає неможливо not no can't cant cannot won't wont don't dont couldn't unable impossible decline refuse nicht kein* unmöglich außerstande no imposible não impossível",
    "sorry": "сожалению извин* простите прощения увы sorry apolog* unfortunately regret* afraid жаль вибач* пробач* перепрош* leider entschuldig* bedau* leid siento lament* disculp* perdon* desafortunadamente infelizmente desculp* lament* sinto",
    "declines": "отказ* отклон* воздерж* declin* refus* reject* відмов* відхил* ablehn* weiger* verweiger* rechaz* declin* neg* abstener* recus* declin* abster*",
    "of itself": "ии модель языковая ассистент* помощник* ai model assistant chatbot модель мовна асистент* помічник* ki sprachmodell assistent* modelo asistente lenguaje assistente linguagem",
    "of the task": "запрос* преобраз* обработ* помо* задани* глав* текст* просьб* выполн* request* convert* process* help* assist* task* chapter* text* fulfil* comply* запит* перетвор* оброб* допом* завдан* розділ* anfrage* umwandel* verarbeit* helf* aufgabe* kapitel* text* bearbeit* ausführ* solicitud* convertir* procesar* ayud* tarea* capítulo* texto* realiz* pedido* converter* processar* ajud* tarefa* capítulo* executar*",
    "addresses": "вам вас ваш* пожалуйста пришлите обратитесь you your please вам вас ваш* надішліть ihnen sie ihr* bitte le les usted su por favor você lhe seu sua",
}
_BITS = {name: 1 << k for k, name in enumerate(CLASSES)}
_EXACT_WORDS: dict[str, int] = {}
_BEGINNINGS: dict[str, int] = {}
for _name, _words in CLASSES.items():
    for _word in _words.split():
        _listed = _BEGINNINGS if _word.endswith("*") else _EXACT_WORDS
        _listed[_word.rstrip("*")] = _listed.get(_word.rstrip("*"), 0) | _BITS[_name]
_SIZES = sorted({len(b) for b in _BEGINNINGS})
#: A clause with a word of one of these is looked at more closely, and then one with fewer words than SHORT.
_CLOSER, SHORT = _BITS["speaks"] | _BITS["sorry"] | _BITS["declines"] | _BITS["of itself"], 25


def word_classes(word: str) -> int:
    """Bits of the classes of a word in lower case."""
    word = word.replace("’", "'")
    found = _EXACT_WORDS.get(word, 0)
    for size in _SIZES:
        found |= _BEGINNINGS.get(word[:size], 0) if len(word) >= size else 0
    return found


_QUOTED = re.compile(r"«[^»\n]*»|„[^“”\n]*[“”]|“[^”\n]*”|\"[^\"\n]*\"")
_INLINE_ASIDE = re.compile(r"`[^`\n]*`|!\[[^\]\n]*\]\([^)\n]*\)|<[^<>\n]*>|\]\([^)\n]*\)|(?<!\w)\w+://\S+|&#?\w+;")
#: Words of a page; what stands in code, tags and entities gives empty ones.
_PAGE_WORD = re.compile(r"<pre\b.*?(?:</pre\s*>|\Z)|<[^<>]*>|&\w+;|([^\W\d_]+)", re.I | re.S)
_SIGNS = re.compile(f"[{re.escape(IDENTIFIER_SIGNS)}]")
_PAGE_TAG = re.compile(r"(?:<|&lt;)/?(?:!doctype|html|body|head|h1)\b", re.I)
_TABLE_LINE = re.compile(r"</?(?:table|thead|tbody|tr|td|th)\b", re.I)
_CAPTION = re.compile(r">\s*\w+ \d+\s*[–—-] ")


_PLAIN_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def speech(text: str, words: int, source: str) -> list[tuple[str, float]]:
    """Features of a clause that may be a speaker's: what classes of words it has outside quotes, and whether its words stand in the source (in lower case)."""
    lower = text.lower()
    outside = _QUOTED.sub(" ", lower)
    bits = 0
    for w in _PLAIN_WORD.findall(outside):
        bits |= word_classes(w)
    has = {name: bool(bits & bit) for name, bit in _BITS.items()}
    long = [w for w in _PLAIN_WORD.findall(lower) if len(w) > 3]
    unseen = bool(source) and sum(w in source for w in long) < 0.6 * len(long) or not source
    out = [(name, has[name]) for name in ("speaks", "sorry", "declines", "of itself", "of the task", "addresses")]
    out += [("speaks and denies", has["speaks"] and has["denies"]), ("sorry and denies", has["sorry"] and has["denies"]), ("unseen", unseen), ("speaks short", has["speaks"] and words < SHORT)]
    out += [(f"unseen and {name}", unseen and has[name]) for name in ("speaks", "sorry", "declines", "of itself", "addresses")]
    out += [("speaks in quotes", outside != lower and not bits & _CLOSER)]
    return [(name, 1.0) for name, on in out if on]


class Clauses:
    """Clauses and features of the answers of one slice."""

    def __init__(self, answers: list[str], sources: list[str | None], profiles: Profiles) -> None:
        self.lines: list[str] = []
        self.row: list[int] = []
        running: list[bool] = []
        plain: list[str] = []
        rows: list[list[float]] = []
        none = [1.0] + [0.0] * (len(FEATURES) - 1)
        for number, (answer, source) in enumerate(zip(answers, sources, strict=True)):
            body = unwrapped(answer)[0]
            front = _FRONT.match(body)
            body = body[front.end() :] if front else body
            raw = None
            inside = False
            first = len(rows)
            for line in body.splitlines():
                text = line.strip()
                if not text:
                    continue
                f = none.copy()
                sign = text[0]
                fence = sign in "`~" and text.startswith(("```", "~~~"))
                aside = inside or fence or sign in "#|" or sign == "!" and text.startswith("![") or sign == ":" and text.startswith("::") or sign == ">" and bool(_CAPTION.match(text)) or sign == "<" and bool(_TABLE_LINE.match(text))
                aside = aside or len(rows) == first and text.endswith(":") and len(text) <= PREFACE
                if fence:
                    inside = not inside
                elif not inside and ("<" in text or "&" in text):
                    if _BLOCK_TAG.search(text):
                        f[1] = 1.0
                        raw = squeezed(source or "") if raw is None else raw
                        own = squeezed(text)
                        while own not in raw and own != (less := html.unescape(own)):
                            own = less
                        f[2] = float(own in raw)
                        f[13] = float(bool(_PAGE_TAG.search(text)))
                f[5] = float(aside)
                rows.append(f)
                self.lines.append(text)
                self.row.append(number)
                running.append(not aside)
                plain.append("" if aside else text)
            if raw is not None:  # code and other lines between the tags of a page
                tagged = [k for k in range(first, len(rows)) if rows[k][1]]
                for k in range(tagged[0], tagged[-1]):
                    rows[k][14] = 1.0 - rows[k][1]
            if len(rows) > first:
                e = ending(answer)
                f = rows[-1]
                where = place_in_source(e.tail, source)
                f[7], f[8], f[9] = 1.0, float(where == "inside"), float(where == "end")
                f[10], f[11], f[12] = float(e.kind == "open"), float(e.kind == "bare"), float(e.mark in ("bytes", "dots"))
        x = np.array(rows, np.float32).reshape(-1, len(FEATURES))
        clean = _INLINE_ASIDE.sub(" ", "\n".join(plain))
        if _SIGNS.search(clean):
            clean = "\n".join(IDENTIFIER.sub(" ", t) if _SIGNS.search(t) else t for t in clean.split("\n"))
        units = profiles.units(clean.split("\n") if plain else [])
        words, products = units.words, units.products
        row = np.array(self.row, np.int64)
        of_source = profiles.products([_PAGE_WORD.findall(s) if s else [] for s in sources])
        own = of_source.argmax(1)
        known = np.array([bool(s) for s in sources]) & (np.abs(of_source).sum(1) > 0)
        if len(row):
            best = products.argmax(1)
            counts = (words >= CLAUSE_WORDS) & known[row]
            other = np.flatnonzero(counts & (best != own[row]))
            length = profiles.lengths(units.place, units.starts[other], units.ends[other])
            ahead = (products[other, best[other]] - products[other, own[row[other]]]) / length
            x[other, 3] = np.clip(ahead / np.maximum(profiles.lead[best[other], own[row[other]]], 0.05), 0, 1.5)
            x[other, 15] = 1
            x[:, 4] = counts & (best == own[row])
            x[:, 6] = np.array(running) & (words >= CLAUSE_WORDS)
            lower: dict[int, str] = {}
            for k in np.flatnonzero((units.marks & _CLOSER > 0) & np.array(running)):
                r = int(row[k])
                if r not in lower:
                    lower[r] = html.unescape(sources[r] or "").lower()
                for name, value in speech(plain[k], int(words[k]), lower[r]):
                    x[k, _AT[name]] = value
        self.x, self.words, self.n = x, np.where(np.array(running, bool), words, 0) if len(row) else words, len(answers)
        self.rows = row
        self.chars = np.array([len(t) for t in self.lines], np.int64)


class Field:
    """A linear-chain conditional random field with real features."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None, first: np.ndarray | None = None) -> None:
        k = len(TAGS)
        self.weights = np.zeros((len(FEATURES), k)) if weights is None else weights
        self.moves = np.zeros((k, k)) if moves is None else moves
        self.first = np.zeros(k) if first is None else first

    def fit(self, sequences: list[np.ndarray], tags: list[np.ndarray], rounds: int = 300, rate: float = 0.1, decay: float = 5e-4) -> Field:
        """By maximum likelihood with Adam steps on all sequences at once; deterministic."""
        n, longest, k = len(sequences), max(map(len, sequences)), len(TAGS)
        x = np.zeros((n, longest, len(FEATURES)))
        y = np.zeros((n, longest), np.int64)
        mask = np.zeros((n, longest), bool)
        for i, (s, t) in enumerate(zip(sequences, tags, strict=True)):
            x[i, : len(s)], y[i, : len(s)], mask[i, : len(s)] = s, t, True
        hot = np.eye(k)[y] * mask[..., None]
        seen = np.einsum("ntf,ntk->fk", x, hot)
        pairs = mask[:, 1:]
        seen_moves = np.einsum("ntj,ntk->jk", hot[:, :-1] * pairs[..., None], hot[:, 1:] * pairs[..., None])
        seen_first = hot[:, 0].sum(0)
        state = [np.zeros_like(p) for p in (self.weights, self.moves, self.first) for _ in range(2)]
        for step in range(1, rounds + 1):
            emit = x @ self.weights
            alpha, beta = np.zeros((n, longest, k)), np.zeros((n, longest, k))
            alpha[:, 0] = emit[:, 0] + self.first
            for t in range(1, longest):
                alpha[:, t] = np.where(mask[:, t, None], emit[:, t] + _logsum(alpha[:, t - 1, :, None] + self.moves, 1), alpha[:, t - 1])
            for t in range(longest - 2, -1, -1):
                beta[:, t] = np.where(mask[:, t + 1, None], _logsum(self.moves + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
            total = _logsum(alpha[:, -1], 1)
            node = np.exp(alpha + beta - total[:, None, None]) * mask[..., None]
            edge = np.exp(np.clip(alpha[:, :-1, :, None] + self.moves + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None], -60, 0)) * pairs[..., None, None]
            grads = (
                (seen - np.einsum("ntf,ntk->fk", x, node)) / n - decay * self.weights,
                (seen_moves - edge.sum((0, 1))) / n - decay * self.moves,
                (seen_first - node[:, 0].sum(0)) / n - decay * self.first,
            )
            for p, (param, grad) in enumerate(zip((self.weights, self.moves, self.first), grads, strict=True)):
                m, v = state[2 * p], state[2 * p + 1]
                m[...] = 0.9 * m + 0.1 * grad
                v[...] = 0.99 * v + 0.01 * grad * grad
                param += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self

    def best(self, x: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """The most likely tags of all sequences (rows: sorted number of the sequence of each clause), by Viterbi over all at once."""
        emit = np.einsum("nf,fk->nk", x, self.weights)  # no threads of a linear algebra library beside the task's own
        if not len(emit):
            return np.zeros(0, np.int64)
        starts = np.searchsorted(rows, np.arange(n))
        sizes = np.diff(np.append(starts, len(rows)))
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        starts, sizes = starts[order], sizes[order]
        back = np.zeros((len(emit), len(TAGS)), np.int8)
        score = emit[starts] + self.first
        scores = np.zeros((len(emit), len(TAGS)), np.float64)
        scores[starts] = score
        live = np.searchsorted(-sizes, -np.arange(1, sizes[0]), "left")
        for t in range(1, sizes[0]):
            m = live[t - 1]
            at = starts[:m] + t
            through = scores[at - 1][:, :, None] + self.moves
            back[at] = through.argmax(1)
            scores[at] = through.max(1) + emit[at]
        tags = np.zeros(len(emit), np.int64)
        last = starts + sizes - 1
        tags[last] = scores[last].argmax(1)
        for t in range(sizes[0] - 1, 0, -1):
            m = live[t - 1]
            at = starts[:m] + t
            tags[at - 1] = back[at, tags[at]]
        return tags


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))


# Parts of answers that decline, from which the field learns: regrets, what can't be done, with what, and what may follow.
_PARTS = {
    "ru": (("К сожалению, ", "Извините, но ", ""), ("я не могу выполнить", "я не в состоянии обработать", "как языковая модель, я не буду преобразовывать", "я должен отклонить"), (" этот запрос.", " эту главу.", " это."), ("", "Чем я могу помочь?")),
    "en": (("I'm sorry, but ", "Unfortunately, ", ""), ("I cannot help with", "I am not able to process", "as a language model, I must decline to convert", "I have to reject"), (" this request.", " this chapter.", " it."), ("", "How else can I help you?")),
    "uk": (("На жаль, ", "Вибачте, але ", ""), ("я не можу виконати", "я не зможу обробити", "як мовна модель, я не буду перетворювати", "я мушу відхилити"), (" цей запит.", " цей розділ.", " це."), ("", "Чи можу я ще допомогти?")),
    "de": (("Leider ", "Entschuldigung, aber ", ""), ("kann ich nicht bearbeiten: ", "muss ich ablehnen, da ich als Sprachmodell nicht helfen darf: ", "ich bin nicht in der Lage zu verarbeiten: ", "ich verweigere "), ("diese Anfrage.", "dieses Kapitel.", "das."), ("", "Kann ich Ihnen sonst helfen?")),
    "es": (("Lo siento, pero ", "Lamentablemente, ", ""), ("no puedo realizar", "no me es posible procesar", "como modelo de lenguaje, no voy a convertir", "debo rechazar"), (" esta solicitud.", " este capítulo.", " esto."), ("", "¿Puedo ayudarle en algo más?")),
    "pt": (("Lamento, mas ", "Infelizmente, ", ""), ("não posso realizar", "não consigo processar", "como modelo de linguagem, não vou converter", "devo recusar"), (" este pedido.", " este capítulo.", " isto."), ("", "Posso ajudar em algo mais?")),
}


def declining(lang: str, number: int) -> list[str]:
    """An answer that declines, as its clauses; different numbers give different parts."""
    sorry, cannot, what, more = _PARTS[lang]
    first = sorry[number % 3] + cannot[number // 3 % 4] + what[(number + number // 12) % 3]
    second = more[(number + number // 3) % 2]
    return [first[0].upper() + first[1:], *([second] if second else [])]


_PREFACE = {"ru": "Вот текст:", "en": "Here is the text:", "uk": "Ось текст:", "de": "Hier ist der Text:", "es": "Aquí está el texto:", "pt": "Aqui está o texto:"}


def training_pairs(samples: list[tuple[str, str]]) -> list[tuple[str, str, list[str]]]:
    """(source, answer, tag of each clause) built from samples of known language."""
    by: dict[str, list[list[str]]] = {}
    for lang, text in samples:
        sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
        if len(sentences) > 1:
            by.setdefault(lang, []).append(sentences)
    langs = sorted(by)
    pairs = []
    for number, lang in enumerate(langs):
        for k, one in enumerate(by[lang]):
            more = by[lang][(k + 1) % len(by[lang])]
            title, body = one[0].rstrip("."), one[1:] + more[1:]
            source = f"<h1>{title}</h1>" + "".join(f"<p>{s.replace('`', '')}</p>" for s in body)
            code = ["```bash", "ls -l", "```"]
            quote = f"> «{declining(lang, k)[0].rstrip('.')}». {body[0]}"
            kind = k % 8
            if kind == 0:
                pairs.append((source if k % 3 else "", "\n\n".join([f"# {title}", *body]), ["answer"] * (1 + len(body))))
            elif kind == 1:
                pairs.append((source, "\n".join([_PREFACE[lang], f"# {title}", quote, *code, *body]), ["answer"] * (6 + len(body))))
            elif kind == 2:
                for some in range(3):
                    own = declining(lang if (k + some) % 3 else langs[(number + 1) % len(langs)], k // 8 + 5 * some)
                    head = [f"# {title}"] if some % 2 else []
                    pairs.append((source if k % 3 else "", "\n\n".join([*head, *own]), ["answer"] * len(head) + ["refusal"] * len(own)))
            elif kind == 3:
                page = source.replace("</h1>", '</h1><pre><code class="language-bash">a = 1\nb:\n  c: 2</code></pre>')
                echo = html.escape(page) if k % 3 == 0 else page
                lines = 4 if k % 16 < 8 else 3
                if k % 16 < 8:
                    echo = "HTML:\n" + echo
                if k % 5:
                    echo = echo.replace("</p>", "</p>\n").replace("&lt;/p&gt;", "&lt;/p&gt;\n")
                    lines += len(body) - 1
                pairs.append((page, echo, ["answer"] * (k % 16 < 8) + ["echo"] * (lines - (k % 16 < 8))))
            elif kind in (4, 5):
                other = langs[(number + 1 + k % (len(langs) - 1)) % len(langs)] if len(langs) > 1 else lang
                foreign = by[other][k % len(by[other])][1:] + by[other][(k + 1) % len(by[other])][1:]
                shown, tags = [f"# {title}"], ["answer"]
                for part, sentence in enumerate(foreign[: 1 + k // 8 % 4]):
                    shown.append(sentence)
                    tags.append("foreign")
                    if (k // 8 + part) % 2:  # code and tables between don't make it an answer
                        shown.extend(code)
                        tags.extend(["answer"] * len(code))
                pairs.append((source + "<pre><code>ls -l</code></pre>", "\n".join(shown), tags))
            elif kind == 6:
                answer = "\n\n".join([f"# {title}", *body])
                answer = answer[: len(answer) - max(4, len(body[-1]) // 3)]
                answer += ("", "…", "...", "�", " `ab", " (ab")[k // 8 % 6]
                pairs.append((source if k // 8 % 3 else "", answer, ["answer"] * len(body) + ["unfinished"]))
            else:
                table = ["| 1 | 2 |", "|---|---|", f"| {title} | 7 |"]
                items = [f"- {s.rstrip('.')}" for s in body]
                pairs.append((source, "\n".join([f"# {title}", *table, *items]), ["answer"] * (4 + len(items))))
    return pairs


def fitted(samples: list[tuple[str, str]], profiles: Profiles) -> Field:
    sequences, tags = [], []
    for source, answer, names in training_pairs(samples):
        c = Clauses([answer], [source], profiles)
        if len(c.lines) != len(names):
            raise ValueError(f"{len(c.lines)} clauses but {len(names)} tags: {answer!r}")
        sequences.append(c.x)
        tags.append(np.array([TAGS.index(t) for t in names]))
    return Field().fit(sequences, tags)


@lru_cache(2)
def model_of(samples: tuple[tuple[str, str], ...]) -> tuple[Profiles, Field]:
    """Profiles and field of sample rows; the same rows give the same model, which is kept for further queries."""
    profiles = Profiles(list(samples), marker=word_classes)
    return profiles, fitted(list(samples[:TRAINING_ROWS]), profiles)


def defects(answers: list[str | None], sources: list[str | None], profiles: Profiles, field: Field) -> list[str | None]:
    """The defect of each pair, or None."""
    out: list[str | None] = ["empty" if is_empty(a) else None for a in answers]
    there = [i for i, d in enumerate(out) if d is None]
    if not there:
        return out
    c = Clauses([answers[i] for i in there], [sources[i] for i in there], profiles)
    tags = field.best(c.x, c.rows, c.n)
    share = lambda tag, weight: np.bincount(c.rows, weight * (tags == TAGS.index(tag)), c.n) / np.maximum(np.bincount(c.rows, weight, c.n), 1)
    echo, refusal, foreign = share("echo", c.chars), share("refusal", c.words), share("foreign", c.words)
    last = np.zeros(c.n, bool)
    if len(c.rows):
        ends = np.flatnonzero(np.append(np.diff(c.rows) > 0, True))
        last[c.rows[ends]] = tags[ends] == TAGS.index("unfinished")
    for k, i in enumerate(there):
        out[i] = "copy" if echo[k] > MOST else "refusal" if refusal[k] > MOST else "other_language" if foreign[k] > MOST else "truncated" if last[k] else None
    return out


def broken_pairs(answers: DataFrame, key: str, text: str, answer_source: str, sources: DataFrame, source_key: str, source_text: str, samples: DataFrame) -> DataFrame:
    """(key, defect) of every answer whose source exists and that has a defect.

    Both texts are shuffled once, on the source's key; the answers of a source that more than
    a thousandth of all answers belong to are split into parts. Sources are not made unique
    before it: their repeated rows only repeat answers, and repeated results are dropped at
    the end, when they are a key and a word.
    """
    profiles, field = model_of(tuple(sample_rows(samples)))
    own = sources.select(F.col(source_key).alias("sk"), F.coalesce(F.col(source_text), F.lit("")).alias("s")).filter("sk is not null")
    rows = answers.select(F.col(key).alias("k"), F.col(answer_source).alias("a"), F.col(text).alias("t")).filter("a is not null")
    joined = split_join(rows, own, "a", "sk", "k", shuffled=True).select("k", "t", "s")
    kind = joined.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ("t", "s")):
            found = pa.array(defects(batch.column("t").to_pylist(), batch.column("s").to_pylist(), profiles, field), pa.string())
            has = found.is_valid()
            yield pa.RecordBatch.from_arrays([batch.column("k").filter(has), found.filter(has)], ["k", "defect"])

    return joined.mapInArrow(run, f"k {kind}, defect string").withColumnRenamed("k", key).dropDuplicates([key])

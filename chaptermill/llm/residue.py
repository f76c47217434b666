"""Template residue, filler, error-page text and script notices in short fields.

The words of all values of a batch are matched at once with one multi-pattern automaton:
phrases in six languages, also as they stand in a slug (transliterated and without accents),
and words that go with such phrases, which count only in a run of matches that holds one. Unfilled placeholders, fillers
of one letter and notes to oneself are matched by patterns, whose letters count as well. A
value is residue if what was matched covers a high share of its letters and digits, so a
chapter that deals with such things by name is not. A named placeholder in template brackets
covers, beside itself, the text it is to complete, unless that text speaks about placeholders.
Each field is judged by its own value alone.

Null, empty and blank values are not residue. A repeated row gives one result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import sliced

#: Share of a value's letters and digits that has to be matched.
COVERAGE = 0.62

# The phrases, by kind.
PHRASES = {
    "error": """
        400|401|403|404|405|408|410|413|429|500|501|502|503|504|http 400|http 401|http 403|http 404|http 405|http 408|http 410|http 413|http 429|http 500|http 501|http 502|http 503|http 504
        bad request|unauthorized|forbidden|not found|page not found|file not found|resource not found|method not allowed|request timeout|too many requests|payload too large
        internal server error|server error|not implemented|bad gateway|service unavailable|service temporarily unavailable|temporarily unavailable|gateway timeout|gateway time out
        error|error page|error occurred|an error occurred|an unexpected error occurred|unexpected error|unknown error|fatal error|fatal error out of memory|out of memory
        something went wrong|oops something went wrong|try again later|please try again later|access denied|permission denied|connection refused|connection reset|connection timed out|upstream request timeout|no healthy upstream
        upstream connect error|this page isn't working|this page isn t working|this page is not working|this site can't be reached|traceback most recent call last|traceback|stack trace|segmentation fault|nullpointerexception
        page cannot be displayed|page can't be displayed|page could not be displayed|page can not be displayed|can't find that page|cannot find that page|couldn't find that page|couldn't find the page|page you requested|page you are looking for|page does not exist|page doesn't exist|could not be loaded|failed to load|an internal error
        не удалось загрузить страницу|страница не может быть отображена|не удаётся отобразить страницу|страница не существует|запрошенная страница|сторінка не може бути показана|не вдалося завантажити сторінку|сторінка не існує|seite kann nicht angezeigt werden|seite konnte nicht geladen werden|seite existiert nicht|diese seite wurde nicht gefunden
        no se puede mostrar la página|no se pudo cargar la página|la página no existe|página não pode ser exibida|não foi possível carregar a página|a página não existe
        request denied|under maintenance|site under maintenance|site is under maintenance
        ошибка|ошибка сервера|внутренняя ошибка сервера|страница не найдена|файл не найден|не найдено|доступ запрещён|доступ запрещен|отказано в доступе|сервис временно недоступен|сервис недоступен|временно недоступен|сайт временно недоступен
        что-то пошло не так|что то пошло не так|попробуйте позже|попробуйте ещё раз|повторите попытку позже|произошла ошибка|непредвиденная ошибка|неверный запрос|слишком много запросов|время ожидания истекло|ведутся технические работы
        помилка|помилка сервера|внутрішня помилка сервера|сторінку не знайдено|сторінка не знайдена|не знайдено|доступ заборонено|сервіс тимчасово недоступний|тимчасово недоступний|щось пішло не так|спробуйте пізніше|сталася помилка|забагато запитів
        fehler|serverfehler|interner serverfehler|seite nicht gefunden|nicht gefunden|zugriff verweigert|dienst nicht verfügbar|dienst vorübergehend nicht verfügbar|etwas ist schiefgelaufen|bitte versuchen sie es später erneut|ungültige anfrage|zu viele anfragen|zeitüberschreitung
        error del servidor|error interno del servidor|página no encontrada|no encontrada|no encontrado|acceso denegado|servicio no disponible|servicio temporalmente no disponible|algo salió mal|algo ha salido mal|inténtelo más tarde|inténtelo de nuevo más tarde|solicitud incorrecta|demasiadas solicitudes|ha ocurrido un error
        erro|erro do servidor|erro interno do servidor|página não encontrada|não encontrada|não encontrado|acesso negado|serviço indisponível|serviço temporariamente indisponível|algo deu errado|algo correu mal|tente novamente mais tarde|pedido inválido|demasiados pedidos|ocorreu um erro
    """,
    "script": """
        enable javascript|please enable javascript|please enable javascript to continue|enable javascript to continue|you need to enable javascript|you need to enable javascript to run this app|javascript is required|javascript is required to view this page
        javascript required|javascript is disabled|javascript is disabled in your browser|your browser does not support scripts|your browser does not support javascript|your browser is not supported|your browser is out of date|please update your browser
        turn javascript on|allow javascript|activate javascript|switch on javascript|javascript must be enabled|javascript has to be enabled|javascript needs to be enabled|javascript is turned off|javascript is not enabled|enable scripts|включите скрипты|schalten sie javascript ein|javascript muss aktiviert|javascript debe estar|javascript precisa estar
        turn on javascript|please turn on javascript|please enable cookies|enable cookies to continue|cookies are required|just a moment|checking your browser|checking your browser before access|checking your browser before accessing|verify you are human|this site requires javascript
        включите javascript|для работы сайта включите javascript|пожалуйста включите javascript|для просмотра страницы включите javascript|у вас отключён javascript|у вас отключен javascript|javascript отключён|javascript отключен|ваш браузер не поддерживает скрипты|ваш браузер не поддерживает javascript|ваш браузер устарел|обновите браузер|проверка браузера|включите поддержку javascript
        увімкніть javascript|увімкніть javascript щоб продовжити|будь ласка увімкніть javascript|javascript вимкнено|у вас вимкнено javascript|ваш браузер не підтримує скрипти|ваш браузер не підтримує javascript|перевірка браузера
        bitte aktivieren sie javascript|aktivieren sie javascript|javascript ist erforderlich|javascript ist deaktiviert|ihr browser unterstützt keine skripte|ihr browser unterstützt kein javascript|ihr browser wird nicht unterstützt|bitte aktivieren sie cookies|einen moment bitte
        active javascript|active javascript para continuar|habilite javascript|habilite javascript para continuar|por favor active javascript|se requiere javascript|javascript está desactivado|su navegador no admite scripts|su navegador no es compatible|su navegador no admite javascript|un momento por favor
        ative o javascript|ative o javascript para ver esta página|ative o javascript para continuar|habilite o javascript|é necessário ativar o javascript|javascript é necessário|javascript está desativado|o seu navegador não suporta scripts|o seu navegador não suporta javascript|um momento por favor
    """,
    "filler": """
        lorem|ipsum|lorem ipsum|dolor sit amet|dolor sit|sit amet|consectetur|adipiscing|eiusmod|incididunt|sed do eiusmod
        todo|tbd|tba|tbc|fixme|xxx|xxx xxx|todo title|todo write|todo дописать|todo заголовок|to be determined|to be done|to do|to be written|wip|asdf|asdf asdf|asdfgh|qwerty|qwertz|azerty|qwerty qwerty|foo|foo bar|foobar|blah|blah blah|test test
        йцукен|фыва|фывафыва|йцукенг|фывапролдж
        placeholder|placeholder text|title placeholder|slug placeholder|name placeholder|page placeholder|chapter placeholder|heading placeholder|section placeholder|file placeholder|filename placeholder|text placeholder
        sample title|sample title goes here|sample text|sample text goes here|title goes here|text goes here|your title here|your text here|your name here|your slug here|your page here|your chapter here|your heading here|your section here|title here|slug here|name here|text here|page here|chapter here
        insert title|insert title here|insert name|insert name here|insert slug|insert page|insert chapter|insert heading|insert section|insert text|insert text here|enter title|enter title here|enter name here|enter text here|chapter title|page title|chapter name|page name|filename|file name|untitled|untitled document|no title|dummy text|filler text
        заполнить|заглушка|заголовок заглушка|текст заглушка|здесь будет заголовок|здесь будет текст|здесь будет название|введите название|введите название раздела|введите название главы|введите заголовок|введите текст|вставьте заголовок|вставьте название|укажите заголовок|укажите название|название главы|название раздела|название компонента|без названия|дописать|рыба|рыбный текст|текст рыба|текст рыба для проверки вёрстки|текст рыба для проверки верстки|пример заголовка
        заповнити|тут буде заголовок|тут буде текст|введіть назву|введіть назву розділу|введіть заголовок|вставте заголовок|вкажіть заголовок|назва розділу|без назви|текст заповнювач
        blindtext|platzhalter|platzhaltertext|fülltext|titel hier einfügen|titel hier eingeben|text hier einfügen|hier titel einfügen|hier steht der titel|ohne titel|kapiteltitel
        texto de relleno|texto de ejemplo|texto de muestra|escriba aquí el título|escriba el título aquí|inserte el título|inserte aquí el título|inserte el título aquí|título aquí|título de ejemplo|título del capítulo|sin título|marcador de posición
        texto de preenchimento|texto de exemplo|escreva aqui o título|insira o título|insira aqui o título|insira o título aqui|título aqui|título de exemplo|título do capítulo|sem título|marcador de posição
    """,
    "missing": """
        undefined|null|none|nan|nil|void|n/a|na|nullptr|undefined undefined|null null|object object|chapter undefined|page undefined|title undefined|slug undefined|name undefined|section undefined|undefined chapter|undefined page|chapter null|page null|title null|chapter none|missing value
    """,
}

# Fixed value: the filler passage; every two words of it in a row are a phrase.
PASSAGE = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat"

# Words that go with those phrases; they count only in a value that holds one.
BESIDE = """
    please|and|then|the|a|to|for|of|in|on|your|this|that|we|it|is|are|was|sorry|oops|again|later|try|retry|reload|refresh|continue|view|run|use|page|site|app|browser|server|moment|code|status|here|now
    dolor|amet|elit|tempor|labore|dolore|magna|aliqua|enim|minim|veniam|bar|baz|value|ref|exception|text|title
    пожалуйста|и|затем|для|в|на|этот|эту|вашем|браузере|страницу|страница|сайт|сайта|перезагрузите|обновите|попробуйте|снова|позже|продолжить|чтобы|будь|ласка|сторінку|оновіть|спробуйте|пізніше|щоб|продовжити|у|браузері
    bitte|und|dann|die|das|der|seite|diese|in|ihrem|browser|laden|sie|neu|später|erneut|um|fortzufahren|por|favor|y|e|la|o|a|os|esta|página|en|no|su|seu|navegador|recargue|recarregue|más|mais|tarde|para|continuar|ver
"""

# How an unfilled placeholder is bracketed.
_PLACEHOLDER = re.compile(
    r"\{\{.*?\}\}|\{%.*?%\}|<%.*?%>|\$\{[^{}\n]*\}|\[\[[^\[\]\n]*\]\]|\{[\w. \t-]*\}|<[^\W\d][^<>\n]*>|__[^\W_][\w.]*?__|%[^\W\d_][\w.-]*%|\$[^\W\d_]\w*|%[sdif]\b|%\([^()\n]*\)[sdif]"
    r"|(?<![^\s.]):[^\W\d_]\w*|#(?:REF|N/A|VALUE|NAME|NULL|DIV/0)[!?]?|\[object \w+\]"
)
#: A line that is one pair of brackets, letters repeated, a note to oneself.
_BRACKETS = re.compile(r"^(?:\[[^\[\]\n]+\]|<[^<>\n]+>|\{[^{}\n]+\})$", re.M)
_FILLERS = re.compile(r"^([^\W\d_])\1{2,}(?:[ \t]+\1{2,})*$|^(?:TODO|TBD|FIXME|XXX)[ \t]*[:–—-].*$", re.I | re.M)
#: Brackets that a text has for nothing else.
_UNMISTAKABLE = ("{{", "{%", "<%", "${", "[[", "__")
#: A placeholder that names what should stand there, and the words with which a text speaks about placeholders.
_NAMED = re.compile(r"[^\W\d_]{2}")
_ABOUT = re.compile(
    r"templat|variab|placeholder|param|argument|value|syntax|macro|marker|шаблон|переменн|параметр|значен|синтакс|макрос|маркер|змінн|vorlage|platzhalter|plantilla|marcador|variáve|modelo|valor|wert", re.I
)
# Latin spellings of Cyrillic letters in slugs; the second and third are used where they differ from the first.
SPELLINGS = (
    dict(zip("абвгдезийклмнопрстуфхцыэіґ", "abvgdezijklmnoprstufhcyeig", strict=True)) | {"ё": "e", "ж": "zh", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ь": "", "ю": "yu", "я": "ya", "ї": "yi", "є": "ye"},
    {"й": "i", "х": "kh", "ц": "ts", "щ": "shch", "ю": "iu", "я": "ia", "ї": "i", "є": "ie"},
    {"й": "y", "х": "kh", "ц": "ts", "щ": "shch"},
)
_NUMBERING = re.compile(r"\s*(?:#{1,6}\s+)?(?:\d+(?:\.\d+)*[.)]\s*)?")
_FILE_NUMBER = re.compile(r"([^.\s]+|\{\{[^{}]*\}\}|\$\{[^{}]*\})\.(?=.*\.\w+$)")
_FILE_END = re.compile(r"\.(?:md|markdown|html?|txt|ext|docx?)$", re.I)
_MISSING_NUMBER = re.compile(r"(?:nan|undefined|null|none|n|nn|x+)$", re.I)
_WORDS = re.compile(r"(?:(?!\n)[\W_])+")
_KINDS = ("placeholder", *PHRASES)


def spellings(text: str) -> set[str]:
    """A text in lower case as slugs may spell it in Latin letters."""
    lower = unicodedata.normalize("NFC", text.lower())
    return {"".join((SPELLINGS[0] | other).get(c, c) for c in lower) for other in ({}, *SPELLINGS[1:])}


def _plain(value: str) -> str:
    """Lower case words without accents, one space between; lines stay lines."""
    flat = unicodedata.normalize("NFKD", value.casefold())
    flat = "".join(c for c in flat if not unicodedata.combining(c) or c == "̆")
    return _WORDS.sub(" ", unicodedata.normalize("NFC", flat))


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    """Phrases as " words " with their kind (0: only beside others) and length."""
    automaton = ahocorasick.Automaton()
    for kind, block in (("", BESIDE), *PHRASES.items()):
        number = _KINDS.index(kind) if kind else 0
        for phrase in (p.strip() for line in block.strip().splitlines() for p in line.split("|")):
            for form in {_plain(phrase).strip(), *(_plain(x).strip() for x in spellings(phrase))}:
                if form:
                    automaton.add_word(f" {form} ", (number, len(form)))
    passage = PASSAGE.split()
    for two in (f"{a} {b}" for a, b in zip(passage, passage[1:], strict=False)):
        automaton.add_word(f" {two} ", (_KINDS.index("filler"), len(two)))
    automaton.make_automaton()
    return automaton


def _content(field: str, value: str) -> str:
    """What of a value names something: without numbering, and a file's name without number and extension."""
    value = value.strip()
    if field == "filename":
        number = _FILE_NUMBER.match(value)
        if number:
            first = number.group(1)
            if _PLACEHOLDER.fullmatch(first) or _MISSING_NUMBER.match(first):
                return "{{" + _WORDS.sub(" ", first) + " number}}"
            if first.isdigit():
                return _FILE_END.sub("", value[number.end() :]).strip() or value[number.end() :]
        return _FILE_END.sub("", value).strip() or value
    return value if field == "slug" else value[_NUMBERING.match(value).end() :].strip() or value


def judged(field: str, value: str | None) -> tuple[float, str]:
    """judged_all() of one value."""
    share, kinds = judged_all([field], [value])
    return float(share[0]), kinds[0]


def judged_all(fields: list[str], values: list[str | None]) -> tuple[np.ndarray, list[str]]:
    """Share of residue in each value of a field ("title", "filename", "slug" or any other), and its kind: "" without residue."""
    n = len(values)
    text = "\n".join(" ".join(_content(f, v).split("\n")) if v and v.strip() else "" for f, v in zip(fields, values, strict=True))
    by_pattern = np.zeros((n, len(_KINDS)))
    named = np.zeros(n, bool)

    def taken(kind: int):
        ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10)

        def take(m: re.Match) -> str:
            row = int(np.searchsorted(ends, m.start()))
            by_pattern[row, kind] += max(1, sum(c.isalnum() for c in m.group()))
            if kind == 0 and m.group().startswith(_UNMISTAKABLE) and _NAMED.search(m.group()):
                named[row] = True
            return " "

        return take

    for pattern, kind in ((_BRACKETS, 0), (_PLACEHOLDER, 0), (_FILLERS, _KINDS.index("filler"))):
        text = pattern.sub(taken(kind), text)
    rest = text.split("\n")
    plain = " " + _plain(text).replace("\n", " \n ") + " "
    points = np.frombuffer(plain.encode("utf-32-le"), np.uint32)
    row = np.cumsum(points == 10) - (points == 10)
    letter = (points != 32) & (points != 10)
    found = [(end - size, end, kind) for end, (kind, size) in _automaton().iter(plain)]
    begin, end, kind = (np.array([x[k] for x in found], np.int64) for k in range(3))

    def spans(some: np.ndarray) -> np.ndarray:
        """Points inside the matches, the space after each included."""
        edges = np.zeros(len(points) + 1, np.int64)
        np.add.at(edges, begin[some], 1)
        np.add.at(edges, end[some] + 1, -1)
        return np.cumsum(edges[:-1]) > 0

    phrase, whole = spans(kind > 0), spans(kind >= 0)
    run = np.cumsum(np.concatenate(([whole[0]], whole[1:] != whole[:-1])))  # words beside count in a run that holds a phrase
    covered = np.bincount(row, letter & whole & (np.bincount(run, phrase)[run] > 0), n)
    of_kind = by_pattern.copy()
    np.add.at(of_kind, (row[begin[kind > 0]], kind[kind > 0]), (end - begin)[kind > 0])
    for i in np.flatnonzero(named):
        if not _ABOUT.search(rest[i]):  # it stands in place of content
            covered[i] = max(covered[i], np.count_nonzero(letter & (row == i)))
    total = by_pattern.sum(1) + np.bincount(row, letter, n)
    signs = np.array([bool(v and v.strip()) for v in values]) & (total == 0)  # nothing but signs
    share = np.where(signs, 1.0, (by_pattern.sum(1) + covered) / np.maximum(total, 1))
    of_kind[signs, _KINDS.index("filler")] = 1
    return share, [_KINDS[k] if some else "" for k, some in zip(of_kind.argmax(1).tolist(), of_kind.any(1).tolist(), strict=True)]


def residue(df: DataFrame, key: str, fields: tuple[str, ...], coverage: float = COVERAGE) -> DataFrame:
    """(key, field, value, share, kind) of each field value of df that is residue. No shuffle but one of the results."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields)))
    values = df.select(F.col(key).alias("k"), each.alias("x")).select("k", "x.field", "x.value").filter("value is not null")
    kind = values.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "value"):
            share, kinds = judged_all(batch.column("field").to_pylist(), batch.column("value").to_pylist())
            keep = np.flatnonzero(share >= coverage)
            if len(keep):
                rows = batch.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(share[keep]), pa.array([kinds[i] for i in keep], pa.string())], ["k", "field", "value", "share", "residue"])

    found = values.mapInArrow(run, f"k {kind}, field string, value string, share double, residue string")
    return found.withColumnRenamed("k", key).dropDuplicates([key, "field"])

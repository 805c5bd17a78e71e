"""Template residue, filler and error-page text (problem 1).

One Aho-Corasick automaton holds phrases of error pages, script notices and filler in several languages,
and the openings of template placeholders. A document is residue when the matched phrases cover at least the
share COVERAGE of its length. Residue may also be inserted into sound text; so a sentence, a line, or an
unpunctuated stretch of dense matches is taken for a document of its own, and the greatest of these coverages
decides. A whole placeholder covers itself wholly. A passing mention ("the server served the writ") covers too
little of its sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import kernel as K

COVERAGE = 0.34  # least share of the characters of a document, or of a sentence or line in it, that matched phrases must cover
LEAST = 8  # characters that they must cover in any case
DENSE = 28  # matched characters that suffice where they stand close together in an unpunctuated text
REPEATS = 4  # equal words in a row that count as filler

# Phrases of notices that scripts are required, as pages commonly word them.
SCRIPT = """
enable javascript|turn on javascript|activate javascript|javascript is disabled|javascript is required|requires javascript|javascript must be|without javascript|
javascript is not enabled|javascript has been disabled|javascript to continue|javascript to view|javascript in the settings|javascript in your browser|does not support javascript|turn javascript on|javascript to use|needs javascript|javascript enabled|
in your browser|your browser|this browser|does not support scripts|support scripts|allow scripts|scripts must be|cookies and scripts|scripts have to be|scripts are blocked|scripts are disabled|
without scripting|enable scripts|enable scripting|stopped scripts|blocked scripts|ad blocker|it looks like an ad blocker|looks like you are using an ad blocker|adblock|script blocker|enable cookies|cookies must be|cookies are required|cookies to continue|must be active|switched on|cannot be shown|cannot be displayed|will not run|
verify that you are human|verify you are human|are not a robot|checking your browser|just a moment|checking if the site connection is secure|<noscript>|</noscript>|then press f5|press f5|reload page|reload the page|refresh the page|refresh this page|works best with it on|turn it on and|to continue reading|
javascript aktivieren|aktivieren sie javascript|javascript ist deaktiviert|bitte javascript|javascript erforderlich|in ihrem browser|ihr browser|cookies aktivieren|skripte|unterstützt kein javascript|seite neu laden|
activer javascript|activez javascript|veuillez activer javascript|javascript est désactivé|javascript est requis|dans votre navigateur|votre navigateur|activer les scripts|activez les cookies|recharger la page|rechargez la page|
activar javascript|active javascript|habilite javascript|habilitar javascript|activa javascript|javascript está desactivado|javascript está deshabilitado|en su navegador|en tu navegador|su navegador|tu navegador|recargue la página|recarga la página|requiere javascript|
abilitare javascript|abilita javascript|attivare javascript|attiva javascript|javascript è disabilitato|javascript disabilitato|nel browser|il tuo browser|ricarica la pagina|richiede javascript|
ative o javascript|ativar o javascript|habilite o javascript|no seu navegador|recarregue a página|
включите javascript|включить javascript|javascript отключен|javascript отключён|в вашем браузере|ваш браузер|обновите страницу|требуется javascript|
启用javascript|请启用javascript|需要javascript|您的浏览器|浏览器不支持|刷新页面|重新加载页面|javascriptを有効|お使いのブラウザ
"""

# Phrases of error pages and failed calls, as servers and programs commonly word them.
ERROR = """
404 not found|404 page not found|error 404|page not found|page can't be found|page can’t be found|page cannot be found|page could not be found|page you requested|page you are looking for|was not found on this server|not found on this server|the requested url|the requested page|the requested resource|could not be found|
500 internal server error|internal server error|http 500|http 502|http 503|http 504|http 404|http 403|http 429|http error|error 500|error 502|error 503|error 504|error 403|server error|502 bad gateway|bad gateway|503 service|service temporarily unavailable|service unavailable|temporarily unavailable|504 gateway|gateway timeout|gateway time-out|closed the connection|
something went wrong|on our end|try again later|please try again|try searching for|oops!|we are sorry, but something|an error occurred|an error has occurred|an unexpected error|unexpected error|unhandled exception|
error establishing a database connection|database connection|database error|connection was reset|connection reset|connection refused|connection timed out|connection failed|could not connect|unable to connect|can't be reached|took too long to respond|
timed out after|request timed out|has timed out|request timeout|read timed out|timeouterror|
session has expired|session expired|log in again|sign in again|please log in|please sign in|you must be logged in|
403 forbidden|access denied|access to this resource|access is denied|you do not have permission|you don't have permission|permission to view|permission to access|to view resource|
rate limit reached|rate limit exceeded|too many requests|quota exceeded|{"error"|"error":|"code": 4|"code": 5|"code":4|"code":5|"message": "|"status": 5|"status": 4|
down for maintenance|under maintenance|scheduled maintenance|will be back at|we'll be back|we will be back|be right back|under construction|
traceback (most recent call last)|file "<stdin>"|stack trace|nullpointerexception|exception in thread|segmentation fault|syntaxerror:|typeerror:|valueerror:|keyerror:|runtimeerror:|undefined is not|fatal error|warning: mysql|cuda out of memory|out of memory|
<html>|<head>|<title>|</title>|</head>|<body>|</body>|</html>|<!doctype html|
seite nicht gefunden|die seite wurde nicht gefunden|die angeforderte seite|interner serverfehler|serverfehler|zugriff verweigert|keine berechtigung|ein fehler ist aufgetreten|bitte versuchen sie es später|später erneut|sitzung ist abgelaufen|verbindung wurde zurückgesetzt|zeitüberschreitung|wartungsarbeiten|
page introuvable|page non trouvée|la page demandée|erreur interne du serveur|erreur du serveur|accès refusé|accès interdit|vous n'avez pas l'autorisation|une erreur est survenue|une erreur s'est produite|veuillez réessayer|réessayer plus tard|session a expiré|connexion a été réinitialisée|délai d'attente dépassé|en maintenance|
página no encontrada|no se encontró la página|la página solicitada|error interno del servidor|error del servidor|acceso denegado|no tiene permiso|se ha producido un error|ha ocurrido un error|inténtelo de nuevo|inténtalo de nuevo|más tarde|sesión ha caducado|sesión ha expirado|en mantenimiento|
pagina non trovata|la pagina richiesta|errore interno del server|errore del server|accesso negato|non hai il permesso|non disponi dell'autorizzazione|si è verificato un errore|riprova più tardi|riprovare più tardi|sessione è scaduta|sessione scaduta|in manutenzione|
página não encontrada|erro interno do servidor|acesso negado|ocorreu um erro|tente novamente|
страница не найдена|внутренняя ошибка сервера|ошибка сервера|доступ запрещён|доступ запрещен|произошла ошибка|попробуйте позже|повторите попытку|сессия истекла|время ожидания истекло|технические работы|
页面未找到|找不到页面|页面不存在|内部服务器错误|服务器错误|拒绝访问|访问被拒绝|没有权限|发生错误|请稍后再试|请稍后重试|会话已过期|连接已重置|请求超时|系统维护
"""

# Phrases of filler and unwritten sections, as templates commonly word them.
FILLER = """
lorem ipsum|dolor sit amet|dummy text|sample text|placeholder text|filler text|for layout|replace this paragraph|replace this text|with your own content|with your own text|your own content|your text here|your content here|your title here|
type something|add your first paragraph|add your text|add text here|insert text here|enter text here|text goes here|content goes here|first paragraph here|click to edit|click here to edit|edit this text|
coming soon|has not been written yet|not been written yet|not yet written|to be written|to be completed|to be added|to be announced|final wording to follow|wording to follow|text to follow|content to follow|copy to follow|details to follow|placeholder paragraph|todo:|todo |tbd tbd|tbd.|fixme|
blah blah|bla bla|xxx xxx|asdf asdf|test test|text text|foo bar|qwerty|
blindtext|platzhaltertext|beispieltext|mustertext|hier steht ihr text|demnächst verfügbar|texte factice|faux texte|texte d'exemple|votre texte ici|bientôt disponible|texto de relleno|texto de ejemplo|su texto aquí|tu texto aquí|próximamente|testo segnaposto|testo di esempio|il tuo testo qui|prossimamente|пример текста|здесь будет текст|скоро здесь|示例文本|占位文本|此处输入文本|敬请期待
"""

# Words of pseudo-Latin filler that other text seldom holds.
LATIN = """
lorem ipsum dolor amet consectetur adipiscing adipis elit eiusmod tempor incididunt labore dolore magna aliqua veniam nostrud exercitation ullamco ullam laboris nisi aliquip commodo consequat consec tetur aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat occaeca cupidatat cupidat proident sunt culpa officia deserunt mollit anim laborum
"""

# HTML tags, which are no placeholders.
TAGS = frozenset("a abbr article aside b big blockquote body br button center code dd div dl dt em figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input label li link main meta nav noscript ol option p pre q s script section select small span strong style sub sup table tbody td textarea th thead title tr u ul video".split())

_NAME = r"[^\W\d_](?:[\w .]{0,46}\w)?"
#: Opening of a placeholder, and the whole placeholder from there (flags are inline).
PLACEHOLDERS = (
    ("{{", rf"\{{\{{[^{{}}\n]{{0,60}}\}}\}}"),
    ("{%", r"\{%[^{}\n]{0,60}%\}"),
    ("{", rf"\{{\s?{_NAME}\s?\}}"),
    ("<%", r"<%=?[^<>\n]{0,60}%>"),
    ("<", r"<(?:[^\W\d_][\w .]{0,46}|\d ?- ?\d)>"),
    ("${", r"\$\{[^{}\n]{1,60}\}"),
    ('"$', r'"\$[A-Za-z_]+"'),
    ("%(", r"%\([^()\n]{1,60}\)[sdf]"),
    ("@@", rf"@@{_NAME}@@"),
    ("__", rf"__{_NAME}__"),
    ("___", r"(?<!\w)___+(?!\w)"),
    ("«", r"«[a-z0-9_]{2,30}(?: [a-z0-9_]{2,30}){0,2}»"),
    ("[[", rf"\[\[\s?{_NAME}\s?\]\]"),
    ("[insert", r"(?i)\[insert [^\[\]\n]{1,60}\]"),
    ("(insert", r"(?i)\(insert [^()\n]{1,60}\)"),
    ("[your", r"(?i)\[your [^\[\]\n]{1,60}\]"),
    ("<your", r"(?i)<your [^<>\n]{1,60}>"),
    ("[enter", r"(?i)\[enter [^\[\]\n]{1,60}\]"),
    (" to be completed]", r"(?i) to be completed\]"),
    (": [", r"(?i): \[(?:[a-z_]{2,20}|\d ?- ?\d)\]"),
)


def _phrases(text: str) -> list[str]:
    return [p for p in text.replace("\n", "").split("|") if p]


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, text in (("script", SCRIPT), ("error", ERROR), ("filler", FILLER)):
        for p in _phrases(text):
            a.add_word(p, (kind, len(p)))
    for w in LATIN.split():
        for left in " \n":
            for right in " .,\n":
                a.add_word(left + w + right, ("latin", len(w) + 2))
    for i, (opening, _) in enumerate(PLACEHOLDERS):
        a.add_word(opening, ("placeholder", i))
    a.make_automaton()
    return a


@lru_cache(maxsize=1)
def _patterns() -> list[tuple[int, re.Pattern]]:
    return [(len(o), re.compile(p)) for o, p in PLACEHOLDERS]


_SEGMENT = re.compile(r"(?<=[.!?。！？])[\"')\]]*\s+|\n+|(?<=[。！？])")
#: A status line: the protocol or the word with a number, then a dash, colon, bar or the end.
_STATUS = re.compile(r"\s*(?:http(?:/\d\.\d)?|error) ?[45]\d\d\b(?: *[-–—:|]|\s*$)")
_LEGAL = re.compile(r"(?i)\[(?:sic|emphasis|end of|citation|footnote|redacted|omitted|internal)\b")


def _placeholder(text: str, i: int, end: int) -> tuple[int, int] | None:
    size, pattern = _patterns()[i]
    m = pattern.match(text, max(0, end - size + 1))
    if not m:
        return None
    if PLACEHOLDERS[i][0] == "<":
        name = m.group()[1:-1].strip().lower()
        if name in TAGS:
            return None
    if PLACEHOLDERS[i][0] == ": [" and _LEGAL.match(text, m.start() + 2):
        return None
    return m.span()


def _union(spans: list[tuple[int, int]]) -> int:
    total, reach = 0, -1
    for s, e in sorted(spans):
        if e > reach:
            total += e - max(s, reach)
            reach = e
    return total


def judge(text: str, low: str, hits: list[tuple[int, tuple[str, int]]]) -> tuple[str, float] | None:
    """(kind, share of the text that is covered) of a text with automaton hits, or None if it is sound."""
    spans: dict[str, list[tuple[int, int]]] = {}
    holes = []
    for end, (kind, x) in hits:
        if kind == "placeholder":
            if found := _placeholder(text, x, end):
                holes.append(found)
        else:
            spans.setdefault(kind, []).append((end - x + 1, end + 1))
    size = max(1, len(text.strip()))
    if holes:
        return "placeholder", min(1.0, _union(holes) / size)
    if not spans:
        return None
    every = sorted(x for s in spans.values() for x in s)
    most = max(spans, key=lambda k: _union(spans[k]))
    whole = min(1.0, _union(every) / size)
    if whole >= COVERAGE and _union(every) >= LEAST:
        return most, whole
    return (most, whole) if _dense(low, every) or _inserted(text, low, every) else None


def _dense(low: str, every: list[tuple[int, int]]) -> bool:
    """Whether different matches stand close together and cover half of the stretch that they span, for texts without punctuation."""
    group: list[tuple[int, int]] = []
    for s, e in [*every, (1 << 60, 1 << 60)]:
        if group and s - max(x[1] for x in group) > 24:
            n = _union(group)
            if n >= DENSE and len({low[a:b] for a, b in group}) > 1 and n >= 0.5 * (max(x[1] for x in group) - group[0][0]):
                return True
            group = []
        group.append((s, e))
    return False


def _inserted(text: str, low: str, every: list[tuple[int, int]]) -> bool:
    """Whether the matches cover enough of one sentence or line; a status line is one as a whole."""
    at = i = 0
    for cut in [m.end() for m in _SEGMENT.finditer(text)] + [len(text)]:
        inside = []
        while i < len(every) and every[i][0] < cut:
            inside.append((max(at, every[i][0]), min(cut, every[i][1])))
            i += 1
        if inside:
            n = _union(inside)
            if n >= LEAST and (n >= COVERAGE * len(text[at:cut].strip()) or _STATUS.match(low[at:cut])):
                return True
        at = cut
    return False


def findings(col: pa.Array) -> list[tuple[int, str, float]]:
    """(row, kind, coverage) of the texts that hold residue."""
    auto = automaton()
    out: dict[int, tuple[str, float]] = {}
    for a, b in K.chunks(col):
        part = col.slice(a, b - a)
        texts = [t or "" for t in part.to_pylist()]
        lows = [t.lower() if t.isascii() else "".join(c.lower() if len(c.lower()) == 1 else c for c in t).replace("\xa0", " ") for t in texts]
        at = np.cumsum([0] + [len(t) + 3 for t in lows])
        big = " " + " \n ".join(lows) + " \n"
        hits: dict[int, list] = {}
        for end, what in auto.iter(big):
            row = int(np.searchsorted(at, end - 1, side="right")) - 1
            hits.setdefault(row, []).append((end - 1 - int(at[row]), what))
        for row, found in hits.items():
            if verdict := judge(texts[row], lows[row], found):
                out[a + row] = verdict
        # one word on and on
        low, s, e, h, first = K.ascii_words(part)
        if len(h) >= REPEATS:
            n = len(h) - REPEATS + 1
            same = np.ones(n, bool)
            for k in range(1, REPEATS):
                same &= h[:n] == h[k : k + n]
            if same.any():
                own = np.repeat(np.arange(b - a), np.diff(first))
                i = np.flatnonzero(same)
                i = i[(own[i] == own[i + REPEATS - 1]) & (low[s[i]] >= 97)]
                for row in np.unique(own[i]):
                    out.setdefault(a + int(row), ("filler", 1.0))
    return [(row, *out[row]) for row in sorted(out)]


def residue(records: DataFrame, key: str, text: str) -> DataFrame:
    """(rec_id, kind, coverage) of the records whose text holds template residue, filler or an error page.

    `coverage` is the share of the text's characters that matched. Null, empty and blank texts are no
    residue (they hold nothing); repeated rows each count; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if found := findings(batch.column("text")):
                rows = pa.array([x[0] for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("rec_id").take(rows), pa.array([x[1] for x in found]), pa.array([x[2] for x in found], pa.float64())], ["rec_id", "kind", "coverage"])

    rows = records.select(F.col(key).cast("long").alias("rec_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(run, "rec_id long, kind string, coverage double")


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    rew = residue(spark.read.parquet(f"{sf_dir}/scored.parquet"), "row_id", "rew").withColumn("field", F.lit("rew"))
    raw = residue(spark.read.parquet(f"{sf_dir}/judged.parquet"), "judge_id", "raw").withColumn("field", F.lit("raw"))
    return rew.unionByName(raw)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir).select("field", "rec_id")


def p1_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with residue by field and kind, with the mean share of the text that it covers."""
    return _both(spark, sf_dir).groupBy("field", "kind").agg(F.count("*").alias("n"), F.round(F.avg("coverage"), 6).alias("mean_coverage"))


QUERIES = {"p1_found": p1_found, "p1_kinds": p1_kinds}

"""Main body of web pages (p1) and residue pages (p3).

Both rest on site template removal. A page is a tree of sections, lines and the items of a line; each line and item is
hashed with the site's own name and short numbers taken out, the hashes are counted per host, and an element recurring beside
enough differing texts of the host, however many pages it has and however long it is, is template; so is a line all of
whose items are. A hash that is template on several hosts is template everywhere, which reaches hosts seen once. What hangs
below a template heading of teasers goes with it. A list of usual words of page furniture (below, by language) names the
same elements on hosts with too few pages to count.

Counts are pre-aggregated before each shuffle and distinct texts are counted by the bits of one long, so a host with
a third of all pages costs one row per line hash and map task. Texts never leave their rows before the last step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.runtime import cut, host_of

# --- Fixed values: words of page furniture, matched against whole lines in lower case, without bullets, digits as "#". ---
MENU = """home|menu|news|opinion|jobs|help|search|sign in|log in|subscribe|newsletter|newsletters|video|videos|podcast|podcasts|events|data
contact|topics|archive|markets|regions|shop|about us|my account
startseite|menü|nachrichten|meinung|termine|regionen|archiv|abo|anmelden|suche|hilfe|über uns|wirtschaft|themen|kontakt|daten|mein konto|stellen
accueil|actualités|opinions|agenda|régions|archives|s'abonner|connexion|rechercher|aide|qui sommes-nous|économie|thèmes|mon compte|vidéo|vidéos
emploi|données|marchés|boutique
inicio|menú|noticias|opinión|regiones|archivo|suscríbete|entrar|buscar|ayuda|quiénes somos|economía|temas|contacto|mi cuenta|vídeo|vídeos
empleo|datos|mercados|tienda""".replace("\n", "|").split("|")
CONSENT = """ok, got it
got it
manage choices
accept all
accept
reject
agree
settings
accept | reject | settings
zustimmen | ablehnen
zustimmen
ablehnen
alle akzeptieren
einstellungen
tout accepter
accepter | refuser
paramétrer
aceptar todo
aceptar | rechazar
configurar""".split("\n")
NOTICE = """skip to content
skip to main content
zum inhalt
zum inhalt springen
aller au contenu
saltar al contenido
leave a comment
kommentar schreiben
laisser un commentaire
deja un comentario
# comment
# comments
# kommentare
# comentarios
# commentaires
comments
kommentare
comentarios
commentaires
share this article
share print save
share
artikel teilen
partager l'article
compartir
story continues below
weiter nach der anzeige
continúa tras la publicidad
la suite après la publicité
advertisement
sponsored
anzeige
publicidad
publicité
newsletter bestellen
follow us
back to top
nach oben
haut de page
volver arriba
some features of this page need javascript.
your browser is out of date or blocks scripts. some parts cannot be shown.""".split("\n")
LEGAL = """terms of use|privacy|privacy notice|privacy policy|imprint|accessibility|cookie policy|impressum|datenschutz|agb|barrierefreiheit
mentions légales|confidentialité|plan du site|accessibilité|aviso legal|privacidad|mapa del sitio|accesibilidad""".replace("\n", "|").split("|")
STARTS = """©
copyright
(c)
sign up for our
get the newsletter
recibe el boletín
recevoir la lettre
listen to this article
artikel anhören
écouter cet article
escuchar este artículo
photo gallery
bilderstrecke
galerie photos
galería
call the desk
registered office
read also:
see also:
lesen sie auch:
lire aussi :
lire aussi:
à lire aussi :
lea también:
lee también:""".split("\n")
CONTAINS = """is not responsible for the content of external
übernimmt keine haftung für externe
décline toute responsabilité
n'est pas responsable d
no se hace responsable
no responde de
all rights reserved
alle rechte vorbehalten
tous droits réservés
todos los derechos reservados""".split("\n")
COOKIE = ["cookie", "local storage", "small files", "témoins de connexion"]
TEASER = """latest|trending now|most read|related articles|you may also like|more from this section|editor's picks
neueste beiträge|meistgelesen|verwandte artikel|weitere artikel|das könnte sie interessieren|das könnte sie auch interessieren|mehr zum thema
les plus lus|sur le même thème|articles liés|articles similaires|à lire aussi|dernières nouvelles|dernières actualités|dernières infos|derniers articles|vous aimerez aussi
últimas noticias|lo más leído|también te puede interesar|artículos relacionados|más de esta sección""".replace("\n", "|").split("|")

# --- Fixed values: what stands in a page in place of its text. ---
PLACEHOLDER = (
    "\\{\\{\\{?\\s?[a-z_ ]{2,30}\\s?\\}\\}\\}?|\\{(?:\\d{1,2}|[a-z]+(?:_[a-z]+)*)\\}|[$#]\\{[a-z_]{2,30}\\}|%%[A-Z_]{2,30}%%|@@[a-z_]{2,30}@@|"
    "%\\([a-z_]{2,30}\\)s|«[a-z_ ]{2,30}»|\\bX{3,6}\\b|__[A-Z_]{2,30}__|<%=? ?[a-z_ ]{2,30}%>|<[a-z]+(?:[ _][a-z]+)?>|"
    "\\[(?:INSERT|TBD:?|Your|YOUR|TODO:?|PLACEHOLDER:?) [A-Za-z ]{2,30}\\]"
)
#: One of these stands in each placeholder: a quick test before the pattern.
PLACEHOLDER_PARTS = "{ [ < « _ %% @@ %( XXX".split()
FILLER = """lorem|ipsum|dolor|amet|consectetur|adipiscing|elit|sed|eiusmod|tempor|incididunt|labore|magna|aliqua
asdf|asdfgh|qwer|qwerty|zxcv|jkl|foo|bar|baz|test|blah""".replace("\n", "|")
#: Function words of the languages of the pages: a sentence of any of them has some, filler of made-up words has none.
FUNCTION = """the of and to in a an is was are were be been for on with at by from as that this it its not or but has have had which who will would than
der die das den dem des ein eine einer und in im ist war wird wurde zu zum zur von vom mit auf für bei nach aus an am nicht als auch sich wie um
le la les de des du un une et en dans est sont était pour par sur avec au aux que qui ne pas plus son sa ses à il elle ce cette d' l'
el los las una y es son fue por para con del al se su lo más entre o""".split()
FILLER_START = """your text here
sample text
insert copy for this section
body copy to follow
text to come
this paragraph only shows how a longer block of type
this is an example page.
hello, this is your first post
dummy copy
blindtext
texte factice
texto de relleno
lorem ipsum
hier steht ihr text
votre texte ici""".split("\n")
#: Strong evidence as a whole short line.
ERROR_LINE = (
    "(?:error|fehler|erreur) ?\\d{3}|\\d{3} (?:error|unavailable|not found|forbidden|bad gateway)|\\{\"(?:status|error|code)\".*\\}|"
    "(?:bad gateway|gateway time-?out|(?:service )?(?:temporarily )?unavailable|forbidden|access denied|not found|internal server error).{0,60}|"
    "too many requests|oops!? ?something went wrong.*|our team has been told\\. .*|down for maintenance.*|scheduled work|this (?:article|page|document) has moved or was removed.*|"
    "try the search box or return to the front page\\.?|log in again to continue.*|your session (?:has )?(?:expired|ended).*|"
    "(?:ray|reference|request id|trace|id)[: #]{1,2}[0-9a-f-]{6,}.{0,80}|at [a-z_.]+ ?\\([^)]*\\)|internal error at line .*|"
    "(?:traceback|fatal error|uncaught|unhandled|typeerror|nullpointer).{0,160}|"
    "seite nicht gefunden|die gewünschte adresse gibt es nicht mehr\\.?|page introuvable|l'adresse demandée n'existe plus\\.?|"
    "página no encontrada|la dirección solicitada ya no existe\\.?|</?noscript>.*|loading(?:…|\\.{3})?|spinner|turn it on and reload\\.?|"
    "javascript is (?:disabled|required|off)\\.?|please wait while the viewer starts\\. .*|checking (?:your browser|that you are human).*"
)
#: Weak evidence: a line counts if half of it are sentences with such words, and where hardly anything else is left of the page.
WEAK = (
    "\\b(?:java)?scripts?\\b|\\bjs\\b|scripting|skripte|guiones|脚本|\\bcaptcha\\b|\\bhuman\\b|your browser|security of your connection|"
    "permission to view|blocked in your region|not available right now|could not be found|(?:was|is) not found|taken down|no longer (?:exists|available)|"
    "does not exist|leads nowhere|nothing lives at this|asked for|will return (?:at|after|soon)|connection (?:was )?(?:refused|reset|timed)|refused by peer|"
    "was reset after|timed out|quota|rate limit|expired|unusual traffic|maintenance|out of service|try again|"
    "nicht erreichbar|später erneut|momentanément indisponible|réessayez|n'est pas disponible|no está disponible|inténtelo|ya no existe|"
    "无法显示|不存在|未找到|不可用|稍后再试|learn how|^retry$|^reload$"
)
#: Literal parts of the patterns of WEAK, one of which each match holds: a quick test before the pattern.
WEAK_PARTS = """script|js|skript|guiones|脚本|captcha|human|your browser|security of your connection|permission to view|blocked in your region|not available right now
be found|not found|taken down|no longer|not exist|leads nowhere|nothing lives|asked for|will return|connection|refused by peer|was reset after|timed out|quota|rate limit
expired|unusual traffic|maintenance|out of service|try again|nicht erreichbar|später erneut|indisponible|réessayez|n'est pas disponible|no está disponible|inténtelo
ya no existe|无法显示|不存在|未找到|不可用|稍后再试|learn how|retry|reload""".replace("\n", "|").split("|")
# --- End of fixed values. ---

#: As many words in a row without a function word, most in lower case, are filler.
FILLER_WORDS = 8
#: A word of cookies in so many characters of a line makes it a notice.
COOKIE_CHARS = 180
#: As many equal lines of text in one record are filler.
REPEATS = 3
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"(?<=[.!?;])\s+|(?<=[。！？])")
CAPITAL = re.compile(r" (?=[A-ZÀ-ÞĀ-Ž])")
BULLET = re.compile(r"^(?:[*•►»·▸–-]|\d{1,2}\.)\s+")
LINK = re.compile(r"\[([^\]]{1,30})\]\(/[^)\s]*\)")
LETTER = re.compile(r"[^\W\d_]")
DIGITS, SITE_WORD = re.compile(r"\d+"), re.compile(r"§(?: \w+)?")
SEPARATOR = re.compile(r" *[>/|·›»,] *|  +| (?=\[)")
QUOTES = "'\"”’»)"
MARKS = frozenset(".!?。！？:;,")
#: A line is template of its host from MIN_TEXTS pages with differing texts on, whatever the size of the host; on small hosts from
#: MIN_PAGES such pages on if these are MIN_SHARE of it. Lines of an article's edited copies recur too, beside fewer differing texts.
MIN_PAGES, MIN_SHARE, MIN_TEXTS, LIFT_HOSTS = 3, 0.04, 6, 2
#: Strong evidence counts for more where less is left of a page: it makes the page residue if, so many times over, it outweighs the
#: rest times the length of the whole.
STRONG_CHARS = 1800
#: An item of a line has so many words at most.
ITEM_WORDS = 4
#: Lines of so many characters are read once as long as they are kept, KEPT at most.
KEPT_CHARS, KEPT = 300, 50_000
LINES = (
    "document_id string, web boolean, host string, chash long, sig int, sig2 int, codes string, lens array<int>, keys array<long>, titles array<long>, "
    "counted array<long>, item_keys array<long>, item_lines array<int>, item_needs array<int>"
)


class _Words:
    """The fixed lists as sets and compiled patterns; made once in each Python worker."""

    def __init__(self) -> None:
        self.menu, self.exact, self.legal, self.teaser = frozenset(MENU), frozenset(MENU + CONSENT + NOTICE), frozenset(LEGAL), frozenset(TEASER)
        self.starts = tuple(STARTS)
        words = "|".join(MENU)
        self.menus = re.compile(f"(?:{words})(?: (?:{words}))+")
        self.placeholder = re.compile(PLACEHOLDER)
        self.filler = re.compile(f"(?:[a-z ]{{3,20}}: ?)?(?:lorem ipsum )?(?:\\b(?:{FILLER})\\b[\\s.,;]*){{3}}", re.I)
        self.error, self.weak = re.compile(ERROR_LINE), re.compile(WEAK)
        self.fillers, self.function = tuple(FILLER_START), frozenset(FUNCTION)
        self.kept: dict[tuple, tuple] = {}

    def furniture(self, bare: str, n: int, closed: bool) -> bool:
        flat = DIGITS.sub("#", bare) if bare[:1].isdigit() or not closed else bare
        if flat in self.exact or not closed and " ".join(flat.split()) in self.exact or bare.startswith(self.starts) or _holds(bare, CONTAINS):
            return True
        if _holds(bare, COOKIE) and "javascript" not in bare and sum(bare.count(w) for w in COOKIE) * COOKIE_CHARS >= n:
            return True
        if closed:
            return bare in self.legal
        if "|" in bare and all(x.strip() in self.legal for x in bare.split("|")) or bare in self.legal:
            return True
        parts = [x.strip() for x in SEPARATOR.split(bare)]
        if len(parts) > 1 and (all(x in self.menu or not x for x in parts) or (" > " in bare and (parts[0] in self.menu or parts[-1] in self.menu))):
            return True
        return self.menus.fullmatch(bare) is not None

    def evidence(self, t: str) -> bool:
        if _holds(t, PLACEHOLDER_PARTS) and len(self.placeholder.findall(t)) * 110 > len(t):
            return True
        return self.filler.match(t) is not None or t.lower().lstrip("# ").startswith(self.fillers) or self.made_up(t)

    def made_up(self, t: str) -> bool:
        """Running words of which none is a function word, in lower case but for the first of a sentence."""
        run = low = 0
        for m in WORD.finditer(t):
            w = m[0]
            if w.lower() in self.function or not w.isascii():
                return False
            run, low = run + 1, low + w.islower()
        return run >= FILLER_WORDS and low * 4 >= run * 3


def _holds(text: str, parts: list[str]) -> bool:
    for x in parts:  # noqa: SIM110  (a generator costs more than the search)
        if x in text:
            return True
    return False


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _closed(t: str) -> bool:
    """Whether a line ends in a closing mark, or is a heading, a fence or a row of a table."""
    return t.rstrip(QUOTES)[-1:] in MARKS or "\t" in t or t.startswith(("#", "```"))


def _hash(text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")))


def _key(low: str, site: str) -> int | None:
    """Hash of a line or item as an element of a template; null where it has no letters, as a fence or a rule."""
    if not LETTER.search(low):
        return None
    k = SITE_WORD.sub("§", low.replace(site, "§")) if site and site in low else low
    if "\t" not in low and len(low.split(None, ITEM_WORDS)) <= ITEM_WORDS:
        k = DIGITS.sub("#", k)
    return _hash(k)


def _items(words: _Words, t: str, bare: str, site: str) -> tuple[list[int], bool]:
    """Hashes of the items of a line, and whether separators part them (else capitals); none where they are no items."""
    parts = [x.strip() for x in SEPARATOR.split(bare)]
    apart = len(parts) > 1
    if not apart:
        parts = [x.lower() for x in CAPITAL.split(LINK.sub(r"\1", BULLET.sub("", t)))]
    parts = [x for x in parts if x]
    if len(parts) < 2 or any(len(x.split()) > ITEM_WORDS for x in parts):
        return [], apart
    keys = [_key(x, site) for x in parts]
    return ([], apart) if None in keys else (list(dict.fromkeys(keys)), apart)


def _line(words: _Words, raw: str, hosted: bool, web: bool, site: str) -> tuple:
    """Text, length, code before and after a look for evidence of error pages, key, title, items and whether separators part them."""
    t = raw.replace("\u00a0", " ").replace("\u3000", " ").strip()
    n, key, title, items, apart = len(t), None, None, (), False
    if not n:
        return t, n, "b", "b", key, title, items, apart
    code, low = "s", t.lower()
    bare, closed = BULLET.sub("", low), _closed(t)
    if "](/" in bare:
        bare = LINK.sub(r"\1", bare)
    if web and bare in words.teaser:
        code = "h"
    elif web and words.furniture(bare, n, closed):
        code = "f"
    elif not closed:
        code = "t"
    if low.startswith("#"):
        title = _hash(low.lstrip("# "))
    elif web and hosted:
        key = _key(low, site)
        if code != "h" and not closed:
            items, apart = _items(words, t, bare, site)
    if code in "ts" and words.evidence(t):
        code = "e"
    last = code
    if code in "ts":
        low = low.lstrip("# ")
        if words.error.fullmatch(low):
            last = "e"
        elif _holds(low, WEAK_PARTS) and words.weak.search(low) and sum(len(x) for x in SENTENCE.split(low) if words.weak.search(x)) * 2 >= len(low):
            last = "v" if code == "t" and BULLET.match(t) else "w"
    return t, n, code, last, key, title, items, apart


def _page(words: _Words, content: str, host: str | None, web: bool, site: str) -> tuple:
    """codes, lens, keys, titles, counted item keys, item keys looked up with their lines and the number of items there, signatures of the longest and second longest line."""
    codes: list[str] = []
    lens: list[int] = []
    keys: list[int | None] = []
    titles: list[int | None] = []
    counted: list[int] = []
    items: tuple[list[int], list[int], list[int]] = ([], [], [])
    longest, second, texts = "", "", {}
    if len(words.kept) > KEPT:
        words.kept.clear()
    for at, raw in enumerate(content.split("\n")):
        # what a line gives depends on these alone
        of = raw, site, web, host is None or not host
        line = words.kept.get(of)
        if line is None:
            line = _line(words, raw, not of[3], web, site)
            if len(raw) <= KEPT_CHARS:
                words.kept[of] = line
        t, n, code, last, key, title, found, apart = line
        if n > len(second) and t != longest:
            longest, second = (t, longest) if n > len(longest) else (longest, t)
        if found:
            if apart:
                counted += found
            for column, values in zip(items, (found, [at] * len(found), [len(found)] * len(found))):
                column.extend(values)
        if code == "s":
            texts.setdefault(t, []).append(at)
        codes.append(last)
        lens.append(n)
        keys.append(key)
        titles.append(title)
    for places in texts.values():
        if len(places) >= REPEATS:
            for i in places:
                codes[i] = "e"
    return "".join(codes), lens, keys, titles, list(dict.fromkeys(counted)), *items, _hash(longest) % 64, _hash(second) % 64


SITE = re.compile(r"^(?:(?:www|news|read|m|blog)\.)?([^.-]+?)(?:online|web)?(?:-[^.]*)?\.")


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _Words()
    schema = pa.schema([
        ("document_id", pa.string()), ("web", pa.bool_()), ("host", pa.string()), ("chash", pa.int64()), ("sig", pa.int32()), ("sig2", pa.int32()),
        ("codes", pa.string()), ("lens", pa.list_(pa.int32())), ("keys", pa.list_(pa.int64())), ("titles", pa.list_(pa.int64())),
        ("counted", pa.list_(pa.int64())), ("item_keys", pa.list_(pa.int64())), ("item_lines", pa.list_(pa.int32())), ("item_needs", pa.list_(pa.int32())),
    ])
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            rows: list[list] = [[] for _ in schema]
            for key, content, host, web, chash in zip(*(c.to_pylist() for c in batch.slice(start, 1000).columns)):
                m = SITE.match(host) if host else None
                site = m[1] if m and len(m[1]) >= 4 else ""
                *found, sig, sig2 = _page(words, content, host, web, site)
                for column, value in zip(rows, (key, web, host, chash, sig, sig2, *found)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)


def line_table(docs: DataFrame) -> DataFrame:
    """One row per record with non-null content: codes (one letter per line), lens, keys (hash of the line as template), titles,
    counted (hashes of items that separators part), item_keys, item_lines and item_needs (items looked up, their line, items of the line).

    Letters: b blank, f furniture by its words, h heading of teasers, e evidence of residue, w weak evidence, v weak evidence in an item of
    a list, t short line without a closing mark, s other text. Extra columns of ``docs`` are ignored. Python workers get Arrow batches of texts and return numbers.
    """
    base = docs.where("content IS NOT NULL AND document_id IS NOT NULL").select(
        "document_id", "content", host_of(F.col("url")).alias("host"),
        F.coalesce(F.col("url").rlike("^(?i)https?://"), F.lit(False)).alias("web"), F.xxhash64("content").alias("chash"),
    )
    return base.mapInArrow(_pages, LINES)


def template_keys(pages: DataFrame) -> DataFrame:
    """Line hashes that are template: key, only_host (null where it is template of several hosts, and so of any).

    Texts are told apart by their longest line, and by the second longest, as the longest may be template itself; the
    latter counts where most pages with the line differ in it. A hash also
    found marked as a heading ("## ...") is a heading of articles, not template.
    """
    web = pages.where("web AND host IS NOT NULL")
    totals = web.groupBy("host").agg(F.count("*").alias("pages"))
    per_host = (
        web.select("host", "sig", "sig2", F.explode(F.array_distinct(F.concat("keys", "counted"))).alias("key")).where("key IS NOT NULL").groupBy("host", "key")
        .agg(F.count("*").alias("n"), F.expr("bit_count(bit_or(shiftleft(1L, sig)))").alias("texts"), F.expr("bit_count(bit_or(shiftleft(1L, sig2)))").alias("others"))
        .where((F.col("n") >= MIN_PAGES) & (F.greatest("texts", "others") >= MIN_PAGES))
    )
    headings = pages.select(F.explode("titles").alias("key")).where("key IS NOT NULL").distinct()
    small = (F.col("texts") >= MIN_PAGES) & (F.col("n") >= MIN_SHARE * F.col("pages"))
    enough = small | (F.col("texts") >= MIN_TEXTS) | ((F.col("others") >= MIN_TEXTS) & (F.col("others") * 2 >= F.least("n", F.lit(64))))
    kept = per_host.join(totals, "host").where(enough).join(headings, "key", "left_anti")
    return kept.groupBy("key").agg(F.count("*").alias("hosts"), F.min("host").alias("h")).select("key", F.when(F.col("hosts") < LIFT_HOSTS, F.col("h")).alias("only_host"))


def _total(letters: str) -> Column:
    """Characters of the lines with these letters."""
    return F.aggregate(F.zip_with("lens", F.split("codes", ""), lambda n, c: F.when(F.lit(letters).contains(c) & (c != ""), n).otherwise(0)), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _marked(hits: str) -> Column:
    """codes with F at these positions."""
    return F.expr(f"CASE WHEN {hits} IS NULL THEN codes ELSE array_join(transform(split(codes, ''), (c, i) -> CASE WHEN array_contains({hits}, i) THEN 'F' ELSE c END), '') END")


def page_codes(docs: DataFrame) -> DataFrame:
    """One row per document_id with non-null content: codes (one letter per line), lens (characters per line), web, chash.

    Letters: F furniture, b blank, e, v and w evidence of residue, t and s main body. Where rows of one document_id differ in
    content, the content with the smallest hash stands for it; equal repeats count once.

    Template lines that look like evidence (a notice on scripts in every page) are furniture if at least half of the pages with
    the line have a body besides it; otherwise they are what recurring error pages hold, and stay evidence.
    """
    pages = cut(line_table(docs), "lines")
    one = pages.groupBy("document_id").agg(F.min_by(F.struct("web", "chash", "codes", "lens"), "chash").alias("p")).select("document_id", "p.*")
    at = F.expr("filter(transform(keys, (k, i) -> named_struct('key', k, 'pos', i, 'need', 1, 'c', substring(codes, i + 1, 1))), x -> x.key IS NOT NULL AND x.c IN ('t', 's', 'e', 'v', 'w'))")
    inside = F.expr("filter(transform(item_keys, (k, i) -> named_struct('key', k, 'pos', item_lines[i], 'need', item_needs[i], 'c', substring(codes, item_lines[i] + 1, 1))), x -> x.c IN ('t', 's'))")
    asked = pages.where("web").select("document_id", "chash", "host", F.explode(F.concat(at, inside)).alias("x")).select("document_id", "chash", "host", "x.*")
    found = asked.join(template_keys(pages), "key").where("only_host IS NULL OR only_host = host").repartition("document_id")
    line = found.groupBy("document_id", "chash", "pos").agg(F.first("c").alias("c"), F.max(F.when(F.col("need") == 1, F.col("key"))).alias("key"), F.count_if(F.col("need") > 1).alias("items"), F.max("need").alias("need"))
    plain = F.col("c").isin("t", "s") & (F.col("key").isNotNull() | (F.col("items") == F.col("need")))
    hits = line.groupBy("document_id", "chash").agg(
        F.collect_set(F.when(plain, F.col("pos"))).alias("hits"), F.collect_set(F.when(~F.col("c").isin("t", "s"), F.struct("key", "pos"))).alias("doubtful")
    )
    # what hangs below a heading of teasers goes with it
    coded = F.regexp_replace(F.replace(_marked("hits"), F.lit("f"), F.lit("F")), "h|\\G(?<!^)[tv]", "F")
    first = cut(one.join(hits, ["document_id", "chash"], "left").select("document_id", "web", "chash", coded.alias("codes"), "lens", "doubtful"), "first", done=(pages,))
    beside = _total("ts") > _total("evw")
    lines = first.where("size(doubtful) > 0").select("document_id", beside.alias("beside"), F.explode("doubtful").alias("x")).select("document_id", "beside", "x.*")
    notices = lines.groupBy("key").agg(F.count("*").alias("n"), F.count_if("beside").alias("real")).where("real * 2 >= n").select("key")
    more = lines.join(notices, "key").groupBy("document_id").agg(F.collect_set("pos").alias("more"))
    return cut(first.join(more, "document_id", "left").select("document_id", "web", "chash", _marked("more").alias("codes"), "lens"), "pages", done=(first,))


def with_residue(pages: DataFrame) -> DataFrame:
    """Adds ``residue``: evidence makes up at least half of what is left when furniture is subtracted."""
    strong, weak, rest = _total("e"), _total("vw"), _total("ts")
    found = (strong + weak >= rest) | (strong * STRONG_CHARS >= rest * (strong + weak + rest))
    return (
        pages.where("codes RLIKE '[evw]'").select("*", F.when(strong > 0, found).otherwise(weak >= rest).alias("residue"))
        .unionByName(pages.where("NOT codes RLIKE '[evw]'").select("*", F.lit(False).alias("residue")))
    )


def classified(docs: DataFrame) -> DataFrame:
    """page_codes with residue: the common ground of p1, p3, p5 and p6."""
    return with_residue(page_codes(docs))


def furniture_lines(docs: DataFrame) -> DataFrame:
    """(document_id, line_no) of furniture lines, first line 1. No rows for null or blank content and for residue."""
    pages = classified(docs).where("web AND NOT residue AND codes LIKE '%F%'")
    return pages.select("document_id", F.posexplode(F.split("codes", "")).alias("i", "c")).where("c = 'F'").select("document_id", (F.col("i") + 1).cast("int").alias("line_no"))


def residue_records(docs: DataFrame) -> DataFrame:
    """document_id of records whose content is residue. Null and blank contents are none."""
    return classified(docs).where("residue").select("document_id")


def bodies(docs: DataFrame) -> DataFrame:
    """document_id, body (main body, lines joined by a line feed), last_code (letter of the last non-blank body line), residue.

    One row per document_id with non-null content.
    """
    pages = classified(docs)
    texts = docs.select("document_id", "content").where("content IS NOT NULL AND document_id IS NOT NULL")
    joined = pages.join(texts, "document_id").where(F.xxhash64("content") == F.col("chash")).dropDuplicates(["document_id"])
    kept = F.filter(F.transform(F.split("content", "\n"), lambda x, i: F.named_struct(F.lit("x"), x, F.lit("c"), F.substring("codes", i + 1, F.lit(1)))), lambda s: s["c"] != "F")
    return joined.select("document_id", "residue", F.array_join(F.transform(kept, lambda s: s["x"]), "\n").alias("body"))

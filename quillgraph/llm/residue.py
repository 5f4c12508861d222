"""Template residue and error-page text.

A text is cut into passages (paragraphs) and sentences, without what it quotes or shows as code. What is
residue is partly known by form and partly learned from the corpus:

* placeholders left unfilled are known by their syntax alone;
* other forms (an error page's status line, a <noscript> element, filler) and phrases mark a passage;
* the responses themselves are learned: sentences are masked (numbers, ids, paths, names) and counted over
  hosts (repositories); one that stands in the bodies of forms (behind a status line, in <noscript>, alone
  between a page's title and its menu) on HOSTS hosts or more, and that is seen within prose less often than
  there or alone, is a response, wherever else it occurs.

Evidence is then added for every mark: the same masked sentence from several hosts, being a learned response,
little information (few words, for filler few different ones), and a body that shares no term with its address slug (repository)
and title. Only a placeholder's syntax is enough by itself.

Defined results: null and blank texts are no case; documents without id are left out, re-delivered ones
count once; null hosts are one host; sentences of more than LONGEST characters are no responses; extra columns
are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import staged
from quillgraph.sources.tables import table

#: The least sum of evidence: 2 for a placeholder's syntax, 1 for another mark or a learned response; to these 1 for a
#: sentence from HOSTS or more hosts (learned ones are), 0.5 each for few words (filler: few different ones) and for a mismatch of slug,
#: title and body; 0.5 less for a mere row of words.
LEAST_EVIDENCE, HOSTS, FEW_WORDS, LONGEST = 2.0, 2, 40, 1000
#: Of a learned response's occurrences at least this part is in forms or alone; and its mask leaves so many words.
LEAST_ALONE, LEAST_TOLD = 0.5, 2

_FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)")
_TAG_CODE = re.compile(r"(?is)<(pre|code)\b.*?</\1>")
_INLINE = re.compile(r"(`+)(?!`).+?\1", re.S)
_QUOTED = re.compile(r"\"[^\"\n]{1,300}\"|“[^”\n]{1,300}”|„[^“”\n]{1,300}[“”]|«[^»\n]{1,300}»|(?<!\w)'[^'\n]{2,300}'(?!\w)")
_QUOTE_LINE = re.compile(r"(?m)^[ \t]*>(?!>).*$")

_PLACEHOLDER = re.compile(
    r"\{\{\s*[A-Za-z_][\w.\-]*\s*\}\}|\$\{\s*[A-Za-z_][\w.]*\s*\}|<%=?\s*[\w.]+\s*%>|\{%-?\s*[\w. ]+\s*-?%\}|\[\[\s*[\w.\- ]+\s*\]\]|#\{\s*[\w.]+\s*\}|@@\w+@@|<<[A-Za-z][\w\-]*>>|%\([A-Za-z_]\w*\)[sd]"
    r"|(?<![\w%])%[A-Z][A-Z0-9_]*%(?!\w)|(?<!\w)__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?!\w)|(?<![\w${#])\{[a-z][a-z_]*\}"
    r"|\[(?i:insert|your|enter|add|replace|put|name of|hier|ihr|votre|insérer|su|inserte)\b[^\]\n(]{0,60}\](?!\()|<[A-Za-z][\w ]{0,50} here>"
)
_STATUS = r"(?:Bad Request|Unauthorized|Payment Required|Forbidden|Not Found|Method Not Allowed|Not Acceptable|Request Timeout|Conflict|Gone|Too Many Requests|Internal Server Error|Not Implemented|Bad Gateway|Service Unavailable|Gateway Time-?out)"
_ERROR = re.compile(
    rf"(?im)^\W*(?:<h1>)?\s*(?:HTTP(?:/\d(?:\.\d)?)?|Error|Fehler|Erreur|Status)\s*:?\s*[45]\d\d\b(?:\s*$|\s*[:\-–]|\s+{_STATUS}|\s*<)|^\W*(?:<h1>|<title>)?\s*[45]\d\d\s*[:\-–]?\s*{_STATUS}\W*(?:$|<)|<(?:h1|title)>\s*(?:[45]\d\d|error)\b"
    rf"|^\W*{_STATUS}\W*$|^\s*\{{\s*\"(?:status|code|statusCode)\"\s*:\s*\"?[45]\d\d\b|^\s*\{{\s*\"(?:error|message)\"\s*:.*\"(?:status|code)\"\s*:\s*\"?[45]\d\d"
    r"|^\W*upstream connect error|^\W*(?:Whoops|Oops)\W.*\berror\b|^\W*Cannot (?:GET|POST|PUT|DELETE|PATCH) /|^\W*no healthy upstream|^\W*Traceback \(most recent call last\)"
)
_ERROR_PHRASE = re.compile(
    r"(?i)page you (?:asked|are looking|were looking|requested).{0,30}(?:not|n't|doesn't|no longer)|(?:can't|cannot|couldn't|can not) (?:seem to )?find (?:that|the|this) page|requested (?:page|url|resource).{0,30}(?:not|n't) (?:be )?found"
    r"|something went wrong|(?:server|site|page) took too long|session has expired|(?:do not|don't) have (?:permission|access) to (?:view|access|see)|access (?:is |was )?denied|temporarily unavailable|an (?:unexpected )?error (?:has )?occurred|try again (?:later|in a few)"
    r"|seite (?:wurde )?nicht gefunden|es ist ein fehler aufgetreten|zugriff verweigert|später (?:erneut|noch einmal|nochmals?)|sitzung ist abgelaufen|keine berechtigung"
    r"|página (?:solicitada )?no|no se ha encontrado la página|se ha producido un error|acceso denegado|inténtelo|sesión ha (?:caducado|expirado)"
    r"|page (?:demandée )?est introuvable|page introuvable|une erreur est survenue|accès refusé|réessayer plus tard|session a expiré"
)
_SCRIPTS = re.compile(
    r"(?i)(?:enable|activate|turn on|allow|switch on)\s+(?:your\s+)?(?:java)?scripts?\b|(?:java)?scripts?\s+(?:is|are|must be|needs? to be|seems to be)\s+(?:currently\s+)?(?:disabled|enabled|turned o\w+|switched o\w+|off|blocked|required)|(?:requires?|needs?)\s+javascript|without javascript\b"
    r"|(?:java)?s[ck]ripte?\s+(?:aktivieren|einschalten|erlauben|ist deaktiviert|deaktiviert)|aktivieren sie (?:bitte )?javascript|ohne javascript\b"
    r"|activez? (?:le )?javascript|activer (?:le )?javascript|javascript est désactivé|sans javascript\b|active javascript|activar javascript|habilit\w+ javascript|javascript (?:está|esta) (?:desactivado|deshabilitado)|sin javascript\b"
)
_FILLER = re.compile(
    r"(?i)\blorem\s+ipsum\b|\b(?:bla+h?)(?:[ ,]+bla+h?){1,}|\b(?:text|content|description|title|name|summary|introduction|image|details|body)\s+(?:goes|comes|belongs)\s+here\b|^\W*your (?:text|content|title|description|name)(?: goes)? here\b"
    r"|^\W*some text (?:for|about|here|goes)\b|^\W*sample (?:text|page|content|post|paragraph)\b|\bthis is (?:a|an|just) (?:sample|placeholder|dummy|example) (?:page|text|post|paragraph|entry)\b|^\W*placeholder (?:paragraph|text|content|page)\b|^\W*dummy (?:entry|text|content|page|post|paragraph)\b"
    r"|\breplace this (?:text|page|paragraph|sentence)\b|^\W*edit this (?:paragraph|page|text|section)\b|^\W*(?:write|add|put|enter|describe|insert)\b[^.\n]{0,60}\bhere\b\W*$|^\W*(?:write|add|put|enter|insert) (?:a|an|your|some|the)\b[^.\n]{0,60}\bhere\."
    r"|hier steht (?:noch )?(?:ein|der|ihr) (?:beispiel|platzhalter|blind)?text|\bplatzhalter(?:text)?\W*$|beispieltext\W|texte d'exemple|le contenu sera placé ici|votre texte ici|texto de (?:ejemplo|relleno|muestra)|aquí va (?:el|más|su|tu|un)\b|su texto aquí"
)
# One of these occurs, in lower case, in whatever the pattern finds; looking for them is cheap.
_PHRASE_HINTS = ("page", "requested ", "something went wrong", "took too long", "session", "permission", "access", "denied", "temporarily unavailable", "error", "try again", "seite", "fehler", "verweigert", "später", "sitzung", "berechtigung", "página", "se ha producido", "denegado", "inténtelo", "sesión", "erreur", "accès", "réessayer")
# an error page without a code has one of these
_ERROR_HINTS = ("bad request", "unauthorized", "required", "forbidden", "not found", "not a", "timeout", "time-out", "conflict", "gone", "too many", "server error", "not implemented", "bad gateway", "unavailable", "<h1>", "<title>", "upstream connect", "whoops", "oops", "cannot ", "no healthy", "traceback")
_CODE = re.compile(r"[45]\d\d\b")
_SCRIPT_HINTS = ("script", "skript")
_FILLER_HINTS = ("lorem", "bla", " here", "some text", "sample", "placeholder", "dummy", "example", "replace this", "edit this", "hier steht", "platzhalter", "beispieltext", "exemple", "placé ici", "texte ici", "texto", "aquí va")
_PLACEHOLDER_HINTS = re.compile(r"[{\[<%@]|__")
_NOSCRIPT = re.compile(r"(?is)<noscript>(.*?)(?:</noscript>|\Z)")
_HEAD = re.compile(rf"(?i)^\W*(?:<(?:h1|title)>\s*)?(?:(?:HTTP(?:/\d(?:\.\d)?)?|Error|Fehler|Erreur|Status)\s*:?\s*[45]\d\d\b|[45]\d\d\s*[:\-–]?\s*{_STATUS}|{_STATUS}\s*$)(?:\s*[:\-–]?\s*{_STATUS})?\s*[:.\-–]?", re.M)
_MENU = re.compile(r"\W*[^\W\d]\w*(?: \w+)?(?:\s*[|·•]\s*\w+(?: \w+)?)+\W*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_TOLD = re.compile(r"[^\W\d_]+|#")
_VARIES = re.compile(r"/[\w/\-.]*|\b[0-9a-f]{8,}\b|\d+|</?\w+>")
_WORD = re.compile(r"[^\W\d_]+")
# The commonest function words of the four languages.
STOP_WORDS = frozenset(
    "a an and any are as at be been but by can do does for from had has have he her his how if in into is it its no not now of on one only or our out she so still than that the their them then there these they this to too up us was we were what when which while who will with you your "
    "aber alle als am an auch auf aus bei bin bis das dass dem den der des die diese durch ein eine einem einen einer es für hat haben ich ihr im in ist ja jede jeder kann kein mit nach nicht noch nur oder sich sie sind so über um und vom von vor war was wenn wer wie wird zu zum zur zwei "
    "al como con de del desde el ella en entre era es esta este está ha hay la las le lo los más me mi muy no nos o para pero por porque que se si sin sobre son su sus también tu un una uno y ya "
    "au aux avec car ce ces cette dans de des donc du elle en est et il ils je la le les leur lui mais mes mon ne ni nous on ou où par pas plus pour qu que qui sa se ses si son sont sur ta te tu un une vos votre vous y à été".split()
)


def unquoted(text: str) -> str:
    """The text without code and quotations."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    for pattern in (_FENCE, _TAG_CODE, _INLINE, _QUOTE_LINE):
        text = pattern.sub(" ", text)
    return text


# What is typed to fill a field.
_MASHED = frozenset("asdf asdfasdf asdfgh qwer qwerty qwertz azerty zxcv zxcvbn hjkl jkl jklö foo bar baz qux test xxx xxxx yyy zzz abc".split())


def _mashed(words: list[str]) -> bool:
    return len(words) >= 3 and sum(w in _MASHED for w in words) >= 0.8 * len(words)


def _meaningless(words: list[str]) -> bool:
    """Many words, and none that any language needs between others."""
    return len(words) >= 8 and not any(w in STOP_WORDS for w in words)


def _found(pattern: re.Pattern, hints: tuple[str, ...], text: str, low: str) -> re.Match | None:
    return pattern.search(text) if any(h in low for h in hints) else None


def _repeats(passage: str) -> bool:
    sentences = [s.strip().lower() for s in re.split(r"(?<=[.!?])\s+", passage) if s.strip()]
    return len(sentences) >= 3 and len(set(sentences)) == 1


def _numbered(lines: list[str]) -> bool:
    """Lines that differ only in numbers, which count up from 1."""
    if len(lines) < 4 or not lines[0].rstrip(".: ").endswith("1"):
        return False
    numbers = [re.findall(r"\d+", x) for x in lines]
    if any(len(n) != 1 for n in numbers):
        return False
    told = [re.sub(r"\d+", "#", x).strip() for x in lines]
    each = len(set(told))
    return len(lines) >= 2 * each and [int(n[0]) for n in numbers] == [k // each + 1 for k in range(len(lines))]


def shape(sentence: str) -> str:
    """The sentence without what differs from one to the next: numbers, ids, paths, and names (its first word, which may
    be one, and words with a capital)."""
    words = ["#" if not i or w[0].isupper() else w for i, w in enumerate(_TOLD.findall(_VARIES.sub("#", sentence)))]
    return " ".join(w for i, w in enumerate(words) if w != "#" or not i or words[i - 1] != "#")


def marks(text: str | None) -> list[tuple[str, str, str, str, bool]]:
    """(kind, form, sentence, passage, alone). form: syntax, mark, body (a sentence in a form's body; kind is the form's)
    or plain (any other sentence, without kind). alone: it is all that the passage says."""
    out: list[tuple[str, str, str, str, bool]] = []
    if not text or not text.strip():
        return out
    passages = [p.strip("\n") for p in re.split(r"\n\s*\n", unquoted(text)) if p.strip()]
    # a page of which nothing but a title, a response and a menu is left
    framed = 2 <= len(passages) <= 3 and len(passages[-1]) < 200 and _MENU.fullmatch(passages[-1]) is not None and (len(passages) == 2 or len(_WORD.findall(passages[0])) <= 3)
    for number, passage in enumerate(passages):
        bare = _QUOTED.sub(" ", passage) if any(c in passage for c in "\"'“„«") else passage
        low = bare.lower()
        if _PLACEHOLDER_HINTS.search(bare) and _PLACEHOLDER.search(bare):
            out.append(("placeholder", "syntax", bare[:LONGEST], bare, False))
        rest, bodies = bare, []
        if "<noscript" in low:
            bodies = [("scripts", m.group(1)) for m in _NOSCRIPT.finditer(bare)]
            rest = _NOSCRIPT.sub("\n", bare)
            out.append(("scripts", "mark", bodies[0][1] if bodies else bare[:LONGEST], bare, True))
        if (_CODE.search(passage) or any(h in low for h in _ERROR_HINTS)) and (m := _ERROR.search(passage)) and (m.start() == 0 or passage[: m.start()].count("\n") <= 1):
            # a log or a stack trace within prose starts later than the passage
            out.append(("error page", "mark", passage[:LONGEST], passage, True))
            if h := _HEAD.match(rest):
                bodies.append(("error page", rest[h.end() :]))
                rest = ""
        if framed and number == len(passages) - 2:
            bodies.append(("page", rest))
            rest = ""
        for kind, body in bodies:
            out += [(kind, "body", x, bare, True) for x in _SENTENCE.split(body) if x.strip()]
        sentences = [x for x in _SENTENCE.split(rest) if x.strip()]
        out += [("", "plain", x, bare, len(sentences) <= 2) for x in sentences]
        if m := _found(_SCRIPTS, _SCRIPT_HINTS, bare, low):
            out.append(("scripts", "mark", _around(bare, m.start()), bare, False))
        elif m := _found(_ERROR_PHRASE, _PHRASE_HINTS, bare, low):
            out.append(("error page", "mark", _around(bare, m.start()), bare, False))
        lines = [x for x in bare.split("\n") if x.strip()]
        if any(h in low for h in _FILLER_HINTS) and (line := next((x for x in lines if _FILLER.search(x)), None)):
            out.append(("filler", "mark", line, bare, False))
            continue
        # equal sentences have a third as many different parts at most
        prose = [_WORD.findall(x.lower()) for x in lines if _prose(x)]
        if len(sentences) >= 3 and 3 * len(set(sentences)) <= len(sentences) and _repeats(bare) or _numbered(lines) or any(_mashed(w) for w in prose):
            out.append(("filler", "mark", bare[:LONGEST], bare, False))
        elif any(_meaningless(w) for w in prose):
            # sentences tell more than a mere row of words
            out.append(("filler" if re.search(r"[.!?]\s*$", bare) else "row", "mark", bare[:LONGEST], bare, False))
    return out


def _around(passage: str, at: int) -> str:
    """The sentence that holds a place of a passage."""
    begin = max((m.end() for m in _SENTENCE.finditer(passage) if m.end() <= at), default=0)
    end = next((m.start() for m in _SENTENCE.finditer(passage, at)), len(passage))
    return passage[begin:end]


def _prose(line: str) -> bool:
    """Words and little else: no list of values, table, path, heading or code."""
    return not re.match(r"\s*(?:[#>|*+\-]|\d+[.)])", line) and not re.search(r"[=;{}()\[\]<>|/\\_@$]|\w:\w|\d", line)


def _terms(text: str) -> set[str]:
    return {w for w in (x.lower() for x in _WORD.findall(text)) if len(w) > 3 and w not in STOP_WORDS and w not in _MASHED}


def marked(documents: DataFrame) -> DataFrame:
    """doc_id, host, kind, form, shape, alone, few (little information), apart (slug and title don't meet the body): one
    row per mark and per sentence. few and apart are not looked for in plain sentences."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, host, repo, text in zip(b["doc_id"], b["host"], b["repo"], b["text"], strict=True):
                about: tuple[str, set[str], set[str]] | None = None
                for kind, form, sentence, passage, alone in marks(text):
                    few = apart = False
                    if form in ("plain", "body"):
                        if len(sentence) > LONGEST:
                            continue
                        masked = shape(sentence)
                        if len(masked.replace("#", "").split()) < LEAST_TOLD:
                            continue
                    else:
                        masked = shape(sentence)
                    if form != "plain":
                        if about is None:
                            title = text.strip().split("\n", 1)[0].strip()
                            slug = _terms((repo or "").replace("-", " "))
                            about = title, slug, slug | _terms(title)
                        told = _WORD.findall(passage)
                        # filler may be long, and yet has few different words
                        few = len(set(told) if kind in ("filler", "row") else told) <= FEW_WORDS
                        apart = not (about[1] if about[0] in passage else about[2]) & _terms(passage)
                    out.append((doc, host, kind, form, xxhash.xxh64_intdigest(masked) - (1 << 63), alone, few, apart))
            yield pd.DataFrame(out, columns=["doc_id", "host", "kind", "form", "shape", "alone", "few", "apart"])

    host = F.xxhash64("workspace_id", "repo").alias("host")
    rows = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", host, "repo", "text")
    return rows.mapInPandas(each, "doc_id bigint, host bigint, kind string, form string, shape bigint, alone boolean, few boolean, apart boolean")


def responses(found: DataFrame) -> DataFrame:
    """shape, hosts, learned, kind of the masked sentences that are marked somewhere or stand in a form's body. found: marked."""
    body = F.col("form") == "body"
    # one row per sentence and host first, so that a response sent everywhere is counted piecewise
    each = found.groupBy("shape", "host").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(body, 1)).alias("bodies"), F.count(F.when(F.col("alone"), 1)).alias("alone"), F.count(F.when(F.col("form") == "mark", 1)).alias("marks"), F.min(F.when(body, F.col("kind"))).alias("kind"))
    total = each.groupBy("shape").agg(F.count(F.lit(1)).alias("hosts"), F.count(F.when(F.col("bodies") > 0, 1)).alias("in_hosts"), F.sum("n").alias("n"), F.sum("alone").alias("alone"), F.sum("marks").alias("marks"), F.min("kind").alias("kind"))
    learned = (F.col("in_hosts") >= HOSTS) & (F.col("alone") >= LEAST_ALONE * F.col("n"))
    return total.select("shape", "hosts", "marks", learned.alias("learned"), F.col("kind").alias("of")).where("learned OR marks > 0")


def residue(documents: DataFrame, least: float = LEAST_EVIDENCE) -> DataFrame:
    """doc_id, kinds, evidence of the documents with residue."""
    found = staged(marked(documents), "residue-marks")
    known = responses(found.where("form <> 'syntax'"))
    seen = found.where("form <> 'syntax'").join(known, "shape").where("form = 'mark' OR learned")
    point = lambda c, n: F.when(c, n).otherwise(0.0)
    shared = point(F.col("few"), 0.5) + point(F.col("apart"), 0.5)
    evidence = 1.0 + point((F.col("hosts") >= HOSTS) | F.col("learned"), 1.0) + shared - point(F.col("kind") == "row", 0.5)
    kind = F.when(F.col("kind") == "row", "filler").when(F.col("kind").isin("", "page"), F.col("of")).otherwise(F.col("kind"))
    both = seen.select("doc_id", kind.alias("kind"), evidence.alias("evidence")).unionByName(found.where("form = 'syntax'").select("doc_id", "kind", (2.0 + shared).alias("evidence")))
    enough = both.where(F.col("evidence") >= least)
    return enough.groupBy("doc_id").agg(F.sort_array(F.collect_set("kind")).alias("kinds"), F.max("evidence").alias("evidence"))


def p10_found(spark, folder):
    return residue(table(spark, folder, "documents")).select("doc_id")


def p10_kinds(spark, folder):
    found = residue(table(spark, folder, "documents")).select("doc_id", F.explode("kinds").alias("kind"))
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("documents"))


SQL = {}
QUERIES = {"p10_found": p10_found, "p10_kinds": p10_kinds}

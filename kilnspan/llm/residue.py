"""Template residue, filler, error pages and script notices.

A text is a case when either

* **open slots** (:func:`open_slots`): a placeholder that was meant to be filled before
  publication is still there.  Each delimiter has its own grammar; a name between the
  delimiters may be any words of any script.  Whether a hit is *open* is decided by its
  context: code blocks, code and configuration lines, quoted strings and sentences that
  talk about placeholders discount it, and so does its **density**: a stray slot in a text
  that otherwise explains such slots (:func:`tutorial`) is an example; or
* **no body** (:func:`no_body`): once mark-up, menus, headings and footers are set aside,
  every sentence is filler, an error message or a notice that scripts are needed.  A
  sentence is told by how **dense** the wording of such texts stands in it
  (:mod:`.wording`), not by the sentence as a whole.  One sentence of other content makes
  the text a non-case (such texts quote, discuss or log these things).

Null, empty and blank texts are never cases.  The whole text is read, whatever its length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wording as W

#: Share of a sentence's words that must be of the wording of such texts.
DENSE = 0.7
#: ... of one that goes along with them (advice, politeness), without saying what is wrong.
DENSE_ALONG = 0.75
#: Slots a sentence of prose must hold on average, when others of the text are only examples.
SLOT_DENSITY = 0.1

# ---------------------------------------------------------------- normalising

_INVISIBLE = re.compile("[" + "".join(map(chr, (*range(9), *range(14, 32), 127, 0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF))) + "]")
_ENTITY = re.compile(r"&(?:lt|gt|amp|quot|apos|nbsp|laquo|raquo|lbrace|rbrace|#\d{2,5}|#x[0-9a-f]{2,4});", re.I)
_SPACES = re.compile("[^\\S\n]+")
_SPECIAL_TOKEN = re.compile(r"<\|\w+\|>")
_PLAIN = (("\u2018", "'"), ("\u2019", "'"), ("\u02bc", "'"), ("\u2010", "-"), ("\u2011", "-"), ("\u2028", "\n"), ("\u2029", "\n"), ("\r\n", "\n"), ("\r", "\n"))


def normalise(text: str) -> str:
    """White space of any kind as one space or a line feed, one kind of apostrophe and hyphen, entities resolved; invisible characters gone."""
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m.group()), text)
    for odd, plain in _PLAIN:
        text = text.replace(odd, plain)
    text = _INVISIBLE.sub("", text)
    return _SPACES.sub(" ", _SPECIAL_TOKEN.sub(" ", text))


# ---------------------------------------------------------------- open slots

_LETTER = r"[^\W\d_]"
#: A field's name: up to six words of any script with digits, dots and hyphens in them, two letters at least.
_NAME = rf"{_LETTER}(?:[\w.'-]*[\w])(?:[ _-]+\w[\w.'-]*){{0,5}}"
#: ... or one letter of a script that writes words in one.
_ANY = rf"(?:{_NAME}|[\u3040-\u30ff\u3400-\u9fff]+)"
_UPPER = r"[A-Z][A-Z0-9]+(?:[_ -][A-Z0-9]+){0,5}"
_FILTER = rf"(?: ?\| ?{_NAME}(?:\([^()\n]*\))?)*"
_VERB = (
    r"(?:insert|enter|add|type|fill in|specify|your|todo|tbd|tbc|hier|einfügen|eingeben|ihr|ihre|insérer|inserer|indiquer|saisir|renseigner|à compléter|votre|insertar|inserte|introducir|completar|indicar|su|aquí)"
)
_TO_DO = (
    r"(?:goes here|here|to be (?:filled|added|completed|determined|confirmed|defined|announced)(?: in)?|to follow|to come|tbd|tbc|tba|todo|hier (?:eintragen|einfügen|ergänzen|einsetzen)|eintragen|ergänzen|einsetzen|einfügen|folgt|"
    r"à (?:compléter|remplir|définir|préciser|renseigner|insérer|venir|indiquer)|(?:por|a) (?:completar|rellenar|definir|insertar|indicar|confirmar)|pendiente|aquí|ici)"
)
_CJK_TO_DO = r"(?:请?填写|请?填入|待?补充|待定|待填|请输入|在此|此处|記入|入力|未定|要確認|ここに|未記入)"

#: One grammar per delimiter; each begins at a character of _HINTS.  The group's name is the delimiter's.
SLOT_GRAMMARS = {
    "double_braces": rf"\{{\{{\{{? ?{_ANY}{_FILTER} ?\}}\}}\}}?(?!\}})",
    "statement_tags": rf"\{{% ?(?!(?:if|else|elif|endif|for|endfor|set|include|block|endblock|raw|endraw|extends|macro|call|with)\b)(?i:{_ANY}) ?%\}}",
    "expression_tags": rf"<%=? ?{_ANY} ?%>",
    "double_brackets": rf"\[\[ ?{_ANY} ?\]\]",
    "double_angles": rf"<<(?! ) ?{_ANY} ?>>(?!>)",
    "double_at": rf"@@ ?{_ANY} ?@@",
    "double_underscores": rf"(?<![\w_])__{_UPPER}__(?![\w_])",
    "hashes": rf"(?<![\w#])(?:##{_UPPER}##|#{_UPPER}#)(?!\w)",
    "print_style": rf"%\({_ANY}\)[sdf]",
    "percents": rf"(?<![\w%])%(?:{_UPPER}|[a-z]+(?:[_ ][a-z]+)*)%(?!\w)",
    "dollar_braces": rf"\$\{{ ?{_ANY} ?\}}",
    "hash_braces": rf"#\{{ ?{_ANY} ?\}}",
    "dollars": r"(?<![\w$])\$(?=[^$\n]{3})[^\W\d_][\w]*(?:[ -][^\W\d_]\w*){0,3}\$(?![\w$])",
    "braces": rf"(?<![\w{{$%#\\}}^_])\{{{_ANY}\}}(?![\w}}])",
    "instructions": rf"\[(?:(?i:{_VERB})\b[^\[\]\n]{{0,60}}|(?!\d)[^\[\]\n]{{1,50}}\b(?i:{_TO_DO}))\](?!\()",
    "instructions_in_angles": rf"<(?i:{_VERB})[ _-][^<>\n/=]{{0,60}}>",
    "instructions_in_parentheses": rf"\((?i:insert|enter|fill in|specify|einfügen|eintragen|insérer|indiquer|insertar|completar) (?!\d)[^()\n]{{1,40}}\)|\((?!\d)[^()\n]{{1,40}} (?i:{_TO_DO})\)",
    "corner_brackets": rf"【[^【】\n]{{0,30}}{_CJK_TO_DO}[^【】\n]{{0,20}}】",
    "lenticular_forms": rf"[（(［\[][^）)］\]\n]{{0,20}}{_CJK_TO_DO}[^）)］\]\n]{{0,30}}[）)］\]]",
    "angles": rf"(?<![\w<=])<{_ANY}>(?!>)",
    "brackets": rf"(?<![\w\])])\[{_ANY}\](?![(\[:\w])",
    "guillemets": rf"« ?{_ANY} ?»",
    "empty_brackets": r"(?<=[:：] )(?:\[ +\]|\( +\))(?=[ .]*(?:\n|\Z))",
    "blank_lines": r"(?<![_\w])_{4,}(?![_\w])|(?<=[:：] )(?:\.{5,}|…{2,})(?=[ \W]*(?:\n|\Z|\s[A-Z]))",
    "to_come": r"(?<![\w/#`-])(?:TBD|TBC|TBA|XXX+)(?![\w:`-])|(?:(?<=[:：] )|(?<=[:：] \W)|(?<=[:：] \W\W))(?:TODO|T\.B\.D\.|XX+|N\.N\.)(?=\W{0,2}(?:\n|\Z|\s[A-Z]))",
}
_SLOTS = re.compile("|".join(f"(?P<{name}>{grammar})" for name, grammar in SLOT_GRAMMARS.items()))
#: Where a slot can begin: the first characters of the grammars.
_HINTS = re.compile(r"[{\[<«%$@_#【（(［…]|\.{5}|T(?:B[DCA]|ODO|\.B)|XX|N\.N")
#: Delimiters with other common uses.
_WEAK = {"angles", "brackets", "guillemets", "braces", "dollars", "double_brackets", "percents"}
_HEADS = frozenset(W.FIELD_HEADS)

_CODE = re.compile(r"(```|~~~).*?(?:\1|\Z)|`[^`\n]*`|<(pre|code|script|style|textarea)\b.*?</\2>", re.S | re.I)
_CODE_LINE = re.compile(
    r"""^[ ]*(?:
        @@\s-\d+.*                                # a hunk's header
      | [-+]\s+[\w.]+\s*[=(:].*[%$\d"')\]}]\s*    # a changed line of a hunk
      | [-+]{3}\s\S+                              # file names of a diff
      | (?:export\s+|set\s+|let\s+|const\s+|var\s+)?[\w.-]+\s*[+:]?=\s*\S.*  # an assignment
      | (?:-\s)?["'][\w.-]+["']\s*:\s*\S.*        # a key in quotes
      | (?:-\s)?[\w.-]+\s*:\s*(?:"[^"\n]*"|'[^'\n]*')\s*,?  # a key of one word with a quoted value
      | (?:-\s)?[a-z][a-z0-9]*(?:[_.-][a-z0-9]+)+\s*:\s*\S.*  # a key joined of parts
      | (?:-\s)?[A-Z][A-Z0-9]*(?:[_][A-Z0-9]+)+\s*:\s*\S.*
      | (?i:usage|verwendung|synopsis|syntax)\s*:.* # how to call a program
      | (?:\$\s|>>>|\#!|//|/\*)\s?\S.*            # a shell or interpreter line, a comment
      | \d{4}-\d\d-\d\d[T ]\d\d:\d\d.*            # a line of a log
      | .*[;{]\s*                                 # a statement
      | (?:def|class|return|import|from|for|if|while|func|fn|public|private)\s[^.!?\n]*[:)]\s*
    )$""",
    re.X,
)
#: A line of a configuration: one word of small letters, then a value.
_SETTING = re.compile(r"^\s*(?:- )?(?:[a-z][\w.-]*|[A-Z][A-Z0-9]*_[A-Z0-9_]*)\s*[:=].*$|^\s*[\[\]{}(),]*\s*$|^\s*\[[\w .-]+\]\s*$|^\s*#.*$")
_QUOTED = re.compile(r"\"[^\"\n]*\"|(?<![^\W_])'[^'\n]*'(?![^\W_])|“[^”\n]*”|„[^“”\n]*[“”]|「[^」\n]*」|『[^』\n]*』|‘[^’\n]*’")
_SENTENCE_END = re.compile(r"(?<=[.!?])(?=\s)|(?<=[。！？])|\n")
#: Words that talk about placeholders, by how surely they do.
_CUES = {
    2: re.compile(
        r"\b(placeholders?|templates?|fills?|filled in|filled by|filling|renders?|rendered|renderer|expand(?:s|ed)?|substitut\w*|interpolat\w*|replaced by|format string|escape[sd]?|literals?|macros?|syntax|typo|tokeni[sz]er|special tokens?|"
        r"platzhalter\w*|vorlagen?|eingesetzt|ersetzt|marcadores?|plantillas?|sustituy\w*|gabarits?|modèles?|remplac\w*|rempli\w*)\b|占位符|模板|替换|プレースホルダ|テンプレート|置き換え|埋め",
        re.I,
    ),
    1: re.compile(
        r"\b(variables?|arguments?|options?|preview|forms?|fields?|parsers?|strings?|brackets?|braces|delimiters?|written|writes?|prints?|printed|shows?|shown|reads?|holds?|means?|called|named|denotes?|stands? for|example|e\.g|such as|"
        r"like|unknown|variablen?|formular|feld|bedeutet|heißt|steht für|campos?|formulario|significa|formulaire|champs?|signifie)\b|变量|字段|変数|意味",
        re.I,
    ),
}
#: Sentences that mention a marker such as TBD instead of using it.
_MENTION = re.compile(r"\b(?:last|every|all|no|any|each|remaining|left ?over|masked|redacted|marked|removed?|resolved?|replaced?|literal|grep|search\w*|anonymi[sz]ed|geschwärzt|maskiert|masqué\w*|enmascarad\w*)\b", re.I)
_LINKING = re.compile(r"^\W*(see|see also|cf\.?|siehe|vgl\.?|voir|véase|ver|参见|参照)\b", re.I)
#: Who reads of a slot that a program fills.
_MATHS = re.compile(r"\\[a-z]+|[∑∫√≤≥∈]")


def _spans(pattern: re.Pattern[str], text: str) -> list[tuple[int, int]]:
    return [m.span() for m in pattern.finditer(text)]


def _without(text: str, start: int, end: int, hits: list[re.Match[str]]) -> str:
    """A stretch of the text with a space for each hit."""
    edges = [start, *(x for hit in hits for x in hit.span()), end]
    return " ".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _code_line(text: str, at: int) -> bool:
    """Whether a place stands in a line of code or configuration."""
    end = text.find("\n", at)
    return bool(_CODE_LINE.match(text[text.rfind("\n", 0, at) + 1 : len(text) if end < 0 else end]))


def _inside(at: int, spans: list[tuple[int, int]]) -> bool:
    return any(a <= at < b for a, b in spans)


def _field_like(name: str) -> bool:
    """Whether a name's last or first word is the head of a field's name (compounds end with it)."""
    words = [w.lower() for w in re.findall(r"[^\W\d_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name))]
    return bool(words) and (
        words[-1] in _HEADS
        or words[0] in _HEADS
        or any(len(h) > 3 and words[-1].endswith(h) and len(words[-1]) > len(h) for h in _HEADS)
        or any(h in name for h in W.FIELD_HEADS_CJK)
    )


def _config(text: str) -> bool:
    """Whether a text is a configuration: most of its lines are settings."""
    lines = [x for x in text.split("\n") if x.strip()]
    return bool(lines) and sum(bool(_SETTING.match(x)) for x in lines) >= 0.6 * len(lines)


def slot_hits(text: str) -> Iterator[re.Match[str]]:
    """Every place of a normalised text where a grammar matches, from left to right, without overlap."""
    at = 0
    for hint in _HINTS.finditer(text):
        if hint.start() >= at and (hit := _SLOTS.match(text, hint.start())):
            at = hit.end()
            yield hit


def tutorial(opened: int, explained: int, cues: int, sentences: int) -> bool:
    """Whether the slots found open are rather strays of a text about slots.

    So it is when the text explains such slots at least twice as often as it leaves them
    open (in code, quotes or sentences about them), talks about placeholders, and the open
    ones are sparse: fewer than SLOT_DENSITY a sentence.
    """
    return cues > 0 and explained >= 2 * opened and opened < SLOT_DENSITY * max(sentences, 1)


def open_slots(text: str) -> list[str]:
    """The slots of a normalised text that are still open."""
    hits = list(slot_hits(text))
    if not hits:
        return []
    code = _spans(_CODE, text)
    config = _config(text)
    bounds = [0, *(m.start() for m in _SENTENCE_END.finditer(text)), len(text)]
    upper = not any(c.islower() for c in _without(text, 0, len(text), hits))
    opened: list[tuple[str, str]] = []
    explained = cues = n = 0
    by_sentence: dict[int, list[re.Match[str]]] = {}
    for hit in hits:
        while n + 1 < len(bounds) - 1 and bounds[n + 1] <= hit.start():
            n += 1
        by_sentence.setdefault(n, []).append(hit)
    weak: list[tuple[str, str]] = []
    for n, found in by_sentence.items():
        start, end = bounds[n], bounds[n + 1]
        # a grammar may reach over what looks like a sentence's end
        sentence = text[start : max(end, found[-1].end())]
        bare = _without(text, start, start + len(sentence), found)
        cue = sum(weight * len({w if isinstance(w, str) else w[0] for w in pattern.findall(bare.lower())}) for weight, pattern in _CUES.items())
        cues += cue > 1
        quoted = _spans(_QUOTED, sentence)
        for hit in found:
            style, slot, at = hit.lastgroup or "", hit.group(), hit.start() - start
            name = slot.strip("{}[]<>«»%$@#_=()【】（）［］ ")
            around = next((s for s in quoted if s[0] <= at < s[1]), None)
            mentioned = around is not None and sentence[around[0] + 1 : around[1] - 1].strip() != slot
            if style == "angles" and (name.lower() in W.ELEMENTS or f"</{name}" in text):
                continue  # mark-up
            if _inside(hit.start(), code) or _code_line(text, hit.start()) or config or mentioned or cue > 1 or (around and cue):
                explained += 1
            elif style == "to_come" and _MENTION.search(bare) or _LINKING.search(bare) or style in ("braces", "dollars") and _MATHS.search(bare):
                explained += 1
            elif style in ("brackets", "angles") and hit.group() == sentence.strip() and not _field_like(name):
                continue  # a heading, a tag
            elif style in _WEAK and not _telling(style, slot, name, upper):
                weak.append((style, slot))
            else:
                opened.append((style, slot))
    if not opened:
        # delimiters with other uses count when several different names stand in the same ones
        for style in {s for s, _ in weak} - {"guillemets", "double_brackets", "brackets"}:
            if len({slot for s, slot in weak if s == style}) > 1:
                opened += [x for x in weak if x[0] == style]
    if opened and tutorial(len(opened), explained, cues, len(bounds) - 1):
        return []
    return [slot for _, slot in opened]


def _telling(style: str, slot: str, name: str, upper: bool) -> bool:
    """Whether a hit between delimiters with other common uses is a slot by its name alone."""
    shouted = name.isupper() and not upper and len(name) > 2
    if style in ("angles", "percents"):
        return shouted or _field_like(name)
    if style == "brackets":
        return (shouted and not any(c.isdigit() for c in name)) or _field_like(name) and " " in name.strip()
    if style == "dollars":
        return shouted or _field_like(name)
    if style == "double_brackets":
        return "-" not in name
    return style == "braces" or _field_like(name)


# ---------------------------------------------------------------- no body

_TAG = re.compile(r"</?[A-Za-z!?][^<>\n]*>")
_NOISE_WORD = re.compile(r"(?<!\S)(?=\S*\d)(?=\S*[A-Za-z])[A-Za-z0-9+/=]{10,}(?!\S)|(\S)\1{5,}|[0-9]{6,}|https?://\S+")
_WORD = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)*")
_LATIN_SCRIPT = re.compile(r"^[A-Za-zÀ-ɏ'-]+$")
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")
_QUOTE = re.compile(r"[\"“”„«»「」]")
#: Marks of content of its own: numbers other than codes and waiting times, names with underscores or numbers.
_OWN = re.compile(r"\d(?![\d ]*(?:minutes?|seconds?|hours?|minuten|stunden|heures?|minutos?|horas?|分钟|分)\b)|\b[^\W_]+_\w+", re.I)
_CODE_NUMBER = re.compile(r"\b(?:error|errors|fehler|erreur|code|http|status)\b\W*[45]\d\d\b|(?:错误|エラー)\W*[45]\d\d\b|^\W*[45]\d\d\b(?= ?[-–—:·] ?[^\W\d]| [^\W\d_]{3})", re.I)
#: Reason phrases of error codes and the like, where they stand alone.
_TITLE = re.compile(
    r"^\W*(?:(?:error|fehler|erreur|http(?: error| status)?)\W*)?(?:[45]\d\d\W*)?(?:not found|forbidden|unauthori[sz]ed|bad request|time-?out|timed out|gone|conflict|not acceptable|payload too large|nosuch\w+|accessdenied|internalerror|slowdown|"
    r"serviceunavailable|requesttimeout|oops|whoops|uh-oh|sorry|maintenance|connection (?:refused|reset)|wartung|maintenance en cours|mantenimiento|维护中|メンテナンス中|(?:coming soon|under construction|content to follow))\W*$"
    r"|^\W*(?:error|fehler|erreur|http(?: error| status)?)\W*[45]\d\d\W*$|^\W*[45]\d\d\W*(?:error|fehler|erreur)?\W*$",
    re.I,
)
_REFERENCE = re.compile(
    r"^\W*(?:ray|request|reference|incident|trace|error|code|id|correlation)(?: ?id| ?#| ?code)?\b\W*(?:(?=[\w-]*\d)[\w-]+(?:\W+\w+){0,2})?\W*$|^\W*(?:edge|nginx|apache|cache|varnish|proxy|cloud)[\w/. -]{0,30}$|^\W*\d{4}-\d\d-\d\d(?:[T ][\d:.]+Z?)?(?:\W+[^\W\d]+){0,2}\W*$", re.I
)
_CHROME = re.compile(
    r"^(?:[^.!?。\n]{1,25}(?: ?[|›»>·•/] ?| {2,}| — )){1,}[^.!?。\n]{0,25}$"  # a menu, a path, a footer
    r"|^\W*(?:©|\(c\)|copyright\b).*$|^☰.*$|^\W*(?:all rights reserved|terms|privacy|help|home|menu|search|reload|sign in|log in|back|cookies?|contact|imprint|impressum)\W*$"
    r"|^\W*(?:loading|please wait|lädt|chargement|cargando|加载中|読み込み中)\W*$|^\W*\d+ (?:of|/) \d+ [^.!?]{1,30}$",
    re.I,
)
_RETRY = re.compile(W.RETRY, re.I)
_LANGUAGES = tuple(W.FUNCTION_WORDS)


def _sets(table: dict[str, str]) -> dict[str, frozenset[str]]:
    return {k: frozenset(v.split()) for k, v in table.items()}


_FUNCTION, _THINGS, _FAULTS, _MANNERS = map(_sets, (W.FUNCTION_WORDS, W.THINGS, W.FAULTS, W.MANNERS))
_FILLER_THINGS, _FILLER_MARKS, _NOTICE_MARKS, _NOTICE_MANNERS = map(_sets, (W.FILLER_THINGS, W.FILLER_MARKS, W.NOTICE_MARKS, W.NOTICE_MANNERS))
_SCRIPTS = frozenset(W.SCRIPT_WORDS.split())
_ERROR_WORDS = {k: _FUNCTION[k] | _THINGS[k] | _FAULTS[k] | _MANNERS[k] for k in _LANGUAGES}
_FILLER_WORDS = {k: _FUNCTION[k] | _FILLER_THINGS[k] | _FILLER_MARKS[k] for k in _LANGUAGES}
_NOTICE_WORDS = {k: _ERROR_WORDS[k] | _NOTICE_MARKS[k] | _NOTICE_MANNERS[k] | _SCRIPTS for k in _LANGUAGES}
_GOES_ALONG = {k: _MANNERS[k] | _THINGS[k] | _SCRIPTS for k in _LANGUAGES}
_longest_first = lambda *terms: re.compile("|".join(sorted({re.escape(x) for t in terms for x in t}, key=len, reverse=True)), re.I)
_CJK_ERROR_TERMS = _longest_first(W.CJK_THINGS, W.CJK_FAULTS, W.CJK_MANNERS)
_CJK_FILLER_TERMS = _longest_first(W.CJK_FILLER_THINGS, W.CJK_FILLER_MARKS, W.CJK_MANNERS, "これ です 这 是 で".split())
_CJK_NOTICE_TERMS = _longest_first(W.CJK_THINGS, W.CJK_FAULTS, W.CJK_MANNERS, W.CJK_SCRIPT_WORDS, W.CJK_NOTICE_MARKS, W.CJK_NOTICE_MANNERS)
_CJK_ANY = {k: _longest_first(v) for k, v in {"thing": W.CJK_THINGS, "fault": W.CJK_FAULTS, "filled": W.CJK_FILLER_THINGS, "mark": W.CJK_FILLER_MARKS, "script": W.CJK_SCRIPT_WORDS, "notice": W.CJK_NOTICE_MARKS}.items()}

CONTENT, RESIDUE, NEUTRAL = "content", "residue", "neutral"


def _share(words: list[str], of: frozenset[str]) -> float:
    return sum(map(of.__contains__, words)) / len(words)


def _pieces(word: str) -> list[str]:
    """A word and, of an elided or joined one, its parts."""
    return [word] if "'" not in word or word.endswith("n't") else word.split("'")


def _wording(unit: str) -> str:
    """What the wording of a sentence says: RESIDUE, CONTENT, or NEUTRAL (it only goes with residue: advice, politeness)."""
    if _TITLE.search(unit):
        return RESIDUE
    if _QUOTE.search(unit):
        return CONTENT
    plain = _CODE_NUMBER.sub(" ", unit, count=1)
    own = bool(_OWN.search(plain))
    if len(_CJK.findall(unit)) > 1:
        return CONTENT if own else _cjk_wording(unit)
    words = [p for w in _WORD.findall(plain.lower()) if _LATIN_SCRIPT.match(w) for p in _pieces(w)]
    if not words:
        return NEUTRAL if not own else CONTENT
    if own:
        return CONTENT
    if _RETRY.search(plain) and any(_share(words, _ERROR_WORDS[k]) >= DENSE for k in _LANGUAGES):
        return RESIDUE
    neutral, here = False, set(words)
    for k in _LANGUAGES:
        if (len(here & _FAULTS[k]) > 1 or here & _FAULTS[k] and (here & _THINGS[k] or plain != unit)) and _share(words, _ERROR_WORDS[k]) >= DENSE:
            return RESIDUE
        if here & _FILLER_THINGS[k] and here & _FILLER_MARKS[k] and _share(words, _FILLER_WORDS[k]) >= DENSE:
            return RESIDUE
        if here & _SCRIPTS and here & _NOTICE_MARKS[k] and _share(words, _NOTICE_WORDS[k]) >= DENSE:
            return RESIDUE
        neutral = neutral or bool(here & _GOES_ALONG[k]) and _share(words, _NOTICE_WORDS[k]) >= DENSE_ALONG
    return NEUTRAL if neutral else CONTENT


def _cjk_wording(unit: str) -> str:
    has = {k: bool(p.search(unit)) for k, p in _CJK_ANY.items()}
    size = len(_CJK.findall(unit))
    left = lambda terms: len(_CJK.findall(terms.sub("", unit))) / size
    if (has["thing"] and has["fault"] or _RETRY.search(unit)) and left(_CJK_ERROR_TERMS) <= 1 - DENSE:
        return RESIDUE
    if has["filled"] and has["mark"] and left(_CJK_FILLER_TERMS) <= 1 - DENSE:
        return RESIDUE
    if has["script"] and has["notice"] and left(_CJK_NOTICE_TERMS) <= 1 - DENSE:
        return RESIDUE
    return NEUTRAL if left(_CJK_NOTICE_TERMS) <= 1 - DENSE else CONTENT


_KEY_RUNS = frozenset(row[::way][a:b] for row in W.KEY_ROWS for way in (1, -1) for a in range(len(row)) for b in range(a + 3, len(row) + 1))


def _key_run(word: str) -> bool:
    """Whether a word is neighbouring keys of a keyboard, either way, or one key again and again."""
    return word in _KEY_RUNS or len(word) > 2 and word == word[0] * len(word)


def _mostly_key_runs(words: list[str]) -> bool:
    """Whether at least 0.6 of the words are runs of keys; stops as soon as too many are not."""
    others = 0
    for word in words:
        others += not _key_run(word)
        if others > 0.4 * len(words):
            return False
    return True


def typed(text: str) -> bool:
    """Whether a piece of text is typing for its own sake: neighbouring keys, or a few words over and over."""
    words = [w for w in (x.strip(".,!?") for x in text.lower().split()) if w]
    if len(words) >= 4 and _mostly_key_runs(words) and any(len(set(w)) > 1 for w in words if _key_run(w)):
        return True
    if len(words) >= 6:
        common = [(w, n) for w, n in Counter(words).most_common(4) if n > 2]
        if sum(n for _, n in common) >= 0.8 * len(words) and sum(n for w, n in common if any(map(str.isalpha, w))) >= 0.4 * len(words) and not re.search(r"\w_\w|\d[.,]\d", " ".join(w for w, _ in common)):
            return True
    if not _CJK.search(text):
        return False
    whole = "".join(_NOISE_WORD.sub(" ", text).split())
    return bool(whole) and sum(len(m.group()) for m in re.finditer(r"(.{1,6}?)\1{2,}", whole)) >= 0.8 * len(whole)


def pseudo_latin(words: list[str]) -> bool:
    """Whether words are Latin filler: many of the usual ones, or Latin endings throughout and hardly a grammatical word of any language."""
    if not words:
        return False
    words = [w.lower() for w in words]
    if _share(words, W.LATIN) >= 0.45 and (len(words) >= 4 or "lorem" in words):
        return True
    grammar = max(_share(words, _FUNCTION[k]) for k in _LANGUAGES)
    endings = sum(w.endswith(tuple(W.LATIN_ENDINGS)) for w in words) / len(words)
    return len(words) >= 8 and (_share(words, W.LATIN) >= 0.3 and grammar < 0.3 or endings >= 0.85 and grammar <= 0.25)


_UNIT_END = re.compile(r"(?<=[.!?])\s+(?=\S)|(?<=[。！？])\s*")
_TYPING = re.compile(r"(?:\b(test|blah|bla|foo|asdf|qwerty|xxx)\b\W*)(?:\1\b\W*)+|(测试|テスト)(?:\s*\2)+", re.I)


def _lines(text: str) -> Iterator[tuple[str, bool]]:
    """Lines, only as far as they are asked for, and whether each is followed by an empty one; mark-up ends a line too."""
    start = 0
    while start <= len(text):
        end = text.find("\n", start)
        end = len(text) if end < 0 else end
        line = text[start:end]
        for piece in _TAG.sub("\n", line).split("\n") if "<" in line else (line,):
            if piece.strip():
                yield piece.strip(), text[end + 1 : end + 2] in ("\n", "")
        start = end + 1


_JSON_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"\s*(:?)')
_JSON_ERROR = re.compile(r'^[^{\n]*(\{.*"(?:error|errors|message|status|detail)"\s*:.*\})', re.I | re.S | re.M)


def _body(text: str) -> str:
    """The text; of a JSON document about an error in it the string values, one per line."""
    found = _JSON_ERROR.search(text) if '"' in text and "{" in text else None
    if not found:
        return text
    values = [m.group(1) for m in _JSON_STRING.finditer(found.group(1)) if not m.group(2)]
    return text[: found.start(1)] + "\n".join(["", *values, ""]) + text[found.end(1) :]


def _heading(line: str) -> bool:
    """Whether a line is a heading by its form: marked as one, or words without a sentence's end or a setting's sign."""
    marked = line[:1] == "#" or line[:2] == line[-2:] == "==" or line[-1:] in ":："
    return marked or not re.search(r"[.!?。！？;,…]$|[{}=;|]|: ", line) and len(_WORD.findall(line)) <= 10


def _prose_words(text: str) -> list[str]:
    """The words of a whole text without what is menu, footer or heading."""
    words: list[str] = []
    for line, _ in _lines(text):
        if not _CHROME.search(line) and (re.search(r"[.!?;,]$", line) or not _heading(line)):
            words += _WORD.findall(line)
    return words


def no_body(text: str) -> bool:
    """Whether a normalised text holds filler, an error message or a script notice and nothing else."""
    text = _body(text)
    residue = latin = False
    whole: bool | None = None
    first = True
    for line, _ in _lines(text):
        if _CHROME.search(line) or _REFERENCE.search(line):
            continue
        if typed(line):
            residue, first = True, False
            continue
        for unit in _UNIT_END.split(line):
            plain = _TYPING.sub(" ", unit)
            residue = residue or plain != unit
            plain = " ".join(_NOISE_WORD.sub(" ", plain.strip("#=*-•> ")).split())
            if not plain or _CHROME.search(plain) or _REFERENCE.search(plain):
                continue
            said = _wording(plain)
            if said == CONTENT:
                words = _WORD.findall(plain)
                if pseudo_latin(words):
                    said, latin = RESIDUE, True
                elif words and (latin or _share([w.lower() for w in words], W.LATIN) >= 0.3 or _latin_looks(words)):
                    if whole is None:
                        whole = pseudo_latin(_prose_words(text))
                    said, latin = (RESIDUE, True) if whole else (CONTENT, latin)
            if said == CONTENT and not residue and first and unit == line and _heading(line):
                continue  # a heading before the body
            if said == CONTENT and residue and len(_WORD.findall(plain)) <= 3 and len(_CJK.findall(plain)) <= 3:
                continue  # a fragment, no sentence: what is left of noise
            if said == CONTENT:
                return False
            residue = residue or said == RESIDUE
            first = first and said != RESIDUE
    return residue


def _latin_looks(words: list[str]) -> bool:
    """Whether a sentence may be of Latin filler, so that the whole text has to be looked at."""
    low = [w.lower() for w in words]
    return sum(w.endswith(tuple(W.LATIN_ENDINGS)) for w in low) >= 0.7 * len(low) and max(_share(low, _FUNCTION[k]) for k in _LANGUAGES) <= 0.3


def is_residue(text: str | None) -> bool:
    """Whether a text is a case; None and blank texts are not."""
    if not text or not text.strip():
        return False
    text = normalise(text)
    return bool(open_slots(text)) or no_body(text)


def flag_residue(docs: DataFrame, text: str = "text", out: str = "is_residue") -> DataFrame:
    """Add a boolean column; one narrow Arrow pass, no shuffle."""

    @F.pandas_udf("boolean")
    def flag(texts: pd.Series) -> pd.Series:
        return texts.map(is_residue)

    return docs.withColumn(out, flag(F.col(text)))


def find_residue(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The keys of the texts to be kept from the corpus."""
    return flag_residue(docs.select(key, text), text, "__residue").where("__residue").select(key)


def without_residue(docs: DataFrame, text: str = "text") -> DataFrame:
    """The corpus without template residue and error pages; all its columns."""
    return flag_residue(docs, text, "__residue").where(~F.col("__residue")).drop("__residue")

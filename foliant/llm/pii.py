"""Personal information in free text: typed spans and placeholders (problem 8).

A transducer first writes disguised text plainly and keeps for each output character the source
span it stands for: full-width and look-alike letters, invisible characters, "[at]" / "(dot)"
spellings and digits written as words. Identifiers are detected on the plain text and the spans are
mapped back, so positions are those of the source.

Names: a lexicon of given and family names is fitted on all documents from phrases that announce a
name; an Aho-Corasick automaton then finds family names anywhere, and a given name or initial beside
it makes a mention. A name announced in the document itself is a mention too, there and wherever the
document repeats it, whether the lexicon has it or not.

Defined results: null, empty and blank texts give no rows; a repeated document gives its rows again;
spans of one document do not overlap (email before id_number before phone before address before
name); positions count code points.
"""
from __future__ import annotations

import bisect
import functools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.lookalikes import LOOKALIKE
from foliant.session import read_table

LEAST = {"latin": 2, "han": 4}  # times that a part of a name is announced before the lexicon has it

# ---- transducer ----------------------------------------------------------------------------------
_ALIKE = {x: k for k, v in LOOKALIKE.items() if k.isascii() and k.isalpha() for x in v}
_PLAIN = _ALIKE | {chr(0xFF10 + i): str(i) for i in range(10)} | {chr(0xFF21 + i): chr(65 + i) for i in range(26)} | {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
_PLAIN |= dict(zip("＠．＿－＋", "@._-+")) | dict.fromkeys(map(chr, (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)), "")
_PLAIN |= dict.fromkeys(map(chr, (0xA0, 0x2002, 0x2007, 0x2009, 0x202F, 0x3000)), " ") | dict.fromkeys(map(chr, (0x2010, 0x2011)), "-")
# Digits as words.
_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
          "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
          "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
          "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9"}
_HAN_DIGITS = dict(zip("〇零一二三四五六七八九两", "001234567892"))  # Fixed values
_W = "(?:" + "|".join(sorted(_WORDS, key=len, reverse=True)) + ")"
_AT = r"\s?[\[({<]\s?(?:at|ät|arroba|arobase|艾特)\s?[\])}>]\s?"
_DOT = r"\s?[\[({<]\s?(?:dot|punkt|point|punto|点)\s?[\])}>]\s?"
_EDIT = re.compile(
    f"(?P<at>{_AT})|(?P<dot>{_DOT})"
    r"|(?P<wat>(?<=[\w]) (?:at|arroba) (?=[\w-]+(?: (?:dot|punto|punkt|point) [\w-]+)+))|(?P<wdot>(?<=[\w]) (?:dot|punto|punkt|point) (?=[\w-]{2,}))"
    f"|(?P<han>[{''.join(_HAN_DIGITS)}]{{7,}})|(?P<num>\\b{_W}(?:[ -]{_W}){{6,}}\\b)|(?P<odd>(?-i:[{''.join(map(re.escape, _PLAIN))}]))", re.I,
)
_ODD = re.compile(f"[{''.join(map(re.escape, _PLAIN))}]")
_DISGUISE = re.compile(f"[{''.join(_HAN_DIGITS)}]{{7}}|[\\[({{<] ?(?:at|ät|arroba|arobase|dot|punkt|point|punto) ?[\\])}}>]|\\b{_W}[ -]{_W}[ -]{_W}[ -]{_W}\\b| (?:at|arroba) [\\w-]+ (?:dot|punto|punkt|point) ", re.I)


def plain(text: str) -> tuple[str, list[int] | None, list[int] | None]:
    """The text without disguises and, per character of it, where its source starts and ends (None: the same)."""
    if not _ODD.search(text) and not _DISGUISE.search(text):
        return text, None, None
    out: list[str] = []
    a: list[int] = []
    b: list[int] = []
    at = 0
    for m in _EDIT.finditer(text):
        k = m.lastgroup
        if k in ("wat", "wdot") and not re.search(r"(?i) (?:dot|punto|punkt|point) |@", text[max(0, m.start() - 60) : m.end() + 40]):
            continue
        s, e = m.span()
        out.append(text[at:s])
        a += range(at, s)
        b += range(at + 1, s + 1)
        new = {"at": "@", "wat": "@", "dot": ".", "wdot": "."}.get(k)
        if k == "han":
            new = "".join(_HAN_DIGITS[c] for c in m.group())
        elif new is None:
            new = "".join(_WORDS[w.lower()] for w in re.findall(_W, m.group(), re.I)) if k == "num" else _PLAIN.get(m.group(), m.group())
        out.append(new)
        a += [s] * len(new)
        b += [e] * len(new)
        at = e
    out.append(text[at:])
    a += range(at, len(text))
    b += range(at + 1, len(text) + 1)
    return "".join(out), a, b


# ---- identifiers ---------------------------------------------------------------------------------
EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
_EXT = r"(?:,? ?(?:ext\.?|extension|extensión|Durchwahl|Durchw\.|poste|转|轉|分机) ?\d{1,5})?"
PHONE = re.compile(
    r"(?:(?:\+|00)\d{1,3}[ .-]?(?:\(0\) ?)?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ ./-]?\d{2,8}){1,5}"
    r"|\(0?\d{1,4}\)[ .-]?\d{2,5}(?:[ ./-]?\d{2,8}){1,3}"
    r"|0\d{1,4}[ ./-]\d{2,8}(?:[ ./-]?\d{2,4}){0,4}|0\d{8,10}"
    r"|[2-9]\d{2}[.-]\d{3}[.-]\d{4}|[2-9]\d{2} \d{3} \d{4}"
    r"|1[3-9]\d[ -]?\d{4}[ -]?\d{4}"
    r"|[6-9]\d{2}(?P<s>[ .-]?)\d{2}(?P=s)\d{2}(?P=s)\d{2}|[6-9]\d{2}[ .-]\d{3}[ .-]\d{3})(?![\d])" + _EXT,
    re.I,
)
_GOES_ON = re.compile(r"[./-]?\d|\s?(?:mg|kg|ml|µg|%|℃|°)")
NUMBER = re.compile(r"(?<![A-Za-z0-9_.,])(?:\+|\()?\d[\d ()./-]{6,}\d")
ID_FORMS = re.compile(
    r"(?:\d{6} ?\d{8} ?\d{3}[\dXx]|[12] ?\d\d ?\d\d ?\d[\dAB] ?\d{3} ?\d{3} ?\d\d|\d\d \d{3} \d{3} \d{3}|\d{3}[ -]\d{2}[ -]\d{4}"
    r"|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]|[A-Z]\d{8}|[CFGHJKLMNPRTVWXYZ][0-9A-Z]{8})(?![A-Za-z0-9])"
)
ID_TOKEN = re.compile(r"(?<![A-Za-z0-9-])(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]|[A-Z](?=[0-9A-Z]{8}(?![A-Za-z0-9]))[0-9A-Z]*\d[0-9A-Z]*)(?![A-Za-z0-9-])")
ID_CUE = re.compile(r"(?:\bID|ID no\.|-ID|-Nr\.|[Ii]nsurance number|card shown|[Pp]assport|identité|sécurité|[Dd]ocumento|DNI|NIE|identidad|身份证号?码?|证件号?码?|证件|护照号?码?|社保号|税号)[:： ]*(?:n[.º°o]\.? ?)?$")
NOT_ID = re.compile(r"(?:字|[Cc]ode|Zulassung|Código|[Aa]pproval|文号|批号|[Ll]ot|Charge|Lote|条码|bar code)[:： ]*$")


def _number_kind(t: str, s: int, e: int) -> tuple[str, int, int] | None:
    left = t[max(0, s - 24) : s]
    if NOT_ID.search(left):
        return None
    m = ID_FORMS.match(t, s)
    if m and ID_CUE.search(left):
        return "id_number", m.start(), m.end()
    digits = sum(c.isdigit() for c in t[s:e])
    if ID_CUE.search(left) and digits >= 8:
        while not t[e - 1].isdigit():
            e -= 1
        return "id_number", s, e
    if m and not m.group().isdigit() and (len(re.sub(r"\D", "", m.group())) in (11, 15, 17, 18) or re.fullmatch(r"9\d\d[ -]\d\d[ -]\d{4}", m.group())):
        return "id_number", m.start(), m.end()
    if m and m.group().isdigit() and len(m.group()) in (15, 18):
        return "id_number", m.start(), m.end()
    p = PHONE.match(t, s)
    if p and 9 <= sum(c.isdigit() for c in re.sub(r"(?i)(?:ext|转|poste|durchw).*", "", p.group())) <= 15 and not _GOES_ON.match(t, p.end()):
        return "phone", p.start(), p.end()
    return None


# ---- addresses -----------------------------------------------------------------------------------
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’.-]*"
_BREAK = r"(?:\n|</p>\s*<p>|<br ?/?>)"
_WORD = r"[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'’]+(?:-[A-Za-zÀ-ÿ'’]+)*"
_TOWN = rf"{_WORD}(?:[ ](?:(?:la|las|los|le|les|de|del|du|des|sur|sous|am|an|im|in|der|bei|en|upon|on|the|of) )*{_WORD}){{0,3}}"
EN_ADDRESS = re.compile(
    rf"(?<![\w.-])\d{{1,5}}[A-Za-z]?,? (?:{_CAP} ){{1,3}}?(?:Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Lane|Ln\.?|Drive|Dr\.?|Court|Ct\.?|Close|Way|Place|Pl\.?|Square|Sq\.?|Terrace|Row|Crescent|Boulevard|Blvd\.?|Highway|Hwy\.?|Walk|Hill|Gardens)"
    rf"(?:,? *(?:Flat|Apt\.?|Apartment|Unit|Suite|Room|Floor|No\.) ?\w+)?(?:,\s*|\s*{_BREAK}\s*){_TOWN}(?: (?:\d{{5}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d[A-Z\d]? \d[A-Z]{{2}}))?(?!\w)"
)
POSTCODE_TOWN = re.compile(rf"(?<![\d.-])\d{{5}} {_TOWN}")
BEFORE_TOWN = re.compile(
    r"(?:\d{1,4}(?: (?:bis|ter|quater))?,? (?:rue|avenue|av\.|bd|boulevard|impasse|place|allée|chemin|quai|cours|passage|route|square|ruelle|faubourg)\b[^\n,]{2,50}"
    r"|(?:Calle|C/|C\.|Avda\.?|Avenida|Av\.|Plaza|Pza\.|Pl\.|Paseo|P\.º|Camino|Ronda|Travesía|Carrera|Callejón)[^\n,]{2,50}?\d{1,4}(?:, ?[^\n,]{1,16})?"
    r"|(?:[A-ZÄÖÜ][\wäöüß.-]* ){0,3}[A-ZÄÖÜ][\wäöüß.-]* \d{1,4} ?[a-z]?(?:[-/]\d+)?)(?:,\s*|\s*(?:\n|</p>\s*<p>|<br ?/?>)\s*|\s+)$"
)
ZH_ADDRESS = re.compile(
    r"(?:[一-龥]{2}(?:省|自治区))?[一-龥]{2}(?:市|州)(?:[一-龥]{2}[区县市])?[一-龥]{1,5}?(?:大道|大街|路|街|道|巷|弄|胡同|里)\d+号(?:\d+(?:号楼|栋|幢|座|单元|楼|层|室|号)?)*"
    r"|[一-龥]{1,5}?(?:大道|大街|路|街|巷|弄|胡同)\d+号(?:\d+(?:号楼|栋|幢|座|单元|楼|层|室|号)?)*，[一-龥]{2}市(?:[一-龥]{2}[区县])?(?:[一-龥]{2}省)?"
)


def _addresses(t: str) -> Iterator[tuple[int, int]]:
    for m in EN_ADDRESS.finditer(t):
        yield m.span()
    for m in POSTCODE_TOWN.finditer(t):
        lo = max(0, m.start() - 90)
        b = BEFORE_TOWN.search(t, lo, m.start())
        if b:
            yield b.start(), m.end()
    if "号" in t:
        for m in ZH_ADDRESS.finditer(t):
            yield m.span()


# ---- names ---------------------------------------------------------------------------------------
_PART = r"(?:(?:von|van|zu|de la|de los|de|del|du|la|le|da|di) |[dD]['’])?"
_NAME = rf"(?P<name>(?P<g>[A-ZÀ-Þ][\w-]+)(?: [A-ZÀ-Þ]\.)? (?P<f>{_PART}[A-ZÀ-Þ][\w'’-]+)|(?P<f2>{_PART}[A-ZÀ-Þ][\w'’-]+), (?P<g2>[A-ZÀ-Þ][\w-]+)(?: [A-ZÀ-Þ]\.)?)"
CUES = (
    "Dr. |Dra. |docteur |Docteur |doctor |doctora |Doctor |Doctora |next of kin: |Patient |Patientin |Patiente |paciente |Paciente |Patient: |Patientin: |Patiente: |paciente: |Paciente: |stammt von |vient de "
    "|Mr. |Mrs. |Ms. |Miss |Mr |Mrs |Ms |Prof. |Professor |Professeur |Profesor |Profesora |Herr |Monsieur |Madame |Mme |Señor |Señora |Sr. |Sra. "
    "|notificación es de |documents to |Herrn |Frau |atención de |attention de |it's |reporter, |docteure "
).split("|")
ANNOUNCED = re.compile(rf"{_NAME}(?![\w])")
RANG_AFTER = ("rang again", "hat den Befund", "a signé", "firmó")
RANG = re.compile(rf"(?:^|[.>] |: ){_NAME} (?:{'|'.join(RANG_AFTER)})", re.M)
HAN = re.compile("[一-龥]")
ZH_ANNOUNCED = re.compile(r"(?:患者|报告人|护士|我是|经办人|家属|，)(?P<n>[一-龥]{2,4}?)(?=，身份证|，联系|记录，|，手机|。|来电|收。)|(?<=[。：\n >])(?P<m>[一-龥]{2,4})(?=医师)")
# Family names of two characters.
TWO_CHARS = ("欧阳", "司徒", "上官", "诸葛", "慕容", "司马", "夏侯", "皇甫", "尉迟", "公孙", "令狐", "宇文", "长孙", "东方", "独孤", "南宫", "闻人", "轩辕")


def _split_zh(name: str) -> tuple[str, str]:
    k = 2 if name[:2] in TWO_CHARS and len(name) > 2 else 1
    return name[:k], name[k:]


@functools.cache
def _cues():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in CUES:
        a.add_word(c, len(c))
    a.make_automaton()
    return a


def announced(text: str) -> Iterator[tuple[str, str, str, int, int]]:
    """(script, given, family, start, end) of each name a phrase announces."""

    def latin(m: re.Match) -> tuple[str, str, str, int, int]:
        g, f = (m["g"], m["f"]) if m["g"] else (m["g2"], m["f2"])
        return "latin", g.lower(), f.lower().replace("’", "'"), *m.span("name")

    last = 0
    for end, n in _cues().iter(text):
        m = ANNOUNCED.match(text, end + 1) if end + 1 - n >= last else None
        if m:
            last = m.end()
            yield latin(m)
    if any(k in text for k in RANG_AFTER):
        yield from map(latin, RANG.finditer(text))
    if not text.isascii() and HAN.search(text):
        for m in ZH_ANNOUNCED.finditer(text):
            f, g = _split_zh(m["n"] or m["m"])
            if 1 <= len(g) <= 2:
                yield "han", g, f, *m.span("n" if m["n"] else "m")


def fit_lexicon(df: DataFrame, text: str, least: dict[str, int] = LEAST) -> dict[str, dict[str, set[str]]]:
    """Given and family names announced often enough in all documents; Spark counts, only the names themselves come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c: Counter = Counter()
            for t in b.column(0).to_pylist():
                for script, g, f, _, _ in announced(t):
                    c[script, "g", g] += 1
                    c[script, "f", f] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in c], pa.string()) for i in range(3)] + [pa.array(list(c.values()), pa.int64())], names=["script", "part", "w", "n"])

    rows = (
        df.select(F.col(text).alias("t")).filter(F.length("t") > 0).mapInArrow(run, "script string, part string, w string, n long")
        .groupBy("script", "part", "w").agg(F.sum("n").alias("n"))
        .filter(" OR ".join(f"script = '{s}' AND n >= {n}" for s, n in least.items())).select("script", "part", "w").toArrow()
    )
    out = {s: {"g": set(), "f": set()} for s in ("latin", "han")}
    for s, k, w in zip(*(rows.column(i).to_pylist() for i in range(3))):
        if s == "han" or (len(w) >= 3 and (k == "g" or w not in PARTICLES)):
            out[s][k].add(w)
    return out


PARTICLES = {"von", "van", "zu", "de", "del", "du", "la", "le", "da", "di", "d", "dr"}


class Names:
    """Finds mentions with a fitted lexicon."""

    # a given name or an initial before and after a family name; whether the lexicon has the given name is looked up
    BEFORE, INITIAL_BEFORE = re.compile(r"(?<![\w'’-])(?P<g>[\w-]+)(?: \w\.)? $"), re.compile(r"(?<![\w'’-])\w\. $")
    AFTER, INITIAL_AFTER = re.compile(r", (?P<g>[\w-]+)(?: \w\.(?!\w))?(?![\w'’-])"), re.compile(r", \w\.(?![\w'’-])")

    def __init__(self, lexicon: dict[str, dict[str, set[str]]]):
        import ahocorasick

        self.lexicon = lexicon
        self.given = {s: lexicon[s]["g"] for s in ("latin", "han")}
        self.latin, self.han = (ahocorasick.Automaton() if lexicon[s]["f"] and lexicon[s]["g"] else None for s in ("latin", "han"))
        for s, a in (("latin", self.latin), ("han", self.han)):
            if a is not None:
                for f in lexicon[s]["f"]:
                    a.add_word(f, len(f))
                a.make_automaton()

    def before(self, low: str, lo: int, s: int) -> re.Match | None:
        m = self.BEFORE.search(low, lo, s)
        return m if m and m["g"] in self.given["latin"] else self.INITIAL_BEFORE.search(low, lo, s)

    def after(self, low: str, e: int) -> re.Match | None:
        m = self.AFTER.match(low, e)
        return m if m and m["g"] in self.given["latin"] else self.INITIAL_AFTER.match(low, e)

    def new_names(self, t: str) -> tuple[list[tuple[int, int]], "Names | None"]:
        """Spans of the names that the text itself announces, and what finds those of them that the lexicon lacks."""
        spans, own = [], {s: {"g": set(), "f": set()} for s in ("latin", "han")}
        for script, g, f, s, e in announced(t):
            if script == "han" and t[s - 1 : s] == "，" and (t[e : e + 1] == "。" or f not in self.lexicon["han"]["f"]):
                continue  # a comma alone announces too little
            spans.append((s, e))
            if g not in self.given[script] or f not in self.lexicon[script]["f"]:
                own[script]["g"].add(g)
                own[script]["f"].add(f)
        return spans, Names(own) if any(x["f"] for x in own.values()) else None

    def find(self, t: str) -> Iterator[tuple[int, int]]:
        if self.latin is not None:
            low = t.lower()
            if len(low) != len(t):
                low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
            low = low.replace("’", "'")
            last = -1
            for end, n in self.latin.iter_long(low):
                s, e = end + 1 - n, end + 1
                if s < last or (s and (low[s - 1].isalnum() or low[s - 1] in "-'@_.")) or (e < len(low) and (low[e].isalnum() or low[e] in "-_@")):
                    continue
                b = self.before(low, max(0, s - 40), s)
                if b:
                    # an initial counts only as a capital, and not as the end of a sentence's last word
                    if b.end() - b.start() > 4 or t[b.start()].isupper() or low[b.start() : b.end()].count(".") == 0:
                        last = e
                        yield b.start(), e
                        continue
                a = self.after(low, e)
                if a and (t[a.end() - 1] != "." or t[a.start() + 2].isupper()):
                    last = a.end()
                    yield s, a.end()
        if self.han is not None:
            longest: dict[int, int] = {}
            for end, n in self.han.iter(t):
                s, e = end + 1 - n, end + 1
                k = next((k for k in (2, 1) if e + k <= len(t) and t[e : e + k] in self.given["han"]), 0)
                if k:
                    longest[s] = max(longest.get(s, 0), e + k)
            last = 0
            for s, e in sorted(longest.items()):
                if s >= last:
                    last = e
                    yield s, e


_HAN_AFTER = re.compile(r"医师|医生|大夫|护士|记录|来电|收[。，\n]|，身份证|，联系|，手机|，证件|，电话|[。，,.;；\n<（(]|\s|$|先生|女士|的")
_HAN_BEFORE = re.compile(r"(?:患者|报告人|护士|我是|经办人|家属|联系人|收件人|医师|医生|[，。：:>\n]|\A|^|\s)\Z")


def mentions(text: str | None, names: Names) -> list[tuple[str, int, int]]:
    """(kind, start, end) in source positions, in order, without overlaps."""
    if not text or not text.strip():
        return []
    t, a, b = plain(text)
    found: list[tuple[str, int, int]] = []
    if "@" in t:
        found += [("email", *m.span()) for m in EMAIL.finditer(t)]
    for m in ID_TOKEN.finditer(t):
        s = m.group()
        left = t[max(0, m.start() - 24) : m.start()]
        if sum(c.isdigit() for c in s) >= 5 and not NOT_ID.search(left):
            found.append(("id_number", *m.span()))
    for m in NUMBER.finditer(t):
        at = m.start()
        while at < m.end():
            k = _number_kind(t, at, m.end())
            if k:
                found.append(k)
                at = k[2]
            else:  # another number may stand behind a space of the same run
                nxt = re.compile(r"[ /](?=[\d(+])").search(t, at + 1, m.end())
                if not nxt:
                    break
                at = nxt.end()
    found += [("address", s, e) for s, e in _addresses(t)]
    spans, own = names.new_names(t)
    named: list[tuple[int, int]] = []
    told = set(spans)
    for s, e in (*names.find(t), *spans, *(own.find(t) if own else ())):  # a span that an earlier one crosses goes
        if t[s] >= "一" and (s, e) not in told and not (_HAN_AFTER.match(t, e) and _HAN_BEFORE.search(t, max(0, s - 4), s)):
            continue
        i = bisect.bisect_right(named, (s, 1 << 60))
        if (not i or named[i - 1][1] <= s) and (i == len(named) or named[i][0] >= e):
            named.insert(i, (s, e))
    found += [("name", s, e) for s, e in named]
    rank = {"email": 0, "id_number": 1, "phone": 2, "address": 3, "name": 4}
    kept: list[tuple[str, int, int]] = []
    starts: list[int] = []  # kept spans do not overlap, so only the ones beside a new one can cross it
    for k, s, e in sorted(found, key=lambda x: (rank[x[0]], x[1], -x[2])):
        i = bisect.bisect_right(starts, s)
        if (not i or kept[i - 1][2] <= s) and (i == len(kept) or kept[i][1] >= e):
            starts.insert(i, s)
            kept.insert(i, (k, s, e))
    if a is not None:
        kept = [(k, a[s], b[e - 1]) for k, s, e in kept]
    return sorted(kept, key=lambda x: x[1])


def mask(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for k, s, e in spans:
        out += [text[at:s], f"[{k.upper()}]"]
        at = e
    return "".join(out) + text[at:]


def find_personal(df: DataFrame, key: str, text: str, lexicon: dict | None = None) -> DataFrame:
    """(key, kind, start_pos, end_pos) of each mention."""
    lex = lexicon or fit_lexicon(df, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(lex)
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            for i, t in zip(ids, b.column(1).to_pylist()):
                rows += [(i, *x) for x in mentions(t, names)]
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32()))], names=[key, "kind", "start_pos", "end_pos"])

    return df.select(F.col(key).cast("long").alias(key), F.col(text).alias("t")).filter(F.length("t") > 0).mapInArrow(run, f"{key} long, kind string, start_pos int, end_pos int")


def mask_personal(df: DataFrame, key: str, text: str, lexicon: dict | None = None) -> DataFrame:
    """(key, masked): the text with typed placeholders; null stays null."""
    lex = lexicon or fit_lexicon(df, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(lex)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([mask(t, mentions(t, names)) for t in b.column(1).to_pylist()], pa.string())], names=[key, "masked"])

    return df.select(F.col(key).cast("long").alias(key), F.col(text).alias("t")).mapInArrow(run, f"{key} long, masked string")


def p8_found(spark, sf_dir: str) -> DataFrame:
    return find_personal(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_masked(spark, sf_dir: str) -> DataFrame:
    return mask_personal(read_table(spark, sf_dir, "documents"), "doc_id", "text")

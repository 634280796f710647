"""Personal data replaced by surrogates of the same kind.

Detected entities (:data:`KINDS`) get keyed replacements that look like the
original: letters stay letters of the same script and case, digits stay digits,
separators stay where they are; telephone numbers keep their country code,
account and card numbers their check sums, given names their gender.  A given name's
gender is that of its title, or else of a listed name; a name of neither gets a
neutral surrogate.  After the listed names, gendered surrogates are stems with an
ending of that gender, so there are as many as the corpus needs (Latin and Cyrillic;
names in other scripts have no gendered forms).

1. Entities are found where a text is read, in a normal form: the same number in
   two formats, or the same address in two cases, is one entity.  Names are found
   after a title or several, with initials, particles and any number of name
   words; the words found are joined back to all their capitalized mentions in the
   text, titled or not, with listed given names and initials before a found surname.
2. The distinct entities of the whole corpus get a candidate each from an HMAC of
   kind, normal form and attempt.  A candidate is refused if it is an original of
   the corpus, has been given to another entity, or is asked for by several in
   this attempt (the least of them gets it); the refused try again, and late attempts
   are longer, so that no kind runs out of surrogates.  Given names and surnames
   share one space, so none gets another's.  So different
   entities stay different and no surrogate is somebody's real value, and the same
   entity has the same surrogate in all documents (coreference).  Parts of a
   person's name are entities of their own, so ``John Smith`` and ``Mr. Smith``
   still share a surname; particles stay.
3. Surrogates are joined back to the rows that mention the entity, and put into the
   format of each mention.

Scale: only mentions are shuffled, and the texts that have one; each (row, entity)
pair is sent once, so an entity in a third of all documents meets its surrogate in
rows that are split by skew handling.  The entity table is written after each
attempt, below ``spark.checkpoint.dir``.

Defined results: null text stays null with no entity; an empty or very long text is
handled like any other, whole.  Repeated rows get the same text.  An empty table gives an
empty result.  A text without entities is returned unchanged.  Extra columns are kept as
they are, whatever their names.  Without the key a surrogate does not lead back to its original; the
same key gives the same surrogates for the same corpus.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transvoc.session import cut_lineage

KINDS = ("email", "iban", "ip", "card", "ssn", "phone", "given_m", "given_f", "given_x", "surname", "initial")

#: Formats of the detected entities.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Between the parts of an international number; some texts put signs after every word.
_BETWEEN = r"[ .|*#%$&!-]{0,6}"
NUMBERS = (
    ("ip", re.compile(rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)")),
    ("card", re.compile(r"(?<![\w.+-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-]|[.,]\d)")),
    ("ssn", re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}" + _BETWEEN + r"(?:\(\d{1,5}\)|\d{1,5})(?:" + _BETWEEN + r"\d{2,5}){1,4}(?!\w)"
                         r"|(?<!\w)\(\d{3,5}\)[ -]?\d{3,4}[ .-]\d{3,5}(?!\w)"
                         r"|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])")),
    ("phone", re.compile("|".join((
        r"(?<![\w.,:+/-])(?:"
        # international with 00; trunk prefix 0, not a date: in pairs, in groups, in one
        r"00[1-9]\d{0,2}(?:[ ./-]?\(\d{1,5}\)|[ ./-]\d{1,5})(?:[ ./-]?\d{2,8}){1,4}",
        r"0[1-9]([ .-])\d{2}\1\d{2}\1\d{2}\1\d{2}",
        r"(?!\d{1,2}([ -])\d{1,2}\2(?:19|20)\d\d(?!\d))0[1-9]\d{0,4}(?: ?/ ?|[ -])(?=(?:[ -]?\d){5,9}(?![ -]?\d))"
        r"\d{2,8}(?:[ -]\d{1,5}){0,4}",
        r"0[1-9]\d{8,9}",
        r"\(0\d{1,5}\) ?/? ?\d{2,8}(?:[ -]\d{2,5}){0,3}",
        # Russia and the NANP with their prefixes, and by groups; Spain, Italy
        r"8[ -]\(?\d{3,4}\)?[ -]\d{2,3}[ -]\d{2}[ -]\d{2}",
        r"(?:1[ .-])?\(?[2-9]\d{2}\)?[ .-][2-9]\d{2}[ .-]\d{4}",
        r"9\d \d{3} \d{2} \d{2}", r"[679]\d{2} \d{2} \d{2} \d{2}", r"3[2-9]\d \d{7}")) + r")(?![\w/]|[.,-]\d)")),
)
#: Attempts after which a surrogate may be longer than its original.
TIGHT = 30
DIGITS = re.compile(r"\d[\d ()./|*#%$&!-]*")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
IBAN_START = re.compile(r"(?<!\w)[A-Z]{2}\d{2}")
DOMAIN = re.compile(r"[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.[^\W\d_]{2,}")
TITLES = {"Mr.": "m", "Herr": "m", "Señor": "m", "Sr.": "m", "господин": "m",
          "Mrs.": "f", "Ms.": "f", "Frau": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra.": "f", "госпожа": "f",
          "Dr.": "", "Prof.": ""}
#: What stands inside a name, and what ends one though it is capitalized.
PARTICLES = frozenset("van von der den de del della di da das do dos du la le el al bin ibn ben ter ten zu zur zum af av y e "
                      "фон де".split())
NOT_NAMES = frozenset(
    "i he she it we you they the a an and or but if in on at of to for from with is was has had his her their this that these "
    "when while who as so then there here not no yes er sie es wir ihr der die das ein eine und oder aber il elle nous vous "
    "ils elles le la les un une et ou él ella y o monday tuesday wednesday thursday friday saturday sunday он она они и но "
    "в на с по это".split())
_TITLE = "(?:" + "|".join(map(re.escape, sorted(TITLES, key=len, reverse=True))) + r")(?!\w)"
TITLE = re.compile(rf"(?<!\w){_TITLE}")
WORD = re.compile(r"(?<![\w'’-])[^\W\d_][\w'’-]*")
#: The next part of a name; an empty line ends it.
PART = re.compile(rf"(?:[^\S\n]+(?:\n[^\S\n]*)?|\n[^\S\n]*)(?:(?P<title>{_TITLE})"
                  r"|(?P<initial>(?:[^\W\d_]\.[ -]?)*[^\W\d_]\.)|(?P<word>[^\W\d_][\w'’-]*))")
INITIAL_BEFORE = re.compile(r"(?<![\w'’-])((?:[^\W\d_]\.[ -]?)*[^\W\d_]\.)\s+\Z")
POSSESSIVE = re.compile(r"['’-]+(?:s['’-]*)?\Z")
ELIDED = re.compile(r"[a-z]{1,2}['’][A-Z]")
#: Given names by gender and script; they decide a mention's gender and serve as surrogates.
GIVEN = {
    ("m", "LATIN"): "James John Robert Michael William David Thomas Daniel Paul Mark Peter Karl Hans Jean Pierre "
                    "Luis Carlos Juan Pedro Miguel".split(),
    ("f", "LATIN"): "Mary Linda Susan Karen Lisa Sarah Anna Emma Laura Julia Helga Ingrid Marie Claire Sophie "
                    "Carmen Lucia Rosa Elena Isabel".split(),
    ("m", "CYRILLIC"): "Иван Пётр Алексей Сергей Дмитрий Николай Андрей Михаил Павел Олег".split(),
    ("f", "CYRILLIC"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Вера Нина".split(),
}
#: Endings that mark made given names by gender; no ending of one is an ending of another.
ENDINGS = {
    ("m", "LATIN"): "bert rich win mund us ian hard or".split(), ("f", "LATIN"): "ina ella etta issa ia ana linda ora".split(),
    ("x", "LATIN"): "y ey i u".split(),
    ("m", "CYRILLIC"): "слав мир бор ан ент ий ослав ей".split(), ("f", "CYRILLIC"): "ина ия ана елла етта ида ора уша".split(),
    ("x", "CYRILLIC"): "и о ю ри".split(),
}
#: Attempts that draw from the listed names.
LISTED = 4
_GENDER = {n.casefold(): g for (g, _), names in GIVEN.items() for n in names}
SYLLABLES = {"LATIN": "ba be da do fe ga ha ka la le ma me mi na ne ni pa ra re ri sa se ta te to va".split(),
             "CYRILLIC": "ба ве да до ка ла ле ма ми на не ни па ра ре ри са та те то".split()}


#: A wider net (a Java pattern): a text without any of these has no entity.
MAY_HOLD = (r"@|[0-9\p{Nd}][0-9\p{Nd} ()./|*#%$&!-]{6,}|[A-Z]{2}\p{Nd}{2}|"
            + "|".join(map(re.escape, sorted(TITLES))))


@dataclass(frozen=True)
class Mention:
    start: int
    end: int
    kind: str
    normal: str


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def normal_form(kind: str, text: str) -> str:
    if kind == "phone":
        if text.startswith("+"):
            code = re.match(r"\+(\d{1,3})(?=\D)", text) or re.match(r"\+(\d)", text)
            return f"{code[1]}|{_digits(text[code.end():])}"
        if text.startswith("00"):
            return normal_form(kind, "+" + text[2:])
        return "|" + _digits(text)
    if kind in ("card", "ssn"):
        return _digits(text)
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "initial":
        text = text.replace(" ", "")
    return unicodedata.normalize("NFC", text).casefold()


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("@")
    while at >= 0:
        start = at
        while start and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        while start < at and text[start] in ".%+-":
            start += 1
        domain = DOMAIN.match(text, at + 1)
        if start < at and domain:
            yield start, domain.end()
            at = text.find("@", domain.end())
        else:
            at = text.find("@", at + 1)


def detect(text: str | None) -> list[Mention]:
    """Mentions in ``text``, from left to right, not overlapping; where formats
    compete the one earlier in :data:`KINDS` wins."""
    if not text:
        return []
    found = [(0, a, b, "email") for a, b in _emails(text)]
    if IBAN_START.search(text):
        found += [(1, m.start(), m.end(), "iban") for m in IBAN.finditer(text)]
    for run in DIGITS.finditer(text):
        if run.end() - run.start() < 7:
            continue
        first, last = max(0, run.start() - 2), min(len(text), run.end() + 2)
        for kind, pattern in NUMBERS:
            found += [(KINDS.index(kind), m.start(), m.end(), kind) for m in pattern.finditer(text, first, last)]
    if any(t in text for t in TITLES):
        found += [(KINDS.index(kind), a, b, kind) for a, b, kind in _names(text)]
    starts: list[int] = []
    taken: list[Mention] = []
    for _, a, b, kind in sorted(set(found)):
        at = bisect_right(starts, a)
        if (not at or taken[at - 1].end <= a) and (at == len(taken) or b <= taken[at].start):
            starts.insert(at, a)
            taken.insert(at, Mention(a, b, kind, normal_form(kind, text[a:b])))
    return taken


def _titled(text: str) -> Iterator[tuple[int, int, str]]:
    """Parts of the names that follow titles."""
    at = 0
    while first := TITLE.search(text, at):
        gender, at = TITLES[first[0]], first.end()
        parts: list[tuple[int, int, str]] = []
        while m := PART.match(text, at):
            kind = m.lastgroup
            a, b = m.span(kind)
            piece, last = m[kind], False
            if kind == "title":
                if parts:
                    break
                gender = gender or TITLES[piece]
            elif kind == "initial":
                if not piece[0].isupper():
                    break
            else:
                own = POSSESSIVE.search(piece)
                if own:
                    piece, b, last = piece[:own.start()], a + own.start(), True
                if piece.casefold() in PARTICLES:
                    kind = "particle"
                elif not (piece[:1].isupper() or ELIDED.match(piece)) or (parts and piece.casefold() in NOT_NAMES):
                    break
            at = m.end()
            if kind != "title":
                parts.append((a, b, kind))
            if last:
                break
        while parts and parts[-1][2] == "particle":
            a, b, _ = parts.pop()
            if text[a].isupper():  # a name after all
                parts.append((a, b, "word"))
        words = [p for p in parts if p[2] == "word"]
        split = next((p[0] for k, p in enumerate(parts) if p[2] == "particle" and any(x[2] == "word" for x in parts[:k])), None)
        given = [p for p in words[:-1] if split is None or p[0] < split]
        if not gender and given:
            gender = next((g for g in (_GENDER.get(normal_form("surname", text[a:b])) for a, b, _ in given) if g), "x")
        for a, b, kind in parts:
            if kind == "initial":
                yield a, b, kind
            elif kind == "word":
                yield a, b, f"given_{gender}" if (a, b, kind) in given else "surname"


def _names(text: str) -> list[tuple[int, int, str]]:
    """Parts of names: after titles, and wherever a word found there is mentioned again."""
    found = list(_titled(text))
    # A name of unknown gender takes the one that it has elsewhere in the text.
    gendered = {normal_form(k, text[a:b]): k for a, b, k in reversed(found) if k in ("given_m", "given_f")}
    found = [(a, b, gendered.get(normal_form(k, text[a:b]), k) if k == "given_x" else k) for a, b, k in found]
    held = {a: kind for a, _, kind in found}
    known: dict[str, dict[str, str]] = {"given": {}, "surname": {}}
    for a, b, kind in found:
        if kind != "initial":
            known[kind.split("_")[0]].setdefault(normal_form(kind, text[a:b]), kind)
    if not known["given"] and not known["surname"]:
        return found
    words = [m.span() for m in WORD.finditer(text)]
    after = ""  # kind of the next word, if only space lies between
    start = len(text)
    for a, b in reversed(words):
        near = after if not text[b:start].strip() else ""
        if a in held:
            after, start = held[a], a
            continue
        own = POSSESSIVE.search(text, a, b)
        end = own.start() if own else b
        kind = _kind_of(text[a:end], known, near if end == b else "")
        after, start = kind, a
        if kind:
            found.append((a, end, kind))
        elif "-" in text[a:end]:
            x = a
            for piece in text[a:end].split("-"):
                if kind := _kind_of(piece, known, ""):
                    found.append((x, x + len(piece), kind))
                x += len(piece) + 1
    for a, _, kind in list(found):  # initials before a name
        if m := INITIAL_BEFORE.search(text, max(0, a - 24), a):
            if kind != "initial" and m[1][0].isupper():
                found.append((*m.span(1), "initial"))
    return found


def _kind_of(word: str, known: dict[str, dict[str, str]], after: str) -> str:
    """The kind of an untitled mention, or nothing; ``after`` is the kind of the word behind it."""
    if not (word[:1].isupper() or ELIDED.match(word)):
        return ""
    normal = normal_form("surname", word)
    if after and normal in known["given"]:
        return known["given"][normal]
    if normal in known["surname"]:
        return "surname"
    if after and normal in _GENDER:
        return f"given_{_GENDER[normal]}"
    return known["given"].get(normal, "")


class _Stream:
    """Numbers below a bound, from an HMAC in counter mode."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.parts, self.block, self.left = key, "\0".join(parts).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hmac.new(self.key, self.parts + b"\0%d" % self.block, hashlib.sha256).digest()
            self.block += 1
        x, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return x * n >> 32


def script_of(text: str) -> str:
    """LATIN, CYRILLIC, ... of the first letter."""
    for c in text:
        if c.isalpha():
            return unicodedata.name(c, "LATIN").split()[0]
    return "LATIN"


def _letter(c: str, draw: _Stream) -> str:
    """Another letter of the script of ``c`` (plain letters where the script has a known alphabet)."""
    base = unicodedata.normalize("NFD", c)[0]
    for first, size in (("a", 26), ("а", 32), ("α", 25)):
        if first <= base <= chr(ord(first) + size - 1):
            new = chr(ord(first) + draw.below(size))
            return "σ" if new == "ς" else new
    # Others: a letter of the same block of 16 code points.
    low = ord(c) & ~15
    near = [chr(p) for p in range(low, low + 16) if chr(p).isalpha() and chr(p).casefold() == chr(p)]
    return near[draw.below(len(near))] if near else c


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10


def candidate(kind: str, normal: str, attempt: int, key: bytes) -> str:
    """The surrogate (in normal form) that ``attempt`` gives to an entity.

    Where a format has too few values for all entities, later attempts get longer."""
    draw = _Stream(key, kind, normal, str(attempt))
    extra = 1 + (attempt - TIGHT) // 10 if attempt >= TIGHT else 0
    if kind in ("phone", "card", "ssn", "iban"):
        normal += "0" * extra
    number = lambda s, lead=False: "".join(
        str(1 + draw.below(9) if lead and i == 0 and c != "0" else draw.below(10)) for i, c in enumerate(s))
    if kind.startswith("given_") or kind == "surname":
        script = script_of(normal)
        names, parts = GIVEN.get((kind[-1], script), []), SYLLABLES.get(script)
        if kind != "surname" and names and attempt < LISTED:
            return names[draw.below(len(names))].casefold()
        if parts:
            stem = "".join(parts[draw.below(len(parts))] for _ in range(2 + attempt // 4 + draw.below(2)))
            if kind == "surname":
                return stem
            ends = ENDINGS[kind[-1], script]
            new = stem[:-1] + ends[draw.below(len(ends))]
            # A listed name may be of another gender.
            return parts[draw.below(len(parts))] + new if new in _GENDER else new
        return "".join(_letter(c, draw) if c.isalpha() else c for c in normal + normal[:1] * extra)
    if kind == "initial":
        new = "".join(_letter(c, draw) if c.isalpha() else c for c in normal)
        return new[:1] + "".join(_letter(normal[0], draw) for _ in range(attempt // 2)) + new[1:]
    if kind == "email":
        local, domain = normal.rsplit("@", 1)
        labels = domain.split(".")
        mask = lambda s: "".join(str(draw.below(10)) if c.isdigit() else _letter(c, draw) if c.isalpha() else c
                                 for c in s)
        # The domain's own stream: addresses of one domain stay of one domain, except when refused.
        own, draw = draw, _Stream(key, "domain", domain, str(attempt))
        host = ".".join([mask("a" * extra + labels[0]), *map(mask, labels[1:-1]), labels[-1]])
        draw = own
        return f"{mask(local + 'a' * extra)}@{host}"
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4 + extra))
    if kind == "phone":
        code, rest = normal.split("|")
        # Prefixes of national numbers stay: 0, or 8 and 1 before ten digits.
        keep = not code and (rest[:1] == "0" or (len(rest) == 11 and rest[0] in "18"))
        return f"{code}|{rest[:keep]}{number(rest[keep:], lead=True)}"
    if kind == "card":
        new = number(normal, lead=True)
        if _luhn(normal) == 0:
            new = next(x for x in (new[:-1] + str(d) for d in range(10)) if _luhn(x) == 0)
        return new
    if kind == "iban":
        body = "".join(str(draw.below(10)) if c.isdigit() else chr(65 + draw.below(26)) for c in normal[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{normal[:2]}00")) % 97
        return f"{normal[:2]}{check:02d}{body}"
    return number(normal, lead=True)


def in_format(kind: str, mention: str, surrogate: str) -> str:
    """``surrogate`` written the way ``mention`` is: its separators, its case."""
    if kind in ("phone", "card", "ssn", "iban"):
        new = iter(("00" if kind == "phone" and mention.startswith("00") else "") + surrogate.replace("|", ""))
        return "".join(next(new) if c.isalnum() else c for c in mention) + "".join(new)
    if kind == "initial":
        parts = [x[:1].upper() + x[1:] for x in surrogate.split(".") if x]
        signs = re.split(r"\w\.", mention)[1:]
        return "".join(f"{x}.{sign}" for x, sign in zip(parts, signs, strict=True))
    if kind.startswith("given_") or kind == "surname":
        return surrogate.upper() if mention.isupper() and len(mention) > 1 else surrogate[:1].upper() + surrogate[1:]
    if mention.isupper():
        return surrogate.upper()
    return surrogate[:1].upper() + surrogate[1:] if mention[:1].isupper() else surrogate


def rewrite(text: str | None, surrogates: dict[tuple[str, str], str]) -> str | None:
    """``text`` with every mention replaced."""
    if not text:
        return text
    out, at = [], 0
    for m in detect(text):
        out += [text[at:m.start], in_format(m.kind, text[m.start:m.end], surrogates[m.kind, m.normal])]
        at = m.end
    return "".join(out) + text[at:]


def mentions(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``mark, kind, normal, n``: the distinct entities of each text (``mark`` is the hash of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for mark, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts: dict[tuple[str, str], int] = {}
                for m in detect(body.as_py()):
                    counts[m.kind, m.normal] = counts.get((m.kind, m.normal), 0) + 1
                rows += [(mark, *k, n) for k, n in counts.items()]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.string()),
                 pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64())],
                names=["mark", "kind", "normal", "n"])

    return (docs.where(F.col(text).isNotNull()).select(_mark(text).alias("mark"), F.col(text).alias("text"))
            .mapInArrow(run, "mark binary, kind string, normal string, n long"))


def _mark(text: str):
    return F.unhex(F.sha2(text, 256))


def surrogate_table(entities: DataFrame, key: bytes) -> DataFrame:
    """``kind, normal, surrogate`` for distinct ``kind, normal``; a surrogate is neither given twice nor an original,
    for names of any kind together, for the other kinds within each."""

    def draw(attempt: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = batch.to_pydict()
                new = [candidate(k, x, attempt, key) for k, x in zip(got["kind"], got["normal"], strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())],
                                                 names=["kind", "normal", "surrogate"])
        return run

    space = F.when(_is_given() | (F.col("kind") == "surname"), F.lit("name")).otherwise(F.col("kind")).alias("space")
    open_, given, attempt = entities.select("kind", "normal"), None, 0
    originals = entities.select(space, F.col("normal").alias("surrogate")).distinct()
    while not open_.isEmpty():
        asked = cut_lineage(open_.mapInArrow(draw(attempt), "kind string, normal string, surrogate string"),
                            "pii-asked")
        free = (asked.groupBy(space, "surrogate").agg(F.min(F.struct("normal", "kind")).alias("first"))
                .join(originals, ["space", "surrogate"], "left_anti"))
        if given is not None:
            free = free.join(given.select(space, "surrogate"), ["space", "surrogate"], "left_anti")
        free = cut_lineage(free.select("first.kind", "first.normal", "surrogate"), "pii-free")
        given = free if given is None else given.unionByName(free)
        open_ = cut_lineage(open_.join(free.select("kind", "normal"), ["kind", "normal"], "left_anti"), "pii-open")
        attempt += 1
    return given if given is not None else entities.select("kind", "normal", F.lit("").alias("surrogate"))


def _is_given():
    return F.col("kind").startswith("given_")


def with_entities(found: DataFrame) -> DataFrame:
    """Mentions with ``entity``, the kind of the entity they mean: a given name whose gender the text does not tell has
    the one that most of its other mentions in the corpus have (equally many: male), so it is the same person's name
    in every document."""
    told = (found.where(_is_given() & (F.col("kind") != "given_x")).groupBy("normal", "kind").agg(F.sum("n").alias("n"))
            .groupBy("normal").agg(F.max_by("kind", F.struct("n", "kind")).alias("told")))
    untold = found.where("kind = 'given_x'").join(told, "normal", "left").select(
        "mark", "kind", "normal", "n", F.coalesce("told", "kind").alias("entity"))
    return found.where("kind <> 'given_x'").withColumn("entity", F.col("kind")).unionByName(untold)


def pseudonymize(docs: DataFrame, key: bytes, *, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` rewritten and ``n_entities``, its number of mentions (``n_entities_1``, ... where
    ``docs`` has such a column itself)."""
    found = cut_lineage(with_entities(cut_lineage(mentions(docs, text=text).distinct(), "pii-found")), "pii-mentions")
    entities = cut_lineage(found.select(F.col("entity").alias("kind"), "normal").distinct(), "pii-entities")
    table = surrogate_table(entities, key).withColumnRenamed("kind", "entity")
    per_text = cut_lineage(
        found.join(table, ["entity", "normal"]).groupBy("mark").agg(
            F.collect_list(F.struct("kind", "normal", "surrogate")).alias("pairs"), F.sum("n").alias("n_found")),
        "pii-pairs")
    at, names = docs.columns.index(text), [f"c{i}" for i in range(len(docs.columns))]  # whatever docs calls them
    rows, body = docs.toDF(*names), f"c{at}"
    # Texts that cannot hold an entity stay where they are.
    may = F.coalesce(F.col(body).rlike(MAY_HOLD), F.lit(False))
    joined = (rows.where(may).withColumn("own", _mark(body)).join(per_text, F.col("own") == F.col("mark"), "left")
              .select(*names, F.coalesce("n_found", F.lit(0)).cast("long").alias("n_found"), "pairs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for own, pairs in zip(batch.column(at), batch.column(len(names) + 1), strict=True):
                held = pairs.as_py()
                new.append(rewrite(own.as_py(), {(p["kind"], p["normal"]): p["surrogate"] for p in held})
                           if held else own.as_py())
            kept = [pa.array(new, pa.string()) if i == at else batch.column(i) for i in range(len(names) + 1)]
            yield pa.RecordBatch.from_arrays(kept, names=[*names, "n_found"])

    out = (joined.mapInArrow(run, joined.drop("pairs").schema)
           .unionByName(rows.where(~may).withColumn("n_found", F.lit(0).cast("long"))))
    count, k = "n_entities", 0
    while count in docs.columns:
        count = f"n_entities_{(k := k + 1)}"
    return out.toDF(*docs.columns, count)

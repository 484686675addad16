"""Personal data and secrets replaced by keyed surrogates of the same type and format."""

from __future__ import annotations

import bisect
import hashlib
import hmac
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, slices, small, staged, unstage

#: Rounds without any progress after which distinct surrogates are taken to be impossible.
STUCK_ROUNDS = 20

# Forms of address and the gender they tell, given names by gender, and the syllables of invented names by script.
TITLES = {"Mr": "m", "Mister": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Señor": "m", "Señora": "f", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f", "Dr": "", "Prof": ""}
CUES = ("my name is", "My name is", "Name:", "name:", "Contact", "contact", "Dear", "Sincerely,", "Regards,", "Patient", "patient", "Signed by", "signed by", "I am", "Author:", "Customer")
#: Common given names by gender, that make a name of the capitalised word behind them.
COMMON = {
    "m": "James John Robert Michael William David Richard Joseph Charles Christopher Daniel Matthew Anthony Mark Paul Steven Andrew Kenneth George Joshua Kevin Brian Edward Ronald Timothy Jason Jeffrey Ryan Jacob Gary Juan Carlos Luis Jorge Pedro Pablo Diego Miguel Antonio Jose Hans Klaus Wolfgang Jean Pierre Jacques Giovanni Marco Luca Ahmed Mohammed Ali Omar".split(),
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Karen Lisa Nancy Betty Sandra Margaret Ashley Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Sharon Cynthia Kathleen Amy Angela Ana Carmen Lucia Isabel Elena Marta Ingrid Ursula Monique Chantal Giulia Francesca Fatima Aisha Maria Anna".split(),
}
#: Small words within names.
PARTICLES = ("van", "von", "vom", "der", "den", "de", "del", "della", "di", "da", "do", "dos", "das", "du", "des", "la", "las", "los", "le", "bin", "ibn", "al", "el", "ten", "ter", "zu", "zum", "zur", "af", "av")
STREETS = ("Street", "St", "Avenue", "Ave", "Road", "Rd", "Lane", "Ln", "Drive", "Boulevard", "Blvd")
GIVEN = {
    ("latin", "m"): ["Adam", "Boris", "Carl", "David", "Edgar", "Felix", "Gustav", "Henry", "Isaac", "Jonas", "Karl", "Leon", "Martin", "Noah", "Oscar", "Peter", "Robert", "Simon", "Thomas", "Victor"],
    ("latin", "f"): ["Alice", "Bertha", "Clara", "Diana", "Emma", "Flora", "Greta", "Helen", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula", "Rosa", "Sarah", "Teresa", "Vera"],
    ("cyrillic", "m"): ["Андрей", "Борис", "Виктор", "Григорий", "Иван", "Максим", "Николай", "Павел"],
    ("cyrillic", "f"): ["Анна", "Вера", "Галина", "Елена", "Ирина", "Мария", "Ольга", "Татьяна"],
    ("greek", "m"): ["Γιώργος", "Νίκος", "Πέτρος", "Στέφανος"],
    ("greek", "f"): ["Άννα", "Ελένη", "Μαρία", "Σοφία"],
}
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "lu", "ma", "ne", "pi", "ro", "su", "ta", "ve", "zi", "kor", "lan", "mer"],
    "cyrillic": ["ба", "де", "фи", "го", "лу", "ма", "не", "пи", "ро", "су", "та", "ве", "зи", "кор", "лан", "мер"],
    "greek": ["βα", "δε", "φι", "γο", "λου", "μα", "νε", "πι", "ρο", "σου", "τα", "βε", "ζι", "κορ", "λαν", "μερ"],
}

_NAME = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
_PATTERNS = [  # (type, what a text must contain, expression with the entity as its last group or whole), in order of precedence
    ("email", "@", re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}")),
    ("secret", "AKIA", re.compile(r"\bAKIA([0-9A-Z]{16})\b")),
    ("secret", "=", re.compile(r"(?i:\b(?:password|passwd|pwd|secret|token|api_?key)\s?=\s?)([^\s,;'\"]{6,})")),
    ("secret", ":", re.compile(r"(?i:\b(?:password|passwd|pwd|secret|token|api[_ ]?key)\s?:\s?)((?=[^\s,;'\"]*\d)[^\s,;'\"]{6,})")),
    ("passport", "assport", re.compile(r"(?i:\bpassport(?: (?:no|number|nr))?\.?[:\s#]{1,3})([A-Z]{0,2}\d{6,9})\b")),
    ("date", None, re.compile(r"(?i:\b(?:born(?: on)?|date of birth|dob|birthday)\b[:\s]{1,3})(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})\b")),
    ("address", " ", re.compile(rf"\b(\d{{1,5}} [A-Z][a-z]+(?: [A-Z][a-z]+)?)(?= (?:{'|'.join(STREETS)})\b)")),
    ("iban", None, re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("ip", ".", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")),
    ("ip6", ":", re.compile(r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])")),
    ("card", None, re.compile(r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])")),
    ("phone", None, re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w(])\(\d{2,4}\)[ .-]?\d{3,4}(?:[ .-]\d{2,4}){1,2}(?!\w)|(?<![\w.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])")),
    ("phone", "0", re.compile(r"(?<![\w.,+/-])0\d{2,4}[ /-](?:\d{5,8}|\d{2,4}(?:[ /-]\d{2,4}){1,3})(?![\w/-]|[.,]\d)")),
    ("ssn", "-", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("number", None, re.compile(r"(?<![\w.,-])\d{9,12}(?![\w-]|[.,]\d)")),
]
#: Behind a title or a cue: a look at the words that may be a name.
_AHEAD = rf"(?=({_NAME}(?: +{_NAME}){{0,7}}))"
_TITLED = re.compile(rf"\b({'|'.join(TITLES)})\b\.? +{_AHEAD}")
_CUED = re.compile(rf"\b(?:{'|'.join(CUES)}):? *{_AHEAD}")
_TURNED = re.compile(rf"({_NAME}), ({_NAME})")
_COMMON = {n: g for g, names in COMMON.items() for n in names}
_COMMONLY = re.compile(rf"\b([A-Z][a-z]+)(?=((?: [A-Z]\.)? +{_NAME}(?: +{_NAME}){{0,5}}))")
_WORD = re.compile(_NAME)
_DIGIT = re.compile(r"\d")


def _capitals(name: str, most: int = 3, shouted: bool = False, lead: bool = False) -> str:
    """The leading words of name that begin with a capital, at most so many, with the small words between them (lead: before them, too).
    shouted: all of them may be in capitals, else none is."""
    words, out, n, loud = name.split(" "), [], 0, False
    for i, word in enumerate(words):
        if word in PARTICLES:
            after = next((w for w in words[i + 1 : i + 4] if w not in PARTICLES), "")
            if (n or lead) and n < most and after[:1].isupper() and (not after.isupper() or len(after) == 1 or loud):
                out.append(word)
                continue
            break
        capitals = word.isupper() and len(word) > 1
        if n == most or not word[:1].isupper() or capitals and not (loud or shouted and not n) or loud and not capitals:
            break
        loud, n = capitals, n + 1
        out.append(word)
    return " ".join(out)


def _script(text: str) -> str:
    first = next((unicodedata.name(c, "") for c in text if c.isalpha()), "")
    return next((s for s in ("cyrillic", "greek") if first.startswith(s.upper())), "latin")


def _name_words(name: str, at: int, gender: str, lone: str) -> list[tuple[int, int, str, str]]:
    """The words of a name: given names, and the last a surname; one alone is what ``lone`` says. A kind tells script and, for given names, gender."""
    words = [(m.start(), m[0]) for m in _WORD.finditer(name) if (len(m[0]) > 1 or len(name) == 1) and m[0] not in PARTICLES]
    out = []
    for i, (k, word) in enumerate(words):
        surname = i == len(words) - 1 if len(words) > 1 else lone == "surname"
        kind = f"surname:{_script(word)}" if surname else f"given:{gender}:{_script(word)}"
        out.append((at + k, at + k + len(word), kind, word.casefold()))
    return out


def _names(text: str) -> list[tuple[int, int, str, str]]:
    """Words of personal names: behind a title, a cue or as a common given name with a capitalised word, and every other mention of the same
    words in the text, capitalised or in capitals."""
    found: list[tuple[int, int, str, str]] = []
    if any(t in text for t in TITLES):
        for m in _TITLED.finditer(text):
            if name := _capitals(m[2], shouted=True, lead=True):
                found += _name_words(name, m.start(2), TITLES[m[1]] or _gender(name.split(" ")[0]), "surname")
    if any(c in text for c in CUES):
        for m in _CUED.finditer(text):
            stated = "ame" in m[0]
            if stated and (t := _TURNED.match(text, m.start(1))) and t[1][0].isupper() and t[2][0].isupper() and t[2].capitalize() in _COMMON:
                script = _script(t[1])  # the surname first
                found.append((*t.span(1), f"surname:{script}", t[1].casefold()))
                found.append((*t.span(2), f"given:{_gender(t[2])}:{_script(t[2])}", t[2].casefold()))
                continue
            name = _capitals(m[1], shouted=stated)
            words = name.split(" ")
            # A cue that is no statement of a name needs two words, so that a sentence's capital is not taken for one.
            if name and (stated or len(words) > 1 and words[1] not in PARTICLES) and words[0] not in TITLES:
                found += _name_words(name, m.start(1), _gender(words[0]), "given")
    for m in _COMMONLY.finditer(text):
        if m[1] not in _COMMON:
            continue
        words = m[2].split(" ")
        more = next((i for i, w in enumerate(words) if w and not w.endswith(".") and w not in _COMMON), len(words))
        behind = " ".join(words[more:])  # further given names, then one surname with its small words
        name = " ".join([*words[:more], _capitals(behind, 1, lead=True)]).rstrip()
        if _capitals(behind, 1, lead=True) or any(w in _COMMON for w in words[:more]):
            found += _name_words(m[1] + name, m.start(1), _COMMON[m[1]], "given")
    if not found:
        return []
    known: dict[str, str] = {}
    for _, _, kind, canon in found:  # a word known as both is a surname where it stands alone
        if canon not in known or kind.startswith("surname"):
            known[canon] = kind
    own = {(a, b): kind for a, b, kind, _ in found}
    out = []
    for m in _WORD.finditer(text):
        word = m[0]
        kind = own.get(m.span()) or (known.get(word.casefold()) if len(word) > 1 and word[0].isupper() and (word.isupper() or not word[1:].isupper()) else None)
        if kind:
            out.append((m.start(), m.end(), kind, word.casefold()))
    return out


def find_entities(text: str) -> list[tuple[int, int, str, str]]:
    """Non-overlapping (start, end, type, canonical form) of the personal data in text, in order. Names are found word by word."""
    found: list[tuple[int, int, str, str]] = []
    digits = bool(_DIGIT.search(text))
    for kind, needs, pattern in _PATTERNS:
        if (needs and needs not in text) or (kind not in ("email", "secret") and not digits):
            continue
        for m in pattern.finditer(text):
            a, b = m.span(m.lastindex or 0)
            if kind == "ip6" and not _DIGIT.search(m[0]):
                continue
            plain = text[a:b]
            canon = {"email": plain.lower, "address": plain.lower, "ip": lambda p=plain: p, "ip6": plain.lower, "secret": lambda p=plain: p, "date": lambda p=plain: p}.get(kind, lambda p=plain: re.sub(r"[^0-9A-Za-z]", "", p))()
            found.append((a, b, kind, canon))
    found += _names(text)
    rank = {k: i for i, k in enumerate(dict.fromkeys(k for k, _, _ in _PATTERNS))}
    taken: list[tuple[int, int, str, str]] = []
    starts: list[int] = []
    for e in sorted(found, key=lambda e: (rank.get(e[2], 99), e[0], -e[1])):
        i = bisect.bisect_left(starts, e[0])
        if (i == 0 or taken[i - 1][1] <= e[0]) and (i == len(taken) or e[1] <= taken[i][0]):
            taken.insert(i, e)
            starts.insert(i, e[0])
    return taken


def _gender(given: str) -> str:
    given = given.capitalize() if given.isupper() else given
    return _COMMON.get(given) or next((g for (_, g), names in GIVEN.items() if given in names), "f" if given[-1:] in "aeαая" else "m")


def _luhn(digits: str) -> int:
    """The Luhn sum of digits, modulo 10: 0 for a valid number."""
    return sum((2 * d - 9 * (d > 4)) if i % 2 else d for i, d in enumerate(map(int, reversed(digits)))) % 10


class _Draws:
    """A stream of numbers below given bounds, from a keyed hash of an entity and an attempt."""

    def __init__(self, key: bytes, kind: str, canon: str, attempt: int) -> None:
        self.state, self.n, self.pool = (key, f"{kind}\0{canon}\0{attempt}".encode()), 0, 0
        self.size = 1

    def below(self, bound: int) -> int:
        if self.size < bound << 40:
            block = hmac.new(self.state[0], self.state[1] + b"\0%d" % self.n, hashlib.sha256).digest()
            self.pool, self.size, self.n = int.from_bytes(block), 1 << 256, self.n + 1
        self.pool, out = divmod(self.pool, bound)
        self.size //= bound
        return out


def _alike(plain: str, draws: _Draws, keep: int = 0) -> str:
    """plain with each digit and ASCII letter after the first ``keep`` replaced by one of its kind (hex digits where all are)."""
    hexes = bool(re.fullmatch(r"[0-9a-f]{8,}", plain)) and not plain.isdigit()
    out = []
    for i, c in enumerate(plain):
        if i < keep:
            out.append(c)
        elif hexes:
            out.append("0123456789abcdef"[draws.below(16)])
        elif c.isdecimal() and c.isascii():
            out.append(str(draws.below(10)))
        elif c.isascii() and c.isalpha():
            out.append(chr(ord("A" if c.isupper() else "a") + draws.below(26)))
        else:
            out.append(c)
    return "".join(out)


def _made(draws: _Draws, script: str, syllables: int) -> str:
    return "".join(SYLLABLES[script][draws.below(len(SYLLABLES[script]))] for _ in range(syllables)).capitalize()


def _date(canon: str, draws: _Draws) -> str:
    """A day of the same form: with the year where it was, and as many digits where the number allows it."""
    parts = re.split(r"([-/.])", canon)
    year = 0 if len(parts[0]) == 4 else 4
    new = {year: 1930 + draws.below(80), 2: 1 + draws.below(12), 4 - year: 1 + draws.below(28)}
    if year == 4 and int(parts[2]) > 12:  # month first
        new[0], new[2] = new[2], new[0]
    return "".join(str(new[i]).zfill(len(x)) if i % 2 == 0 else x for i, x in enumerate(parts))


def surrogate(key: bytes, kind: str, canon: str, attempt: int = 0) -> str:
    """The canonical form of the replacement: same type, length and kinds of characters; of an e-mail address the part before the @; a given
    name of the same gender and script. Later attempts may be longer where the type allows it."""
    family = kind.split(":")[0]
    draws = _Draws(key, family, canon, attempt)
    longer = "".join(chr(97 + draws.below(26)) for _ in range(attempt // 4)) if family in ("email", "domain", "secret") else ""
    if family == "email":
        local = canon.partition("@")[0]
        return f"{_alike(local, draws)}{''.join(chr(97 + draws.below(26)) for _ in range(max(0, 3 - len(local))))}{longer}"
    if family == "domain":
        labels = canon.split(".")
        return ".".join([_alike(labels[0], draws) + longer, *(_alike(x, draws) if len(x) > 3 else x for x in labels[1:-1]), labels[-1]])
    if family == "ip":
        first = [n for n in range(11, 224) if n not in (100, 127, 169, 172, 192, 198, 203)]
        return ".".join(map(str, (first[draws.below(len(first))], draws.below(256), draws.below(256), 1 + draws.below(254))))
    if family == "ip6":  # the blocks' lengths and what is left out stay
        return "".join((("123456789abcdef" if i == 0 or canon[i - 1] == ":" else "0123456789abcdef")[draws.below(15 if i == 0 or canon[i - 1] == ":" else 16)]) if c != ":" else c for i, c in enumerate(canon))
    if family == "card":
        body = _alike(canon[:-1], draws, 1)
        if _luhn(canon) == 0:
            return body + str(-_luhn(body + "0") % 10)
        return body + str(draws.below(10))
    if family == "phone":
        return _alike(canon, draws, max(0, len(canon) - 10))
    if family == "iban":
        return _alike(canon, draws, 2)
    if family == "date":
        return _date(canon, draws)
    if family == "address":
        number, _, street = canon.partition(" ")
        return " ".join([str(1 + draws.below(9)) + _alike(number[1:], draws), *(_made(draws, "latin", 2 + attempt // 4) for _ in street.split(" "))])
    if family == "given":
        _, gender, script = kind.split(":")
        if attempt < 2:
            return GIVEN[script, gender][draws.below(len(GIVEN[script, gender]))]
        end = {"latin": ("a", "on"), "cyrillic": ("на", "он"), "greek": ("να", "ος")}[script][gender == "m"]
        return _made(draws, script, 2 + attempt // 4) + end
    if family == "surname":
        return _made(draws, kind.split(":")[1], 3 + attempt // 4)
    return _alike(canon, draws) + longer


def _as_written(plain: str, kind: str, replacement: str) -> str:
    """The replacement with the separators of the entity as it was written, and in capitals where it was."""
    if kind.startswith(("given", "surname")):
        return replacement.upper() if plain.isupper() and len(plain) > 1 else replacement
    if kind in ("email", "ip", "secret", "date", "address"):
        return replacement
    if kind == "ip6":
        return replacement.upper() if plain.isupper() else replacement
    it = iter(replacement)
    return "".join(next(it, "") if c.isalnum() and c.isascii() else c for c in plain)


def _keys(entities: list[tuple[int, int, str, str]]) -> list[tuple[str, str]]:
    """The different (kind, canonical form) that are drawn for: those of the entities, and the domains of e-mail addresses."""
    out = dict.fromkeys((e[2], e[3]) for e in entities)
    for kind, canon in list(out):
        if kind == "email":
            out["domain", canon.partition("@")[2]] = None
    return list(out)


def replace_entities(text: str, key: bytes, drawn: dict[tuple[str, str], tuple[str, int]]) -> tuple[str, int]:
    """text with surrogates, and how many. drawn: kind and attempt of the entities that are not drawn as met at the first attempt."""
    out, at = [], 0
    entities = find_entities(text)
    draw = lambda kind, canon: surrogate(key, (got := drawn.get((_family(kind), canon), (kind, 0)))[0], canon, got[1])
    for a, b, kind, canon in entities:
        new = draw(kind, canon)
        if kind == "email":
            new = f"{new}@{draw('domain', canon.partition('@')[2])}"
        out += [text[at:a], _as_written(text[a:b], kind, new)]
        at = b
    return "".join([*out, text[at:]]), len(entities)


def _family(kind: str) -> str:
    return kind.split(":")[0]


def with_surrogates(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """Replaces text by one in which e-mail and IP addresses (both versions), telephone, card, account, passport, social-security and other
    long numbers, dates of birth, street addresses, secrets and personal names are surrogates; adds n_entities.

    A surrogate is drawn by a keyed hash of the entity's type and canonical form (case of e-mail addresses and names,
    and separators of numbers, do not count), so an entity has one surrogate wherever it occurs. Names are replaced
    word by word, given names and surnames apart, so that a person's full name, surname, given name and name in
    capitals stay one person's; a domain is replaced alike in all its addresses. All different entities of the table
    are gathered once; of those whose surrogates coincide, or are themselves found in the table, all but the first
    draw again until all differ. Texts without entities stay as they are; null stays null with 0 entities; repeated
    rows get equal texts. A column n_entities in docs is replaced.
    """
    docs = docs.drop("n_entities")
    own, exceptions = fresh(docs, "own", "exceptions")
    kind = "array<struct<kind: string, canon: string>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("canon", pa.string())]))

    def find(texts: pa.Array) -> pa.Array:
        return pa.array([[{"kind": k, "canon": c} for k, c in _keys(find_entities(t.decode()))] if t else [] for _, _, part in slices(texts) for t in part], arrow)

    found = docs.select(F.md5(text).alias("own"), F.arrow_udf(find, kind)(F.col(text).cast("binary")).alias("e")).where(F.size("e") > 0)
    found = staged(found.select("own", F.explode("e").alias("e")).select("own", "e.*").distinct(), "found")

    def draw(kinds: pa.Array, canons: pa.Array, attempts: pa.Array) -> pa.Array:
        return pa.array([surrogate(key, k, c, a) for k, c, a in zip(kinds.to_pylist(), canons.to_pylist(), attempts.to_pylist(), strict=True)], pa.string())

    # A name met with different titles is one entity; it takes the kind that most texts give it, of equals the first.
    by_kind = found.groupBy(F.split("kind", ":")[0].alias("family"), "canon", "kind").agg(F.count("*").alias("n"))
    most = F.min(F.struct((-F.col("n")).alias("n"), "kind"))
    names = by_kind.groupBy("family", "canon").agg(most["kind"].alias("kind"), (F.count("*") > 1).alias("several"))
    real = staged(names, "entities")
    open_, parts, stuck, before = real.withColumn("attempt", F.lit(0)), [], 0, None
    while True:
        # Those of e-mail addresses must differ within their domain, as domains do among each other.
        whole = F.when(F.col("family") == "email", F.concat(F.arrow_udf(draw, "string")("kind", "canon", "attempt"), F.lit("@"), F.split("canon", "@")[1])).otherwise(F.arrow_udf(draw, "string")("kind", "canon", "attempt"))
        drawn = staged(open_.withColumn("drawn", F.lower(whole)), "drawn")
        first = drawn.groupBy("family", "drawn").agg(F.min("canon").alias("canon"))
        taken = real.select("family", F.lower("canon").alias("drawn"))
        for p in parts:
            taken = taken.unionByName(p.select("family", "drawn"))
        won = staged(drawn.join(first.join(taken, ["family", "drawn"], "left_anti"), ["family", "drawn", "canon"], "left_semi"), "settled")
        parts.append(won)
        later = staged(drawn.join(won.select("family", "canon"), ["family", "canon"], "left_anti").withColumn("attempt", F.col("attempt") + 1).drop("drawn"), "open")
        unstage(drawn, open_ if len(parts) > 1 else None)
        open_ = later
        n = open_.count()
        if not n:
            break
        stuck = stuck + 1 if n == before else 0
        before = n
        if stuck >= STUCK_ROUNDS:
            raise RuntimeError(f"{n} surrogates still coincide after {stuck} draws without progress")
    settled = parts[0]
    for p in parts[1:]:
        settled = settled.unionByName(p)
    odd = settled.where("attempt > 0 or several")
    per = found.select("own", F.split("kind", ":")[0].alias("family"), "canon").join(odd, ["family", "canon"]).groupBy("own").agg(F.collect_set(F.struct("family", "canon", "kind", "attempt")).alias("odd"))
    per = staged(per.select(F.col("own").alias(own), F.col("odd").alias(exceptions)), "exceptions")
    unstage(found, real, open_, *parts)
    out_kind = pa.struct([("text", pa.string()), ("n", pa.int32())])

    def replace(texts: pa.Array, odd: pa.Array) -> pa.Array:
        rows = []
        for i, j, part in slices(texts):
            for t, o, there in zip(part, odd.slice(i, j - i).to_pylist(), texts.slice(i, j - i).is_valid().to_pylist(), strict=True):
                new, n = replace_entities(t.decode(), key, {(x["family"], x["canon"]): (x["kind"], x["attempt"]) for x in o or ()}) if t else ("" if there else None, 0)
                rows.append({"text": new, "n": n})
        return pa.array(rows, out_kind)

    (done,) = fresh(docs, "done")
    out = docs.withColumn(own, F.md5(text)).join(small(per), own, "left")
    out = out.withColumn(done, F.arrow_udf(replace, "struct<text: string, n: int>")(F.col(text).cast("binary"), F.col(exceptions)))
    return out.select(*[F.col(f"{done}.text").alias(c) if c == text else F.col(c) for c in docs.columns], F.col(f"{done}.n").alias("n_entities"))

"""PII surrogates: keyed, type-consistent replacements.

Detected entities become atoms (kind, normal form): an e-mail address, a phone
number's digits, a given name, a family name, and so on.  An atom's surrogate is
drawn from a keyed hash of it, so the same entity gets the same surrogate in any
text and in any spelling (coreference; a family name whatever its title), with the kind's own shape: gender and
script of names, digit grouping, letter case, checksums.  Draws are checked over
the whole corpus: two atoms with one surrogate, or a surrogate that is itself a
detected atom, are drawn again until all are distinct.
"""

from __future__ import annotations

import hashlib
import hmac
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from exposcope.llm.catalog import query
from exposcope.llm.common import broadcast_if_small, map_texts, table, written
from exposcope.session import ship_package

#: Key of the surrogates; a deployment passes its own secret.
KEY = "surrogates"
#: Draws after which an atom without a free surrogate is an error.
MOST_DRAWS = 64

#: Titles by gender (fixed values; f, m or n for either).
TITLES = {
    "m": ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Sir", "господин", "Господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "госпожа", "Госпожа"),
    "n": ("Dr", "Prof", "Доктор"),
}
#: Given names that tell a person's gender without a title (fixed values).
GIVEN = {
    "f": ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Jessica", "Sarah", "Karen", "Emma", "Anna",
          "Laura", "Sophie", "Camille", "Claire", "Ursula", "Sabine", "Lucía", "Carmen", "Мария", "Анна", "Ольга", "Елена"),
    "m": ("James", "Robert", "John", "Michael", "David", "William", "Richard", "Thomas", "Daniel", "Peter", "Paul",
          "Pierre", "Antoine", "Hans", "Jürgen", "Wolfgang", "Carlos", "José", "Javier", "Иван", "Дмитрий", "Сергей", "Алексей"),
}
GENDER = {name: g for g, names in GIVEN.items() for name in names}
_TITLE_GENDER = {t: g for g, ts in TITLES.items() for t in ts}

#: Syllables that surrogate names are made of, and endings by gender.
SYLLABLES = {"latin": ("ba", "del", "fi", "gor", "hal", "ka", "len", "mi", "nor", "pe", "ras", "sol", "ti", "va", "wen", "zu"),
             "cyrillic": ("ба", "вел", "го", "дан", "ка", "лен", "ми", "нор", "па", "рус", "со", "ти", "ва", "зу", "же", "ра")}
ENDINGS = {("latin", "f"): ("a", "ia", "ina"), ("latin", "m"): ("o", "er", "as"), ("latin", "n"): ("y", "is", "en"),
           ("cyrillic", "f"): ("а", "ия", "ина"), ("cyrillic", "m"): ("ор", "ан", "ей"), ("cyrillic", "n"): ("и", "е", "у")}
FAMILY_ENDINGS = {("latin", "f"): ("son", "man", "berg"), ("latin", "m"): ("son", "man", "berg"), ("latin", "n"): ("son", "man", "berg"),
                  ("cyrillic", "f"): ("ова", "ина", "ская"), ("cyrillic", "m"): ("ов", "ин", "ский"), ("cyrillic", "n"): ("енко", "ук", "их")}

EMAIL = re.compile(r"[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
IBAN = re.compile(r"[A-Z](?<!\w[A-Z])[A-Z]\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
#: The look-ahead passes over most characters before any alternative is tried.
NUMBER = re.compile(
    r"(?=[\d+(])(?:(?P<ip>(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<!\w)\d(?:[ -]?\d){12,18}(?!\w))"
    r"|(?P<phone>(?<!\w)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\w)"
    r"|(?<!\w)0\d{1,4}[ /-]\d{5,8}(?!\w)"
    r"|(?<!\w)(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)))")
#: Two letters or more; hyphens and apostrophes join letters, but 's, 'll and the like end a name.
_WORD = r"[^\W\d_](?:-?[^\W\d_]|['’](?!(?i:s|d|ll|ve|re)(?!\w))[^\W\d_])+"
_INITIALS = r"(?: [^\W\d_]\.){0,2}"


def _either_case(words) -> str:
    """Words as they stand and in capitals, longest first."""
    return "|".join(sorted({f for w in words for f in (w, w.upper())}, key=len, reverse=True))


TITLED = re.compile(rf"(?<!\w)({_either_case(_TITLE_GENDER)})\.? ({_WORD})(?:{_INITIALS} ({_WORD}))?")
NAMED = re.compile(rf"(?<!\w)({_either_case(GENDER)}){_INITIALS} ({_WORD})")
_GENDER_OF = {w.lower(): g for w, g in GENDER.items()}
_TITLE_OF = {t.lower(): g for t, g in _TITLE_GENDER.items()}

#: Words that tell a street, and those between them and its name (fixed values).
STREETS = ("street", "st", "road", "rd", "avenue", "ave", "lane", "drive", "boulevard", "square", "rue", "place", "calle", "avenida", "plaza")
BETWEEN = ("de", "del", "des", "du", "la", "le", "las", "los")
SUFFIXES = ("straße", "strasse", "weg", "platz", "allee", "gasse")
_CAPITAL = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+"
#: House number first, and house number last.
NUMBERED = re.compile(rf"\d(?<!\w\d)\d{{0,4}}[a-z]? (?:(?:(?!The ){_CAPITAL} ){{1,3}}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Drive|Boulevard|Square)"
                      rf"|(?:rue|avenue|boulevard|place)(?: (?:de|des|du|la|le)){{0,2}}(?: {_CAPITAL}){{1,3}})(?!\w)")
LAST = re.compile(rf"(?<!\w)(?:{_CAPITAL}(?<=straße|.platz|.allee|.gasse|...weg)|{_CAPITAL}(?<=strasse)"
                  rf"|(?:Calle|Avenida|Plaza)(?: (?:de|del|la|las|los)){{0,2}}(?: {_CAPITAL}){{1,2}},?) \d{{1,4}}[a-z]?(?!\w|\.\d)")
_LAST_HINTS = (*(f"{x} " for x in SUFFIXES), "Calle ", "Avenida ", "Plaza ")


def _script(word: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in word) else "latin"


def _named(word: str | None) -> bool:
    return bool(word) and word[0].isupper() and (len(word) == 1 or not word.isupper())


def _norm(word: str) -> str:
    return word.lower().replace("’", "'")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def iban_check(letters: str) -> int:
    """What an account number leaves over 97; 1 for a valid one."""
    return int("".join(str(int(c, 36)) for c in letters[4:] + letters[:4])) % 97


def family_gender(name: str) -> str:
    """The gender that a family name's own ending tells, whatever title stands before it."""
    if _script(name) == "latin" or name.endswith(("ко", "ук", "юк", "их", "ых")):
        return "n"
    return "f" if name.endswith(("а", "я")) else "m"


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of the atoms in a whole text, by start, not overlapping."""
    text = text or ""
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in EMAIL.finditer(text)]
    for m in IBAN.finditer(text):
        norm = m[0].replace(" ", "")
        if iban_check(norm) == 1:
            found.append((m.start(), m.end(), "iban", norm))
    for m in NUMBER.finditer(text):
        digits = m[0] if m.lastgroup == "ip" else re.sub(r"\D", "", m[0])
        found.append((m.start(), m.end(), m.lastgroup, digits))
    for pattern in (NUMBERED, LAST) if any(h in text for h in _LAST_HINTS) else (NUMBERED,):
        found += [(m.start(), m.end(), "address", m[0].lower()) for m in pattern.finditer(text)]
    names: dict[str, tuple[str, str]] = {}  # lower-case name -> (kind, word as written)

    def person(m, gender, given, family):
        for base, word in (("family", family), ("given", given)):
            # the halves of a double name may stand alone elsewhere
            for w in dict.fromkeys((word, *word.split("-")) if word else ()):
                if w == word or len(w) > 1 and (_named(w) or word.isupper()):
                    g = family_gender(_norm(w)) if base == "family" else gender
                    names.setdefault(_norm(w), (f"{base}:{g}:{_script(w)}", w))

    def name(word, caps):  # in a name in capitals its words are too
        return bool(word) and (word.isupper() and len(word) > 1 if caps else _named(word))

    for m in TITLED.finditer(text):
        g, caps = _TITLE_OF[m[1].lower()], m[2].isupper()
        if name(m[2], caps) and name(m[3], caps):
            person(m, _GENDER_OF.get(m[2].lower(), g) if g == "n" else g, m[2], m[3])
        elif name(m[2], caps) and (m[1].isupper() or not caps):
            person(m, g, None, m[2])
    for m in NAMED.finditer(text):
        if name(m[2], m[1].isupper()):
            person(m, _GENDER_OF[m[1].lower()], m[1], m[2])
    if names:  # every mention of a part, alone or not, in capitals too
        forms = {f for _, w in names.values() for f in ((w, w.upper()) if not w.isupper() else (w, w.capitalize()))}
        longest = sorted(forms, key=len, reverse=True)
        part = re.compile(r"(?<!\w)(?:%s)(?!\w)" % "|".join(re.sub("['’]", "['’]", re.escape(w)) for w in longest))
        found += [(m.start(), m.end(), names[_norm(m[0])][0], _norm(m[0])) for m in part.finditer(text)]
    out, reach = [], 0
    for a in sorted(found, key=lambda x: (x[0], -x[1])):
        if a[0] >= reach:
            out.append(a)
            reach = a[1]
    return out


class _Draw:
    """A stream of numbers from a keyed hash of (kind, normal form, attempt)."""

    def __init__(self, key: bytes, *what):
        self.key, self.what, self.left, self.block = key, "\x1f".join(map(str, what)).encode(), b"", 0

    def below(self, n: int) -> int:
        while len(self.left) < 8:
            self.left += hmac.new(self.key, self.what + b"#%d" % self.block, hashlib.sha256).digest()
            self.block += 1
        v, self.left = int.from_bytes(self.left[:8], "big"), self.left[8:]
        return v % n

    def digits(self, n: int) -> str:
        return "".join(str(self.below(10)) for _ in range(n))


def surrogate(key: bytes, kind: str, norm: str, attempt: int) -> str:
    """The draw for an atom in its normal form."""
    d = _Draw(key, kind, norm, attempt)
    base, *what = kind.split(":")
    if base in ("given", "family"):
        gender, script = what
        s = SYLLABLES[script]
        end = (ENDINGS if base == "given" else FAMILY_ENDINGS)[script, gender]
        return "".join(s[d.below(len(s))] for _ in range(2 + (base == "family") + attempt // 4)) + end[d.below(len(end))]
    if base == "address":
        def name():
            return "".join(SYLLABLES["latin"][d.below(16)] for _ in range(2 + attempt // 4))
        out = []
        for w in norm.split(" "):
            ending = next((x for x in SUFFIXES if w.endswith(x)), None)
            if w[0].isdigit():
                n = w.rstrip("abcdefghijklmnopqrstuvwxyz")
                out.append(str(1 + d.below(9)) + d.digits(len(n) - 1) + w[len(n):])
            elif w in STREETS or w in BETWEEN:
                out.append(w)
            else:
                out.append(name() + (ending or "") + ("," if w.endswith(",") else ""))
        return " ".join(out)
    if base == "ip":
        first = norm.split(".")[0]
        head = first if first in ("10", "127") else str(1 + d.below(223))
        return ".".join([head, *(str(d.below(256)) for _ in range(2)), str(1 + d.below(254))])
    if base == "email":
        local, _, domain = norm.partition("@")
        swap = lambda text, e: "".join(
            str(e.below(10)) if c.isdigit() else (chr(0x430 + e.below(32)) if "Ѐ" <= c <= "ӿ" else chr(97 + e.below(26))) if c.isalpha() else c
            for c in text)
        host, _, top = domain.rpartition(".")
        # a domain keeps its own surrogate, so addresses of one domain stay together
        return f"{swap(local, d)}{'x' * (attempt // 4)}@{swap(host, _Draw(key, 'domain', domain, 0))}.{top}"
    if base == "phone":
        keep = 1 if len(norm) > 10 or norm.startswith("0") else 0
        return norm[:keep] + str(2 + d.below(8)) + d.digits(len(norm) - keep - 1)
    if base == "iban":
        body = "".join(str(d.below(10)) if c.isdigit() else chr(65 + d.below(26)) for c in norm[4:])
        return f"{norm[:2]}{98 - iban_check(f'{norm[:2]}00{body}'):02d}{body}"
    if base == "card":
        out = str(1 + d.below(9)) + d.digits(len(norm) - 1)
        if luhn(norm):
            return next(c for k in range(10) if luhn(c := out[:-1] + str(k)))
        return out if not luhn(out) else out[:-1] + str((int(out[-1]) + 1) % 10)
    return d.digits(len(norm))


def dressed(raw: str, kind: str, drawn: str) -> str:
    """The surrogate in the mention's format: its separators, its letter case."""
    base = kind.split(":")[0]
    if base in ("phone", "card", "ssn", "iban"):
        it = iter(drawn)
        return "".join(next(it) if c.isalnum() else c for c in raw)
    if base in ("given", "family"):
        return drawn.upper() if raw.isupper() and len(raw) > 1 else drawn.capitalize()
    if base == "address":
        return " ".join(n.capitalize() if r[0].isupper() else n for r, n in zip(raw.split(" "), drawn.split(" ")))
    return drawn.upper() if raw.isupper() else drawn


def assign_surrogates(atoms: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, norm, surrogate) for distinct atoms (kind, norm): keyed draws, drawn
    again while two atoms of one shape share a surrogate or a surrogate is a
    detected atom.  Of several claimants the smallest normal form keeps it."""
    ship_package(atoms.sparkSession)
    secret = key.encode()

    @F.pandas_udf("string")
    def draw(kind: pd.Series, norm: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(secret, k, n, a) for k, n, a in zip(kind, norm, attempt)], dtype=object)

    shape = F.element_at(F.split("kind", ":"), 1)
    drawn = written(atoms.select("kind", "norm", F.lit(0).alias("attempt"))
                    .withColumn("surrogate", draw("kind", "norm", "attempt")).withColumn("shape", shape))
    real = written(drawn.select("shape", F.col("norm").alias("surrogate")).distinct())
    for _ in range(MOST_DRAWS):
        # one row per name even where it was seen with several genders
        claims = drawn.groupBy("shape", "surrogate").agg(
            F.min(F.struct("norm", "kind")).alias("owner"), F.count("*").alias("n"))
        claims = claims.join(real.withColumn("taken", F.lit(True)), ["shape", "surrogate"], "left") \
            .where("n > 1 OR taken").select("shape", "surrogate", "owner", F.coalesce("taken", F.lit(False)).alias("taken"))
        claims = written(claims)
        if not claims.limit(1).count():
            return drawn.select("kind", "norm", "surrogate")
        again = drawn.join(broadcast_if_small(claims, 256), ["shape", "surrogate"], "left")
        lost = F.coalesce(F.col("taken") | (F.struct("norm", "kind") != F.col("owner")), F.lit(False))
        again = again.select("kind", "norm", (F.col("attempt") + lost.cast("int")).alias("attempt"),
                             F.when(~lost, F.col("surrogate")).alias("__old"), "shape")
        drawn = written(again.withColumn("surrogate", F.coalesce("__old", draw("kind", "norm", "attempt"))).drop("__old"))
    raise ValueError(f"no distinct surrogates after {MOST_DRAWS} draws")


ATOMS = "array<struct<start:int,`end`:int,kind:string,norm:string>>"


def replace_pii(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", key: str = KEY) -> DataFrame:
    """``id_col``, ``text_col`` with surrogates, and ``entities``: an array of (start,
    end, kind) in the new text's code points.

    Null and empty texts stay as they are, without entities; null ids stay; rows
    that repeat an id and text get the same result; an empty table gives an empty
    result; other columns are not carried.  Detection is map-only; only texts with
    entities are shuffled, with their distinct atoms counted before the shuffle.
    """
    src = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    make = lambda: lambda texts: [([dict(zip(("start", "end", "kind", "norm"), a)) for a in detect(t)],) for t in texts]
    seen = map_texts(src, "__text", ["__id", "__text"], f"atoms {ATOMS}", make)
    hold = written(seen.where(F.size("atoms") > 0).withColumn("__t", F.xxhash64("__text")))
    mention = hold.select("__id", "__t", F.explode("atoms").alias("a")) \
        .select("__id", "__t", "a.start", F.col("a.kind").alias("kind"), F.col("a.norm").alias("norm"))
    drawn = written(assign_surrogates(mention.select("kind", "norm").distinct(), key))
    small = broadcast_if_small(drawn, F.octet_length("kind") + F.octet_length("norm") + F.octet_length("surrogate") + 48)
    told = mention.join(small, ["kind", "norm"]).groupBy("__id", "__t").agg(
        F.map_from_entries(F.collect_set(F.struct("start", "surrogate"))).alias("__new"))
    told = told.withColumnsRenamed({"__id": "__i", "__t": "__u"})
    full = hold.join(told, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__t") == F.col("__u")))

    def make_new():
        def run(rows):
            out = []
            for r in rows:
                new, text, parts, spans, at, size = dict(r["__new"]), r["__text"], [], [], 0, 0
                for a in r["atoms"]:
                    word = dressed(text[a["start"]:a["end"]], a["kind"], new[a["start"]])
                    parts += [text[at:a["start"]], word]
                    size += a["start"] - at
                    spans.append({"start": size, "end": size + len(word), "kind": a["kind"].split(":")[0]})
                    size += len(word)
                    at = a["end"]
                out.append(("".join(parts) + text[at:], spans))
            return out
        return run

    schema = f"{text_col} string, entities array<struct<start:int,`end`:int,kind:string>>"
    changed = map_texts(full.select("__id", F.struct("__text", "atoms", "__new").alias("__v")), "__v", ["__id"], schema, make_new)
    same = seen.where(F.size("atoms") == 0).select(
        "__id", F.col("__text").alias(text_col), F.array().cast("array<struct<start:int,`end`:int,kind:string>>").alias("entities"))
    return changed.unionByName(same).withColumnRenamed("__id", id_col)


@query("op2_pii_surrogates")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents")).select(
        "doc_id", "text", F.size("entities").cast("long").alias("n_entities"),
        F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["end"].cast("string"))), ",").alias("entities"))

"""Secret scan with multipart credential linking.

Single patterns (assignments, access identifiers, long hex runs) are reported as
they are.  Weak parts (other identifiers, bare high-entropy secrets, endpoints)
mean little alone: each part opens a scope of SCOPE code points around it inside
its section (sections end at blank lines), and an interval join of the scopes
reports a weak part only where complementary parts co-occur.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, functions as F

from exposcope.llm.catalog import query
from exposcope.llm.common import map_texts, table

BASE = ("assign", "access", "hex")
#: Kinds the linking adds, in their order after the base kinds.
LINKED = ("identifier", "secret", "endpoint")
#: Code points on either side of a part in which its complements must lie.
SCOPE = 300
#: Bits per character from which a bare token counts as a possible secret.
ENTROPY = 3.5

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # whole runs: equal to [0-9a-f]+ with the short ones dropped
IDENTIFIER = re.compile(r"""(?:client|account|user|access|tenant|app)[_-]?(?:id|name|key_id|user)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}""", re.A | re.I)
SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""(?:https?|postgres(?:ql)?|mysql|amqp|redis|mongodb|s3|ftp)://[^\s"'<>]+""")
SECTION = re.compile(r"\n[ \t\r]*\n")


def entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the single patterns, by start and kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def weak_spans(text: str, base: list) -> list[tuple[int, int, int]]:
    """Weak parts outside the base spans: (start, kind index from 3, end)."""
    starts = [b[0] for b in base]
    reach = 0
    ends = [reach := max(reach, b[2]) for b in base]

    def free(m) -> bool:
        k = bisect.bisect_left(starts, m.end())
        return k == 0 or ends[k - 1] <= m.start()

    found = [(m.start(), 3, m.end()) for m in IDENTIFIER.finditer(text) if free(m)]
    found += [(m.start(), 4, m.end()) for m in SECRET.finditer(text)
              if free(m) and any(map(str.isdigit, m[0])) and any(map(str.isalpha, m[0])) and entropy(m[0]) >= ENTROPY]
    found += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    return sorted(found)


def link(text: str, base: list, weak: list) -> list:
    """Weak parts whose complements lie in scope.  A secret needs an identifier
    or an access id; an identifier needs a secret, an assignment or hex run; an
    endpoint needs both sides.  A part of any length is in scope if the gap to it
    is at most SCOPE, on either side.  Each role's starts and ends are sorted, so
    the nearest part of a side is one binary search; no pairs are listed."""
    sections = [m.start() for m in SECTION.finditer(text)]
    roles = {"who": [], "what": []}
    for s, k, e in sorted(base + weak):
        if k in (1, 3):
            roles["who"].append((s, e))
        elif k in (0, 2, 4):
            roles["what"].append((s, e))
    starts = {r: [s for s, _ in v] for r, v in roles.items()}
    ends = {r: sorted(e for _, e in v) for r, v in roles.items()}

    def near(role: str, s: int, e: int) -> bool:
        # no part holds a line end, so one that ends in the section lies in it
        i = bisect.bisect_right(sections, s)
        low = max(s - SCOPE, sections[i - 1] + 1 if i else 0)
        high = min(e + SCOPE, sections[i] if i < len(sections) else len(text))
        before, after = bisect.bisect_right(ends[role], s), bisect.bisect_left(starts[role], e)
        return before > 0 and ends[role][before - 1] >= low or after < len(starts[role]) and starts[role][after] <= high

    needs = {3: ("what",), 4: ("who",), 5: ("who", "what")}
    return [(s, k, e) for s, k, e in weak if all(near(r, s, e) for r in needs[k])]


def scan(text: str | None) -> tuple[list, list]:
    """All base and linked spans of one whole text as (kind, start, end)."""
    text = text or ""
    base = base_spans(text)
    weak = weak_spans(text, base) if base or "://" in text or "=" in text or ":" in text else []
    linked = link(text, base, weak) if weak else []
    kinds = BASE + LINKED
    return ([(kinds[k], s, e) for s, k, e in base],
            [(kinds[k], s, e) for s, k, e in sorted(base + linked)])


SPANS = "array<struct<kind:string,start:long,`end`:long>>"


def scan_secrets(df: DataFrame, text_col: str = "text", keep=("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``base`` and ``spans`` (arrays of kind, start, end in
    code points; end exclusive).

    Null and empty texts have no spans; a null key stays null; repeated rows are
    scanned each; an empty table gives an empty result; other columns are not
    carried.  Overlapping spans of different kinds are all reported.
    """
    def make():
        def run(texts):
            out = []
            for t in texts:
                base, spans = scan(t)
                out.append(tuple([{"kind": k, "start": s, "end": e} for k, s, e in x] for x in (base, spans)))
            return out
        return run

    return map_texts(df, text_col, list(keep), f"base {SPANS}, spans {SPANS}", make)


def joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


@query("op9_secret_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select("doc_id", *map(count, BASE), F.sha2(joined("base"), 256).alias("base_sha256"),
                      joined("spans").alias("spans"))

"""Secret scans: fixed patterns, and guess costs of the values in credential contexts.

Patterns: assignments to password-like names, access keys, long hex runs.  Beyond these, a value that stands in a
credential context ("pwd is ...", "passphrase: ...") is cut by dynamic programming into the segmentation that an
attacker would guess cheapest: common words by rank (words of prose after them), dates, repeats, keyboard walks and
brute-force spans.  The cost alone decides, for values of letters too: it is the sum of log10 guesses of the spans and of one guess per span for how they are put together; values of
at least MIN_COST are reported as kind `guess` unless a pattern already covers them.

Null texts have no spans.  Positions are code points, ends exclusive.  Repeated rows get a row each.  Texts are
scanned whole; a map without shuffle.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import append_columns
from tabulon.llm.words import text_blocks

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: What stands before a value that deserves a guess cost.
CONTEXT = re.compile(
    r"""(?<![a-z0-9])(?:pass(?:word|wd|code|phrase)?|pwd|secret|token|api[ _-]?key|credentials?|login|auth)["']?"""
    r"""(?:\x20*(?::=|=>|[:=])\x20*|\x20+(?:is|was)\x20+)["'`]?([^\s"'`<>,;()\[\]{}]+)""", re.I | re.A)
_HINTS = ("pass", "pwd", "secret", "token", "api", "credential", "login", "auth")
MIN_COST = 8.0

#: Common words of passwords, most common first (their place is their rank); a parameter of the scan.
COMMON = tuple("""password qwerty abc letmein monkey dragon master login admin welcome hello secret test user root
love sunshine princess football baseball shadow superman batman trustno access flower summer winter spring autumn
monday friday january march april june july august october december pass key token home house computer internet
freedom whatever starwars cheese orange purple silver golden chocolate cookie pepper ginger tiger eagle hunter
killer soccer hockey ranger jordan thomas michael jennifer daniel charlie george london paris america change the
and for you not with this that from have will your default guest public private server system data example""".split())
#: Words of prose that follow "password is", "token:" and the like: ranked after the others, so that a guess of them is cheap.
PROSE = tuple("""required incorrect invalid wrong correct valid needed missing empty expired changed reset set stored sent
saved hidden shown used unused given entered asked prompted requested provided supplied specified included generated created updated
deleted removed replaced revoked refreshed renewed rotated issued accepted rejected denied refused blocked locked unlocked disabled
enabled protected encrypted decrypted hashed salted encoded decoded masked redacted compromised leaked stolen exposed cracked
guessed broken forgotten remembered lost found known unknown printed displayed written typed copied pasted shared passed returned
received transmitted authenticated unauthenticated authorized unauthorized authorised unauthorised verified unverified confirmed
checked validated tested compared matched mismatched successful unsuccessful failed failing failure success successfully
always never often usually sometimes still already only also just now then here there therefore thus hence however because
simply really actually probably possibly perhaps maybe certainly definitely clearly obviously apparently currently recently
previously originally initially finally normally typically generally automatically immediately temporarily permanently securely
properly correctly incorrectly directly easily quickly safely supposed expected intended allowed forbidden permitted
optional mandatory necessary unnecessary important essential critical sensitive confidential secure insecure strong stronger
weak weaker simple complex complicated difficult short shorter long longer enough sufficient insufficient unique random
different similar identical same equal another something anything nothing everything someone anyone everyone nobody
available unavailable visible invisible accessible readable unreadable plain plaintext clear cleartext bad good better best
safe unsafe easy hard impossible possible useless useful obsolete deprecated temporary permanent initial original previous
current active inactive pending ready complete completed incomplete finished started stopped running working
between before after during without within against through about above below under where when while which what whose
being been made done taken kept held left right called named based defined configured installed loaded described
considered recommended suggested assigned associated attached appended added bound tied linked limited restricted
supported unsupported implemented ignored skipped omitted cleared cached logged recorded tracked monitored managed handled
button field fields page screen form prompt dialog window account accounts username username's email address number
string value values name code phrase length character characters letter letters information credential credentials
authentication authorization verification validation encryption protection security management manager service services
provider session sessions database application applications website please contact support administrator""".split())
COMMON += PROSE
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])"
                   r"|(?:0?[1-9]|[12]\d|3[01])[-/.](?:0?[1-9]|1[0-2])[-/.](?:19|20)?\d\d|(?:19|20)\d\d")
#: Fewest and most characters of a date.
DATE_CHARS = (4, 10)
#: One more span to put in place.
SPAN_COST = log10(2)
_LOOKS = str.maketrans("4@310$57!", "aaeiossti")


@lru_cache(maxsize=1)
def _neighbours() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for r, row in enumerate(ROWS):
        for i, c in enumerate(row):
            near.setdefault(c, set())
            for rr, ii in ((r, i - 1), (r, i + 1), (r - 1, i), (r - 1, i + 1), (r + 1, i - 1), (r + 1, i)):
                if 0 <= rr < len(ROWS) and 0 <= ii < len(ROWS[rr]):
                    near[c].add(ROWS[rr][ii])
    return near


def _alphabet(c: str) -> int:
    return 26 if c.isascii() and c.isalpha() else 10 if c.isdigit() else 33 if c.isascii() else 1000


def _walk_way(before: str, c: str) -> int:
    """Rows that a step on the keyboard goes down; a change of it is a turn."""
    return ROWS_AT[c][0] - ROWS_AT[before][0]


def _cheapest(starts: list[tuple[int, float]], j: int) -> float:
    """Least of base + log10(j - i) over the starts (i, base).

    A start that an earlier one undercuts now is dropped: the gap of the logarithms only shrinks as j grows.
    """
    least, kept = float("inf"), []
    for i, base in starts:
        cost = base + log10(j - i)
        if cost < least:
            least = cost
            kept.append((i, base))
    starts[:] = kept
    return least


@lru_cache(maxsize=50_000)
def guess_cost(value: str, words: tuple[str, ...] = COMMON) -> float:
    """log10 of the guesses that the cheapest segmentation of the value takes, over all segmentations."""
    n = len(value)
    rank = _ranks(words)
    longest = max(map(len, rank), default=0)
    low, plain, near = value.lower(), value.lower().translate(_LOOKS), _neighbours()
    if len(low) != n:  # a letter whose lower case is longer
        low = plain = value
    best = [0.0] + [float("inf")] * n
    dates: dict[int, list[int]] = {}
    for m in re.finditer(r"(?=[0-9])", low):
        for end in range(m.start() + DATE_CHARS[0], min(n, m.start() + DATE_CHARS[1]) + 1):
            if _DATE.fullmatch(low, m.start(), end):
                dates.setdefault(end, []).append(m.start())
    brute = [0.0]
    for c in value:
        brute.append(brute[-1] + log10(_alphabet(c)))
    open_brute = 0.0  # least of best[i] - brute[i] over earlier i
    repeat = walk = turns = 1
    way = 0
    repeats: list[tuple[int, float]] = []  # where a repeat or walk that reaches j may start, with its cost but for the length
    walks: list[tuple[int, float]] = []
    for j in range(1, n + 1):
        c, before = low[j - 1], low[j - 2] if j > 1 else ""
        options = [open_brute + brute[j] + SPAN_COST]
        if c == before:
            repeat += 1
        else:
            repeat = 1
            repeats.clear()
        if c in near.get(before, ()):
            last_turns, last_way, way = turns, way, _walk_way(before, c)
            turns = turns + (way != last_way) if walk > 1 else 1
            walk += 1
        else:
            walk = turns = last_turns = 1
            walks.clear()
        if repeat >= 3:
            repeats.append((j - 3, best[j - 3]))
            options.append(_cheapest(repeats, j) + log10(_alphabet(c)) + SPAN_COST)
        if walk >= 3:
            walks.append((j - 3, best[j - 3] - last_turns * log10(4)))
            options.append(_cheapest(walks, j) + log10(47) + (1 + turns) * log10(4) + SPAN_COST)
        for k in range(max(0, j - longest), j - 1):
            r = rank.get(low[k:j])
            extra = 0.0
            if r is None:
                r, extra = rank.get(plain[k:j]), log10(4)
            if r is not None:
                upper = log10(2) if value[k:j] != low[k:j] else 0.0
                options.append(best[k] + log10(r + 1) + extra + upper + SPAN_COST)
        for k in dates.get(j, ()):
            options.append(best[k] + log10(365 * 120 if j - k > 4 else 120) + SPAN_COST)
        best[j] = min(options)
        open_brute = min(open_brute, best[j] - brute[j])
    return best[n] if n else 0.0


ROWS_AT = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}


@lru_cache(maxsize=4)
def _ranks(words: tuple[str, ...]) -> dict[str, int]:
    return {w: i + 1 for i, w in reversed(list(enumerate(words)))}


def find_spans(text: str | None, has_hex: bool = True, min_cost: float = MIN_COST) -> list[tuple[str, int, int, int, float | None]]:
    """(kind, start, end, start of the value, cost) by start, then kind as listed."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                found.append(("assign", m.start(), m.end(), m.start(2), guess_cost(m[2])))
        covered = [(a, b) for _, a, b, _, _ in found]
        for m in CONTEXT.finditer(text):
            a, b = m.span(1)
            value = m[1].rstrip(".:!?")
            b = a + len(value)
            if len(value) >= 6 and not any(x < b and a < y for x, y in covered):
                cost = guess_cost(value)
                if cost >= min_cost:
                    found.append(("guess", a, b, a, cost))
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.start(), None) for m in ACCESS.finditer(text)]
    if has_hex:
        found += [("hex", m.start(), m.end(), m.start(), None) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[np.frombuffer(b"0123456789abcdef", np.uint8)] = True


def _hex_runs(texts: pa.Array) -> np.ndarray:
    """Whether a text's bytes hold 32 hex digits in a row (over a text's end may count too; the pattern decides)."""
    out = np.zeros(len(texts), bool)
    for i, _, data, bounds in text_blocks(texts):
        on = np.concatenate([[False], _HEX_BYTE[data], [False]])
        edge = np.flatnonzero(on[1:] != on[:-1])
        start, end = edge[0::2], edge[1::2]
        long = np.flatnonzero(end - start >= 32)
        for k in long:
            a = np.searchsorted(bounds, start[k], side="right") - 1
            b = np.searchsorted(bounds, end[k] - 1, side="right") - 1
            out[i + a : i + b + 1] = True
    return out


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                     T.StructField("end", T.IntegerType()), T.StructField("value_start", T.IntegerType()),
                     T.StructField("log10_guesses", T.DoubleType())])


def _columns(texts: pa.Array) -> dict:
    hexes = _hex_runs(texts)
    spans = [find_spans(t.as_py(), bool(h)) for t, h in zip(texts, hexes, strict=True)]
    as_text = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b, _, _ in s)
    base = [[x for x in s if x[0] != "guess"] for s in spans]
    return {"secrets": [[dict(zip(SPAN.names, x, strict=True)) for x in s] for s in spans],
            **{f"n_{k}": [sum(x[0] == k for x in s) for s in base] for k in KINDS[:3]},
            "base_sha256": [hashlib.sha256(as_text(s).encode()).hexdigest() for s in base],
            "spans": [as_text(s) for s in spans]}


FIELDS = [T.StructField("secrets", T.ArrayType(SPAN)), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]],
          T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]


def scan_secrets(df: DataFrame, *, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """The rows with the secrets (kind, positions, guess cost) and their counts appended; also the new names."""
    return append_columns(df, text_col, FIELDS, _columns)


def redact(df: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with the value of every secret replaced by `mark`."""

    def run(texts: pa.Array) -> dict:
        out = []
        for t, h in zip(texts, _hex_runs(texts), strict=True):
            t = t.as_py()
            parts, at = [], 0
            for _, _, end, value, _ in sorted(find_spans(t, bool(h)), key=lambda s: s[3]):
                if end > at:
                    if value >= at:
                        parts += [t[at:value], mark]
                    at = end
            out.append(t if not parts else "".join([*parts, t[at:]]))
        return {"clean": out}

    out, names = append_columns(df, text_col, [T.StructField("clean", T.StringType())], run)
    clean = F.col(names["clean"])
    return out.select(*[clean.alias(c) if c == text_col else
                        F.when(clean.eqNullSafe(F.col(text_col)), F.col(f"`{c}`"))
                        .otherwise(F.length(clean).cast(df.schema[c].dataType)).alias(c) if c == "n_chars" else F.col(f"`{c}`")
                        for c in df.columns])


def op8(documents: DataFrame) -> DataFrame:
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    out, _ = scan_secrets(docs)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts (and n_chars with them); every document stays."""
    return redact(docs)

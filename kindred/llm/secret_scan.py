"""Secret scans: three base patterns, and a battery of randomness tests for strings that no pattern names.

A candidate is a run of 20 or more characters of base64's two alphabets; '=' belongs to it as padding at its end only, so a
value is apart from the name before it. Where a run mixes both alphabets or fails the tests below as a whole, as a value in a path
does, its pieces between '/' or '+' and those between '_' or '-' are candidates, if they are long enough. Its encoding is inferred:
the smallest of digits, hexadecimal (either case), letters of one case, base32, letters and digits of one case, letters, letters and
digits, and base64 that holds all its characters. Three tests ask whether its symbols could be drawn at random from
that alphabet: chi-squared for uniformity, runs above and below the alphabet's middle, and lag-1 serial correlation. A candidate
that one of them rejects gets the probability 1.

Passing means little for a short string, so each passing candidate gets the probability that prose or a name of its length would
look as random. The same tests are turned round: prose spreads its symbols unevenly, by which its chi-squared statistic has
a noncentral distribution whose mean grows with the length; it changes between small letters, capitals, digits and signs
more seldom, so its runs of them are fewer; and what follows a character is like it, so its serial correlation is positive. The three
probabilities are joined by Fisher's method, their number counted as two as they aren't independent; where an encoding has
one class of characters, chi-squared stands alone.

These probabilities, of the candidates of all documents, go through Benjamini-Hochberg at FALSE_SHARE: of what it finds no more than
that share is expected to be prose. The cut is found from counts by steps of the probability, a table of bounded size.
What lies below it are spans of kind ``random``. Texts are scanned whole, each in its own row.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import ship, table

#: Kinds in the order in which spans of equal start stand.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: At least 14 characters, as base32 has up to six of padding.
RUN = re.compile(r"[A-Za-z0-9+/_-]{14,}(?:={1,6}(?![A-Za-z0-9+/_=-]))?")
MIN_RUN = 20
#: What a piece of a run holds: base64url's characters, or base64's.
PIECES = (re.compile(r"[A-Za-z0-9_-]+=*"), re.compile(r"[A-Za-z0-9+/]+=*"))
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
MIN_SECRET = 6
#: Level at which one of the three tests rejects randomness, and the share of false finds that is allowed.
REJECT = 0.001
FALSE_SHARE = 0.01
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings and their alphabets, smallest first.
ENCODINGS = {
    "digits": DIGITS,
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "lower": LOWER,
    "upper": UPPER,
    "base32": UPPER + "234567",
    "lower36": DIGITS + LOWER,
    "upper36": DIGITS + UPPER,
    "letters": UPPER + LOWER,
    "base62": DIGITS + UPPER + LOWER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}
_SETS = {k: frozenset(v) for k, v in ENCODINGS.items()}
_PLACE = {k: {c: i for i, c in enumerate(v)} for k, v in ENCODINGS.items()}
#: Chance that two symbols of prose are the same: of its letters, of its letters a to f and digits, and of the digits of numbers.
PROSE_SAME = {"hex": 0.26, "HEX": 0.26, "digits": 0.2}
PROSE_SAME_LETTERS = 0.0655
#: How often prose or a name goes from one class of characters to another, and how like its neighbours' places its symbols' are, by
#: encoding; one of one class has neither.
PROSE_CHANGES = {"hex": 0.15, "HEX": 0.15, "base32": 0.1, "lower36": 0.1, "upper36": 0.1, "letters": 0.3, "base62": 0.3, "base64": 0.3, "base64url": 0.3}
PROSE_SERIAL = 0.3
#: Steps of the probability by which candidates are counted, each a factor of 10^(1/STEPS); below 10^-LEAST all count alike.
STEPS, LEAST = 64, 40


def encoding(s: str) -> str | None:
    """The smallest encoding that holds ``s`` without its padding; None if it mixes base64's two."""
    seen = set(s.rstrip("="))
    return next((k for k, v in _SETS.items() if seen <= v), None)


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _serial(v: list[int]) -> float:
    """Lag-1 serial correlation, plus its expectation for random symbols; 1 if all are the same."""
    n, mid = len(v), sum(v) / len(v)
    spread = sum((x - mid) ** 2 for x in v)
    return sum((x - mid) * (y - mid) for x, y in zip(v, v[1:], strict=False)) / spread + 1 / n if spread else 1.0


def battery(s: str, kind: str) -> tuple[float, float, float, float, float]:
    """P-values of chi-squared uniformity, runs and serial correlation, the chi-squared statistic, and the correlation."""
    s = s.rstrip("=")
    place, k, n = _PLACE[kind], len(ENCODINGS[kind]), len(s)
    v = [place[c] for c in s]
    chi = sum(c * c for c in Counter(v).values()) * k / n - n
    # Wilson-Hilferty, by which few symbols in a large alphabet are judged fairly enough
    d = k - 1
    p_chi = _tail(((max(chi, 1e-9) / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)))
    high = [x >= k / 2 for x in v]
    a = sum(high)
    b = n - a
    if a and b:
        runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / max(1, n - 1)
        p_runs = 2 * _tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    serial = _serial(v)
    return p_chi, p_runs, 2 * _tail(abs(serial) * math.sqrt(n)), chi, serial


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def prose_p(s: str, kind: str, chi: float, serial: float) -> float:
    """Probability that prose or a name of the length of ``s`` looks as random (normal approximations of the three laws)."""
    k, n = len(ENCODINGS[kind]), len(s)
    d, shift = k - 1, n * (k * PROSE_SAME.get(kind, PROSE_SAME_LETTERS) - 1)
    p_chi = _tail((d + shift - chi) / math.sqrt(2 * (d + 2 * shift)))
    rate = PROSE_CHANGES.get(kind)
    if rate is None:
        return p_chi
    classes = [_class(c) for c in s]
    changes = sum(x != y for x, y in zip(classes, classes[1:], strict=False))
    p_runs = _tail((changes - 0.5 - rate * (n - 1)) / math.sqrt(rate * (1 - rate) * (n - 1)))
    p_serial = _tail((PROSE_SERIAL - serial) * math.sqrt(n))
    # Fisher's statistic of three, scaled to two: chi-squared of four degrees of freedom
    half = -(math.log(max(p_chi, 1e-300)) + math.log(max(p_runs, 1e-300)) + math.log(max(p_serial, 1e-300))) * 2 / 3
    return math.exp(-half) * (1 + half)


def tested(start: int, s: str) -> tuple[float, int, int] | None:
    """(probability of prose, start, end) of a candidate, 1 if the battery rejects it; None if it is in no encoding."""
    kind = encoding(s)
    if kind is None:
        return None
    *ps, chi, serial = battery(s, kind)
    return (prose_p(s.rstrip("="), kind, chi, serial) if min(ps) >= REJECT else 1.0), start, start + len(s)


def candidates(runs: list[tuple[int, str]]) -> list[tuple[float, int, int]]:
    """(probability, start, end) of the candidates in the runs (start, string) of one document."""
    found: list[tuple[float, int, int]] = []
    for start, s in runs:
        whole = tested(start, s)
        if whole is not None:
            found.append(whole)
        if whole is None or whole[0] == 1.0:
            pieces = {(start + m.start(), m[0]) for p in PIECES for m in p.finditer(s) if MIN_RUN <= len(m[0]) < len(s)}
            found += [t for at, x in sorted(pieces) if (t := tested(at, x)) is not None]
    return found


def step(p: float) -> int:
    """The step of a probability: those of one step lie within a factor of 10^(1/STEPS), and the least in the highest."""
    return min(LEAST * STEPS, math.floor(-math.log10(max(p, 1e-300)) * STEPS))


def cut(counts: dict[int, int]) -> int:
    """The lowest step that Benjamini-Hochberg finds, from the candidates counted by step; judged by each step's greatest probability."""
    total, above, best = sum(counts.values()), 0, LEAST * STEPS + 1
    for k in sorted(counts, reverse=True):
        above += counts[k]
        if 10 ** (-k / STEPS) <= FALSE_SHARE * above / total:
            best = k
    return best


def random_spans(found: list[tuple[float, int, int]], lowest: int) -> list[tuple[int, int]]:
    """The candidates of one document at the step ``lowest`` or above; overlapping ones are joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for p, a, b in found if step(p) >= lowest):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[float, int, int]]]:
    """(start, kind's place in KINDS, end) of every base span of a text, in order (code points, end exclusive); and its candidates."""
    out = []
    low = text.lower() if text.isascii() else text.translate(_LOWER)
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_SECRET]
    # both other patterns match inside runs only, as their characters are a run's and their matches longer than the least run
    runs = [(m.start(), m[0]) for m in RUN.finditer(text) if len(m[0]) >= MIN_RUN]
    for at, s in runs:
        out += [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(s)]
        out += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(s)]
    return sorted(out), candidates(runs) if runs else []


def all_spans(base: list[tuple[int, int, int]], found: list[tuple[float, int, int]], lowest: int) -> list[tuple[int, int, int]]:
    return sorted([*base, *((a, KINDS.index("random"), b) for a, b in random_spans(found, lowest))]) if found else base


_LOWER = {c: c + 32 for c in range(65, 91)}


SCANNED = "base array<struct<a:int,k:int,b:int>>, found array<struct<p:double,a:int,b:int>>"


def _scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (doc_id, text) -> their spans and candidates."""
    for b in batches:
        yield pd.DataFrame([(i, *scan(text or "")) for i, text in zip(b["doc_id"], b["text"], strict=True)], columns=["doc_id", "base", "found"])


def _counted(found: Iterator[list[float]]) -> pd.DataFrame:
    n = Counter(step(p) for ps in found for p in ps)
    return pd.DataFrame({"step": pd.Series(list(n), dtype="int32"), "n": pd.Series(list(n.values()), dtype="int64")})


def _steps_of_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts -> their candidates counted by step, in one worker: two one after another in a task would each take memory."""
    for b in batches:
        yield _counted([p for p, *_ in scan(text or "")[1]] for text in b["text"])


def _steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield _counted([f["p"] for f in found] for found in b["found"])


def corpus_cut(counts: DataFrame) -> int:
    """The lowest step that Benjamini-Hochberg finds, from (step, n) of all candidates; LEAST * STEPS + 1 sums at most come to the driver."""
    return cut({r["step"]: r["n"] for r in counts.groupBy("step").agg(F.sum("n").alias("n")).collect()})


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _told(lowest: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, base, found in zip(b["doc_id"], b["base"], b["found"], strict=True):
                base, found = [tuple(x.values()) for x in base], [tuple(x.values()) for x in found]
                n = Counter(s[1] for s in base)
                rows.append((i, n[0], n[1], n[2], hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(all_spans(base, found, lowest))))
            yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]).astype({c: "int64" for c in ("n_assign", "n_access", "n_hex")})

    return run


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row.

    Null and empty texts have no spans. Repeated rows give repeated results and count as often in the false-discovery control, other
    columns are not read, and an empty table gives none. Texts are scanned once; spans and candidates are written.
    """
    ship(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    scanned = table(rows.mapInPandas(_scanned, f"doc_id {kind}, {SCANNED}"), "scanned")
    lowest = corpus_cut(scanned.select("found").mapInPandas(_steps, "step int, n bigint"))
    return scanned.mapInPandas(_told(lowest), f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact(text: str | None, lowest: int, mark: str = "[secret]") -> str | None:
    """``text`` with every span, overlapping ones joined, replaced by ``mark``."""
    if not text:
        return text
    out, done = [], 0
    spans = all_spans(*scan(text), lowest)
    if not spans:
        return text
    merged: list[list[int]] = []
    for a, _, b in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[done:a], mark]
        done = b
    return "".join([*out, text[done:]])


def without_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its secrets replaced, same columns; n_chars, if there is one, is brought up to date.

    Texts are scanned twice, as what counts as random is known only once all candidates are: first for the candidates.
    """
    ship(docs.sparkSession)
    lowest = corpus_cut(docs.select(F.col(f"`{text}`").alias("text")).mapInPandas(_steps_of_texts, "step int, n bigint"))

    @F.pandas_udf("string")
    def clean(s: pd.Series) -> pd.Series:
        return s.map(lambda t: redact(t, lowest))

    d = docs.withColumn(text, clean(F.col(f"`{text}`")))
    return d.withColumn("n_chars", F.coalesce(F.char_length(F.col(f"`{text}`")).cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else d

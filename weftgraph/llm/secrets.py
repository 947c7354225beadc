"""Secret scans: base patterns, and password guess-cost dynamic programming on credential-context values.

Values that follow a credential word are cut, at minimum cost, into dictionary words, dates, repeats, keyboard walks and
brute-force spans; the cost is log10 of the guesses.  A value whose cheapest cut costs at least `threshold` is a secret,
so that "password = changeme2024" is none and a random string is one.  The dictionary is the list below and, behind it,
the DICTIONARY words that most texts of the table hold, in that order: an ordinary word costs its rank.

The cost takes time in proportion to a value's length.  Units of repeats have UNIT characters at most: a longer one costs
more than 10 ** UNIT guesses by itself, which is above the threshold.

Cases: null text is empty and has no spans; spans are in code points, end exclusive; a value that a base `assign` span
already holds adds no span of its own; rows are independent, so repeated rows repeat; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import rows_per_batch

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth(?:orization)?|bearer)["']?[ \t]*(=>|[:=]|\bis\b)[ \t]*["']?([!-&(-~]{6,})""",
    re.I | re.A,
)
CUES = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer")
THRESHOLD = 9.0
#: Words that the table adds to the dictionary, at most; texts that must hold them; characters of a repeat's unit.
DICTIONARY, TEXTS, UNIT = 20_000, 20, 16
#: Common passwords and placeholder words, commonest first; the rank is the guess count.  A parameter of guess_cost.
WORDS = (
    "password 123456 qwerty admin letmein welcome monkey dragon master login secret token key user root test guest "
    "default changeme example sample demo temp public private access account iloveyou sunshine princess football "
    "baseball shadow superman batman trustno michael jordan hunter killer pepper ginger summer winter spring autumn "
    "monday friday january october november december love hello world freedom whatever starwars cheese computer "
    "internet server data base home office company manager system service null none true false value string your here "
    "the and for with from this that have not are was you all can had her one our out day get has him his how man new "
    "now old see two way who boy did its let put say she too use black white blue green red orange silver gold"
).split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
LEET = str.maketrans("@4301!$57+", "aaeoiissTt".lower())
WALKS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "1qaz2wsx3edc4rfv5tgb6yhn7ujm")
DATE = re.compile(r"(?:19|20)\d\d(?:([-/._]?)\d{1,2}\1\d{1,2})?|\d{1,2}([-/._])\d{1,2}\2(?:\d\d){1,2}")
LONGEST = 24


def _classes(c: str) -> int:
    return 26 if c.islower() or c.isupper() else 10 if c.isdigit() else 33


def _walks(low: str) -> list[int]:
    """For each start, the length of the keyboard walk from there (0 below 3)."""
    out, n = [0] * len(low), len(low)
    for row in WALKS:
        for keys in (row, row[::-1]):
            follows = dict(zip(keys, keys[1:]))
            i = 0
            while i < n - 2:
                j = i
                while j + 1 < n and follows.get(low[j]) == low[j + 1]:
                    j += 1
                for k in range(i, j - 1):
                    out[k] = max(out[k], j - k + 1)
                i = j + 1 if j > i else i + 1
    return out


def corpus_rank(docs: DataFrame, size: int = DICTIONARY, texts: int = TEXTS) -> dict[str, int]:
    """Guesses of the list's words and, behind them, of the `size` words of 3 to 24 letters that most texts hold.  The
    bound is a parameter; ties go by the word."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![a-z])[a-z]{3,24}(?![a-z])"), F.lit(0)))
    counted = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= texts)
    rank = dict(RANK)
    for r in counted.orderBy(F.desc("n"), "word").limit(size).collect():
        rank.setdefault(r.word, len(rank) + 1)
    return rank


def _matches(value: str, unit: int) -> list[int]:
    """For each start, how many characters agree with those `unit` places on."""
    out = [0] * (len(value) + 1)
    for i in range(len(value) - unit - 1, -1, -1):
        if value[i] == value[i + unit]:
            out[i] = out[i + 1] + 1
    return out


def guess_cost(value: str, rank: dict[str, int] = RANK, longest: int | None = None) -> tuple[float, list[tuple[int, int, str]]]:
    """log10 of the guesses of the cheapest segmentation, and its segments (start, end, kind)."""
    n, low = len(value), value.lower()
    longest = longest or max(map(len, rank), default=0)
    plain, walks = low.translate(LEET), _walks(low)
    repeats = [(unit, _matches(value, unit)) for unit in range(1, min(UNIT, n // 2) + 1)]
    brute = [0.0]
    for c in value:
        brute.append(brute[-1] + math.log10(_classes(c)))
    best, came = [0.0] + [math.inf] * n, [None] * (n + 1)

    def offer(i: int, j: int, cost: float, kind: str) -> None:
        if best[i] + cost < best[j] - 1e-12:
            best[j], came[j] = best[i] + cost, (i, kind)

    for i in range(n):
        offer(i, i + 1, brute[i + 1] - brute[i], "brute")
        for j in range(i + 3, min(n, i + longest) + 1):
            for form, extra in ((low, 0.0), (plain, 0.3)):
                if r := rank.get(form[i:j]):
                    offer(i, j, math.log10(r + 1) + extra + 0.3 * (value[i:j] != low[i:j]) + 0.3, "word")
                    break
        if value[i].isdigit() and (m := DATE.match(value, i)):
            offer(i, m.end(), 2.1 if m.end() - i == 4 else 4.6, "date")
        for j in range(i + 3, i + walks[i] + 1):
            offer(i, j, math.log10(47 * 2 * (j - i)), "walk")
        for unit, same in repeats:
            if same[i] >= unit:
                times = 1 + same[i] // unit
                offer(i, i + times * unit, brute[i + unit] - brute[i] + math.log10(times), "repeat")
    segments, j = [], n
    while j:
        i, kind = came[j]
        segments.append((i, j, kind))
        j = i
    return best[n], segments[::-1]


_IS_HEX = bytes(104 if c in b"0123456789abcdef" else 32 for c in range(256))


def find_secrets(text: str, threshold: float = THRESHOLD, rank: dict[str, int] = RANK) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], float]:
    """Base spans (start, kind, end), all spans, and the highest log10 of guesses among credential-context values."""
    low, found, most = text.lower(), [], 0.0
    cued = any(c in low for c in CUES)
    if cued:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"h" * 32 in text.encode().translate(_IS_HEX):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    every = found
    if cued:
        more, assigned = [], [(s, e) for s, k, e in found if k == 0]
        for m in CONTEXT.finditer(text):
            value, (a, b) = m[2].rstrip("\"',.;)]}>"), (m.start(2), m.end(2))
            b = a + len(value)
            if len(value) < 6:
                continue
            cost, _ = guess_cost(value, rank, LONGEST)
            most = max(most, cost)
            if cost >= threshold and not any(s <= a and b <= e for s, e in assigned):
                more.append((a, 3, b))
        every = sorted(found + more)
    return found, every, most


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def op2_secret_scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    rows_per_batch(docs.sparkSession, 2000)
    rank = docs.sparkSession.sparkContext.broadcast(corpus_rank(docs))
    schema = (
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, "
        "max_log10_guesses double"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                base, every, most = find_secrets(text or "", threshold, rank.value)
                n = [sum(k == x for _, k, _ in every) for x in range(4)]
                digest = hashlib.sha256(_joined(base).encode()).hexdigest() if base else none
                rows.append((doc_id, n[0], n[1], n[2], digest, _joined(every), n[3], most))
            names = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "max_log10_guesses")
            kinds = (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.int64(), pa.float64())
            columns = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, schema)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    out, at = [], 0
    for start, _, end in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The same rows and columns; secrets in text are replaced by a mark."""
    rows_per_batch(docs.sparkSession, 2000)
    rank = docs.sparkSession.sparkContext.broadcast(corpus_rank(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("text")
            texts = [t and redact(t, find_secrets(t, threshold, rank.value)[1]) for t in batch.column(i).to_pylist()]
            yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)

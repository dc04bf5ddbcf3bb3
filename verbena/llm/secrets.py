"""Secret scan with a guess-cost model for values in a credential context.

Fixed patterns find assignments, access keys and hex digests. Where a credential word is
followed by a value, the number of guesses a password cracker needs for that value is
estimated by dynamic programming: the cheapest segmentation into dictionary words (also
reversed, with capitals or look-alikes), dates, repeats, keyboard walks and brute-force spans.
Values that stand up to guessing are added as spans of kind ``guess``.

The dictionary is a short list of common passwords and, behind it, the most frequent words of
letters in the corpus itself, counted over all texts.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbena.llm._common import LOWER, discard, doc_chunks, materialise, small_batches, split_words, text_buffers, tidied

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "guess")

#: Credential context: a name with a credential word in it (short ones as a part of their own), up to a few filler words, then a value.
CONTEXT = re.compile(
    r"""(?<![\w-])(?=(?:[\w-]*?[\d_-])?(?:pwd|pass|pin|token|login)(?![a-z])"""
    r"""|[\w-]*?(?:password|passwd|passphrase|passcode|secret(?:[_-]?key)?|credentials?|(?:api|auth|access|private)[_-]?key)(?![a-z]))[\w-]++"""
    r"""["']?(?:\x20*[:=]\x20*|\x20+(?:is|was|to|as)\x20+)["']?([^\s"'<>,;]{4,})""",
    re.I | re.A,
)
#: What every context has in its name; names are looked at only where this occurs.
HINT = re.compile("pwd|pass|pin|token|login|secret|credential|key", re.I | re.A)
NAME = re.compile(r"[\w-]+", re.A)
#: A value that takes fewer than 10**GUESS_LEAST guesses is a placeholder or a word, not a secret.
GUESS_LEAST = 8.0

#: Words of the corpus in the dictionary (the driver and every task hold them), and their letters.
DICTIONARY = 20_000
LETTERS = (3, 15)

# Common passwords and words, by rank; keyboard rows and keypad.
WORDS = (
    "password 123456 12345678 qwerty abc123 letmein monkey dragon master admin login welcome secret token test user guest root pass "
    "shadow sunshine princess football baseball iloveyou trustno1 superman batman hello freedom whatever michael jordan hunter "
    "killer summer winter spring autumn monday friday january april august october december example sample changeme default "
    "placeholder your key value string null none true false here the and for with this that from have not you are was all can "
    "love life time people world house money water light black white green orange purple apple banana computer internet server "
    "database system access private public account google amazon"
).split()
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")

KEYPAD = ("789", "456", "123")

RANK = {w: i + 1 for i, w in reversed(list(enumerate(WORDS)))}


def next_keys(rows: tuple[str, ...], steps: tuple[tuple[int, int], ...]) -> dict[tuple[str, str], int]:
    """Pairs of keys side by side with the number of the step that leads from one to the other."""
    out = {}
    for r, row in enumerate(rows):
        for k, key in enumerate(row):
            for number, (dr, dk) in enumerate(steps):
                if 0 <= r + dr < len(rows) and 0 <= k + dk < len(rows[r + dr]):
                    out[key, rows[r + dr][k + dk]] = number
    return out


#: Every row stands half a key to the right of the one above; the keypad is a grid. Steps on the
#: keypad have numbers of their own.
NEXT_KEY = next_keys(ROWS, ((0, 1), (0, -1), (1, 0), (-1, 0), (1, -1), (-1, 1)))
NEXT_KEY = {k: n + 10 for k, n in next_keys(KEYPAD, ((0, 1), (0, -1), (1, 0), (-1, 0), (1, 1), (-1, -1), (1, -1), (-1, 1))).items()} | NEXT_KEY
LEET = str.maketrans("4301$@57!", "aeolsasti")
#: In a longer run or walk, pieces of middle lengths are never cheapest: only those this near to either end are tried.
NEAR = 32
DATE = re.compile(r"(?:(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d)")
LOG = math.log10


def alphabet(value: str) -> int:
    """Size of the smallest usual alphabet that holds all characters."""
    size = 10 * any(c.isdigit() for c in value) + 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value)
    return max(10, size + 33 * any(not c.isalnum() for c in value))


def lengths(j: int, end: int):
    """Ends of the pieces of a run or walk [j, end) that are tried: all, or those near its ends."""
    if end - j <= 2 * NEAR:
        return range(j + 3, end + 1)
    return (*range(j + 3, j + NEAR + 1), *range(end - NEAR + 1, end + 1))


def turns(low: str) -> list[int]:
    """Changes of direction of the walk from the first character to each one."""
    out, before = [0] * len(low), None
    for i in range(1, len(low)):
        step = NEXT_KEY.get((low[i - 1], low[i]))
        out[i] = out[i - 1] + (before is not None and step is not None and step != before)
        before = step
    return out


def guess_cost(value: str, ranks: dict[str, int] = RANK) -> tuple[float, str]:
    """(log10 of the guesses, segmentation) of the cheapest way to build ``value``.

    Two costs are kept of the first i characters: of the cheapest way that ends in a brute-force
    span, which can go on at no extra price, and of the cheapest that ends otherwise. An edge from
    j to i costs what a cracker pays for that piece: the rank of a word (twice with capitals or
    reversed, four times with look-alikes), the days of the dates, start and length of a repeat,
    start, length and turns of a keyboard walk, or the alphabet to the power of the length. Every
    extra piece adds the factor of its order.
    """
    n = len(value)
    low = "".join(x if len(x) == 1 else c for c in value for x in (c.lower(),))
    plain = low.translate(LEET)
    brute = LOG(alphabet(value))
    # by the last piece: brute force, or another; the start counts as another
    best = ([math.inf] * (n + 1), [0.0] + [math.inf] * n)
    back: tuple[list, list] = ([None] * (n + 1), [None] * (n + 1))

    def offer(j: int, i: int, cost: float, kind: str) -> None:
        last = int(best[1][j] <= best[0][j])
        total = best[last][j] + cost + (0.3 if j else 0.0)
        if total < best[1][i] - 1e-12:
            best[1][i], back[1][i] = total, (j, kind, last)

    dates: dict[int, list[int]] = {}
    for m in (DATE.match(value, k) for k in range(n)):
        if m:
            dates.setdefault(m.start(), []).append(m.end())
    # where the run, the walk and the repeats of each period that begin at a place end
    run, walk, turned = [*range(1, n + 1)], [*range(1, n + 1)], turns(low)
    for i in range(n - 2, -1, -1):
        run[i] = run[i + 1] if low[i] == low[i + 1] else i + 1
        walk[i] = walk[i + 1] if (low[i], low[i + 1]) in NEXT_KEY else i + 1
    again = {}
    for period in (2, 3, 4):
        again[period] = [min(i + period, n) for i in range(n)]
        for i in range(n - period - 1, -1, -1):
            if low[i] == low[i + period]:
                again[period][i] = again[period][i + 1]
    for j in range(n):
        # a brute-force span is priced by the character; to go on with it costs nothing more
        on, new = best[0][j], best[1][j] + (0.3 if j else 0.0)
        best[0][j + 1], back[0][j + 1] = min(on, new) + brute, (j, "brute", int(new < on))
        for i in range(j + 2, min(n, j + LETTERS[1]) + 1):
            for text, extra in ((low[j:i], 0.0), (low[j:i][::-1], LOG(2)), (plain[j:i], LOG(4))):
                rank = ranks.get(text)
                if rank is not None:
                    offer(j, i, LOG(rank + 1) + extra + (LOG(2) if value[j:i] != low[j:i] else 0.0), "word")
        for i in dates.get(j, ()):
            offer(j, i, LOG(365 * 130) if i - j > 4 else LOG(130), "date")
        if run[j] - j >= 3:
            one = LOG(alphabet(value[j]))
            for i in lengths(j, run[j]):
                offer(j, i, one + LOG(i - j), "repeat")
        for i in lengths(j, walk[j]):
            # the step into a walk's second key is no turn
            offer(j, i, LOG(47) + LOG(i - j) + LOG(2) + LOG(5) * (turned[i - 1] - turned[j + 1]), "walk")
        for period in (2, 3, 4):
            i = again[period][j]
            if i - j >= 2 * period:
                offer(j, i, period * brute + LOG((i - j) / period), "repeat")
    pieces, i, last = [], n, int(best[1][n] <= best[0][n])
    cost = best[last][n]
    while i:
        j, kind, last = back[last][i]
        pieces.append((kind, i - j))
        i = j
    merged: list[list] = []
    for kind, piece in reversed(pieces):
        if merged and kind == merged[-1][0] == "brute":
            merged[-1][1] += piece
        else:
            merged.append([kind, piece])
    return cost, "+".join(f"{k}:{p}" for k, p in merged)


def contexts(text: str):
    """The matches of CONTEXT, leftmost and non-overlapping, found through the names with a hint."""
    done = 0
    for hint in HINT.finditer(text):
        start = hint.start()
        if start < done:
            continue
        while start > done and NAME.match(text, start - 1):
            start -= 1
        match = CONTEXT.match(text, start)
        done = match.end() if match else NAME.match(text, start).end()
        if match:
            yield match


def scan(text: str | None, ranks: dict[str, int] = RANK) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, float, str]]]:
    """(base spans, guess-cost spans) of one text: start, end and kind or cost and segmentation."""
    if not text:
        return [], []
    base = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    base.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    guessed = []
    for m in contexts(text):
        value = m[1].rstrip(".!?:)]}")
        cost, pieces = guess_cost(value, ranks)
        if cost >= GUESS_LEAST:
            guessed.append((m.start(1), m.start(1) + len(value), cost, pieces))
    return base, guessed


SCAN_SCHEMA = "doc_id bigint, base array<struct<start:int,end:int,kind:string>>, guess array<struct<start:int,end:int,cost:double,pieces:string>>"
_BASE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
_GUESS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.float64()), ("pieces", pa.string())]))


#: Bytes of words of letters.
_ALPHA = np.zeros(256, bool)
_ALPHA[97:123] = True
CHUNK_BYTES = 2 << 20
#: Distinct words that a task counts before it hands them on.
FLUSH = 300_000


def count_letters(batches):
    """(word, count) of the words of letters that a task reads."""
    held: dict[bytes, int] = {}
    for batch in batches:
        data, offsets = text_buffers(batch.column(0))
        for i, j in doc_chunks(offsets, CHUNK_BYTES):
            part = offsets[i : j + 1]
            raw = LOWER[data[part[0] : part[-1]]]
            _, starts, ends, words = split_words(raw, part - part[0], _ALPHA)
            fits = (ends - starts >= LETTERS[0]) & (ends - starts <= LETTERS[1])
            starts, ends = starts[fits], ends[fits]
            _, first, counts = np.unique(words[fits], return_index=True, return_counts=True)
            text = raw.tobytes()
            for s, e, c in zip(starts[first].tolist(), ends[first].tolist(), counts.tolist(), strict=True):
                word = text[s:e]
                held[word] = held.get(word, 0) + c
            if len(held) > FLUSH:
                yield letter_rows(held)
                held = {}
    yield letter_rows(held)


def letter_rows(held: dict[bytes, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])


def corpus_ranks(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> dict[str, int]:
    """The dictionary: the fixed words by rank, then about the ``size`` most frequent words of
    letters in all texts: those above a step of a logarithmic scale of the counts, found from the
    number of words at each step (so tasks send on only what is kept), and of the step in which
    the bound lies a share by hash. A word counts in every text, so that a secret of letters
    alone that is copied very often would become one; words with digits or marks never do."""
    texts = small_batches(docs).select(F.col(text_col).cast("string").alias("text"))
    counts = materialise(texts.mapInArrow(tidied(count_letters), "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c")), "letters")
    step = F.floor(F.log2("c") * 16).cast("int")
    steps = {r["step"]: r["n"] for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()}
    total, least, share = 0, 0, 1.0
    for s in sorted(steps, reverse=True):
        least = s
        if total + steps[s] > size:
            share = (size - total) / steps[s]
            break
        total += steps[s]
    cut = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20))
    ranks = dict(RANK)
    for row in sorted(counts.where((step > least) | ((step == least) & cut)).collect(), key=lambda r: (-r["c"], r["word"])):
        ranks.setdefault(row["word"], len(ranks) + 1)
    discard(counts)
    return ranks


def scanner(shared):
    def scan_batches(batches):
        ranks = shared.value
        for batch in batches:
            base, guess = [], []
            for text in batch.column(1):
                b, g = scan(text.as_py(), ranks)
                base.append([{"start": s, "end": e, "kind": k} for s, e, k in b])
                guess.append([{"start": s, "end": e, "cost": c, "pieces": p} for s, e, c, p in g])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, _BASE), pa.array(guess, _GUESS)], names=["doc_id", "base", "guess"])

    return scan_batches


def read_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return small_batches(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All spans of every whole text: base spans and guess-cost spans (code points, end
    exclusive). Null and empty texts have none; each row is scanned by itself, so order,
    repeats and skew of rows do not matter; other columns are ignored. A value is priced and
    covered to its end, however long it is."""
    shared = docs.sparkSession.sparkContext.broadcast(corpus_ranks(docs, text_col))
    return read_texts(docs, id_col, text_col).mapInArrow(tidied(scanner(shared)), SCAN_SCHEMA)


def digest_batches(batches):
    for batch in batches:
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "max_cost")}
        for base, guess in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            kinds = [x["kind"] for x in base]
            for k in KINDS[:3]:
                out[f"n_{k}"].append(kinds.count(k))
            found = [(x["start"], KINDS.index(x["kind"]), x["end"]) for x in base]
            shown = lambda rows: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(rows))
            out["base_sha256"].append(hashlib.sha256(shown(found).encode()).hexdigest())
            out["spans"].append(shown(found + [(x["start"], 3, x["end"]) for x in guess]))
            out["n_guess"].append(len(guess))
            out["max_cost"].append(max((x["cost"] for x in guess), default=None))
        types = {"base_sha256": pa.string(), "spans": pa.string(), "max_cost": pa.float64()}
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, types.get(k, pa.int64())) for k, v in out.items())], names=["doc_id", *out])


DIGEST_SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_guess bigint, max_cost double"


def secret_digest(docs: DataFrame) -> DataFrame:
    """``find_secrets`` as counts and digests, a row for each document."""
    scanned = scanner(docs.sparkSession.sparkContext.broadcast(corpus_ranks(docs)))
    return read_texts(docs).mapInArrow(tidied(lambda batches: digest_batches(scanned(batches))), DIGEST_SCHEMA)


def redacted(text: str, spans: list[tuple[int, int]]) -> str:
    kept, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            kept += [text[at:s], "[REDACTED]"]
        at = max(at, e)
    return "".join(kept) + text[at:]


def redactor(shared):
    def redact(batches):
        ranks = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, text in enumerate(texts):
                base, guess = scan(text, ranks)
                if base or guess:
                    texts[i] = redacted(text, [x[:2] for x in base] + [x[:2] for x in guess])
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return redact


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every span found replaced by ``[REDACTED]``; overlapping spans become
    one. All rows and columns stay, null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(corpus_ranks(docs))
    return small_batches(docs).mapInArrow(tidied(redactor(shared)), docs.schema)

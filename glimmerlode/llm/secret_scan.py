"""Secret scans: fixed patterns plus character Markov models. DataFrame functions only.

Two first-order Markov models over characters are trained from labelled samples: seeded random strings of several
alphabets, and ordinary identifiers joined from common words and from pronounceable syllables. A candidate token's score
is the mean of its transitions' log-likelihood ratios; tokens of THRESHOLD or more are added as `markov` spans. The ratio
table is one literal array, read by index for each pair of neighbouring characters, so scoring stays in the engine and
takes time in proportion to the token.

Offsets come from splitting and extracting with the same pattern: pieces and matches alternate, and running sums of
their lengths are the code-point positions. Defined cases: null or empty text has no spans and the hash of the empty
string; very long texts and tokens are scanned whole; rows that repeat are scanned alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed patterns of the base kinds, in their order.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
THRESHOLD = 0.3
SCALE = 1000
WORDS = "the and for user name value index count table file path list item data node tree hash map key config server client request response time start stop open close read write get set add remove update create delete find search print format parse load save send receive buffer stream string number object class method function variable module package import export test check error warning message state event handler thread process memory cache queue stack array matrix vector image color width height size length offset position account order price customer report summary total average network service session window button label field form page link image title content document section paragraph letter".split()


ONSETS = "b c d f g h j k l m n p r s t v w z st tr pr gr sch th ch br cl str qu".split()
VOWELS = "a e i o u a e i o e ie ei ou ai au ea io".split()
CODAS = ["", "", "", "n", "r", "s", "t", "ng", "l", "nd", "st", "m", "ll"]
#: Alphabets of random strings: letters of either or one case, with digits, and with the marks of encodings.
ALPHABETS = (ALPHABET[:62], ALPHABET[:64], ALPHABET, ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], ALPHABET[:52], ALPHABET[:26], ALPHABET[26:52])


def ordinary(rng: random.Random) -> str:
    """A name as programs and texts have it."""
    made = lambda: "".join(rng.choice(ONSETS) + rng.choice(VOWELS) + rng.choice(CODAS) for _ in range(rng.randint(1, 4)))
    words = [rng.choice(WORDS) if rng.random() < 0.5 else made() for _ in range(rng.randint(2, 6))]
    if rng.random() < 0.3:
        words.append(str(rng.randint(0, 2030)))
    style = rng.randrange(6)
    return ("_", "-", "/", "", "_", "")[style].join(w.upper() if style == 4 else w.capitalize() if style == 3 else w for w in words)


def samples(n: int = 8000, seed: int = 11) -> list[tuple[str, int]]:
    """Labelled samples: 1 for a random string, 0 for an ordinary identifier."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        kind = rng.choice(ALPHABETS)
        out.append(("".join(rng.choice(kind) for _ in range(rng.randint(20, 44))), 1))
        out.append((ordinary(rng), 0))
    return out


def train(labelled: list[tuple[str, int]]) -> list[int]:
    """Log-likelihood ratios of all transitions in units of 1 / SCALE, row by row of the alphabet."""
    n = len(ALPHABET)
    at = {c: i for i, c in enumerate(ALPHABET)}
    counts = [[[0.5] * n for _ in range(n)] for _ in range(2)]
    for text, label in labelled:
        for a, b in zip(text, text[1:], strict=False):
            counts[label][at[a]][at[b]] += 1
    sums = [[sum(row) for row in side] for side in counts]
    ratio = lambda a, b: math.log(counts[1][a][b] / sums[1][a]) - math.log(counts[0][a][b] / sums[0][a])
    return [round(SCALE * ratio(a, b)) for a in range(n) for b in range(n)]


def _spans(text: Column, pattern: str, kind: int, size: Column | None = None, group: int = 0, least: int = 0) -> Column:
    """Array of (start, kind, end) of the pattern's leftmost matches whose group has `least` characters."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    pieces = F.split(text, pattern, -1)
    rows = F.zip_with(F.slice(pieces, 1, F.size(found)), F.zip_with(found, parts, lambda f, p: F.struct(F.char_length(f).alias("n"), F.char_length(p).alias("p"))), lambda gap, m: F.struct(F.char_length(gap).alias("gap"), m["n"].alias("n"), m["p"].alias("p")))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("spans"))
    add = lambda acc, m: F.struct(
        (acc["at"] + m["gap"] + m["n"]).alias("at"),
        F.when(m["p"] >= least, F.concat(acc["spans"], F.array(F.struct((acc["at"] + m["gap"]).alias("start"), F.lit(kind).alias("kind"), (acc["at"] + m["gap"] + m["n"]).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
    )
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.when(text.rlike(pattern), F.aggregate(rows, none, add, lambda acc: acc["spans"])).otherwise(empty)


def markov_score(token: Column, table: list[int]) -> Column:
    """Mean log-likelihood ratio of a token's transitions."""
    n = len(ALPHABET)
    ratios = F.from_json(F.lit("[" + ",".join(map(str, table)) + "]"), "array<int>")
    index = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pairs = F.zip_with(F.slice(index, 1, F.char_length(token) - 1), F.slice(index, 2, F.char_length(token) - 1), lambda a, b: a * n + b)
    total = F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, at: acc + F.get(ratios, at))
    return total / (F.char_length(token) - 1) / SCALE


def scan_secrets(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans."""
    table = train(samples())
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = F.concat(_spans(F.col("text"), ASSIGN, 0, group=2, least=8), _spans(F.col("text"), ACCESS, 1), _spans(F.col("text"), HEX, 2))
    cut = lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])
    rows = rows.withColumn("base", F.array_sort(base)).withColumn("tokens", _spans(F.col("text"), TOKEN, 3))
    looks = lambda s: markov_score(cut(s), table) >= threshold
    rows = rows.withColumn("more", F.when(F.size("tokens") > 0, F.filter("tokens", looks)).otherwise(F.col("tokens")))
    names = F.array(*[F.lit(k) for k in KINDS])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.array_sort(F.concat("base", "more"))).alias("spans"))

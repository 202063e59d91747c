"""Secret scan: fixed patterns, then a battery of randomness tests, in Catalyst expressions only.

Candidates of the battery are runs of at least ``MIN_LENGTH`` letters, digits and ``+ / _ = -`` that have a letter.
For each the narrowest encoding that holds all its characters is inferred (``ENCODINGS``, from hexadecimal over letters,
base 32, 36, 58 and 62 to base 64), and three tests of the hypothesis "uniform over that alphabet" are taken on the symbols' places in it:

* chi-squared of the symbol counts (normal score by its mean and exact variance for that length);
* runs above and below the middle of the alphabet (Wald-Wolfowitz);
* serial correlation of neighbours (lag one).

A token passes if no test rejects at ``REJECT`` (Bonferroni over the three). That alone would let short natural
words through, so false discoveries are controlled too: under the hypothesis "natural text" a character costs
``NATURAL`` nats at least to stay in its class (lower case, upper case, digit, mark) and ``SWITCH`` more to change
it, against ln(k) nats for a uniform symbol; in a run of letters alone a character costs what the letter (over all
languages scanned) and its place after a vowel or consonant are worth (``letter_cost``); the likelihood ratio bounds the p-value (Markov's inequality), and
Benjamini-Hochberg over the tokens of the document, weighted by their length, keeps the share of false discoveries
under ``FDR``. Longer tokens reach smaller p-values and a larger weight.

Spans of the battery that overlap a base span are not repeated.

Defined results: null and empty texts have no spans; repeated rows are scanned alike; other columns are ignored.
Positions are code points, ends exclusive. The plan is a narrow projection of the scan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.native_text import find_all, let, running

#: Base kinds, in order: pattern, shortest match (assign: shortest value).
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

MIN_LENGTH = 20
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
REJECT, FDR = 0.001, 0.01
NATURAL, SWITCH = 2.9, 3.0
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
HEXES = "0123456789abcdef"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: pattern | alphabet, the narrowest first
ENCODINGS = (
    ("^[0-9a-f]+$", HEXES),
    ("^[0-9A-F]+$", HEXES.upper()),
    ("^[a-z]+$", LETTERS),
    ("^[A-Z]+$", LETTERS.upper()),
    ("^[A-Z2-7]+$", BASE32),
    ("^[a-z2-7]+$", BASE32.lower()),
    ("^[a-z0-9]+$", LETTERS + "0123456789"),
    ("^[A-Z0-9]+$", LETTERS.upper() + "0123456789"),
    ("^[A-Za-z]+$", LETTERS.upper() + LETTERS),
    ("^[1-9A-HJ-NP-Za-km-z]+$", BASE58),
    ("^[A-Za-z0-9]+$", LETTERS.upper() + LETTERS + "0123456789"),
)
#: Letters of natural text in per mille: the most of English, German, Spanish and French.
FREQUENCY = dict(zip(LETTERS, (125, 19, 47, 59, 174, 22, 30, 61, 76, 6, 14, 55, 32, 98, 87, 30, 14, 70, 80, 91, 63, 16, 24, 4, 20, 11), strict=True))
VOWELS = "aeiouy"
#: Nats of a vowel or consonant (first letter of the key) by what it follows (second) in natural text.
FOLLOWS = {"VC": -math.log(0.62), "CC": -math.log(0.38), "VV": -math.log(0.2), "CV": -math.log(0.8)}
SPAN = "array<struct<start:int,kind_order:int,stop:int,kind:string>>"
KINDS = ("assign", "access", "hex", "random")


def _found(text: Column, pattern: str, gate: Column) -> Column:
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    return F.when(gate & text.rlike(pattern), find_all(text, F.lit(pattern))).otherwise(none)


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_order"), m["end"].alias("stop"), F.lit(kind).alias("kind")))


def base_spans(text: Column) -> list[Column]:
    """Spans of the fixed patterns: assign, access, hex."""
    assign = F.filter(_found(text, ASSIGN, text.contains("=") | text.contains(":")), lambda m: F.length(F.regexp_extract(m["found"], VALUE, 1)) >= 8)
    return [_spans(assign, "assign"), _spans(_found(text, ACCESS, text.contains("AKIA")), "access"), _spans(_found(text, HEX, F.lit(True)), "hex")]


def normal_tail(z: Column) -> Column:
    """P(|N(0,1)| > |z|), by the rational approximation of the error function with absolute error under 2e-7."""
    x = F.abs(z) / (2.0**0.5)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.lit(1.0), poly * F.exp(-x * x))


def encoding_of(token: Column) -> Column:
    """The narrowest alphabet that holds the token, of which padding is cut off and url-safe marks are folded."""
    out = F.lit(BASE64)
    for pattern, alphabet in reversed(ENCODINGS):
        out = F.when(token.rlike(pattern), F.lit(alphabet)).otherwise(out)
    return out


def letter_cost(token: Column) -> Column:
    """Nats of a run of letters as natural text: each letter within vowels or consonants, and which of the two follows which."""
    total = {v: sum(f for c, f in FREQUENCY.items() if (c in VOWELS) == v) for v in (True, False)}
    cost = F.array(*[F.lit(-math.log(f / total[c in VOWELS])) for c, f in FREQUENCY.items()])
    lower = F.lower(token)
    letters = _sum(F.transform(F.filter(F.split(lower, ""), lambda c: c != ""), lambda c: F.element_at(cost, F.instr(F.lit(LETTERS), c))))
    vowel = F.transform(F.filter(F.split(lower, ""), lambda c: c != ""), lambda c: F.instr(F.lit(VOWELS), c) > 0)
    pairs = F.arrays_zip(F.slice(vowel, 1, F.size(vowel) - 1).alias("a"), F.slice(vowel, 2, F.size(vowel) - 1).alias("b"))
    after = lambda p: F.when(p["a"] & p["b"], FOLLOWS["VV"]).when(p["a"], FOLLOWS["CV"]).when(p["b"], FOLLOWS["VC"]).otherwise(FOLLOWS["CC"])
    return letters + _sum(F.transform(pairs, after))


def switches(token: Column) -> Column:
    """How often neighbouring characters are of different classes."""
    classes = F.translate(token, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=", "A" * 26 + "a" * 26 + "0" * 10 + "+++")
    runs = F.regexp_replace(classes, r"(.)\1*", "$1")
    return (F.length(runs) - 1).cast("double")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def battery(token: Column) -> Column:
    """(n, p_random, log_natural) of one token. What a lambda needs is bound before, so the work is linear in the token."""
    folded = F.translate(F.regexp_replace(token, "=+$", ""), "-_", "+/")
    neighbours = lambda of: F.zip_with(F.slice(of, F.lit(1), F.size(of) - 1), F.slice(of, F.lit(2), F.size(of) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def symbols(text: Column) -> Column:
        natural = F.when(text.rlike("^[A-Za-z]+$"), letter_cost(text)).otherwise(F.length(text) * NATURAL) + switches(text) * SWITCH
        place = lambda alphabet: F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))
        return let(encoding_of(text), lambda alphabet: F.struct(place(alphabet).alias("place"), F.length(alphabet).cast("double").alias("k"), F.length(text).cast("double").alias("n"), natural.alias("natural")))

    def sums(m: Column) -> Column:
        place, k = m["place"], m["k"]
        squares = _sum(F.transform(F.array_distinct(place), lambda s: F.pow(F.size(F.filter(place, lambda x: x == s)).cast("double"), F.lit(2.0))))
        runs = lambda high: F.struct(_sum(high).alias("n1"), (1.0 + _sum(F.transform(neighbours(high), lambda p: F.when(p["a"] == p["b"], 0.0).otherwise(1.0)))).alias("runs"))
        waves = lambda c: F.struct(_sum(F.transform(c, lambda x: x * x)).alias("energy"), _sum(F.transform(neighbours(c), lambda p: p["a"] * p["b"])).alias("serial"))
        half = let(F.transform(place, lambda x: F.when(2.0 * x >= k, 1.0).otherwise(0.0)), runs)
        wave = let(_sum(place) / m["n"], lambda mean: let(F.transform(place, lambda x: x - mean), waves))
        return F.struct(m["n"].alias("n"), k.alias("k"), m["natural"].alias("natural"), squares.alias("squares"), half.alias("half"), wave.alias("wave"))

    def verdict(m: Column) -> Column:
        k, n, n1, runs = m["k"], m["n"], m["half"]["n1"], m["half"]["runs"]
        chi = (k / n * m["squares"] - n - (k - 1.0)) / F.sqrt(2.0 * (k - 1.0) * (1.0 - 1.0 / n))
        n2 = n - n1
        expected = 1.0 + 2.0 * n1 * n2 / n
        spread = 2.0 * n1 * n2 * (2.0 * n1 * n2 - n) / (n * n * (n - 1.0))
        z_runs = F.when(spread > 0, (runs - expected) / F.sqrt(F.greatest(spread, F.lit(1e-9)))).otherwise(99.0)
        energy = m["wave"]["energy"]
        z_serial = F.when(energy > 0, m["wave"]["serial"] / F.greatest(energy, F.lit(1e-9)) * F.sqrt(n)).otherwise(99.0)
        # Only too many repeats speak against a key; too even a spread does not make a token natural.
        tail = lambda z: let(z, normal_tail)
        p = 3.0 * F.least(let(chi, lambda c: F.when(c > 0, normal_tail(c)).otherwise(1.0)), tail(z_runs), tail(z_serial))
        return F.struct(n.alias("n"), F.least(p, F.lit(1.0)).alias("p_random"), F.least(n * F.log(k) - m["natural"], F.lit(0.0)).alias("log_natural"))

    return let(let(let(folded, symbols), sums), verdict)


def with_random(found: DataFrame) -> DataFrame:
    """Adds ``random``: spans that the battery takes for secrets, beside those of ``base``.

    Each step is a column of its own, used more than once, so that no lambda computes it again per token.
    """
    text, none = F.col("text"), F.array().cast(SPAN)
    mixed = F.filter(_found(text, TOKEN, F.lit(True)), lambda m: m["found"].rlike("[A-Za-z]") & (F.length(F.regexp_replace(m["found"], "=+$", "")) >= MIN_LENGTH))
    rated = F.transform("mixed", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), battery(m["found"]).alias("b")))
    found = found.withColumn("mixed", mixed).withColumn("rated", F.when(F.size("mixed") > 0, rated))
    # Weighted Benjamini-Hochberg over the document's tokens, on logarithms; a null limit discovers nothing.
    weight = lambda rated: F.log(_sum(F.transform(rated, lambda r: r["b"]["n"])) / F.size(rated))
    rate = lambda mean: F.transform("rated", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["b"]["p_random"].alias("p_random"), (r["b"]["log_natural"] + mean - F.log(r["b"]["n"])).alias("q")))
    found = found.withColumn("scored", F.when(F.size("rated") > 0, let(weight(F.col("rated")), rate)))
    ordered = F.array_sort(F.transform("scored", lambda s: s["q"]))
    found = found.withColumn("limit", F.array_max(F.transform(ordered, lambda x, i: F.when(x <= F.log((i + 1).cast("double") * FDR / F.size("scored")), x))))
    found = found.withColumn("likely", let(F.col("limit"), lambda limit: F.filter("scored", lambda s: (s["q"] <= limit) & (s["p_random"] >= REJECT))))
    spans = F.transform(apart("likely", "base"), lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind_order"), s["end"].alias("stop"), F.lit("random").alias("kind")))
    return found.withColumn("random", F.coalesce(spans, none))


def apart(tokens: str, base: str) -> Column:
    """The tokens that overlap no base span: of the spans that start before a token ends none ends after its start."""
    event = lambda at, order, start, end, reach: F.struct(at.alias("at"), F.lit(order).alias("order"), start.alias("start"), end.alias("end"), reach.alias("reach"))
    ends = F.transform(tokens, lambda s: event(s["end"], 0, s["start"], s["end"], F.lit(-1)))
    starts = F.transform(base, lambda b: event(b["start"], 1, b["start"], b["stop"], b["stop"]))

    def free(events: Column) -> Column:
        before = running(F.transform(events, lambda e: e["reach"]), F.lit(-1), lambda a, b: F.greatest(a, b))
        return F.filter(F.zip_with(events, before, lambda e, reach: F.struct(e["order"].alias("order"), e["start"].alias("start"), e["end"].alias("end"), reach.alias("reach"))), lambda e: (e["order"] == 0) & (e["reach"] <= e["start"]))

    return F.when(F.size(tokens) > 0, let(F.array_sort(F.concat(ends, starts)), free))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_secrets(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans, and span_list (start, stop, kind)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    assign, access, hexes = base_spans(text)
    found = documents.select("doc_id", text.alias("text"), assign.alias("assign"), access.alias("access"), hexes.alias("hexes"))
    found = found.withColumn("base", F.concat("assign", "access", "hexes"))
    found = with_random(found)
    every = F.concat("base", "random")
    return found.select("doc_id", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hexes").cast("long").alias("n_hex"), F.size("random").cast("long").alias("n_random"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"), F.col("limit").alias("log_limit"), F.array_sort(every).alias("span_list"))

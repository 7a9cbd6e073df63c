"""Secret scans with DataFrame functions only: fixed formats, and a randomness test battery for everything else.

Long runs of key-like characters are candidates. Each gets an inferred encoding (digits, hex, base32, letters, base62,
base64), and under it three tests of uniform randomness: chi-squared over the alphabet, runs about the alphabet's
middle, and lag-1 serial correlation; Bonferroni joins them. A candidate that they reject is not random. For the rest,
the evidence against ordinary text is a likelihood ratio against a model in which character classes persist as they do
in words, identifiers and numbers. Under that model exp(-ratio) bounds the p-value (Markov), and the ratio grows with
length. Benjamini-Hochberg over all candidates of the corpus then sets how long and how mixed a run must be: false
discoveries stay under a stated share, whatever the number of candidates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

#: Patterns of the contract (fixed values). For access and hex keys the least length is part of the pattern, which
#: finds the same spans: a run is taken whole from its leftmost start, and a start further right is only shorter.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
KINDS = {"assign": (ASSIGN, 6), "access": (r"AKIA[A-Z0-9]{16,}", 0), "hex": (r"[0-9a-f]{24,}", 0)}
#: Runs of key-like characters. A run of fewer than 20 that is a word, a number or one after the other changes its
#: character class once at most, and no threshold accepts it: its ratio stays below -ln(share). All others are tested.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?!(?:[A-Z]?[a-z]*[0-9]*|[A-Z]*[0-9]*|[0-9]+[A-Za-z]?[a-z]*)(?![A-Za-z0-9+/_-]))[A-Za-z0-9+/_-]{8,}|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
_SPANS = "array<struct<s:int,e:int>>"


def before(values: str, zero: str, merge: str) -> str:
    """SQL: for each element of an array, ``merge`` (of a.at and x) over all elements in front of it.

    Runs inside blocks of about the root of the size, then over the blocks: an array of n copies n ** 1.5 values, where
    growing one array copies n ** 2.
    """
    scan = f"named_struct('at', {merge}, 'out', concat(a.out, array(a.at)))"
    empty = f"CAST(array() AS array<{'bigint' if zero.endswith('L') else 'int'}>)"
    width = f"greatest(1, CAST(sqrt(size({values})) AS int))"
    blocks = f"transform(sequence(0, CAST(greatest(0, ceil(size({values}) / {width}) - 1) AS int)), b -> slice({values}, b * {width} + 1, {width}))"
    totals = f"transform({blocks}, v -> aggregate(v, named_struct('at', {zero}), (a, x) -> named_struct('at', {merge}), a -> a.at))"
    starts = f"aggregate({totals}, named_struct('at', {zero}, 'out', {empty}), (a, x) -> {scan}, a -> a.out)"
    inside = f"aggregate(y.v, named_struct('at', y.at, 'out', {empty}), (a, x) -> {scan}, a -> a.out)"
    return f"flatten(transform(zip_with({blocks}, {starts}, (v, at) -> named_struct('v', v, 'at', at)), y -> {inside}))"


def with_spans(rows: DataFrame, name: str, pattern: str, least: int = 0, text_of_hits: bool = False) -> DataFrame:
    """Add the code point spans of the leftmost non-overlapping matches; group 2 must have ``least`` characters.

    The pieces between matches and the matches alternate, so their lengths add up to the places.
    """
    text, found, none = F.col("text"), F.col("text").rlike(pattern), F.array().cast("array<string>")
    extra = ", 't', __hits[i]" if text_of_hits else ""
    kind = "array<struct<s:int,e:int,t:string>>" if text_of_hits else _SPANS
    wanted = f"length(__groups[i]) >= {least}" if least else "true"
    rows = rows.withColumns({
        "__hits": F.when(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
        "__groups": F.when(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(2))).otherwise(none) if least else none,
        "__pieces": F.when(found, F.split(text, pattern, -1)).otherwise(none),
    })
    rows = rows.withColumn("__long", F.expr("transform(__hits, (h, i) -> length(__pieces[i]) + length(h))"))
    rows = rows.withColumn("__from", F.expr(f"CASE WHEN size(__long) > 0 THEN {before('__long', '0', 'a.at + x')} ELSE CAST(array() AS array<int>) END"))
    spans = F.expr(f"""filter(transform(__from, (at, i) -> CASE WHEN {wanted} THEN
        named_struct('s', at + length(__pieces[i]), 'e', at + __long[i]{extra}) END), x -> x IS NOT NULL)""").cast(kind)
    return rows.withColumn(name, spans).drop("__hits", "__groups", "__pieces", "__long", "__from")


def _normal_tail(z: str) -> str:
    """SQL: the upper tail of the normal distribution (Abramowitz and Stegun 26.2.17, error below 1e-7)."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    series = f"({t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    upper = f"(exp(-least(0.5 * {z} * {z}, 700)) / {math.sqrt(2 * math.pi)} * {series})"
    return f"(CASE WHEN {z} >= 0 THEN {upper} ELSE 1 - {upper} END)"


#: Encodings from the narrowest on: condition on the run t, alphabet in order of value.
ENCODINGS = (
    ("^[0-9]+$", "0123456789"),
    ("^[0-9a-f]+$", "0123456789abcdef"),
    ("^[0-9A-F]+$", "0123456789ABCDEF"),
    ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    ("^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("^[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
#: Text model: a character class lasts with this probability; sizes of lower, upper, digit and other classes.
STAY, CLASSES = 0.9, (26, 26, 10, 4)


def battery(rows: DataFrame, name: str) -> DataFrame:
    """Replace candidate spans (s, e, t) by (s, e, p_random, ratio); the runs themselves are not carried on."""
    alphabet = "CASE " + " ".join(f"WHEN c.t RLIKE '{p}' THEN '{a}'" for p, a in ENCODINGS if p) + f" ELSE '{ENCODINGS[-1][1]}' END"
    # each step reads what the one before bound, so nothing of a whole run is computed for each of its characters
    named = f"transform({name}, c -> named_struct('s', c.s, 'e', c.e, 'a', {alphabet}, 'x', split(c.t, '')))"
    coded = """transform(__named, c -> named_struct('s', c.s, 'e', c.e, 'n', CAST(size(c.x) AS double), 'k', CAST(length(c.a) AS double),
        'v', transform(c.x, x -> CAST(instr(c.a, x) - 1 AS double)),
        'c', transform(c.x, x -> CASE WHEN x BETWEEN 'a' AND 'z' THEN 0 WHEN x BETWEEN 'A' AND 'Z' THEN 1 WHEN x BETWEEN '0' AND '9' THEN 2 ELSE 3 END)))"""
    ends = """transform(__coded, c -> named_struct('s', c.s, 'e', c.e, 'n', c.n, 'k', c.k, 'v', c.v, 'c', c.c, 'sorted', array_sort(c.v)))"""
    cut = """transform(__ends, c -> named_struct('s', c.s, 'e', c.e, 'n', c.n, 'k', c.k, 'v', c.v, 'c', c.c, 'last', filter(
        transform(c.sorted, (x, i) -> CASE WHEN i + 1 = size(c.sorted) OR x != c.sorted[i + 1] THEN i + 1 END), i -> i IS NOT NULL)))"""
    counted = """transform(__cut, c -> named_struct('s', c.s, 'e', c.e, 'n', c.n, 'k', c.k,
        'squares', aggregate(transform(c.last, (x, i) -> x - CASE WHEN i > 0 THEN c.last[i - 1] ELSE 0 END), 0D, (a, x) -> a + power(x, 2)),
        'runs', 1 + size(filter(c.v, (x, i) -> i > 0 AND (x * 2 < c.k) != (c.v[i - 1] * 2 < c.k))),
        'serial', aggregate(transform(slice(c.v, 2, size(c.v)), (x, i) -> (x - (c.k - 1) / 2) * (c.v[i] - (c.k - 1) / 2)), 0D, (a, x) -> a + x),
        'changes', size(filter(c.c, (x, i) -> i > 0 AND x != c.c[i - 1])),
        'inside', aggregate(c.c, 0D, (a, x) -> a + CASE x """ + " ".join(f"WHEN {k} THEN {math.log(1 / size)!r}D" for k, size in enumerate(CLASSES)) + """ END)))"""
    chi = "((power((c.squares * c.k / c.n - c.n) / (c.k - 1), 1 / 3D) - (1 - 2 / (9 * (c.k - 1)))) / sqrt(2 / (9 * (c.k - 1))))"
    # an odd alphabet's middle splits it unevenly by one letter in k, which is neglected
    runs = "(abs(c.runs - 1 - (c.n - 1) / 2) / sqrt((c.n - 1) / 4))"
    serial = "(abs(c.serial) / ((c.k * c.k - 1) / 12) / sqrt(c.n - 1))"
    p = f"least(1D, 3 * least({_normal_tail(chi)}, 2 * {_normal_tail(runs)}, 2 * {_normal_tail(serial)}))"
    ratio = f"c.n * ln(1 / c.k) - ({math.log(1 / 4)!r} + c.changes * {math.log((1 - STAY) / 3)!r} + (c.n - 1 - c.changes) * {math.log(STAY)!r} + c.inside)"
    scored = f"transform(__counted, c -> named_struct('s', c.s, 'e', c.e, 'p_random', {p}, 'ratio', {ratio}))"
    steps = {"__named": named, "__coded": coded, "__ends": ends, "__cut": cut, "__counted": counted, name: scored}
    for step, sql in steps.items():
        rows = rows.withColumn(step, F.expr(sql))
    return rows.drop(*[x for x in steps if x != name])


def scanned(rows: DataFrame) -> DataFrame:
    """Add the span columns assign, access, hex and candidates to rows with a text (null counts as empty)."""
    for kind, (pattern, least) in KINDS.items():
        rows = with_spans(rows, kind, pattern, least)
    return battery(with_spans(rows, "candidates", CANDIDATE, text_of_hits=True), "candidates")


def discovery_threshold(candidates: DataFrame, alpha: float, share: float) -> float:
    """The least ratio that Benjamini-Hochberg accepts, over all candidates that the battery does not reject.

    Counts by tenths of the ratio (a bounded number of rows) decide; each candidate takes the bound of its tenth's
    lower end, so the rule errs to the safe side.
    """
    score = F.floor(F.greatest(F.least(F.col("c.ratio"), F.lit(1000.0)), F.lit(0.0)) * 10)
    counts = candidates.select(F.explode("candidates").alias("c")).groupBy(F.when(F.col("c.p_random") >= alpha, score).otherwise(-1).alias("tenth")).agg(F.count("*").alias("n")).collect()
    total, above, least = sum(r["n"] for r in counts), 0, math.inf
    for tenth, n in sorted(((r["tenth"], r["n"]) for r in counts if r["tenth"] >= 0), reverse=True):
        above += n
        if math.exp(-tenth / 10) <= share * above / total:
            least = tenth / 10
    return least


def with_all_spans(rows: DataFrame, alpha: float, threshold: float) -> DataFrame:
    """Add __base and __every: base spans and all spans, as sorted arrays of (s, order, e, kind).

    A candidate counts where no base span overlaps it. In the array of candidates and of one kind's spans by start, a
    candidate's place less its own number is the number of spans before it, so its two neighbours are known.
    """

    def labelled(kind: str, order: int) -> str:
        return f"transform({kind}, c -> named_struct('s', c.s, 'order', {order}, 'e', c.e, 'kind', '{kind}'))"

    limit = "false" if math.isinf(threshold) else f"c.ratio >= {threshold}D"
    rows = rows.withColumn("__base", F.expr("array_sort(concat(" + ", ".join(labelled(k, i) for i, k in enumerate(KINDS)) + "))"))
    rows = rows.withColumn("__free", F.expr(f"transform(filter(candidates, c -> c.p_random >= {alpha}D AND {limit}), c -> named_struct('s', c.s, 'e', c.e))"))
    for kind in KINDS:
        mixed = f"array_sort(concat(transform({kind}, b -> named_struct('s', b.s, 'mine', 0, 'e', b.e, 'i', 0)), transform(__free, (c, i) -> named_struct('s', c.s, 'mine', 1, 'e', c.e, 'i', i))))"
        clear = f"u.mine = 1 AND (p - u.i <= 0 OR {kind}[p - u.i - 1].e <= u.s) AND (p - u.i >= size({kind}) OR {kind}[p - u.i].s >= u.e)"
        rows = rows.withColumn("__free", F.expr(f"CASE WHEN size({kind}) = 0 OR size(__free) = 0 THEN __free ELSE transform(filter({mixed}, (u, p) -> {clear}), u -> named_struct('s', u.s, 'e', u.e)) END"))
    more = f"transform(__free, c -> named_struct('s', c.s, 'order', {len(KINDS)}, 'e', c.e, 'kind', 'random'))"
    return rows.withColumn("__every", F.expr(f"array_sort(concat(__base, {more}))")).drop("__free")


def joined(spans: str) -> Column:
    return F.array_join(F.expr(f"transform({spans}, c -> concat_ws(':', c.kind, c.s, c.e))"), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.001, share: float = 0.01) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, whole matches; ``random`` spans are runs that the battery
    does not reject at ``alpha`` and that count as discoveries with a false share of ``share``, where no base span
    overlaps. Null text counts as empty: no spans, the checksum of ''. Null ids and repeated rows are kept as they
    are; an empty table gives an empty result; other columns are ignored. The texts are read once; only places and
    test results are written in between, never the secrets.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = keep(scanned(rows).drop("text"))
    out = with_all_spans(found, alpha, discovery_threshold(found, alpha, share))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(joined("__base").cast("binary"), 256).alias("base_sha256"), joined("__every").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[secret]", alpha: float = 0.001, share: float = 0.01) -> DataFrame:
    """The same rows and columns with every span of a secret replaced by ``mask``; null texts stay null.

    Overlapping spans become one mask. The first pass sets the discovery threshold, the second writes the texts.
    """
    columns, original = docs.columns, "__original"
    rows = docs.withColumn(original, F.struct(*[F.col(c) for c in columns])).select(original, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    only = keep(scanned(rows.select("text")).select("candidates"))
    out = with_all_spans(scanned(rows), alpha, discovery_threshold(only, alpha, share))
    # characters and the places to which the spans in front of each span reach; a slice costs its own length
    hit = F.size("__every") > 0
    out = out.withColumn("__chars", F.when(hit, F.split("text", ""))).withColumn("__ends", F.when(hit, F.expr("transform(__every, c -> c.e)")))
    out = out.withColumn("__reach", F.when(hit, F.expr(before("__ends", "0", "greatest(a.at, x)"))))
    pieces = f"""concat(transform(__every, (c, i) -> CASE WHEN c.s < __reach[i] THEN '' ELSE
        concat(array_join(slice(__chars, __reach[i] + 1, c.s - __reach[i]), ''), '{mask}') END),
        array(array_join(slice(__chars, array_max(__ends) + 1, size(__chars)), '')))"""
    kept = F.array_join(F.expr(pieces), "")
    clean = F.when(F.size("__every") > 0, kept).otherwise(F.col(f"{original}.{text_col}"))
    return out.select(*[clean.alias(c) if c == text_col else F.col(f"{original}.{c}").alias(c) for c in columns])

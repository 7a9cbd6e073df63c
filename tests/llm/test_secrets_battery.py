"""The random spans of the secret scan against the same tests in plain Python, and long texts in bounded time."""

import math
import random
import re
import time
from collections import Counter

import pytest

from rareflow.llm import secrets

R = random.Random(11)
B62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def key(n, alphabet=B62):
    return "".join(R.choices(alphabet, k=n))


KEYS = [key(40), key(32), key(24), key(64, B62 + "+/"), key(30, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), key(14), key(12)]
#: Ordinary runs; in CAMEL the case changes as often as in a weak key, so it may be taken for one.
CAMEL = "getUserAccountNameByIdentifier"
PLAIN = ["max_number_of_items_7", "a" * 40, "ab1" * 12, "2023-04-05-2023-04-05-17-00", "internationalisation", "McDonald", "iPhone15", "0123456789012345678901234", "antidisestablishmentarianism2"]
TEXTS = [
    f"the key is {KEYS[0]} and {CAMEL}", f"é {KEYS[1]}. {PLAIN[1]} {PLAIN[5]}", f"{KEYS[2]}\n{KEYS[3]}\n{PLAIN[2]}", f"x {PLAIN[3]} {KEYS[4]} {PLAIN[4]}", " ".join(PLAIN),
    f"token = {KEYS[0]} and {key(40, '0123456789abcdef')}", f"{KEYS[5]} {KEYS[6]} {PLAIN[6]}", None, "", f"my_secret_name_here=abcdefgh12 {KEYS[0]}", " ".join(f"some_name_{i}_of_it" for i in range(300)),
]
CLASS = {**dict.fromkeys("abcdefghijklmnopqrstuvwxyz", 0), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), **dict.fromkeys("0123456789", 2)}


def tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery_of(t):
    letters = next(a for p, a in secrets.ENCODINGS if re.search(p, t))
    n, k, v, c = len(t), len(letters), [letters.index(x) for x in t], [CLASS.get(x, 3) for x in t]
    mid = (k - 1) / 2
    chi2 = sum((x - n / k) ** 2 for x in [v.count(i) for i in range(k)]) * k / n
    z = ((chi2 / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    runs = 1 + sum((a * 2 < k) != (b * 2 < k) for a, b in zip(v, v[1:]))
    serial = sum((a - mid) * (b - mid) for a, b in zip(v, v[1:]))
    p = min(1, 3 * min(tail(z), 2 * tail(abs(runs - 1 - (n - 1) / 2) / math.sqrt((n - 1) / 4)), 2 * tail(abs(serial) / ((k * k - 1) / 12) / math.sqrt(n - 1))))
    changes = sum(a != b for a, b in zip(c, c[1:]))
    model = math.log(1 / 4) + changes * math.log((1 - secrets.STAY) / 3) + (n - 1 - changes) * math.log(secrets.STAY) + sum(math.log(1 / secrets.CLASSES[x]) for x in c)
    return p, n * math.log(1 / k) - model


def overlaps(a, b):
    return a[0] < b[1] and b[0] < a[1]


def test_random_spans_are_those_of_the_battery(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)
    candidates = [(i, m.start(), m.end(), *battery_of(m[0])) for i, t in enumerate(TEXTS) for m in re.finditer(secrets.CANDIDATE, t or "")]
    alpha, share, least = 0.001, 0.01, math.inf
    passed = sorted((min(max(r, 0), 1000) for *_, p, r in candidates if p >= alpha), reverse=True)
    for rank, r in enumerate(passed, 1):
        tenth = math.floor(r * 10)
        above = sum(math.floor(x * 10) >= tenth for x in passed)
        if math.exp(-tenth / 10) <= share * above / len(candidates):
            least = tenth / 10
    got = {r.doc_id: [x.split(":") for x in r.spans.split(",") if x] for r in secrets.scan_secrets(docs, alpha=alpha, share=share).collect()}
    found = set()
    for i, s, e, p, r in candidates:
        base = [(int(a), int(b)) for k, a, b in got[i] if k != "random"]
        if p >= alpha and r >= least and not any(overlaps((s, e), b) for b in base):
            found.add((i, s, e))
    assert {(i, int(a), int(b)) for i, spans in got.items() for k, a, b in spans if k == "random"} == found
    texts = {TEXTS[i][s:e] for i, s, e in found}
    assert set(KEYS[:4]) <= texts and not texts & set(PLAIN)
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    for i, t in enumerate(TEXTS):
        out, at = "", 0
        for _, a, b in sorted(got[i], key=lambda x: int(x[1])):
            if int(a) >= at:
                out += t[at : int(a)] + "[secret]"
            at = max(at, int(b))
        assert clean[i] == (None if t is None else out + t[at:])


def test_short_runs_left_out_could_not_be_accepted():
    run = re.compile("[A-Za-z0-9+/_-]{8,}")
    for t in ["wordswords", "Internation", "ABCDEFGHIJK", "1234567890123456789", "abcdefgh12345678", "Abcdefgh1234567890", "12345678abcdefgh", "ABCDEFGH12345"]:
        assert run.fullmatch(t) and not re.fullmatch(secrets.CANDIDATE, t) and battery_of(t)[1] < -math.log(0.01)


@pytest.mark.parametrize("kind", ["lines", "run"])
def test_long_texts_take_linear_time(spark, kind):
    text = "\n".join(f"é {key(32, '0123456789abcdef')}" for _ in range(20_000)) if kind == "lines" else key(400_000)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    (row,) = secrets.scan_secrets(docs).collect()
    if kind == "lines":
        assert row.n_hex == 20_000 and Counter(secrets.redact(docs).first().text.split()) == {"é": 20_000, "[secret]": 20_000}
    assert time.time() - began < 60

"""Line dedup, fill-in-middle and collocations against brute force, over nulls, empties, ties, repeats, long texts and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import pytest

from rareflow.llm import collocations, fim, lines

R = random.Random(11)
SCHEMA = "doc_id long, text string, lang string, row long, lines string, n long, shard int, h1 long, output string, phrase string, ids string"


def made(texts, langs=("en", None)):
    rows = [(i, t, langs[i % len(langs)], 1, "x", 2, 3, 4, "o", "p", "q") for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, *rows[4][1:]), (None, *rows[4][1:])]


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# lines

COMMON = ["Share this page", "É tudo", "", "\t ", "x", "日本"]
LINE_TEXTS = ["\n".join(R.choice(COMMON) if R.random() < 0.5 else f" line {R.randint(0, 40)} " for _ in range(R.randint(1, 9))) for _ in range(40)]
LINE_TEXTS += [None, "", "\n\n", "share THIS page\r", "  x", "é tudo", "x\n" * 3000 + "end", "\n".join(f"own {i}" for i in range(5000)), "\x0b X \x0c\nx\nx"]


@pytest.mark.parametrize("least,chars", [(10, 1), (3, 0), (2, 3), (1, 1), (1000, 1)])
def test_lines(spark, least, chars):
    rows = made(LINE_TEXTS)
    held = Counter(k for r in rows for k in {lower(x.strip(" \t\n\x0b\x0c\r")) for x in (r[1] or "").split("\n")})
    want = []
    for r in rows:
        split = (r[1] or "").split("\n")
        kept = [x for x in split if not (held[k := lower(x.strip(" \t\n\x0b\x0c\r"))] >= least and len(k) >= chars)]
        want.append((r[0], len(split), len(split) - len(kept), sha("\n".join(kept))))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = lines.digest(lines.drop_common_lines(docs, least, chars))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_lines_of_no_rows(spark):
    assert lines.drop_common_lines(spark.createDataFrame([], SCHEMA)).count() == 0


# fill-in-middle

FIM_TEXTS = [None, "", "a", "ab", "日本語 text", "😀😁😂" * 7, "$1 \\2 $0", "line\nline\r\n end", "<P> in it", "a<S>", "<M>", "<P", "P>", "<<S", "S>><M", "éx", "z" * 4096, "é" * 4097, "q" * 200_001]
FIM_TEXTS += ["".join(R.choices("<>PSM ab😀\n", k=R.randint(0, 12))) for _ in range(300)]


def test_fim(spark):
    rows = made(FIM_TEXTS)
    want = []
    for doc_id, text, *_ in rows:
        t = text or ""
        h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
        a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
        if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            want.append((doc_id, len(t), "plain", None, None, t))
        elif h4 % 100 < 20:
            want.append((doc_id, len(t), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"))
        else:
            want.append((doc_id, len(t), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = fim.fill_in_middle(docs)
    assert Counter(map(tuple, out.collect())) == Counter(want)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    texts = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    for r in out.select("doc_id", fim.restored(out["form"], out["output"]).alias("back")).where("doc_id is not null").collect():
        assert r.back == texts[r.doc_id]
    assert Counter(r.restored_sha256 for r in fim.digest(out).collect()) == Counter(sha(r[1] or "") for r in rows)


@pytest.mark.parametrize("percent,spm,forms", [(0, 50, {"plain"}), (100, 0, {"plain", "psm"}), (100, 100, {"plain", "spm"})])
def test_fim_shares(spark, percent, spm, forms):
    docs = spark.createDataFrame([(i, "some text" if i else "") for i in range(40)], "doc_id long, text string")
    assert {r.form for r in fim.fill_in_middle(docs, percent, spm).select("form").distinct().collect()} == forms
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


# collocations

FEW = ["the", "red", "house", "of", "É", "cat", "sat", "x"]
PHRASE_TEXTS = [" ".join(R.choices(FEW, weights=[9, 5, 3, 3, 2, 1, 1, 1], k=R.randint(0, 40))) + R.choice([".", "! ", "\n", ",the red house of", ""]) for _ in range(120)]
PHRASE_TEXTS += [None, "", " \t ", "...", "the the the the the the the", "The RED;house of?\x0bthe\x0cred\r", "\x00 \x1f\x85 the", "a b the", "red house of the cat sat " * 3000]


def counts(rows, longest=5):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                f.update((lang or "und", tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    return f, n


def by_hand(rows, least, longest, percent, top):
    f, n = counts(rows, longest)
    held = {k: a for k, a in f.items() if a >= least}
    out = []
    for lang in {k[0] for k in held}:
        found = []
        for (own, p), a in held.items():
            longer = [b for (o, q), b in held.items() if o == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if own != lang or len(p) < 2 or any(100 * b >= percent * a for b in longer):
                continue
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("least,longest,percent,top,shards,bits", [(20, 5, 100, 2000, 3, 26), (5, 4, 60, 7, 2, 8), (40, 3, 100, 50, 1, 26), (3, 2, 100, 2000, 4, 6)])
def test_collocations(spark, least, longest, percent, top, shards, bits):
    """With 64 to 256 bits nearly everything seems frequent: early starts, the same rows."""
    rows = made(PHRASE_TEXTS, ("en", None, "de"))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = collocations.collocations(docs, least, longest, percent, top, shards=shards, bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = by_hand(rows, least, longest, percent, top)
    assert want and sorted(map(tuple, got.collect())) == want


def test_phrases_across_rows_of_ids(spark, monkeypatch):
    """A piece that is longer than a row of ids, or a slice, is counted whole, and each phrase once."""
    monkeypatch.setattr(collocations, "CHUNK", 7)
    monkeypatch.setattr(collocations, "SLICE", 23)
    rows = made(PHRASE_TEXTS[100:127])
    coded, words = collocations.coded_corpus(spark.createDataFrame(rows, SCHEMA).selectExpr("coalesce(lang, 'und') as lang", "coalesce(text, '') as text").repartition(2), 2)
    spelled = dict(map(tuple, words.collect()))
    f, n = counts(rows)
    assert Counter({spelled[r.lang]: r.n for r in coded.where("shard >= 0").groupBy("lang").agg({"n_words": "sum"}).toDF("lang", "n").collect()}) == n
    got = {(spelled[r.lang], tuple(spelled[r[w]] for w in collocations.WORDS if r[w])): r.n for r in collocations.frequent_phrases(coded, 2, shards=2, bits=12).collect()}
    assert got == {k: a for k, a in f.items() if a >= 2}


def test_colliding_word_ids_take_another_seed(spark, monkeypatch):
    docs = spark.createDataFrame([("en", "one two three one")], "lang string, text string")
    right = collocations.encoded
    seeds = []

    def encoded(docs, seed, shards):
        from pyspark.sql import functions as F

        seeds.append(seed)
        out = right(docs, seed, shards)
        return out.withColumn("ids", F.transform("ids", lambda x: F.lit(5).cast("long"))) if seed == 1 else out

    monkeypatch.setattr(collocations, "encoded", encoded)
    _, words = collocations.coded_corpus(docs, 2)
    assert seeds == [1, 2] and {r.word for r in words.collect()} == {"one", "two", "three", "en"}


def test_collocations_of_no_rows(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**12
    phrases = spark.createDataFrame([("en", [1], big), ("en", [2], big), ("en", [1, 2], big - 1)], "lang string, phrase array<long>, a long")
    totals = spark.createDataFrame([("en", 10**15)], "lang string, n long")
    (r,) = collocations.best_cuts(phrases, totals).collect()
    assert (r.score, r.l, r.r, r.k) == (1000 * (big - 1) * 10**15 // (big * big), big, big, 1)

import collections
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sievewright.llm import quality_mil
from sievewright.llm import quality_rules
from sievewright.llm.quality_rules import apply_rules, counts


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
    earlier, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in earlier
            earlier.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab #\n\t\x0b\xa0é", max_size=60)), min_size=1, max_size=40))
def test_counts(spark, texts):
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_rules_keep_clean_texts_and_fences_follow_the_group(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9)))
    clean = lambda: " ".join(word() for _ in range(rnd.randint(60, 200)))
    data = [(i, clean(), "en", "s1") for i in range(200)]
    data += [(200 + i, clean(), "en", None) for i in range(10)]
    data += [(300, clean().replace(" ", "*** "), "en", "s1"), (301, "same " * 300, "en", "s1"), (302, "few words", "en", "s1"), (303, None, None, None), (304, "x" * 200_000, "de", "s2")]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").repartition(3).selectExpr("*", "1 as n", "2 as level", "3 as _w")
    got = {r["doc_id"]: r for r in apply_rules(frame).collect()}
    assert len(got) == len(data)
    assert all(got[i]["kept"] for i in range(210))
    assert not got[300]["kept"] and not got[300]["base_failed"]
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (301, 302, 303, 304))
    assert apply_rules(frame.limit(0)).count() == 0


def brute_fences(v, width=1.5, both=False):
    """lo and hi by exact quantiles of plain Python."""
    v = sorted(v)
    q = [v[max(0, -(-g * len(v) // 1000) - 1)] for g in quality_rules.GRID]
    at = quality_rules.GRID.index
    spread = next((s for lo, hi in quality_rules.SPREADS if (s := q[at(hi)] - q[at(lo)]) > 0), None)
    wide = [i for i in range(len(q) - 1) if spread and q[i + 1] - q[i] > width * spread]
    up, down = [i for i in wide if i >= at(500)], [i for i in wide if i < at(500)]
    middle = lambda i: (q[i] + q[i + 1]) / 2
    return (middle(down[-1]) if both and down else -np.inf), (middle(up[0]) if up else np.inf)


def test_thresholds_come_from_the_group(spark):
    """The same text passes where its like is the habit and fails where it isn't; fences and verdicts are those of exact quantiles."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9)))
    text = lambda share: " ".join(word() + ("#" if rnd.random() < share else "") for _ in range(rnd.randint(60, 300)))
    data = [(i, text(rnd.uniform(0.02, 0.5)), "en", "code") for i in range(120)] + [(200 + i, text(0), "en", "news") for i in range(120)]
    same = text(0.3)
    data += [(500, same, "en", "code"), (501, same, "en", "news"), (502, same, "en", None), (503, same, "xx", "tiny"), (504, None, "zz", "none")]
    data += [(600 + i, "one and the same text of many copies " * 3 + " ".join(f"w{k}" for k in range(60)), "de", "copies") for i in range(80)]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").repartition(5)
    got = {r["doc_id"]: r for r in apply_rules(frame).collect()}
    assert got[500]["kept"] and not got[501]["kept"] and not got[501]["base_failed"]
    rows = {i: (brute(t), lang, source) for i, t, lang, source in data}
    passing = {i: r for i, r in rows.items() if r[0][0] >= 50 and 100 * r[0][4] <= 50 * r[0][0]}
    rate = lambda c, k: np.log((c[k] + 0.5) / (c[0] + 1))
    column = {"symbol_rate": 2, "dup_line_rate": 3, "repeat_rate": 4, "word_length": 1}

    def members(lang, source):
        own = [r for r in passing.values() if r[1:] == (lang, source)]
        of_lang = [r for r in passing.values() if r[1] == lang]
        return own if len(own) >= 50 else of_lang if len(of_lang) >= 50 else list(passing.values())

    for i, r in rows.items():
        ok = i in passing
        for name, k in column.items():
            if ok:
                lo, hi = brute_fences([rate(m[0], k) for m in members(*r[1:])], both=name == "word_length")
                ok = lo <= rate(r[0], k) <= hi
        assert got[i]["kept"] == ok, i
    assert all(got[600 + i]["kept"] for i in range(80))


def corpus(n, seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9)))
    out = []
    for i in range(n):
        good = " ".join(word() + rnd.choice(["", "", "."]) for _ in range(rnd.randint(5, 400)))
        kind = rnd.randrange(6)
        if kind == 0:
            at = rnd.randrange(len(good))
            good = good[:at] + " " + " ".join(word().upper() + "!!" for _ in range(80)) + " " + good[at:]
        elif kind == 1:
            good += " " + " ".join([word()] * 90)
        out.append((i, good, int(kind > 1)))
    return out


def test_classifier_tells_held_out_documents(spark):
    data = corpus(900)
    docs = spark.createDataFrame([r[:2] for r in data], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in data], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_mil.classify(docs, labels).collect()}
    held = [i for i, *_ in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in data)
    truth = {i: q for i, _, q in data}
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.95
    flipped = labels.selectExpr("doc_id", "case when crc32(encode(cast(doc_id as string), 'UTF-8')) % 5 = 0 then 1 - quality else quality end as quality", "toxic")
    again = {r["doc_id"]: r["score"] for r in quality_mil.classify(docs.repartition(2), flipped).collect()}
    assert again == {i: r["score"] for i, r in got.items()}  # held-out labels have no say
    kept = quality_mil.accepted(docs.selectExpr("*", "1 as held_out"), quality_mil.fit(docs, labels))
    assert kept.columns == ["doc_id", "text", "held_out"] and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}


def test_classifier_tells_texts_that_differ_by_words_only(spark):
    """Good and bad texts have the same lengths, marks and letters' habits; a part of their words is another."""
    rnd = random.Random(17)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8)))
    common, own = [word() for _ in range(400)], {q: [word() for _ in range(150)] for q in (0, 1)}
    data = [(i, " ".join(rnd.choice(own[q]) if rnd.random() < 0.25 else rnd.choice(common) for _ in range(rnd.randint(60, 300))), q) for i in range(1200) for q in [rnd.randrange(2)]]
    docs = spark.createDataFrame([r[:2] for r in data], "doc_id long, text string").repartition(4).selectExpr("*", "1 as score", "2 as h", "'x' as y", "3 as n")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in data], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_mil.classify(docs, labels).collect() if r["held_out"]}
    assert len(got) > 150 and np.mean([(got[i]["score"] >= 0.5) == q for i, _, q in data if i in got]) > 0.95


def test_training_is_bounded(spark):
    docs = spark.createDataFrame([(k % 100, f"a text {k} " * 40) for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(100)], "doc_id long, quality int, toxic int")
    seen = []
    real, quality_mil.train = quality_mil.train, lambda x, counts, y, **more: seen.append((len(counts), counts.sum())) or real(x, counts, y, epochs=1, **more)
    try:
        quality_mil.fit(docs, labels, max_train=20)
        quality_mil.fit(docs, labels, max_passages=50)
    finally:
        quality_mil.train = real
    assert seen[0][0] == 20 and 40 < seen[1][1] <= 50


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a"), (4, "b " * 40_000), (4, "b " * 40_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_mil.classify(docs, none).collect()
    assert len(got) == 5 and all(r["score"] == 0.5 for r in got)
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    assert all(r["score"] > 0.99 for r in quality_mil.classify(docs, one).collect())
    assert quality_mil.classify(docs.limit(0), none).count() == 0


def test_gradient_fits_its_own_data():
    rng = np.random.default_rng(0)
    counts_ = rng.integers(1, 6, 200)
    x = rng.normal(size=(counts_.sum(), 5))
    first = np.r_[0, np.cumsum(counts_)[:-1]]
    y = (np.maximum.reduceat(x[:, 0], first) > 0.8).astype(float)
    s = quality_mil.train(x, counts_, y).scores(x, counts_)
    assert np.mean((s > 0.5) == (y > 0)) > 0.95

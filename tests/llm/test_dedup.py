"""Exact and near dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st

from sievewright.llm import near_dedup
from sievewright.llm.exact_dedup import exact_duplicates
from sievewright.llm.near_dedup import near_duplicates
from sievewright.llm.quality_mil import passages
from sievewright.llm.textkit import Words, shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids, texts, strict=True)], DOCS).repartition(3)


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(texts):
    sets = [shingle_set(t) for t in texts]
    comp = list(range(len(texts)))
    changed = True
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(comp[i], comp[j])
            changed |= comp[i] != low or comp[j] != low
            comp[i] = comp[j] = low
    return [len(s) for s in sets], comp


def near(spark, texts):
    got = {r["doc_id"]: r for r in near_duplicates(docs(spark, texts)).collect()}
    return [got[i]["n_shingles"] for i in range(len(texts))], [got[i]["component_id"] for i in range(len(texts))], got


def words(rnd, n, vocabulary=4000):
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


def mutate(rnd, base, share):
    return [f"m{rnd.randrange(10**9)}" if rnd.random() < share else w for w in base]


def test_near_groups_chains_and_shared_passages(spark):
    rnd = random.Random(4)
    texts = [None, "", " \t\n", "one two", "ONE  two", "one two three", "a b c d e"]
    base = words(rnd, 150)
    texts += [" ".join(mutate(rnd, base, s)) for s in [0, 0.01, 0.02, 0.03, 0.05, 0.1] * 12]
    passage = words(rnd, 60)
    texts += [" ".join(words(rnd, 30) + passage + words(rnd, rnd.randrange(10, 90))) for _ in range(90)]
    chain = words(rnd, 200)
    for _ in range(12):
        texts.append(" ".join(chain))
        at = rnd.randrange(0, 180)
        chain = chain[:at] + words(rnd, 8) + chain[at + 8 :]
    texts += [" ".join(base).upper()] * 3
    rnd.shuffle(texts)
    sizes, comps, _ = near(spark, texts)
    assert (sizes, comps) == brute_components(texts)


def test_near_dense_lists_go_by_the_exact_prefix_filter(spark, monkeypatch):
    """With lists of any length called long, every pair beyond the stars comes from the prefix filter."""
    monkeypatch.setattr(near_dedup, "FEW", 0)
    rnd = random.Random(9)
    base = words(rnd, 80)
    texts = [" ".join(mutate(rnd, base, rnd.choice([0.005, 0.02, 0.04, 0.06]))) for _ in range(80)]
    sizes, comps, _ = near(spark, texts)
    assert (sizes, comps) == brute_components(texts)


@settings(max_examples=3, deadline=None, phases=[Phase.explicit, Phase.generate])
@given(st.lists(st.text(alphabet="aB \n", max_size=24), min_size=1, max_size=25))
def test_near_small_texts(spark, texts):
    sizes, comps, _ = near(spark, texts)
    assert (sizes, comps) == brute_components(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\x0b\xa0\xe9", max_size=30)), max_size=12))
def test_shingles_and_passages_of_any_batch(texts):
    column = pa.array(texts, pa.string())
    words = Words(column, lower=True)
    assert [len(s) for s in shingles(words)] == [len(shingle_set(t)) for t in texts]
    assert words.counts.tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    features, counts = passages(column)
    assert len(counts) == len(texts) and len(features) == counts.sum() and np.isfinite(features).all()


def test_near_empty_table_null_ids_and_clashing_columns(spark):
    assert near_duplicates(docs(spark, [])).count() == 0
    odd = docs(spark, ["a b c d e f", "a b c d e f", "a b c d e f"], [3, None, 7]).selectExpr("*", "1 as n", "'x' as sketch", "2 as cls", "3 as value", "4 as component")
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in near_duplicates(odd).collect()}
    assert got == {3: (3, True), 7: (3, False), None: (None, True)}


def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm, strict=True):
        group = [(-len(t or ""), j) for (j, t), m in zip(rows, norm, strict=True) if m == n]
        keep = min(group)[1]
        out.append((i, keep, len(group), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("force", [False, True])
def test_exact(spark, force, monkeypatch):
    texts = ["a b", "ab", "a  b", None, "", " \x0b", "é x", "é x", "x" * 50_000, "x " * 50_000, "ab", "A b"]
    if force:  # all rows share one key, as if 128 bits collided: bytes alone tell texts apart
        import sievewright.llm.exact_dedup as m

        real = m.F.unhex
        monkeypatch.setattr(m.F, "unhex", lambda c: real(m.F.lit("00")))
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_duplicates(docs(spark, texts)).collect())
    assert got == brute_exact(list(enumerate(texts)))


def test_exact_empty_null_ids_repeats_and_clashing_columns(spark):
    assert exact_duplicates(docs(spark, [])).count() == 0
    odd = docs(spark, ["a", "a", "a", "b"], [5, 5, None, None]).selectExpr("*", "1 as key", "2 as norm", "3 as best", "4 as length")
    got = sorted(((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"]) for r in exact_duplicates(odd).collect()), key=repr)
    assert got == [("5", 5, 3, True), ("5", 5, 3, True), ("None", 5, 3, False), ("None", None, 1, True)]


LEAST, MOST = -(2**63), 2**63 - 1


def test_exact_takes_any_doc_id(spark):
    ids = [LEAST, MOST, 0, -1, LEAST, MOST]
    texts = ["a b", "ab", "a b", "c", "c", "d"]
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_duplicates(docs(spark, texts, ids)).collect())
    assert got == brute_exact(list(zip(ids, texts, strict=True)))


def test_near_takes_any_doc_id_and_judges_repeated_ones_by_their_own_texts(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue black white grey")
    rows = [(3, a), (5, a), (5, b), (7, b), (LEAST, c), (MOST, c), (9, a + " more words here"), (9, "one two three four five six"), (None, a), (11, None)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs(spark, [t for _, t in rows], [i for i, _ in rows])).collect()), key=repr)
    want = [(3, 2, 3, True), (5, 2, 3, False), (5, 2, 5, True), (7, 2, 5, False), (LEAST, 2, LEAST, True), (MOST, 2, LEAST, False), (9, 5, 9, True), (9, 2, 5, False), (None, 2, None, True), (11, 0, 11, True)]
    assert got == sorted(want, key=repr)


def test_dedup_stages_lose_no_text_and_keep_one_row_of_each(spark):
    """Repeated, null and extreme ids: the kept rows are those of a plain-Python model over row numbers."""
    import corpus_pipeline

    rnd = random.Random(6)
    base = [" ".join(words(rnd, 40)) for _ in range(12)]
    rows = [(3, "same text here"), (5, "same text here"), (5, "a wholly unique text"), (LEAST, base[0]), (MOST, base[0]), (None, base[1]), (None, base[2]), (None, base[1])]
    rows += [(rnd.choice([None, 1, 1, 2, 7, 40 + k]), rnd.choice([base[k % 12], base[k % 12].replace(" ", "  "), base[k % 12] + f" end{k % 3}"])) for k in range(60)] + [(8, None), (8, ""), (8, None)]
    frame = docs(spark, [t for _, t in rows], [i for i, _ in rows]).selectExpr("*", "1 as nth", "2 as row", "3 as position")
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    best = {}
    for at, k in enumerate(order):
        key = norm(rows[k][1])
        best[key] = min(best.get(key, (1, 0)), (-len(rows[k][1] or ""), at))
    exact = corpus_pipeline.exact_duplicates(spark, frame, "")
    assert exact.columns == frame.columns
    got = exact.collect()
    kept = [rows[order[at]] for _, at in best.values()]
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted(kept, key=repr)
    near_kept = corpus_pipeline.near_duplicates(spark, frame, "").collect()
    comps = brute_components([rows[k][1] for k in order])[1]
    of_text = {rows[k][1]: comps[at] for at, k in enumerate(order)}
    no_words = [at for at, k in enumerate(order) if not shingle_set(rows[k][1])]
    assert sorted(of_text[r["text"]] for r in near_kept if shingle_set(r["text"])) == sorted(set(comps) - set(no_words))
    assert sorted(repr(r["doc_id"]) for r in near_kept) == sorted(repr(rows[order[at]][0]) for at in {*comps, *no_words})
    empty = frame.limit(0)
    assert corpus_pipeline.exact_duplicates(spark, empty, "").count() == corpus_pipeline.near_duplicates(spark, empty, "").count() == 0


def test_near_texts_assembled_from_few_passages(spark):
    """Every shingle is shared by many texts: what many share is taken apart by further tokens, and no link is lost."""
    rnd = random.Random(21)
    passages_ = [" ".join(words(rnd, 40, 10**6)) for _ in range(12)]
    texts = [" ".join(rnd.sample(passages_, rnd.choice([4, 5, 6]))) for _ in range(500)]
    sizes, comps, _ = near(spark, texts)
    assert (sizes, comps) == brute_components(texts)


def test_near_dense_pairs_make_few_rows_of_many_alike_lists(spark):
    rnd = random.Random(22)
    passages_ = [" ".join(words(rnd, 60, 10**6)) for _ in range(20)]
    texts = [" ".join(rnd.sample(passages_, 5)) for _ in range(5000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    dense = near_dedup.describe(rows).selectExpr("doc_id as cls", "n", "doc_id as comp")
    tokens = near_dedup._tokens(dense, rows, 5)
    got = {(r["a"], r["b"]) for r in near_dedup._dense_pairs(tokens, 75).collect()}
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in got:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    sets = [shingle_set(t) for t in texts]
    sample = rnd.sample(range(5000), 60)
    for i in sample:
        for j in range(5000):
            if i != j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                assert find(i) == find(j)
    assert len(got) < 5000 * 5000 / 2 / 10

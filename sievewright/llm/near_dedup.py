"""MinHash near-dedup on word shingles.

One hash function orders all shingles; a document keeps the bottom K of its set. Inverted lists of the retained values
generate the overlaps, the bottom K of the union of two sketches estimates their similarity, and the full sets, built
again from the whole texts, confirm every link.

No list is expanded into all its pairs:

1. Documents with equal sets are one class from the start.
2. Star rounds tie the members of a list to one member, the one whose values are the most shared. What a star links is
   contracted, so that groups of copies become single components after linear work.
3. Only pairs of different components remain. A list with at most FEW of these emits them.
4. Longer lists come from passages that many unlike documents share. A document of which they hold no more than a quarter
   has values enough in short lists. The others are joined by prefix filter: with the shingles of each in order of their
   number of documents, two sets as similar as asked must meet before what is left of either is too little. This is exact
   and leaves shared passages to the end, where they need not be looked up. Shingles that lie in the same documents are one
   token with a weight, and where many documents meet in one token, they are dealt out again by the next token that they
   have in common, as often as it takes (`_dense_pairs`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import bounded, cut, in_batches, numbered, repeated_ids, text_or_empty
from .components import connected_components
from .textkit import Words, mix, shingles

K = 64
#: Values of a sketch that make keys. Two sets of similarity .75 share none of them with a chance of .25**24.
KEYS = 24
#: Pairs of different components up to which a list emits them.
FEW = 512
#: Rows up to which a key of the prefix filter may emit its pairs, if going on would make more rows than these.
PAIR_ROWS = 8192
#: A share of common values in the union's bottom K below which a pair is no candidate; at a similarity of .75 the chance of
#: 28 or fewer of 64 is about 10**-7.
LEAST_ESTIMATE = 0.44


def describe(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, n, sig1, sig2, sketch): set size, a 128-bit signature of the set, its K least hashes in order."""

    def work(batch: pa.RecordBatch) -> dict:
        sets = shingles(Words(batch.column("text"), lower=True), width)
        sizes = np.array([len(s) for s in sets], np.int64)
        sig = [np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)]
        if sizes.sum():
            every = np.concatenate(sets)
            at = np.flatnonzero(sizes)
            starts = np.r_[0, np.cumsum(sizes)[:-1]][at]
            sig[0][at] = np.add.reduceat(mix(every + np.uint64(0x51ED270B)), starts)
            sig[1][at] = np.bitwise_xor.reduceat(mix(every * np.uint64(0x2545F4914F6CDD1D)), starts)
        short = [s[:K] for s in sets]
        offsets = np.r_[0, np.cumsum([len(s) for s in short])].astype(np.int32)
        flat = (np.concatenate(short) if short else np.zeros(0, np.uint64)).view(np.int64)
        return {"doc_id": batch.column("doc_id"), "n": sizes, "sig1": sig[0].view(np.int64), "sig2": sig[1].view(np.int64), "sketch": pa.ListArray.from_arrays(offsets, flat)}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return in_batches(rows, "doc_id long, n long, sig1 long, sig2 long, sketch array<long>", work, by="text")


def _estimates(a: pa.ListArray, b: pa.ListArray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Share of common values among the bottom K of both sketches' union; exact where both sets are whole in them."""
    out = np.zeros(len(na))
    for i, (x, y) in enumerate(zip(_arrays(a), _arrays(b), strict=True)):
        both = np.sort(np.concatenate((x, y)))
        twice = both[1:] == both[:-1]
        new = np.r_[True, ~twice]
        rank = np.cumsum(new)
        k = rank[-1] if na[i] <= K and nb[i] <= K else min(K, rank[-1])
        out[i] = np.count_nonzero(twice & (rank[1:] <= k)) / k
    return out


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    flat, off = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    return [flat[i:j] for i, j in zip(off[:-1], off[1:], strict=True)]


def estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, whole) of the pairs that the union of their sketches doesn't rule out; whole: the sketches are the sets."""
    left = classes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    def work(batch: pa.RecordBatch) -> dict:
        na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
        e = _estimates(batch.column("sa"), batch.column("sb"), na, nb)
        whole = (na <= K) & (nb <= K)
        ok = np.where(whole, e >= 0.75 - 1e-9, e >= LEAST_ESTIMATE)
        return {"a": batch.column("a").filter(ok), "b": batch.column("b").filter(ok), "whole": whole[ok]}

    return in_batches(pairs.join(left, "a").join(right, "b"), "a long, b long, whole boolean", work)


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the documents in ids, once each; ids is broadcast if it is known to be small."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text"))
    return rows.join(bounded(ids), "id", "left_semi")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as asked, computed from the whole texts."""
    texts = cut(_texts(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()))
    joined = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")

    def work(batch: pa.RecordBatch) -> dict:
        ids = batch.column("a").to_numpy()
        sb = shingles(Words(batch.column("tb"), lower=True), width)
        new = np.r_[True, ids[1:] != ids[:-1]]  # pairs of one leader come together: its text is cut once
        sa = shingles(Words(batch.column("ta").filter(pa.array(new)), lower=True), width)
        at = np.cumsum(new) - 1
        ok = np.zeros(len(ids), bool)
        for i, y in enumerate(sb):
            x = sa[at[i]]
            common = len(np.intersect1d(x, y, assume_unique=True))
            ok[i] = common > 0 and 100 * common >= threshold * (len(x) + len(y) - common)
        return {"a": batch.column("a").filter(ok), "b": batch.column("b").filter(ok)}

    return in_batches(joined.select("a", "ta", "b", "tb"), "a long, b long", work, max_bytes=1 << 19, by="tb")


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, threshold: int) -> DataFrame:
    likely = cut(estimated(pairs, classes))
    return cut(likely.where("whole").select("a", "b").unionByName(confirmed(likely.where("not whole").select("a", "b"), docs, width, threshold)))


def _sized(threshold: int):
    """Sizes so different that the smaller set can't be the share of the union that is asked for."""
    return F.expr(f"100 * least(na, nb) >= {threshold} * greatest(na, nb)")


def _stars(lists: DataFrame, threshold: int) -> DataFrame:
    """(a, b), a the leader: the member of each list that shares the most values with others, by its lists' lengths."""
    shared = lists.groupBy("cls").agg(F.sum("members").alias("shared"))
    known = lists.join(shared, "cls")
    leaders = cut(known.groupBy("value").agg(F.max(F.struct("shared", F.bitwise_not("cls").alias("not_cls"), "n", "comp")).alias("lead")))
    pairs = lists.join(leaders, "value").select(F.bitwise_not("lead.not_cls").alias("a"), F.col("cls").alias("b"), F.col("lead.n").alias("na"), F.col("n").alias("nb"), F.col("lead.comp").alias("ca"), F.col("comp").alias("cb"))
    return pairs.where("ca <> cb").where(_sized(threshold)).select("a", "b").distinct()


def _lists(keys: DataFrame) -> DataFrame:
    """Members of the lists that hold more than one component: value, cls, n, comp, members."""
    # Counted into a table of its own: a join of two plain exchanges can split the rows of a hot value over tasks.
    multiple = cut(keys.groupBy("value").agg(F.count("*").alias("members"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("value", "members"))
    return cut(keys.select("value", "cls", "n", "comp").join(multiple, "value"))


def _relabel(lists: DataFrame, links: DataFrame) -> DataFrame:
    comp = connected_components(links).select(F.col("node").alias("cls"), "component")
    return lists.select("value", "cls", "n").join(comp, "cls", "left").select("value", "cls", "n", F.coalesce("component", "cls").alias("comp"))


def _tokens(dense: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """dense (cls, n, comp) with tokens, an array of (df, token, w, left), rarest first; left is the weight of a token and all after it.

    A token stands for all shingles that lie in the same documents, w of them. Shingles of one document only are left out.
    """

    def work(batch: pa.RecordBatch) -> dict:
        sets = shingles(Words(batch.column("text"), lower=True), width)
        counts = np.array([len(s) for s in sets], np.int64)
        flat = (np.concatenate(sets) if sets else np.zeros(0, np.uint64)).view(np.int64)
        return {"cls": np.repeat(batch.column("id").to_numpy(), counts), "shingle": flat}

    sets = cut(in_batches(_texts(docs, dense.select(F.col("cls").alias("id"))), "cls long, shingle long", work, max_bytes=1 << 19, by="text"))
    of = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "cls"))
    held = cut(sets.groupBy("shingle").agg(F.count("*").alias("df"), of(3).alias("h1"), of(5).alias("h2")).where("df > 1"))
    weighed = sets.join(held, "shingle").groupBy("cls", "df", "h1", "h2").agg(F.count("*").alias("w"), F.min("shingle").alias("token"))
    rarest_last = Window.partitionBy("cls").orderBy(F.desc("df"), F.desc("token")).rowsBetween(Window.unboundedPreceding, 0)
    left = weighed.withColumn("left", F.sum("w").over(rarest_last))
    return cut(left.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "token", "w", "left"))).alias("tokens")).join(dense, "cls"))


def _need(threshold: int, n: str, other: str) -> str:
    """SQL of the least intersection of sets of these sizes that is similar enough."""
    return f"cast(ceil({threshold} * ({n} + {other}) / {100.0 + threshold} - 1e-9) as long)"


def _dense_pairs(tokens: DataFrame, threshold: int) -> DataFrame:
    """(a, b): the pairs of different components that the tokens (see _tokens) don't rule out, and pairs that join the same components.

    A row says that a class has the tokens of a key, of weight `have`, the last of them at place `at`. It is there if `have`
    and what is left after `at` are enough for a partner of any size, so two similar sets have rows under the key of the
    first tokens that they share, whatever its length. Keys of few rows emit their pairs, and so do keys of up to PAIR_ROWS
    if the rows that they would make on their way, about half the square of what is left of each, are more than these
    pairs. In the others the smallest set leads: a member whose `have` is enough for the leader is tied to it, and two such
    members are in one component by that. A member that isn't tied must share a further token with any partner, so the
    key's rows go on to keys one token longer: what many share is taken apart until few share it, or what they share is enough.
    """
    alone = f"cast(ceil({threshold} * n / 100.0 - 1e-9) as long)"
    after = lambda start: F.posexplode(F.slice("tokens", start + 1, F.size("tokens"))).alias("ahead", "t")
    next_row = ["cls", "n", "comp", "at", "have", (F.col("t.left") - F.col("t.w")).alias("rest"), (F.size("tokens") - F.col("at") - 1).cast("long").alias("more")]
    rows = tokens.select("*", after(F.lit(0))).where(f"t.left >= {alone}").withColumns({"at": F.col("ahead"), "have": F.col("t.w")}).select(F.col("t.token").alias("key"), *next_row)
    found = []
    while True:
        rows = cut(rows)
        of_key = rows.groupBy("key").agg(F.count("*").alias("m"), F.sum(F.expr("more * more")).alias("grow"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct("n", "cls", "comp")).alias("lead"))
        of_key = cut(of_key.where("lo <> hi").select("key", "lead", F.expr(f"m <= {FEW} or (m <= {PAIR_ROWS} and m * (m - 1) <= grow)").alias("few")))
        met = cut(rows.join(of_key, "key"))
        left = met.where("few").select("key", "have", *(F.col(c).alias(x) for c, x in (("cls", "a"), ("n", "na"), ("comp", "ca"), ("rest", "ra"))))
        right = met.where("few").select("key", *(F.col(c).alias(x) for c, x in (("cls", "b"), ("n", "nb"), ("comp", "cb"), ("rest", "rb"))))
        pairs = left.join(right, "key").where("a < b and ca <> cb").where(_sized(threshold)).where(f"have + least(ra, rb) >= {_need(threshold, 'na', 'nb')}")
        many = met.where("not few").withColumn("tied", F.expr(f"have >= {_need(threshold, 'n', 'lead.n')}"))
        ties = many.where("tied and comp <> lead.comp").select(F.least("cls", "lead.cls").alias("a"), F.greatest("cls", "lead.cls").alias("b"))
        found.append(cut(pairs.select("a", "b").unionByName(ties).distinct()))
        loose = many.where("not tied")
        if loose.isEmpty():
            return _all(found).distinct()
        # No partner is smaller than the leader, nor than the share of n that is asked for.
        going = many.join(loose.select("key").distinct(), "key").withColumn("least", F.expr(f"greatest({alone}, {_need(threshold, 'n', 'lead.n')})"))
        on = going.join(tokens.select("cls", "tokens"), "cls").select("*", after(F.col("at") + 1)).where("have + t.left >= least")
        rows = on.withColumns({"key": F.xxhash64("key", "t.token"), "at": F.col("at") + 1 + F.col("ahead"), "have": F.col("have") + F.col("t.w")}).select("key", *next_row)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text; further columns don't matter).

    Links join documents whose distinct shingles have 100 * intersection >= threshold * union. component_id is the least
    doc_id reachable over links, kept is doc_id = component_id. Null and empty texts, and texts without words, have an
    empty set and are linked with nothing; a text of fewer words than width has its whole sequence as one shingle. Rows
    with a null doc_id are nobody's copy: component_id null, kept true. Rows that repeat a doc_id are judged each by its own
    text, so that unlike texts of one doc_id may have different components. An empty table gives an empty result. Texts of
    any length are read whole. threshold is 60 or more: KEYS and LEAST_ESTIMATE are set for 75.
    """
    if not repeated_ids(docs):
        return _judged(docs, width, threshold)
    rows = numbered(docs.select("doc_id", "text"))
    judged = _judged(rows.select(F.when(F.col("row.doc_id").isNotNull(), F.col("nth")).alias("doc_id"), F.col("row.text").alias("text")), width, threshold)
    names = cut(rows.select("nth", F.col("row.doc_id").cast("long").alias("name")))
    told = judged.join(names.toDF("doc_id", "_own"), "doc_id", "left").join(names.toDF("component_id", "_least"), "component_id", "left")
    return told.select(F.col("_own").alias("doc_id"), "n_shingles", F.col("_least").alias("component_id"), F.coalesce(F.col("_own") == F.col("_least"), F.lit(True)).alias("kept"))


def _judged(docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """near_duplicates of documents whose doc_ids, but for null, are unique: the least of a class names it."""
    described = cut(describe(docs, width))
    classes = cut(described.where("n > 0 and doc_id is not null").groupBy("sig1", "sig2", "n").agg(F.min("doc_id").alias("cls"), F.first("sketch").alias("sketch")))
    keys = classes.select(F.explode(F.slice("sketch", 1, KEYS)).alias("value"), "cls", "n", F.col("cls").alias("comp"))
    lists, found = _lists(keys), []
    for _ in range(2):
        found.append(_links(_stars(lists, threshold), classes, docs, width, threshold))
        so_far = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        lists = _lists(_relabel(lists, so_far))

    sizes = cut(lists.groupBy("value", "comp").agg(F.count("*").alias("s")).groupBy("value").agg(F.expr("(sum(s) * sum(s) - sum(s * s)) / 2").alias("pairs")))
    sized = cut(lists.join(sizes, "value").select("value", "cls", "n", "comp", "pairs"))
    few, many = sized.where(f"pairs <= {FEW}"), sized.where(f"pairs > {FEW}")
    a = few.select("value", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))
    b = few.select("value", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    short = a.join(b, "value").where("a < b and ca <> cb").where(_sized(threshold)).select("a", "b").distinct()
    dense = cut(many.groupBy("cls", "n", "comp").agg(F.count("*").alias("hot")).where(f"4 * hot > least(n, {KEYS})").select("cls", "n", "comp"))
    pairs = short.unionByName(_dense_pairs(_tokens(dense, docs, width), threshold)).distinct()
    found.append(_links(pairs, classes, docs, width, threshold))

    comps = connected_components(found[0].unionByName(found[1]).unionByName(found[2])).select(F.col("node").alias("cls"), "component")
    of_class = classes.select("sig1", "sig2", "n", "cls").join(comps, "cls", "left").select("sig1", "sig2", "n", F.coalesce("component", "cls").alias("of_class"))
    rows = described.select("doc_id", "n", "sig1", "sig2").join(of_class, ["sig1", "sig2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("of_class")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

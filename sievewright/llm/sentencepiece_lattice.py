"""SentencePiece encoding and decoding by a relational lattice.

Encoding is a matter of words: no piece reaches over the start of a word, so a text's ids are those of its words in a row.
The lattice of a word holds an edge for each substring that is a piece. `encode_words` builds it relationally: substrings of
bounded length are exploded, joined to the piece table by equality, grouped by word and folded by Spark's higher-order
`aggregate`. A unigram model's fold is Viterbi's. A BPE model's scores are merge ranks, not log probabilities, and a best
path over their sum is not what the model means; its fold merges neighbouring edges, best rank first and leftmost in ties.

`encode` needs ids for every word of a text at its place. Distinct words grow with the corpus and sending their ids back to
each document would move more bytes than the texts have, so the relational lattice encodes the most frequent words, a
dictionary of bounded size, and words beyond it are folded where they are met, by the same lattice in arrays. The fold of
a BPE model in Spark's `aggregate` looks through all edges at each merge, so words of more than LONGEST_WORD characters are left
out of the dictionary too; the fold in arrays takes n log n steps for them.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import in_batches, release, session, slices, text_or_empty

#: The mark that stands for a blank. Fixed value of the format.
MARK = "▁"
#: Control characters that end a word like a blank does, unless some longer piece has them.
APART = "\n\t\r\x0b\x0c"
#: Frequent words that the relational lattice encodes for the dictionary.
DICTIONARY_WORDS = 100_000
#: Other words that a worker remembers.
REMEMBERED = 60_000
#: Characters of the longest words that are put into the dictionary, folded many at once in arrays, and remembered.
LONGEST_WORD = 48


@dataclass
class Pieces:
    """The model's pieces: those that match text, bytes for characters without one, and what every id decodes to."""

    kind: str
    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    unknown: int
    spelled: list[bytes]
    longest: int = 0
    apart: str = ""
    words: re.Pattern = field(default=None, repr=False)

    def __post_init__(self):
        self.longest = max(map(len, self.ids), default=1)
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        self.apart = "".join(c for c in APART if c not in joined)
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece goes over the start of a word")
        no = re.escape(MARK + self.apart)
        self.words = re.compile(rf"{MARK}*[^{no}]+|{MARK}+|[{re.escape(self.apart)}]" if self.apart else rf"{MARK}*[^{no}]+|{MARK}+")

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unknown]


def load(model_file: str) -> Pieces:
    """The pieces of a SentencePiece model whose normaliser is the identity, with a blank put before the text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    plain = [i for i in range(len(names)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    bytes_ = {names[i]: i for i in range(len(names)) if sp.is_byte(i)}
    spelled = [bytes([int(n[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else names[i].replace(MARK, " ").encode() for i, n in enumerate(names)]
    scores = {names[i]: sp.get_score(i) for i in plain}
    merges = all(s <= 0 and float(s).is_integer() for s in scores.values())
    return Pieces("bpe" if merges else "unigram", {names[i]: i for i in plain}, scores, [bytes_[f"<0x{b:02X}>"] for b in range(256)] if len(bytes_) == 256 else [], sp.unk_id(), spelled)


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """(piece, id, score): as many rows as the model has pieces."""
    return spark.createDataFrame([(p, i, float(pieces.scores[p])) for p, i in pieces.ids.items()], "piece string, id int, score double")


def _viterbi(edges: Column, length: Column) -> Column:
    """The ids on the best path from 0 to length. Edges come by start, so all that end at a place come before those that leave it."""
    none = F.struct(F.lit(float("-inf")).alias("s"), F.array().cast("array<int>").alias("path"))
    zero = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<int>").alias("path"))
    start = F.concat(F.array(zero), F.transform(F.sequence(F.lit(1), length), lambda _: none))

    def relax(best: Column, e: Column) -> Column:
        reach = F.get(best, e["start"])
        total = reach["s"] + e["score"]
        return F.transform(best, lambda b, k: F.when((k == e["end"]) & (total > b["s"]), F.struct(total.alias("s"), F.concat(reach["path"], e["ids"]).alias("path"))).otherwise(b))

    return F.aggregate(edges, start, relax, lambda best: F.get(best, length)["path"])


def _merge(edges: Column, length: Column) -> Column:
    """The ids left after merging neighbours, best score first, leftmost in ties, until no two neighbours make a piece."""
    start = F.sequence(F.lit(0), length)

    def merge(at: Column, _: Column) -> Column:
        fits = F.filter(edges, lambda e: F.get(at, F.nullif(F.array_position(at, e["start"]).cast("int"), F.lit(0)) + 1) == e["end"])
        best = F.array_min(F.transform(fits, lambda e: F.struct((-e["score"]).alias("cost"), e["start"].alias("start"))))
        return F.coalesce(F.array_remove(at, F.get(at, F.array_position(at, best["start"]).cast("int"))), at)

    def ids(at: Column) -> Column:
        spans = F.transform(F.slice(at, F.lit(1), F.size(at) - 1), lambda a, k: F.filter(edges, lambda e: (e["start"] == a) & (e["end"] == F.get(at, k + 1)))[0]["ids"])
        return F.flatten(spans)

    return F.aggregate(F.sequence(F.lit(1), length), start, merge, ids)


def encode_words(words: DataFrame, table: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) for each distinct non-empty word of words (word). Blanks are marks already. A BPE fold's steps go with about the
    cube of a word's length: words of more than some hundred characters belong to Lattice.

    The piece table is as large as the model and is broadcast; words stay where they are dealt out by word, so the group
    needs no second shuffle. A character that is no piece has its bytes' ids (or the unknown id) and joins nothing; to
    Viterbi it costs ten more than the worst piece. Null words are left out.
    """
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, or a small table would end in one task
    distinct = words.where("word is not null and word <> ''").select("word").repartition(tasks, "word").distinct()
    starts = distinct.select("word", F.length("word").alias("length"), F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("start"))
    parts = starts.select("word", "length", "start", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("length"), F.col("start") + pieces.longest))).alias("end"))
    parts = parts.withColumn("part", F.expr("substring(word, start + 1, end - start)"))
    known = parts.join(F.broadcast(table.withColumnRenamed("piece", "part")), "part", "left").where("id is not null or end = start + 1")
    worst = min(pieces.scores.values(), default=0.0) - 10
    if pieces.byte_ids:
        code = F.encode(F.col("part"), "UTF-8")
        bytes_ = F.transform(F.sequence(F.lit(1), F.octet_length("part")), lambda k: F.element_at(F.array(*map(F.lit, pieces.byte_ids)), F.conv(F.hex(F.substring(code, k, F.lit(1))), 16, 10).cast("int") + 1))
    else:
        bytes_ = F.array(F.lit(pieces.unknown))
    edge = F.struct("start", "end", F.coalesce("score", F.lit(worst)).alias("score"), F.when(F.col("id").isNotNull(), F.array("id")).otherwise(bytes_).alias("ids"))
    lattice = known.select("word", "length", edge.alias("edge")).groupBy("word", "length").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    fold = _viterbi if pieces.kind == "unigram" else _merge
    return lattice.select("word", F.transform(F.array(F.struct("edges", "length")), lambda x: fold(x["edges"], x["length"]))[0].alias("ids"))


class Lattice:
    """The same lattice for many words at once, in arrays: an edge table over (word, start, length) and a fold over all words.

    Substrings are found by walking a trie of the pieces from every place at once. A step's key is the node and the code
    point, whole, so that no two steps share one.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        order = sorted(set(pieces.scores.values()), reverse=True)
        rank = {s: r for r, s in enumerate(order)}
        self.rank = np.zeros(max(pieces.ids.values(), default=0) + 2, np.int64)
        steps: dict[int, int] = {}
        piece_at = [-1]
        for name, i in pieces.ids.items():
            self.rank[i] = rank[pieces.scores[name]]
            at = 0
            for c in name:
                key = at << 21 | ord(c)
                at = steps.setdefault(key, len(piece_at))
                if at == len(piece_at):
                    piece_at.append(-1)
            piece_at[at] = i
        self.piece_at = np.array(piece_at, np.int32)
        self.keys, self.nodes = np.array(list(steps), np.uint64), np.array(list(steps.values()), np.int32)
        self.levels, rest = [], np.arange(len(steps))
        while len(rest):  # each level takes the keys that have a slot of their own, the others go on to the next one
            step = np.uint64(0x9E3779B97F4A7C15 + 2 * len(self.levels) * 0x1234567)
            slot = (self.keys[rest] * step) >> np.uint64(45)
            _, first = np.unique(slot, return_index=True)
            table = np.full(1 << 19, -1, np.int32)
            table[slot[first]] = rest[first]
            self.levels.append((step, table))
            rest = np.delete(rest, first)

    def _step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The nodes that chars lead to, -1 for none. A key is sought in the next level only if another one has its slot."""
        key = nodes.astype(np.uint64) << np.uint64(21) | chars
        out = np.full(len(key), -1, np.int32)
        at = None
        for step, table in self.levels:
            taken = table[(key * step) >> np.uint64(45)]
            full = np.flatnonzero(taken >= 0)
            taken, key = taken[full], key[full]
            at = full if at is None else at[full]
            hit = self.keys[taken] == key
            out[at[hit]] = self.nodes[taken[hit]]
            at, key = at[~hit], key[~hit]
            if not len(at):
                break
        return out

    def encode(self, words: list[str]) -> list[tuple[int, ...]]:
        if self.pieces.kind == "unigram":
            return [self._best_path(w) for w in words]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out: list = [()] * len(words)
        for lo, hi in ((0, 8), (8, 12), (12, 16), (16, 24), (24, LONGEST_WORD)):
            at = np.flatnonzero((lengths > lo) & (lengths <= hi))
            for k in range(0, len(at), 2048):
                part = at[k : k + 2048]
                for i, ids in zip(part.tolist(), self._merged([words[i] for i in part], lengths[part], hi), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(lengths > LONGEST_WORD).tolist():
            out[i] = self._long(words[i])
        return out

    def _merged(self, words: list[str], n: np.ndarray, width: int) -> list[tuple[int, ...]]:
        """Arrays have a row for each place and a column for each word, so that the least of all costs is taken for many words at once."""
        count, most = len(words), min(self.pieces.longest, width)
        n = n.astype(np.int32)
        inside = np.arange(width)[:, None] < n[None, :]
        chars = np.zeros((count, width), np.uint64)
        chars[inside.T] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = np.ascontiguousarray(chars.T)
        edge = np.full((most + 1, width, count), -1, np.int32)
        start, of = np.nonzero(inside)
        node = np.zeros(len(start), np.int32)
        for size in range(1, most + 1):
            node = self._step(node, chars[start + size - 1, of])
            on = node >= 0
            start, of, node = start[on], of[on], node[on]
            edge[size, start, of] = self.piece_at[node]
            more = start + size < n[of]
            start, of, node = start[more], of[more], node[more]
        none = np.int32(np.iinfo(np.int32).max)
        rank = (self.rank * 64).astype(np.int32)
        cost = np.full((width, count), none)
        pair = edge[2, : width - 1]
        cost[: width - 1] = np.where(pair >= 0, rank[pair] + np.arange(width - 1, dtype=np.int32)[:, None], none)
        after = np.arange(1, width + 1, dtype=np.int32)[:, None].repeat(count, 1)
        before = np.arange(-1, width - 1, dtype=np.int32)[:, None].repeat(count, 1)
        alive = inside.copy()

        def weigh(w: np.ndarray, i: np.ndarray, mid: np.ndarray) -> None:
            """The cost of merging the symbol of word w that goes from i to mid with the next one."""
            has = mid < n[w]
            size = np.where(has, after[np.minimum(mid, width - 1), w] - i, 0)
            size[size > most] = 0
            ids = edge[size, i, w]  # size 0 has no edges
            cost[i, w] = np.where(ids >= 0, rank[ids] + i, none)

        while True:
            least = cost.min(0)
            w = np.flatnonzero(least < none)
            if not len(w):
                break
            i = least[w] & 63
            mid = after[i, w]
            end = after[mid, w]
            after[i, w] = end
            alive[mid, w] = False
            cost[mid, w] = none
            behind = end < n[w]
            before[end[behind], w[behind]] = i[behind]
            weigh(w, i, end)
            prev = before[i, w]
            front = prev >= 0
            weigh(w[front], prev[front], i[front])
        w, i = np.nonzero(alive.T)
        ids = edge[np.minimum(after[i, w] - i, most), i, w]
        flat, split = ids.tolist(), np.searchsorted(w, np.arange(count + 1)).tolist()
        out = [tuple(flat[a:b]) for a, b in zip(split[:-1], split[1:], strict=True)]
        places = i.tolist()
        for k in np.unique(w[ids < 0]).tolist():
            a, b = split[k], split[k + 1]
            out[k] = tuple(x for p, at in zip(flat[a:b], places[a:b], strict=True) for x in ((p,) if p >= 0 else self.pieces.fallback(words[k][at])))
        return out

    def _long(self, word: str) -> tuple[int, ...]:
        """A heap instead of arrays, for words of any length: n log n."""
        ids, rank = self.pieces.ids, self.rank
        n = len(word)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            if after[i] < n and (end := after[after[i]]) - i <= self.pieces.longest and (k := ids.get(word[i:end])) is not None:
                heapq.heappush(heap, (int(rank[k]), i, end))

        for i in range(n):
            offer(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or after[after[i]] != end:
                continue
            alive[after[i]] = False
            after[i] = end
            if end < n:
                before[end] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out: list[int] = []
        for i in range(n):
            if alive[i]:
                k = ids.get(word[i : after[i]])
                out += self.pieces.fallback(word[i]) if k is None else [k]
        return tuple(out)

    def _best_path(self, word: str) -> tuple[int, ...]:
        ids, scores, worst = self.pieces.ids, self.pieces.scores, min(self.pieces.scores.values(), default=0.0) - 10
        best: list[tuple[float, int, tuple[int, ...]]] = [(0.0, 0, ())] + [(float("-inf"), 0, ())] * len(word)
        for i in range(len(word)):
            for j in range(i + 1, min(len(word), i + self.pieces.longest) + 1):
                k = ids.get(word[i:j])
                if k is None and j > i + 1:
                    continue
                total = best[i][0] + (worst if k is None else scores[word[i:j]])
                if total > best[j][0]:
                    best[j] = (total, i, tuple(self.pieces.fallback(word[i])) if k is None else (k,))
        out: list[int] = []
        at = len(word)
        while at:
            _, i, own = best[at]
            out[:0] = own
            at = i
        return tuple(out)


def _words_of(text: str, pieces: Pieces) -> list[str]:
    return pieces.words.findall(MARK + text.replace(" ", MARK)) if text else []


def frequent_words(docs: DataFrame, pieces: Pieces, most: int = DICTIONARY_WORDS, hold: int = 200_000) -> DataFrame:
    """(word): about the most frequent words of up to LONGEST_WORD characters. Tasks count in tables of at most `hold` words and let go of what they saw once or twice, which only makes the choice a little less exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            often = {w: n for w, n in seen.items() if n > 2}
            seen.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array(list(often), pa.string()), "n": pa.array(list(often.values()), pa.int64())})

        for batch in batches:
            for text in batch.column("text"):
                seen.update(w for w in _words_of(text.as_py(), pieces) if len(w) <= LONGEST_WORD)
                if len(seen) > hold:
                    yield out()
        yield out()
        release()

    session(docs)
    counted = docs.select(text_or_empty().alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.orderBy(F.desc("n"), "word").limit(most).select("word")


def encode(docs: DataFrame, pieces: Pieces, keep: tuple[str, ...] = ("doc_id",), dictionary_words: int = DICTIONARY_WORDS, check: bool = True) -> DataFrame:
    """docs' columns `keep`, ids array<int>, and with `check` round_trip: the ids decode to the text again.

    Null and empty texts have no ids. A mark in a text is read as a blank, as the format has it. Texts of any length, and words
    of any length in them, are read whole; the result of a text doesn't depend on other rows or on which words are in the
    dictionary. Rows that repeat a doc_id, or have none, are rows like others. Columns of docs that aren't in `keep` change
    nothing, whatever their names. An empty table gives an empty result.
    """
    spark = session(docs)
    frequent = encode_words(frequent_words(docs, pieces, dictionary_words), piece_table(spark, pieces), pieces).toPandas()
    words, ids = frequent["word"].tolist(), [tuple(map(int, x)) for x in frequent["ids"]]
    shared = spark.sparkContext.broadcast((pieces, dict(zip(words, ids, strict=True))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, dictionary = shared.value
        lattice, known = Lattice(own), dict(dictionary)
        for batch in batches:
            for part in slices(batch, "_text", 1 << 19):
                texts = part.column("_text").to_pylist()
                split = [_words_of(t, own) for t in texts]
                met = set().union(*split)
                if len(known) - len(dictionary) > REMEMBERED:
                    known = dict(dictionary)
                new = list(met.difference(known))
                known.update(zip(new, lattice.encode(new), strict=True))
                long = [w for w in new if len(w) > LONGEST_WORD]
                coded = [list(chain.from_iterable(map(known.__getitem__, ws))) for ws in split]
                cols = {c: part.column(c) for c in keep} | {"ids": pa.array(coded, pa.list_(pa.int32()))}
                if check:
                    cols["round_trip"] = [decode_ids(i, own) == t.replace(MARK, " ") for i, t in zip(coded, texts, strict=True)]
                for w in long:
                    del known[w]
                del texts, split, met, coded
                yield pa.RecordBatch.from_pydict(cols)
        release()

    rows = docs.select(*keep, text_or_empty().alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}, ids array<int>{', round_trip boolean' if check else ''}")


def decode_ids(ids: list[int], pieces: Pieces) -> str:
    """The text of ids: pieces in a row, bytes joined to characters (U+FFFD for what is none), without the leading blank."""
    spelled = pieces.spelled
    text = b"".join([spelled[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def decode(coded: DataFrame, pieces: Pieces, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """coded's columns `keep` and text, from ids array<int>; null ids have a null text, ids outside the model none."""

    def work(batch: pa.RecordBatch) -> dict:
        known = range(len(pieces.spelled))
        texts = [None if x is None else decode_ids([i for i in x if i in known], pieces) for x in batch.column("ids").to_pylist()]
        return {c: batch.column(c) for c in keep} | {"text": pa.array(texts, pa.string())}

    rows = coded.select(*keep, "ids")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return in_batches(rows, f"{kept}, text string", work)

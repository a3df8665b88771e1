"""URL filters: explicit rules first, gradient-boosted trees on lexical features for the rest.

The features are lengths, depth, digit shares, entropies, parameter counts and suffix statistics; no word of a host is looked
up. They are Column expressions; only the trees run in Python, on Arrow columns of numbers and two short strings.
"""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import in_batches

SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (action, rule): the production rules. Fixed values.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("allow", "example.net/de/8"), ("block", "org/es/")]

#: Features that are numbers of the URL alone, in order; after them come the statistics of its suffixes.
LEXICAL = ["length", "host_length", "path_length", "labels", "depth", "digit_ratio", "host_digits", "hyphens", "host_entropy", "path_entropy", "parameters", "parameter_length", "escapes", "fragment", "longest_label"]
#: Characters at the end of a host's name whose statistics are kept.
ENDINGS = (2, 3)
FEATURE_NAMES = [*LEXICAL, "suffix_rate", "suffix_count", "end_count", *(f"end{k}_rate" for k in ENDINGS)]


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, SPLIT, 1), UPPER, LOWER), F.regexp_extract(text, SPLIT, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (host/path) that fits the host or a domain above it and begins the path; null if none does."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of, _, rest = rule.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(f"/{rest}")
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


_LOWER = str.maketrans(UPPER, LOWER)


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def _parts(url: str | None) -> tuple[str, str, str, str]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", "", "", ""
    rest, _, fragment = rest.partition("#")
    rest, _, query = rest.partition("?")
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path, query, fragment


def _name_and_suffix(labels: list[str]) -> tuple[str, str]:
    """The label that names a site, the first one or, after a short one like www in a host of four or more, the second; and the last label."""
    if not labels:
        return "", ""
    return labels[1 if len(labels) > 3 and len(labels[0]) <= 4 else 0], labels[-1]


def lexical(url: str | None) -> tuple[list[float], str, str]:
    """The features of LEXICAL, the site's name and its suffix; lexical_columns in plain Python, for training."""
    host, path, query, fragment = _parts(url)
    labels = [x for x in host.split(".") if x]
    letters = host + path
    digits = lambda s: sum("0" <= c <= "9" for c in s)
    numbers = [
        len(url or ""), len(host), len(path), len(labels), sum(1 for x in path.split("/") if x), digits(letters) / max(1, len(letters)), digits(host), host.count("-"),
        _entropy(host), _entropy(path), query.count("&") + 1 if query else 0, len(query), letters.count("%"), len(fragment), max(map(len, labels), default=0),
    ]
    return numbers, *_name_and_suffix(labels)


def lexical_columns(url: Column) -> dict[str, Column]:
    """The features of LEXICAL as doubles, and the strings `name` and `suffix`."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    host, path = host_and_path(url)
    query, fragment = F.regexp_extract(text, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.regexp_extract(text, r"(?s)^.*?://[^#]*#(.*)$", 1)
    labels = F.array_remove(F.split(host, r"\."), "")
    letters = F.concat(host, path)
    count = lambda s, c: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))
    digits = lambda s: F.regexp_count(s, F.lit("[0-9]"))

    def entropy(s: Column) -> Column:
        n = F.length(s)
        times = F.transform(F.array_distinct(F.split(s, "")), lambda c: n - F.length(F.replace(s, c, F.lit(""))))
        return F.when(n > 0, F.aggregate(times, F.lit(0.0), lambda a, t: a - t / n * F.log2(t / n))).otherwise(F.lit(0.0))

    numbers = [
        F.length(text), F.length(host), F.length(path), F.size(labels), F.size(F.array_remove(F.split(path, "/"), "")), digits(letters) / F.greatest(F.lit(1), F.length(letters)), digits(host), count(host, "-"),
        entropy(host), entropy(path), F.when(query != "", count(query, "&") + 1).otherwise(0), F.length(query), count(letters, "%"), F.length(fragment), F.coalesce(F.array_max(F.transform(labels, F.length)), F.lit(0)),
    ]
    first = F.when((F.size(labels) > 3) & (F.length(F.get(labels, 0)) <= 4), F.get(labels, 1)).otherwise(F.get(labels, 0))
    strings = {"name": F.coalesce(first, F.lit("")), "suffix": F.coalesce(F.get(labels, F.size(labels) - 1), F.lit(""))}
    return {n: c.cast("double") for n, c in zip(LEXICAL, numbers, strict=True)} | strings


def _suffix_keys(name: str, suffix: str) -> list[str]:
    """What statistics are kept of: the suffix, and the name's endings under a leading star."""
    return [suffix, *(f"*{name[-k:]}" for k in ENDINGS)]


def suffix_statistics(rows: list[tuple[str, str, int]], prior: float, strength: float = 4.0) -> dict[str, tuple[float, int]]:
    """Smoothed share of bad URLs, and number, of each suffix and ending in rows (name, suffix, label)."""
    by: dict[str, list[int]] = defaultdict(list)
    for name, suffix, label in rows:
        for key in _suffix_keys(name, suffix):
            by[key].append(label)
    return {s: ((sum(v) + strength * prior) / (len(v) + strength), len(v)) for s, v in by.items()}


def with_suffixes(numbers: np.ndarray, names: list[str], suffixes: list[str], known: dict[str, tuple[float, int]], prior: float) -> np.ndarray:
    """The columns of FEATURE_NAMES."""
    keys, none = [_suffix_keys(n, s) for n, s in zip(names, suffixes, strict=True)], (prior, 0)
    rates = np.array([[known.get(k, none)[0] for k in own] for own in keys], np.float64).reshape(len(keys), 1 + len(ENDINGS))
    seen = np.log1p([[known.get(k, none)[1] for k in (own[0], own[-1])] for own in keys]).reshape(len(keys), 2)
    return np.column_stack([numbers.reshape(len(keys), len(LEXICAL)), rates[:, :1], seen, rates[:, 1:]])


@dataclass
class Tree:
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (inner := self.feature[at] >= 0).any():
            f, c = self.feature[at], self.cut[at]
            goes = x[np.arange(len(x)), np.maximum(f, 0)] > c
            at = np.where(inner, 2 * at + 1 + goes, at)
        return self.value[at]


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, cuts: list[np.ndarray], least: float, ridge: float) -> Tree:
    size = 2 ** (depth + 1) - 1
    tree = Tree(np.full(size, -1), np.zeros(size), np.zeros(size))

    def node(at: int, rows: np.ndarray, left: int) -> None:
        gs, hs = g[rows].sum(), h[rows].sum()
        tree.value[at] = -gs / (hs + ridge)
        best = (1e-6, -1, 0.0)
        if left:
            for f, own in enumerate(cuts):
                low = x[rows, f][:, None] <= own[None, :]
                gl, hl = g[rows] @ low, h[rows] @ low
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(hl < least) | (hs - hl < least)] = -1
                k = int(np.argmax(gain)) if len(gain) else -1
                if k >= 0 and gain[k] > best[0]:
                    best = (float(gain[k]), f, float(own[k]))
        if best[1] < 0:
            return
        tree.feature[at], tree.cut[at] = best[1], best[2]
        low = x[rows, best[1]] <= best[2]
        node(2 * at + 1, rows[low], left - 1)
        node(2 * at + 2, rows[~low], left - 1)

    node(0, np.arange(len(x)), depth)
    return tree


@dataclass
class Booster:
    """Trees on the log odds of a URL being bad."""

    base: float
    rate: float
    trees: list[Tree]
    suffixes: dict[str, tuple[float, int]]
    prior: float

    def of_features(self, numbers: np.ndarray, names: list[str], suffixes: list[str]) -> np.ndarray:
        x = with_suffixes(numbers, names, suffixes, self.suffixes, self.prior)
        return 1 / (1 + np.exp(-np.clip(self.base + self.rate * sum((t(x) for t in self.trees), np.zeros(len(x))), -30, 30)))

    def probability(self, urls: list[str | None]) -> np.ndarray:
        rows = [lexical(u) for u in urls]
        return self.of_features(np.array([r[0] for r in rows], np.float64), [r[1] for r in rows], [r[2] for r in rows])


def train(labelled: list[tuple[str, int]], rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 24, folds: int = 4) -> Booster:
    """Newton boosting of the log loss; split candidates are quantiles of each feature. label 1: bad.

    A training URL comes twice: with suffix statistics from the names of other folds, and with none, as a URL whose suffixes
    nobody has seen. So trees learn what suffixes say of new names, and to go by the rest where they say nothing.
    """
    y = np.array([label for _, label in labelled], np.float64)
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 1e-3
    rows = [lexical(u) for u, _ in labelled]
    told = [(name, suffix, label) for (_, name, suffix), (_, label) in zip(rows, labelled, strict=True)]
    model = Booster(math.log(prior / (1 - prior)), rate, [], suffix_statistics(told, prior), prior)
    if not len(y) or y.min() == y.max():
        return model
    fold = np.array([zlib.crc32(name.encode()) % folds for name, _, _ in told])
    x = np.zeros((len(y), len(FEATURE_NAMES)))
    for f in range(folds):
        own = np.flatnonzero(fold == f)
        others = suffix_statistics([told[i] for i in np.flatnonzero(fold != f)], prior)
        x[own] = with_suffixes(np.array([rows[i][0] for i in own], np.float64), [told[i][0] for i in own], [told[i][1] for i in own], others, prior)
    bare = with_suffixes(np.array([r[0] for r in rows], np.float64), [r[1] for r in rows], [r[2] for r in rows], {}, prior)
    x, y = np.concatenate([x, bare]), np.concatenate([y, y])
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[:-1], method="lower")) for f in range(x.shape[1])]
    odds = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-odds))
        tree = _grow(x, p - y, np.maximum(p * (1 - p), 1e-6), depth, cuts, least=0.3, ridge=1.0)
        model.trees.append(tree)
        odds += rate * tree(x)
    return model


def fit(labelled: DataFrame, max_train: int = 20_000) -> Booster:
    """Train on at most max_train rows of labelled (url, label), those whose hashes come first; rows with a null are passed over."""
    rows = labelled.where("url is not null and label in (0, 1)").select("url", F.col("label").cast("int").alias("label"))
    got = rows.orderBy(F.xxhash64(F.lit(13), "url"), "url", "label").limit(max_train).collect()
    return train([(r["url"], r["label"]) for r in got])


def judge(pages: DataFrame, model: Booster, rules: list[tuple[str, str]] = RULES, threshold: float = 0.7) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad) for each row of pages (page_id, url; further columns don't matter).

    host and path of a null url, or one without ://, are empty. verdict is that of the longest fitting rule; without one it
    is block where the trees' probability `bad` reaches the threshold. A url without a host shows nothing to judge: allow.
    Null, repeated and very long urls and page_ids are rows like others; an empty table gives an empty result.
    """
    url = F.col("url").cast("string")
    host, path = host_and_path(url)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), *(c.alias(n) for n, c in lexical_columns(url).items()))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))

    def work(batch: pa.RecordBatch) -> dict:
        numbers = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in LEXICAL])
        bad = model.of_features(numbers, batch.column("name").to_pylist(), batch.column("suffix").to_pylist())
        return {c: batch.column(c) for c in ("page_id", "host", "path", "rule")} | {"bad": bad}

    judged = in_batches(rows, "page_id long, host string, path string, rule string, bad double", work)
    action = F.lit(None).cast("string")
    for what, rule in rules:
        action = F.when(F.col("rule") == rule, F.lit(what)).otherwise(action)
    own = F.when((F.col("host") != "") & (F.col("bad") >= threshold), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce(action, own).alias("verdict"), "bad")


#: Names of generated sites: what link, betting, drug, loan, adult and warez farms sell, and what other sites are about. The
#: words before them are the same for both.
SOLD = "betting bingo casino cracked dosage escorts followers forex giveaway handbags hookups jackpot keygen lender loans lottery payday pharmacy poker prizes replicas roulette slots steroids tablets torrents warez webcams".split()
SUBJECTS = "academy archive bakery college council cycling farm field forest garden gazette harbor history hospital institute journal kitchen letters library market mountain museum notes observatory orchestra press railway review river school science society station theatre village weather workshop".split()
BEFORE = "best blue cheap city daily free green my new north old online open royal super top track win".split()


def seed_urls(sold: list[str] = SOLD, subjects: list[str] = SUBJECTS, each: int = 24, seed: int = 20) -> list[tuple[str, int]]:
    """Labelled URLs for want of a labelled table, (url, 1 for bad).

    Both classes have plain and compound names, queries and fragments; those of farms have hyphens, digits, deep
    paths, many parameters and random strings more often, as published studies of spam URLs find.
    """
    rnd = random.Random(seed)
    letters, some = "abcdefghijklmnopqrstuvwxyz0123456789", lambda share: rnd.random() < share
    code = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    out = []
    for nouns, bad in ((sold, 1), (subjects, 0)):
        for noun in nouns:
            for _ in range(each):
                name = noun if some(0.15 if bad else 0.6) else rnd.choice(BEFORE) + ("-" if some(0.9 if bad else 0.4) else "") + noun
                if some(0.4 if bad else 0.01):
                    name += rnd.choice(["-", ""]) + rnd.choice(["24", "4u", "777", "365", code(3)])
                host = f"{rnd.choice(['', '', 'www.', 'm.', 'blog.'])}{name}.example.{rnd.choice(['com', 'net', 'org'])}"
                path = rnd.choice(["/en/{0}", "/de/{0}.html", "/fr/{0}/", "/es/{0}", "/news/2024/{0}", "/", "/{0}"]).format(rnd.randrange(1, 9999))
                if some(0.5 if bad else 0.02):
                    path += "/".join(["", *(code(rnd.randint(4, 12)) for _ in range(rnd.randint(1, 4)))])
                names = rnd.sample(["page", "ref", "utm_source", "id", "aff", "click", "sid", "src"], rnd.choice([0, 0, 3, 4, 6] if bad else [0, 0, 0, 1, 2]))
                query = "&".join(f"{n}={code(rnd.randint(6, 16) if bad else rnd.randint(1, 5))}" for n in names)
                out.append((f"{rnd.choice(['http', 'https', 'https'])}://{host}{path}{'?' + query if query else ''}{'#top' if some(0.15) else ''}", bad))
    return out


SEED_URLS = seed_urls()
